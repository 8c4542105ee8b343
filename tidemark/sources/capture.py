"""Capture files to packets, datagrams, segments and typed messages, and back.

Small files are read whole by Spark's binary source, so any store that Spark reads will do. Files
of any size go through a source of their own: one pass over the record headers cuts a file at
records into ranges, and every range is a task. From packets on, each step is an Arrow-batched map
in NumPy columns; no row becomes a Python dict. Steps that follow each other go in one map
(:func:`chain`), so a task has one Python worker for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import wire
from tidemark.tables import stored

PACKETS = "capture_id string, format string, linktype long, packet_no long, ts_nanos long, data binary, orig_len long, position long"
DATAGRAMS = "capture_id string, packet_no long, ts_nanos long, skip string, src_port int, dst_port int, dst_ip string, payload binary"
SEGMENT = "version int, protocol int, channel long, session long, message_count int, stream_offset long, first_sequence long, send_time long, messages array<binary>"
SEGMENTS = "capture_id string, packet_no long, ts_nanos long, " + SEGMENT
MESSAGES = (
    "capture_id string, packet_no long, msg_no long, channel long, session long, sequence long, kind int, ts_nanos long, flags int, symbol string, symbol_raw binary, size long, price long, trade_id long, "
    "sale_condition int, event int, status int, reason string, round_lot long, adj_poc long, luld_tier int, value int, detail int, price_type int, auction_type int, paired long, ref_price long, "
    "indicative_price long, imbalance long, imbalance_side int, raw binary, error string"
)
#: Rows of a batch that the maps below emit at once, bytes of its packets, and bytes of a file that one task reads.
OUT_ROWS, OUT_BYTES, RANGE_BYTES = 20_000, 8 << 20, 128 << 20


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}


def _fields(schema: str) -> dict[str, pa.DataType]:
    return {n: _KINDS[t] for n, t in (f.strip().split(" ") for f in schema.split(","))}


def _batch(schema: str, columns: dict) -> pa.RecordBatch:
    kinds = _fields(schema)
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[n], pa.Array) else pa.array(c, t) for n, t in kinds.items()], list(kinds))


def _packet_batches(name: str, kind: str, link: int | None, number: int, found):
    """Packets numbered from ``number``, so many at a time as :data:`OUT_ROWS` and :data:`OUT_BYTES` allow (a larger one alone)."""
    rows, held = [], 0

    def batch():
        ts, data, orig, position = zip(*rows, strict=True) if rows else ((), (), (), ())
        n = len(rows)
        return _batch(PACKETS, {"capture_id": [name] * n, "format": [kind] * n, "linktype": [link] * n, "packet_no": range(number, number + n), "ts_nanos": ts, "data": data, "orig_len": orig, "position": position})

    for row in found:
        if rows and (len(rows) >= OUT_ROWS or held + len(row[1]) > OUT_BYTES):
            yield batch()
            number, rows, held = number + len(rows), [], 0
        rows.append(row)
        held += len(row[1])
    yield batch()


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """The packets of every capture file under ``path``, each up to 2 GB; a file of an unknown format is an error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return packets_of(files.withColumnRenamed("path", "capture_id"))


def packets_of(files: DataFrame) -> DataFrame:
    """Packets of ``(capture_id, content)`` rows."""
    return chain(files, "packets")


def _packets(batches):
    for batch in batches:
        for name, content in zip(batch.column("capture_id").to_pylist(), batch.column("content"), strict=True):
            kind, link, found = wire.packets(content.as_py())
            yield from _packet_batches(name, kind, link, 0, found)


RANGES = "path string, format string, first_packet long, start long, stop long, state string"


def large_ranges(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges of whole records of capture files of any size, found by one pass over their record headers: a task for each file.

    The files lie where executors can open them by these paths; headers alone are read.
    """

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = list(wire.record_ranges(path, range_bytes))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield _batch(RANGES, {"path": [path] * len(rows), **dict(zip(("format", "first_packet", "start", "stop", "state"), columns, strict=True))})

    found = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return found.mapInArrow(run, RANGES)


def read_large(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The packets of capture files of any size: one task reads one range. The rows are those of :func:`read_packets`."""
    ranges = stored(large_ranges(spark, paths, range_bytes), "capture-ranges")  # counted, then read: the headers are walked once

    def run(batches):
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path, kind, first, start, stop, state = row
                link, found = wire.range_packets(path, kind, start, stop, state)
                yield from _packet_batches(path, kind, link, first, found)

    number = ranges.count()
    return ranges.repartition(max(1, number), "path", "start").mapInArrow(run, PACKETS)


def _pieces(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a column of byte strings, where each begins, and its size (0 for null)."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    sizes = np.where(np.asarray(column.is_valid()), np.diff(edges), 0)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), edges[:-1], sizes


def _binary(data: np.ndarray, places: np.ndarray, sizes: np.ndarray, absent: np.ndarray | None = None) -> pa.Array:
    """A column of the pieces of ``data``, null where ``absent``."""
    offsets, values = wire.gathered(data, places, sizes)
    valid = None if absent is None else pa.py_buffer(np.packbits(~absent, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), len(sizes), [valid, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def datagrams(packets: DataFrame) -> DataFrame:
    """One row for each packet: its datagram, or in ``skip`` why there is none. A null packet is too short."""
    return chain(packets, "datagrams")


def _datagrams(batches):
    reasons = np.array(wire.SKIPS, object)
    for batch in batches:
        data, starts, sizes = _pieces(batch.column("data"))
        found = wire.datagrams(data, starts, sizes)
        skipped = found["code"] > 0
        address = wire.addresses(found["dst_ip"])
        columns = {
            "skip": reasons[found["code"]].tolist(), "src_port": pa.array(found["src_port"], pa.int32()), "dst_port": pa.array(found["dst_port"], pa.int32()),
            "dst_ip": pa.array(address, pa.string(), mask=skipped) if len(skipped) else [], "payload": _binary(data, found["start"], found["size"], skipped),
        }
        yield _batch(DATAGRAMS, {**{n: batch.column(n) for n in ("capture_id", "packet_no", "ts_nanos")}, **columns})


def segments(found: DataFrame) -> DataFrame:
    """The segments of datagrams; payloads too short for a header give none."""
    return chain(found.where("skip IS NULL"), "segments")


def _segments(batches):
    kinds = _fields(SEGMENT)
    for batch in batches:
        batch = batch.filter(batch.column("skip").is_null())
        data, starts, sizes = _pieces(batch.column("payload"))
        whole, headers, owner, places, lengths = wire.segments(data, starts, sizes)
        own = batch.filter(pa.array(whole))
        edges = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(headers)))]).astype(np.int32)
        columns = {n: pa.array(headers[n].astype(np.int64)).cast(kinds[n]) for n in kinds if n != "messages"}
        columns["messages"] = pa.ListArray.from_arrays(pa.array(edges), _binary(data, places, lengths))
        yield _batch(SEGMENTS, {**{n: own.column(n) for n in ("capture_id", "packet_no", "ts_nanos")}, **columns})


def heartbeats(found: DataFrame) -> DataFrame:
    return found.where("message_count = 0")


def messages(found: DataFrame) -> DataFrame:
    """Typed messages of segments, one wide row each; unknown kinds and errors keep their bytes in ``raw``."""
    return chain(found, "messages")


def _messages(batches):
    kinds = _fields(MESSAGES)
    for whole in batches:
        for batch in _within(whole, np.diff(whole.column("messages").offsets.to_numpy()), OUT_ROWS):
            lists = batch.column("messages")
            per_row = np.diff(lists.offsets.to_numpy())
            bodies = lists.flatten()
            owner = np.repeat(np.arange(batch.num_rows), per_row)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
            edges = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset : bodies.offset + len(bodies) + 1].astype(np.int64) if len(bodies) else np.zeros(1, np.int64)
            data = np.frombuffer(bodies.buffers()[2], np.uint8) if len(bodies) and bodies.buffers()[2] else np.empty(0, np.uint8)
            parsed = wire.messages(data, edges[:-1], np.diff(edges))
            columns = {n: batch.column(n).take(pa.array(owner)) for n in ("capture_id", "packet_no", "channel", "session")}
            columns |= {"msg_no": pa.array(number, pa.int64()), "sequence": pa.array(batch.column("first_sequence").to_numpy()[owner] + number, pa.int64()), "raw": bodies}
            for name, values in parsed.items():
                columns[name] = pa.array(values[0], mask=~values[1]).cast(kinds[name]) if isinstance(values, tuple) else pa.array(values, kinds[name])
            yield _batch(MESSAGES, columns)


def _within(batch: pa.RecordBatch, weights: np.ndarray, most: int):
    """Successive rows of ``batch`` whose weights come to ``most`` together; a heavier row is alone."""
    sums, at = np.cumsum(weights), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


#: What each step reads, does to batches and returns.
_STEPS = {
    "packets": (("capture_id", "content"), _packets, PACKETS),
    "datagrams": (("capture_id", "packet_no", "ts_nanos", "data"), _datagrams, DATAGRAMS),
    "segments": (("capture_id", "packet_no", "ts_nanos", "skip", "payload"), _segments, SEGMENTS),
    "messages": (("capture_id", "packet_no", "channel", "session", "first_sequence", "messages"), _messages, MESSAGES),
}


def chain(rows: DataFrame, *steps: str) -> DataFrame:
    """Successive steps of ``packets``, ``datagrams``, ``segments`` and ``messages`` over ``rows`` in one map: the rows of the operators one after the other.

    Maps that follow each other have a Python worker each in every task, all alive at once. A chain
    has one worker, which holds a bounded batch of each step.
    """
    made = [_STEPS[step][1] for step in steps]

    def run(batches):
        for step in made:
            batches = step(batches)
        return batches

    return rows.select(*_STEPS[steps[0]][0]).mapInArrow(run, _STEPS[steps[-1]][2])


def skip_counts(found: DataFrame) -> DataFrame:
    return found.groupBy(F.coalesce("skip", F.lit("datagram")).alias("reason")).agg(F.count("*").alias("n"))


def kind_lengths(found: DataFrame) -> DataFrame:
    """Messages by kind and length; ``second`` flags every length but a kind's most frequent."""
    from pyspark.sql import Window

    n = found.groupBy("kind", F.length("raw").alias("length")).agg(F.count("*").alias("n"))
    return n.withColumn("second", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "length")) > 1)


def encode_updates(updates: DataFrame, segment_messages: int = 5, session: int = 7_001, packets_per_capture: int = 4_000) -> DataFrame:
    """Packets that carry price-level updates in order of ``seq``: ``(capture_id, packet_no, ts_nanos, data)``.

    A segment has the updates of ``segment_messages`` successive sequence numbers, a capture the
    segments of ``packets_per_capture``: a capture is one bounded group, its bodies one array.
    """
    segment = F.floor(F.col("seq") / segment_messages).cast("long")
    rows = updates.select(F.floor(segment / packets_per_capture).cast("long").alias("capture"), segment.alias("segment"), "seq", "symbol", "side", "flags", "size", "price", "ts_nanos")
    layout = wire.LAYOUTS[0x38]

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("seq", "ascending")])
        own, seq, ts = (table[c].to_numpy() for c in ("segment", "seq", "ts_nanos"))
        bodies = np.zeros(len(seq), layout)
        for name in ("flags", "size", "price", "ts_nanos"):
            bodies[name] = table[name].to_numpy()
        bodies["kind"] = np.where(table["side"].to_numpy(zero_copy_only=False) == "B", 0x38, 0x35)
        bodies["symbol"] = np.array([s.encode()[:8].ljust(8) for s in table["symbol"].to_pylist()]).view("V8")
        cut = np.frombuffer(bodies.tobytes(), f"V{layout.itemsize}").tolist()
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ends = [*first[1:].tolist(), len(own)]
        frames = [wire.frame_bytes(wire.segment_bytes(cut[a:b], session, int(seq[a]) + 1, send_time=int(ts[b - 1]))) for a, b in zip(first.tolist(), ends, strict=True)]
        name = f"capture-{table['capture'][0].as_py():06d}"
        return pa.table({"capture_id": [name] * len(first), "packet_no": pa.array(own[first] % packets_per_capture), "ts_nanos": pa.array(ts[np.array(ends) - 1]), "data": pa.array(frames, pa.binary())})

    return rows.groupBy("capture").applyInArrow(build, "capture_id string, packet_no long, ts_nanos long, data binary")


def encode_messages(rows: DataFrame) -> DataFrame:
    """``rows`` with ``body``, the message of their ``kind``, ``ts_nanos`` and field columns (null is 0 or blank)."""
    schema = T.StructType([*rows.schema.fields, T.StructField("body", T.BinaryType())])
    names = rows.columns

    def run(batches):
        for batch in batches:
            kinds, bodies = batch.column(names.index("kind")).to_numpy(), [None] * batch.num_rows
            for kind in np.unique(kinds).tolist():
                mine, layout = np.flatnonzero(kinds == kind), wire.LAYOUTS[kind]
                own, made = batch.take(pa.array(mine)), np.zeros(len(mine), layout)
                for name in layout.names:
                    if name in wire.TEXTS:
                        texts = own.column(names.index(name)).to_pylist() if name in names else [""] * len(mine)
                        made[name] = np.array([(t or "").encode()[: wire.TEXTS[name]].ljust(wire.TEXTS[name]) for t in texts]).view(f"V{wire.TEXTS[name]}")
                    elif name in names:
                        made[name] = own.column(names.index(name)).fill_null(0).to_numpy()
                for i, body in zip(mine.tolist(), np.frombuffer(made.tobytes(), f"V{layout.itemsize}").tolist(), strict=True):
                    bodies[i] = body
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bodies, pa.binary())], [*names, "body"])

    return rows.mapInArrow(run, schema)


def encode_segments(rows: DataFrame) -> DataFrame:
    """Packets of segments ``(capture_id, packet_no, ts_nanos, channel, session, first_sequence, bodies array<binary>)``."""

    def run(batches):
        for batch in batches:
            *_, channel, session, first, bodies = (c.to_pylist() for c in batch.columns)
            frames = [wire.frame_bytes(wire.segment_bytes(b, s, f, channel=c)) for c, s, f, b in zip(channel, session, first, bodies, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(frames, pa.binary())], ["capture_id", "packet_no", "ts_nanos", "data"])

    chosen = rows.select("capture_id", *(F.col(c).cast("long").alias(c) for c in ("packet_no", "ts_nanos", "channel", "session", "first_sequence")), "bodies")
    return chosen.mapInArrow(run, "capture_id string, packet_no long, ts_nanos long, data binary")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """``(path, day, n_bytes)`` of the capture files under ``path``; the day is the date in a file's name. No content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pcap*").load(path).select("path", "length")
    day = F.to_date(F.nullif(F.regexp_extract(F.element_at(F.split("path", "/"), -1), "([0-9]{8})", 1), F.lit("")), "yyyyMMdd")
    return files.select("path", day.alias("day"), F.col("length").alias("n_bytes"))


def _file(table: pa.Table, form: str) -> pa.RecordBatch:
    table = table.sort_by([("packet_no", "ascending")])
    items = list(zip(table["ts_nanos"].to_pylist(), table["data"].to_pylist(), strict=True))
    content = wire.pcap_bytes(items) if form == "pcap" else wire.pcapng_bytes(items, tsresol=9)
    return pa.record_batch({"capture_id": table["capture_id"].slice(0, 1).combine_chunks(), "content": pa.array([content], pa.binary())})


def capture_files(packets: DataFrame, form: str = "pcap") -> DataFrame:
    """``(capture_id, content)``: a file of each capture's packets in order of ``packet_no``, classic with microsecond times or pcapng with nanoseconds."""

    def build(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_file(table, form)])

    return packets.select("capture_id", "packet_no", "ts_nanos", "data").groupBy("capture_id").applyInArrow(build, "capture_id string, content binary")


def through_files(packets: DataFrame, *steps: str, form: str = "pcap") -> DataFrame:
    """``chain(capture_files(packets, form), *steps)``, with every file read where it was written: one worker in each task, which holds one file at a time."""
    made = [_STEPS[step][1] for step in steps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = iter([_file(pa.Table.from_batches(batches), form)])
        for step in made:
            found = step(found)
        return found

    return packets.select("capture_id", "packet_no", "ts_nanos", "data").groupBy("capture_id").applyInArrow(run, _STEPS[steps[-1]][2])
