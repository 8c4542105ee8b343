"""``spark.read.format("capture")``: capture files of any size as packets, one task for each range of bytes.

No pass over a file comes first. A range's task looks for the first record that begins in it: it
takes every place of a window some records before the range that could be a header, follows each
chain of headers to the range, and goes on where all chains that get there meet. The true chain is
always among them, as its headers are plausible by the bounds below, which reading checks of every
record. Where chains don't meet in one place, the file is walked from its start. So each record
belongs to exactly one range, whatever the bytes of its packets look like.

What can't be read is a row too: ``error`` says why and ``position`` where, beside the packets before it.
"""

from __future__ import annotations

import fnmatch
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tidemark.functions import wire

SCHEMA = "capture_id string, range_no long, format string, linktype long, ts_nanos long, data binary, orig_len long, position long, error string"
#: Fixed value: the largest record that counts as one (the public tools' largest snapshot length, and block headers).
MOST = 262_144 + 64
#: Bytes of a range, of the window before it in which chains begin and run, of a file's start where interfaces are declared; rows of a batch.
RANGE_BYTES, LOOK_BACK, HEAD, OUT_ROWS = 128 << 20, 2 * MOST, 1 << 20, 20_000
CUT, IMPLAUSIBLE, SHORT_HEADER, BAD_MAGIC, LATE_SECTION, LATE_INTERFACE = "cut_record", "implausible_record", "truncated_header", "bad_magic", "section_beyond_first_range", "undeclared_interface"


class Layout:
    """What a file's first bytes say: the format, byte order, time units and link type."""

    def __init__(self, head: bytes):
        self.error = None
        self.kind, self.order, self.unit, self.units, self.link, self.first = "unknown", "<", 1000, [], None, 0
        if head[:4] == b"\x0a\x0d\x0d\x0a":
            self.kind = "pcapng"
            self.order = ">" if head[8:12] == b"\x1a\x2b\x3c\x4d" else "<"
            for n, (order, kind, body, _) in enumerate(wire._walk(head)):
                if kind in (wire.ENHANCED, wire.SIMPLE) or (kind == wire.SECTION and n):
                    break
                if kind == wire.INTERFACE:
                    self.units.append(wire._unit(order, body))
                    self.link = struct.unpack_from(order + "H", body)[0] if self.link is None and len(body) >= 2 else self.link
        elif head[:4] in wire.CLASSIC:
            self.kind, (self.order, self.unit), self.first = "pcap", wire.CLASSIC[head[:4]], 24
            if len(head) < 24:
                self.error = SHORT_HEADER
            else:
                self.link = struct.unpack_from(self.order + "I", head, 20)[0]
        else:
            self.error = f"{BAD_MAGIC}: {head[:4].hex()}"

    def nexts(self, data: np.ndarray, base: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The places in ``data`` (the bytes from ``base``) that could begin a record, and where the next one would; ``end`` where a record is the file's last, whole or cut."""
        word = lambda at, n: sum(data[at + k : at + k + n].astype(np.int64) << (8 * (k if self.order == "<" else 3 - k)) for k in range(4))
        n = len(data) - 15
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.kind == "pcap":
            size = word(8, n) + 16
            whole = word(12, n)  # without this a chain four bytes off goes on for ever where nothing was cut
            good = (size <= MOST) & (word(4, n) * self.unit < 1_000_000_000) & (whole >= size - 16) & (whole <= MOST)
        else:
            size = word(4, n)
            good = (size >= 12) & (size <= MOST) & (size % 4 == 0) & ((base + np.arange(n)) % 4 == 0)
        at = np.flatnonzero(good)
        following = at + size[at]
        if self.kind == "pcapng":  # the length stands at the block's end too
            inside = following <= len(data)
            ends = np.where(inside, following, 4)[:, None] - 4 + np.arange(4)
            tail = (data[ends].astype(np.int64) << (8 * np.arange(4)[:: 1 if self.order == "<" else -1])).sum(1)
            at, following = at[~inside | (tail == size[at])], following[~inside | (tail == size[at])]
        return base + at, np.minimum(base + following, end)


def find_border(layout: Layout, read, start: int, size: int, look_back: int = LOOK_BACK) -> int:
    """The first place from ``start`` at which a record begins, or the file's end; ``read(at, n)`` gives bytes of the file."""
    low = start - look_back
    if low > layout.first:
        data = np.frombuffer(read(low, look_back + MOST), np.uint8)
        places, following = layout.nexts(data, low, size)
        meets: dict[int, int] = {size: size}
        tail = max(low + len(data) - 15, low)  # no whole header beyond; at the file's end none is needed
        for at, to in zip(places[::-1].tolist(), following[::-1].tolist(), strict=True):
            if at >= start:
                meets[at] = at
            elif to >= size - 15 and low + len(data) >= size:
                meets[at] = to if to >= start else size  # what is left is the tail of a cut record
            elif to in meets:
                meets[at] = meets[to]
            elif to >= tail:
                meets[at] = to
        window = low + min(look_back, MOST)
        borders = {to for at, to in meets.items() if low <= at < window and at < start}
        if len(borders) == 1:
            return borders.pop()
    return _walked_border(layout, read, start, size)


def _walked_border(layout: Layout, read, start: int, size: int, step: int = 8 << 20) -> int:
    """The same by walking all headers from the file's start."""
    at, base, data = layout.first, 0, b""
    place, extra = (8, 16) if layout.kind == "pcap" else (4, 0)
    while at < start and at + 16 - 4 * (extra == 0) <= size:
        if at + 16 > base + len(data):
            base, data = at, read(at, step)
        length = struct.unpack_from(layout.order + "I", data, at - base + place)[0] + extra if len(data) - (at - base) >= place + 4 else MOST + 1
        if not 12 <= length <= MOST:  # reading says so where the record begins
            return size
        at += length
    return min(at, size) if at >= start else size


@dataclass
class Range(InputPartition):
    path: str
    capture_id: str
    number: int
    start: int
    stop: int
    size: int


def _open(path: str):
    """The file system of a path and the path in it: local paths and every scheme that Arrow knows."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if colon and scheme == "file":
        path = "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(path)


class CaptureReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path") or ""
        self.range_bytes, self.look_back = int(options.get("rangeBytes", RANGE_BYTES)), int(options.get("lookBack", LOOK_BACK))
        self.ids: set | None = None
        self.since, self.until = -(1 << 63), (1 << 63) - 1

    def pushFilters(self, filters):
        """Files that filters on ``capture_id`` exclude aren't opened; packets outside bounds on ``ts_nanos`` aren't made into rows."""
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if name == ("capture_id",) and isinstance(f, (EqualTo, In)):
                chosen = set(f.value if isinstance(f, In) else [f.value])
                self.ids = chosen if self.ids is None else self.ids & chosen
            elif name == ("ts_nanos",) and isinstance(value, int) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.since = max(self.since, value + isinstance(f, GreaterThan))
            elif name == ("ts_nanos",) and isinstance(value, int) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.until = min(self.until, value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[Range]:
        """Ranges of all files by their sizes alone; no file is opened."""
        from pyarrow import fs

        system, root = _open(self.path)
        pattern = None
        if any(c in root for c in "*?["):
            root, _, pattern = root.rpartition("/")
        info = system.get_file_info(root)
        found = system.get_file_info(fs.FileSelector(root)) if info.type == fs.FileType.Directory else [info]
        prefix = "file:" if isinstance(system, fs.LocalFileSystem) else self.path[: self.path.index("://") + 3]
        ranges = []
        for one in sorted(found, key=lambda i: i.path):
            if one.type != fs.FileType.File or one.base_name[:1] in "._" or (pattern and not fnmatch.fnmatchcase(one.base_name, pattern)):
                continue
            name = prefix + one.path
            if self.ids is None or name in self.ids:
                starts = range(0, max(one.size, 1), self.range_bytes)
                ranges += [Range(one.path, name, k, at, min(at + self.range_bytes, one.size), one.size) for k, at in enumerate(starts)]
        return ranges or [Range("", "", 0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = _open(self.path)
        with system.open_input_file(partition.path) as file:

            def read(at: int, n: int) -> bytes:
                return file.read_at(min(n, partition.size - at), at) if at < partition.size else b""

            layout, rows = Layout(read(0, HEAD)), []
            for row in self._rows(layout, read, partition):
                if row[4] is not None or self.since <= row[0] <= self.until:
                    rows.append(row)
                if len(rows) >= OUT_ROWS:
                    yield _batch(partition, layout, rows)
                    rows = []
            yield _batch(partition, layout, rows)

    def _rows(self, layout: Layout, read, part: Range) -> Iterator[tuple]:
        """``(ts_nanos, data, orig_len, position, error)`` of the records that begin in the range."""
        if layout.error:
            if part.number == 0:
                yield None, None, None, 0, layout.error
            return
        at = layout.first if part.start <= layout.first else find_border(layout, read, part.start, part.size, self.look_back)
        records = self._records if layout.kind == "pcap" else self._blocks
        if at < part.stop:
            yield from records(layout, read, part, at)

    def _records(self, layout: Layout, read, part: Range, at: int) -> Iterator[tuple]:
        head, data, base, limit = struct.Struct(layout.order + "IIII"), b"", at, 1_000_000_000 // layout.unit
        while at < part.stop:
            if at + MOST > base + len(data) and base + len(data) < part.size:
                base, data = at, read(at, min(part.stop - at, 32 << 20) + MOST)
            if at + 16 > part.size:
                yield None, None, None, at, CUT
                return
            sec, fraction, size, orig = head.unpack_from(data, at - base)
            if size + 16 > MOST or fraction >= limit or not size <= orig <= MOST:
                yield None, None, None, at, IMPLAUSIBLE
                return
            if at + 16 + size > part.size:
                yield None, None, None, at, CUT
                return
            yield sec * 1_000_000_000 + fraction * layout.unit, data[at - base + 16 : at - base + 16 + size], orig, at + 16 + size, None
            at += 16 + size

    def _blocks(self, layout: Layout, read, part: Range, at: int) -> Iterator[tuple]:
        order, data, base = layout.order, b"", at
        units = list(layout.units) if at else []  # the first range meets the declarations again
        while at < part.stop:
            if at + MOST > base + len(data) and base + len(data) < part.size:
                base, data = at, read(at, min(part.stop - at, 32 << 20) + MOST)
            if at + 12 > part.size:
                yield None, None, None, at, CUT
                return
            place = at - base
            if data[place : place + 4] == b"\x0a\x0d\x0d\x0a":
                if part.number or (at and part.stop < part.size):  # the ranges after this one don't know of it
                    yield None, None, None, at, LATE_SECTION
                    return
                order, units = ">" if data[place + 8 : place + 12] == b"\x1a\x2b\x3c\x4d" else "<", []
            kind, size = struct.unpack_from(order + "II", data, place)
            if not 12 <= size <= MOST:
                yield None, None, None, at, IMPLAUSIBLE
                return
            if at + size > part.size:
                yield None, None, None, at, CUT
                return
            body = data[place + 8 : place + size - 4]
            if kind == wire.INTERFACE:
                units.append(wire._unit(order, body))
            packet = wire.packet_of(order, kind, body, units)
            if packet:
                if kind == wire.ENHANCED and part.number and struct.unpack_from(order + "I", body)[0] >= len(units):
                    yield None, None, None, at, LATE_INTERFACE
                    return
                yield *packet, at + size, None
            at += size


def _batch(part: Range, layout: Layout, rows: list[tuple]) -> pa.RecordBatch:
    ts, data, orig, position, error = zip(*rows, strict=True) if rows else ((),) * 5
    n = len(rows)
    columns = [
        pa.array([part.capture_id] * n, pa.string()), pa.array([part.number] * n, pa.int64()), pa.array([layout.kind] * n, pa.string()), pa.array([layout.link] * n, pa.int64()), pa.array(ts, pa.int64()),
        pa.array(data, pa.binary()), pa.array(orig, pa.int64()), pa.array(position, pa.int64()), pa.array(error, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, [f.split(" ")[0] for f in SCHEMA.split(", ")])


class CaptureSource(DataSource):
    """Options: ``path`` (a file, a folder or a pattern), ``rangeBytes``, ``lookBack``."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)  # keys in any case


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)


def read_captures(spark: SparkSession, path: str, **options) -> DataFrame:
    """The rows of the format: packets, and ``error`` rows where reading a file ended early."""
    register(spark)
    return spark.read.format("capture").options(**options).load(path)


def packets(found: DataFrame) -> DataFrame:
    """The packets, numbered within their file: numbers within a range, and the packets of the ranges before it."""
    good = found.where("error IS NULL")
    before = Window.partitionBy("capture_id").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = good.groupBy("capture_id", "range_no").agg(F.count("*").alias("n")).select("capture_id", "range_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("capture_id", "range_no").orderBy("position")) - 1
    numbered = good.withColumn("within", within).join(starts, ["capture_id", "range_no"])
    return numbered.select("capture_id", "format", "linktype", (F.col("start") + F.col("within")).alias("packet_no"), "ts_nanos", "data", "orig_len", "position")


def errors(found: DataFrame) -> DataFrame:
    """What couldn't be read: ``(capture_id, position, reason)``."""
    return found.where("error IS NOT NULL").select("capture_id", "position", F.split("error", ":")[0].alias("reason"))


def write_captures(files: DataFrame, folder: str) -> DataFrame:
    """Writes ``(capture_id, content)`` as ``<capture_id>.pcap`` under a folder; gives ``(path, n_bytes)``. A task that runs again writes the same bytes."""

    def run(batches):
        for batch in batches:
            names = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, root = _open(folder)
                system.create_dir(root, recursive=True)
                with system.open_output_stream(f"{root}/{name}.pcap") as out:
                    out.write(content)
                names.append((f"{folder}/{name}.pcap", len(content)))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in names], pa.string()), pa.array([s for _, s in names], pa.int64())], ["path", "n_bytes"])

    return files.select("capture_id", "content").mapInArrow(run, "path string, n_bytes long")
