"""Registered queries from packets on, with DuckDB oracles: sequencing with resets and losses, the whole chain, all message kinds."""

from __future__ import annotations

import uuid
from pyspark.sql import functions as F

from tidemark.functions import wire
from tidemark.operators import book, flow, orders, sequencing
from tidemark.plans import feeds
from tidemark.queries import _FLOW, ORACLES, TOUCH, U, WIDTH, _fit_sql, _quotes, query
from tidemark.sources import capture, capture_source, quotes
from tidemark.tables import shared_dir

_SENT = "STRUCT(first BIGINT, action VARCHAR, epoch INTEGER)[]"


def fold_sql(arrivals: str, sessions: int, resync_at: int = 64) -> str:
    """A plain fold in SQL, one arrival a step: ``f`` has each arrival's action and what it set free, ``d`` the deliveries.

    Segments that wait are a list; ``resync_at`` of them force a resynchronisation; a segment has 5 messages.
    """
    return f"""WITH RECURSIVE {U},
a AS (SELECT *, session // {sessions} AS channel, row_number() OVER (PARTITION BY session // {sessions} ORDER BY arrival_no) AS i FROM ({arrivals})),
f AS (
    SELECT channel, i, arrival_no, session, session AS live, first_sequence + message_count AS due, []::BIGINT[] AS held, 0 AS epoch, CASE WHEN message_count = 0 THEN 'heartbeat' ELSE 'deliver' END AS action,
           CASE WHEN message_count = 0 THEN []::{_SENT} ELSE [{{'first': first_sequence, 'action': 'deliver', 'epoch': 0}}]::{_SENT} END AS sent, 0::BIGINT AS lost, 0 AS opened, 0 AS healed
    FROM a WHERE i = 1
  UNION ALL
    SELECT channel, i, arrival_no, session, CASE WHEN action = 'session_reset' THEN session ELSE live END, due3, list_filter(held2, lambda x: x >= due3), epoch2, action,
           list_concat(sent2, list_transform(range(due2, due3, 5), lambda x: {{'first': x, 'action': 'drained', 'epoch': epoch2}}))::{_SENT}, lost, opened,
           (due3 > due2 AND len(list_filter(held2, lambda x: x >= due3)) = 0)::INTEGER
    FROM (SELECT *, CASE WHEN action = 'deliver' OR resync THEN coalesce((SELECT max(e) FROM (
              SELECT x + 5 AS e, x - 5 * row_number() OVER (ORDER BY x) AS run FROM (SELECT DISTINCT unnest(held2) AS x) WHERE x >= due2) WHERE run = due2 - 5), due2) ELSE due2 END AS due3
        FROM (SELECT *, CASE WHEN resync THEN low + 5 ELSE due1 END AS due2, CASE WHEN resync THEN list_filter(held1, lambda x: x > low) ELSE held1 END AS held2, CASE WHEN resync THEN low - due1 ELSE 0 END AS lost,
                     epoch + (action = 'session_reset')::INTEGER + resync::INTEGER AS epoch2,
                     CASE WHEN action IN ('deliver', 'session_reset') THEN [{{'first': first_sequence, 'action': action, 'epoch': epoch + (action = 'session_reset')::INTEGER}}]::{_SENT}
                          WHEN resync THEN [{{'first': low, 'action': 'resync', 'epoch': epoch + 1}}]::{_SENT} ELSE []::{_SENT} END AS sent2
            FROM (SELECT *, action = 'buffered' AND len(held1) >= {resync_at} AS resync, list_min(held1) AS low
                FROM (SELECT *, CASE WHEN action IN ('deliver', 'session_reset') THEN first_sequence + message_count ELSE due END AS due1, (action = 'buffered' AND len(held) = 0)::INTEGER AS opened,
                             CASE WHEN action = 'session_reset' THEN []::BIGINT[] WHEN action = 'buffered' THEN list_distinct(list_append(held, first_sequence)) ELSE held END AS held1
                    FROM (SELECT a.*, f.live, f.due, f.held, f.epoch, CASE WHEN a.message_count = 0 THEN 'heartbeat' WHEN a.session <> f.live THEN 'session_reset' WHEN a.first_sequence < f.due THEN 'duplicate'
                                 WHEN a.first_sequence > f.due THEN 'buffered' ELSE 'deliver' END AS action
                          FROM f JOIN a ON a.channel = f.channel AND a.i = f.i + 1)))))
),
d AS (SELECT channel, session, s.first AS first_sequence, row_number() OVER (PARTITION BY channel ORDER BY i, pos) - 1 AS delivery_no, s.epoch::BIGINT AS book_epoch, s.action AS action, arrival_no FROM f, unnest(sent) WITH ORDINALITY AS t(s, pos))"""


_TALLY = """SELECT channel, sum(len(sent))::BIGINT AS delivered, count(*) FILTER (action = 'duplicate')::BIGINT AS duplicates, count(*) FILTER (action = 'buffered')::BIGINT AS buffered, sum(opened)::BIGINT AS gaps_opened,
    sum(healed)::BIGINT AS gaps_healed, sum(lost)::BIGINT AS messages_lost, count(*) FILTER (action = 'session_reset')::BIGINT AS session_resets, count(*) FILTER (action = 'heartbeat')::BIGINT AS heartbeats,
    sum(len(list_filter(sent, lambda x: x.action = 'resync')))::BIGINT AS resyncs FROM f GROUP BY channel"""


@query(fold_sql(feeds.BEATS_SQL, 5) + f" SELECT 'c' AS capture_id, * FROM ({_TALLY})")
def feed_statistics(spark, sf_dir):
    arrived = feeds.arrivals_with_beats(spark, sf_dir).withColumn("capture_id", F.lit("c")).withColumn("channel", F.expr("session div 5"))
    return sequencing.statistics(arrived)


ORACLES["sequence_replayed"] = fold_sql(feeds.ARRIVALS_SQL, 50) + " SELECT 'c' AS capture_id, * FROM d"


@query(fold_sql(feeds.BEATS_SQL, 5) + " SELECT 'c' AS capture_id, * FROM d")
def feed_deliveries(spark, sf_dir):
    arrived = feeds.arrivals_with_beats(spark, sf_dir).withColumn("capture_id", F.lit("c")).withColumn("channel", F.expr("session div 5"))
    return sequencing.sequence_exact(arrived).where("delivery_no IS NOT NULL")


#: Deliveries as updates of books that begin anew with each epoch of a channel, then touches and quotes.
_BOOKS = """,
dm AS (SELECT row_number() OVER (ORDER BY channel, delivery_no, u.seq) AS seq, channel * 100000 + d.book_epoch AS book_epoch, symbol, side, flags, size, price, u.seq % 10 = 3 AS trade
       FROM d JOIN u ON u.seq // 5 = d.session * 100 + (d.first_sequence - 1) // 5),
du AS (SELECT * FROM dm WHERE NOT trade),
span AS (SELECT *, lead(seq) OVER (PARTITION BY book_epoch, symbol, side, price ORDER BY seq) AS until FROM du),
touch AS (SELECT a.seq, max(l.price) FILTER (l.side = 'B') AS bid, min(l.price) FILTER (l.side = 'S') AS ask, any_value(a.flags) & 1 = 1 AS stable
          FROM du a LEFT JOIN span l ON l.book_epoch = a.book_epoch AND l.symbol = a.symbol AND l.size > 0 AND l.seq <= a.seq AND (l.until IS NULL OR a.seq < l.until) GROUP BY a.seq)"""


@query(fold_sql(feeds.BEATS_SQL, 5) + _BOOKS + f""", t AS (SELECT sum(resyncs)::BIGINT AS resyncs, sum(messages_lost)::BIGINT AS messages_lost FROM ({_TALLY})),
    n AS (SELECT (SELECT count(*) FROM a)::BIGINT AS packets, (SELECT count(*) FROM dm)::BIGINT AS messages, (SELECT count(*) FROM du)::BIGINT AS updates, (SELECT count(*) FROM touch WHERE stable AND ask - bid >= 200)::BIGINT AS quotes)
    SELECT stage, packets, CASE WHEN k >= 1 THEN resyncs ELSE 0 END AS resyncs, CASE WHEN k >= 3 THEN resyncs ELSE 0 END AS book_resets, CASE WHEN k >= 1 THEN messages_lost ELSE 0 END AS messages_lost,
        CASE WHEN k >= 2 THEN messages ELSE 0 END AS messages, CASE WHEN k >= 3 THEN updates ELSE 0 END AS book_updates, CASE WHEN k >= 4 THEN quotes ELSE 0 END AS quotes,
        CASE WHEN k >= 5 THEN quotes ELSE 0 END AS orders_encoded, 0::BIGINT AS encode_errors
    FROM n, t, (VALUES (0, 'receive'), (1, 'sequence'), (2, 'parse'), (3, 'book'), (4, 'decide'), (5, 'encode')) AS s(k, stage)""")
def packet_stages(spark, sf_dir):
    return orders.stage_counters(feeds.packets(spark, sf_dir, 5))


@query(fold_sql(feeds.BEATS_SQL, 1, 10**9) + """,
    m AS (SELECT u.*, f.channel, f.arrival_no * 100 + u.seq % 5 AS place, u.seq % 10 = 3 AS trade FROM f JOIN a USING (channel, i) JOIN u ON u.seq // 5 = a.session * 100 + (a.first_sequence - 1) // 5 WHERE f.action IN ('deliver', 'session_reset')),
    span AS (SELECT *, lead(place) OVER (PARTITION BY channel, symbol, side, price ORDER BY place) AS until FROM m WHERE NOT trade),
    touch AS (SELECT x.channel, x.place, max(l.price) FILTER (l.side = 'B') AS bid, min(l.price) FILTER (l.side = 'S') AS ask, any_value(x.flags) & 1 = 1 AS stable
              FROM m x LEFT JOIN span l ON l.channel = x.channel AND l.symbol = x.symbol AND l.size > 0 AND l.place <= x.place AND (l.until IS NULL OR x.place < l.until) WHERE NOT x.trade GROUP BY ALL)
    SELECT (SELECT count(*) FROM a)::BIGINT AS packets, count(*)::BIGINT AS messages, 0::BIGINT AS errors, 0::BIGINT AS unknown, count(DISTINCT symbol)::BIGINT AS symbols, count(*) FILTER (NOT trade)::BIGINT AS price_updates,
        count(*) FILTER (trade)::BIGINT AS trades, min(price) FILTER (NOT trade AND size > 0) AS low, max(price) FILTER (NOT trade AND size > 0) AS high, (SELECT sum(opened) FROM f)::BIGINT AS gaps,
        (SELECT count(*) FROM f WHERE action = 'duplicate')::BIGINT AS duplicates, (SELECT count(*) FROM touch WHERE stable AND bid > ask)::BIGINT AS crossed FROM m""")
def packet_verdict(spark, sf_dir):
    return orders.verdict(feeds.packets(spark, sf_dir, 1))


# ---- all kinds, both file formats, every skip reason ---------------------------------------

#: Values of the fields by event, within every field's range.
_VALUES = {
    "flags": "event_id % 256", "symbol": "concat('K', CAST(event_id % 400 AS {text}))", "size": "event_id * 7919 % 4294967296", "price": "event_id * 31 - 150000", "trade_id": "event_id * 1000003 - 5", "sale_condition": "event_id % 200",
    "event": "event_id % 90", "status": "event_id % 80", "reason": "concat('R', CAST(event_id % 30 AS {text}))", "round_lot": "event_id % 1000 + 3000000000", "adj_poc": "-event_id", "luld_tier": "event_id % 3", "value": "event_id % 77",
    "detail": "event_id % 5", "price_type": "event_id % 99", "auction_type": "event_id % 60", "paired": "event_id * 11 % 4294967296", "ref_price": "event_id * 3", "indicative_price": "-event_id * 5", "imbalance": "event_id * 13 % 4294967296",
    "imbalance_side": "event_id % 250",
}
_KIND_LIST = sorted(wire.LAYOUTS)
_KINDS_OF = {n: [k for k in _KIND_LIST if n in wire.LAYOUTS[k].names] for n in _VALUES}


def _field_sql(name: str) -> str:
    zero = " WHEN kind IN (79, 69, 73) THEN 0" if name == "detail" else ""
    kind = "" if name in wire.TEXTS else "::BIGINT" if name in wire.LONGS else "::INTEGER"
    return f"(CASE WHEN kind IN ({', '.join(map(str, _KINDS_OF[name]))}) THEN {_VALUES[name].format(text='VARCHAR')}{zero} END){kind} AS {name}"


@query(f"""WITH k AS (SELECT event_id, [{', '.join(map(str, _KIND_LIST))}][event_id % {len(_KIND_LIST)} + 1] AS kind FROM events)
    SELECT event_id + 1 AS sequence, kind::INTEGER AS kind, event_id * 17 AS ts_nanos, {', '.join(map(_field_sql, _VALUES))} FROM k""")
def all_kinds_round_trip(spark, sf_dir):
    events = feeds.events(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, _KIND_LIST)), (F.col("event_id") % len(_KIND_LIST) + 1).cast("int"))
    rows = events.select(F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") * 17).alias("ts_nanos"), *(F.expr(v.format(text="STRING")).alias(n) for n, v in _VALUES.items()))
    bodies = capture.encode_messages(rows).groupBy(F.expr("seq div 8").alias("packet")).agg(F.sort_array(F.collect_list(F.struct("seq", "body"))).alias("m"))
    segments = bodies.select(
        F.format_string("kinds-%04d", F.expr("packet div 2000")).alias("capture_id"), F.expr("packet % 2000").alias("packet_no"), (F.col("packet") * 1000).alias("ts_nanos"), F.lit(1).alias("channel"), F.lit(5).alias("session"),
        (F.col("packet") * 8 + 1).alias("first_sequence"), F.transform("m", lambda r: r["body"]).alias("bodies"),
    )
    found = capture.through_files(capture.encode_segments(segments), "packets", "datagrams", "segments", "messages", form="pcapng")
    return found.where("error IS NULL").select("sequence", "kind", "ts_nanos", *_VALUES)


#: What is done to every seventh message: the last byte goes, all go, or the kind becomes one that isn't known.
_CUT, _EMPTY, _UNKNOWN = 2, 4, 5


@query(f"""WITH k AS (SELECT event_id % 7 AS turn, [{', '.join(map(str, _KIND_LIST))}][event_id % {len(_KIND_LIST)} + 1] AS kind FROM events)
    SELECT CASE turn WHEN {_EMPTY} THEN NULL WHEN {_UNKNOWN} THEN 238 ELSE kind END::INTEGER AS kind, CASE turn WHEN {_CUT} THEN 'wrong_length' WHEN {_EMPTY} THEN 'empty' END AS reason, count(*)::BIGINT AS n FROM k GROUP BY ALL""")
def message_errors(spark, sf_dir):
    events = feeds.events(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, _KIND_LIST)), (F.col("event_id") % len(_KIND_LIST) + 1).cast("int"))
    rows = capture.encode_messages(events.select(F.col("event_id").alias("seq"), kind.alias("kind"), F.lit(0).cast("long").alias("ts_nanos"), F.lit("K").alias("symbol")))
    turn, body = F.col("seq") % 7, F.col("body")
    spoilt = F.when(turn == _CUT, F.substring(body, 1, F.length(body) - 1)).when(turn == _EMPTY, F.substring(body, 1, 0)).when(turn == _UNKNOWN, _with_byte(body, 0, 238)).otherwise(body)
    packed = rows.groupBy(F.expr("seq div 9").alias("packet_no")).agg(F.sort_array(F.collect_list(F.struct("seq", spoilt.alias("body")))).alias("m"))
    segments = packed.select(
        F.lit("spoilt").alias("capture_id"), "packet_no", F.lit(0).alias("ts_nanos"), F.lit(1).alias("channel"), F.lit(5).alias("session"), (F.col("packet_no") * 9 + 1).alias("first_sequence"), F.transform("m", lambda r: r["body"]).alias("bodies"),
    )
    found = capture.chain(capture.encode_segments(segments), "datagrams", "segments", "messages")
    return found.groupBy("kind", F.split("error", ":")[0].alias("reason")).agg(F.count("*").alias("n"))


def _with_byte(data, at: int, value: int):
    """``data`` with one byte replaced."""
    return F.concat(F.substring(data, 1, at), F.unhex(F.lit(f"{value:02X}")), F.substring(data, at + 2, 100_000))


#: What is done to every sixth packet, and the reason it is then skipped for; the frames carry one VLAN tag.
_SPOILED = {1: (27, 6, "not_udp"), 2: (24, 0x20, "fragmented"), 3: (25, 1, "fragmented"), 4: (16, 0x86, "not_ipv4")}


@query("""SELECT CASE p % 6 WHEN 1 THEN 'not_udp' WHEN 2 THEN 'fragmented' WHEN 3 THEN 'fragmented' WHEN 4 THEN 'not_ipv4' WHEN 5 THEN 'too_short' ELSE 'datagram' END AS reason, count(*)::BIGINT AS n
    FROM (SELECT DISTINCT event_id // 5 AS p FROM events) GROUP BY reason""")
def frame_reasons(spark, sf_dir):
    packets = capture.encode_updates(feeds.updates(spark, sf_dir), packets_per_capture=6000)
    turn, data = F.col("packet_no") % 6, F.col("data")
    spoiled = F.when(turn == 5, F.substring(data, 1, 40))
    for k, (at, value, _) in _SPOILED.items():
        spoiled = spoiled.when(turn == k, _with_byte("data", at, value))
    return capture.skip_counts(capture.through_files(packets.withColumn("data", spoiled.otherwise(data)), "packets", "datagrams", form="pcapng"))


# ---- regression reports --------------------------------------------------------------------


@query(_FLOW + _fit_sql("SELECT symbol, t, x, 0.002::DOUBLE * x + ((t * 7919) % 1000 - 500) / 10000.0::DOUBLE AS y FROM x") + " SELECT symbol, 0.002::DOUBLE AS true_beta, abs(beta - 0.002::DOUBLE) <= 1.96::DOUBLE * stderr AS contains FROM r WHERE term = 'ofi'")
def regression_control(spark, sf_dir):
    """A coefficient planted in the flow of the events: whether the fit's interval has it."""
    return flow.covers(flow.ols_hac(flow.planted(flow.regressors(_quotes(spark, sf_dir), WIDTH))), 0.002)


@query(_FLOW + _fit_sql("SELECT * FROM x") + """, l AS (
        SELECT symbol, 0 AS line_no, printf('%d buckets, %.2f%% explained, errors over %d lags', n, r2 * 100, lags) AS line FROM r WHERE term = 'intercept'
        UNION ALL SELECT symbol, CASE term WHEN 'intercept' THEN 1 ELSE 2 END, printf('  %s = %.5e +- %.1e%s', term, beta, 1.96::DOUBLE * stderr, CASE WHEN abs(beta / stderr) > 1.96 THEN ' *' ELSE '' END) FROM r)
    SELECT symbol, line_no::INTEGER AS line_no, line FROM l""")
def regression_report(spark, sf_dir):
    return flow.report(flow.ols_hac(flow.regressors(_quotes(spark, sf_dir), WIDTH)))


# ---- touches as files ----------------------------------------------------------------------


@query(TOUCH + """, j AS (SELECT * FROM touch WHERE stable AND bid IS NOT NULL AND ask IS NOT NULL),
    w AS (SELECT *, lag(bid) OVER v AS b, lag(bid_size) OVER v AS bs, lag(ask) OVER v AS a, lag(ask_size) OVER v AS s FROM j WINDOW v AS (PARTITION BY book_epoch, symbol ORDER BY seq))
    SELECT u.ts_nanos, w.symbol, w.bid, w.bid_size, w.ask, w.ask_size FROM w JOIN u USING (seq) WHERE (b IS NULL OR b <> w.bid OR bs <> w.bid_size OR a <> w.ask OR s <> w.ask_size) AND w.symbol = (SELECT min(symbol) FROM u)""")
def touch_export(spark, sf_dir):
    """Touch changes written as CSV, and those of the first symbol read again."""
    updates, folder = feeds.updates(spark, sf_dir), f"{shared_dir(spark)}/touches-{uuid.uuid4().hex}"
    changes = book.touch_changes(book.touch(updates)).join(updates.select("seq", "ts_nanos"), "seq")
    quotes.write_touches(changes, folder)
    return quotes.read_touches(spark, folder, updates.agg(F.min("symbol")).first()[0])


# ---- the capture format --------------------------------------------------------------------


def _captured(spark, sf_dir, spoil: bool = False):
    """Capture files of the updates, written to the shared folder and read as ranges of 64 KB; with ``spoil`` every third file loses its last byte, and every third is no capture."""
    folder = f"{shared_dir(spark)}/captures-{uuid.uuid4().hex}"
    files = capture.capture_files(capture.encode_updates(feeds.updates(spark, sf_dir), packets_per_capture=500))
    if spoil:
        turn, content = F.regexp_extract("capture_id", "([0-9]+)$", 1).cast("int") % 3, F.col("content")
        files = files.withColumn("content", F.when(turn == 1, F.substring(content, 1, F.length(content) - 1)).when(turn == 2, F.encode(F.lit("no capture"), "utf-8")).otherwise(content))
    capture_source.write_captures(files, folder).agg(F.sum("n_bytes")).collect()
    return capture_source.read_captures(spark, folder, rangeBytes=65_536, lookBack=1 << 20)


@query(f"WITH {U} SELECT seq + 1 AS sequence, symbol, CASE side WHEN 'B' THEN 56 ELSE 53 END AS kind, flags, size, price, ts_nanos FROM u")
def capture_format(spark, sf_dir):
    found = capture_source.packets(_captured(spark, sf_dir))
    return capture.chain(found, "datagrams", "segments", "messages").select("sequence", "symbol", "kind", "flags", "size", "price", "ts_nanos")


@query("""WITH p AS (SELECT event_id // 5 // 500 AS file, 102 + 32 * count(*) AS record FROM events GROUP BY event_id // 5, event_id // 5 // 500)
    SELECT file::BIGINT AS file, count(*)::BIGINT AS packets, (24 + sum(record))::BIGINT AS file_bytes, sum(record - 16)::BIGINT AS packet_bytes, 'pcap' AS format, 1::BIGINT AS linktype FROM p GROUP BY file""")
def capture_positions(spark, sf_dir):
    """How far the reader of each file has come after its last packet, and what it has passed on."""
    file = F.regexp_extract("capture_id", "([0-9]+)\\.pcap$", 1).cast("long").alias("file")
    return capture_source.packets(_captured(spark, sf_dir)).groupBy(file).agg(
        (F.max("packet_no") + 1).alias("packets"), F.max("position").alias("file_bytes"), F.sum("orig_len").alias("packet_bytes"), F.first("format").alias("format"), F.first("linktype").alias("linktype"),
    )


@query("""WITH p AS (SELECT event_id // 5 AS packet, event_id // 5 // 500 AS file FROM events), f AS (SELECT file, count(DISTINCT packet) AS n FROM p GROUP BY file)
    SELECT file::BIGINT AS file, CASE file % 3 WHEN 2 THEN 0 WHEN 1 THEN n - 1 ELSE n END::BIGINT AS packets, CASE file % 3 WHEN 1 THEN 'cut_record' WHEN 2 THEN 'bad_magic' END AS reason FROM f""")
def capture_errors(spark, sf_dir):
    file = F.regexp_extract("capture_id", "([0-9]+)\\.pcap$", 1).cast("long").alias("file")
    found = _captured(spark, sf_dir, spoil=True)
    return found.groupBy(file).agg(F.count_if(F.col("error").isNull()).alias("packets"), F.max(F.split("error", ":")[0]).alias("reason"))
