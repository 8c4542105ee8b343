"""Registered queries of the market-data operators, with their DuckDB oracles.

Every query is ``(spark, sf_dir) -> DataFrame`` over feeds derived from ``events``. An oracle
states the rows in plain relational terms: joins of updates with what was live, recursive or
windowed folds, never the operator's own route.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import market
from tidemark.operators import book, flow, latency, orders, pricing, sequencing
from tidemark.plans import feeds
from tidemark.sources import capture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

U = f"u AS ({feeds.UPDATES_SQL})"
#: Live levels at each update, by join; then the touch.
LIVE = """,
span AS (SELECT *, lead(seq) OVER (PARTITION BY book_epoch, symbol, side, price ORDER BY seq) AS until FROM u),
touch AS (
    SELECT a.book_epoch, a.symbol, a.seq, max(l.price) FILTER (l.side = 'B') AS bid, arg_max(l.size, l.price) FILTER (l.side = 'B') AS bid_size,
           min(l.price) FILTER (l.side = 'S') AS ask, arg_min(l.size, l.price) FILTER (l.side = 'S') AS ask_size, any_value(a.flags) & 1 = 1 AS stable
    FROM u a LEFT JOIN span l ON l.book_epoch = a.book_epoch AND l.symbol = a.symbol AND l.size > 0 AND l.seq <= a.seq AND (l.until IS NULL OR a.seq < l.until)
    GROUP BY ALL
)"""
TOUCH = f"WITH {U}{LIVE}"
FINAL = f"WITH {U}, final AS (SELECT book_epoch, symbol, side, price, arg_max(size, seq) AS size FROM u GROUP BY ALL HAVING arg_max(size, seq) > 0)"


def query(sql: str | None = None):
    """Registers a query under its name, with its oracle if SQL has one."""

    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return put


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touch changes of the derived feed."""
    return book.touch_changes(book.touch(feeds.updates(spark, sf_dir)))


# ---- expressions ---------------------------------------------------------------------------


@query(f"""WITH {U} SELECT seq, price // 10000 AS dollars, CASE WHEN price % 100 = 0 THEN price // 100 END AS tick,
    CASE WHEN price % 100 = 0 THEN printf('%d.%02d', price // 10000, price % 10000 // 100) ELSE printf('%d.%04d', price // 10000, price % 10000) END AS price_text,
    size = 0 AS is_delete, flags & 1 = 1 AS complete, size % 100 <> 0 AS odd_lot, price % 100 <> 0 AS off_penny, hex(encode(rpad(symbol, 8, ' '))) AS symbol_hex
    FROM (SELECT * REPLACE (price + seq % 3 AS price) FROM u)""")
def market_expressions(spark, sf_dir):
    u = feeds.updates(spark, sf_dir).withColumn("price", F.col("price") + F.col("seq") % 3)
    p, z = F.col("price"), F.col("size")
    return u.select(
        "seq", market.dollars(p).alias("dollars"), market.tick_index(p, 100).alias("tick"), market.price_text(p).alias("price_text"), market.is_delete(z).alias("is_delete"),
        market.event_complete(F.col("flags")).alias("complete"), market.odd_lot(z).alias("odd_lot"), market.off_penny(p).alias("off_penny"), F.hex(market.symbol_bytes(F.col("symbol"))).alias("symbol_hex"),
    )


@query(f"WITH {U} SELECT count(*) FILTER (size % 100 <> 0)::BIGINT AS odd_lots, count(*) FILTER (price % 100 <> 0)::BIGINT AS off_penny, min(price) FILTER (size > 0) AS low, max(price) FILTER (size > 0) AS high FROM u")
def sanity_counts(spark, sf_dir):
    z, p = F.col("size"), F.col("price")
    return feeds.updates(spark, sf_dir).agg(F.count_if(market.odd_lot(z)).alias("odd_lots"), F.count_if(market.off_penny(p)).alias("off_penny"), F.min(F.when(z > 0, p)).alias("low"), F.max(F.when(z > 0, p)).alias("high"))


# ---- order book ----------------------------------------------------------------------------


@query(FINAL + " SELECT * FROM final")
def final_levels(spark, sf_dir):
    return book.final_levels(feeds.updates(spark, sf_dir))


@query(FINAL + """ SELECT book_epoch, symbol, max(price) FILTER (side = 'B') AS bid, arg_max(size, price) FILTER (side = 'B') AS bid_size, min(price) FILTER (side = 'S') AS ask,
    arg_min(size, price) FILTER (side = 'S') AS ask_size, min(price) FILTER (side = 'S') - max(price) FILTER (side = 'B') AS spread FROM final GROUP BY ALL""")
def best_prices(spark, sf_dir):
    return book.best(book.final_levels(feeds.updates(spark, sf_dir)))


@query(TOUCH + " SELECT * FROM touch")
def touch_after_update(spark, sf_dir):
    return book.touch(feeds.updates(spark, sf_dir))


@query(TOUCH + " SELECT * FROM touch")
def touch_by_range_join(spark, sf_dir):
    return book.touch(feeds.updates(spark, sf_dir), "join")


@query(TOUCH + """ SELECT (SELECT count(*) FROM u)::BIGINT AS updates, (SELECT count(*) FROM u WHERE size = 0)::BIGINT AS deletes,
    (SELECT count(*) FROM (SELECT size, lag(size, 1, 0) OVER (PARTITION BY book_epoch, symbol, side, price ORDER BY seq) AS p FROM u) WHERE size = 0 AND p = 0)::BIGINT AS absent_deletes,
    count(*) FILTER (bid > ask AND stable)::BIGINT AS crossed_when_stable, count(*) FILTER (bid > ask AND NOT stable)::BIGINT AS crossed_mid_event, count(*) FILTER (bid = ask AND stable)::BIGINT AS locked_when_stable FROM touch""")
def book_counters(spark, sf_dir):
    u = feeds.updates(spark, sf_dir)
    return book.book_counters(u, book.touch(u))


@query(f"WITH t AS ({feeds.TRADES_SQL}) SELECT symbol, count(*) FILTER (kind = 84)::BIGINT AS trades, coalesce(sum(size) FILTER (kind = 84), 0)::BIGINT AS shares, count(*) FILTER (kind = 66)::BIGINT AS breaks FROM t GROUP BY symbol")
def trades_by_symbol(spark, sf_dir):
    report = F.col("kind") == 0x54
    return feeds.trades(spark, sf_dir).groupBy("symbol").agg(F.count_if(report).alias("trades"), F.sum(F.when(report, F.col("size")).otherwise(0)).alias("shares"), F.count_if(F.col("kind") == 0x42).alias("breaks"))


@query(f"""WITH {U}, span AS (SELECT *, lead(seq) OVER (PARTITION BY book_epoch, symbol, side, price ORDER BY seq) AS until FROM u)
    SELECT a.seq, a.book_epoch, a.symbol, a.side, count(l.size)::BIGINT AS n_levels, coalesce(sum(l.size), 0)::BIGINT AS total_size
    FROM u a LEFT JOIN span l ON l.book_epoch = a.book_epoch AND l.symbol = a.symbol AND l.side = a.side AND l.size > 0 AND l.seq <= a.seq AND (l.until IS NULL OR a.seq < l.until) GROUP BY ALL""")
def running_depth(spark, sf_dir):
    return book.running_depth(feeds.updates(spark, sf_dir))


@query(FINAL + " SELECT book_epoch, symbol, side, string_agg(concat(price, 'x', size), ' ' ORDER BY price) AS ladder, count(*)::BIGINT AS n_levels FROM final GROUP BY ALL")
def ladders(spark, sf_dir):
    return book.ladders(book.final_levels(feeds.updates(spark, sf_dir)))


@query(f"WITH {U} SELECT book_epoch, count(*)::BIGINT AS updates, count(DISTINCT symbol)::BIGINT AS symbols, min(ts_nanos) AS first_ts, max(ts_nanos) AS last_ts, avg((flags = 0)::INT) AS mid_event_rate, avg((size = 0)::INT) AS delete_rate FROM u GROUP BY book_epoch")
def epochs(spark, sf_dir):
    u = feeds.updates(spark, sf_dir)
    rate = lambda c: F.avg(c.cast("int"))
    return u.groupBy("book_epoch").agg(
        F.count("*").alias("updates"), F.count_distinct("symbol").alias("symbols"), F.min("ts_nanos").alias("first_ts"), F.max("ts_nanos").alias("last_ts"),
        rate(F.col("flags") == 0).alias("mid_event_rate"), rate(F.col("size") == 0).alias("delete_rate"),
    )


@query("SELECT count(*)::BIGINT AS updates, 0::BIGINT AS differing FROM events")
def strategies_agree(spark, sf_dir):
    u = feeds.updates(spark, sf_dir)
    a, b = book.touch(u), book.touch(u, "join")
    both = a.join(b.select("seq", *(F.col(c).alias(f"o_{c}") for c in ("bid", "bid_size", "ask", "ask_size", "stable"))), "seq")
    same = F.lit(True)
    for c in ("bid", "bid_size", "ask", "ask_size", "stable"):
        same = same & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    return both.agg(F.count("*").alias("updates"), F.count_if(~same).alias("differing"))


@query(TOUCH + """ SELECT book_epoch, symbol, seq, bid, bid_size, ask, ask_size FROM (SELECT *, lag(concat_ws('/', bid, bid_size, ask, ask_size)) OVER (PARTITION BY book_epoch, symbol ORDER BY seq) AS was
    FROM touch WHERE stable AND bid IS NOT NULL AND ask IS NOT NULL) WHERE was IS DISTINCT FROM concat_ws('/', bid, bid_size, ask, ask_size)""")
def touch_changes(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(TOUCH + """, hit AS (SELECT * FROM touch WHERE stable AND bid > ask ORDER BY seq LIMIT 20)
    SELECT h.book_epoch, h.symbol, h.seq, h.bid, h.ask, string_agg(concat(l.price, 'x', l.size), ' ' ORDER BY l.price) FILTER (l.side = 'B') AS bids, string_agg(concat(l.price, 'x', l.size), ' ' ORDER BY l.price) FILTER (l.side = 'S') AS asks
    FROM hit h JOIN span l ON l.book_epoch = h.book_epoch AND l.symbol = h.symbol AND l.size > 0 AND l.seq <= h.seq AND (l.until IS NULL OR h.seq < l.until) GROUP BY ALL""")
def crossed_events(spark, sf_dir):
    u = feeds.updates(spark, sf_dir)
    return book.crossed_events(u, book.touch(u))


@query(FINAL + """, last AS (SELECT * FROM final WHERE book_epoch = (SELECT max(book_epoch) FROM u)) SELECT * FROM (
    SELECT book_epoch, symbol, max(price) FILTER (side = 'B') AS bid, arg_max(size, price) FILTER (side = 'B') AS bid_size, min(price) FILTER (side = 'S') AS ask, arg_min(size, price) FILTER (side = 'S') AS ask_size,
    min(price) FILTER (side = 'S') - max(price) FILTER (side = 'B') AS spread, count(*) FILTER (side = 'B')::BIGINT AS bid_levels, count(*) FILTER (side = 'S')::BIGINT AS ask_levels FROM last GROUP BY ALL)
    WHERE bid IS NOT NULL AND ask IS NOT NULL ORDER BY symbol LIMIT 8""")
def quote_board(spark, sf_dir):
    return book.quote_board(feeds.updates(spark, sf_dir))


_SHAPES = f"""WITH {U}, span AS (SELECT *, lead(seq) OVER (PARTITION BY book_epoch, symbol, side, price ORDER BY seq) AS until FROM u),
    points AS (SELECT DISTINCT book_epoch, seq AS point FROM u WHERE seq % 500 = 0),
    shape AS (SELECT s.book_epoch, symbol, point, count(*) FILTER (side = 'B')::BIGINT AS bid_levels, count(*) FILTER (side = 'S')::BIGINT AS ask_levels,
        (max(price) FILTER (side = 'B') - min(price) FILTER (side = 'B')) // 100 AS bid_span, (max(price) FILTER (side = 'S') - min(price) FILTER (side = 'S')) // 100 AS ask_span,
        CASE WHEN count(*) FILTER (side = 'B') > 0 AND count(*) FILTER (side = 'S') > 0 THEN greatest((min(price) FILTER (side = 'S') - max(price) FILTER (side = 'B')) // 100, 0) END AS spread
        FROM points p JOIN span s ON s.book_epoch = p.book_epoch AND size > 0 AND seq <= point AND (until IS NULL OR point < until) GROUP BY ALL)"""


@query(_SHAPES + " SELECT * FROM shape")
def shape_samples(spark, sf_dir):
    return book.shape_samples(feeds.updates(spark, sf_dir), 500)


@query(_SHAPES + """, h AS (SELECT least(bid_levels + ask_levels, 5) AS bucket, count(*)::BIGINT AS n FROM shape GROUP BY ALL)
    SELECT bucket, n, sum(n) OVER (ORDER BY bucket)::BIGINT AS running FROM h""")
def depth_histogram(spark, sf_dir):
    shapes = book.shape_samples(feeds.updates(spark, sf_dir), 500).withColumn("depth", F.col("bid_levels") + F.col("ask_levels"))
    return book.saturating_histogram(shapes, "depth", 6)


@query(_SHAPES + """, h AS (SELECT least(bid_levels + ask_levels, 63) AS bucket, count(*)::BIGINT AS n FROM shape GROUP BY ALL), r AS (SELECT *, sum(n) OVER (ORDER BY bucket) AS running, sum(n) OVER () AS total FROM h)
    SELECT min(bucket) AS bucket FROM r WHERE running >= floor(total * 0.9::DOUBLE)""")
def depth_p90(spark, sf_dir):
    shapes = book.shape_samples(feeds.updates(spark, sf_dir), 500).withColumn("depth", F.col("bid_levels") + F.col("ask_levels"))
    return book.histogram_percentile(book.saturating_histogram(shapes, "depth", 64), 0.9)


@query(FINAL + " SELECT book_epoch, symbol, count(*)::BIGINT AS n_levels FROM final GROUP BY ALL ORDER BY n_levels DESC, book_epoch, symbol LIMIT 8")
def deepest_books(spark, sf_dir):
    return book.deepest(feeds.updates(spark, sf_dir))


# ---- decision and orders -------------------------------------------------------------------

_QUOTES = TOUCH + ", q AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS number FROM touch WHERE stable AND ask - bid >= 200)"


@query(_QUOTES + " SELECT book_epoch, seq, symbol, 'B' AS side, 100::BIGINT AS shares, bid AS price FROM q")
def threshold_quotes(spark, sf_dir):
    return orders.spread_threshold(book.touch(feeds.updates(spark, sf_dir)))


@query(_QUOTES + """ SELECT seq, token, CASE WHEN price BETWEEN 0 AND 4294967295 THEN concat('4F', hex(encode(token)), '42', '00000064', hex(encode(rpad(symbol, 8, ' '))), printf('%08X', price),
    hex(encode('IOCELTLDYPN')), '00000000', hex(encode('NR'))) END AS message_hex, CASE WHEN price NOT BETWEEN 0 AND 4294967295 THEN 'price_out_of_range' END AS error
    FROM (SELECT seq, symbol, concat('LL', lpad(number::VARCHAR, 12, '0')) AS token, CASE WHEN number % 10 = 3 THEN bid + 4294967296 ELSE bid END AS price FROM q)""")
def encoded_orders(spark, sf_dir):
    quotes = orders.with_tokens(orders.spread_threshold(book.touch(feeds.updates(spark, sf_dir))), 1000)
    spoiled = quotes.withColumn("price", F.when(F.substring("token", 14, 1) == "3", F.col("price") + (1 << 32)).otherwise(F.col("price")))
    return orders.encoded(spoiled).select("seq", "token", F.hex("message").alias("message_hex"), "error")


@query(_QUOTES + " SELECT (SELECT count(*) FROM u)::BIGINT AS messages, (SELECT count(*) FROM u)::BIGINT AS book_updates, count(*)::BIGINT AS quotes, count(*)::BIGINT AS orders_encoded, 0::BIGINT AS encode_errors FROM q")
def pipeline_counters(spark, sf_dir):
    return orders.counters(feeds.updates(spark, sf_dir))


@query(_QUOTES + " SELECT (SELECT count(*) FROM u)::BIGINT AS messages, (SELECT count(*) FROM u)::BIGINT AS book_updates, count(*)::BIGINT AS quotes, 0::BIGINT AS orders_encoded, 0::BIGINT AS encode_errors FROM q")
def pipeline_upto_decide(spark, sf_dir):
    return orders.counters(feeds.updates(spark, sf_dir), "decide")


# ---- sequencing ----------------------------------------------------------------------------

_ARRIVED = f"WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY arrival_no) AS i FROM ({feeds.ARRIVALS_SQL}))"
#: A plain fold: one arrival a step; held segments as a list, drained while one is in turn.
_FOLD = (
    _ARRIVED
    + """, f AS (
    SELECT session, i, first_sequence, message_count, arrival_no, 'deliver' AS action, first_sequence + message_count AS expected, []::BIGINT[] AS held FROM a WHERE i = 1
  UNION ALL
    SELECT session, i, first_sequence, message_count, arrival_no, action, drained, list_filter(kept, lambda x: x >= drained) FROM (
        SELECT *, CASE WHEN action = 'deliver' THEN coalesce((SELECT max(e) FROM (
            SELECT x + 5 AS e, x - 5 * row_number() OVER (ORDER BY x) AS run FROM (SELECT DISTINCT unnest(kept) AS x) WHERE x >= after) WHERE run = after - 5), after) ELSE after END AS drained FROM (
            SELECT a.*, CASE WHEN a.first_sequence < f.expected THEN 'duplicate' WHEN a.first_sequence > f.expected THEN 'buffered' ELSE 'deliver' END AS action,
                   CASE WHEN a.first_sequence = f.expected THEN a.first_sequence + a.message_count ELSE f.expected END AS after,
                   CASE WHEN a.first_sequence > f.expected THEN list_append(f.held, a.first_sequence) ELSE f.held END AS kept
            FROM f JOIN a ON a.session = f.session AND a.i = f.i + 1)))"""
)


@query(_FOLD + " SELECT session, arrival_no, first_sequence, message_count, action FROM f")
def sequence_actions(spark, sf_dir):
    return sequencing.classify(feeds.arrivals(spark, sf_dir))


@query(_FOLD + """ SELECT count(*) FILTER (action = 'deliver')::BIGINT AS delivered, count(*) FILTER (action = 'duplicate')::BIGINT AS duplicates, count(*) FILTER (action = 'buffered')::BIGINT AS buffered,
    coalesce(sum(message_count) FILTER (action = 'deliver'), 0)::BIGINT AS messages FROM f""")
def sequence_counts(spark, sf_dir):
    return sequencing.action_counts(sequencing.classify(feeds.arrivals(spark, sf_dir)))


@query(_ARRIVED + " SELECT DISTINCT ON (session, first_sequence) session, first_sequence, message_count, feed, arrival_no FROM a ORDER BY session, first_sequence, arrival_no")
def arbitrated(spark, sf_dir):
    return sequencing.first_copies(feeds.arrivals(spark, sf_dir))


@query(_ARRIVED + """, d AS (SELECT DISTINCT session, first_sequence AS s, first_sequence + message_count AS e FROM a)
    SELECT d.session, (SELECT max(e) FROM d p WHERE p.session = d.session AND p.s < d.s) AS gap_start, s AS gap_end, s - (SELECT max(e) FROM d p WHERE p.session = d.session AND p.s < d.s) AS n_lost
    FROM d WHERE s > (SELECT max(e) FROM d p WHERE p.session = d.session AND p.s < d.s)""")
def sequence_gaps(spark, sf_dir):
    return sequencing.gaps(feeds.arrivals(spark, sf_dir))


@query(_FOLD + " SELECT session AS channel, arrival_no, action FROM f")
def sequence_exact_actions(spark, sf_dir):
    arrived = feeds.arrivals(spark, sf_dir).withColumn("capture_id", F.lit("c")).withColumn("channel", F.col("session"))
    found = sequencing.sequence_exact(arrived, replay_buffered=False)
    return found.select("channel", "arrival_no", "action")


@query()
def sequence_replayed(spark, sf_dir):
    # a channel has 50 sessions in turn: session changes and resynchronisation within it, a fold of its own for each
    arrived = feeds.arrivals(spark, sf_dir).withColumn("capture_id", F.lit("c")).withColumn("channel", F.expr("session div 50"))
    return sequencing.sequence_exact(arrived).where("delivery_no IS NOT NULL")


# ---- wire ----------------------------------------------------------------------------------


def _sent(spark, sf_dir) -> DataFrame:
    return capture.encode_updates(feeds.updates(spark, sf_dir))


def _received(spark, sf_dir) -> DataFrame:
    return capture.through_files(_sent(spark, sf_dir), "packets", "datagrams", "segments", "messages")


@query(f"WITH {U} SELECT seq + 1 AS sequence, symbol, CASE side WHEN 'B' THEN 56 ELSE 53 END AS kind, flags, size, price, ts_nanos FROM u")
def wire_round_trip(spark, sf_dir):
    return _received(spark, sf_dir).select("sequence", "symbol", "kind", "flags", "size", "price", "ts_nanos")


@query("SELECT 'datagram' AS reason, count(DISTINCT event_id // 5)::BIGINT AS n FROM events")
def frame_skips(spark, sf_dir):
    return capture.skip_counts(capture.through_files(_sent(spark, sf_dir), "packets", "datagrams"))


@query("SELECT event_id // 5 * 5 + 1 AS first_sequence, count(*)::INTEGER AS message_count, event_id // 5 * 5 + 1 + count(*) AS next_sequence FROM events GROUP BY event_id // 5")
def segment_headers(spark, sf_dir):
    found = capture.chain(_sent(spark, sf_dir), "datagrams", "segments")
    return found.select("first_sequence", "message_count", (F.col("first_sequence") + F.col("message_count")).alias("next_sequence"))


@query(f"WITH {U} SELECT CASE side WHEN 'B' THEN 'price_level_buy' ELSE 'price_level_sell' END AS name, count(*)::BIGINT AS n, count(*) / sum(count(*)) OVER () AS share FROM u GROUP BY side")
def kind_counts(spark, sf_dir):
    from pyspark.sql import Window

    n = _received(spark, sf_dir).groupBy(market.kind_name(F.col("kind")).alias("name")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row for each kind


@query(f"WITH {U} SELECT CASE side WHEN 'B' THEN 56 ELSE 53 END AS kind, 30 AS length, count(*)::BIGINT AS n, false AS second FROM u GROUP BY side")
def kind_lengths(spark, sf_dir):
    return capture.kind_lengths(_received(spark, sf_dir))


@query(f"""WITH {U} SELECT (SELECT count(DISTINCT seq // 5) FROM u)::BIGINT AS packets, count(*)::BIGINT AS messages, 0::BIGINT AS errors, 0::BIGINT AS unknown, count(DISTINCT symbol)::BIGINT AS symbols,
    count(*)::BIGINT AS price_updates, min(price) FILTER (size > 0) AS low, max(price) FILTER (size > 0) AS high FROM u""")
def session_verdict(spark, sf_dir):
    m = _received(spark, sf_dir)
    update, live = F.col("kind").isin(0x38, 0x35), F.col("size") > 0
    return m.agg(
        F.count_distinct("capture_id", "packet_no").alias("packets"), F.count("*").alias("messages"), F.count("error").alias("errors"), F.count_if(~F.col("kind").isin(*market.KINDS)).alias("unknown"),
        F.count_distinct("symbol").alias("symbols"), F.count_if(update).alias("price_updates"), F.min(F.when(update & live, F.col("price"))).alias("low"), F.max(F.when(update & live, F.col("price"))).alias("high"),
    )


@query(f"""WITH {U}, t AS ({feeds.TRADES_SQL}) SELECT symbol, updates, coalesce(trades, 0) AS trades, coalesce(shares, 0) AS shares FROM (SELECT symbol, count(*)::BIGINT AS updates FROM u GROUP BY symbol)
    LEFT JOIN (SELECT symbol, count(*)::BIGINT AS trades, sum(size)::BIGINT AS shares FROM t GROUP BY symbol) USING (symbol) ORDER BY updates DESC, symbol LIMIT 10""")
def symbol_activity(spark, sf_dir):
    n = feeds.updates(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("updates"))
    t = feeds.trades(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("trades"), F.sum("size").alias("shares"))
    return n.join(t, "symbol", "left").fillna(0, ["trades", "shares"]).orderBy(F.desc("updates"), "symbol").limit(10)


# ---- latency -------------------------------------------------------------------------------

#: Bucket of a value from its count of halvings: independent of the operator's bit length.
_Q = f"""WITH RECURSIVE q AS ({feeds.QUEUE_SQL}), h AS (SELECT v, v AS w, 0 AS s FROM (SELECT DISTINCT service AS v FROM q) UNION ALL SELECT v, w // 2, s + 1 FROM h WHERE w >= 4096),
    low AS (SELECT v, max(s) AS s FROM h GROUP BY v), b AS (SELECT service, (service >> s) << s AS bucket_low FROM q JOIN low ON v = service)"""


@query(_Q + " SELECT bucket_low, count(*)::BIGINT AS n, sum(service)::BIGINT AS total FROM b GROUP BY bucket_low")
def service_histogram(spark, sf_dir):
    return latency.histogram(feeds.queue(spark, sf_dir), "service")


@query(_Q + """, r AS (SELECT bucket_low, row_number() OVER (ORDER BY bucket_low) AS i, count(*) OVER () AS n FROM b)
    SELECT w.q::DOUBLE AS q, (SELECT min(bucket_low) FROM r WHERE i >= greatest(ceil(w.q::DOUBLE * n), 1)) AS bucket_low, false AS overflow FROM (SELECT unnest([0.0, 0.5, 0.9, 0.99, 1.0]) AS q) w""")
def service_quantiles(spark, sf_dir):
    return latency.quantiles(latency.histogram(feeds.queue(spark, sf_dir), "service"), [0.0, 0.5, 0.9, 0.99, 1.0])


@query(_Q.replace("SELECT service, (service", "SELECT server, service, (service") + """, r AS (SELECT server, bucket_low, row_number() OVER (PARTITION BY server ORDER BY bucket_low) AS i, count(*) OVER (PARTITION BY server) AS n FROM b)
    SELECT server, count(*)::BIGINT AS count, 0::BIGINT AS overflow, sum(service)::BIGINT AS total, min(service) AS least, max(service) AS greatest, count(DISTINCT bucket_low)::INTEGER AS n_buckets,
        (SELECT min(bucket_low) FROM r WHERE r.server = b.server AND i >= ceil(0.5::DOUBLE * n)) AS median, (SELECT min(bucket_low) FROM r WHERE r.server = b.server AND i >= ceil(0.99::DOUBLE * n)) AS p99 FROM b GROUP BY server""")
def merged_sketches(spark, sf_dir):
    """Histograms of seven parts of each server's items, kept as values and added up."""
    parts = latency.sketches(feeds.queue(spark, sf_dir).withColumn("part", F.col("item") % 7), "service", ("server", "part"))
    whole = latency.merged_sketches(parts, ("server",))
    return whole.select("server", "count", "overflow", "total", "least", "greatest", F.size("buckets").alias("n_buckets"), latency.sketch_quantile(0.5).alias("median"), latency.sketch_quantile(0.99).alias("p99"))


@query(f"SELECT count(*)::BIGINT AS n, 0::BIGINT AS overflow, min(service) AS least, max(service) AS greatest, sum(service)::DOUBLE / count(*) AS mean FROM ({feeds.QUEUE_SQL})")
def service_summary(spark, sf_dir):
    return latency.summary(feeds.queue(spark, sf_dir), "service")


@query(f"""WITH RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY server ORDER BY sched, item) AS i FROM ({feeds.QUEUE_SQL})),
    f AS (SELECT server, i, item, sched, service, sched + service AS finish, false AS behind FROM q WHERE i = 1 UNION ALL
        SELECT q.server, q.i, q.item, q.sched, q.service, greatest(f.finish, q.sched) + q.service, f.finish > q.sched FROM f JOIN q ON q.server = f.server AND q.i = f.i + 1)
    SELECT server, item, sched, service, finish, finish - sched AS corrected, behind FROM f""")
def queued_latency(spark, sf_dir):
    return latency.queued(feeds.queue(spark, sf_dir))


@query(f"""WITH q AS (SELECT server AS variant, service / 1000.0::DOUBLE AS seconds FROM ({feeds.QUEUE_SQL})), b AS (SELECT variant, min(seconds) AS best, max(seconds) AS worst, max(seconds) - min(seconds) AS spread FROM q GROUP BY variant)
    SELECT *, best - lag(best) OVER (ORDER BY variant) AS step, abs(best - lag(best) OVER (ORDER BY variant)) < spread AS unresolved FROM b""")
def run_spread(spark, sf_dir):
    return latency.spread_of_runs(feeds.queue(spark, sf_dir).selectExpr("server AS variant", "service / 1000D AS seconds"))


# ---- order flow ----------------------------------------------------------------------------

WIDTH = 20_000_000_000_000
_FLOW = f"""WITH {U}, s AS (SELECT seq, ts_nanos, concat('G', CAST(CAST(substr(symbol, 4) AS INT) % 5 AS VARCHAR)) AS symbol, 990000 + (seq * 31 % 17) * 100 AS bid, size + 100 AS bid_size, 1002000 + (seq * 13 % 11) * 100 AS ask, size + 50 + seq % 7 AS ask_size FROM u),
    p AS (SELECT *, lag(bid) OVER w AS pb, lag(bid_size) OVER w AS pbs, lag(ask) OVER w AS pa, lag(ask_size) OVER w AS pas FROM s WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
    o AS (SELECT seq, ts_nanos, symbol, (bid + ask) / 2.0::DOUBLE / 10000.0::DOUBLE AS mid, ((bid >= pb)::INT * bid_size - (bid <= pb)::INT * pbs - (ask <= pa)::INT * ask_size + (ask >= pa)::INT * pas)::BIGINT AS ofi FROM p WHERE pb IS NOT NULL),
    k AS (SELECT *, (ts_nanos - first_value(ts_nanos) OVER (PARTITION BY symbol ORDER BY seq)) // {WIDTH} AS idx FROM o),
    c AS (SELECT symbol, idx, sum(ofi)::BIGINT AS ofi, arg_max(mid, seq) AS last_mid FROM k GROUP BY ALL),
    x AS (SELECT * FROM (SELECT symbol, row_number() OVER w AS t, ofi::DOUBLE AS x, lead(last_mid) OVER w - last_mid AS y FROM c WINDOW w AS (PARTITION BY symbol ORDER BY idx)) WHERE y IS NOT NULL)"""


def _quotes(spark, sf_dir) -> DataFrame:
    return feeds.updates(spark, sf_dir).selectExpr(
        "seq", "ts_nanos", "concat('G', CAST(CAST(substr(symbol, 4) AS INT) % 5 AS STRING)) AS symbol", "990000 + (seq * 31 % 17) * 100 AS bid", "size + 100 AS bid_size", "1002000 + (seq * 13 % 11) * 100 AS ask", "size + 50 + seq % 7 AS ask_size"
    )


@query(_FLOW + " SELECT symbol, seq, ofi FROM o")
def order_flow(spark, sf_dir):
    return flow.order_flow_imbalance(_quotes(spark, sf_dir)).select("symbol", "seq", "ofi")


@query(_FLOW + " SELECT * FROM c")
def flow_buckets(spark, sf_dir):
    return flow.buckets(_quotes(spark, sf_dir), WIDTH)


def _fit_sql(rows: str) -> str:
    """The regression of y on x by symbol over ``rows``, then ``r``: one row for each symbol and term."""
    return f""", f AS ({rows}),
    m AS (SELECT symbol, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, regr_r2(y, x) AS r2, greatest(1, floor(4 * pow(count(*) / 100, 2.0::DOUBLE / 9)))::INT AS lags FROM f GROUP BY symbol HAVING count(*) >= 50),
    e AS (SELECT f.symbol, t, x, y - b0 - b1 * x AS e, lags FROM f JOIN m USING (symbol)),
    g AS (SELECT a.symbol, sum(w * a.e * b.e) AS s00, sum(w * a.e * b.e * (a.x + b.x) / 2) AS s01, sum(w * a.e * b.e * a.x * b.x) AS s11
        FROM (SELECT *, unnest(range(0, lags + 1)) AS j FROM e) a JOIN e b ON b.symbol = a.symbol AND b.t = a.t - a.j, LATERAL (SELECT CASE WHEN a.j = 0 THEN 1 ELSE 2 * (1 - a.j / (a.lags + 1.0::DOUBLE)) END AS w) GROUP BY a.symbol),
    v AS (SELECT m.*, n * sxx - sx * sx AS det, s00, s01, s11 FROM m JOIN g USING (symbol)),
    r AS (SELECT symbol, 'intercept' AS term, b0 AS beta, sqrt(greatest((sxx * sxx * s00 - 2 * sxx * sx * s01 + sx * sx * s11) / det / det, 0)) AS stderr, r2, n, lags FROM v UNION ALL
        SELECT symbol, 'ofi', b1, sqrt(greatest((sx * sx * s00 - 2 * sx * n * s01 + n * n * s11) / det / det, 0)), r2, n, lags FROM v)"""


_ROUNDED = " SELECT symbol, term, round(beta, 7) AS beta, round(stderr, 7) AS stderr, round(beta / stderr, 4) AS tstat, abs(beta / stderr) > 1.96 AS significant, round(r2, 6) AS r2, n, lags FROM r"
_DIGITS = {"beta": 7, "stderr": 7, "tstat": 4, "r2": 6}


@query(_FLOW + _fit_sql("SELECT * FROM x") + _ROUNDED)
def flow_regression(spark, sf_dir):
    fit = flow.ols_hac(flow.regressors(_quotes(spark, sf_dir), WIDTH))
    return fit.withColumns({c: F.round(c, d) for c, d in _DIGITS.items()})


@query(_FLOW + """, f AS (SELECT * FROM (SELECT *, lag(x) OVER (PARTITION BY symbol ORDER BY t) AS z FROM x WHERE symbol IN (SELECT symbol FROM x GROUP BY symbol HAVING count(*) >= 50)) WHERE z IS NOT NULL),
    m AS (SELECT symbol, count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS vx, var_pop(z) AS vz, var_pop(y) AS vy, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM f GROUP BY symbol),
    b AS (SELECT *, vx * vz - xz * xz AS det, (xy * vz - zy * xz) / det AS b1, (zy * vx - xy * xz) / det AS b2, my - b1 * mx - b2 * mz AS b0, greatest(1, floor(4 * pow(n / 100, 2.0::DOUBLE / 9)))::INT AS lags,
        vz / det / n AS i11, -xz / det / n AS i12, vx / det / n AS i22 FROM m),
    w AS (SELECT symbol, t, lags, y - b0 - b1 * x - b2 * z AS u0, u0 * (x - mx) AS u1, u0 * (z - mz) AS u2 FROM f JOIN b USING (symbol)),
    g AS (SELECT a.symbol, sum(w * a.u0 * b.u0) AS s00, sum(w * (a.u0 * b.u1 + a.u1 * b.u0)) / 2 AS s01, sum(w * (a.u0 * b.u2 + a.u2 * b.u0)) / 2 AS s02, sum(w * a.u1 * b.u1) AS s11, sum(w * (a.u1 * b.u2 + a.u2 * b.u1)) / 2 AS s12, sum(w * a.u2 * b.u2) AS s22
        FROM (SELECT *, unnest(range(0, lags + 1)) AS j FROM w) a JOIN w b ON b.symbol = a.symbol AND b.t = a.t - a.j, LATERAL (SELECT CASE WHEN a.j = 0 THEN 1 ELSE 2 * (1 - a.j / (a.lags + 1.0::DOUBLE)) END AS w) GROUP BY a.symbol),
    q AS (SELECT symbol, sum(u0 * u0) AS rss FROM w GROUP BY symbol),
    terms AS (SELECT *, unnest([{'term': 'intercept', 'beta': b0, 'p': 1.0::DOUBLE / n, 'q': -(i11 * mx + i12 * mz), 'r': -(i12 * mx + i22 * mz)}, {'term': 'ofi', 'beta': b1, 'p': 0::DOUBLE, 'q': i11, 'r': i12}, {'term': 'ofi_before', 'beta': b2, 'p': 0::DOUBLE, 'q': i12, 'r': i22}], recursive := true)
          FROM b JOIN g USING (symbol) JOIN q USING (symbol)),
    r AS (SELECT symbol, term, beta, sqrt(greatest(p * p * s00 + q * q * s11 + r * r * s22 + 2 * p * q * s01 + 2 * p * r * s02 + 2 * q * r * s12, 0)) AS stderr, 1 - rss / (n * vy) AS r2, n, lags FROM terms)""" + _ROUNDED)
def flow_regression_two(spark, sf_dir):
    """The next return on a bucket's flow and on that of the bucket before."""
    rows = flow.with_lagged_flow(flow.regressors(_quotes(spark, sf_dir), WIDTH))
    fit = flow.ols_hac(rows, columns=("x", "x2"), names=("ofi", "ofi_before"))
    return fit.withColumns({c: F.round(c, d) for c, d in _DIGITS.items()})


# ---- option pricing ------------------------------------------------------------------------

_OPTIONS = """event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'call' ELSE 'put' END AS kind, CAST(80 + event_id % 50 AS DOUBLE) AS spot, CAST(90 + event_id % 23 AS DOUBLE) AS strike,
    CAST(event_id % 6 AS DOUBLE) / 100e0 AS rate, CAST(event_id % 10 AS DOUBLE) / 20e0 AS vol, CAST(event_id % 9 AS DOUBLE) / 4e0 AS time"""


def _options(spark, sf_dir) -> DataFrame:
    return feeds.events(spark, sf_dir).selectExpr(*_split(_OPTIONS))


def _split(columns: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, ch in enumerate(columns):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


def _normal(x: str, end: str) -> str:
    """The normal distribution function by its power series, not by the operator's quotients; ``end`` is the least of 9 and ``abs(x)``."""
    odd = "list_concat([1e0], list_transform(range(200), lambda i: 401e0 - 2 * i))"
    return f"0.5e0 + sign({x}) * exp(-0.5e0 * {end} * {end}) / sqrt(2 * pi()) * {end} * list_reduce({odd}, lambda s, k: 1e0 + s * {end} * {end} / k)"


# Puts by parity from calls, and vega and gamma from the second of the two densities, which the operator doesn't use.
@query(f"""
    WITH o AS (SELECT {_OPTIONS} FROM events),
    s AS (SELECT *, vol * sqrt(time) AS width, strike * exp(-rate * time) AS owed, kind = 'put' AS put, vol > 0 AND time > 0 AS live FROM o),
    d AS (SELECT *, ln(spot / owed) / width + width / 2 AS up, ln(spot / owed) / width - width / 2 AS down FROM s WHERE live),
    e AS (SELECT *, least(abs(up), 9e0) AS up_end, least(abs(down), 9e0) AS down_end, exp(-0.5e0 * down * down) / sqrt(2 * pi()) AS density FROM d),
    n AS (SELECT *, {_normal("up", "up_end")} AS held, owed * ({_normal("down", "down_end")}) AS paid FROM e),
    r AS (SELECT id, spot * held - paid + if(put, owed - spot, 0e0) AS price, held - put::INT AS delta, owed * density / (spot * spot * width) AS gamma, owed * density * sqrt(time) AS vega,
            -owed * density * vol / (2 * sqrt(time)) - rate * (paid - if(put, owed, 0e0)) AS theta, time * (paid - if(put, owed, 0e0)) AS rho FROM n
        UNION ALL
        SELECT id, greatest(if(put, strike - spot, spot - strike), 0e0), CASE WHEN put AND spot < strike THEN -1e0 WHEN NOT put AND spot > strike THEN 1e0 ELSE 0e0 END, 0e0, 0e0, 0e0, 0e0 FROM s WHERE NOT live)
    SELECT id, {', '.join(f'round({c}, 6) + 0e0 AS {c}' for c in pricing.RESULTS)} FROM r""")
def option_prices(spark, sf_dir):
    return pricing.priced(_options(spark, sf_dir)).select("id", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in pricing.RESULTS))


@query("SELECT event_id AS id, true AS holds FROM events WHERE event_id % 10 > 0 AND event_id % 9 > 0")
def put_call_parity(spark, sf_dir):
    found = pricing.parity_residual(_options(spark, sf_dir).where("vol > 0 AND time > 0").drop("kind"))
    return found.select("id", (F.abs("residual") < 1e-10).alias("holds"))


@query(f"""WITH o AS (SELECT {_OPTIONS} FROM events), d AS (SELECT *, (ln(spot / strike) + (rate + vol * vol / 2) * time) / (vol * sqrt(time)) AS d FROM o WHERE vol > 0 AND time > 0)
    SELECT id, true AS reprices, CASE WHEN spot * sqrt(time) * exp(-0.5e0 * d * d) / sqrt(2 * pi()) > 1 THEN round(vol, 6) END AS vol FROM d""")
def implied_vols(spark, sf_dir):
    """The volatility that a price was made with, where a price tells it, and whether the one found gives the price again."""
    live = pricing.priced(_options(spark, sf_dir).where("vol > 0 AND time > 0")).withColumnRenamed("price", "target").withColumnRenamed("vega", "told").drop(*pricing.RESULTS[1:])
    solved = live.withColumn("iv", pricing.implied_vol("target", "spot", "strike", "rate", "time", "kind"))
    again = pricing.priced(solved.select("id", "kind", "spot", "strike", "rate", "time", "target", "told", F.col("iv.vol").alias("vol")))
    return again.select("id", (F.abs(F.col("price") - F.col("target")) < 1e-8).alias("reprices"), F.when(F.col("told") > 1, F.round("vol", 6)).alias("vol"))


@query()
def monte_carlo_european(spark, sf_dir):
    return pricing.monte_carlo(spark, 100.0, 100.0, 0.05, 0.2, 1.0)


@query()
def monte_carlo_asian(spark, sf_dir):
    return pricing.monte_carlo(spark, 100.0, 100.0, 0.05, 0.2, 1.0, steps=52, paths=200_000)
