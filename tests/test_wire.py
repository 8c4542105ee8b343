"""Byte layouts, capture files and pricing."""

import math
import struct

import numpy as np
import pytest

from tidemark.functions import normal, wire
from tidemark.operators import pricing
from tidemark.sources import capture, synthetic


def test_capture_files():
    for order in "<>":
        kind, link, found = wire.packets(wire.pcap_bytes([(7_000_500_000, b"aaa"), (8_000_000_000, b"bbbb")], order))
        assert (kind, link) == ("pcap", 1) and [(t, d) for t, d, _, _ in found] == [(7_000_500_000, b"aaa"), (8_000_000_000, b"bbbb")]
        for res, unit in ((6, 1000), (9, 1), (None, 1000), (0x80 | 10, 976562)):
            kind, link, found = wire.packets(wire.pcapng_bytes([(1000, b"xy"), (2000, b"z")], order, res))
            assert (kind, link) == ("pcapng", 1) and [(t, d) for t, d, _, _ in found] == [(1000 * unit, b"xy"), (2000 * unit, b"z")]
    assert next(wire.packets(wire.pcap_bytes([(7_000_000_500, b"a")], nanos=True))[2])[0] == 7_000_000_500
    with pytest.raises(wire.BadMagic):
        wire.packets(bytes(32))
    two = wire.pcapng_bytes([(1, b"p")], "<", 9) + wire.pcapng_bytes([(1, b"q")], ">", 6)
    assert [(t, d) for t, d, _, _ in wire.packets(two)[2]] == [(1, b"p"), (1000, b"q")]


def test_frames():
    frame = wire.frame_bytes(b"hello")
    for f in (frame, wire.frame_bytes(b"hello", 0), wire.frame_bytes(b"hello", 2), frame + bytes(20)):
        assert wire.datagram(f) == (None, 20_480, 20_480, "239.1.2.3", b"hello")
    base = bytearray(wire.frame_bytes(b"hello", 0))
    for at, value, skip in ((23, 6, "not_udp"), (20, 0x20, "fragmented"), (21, 1, "fragmented"), (12, 0x86, "not_ipv4")):
        bad = bytearray(base)
        bad[at] = value
        assert wire.datagram(bytes(bad))[0] == skip


def test_segments_and_messages():
    seg = wire.segment(wire.segment_bytes([b"first", b"2nd", b""], 88, 7_000))
    assert (seg["message_count"], seg["messages"], seg["first_sequence"], seg["session"]) == (3, [b"first", b"2nd", b""], 7_000, 88)
    assert wire.segment(wire.segment_bytes([b"x"], 1, 1, count=9))["messages"] == [b"x"] and wire.segment(wire.segment_bytes([], 1, 1))["messages"] == []
    body = wire.message_bytes(0x38, 1_500_000_000_000_000_000, symbol="AAPL", flags=1, size=4_000_000_000, price=-1)
    m = wire.message(body)
    assert len(body) == 30 and (m["symbol"], m["size"], m["price"], m["flags"]) == ("AAPL", 4_000_000_000, -1, 1)
    assert wire.message(body + b"x")["error"].startswith("wrong_length: expected 30, got 31") and wire.message(b"")["error"] == "empty" and wire.message(b"\xee\x01") == {"kind": 0xEE}
    assert wire.message(body[:10] + b"\xff\xfe      " + body[18:])["symbol"] is None
    from tidemark.functions.market import KINDS

    assert {k: len(wire.message_bytes(k, 5)) for k in wire.LAYOUTS} == {k: n for k, (_, n) in KINDS.items()}


#: Offset and struct format of each field, written down apart from the layouts.
PLACES = {
    0x38: {"flags": (1, "B"), "size": (18, "<I"), "price": (22, "<q")}, 0x54: {"sale_condition": (1, "B"), "size": (18, "<I"), "price": (22, "<q"), "trade_id": (30, "<q")},
    0x53: {"event": (1, "B")}, 0x44: {"flags": (1, "B"), "round_lot": (18, "<I"), "adj_poc": (22, "<q"), "luld_tier": (30, "B")}, 0x48: {"status": (1, "B")},
    0x4F: {"value": (1, "B")}, 0x50: {"value": (1, "B"), "detail": (18, "B")}, 0x58: {"price_type": (1, "B"), "price": (18, "<q")},
    0x41: {"auction_type": (1, "B"), "paired": (18, "<I"), "ref_price": (22, "<q"), "indicative_price": (30, "<q"), "imbalance": (38, "<I"), "imbalance_side": (42, "B")},
}
PLACES |= {0x35: PLACES[0x38], 0x42: PLACES[0x54], 0x45: PLACES[0x4F], 0x49: PLACES[0x4F]}


def plain_message(body):
    if not body:
        return {"error": "empty"}
    kind = body[0]
    if kind not in PLACES:
        return {"kind": kind}
    if len(body) != len(wire.message_bytes(kind, 0)):
        return {"kind": kind, "error": f"wrong_length: expected {len(wire.message_bytes(kind, 0))}, got {len(body)}"}
    out = {"kind": kind, "ts_nanos": struct.unpack_from("<q", body, 2)[0]} | {n: struct.unpack_from(f, body, at)[0] for n, (at, f) in PLACES[kind].items()}
    if kind != 0x53:
        out |= {"symbol_raw": body[10:18], "symbol": wire._text(body[10:18])}
    if kind == 0x48 and (reason := wire._text(body[18:22])) is not None:
        out["reason"] = reason
    return out | ({"detail": 0} if kind in (0x4F, 0x45, 0x49) else {})


def test_columns_of_random_bodies_equal_a_plain_parse():
    rng = np.random.default_rng(3)
    bodies = [b"", b"\x00", b"\xee" * 9]
    for kind in [*PLACES] * 12:
        size = len(wire.message_bytes(kind, 0))
        bodies.append(bytes([kind]) + rng.bytes(size - 1 if rng.random() < 0.8 else int(rng.integers(0, 90))))
        bodies.append(wire.message_bytes(kind, 9, symbol="AB", reason="R1", price=-5, size=4_000_000_000, flags=200))
    order = rng.permutation(len(bodies))
    bodies = [bodies[i] for i in order]
    sizes = np.array([len(b) for b in bodies])
    found = wire.messages(np.frombuffer(b"".join(bodies), np.uint8), np.cumsum(sizes) - sizes, sizes)
    for i, body in enumerate(bodies):
        row = {k: int(v[0][i]) for k, v in found.items() if isinstance(v, tuple) and v[1][i]} | {k: v[i] for k, v in found.items() if isinstance(v, list) and v[i] is not None}
        want = {k: v for k, v in plain_message(body).items() if v is not None}
        assert row == want


def test_catalogue_of_captures(spark, tmp_path):
    for name, size in (("feed_20180127_A.pcap", 30), ("own.pcapng", 5), ("notes.txt", 9)):
        (tmp_path / name).write_bytes(b"x" * size)
    found = {r.path.split("/")[-1]: (str(r.day), r.n_bytes) for r in capture.catalogue(spark, str(tmp_path)).collect()}
    assert found == {"feed_20180127_A.pcap": ("2018-01-27", 30), "own.pcapng": ("None", 5)}


def test_files_in_ranges_equal_whole_files(spark, tmp_path):
    """Any cut of a file at records gives its packets, with a section of another byte order inside."""
    items = [(1_000_000 + 7_000 * i, bytes([i % 251]) * (i % 90)) for i in range(300)]
    files = {
        "a.pcap": wire.pcap_bytes(items, ">"), "b.pcap": wire.pcap_bytes(items, nanos=True) + b"cut",
        "c.pcapng": wire.pcapng_bytes(items, "<", 9) + wire.pcapng_bytes(items[:50], ">", 6) + wire.pcapng_bytes(items[:50], "<", None), "d.pcap": wire.pcap_bytes([]),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    for size in (1, 500, 4096, 1 << 30):
        for name, data in files.items():
            kind, link, whole = wire.packets(data)
            got, number = [], 0
            for form, first, start, stop, state in wire.record_ranges(str(tmp_path / name), size):
                found_link, packets = wire.range_packets(str(tmp_path / name), form, start, stop, state)
                packets = list(packets)
                assert (form, found_link, first) == (kind, link, number)
                got, number = got + packets, number + len(packets)
            assert got == list(whole)
    paths = [str(tmp_path / n) for n in files]
    key = lambda r: (r.capture_id.split("/")[-1], r.packet_no)
    a = sorted(((*key(r), r.format, r.linktype, r.ts_nanos, bytes(r.data), r.orig_len, r.position) for r in capture.read_large(spark, paths, 2000).collect()))
    b = sorted(((*key(r), r.format, r.linktype, r.ts_nanos, bytes(r.data), r.orig_len, r.position) for r in capture.read_packets(spark, str(tmp_path)).collect()))
    assert a == b and len(a) == 1000
    with pytest.raises(wire.BadMagic):
        (tmp_path / "e").write_bytes(bytes(40))
        list(wire.record_ranges(str(tmp_path / "e"), 10))


def test_every_prefix_is_safe():
    frame = wire.frame_bytes(wire.segment_bytes([wire.message_bytes(0x38, 1, symbol="A")], 1, 1))
    for data in (wire.pcap_bytes([(1, frame)]), wire.pcapng_bytes([(1, frame)], tsresol=9)):
        for i in range(len(data)):
            try:
                list(wire.packets(data[:i])[2])
            except ValueError:
                pass
    for i in range(len(frame)):
        wire.datagram(frame[:i])
    payload = wire.datagram(frame)[4]
    for i in range(len(payload)):
        wire.segment(payload[:i])
        wire.message(payload[42 : 42 + i])


def test_files_are_read_through_spark(spark, tmp_path):
    u = synthetic.updates(spark, 200, seed=1)
    for row in capture.capture_files(capture.encode_updates(u, packets_per_capture=10)).collect():
        (tmp_path / f"{row.capture_id}.pcap").write_bytes(row.content)
    found = capture.messages(capture.segments(capture.datagrams(capture.read_packets(spark, str(tmp_path)))))
    got = {(r.sequence - 1, r.symbol, r.size, r.price, r.flags) for r in found.collect()}
    assert got == {(r.seq, r.symbol, r.size, r.price, r.flags) for r in u.collect()}
    assert capture.heartbeats(capture.segments(capture.datagrams(capture.read_packets(spark, str(tmp_path))))).count() == 0


def test_erfc_and_prices(spark):
    x = np.linspace(-7, 25, 3001)
    assert np.allclose(normal.erfc(x), [math.erfc(v) for v in x], rtol=1e-12, atol=0)
    o = spark.createDataFrame([(k, 100.0, 100.0, 0.05, 0.2, 1.0) for k in ("call", "put")] + [("call", 110.0, 100.0, 0.05, 0.2, 0.0), ("put", 110.0, 100.0, 0.05, 0.2, 0.0), ("call", 110.0, 100.0, 0.05, 0.0, 1.0)], "kind string, spot double, strike double, rate double, vol double, time double")
    p = [r.price for r in pricing.priced(o).collect()]
    assert p[:2] == pytest.approx([10.450583572185565, 5.573526022256971], abs=1e-9) and p[2:] == [10.0, 0.0, 10.0]


def test_greeks_match_differences(spark):
    base = {"kind": "put", "spot": 95.0, "strike": 100.0, "rate": 0.03, "vol": 0.35, "time": 0.8}
    rows = [base] + [base | {k: base[k] + s * h} for k, h in (("spot", 1e-3), ("vol", 1e-5), ("time", 1e-5), ("rate", 1e-5)) for s in (1, -1)]
    r = pricing.priced(spark.createDataFrame([tuple(x.values()) for x in rows], "kind string, spot double, strike double, rate double, vol double, time double")).collect()
    slope = lambda i, h: (r[i].price - r[i + 1].price) / (2 * h)
    assert [r[0].delta, r[0].vega, -r[0].theta, r[0].rho] == pytest.approx([slope(1, 1e-3), slope(3, 1e-5), slope(5, 1e-5), slope(7, 1e-5)], rel=1e-5)
    assert r[0].gamma == pytest.approx((r[1].delta - r[2].delta) / 2e-3, rel=1e-5)


def textbook_call(spot, strike, rate, vol, time):
    """The call's price by the standard library's error function."""
    cdf = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
    d = (math.log(spot / strike) + (rate + vol * vol / 2) * time) / (vol * math.sqrt(time))
    return spot * cdf(d) - strike * math.exp(-rate * time) * cdf(d - vol * math.sqrt(time))


def test_implied_vols_of_textbook_prices():
    rng = np.random.default_rng(9)
    rows = [(rng.uniform(60, 160), 110.0, rng.uniform(0, 0.08), rng.uniform(0.08, 1.2), rng.uniform(0.1, 3)) for _ in range(200)]
    spot, strike, rate, vol, time = (np.array(c) for c in zip(*rows))
    target = np.array([textbook_call(*r) for r in rows])
    got, _, well = pricing.solve_vol(target, spot, strike, rate, time, np.ones(200, bool))
    again = [textbook_call(s, k, r, v, t) for s, k, r, v, t in zip(spot, strike, rate, got, time)]
    assert np.allclose(again, target, atol=1e-7) and well.mean() > 0.9 and np.allclose(got[well], vol[well], atol=1e-5)
    beyond = pricing.solve_vol(np.array([spot[0] * 2, -1.0]), spot[:2], strike[:2], rate[:2], time[:2], np.ones(2, bool))[0]
    assert np.isnan(beyond).all()


def test_monte_carlo_intervals(spark):
    hits = 0
    for seed in range(6):
        m = pricing.monte_carlo(spark, 100.0, 100.0, 0.05, 0.2, 1.0, paths=100_000, seed=seed).first()
        hits += m.low <= 10.450583572185565 <= m.high
    assert hits >= 4 and m.stderr < 0.05
    asian = pricing.monte_carlo(spark, 100.0, 100.0, 0.05, 0.2, 1.0, steps=52, paths=20_000).first()
    assert 0 < asian.price < 10.45


def plain_datagram(frame):
    if len(frame) < 14:
        return "too_short"
    at, kind = 12, int.from_bytes(frame[12:14], "big")
    while kind == 0x8100:
        at += 4
        if at + 2 > len(frame):
            return "too_short"
        kind = int.from_bytes(frame[at : at + 2], "big")
    ip = frame[at + 2 :]
    if kind != 0x0800:
        return "not_ipv4"
    if len(ip) < 20:
        return "too_short"
    if ip[0] >> 4 != 4:
        return "not_ipv4"
    size = ip[0] % 16 * 4
    if size < 20 or len(ip) < size:
        return "too_short"
    if ip[9] != 17:
        return "not_udp"
    if int.from_bytes(ip[6:8], "big") % 0x4000:
        return "fragmented"
    udp = ip[size:]
    if len(udp) < 8:
        return "too_short"
    length = int.from_bytes(udp[4:6], "big")
    if length < 8 or length > len(udp):
        return "too_short"
    return (int.from_bytes(udp[:2], "big"), int.from_bytes(udp[2:4], "big"), ".".join(str(b) for b in ip[16:20]), udp[8:length])


def plain_messages(payload):
    if len(payload) < 40:
        return None
    count, at, out = int.from_bytes(payload[14:16], "little"), 40, []
    while len(out) < count and at + 2 <= len(payload):
        size = int.from_bytes(payload[at : at + 2], "little")
        if at + 2 + size > len(payload):
            break
        out.append(payload[at + 2 : at + 2 + size])
        at += 2 + size
    return out


def test_framing_in_columns_equals_a_packet_at_a_time(spark):
    rng, frames = __import__("random").Random(41), [None, b""]
    for _ in range(400):
        bodies = [bytes(rng.randint(0, 255) for _ in range(rng.choice((0, 1, 9)))) for _ in range(rng.choice((0, 1, 3, 40)))]
        payload = wire.segment_bytes(bodies, 7, rng.randint(-5, 10**12), channel=rng.randint(0, 2**32 - 1), count=rng.choice((None, 0, 2, 60)))
        frame = bytearray(wire.frame_bytes(payload[: rng.choice((len(payload), len(payload), 39, len(payload) - 1))], rng.randint(0, 3), port=rng.randint(0, 65535)))
        for _ in range(rng.choice((0, 0, 1, 2))):
            frame[rng.randrange(len(frame))] = rng.choice((0, 1, 0x45, 0x46, 0x60, 0x81, 17, 255))
        frames.append(bytes(frame[: rng.choice((len(frame), len(frame), len(frame), rng.randint(0, len(frame))))]))
    packets = spark.createDataFrame([("c", i, i, bytearray(f) if f is not None else None) for i, f in enumerate(frames)], "capture_id string, packet_no long, ts_nanos long, data binary")
    found = capture.datagrams(packets.repartition(3))
    for r in found.collect():
        want = plain_datagram(frames[r.packet_no] or b"")
        assert (r.skip, r.payload) == (want, None) if isinstance(want, str) else (r.skip, r.src_port, r.dst_port, r.dst_ip, bytes(r.payload)) == (None, *want)
    segments = {r.packet_no: [bytes(m) for m in r.messages] for r in capture.segments(found).collect()}
    payloads = {i: d[3] for i, f in enumerate(frames) if not isinstance(d := plain_datagram(f or b""), str)}
    assert segments == {i: m for i, p in payloads.items() if (m := plain_messages(p)) is not None} and len(segments) > 100


def test_one_worker_for_successive_steps(spark):
    from tidemark import packet_queries, queries  # noqa: F401  registers its queries beside the others

    for name in ("kind_counts", "kind_lengths", "session_verdict", "wire_round_trip", "frame_skips", "frame_reasons", "segment_headers", "all_kinds_round_trip"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        maps = [line for line in plan.splitlines() if "InArrow" in line]
        assert len(maps) == (3 if name == "all_kinds_round_trip" else 2), (name, maps)  # two encoders there; else one map writes packets and one reads them


@pytest.mark.parametrize("form", ["pcap", "pcapng"])
def test_chained_steps_equal_single_ones(spark, form):
    """Frames whole, cut, of other protocols and of segments with cut, empty, unknown and no messages."""
    good = wire.message_bytes(0x38, 1, symbol="A", size=3, price=4)
    bodies = [[good, good[:9], b"", b"\xee"], [], [good] * 40, [wire.message_bytes(0x41, 2, symbol="é")]]
    frames = [wire.frame_bytes(wire.segment_bytes(b, 7, 10 * i), i % 3) for i, b in enumerate(bodies)] * 3
    frames += [b"", frames[0][:30], frames[0][:50], frames[2][:-3], wire.frame_bytes(b"x" * 39), frames[0].replace(b"\x45\x00", b"\x65\x00", 1)]
    packets = spark.createDataFrame([(f"c{i % 4}", i, i * 1000, bytearray(f)) for i, f in enumerate(frames)], "capture_id string, packet_no long, ts_nanos long, data binary")
    files = capture.capture_files(packets, form)
    framed = capture.datagrams(capture.packets_of(files))
    rows = lambda df: sorted(map(str, df.collect()))
    steps = ("packets", "datagrams", "segments", "messages")
    for n, one in enumerate((capture.packets_of(files), framed, capture.segments(framed), capture.messages(capture.segments(framed))), 1):
        want = rows(one)
        assert len(want) > 10 and rows(capture.chain(files, *steps[:n])) == want and rows(capture.through_files(packets, *steps[:n], form=form)) == want
    assert rows(capture.chain(packets, *steps[1:])) == rows(capture.messages(capture.segments(capture.datagrams(packets))))


def test_batches_are_bounded(monkeypatch):
    """By rows and by bytes, however many packets a file and messages a segment have; nothing is lost at a border."""
    monkeypatch.setattr(capture, "OUT_ROWS", 50)
    monkeypatch.setattr(capture, "OUT_BYTES", 10_000)
    body = wire.message_bytes(0x53, 1)
    frames = [wire.frame_bytes(wire.segment_bytes([body] * n, 7, i)) for i, n in enumerate([3, 0, 60, 7, 20, 30, 1] * 40 + [1000, 2])]
    file = wire.pcap_bytes([(i * 1000, f) for i, f in enumerate(frames)])
    files = [capture.pa.record_batch({"capture_id": ["c"], "content": capture.pa.array([file], capture.pa.binary())})]
    found = list(capture._packets(files))
    assert all(b.num_rows <= 50 and (b.num_rows == 1 or sum(map(len, b["data"].to_pylist())) <= 10_000) for b in found)
    assert [p for b in found for p in b["packet_no"].to_pylist()] == list(range(len(frames))) and [d for b in found for d in b["data"].to_pylist()] == frames
    at_once = capture.pa.Table.from_batches(list(capture._segments(capture._datagrams(found)))).combine_chunks().to_batches()
    parsed = list(capture._messages(at_once))
    assert len(at_once) == 1 and all(b.num_rows <= 50 or len(set(b["packet_no"].to_pylist())) == 1 for b in parsed)
    got = [x for b in parsed for x in zip(b["packet_no"].to_pylist(), b["msg_no"].to_pylist(), b["sequence"].to_pylist(), b["raw"].to_pylist())]
    counts = [3, 0, 60, 7, 20, 30, 1] * 40 + [1000, 2]
    assert got == [(i, k, i + k, body) for i, n in enumerate(counts) for k in range(n)]
