"""The capture format against whole-file reading: cut at every byte, false chains, errors, filters."""

import random
import struct

import numpy as np
import pytest

from tidemark.functions import wire
from tidemark.sources import capture, capture_source as cs


def items(rng, n, most=60):
    return [(rng.randint(0, 2**31) * 1_000_000_000 + rng.randint(0, 999_999) * 1000, bytes(rng.choice((0, 0, 1, 7, 255)) for _ in range(rng.randint(0, most)))) for _ in range(n)]


def rows_of(content, range_bytes, look_back):
    """All rows that the reader gives for a file's bytes, range after range, without Spark."""
    reader = cs.CaptureReader({"rangeBytes": range_bytes, "lookBack": look_back})
    layout, out = cs.Layout(content[: cs.HEAD]), []
    for k, start in enumerate(range(0, max(len(content), 1), range_bytes)):
        part = cs.Range("x", "x", k, start, min(start + range_bytes, len(content)), len(content))
        out += reader._rows(layout, lambda at, n: content[at : at + n], part)
    return out


@pytest.mark.parametrize("form", ["<", ">", "nanos", "ng<", "ng>"])
def test_ranges_cut_at_every_byte_give_the_whole_file(form, monkeypatch):
    monkeypatch.setattr(cs, "MOST", 128)  # so that look-back windows are small beside the file
    rng = random.Random(form)
    packets = items(rng, 40)
    order = form[-1] if form[-1] in "<>" else "<"
    content = wire.pcapng_bytes(packets, order, 9) if form[:2] == "ng" else wire.pcap_bytes(packets, order, form == "nanos")
    whole = [(*p, None) for p in wire.packets(content)[2]]
    assert len(whole) == 40
    for range_bytes in (1, 2, 3, 5, 16, 17, 97, 256, 1000, len(content), len(content) + 1):
        for look_back in (256, 384, 1 << 20):
            assert rows_of(content, range_bytes, look_back) == whole, (range_bytes, look_back)


def test_packets_that_carry_captures_mislead_no_range(monkeypatch):
    monkeypatch.setattr(cs, "MOST", 400)
    rng = random.Random(3)
    inner = wire.pcap_bytes(items(rng, 6, 20))[24:]
    packets = [(k * 1_000_000_000, (inner if k % 2 else bytes(rng.randint(0, 120)))[:380]) for k in range(60)]
    content = wire.pcap_bytes(packets)
    whole = [(*p, None) for p in wire.packets(content)[2]]
    for range_bytes in (13, 150, 700):
        assert rows_of(content, range_bytes, 800) == whole


def test_cut_and_spoilt_files_end_with_a_row(monkeypatch):
    monkeypatch.setattr(cs, "MOST", 128)
    rng = random.Random(4)
    for build in (wire.pcap_bytes, lambda p: wire.pcapng_bytes(p, "<", 9)):
        content = build(items(rng, 30))
        ends = [p[3] for p in wire.packets(content)[2]]
        for cut in (ends[-1] - 1, ends[-2] + 3, ends[-2] + 13, ends[10] + 1):
            whole = [(*p, None) for p in wire.packets(content[:cut])[2]]
            at = max(e for e in ends if e <= cut)
            for range_bytes in (40, 333, 10**6):
                assert rows_of(content[:cut], range_bytes, 256) == [*whole, (None, None, None, at, cs.CUT)]
    assert rows_of(b"nonsense" * 9, 20, 256) == [(None, None, None, 0, "bad_magic: 6e6f6e73")] and rows_of(b"", 20, 256)[0][4].startswith("bad_magic")
    assert rows_of(wire.pcap_bytes([])[:20], 7, 256) == [(None, None, None, 0, cs.SHORT_HEADER)] and rows_of(wire.pcap_bytes([]), 7, 256) == []
    spoilt = wire.pcap_bytes(items(rng, 3)) + struct.pack("<IIII", 1, 2, 1 << 30, 5) + bytes(40)
    assert [r[4] for r in rows_of(spoilt, 10**6, 256)] == [None] * 3 + [cs.IMPLAUSIBLE]


def test_sections_and_interfaces_that_ranges_cannot_know_are_errors(monkeypatch):
    monkeypatch.setattr(cs, "MOST", 128)
    two = wire.pcapng_bytes([(1, b"p" * 30)] * 9, "<", 9) + wire.pcapng_bytes([(1, b"q")], ">", 6)
    assert rows_of(two, 10**6, 256) == [(*p, None) for p in wire.packets(two)[2]]  # one range knows all
    assert cs.LATE_SECTION in {r[4] for r in rows_of(two, 100, 256)}


def test_format_equals_reading_whole_files(spark, tmp_path):
    rng = random.Random(8)
    for k in range(3):
        (tmp_path / f"a{k}.pcap").write_bytes(wire.pcap_bytes(items(rng, 50), "<>"[k % 2]))
    (tmp_path / "b.pcapng").write_bytes(wire.pcapng_bytes(items(rng, 50), "<", 9))
    (tmp_path / "_hidden.pcap").write_bytes(b"x")
    want = sorted(map(tuple, capture.read_packets(spark, str(tmp_path)).collect()), key=repr)
    found = cs.read_captures(spark, str(tmp_path), rangeBytes=700)
    assert sorted(map(tuple, cs.packets(found).collect()), key=repr) == want and found.rdd.getNumPartitions() > 8
    times = sorted(r[4] for r in want)
    low, high = times[40], times[120]
    some = found.where(f"ts_nanos >= {low} AND ts_nanos < {high}")
    assert sorted(r.ts_nanos for r in some.collect()) == [t for t in times if low <= t < high]
    one = found.where(f"capture_id = 'file:{tmp_path}/b.pcapng'")
    assert one.count() == 50 and one.rdd.getNumPartitions() < 8 and cs.errors(found).count() == 0
    assert cs.packets(cs.read_captures(spark, f"{tmp_path}/a*.pcap")).count() == 150
    (tmp_path / "c.pcap").write_bytes(b"not a capture at all")
    (tmp_path / "d.pcap").write_bytes((tmp_path / "a0.pcap").read_bytes()[:-1])
    again = cs.read_captures(spark, str(tmp_path), rangeBytes=700)
    bad = sorted(map(tuple, cs.errors(again).collect()))
    assert [(p.rsplit("/", 1)[1], r) for p, _, r in bad] == [("c.pcap", "bad_magic"), ("d.pcap", "cut_record")] and cs.packets(again).count() == 249
    empty = tmp_path / "none"
    empty.mkdir()
    assert cs.read_captures(spark, str(empty)).count() == 0


def test_borders_in_a_large_file_are_found_without_a_walk(monkeypatch):
    rng = np.random.default_rng(5)
    packets = [(k * 1_000_000, rng.integers(0, 256, 200 + k % 900, np.uint8).tobytes()) for k in range(4000)]
    content = wire.pcap_bytes(packets)
    ends = {p[3] for p in wire.packets(content)[2]} | {24}
    monkeypatch.setattr(cs, "_walked_border", None)
    layout = cs.Layout(content[:64])
    for start in (cs.LOOK_BACK + 100, 10**6, 2 * 10**6 + 7, len(content) - 3):
        assert cs.find_border(layout, lambda at, n: content[at : at + n], start, len(content)) == min(e for e in ends if e >= start)
