"""Byte layouts: capture files, frames, segments and messages, for the Arrow-batched operators.

Ethernet, IPv4 and UDP are big-endian, segments and messages little-endian. Every parser is total:
any prefix of any input gives rows or a reason, never a crash.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

# Magics, block types and ether types of the public capture and network formats.
CLASSIC = {b"\xa1\xb2\xc3\xd4": (">", 1000), b"\xa1\xb2\x3c\x4d": (">", 1), b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1)}
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
VLAN, IPV4, UDP = 0x8100, 0x0800, 17
HEADER = struct.Struct("<BxHIIHHqqq")

TOO_SHORT, NOT_IPV4, NOT_UDP, FRAGMENTED = "too_short", "not_ipv4", "not_udp", "fragmented"


class BadMagic(ValueError):
    """The file is neither kind of capture."""


def packets(data: bytes) -> tuple[str, int | None, Iterator[tuple]]:
    """Format, link type, and ``(ts_nanos, data, orig_len, position)`` of each packet; a cut record ends the file."""
    if data[:4] == b"\x0a\x0d\x0d\x0a":
        return "pcapng", _first_link(data), _blocks(data)
    if data[:4] not in CLASSIC:
        raise BadMagic(data[:4].hex())
    order, unit = CLASSIC[data[:4]]
    if len(data) < 24:
        raise ValueError("truncated header")
    return "pcap", struct.unpack_from(order + "I", data, 20)[0], _records(data, order, unit)


def _records(data: bytes, order: str, unit: int, at: int = 24) -> Iterator[tuple]:
    head = struct.Struct(order + "IIII")
    while at + 16 <= len(data):
        sec, part, size, orig = head.unpack_from(data, at)
        if at + 16 + size > len(data):
            return
        yield sec * 1_000_000_000 + part * unit, data[at + 16 : at + 16 + size], orig, at + 16 + size
        at += 16 + size


def _walk(data: bytes, order: str = "<") -> Iterator[tuple[str, int, bytes, int]]:
    """Byte order, type, body and end of each block."""
    at = 0
    while at + 12 <= len(data):
        if data[at : at + 4] == b"\x0a\x0d\x0d\x0a":
            order = ">" if data[at + 8 : at + 12] == b"\x1a\x2b\x3c\x4d" else "<"
        kind, size = struct.unpack_from(order + "II", data, at)
        if size < 12 or at + size > len(data):
            return
        yield order, kind, data[at + 8 : at + size - 4], at + size
        at += size


def _unit(order: str, body: bytes) -> int:
    """Nanoseconds of a time unit of the interface, by integer division."""
    at = 8
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "HH", body, at)
        if code == 0:
            break
        if code == 9 and size >= 1 and at + 4 < len(body):
            res = body[at + 4]
            return 1_000_000_000 // (1 << min(res & 0x7F, 63)) if res & 0x80 else 1_000_000_000 // 10 ** min(res, 9)
        at += 4 + (size + 3) // 4 * 4
    return 1000


def _first_link(data: bytes) -> int | None:
    return next((struct.unpack_from(o + "H", b)[0] for o, k, b, _ in _walk(data) if k == INTERFACE and len(b) >= 2), None)


def _blocks(data: bytes, order: str = "<", units: list[int] | None = None) -> Iterator[tuple]:
    units = list(units or ())
    for order, kind, body, end in _walk(data, order):
        if kind == SECTION:
            units = []
        elif kind == INTERFACE:
            units.append(_unit(order, body))
        packet = packet_of(order, kind, body, units)
        if packet:
            yield *packet, end


def packet_of(order: str, kind: int, body: bytes, units: list[int]) -> tuple[int, bytes, int] | None:
    """``(ts_nanos, data, orig_len)`` of a block's body; None if it has no packet, or one that is cut."""
    if kind == ENHANCED and len(body) >= 20:
        iface, high, low, size, orig = struct.unpack_from(order + "IIIII", body)
        if 20 + size <= len(body):
            return ((high << 32) | low) * (units[iface] if iface < len(units) else 1000), body[20 : 20 + size], orig
    elif kind == SIMPLE and len(body) >= 4:
        orig = struct.unpack_from(order + "I", body)[0]
        return 0, body[4 : 4 + min(len(body) - 4, orig)], orig
    return None


def _read(file, at: int, size: int) -> bytes:
    file.seek(at)
    return file.read(size)


def record_ranges(path: str, range_bytes: int) -> Iterator[tuple[str, int, int, int, str]]:
    """``(format, first packet, start, stop, state)`` of ranges of whole records, about ``range_bytes`` each.

    Only headers are read. ``state`` holds what a reader must know at ``start``: the byte order and
    units of the section it lies in (of pcapng), or the file's (of a classic capture).
    """
    import os

    with open(path, "rb") as file:
        end, magic = os.fstat(file.fileno()).st_size, file.read(24)
        if magic[:4] in CLASSIC:
            order, unit = CLASSIC[magic[:4]]
            if len(magic) < 24:
                raise ValueError("truncated header")
            state = f"{order}{unit}"
            number = first = 0
            at = start = 24
            while at + 16 <= end:
                size = struct.unpack(order + "I", _read(file, at + 8, 4))[0]
                if at + 16 + size > end:
                    break
                at, number = at + 16 + size, number + 1
                if at - start >= range_bytes:
                    yield "pcap", first, start, at, state
                    start, first = at, number
            yield "pcap", first, start, at, state
        elif magic[:4] == b"\x0a\x0d\x0d\x0a":
            order, units, number, first, at, start = "<", [], 0, 0, 0, 0
            held = (order, "")
            while at + 12 <= end:
                head = _read(file, at, 36)
                if head[:4] == b"\x0a\x0d\x0d\x0a":
                    order, units = ">" if head[8:12] == b"\x1a\x2b\x3c\x4d" else "<", []
                kind, size = struct.unpack_from(order + "II", head)
                if size < 12 or at + size > end:
                    break
                if kind == INTERFACE:
                    units.append(_unit(order, _read(file, at + 8, size - 12)))
                number += (kind == ENHANCED and size >= 32 and 20 + struct.unpack_from(order + "I", head, 20)[0] <= size - 12) or (kind == SIMPLE and size >= 16)
                at += size
                if at - start >= range_bytes:
                    yield "pcapng", first, start, at, held[0] + held[1]
                    start, first, held = at, number, (order, ",".join(map(str, units)))
            yield "pcapng", first, start, at, held[0] + held[1]
        else:
            raise BadMagic(magic[:4].hex())


def range_packets(path: str, kind: str, start: int, stop: int, state: str) -> tuple[int | None, Iterator[tuple]]:
    """The link type of a file and the packets of one of its :func:`record_ranges`, positions counted from the file's start."""
    with open(path, "rb") as file:
        head, data = file.read(1 << 16), _read(file, start, stop - start)
    order, rest = state[0], state[1:]
    if kind == "pcap":
        link, found = struct.unpack_from(order + "I", head, 20)[0], _records(data, order, int(rest), 0)
    else:
        link, found = _first_link(head), _blocks(data, order, [int(u) for u in rest.split(",") if u])
    return link, ((ts, body, orig, at + start) for ts, body, orig, at in found)


#: What can become of a packet, by its code.
SKIPS = (None, TOO_SHORT, NOT_IPV4, NOT_UDP, FRAGMENTED)


def _padded(data: np.ndarray) -> np.ndarray:
    """``data`` with zeros behind it, so that a field of a cut packet can be read before its length is judged."""
    return np.concatenate([data, np.zeros(64, np.uint8)])


def _big(data: np.ndarray, at: np.ndarray, n: int = 2) -> np.ndarray:
    return sum(data[at + k].astype(np.int64) << (8 * (n - 1 - k)) for k in range(n))


def datagrams(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Of the frames at ``starts`` in the bytes ``data``: a code of :data:`SKIPS`, source and target ports, target address, and where the payload lies.

    One step for each header over all frames that are still good, and one for each depth of VLAN tags.
    """
    n, data, ends = len(starts), _padded(data), starts + sizes
    code = np.zeros(n, np.int64)
    out = {name: np.zeros(n, np.int64) for name in ("src_port", "dst_port", "dst_ip", "start", "size")}
    live = np.arange(n)

    def judge(bad: np.ndarray, reason: str, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
        nonlocal live
        code[live[bad]] = SKIPS.index(reason)
        live = live[~bad]
        return tuple(c[~bad] for c in columns)

    judge(sizes < 14, TOO_SHORT)
    at = starts[live] + 12
    kind = _big(data, at)
    while (kind == VLAN).any():
        at = np.where(kind == VLAN, at + 4, at)
        at, kind = judge(at + 2 > ends[live], TOO_SHORT, at, kind)
        kind = np.where(kind == VLAN, _big(data, at), kind)
    (at,) = judge(kind != IPV4, NOT_IPV4, at)
    ip = at + 2
    (ip,) = judge(ends[live] - ip < 20, TOO_SHORT, ip)
    (ip,) = judge(data[ip] >> 4 != 4, NOT_IPV4, ip)
    size = (data[ip] & 15).astype(np.int64) * 4
    ip, size = judge((size < 20) | (ends[live] - ip < size), TOO_SHORT, ip, size)
    ip, size = judge(data[ip + 9] != UDP, NOT_UDP, ip, size)
    ip, size = judge(_big(data, ip + 6) & 0x3FFF != 0, FRAGMENTED, ip, size)
    udp = ip + size
    ip, udp = judge(ends[live] - udp < 8, TOO_SHORT, ip, udp)
    length = _big(data, udp + 4)
    ip, udp, length = judge((length < 8) | (length > ends[live] - udp), TOO_SHORT, ip, udp, length)
    for name, values in (("src_port", _big(data, udp)), ("dst_port", _big(data, udp + 2)), ("dst_ip", _big(data, ip + 16, 4)), ("start", udp + 8), ("size", length - 8)):
        out[name][live] = values
    return {"code": code, **out}


def addresses(values: np.ndarray) -> list[str]:
    """Addresses as text; each distinct one is written once."""
    distinct, at = np.unique(values, return_inverse=True)
    return np.array([".".join(str(int(v) >> s & 255) for s in (24, 16, 8, 0)) for v in distinct] or [""], object)[at].tolist()


def datagram(frame: bytes) -> tuple[str | None, int, int, str, bytes]:
    """Skip reason (None if there is a datagram), source and target ports, target address, payload of one frame."""
    found = {k: int(v[0]) for k, v in datagrams(np.frombuffer(frame, np.uint8), np.zeros(1, np.int64), np.array([len(frame)])).items()}
    if found["code"]:
        return SKIPS[found["code"]], 0, 0, "", b""
    return None, found["src_port"], found["dst_port"], addresses(np.array([found["dst_ip"]]))[0], frame[found["start"] : found["start"] + found["size"]]


_HEADER = np.dtype([("version", "u1"), ("_", "u1"), ("protocol", "<u2"), ("channel", "<u4"), ("session", "<u4"), ("length", "<u2"), ("message_count", "<u2"), ("stream_offset", "<i8"), ("first_sequence", "<i8"), ("send_time", "<i8")])


def segments(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the payloads at ``starts``: which have a header, the headers, and of all messages in order the header's row, the place and the size.

    Messages end at the count or the end of the bytes. All payloads step from length to length together.
    """
    data, whole = _padded(data), sizes >= HEADER.size
    at, ends = starts[whole], (starts + sizes)[whole]
    headers = data[at[:, None] + np.arange(HEADER.size)].reshape(-1).view(_HEADER) if len(at) else np.zeros(0, _HEADER)
    counts, live, place = headers["message_count"].astype(np.int64), np.arange(len(at)), at + HEADER.size
    owners, places, lengths = [], [], []
    turn = 0
    while True:
        going = (counts[live] > turn) & (place + 2 <= ends[live])
        live, place = live[going], place[going]
        size = data[place].astype(np.int64) | data[place + 1].astype(np.int64) << 8
        fits = place + 2 + size <= ends[live]
        live, place, size = live[fits], place[fits], size[fits]
        if not len(live):
            break
        owners.append(live)
        places.append(place + 2)
        lengths.append(size)
        place, turn = place + 2 + size, turn + 1
    none = np.zeros(0, np.int64)
    owner, where, length = (np.concatenate(v) if v else none for v in (owners, places, lengths))
    order = np.argsort(owner, kind="stable")
    return whole, headers, owner[order], where[order], length[order]


def segment(payload: bytes) -> dict | None:
    """A segment's header and message bodies; None if the header is cut."""
    whole, headers, _, places, sizes = segments(np.frombuffer(payload, np.uint8), np.zeros(1, np.int64), np.array([len(payload)]))
    if not whole[0]:
        return None
    found = {n: int(headers[n][0]) for n in _HEADER.names if n not in ("_", "length")}
    return found | {"messages": [payload[a : a + n] for a, n in zip(places.tolist(), sizes.tolist(), strict=True)]}


def gathered(data: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of the pieces at ``places``, put one after the other."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return offsets.astype(np.int32), data[np.repeat(places - offsets[:-1], sizes) + np.arange(offsets[-1])]


#: Fixed values of the message format: after kind@0, one byte@1 and the time@2, each kind's fields in order ('_' is kept raw only).
_LAYOUTS = {
    0x38: ("flags", "symbol:S8 size:u4 price:i8"), 0x35: ("flags", "symbol:S8 size:u4 price:i8"),
    0x54: ("sale_condition", "symbol:S8 size:u4 price:i8 trade_id:i8"), 0x42: ("sale_condition", "symbol:S8 size:u4 price:i8 trade_id:i8"),
    0x53: ("event", ""), 0x44: ("flags", "symbol:S8 round_lot:u4 adj_poc:i8 luld_tier:u1"), 0x48: ("status", "symbol:S8 reason:S4"),
    0x4F: ("value", "symbol:S8"), 0x45: ("value", "symbol:S8"), 0x49: ("value", "symbol:S8"), 0x50: ("value", "symbol:S8 detail:u1"),
    0x58: ("price_type", "symbol:S8 price:i8"),
    0x41: ("auction_type", "symbol:S8 paired:u4 ref_price:i8 indicative_price:i8 imbalance:u4 imbalance_side:u1 _:V37"),
}


def _dtype(second: str, fields: str) -> np.dtype:
    """The packed little-endian layout of a kind's whole body."""
    named = [f.split(":") for f in fields.split()]
    return np.dtype([("kind", "u1"), (second, "u1"), ("ts_nanos", "<i8"), *((n, t.replace("S", "V") if t[0] in "SV" else f"<{t}") for n, t in named)])


LAYOUTS = {k: _dtype(*v) for k, v in _LAYOUTS.items()}
DETAIL_ZERO = frozenset((0x4F, 0x45, 0x49))
#: Text fields and their bytes.
TEXTS = {"symbol": 8, "reason": 4}

FIELDS = (
    "flags", "symbol", "size", "price", "trade_id", "sale_condition", "event", "status", "reason", "round_lot", "adj_poc", "luld_tier", "value", "detail", "price_type",
    "auction_type", "paired", "ref_price", "indicative_price", "imbalance", "imbalance_side",
)
LONGS = frozenset("size price trade_id round_lot adj_poc paired ref_price indicative_price imbalance".split())


def _text(raw: bytes) -> str | None:
    try:
        return raw.rstrip(b" ").decode("utf-8")
    except UnicodeDecodeError:
        return None


def texts_of(raw: np.ndarray) -> list[str | None]:
    """Space-padded byte fields as texts; null where they aren't UTF-8. Each distinct value is decoded once."""
    distinct, at = np.unique(raw.view(f"S{raw.dtype.itemsize}") if raw.size else np.empty(0, "S1"), return_inverse=True)
    whole = [x.ljust(raw.dtype.itemsize, b"\0") for x in distinct.tolist()]  # numpy drops zero bytes at the end
    return np.array([_text(x) for x in whole] or [None], object)[at].tolist()


def messages(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray | list]:
    """Columns of the bodies at ``starts`` in the bytes ``data``: kind, time, fields and ``error``.

    Empty bodies and known kinds of a wrong length are errors; unknown kinds have a kind alone. A
    column is a pair of values and of a mask of those present; texts and errors are lists.
    """
    n = len(starts)
    out = {name: (np.zeros(n, np.int64), np.zeros(n, bool)) for name in ("kind", "ts_nanos", *(f for f in FIELDS if f not in TEXTS))}
    texts = {name: [None] * n for name in (*TEXTS, "symbol_raw", "error")}
    some = np.flatnonzero(sizes > 0)
    kinds = np.zeros(n, np.int64)
    kinds[some] = data[starts[some]]
    out["kind"][0][some], out["kind"][1][some] = kinds[some], True
    for i in np.flatnonzero(sizes == 0).tolist():
        texts["error"][i] = "empty"
    for kind in np.unique(kinds[some]).tolist():
        layout = LAYOUTS.get(kind)
        if layout is None:
            continue
        mine = some[kinds[some] == kind]
        for i in mine[sizes[mine] != layout.itemsize].tolist():
            texts["error"][i] = f"wrong_length: expected {layout.itemsize}, got {sizes[i]}"
        mine = mine[sizes[mine] == layout.itemsize]
        rows = data[starts[mine][:, None] + np.arange(layout.itemsize)].reshape(-1).view(layout)
        for name in layout.names[1:]:
            if name in TEXTS:
                raw = np.ascontiguousarray(rows[name])
                found = texts_of(raw)
                cut = raw.view(f"V{TEXTS[name]}").tolist() if name == "symbol" else ()
                for at, i in enumerate(mine.tolist()):
                    texts[name][i] = found[at]
                    if name == "symbol":
                        texts["symbol_raw"][i] = cut[at]
            elif name != "_":
                out[name][0][mine], out[name][1][mine] = rows[name], True
        if kind in DETAIL_ZERO:
            out["detail"][1][mine] = True
    return {**out, **texts}


def message(body: bytes) -> dict:
    """One message's fields that are present, as :func:`messages` gives them."""
    found = messages(np.frombuffer(body, np.uint8), np.zeros(1, np.int64), np.array([len(body)]))
    row = {k: int(v[0][0]) for k, v in found.items() if isinstance(v, tuple) and v[1][0]} | {k: v[0] for k, v in found.items() if isinstance(v, list) and v[0] is not None}
    return row | ({"symbol": None} if "symbol_raw" in row and "symbol" not in row else {})


def message_bytes(kind: int, ts_nanos: int, **fields) -> bytes:
    """The body of a message of a known kind; symbols are padded with spaces."""
    row = np.zeros(1, LAYOUTS[kind])
    row["kind"], row["ts_nanos"] = kind, ts_nanos
    for name in LAYOUTS[kind].names:
        if name in TEXTS:
            row[name] = np.array([str(fields.get(name) or "").encode()[: TEXTS[name]].ljust(TEXTS[name])]).view(f"V{TEXTS[name]}")
        elif name not in ("kind", "ts_nanos", "_"):
            row[name] = int(fields.get(name) or 0)
    return row.tobytes()


def segment_bytes(bodies: list[bytes], session: int, first_sequence: int, channel: int = 1, send_time: int = 0, stream_offset: int = 0, count: int | None = None, protocol: int = 0x8004, version: int = 1) -> bytes:
    block = b"".join(len(b).to_bytes(2, "little") + b for b in bodies)
    return HEADER.pack(version, protocol, channel, session, len(block) & 0xFFFF, len(bodies) if count is None else count, stream_offset, first_sequence, send_time) + block


def frame_bytes(payload: bytes, tags: int = 1, target: tuple[int, ...] = (239, 1, 2, 3), port: int = 20_480) -> bytes:
    udp = struct.pack(">HHHH", port, port, 8 + len(payload), 0) + payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(udp), 0, 0, 64, UDP, 0, bytes(4), bytes(target))
    return bytes(12) + b"\x81\x00\x00\x01" * tags + b"\x08\x00" + ip + udp


def pcap_bytes(items: list[tuple[int, bytes]], order: str = "<", nanos: bool = False) -> bytes:
    """A classic capture of ``(ts_nanos, data)``; microsecond files drop the rest of the nanoseconds."""
    unit = 1 if nanos else 1000
    head = struct.pack(order + "IHHiIII", 0xA1B23C4D if nanos else 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    return head + b"".join(struct.pack(order + "IIII", t // 1_000_000_000, t % 1_000_000_000 // unit, len(d), len(d)) + d for t, d in items)


def pcapng_bytes(items: list[tuple[int, bytes]], order: str = "<", tsresol: int | None = None) -> bytes:
    """A one-interface pcapng capture of ``(time units, data)``."""

    def block(kind: int, body: bytes) -> bytes:
        body += bytes(-len(body) % 4)
        return struct.pack(order + "II", kind, 12 + len(body)) + body + struct.pack(order + "I", 12 + len(body))

    options = b"" if tsresol is None else struct.pack(order + "HHB3xHH", 9, 1, tsresol, 0, 0)
    out = block(SECTION, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(INTERFACE, struct.pack(order + "HHI", 1, 0, 65535) + options)
    return out + b"".join(block(ENHANCED, struct.pack(order + "IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(d), len(d)) + d) for t, d in items)
