"""Column expressions on prices, symbols, flags and sizes. Prices are integers in 1/10000 dollar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE_SCALE = 10_000
EVENT_COMPLETE = 0x01

#: Message kinds: name and body length (fixed values of the wire format).
KINDS = {
    0x38: ("price_level_buy", 30), 0x35: ("price_level_sell", 30), 0x54: ("trade_report", 38), 0x42: ("trade_break", 38), 0x53: ("system_event", 10),
    0x44: ("security_directory", 31), 0x48: ("trading_status", 22), 0x4F: ("operational_halt", 18), 0x45: ("security_event", 18), 0x49: ("retail_liquidity", 18),
    0x50: ("short_sale_test", 19), 0x58: ("official_price", 26), 0x41: ("auction_information", 80),
}


def event_complete(flags: Column) -> Column:
    """Whether the update ends its event, so that the book may be judged (bit 0 only)."""
    return flags.bitwiseAND(EVENT_COMPLETE) != 0


def is_delete(size: Column) -> Column:
    return size == 0


def dollars(price: Column) -> Column:
    """Whole dollars, toward zero (as ``%`` truncates, the division below has no remainder)."""
    return ((price - price % PRICE_SCALE) / PRICE_SCALE).cast("long")


def tick_index(price: Column, tick: int) -> Column:
    """The price in ticks; null where it is negative or between ticks, or the tick isn't positive."""
    if tick <= 0:
        return F.lit(None).cast("long")
    return F.when((price >= 0) & (price % tick == 0), (price / tick).cast("long"))


def price_text(price: Column) -> Column:
    """Exact decimal text: two decimals, or four where the last two aren't zero."""
    size = F.abs(price)
    part = size % PRICE_SCALE
    cents = F.lpad((part / 100).cast("long").cast("string"), 2, "0")
    decimals = F.when(part % 100 == 0, cents).otherwise(F.lpad(part.cast("string"), 4, "0"))
    whole = ((size - part) / PRICE_SCALE).cast("long").cast("string")
    return F.concat(F.when(price < 0, "-").otherwise(""), whole, F.lit("."), decimals)


def symbol_text(padded: Column) -> Column:
    """A symbol without its padding (spaces only)."""
    return F.rtrim(padded)


def symbol_bytes(symbol: Column) -> Column:
    """The eight space-padded bytes of a symbol."""
    return F.encode(F.rpad(F.substring(symbol, 1, 8), 8, " "), "ISO-8859-1")


def kind_name(kind: Column) -> Column:
    named = F.create_map(*(F.lit(x) for k, (name, _) in KINDS.items() for x in (k, name)))
    return F.coalesce(named[kind], F.lit("unknown"))


def odd_lot(size: Column) -> Column:
    return size % 100 != 0


def off_penny(price: Column) -> Column:
    return tick_index(price, 100).isNull()
