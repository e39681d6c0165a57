"""Stored intervals cut into aligned blocks, so that a point finds its intervals by equality.

The line is divided into blocks of `unit`, of `RADIX` units, of `RADIX` squared and so on. An
interval is a union of few blocks, some 2 * (RADIX - 1) at most on each level, and a point asks the
one block that holds it on each level. Both sides then meet by an equality join, however long
an interval is; the exact ends are compared after it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIX = 8
#: Levels for dates in blocks of eight days: the calendar's years 1 to 9999 lie in three blocks of the last one.
DAY_UNIT, DAY_LEVELS = 8, 7


def _floor(x: Column, by: int) -> Column:
    """Whole division that rounds down, also below zero."""
    return F.floor((x - F.pmod(x, F.lit(by))) / by).cast("bigint") if by > 1 else x.cast("bigint")


def _block(x: Column, level: int) -> Column:
    return _floor(x, RADIX**level)


def _name(level: int, block: Column) -> Column:
    return block * 32 + level


def cut(first: Column, last: Column, levels: int) -> Column:
    """The names of the blocks whose union is the units first to last, both included; none where last < first."""
    low = [_block(first + (RADIX**k - 1), k) for k in range(levels)]  # the first block that lies inside, and the first that does not
    high = [_block(last + 1, k) for k in range(levels)]
    empty = F.array().cast("array<bigint>")

    def blocks(a: Column, b: Column) -> Column:
        return F.when(a < b, F.sequence(a, b - 1)).otherwise(empty)

    parts = []
    for k in range(levels):
        if k + 1 < levels:
            inner = low[k + 1] < high[k + 1]
            own = F.when(inner, F.concat(blocks(low[k], low[k + 1] * RADIX), blocks(high[k + 1] * RADIX, high[k]))).otherwise(blocks(low[k], high[k]))
        else:
            own = blocks(low[k], high[k])
        parts.append(F.transform(own, _named(k)))
    return F.concat(*parts)


def _named(level: int):
    return lambda block: _name(level, block)


def holders(unit: Column, levels: int) -> Column:
    """The names of the blocks that hold a unit, one a level; null for a null unit."""
    return F.when(unit.isNotNull(), F.array(*[_name(k, _block(unit, k)) for k in range(levels)]))


def days(first: Column, last: Column) -> Column:
    """Blocks of dates; a null end is open."""
    top = RADIX ** (DAY_LEVELS - 1)
    return cut(F.coalesce(_block_of_day(first), F.lit(-top)), F.coalesce(_block_of_day(last), F.lit(2 * top - 1)), DAY_LEVELS)


def day(at: Column) -> Column:
    """Blocks that hold a date."""
    return holders(_block_of_day(at), DAY_LEVELS)


def _block_of_day(c: Column) -> Column:
    return _floor(F.unix_date(c.cast("date")), DAY_UNIT)
