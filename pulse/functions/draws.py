"""Seeded uniform draws from a hash of the draw's identity.

A draw depends only on (seed, row key, copy, position, purpose), never on the
partition a row lands in or the order rows arrive, so a re-run - or a retried
task on a lost executor - gives the same answer. The value is the first 32 bits
of md5 over the parts joined with '|', divided by 2^32: exact in a double and
the same in any engine that has md5 (the SQL oracle builds it the same way).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _part(p) -> Column:
    if isinstance(p, Column):
        return p.cast("string")
    return F.lit(str(p))


def draw_key(*parts) -> Column:
    return F.concat_ws("|", *[_part(p) for p in parts])


def uniform(*parts) -> Column:
    """u in [0, 1) from the md5 of the joined parts."""
    hex8 = F.substring(F.md5(draw_key(*parts)), 1, 8)
    return F.conv(hex8, 16, 10).cast("double") / F.lit(TWO_POW_32)


def pick(n: Column, *parts) -> Column:
    """An integer in [0, n) drawn from the parts (n > 0)."""
    return F.floor(uniform(*parts) * n).cast("int")
