"""Deterministic splits of a table's rows."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import kept


def check_range(n: int, offset: int, count: int) -> None:
    if offset < 0 or count < 0:
        raise ValueError("offset and count must not be negative")
    if offset + count > n:
        raise ValueError(f"asked for rows {offset} to {offset + count} of {n}")


def permutation(n: int, seed: int) -> list[int]:
    """The order in which a seeded shuffle leaves n row numbers."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order


def shuffled_split(df: DataFrame, row_col: str, n: int, seed: int, offset: int, count: int) -> DataFrame:
    """Rows at places [offset, offset + count) of the seeded shuffle, with their place. For tables that fit a driver's list of numbers."""
    check_range(n, offset, count)
    places = [(row, k) for k, row in enumerate(permutation(n, seed)) if offset <= k < offset + count]
    return df.join(df.sparkSession.createDataFrame(places, f"{row_col} int, place int"), row_col)


def hashed_split(df: DataFrame, id_col: str, shares: dict[str, float], seed: str = "0") -> DataFrame:
    """Add ``split`` by the first digits of a hash of the id: no row count is needed and no row moves."""
    if abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError("shares must sum to 1")
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    out, below = F.lit(list(shares)[-1]), 1.0
    for name, share in reversed(list(shares.items())[:-1]):
        below = sum(s for s in list(shares.values())[: list(shares).index(name) + 1])
        out = F.when(draw < below, name).otherwise(out)
    return df.withColumn("split", out)


def with_place(df: DataFrame, order: list[str], place: str = "place") -> DataFrame:
    """Add each row's place in an order, from 0, without bringing all rows together.

    Rows are dealt to ranges, sorted within them and numbered there; the ranges
    are counted, and each row adds the rows of the ranges before its own. What
    reaches the driver is a count for each range. The ranges are written to the
    shared folder first, as a second sampling could cut them elsewhere. The
    order must tell all rows apart, or equal ones take places in any order.
    """
    ranged = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    counts = sorted(ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, {}
    for c in counts:
        offsets[c.part] = before
        before += c.n
    table = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair]) if offsets else F.create_map().cast("map<bigint,int>")
    within = F.col("__id").bitwiseAND((1 << 33) - 1)
    return ranged.withColumn(place, (F.element_at(table, part) + within).cast("long")).drop("__id")


def ordered_slice(df: DataFrame, order: list[str], offset: int, count: int) -> DataFrame:
    """Rows [offset, offset + count) in an order, with their place; a range beyond the table raises."""
    rows = with_place(df, order)
    check_range(rows.count(), offset, count)
    return rows.where((F.col("place") >= offset) & (F.col("place") < offset + count))


ROUNDS = 4
#: Steps of a walk back into the range; each takes a number out of it with a chance of 1 in the root of the range.
WALKS = 64


def _sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permuted(x: Column, n: int, seed: int) -> Column:
    """Where a seeded permutation of 0 to n - 1 puts x: a Feistel network over two digits, walked on until it is in the range.

    Each row finds its place by itself, so a shuffle of any size needs no list.
    """
    a, b = _sides(n)

    def once(value: Column) -> Column:
        def turn(state: Column, k: Column) -> Column:
            digest = F.md5(F.concat_ws("|", F.lit(str(seed)), k.cast("string"), state["r"].cast("string")).cast("binary"))
            mixed = state["l"] + F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
            return F.struct(state["r"].alias("l"), F.pmod(mixed, F.when(k % 2 == 1, F.lit(a)).otherwise(F.lit(b)).cast("long")).alias("r"))

        start = F.struct((value % a).cast("long").alias("l"), F.floor(value / a).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["r"] * a + s["l"])

    walked = F.aggregate(F.sequence(F.lit(2), F.lit(WALKS)), once(x.cast("long")), lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a walk did not come back into the range")).cast("long"))


def permuted_split(df: DataFrame, order: list[str], seed: int, shares: dict[str, int]) -> DataFrame:
    """Rows with ``split``: the first count of the seeded shuffle go to the first name, and so on; the rest are left out.

    ``order`` gives the rows the numbers that are shuffled. More rows than
    there are raise.
    """
    rows = with_place(df, order, "row")
    n = rows.count()
    check_range(n, 0, sum(shares.values()))
    rows = rows.withColumn("place", permuted(F.col("row"), n, seed))
    name, below = F.lit(None).cast("string"), 0
    for split, count in shares.items():
        name = F.when((F.col("place") >= below) & (F.col("place") < below + count), split).otherwise(name)
        below += count
    return rows.withColumn("split", name).where("split is not null")
