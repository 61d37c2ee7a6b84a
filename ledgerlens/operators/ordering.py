"""First-wins picks, positions within a group and lookups that hold under skew.

* A pick ("first by position", "best by score") is an aggregate, so it is combined
  before the shuffle and no group is ever gathered in one task.
* A position within a group is found from value ranges: the group is cut into ranges
  at its own quantiles, counted per range, and only single ranges are sorted.
* A lookup against one row per key spreads hot keys: their rows are joined by a
  broadcast of the hot keys alone, whose number has a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.session import cut_lineage

BROADCAST_ROWS = 200_000  # most rows of a derived table that is broadcast
HOT_SHARE = 10_000  # a key is hot when it holds more than 1 / HOT_SHARE of the rows


def key_hash(*keys: str) -> Column:
    """A number to group by in front of keys: rows are then sorted by it, where texts that begin alike are slow to compare."""
    return F.xxhash64(*keys).alias("_hash")


def first_by(df: DataFrame, keys: list[str], pos: str, columns: list[str] | None = None) -> DataFrame:
    """The row with the lowest `pos` per key, as a partial aggregate."""
    columns = columns or [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.col(pos)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in columns])


def best_by(df: DataFrame, keys: list[str], score: list[Column], pos: str, columns: list[str]) -> DataFrame:
    """The row with the highest score (numbers, not null) per key; the lowest `pos`, of any ordered type, among equals."""
    lowest = F.struct(*[(-s).alias(f"s{i}") for i, s in enumerate(score)], F.col(pos))
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), lowest).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in columns if c not in keys])


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows per key. Spark limits each partition before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= k)


def positions(
    df: DataFrame, keys: list[str], value: str, pos: str, name: str = "position", ranges: int = 64
) -> DataFrame:
    """1-based place of each row in its group by ascending (`value`, `pos`); `pos` is unique and numeric.

    Exact for any group size. A value that fills several quantiles gets a range of its
    own, which is cut further by `pos`. One group is sorted in pieces of about 1 / `ranges`
    of its rows; raise `ranges` for groups of many billions. The input is read three times,
    so a costly one should be stored first.
    """
    steps = [i / ranges for i in range(1, ranges)]
    cuts = df.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx(value, steps, 1000)).alias("_cuts"),
        F.array_distinct(F.percentile_approx(pos, steps, 1000)).alias("_pos_cuts"),
    )
    below = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    on_cut = F.array_contains("_cuts", F.col(value))
    placed = (
        small_lookup(df, cuts, keys)
        .withColumn("_range", below * 2 + on_cut.cast("int"))
        .withColumn("_part", F.when(on_cut, F.size(F.filter("_pos_cuts", lambda c: c < F.col(pos)))).otherwise(0))
        .drop("_cuts", "_pos_cuts")
    )
    cell = [*keys, "_range", "_part"]
    earlier = W.partitionBy(*keys).orderBy("_range", "_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (  # at most 2 * ranges * ranges rows per group
        placed.groupBy(*cell)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    local = F.row_number().over(W.partitionBy(*cell).orderBy(F.col(value), F.col(pos)))
    return (
        placed.withColumn("_local", local)
        .join(offsets, cell)
        .withColumn(name, (F.col("_local") + F.col("_before")).cast("long"))
        .drop("_range", "_part", "_local", "_before")
    )


def lookup(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a large frame to one row per key, without a hint.

    The small side is measured at run time: adaptive execution turns the join into a
    broadcast when it is below the configured size, and otherwise splits the partitions
    of hot keys, which the large side allows because the other side has one row per key.
    """
    return df.join(table, keys, how)


def measured(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """A result stored once, and whether it is small enough to send to every task."""
    stored = cut_lineage(df)
    return stored, stored.limit(rows + 1).count() <= rows


def small_lookup(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a large frame to a derived table that is expected to be small.

    The table is stored and counted first. Within BROADCAST_ROWS it is broadcast and the
    large side stays where it is; beyond that the join is a plain `lookup`.
    """
    stored, small = measured(table)
    return df.join(F.broadcast(stored), keys, how) if small else lookup(df, stored, keys, how)


def split_lookup(df: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """`lookup` for a key with known frequencies in `table[weight]`.

    Keys above 1 / HOT_SHARE of all rows number at most HOT_SHARE, so they are broadcast;
    the rows of all other keys are shuffled in groups no larger than that share.
    """
    hot = table.filter(F.col(weight) * HOT_SHARE > total)
    hot_keys = hot.select(key).withColumn("_hot", F.lit(True))
    marked = df.join(F.broadcast(hot_keys), key, "left")
    rest = marked.filter(F.col("_hot").isNull()).drop("_hot")
    return (
        marked.filter("_hot").drop("_hot").join(F.broadcast(hot), key)
        .unionByName(rest.join(table.filter(F.col(weight) * HOT_SHARE <= total), key))
    )
