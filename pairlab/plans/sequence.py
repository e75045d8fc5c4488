"""Global order, ranks and running totals without a window over all rows.

Rows are range-partitioned and sorted; what is gathered is one number for each
partition. The order columns must together be unique, else ties fall in any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .cut import cut

_LOW = (1 << 33) - 1
#: A column or its name, or one of these and "desc" (nulls last).
Order = Column | str | tuple[Column | str, str]


def global_sequence(df: DataFrame, order: Sequence[Order], name: str = "seq", partitions: int | None = None) -> DataFrame:
    """``df`` with the 0-based position of each row in ``order`` (BIGINT, named ``name``).

    Nulls order as Spark orders them (first when ascending). An empty table stays
    empty. Range bounds come from a sample of the rows, so the ordered rows are
    checkpointed before the partitions are counted.
    """
    return global_running(df, order, {name: None}, partitions)


def global_running(df: DataFrame, order: Sequence[Order], totals: dict[str, str | None], partitions: int | None = None) -> DataFrame:
    """``df`` with exclusive running totals in ``order``: ``totals`` maps an output name to a
    column to sum (null counts as 0), or to None for the row's position."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    down = [isinstance(c, tuple) for c in order]
    by = [c[0] if isinstance(c, tuple) else c for c in order]
    by = [F.col(c) if isinstance(c, str) else c for c in by]
    # Keys as plain columns: range bounds over expressions would be computed again for each row.
    keyed = df.select("*", *[c.alias(f"__o{i}") for i, c in enumerate(by)])
    keys = [f"__o{i}" for i in range(len(by))]
    sorts = [F.col(k).desc_nulls_last() if d else F.col(k).asc_nulls_first() for k, d in zip(keys, down)]
    ranged = keyed.repartitionByRange(n, *sorts).sortWithinPartitions(*sorts).drop(*keys)
    ranged = cut(ranged.withColumn("__mid", F.monotonically_increasing_id()))
    part = F.shiftright("__mid", 33)
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0)) if c else F.lit(1)).alias(f"__s{i}") for i, c in enumerate(totals.values())]
    per = ranged.groupBy(part.alias("__part")).agg(*sums)
    # One row for each partition: a window over all of them is small whatever the data.
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = per.select("__part", *[F.coalesce(F.sum(f"__s{i}").over(before), F.lit(0)).alias(f"__b{i}") for i in range(len(totals))])
    joined = ranged.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    within = W.partitionBy("__part").orderBy("__mid").rowsBetween(W.unboundedPreceding, -1)
    out = joined
    for i, (name, c) in enumerate(totals.items()):
        if c is None:
            out = out.withColumn(name, F.col(f"__b{i}") + F.col("__mid").bitwiseAND(F.lit(_LOW)))
        else:
            out = out.withColumn(name, F.col(f"__b{i}") + F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))).over(within), F.lit(0)))
    return out.select(*df.columns, *totals)


def running(df: DataFrame, by: Sequence[str], order: Sequence[Order], totals: dict[str, str | None]) -> DataFrame:
    """``df`` with exclusive running totals in each group: ``totals`` maps an output name to a column (summed, not negative)
    or to None (rows counted).

    Totals come from range partitions over (group, order), less the total before the group, so a group
    that holds most rows is spread like any other; null is a group too.
    """
    names = {f"__t{i}": c for i, c in enumerate(totals.values())}
    whole = global_running(df, [*by, *order], names)
    if not by:
        return whole.withColumnsRenamed(dict(zip(names, totals)))
    keys = [F.col(b).alias(f"__g{i}") for i, b in enumerate(by)]
    start = whole.groupBy(*keys).agg(*[F.min(t).alias(f"{t}m") for t in names])
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__g{i}"))
    joined = whole.join(start, same)
    return joined.select(*df.columns, *[(F.col(t) - F.col(f"{t}m")).alias(n) for t, n in zip(names, totals)])
