"""Splits that keep tied records together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..plans.cut import cut
from ..plans.sequence import global_running


def groups(df: DataFrame, id_col: str, keys: Sequence[Column], hops: int = 2, small_graph: int = 200_000) -> DataFrame:
    """``row_id``, ``group_row_id`` and ``group_size`` for every id: the least id tied to it.

    Rows are tied by an equal value of the same key (null and '' tie nothing), through other rows
    too; rows with the same id are one record. Rows with a null id are left out. Keys are joined
    within a row only, so a value that a third of the rows hold costs one edge a row.
    """
    marked = [F.when(k != "", F.concat(F.lit(f"{i}:"), k)) for i, k in enumerate(keys)]
    rows = df.select(F.col(id_col).cast("string").alias("row_id"), F.array_compact(F.array(*marked)).alias("ks")).where("row_id is not null")
    # An id that occurs once needs no node of its own; it hangs on its first key.
    several = rows.groupBy("row_id").agg(F.count("*").alias("c")).where("c > 1").select("row_id", F.lit(True).alias("again"))
    rows = cut(rows.join(several, "row_id", "left").withColumn("ks", F.when(F.col("again"), F.concat(F.array(F.concat(F.lit("r:"), "row_id")), "ks")).otherwise(F.col("ks"))).drop("again"))
    edges = rows.where("size(ks) > 1").select(F.get("ks", F.lit(0)).alias("u"), F.explode(F.slice("ks", 2, len(keys) + 1)).alias("v"))
    found = components(edges, "u", "v", hops, small_graph)
    first = rows.select("row_id", F.get("ks", F.lit(0)).alias("node")).dropDuplicates(["row_id"])
    named = first.join(found, "node", "left").select("row_id", F.coalesce("component", "node", F.concat(F.lit("r:"), "row_id")).alias("comp"))
    named = cut(named)
    sizes = named.groupBy("comp").agg(F.min("row_id").alias("group_row_id"), F.count("*").alias("group_size"))
    return named.join(sizes, "comp").select("row_id", "group_row_id", "group_size")


def grouped_splits(df: DataFrame, id_col: str, keys: Sequence[Column], proportions: dict[str, float], day: Column | None = None) -> DataFrame:
    """``row_id``, ``group_row_id``, ``split``: whole groups of tied rows in splits of about the given proportions.

    Groups come in the order of their mean day (groups without a day last), those of one day and
    all groups without ``day`` in the order of a hash, and fill the splits in the order given. A
    group larger than half the smallest split would shift the borders, so it is placed first, in
    the split with the most room; there are fewer than two for each smallest share of the rows.
    Running totals come from range partitions, not from one task.
    """
    total_share = sum(proportions.values())
    shares = {k: v / total_share for k, v in proportions.items()}
    tied = cut(groups(df, id_col, keys))
    days = df.select(F.col(id_col).cast("string").alias("row_id"), (F.unix_date(day) if day is not None else F.lit(None).cast("int")).alias("d")).groupBy("row_id").agg(F.min("d").alias("d"))
    per = tied.join(days, "row_id", "left").groupBy("group_row_id").agg(F.count("*").alias("n"), F.floor(F.avg("d")).alias("d"))
    per = cut(per.withColumn("h", F.md5("group_row_id")))
    n = per.agg(F.sum("n").alias("n")).first().n or 0
    limit = n * min(shares.values()) / 2
    room = {k: v * n for k, v in shares.items()}
    placed = []
    # Bounded: each has more than limit rows.
    for r in per.where(F.col("n") > limit).orderBy(F.desc("n"), "group_row_id").collect() if n else []:
        name = max(room, key=lambda k: room[k])
        room[name] -= r.n
        placed.append((r.group_row_id, name))
    rest = per.where(F.col("n") <= limit)
    left = {k: max(0.0, v) for k, v in room.items()}
    scale = (sum(room.values()) / sum(left.values())) if sum(left.values()) > 0 else 0
    order = [F.col("d").asc_nulls_last(), "h", "group_row_id"]
    keyed = rest.withColumn("no_day", F.col("d").isNull())
    run = global_running(keyed, ["no_day", "d", *order[1:]], {"before": "n"})
    split, border = F.lit(list(shares)[-1]), sum(left.values()) * scale
    for name in reversed(list(shares)[:-1]):
        border -= left[list(shares)[list(shares).index(name) + 1]] * scale
        split = F.when(F.col("before") + F.col("n") / 2 <= border, name).otherwise(split)
    chosen = run.select("group_row_id", split.alias("split"))
    if placed:
        chosen = chosen.unionByName(df.sparkSession.createDataFrame(placed, "group_row_id string, split string"))
    return tied.join(chosen, "group_row_id").select("row_id", "group_row_id", "split")


def split_audit(splits: DataFrame, proportions: dict[str, float]) -> DataFrame:
    """``split``, ``rows``, ``groups``, ``share`` reached and ``wanted`` for each split asked for, and ``torn`` groups (in several splits)."""
    total = sum(proportions.values())
    asked = splits.sparkSession.createDataFrame([(k, v / total) for k, v in proportions.items()], "split string, wanted double")
    per = splits.groupBy("split", "group_row_id").agg(F.count("*").alias("n"))
    torn = per.groupBy("group_row_id").agg(F.count("*").alias("k"), F.sum("n").alias("n")).agg(F.count_if(F.col("k") > 1).alias("torn"), F.sum("n").alias("all"))
    sizes = asked.join(per.groupBy("split").agg(F.sum("n").alias("rows"), F.count("*").alias("groups")), "split", "left")
    zero = F.lit(0).cast("long")
    return sizes.crossJoin(F.broadcast(torn)).select("split", F.coalesce("rows", zero).alias("rows"), F.coalesce("groups", zero).alias("groups"), F.round(F.coalesce("rows", zero) / F.col("all"), 6).alias("share"), "wanted", "torn")
