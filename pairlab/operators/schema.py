"""Checks of tables, and names and identifiers that differ between exports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_id, normalize_id


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    """``df``, or an error naming the columns that it lacks."""
    lacking = [c for c in needed if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {lacking}")
    return df


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, or an error with the number of keys that occur more than once (an action). Nulls are a key."""
    twice = df.groupBy(*keys).count().where("count > 1").count()
    if twice:
        raise ValueError(f"{twice} values of {keys} occur more than once")
    return df


def _plain(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def resolve_columns(df: DataFrame, wanted: dict[str, list[str]]) -> dict[str, str]:
    """For each wanted name the column whose name fits one of its aliases, in their order, whatever the
    case and punctuation; an error if none fits."""
    by_plain = {}
    for c in df.columns:
        by_plain.setdefault(_plain(c), c)
    out = {}
    for name, aliases in wanted.items():
        found = next((by_plain[_plain(a)] for a in [name, *aliases] if _plain(a) in by_plain), None)
        if found is None:
            raise ValueError(f"no column for {name}: {df.columns}")
        out[name] = found
    return out


def best_overlap_column(df: DataFrame, candidates: list[str], other: DataFrame, key: str) -> str:
    """Of several id columns the one with the most distinct values among ``other``'s keys; the first on ties."""
    keys = other.select(F.col(key).cast("string").alias("__k")).distinct()
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("__k")) for i, c in enumerate(candidates)])).alias("x")).select("x.i", "x.__k").distinct()
    counts = {r.i: r.n for r in stacked.join(keys, "__k").groupBy("i").agg(F.count("*").alias("n")).collect()}
    return max(enumerate(candidates), key=lambda x: (counts.get(x[0], 0), -x[0]))[1]


def alias_table(meta: DataFrame, id_col: str, base_col: str, order: str) -> DataFrame:
    """``alias``, ``target``: a document's spellings and base forms with its base; of several rows the last counts."""
    own = base_id(id_col)
    m = meta.select(normalize_id(id_col).alias("exact"), own.alias("base"), F.coalesce(F.when(base_id(base_col) != "", base_id(base_col)), own).alias("target"), F.col(order).alias("o")).where("exact <> ''")
    both = m.select(F.col("exact").alias("alias"), "target", "o").union(m.select("base", "target", "o"))
    return both.groupBy("alias").agg(F.max_by("target", "o").alias("target"))


def resolved(exact: DataFrame, meta: DataFrame, meta_id: str, meta_base: str, order: str) -> DataFrame:
    """``exact`` (normalized spellings, distinct) with ``target``, as resolve_ids finds it: ids move here, not the rows that have them."""
    aliases = alias_table(meta, meta_id, meta_base, order)
    first = aliases.select(F.col("alias").alias("exact"), F.col("target").alias("__t1"))
    second = aliases.select(F.col("alias").alias("__base"), F.col("target").alias("__t2"))
    joined = exact.withColumn("__base", base_id("exact")).join(first, "exact", "left").join(second, "__base", "left")
    return joined.select("exact", F.coalesce("__t1", "__t2", "__base").alias("target"))


def resolve_ids(df: DataFrame, id_col: str, meta: DataFrame, meta_id: str, meta_base: str, order: str, name: str) -> DataFrame:
    """``df`` with ``name``: the base of ``id_col`` by its alias, else by its base form's alias, else its base form.

    Null and empty ids give ''. The joins broadcast the alias table only where Spark finds it small enough.
    """
    aliases = alias_table(meta, meta_id, meta_base, order)
    keyed = df.withColumn("__exact", normalize_id(id_col)).withColumn("__base", F.coalesce(base_id(id_col), F.lit("")))
    first = aliases.select(F.col("alias").alias("__exact"), F.col("target").alias("__t1"))
    second = aliases.select(F.col("alias").alias("__base"), F.col("target").alias("__t2"))
    joined = keyed.join(first, "__exact", "left").join(second, "__base", "left")
    return joined.withColumn(name, F.coalesce("__t1", "__t2", "__base")).select(*df.columns, name)
