"""Joins with the checks and fallbacks that evaluation data need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut
from ..plans.sequence import global_running
from .schema import require_unique


def one_to_one(left: DataFrame, right: DataFrame, key: str, agree: str | None = None) -> DataFrame:
    """Inner join on a key that is unique on both sides (checked); with ``agree``, a column of both, its values must be equal.

    The right side's other columns that the left side has too get the suffix _right."""
    require_unique(left, [key])
    require_unique(right, [key])
    r = right.select(key, *[F.col(c).alias(f"{c}_right" if c in left.columns else c) for c in right.columns if c != key])
    joined = left.join(r, key)
    if agree:
        bad = joined.where(~F.col(agree).eqNullSafe(F.col(f"{agree}_right"))).count()
        if bad:
            raise ValueError(f"{bad} rows differ in {agree}")
        joined = joined.drop(f"{agree}_right")
    return joined


def in_template_order(template: DataFrame, order: str, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row of the template in its order, with the right side's columns or nulls."""
    return template.join(right, list(keys), "left").orderBy(order)


def with_fallback(df: DataFrame, keys: Sequence[str], lookup: DataFrame, lookup_key: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the lookup's value for the first of ``keys`` that it has, else null. The lookup's keys are unique."""
    out, found = df, []
    for i, k in enumerate(keys):
        one = lookup.select(F.col(lookup_key).alias(k), F.col(value).alias(f"__v{i}"))
        out = out.join(one, k, "left")
        found.append(f"__v{i}")
    return out.withColumn(name, F.coalesce(*found)).select(*df.columns, name)


def by_source(df: DataFrame, kind: str, key: str, sources: dict[str, DataFrame], id_col: str, value: str) -> DataFrame:
    """Each row's ``value`` from the table that its ``kind`` names; the tables go into one tagged lookup."""
    tagged = None
    for name, t in sources.items():
        one = t.select(F.lit(name).alias(kind), F.col(id_col).alias(key), F.col(value).alias(value))
        tagged = one if tagged is None else tagged.unionByName(one)
    return df.join(tagged, [kind, key], "left")


def owners(df: DataFrame, query: str, wanted: Column) -> DataFrame:
    """The rows of queries that own a row with ``wanted``; null queries own nothing."""
    return df.join(df.where(wanted).select(query).distinct(), query, "left_semi")


def salted(left: DataFrame, left_key: str, spread: Column, right: DataFrame, right_key: str, rows: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join that makes many rows from few keys, partitioned by key and salt: ``__s`` and ``__t``.

    A key gets a salt for each ``rows`` of its left rows, taken from ``spread``; the right side's rows are repeated for each. The
    number of partitions is stated, so that they aren't merged for being small: the work lies in what they make."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = left.groupBy(F.col(left_key).alias("__key")).agg(F.ceil(F.count("*") / rows).cast("int").alias("__salts"))
    a = left.join(salts, F.col(left_key) == F.col("__key")).withColumn("__s", F.pmod(F.xxhash64(spread), F.col("__salts")).cast("int"))
    b = right.join(salts, F.col(right_key) == F.col("__key")).withColumn("__t", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)))
    drop = ("__key", "__salts")
    return a.drop(*drop).repartition(n, left_key, "__s"), b.drop(*drop).repartition(n, right_key, "__t")


def sharing(left: DataFrame, left_id: str, left_set: str, right: DataFrame, right_id: str, right_set: str, residual: Column | None = None, unique_ids: bool = False) -> DataFrame:
    """Distinct pairs of ids whose sets have an element in common and that pass ``residual``.

    Sets are exploded and joined on the element, with the residual inside the join; elements are
    salted, as few of them may hold most sets. Null and empty sets share nothing. A pair comes
    out for the least common element only; with ``unique_ids`` that makes pairs distinct without a shuffle.
    """
    # The other columns stay for the residual; names must differ between the sides.
    a = left.where(F.size(left_set) > 0).withColumn("__e", F.explode(F.array_distinct(left_set)))
    b = right.where(F.size(right_set) > 0).withColumn("__f", F.explode(F.array_distinct(right_set)))
    a, b = salted(a, "__e", F.col(left_id), b, "__f")
    on = (F.col("__e") == F.col("__f")) & (F.col("__s") == F.col("__t")) & (F.col("__e") == F.array_min(F.array_intersect(left_set, right_set)))
    pairs = a.join(b, on if residual is None else on & residual).select(left_id, right_id)
    return pairs if unique_ids else pairs.distinct()


def count_before(left: DataFrame, day: str, right: DataFrame, right_day: str, name: str) -> DataFrame:
    """``left`` with ``name``: the number of right rows strictly before its ``day``; null without a day.

    No pairs are compared: the rights' counts by day and the lefts' days are put in one order with running totals."""
    days = left.select(F.col(day).alias("__d")).where("__d is not null").distinct()
    n = right.groupBy(F.col(right_day).alias("__d")).agg(F.count("*").alias("__n")).where("__d is not null")
    both = n.unionByName(days.select("__d", F.lit(0).cast("long").alias("__n"))).groupBy("__d").agg(F.sum("__n").alias("__n"))
    run = global_running(both, ["__d"], {name: "__n"}).select(F.col("__d").alias(day), name)
    return left.join(run, day, "left")


def excluding(pairs: DataFrame, relations: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Pairs that are in none of the relations; one anti join, as the relations are put together first."""
    all_of = relations[0].select(*keys)
    for r in relations[1:]:
        all_of = all_of.union(r.select(*keys))
    return pairs.join(all_of.distinct(), list(keys), "left_anti")


def bridged_flags(flags: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """``key``, ``flag`` over several alias columns; an alias with different flags is an error (an action)."""
    long = flags.select(F.explode(F.array(*[F.col(k).cast("string") for k in keys])).alias("key"), flag).where("key is not null")
    one = cut(long.groupBy("key").agg(F.countDistinct(flag).alias("__n"), F.max(flag).alias(flag)))
    bad = one.where("__n > 1").count()
    if bad:
        raise ValueError(f"{bad} aliases with different flags")
    return one.select("key", flag)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in ``order``; a null is a key like any other. Combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__v"))
    return first.select(*[F.col(c) if c in keys else F.col("__v")[c].alias(c) for c in df.columns])


def last_values(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: str) -> DataFrame:
    """``keys`` and the values of each key's last row in ``order``; combined map-side, so a hot key is no task of its own."""
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("__v"))
    return agg.select(*keys, *[F.col(f"__v.{v}").alias(v) for v in values])


def caliper_match(df: DataFrame, query: str, treated: Column, id_col: str, features: dict[str, tuple[float, float]], caliper: float | None) -> DataFrame:
    """``query``, ``id``, ``match``, ``distance``: for each treated row the nearest other row of its query.

    The distance is the largest absolute difference of the standardized features (name -> mean and standard
    deviation); ties take the least id. Rows beyond ``caliper`` are left out. Pairs are formed within a query only.
    """
    cols = [F.col(query).alias("q"), F.col(id_col).alias("i"), *[((F.col(f) - F.lit(m)) / F.lit(s if s else 1.0)).alias(f"z{k}") for k, (f, (m, s)) in enumerate(features.items())]]
    a, b = df.where(treated).select(*cols), df.where(~treated).select(*[c.alias(n) for c, n in zip(cols, ["q", "j", *[f"y{k}" for k in range(len(features))]])])
    gaps = [F.abs(F.col(f"z{k}") - F.col(f"y{k}")) for k in range(len(features))]
    d = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    best = a.join(b, "q").select("q", "i", "j", d.alias("d")).where("d is not null").groupBy("q", "i").agg(F.min(F.struct("d", "j")).alias("b"))
    out = best.select(F.col("q").alias(query), F.col("i").alias("id"), F.col("b.j").alias("match"), F.col("b.d").alias("distance"))
    return out if caliper is None else out.where(F.col("distance") <= caliper)
