"""Audits of splits: shared values, contamination, conflicts, duplicates, invariants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import pair_hash
from ..functions.text import normalize_text


def _long(df: DataFrame, split: str, relations: dict[str, Column]) -> DataFrame:
    """``split``, ``relation``, ``value`` (its MD5, which is what moves): one row for each row and relation; null and '' and rows without a split left out."""
    items = F.array(*[F.struct(F.lit(n).alias("relation"), c.cast("string").alias("value")) for n, c in relations.items()])
    return df.select(F.col(split).alias("split"), F.explode(items).alias("__x")).select("split", "__x.relation", "__x.value").where("value <> '' and split is not null").withColumn("value", F.unhex(F.md5("value")))


def _split_counts(df: DataFrame, split: str, relations: dict[str, Column]) -> DataFrame:
    """``relation``, ``value``, ``n`` (rows by split): one shuffle for all relations; a hot value is combined map-side."""
    counts = _long(df, split, relations).groupBy("relation", "value", "split").agg(F.count("*").alias("n"))
    return counts.groupBy("relation", "value").agg(F.map_from_entries(F.collect_list(F.struct("split", "n"))).alias("n"))


def cross_split_overlaps(df: DataFrame, split: str, relations: dict[str, Column]) -> DataFrame:
    """``relation``, ``first``, ``second``, ``shared``: distinct values that two splits have in common; pairs with none are left out."""
    names = F.array_sort(F.map_keys("n"))
    wide = _split_counts(df, split, relations).select("relation", names.alias("s")).where("size(s) > 1")
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    return wide.select("relation", F.explode(pairs).alias("p")).groupBy("relation", F.col("p.first").alias("first"), F.col("p.second").alias("second")).agg(F.count("*").alias("shared"))


def cross_split_statistics(df: DataFrame, split: str, relations: dict[str, Column], train: str = "train", test: str = "test") -> DataFrame:
    """For each relation: values in several splits and the rows that have them, values in train and test and
    their rows, and the test rows contaminated by train, in number and share. A relation without values is left out."""
    c = _split_counts(df, split, relations)
    tr, te = F.coalesce(F.col("n")[train], F.lit(0)), F.coalesce(F.col("n")[test], F.lit(0))
    total = F.aggregate(F.map_values("n"), F.lit(0).cast("long"), lambda a, x: a + x)
    shared, both = F.size("n") > 1, (tr > 0) & (te > 0)
    agg = c.groupBy("relation").agg(
        F.count_if(shared).alias("shared_values"),
        F.sum(F.when(shared, total).otherwise(0)).alias("rows_affected"),
        F.count_if(both).alias("train_test_values"),
        F.sum(F.when(both, tr + te).otherwise(0)).alias("train_test_rows"),
        F.sum(F.when(both, te).otherwise(0)).alias("contaminated_rows"),
        F.sum(te).alias("test_rows"),
    )
    return agg.withColumn("contamination", F.round(F.coalesce(F.col("contaminated_rows") / F.nullif("test_rows", F.lit(0)), F.lit(0.0)), 6))


def relation_sweep(df: DataFrame, splits: Sequence[str], relations: dict[str, Column]) -> DataFrame:
    """cross_split_statistics under several split columns at once, with ``condition`` naming the column."""
    stacked = df.withColumn("__c", F.explode(F.array(*[F.struct(F.lit(s).alias("condition"), F.col(s).alias("split")) for s in splits])))
    marked = {f"{c}|{n}": F.when(F.col("__c.condition") == c, v) for c in splits for n, v in relations.items()}
    out = cross_split_statistics(stacked.withColumn("__split", F.col("__c.split")), "__split", marked)
    return out.withColumn("condition", F.substring_index("relation", "|", 1)).withColumn("relation", F.substring_index("relation", "|", -1))


def release_report(df: DataFrame, split: str, label: str, query: Column, passage: Column, relations: dict[str, Column]) -> DataFrame:
    """``check``, ``subject``, ``value``: rows by split and label, repeated normalized pairs, queries with several uncited rows, and shared values."""
    pair = F.concat_ws("\n", query, passage)
    counts = df.groupBy(split, label).agg(F.count("*").alias("v")).select(F.lit("rows").alias("check"), F.concat_ws("/", split, F.col(label).cast("string")).alias("subject"), F.col("v").alias("value"))
    pairs = df.groupBy(split, F.sha2(pair, 256).alias("h")).agg(F.count("*").alias("c")).groupBy(split).agg(F.sum(F.col("c") - 1).alias("value")).select(F.lit("repeated_pairs").alias("check"), F.col(split).alias("subject"), "value")
    several = df.groupBy(split, F.sha2(query, 256).alias("h")).agg(F.count_if(F.col(label) == 2).alias("u")).groupBy(split).agg(F.count_if(F.col("u") > 1).alias("value")).select(F.lit("queries_with_several_u").alias("check"), F.col(split).alias("subject"), "value")
    shared = cross_split_overlaps(df, split, relations).select(F.lit("shared_values").alias("check"), F.concat_ws("/", "relation", "first", "second").alias("subject"), F.col("shared").alias("value"))
    return counts.unionByName(pairs).unionByName(several).unionByName(shared)


def clean_pairs(df: DataFrame, claim: str, passage: str, label: str, order: Sequence[str]) -> DataFrame:
    """``df`` with ``pair`` (a hash of the normalized texts) and ``reason``: conflicting_label for all rows of a pair with
    several labels, duplicate for all but the first row in ``order`` of any other pair, else null (kept).

    Labels are counted with map-side combining, so a pair that very many rows share is fine there; the
    first row comes from a minimum over ``order``, not from a window.
    """
    keyed = df.withColumn("pair", pair_hash(normalize_text(claim), normalize_text(passage)))
    facts = keyed.groupBy("pair").agg(F.countDistinct(label).alias("__l"), F.min(F.struct(*order)).alias("__f"))
    joined = keyed.join(facts, "pair")
    reason = F.when(F.col("__l") > 1, "conflicting_label").when(F.struct(*order) != F.col("__f"), "duplicate")
    return joined.withColumn("reason", reason).drop("__l", "__f")


def extract_marked(df: DataFrame, marker: str | None, kept: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Rows set aside: those with a true ``marker`` column, else those whose ``key`` isn't among the ``kept`` rows."""
    if marker and marker in df.columns:
        return df.where(F.lower(F.col(marker).cast("string")).isin("1", "true", "t", "yes", "y"))
    return df.join(kept.select(key).distinct(), key, "left_anti")


def one_anchor(df: DataFrame, query: str, wanted: Column, values: Sequence[str]) -> DataFrame:
    """The values of each query's single wanted row, the number of its rows, and ``several``, true where it has more than one."""
    w = F.when(wanted, F.struct(*values))
    agg = df.groupBy(query).agg(F.count_if(wanted).alias("__u"), F.count("*").alias("rows"), F.min(w).alias("__v"))
    return agg.where("__u > 0").select(query, *[F.col(f"__v.{v}").alias(v) for v in values], "rows", (F.col("__u") > 1).alias("several"))


def manifest_report(df: DataFrame, by: Sequence[str], query: str, cited: Column, texts: Sequence[str], expected: DataFrame | None = None) -> DataFrame:
    """For each group of a manifest: ``rows``, ``queries``, ``cited_rows``, ``u_rows`` and ``no_<text>``, rows without a text.

    With ``expected`` (``by`` and the first four columns) also ``valid``: the counts are as expected and no text is missing; a group
    that only one side has isn't."""
    q = F.trim(F.col(query).cast("string"))
    told = df.groupBy(*by).agg(F.count("*").alias("rows"), F.countDistinct(q).alias("queries"), F.count_if(cited == 1).alias("cited_rows"), F.count_if(cited == 0).alias("u_rows"), *[F.count_if(F.col(t).isNull()).alias(f"no_{t}") for t in texts])
    if expected is None:
        return told
    names = ("rows", "queries", "cited_rows", "u_rows")
    both = told.join(expected.select(*by, *[F.col(c).alias(f"__{c}") for c in names]), list(by), "full")
    ok = F.lit(True)
    for c in names:
        ok = ok & F.coalesce(F.col(c) == F.col(f"__{c}"), F.lit(False))
    for t in texts:
        ok = ok & (F.coalesce(F.col(f"no_{t}"), F.lit(1)) == 0)
    return both.select(*told.columns, ok.alias("valid"))
