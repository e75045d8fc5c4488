"""Queries of the training-data operators over the test tables, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.text import base_id, component, field_key
from ..plans.cut import cut, scratch
from .grouped_splits import grouped_splits, groups, split_audit
from .hidden_copies import collapsed, copies
from .leaks import leaks
from .near_duplicates import near_duplicate_groups, near_duplicate_pairs
from .overlaps import overlaps
from .packing import pack, pack_audit, pack_fill
from .paragraphs import paragraph_clusters
from .shared_spans import shared_share, shared_spans
from .stable_sample import stable_sample

#: Claims are compared by claim, passages by row.
FIELDS = {"text": ("claim_id", "text"), "text_b": ("_row_id", "text_b")}
PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
SAMPLE_RATE, CAPACITY = 0.125, 2048


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _tied_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, list[Column]]:
    columns = ["_row_id", "patent_application_id", "cited_document_id", "_u_target_component", "_date", "_parsed_date"]
    rows = _read(spark, folder, "test").select(columns).unionByName(_read(spark, folder, "generate_random_u").select(columns))
    return rows, [base_id("patent_application_id"), base_id("cited_document_id"), component("_u_target_component")]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    rows, keys = _tied_rows(spark, folder)
    return groups(rows, "_row_id", keys).where("group_size > 1").select("row_id", "group_row_id")


def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    rows, keys = _tied_rows(spark, folder)
    return grouped_splits(rows, "_row_id", keys, PROPORTIONS, F.coalesce(parse_date("_date"), F.col("_parsed_date").cast("date")))


def p1_proportions(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of rows that the splits reached."""
    return split_audit(cut(p1_splits(spark, folder)), PROPORTIONS)


def _both(passage: str) -> Column:
    claim, other = field_key("text"), field_key(passage)
    return F.when((claim != "") & (other != ""), F.concat_ws("\n", claim, other))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [copies(_read(spark, folder, t), "_row_id", _both(c)) for t, c in (("test", "text_b"), ("generate_random_u", "_normalized_passage"))]
    return parts[0].unionByName(parts[1])


def p2_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    parts = [collapsed(_read(spark, folder, t), "_row_id", _both(c)).select(F.lit(t).alias("source"), "kept_row_id", "copies") for t, c in (("test", "text_b"), ("generate_random_u", "_normalized_passage"))]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_pairs(_read(spark, folder, "test"), FIELDS, 0.6, 3, bands=72, rows=4)


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_groups(_read(spark, folder, "test"), FIELDS, 0.6, 3, bands=72, rows=4)


def _evaluation(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["_row_id", "claim_id", "cited_document_id", "text", "text_b"]
    return _read(spark, folder, "test").select(*columns, F.lit("test").alias("split")).unionByName(_read(spark, folder, "validation").select(*columns, F.lit("validation").alias("split")))


def _overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return overlaps(_evaluation(spark, folder), _read(spark, folder, "train"), FIELDS, 0.7, 3, bands=32, rows=4)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = _overlaps(spark, folder).where("eval_id <> train_id")
    return found.select("field", F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b")).distinct()


def p4_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Each pair's longest match, its words in matches of eight words or more, and these merged into spans ("first-stop" in training words)."""
    spans = F.array_join(F.transform("spans", lambda x: F.concat(x.first.cast("string"), F.lit("-"), x.stop.cast("string"))), ",")
    return _overlaps(spark, folder).withColumn("spans", spans)


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Claims and passages of each split and cited document that train holds too, with the same shingles or almost; their
    longest match with a training text, and the words of each in spans of matches with the training text that covers most."""
    best = _overlaps(spark, folder).groupBy("field", F.col("eval_id").alias("id")).agg(F.max("similarity").alias("s"), F.max("longest_span").alias("longest"), F.max("span_words").alias("covered"))
    rows = _evaluation(spark, folder).withColumn("document", F.coalesce(base_id("cited_document_id"), F.lit("")))
    ids = rows.select("split", "document", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(i).alias("id")) for f, (i, _) in FIELDS.items()])).alias("x")).select("split", "document", "x.field", "x.id").distinct()
    told = ids.join(best, ["field", "id"])
    count = lambda field, exact: F.count_if((F.col("field") == field) & ((F.col("s") == 1) == F.lit(exact)))
    counts = [count("text", True).alias("claims_same"), count("text", False).alias("claims_almost"), count("text_b", True).alias("passages_same"), count("text_b", False).alias("passages_almost")]
    return told.groupBy("split", "document").agg(*counts, F.max("longest").alias("longest_span"), F.sum("covered").alias("span_words"))


def p5_sample_rows(spark: SparkSession, folder: str) -> DataFrame:
    """With stored numbers, here of a first load."""
    rows = _read(spark, folder, "test")
    return stable_sample(rows, F.col("_row_id"), "_loaded_at", SAMPLE_RATE, numbers=scratch(spark, "numbers")).select(F.col("unit").alias("row_id"), "seq")


def p5_sample_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of the sampled cited documents; the spellings of a document count as one."""
    rows = _read(spark, folder, "test").select("_row_id", "cited_document_id", "_loaded_at").withColumn("document", base_id("cited_document_id"))
    chosen = stable_sample(rows, F.col("document"), "_loaded_at", SAMPLE_RATE, numbers=scratch(spark, "numbers")).select(F.col("unit").alias("document"), "seq")
    return rows.join(chosen, "document").select(F.col("_row_id").alias("row_id"), "document", "seq")


def p6_pack(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_read(spark, folder, "documents"), "doc_id", "text", CAPACITY)


def p6_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in containers, whole or in order, and none of these above the capacity."""
    documents = _read(spark, folder, "documents")
    return pack_audit(cut(pack(documents, "doc_id", "text", CAPACITY)), documents, "doc_id", "text", CAPACITY)


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    return pack_fill(_read(spark, folder, "documents"), "doc_id", "text", CAPACITY)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Parts without a replaced word, of those found with one replaced word allowed."""
    return p7_leaks(spark, folder).where("equal_words = window_words").select("item_id", "doc_id")


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """With one word replaced in a part, too; how many words of the best part agree, and where the parts lie."""
    found = leaks(_read(spark, folder, "documents"), _read(spark, folder, "heldout_items"), max_substitutions=1)
    return found.withColumnRenamed("item", "item_id").withColumnRenamed("doc", "doc_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans(_read(spark, folder, "documents"), "doc_id", "text", 200)


def p8_share(spark: SparkSession, folder: str) -> DataFrame:
    return shared_share(_read(spark, folder, "documents"), "doc_id", "text", 200)


def p8_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of paragraphs alike as wholes, by sketches and bands: not the shared stretches of p8_found."""
    return paragraph_clusters(_read(spark, folder, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_splits, p1_proportions, p2_found, p2_collapsed, p3_found, p3_groups, p4_found, p4_spans, p4_report, p5_sample_rows, p5_sample_documents, p6_pack, p6_audit, p6_fill, p7_found, p7_leaks, p8_found, p8_share, p8_paragraphs)}
