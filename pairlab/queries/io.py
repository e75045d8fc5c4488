"""Sources and sinks (s01-s18); what is written goes to the session's shared scratch folder and is read again."""

from __future__ import annotations

import glob
import os
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import scratch
from ..sources import tables as S
from .fixtures import METRICS, scored_metrics
from .registry import query, table


@query("SELECT 'train' AS split, count(*) AS rows, count(DISTINCT _row_id) AS ids FROM train UNION ALL SELECT 'validation', count(*), count(DISTINCT _row_id) FROM validation UNION ALL SELECT 'test', count(*), count(DISTINCT _row_id) FROM test")
def s01_load_splits(spark: SparkSession, folder: str) -> DataFrame:
    """At a pinned revision of the files."""
    names = ["train", "validation", "test"]
    return S.load_splits(spark, folder, names, pinned=S.revision(spark, folder, names)).groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("_row_id").alias("ids"))


@query("SELECT _row_id, label FROM train")
def s02_pruned_load(spark: SparkSession, folder: str) -> DataFrame:
    return S.load_splits(spark, folder, ["train"], ["_row_id", "label"]).drop("split")


@query("SELECT _row_id, text_b, label::VARCHAR AS label FROM test WHERE text_b <> ''")
def s03_csv_strings(spark: SparkSession, folder: str) -> DataFrame:
    """Texts written as CSV (s12) and read back as strings."""
    path = scratch(spark, "csv")
    S.write_csv(table(spark, folder, "test").where("text_b <> ''").select("_row_id", "text_b", "label"), path)
    return S.read_csv(spark, path, ["_row_id", "text_b", "label"], multi_line=True)


@query("SELECT _row_id, label, _u_bm25_score FROM test")
def s04_csv_schema(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "csv")
    S.write_csv(table(spark, folder, "test").select("_row_id", "label", "_u_bm25_score"), path)
    return S.read_csv(spark, path, "_row_id string, label int, _u_bm25_score double")


@query("SELECT _row_id, label, _u_bm25_score, _u_bm25_score IS NOT NULL AS scored FROM test")
def s04_csv_inferred(spark: SparkSession, folder: str) -> DataFrame:
    """Types found by a pass over the file, from an address instead of a path."""
    path = scratch(spark, "csv")
    S.write_csv(table(spark, folder, "test").select("_row_id", "label", "_u_bm25_score", F.col("_u_bm25_score").isNotNull().alias("scored")), path)
    return S.read_csv(spark, path)


@query("SELECT doc_id, lang FROM documents")
def s05_parquet_scan(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "lang")


@query("SELECT training_condition, seed::VARCHAR AS seed, count(*) AS rows FROM predictions_long GROUP BY ALL")
def s06_grid_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A file for each condition and seed, put together again under a check that the grid is full."""
    p = table(spark, folder, "predictions_long")
    base, paths = scratch(spark, "grid"), {}
    p.select("training_condition", "seed", "source_row_id").write.partitionBy("training_condition", "seed").parquet(base)
    for r in p.select("training_condition", "seed").distinct().collect():  # the grid's cells
        paths[(r.training_condition, str(r.seed))] = f"{base}/training_condition={r.training_condition}/seed={r.seed}"
    return S.read_grid(spark, paths, ["training_condition", "seed"]).groupBy("training_condition", "seed").agg(F.count("*").alias("rows"))


@query("SELECT 0::BIGINT AS row_pos, -1.5::DOUBLE AS l0, 1.5::DOUBLE AS l1 UNION ALL SELECT 1, -0.25, 0.25")
def s08_npz_logits(spark: SparkSession, folder: str) -> DataFrame:
    with tempfile.TemporaryDirectory() as d:  # read by the driver only
        np.savez(os.path.join(d, "x.npz"), logits=np.array([1.5, 0.25], dtype=np.float16))
        return S.read_npz_logits(spark, S.find_file(spark, d, "x", "npz"), classes=2)


@query("SELECT * FROM (VALUES ('n_nationkey'), ('n_name'), ('n_regionkey')) t(name)")
def s09_schema_probe(spark: SparkSession, folder: str) -> DataFrame:
    return S.parquet_schema(spark, f"{folder}/nation.parquet").select("name")


@query("SELECT unnest(['customer', 'doc_metadata', 'documents', 'embeddings', 'events', 'generate_random_u', 'heldout_items', 'nation', 'part', 'predictions_long', 'quarantine', 'region', 'supplier', 'test', 'train', 'validation']) || '.parquet' AS name")
def s10_discovery(spark: SparkSession, folder: str) -> DataFrame:
    """Table names below the folder, without the TPC-H-like ones."""
    names = sorted({os.path.relpath(f, folder).split("/")[0] for f in S.discover(spark, folder, "*.parquet", ["lineitem", "orders"])})
    return spark.createDataFrame([(n,) for n in names], "name string")


@query("SELECT _row_id, text FROM validation")
def s11_parquet_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "parquet")
    S.write_parquet(table(spark, folder, "validation").select("_row_id", "text"), path)
    return spark.read.parquet(path)


@query("SELECT '{\"training_condition\":' || coalesce('\"' || training_condition || '\"', 'null') || ',\"seed\":' || seed || ',\"rows\":' || n || ',\"least\":' || coalesce(printf('%.6g', least), 'null') || ',\"nan\":null}' AS json FROM (SELECT training_condition, seed, count(*) AS n, round(min(cited_probability) FILTER (cited_probability > 0.5 AND cited_probability < 1), 2) AS least FROM predictions_long GROUP BY ALL)")
def s13_json_report(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("cited_probability")
    told = table(spark, folder, "predictions_long").groupBy("training_condition", "seed").agg(F.count("*").alias("rows"), F.round(F.min(F.when((p > 0.5) & (p < 1), p)), 2).alias("least"), F.lit(float("nan")).alias("nan"))
    return S.to_report(told)


@query(f"WITH {METRICS} SELECT _row_id, seed, cited FROM m")
def s16_cached_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores kept under a name made from the rows they are of (s14, s15, s17), with their number and finiteness checked: the
    second call reads what the first wrote."""
    test = table(spark, folder, "test").select("_row_id", "claim_id", "label")
    path = scratch(spark, "cache") + "/" + S.content_key(test, ["claim_id", "label"], "_row_id", "cited")
    made = scored_metrics(spark, folder).select("_row_id", "seed", "cited")
    rows = 3 * test.count()
    S.cached(lambda: made, spark, path, rows, ["cited"])
    return S.cached(lambda: 1 / 0, spark, path, rows, ["cited"])


@query()
def s18_file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    paths = glob.glob(f"{folder}/nation.parquet*")
    return S.file_hashes(spark, paths[0]).select(F.substring_index("path", "/", -1).alias("name"), "bytes", "sha256")


@query("SELECT 'nation.parquet' AS name")
def s07_unique_file(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(os.path.basename(S.find_file(spark, folder, "nation")),)], "name string")


@query("SELECT label::VARCHAR AS label, count(*)::VARCHAR AS rows FROM test GROUP BY label")
def s12_csv_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "csv")
    S.write_csv(table(spark, folder, "test").groupBy("label").agg(F.count("*").alias("rows")), path)
    return S.read_csv(spark, path, ["label", "rows"])


@query(f"WITH {METRICS} SELECT seed AS replicate, 'accuracy' AS metric, round(avg((label = predicted)::INT), 6) AS value FROM m GROUP BY seed")
def s14_array_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Arrays of replicates as a long Parquet table (replicate, metric, value)."""
    from ..operators.metrics import accuracy_f1

    path = scratch(spark, "replicates")
    v = accuracy_f1(scored_metrics(spark, folder), ["seed"], "label", "predicted").where("metric = 'accuracy'")
    S.write_parquet(v.select(F.col("seed").alias("replicate"), "metric", F.round("value", 6).alias("value")), path)
    return spark.read.parquet(path)


@query("SELECT count(*) AS rows FROM validation")
def s15_atomic_write(spark: SparkSession, folder: str) -> DataFrame:
    """A table that replaces an older one at the same path, whole."""
    path = scratch(spark, "atomic")
    S.write_parquet(spark.range(3), path)
    S.write_parquet(table(spark, folder, "validation").select("_row_id"), path)
    return spark.read.parquet(path).agg(F.count("*").alias("rows"))


@query("SELECT label, count(*) AS rows FROM validation GROUP BY label")
def s17_resume(spark: SparkSession, folder: str) -> DataFrame:
    """A step whose output is there whole is skipped: the second call's maker would fail."""
    path = scratch(spark, "resume")
    S.cached(lambda: table(spark, folder, "validation").groupBy("label").agg(F.count("*").alias("rows")), spark, path)
    return S.cached(lambda: 1 / 0, spark, path)


@query("SELECT count(*) AS rows FROM validation")
def s19_path_bridge(spark: SparkSession, folder: str) -> DataFrame:
    """A table asked for at its old place is read at the new one."""
    path = S.bridged(spark, "/old/place/validation.parquet", {"/old/place": folder})
    return spark.read.parquet(path).agg(F.count("*").alias("rows"))
