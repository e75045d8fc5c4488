"""Sources, sinks, adapters and the streaming extension."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.operators import adapters
from pairlab.sources import tables as S
from pairlab.streaming.events import first_seen, read_events, run_once


def test_csv_round_trip(spark, tmp_path):
    rows = [("a", ' "x", y\nz '), ("b", None), ("c", "\t|,")]
    path = str(tmp_path / "t")
    S.write_csv(spark.createDataFrame(rows, "k string, t string"), path)
    assert sorted(tuple(r) for r in S.read_csv(spark, path, ["k", "t"], multi_line=True).collect()) == sorted(rows)


def test_grid(spark, tmp_path):
    paths = {}
    for c in ("h", "m"):
        for s in (13, 42):
            paths[(c, s)] = str(tmp_path / f"{c}{s}")
            spark.range(3).write.parquet(paths[(c, s)])
    assert S.read_grid(spark, paths, ["c", "s"]).groupBy("c", "s").count().count() == 4
    del paths[("m", 42)]
    with pytest.raises(ValueError):
        S.read_grid(spark, paths, ["c", "s"])


def test_files(spark, tmp_path):
    for n in ("a_seed13.npz", "b_seed13.npz"):
        np.savez(tmp_path / n, logits=np.array([[0.0, 1.0], [2.0, -1.0]]))
    assert S.find_file(spark, str(tmp_path), "A", "seed13").endswith("a_seed13.npz")
    with pytest.raises(FileNotFoundError):
        S.find_file(spark, str(tmp_path), "seed13")
    assert len(S.discover(spark, str(tmp_path), "*.npz", ["b_"])) == 1
    df = S.read_npz_logits(spark, str(tmp_path / "a_seed13.npz"), classes=2)
    assert [tuple(r) for r in df.orderBy("row_pos").collect()] == [(0, 0.0, 1.0), (1, 2.0, -1.0)]
    with pytest.raises(ValueError):
        S.read_npz_logits(spark, str(tmp_path / "a_seed13.npz"), classes=3)
    np.savez(tmp_path / "c.npz", logits=np.array([np.nan]))
    with pytest.raises(ValueError):
        S.read_npz_logits(spark, str(tmp_path / "c.npz"))
    assert S.file_hashes(spark, str(tmp_path), "*.npz").count() == 3


def test_cached_and_report(spark, tmp_path):
    path = str(tmp_path / "c")
    assert S.cached(lambda: spark.range(3), spark, path).count() == 3
    assert S.cached(lambda: 1 / 0, spark, path, rows=3).count() == 3
    os.remove(f"{path}/_SUCCESS")
    assert S.cached(lambda: spark.range(5), spark, path).count() == 5
    df = spark.createDataFrame([("a", float("nan"), 1 / 3)], "k string, x double, y double")
    assert S.to_report(df).first().json == '{"k":"a","x":null,"y":0.333333}'


def test_replacing_a_table(spark, tmp_path):
    """A writer that fails leaves the old table; one that reads it may replace it."""
    path = str(tmp_path / "t")
    S.write_parquet(spark.range(3), path)
    with pytest.raises(Exception):
        S.write_parquet(spark.range(5).select(F.raise_error(F.lit("stop")).cast("int").alias("id")), path)
    assert spark.read.parquet(path).count() == 3
    S.write_parquet(spark.read.parquet(path).union(spark.range(4)), path)
    assert spark.read.parquet(path).count() == 7 and [f.name for f in tmp_path.iterdir()] == ["t"]


def test_revision_and_content_key(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a.parquet")
    pinned = S.revision(spark, str(tmp_path), ["a"])
    assert S.load_splits(spark, str(tmp_path), ["a"], pinned=pinned).count() == 3
    df = spark.createDataFrame([(1, "x"), (2, None)], "k int, t string")
    key = S.content_key(df, ["t"], "k", "model")
    assert key == S.content_key(df.repartition(3), ["t"], "k", "model") != S.content_key(df.fillna("x"), ["t"], "k", "model")
    spark.range(4).write.mode("overwrite").parquet(f"{tmp_path}/a.parquet")
    with pytest.raises(ValueError):
        S.load_splits(spark, str(tmp_path), ["a"], pinned=pinned)
    with pytest.raises(ValueError):
        S.cached(lambda: spark.createDataFrame([(float("nan"),)], "s double"), spark, f"{tmp_path}/c", 1, ["s"])
    assert S.bridged(spark, "/gone/a.parquet", {"/other": "/x", "/gone": str(tmp_path)}) == f"{tmp_path}/a.parquet"
    with pytest.raises(FileNotFoundError):
        S.bridged(spark, "/gone/b.parquet", {"/gone": str(tmp_path)})


def test_file_digest(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc" * 4_000_000)
    row = S.file_hashes(spark, str(tmp_path)).first()
    assert row.bytes == 12_000_000 and row.sha256 == hashlib.sha256(b"abc" * 4_000_000).hexdigest()


def test_inferred_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b\n1,x\n2,\n")
    assert S.read_csv(spark, f"file://{tmp_path}/f.csv").dtypes == [("a", "int"), ("b", "string")]


def test_adapter_halves_batches(spark):
    def load():
        def score(a, b):
            if len(a) > 2:
                raise MemoryError
            return [len(x) + len(y) for x, y in zip(a, b)]

        return score

    df = spark.createDataFrame([(i, "a" * i, None) for i in range(9)], "i int, q string, p string")
    assert {r.i: r.score for r in adapters.score_pairs(df, "i", "q", "p", load).collect()} == {i: float(i) for i in range(9)}
    out = adapters.embed_distinct(df.union(df), "q", adapters.hashed_terms(8))
    assert out.count() == 18 and out.where("q = ''").first().vector is None


def test_stream_drops_repeats(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-01"), ("b", "2024-01-02")], "k string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(path)
    out = run_once(first_seen(read_events(spark, path, df.schema, "ts"), "ts", "k"), "first_seen_test", "append")
    assert sorted(r.k for r in out.collect()) == ["a", "b"]
