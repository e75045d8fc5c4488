import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlab.functions.text import field_key
from pairlab.llm.hidden_copies import _scan, collapsed, copies


def key():
    k = field_key("text")
    return F.when(k != "", k)


def test_field_key(spark):
    df = spark.createDataFrame([(t,) for t in ["B: Two | a: ONE.", "a one|b two", "|| ÄÖ-1 |", "...", "", None]], "text string")
    assert [r[0] for r in df.select(field_key("text")).collect()] == ["aone|btwo", "aone|btwo", "äö1", "", "", None]


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_against_brute_force(spark, partitions):
    r = random.Random(partitions)
    texts = ["Hot one!", "hot ONE", "b|a", "A|B", "c", "D d", "e", None, "", "--", "long " * 5000]
    rows = []
    for i in range(200):
        t = r.choice(texts[:2]) if i % 3 == 0 else r.choice(texts)
        rows.append((f"r{i:03d}", t + str(r.randint(0, 20)) if t and i % 2 else t, "k", 1))
    df = spark.createDataFrame(rows, "id string, text string, key string, n int")
    groups = {}
    for i, t, *_ in rows:
        k = "|".join(sorted(p for p in ("".join(c for c in x.lower() if c.isalnum()) for x in (t or "").split("|")) if p))
        if k:
            groups.setdefault(k, []).append(i)
    got = [tuple(x) for x in copies(df, "id", key(), partitions).collect()]
    assert sorted(got) == sorted((i, min(g)) for g in groups.values() if len(g) > 1 for i in g)
    got = [tuple(x) for x in collapsed(df, "id", key(), partitions).collect()]
    assert sorted(got) == sorted((min(g), len(g)) for g in groups.values())


def test_batches_may_end_anywhere():
    r = random.Random(4)
    for _ in range(80):
        keys = sorted(r.choice("abcdef") for _ in range(r.randint(1, 25)))
        rows = [(k, i) for i, k in enumerate(keys)]
        cuts = sorted(r.randint(0, len(rows)) for _ in range(r.randint(0, 6)))
        told = []
        for parts in ([rows], [rows[i:j] for i, j in zip([0, *cuts], [*cuts, len(rows)])]):
            batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in p], pa.string()), pa.array([i for _, i in p], pa.int64())], names=["key", "row_id"]) for p in parts]
            told.append(sorted((str(sorted(x.items())) for out in _scan(pa.int64())(iter(batches)) for x in out.to_pylist())))
        assert told[0] == told[1]
        sizes = {k: keys.count(k) for k in keys}
        assert told[0].count("") == 0 and sum("'what', 2" in x for x in told[0]) == min(2, len(sizes))


def test_all_the_same_and_number_ids(spark):
    df = spark.range(50).select(F.col("id"), F.lit("x").alias("text"))
    assert {tuple(r) for r in copies(df, "id", key(), 4).collect()} == {(i, 0) for i in range(50)}
    assert [tuple(r) for r in collapsed(df, "id", key(), 4).collect()] == [(0, 50)]


def test_empty_and_nulls(spark):
    df = spark.createDataFrame([("a", None), (None, "x"), ("b", "")], "id string, text string")
    assert copies(df, "id", key()).count() == 0 and collapsed(df, "id", key()).count() == 0
    assert copies(df.limit(0), "id", key()).count() == 0
