import random

from pyspark.sql import functions as F

from pairlab.llm.grouped_splits import grouped_splits, groups

SCHEMA = "id string, a string, d string, day date, component string, node string"


def frame(spark, rows):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, a, d, None, "x", "y") for i, a, d in rows], SCHEMA)


def brute(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, a, d in rows:
        if i is None:
            continue
        find(("r", i))
        for k in (("a", a), ("d", d)):
            if k[1]:
                parent[find(("r", i))] = find(k)
    out = {}
    for i, *_ in rows:
        if i is not None:
            out.setdefault(find(("r", i)), set()).add(i)
    return {(i, min(g), len(g)) for g in out.values() for i in g}


def test_groups_against_brute_force(spark):
    r = random.Random(5)
    rows = [(f"r{i:03d}", r.choice([None, "", *map(str, range(60))]), r.choice([None, *map(str, range(60))])) for i in range(90)]
    rows += [(f"h{i:02d}", f"own{i}", "hub") for i in range(40)]  # a key that a third of the rows hold
    rows += [("r001", "own3", None), (None, "1", "2"), ("h05", "own5", "hub"), ("alone", None, "")]
    keys = [F.col("a"), F.col("d")]
    for small in (0, 1000):
        got = groups(frame(spark, rows), "id", keys, small_graph=small).collect()
        assert {tuple(x) for x in got} == brute(rows) and len(got) == len(brute(rows))


def test_same_value_of_other_key_ties_nothing(spark):
    got = groups(frame(spark, [("x", "1", None), ("y", None, "1")]), "id", [F.col("a"), F.col("d")])
    assert {r.group_size for r in got.collect()} == {1}


def test_splits_whole_and_proportional(spark):
    rows = [(f"r{i:04d}", f"a{i // 2}", None) for i in range(1200)] + [(f"z{i:04d}", f"own{i}", "hot") for i in range(600)]
    df = frame(spark, rows).withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), F.substring("id", 2, 4).cast("int")))
    got = grouped_splits(df, "id", [F.col("a"), F.col("d")], {"train": 0.8, "validation": 0.1, "test": 0.1}, F.col("day")).toPandas()
    assert len(got) == 1800 and got.groupby("group_row_id")["split"].nunique().max() == 1
    share = got["split"].value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["test"] - 0.1) < 0.01
    small = got[got.row_id.str.startswith("r")]
    assert small[small.split == "train"].row_id.max() < small[small.split == "validation"].row_id.min()
    assert small[small.split == "validation"].row_id.max() < small[small.split == "test"].row_id.min()


def test_empty(spark):
    df = frame(spark, [("x", None, None)]).limit(0)
    assert groups(df, "id", [F.col("a")]).count() == 0
    assert grouped_splits(df, "id", [F.col("a")], {"train": 0.5, "test": 0.5}).count() == 0


def test_all_days_missing(spark):
    got = grouped_splits(frame(spark, [(f"r{i}", None, None) for i in range(100)]), "id", [F.col("a")], {"train": 0.5, "test": 0.5}, F.col("day"))
    assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 50, "test": 50}
