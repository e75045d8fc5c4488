"""Eligible items against brute force in several blocks, and what is written for them."""

import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.operators import candidates, eligible
from pairlab.queries import QUERIES


def made(spark, n=120, m=40, seed=3):
    """Items with two codes and a document, targets with two codes and barred documents, one code held by most."""
    r = random.Random(seed)
    codes = lambda: sorted({r.choice(["H", "H", "H", "A", "B", "C"]), r.choice("ABCDE")})
    items = [("s" if i % 3 else "t", i, f"20{r.randrange(10, 20)}-01-0{r.randrange(1, 4)}", codes(), f"d{r.randrange(9)}", [float(r.randrange(-2, 3)) for _ in range(3)]) for i in range(n)]
    targets = [("s" if i % 3 else "t", f"c{i}", f"20{r.randrange(10, 20)}-01-0{r.randrange(1, 4)}", codes(), [f"d{r.randrange(9)}" for _ in range(2)], [float(r.randrange(-2, 3)) for _ in range(3)]) for i in range(m)]
    eligible_pairs = {(s, c, i) for s, c, day, want, bar, _ in targets for s2, i, pub, have, doc, _ in items if s == s2 and set(want) & set(have) and pub < day and doc not in bar}
    it = spark.createDataFrame(items, "split string, cand long, pub string, codes array<string>, doc string, vector array<double>").withColumn("pub", F.to_date("pub"))
    tg = spark.createDataFrame(targets, "split string, claim_id string, target string, codes array<string>, bar array<string>, vector array<double>").withColumn("target", F.to_date("target"))
    index, numbers = eligible.numbered(it, [F.col("codes"), F.array("doc")])
    barred = tg.select("split", "claim_id", F.lit(1).alias("kind"), F.explode("bar").alias("value"))
    ask = lambda t, *also: eligible.asked(t, "codes", 0, barred, numbers, *also)
    return items, targets, eligible_pairs, it, tg, index, ask


@pytest.mark.parametrize("size", [7, 1000])
def test_pairs_counts_and_picked_equal_brute_force(spark, size):
    _, _, expected, _, tg, index, ask = made(spark)
    asked = ask(tg)
    assert sorted(map(tuple, eligible.pairs(asked, index, size).collect())) == sorted(expected)
    counts = eligible.counts(asked, index, size)
    got = {(r.split, r.claim_id, r.block): r.n for r in counts.collect()}
    assert got == {k: n for k in {(s, c, i // size) for s, c, i in expected} if (n := sum((s, c, i // size) == k for s, c, i in expected))}
    # The last of each target's eligible items.
    by_target = {}
    for s, c, i in sorted(expected):
        by_target[s, c] = i
    draw = asked.withColumn("draw", F.sha2("claim_id", 256))
    chosen = {(r.split, r.claim_id): (r.cand, r.pool_size) for r in candidates.choose(draw, index, counts, size).collect()}
    import hashlib

    for (s, c), (cand, n) in chosen.items():
        own = sorted(i for s2, c2, i in expected if (s2, c2) == (s, c))
        assert n == len(own) and cand == own[int(hashlib.sha256(c.encode()).hexdigest()[:16], 16) % n]
    assert set(chosen) == set(by_target)


@pytest.mark.parametrize("size", [7, 1000])
def test_best_equals_brute_force(spark, size):
    items, targets, expected, it, tg, index, ask = made(spark)
    short = tg.withColumn("vector", F.when(F.col("claim_id") == "c1", F.slice("vector", 1, 2)).when(F.col("claim_id") != "c2", F.col("vector"))).withColumn("own", F.lit(1.0))
    got = {(r.split, r.claim_id): (r.score, r.cand, r.ties, r.above, r.n) for r in eligible.best(ask(short, "vector", "own"), index.join(it.select("split", "cand", "vector"), ["split", "cand"]), size).collect()}
    vector, own = {i: v for _, i, _, _, _, v in items}, {c: v for _, c, _, _, _, v in targets}
    want = {}
    for s, c, i in expected:
        if c not in ("c1", "c2"):
            want.setdefault((s, c), []).append((round(sum(x * y for x, y in zip(own[c], vector[i])), 6), -i))
    assert got == {k: (max(v)[0], -max(v)[1], sum(x == max(v)[0] for x, _ in v), sum(x > 1 for x, _ in v), len(v)) for k, v in want.items()}


def test_no_items(spark):
    _, _, _, it, tg, _, _ = made(spark)
    index, numbers = eligible.numbered(it.limit(0), [F.col("codes")])
    assert eligible.counts(eligible.asked(tg, "codes", 0, None, numbers), index).count() == 0


def rows_written(spark, folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("part-*"))


def test_lists_of_candidates_are_not_written(spark):
    """400 sets of codes that all share a code with 1,500 candidates: 600,000 entries of lists of 16 bytes would be 9.6 MB."""
    spark.range(1).checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else candidates.cut(spark.range(1))
    folder = re.sub("^file:", "", spark.sparkContext._jsc.sc().getCheckpointDir().get())
    cited = spark.range(1500).select(F.concat(F.lit("r"), "id").alias("_row_id"), F.concat(F.lit("x"), "id").alias("claim_id"), F.concat(F.lit("DE"), F.col("id") + 100000).alias("cited_document_id"), F.lit("APPZ").alias("patent_application_id"), F.concat(F.lit("passage "), "id").alias("text_b"), F.lit(0).alias("label"))
    asks = spark.range(400).select(F.concat(F.lit("u"), "id").alias("_row_id"), F.concat(F.lit("c"), "id").alias("claim_id"), F.lit("DE99").alias("cited_document_id"), F.concat(F.lit("EP"), F.col("id") + 500000).alias("patent_application_id"), F.lit("own").alias("text_b"), F.lit(2).alias("label"))
    none = F.lit(None).cast("string")
    pairs = cited.union(asks).select("*", F.concat(F.lit("text "), "claim_id").alias("text"), F.lit("t").alias("split"), F.lit("2020-01-01").alias("_date"), none.alias("date"), none.cast("timestamp").alias("_parsed_date"), none.alias("_u_target_component"), none.alias("_priority_component_id"), none.alias("_u_candidate_base"))
    m = lambda d, code: d.select(F.lit(None).cast("string").alias("base_id"), F.col("k").alias("input_id"), F.lit("20100101").alias("publication_date"), code.alias("cpc_subclasses"), F.lit("").alias("reference_bases"), F.monotonically_increasing_id().alias("row_pos"))
    meta = m(cited.select(F.col("cited_document_id").alias("k")), F.lit("A01B")).union(m(asks.select(F.col("patent_application_id").alias("k"), F.col("claim_id").alias("c")), F.concat(F.lit("A01B, Z"), "c")))
    before = rows_written(spark, folder)
    chain = candidates.Chain(pairs, meta)
    assert {r.n for r in chain.sizes.collect()} == {1500} and chain.sizes.count() == 400
    assert rows_written(spark, folder) - before < 6_000_000


@pytest.mark.parametrize("name", ["g06_dense_candidates", "g10_near_ties", "g04_failures", "g09_pool_summary", "g05_random_candidates", "j09_set_overlap_before_date", "j11_exclusion_sets"])
def test_no_pairs_in_the_plan(name, spark, sf):
    """Nothing is exploded to pairs of target and candidate."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {str(p) for d in dirs for p in Path(d.getPath()).rglob("shuffle_*.data")}


def test_cut_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    df = spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).count()
    one = candidates.cut(df)
    assert not shuffle_files(spark) - before
    assert one.count() == 1000 and df.count() == 1000 and one.join(df, "k").count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_items_of_a_common_barred_document_are_found_once():
    """Documents 1 and 2 have a third of 3,000 items each; what they bar is kept, and other barred properties are taken off once."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(5)
    days, have = [r.randrange(100) for _ in range(3000)], [[100 + i % 2, 1 + i % 3, 1000 + i // 2] for i in range(3000)]
    block = eligible._Block(pa.table({"cand": pa.array(range(3000), pa.int64()), "day": days, "properties": have}))
    near = eligible._Near(block, [100])
    for day, bar in ((50, [1]), (60, [1]), (70, [1, 1003]), (70, [1003, 1004, 7]), (80, [1, 2, 1001, 1200]), (90, [])):
        own = [i for i in range(0, 3000, 2) if days[i] < day and not set(bar) & set(have[i])]
        assert near.count(day, bar) == len(own)
        assert near.block.cand[near.places[np.flatnonzero(near.opened(day, bar))]].tolist() == own
    assert len(near._common) == 2


def test_no_text_moves_with_the_rows(spark, sf):
    """Texts of uncited rows were carried through the joins for their draws; ids are resolved apart from the rows."""
    from pairlab.queries.composites import _chain

    chain = _chain(spark, sf)
    assert "draw" not in chain.prep.columns + chain.targets.columns
    plan = candidates.prepared(chain.pairs, spark.read.parquet(f"{sf}/doc_metadata.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2


def test_equal_vectors_of_a_block_are_scored_once():
    """3,000 items with 20 vectors: 20 are kept, and each item's is among them."""
    import numpy as np
    import pyarrow as pa

    given = [None if i % 20 == 7 else [float(i % 20), 1.0][: 1 + i % 2] for i in range(3000)]
    block = eligible._Block(pa.table({"cand": pa.array(range(3000), pa.int64()), "day": [0] * 3000, "properties": [[1]] * 3000, "vector": pa.array(given, pa.list_(pa.float64()))}))
    assert block.vectors.shape == (20, 2)
    assert all(block.sizes[k] == (-1 if v is None else len(v)) and (v is None or block.vectors[k][: len(v)].tolist() == v) for k, v in zip(np.ravel(block.of), given))


def test_audit_of_two_sources_in_one_pass(spark, sf):
    """Each source was joined by itself, and lists of references and codes moved through every join."""
    from pairlab.queries.composites import _chain

    chain = _chain(spark, sf)
    rows = chain.picked()
    both = rows.withColumn("source", F.lit("a")).unionByName(rows.where("claim_id > 'EP005'").withColumn("source", F.lit("b")))
    of = lambda r: {(x["split"], x["check"]): x["count"] for x in candidates.violations(r, chain.targets, chain.prep, chain.docs).collect()}
    got = candidates.violations(both, chain.targets, chain.prep, chain.docs)
    told = {n: {(x["split"], x["check"]): x["count"] for x in got.where(F.col("source") == n).collect()} for n in "ab"}
    assert told == {"a": of(rows), "b": of(rows.where("claim_id > 'EP005'"))}
    plan = QUERIES["g07_violations"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    # Five of the audit, three before it; two passes had thirteen.
    assert plan.count("Join") == 8


def test_a_block_is_made_in_little_memory():
    """200,000 items of ten properties: 16 MB of them. Sorting copies again took 5.75 times that beside the table, this takes 3."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    n, k = 200_000, 10
    have = np.random.default_rng(3).integers(0, 50_000, n * k)
    t = pa.table({"cand": pa.array(np.arange(n)), "day": pa.array(np.zeros(n, dtype=np.int32)), "properties": pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(have))})
    tracemalloc.start()
    block = eligible._Block(t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * have.nbytes
    assert block.properties.tolist() == np.unique(have).tolist() and block.starts[-1] == n * k
    for p in (0, 777, 49_999):
        assert sorted(block.having([p]).tolist()) == sorted(np.flatnonzero(have == p) // k)


@pytest.mark.parametrize("row, pairs", [(1, 1), (20, 30), (1 << 13, 1 << 20)])
@pytest.mark.parametrize("targets, items", [(1, 9), (5, 200), (8, 300), (61, 300), (200, 40)])
def test_shared_rows_stand_for_each_pair_once(monkeypatch, row, pairs, targets, items):
    monkeypatch.setattr(eligible, "_ROW", row)
    monkeypatch.setattr(eligible, "_PAIRS", pairs)
    r = np.random.default_rng(targets)
    kinds = r.random((6, targets)) < np.array([1, 1, 0.9, 0.5, 0.05, 0])[:, None]
    ok = kinds[r.integers(0, 6, items)] ^ (r.random((items, targets)) < 0.002)
    cand = np.sort(r.choice(10_000, items, replace=False))
    bits = np.packbits(ok.T, axis=0)
    got = []
    for (ends, claims), (to, cands) in eligible._shared(bits, cand):
        assert len(ends) == len(to) and ends[-1] == len(claims) and to[-1] == len(cands)
        for k in range(len(ends) - 1):
            mine, of = claims[ends[k] : ends[k + 1]], cands[to[k] : to[k + 1]]
            assert len(mine) and len(of) and (len(mine) * len(of) <= row or len(of) == 1)
            got += [(int(t), int(c)) for t in mine for c in of]
    assert sorted(got) == sorted((t, int(cand[i])) for i, t in np.argwhere(ok))
    assert not list(eligible._shared(bits * 0, cand))


def test_pairs_are_small_on_disk(spark, tmp_path):
    """1.2 million pairs of 300 targets with 5,000 items, a few of them barred: one target's items after another's took about two bytes a pair."""
    r = random.Random(5)
    it = spark.createDataFrame([("s", i, f"20{r.randrange(10, 20)}-01-01", ["H" if i % 9 else "A"], f"d{i % 500}") for i in range(5000)], "split string, cand long, pub string, codes array<string>, doc string").withColumn("pub", F.to_date("pub"))
    targets = [("s", f"EP{i:08}_c1", f"20{r.randrange(18, 21)}-02-01", ["H"] if i % 4 else ["A", "H"], [f"d{r.randrange(500)}"]) for i in range(300)]
    tg = spark.createDataFrame(targets, "split string, claim_id string, target string, codes array<string>, bar array<string>").withColumn("target", F.to_date("target"))
    index, numbers = eligible.numbered(it, [F.col("codes"), F.array("doc")])
    asked = eligible.asked(tg, "codes", 0, tg.select("split", "claim_id", F.lit(1).alias("kind"), F.explode("bar").alias("value")), numbers)
    eligible.pairs(asked, index).write.parquet(out := str(tmp_path / "pairs"))
    found = spark.read.parquet(out)
    n = found.count()
    assert n == eligible.counts(asked, index).agg(F.sum("n")).first()[0] == found.distinct().count() > 1_000_000
    assert rows_written(spark, out) < 0.7 * n
