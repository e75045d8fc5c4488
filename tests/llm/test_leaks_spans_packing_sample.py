import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.llm.leaks import leaks
from pairlab.llm.packing import difference, fill, pack, pack_audit, pack_fill
from pairlab.llm.shared_spans import merge_ranges, shared_share, shared_spans
from pairlab.llm.stable_sample import stable_sample, stored_numbers

WORDS = [f"w{i}" for i in range(300)]


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def leak_data():
    r = random.Random(1)
    items = [(i, " ".join(r.choices(WORDS, k=r.choice([1, 2, 5, 12, 13, 14, 40])))) for i in range(40)] + [(100, None), (101, ""), (102, "...")]
    docs = []
    for d in range(80):
        w = r.choices(WORDS, k=r.randint(0, 60))
        if r.random() < 0.7:
            part = words(r.choice(items[:40])[1])
            a = r.randint(0, max(0, len(part) - 13))
            part = part[a : a + 13 + r.randint(0, 3)]
            if r.random() < 0.5:
                part[r.randrange(len(part))] = "changed"
            k = r.randint(0, len(w))
            w[k:k] = part
        docs.append((d, (", ".join(w)).upper() if d % 2 else " ".join(w)))
    return items, docs + [(200, None), (201, ""), (202, "x " * 100000), (203, docs[0][1]), (203, docs[1][1])]


@pytest.mark.parametrize("bound", [0, 10**6])
@pytest.mark.parametrize("subs", [0, 1])
def test_leaks_against_brute_force(spark, bound, subs):
    items, docs = leak_data()
    d = spark.createDataFrame([(*x, 1, "h") for x in docs], "doc_id long, text string, item_id int, seed string")
    i = spark.createDataFrame([(*x, 1) for x in items + items[:3]], "item_id long, text string, doc_id int")
    expected = {}
    for k, t in items:
        w = words(t)
        n = min(13, len(w))
        for doc, x in docs:
            v = words(x)
            for a in range(len(v) - n + 1 if n and len(v) < 1000 else 0):
                best = max(sum(p == q for p, q in zip(v[a : a + n], w[b : b + n])) for b in range(len(w) - n + 1))
                if best >= n - (subs if n > 1 else 0):
                    equal, places = expected.setdefault((k, doc, n), [0, set()])
                    expected[k, doc, n] = [max(equal, best), places | {a}]
    rows = {(k, doc, equal, n, len(at), min(at), max(at) + n - 1) for (k, doc, n), (equal, at) in expected.items()}
    got = leaks(d, i, max_substitutions=subs, max_shared_words=bound).collect()
    assert {tuple(r) for r in got} == rows and len(got) == len(rows)


@pytest.mark.parametrize("bound", [0, 10**6])
def test_leaks_repeated_document(spark, bound):
    """Two rows of one document that hold the item at the same words count these once."""
    text = " ".join(f"a{k}" for k in range(14))
    d = spark.createDataFrame([(1, text), (1, text + " end"), (2, None)], "doc_id long, text string")
    i = spark.createDataFrame([(5, text), (5, text)], "item_id long, text string")
    assert [tuple(r) for r in leaks(d, i, max_shared_words=bound).collect()] == [(5, 1, 13, 13, 2, 0, 13)]


def test_leaks_many_items_and_a_hot_window(spark):
    """A window that every item and a third of the documents hold; both ways give the same rows."""
    hot = " ".join(f"h{k}" for k in range(13))
    d = spark.createDataFrame([(k, hot if k % 3 == 0 else f"x{k} y") for k in range(300)], "doc_id long, text string")
    i = spark.createDataFrame([(k, f"i{k} {hot} j{k}") for k in range(100)], "item_id long, text string")
    one, other = ({tuple(r) for r in leaks(d, i, max_shared_words=b).collect()} for b in (0, 10**6))
    assert one == other and len(one) == 100 * 100


def test_leaks_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    i = spark.createDataFrame([(1, None)], "item_id long, text string")
    assert leaks(d, i).count() == 0
    assert leaks(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), i).count() == 0


def brute_spans(docs, span):
    owners = {}
    for d, t in docs:
        for s in range(len(t or "") - span + 1):
            owners.setdefault(t[s : s + span], set()).add(d)
    out = set()
    for d, t in docs:
        run = None
        for s in range(len(t or "") - span + 1):
            if len(owners[t[s : s + span]]) > 1:
                if run and s <= run[1]:
                    run[1] = s + span
                else:
                    if run:
                        out.add((d, *run))
                    run = [s, s + span]
        if run:
            out.add((d, *run))
    return out


def span_docs(seed):
    r = random.Random(seed)
    letters = "abcdeé😀 "
    parts = ["".join(r.choices(letters, k=r.randint(10, 90))) for _ in range(6)]
    docs = []
    for d in range(40):
        t = "".join(r.choice(parts) if r.random() < 0.5 else "".join(r.choices(letters, k=r.randint(1, 60))) for _ in range(r.randint(0, 6)))
        docs.append((d, t))
    return docs + [(100, None), (101, ""), (102, "aa" * 60), (103, "a" * 95), (104, docs[5][1]), (105, docs[5][1] * 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_against_brute_force(spark, seed, monkeypatch):
    docs = span_docs(seed)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, fp int")
    expected = brute_spans(docs, 20)
    got = shared_spans(df, span=20, gram=7).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    share = {r.doc_id: (r.n_chars, r.shared_chars, r.shared_share) for r in shared_share(df, span=20, gram=7).collect()}
    assert share[100] == (0, 0, None) and len(share) == len(docs)
    assert {k: v[1] for k, v in share.items() if v[1]} == {k: sum(e - s for d, s, e in expected if d == k) for k in {d for d, *_ in expected}}


def test_spans_of_long_texts_and_hot_passage(spark):
    """A passage in a third of the records, and texts longer than what a worker handles at once."""
    passage = "".join(random.Random(3).choices("abcdefgh ", k=300))
    r = random.Random(4)
    fresh = lambda n: "".join(r.choices("ijklmnopq", k=n))
    docs = [(d, fresh(50) + passage + fresh(40) if d % 3 == 0 else fresh(100)) for d in range(60)]
    long = fresh(399_900) + passage + fresh(100_000)
    docs.append((99, long))
    got = {tuple(x) for x in shared_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_spans(docs, 200) and len(got) == 21


def test_spans_empty_and_merge(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert shared_spans(df).count() == 0 and shared_share(df).count() == 0
    ranges = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 9, 10), (1, 2, 3), (2, 0, 1)], "k int, a int, b int")
    assert {tuple(x) for x in merge_ranges(ranges, "k", "a", "b").collect()} == {(1, 0, 8), (1, 9, 10), (2, 0, 1)}


def test_differencing():
    place, largest = difference(np.array([8, 7, 6, 5, 4]), 2)
    assert largest == 16 and sorted(np.bincount(place, weights=[8, 7, 6, 5, 4])) == [14, 16]
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 60, 400):
        sizes = r.integers(1, 101, n)
        place = fill(sizes, 100)
        assert np.bincount(place, weights=sizes).max() <= 100
    sizes = r.integers(1, 40, 2000)
    assert len(set(fill(sizes, 200))) <= 1.02 * -(-sizes.sum() // 200)


def test_pack(spark):
    r = random.Random(6)
    docs = [(d, " ".join(r.choices(WORDS, k=r.randint(1, 120))), "x") for d in range(300)] + [(400, None, "x"), (401, "", "x"), (402, "word " * 5000, "x"), (403, " ", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, slot string")
    got = pack(df, capacity=256, windows_per_block=16).toPandas()
    assert got.groupby("container_id").n_tokens.sum().max() <= 256
    assert (got.groupby("container_id").n_tokens.transform("sum") == got.container_tokens).all()
    assert set(got.doc_id) == set(range(300)) | {402, 403}
    whole = got[got.doc_id != 402]
    assert (whole.piece == 0).all() and whole.doc_id.is_unique
    cut = got[got.doc_id == 402].sort_values("piece")
    assert (cut.n_tokens.iloc[:-1] == 256).all() and (cut.first_token == cut.piece * 256).all()
    again = pack(df.repartition(7), capacity=256, windows_per_block=16).toPandas()
    assert {tuple(x) for x in got.values} == {tuple(x) for x in again[got.columns].values}
    assert pack_fill(df, capacity=1024).first().fill > 0.95
    assert pack(df.limit(0), capacity=256).count() == 0 and pack_fill(df.limit(0), capacity=256).first().containers == 0


def test_pack_repeated_ids(spark):
    """Rows with one id, of the same and of other texts, are items of their own; the copies of one row fill several runs."""
    long, other = "alpha " * 100, "beta gamma " * 90
    rows = [(1, long), (1, long), (1, other), (2, "short")] + [(7, "the same few words")] * 25_000
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pack(df, capacity=64, windows_per_block=16).toPandas()
    assert got.groupby("container_id").n_tokens.sum().max() <= 64
    assert (got.groupby("container_id").n_tokens.transform("sum") == got.container_tokens).all()
    assert (got.doc_id == 7).sum() == 25_000 and not got[["doc_id", "text_key", "copy", "piece"]].duplicated().any()
    audit = pack_audit(pack(df, capacity=64), df, capacity=64).first()
    assert (audit.items, audit.rows, audit.overfull, audit.wrong_totals, audit.gap, audit.cut) == (len(rows), len(rows), 0, 0, 0, 0)


def sample(df, rate=0.2):
    return {r.unit for r in stable_sample(df, F.col("id"), "at", rate).collect()}


def test_sample_keeps_what_it_held(spark):
    base = spark.range(3000).select(F.concat(F.lit("r"), "id").alias("id"), (F.lit("2026-01-01").cast("timestamp") + F.make_interval(days=F.floor(F.col("id") / 700).cast("int"))).alias("at"), F.lit(1).alias("seq"))
    later = spark.range(500).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("2026-02-01").cast("timestamp").alias("at"), F.lit(1).alias("seq"))
    first = sample(base)
    both = base.unionByName(later)
    assert first == sample(base.repartition(13)) and first <= sample(both)
    assert sample(both.unionByName(base)) == sample(both)
    assert abs(len(first) / 3000 - 0.2) < 0.03 and first < sample(base, 0.5)
    assert len(sample(base, 1.0)) == 3000 and not sample(base, 0.0)


def test_sample_with_stored_numbers(spark, tmp_path):
    """Tied, late and undated rows and deletions take nothing from the sample; a load that failed leaves no trace."""
    base = spark.range(3000).select(F.concat(F.lit("r"), "id").alias("id"), (F.lit("2026-01-01").cast("timestamp") + F.make_interval(days=F.floor(F.col("id") / 700).cast("int"))).alias("at"))
    path = str(tmp_path / "numbers")
    kept = lambda df: {r.unit for r in stable_sample(df, F.col("id"), "at", 0.2, numbers=path).collect()}
    first = kept(base)
    assert first == sample(base) and abs(len(first) - 600) < 90
    (tmp_path / "numbers" / "load-00000001").mkdir()
    late = spark.range(50).select(F.concat(F.lit("t"), "id").alias("id"), F.when(F.col("id") > 9, F.lit("2026-01-02")).cast("timestamp").alias("at"))
    both = kept(base.unionByName(late))
    assert first <= both and len(both) > len(first)
    assert kept(base.unionByName(late).repartition(9)) == both
    gone = kept(base.unionByName(late).where("id <> 'r3'"))
    assert gone == both - {"r3"}
    numbers = stored_numbers(spark, path).toPandas()
    assert sorted(numbers.seq) == list(range(3050)) and numbers.unit.is_unique


def test_sample_edges(spark, tmp_path):
    df = spark.createDataFrame([("a", None), (None, "2026-01-01"), ("", "2026-01-01")], "id string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert sample(df, 1.0) == {"a"} and sample(df.limit(0), 1.0) == set()
    assert stable_sample(df.limit(0), F.col("id"), "at", 1.0, numbers=str(tmp_path / "n")).count() == 0
    assert [tuple(r) for r in stable_sample(df, F.col("id"), "at", 1.0, numbers=str(tmp_path / "n")).collect()] == [("a", 0)]
