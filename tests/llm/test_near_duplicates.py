import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pairlab.llm.near_duplicates import _meet, candidates, near_duplicate_groups, near_duplicate_pairs
from pairlab.llm.overlaps import WordIndex, overlaps
from pairlab.llm.paragraphs import paragraph_clusters
from pairlab.llm.sketches import shingles, similarity_sketch, word_hashes

VOCABULARY = [f"w{i}" for i in range(400)]
FIELDS = {"text": ("id", "text")}


def sets(t, n):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def texts(seed, count):
    r = random.Random(seed)
    out = []
    for i in range(count):
        if out and r.random() < 0.6:
            w = r.choice(out).split(" ")
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = r.choice(VOCABULARY)
            out.append(" ".join(w))
        else:
            out.append(" ".join(r.choices(VOCABULARY, k=r.randint(15, 60))))
    return out + [None, "", "one two", "One, TWO!", "ünd œuvre Äß straße ½ x²", "Und œuvre äß Straße ½ x²", "word " * 30000]


def test_pairs_against_brute_force(spark):
    all_ = texts(1, 120)
    rows = [(f"r{i:03d}", t, "x", 1) for i, t in enumerate(all_)] + [("r000", all_[0], "x", 2)]
    df = spark.createDataFrame(rows, "id string, text string, tid string, band int")
    for least, n, bands in ((0.6, 3, 72), (0.8, 5, 32)):
        s = {i: sets(t, n) for i, t, *_ in rows}
        expected = {("text", a, b) for a in s for b in s if a < b and s[a] | s[b] and jaccard(s[a], s[b]) >= least}
        got = near_duplicate_pairs(df, FIELDS, least, n, bands, 4).collect()
        assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    groups = {r.id: (r.group_id, r.links) for r in near_duplicate_groups(df, FIELDS, 0.8, 5).collect()}
    assert len(groups) == len({i for i, t, *_ in rows if t})
    for _, a, b in expected:
        assert groups[a][0] == groups[b][0] <= a


def band_pairs(rows, cross):
    return {(a, b) for x, s, a in rows for y, t, b in rows if x == y and ((s, t) == (0, 1) if cross else a < b)}


def test_bands_in_batches_against_brute_force():
    """Rows cut into batches anywhere; bands above the bound come out as blocks with their number."""
    r = random.Random(8)
    for cross in (False, True):
        for trial in range(60):
            rows = sorted(((r.choice([1, 2, 3, 9]), r.randint(0, 1) if cross else 0, r.randint(0, 12)) for _ in range(r.randint(0, 60))), key=lambda x: x[:2])
            cuts = sorted(r.randint(0, len(rows)) for _ in range(r.randint(0, 6)))
            parts = [rows[i:j] for i, j in zip([0, *cuts], [*cuts, len(rows)])]
            batches = [pa.RecordBatch.from_arrays([pa.array([x[0] * 2 + x[1] for x in p], pa.int64()), pa.array([x[2] for x in p], pa.int64())], names=["band", "tid"]) for p in parts]
            got, blocks, told = set(), {}, {}
            for out in _meet(cross, 5)(iter(batches)):
                for x in out.to_pylist():
                    if x["band"] is None:
                        got.add((x["a"], x["b"]))
                    elif x["side"] == 2:
                        told[x["band"]] = x["block"]
                    else:
                        blocks.setdefault(x["band"], []).append((x["block"], x["side"], x["a"]))
            distinct = set(rows)
            # A text that comes again in a later batch may count again.
            assert {b for b, n in Counter(x[0] for x in distinct).items() if n > 5} <= set(told) == set(blocks) <= {b for b, n in Counter(x[0] for x in rows).items() if n > 5}
            for b, members in blocks.items():
                assert {(b, s, t) for _, s, t in members} == {x for x in distinct if x[0] == b} and [m[0] for m in members] == [i // 5 for i in range(len(members))]
                assert told[b] == -(-len(members) // 5)
            assert got == band_pairs([x for x in distinct if x[0] not in told], cross)


def test_large_bands_are_split(spark):
    r = random.Random(9)
    for cross in (False, True):
        rows = [(r.choice([1, 1, 2, 3]), r.randint(0, 1) if cross else 0, r.randint(0, 70)) for _ in range(300)]
        df = spark.createDataFrame([(2 * b + s, t) for b, s, t in rows], "band long, tid long")
        got = [tuple(x) for x in candidates(df, 3, cross, block=7).collect()]
        assert set(got) == band_pairs(set(rows), cross) and len(got) == len(set(got))


def test_many_variants_of_one_template(spark):
    """A third of the records are variants of one template; each pair of them is a link."""
    words = " ".join(VOCABULARY[:60])
    df = spark.range(3600).select(F.concat(F.lit("r"), "id").alias("id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit(words + " v"), F.col("id").cast("string"))).otherwise(F.concat_ws(" ", *[F.concat(F.lit("u"), (F.col("id") * (k + 7) % 100_003).cast("string")) for k in range(12)])).alias("text"))
    groups = near_duplicate_groups(df, FIELDS, 0.8, 5, 8, 4).toPandas()
    family = groups[groups.links > 0]
    assert len(groups) == 3600 and len(family) == 1200 and family.group_id.nunique() == 1 and (family.links == 1199).all()


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert near_duplicate_pairs(df, FIELDS).count() == 0 and near_duplicate_groups(df, FIELDS).count() == 0
    assert overlaps(df, df, FIELDS).count() == 0


def test_sketch_fills_and_estimates():
    a, b = np.arange(300, dtype=np.uint64), np.arange(100, 400, dtype=np.uint64)
    one = np.array([7], dtype=np.uint64)
    items = np.concatenate([a, b, one])
    s = similarity_sketch(items, np.repeat([0, 1, 2], [300, 300, 1]), 3, 512)
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.08


def test_words_are_those_of_unicode():
    words, text = word_hashes(["Ärger, x²_½ ok", "", "ok\x00ok", "ok"])
    assert text.tolist() == [0, 0, 0, 0, 2, 2, 3] and len(set(words[3:].tolist())) == 1
    assert len(shingles(words, text, 3)[0]) == 2 and len(word_hashes([])[0]) == 0


def test_word_index_against_brute_force():
    r = random.Random(2)
    evals = [" ".join(r.choices(VOCABULARY[:12], k=r.randint(1, 30))) for _ in range(25)] + ["", "w1"]
    index = WordIndex(*word_hashes(evals), len(evals), 3)
    assert index.sizes.tolist() == [len(sets(t, 3)) for t in evals]
    probe = " ".join(r.choices(VOCABULARY[:14], k=60))
    words, text = word_hashes([probe])
    coded = index.code(words)
    at, lo, hi = index.shingle_intervals(coded, text)
    split = probe.split(" ")
    padded = [f" {t} " for t in evals]
    for a, x, y in zip(at, lo, hi):
        gram = " ".join(split[a : a + 3])
        assert y - x == sum(t.count(f" {gram} ") if len(set(gram.split())) > 1 else len(re.findall(f"(?= {gram} )", t)) for t in padded)
    _, first, stop = index.matches(coded, np.array([0]), np.array([len(coded)]))
    for a, b in zip(first, stop):
        assert any(f" {' '.join(split[a:b])} " in t for t in padded)
        assert a == 0 or not any(f" {' '.join(split[a - 1 : b])} " in t for t in padded)


def test_overlaps_against_brute_force(spark):
    all_ = texts(4, 140)
    e = [(f"e{i:03d}", t, 0) for i, t in enumerate(all_[::2])]
    t = [(f"t{i:03d}", x, "s") for i, x in enumerate(all_[1::2])] + [("t001", all_[3], "s")]
    edf, tdf = spark.createDataFrame(e, "id string, text string, e int"), spark.createDataFrame(t, "id string, text string, shard string")
    for least, n, bands in ((0.7, 3, 32), (0.8, 5, 32)):
        se, st = {i: sets(x, n) for i, x, *_ in e}, {i: sets(x, n) for i, x, *_ in t}
        expected = {(a, b) for a in se for b in st if se[a] | st[b] and jaccard(se[a], st[b]) >= least}
        got = overlaps(edf, tdf, FIELDS, least, n, bands, 4).collect()
        assert {(r.eval_id, r.train_id) for r in got} == expected and len(got) == len(expected)
        for r in got:
            assert abs(r.similarity - jaccard(se[r.eval_id], st[r.train_id])) < 1e-5


def test_hot_text(spark):
    """A third of the training rows are one text."""
    hot = " ".join(VOCABULARY[:40])
    t = spark.range(300).select(F.concat(F.lit("t"), "id").alias("id"), F.when(F.col("id") % 3 == 0, hot).otherwise(F.concat(F.lit("other text number "), F.col("id").cast("string"), F.lit(" of its own"))).alias("text"))
    e = spark.createDataFrame([("e", hot + " end")], "id string, text string")
    assert overlaps(e, t, FIELDS).count() == 100


def test_paragraph_clusters(spark):
    r = random.Random(11)
    part = " ".join(r.choices(VOCABULARY, k=40))
    near = part.replace(part.split(" ")[39], "changed")
    docs = [(1, f"Title\n{part}\n\nend of one"), (2, f"{near}"), (3, None), (4, ""), (5, f"é\n{part.upper()}"), (6, "alone with a text of its own"), (None, part)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, pid string")
    got = {tuple(x) for x in paragraph_clusters(df).collect()}
    assert got == {(1, 1, 6, 6 + len(part), "1:1", 2, False), (2, 0, 0, len(near), "1:1", 2, True), (5, 1, 2, 2 + len(part), "1:1", 2, True)}
    assert paragraph_clusters(df.limit(0)).count() == 0
