"""Retrieval and similarity of texts (t01-t19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..operators import adapters, joins, training, vectors
from ..operators import lexical as X
from ..operators.metrics import accuracy_f1, roc_auc
from ..plans.cut import cut
from ..sources.tables import load_splits
from .fragments import TOKENS
from .registry import columns, query, table

_BIGRAMS = "list_concat({0}, list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"

columns("t01_tokens", "test", "_row_id", {"tokens": (lambda: T.tokens("text_b"), TOKENS.format("text_b"))})
columns("t02_ngrams", "test", "_row_id", {"terms": (lambda: T.ngrams_1_2(T.tokens("text_b")), _BIGRAMS.format(TOKENS.format("text_b")))})
_FIELD = {"claim": "coalesce(text, '')", "passage": "coalesce(text_b, '')", "pair": "coalesce(text, '') || ' ' || coalesce(text_b, '')"}
_VARIANT = {"raw": "{0}", "masked": "regexp_replace({0}, '[0-9]+', '<num>', 'g')", "content": r"trim(regexp_replace(regexp_replace(lower({0}), '\([0-9]+[a-z]?\)|[0-9]+', ' ', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"}
_MAKE = {"raw": lambda c: c, "masked": T.mask_numbers, "content": T.content_only}


def _field(name: str) -> Column:
    claim, passage = F.coalesce("text", F.lit("")), F.coalesce("text_b", F.lit(""))
    return {"claim": claim, "passage": passage, "pair": F.concat_ws(" ", claim, passage)}[name]


columns("t17_text_variants", "test", "_row_id", {f"{f}_{v}": (lambda f=f, v=v: _MAKE[v](_field(f)), _VARIANT[v].format(_FIELD[f])) for f in _FIELD for v in _VARIANT})

_CORPUS = "corpus AS (SELECT coalesce(text, '') AS t FROM train UNION SELECT coalesce(text_b, '') FROM train)"
_BOTH_GRAMS = "unnest(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]))) AS term"
_TERMS = f"toks AS (SELECT t AS doc, {TOKENS.format('t')} AS k FROM corpus), terms AS (SELECT doc, {_BOTH_GRAMS} FROM toks), tf AS (SELECT doc, term, count(*) AS tf FROM terms GROUP BY ALL), vocab AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 200000)"
_TEST_W = f"""ttoks AS (SELECT d, {TOKENS.format('d')} AS k FROM (SELECT coalesce(text, '') AS d FROM test UNION SELECT coalesce(text_b, '') FROM test)), test_tf AS (SELECT d AS doc, term, count(*) AS tf FROM (SELECT d, {_BOTH_GRAMS} FROM ttoks) GROUP BY ALL),
    raw AS (SELECT doc, term, (1 + ln(tf)) * (ln((1.0::DOUBLE + (SELECT count(*) FROM corpus)) / (1 + df)) + 1) AS w FROM test_tf JOIN vocab USING (term)),
    w AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM raw)"""


def _fit(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, int]:
    texts = X.corpus(table(spark, folder, "train"), ["text", "text_b"])
    return texts, X.vocabulary(X.term_statistics(texts, "text", bigrams=True)).select("term", "df"), texts.count()


def _weights(spark: SparkSession, folder: str) -> DataFrame:
    _, vocab, n = _fit(spark, folder)
    docs = X.corpus(table(spark, folder, "test"), ["text", "text_b"])
    return X.tfidf(X.term_counts(docs, "doc", "text", bigrams=True), vocab, n)


@query(f"WITH {_CORPUS}, {_TERMS} SELECT term, df FROM vocab")
def t03_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return _fit(spark, folder)[1]


@query(f"WITH {_CORPUS}, {_TERMS}, {_TEST_W} SELECT md5(doc) AS doc, term, round(w, 6) AS w FROM w")
def t04_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    return _weights(spark, folder).select("doc", "term", F.round("w", 6).alias("w"))


@query(f"WITH {_CORPUS}, {_TERMS}, {_TEST_W}, s AS (SELECT _row_id, sum(a.w * b.w) AS score FROM test JOIN w a ON a.doc = coalesce(text, '') JOIN w b ON b.doc = coalesce(text_b, '') AND a.term = b.term GROUP BY 1) SELECT t._row_id, round(coalesce(score, 0), 6) AS score FROM test t LEFT JOIN s USING (_row_id)")
def t05_tfidf_pairs(spark: SparkSession, folder: str) -> DataFrame:
    w = _weights(spark, folder)
    pairs = table(spark, folder, "test").select("_row_id", X.text_key(F.coalesce("text", F.lit(""))).alias("q"), X.text_key(F.coalesce("text_b", F.lit(""))).alias("d"))
    return X.pair_dot(pairs, "_row_id", "q", "d", w, w).withColumn("score", F.round("score", 6))


@query(f"WITH {_CORPUS} SELECT t AS text FROM corpus")
def t06_fit_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return X.corpus(table(spark, folder, "train"), ["text", "text_b"]).select("text")


@query(f"""WITH tt AS (SELECT _row_id AS d, unnest({TOKENS.format('text_b')}) AS term FROM train), tf AS (SELECT d, term, count(*) AS tf FROM tt GROUP BY ALL),
    st AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 200000), av AS (SELECT (SELECT sum(total) FROM st) / (SELECT count(*) FROM train) AS avg, (SELECT count(*) FROM train) AS n),
    dt AS (SELECT _row_id, term, count(*) AS tf FROM (SELECT _row_id, unnest({TOKENS.format('text_b')}) AS term FROM test) GROUP BY ALL), kd AS (SELECT * FROM dt JOIN st USING (term)), le AS (SELECT _row_id, sum(tf) AS len FROM kd GROUP BY 1),
    qt AS (SELECT DISTINCT _row_id, unnest({TOKENS.format('text')}) AS term FROM test),
    s AS (SELECT _row_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg))) AS score FROM kd JOIN qt USING (_row_id, term) JOIN le USING (_row_id), av GROUP BY 1)
    SELECT t._row_id, round(coalesce(score, 0), 6) AS score FROM test t LEFT JOIN s USING (_row_id)""")
def t07_bm25(spark: SparkSession, folder: str) -> DataFrame:
    test = table(spark, folder, "test").select("_row_id", "text", "text_b")
    train = table(spark, folder, "train").select("_row_id", "text_b")
    count = lambda c: X.term_counts(test, "_row_id", c).withColumnRenamed("doc", "_row_id")
    return X.bm25(test, "_row_id", count("text").select("_row_id", "term"), count("text_b"), X.term_statistics(train, "text_b"), train.count()).withColumn("score", F.round("score", 6))


_ALNUM = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_BUCKETS = "list_transform(range(64), lambda b: len(list_filter(list_transform(" + _ALNUM.format("text_b") + ", lambda w: ('0x' || substr(md5(w), 1, 8))::UBIGINT % 64), lambda x: x = b))::DOUBLE)"


@query(f"""WITH d AS (SELECT DISTINCT text_b, {_BUCKETS} AS v FROM test WHERE text_b <> ''), u AS (SELECT text_b, list_transform(v, lambda x: round(x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12), 6)) AS vector FROM d)
    SELECT _row_id, vector FROM test LEFT JOIN u USING (text_b)""")
def t08_embed_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Unit vectors of distinct texts from a plugged-in encoder (here hashed terms), joined back to the rows."""
    rows = table(spark, folder, "test").select("_row_id", F.col("text_b").alias("text"))
    out = adapters.embed_distinct(rows, "text", adapters.hashed_terms(64))
    return out.select("_row_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id, round(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)), 6) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def t09_pair_cosine(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(b, "vec_id").select("vec_id", F.round(vectors.cosine("embedding", "next"), 6).alias("cosine"))


_DA, _DB = (f"list_distinct({_ALNUM.format(f'coalesce({c}, {chr(39)}{chr(39)})')})" for c in ("text", "text_b"))


@query(f"SELECT _row_id, round(len(list_intersect({_DA}, {_DB})) / greatest(1, len(list_distinct(list_concat({_DA}, {_DB}))))::DOUBLE, 6) AS score FROM test")
def t10_pair_scorer(spark: SparkSession, folder: str) -> DataFrame:
    """Pair scores from a plugged-in model (here word overlap) in Arrow batches; T11-T13 plug in alike."""
    return adapters.score_pairs(table(spark, folder, "test"), "_row_id", "text", "text_b", adapters.overlap_model).withColumn("score", F.round("score", 6))


_STEP = "(2.0::DOUBLE ** (floor(log2(abs(x))) - 7))"


@query(f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), b AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN x = 0 THEN 0 ELSE round_even(x / {_STEP}, 0) * {_STEP} END) AS v FROM e) SELECT vec_id, list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)), 6)) AS pooled FROM b")
def t11_pooled_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The first of a row's token states (given, here the vector before its own reverse) as bfloat16, brought to unit length."""
    states = table(spark, folder, "embeddings").select("vec_id", F.array("embedding", F.reverse("embedding")).alias("states"))
    return states.select("vec_id", F.transform(adapters.pool_first(F.col("states"), bf16=True), lambda x: F.round(x, 6)).alias("pooled"))


@query("SELECT vec_id, round(exp(embedding[4]::DOUBLE) / (exp(embedding[4]::DOUBLE) + exp(embedding[6]::DOUBLE)), 6) AS p_yes FROM embeddings")
def t12_yes_no(spark: SparkSession, folder: str) -> DataFrame:
    """The probability of 'yes' (token 3) against 'no' (token 5) from rows of next-token logits (given, here the vectors)."""
    return table(spark, folder, "embeddings").select("vec_id", F.round(adapters.next_token_probability(F.col("embedding"), 3, [5]), 6).alias("p_yes"))


#: Tokens of the label words of three prompts: three classes, cited or not, and A or X.
_WORDS = {"direct": {"a": [3, 10], "x": [5], "u": [7, 20, 33]}, "cited": {"c": [2, 4], "u": [9]}, "which": {"a": [11], "x": [12, 13]}}


def _mass(ids: list[int]) -> str:
    return "(" + " + ".join(f"exp(v[{i + 1}])" for i in ids) + ")"


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) " + " UNION ALL ".join(f"SELECT vec_id, '{p}' AS prompt, '{k}' AS label, round({_mass(ids)} / ({' + '.join(_mass(i) for i in w.values())}), 6) AS probability FROM e" for p, w in _WORDS.items() for k, ids in w.items()))
def t13_verbalizers(spark: SparkSession, folder: str) -> DataFrame:
    """Probabilities of the labels from the logits of their words under three prompts; p23 puts the last two together."""
    e = table(spark, folder, "embeddings")
    each = [F.struct(F.lit(p).alias("prompt"), F.lit(k).alias("label"), F.round(c, 6).alias("probability")) for p, w in _WORDS.items() for k, c in adapters.verbalize(F.col("embedding"), w).items()]
    return e.select("vec_id", F.explode(F.array(*each)).alias("x")).select("vec_id", "x.*")


_MODELS, _SEEDS = ("lexical", "hashed"), (13, 42, 77)


def _task_rows(rows: DataFrame) -> DataFrame:
    """Rows of each task with their class: cited or not (of claims that have both kinds), X or A, and all three."""
    cu = joins.owners(rows, "claim_id", F.col("label") == 2).withColumns({"task": F.lit("cited_vs_u"), "y": (F.col("label") != 2).cast("int")})
    xa = rows.where("label <> 2").withColumns({"task": F.lit("x_vs_a"), "y": F.col("label")})
    return cu.unionByName(xa, allowMissingColumns=True).unionByName(rows.withColumns({"task": F.lit("three_way"), "y": F.col("label")}), allowMissingColumns=True)


def _supervised(spark: SparkSession, folder: str) -> DataFrame:
    make = lambda t: training.featured(table(spark, folder, t), "text", "text_b", ["_row_id", "claim_id", "label"])
    fitted = training.train_grid(_task_rows(cut(make("train"))), "task", "y", _MODELS, _SEEDS, "_row_id")
    test = cut(make("test"))
    wanted = _task_rows(test).select("task", "_row_id", "y").dropDuplicates(["task", "_row_id"])
    return training.score_grid(test, fitted, _MODELS, "_row_id").join(wanted, ["task", "_row_id"])


@query()
def t14_supervised(spark: SparkSession, folder: str) -> DataFrame:
    """ROC-AUC of two tasks, and accuracy and macro-F1 of the third, for two models and three seeds, on all test rows."""
    s = cut(_supervised(spark, folder))
    by = ["task", "model", "seed"]
    auc = roc_auc(s.where("task <> 'three_way'"), by, F.col("y") == 1, F.get("probabilities", F.lit(1)))
    best = F.array_position("probabilities", F.array_max("probabilities")).cast("int") - 1
    three = accuracy_f1(s.where("task = 'three_way'").withColumn("best", best), by, "y", "best").where("metric in ('accuracy', 'macro_f1')")
    return auc.unionByName(three).withColumn("value", F.round("value", 3))


@query("""WITH t AS (SELECT 'cited_vs_u' AS task, _row_id FROM test WHERE claim_id IN (SELECT claim_id FROM test WHERE label = 2) UNION SELECT 'x_vs_a', _row_id FROM test WHERE label <> 2 UNION SELECT 'three_way', _row_id FROM test)
    SELECT task, model, seed, count(*) AS rows, count(*) AS valid FROM t, (SELECT unnest(['lexical', 'hashed']) AS model), (SELECT unnest([13, 42, 77])::INT AS seed) GROUP BY ALL""")
def t14_scored_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Each test row of a task is scored by each model and seed, and its probabilities make 1."""
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x)
    valid = (F.abs(total - 1) < 1e-9) & (F.array_min("probabilities") >= 0) & (F.size("probabilities") == F.when(F.col("task") == "three_way", 3).otherwise(2))
    return _supervised(spark, folder).groupBy("task", "model", "seed").agg(F.count("*").alias("rows"), F.count_if(valid).alias("valid"))


def _controlled(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Classifiers of two training conditions, with the same cited rows, and their scores of test and random rows."""
    cols = ["_row_id", "label", "text", "text_b"]
    train, test, random = (table(spark, folder, t).select(cols) for t in ("train", "test", "generate_random_u"))
    made = [training.featured(rows.withColumn("task", F.lit(c)).withColumn("y", (F.col("label") != 2).cast("int")), "text", "text_b", ["_row_id", "task", "y"]) for c, rows in (("hard_only", train), ("mixed", train.unionByName(random)))]
    fitted = cut(training.train_grid(made[0].unionByName(made[1]), "task", "y", ["hashed"], _SEEDS, "_row_id"))
    kinds = test.withColumn("kind", F.when(F.col("label") == 2, "hard_u").otherwise("cited")).unionByName(random.dropDuplicates(["_row_id"]).withColumn("kind", F.lit("random_u")))
    rows = cut(training.featured(kinds.withColumn("key", F.concat_ws("|", "kind", "_row_id")).dropDuplicates(["key"]), "text", "text_b", ["key", "kind"]))
    return fitted, training.score_grid(rows, fitted, ["hashed"], "key").join(rows.select("key", "kind"), "key")


@query()
def t15_controlled_training(spark: SparkSession, folder: str) -> DataFrame:
    """Mean cited probability by training condition, seed and kind of row: hard uncited rows alone in training, or with random ones."""
    scores = _controlled(spark, folder)[1]
    return scores.groupBy(F.col("task").alias("condition"), "seed", "kind").agg(F.round(F.avg(F.get("probabilities", F.lit(1))), 3).alias("mean_score"))


@query("""WITH k AS (SELECT CASE WHEN label = 2 THEN 'hard_u' ELSE 'cited' END AS kind, _row_id FROM test UNION SELECT 'random_u', _row_id FROM generate_random_u)
    SELECT condition, seed, kind, count(*) AS rows FROM k, (SELECT unnest(['hard_only', 'mixed']) AS condition), (SELECT unnest([13, 42, 77])::INT AS seed) GROUP BY ALL""")
def t15_scored_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Each row is scored under each condition and seed."""
    return _controlled(spark, folder)[1].groupBy(F.col("task").alias("condition"), "seed", "kind").agg(F.count("*").alias("rows"))


_A, _B = (f"list_distinct({TOKENS.format(c)})" for c in ("text", "text_b"))
_NA, _NB = (f"len({TOKENS.format(c)})" for c in ("text", "text_b"))
_BOTH = f"len(list_intersect({_A}, {_B}))"


@query(f"""SELECT _row_id, round(coalesce({_BOTH} / nullif(len({_A}) + len({_B}) - {_BOTH}, 0), 0), 6) AS token_jaccard, round(coalesce({_BOTH} / nullif(len({_A}), 0), 0), 6) AS claim_coverage,
    round(ln(1 + {_NB}), 6) AS log1p_passage_length, round(ln(1 + coalesce({_NB} / nullif({_NA}, 0), 0)), 6) AS log1p_passage_claim_ratio FROM test""")
def t16_lexical_features(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "test").select("_row_id", *[F.round(c, 6).alias(n) for n, c in X.pair_features("text", "text_b").items()])


def _fold(key: str) -> Column:
    return H.hex_number(F.md5(key)) % 4 == 0


_SIDES = "(SELECT 'train' AS split, _row_id, claim_id, text_b FROM train UNION ALL SELECT 'test', _row_id, claim_id, text_b FROM test)"


@query(f"SELECT fold, split, count(*) FILTER (held) AS held, count(*) FILTER (NOT held) AS fitted, count(DISTINCT claim_id) FILTER (held) AS held_claims FROM (SELECT f AS fold, split, claim_id, ('0x' || substr(md5(CASE f WHEN 'random_row' THEN _row_id ELSE claim_id END), 1, 8))::UBIGINT % 4 = 0 AS held FROM {_SIDES}, (SELECT unnest(['random_row', 'whole_claims']) AS f)) GROUP BY ALL")
def t18_folds(spark: SparkSession, folder: str) -> DataFrame:
    """Rows held out at random and by whole claims."""
    rows = load_splits(spark, folder, ["train", "test"], ["_row_id", "claim_id"])
    out = [rows.withColumn("held", _fold(k)).groupBy("split").agg(F.count_if("held").alias("held"), F.count_if(~F.col("held")).alias("fitted"), F.countDistinct(F.when(F.col("held"), F.col("claim_id"))).alias("held_claims")).withColumn("fold", F.lit(f)) for f, k in (("random_row", "_row_id"), ("whole_claims", "claim_id"))]
    return out[0].unionByName(out[1])


def _told_apart(spark: SparkSession, folder: str, key: str, field: str = "passage", variant: str = "content") -> tuple[DataFrame, DataFrame]:
    rows = load_splits(spark, folder, ["train", "test"], ["_row_id", "claim_id", "text", "text_b"]).withColumn("y", (F.col("split") == "test").cast("double"))
    return adapters.train_text_classifier(rows.where(~_fold(key)), rows.where(_fold(key)), _MAKE[variant](_field(field)), "y", "_row_id", ["y"])


@query()
def t18_split_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """How well train and test can be told apart by their passages' content words, with rows held out at random and with whole claims
    held out: accuracy and ROC-AUC. What the first has above the second comes from claims that lie on both sides."""
    out = None
    for fold, key in (("random_row", "_row_id"), ("whole_claims", "claim_id")):
        scored = cut(_told_apart(spark, folder, key)[0])
        acc = accuracy_f1(scored.select(F.col("y").cast("int").alias("yy"), (F.col("score") >= 0.5).cast("int").alias("pp")), [], "yy", "pp", [0, 1]).where("metric = 'accuracy'")
        one = roc_auc(scored, [], F.col("y") == 1, "score").unionByName(acc).select(F.lit(fold).alias("fold"), "metric", F.round("value", 3).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def t18_top_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty terms that speak most for either side."""
    terms = _told_apart(spark, folder, "claim_id")[1]
    top = lambda side, order: terms.orderBy(order, "term").limit(20).select(F.lit(side).alias("side"), "term", F.round("coefficient", 3).alias("coefficient"))
    return top("test", F.desc("coefficient")).unionByName(top("train", F.asc("coefficient")))


_TASKS = """SELECT 'cited_vs_u' AS task, _row_id, (label <> 2)::INT AS y FROM test WHERE claim_id IN (SELECT claim_id FROM test WHERE label = 2)
    UNION ALL SELECT 'x_vs_a', _row_id, label FROM test WHERE label <> 2 UNION ALL SELECT 'three_way', _row_id, label FROM test"""


@query(_TASKS)
def t19_task_rows(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "test").select("_row_id", "claim_id", "label")
    cu = joins.owners(t, "claim_id", F.col("label") == 2).select(F.lit("cited_vs_u").alias("task"), "_row_id", (F.col("label") != 2).cast("int").alias("y"))
    xa = t.where("label <> 2").select(F.lit("x_vs_a").alias("task"), "_row_id", F.col("label").alias("y"))
    return cu.unionByName(xa).unionByName(t.select(F.lit("three_way").alias("task"), "_row_id", F.col("label").alias("y")))
