"""Candidate generation, audits and temporal tables (g01-g23)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import date_split, parse_date
from ..functions.hashing import hex_number
from ..functions.labels import cited_type
from ..functions.text import base_id, component, normalize_text
from ..operators import audits, eligible, joins, temporal
from ..operators import candidates as C
from ..operators.components import components
from ..operators.schema import best_overlap_column, resolve_ids
from ..operators.vectors import dot, unit
from ..plans.cut import cut
from ..sources.tables import load_splits
from .fragments import BASE, CODES, COMPONENT, DATE, IDENT, NORM, REFERENCES
from .registry import query, table
from .relational import _PAIRS3
from .scalars import T1, T2

_DOCS = f"""md AS (SELECT coalesce(nullif({BASE.format('base_id')}, ''), {BASE.format('input_id')}) AS base, {DATE.format('publication_date')} AS pub, {CODES.format('cpc_subclasses')} AS codes, {REFERENCES.format('reference_bases')} AS refs, row_pos FROM doc_metadata),
    dm AS (SELECT base, arg_max({{'pub': pub, 'codes': codes, 'refs': refs}}, row_pos) AS v FROM md WHERE base <> '' GROUP BY base), docs AS (SELECT base, v.pub AS pub, v.codes AS codes, v.refs AS refs FROM dm),
    al AS (SELECT {IDENT.format('input_id')} AS exact, {BASE.format('input_id')} AS base, coalesce(nullif({BASE.format('base_id')}, ''), {BASE.format('input_id')}) AS target, row_pos FROM doc_metadata),
    alias AS (SELECT alias, arg_max(target, row_pos) AS target FROM (SELECT exact AS alias, target, row_pos FROM al WHERE exact <> '' UNION ALL SELECT base, target, row_pos FROM al WHERE exact <> '') GROUP BY alias)"""


def _resolved(c: str) -> str:
    return f"coalesce((SELECT target FROM alias WHERE alias = {IDENT.format(c)}), (SELECT target FROM alias WHERE alias = {BASE.format(c)}), {BASE.format(c)})"


_SPLIT_ROWS = "(" + " UNION ALL BY NAME ".join(f"SELECT '{n}' AS split, * FROM {n}" for n in ("train", "validation", "test")) + ")"
_PREP = f"""prep AS (SELECT split, _row_id, claim_id, label, {_resolved('t.patent_application_id')} AS app, {_resolved('t.cited_document_id')} AS doc, {_resolved('coalesce(t._u_candidate_base, t.cited_document_id)')} AS hard_doc,
    {NORM.format('text')} AS q, {NORM.format('text_b')} AS passage, coalesce({DATE.format('_date')}, _parsed_date::DATE, {DATE.format('date')}) AS target, CASE WHEN {DATE.format('_date')} IS NOT NULL THEN '_date' WHEN _parsed_date IS NOT NULL THEN '_parsed_date' WHEN {DATE.format('date')} IS NOT NULL THEN 'date' END AS target_source,
    coalesce({COMPONENT.format('_u_target_component')}, {COMPONENT.format('_priority_component_id')}) AS target_component, {COMPONENT.format('_priority_component_id')} AS own_component FROM {_SPLIT_ROWS} t)"""
_UNIVERSE = """uni0 AS (SELECT split, doc, passage, min(_row_id) AS first, coalesce(list_sort(list(DISTINCT own_component) FILTER (own_component IS NOT NULL)), []) AS components FROM prep WHERE label <> 2 AND doc <> '' AND passage <> '' GROUP BY ALL),
    uni AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY first, doc, md5(passage)) - 1 AS cand, doc AS base, passage AS cpassage, pub, codes, components FROM uni0 JOIN docs ON base = doc WHERE pub IS NOT NULL AND len(codes) > 0)"""
_TARGETS = "tg AS (SELECT p.*, d.codes AS target_codes, d.refs AS target_refs, d.base IS NOT NULL AS known FROM prep p LEFT JOIN docs d ON d.base = p.app WHERE label = 2 QUALIFY row_number() OVER (PARTITION BY split, claim_id ORDER BY _row_id) = 1)"
_POOL = """pool0 AS (SELECT t.split, t.claim_id, t.app, t.q, u.cand, u.base, u.cpassage FROM tg t JOIN uni u ON t.split = u.split AND len(list_intersect(t.target_codes, u.codes)) > 0 AND u.pub < t.target AND u.base <> t.app AND u.base <> t.hard_doc AND u.cpassage <> t.passage
    AND NOT coalesce(list_contains(u.components, t.target_component), false) AND NOT list_contains(t.target_refs, u.base)),
    pool AS (SELECT split, claim_id, cand FROM pool0 t WHERE NOT EXISTS (SELECT 1 FROM prep p WHERE p.label <> 2 AND p.split = t.split AND p.app = t.app AND p.doc = t.base) AND NOT EXISTS (SELECT 1 FROM prep p WHERE p.label <> 2 AND p.split = t.split AND p.q = t.q AND p.doc = t.base)
    AND NOT EXISTS (SELECT 1 FROM prep p WHERE p.split = t.split AND p.q = t.q AND p.passage = t.cpassage))"""
_CHAIN = f"WITH {_DOCS}, {_PREP}, {_UNIVERSE}, {_TARGETS}, {_POOL}"
_CHOSEN = """, sized AS (SELECT split, claim_id, count(*) AS pool_size FROM pool GROUP BY ALL), pick AS (SELECT split, claim_id, pool_size, (('0x' || substr(sha256('42|' || split || '|' || app || '|' || q), 1, 16))::UBIGINT % pool_size)::BIGINT AS place FROM tg JOIN sized USING (split, claim_id)),
    placed AS (SELECT split, claim_id, cand, row_number() OVER (PARTITION BY split, claim_id ORDER BY cand) - 1 AS n FROM pool), chosen AS (SELECT p.split, p.claim_id, cand, pool_size FROM placed p JOIN pick k ON p.split = k.split AND p.claim_id = k.claim_id AND n = place)"""


_SPLITS = ("train", "validation", "test")
_CHAIN_COLUMNS = ["_row_id", "claim_id", "patent_application_id", "cited_document_id", "text", "text_b", "label", "date", "_date", "_parsed_date", "_priority_component_id", "_u_target_component", "_u_candidate_base"]


def _chain(spark: SparkSession, folder: str, splits: tuple[str, ...] = _SPLITS) -> C.Chain:
    return C.Chain(load_splits(spark, folder, list(splits), _CHAIN_COLUMNS), table(spark, folder, "doc_metadata"))


@query(f"WITH {_DOCS} SELECT base, pub, codes, refs FROM docs")
def g01_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return C.metadata(table(spark, folder, "doc_metadata"))


@query(f"WITH {_DOCS}, {_PREP}, {_UNIVERSE} SELECT split, cand, base, md5(cpassage) AS passage, pub, codes, components FROM uni")
def g02_universe(spark: SparkSession, folder: str) -> DataFrame:
    return _chain(spark, folder).cands.select("split", "cand", "base", F.col("text_key").alias("passage"), "pub", "codes", "components")


@query(f"{_CHAIN} SELECT split, claim_id, cand FROM pool")
def g03_pool(spark: SparkSession, folder: str) -> DataFrame:
    return _chain(spark, folder).pool()


@query(f"{_CHAIN} SELECT split, claim_id, CASE WHEN NOT known THEN 'missing_target_metadata' WHEN len(target_codes) = 0 THEN 'missing_target_cpc' WHEN target IS NULL THEN 'missing_target_date' WHEN (split, claim_id) NOT IN (SELECT (split, claim_id) FROM pool) THEN 'no_remaining_candidate' END AS reason FROM tg")
def g04_failures(spark: SparkSession, folder: str) -> DataFrame:
    c = _chain(spark, folder)
    return C.failures(c.targets, c.sizes)


@query(f"{_CHAIN} {_CHOSEN} SELECT split, 'random_' || split || '_' || _row_id AS row_id, claim_id, base AS candidate_base, strftime(u.pub, '%Y-%m-%d') AS candidate_date, array_to_string(codes, '|') AS candidate_codes, cpassage AS text_b, 2 AS label, 42 AS seed, pool_size, target_source FROM chosen JOIN uni u USING (split, cand) JOIN tg USING (split, claim_id)")
def g05_random_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return _chain(spark, folder).random()


def _vectors(spark: SparkSession, folder: str, df: DataFrame, digest: str, name: str) -> DataFrame:
    """``df`` with a vector of the table of embeddings for each text, drawn by its digest: stands in for the texts' own."""
    vectors = table(spark, folder, "embeddings")
    of = df.crossJoin(F.broadcast(vectors.agg(F.count("*").alias("__n")))).withColumn("__v", hex_number(digest) % F.col("__n")).drop("__n")
    return of.join(vectors.select(F.col("vec_id").alias("__v"), unit("embedding").alias(name)), "__v", "left").drop("__v")


def _best(spark: SparkSession, folder: str, c: C.Chain, chosen: DataFrame | None = None) -> DataFrame:
    """The best cosines of claim and passage over each target's eligible candidates, and with ``chosen`` the chosen candidate's (``own``)."""
    t = _vectors(spark, folder, c.targets, "q", "vector").withColumn("own", F.lit(None).cast("double"))
    u = _vectors(spark, folder, c.cands.select("split", "cand", "text_key"), "text_key", "vector").select("split", "cand", "vector")
    if chosen is not None:
        of = chosen.join(u, ["split", "cand"]).select("split", "claim_id", F.col("vector").alias("__c"))
        t = t.drop("own").join(of, ["split", "claim_id"], "left").withColumn("own", F.round(dot("vector", "__c"), 6)).drop("__c")
    t = cut(t)
    found = eligible.best(c.asked(t, "vector", "own"), cut(c.index.join(u, ["split", "cand"])))
    return found.join(t.select("split", "claim_id", "own"), ["split", "claim_id"])


_VECTOR = "(SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id = ('0x' || substr(md5({0}), 1, 8))::UBIGINT % (SELECT count(*) FROM embeddings))"
_DENSE = f"""tv AS (SELECT split, claim_id, {_VECTOR.format('q')} AS qv FROM tg), cv AS (SELECT split, cand, {_VECTOR.format('cpassage')} AS cv FROM uni),
    dense AS (SELECT split || '|' || claim_id AS key, split, claim_id, cand, round(list_cosine_similarity(qv, cv), 6) AS score FROM pool JOIN tv USING (split, claim_id) JOIN cv USING (split, cand) WHERE split = 'test' AND qv IS NOT NULL AND cv IS NOT NULL)"""


@query(f"""{_CHAIN}, {_DENSE}, b AS (SELECT key, max(score) AS m FROM dense GROUP BY 1), o AS (SELECT split, claim_id, min(cand) FILTER (score = m) AS cand, any_value(m) AS similarity, sum((m - score <= 1e-8)::INT)::BIGINT AS ties, count(*) AS pool_size FROM dense d JOIN b USING (key) GROUP BY ALL)
    SELECT split, claim_id, base AS candidate_base, md5(cpassage) AS passage, strftime(pub, '%Y-%m-%d') AS candidate_date, similarity, ties, pool_size, 'cosine' AS method FROM o JOIN uni USING (split, cand)""")
def g06_dense_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """For test, the evaluation split: the eligible candidate with the largest cosine (the least number on ties), how many tie, the pool's size and where it is from."""
    c = _chain(spark, folder, ("test",))
    told = _best(spark, folder, c).join(c.cands, ["split", "cand"])
    return told.select("split", "claim_id", F.col("base").alias("candidate_base"), F.col("text_key").alias("passage"), F.date_format("pub", "yyyy-MM-dd").alias("candidate_date"), F.col("score").alias("similarity"), "ties", F.col("n").alias("pool_size"), F.lit("cosine").alias("method"))


_AUDIT = f"""r AS (SELECT 'generated' AS source, split, claim_id, base AS cb, cpassage AS tb FROM chosen JOIN uni USING (split, cand) UNION ALL SELECT 'table', 'test', claim_id, {_resolved('coalesce(t._u_candidate_base, t.cited_document_id)')}, {NORM.format('text_b')} FROM generate_random_u t),
    j AS (SELECT r.source, t.split, t.q, r.tb, r.tb = t.passage AS v3, r.cb = t.hard_doc AS v4, coalesce(list_contains(t.target_refs, r.cb), false) OR EXISTS (SELECT 1 FROM prep p WHERE p.label <> 2 AND p.split = t.split AND p.claim_id = t.claim_id AND p.doc = r.cb) OR EXISTS (SELECT 1 FROM prep p WHERE p.label <> 2 AND p.split = t.split AND p.app = t.app AND p.doc = r.cb) AS v5,
      NOT coalesce(d.pub < t.target, false) AS v6, NOT coalesce(len(list_intersect(d.codes, t.target_codes)) > 0, false) AS v7, coalesce(list_contains(c.components, t.target_component), false) AS v8
      FROM r JOIN tg t ON t.split = r.split AND t.claim_id = r.claim_id LEFT JOIN docs d ON d.base = r.cb LEFT JOIN uni0 c ON c.split = r.split AND c.doc = r.cb AND c.passage = r.tb)"""


@query(f"""{_CHAIN} {_CHOSEN}, {_AUDIT} SELECT source, split, unnest(['duplicate_queries', 'duplicate_query_passage_pairs', 'same_as_hard_u_passage', 'same_as_hard_u_document', 'existing_citation_or_reference', 'time_violation', 'cpc_violation', 'same_component_violation']) AS check,
    unnest([count(*) - count(DISTINCT q), count(*) - count(DISTINCT (q, tb)), count(*) FILTER (v3), count(*) FILTER (v4), count(*) FILTER (v5), count(*) FILTER (v6), count(*) FILTER (v7), count(*) FILTER (v8)]) AS count FROM j GROUP BY source, split""")
def g07_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Of the candidates made here, and of those of the table, which weren't made by these rules."""
    c = _chain(spark, folder)
    given = table(spark, folder, "generate_random_u").select("claim_id", F.coalesce("_u_candidate_base", "cited_document_id").alias("id"), normalize_text("text_b").alias("text_b"), F.lit("test").alias("split"))
    given = resolve_ids(given, "id", table(spark, folder, "doc_metadata"), "input_id", "base_id", "row_pos", "candidate_base")
    both = c.picked().withColumn("source", F.lit("generated")).unionByName(given.select("split", "claim_id", "candidate_base", F.md5("text_b").alias("text_key"), F.lit("table").alias("source")))
    return C.violations(both, c.targets, c.prep, c.docs)


_REL = {"query": NORM.format("text"), "passage": NORM.format("text_b"), "document": BASE.format("cited_document_id"), "application": BASE.format("patent_application_id"), **{c.strip("_"): f"trim({c})" for c in ("_component_id", "_supercomponent_id", "_priority_component_id")}}


def _relations() -> dict:
    own = {c.strip("_"): F.trim(c) for c in ("_component_id", "_supercomponent_id", "_priority_component_id")}
    return {"query": normalize_text("text"), "passage": normalize_text("text_b"), "document": base_id("cited_document_id"), "application": base_id("patent_application_id")} | own


def _values(source: str, relations: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT split, '{n}' AS relation, {s} AS value FROM {source}" for n, s in relations.items())


_REL3 = {k: _REL[k] for k in ("query", "passage", "document")}
_RANDOM4 = "(" + " UNION ALL ".join(f"SELECT '{n}' AS split, text, text_b, cited_document_id AS id FROM {n}" for n in ("train", "validation", "test")) + " UNION ALL SELECT 'random', text, text_b, _u_candidate_base FROM generate_random_u)"


@query(f"""WITH {_DOCS}, v AS (SELECT split, text, text_b, {_resolved('t.id')} AS doc FROM {_RANDOM4} t), d AS (SELECT DISTINCT * FROM ({_values('v', _REL3 | {'document': 'doc'})}) WHERE value <> '')
    SELECT a.relation, a.split AS first, b.split AS second, count(*) AS shared FROM d a JOIN d b ON a.relation = b.relation AND a.value = b.value AND a.split < b.split GROUP BY ALL""")
def g08_cross_split_random(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of splits and the random rows, by resolved documents: the candidate's for random rows, the cited one for others."""
    cols = ["text", "text_b"]
    rows = load_splits(spark, folder, list(_SPLITS), [*cols, F.col("cited_document_id").alias("id")])
    rand = table(spark, folder, "generate_random_u").select(*cols, F.col("_u_candidate_base").alias("id"), F.lit("random").alias("split"))
    both = resolve_ids(rows.unionByName(rand), "id", table(spark, folder, "doc_metadata"), "input_id", "base_id", "row_pos", "doc")
    rel = _relations()
    return audits.cross_split_overlaps(both, "split", {"query": rel["query"], "passage": rel["passage"], "document": F.col("doc")})


@query(f"{_CHAIN}, z AS (SELECT split, claim_id, count(*) AS n FROM pool GROUP BY ALL) SELECT split, count(n) AS queries, round(count(n) / count(*), 6) AS coverage, round(avg(n), 6) AS mean, median(n)::DOUBLE AS median, min(n) AS least, max(n) AS most FROM tg LEFT JOIN z USING (split, claim_id) GROUP BY split")
def g09_pool_summary(spark: SparkSession, folder: str) -> DataFrame:
    c = _chain(spark, folder)
    return C.pool_summary(c.targets, c.sizes)


@query(f"{_CHAIN} {_CHOSEN}, {_DENSE}, b AS (SELECT key, max(score) AS m FROM dense GROUP BY 1), o AS (SELECT key, score AS own FROM dense JOIN chosen USING (split, claim_id, cand)) SELECT key, sum((score > own)::INT)::BIGINT + 1 AS rank, round(any_value(m) - any_value(own), 6) AS gap, (sum((score > own)::INT) + 1 <= 3 AND round(any_value(m) - any_value(own), 6) <= 0.002::DOUBLE) AS near_tie FROM dense JOIN o USING (key) JOIN b USING (key) GROUP BY key")
def g10_near_ties(spark: SparkSession, folder: str) -> DataFrame:
    c = _chain(spark, folder, ("test",))
    return C.near_ties(_best(spark, folder, c, c.chosen))


@query(f"""WITH v AS (SELECT split, label, {NORM.format('text')} AS q, {NORM.format('text_b')} AS p FROM {_PAIRS3}),
    d AS (SELECT DISTINCT * FROM ({_values(_PAIRS3, _REL)}) WHERE value <> '')
    SELECT 'rows' AS check, split || '/' || label AS subject, count(*) AS value FROM v GROUP BY ALL
    UNION ALL SELECT 'repeated_pairs', split, count(*) - count(DISTINCT q || chr(10) || p) FROM v GROUP BY split
    UNION ALL SELECT 'queries_with_several_u', split, count(*) FILTER (u > 1) FROM (SELECT split, q, count(*) FILTER (label = 2) AS u FROM v GROUP BY ALL) GROUP BY split
    UNION ALL SELECT 'shared_values', a.relation || '/' || a.split || '/' || b.split, count(*) FROM d a JOIN d b ON a.relation = b.relation AND a.value = b.value AND a.split < b.split GROUP BY ALL""")
def g11_release_report(spark: SparkSession, folder: str) -> DataFrame:
    cols = ["label", "text", "text_b", "cited_document_id", "patent_application_id", "_component_id", "_supercomponent_id", "_priority_component_id"]
    rows = load_splits(spark, folder, ["train", "validation", "test"], cols)
    return audits.release_report(rows, "split", "label", normalize_text("text"), normalize_text("text_b"), _relations())


_DAY = f"coalesce({DATE.format('_date')}, _parsed_date::DATE, {DATE.format('date')})"
_RELAX = f"""u AS (SELECT 0 AS src, * FROM {_PAIRS3} WHERE label <> 2 UNION ALL SELECT 1, 'quarantine', * FROM quarantine),
    one AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY _row_id ORDER BY src, {NORM.format('text_b')}, label) = 1),
    rel AS (SELECT *, {_DAY} AS day FROM one), relaxed AS (SELECT *, CASE WHEN day <= DATE '{T1}' THEN 'train' WHEN day <= DATE '{T2}' THEN 'validation' WHEN day IS NOT NULL THEN 'test' END AS relaxed FROM rel)"""


def _relaxed(spark: SparkSession, folder: str) -> DataFrame:
    from ..functions.dates import choose_date

    cols = ["_row_id", "label", "text", "text_b", "cited_document_id", "patent_application_id", "_component_id", "_supercomponent_id", "_priority_component_id", "date", "_date", "_parsed_date"]
    rows = load_splits(spark, folder, ["train", "validation", "test"], cols).where("label <> 2").withColumn("src", F.lit(0))
    q = table(spark, folder, "quarantine").select(*cols, F.lit("quarantine").alias("split"), F.lit(1).alias("src"))
    both = rows.unionByName(q, allowMissingColumns=True).withColumn("o", normalize_text("text_b"))
    one = joins.first_rows(both, ["_row_id"], ["src", "o", "label"]).drop("o")
    return one.withColumn("relaxed", date_split(choose_date(["_date", "_parsed_date", "date"])[0], T1, T2))


@query(f"WITH {_RELAX} SELECT split, relaxed, label, count(*) AS rows FROM relaxed GROUP BY ALL")
def g12_relaxed_split(spark: SparkSession, folder: str) -> DataFrame:
    """Cited rows and quarantine put together, first row of an id kept, and split again by date."""
    return _relaxed(spark, folder).groupBy("split", "relaxed", "label").agg(F.count("*").alias("rows"))


def _stats(values: str) -> str:
    """Statistics of a relation of (relation, split, value)."""
    return f"""x AS (SELECT * FROM ({values}) WHERE value <> ''), n AS (SELECT relation, value, count(DISTINCT split) AS k, count(*) AS n, count(*) FILTER (split = 'train') AS tr, count(*) FILTER (split = 'test') AS te FROM x WHERE split IS NOT NULL GROUP BY ALL)
    SELECT relation, count(*) FILTER (k > 1) AS shared_values, coalesce(sum(n) FILTER (k > 1), 0)::BIGINT AS rows_affected, count(*) FILTER (tr > 0 AND te > 0) AS train_test_values,
    coalesce(sum(tr + te) FILTER (tr > 0 AND te > 0), 0)::BIGINT AS train_test_rows, coalesce(sum(te) FILTER (tr > 0), 0)::BIGINT AS contaminated_rows, sum(te)::BIGINT AS test_rows, round(coalesce(coalesce(sum(te) FILTER (tr > 0), 0) / nullif(sum(te), 0), 0), 6) AS contamination FROM n GROUP BY relation"""


@query(f"WITH {_stats(_values(_PAIRS3, _REL))}")
def g13_cross_split_stats(spark: SparkSession, folder: str) -> DataFrame:
    cols = ["text", "text_b", "cited_document_id", "patent_application_id", "_component_id", "_supercomponent_id", "_priority_component_id"]
    return audits.cross_split_statistics(load_splits(spark, folder, ["train", "validation", "test"], cols), "split", _relations())


_SWEEP = " UNION ALL ".join(f"SELECT '{c}|{n}' AS relation, {c} AS split, {s} AS value FROM relaxed" for c in ("split", "relaxed") for n, s in _REL.items())


@query(f"WITH {_RELAX}, s AS (WITH {_stats(_SWEEP)}) SELECT string_split(relation, '|')[1] AS condition, * REPLACE (string_split(relation, '|')[2] AS relation) FROM s")
def g14_relation_sweep(spark: SparkSession, folder: str) -> DataFrame:
    rows = _relaxed(spark, folder)
    return audits.relation_sweep(rows, ["split", "relaxed"], _relations())


@query("SELECT DISTINCT _row_id FROM quarantine WHERE _row_id NOT IN (SELECT _row_id FROM train UNION ALL SELECT _row_id FROM validation UNION ALL SELECT _row_id FROM test)")
def g15_quarantine_rows(spark: SparkSession, folder: str) -> DataFrame:
    kept = load_splits(spark, folder, ["train", "validation", "test"], ["_row_id"])
    return audits.extract_marked(table(spark, folder, "quarantine"), "is_quarantine", kept, "_row_id").select("_row_id").distinct()


@query("""WITH k AS (SELECT claim_id FROM test WHERE label = 2 INTERSECT SELECT claim_id FROM generate_random_u INTERSECT SELECT claim_id FROM test WHERE label <> 2)
    SELECT 'cited' AS kind, claim_id, _row_id FROM test WHERE label <> 2 AND claim_id IN (SELECT * FROM k) UNION ALL SELECT 'hard_u', claim_id, _row_id FROM test WHERE label = 2 AND claim_id IN (SELECT * FROM k) UNION ALL SELECT 'random_u', claim_id, _row_id FROM generate_random_u WHERE claim_id IN (SELECT * FROM k)""")
def g16_matched_set(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "test").select(F.when(F.col("label") == 2, "hard_u").otherwise("cited").alias("kind"), "claim_id", "_row_id")
    r = table(spark, folder, "generate_random_u").select(F.lit("random_u").alias("kind"), "claim_id", "_row_id")
    rows = t.unionByName(r)
    key = lambda k: rows.where(F.col("kind") == k).select("claim_id")
    return rows.join(key("hard_u").intersect(key("random_u")).intersect(key("cited")), "claim_id", "left_semi").select("kind", "claim_id", "_row_id")


@query("SELECT DISTINCT p.query_id, p.source_row_id AS _row_id, p.candidate_type, coalesce(t.text, r.text) AS query_text, CASE WHEN p.candidate_type = 'random_u' THEN r.text_b ELSE t.text_b END AS passage_text FROM predictions_long p LEFT JOIN test t ON t._row_id = p.source_row_id LEFT JOIN (SELECT _row_id, min(text) AS text, min(text_b) AS text_b FROM generate_random_u GROUP BY 1) r ON r._row_id = p.source_row_id")
def g17_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The template's rows with their texts from the table that their type names; its id column is found by overlap."""
    p = table(spark, folder, "predictions_long")
    test = table(spark, folder, "test")
    id_col = best_overlap_column(p, ["query_id", "source_row_id", "prediction_row_id"], test, "_row_id")
    both = test.select(F.lit(False).alias("random"), "_row_id", F.col("text").alias("query_text"), F.col("text_b").alias("passage_text"))
    r = table(spark, folder, "generate_random_u").groupBy("_row_id").agg(F.min("text").alias("query_text"), F.min("text_b").alias("passage_text")).withColumn("random", F.lit(True))
    template = p.select("query_id", F.col(id_col).alias("_row_id"), "candidate_type", (F.col("candidate_type") == "random_u").alias("random")).distinct()
    return template.join(both.unionByName(r), ["random", "_row_id"], "left").drop("random")


@query("""WITH r AS (SELECT _row_id, min(text) AS text, min(text_b) AS text_b FROM generate_random_u GROUP BY 1),
    m AS (SELECT DISTINCT p.query_id, p.source_row_id, p.candidate_type, coalesce(t.text, r.text) AS query_text, CASE WHEN p.candidate_type = 'random_u' THEN r.text_b ELSE t.text_b END AS passage_text FROM predictions_long p LEFT JOIN test t ON t._row_id = p.source_row_id AND p.candidate_type <> 'random_u' LEFT JOIN r ON r._row_id = p.source_row_id AND p.candidate_type = 'random_u'),
    e AS (SELECT 'cited' AS candidate_type, count(*) AS n, count(DISTINCT claim_id) AS q FROM test WHERE label <> 2 UNION ALL SELECT 'hard_u', count(*), count(DISTINCT claim_id) FROM test WHERE label = 2 UNION ALL SELECT 'random_u', count(DISTINCT _row_id), count(DISTINCT claim_id) FROM generate_random_u),
    g AS (SELECT candidate_type, count(*) AS rows, count(DISTINCT trim(query_id)) AS queries, count(*) FILTER (candidate_type = 'cited') AS cited_rows, count(*) FILTER (candidate_type <> 'cited') AS u_rows, count(*) FILTER (query_text IS NULL) AS no_query_text, count(*) FILTER (passage_text IS NULL) AS no_passage_text FROM m GROUP BY 1)
    SELECT candidate_type, rows, queries, cited_rows, u_rows, no_query_text, no_passage_text, coalesce(rows = n AND queries = q AND no_query_text = 0 AND no_passage_text = 0, false) AS valid FROM g FULL JOIN e USING (candidate_type)""")
def g18_manifest_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of g17 against the rows, queries, cited and uncited rows that its tables have, and without missing texts."""
    t, r = table(spark, folder, "test"), table(spark, folder, "generate_random_u")
    count = lambda df, kind, c: df.agg(F.countDistinct("_row_id").alias("rows"), F.countDistinct("claim_id").alias("queries")).select(F.lit(kind).alias("candidate_type"), "rows", "queries", (F.col("rows") * c).alias("cited_rows"), (F.col("rows") * (1 - c)).alias("u_rows"))
    expected = count(t.where("label <> 2"), "cited", 1).unionByName(count(t.where("label = 2"), "hard_u", 0)).unionByName(count(r, "random_u", 0))
    return audits.manifest_report(g17_manifest(spark, folder), ["candidate_type"], "query_id", cited_type("candidate_type"), ["query_text", "passage_text"], expected)


@query(f"""WITH k AS (SELECT _row_id, label, sha1(sha1({NORM.format('text')}) || '|' || sha1({NORM.format('text_b')})) AS pair FROM train), f AS (SELECT pair, count(DISTINCT label) AS l, min(_row_id) AS first FROM k GROUP BY 1)
    SELECT _row_id, pair, CASE WHEN l > 1 THEN 'conflicting_label' WHEN _row_id <> first THEN 'duplicate' END AS reason FROM k JOIN f USING (pair)""")
def g19_source_cleaning(spark: SparkSession, folder: str) -> DataFrame:
    return audits.clean_pairs(table(spark, folder, "train").select("_row_id", "label", "text", "text_b"), "text", "text_b", "label", ["_row_id"]).select("_row_id", "pair", "reason")


_IDS = ("document", "application", "component_id", "supercomponent_id", "priority_component_id")


@query(f"""WITH RECURSIVE rows AS (SELECT list_filter([{", ".join(f"CASE WHEN {_REL[n]} <> '' THEN '{n}|' || {_REL[n]} END" for n in _IDS)}], lambda x: x IS NOT NULL) AS ids FROM {_PAIRS3}),
    e AS (SELECT DISTINCT ids[1] AS u, unnest(ids) AS v FROM rows WHERE len(ids) > 0), s AS (SELECT u AS x, v AS y FROM e UNION SELECT v, u FROM e),
    least_(x, y, k) AS (SELECT x, min(y), 0 FROM s GROUP BY x UNION ALL SELECT s.x, min(l.y), l.k + 1 FROM s JOIN least_ l ON l.x = s.y WHERE l.k < 40 GROUP BY s.x, l.k) SELECT x AS node, min(y) AS component FROM least_ GROUP BY x""")
def g20_components(spark: SparkSession, folder: str) -> DataFrame:
    """Components of all ids that rows of the three splits share, cited or not; a node is a relation and an id.

    A row ties its first id to each other one; a row with one id gives a node of its own."""
    rel = _relations()
    cols = ["cited_document_id", "patent_application_id", "_component_id", "_supercomponent_id", "_priority_component_id"]
    ids = F.filter(F.array(*[F.when(rel[n] != "", F.concat(F.lit(f"{n}|"), rel[n])) for n in _IDS]), lambda x: x.isNotNull())
    rows = load_splits(spark, folder, list(_SPLITS), cols).select(ids.alias("ids")).where("size(ids) > 0")
    others = F.when(F.size("ids") == 1, F.col("ids")).otherwise(F.slice("ids", 2, len(_IDS)))
    return components(rows.select(F.col("ids")[0].alias("u"), F.explode(others).alias("v")), "u", "v")


def _dated(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "test").select("claim_id", "label", F.coalesce(parse_date("_date"), F.col("_parsed_date").cast("date")).alias("day"))
    return temporal.query_table(rows, "claim_id", F.col("label") == 2, "day", T1, strict=False)


_QT = f"qt AS (SELECT claim_id, min(coalesce({DATE.format('_date')}, _parsed_date::DATE)) FILTER (label = 2) AS day, count(*) AS rows FROM test GROUP BY 1 HAVING count(*) FILTER (label = 2) > 0), qd AS (SELECT *, date_diff('day', DATE '{T1}', day)::INT AS days FROM qt)"
_BINS = f"{_QT}, p AS (SELECT *, (rank() OVER (ORDER BY day) + (count(*) OVER (PARTITION BY day) - 1) / 2.0::DOUBLE) / count(*) OVER () AS pct FROM qd WHERE day IS NOT NULL), bins AS (SELECT *, CASE WHEN pct <= 1.0::DOUBLE / 3 THEN 'early' WHEN pct <= 2.0::DOUBLE / 3 THEN 'middle' ELSE 'late' END AS bin FROM p)"


@query(f"WITH {_QT} SELECT claim_id, day, rows, days FROM qd")
def g21_temporal_table(spark: SparkSession, folder: str) -> DataFrame:
    return _dated(spark, folder)


@query(f"WITH {_BINS} SELECT bin, count(*) AS queries, sum(rows)::BIGINT AS rows, min(day) AS first, max(day) AS last, median(days)::DOUBLE AS median_days FROM bins GROUP BY bin")
def g22_bin_summary(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.bin_summary(temporal.with_bins(_dated(spark, folder), "day"), "day")


_FLAGS = f"fl AS (SELECT h.claim_id, bool_or({NORM.format('h.text_b')} = {NORM.format('r.text_b')}) AS same_passage, bool_or(coalesce(h._u_candidate_base, '') = coalesce(r._u_candidate_base, '')) AS same_document FROM test h JOIN generate_random_u r ON h.claim_id = r.claim_id AND h.label = 2 GROUP BY 1)"


@query(f"WITH {_FLAGS} SELECT claim_id, unnest(list_filter(['all', CASE WHEN NOT same_passage THEN 'passage_different' END, CASE WHEN NOT same_document THEN 'document_different' END], lambda x: x IS NOT NULL)) AS subset FROM fl")
def g23_subsets(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "test").where("label = 2").select("claim_id", normalize_text("text_b").alias("p"), F.coalesce("_u_candidate_base", F.lit("")).alias("b"))
    r = table(spark, folder, "generate_random_u").select("claim_id", normalize_text("text_b").alias("p2"), F.coalesce("_u_candidate_base", F.lit("")).alias("b2"))
    f = h.join(r, "claim_id").groupBy("claim_id").agg(F.bool_or(F.col("p") == F.col("p2")).alias("sp"), F.bool_or(F.col("b") == F.col("b2")).alias("sd"))
    names = F.array_compact(F.array(F.lit("all"), F.when(~F.col("sp"), "passage_different"), F.when(~F.col("sd"), "document_different")))
    return f.select("claim_id", F.explode(names).alias("subset"))
