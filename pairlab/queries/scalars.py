"""Projections, predicates and scalar functions (f01-f38)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import collections as C
from ..functions import dates as D
from ..functions import hashing as H
from ..functions import labels as L
from ..functions import probs as P
from ..functions import text as T
from ..operators.schema import resolve_columns, resolve_ids
from .fragments import BASE, CODES, COMPONENT, DATE, IDENT, ITEMS, NORM, REFERENCES, UNIFORM
from .registry import columns, query, table

T1, T2 = "2016-09-25", "2017-05-13"
_LOWERLESS = r"trim(regexp_replace(coalesce({0}, ''), '[\s\p{{Z}}\x0b\x{{85}}]+', ' ', 'g'))"

columns("f01_normalize_text", "train", "_row_id", {"value": (lambda: T.normalize_text("text_b"), NORM.format("text_b"))})
columns("f02_normalize_null_word", "test", "_row_id", {"value": (lambda: T.normalize_text("text_b", null="nan"), f"CASE WHEN text_b IS NULL THEN 'nan' ELSE {NORM.format('text_b')} END")})
columns("f03_collapse_blanks", "test", "_row_id", {"value": (lambda: T.normalize_text("text_b", lower=False), _LOWERLESS.format("text_b"))})
columns("f04_normalize_id", "train", "_row_id", {"application": (lambda: T.normalize_id("patent_application_id"), IDENT.format("patent_application_id")), "document": (lambda: T.normalize_id("cited_document_id"), IDENT.format("cited_document_id"))})
columns("f05_base_id", "train", "_row_id", {"application": (lambda: F.coalesce(T.base_id("patent_application_id"), F.lit("")), BASE.format("patent_application_id")), "document": (lambda: F.coalesce(T.base_id("cited_document_id"), F.lit("")), BASE.format("cited_document_id"))})
columns("f07_component", "train", "_row_id", {c: (lambda c=c: T.component(c), COMPONENT.format(c)) for c in ("_component_id", "_supercomponent_id", "_priority_component_id")})
columns("f08_parse_date", "train", "_row_id", {"day": (lambda: D.parse_date("date"), DATE.format("date")), "own_day": (lambda: D.parse_date("_date"), DATE.format("_date"))})
columns("f09_strict_date", "train", "_row_id", {"day": (lambda: D.strict_date(F.date_format("_parsed_date", "yyyyMMdd")), "_parsed_date::DATE")})
_DATE_COLUMNS = ["_date", "_parsed_date", "date"]
_DAYS = [DATE.format("_date"), "_parsed_date::DATE", DATE.format("date")]
columns("f10_choose_target_date", "train", "_row_id", {"target_date": (lambda: D.choose_date(_DATE_COLUMNS)[0], f"coalesce({', '.join(_DAYS)})"), "target_source": (lambda: D.choose_date(_DATE_COLUMNS)[1], "CASE " + " ".join(f"WHEN {d} IS NOT NULL THEN '{c}'" for c, d in zip(_DATE_COLUMNS, _DAYS)) + " END")})
columns("f12_parse_collection", "doc_metadata", "row_pos", {"items": (lambda: C.parse_collection("cpc_subclasses"), ITEMS.format("cpc_subclasses"))})
columns("f13_parse_codes", "doc_metadata", "row_pos", {"codes": (lambda: C.parse_codes("cpc_subclasses"), CODES.format("cpc_subclasses"))})
columns("f14_parse_references", "doc_metadata", "row_pos", {"refs": (lambda: C.parse_references("reference_bases"), REFERENCES.format("reference_bases"))})
columns("f15_label_decode", "train", "_row_id", {"from_number": (lambda: L.decode_label("label"), "label::INT"), "from_name": (lambda: L.decode_label("label_name", strict=False), "CASE lower(trim(label_name)) WHEN 'a' THEN 0 WHEN 'x' THEN 1 WHEN 'u' THEN 2 END")})
columns("f16_binary_label", "train", "_row_id", {"cited": (lambda: L.cited("label_name", strict=False), "CASE WHEN lower(trim(label_name)) IN ('a', 'x') THEN 1 WHEN lower(trim(label_name)) = 'u' THEN 0 END")})
columns("f16_cited_type", "predictions_long", "prediction_row_id", {"cited": (lambda: L.cited_type("candidate_type"), "CASE WHEN candidate_type IN ('hard_u', 'random_u') THEN 0 ELSE 1 END")})
columns("f18_parse_bool", "doc_metadata", "row_pos", {"same": (lambda: L.parse_bool(F.when(F.col("status") == "ok", "Yes ").otherwise(F.col("status"))), "coalesce(status = 'ok', false)")})
columns("f19_hashes", "train", "_row_id", {"sha": (lambda: H.sha256_text(T.normalize_text("text_b")), f"sha256({NORM.format('text_b')})"), "pair": (lambda: H.pair_hash(T.normalize_text("text"), T.normalize_text("text_b")), f"sha1(sha1({NORM.format('text')}) || '|' || sha1({NORM.format('text_b')}))")})



def _u(k: int | None = None):
    """Fixture scores of a row: three numbers from a hash, or one of them."""
    made = [H.uniform("_row_id", F.lit(13), F.lit(i)) for i in range(3)]
    return made if k is None else made[k]


def _l() -> list:
    return [c * 4.0 - 2.0 for c in _u()]


def _caps():
    words = [F.size(F.split(T.normalize_text(c), " ")) for c in ("text", "text_b")]
    return T.balanced_caps(*words, 128)


_LS = [f"({UNIFORM.format(f'_row_id || {chr(39)}|13|{k}{chr(39)}')} * 4.0::DOUBLE - 2.0::DOUBLE)" for k in range(3)]
_US = [UNIFORM.format(f"_row_id || '|13|{k}'") for k in range(3)]
_SUM = "(" + " + ".join(f"exp({x})" for x in _LS) + ")"
columns("f21_softmax", "test", "_row_id", {f"p{k}": (lambda k=k: F.round(P.softmax(_l())[k], 6), f"round(exp({_LS[k]}) / {_SUM}, 6)") for k in range(3)})
columns("f22_sigmoid", "test", "_row_id", {"p": (lambda: F.round(P.sigmoid(_l()[0]), 6), f"round(1.0 / (1.0 + exp(-{_LS[0]})), 6)"), "negated": (lambda: F.round(P.two_logits(_l()[0])[0], 6), f"round(-{_LS[0]}, 6)")})
columns("f23_hierarchical", "test", "_row_id", {"p_a": (lambda: F.round(P.hierarchical(_u(0), _u(1))[0], 6), f"round({_US[0]} * (1 - {_US[1]}), 6)"), "p_x": (lambda: F.round(P.hierarchical(_u(0), _u(1))[1], 6), f"round({_US[0]} * {_US[1]}, 6)"), "p_u": (lambda: F.round(P.hierarchical(_u(0), _u(1))[2], 6), f"round(1 - {_US[0]}, 6)")})
columns("f24_renormalize", "test", "_row_id", {f"p{k}": (lambda k=k: F.round(P.renormalized(_u())[k], 6), f"round({_US[k]} / greatest({' + '.join(_US)}, 1e-12), 6)") for k in range(3)})
columns("f25_scores", "test", "_row_id", {"cited": (lambda: F.round(P.cited_score(_u(0), _u(1)), 6), f"round({_US[0]} + {_US[1]}, 6)"), "x": (lambda: F.round(P.x_score(_u(0), _u(1)), 6), f"round({_US[1]} / ({_US[0]} + {_US[1]} + 1e-12), 6)"), "graded": (lambda: F.round(P.graded_score(_u(0), _u(1)), 6), f"round({_US[0]} + 2 * {_US[1]}, 6)")})
columns("f26_argmax", "test", "_row_id", {"predicted": (lambda: P.argmax_class(_u()), f"CASE WHEN {_US[0]} >= greatest({_US[1]}, {_US[2]}) THEN 0 WHEN {_US[1]} >= {_US[2]} THEN 1 ELSE 2 END")})
columns("f27_threshold", "test", "_row_id", {"predicted": (lambda: P.at_least(_u(0)), f"({_US[0]} >= 0.5)::INT")})
columns("f28_relevance", "test", "_row_id", {"grade": (lambda: P.relevance("label"), "CASE label WHEN 1 THEN 2 WHEN 0 THEN 1 ELSE 0 END")})
columns("f29_date_split", "train", "_row_id", {"split": (lambda: D.date_split(D.parse_date("_date"), T1, T2), f"CASE WHEN {DATE.format('_date')} <= DATE '{T1}' THEN 'train' WHEN {DATE.format('_date')} <= DATE '{T2}' THEN 'validation' WHEN {DATE.format('_date')} IS NOT NULL THEN 'test' END")})
columns("f30_days_since", "test", "_row_id", {"days": (lambda: D.days_since(D.parse_date("_date"), T1), f"date_diff('day', DATE '{T1}', {DATE.format('_date')})::INT")})
columns("f31_ordinal_id", "doc_metadata", "row_pos", {"name": (lambda: F.format_string("doc_%06d", F.col("row_pos")), "printf('doc_%06d', row_pos)")})
columns("f32_join_sorted", "doc_metadata", "row_pos", {"codes": (lambda: C.join_sorted(C.parse_codes("cpc_subclasses")), f"array_to_string({CODES.format('cpc_subclasses')}, '|')")})
_q, _d = (f"len(string_split({NORM.format(c)}, ' '))" for c in ("text", "text_b"))
columns(
    "f33_balanced_truncation",
    "test",
    "_row_id",
    {
        "query_words": (lambda: _caps()[0], f"(CASE WHEN {_q} + {_d} <= 128 THEN {_q} WHEN {_d} < 64 THEN 128 - {_d} WHEN {_q} < 64 THEN {_q} ELSE 64 END)::INT"),
        "passage_words": (lambda: _caps()[1], f"(CASE WHEN {_q} + {_d} <= 128 THEN {_d} WHEN {_d} < 64 THEN {_d} WHEN {_q} < 64 THEN 128 - {_q} ELSE 64 END)::INT"),
    },
)
columns("f34_clip_words", "test", "_row_id", {"value": (lambda: T.clip_words("text", 32), f"array_to_string(string_split({_LOWERLESS.format('text')}, ' ')[1:32], ' ')")})
columns("f35_prompt", "test", "_row_id", {"value": (lambda: T.prompt("text", "text_b", "Claim: %s\nPassage: %s\nAnswer:"), "'Claim: ' || text || chr(10) || 'Passage: ' || coalesce(text_b, '') || chr(10) || 'Answer:'")})
columns("f36_filters", "test", "_row_id", {"label": (lambda: F.col("label"), "label")}, "text_b IS NOT NULL AND text_b <> '' AND label IN (0, 1)")
columns("f37_close", "test", "_row_id", {"same": (lambda: P.close(_u(0), _u(1), 0.05), f"abs({_US[0]} - {_US[1]}) <= 0.05")})


@query(f"""WITH m AS (SELECT {BASE.format('input_id')} AS base, {IDENT.format('input_id')} AS alias, coalesce(nullif({BASE.format('base_id')}, ''), {BASE.format('input_id')}) AS target, row_pos FROM doc_metadata),
    a AS (SELECT alias, arg_max(target, row_pos) AS target FROM (SELECT alias, target, row_pos FROM m UNION ALL SELECT base, target, row_pos FROM m) GROUP BY alias)
    SELECT _row_id, coalesce(x.target, y.target, {BASE.format('cited_document_id')}) AS document FROM test t
    LEFT JOIN a x ON x.alias = {IDENT.format('t.cited_document_id')} LEFT JOIN a y ON y.alias = {BASE.format('t.cited_document_id')}""")
def f06_resolve_base(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by their alias, else by the alias of their base form, else their base form."""
    out = resolve_ids(table(spark, folder, "test"), "cited_document_id", table(spark, folder, "doc_metadata"), "input_id", "base_id", "row_pos", "document")
    return out.select("_row_id", "document")


@query(f"SELECT _row_id, {DATE.format('date')} AS day, 'date' AS source FROM test")
def f11_first_date_column(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "test")
    name = D.first_date_column(df.columns)
    return df.select("_row_id", D.parse_date(name).alias("day"), F.lit(name).alias("source"))


@query("SELECT source_row_id AS row_id, query_id AS query, cited_probability AS score FROM predictions_long")
def f17_column_aliases(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "predictions_long")
    found = resolve_columns(df, {"row_id": ["row_id", "Source Row-ID"], "query": ["query", "queryid", "query_id"], "score": ["probability", "Cited Probability"]})
    return df.select(*[F.col(c).alias(n) for n, c in found.items()])


@query()
def f20_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return H.fingerprint(table(spark, folder, "test"), ["text", "text_b", "label"], "_row_id")


@query("SELECT label, _row_id AS source_row_id, text AS query_text FROM test")
def f38_rename_drop(spark: SparkSession, folder: str) -> DataFrame:
    renamed = table(spark, folder, "test").withColumnsRenamed({"_row_id": "source_row_id", "text": "query_text"})
    return renamed.drop(*[c for c in renamed.columns if c.startswith("_")]).select("label", "source_row_id", "query_text")
