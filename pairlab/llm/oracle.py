"""The same results in SQL, by plain definitions; for small tables."""

from __future__ import annotations

from ..queries.fragments import DATE

_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_BASE = "regexp_replace(regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g'), '^([A-Z]{{2}}[0-9]+)[A-Z][0-9]?$', '\\1')"
_KEY = r"array_to_string(list_sort(list_filter(list_transform(string_split(lower({0}), '|'), lambda p: regexp_replace(p, '[^\p{{L}}\p{{N}}]+', '', 'g')), lambda p: p <> '')), '|')"


def _grams(words: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, len({words}) - {n - 2}), lambda i: array_to_string({words}[i:i + {n - 1}], ' ')))"


_TIES = f"""
rows AS (
  SELECT _row_id AS r, {_BASE.format("patent_application_id")} AS a, {_BASE.format("cited_document_id")} AS d, trim(_u_target_component) AS c FROM test
  UNION ALL
  SELECT _row_id, {_BASE.format("patent_application_id")}, {_BASE.format("cited_document_id")}, trim(_u_target_component) FROM generate_random_u),
keys AS (
  SELECT r, 'a:' || a AS k FROM rows WHERE a <> '' UNION SELECT r, 'd:' || d FROM rows WHERE d <> ''
  UNION SELECT r, 'c:' || c FROM rows WHERE lower(c) NOT IN ('', 'nan', 'none', 'null')),
links AS (SELECT DISTINCT x.r AS a, y.r AS b FROM keys x JOIN keys y ON x.k = y.k),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
"""


def _copies(table: str, passage: str) -> str:
    return f"SELECT '{table}' AS source, _row_id AS r, {_KEY.format('text')} AS a, {_KEY.format(passage)} AS b FROM {table}"


_COPIES = f"WITH k AS ({_copies('test', 'text_b')} UNION ALL {_copies('generate_random_u', '_normalized_passage')}), k2 AS (SELECT * FROM k WHERE a <> '' AND b <> '')"


def _texts(table: str, field: str, id_col: str) -> str:
    words = _WORDS.format(field)
    return f"SELECT DISTINCT '{field}' AS field, {id_col} AS id, {words} AS w FROM {table} WHERE {field} <> '' AND {id_col} IS NOT NULL"


def _shingled(name: str, tables: tuple[str, ...]) -> str:
    parts = " UNION ".join(_texts(t, f, i) for t in tables for f, i in (("text", "claim_id"), ("text_b", "_row_id")))
    return f"{name}_t AS ({parts}), {name}_s AS (SELECT field, id, w, {_grams('w', 3)} AS s FROM {name}_t WHERE len(w) >= 3), {name}_u AS (SELECT field, id, w, len(s) AS n, unnest(s) AS g FROM {name}_s)"


_P5 = """
WITH units AS (SELECT {unit} AS unit, CASE WHEN count(_loaded_at) = count(*) THEN min(_loaded_at) END AS arrived FROM test WHERE {unit} <> '' GROUP BY 1),
numbered AS (SELECT unit, row_number() OVER (ORDER BY arrived NULLS FIRST, md5(unit), unit) - 1 AS seq FROM units),
r0 AS (SELECT unit, seq, seq // 1024 AS blk, (seq % 1024) // 32 AS a, seq % 32 AS b FROM numbered)
"""
for _r in range(6):
    _P5 += f", r{_r + 1} AS (SELECT unit, seq, blk, b AS a, (a + ('0x' || substr(md5('7|' || blk || '|{_r}|' || b), 1, 8))::UBIGINT::BIGINT) % 32 AS b FROM r{_r})\n"
_P5 += ", chosen AS (SELECT unit, seq FROM r6 WHERE a * 32 + b < 128)\n"

_DAY = f"coalesce({DATE.format('_date')}, _parsed_date::DATE)"
#: Groups above half the smallest split one after another, each to the split with the most room; the others by running totals.
_SPLITS = f"""WITH RECURSIVE {_TIES}, tied AS (SELECT a AS row_id, min(b) AS g FROM reach GROUP BY a UNION SELECT r, r FROM rows WHERE r IS NOT NULL AND r NOT IN (SELECT a FROM reach)),
day AS (SELECT _row_id AS row_id, min(date_diff('day', DATE '1970-01-01', {_DAY})) AS d FROM (SELECT _row_id, _date, _parsed_date FROM test UNION ALL SELECT _row_id, _date, _parsed_date FROM generate_random_u) GROUP BY 1),
per AS (SELECT g, count(*) AS n, floor(avg(d)) AS d FROM tied JOIN day USING (row_id) GROUP BY g), every AS (SELECT sum(n)::DOUBLE AS n FROM per),
big AS (SELECT g, n, row_number() OVER (ORDER BY n DESC, g) AS k FROM per WHERE n > (SELECT n FROM every) * 0.1::DOUBLE / 2),
room(k, g, split, t, v, e) AS (SELECT 0, NULL::VARCHAR, NULL::VARCHAR, 0.8::DOUBLE * n, 0.1::DOUBLE * n, 0.1::DOUBLE * n FROM every
  UNION ALL SELECT big.k, big.g, CASE WHEN t >= greatest(v, e) THEN 'train' WHEN v >= e THEN 'validation' ELSE 'test' END,
    CASE WHEN t >= greatest(v, e) THEN t - n ELSE t END, CASE WHEN t < greatest(v, e) AND v >= e THEN v - n ELSE v END, CASE WHEN t < greatest(v, e) AND v < e THEN e - n ELSE e END FROM room JOIN big ON big.k = room.k + 1),
free AS (SELECT greatest(0, t) AS lt, greatest(0, v) AS lv, greatest(0, e) AS le, t + v + e AS all_ FROM room ORDER BY k DESC LIMIT 1),
edge AS (SELECT lv * all_ / (lt + lv + le) AS sv, (lt + lv + le) * (all_ / (lt + lv + le)) - le * (all_ / (lt + lv + le)) AS bv FROM free),
run AS (SELECT g, n, coalesce(sum(n) OVER (ORDER BY d IS NULL, d, md5(g), g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM per WHERE g NOT IN (SELECT g FROM big)),
chosen AS (SELECT g, CASE WHEN before + n / 2.0::DOUBLE <= bv - sv THEN 'train' WHEN before + n / 2.0::DOUBLE <= bv THEN 'validation' ELSE 'test' END AS split FROM run, edge UNION ALL SELECT g, split FROM room WHERE k > 0),
splits AS (SELECT row_id, g AS group_row_id, split FROM tied JOIN chosen USING (g))"""

def _groups(texts: str, n: int, least: float) -> str:
    """Groups of the ids of ``texts`` (field, id, t) whose texts are alike, through others too, and their links."""
    return f"""WITH RECURSIVE {texts},
w AS (SELECT field, t, {_WORDS.format('t')} AS w FROM (SELECT DISTINCT field, t FROM tx)), s AS (SELECT field, t, {_grams('w', n)} AS s FROM w WHERE len(w) >= {n}), u AS (SELECT field, t, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT p.field, p.t AS a, q.t AS b, count(*) AS s, any_value(p.n) + any_value(q.n) AS n FROM u p JOIN u q ON p.field = q.field AND p.g = q.g AND p.t <> q.t GROUP BY ALL),
near AS (SELECT field, a, b FROM c WHERE s >= {least} * (n - s) - 1e-9),
reach(field, a, b) AS (SELECT field, t, t FROM w UNION SELECT reach.field, reach.a, near.b FROM reach JOIN near ON reach.field = near.field AND reach.b = near.a),
comp AS (SELECT field, a AS t, min(b) AS c FROM reach GROUP BY ALL), links AS (SELECT field, a AS t, count(*) AS links FROM near GROUP BY ALL),
named AS (SELECT field, id, c, coalesce(links, 0) AS links FROM tx JOIN comp USING (field, t) LEFT JOIN links USING (field, t)), least_ AS (SELECT field, c, min(id) AS group_id FROM named GROUP BY ALL),
gr AS (SELECT field, id, min(group_id) AS group_id, sum(links)::BIGINT AS links FROM named JOIN least_ USING (field, c) GROUP BY field, id)"""


_GROUPS = _groups("tx AS (SELECT DISTINCT 'text' AS field, claim_id AS id, text AS t FROM test WHERE text <> '' AND claim_id IS NOT NULL UNION SELECT 'text_b', _row_id, text_b FROM test WHERE text_b <> '' AND _row_id IS NOT NULL)", 3, 0.6)
_PARAGRAPHS = _groups("""li AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text <> '' AND doc_id IS NOT NULL), pa AS (SELECT doc_id, p, unnest(range(len(p)))::INT AS paragraph FROM li),
pl AS (SELECT doc_id, paragraph, doc_id || ':' || paragraph AS id, p[paragraph + 1] AS t, coalesce(list_sum(list_transform(p[1:paragraph], lambda x: length(x) + 1)), 0)::BIGINT AS start_char FROM pa WHERE p[paragraph + 1] <> ''),
tx AS (SELECT DISTINCT 'text' AS field, id, t FROM pl)""", 5, 0.8)

#: Pairs with the stretches of words that both texts have, extendable on neither side.
_SPANS = f"""WITH {_shingled('x', ('test', 'validation'))}, {_shingled('y', ('train',))},
c AS (SELECT p.field, p.id AS eval_id, p.w AS wa, q.id AS train_id, q.w AS wb, count(*) AS s, any_value(p.n) + any_value(q.n) AS n FROM x_u p JOIN y_u q ON p.field = q.field AND p.g = q.g GROUP BY ALL),
pr AS (SELECT *, row_number() OVER () AS k FROM c WHERE s >= 0.7 * (n - s) - 1e-9),
i AS (SELECT k, unnest(wa) AS word, generate_subscripts(wa, 1) AS i FROM pr), j AS (SELECT k, unnest(wb) AS word, generate_subscripts(wb, 1) - 1 AS j FROM pr),
ru AS (SELECT k, min(j) AS lo, max(j) + 1 AS hi FROM (SELECT k, i - j AS diagonal, j, j - row_number() OVER (PARTITION BY k, i - j ORDER BY j) AS run FROM i JOIN j USING (k, word)) GROUP BY k, diagonal, run),
lo AS (SELECT k, lo, hi, CASE WHEN lo >= max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM ru WHERE hi - lo >= 8),
me AS (SELECT k, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS part FROM lo) GROUP BY k, part),
told AS (SELECT k, max(hi - lo)::INT AS longest_span FROM ru GROUP BY k), sp AS (SELECT k, sum(hi - lo)::INT AS span_words, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS spans FROM me GROUP BY k),
res AS (SELECT DISTINCT field, eval_id, train_id, round(s::DOUBLE / (n - s), 6) AS similarity, longest_span, coalesce(span_words, 0) AS span_words, coalesce(spans, '') AS spans FROM pr JOIN told USING (k) LEFT JOIN sp USING (k))"""

#: The words of a window that a mask looks at.
_SEED = "array_to_string(list_filter(list_transform(g, lambda x, i: CASE WHEN z = 1 OR (i - 1) % 4 <> m THEN x END), lambda x: x IS NOT NULL), ' ')"

SQL = {
    "p1_found": f"WITH RECURSIVE {_TIES} SELECT a AS row_id, min(b) AS group_row_id FROM reach GROUP BY a HAVING count(*) > 1",
    "p1_splits": f"{_SPLITS} SELECT * FROM splits",
    "p1_proportions": f"""{_SPLITS}, q AS (SELECT split, count(*) AS rows, count(DISTINCT group_row_id) AS groups FROM splits GROUP BY 1)
        SELECT split, coalesce(rows, 0) AS rows, coalesce(groups, 0) AS groups, round(coalesce(rows, 0) / (SELECT n FROM every), 6) AS share, wanted::DOUBLE AS wanted, 0::BIGINT AS torn FROM (VALUES ('train', 0.8), ('validation', 0.1), ('test', 0.1)) s(split, wanted) LEFT JOIN q USING (split)""",
    "p2_found": f"{_COPIES} SELECT r AS row_id, min(r) OVER (PARTITION BY source, a, b) AS kept_row_id FROM k2 QUALIFY count(*) OVER (PARTITION BY source, a, b) > 1",
    "p2_collapsed": f"{_COPIES} SELECT source, min(r) AS kept_row_id, count(*) AS copies FROM k2 GROUP BY source, a, b",
    "p3_found": f"""WITH {_shingled('x', ('test',))},
        c AS (SELECT p.field, p.id AS a, p.w AS wa, q.id AS b, q.w AS wb, count(*) AS s, any_value(p.n) + any_value(q.n) AS n
              FROM x_u p JOIN x_u q ON p.field = q.field AND p.g = q.g AND p.id < q.id GROUP BY ALL)
        SELECT DISTINCT field, a AS id_a, b AS id_b FROM c WHERE s >= 0.6 * (n - s) - 1e-9""",
    "p3_groups": f"{_GROUPS} SELECT * FROM gr",
    "p8_paragraphs": f"""{_PARAGRAPHS} SELECT doc_id, paragraph, start_char, start_char + length(t) AS end_char, group_id AS cluster_id, links, id <> group_id AS removed
        FROM gr JOIN pl USING (id) WHERE group_id IN (SELECT group_id FROM gr GROUP BY 1 HAVING count(*) > 1)""",
    "p4_spans": f"{_SPANS} SELECT * FROM res",
    "p4_report": f"""{_SPANS}, best AS (SELECT field, eval_id AS id, max(similarity) AS s, max(longest_span) AS longest, max(span_words) AS covered FROM res GROUP BY ALL),
        ids AS (SELECT DISTINCT split, coalesce({_BASE.format("cited_document_id")}, '') AS document, unnest(['text', 'text_b']) AS field, unnest([claim_id, _row_id]) AS id FROM (SELECT 'test' AS split, * FROM test UNION ALL SELECT 'validation', * FROM validation))
        SELECT split, document, count(*) FILTER (field = 'text' AND s = 1) AS claims_same, count(*) FILTER (field = 'text' AND s <> 1) AS claims_almost, count(*) FILTER (field = 'text_b' AND s = 1) AS passages_same, count(*) FILTER (field = 'text_b' AND s <> 1) AS passages_almost,
        max(longest) AS longest_span, sum(covered)::BIGINT AS span_words FROM ids JOIN best USING (field, id) GROUP BY ALL""",
    "p4_found": f"""WITH {_shingled('x', ('test', 'validation'))}, {_shingled('y', ('train',))},
        c AS (SELECT p.field, p.id AS a, p.w AS wa, q.id AS b, q.w AS wb, count(*) AS s, any_value(p.n) + any_value(q.n) AS n
              FROM x_u p JOIN y_u q ON p.field = q.field AND p.g = q.g AND p.id <> q.id GROUP BY ALL)
        SELECT DISTINCT field, least(a, b) AS id_a, greatest(a, b) AS id_b FROM c WHERE s >= 0.7 * (n - s) - 1e-9""",
    "p5_sample_rows": _P5.format(unit="_row_id") + "SELECT unit AS row_id, seq FROM chosen",
    "p5_sample_documents": _P5.format(unit=_BASE.format("cited_document_id")) + f"SELECT _row_id AS row_id, unit AS document, seq FROM test JOIN chosen ON unit = {_BASE.format('cited_document_id')}",
    "p6_audit": "SELECT count(*) AS items, count(*) AS rows, 0::BIGINT AS overfull, 0::BIGINT AS wrong_totals, 0::BIGINT AS gap, 0::BIGINT AS cut FROM documents WHERE text <> ''",
    "p7_found": f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text <> ''),
        i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM heldout_items WHERE text <> ''),
        iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS z, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda k: array_to_string(w[k:k + least(13, len(w)) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
        z AS (SELECT DISTINCT z FROM iw),
        dw AS (SELECT DISTINCT doc_id, z, unnest(list_transform(range(1, len(w) - z + 2), lambda k: array_to_string(w[k:k + z - 1], ' '))) AS g FROM d, z WHERE len(w) >= z)
        SELECT DISTINCT item_id, doc_id FROM iw JOIN dw USING (z, g)""",
    "p7_leaks": f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text <> ''),
        i AS (SELECT DISTINCT item_id, {_WORDS.format('text')} AS w FROM heldout_items WHERE text <> ''),
        iw AS (SELECT item_id, least(13, len(w)) AS z, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k, w FROM i WHERE len(w) > 0),
        im AS (SELECT item_id, z, w[k:k + z - 1] AS g, unnest(range(least(4, z))) AS m FROM iw),
        dw AS (SELECT doc_id, z, unnest(range(1, len(w) - z + 2)) AS k, w FROM d, (SELECT DISTINCT z FROM iw) WHERE len(w) >= z),
        dm AS (SELECT doc_id, z, k - 1 AS pos, w[k:k + z - 1] AS g, unnest(range(least(4, z))) AS m FROM dw),
        a AS (SELECT *, {_SEED} AS s FROM im), b AS (SELECT *, {_SEED} AS s FROM dm),
        h AS (SELECT DISTINCT item_id, doc_id, z, pos, len(list_filter(list_zip(a.g, b.g), lambda x: x[1] = x[2])) AS equal FROM a JOIN b USING (z, m, s)),
        q AS (SELECT item_id, doc_id, z, pos, max(equal) AS equal FROM h WHERE equal >= z - 1 GROUP BY ALL)
        SELECT item_id, doc_id, max(equal)::INT AS equal_words, max(z)::INT AS window_words, count(*)::INT AS windows, min(pos)::BIGINT AS first_word, (max(pos) + max(z) - 1)::BIGINT AS last_word FROM q GROUP BY item_id, doc_id""",
    "p8_found": """WITH d AS (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS p FROM documents WHERE length(text) >= 200),
        w AS (SELECT doc_id, p, hash(substring(text, p + 1, 200)) AS h1, md5(substring(text, p + 1, 200)) AS h2 FROM d),
        m AS (SELECT h1, h2 FROM w GROUP BY h1, h2 HAVING min(doc_id) < max(doc_id)),
        s AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS new FROM w JOIN m USING (h1, h2)),
        g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM s)
        SELECT doc_id, min(p) AS start_char, max(p) + 200 AS end_char FROM g GROUP BY doc_id, run""",
}
SQL["p8_share"] = f"""WITH sp AS ({SQL["p8_found"]}), k AS (SELECT doc_id, sum(end_char - start_char)::BIGINT AS shared FROM sp GROUP BY 1)
    SELECT d.doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(shared, 0) AS shared_chars, round(coalesce(shared, 0) / nullif(coalesce(length(text), 0), 0)::DOUBLE, 6) AS shared_share FROM documents d LEFT JOIN k USING (doc_id) WHERE d.doc_id IS NOT NULL"""
