"""Components and shared values over all three splits, by hand and against union-find."""

import duckdb
from pairlab.queries import QUERIES

SPLITS = ("train", "validation", "test")

def tied(rows):
    """Union-find: (node, least node of its component)."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for ids in rows:
        for x in ids:
            a, b = find(ids[0]), find(x)
            root[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(root)}


IDS = {"document": "cited_document_id", "application": "patent_application_id", "component_id": "_component_id", "supercomponent_id": "_supercomponent_id", "priority_component_id": "_priority_component_id"}


def test_components_tie_splits(spark, tmp_path):
    """A document of many train rows, a test row tied to it by a validation row, an uncited row, and a row with one id."""
    rows = {
        "train": [(f"EP{i}", "US1", 0, None, None, None) for i in range(30)] + [("EP90", "US90", 2, None, None, None), (None, "US91", 1, "", " ", None)],
        "validation": [("EP5", "US2", 0, None, None, None), ("EP40", "US3", 1, "c1", None, None)],
        "test": [("EP41", "US2", 0, None, "s1", "p1"), ("EP42", "US4", 2, "c1", None, None), ("EP43", "US5", 1, None, None, "p1")],
    }
    for name, r in rows.items():
        spark.createDataFrame(r, "patent_application_id string, cited_document_id string, label int, _component_id string, _supercomponent_id string, _priority_component_id string").write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.node, r.component) for r in QUERIES["g20_components"](spark, str(tmp_path)).collect()}
    names = ("application|", "document|", None, "component_id|", "supercomponent_id|", "priority_component_id|")
    assert got == tied([[n + x.strip() for n, x in zip(names, r) if n and x and x.strip()] for rs in rows.values() for r in rs])
    of = dict(got)
    assert of["document|US1"] == of["application|EP41"] == of["document|US5"] and of["document|US3"] == of["document|US4"] != of["document|US1"]


def test_components_of_smallest_tables(spark, sf):
    from pairlab.queries.composites import _REL

    con = duckdb.connect()
    some = ", ".join(f"CASE WHEN {_REL[n]} <> '' THEN '{n}|' || {_REL[n]} END" for n in IDS)
    rows = [r for s in SPLITS for r in con.execute(f"SELECT {some} FROM read_parquet('{sf}/{s}.parquet')").fetchall()]
    got = [(r.node, r.component) for r in QUERIES["g20_components"](spark, sf).collect()]
    expected = tied([ids for r in rows if (ids := [x for x in r if x is not None])])
    assert set(got) == expected and len(got) == len(expected)


def test_random_rows_are_compared_with_all_splits_by_candidate(spark, tmp_path):
    row = "text string, text_b string, cited_document_id string"
    for name in SPLITS:
        spark.createDataFrame([(f"q {name}", f"p {name}", f"US1{len(name)}")] + [("q both", "p v", "EP7A1")] * (name == "validation"), row).write.parquet(f"{tmp_path}/{name}.parquet")
    # The candidate is an alias of validation's document; the cited document is another one.
    spark.createDataFrame([("Q both", "p r", "XX9", "WO8")], row + ", _u_candidate_base string").write.parquet(f"{tmp_path}/generate_random_u.parquet")
    spark.createDataFrame([("WO8", "EP7", 1)], "input_id string, base_id string, row_pos long").write.parquet(f"{tmp_path}/doc_metadata.parquet")
    got = {(r["relation"], r["first"], r["second"], r["shared"]) for r in QUERIES["g08_cross_split_random"](spark, str(tmp_path)).collect()}
    assert got == {("query", "random", "validation", 1), ("document", "random", "validation", 1)}
