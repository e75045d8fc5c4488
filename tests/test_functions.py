"""Hand-made cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from pairlab.functions import collections as C
from pairlab.functions import dates as D
from pairlab.functions import hashing as H
from pairlab.functions import labels as L
from pairlab.functions import probs as P
from pairlab.functions import text as T


def values(spark, column, *texts, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_normalize_text(spark):
    assert values(spark, T.normalize_text("c"), "A B \t\n c D ", None, "") == ["a b c d", "", ""]
    assert values(spark, T.normalize_text("c", lower=False, null="nan"), " A  B", None) == ["A B", "nan"]


def test_ids(spark):
    assert values(spark, T.base_id("c"), "ep1234b1", "EP 12-34 A", "US99", "foo1", None, "EP12B12") == ["EP1234", "EP1234", "US99", "FOO1", None, "EP12B12"]
    assert values(spark, T.normalize_id("c"), " ep/1.a ", None) == ["EP1A", ""]
    assert values(spark, T.component("c"), " pr1\t", " NaN ", "", None, "none") == ["pr1", None, None, None, None]


def test_dates(spark):
    got = values(spark, D.parse_date("c"), "20111229", "2011-12-29", "08 Feb 2011", "2011-12-29T10:00:00Z", "0000-00-00", "n/a", None, "2011-13-01", "201112")
    assert [str(x) if x else None for x in got] == ["2011-12-29", "2011-12-29", "2011-02-08", "2011-12-29", None, None, None, None, None]
    assert values(spark, D.date_split(D.parse_date("c"), "2016-09-25", "2017-05-13"), "2016-09-25", "2017-05-13", "2018-01-01", "x") == ["train", "validation", "test", None]
    with pytest.raises(Exception, match="unreadable date"):
        values(spark, D.strict_date("c"), "n/a")


def test_collections(spark):
    assert values(spark, C.parse_collection("c"), "['B60W', 'B41J']", "a;b,, c|a", "[]", None, "nan", "{'x'}", "('x',)") == [["B41J", "B60W"], ["a", "b", "c"], [], [], [], ["x"], ["x"]]
    assert values(spark, C.parse_codes("c"), "F16K 6/19", "['b41j 2/00', 'ZZ']") == [["6/19", "F16K"], ["B41J", "ZZ"]]
    assert values(spark, C.parse_references("c"), "['EP00744712B1', 'ep-00744712']") == [["EP00744712"]]


def test_labels(spark):
    assert values(spark, L.decode_label("c"), "A", " x", "2") == [0, 1, 2]
    assert values(spark, L.decode_label("c", strict=False), "z", None) == [None, None]
    with pytest.raises(Exception, match="unknown label"):
        values(spark, L.decode_label("c"), "z")
    assert values(spark, L.cited("c"), "Cited", "hard_u", "A") == [1, 0, 1]
    assert values(spark, L.cited_type("c"), "Cited", "Dense_Hard_U ", "other", None) == [1, 0, 1, 1]
    assert values(spark, L.parse_bool("c"), "TRUE ", "y", "no", None) == [True, True, False, False]


def test_choice(spark):
    assert values(spark, H.choice(F.lit(107), F.lit("42"), F.lit("test"), F.lit("EP123"), F.col("c")), "a method") == [16]
    assert values(spark, H.choice(F.lit(0), F.col("c")), "x") == [None]


def test_balanced_caps(spark):
    df = spark.createDataFrame([(10, 10), (200, 10), (10, 200), (200, 200)], "a int, b int")
    q, d = T.balanced_caps(F.col("a"), F.col("b"), 101)
    assert [tuple(r) for r in df.select(q, d).collect()] == [(10, 10), (91, 10), (10, 91), (50, 51)]


def test_probabilities(spark):
    df = spark.createDataFrame([(0.2, 0.2, 0.1)], "a double, b double, c double")
    assert df.select(P.argmax_class(["a", "b", "c"])).first()[0] == 0
    assert [round(x, 9) for x in df.select(*P.renormalized(["a", "b", "c"])).first()] == [0.4, 0.4, 0.2]
    assert abs(sum(df.select(*P.softmax(["a", "b", "c"])).first()) - 1) < 1e-12
    assert df.select(*P.renormalized([F.lit(float("nan")), "b", "c"])).first()[0] is None


def test_fingerprint(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, t string")
    one = lambda df: df.first().fingerprint
    assert one(H.fingerprint(a.repartition(3), ["t"], "i")) == one(H.fingerprint(a.coalesce(1), ["t"], "i"))
    assert one(H.fingerprint(a, ["t"], "i")) != one(H.fingerprint(a.fillna(""), ["t"], "i"))
    assert H.fingerprint(a.limit(0), ["t"], "i").first().rows == 0
