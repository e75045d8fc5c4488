"""The intersection of three tables is one of whole keys."""

from pairlab.queries import QUERIES


def test_claims_with_a_common_start_are_not_shared(spark, tmp_path):
    spark.createDataFrame([("EP123_1", 0), ("EP123_1", 2), ("EP123_2", 1), ("EP123_3", 2), ("EP123_4", 0), ("EP123_4", 2)], "claim_id string, label int").write.parquet(f"{tmp_path}/test.parquet")
    spark.createDataFrame([("EP123_1",), ("EP123_1",), ("EP123_2",), ("EP123_3",)], "claim_id string").write.parquet(f"{tmp_path}/generate_random_u.parquet")
    assert [r.claim_id for r in QUERIES["o04_intersect3"](spark, str(tmp_path)).collect()] == ["EP123_1"]


def test_smallest_tables_share_claims(spark, sf):
    assert QUERIES["o04_intersect3"](spark, sf).count() > 0
