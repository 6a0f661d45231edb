import pytest

from shelfmark.plans import registry as catalog


@pytest.mark.parametrize("ids", [(10, 50), (60, 61), (70, 80)])
def test_fresh_sets_whatever_the_greatest_id_that_was_there(spark, tmp_path, ids):
    """The greatest set that is there may lie far below 60, or there is none: new ids begin right above it."""
    customers = [(ids[0], "a", 1), (ids[1], "b", 2), (100, "c", 2), (101, "c", 4), (102, "d", 3), (103, "a", 1)]
    spark.createDataFrame(customers, "c_custkey long, c_mktsegment string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = {(r["name"], r["studio"]): r["fresh"] for r in catalog.queries()["create_sets"](spark, str(tmp_path)).collect()}
    assert got == {("a", "n1"): ids[0] > 60, ("b", None): ids[1] > 60, ("c", None): True, ("d", "n3"): True}
