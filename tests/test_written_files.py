"""File queries over tables that are folders of part files, and the sort contract without a join of all rows."""

import shutil

from tracklens.plans import registry


def test_one_file_of_a_folder_is_altered_and_one_is_absent(spark, small, tmp_path):
    for table in ("orders", "part"):
        spark.read.parquet(f"{small}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    shutil.copy(f"{small}/nation.parquet", f"{tmp_path}/nation.parquet")
    found = sorted((r.problem, r.relative_path) for r in registry.queries()["src_10_verify_sources"](spark, str(tmp_path)).collect())
    assert [p for p, _ in found] == ["missing", "sha256"]
    assert found[0][1] == "gone.csv" and found[1][1].startswith("orders.parquet/")


def test_sort_contract_holds_and_joins_no_file_with_itself(spark, small):
    bad = registry.queries()["snk_02_sort_contract"](spark, small)
    assert bad.first()[0] == 0
    # The one join brings a row for each block of a file: its right side is an aggregate.
    plan = bad._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "LeftOuter" in plan
