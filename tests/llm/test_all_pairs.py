from riskloom.llm.queries import QUERIES, SQL
from tests.differential import compare, duck


def test_pairs_with_one_common_commit_are_kept(spark, tmp_path):
    rows = [("an", "c1", "a"), ("an", "C1 ", "b"), ("an", "c2", "a"), ("an", "c2", "b"), ("an", "c2", "c"), ("an", "c3", "d"), ("an", "c3", None), ("an", None, "e")]
    spark.createDataFrame(rows, "analysis_id string, commit_hash string, file_path string").write.parquet(f"{tmp_path}/process_file_changes.parquet")
    got = {(r.file_a, r.file_b): (r.n_ab, r.lift) for r in QUERIES["p1_all_pairs"](spark, str(tmp_path)).collect()}
    assert got == {("a", "b"): (2, 1.5), ("a", "c"): (1, 1.5), ("b", "c"): (1, 1.5)}


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    ours, theirs, only_ours, only_theirs = compare(spark, duck(folder), folder, QUERIES["p1_all_pairs"], SQL["p1_all_pairs"])
    assert not only_ours and not only_theirs and ours == theirs > 0
