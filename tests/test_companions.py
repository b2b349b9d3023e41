from riskloom.operators.process import co_changes_by_file


def test_a_hot_file_keeps_all_its_companions(spark):
    pairs = spark.createDataFrame([("an", "a", f"f{i:02}", 1 + i % 3) for i in range(40)], "analysis_id string, file_a string, file_b string, n long")
    rows = co_changes_by_file(pairs).where("file_path = 'a'").orderBy("place").collect()
    assert [r.place for r in rows] == list(range(1, 41)) and {r.with_file for r in rows} == {f"f{i:02}" for i in range(40)}
    assert [r.n for r in rows] == sorted((r.n for r in rows), reverse=True)
    assert co_changes_by_file(pairs, 5).where("file_path = 'a'").count() == 5
