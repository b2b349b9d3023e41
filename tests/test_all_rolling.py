from riskloom.plans.problems import QUERIES

DAY = 86_400_000


def test_added_and_deleted_have_totals_of_their_own(spark, tmp_path):
    commits = [("an", "a" * 40, 0), ("an", "b" * 40, 8 * DAY)]
    spark.createDataFrame(commits, "analysis_id string, hash string, timestamp_ms long").write.parquet(f"{tmp_path}/process_commits.parquet")
    changes = [("an", "a" * 40, "f", 14, 7), ("an", "b" * 40, "f", 30, None), ("an", "b" * 40, "g", 5, 3)]
    spark.createDataFrame(changes, "analysis_id string, commit_hash string, file_path string, lines_added long, lines_deleted long").write.parquet(f"{tmp_path}/process_file_changes.parquet")
    got = {r.day: r for r in QUERIES["p6_all_rolling"](spark, str(tmp_path)).collect()}
    first, last = got["1970-01-01"], got["1970-01-09"]
    assert len(got) == 9 and (first.added_s7, first.added_avg7, first.deleted_s7, first.deleted_avg7, first.changed_s7) == (14, 2.0, 7, 1.0, 21)
    assert (last.added, last.added_s7, last.added_s30, last.deleted, last.deleted_s7, last.deleted_s30, last.changed_s30) == (35, 35, 49, 3, 3, 10, 59)
    assert last.added_avg30 == round(49 / 30, 6) and last.deleted_avg30 == round(10 / 30, 6)
