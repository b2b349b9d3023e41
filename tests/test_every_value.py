from riskloom.plans.problems import QUERIES


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_fan_in_of_targets_that_are_no_node_or_loaded_twice(spark, tmp_path):
    write(spark, tmp_path, "dep_edges", [("an", "m", 3), ("an", "m", 5), ("an", "gone", 7), ("an", None, 1)], "analysis_id string, target_id string, line long")
    write(spark, tmp_path, "dep_nodes", [("an", "m"), ("an", "m"), ("an", "unused")], "analysis_id string, id string")
    got = {r.target_id: (r.fan_in, r.joined_rows, r.max_line) for r in QUERIES["p2_all_fan_in"](spark, str(tmp_path)).collect()}
    assert got == {"m": (2, 4, 5), "gone": (1, 0, 7), None: (1, 0, 1)}


def test_files_with_short_unknown_and_repeated_commits(spark, tmp_path):
    full = "a" * 12 + "0" * 28
    write(spark, tmp_path, "process_commits", [("an", full), ("an", full.upper()), ("an", None)], "analysis_id string, hash string")
    changes = [("an", full, "f", 10, 1), ("an", full[:10], "f", 5, None), ("an", "b" * 40, "f", 100, 2), ("an", None, "g", 7, 0), ("an", "b" * 40, "h", 1, 1)]
    write(spark, tmp_path, "process_file_changes", changes, "analysis_id string, commit_hash string, file_path string, lines_added long, lines_deleted long")
    got = {r.file_path: r for r in QUERIES["p2_all_file_results"](spark, str(tmp_path)).collect()}
    f, g = got["f"], got["g"]
    assert set(got) == {"f", "g", "h"} and (f.n_changes, f.joined_rows, f.sum_lines_added, f.sum_lines_deleted, f.max_lines_added) == (3, 2, 15, 1, 10)
    assert (f.all_sum_lines_added, f.all_sum_lines_deleted, f.all_max_lines_added) == (115, 3, 100)
    assert (g.n_changes, g.joined_rows, g.sum_lines_added, g.all_sum_lines_added) == (1, 0, None, 7)
