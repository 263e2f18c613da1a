"""Sources, sinks, the ledger and its stream."""

import json

from gaugeline.sources import io
from gaugeline.streaming import ledger


def test_positional_and_nested(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"fields": ["i", "cat", "h"], "rows": [[0, 1, 0.5], [1, 0, 0.25]], "cats": [{"name": "mug"}, {"name": "jug"}]}))
    got = io.read_positional(spark, str(tmp_path / "p.json")).orderBy("i").collect()
    assert [(r["category"], r["h"]) for r in got] == [("jug", 0.5), ("mug", 0.25)]
    (tmp_path / "n.json").write_text(json.dumps({"summary": 1, "episodes": [{"a": 1}, {"a": 2}]}))
    assert io.read_nested(spark, str(tmp_path / "n.json")).count() == 2


def test_coerced_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2.5\nx,NaN\n")
    assert [tuple(r) for r in io.read_csv_coerced(spark, str(tmp_path / "x.csv"), "a int, b double").collect()] == [(1, 2.5), (None, None)]


def test_episode_files_and_subset(spark, tmp_path):
    for e in (3, 7):
        spark.range(2).selectExpr("id as frame_index").write.parquet(str(tmp_path / f"episode_{e:06d}"))
    df = io.read_episode_files(spark, str(tmp_path))
    assert {r["episode"] for r in df.select("episode").distinct().collect()} == {3, 7}
    chosen = spark.createDataFrame([(7, 0), (3, 1), (7, 2)], "episode_index long, position int")
    out = io.subset(df.withColumnRenamed("episode", "episode_index"), chosen).orderBy("index").collect()
    assert [(r["episode_index"], r["index"]) for r in out] == [(0, 0), (0, 1), (1, 2), (1, 3)]


def test_ledger_resumes(spark, tmp_path):
    path = str(tmp_path / "led")
    ledger.append_new(spark.range(5), path, ["id"])
    ledger.append_new(spark.range(3, 8), path, ["id"])
    assert spark.read.parquet(path).count() == 8
    spark.range(12).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    for c in ("c1", "c2"):  # a second run replays everything and adds nothing
        q = ledger.stream_to_ledger(stream, path, str(tmp_path / c), ["id"])
        q.awaitTermination()
    assert spark.read.parquet(path).count() == 12


def test_stable_schema(spark):
    out = io.stable(spark.createDataFrame([("p1", "ok")], "pull_id string, status string"), io.PULLS)
    assert out.columns == io.PULLS.names and out.first()["delta"] is None


def test_jsonl_and_runs(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r["a"] for r in io.read_jsonl(spark, str(tmp_path / "e.jsonl"), "a int").collect()) == [1, 2]
    for name, j in (("N10_seed1", 0.5), ("N40_seed2", 0.75), ("other", 1.0)):
        (tmp_path / "out" / name).mkdir(parents=True)
        (tmp_path / "out" / name / "fixed.json").write_text(json.dumps({"J": j}))
    got = io.read_runs(spark, str(tmp_path / "out"), "fixed.json", r"N(\d+)_seed(\d+)", ["N", "seed"], "J double")
    assert sorted(map(tuple, got.collect())) == [("10", "1", 0.5), ("40", "2", 0.75)]


def test_results_of_two_formats(spark, tmp_path):
    root = tmp_path / "evals"
    for where, doc in (("a/x/eval_log.json", {"success_rate/lift": 0.5, "test/sim_max_reward_1": 1, "test/sim_max_reward_2": 0}), ("b/stack/t1/stats.json", {"success_rate": 0.25, "num_episodes": 8}), ("c/eval_log.json", {"z": 1})):
        (root / where).parent.mkdir(parents=True)
        (root / where).write_text(json.dumps(doc))
    got = sorted(map(tuple, io.discover_results(spark, str(root)).collect()))
    assert got == [("a", "dp", "lift", 0.5, 2), ("b", "pi0", "stack", 0.25, 8), ("c", "dp", "?", None, 0)]


def test_small_sinks(spark, tmp_path):
    path = str(tmp_path / "x.json")
    for value in ({"a": 1}, {"a": [1, 2]}):
        io.write_json_atomic(spark, value, path)
        assert json.loads(open(path).read()) == value
    assert not (tmp_path / "x.json.tmp").exists()
    frames = spark.createDataFrame([(i, i * 10) for i in range(5)], "episode_index int, v int")
    io.write_first_episodes(frames, 3, str(tmp_path / "f"))
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "f")).select("episode_index").collect()) == [0, 1, 2]
    assert io.markdown(spark.createDataFrame([(1, 0.5, "a|b"), (2, None, None)], "k int, r double, s string")) == "| k | r | s |\n| --- | --- | --- |\n| 1 | 0.5000 | a\\|b |\n| 2 |  |  |"
