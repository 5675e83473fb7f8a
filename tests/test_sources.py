"""Rejects, several datasets from one scan, ordinals of lines, counts while writing, job order."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from forgeline import schemas
from forgeline.operators import ci, commits, ownership
from forgeline.plans import qa_pairs, runner
from forgeline.sources import fan_out, ordinals, rejects, tables
from tests.test_tables_runs import land, raw_issue

SMALL = "repo STRING, number BIGINT, tags ARRAY<STRING>"


def test_damaged_lines_are_kept_apart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = ['{"repo": "r", "number": 1, "tags": ["a"]}', '{"repo": "r", "num', "", '{"repo": "r", "number": "x"}',
             '{"number": 4}', '{"repo": "r", "number": 5, "other": {}}', "[1", '{"repo": "r", "number": 6, "tags": 7}']
    (folder / "1.json").write_text("\n".join(lines) + "\n")
    good, bad = rejects.read_with_rejects(spark, str(folder), SMALL, "things", ["repo", "number"])
    assert good.columns == ["repo", "number", "tags"]
    assert sorted(map(tuple, good.collect())) == [("r", 1, ["a"]), ("r", 5, None)]
    found = {(r.reason, r.record) for r in bad.collect()}
    assert {(a, b) for a, b in found if a != rejects.NO_KEY} == {
        (rejects.NOT_JSON, lines[1]), (rejects.WRONG_TYPE, lines[3]), (rejects.NOT_JSON, "[1"), (rejects.WRONG_TYPE, lines[7])
    }
    assert [json.loads(b)["number"] for a, b in found if a == rejects.NO_KEY] == [4]
    assert all(r.kind == "things" and r.file.endswith("in/1.json") for r in bad.collect())
    assert "FileScan parquet" in bad._jdf.queryExecution().executedPlan().toString()  # the lines are read once


def test_budget(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text("".join('{"repo": "r", "number": 1}\n' if k % 4 else "junk\n" for k in range(100)))
    with pytest.raises(rejects.TooManyRejects, match="25 of 100"):
        rejects.read_with_rejects(spark, str(folder), SMALL, "things", budget=rejects.Budget(0.2, 10))
    for budget in (rejects.Budget(0.25, 0), rejects.Budget(0, 25)):
        good, bad = rejects.read_with_rejects(spark, str(folder), SMALL, "things", budget=budget)
        assert (good.count(), bad.count()) == (75, 25)
    good, bad = rejects.read_with_rejects(spark, str(tmp_path / "none"), SMALL, "things", budget=rejects.Budget())
    assert (good.count(), bad.count()) == (0, 0)


def test_missing_details_and_stored_rejects(spark, rows, tmp_path):
    listing = rows("repo STRING, sha STRING", ("r", "a"), ("r", "b"), ("r", "b"))
    absent = rejects.missing_details(listing, rows("repo STRING, sha STRING", ("r", "a")), ["repo", "sha"], "commits")
    for _ in range(2):
        rejects.write_rejects(absent, str(tmp_path), "details")
    rejects.write_rejects(absent.withColumn("kind", F.lit("other")), str(tmp_path), "lines")
    got = rejects.read_rejects(spark, str(tmp_path)).collect()
    assert sorted((r.run, r.kind, r.reason, json.loads(r.record)["sha"]) for r in got) == [
        ("details", "commits", "no detail", "b"), ("lines", "other", "no detail", "b")
    ]
    assert rejects.read_rejects(spark, str(tmp_path / "no")).count() == 0


RAW = [{"repo": f"a/r{k % 2}", "sha": f"s{k}", "author": {"login": f"u{k % 3}"} if k else None,
        "files": [{"filename": f"src/f{n}", "additions": 1} for n in range(k)],
        "commit": {"message": "fix #1", "author": {"date": "2024-01-01T00:00:00Z"}}} for k in range(6)]


def test_several_datasets_from_one_scan(spark, landed, tmp_path, monkeypatch):
    raw = landed(schemas.RAW_COMMIT, *RAW)
    root, made = str(tmp_path / "out"), []
    tagged = fan_out.tagged
    monkeypatch.setattr(fan_out, "tagged", lambda *a: made.append(tagged(*a)) or made[-1])
    commits.write_history(raw, root)
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan json") == 1 and "Exchange" not in plan
    stored = tables.read_table(spark, f"{root}/commits", schemas.COMMITS)
    want = commits.normalise_commits(raw)
    assert sorted(map(str, stored.collect())) == sorted(map(str, want.select(*stored.columns).collect()))
    touches = tables.read_table(spark, f"{root}/touches", schemas.TOUCHES)
    assert sorted(map(str, touches.collect())) == sorted(map(str, commits.touches(want).select(*touches.columns).collect()))
    owners = ownership.file_ownership(touches)
    assert sorted(map(str, owners.collect())) == sorted(map(str, ownership.file_ownership(commits.touches(want)).collect()))
    plan = owners._jdf.queryExecution().executedPlan().toString()
    assert "json" not in plan.lower().replace("jsontostructs", "")  # neither the landed files nor the commits again
    # a second run replaces the repos it has and leaves the others
    commits.write_history(raw.filter("repo = 'a/r1'"), root)
    again = tables.read_table(spark, f"{root}/commits", schemas.COMMITS)
    assert again.count() == len(RAW) and not list((tmp_path / "out" / "_staged").iterdir())


def test_columns_of_two_types_are_refused(rows):
    df = rows("repo STRING, a BIGINT", ("r", 1))
    one = F.array(F.struct("repo", "a"))
    with pytest.raises(ValueError, match="another type"):
        fan_out.tagged(df, {"x": one, "y": F.array(F.struct("repo", F.lit("s").alias("a")))})


def test_ordinals_follow_files_and_lines(spark, tmp_path):
    sizes = {"a.txt": 700, "b.txt": 0, "c.txt": 3, "d.txt": 900}
    want, n = {}, 0
    for name, size in sizes.items():
        lines = [f"{name} line {k} {'x' * (k % 40)}" for k in range(size)]
        (tmp_path / name).write_text("".join(line + "\n" + "\n" * (k % 5 == 0) for k, line in enumerate(lines)))
        for line in lines:
            want[n] = line
            n += 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")  # files are read in stretches
    try:
        got = {r.ordinal: r.value for r in ordinals.numbered_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want
    assert ordinals.numbered_lines(spark, str(tmp_path / "none")).count() == 0


def test_json_with_ordinals(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"repo": "r", "number": 5}\nbroken\n{"repo": "r", "number": 7}\n')
    got = ordinals.numbered_json(spark, str(tmp_path), SMALL).collect()
    assert sorted((r.ordinal, r.number) for r in got if r.number) == [(0, 5), (2, 7)] and len(got) == 3


def test_jobs_keep_their_order(rows):
    runs = rows(schemas.RAW_CI_RUN)
    kind = rows(schemas.RAW_CI_JOB).schema
    jobs = [("r", 1, 2, "a"), ("r", 1, 0, "z"), ("r", 1, None, "b"), ("r", 1, 1, "m"), ("r", 1, None, "a2")]
    spark = runs.sparkSession
    made = spark.createDataFrame([(r, i, o, n, "failure", None, None, None) for r, i, o, n in jobs], kind)
    run = spark.createDataFrame([{"repo": "r", "id": 1, "conclusion": "failure"}], runs.schema)
    found = ci.normalise_ci_runs(run, made).first().failed_jobs
    assert [j.job_name for j in found] == ["z", "m", "a", "a2", "b"]


def test_counts_come_with_the_write(rows, tmp_path):
    def builder(n):
        return lambda t, settings: rows("repo STRING, question_id STRING", *[("r", f"Q{n}")] * n)

    written = []
    counts = qa_pairs.write_all(
        None, lambda pairs: (written.append(1), pairs.write.parquet(str(tmp_path / "p"))), builders={"x": builder(3), "y": builder(5), "z": builder(0)}
    )
    assert counts == {"x": 3, "y": 5, "z": 0} and len(written) == 1


def test_whole_job_with_damaged_lines(spark, tmp_path):
    base, root = tmp_path / "landed", str(tmp_path / "out")
    land(base / "issues", "1.json", raw_issue(1), raw_issue(2))
    with (base / "issues" / "1.json").open("a") as f:
        f.write('{"repo": "a/b", "numb\n')
    land(base / "commit_listing", "1.json", *[{"repo": "a/b", "sha": s} for s in ("s1", "s2")])
    land(base / "commits", "1.json", {"repo": "a/b", "sha": "s1", "author": {"login": "u"}, "files": [{"filename": "x"}],
                                      "commit": {"message": "m", "author": {"date": "2024-01-01T00:00:00Z"}}})
    with pytest.raises(Exception, match="(?i)malformed"):
        runner.run(spark, str(base), root, ["a/b"], skip_ci=True)
    counts = runner.run(spark, str(base), root, ["a/b"], skip_ci=True, budget=rejects.Budget())
    assert counts["latest_owner"] == 1 and set(counts) == set(qa_pairs.BUILDERS)
    assert sum(counts.values()) == tables.read_table(spark, f"{root}/qa_pairs", schemas.QA_PAIRS).count()
    assert {(r.kind, r.reason) for r in rejects.read_rejects(spark, root).collect()} == {("issues", "not JSON"), ("commits", "no detail")}
    assert tables.read_table(spark, f"{root}/touches", schemas.TOUCHES).count() == 1


def test_settled_tables_leave_no_shuffle_files(spark, tmp_path):
    def kept():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {p for d in dirs for p in Path(d.getPath()).rglob("shuffle_*.data")}

    before, was = kept(), spark.conf.get(tables.SHUFFLE_CLEANUP)
    rows = spark.range(20_000).withColumn("k", F.col("id") % 997).repartition(7, "k").groupBy("k").agg(F.sum("id").alias("s"))
    done = tables.settle(rows, "sums")
    for _ in range(50):
        if not kept() - before:
            break
        time.sleep(0.1)
    assert not kept() - before
    assert done.count() == 997 and done.agg(F.sum("s")).first()[0] == 20_000 * 19_999 // 2
    assert spark.conf.get(tables.SHUFFLE_CLEANUP) == was
