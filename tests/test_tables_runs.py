"""Sources, sinks, incremental runs, and the whole job on landed files."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from forgeline import schemas
from forgeline.operators import ci, classify, issues, threads
from forgeline.plans import runner
from forgeline.session import shared_folder
from forgeline.sources import landing, tables
from forgeline.streaming import incremental

SMALL = "repo STRING, a INT, b STRING"


def test_jsonl_keeps_nulls_and_skips_blank_lines(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    tables.write_jsonl(rows(SMALL, ("x/y", 1, None)), path)
    written = [f.read_text() for f in (tmp_path / "out").glob("*.json")]
    assert json.loads("".join(written)) == {"repo": "x/y", "a": 1, "b": None}
    tables.write_jsonl(rows(SMALL, ("x/y", 2, "z")), path, "append")
    assert tables.read_jsonl(spark, path, SMALL).count() == 2
    blank = tmp_path / "blank.jsonl"
    blank.write_text('{"repo": "r", "a": 1}\n\n\n{"repo": "r", "a": 2}\n')
    assert [r.a for r in tables.read_jsonl(spark, str(blank), SMALL).collect()] == [1, 2]


def test_missing_and_damaged_inputs(spark, tmp_path):
    assert tables.read_jsonl(spark, str(tmp_path / "no"), SMALL).count() == 0
    assert tables.read_jsonl(spark, str(tmp_path / "*/no.jsonl"), SMALL).columns == ["repo", "a", "b"]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"repo": "r"\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_jsonl(spark, str(bad), SMALL).collect()


def test_glob_over_repos(spark, rows, tmp_path):
    for name in ("a__b", "c__d"):
        tables.write_jsonl(rows(SMALL, (name, 1, None)), str(tmp_path / name / "pairs.jsonl"))
    assert tables.read_jsonl(spark, str(tmp_path / "*" / "pairs.jsonl"), SMALL).count() == 2


def test_tables_by_repo(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    assert tables.read_table(spark, path, SMALL).count() == 0
    tables.write_table(rows(SMALL, ("a/b", 1, "x"), ("c/d", 2, "y")), path)
    assert (tmp_path / "t" / "repo_dir=a__b").is_dir()
    tables.write_table(rows(SMALL, ("a/b", 3, "z")), path)
    assert {(r.repo, r.a) for r in tables.read_table(spark, path, SMALL).collect()} == {("a/b", 3), ("c/d", 2)}
    pruned = tables.read_table(spark, path, SMALL, ["c/d"])
    assert pruned.columns == ["repo", "a", "b"] and [r.a for r in pruned.collect()] == [2]
    assert "PartitionFilters: [isnotnull(repo_dir" in pruned._jdf.queryExecution().toString()
    assert tables.write_new_repos(rows(SMALL, ("a/b", 9, ""), ("e/f", 9, "")), path, ["a/b", "e/f"]) == ["e/f"]
    assert {(r.repo, r.a) for r in tables.read_table(spark, path, SMALL).collect()} == {("a/b", 3), ("c/d", 2), ("e/f", 9)}


def test_missing_repos_takes_no_job(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    assert tables.missing_repos(spark, path, ["a/b", "c"]) == ["a/b", "c"]
    tables.write_table(rows(SMALL, ("a/b", 1, "x"), ("c:d", 1, "x"), ("e", 1, "x")), path)
    spark.sparkContext.setJobGroup("missing", "listing")
    assert tables.missing_repos(spark, path, ["a/b", "c", "c:d", "e"]) == ["c"]
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("missing")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tables.drop_repos(spark, path, ["a/b"])
    assert tables.missing_repos(spark, path, ["a/b", "e"]) == ["a/b"]


def test_ledger_files(spark, rows, tmp_path):
    path = str(tmp_path / "ledger")
    entry = rows(schemas.LEDGER, ("r", "issue", 1, "k"))
    tables.append_ledger(entry, path)
    tables.append_ledger(entry, path)
    assert tables.read_ledger(spark, path, schemas.LEDGER).count() == 1
    assert tables.read_ledger(spark, path + "x", schemas.LEDGER).count() == 0


def test_shared_folder_prefers_the_named_one():
    def session(named, master):
        conf = SimpleNamespace(get=lambda key, default: named if key == "spark.checkpoint.dir" else default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert shared_folder(session("/shared/x/", "yarn")) == "/shared/x"
    assert "forgeline-" in shared_folder(session(None, "local[2]"))
    with pytest.raises(ValueError):
        shared_folder(session(None, "yarn"))


LONG = "word " * 30


def raw_issue(n, comments=1):
    nodes = [{"databaseId": i, "author": {"login": "u"}, "body": LONG, "createdAt": None} for i in range(comments)]
    return {"repo": "a/b", "number": n, "title": f"T{n}", "state": "OPEN", "createdAt": "2024-01-01T00:00:00Z",
            "comments": {"totalCount": comments, "nodes": nodes}}


def land(folder, name, *records):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in records))


def test_incremental_threads_equal_batch(spark, tmp_path):
    inbox, root = tmp_path / "landed" / "issues", str(tmp_path / "out")

    def run():
        stream = landing.stream_landed(spark, str(tmp_path / "landed"), "issues", 1)
        incremental.build_threads(stream, "issue", root).awaitTermination()

    land(inbox, "1.json", *[raw_issue(n) for n in range(4)], raw_issue(2))
    land(inbox, "2.json", raw_issue(3), raw_issue(10, comments=0))
    run()
    land(inbox, "3.json", raw_issue(0), raw_issue(11))
    run()
    run()
    batch = threads.issue_threads(
        issues.normalise_issues(landing.read_landed(spark, str(tmp_path / "landed"), "issues").dropDuplicates(["number"]))
    )
    built = spark.read.schema(batch.schema).parquet(f"{root}/threads")
    assert built.count() == 5
    assert {r.thread_text for r in built.collect()} == {r.thread_text for r in batch.collect()}
    ledger = incremental.read_batches(spark, f"{root}/thread_ledger", schemas.LEDGER)
    assert sorted(r.number for r in ledger.collect()) == [0, 1, 2, 3, 10, 11]


def test_incremental_classification(spark, rows, tmp_path):
    schema = "repo STRING, source STRING, number BIGINT, title STRING, url STRING, created_at TIMESTAMP, thread_text STRING, comments ARRAY<STRING>"
    inbox, root = str(tmp_path / "threads"), str(tmp_path / "out")

    def threads_of(*numbers):
        return rows(schema, *[("r", "issue", n, "t", "u", None, f"text {n}", []) for n in numbers])

    def responses(prompts, stage):
        answer = (
            '{"contains_qa": true, "category": "D", "confidence": 1}' if stage == 1
            else '{"question_id": "Q33", "confidence": 0.9, "answer_text": "a"}'
        )
        return classify.score(prompts, "prompt", lambda ps: [answer if "text 2" not in p else None for p in ps])

    for numbers in ((1, 2), (2, 3)):
        threads_of(*numbers).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(threads_of(1).schema).parquet(inbox)
        incremental.classify_threads(stream, responses, root, "m", "n").awaitTermination()
    pairs = spark.read.parquet(f"{root}/pairs")
    assert sorted((r.number, r.question_id, r.stage1_model) for r in pairs.collect()) == [(1, "Q33", "m"), (3, "Q33", "m")]
    outcome = spark.read.schema("repo STRING, source STRING, number BIGINT, outcome STRING").parquet(f"{root}/outcomes")
    assert sorted((r.number, r.outcome) for r in outcome.collect()) == [(1, "kept"), (2, "parse_error_s1"), (3, "kept")]


def test_running_counters_equal_batch(spark, rows, tmp_path):
    schema = "repo STRING, actor STRING, workflow_name STRING, conclusion STRING"
    inbox, root = str(tmp_path / "runs"), str(tmp_path / "out")
    data = [("r", f"u{i % 3}" if i % 3 else None, "w", "failure" if i % 4 == 0 else "success") for i in range(30)]
    assert incremental.latest_counters(spark, root).count() == 0
    for part in (data[:10], data[10:11], data[11:]):
        rows(schema, *part).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(rows(schema, *data).schema).parquet(inbox)
        incremental.count_runs(stream, root).awaitTermination()
    got = {tuple(r) for r in incremental.latest_counters(spark, root).select("actor", "failures", "total_runs").collect()}
    want = ci.actor_failure_rates(rows(schema, *data)).select("actor", "failures", "total_runs").collect()
    assert got == {tuple(r) for r in want}


def test_whole_job(spark, tmp_path):
    base, root = tmp_path / "landed", str(tmp_path / "out")
    bug = [{"__typename": "LabeledEvent", "createdAt": None, "label": {"name": "bug"}},
           {"__typename": "AssignedEvent", "createdAt": None, "assignee": {"login": "dev"}}]
    land(base / "issues", "1.json", raw_issue(1), raw_issue(2) | {"body": "duplicate of #1", "timelineItems": {"nodes": bug}}, raw_issue(3))
    shas = ["s1", "s2", "s3"]
    land(base / "commit_listing", "1.json", *[{"repo": "a/b", "sha": s} for s in shas])
    land(base / "commits", "1.json", *[
        {"repo": "a/b", "sha": s, "author": {"login": f"u{i % 2}"}, "files": [{"filename": "src/x", "additions": 1, "deletions": 0}],
         "commit": {"message": "Fixes #1" if i == 2 else "work", "author": {"date": f"2024-01-0{i + 1}T00:00:00Z"}}}
        for i, s in enumerate(shas)
    ])
    land(base / "pull_requests", "1.json", *[
        {"repo": "a/b", "number": n, "title": "P", "state": "MERGED", "createdAt": "2024-01-01T00:00:00Z", "author": {"login": "u0"},
         "reviews": {"nodes": [{"author": {"login": "u1"}, "state": "OK", "submittedAt": f"2024-01-01T0{n}:00:00Z"}]}}
        for n in range(1, 6)
    ])
    land(base / "ci_runs", "1.json", {"repo": "a/b", "id": 5, "conclusion": "failure", "name": "w", "triggering_actor": {"login": "u1"}})
    land(base / "ci_jobs", "1.json", {"repo": "a/b", "run_id": 5, "name": "j", "conclusion": "failure"})
    runner.run(spark, str(base), root, ["a/b"])

    def table(name):
        return tables.read_table(spark, f"{root}/{name}", schemas.DATASETS[name])

    counts = {r.question_id: r.n for r in table("qa_pairs").groupBy("question_id").agg(F.count("*").alias("n")).collect()}
    negatives = table("qa_pairs").filter("question_id = 'Q53' AND NOT try_variant_get(ground_truth, '$.is_duplicate', 'boolean')").count()
    assert counts == {"Q53": 1 + negatives, "Q54": 1, "Q56": 1, "Q32": 1, "Q33": 1, "Q18": 1, "Q19": 2, "Q50": 1}
    assert table("szz_pairs").first().inducing_sha == "s2"
    assert {r.login for r in table("contributors").collect()} == {"u", "u0", "u1"}

    # a second run skips mined tables and rebuilds the same pairs
    runner.run(spark, str(base), root, ["a/b"])
    again = {r.question_id: r.n for r in table("qa_pairs").groupBy("question_id").agg(F.count("*").alias("n")).collect()}
    assert again == counts
    # pairs by reference: the same questions, artifacts stored once however often it runs
    for _ in range(2):
        runner.run_by_reference(spark, root, ["a/b"])
        referred = {r.question_id: r.n for r in table("qa_pair_refs").groupBy("question_id").agg(F.count("*").alias("n")).collect()}
        assert referred == counts
        assert sorted(r.kind for r in table("shared_artifacts").collect()) == ["contributor_profiles", "pr_review_history"]
    assert table("qa_pair_refs").join(table("shared_artifacts"), "artifact_id").select("question_id").distinct().count() == 2
    exported = str(tmp_path / "export")
    tables.write_jsonl(table("qa_pairs"), exported)
    line = spark.read.text(exported).filter(F.contains("value", F.lit('"Q54"'))).first()[0]
    assert json.loads(line)["ground_truth"] == {"assignee": "dev"}
