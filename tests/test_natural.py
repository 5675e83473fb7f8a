"""Threads, classification and review as stored tables: batches, generations, decisions, export."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from forgeline import schemas
from forgeline.operators import ci, review
from forgeline.plans import natural
from forgeline.sources import decisions, generations, landing
from forgeline.streaming import incremental
from tests.test_tables_runs import land, raw_issue

STATE = schemas.VERIFICATION


def raw_discussion(n):
    return {"repo": "a/b", "number": n, "title": f"D{n}", "body": "Why does it fail?", "createdAt": "2024-01-01T00:00:00Z",
            "author": {"login": "u"}, "comments": {"totalCount": 1, "nodes": [{"id": "x", "body": "Because.", "author": {"login": "v"}}]}}


def replies(prompts, stage):
    answer = (
        F.lit('{"contains_qa": true, "category": "D", "confidence": 1}') if stage == 1
        else F.concat(F.lit('{"question_id": "Q33", "confidence": 0.9, "answer_text": "a'), "number", F.lit('"}'))
    )
    return prompts.withColumn("response_text", answer)


def keys(df):
    return Counter((r.source, r.number) for r in df.collect())


def test_from_landed_files_to_export(spark, tmp_path):
    base, root = tmp_path / "landed", str(tmp_path / "out")
    land(base / "issues", "1.json", *[raw_issue(n) for n in range(3)], raw_issue(10, comments=0), raw_issue(2))
    natural.mine_threads(spark, str(base), root)
    natural.classify_stored(spark, root, replies, "m:1", "m/2")
    assert keys(natural.read_threads(spark, root)) == keys(natural.read_pairs(spark, root)) == {("issue", n): 1 for n in range(3)}

    land(base / "discussions", "1.json", raw_discussion(7))
    land(base / "issues", "2.json", raw_issue(1), raw_issue(4))
    asked = []

    def counted(prompts, stage):
        asked.extend((stage, r.number) for r in prompts.select("number").collect())
        return replies(prompts, stage)

    for _ in range(2):
        natural.mine_threads(spark, str(base), root)
        natural.classify_stored(spark, root, counted, "m:1", "m/2")
    assert sorted(asked) == [(1, 4), (1, 7), (2, 4), (2, 7)]
    pairs = natural.read_pairs(spark, root)
    assert keys(pairs) == {("issue", 0): 1, ("issue", 1): 1, ("issue", 2): 1, ("issue", 4): 1, ("discussion", 7): 1}
    assert (tmp_path / "out/natural/pairs/classify_m_1_m_2/generation=0/tables/pairs/repo_dir=a__b").is_dir()
    assert natural.read_pairs(spark, root, ["no/repo"]).count() == 0
    plan = natural.read_pairs(spark, root, ["a/b"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "repo_dir" in plan

    requests = spark.createDataFrame(
        [(f"a/b/issue/{n}/Q33", s, None) for n, s in ((0, "accepted"), (1, "rejected"), (4, "accepted"), (2, "maybe"))],
        "pair_id STRING, status STRING, note STRING",
    )
    assert [r.status for r in natural.decide(spark, root, requests).collect()] == ["maybe"]
    decisions.compact(spark, f"{root}/natural/decisions")
    natural.decide(spark, root, requests.limit(1).withColumn("status", F.lit("rejected")))
    assert natural.pair_detail(spark, root, "a/b/issue/4/Q33").first().status == "accepted"
    out = tmp_path / "export"
    natural.export_accepted(spark, root, str(out))
    lines = [json.loads(line) for f in out.glob("*.json") for line in f.read_text().splitlines()]
    assert [(x["number"], x["answer_text"], x["question_text"]) for x in lines] == [(4, "a4", "")]


def test_other_models_classify_again_and_empty_inputs(spark, tmp_path):
    base, root = tmp_path / "landed", str(tmp_path / "out")
    natural.mine_threads(spark, str(base), root)
    natural.classify_stored(spark, root, replies, "m", "n")
    assert natural.read_threads(spark, root).count() == natural.read_pairs(spark, root).count() == 0
    land(base / "issues", "1.json", raw_issue(1))
    natural.mine_threads(spark, str(base), root)
    for models in (("m", "n"), ("m", "n"), ("m", "other")):
        natural.classify_stored(spark, root, replies, *models)
    assert Counter((r.stage2_model, r.number) for r in natural.read_pairs(spark, root).collect()) == {("n", 1): 1, ("other", 1): 1}


def test_forced_rerun_and_a_crash_before_its_commit(spark, tmp_path, monkeypatch):
    base, root = tmp_path / "landed", str(tmp_path / "out")
    land(base / "issues", "1.json", *[raw_issue(n) for n in range(3)])
    natural.mine_threads(spark, str(base), root)
    natural.classify_stored(spark, root, replies, "m", "n")
    (base / "issues" / "1.json").write_text("".join(json.dumps(raw_issue(n)) + "\n" for n in (1, 5)))

    with monkeypatch.context() as m:
        m.setattr(generations, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            natural.mine_threads(spark, str(base), root, force=True)
        with pytest.raises(RuntimeError):
            natural.classify_stored(spark, root, replies, "m", "n", force=True)
    # readers still see what was committed, both before and after threads are derived anew
    assert sorted(r.number for r in natural.read_threads(spark, root).collect()) == [0, 1, 2]
    assert sorted(r.number for r in natural.read_pairs(spark, root).collect()) == [0, 1, 2]
    natural.mine_threads(spark, str(base), root, force=True)
    folder = f"{root}/natural/threads_issue"
    assert generations.newest(spark, folder) == 1
    assert sorted(r.number for r in natural.read_threads(spark, root).collect()) == [1, 5]
    assert sorted(r.number for r in natural.read_pairs(spark, root).collect()) == [0, 1, 2]
    # without force only threads that the ledger lacks are asked about, the others stay
    natural.classify_stored(spark, root, replies, "m", "n")
    assert keys(natural.read_pairs(spark, root)) == {("issue", n): 1 for n in (0, 1, 2, 5)}
    natural.classify_stored(spark, root, replies, "m", "n", force=True)
    natural.classify_stored(spark, root, replies, "m", "n", force=True)
    assert keys(natural.read_pairs(spark, root)) == {("issue", n): 1 for n in (1, 5)}
    assert generations.drop_old(spark, folder) == [0]
    assert sorted(r.number for r in natural.read_threads(spark, root).collect()) == [1, 5]


def test_uncommitted_batches_and_folds_are_not_seen(spark, rows, tmp_path, monkeypatch):
    schema, generation = "repo STRING, a BIGINT", str(tmp_path / "g")
    for batch in range(3):
        rows(schema, ("x/y", batch), ("z/w", batch)).write.parquet(f"{generation}/d/batch_id={batch}")
        if batch < 2:
            generations.commit_batch(spark, generation, batch, {"n": batch})
    read = lambda: sorted((r.repo, r.a) for r in generations.read(spark, generation, "d", schema).collect())
    want = sorted((r, b) for r in ("x/y", "z/w") for b in range(2))
    assert read() == want and generations.batch_note(spark, generation, 1) == {"n": 1}
    with monkeypatch.context() as m:
        m.setattr(generations, "mark", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            generations.fold(spark, generation, "d", schema)
    assert read() == want
    generations.commit_batch(spark, generation, 2)
    want = sorted((r, b) for r in ("x/y", "z/w") for b in range(3))
    assert read() == want
    assert generations.fold(spark, generation, "d", schema) == 2 == generations.fold(spark, generation, "d", schema)
    assert read() == want
    generations.drop_folded(spark, generation, "d")
    assert read() == want
    assert generations.read(spark, generation, "d", schema, ["x/y"]).count() == 3


def mine(spark, tmp_path, root, **options):
    stream = landing.stream_landed(spark, str(tmp_path / "landed"), "issues", 1)
    incremental.build_threads(stream, "issue", root, **options).awaitTermination()
    return sorted(r.number for r in generations.read(spark, root, "threads", schemas.RAW_THREADS).collect())


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    for k, numbers in enumerate(([0, 1], [1, 2, 0], [3, 2, 3])):
        land(tmp_path / "landed" / "issues", f"{k}.json", *[raw_issue(n) for n in numbers])
        assert mine(spark, tmp_path, root) == list(range(k + 2))
    last = max(int(f.name) for f in (tmp_path / "out/_checkpoint/commits").iterdir() if f.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):  # as if the last batch had not got to its commit
        (tmp_path / "out/_checkpoint/commits" / name).unlink(missing_ok=True)
    land(tmp_path / "landed" / "issues", "9.json", raw_issue(3), raw_issue(8))
    assert mine(spark, tmp_path, root) == [0, 1, 2, 3, 8]


def bytes_read(spark):
    jvm = spark._jvm
    return sum(s.getBytesRead() for s in jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())


def test_a_batch_reads_nothing_of_the_history(spark, tmp_path, monkeypatch):
    """Bytes that a batch reads stay the same over 20 batches, while the ledger grows."""
    for k in range(20):
        land(tmp_path / "landed" / "issues", f"{k:02}.json", *[raw_issue(1000 + 40 * k + n) for n in range(40)])
    spent, commit = [], generations.commit_batch

    def counted(session, generation, batch_id, note=None):
        commit(session, generation, batch_id, note)
        spent.append(bytes_read(spark))

    monkeypatch.setattr(generations, "commit_batch", counted)
    assert len(mine(spark, tmp_path, str(tmp_path / "out"))) == 800
    each = [b - a for a, b in zip(spent, spent[1:])]
    assert len(spent) == 20 and max(each[9:]) <= 1.2 * max(each[1:9])


def test_counters_stay_of_one_size(spark, rows, tmp_path):
    schema = "repo STRING, actor STRING, workflow_name STRING, conclusion STRING"
    inbox, root = tmp_path / "runs", str(tmp_path / "out")
    data = [("r", f"u{i % 50}" if i % 50 else None, "w", "failure" if i % 4 == 0 else "success") for i in range(2000)]
    sizes = []
    for k in range(20):
        rows(schema, *data[100 * k : 100 * (k + 1)]).coalesce(1).write.mode("append").parquet(str(inbox))
        stream = spark.readStream.schema(rows(schema, *data[:1]).schema).parquet(str(inbox))
        incremental.count_runs(stream, root, buckets=4).awaitTermination()
        sizes.append(sum(f.stat().st_size for d in ("counters", "changed", "merged") for f in (tmp_path / "out" / d).rglob("*.parquet")))
    assert max(sizes[1:]) <= 1.2 * min(sizes[1:])
    got = {tuple(r) for r in incremental.latest_counters(spark, root).collect()}
    assert got == {tuple(r) for r in ci.actor_failure_rates(rows(schema, *data)).select(*incremental.latest_counters(spark, root).columns).collect()}


# -- decisions -------------------------------------------------------------------


def entries(rows, *decided):
    schema = "pair_id STRING, status STRING, note STRING, day INT"
    return rows(schema, *decided).withColumn("verified_at", F.timestamp_seconds(F.col("day") * 86400)).drop("day")


def state(spark, root, **options):
    return {(r.pair_id, r.status, r.note) for r in decisions.read_state(spark, root, **options).collect()}


def test_decisions_stay_the_same_through_compaction(spark, rows, tmp_path):
    root = str(tmp_path / "log")
    assert state(spark, root) == set() and decisions.compact(spark, root) is None
    decisions.append(entries(rows, ("p1", "accepted", "", 1), ("p2", "rejected", "no", 1)), root)
    decisions.append(entries(rows, ("p1", "rejected", "late", 3), ("p3", "pending", "", 1)), root)
    want = {("p1", "rejected", "late"), ("p2", "rejected", "no"), ("p3", "pending", "")}
    assert state(spark, root) == want
    assert decisions.compact(spark, root) == 0 and state(spark, root) == want and decisions.pending_changes(spark, root) == []
    decisions.append(entries(rows, ("p1", "accepted", "early", 2), ("p2", "accepted", "", 9)), root)
    want = want - {("p2", "rejected", "no")} | {("p2", "accepted", "")}
    for k in (1, 2):
        assert state(spark, root) == want
        assert decisions.compact(spark, root) == k and state(spark, root) == want
        decisions.append(entries(rows, ("p9", "accepted", "", 1)), root)
        want = want | {("p9", "accepted", "")}
    assert state(spark, root, pair_id="p1") == {("p1", "rejected", "late")} and state(spark, root, pair_id="none") == set()
    assert len(list((tmp_path / "log/snapshots").iterdir())) == 2  # older ones are gone


def test_a_lost_compaction_or_append_changes_nothing(spark, rows, tmp_path, monkeypatch):
    root = str(tmp_path / "log")
    decisions.append(entries(rows, ("p1", "accepted", "", 1)), root)
    with monkeypatch.context() as m:
        m.setattr(generations, "mark", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            decisions.append(entries(rows, ("p1", "rejected", "", 2)), root)
        with pytest.raises(RuntimeError):
            decisions.compact(spark, root)
    assert state(spark, root) == {("p1", "accepted", "")} and decisions.version(spark, root) is None
    assert decisions.compact(spark, root) == 0 and state(spark, root) == {("p1", "accepted", "")}


def test_one_pair_is_looked_up_in_one_bucket(spark, rows, tmp_path):
    root = str(tmp_path / "log")
    decisions.append(entries(rows, *[(f"p{k}", "accepted", "", 1) for k in range(500)]), root)
    decisions.compact(spark, root)
    one = decisions.read_state(spark, root, "p17")
    assert [r.pair_id for r in one.collect()] == ["p17"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    read = decisions._rows(spark, root, [], 0).filter(F.col("bucket") == decisions.bucket_of(F.lit("p17")))
    assert len({f for f in read.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}) == 1
    assert review.current_verification(read).count() < 500
