"""Inducing commits, ownership, ranking: laws and brute force."""

import hashlib
import random
import re
import statistics
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from forgeline.operators import contributors, inducing, ownership, ranking
from forgeline.sources import star, tables

DAY0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
TOUCH = (
    "repo STRING, sha STRING, author_login STRING, committed_at TIMESTAMP, is_bug_fix BOOLEAN, "
    "closes_issues ARRAY<BIGINT>, path STRING"
)


def touch(sha, at, path="f", refs=(), login="u", repo="r"):
    return (repo, sha, login, DAY0 + at, bool(refs), list(refs), path)


def found(df):
    return sorted((r.issue_number, r.fix_sha, r.inducing_sha, r.file) for r in inducing.inducing_pairs(df).collect())


def test_same_instant_is_not_earlier(rows):
    d = timedelta(days=5)
    df = rows(TOUCH, touch("c1", timedelta(0)), touch("c2", d), touch("fx", d, refs=[1]))
    assert found(df) == [(1, "fx", "c1", "f")]


@pytest.mark.parametrize("extra, hit", [(0, True), (1, False)])
def test_window_is_inclusive(rows, extra, hit):
    df = rows(TOUCH, touch("c1", timedelta(0)), touch("fx", timedelta(days=365, seconds=extra), refs=[1]))
    assert bool(found(df)) is hit


def test_every_issue_and_file(rows):
    day = timedelta(days=1)
    df = rows(
        TOUCH,
        *[touch("c1", timedelta(0), p) for p in "ab"],
        *[touch("fx", day, p, refs=[1, 2]) for p in "abc"],
    )
    assert found(df) == [(i, "fx", "c1", p) for i in (1, 2) for p in "ab"]


def test_nearest_on_the_same_day_wins_over_carried(rows):
    h = timedelta(hours=1)
    df = rows(TOUCH, touch("old", -24 * h), touch("near", h), touch("fx", 2 * h, refs=[1]), touch("late", 3 * h))
    assert found(df) == [(1, "fx", "near", "f")]


def brute_force(touches, days=365):
    out = []
    for repo, sha, _, at, _, refs, path in touches:
        if not refs:
            continue
        earlier = [
            (t[3], t[1]) for t in touches if t[0] == repo and t[6] == path and t[3] < at and at - t[3] <= timedelta(days=days)
        ]
        if earlier:
            out += [(i, sha, max(earlier)[1], path) for i in refs]
    return sorted(out)


def random_touches(n, seed, hot=0.4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        path = "hot" if rng.random() < hot else f"f{rng.randrange(12)}"
        at = timedelta(days=rng.randrange(900), seconds=rng.choice([0, 0, 3600, 7200]))
        refs = [rng.randrange(50) for _ in range(rng.choice([0, 0, 1, 2]))]
        out.append(touch(f"s{i:05d}", at, path, refs, login=f"u{rng.randrange(5)}"))
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_equals_brute_force_with_a_hot_file(rows, partitions):
    data = random_touches(600, seed=3)
    df = rows(TOUCH, *data).repartition(partitions)
    assert found(df) == brute_force(data)


def test_pairs_obey_the_rules(rows):
    pairs = inducing.inducing_pairs(rows(TOUCH, *random_touches(300, seed=5)))
    wrong = pairs.filter(
        "inducing_at >= fix_at OR fix_sha = inducing_sha OR unix_micros(fix_at) - unix_micros(inducing_at) > 31536000000000"
    )
    assert pairs.count() > 0 and wrong.count() == 0
    q = pairs.first().ground_truth_q56
    assert q.question == f"Which commit introduced the regression in issue #{pairs.first().issue_number}?"


def test_expertise_counts_directories(rows):
    df = rows(TOUCH, touch("c1", timedelta(0), "s/x"), touch("c1", timedelta(0), "s/y"), touch("c2", timedelta(0), "top", login=None))
    got = {(r.login, r.path): r.commits for r in ownership.path_expertise(df).collect()}
    assert got == {("u", "s"): 2, ("u", "s/x"): 1, ("u", "s/y"): 1}


def test_ownership_counts_commits_without_login(rows):
    z = timedelta(0)
    df = rows(TOUCH, touch("a", z, login="v"), touch("b", z, login=None), touch("c", z, login="u"), touch("d", z, login="u"))
    row = ownership.file_ownership(df).first()
    assert (row.total_commits, row.unique_authors) == (4, ["u", "v"])


def test_latest_modifier_keeps_a_null_winner(rows):
    df = rows(TOUCH, touch("a", timedelta(0)), touch("b", timedelta(1), login=None))
    assert ownership.latest_modifier(df).first().login is None


def test_top_paths_and_experts_match_brute_force(rows):
    data = random_touches(400, seed=9)
    data = [t[:6] + (f"d{int(t[1][1:]) % 3}/{t[6]}",) for t in data]
    counts = defaultdict(Counter)
    for _, _, login, _, _, _, path in data:
        counts[login][path] += 1
        counts[login][path.split("/")[0]] += 1
    want = {
        (login, p, n): i + 1
        for login, c in counts.items()
        for i, (p, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:20])
    }
    paths = ownership.top_paths(rows(TOUCH, *data))
    assert {(r.login, r.path, r.commits): r.rank for r in paths.collect()} == want
    experts = {r.file: [(e.login, e.commits) for e in r.experts] for r in ownership.file_experts(paths, 2).collect()}
    by_path = defaultdict(list)
    for login, path, n in want:
        by_path[path].append((login, n))
    assert experts == {p: sorted(e, key=lambda x: (-x[1], x[0]))[:2] for p, e in by_path.items()}


def test_profile_population_and_round_trip(rows):
    commits = rows("repo STRING, author_login STRING", ("r", "c"), ("r", "c"), ("r", None))
    issues = rows("repo STRING, reporter STRING, assignees ARRAY<STRING>", ("r", "only_reports", ["c", "x"]))
    comments = rows("repo STRING, login STRING", *[("r", "c")] * 4, ("r", None))
    reviews = rows("repo STRING, author STRING, reviewer STRING", ("r", "c", "c"), ("r", "c", None), ("r", None, "v"))
    totals = contributors.activity_totals(contributors.activity_rows(commits, issues, comments, reviews))
    got = {r.login: r for r in totals.collect()}
    assert set(got) == {"c", "v"}
    c = got["c"]
    assert (c.total_commits, c.total_issue_comments, c.total_reviews_given, c.total_reviews_received) == (2, 4, 1, 2)
    assert (c.issues_reported, c.issues_assigned, c.activity_score) == (0, 1, 12)
    paths = rows("repo STRING, login STRING, path STRING, commits BIGINT, rank INT", ("r", "c", "a/b/c", 5, 1), ("r", "c", "a", 3, 2))
    profiles = contributors.profiles(totals, paths)
    rows_by = {r.login: r for r in profiles.collect()}
    assert [(d.dir, d.commits) for d in rows_by["c"].top_directories] == [("a", 3)] and rows_by["v"].top_files == []
    back = ownership.paths_of_profiles(profiles).orderBy("rank").collect()
    assert [(r.path, r.commits, r.rank) for r in back] == [("a/b/c", 5, 1), ("a", 3, 2)]


@pytest.mark.parametrize("width", [4, 65_536])
def test_rank_equals_row_number_with_a_hot_group(rows, monkeypatch, width):
    monkeypatch.setattr(ranking, "RANK_BUCKET", width)
    rng = random.Random(1)
    numbers = {g: rng.sample(range(5000), n) for g, n in (("hot", 300), ("b", 20), ("c", 1))}
    df = rows("g STRING, n BIGINT", *[(g, n) for g, ns in numbers.items() for n in ns])
    got = ranking.with_rank(df, ["g"], "n", F.col("n") % 2 == 0, {"odd": F.col("n") % 2 == 1}).collect()
    want = {
        (g, n): i + 1 for g, ns in numbers.items() for i, n in enumerate(sorted(x for x in ns if x % 2 == 0))
    }
    assert {(r.g, r.n): r["rank"] for r in got} == want
    assert all(r.odd == sum(x % 2 for x in numbers[r.g]) for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_exact_median(rows, seed):
    rng = random.Random(seed)
    groups = {g: [round(rng.uniform(-50, 300), 3) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 101), ("d", 500))}
    groups["d"] += [12.5] * 400
    df = rows("g STRING, v DOUBLE", *[(g, v) for g, vs in groups.items() for v in vs], ("a", None))
    got = {r.g: (r.median, r.sample_size) for r in ranking.exact_median(df, ["g"], "v", F.floor("v")).collect()}
    for g, vs in groups.items():
        assert got[g][0] == pytest.approx(statistics.median(vs)) and got[g][1] == len(vs)


def test_busy_files_go_by_days_and_others_are_shuffled_once(rows, tmp_path, spark):
    data = random_touches(600, seed=7)
    data += [touch("n1", timedelta(1), None), touch("n2", timedelta(2), None, refs=[3]), touch("n3", timedelta(2), "f1", refs=[3], repo=None)]
    df = tables.settle_at(rows(TOUCH, *data), f"{tmp_path}/touches")
    want = brute_force([t for t in data if t[0] and t[6]])
    # 600 touches: none, the hot file alone and all files are busy
    for busy in (1_000_000, 100, 0):
        pairs = inducing.inducing_pairs(df, busy_touches=busy)
        assert sorted((r.issue_number, r.fix_sha, r.inducing_sha, r.file) for r in pairs.collect()) == want
    pairs = inducing.inducing_pairs(df)
    pairs.collect()
    final = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # the keys for the counts by bucket, and each touch
    assert len(re.findall(r"hashpartitioning\(path|hashpartitioning\(repo", final)) == 1, final


def test_touches_shuffle_lines_once(spark, rows, tmp_path):
    orders = [(k, k, "F", None, datetime(2024, 1, 1 + k), "1-URGENT") for k in range(6)] + [(2, 7, "O", None, datetime(2024, 2, 1), "5-LOW")]
    lines = [(k % 8, p, 1, n, 1.0, 1.0, 0.0, 0.0, "R", "O", datetime(2024, 3, 1)) for n, (k, p) in enumerate([(0, 1), (0, 1), (0, 2), (1, 2), (2, 1), (2, 9), (7, 1)])]
    lines += [(None, 1, *lines[0][2:]), (1, None, *lines[0][2:])]
    parts = [(1, "a", "Brand#1", "LARGE", 1, 1.0), (2, "b", "Brand#2", None, 1, 1.0), (2, "b", "Brand#3", "SMALL", 1, 1.0)]
    for name, data in (("orders", orders), ("lineitem", lines), ("part", parts)):
        rows(star.TABLES[name], *data).write.parquet(f"{tmp_path}/{name}.parquet")
    df = star.touches(spark, str(tmp_path))
    got = sorted((r.sha, r.author_login or "", r.path or "") for r in df.collect())
    md5 = [hashlib.md5(str(k).encode()).hexdigest() for k in range(3)]
    want = [(md5[0], "", "src/LARGE/Brand1/p1"), (md5[0], "", ""), (md5[0], "", "src/SMALL/Brand3/p2"), (md5[1], "u1", ""), (md5[1], "u1", "src/SMALL/Brand3/p2")]
    want += [(md5[2], "u2", "src/LARGE/Brand1/p1"), (md5[2], "u7", "src/LARGE/Brand1/p1")]
    assert got == sorted(want)
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert not re.search(r"hashpartitioning\([^,]+, l_partkey", final)
    dealt = re.findall(r"hashpartitioning\(o_orderkey", final)
    assert len(dealt) == 2, final  # lines and orders
