"""Project activity read out of a star schema of orders, events and texts.

Lets every job run over warehouse tables that hold no repository records: orders
act as commits, issues and pull requests, order lines as files, comments, reviews
and timeline events, events as CI runs, conversations as threads. The results have
the landed (raw) shapes of :mod:`forgeline.schemas`, so the same operators apply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forgeline.functions.refs import commit_refs, is_bug_fix
from forgeline.functions.times import format_iso
from forgeline.operators.ranking import collected

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]


# Declared schemas: no job is needed to look them up.
TABLES = {
    "orders": """o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,
        o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING""",
    "lineitem": """l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT,
        l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE,
        l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ""",
    "part": """p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT,
        p_retailprice DOUBLE""",
    "events": """event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING,
        value DOUBLE, props STRING""",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _repo(key: str) -> Column:
    return _text("acme/r", F.col(key) % 3)


def _sha(key: Column) -> Column:
    return F.md5(key.cast("string"))


def _iso(column: str) -> Column:
    return format_iso(F.col(column).cast("timestamp"))


def _customer() -> Column:
    return F.when(F.col("o_custkey") % 97 != 0, _text("u", F.col("o_custkey")))


def _supplier(line: Column) -> Column:
    return F.when(line["l_suppkey"] % 41 != 0, _text("s", line["l_suppkey"]))


def _message() -> Column:
    k = F.col("o_orderkey")
    url = F.when(k % 5 == 0, _text(", resolves https://github.com/acme/core/issues/", k % 777)).otherwise("")
    return (
        F.when(F.col("o_orderstatus") == "F", _text("Fixes #", k % 1000, url))
        .when(F.col("o_orderstatus") == "P", "bump version")
        .otherwise("crash on load")
    )


def _path() -> Column:
    part = F.col("p_partkey")
    nested = _text("src/", F.col("p_type"), "/", F.replace("p_brand", F.lit("#"), F.lit("")), "/p", part)
    return F.when(part % 50 == 0, _text("p", part)).otherwise(nested)


def commit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits without their files: the columns that author and history jobs use."""
    return _as_commits(read(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")


def _as_commits(orders: DataFrame, *more: str) -> DataFrame:
    """Commit columns of rows that hold an order, with ``more`` of their own."""
    return orders.select(
        _repo("o_orderkey").alias("repo"),
        _sha(F.col("o_orderkey")).alias("sha"),
        _message().alias("message"),
        _customer().alias("author_login"),
        F.col("o_orderdate").cast("timestamp").alias("committed_at"),
        *more,
    ).withColumns(
        {"closes_issues": commit_refs(F.col("message"))}
    ).withColumn("is_bug_fix", is_bug_fix(F.col("message"), F.col("closes_issues")))


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per commit and distinct file.

    Lines are dealt by their commit, two numbers each, and made distinct there; they meet the
    paths with the bare columns of the order. Hashes and texts of a commit are made last.
    """
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    changed = lines.filter("l_partkey IS NOT NULL").repartition("o_orderkey").distinct()
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), _path().alias("path"))
    # Lines and orders are both large: joined by sorting, never by broadcast.
    joined = changed.hint("merge").join(orders, "o_orderkey").join(part, "l_partkey")
    return _as_commits(joined, "path").select(
        "repo", "sha", "author_login", "committed_at", "is_bug_fix", "closes_issues", "path"
    )


def raw_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), _path().alias("filename"))
    files = (
        read(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_partkey")
        .agg(
            F.sum(F.col("l_quantity").cast("bigint")).alias("additions"),
            F.sum(F.col("l_linenumber").cast("bigint")).alias("deletions"),
        )
        .join(part, "l_partkey")
    )
    listed = F.array_sort(F.collect_list(F.struct("filename", "additions", "deletions")))
    nested = files.groupBy("l_orderkey").agg(listed.alias("files"))
    commits = commit_rows(spark, sf_dir)
    joined = commits.join(nested.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left")
    k = F.col("o_orderkey")
    return joined.select(
        "repo",
        "sha",
        F.struct(
            "message",
            F.struct(
                _text("Name ", F.col("o_custkey")).alias("name"),
                _text(F.col("o_custkey"), "@example.org").alias("email"),
                _iso("committed_at").alias("date"),
            ).alias("author"),
        ).alias("commit"),
        F.when(F.col("author_login").isNotNull(), F.struct(F.col("author_login").alias("login"))).alias("author"),
        "files",
        F.when(k >= 3, F.array(F.struct(_sha(k - 3).alias("sha"))))
        .otherwise(F.array().cast("array<struct<sha:string>>"))
        .alias("parents"),
    )


# Columns of an order line by name, as the record functions below take them.
def _line() -> dict[str, Column]:
    return {c: F.col(c) for c in (*LINE_ORDER, "l_orderkey", "l_returnflag", "l_linestatus", "pos")}


def _order_lines(spark: SparkSession, sf_dir: str, **records: Column) -> DataFrame:
    """Per order: number of lines, last ship date, and an array per record of its lines.

    Lines are shuffled and sorted once, with their few columns. Records are built on them as
    flat rows, in generated code, and collected as they come (``replaceHashWithSortAgg``): a
    task holds the records of one order. Arrays that a query doesn't use are not made.
    """
    built = _placed_lines(spark, sf_dir).select(
        "l_orderkey", "pos", "l_shipdate", *[column.alias(name) for name, column in records.items()]
    )
    lines = built.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.max("l_shipdate").alias("last_ship"),
        *[collected(F.col(name), "pos").alias(name) for name in records],
    )
    # Orders and their lines are both large: joined by sorting, never by broadcast.
    return lines.hint("merge")


def _nodes(values: Column) -> Column:
    return F.struct(values.alias("nodes"))


def _login(name: Column) -> Column:
    return F.struct(name.alias("login"))


def _comment_body(line: Column) -> Column:
    ref = (
        F.when(line["l_linenumber"] == 3, _text("duplicate of #", line["l_partkey"] % 1000))
        .when(line["l_linenumber"] == 5, _text("similar to #", line["l_partkey"] % 1000))
        .otherwise("")
    )
    return F.concat(F.repeat(F.lit("text "), line["l_quantity"].cast("int")), ref)


def _assignees() -> Column:
    second = F.when(F.col("o_orderkey") % 2 == 0, _text("u", F.col("o_custkey") % 31))
    return F.array_compact(F.array(_text("u", F.col("o_custkey") % 50), second))


def issue_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, reporter, assignees) per issue."""
    return read(spark, sf_dir, "orders").select(
        _repo("o_orderkey").alias("repo"), _customer().alias("reporter"), _assignees().alias("assignees")
    )


def _placed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their place in the order."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*[F.asc(c) for c in LINE_ORDER]))
    return read(spark, sf_dir, "lineitem").withColumn("pos", place)


def comment_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, login) per issue comment."""
    return read(spark, sf_dir, "lineitem").select(
        _repo("l_orderkey").alias("repo"), _supplier({"l_suppkey": F.col("l_suppkey")}).alias("login")
    )


def review_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, author, reviewer) per review."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    authors = read(spark, sf_dir, "orders").select("o_orderkey", _customer().alias("author"))
    return lines.join(authors, "o_orderkey").select(
        _repo("o_orderkey").alias("repo"), "author", _supplier({"l_suppkey": F.col("l_suppkey")}).alias("reviewer")
    )


def _comment(line: dict[str, Column]) -> Column:
    return F.struct(
        (line["l_orderkey"] * 100 + line["pos"]).alias("databaseId"),
        _login(_supplier(line)).alias("author"),
        _comment_body(line).alias("body"),
        _iso("l_shipdate").alias("createdAt"),
    )


def _event(line: dict[str, Column]) -> Column:
    ln = line["l_linenumber"]
    kind = (
        F.when(ln % 5 == 0, "CrossReferencedEvent")
        .when(ln == 7, "ClosedEvent")
        .when(ln % 2 == 0, "AssignedEvent")
        .otherwise("LabeledEvent")
    )
    source = F.struct(
        line["l_partkey"].alias("number"),
        _text("ref ", line["l_partkey"]).alias("title"),
        F.when(line["l_linestatus"] == "O", "OPEN").otherwise("MERGED").alias("state"),
    )
    label = F.when(line["l_returnflag"] == "R", "Bug").otherwise(line["l_returnflag"])
    return F.struct(
        kind.alias("__typename"),
        _iso("l_shipdate").alias("createdAt"),
        _login(_supplier(line)).alias("assignee"),
        F.struct(label.alias("name")).alias("label"),
        F.when(line["l_suppkey"] % 10 != 0, source).alias("source"),
    )


def raw_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    lines = _order_lines(spark, sf_dir, comment=_comment(_line()), event=_event(_line()))
    orders = read(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    number = F.expr("o_orderkey div 3")
    body = (
        F.when(k % 7 == 0, _text("Crash seen. Duplicate of #", k % 5003))
        .when(k % 7 == 1, _text("Same as #1 and dup of #", k % 701, ". See also #", k % 211))
        .when(k % 7 == 2, _text("Related to #", k % 499))
        .when(k % 7 != 3, "Steps: open, save, close.")
    )
    labels = F.array_compact(
        F.array(F.col("o_orderpriority"), F.when(k % 4 == 0, "Bug"), F.when(k % 11 == 0, "Duplicate"))
    )
    return orders.select(
        _repo("o_orderkey").alias("repo"),
        number.alias("number"),
        _text("Issue ", number, " ", F.col("o_orderpriority")).alias("title"),
        body.alias("body"),
        F.when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("OPEN").alias("state"),
        _iso("o_orderdate").alias("createdAt"),
        F.when(F.col("o_orderstatus") == "F", _iso("last_ship")).alias("closedAt"),
        _login(_customer()).alias("author"),
        _nodes(F.transform(labels, lambda x: F.struct(x.alias("name")))).alias("labels"),
        _nodes(F.transform(_assignees(), _login)).alias("assignees"),
        F.struct(
            F.coalesce("n_lines", F.lit(0)).alias("totalCount"), F.col("comment").alias("nodes")
        ).alias("comments"),
        _nodes(F.col("event")).alias("timelineItems"),
    )


def _request(line: dict[str, Column]) -> Column:
    ln = line["l_linenumber"]
    person = F.when(ln % 2 == 1, _text("s", line["l_suppkey"])).alias("login")
    team = F.when(ln % 4 == 0, _text("team", line["l_suppkey"] % 5)).alias("slug")
    return F.struct(F.struct(person, team).alias("requestedReviewer"))


def _review(line: dict[str, Column]) -> Column:
    ln = line["l_linenumber"]
    return F.struct(
        _login(_supplier(line)).alias("author"),
        line["l_returnflag"].alias("state"),
        F.when(ln != 6, _iso("l_shipdate")).alias("submittedAt"),
        F.when(ln != 1, F.repeat(F.lit("x"), line["l_quantity"].cast("int"))).alias("body"),
    )


def _review_thread(line: dict[str, Column]) -> Column:
    comment = F.struct(
        _login(_supplier(line)).alias("author"),
        _text("p", line["l_partkey"]).alias("path"),
        F.repeat(F.lit("word "), line["l_quantity"].cast("int")).alias("body"),
        _iso("l_shipdate").alias("createdAt"),
    )
    return F.struct(_nodes(F.array(comment)).alias("comments"))


def raw_pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    line = _line()
    lines = _order_lines(
        spark, sf_dir, request=_request(line), review=_review(line), thread=_review_thread(line)
    )
    orders = read(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    number = F.expr("o_orderkey div 3")
    status = F.col("o_orderstatus")
    body = (
        F.when(k % 5 == 0, _text("This fixes #", k % 400, " and closes #", k % 300))
        .when(k % 5 == 1, F.repeat(F.lit("why "), 30))
        .when(k % 5 != 2, "prefix #9")
    )
    ordered = F.col("o_orderdate").cast("timestamp")

    def after_hours(hours: Column) -> Column:
        return format_iso(F.timestamp_micros(F.unix_micros(ordered) + hours.cast("bigint") * 3_600_000_000))

    return orders.select(
        _repo("o_orderkey").alias("repo"),
        number.alias("number"),
        _text("PR ", number).alias("title"),
        body.alias("body"),
        F.when(status == "F", "MERGED").when(status == "P", "CLOSED").otherwise("OPEN").alias("state"),
        _iso("o_orderdate").alias("createdAt"),
        F.when(status == "F", after_hours(F.lit(72))).alias("mergedAt"),
        F.when(status != "O", after_hours(k % 100)).alias("closedAt"),
        _login(_customer()).alias("author"),
        _nodes(F.array(F.struct(F.col("o_orderpriority").alias("name")))).alias("labels"),
        (k % 500).alias("additions"),
        (k % 77).alias("deletions"),
        F.nullif(k % 9, F.lit(0)).alias("changedFiles"),
        _nodes(F.col("request")).alias("reviewRequests"),
        _nodes(F.col("review")).alias("reviews"),
        _nodes(F.col("thread")).alias("reviewThreads"),
    )


def raw_ci_runs(events: DataFrame) -> DataFrame:
    """CI runs out of an event table, batch or stream."""
    kind = F.col("event_type")
    e = F.col("event_id")
    at = _iso("ts")
    return events.select(
        _repo("event_id").alias("repo"),
        e.alias("id"),
        F.when(kind == "error", "failure")
        .when(kind.isin("purchase", "click"), "success")
        .when(kind == "view", "cancelled")
        .alias("conclusion"),
        F.when(kind == "signup", "in_progress").otherwise("completed").alias("status"),
        _login(F.when(F.col("user_id") % 29 != 0, _text("u", F.col("user_id")))).alias("triggering_actor"),
        _text("wf", F.get_json_object("props", "$.k").cast("int") % 10).alias("name"),
        _sha(e).alias("head_sha"),
        _text("b", e % 7).alias("head_branch"),
        at.alias("created_at"),
        at.alias("updated_at"),
        F.when(e % 4 == 0, F.array(F.struct((e % 50).alias("number"))))
        .otherwise(F.array().cast("array<struct<number:bigint>>"))
        .alias("pull_requests"),
    )


def raw_ci_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    ln = F.col("l_linenumber")

    def step(name: str, failed: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), F.when(failed, "failure").otherwise("success").alias("conclusion"))

    return lines.select(
        _repo("l_orderkey").alias("repo"),
        F.col("l_orderkey").alias("run_id"),
        (100 - ln).cast("bigint").alias("ordinal"),
        _text("job", ln, "-", F.col("l_partkey")).alias("name"),
        F.when(flag == "R", "failure").when(flag == "A", "success").alias("conclusion"),
        _iso("l_shipdate").alias("started_at"),
        _iso("l_shipdate").alias("completed_at"),
        F.array(step("build", F.col("l_linestatus") == "O"), step("test", ln % 2 == 0)).alias("steps"),
    )


def _conversation_time(minutes: Column) -> Column:
    start = 1_704_067_200  # 2024-01-01T00:00:00Z
    return format_iso(F.timestamp_seconds(F.lit(start) + F.col("conv_id") * 3600 + minutes * 60))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: opening turn, reply count, replies as an array."""
    turns = read(spark, sf_dir, "conversations")
    opening = turns.filter("turn = 0").select(
        "conv_id", F.col("text").alias("opening_text"), F.col("role").alias("opening_role")
    )
    replies = turns.filter("turn >= 1")
    nested = replies.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_replies"),
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("replies"),
    )
    return opening.join(nested, "conv_id", "left")


def _reply_time(turn: Column) -> Column:
    return F.when(turn % 4 != 3, _conversation_time(turn))


def conversation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as landed issues."""
    c = F.col("conv_id")

    def comment(r: Column) -> Column:
        return F.struct(
            (c * 100 + r["turn"]).alias("databaseId"),
            _login(r["role"]).alias("author"),
            r["text"].alias("body"),
            _reply_time(r["turn"]).alias("createdAt"),
        )

    return _conversations(spark, sf_dir).select(
        _repo("conv_id").alias("repo"),
        c.alias("number"),
        _text("Conversation ", c).alias("title"),
        F.col("opening_text").alias("body"),
        F.lit("OPEN").alias("state"),
        _conversation_time(F.lit(0)).alias("createdAt"),
        F.lit(None).cast("string").alias("closedAt"),
        _login(F.when(c % 13 != 0, F.col("opening_role"))).alias("author"),
        _nodes(F.array(F.struct(_text("l", c % 3).alias("name")), F.struct(F.lit("chat").alias("name")))).alias("labels"),
        F.lit(None).cast("STRUCT<nodes:ARRAY<STRUCT<login:STRING>>>").alias("assignees"),
        F.struct(
            F.coalesce("n_replies", F.lit(0)).alias("totalCount"), F.transform("replies", comment).alias("nodes")
        ).alias("comments"),
        F.lit(None)
        .cast(
            "STRUCT<nodes:ARRAY<STRUCT<__typename:STRING, createdAt:STRING, assignee:STRUCT<login:STRING>, "
            "label:STRUCT<name:STRING>, source:STRUCT<number:BIGINT, title:STRING, state:STRING>>>>"
        )
        .alias("timelineItems"),
    )


def conversation_discussions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as landed discussions: answered in a comment, in a nested reply, or not."""
    c = F.col("conv_id")

    def comment(r: Column) -> Column:
        return F.struct(
            r["text"].alias("body"), _reply_time(r["turn"]).alias("createdAt"), _login(r["role"]).alias("author")
        )

    nodes = F.transform("replies", comment)
    nested_reply = F.struct(
        _text("Nested answer ", c).alias("body"),
        _conversation_time(F.lit(90)).alias("createdAt"),
        _login(F.lit("helper")).alias("author"),
    )
    return _conversations(spark, sf_dir).select(
        _repo("conv_id").alias("repo"),
        c.alias("number"),
        _text("Conversation ", c).alias("title"),
        F.col("opening_text").alias("body"),
        _conversation_time(F.lit(0)).alias("createdAt"),
        F.when(c % 13 != 0, _login(F.col("opening_role"))).alias("author"),
        F.when(c % 3 == 0, F.get(nodes, 0)).when(c % 3 == 1, nested_reply).alias("answer"),
        F.struct(F.coalesce("n_replies", F.lit(0)).alias("totalCount"), nodes.alias("nodes")).alias("comments"),
    )


def document_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as threads with whole texts."""
    d = F.col("doc_id")
    opening = F.struct(
        F.lit("c0").alias("id"),
        F.col("source").alias("author"),
        F.lit("").alias("timestamp"),
        F.col("text").alias("body"),
        F.lit(False).alias("is_accepted"),
        F.lit("body").alias("role"),
    )
    return read(spark, sf_dir, "documents").select(
        F.when(d % 2 == 0, "issue").otherwise("discussion").alias("source"),
        _repo("doc_id").alias("repo"),
        d.alias("number"),
        _text("Doc ", d).alias("title"),
        _text("https://example.org/", d).alias("url"),
        F.timestamp_seconds(F.lit(1_704_067_200) + d * 60).alias("created_at"),
        F.col("text").alias("thread_text"),
        F.array(opening).alias("comments"),
    )


def _two_digits(value: Column) -> Column:
    return F.concat(F.lit("0."), F.lpad(value.cast("string"), 2, "0"))


def document_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorer replies per document and stage: valid, wrapped, junk and missing ones."""
    d = F.col("doc_id")
    docs = (
        read(spark, sf_dir, "documents")
        .select("doc_id")
        .join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
        .withColumn("quality", F.coalesce("quality", F.lit(0)))
    )
    letter = F.substring(F.lit("ABCDEFGHIJK"), (d % 11 + 1).cast("int"), F.lit(1))
    s1 = _two_digits(50 + F.col("quality") * 30 + d % 20)
    stage1 = (
        F.when(d % 10 == 0, F.lit(None))
        .when(d % 10 == 1, "not json at all")
        .when(d % 10 == 2, 'Sure: {"contains_qa": true, "category": "b", "confidence": 0.9} done')
        .when(d % 10 == 3, '{"contains_qa": false, "category": "A", "confidence": 0.4}')
        .when(d % 10 == 4, '{"contains_qa": true, "category": "Z", "confidence": 0.9}')
        .when(d % 10 == 5, _text('{"contains_qa": 1, "category": "', letter, '", "confidence": "', s1, '"}'))
        .otherwise(_text('{"contains_qa": true, "category": "', letter, '", "confidence": ', s1, "}"))
    )
    s2 = _two_digits(60 + d % 40)
    full = _text(
        '{"question_id": "Q', d % 37 + 1, '", "question_text": "Who owns file ', d,
        '", "question_author": "u', d % 17, '", "question_source": "comment", "question_comment_id": "c0", ',
        '"answer_text": "owner ', d % 5, '", "answer_author": "u', d % 11, '", "answer_comment_id": "c0", ',
        '"answer_is_accepted": ', F.when(d % 2 == 0, "true").otherwise("false"), ', "confidence": ', s2,
        ', "reasoning": "named"}',
    )
    stage2 = (
        F.when(d % 7 == 0, F.lit(None))
        .when(d % 7 == 1, '{"question_id": "NONE", "confidence": 0.95}')
        .when(d % 7 == 2, "junk {")
        .otherwise(full)
    )
    replies = F.array(
        F.struct(F.lit(1).alias("stage"), stage1.alias("response_text")),
        F.struct(F.lit(2).alias("stage"), stage2.alias("response_text")),
    )
    return docs.select(
        _repo("doc_id").alias("repo"),
        F.when(d % 2 == 0, "issue").otherwise("discussion").alias("source"),
        d.alias("number"),
        F.lit("table").alias("model"),
        F.inline(replies),
    ).filter("response_text IS NOT NULL")


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Natural pairs: each user turn with the assistant turn after it."""
    turns = read(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question_text"))
    answered = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer_text")
    )
    c, t = F.col("conv_id"), F.col("turn")

    def post(ident: str, author: str, text: str) -> Column:
        return F.struct(
            F.lit(ident).alias("id"),
            F.lit(author).alias("author"),
            F.lit("").alias("timestamp"),
            F.col(text).alias("body"),
            F.lit(ident == "c1").alias("is_accepted"),
            F.lit("comment").alias("role"),
        )

    return asked.join(answered, ["conv_id", "turn"]).select(
        F.when(c % 2 == 0, "issue").otherwise("discussion").alias("source"),
        _repo("conv_id").alias("repo"),
        (c * 1000 + t).alias("number"),
        F.when(c % 9 != 0, _text("Conversation ", c)).alias("title"),
        _text("Q", (c + t) % 37 + 1).alias("question_id"),
        "question_text",
        F.when(c % 2 == 0, "c0").otherwise("").alias("question_comment_id"),
        "answer_text",
        F.lit("assistant").alias("answer_author"),
        F.when(c % 4 == 0, "c1").otherwise("").alias("answer_comment_id"),
        ((c * 7 + t) % 45 + 55).cast("double").__truediv__(100).alias("confidence"),
        F.substring(F.lit("ABCDEFGHIJK"), (c % 11 + 1).cast("int"), F.lit(1)).alias("stage1_category"),
        F.array(post("c0", "user", "question_text"), post("c1", "assistant", "answer_text")).alias("comments"),
    )


def verification_requests(pairs_with_id: DataFrame) -> DataFrame:
    """Decisions on pairs, several for some, a few with an unknown status."""
    n = F.col("number")

    def request(day: int, status: str, note: str | None) -> Column:
        return F.struct(
            F.lit(status).alias("status"),
            F.lit(note).cast("string").alias("note"),
            F.timestamp_seconds(F.lit(1_706_745_600 + day * 86_400) + n * 60).alias("verified_at"),
        )

    entries = F.array_compact(
        F.array(
            F.when(n % 3 == 0, request(0, "accepted", None)),
            F.when(n % 6 == 0, request(1, "rejected", "wrong")),
            F.when(n % 5 == 0, request(2, "accepted", "ok")),
            F.when(n % 7 == 0, request(3, "maybe", None)),
        )
    )
    return pairs_with_id.select("pair_id", F.inline(entries))
