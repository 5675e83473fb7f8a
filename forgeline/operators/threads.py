"""Discussion threads: structured comments and readable text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeline.functions.text import excerpt, or_empty, present
from forgeline.functions.times import format_iso, parse_iso
from forgeline.settings import Settings

UNKNOWN_AUTHOR = "unknown"
UNKNOWN_COMMENTER = "?"
COMMENT_DDL = (
    "STRUCT<id:STRING, author:STRING, timestamp:STRING, body:STRING, is_accepted:BOOLEAN, role:STRING>"
)
COMMENTS_DDL = f"ARRAY<{COMMENT_DDL}>"


def _comment(
    ident: Column, author: Column, at: Column, body: Column, accepted: Column, role: str
) -> Column:
    return F.struct(
        ident.alias("id"),
        author.alias("author"),
        F.coalesce(at, F.lit("")).alias("timestamp"),
        F.coalesce(body, F.lit("")).alias("body"),
        accepted.alias("is_accepted"),
        F.lit(role).alias("role"),
    )


def _comment_id(position: Column) -> Column:
    return F.concat(F.lit("c"), position.cast("string"))


def issue_comments(settings: Settings = Settings()) -> Column:
    """c0 is the issue body, c1.. its kept comments, over an ``issues`` row."""
    opening = _comment(
        F.lit("c0"),
        F.coalesce("reporter", F.lit(UNKNOWN_AUTHOR)),
        format_iso(F.col("created_at")),
        excerpt(F.col("body"), settings.thread_body_chars),
        F.lit(False),
        "body",
    )
    listed = F.col("comments")
    if settings.thread_comments is not None:
        listed = F.slice(listed, 1, settings.thread_comments)
    replies = F.transform(
        listed,
        lambda c, i: _comment(
            _comment_id(i + 1),
            F.coalesce(c["author"], F.lit(UNKNOWN_COMMENTER)),
            format_iso(c["created_at"]),
            excerpt(c["body"], settings.thread_body_chars),
            F.lit(False),
            "comment",
        ),
    )
    return F.concat(F.array(opening), replies)


def discussion_comments() -> Column:
    """c0 is the discussion body, c1.. its comments, over a landed discussion.

    A comment equal to the answer in body and author is the accepted one. An answer
    that matches none, such as a nested reply, is appended as the last comment.
    """
    nodes = F.coalesce(
        F.col("comments.nodes"),
        F.from_json(F.lit("[]"), "ARRAY<STRUCT<body:STRING, createdAt:STRING, author:STRUCT<login:STRING>>>"),
    )
    answer = F.col("answer")

    def body_of(c: Column) -> Column:
        return F.coalesce(c["body"], F.lit(""))

    def is_answer(c: Column) -> Column:
        same_author = c["author"]["login"].eqNullSafe(answer["author"]["login"])
        return F.coalesce(answer.isNotNull() & (body_of(c) == answer["body"]) & same_author, F.lit(False))

    opening = _comment(
        F.lit("c0"),
        F.coalesce(F.col("author.login"), F.lit(UNKNOWN_AUTHOR)),
        F.col("createdAt"),
        F.col("body"),
        F.lit(False),
        "body",
    )
    replies = F.transform(
        nodes,
        lambda c, i: _comment(
            _comment_id(i + 1),
            F.coalesce(c["author"]["login"], F.lit(UNKNOWN_AUTHOR)),
            c["createdAt"],
            c["body"],
            is_answer(c),
            "comment",
        ),
    )
    appended = _comment(
        _comment_id(F.size(nodes) + 1),
        F.coalesce(answer["author"]["login"], F.lit(UNKNOWN_AUTHOR)),
        answer["createdAt"],
        answer["body"],
        F.lit(True),
        "comment",
    )
    unmatched = answer.isNotNull() & ~F.exists(nodes, is_answer)
    return F.concat(
        F.array(opening),
        replies,
        F.when(unmatched, F.array(appended)).otherwise(F.array().cast(COMMENTS_DDL)),
    )


# Marks in the text form of a thread.
COMMENTS_MARK = "--- COMMENTS ---"
COMMENT_END = "---"
NO_BODY = "[no body]"
ACCEPTED_MARK = "[ACCEPTED ANSWER]"


def thread_text(headers: list[Column]) -> Column:
    """Header lines, the opening post, then one block per entry of ``comments``."""
    comments = F.col("comments")
    opening = F.get(comments, 0)

    def head_line(c: Column) -> Column:
        tag = F.when(c["is_accepted"], F.lit(f" {ACCEPTED_MARK}")).otherwise("")
        at = F.when(present(c["timestamp"]), F.concat(F.lit(" "), c["timestamp"])).otherwise("")
        return F.concat(F.lit("["), c["id"], F.lit("]"), tag, F.lit(" @"), c["author"], at, F.lit(":"))

    blocks = F.flatten(
        F.transform(
            F.slice(comments, F.lit(2), F.size(comments)),
            lambda c: F.array(head_line(c), c["body"], F.lit(COMMENT_END)),
        )
    )
    lines = F.array(
        *headers,
        F.lit(""),
        F.lit("[c0]"),
        F.when(present(opening["body"]), opening["body"]).otherwise(NO_BODY),
        F.lit(""),
        F.lit(COMMENTS_MARK),
    )
    return F.array_join(F.concat(lines, blocks), "\n")


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(name), F.coalesce(value, F.lit("")))


def issue_threads(issues: DataFrame, settings: Settings = Settings(), url_base: str = "https://github.com") -> DataFrame:
    """``raw_threads`` rows of issues with at least one comment. Narrow: no shuffle."""
    built = (
        issues.filter("comment_count >= 1")
        .withColumn("comments", issue_comments(settings))
        .withColumn("_opening", F.get("comments", 0))
    )
    headers = [
        F.concat(F.lit("ISSUE #"), F.col("number").cast("string"), F.lit(": "), F.coalesce("title", F.lit(""))),
        _header("Author: ", F.col("_opening.author")),
        _header("Date: ", F.col("_opening.timestamp")),
        _header("Labels: ", F.array_join("labels", ", ")),
        _header("State: ", F.col("state")),
    ]
    return built.select(
        F.lit("issue").alias("source"),
        "repo",
        "number",
        "title",
        thread_text(headers).alias("thread_text"),
        "comments",
        "comment_count",
        "labels",
        "state",
        "created_at",
        "closed_at",
        "reporter",
        F.concat(F.lit(f"{url_base}/"), "repo", F.lit("/issues/"), F.col("number").cast("string")).alias("url"),
    )


def discussion_threads(raw: DataFrame, url_base: str = "https://github.com") -> DataFrame:
    """``raw_threads`` rows of all discussions. Narrow: no shuffle."""
    built = raw.withColumn("_total", F.coalesce(F.col("comments.totalCount"), F.lit(0))).withColumn(
        "comments", discussion_comments()
    )
    headers = [
        F.concat(
            F.lit("DISCUSSION #"), F.col("number").cast("string"), F.lit(": "), F.coalesce("title", F.lit(""))
        ),
        _header("Author: ", F.get("comments", 0)["author"]),
        _header("Date: ", F.get("comments", 0)["timestamp"]),
    ]
    return built.select(
        F.lit("discussion").alias("source"),
        "repo",
        "number",
        "title",
        thread_text(headers).alias("thread_text"),
        "comments",
        F.col("_total").alias("comment_count"),
        F.col("answer").isNotNull().alias("has_accepted_answer"),
        parse_iso(F.col("createdAt")).alias("created_at"),
        F.coalesce(F.col("author.login"), F.lit(UNKNOWN_AUTHOR)).alias("author"),
        F.concat(F.lit(f"{url_base}/"), "repo", F.lit("/discussions/"), F.col("number").cast("string")).alias("url"),
    )


def all_threads(issue_rows: DataFrame, discussion_rows: DataFrame) -> DataFrame:
    return issue_rows.unionByName(discussion_rows, allowMissingColumns=True)


# Fixed pattern: first line of a comment block, with or without its [cN] id.
_BLOCK_HEAD = r"^(?:\[c\d+\] )?(\[ACCEPTED ANSWER\] )?@(\S+)(?: ([^\n]*?))?:?(?:\n|$)"
_BLOCK_START = r"\n---\n(?=(?:\[c\d+\] )?(?:\[ACCEPTED|@))"


def comments_from_text(threads: DataFrame) -> DataFrame:
    """Comments read back from ``thread_text``, one row each, opening post first.

    For records stored without structured comments. Reads both layouts, with and
    without comment ids. Columns: source, repo, number, position, author,
    timestamp, body, is_accepted.
    """
    mark = f"\n{COMMENTS_MARK}\n"
    # An empty comment section leaves the mark at the very end of the text.
    text = F.concat("thread_text", F.lit("\n"))
    header = F.substring_index(text, mark, 1)
    section = F.when(
        F.contains(text, F.lit(mark)), F.substring(text, F.char_length(header) + len(mark) + 1, 2**31 - 1)
    ).otherwise("")
    body = F.trim(
        F.regexp_replace(
            F.regexp_replace(header, r"^[^\n]*\n?(?:(?:Author|Labels|State|Date):[^\n]*\n?)*", ""),
            r"^\s*(?:\[c0\]\n)?",
            "",
        )
    )
    blocks = F.filter(
        F.split(F.regexp_replace(section, r"\n---\s*$", ""), _BLOCK_START),
        lambda b: F.rlike(b, F.lit(_BLOCK_HEAD)),
    )
    first = F.struct(
        F.regexp_extract(header, r"(?m)^Author: ?(.*)$", 1).alias("author"),
        F.regexp_extract(header, r"(?m)^Date: ?(.*)$", 1).alias("timestamp"),
        F.regexp_replace(body, r"\s+$", "").alias("body"),
        F.lit(False).alias("is_accepted"),
    )
    rest = F.transform(
        blocks,
        lambda b: F.struct(
            F.regexp_replace(F.regexp_extract(b, _BLOCK_HEAD, 2), ":$", "").alias("author"),
            F.regexp_extract(b, _BLOCK_HEAD, 3).alias("timestamp"),
            F.regexp_replace(
                F.regexp_replace(b, _BLOCK_HEAD, ""), r"^\s+|\s+$", ""
            ).alias("body"),
            (F.regexp_extract(b, _BLOCK_HEAD, 1) != "").alias("is_accepted"),
        ),
    )
    return threads.select(
        "source", "repo", "number", F.posexplode(F.concat(F.array(first), rest)).alias("position", "c")
    ).select("source", "repo", "number", "position", "c.*")


def issue_mentions(threads: DataFrame, text: str = "thread_text") -> DataFrame:
    """Edges from a thread to every issue number its text mentions."""
    from forgeline.functions.refs import mentions

    return threads.select("source", "repo", "number", F.explode(mentions(F.col(text))).alias("mentioned"))
