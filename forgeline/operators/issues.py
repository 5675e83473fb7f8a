"""Issues: landed record to analysis row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeline.functions import refs
from forgeline.functions.text import or_empty, present, priority_label
from forgeline.functions.times import hours_between, parse_iso
from forgeline.settings import Settings


def with_source_labels(raw: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Keep issues carrying one of the labels; no labels keeps all."""
    if not labels:
        return raw
    wanted = F.array(*[F.lit(label) for label in labels])
    return raw.filter(F.arrays_overlap(or_empty(F.col("labels.nodes.name")), wanted))


def _of_kind(kind: str):
    return lambda e: e["__typename"] == kind


def _label_name(e: Column) -> Column:
    return F.coalesce(e["label"]["name"], F.lit(""))


def _is_assignment(e: Column) -> Column:
    return _of_kind("AssignedEvent")(e) & present(e["assignee"]["login"])


def fold_timeline(df: DataFrame, nodes: str, bug_labels: tuple[str, ...]) -> DataFrame:
    """Add histories and first-response facts of an ordered event list to each row.

    "First" and "after" follow list positions, not timestamps. Adds
    assignment_history, label_history, cross_refs, first_bug_label_at,
    first_assignee_after_bug_label and last_closed_event_at.
    """
    events = F.coalesce(F.col(nodes), F.from_json(F.lit("[]"), TIMELINE_DDL))
    wanted = [b.lower() for b in bug_labels]

    def is_bug_label(e: Column) -> Column:
        return _of_kind("LabeledEvent")(e) & F.lower(_label_name(e)).isin(*wanted)

    # Each step is a column of its own, so that the next one does not repeat it per event.
    staged = df.withColumn("_events", events)
    if bug_labels:
        placed = F.transform("_events", lambda e, i: F.struct(i.alias("pos"), e.alias("event")))
        staged = staged.withColumn("_placed", placed).withColumn(
            "_first_bug", F.get(F.filter("_placed", lambda p: is_bug_label(p["event"])), 0)
        )
        # what follows is cut out once; a position compared in a lambda is found again for every event
        after = F.slice("_events", F.col("_first_bug.pos") + 2, F.size("_events"))
        first_assignee = F.get(F.filter(after, _is_assignment), 0)["assignee"]["login"]
        first_bug_at = parse_iso(F.col("_first_bug.event.createdAt"))
    else:
        first_assignee = F.lit(None).cast("string")
        first_bug_at = F.lit(None).cast("timestamp")

    facts = {
        "assignment_history": F.transform(
            F.filter("_events", _is_assignment),
            lambda e: F.struct(e["assignee"]["login"].alias("assignee"), parse_iso(e["createdAt"]).alias("at")),
        ),
        "label_history": F.transform(
            F.filter("_events", _of_kind("LabeledEvent")),
            lambda e: F.struct(_label_name(e).alias("label"), parse_iso(e["createdAt"]).alias("at")),
        ),
        "cross_refs": F.transform(
            F.filter("_events", _of_kind("CrossReferencedEvent")),
            lambda e: F.struct(
                e["source"]["number"].alias("ref_number"),
                e["source"]["title"].alias("ref_title"),
                F.lower(F.coalesce(e["source"]["state"], F.lit(""))).alias("ref_state"),
                parse_iso(e["createdAt"]).alias("at"),
            ),
        ),
        "first_bug_label_at": first_bug_at,
        "first_assignee_after_bug_label": first_assignee,
        "last_closed_event_at": parse_iso(
            F.try_element_at(F.filter("_events", _of_kind("ClosedEvent")), F.lit(-1))["createdAt"]
        ),
    }
    return staged.withColumns(facts).drop("_events", "_placed", "_first_bug")


FOLDED = (
    "assignment_history",
    "label_history",
    "cross_refs",
    "first_bug_label_at",
    "first_assignee_after_bug_label",
    "last_closed_event_at",
)
TIMELINE_DDL = (
    "ARRAY<STRUCT<__typename:STRING, createdAt:STRING, assignee:STRUCT<login:STRING>, "
    "label:STRUCT<name:STRING>, source:STRUCT<number:BIGINT, title:STRING, state:STRING>>>"
)
COMMENTS_DDL = (
    "ARRAY<STRUCT<databaseId:BIGINT, author:STRUCT<login:STRING>, body:STRING, createdAt:STRING>>"
)


def long_enough(nodes: Column, min_chars: int) -> Column:
    """Landed comments long enough to matter."""
    listed = F.coalesce(nodes, F.from_json(F.lit("[]"), COMMENTS_DDL))
    if min_chars <= 0:
        return listed
    return F.filter(listed, lambda c: F.char_length(F.coalesce(c["body"], F.lit(""))) >= min_chars)


def comment_list(nodes: Column, duplicates: Column, related: Column) -> Column:
    """Comments with the references that each of them makes."""
    return F.zip_with(
        nodes,
        F.arrays_zip(duplicates.alias("d"), related.alias("r")),
        lambda c, found: F.struct(
            c["databaseId"].alias("id"),
            c["author"]["login"].alias("author"),
            F.coalesce(c["body"], F.lit("")).alias("body"),
            parse_iso(c["createdAt"]).alias("created_at"),
            found["d"].alias("duplicate_refs"),
            found["r"].alias("related_refs"),
        ),
    )


def normalise_issues(
    raw: DataFrame,
    settings: Settings = Settings(),
    strict_priority: bool = False,
    refs_in_short_comments: bool = False,
    with_last_closed_event: bool = False,
) -> DataFrame:
    """Landed issues to the ``issues`` table. Narrow: no shuffle.

    ``refs_in_short_comments`` also reads references from comments too short to
    keep; by default they are lost together with the comment. References are columns of
    their own on the way, so that a reader of them alone does not have the comments made.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    base = fold_timeline(raw, "timelineItems.nodes", settings.bug_labels).select(
        "repo",
        "number",
        "title",
        body.alias("body"),
        F.lower("state").alias("state"),
        parse_iso(F.col("createdAt")).alias("created_at"),
        parse_iso(F.col("closedAt")).alias("closed_at"),
        F.col("author.login").alias("reporter"),
        or_empty(F.col("labels.nodes.name")).alias("labels"),
        or_empty(F.col("assignees.nodes.login")).alias("assignees"),
        *FOLDED,
        long_enough(F.col("comments.nodes"), settings.min_text_chars).alias("_kept"),
        F.coalesce(F.col("comments.totalCount"), F.lit(0)).alias("comment_count"),
        refs.duplicate_refs(body).alias("_dup"),
        refs.related_refs(body).alias("_rel"),
        *(
            [long_enough(F.col("comments.nodes"), 0).alias("_every")]
            if refs_in_short_comments
            else []
        ),
    )

    def made(by: str, find: Callable[[Column], Column]) -> Column:
        return F.transform(by, lambda c: find(c["body"]))

    source = "_every" if refs_in_short_comments else "_kept"
    base = base.withColumns(
        {
            "_kept_dup": made("_kept", refs.duplicate_refs),
            "_kept_rel": made("_kept", refs.related_refs),
            **(
                {"_every_dup": made("_every", refs.duplicate_refs), "_every_rel": made("_every", refs.related_refs)}
                if refs_in_short_comments
                else {}
            ),
        }
    )
    labels_lower = F.transform("labels", F.lower)
    return base.select(
        "repo",
        "number",
        "title",
        "body",
        "state",
        "created_at",
        "closed_at",
        "reporter",
        "labels",
        "assignees",
        "first_assignee_after_bug_label",
        "first_bug_label_at",
        (F.array_contains(labels_lower, "duplicate") | (F.size("_dup") > 0)).alias("is_duplicate"),
        F.concat("_dup", F.flatten(f"{source}_dup")).alias("duplicate_of"),
        F.concat("_rel", F.flatten(f"{source}_rel")).alias("related_issues"),
        "cross_refs",
        priority_label(F.col("labels"), strict_priority).alias("priority_label"),
        hours_between(F.col("created_at"), F.col("closed_at")).alias("time_to_close_hours"),
        "assignment_history",
        "label_history",
        comment_list(F.col("_kept"), F.col("_kept_dup"), F.col("_kept_rel")).alias("comments"),
        "comment_count",
        *(["last_closed_event_at"] if with_last_closed_event else []),
    )

