"""The question taxonomy as two small dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_QUESTION = "NONE"

# Category names.
CATEGORIES = {
    "A": "People & Awareness",
    "B": "Code Changes",
    "C": "Work Item Progress",
    "D": "Broken Builds",
    "E": "Test Cases",
    "F": "Pull Requests",
    "G": "Bug Management",
    "H": "CI/CD",
    "I": "Security & Quality",
    "J": "Onboarding",
    "K": "Cross-Artifact Synthesis",
}

# Category, question id and description.
QUESTIONS = (
    ("A", "Q1", "Who is currently working on a task or feature"),
    ("A", "Q2", "What a specific coworker is working on right now"),
    ("A", "Q3", "How much work a person has contributed"),
    ("A", "Q4", "Who made a specific code change (person-focused)"),
    ("A", "Q5", "Who has the knowledge to do a code review"),
    ("A", "Q6", "What a person or team has been working on recently"),
    ("A", "Q7", "Which code reviews are assigned to a specific person"),
    ("B", "Q8", "How a piece of code has evolved over time"),
    ("B", "Q9", "Why a specific change was introduced"),
    ("B", "Q10", "Who made a change and why"),
    ("B", "Q11", "Which classes or files a team has been editing"),
    ("B", "Q12", "What changed in recently resolved work items related to someone"),
    ("B", "Q13", "Who else is working on the same files"),
    ("B", "Q14", "What changed between two builds and who changed it"),
    ("B", "Q15", "Who has modified a specific file or class"),
    ("B", "Q16", "Who is using an API that is about to change"),
    ("B", "Q17", "Who originally created a specific API or component"),
    ("B", "Q18", "Who most recently modified a file (latest owner)"),
    ("B", "Q19", "Who has modified a file most frequently (primary owner)"),
    ("B", "Q20", "Who to contact about an unfamiliar part of the codebase"),
    ("B", "Q21", "Which files or classes have changed recently"),
    ("B", "Q22", "Which API methods have been added, changed, or removed"),
    ("B", "Q23", "Which file or class has changed most frequently"),
    ("B", "Q24", "Which code the asker worked on uses a specific pattern"),
    ("B", "Q25", "Which code related to the asker has changed recently"),
    ("B", "Q26", "How recent changes affect something the asker is building"),
    ("B", "Q27", "What code is related to or affected by a specific change"),
    ("C", "Q28", "What recent activity has happened on a specific issue"),
    ("C", "Q29", "Which features or functions have been actively changing"),
    ("C", "Q30", "Whether blocking issues in a milestone have been resolved"),
    ("C", "Q31", "Whether work is progressing on planned items"),
    ("D", "Q32", "What change or commit caused a build or test to fail"),
    ("D", "Q33", "Who is responsible for breaking a build"),
    ("D", "Q34", "Who most recently changed a failing test"),
    ("D", "Q35", "Which specific changes caused test failures"),
    ("E", "Q36", "Who owns or is responsible for a specific test"),
    ("E", "Q37", "How tests relate to specific packages or classes"),
    ("F", "Q47", "Who should review a specific PR"),
    ("F", "Q48", "Why a PR was merged or rejected"),
    ("F", "Q49", "Which PRs are blocking an issue from being resolved"),
    ("F", "Q50", "How long PR review typically takes in an area"),
    ("F", "Q51", "Which PRs have been waiting longest without review"),
    ("F", "Q52", "Which bugs a PR is likely to fix"),
    ("G", "Q53", "Whether a bug has been reported before (duplicate detection)"),
    ("G", "Q54", "Who should be assigned to triage or fix a bug"),
    ("G", "Q55", "Which file or component is responsible for a bug"),
    ("G", "Q56", "Which commit introduced a regression"),
    ("G", "Q57", "The severity or priority of a bug relative to others"),
    ("G", "Q58", "Which bugs are related without being duplicates"),
    ("G", "Q59", "How long bugs in an area typically take to fix"),
    ("G", "Q60", "The full history and lifecycle of a bug"),
    ("H", "Q61", "Whether a test failure is flaky or a real regression"),
    ("H", "Q62", "Which CI stage or step is the bottleneck"),
    ("H", "Q63", "How often a component causes build failures"),
    ("H", "Q64", "Which contributor's changes most frequently break CI"),
    ("I", "Q65", "Whether a change introduces a known vulnerability"),
    ("I", "Q66", "Which dependencies have known vulnerabilities"),
    ("I", "Q67", "Which parts of the codebase have low test coverage"),
    ("I", "Q68", "Whether a patch follows security or style conventions"),
    ("J", "Q69", "Where to start contributing to a specific component"),
    ("J", "Q70", "What the unwritten conventions of the codebase are"),
    ("J", "Q71", "Which issues are suitable for new contributors"),
    ("J", "Q72", "What the contribution workflow looks like end to end"),
    ("K", "Q73", "Given a stack trace, which recent commits are suspicious"),
    ("K", "Q74", "Which developer has the most context on a specific bug"),
    ("K", "Q75", "Which open bugs are likely to recur based on patterns"),
    ("K", "Q76", "Why a PR was reverted given the full project context"),
    ("K", "Q77", "Which changes historically co-occur with bugs in an area"),
    ("K", "Q78", "What the blast radius of a change to a file would be"),
)

# Fixed value: description of the answer "no question matches".
NO_QUESTION_DESCRIPTION = "Does not contain a matching question"
# Retired question numbers, kept inactive so that old rows resolve.
RETIRED = range(38, 47)


def questions() -> dict[str, str]:
    """Question id to description, ending with NONE."""
    return {qid: text for _, qid, text in QUESTIONS} | {NO_QUESTION: NO_QUESTION_DESCRIPTION}


def category_questions(key: str) -> list[str]:
    return [qid for category, qid, _ in QUESTIONS if category == key]


def question_dimension(spark: SparkSession) -> DataFrame:
    """(category, category_name, question_id, description, active): 79 rows."""
    rows = [(key, CATEGORIES[key], qid, text, True) for key, qid, text in QUESTIONS]
    rows.append((None, None, NO_QUESTION, NO_QUESTION_DESCRIPTION, True))
    rows += [(None, None, f"Q{n}", None, False) for n in RETIRED]
    return spark.createDataFrame(
        rows,
        "category STRING, category_name STRING, question_id STRING, description STRING, active BOOLEAN",
    )


def usage(counts: DataFrame) -> DataFrame:
    """The listing of all questions, retired ones and NONE included, with how many pairs each has.

    ``counts`` has one row per question id at most.
    """
    listing = question_dimension(counts.sparkSession)
    return listing.join(counts.select("question_id", "n"), "question_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def category_dimension(spark: SparkSession) -> DataFrame:
    """(category, category_name, question_list): 11 rows."""
    text = questions()
    rows = [
        (key, name, "\n".join(f"{qid}: {text[qid]}" for qid in category_questions(key)))
        for key, name in CATEGORIES.items()
    ]
    return spark.createDataFrame(rows, "category STRING, category_name STRING, question_list STRING")


def category_list() -> str:
    return "\n".join(f"{key} - {name}" for key, name in CATEGORIES.items())


def is_category(value: Column) -> Column:
    return value.isin(*CATEGORIES)


def with_description(df: DataFrame) -> DataFrame:
    """Attach the description; the dimension holds 79 rows, so it is broadcast."""
    dim = question_dimension(df.sparkSession).select("question_id", "description", "category_name")
    return df.join(F.broadcast(dim), "question_id", "left")
