"""Parameters shared by the jobs, with their default values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Defaults keep every row and whole texts; a number, where None stands, cuts to it.
    bug_labels: tuple[str, ...] = ("bug",)      # labels that open the triage clock
    source_labels: tuple[str, ...] = ()         # empty = read issues with any label
    min_text_chars: int = 0                     # shorter comments are left out
    rationale_chars: int = 100                  # a description this long explains itself
    inducing_window_days: int = 365
    question_excerpt_chars: int | None = None
    candidate_excerpt_chars: int | None = None
    thread_body_chars: int | None = None
    thread_comments: int | None = None
    prompt_thread_chars: int | None = None      # context window of the scorer
    confidence_threshold: float = 0.55
    top_files_per_author: int = 20              # size of the top-paths report
    experts_per_path: int = 5
    profiles_per_assignment: int = 10
    files_per_profile: int | None = None         # of those in the report
    review_samples_min: int = 5
    review_samples_shown: int | None = None
    negative_seed: int = 42


# How many nested nodes one request of the hosting service returns; only for
# the opt-in bounded reads of ``sources.landing``.
LANDED_LIMITS = {
    "labels": 15,
    "assignees": 10,
    "issue_comments": 50,
    "timeline": 50,
    "review_requests": 20,
    "reviews": 50,
    "review_threads": 20,
    "thread_comments": 5,
    "discussion_comments": 15,
    "commit_files": 300,
    "run_jobs": 100,
}
