"""Developer-activity analytics expressed as Spark DataFrame jobs."""

from forgeline.settings import Settings

__all__ = ["Settings"]
