"""Registered queries over the given tables."""

from importlib import import_module

FAMILIES = (
    "text_queries",
    "chunk_queries",
    "coverage_queries",
    "feedback_queries",
    "syllabus_queries",
    "run_queries",
    "stream_queries",
)


def all_queries() -> dict:
    for family in FAMILIES:
        import_module(f"curricle.plans.{family}")
    from curricle.plans.registry import QUERIES

    return QUERIES
