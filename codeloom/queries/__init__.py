"""Queries over the given tables, grouped by subject."""

from importlib import import_module

SUBJECTS = ("corpus", "textual", "trees", "lowered", "encoded", "checks", "evaluation", "storage")


def load_all() -> None:
    for subject in SUBJECTS:
        import_module(f"codeloom.queries.{subject}")
