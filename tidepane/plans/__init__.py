"""Queries over the given tables."""

from importlib import import_module

_MODULES = [
    "triple_queries",
    "window_queries",
    "merge_queries",
    "profile_queries",
    "accuracy_queries",
    "stream_queries",
]


def load_all() -> None:
    for module in _MODULES:
        import_module(f"tidepane.plans.{module}")
