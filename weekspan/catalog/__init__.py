"""All registered queries and their oracle SQL."""

from importlib import import_module

MODULES = ("views", "logs", "weekly", "scored", "sequences", "sampling", "clusters", "models")


def load() -> tuple[dict, dict]:
    from weekspan.catalog import base

    for m in MODULES:
        import_module(f"weekspan.catalog.{m}")
    return dict(base.QUERIES), base.oracle_texts()
