"""The operators applied to the standard tables, with SQL for comparison."""

from __future__ import annotations


def catalog() -> dict:
    """name -> (query of (spark, sf_dir), SQL or None)."""
    from notequery.plans import library, search

    return {**search.QUERIES, **library.QUERIES}
