"""Ordered lists of ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def union(existing: Column, new: Column) -> Column:
    """Existing, then new, each once, without blanks."""
    return F.array_distinct(F.filter(F.concat(existing, new), lambda x: x.isNotNull() & (x != "")))


def subtract(ids: Column, removed: Column) -> Column:
    """ids without the removed ones; order and repeats stay."""
    return F.filter(ids, lambda x: ~F.array_contains(removed, x))


def apply_delta(existing: Column, old: Column, new: Column) -> Column:
    """existing less what only old has, then what only new has."""
    return F.array_distinct(F.concat(subtract(existing, subtract(old, new)), subtract(new, old)))


def cap(ids: Column, limit: int, newest: bool = True) -> Column:
    """The last (newest) or the first limit ids; none for a limit of 0 or less."""
    if limit <= 0:
        return F.slice(ids, 1, 0)
    return F.when(F.size(ids) <= limit, ids).otherwise(F.slice(ids, -limit if newest else 1, limit))


def cap_by(ids: Column, limit: int, method: str | None = None) -> Column:
    """cap() by the name of a method: KEEP keeps the first ids, FIFO (also for names that aren't known) the last."""
    return cap(ids, limit, newest=(method or "").strip().upper() != "KEEP")
