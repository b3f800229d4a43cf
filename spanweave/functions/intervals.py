"""Closed token intervals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(l1: Column, r1: Column, l2: Column, r2: Column) -> Column:
    return (l1 <= r2) & (l2 <= r1)


def disjoint(l1: Column, r1: Column, l2: Column, r2: Column) -> Column:
    return (r1 < l2) | (r2 < l1)


def contains(l1: Column, r1: Column, l2: Column, r2: Column) -> Column:
    """The first holds the second."""
    return (l1 <= l2) & (r2 <= r1)


def near(l1: Column, r1: Column, l2: Column, r2: Column, width: int | Column) -> Column:
    """The hull of both ends at most ``width`` tokens after it begins."""
    return F.greatest(r1, r2) - F.least(l1, l2) <= width


def gap(l1: Column, r1: Column, l2: Column, r2: Column) -> Column:
    """Distance from the end of one to the begin of the other; 0 if they overlap."""
    return F.greatest(F.greatest(l1, l2) - F.least(r1, r2), F.lit(0))


def proximity(l1: Column, r1: Column, l2: Column, r2: Column) -> Column:
    """1 for overlapping intervals, else one over the gap."""
    return F.when(overlaps(l1, r1, l2, r2), F.lit(1.0)).otherwise(1.0 / gap(l1, r1, l2, r2))
