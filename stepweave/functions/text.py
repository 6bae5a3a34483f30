"""Canonical forms of keys and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_form(c: Column | str) -> Column:
    """Letters and digits only, upper case; null stays null. Two keys are equal when their key forms are."""
    return F.upper(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[^\p{L}\p{Nd}]", ""))


def name_form(c: Column | str) -> Column:
    """Lower case, every run of characters other than a-z one underscore, none at either end; null where that is empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(F.regexp_replace(F.lower(c), "[^a-z]+", "_"), F.lit("_")), F.lit(""))


def name_forms(c: Column | str) -> Column:
    """The name forms of an array of names, in order, without those that are no step; null gives an empty array."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.filter(F.transform(c, name_form), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def has_digit(c: Column) -> Column:
    return c.rlike(r"\p{Nd}")


def numbered(items: Column) -> Column:
    """A list of texts as numbered lines, from 1."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
