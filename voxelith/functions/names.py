"""Names: safe collection names, sort keys and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def safe_name(name: Column) -> Column:
    """Letters, digits, dot, underscore and hyphen only, with a letter or digit at both ends; else ``collection``."""
    out = F.regexp_replace(name, r"[^a-zA-Z0-9._-]", "_")
    out = F.regexp_replace(out, r"^[^a-zA-Z0-9]+", "")
    out = F.regexp_replace(out, r"[^a-zA-Z0-9]+$", "")
    return F.when(out == "", F.lit("collection")).otherwise(out)


def natural_key(name: Column) -> Column:
    """A sort key: text and numbers in turn, numbers by value."""
    texts = F.split(name, r"\d+")
    numbers = F.transform(F.regexp_extract_all(name, F.lit(r"(\d+)"), 1), lambda x: x.cast("decimal(38,0)"))
    return F.arrays_zip(texts.alias("text"), numbers.alias("number"))


def index_key(path: Column) -> Column:
    """The first number in a path's last part."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.regexp_extract(base, r"(\d+)", 1).try_cast("bigint")


def frame_name(index: Column) -> Column:
    return F.lpad(index.cast("string"), 6, "0")


def point_document(point_id: Column) -> Column:
    return F.concat(F.lit("point_"), point_id.cast("string"))


def parsed_id(text: Column) -> Column:
    """An identifier as a number; anything else is null, nothing is evaluated."""
    return text.try_cast("bigint")


def has_text(x: Column) -> Column:
    return F.coalesce(F.trim(x) != "", F.lit(False))
