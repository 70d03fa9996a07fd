"""Strict parsing: what has no sure reading becomes null, never a default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that stand for no name (fixed values).
PLACEHOLDERS = ("", "unknown", "none", "nan", "null", "n/a", "na")


def strict_bool(text: Column, trim: bool = True) -> Column:
    """true / True / 1 and false / False / 0 as text; anything else, floats and blanks too, is null."""
    t = F.trim(text) if trim else text
    return F.when(t.isin("true", "True", "1"), True).when(t.isin("false", "False", "0"), False)


def integral(value: Column) -> Column:
    """A number without fraction as long, from any text or number; else null."""
    x = F.trim(value.cast("string")).try_cast("double")
    return F.when(x == F.floor(x), x.cast("long"))


def is_placeholder(name: Column) -> Column:
    return name.isNull() | F.lower(F.trim(name)).isin(*PLACEHOLDERS)
