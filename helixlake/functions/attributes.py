"""GFF3 attribute strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(value: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def attribute(attrs: Column, key: str) -> Column:
    """Value of the first ``;`` field with exactly this key, trimmed, one pair of quotes removed.

    Null if no field has the key; an empty value is an empty string. Nothing is percent-decoded.
    """
    pattern = rf"(?:^|;)\s*{key}=([^;]*)"
    value = trimmed(F.regexp_extract(attrs, pattern, 1))
    return F.when(F.rlike(attrs, F.lit(pattern)), F.regexp_replace(value, r'^"([\s\S]*)"$', "$1"))


def parents(attrs: Column) -> Column:
    """Transcript ids of a feature: its Parent list, or its ID only where Parent is absent; no empty ids."""
    owner = F.coalesce(attribute(attrs, "Parent"), attribute(attrs, "ID"))
    return F.filter(F.transform(F.split(owner, ","), trimmed), lambda p: p != "")
