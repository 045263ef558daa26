"""Expressions over texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates terms.
BREAK = r"[ \n\t\r.,;:!?()]+"


def terms(text: Column | str) -> Column:
    """Lower-cased terms of a text in order, without empty ones; null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK), lambda t: t != "")
