"""Small expression helpers for operators that stay in Spark SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is evaluated once however often `body` names it,
    also inside the lambdas of higher-order functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case and nothing else; the slower way only for non-ASCII text."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    r"""The runs of [^\x20\x09-\x0D]."""
    return F.filter(F.split(text, WHITE_RUN), lambda w: w != "")


def letters_left(text: Column, drop: str) -> Column:
    """Code points of `text` outside the matches of `drop`."""
    return F.length(F.regexp_replace(text, drop, ""))
