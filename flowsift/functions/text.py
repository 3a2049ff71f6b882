"""Text cleaning, number parsing and label names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from flowsift.schema import LABEL_NAMES

DEFAULT_DATASET = "default.db"

# Every character str.strip() removes; Spark's own trim() knows only the blank.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def strip(c) -> Column:
    return F.btrim(_column(c), F.lit(WHITESPACE))


def dataset_id(c, default: str = DEFAULT_DATASET) -> Column:
    """Clean a dataset name; what is left empty becomes the default dataset."""
    kept = F.regexp_replace(_column(c), r"[^a-zA-Z0-9_\-.]", "")
    named = F.when(kept.endswith(".db"), kept).otherwise(F.concat(kept, F.lit(".db")))
    return F.when(F.length(named) < 4, default).otherwise(F.coalesce(named, F.lit(default)))


def parse_number(c) -> Column:
    """Text -> double, null where it is no number.

    The pattern keeps out spellings only Spark's cast accepts, such as '1d'.
    """
    text = strip(_column(c).cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def label_name(c) -> Column:
    out = F.lit(None).cast("string")
    for value, name in LABEL_NAMES.items():
        out = F.when(_column(c) == value, name).otherwise(out)
    return out


def flag(score, threshold: float = 0.5) -> Column:
    return (_column(score) >= F.lit(float(threshold))).cast("int")
