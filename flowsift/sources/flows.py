"""Flow CSV source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowsift.functions import parse_number, strip
from flowsift.operators.flows import cast_label, normalise_headers, rename_headers, validate
from flowsift.schema import CSV_MISSING, FLOW_TYPES


def _cell(name: str, kind: str) -> Column:
    """A text cell as its column type; the missing spellings are null, '-' is a value."""
    if kind == "string":
        return F.when(~F.coalesce(F.col(name), F.lit("")).isin(CSV_MISSING), F.col(name))
    number = parse_number(name)
    if kind == "double":
        return number
    # Whole numbers go straight from text, so that 64-bit values keep every digit.
    return F.coalesce(strip(name).try_cast(kind), F.when(number == F.floor(number), number).try_cast(kind))


def read_flows(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Headered CSV -> typed flow table with internal names.

    Columns outside the flow schema are kept as numbers when they parse, because an
    undeclared numeric column counts as a feature. Whole-number columns that hold other
    numbers become double. That costs one look at these columns.
    """
    raw = spark.read.csv(path, header=True, escape='"', enforceSchema=False)
    if not raw.columns:
        raise ValueError(f"no header in {path}: file is empty")
    named = rename_headers(normalise_headers(raw))
    if check:
        validate(named)
    extra = [c for c in named.columns if c not in FLOW_TYPES]
    types = FLOW_TYPES | _seen_types(named, extra)
    typed = named.select(*[_cell(f"`{c}`" if c in extra else c, types[c]).alias(c) for c in named.columns])
    return cast_label(typed) if "Label" in typed.columns else typed


def _seen_types(df: DataFrame, extra: list[str]) -> dict[str, str]:
    """Column types that keep every readable number: one look at the extra and the whole-number columns.

    An extra column is a number if all its cells are; a whole-number column with a
    fraction or a number out of range is read as double.
    """
    whole = [c for c in df.columns if FLOW_TYPES.get(c) in ("int", "bigint") and c != "Label"]
    lost = {c: _cell(f"`{c}`", "string").isNotNull() & _cell(f"`{c}`", "double").isNull() for c in extra}
    lost |= {c: _cell(c, "double").isNotNull() & _cell(c, FLOW_TYPES[c]).isNull() for c in whole}
    if not lost:
        return {}
    bad = df.agg(*[F.count_if(rule).alias(c) for c, rule in lost.items()]).first()
    return {c: "string" if c in extra else "double" for c in lost if bad[c]} | {
        c: "double" for c in extra if not bad[c]
    }
