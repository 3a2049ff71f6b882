"""Imputation, scaling and one-hot encoding with exact statistics."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from flowsift.operators.sparse import category_dictionary
from flowsift.schema import CATEGORICAL

SMALL = 200_000  # rows per column an exact aggregate may hold
ACCURACY = 1_000  # a coarse sketch is cheap, and the exact counts of each round make up for it
SLACK = 3 / ACCURACY
COLUMNS_AT_ONCE = 8  # statistics of more columns make an aggregate too wide for generated code


def _first_of(df: DataFrame, aggregates: list[list[Column]]) -> dict:
    """The aggregates, a list for each column, in passes over a few columns each."""
    out = {}
    for i in range(0, len(aggregates), COLUMNS_AT_ONCE):
        some = [a for column in aggregates[i : i + COLUMNS_AT_ONCE] for a in column]
        row = df.agg(*some).first()
        out |= {n: row[n] for n in row.__fields__}
    return out


def exact_medians(df: DataFrame, cols: list[str], small: int = SMALL) -> dict[str, float | None]:
    """Exact median of every column, in all columns at once; null for an all-null column.

    Up to `small` rows an exact aggregate does it. Beyond, each round brackets the wanted
    rank with a bounded sketch, checks the bracket with exact counts, and goes on inside it
    until few enough values are left to order.
    """
    x = {c: F.col(c).cast("double") for c in cols}
    if df.count() <= small:
        return df.agg(*[F.percentile(v, 0.5).alias(c) for c, v in x.items()]).first().asDict()
    first = _first_of(
        df,
        [
            [
                F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n")).alias(c),
                F.percentile_approx(v, [0.5 - SLACK, 0.5 + SLACK], ACCURACY).alias(f"~{c}"),
            ]
            for c, v in x.items()
        ],
    )
    # Per column: the bracket [lo, hi], values in it, rank of the lower middle inside it.
    state = {
        c: {**first[c].asDict(), "k": (first[c]["n"] - 1) // 2, "even": first[c]["n"] % 2 == 0}
        for c in cols
        if first[c]["n"]
    }
    near = {c: first[f"~{c}"] for c in state}
    while True:
        wide = {c: s for c, s in state.items() if s["n"] > small and s["lo"] < s["hi"]}
        if not wide:
            break
        _narrow(df, x, wide, near if near else _bracket(df, x, wide))
        near = {}
    return dict.fromkeys(cols) | _middles(df, x, state)


def _within(v: Column, s: dict) -> Column:
    return (v >= s["lo"]) & (v <= s["hi"])


def _bracket(df: DataFrame, x: dict[str, Column], wide: dict[str, dict]) -> dict[str, list[float]]:
    sketches = []
    for c, s in wide.items():
        share = (s["k"] + 1) / s["n"]
        around = [max(0.0, share - SLACK), min(1.0, share + SLACK)]
        sketches.append([F.percentile_approx(F.when(_within(x[c], s), x[c]), around, ACCURACY).alias(c)])
    return _first_of(df, sketches)


def _narrow(df: DataFrame, x: dict[str, Column], wide: dict[str, dict], near: dict[str, list[float]]) -> None:
    checks = []
    for c, s in wide.items():
        inside, (lo, hi) = _within(x[c], s), near[c]
        checks.append([
            F.struct(
                F.count_if(inside & (x[c] < lo)).alias("below"),
                F.count_if(inside & (x[c] < hi)).alias("below_hi"),
                F.count_if(inside & (x[c] <= lo)).alias("upto_lo"),
                F.count_if(inside & (x[c] <= hi)).alias("upto"),
                F.max(F.when(inside & (x[c] < lo), x[c])).alias("before_lo"),
                F.min(F.when(inside & (x[c] > lo), x[c])).alias("after_lo"),
                F.max(F.when(inside & (x[c] < hi), x[c])).alias("before_hi"),
                F.min(F.when(inside & (x[c] > hi), x[c])).alias("after_hi"),
            ).alias(c)
        ])
    seen = _first_of(df, checks)
    for c, s in wide.items():
        (lo, hi), got, k, n = near[c], seen[c], s["k"], s["n"]
        # The rank falls on one of five parts: before lo, lo, between, hi, after hi.
        # Each leaves out at least one value, so the loop ends whatever the sketch says.
        if k < got["below"]:
            part = (s["lo"], got["before_lo"], 0, got["below"])
        elif k < got["upto_lo"]:
            part = (lo, lo, got["below"], got["upto_lo"])
        elif k < got["below_hi"]:
            part = (got["after_lo"], got["before_hi"], got["upto_lo"], got["below_hi"])
        elif k < got["upto"]:
            part = (hi, hi, got["below_hi"], got["upto"])
        else:
            part = (got["after_hi"], s["hi"], got["upto"], n)
        s["lo"], s["hi"], s["k"], s["n"] = part[0], part[1], k - part[2], part[3] - part[2]


def _middles(df: DataFrame, x: dict[str, Column], state: dict[str, dict]) -> dict[str, float]:
    """Medians from final brackets: at most `small` values, or a single one, per column."""
    middle = {c: [s["lo"]] * 2 for c, s in state.items() if s["lo"] == s["hi"]}
    open_ = {c: s for c, s in state.items() if c not in middle}
    if open_:
        pairs = [
            F.when(_within(x[c], s), F.struct(F.lit(c).alias("c"), x[c].alias("v"))) for c, s in open_.items()
        ]
        counts = df.select(F.inline(F.array_compact(F.array(*pairs)))).groupBy("c", "v").agg(F.count("*").alias("n"))
        rank = F.create_map(*[F.lit(v) for c, s in open_.items() for v in (c, s["k"])])[F.col("c")]
        ranked = counts.withColumns({"upto": F.sum("n").over(Window.partitionBy("c").orderBy("v")), "k": rank})
        both = ranked.groupBy("c").agg(
            F.min(F.when(F.col("upto") > F.col("k"), F.col("v"))).alias("lower"),
            F.min(F.when(F.col("upto") > F.col("k") + 1, F.col("v"))).alias("upper"),
        )
        middle |= {r["c"]: [r["lower"], r["upper"]] for r in both.collect()}
    # The upper middle may be the first value after the bracket.
    beyond = [c for c, s in state.items() if s["even"] and s["k"] + 1 == s["n"]]
    if beyond:
        nexts = [F.min(F.when(x[c] > middle[c][0], x[c])).alias(c) for c in beyond]
        for c, v in df.agg(*nexts).first().asDict().items():
            middle[c][1] = v
    return {c: (m[0] + m[1]) / 2 if state[c]["even"] else m[0] for c, m in middle.items()}


def fit_medians(df: DataFrame, cols: list[str], method: str = "exact", small: int = SMALL) -> DataFrame:
    """One row with the median of every column. `approx` trades exactness for a single pass."""
    if method == "approx":
        return df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, 10_000).alias(c) for c in cols])
    medians = exact_medians(df, cols, small)
    return df.sparkSession.createDataFrame(
        [tuple(medians[c] for c in cols)], ", ".join(f"`{c}` double" for c in cols)
    )


def impute(df: DataFrame, medians: DataFrame) -> DataFrame:
    """Fill missing numbers; a column without any value is dropped."""
    row = medians.first()
    known = {c: row[c] for c in medians.columns if row[c] is not None}
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in known.items()})
    return filled.drop(*[c for c in medians.columns if c not in known])


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row of (mean, std) structs, population standard deviation."""
    moments = [
        [F.struct(F.avg(F.col(c).cast("double")).alias("mean"), F.stddev_pop(F.col(c).cast("double")).alias("std")).alias(c)]
        for c in cols
    ]
    found = _first_of(df, moments)
    return df.sparkSession.createDataFrame(
        [tuple(found[c] for c in cols)], ", ".join(f"`{c}` struct<mean: double, std: double>" for c in cols)
    )


def scale(df: DataFrame, stats: DataFrame) -> DataFrame:
    row = stats.first()
    return df.withColumns(
        {
            c: (F.col(c).cast("double") - F.lit(row[c]["mean"])) / F.lit(row[c]["std"] or 1.0)
            for c in stats.columns
        }
    )


def fit_categories(df: DataFrame, cols: list[str] = CATEGORICAL) -> DataFrame:
    """(col, pos, value): the sorted values of every column, a missing one counts as 'unknown'."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("col"), F.coalesce(F.col(c), F.lit("unknown")).alias("value"))
            for c in cols
        ]
    )
    values = df.select(F.inline(pairs)).distinct()
    pos = F.row_number().over(Window.partitionBy("col").orderBy("value")) - 1
    return values.select("col", pos.alias("pos"), "value")


#: Categories that become columns; more are an error, and `operators.sparse` takes any number.
MAX_CATEGORIES = 50_000


def _fitted(cats: DataFrame) -> list[Row]:
    rows = cats.orderBy("col", "pos").limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories cannot become columns: use the sparse form")
    return rows


def _categories(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in _fitted(fit_categories(df, cols)):
        out[r["col"]].append(r["value"])
    return out


def one_hot(df: DataFrame, cats: DataFrame, cols: list[str] = CATEGORICAL) -> DataFrame:
    """Add an int column `col_value` per fitted category; a value not fitted is 0 everywhere."""
    rows = _fitted(cats)  # one row per output column
    return df.withColumns(
        {
            f"{c}_{r['value']}": (F.coalesce(F.col(c), F.lit("unknown")) == r["value"]).cast("int")
            for c in cols
            for r in rows
            if r["col"] == c
        }
    )


def feature_names(flows: DataFrame, numeric: list[str], categorical: list[str] = CATEGORICAL) -> DataFrame:
    """(pos, name) of the output features: numbers first, then `col_value` per category, however many there are."""
    names = flows.sparkSession.createDataFrame(list(enumerate(numeric)), "pos int, name string")
    first = len(numeric)
    for c, keys in category_dictionary(flows, categorical).items():
        names = names.unionByName(
            keys.select((F.col("slot") + F.lit(first)).alias("pos"), F.concat(F.lit(f"{c}_"), "key").alias("name"))
        )
        first += keys.count()
    return names


def _sql_literal(value: float) -> str:
    return f"CAST('{float(value)!r}' AS DOUBLE)"


def fit_preprocess(
    df: DataFrame,
    numeric: list[str],
    categorical: list[str] = CATEGORICAL,
    fit_on: DataFrame | str = "all",
    split_col: str = "split",
    output: str = "features",
    small: int = SMALL,
) -> PipelineModel:
    """Fitted imputation + scaling + one-hot as one savable model.

    fit_on='training' learns from the rows with split = 'train' only, so that test
    rows do not leak into the statistics; 'all' uses every row.
    """
    seen = df.where(F.col(split_col) == "train") if fit_on == "training" else df
    medians = exact_medians(seen, numeric, small)
    kept = [c for c in numeric if medians[c] is not None]
    filled = seen.select(*[F.coalesce(F.col(c).cast("double"), F.lit(medians[c])).alias(c) for c in kept])
    stats: Row = fit_scaler(filled, kept).first() if kept else Row()
    cats = _categories(seen, categorical)
    scaled = [
        f"(coalesce(CAST(`{c}` AS DOUBLE), {_sql_literal(medians[c])}) - {_sql_literal(stats[c]['mean'])})"
        f" / {_sql_literal(stats[c]['std'] or 1.0)} AS `_n_{c}`"
        for c in kept
    ]
    texts = [f"coalesce(`{c}`, 'unknown') AS `_t_{c}`" for c in categorical]
    prepare = SQLTransformer(statement=f"SELECT *, {', '.join(scaled + texts)} FROM __THIS__")
    indexer = PipelineModel(
        [
            StringIndexerModel.from_labels(
                cats[c], inputCol=f"_t_{c}", outputCol=f"_i_{c}", handleInvalid="keep"
            )
            for c in categorical
        ]
    )
    # The index of unseen values is the last one, which dropLast turns into zeros.
    encoder = OneHotEncoder(
        inputCols=[f"_i_{c}" for c in categorical], outputCols=[f"_h_{c}" for c in categorical], dropLast=True
    ).fit(indexer.transform(prepare.transform(df)))
    assembler = VectorAssembler(
        inputCols=[f"_n_{c}" for c in kept] + [f"_h_{c}" for c in categorical], outputCol=output
    )
    temporary = ", ".join(f"`_{k}_{c}`" for k in "tih" for c in categorical)
    numbers = ", ".join(f"`_n_{c}`" for c in kept)
    tidy = SQLTransformer(
        statement=f"SELECT * EXCEPT ({', '.join(x for x in (temporary, numbers) if x)}) FROM __THIS__"
    )
    return PipelineModel([prepare, indexer, encoder, assembler, tidy])
