"""Imputing, scaling and one-hot encoding, learned once and kept as JVM pipeline stages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from tabwright.functions.columns import as_double, quoted, ref
from tabwright.functions.counting import top_values, value_counts
from tabwright.functions.quantiles import exact_medians

# Names of the strategies.
IMPUTE = ("median", "mean", "most_frequent", "constant")
SCALE = ("standard", "minmax", "none")

MAX_LEVELS = 10_000


def fit_fill(df: DataFrame, columns: Sequence[str], strategy: str) -> dict[str, float]:
    """Value that replaces null per numeric column; columns without values are left out."""
    columns = list(columns)
    if not columns:
        return {}
    if strategy == "constant":
        fills = {c: 0.0 for c in columns}
    elif strategy == "median":
        fills = exact_medians(df, columns)
    elif strategy == "mean":
        row = df.agg(*[F.avg(as_double(c)).alias(f"a{i}") for i, c in enumerate(columns)]).first()
        fills = {c: row[i] for i, c in enumerate(columns)}
    elif strategy in ("most_frequent", "drop"):
        tops = top_values(value_counts(df, columns, "double")).select("column", "top").collect()
        found = {r["column"]: r["top"] for r in tops}
        fills = {c: found.get(c) for c in columns}
    else:
        raise ValueError(f"unknown missing value strategy {strategy!r}; known are {', '.join(IMPUTE)} and drop")
    return {c: v for c, v in fills.items() if v is not None}


def impute(df: DataFrame, fills: Mapping[str, float | str]) -> DataFrame:
    replaced = {
        c: F.coalesce(as_double(c) if isinstance(v, float) else ref(c).cast("string"), F.lit(v)).alias(c)
        for c, v in fills.items()
    }
    return df.select(*[replaced.get(c, ref(c)) for c in df.columns])


def drop_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop the rows with a null in any of the columns."""
    return df.na.drop(subset=list(columns) if columns else None)


def fit_text_fill(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value per text column, the smallest on a tie."""
    if not columns:
        return {}
    return {r["column"]: r["top"] for r in top_values(value_counts(df, columns)).select("column", "top").collect()}


@dataclass(frozen=True)
class Scale:
    """``(x - shift) / spread``; a spread of 0 stands for a constant column, which becomes 0."""

    shift: float
    spread: float

    def of(self, value: Column) -> Column:
        return (value - F.lit(self.shift)) / F.lit(self.spread) if self.spread else value * F.lit(0.0)

    def sql(self, value: str) -> str:
        if not self.spread:
            return "CAST(0.0 AS DOUBLE)"
        return f"({value} - ({self.shift!r}D)) / {self.spread!r}D"


def fit_scale(df: DataFrame, columns: Mapping[str, float], kind: str) -> dict[str, Scale]:
    """Scaling of each column after its nulls are filled with the given values."""
    if kind == "none" or not columns:
        return {}
    if kind not in SCALE:
        raise ValueError(f"unknown scaling {kind!r}; known are {', '.join(SCALE)}")
    aggregates = []
    for i, (c, fill) in enumerate(columns.items()):
        value = F.coalesce(as_double(c), F.lit(fill))
        if kind == "standard":
            aggregates += [F.avg(value).alias(f"a{i}"), F.stddev_pop(value).alias(f"b{i}")]
        else:
            aggregates += [F.min(value).alias(f"a{i}"), (F.max(value) - F.min(value)).alias(f"b{i}")]
    row = df.agg(*aggregates).first()
    return {c: Scale(row[f"a{i}"] or 0.0, row[f"b{i}"] or 0.0) for i, c in enumerate(columns)}


def scale(df: DataFrame, scales: Mapping[str, Scale], fills: Mapping[str, float] | None = None) -> DataFrame:
    fills = fills or {}
    value = lambda c: F.coalesce(as_double(c), F.lit(fills[c])) if c in fills else as_double(c)
    scaled = {c: s.of(value(c)).alias(c) for c, s in scales.items()}
    return df.select(*[scaled.get(c, ref(c)) for c in df.columns])


def fit_levels(df: DataFrame, columns: Sequence[str], max_levels: int = MAX_LEVELS) -> dict[str, tuple[str, list[str]]]:
    """Most frequent value and sorted levels per categorical column, from one shuffle.

    More than ``max_levels`` levels are refused: one slot per level would not fit a model.
    """
    if not columns:
        return {}
    counts = value_counts(df, columns).persist()
    try:
        tops = {r["column"]: r for r in top_values(counts).collect()}
        wide = [c for c in columns if c in tops and tops[c]["levels"] > max_levels]
        if wide:
            raise ValueError(
                f"too many levels for one-hot encoding in {', '.join(wide)}; use label encoding or drop the column"
            )
        levels: dict[str, list[str]] = {}
        for r in counts.select("column", "value").collect():
            levels.setdefault(r["column"], []).append(r["value"])
    finally:
        counts.unpersist()
    return {c: (tops[c]["top"], sorted(levels[c])) for c in columns if c in tops}


def onehot(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """One 0/1 column ``<column>_<level>`` per level; unseen values and null give zeros."""
    text = ref(column).cast("string")
    slots = [F.coalesce((text == F.lit(v)).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in levels]
    return df.select("*", *slots)


def _slot_name(kind: str, column: str) -> str:
    return f"{kind}__{column}".replace(".", "_")


def fit_preprocessing(
    df: DataFrame,
    numerical: Sequence[str],
    categorical: Sequence[str],
    missing: str = "median",
    scaling: str | None = "standard",
    max_levels: int = MAX_LEVELS,
    output: str = "features",
) -> PipelineModel:
    """Learn the fills, scales and levels and return stages that write the feature vector.

    Every stage runs in the JVM and can be saved, so a fitted pipeline also scores a stream. The
    vector's metadata names its slots ``num__<column>`` and ``cat__<column>_<level>``.
    """
    fills = fit_fill(df, numerical, missing)
    scales = fit_scale(df, fills, scaling or "none")
    levels = fit_levels(df, categorical, max_levels)
    parts, inputs = [], []
    for c, fill in fills.items():
        value = f"coalesce(CAST({quoted(c)} AS DOUBLE), {fill!r}D)"
        value = scales[c].sql(value) if c in scales else value
        parts.append(f"{value} AS {quoted(_slot_name('num', c))}")
        inputs.append(_slot_name("num", c))
    texts = {}
    for c, (top, _) in levels.items():
        texts[c] = f"_text_{len(texts)}"
        literal = top.replace("\\", "\\\\").replace("'", "\\'")
        parts.append(f"coalesce(CAST({quoted(c)} AS STRING), '{literal}') AS {texts[c]}")
    if not parts:
        raise ValueError("no feature column holds any value")
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")]
    if levels:
        codes = {c: f"_code_{i}" for i, c in enumerate(levels)}
        slots = {c: _slot_name("cat", c) for c in levels}
        stages += [
            StringIndexerModel.from_labels(found, inputCol=texts[c], outputCol=codes[c], handleInvalid="keep")
            for c, (_, found) in levels.items()
        ]
        # The indexer's slot for unseen values is the last one, which dropLast turns into zeros.
        encoder = OneHotEncoder(
            inputCols=list(codes.values()), outputCols=list(slots.values()), dropLast=True
        )
        stages.append(encoder.fit(PipelineModel(list(stages)).transform(df.limit(1))))
        inputs += list(slots.values())
    stages.append(VectorAssembler(inputCols=inputs, outputCol=output))
    return PipelineModel(stages)


def feature_names(vectors: DataFrame, column: str = "features") -> list[str]:
    """Slot names of a vector column, from its metadata."""
    meta = vectors.schema[column].metadata.get("ml_attr", {})
    attributes = [a for group in meta.get("attrs", {}).values() for a in group]
    named = {a["idx"]: a.get("name", f"feature_{a['idx']}") for a in attributes}
    return [named.get(i, f"feature_{i}") for i in range(meta.get("num_attrs", len(named)))]


def config_preprocessing(df: DataFrame, numerical: Sequence[str], categorical: Sequence[str], config: Mapping) -> PipelineModel:
    """The same from the ``data_cleaning`` section of a run's settings.

    ``drop`` fills with the most frequent value; use ``drop_rows`` to drop rows.
    """
    return fit_preprocessing(
        df,
        numerical,
        categorical,
        config.get("missing_value_strategy", "median"),
        config.get("feature_scaling", "standard"),
        config.get("max_levels", MAX_LEVELS),
    )
