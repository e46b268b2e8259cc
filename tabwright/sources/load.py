"""Read tables from files and check them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabwright.functions.columns import fold_nan, ref

# Texts that mean a missing value in a CSV file, and the fewest rows of a table.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
MIN_ROWS = 10
PREVIEW_ROWS = 15

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
WHOLE = r"^\s*[+-]?\d+\s*$"
TRUTH = r"^(True|False|TRUE|FALSE|true|false)$"
FORMATS = ("csv", "parquet", "json", "orc")


def load(
    spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None, **options: str
) -> DataFrame:
    """Table from a file or folder; the format follows from the suffix unless given.

    CSV columns are typed from their whole content unless a schema is given, and the usual texts
    for a missing value become null in either case.
    """
    fmt = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; use one of {', '.join(FORMATS)}")
    if fmt == "csv":
        return load_csv(spark, path, schema, **options)
    reader = spark.read.format(fmt).options(**options)
    return fold_nan((reader.schema(schema) if schema else reader).load(path))


def open_quotes(spark: SparkSession, path: str, quote: str = '"') -> bool:
    """Whether some line of the files ends inside quotes: the value goes on in the next line.

    One scan without a shuffle. Doubled quotes inside a value count twice, so an odd number means an open one.
    """
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit(quote), F.lit("")))
    return bool(lines.where(quotes % 2 == 1).limit(1).count())


def load_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """CSV with a header; values in quotes may hold line breaks, rows with more fields than the header are an error.

    Files with line breaks inside quotes can't be cut into parts: each is then read by one task, as nothing shows
    whether a part begins inside quotes. Files without are cut as usual. Rows with fewer fields end in missing values.
    """
    settings = {"header": "true", "inferSchema": "false", "escape": '"', **options}
    if "multiLine" not in settings and open_quotes(spark, path, settings.get("quote", '"')):
        settings["multiLine"] = "true"
    names = spark.read.options(**settings).csv(path).columns
    surplus = next(n for n in (f"_surplus{i}" for i in range(len(names) + 1)) if n not in names)
    # The header gives the names; the place after the last one catches what has none.
    wide = T.StructType([T.StructField(n, T.StringType()) for n in [*names, surplus]])
    raw = spark.read.options(**settings).schema(wide).csv(path)
    message = F.concat(F.lit(f"a row of {path} has more than {len(names)} fields; it begins with "), F.coalesce(ref(names[0]), F.lit("")))
    fits = F.when(ref(surplus).isNotNull(), F.raise_error(message).cast("string"))
    texts = raw.select(*[fits.otherwise(F.when(~ref(c).isin(*NA_TOKENS), ref(c))).alias(c) for c in names])
    if schema is not None:
        fields = schema.fields if isinstance(schema, T.StructType) else T._parse_datatype_string(schema).fields
        kinds = {f.name: f.dataType.simpleString() for f in fields}
    else:
        kinds = infer_kinds(texts)
    return texts.select(*[_typed(c, kinds.get(c, "string")) for c in texts.columns])


def infer_kinds(texts: DataFrame) -> dict[str, str]:
    """bigint, double, boolean or string per column, from one pass over all rows.

    Whole numbers with gaps become double and truth values with gaps stay text, as there is no
    missing value in those types.
    """
    tests = []
    for i, c in enumerate(texts.columns):
        value = ref(c)
        tests += [
            F.count(value).alias(f"n{i}"),
            F.count_if(value.isNull()).alias(f"m{i}"),
            F.count_if(value.rlike(WHOLE) & value.try_cast("bigint").isNotNull()).alias(f"w{i}"),
            F.count_if(value.rlike(NUMBER)).alias(f"d{i}"),
            F.count_if(value.rlike(TRUTH)).alias(f"t{i}"),
        ]
    row = texts.agg(*tests).first()
    kinds = {}
    for i, c in enumerate(texts.columns):
        filled, gaps = row[f"n{i}"], row[f"m{i}"]
        if filled == 0 or (row[f"w{i}"] == filled and gaps):
            kinds[c] = "double"
        elif row[f"w{i}"] == filled:
            kinds[c] = "bigint"
        elif row[f"d{i}"] == filled:
            kinds[c] = "double"
        elif row[f"t{i}"] == filled and not gaps:
            kinds[c] = "boolean"
        else:
            kinds[c] = "string"
    return kinds


def _typed(name: str, kind: str) -> Column:
    if kind == "string":
        return ref(name)
    return F.trim(ref(name)).try_cast(kind).alias(name)


def check_rows(df: DataFrame, min_rows: int = MIN_ROWS, folds: int | None = None) -> None:
    """Refuse an empty or too small table; reads no more rows than the limit."""
    needed = max(min_rows, 2 * folds if folds else 0)
    found = df.limit(needed).count()
    if found == 0:
        raise ValueError("the table is empty")
    if found < needed:
        raise ValueError(f"the table has {found} rows and needs at least {needed}")


def check_types(df: DataFrame) -> None:
    """Refuse columns that cannot be features."""
    nested = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
    ]
    if nested:
        raise ValueError(f"columns of nested type cannot be used: {', '.join(nested)}")


def preview(df: DataFrame, rows: int = PREVIEW_ROWS, order: list[str] | None = None) -> DataFrame:
    """The first rows as text with missing shown empty; ``order`` makes the choice repeatable."""
    first = df.orderBy(*[ref(c) for c in order]) if order else df
    return first.limit(rows).select(
        *[F.coalesce(ref(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
    )


def shape(df: DataFrame) -> dict:
    """Row count, columns, and the last column as the likely target."""
    return {"rows": df.count(), "columns": list(df.columns), "target": df.columns[-1]}
