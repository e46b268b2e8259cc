"""Mixing sources to target weights by systematic sampling, in DataFrame functions alone.

Every document of a source expects target / source size copies. Documents are put in a fixed order within their
source, by size and then by a hash of their id, expected copies are summed along it from one random offset, and a
document is taken once per integer that the sum crosses. As neighbours are of like size, the words taken stay near
the target.

The running sum is the rank times one rate, in whole numbers of 2**-24. Ranks come from three levels of counts, so
no task sees a whole source: cells of like size, hash prefixes within a cell, rows within a prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.blocks import unused_name, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix"
UNIT = 1 << 24
SOURCE = ["no_source", "source_key"]
CELL = [*SOURCE, "octave", "top"]
GROUP = [*CELL, "prefix"]
LOOKUP_ROWS = 200_000  # rows of a lookup table that is broadcast; its rows are a few numbers each
SALTS = 64


def _sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"))
    octave = F.length(F.bin("size"))
    return rows.select(
        "doc_id",
        "size",
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("source_key"),
        octave.alias("octave"),
        F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))").alias("top"),
        F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 16).alias("hash"),
    )


def source_targets(sized: DataFrame, weights: tuple[int, ...], cap: int, seed: str) -> DataFrame:
    """Size, target, rate and random offset of each source. One row a source, so its windows are small."""
    sums = sized.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(*SOURCE)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(ordered) - 1) % len(weights) + 1).cast("double")
    everything = Window.orderBy("ratio", *SOURCE)
    whole = Window.partitionBy()
    filled = (
        sums.withColumn("weight", weight)
        .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("free_size", F.sum("source_size").over(whole) - F.sum("most").over(everything) + F.col("most"))
        .withColumn("free_weight", F.sum("weight").over(whole) - F.sum("weight").over(everything) + F.col("weight"))
        .withColumn("level", F.col("free_size") / F.col("free_weight"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"])
    )
    target = F.least("most", F.col("level") * F.col("weight"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), "source_key", F.when(F.col("no_source"), "?").otherwise(""))), 1, 6), 16, 10)
    rate = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long")
    return filled.withColumn("target", target).select(*SOURCE, "source_size", "target", rate.alias("rate"), offset.cast("long").alias("offset"))


def looked_up(rows: DataFrame, facts: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with the row of ``facts`` of their key, wherever the key is hot.

    Up to ``LOOKUP_ROWS`` facts are broadcast. More of them are repeated for each of ``SALTS`` salts, by which the rows are
    dealt as well.
    """
    if facts.count() <= LOOKUP_ROWS:
        return rows.join(F.broadcast(facts), key)
    salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("hash"), F.lit(SALTS)).cast("int")
    return rows.withColumn("salt", salt).join(salted, [*key, "salt"]).drop("salt")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken.

    ``size`` counts words (null text: 0). Sources by code point, null last, have the ``weights`` in turn and share
    the size of all documents; a target stops at ``cap`` times its source's size and the excess is shared again by
    weight. ``taken`` is size times copies; copies are at most ``cap``. Reruns agree. Rows of one id are ordered by
    id alone, so equal rows may swap their copies. Other columns are ignored; an empty table gives no row.
    """
    spark = docs.sparkSession
    sized = written(_sized(docs))
    targets = written(source_targets(sized, weights, cap, seed))
    cells = sized.groupBy(*CELL).agg(F.count("*").alias("cell_rows"))
    # Rows a task ranks at once: a share of a shuffle partition, so a hot source fills all of them.
    rows = sized.count()
    share = max(64, rows // (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("cell_rows") / share))).cast("int")
    before = F.sum("cell_rows").over(Window.partitionBy(*SOURCE).orderBy("octave", "top")) - F.col("cell_rows")
    cells = cells.select(*CELL, digits.alias("digits"), before.alias("before_cell"))
    prefixed = looked_up(sized, written(cells), CELL).withColumn("prefix", F.expr("substring(hash, 1, digits)"))
    groups = prefixed.groupBy(*GROUP).agg(F.count("*").alias("group_rows"))
    before = F.sum("group_rows").over(Window.partitionBy(*CELL).orderBy("prefix")) - F.col("group_rows")
    groups = groups.select(*GROUP, before.alias("before_group"))
    within = F.row_number().over(Window.partitionBy(*GROUP).orderBy("hash", "doc_id"))
    ranked = prefixed.withColumn("within", within).join(groups, GROUP)
    rank = F.col("before_cell") + F.col("before_group") + F.col("within")
    passed = lambda at: F.shiftright(at * F.col("rate") + F.col("offset"), 24)
    copies = passed(rank) - passed(rank - 1)
    return (
        looked_up(ranked, targets, SOURCE)
        .withColumn("copies", copies)
        .select(
            "doc_id",
            F.when(~F.col("no_source"), F.col("source_key")).alias("source"),
            "size",
            "source_size",
            "target",
            "copies",
            (F.col("size") * F.col("copies")).alias("taken"),
        )
    )


def draw(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Equal ids of one source are told apart by number.

    Rows of null id or text are mixed like any other; an empty table gives no row. All columns are kept as they are.
    """
    mix_id, mix_source, mix_copies, mix_count, mix_copy = (unused_name(n, docs.columns) for n in ("mix_id", "mix_source", "mix_copies", "mix_count", "mix_copy"))
    key = [mix_id, mix_source]
    keyed = {
        mix_id: F.struct(F.col("doc_id").cast("long").alias("doc_id")),
        mix_source: F.struct(F.col("source").cast("string").alias("source")),
    }
    taken = mix(docs, weights, cap, seed).withColumns(keyed).groupBy(*key)
    taken = taken.agg(F.array_sort(F.collect_list(F.struct("size", "copies")))["copies"].alias(mix_copies))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    joined = docs.withColumns(keyed).join(taken.where(F.exists(mix_copies, lambda c: c > 0)), key)
    number = F.row_number().over(Window.partitionBy(*key).orderBy(size))
    counted = joined.withColumn(mix_count, F.element_at(mix_copies, number)).where(F.col(mix_count) > 0)
    copied = counted.withColumn(mix_copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(mix_count))))
    return copied.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16) AS hash
  FROM documents),
cells AS (SELECT *, length(bin(size)) AS octave, size >> greatest(length(bin(size)) - 4, 0)::BIGINT AS top FROM sized),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY octave, top, hash, doc_id NULLS FIRST) AS rank FROM cells),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM sums),
shares AS (SELECT *, 3.0::DOUBLE * source_size AS most, 3.0::DOUBLE * source_size / weight AS ratio FROM weighed),
levels AS (
  SELECT *, (sum(source_size) OVER () - sum(most) OVER (ORDER BY ratio, source NULLS LAST) + most)::DOUBLE
         / (sum(weight) OVER () - sum(weight) OVER (ORDER BY ratio, source NULLS LAST) + weight) AS own_level FROM shares),
found AS (SELECT own_level AS level FROM levels WHERE own_level <= ratio ORDER BY ratio, own_level LIMIT 1),
targets AS (
  SELECT source, source_size, least(most, level * weight) AS target,
         ('0x' || substr(md5('{SEED}:' || coalesce(source, '?')), 1, 6))::BIGINT AS start
  FROM levels, found),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target / source_size * {UNIT}) ELSE 0 END::BIGINT AS rate FROM targets)
SELECT doc_id, size, source_size, target,
       (size * ((rank * rate + start) // {UNIT} - ((rank - 1) * rate + start) // {UNIT}))::BIGINT AS taken
FROM ranked JOIN rates ON ranked.source IS NOT DISTINCT FROM rates.source
"""
