"""A corpus pipeline: toxic documents out, near copies out, repeated passages out, sources mixed, texts encoded.

Every stage takes what the one before kept and changes the rows; all but the last return the columns of
``documents``. Between stages the rows are written as Parquet to the shared scratch folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.bpe import encode_decode
from tabwright.llm.mixing import draw
from tabwright.llm.near_dedup import representatives
from tabwright.llm.queries import table, vocabulary
from tabwright.llm.suffix_dedup import remove_repeats
from tabwright.llm.toxicity import without_toxic
from tabwright.session import scratch_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; null and empty texts stay."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays; texts without words all stay."""
    return representatives(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that a document with a smaller id holds are cut out.

    ``n_chars`` counts what is left. Documents of which nothing is left go; texts that were empty before stay.
    """
    names = [c for c in docs.columns if c not in ("text", "n_chars")]
    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    kept = remove_repeats(docs, with_text=True, carry=names).where("n_bytes = 0 or n_removed < n_bytes")
    kept = kept.withColumn("carried", F.from_json("extra", carried))
    own = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return kept.select(*[own.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them: none to three times."""
    return draw(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, little-endian 32-bit, with the digests of ids and of the text decoded from them."""
    return encode_decode(docs, vocabulary("byte_bpe_50k.json"), with_ids=True).drop("decoded")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mixing", mixing), ("bpe", bpe)]
# The classifier, the sketches and the vocabulary can't be said in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


PIPELINE_QUERY = {"pipeline": run}
PIPELINE_SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
