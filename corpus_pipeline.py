"""A corpus from documents to packed bins: toxicity, near-duplicates, secrets, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlight.llm import mixing, packing, secrets, simhash, toxicity
from orderlight.llm.base import table
from orderlight.session import scratch_path, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon model, learned from the labels of these documents, scores under its cut."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(F.col("text"), model) < toxicity.CUT)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: 64-bit fingerprints of four-word shingles, linked at four bits."""
    return simhash.first_of_each(docs, width=4)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts; n_chars follows the text. A null text stays null."""
    own = docs.columns
    named = docs.toDF(*[f"c{i}" for i in range(len(own))])
    at = {n: f"c{own.index(n)}" for n in ("text", "n_chars")}
    found = secrets.scan(named, text=at["text"], out="_spans")
    changed = F.size("_spans") > 0
    text = F.when(changed, secrets.redacted(F.col(at["text"]), F.col("_spans"))).otherwise(F.col(at["text"]))
    count = F.when(changed, F.length(at["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(at["n_chars"]))
    clean = found.withColumn(at["text"], text).withColumn(at["n_chars"], count)
    return clean.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(own)])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    own = docs.columns
    rows = stored(docs.toDF(*[f"c{i}" for i in range(len(own))]).withColumn("_row", F.monotonically_increasing_id()), "rows")
    doc_id, source, text = (F.col(f"c{own.index(n)}") for n in ("doc_id", "source", "text"))
    sizes = rows.select(F.col("_row").alias("doc_id"), source.alias("source"), mixing.word_count(text).alias("size"), F.xxhash64(doc_id, source, text).alias("key"))
    taken = mixing.mixed(sizes).where("copies > 0").select(F.col("doc_id").alias("_row"), "copies")
    often = rows.join(taken, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return often.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(own)])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their bins. Copies of a document are one cluster, which never meet in a bin."""
    return packing.pack_documents(docs, F.col("doc_id").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

# Learned scores, hashes and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
