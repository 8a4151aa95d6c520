"""A training corpus from raw documents: five stages, each the whole of what the one before kept.

Stages take (spark, docs, sf_dir) and return the columns of documents, the last the plan of
the mix. Texts may be null or empty, rows may repeat, columns may be added; an
empty table passes through as an empty one. See the operators for what each defines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallymark.llm import bm25_wand, circulant_minhash, decode_scan, entropy_mix, rule_ensemble
from tallymark.llm.common import settle, small, table

#: The near-dedup stage's shingle length and similarity.
WORDS, SIMILAR = 5, 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the classifier's cutoff."""
    model = rule_ensemble.fit(docs, table(spark, sf_dir, "labels"))
    # The partition's number keeps the filter above the projections: below them, each rule would compute its statistics anew.
    scored = rule_ensemble.scored(docs, model, into="__score").withColumn("__part", F.spark_partition_id())
    return scored.where((F.col("__score") >= rule_ensemble.CUTOFF) & (F.col("__part") >= 0)).select(docs.columns)


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A row's id and text as one text, in the order of ids, rows without an id last."""
    number = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    # Flipping the sign bit puts negative numbers first.
    flipped = F.hex(F.col(id_col).cast("bigint").bitwiseXOR(F.lit(-(2**63)))) if number else F.col(id_col).cast("string")
    own = F.concat(F.lit("a"), F.lpad(flipped, 16, "0") if number else flipped)
    digest = F.coalesce(F.sha2(F.col(text_col).cast("binary"), 256), F.lit("null"))
    return F.concat_ws(":", F.coalesce(own, F.lit("b")), digest)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least id. Ids may be null or repeat: rows are judged by id
    and text, and of rows that agree in both one stays."""
    keyed = docs.withColumn("__key", row_key(docs))
    judged = circulant_minhash.near_duplicates(keyed, id_col="__key", words=WORDS, threshold=SIMILAR)
    judged = settle(judged.groupBy("__key").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).where("n > 1 or not kept"), "judged")
    gone = judged.where("not kept").select(F.col("__key").alias("__gone"))
    again = judged.where("kept").select(F.col("__key").alias("__gone"))
    left = keyed.join(small(gone), F.col("__key") == F.col("__gone"), "left_anti")
    if not again.isEmpty():
        same = F.col("__key") == F.col("__gone")
        left = left.join(small(again), same, "left_anti").union(left.join(small(again), same, "left_semi").dropDuplicates(["__key"]))
    return left.drop("__key")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was verified."""
    items = bm25_wand.split_text(table(spark, sf_dir, "benchmark"))
    found = bm25_wand.search(docs, items, into="__leaks")
    return found.where(F.size("__leaks.items") == 0).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars, where present, set anew."""
    masked = decode_scan.redact(docs)
    if "n_chars" in docs.columns:
        chars = F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(chars))
    return masked


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies and words that the mix takes of each document."""
    return entropy_mix.mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
]

#: The classifier and the rounding have no SQL form; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
