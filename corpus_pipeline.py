"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, mixing to target weights, packing."""

from __future__ import annotations

import public_tokenizers
from planwatch.llm import line_dedup, mixing, packing, simhash, toxicity
from planwatch.llm.common import free_name, read, stored
from planwatch.llm.queries import LINE_RATIO, LINE_SURE, LOSS_TOKENS, SEGMENTS, fold
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose text scores 0.5 or more; the model learns from the labels of four fifths of the ids.

    A null text scores as an empty one; rows with a null id are scored like others; equal texts share their fate; no docs give none.
    Without a toxic document among those with labels all stay.
    """
    model = toxicity.train(docs, read(spark, sf_dir, "labels").where(~fold().isin(0, -1)), "doc_id", "text", "toxic")
    score = free_name(docs, "score")
    return toxicity.scored(docs, model, "text", score).where(F.col(score) < 0.5).drop(score)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose texts have lost their source's boilerplate lines; n_chars, if there, follows.

    All rows stay: a null text is null, one of boilerplate alone is empty. A null source is a source; repeated rows are pages each.
    """
    text, lost = free_name(docs, "kept_text"), free_name(docs, "lines_lost")
    kept = line_dedup.without_boilerplate(docs, "text", "source", LINE_RATIO, LINE_SURE, text, lost).withColumn("text", F.col(text))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(lost) > 0, F.length("text")).otherwise(F.col("n_chars")))
    return kept.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs but those that aren't the first (least id) of their group of near-duplicates: five words, similarity 0.8.

    Null, empty and blank texts are copies of each other. Rows of a repeated id go only if the id isn't the first of a group of one of
    them; rows with a null id stay, as nothing names them.
    """
    groups = simhash.near_duplicates(docs, "doc_id", "text", shingle=5, similarity=0.8)
    gone = stored(groups.where("id is not null").groupBy(F.col("id").alias("gone")).agg(F.max(F.col("id") == F.col("component")).alias("first")).where("not first").select("gone"))
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs, each as often as the mix takes it: 0 to 2 times. Null and empty texts have no words and are never taken; a null source is a source.

    A source's words come within its largest document of its target, repeated rows and ids and null ids included.
    """
    row = free_name(docs, "row")
    rows = mixing.placed(docs, row)
    sizes = stored(rows.select(F.col(row).alias("row"), "source", mixing.word_count(F.col("text")).alias("size"), mixing.content("doc_id", "text").alias("key")))
    taken = mixing.with_copies(sizes).where("copies > 0").select(F.col("row").alias("of"), "copies")
    whole = rows.select(row, F.struct(*docs.columns).alias("doc"))
    return whole.join(taken, F.col(row) == F.col("of")).select("doc", F.explode(F.sequence(F.lit(1), "copies"))).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all docs in training sequences, a row each. A null text is the end id alone; copies are documents of their own."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), segments=SEGMENTS, loss_tokens=LOSS_TOKENS)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: No stage but line dedup can be said in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; what a stage returns is written and read again for the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
