"""A corpus pipeline of five of the training-data operators over the table documents.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the columns of
documents. Defined cases are those of the operators: rows with null texts are scored like empty ones and stay
where no rule rejects them; an empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import line_dedup, packing, quality, simhash, toxicity
from folioscope.llm.common import checkpointed, table
from folioscope.llm.queries import LINE_PAGES, LINE_RATIO, QUALITY_FROM, TOXIC_FROM, tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; the network learns from the labelled ones among them."""
    network = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, network).where(F.col("toxic_score") < TOXIC_FROM).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality reaches the threshold; the machine learns from the labelled ones among them."""
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, machine).where(F.col("quality_score") >= QUALITY_FROM).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; n_chars follows the text."""
    kept = line_dedup.drop_boilerplate(docs, F.col("source"), max_ratio=LINE_RATIO, min_pages=LINE_PAGES)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every group of near copies: SimHash links (pigeonring) of a shingle similarity of 0.8 or more."""
    return simhash.one_per_linked(docs, checked_words=5, similarity=0.8).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("simhash", one_of_each),
    ("packing", pack_sequences),
]

#: The classifiers are not expressible in SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage's rows being kept in the checkpoint folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
