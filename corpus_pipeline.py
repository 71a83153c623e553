"""From raw documents to packed training sequences, in five stages.

Each stage takes rows with the columns of documents and keeps columns that it doesn't use as they are, whatever their
names. Rows with a null in any column take part; a table without rows gives one without rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormloom.llm import line_dedup, mixing, packing, similar, toxicity
from stormloom.llm.common import read_table, shared_table
from stormloom.llm.queries import END_ID, SEQUENCE_TOKENS, VOCABULARY

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def aside(docs: DataFrame, *used: str) -> DataFrame:
    """The columns that a stage uses, the others as one struct, so that no name of theirs clashes with the stage's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*[F.col(f"`{c}`") for c in used], (F.struct(*rest) if rest else F.lit(0)).alias("__rest"))


def restored(df: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of docs, from a result that began with aside()."""
    return df.select(*[F.col(f"`{c}`") if c in used else F.col("__rest").getField(c).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. Labels of the held-out fifth aren't learnt from. A null text, or one without words,
    scores the share of toxic labels, so it stays where that is under a half. Rows alike go or stay together."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    used = ("doc_id", "text")
    scored = toxicity.score_toxicity(aside(docs, *used), read_table(spark, sf_dir, "labels"), fold != 0)
    return restored(scored.filter("predicted = 0"), docs, *used)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source are taken out of its documents' texts; n_chars is that of what is left. Null sources
    are one source. A null text stays null and has a null n_chars; no row goes, and rows alike stay alike."""
    used = ("doc_id", "text", "source", "n_chars")
    cleaned = line_dedup.site_line_dedup(aside(docs, *used))
    return restored(cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)), docs, *used)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that five-word shingles with a similarity of 0.8 or more link, the row with the smallest id stays, once
    however often it comes; of several texts with that id the one with the smallest hash. Texts without words, null ones
    too, are one group. A row of null id stays only if no row of its group has an id; then all of the group do."""
    return similar.drop_similar_texts(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's target weight asks, so some come several times and some not at all. Null
    sources are one source, the last. A document without words, or with a null text, comes as often as the whole part of
    what its source wants. Rows alike are rounded one by one."""
    used = ("doc_id", "text", "source")
    return restored(mixing.mix_documents(aside(docs, *used)), docs, *used)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a sequence. A null text is empty: its document is the end id
    alone. Rows alike are packed one by one; null ids are kept."""
    return packing.pack_documents(docs, public_tokenizers.path(VOCABULARY), SEQUENCE_TOKENS, END_ID)


#: (name, function of (spark, docs, sf_dir)); each one's rows are the next one's docs.
STAGES: list[tuple[str, Stage]] = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_duplicates), ("mixing", mix), ("packing", pack)]

#: Scores, fingerprints, rounding and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
