"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of docs.

Defined cases, in every stage: an empty table gives no rows; a null text counts as empty, a null source as a
source of its own, a null id as described at the stage; columns beyond those of documents pass through,
also if an operator uses their names itself; a text of any length is handled whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import linededup, mixing, neardup, packing, toxicity
from eventloom.llm._common import read, stash


def _carried(docs: DataFrame, *own: str) -> DataFrame:
    """The named columns, and all but the text in one struct ``row``, which no operator's column can clash with."""
    return docs.select(*own, F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))


def _restored(out: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    new = {"text": F.col("text")} | new
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs less those the compression model finds toxic; it learns from labelled rows of docs.

    Rows without id or label are scored like others; equal texts share a verdict; without labels all rows stay.
    """
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(_carried(docs, "text"), model)
    return _restored(scored.where("toxic_score < 0.5"), docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with each repeated line left in one document only; n_chars follows the text.

    Rows that share an id are one document; rows without id are one document after all others.
    """
    out = linededup.dedup_lines(_carried(docs, "doc_id", "text"))
    return _restored(out, docs.columns, n_chars=F.char_length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id.

    Documents without words stay; a row without id stays, as no id tells which of a group it is; rows of one id
    stay or go together.
    """
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes; rows that share an id share their draw, as do rows without."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs with their sequences and offsets; every row is packed, repeated ones too."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Scores, packing and the tokenizer have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
