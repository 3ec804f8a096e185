"""A corpus from documents, in stages; each is written as Parquet and read again by the next.

Language ID lets go what has no language, the Jaccard join keeps one document of each group of near
duplicates, personal data is redacted, sources are mixed to their target weights (documents that
are due several copies are repeated), and BPE encoding gives the tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, langid, mixing, pii, setjoin
from plumbline.llm.common import discard, table, written
from plumbline.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told. Null texts and texts without a letter go; where nothing can be learnt (no labels) only they do. Rows with repeated
    or null ids are judged each; an empty table stays empty."""
    return langid.without_rejected(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 80 %): the least id, null ids last, then the least digest of id and text. Documents without
    words stay, whatever their ids, and so does a text that is no near copy; an empty table stays empty."""
    return setjoin.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, identifiers replaced by their kind and n_chars renewed where a text changed. Null texts stay null."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: sources near their targets. Documents without words come with their source's whole copies."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids, n_tokens, ids_sha256 and decoded_sha256, that of the text decoded from the ids. Null texts have no ids; rows stay."""
    out = bpe.with_tokens(docs.select("doc_id", "source", "lang", "text"), vocabulary("byte_bpe_50k.json"), into="bpe", decoded=False)
    return out.select("doc_id", "source", "lang", F.col("bpe.ids").alias("ids"), F.col("bpe.n_tokens").alias("n_tokens"), F.col("bpe.ids_sha256").alias("ids_sha256"), F.col("bpe.decoded_sha256").alias("decoded_sha256"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("encode", encode)]

#: A trained model and a BPE vocabulary take part, which SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage read is deleted when the next one has its table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
