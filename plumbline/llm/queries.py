"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import table
from plumbline.llm.mixing import ORACLE as MIX_SQL
from plumbline.llm.setjoin import ORACLE as JACCARD_SQL
from plumbline.llm.warczip import ORACLE as WARC_SQL


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.spotsigs import op1

    return op1(table(spark, sf_dir, "documents"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.setjoin import op2

    return op2(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.bpe import op3

    return op3(spark, table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.langid import op4

    return op4(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.pii import op5

    return op5(table(spark, sf_dir, "documents"))


def op6_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.sharding import op6

    return op6(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.warczip import op7

    return op7(table(spark, sf_dir, "pages"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.mixing import op8

    return op8(table(spark, sf_dir, "documents"))


def op9_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.fertility import op9

    return op9(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.quality import op10

    return op10(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_spotsigs": op1_spotsigs, "op2_jaccard": op2_jaccard, "op3_bpe": op3_bpe, "op4_language": op4_language, "op5_pii": op5_pii, "op6_hilbert": op6_hilbert, "op7_warc": op7_warc, "op8_mix": op8_mix, "op9_fertility": op9_fertility, "op10_quality": op10_quality}
ORACLES: dict[str, str] = {"op2_jaccard": JACCARD_SQL, "op7_warc": WARC_SQL, "op8_mix": MIX_SQL}
