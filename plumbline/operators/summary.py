"""Summaries of the response table, all as DataFrames of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import is_blank, or_else
from plumbline.model import MULTIRECORD, UNRESOLVED

WORD = "^[A-Z][A-Z0-9_]*$"
TOP = 10
NO_VALUE = "<no value>"


def for_phase(r: DataFrame, phase: str) -> DataFrame:
    return r.where(F.col("phase") == phase)


def for_type(r: DataFrame, kind: str) -> DataFrame:
    return r.where(F.col("test_type") == kind)


def for_response_status(r: DataFrame, status: str) -> DataFrame:
    return r.where(F.col("response_status") == status)


def multirecord_measures(r: DataFrame) -> DataFrame:
    return r.where((F.col("test_type") == "MEASURE") & (F.col("record_id") == MULTIRECORD))


def per_record(r: DataFrame) -> DataFrame:
    return r.where(~F.coalesce(F.col("record_id").isin(MULTIRECORD, UNRESOLVED), F.lit(False)))


def sentinels(r: DataFrame) -> DataFrame:
    return r.where(F.col("record_id").isin(MULTIRECORD, UNRESOLVED))


def counts_by(r: DataFrame, column: str) -> DataFrame:
    """key, n: blank values count as <none>."""
    return r.groupBy(or_else(column, "<none>").alias("key")).agg(F.count(F.lit(1)).alias("n"))


def keywords(counts: DataFrame) -> DataFrame:
    """Counts whose key is a word of a vocabulary, not a number, a map or <none>."""
    return counts.where(F.col("key").rlike(WORD))


def count_where(r: DataFrame, **equal: str) -> DataFrame:
    """One row: n, the responses whose columns have these values."""
    hit = F.lit(True)
    for c, v in equal.items():
        hit = hit & F.coalesce(F.col(c) == v, F.lit(False))
    return r.agg(F.count_if(hit).alias("n"))


def top(counts: DataFrame, n: int = TOP) -> DataFrame:
    """The most frequent keys, ties by key without case, then by key."""
    return counts.orderBy(F.desc("n"), F.lower("key"), "key").limit(n)


def top_with_rest(counts: DataFrame, n: int = TOP) -> DataFrame:
    """The same with a row '... and N more distinct value(s)', n that number, where there are more."""
    rest = counts.agg((F.count(F.lit(1)) - n).alias("rest")).where("rest > 0")
    more = rest.select(F.format_string("... and %d more distinct value(s)", "rest").alias("key"), F.col("rest").alias("n"))
    return top(counts, n).unionByName(more)


def filled_in(r: DataFrame) -> DataFrame:
    """key 'term=value', n: of responses that filled in."""
    each = r.where("response_status = 'FILLED_IN'").select(F.explode("amendments").alias("term", "value"))
    return each.groupBy(F.concat("term", F.lit("="), or_else("value", "<empty>")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def amended_pairs(r: DataFrame, source: DataFrame, terms: list[str]) -> DataFrame:
    """key 'term: old -> new', n: of responses that amended. Old values are the source's."""
    each = r.where("response_status = 'AMENDED'").select("record_ord", F.explode("amendments").alias("term", "value"))
    old = F.coalesce(*(F.when(F.col("term") == t, F.col(f"`{t}`")) for t in terms), F.lit(None).cast("string"))
    joined = each.join(source.select("record_ord", *(F.col(f"`{t}`") for t in terms)), "record_ord", "left")
    key = F.concat("term", F.lit(": "), or_else(old, "<empty>"), F.lit(" -> "), or_else("value", "<empty>"))
    return joined.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


def measure_pivot(r: DataFrame) -> DataFrame:
    """test_id with its result in each phase; a phase has one row for a measure."""
    own = multirecord_measures(r)
    result = lambda p: F.max(F.when(F.col("phase") == p, F.col("response_result")))
    return own.groupBy("test_id").agg(result("PRE_AMENDMENT").alias("pre_amendment"), result("POST_AMENDMENT").alias("post_amendment"))


def outcome_tally(r: DataFrame) -> DataFrame:
    """phase, key, n: key is the status, with the result where it is a word of a vocabulary that the type has."""
    status = or_else("response_status", "<none>")
    with_result = F.col("test_type").isin("VALIDATION", "ISSUE") & ~is_blank("response_result") | (F.col("test_type") == "MEASURE") & F.col("response_result").isin("COMPLETE", "NOT_COMPLETE")
    key = F.when(F.coalesce(with_result, F.lit(False)), F.concat_ws(" | ", status, "response_result")).otherwise(status)
    return r.groupBy("phase", key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


def value_tally(r: DataFrame, source: DataFrame, term: str) -> DataFrame:
    """key (the source's value of the term, <no value> where there is none), n: over responses."""
    joined = r.select("record_ord").join(source.select("record_ord", F.col(f"`{term}`").alias("value")), "record_ord", "left")
    return joined.groupBy(or_else("value", NO_VALUE).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def metadata(records: DataFrame) -> DataFrame:
    """term_count, record_count."""
    n = len([c for c in records.columns if c not in ("record_ord", "record_id")])
    return records.agg(F.lit(n).cast("long").alias("term_count"), F.count(F.lit(1)).alias("record_count"))


def padded(records: DataFrame, expected: list[str], id_term: str) -> DataFrame:
    """The expected terms only, '' where a record has none, the id term filled from the record's id; prefixes dwc: are dropped."""
    have = set(records.columns)
    filled = lambda t: F.coalesce(F.col(f"`{t}`"), F.lit("")) if t in have else F.lit("")
    one = lambda t: F.when(filled(t) == "", F.col("record_id")).otherwise(filled(t)) if t == id_term else filled(t)
    return records.select("record_id", *(one(t).alias(t.removeprefix("dwc:")) for t in expected))
