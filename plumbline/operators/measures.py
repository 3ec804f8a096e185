"""Measures over all records, COUNT and QA: all of a run's are one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import percent
from plumbline.model import MULTIRECORD, PHASES, Binding
from plumbline.operators.execute import Evaluated


def hit(b: Binding, status: Column, result: Column) -> Column:
    """Whether a response of the target counts."""
    m = b.measure
    if m.kind == "COUNT":
        return F.coalesce(result == m.result, F.lit(False))
    return F.coalesce(result.isin(*m.results), F.lit(False)) | F.coalesce(status.isin(*m.statuses), F.lit(False))


def row(b: Binding, phase: str, eligible: Column, matching: Column, total: Column, failed: Column) -> Column:
    """The response of a measure. A QA measure of a target without responses is COMPLETE."""
    m = b.measure
    if m.kind == "COUNT":
        result, status = matching.cast("string"), F.lit("PASSED")
        told = F.format_string(f"%d/%d records matched {m.result} for {m.target_label} (%.1f%%)", matching, total, percent(matching, total))
    else:
        complete = eligible == matching
        result = F.when(complete, "COMPLETE").otherwise("NOT_COMPLETE")
        status = F.when(complete, "PASSED").otherwise("FAILED")
        told = F.format_string(f"%d/%d records met {m.target_label} (%.1f%%)", matching, F.greatest(total, eligible), percent(matching, total))
    parameters = F.map_concat(
        F.create_map(*(F.lit(x) for kv in m.encoded().items() for x in kv)),
        F.create_map(F.lit("matchingCount"), matching.cast("string"), F.lit("totalRecords"), total.cast("string"), F.lit("percentage"), F.format_string("%.1f", percent(matching, total))),
    )
    text = lambda x: F.lit(x).cast("string")
    now = F.current_timestamp()
    return F.struct(
        F.lit(None).cast("long").alias("record_ord"), text(MULTIRECORD).alias("record_id"), text(b.test.id).alias("test_id"), text("MEASURE").alias("test_type"),
        text("plumbline.operators.measures").alias("implementation_class"), text(m.kind.lower()).alias("implementation_method"), text(phase).alias("phase"), F.lit(PHASES.index(phase)).alias("phase_ord"),
        parameters.alias("parameters"), F.when(failed, "ERROR").otherwise(status).alias("status"), F.when(failed, "ERROR").otherwise("RUN_HAS_RESULT").alias("response_status"),
        F.when(~failed, result).alias("response_result"), told.alias("comment"), F.when(failed, "a response of the target has no result").otherwise(told).alias("message"),
        F.create_map().cast("map<string,string>").alias("amendments"), now.alias("started_at"), now.alias("finished_at"),
    )


def rows(one: DataFrame, due: Sequence[tuple[str, Binding]]) -> DataFrame:
    """From one row with total and, for each measure due, e_i, m_i and f_i (whether it failed): its responses, in order."""
    return one.select(F.inline(F.array(*(row(b, phase, F.col(f"e_{i}"), F.col(f"m_{i}"), F.col("total"), F.col(f"f_{i}")) for i, (phase, b) in enumerate(due)))))


def missing(b: Binding, result: Column, strict: bool) -> Column:
    """Of a strict run's QA measure: whether a response has no result."""
    return result.isNull() if strict and b.measure.kind == "QA" else F.lit(False)


def measures(responses: DataFrame, records: DataFrame, bindings: Sequence[Binding], phase: str, strict: bool = False) -> DataFrame | None:
    """Measures of a phase from its table of responses."""
    if not bindings:
        return None
    status, result = F.col("response_status"), F.col("response_result")
    aggs = []
    for i, b in enumerate(bindings):
        own = F.col("test_id") == b.measure.target_id
        aggs += [F.count_if(own).alias(f"e_{i}"), F.count_if(own & hit(b, status, result)).alias(f"m_{i}"), F.coalesce(F.bool_or(own & missing(b, result, strict)), F.lit(False)).alias(f"f_{i}")]
    total = records.agg(F.count(F.lit(1)).alias("total"))
    return rows(responses.agg(*aggs).crossJoin(F.broadcast(total)), [(phase, b) for b in bindings])  # one row each


def measures_of(done: Evaluated, due: Sequence[tuple[str, Binding]], strict: bool = False) -> DataFrame | None:
    """Measures (phase, binding) of evaluated records: one scan, on the rules' outputs before they are rows."""
    if not due:
        return None
    aggs = [F.count(F.lit(1)).alias("total")]
    for i, (phase, b) in enumerate(due):
        targets = [F.col(name) for at, own, name in done.outputs if at == phase and own.test.id == b.measure.target_id]
        count = lambda use: sum((F.count_if(use(t["status"], t["result"])) for t in targets), F.lit(0))  # noqa: B023, E731
        aggs += [(F.count(F.lit(1)) * len(targets)).alias(f"e_{i}"), count(lambda s, r: hit(b, s, r)).alias(f"m_{i}"), (count(lambda s, r: missing(b, r, strict)) > 0).alias(f"f_{i}")]  # noqa: B023
    return rows(done.df.agg(*aggs), due)
