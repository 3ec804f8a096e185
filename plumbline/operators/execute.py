"""The three phases as DataFrame plans.

Records have record_ord long, record_id string and a string column for each term; NULL is missing, '' is empty.
Native rules are Columns: all of a phase run in one projection of one scan. Python rules run in Arrow
batches, by default over the distinct tuples of their fields only, which are joined back null-safely; rules with
the same fields share the distinct and the join. An amendment rewrites columns that later ones read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.binding import for_phase
from plumbline.functions.text import bad_argument, cast_argument, message, outcome
from plumbline.model import AMEND, OUTPUT_SCHEMA, PHASES, POST, PRE, RESPONSE_SCHEMA, Binding

KEYS = ("record_ord", "record_id")
NO_MAP = "map<string,string>"


def from_table(df: DataFrame, key: str, ord_column: str | None = None) -> DataFrame:
    """A table as records: the key as id, its values as strings. `ord_column` (unique, long) tells rows with equal ids apart; else the key does."""
    terms = [F.col(c).cast("string").alias(c) for c in df.columns if c != ord_column or ord_column == key]
    return df.select(F.col(ord_column or key).cast("long").alias("record_ord"), F.col(key).cast("string").alias("record_id"), *terms)


def terms(records: DataFrame) -> list[str]:
    return [c for c in records.columns if c not in KEYS]


def output(status: Column | str, result: Column | str | None = None, comment: Column | str | None = None, amendments: Column | None = None, error: Column | None = None) -> Column:
    """What a native rule gives."""
    text = lambda x: F.lit(None).cast("string") if x is None else (F.lit(x) if isinstance(x, str) else x.cast("string"))
    none = F.lit(None).cast("string")
    return F.struct(text(status).alias("status"), text(result).alias("result"), text(comment).alias("comment"), (F.create_map().cast(NO_MAP) if amendments is None else amendments.cast(NO_MAP)).alias("amendments"), (none if error is None else error.cast("string")).alias("error"))


def arguments(b: Binding, records: DataFrame) -> tuple[list[Column], Column]:
    """Typed arguments of a native rule, and a text that tells of the first that can't be converted (else null)."""
    args, errors = [], []
    have = set(records.columns)
    for p in b.params:
        if p.param.role == "LEGACY_RECORD":
            args.append(whole_record(records))
        elif p.param.role == "LEGACY_PARAMETERS":
            args.append(map_literal(b.test.parameters))
        else:
            raw = F.lit(p.value).cast("string") if p.param.role == "PARAMETER" else (F.col(f"`{p.column}`") if p.column in have else F.lit(None).cast("string"))
            args.append(cast_argument(raw, p.param.type))
            if p.param.type not in ("string", "boolean"):
                errors.append(F.when(bad_argument(raw, p.param.type), F.concat(F.lit("NumberFormatException: "), raw)))
    return args, F.coalesce(*errors, F.lit(None).cast("string")) if errors else F.lit(None).cast("string")


def whole_record(records: DataFrame) -> Column:
    own = terms(records)
    entries = F.array(*(F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").alias("v")) for c in own))
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())) if own else F.create_map().cast(NO_MAP)


def map_literal(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in sorted(values.items()) for x in kv)).cast(NO_MAP)


def native_output(b: Binding, records: DataFrame) -> Column:
    args, wrong = arguments(b, records)
    error = output("ERROR", None, None, None, wrong)
    return F.when(wrong.isNotNull(), error).otherwise(b.rule.fn(*args)) if b.rule.params else b.rule.fn()


def converted(v: str | None, kind: str):
    if v is None or kind == "string":
        return v
    if kind in ("int", "long"):
        if not v.lstrip("+-").isascii() or not v.lstrip("+-").isdigit() or len(v) - len(v.lstrip("+-")) > 1:
            raise ValueError(f"NumberFormatException: {v}")
        return int(v)
    if kind in ("double", "float"):
        return float(v)
    return v.lower() == "true" if kind == "boolean" else v


def told(e: BaseException) -> str:
    text = f"{type(e).__name__}: {e}" if str(e) else type(e).__name__
    cause = e.__cause__
    return text + (f" (caused by {type(cause).__name__}: {cause})" if cause else "")


def python_output(b: Binding, records: DataFrame) -> Column:
    """One call for each row of records; an exception is an ERROR output of its row alone. fn may return a bool, a text or a dict of the output's
    fields; a record it was given whole is a copy, and what it changes there is an amendment while amending."""
    params, fn, defaults, amending = b.params, b.rule.fn, dict(b.test.parameters), b.type == "AMENDMENT"
    have = set(records.columns)
    inputs = []
    for p in params:
        if p.param.role == "LEGACY_RECORD":
            inputs.append(F.to_json(whole_record(records)))
        elif p.param.role in ("ACTED_UPON", "CONSULTED"):
            inputs.append(F.col(f"`{p.column}`") if p.column in have else F.lit(None).cast("string"))
    if not inputs:
        inputs.append(F.lit(None).cast("string"))

    def call(row: tuple) -> tuple:
        at, args, record = 0, [], None
        try:
            for p in params:
                if p.param.role == "LEGACY_RECORD":
                    record = json.loads(row[at])
                    args.append(dict(record))
                    given, at = args[-1], at + 1
                elif p.param.role == "LEGACY_PARAMETERS":
                    args.append(dict(defaults))
                elif p.param.role == "PARAMETER":
                    args.append(converted(p.value, p.param.type))
                else:
                    args.append(converted(row[at], p.param.type))
                    at += 1
            got = fn(*args)
            if isinstance(got, bool) or got is None or isinstance(got, str):
                got = {"result": None if got is None else str(got).lower() if isinstance(got, bool) else got}
            changes = {k: v for k, v in given.items() if record.get(k) != v} if record is not None and amending else {}
            changes |= got.get("amendments") or {}
            if any(v is None for v in changes.values()):
                raise ValueError("an amendment proposes no value")
            status = got.get("status") or ("AMENDED" if amending and changes else None)
            result = got.get("result")
            return status, None if result is None else str(result), got.get("comment"), {k: str(v) for k, v in changes.items()}, None
        except Exception as e:  # noqa: BLE001 - errors are rows
            return "ERROR", None, None, {}, told(e)

    @F.pandas_udf(OUTPUT_SCHEMA)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = (batch,) if isinstance(batch, pd.Series) else batch
            rows = [call(tuple(None if pd.isna(x) else x for x in row)) for row in zip(*batch)]
            yield pd.DataFrame(rows, columns=["status", "result", "comment", "amendments", "error"])

    return run(*inputs)


def distinct_groups(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row for each distinct tuple of the fields (missing values are equal to each other, not to ''), with the least record_ord as its
    representative and the number of its records."""
    agg = [F.min("record_ord").alias("representative"), F.count(F.lit(1)).alias("members")]
    return records.groupBy(*(F.col(f"`{f}`") for f in fields)).agg(*agg) if fields else records.agg(*agg).where("members > 0")


def with_outputs(records: DataFrame, bindings: Sequence[Binding], dedup: bool = True) -> tuple[DataFrame, dict[int, str]]:
    """records with a column of OUTPUT_SCHEMA for each binding (by its place)."""
    names, plain, groups = {}, [], {}
    for i, b in enumerate(bindings):
        names[i] = f"__out_{i}"
        fields = tuple(f for f in b.fields if f in records.columns)
        if b.rule.native or not dedup or not b.dedupable or not fields:
            plain.append(i)
        else:
            groups.setdefault(fields, []).append(i)
    out = records.withColumns({names[i]: (native_output if bindings[i].rule.native else python_output)(bindings[i], records) for i in plain}) if plain else records
    for fields, own in groups.items():
        tuples = records.select(*(F.col(f"`{f}`") for f in fields)).distinct()
        ran = tuples.withColumns({names[i]: python_output(bindings[i], tuples) for i in own})
        keyed = ran.select(*(F.col(f"`{f}`").alias(f"__k{j}") for j, f in enumerate(fields)), *(names[i] for i in own))
        same = None
        for j, f in enumerate(fields):
            eq = F.col(f"`{f}`").eqNullSafe(F.col(f"__k{j}"))
            same = eq if same is None else same & eq
        out = out.join(keyed, same, "left").drop(*(f"__k{j}" for j in range(len(fields))))
    return out, names


def response(b: Binding, out: Column, phase: str, columns: Sequence[str] | None = None) -> Column:
    """A row of responses, or those of its columns that are named."""
    status, result, comment, amend, error = (out[k] for k in ("status", "result", "comment", "amendments", "error"))
    text = lambda x: F.lit(x).cast("string")
    made = {
        "test_id": lambda: text(b.test.id), "test_type": lambda: text(b.type), "implementation_class": lambda: text(b.rule.cls), "implementation_method": lambda: text(b.rule.method),
        "phase": lambda: text(phase), "phase_ord": lambda: F.lit(PHASES.index(phase)),
        "parameters": lambda: map_literal({x.param.source: x.value for x in b.params if x.value is not None} | dict(b.test.parameters)),
        "status": lambda: outcome(status, result, amend, phase), "response_status": lambda: status, "response_result": lambda: result, "comment": lambda: comment,
        "message": lambda: message(comment, status, result, error), "amendments": lambda: F.coalesce(amend, F.create_map().cast(NO_MAP)),
        "started_at": F.current_timestamp, "finished_at": F.current_timestamp,
    }
    return F.struct(*(made[name]().alias(name) for name in FIELDS if columns is None or name in columns))


#: Columns of a response that its rule gives; record_ord and record_id come from the record.
FIELDS = tuple(x.split()[0] for x in RESPONSE_SCHEMA.split(", "))[2:]


def responses_of(evaluated: DataFrame, bindings: Sequence[Binding], names: dict[int, str], phase: str) -> DataFrame:
    rows = F.array(*(response(b, F.col(names[i]), phase) for i, b in enumerate(bindings)))
    return evaluated.select("record_ord", "record_id", F.inline(rows))


@dataclass(frozen=True)
class Evaluated:
    """Records with the output of every rule of some phases as a column of its own, and with the terms as the amendments
    leave them: one scan, whatever is then taken from it."""

    df: DataFrame
    outputs: tuple[tuple[str, Binding, str], ...]

    def responses(self, columns: Sequence[str] | None = None) -> DataFrame:
        """A row for each record, phase and binding."""
        own = [k for k in KEYS if columns is None or k in columns]
        if not self.outputs:
            return no_responses(self.df).select(*(columns or "*"))
        rows = F.array(*(response(b, F.col(name), phase, columns) for phase, b, name in self.outputs))
        out = self.df.select(*own, F.inline(rows))
        return out if columns is None else out.select(*columns)

    def amended(self) -> DataFrame:
        return self.df.drop(*(name for _, _, name in self.outputs))


def evaluate(records: DataFrame, bindings: Sequence[Binding], dedup: bool = True, phases: Sequence[str] = PHASES, wanted: Callable[[Binding], bool] = lambda b: True) -> Evaluated:
    """Runs the rules of the phases that `wanted` asks for. Amendments run as far as a later rule may read what they wrote."""
    direct, now, outputs = [b for b in bindings if b.measure is None], records, []

    def add(phase: str, own: Sequence[Binding]) -> dict[int, str]:
        nonlocal now
        evaluated, names = with_outputs(now, own, dedup)
        renamed = {n: f"__{phase}_{len(outputs) + i}" for i, n in names.items()}
        now = evaluated.withColumnsRenamed(renamed)
        outputs.extend((phase, b, renamed[names[i]]) for i, b in enumerate(own))
        return {i: renamed[n] for i, n in names.items()}

    if PRE in phases:
        add(PRE, [b for b in for_phase(direct, PRE) if wanted(b)])
    amendments = for_phase(direct, AMEND)
    if POST not in phases:
        last = max((i for i, b in enumerate(amendments) if wanted(b)), default=-1)
        amendments = amendments[: last + 1]
    if AMEND in phases or POST in phases:
        for b in amendments:
            name = add(AMEND, [b])[0]
            now = now.withColumns(amended_terms(now, b, F.col(name)["amendments"]))
    if POST in phases:
        add(POST, [b for b in for_phase(direct, POST) if wanted(b)])
    return Evaluated(now, tuple(o for o in outputs if o[0] in phases and wanted(o[1])))


def amended_terms(records: DataFrame, b: Binding, made: Column) -> dict[str, Column]:
    """The terms that an amendment may write, with what it proposes in place of what was there."""
    changed = {}
    for t in b.rule.writes:
        column = next((x.column for x in b.params if x.param.source == t and x.column), t)
        old = F.col(f"`{column}`") if column in records.columns else F.lit(None).cast("string")
        changed[column] = F.coalesce(F.try_element_at(made, F.lit(column)), F.try_element_at(made, F.lit(t)), old)
    return changed


def no_responses(records: DataFrame) -> DataFrame:
    return records.sparkSession.createDataFrame([], RESPONSE_SCHEMA)


def validate(records: DataFrame, bindings: Sequence[Binding], phase: str = PRE, dedup: bool = True) -> DataFrame:
    """Responses of the phase's rules: one row for each record and binding."""
    if not bindings:
        return no_responses(records)
    evaluated, names = with_outputs(records, bindings, dedup)
    return responses_of(evaluated, bindings, names, phase)


def amend(records: DataFrame, bindings: Sequence[Binding], dedup: bool = True) -> tuple[DataFrame, DataFrame]:
    """Responses of the amendments, run in order, and the amended records. A proposed value replaces the term, whatever the status;
    a term that no record has becomes a column. Each amendment's output is a column of its own, so nothing is evaluated twice."""
    if not bindings:
        return no_responses(records), records
    done = evaluate(records, [b for b in bindings if b.measure is None], dedup, (AMEND,))
    return done.responses(), done.amended()


def run_phases(records: DataFrame, bindings: Sequence[Binding], dedup: bool = True) -> dict[str, DataFrame]:
    """Responses of the rules by phase (measures are taken apart), and the amended records, each with the rules that it needs."""
    out = {phase: evaluate(records, bindings, dedup, (phase,)).responses() for phase in PHASES}
    return out | {"amended": evaluate(records, bindings, dedup, (AMEND,)).amended()}


def ordered(responses: DataFrame) -> DataFrame:
    return responses.orderBy("phase_ord", "test_id", "record_id", "implementation_class", "implementation_method", "record_ord")


def trace(records: DataFrame, b: Binding) -> DataFrame:
    """One rule over all records, with its raw arguments and what it gave: no dedup, nothing applied."""
    evaluated, names = with_outputs(records, [b], dedup=False)
    args = F.array(*(F.struct(F.lit(p.param.source).alias("source"), F.lit(p.param.role).alias("role"), (F.lit(p.value).cast("string") if p.param.role == "PARAMETER" else F.col(f"`{p.column}`") if p.column in records.columns else F.lit(None).cast("string")).alias("raw"), F.lit(p.param.type).alias("type"), F.lit(p.reason).alias("reason")) for p in b.params))
    return evaluated.select(*KEYS, args.alias("arguments"), F.col(names[0]).alias("output"))
