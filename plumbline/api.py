"""prepare, review, with_parameters, run: a run from a dataset, definitions and a use case to responses and reports."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbline import policy
from plumbline.binding import Bound, bind, matches, split
from plumbline.functions.text import structured_response
from plumbline.model import AMEND, OUTCOMES, PHASES, POST, PRE, RESPONSE_SCHEMA, UNRESOLVED, Binding, Param, Plan, Test
from plumbline.operators import execute, measures
from plumbline.registry import discover
from plumbline.sources import cached, read_records


@dataclass(frozen=True)
class Prepared:
    """The analysed plan of a run."""

    records: DataFrame
    plan: Plan
    bound: Bound
    packages: tuple[str, ...]
    source: str = ""
    explicit: Mapping[str, str] | None = None
    definitions: tuple[str, ...] = ()

    def with_parameters(self, settings: Mapping[str, Mapping]) -> "Prepared":
        """Rebinds with settings {test id: {useDefaults, parameters}}; tests without settings use defaults."""
        tests = []
        for t in self.plan.tests:
            s = settings.get(t.id, {"useDefaults": True, "parameters": {}})
            tests.append(replace(t, parameters={} if s.get("useDefaults", True) else dict(s.get("parameters", {}))))
        return replace(self, plan=replace(self.plan, tests=tuple(tests)), bound=bind(tests, discover(self.packages), self.explicit, execute.terms(self.records)))

    def review(self) -> DataFrame:
        spark = self.records.sparkSession
        rows = [(r.test.id, r.test.label, r.test.type, r.implementation, r.status, "PARAMETERIZED_VERSION_AVAILABLE" if r.capability == "BOTH" else r.capability, r.chosen, ", ".join(r.values), r.using_defaults, "; ".join(r.diagnostics)) for r in self.bound.reviews]
        return spark.createDataFrame(rows, "test_id string, label string, type string, implementation string, binding string, capability string, chosen string, parameter_values string, using_defaults boolean, diagnostics string")

    def parameters_of(self, test_id: str) -> list[Param]:
        """Parameters that can be set for a test: those of its rule or, where that has none, of the rules with parameters that match it, the first of a name."""
        own = next((b for b in self.bound.bindings if b.test.id == test_id and b.rule is not None), None)
        found = [p.param for p in own.params if p.param.role == "PARAMETER"] if own else []
        if not found:
            rules = sorted((r for r in discover(self.packages) if r.parameterized and matches(test_id, r)), key=lambda r: (r.cls, r.method))
            found = list({p.source: p for r in reversed(rules) for p in reversed(r.params) if p.role == "PARAMETER"}.values())[::-1]
        return found

    def preflight(self) -> str:
        b = self.bound
        return f"{len(self.plan.tests)} tests resolved, {len(self.plan.unresolved)} not; {sum(x.status == 'BOUND' for x in b.bindings)} runnable, {len(b.unresolved)} not bound"

    def binding(self, test_id: str) -> Binding:
        return next(b for b in self.bound.bindings if b.test.id == test_id and b.measure is None)

    def trace(self, test_id: str) -> DataFrame:
        return execute.trace(self.records, self.binding(test_id))


@dataclass(frozen=True)
class Run:
    """A run's responses and amended records, as lazy tables; their plans are made when they are first asked for."""

    prepared: Prepared
    dedup: bool = True
    strict: bool = False

    @cached_property
    def _evaluated(self) -> execute.Evaluated:
        return execute.evaluate(self.prepared.records, self.prepared.bound.bindings, self.dedup)

    @cached_property
    def responses(self) -> DataFrame:
        """The three phases, their measures and the unresolved rows, as one table: the records are scanned once for the rules and once
        for the measures."""
        taken = measures.measures_of(self._evaluated, measures_due(self.prepared.bound.bindings), self.strict)
        rest = unresolved_rows(self.prepared.records.sparkSession, self.prepared.bound)
        return reduce(DataFrame.unionByName, [self._evaluated.responses(), *([taken] if taken is not None else []), rest])

    @cached_property
    def amended(self) -> DataFrame:
        return execute.evaluate(self.prepared.records, self.prepared.bound.bindings, self.dedup, (AMEND,)).amended()

    def of(self, phase: str | None = None, test_type: str | None = None, test_id: str | None = None, columns: Sequence[str] | None = None, multirecord: bool | None = None) -> DataFrame:
        """The responses of a phase, a type or a test, or some of their columns. Rules that none of them needs don't run. multirecord
        leaves the measures over all records alone, or leaves them out; unresolved tests count as rows of records."""
        wanted = lambda b: (test_type is None or b.type == test_type) and (test_id is None or b.test.id == test_id)
        phases = PHASES if phase is None else (phase,)
        bindings, parts = self.prepared.bound.bindings, []
        if multirecord is not True:
            parts.append(execute.evaluate(self.prepared.records, bindings, self.dedup, phases, wanted).responses(columns))
            rest = unresolved_rows(self.prepared.records.sparkSession, self.prepared.bound, lambda t: (phase is None or t.phase == phase) and (test_type is None or t.type == test_type) and (test_id is None or t.id == test_id))
            parts.append(rest.select(*(columns or "*")))
        if multirecord is not False:
            due = [(p, b) for p, b in measures_due(bindings) if p in phases and wanted(b)]
            targets = {b.measure.target_id for _, b in due}
            taken = measures.measures_of(execute.evaluate(self.prepared.records, bindings, self.dedup, sorted({p for p, _ in due}, key=PHASES.index), lambda b: b.test.id in targets), due, self.strict)
            parts += [taken.select(*(columns or "*"))] if taken is not None else []
        return reduce(DataFrame.unionByName, parts) if parts else execute.no_responses(self.prepared.records).select(*(columns or "*"))

    def review(self) -> DataFrame:
        """The review of the plan, with what each measure gave before and after amendments; '' where there is none."""
        given = self.of(multirecord=True).select("test_id", "phase", "implementation_method", "response_status", "response_result", "parameters")
        number, share = (F.element_at("parameters", F.lit(k)) for k in ("matchingCount", "percentage"))
        text = F.when(F.col("implementation_method") == "count", F.concat(number, F.lit(" ("), share, F.lit("%)"))).otherwise(structured_response("response_status", "response_result"))
        by_phase = given.groupBy(F.col("test_id").alias("__id")).agg(*(F.max(F.when(F.col("phase") == p, text)).alias(name) for p, name in ((PRE, "pre_amendment"), (POST, "post_amendment"))))
        plan = self.prepared.review()
        out = plan.join(F.broadcast(by_phase), F.col("test_id") == F.col("__id"), "left")  # one row for each measure of the plan
        return out.select(*plan.columns, *(F.coalesce(n, F.lit("")).alias(n) for n in ("pre_amendment", "post_amendment")))

    def write(self, path: str, progress: Callable[[str, str, Mapping[str, int]], None] = lambda event, phase, counts: None) -> dict[str, dict[str, int]]:
        """Writes the responses as Parquet, in one pass, and tells how many each phase has by status: progress hears of the start, and of the end of
        each phase with its counts, which Spark takes while it writes."""
        seen = Observation("responses")
        counts = [F.count_if((F.col("phase") == p) & (F.col("status") == o)).alias(f"{p}:{o}") for p in PHASES for o in OUTCOMES]
        progress("start", "", {})
        self.responses.observe(seen, *counts).write.mode("overwrite").parquet(path)
        got = seen.get
        out = {p: {o: got[f"{p}:{o}"] for o in OUTCOMES if got[f"{p}:{o}"]} for p in PHASES}
        for p in PHASES:
            progress("end", p, out[p])
        return out


def measures_due(bindings: Sequence[Binding]) -> list[tuple[str, Binding]]:
    """Phase and binding of the measures that a run takes: those whose target runs in the phase. A measure of the first phase is taken in the
    last one too, unless that has a binding of the same test."""
    return [(phase, b) for phase in (PRE, POST) for b in split(bindings, phase)[1]]


def unresolved_rows(spark: SparkSession, bound: Bound, wanted: Callable[[Test], bool] = lambda t: True) -> DataFrame:
    """A row with record * and status UNABLE_TO_RUN for each unresolved test that is wanted."""
    told = {r.test.id: "; ".join(r.diagnostics) for r in reversed(bound.reviews)}
    rows = [(None, UNRESOLVED, t.id, t.type, "", "", t.phase, PHASES.index(t.phase), {}, "UNABLE_TO_RUN", "UNABLE_TO_RUN", None, None, told.get(t.id) or "No implementation discovered", {}, None, None) for t in bound.unresolved if wanted(t)]
    return spark.createDataFrame(rows, RESPONSE_SCHEMA)


def prepare(spark: SparkSession, dataset: str | DataFrame, definitions: Sequence[str] = (), use_cases: str | None = None, use_case: str | None = None, packages: Sequence[str] = ("plumbline.rules",), tests: Sequence[Test] | None = None, explicit: Mapping[str, str] | None = None, cache: str | None = None) -> Prepared:
    """Tests are given, or come from the policies of a use case. Definitions and use cases may be URLs: they are fetched once to the folder `cache`."""
    at = lambda x: cached(x, cache or os.path.join(tempfile.gettempdir(), "plumbline-cache")) if str(x).startswith(("http://", "https://")) else x
    definitions, use_cases = tuple(map(at, definitions)), at(use_cases) if use_cases else use_cases
    records = read_records(spark, dataset) if isinstance(dataset, str) else dataset
    plan = Plan(policy.UseCase(use_case or ""), (), tuple(tests)) if tests is not None else policy.resolve(definitions, use_cases, use_case)
    bound = bind(plan.tests, discover(packages), explicit, execute.terms(records))
    return Prepared(records, plan, bound, tuple(packages), dataset if isinstance(dataset, str) else "", dict(explicit or {}), definitions)


def run(prepared: Prepared, dedup: bool = True, strict: bool = False) -> Run:
    return Run(prepared, dedup, strict)


def run_rule(records: DataFrame, binding: Binding) -> DataFrame:
    """One rule alone over the source records, without dedup."""
    phase = binding.phase if binding.phase != POST else PRE
    return execute.validate(records, [binding], phase, dedup=False)


def value_counts(responses: DataFrame, test_id: str) -> DataFrame:
    return responses.where(F.col("test_id") == test_id).groupBy("phase", "response_result").count()
