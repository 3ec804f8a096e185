"""Binding of tests to rules, and of rules' arguments to columns and values."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from plumbline.functions.text import UUID
from plumbline.model import AMEND, POST, PRE, Binding, BoundParam, Param, Review, Rule, Test

#: What a COUNT measure's label may name.
COUNTED = (
    "EXTERNAL_PREREQUISITES_NOT_MET", "INTERNAL_PREREQUISITES_NOT_MET", "NOT_COMPLIANT", "NOT_COMPLETE", "NOT_AMENDED",
    "COMPLIANT", "COMPLETE", "AMENDED", "FILLED_IN",
)
#: Results of issues, which labels may name here too.
COUNTED_ISSUES = ("POTENTIAL_ISSUE", "NOT_ISSUE", "IS_ISSUE")


def normalized(id: str | None) -> str | None:
    t = (id or "").strip()
    return (t[:-1] if t.endswith("/") else t) or None


def uuid_of(id: str) -> str:
    m = re.search(UUID, id)
    return m[0] if m else id


def local_name(term: str) -> str:
    m = re.search(r"[/#:]([^/#:]+)$", term)
    return m[1] if m else term


def term_key(term: str | None) -> str:
    return (term or "").strip().lower()


@dataclass(frozen=True)
class Measure:
    """A measure over all records. COUNT counts `result` of the target; QA asks that every response of the target have
    one of `results` or `statuses`."""

    kind: str
    target_label: str
    target_id: str = ""
    result: str = ""
    results: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()

    def encoded(self) -> dict[str, str]:
        return {"kind": self.kind, "targetLabel": self.target_label, "targetId": self.target_id, "result": self.result, "results": "|".join(self.results), "statuses": "|".join(self.statuses)}

    @staticmethod
    def decoded(p: Mapping[str, str]) -> "Measure":
        split = lambda x: tuple(y for y in x.split("|") if y)
        return Measure(p["kind"], p["targetLabel"], p.get("targetId", ""), p.get("result", ""), split(p.get("results", "")), split(p.get("statuses", "")))


def measure_of(test: Test) -> Measure | None:
    """What a test of type MEASURE says about all records, from its expected response or its label."""
    if test.type != "MEASURE":
        return None
    text, label = test.metadata.get("expectedResponse", ""), (test.label or "").strip()
    if label.startswith("MULTIRECORD_MEASURE_COUNT_"):
        if m := re.search(r"count\s+the\s+number\s+of\s+([A-Z0-9_]+).*?response\.result\s*=\s*\"?([A-Z_]+)", text, re.I):
            return Measure("COUNT", m[1].upper(), result=m[2].upper())
        rest = label.removeprefix("MULTIRECORD_MEASURE_COUNT_")
        for r in (*COUNTED, *COUNTED_ISSUES):
            if rest.startswith(r + "_") and len(rest) > len(r) + 1:
                return Measure("COUNT", "VALIDATION_" + rest.removeprefix(r + "_"), result=r)
        return None
    if label.startswith("MULTIRECORD_MEASURE_QA_"):
        m = re.search(r"every\s+([A-Z0-9_]+)\s+in the MultiRecord", text, re.I)
        target = m[1].upper() if m else "VALIDATION_" + label.removeprefix("MULTIRECORD_MEASURE_QA_")
        told = re.findall(r"response\.(result|status)\s*=\s*\"?([A-Z_]+)", text, re.I)
        results = tuple(dict.fromkeys(v.upper() for k, v in told if k.lower() == "result"))
        statuses = tuple(dict.fromkeys(v.upper() for k, v in told if k.lower() == "status"))
        if not told:
            results, statuses = ("COMPLIANT",), ("INTERNAL_PREREQUISITES_NOT_MET",)
        return Measure("QA", target, results=results, statuses=statuses)
    return None


@dataclass(frozen=True)
class Bound:
    bindings: tuple[Binding, ...]
    unresolved: tuple[Test, ...]
    reviews: tuple[Review, ...]


def candidates(test: Test, rules: Sequence[Rule], explicit: Mapping[str, str]) -> tuple[list[Rule], list[str]]:
    """Rules for a test: the explicit mapping rules; else those whose version is the test's id, else whose id it is, else whose
    id is the UUID in it."""
    if test.id in explicit:
        return [r for r in rules if r.key == explicit[test.id]], []
    own = normalized(test.id)
    for found, notes in (
        ([r for r in rules if own and normalized(r.version) == own], []),
        ([r for r in rules if own and normalized(r.provides) == own], []),
        ([r for r in rules if own and normalized(r.provides) == uuid_of(own)], ["Matched by UUID; the version of the implementation differs"]),
    ):
        if found:
            return found, notes
    return [], []


def matches(test_id: str, rule: Rule) -> bool:
    """Whether a rule is for a test, in any of these ways."""
    own = normalized(test_id)
    return bool(own) and (normalized(rule.version) == own or normalized(rule.provides) in (own, uuid_of(own)))


def parameters_text(values: Mapping[str, str]) -> str:
    """Values as `k=v; k2=v2`, sorted."""
    return "; ".join(sorted(f"{k}={v}" for k, v in values.items()))


def parameters_from(text: str) -> dict[str, str]:
    """The values of such a text. What has no = is a name with an empty value."""
    parts = (x.strip() for x in text.split(";"))
    return {k.strip(): v.strip() for k, _, v in (x.partition("=") for x in parts if x)}


def choose(found: Sequence[Rule], values: Mapping[str, str]) -> tuple[Rule | None, str, str | None]:
    """Rule, implementation status and capability. Given values ask for a rule with parameters, none for one without; of several the
    first by class and method."""
    by_key = sorted(found, key=lambda r: (r.cls, r.method))
    plain, rich = [r for r in by_key if not r.parameterized], [r for r in by_key if r.parameterized]
    if not by_key:
        return None, "MISSING", None
    capability = "BOTH" if plain and rich else "PARAMETERIZED_ONLY" if rich else "DEFAULT_ONLY"
    first = (rich or plain) if values else (plain or rich)
    return first[0], "FOUND" if len(plain) <= 1 and len(rich) <= 1 else "AMBIGUOUS", capability


def column_for(term: str, columns: Iterable[str]) -> str | None:
    """The column of a term: by its full name, else its local name, without case; the first in order of names."""
    ordered = sorted(columns)
    for key in (term_key(term), term_key(local_name(term))):
        for c in ordered:
            if key and key in (term_key(c), term_key(local_name(c))):
                return c
    return None


def value_for(name: str, values: Mapping[str, str]) -> str | None:
    if name in values:
        return values[name]
    return next((v for k, v in values.items() if term_key(k) == term_key(name)), None)


def bind_param(p: Param, columns: Sequence[str] | None, values: Mapping[str, str]) -> BoundParam:
    if p.role.startswith("LEGACY"):
        return BoundParam(p)
    if p.role == "PARAMETER":
        v = value_for(p.source, values)
        if v is not None:
            return BoundParam(p, value=v)
        return BoundParam(p, bound=False, reason=f"PARAMETER MISSING: {p.source}") if p.required else BoundParam(p, reason=f"{p.source} uses the implementation's default")
    if columns is None:
        return BoundParam(p, column=p.source)
    c = column_for(p.source, columns)
    return BoundParam(p, column=c) if c else BoundParam(p, bound=False, reason=f"TERM MISSING: {p.source}")


def worst(params: Sequence[BoundParam]) -> str:
    if any(b.reason.startswith("TERM MISSING") for b in params):
        return "TERM_MISSING"
    missing = [b for b in params if not b.bound]
    return "BOUND" if not missing else "UNBOUND" if len(missing) == len(params) else "PARTIAL"


def bind(tests: Sequence[Test], rules: Sequence[Rule], explicit: Mapping[str, str] | None = None, columns: Sequence[str] | None = None) -> Bound:
    """Binds in the tests' order. A binding that isn't BOUND is run all the same and is among the unresolved too."""
    bindings, unresolved, reviews = [], [], []
    by_label: dict[str, Test] = {}
    for t in tests:
        by_label.setdefault(t.label, t)
    for t in tests:
        if (m := measure_of(t)) is not None:
            target = by_label.get(m.target_label)
            if target is None:
                unresolved.append(t)
                reviews.append(Review(t, "MISSING", "UNBOUND", None, None, (), True, (f"No test is labelled {m.target_label}",)))
                continue
            m = replace(m, target_id=target.id)
            bindings.append(Binding(t, None, phase=t.phase, measure=m))
            reviews.append(Review(t, "FOUND", "BOUND", "DEFAULT_ONLY", f"built-in {m.kind}", (), True, ()))
            continue
        found, notes = candidates(t, rules, explicit or {})
        r, status, capability = choose(found, t.parameters)
        if r is None:
            unresolved.append(t)
            reviews.append(Review(t, status, "UNBOUND", None, None, (), not t.parameters, ("No implementation discovered",)))
            continue
        params = tuple(bind_param(p, columns, t.parameters) for p in r.params)
        b = Binding(t, r, params, worst(params), r.phase)
        bindings.append(b)
        if b.status != "BOUND":
            unresolved.append(t)
        notes = [*notes, *(x.reason for x in params if x.reason)]
        reviews.append(Review(t, status, b.status, capability, r.key, tuple(f"{x.param.source}={x.value}" for x in params if x.value is not None), not t.parameters, tuple(notes)))
    return Bound(tuple(bindings), tuple(unresolved), tuple(reviews))


def for_phase(bindings: Sequence[Binding], phase: str) -> list[Binding]:
    """The bindings that run in a phase. The last phase reruns those of the first on amended records, but for tests that have
    a binding of their own there."""
    if phase != POST:
        return [b for b in bindings if b.phase == phase]
    own = [b for b in bindings if b.phase == POST]
    ids = {b.test.id for b in own}
    again = [replace(b, phase=POST) for b in bindings if b.phase == PRE and b.type != "AMENDMENT" and b.test.id not in ids]
    return own + again


def split(bindings: Sequence[Binding], phase: str) -> tuple[list[Binding], list[Binding]]:
    """Rules to run and measures to take in a phase: measures of targets that run there, none while amending."""
    own = for_phase(bindings, phase)
    direct = [b for b in own if b.measure is None]
    ids = {b.test.id for b in direct}
    return direct, [] if phase == AMEND else [b for b in own if b.measure is not None and b.measure.target_id in ids]
