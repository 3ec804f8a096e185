"""Vocabulary, plan nodes and the schema of the response table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

#: Vocabularies of the response table.
TEST_TYPES = ("VALIDATION", "ISSUE", "MEASURE", "AMENDMENT", "UNKNOWN")
PHASES = ("PRE_AMENDMENT", "AMENDMENT", "POST_AMENDMENT")
OUTCOMES = ("PASSED", "FAILED", "AMENDED", "NOT_IMPLEMENTED", "UNABLE_TO_RUN", "ERROR")
BINDING_STATUSES = ("BOUND", "PARTIAL", "TERM_MISSING", "UNBOUND")
IMPLEMENTATION_STATUSES = ("FOUND", "MISSING", "AMBIGUOUS")
CAPABILITIES = ("DEFAULT_ONLY", "PARAMETERIZED_ONLY", "BOTH")
ROLES = ("ACTED_UPON", "CONSULTED", "PARAMETER", "LEGACY_RECORD", "LEGACY_PARAMETERS")
MULTIRECORD, UNRESOLVED = "MULTIRECORD", "*"
PRE, AMEND, POST = PHASES

RESPONSE_SCHEMA = (
    "record_ord long, record_id string, test_id string, test_type string, implementation_class string, implementation_method string, "
    "phase string, phase_ord int, parameters map<string,string>, status string, response_status string, response_result string, "
    "comment string, message string, amendments map<string,string>, started_at timestamp, finished_at timestamp"
)
#: What a rule gives for a record.
OUTPUT_SCHEMA = "status string, result string, comment string, amendments map<string,string>, error string"


class PlumblineError(Exception):
    """Told to the user without a trace."""


@dataclass(frozen=True)
class Param:
    """A rule's argument. source: a term for ACTED_UPON and CONSULTED, a name for PARAMETER."""

    role: str
    source: str = ""
    type: str = "string"
    required: bool = True
    name: str = ""


@dataclass(frozen=True)
class Rule:
    """A discovered implementation. native: fn takes Columns and returns a Column of OUTPUT_SCHEMA; else
    fn takes Python values and runs in Arrow batches, once for each distinct tuple."""

    provides: str
    version: str
    type: str
    cls: str
    method: str
    params: tuple[Param, ...]
    fn: Callable
    native: bool = True
    writes: tuple[str, ...] = ()

    @property
    def phase(self) -> str:
        return AMEND if self.type == "AMENDMENT" else PRE

    @property
    def key(self) -> str:
        return f"{self.cls}#{self.method}"

    @property
    def parameterized(self) -> bool:
        return any(p.role == "PARAMETER" for p in self.params)


@dataclass(frozen=True)
class Test:
    """A test definition of a policy."""

    id: str
    label: str = ""
    type: str = "VALIDATION"
    phase: str = PRE
    parameters: dict[str, str] = field(default_factory=dict)
    metadata: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class BoundParam:
    param: Param
    column: str | None = None
    value: str | None = None
    bound: bool = True
    reason: str = ""


@dataclass(frozen=True)
class Binding:
    test: Test
    rule: Rule | None
    params: tuple[BoundParam, ...] = ()
    status: str = "BOUND"
    phase: str = PRE
    measure: "object | None" = None

    @property
    def type(self) -> str:
        return self.test.type if self.rule is None or self.rule.type == "UNKNOWN" else self.rule.type

    @property
    def fields(self) -> tuple[str, ...]:
        """Columns that tell tuples apart: parameters are the same for all records."""
        return tuple(sorted({b.column for b in self.params if b.column and b.param.role in ("ACTED_UPON", "CONSULTED")}))

    @property
    def dedupable(self) -> bool:
        return not any(b.param.role.startswith("LEGACY") for b in self.params)


@dataclass(frozen=True)
class Review:
    test: Test
    implementation: str
    status: str
    capability: str | None
    chosen: str | None
    values: tuple[str, ...]
    using_defaults: bool
    diagnostics: tuple[str, ...]


@dataclass(frozen=True)
class UseCase:
    id: str
    label: str = ""
    policy: str = ""


@dataclass(frozen=True)
class Plan:
    use_case: UseCase
    policies: tuple[str, ...]
    tests: tuple[Test, ...]
    unresolved: tuple[str, ...] = ()
