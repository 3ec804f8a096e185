"""Registration of rules by decorators, and discovery of them in packages."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable, Iterable

from plumbline.model import Param, Rule

_RULES: dict[str, Rule] = {}


def acted(term: str, type: str = "string") -> Param:
    return Param("ACTED_UPON", term, type)


def consulted(term: str, type: str = "string") -> Param:
    return Param("CONSULTED", term, type)


def parameter(name: str, type: str = "string", required: bool = False) -> Param:
    return Param("PARAMETER", name, type, required, name)


WHOLE_RECORD = Param("LEGACY_RECORD")
ALL_PARAMETERS = Param("LEGACY_PARAMETERS", required=False)


def rule(kind: str, provides: str, *params: Param, version: str = "", cls: str | None = None, native: bool = True, writes: Iterable[str] = ()) -> Callable:
    """Registers the function below it. Rules that write terms (amendments) name them; else they are the
    terms acted upon."""

    def keep(fn: Callable) -> Callable:
        terms = tuple(writes) or tuple(p.source for p in params if p.role == "ACTED_UPON")
        r = Rule(provides, version, kind, cls or fn.__module__, fn.__name__, tuple(params), fn, native, terms if kind == "AMENDMENT" else ())
        _RULES[r.key] = r
        return fn

    return keep


def validation(provides, *params, **kw):
    return rule("VALIDATION", provides, *params, **kw)


def issue(provides, *params, **kw):
    return rule("ISSUE", provides, *params, **kw)


def measure(provides, *params, **kw):
    return rule("MEASURE", provides, *params, **kw)


def amendment(provides, *params, **kw):
    return rule("AMENDMENT", provides, *params, **kw)


def discover(packages: Iterable[str]) -> list[Rule]:
    """Rules of the packages and the modules below them, by class and method. Modules that can't be
    imported are passed over."""
    names = []
    for package in packages:
        try:
            found = importlib.import_module(package)
        except ImportError:
            continue
        names.append(package)
        for m in pkgutil.walk_packages(getattr(found, "__path__", []), package + "."):
            try:
                importlib.import_module(m.name)
            except ImportError:
                continue
            names.append(m.name)
    return sorted((r for r in _RULES.values() if r.fn.__module__ in set(names)), key=lambda r: r.key)
