"""RDF readers for definitions: small graphs, parsed on the driver into sets of triples.

A term is (kind, value, datatype or language): kind is iri, blank or literal. Triples keep the order of the document.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from plumbline.model import PlumblineError

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE = RDF + "type"


class Term(NamedTuple):
    kind: str
    value: str
    datatype: str | None = None
    lang: str | None = None


class Triple(NamedTuple):
    s: str
    p: str
    o: Term


def iri(value: str) -> Term:
    return Term("iri", value)


TOKEN = re.compile(
    r'''(?P<skip>[\s]+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)|(?P<string>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^'\\]|\\.|'(?!''))*\'\'\'|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')'''
    r"|(?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)|(?P<typed>\^\^)|(?P<blank>_:[\w][\w.\-]*)|(?P<number>[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)"
    r"|(?P<name>(?:[\w][\w.\-]*)?:(?:[\w%:\\][\w.\-%:\\]*)?)|(?P<word>[A-Za-z]+)|(?P<mark>[.;,\[\]()])",
    re.S,
)
ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescaped(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" else ESCAPES.get(m[1], m[1]), text, flags=re.S)


class Turtle:
    """Recursive descent over the tokens of a Turtle document."""

    def __init__(self, text: str, base: str = ""):
        self.tokens, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise PlumblineError(f"Turtle can't be read at {text[at : at + 30]!r}")
            kind, value, at = m.lastgroup, m[0], m.end()
            if kind == "name" and value.endswith("."):  # the dot ends the statement
                value, at = value[:-1], at - 1
            if kind == "number" and value.endswith("."):
                value, at = value[:-1], at - 1
            if kind != "skip":
                self.tokens.append((kind, value))
        self.at, self.base, self.prefixes, self.out, self.blanks = 0, base, {}, [], 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, mark: str | None = None) -> tuple[str, str]:
        got = self.peek()
        if got[0] == "end" or mark and got[1] != mark:
            raise PlumblineError(f"Turtle: {mark or 'more'} expected, not {got[1]!r}")
        self.at += 1
        return got

    def parse(self) -> list[Triple]:
        while self.peek()[0] != "end":
            kind, value = self.peek()
            low = value.lower()
            if low in ("@prefix", "prefix", "@base", "base") and kind in ("lang", "word"):
                self.take()
                if low.endswith("prefix"):
                    name = self.take()[1]
                    self.prefixes[name[:-1]] = self.resolve(self.take()[1])
                else:
                    self.base = self.resolve(self.take()[1])
                if low.startswith("@"):
                    self.take(".")
                continue
            subject = self.node()
            if self.peek()[1] != ".":
                self.predicates(subject)
            self.take(".")
        return list(dict.fromkeys(self.out))

    def resolve(self, ref: str) -> str:
        from urllib.parse import urljoin

        ref = unescaped(ref[1:-1])
        return ref if re.match(r"^[A-Za-z][\w+.\-]*:", ref) else (urljoin(self.base, ref) if self.base else ref)

    def expand(self, name: str) -> str:
        prefix, _, local = name.partition(":")
        if prefix not in self.prefixes:
            raise PlumblineError(f"Turtle: the prefix {prefix}: is not declared")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def fresh(self) -> str:
        self.blanks += 1
        return f"_:b{self.blanks}"

    def node(self) -> str:
        t = self.object()
        if t.kind == "literal":
            raise PlumblineError("Turtle: a literal can't be a subject")
        return t.value

    def predicates(self, subject: str) -> None:
        while True:
            kind, value = self.take()
            p = TYPE if (kind, value) == ("word", "a") else self.resolve(value) if kind == "iri" else self.expand(value)
            while True:
                self.out.append(Triple(subject, p, self.object()))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]") or self.peek()[0] == "end":
                return
            if self.tokens[self.at - 1][1] != ";":
                raise PlumblineError(f"Turtle: a ; or . is missing before {self.peek()[1]!r}")

    def object(self) -> Term:
        kind, value = self.take()
        if kind == "iri":
            return iri(self.resolve(value))
        if kind == "name":
            return iri(self.expand(value))
        if kind == "blank":
            return Term("blank", value)
        if kind == "number":
            return Term("literal", value, XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"))
        if kind == "word" and value in ("true", "false"):
            return Term("literal", value, XSD + "boolean")
        if kind == "string":
            n = 3 if value[:3] in ('"""', "\'\'\'") else 1
            text = unescaped(value[n:-n])
            if self.peek()[0] == "lang":
                return Term("literal", text, None, self.take()[1][1:])
            if self.peek()[0] == "typed":
                self.take()
                return Term("literal", text, self.object().value)
            return Term("literal", text)
        if value == "[":
            own = self.fresh()
            if self.peek()[1] != "]":
                self.predicates(own)
            self.take("]")
            return Term("blank", own)
        if value == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.object())
            self.take()
            rest = iri(RDF + "nil")
            for item in reversed(items):
                own = self.fresh()
                self.out += [Triple(own, RDF + "first", item), Triple(own, RDF + "rest", rest)]
                rest = Term("blank", own)
            return rest
        raise PlumblineError(f"Turtle: {value!r} is not expected")


def parse_turtle(text: str) -> list[Triple]:
    return Turtle(text).parse()


def _qname(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


def parse_rdfxml(text: str) -> list[Triple]:
    """Node elements and property elements; rdf:about, ID, nodeID, resource, datatype, parseType Resource, xml:lang."""
    root = ET.fromstring(text)
    out, blanks = [], [0]
    own = lambda name: f"{{{RDF}}}{name}"

    def fresh() -> str:
        blanks[0] += 1
        return f"_:x{blanks[0]}"

    def node(e: ET.Element) -> str:
        s = e.get(own("about"))
        if s is None:
            s = "#" + e.get(own("ID")) if e.get(own("ID")) else "_:" + e.get(own("nodeID")) if e.get(own("nodeID")) else fresh()
        if e.tag != own("Description"):
            out.append(Triple(s, TYPE, iri(_qname(e.tag))))
        for k, v in e.attrib.items():
            if not k.startswith(f"{{{RDF}}}") and k.startswith("{") and "XML/1998" not in k:
                out.append(Triple(s, _qname(k), Term("literal", v)))
        for p in e:
            prop(s, p)
        return s

    def prop(s: str, p: ET.Element) -> None:
        name = _qname(p.tag)
        if p.get(own("resource")) is not None:
            out.append(Triple(s, name, iri(p.get(own("resource")))))
        elif p.get(own("nodeID")):
            out.append(Triple(s, name, Term("blank", "_:" + p.get(own("nodeID")))))
        elif p.get(own("parseType")) == "Resource":
            b = fresh()
            out.append(Triple(s, name, Term("blank", b)))
            for q in p:
                prop(b, q)
        elif len(p):
            for child in p:
                at = len(out)
                o = node(child)
                out.insert(at, Triple(s, name, Term("blank", o) if o.startswith("_:") else iri(o)))
        else:
            out.append(Triple(s, name, Term("literal", p.text or "", p.get(own("datatype")), p.get("{http://www.w3.org/XML/1998/namespace}lang"))))

    if root.tag == own("RDF"):
        for e in root:
            node(e)
    elif any(k.startswith(f"{{{RDF}}}") for k in root.attrib):
        node(root)
    else:
        raise PlumblineError("not RDF/XML")
    return list(dict.fromkeys(out))


def parse_jsonld(text: str) -> list[Triple]:
    """The usual subset: @context of prefixes, terms and @vocab, @graph, @id, @type, @value, @language, @list and nested nodes."""
    doc, out, blanks = json.loads(text), [], [0]

    def expand(name: str, ctx: dict, vocab: bool = True) -> str:
        if name in ctx:
            d = ctx[name]
            d = d.get("@id", name) if isinstance(d, dict) else d
            return d if d == name else expand(d, ctx, vocab)
        prefix, sep, local = name.partition(":")
        if sep and not local.startswith("//") and prefix in ctx:
            return expand(prefix, ctx) + local
        return name if sep or not vocab else ctx.get("@vocab", "") + name

    def value(v, key: str, ctx: dict) -> list[Term]:
        if isinstance(v, list):
            return [t for x in v for t in value(x, key, ctx)]
        if isinstance(v, dict):
            if "@value" in v:
                return [Term("literal", str(v["@value"]), expand(v["@type"], ctx) if "@type" in v else None, v.get("@language"))]
            if "@list" in v or "@set" in v:
                return value(v.get("@list", v.get("@set")), key, ctx)
            s = node(v, ctx)
            return [Term("blank", s) if s.startswith("_:") else iri(s)]
        d = ctx.get(key)
        if isinstance(v, str) and isinstance(d, dict) and d.get("@type") in ("@id", "@vocab"):
            return [iri(expand(v, ctx, d["@type"] == "@vocab"))]
        if isinstance(v, bool):
            return [Term("literal", str(v).lower(), XSD + "boolean")]
        return [Term("literal", str(v), None if isinstance(v, str) else XSD + ("integer" if isinstance(v, int) else "double"))]

    def node(n: dict, ctx: dict) -> str:
        ctx = context(n.get("@context"), ctx)
        blanks[0] += "@id" not in n
        s = expand(n["@id"], ctx, False) if "@id" in n else f"_:j{blanks[0]}"
        for t in [n["@type"]] if isinstance(n.get("@type"), str) else n.get("@type", []):
            out.append(Triple(s, TYPE, iri(expand(t, ctx))))
        for k, v in n.items():
            if not k.startswith("@"):
                out.extend(Triple(s, expand(k, ctx), o) for o in value(v, k, ctx))
        return s

    def context(c, ctx: dict) -> dict:
        for x in c if isinstance(c, list) else [c]:
            if isinstance(x, dict):
                ctx = ctx | x
        return ctx

    ctx = context(doc.get("@context") if isinstance(doc, dict) else None, {})
    nodes = doc if isinstance(doc, list) else doc["@graph"] if "@graph" in doc else [doc]
    for n in nodes if isinstance(nodes, list) else [nodes]:
        node(n, ctx)
    return list(dict.fromkeys(out))


PARSERS = {"xml": parse_rdfxml, "ttl": parse_turtle, "json": parse_jsonld}
#: Syntaxes that are tried in turn, by extension.
ORDER = {"xml": ("xml", "ttl", "json"), "rdf": ("xml", "ttl", "json"), "owl": ("xml", "ttl", "json"), "ttl": ("ttl", "xml", "json"), "json": ("json", "ttl", "xml"), "jsonld": ("json", "ttl", "xml")}


def parse_file(path: str, strict: bool = False) -> list[Triple]:
    """Triples of a file by the syntaxes of its extension: all in turn, or the first alone. A file that can't be read is told before one that can't be parsed."""
    extension = Path(path).suffix.lower().lstrip(".")
    text = Path(path).read_text(encoding="utf-8")
    error = None
    for kind in ORDER.get(extension, ("ttl", "xml", "json"))[: 1 if strict else 3]:
        try:
            return PARSERS[kind](text)
        except Exception as e:  # noqa: BLE001 - the next syntax is tried
            error = error or e
    raise PlumblineError(f"{path} can't be read as RDF: {error}")


def load(paths: Iterable[str]) -> list[Triple]:
    """The union of the files' graphs, a set in order of documents; missing files are passed over. Blank nodes stay apart."""
    out = []
    for i, path in enumerate(paths):
        if Path(path).is_file():
            mine = lambda x, i=i: f"{x}.{i}" if x.startswith("_:") else x
            out += [Triple(mine(t.s), t.p, t.o._replace(value=mine(t.o.value)) if t.o.kind == "blank" else t.o) for t in parse_file(path)]
    return list(dict.fromkeys(out))


def frame(spark: SparkSession, triples: Iterable[Triple]) -> DataFrame:
    return spark.createDataFrame([(t.s, t.p, tuple(t.o)) for t in triples], "s string, p string, o struct<kind:string,value:string,datatype:string,lang:string>").dropDuplicates()
