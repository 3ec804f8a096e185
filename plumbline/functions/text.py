"""Scalar functions as Column expressions. Blank means null or nothing but characters up to U+0020."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that trimming takes off.
EDGES = "".join(map(chr, range(33)))
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(EDGES))


def is_blank(c: Column | str) -> Column:
    return col(c).isNull() | (trim(c) == "")


def or_else(c: Column | str, text: str) -> Column:
    """The value, or text where it is blank: '<none>', '<empty>' or ''."""
    return F.when(is_blank(c), F.lit(text)).otherwise(col(c))


def first_non_blank(*cs: Column | str) -> Column:
    return F.coalesce(*(F.when(~is_blank(c), col(c)) for c in cs), F.lit(""))


def normalize_id(c: Column | str) -> Column:
    """Trimmed, one slash at the end dropped; null where blank."""
    t = trim(c)
    return F.when(t != "", F.regexp_replace(t, "/$", ""))


def uuid_in(c: Column | str, otherwise: Column | None = None) -> Column:
    """The first UUID in the text, else `otherwise` (the text itself unless given)."""
    found = F.regexp_extract(col(c), UUID, 0)
    return F.when(found != "", found).otherwise(col(c) if otherwise is None else otherwise)


def local_name(c: Column | str, separators: str = "/#:") -> Column:
    """What follows the last separator; the whole text where there is none or it is the last character."""
    found = F.regexp_extract(col(c), f"[{separators}]([^{separators}]+)$", 1)
    return F.when(found != "", found).otherwise(col(c))


def resource_name(c: Column | str) -> Column:
    """What follows the last slash or hash: nothing where it is the last character."""
    return F.regexp_replace(col(c), r"(?s)^.*[/#]", "")


def normalize_term(c: Column | str) -> Column:
    return F.lower(trim(F.coalesce(col(c), F.lit(""))))


def normalize_uri(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(trim(c), "^https?://", ""), "/$", "")


def uri_candidates(c: Column | str) -> Column:
    """array<string>: the URI and its unversioned form, each with either scheme."""
    u = trim(c)
    swap = lambda x: F.when(x.startswith("http://"), F.regexp_replace(x, "^http:", "https:")).when(x.startswith("https://"), F.regexp_replace(x, "^https:", "http:")).otherwise(x)
    plain = F.regexp_replace(F.regexp_replace(u, "(/terms/version/.*)-[0-9]{4}-[0-9]{2}-[0-9]{2}$", "$1"), "/terms/version/", "/terms/")
    return F.array_distinct(F.array(u, swap(u), plain, swap(plain)))


def test_type_of(name: Column | str, type_name: Column | str) -> Column:
    n, t = F.lower(col(name)), F.lower(F.coalesce(col(type_name), F.lit("")))
    out = F.lit("UNKNOWN")
    for text, kind in reversed((("validation", "VALIDATION"), ("issue", "ISSUE"), ("measure", "MEASURE"), ("amendment", "AMENDMENT"))):
        out = F.when(t.endswith(text), F.lit(kind)).otherwise(out)
    for text, kind in reversed((("amend", "AMENDMENT"), ("measure", "MEASURE"), ("issue", "ISSUE"), ("validation", "VALIDATION"))):
        out = F.when(n.contains(text), F.lit(kind)).otherwise(out)
    return out


def phase_of(test_type: Column | str) -> Column:
    return F.when(col(test_type) == "AMENDMENT", "AMENDMENT").otherwise("PRE_AMENDMENT")


def cast_argument(c: Column | str, kind: str) -> Column:
    """A rule's argument as its type: null where it is null or not a value of the type (see bad_argument)."""
    v = col(c)
    if kind in ("int", "long"):
        return F.when(v.rlike("^[+-]?[0-9]+$"), v.try_cast("int" if kind == "int" else "bigint"))
    if kind in ("double", "float"):
        return F.when(v.rlike(r"^[\x00-\x20]*[+-]?(NaN|Infinity|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)[fFdD]?[\x00-\x20]*$"), F.regexp_replace(trim(v), "(?<=[0-9.])[fFdD]$", "").try_cast(kind))
    if kind == "boolean":
        return F.when(v.isNotNull(), F.lower(v) == "true")
    return v


def bad_argument(c: Column | str, kind: str) -> Column:
    return col(c).isNotNull() & cast_argument(c, kind).isNull() & F.lit(kind in ("int", "long", "double", "float"))


def outcome(status: Column, result: Column, amendments: Column, phase: str) -> Column:
    """Outcome of a response from its status, else from its amendments and result."""
    fails = F.when(F.coalesce(F.lower(result) == "false", F.lit(False)), "FAILED").otherwise("PASSED")
    blank = F.when(F.coalesce(F.size(amendments), F.lit(0)) > 0, F.lit("AMENDED")).otherwise(fails) if phase == "AMENDMENT" else fails
    return (
        F.when(status == "ERROR", "ERROR")
        .when(status.isin("AMENDED", "FILLED_IN"), "AMENDED")
        .when(status.isin("NOT_AMENDED", "NOT_RUN", "INTERNAL_PREREQUISITES_NOT_MET", "EXTERNAL_PREREQUISITES_NOT_MET"), "FAILED")
        .when(status == "RUN_HAS_RESULT", "PASSED")
        .when(is_blank(status), blank)
        .otherwise(fails)
    )


def message(comment: Column, status: Column, result: Column, error: Column) -> Column:
    told = F.when(is_blank(result), status).otherwise(F.concat(status, F.lit(" ["), result, F.lit("]")))
    return F.when(error.isNotNull(), error).when(~is_blank(comment), comment).when(~is_blank(status), told).otherwise(result)


def map_text(m: Column | str) -> Column:
    """A map as {k=v, k2=v2}, in the map's order; {} for an empty one."""
    each = F.transform(F.map_entries(col(m)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(each, ", "), F.lit("}"))


def amendments_json(m: Column | str) -> Column:
    return F.coalesce(F.to_json(col(m)), F.lit("{}"))


def map_difference(before: Column | str, after: Column | str) -> Column:
    """Entries of after that are new or changed; entries that went are not told."""
    return F.map_filter(col(after), lambda k, v: ~v.eqNullSafe(F.element_at(col(before), k)))


def structured_response(status: Column | str, result: Column | str) -> Column:
    """`status / result`, or the one that isn't blank; null where both are."""
    s, r = (F.when(~is_blank(c), col(c)) for c in (status, result))
    return F.nullif(F.concat_ws(" / ", s, r), F.lit(""))


def tsv_cell(c: Column | str) -> Column:
    return F.coalesce(F.translate(col(c).cast("string"), "\t\n", "  "), F.lit(""))


def rdf_response_type(test_type: Column | str, status: Column | str) -> Column:
    """Class of the typed response, null for statuses outside the vocabulary of the type."""
    t, s = col(test_type), col(status)
    unmet = ("INTERNAL_PREREQUISITES_NOT_MET", "EXTERNAL_PREREQUISITES_NOT_MET")
    run = s.isin("RUN_HAS_RESULT", *unmet)
    return (
        F.when((t == "VALIDATION") & run, "ValidationResponse")
        .when((t == "ISSUE") & run, "IssueResponse")
        .when((t == "MEASURE") & run, "MeasurementResponse")
        .when((t == "AMENDMENT") & s.isin("AMENDED", "FILLED_IN", "NOT_AMENDED", *unmet), "AmendmentResponse")
    )


def rdf_result(test_type: Column | str, result: Column | str, amendments: Column | str) -> Column:
    """What the typed response tells as its result: a word of the vocabulary, a number or JSON."""
    t, r = col(test_type), col(result)
    return (
        F.when((t == "VALIDATION") & r.isin("COMPLIANT", "NOT_COMPLIANT"), r)
        .when((t == "ISSUE") & r.isin("IS_ISSUE", "NOT_ISSUE", "POTENTIAL_ISSUE"), r)
        .when((t == "MEASURE") & (r.isin("COMPLETE", "NOT_COMPLETE") | r.try_cast("double").isNotNull()), r)
        .when(t == "AMENDMENT", amendments_json(amendments))
    )


def percent(part: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(100.0 * part / total)
