"""Reports of a run. Tables of responses are written by Spark as folders; texts and workbooks hold aggregates, or rows that are
streamed to one file (workbooks go on in a further sheet where the format's limit of rows is met)."""

from __future__ import annotations

import itertools
import os
import warnings
import zipfile
from collections.abc import Callable, Iterable, Iterator, Mapping
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import policy, rdf
from plumbline.api import Prepared, Run
from plumbline.functions import text as fx
from plumbline.model import MULTIRECORD, PHASES, UNRESOLVED, PlumblineError, Test
from plumbline.operators import execute, summary

TSV_COLUMNS = ("record_id", "test_id", "test_type", "phase", "implementation", "parameters", "response_status", "response_result", "comment", "amendments")
#: Rows of a sheet, by the format.
SHEET_ROWS = 1_048_576


def tsv_frame(r: DataFrame) -> DataFrame:
    """The ten columns of the response table as cells."""
    own = r.withColumns({"implementation": F.concat_ws("#", F.col("implementation_class"), F.col("implementation_method")), "parameters": fx.map_text("parameters"), "amendments": fx.map_text("amendments")})
    return own.select(*(fx.tsv_cell(c).alias(c) for c in TSV_COLUMNS))


def write_tsv(r: DataFrame, folder: str) -> None:
    """In the order of responses, as a folder of parts that each start with the header."""
    lines = tsv_frame(execute.ordered(r))
    lines.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(folder)


def turtle_literal(c: Column) -> Column:
    out = c
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.concat(F.lit('"'), out, F.lit('"'))


#: Namespaces of the published vocabularies.
BDQ, DWC, RDF_TYPE, RDFS_LABEL = "https://rs.tdwg.org/bdqffdq/terms/", "http://rs.tdwg.org/dwc/terms/", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2000/01/rdf-schema#label"
#: Results that are resources; others are values.
RESULT_WORDS = ("COMPLIANT", "NOT_COMPLIANT", "IS_ISSUE", "NOT_ISSUE", "POTENTIAL_ISSUE", "COMPLETE", "NOT_COMPLETE")


def turtle_lines(r: DataFrame, records: DataFrame | None = None, specifications: Mapping[str, str] | None = None) -> DataFrame:
    """value: N-Triples lines (a subset of Turtle) of one report, its implementations, their mechanisms and responses. A response applies to its
    record; sentinels have none. Only terms with the prefix dwc: and a value are told of records. specifications: of tests, where the
    definitions tell them; implementations use them."""
    own, report = "urn:plumbline:", "<urn:plumbline:report>"
    term = lambda x: f"<{BDQ}{x}>"
    node = lambda kind, *cs: F.concat(F.lit(f"<{own}{kind}:"), F.sha2(F.concat_ws("|", *cs), 256), F.lit(">"))
    impl = node("implementation", "test_id", "test_type", "implementation_class", "implementation_method")
    resp = node("response", "phase", "test_id", F.coalesce("record_ord", F.lit(-1)).cast("string"), "record_id", "implementation_class", "implementation_method")
    record = node("record", F.col("record_ord").cast("string"))
    line = lambda s, p, o: F.when(o.isNotNull(), F.concat(s, F.lit(f" {p} "), o, F.lit(" .")))
    a, text = f"<{RDF_TYPE}>", lambda c: F.when(~fx.is_blank(c), turtle_literal(c))
    typed = fx.rdf_response_type("test_type", "response_status")
    told = fx.rdf_result("test_type", "response_result", "amendments")
    word = told.isin(*RESULT_WORDS) & (F.col("test_type") != "AMENDMENT")
    resource = lambda c: F.concat(F.lit(f"<{BDQ}"), c, F.lit(">"))
    comment = F.when(~fx.is_blank("comment"), F.col("comment")).otherwise(F.col("message"))
    rows = r.select(F.explode(F.filter(F.array(
        F.concat(F.lit(f"{report} {term('containsResponse')} "), resp, F.lit(" .")),
        F.concat(impl, F.lit(f" {term('producesResponse')} "), resp, F.lit(" .")),
        line(resp, a, resource(F.coalesce(typed, F.lit("Response")))),
        line(resp, term("hasResponseStatus"), F.when(typed.isNotNull(), resource(F.col("response_status")))),
        line(resp, term("hasResponseResult"), F.when(typed.isNotNull() & word, resource(told))),
        line(resp, term("hasResponseResultValue"), F.when(typed.isNotNull() & ~word, turtle_literal(told))),
        line(resp, term("hasResponseComment"), text(comment)), line(resp, f"<{own}phase>", turtle_literal(F.col("phase"))),
        line(resp, term("appliesTo"), F.when(F.col("record_ord").isNotNull() & ~F.col("record_id").isin(MULTIRECORD, UNRESOLVED) & ~fx.is_blank("record_id"), record)),
    ), lambda x: x.isNotNull())).alias("value"))
    # each implementation once, with its mechanism and its test's specification
    once = r.select("test_id", "test_type", "implementation_class", "implementation_method").distinct()
    mechanism = node("mechanism", "implementation_class", "implementation_method")
    used = F.create_map(*(F.lit(x) for kv in sorted((specifications or {}).items()) for x in kv)).cast("map<string,string>")
    impls = once.select(F.explode(F.filter(F.array(
        F.concat(impl, F.lit(f" {a} {term('Implementation')} .")), line(impl, term("implementedBy"), mechanism), F.concat(mechanism, F.lit(f" {a} {term('Mechanism')} .")),
        line(mechanism, f"<{RDFS_LABEL}>", turtle_literal(F.concat_ws("#", "implementation_class", "implementation_method"))),
        line(impl, term("usesSpecification"), F.concat(F.lit("<"), F.try_element_at(used, F.col("test_id")), F.lit(">"))),
    ), lambda x: x.isNotNull())).alias("value"))
    head = r.sparkSession.createDataFrame([(f"{report} {a} {term('DataQualityReport')} .",)], "value string")
    out = head.unionByName(impls.distinct()).unionByName(rows)
    if records is not None:
        terms = [c for c in execute.terms(records) if c.startswith("dwc:")]
        if terms:
            each = records.select(F.explode(F.filter(F.array(*(F.when(~fx.is_blank(F.col(f"`{t}`")), F.concat(record, F.lit(f" <{DWC}{t.removeprefix('dwc:')}> "), turtle_literal(F.col(f"`{t}`")), F.lit(" ."))) for t in terms)), lambda x: x.isNotNull())).alias("value"))
            out = out.unionByName(each)
    return out


def specifications_of(prepared: Prepared) -> dict[str, str]:
    """The specification of each test that the definitions name."""
    if not prepared.definitions:
        return {}
    index = policy.Specifications(rdf.load(prepared.definitions))
    return {t.id: found[0] for t in prepared.plan.tests if (found := index.of(t.id, t.type))}


def write_turtle(r: DataFrame, folder: str, records: DataFrame | None = None, specifications: Mapping[str, str] | None = None) -> None:
    turtle_lines(r, records, specifications).write.mode("overwrite").text(folder)


def section(title: str, counts: DataFrame) -> Iterator[str]:
    yield f"{title}:"
    rows = counts.orderBy(F.desc("n"), F.lower("key"), "key").collect()  # few: keys of a vocabulary, or the top ten
    yield from (f"  {x['key']}: {x['n']}" for x in rows) if rows else ["  <none>"]
    yield ""


def phase_section(r: DataFrame) -> Iterator[str]:
    got = {x["key"]: x["n"] for x in summary.counts_by(r, "phase").collect()}
    yield "By phase:"
    yield from (f"  {p}: {got[p]}" for p in [*(p for p in PHASES if p in got), *sorted(set(got) - set(PHASES))])
    yield ""


def measure_cell(row) -> str:
    p = row["parameters"] or {}
    if row["response_result"] is None:
        return "no result"
    if "matchingCount" in p:
        return f"{p['matchingCount']}/{p['totalRecords']} ({p['percentage']}%)"
    return row["response_result"]


def measure_section(title: str, kind: str, r: DataFrame) -> Iterator[str]:
    cells: dict[str, dict[str, str]] = {}
    for x in summary.multirecord_measures(r).where(F.col("implementation_method") == kind).orderBy("test_id", "phase_ord").collect():
        told = measure_cell(x) if kind == "count" else f"{x['response_result']} {measure_cell(x)}"
        cells.setdefault(x["test_id"], {})[x["phase"]] = told
    yield f"{title}:"
    for test in sorted(cells):
        yield f"  {test}: " + ", ".join(f"{p} {cells[test].get(p, 'not run')}" for p in (PHASES[0], PHASES[2]))
    if not cells:
        yield "  <none>"
    yield ""


def use_case_label(id: str, label: str) -> str:
    return f"{id} ({label})" if id and label and id != label else id or label or "<unknown>"


def summary_text(run: Run) -> str:
    """Context, explanation, counts by phase, status and result, the measures and the most frequent amendments, in this order."""
    r, p = run.responses.persist(), run.prepared
    n_terms, n_records = summary.metadata(p.records).first()
    out = ["Data quality summary", f"Use case: {use_case_label(p.plan.use_case.id, p.plan.use_case.label)}", f"Input: {p.source or '<table>'}", f"Terms: {n_terms}, records: {n_records}", "", "Every count is of responses: one for each record, test and phase.", ""]
    out += phase_section(r)
    out += section("By response status", summary.counts_by(r, "response_status"))
    out += section("By response result", summary.keywords(summary.counts_by(r, "response_result")))
    out += measure_section("COUNT measures", "count", r)
    out += measure_section("QA measures", "qa", r)
    out += section("Most frequent values filled in", summary.top(summary.filled_in(r)))
    terms = execute.terms(p.records)
    out += section("Most frequent values amended", summary.top(summary.amended_pairs(r, p.records, terms)))
    r.unpersist()
    return "\n".join(out)


def described(prepared: Prepared, test: Test) -> list[str]:
    """What the definitions say of a test, over its versions."""
    if not prepared.definitions:
        return [f"{k}: {v}" for k, v in test.metadata.items()]
    x = policy.Specifications(rdf.load(prepared.definitions)).described(test.id)
    terms = lambda of: ", ".join(f"dwc:{policy.local(t)}" for t in of)
    out = [f"Description: {x['description']}"] if x["description"] else []
    out += [f"{k.capitalize()}: {policy.local(x[k])}" for k in ("dimension", "criterion", "enhancement") if x[k]]
    out += [f"Acts upon: {terms(x['acts_upon']) or '(none found)'}"] + ([f"Consults: {terms(x['consults'])}"] if x["consults"] else [])
    return out + [f"{k}: {v}" for k, v in test.metadata.items()]


def test_summary(run: Run, test_id: str) -> str:
    """What a test is, its outcomes and the ten most frequent values of its terms, by phase. Values are the source's. Only the test's rule is run."""
    test = next((t for t in run.prepared.plan.tests if t.id == test_id), None)
    if test is None:
        raise PlumblineError(f"no test {test_id}")
    own = run.of(test_id=test_id).persist()
    fields = next((b.fields for b in run.prepared.bound.bindings if b.test.id == test_id and b.measure is None), ())
    out = [f"{test.label} ({test.id})", f"Type: {test.type}", *described(run.prepared, test), ""]
    tallies: dict[str, list] = {}
    for x in summary.outcome_tally(own).collect():  # keys of a vocabulary, by phase
        tallies.setdefault(x["phase"], []).append(x)
    for phase in (p for p in PHASES if p in tallies):
        out.append(f"{phase} outcomes:")
        out += [f"  {x['key']}: {x['n']}" for x in sorted(tallies[phase], key=lambda x: (-x["n"], x["key"].lower(), x["key"]))] + [""]
        for f in fields:
            out.append(f"{phase} values of {f}:")
            rows = summary.top_with_rest(summary.value_tally(own.where(F.col("phase") == phase), run.prepared.records, f)).collect()
            out += [f"  {x['key']}" if x["key"].startswith("... and ") else f"  {x['key']}: {x['n']}" for x in rows] + [""]
    own.unpersist()
    return "\n".join(out if tallies else [*out, "No responses of this test."])


# -- workbooks -----------------------------------------------------------------------------------------


def column_letters(i: int) -> str:
    out = ""
    while i >= 0:
        i, r = divmod(i, 26)
        out, i = chr(65 + r) + out, i - 1
    return out


def paged(sheets: Iterable[tuple[str, Iterable[Iterable]]]) -> Iterator[tuple[str, Iterable[Iterable]]]:
    """Sheets of at most SHEET_ROWS rows: what is more goes on in sheets of the same name and a number, each with the first row at its top."""
    for name, rows in sheets:
        rows, page = iter(rows), 1
        first = next(rows, None)
        if first is None:
            yield name, []
            continue
        ahead: list = []

        def some(rows=rows, first=first, ahead=ahead) -> Iterator:
            yield first
            for n, row in enumerate(itertools.chain(ahead[:], rows), 2):
                if n > SHEET_ROWS:
                    ahead[:] = [row]
                    return
                yield row
            ahead.clear()

        while True:
            yield name if page == 1 else f"{name[:25]} ({page})", some()
            if not ahead:
                break
            page += 1


def write_workbook(path: str, sheets: Iterable[tuple[str, Iterable[Iterable]]]) -> None:
    """Sheets of text cells as Office Open XML, streamed row by row."""
    names = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, rows in paged(sheets):
            names.append(name)
            with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as f:
                f.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                for n, row in enumerate(rows, 1):
                    cells = "".join(f'<c r="{column_letters(i)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(clean(v))}</t></is></c>' for i, v in enumerate(row))
                    f.write(f'<row r="{n}">{cells}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
        head = '<?xml version="1.0" encoding="UTF-8"?>'
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("[Content_Types].xml", head + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1)) + "</Types>")
        z.writestr("_rels/.rels", head + f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", head + f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", head + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")


def clean(v) -> str:
    return "" if v is None else "".join(c for c in str(v) if c >= " " or c in "\t\n\r")


def streamed(df: DataFrame) -> Iterator[list]:
    yield df.columns
    for row in df.toLocalIterator():
        yield list(row)


def record_sheets(run: Run) -> Iterator[tuple[str, Iterable]]:
    """Summary, Initial Values, Final Values, Measures, Validations, Amendments, Issues. Sentinels and rows of unknown type are left out."""
    records, amended = run.prepared.records, run.amended
    every = summary.per_record(run.responses)
    r = every.join(records.select("record_ord"), "record_ord", "left_semi")
    if not r.limit(1).count():
        yield "Summary", [["No responses of records"]]
        return
    if astray := every.join(records.select("record_ord"), "record_ord", "left_anti").count():
        warnings.warn(f"{astray} responses have no record and are left out of the workbook", stacklevel=2)
    fields = sorted({f for b in run.prepared.bound.bindings for f in b.fields})
    yield "Summary", [[line] for line in summary_text(run).split("\n")]
    for title, df in (("Initial Values", records), ("Final Values", amended)):
        yield title, streamed(summary.padded(df.orderBy("record_ord"), fields, "dwc:occurrenceID"))
    for title, kind in (("Measures", "MEASURE"), ("Validations", "VALIDATION"), ("Amendments", "AMENDMENT"), ("Issues", "ISSUE")):
        own = r.where(F.col("test_type") == kind)
        value = fx.map_text(F.transform_values(F.transform_keys("amendments", lambda k, v: F.regexp_replace(k, "^dwc:", "")), lambda k, v: F.coalesce(v, F.lit("")))) if kind == "AMENDMENT" else F.coalesce("response_result", F.lit(""))
        yield title, streamed(own.orderBy("record_ord", "phase_ord", "test_id").select("record_id", "test_id", "phase", "response_status", value.alias("value"), F.coalesce("comment", F.lit("")).alias("comment")))


def sentinel_rows(r: DataFrame) -> DataFrame:
    return summary.sentinels(r).orderBy("phase_ord", "test_id").select("record_id", "test_id", "phase", "response_status", "response_result", fx.first_non_blank("comment", "message").alias("comment"))


def write_reports(run: Run, folder: str, formats: Iterable[str] = ("summary", "tsv", "rdf", "xlsx", "unresolved")) -> list[str]:
    """dq-report-<format> for each format. All are tried; what can't be written is told as one error in the end."""
    r = execute.ordered(run.responses)
    at = lambda name: os.path.join(folder, f"dq-report-{name}")

    def text() -> str:
        with open(at("summary.txt"), "w", encoding="utf-8") as f:
            f.write(summary_text(run))
        return at("summary.txt")

    writers: dict[str, Callable[[], str]] = {
        "summary": text,
        "tsv": lambda: write_tsv(r, at("tsv")) or at("tsv"),
        "rdf": lambda: write_turtle(r, at("rdf"), run.prepared.records, specifications_of(run.prepared)) or at("rdf"),
        "xlsx": lambda: write_workbook(at("xlsx.xlsx"), record_sheets(run)) or at("xlsx.xlsx"),
        "unresolved": lambda: write_workbook(at("unresolved.xlsx"), [("Unresolved & Multi-record", streamed(sentinel_rows(r)))]) or at("unresolved.xlsx"),
    }
    done, failed = [], []
    try:
        os.makedirs(folder, exist_ok=True)
    except OSError as e:
        raise PlumblineError(f"the reports can't be written: {e}") from e
    for f in formats:
        try:
            done.append(writers[f]())
        except (OSError, PlumblineError) as e:
            failed.append(f"{f}: {e}")
    if failed:
        raise PlumblineError(f"the reports can't be written: {'; '.join(failed)}")
    return done
