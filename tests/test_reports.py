import os
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline import rdf
from plumbline.api import prepare, run
from plumbline.cli import main
from plumbline.model import PlumblineError, Test
from plumbline.operators import execute, summary
from plumbline.reports import column_letters, specifications_of, summary_text, test_summary, tsv_frame, turtle_lines, write_reports
from plumbline.streaming import run_stream

test_summary.__test__ = False
Test.__test__ = False


@pytest.fixture(scope="module")
def done(spark):
    df = spark.createDataFrame([(1, "r1", "F", "1-URGENT", "10"), (2, "r2", "P", "4-NOT SPECIFIED", "20\t")], "record_ord long, record_id string, o_orderstatus string, o_orderpriority string, `dwc:country` string")
    tests = [Test("urn:rule:orderstatus", "VALIDATION_O"), Test("urn:rule:priorityname", "A", "AMENDMENT"), Test("urn:none", "N"), Test("m", "MULTIRECORD_MEASURE_COUNT_COMPLIANT_O", "MEASURE")]
    return run(prepare(spark, df, tests=tests))


def test_texts(done):
    text = summary_text(done)
    for want in ("COUNT measures:", "  m: PRE_AMENDMENT 1/2 (50.0%), POST_AMENDMENT 1/2 (50.0%)", "o_orderpriority=MEDIUM: 1", "o_orderpriority: 1-URGENT -> URGENT: 1", "QA measures:\n  <none>"):
        assert want in text
    assert [text.index(x) for x in ("By phase", "By response status", "By response result", "COUNT", "QA", "filled in", "values amended")] == sorted(text.index(x) for x in ("By phase", "By response status", "By response result", "COUNT", "QA", "filled in", "values amended"))
    assert "RUN_HAS_RESULT | COMPLIANT: 1" in test_summary(done, "urn:rule:orderstatus")


def test_tables(done):
    rows = tsv_frame(execute.ordered(done.responses)).collect()
    assert len(rows) == 9 and "{o_orderpriority=URGENT}" in {r.amendments for r in rows}
    lines = [r.value for r in turtle_lines(done.responses, done.prepared.records).collect()]
    graph = rdf.parse_turtle("\n".join(lines))
    kinds = [t.o.value.rpartition("/")[2] for t in graph if t.p == rdf.TYPE]
    assert kinds.count("ValidationResponse") == 4 and kinds.count("DataQualityReport") == 1 and kinds.count("MeasurementResponse") == 2
    assert sum(t.p.endswith("/country") for t in graph) == 2


def test_report_as_a_graph(done):
    """Shapes of the published vocabulary: what a report, an implementation and a response are linked with."""
    lines = [r.value for r in turtle_lines(done.responses, done.prepared.records, {"urn:rule:orderstatus": "urn:spec:1"}).collect()]
    graph = rdf.parse_turtle("\n".join(lines))
    by = lambda p: [(t.s, t.o.value) for t in graph if t.p.rpartition("/")[2] == p or t.p == p]
    typed = {}
    for s, o in by(rdf.TYPE):
        typed.setdefault(o.rpartition("/")[2], set()).add(s)
    responses = set().union(*(v for k, v in typed.items() if k.endswith("Response")))
    contained, produced, applied = by("containsResponse"), by("producesResponse"), dict(by("appliesTo"))
    assert {o for _, o in contained} == responses and sorted(o for _, o in produced) == sorted(responses)
    assert {s for s, _ in contained} == typed["DataQualityReport"] and {s for s, _ in produced} == typed["Implementation"]
    assert {s for s, _ in by("implementedBy")} == typed["Implementation"] and {o for _, o in by("implementedBy")} == typed["Mechanism"]
    assert [o for _, o in by("usesSpecification")] == ["urn:spec:1"]
    # sentinels apply to no record; the others to nodes that hold the records' terms
    assert len(applied) == done.responses.where("record_ord is not null").count() and {s for s, _ in by("country")} == set(applied.values())
    status, result = dict(by("hasResponseStatus")), dict(by("hasResponseResult"))
    assert set(result) <= set(status) and {x.rpartition("/")[2] for x in result.values()} == {"COMPLIANT", "NOT_COMPLIANT"}
    assert not set(result) & set(dict(by("hasResponseResultValue")))


def test_sheets_go_on_and_reports_fail_together(done, tmp_path, monkeypatch):
    from plumbline import reports

    monkeypatch.setattr(reports, "SHEET_ROWS", 3)
    reports.write_workbook(str(tmp_path / "w.xlsx"), [("Rows", [["head"], *([str(i)] for i in range(5))]), ("None", []), ("Full", [["h"], ["a"], ["b"]])])
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        assert len([x for x in z.namelist() if "sheet" in x]) == 5 and b'name="Rows (3)"' in z.read("xl/workbook.xml")
        assert [z.read(f"xl/worksheets/sheet{i}.xml").count(b"<row ") for i in range(1, 6)] == [3, 3, 2, 0, 3]
    (tmp_path / "r").mkdir()
    (tmp_path / "r/dq-report-summary.txt").mkdir()
    with pytest.raises(PlumblineError, match="summary"):
        write_reports(done, str(tmp_path / "r"), ["summary", "unresolved"])
    assert (tmp_path / "r/dq-report-unresolved.xlsx").exists()


def test_summary_from_definitions(spark, tmp_path):
    """What the definitions say of a test and its versions comes with how it did; they may be at an address."""
    import http.server
    import threading

    b, d, l, v = "https://rs.tdwg.org/bdqffdq/terms/", "http://purl.org/dc/terms/", "<http://www.w3.org/2000/01/rdf-schema#label>", "<http://purl.org/dc/terms/isVersionOf>"
    (tmp_path / "d.ttl").write_text(f"""<urn:p> <urn:x:hasTest> <urn:rule:orderstatus> . <urn:rule:orderstatus> {l} "VALIDATION_O" . <urn:rule:orderstatus> <{d}description> "Is it final?" . <urn:rule:orderstatus> <{rdf.TYPE}> <{b}Validation> .
    <urn:v:1> {v} <urn:rule:orderstatus> . <urn:v:1> <{b}hasDataQualityDimension> <{b}Conformance> . <urn:v:1> <{b}hasActedUponInformationElement> <urn:ie:1> . <urn:ie:1> <{b}composedOf> <http://rs.tdwg.org/dwc/terms/country> .
    <urn:m:1> <{b}forValidation> <urn:v:1> . <urn:m:1> <{b}hasSpecification> <urn:spec:1> .""")
    (tmp_path / "u.xml").write_text('<usecases><useCase id="urn:u" policy="urn:p"/></usecases>')
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), lambda *a: http.server.SimpleHTTPRequestHandler(*a, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    df = spark.createDataFrame([(1, "r1", "F"), (2, "r2", "P"), (3, "r3", None)], "record_ord long, record_id string, o_orderstatus string")
    made = prepare(spark, df, [f"{at}/d.ttl"], f"{at}/u.xml", cache=str(tmp_path / "cache"))
    server.shutdown()
    text = test_summary(run(prepare(spark, df, [f"{at}/d.ttl"], f"{at}/u.xml", cache=str(tmp_path / "cache"))), "urn:rule:orderstatus")  # from the cache
    for want in ("Description: Is it final?", "Dimension: Conformance", "Acts upon: dwc:country", "POST_AMENDMENT outcomes:\n  INTERNAL_PREREQUISITES_NOT_MET: 1\n  RUN_HAS_RESULT | COMPLIANT: 1", "  <no value>: 1"):
        assert want in text
    assert specifications_of(made) == {"urn:rule:orderstatus": "urn:spec:1"}


def test_progress_and_review(done, tmp_path):
    heard = []
    counts = done.write(str(tmp_path / "r"), lambda event, phase, n: heard.append((event, phase, sum(n.values()))))
    assert heard == [("start", "", 0), ("end", "PRE_AMENDMENT", 4), ("end", "AMENDMENT", 2), ("end", "POST_AMENDMENT", 3)] and counts["AMENDMENT"] == {"AMENDED": 2}
    got = {r.test_id: (r.pre_amendment, r.post_amendment) for r in done.review().collect()}
    assert got["m"] == ("1 (50.0%)", "1 (50.0%)") and got["urn:rule:orderstatus"] == ("", "") and len(got) == 4


def test_files(done, tmp_path):
    paths = write_reports(done, str(tmp_path))
    assert all(os.path.exists(p) for p in paths)
    with zipfile.ZipFile(tmp_path / "dq-report-xlsx.xlsx") as z:
        assert 'name="Final Values"' in z.read("xl/workbook.xml").decode() and b"URGENT" in z.read("xl/worksheets/sheet3.xml")
    with zipfile.ZipFile(tmp_path / "dq-report-unresolved.xlsx") as z:
        assert b"No implementation discovered" in z.read("xl/worksheets/sheet1.xml")
    assert [column_letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_padding(done):
    got = summary.padded(done.prepared.records, ["dwc:occurrenceID", "dwc:country", "dwc:year"], "dwc:occurrenceID").orderBy("record_id").collect()
    assert [tuple(r) for r in got] == [("r1", "r1", "10", ""), ("r2", "r2", "20\t", "")]


def test_cli(tmp_path, spark):
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("occurrence.txt", "occurrenceID\to_orderstatus\nocc-1\tF\n")
    (tmp_path / "u.xml").write_text('<usecases><useCase id="urn:u" policy="urn:p"/></usecases>')
    (tmp_path / "d.ttl").write_text('<urn:p> <urn:x:hasTest> <urn:rule:orderstatus> . <urn:rule:orderstatus> <http://www.w3.org/2000/01/rdf-schema#label> "VALIDATION_O" .')
    args = ["--dataset", str(tmp_path / "d.zip"), "--use-cases", str(tmp_path / "u.xml"), "--definitions", str(tmp_path / "d.ttl"), "--reports", str(tmp_path / "r")]
    assert main(args) == 0 and (tmp_path / "r/dq-report-summary.txt").exists()
    assert main(["--nonsense"]) == 2 and main([*args[2:], "--dataset", "x.bin"]) == 1


def test_stream(spark, done, tmp_path):
    done.prepared.records.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(done.prepared.records.schema).parquet(str(tmp_path / "in"))
    run_stream(stream, done.prepared.bound.bindings, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    want = done.responses.where(F.col("record_id").isin("r1", "r2")).count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want
