import json
import zipfile

import pytest

from plumbline import policy, rdf
from plumbline.model import PlumblineError
from plumbline.sources import cached, config, names, read_records, read_settings, strict_bool, threads, write_settings

NS = "@prefix b: <urn:dq:> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .\n"


def archive(path, entries):
    with zipfile.ZipFile(path, "w") as z:
        for n, t in entries.items():
            z.writestr(n, t)
    return str(path)


def test_darwin_core_archive(spark, tmp_path):
    p = archive(tmp_path / "d.ZIP", {"a.txt": "x\n1\n", "occurrence.txt": ' occurrenceID \tdwc:country\tnote\nocc-1\t Greenland \t"a ""q""\nb"\n\t\tz\nocc-3\tDenmark\n'})
    got = [tuple(r) for r in read_records(spark, p).orderBy("record_ord").collect()]
    assert got == [(1, "occ-1", "occ-1", "Greenland", 'a "q"\nb'), (2, "", "", "", "z"), (3, "occ-3", "occ-3", "Denmark", None)]
    q = archive(tmp_path / "e.zip", {"m.xml": "", "other.txt": "country\nFR\n"})
    assert read_records(spark, q).first().record_id == "row-1"
    with pytest.raises(PlumblineError):
        read_records(spark, archive(tmp_path / "f.zip", {"m.xml": ""})).collect()


def test_data_package(spark, tmp_path):
    (tmp_path / "r.csv").write_text('id,dwc:eventDate\n7,"2020, May"\n8,\n')
    (tmp_path / "p.json").write_text(json.dumps({"resources": [{"path": "r.csv"}, {"path": "ignored.csv"}]}))
    got = [tuple(r) for r in read_records(spark, str(tmp_path / "p.json")).collect()]
    assert got == [(1, "7", "7", "2020, May"), (2, "8", "8", "")]
    (tmp_path / "q.json").write_text('{"resources": []}')
    with pytest.raises(PlumblineError):
        read_records(spark, str(tmp_path / "q.json"))
    with pytest.raises(PlumblineError, match="Unsupported"):
        read_records(spark, "x.parquet")


def test_settings_and_config(spark, tmp_path):
    write_settings({"t": {"useDefaults": False, "parameters": {"p": "1"}}}, str(tmp_path / "s.json"))
    assert read_settings(str(tmp_path / "s.json"))["t"]["parameters"] == {"p": "1"}
    assert names(" a, ,b ") == ["a", "b"] and strict_bool("TRUE") and threads("2") == 2
    for bad in (lambda: strict_bool("yes"), lambda: threads("0")):
        with pytest.raises(Exception):
            bad()
    spark.conf.set("plumbline.reports", "from-session")
    assert config({"definitions": "x"}, spark)["reports"] == "from-session"
    spark.conf.unset("plumbline.reports")
    assert cached(str(tmp_path / "s.json"), str(tmp_path)) and pytest.raises(PlumblineError, cached, " ", ".") and pytest.raises(PlumblineError, cached, "/none/here", ".")


def test_turtle():
    t = rdf.parse_turtle(NS + '<urn:t:1> a b:Validation ; rdfs:label "A \\"q\\""@en , """x\ny""" ; b:n 1, 2.5, true ; b:x [ b:y <urn:z> ] ; b:l ( 1 "b" ) . # end\nb:t2 a b:Test.')
    assert rdf.Triple("urn:t:1", rdf.TYPE, rdf.iri("urn:dq:Validation")) in t
    assert any(x.o == rdf.Term("literal", 'A "q"', None, "en") for x in t) and any(x.o.value == "x\ny" for x in t)
    assert {x.o.datatype for x in t if x.p == "urn:dq:n"} == {rdf.XSD + k for k in ("integer", "decimal", "boolean")}
    assert sum(x.p.endswith("#rest") for x in t) == 2 and t[-1].s == "urn:dq:t2"
    with pytest.raises(PlumblineError):
        rdf.parse_turtle("<a> <b> .. ")


def test_rdfxml_and_jsonld():
    x = rdf.parse_rdfxml('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:b="urn:dq:"><b:UseCase rdf:about="urn:u"><b:label>L</b:label><b:policy rdf:resource="urn:p"/></b:UseCase></rdf:RDF>')
    j = rdf.parse_jsonld('{"@context": {"b": "urn:dq:", "policy": {"@id": "b:policy", "@type": "@id"}}, "@graph": [{"@id": "urn:u", "@type": "b:UseCase", "b:label": "L", "policy": "urn:p"}]}')
    assert set(x) == set(j) and len(x) == 3


@pytest.mark.parametrize(
    "name, text",
    [
        ("u.xml", '<usecases><useCase id="urn:u" label="L" policy="urn:p"/></usecases>'),
        ("u.xml", '<b:UseCases xmlns:b="urn:b"><b:UseCase b:id="urn:u"><b:label>L</b:label><b:policy>urn:p</b:policy></b:UseCase></b:UseCases>'),
        ("u.xml", '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:b="urn:b:"><b:UseCase rdf:about="urn:u"><b:label>L</b:label><b:policy rdf:resource="urn:p"/></b:UseCase></rdf:RDF>'),
        ("u.ttl", NS + '<urn:u> a b:UseCase ; rdfs:label "L" ; b:hasPolicy <urn:p> .'),
        ("u.json", '{"@id": "urn:u", "@type": "urn:b:UseCase", "urn:b:label": "L", "urn:b:hasPolicy": {"@id": "urn:p"}}'),
    ],
)
def test_use_cases(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    (got,) = policy.use_cases(str(tmp_path / name)).values()
    assert (got.id, got.label, got.policy) == ("urn:u", "L", "urn:p")


def test_use_case_errors_and_choice(tmp_path):
    (tmp_path / "bad.xml").write_text('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><b:UseCase></rdf:RDF>')
    with pytest.raises(PlumblineError, match="RDF/XML"):
        policy.use_cases(str(tmp_path / "bad.xml"))
    cases = {"http://x/u": policy.UseCase("http://x/u"), "urn:2": policy.UseCase("urn:2")}
    assert policy.pick(cases, "https://x/u/").id == "http://x/u"
    with pytest.warns(UserWarning):
        assert policy.pick(cases, "urn:none").id == "http://x/u"
    with pytest.raises(PlumblineError):
        policy.pick({}, "a")


def test_resolution(tmp_path):
    (tmp_path / "u.xml").write_text('<usecases><useCase id="http://x/terms/version/U-2024-01-01" policy="urn:p"/></usecases>')
    (tmp_path / "d.ttl").write_text(
        NS
        + """<urn:p> b:hasTest <urn:test:validate>, <urn:test:nolabel> .
    <urn:q> a b:ValidationPolicy ; b:hasUseCase <https://x/terms/U> ; b:requires <urn:need:1> .
    b:requires rdfs:range b:Issue . b:Issue rdfs:subClassOf b:DataQualityNeed .
    <urn:need:1> a b:Issue ; rdfs:label "ISSUE_ONE" ; b:hasExpectedResponse "told" .
    <urn:test:validate> a b:Validation ; rdfs:label "VALIDATION_ONE" ."""
    )
    plan = policy.resolve([str(tmp_path / "d.ttl"), "/missing.ttl"], str(tmp_path / "u.xml"), None)
    assert [(t.id, t.type) for t in plan.tests] == [("urn:test:validate", "VALIDATION"), ("urn:need:1", "ISSUE")]
    assert plan.unresolved == ("urn:test:nolabel",) and plan.tests[1].metadata == {"expectedResponse": "told"}
    per, total = policy.statistics([str(tmp_path / "d.ttl")])
    assert total["use_cases"] == 1 and total["policies"] == 1 and per[str(tmp_path / "d.ttl")]["tests"] == 2


def test_specification_chain():
    t = rdf.parse_turtle(NS + '<urn:t-2024-01-01> b:isVersionOf <urn:t> . <urn:m> b:forValidation <urn:t-2024-01-01> ; b:hasSpecification <urn:s> . <urn:s> rdfs:label "Spec" .')
    assert policy.specification(t, "urn:t", "VALIDATION") == ("urn:s", "Spec") and policy.specification(t, "urn:none", "ISSUE") is None


def test_datasets_in_a_store_that_only_spark_reads(spark, tmp_path):
    """An archive and a data package by viewfs."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.own.link./data", f"file://{tmp_path}")
    with zipfile.ZipFile(tmp_path / "remote.zip", "w") as z:
        z.writestr("occurrence.txt", "occurrenceID\tcountry\nocc-1\tDE\nocc-2\n")
    (tmp_path / "remote.json").write_text('{"resources": [{"path": "remote.csv"}]}')
    (tmp_path / "remote.csv").write_text('id,country\n7,"F, R"\n')
    got = read_records(spark, "viewfs://own/data/remote.zip").orderBy("record_ord").collect()
    assert [(r.record_id, r.country) for r in got] == [("occ-1", "DE"), ("occ-2", None)]
    assert [(r.record_id, r.country) for r in read_records(spark, "viewfs://own/data/remote.json").collect()] == [("7", "F, R")]
