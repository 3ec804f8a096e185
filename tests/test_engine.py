"""Phases, grouping, binding and measures on small record sets."""

import pytest
from pyspark.sql import functions as F

from plumbline.api import prepare, run, unresolved_rows
from plumbline.binding import COUNTED, bind, column_for, for_phase, measure_of
from plumbline.model import AMEND, POST, PRE, Binding, BoundParam, Param, Rule, Test
from plumbline.operators import execute, measures, summary
from plumbline.operators.execute import output

CALLS = "urn:calls"


def records(spark, rows, *terms):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "record_ord long, record_id string, " + ", ".join(f"`{t}` string" for t in terms))


def a_rule(kind, fn, *params, native=True, writes=(), id="t", cls="C", version=""):
    return Rule(id, version, kind, cls, fn.__name__, tuple(params), fn, native, tuple(writes) or tuple(p.source for p in params if p.role == "ACTED_UPON"))


def a_binding(rule, columns=None, phase=None, values=None, test=None):
    t = test or Test(rule.provides, rule.provides.upper(), rule.type, parameters=values or {})
    got = bind([t], [rule], columns=columns).bindings[0]
    return got if phase is None else Binding(got.test, got.rule, got.params, got.status, phase)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize(
    "fields, members",
    [(["country", "stateProvince"], [1, 2]), (["country"], [3]), ([], [3])],
)
def test_groups(spark, fields, members):
    df = records(spark, [("r1", "Greenland", "A"), ("r2", "Greenland", "B"), ("r3", "Greenland", "A")], "country", "stateProvince")
    assert sorted(r.members for r in execute.distinct_groups(df, fields).collect()) == members


def test_groups_missing_case_and_empty(spark):
    df = records(spark, [("r1", None), ("r2", None), ("r3", "Greenland"), ("r4", "greenland"), ("r5", "")], "country")
    got = execute.distinct_groups(df, ["country"]).collect()
    assert {(r.country, r.members, r.representative) for r in got} == {(None, 2, 1), ("Greenland", 1, 3), ("greenland", 1, 4), ("", 1, 5)}
    assert execute.distinct_groups(df.where("false"), ["country"]).count() == 0
    assert execute.distinct_groups(df.where("false"), []).count() == 0


def echo(x):
    return output("RUN_HAS_RESULT", "COMPLIANT", x)


def change(x):
    return output("AMENDED", None, None, F.create_map(F.lit("dwc:eventDate"), F.lit("changed")))


def test_amend_then_validate_again(spark):
    df = records(spark, [("r1", "orig")], "dwc:eventDate")
    p = Param("ACTED_UPON", "dwc:eventDate")
    bindings = [a_binding(a_rule("VALIDATION", echo, p, id="v")), a_binding(a_rule("AMENDMENT", change, p, id="a"))]
    out = execute.run_phases(df, bindings)
    assert rows(out[PRE], "comment") == [("orig",)] and rows(out[POST], "comment") == [("changed",)]
    assert rows(out[AMEND], "status", "response_status") == [("AMENDED", "AMENDED")]
    assert rows(out["amended"], "`dwc:eventDate`") == [("changed",)]
    assert rows(df, "`dwc:eventDate`") == [("orig",)]


def test_chained_amendments_and_fanout(spark):
    df = records(spark, [("r1", "Greenland", "A", None), ("r2", "Greenland", "B", "STALE")], "country", "locality", "countryCode")

    def code(country):
        return {"status": "FILLED_IN", "amendments": {"countryCode": "GL"}}

    def note(c):
        return {"status": "AMENDED", "amendments": {"note": f"code {c}"}}

    def show(loc, c):
        return {"status": "RUN_HAS_RESULT", "result": "COMPLIANT", "comment": f"{loc}:{c}"}

    acted, also = Param("ACTED_UPON", "country"), Param("CONSULTED", "countryCode")
    bindings = [
        a_binding(a_rule("AMENDMENT", code, acted, native=False, writes=("countryCode",), id="a1")),
        a_binding(a_rule("AMENDMENT", note, Param("ACTED_UPON", "countryCode"), native=False, writes=("note",), id="a2")),
        a_binding(a_rule("VALIDATION", show, Param("ACTED_UPON", "locality"), also, native=False, id="v")),
    ]
    out = execute.run_phases(df, bindings)
    assert rows(out[POST], "record_id", "comment") == [("r1", "A:GL"), ("r2", "B:GL")]
    assert rows(out["amended"], "note") == [("code GL",), ("code GL",)]


def test_python_errors_stay_with_their_rows_and_dedup_agrees(spark):
    df = records(spark, [("r1", "x"), ("r2", "bad"), ("r3", "x"), ("r4", None), ("r5", "")], "c")

    def picky(v):
        if v == "bad":
            raise RuntimeError("boom")
        return v is not None

    b = a_binding(a_rule("VALIDATION", picky, Param("ACTED_UPON", "c"), native=False))
    cols = ["record_id", "status", "response_status", "response_result", "message"]
    on, off = (rows(execute.validate(df, [b], dedup=d), *cols) for d in (True, False))
    assert on == off
    assert on[1] == ("r2", "ERROR", "ERROR", None, "RuntimeError: boom")
    assert [r[1] for r in on] == ["PASSED", "ERROR", "PASSED", "FAILED", "PASSED"]


def test_distinct_tuples_are_called_once(spark):
    df = records(spark, [(f"r{i}", c) for i, c in enumerate(["Greenland"] * 3 + ["Denmark"] * 2)], "country")
    calls = spark.sparkContext.accumulator(0)

    def counted(c):
        calls.add(1)
        return {"status": "RUN_HAS_RESULT", "result": "COMPLIANT"}

    b = a_binding(a_rule("VALIDATION", counted, Param("ACTED_UPON", "country"), native=False))
    assert len(execute.validate(df, [b]).collect()) == 5 and calls.value == 2
    assert len(execute.validate(df, [b], dedup=False).collect()) == 5 and calls.value == 7


def test_whole_record_rules_see_copies_and_amend(spark):
    df = records(spark, [("r1", "a"), ("r2", "a")], "c")

    def rewrite(record):
        record["c"] = record["c"].upper()

    b = a_binding(a_rule("AMENDMENT", rewrite, Param("LEGACY_RECORD"), native=False, writes=("c",)))
    responses, amended = execute.amend(df, [b])
    assert rows(responses, "status") == [("AMENDED",)] * 2 and rows(amended, "c") == [("A",), ("A",)]


def test_null_amendment_is_an_error(spark):
    def none(c):
        return {"status": "AMENDED", "amendments": {"c": None}}

    df = records(spark, [("r1", "a")], "c")
    responses, amended = execute.amend(df, [a_binding(a_rule("AMENDMENT", none, Param("ACTED_UPON", "c"), native=False))])
    assert rows(responses, "status") == [("ERROR",)] and rows(amended, "c") == [("a",)]


@pytest.mark.parametrize("native", [True, False])
def test_parameter_conversion(spark, native):
    df = records(spark, [("r1", "2025-01-01"), ("r2", None)], "dwc:eventDate")

    def checked(date, latest):
        if native:
            return F.when(date.isNull(), output("INTERNAL_PREREQUISITES_NOT_MET")).otherwise(output("RUN_HAS_RESULT", F.when(F.substring(date, 1, 4).cast("int") <= latest, "COMPLIANT").otherwise("NOT_COMPLIANT"), "checked"))
        if date is None:
            return {"status": "INTERNAL_PREREQUISITES_NOT_MET"}
        return {"status": "RUN_HAS_RESULT", "result": "COMPLIANT" if int(date[:4]) <= latest else "NOT_COMPLIANT", "comment": "checked"}

    rule = a_rule("VALIDATION", checked, Param("ACTED_UPON", "dwc:eventDate"), Param("PARAMETER", "latest", "int"), native=native)
    cols = ["record_id", "response_status", "response_result", "message"]
    assert rows(execute.validate(df, [a_binding(rule, values={"latest": "2026"})]), *cols) == [("r1", "RUN_HAS_RESULT", "COMPLIANT", "checked"), ("r2", "INTERNAL_PREREQUISITES_NOT_MET", None, "INTERNAL_PREREQUISITES_NOT_MET")]
    bad = rows(execute.validate(df, [a_binding(rule, values={"latest": "not-a-number"})]), *cols)
    assert all(r[1] == "ERROR" and "NumberFormatException" in r[3] for r in bad)


QA = Test("m2", "MULTIRECORD_MEASURE_QA_B", "MEASURE")
COUNT = Test("m1", "MULTIRECORD_MEASURE_COUNT_COMPLIANT_B", "MEASURE")


def matches(x):
    return F.when(x == "prereq", output("INTERNAL_PREREQUISITES_NOT_MET")).otherwise(output("RUN_HAS_RESULT", F.when(x == "match", "COMPLIANT").otherwise("NOT_COMPLIANT")))


@pytest.mark.parametrize("values, count, qa, strict", [(["match", "miss"], "1", "NOT_COMPLETE", "NOT_COMPLETE"), (["match"] * 4, "4", "COMPLETE", "COMPLETE"), (["match", "prereq"], "1", "COMPLETE", None), ([], "0", "COMPLETE", "COMPLETE")])
def test_measures(spark, values, count, qa, strict):
    df = records(spark, [(f"r{i}", v) for i, v in enumerate(values)], "x")
    rule = a_rule("VALIDATION", matches, Param("ACTED_UPON", "x"), id="b")
    bindings = bind([Test("b", "VALIDATION_B"), COUNT, QA], [rule], columns=["x"]).bindings
    pre = execute.validate(df, for_phase([b for b in bindings if b.measure is None], PRE))
    own = [b for b in bindings if b.measure is not None]
    got = {r.test_id: r for r in measures.measures(pre, df, own, PRE).collect()}
    assert got["m1"].response_result == count and got["m2"].response_result == qa
    if len(values) == 2 and values[1] == "miss":
        assert got["m1"].message == "1/2 records matched COMPLIANT for VALIDATION_B (50.0%)"
    hard = {r.test_id: r for r in measures.measures(pre, df, own, PRE, strict=True).collect()}["m2"]
    assert hard.response_result == strict and (strict is not None or hard.status == "ERROR")


def test_measure_specs():
    assert measure_of(COUNT).target_label == "VALIDATION_B"
    m = measure_of(Test("q", "MULTIRECORD_MEASURE_QA_X", "MEASURE", metadata={"expectedResponse": 'COMPLETE if every VALIDATION_Y in the MultiRecord has Response.result="COMPLIANT" or Response.status="INTERNAL_PREREQUISITES_NOT_MET"'}))
    assert (m.target_label, m.results, m.statuses) == ("VALIDATION_Y", ("COMPLIANT",), ("INTERNAL_PREREQUISITES_NOT_MET",))
    assert type(m).decoded(m.encoded()) == m
    told = {"expectedResponse": "Count the number of VALIDATION_Z where Response.result=NOT_COMPLIANT"}
    m = measure_of(Test("c", "MULTIRECORD_MEASURE_COUNT_X", "MEASURE", metadata=told))
    assert (m.target_label, m.result) == ("VALIDATION_Z", "NOT_COMPLIANT")
    assert measure_of(Test("c", "x", "MEASURE", metadata=told)) is None  # the label makes it a measure of all records
    for result in COUNTED:
        m = measure_of(Test("c", f"MULTIRECORD_MEASURE_COUNT_{result}_X", "MEASURE"))
        assert (m.result, m.target_label) == (result, "VALIDATION_X")
    assert measure_of(Test("c", "MULTIRECORD_MEASURE_COUNT_AMENDED_", "MEASURE")) is None
    assert measure_of(Test("v", "MULTIRECORD_MEASURE_QA_X", "VALIDATION")) is None


def test_binding_choices():
    v = Param("ACTED_UPON", "dwc:eventDate")
    plain, rich = a_rule("VALIDATION", echo, v, version="urn:v:1"), a_rule("VALIDATION", matches, v, Param("PARAMETER", "p", "string", False), version="urn:v:1")
    rules, columns = [plain, rich], ["dwc:eventDate"]
    one = lambda t, **k: bind([t], rules, columns=k.pop("columns", columns), **k)
    assert one(Test("urn:v:1/")).bindings[0].rule is plain
    assert one(Test("urn:v:1", parameters={"P ": "3"})).bindings[0].rule is rich
    assert one(Test("urn:v:1")).reviews[0].capability == "BOTH"
    missing = one(Test("urn:v:1"), columns=["dwc:scientificName"])
    assert missing.bindings[0].status == "TERM_MISSING" and len(missing.unresolved) == 1
    none = one(Test("urn:none"))
    assert not none.bindings and none.reviews[0].implementation == "MISSING"
    assert one(Test("urn:x"), explicit={"urn:x": rich.key}).bindings[0].rule is rich
    twice = bind([Test("urn:v:1")], [plain, a_rule("VALIDATION", echo, v, version="urn:v:1", cls="B")], columns=columns)
    assert twice.reviews[0].implementation == "AMBIGUOUS" and twice.bindings[0].rule.cls == "B"
    by_uuid = bind([Test("http://x/ABCDEF01-2345-6789-abcd-ef0123456789-2024-01-01")], [a_rule("VALIDATION", echo, v, id="ABCDEF01-2345-6789-abcd-ef0123456789")], columns=columns)
    assert by_uuid.bindings and "UUID" in by_uuid.reviews[0].diagnostics[0]
    assert column_for("dwc:eventDate", ["EVENTDATE"]) == "EVENTDATE" and column_for("dwc:x", ["y"]) is None


def test_explicit_post_binding_replaces_the_rerun():
    r = a_rule("VALIDATION", echo, Param("ACTED_UPON", "x"))
    pre = Binding(Test("a"), r, (BoundParam(r.params[0], "x"),))
    own = Binding(Test("a"), r, pre.params, phase=POST)
    assert [b.phase for b in for_phase([pre, own], POST)] == [POST] and for_phase([pre, own], POST)[0] is own
    assert [b.phase for b in for_phase([pre], POST)] == [POST]


def test_run_end_to_end(spark):
    df = records(spark, [("r1", "F", "1-URGENT", "10"), ("r2", "P", "4-NOT SPECIFIED", "oops")], "o_orderstatus", "o_orderpriority", "o_totalprice")
    tests = [Test("urn:rule:orderstatus", "VALIDATION_O"), Test("urn:rule:priorityname", "A", "AMENDMENT"), Test("urn:rule:price", "P"), Test("urn:none", "N"), Test("m", "MULTIRECORD_MEASURE_COUNT_COMPLIANT_O", "MEASURE")]
    done = run(prepare(spark, df, tests=tests))
    r = done.responses.persist()
    assert rows(r.where("record_id = '*'"), "test_id", "message") == [("urn:none", "No implementation discovered")]
    assert rows(r.where("record_id = 'MULTIRECORD'"), "phase", "response_result") == [(POST, "1"), (PRE, "1")]
    assert rows(r.where("test_id = 'urn:rule:price' and phase = 'PRE_AMENDMENT'"), "record_id", "response_status") == [("r1", "RUN_HAS_RESULT"), ("r2", "ERROR")]
    assert rows(summary.top(summary.filled_in(r)), "key", "n") == [("o_orderpriority=MEDIUM", 1)]
    assert rows(summary.amended_pairs(r, df, ["o_orderpriority"]), "key", "n") == [("o_orderpriority: 1-URGENT -> URGENT", 1)]
    assert done.prepared.review().count() == 5
    again = done.prepared.with_parameters({"urn:rule:price": {"useDefaults": False, "parameters": {"maxPrice": "5"}}})
    assert again.binding("urn:rule:price").rule.method == "price_below"
    assert again.trace("urn:rule:price").count() == 2
    assert unresolved_rows(spark, bind([], [])).count() == 0


def test_parameters_text_and_rebinding_with_a_mapping(spark):
    from plumbline.binding import parameters_from, parameters_text

    assert parameters_text({"b": "2", "a": "x=y"}) == "a=x=y; b=2" and parameters_from(" a = x=y ;; c ; b=2") == {"a": "x=y", "c": "", "b": "2"}
    df = records(spark, [("r1", "1")], "o_totalprice")
    made = prepare(spark, df, tests=[Test("urn:t", "T")], explicit={"urn:t": "rules.Orders#price_below"})
    assert made.binding("urn:t").rule.method == "price_below"
    again = made.with_parameters({"urn:t": {"useDefaults": False, "parameters": {"maxPrice": "0"}}})
    assert again.binding("urn:t").rule.method == "price_below" and run(again).of(phase=PRE).first().response_result == "NOT_COMPLIANT"
    # parameters that can be set: those of the chosen rule, else of the rules with parameters that match
    assert [p.source for p in again.parameters_of("urn:t")] == ["maxPrice"]
    plain = prepare(spark, df, tests=[Test("urn:rule:price", "T")])
    assert plain.binding("urn:rule:price").rule.method == "price_in_range" and [p.source for p in plain.parameters_of("urn:rule:price")] == ["maxPrice"]


def test_measures_of_outputs_equal_those_of_responses(spark):
    """The aggregate on the rules' outputs and that on the table of responses."""
    df = records(spark, [("r1", "F", "1-URGENT"), ("r2", "P", "4-NOT SPECIFIED"), ("r3", None, None)], "o_orderstatus", "o_orderpriority")
    tests = [Test("urn:rule:orderstatus", "VALIDATION_O"), Test("urn:rule:priority", "VALIDATION_P"), Test("urn:rule:priorityname", "A", "AMENDMENT", AMEND)]
    tests += [Test("c", "MULTIRECORD_MEASURE_COUNT_COMPLIANT_O", "MEASURE"), Test("q", "MULTIRECORD_MEASURE_QA_P", "MEASURE"), Test("n", "MULTIRECORD_MEASURE_COUNT_NOT_COMPLIANT_O", "MEASURE")]
    done = run(prepare(spark, df, tests=tests), strict=True)
    same = ["test_id", "phase", "status", "response_status", "response_result", "message"]
    for phase in (PRE, POST):
        own = [b for b in done.prepared.bound.bindings if b.measure is not None]
        table = measures.measures(done.of(phase=phase, multirecord=False), df, own, phase, strict=True)
        assert rows(table, *same) == rows(done.of(phase=phase, multirecord=True), *same) == rows(done.responses.where((F.col("phase") == phase) & (F.col("record_id") == "MULTIRECORD")), *same)


def test_one_scan_for_rules_and_one_for_measures(spark, tmp_path):
    df = records(spark, [("r1", "F", "1-URGENT")], "o_orderstatus", "o_orderpriority")
    df.write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    tests = [Test("urn:rule:orderstatus", "VALIDATION_O"), Test("urn:rule:priorityname", "A", "AMENDMENT", AMEND), Test("c", "MULTIRECORD_MEASURE_COUNT_COMPLIANT_O", "MEASURE")]
    done = run(prepare(spark, df, tests=tests))
    scans = lambda x: x._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")
    assert scans(done.responses) == 2 and scans(done.of(test_id="c")) == 1 and scans(done.of(phase=PRE, multirecord=False)) == 1
    # a filter on a test leaves the other rules out of the plan
    assert "priority" not in done.of(test_id="urn:rule:orderstatus", phase=PRE, multirecord=False, columns=["response_result"])._jdf.queryExecution().executedPlan().toString()
