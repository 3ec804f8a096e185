"""The registered queries: each operator over the driver's tables, with its SQL.

Responses of orders come from three native rules, an issue, two chained amendments and four measures; responses of events from
Python rules. The SQL repeats them from the tables alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import api, policy
from plumbline.binding import Bound, bind, candidates, column_for, worst
from plumbline.functions import text as fx
from plumbline.model import AMEND, POST, PRE, BoundParam, Param, Plan, Rule, Test, UseCase
from plumbline.operators import execute, graph, summary
from plumbline.rdf import Term, Triple
from plumbline.registry import discover

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


TESTS = [
    Test("urn:rule:orderstatus", "VALIDATION_ORDERSTATUS_FINAL"),
    Test("urn:rule:priority", "VALIDATION_PRIORITY_SPECIFIED"),
    Test("urn:rule:price", "VALIDATION_PRICE_INRANGE", parameters={"maxPrice": "300000"}),
    Test("urn:rule:outlier", "ISSUE_PRICE_OUTLIER", "ISSUE"),
    Test("urn:rule:priorityname", "AMENDMENT_PRIORITY_STANDARDISED", "AMENDMENT", AMEND),
    Test("urn:rule:queue", "AMENDMENT_QUEUE", "AMENDMENT", AMEND),
    Test("urn:measure:count", "MULTIRECORD_MEASURE_COUNT_COMPLIANT_ORDERSTATUS_FINAL", "MEASURE"),
    Test("urn:measure:qa", "MULTIRECORD_MEASURE_QA_PRIORITY_SPECIFIED", "MEASURE", metadata={"expectedResponse": "COMPLETE if every VALIDATION_PRIORITY_SPECIFIED in the MultiRecord has Response.result=COMPLIANT"}),
]


def rules():
    return discover(["plumbline.rules"])


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execute.from_table(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), "o_orderkey")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execute.from_table(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type"), "event_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "n_chars")
    return execute.from_table(docs.join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"), "doc_id", "left"), "doc_id")


def bound(records: DataFrame, tests=None):
    return bind(tests or TESTS, rules(), columns=execute.terms(records)).bindings


def done(spark: SparkSession, sf_dir: str, tests=None, records: DataFrame | None = None, **settings) -> api.Run:
    """A run of the engine over orders. Measures of the first phase are taken in the last one too, under the same id."""
    return api.run(api.prepare(spark, records if records is not None else orders(spark, sf_dir), tests=tests or TESTS), **settings)


def everything(spark: SparkSession, sf_dir: str, columns=None) -> DataFrame:
    return done(spark, sf_dir).of(columns=columns)


def per_record(spark: SparkSession, sf_dir: str, columns=None) -> DataFrame:
    return done(spark, sf_dir).of(columns=columns, multirecord=False)


#: The same responses in SQL: ord, test_id, type, phase, p (its place), status, result, outcome, amended term and value.
SQL = """
WITH o AS (SELECT o_orderkey AS ord, CAST(o_orderkey AS VARCHAR) AS record_id, o_orderstatus AS st, o_orderpriority AS pr, o_totalprice AS price FROM orders),
am AS (SELECT *, CASE WHEN pr = '4-NOT SPECIFIED' THEN 'MEDIUM' WHEN regexp_matches(pr, '^[0-9]-') THEN substr(pr, 3) ELSE pr END AS pr2 FROM o),
val AS (
  SELECT ord, record_id, 'urn:rule:orderstatus' AS test_id, 'VALIDATION' AS test_type, 'RUN_HAS_RESULT' AS rs, CASE WHEN st IN ('F', 'O') THEN 'COMPLIANT' ELSE 'NOT_COMPLIANT' END AS rr, 'both' AS ph FROM o
  UNION ALL SELECT ord, record_id, 'urn:rule:price', 'VALIDATION', 'RUN_HAS_RESULT', CASE WHEN price <= 300000 THEN 'COMPLIANT' ELSE 'NOT_COMPLIANT' END, 'both' FROM o
  UNION ALL SELECT ord, record_id, 'urn:rule:outlier', 'ISSUE', 'RUN_HAS_RESULT', CASE WHEN price > 450000 THEN 'IS_ISSUE' WHEN price > 350000 THEN 'POTENTIAL_ISSUE' ELSE 'NOT_ISSUE' END, 'both' FROM o
  UNION ALL SELECT ord, record_id, 'urn:rule:priority', 'VALIDATION', CASE WHEN pr = '4-NOT SPECIFIED' THEN 'INTERNAL_PREREQUISITES_NOT_MET' ELSE 'RUN_HAS_RESULT' END, CASE WHEN pr = '4-NOT SPECIFIED' THEN NULL ELSE 'COMPLIANT' END, 'PRE_AMENDMENT' FROM o
  UNION ALL SELECT ord, record_id, 'urn:rule:priority', 'VALIDATION', 'RUN_HAS_RESULT', 'COMPLIANT', 'POST_AMENDMENT' FROM am),
r AS (
  SELECT v.ord, v.record_id, v.test_id, v.test_type, p.phase, p.n AS phase_ord, v.rs, v.rr, CASE WHEN v.rs = 'RUN_HAS_RESULT' THEN 'PASSED' ELSE 'FAILED' END AS outcome, NULL AS term, NULL AS value
  FROM val v JOIN (VALUES ('PRE_AMENDMENT', 0), ('POST_AMENDMENT', 2)) p(phase, n) ON v.ph = 'both' OR v.ph = p.phase
  UNION ALL SELECT ord, record_id, 'urn:rule:priorityname', 'AMENDMENT', 'AMENDMENT', 1, CASE WHEN pr = '4-NOT SPECIFIED' THEN 'FILLED_IN' ELSE 'AMENDED' END, NULL, 'AMENDED', 'o_orderpriority', pr2 FROM am
  UNION ALL SELECT ord, record_id, 'urn:rule:queue', 'AMENDMENT', 'AMENDMENT', 1, 'FILLED_IN', NULL, 'AMENDED', 'o_queue', CASE WHEN pr2 IN ('URGENT', 'HIGH') THEN 'fast' ELSE 'normal' END FROM am),
m AS (
  SELECT 'urn:measure:count' AS test_id, phase, CAST(count(*) FILTER (rr = 'COMPLIANT') AS VARCHAR) AS result, count(*) FILTER (rr = 'COMPLIANT') AS matching, count(*) AS eligible, 'PASSED' AS outcome FROM r WHERE test_id = 'urn:rule:orderstatus' GROUP BY phase
  UNION ALL SELECT 'urn:measure:qa', phase, CASE WHEN count(*) = count(*) FILTER (rr = 'COMPLIANT') THEN 'COMPLETE' ELSE 'NOT_COMPLETE' END, count(*) FILTER (rr = 'COMPLIANT'), count(*), CASE WHEN count(*) = count(*) FILTER (rr = 'COMPLIANT') THEN 'PASSED' ELSE 'FAILED' END FROM r WHERE test_id = 'urn:rule:priority' GROUP BY phase),
a AS (
  SELECT record_id, test_id, test_type, phase, phase_ord, rs, rr, outcome FROM r
  UNION ALL SELECT 'MULTIRECORD', test_id, 'MEASURE', phase, CASE WHEN phase = 'PRE_AMENDMENT' THEN 0 ELSE 2 END, 'RUN_HAS_RESULT', result, outcome FROM m)
"""
ROW = ["record_ord", "test_id", "test_type", "phase", "status", "response_status", "response_result", "message"]
ROW_SQL = "SELECT ord AS record_ord, test_id, test_type, phase, outcome AS status, rs AS response_status, rr AS response_result, CASE WHEN rs = 'INTERNAL_PREREQUISITES_NOT_MET' THEN 'not specified' WHEN rr IS NULL THEN rs ELSE rs || ' [' || rr || ']' END AS message FROM r"


@query(SQL + ROW_SQL + " WHERE phase = 'PRE_AMENDMENT'")
def pre_validation_responses(spark, sf_dir):
    return done(spark, sf_dir).of(phase=PRE, multirecord=False, columns=ROW)


@query(SQL + ROW_SQL + " WHERE phase = 'POST_AMENDMENT'")
def post_rerun_responses(spark, sf_dir):
    return done(spark, sf_dir).of(phase=POST, multirecord=False, columns=ROW)


@query(SQL + "SELECT ord AS record_ord, test_id, outcome AS status, rs AS response_status, '{' || term || '=' || value || '}' AS amendments FROM r WHERE phase = 'AMENDMENT'")
def amendment_responses(spark, sf_dir):
    return done(spark, sf_dir).of(phase=AMEND, multirecord=False).select("record_ord", "test_id", "status", "response_status", fx.map_text("amendments").alias("amendments"))


@query(SQL + "SELECT record_id, st AS o_orderstatus, pr2 AS o_orderpriority, CASE WHEN pr2 IN ('URGENT', 'HIGH') THEN 'fast' ELSE 'normal' END AS o_queue FROM am")
def amended_records(spark, sf_dir):
    return done(spark, sf_dir).amended.select("record_id", "o_orderstatus", "o_orderpriority", "o_queue")


@query(SQL + "SELECT value AS queue, count(*) AS n FROM r WHERE test_id = 'urn:rule:queue' GROUP BY value")
def chained_amendment(spark, sf_dir):
    out = done(spark, sf_dir).of(test_id="urn:rule:queue", columns=["amendments"])
    return out.groupBy(F.element_at("amendments", F.lit("o_queue")).alias("queue")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, min(o_orderkey) AS representative, count(*) AS members FROM orders GROUP BY ALL")
def dedup_distinct_groups(spark, sf_dir):
    return execute.distinct_groups(orders(spark, sf_dir), ["o_orderstatus", "o_orderpriority"])


EVENT_TESTS = [Test("urn:rule:event", "VALIDATION_EVENT_ALLOWED"), Test("urn:rule:eventlength", "VALIDATION_EVENT_SHORT", parameters={"most": "6"})]
EVENT_SQL = """
SELECT event_id AS record_ord, 'urn:rule:event' AS test_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'PASSED' END AS status, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'RUN_HAS_RESULT' END AS response_status,
  CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN 'NOT_COMPLIANT' ELSE 'COMPLIANT' END AS response_result,
  CASE WHEN event_type = 'error' THEN 'ValueError: not an event' WHEN event_type = 'signup' THEN 'RUN_HAS_RESULT [NOT_COMPLIANT]' ELSE 'RUN_HAS_RESULT [COMPLIANT]' END AS message FROM events
UNION ALL SELECT event_id, 'urn:rule:eventlength', 'PASSED', 'RUN_HAS_RESULT', CASE WHEN length(event_type) <= 6 THEN 'COMPLIANT' ELSE 'NOT_COMPLIANT' END, CASE WHEN length(event_type) <= 6 THEN 'RUN_HAS_RESULT [COMPLIANT]' ELSE 'RUN_HAS_RESULT [NOT_COMPLIANT]' END FROM events
"""
EVENT_ROW = ["record_ord", "test_id", "status", "response_status", "response_result", "message"]


@query(EVENT_SQL)
def dedup_fanout_responses(spark, sf_dir):
    records = events(spark, sf_dir)
    return execute.validate(records, bound(records, EVENT_TESTS)).select(EVENT_ROW)


@query(EVENT_SQL)
def dedup_off_responses(spark, sf_dir):
    records = events(spark, sf_dir)
    return execute.validate(records, bound(records, EVENT_TESTS), dedup=False).select(EVENT_ROW)


@query("SELECT count(DISTINCT event_type) AS deduplicated, count(*) AS plain FROM events")
def dedup_invocation_counts(spark, sf_dir):
    """Real calls of a Python rule, counted in the workers while its responses are taken with and without distinct invocation."""
    records = events(spark, sf_dir)
    event = next(r for r in rules() if r.provides == "urn:rule:event")
    made = {}
    for name, dedup in (("deduplicated", True), ("plain", False)):
        calls = spark.sparkContext.accumulator(0)

        def counted(event_type, calls=calls):
            calls.add(1)
            return event.fn(event_type)

        rule = Rule(event.provides, event.version, event.type, event.cls, event.method, event.params, counted, False, event.writes)
        own = bind([Test("urn:rule:event", "VALIDATION_EVENT_ALLOWED")], [rule], columns=execute.terms(records)).bindings
        execute.validate(records, own, dedup=dedup).write.format("noop").mode("overwrite").save()
        made[name] = calls.value
    return spark.createDataFrame([(made["deduplicated"], made["plain"])], "deduplicated long, plain long")


@query(f"SELECT test_id, status, count(*) AS n FROM ({EVENT_SQL}) GROUP BY ALL")
def error_isolation(spark, sf_dir):
    records = events(spark, sf_dir)
    return execute.validate(records, bound(records, EVENT_TESTS)).groupBy("test_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id AS record_ord, CASE WHEN user_id % 2 = 0 THEN 'COMPLIANT' ELSE 'NOT_COMPLIANT' END AS response_result FROM events")
def legacy_whole_record_rule(spark, sf_dir):
    records = events(spark, sf_dir)
    return execute.validate(records, bound(records, [Test("urn:rule:wholeevent", "VALIDATION_WHOLE")])).select("record_ord", "response_result")


MEASURED = ["test_id", "phase", "status", "response_result", "matching", "total"]
MEASURED_SQL = "SELECT test_id, phase, outcome AS status, result AS response_result, CAST(matching AS BIGINT) AS matching, (SELECT count(*) FROM orders) AS total FROM m"


def measured(spark, sf_dir, kind):
    out = done(spark, sf_dir).of(test_id=f"urn:measure:{kind}")
    number = lambda k: F.element_at("parameters", F.lit(k)).cast("long")
    return out.withColumns({"matching": number("matchingCount"), "total": number("totalRecords")}).select(MEASURED)


@query(SQL + MEASURED_SQL + " WHERE test_id = 'urn:measure:count'")
def count_measure(spark, sf_dir):
    return measured(spark, sf_dir, "count")


@query(SQL + MEASURED_SQL + " WHERE test_id = 'urn:measure:qa'")
def qa_measure(spark, sf_dir):
    return measured(spark, sf_dir, "qa")


@query("""SELECT phase, CAST(count(*) FILTER (new <> pr) AS BIGINT) AS matching, count(*) AS total FROM (SELECT 'POST_AMENDMENT' AS phase, o_orderpriority AS pr,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN o_orderpriority WHEN regexp_matches(o_orderpriority, '^[0-9]-') THEN substr(o_orderpriority, 3) ELSE o_orderpriority END AS new FROM orders) GROUP BY phase""")
def count_amended_measure(spark, sf_dir):
    """A COUNT measure whose label names a status of amendments. Its target runs in the phase that it is taken in: a validation that repeats what the amendment did."""
    told = Rule("urn:rule:told", "", "VALIDATION", "catalogue", "told", (Param("ACTED_UPON", "o_orderpriority"), Param("ACTED_UPON", "o_before")), lambda now, before: execute.output("RUN_HAS_RESULT", F.when(now.isin("MEDIUM") & (before == "4-NOT SPECIFIED"), "FILLED_IN").when(now != before, "AMENDED").otherwise("NOT_AMENDED")))
    tests = [Test("urn:rule:priorityname", "AMENDMENT_PRIORITY_STANDARDISED", "AMENDMENT", AMEND), Test("urn:rule:told", "VALIDATION_PRIORITY_CHANGED"), Test("urn:measure:amended", "MULTIRECORD_MEASURE_COUNT_AMENDED_PRIORITY_CHANGED", "MEASURE")]
    records = orders(spark, sf_dir).withColumn("o_before", F.col("o_orderpriority"))
    bound_ = bind(tests, [*rules(), told], columns=execute.terms(records))
    run = api.run(api.Prepared(records, Plan(UseCase(""), (), tuple(tests)), bound_, ()))
    number = lambda k: F.element_at("parameters", F.lit(k)).cast("long")
    return run.of(phase=POST, multirecord=True).select("phase", number("matchingCount").alias("matching"), number("totalRecords").alias("total"))


@query("SELECT CASE WHEN count(*) FILTER (o_orderpriority <> '4-NOT SPECIFIED') = count(*) THEN 'COMPLETE' ELSE 'NOT_COMPLETE' END AS response_result, CASE WHEN count(*) FILTER (o_orderpriority <> '4-NOT SPECIFIED') = count(*) THEN 'PASSED' ELSE 'FAILED' END AS status FROM orders WHERE false")
def qa_measure_empty_target(spark, sf_dir):
    return done(spark, sf_dir, records=orders(spark, sf_dir).where("false")).of(phase=PRE, test_id="urn:measure:qa", columns=["response_result", "status"])


@query(SQL + "SELECT CASE WHEN count(*) FILTER (rr IS NULL) > 0 THEN 'ERROR' ELSE 'PASSED' END AS status FROM r WHERE test_id = 'urn:rule:priority' AND phase = 'PRE_AMENDMENT'")
def qa_measure_strict(spark, sf_dir):
    return done(spark, sf_dir, strict=True).of(phase=PRE, test_id="urn:measure:qa", columns=["status"])


SLIM = ["record_id", "test_id", "phase", "status"]
SLIM_SQL = "SELECT record_id, test_id, phase, outcome AS status FROM a"


@query(SQL + SLIM_SQL + " WHERE phase = 'AMENDMENT'")
def responses_for_phase(spark, sf_dir):
    return done(spark, sf_dir).of(phase=AMEND, columns=SLIM)


@query(SQL + SLIM_SQL + " WHERE test_type = 'ISSUE'")
def responses_for_type(spark, sf_dir):
    return done(spark, sf_dir).of(test_type="ISSUE", columns=SLIM)


@query(SQL + SLIM_SQL + " WHERE rs = 'INTERNAL_PREREQUISITES_NOT_MET'")
def responses_for_status(spark, sf_dir):
    return summary.for_response_status(everything(spark, sf_dir, [*SLIM, "response_status"]), "INTERNAL_PREREQUISITES_NOT_MET").select(SLIM)


@query(SQL + SLIM_SQL + " WHERE record_id = 'MULTIRECORD'")
def multirecord_measures(spark, sf_dir):
    return summary.multirecord_measures(done(spark, sf_dir).of(multirecord=True)).select(SLIM)


@query(SQL + "SELECT count(*) FILTER (record_id NOT IN ('MULTIRECORD', '*')) AS per_record, count(*) FILTER (record_id IN ('MULTIRECORD', '*')) AS sentinel FROM a")
def sentinel_split(spark, sf_dir):
    r = everything(spark, sf_dir, ["record_id"])
    own, rest = summary.per_record(r).agg(F.count(F.lit(1)).alias("per_record")), summary.sentinels(r).agg(F.count(F.lit(1)).alias("sentinel"))
    return own.crossJoin(rest)  # one row each


@query(SQL + "SELECT coalesce(rs, '<none>') AS key, count(*) AS n FROM a GROUP BY 1")
def counts_by_status(spark, sf_dir):
    return summary.counts_by(everything(spark, sf_dir, ["response_status"]), "response_status")


@query(SQL + "SELECT coalesce(rr, '<none>') AS key, count(*) AS n FROM a GROUP BY 1")
def counts_by_result(spark, sf_dir):
    return summary.counts_by(everything(spark, sf_dir, ["response_result"]), "response_result")


@query(SQL + "SELECT rr AS key, count(*) AS n FROM a WHERE regexp_matches(rr, '^[A-Z][A-Z0-9_]*$') GROUP BY 1")
def result_keywords(spark, sf_dir):
    return summary.keywords(summary.counts_by(everything(spark, sf_dir, ["response_result"]), "response_result"))


@query(SQL + "SELECT phase AS key, count(*) AS n FROM a GROUP BY 1")
def counts_by_phase(spark, sf_dir):
    return summary.counts_by(everything(spark, sf_dir, ["phase"]), "phase")


@query(SQL + "SELECT count(*) AS n FROM a WHERE phase = 'PRE_AMENDMENT' AND rs = 'RUN_HAS_RESULT'")
def count_phase_status(spark, sf_dir):
    return summary.count_where(everything(spark, sf_dir, ["phase", "response_status"]), phase=PRE, response_status="RUN_HAS_RESULT")


@query(SQL + "SELECT count(*) AS n FROM a WHERE test_type = 'ISSUE' AND rr = 'IS_ISSUE'")
def count_type_result(spark, sf_dir):
    return summary.count_where(everything(spark, sf_dir, ["test_type", "response_result"]), test_type="ISSUE", response_result="IS_ISSUE")


@query(SQL + "SELECT test_id, max(result) FILTER (phase = 'PRE_AMENDMENT') AS pre_amendment, max(result) FILTER (phase = 'POST_AMENDMENT') AS post_amendment FROM m GROUP BY test_id")
def measure_pivot(spark, sf_dir):
    return summary.measure_pivot(done(spark, sf_dir).of(multirecord=True))


@query(SQL + "SELECT term || '=' || value AS key, count(*) AS n FROM r WHERE rs = 'FILLED_IN' GROUP BY 1 ORDER BY n DESC, lower(key), key LIMIT 10")
def filled_in_top10(spark, sf_dir):
    return summary.top(summary.filled_in(done(spark, sf_dir).of(phase=AMEND, columns=["response_status", "amendments"])))


@query(SQL + "SELECT term || ': ' || pr || ' -> ' || value AS key, count(*) AS n FROM r JOIN o USING (ord) WHERE rs = 'AMENDED' GROUP BY 1 ORDER BY n DESC, lower(key), key LIMIT 10")
def amended_pairs_top10(spark, sf_dir):
    return summary.top(summary.amended_pairs(done(spark, sf_dir).of(phase=AMEND, columns=["record_ord", "response_status", "amendments"]), orders(spark, sf_dir), ["o_orderpriority", "o_orderstatus"]))


@query(SQL + "SELECT phase, CASE WHEN test_type IN ('VALIDATION', 'ISSUE') AND rr IS NOT NULL OR test_type = 'MEASURE' AND rr IN ('COMPLETE', 'NOT_COMPLETE') THEN rs || ' | ' || rr ELSE rs END AS key, count(*) AS n FROM a GROUP BY ALL")
def outcome_tally(spark, sf_dir):
    return summary.outcome_tally(everything(spark, sf_dir, ["phase", "test_type", "response_status", "response_result"]))


@query(SQL + """, t AS (SELECT coalesce(CAST(price AS VARCHAR), '<no value>') AS k, count(*) AS n FROM r LEFT JOIN (SELECT ord, CAST(round(price / 10000) AS BIGINT) AS price FROM o) USING (ord) GROUP BY 1)
SELECT * FROM (SELECT k AS key, n FROM t ORDER BY n DESC, lower(k), k LIMIT 10) UNION ALL SELECT '... and ' || (count(*) - 10) || ' more distinct value(s)', count(*) - 10 FROM t HAVING count(*) > 10""")
def term_value_top10_more(spark, sf_dir):
    source = orders(spark, sf_dir).withColumn("band", F.round(F.col("o_totalprice").cast("double") / 10000).cast("long").cast("string"))
    return summary.top_with_rest(summary.value_tally(per_record(spark, sf_dir, ["record_ord"]), source, "band"))


@query(SQL + "SELECT record_id, phase, test_id, row_number() OVER (ORDER BY phase_ord, test_id, record_id) AS rank FROM r")
def response_sort_order(spark, sf_dir):
    from plumbline.operators.ranking import with_row_number

    r = per_record(spark, sf_dir, ["record_id", "phase", "phase_ord", "test_id"])
    return with_row_number(r, ["phase_ord", "test_id", "record_id"], "rank").select("record_id", "phase", "test_id", "rank")


@query(SQL + "SELECT record_id, 'class' AS implementation, replace(replace(test_id, chr(9), ' '), chr(10), ' ') AS test_id, coalesce(rr, '') AS response_result, CASE WHEN term IS NULL THEN '{}' ELSE '{' || term || '=' || value || '}' END AS amendments FROM r")
def tsv_projection(spark, sf_dir):
    r = per_record(spark, sf_dir)
    return r.select("record_id", F.lit("class").alias("implementation"), fx.tsv_cell("test_id").alias("test_id"), fx.tsv_cell("response_result").alias("response_result"), fx.map_text("amendments").alias("amendments"))


@query(SQL + """SELECT kind, result, count(*) AS n FROM (SELECT CASE test_type WHEN 'VALIDATION' THEN 'ValidationResponse' WHEN 'ISSUE' THEN 'IssueResponse' WHEN 'MEASURE' THEN 'MeasurementResponse' ELSE 'AmendmentResponse' END AS kind,
  rr AS result FROM a WHERE test_type <> 'AMENDMENT' UNION ALL SELECT 'AmendmentResponse', '{"' || term || '":"' || value || '"}' FROM r WHERE test_type = 'AMENDMENT') GROUP BY ALL""")
def rdf_response_typing(spark, sf_dir):
    r = everything(spark, sf_dir, ["test_type", "response_status", "response_result", "amendments"])
    return r.select(fx.rdf_response_type("test_type", "response_status").alias("kind"), fx.rdf_result("test_type", "response_result", "amendments").alias("result")).groupBy("kind", "result").agg(F.count(F.lit(1)).alias("n"))


@query(SQL + """SELECT CASE WHEN term IS NULL THEN '{}' ELSE '{"' || term || '":"' || value || '"}' END AS json, count(*) AS n FROM r GROUP BY 1""")
def amendments_json(spark, sf_dir):
    return per_record(spark, sf_dir, ["amendments"]).groupBy(fx.amendments_json("amendments").alias("json")).agg(F.count(F.lit(1)).alias("n"))


@query(SQL + "SELECT ord AS record_ord, '{pr=' || pr2 || ', q=new}' AS difference FROM am WHERE pr <> pr2 UNION ALL SELECT ord, '{q=new}' FROM am WHERE pr = pr2")
def map_diff(spark, sf_dir):
    amended = done(spark, sf_dir).amended.select("record_ord", F.col("o_orderpriority").alias("pr2"))
    both = orders(spark, sf_dir).join(amended, "record_ord")
    before = F.create_map(F.lit("pr"), F.col("o_orderpriority"), F.lit("st"), F.col("o_orderstatus"))
    after = F.create_map(F.lit("pr"), F.col("pr2"), F.lit("st"), F.col("o_orderstatus"), F.lit("q"), F.lit("new"))
    return both.select("record_ord", fx.map_text(fx.map_difference(before, after)).alias("difference"))


@query("SELECT CAST(doc_id AS VARCHAR) AS record_id, CASE WHEN quality IS NULL THEN 'INTERNAL_PREREQUISITES_NOT_MET' ELSE 'RUN_HAS_RESULT' END AS response_status, CASE WHEN quality IS NOT NULL THEN 'COMPLIANT' END AS response_result FROM documents LEFT JOIN labels USING (doc_id)")
def missing_terms(spark, sf_dir):
    records = documents(spark, sf_dir)
    return execute.validate(records, bound(records, [Test("urn:rule:labelled", "VALIDATION_LABEL_PRESENT")])).select("record_id", "response_status", "response_result")


@query("SELECT CAST(doc_id AS VARCHAR) AS record_id, 'urn:rule:length' AS test_id, CAST(n_chars AS VARCHAR) AS response_result FROM documents UNION ALL SELECT CAST(doc_id AS VARCHAR), 'urn:rule:complete', CASE WHEN quality IS NULL THEN 'NOT_COMPLETE' ELSE 'COMPLETE' END FROM documents LEFT JOIN labels USING (doc_id)")
def record_measures(spark, sf_dir):
    records = documents(spark, sf_dir)
    return execute.validate(records, bound(records, [Test("urn:rule:length", "MEASURE_LENGTH", "MEASURE"), Test("urn:rule:complete", "MEASURE_COMPLETE", "MEASURE")])).select("record_id", "test_id", "response_result")


@query("SELECT CAST(doc_id AS VARCHAR) AS record_id, CAST(doc_id AS VARCHAR) AS occurrenceID, lang, coalesce(CAST(quality AS VARCHAR), '') AS quality, '' AS country FROM documents LEFT JOIN labels USING (doc_id)")
def pad_missing_terms(spark, sf_dir):
    return summary.padded(documents(spark, sf_dir), ["dwc:occurrenceID", "lang", "quality", "country"], "dwc:occurrenceID")


@query("SELECT 3 AS n_runs, CAST(sum(CASE WHEN o_totalprice <= 300000 THEN 1 ELSE 0 END) AS BIGINT) AS with_parameter, CAST(sum(CASE WHEN o_totalprice <= 400000 THEN 1 ELSE 0 END) AS BIGINT) AS with_default FROM orders")
def param_vs_default_rule(spark, sf_dir):
    records = orders(spark, sf_dir)
    run = lambda p: execute.validate(records, bound(records, [Test("urn:rule:price", "VALIDATION_PRICE_INRANGE", parameters=p)])).agg(F.count_if(F.col("response_result") == "COMPLIANT").alias("n"))
    return run({"maxPrice": "300000"}).select(F.lit(3).alias("n_runs"), F.col("n").alias("with_parameter")).crossJoin(run({}).select(F.col("n").alias("with_default")))  # one row each


def values(spark, sf_dir, rows: str, *columns: str) -> DataFrame:
    """A small table from SQL literals, which the SQL shares."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({', '.join(columns)})")


UNRESOLVED_TESTS = [Test("urn:rule:orderstatus", "A"), Test("urn:rule:none", "B"), Test("urn:rule:price", "C")]


@query("SELECT '*' AS record_id, test_id, 'UNABLE_TO_RUN' AS status, message FROM (VALUES ('urn:rule:none', 'No implementation discovered'), ('urn:rule:price', 'TERM MISSING: o_totalprice')) t(test_id, message)")
def unresolved_placeholder_rows(spark, sf_dir):
    records = orders(spark, sf_dir).drop("o_totalprice")
    return api.unresolved_rows(spark, bind(UNRESOLVED_TESTS, rules(), columns=execute.terms(records))).select("record_id", "test_id", "status", "message")


@query("SELECT 'TERM_MISSING' AS status, 'urn:rule:price' AS test_id, count(*) AS n FROM orders UNION ALL SELECT 'BOUND', 'urn:rule:orderstatus', count(*) FROM orders")
def unbound_still_runs(spark, sf_dir):
    records = orders(spark, sf_dir).drop("o_totalprice")
    bindings = bind(UNRESOLVED_TESTS, rules(), columns=execute.terms(records)).bindings
    status = {b.test.id: b.status for b in bindings}
    told = F.create_map(*(F.lit(x) for kv in status.items() for x in kv))
    return execute.validate(records, bindings).groupBy("test_id").agg(F.count(F.lit(1)).alias("n")).select(F.element_at(told, F.col("test_id")).alias("status"), "test_id", "n")


@query("""WITH n AS (SELECT count(*) FILTER (o_totalprice <= 200000) AS low, count(*) FILTER (o_totalprice <= 300000) AS high, count(*) FILTER (o_orderstatus IN ('F', 'O')) AS fin FROM orders)
SELECT 'PRE_AMENDMENT' AS phase, 'urn:rule:price' AS test_id, high AS n FROM n UNION ALL SELECT 'POST_AMENDMENT', 'urn:rule:price', low FROM n
UNION ALL SELECT 'PRE_AMENDMENT', 'urn:rule:orderstatus', fin FROM n UNION ALL SELECT 'POST_AMENDMENT', 'urn:rule:orderstatus', fin FROM n""")
def post_explicit_antijoin(spark, sf_dir):
    """A binding of its own in the last phase takes the place of the first phase's; the others are run again."""
    tests = (Test("urn:rule:orderstatus", "A"), Test("urn:rule:price", "B", parameters={"maxPrice": "300000"}), Test("urn:rule:price", "C", parameters={"maxPrice": "200000"}))
    records = orders(spark, sf_dir)
    first, second, last = bound(records, tests)
    own = Bound((first, second, replace(last, phase=POST)), (), ())
    r = api.run(api.Prepared(records, Plan(UseCase(""), (), tests), own, ())).of(columns=["phase", "test_id", "response_result"])
    return r.groupBy("phase", "test_id").agg(F.count_if(F.col("response_result") == "COMPLIANT").alias("n"))


@query("""SELECT 'urn:measure:there' AS test_id, phase, 'RUN_HAS_RESULT' AS response_status, (SELECT CAST(count(*) FILTER (o_orderstatus IN ('F', 'O')) AS VARCHAR) FROM orders) AS response_result FROM (VALUES ('PRE_AMENDMENT'), ('POST_AMENDMENT')) p(phase)
UNION ALL SELECT 'urn:measure:absent', 'PRE_AMENDMENT', 'UNABLE_TO_RUN', NULL""")
def measure_target_semijoin(spark, sf_dir):
    """Measures are taken where their target runs; one without a target is unresolved."""
    tests = [Test("urn:rule:orderstatus", "VALIDATION_A"), Test("urn:measure:there", "MULTIRECORD_MEASURE_COUNT_COMPLIANT_A", "MEASURE"), Test("urn:measure:absent", "MULTIRECORD_MEASURE_COUNT_COMPLIANT_Z", "MEASURE")]
    return summary.sentinels(done(spark, sf_dir, tests).of(test_type="MEASURE")).select("test_id", "phase", "response_status", "response_result")


@query("SELECT * FROM (VALUES ('plain', 'FOUND', 'PARAMETERIZED_VERSION_AVAILABLE', 'rules.Orders#price_in_range'), ('rich', 'FOUND', 'PARAMETERIZED_VERSION_AVAILABLE', 'rules.Orders#price_below'), ('one', 'FOUND', 'DEFAULT_ONLY', 'rules.Orders#order_status_final'), ('none', 'MISSING', NULL, NULL)) t(label, implementation, capability, chosen)")
def candidate_selection(spark, sf_dir):
    """Of two rules for a test the one with parameters is chosen where values are given."""
    tests = [Test("urn:rule:price", "plain"), Test("urn:rule:price", "rich", parameters={"maxPrice": "1"}), Test("urn:rule:orderstatus", "one"), Test("urn:rule:absent", "none")]
    return api.prepare(spark, orders(spark, sf_dir), tests=tests).review().select("label", "implementation", "capability", "chosen")


IDS = (("t1", "urn:v:1/"), ("t2", "urn:p:2"), ("t3", "https://x/ABCDEF01-2345-6789-abcd-ef0123456789-2024"), ("t4", "urn:none"))
PROVIDED = (("i1", "urn:other", "urn:v:1"), ("i2", "urn:p:2", ""), ("i3", "ABCDEF01-2345-6789-abcd-ef0123456789", "x"), ("i4", "urn:v:1", ""))
literal = lambda rows: ", ".join(map(str, rows))


@query(f"""WITH t AS (SELECT t, regexp_replace(trim(id), '/$', '') AS id, regexp_extract(id, '{fx.UUID}') AS u FROM (VALUES {literal(IDS)}) x(t, id)), p AS (SELECT * FROM (VALUES {literal(PROVIDED)}) x(i, pid, ver)),
h AS (SELECT t, i, 1 AS k FROM t JOIN p ON id = ver UNION ALL SELECT t, i, 2 FROM t JOIN p ON id = pid UNION ALL SELECT t, i, 3 FROM t JOIN p ON u = pid AND u <> '')
SELECT t, i, k = 3 AS told FROM h x WHERE k = (SELECT min(k) FROM h y WHERE y.t = x.t)""")
def version_fallback_match(spark, sf_dir):
    """The engine's candidates of a test: by version, else by id, else by the UUID in the id, which is told."""
    own = [Rule(pid, ver, "VALIDATION", i, "m", (), str) for i, pid, ver in PROVIDED]
    found = [(t, r.cls, bool(notes)) for t, id in IDS for rules_, notes in [candidates(Test(id), own, {})] for r in rules_]
    return spark.createDataFrame(found, "t string, i string, told boolean")


@query("SELECT * FROM (VALUES ('dwc:eventDate', 'EVENTDATE'), ('dwc:country', 'Country'), ('dwc:absent', NULL)) t(term, bound_column)")
def term_alias_resolution(spark, sf_dir):
    """The engine's column of a term, among columns that differ in prefix and case: by the full name, else by the local one, the first by name."""
    columns = ["EVENTDATE", "eventdate", "Country", "http://x/terms/country"]
    return spark.createDataFrame([(t, column_for(t, columns)) for t in ("dwc:eventDate", "dwc:country", "dwc:absent")], "term string, bound_column string")


FOLD = (("t1", "given"), ("t1", "given"), ("t2", "given"), ("t2", "PARAMETER MISSING"), ("t3", "TERM MISSING"), ("t3", "given"), ("t4", "PARAMETER MISSING"))


@query(f"SELECT t, CASE WHEN bool_or(p = 'TERM MISSING') THEN 'TERM_MISSING' WHEN bool_and(p = 'given') THEN 'BOUND' WHEN bool_or(p = 'given') THEN 'PARTIAL' ELSE 'UNBOUND' END AS status FROM (VALUES {literal(FOLD)}) x(t, p) GROUP BY t")
def binding_status_fold(spark, sf_dir):
    """A binding's status from its arguments', by the engine."""
    given = lambda t: [BoundParam(Param("ACTED_UPON", "x"), bound=p == "given", reason="" if p == "given" else f"{p}: x") for own, p in FOLD if own == t]
    return spark.createDataFrame([(t, worst(given(t))) for t in dict(FOLD)], "t string, status string")


URIS = ("http://a.org/x", "https://a.org/x/", "https://b.org/terms/version/T-2024-01-31", "http://b.org/terms/T")


@query(f"""WITH u AS (SELECT x FROM (VALUES {", ".join(f"('{x}')" for x in URIS)}) t(x)), c AS (
SELECT x, regexp_replace(regexp_replace(x, '(/terms/version/.*)-[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$', '\\1'), '/terms/version/', '/terms/') AS y FROM u),
n AS (SELECT x, regexp_replace(regexp_replace(z, '^https?://', ''), '/$', '') AS k FROM (SELECT x, x AS z FROM c UNION SELECT x, y FROM c))
SELECT DISTINCT a.x AS a, b.x AS b FROM n a JOIN n b ON a.k = b.k AND a.x < b.x""")
def uri_normalise_match(spark, sf_dir):
    """URIs that the policies' resolver holds for the same."""
    alike = [(a, b) for a in URIS for b in URIS if a < b and any(policy.same_uri(x, y) for x in policy.candidates(a) for y in policy.candidates(b))]
    return spark.createDataFrame(alike, "a string, b string")


NS, RDFS_NS, TYPE_IRI = "urn:x:", policy.RDFS, policy.TYPE


def triples(rows) -> list[Triple]:
    """Rows s, p, o: IRIs, but for objects that start with a capital and a blank, or hold one: literals."""
    full = lambda x: x if ":" in x else NS + x
    names = {"subClassOf": RDFS_NS + "subClassOf", "type": TYPE_IRI, "label": RDFS_NS + "label"}
    return [Triple(full(s), names.get(p, NS + p), Term("literal", o, "", "") if " " in o else Term("iri", full(o), "", "")) for s, p, o in rows]


TRIPLES = (("C1", "subClassOf", "Issue"), ("C2", "subClassOf", "C1"), ("C3", "subClassOf", "C2"), ("X", "subClassOf", "Y"), ("Issue", "subClassOf", "C2"), ("i1", "type", "C3"), ("i2", "type", "Y"))


@query(f"WITH RECURSIVE t AS (SELECT * FROM (VALUES {literal(TRIPLES)}) t(s, p, o)), c(n) AS (SELECT 'Issue' UNION SELECT t.s FROM t JOIN c ON t.o = c.n AND t.p = 'subClassOf') SELECT n, (SELECT count(*) FROM t WHERE p = 'type' AND o = c.n) AS instances FROM c")
def subclass_closure(spark, sf_dir):
    """Classes of tests below the resolver's seeds, over a cycle, and their instances."""
    own = triples(TRIPLES)
    g = policy.Graph(own)
    return spark.createDataFrame([(c.removeprefix(NS), sum(t.p == TYPE_IRI and t.o.value == c and t.s in g.instances for t in own)) for c in g.classes], "n string, instances long")


CHAIN = (("m1", "forValidation", "t1"), ("m2", "forValidation", "t2"), ("m1", "hasSpecification", "s1"), ("s1", "label", "Spec one"), ("m3", "forTest", "t1"), ("m3", "hasSpecification", "s0"), ("t3-2024", "isVersionOf", "t3"), ("m4", "forTest", "t3-2024"), ("m4", "hasSpecification", "s4"))


@query(f"""WITH t AS (SELECT * FROM (VALUES {literal(CHAIN)}) t(s, p, o)), v AS (SELECT x AS test, x AS variant FROM (VALUES ('t1'), ('t2'), ('t3')) n(x) UNION SELECT o, s FROM t WHERE p = 'isVersionOf'),
h AS (SELECT v.test, b.o AS specification, c.o AS label, row_number() OVER (PARTITION BY v.test ORDER BY CASE a.p WHEN 'forValidation' THEN 0 ELSE 1 END) AS k
FROM v JOIN t a ON a.o = v.variant AND a.p IN ('forValidation', 'forTest') JOIN t b ON b.s = a.s AND b.p = 'hasSpecification' LEFT JOIN t c ON c.s = b.o AND c.p = 'label')
SELECT test, specification, label FROM h WHERE k = 1""")
def spec_chain_join(spark, sf_dir):
    """The specification that the engine's index has for a test: over its versions, the specific link before the general one."""
    index = policy.Specifications(triples(CHAIN))
    found = [(t, *got) for t in ("t1", "t2", "t3") if (got := index.of(NS + t, "VALIDATION"))]
    return spark.createDataFrame([(t, x.removeprefix(NS), label) for t, x, label in found], "test string, specification string, label string")


RESPONSES = (
    ("i1", "producesResponse", "r1"), ("i1", "producesResponse", "r2"), ("i2", "producesResponse", "r3"), ("i1", "usesSpecification", "s1"), ("i2", "usesSpecification", "s2"),
    ("m1", "hasSpecification", "s1"), ("m2", "hasSpecification", "s2"), ("m1", "forValidation", "t1"), ("m2", "forAmendment", "t1-2024"), ("t1-2024", "isVersionOf", "t1"),
    ("r1", "hasResponseStatus", "HAS RESULT"), ("r1", "hasResponseResult", "IS COMPLIANT"), ("r2", "hasResponseStatus", "NOT MET"), ("r3", "phase", "POST AMENDMENT"), ("r1", "appliesTo", "rec1"),
)


@query(f"""WITH t AS (SELECT * FROM (VALUES {literal(RESPONSES)}) t(s, p, o)), v AS (SELECT 't1' AS n UNION SELECT s FROM t WHERE p = 'isVersionOf' AND o = 't1')
SELECT x.o AS response, st.o AS status, re.o AS result, ph.o AS phase, ap.o AS record
FROM t x JOIN t u ON u.s = x.s AND u.p = 'usesSpecification' JOIN t h ON h.o = u.o AND h.p = 'hasSpecification' JOIN t g ON g.s = h.s AND g.p IN ('forValidation', 'forIssue', 'forMeasure', 'forAmendment') JOIN v ON v.n = g.o
LEFT JOIN t st ON st.s = x.o AND st.p = 'hasResponseStatus' LEFT JOIN t re ON re.s = x.o AND re.p = 'hasResponseResult' LEFT JOIN t ph ON ph.s = x.o AND ph.p = 'phase' LEFT JOIN t ap ON ap.s = x.o AND ap.p = 'appliesTo'
WHERE x.p = 'producesResponse'""")
def response_chain(spark, sf_dir):
    """Responses of a test and its versions, from triples: implementation, specification and method, what a response lacks being null."""
    t = values(spark, sf_dir, literal(RESPONSES), "s", "p", "o")
    return graph.response_chain(t, graph.version_variants(t, "t1"))


STATS = (("f1", "u1", "type", "UseCase"), ("f1", "p1", "hasUseCase", "u1"), ("f1", "p1", "hasTest", "t1"), ("f1", "t1", "type", "Validation"), ("f2", "t1", "type", "Validation"), ("f2", "t2", "type", "Validation"))


@query(f"""WITH x AS (SELECT * FROM (VALUES {literal(STATS)}) x(f, s, p, o))
SELECT f, count(DISTINCT CASE WHEN p = 'type' AND o = 'UseCase' THEN s WHEN p = 'hasUseCase' THEN o END) AS use_cases, count(DISTINCT CASE WHEN p = 'hasUseCase' THEN s END) AS policies,
count(DISTINCT CASE WHEN p = 'type' AND o = 'Validation' THEN s WHEN p = 'hasTest' THEN o END) AS tests FROM x GROUP BY ROLLUP (f)""")
def definition_stats(spark, sf_dir):
    """Distinct use cases, policies and tests of definitions, by file and over all files, by the engine."""
    per, total = policy.statistics_of({f: triples([r[1:] for r in STATS if r[0] == f]) for f in dict((r[0], 0) for r in STATS)})
    rows = [(f, x["use_cases"], x["policies"], x["tests"]) for f, x in [*per.items(), (None, total)]]
    return spark.createDataFrame(rows, "f string, use_cases long, policies long, tests long")


@query("""SELECT o_orderkey, coalesce(TRY_CAST(CASE WHEN regexp_matches(v, '^[+-]?[0-9]+$') THEN v END AS INTEGER), -1) AS as_int, lower(v) = 'true' AS as_boolean, regexp_matches(v, '^[+-]?[0-9]+$') = false AS bad
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN ' 5 ' WHEN 2 THEN 'TRUE' ELSE 'yes' END AS v FROM orders)""")
def safe_cast_args(spark, sf_dir):
    v = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey").cast("string")).when(F.col("o_orderkey") % 4 == 1, " 5 ").when(F.col("o_orderkey") % 4 == 2, "TRUE").otherwise("yes")
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", v.alias("v"))
    return df.select("o_orderkey", F.coalesce(fx.cast_argument("v", "int"), F.lit(-1)).alias("as_int"), fx.cast_argument("v", "boolean").alias("as_boolean"), fx.bad_argument("v", "int").alias("bad"))


@query("SELECT CAST(4 AS BIGINT) AS term_count, count(*) AS record_count FROM orders")
def run_metadata(spark, sf_dir):
    return summary.metadata(orders(spark, sf_dir))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS record_id, count(*) AS responses, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def repeated_record_ids(spark, sf_dir):
    """Lines as records with their order's key for an id: rows with equal ids keep a response each."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), "l_returnflag")
    records = execute.from_table(items, "l_orderkey", "line")
    rule = Rule("urn:rule:returned", "", "VALIDATION", "catalogue", "returned", (Param("ACTED_UPON", "l_returnflag"),), lambda flag: execute.output("RUN_HAS_RESULT", F.when(flag == "R", "NOT_COMPLIANT").otherwise("COMPLIANT")))
    own = bind([Test("urn:rule:returned", "VALIDATION_NOT_RETURNED")], [rule], columns=execute.terms(records)).bindings
    r = execute.validate(records, own)
    return r.groupBy("record_id").agg(F.count(F.lit(1)).alias("responses"), F.count_if(F.col("response_result") == "NOT_COMPLIANT").alias("returned")).where("responses > 1")


@query(SQL + "SELECT phase, test_id, CAST(count(*) AS BIGINT) AS n FROM r WHERE phase <> 'AMENDMENT' AND rr IS NOT NULL GROUP BY ALL")
def typed_response_counts(spark, sf_dir):
    r = per_record(spark, sf_dir)
    return r.where(fx.rdf_response_type("test_type", "response_status").isNotNull() & (F.col("test_type") != "AMENDMENT") & F.col("response_result").isNotNull()).groupBy("phase", "test_id").agg(F.count(F.lit(1)).alias("n"))


