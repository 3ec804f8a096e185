from pyspark.sql import functions as F

from plumbline.functions import text as fx
from plumbline.operators import graph, summary


s = lambda x: F.lit(x).cast("string")


def test_scalar(spark):
    cases = [
        (fx.normalize_id(s(" a/ ")), "a"), (fx.normalize_id(s("  ")), None), (fx.trim(s("\x01 a\t")), "a"),
        (fx.local_name(s("http://x/y#z")), "z"), (fx.local_name(s("x/")), "x/"), (fx.resource_name(s("a/b/")), ""),
        (fx.normalize_uri(s(" https://a.b/c/ ")), "a.b/c"), (fx.normalize_term(s(None)), ""),
        (fx.uri_candidates(s("http://r/terms/version/T-2024-01-02")), ["http://r/terms/version/T-2024-01-02", "https://r/terms/version/T-2024-01-02", "http://r/terms/T", "https://r/terms/T"]),
        (fx.test_type_of(s("MyAmendmentMeasure"), s("Validation")), "AMENDMENT"), (fx.test_type_of(s("x"), s("urn:Issue")), "ISSUE"), (fx.test_type_of(s("x"), s(None)), "UNKNOWN"),
        (fx.cast_argument(s(" 5 "), "int"), None), (fx.cast_argument(s("+5"), "int"), 5), (fx.cast_argument(s("99999999999"), "int"), None), (fx.cast_argument(s("yes"), "boolean"), False), (fx.cast_argument(s("TRUE"), "boolean"), True), (fx.cast_argument(s(" 1e3 "), "double"), 1000.0),
        (fx.first_non_blank(s(" "), s(None), s("b")), "b"), (fx.or_else(s(" "), "<none>"), "<none>"), (fx.tsv_cell(s("a\tb\nc\rd")), "a b c\rd"), (fx.tsv_cell(s(None)), ""),
        (fx.map_text(F.create_map(s("a"), s("1"), s("b"), s("2"))), "{a=1, b=2}"), (fx.map_text(F.create_map().cast("map<string,string>")), "{}"),
        (fx.map_difference(F.create_map(s("a"), s("1"), s("b"), s("2"), s("c"), s("3")), F.create_map(s("a"), s("1"), s("b"), s("9"), s("d"), s("4"))), {"b": "9", "d": "4"}),
        (fx.rdf_response_type(s("MEASURE"), s("RUN_HAS_RESULT")), "MeasurementResponse"), (fx.rdf_response_type(s("VALIDATION"), s("ERROR")), None),
        (fx.outcome(s(None), s("false"), F.create_map().cast("map<string,string>"), "PRE_AMENDMENT"), "FAILED"), (fx.outcome(s(""), s(None), F.create_map(s("a"), s("b")), "AMENDMENT"), "AMENDED"), (fx.outcome(s("NOT_RUN"), s(None), F.create_map().cast("map<string,string>"), "AMENDMENT"), "FAILED"),
        (fx.uuid_in(s("a ABCDEF01-2345-6789-abcd-ef0123456789 b")), "ABCDEF01-2345-6789-abcd-ef0123456789"), (fx.uuid_in(s("none")), "none"),
        (fx.message(s(" "), s("RUN_HAS_RESULT"), s("COMPLIANT"), s(None)), "RUN_HAS_RESULT [COMPLIANT]"),
    ]
    got = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(cases))).first()
    assert list(got) == [want for _, want in cases]


def test_top_with_rest(spark):
    df = spark.createDataFrame([(k, 2 if k == "US" else 1) for k in ["US", *map(str, range(10, 21))]], "key string, n long")
    got = [r.key for r in summary.top_with_rest(df).collect()]
    assert got[0] == "US" and len(got) == 11 and got[-1] == "... and 2 more distinct value(s)"
    assert summary.top_with_rest(df.limit(3)).count() == 3


def test_picks_and_closure(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, o int, v string")
    assert sorted(r.v for r in graph.first_per(df, ["k"], ["o"]).collect()) == ["x", "z"]
    assert sorted(r.v for r in graph.last_per(df, ["k"], "o").collect()) == ["y", "z"]
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("z", "y")], "s string, o string")
    assert sorted(r.n for r in graph.closure(edges, spark.createDataFrame([("a",)], "n string")).collect()) == ["a", "b", "c"]
    t = spark.createDataFrame([("t-2024", "isVersionOf", "t"), ("t-2023", "isVersionOf", "t")], "s string, p string, o string")
    assert sorted(r.n for r in graph.version_variants(t, "t").collect()) == ["t", "t-2023", "t-2024"]
