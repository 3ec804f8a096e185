"""Picks by key, and graph operators over triples (s, p, o)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ranking import checkpoint_dir


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def last_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seeds (n) with all that reach them over edges (s, o). Cycles end, as only new nodes are followed. What is known is checkpointed each round, so
    plans don't grow, and the rounds before are released."""
    checkpoint_dir(edges.sparkSession)
    known = seeds.select("n", F.lit(True).alias("fresh")).distinct().checkpoint()
    while known.where("fresh").limit(1).count():
        step = edges.join(known.where("fresh").select(F.col("n").alias("o")), "o").select(F.col("s").alias("n")).distinct()
        new = step.join(known, "n", "left_anti").select("n", F.lit(True).alias("fresh"))
        known = known.withColumn("fresh", F.lit(False)).union(new).checkpoint()
    return known.select("n")


#: Properties from a method to its test.
FOR_TEST = ("forValidation", "forIssue", "forMeasure", "forAmendment")


def response_chain(triples: DataFrame, tests: DataFrame) -> DataFrame:
    """response, status, result, phase and record of the responses of tests (n), over the triples (s, p, o) of a run's report and the definitions: implementation
    to response, implementation to specification, method to specification, method to test. What a response lacks is null."""
    hop = lambda p, s, o: triples.where(F.col("p").isin(*p) if isinstance(p, tuple) else F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))
    methods = hop(FOR_TEST, "method", "n").join(tests, "n").join(hop("hasSpecification", "method", "specification"), "method")
    out = hop("producesResponse", "implementation", "response").join(hop("usesSpecification", "implementation", "specification"), "implementation").join(methods, "specification")
    for p, name in (("hasResponseStatus", "status"), ("hasResponseResult", "result"), ("phase", "phase"), ("appliesTo", "record")):
        out = out.join(hop(p, "response", name), "response", "left")
    return out.select("response", "status", "result", "phase", "record")


def version_variants(triples: DataFrame, test: str) -> DataFrame:
    """n: the test, what it is a version of and what is a version of it."""
    v = triples.where("p = 'isVersionOf'")
    own = triples.sparkSession.createDataFrame([(test,)], "n string")
    return own.union(v.where(F.col("s") == test).select("o")).union(v.where(F.col("o") == test).select("s")).distinct()
