"""Mixing sources to target weights by Pareto order sampling.

A source's target divided by its size is the number of copies its documents are due. The whole part is certain. The words that
it leaves open are shared among the documents as inclusion probabilities p in proportion to their pull, which grows a little with the
length of a document (its number of words in binary digits, and 4), so p differs by document; those that reach 1 are certain too. The others are
ranked by their random odds divided by their inclusion odds, (u / (1 - u)) / (p / (1 - p)), and the first are taken until the open words
are filled: a sample of fixed size, to within half a document.

Only sums travel: words by source and pull, then words by source and bucket of the ranking. A document's place is found
within its bucket, so no source, however hot, has to be sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import JAVA_WORD, discard, fresh_name, with_rank, written

#: Rows that a bucket of the ranking holds on average.
BUCKET_ROWS = 512
#: Classes of documents (by source and pull, 60 bytes each) are broadcast up to so many, else joined by a shuffle.
BROADCAST_CLASSES = 200_000
SEED = "mix"


def words(text: str = "text") -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(JAVA_WORD)), F.lit(0)).cast("long")


def pull(size: Column) -> Column:
    """What a document of so many words draws of its source's open words, beside others: one of a few whole numbers."""
    return F.length(F.bin(size)) + 4


def uniform(doc_id: str, text: str, seed: str = SEED) -> Column:
    """In [0, 1), from id and text alone, so reruns agree, and rows that share an id are told apart. A null id or text counts as an empty one."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def targets(by_source: DataFrame, most: float, weights: tuple[int, ...]) -> DataFrame:
    """by_source (s_null, s_key, source_size) with target. Targets share all words by weight, none above `most` times its source's
    size; the excess goes to the others by weight. Sources are met in the order of the words for a weight of 1 at which they
    are full: the level is that at which what is left divides by the weights that are left before the next one is full."""
    ranked, _ = with_rank(by_source, [F.col("s_null"), F.col("s_key")], "s_rank")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("s_rank") % len(weights) + 1).cast("int")).cast("long")
    weighed = written(ranked.withColumn("weight", weight).withColumn("full", F.lit(float(most)) * F.col("source_size") / F.col("weight")), "sources")
    sums = weighed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight"), F.max("full").alias("full")).first()
    steps, _ = with_rank(weighed, [F.col("full"), F.col("s_null"), F.col("s_key")], "step", {"source_size": "size_ahead", "weight": "weight_ahead"})
    level = (F.lit(float(sums["size"] or 0)) - F.lit(float(most)) * F.col("size_ahead")) / (F.lit(sums["weight"] or 0) - F.col("weight_ahead"))
    found = steps.select("step", level.alias("level"), "full").where("level <= full").agg(F.min_by("level", "step")).first()[0]
    level = found if found is not None else sums["full"] or 0.0
    return weighed.withColumn("target", F.least(F.lit(float(level)) * F.col("weight"), F.lit(float(most)) * F.col("source_size"))).drop("weight", "full", "s_rank")


def due(classes: DataFrame) -> DataFrame:
    """classes (s_null, s_key, pull, class_size, source_size, target: documents of a source by pull, a few rows each) with whole, the certain
    copies, and p: the pull times a factor that makes the expected words meet the open ones, below 1; those of the greatest pull are certain first."""
    w = Window.partitionBy("s_null", "s_key").orderBy(F.desc("pull"))
    before, rest = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    opened = F.col("target") - F.col("copies") * F.col("source_size")
    factor = F.try_divide(opened - F.coalesce(F.sum("class_size").over(before), F.lit(0)), F.sum(F.col("class_size") * F.col("pull")).over(rest))
    steps = classes.withColumn("copies", copies).withColumn("factor", factor)
    # the first at which none of the rest is certain
    fits = F.col("factor") * F.col("pull") < 1
    chosen = F.max_by(F.when(fits, F.col("factor")), F.when(fits, F.col("pull"))).over(Window.partitionBy("s_null", "s_key"))
    p = F.when(F.col("source_size") > 0, F.greatest(F.coalesce(chosen * F.col("pull"), F.lit(1.0)), F.lit(0.0))).otherwise(0.0)
    out = steps.withColumn("p", p)
    sure = F.col("p") >= 1
    return out.withColumn("whole", F.col("copies") + sure.cast("long")).withColumn("p", F.when(sure, 0.0).otherwise(F.col("p"))).drop("factor", "copies")


def with_copies(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", most: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), into: str = "mix") -> DataFrame:
    """df with a struct column `into`: size (words), source_size, target, copies (whole copies of the
    document that the mix takes, 0 to `most`) and taken (size times copies).

    Null sources are a source of their own, the last. Documents without words add nothing and get their source's
    whole copies. Rows of one id and text are documents of their own that share a place in the order; a null id counts
    as an empty one. Very long texts count whole. An empty table gives an empty result.
    """
    taken = {c.lower() for c in df.columns}
    if clash := taken & {"s_null", "s_key", "m_size", "m_u", "m_pull", "m_odds", "m_bucket"}:
        df = df.withColumnsRenamed({c: f"{c}__kept" for c in df.columns if c.lower() in clash})
    keyed = df.withColumns({"s_null": F.col(f"`{source}`").isNull(), "s_key": F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")), "m_size": words(text), "m_u": uniform(doc_id, text)})
    keyed = keyed.withColumn("m_pull", pull(F.col("m_size")))
    slim = written(keyed.select("s_null", "s_key", "m_size", "m_u", "m_pull"), "sized")
    classes = slim.groupBy("s_null", "s_key", F.col("m_pull").alias("pull")).agg(F.sum("m_size").alias("class_size"), F.count(F.lit(1)).alias("class_rows"))
    by_source = classes.groupBy("s_null", "s_key").agg(F.sum("class_size").alias("source_size"), F.sum("class_rows").alias("source_rows"))
    # every class of every source: a few dozen rows each
    plan = written(due(classes.join(targets(by_source, most, weights), ["s_null", "s_key"])), "due")
    of_source = F.sum(F.col("p") * F.col("class_size"))
    opened = plan.groupBy("s_null", "s_key").agg((F.max("target") - F.sum(F.col("whole") * F.col("class_size"))).alias("open"), (of_source / F.greatest(F.sum("class_size"), F.lit(1))).alias("mean_p"), F.max("source_rows").alias("m_rows"))
    own = plan.select("s_null", "s_key", F.col("pull").alias("m_pull"), "whole", "p", "source_size", "target").join(opened, ["s_null", "s_key"])
    own = written(own, "plan")
    if own.count() <= BROADCAST_CLASSES:
        own = F.broadcast(own)

    def placed(rows: DataFrame) -> DataFrame:
        """With odds (null without a fraction to fill) and the bucket of the ranking. Inclusion odds are taken beside those of the source's mean, so that
        buckets, runs of the odds, fill about evenly."""
        rows = rows.join(own, ["s_null", "s_key", "m_pull"])
        inclusion = F.when(F.col("p") > 0, F.col("p") / (1 - F.col("p")))
        odds = F.try_divide(F.col("m_u") / (1 - F.col("m_u")), inclusion)
        even = odds * F.when((F.col("mean_p") > 0) & (F.col("mean_p") < 1), F.col("mean_p") / (1 - F.col("mean_p"))).otherwise(1.0)
        bucket = F.when(odds.isNull(), -1 - F.floor(F.col("m_u") * F.ceil(F.col("m_rows") / BUCKET_ROWS))).otherwise(F.floor(even / (1 + even) * F.ceil(F.col("m_rows") / BUCKET_ROWS)))
        return rows.withColumn("m_odds", odds).withColumn("m_bucket", bucket.cast("long"))

    sums = placed(slim).where("m_odds is not null").groupBy("s_null", "s_key", "m_bucket").agg(F.sum("m_size").alias("words_here"))
    # sources one after the other, each bucket's words before it less those before its source
    ranked, _ = with_rank(sums, [F.col("s_null"), F.col("s_key"), F.col("m_bucket")], "b_rank", {"words_here": "words_all"})
    first = written(ranked, "ranked")
    start = first.groupBy("s_null", "s_key").agg(F.min("words_all").alias("words_start"))
    buckets = written(first.join(start, ["s_null", "s_key"]).select("s_null", "s_key", "m_bucket", (F.col("words_all") - F.col("words_start")).alias("words_before")), "buckets")
    rows = placed(keyed).join(buckets, ["s_null", "s_key", "m_bucket"], "left")
    ranking = Window.partitionBy("s_null", "s_key", "m_bucket").orderBy("m_odds", F.col(f"`{doc_id}`"), "m_size").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("words_before") + F.coalesce(F.sum("m_size").over(ranking), F.lit(0))
    extra = F.coalesce(F.col("m_odds").isNotNull() & (at + F.col("m_size") / 2 < F.col("open")), F.lit(False)).cast("long")
    mix = F.struct(F.col("m_size").alias("size"), "source_size", "target", (F.col("whole") + extra).alias("copies"), ((F.col("whole") + extra) * F.col("m_size")).alias("taken"))
    out = rows.withColumn("m_mix", mix)
    for done in (slim, plan, first):
        discard(done)
    kept = [c for c in df.columns if c.lower() != into.lower()]
    out = out.select(*(F.col(f"`{c}`") for c in kept), F.col("m_mix").alias(into))
    return out.withColumnsRenamed({c: c.removesuffix("__kept") for c in kept if c.endswith("__kept")}) if clash else out


def op8(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    out = with_copies(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def mixed(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of docs."""
    into = fresh_name(docs, "mix")
    out = with_copies(docs, into=into, **params).where(F.col(f"{into}.copies") > 0)
    again = fresh_name(docs, "again")
    return out.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(f"{into}.copies").cast("int")))).select(docs.columns)


#: DuckDB's SQL for op8.
ORACLE = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS u
  FROM documents),
pulled AS (SELECT *, length(bin(size)) + 4 AS pull FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM pulled GROUP BY source),
steps AS (
  SELECT *, 3.0 * source_size / weight AS reach,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total,
         coalesce(sum(3.0 * source_size) OVER w, 0.0) AS fixed,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0) AS rest
  FROM sources
  WINDOW w AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT coalesce((SELECT (total - fixed) / rest FROM steps WHERE (total - fixed) / rest <= reach ORDER BY reach, source NULLS LAST LIMIT 1),
                  (SELECT max(reach) FROM steps)) AS level),
targets AS (
  SELECT source, source_size, least(level * weight, 3.0 * source_size) AS target
  FROM sources, level),
classes AS (
  SELECT c.source, pull, class_size, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies
  FROM (SELECT source, pull, CAST(sum(size) AS BIGINT) AS class_size FROM pulled GROUP BY source, pull) c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source),
fits AS (
  SELECT source, pull, (target - copies * source_size - coalesce(sum(class_size) OVER before, 0)) / nullif(sum(class_size * pull) OVER rest, 0) AS factor
  FROM classes
  WINDOW before AS (PARTITION BY source ORDER BY pull DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (PARTITION BY source ORDER BY pull DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
factors AS (SELECT source, max_by(factor, pull) AS factor FROM fits WHERE factor * pull < 1 GROUP BY source),
chances AS (
  SELECT c.*, CASE WHEN source_size > 0 THEN greatest(coalesce(f.factor * c.pull, 1.0), 0.0) ELSE 0.0 END AS chance
  FROM classes c LEFT JOIN factors f ON c.source IS NOT DISTINCT FROM f.source),
copied AS (SELECT *, copies + CASE WHEN chance >= 1 THEN 1 ELSE 0 END AS whole, CASE WHEN chance < 1 THEN chance ELSE 0.0 END AS p FROM chances),
opened AS (SELECT source, max(target) - sum(whole * class_size) AS open FROM copied GROUP BY source),
ranked AS (
  SELECT d.*, c.source_size, c.target, c.whole, CASE WHEN c.p > 0 THEN (u / (1 - u)) / (c.p / (1 - c.p)) END AS odds
  FROM pulled d JOIN copied c ON d.source IS NOT DISTINCT FROM c.source AND d.pull = c.pull),
placed AS (
  SELECT r.*, o.open, coalesce(sum(CASE WHEN odds IS NULL THEN 0 ELSE size END) OVER (PARTITION BY r.source ORDER BY odds NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM ranked r JOIN opened o ON r.source IS NOT DISTINCT FROM o.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN odds IS NOT NULL AND before + size / 2.0 < open THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""
