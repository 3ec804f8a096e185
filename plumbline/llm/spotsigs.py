"""Document fingerprints by SpotSigs.

Common words are anchors. An anchor with the chain of content words that follows it, common words skipped, is a spot signature; the set of a
text's signatures, hashed, is its fingerprint. In a text without anchors, chains start at every word. Sets are compared by their Jaccard similarity. For near duplicates,
sets are partitioned by length, so that only neighbouring partitions can hold partners, and only pairs that share
one of their rarest signatures are compared.

All is DataFrame expressions. A text is marked once by an expression that puts every anchor between
two control characters; pieces between anchors are then its content words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import with_rank, written
from plumbline.llm.pii import running
from plumbline.llm.sharding import let

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "the of and to a in is that it was for on are with as be this by an at "
    "de la le et les des un une que du dans pour qui sur par au "
    "der die und den von das ist im mit für ein sich auf nicht "
    "el los las y se por con para es una"
).split()
#: Content words of a chain, wherever the next ones stand.
CHAIN = 2


def chains(words: Column) -> Column:
    """array<long>: the hash of each word with the CHAIN words after it; of fewer words than that, of all of them."""
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - CHAIN - 1, F.lit(0)))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(CHAIN + 1))))


def told_by_count(hashes: Column) -> Column:
    """array<long>: the distinct hashes. One that fills a 16th of the places, four at least, is told by the number of bits of its
    count too, so that a page of one repeated word is no copy of a much shorter one."""

    def runs(s: Column) -> Column:
        def one(p: Column, n: Column) -> Column:
            return F.when((n >= 4) & (n * 16 >= F.size(s)), F.xxhash64(F.get(s, p), F.length(F.bin(n)))).otherwise(F.get(s, p))

        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda st: F.transform(st, lambda p, j: one(p, F.coalesce(F.get(st, j + 1), F.size(s)) - p)))

    return let(F.array_sort(hashes), runs)


def signatures(text: Column) -> Column:
    """array<long>: the distinct hashes of the text's spot signatures, sorted. A text without anchors has chains of words at every
    position instead, so that a changed word costs it a few signatures. An empty text has one signature."""
    words = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    marked = F.regexp_replace(F.concat(F.lit(" "), words, F.lit(" ")), f" ({'|'.join(sorted(ANCHORS, key=len, reverse=True))})(?= )", "\x01$1\x02")

    def spots(marked: Column) -> Column:
        def of(pieces: Column) -> Column:
            """pieces: each an anchor and the content words up to the next one."""
            own = F.transform(pieces, lambda p: F.filter(F.split(F.substring_index(p, "\x02", -1), " "), lambda w: w != ""))

            def chained(own: Column) -> Column:
                def hashed(content: Column, at: Column) -> Column:
                    chain = lambda i: F.concat_ws(" ", *(F.get(content, F.get(at, i) + k) for k in range(CHAIN)))
                    return F.transform(pieces, lambda p, i: F.xxhash64(F.substring_index(p, "\x02", 1), chain(i)))

                # where the content words after each anchor begin, among all
                return let(F.flatten(own), lambda content: let(let(F.transform(own, F.size), running), lambda at: hashed(content, at)))

            return let(own, chained)

        found = let(F.split(marked, "\x01"), lambda p: let(F.slice(p, F.lit(2), F.size(p) - 1), of))
        every = told_by_count(let(F.split(F.trim(marked), " "), chains))
        return F.array_sort(F.array_distinct(F.when(F.contains(marked, F.lit("\x01")), found).otherwise(every)))

    return let(marked, spots)


def fingerprint(signatures: Column) -> Column:
    """The signatures, in order, as hexadecimal text: equal for equal sets, and two of them tell the likeness of what they stand for."""
    return F.lower(F.array_join(F.transform(signatures, F.hex), ","))


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two fingerprints."""
    return jaccard(F.split(a, ","), F.split(b, ","))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return let(shared, lambda n: n / (F.size(a) + F.size(b) - n).cast("double"))


def pruned_jaccard(a: Column, b: Column, least: float) -> Column:
    """The similarity, or null at once where the lengths alone keep it below `least`."""
    return F.when(F.least(F.size(a), F.size(b)) >= least * F.greatest(F.size(a), F.size(b)), jaccard(a, b))


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, similarity) of representatives whose sets reach `least`, and the membership (doc_id,
    representative): documents of equal sets are one, told by its least id. Null texts count as empty, null ids take no part.

    Sets are partitioned by length, each partition reaching from x to x / least; a set is looked for in its own partition and
    the one below. In each only the rarest signatures are joined, as many as a partner cannot do without.
    """
    own = df.where(F.col(f"`{doc_id}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("id"), signatures(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("sigs"))
    own = written(own.withColumn("print", F.sha2(fingerprint(F.col("sigs")), 256)), "spots")
    heads = own.groupBy("print").agg(F.min("id").alias("rep"))
    members = own.select("id", "print").join(heads, "print").select(F.col("id").alias(doc_id), F.col("rep").alias("representative"))
    one = own.join(heads, (F.col("id") == F.col("rep")) & (own["print"] == heads["print"])).select("rep", "sigs").dropDuplicates(["rep"])
    spots = one.select("rep", F.size("sigs").alias("n"), F.explode("sigs").alias("s"))
    counts = spots.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rank = Window.partitionBy("rep").orderBy(F.col("df").asc_nulls_first(), "s")
    prefix = spots.join(counts, "s", "left").withColumn("at", F.row_number().over(rank)).where(F.col("at") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).where("df is not null")
    prefix = prefix.withColumn("band", F.floor(F.log("n") / F.log(F.lit(1 / least)) + 1e-9).cast("int"))
    probe = prefix.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), "s", F.explode(F.array("band", F.col("band") - 1)).alias("band"))
    hits = probe.join(prefix.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), "s", "band"), ["s", "band"])
    hits = hits.where((F.col("a") != F.col("b")) & (F.col("n_b") <= F.col("n_a")) & (F.col("n_b") >= least * F.col("n_a"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = hits.join(one.select(F.col("rep").alias("a"), F.col("sigs").alias("x")), "a").join(one.select(F.col("rep").alias("b"), F.col("sigs").alias("y")), "b")
    return both.select("a", "b", pruned_jaccard(F.col("x"), F.col("y"), least).alias("similarity")).where(F.col("similarity") >= least), members


#: Documents next to each other in order of id share a bucket of so many ids.
BUCKET = 64


def op1(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures of every document.

    The next document comes from the row's bucket of ids; the last row of a bucket gets the first of the next filled bucket,
    that of the last the first of all. Texts are shuffled once. Null ids come first; repeated ids follow each other by a hash of their texts. A null or
    empty text has one signature. Very long texts are fingerprinted whole. An empty table gives an empty result; a lone document is its own next.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.floor(F.col("doc_id") / BUCKET), F.lit(-(2**60)))
    own = docs.select("doc_id", t.alias("t"), key.cast("long").alias("bucket"))
    buckets, n = with_rank(docs.select(key.cast("long").alias("bucket")).distinct(), [F.col("bucket")], "r")
    buckets = written(buckets, "buckets")
    # from a bucket to the one before it, around the end
    before = buckets.select("bucket", ((F.col("r") + max(1, n) - 1) % max(1, n)).alias("r")).join(buckets.select(F.col("bucket").alias("before"), "r"), "r").select("bucket", "before")
    dealt = own.repartition("bucket")
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("t"))
    heads = dealt.withColumn("at", F.row_number().over(order)).where("at = 1").select("bucket", F.col("t").alias("head"))
    heads = heads.join(before, "bucket").select(F.col("before").alias("bucket"), F.struct(F.col("head").alias("t"), signatures(F.col("head")).alias("sigs")).alias("head"))
    own = dealt.withColumn("sigs", signatures(F.col("t")))
    own = own.withColumn("next", F.lead(F.struct("t", "sigs")).over(order)).withColumn("last", F.col("next").isNull())
    with_next = own.join(heads.withColumnRenamed("bucket", "of"), (F.col("bucket") == F.col("of")) & F.col("last"), "left").withColumn("next", F.coalesce("next", "head"))
    n_chars = F.char_length("t")
    half = F.floor(n_chars / 2).cast("int")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), n_chars - half), F.substring(F.col("next.t"), F.lit(1), half))
    slim = with_next.select("doc_id", n_chars.cast("long").alias("n_chars"), edited.alias("edited"), "sigs", F.col("next.sigs").alias("next_sigs"))
    slim = slim.withColumn("edited_sigs", signatures(F.col("edited")))
    return slim.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        F.size("sigs").cast("long").alias("n_signatures"),
    )
