"""Personal data by bootstrapped contextual extraction.

Expressions find the base spans: e-mail and IP addresses, card and telephone numbers. They are seeds, and so
are secrets that name themselves (`token = "..."`), which have no base expression. Instances are words with a digit or an
@, groups of digits in a row being one instance. The words on the left and right of seeds are lexical patterns.
On the bipartite graph of patterns and instances a pattern's confidence is the share of identifiers of its kind among the instances
it stands beside, those of other kinds left out; an instance's score is a noisy or over its trusted patterns. Instances that reach
a score are new identifiers, of the kind of those patterns, and seeds of the next round, until a round adds none. Base spans stay.

All is DataFrame expressions, linear in a text's length but for a search in the text's own spans; the graph is a table of counts by
pattern and token, summed before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, fresh_name, written
from plumbline.llm.sharding import let

KINDS = ("email", "ip", "card", "phone")
#: Kinds with base expressions, then the one that only the method adds.
ALL_KINDS = (*KINDS, "secret")
SECRET = len(KINDS)
#: The base expressions, with possessive repeats and, where a match can only start at the start of a run, a look behind: the
#: same matches in time linear in the text's length.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Groups of digits in a row, or a word with a digit or an @.
INSTANCE = (
    r"(?<![^\x20\x09-\x0D])(?:[(+]*+[0-9][0-9().+-]*+(?:\x20[(+]*+[0-9][0-9().+-]*+)++(?=[\p{P}\p{S}]*+(?![^\x20\x09-\x0D]))"
    r"|(?=[^\x20\x09-\x0D]*[0-9@])[^\x20\x09-\x0D]++)"
)
#: What is left of an instance without punctuation at its ends.
CORE = r"(?s)[\p{L}\p{N}+@](?:.*[\p{L}\p{N}])?"
#: Names of secrets, before the value that is assigned to them.
ASSIGNED = r"(?i)(?<![a-z])(?:token|secret|password|passwd|api[_-]?key)[\"']?\x20?[=:]\x20?[\"']?((?=[a-z0-9+/_.~-]*[0-9])(?=[a-z0-9+/_.~-]*[a-z])[a-z0-9+/_.~-]{16,})"
#: Distinct identifiers that a pattern needs, its least confidence, the least score of a new identifier, and its least length.
LEAST_SEEDS, LEAST_CONFIDENCE, LEAST_SCORE, LEAST_LENGTH = 5, 0.6, 0.85, 4
#: Sums are run over blocks of so many numbers; text is cut into blocks of so many characters.
BLOCK, CUT = 64, 1024


def running(x: Column) -> Column:
    """Of an array of integers, the sum before each. Blocks are summed apart, so that no long array is copied again and again."""

    def over(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, first, lambda a, v: F.struct((a["at"] + v).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

    def joined(blocks: Column) -> Column:
        before = over(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda t, v: t + v)), F.lit(0))
        return F.flatten(F.zip_with(blocks, before, over))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda i: F.slice(x, i * BLOCK + 1, F.lit(BLOCK)))
    return F.when(F.size(x) <= BLOCK, over(x, F.lit(0))).otherwise(let(blocks, joined))


def places(pieces: Column, found: Column) -> Column:
    """Where each of found starts: code points from 0. pieces lie between."""
    before = let(F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.char_length(p) + F.char_length(m)), running)
    return F.zip_with(before, F.slice(pieces, F.lit(1), F.size(found)), lambda a, p: a + F.char_length(p))


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of the matches: code points from 0, end exclusive. The pieces between matches
    have the lengths that lie between, so one pass gives all places."""
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def place(found: Column) -> Column:
        at = let(F.split(text, pattern, -1), lambda pieces: places(pieces, found))
        spans = F.zip_with(at, found, lambda b, x: F.struct(b.alias("start"), (b + F.char_length(x)).alias("end"), x.alias("found")))
        return F.when(F.size(found) == 0, none).otherwise(spans)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    each = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")
    value = F.transform(each, lambda c, i: let(c.cast("int") * (i % 2 + 1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(value, F.lit(0), lambda a, v: a + v) % 10 == 0


def small_part(x: Column) -> Column:
    return let(F.regexp_replace(x, "^0+(?=[0-9])", ""), lambda n: (F.char_length(n) <= 3) & (n.cast("int") <= 255))


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), small_part),
    "card": lambda m: let(digits(m), lambda d: F.char_length(d).between(16, 19) & luhn(d)),
    "phone": lambda m: F.char_length(digits(m)).between(8, 15),
}
#: Texts without these have no match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}


def base_spans(text: Column) -> Column:
    """array<struct<kind int (place in KINDS), start, end, found>> by kind, then start."""
    none = F.array().cast("array<struct<kind:int,start:int,end:int,found:string>>")
    parts = []
    for k, kind in enumerate(KINDS):
        own = F.filter(spans_of(text, BASE[kind]), lambda s: VALID[kind](s["found"]))  # noqa: B023
        named = F.transform(own, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found")))
        parts.append(F.when(F.contains(text, F.lit(NEEDS[kind])), named).otherwise(none) if NEEDS[kind] else named)
    return F.when(text.rlike("[0-9@]"), F.concat(*parts)).otherwise(none)


def first_ending_after(spans: Column, at: Column) -> Column:
    """Of spans that lie in order without overlap, the first that ends after `at`; null if there is none."""
    steps = F.array(*(F.lit(1 << b) for b in range(23, -1, -1)))
    before = F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= F.size(spans)) & (F.get(spans, n + s - 1)["end"] <= at), n + s).otherwise(n))
    return F.get(spans, before)


def tokens_of(text: Column, base: Column) -> Column:
    """array<struct<start, end, token, contexts, kind>> of the instances without punctuation at their ends, lower-cased, with their contexts (the word
    before, the two words before, the words on both sides or, with none before, the word after; an instance is no context), and the kind of the base span that the
    instance starts (null: none; -1: it lies in one; SECRET: it names itself). An instance that starts a base span is told by the whole of that span."""
    none = F.array().cast("array<struct<start:int,end:int,token:string,contexts:array<string>,kind:int>>")

    def words(piece: Column) -> Column:
        return F.lower(F.trim(F.translate(piece, "\t\n\x0b\x0c\r", "     ")))

    def one(found: Column, at: Column, left: Column, right: Column, by_kind: Column) -> Column:
        value = F.regexp_extract(F.concat(F.substring_index(left, " ", -2), F.lit(" "), found), ASSIGNED, 1)

        def told(x: Column) -> Column:
            """x: core, whether it is a secret."""
            begin = at + F.instr(found, x["core"]) - 1
            end = begin + F.char_length(x["core"])
            hits = F.filter(F.transform(by_kind, lambda spans: first_ending_after(spans, begin)), lambda h: h.isNotNull() & (h["start"] < end))
            hit = F.when(F.size(by_kind) == 0, None).otherwise(F.get(hits, F.lit(0)))

            def row(h: Column) -> Column:
                kind = F.when(h.isNotNull(), F.when(h["start"] >= begin, h["kind"]).otherwise(-1)).when(x["secret"], SECRET)
                contexts = F.filter(
                    F.array(
                        F.when(left != "", F.concat(F.lit("<"), F.substring_index(left, " ", -1))),
                        F.when(F.contains(left, F.lit(" ")), F.concat(F.lit("<<"), F.substring_index(left, " ", -2))),
                        F.when(right != "", F.concat(F.substring_index(left, " ", -1), F.lit(">"), F.substring_index(right, " ", 1))),
                    ),
                    lambda c: c.isNotNull(),
                )
                return F.struct(begin.alias("start"), end.alias("end"), F.lower(F.when(kind.between(0, SECRET - 1), h["found"]).otherwise(x["core"])).alias("token"), contexts.alias("contexts"), kind.alias("kind"))

            return let(hit, row)

        plain = F.struct(F.regexp_extract(found, CORE, 0).alias("core"), F.lit(False).alias("secret"))
        return let(let(value, lambda v: F.when(v != "", F.struct(v.alias("core"), F.lit(True).alias("secret"))).otherwise(plain)), told)

    def build(found: Column, pieces: Column, by_kind: Column) -> Column:
        sides = F.transform(pieces, words)
        return let(sides, lambda w: let(places(pieces, found), lambda at: F.transform(found, lambda x, i: one(x, F.get(at, i), F.get(w, i), F.get(w, i + 1), by_kind))))

    def placed(found: Column) -> Column:
        by_kind = F.when(F.size(base) > 0, F.transform(F.sequence(F.lit(0), F.lit(len(KINDS) - 1)), lambda k: F.filter(base, lambda s: s["kind"] == k))).otherwise(F.slice(F.array(base), F.lit(1), F.lit(0)))
        return F.when(F.size(found) == 0, none).otherwise(let(F.split(text, INSTANCE, -1), lambda pieces: let(by_kind, lambda kinds: build(found, pieces, kinds))))

    return F.when(text.rlike("[0-9@]"), let(F.regexp_extract_all(text, F.lit(INSTANCE), F.lit(0)), placed)).otherwise(none)


def bootstrapped(found: DataFrame) -> DataFrame:
    """token, kind of the identifiers that trusted patterns discover in found (tokens)."""
    each = found.select(F.explode("tokens").alias("t")).where("t.kind is null or t.kind >= 0").where(F.char_length("t.token") >= LEAST_LENGTH)
    graph = written(each.select("t.token", "t.kind", F.explode("t.contexts").alias("pattern")).groupBy("pattern", "token").agg(F.max("kind").alias("seed")), "graph")
    # a token that is a seed anywhere is one
    known = written(graph.where("seed is not null").groupBy("token").agg(F.max("seed").alias("kind")), "known")
    added = None
    while True:
        given = graph.select("pattern", "token").join(known, "token", "left")
        counts = given.groupBy("pattern").agg(F.count_if(F.col("kind").isNull()).alias("free"), *(F.count_if(F.col("kind") == k).alias(f"n{k}") for k in range(len(ALL_KINDS))))
        by_kind = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"n{k}").alias("n")) for k in range(len(ALL_KINDS))))).alias("k")
        trust = counts.where("free > 0").select("pattern", "free", by_kind).select("pattern", "k.kind", "k.n", (F.col("k.n") / (F.col("k.n") + F.col("free"))).alias("confidence"))
        trust = trust.where(f"n >= {LEAST_SEEDS} and confidence >= {LEAST_CONFIDENCE}").select("pattern", F.col("kind").alias("as_kind"), "confidence")
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))
        scores = given.where("kind is null").join(trust, "pattern").groupBy("token", "as_kind").agg((1 - doubt).alias("score")).where(f"score >= {LEAST_SCORE}")
        # of several kinds the best score's, then the first
        new = scores.groupBy("token").agg((-F.max(F.struct("score", (-F.col("as_kind")).alias("k")))["k"]).alias("kind"))
        new = written(new, "discovered")
        if new.limit(1).count() == 0:
            discard(new)
            break
        added = new if added is None else written(added.unionByName(new), "added")
        known = written(known.unionByName(new), "known")
    return added if added is not None else known.where("false")


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A table of the columns `keep`, base and spans: both array<struct<kind, start, end>> by kind in KINDS, then start.

    A null text counts as empty: no spans. Rows stay as they are, repeated ones too; a repeated row counts once for the patterns, which count
    distinct instances. An empty table gives an empty result. Very long texts are read whole, in linear time. Of kinds with equal
    scores the first is taken. Added spans overlap no base span; their kinds are those of KINDS or `secret`, the last.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), t.alias("t"))
    based = own.withColumn("base", base_spans(F.col("t"))).withColumn("tokens", tokens_of(F.col("t"), F.col("base"))).withColumn("uid", F.monotonically_increasing_id())
    found = written(based.drop("t"), "spans")
    new = bootstrapped(found)
    at = found.select("uid", F.explode("tokens").alias("t")).where("t.kind is null").select("uid", "t.start", "t.end", "t.token").join(new, "token")
    added = at.groupBy("uid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    plain = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    secrets = plain(F.filter("tokens", lambda s: s["kind"] == SECRET))
    more = F.concat(plain(F.col("base")), secrets, F.coalesce(F.col("added"), F.array().cast("array<struct<kind:int,start:int,end:int>>")))
    both = F.when((F.size(secrets) == 0) & F.col("added").isNull(), plain(F.col("base"))).otherwise(F.array_sort(more))
    out = found.join(added, "uid", "left").select(*(f"k{i}" for i in range(len(keep))), plain(F.col("base")).alias("base"), both.alias("spans"))
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def written_spans(spans: Column) -> Column:
    name = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added of every document."""
    found = find(docs.select("doc_id", "text"), keep=("doc_id",))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written_spans(F.col("base")), 256).alias("base_sha256"), written_spans(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


def redact(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in brackets; what overlaps is replaced once, to its last end. The text is cut into blocks
    first, so that what lies between spans is found without a walk from the text's start."""
    label = F.array(*(F.lit(f"[{k.upper()}]") for k in ALL_KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        """Adds the gap before a span and its label, unless the span starts within what is replaced."""
        part = F.struct(acc["at"].alias("from"), s["start"].alias("to"), F.element_at(label, s["kind"] + 1).alias("name"))
        return F.struct(F.when(s["start"] >= acc["at"], F.array_append(acc["out"], part)).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    start = F.struct(F.array().cast("array<struct<from:int,to:int,name:string>>").alias("out"), F.lit(0).alias("at"))
    last = lambda a: F.array_append(a["out"], F.struct(a["at"].alias("from"), F.char_length(text).alias("to"), F.lit("").alias("name")))
    parts = F.aggregate(ordered, start, step, last)

    def between(blocks: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / CUT).cast("int")
        own = F.slice(blocks, first + 1, F.greatest(F.ceil(b / CUT).cast("int") - first, F.lit(0)))
        return F.array_join(F.transform(own, lambda x, i: F.substring(x, F.greatest(a - (first + i) * CUT, F.lit(0)) + 1, b - F.greatest(a, (first + i) * CUT))), "")

    whole = lambda blocks: F.array_join(F.transform(parts, lambda p: F.concat(between(blocks, p["from"], p["to"]), p["name"])), "")
    return F.when(F.size(spans) == 0, text).otherwise(let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)), whole))


def redacted(docs: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    """docs with all spans redacted and, where the column `size` exists and the text changed, its length in code points renewed. Null texts stay null; all rows and columns stay."""
    found = find(docs, text, keep=tuple(docs.columns))
    new = fresh_name(docs, "clean")
    out = found.withColumn(new, redact(F.col(f"`{text}`"), F.col("spans")))
    changed = F.size("spans") > 0
    columns = []
    for c, kind in docs.dtypes:
        if c == text:
            columns.append(F.when(F.col(f"`{c}`").isNull(), F.lit(None)).otherwise(F.col(new)).alias(c))
        elif c == size:
            columns.append(F.when(changed, F.char_length(new).cast(kind)).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return out.select(*columns)
