"""N-gram Jaccard join by universe partitioning.

A document's set holds its distinct word n-grams, as 64-bit hashes. Two sets whose Jaccard
similarity is at least `num/den` differ in at most H = (den - num) * (|r| + |s|) / (den + num) elements.

Sizes fall into bands. The scheme of a band hashes the universe of elements into m segments and
marks d of them as neighbourhood segments. For every segment the subset of a record's elements in it
is a signature; for neighbourhood segments so are the subsets with one element deleted. Sets that share
no signature differ by at least 1 in each plain and 2 in each neighbourhood segment, m + d in all;
with m + d > H a shared signature is certain, and m + d - H - 1 is slack. m and d come from a cost
model (signatures, weighed by how common short subsets are), for each band.

Candidates come in two rounds, as what is asked for is the components of the links. In the first every
record meets the least record of each of its signatures, one pair however many share it; links make
components. In the second only signatures are left that records of several components share. Those of
few records give their pairs. Hot ones, which more than HOT records have, may be passed over while a
record's slack lasts: whether one is passed over depends on the signature alone, so a pair misses only if
both records have passed over more than the slack; such records join on hot signatures too, where hubs
and rare elements keep the number of candidates small (see hot_links).

Candidates are compared by sizes, then by counts of elements in cells of the universe (a lower bound of
what two sets differ in), and what is left is verified on the words themselves, without hashes. Equal
sets are one record throughout. Records are told by 61 bits of their sets' hash; a second hash of 64 bits,
from other hashes of the words, shows two sets with the same id, and then the seed is changed. The hash of a word
sums its bytes times random numbers, one for each place, that follow from the seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import discard, fresh_name, small_batches, written

U = np.uint64
HOT = 8
#: Signature entries that a task holds before it sends them, and that a group holds on average (16 bytes each).
HELD = 500_000
#: Signatures of which a task has met more records at once than this are sent apart from the others.
CROWD = 16
#: Records that a task remembers, so that a copy's signatures aren't sent twice.
SEEN = 50_000
#: Bytes of text that are hashed together, and elements whose signatures are made together.
TOGETHER, AT_ONCE = 1 << 16, 1 << 14
#: Words of more bytes are hashed one by one.
LONGEST = 4096
#: Ids are broadcast up to so many, else joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Sets of hubs are broadcast up to so many elements (8 bytes each), else joined by a shuffle.
BROADCAST_ELEMENTS = 4_000_000
#: Elements are counted by these many first bits of their hashes, to compare sets before they are sent.
CELL_BITS = 7
#: Cost model: how often an element is a common one, and what a signature of only common elements costs.
COMMON, PENALTY = 0.2, 50.0
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit integers stirred, one to one."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words_of(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased, in UTF-8."""
    return text.encode("utf-8").lower().split()


@lru_cache(4)
def weights(seed: int) -> np.ndarray:
    """A random number for each place in a word, which follow from the seed."""
    return np.random.Generator(np.random.Philox(key=seed)).integers(0, 1 << 64, LONGEST, dtype=U)


def word_hashes(data: bytes, seed: int, halves: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of data starts, and one or two 64-bit hashes of it (rows): the sum of its bytes times the random
    numbers of their places, and its length. Two words of a length have equal sums with a probability of at most 2**-56, whatever they are."""
    raw = np.frombuffer(data, dtype=np.uint8)
    solid = (raw != 32) & (raw - np.uint8(9) > 4)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]])))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.zeros((halves, 0), dtype=U)
    sizes = ends - starts
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    letters = raw[starts[0] :].astype(U) + U(1)
    # longer words are rare and get a digest each
    far = sizes.max() > LONGEST
    out = np.empty((halves, len(starts)), dtype=U)
    for i in range(halves):
        own = weights(2 * seed + i)
        sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum(letters * own[place % LONGEST if far else place])])
        out[i] = mix((sums[ends - starts[0]] - sums[starts - starts[0]]) ^ sizes.astype(U) * U(MULTIPLIERS[0]))
    for k in np.flatnonzero(sizes > LONGEST) if far else ():
        word = data[starts[k] : ends[k]]
        for i in range(halves):
            out[i, k] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=(2 * seed + i).to_bytes(8, "little")).digest(), "little")
    return starts, out


def shingles(texts: list[str | None], n: int = 5, seed: int = 0, halves: int = 1) -> Iterator[np.ndarray]:
    """Of every text, one or two 64-bit hashes (rows) of its n-word shingles in order. Fewer words than n are one shingle; none give none.
    Texts are hashed together, TOGETHER bytes at a time."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        group.append((text or "").encode("utf-8").lower())
        size += len(group[-1])
        if size >= TOGETHER:
            yield from _shingles(group, n, seed, halves)
            group, size = [], 0
    if group:
        yield from _shingles(group, n, seed, halves)


def _shingles(group: list[bytes], n: int, seed: int, halves: int) -> Iterator[np.ndarray]:
    starts, words = word_hashes(b"\n".join(group), seed, halves)
    sizes = np.fromiter(map(len, group), dtype=np.int64, count=len(group)) + 1
    cuts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    factors = [U(pow(MULTIPLIERS[0], i + 1, 1 << 64)) for i in range(n)]

    def over(h: np.ndarray, k: int) -> np.ndarray:
        out = np.full((halves, h.shape[1] - k + 1), k, dtype=U)
        for i in range(k):
            out += h[:, i : h.shape[1] - k + 1 + i] * factors[i]
        return mix(out)

    every = over(words, n) if words.shape[1] >= n else None
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        yield every[:, a : b - n + 1] if b - a >= n else over(words[:, a:b], b - a) if b > a else words[:, a:a]


def shingle_set(text: str | None, n: int = 5, seed: int = 0) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles."""
    return distinct(next(shingles([text], n, seed))[0])


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    s = np.sort(x)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def record_ids(sets: list[np.ndarray]) -> np.ndarray:
    """Ids of sets: 61 bits, the last three bits free, as signed integers; 0 of empty sets."""
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    out, full = np.zeros(len(sets), dtype=np.int64), sizes > 0
    if full.any():
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full] = (mix(np.add.reduceat(mix(np.concatenate(sets) ^ U(MULTIPLIERS[1])), starts) + sizes[full].astype(U)) & ~U(7)).view(np.int64)
    return out


def described(both: list[np.ndarray]) -> pd.DataFrame:
    """Of sets given by two hashes of their shingles: their sizes, ids, second hashes, and the numbers of their elements by cell of the universe, 127 at most."""
    sets, others = [], []
    for first, second in both:
        order = np.argsort(first)
        s = first[order]
        new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else slice(0)
        sets.append(s[new])
        others.append(second[order][new])
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    other, full = np.zeros(len(sets), dtype=np.int64), sizes > 0
    if full.any():
        other[full] = np.add.reduceat(mix(np.concatenate(others)), (np.cumsum(sizes) - sizes)[full]).view(np.int64)
    cell = np.repeat(np.arange(len(sets)) << CELL_BITS, sizes) + (np.concatenate(sets) >> U(64 - CELL_BITS)).astype(np.int64)
    cells = np.minimum(np.bincount(cell, minlength=len(sets) << CELL_BITS), 127).astype(np.int8).reshape(len(sets), -1)
    return pd.DataFrame({"n_shingles": sizes, "node": record_ids(sets), "second": other, "cells": list(cells)})


def similar(a: str, b: str, n: int, num: int, den: int) -> bool:
    """Whether the sets of two texts reach the similarity, by their words. Hashes come first; where they do, every step from words to shingles
    numbers what the two texts have, one to one."""
    p, q = (distinct(x[0]) for x in shingles([a, b], n))
    shared = len(np.intersect1d(p, q, assume_unique=True))
    # hashes that are equal by chance only add to what is shared, and take from what there is: a few are let pass
    if not shared or den * (shared + 2) < num * (len(p) + len(q) - shared - 2):
        return False
    x, y = words_of(a), words_of(b)
    if len(x) < n or len(y) < n:
        return x == y and bool(x)
    numbers: dict[bytes, int] = {}
    for word in x + y:
        numbers.setdefault(word, len(numbers))
    own = [np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)) for words in (x, y)]
    # as many words at once as fit in 63 bits
    step = 63 // max(1, (len(x) + len(y)).bit_length())
    grams, k = own, 1
    while k < n:
        more = min(step - 1, n - k)
        longer = [g[: len(w) - k - more + 1] for g, w in zip(grams, own)]
        for j in range(k, k + more):
            longer = [g * (len(x) + len(y)) + w[j : j + len(g)] for g, w in zip(longer, own)]
        k += more
        if k < n:
            at = np.unique(np.concatenate(longer), return_inverse=True)[1]
            longer = [at[: len(longer[0])], at[len(longer[0]) :]]
        grams = longer
    p, q = distinct(grams[0]), distinct(grams[1])
    shared = len(np.intersect1d(p, q, assume_unique=True))
    return den * shared >= num * (len(p) + len(q) - shared)


class Bands:
    def __init__(self, num: int = 80, den: int = 100):
        self.num, self.den = num, den
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(max(self.lows[-1] + 1, self.lows[-1] * den // num))
        self.scheme = lru_cache(None)(self._scheme)

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.lows, size, side="right")) - 1

    def bands_of(self, size: int) -> list[int]:
        """The record's own band, and those below that may hold smaller partners."""
        own = self.band(size)
        out = [own]
        while own and self.num * size <= self.den * (self.lows[own] - 1):
            own -= 1
            out.append(own)
        return out

    def _scheme(self, band: int) -> tuple[int, int, int]:
        """Segments m, neighbourhood segments d (the first d), slack."""
        low, high = self.lows[band], self.lows[band + 1] - 1
        h = (self.den - self.num) * (high + high * self.den // self.num) // (self.den + self.num)
        best = None
        for m in range((h + 2) // 2, 2 * h + 6):
            each = low / m
            bad = m * np.exp(-each) if m > 1 else 0.0
            slack = int(np.ceil(bad + 2 * np.sqrt(bad) + 0.04 * m)) if m > 2 else 0
            d = max(0, h + 1 + slack - m)
            if d > m:
                continue
            price = lambda k: 1 + PENALTY * COMMON ** max(k, 0.0)
            cost = (m - d) * price(each) + d * (price(each) + each * price(each - 1))
            if best is None or cost < best[0]:
                best = (cost, m, d, m + d - h - 1)
        return best[1:]


@lru_cache(4)
def bands_for(num: int, den: int) -> Bands:
    return Bands(num, den)


def signatures(sets: list[np.ndarray], nodes: list[int], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Entries of records: signature (56 bits, then the slack that empty subsets leave) and record (61
    bits, then which band below its own, and whether the segment is a neighbourhood one).

    Every band that a record takes part in is a row; the segments of all rows are numbered through.
    """
    rows = [(i, below, band, *bands.scheme(band)) for i, s in enumerate(sets) for below, band in enumerate(bands.bands_of(len(s)))]
    record, below, band, m, d, slack = np.array(rows, dtype=np.int64).T
    lens = np.fromiter((len(sets[i]) for i in record), dtype=np.int64, count=len(record))
    s, row = np.concatenate([sets[i] for i in record]), np.repeat(np.arange(len(record)), lens)
    parts = mix(s ^ U(MULTIPLIERS[3]))
    spread = mix(s + (band + 1).astype(U)[row])
    own = (((spread >> U(32)) * m.astype(U)[row]) >> U(32)).astype(np.int64)
    seg = (np.cumsum(m) - m)[row] + own
    total = int(m.sum())
    sums = np.zeros(total, dtype=U)
    np.add.at(sums, seg, parts)
    count = np.bincount(seg, minlength=total)
    of = np.repeat(np.arange(len(record)), m)
    place = np.arange(total) - (np.cumsum(m) - m)[of]
    filled, inner = count > 0, place < d[of]
    # a subset of one leaves an empty neighbour
    passed = np.bincount(of, weights=~filled * (1.0 + inner) + ((count == 1) & inner), minlength=len(record)).astype(np.int64)
    easy = passed <= slack
    tag = mix(place.astype(U) + (band.astype(U) << U(32))[of])
    use = np.flatnonzero(filled | ~easy[of])
    less = np.flatnonzero((own < d[row]) & (~easy[row] | (count[seg] > 1)))
    key = np.concatenate([mix(sums[use] + tag[use]), mix(sums[seg[less]] - parts[less] + tag[seg[less]])])
    at = np.concatenate([of[use], row[less]])
    left = np.clip(slack - passed, 0, 255).astype(U)
    flags = np.minimum(below, 2).astype(U) << U(1)
    near = np.concatenate([inner[use], np.ones(len(less), dtype=bool)]).astype(U)
    owner = np.array(nodes, dtype=np.int64).view(U)[record] | flags
    return key & ~U(255) | left[at], owner[at] | near


def slim_sets(docs: DataFrame, n: int, seed: int) -> DataFrame:
    """docs (row, t and others) without t, with n_shingles, node, second, cells."""

    @F.pandas_udf("n_shingles long, node long, second long, cells array<tinyint>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield described(list(shingles(batch.tolist(), n, seed, halves=2)))

    return docs.withColumn("s", run("t")).drop("t").select("*", "s.*").drop("s")


def signature_rows(docs: DataFrame, parts: int, n: int, seed: int, bands: Bands) -> DataFrame:
    """Entries of every distinct set of a task, packed by part: part, entries.

    A signature's part follows from the signature, but entries of a crowd (more than CROWD records at once) go to a part
    of their own, past the others, and one of them, with all flags set, marks the signature in its usual part. So no part gets more than CROWD + 1
    entries of a signature from a task, however many records have it.
    """
    num, den = bands.num, bands.den

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, seen, keys, owners, size = bands_for(num, den), set(), [], [], 0
        crowds, apart_from = np.zeros(0, dtype=U), parts + (TaskContext.get().partitionId() << 24)

        def packed() -> pd.DataFrame:
            nonlocal crowds, apart_from
            k, o = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(k)
            k, o = k[order], o[order]
            sig = k >> U(8)
            start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            count = np.diff(np.append(start, len(sig)))
            known = np.isin(sig[start], crowds)
            crowded = known | (count > CROWD)
            marks = start[crowded & ~known]
            crowds, apart = np.union1d(crowds, sig[marks]), np.repeat(crowded, count)
            rows = []
            if apart.any():
                rows.append((apart_from, np.stack([k[apart], o[apart]], axis=1).tobytes()))
                apart_from += 1
                o[marks] |= U(7)
                apart[marks] = False
                k, o = k[~apart], o[~apart]
            # parts are runs of signatures, so one sort does
            part = (((k >> U(32)) * U(parts)) >> U(32)).astype(np.int64)
            both, cuts = np.stack([k, o], axis=1), np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            rows += [(int(part[a]), both[a:b].tobytes()) for a, b in zip(cuts, np.append(cuts[1:], len(part)))]
            return pd.DataFrame(rows, columns=["part", "entries"])

        def signed() -> None:
            nonlocal size
            k, o = signatures([s for s, _ in fresh], [node for _, node in fresh], own)
            keys.append(k)
            owners.append(o)
            size += len(k)

        for batch in batches:
            fresh, elements = [], 0
            sets = [distinct(x[0]) for x in shingles(batch["t"].tolist(), n, seed)]
            for s, node in zip(sets, record_ids(sets).tolist()):
                if not len(s) or node in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                fresh.append((s, node))
                elements += len(s)
                if elements >= AT_ONCE:
                    signed()
                    fresh, elements = [], 0
                if size >= HELD:
                    yield packed()
                    keys, owners, size = [], [], 0
            if fresh:
                signed()
        if size:
            yield packed()

    return docs.select("t").mapInPandas(run, "part long, entries binary")


def shared_entries(packed: DataFrame, parts: int) -> DataFrame:
    """Entries of signatures that several records have: sig, node, slack (that empty subsets leave), below (which band), weight."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        both = np.frombuffer(b"".join(pdf["entries"]), dtype=U).reshape(-1, 2)
        both = both[np.argsort(both[:, 0])]
        sig = both[:, 0] >> U(8)
        several = np.zeros(len(sig), dtype=bool)
        several[1:] = sig[1:] == sig[:-1]
        several[:-1] |= several[1:]
        apart = pdf["part"].iloc[0] >= parts
        both = both if apart else both[several]
        # of few entries now: each record once
        both = both[np.lexsort((both[:, 1], both[:, 0] >> U(8)))]
        sig, left, node, flags = both[:, 0] >> U(8), both[:, 0] & U(255), both[:, 1] & ~U(7), both[:, 1] & U(7)
        first = np.ones(len(sig), dtype=bool)
        first[1:] = sig[1:] != sig[:-1]
        new = first.copy()
        new[1:] |= node[1:] != node[:-1]
        sig, node, flags, left, first = sig[new], node[new], flags[new], left[new], first[new]
        count = np.diff(np.append(np.flatnonzero(first), len(sig)))
        shared = np.repeat((count > 1) | apart, count) & (flags != U(7))
        sig, node, flags, left = sig[shared], node[shared], flags[shared], left[shared]
        return pd.DataFrame({"sig": sig.astype(np.int64), "node": node.view(np.int64), "slack": left.astype(np.int32), "below": (flags >> U(1)).astype(np.int32), "weight": (flags & U(1)).astype(np.int32) + np.int32(1)})

    return packed.groupBy("part").applyInPandas(run, "sig long, node long, slack int, below int, weight int")


def close(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) that sizes and cells leave: what two sets differ in by cell of the universe is a lower bound of what they
    differ in."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("cells").alias(f"c_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)")
    apart = F.aggregate(F.zip_with("c_a", "c_b", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda t, v: t + v)
    return both.where(apart * (den + num) <= (F.col("n_a") + F.col("n_b")) * (den - num)).select("a", "b")


def texts_of(ids: DataFrame, base: DataFrame, nodes: DataFrame, repeats: bool) -> DataFrame:
    """node, t for the sets (node) of ids. Rows are found by id and hash of the text, null ids too."""
    wanted = ids.distinct().join(nodes.select("node", F.col("rep.row").alias("want"), F.col("rep.tk").alias("want_tk")), "node")
    found = base.join(_sent(*_counted(wanted, "wanted")), F.col("row").eqNullSafe(F.col("want")) & (F.col("tk") == F.col("want_tk"))).select("node", "t")
    return found.groupBy("node").agg(F.min("t").alias("t")) if repeats else found


def verified(pairs: DataFrame, base: DataFrame, nodes: DataFrame, repeats: bool, n: int, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) whose sets reach the similarity, by their words."""
    left = written(close(pairs, nodes, num, den), "close")
    texts = written(texts_of(left.select(F.col("a").alias("node")).union(left.select("b")), base, nodes, repeats), "texts")
    same = F.udf(lambda x, y: similar(x, y, n, num, den), "boolean")
    side = lambda x: texts.select(F.col("node").alias(x), F.col("t").alias(f"t_{x}"))
    out = written(left.join(side("a"), "a").join(side("b"), "b").where(same("t_a", "t_b")).select("a", "b"), "links")
    discard(left), discard(texts)
    return out


def _sent(ids: DataFrame, n: int) -> DataFrame:
    """ids (n rows of a few longs) to be broadcast while they are few, so that sets needn't be dealt out."""
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


def _counted(ids: DataFrame, name: str) -> tuple[DataFrame, int]:
    ids = written(ids, name)
    return ids, ids.count()


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the least node that is reachable, for the nodes of edges (a, b). Every round takes
    the least label around and then that label's own label; tables of the round before are dropped."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("comp")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("least"))
        near = labels.join(around.withColumnRenamed("a", "node"), "node").select("node", "comp", F.least("comp", "least").alias("next"))
        jump = near.join(labels.select(F.col("node").alias("next"), F.col("comp").alias("far")), "next", "left")
        after = written(jump.select("node", F.least("next", "far").alias("comp"), (F.least("next", "far") != F.col("comp")).alias("moved")), "labels")
        discard(labels)
        labels = after
        if labels.where("moved").limit(1).count() == 0:
            discard(both)
            return labels.select("node", "comp")


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, of, elements) by element that several rows of the keys have, with its place among the row's elements, the
    rarest first. Elements that only one row has lead to no partner, but take their places."""
    each = rows.select(*keys, "of", *([c for c in ("linked",) if c in rows.columns]), F.explode("elements").alias("el"))
    counts = each.groupBy(*keys, "el").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    place = Window.partitionBy(*keys, "of").orderBy(F.coalesce("df", F.lit(0)), "el")
    return each.join(counts, [*keys, "el"], "left").withColumn("at", F.row_number().over(place)).where("df is not null")


def hot_links(hot: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Candidates (a, b) among the records of hot signatures (sig, node), at least one path of them between any two that link.

    The hub of a signature is its record with the most hot signatures. E(x), what x differs from its hub h in, says all about pairs near a hub:
    x and y differ in as many elements as E(x) and E(y). Records that link to the hub are in one component, so one of a pair still
    asked for doesn't: |E(x)| > H(x, h). Then E(x) and E(y) must share (|E(x)| + |E(y)| - H(x, y)) / 2 > 0 elements, and the rare
    elements at the front of both, as many as this leaves, hold one of these. Near copies of one text thus aren't compared
    with each other unless they share rare edits. Records that are far from a hub are compared by the rare elements of their sets.
    """
    more, less = den + num, den - num
    degree = hot.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    hubs = hot.join(degree, "node").groupBy("sig").agg(F.max(F.struct("degree", "node")).alias("hub")).select("sig", F.col("hub.node").alias("hub"))
    star = hot.join(hubs, "sig").where("node != hub").select("hub", "node").distinct().join(degree.select(F.col("node").alias("hub"), "degree"), "hub")
    hub_sets = written(sets.select(F.col("node").alias("hub"), F.col("n").alias("n_h"), F.col("elements").alias("h")).join(_sent(*_counted(hubs.select("hub").distinct(), "hub-ids")), "hub", "left_semi"), "hub-sets")
    small = (hub_sets.agg(F.sum("n_h")).first()[0] or 0) <= BROADCAST_ELEMENTS
    full = sets.select("node", F.col("n").alias("n_x"), F.col("elements").alias("x")).join(_sent(*_counted(star, "star")), "node").join(F.broadcast(hub_sets) if small else hub_sets, "hub")
    apart = F.concat(F.array_except("x", "h"), F.array_except("h", "x"))
    full = full.select("hub", "degree", F.col("node").alias("of"), "n_x", "n_h", apart.alias("elements")).withColumn("e", F.size("elements").cast("long"))
    full = written(full.withColumn("linked", F.col("e") * more <= (F.col("n_x") + F.col("n_h")) * less).withColumn("near", F.col("e") * 2 <= F.col("n_x")).withColumn("elements", F.when(F.col("near"), F.col("elements"))), "hubs")
    links = full.where("linked").select(F.least("hub", "of").alias("a"), F.greatest("hub", "of").alias("b"))
    near = full.where("near")
    # places that the least number of shared elements leaves, for the record that doesn't link and for its partner
    own = f"e - greatest(ceil((e * {more} - (n_x + n_h) * {less}) / {2 * more}.0), 1) + 1"
    partner = f"e - greatest(ceil((e * {more} + (n_h - n_x) * {less} + 1) / {2 * more}.0), 1) + 1"
    # two records that have the same first hub are compared there alone
    main = near.groupBy("of").agg(F.max(F.struct("degree", "hub")).alias("main")).select("of", F.col("main.hub").alias("main"))
    places = near.join(main, "of").select("hub", "of", "main", F.expr(own).alias("own"), F.expr(partner).alias("partner"))
    rows = _ranked(near, ["hub"]).join(places, ["hub", "of"])
    x = rows.where("not linked and at <= own").select("hub", "el", F.col("of").alias("a"), F.col("main").alias("m_a"))
    y = rows.where("at <= partner").select("hub", "el", F.col("of").alias("b"), F.col("main").alias("m_b"))
    by_edits = x.join(y, ["hub", "el"]).where("a != b and (m_a != m_b or hub = m_a)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    far = full.where("not near").select("of").distinct()
    every = sets.join(_sent(*_counted(hot.select("node").distinct(), "hot-nodes")), "node").select(F.col("node").alias("of"), "n", "elements")
    front = _ranked(every, []).join(every.select("of", "n", F.expr(f"n - ceil(n * {num} / {den}.0) + 1").alias("take")), "of").where("at <= take").select("of", "n", "at", "el")
    front = written(front, "front")
    rare = front.join(far, "of").select("el", F.col("of").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a")).join(front.select("el", F.col("of").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b")), "el")
    # if this is the first element that the two share, no more than those behind it can follow
    rare = rare.where(f"a != b and {den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b) and (1 + least(n_a - at_a, n_b - at_b)) * {more} >= {num} * (n_a + n_b)")
    rare = rare.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return links.union(by_edits).union(rare).distinct()


def jaccard_components(df: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 5, num: int = 80, den: int = 100, into: str = "near") -> DataFrame:
    """df without its text, with a struct column `into`: n_shingles (set size), node (equal for equal sets) and component_id (the least
    doc_id reachable by links of similarity num/den or more, itself included).

    Null, empty and blank texts have an empty set, no links and themselves as component. Rows with a null id are
    in the component of their set, but are never its id. Repeated rows are documents of their own. Ties take the least id.
    """
    out = labelled(df.select(F.col(f"`{doc_id}`").alias("row"), F.col(f"`{text}`").alias("t")), n, num, den)
    return out.select("row", F.struct("n_shingles", "node", F.coalesce("component_id", "row").alias("component_id")).alias(into))


def labelled(base: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """base (row, t and others) without t, with n_shingles, node, component_id (null where no row has an id) and comp, equal for the rows
    of a component. The last two are null for empty sets."""
    small_batches(base.sparkSession)
    base, seed, bands = base.withColumn("tk", F.xxhash64("t")), 0, bands_for(num, den)
    rep = F.min(F.struct(F.col("row").isNull().alias("nameless"), "row", "tk")).alias("rep")
    while True:
        slim = written(slim_sets(base, n, seed), "sets")
        nodes = written(slim.where("n_shingles > 0").groupBy("node").agg(rep, F.min("second").alias("s0"), F.max("second").alias("s1"), F.min("n_shingles").alias("n"), F.max("n_shingles").alias("n1"), F.min("cells").alias("cells")), "nodes")
        if nodes.where("s0 != s1 or n != n1").limit(1).count() == 0:
            break
        discard(slim), discard(nodes)
        seed += 1
    # repeated rows may repeat a set
    repeats = slim.groupBy("row", "tk").count().where("count > 1").limit(1).count() > 0
    check = lambda pairs: verified(pairs, base, nodes, repeats, n, num, den)
    elements, = nodes.agg(F.sum("n")).first()
    parts = max(4, int((elements or 0) * 0.7) // HELD)
    shared = written(shared_entries(signature_rows(base.where("t is not null"), parts, n, seed, bands), parts), "shared")
    # first round: every record and the least of each of its signatures
    least = shared.groupBy("sig").agg(F.min("node").alias("a"))
    star = written(shared.join(least, "sig").where("node != a").select("a", F.col("node").alias("b")).distinct(), "star")
    links = check(star)
    labels = components(links)
    # second round: signatures that several components share
    known = shared.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    split = known.groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("k")).where("c0 != c1").select("sig", "k")
    open_ = written(known.join(split, "sig").join(nodes.select("node", "n"), "node"), "open")
    discard(shared)
    hot = open_.where(F.col("k") > HOT)
    unsafe = hot.groupBy("node", "below").agg(F.sum("weight").alias("passed"), F.min("slack").alias("slack")).where("passed > slack").select("node", "below")
    left = written(hot.join(unsafe, ["node", "below"], "left_semi"), "unsafe")
    again = left.groupBy("sig").agg(F.count(F.lit(1)).alias("k2"))
    left = left.join(again, "sig")
    few = open_.where(F.col("k") <= HOT).select("sig", "node", "comp", "n").union(left.where(F.col("k2") <= HOT).select("sig", "node", "comp", "n"))
    side = lambda x: few.select("sig", F.col("node").alias(x), F.col("comp").alias(f"c_{x}"), F.col("n").alias(f"n_{x}"))
    asked = side("a").join(side("b"), "sig").where(f"a < b and c_a != c_b and {den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)").select("a", "b").distinct()
    crowd = written(left.where(F.col("k2") > HOT).select("sig", "node", "comp").distinct(), "hot")
    if crowd.limit(1).count():
        texts = texts_of(crowd.select("node"), base, nodes, repeats)
        sets = written(elements_of(texts, n, seed), "elements")
        own = crowd.select("node", "comp").distinct()
        more = hot_links(crowd.select("sig", "node"), sets, num, den)
        more = more.join(own.select(F.col("node").alias("a"), F.col("comp").alias("c_a")), "a").join(own.select(F.col("node").alias("b"), F.col("comp").alias("c_b")), "b")
        asked = asked.union(more.where("c_a != c_b").select("a", "b")).distinct()
    asked = written(asked.join(star, ["a", "b"], "left_anti"), "asked")
    more = check(asked)
    if more.limit(1).count():
        discard(labels)
        links = written(links.union(more), "links")
        labels = components(links)
    full = nodes.select("node", F.col("rep.row").alias("rep")).join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = full.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = written(full.join(least, "comp").select("node", "component_id", "comp"), "named")
    for done in (star, links, labels, open_, left, crowd, asked, more, nodes):
        discard(done)
    return slim.drop("tk", "cells", "second").join(named, "node", "left")


def elements_of(texts: DataFrame, n: int, seed: int) -> DataFrame:
    """node, n, elements from node, t."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for node, x in zip(batch["node"], shingles(batch["t"].tolist(), n, seed)):
                s = distinct(x[0])
                rows.append((node, len(s), s.view(np.int64)))
                size += len(s)
                if size > HELD:
                    yield pd.DataFrame(rows, columns=["node", "n", "elements"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["node", "n", "elements"])

    return texts.mapInPandas(run, "node long, n long, elements array<long>")


def op2(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    out = jaccard_components(docs)
    return out.select(F.col("row").alias("doc_id"), "near.n_shingles", "near.component_id")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **params) -> DataFrame:
    """docs with one document of each component; documents without shingles stay. It is the one with the least id, null ids last; of rows
    with that id (or of null ids) the one with the least MD5 of id and text. Texts that aren't near copies each keep a row, whatever their ids."""
    key = fresh_name(docs, "key")
    row, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    # known for every row, null ids too: a digest of id and text
    marked = docs.withColumn(key, F.unhex(F.md5(F.concat(F.coalesce(row.cast("string"), F.lit("")), F.lit("|"), F.coalesce(t, F.lit(""))).cast("binary"))))
    near = labelled(marked.select(row.alias("row"), t.alias("t"), F.col(key).alias("key")), **params)
    first = F.min(F.struct(F.col("row").isNull().alias("nameless"), "row", "key")).alias("first")
    kept = written(near.where("n_shingles > 0").groupBy("comp").agg(first).select(F.col("first.key").alias(key)), "kept")
    blank = ~F.coalesce(t, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    once = marked.where(~blank).join(kept, key).dropDuplicates([key])
    return once.select(docs.columns).unionByName(docs.where(blank))


#: DuckDB's SQL for op2.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""
