"""Byte-level BPE encoding and decoding over a contiguous rank array.

A word is held as a list of part ids with, beside it, the rank of each pair of neighbours. The
least rank is found by a scan, its boundary deleted and the two neighbouring ranks refreshed,
until no pair has a rank. That is quadratic, so words of over SHORT bytes (rare: lines without
spaces) take a heap over a linked list, with the same order of merges.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import fresh_name, small_batches

#: The pattern that splits text before byte-level merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: No word crosses a lone space between two other characters; it belongs to what follows it.
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
OTHER_SPACE = re.compile(r" (?:\s|\Z)|\s ").search
SHORT = 64
NONE = 1 << 30
#: Words kept with their ids by each worker (about 200 bytes each); beyond that the memory starts anew.
REMEMBERED = 150_000
#: Ids that a worker holds before it sends them on.
HELD = 1_000_000


def byte_characters() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable Latin-1 bytes stand
    for themselves, the others for the characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Remembered(dict):
    """Ids of strings, as little-endian 32-bit integers, made when first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class ByteBpe:
    """From the JSON of a tokenizer with a byte-level BPE model."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        model, chars = spec["model"], byte_characters()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("not a byte-level BPE vocabulary")
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        tokens = {i: bytes(chars[c] for c in t) for t, i in ids.items()} | {i: s.encode("utf-8") for s, i in self.special.items()}
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.of_byte = [ids[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.find = regex.compile(SPLIT).findall
        self.words = Remembered(self.merge)
        self.spaced = Remembered(lambda x: b"".join(map(self.words.__getitem__, self.find(" " + x))))

    def merge(self, word: str) -> bytes:
        parts = [self.of_byte[b] for b in word.encode("utf-8")]
        return np.asarray(self.merge_long(parts) if len(parts) > SHORT else self.merge_short(parts), dtype="<u4").tobytes()

    def merge_short(self, parts: list[int]) -> list[int]:
        merges, nothing = self.merges, (NONE, -1)
        ranks = [merges.get(pair, nothing)[0] for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = merges[parts[i], parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = merges.get((parts[i - 1], parts[i]), nothing)[0]
            if i < len(ranks):
                ranks[i] = merges.get((parts[i], parts[i + 1]), nothing)[0]
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        merges, n = self.merges, len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m[0], i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (m := merges.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = merges[a, b][1], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := merges.get((parts[x], parts[y]))):
                    heapq.heappush(heap, (m[0], x, parts[x], parts[y]))
        return [p for p, ok in zip(parts, alive) if ok]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Special tokens' strings are those tokens."""
        if not self.special_split or not any(s in text for s in self.special):
            return self.encode_plain(text)
        out = []
        for piece in self.special_split.split(text):
            own = self.special.get(piece)
            out.append(self.encode_plain(piece) if own is None else own.to_bytes(4, "little"))
        return b"".join(out)

    def encode_plain(self, text: str) -> bytes:
        parts = LONE_SPACE.split(text) if text.startswith(" ") or OTHER_SPACE(text) else text.split(" ")
        return b"".join(map(self.words.__getitem__, self.find(parts[0]))) + b"".join(map(self.spaced.__getitem__, parts[1:]))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[str, ByteBpe] = {}


def loaded(vocabulary: str) -> ByteBpe:
    """One for each worker process, whose remembered words last over its tasks."""
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = ByteBpe(vocabulary)
    return _loaded[key]


def with_tokens(df: DataFrame, vocabulary_path: str, text: str = "text", into: str = "bpe", ids: bool = True, decoded: bool = True) -> DataFrame:
    """df with a struct column `into`: n_tokens long, ids_sha256, and if asked for ids array<int>, decoded (the text from
    the ids) and in any case decoded_sha256.

    A null text counts as empty: no ids, decoded to the empty text. Repeated rows stay; other
    columns pass through; a column that is named as `into` is replaced. The vocabulary is read on the
    driver and broadcast: it is a file of fixed size. An empty table gives an empty result. A very long text is a row like
    others: a worker holds its ids and no more than HELD ids of other texts.
    """
    small_batches(df.sparkSession)
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded

    @F.pandas_udf(fields)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = loaded(shared.value)
        names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids + ["decoded"] * decoded
        for batch in texts:
            rows, held = [], 0
            for t in batch:
                got = bpe.encode(t or "")
                back = bpe.decode(got)
                row = [len(got) // 4, hashlib.sha256(got).hexdigest(), hashlib.sha256(back.encode("utf-8")).hexdigest()]
                rows.append(row + [np.frombuffer(got, dtype="<i4")] * ids + [back] * decoded)
                held += len(got) // 4
                if held > HELD:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    return df.withColumn(into, run(F.col(f"`{text}`")))


def op3(spark: SparkSession, docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    own = docs.select("doc_id", "text")
    into = fresh_name(own, "bpe")
    return with_tokens(own, vocabulary_path, into=into, ids=False, decoded=False).select("doc_id", f"{into}.n_tokens", f"{into}.ids_sha256", f"{into}.decoded_sha256")
