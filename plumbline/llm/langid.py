"""Language identification by a byte convolutional network, trained in numpy.

Filters of several widths run over embedded bytes, each is max-pooled over a window of fixed length,
and a softmax layer gives the languages' probabilities. A text is cut into windows from its start to
its end; its probabilities are the means over its windows, weighted by their bytes. For prediction
the embedding and the filters are folded into tables by byte pair, so a window costs three lookups
per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fresh_name, held_out, small_batches

UNKNOWN = "und"
WIDTHS = (2, 3, 4)
#: Bytes of ASCII capitals count as their small letters.
FOLD = bytes(range(256)).lower()
LETTER = regex.compile(r"\p{L}").search
#: Windows that are convolved at once: bounds a worker's memory, whatever the length of a text.
AT_ONCE = 1024


@dataclass
class Model:
    langs: list[str]
    length: int
    embedding: np.ndarray  # 256 x E
    filters: list[np.ndarray]  # width x E x K
    bias: np.ndarray  # of all filters
    dense: np.ndarray  # filters x languages
    dense_bias: np.ndarray

    def tables(self) -> "Tables":
        by_byte = [np.einsum("be,wek->wbk", self.embedding, f).astype("f4") for f in self.filters]
        two, three, four = by_byte
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        here = np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1])], axis=1)
        return Tables(self, here, three[2], pair(four[2], four[3]))


@dataclass
class Tables:
    model: Model
    here: np.ndarray  # what a byte and the next add to the filters of each width that start there
    third: np.ndarray  # what the byte after them adds to those of width 3
    last: np.ndarray  # what the pair after them adds to those of width 4

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Of each row of bytes."""
        out = []
        for x in (windows[i : i + 64] for i in range(0, len(windows), 64)):
            pairs = x[:, :-1].astype(np.intp) * 256 + x[:, 1:]
            conv = self.here.take(pairs, axis=0)
            k = conv.shape[2] // len(WIDTHS)
            conv[:, :-1, k : 2 * k] += self.third.take(x[:, 2:], axis=0)
            conv[:, :-2, 2 * k :] += self.last.take(pairs[:, 2:], axis=0)
            best = [conv[:, :, :k].max(axis=1), conv[:, :-1, k : 2 * k].max(axis=1), conv[:, :-2, 2 * k :].max(axis=1)]
            h = np.maximum(np.concatenate(best, axis=1) + self.model.bias, 0)
            out.append(softmax(h @ self.model.dense + self.model.dense_bias))
        return np.concatenate(out)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its probability. A text that is null or has no letter: und, 0."""
        n, sums, weights = self.model.length, np.zeros((len(texts), len(self.model.langs))), np.zeros(len(texts))
        rows, owners, sizes = [], [], []

        def flush() -> None:
            if rows:
                w = np.array(sizes, dtype="f8")
                p = self.probabilities(np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, n))
                np.add.at(sums, owners, p * w[:, None])
                np.add.at(weights, owners, w)
                rows.clear(), owners.clear(), sizes.clear()

        for i, text in enumerate(texts):
            if text is None or not LETTER(text):
                continue
            data = text.encode("utf-8").translate(FOLD)
            for at in range(0, len(data), n):
                part = data[at : at + n]
                rows.append(part.ljust(n, b"\0"))
                owners.append(i)
                sizes.append(len(part))
                if len(rows) == AT_ONCE:
                    flush()
        flush()
        out = []
        for s, w in zip(sums, weights):
            k = int(s.argmax()) if w else -1
            out.append((self.model.langs[k], min(1.0, float(s[k] / w))) if w else (UNKNOWN, 0.0))
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut(data: bytes, n: int, length: int, seed: int) -> list[bytes]:
    """n windows at random places of a text, so that none of its parts is preferred; two of five are shorter, as short texts are padded."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        at = int(rng.integers(0, max(1, len(data) - length // 2)))
        size = length if rng.random() < 0.6 else int(rng.integers(12, length))
        out.append(data[at : at + size])
    return out


def train(texts: list[str], langs: list[str], length: int = 256, windows_per_text: int = 3, seed: int = 7, **params) -> Model | None:
    """From windows of the texts."""
    pairs = [(la, w) for i, (t, la) in enumerate(zip(texts, langs)) for w in cut(t.encode("utf-8").translate(FOLD), windows_per_text, length, seed + i)]
    return train_on(pairs, length=length, seed=seed, **params)


def train_on(pairs: list[tuple[str, bytes]], length: int = 256, filters: int = 8, dim: int = 8, steps: int = 900, batch: int = 64, seed: int = 7) -> Model | None:
    """By Adam on cross-entropy over windows (language, bytes). The same windows in the same order give the same model; none give none."""
    rng = np.random.default_rng(seed)
    names = sorted({la for la, _ in pairs})
    windows, labels = [w.ljust(length, b"\0") for _, w in pairs], [names.index(la) for la, _ in pairs]
    if not names:
        return None
    x, y = np.frombuffer(b"".join(windows), dtype=np.uint8).reshape(-1, length), np.array(labels)
    p = {"emb": rng.normal(0, 0.3, (256, dim)), "bias": np.zeros(filters * len(WIDTHS)), "dense": rng.normal(0, 0.3, (filters * len(WIDTHS), len(names))), "dense_bias": np.zeros(len(names))}
    p |= {f"w{w}": rng.normal(0, 0.4, (w, dim, filters)) for w in WIDTHS}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    # each language is drawn equally often
    by_lang = [np.flatnonzero(y == k) for k in range(len(names))]
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(by_lang[k]) for k in rng.integers(0, len(names), batch)])
        xb, yb = x[pick], y[pick]
        e = p["emb"][xb]
        pooled, where = [], []
        for w in WIDTHS:
            conv = sum(e[:, j : length - w + 1 + j] @ p[f"w{w}"][j] for j in range(w))
            where.append(conv.argmax(axis=1))
            pooled.append(np.take_along_axis(conv, where[-1][:, None, :], axis=1)[:, 0])
        pre = np.concatenate(pooled, axis=1) + p["bias"]
        h = np.maximum(pre, 0)
        d = softmax(h @ p["dense"] + p["dense_bias"])
        d[np.arange(batch), yb] -= 1
        d /= batch
        g = {"dense": h.T @ d, "dense_bias": d.sum(axis=0)}
        back = (d @ p["dense"].T) * (pre > 0)
        g["bias"] = back.sum(axis=0)
        g["emb"] = np.zeros_like(p["emb"])
        for i, w in enumerate(WIDTHS):
            own, at = back[:, i * filters : (i + 1) * filters], where[i]
            g[f"w{w}"] = np.zeros_like(p[f"w{w}"])
            for j in range(w):
                seen = np.take_along_axis(xb, at + j, axis=1)  # batch x filters
                g[f"w{w}"][j] = np.einsum("bfe,bf->ef", p["emb"][seen], own)
                np.add.at(g["emb"], seen.ravel(), (own[:, :, None] * p[f"w{w}"][j].T[None]).reshape(-1, dim))
        rate = 0.02 * (0.5 if step > steps * 0.6 else 1) * (0.4 if step > steps * 0.85 else 1)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Model(names, length, p["emb"].astype("f4"), [p[f"w{w}"].astype("f4") for w in WIDTHS], p["bias"].astype("f4"), p["dense"].astype("f4"), p["dense_bias"].astype("f4"))


def windows(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = 2000, windows_per_text: int = 3, length: int = 256) -> list[tuple[str, bytes]]:
    """Windows of at most `sample` labelled documents (null languages and texts and held-out documents
    are left out), those whose ids have the least hashes: a bounded sample that does not depend on the
    order or the partitions of the rows. The ids are chosen first and the executors cut the windows, so no more than sample * windows_per_text
    * length bytes reach the driver. Of repeated ids the rows after the first in text order are not used."""
    known = docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l"))
    known = known.where(F.col("i").isNotNull() & F.col("l").isNotNull() & F.col("t").isNotNull() & ~held_out("i"))
    chosen = known.select("i", F.xxhash64("i").alias("h")).distinct().orderBy("h", "i").limit(sample).select("i")
    first = known.join(F.broadcast(chosen), "i", "left_semi").groupBy("i").agg(F.min(F.struct("t", "l")).alias("r")).select("i", "r.t", "r.l", F.xxhash64("i").alias("h"))

    @F.pandas_udf("array<binary>")
    def run(texts: pd.Series, seeds: pd.Series) -> pd.Series:
        return pd.Series([cut(t.encode("utf-8").translate(FOLD), windows_per_text, length, h & 0x7FFFFFFF) for t, h in zip(texts, seeds)])

    rows = first.select("i", "l", run("t", "h").alias("w")).orderBy("i").collect()
    return [(r["l"], bytes(w)) for r in rows for w in r["w"]]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = 2000, windows_per_text: int = 3, length: int = 256, **params) -> Model | None:
    """Learns from `windows_per_text` windows of each of at most `sample` documents."""
    small_batches(docs.sparkSession)
    return train_on(windows(docs, text, lang, doc_id, sample, windows_per_text, length), length=length, **params)


def with_language(df: DataFrame, model: Model | None, text: str = "text", into: str = "language") -> DataFrame:
    """df with a struct column `into`: lang (a learned language, und for null texts and texts without
    a letter) and score (its probability, 0 for und). Rows and other columns stay as they are; an
    existing column named as `into` is replaced. Without a model (nothing to learn from) all is und."""
    if model is None:
        return df.withColumn(into, F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score")))
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = shared.value.tables()
        for batch in texts:
            yield pd.DataFrame(tables.predict(batch.tolist()), columns=["lang", "score"])

    return df.withColumn(into, run(F.col(f"`{text}`")))


def op4(docs: DataFrame, **params) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document. A null or empty text, or one without a letter, is und with score 0; equal probabilities give
    the first language by name; repeated rows are predicted each. Very long texts are read to their end, in windows. An empty table gives an empty result."""
    small_batches(docs.sparkSession)
    own = docs.select("doc_id", "text")
    into = fresh_name(own, "language")
    out = with_language(own, fit(docs, **params), into=into)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col(f"{into}.lang").alias("lang_pred"), F.col(f"{into}.score").alias("score"))


def without_rejected(docs: DataFrame, least: float = 0.4, **params) -> DataFrame:
    """The documents whose language is told: those that are und, or whose best language has a
    probability under `least`, go. Without a model (nothing to learn from) only null texts and texts without a letter go. The columns
    are those of docs."""
    into = fresh_name(docs, "language")
    model = fit(docs, **params)
    if model is None:
        return docs.where(F.coalesce(F.col(f"`{params.get('text', 'text')}`"), F.lit("")).rlike(r"\p{L}"))
    out = with_language(docs, model, into=into)
    return out.where((F.col(f"{into}.lang") != UNKNOWN) & (F.col(f"{into}.score") >= least)).select(docs.columns)
