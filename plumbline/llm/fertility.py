"""Quality rules by tokeniser fertility.

Public vocabularies measure, over the whole text, characters per token, the share of tokens that are bytes
and the entropy of the tokens: a vocabulary of pieces with byte fallback, and a byte-level one for many languages. Each script
has bands, and so have languages with labelled documents; a text outside them is rejected. The base rules (length, repeated
words) come first.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, fresh_name, small_batches

match_words = re.compile(WORD).findall
#: White space to str.split() that is part of words here.
odd_space = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
beyond_latin = re.compile("[^\x00-\u024f]").search
SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "
#: Words kept with their tokens by each worker; beyond that the memory starts anew.
REMEMBERED = 500_000


@dataclass(frozen=True)
class Band:
    """A text is kept while its measures lie in the band (ends included)."""

    least_chars_per_token: float
    most_chars_per_token: float
    most_byte_share: float
    least_entropy: tuple[float, ...]  # bits, of texts with at least 100, 200, 400, … tokens; the last for all longer ones
    least_second: float = 0.0  # characters per token and byte share under the second vocabulary
    most_second_byte_share: float = 1.0


#: Entropy grows with a text's length, so its floors do.
FLOORS = (5.56, 5.88, 6.19, 6.40, 6.52, 6.62)


def _language(least_chars_per_token: float, shift: float, least_second: float, most_second_byte_share: float) -> Band:
    return Band(least_chars_per_token, 8.0, 0.05, tuple(round(f + shift, 2) for f in FLOORS), least_second, most_second_byte_share)


#: Rejection bands by language, for texts in Latin letters whose language is given, and by script otherwise. A text's
#: script is that of most of its letters, "none" without letters. The floors of the four languages are the 0.5 % quantiles of the 2,573 documents
#: of sf0.1 that have quality 1, pass the base rules and aren't held out, and so is the least of characters per token; the most of byte shares under the second
#: vocabulary is 1.25 times their 99.5 % quantile, a hundredth at least; bounds of Latin are the loosest of the four. No labels are
#: there for the rest: their byte shares lie above those of sentences in Arabic, Hebrew, Devanagari, Thai, Kana, Hangul, Georgian,
#: Armenian, Tamil, Burmese and Ethiopic letters (0 to 0.83), and of numbers and emoji (0 to 0.29). What is nearly all bytes can't be judged and goes.
BANDS = {
    "en": _language(2.037, 0.14, 2.111, 0.010),
    "de": _language(2.105, 0.0, 2.179, 0.033),
    "es": _language(1.808, -0.06, 1.927, 0.026),
    "fr": _language(1.797, -0.02, 1.895, 0.011),
    "Latin": _language(1.45, -0.06, 1.45, 0.15),
    "Cyrillic": Band(1.2, 8.0, 0.10, (4.0,)),
    "Greek": Band(0.7, 8.0, 0.30, (4.0,)),
    "Han": Band(0.3, 8.0, 0.80, (4.0,)),
    "other": Band(0.2, 12.0, 0.90, (3.5,)),
    "none": Band(0.2, 12.0, 0.50, (3.0,)),
}
SCRIPTS = {name: regex.compile(rf"\p{{{name}}}").findall for name in ("Cyrillic", "Greek", "Han")}
LATIN = regex.compile(r"\p{Latin}").findall
LETTERS = regex.compile(r"\p{L}").findall
ENTROPY_FROM = 100
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)

MEASURES = ("n_tokens", "chars_per_token", "byte_share", "token_entropy")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def find_words(text: str) -> list[str]:
    return match_words(text) if odd_space(text) else text.split()


def base_measures(text: str, words: list[str]) -> tuple[int, int, int, int, int]:
    lines = [x for x in text.split("\n") if x.strip(SPACES)] if "\n" in text else []
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of three words that occurs twice or more."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mixed = np.sort(h[:-2] * MIX[0] ^ h[1:-1] * MIX[1] + h[2:] * MIX[2])
    if not (mixed[1:] == mixed[:-1]).any():  # equal windows would have equal sums
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    often = np.fromiter((seen[w] > 1 for w in windows), dtype=bool, count=len(windows))
    mark = np.zeros(len(words), dtype=bool)
    for k in range(3):
        mark[k : k + len(windows)] |= often
    return int(mark.sum())


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def script_of(text: str) -> str:
    if not beyond_latin(text):
        return "Latin" if any(map(str.isalpha, text)) else "none"
    n = len(LETTERS(text))
    if not n:
        return "none"
    if 2 * len(LATIN(text)) >= n > 0:
        return "Latin"
    for name, find in SCRIPTS.items():
        if 2 * len(find(text)) >= n > 0:
            return name
    return "other"


class Tokens(dict):
    """Ids of words under all vocabularies, made when first asked for; those of a later one come after all of the ones before."""

    def __init__(self, encoders):
        super().__init__()
        self.encoders = encoders

    def __missing__(self, word: str) -> bytes:
        ids = array("I", [first + i for encode, first in self.encoders for i in encode(word)]).tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


def pieces(model: bytes):
    """Encoder, size and byte tokens of a vocabulary of pieces with byte fallback."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    return own.encode, own.vocab_size(), np.array([own.is_byte(i) for i in range(own.vocab_size())])


def byte_level(ranks: bytes):
    """The same of a byte-level vocabulary, from a line for each token: the token in base 64, its rank. Byte tokens are
    those that hold part of a character."""
    import public_tokenizers
    import tiktoken

    own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})
    is_byte = np.zeros(max(own.values()) + 1, dtype=bool)
    for token, i in own.items():
        is_byte[i] = "\ufffd" in token.decode("utf-8", "replace")
    return lambda word: encoding.encode_ordinary(" " + word), len(is_byte), is_byte


class Fertility:
    """Tokens of words under a vocabulary with byte fallback and, if given, a byte-level one. No token crosses white space, so
    words are encoded one by one and remembered."""

    def __init__(self, model: bytes, ranks: bytes | None = None):
        own = [pieces(model)] + ([byte_level(ranks)] if ranks else [])
        self.starts = np.cumsum([0] + [size for _, size, _ in own])
        self.is_byte = np.concatenate([x for _, _, x in own])
        self.tokens = Tokens([(encode, start) for (encode, _, _), start in zip(own, self.starts.tolist())])

    def every(self, words: list[str], chars: int) -> list[tuple[int, float, float, float]]:
        """For each vocabulary: tokens, characters per token, share of byte tokens, entropy in bits. Without words: zeros."""
        ids = np.frombuffer(b"".join(map(self.tokens.__getitem__, words)), dtype=np.uint32)
        each, count = np.unique(ids, return_counts=True)
        out = []
        for a, b in zip(np.searchsorted(each, self.starts), np.searchsorted(each, self.starts)[1:]):
            n = int(count[a:b].sum())
            share = count[a:b] / max(n, 1)
            out.append((n, chars / n, float(share[self.is_byte[each[a:b]]].sum()), float(-(share * np.log2(share)).sum()) + 0.0) if n else (0, 0.0, 0.0, 0.0))
        return out

    def measures(self, words: list[str], chars: int) -> tuple[int, float, float, float]:
        return self.every(words, chars)[0]


_loaded: dict[str, Fertility] = {}


def loaded(model: bytes, ranks: bytes | None) -> Fertility:
    key = hashlib.sha256(model + b"|" + (ranks or b"")).hexdigest()
    if key not in _loaded:
        _loaded[key] = Fertility(model, ranks)
    return _loaded[key]


def within(script: str, tokens: int, chars_per_token: float, byte_share: float, entropy: float, bands: dict[str, Band], lang: str | None = None, second: tuple[int, float, float, float] | None = None) -> bool:
    """Whether a text's measures, those of the second vocabulary too if there is one, lie in its band."""
    band = bands[lang] if script == "Latin" and lang in bands else bands.get(script, bands["other"])
    if not (band.least_chars_per_token <= chars_per_token <= band.most_chars_per_token and byte_share <= band.most_byte_share):
        return False
    if second and second[0] and (second[1] < band.least_second or second[2] > band.most_second_byte_share):
        return False
    at = min((tokens // ENTROPY_FROM).bit_length(), len(band.least_entropy)) - 1
    return at < 0 or entropy >= band.least_entropy[at]


def with_measures(df: DataFrame, vocabulary_path: str, text: str = "text", into: str = "fertility", bands: dict[str, Band] | None = None, lang: str | None = None, second_path: str | None = None) -> DataFrame:
    """df with a struct column `into`: the five base measures, script, n_tokens, chars_per_token,
    byte_share, token_entropy, those under the second vocabulary if there is one (second_…), base_failed and kept.

    `lang` names the column of the language, if there is one; where it is null or has no band, the script decides.
    A null text counts as empty: no words, so it fails the base rules. Rows and other columns stay, repeated rows too, each measured
    by itself; a column named as `into` is replaced. An empty table gives an empty result. A measure on the edge of a band is in it. Very long
    texts are measured whole. The vocabularies (files of fixed size) are read on the driver and broadcast."""
    small_batches(df.sparkSession)
    files = []
    for path in (vocabulary_path, second_path):
        if path:
            with open(path, "rb") as f:
                files.append(f.read())
    shared = df.sparkSession.sparkContext.broadcast(files)
    bands = bands or BANDS
    with_second = len(files) > 1
    measured = [*MEASURES, *(f"second_{m}" for m in MEASURES)] if with_second else MEASURES
    names = [*BASE, "script", *measured, "base_failed", "kept"]
    kinds = ["long"] * len(BASE) + ["string"] + ["long", "double", "double", "double"] * (1 + with_second) + ["boolean"] * 2

    @F.pandas_udf(", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    def run(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        fertility = loaded(*shared.value, *[None] * (not with_second))
        for batch, langs in texts:
            rows = []
            for t, la in zip(batch, langs):
                t = t or ""
                words = find_words(t)
                base = base_measures(t, words)
                own, *second = fertility.every(words, base[1])
                script, failed = script_of(t), base_fails(base[0], base[4])
                rows.append((*base, script, *own, *(x for s in second for x in s), failed, not failed and within(script, *own, bands, la, *second)))
            yield pd.DataFrame(rows, columns=names)

    return df.withColumn(into, run(F.col(f"`{text}`"), F.col(f"`{lang}`") if lang else F.lit(None).cast("string")))


def op9(docs: DataFrame, vocabulary_path: str, second_path: str | None = None) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, and the fertility measures, of every document."""
    own = docs.select("doc_id", "text", "lang")
    into = fresh_name(own, "fertility")
    out = with_measures(own, vocabulary_path, into=into, lang="lang", second_path=second_path)
    more = [f"second_{m}" for m in MEASURES] if second_path else []
    return out.select("doc_id", *(f"{into}.{n}" for n in (*BASE, "base_failed", "kept", "script", *MEASURES, *more)))
