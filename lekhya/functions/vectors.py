"""Hashed n-gram embeddings and cosine similarity."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from lekhya import fixed_values as fv
from lekhya.functions.text import TOKEN, py_tokens

DIM = fv.EMBEDDING_DIM
VOTES = T.StructType([T.StructField("words", T.ArrayType(T.IntegerType())),
                      T.StructField("ngrams", T.ArrayType(T.IntegerType()))])


@lru_cache(maxsize=1 << 18)
def _word_slot(word: str) -> tuple[int, int]:
    h = int(hashlib.md5(word.encode("utf-8")).hexdigest(), 16)
    return h % DIM, 1 if (h >> 8) & 1 == 0 else -1


@lru_cache(maxsize=1 << 18)
def _ngram_slot(gram: str) -> tuple[int, int]:
    h = int(hashlib.sha256(gram.encode("utf-8")).hexdigest()[:8], 16)
    return h % DIM, 1 if (h >> 4) & 1 == 0 else -1


def votes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Signed votes per dimension of words (with expansions) and of character 3-grams.

    Each distinct word or 3-gram is hashed once and counted, so cost follows the
    vocabulary of a text rather than its length.
    """
    by_word, by_gram = [0] * DIM, [0] * DIM  # lists add single numbers faster than arrays
    counts = Counter(py_tokens(text))
    for word, n in list(counts.items()):
        for other in fv.BILINGUAL_TERMS.get(word, ()):
            counts[other] += n
    for word, n in counts.items():
        slot, sign = _word_slot(word)
        by_word[slot] += sign * n
    lowered = (text or "").lower()
    grams = Counter([lowered[i:i + fv.NGRAM] for i in range(len(lowered) - fv.NGRAM + 1)])
    for gram, n in grams.items():
        slot, sign = _ngram_slot(gram)
        by_gram[slot] += sign * n
    return np.array(by_word, np.int32), np.array(by_gram, np.int32)


def embed(text: str | None) -> np.ndarray:
    """Unit-length embedding of one text."""
    by_word, by_gram = votes(text)
    vector = by_word + fv.NGRAM_WEIGHT * by_gram
    norm = np.sqrt((vector * vector).sum())
    return vector / norm if norm > 1e-6 else vector


_FIND_TOKENS = re.compile(TOKEN).findall
_ASCII_GRAMS = np.zeros(128 ** fv.NGRAM, np.int16)  # slot + 1 with its sign, 0 where not yet hashed


@lru_cache(maxsize=1 << 18)
def _word_votes(word: str) -> tuple[int, ...]:
    """Slots + 1, with their signs, of a word and its expansions; none of a single letter."""
    if len(word) == 1:
        return ()
    found = [_word_slot(w) for w in (word, *fv.BILINGUAL_TERMS.get(word, ()))]
    return tuple(sign * (slot + 1) for slot, sign in found)


def _added_up(rows: np.ndarray, signed: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows * DIM + np.abs(signed) - 1, np.sign(signed), n * DIM).reshape(n, DIM)


def _ascii_votes(lowered: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`votes` of lower-case ASCII texts, a row each.

    The 3-grams of all texts are looked up in one table; a new one is hashed once.
    """
    n = len(lowered)
    words = [_FIND_TOKENS(t) for t in lowered]
    each = [_word_votes(w) for w in chain.from_iterable(words)]
    rows = np.repeat(np.repeat(np.arange(n), [len(w) for w in words]), [len(e) for e in each])
    by_word = _added_up(rows, np.fromiter(chain.from_iterable(each), np.int64, len(rows)), n)
    codes = np.frombuffer("".join(lowered).encode("ascii"), np.uint8).astype(np.int32)
    rows = np.repeat(np.arange(n), [len(t) for t in lowered])
    last = max(len(codes) - fv.NGRAM + 1, 0)
    gram = np.zeros(last, np.int32)
    for i in range(fv.NGRAM):
        gram = gram * 128 + codes[i:i + last]
    inside = rows[:last] == rows[len(rows) - last:]
    gram, rows = gram[inside], rows[:last][inside]
    signed = _ASCII_GRAMS[gram]
    if not signed.all():
        for g in np.unique(gram[signed == 0]).tolist():
            text = "".join(chr(g >> 7 * i & 127) for i in reversed(range(fv.NGRAM)))
            slot, sign = _ngram_slot(text)
            _ASCII_GRAMS[g] = sign * (slot + 1)
        signed = _ASCII_GRAMS[gram]
    return by_word, _added_up(rows, signed.astype(np.int64), n)


def _blocks(sizes: list[int]):
    """Slices of at most 256 texts and some 256,000 characters, so arrays stay small."""
    begin = held = 0
    for i, size in enumerate(sizes):
        if i > begin and (i - begin == 256 or held + size > 1 << 18):
            yield begin, i
            begin, held = i, 0
        held += size
    if sizes:
        yield begin, len(sizes)


def embed_all(texts: list[str | None]) -> np.ndarray:
    """:func:`embed` of every text, a row each; ASCII texts together."""
    out = np.zeros((len(texts), DIM))
    plain = []
    for i, text in enumerate(texts):
        low = (text or "").lower()
        if low.isascii():
            plain.append((i, low))
        else:
            out[i] = embed(text)
    for a, b in _blocks([len(low) for _, low in plain]):
        by_word, by_gram = _ascii_votes([low for _, low in plain[a:b]])
        vectors = by_word + fv.NGRAM_WEIGHT * by_gram
        norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        out[[i for i, _ in plain[a:b]]] = vectors / np.where(norms > 1e-6, norms, 1.0)
    return out


@F.pandas_udf(VOTES)
def embedding_votes(texts: pd.Series) -> pd.DataFrame:
    pairs = [votes(t) for t in texts]
    return pd.DataFrame({"words": [w for w, _ in pairs], "ngrams": [g for _, g in pairs]})


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def embedding(texts: pd.Series) -> pd.Series:
    return pd.Series(list(embed_all(texts.tolist())))


def similarity_to(queries: list[np.ndarray]):
    """A function of (text, stored vector) giving one clamped cosine per query vector.

    The stored vector wins over one computed from the text.  A vector of another
    length scores 0.  The queries are a request batch, so the matrix is small.
    """
    matrix = np.array(queries, dtype=np.float64).reshape(len(queries), DIM)
    norms = np.sqrt((matrix * matrix).sum(axis=1))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def similarities(texts: pd.Series, stored: pd.Series) -> pd.Series:
        bare = np.array([v is None or len(v) == 0 for v in stored], bool)
        out = np.zeros((len(texts), len(matrix)))
        made = embed_all(texts[bare].tolist())
        vectors = iter(made)
        for i, v in enumerate(stored):
            v = next(vectors) if bare[i] else np.asarray(v, float)
            if len(v) == DIM:
                out[i] = matrix @ v
        sizes = np.zeros(len(texts))
        sizes[bare] = np.sqrt((made * made).sum(axis=1))
        for i in np.flatnonzero(~bare):
            v = np.asarray(stored.iloc[i], float)
            sizes[i] = np.sqrt((v * v).sum()) if len(v) == DIM else 0.0
        used = (sizes[:, None] > 1e-6) & (norms > 1e-6)
        out = np.where(used, out / np.where(used, norms * sizes[:, None], 1.0), 0.0)
        return pd.Series(list(np.clip(out, 0.0, 1.0)))

    return similarities


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to [0, 1]; 0 for missing, empty, unequal or near-zero vectors."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (na > 1e-6) & (nb > 1e-6)
    raw = dot(a, b) / F.nullif(na * nb, F.lit(0.0))
    return F.when(F.coalesce(usable, F.lit(False)),
                  F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).otherwise(F.lit(0.0))
