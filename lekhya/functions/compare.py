"""Text comparison: error rates, exact match and similarity."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from lekhya.functions.text import SPACES, nfc, strip, text_or_empty


SHORT = 512   # below this a band saves nothing
BLOCK = 4096  # steps for which the places of characters are cut out once
_WORD = re.compile(f"[^{SPACES}]+")


def _places(items: np.ndarray, wanted: np.ndarray) -> dict[int, int]:
    """For each wanted value that occurs, the places where, as bits of a number."""
    return {int(v): int.from_bytes(np.packbits(items == v, bitorder="little"), "little")
            for v in np.intersect1d(items, wanted)}


def _whole(long: np.ndarray, short: np.ndarray) -> int:
    """Edits from one table whose columns are numbers of len(long) bits (vertical differences)."""
    places, m = _places(long, short), len(long)
    full = (1 << m) - 1
    up, down = full, 0
    for c in short.tolist():
        x = places.get(c, 0)
        level = ((((x & up) + up) ^ up) | x | down) & full
        plus = (down | (full ^ (level | up))) << 1 | 1
        minus = (level & up) << 1
        down = level & plus
        up = (minus | (full ^ ((level | plus) & full))) & full
    return len(short) + up.bit_count() - down.bit_count()


def _banded(long: np.ndarray, short: np.ndarray, most: int) -> tuple[int, int]:
    """Edits if there are at most ``most``, else a larger number, and the columns looked at.

    As :func:`_whole`, for the 2 * most + 1 diagonals around the main one; the window of bits
    moves down by one row with every column.  Values never fall along a diagonal, so that which
    ends in the last cell is followed, and given up where it exceeds ``most``.
    """
    width, lead = 2 * most + 1, len(long) - len(short)
    full, at, score = (1 << width) - 1, most + lead, lead
    up, down = full ^ ((1 << most) - 1), 0
    padded = np.concatenate([np.full(most, -1, long.dtype), long,
                             np.full(most + 1, -1, long.dtype)])
    for start in range(0, len(short), BLOCK):
        part = short[start:start + BLOCK]
        places = _places(padded[start:start + width + len(part)], part)
        for k, c in enumerate(part.tolist()):
            x = (places.get(c, 0) >> k) & full
            level = ((((x & up) + up) ^ up) | x | down) & full
            plus = down | (full ^ (level | up))
            minus = level & up
            if not level >> at & 1:
                score += 1
                if score > most:
                    return score, start + k + 1
            level >>= 1
            up = minus | (full ^ (level | plus))
            down = level & plus
    return score, len(short)


def _edits(a: np.ndarray, b: np.ndarray) -> int:
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    n = len(short)
    differ = np.flatnonzero(long[:n] != short)
    first = int(differ[0]) if len(differ) else n
    long, short = long[first:], short[first:]
    n = len(short)
    differ = np.flatnonzero(long[len(long) - n:] != short)
    tail = n - 1 - int(differ[-1]) if len(differ) else n
    long, short = long[:len(long) - tail], short[:n - tail]
    if not len(short):
        return len(long)
    most = max(64, 2 * (len(long) - len(short)))
    while len(long) > SHORT and 4 * most < len(long):
        score, looked = _banded(long, short, most)
        if score <= most:
            return score
        # as many as there are if the rest differs as much, and some more
        most = max(2 * most, 5 * score * len(short) // (4 * looked))
    return _whole(long, short)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)


def py_edits(a: str, b: str) -> int:
    """Levenshtein distance of two texts over code points, exactly, 64 and more cells a step."""
    return 0 if a == b else _edits(_points(a), _points(b))


def py_word_edits(a: list[str], b: list[str]) -> int:
    """Levenshtein distance of two lists of words."""
    names: dict[str, int] = {}
    return _edits(*[np.array([names.setdefault(w, len(names)) for w in ws], np.int32)
                    for ws in (a, b)])


def _integers(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.IntegerType()) for n in names.split()])


def _nfc(text: str | None) -> str:
    return unicodedata.normalize("NFC", text or "")


@F.pandas_udf(T.IntegerType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edits between two texts; null where one is null."""
    return pd.Series([None if x is None or y is None else py_edits(x, y) for x, y in zip(a, b)],
                     dtype="Int32")


def _agreeing(a: str, b: str) -> int:
    """Places at which two texts have the same character."""
    n = min(len(a), len(b))
    return n if a[:n] == b[:n] else int((_points(a)[:n] == _points(b)[:n]).sum())


@F.pandas_udf(_integers("edits size"))
def _characters(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    pairs = [(_nfc(r), _nfc(h)) for r, h in zip(reference, hypothesis)]
    return pd.DataFrame({"edits": [py_edits(r, h) for r, h in pairs],
                         "size": [len(r) for r, _ in pairs]}, dtype="int32")


@F.pandas_udf(_integers("edits size other same"))
def _readings(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    pairs = [(_nfc(r), _nfc(h)) for r, h in zip(reference, hypothesis)]
    return pd.DataFrame([(py_edits(r, h), len(r), len(h), _agreeing(r, h)) for r, h in pairs],
                        columns=["edits", "size", "other", "same"], dtype="int32")


@F.pandas_udf(_integers("edits size other"))
def _words(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    pairs = [(_WORD.findall(r or ""), _WORD.findall(h or ""))
             for r, h in zip(reference, hypothesis)]
    return pd.DataFrame([(py_word_edits(r, h), len(r), len(h)) for r, h in pairs],
                        columns=["edits", "size", "other"], dtype="int32")


@F.pandas_udf(_integers("edits size trimmed r h word_edits words other"))
def _rates(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    rows = []
    for reference_, hypothesis_ in zip(reference, hypothesis):
        ref, hyp = _nfc(reference_), _nfc(hypothesis_)
        r, h = ref.strip(SPACES), hyp.strip(SPACES)
        edits = py_edits(ref, hyp)
        # texts without outer spaces are the same trimmed, so one distance serves both rates
        trimmed = edits if len(r) == len(ref) and len(h) == len(hyp) else py_edits(r, h)
        ws, os = _WORD.findall(reference_ or ""), _WORD.findall(hypothesis_ or "")
        rows.append((edits, len(ref), trimmed, len(r), len(h), py_word_edits(ws, os), len(ws), len(os)))
    return pd.DataFrame(rows, columns=["edits", "size", "trimmed", "r", "h", "word_edits", "words",
                                       "other"], dtype="int32")


def _rate(edits: Column, size: Column) -> Column:
    return F.coalesce(edits / F.nullif(size, F.lit(0)), F.lit(0.0))


def _rounded(edits: Column, size: Column, other: Column) -> Column:
    rate = F.round(edits / F.nullif(size, F.lit(0)), 4)
    return F.coalesce(rate, F.when(other == 0, 0.0).otherwise(1.0))


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character error rate, unrounded; an empty reference scores 0."""
    found = _characters(reference, hypothesis)
    return _rate(found["edits"], found["size"])


def with_error_rates(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Add ``cer``, ``cer_rounded`` and ``wer`` of two text columns, in one pass of the texts."""
    x = df.withColumn("_rates", _rates(F.col(reference), F.col(hypothesis)))
    return x.select(
        *df.columns, _rate(F.col("_rates.edits"), F.col("_rates.size")).alias("cer"),
        _rounded(F.col("_rates.trimmed"), F.col("_rates.r"), F.col("_rates.h")).alias("cer_rounded"),
        _rounded(F.col("_rates.word_edits"), F.col("_rates.words"), F.col("_rates.other"))
        .alias("wer"))


def cer_rounded(reference: Column, hypothesis: Column) -> Column:
    """Benchmark variant: trimmed, 4 decimals, an empty reference scores 0 or 1."""
    r, h = strip(text_or_empty(reference)), strip(text_or_empty(hypothesis))
    found = _characters(r, h)
    return _rounded(found["edits"], found["size"], F.length(h))


def wer(reference: Column, hypothesis: Column) -> Column:
    """Word error rate, 4 decimals: edits between the lists of words."""
    found = _words(reference, hypothesis)
    return _rounded(found["edits"], found["size"], found["other"])


def with_reading_rates(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Add ``cer`` and ``exact_match`` of two text columns, in one pass of the texts."""
    x = df.withColumn("_found", _readings(F.col(reference), F.col(hypothesis)))
    size, other = F.col("_found.size"), F.col("_found.other")
    return x.select(*df.columns, _rate(F.col("_found.edits"), size).alias("cer"),
                    _share(F.col("_found.same"), size, other).alias("exact_match"))


def _share(same: Column, size: Column, other: Column) -> Column:
    longest = F.greatest(size, other)
    return F.when(longest == 0, F.lit(1.0)).otherwise(
        F.when(F.least(size, other) == 0, F.lit(0.0))
         .otherwise(same / F.nullif(longest, F.lit(0))))


def exact_match(reference: Column, hypothesis: Column, normalise: bool = True) -> Column:
    """Share of positions whose characters agree, over the longer length; both empty is 1."""
    ref, hyp = text_or_empty(reference), text_or_empty(hypothesis)
    if normalise:
        ref, hyp = nfc(ref), nfc(hyp)
    same = F.aggregate(
        F.zip_with(F.split(ref, ""), F.split(hyp, ""), lambda a, b: F.coalesce(
            (a == b).cast("int"), F.lit(0))), F.lit(0), lambda acc, x: acc + x)
    return _share(same, F.length(ref), F.length(hyp))


def matching_ratio(a: str, b: str) -> float:
    """``difflib.SequenceMatcher(None, a, b).ratio()``, exactly.

    Blocks begin from characters that are not frequent in ``b`` (up to 1 % of 200 or more), so
    only the places of these are walked, and their places in ``b`` from where a region begins.
    """
    most = len(b) // 100 + 1 if len(b) >= 200 else len(b)
    seeds = [c for c, n in Counter(b).items() if n <= most]
    places: dict[str, list[int]] = {c: [] for c in seeds}
    at, targets = [], []
    if seeds:
        find = re.compile("[" + "".join(map(re.escape, seeds)) + "]").finditer
        for m in find(b):
            places[m.group()].append(m.start())
        for m in find(a):
            at.append(m.start())
            targets.append(places[m.group()])
    matched, queue = 0, [(0, len(a), 0, len(b))]
    while queue:
        alo, ahi, blo, bhi = queue.pop()
        i, j, size = alo, blo, 0
        runs: dict[int, int] = {}
        before = -1
        for x in range(bisect_left(at, alo), bisect_left(at, ahi)):
            here, js = at[x], targets[x]
            longer = {}
            if here != before + 1:
                runs = longer
            for y in range(bisect_left(js, blo) if blo else 0, len(js)):
                to = js[y]
                if to >= bhi:
                    break
                k = longer[to] = runs.get(to - 1, 0) + 1 if runs is not longer else 1
                if k > size:
                    i, j, size = here - k + 1, to - k + 1, k
            runs, before = longer, here
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        if size:
            matched += size
            if alo < i and blo < j:
                queue.append((alo, i, blo, j))
            if i + size < ahi and j + size < bhi:
                queue.append((i + size, ahi, j + size, bhi))
    return 2.0 * matched / (len(a) + len(b)) if a or b else 1.0


def py_similarity(a: str | None, b: str | None) -> float:
    a, b = " ".join((a or "").split()), " ".join((b or "").split())
    if not a and not b:
        return 1.0
    return matching_ratio(a, b) if a and b else 0.0


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two texts, spacing ignored."""
    return pd.Series([py_similarity(x, y) for x, y in zip(a, b)], dtype="float64")
