"""Text expressions: tokens, whitespace, scripts, cleaning, token estimates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from lekhya import fixed_values as fv
from lekhya.functions.regex import SPACE_CLASS, java_pattern

TOKEN = "[A-Za-z0-9ऀ-ॿ]+"
DEVANAGARI = "[ऀ-ॿ]"
KEPT_TOKEN = TOKEN[:-1] + "{2,}|" + DEVANAGARI  # runs of one Latin letter or digit match nowhere


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


# the members of SPACE_CLASS
SPACES = "".join(map(chr, (*range(0x09, 0x0e), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680,
                           *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000)))


def strip(c: Column) -> Column:
    """Drop leading and trailing whitespace, Unicode spaces included."""
    return F.btrim(c, F.lit(SPACES))


def words(c: Column) -> Column:
    """Runs of non-space characters, in order."""
    return F.regexp_extract_all(text_or_empty(c), F.lit(f"[^{SPACE_CLASS}]+"), F.lit(0))


def collapse_spaces(c: Column) -> Column:
    return F.array_join(words(c), " ")


def tokens(c: Column) -> Column:
    """Lower-case alphanumeric or Devanagari runs; one-letter Latin runs are dropped."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(KEPT_TOKEN), F.lit(0))


def py_tokens(text: str | None) -> list[str]:
    """The same tokens for text already in Python (query strings, Arrow batches)."""
    import re
    return [t for t in re.findall(TOKEN, (text or "").lower())
            if len(t) > 1 or "ऀ" <= t[0] <= "ॿ"]


def term_dictionary() -> Column:
    """The bilingual dictionary as a constant map column (137 keys)."""
    pairs = []
    for term, expansion in fv.BILINGUAL_TERMS.items():
        pairs += [F.lit(term), F.array(*[F.lit(e) for e in expansion])]
    return F.create_map(*pairs)


def expand_tokens(toks: Column) -> Column:
    """Tokens followed by every dictionary expansion; duplicates are kept."""
    table = term_dictionary()
    extra = F.flatten(F.transform(
        toks, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))
    return F.concat(toks, extra)


def devanagari_count(c: Column) -> Column:
    return F.length(F.regexp_replace(text_or_empty(c), "[^ऀ-ॿ]+", ""))


def latin_count(c: Column) -> Column:
    return F.length(F.regexp_replace(text_or_empty(c), "[^A-Za-z]+", ""))


def _minority_share(dev: Column, lat: Column) -> Column:
    return F.least(dev, lat) / F.nullif(dev + lat, F.lit(0))


def is_mixed_script(c: Column, threshold: float = fv.MIXED_SCRIPT_RATIO) -> Column:
    dev, lat = devanagari_count(c), latin_count(c)
    return F.coalesce((dev >= 5) & (lat >= 5) & (_minority_share(dev, lat) >= threshold),
                      F.lit(False))


def detect_language(c: Column) -> Column:
    """'hi', 'en' or 'bilingual' from the share of each script; no letters means 'hi'."""
    dev, lat = devanagari_count(c), latin_count(c)
    return (F.when(dev + lat == 0, "hi")
             .when(is_mixed_script(c), "bilingual")
             .when(dev / F.nullif(dev + lat, F.lit(0)) >= 0.60, "hi")
             .otherwise("en"))


def is_ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def language_distribution(c: Column) -> Column:
    """Shares of the two scripts; in ASCII only whether there is a letter matters."""
    c = text_or_empty(c)
    ascii_hi = F.when(c.rlike("[A-Za-z]"), 0).otherwise(100)
    # a lambda's argument is evaluated once, however often it is named
    counted = F.transform(
        F.array(F.struct(devanagari_count(c).alias("dev"), latin_count(c).alias("lat"))),
        lambda n: F.coalesce(F.floor(n["dev"] / F.nullif(n["dev"] + n["lat"], F.lit(0)) * 100),
                             F.lit(100)).cast("int"))
    hi = F.when(is_ascii(c), ascii_hi).otherwise(F.get(counted, F.lit(0)))
    return F.transform(F.array(hi), lambda p: F.struct(
        p.alias("hi_pct"), (F.lit(100) - p).alias("en_pct")))[0]


def token_estimate(c: Column) -> Column:
    n = F.greatest(F.floor(F.size(words(c)) * 1.25).cast("int"),
                   F.floor(F.length(c) / 4).cast("int"), F.lit(1))
    return F.when(F.length(text_or_empty(c)) == 0, 0).otherwise(n)


def py_token_estimate(text: str) -> int:
    return max(int(len(text.split()) * 1.25), len(text) // 4, 1) if text else 0


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode NFC; the one normal form Spark SQL has no function for."""
    return texts.map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t)
                     else unicodedata.normalize("NFC", t))


def clean_text(c: Column, normalise: bool = True) -> Column:
    """Drop page-number lines, odd spaces and broken line wraps; trim."""
    c = nfc(text_or_empty(c)) if normalise else text_or_empty(c)
    steps = [
        (java_pattern(r"^\s*page\s+\d+\s*(of\s+\d+)?\s*$", True, True), ""),
        (java_pattern(r"^\s*पृष्ठ\s+\d+\s*(का\s+\d+)?\s*$", False, True), ""),
        ("\u00a0", " "), ("\ufeff", ""),
        (java_pattern(r"(\w+)-\n(\w+)"), "$1$2"),
        ("\n{3,}", "\n\n"),
    ]
    for pattern, replacement in steps:
        c = F.regexp_replace(c, pattern, replacement)
    return strip(c)


def is_list_item(c: Column) -> Column:
    return strip(c).rlike(java_pattern(fv.LIST_ITEM))


def first_line(c: Column) -> Column:
    return F.substring_index(strip(text_or_empty(c)), "\n", 1)


def is_proviso(c: Column) -> Column:
    return c.rlike(java_pattern(fv.PROVISO, True))


def is_schedule(c: Column) -> Column:
    return c.rlike(java_pattern(fv.SCHEDULE, True))


def is_heading(block_type: Column, c: Column) -> Column:
    line = first_line(c)
    return F.coalesce((block_type == "HEADING") | (
        (F.length(line) < 120) & line.rlike(java_pattern(fv.SECTION_HEADING, True))),
        F.lit(False))


def block_type(c: Column, average_font_size: Column) -> Column:
    """HEADING by font size, LIST_ITEM by its marker, otherwise PARAGRAPH."""
    size = F.coalesce(average_font_size, F.lit(fv.DEFAULT_FONT_SIZE))
    return (F.when(size >= fv.HEADING_FONT_SIZE, "HEADING")
             .when(is_list_item(c), "LIST_ITEM").otherwise("PARAGRAPH"))
