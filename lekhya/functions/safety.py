"""Redaction, cross-site-scripting, prompt-injection and error-message expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from lekhya import fixed_values as fv
from lekhya.functions.regex import java_pattern
from lekhya.functions.text import text_or_empty


def redact_secrets(c: Column, signing_secrets: tuple[str, ...] = ()) -> Column:
    """Mask keys, secrets, passwords and private keys; known secrets are masked verbatim."""
    c = text_or_empty(c)
    for i, (pattern, mask) in enumerate(fv.SECRET_PATTERNS):
        if i == 2:
            for secret in signing_secrets:
                c = F.replace(c, F.lit(secret), F.lit("[REDACTED_SIGNING_SECRET]"))
        c = F.regexp_replace(c, java_pattern(pattern), mask)
    return c


def redact_system_prompt(c: Column, assistant_openings: tuple[str, ...] = ()) -> Column:
    """Mask system-prompt blocks, and lines that begin with a known system-prompt opening."""
    c = text_or_empty(c)
    for pattern, mask in fv.SYSTEM_PROMPT_PATTERNS:
        c = F.regexp_replace(c, java_pattern(pattern), mask)
    for opening in assistant_openings:
        c = F.regexp_replace(c, java_pattern(re.escape(opening) + r"[^\n\r]*", True),
                             "[REDACTED_SYSTEM_PROMPT]")
    return c


def redact(c: Column, signing_secrets: tuple[str, ...] = (),
           assistant_openings: tuple[str, ...] = ()) -> Column:
    return redact_system_prompt(redact_secrets(c, signing_secrets), assistant_openings)


def redact_nested(c: Column, dtype: T.DataType) -> Column:
    """Redact every string inside a nested column; keys and other types are left alone."""
    if isinstance(dtype, T.StringType):
        return F.when(c.isNotNull(), redact(c))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: redact_nested(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda _, v: redact_nested(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[
            redact_nested(c[f.name], f.dataType).alias(f.name) for f in dtype.fields]))
    return c


def contains_xss(c: Column) -> Column:
    return F.greatest(*[text_or_empty(c).rlike(java_pattern(p)) for p in fv.XSS_PATTERNS])


def sanitize_xss(c: Column) -> Column:
    """Remove dangerous markup, then escape what is left for HTML."""
    c = text_or_empty(c)
    for pattern in fv.XSS_PATTERNS:
        c = F.regexp_replace(c, java_pattern(pattern), "")
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                         ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return c


def injection_matches(c: Column) -> Column:
    """Names of the prompt-injection patterns found in the text."""
    return F.array_compact(F.array(*[
        F.when(text_or_empty(c).rlike(java_pattern(p)), name)
        for name, p in fv.INJECTION_PATTERNS]))


def quote_passage(c: Column) -> Column:
    """Fence an untrusted passage and defuse chat control tags."""
    safe = F.regexp_replace(c, fv.CONTROL_TAGS, "[TAG_DEFUSED]")
    quoted = F.concat(F.lit(fv.PASSAGE_OPEN + "\n"), safe, F.lit("\n" + fv.PASSAGE_CLOSE))
    return F.when(F.length(text_or_empty(c)) == 0, "").otherwise(quoted)


def scrub_error(c: Column) -> Column:
    leaking = F.greatest(*[F.contains(F.lower(c), F.lit(t)) for t in fv.SENSITIVE_ERROR_TERMS])
    return F.when(leaking, fv.SCRUBBED_ERROR).otherwise(c)
