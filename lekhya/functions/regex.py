"""Python ``re`` patterns evaluated by Spark's Java regex engine.

The two dialects disagree on what ``\\w``, ``\\d``, ``\\s``, ``\\b``, ``.`` and ``$``
mean outside ASCII.  ``java_pattern`` rewrites those classes to their Python
meaning, so combining marks (vowel signs) are not word characters and a
Devanagari digit is a digit.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as op, _parser as parser

_WORD = r"\p{L}\p{N}_"
_SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
_BOUNDARY = rf"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
# before a word character a boundary only asks for no word character in front
_WORD_START = rf"(?<![{_WORD}])"
_CLASSES = {"w": _WORD, "d": r"\p{Nd}", "s": _SPACE}

SPACE_CLASS = _SPACE


def _next_class(rest: str) -> str:
    """A look ahead at a digit or character class that must follow a boundary.

    It changes no match; it dismisses most positions before the boundary is tested.
    """
    rest = rest.lstrip("(")
    if rest.startswith(r"\d"):
        unit = rest[:2]
    elif rest.startswith("["):
        unit = rest[:rest.index("]") + 1]
    else:
        return ""
    if rest[len(unit):].startswith(("*", "?", "{0", "{,")):
        return ""  # may be absent
    return f"(?=[{_CLASSES['d']}])" if unit == r"\d" else f"(?={_java_class(unit)})"


def _starts_word(rest: str) -> bool:
    """Whether what follows can only begin with a word character.

    Groups in the pattern tables open with a letter in every alternative, so the
    first one decides.
    """
    while rest.startswith(("(?:", "(")):
        rest = rest[3:] if rest.startswith("(?:") else rest[1:]
    return rest[:1].isalnum() or rest.startswith((r"\d", r"\w"))


def _first_units(items) -> tuple[list[str], bool] | None:
    """What a match of parsed ``items`` can begin with, as members of a Java class, and whether
    it can be empty; None where that is too much to list."""
    found: list[str] = []
    for code, value in items:
        if code is op.AT or code in (op.ASSERT, op.ASSERT_NOT):
            continue
        if code is op.LITERAL:
            part = [chr(value)], False
        elif code is op.IN:
            part = _class_units(value)
        elif code is op.BRANCH:
            parts = [_first_units(b) for b in value[1]]
            part = None if None in parts else (sum((p[0] for p in parts), []),
                                               any(p[1] for p in parts))
        elif code is op.SUBPATTERN:
            part = _first_units(value[3])
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT):
            inner = _first_units(value[2])
            part = inner and (inner[0], inner[1] or value[0] == 0)
        else:
            part = None
        if part is None:
            return None
        found += part[0]
        if not part[1]:
            return found, False
    return found, True


def _class_units(members) -> tuple[list[str], bool] | None:
    units = []
    for code, value in members:
        if code is op.LITERAL:
            units.append(chr(value))
        elif code is op.RANGE:
            units.append(chr(value[0]) + "-" + chr(value[1]))
        elif code is op.CATEGORY and value is op.CATEGORY_DIGIT:
            units.append(r"\p{Nd}")
        elif code is op.CATEGORY and value is op.CATEGORY_SPACE:
            units.append(_SPACE)
        else:
            return None
    return units, False


def _first_class(pattern: str) -> str:
    """A look ahead at the characters a match can begin with, "" where any will do.

    It changes no match; it dismisses most positions of a text by one test.  Characters beyond
    ASCII become one range, which may hold more than needed.
    """
    first = _first_units(parser.parse(pattern))
    if first is None or first[1]:
        return ""
    classes = {u for u in first[0] if u.startswith("\\") and len(u) > 1}
    spans = [(ord(u[0]), ord(u[-1])) for u in set(first[0]) - classes]
    beyond = [x for x in spans if x[1] > 127]
    spans = sorted(x for x in spans if x[1] <= 127)
    if beyond:
        spans.append((min(a for a, _ in beyond), max(b for _, b in beyond)))
    return "(?=[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" if a < b else rf"\x{{{a:x}}}"
                            for a, b in spans) + "".join(sorted(classes)) + "])"


def _java_class(unit: str) -> str:
    """A character class as Java writes it."""
    for code, members in _CLASSES.items():
        unit = unit.replace("\\" + code, members)
    return unit


@lru_cache(maxsize=None)
def java_pattern(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """Rewrite a Python pattern for Java, with flags in front."""
    if pattern.startswith("(?i)"):
        pattern, ignore_case = pattern[4:], True
    first = _first_class(pattern)
    pattern = pattern.replace(r"[\s\S]", r"(?s:.)")
    out, i, in_class = [], 0, False
    while i < len(pattern):
        char = pattern[i]
        if char == "\\":
            code = pattern[i + 1]
            if code in _CLASSES:
                out.append(_CLASSES[code] if in_class else f"[{_CLASSES[code]}]")
            elif code.lower() in _CLASSES and code.isupper() and not in_class:
                out.append(f"[^{_CLASSES[code.lower()]}]")
            elif code == "b" and not in_class:
                rest = pattern[i + 2:]
                out.append(_next_class(rest) + (_WORD_START if _starts_word(rest)
                                                else _BOUNDARY))
            else:
                out.append(char + code)
            i += 2
            continue
        if char == "[" and not in_class:
            in_class = True
        elif char == "]" and in_class:
            in_class = False
        out.append(char)
        i += 1
    flags = "d" + ("i" if ignore_case else "") + ("m" if multiline else "")
    body = "".join(out)
    if first and "|" in body:
        body = f"(?:{body})"  # the look ahead holds for every alternative
    return f"(?{flags}){first}{body}"


_EITHER = re.compile(r"\(\?:\\b\(\?:(.*)\)\\b\|(.*)\)")


def any_of(patterns: list[str], ignore_case: bool = False) -> str:
    """One alternation that matches where any of ``patterns`` does.

    Patterns of the form "whole word X, or Y anywhere" share one word boundary, so
    most positions of a text are dismissed by a single test.
    """
    whole, anywhere = [], []
    for p in patterns:
        split = _EITHER.fullmatch(p)
        if split:
            whole.append(split.group(1))
            anywhere.append(split.group(2))
        else:
            anywhere.append(f"(?:{p})")
    parts = ([r"\b(?:" + "|".join(whole) + r")\b"] if whole else []) + anywhere
    return java_pattern("|".join(parts), ignore_case)
