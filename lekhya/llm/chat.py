"""Chat formatting by schema fingerprints.

A record is JSON in any layout.  The hash of its nested field paths names its layout and
selects a declarative mapping, which yields the canonical turns (conversation, turn, role,
text).  Turns are rendered with a template whose markers cannot occur in an escaped text, and
the rendering can be read back without loss.  Each turn is rendered on its own, so that a
conversation of any length streams through in order and is never held whole.

Ids of conversations are text, so that numbers and names meet in one column; a null id is a
conversation of its own.  A record that no mapping fits, or that is not JSON, has no turns and
is a row of ``rejected`` that says why; null records have neither.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

TURNS = "conv_id string, turn long, part int, role string, text string"


def field_paths(value, path: str = "") -> set[str]:
    """Nested field paths of a JSON value; list elements share the path ``[]``."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{path}.{k}")} or {path}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, path + "[]")} or {path + "[]"}
    return {path}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    ``paths``: the field paths of the layout.  ``turns``: (role, path of the text, path of a
    text to append or "") for fixed fields; or ``each``: list of messages with ``role`` and
    ``text`` fields.  A role that starts with "." is a path.  ``roles`` renames roles.
    ``optional``: paths that a record may have besides; what lies below one belongs to it.
    """
    paths: tuple[str, ...]
    conv: str
    turn: str = ""
    turns: tuple[tuple[str, str, str], ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    roles: dict = field(default_factory=dict)
    optional: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return fingerprint(self.paths)

    def reduced(self, paths: frozenset[str]) -> set[str]:
        """A record's paths without the optional ones; an empty or null list of messages
        stands for the paths of its messages."""
        kept = {p for p in paths if not any(
            p == o or p.startswith((o + ".", o + "[")) for o in self.optional)}
        if self.each and kept & {self.each, self.each + "[]"}:
            kept -= {self.each, self.each + "[]"}
            kept |= {p for p in self.paths if p.startswith(self.each + "[].")}
        return kept


def at(record, path: str):
    """The value at ``.a.b``; None where it is missing."""
    for name in path.strip(".").split(".") if path.strip(".") else ():
        record = record.get(name) if isinstance(record, dict) else None
    return record


def plain(value, what: str) -> str:
    """A text or null, as text."""
    if value is not None and not isinstance(value, str):
        raise ValueError(f"{what} is not a text")
    return value or ""


def apply(mapping: Mapping, record: dict) -> Iterator[tuple]:
    """(conv_id, turn, part, role, text); a null text is empty, a null role is ""."""
    conv, turn = at(record, mapping.conv), at(record, mapping.turn) if mapping.turn else None
    if conv is not None and not isinstance(conv, str):
        conv = json.dumps(conv)
    if turn is not None and (type(turn) is not int or not -1 << 63 <= turn < 1 << 63):
        raise ValueError("the turn is not a 64-bit integer")
    if mapping.each:
        found = [(m.get(mapping.role), m.get(mapping.text)) for m in at(record, mapping.each) or ()]
    else:
        found = [(at(record, r) if r.startswith(".") else r,
                  "\n\n".join(filter(None, (plain(at(record, p), p) for p in (a, b) if p))))
                 for r, a, b in mapping.turns]
    for i, (role, text) in enumerate(found):
        role = plain(role, "a role")
        yield (conv, i if turn is None else turn, i, mapping.roles.get(role, role) or "",
               plain(text, "a text"))


SHARE_ROLES = {"human": "user", "gpt": "assistant"}
LAYOUTS = (
    Mapping((".conv_id", ".role", ".text", ".turn"), ".conv_id", ".turn",
            ((".role", ".text", ""),)),
    Mapping((".conv_id", ".messages[].content", ".messages[].role"), ".conv_id",
            each=".messages", role="role", text="content", optional=(".messages[].name",)),
    Mapping((".conv_id", ".conversations[].from", ".conversations[].value"), ".conv_id",
            each=".conversations", role="from", text="value", roles=SHARE_ROLES),
    Mapping((".conv_id", ".prompt", ".response"), ".conv_id",
            turns=(("user", ".prompt", ""), ("assistant", ".response", ""))),
    Mapping((".conv_id", ".prompt", ".completion"), ".conv_id",
            turns=(("user", ".prompt", ""), ("assistant", ".completion", ""))),
    Mapping((".conv_id", ".input", ".instruction", ".output"), ".conv_id",
            turns=(("user", ".instruction", ".input"), ("assistant", ".output", ""))),
    Mapping((".conv_id", ".instruction", ".output"), ".conv_id",
            turns=(("user", ".instruction", ""), ("assistant", ".output", ""))),
)


LAYOUTS_REMEMBERED = 4096


def chooser(layouts: tuple[Mapping, ...]):
    """The mapping for a set of field paths: by its fingerprint, or else by the fingerprint of
    what is left of it without a mapping's optional paths; None where there is none."""
    by_key = {m.key: m for m in layouts}

    @lru_cache(LAYOUTS_REMEMBERED)
    def choose(paths: frozenset[str]) -> Mapping | None:
        return by_key.get(fingerprint(paths)) or next(
            (m for m in layouts if fingerprint(m.reduced(paths)) == m.key), None)

    return choose


def read_records(records: DataFrame, layouts: tuple[Mapping, ...] = LAYOUTS,
                 column: str = "record") -> DataFrame:
    """The turns of JSON records, and a row with ``record`` and ``problem`` and no turn for each
    record that cannot be read: no JSON, no mapping for its layout, or a field of another type."""
    def run(batches):
        choose = chooser(layouts)
        for pdf in batches:
            rows = []
            for line in pdf["record"]:
                if line is None:
                    continue
                try:
                    record = json.loads(line)
                    paths = frozenset(field_paths(record))
                    mapping = choose(paths)
                    if mapping is None:
                        raise ValueError(f"no mapping for layout {sorted(paths)}")
                    rows += [(*turn, None, None) for turn in apply(mapping, record)]
                except (ValueError, AttributeError, RecursionError) as e:
                    rows.append((None, None, None, None, None, line,
                                 str(e) or type(e).__name__))
            made = pd.DataFrame(rows, columns=["conv_id", "turn", "part", "role", "text",
                                               "record", "problem"])
            yield made.astype({"conv_id": object, "turn": "Int64", "part": "Int32"})

    return records.select(F.col(column).alias("record")).mapInPandas(
        run, f"{TURNS}, record string, problem string")


def canonical_turns(records: DataFrame, layouts: tuple[Mapping, ...] = LAYOUTS,
                    column: str = "record") -> DataFrame:
    """Turns of the JSON records that a mapping fits; ``rejected`` has the others."""
    return (read_records(records, layouts, column).filter("problem IS NULL")
            .drop("record", "problem"))


def rejected(records: DataFrame, layouts: tuple[Mapping, ...] = LAYOUTS,
             column: str = "record") -> DataFrame:
    """``record`` and ``problem`` of every record that ``canonical_turns`` leaves out."""
    return (read_records(records, layouts, column).filter("problem IS NOT NULL")
            .select("record", "problem"))


#: Control strings of the template.  None contains the escape character.
OPEN_USER, CLOSE_USER = "<s>[INST] ", " [/INST]"
OPEN_ANSWER, END = " ", " </s>"
OPEN_SYSTEM, CLOSE_SYSTEM = "<<SYS>>\n", "\n<</SYS>>\n"
OPEN_OTHER, CLOSE_NAME, CLOSE_OTHER = "[ROLE ", "] ", " [/ROLE]"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE", "[/ROLE]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(\\|)")


def escape(text: str) -> str:
    """Doubles backslashes and puts one into every control string: ``<s>`` is ``<\\s>``."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, str, str]:
    """Opening marker, escaped text and closing marker of a turn."""
    if role == "user":
        return OPEN_USER, escape(text), CLOSE_USER
    if role == "assistant":
        return OPEN_ANSWER, escape(text), END
    if role == "system":
        return OPEN_SYSTEM, escape(text), CLOSE_SYSTEM
    return OPEN_OTHER + escape(role).replace("]", "\\]") + CLOSE_NAME, escape(text), CLOSE_OTHER


_TURN = re.compile(
    rf"{re.escape(OPEN_USER)}(?P<user>.*?){re.escape(CLOSE_USER)}"
    rf"|{re.escape(OPEN_SYSTEM)}(?P<system>.*?){re.escape(CLOSE_SYSTEM)}"
    rf"|{re.escape(OPEN_OTHER)}(?P<name>(?:[^\]\\]|\\.)*){re.escape(CLOSE_NAME)}"
    rf"(?P<other>.*?){re.escape(CLOSE_OTHER)}"
    rf"|{re.escape(OPEN_ANSWER)}(?P<assistant>.*?){re.escape(END)}", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn in a rendered conversation or part of one."""
    turns, done = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != done:
            break
        done = m.end()
        kind = m.lastgroup
        role = unescape(m["name"]) if kind == "other" else kind
        turns.append((role, unescape(m[kind])))
    if done != len(formatted):
        raise ValueError(f"not a rendering at {done}: {formatted[done:done + 40]!r}")
    return turns


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, turn, part, role, formatted, loss_start, loss_end: a row per turn.

    A conversation's rendering is the concatenation in order of (turn, part); loss_start and
    loss_end bound the escaped text of an assistant within its row, null for other roles.
    """
    def run(batches):
        for pdf in batches:
            rows = []
            for conv, turn, part, role, text in pdf.itertuples(index=False):
                start, body, stop = render(role, text)
                mask = (len(start), len(start) + len(body)) if role == "assistant" else (None, None)
                rows.append((conv, turn, part, role, start + body + stop, *mask))
            made = pd.DataFrame(rows, columns=["conv_id", "turn", "part", "role", "formatted",
                                               "loss_start", "loss_end"])
            yield made.astype({"conv_id": object} | dict.fromkeys(
                ("turn", "loss_start", "loss_end"), "Int64"))

    return turns.mapInPandas(run, "conv_id string, turn long, part int, role string, "
                                  "formatted string, loss_start long, loss_end long")


DIGEST = ("conv_id string, n_turns long, turns_sha256 string, loss_chars long, "
          "loss_sha256 string, formatted_chars long")


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of what the renderings say, per conversation.

    Turns arrive sorted and are hashed as they pass, so memory does not depend on the length
    of a conversation; its digest is sequential by nature.
    """
    order = ["conv_id", "turn", "part", "role", "formatted"]

    def run(batches):
        now, state = None, None

        def result():
            n, said, chars, learnt, size = state
            return now, n, said.hexdigest(), chars, learnt.hexdigest(), size

        for pdf in batches:
            rows = []
            ids = pdf["conv_id"].astype(object)
            for conv, text, start, end in zip(ids.where(ids.notna(), None), pdf["formatted"],
                                              pdf["loss_start"].astype("Int64"),
                                              pdf["loss_end"].astype("Int64")):
                if state is None or conv != now:
                    if state is not None:
                        rows.append(result())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                if start is not pd.NA:
                    learnt = unescape(text[start:end])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(text)
            yield frame(rows)
        if state is not None:
            yield frame([result()])

    def frame(rows):
        names = [c.split()[0] for c in DIGEST.split(", ")]
        return pd.DataFrame(rows, columns=names).astype({"conv_id": object})

    return (rendered.repartition("conv_id").sortWithinPartitions(*order)
            .select("conv_id", "formatted", "loss_start", "loss_end").mapInPandas(run, DIGEST))
