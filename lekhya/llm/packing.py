"""Best-fit packing of tokenised documents into sequences of a fixed length.

Each task tokenises its documents and packs them as they come: a piece goes into the open
sequence with the least room that still holds it.  A fixed number of sequences is open; a
bitset has one bit per amount of free space, so the tightest one is the lowest set bit at or
above the piece's length.  Where nothing fits and all are open, the fullest closes first.

Sequences still open at the end of a task are taken apart and packed again, some tasks'
worth in each task of the next round, down to one.  A round moves only those few pieces, and
their number is bounded by tasks x open sequences.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lekhya.llm.workers import trimmed
from lekhya.session import stage

CAPACITY = 4096
OPEN = 512         # open sequences per task
FAN_IN = 16        # tasks of a round that one task of the next takes up
CACHED = 300_000   # words whose ids a worker remembers, twice at most
LONG_WORD = 64     # longer ones are not remembered

# How the tokenizer cuts lower-case words of ASCII and Latin-1 letters; others it cuts itself.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]"
                   "|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")

PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, "
          "sequence_id long, offset long")


class Memo(dict):
    """Remembers results of ``make``; when full, it keeps the last ``limit`` at hand and
    starts anew, so what recurs is not lost."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONG_WORD:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level models use for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


class WordIds:
    """Ids of a text as little-endian bytes, from ids remembered per word and word part.

    For the word-end BPE of ``word_bpe_49k.json``, whose parts never span a space or a newline.
    """

    def __init__(self, path: str, cached: int = CACHED):
        from tokenizers import Tokenizer

        self.tokenizer, self.letters = Tokenizer.from_file(path), byte_letters()
        self.words, self.parts = Memo(self._word, cached), Memo(self._part, cached)

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        if "<|" in word or not PLAIN.fullmatch(word):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.parts.__getitem__, PARTS.findall(word.lower())))

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


class BestFit:
    """Bounded-space online best fit; ``put`` returns the sequences that it closed."""

    def __init__(self, capacity: int, open_limit: int):
        self.capacity, self.limit, self.count = capacity, open_limit, 0
        self.bits = 0                          # bit f: a sequence with free space f is open
        self.open: dict[int, list[list]] = {}  # by free space

    def _take(self, free: int) -> list:
        held = self.open[free]
        sequence = held.pop()
        if not held:
            del self.open[free]
            self.bits ^= 1 << free
        self.count -= 1
        return sequence

    def put(self, item, size: int) -> list[list]:
        closed, fits = [], self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.count == self.limit:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            free, sequence = self.capacity, []
        sequence.append((item, self.capacity - free))
        free -= size
        if not free:
            closed.append(sequence)
        else:
            self.open.setdefault(free, []).append(sequence)
            self.bits |= 1 << free
            self.count += 1
        return closed

    def rest(self) -> list[list]:
        """The open sequences, fullest first."""
        return [s for free in sorted(self.open) for s in self.open[free]]


def pieces_of(doc_id, ids: bytes, capacity: int) -> Iterator[tuple]:
    """(doc_id, piece, start, length, crc) of at most ``capacity`` ids each."""
    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
        part = ids[at:at + 4 * capacity]
        yield doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)


def _packed(batches: Iterator[Iterator[tuple]], level: int, capacity: int, open_limit: int,
            last: bool) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in PIECES.split(", ")]
    packer, n = BestFit(capacity, open_limit), 0
    base = (level << 56) | (TaskContext.get().partitionId() << 32)
    for pieces in batches:
        rows = []
        for p in pieces:
            for sequence in packer.put(p, p[3]):
                rows += [(*q, base | n, offset) for q, offset in sequence]
                n += 1
        yield pd.DataFrame(rows, columns=names)
    rows = []
    for sequence in packer.rest():
        rows += [(*q, base | n if last else None, offset) for q, offset in sequence]
        n += 1
    made = pd.DataFrame(rows, columns=names)
    yield made.astype({"sequence_id": "Int64"})


def pack(docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = CAPACITY,
         open_sequences: int = OPEN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every document, cut into pieces of at most ``capacity`` ids, in a sequence.

    ``tokenizer`` is the path of a tokenizers file that all machines have.  Returns doc_id,
    piece, start, length, ids_crc32, sequence_id, offset.  Null and empty texts are the one
    id ``end``; repeated rows are packed once each; an empty table gives an empty result.
    Only ``key`` and ``text`` are read, whatever else the table holds.
    """
    def first(batches):
        ids_of, tail = WordIds(tokenizer), array("I", [end]).tobytes()

        def cut(pdf):
            for doc_id, t in zip(pdf["doc_id"], pdf["text"]):
                yield from pieces_of(None if pd.isna(doc_id) else int(doc_id),
                                     ids_of(t or "") + tail, capacity)
        yield from _packed(map(cut, batches), 0, capacity, open_sequences, False)

    def again(level: int, last: bool):
        def run(batches):
            pieces = (zip(*[pdf[c].astype(object).where(pdf[c].notna(), None) for c in (
                "doc_id", "piece", "start", "length", "ids_crc32")]) for pdf in batches)
            yield from _packed(pieces, level, capacity, open_sequences, last)
        return run

    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tasks = texts.rdd.getNumPartitions()
    made = stage(texts.mapInPandas(trimmed(first), PIECES))
    out, level = made.filter("sequence_id IS NOT NULL"), 0
    while True:
        level, tasks = level + 1, ceil(tasks / FAN_IN)
        left = made.filter("sequence_id IS NULL").repartition(tasks)
        made = stage(left.mapInPandas(trimmed(again(level, tasks == 1)), PIECES))
        out = out.unionByName(made.filter("sequence_id IS NOT NULL"))
        if tasks <= 1:
            return out
