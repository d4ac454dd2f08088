"""Embeddings of many texts are those of each."""

import pandas as pd
import pytest

from lekhya.functions import vectors

PROSE = ("The quick brown fox, No. 12/A of 2019, jumps over the lazy dog; é-ü is kept [x^y]. "
         "Zwei Jahre später\\war alles - wie je zuvor.\n")


def test_embeddings_of_many_texts_are_those_of_each():
    texts = [None, "", "a", "ab", "abc", "x 1 y", "Leave leave भत्ता", "KK order", "\x00\x7f a",
             *[PROSE * n for n in range(5)], *[f"Order No. {i}/FIN/A allowance pension"
                                               for i in range(600)], "word " * 90_000, "end leave"]
    for some in (texts, [None], []):
        got = vectors.embed_all(some)
        assert len(got) == len(some)
        assert all((g == vectors.embed(t)).all() for g, t in zip(got, some))


def test_similarities_take_stored_vectors_before_texts():
    queries = [vectors.embed("leave order"), vectors.embed(""), vectors.embed("pension")]
    texts = pd.Series(["leave order", "pension", None, "pension", "leave"], dtype=object)
    stored = pd.Series([None, list(queries[0]), None, [1.0, 2.0], []], dtype=object)
    got = vectors.similarity_to(queries).func(texts, stored)
    first = [g[0] for g in got]
    assert first[:4] == pytest.approx([1.0, 1.0, 0.0, 0.0]) and 0 < first[4] < 1
    assert all(g[1] == 0 for g in got) and list(got[3]) == [0, 0, 0]
