"""Votes of hashed embeddings."""

from lekhya.functions import vectors


def test_votes_are_whole_numbers():
    for text in (None, "", "ab", "Leave leave भत्ता"):
        words, grams = vectors.votes(text)
        assert words.dtype == grams.dtype == "int32" and len(words) == len(grams) == vectors.DIM
