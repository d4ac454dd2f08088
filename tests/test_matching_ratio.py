"""The matching-block ratio is that of difflib."""

import random
from difflib import SequenceMatcher

import pytest

from lekhya.functions.compare import matching_ratio

PROSE = ("The quick brown fox, No. 12/A of 2019, jumps over the lazy dog; é-ü is kept [x^y]. "
         "Zwei Jahre später\\war alles - wie je zuvor.\n")


@pytest.mark.parametrize("seed", range(12))
def test_ratio_is_that_of_difflib(seed):
    rng = random.Random(seed)
    for size in (0, 1, 30, 199, 200, 260, 2500):
        body = "".join(rng.choice(PROSE) for _ in range(size))
        words = " ".join(rng.choice(PROSE.split()) for _ in range(size // 5))
        for text in (body, words, "ab" * (size // 2)):
            cut = rng.randrange(len(text) + 1)
            for other in (text, text.translate(str.maketrans("eo", "co")), text[cut:] + text[:cut],
                          text[:cut] + "~" + text[cut:], body[::-1], ""):
                for a, b in ((text, other), (other, text)):
                    assert matching_ratio(a, b) == SequenceMatcher(None, a, b).ratio()
