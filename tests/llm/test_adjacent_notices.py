"""Places of notices that stand near each other, with different edit counts."""

import random

import brute
import pytest
import regex

from colflow.llm.notices import NOTICES, edits_allowed, fuzzy_places, scan_notices


def best_first(text, pattern, low, high):
    """The best match of a stretch, and the same to its left and right."""
    m = pattern.search(text, low, high)
    if not m:
        return []
    left, right = best_first(text, pattern, low, m.start()), best_first(text, pattern, m.end(), high)
    return [*left, (m.start(), m.end(), sum(m.fuzzy_counts)), *right]


def damaged(rng, notice, edits):
    letters = list(notice)
    for _ in range(edits):
        at = rng.randrange(len(letters))
        letters[at : at + 1] = rng.choice([[], ["x"], [letters[at], "y"]])
    return "".join(letters)


@pytest.mark.parametrize("notice", NOTICES)
def test_adjacent_notices_are_all_found(notice):
    rng = random.Random(notice)
    k = edits_allowed(notice)
    pattern = regex.compile(f"(?b)(?:{notice}){{e<={k}}}")
    for _ in range(20):
        parts = []
        for _ in range(rng.randint(2, 6)):
            parts += [damaged(rng, notice, rng.randint(0, k)), rng.choice(["or", "z", "and some more words here"])]
        text = " ".join(parts)
        want = best_first(text, pattern, 0, len(text))
        assert sorted(p[1:4] for p in fuzzy_places(text, ((notice, "x"),))) == want, text


def test_repeated_notice_before_an_exact_one(spark):
    text = "relesed under the mit license or " * 5 + "released under the mit license"
    (row,) = scan_notices(brute.table(spark, [(1, text, None, None, 0)])).collect()
    assert [(p.first_word, p.last_word, p.edits) for p in row.places] == [(6 * i, 6 * i + 4, int(i < 5)) for i in range(6)]
