"""The search of op8 against a comparison of every diagonal."""

from itertools import combinations

import numpy as np
import pytest

from tidemark.llm import decontaminate as D


def placements(n):
    """All ways to lay the most substitutions that 75 % allows into ``n`` tokens: rows of equal or not."""
    lost = list(combinations(range(n), n - int(np.ceil(0.75 * n))))
    same = np.ones((len(lost), n), bool)
    if lost[0]:
        np.put_along_axis(same, np.array(lost), False, 1)
    return same


@pytest.mark.parametrize("n", range(1, 26))
def test_a_mask_fits_wherever_the_substitutions_lie(n):
    same = placements(n)
    fits = np.zeros(len(same), bool)
    for mask in D.masks_of(n, None, 13, 0.75):
        keep = np.array([c == "1" for c in mask])
        for at in range(n - len(mask) + 1):
            fits |= same[:, at : at + len(mask)][:, keep].all(1)
    assert fits.all()


def brute(doc, items, least, share):
    return {k for k, t in enumerate(items) for g in range(1 - len(t), len(doc)) if D.overlap(doc, t, g, least, share)}


@pytest.mark.parametrize(("least", "share"), [(13, 0.75), (8, 0.6), (20, 0.9)])
def test_search_finds_what_all_diagonals_hold(least, share):
    rng = np.random.default_rng(5)
    words = [b"w%d" % k for k in range(40)]
    texts = [b" ".join(rng.choice(words, n)) for n in (1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13, 14, 16, 20, 24, 25, 60)]
    bank = D.Bank(list(enumerate(texts)), None, least, share)
    found = 0
    for _ in range(300):
        item = texts[rng.integers(len(texts))].split()
        a = rng.integers(len(item))
        part = [w if rng.random() < 0.8 else b"other" for w in item[a // 2 :]]
        (doc,) = D.token_hashes([[*rng.choice(words, rng.integers(30)), *part, *rng.choice(words, rng.integers(30))]])
        got = {m[0] for m in bank.matches(doc)}
        assert got == brute(doc, bank.tokens, least, share)
        found += len(got)
    assert found > 100


def test_every_fourth_word_replaced_is_found():
    w = [b"w%d" % k for k in range(40)]
    bank = D.Bank([(1, b" ".join(w))], None, 13, 0.75)
    (doc,) = D.token_hashes([[b"x", *(b"other" if i % 4 == 3 else x for i, x in enumerate(w)), b"y"]])
    assert bank.matches(doc) == [(0, 1, 40, 30)]
