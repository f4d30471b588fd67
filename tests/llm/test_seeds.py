"""Rare seeds open few pairs on text with natural word frequencies, and lose no alignment."""

import random

import numpy as np
import pyarrow as pa

from stratiform.llm import decontamination as dc
from stratiform.llm import textkit as tk

WORDS = [f"w{i}" for i in range(20_000)]
WEIGHTS = np.cumsum(1 / np.arange(1, 20_001))


def zipf(rng, n):
    return rng.choices(WORDS, cum_weights=WEIGHTS, k=n)


def frequencies(words, doc, items):
    held = {}
    for _, grams, at, _ in dc._seed_hits(words, doc, items):
        for g, d in {(int(g), int(d)) for g, d in zip(tk.signed(grams[at]), doc[at])}:
            held[g] = held.get(g, 0) + 1
    return held


def test_common_phrases_open_few_pairs():
    rng = random.Random(1)
    docs, tests = [" ".join(zipf(rng, 500)) for _ in range(2000)], [" ".join(zipf(rng, 38)) for _ in range(100)]
    items = dc.Items(list(range(100)), tests, dc.SEED_WORDS, dc.MIN_SCORE)
    words, doc = dc._words(*tk.buffer_of(pa.array(docs, pa.large_string())))
    items.keep_rare(frequencies(words, doc, items), items.some())
    met = sum(dc.meetings(doc, at, low, size, items).shape[1] for size, _, at, low in dc._seed_hits(words, doc, items))
    assert met < 0.005 * 2000 * 100


def test_edited_copies_meet_their_items():
    """Copies changed at random until the score is near the limit, against the alignment itself; verbatim copies make every seed of an item frequent."""
    rng = random.Random(2)
    tests = [zipf(rng, n) for n in (3, 8, 15, 38, 100) for _ in range(12)]
    docs, pairs = [], set()
    for i, item in enumerate(tests):
        for share in (0.0, 0.1, 0.2, 0.3):
            copy = []
            for w in item:
                u = rng.random()
                copy += [] if u < share / 3 else [rng.choice(WORDS)] if u < 2 * share / 3 else [w, rng.choice(WORDS)] if u < share * 1.5 else [w]
            docs.append(" ".join(zipf(rng, 60) + copy + zipf(rng, 60)))
            pairs.add((len(docs) - 1, i))
        docs += [" ".join(item)] * 3
    items = dc.Items(list(range(len(tests))), [" ".join(t) for t in tests], dc.SEED_WORDS, dc.MIN_SCORE)
    words, doc = dc._words(*tk.buffer_of(pa.array(docs, pa.large_string())))
    items.keep_rare(frequencies(words, doc, items), items.some())
    met = {(d, i) for size, _, at, low in dc._seed_hits(words, doc, items) for d, i in dc.meetings(doc, at, low, size, items).T.tolist()}
    cuts = np.searchsorted(doc, np.arange(len(docs) + 1))
    good = {(d, i) for d, i in pairs if dc.align(items.words[i], words[cuts[d] : cuts[d + 1]]) >= dc.MIN_SCORE}
    assert good <= met and len(good) > 120
