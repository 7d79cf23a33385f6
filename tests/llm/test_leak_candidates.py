"""Leaks: candidates that cannot hold their item are passed over before they are confirmed, and no other."""
from __future__ import annotations

import numpy as np

from gapscope.llm import decontamination, neardup

ITEM = " ".join(f"a{k}" for k in range(20))
SHORT = "b0 b1 b2 b3"


def searcher():
    rng = np.random.default_rng(3)
    weights = rng.gamma(0.5, 1.0, decontamination.BUCKETS).astype(np.float32) + np.float32(0.01)
    basis = np.linalg.qr(rng.standard_normal((decontamination.BUCKETS, 24)))[0].astype(np.float32)
    items = [(i, neardup.word_hashes([x], decontamination.PUNCTUATION)[0].tolist(), 0) for i, x in enumerate((ITEM, SHORT))]
    return decontamination.Searcher(weights, basis, items)


def test_windows_with_too_few_words_of_an_item_are_not_confirmed(monkeypatch):
    tried = []
    confirm = decontamination.Searcher.confirm
    monkeypatch.setattr(decontamination.Searcher, "confirm", lambda self, item, *rest: tried.append(item) or confirm(self, item, *rest))
    filler = " ".join(f"z{k}" for k in range(30))
    few = " ".join(["a0 a1 a2 a3 a4 a5 a6"] * 9)  # 63 words of the item, seven different ones
    texts = [few, None, "", f"{filler} {few} {filler}", "b0 b1 b3 " * 20, filler]
    assert searcher().search(texts) == [] == searcher().search([filler, None]) and tried == []
    got = searcher().search([*texts, f"{few} {ITEM} {filler}", f"{filler} {SHORT}"])
    assert [(t, i, common) for t, i, _, common, *_ in got] == [(6, 0, 1.0), (7, 1, 1.0)] and sorted(set(tried)) == [0, 1]


def test_present_words_are_counted_like_sets():
    found = searcher()
    rng = np.random.default_rng(4)
    words = np.array([*found.items[0][1], *found.items[1][1], 12345, 99999], np.uint64)
    hashes = words[rng.integers(0, len(words), 400)]
    at, slot = found.spotted(hashes, decontamination.buckets_of(hashes))
    places = np.sort(slot * 401 + at)
    item, low = rng.integers(0, 2, 3000), rng.integers(0, 400, 3000)
    high = np.minimum(400, low + rng.integers(0, 60, 3000))
    need = rng.integers(1, 15, 3000)
    want = [len(set(hashes[a:b].tolist()) & set(found.items[i][1])) >= n for i, a, b, n in zip(item, low, high, need)]
    assert found.may_hold(places, 401, item, low, high, need).tolist() == want and 100 < sum(want) < 2900


def test_gram_product_of_long_and_many_passages():
    """More passages than are sorted at once, of one word to hundreds."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 300, decontamination.GRAM_SORTED + 77)
    buckets = rng.zipf(1.3, int(sizes.sum())) % 500
    weights = rng.random(decontamination.BUCKETS).astype(np.float32) + np.float32(0.05)
    basis = rng.standard_normal((decontamination.BUCKETS, 6)).astype(np.float32)
    out = np.zeros_like(basis)
    decontamination.gram_product(buckets, sizes, weights, basis, out, 3.0)
    rows = np.array([np.bincount(b, weights[b], 500) * 3 / np.sqrt((weights[b].astype(float) ** 2).sum()) for b in np.split(buckets, np.cumsum(sizes)[:-1])])
    want = rows.T @ (rows @ basis[:500])
    assert np.allclose(out[:500], want, atol=1e-5 * np.abs(want).max()) and not out[500:].any()
