import hashlib

import numpy as np
import pytest

from tidewater.llm import sketch
from tidewater.llm.sketch import SHINGLE_WORDS, compare, keep, merge


def true_set(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + SHINGLE_WORDS]) for i in range(max(1, len(words) - SHINGLE_WORDS + 1))} if words else set()


def test_every_row_beside_its_next(prose):
    rows = sorted((r.doc_id, r.text) for r in prose.collect())
    got = {r.doc_id: r for r in sketch.edited_fingerprints(prose.repartition(5)).collect()}
    assert len(got) == len(rows)
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        part = len(text) // 4
        changed = text[: len(text) - part] + following[:part]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        own, other, after = (sketch.sketch(t.encode()) for t in (text, changed, following))
        assert bytes(r.sketch) == own.astype(">u8").tobytes() and bytes(r.edited_sketch) == other.astype(">u8").tobytes()
        assert r.near_edited == compare(own, other)[0] and r.near_next == compare(own, after)[0]


def test_ranges_meet_at_their_bounds(prose, monkeypatch):
    whole = sorted(tuple(r) for r in sketch.edited_fingerprints(prose).collect())
    monkeypatch.setattr(sketch, "ROWS_PER_RANGE", 7)
    assert sorted(tuple(r) for r in sketch.edited_fingerprints(prose).collect()) == whole


def test_estimates_and_merging(prose):
    texts = [r.text for r in prose.collect()][:60]
    errors = []
    for a, b in zip(texts, texts[1:]):
        both = a + "\n" + b
        x, y = sketch.sketch(a.encode()), sketch.sketch(both.encode())
        s, t = true_set(a), true_set(both)
        errors.append(abs(compare(x, y)[0] - len(s & t) / len(s | t)))
        if len(a.split()) >= SHINGLE_WORDS:
            assert compare(x, y)[1] > 0.9  # contained, however unequal
    assert np.mean(errors) < 0.06
    rng = np.random.default_rng(5)
    for size in (5, 40, 5000):
        h = rng.integers(0, 2**63, (2, size), dtype=np.uint64) * np.uint64(2)
        assert merge(keep(h[0]), keep(h[1])).tolist() == keep(h.ravel()).tolist()


def test_nulls_empties_and_repeated_rows(frame):
    docs = frame((4, "a b c d e f g h"), (4, "a b c d e f g h"), (None, None), (7, ""), extra="sketch")
    got = sorted((r.doc_id or 0, r.n_chars, r.near_next) for r in sketch.edited_fingerprints(docs).collect())
    assert got == [(0, 0, 0.0), (4, 15, 0.0), (4, 15, 1.0), (7, 0, 1.0)]
    assert sketch.edited_fingerprints(docs.limit(0)).count() == 0
    one = sketch.edited_fingerprints(frame((1, "alone here"))).collect()
    assert len(one) == 1 and one[0].near_next == pytest.approx(1.0)
