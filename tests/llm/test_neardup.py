import random
from collections import Counter

import numpy as np

from tidewater.llm import neardup


def alike(a, b):
    """Jaccard similarity of sets of five-word shingles, word by word."""
    sets = []
    for text in (a, b):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def planted(rng, n_texts=120, copies=3):
    vocabulary = ["".join(rng.choices("abcdefghijklmnoprstuvwyz", k=rng.randint(2, 9))) for _ in range(4000)]
    texts = []
    for _ in range(n_texts):
        words = rng.choices(vocabulary, k=rng.choice([60, 120, 300, 900]))
        texts.append(" ".join(words))
        for _ in range(copies):
            edited = list(words)
            kind = rng.random()
            if kind < 0.7:  # single words replaced
                for _ in range(max(1, int(len(words) * rng.uniform(0.002, 0.02)))):
                    edited[rng.randrange(len(words))] = rng.choice(vocabulary)
            else:  # words put in or left out
                at = rng.randrange(len(words))
                edited[at : at + rng.randint(0, 2)] = rng.choices(vocabulary, k=rng.randint(0, 2))
            texts.append(" ".join(edited))
    return texts


def test_finds_planted_near_copies(spark, frame):
    texts = planted(random.Random(11))
    want = [(i, j) for i in range(len(texts)) for j in range(i - i % 4, i) if 0.8 <= alike(texts[i], texts[j]) < 0.98]
    got = {r.id: r.component for r in neardup.groups(frame(*enumerate(texts))).collect()}
    assert len(got) == len(texts) and len(want) > 150
    assert sum(got[i] == got[j] for i, j in want) >= 0.95 * len(want)
    # nothing else is joined: the rows of a group come from one text
    assert all(len({i // 4 for i in members}) == 1 for members in _members(got))


def _members(got):
    out = {}
    for i, c in got.items():
        out.setdefault(c, []).append(i)
    return out.values()


def test_a_large_group_of_near_copies_is_one(spark, frame):
    rng = random.Random(5)
    words = [f"w{rng.randrange(9000)}" for _ in range(200)]
    texts = []
    for i in range(400):
        edited = list(words)
        edited[i % 200] = f"other{i}"
        texts.append(" ".join(edited))
    assert alike(texts[0], texts[1]) > 0.8
    kept = neardup.drop_near_duplicates(frame(*enumerate(texts), (1000, "quite another text with words of its own here"))).collect()
    assert sorted(r.doc_id for r in kept) == [0, 1000]


def test_below_the_threshold_stays(spark, frame):
    words = [f"w{i}" for i in range(60)]
    far = [*words[:20], *[f"x{i}" for i in range(15)], *words[35:]]
    assert alike(" ".join(words), " ".join(far)) < 0.8
    assert neardup.drop_near_duplicates(frame((1, " ".join(words)), (2, " ".join(far)))).count() == 2


def test_null_empty_repeated_and_extra_columns(frame):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A b  c\td e f"), (None, "a b c d e f"), (9, ""), (8, None), (None, "only here now"), (7, "x y " * 50_000), (4, "x y " * 49_999)]
    docs = frame(*rows, extra="node")
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(3, "A b  c\td e f"), (8, None), (None, "only here now"), (4, "x y " * 49_999)])
    same = frame((1, "one two three"), (1, "one two three"))
    assert neardup.drop_near_duplicates(same).count() == 1
    assert neardup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_texts_that_share_words_but_no_passages_are_not_compared(spark, frame, monkeypatch):
    settled, seen = neardup.settle, Counter()

    def counted(df, label):
        out = settled(df, label)
        seen[label] += out.count()
        return out

    monkeypatch.setattr(neardup, "settle", counted)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(90)]
    texts = [" ".join(rng.sample(words, 90)) for _ in range(40)]  # one fingerprint, 780 pairs of no similarity
    copy = texts[0].replace("w5 ", "other ")
    assert alike(texts[0], copy) >= 0.8
    kept = neardup.drop_near_duplicates(frame(*enumerate(texts), (99, copy))).collect()
    assert sorted(r.doc_id for r in kept) == list(range(40))
    assert seen["near-close"] <= 3


def test_sketches_tell_the_similarity():
    rng = np.random.default_rng(2)
    most = neardup.most_sketch_bits(0.8, neardup.SKETCH_LANES)
    for size in (1, 40, 300, 5000):
        a = rng.integers(0, 2**64, size, dtype=np.uint64)
        b = np.concatenate([a[size // 9 :], rng.integers(0, 2**64, size // 9, dtype=np.uint64)])
        far = np.concatenate([a[size // 2 :], rng.integers(0, 2**64, size // 2 + 1, dtype=np.uint64)])
        bits = [sum(int(x).bit_count() for x in (neardup.sketch(a) ^ neardup.sketch(other)).view(np.uint64)) for other in (a, b, far)]
        assert neardup.jaccard(np.unique(a), np.unique(b)) >= 0.8 and bits[0] == 0 and bits[1] <= most < bits[2]
