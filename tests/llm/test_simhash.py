import random
from collections import Counter

import numpy as np
import xxhash

from tidewater.llm import components, queries, simhash


def slow_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if c == " " or "\x09" <= c <= "\x0d":
            words += [word] if word else []
            word = ""
        else:
            word += c
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints):
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((a for a, h in zip(ids, group) if h == g and a is not None), default=None) for g in group}
    return [least[g] for g in group]


def test_fingerprints_and_components_of_real_texts(spark, prose):
    rows = sorted((r.doc_id, r.text) for r in prose.collect())
    ids, prints = [r[0] for r in rows], [slow_fingerprint(r[1]) for r in rows]
    want = [(a, f"{p:016x}", c) for a, p, c in zip(ids, prints, slow_components(ids, prints))]
    got = queries.op1_simhash(spark, "/root/testdata/sf0.001").collect()
    assert sorted(tuple(r) for r in got) == want


def test_golay_code_covers_every_word_once():
    words = np.arange(1 << 23, step=61)
    assert set(simhash.codeword_index(words)) == set(range(4096))
    assert {len(set(x)) for x in simhash.nearby_indices(words).tolist()} == {1, 6}


def test_links_are_complete(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = {b ^ sum({1 << x for x in rng.sample(range(64), n)}) for b in base for n in (0, 1, 2, 3, 3, 3, 4)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    mask = (1 << 64) - 1
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & mask).count("1") <= 3}
    assert got == want and len(want) > 100


def test_chain_is_one_component(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_null_empty_repeated_and_extra_columns(frame):
    rows = [(5, "a b c d"), (5, "a b c d"), (3, "A b  c\td"), (None, "a b c d"), (9, ""), (8, None), (None, "only here now"), (7, "x" * 100_000)]
    docs = frame(*rows, extra="fp")
    found = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.component_id) for r in found) == Counter({(5, 3): 2, (3, 3): 1, (None, 3): 1, (9, 8): 1, (8, 8): 1, (None, None): 1, (7, 7): 1})
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(3, "A b  c\td"), (8, ""), (0, "only here now"), (7, "x" * 100_000)])
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0
