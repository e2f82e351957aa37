import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewater.llm import queries, tokens

PATH = public_tokenizers.path(tokens.VOCABULARY)
WHOLE = Tokenizer.from_file(PATH)


def count(text):
    return len(WHOLE.encode(text or "", add_special_tokens=False).ids)


def got(docs, **parameters):
    return sorted(((r.doc_id if r.doc_id is not None else -1), r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs, **parameters).collect())


def want(rows, limit=1024):
    return sorted(((i if i is not None else -1), len((t or "").encode()), count(t), count(t) > limit) for i, t, *_ in rows)


def test_every_real_text(spark, prose):
    rows = [(r.doc_id, r.text) for r in prose.collect()]
    assert got(prose) == want(rows)
    assert sorted(tuple(r) for r in queries.op11_token_counts(spark, "/root/testdata/sf0.001").collect()) == want(rows)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 2\n\t'st.,<|>é日本。， \x1c\x85") | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_stable_positions_split_the_encoding(text):
    """What lies before a stable position and what lies behind encode alone as they do together."""
    ids = WHOLE.encode(text, add_special_tokens=False).ids
    for m in tokens.STABLE.finditer(text):
        p = m.start()
        assert WHOLE.encode(text[:p], add_special_tokens=False).ids + WHOLE.encode(text[p:], add_special_tokens=False).ids == ids


def test_overlaps_are_spliced_and_widened(spark, frame):
    rng = random.Random(2)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 9))) for _ in range(300)]
    prose = " ".join(rng.choice(words) + rng.choice(["", ".", ",", "\n", "  ", "'s", "<|endoftext|>", "'t1"]) for _ in range(900))
    rows = [
        (1, prose),
        (2, "x" * 3000),  # no stable position at all
        (3, prose[:700] + "y" * 900 + prose[700:1500] + "-" * 450 + prose[1500:]),  # none for some overlaps in a row
        (4, "don't" * 500),
        (5, "日本語の文章" * 300 + "。" + "漢字" * 200),
        (6, " " * 1000 + "a" + "\n" * 777),
        (7, "<|endoftext|>" * 120),
        (8, "a1" * 700 + "é́" * 500),
        (9, "é" * 255 + " " + "🎉" * 300),
    ]
    docs = frame(*rows)
    for chunk, overlap in ((100, 20), (257, 64), (128, 128)):
        assert got(docs, chunk=chunk, overlap=overlap) == want(rows)
    with pytest.raises(ValueError):
        tokens.token_counts(docs, chunk=10, overlap=11)


def test_null_empty_repeated_and_extra_columns(frame):
    rows = [(1, None), (None, ""), (None, "two words"), (2, "same text here"), (2, "same text here"), (3, "word and " * 20_000)]
    for extra in ("tokens", "row"):
        docs = frame(*rows, extra=extra)
        assert got(docs, limit=3) == want(rows, 3)
    assert got(docs.limit(0)) == []
    assert got(frame((1, "a b c")), limit=2) == [(1, 5, 3, True)]
