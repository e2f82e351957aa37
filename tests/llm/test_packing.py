import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewater.llm import packing

PATH = public_tokenizers.path(packing.VOCABULARY)
WHOLE = Tokenizer.from_file(PATH)
ENCODER = packing.Encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abEé İßΣς\n\t'._<|>12½日́ \x1c") | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_chunks_give_the_ids_of_the_whole(text):
    assert ENCODER.ids(text.encode()) == np.array(WHOLE.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_special_strings_inside_texts():
    for text in ("a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "don't I'LL x_y", "A" * 200):
        assert ENCODER.ids(text.encode()) == np.array(WHOLE.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_round_trip_of_real_texts(prose):
    cut = packing.pieces(prose).collect()
    assert all(len(r.ids) == 4 * r.length and r.length & (r.length - 1) == 0 and r.length <= 4096 for r in cut)
    parts = defaultdict(dict)
    for r in cut:
        parts[r.doc_id][r.start] = bytes(r.ids)
    for r in prose.collect():
        ids = np.frombuffer(b"".join(parts[r.doc_id][k] for k in sorted(parts[r.doc_id])), "<u4").tolist()
        assert ids == WHOLE.encode(r.text, add_special_tokens=False).ids + [2]
    packed = packing.pack(prose).collect()
    assert len({r.sequence_id for r in packed}) == len(packed) == len(cut) and all(r.offset == 0 for r in packed)
    assert {(r.doc_id, r.start, r.ids_crc32) for r in packed} == {(r.doc_id, r.start, zlib.crc32(r.ids)) for r in cut}
    again = {(r.doc_id, r.start): r.sequence_id for r in packing.pack(prose.repartition(7)).collect()}
    assert again == {(r.doc_id, r.start): r.sequence_id for r in packed}


def test_nulls_empties_and_repeated_rows(frame):
    docs = frame((1, None), (None, ""), (2, "hello world"), (2, "hello world"), (3, "word " * 30_000), extra="length")
    got = packing.pack(docs).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in got if (r.doc_id or 0) < 2) == [(0, 1), (1, 1)]
    assert sum(r.length for r in got if r.doc_id == 3) == 30_001 and sum(r.length for r in got if r.doc_id == 2) == 6
    assert packing.pack(docs.limit(0)).count() == 0
    assert packing.binary_lengths(0) == [] and packing.binary_lengths(8200) == [4096, 4096, 8]
