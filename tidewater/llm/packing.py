"""Sequence packing by power-of-two decomposition.

A document's ids are cut into full sequences and then into pieces of the binary digits of what is left, longest first. Every piece
is a sequence of its own whose length is a power of two: nothing is padded, no sequence crosses documents, and sequences of one
length form a bucket.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewater.llm.common import ROWS_PER_BUCKET, buckets_for, running_before, settle

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
MAX_TOKENS = 4096

#: Entries of one generation of a worker's memory of encoded chunks; two generations take about 150 MB.
CACHE_ENTRIES = 300_000


def _byte_letters() -> str:
    """The visible letter that byte-level vocabularies use for each byte value: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(spare)) for b in range(256))


class Encoder:
    """Ids of whole texts, put together from remembered chunks between white space.

    The vocabulary's rules never look across white space, so a text's ids are those of its chunks. A chunk of Latin letters, with
    punctuation behind or not, goes straight to the merge model; everything else through the whole tokenizer.
    """

    SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]{0,64})([!-&(-/:;=-@\[-`{-~]{0,64})")

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(_byte_letters()))
        self.chunks: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, text: str) -> bytes:
        if (found := self.pieces.get(text)) is None:
            shown = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
            found = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            if len(self.pieces) >= CACHE_ENTRIES:
                self.pieces.clear()
            self.pieces[text] = found
        return found

    def _learn(self, chunk: bytes) -> bytes:
        if len(chunk) >= 64:
            return self._whole(chunk.decode())
        if (found := self.chunks.get(chunk)) is not None:
            return found  # learnt further up in the same text
        if (found := self.older.get(chunk)) is None:
            text = chunk.decode()
            if text.isascii() and text.isalpha():
                found = self._piece(text.lower())
            elif simple := self.SIMPLE.fullmatch(text):
                word, marks = simple.groups()
                found = (self._piece(word.lower()) if word else b"") + (self._piece(marks) if marks else b"")
            else:
                found = self._whole(text)
        if len(self.chunks) >= CACHE_ENTRIES:
            # the full generation becomes the old one, from which used chunks move over
            self.chunks, self.older = {}, self.chunks
        self.chunks[chunk] = found
        return found

    def ids(self, data: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of a UTF-8 text."""
        chunks = data.split()
        found = list(map(self.chunks.get, chunks))
        if None in found:
            learn = self._learn
            found = [learn(chunk) if x is None else x for chunk, x in zip(chunks, found)]
        return b"".join(found)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process, kept from task to task."""
    return Encoder(path)


def binary_lengths(tokens: int, most: int = MAX_TOKENS) -> list[int]:
    """Lengths of a document's pieces: full ones, then the binary digits of the rest, longest first."""
    rest = tokens % most
    return [most] * (tokens // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, path: str | None = None, end_id: int = END_ID, most: int = MAX_TOKENS, place: Column | None = None) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids) for each piece of each document; ids are little-endian unsigned 32-bit numbers.

    With ``place``, a long for each document, its pieces have it too.

    ``docs`` has doc_id and text; further columns are left out. A missing text is empty: its only id is the end. Repeated rows are
    documents of their own, and a missing doc_id stays missing. ``most`` is a power of two.
    """
    if most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    path = path or public_tokenizers.path(VOCABULARY)
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["doc_id", "start", "length", "doc_tokens", "ids"] + (["place"] if place is not None else [])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).ids
        for frame in batches:
            for at in range(0, len(frame), 256):
                out: tuple[list, ...] = tuple([] for _ in names)
                placed = frame["place"][at : at + 256] if "place" in names else repeat(None)
                for doc_id, data, n in zip(frame["doc_id"][at : at + 256], frame["text"][at : at + 256], placed):
                    ids = encode(data) + end
                    total, start = len(ids) // 4, 0
                    for length in binary_lengths(total, most):
                        for column, value in zip(out, (doc_id, start, length, total, ids[4 * start : 4 * (start + length)], n)):
                            column.append(value)
                        start += length
                yield pd.DataFrame(dict(zip(names, out))).astype({"doc_id": "Int64"})

    more = [place.alias("place")] if place is not None else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), *more)
    return rows.mapInPandas(cut, "doc_id long, start long, length long, doc_tokens long, ids binary" + (", place long" if more else ""))


def number_sequences(cut: DataFrame, mark: Column) -> DataFrame:
    """Adds sequence_id and offset to pieces. Each piece is a whole sequence: offset 0, and an id from its number in its bucket.

    The number counts the pieces of one length, dealt out by a hash of (doc_id, start, ``mark``); the id is 16 times it plus the
    bucket's power of two. Only the columns of ``cut`` travel, so drop or digest the ids first. Reruns agree.
    """
    cut = settle(cut.withColumns({"__one": F.lit(1), "__mark": mark}), "pieces")
    spread = F.pmod(F.xxhash64("doc_id", "start", "__mark"), F.lit(buckets_for(cut.count(), 64)))
    power = F.length(F.bin("length")) - 1
    order = [F.col("doc_id").asc_nulls_last(), F.col("start"), F.col("__mark")]
    numbered = running_before(cut, [power], spread, order, "__one", "__n")
    return numbered.withColumns({"sequence_id": F.col("__n") * 16 + power, "offset": F.lit(0).cast("long")}).drop("__one", "__mark", "__n")


def pack(docs: DataFrame, path: str | None = None, end_id: int = END_ID, most: int = MAX_TOKENS) -> DataFrame:
    """One row for each piece: (doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset), without the ids themselves.

    Null and repeated rows as in :func:`pieces`; an empty table gives an empty one. The ids of a piece are in ``pieces``.
    """
    cut = pieces(docs, path, end_id, most).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return number_sequences(cut, F.col("ids_crc32"))


def pack_in_order(docs: DataFrame, path: str | None = None, end_id: int = END_ID, most: int = MAX_TOKENS) -> DataFrame:
    """As :func:`pack`, for documents stored in training order: adds position and numbers the sequences of each bucket by it.

    ``docs`` is a table read from the files that a sorted one was written to, one file after the other; part numbers and row numbers
    in the files say the order, however the reader deals them out. ``position`` numbers the documents from 0, so the times a document
    is taken are told apart. Pieces of one document follow each other by start.
    """
    name = F.col("_metadata.file_name")
    part, chunk = (F.regexp_extract(name, pattern, 1).try_cast("long") for pattern in ("^part-(\\d+)", "-c(\\d+)\\."))
    place = F.shiftleft(part, 42) + F.shiftleft(F.coalesce(chunk, F.lit(0).cast("long")), 30) + F.col("_metadata.row_index")
    cut = pieces(docs, path, end_id, most, place).withColumns({"ids_crc32": F.crc32("ids"), "__first": (F.col("start") == 0).cast("long")}).drop("ids")
    cut = settle(cut, "placed-pieces")
    # files, cut into ranges of rows; every document has one piece that starts at 0
    order = [F.col("place"), F.col("start")]
    numbered = running_before(cut, [], F.expr(f"place div {ROWS_PER_BUCKET}"), order, "__first", "__n")
    numbered = numbered.withColumn("position", F.col("__n") + F.col("__first") - 1).withColumn("__one", F.lit(1))
    power = F.length(F.bin("length")) - 1
    numbered = settle(numbered.drop("__n", "__first"), "numbered-pieces")
    out = running_before(numbered, [power], F.expr(f"position div {ROWS_PER_BUCKET // 16}"), [F.col("position"), F.col("start")], "__one", "__n")
    out = out.withColumns({"sequence_id": F.col("__n") * 16 + power, "offset": F.lit(0).cast("long")})
    return out.select("doc_id", "start", "length", "doc_tokens", "ids_crc32", "position", "sequence_id", "offset")
