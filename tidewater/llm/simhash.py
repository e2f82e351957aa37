"""SimHash near duplicates through fuzzy hashing with the perfect Golay code.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The binary (23, 12) Golay code covers every 23-bit word by exactly
one codeword within 3 errors, so a segment decodes to a 12-bit codeword index. A *nearby* key set holds the indices that the
segment and its 23 one-bit neighbours decode to: 1 or 6 of them. Two fingerprints that differ in 3 bits or fewer have, by the
pigeonhole principle, two segments with at most one error each; for those two, the own index of one fingerprint is among the nearby
indices of the other. The candidates of a pair of segments therefore meet on 24-bit keys: own keys on one side, nearby keys on the
other, and the join verifies the bit count in place.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import id_key, settle
from tidewater.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42

# The generator polynomial of the (23, 12) Golay code and the segments (shift, width) of a fingerprint.
GOLAY = 0b110001110101
SEGMENTS = ((41, 23), (18, 23), (0, 18))


def fingerprint_of(data: bytes, words: int = SHINGLE_WORDS) -> int:
    """Fingerprint of one UTF-8 text, unsigned. Fewer words than a shingle: the whole sequence counts as one; none: 0."""
    parts = data.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not parts:
        return 0
    joined = memoryview(b" ".join(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    span = min(words, len(parts))
    starts = np.concatenate(([0], ends[: len(parts) - span] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[span - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[at : at + (1 << 16)], dtype=">u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint_of(x) for x in texts], dtype=np.uint64).view(np.int64))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as a signed long; a missing text counts as empty."""
    return _fingerprints(F.coalesce(text, F.lit("")).cast("binary"))


def _syndromes(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


def _leaders() -> np.ndarray:
    """The error pattern, of 3 bits at most, of each of the 2048 syndromes."""
    patterns = [0] + [sum(1 << b for b in bits) for n in (1, 2, 3) for bits in combinations(range(23), n)]
    table = np.zeros(2048, np.int64)
    table[_syndromes(np.array(patterns))] = patterns
    return table


LEADERS = _leaders()


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    return (words ^ LEADERS[_syndromes(words)]) >> 11


def nearby_indices(words: np.ndarray) -> np.ndarray:
    """Row for each word: the 24 codeword indices of the word and its one-bit neighbours, repeats included."""
    return np.stack([codeword_index(words ^ flip) for flip in [0] + [1 << b for b in range(23)]], axis=1)


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each fingerprint its own keys (near false) and nearby keys (near true) over the three pairs of segments."""
    for frame in batches:
        for at in range(0, len(frame), 4096):
            value = frame["fp"].to_numpy(np.int64)[at : at + 4096]
            bits = value.view(np.uint64)
            words = [((bits >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64) for shift, width in SEGMENTS]
            own = [codeword_index(w) for w in words]
            near = []
            for w in words:
                found = np.sort(nearby_indices(w), axis=1)
                # repeats become -1; at most 6 differ, so 6 columns hold all
                found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
                near.append(-np.sort(-found, axis=1)[:, :6])
            for pair, (x, y) in enumerate(combinations(range(3), 2)):
                yield pd.DataFrame({"fp": value, "key": ((pair << 24) | (own[x] << 12) | own[y]).astype(np.int32), "near": False})
                grid = (pair << 24) | (near[x][:, :, None] << 12) | near[y][:, None, :]
                valid = (near[x][:, :, None] >= 0) & (near[y][:, None, :] >= 0)
                row, _, _ = np.nonzero(valid)
                yield pd.DataFrame({"fp": value[row], "key": grid[valid].astype(np.int32), "near": True})


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): each two of the distinct fingerprints (column fp) that differ in ``max_bits`` bits or fewer, 3 at most."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two of three segments hold one error at most only up to 3 bits in all")
    # fingerprints are few bytes but fan out to dozens of keys each, so they are dealt out by number and not by size
    spark = distinct.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-distinct.count() // 20_000))
    keys = distinct.select("fp").repartition(parts, "fp").mapInPandas(_keys, "fp long, key int, near boolean")
    keys = settle(keys, "simhash-keys")
    own = keys.where("not near").select(F.col("fp").alias("a"), "key")
    near = keys.where("near").select(F.col("fp").alias("b"), "key")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return own.join(near, (own["key"] == near["key"]) & close).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id, first_hash) for every row of ``docs`` (doc_id, text; further columns are left out).

    Equal fingerprints are one node, so a group of copies of any size costs one row in the search. ``component_id``: the least doc_id
    reachable, itself included; missing doc_ids don't count, and a component without any has a missing one. ``root`` names the
    component even then, and ``first_hash`` is the text hash of its first row by (doc_id, text_hash). Missing texts are empty ones;
    texts without words have fingerprint 0 and are linked like any other. Repeated rows come out repeatedly.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), fingerprint(F.col("text")).alias("fp"))
    rows = settle(rows, "simhash-rows")
    nodes = rows.groupBy("fp").agg(F.min(F.struct(id_key().alias("id"), "text_hash")).alias("first"))
    nodes = settle(nodes, "simhash-nodes")
    roots = components(links(nodes, max_bits)).withColumnRenamed("node", "fp")
    nodes = nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    heads = nodes.groupBy("root").agg(F.min("first").alias("head"))
    placed = nodes.join(heads, "root").select("fp", "root", "head")
    least = F.when(F.col("head.id") < F.lit(2**63 - 1), F.col("head.id"))
    return rows.join(placed, "fp").select("doc_id", "text_hash", "fp", "root", least.alias("component_id"), F.col("head.text_hash").alias("first_hash"))


def drop_near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: its first by (doc_id, missing last; text hash). All columns are kept."""
    found = near_duplicates(docs, max_bits).where("doc_id <=> component_id and text_hash = first_hash")
    kept = found.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    keyed = docs.withColumns({"__id": id_key(), "__hash": F.xxhash64(F.coalesce("text", F.lit("")))})
    # the join and the removal of repeated rows share one exchange
    return keyed.join(kept, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"]).select(*docs.columns)
