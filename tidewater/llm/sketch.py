"""Document fingerprints as threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so sketches of any two documents sample the same hashes:
they merge by union, and containment holds up between very unequal documents. A short text, of which the fraction would leave next to
nothing, keeps its least hashes instead; two sketches are compared over the range that both have kept in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import id_key

SHINGLE_WORDS = 5
SEED = 42

#: The part of the hash range that is always kept, and the number of least hashes that a sketch has at least (if the text has them).
FRACTION = 1 / 8
LEAST_HASHES = 32
LIMIT = np.uint64(int(FRACTION * 2**64) - 1)
_ALL = np.uint64(2**64 - 1)

#: Documents of one range of ids, and the most ranges: their bounds, one number each, go to every task.
ROWS_PER_RANGE = 1_000
MOST_RANGES = 100_000


def sketch(data: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted unsigned hashes of a UTF-8 text. Fewer words than a shingle: the whole sequence counts as one; none: empty."""
    parts = data.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = memoryview(b" ".join(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    span = min(words, len(parts))
    starts = np.concatenate(([0], ends[: len(parts) - span] + 1)).tolist()
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[span - 1 :].tolist())), np.uint64, len(starts))
    return keep(hashes)


def keep(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes."""
    low = np.unique(hashes[hashes <= LIMIT])
    return low if len(low) >= LEAST_HASHES else np.unique(hashes)[:LEAST_HASHES]


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two texts together, from theirs."""
    return keep(np.union1d(a, b))


def full_below(a: np.ndarray) -> np.uint64:
    """The hash up to which a sketch has kept everything: a short one is complete."""
    return _ALL if len(a) < LEAST_HASHES else max(a[-1], LIMIT)


def compare(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Estimates of (resemblance, containment of a in b). Two empty texts are alike; an empty one is contained in any."""
    top = min(full_below(a), full_below(b))
    a, b = a[: np.searchsorted(a, top, "right")], b[: np.searchsorted(b, top, "right")]
    shared = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - shared
    return shared / either if either else 1.0, shared / len(a) if len(a) else 1.0


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the beginning of ``following``, or all of it."""
    part = len(text) // 4
    return text[: len(text) - part] + following[:part]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, sketch binary, edited_sketch binary, near_edited double, near_next double, kept_in_edited double"


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each row beside the one behind it. Rows come sorted by range, then order; a range ends with the first row of the next."""
    last = None  # (range, id, text, sketch) of the row that waits for the one behind it
    for frame in batches:
        out = []
        for span, tail, doc_id, text in zip(frame["range"], frame["tail"], frame["doc_id"], frame["text"]):
            waits = last is not None and last[0] == span
            if tail and not waits:
                continue  # another row with the id of the boundary
            own = sketch(text.encode())
            if waits:
                before, before_id, before_text, before_sketch = last
                changed = edited(before_text, text)
                data = changed.encode()
                changed_sketch = sketch(data)
                alike, kept = compare(before_sketch, changed_sketch)
                out.append((before_id, len(before_text), hashlib.sha256(data).hexdigest(), before_sketch.astype(">u8").tobytes(), changed_sketch.astype(">u8").tobytes(), alike, compare(before_sketch, own)[0], kept))
            last = None if tail else (span, doc_id, text, own)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, sketch, edited_sketch, near_edited, near_next, kept_in_edited) of each row of ``docs``.

    The next document is that of the next doc_id; the last is followed by the first. Missing doc_ids come last; rows of one doc_id are
    in the order of a hash of their texts. Missing texts are empty. Sketches are big-endian 64-bit hashes.

    Texts travel once, to the range of their doc_id; only the first document of a range goes to the range before as well.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), id_key().alias("order"))
    ids = rows.select("order")
    ranges = min(MOST_RANGES, max(1, -(-ids.count() // ROWS_PER_RANGE)))
    least = ids.repartitionByRange(ranges, "order").groupBy(F.spark_partition_id()).agg(F.min("order").alias("order"))
    bounds = np.array(sorted({r[0] for r in least.select("order").collect()}), dtype=np.int64)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def placed(order: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, order.to_numpy(np.int64), "right") - 1
        first = bounds[at] == order.to_numpy(np.int64)
        return pd.Series([[a, (a - 1) % len(bounds)] if f else [a] for a, f in zip(at.tolist(), first.tolist())])

    dealt = rows.select("*", F.posexplode(placed("order")).alias("tail", "range")).withColumn("hash", F.xxhash64("text"))
    dealt = dealt.repartition("range").sortWithinPartitions("range", "tail", "order", "hash")
    return dealt.select("range", "tail", "doc_id", "text").mapInPandas(_rows, SCHEMA)
