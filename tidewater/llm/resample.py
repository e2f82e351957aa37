"""Quality by importance resampling.

Two bag-of-n-grams models, each a distribution over hashed unigrams and bigrams, describe target text (labelled good) and raw text (all
of it). A document's log weight is the sum over its n-grams of the log ratio of the two. Adding Gumbel noise to the log weights and
taking the top k samples k documents without replacement, in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import settle

#: Buckets of hashed n-grams.
BUCKETS = 10_000

#: Target documents that the target model reads at most: those with the least hash of their doc_id. The raw model reads everything.
MOST_TARGETS = 50_000

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SHIFTS = (np.uint64(30), np.uint64(27), np.uint64(31))
_MULTIPLIERS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class NGrams:
    """Hash buckets of a text's unigrams and bigrams, in array operations over its bytes.

    A token is a run of letters, digits and non-ASCII bytes, or one of other visible bytes. Its hash is a polynomial over its bytes,
    from differences of prefix sums modulo 2^64.
    """

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = np.uint64(buckets)
        kinds = np.ones(256, np.int8)
        kinds[list(b" \t\n\r\x0b\x0c")] = 0
        kinds[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") + list(range(128, 256))] = 2
        self.kinds = kinds
        self.powers, self.inverses = _powers(_BASE, 1), _powers(_INVERSE, 1)

    def _mixed(self, x: np.ndarray) -> np.ndarray:
        for shift, factor in zip(_SHIFTS, _MULTIPLIERS):
            x = (x ^ (x >> shift)) * factor
        return x ^ (x >> _SHIFTS[2])

    def of(self, data: bytes) -> np.ndarray:
        raw = np.frombuffer(data, np.uint8)
        if not len(raw):
            return np.empty(0, np.int64)
        if len(self.powers) < len(raw):
            size = 1 << len(raw).bit_length()
            self.powers, self.inverses = _powers(_BASE, size), _powers(_INVERSE, size)
        kind = self.kinds[raw]
        edges = np.flatnonzero(np.diff(kind)) + 1
        starts, ends = np.concatenate(([0], edges)), np.append(edges, len(raw))
        visible = kind[starts] > 0
        starts, ends = starts[visible], ends[visible]
        if not len(starts):
            return np.empty(0, np.int64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[: len(raw)], dtype=np.uint64)))
        one = self._mixed((sums[ends] - sums[starts]) * self.inverses[starts] + _FACTOR)
        two = self._mixed(one[:-1] * _FACTOR + one[1:])
        return (np.concatenate((one, two)) % self.buckets).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """The fifth of the labels that the target model never reads, for measuring."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most: int = MOST_TARGETS) -> np.ndarray:
    """Log of target over raw probability of each bucket, with half a count added to either.

    Raw counts are over all documents; target counts over at most ``most`` documents labelled good (quality 1) and not held out. A
    doc_id with contradictory labels is none. Without target documents all ratios are 0.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").where(~held_out(F.col("doc_id")))
    sample = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", F.lit(True).alias("target"))

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, raw, target = NGrams(buckets), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for frame in batches:
            for data, good in zip(frame["text"], frame["target"]):
                found = np.bincount(grams.of(data), minlength=buckets)
                raw += found
                if good:
                    target += found
        yield pd.DataFrame({"bucket": np.arange(buckets), "raw": raw, "target": target})[raw > 0]

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    # the sample is bounded by ``most`` numbers
    texts = texts.join(F.broadcast(sample), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    sums = texts.mapInPandas(counts, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.full(buckets, 0.5), np.full(buckets, 0.5)
    for r in sums.collect():  # one row for each bucket
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    if target.sum() == 0.5 * buckets:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``doc_id``, n_grams, log_weight and mean_ratio of each row; a text without n-grams has 0."""
    columns = "doc_id long, n_grams long, log_weight double, mean_ratio double"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = NGrams(len(ratios))
        for frame in batches:
            found = [grams.of(data) for data in frame["text"]]
            sizes = np.array([len(x) for x in found], np.int64)
            sums = np.array([ratios[x].sum() for x in found], float)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n_grams": sizes, "log_weight": sums, "mean_ratio": sums / np.maximum(sizes, 1)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInPandas(rows, columns)


def gumbel(seed: int, *key: str) -> Column:
    """Gumbel noise from a hash of ``key``, so that reruns agree."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def kth_largest(rows: DataFrame, column: str, k: int, fetch: int = 10_000) -> float | None:
    """The k-th largest value of ``column``, exactly; None if there are fewer.

    Rounds of a 1000-part histogram narrow the range until at most ``fetch`` different values remain, which the driver reads.
    """
    low, high, above = *rows.agg(F.min(column), F.max(column)).first(), 0
    if k < 1 or low is None:
        return None
    inside = rows.select(column)
    while True:
        few = inside.groupBy(column).count().orderBy(F.desc(column)).limit(fetch + 1).collect()
        if len(few) <= fetch:
            for value, count in few:
                above += count
                if above >= k:
                    return value
            return None
        part = F.least(F.floor((F.col(column) - low) / ((high - low) / 1000)), F.lit(999))
        cut = inside.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("part")).collect()
        for r in cut:
            if above + r.n >= k:
                low, high = r.low, r.high
                inside = inside.where(F.col(column).between(low, high))
                break
            above += r.n
        else:
            return None


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 42) -> DataFrame:
    """(doc_id, n_grams, log_weight, mean_ratio, sample_key, selected) of each row of ``docs``.

    ``selected`` marks the top k by sample_key = log_weight + Gumbel noise, k being ``share`` of the rows; by default the share of good
    labels among all. Rows that tie with the k-th are selected with it (repeated rows have the same noise); a missing doc_id has its own
    noise from its weight. Missing texts are empty. ``docs`` needs doc_id and text, ``labels`` doc_id and quality.
    """
    found = weights(docs, log_ratios(docs, labels)).withColumn("sample_key", F.col("log_weight") + gumbel(seed, "doc_id", "log_weight"))
    found = settle(found, "resample")
    if share is None:
        share = labels.where("quality in (0, 1)").agg(F.coalesce(F.avg("quality"), F.lit(1.0))).first()[0]
    least = kth_largest(found, "sample_key", round(share * found.count()))
    chosen = F.lit(False) if least is None else F.col("sample_key") >= least
    return found.withColumn("selected", chosen)
