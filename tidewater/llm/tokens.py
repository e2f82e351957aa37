"""Token counts of whole texts; huge ones are encoded in overlapping chunks that are put together again where both sides provably agree.

A text of up to ``CHUNK`` characters goes to the tokenizer as it is. A longer one is cut into chunks, each with the first ``OVERLAP``
characters of the next behind it, which are encoded by any number of tasks, offsets included. Two neighbours are spliced at a position
of their overlap that is

* stable: the characters on both sides alone prove that the vocabulary's rules start anew there, whatever stands further off. No
  pre-token goes on from a visible character to white space, or between a letter and a digit, and no special string has such a place;
* common: a token starts there in both encodings.

What lies before it is then encoded as in the whole text by the left chunk, and what lies behind by the right one. Where an overlap
has no such position, it is widened to all of the next chunk, as often as it takes: the chunks of the run become one, and only these
are encoded again. A text without any stable position is thus encoded whole, by one task, as there is no other exact way.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import settle, share_package

VOCABULARY = "byte_bpe_50k.json"
CHUNK = 32_768
OVERLAP = 512
LIMIT = 1024

#: Between a visible character and white space; between an ASCII letter and a digit; between an ideograph and its punctuation.
STABLE = re.compile(r"(?<=[!-~]|[^\W_])(?=[ \t\r\n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[一-鿿])(?=[，。、；：！？])|(?<=[，。、；：！？])(?=[一-鿿])")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a file, once for each worker process; the tasks are what runs in parallel."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def boundaries(text: str, starts: np.ndarray, low: int, high: int) -> tuple[list[int], list[int]]:
    """The stable positions in (low, high) at which a token starts, and the tokens before each."""
    places = np.array([m.start() for m in STABLE.finditer(text, max(low - 1, 0), min(high + 1, len(text))) if low < m.start() < high], np.int64)
    before = np.searchsorted(starts, places)
    real = before < len(starts)
    real[real] = starts[before[real]] == places[real]
    return places[real].tolist(), before[real].tolist()


def _cut(path: str, chunk: int, overlap: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each short text, with its tokens; rows with the chunks of each long one."""
        encoder = tokenizer(path)
        for frame in batches:
            short = frame["text"].str.len() <= chunk + overlap
            keys = frame.drop(columns="text").astype({"doc_id": "Int64"})
            for at in range(0, len(frame), 64):
                part = frame["text"].iloc[at : at + 64][short.iloc[at : at + 64]]
                if len(part):
                    counts = [len(e) for e in encoder.encode_batch_fast(part.tolist(), add_special_tokens=False)]
                    yield keys.loc[part.index].assign(number=0, own=0, piece=None, tokens=counts)
            for i, text in frame["text"][~short].items():
                for number, start in enumerate(range(0, len(text), chunk)):
                    yield keys.loc[[i]].assign(number=number, own=min(chunk, len(text) - start), piece=text[start : start + chunk + overlap], tokens=pd.array([None], "Int64"))

    return cut


def _encode(path: str, overlap: int):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Tokens of each chunk, and its boundaries in the overlaps with the chunk before (head) and the one behind (tail)."""
        encoder = tokenizer(path)
        for frame in batches:
            out: list[tuple] = []
            for row, number, own, piece in zip(frame["row"], frame["number"], frame["own"], frame["piece"]):
                found = encoder.encode(piece, add_special_tokens=False).offsets
                starts = np.array([a for a, _ in found], np.int64)
                head, tail = boundaries(piece, starts, 0, min(overlap, own)), boundaries(piece, starts, own, len(piece))
                # positions of the tail as the next chunk counts them
                out.append((row, number, len(starts), *head, [p - own for p in tail[0]], tail[1]))
            yield pd.DataFrame(out, columns=["row", "number", "tokens", "head", "head_before", "tail", "tail_before"])

    return encode


def _spliced(pieces: DataFrame, path: str, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(counts, failed): tokens of each text over its chunks, and the chunks whose overlap with the one before has no common boundary."""
    spread = max(pieces.sparkSession.sparkContext.defaultParallelism, -(-pieces.count() // 256))
    shape = "row long, number long, tokens long, head array<long>, head_before array<long>, tail array<long>, tail_before array<long>"
    encoded = settle(pieces.repartition(spread, "row", "number").mapInPandas(_encode(path, overlap), shape), "token-chunks")
    # only positions and counts meet here, never texts
    follows = Window.partitionBy("row").orderBy("number")
    seam = F.array_min(F.array_intersect("head", "__tail"))
    at = lambda places, counts: F.element_at(counts, F.array_position(places, F.col("__seam")).cast("int"))
    seams = encoded.withColumns({"__tail": F.lag("tail").over(follows), "__tail_before": F.lag("tail_before").over(follows), "__first": F.col("number") == 0})
    seams = seams.withColumn("__seam", seam)
    # a chunk takes over from the one before at the seam: what that one counts from there on, and what this one counts up to there, goes
    less = F.when(F.col("__first"), 0).otherwise(at("head", F.col("head_before")) - at("__tail", F.col("__tail_before")))
    last = F.lead("number").over(follows).isNull()
    seams = seams.withColumns({"__less": less, "__last": last})
    counts = seams.groupBy("row").agg((F.sum(F.when(F.col("__last"), F.col("tokens")).otherwise(0)) - F.sum("__less")).alias("tokens"))
    return counts, seams.where(~F.col("__first") & F.col("__seam").isNull()).select("row", "number")


def _widened(pieces: DataFrame, failed: DataFrame) -> DataFrame:
    """The chunks of the texts with failed overlaps, each failed one made part of the chunk before; texts that are whole stay out."""
    texts = failed.select("row").distinct()
    again = pieces.join(texts, "row", "left_semi").join(failed.withColumn("__failed", F.lit(1)), ["row", "number"], "left")
    runs = Window.partitionBy("row").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    numbered = again.select("row", "number", F.sum(F.coalesce(F.lit(1) - F.col("__failed"), F.lit(1))).over(runs).alias("run"))
    joined = again.drop("__failed").join(numbered, ["row", "number"])
    parts = joined.groupBy("row", "run").agg(F.array_sort(F.collect_list(F.struct("number", "own", "piece"))).alias("parts"))
    # all own parts but the last, which has its overlap behind it
    text = F.array_join(F.transform("parts", lambda p, i: F.when(i == F.size("parts") - 1, p["piece"]).otherwise(F.substring(p["piece"], F.lit(1), p["own"].cast("int")))), "")
    own = F.aggregate("parts", F.lit(0).cast("long"), lambda total, p: total + p["own"])
    return parts.select("row", (F.col("run") - 1).alias("number"), own.alias("own"), text.alias("piece"))


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs`` (doc_id, text; any others are left out).

    ``n_tokens`` is what the tokenizer file gives for the whole text, no special tokens added, those inside a text taken as the file
    says; ``n_bytes`` counts UTF-8 bytes, ``over_limit`` says whether there are more tokens than ``limit``. A missing text is empty and
    has none. Repeated rows and rows without a doc_id are texts of their own. An empty table gives an empty one.
    """
    if not 1 < overlap <= chunk:
        raise ValueError("the overlap has two characters at least and is no longer than a chunk")
    spark = docs.sparkSession
    share_package(spark)
    path = path or public_tokenizers.path(VOCABULARY)
    text: Column = F.coalesce(F.col("text"), F.lit(""))
    # a row's number is written with all that comes of the row, so it means one text whatever is tried again later
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    shape = "row long, doc_id long, n_bytes long, number long, own long, piece string, tokens long"
    cut = settle(rows.mapInPandas(_cut(path, chunk, overlap), shape), "token-texts")
    found = [cut.where("piece is null").select("doc_id", "n_bytes", "tokens")]
    heads = cut.where("piece is not null and number = 0").select("row", "doc_id", "n_bytes")
    pieces = cut.where("piece is not null").select("row", "number", "own", "piece")
    while pieces.head(1):
        counts, failed = _spliced(pieces, path, overlap)
        failed = settle(failed, "token-failed")
        whole = counts.join(failed.select("row").distinct(), "row", "left_anti")
        found.append(heads.join(whole, "row").select("doc_id", "n_bytes", "tokens"))
        pieces = settle(_widened(pieces, failed), "token-widened")
    counted = reduce(DataFrame.unionAll, found)
    return counted.select("doc_id", "n_bytes", F.col("tokens").alias("n_tokens"), (F.col("tokens") > limit).alias("over_limit"))
