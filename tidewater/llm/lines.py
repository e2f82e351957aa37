"""Line dedup by log templates.

A fixed-depth tree routes a line by its token count and its leading tokens; below, fields that vary (tokens with a digit, an @ or a
URL scheme) stand for any value. What remains is the line's template. A template that recurs across documents stays in its first
document, by doc_id, and is dropped from all others. Only digests of templates travel; texts move once, to lose their lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import NO_ID, id_key, settle

#: Lines of fewer tokens always stay: all that have a token are compared.
LEAST_TOKENS = 1

#: Levels of leading tokens below the token count.
DEPTH = 2

ANY = b"<*>"
_VARIABLE = re.compile(rb"[0-9@]|://")


def template(line: bytes, depth: int = DEPTH) -> tuple[int, bytes, bytes] | None:
    """(token count, leading tokens, rest) of a line, varying tokens replaced; None for a line without tokens.

    A line in which all tokens vary is data and not a pattern: it is its own template, unmasked.
    """
    tokens = line.split()
    if not tokens:
        return None
    if _VARIABLE.search(line):
        masked = [ANY if _VARIABLE.search(t) else t for t in tokens]
        if masked.count(ANY) < len(tokens):
            tokens = masked
    return len(tokens), b" ".join(tokens[:depth]), b" ".join(tokens[depth:])


def _digests(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    digest = xxhash.xxh3_64_intdigest
    for frame in batches:
        for at in range(0, len(frame), 512):
            part = frame.iloc[at : at + 512]
            row, number, count, leaf, rest = [], [], [], [], []
            for i, data in enumerate(part["text"]):
                for n, line in enumerate(data.split(b"\n")):
                    found = template(line)
                    if found and found[0] >= least:
                        row.append(i)
                        number.append(n)
                        count.append(found[0])
                        # the leaf narrows its 64-bit digest: a false match needs the same count and leading tokens too
                        leaf.append(digest(found[1]) & 0x7FFFFFFF)
                        rest.append(digest(found[2]))
            head = part[["id", "text_hash"]].iloc[row].reset_index(drop=True)
            yield head.assign(line=np.array(number, np.int32), tokens=np.array(count, np.int32), leaf=np.array(leaf, np.int32), rest=np.array(rest, np.uint64).view(np.int64))


def recurring_lines(docs: DataFrame, least: int = LEAST_TOKENS) -> DataFrame:
    """(id, text_hash, line): each line (numbered from 0) of ``least`` tokens or more whose template stands in a document with a lesser doc_id.

    Missing doc_ids are one document after all others (``id`` is then 2^63 - 1). Lines end at ``\\n``; tokens are separated by ASCII
    white space. A frequent template is summed up to one row before it meets its lines.
    """
    rows = docs.select(id_key().alias("id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text")).where("text is not null")
    found = settle(rows.mapInPandas(lambda batches: _digests(batches, least), "id long, text_hash long, line int, tokens int, leaf int, rest long"), "line-templates")
    key = ["tokens", "leaf", "rest"]
    again = found.groupBy(*key).agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    # settled, so that the join deals out both sides itself and can split the rows of a frequent template
    again = settle(again, "line-recurring")
    return found.join(again, key).where("id > first").select("id", "text_hash", "line").distinct()


def _without(text: Column, gone: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(gone, i)), "\n")


def _joined(docs: DataFrame, least: int) -> DataFrame:
    gone = recurring_lines(docs, least).groupBy("id", "text_hash").agg(F.sort_array(F.collect_list("line")).alias("__gone"))
    keyed = docs.withColumns({"__id": id_key(), "__hash": F.xxhash64("text")})
    gone = gone.withColumnsRenamed({"id": "__id", "text_hash": "__hash"})
    return keyed.join(gone, ["__id", "__hash"], "left")


def _deduped(docs: DataFrame, least: int) -> DataFrame:
    """``docs`` without recurring lines, and their numbers as ``__dropped``."""
    out = _joined(docs, least).withColumn("__dropped", F.coalesce("__gone", F.array().cast("array<int>")))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("__gone")))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns, "__dropped")


def dedup_lines(docs: DataFrame, least: int = LEAST_TOKENS) -> DataFrame:
    """``docs`` with its columns and without recurring lines, plus dropped_lines (array of line numbers, empty if none).

    A missing text stays missing, an empty one empty; repeated rows are one document and all keep the same lines; lines of fewer than
    ``least`` tokens stay. ``n_chars``, if there, follows the text. A column of ``docs`` named dropped_lines gives way to the new one.
    """
    kept = [c for c in docs.columns if c != "dropped_lines"]
    return _deduped(docs, least).select(*kept, F.col("__dropped").alias("dropped_lines"))


def drop_repeated(docs: DataFrame) -> DataFrame:
    """As :func:`dedup_lines` over all lines that have a token, with the columns of ``docs`` alone and without the documents that lost lines and have no word left: all they held stands in an earlier one."""
    out = _deduped(docs, 1)
    emptied = (F.size("__dropped") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    return out.where(~emptied).drop("__dropped")
