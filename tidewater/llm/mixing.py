"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

Each source has a target of words and a schedule: a density over training time from 0 to 1. Its integral times the target is the
cumulative demand. A document sits at a word offset in its source's order; inverting the demand at that offset gives the time at
which training reaches it. Where demand exceeds the source, the order starts over: a document is taken up to three times.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import NO_ID, ROWS_PER_BUCKET, buckets_for, running_before, settle

# Weights by rank of the source, repeating; the most epochs; slope of each weight's schedule over time.
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
SLOPES = (-0.5, 0.0, 0.5)

WORD = "[^\\x20\\x09-\\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _pick(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def source_targets(rows: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, rank, target) from (source, size).

    Sources rank by code point, a missing one last; weights repeat by rank. Targets share the sum of all sizes by weight. One that
    would exceed ``most`` times its source stops there, and the excess is shared again; each round only sums the table of sources.
    """
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    count = totals.count()
    # sources that lie in one range of names keep together; the settled number of the range makes the ranks repeatable
    ranged = totals.repartitionByRange(buckets_for(count), F.col("source").asc_nulls_last())
    ranged = settle(ranged.withColumns({"__range": F.spark_partition_id(), "__one": F.lit(1)}), "mix-sources")
    ranked = running_before(ranged, [], F.col("__range"), [F.col("source").asc_nulls_last()], "__one", "rank")
    ranked = ranked.select("source", "source_size", "rank", _pick(weights, F.col("rank") % len(weights)).cast("long").alias("weight"))
    cap, level = F.col("source_size") * most, (0, 1)
    while True:
        # capped: weight * left / share > cap, in whole numbers
        above = F.col("weight").cast("decimal(38,0)") * level[0] > cap.cast("decimal(38,0)") * level[1]
        left, share = ranked.agg(F.coalesce(F.sum(F.col("source_size") - F.when(above, cap).otherwise(0)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if not share or (left, share) == level:
            break
        level = (left, share)
    left, share = level
    target = F.least(cap.cast("double"), F.lit(float(left)) * F.col("weight") / F.lit(float(share)))
    return ranked.select("source", "source_size", "rank", target.alias("target"))


def _arrival(share: Column, slope: Column) -> Column:
    """The time at which the integral of 1 + slope * (2 t - 1) reaches ``share``."""
    return 2 * share / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share))


def plan(rows: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, most: int = MOST_EPOCHS) -> DataFrame:
    """Adds source_size, target, before, taken and position to rows (doc_id, source, size, and others that are kept).

    The order inside a source is the MD5 of the doc_id, then size. ``before``: the source's words ahead of the document. ``taken``:
    its words below the target, whole epochs and a last part, so a source's taken words sum to its rounded target. ``position``:
    when training first reaches it; documents that are not reached follow after 1. Missing doc_ids and sources are values like any
    other; repeated rows count each. ``rows`` should be settled, for it is read more than once.
    """
    sources = source_targets(rows, weights, most)
    # leading hex digits of the order key are a bucket; hot sources are thus cut into 256 parts or more
    digits = max(2, math.ceil(math.log(max(rows.count() / ROWS_PER_BUCKET, 1), 16)))
    keyed = rows.withColumn("__md5", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    order = [F.col("__md5"), F.col("size")]
    offset = running_before(keyed, [F.col("source")], F.substring("__md5", 1, digits), order, "size", "before")
    joined = offset.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    kept = [F.col(f"d.`{c}`") for c in rows.columns]
    joined = joined.select(*kept, "d.before", "s.source_size", "s.target", "s.rank")
    goal = F.round("target").cast("long")
    part = [F.greatest(F.lit(0), F.least(F.col("size"), goal - F.col("before") - F.col("source_size") * e)) for e in range(most)]
    slope = _pick(slopes, F.col("rank") % len(slopes))
    reached = F.when(goal > F.col("before"), _arrival(F.col("before") / goal, slope)).otherwise(1 + F.col("before") / F.greatest(F.col("source_size"), F.lit(1)))
    return joined.withColumns({"taken": sum(part[1:], part[0]), "position": reached, "__goal": goal, "__slope": slope}).drop("rank")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, most: int = MOST_EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, position) of every row of ``docs``, in training order.

    Words are ``[^\\x20\\x09-\\x0D]+``; a missing text has none. See :func:`plan` for the rest. An empty table gives an empty one.
    """
    rows = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words_in(F.col("text")).alias("size")), "mix-sizes")
    found = plan(rows, weights, slopes, most)
    return found.select("doc_id", "source", "size", "source_size", "target", "taken", "position").orderBy("position", "doc_id")


def _head(text: Column, words: Column) -> Column:
    """The text up to its ``words``-th word, white space in between as it was."""
    starts = F.split(F.regexp_replace(text, "^[\\x20\\x09-\\x0D]+", ""), "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])")
    return F.rtrim(F.array_join(F.slice(starts, 1, words.cast("int")), ""))


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, most: int = MOST_EPOCHS) -> DataFrame:
    """The mix itself: ``docs`` as training reads them, with all columns, sorted by position.

    A document comes once for each epoch that takes it; one at the edge of a target comes with its first words only (its n_chars
    follows, if there is such a column). Documents of which nothing is taken don't come.
    """
    plain = [f.name for f in docs.schema if not isinstance(f.dataType, T.MapType)]
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__hash": F.xxhash64(*plain)})
    rows = settle(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words_in(F.col("text")).alias("size"), "__id", "__hash"), "mix-sizes")
    found = plan(rows, weights, slopes, most).select("__id", "__hash", F.col("before").alias("__before"), F.col("source_size").alias("__source_size"), F.col("size").alias("__words"), "__goal", "__slope")
    # repeated rows: one text meets the plan's row of each
    keyed = keyed.dropDuplicates(["__id", "__hash"])
    at = F.col("__before") + F.col("__source_size") * F.col("__epoch")
    part = F.least(F.col("__words"), F.col("__goal") - at)
    text = F.when(F.col("__part") < F.col("__words"), _head(F.col("text"), F.col("__part"))).otherwise(F.col("text"))
    out = keyed.join(found, ["__id", "__hash"]).withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    out = out.withColumn("__part", part).where("__part > 0").withColumn("__at", _arrival(at / F.col("__goal"), F.col("__slope")))
    changed = {"text": text} | ({"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {})
    for name, value in changed.items():
        out = out.withColumn(name, value)
    return out.repartitionByRange("__at", "__id", "__hash", "__epoch").sortWithinPartitions("__at", "__id", "__hash", "__epoch").select(*docs.columns)
