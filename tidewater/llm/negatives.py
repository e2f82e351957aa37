"""Hard negatives by exact inner products of Kronecker-packed vectors.

Components are whole numbers. Raised by a bias they are at least 0, so the components that several candidates have in one dimension fit
side by side into fields of one wide integer, wide enough for any sum of products. One multiplication of that integer with an anchor's
raised component serves all its candidates at once; summed over the dimensions, each field holds one candidate's raised product, and
taking away what the biases added leaves the exact score. Where two fields or more fit into 53 bits, as for vectors of unit length,
the wide integer is held in a double, whose sums and products are exact below that; else in a 64-bit integer, and beyond in Python's own.

Anchors and rows are dealt into blocks, and each pair of blocks is one task's unit with bounded memory; only the best few scores of a
pair travel. A hot label is many blocks. Nothing is broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import settle
from tidewater.llm.topk import quantised

#: Rows of a block, on either side, and the anchors whose scores are in memory together.
BLOCK = 16_384
BATCH = 128

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of its positive's.
LEAST_SHARE, MOST_SHARE = 50, 95

#: A score that no field can hold: of pairs that don't count.
NONE = np.iinfo(np.int64).min


class Packed:
    """Candidates packed for anchors whose components lie within ``reach`` of 0."""

    def __init__(self, vectors: np.ndarray, reach: int):
        self.count, self.width = vectors.shape
        self.bias, self.reach = int(np.abs(vectors).max(initial=0)), int(reach)
        most = 4 * max(self.bias, 1) * max(self.reach, 1) * max(self.width, 1)  # raised components are at most twice the bias
        self.bits = most.bit_length()
        if self.bits <= 26:
            self.kind, self.fields = np.float64, 53 // self.bits
        elif self.bits <= 31:
            self.kind, self.fields = np.int64, 63 // self.bits
        else:
            self.kind, self.fields = object, 8
        groups = -(-self.count // self.fields)
        raised = np.zeros((groups * self.fields, self.width), object if self.kind is object else np.int64)
        raised[: self.count] = vectors
        raised[: self.count] += self.bias
        # field f of group g is candidate f * groups + g, so each field unpacks into a run of columns
        parts = raised.reshape(self.fields, groups, self.width)
        wide = parts[0].copy()
        for f in range(1, self.fields):
            wide += parts[f] << (self.bits * f)
        self.wide = np.ascontiguousarray(wide.T).astype(self.kind)
        self.sums = vectors.astype(object if self.kind is object else np.int64).sum(axis=1)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """The exact inner products of anchors (rows) with all candidates (columns)."""
        whole = object if self.kind is object else np.int64
        raised = anchors.astype(whole) + self.reach
        total = raised.astype(self.kind) @ self.wide
        total = total if self.kind is object else total.astype(np.int64)
        fields = [(total >> (self.bits * f)) & ((1 << self.bits) - 1) for f in range(self.fields)]
        out = np.concatenate(fields, axis=1)[:, : self.count]
        # (a + r)(c + b) = ac + b a + r c + r b, summed over the dimensions
        out = out - (self.bias * anchors.astype(whole).sum(axis=1))[:, None] - (self.reach * self.sums)[None, :] - self.width * self.reach * self.bias
        if whole is object and np.abs(out).max(initial=0) >= 1 << 62:
            raise OverflowError("a score has more than 62 bits")
        return out.astype(np.int64)


def _table(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _firsts(scores: np.ndarray, k: int):
    """For each row up to k columns, highest score first and ties to the first column; columns of score NONE don't count."""
    for _ in range(min(k, scores.shape[1])):
        at = scores.argmax(axis=1)
        best = scores[np.arange(len(scores)), at]
        yield at, best
        scores[np.arange(len(scores)), at] = NONE


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["vec_id", "row"], kind="stable", ignore_index=True)


def _positives(k: int, width: int):
    def best(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros(0, np.int64)] * 5
        parts = [found]
        if len(anchors) and len(rows):
            rows, table = _ordered(rows), _table(anchors["vector"], width)
            packed = Packed(_table(rows["vector"], width), np.abs(table).max(initial=0))
            ids, hashes = rows["vec_id"].to_numpy(np.int64), rows["row"].to_numpy(np.int64)
            for at in range(0, len(anchors), BATCH):
                part = anchors.iloc[at : at + BATCH]
                scores = packed.scores(table[at : at + BATCH])
                scores[part["vec_id"].to_numpy()[:, None] == ids[None, :]] = NONE
                for column, score in _firsts(scores, k):
                    ok = score > NONE
                    parts.append([part["vec_id"].to_numpy(np.int64)[ok], part["row"].to_numpy(np.int64)[ok], ids[column[ok]], hashes[column[ok]], score[ok]])
        columns = [np.concatenate(x) for x in zip(*parts)]
        return pd.DataFrame(dict(zip(["vec_id", "row", "positive_id", "positive_row", "positive_score"], columns)))

    return best


def _negatives(k: int, width: int, least: int, most: int):
    def best(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [[np.zeros(0, np.int64)] * 6]
        if len(anchors) and len(rows):
            rows, table = _ordered(rows), _table(anchors["vector"], width)
            packed = Packed(_table(rows["vector"], width), np.abs(table).max(initial=0))
            ids, hashes, labels = (rows[c].to_numpy(np.int64) for c in ("vec_id", "row", "label"))
            for at in range(0, len(anchors), BATCH):
                part = anchors.iloc[at : at + BATCH]
                who, which, label = (part[c].to_numpy(np.int64) for c in ("vec_id", "row", "label"))
                scores = packed.scores(table[at : at + BATCH])
                scores[(label[:, None] == labels[None, :]) | (who[:, None] == ids[None, :])] = NONE
                goals = part["goals"].tolist()
                for n in range(max(map(len, goals), default=0)):
                    held = np.array([i for i, g in enumerate(goals) if len(g) > n])
                    goal = np.array([int(goals[i][n]) for i in held], np.int64)
                    # whole numbers: 100 s <= 95 p is s <= floor(95 p / 100), 50 p <= 100 s is s >= ceil(50 p / 100)
                    whole, rest = np.divmod(goal, 100)
                    high, low = most * whole + most * rest // 100, least * whole - (-least * rest // 100)
                    fit = np.where(scores[held] <= high[:, None], scores[held], NONE)
                    for column, score in _firsts(fit, k):
                        ok = (score > NONE) & (score >= low)
                        if not ok.any():
                            break
                        parts.append([who[held][ok], which[held][ok], goal[ok], ids[column[ok]], hashes[column[ok]], score[ok]])
        columns = [np.concatenate(x) for x in zip(*parts)]
        return pd.DataFrame(dict(zip(["vec_id", "row", "goal", "negative_id", "negative_row", "negative_score"], columns)))

    return best


def _paired(anchors: DataFrame, rows: DataFrame, by: list[str], block: int):
    """Anchors and rows grouped so that each anchor meets each row once, by blocks of either within ``by``."""

    def counted(t: DataFrame, side: str) -> DataFrame:
        # blocks of each group of labels: a number for each label, or one in all
        n = t.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("long").alias(f"__{side}n"))
        return n if by else n.withColumn(f"__{side}n", F.greatest(f"__{side}n", F.lit(1)))

    sizes = counted(anchors, "a").join(counted(rows, "r"), by) if by else counted(anchors, "a").crossJoin(counted(rows, "r"))

    def dealt(t: DataFrame, own: str, other: str) -> DataFrame:
        joined = t.join(sizes, by) if by else t.crossJoin(sizes)
        place = F.pmod(F.xxhash64("number"), F.col(f"__{own}n")).alias(f"__{own}")
        return joined.select(*t.columns, place, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"__{other}n") - 1)).alias(f"__{other}"))

    keys = [*by, "__a", "__r"]
    left, right = dealt(anchors, "a", "r"), dealt(rows, "r", "a")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys))


def labelled(table: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, vector, row) from a table of floats: components quantised, labels shifted where vec_id is divisible by 7.

    Rows without vec_id or label, and those whose vector is missing or has a missing or non-finite component, stay out. ``row`` is a
    hash that orders rows of one vec_id.
    """
    shifted: Column = F.when(F.col("vec_id") % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label)).cast("long")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), shifted.alias("label"), quantised(F.col(vector)).alias("vector"))
    rows = rows.where("vec_id is not null and label is not null and vector is not null")
    return rows.withColumn("row", F.xxhash64("label", "vector"))


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST_SHARE, most: int = MOST_SHARE, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive.

    Both tables are as :func:`labelled` gives them, ``anchors`` being some of ``rows``. An anchor's positives are its best ``positives``
    rows of the same label, its negatives for one of them the best ``negatives`` rows of other labels with a score of ``least`` to
    ``most`` hundredths of the positive's; ties go to the lesser vec_id, then by ``row``. Rows with the anchor's own vec_id are neither.
    Repeated rows are rows of their own, on all sides. Vectors of unequal length count as filled up with zeros; an empty table gives
    an empty one. A score of over 62 bits is an error. An anchor without positives, or a positive without negatives, gives no row.
    """
    # a number deals out even rows that are equal in all else; it is written, so it stays
    number = F.monotonically_increasing_id()
    rows = settle(rows.select("vec_id", "label", "vector", "row", number.alias("number")), "negatives-rows")
    # equal anchors have equal results: they are searched once and come out as often as they stand there
    anchors = settle(anchors.groupBy("vec_id", "label", "vector", "row").agg(F.count("*").alias("times")).withColumn("number", number), "negatives-anchors")
    width = max(t.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0] for t in (rows, anchors))
    plain = anchors.drop("times")
    same = _paired(plain, rows, ["label"], block).applyInPandas(_positives(positives, width), "vec_id long, row long, positive_id long, positive_row long, positive_score long")
    first = Window.partitionBy("vec_id", "row").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    chosen = same.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    chosen = settle(chosen.drop("positive_row"), "negatives-positives")
    goals = chosen.groupBy("vec_id", "row").agg(F.array_sort(F.collect_set("positive_score")).alias("goals"))
    asked = settle(plain.join(goals, ["vec_id", "row"]), "negatives-asked")
    found = _paired(asked, rows, [], block).applyInPandas(_negatives(negatives, width, least, most), "vec_id long, row long, goal long, negative_id long, negative_row long, negative_score long")
    ranks = Window.partitionBy("vec_id", "row", "goal").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    ranked = found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= negatives)
    out = chosen.join(ranked.withColumnRenamed("goal", "positive_score"), ["vec_id", "row", "positive_score"]).join(anchors.select("vec_id", "row", "times"), ["vec_id", "row"])
    out = out.withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
