"""Near duplicates by five-word shingles: SimHash candidates through Golay codes, links by exact Jaccard similarity.

The SimHash of :mod:`simhash` finds fingerprints a few bits apart. Texts whose shingle sets overlap by 0.8 lie further apart, so this
operator has its own fingerprint: 384 bits over the distinct words of a text (an edit changes five shingles but one word: measured on
copies of 0.8 and more, 3 to 11 % of these bits differ, and 36 % or more between other texts). Sixteen segments of 23 bits decode in
the Golay code, an own index and up to six nearby ones each; they are taken in eight bands of two. Two texts that differ in E bits of a
band's segments with at most one error in either meet on that band's key, by the pigeonhole principle always if the segments hold
seven errors or fewer in all, and mostly far beyond, for the code absorbs up to three errors that fall towards one codeword.

Keys only propose. A text also has a sketch of its five-word shingles: 1,024 bits, each of the least of the shingles under a hash of its
own, so that a share (1 - s) / 2 of the bits differs between texts of similarity s, give or take 0.9 % at 0.8. A pair is dropped if its
fingerprints differ in over a fifth of their bits, or its sketches by five standard deviations more than at the least similarity (first
by one lane of the sketch, in the join itself); texts that share words but no passages don't come through, so that the texts read again
are about those that have near copies. These are compared by the exact Jaccard similarity of their sets of shingles. Texts with one own
key meet one leader first, then those whose nearby keys lead to another group meet that group's leader; what this links is one
component, inside which nothing is compared again, and all pairs left over meet in a last step, where the whole sketch is part of the
join. So a group of thousands of near copies costs stars and not its square, and no component is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import id_key, settle, share_package
from tidewater.llm.components import components
from tidewater.llm.simhash import codeword_index, nearby_indices

SHINGLE_WORDS = 5
SIMILARITY = 0.8
LANES = 6  # 64-bit words of a fingerprint
BANDS = 8
MOST_BITS = 64 * LANES // 5
SKETCH_LANES = 16  # 64-bit words of a sketch of shingles

# Odd multipliers that spread a word's hash over the lanes.
SPREAD = tuple(np.uint64(0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1C * k & (1 << 64) - 1 | 1) for k in range(LANES))

# One multiplier for each bit of a sketch, odd and fixed.
TURNS = np.random.default_rng(20_260).integers(0, 1 << 31, 64 * SKETCH_LANES, dtype=np.uint32) << np.uint32(1) | np.uint32(1)
# Room for the products of a block of hashes, small enough for a core's cache; a worker makes one sketch at a time.
PRODUCTS = np.empty((64, 64 * SKETCH_LANES), np.uint32)


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: only A-Z change, only ASCII white space splits


def _lanes(hashes: np.ndarray) -> np.ndarray:
    """Signed 64-bit words whose bits are set in over half of the mixed hashes."""
    counts = np.zeros(64 * LANES, np.int64)
    for at in range(0, len(hashes), 1 << 13):
        block = hashes[at : at + (1 << 13)]
        mixed = np.empty((len(block), LANES), ">u8")
        for k, factor in enumerate(SPREAD):
            x = block * factor
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            mixed[:, k] = x ^ (x >> np.uint64(32))
        counts += np.unpackbits(mixed.view(np.uint8).reshape(len(block), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.frombuffer(np.packbits(2 * counts > len(hashes)).tobytes(), ">u8").astype(np.uint64).view(np.int64)


def fingerprint(words: list[bytes]) -> np.ndarray:
    """The fingerprint of a text's distinct words."""
    distinct = set(words)
    return _lanes(np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct)))


def shingles(words: list[bytes], span: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words than a shingle are one, none are none."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, span = memoryview(b" ".join(words)), min(span, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - span] + 1)).tolist()
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(joined[a:b]) for a, b in zip(starts, ends[span - 1 :].tolist())), np.uint64))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Signed 64-bit words with one bit of the least of the hashes under each of the multipliers."""
    halves = (hashes >> np.uint64(32)).astype(np.uint32)[:, None]  # 32-bit products are vector instructions
    least = np.full(64 * SKETCH_LANES, np.iinfo(np.uint32).max)
    for at in range(0, len(halves), len(PRODUCTS)):
        block = halves[at : at + len(PRODUCTS)]
        np.minimum(least, np.multiply(block, TURNS, out=PRODUCTS[: len(block)]).min(axis=0), out=least)
    # a least value has leading zeros; the bit is taken below them
    return np.frombuffer(np.packbits((least >> np.uint32(8) & np.uint32(1)).astype(bool)).tobytes(), ">u8").astype(np.uint64).view(np.int64)


def most_sketch_bits(similarity: float, lanes: int) -> int:
    """Bits in which that many lanes of two sketches may differ: five standard deviations above the mean at this similarity."""
    share = (1 - similarity) / 2
    return int(64 * lanes * share + 5 * math.sqrt(64 * lanes * share * (1 - share)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


_LANE_NAMES = [f"f{k}" for k in range(LANES)]
_SKETCH_NAMES = [f"s{k}" for k in range(SKETCH_LANES)]
_CARRIED = ["node", "s0", "group"]


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        node, words_seen, lanes, sketches = [], [], [], []
        for text in frame["text"]:
            words = _words(text)
            node.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
            words_seen.append(len(words))
            full = len(words) >= SHINGLE_WORDS
            lanes.append(fingerprint(words) if full else np.zeros(LANES, np.int64))
            sketches.append(sketch(shingles(words)) if full else np.zeros(SKETCH_LANES, np.int64))
        names = [*_LANE_NAMES, *_SKETCH_NAMES]
        table = np.concatenate([np.stack(lanes), np.stack(sketches)], axis=1) if lanes else np.zeros((0, len(names)), np.int64)
        found = {"node": np.array(node, np.uint64).view(np.int64), "words": np.array(words_seen, np.int64)}
        yield frame[["id", "row"]].assign(**found, **{name: table[:, k] for k, name in enumerate(names)})


def _segments(frame: pd.DataFrame) -> list[np.ndarray]:
    """The 23-bit segments of each fingerprint, cut from its lanes laid end to end."""
    lanes = np.ascontiguousarray(frame[_LANE_NAMES].to_numpy(np.int64), dtype=">i8")
    bits = np.unpackbits(lanes.view(np.uint8).reshape(len(frame), 8 * LANES), axis=1)
    weight = 1 << np.arange(22, -1, -1)
    return [bits[:, 23 * s : 23 * s + 23] @ weight for s in range(2 * BANDS)]


def _own_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        index = [codeword_index(s) for s in _segments(frame)]
        for band in range(BANDS):
            yield frame[_CARRIED].assign(key=((band << 24) | (index[2 * band] << 12) | index[2 * band + 1]).astype(np.int32))


def _nearby_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The keys of nearby codewords, without the own key."""
    for frame in batches:
        for at in range(0, len(frame), 4096):
            part, near, own = frame.iloc[at : at + 4096].reset_index(drop=True), [], []
            for s in _segments(part):
                found = np.sort(nearby_indices(s), axis=1)
                found[:, 1:][found[:, 1:] == found[:, :-1]] = -1  # repeats; at most 6 differ
                near.append(-np.sort(-found, axis=1)[:, :6])
                own.append(codeword_index(s)[:, None, None])
            for band in range(BANDS):
                x, y = near[2 * band][:, :, None], near[2 * band + 1][:, None, :]
                valid = (x >= 0) & (y >= 0) & ((x != own[2 * band]) | (y != own[2 * band + 1]))
                yield part[_CARRIED].iloc[np.nonzero(valid)[0]].assign(key=((band << 24) | (x << 12) | y)[valid].astype(np.int32))


def _shingle_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        yield pd.DataFrame({"node": frame["node"], "set": [shingles(_words(t)).tobytes() for t in frame["text"]]})


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)], dtype="float64")


def _pairs(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _keyed(docs: DataFrame) -> DataFrame:
    plain = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, T.MapType)]
    return docs.withColumns({"__id": id_key(), "__row": F.xxhash64(*plain)})


def _apart(x: str, y: str, names: list[str]) -> Column:
    """The number of bits in which the columns ``names`` differ, those of either side with its prefix."""
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(x + n).bitwiseXOR(F.col(y + n))) for n in names])


def _alike(x: str, y: str, similarity: float, lanes: int = SKETCH_LANES) -> Column:
    return _apart(x, y, _SKETCH_NAMES[:lanes]) <= most_sketch_bits(similarity, lanes)


def _closest(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose fingerprints and sketches are close."""
    sides = [nodes.select(F.col("node").alias(s), *[F.col(n).alias(f"{s}_{n}") for n in _LANE_NAMES + _SKETCH_NAMES]) for s in ("a", "b")]
    near = (_apart("a_", "b_", _LANE_NAMES) <= MOST_BITS) & _alike("a_", "b_", similarity)
    return pairs.join(sides[0], "a").join(sides[1], "b").where(near).select("a", "b")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets are ``similarity`` alike."""
    close = settle(pairs, "near-close")
    if not close.head(1):
        return close
    wanted = close.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = settle(nodes.join(wanted, "node", "left_semi").select("node", F.col("first.id").alias("__id"), F.col("first.row").alias("__row")), "near-wanted")
    sets = texts.join(wanted, ["__id", "__row"]).select("node", "text").mapInPandas(_shingle_sets, "node long, set binary").dropDuplicates(["node"])
    sets = settle(sets, "near-sets")
    both = close.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    return settle(both.where(_similarity("set_a", "set_b") >= similarity).select("a", "b"), "near-links")


def _group() -> Column:
    """A text's group, which is the text itself where none is carried (0)."""
    return F.when(F.col("group") != 0, F.col("group")).otherwise(F.col("node"))


def links(nodes: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links between nodes whose components are those of all candidate pairs that are ``similarity`` alike."""
    spark = nodes.sparkSession
    # fingerprints are few bytes but fan out to hundreds of keys each, so they are dealt out by number and not by size
    parts = max(spark.sparkContext.defaultParallelism, -(-nodes.count() // 20_000))
    keyed = nodes.where(F.col("words") >= SHINGLE_WORDS).select("node", "s0", *_LANE_NAMES)

    def keys(of: DataFrame, make) -> DataFrame:
        return of.repartition(parts, "node").mapInPandas(make, "node long, s0 long, group long, key int")

    def led(own: DataFrame) -> DataFrame:
        """For each own key its leader and its last member, their number, and the least and greatest group among them."""
        group, member = _group(), F.struct("node", "s0", _group().alias("group"))
        return own.groupBy("key").agg(F.min(member).alias("leader"), F.max(member).alias("last"), F.count("*").alias("members"), F.min(group).alias("low"), F.max(group).alias("high"))

    # one: texts with the same own key meet its leader
    own = keys(keyed.withColumn("group", F.lit(0).cast("long")), _own_keys)
    leaders = led(own).where("low <> high").select("key", F.col("leader.node").alias("leader"), F.col("leader.s0").alias("leader_s0"))
    star = own.join(leaders, (own["key"] == leaders["key"]) & (F.col("node") != F.col("leader")) & _alike("", "leader_", similarity, 1))
    linked = [_verified(_closest(star.select(*_pairs("node", "leader")).distinct(), nodes, similarity), nodes, texts, similarity)]
    # two: texts whose nearby keys lead to another group meet its leader
    roots = settle(components(linked[0]).withColumnRenamed("root", "group"), "near-roots")
    keyed = keyed.join(roots, "node", "left").withColumn("group", F.coalesce("group", F.lit(0).cast("long")))
    own, near = keys(keyed, _own_keys), keys(keyed, _nearby_keys)
    held = led(own).select(F.col("key").alias("__key"), *[F.col(f"{m}.{n}").alias(f"{m}_{n}") for m in ("leader", "last") for n in ("node", "s0", "group")], "members", (F.col("low") != F.col("high")).alias("several"))
    other = (_group() != F.col("leader_group")) & _alike("", "leader_", similarity, 1)
    # of two members the last is known, so only what is close to it is kept for the last step
    mixed = F.col("several") & ((F.col("members") > 2) | (_group() != F.col("last_group")) & _alike("", "last_", similarity, 1))
    hits = near.join(held, (F.col("key") == F.col("__key")) & (other | mixed)).select("key", "node", F.col("leader_node").alias("leader"), mixed.alias("mixed"), other.alias("other"))
    hits = settle(hits, "near-hits")
    star = settle(hits.where("other").select(*_pairs("node", "leader")).distinct(), "near-star")
    linked.append(_verified(_closest(star, nodes, similarity), nodes, texts, similarity))
    # three: in keys that hold several groups, all that are still apart meet, but for members of the leader's group among themselves
    roots = settle(components(linked[0].unionAll(linked[1])), "near-roots")
    sketches = nodes.select("node", *_SKETCH_NAMES)

    def rooted(members: DataFrame, prefix: str) -> DataFrame:
        of = [roots.select(F.col("node").alias(k), F.col("root").alias(r)) for k, r in (("node", "__own"), ("leader", "__lead"))]
        found = members.join(of[0], "node", "left").join(of[1], "leader", "left").join(sketches, "node")
        root = F.coalesce("__own", "node")
        columns = {"node": F.col("node"), "root": root, "main": root == F.coalesce("__lead", "leader")} | {n: F.col(n) for n in _SKETCH_NAMES}
        return settle(found.select("key", *[c.alias(prefix + name) for name, c in columns.items()]), "near-members")

    mates = own.join(held.where("several and members > 2"), F.col("key") == F.col("__key")).select("key", "node", F.col("leader_node").alias("leader"))
    mixed = settle(hits.where("mixed").select("key", "node", "leader").unionAll(mates), "near-mixed")
    near_side = rooted(mixed, "n_")
    own_side = rooted(own.select("key", "node").join(mixed.select("key", "leader").distinct(), "key"), "o_")
    apart = (near_side["key"] == own_side["key"]) & (F.col("n_root") != F.col("o_root")) & _alike("n_", "o_", similarity)
    met = [near_side.where("not n_main").join(own_side, apart), near_side.where("n_main").join(own_side.where("not o_main"), apart)]
    rest = met[0].unionAll(met[1]).select(*_pairs("n_node", "o_node")).distinct().join(star, ["a", "b"], "left_anti")
    return linked[0].unionAll(linked[1]).unionAll(_verified(rest, nodes, texts, similarity))


def groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, row, node, words, component, first_id, first_row) for each row of ``docs`` (doc_id, text; any others).

    ``row`` is a hash of all columns, ``id`` the doc_id with 2^63 - 1 for a missing one. Texts that are equal word for word (A-Z in
    lower case) are one node; a missing text is an empty one, and all texts without words are one group. ``component`` is a node of the
    group, the same for all its rows; ``first_id`` and ``first_row`` are its least row by (id, row).
    """
    share_package(docs.sparkSession)
    texts = _keyed(docs).select("__id", "__row", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    lanes = ", ".join(f"{n} long" for n in _LANE_NAMES + _SKETCH_NAMES)
    rows = texts.withColumnsRenamed({"__id": "id", "__row": "row"}).mapInPandas(_describe, f"id long, row long, node long, words long, {lanes}")
    rows = settle(rows, "near-rows")
    nodes = rows.groupBy("node").agg(F.min("words").alias("words"), *[F.min(n).alias(n) for n in _LANE_NAMES + _SKETCH_NAMES], F.min(F.struct("id", "row")).alias("first"))
    nodes = settle(nodes, "near-nodes")
    roots = components(links(nodes, texts, similarity))
    placed = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"), "first")
    heads = placed.groupBy("component").agg(F.min("first").alias("head"))
    placed = settle(placed.join(heads, "component").select("node", "component", "head"), "near-placed")
    return rows.select("id", "row", "node", "words").join(placed, "node").select("id", "row", "node", "words", "component", F.col("head.id").alias("first_id"), F.col("head.row").alias("first_row"))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, all its columns: the least by (doc_id, missing last; hash of the row).

    Rows equal in every column come once. Only keys of the rows that go meet the texts.
    """
    found = settle(groups(docs, similarity).select("id", "row", "first_id", "first_row"), "near-groups")
    stays = (F.col("id") == F.col("first_id")) & (F.col("row") == F.col("first_row"))
    gone = settle(found.where(~stays).select(F.col("id").alias("__id"), F.col("row").alias("__row")).distinct(), "near-gone")
    repeated = settle(found.where(stays).groupBy(F.col("id").alias("__id"), F.col("row").alias("__row")).count().where("count > 1").drop("count"), "near-repeated")
    keyed, key = _keyed(docs), ["__id", "__row"]
    once = keyed.join(gone.unionAll(repeated), key, "left_anti")
    return once.unionAll(keyed.join(repeated, key, "left_semi").dropDuplicates(key)).select(*docs.columns)
