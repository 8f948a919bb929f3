"""Operator 9, SimHash near-dedup by anchor-point covering.

A fingerprint has 64 bits; two within `3` bits differ by one bit at most in one of its two halves.
Of each half, 31 bits are covered by the perfect Hamming code of length 31: every word lies within
radius 1 of one code word. Both members of a pair that differ by one bit there lie within 1 + 1 of
the anchor of either, so each fingerprint is replicated to every anchor within 2 of each half, 16 at
most by half, and compared only with those that share an anchor. Equal fingerprints are one
before that. Inside an anchor each fingerprint is tied to the least one it is
linked with there, so what leaves an anchor is a forest, never all pairs. The forests are joined to
components by rounds of large and small stars with checkpoints.

An anchor with more than `GROUP` fingerprints is cut into parts; each pair of parts is a group of its
own, so no task holds an anchor whole and no link is lost. An anchor holds about 16 n / 2^26 of n distinct
fingerprints that lie evenly, so comparisons grow with the square of n: 2,400 to an anchor at 10^10.

Defined cases: null, empty or blank text has fingerprint zero and links like any other; a text of
one or two words is one shingle; repeated rows link to themselves by their equal fingerprints and a
repeated doc_id gives one row for each of its rows; a null doc_id gets a row and counts last as a
component's name; keys may be of any type that Spark orders; a text of any length is hashed whole in one task, 65,536 shingles at
a time; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, freed_shuffles, read_table, removed, shared_path, slices, spaced_words

#: Differing bits of a link.
BITS = 3
#: Fingerprints of an anchor that are compared in one group.
GROUP = 4096
#: Edges of a graph whose minima are broadcast in a round of components(), and edges a task then.
FEW, FEW_ROWS = 1 << 15, 1 << 13
_BOUNDS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the shingles of a text, repeats included; bit b is set if over half the shingles' hashes set it."""
    w = spaced_words(text, lower=True)
    if not w:
        return 0
    joined, k = b" ".join(w), min(words, len(w))
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = (ends - [len(x) + 1 for x in w])[: len(w) - k + 1].tolist()
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << _BOUNDS)[2 * total > len(hashes)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, fp long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp long").withColumnRenamed("key", key)


def _masks() -> np.ndarray:
    """By syndrome of the Hamming code of length 31, what to flip to reach each code word within distance 2; unused places repeat the first."""
    rows = []
    for s in range(32):
        flips = [1 << (s - 1)] if s else [0]
        flips += [(1 << (i - 1)) ^ (1 << ((i ^ s) - 1)) for i in range(1, 32) if s and i < (i ^ s)]
        rows.append(flips + [flips[0]] * (16 - len(flips)))
    return np.array(rows, dtype=np.uint64)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of each anchor within covering radius plus one of the halves of 64-bit fingerprints."""
    masks, out_row, out_anchor = _masks(), [], []
    for half in (0, 1):
        x = (fps >> np.uint64(32 * half)) & np.uint64((1 << 31) - 1)
        syndrome = np.zeros(len(x), dtype=np.int64)
        for i in range(1, 32):
            syndrome ^= np.where((x >> np.uint64(i - 1)) & np.uint64(1), i, 0)
        to = x[:, None] ^ masks[syndrome]
        keep = np.ones(to.shape, dtype=bool)
        keep[syndrome == 0, 1:] = False
        row, col = np.nonzero(keep)
        out_row.append(row)
        out_anchor.append((to[row, col] | np.uint64(half << 31)).view(np.int64))
    return np.concatenate(out_row), np.concatenate(out_anchor)


def _forest(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fp, root) that join what is linked inside each group; rows come sorted by group."""
    u, parent = fp.view(np.uint64), np.arange(len(fp))

    def roots(i: np.ndarray) -> np.ndarray:
        while True:
            up = parent[i]
            if (up == i).all():
                return up
            i = up

    step, at = 1, np.nonzero(group[1:] == group[:-1])[0]
    while len(at):
        close = at[np.bitwise_count(u[at] ^ u[at + step]) <= BITS]
        a, b = close, close + step
        while len(a):  # the larger root goes below the smaller until all are one
            ra, rb = roots(a), roots(b)
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        step += 1
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
    root = roots(np.arange(len(fp)))
    linked = root != np.arange(len(fp))
    return fp[linked], fp[root[linked]]


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp); their components are those of all links."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            row, anchor = anchors(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[row])], names=["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, dtype=np.int64)] * 4
        for batch in batches:
            now = [np.concatenate([r, batch.column(i).to_numpy()]) for i, r in enumerate(rest)]
            a, p, q, f = now
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]) if len(a) else np.empty(0, dtype=bool)
            last = int(np.nonzero(new)[0][-1]) if len(a) else 0
            rest = [x[last:] for x in now]
            x, y = _forest(np.cumsum(new[:last]), f[:last])
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
        x, y = _forest(np.zeros(len(rest[0]), dtype=np.int64), rest[3])
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    spread = distinct.select("fp").mapInArrow(replicate, "anchor long, fp long")
    large = checkpointed(spread.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP))
    if large.isEmpty():
        cut = spread.select("anchor", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), "fp")
    else:
        parts = F.coalesce(F.ceil(F.col("n") / GROUP), F.lit(1)).cast("long")
        cut = (
            spread.join(large, "anchor", "left")
            .withColumn("parts", parts)
            .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            .select("anchor", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp")
        )
    dealt = cut.repartition("anchor", "p", "q").sortWithinPartitions("anchor", "p", "q", "fp")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) of each node of edges (a, b): root is the least node it reaches. Large and small stars until nothing changes.

    A round is written to the shared folder and the one before it deleted. A node with many neighbours is a hot key of the rounds' joins alone, which Spark splits; minima are taken before any shuffle.
    Of `few` edges at most the minima, two rows an edge at most, are broadcast, and a round's tasks go by the number of edges, not by the session's shuffle partitions: else many partitions make a thousand empty tasks a round.
    """
    spark, paths = edges.sparkSession, []

    def written(df: DataFrame) -> DataFrame:
        paths.append(shared_path(spark, "edges"))
        with freed_shuffles(spark):
            df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    def law(df: DataFrame) -> tuple:
        return tuple(df.select(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    same = law(edges)
    while True:
        light, tasks = same[0] <= few, 4 + same[0] // FEW_ROWS

        def minima(df: DataFrame) -> DataFrame:
            return df.groupBy("a").agg(F.min("b").alias("m"))

        def joined(df: DataFrame, least: DataFrame) -> DataFrame:
            return df.join(F.broadcast(least.coalesce(tasks)) if light else least, "a")  # noqa: B023

        # large star: neighbours above a node go to the least of its neighbourhood
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = joined(both, minima(both).select("a", F.least("a", "m").alias("m"))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large if light else large.distinct()
        # small star: a node and its lesser neighbours go to the least of them
        small = joined(large, minima(large)).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        edges = written(small.coalesce(tasks) if light else small)
        removed(spark, paths.pop(0))
        before, same = same, law(edges)
        if before == same:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, fp long, component_id) of each row; component_id is the least key reachable by links of BITS bits or fewer."""
    fps = checkpointed(fingerprints(docs, key, text, words))
    distinct = fps.groupBy("fp").agg(F.min(key).alias("least"))
    roots = components(links(distinct))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    tops = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(named.join(tops, "root").select("fp", "component_id"), "fp").select(key, "fp", "component_id")


def op9_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
