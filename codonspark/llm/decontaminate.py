"""Operator 2, benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of ten words of the benchmark items (an item of fewer is one window). The
alphabet is words and a block is two neighbouring words. A shift table says for the block at the end
of the search position how far every pattern lets it move; a block that ends a pattern has shift
zero and opens the bucket of patterns with that suffix, whose words are then compared directly. Patterns of
one length share a table, so that short items don't shorten the shifts of long ones.

Words and blocks are numbers, patterns rows of numbers, so that a window costs some 150 bytes. Tables are built once by each
process that searches. The benchmark is cut into blocks of at most `block_mb` of text by a
hash, and each block is one pass over the documents; with one block, as with any benchmark of usual
size, nothing is shuffled. Passes are executed one after the other, and joined by row.

Defined cases: a null or empty text has no words and isn't contaminated; an item without words has
no window; an item without item_id hits like any other but names nothing, so n_items can be 0 where n_hit isn't; repeated items with equal ids count once; equal windows of several items count for each; a document shorter
than a window can only be hit by short items; ties don't arise; a text of any length is searched whole in one task; repeated documents are answered row by row; empty tables give no
hits or no rows; extra columns are not read.
"""

from __future__ import annotations

import functools
import itertools
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import plain_words, read_table, slices, staged

WINDOW = 10


class WuManber:
    """Patterns of one length in words, as rows of word ids: shift table by block, buckets of rows by suffix block."""

    def __init__(self, patterns: np.ndarray, owner: np.ndarray):
        """patterns: a row for each window; owner: the item of each. Equal windows are one pattern of several items."""
        self.length = patterns.shape[1]
        self.block = min(2, self.length)
        self.most = self.length - self.block + 1
        rows, place = np.unique(patterns, axis=0, return_inverse=True)
        suffix, prefix = self._keys(rows, self.length), self._keys(rows, self.block)
        order = np.lexsort((prefix, suffix))
        self.rows, self.prefix, suffix = rows[order], prefix[order], suffix[order]
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        pairs = np.unique(np.stack([back[place.reshape(-1)], owner], axis=1), axis=0)
        self.owners, self.first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1))
        # a bucket is a run of rows with one suffix block, in the order of their first block
        keys, starts = np.unique(suffix, return_index=True)
        self.buckets = dict(zip(keys.tolist(), zip(starts.tolist(), np.append(starts[1:], len(rows)).tolist())))
        blocks = np.concatenate([self._keys(rows, end) for end in range(self.block, self.length + 1)])
        moves = np.repeat(self.length - np.arange(self.block, self.length + 1), len(rows))
        keys, place = np.unique(blocks, return_inverse=True)
        least = np.full(len(keys), self.most)
        np.minimum.at(least, place, moves)
        self.shift = dict(zip(keys.tolist(), least.tolist()))

    def _keys(self, rows: np.ndarray, end: int) -> np.ndarray:
        last = rows[:, end - 1].astype(np.int64)
        return rows[:, end - 2].astype(np.int64) << 32 | last if self.block == 2 else last

    def search(self, ids: list[int]) -> Iterator[tuple[int, list[int]]]:
        """(start, items) of every occurrence in a text of word ids, -1 for words that no pattern has."""
        length, most, shift, n, two = self.length, self.most, self.shift, len(ids), self.block == 2
        end = length
        while end <= n:
            last = ids[end - 1]
            # a block with a strange word is in no pattern
            key = -1 if last < 0 or two and ids[end - 2] < 0 else ids[end - 2] << 32 | last if two else last
            move = shift.get(key, most)
            if move:
                end += move
                continue
            start = end - length
            low, high = self.buckets[key]
            head = ids[start + self.block - 1]
            if two:
                head = ids[start] << 32 | head if head >= 0 and ids[start] >= 0 else -1
            if high - low > 4:
                low, high = low + np.searchsorted(self.prefix[low:high], head, side="left"), low + np.searchsorted(self.prefix[low:high], head, side="right")
            for i in range(low, high):
                if self.prefix[i] == head and self.rows[i].tolist() == ids[start:end]:
                    yield start, self.owners[self.first[i] : self.first[i + 1]].tolist()
                    break  # rows differ
            end += 1


class Patterns:
    """The windows of (item, text) and their tables, one for each length. Sent to tasks as text, and built once by each process that searches."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.items, self.window, self.built = items, window, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"built": None}

    def tables(self) -> tuple[dict[bytes, int], list[WuManber]]:
        """(id of each word, tables by length)."""
        if self.built is None:
            words: dict[bytes, int] = {}
            found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
            for i, (_, text) in enumerate(self.items):
                ids = np.array([words.setdefault(w, len(words)) for w in plain_words(text)], dtype=np.int32)
                size = min(self.window, len(ids))
                if size:
                    rows = np.lib.stride_tricks.sliding_window_view(ids, size)
                    found[size].append((rows, np.full(len(rows), i)))
            self.built = words, [WuManber(np.concatenate([r for r, _ in x]), np.concatenate([o for _, o in x])) for _, x in sorted(found.items())]
        return self.built

    def hits(self, text: str | None) -> tuple[int, Iterator[tuple[int, int, list[int]]]]:
        """(words, (start, end, items) of every occurrence)."""
        known, tables = self.tables()
        words = plain_words(text)
        ids = [known.get(w, -1) for w in words]
        return len(words), ((start, start + table.length, at) for table in tables for start, at in table.search(ids))


def _pass(docs: DataFrame, sent: Broadcast) -> DataFrame:
    """(row, n_words, spans, items): hit word ranges from word 0, flat (start, end, start, end ...), and ids of items found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = sent.value
        names = [i for i, _ in patterns.items]
        for batch in slices(batches, 4 << 20):
            n_words, spans, hit_items = [], [], []
            for text in batch.column(1).to_pylist():
                n, found = patterns.hits(text)
                ranges, hit = [], set()
                for start, end, at in found:
                    ranges.append((start, end))
                    hit.update(at)
                n_words.append(n)
                spans.append([x for r in _merged(ranges) for x in r])
                hit_items.append(sorted({names[i] for i in hit} - {None}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(hit_items, pa.list_(pa.string()))],
                names=["row", "n_words", "spans", "items"],
            )

    kind = docs.schema["row"].dataType.simpleString()
    return docs.mapInArrow(run, f"row {kind}, n_words long, spans array<long>, items array<string>")


def _merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _benchmark_blocks(benchmark: DataFrame, item: str, block_mb: float) -> Iterator[list[tuple[str | None, str]]]:
    """The benchmark's (item, text) in lists of at most about block_mb of text, dealt by a hash of the item and its text."""
    bench = benchmark.select(F.col(item).cast("string").alias("item"), F.col("text").alias("text")).where("text IS NOT NULL")
    total = bench.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    bound = block_mb * (1 << 20)
    blocks = int(-(-total // (bound / 2))) if total > bound else 1  # of half the bound, as hashes deal unevenly
    for k in range(blocks):
        own = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else bench
        yield [(r[0], r[1]) for r in own.toLocalIterator()]


def _passes(rows: DataFrame, blocks: Iterator[list[tuple[str | None, str]]], window: int, keep: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """keep(pass) of each block. A single block is left to be executed with what reads it; of several, each is executed in turn, its rows written and its tables
    taken back from the tasks before the next is read, so that one is held at a time. rows names them by (row, text)."""
    context, own, out = rows.sparkSession.sparkContext, next(blocks), []
    for following in blocks:
        sent = context.broadcast(Patterns(own, window))
        out.append(staged(keep(_pass(rows, sent))))
        sent.destroy()
        own = following
    last = keep(_pass(rows, context.broadcast(Patterns(own, window))))
    return [*out, staged(last)] if out else [last]


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows with an id of their own, written so that all passes see the same."""
    return staged(docs.withColumn("__row", F.monotonically_increasing_id()))


def _several(blocks: Iterator[list]) -> tuple[bool, Iterator[list]]:
    """Whether there are blocks besides the first, and all of them."""
    first = list(itertools.islice(blocks, 2))
    return len(first) > 1, itertools.chain(first, blocks)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW, block_mb: float = 8
) -> DataFrame:
    """(key, n_words, spans, items) of each row: merged hit word ranges as a flat array, ids of the items found, sorted as strings."""
    rows = docs.select(F.col(key).alias("row"), F.col(text).alias("text"))
    several, blocks = _several(_benchmark_blocks(benchmark, item, block_mb))
    if not several:
        return _passes(rows, blocks, window, lambda found: found)[0].withColumnRenamed("row", key)
    named = _numbered(rows)  # a row is named by more than its key, which can repeat
    passes = functools.reduce(DataFrame.union, _passes(named.select(F.col("__row").alias("row"), "text"), blocks, window, lambda found: found))
    counted = passes.groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # ranges of several blocks are merged where one begins after all before it have ended
    pair = F.transform(F.sequence(F.lit(0), (F.size("spans") / 2).cast("int") - 1), lambda i: F.struct(F.get("spans", 2 * i).alias("a"), F.get("spans", 2 * i + 1).alias("b")))
    ranges, by_row = passes.where("size(spans) > 0").select("row", F.inline(pair)), W.partitionBy("row").orderBy("a", "b")
    ahead = F.max("b").over(by_row.rowsBetween(W.unboundedPreceding, -1))
    runs = ranges.withColumn("new", F.when(ahead >= F.col("a"), 0).otherwise(1)).withColumn("run", F.sum("new").over(by_row.rowsBetween(W.unboundedPreceding, 0)))
    merged = runs.groupBy("row", "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).groupBy("row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("a", "b"))), lambda x: F.array(x["a"], x["b"]))).alias("spans"))
    joined = named.select(F.col("__row").alias("row"), F.col("row").alias("__key")).join(counted, "row").join(merged, "row", "left")
    return joined.select(F.col("__key").alias(key), "n_words", F.coalesce("spans", F.array().cast("array<long>")).alias("spans"), "items")


def n_hit(spans: Column) -> Column:
    """Words in the ranges."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: x - a)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW, block_mb: float = 8) -> DataFrame:
    """The rows without any benchmark window, all columns kept. One block of the benchmark drops its rows without a shuffle; of several, each names the rows it drops."""
    several, blocks = _several(_benchmark_blocks(benchmark, item, block_mb))
    if several:
        named = _numbered(docs)
        hit = _passes(named.select(F.col("__row").alias("row"), F.col(text).alias("text")), blocks, window, lambda found: found.where("size(spans) > 0").select("row"))
        return named.join(functools.reduce(DataFrame.union, hit).select(F.col("row").alias("__row")), "__row", "left_anti").select(*docs.columns)
    sent = docs.sparkSession.sparkContext.broadcast(Patterns(next(blocks), window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = sent.value
        for batch in slices(batches, 4 << 20, text):
            yield batch.filter(pa.array([not any(True for _ in patterns.hits(t)[1]) for t in batch.column(text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM
  (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(10, len(w)) AS k FROM b WHERE len(w) > 0))),
d AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM
  (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)),
h AS (SELECT d.doc_id, d.i, d.k, p.item_id FROM d JOIN p ON d.k = p.k AND d.g = p.g),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS l FROM h GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(s.n, 0)::BIGINT AS n_items,
  sha256(coalesce(s.l, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN s ON s.doc_id = w.doc_id
"""
