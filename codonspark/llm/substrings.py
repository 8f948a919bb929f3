"""Operator 6, substring dedup by level-wise doubling.

Windows of half the wanted length are counted first; only starts whose window is repeated in another document stay
candidates. Two candidates make a window of up to twice the length, which is counted in turn: from 7 words to 13, the length
wanted, where windows end: longer ones are made of these and would remove no other word. Each level reads the candidates of the one before alone.

Documents are put into blocks of about `block_bytes` of text, kept compressed in the shared folder. A level
takes each distinct window of a block once, as a hash, deals these
out by hash into buckets, and gets back one bit for each: whether another block has it.
So what is shuffled for a window grows with blocks, never with copies, and a bucket's
size is bounded by how many there are. Levels that narrow the candidates send 24 bits of a
hash, which may keep a candidate too many but lose none; windows that are still candidates at the wanted length are sent once more, with all 128 bits of
two independent hashes and the least document that has them, and that decides: among 10^13 windows some 10^-13 pairs of different ones agree.

Defined cases: null, empty and short texts have no window and lose no word; a window repeated only inside its own
document is not removed; rows that repeat a doc_id count as one document in the order of windows; a null doc_id
comes after all others; keys may be integers or of any other type that Spark orders, and go by that order; an empty table gives an empty result; extra
columns are not read, whatever their names. A text of any length is one row of one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, read_table, running, spaced_words, staged

BLOCK_BYTES = 8 << 20
#: Windows that a bucket is sized for.
BUCKET = 1 << 20
_NONE = np.iinfo(np.int64).max
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _blocks(docs: DataFrame, key: str, text: str, block_bytes: int) -> DataFrame:
    """(block, keys array<long>, n_words array<int>, body binary): documents as word streams, words joined by spaces, one document a line, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, part, serial = zstandard.ZstdCompressor(level=1), None, 0
        keys: list[int | None] = []
        counts: list[int] = []
        lines: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + serial], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([pack.compress(b"\n".join(lines))], pa.binary())],
                names=["block", "keys", "n_words", "body"],
            )

        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = spaced_words(t.as_py())
                keys.append(k)
                counts.append(len(words))
                lines.append(b" ".join(words))
                size += len(lines[-1]) + 1
                if size >= block_bytes:
                    yield flush()
                    keys, counts, lines, size, serial = [], [], [], 0, serial + 1
        if keys:
            yield flush()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(run, "block long, keys array<long>, n_words array<int>, body binary")


class _Block:
    """A block's words as hashes, documents one after the other."""

    def __init__(self, keys: np.ndarray, n_words: np.ndarray, body: bytes):
        self.keys, self.n = keys, n_words.astype(np.int64)
        self.body = zstandard.ZstdDecompressor().decompress(body) if len(body) else b""
        words = pa.array([self.body.replace(b"\n", b" ")], pa.binary()).cast(pa.string())
        flat = pa.compute.split_pattern(words, " ").flatten() if self.n.sum() else pa.array([], pa.string())
        if len(flat) != self.n.sum():  # empty documents leave empty strings
            flat = flat.filter(pa.compute.not_equal(flat, ""))
        named = flat.dictionary_encode()
        wide = [xxhash.xxh3_128_intdigest(w) for w in named.dictionary.cast(pa.binary()).to_pylist()]
        both = np.array([[w & ((1 << 64) - 1) for w in wide], [w >> 64 for w in wide]], dtype=np.uint64)
        self.words = both[:, named.indices.to_numpy()] if len(flat) else np.empty((2, 0), dtype=np.uint64)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.left = np.repeat(np.cumsum(self.n), self.n) - np.arange(self.words.shape[1])  # words from here to the document's end

    def windows(self, length: int, lane: int = 0) -> np.ndarray:
        """64 bits of a hash of the window of `length` words that starts at each word; of use where `left` is as long. Built by doubling; two lanes are independent."""
        h, size = _mix(self.words[lane] + (_A, _C)[lane]), 1
        while size < length:
            step = min(size, length - size)
            ahead = np.concatenate([h[step:], np.zeros(min(step, len(h)), dtype=np.uint64)])[: len(h)]
            h = _mix(h * (_A, _D)[lane] + ahead + np.uint64(size + step))
            size += step
        return h


class _Replay:
    """A block's candidates, level after level: each level's answers narrow the starts of the next."""

    def __init__(self, block: _Block):
        self.block, self.length = block, 0
        self.starts = np.arange(block.words.shape[1])

    def open(self, length: int, decide: bool) -> tuple[np.ndarray, np.ndarray]:
        """Distinct windows of the next length in rising order of hash, 64 bits of it, or 128 as two columns at the level that decides, and the least key of each."""
        b, n = self.block, self.block.words.shape[1]
        if self.length:
            alive = np.zeros(n + 1, dtype=bool)
            alive[self.starts] = True
            self.starts = self.starts[alive[np.minimum(self.starts + length - self.length, n)]]
        self.starts, self.length = self.starts[b.left[self.starts] >= length], length
        if decide:
            pair = np.stack([b.windows(length)[self.starts], b.windows(length, 1)[self.starts]], axis=1)
            order = np.lexsort((pair[:, 1], pair[:, 0]))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (pair[order][1:] != pair[order][:-1]).any(axis=1)
            hashes = pair[order[new]]
            self.place = np.empty(len(order), dtype=np.int64)
            self.place[order] = np.cumsum(new) - 1
        else:
            hashes, self.place = np.unique(b.windows(length)[self.starts], return_inverse=True)
        self.own = b.keys[b.doc[self.starts]]
        self.least = np.full(len(hashes), _NONE)
        np.minimum.at(self.least, self.place, self.own)
        most = np.full(len(hashes), np.iinfo(np.int64).min)
        np.maximum.at(most, self.place, self.own)
        self.several = most > self.least
        return hashes, self.least

    def close(self, bits: np.ndarray) -> None:
        """Keep the starts whose window another document has."""
        self.starts = self.starts[(bits | self.several)[self.place]]

    def later(self, bits: np.ndarray) -> np.ndarray:
        """Starts whose window an earlier document has; a bit says that one of another block is before the block's least."""
        return self.starts[bits[self.place] | (self.own > self.least[self.place])]


def levels(min_words: int, first: int = 7) -> list[int]:
    """Window lengths up to the wanted one: each at most twice the one before, none under `first` but a shorter wanted one."""
    out = [min_words]
    while -(-out[0] // 2) >= first:
        out.insert(0, -(-out[0] // 2))
    return out


def _bounds(buckets: int) -> np.ndarray:
    """First hash of every bucket but the first."""
    return np.array([-(-(k << 64) // buckets) for k in range(1, buckets)], dtype=np.uint64)


def _load(row: dict) -> _Block:
    return _Block(np.array([_NONE if k is None else k for k in row["keys"]], dtype=np.int64), np.array(row["n_words"], dtype=np.int64), row["body"])


def _bits(answers: list[dict], level: int, n: int) -> np.ndarray:
    """A level's bits of a block in order of hash."""
    own = sorted((a["bucket"], a["n"], a["bits"]) for a in answers or [] if a["level"] == level)
    parts = [np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=k).astype(bool) for _, k, b in own]
    return np.concatenate(parts) if parts else np.zeros(n, dtype=bool)


def _replayed(row: dict, steps: list[tuple[int, bool]]) -> _Replay:
    """The block after the answers of all given steps."""
    replay = _Replay(_load(row))
    for k, step in enumerate(steps):
        hashes, _ = replay.open(*step)
        replay.close(_bits(row["answers"], k, len(hashes)))
    return replay


def _ask(rows: DataFrame, steps: list[tuple[int, bool]], buckets: int) -> DataFrame:
    """(bucket, block, n, hashes, base, least): the distinct windows of the last step by bucket; 24 bits of a hash where the step doesn't decide, else 128 and the least key."""
    decide = steps[-1][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _bounds(buckets)
        for batch in batches:
            for row in batch.to_pylist():
                replay = _replayed(row, steps[:-1])
                hashes, least = replay.open(*steps[-1])
                cut = [0, *np.searchsorted(hashes[:, 0] if decide else hashes, bounds).tolist(), len(hashes)]
                base = int(least.min()) if len(least) else 0
                kind = np.uint32 if len(least) and int(least.max()) - base < 1 << 32 else np.int64
                near = (least - base).astype(kind)
                sent = hashes if decide else hashes.view(np.uint8).reshape(-1, 8)[:, :3]
                found = [(i, a, b) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _, _ in found], pa.int64()),
                        pa.array([row["block"]] * len(found), pa.int64()),
                        pa.array([b - a for _, a, b in found], pa.int64()),
                        pa.array([sent[a:b].tobytes() for _, a, b in found], pa.binary()),
                        pa.array([base] * len(found), pa.int64()),
                        pa.array([near[a:b].tobytes() if decide else b"" for _, a, b in found], pa.binary()),
                    ],
                    names=["bucket", "block", "n", "hashes", "base", "least"],
                )

    return rows.mapInArrow(run, "bucket long, block long, n long, hashes binary, base long, least binary")


def _answer(decide: bool, level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For a bucket, the bits of each block in it."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sizes = group["n"].to_numpy()
        if decide:
            pair = np.concatenate([np.frombuffer(x, dtype=np.uint64).reshape(-1, 2) for x in group["hashes"]])
            least = np.concatenate([np.frombuffer(x, dtype=np.uint32 if len(x) == 4 * n else np.int64).astype(np.int64) + base for x, n, base in zip(group["least"], sizes, group["base"], strict=True)])
            order = np.lexsort((pair[:, 1], pair[:, 0]))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (pair[order][1:] != pair[order][:-1]).any(axis=1)
            starts = np.nonzero(new)[0]
            first = np.minimum.reduceat(least[order], starts) if len(starts) else least
            bit = np.empty(len(order), dtype=bool)
            bit[order] = first[np.cumsum(new) - 1] < least[order]
        else:
            low = np.concatenate([np.frombuffer(x, dtype=np.uint8).reshape(-1, 3) for x in group["hashes"]]).astype(np.int32)
            counts = np.bincount(h := low[:, 0] | low[:, 1] << 8 | low[:, 2] << 16, minlength=1)
            bit = counts[h] > 1
        ends = np.cumsum(sizes)
        bits = [np.packbits(bit[e - n : e]).tobytes() for n, e in zip(sizes, ends, strict=True)]
        return pd.DataFrame({"block": group["block"], "level": level, "bucket": group["bucket"], "n": sizes, "bits": bits})

    return run


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, n_words, removed array<int>, kept string): words of each row covered by a window of min_words that an earlier document
    also has, as flat (start, end) pairs, and the words that are left, joined by spaces."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if kind not in ("tinyint", "smallint", "int", "bigint"):  # keys of other types go by their place in order
        places = running(rows.select("key").where("key IS NOT NULL").distinct(), ["key"]).select(F.col("key").alias("name"), F.col("__rank").alias("place"))
        places = checkpointed(places)
        found = drop_repeats(rows.join(places, F.col("key") == F.col("name"), "left").select("place", "text"), "place", "text", min_words, block_bytes)
        return found.join(places, "place", "left").select(F.col("name").alias(key), "n_words", "removed", "kept")
    blocks = checkpointed(_blocks(rows, "key", "text", block_bytes))
    words = blocks.agg(F.sum(F.aggregate("n_words", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets, steps = max(1, -(-words // BUCKET)), [*((n, False) for n in levels(min_words)), (min_words, True)]
    rows, answers = blocks.withColumn("answers", F.lit(None).cast("array<struct<level:int,bucket:long,n:long,bits:binary>>")), None
    for k in range(len(steps)):
        asked = _ask(rows, steps[: k + 1], buckets)
        given = staged(asked.groupBy("bucket").applyInPandas(_answer(steps[k][1], k), "block long, level int, bucket long, n long, bits binary"))
        answers = given if answers is None else answers.union(given)
        rows = blocks.join(answers.groupBy("block").agg(F.collect_list(F.struct("level", "bucket", "n", "bits")).alias("answers")), "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                replay = _replayed(row, steps[:-1])
                hashes, _ = replay.open(*steps[-1])
                starts = replay.later(_bits(row["answers"], len(steps) - 1, len(hashes)))
                block = replay.block
                step = np.zeros(block.words.shape[1] + 1, dtype=np.int64)
                np.add.at(step, starts, 1)
                np.add.at(step, starts + min_words, -1)
                gone = np.cumsum(step)[:-1] > 0
                removed, kept, at = [], [], 0
                for line, n in zip(block.body.split(b"\n"), block.n.tolist(), strict=True):
                    own = gone[at : at + n]
                    edges = np.nonzero(np.diff(np.concatenate([[False], own, [False]])))[0]
                    removed.append(edges.tolist())
                    kept.append(b" ".join(w for w, g in zip(line.split(b" "), own.tolist(), strict=True) if not g) if len(edges) else line)
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["keys"], pa.int64()), pa.array(block.n, pa.int64()), pa.array(removed, pa.list_(pa.int64())), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["key", "n_words", "removed", "kept"],
                )

    return rows.mapInArrow(run, "key long, n_words long, removed array<long>, kept string").withColumnRenamed("key", key)


def op6_substring_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeats(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: x - a).alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
r AS (SELECT doc_id, i FROM g QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM r),
e AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM w),
k AS (SELECT e.doc_id, count(c.j) AS n, string_agg(e.x, ' ' ORDER BY e.j) FILTER (WHERE c.j IS NULL) AS t
  FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.j = e.j GROUP BY e.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
