"""Operator 4, language-model scoring by context-tree weighting.

A text is the bytes of its lower-cased words, one space between, and a line feed as its end; the context of a
byte is the `DEPTH` bytes before it, line feeds before the first. A byte is eight binary choices, each in the context tree of the bits already
known. Every node of a tree has a Krichevsky-Trofimov estimate of its choice; a choice's probability mixes
the estimates of all depths along its context, each node weighted against what lies deeper by the
evidence of the training texts: w = KT / (KT + product of the children), halves cancelled.

Texts lie in blocks of about `BLOCK_BYTES`, written once to the shared folder. Training: tasks count the distinct windows
of DEPTH + 1 bytes of each block, `_SORTED` at a time, and deal them by the last `KEPT` bytes of the context, so all deeper nodes of a window are in one
task, sorted. There every node of depths KEPT to DEPTH is counted exactly and mixed bottom up, and what a window takes from them is kept with it.
Only the nodes of fewer bytes, at most 2^24 whatever the corpus, are added up over tasks and broadcast. Scores of windows go back
to their blocks, each window once for a block. All nodes of all texts count, none shares counts with another, and
a context that was never seen takes no part. Choices sum to one, so the score is a probability; of a choice under 10^-9 that is kept instead, and what deep nodes give and scores of windows
are kept in single precision, a relative error of 10^-7.

The base score needs the count of each word. Words are joined by word: a task sends each distinct word of
a block of documents once, so a common word has as many rows as there are blocks.

Defined cases: null, empty and blank texts are the end alone; a null doc_id counts as the empty string for held_out; repeated
rows count and are scored each for itself; without training rows N is 0 and every choice is even;
a text of any length is one line of a block, whose windows are taken in runs of `_PIECE` bytes; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freed_shuffles, read_table, slices, spaced_words, staged

DEPTH = 5
#: Bytes of the context by which windows are dealt; nodes of fewer bytes are broadcast.
KEPT = 3
BLOCK_BYTES = 12 << 20
_PIECE = 1 << 17
#: Distinct windows that are mixed at once, and pairs of window and block that are held for them or scored at once, by one task.
_GROUP, _PAIRS = 30_000, 300_000
#: Windows that are sorted at once, block by block.
_SORTED = 1 << 19
_END = b"\n"
#: Bits of a window besides those bytes.
_REST = np.uint64(8 * (DEPTH - KEPT + 1))


def held_out(key: object, folds: int = 7, fold: int = 2) -> bool:
    return zlib.crc32(("" if key is None else str(key)).encode()) % folds == fold


def _lines(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    lines, n_words = [], np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        words = spaced_words(t, lower=True)
        lines.append(b" ".join(words))
        n_words[i] = len(words)
    return lines, n_words


def _windows(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(window of DEPTH + 1 bytes, the last byte lowest, for every byte of the texts; first byte's place of each text)."""
    data = np.frombuffer(b"".join(_END * DEPTH + x + _END for x in lines), dtype=np.uint8).astype(np.uint64)
    size = np.array([len(x) + 1 for x in lines], dtype=np.int64)
    out = np.zeros(len(data), dtype=np.uint64)
    for i in range(DEPTH + 1):
        out[i:] |= data[: len(data) - i] << np.uint64(8 * i)
    first = np.cumsum(size + DEPTH) - size
    own = np.ones(len(data), dtype=bool)
    for i in range(DEPTH):
        own[first - 1 - i] = False
    return out[own], np.cumsum(size) - size


def count_windows(docs: DataFrame) -> DataFrame:
    """(ctx, y, n): counts of context and next byte over the training rows (key, text), one row for each task and window at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            u, place = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
            return u, np.bincount(place, np.concatenate([n for _, n in found]), minlength=len(u)).astype(np.int64)

        def row(u: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((u >> np.uint64(8)).view(np.int64)), pa.array((u & np.uint64(255)).astype(np.int32)), pa.array(n)], names=["ctx", "y", "n"])

        found, size = [], 0
        for batch in slices(batches, 4 << 20):
            texts = [t for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if not held_out(k)]
            if texts:
                found.append(np.unique(_windows(_lines(texts)[0])[0], return_counts=True))
                size += len(found[-1][0])
            if size > 6_000_000:
                found = [merged(found)]
                size = len(found[0][0])
                if size > 4_000_000:
                    yield row(*found[0])
                    found, size = [], 0
        if found:
            yield row(*merged(found))

    return docs.mapInArrow(run, "ctx long, y int, n long")


def _lgamma(x: Column) -> Column:
    """ln of gamma for x of 1/2 and more: Stirling's series after seven steps up."""
    z = x + 7
    steps = sum((F.ln(x + i) for i in range(1, 7)), F.ln(x))
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) - steps


def _kt(n0: Column, n1: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0) - math.log(math.pi)


def nodes(counts: DataFrame) -> list[DataFrame]:
    """By depth, (ctx, b, n0, n1, w): counts of the choice after bits b (1 and the bits known), and the node's weight against deeper ones."""
    bits = counts.repartition("ctx").select("ctx", "y", "n", F.explode(F.array(*[F.lit(j) for j in range(8)])).alias("j"))
    b = F.expr("shiftleft(1, j) | shiftright(y, 8 - j)")
    one = F.expr("shiftright(y, 7 - j) & 1")
    level = bits.groupBy("ctx", b.alias("b")).agg(F.sum(F.when(one == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(one == 1, F.col("n")).otherwise(0)).alias("n1"))
    level = level.withColumn("pw", _kt(F.col("n0"), F.col("n1"))).withColumn("w", F.lit(1.0))
    out = [level]
    for d in range(DEPTH - 1, -1, -1):
        up = F.col("ctx").bitwiseAND(F.lit((1 << (8 * d)) - 1))
        level = level.groupBy(up.alias("ctx"), "b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("below"))
        kt, gap = _kt(F.col("n0"), F.col("n1")), F.col("below") - F.col("kt")
        w = F.when(gap > 40, F.exp(-F.least(gap, F.lit(700.0)))).otherwise(1 / (1 + F.exp(F.least(gap, F.lit(40.0)))))
        pw = F.greatest("kt", "below") + F.log1p(F.exp(-F.least(F.abs(gap), F.lit(700.0)))) - math.log(2)
        level = level.withColumn("kt", kt).withColumn("w", w).withColumn("pw", pw).select("ctx", "b", "n0", "n1", "pw", "w")
        out.insert(0, level)
    return [x.select("ctx", "b", "n0", "n1", "w") for x in out]


#: ln of gamma at n + 1/2 and n + 1 for small n.
_HALF = np.array([math.lgamma(i + 0.5) for i in range(1 << 12)])
_WHOLE = np.array([math.lgamma(i + 1.0) for i in range(1 << 12)])


def _ln_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """As _kt, over arrays of counts."""

    def at(n: np.ndarray, small: np.ndarray, plus: float) -> np.ndarray:
        out = small[np.minimum(n, len(small) - 1).astype(np.int64)]
        large = n >= len(small)
        z = n[large] + plus
        out[large] = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z)
        return out

    return at(n0, _HALF, 0.5) + at(n1, _HALF, 0.5) - at(n0 + n1, _WHOLE, 1.0) - math.log(math.pi)


def _mixed(kt: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln of the evidence, weight) of nodes of a depth below DEPTH."""
    both = np.logaddexp(kt, below)
    return both - math.log(2), np.exp(kt - both)


def _choices(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, bits known, bit taken) of the eight choices of each window, choice by choice."""
    y = windows & np.uint64(255)
    b = np.concatenate([np.uint64(1 << j) | (y >> np.uint64(8 - j)) for j in range(8)])
    one = np.concatenate([((y >> np.uint64(7 - j)) & np.uint64(1)).astype(bool) for j in range(8)])
    return np.tile(windows >> np.uint64(8), 8), b, one


def _codes(depth: int, ctx: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((ctx & np.uint64((1 << (8 * depth)) - 1)) << np.uint64(8)) | b


def _deep(windows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Over all windows, each once, of some contexts of KEPT bytes, with their counts of training: what the nodes of KEPT bytes and more give to each
    choice as it was taken, and (code, n0, n1, ln of the evidence below) of the nodes of KEPT - 1 bytes. A node without training is even."""
    ctx, b, one = _choices(windows)
    code, place = np.unique(_codes(DEPTH, ctx, b), return_inverse=True)
    times, at = np.tile(n, 8), []
    n0, n1 = (np.bincount(place, times * x, minlength=len(code)) for x in (~one, one))
    kt = _ln_kt(n0, n1)
    pw, w, level = kt, np.ones(len(code)), place
    for depth in range(DEPTH, KEPT - 1, -1):
        at.append((level, n0, n1, w))
        up, parent = np.unique(_codes(depth - 1, code >> np.uint64(8), code & np.uint64(255)), return_inverse=True)
        n0, n1, below = (np.bincount(parent, x, minlength=len(up)) for x in (n0, n1, pw))
        code, level = up, parent[level]
        if depth > KEPT:
            pw, w = _mixed(_ln_kt(n0, n1), below)
    q = np.full(len(ctx), 0.5)
    for level, m0, m1, w in at:
        q += w[level] * ((np.where(one, m1[level], m0[level]) + 0.5) / (m0 + m1 + 1)[level] - q)
    real = n0 + n1 > 0
    return q.reshape(8, -1).T, (code[real], n0[real].astype(np.int64), n1[real].astype(np.int64), below[real])


def _tops(code: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By depth under KEPT, (code sorted, probability of bit 1, weight) from the nodes of KEPT - 1 bytes."""
    out = []
    for depth in range(KEPT - 1, -1, -1):
        code, place = np.unique(_codes(depth, code >> np.uint64(8), code & np.uint64(255)), return_inverse=True)
        n0, n1, below = (np.bincount(place, x, minlength=len(code)) for x in (n0, n1, below))
        pw, w = _mixed(_ln_kt(n0, n1), below)
        out.insert(0, (code, (n1 + 0.5) / (n0 + n1 + 1), w))
        below = pw
    return out


def train(docs: DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By depth, (code sorted, probability of bit 1, weight) of every node, collected: for small tables. score_texts never holds all nodes."""
    out = []
    for level in nodes(count_windows(docs)):
        x = level.toArrow()
        ctx, b, n0, n1, w = (x[c].to_numpy() for c in ("ctx", "b", "n0", "n1", "w"))
        code = (ctx.astype(np.uint64) << np.uint64(8)) | b.astype(np.uint64)
        order = np.argsort(code)
        out.append((code[order], ((n1 + 0.5) / (n0 + n1 + 1))[order], w[order].astype(np.float64)))
    return out


def log10_windows(windows: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]], deep: np.ndarray | None = None) -> np.ndarray:
    """log10 of the probability of the last byte of each window, from the nodes of the first depths and what deeper ones give to each choice."""
    ctx, b, one = _choices(windows)
    p = np.full(len(ctx), 0.5) if deep is None else deep.T.reshape(-1)
    for depth in range(len(tables) - 1, -1, -1):
        codes, kt, w = tables[depth]
        if len(codes):
            want = _codes(depth, ctx, b)
            i = np.minimum(np.searchsorted(codes, want), len(codes) - 1)
            p += np.where(codes[i] == want, w[i], 0.0) * (np.where(one, kt[i], 1 - kt[i]) - p)
    return np.log10(np.clip(p, 1e-9, 1.0)).reshape(8, -1).sum(axis=0)


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _pieces(lines: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of lines of about _PIECE bytes."""
    ends, at = np.cumsum([len(x) + 1 for x in lines]), 0
    while at < len(lines):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PIECE)))
        yield at, to
        at = to


def _runs(lines: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first line, line after the last, windows, first window of each line) of runs of lines; a line of more than a run's size comes in several, with the bytes before each as its context."""
    for at, to in _pieces(lines):
        if to - at > 1 or len(lines[at]) <= 2 * _PIECE:
            yield at, to, *_windows(lines[at:to])
            continue
        data = np.frombuffer(_END * DEPTH + lines[at] + _END, dtype=np.uint8)
        for a in range(0, len(lines[at]) + 1, _PIECE):
            own = data[a : a + _PIECE + DEPTH].astype(np.uint64)
            windows = np.zeros(len(own) - DEPTH, dtype=np.uint64)
            for i in range(DEPTH + 1):
                windows |= own[DEPTH - i : len(own) - i] << np.uint64(8 * i)
            yield at, to, windows, np.zeros(1, dtype=np.int64)


def _starts(x: np.ndarray) -> np.ndarray:
    """Places of the first of equal values of a sorted array."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)])


def _turned(windows: np.ndarray) -> np.ndarray:
    """Windows with the last KEPT bytes of the context in front, so that they sort by these."""
    x = (windows >> np.uint64(8)) & np.uint64((1 << (8 * KEPT)) - 1)
    return x << _REST | windows >> np.uint64(8 * (KEPT + 1)) << np.uint64(8) | windows & np.uint64(255)


def _turned_back(x: np.ndarray) -> np.ndarray:
    rest = (x & ((np.uint64(1) << _REST) - np.uint64(1))) >> np.uint64(8)
    return rest << np.uint64(8 * (KEPT + 1)) | x >> _REST << np.uint64(8) | x & np.uint64(255)


def _block_windows(lines: list[bytes], trained: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of the distinct windows of the lines, sorted, with their counts in the lines of training. Besides these only _SORTED windows are held: they are sorted in place, the mark of training as lowest bit."""

    def merged(key: np.ndarray, n: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        more = np.concatenate(held)
        more.sort()
        first = _starts(more)
        key, n = np.concatenate([key, more[first]]), np.concatenate([n, np.diff(first, append=len(more))])
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = _starts(key)
        return key[first], np.add.reduceat(n, first)

    key, n, held, size = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), [], 0
    for at, to, windows, first in _runs(lines):
        held.append(windows << np.uint64(1) | np.repeat(trained[at:to], np.diff(first, append=len(windows))))
        size += len(windows)
        if size >= _SORTED:
            (key, n), held, size = merged(key, n, held), [], 0
    if held:
        key, n = merged(key, n, held)
    windows, n = key >> np.uint64(1), np.where(key & np.uint64(1), n, 0)
    if len(windows):
        first = _starts(windows)
        windows, n = windows[first], np.add.reduceat(n, first)
    for i in range(0, len(windows), 1 << 16):
        yield windows[i : i + (1 << 16)], n[i : i + (1 << 16)]


def _looked_up(found: np.ndarray, windows: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The values of windows, all of which are among the sorted ones. So many are sorted at once as the bits that a window leaves can number."""
    out, bits = np.empty(len(found)), np.uint64(64 - 8 * (DEPTH + 1))
    for i in range(0, len(found), 1 << int(bits)):
        x = found[i : i + (1 << int(bits))]
        x = x << bits | np.arange(len(x), dtype=np.uint64)
        x.sort()
        own = x >> bits
        first = _starts(own)
        out[i + (x & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = np.repeat(value[np.searchsorted(windows, own[first])], np.diff(first, append=len(x)))
    return out


def _blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """(block, data): blocks of (key, held, line, n_words), written to the shared folder once, so that all passes see the same blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = 0
        for batch in slices(batches, block_bytes):
            block, serial = (batch.column(2)[0].as_py() << 32) + serial, serial + 1
            parts = [_lines(x.column(1).to_pylist()) for x in slices(iter([batch]), _PIECE)]
            lines, n_words = [x for part, _ in parts for x in part], np.concatenate([n for _, n in parts])
            held = pa.array([held_out(k) for k in batch.column(0).to_pylist()], pa.bool_())
            own = pa.record_batch({"key": batch.column(0), "held": held, "line": pa.array(lines, pa.large_binary()), "n_words": n_words})
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([_packed(own)], pa.binary())], names=["block", "data"])

    return staged(rows.withColumn("part", F.spark_partition_id()).mapInArrow(run, "block long, data binary"))


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    for batch in batches:
        for block, data in zip(batch.column(0), batch.column(1), strict=True):
            yield block.as_py(), pa.ipc.open_stream(data.as_py()).read_all()
            pa.default_memory_pool().release_unused()  # else each worker keeps what a block has taken at most


def _window_scores(blocks: DataFrame) -> DataFrame:
    """(block, windows, scores): log10 of the probability of every window of each block, as packed arrays in several rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, own in _opened(batches):
            lines, trained = own["line"].to_pylist(), ~own["held"].to_numpy()
            del own
            for x, n in _block_windows(lines, trained):
                yield pa.RecordBatch.from_arrays([pa.array(_turned(x).view(np.int64)), pa.array(n), pa.array(np.full(len(x), block))], names=["turned", "n", "block"])

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(u: np.ndarray, n: np.ndarray, times: np.ndarray, block: np.ndarray) -> Iterator[pa.RecordBatch]:
            q, up = _deep(u := _turned_back(u), n)
            ends = pa.array(np.concatenate([[0], np.cumsum(times)]).astype(np.int32))
            none = lambda k: [pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.list_(pa.int64()))]
            # a choice of over 1/2 is kept as what it lacks to one, with a minus: single precision is fine at both ends
            packed = pa.Array.from_buffers(pa.binary(), len(u), [None, pa.py_buffer((np.arange(len(u) + 1) * 32).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(np.where(q > 0.5, q - 1, q), dtype=np.float32).tobytes())])
            own = [pa.array(u.view(np.int64)), packed, pa.ListArray.from_arrays(ends, pa.array(block))]
            yield pa.RecordBatch.from_arrays([*own, pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.float64())], names=names)
            code, n0, n1, below = up
            yield pa.RecordBatch.from_arrays([*none(len(code)), pa.array(code.view(np.int64)), pa.array(n0), pa.array(n1), pa.array(below)], names=names)

        names = ["window", "deep", "blocks", "code", "n0", "n1", "below"]
        def merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            """Distinct windows of sorted rows, counts of training, numbers of blocks, and blocks."""
            u, n, times, block = (np.concatenate(x) for x in zip(*held, strict=True))
            first = _starts(u)
            return u[first], np.add.reduceat(n, first), np.add.reduceat(times, first), block

        held, size = [], 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            u, n, block = (c.to_numpy() for c in batch.columns)
            held.append(merged([(u.view(np.uint64), n, np.ones(len(u), dtype=np.int64), block)]))
            size += max(len(held[-1][0]) * (_PAIRS // _GROUP), len(u))
            if size >= _PAIRS and held[0][0][0] >> _REST != held[-1][0][-1] >> _REST:  # all but the last context of KEPT bytes are whole
                u, n, times, block = merged(held)
                last = int(np.searchsorted(u, u[-1] >> _REST << _REST))
                pairs = int(times[:last].sum())
                yield from done(u[:last], n[:last], times[:last], block[:pairs])
                pa.default_memory_pool().release_unused()
                held = [(u[last:].copy(), n[last:].copy(), times[last:].copy(), block[pairs:].copy())]
                size = max((len(u) - last) * (_PAIRS // _GROUP), len(block) - pairs)
        if held:
            yield from done(*merged(held))

    dealt = blocks.mapInArrow(count, "turned long, n long, block long").repartition(F.shiftright("turned", int(_REST))).sortWithinPartitions("turned")
    mixed = staged(dealt.mapInArrow(mix, "window long, deep binary, blocks array<long>, code long, n0 long, n1 long, below double"))
    with freed_shuffles(blocks.sparkSession):
        top = mixed.where("code IS NOT NULL").groupBy("code").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below")).toArrow()  # at most 2^24 rows
    tables = blocks.sparkSession.sparkContext.broadcast(_tops(top["code"].to_numpy().view(np.uint64), *(top[c].to_numpy() for c in ("n0", "n1", "below"))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = pa.Table.from_batches(held).combine_chunks()
            deep = np.frombuffer(b"".join(x["deep"].to_pylist()), dtype=np.float32).reshape(-1, 8).astype(np.float64)
            window = x["window"].to_numpy()
            deep = np.where(deep < 0, deep + 1, deep)
            value = np.concatenate([log10_windows(window[i : i + 8192].view(np.uint64), tables.value, deep[i : i + 8192]) for i in range(0, len(window), 8192)]).astype(np.float32)
            block, times = pa.compute.list_flatten(x["blocks"]).to_numpy(), pa.compute.list_value_length(x["blocks"]).to_numpy()
            order = np.argsort(block, kind="stable")
            ids, first = np.unique(block[order], return_index=True)
            window, value = np.repeat(window, times)[order], np.repeat(value, times)[order]
            cuts = [*first.tolist(), len(order)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), *(pa.array([v[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()) for v in (window, value))], names=["block", "windows", "scores"]
            )

        held, size = [], 0
        for batch in batches:
            ends, at = np.cumsum(pa.compute.list_value_length(batch["blocks"]).to_numpy()), 0
            while at < batch.num_rows:  # a window has as many pairs as blocks
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS - size, side="right")))
                held.append(batch.slice(at, to - at))
                size, at = size + int(ends[to - 1] - (ends[at - 1] if at else 0)), to
                if size >= _PAIRS or at < batch.num_rows or sum(x.num_rows for x in held) >= 50_000:
                    yield from done(held)
                    held, size = [], 0
        if held:
            yield from done(held)

    return mixed.where("window IS NOT NULL").select("window", "deep", "blocks").mapInArrow(score, "block long, windows binary, scores binary")


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each row."""
    kind = docs.schema[key].dataType.simpleString()
    blocks = _blocks(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), block_bytes)
    scored = _window_scores(blocks)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each distinct word of a block with its count in training; the null word stands for the ends of the texts."""
        for block, own in _opened(batches):
            lines, trained = own["line"].to_pylist(), ~own["held"].to_numpy()
            places, words = _coded(lines)
            n = np.bincount(places, np.repeat(trained, own["n_words"].to_numpy()), minlength=len(words)).astype(np.int64)
            for i in range(0, len(words), 1 << 16):
                x = n[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), block)), words.slice(i, len(x)), pa.array(np.arange(i, i + len(x), dtype=np.int32)), pa.array(x)], names=names)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), pa.array([int(trained.sum())])], names=names)

    names = ["block", "word", "place", "n"]
    sent = blocks.mapInArrow(spread, "block long, word string, place int, n long")
    counted = staged(sent.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"))
    n, v = counted.agg(F.sum("c"), F.count(F.lit(1))).first()
    n, ends_known = n or 0, counted.where("word IS NULL").agg(F.sum("c")).first()[0] or 0
    lead = math.log10(n + v + 1)

    def gather(group: pa.Table) -> pa.Table:
        own = pa.ipc.open_stream(group.filter(group["data"].is_valid())["data"][0].as_py()).read_all()
        lines = own["line"].to_pylist()
        words = group.select(["places", "counts"]).filter(group["places"].is_valid())
        total = own["n_words"].to_numpy().astype(np.int64)
        size, known, base = len(total), np.zeros(len(total), dtype=np.int64), np.zeros(len(total))
        if words.num_rows and total.sum():
            places, distinct = _coded(lines)
            counts, starts = np.zeros(len(distinct), dtype=np.int64), np.concatenate([[0], np.cumsum(total)])
            counts[np.frombuffer(b"".join(words["places"].to_pylist()), dtype=np.int32)] = np.frombuffer(b"".join(words["counts"].to_pylist()), dtype=np.int64)
            pa.default_memory_pool().release_unused()
            for a, b in _pieces(lines):
                c, doc = counts[places[starts[a] : starts[b]]], np.repeat(np.arange(b - a), total[a:b])
                known[a:b] = np.bincount(doc[c > 0], minlength=b - a)
                base[a:b] = np.bincount(doc, np.log10(c + 1.0), minlength=b - a)
        packed = group.select(["windows", "scores"]).filter(group["windows"].is_valid())
        windows = np.frombuffer(b"".join(packed["windows"].to_pylist()), dtype=np.uint64)
        order = np.argsort(windows)
        windows, value = windows[order], np.frombuffer(b"".join(packed["scores"].to_pylist()), dtype=np.float32)[order].astype(np.float64)
        del group, words, packed
        score = np.zeros(size)
        for a, b, found, first in _runs(lines):
            score[a:b] += np.add.reduceat(_looked_up(found, windows, value), first)
        return pa.table(
            {
                "key": own["key"],
                "held_out": own["held"],
                "n_tokens": pa.array(total + 1),
                "n_known": pa.array(known + (1 if ends_known else 0)),
                "train_tokens": pa.array(np.full(size, n, dtype=np.int64)),
                "base_score": pa.array(base + math.log10(ends_known + 1) - (total + 1) * lead),
                "score": pa.array(score),
                "bits_per_byte": pa.array(-score / math.log10(2) / np.array([len(x) + 1 for x in lines])),
            }
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of words by block, in arrays: a word is named by its place among its block's words."""

        def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            block, place, c = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
            order = np.argsort(block, kind="stable")
            ids, first = np.unique(block[order], return_index=True)
            cuts = [*first.tolist(), len(order)]
            packed = [pa.array([v[order][a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()) for v in (place, c)]
            return pa.RecordBatch.from_arrays([pa.array(ids), *packed], names=["block", "places", "counts"])

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= 500_000:
                yield done(held)
                held, size = [], 0
        if size:
            yield done(held)

    none = {c: F.lit(None).cast("binary") for c in ("data", "places", "counts", "windows", "scores")}

    def parts(df: DataFrame) -> DataFrame:
        return df.select("block", *[c if c in df.columns else x.alias(c) for c, x in none.items()])

    words = sent.select("block", "word", "place").join(counted, "word").select("block", "place", "c").mapInArrow(pack, "block long, places binary, counts binary")
    found = parts(words).union(parts(scored)).union(parts(blocks))
    schema = f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return found.groupBy("block").applyInArrow(gather, schema).withColumnRenamed("key", key)


def _coded(lines: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """All words of the lines as places in the array of the distinct ones, which is in the order of their first places."""
    runs = [_split(lines[a:b]).dictionary_encode() for a, b in _pieces(lines)]
    distinct = pa.concat_arrays([x.dictionary for x in runs]).dictionary_encode()
    starts = np.cumsum([0, *(len(x.dictionary) for x in runs)])
    return np.concatenate([distinct.indices.to_numpy()[at + x.indices.to_numpy()] for at, x in zip(starts, runs, strict=False)]), distinct.dictionary


def _split(lines: list[bytes]) -> pa.Array:
    """All words of the lines."""
    flat = pa.compute.split_pattern(pa.array([b" ".join(lines)], pa.binary()).cast(pa.string()), " ").flatten()
    return flat.filter(pa.compute.not_equal(flat, ""))


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"))
