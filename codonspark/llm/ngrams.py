"""Operator 13, a Jaccard join of n-gram sets by vertical partitioning.

Two rows link when their sets of distinct word n-grams, A-Z lowered, have a Jaccard similarity of `percent` / 100 or more; a text
of fewer words is one n-gram. Rows of equal sets are one set from the start.

- The global order of n-grams goes by how frequent they are, rarest first, ties by hash. Frequency comes from counters over all
  documents, `COUNTERS` of them whatever the corpus; n-grams that share one seem more frequent than they are, which moves them in the order, the same for all, and loses nothing.
- Sets that link share an n-gram of both prefixes: of n n-grams in order, the first n - ceil(percent n / 100) + 1. Sets meet under such n-grams.
- Meeting sets whose sizes, and whose parities of n-grams in 1024 classes, leave the similarity open become candidate pairs. Under an n-gram of
  more than `SMALL` sets, only a spanning forest of the closest pairs does so, and pairs that links have joined already don't; rounds go on until no link is
  found, then what is still open is asked at once. So a group of near copies gives as many pairs as it has sets, not their square. Which
  sets are joined is what all links join: no link between different components is left unasked.
- The order is cut into fragments of equal weight; a candidate's sets are cut alike. Overlaps are counted by fragment, and summed by pair.

An n-gram of more than `GROUP` sets is compared by pairs of parts of it, each a group of its own. Sets and n-grams go by 128 and 64 bits of hashes: of two sets of 10^4 n-grams
some 10^-11 take a different n-gram for equal. Thousands of sets that lie just under the similarity of one another are asked in all their pairs, as each may link.

Defined cases: null, empty and blank texts have an empty set, link with nothing and are their own component; repeated rows and repeated keys have
each a row of their own; a null key counts last as a component's name; keys may be of any type that Spark orders; a text of any length is one row of one
task; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices, staged
from .simhash import components

WORDS, PERCENT = 3, 90
COUNTERS, CHUNK = 1 << 22, 1 << 16
#: Sets under an n-gram whose pairs are all candidates; sets that one group compares.
SMALL, GROUP = 16, 4096
#: Bits of the filter of sets whose n-grams are needed: 16 MB, whatever the corpus.
FILTER = 1 << 27
SEGMENT = 4096
#: Lots of fragments that are counted one after the other, so that the segments of one alone are on disk.
LOTS = 4
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_FAR = 1 << 30


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def ngram_sets(text: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): of each text the hashes of its distinct n-grams, rising."""
    split = pc.ascii_split_whitespace(pc.fill_null(pc.ascii_lower(text), ""))
    row, flat = pc.list_parent_indices(split).to_numpy(), pc.list_flatten(split)
    full = pc.not_equal(flat, "")
    row, flat = row[full.to_numpy(zero_copy_only=False)], flat.filter(full)
    n_words = np.bincount(row, minlength=len(text))
    if not len(flat):
        return np.zeros(len(text) + 1, dtype=np.int64), np.empty(0, dtype=np.uint64)
    named = flat.dictionary_encode()
    table = np.array([xxhash.xxh3_64_intdigest(w) for w in named.dictionary.cast(pa.binary()).to_pylist()], dtype=np.uint64)
    h, ends = table[named.indices.to_numpy()], np.cumsum(n_words)
    left = ends[row] - np.arange(len(row))
    first = np.concatenate([[True], row[1:] != row[:-1]])
    starts = np.nonzero((left >= words) | first)[0]
    row, left = row[starts], np.minimum(left[starts], words)
    value = _mix(left.astype(np.uint64) * _A)
    for j in range(words):
        value = np.where(j < left, _mix(value * _A + h[np.minimum(starts + j, len(h) - 1)]), value)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])])
    row, value = row[new], value[new]
    return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(text)))]), value


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each stretch, modulo 2^64."""
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _names(bounds: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set as two longs."""
    return _sums(_mix(value ^ _A), bounds).view(np.int64), _sums(_mix(value ^ _B), bounds).view(np.int64)


def _parities(bounds: np.ndarray, value: np.ndarray) -> list[bytes]:
    """Of each set, whether an odd number of its n-grams falls into each of 1024 classes; sets that differ in d n-grams differ in d classes at most."""
    classes, out = (_mix(value ^ _C) >> np.uint64(54)).astype(np.int64), []
    for a in range(0, len(bounds) - 1, 512):
        own = bounds[a : a + 513]
        row = np.repeat(np.arange(len(own) - 1), np.diff(own))
        odd = np.bincount((row << 10) + classes[own[0] : own[-1]], minlength=(len(own) - 1) << 10) & 1
        out += [x.tobytes() for x in np.packbits(odd.astype(np.uint8).reshape(-1, 1024), axis=1)]
    return out


def _described(rows: DataFrame, words: int) -> DataFrame:
    """(key, n, s, t, parity) of each row, and (part, chunk, counts): the counters of each task, CHUNK at a time, in rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind = np.zeros(COUNTERS, dtype=np.uint32), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for piece in slices([batch], 2 << 20):
                bounds, value = ngram_sets(piece.column(1), words)
                np.add.at(counts, (value >> np.uint64(42)).astype(np.int64), np.uint32(1))
                s, t = _names(bounds, value)
                none = [pa.nulls(len(s), k) for k in (pa.int64(), pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(bounds)), pa.array(s), pa.array(t), pa.array(_parities(bounds, value), pa.binary()), *none], names=names)
        if kind is not None:
            pack, part = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId()
            chunks = COUNTERS // CHUNK
            packed = [pack.compress(counts[k * CHUNK : (k + 1) * CHUNK].tobytes()) for k in range(chunks)]
            none = [pa.nulls(chunks, k) for k in (kind, pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([part] * chunks, pa.int64()), pa.array(range(chunks), pa.int32()), pa.array(packed, pa.binary())], names=names)

    names = ["key", "n", "s", "t", "parity", "part", "chunk", "counts"]
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n long, s long, t long, parity binary, part long, chunk int, counts binary")


def _counters(chunks: DataFrame) -> np.ndarray:
    """Counters of all tasks (part, chunk, counts), summed 256 tasks at a time."""

    def run(group: pa.Table) -> pa.Table:
        total, unpack = np.zeros(CHUNK, dtype=np.uint64), zstandard.ZstdDecompressor()
        for x in group.column("counts").to_pylist():
            raw = unpack.decompress(x)
            total += np.frombuffer(raw, dtype=np.uint32 if len(raw) == 4 * CHUNK else np.uint64)
        packed = zstandard.ZstdCompressor(level=1).compress(total.tobytes())
        return pa.table({"part": group.column("lot")[:1], "chunk": group.column("chunk")[:1], "counts": pa.array([packed], pa.binary())})

    last = chunks.agg(F.max("part")).first()[0]
    out = np.zeros(COUNTERS, dtype=np.uint64)
    while last is not None:
        chunks = chunks.withColumn("lot", F.floor(F.col("part") / 256)).groupBy("chunk", "lot").applyInArrow(run, "part long, chunk int, counts binary")
        last //= 256
        if last == 0:
            for r in chunks.collect():
                out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["counts"]), dtype=np.uint64)
            break
        chunks = staged(chunks)
    return out


def _classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequency class of each counter, one byte, and the share of all n-grams in the classes before each."""
    cls = np.minimum(np.log2(counts + 1.0) * 6, 255).astype(np.uint8)
    mass = np.bincount(cls, weights=counts.astype(np.float64), minlength=256)
    return cls, np.concatenate([[0], np.cumsum(mass)]) / max(mass.sum(), 1)


def _plausible(n: np.ndarray, parity: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Distance in parities of the pairs whose similarity is open, _FAR of others."""
    a, b = n[i], n[j]
    least = -(-percent * (a + b) // (100 + percent))
    apart = np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype=np.int64)
    return np.where((apart <= a + b - 2 * least) & (least <= np.minimum(a, b)), apart, _FAR)


def _forest(n: np.ndarray, parity: np.ndarray, comp: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the least distances between a group's sets; sets of one component are joined already."""
    rest, apart, near, out, at = np.arange(1, len(n)), np.full(len(n), _FAR), np.zeros(len(n), dtype=np.int64), [], 0
    while len(rest):
        d = np.where(comp[rest] == comp[at], -1, _plausible(n, parity, np.array([at]), rest, percent))
        closer = rest[d < apart[rest]]
        near[closer] = at
        apart[rest] = np.minimum(apart[rest], d)
        pick = int(np.argmin(apart[rest]))
        at = int(rest[pick])
        if 0 <= apart[at] < _FAR:
            out.append((int(near[at]), at))
        rest = np.delete(rest, pick)
    return out


def _pairs(group: np.ndarray, n: np.ndarray, parity: np.ndarray, comp: np.ndarray, percent: int, whole: bool, most: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of rows that share a group; rows come sorted by group."""
    starts = np.nonzero(np.concatenate([[True], group[1:] != group[:-1]]))[0] if len(group) else np.empty(0, dtype=np.int64)
    sizes = np.diff(np.concatenate([starts, [len(group)]]))
    small = np.repeat(sizes <= most, sizes)
    left, right = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for step in range(1, most):
        i = np.nonzero(small[:-step] & (group[step:] == group[:-step]) & (comp[step:] != comp[:-step]))[0]
        i = i[_plausible(n, parity, i, i + step, percent) < _FAR]
        left.append(i)
        right.append(i + step)
    for a, size in zip(starts[sizes > most].tolist(), sizes[sizes > most].tolist(), strict=True):
        own = slice(a, a + size)
        if (comp[own] == comp[a]).all():
            continue
        if not whole:
            edges = np.array(_forest(n[own], parity[own], comp[own], percent), dtype=np.int64).reshape(-1, 2)
            left.append(edges[:, 0] + a)
            right.append(edges[:, 1] + a)
            continue
        for i in range(a, a + size - 1):
            j = np.arange(i + 1, a + size)
            j = j[comp[j] != comp[i]]
            j = j[_plausible(n, parity, np.array([i]), j, percent) < _FAR]
            left.append(np.full(len(j), i))
            right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _candidates(members: DataFrame, percent: int, small: int, whole: bool = False) -> DataFrame:
    """(a, b, na, nb), distinct: sets a < b with their sizes, of members (gram, p, q, set, n, parity, comp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(table: pa.Table) -> pa.RecordBatch:
            cols = [table.column(k).to_numpy() for k in ("gram", "p", "q")]
            new = np.zeros(table.num_rows, dtype=np.int64)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            parity = np.frombuffer(b"".join(table.column("parity").to_pylist()), dtype=np.uint64).reshape(-1, 16)
            s, t, n = (table.column(k).to_numpy() for k in ("s", "t", "n"))
            i, j = _pairs(np.cumsum(new), n, parity, table.column("comp").to_numpy(), percent, whole, small)
            turn = (s[i] > s[j]) | ((s[i] == s[j]) & (t[i] > t[j]))
            i, j = np.where(turn, j, i), np.where(turn, i, j)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (s[i], t[i], s[j], t[j], n[i], n[j])], names=["sa", "ta", "sb", "tb", "na", "nb"])

        held = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            ends = [table.column(k).to_numpy() for k in ("gram", "p", "q")]
            cut = np.nonzero(np.logical_or.reduce([e != e[-1] for e in ends]))[0]
            first = int(cut[-1]) + 1 if len(cut) else 0
            joins = bool(held) and all(held[-1].column(k)[-1].as_py() == e[0] for k, e in zip(("gram", "p", "q"), ends, strict=True))
            if first or (held and not joins):  # groups have ended
                yield found(pa.concat_tables([*held, table.slice(0, first)]))
                held = []
            held.append(table.slice(first))
        if held:
            yield found(pa.concat_tables(held))

    dealt = members.select("gram", "p", "q", "set.s", "set.t", "n", "parity", "comp").repartition("gram", "p", "q").sortWithinPartitions("gram", "p", "q", "n", "s", "t")
    pairs = dealt.mapInArrow(run, "sa long, ta long, sb long, tb long, na long, nb long").distinct()
    return pairs.select(F.struct(F.col("sa").alias("s"), F.col("ta").alias("t")).alias("a"), F.struct(F.col("sb").alias("s"), F.col("tb").alias("t")).alias("b"), "na", "nb")


def _meetings(members: DataFrame, percent: int, group: int) -> DataFrame:
    """(gram, p, q, set, many) of members (gram, set, n): sets meet under an n-gram and a class of sizes. Sets that may link are of one class or the next, so each goes to two;
    what meets no other is left out, and of n-grams under which the same sets meet, told by their count and 128 bits, one is kept. More than `group` sets are cut into parts, and each pair of parts (p, q) is a group."""
    size = F.floor(F.log("n") / float(max(np.log(100 / percent), 1e-9) * (1 + 1e-9)))
    classed = members.withColumn("size", F.explode(F.array(size, size + 1))).select(F.xxhash64("gram", "size").alias("gram"), "set")
    counts = classed.groupBy("gram").agg(F.count(F.lit(1)).alias("many"), F.bit_xor("set.s").alias("x"), F.bit_xor("set.t").alias("y")).where("many > 1")
    counts = counts.groupBy("x", "y", "many").agg(F.min("gram").alias("gram"))
    parts = F.ceil(F.col("many") / group)
    return (
        classed.join(counts, "gram")
        .withColumn("own", F.pmod(F.xxhash64("set"), parts))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        .select("gram", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "set", "many")
    )


def _segments(docs: DataFrame, needed: DataFrame, classes: object, before: np.ndarray, words: int, fragments: int) -> DataFrame:
    """(set, fragment, grams array<long>) of the needed sets (column set)."""
    spark, slots = docs.sparkSession, FILTER // 64
    held = needed.groupBy(F.pmod("set.s", F.lit(slots)).alias("slot")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(set.s div {slots}, 64) as int)))").alias("bits")).toPandas()
    bits = np.zeros(slots, dtype=np.uint64)
    bits[held["slot"].to_numpy().astype(np.int64)] = held["bits"].to_numpy().astype(np.int64).view(np.uint64)
    filter_ = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20):
            bounds, value = ngram_sets(batch.column(0), words)
            s, t = _names(bounds, value)
            wide = np.where(s < 0, -(-s // slots), s // slots)  # as div does, towards zero
            may = (filter_.value[s % slots] >> (wide % 64).astype(np.uint64)) & np.uint64(1)
            _, first = np.unique(np.stack([s, t]), axis=1, return_index=True)
            keep = np.intersect1d(first, np.nonzero(may)[0])
            row = np.repeat(keep, np.diff(bounds)[keep])
            grams = value[np.isin(np.repeat(np.arange(len(s)), np.diff(bounds)), keep)]
            cls = classes.value[(grams >> np.uint64(42)).astype(np.int64)]
            place = before[cls] + (before[cls.astype(np.int64) + 1] - before[cls]) * (grams / 2.0**64)
            part = np.minimum((place * fragments).astype(np.int64), fragments - 1)
            order = np.lexsort((part, row))
            row, part, grams = row[order], part[order], grams[order]
            new = np.nonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (part[1:] != part[:-1])]))[0] if len(row) else np.empty(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([new, [len(row)]]), pa.int32()), pa.array(grams.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(s[row[new]]), pa.array(t[row[new]]), pa.array(part[new]), lists], names=["s", "t", "fragment", "grams"])

    found = docs.select("text").mapInArrow(run, "s long, t long, fragment long, grams array<long>").select(F.struct("s", "t").alias("set"), "fragment", "grams")
    return found.join(needed, "set", "left_semi").groupBy("set", "fragment").agg(F.first("grams").alias("grams"))


def _linked(pairs: DataFrame, segments: DataFrame, percent: int, few: bool = False) -> DataFrame:
    """The pairs (a, b) that link: overlaps by fragment, summed. Few pairs fetch their own segments alone."""
    if few:
        segments = segments.join(pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set"))).distinct(), "set", "left_semi")
    parts = None
    for lot in range(1 if few else LOTS):
        own = segments if few else segments.where(F.col("fragment") % LOTS == lot)
        left = own.select(F.col("set").alias("a"), "fragment", F.col("grams").alias("ga"))
        right = own.select(F.col("set").alias("b"), "fragment", F.col("grams").alias("gb"))
        both = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("part"))
        both = staged(both.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("part")))
        parts = both if parts is None else parts.union(both)
    whole = parts.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
    return whole.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, small: int = SMALL, group: int = GROUP) -> DataFrame:
    """(key, n_shingles, component_id) of each row: how many distinct n-grams it has, and the least key reachable by links."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType
    described = staged(_described(rows, words))
    named = described.where("chunk IS NULL").select("key", "n", F.struct("s", "t").alias("set"), "parity")
    cls, before = _classes(_counters(described.where("chunk IS NOT NULL").select("part", "chunk", "counts")))
    classes = spark.sparkContext.broadcast(cls)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20):
            bounds, value = ngram_sets(batch.column(0), words)
            s, t = _names(bounds, value)
            n = np.diff(bounds)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((value, classes.value[(value >> np.uint64(42)).astype(np.int64)], row))
            first = np.arange(len(value)) - np.repeat(bounds[:-1], n) < np.repeat(n - -(-percent * n // 100) + 1, n)
            row, value = row[first], value[order][first]
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(s[row]), pa.array(t[row]), pa.array(n[row])], names=["gram", "s", "t", "n"])

    met = rows.select("text").mapInArrow(prefixes, "gram long, s long, t long, n long")
    shared = met.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("gram")
    sets = staged(named.where("n > 0").groupBy("set").agg(F.min("key").alias("least"), F.first("n").alias("n"), F.first("parity").alias("parity")))
    members = staged(met.join(shared, "gram").distinct().select("gram", F.struct("s", "t").alias("set"), "n"))
    meetings, known = staged(_meetings(members, percent, group)), sets.drop("least")
    pairs = staged(_candidates(meetings.join(known, "set").withColumn("comp", F.xxhash64("set")), percent, small))
    crowded = meetings.where(F.col("many") > small)
    needed = pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set"))).union(crowded.select("set")).distinct()
    longest = sets.agg(F.max("n")).first()[0] or 0
    segments = staged(_segments(rows, staged(needed), classes, before, words, max(4, -(-longest // SEGMENT))))
    links = staged(_linked(pairs, segments, percent))
    roots = components(links)
    asked, whole, done = pairs, False, crowded.isEmpty()
    while not done:
        open_ = crowded.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("comp", F.xxhash64(F.coalesce("root", "set"))).join(known, "set")
        new = staged(_candidates(open_, percent, small, whole).join(asked.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "na", "nb"))
        found = False
        if not new.isEmpty():
            asked, more = asked.union(new), staged(_linked(new, segments, percent, few=True))
            found = not more.isEmpty()
        if found:
            links = links.union(more)
            roots = components(links)
        done, whole = whole, not found
    top = sets.join(roots.withColumnRenamed("node", "set"), "set", "left").select("set", "least", F.coalesce("root", "set").alias("root"))
    least = top.groupBy("root").agg(F.min("least").alias("component_id"))
    own = top.join(least, "root").select("set", "component_id")
    out = named.where("n > 0").select("key", "n", "set").join(own, "set").select("key", "n", "component_id")
    empty = named.where("n = 0").select("key", "n", F.col("key").alias("component_id"))
    return out.union(empty).select(F.col("key").cast(kind).alias(key), F.col("n").alias("n_shingles"), "component_id")


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
