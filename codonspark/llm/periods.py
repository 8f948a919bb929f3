"""Operator 11, periodic runs of words by internal pattern matching.

A run is a stretch of consecutive words with smallest period q, at least `min_length` and 2q long, that no neighbouring word
extends. Each text is worked on whole; the texts of a batch lie one after the other, and no two words of different texts agree.

- Ranks of all factors of length 1, 2, 4, ... come from prefix doubling, which leaves the suffix array; a factor's
  occurrences are an interval of it, from its rank on.
- A run of period q holds a dyadic block, one of length B at a multiple of B, together with the block's copy q further, if
  2B - 1 <= max(q, min_length - q). So each block asks for its occurrences in the neighbouring window of the periods
  that fall to its length: range successor in a wavelet matrix over the suffix array, in time of its height.
- Occurrences at most B/2 apart are a progression whose difference is the block's period. A block that lies in the same
  periodic stretch gives that difference alone; else each term gives its distance as a candidate period.
- A candidate is extended to both sides by the ranks, longest factors first. Stretches of equal place and length keep the least period.

Candidates are at most some n/B * B/d for a block length and progressions of difference d, so time is n log^2 n, never n squared.

Defined cases: null, empty and blank texts have no word and no run, and collapse to the empty text; a text of any length is
worked on whole in one task, some 4 bytes for each word and level of repetition; repeated rows and a null or repeated
doc_id are each judged for themselves; an empty table gives an empty result; extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read_table, slices, words_of

MIN_LENGTH = 12


class Factors:
    """Ranks of the factors of length 2^k of texts that lie one after the other, and their suffix array."""

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        """words: codes; ends: of each word, where its text ends."""
        n = len(words)
        order = np.lexsort((words, ends))
        same = (words[order][1:] == words[order][:-1]) & (ends[order][1:] == ends[order][:-1])
        rank = np.empty(n, dtype=np.int32)
        rank[order] = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(n), 0))
        self.n, self.levels, self.sizes = n, [rank], [np.bincount(rank, minlength=n).astype(np.int32)]
        while True:
            size = self.sizes[-1]
            open_ = np.nonzero(size[rank[order]] > 1)[0]
            if not len(open_):
                break
            at = order[open_]
            ahead = at + (1 << (len(self.levels) - 1))
            second = np.where(ahead < ends[at], rank[np.minimum(ahead, n - 1)].astype(np.int64) + 1, 0)
            pair = rank[at].astype(np.int64) * (n + 1) + second
            turn = np.argsort(pair, kind="stable")
            order[open_], pair = at[turn], pair[turn]
            new = np.concatenate([[True], pair[1:] != pair[:-1]])
            rank = rank.copy()
            rank[order[open_]] = np.maximum.accumulate(np.where(new, open_, 0))
            self.levels.append(rank)
            self.sizes.append(np.bincount(rank, minlength=n).astype(np.int32))
        self.suffixes = order

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from places i and j > i on."""
        i, j = i.copy(), j.copy()
        begun = j.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            agree = (j < self.n) & (rank[np.minimum(i, self.n - 1)] == rank[np.minimum(j, self.n - 1)])
            i += agree * (1 << k)
            j += agree * (1 << k)
        return j - begun

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree before places i and j > i."""
        i, j = i.copy(), j.copy()
        begun = j.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            rank, step = self.levels[k], 1 << k
            agree = (i >= step) & (rank[np.maximum(i - step, 0)] == rank[np.maximum(j - step, 0)])
            i -= agree * step
            j -= agree * step
        return begun - j


class Wavelet:
    """Wavelet matrix of an array of places, for many queries at once."""

    def __init__(self, values: np.ndarray, most: int):
        self.bits = []
        for bit in range(max(1, int(most).bit_length()) - 1, -1, -1):
            ones = (values >> bit) & 1
            zeros = np.concatenate([[0], np.cumsum(1 - ones)]).astype(np.int32)
            self.bits.append((bit, zeros, int(zeros[-1])))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def successor(self, left: np.ndarray, right: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The least value not under `least` within [left, right) of the array; -1 where there is none."""
        a, b, below = left, right, np.zeros(len(left), dtype=np.int64)
        for bit, zeros, ones_at in self.bits:
            up, a0, b0 = ((least >> bit) & 1).astype(bool), zeros[a], zeros[b]
            below += np.where(up, b0 - a0, 0)
            a, b = np.where(up, ones_at + a - a0, a0), np.where(up, ones_at + b - b0, b0)
        below = np.where(least >> len(self.bits), right - left, below)
        there = below < right - left
        a, b, rest, value = left[there], right[there], below[there], np.zeros(int(there.sum()), dtype=np.int64)
        for bit, zeros, ones_at in self.bits:
            a0, b0 = zeros[a], zeros[b]
            up = rest >= b0 - a0
            rest = rest - np.where(up, b0 - a0, 0)
            a, b = np.where(up, ones_at + a - a0, a0), np.where(up, ones_at + b - b0, b0)
            value |= up.astype(np.int64) << bit
        out = np.full(len(left), -1, dtype=np.int64)
        out[there] = value
        return out


def spans(min_length: int, levels: int) -> list[tuple[int, int, int]]:
    """(k, lowest, highest period): the periods that fall to blocks of length 2^k, for all k under `levels`."""
    out, q = [], 1
    while True:
        room = max(q, min_length - q)
        k = ((room + 1) // 2).bit_length() - 1
        if k >= levels and q >= min_length:
            return [x for x in out if x[0] < levels]
        last = q if q < min_length else (4 << k) - 2
        if out and out[-1][0] == k and out[-1][2] == q - 1:
            out[-1] = (k, out[-1][1], last)
        else:
            out.append((k, q, last))
        q = last + 1


def runs(words: np.ndarray, ends: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period, in texts that lie one after the other."""
    none = (np.empty(0, dtype=np.int64),) * 3
    if not len(words):
        return none
    factors = Factors(words, ends)
    n, todo = factors.n, spans(min_length, len(factors.levels))
    if not todo:
        return none
    lowest = min(k for k, _, _ in todo)
    live = factors.sizes[lowest][factors.levels[lowest][factors.suffixes]] > 1
    if not live.any():
        return none
    tree, place = Wavelet(factors.suffixes[live], n), np.concatenate([[0], np.cumsum(live)])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k, lo, hi in todo:
        block = 1 << k
        p = np.arange(0, n, block)
        first = factors.levels[k][p]
        many = factors.sizes[k][first] > 1
        p, first = p[many], first[many]
        left, right = place[first], place[first + factors.sizes[k][first]]
        at = p + lo
        while len(p):
            x = tree.successor(left, right, at)
            go = (x >= 0) & (x <= p + hi)
            p, left, right, x = p[go], left[go], right[go], x[go]
            y = tree.successor(left, right, x + 1)
            dense = (y >= 0) & (y - x <= block // 2)
            found.append((p[~dense], (x - p)[~dense]))
            at = x + 1
            if dense.any():
                own, a, b = p[dense], x[dense], y[dense]
                gap = b - a
                stop, start = b + factors.forward(a, b), a - factors.backward(a, b)
                last = a + (stop - block - a) // gap * gap
                inside = (start <= own) & (own + block <= stop)
                fit = inside & (gap >= lo) & (gap <= hi)
                found.append((own[fit], gap[fit]))
                own, a, gap, upto = own[~inside], a[~inside], gap[~inside], np.minimum(last, p[dense] + hi)[~inside]
                terms = (upto - a) // gap + 1
                step = np.arange(int(terms.sum())) - np.repeat(np.cumsum(terms) - terms, terms)
                found.append((np.repeat(own, terms), np.repeat(a - own, terms) + step * np.repeat(gap, terms)))
                at[dense] = last + 1
    if not found:
        return none
    p, q = (np.concatenate(x) for x in zip(*found, strict=True))
    start = p - factors.backward(p, p + q)
    length = p + q + factors.forward(p, p + q) - start
    long = length >= np.maximum(min_length, 2 * q)
    start, length, q = start[long], length[long], q[long]
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    new = np.ones(len(q), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, q = start[new], length[new], q[new]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def _batch(key: pa.Array, text: pa.Array, min_length: int) -> pa.RecordBatch:
    """One row for each text: key, n_words, runs, collapsed."""
    split = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    row, flat = pc.list_parent_indices(split).to_numpy(), pc.list_flatten(split)
    full = pc.not_equal(flat, "")
    row, flat = row[full.to_numpy(zero_copy_only=False)], flat.filter(full)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(key)))])
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64) if len(flat) else np.empty(0, dtype=np.int64)
    start, length, period = runs(codes, bounds[1:][row], min_length)
    edge = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    kept = np.cumsum(edge)[:-1] == 0
    left = np.concatenate([[0], np.cumsum(kept)])[bounds]
    words = pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(kept)))
    owner = row[start] if len(start) else start
    of_row = np.searchsorted(owner, np.arange(len(key) + 1))
    fields = pa.StructArray.from_arrays([pa.array(start - bounds[owner]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
    columns = [key, pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(of_row, pa.int32()), fields), pc.binary_join(words, " ")]
    return pa.RecordBatch.from_arrays(columns, names=["key", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(key, n_words, runs array<struct<start, length, period>> by start and period, collapsed string) of each row; collapsed
    has no word that a run holds after its first period, and single spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20):
            yield _batch(batch.column(0), batch.column(1), min_length)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("key", key)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or for one document in ten a text that repeats itself from a word on; both drawn by crc32 of the key."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n == 0, "").otherwise(F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " "))

    return F.when(h % 10 == 0, let(words_of(text), repeated)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))), -1)
    top = F.when(F.size("runs") > 0, best)
    return found.withColumn("__top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("__top.start")).alias("start"),
        F.col("__top.length").alias("length"),
        (-F.col("__top.period")).alias("period"),
        F.floor(1000 * F.col("__top.length") / -F.col("__top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: crc32 of a number's decimal digits, as DuckDB has none: a table of 256 from the polynomial, then a fold over the digits.
CRC_SQL = r"""
k AS MATERIALIZED (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS k FROM (SELECT unnest(range(256)) AS i)),
h AS MATERIALIZED (SELECT doc_id, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c // 256, k[xor(c % 256, b) + 1]))) AS h
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), k)
"""

OP11_SQL = (
    "WITH"
    + CRC_SQL
    + r""",
w AS (SELECT d.doc_id, coalesce(h, 1) AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents d LEFT JOIN h USING (doc_id)),
a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM w),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
t AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM p),
e AS MATERIALIZED (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS x FROM t),
s AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.x = y.x AND y.i > x.i AND y.i - x.i <= x.n // 2),
z AS (SELECT doc_id, q, min(i) AS start, count(*) AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS z FROM s) GROUP BY doc_id, q, z),
r AS (SELECT doc_id, start, m + q AS length, min(q) AS period FROM z WHERE m >= q AND m + q >= 12 GROUP BY doc_id, start, m + q),
g AS (SELECT doc_id, count(*) AS n_runs, max(struct_pack(length := length, start := -start, period := -period)) AS top, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
o AS (SELECT e.doc_id, string_agg(e.x, ' ' ORDER BY e.i) AS kept FROM e ANTI JOIN c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY e.doc_id)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, (-top.start)::BIGINT AS start, top.length::BIGINT AS length, (-top.period)::BIGINT AS period,
  (1000 * top.length // -top.period)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN g ON g.doc_id = t.doc_id LEFT JOIN o ON o.doc_id = t.doc_id
"""
)
