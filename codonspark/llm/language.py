"""Operator 7, language identification by a linear-chain conditional random field over words.

Words are runs of letters, in lower case. A word's features are its byte n-grams of two to four with marks at both ends,
which are prefixes and suffixes where they touch a mark, and the word itself as a lexicon
entry. Label transitions are learned with them, on sequences spliced from stretches of documents of all languages, so
that the field knows how rarely text switches. Forward-backward gives each word's label
probabilities; a document's language is the label with the largest sum, its score that sum's share.

Training takes a sample bounded by `per_label` documents of each language, dealt by a hash of the key, and of each at most
`stretches` stretches of `STRETCH` words spread over the whole text. Everything else reads whole texts. The
model is a table of 2^18 rows for each language, which is what is broadcast.

Defined cases: null texts and texts without a letter get `und` with score 0; ties go to the first label in order; a
text of any length is one chain, worked on in pieces of `CHAIN` words that pass their messages to each other both ways; repeated rows get equal answers; without any training
row every text is `und`; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices

STRETCH = 24
CHAIN = 2048
_BITS = 18
_WORD = re.compile(r"[^\W\d_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def held_out(key: object, folds: int = 4, fold: int = 2) -> bool:
    return zlib.crc32(("" if key is None else str(key)).encode()) % folds == fold


def letter_words(text: str | None) -> list[str]:
    """Runs of letters; a run of numerals that aren't digits, as superscripts, is none."""
    return [w for w in _WORD.findall(text.lower()) if w.isascii() or any(map(str.isalpha, w))] if text else []


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(feature rows of all words one after the other, place of each word's first)."""
    marked = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), dtype=np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], dtype=np.int64)
    ends, n = np.cumsum(size), len(marked)
    owner = np.repeat(np.arange(len(words)), size)
    left = ends[owner] - np.arange(n)
    rows, owners = [], []
    code = marked.copy()
    for k in range(2, 5):
        code[: n - k + 1] |= marked[k - 1 :] << np.uint64(8 * (k - 1))
        at = np.nonzero(left >= k)[0]
        rows.append((((code[at] & np.uint64((1 << (8 * k)) - 1)) + np.uint64(k)) * _MUL) >> np.uint64(64 - _BITS))
        owners.append(owner[at])
    weight = np.uint64(0x100000001B3) ** (np.arange(int(size.max(initial=1))).astype(np.uint64))
    whole = np.add.reduceat((marked + np.uint64(1)) * weight[np.arange(n) - (ends - size)[owner]], ends - size) if n else np.empty(0, dtype=np.uint64)
    rows.append((whole * _MUL) >> np.uint64(64 - _BITS))
    owners.append(np.arange(len(words)))
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(rows)[order].astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(owners), minlength=len(words)))[:-1]])


@dataclass
class Field:
    """A trained field: weights by feature row and label, transition weights, labels in order."""

    weights: np.ndarray
    moves: np.ndarray
    labels: list[str]

    def emissions(self, words: list[bytes]) -> np.ndarray:
        rows, first = features(words)
        return np.add.reduceat(self.weights[rows], first, axis=0) if len(words) else np.zeros((0, len(self.labels)), dtype=np.float32)


def forward_backward(emit: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label probabilities, forward probabilities), both (sequence, word, label), from scores of words and of transitions."""
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    a = np.exp(moves)
    forward = np.empty_like(e)
    forward[:, 0] = f = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, e.shape[1]):
        f = (f @ a) * e[:, t]
        forward[:, t] = f = f / f.sum(axis=1, keepdims=True)
    marginal, b = forward.copy(), np.ones_like(f)
    for t in range(e.shape[1] - 2, -1, -1):
        b = (b * e[:, t + 1]) @ a.T
        b /= b.sum(axis=1, keepdims=True)
        marginal[:, t] *= b
    return marginal / marginal.sum(axis=2, keepdims=True), forward


def _masked(emit: np.ndarray, moves: np.ndarray, sizes: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """forward_backward for sequences of unequal sizes: past a sequence's end nothing flows back into it.

    before and after: by sequence and label, what the words before it say of its first word and those after it of its last.
    """
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    a = np.exp(moves).astype(e.dtype)
    out = np.empty_like(e)
    f = e[:, 0] if before is None else e[:, 0] * before.astype(e.dtype)
    out[:, 0] = f = f / f.sum(axis=1, keepdims=True)
    for t in range(1, e.shape[1]):
        f = (f @ a) * e[:, t]
        out[:, t] = f = f / f.sum(axis=1, keepdims=True)
    b = np.ones_like(f) if after is None else after.astype(e.dtype).copy()
    out[:, -1] *= b
    for t in range(e.shape[1] - 2, -1, -1):
        inside = np.searchsorted(-sizes, -(t + 1), side="left")  # sizes fall, so sequences with word t + 1 come first
        step = (b[:inside] * e[:inside, t + 1]) @ a.T
        b[:inside] = step / step.sum(axis=1, keepdims=True)
        out[:, t] *= b
    return out / out.sum(axis=2, keepdims=True)


def _messages(emit: np.ndarray, moves: np.ndarray, sizes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, after) of pieces of sequences, in order; begins marks those that begin a sequence.

    Each piece's words make one matrix from the label before it to the label of its last word; all pieces' matrices are made side by side, then messages go over the pieces.
    """
    e, a, k = np.exp(emit - emit.max(axis=2, keepdims=True)), np.exp(moves).astype(emit.dtype), moves.shape[0]
    first, later = np.nonzero(begins)[0], np.nonzero(~begins)[0]
    ends = np.ones((len(sizes), k))  # of pieces that begin a sequence, the label probabilities of their last word
    f = e[first, 0]
    for t in range(1, e.shape[1]):
        f = (f @ a) * e[first, t]
        f /= f.sum(axis=1, keepdims=True)
    ends[first] = f  # a piece that another follows is full
    through = np.broadcast_to(np.eye(k, dtype=e.dtype), (len(later), k, k)).copy()
    for t in range(e.shape[1]):
        inside = t < sizes[later]
        step = (through[inside] @ a) * e[later[inside], t][:, None, :]
        through[inside] = step / step.sum(axis=(1, 2), keepdims=True)
    moved = np.empty((len(sizes), k, k))
    moved[later] = through
    before, after = np.ones((len(sizes), k)), np.ones((len(sizes), k))
    for i in later.tolist():
        before[i] = ends[i - 1] @ a
        ends[i] = ends[i - 1] @ moved[i]
        ends[i] /= ends[i].sum()
    for i in later[::-1].tolist():
        after[i - 1] = moved[i] @ after[i]
        after[i - 1] /= after[i - 1].sum()
    return before, after


def fit(samples: list[tuple[str, list[str]]], rounds: int = 60, seed: int = 7, length: int = 48, l2: float = 1e-6) -> Field:
    """Maximum likelihood by Adam over sequences spliced from (label, words) stretches."""
    labels, draw = sorted({x for x, _ in samples}), np.random.default_rng(seed)
    stream: list[tuple[str, int]] = []
    for i in draw.permutation(len(samples)).tolist():
        stream += [(w, labels.index(samples[i][0])) for w in samples[i][1]]
    stream = stream[: max(1, len(stream) // length) * length]
    length = min(length, len(stream))
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for w, _ in stream))}
    word = np.array([vocabulary[w] for w, _ in stream]).reshape(-1, length)
    gold = np.array([y for _, y in stream]).reshape(-1, length)
    rows, first = features([w.encode() for w in vocabulary])
    owner = np.repeat(np.arange(len(vocabulary)), np.diff(np.append(first, len(rows))))
    used, rows = np.unique(rows, return_inverse=True)
    k, one = len(labels), np.eye(len(labels))[gold]
    weights, moves = np.zeros((len(used), k)), np.zeros((k, k))
    state = [np.zeros_like(x) for x in (weights, weights, moves, moves)]
    pairs = np.einsum("sti,stj->ij", one[:, :-1], one[:, 1:])
    for step in range(1, rounds + 1):
        emit = np.add.reduceat(weights[rows], first, axis=0)[word]
        marginal, forward = forward_backward(emit, moves)
        gap = np.zeros((len(vocabulary), k))
        for y in range(k):
            gap[:, y] = np.bincount(word.ravel(), (one - marginal)[:, :, y].ravel(), minlength=len(vocabulary))
        slope = np.stack([np.bincount(rows, gap[owner, y], minlength=len(used)) for y in range(k)], axis=1) / word.size - l2 * weights
        a = np.exp(moves)
        reach = forward[:, :-1] @ a  # a pair's probability is forward, move, and what the second word's probability adds to its reach
        turn = (pairs - a * np.einsum("sti,stj->ij", forward[:, :-1], marginal[:, 1:] / np.maximum(1e-300, reach))) / word.size
        for x, g, m, v in ((weights, slope, state[0], state[1]), (moves, turn, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    table = np.zeros((1 << _BITS, k), dtype=np.float32)
    table[used] = weights
    return Field(table, moves.astype(np.float32), labels)


def train(docs: DataFrame, per_label: int = 400, stretches: int = 4) -> Field | None:
    """Field learned from (key, text, lang) rows that are not held out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            lang, found = [], []
            for key, text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = letter_words(text)
                if not words or held_out(key):
                    continue
                n = max(1, min(stretches, len(words) // STRETCH))
                for i in range(n):
                    at = (len(words) - STRETCH) * i // max(1, n - 1) if n > 1 else 0
                    lang.append(y)
                    found.append(words[at : at + STRETCH])
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(found, pa.list_(pa.string()))], names=["lang", "words"])

    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    shares = {r["lang"]: min(1.0, 1.4 * per_label / r["count"]) for r in labelled.groupBy("lang").count().collect()}
    if not shares:
        return None
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    sample = labelled.where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 30)) < share * (1 << 30))
    rows = sample.mapInArrow(cut, "lang string, words array<string>").collect()
    samples = sorted((r["lang"], list(r["words"])) for r in rows)
    return fit(samples) if samples else None


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", field: Field | None = None) -> DataFrame:
    """(key, held_out, lang_pred, score, n_words, spans array<struct<lang, n>>) of each row; spans are runs of words with one most probable label."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    field = field or train(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")))
    sent = docs.sparkSession.sparkContext.broadcast((field.weights, field.moves, field.labels) if field else None)
    span = pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(*sent.value) if sent.value else None
        for batch in slices(batches, 4 << 20):
            keys = batch.column(0).to_pylist()
            words = [letter_words(t) if model else [] for t in batch.column(1).to_pylist()]
            total, best = _label(words, model) if model else (np.zeros((len(words), 1)), [np.empty(0, dtype=np.int64)] * len(words))
            mass = total.sum(axis=1)
            top = total.argmax(axis=1)
            pred = [model.labels[i] if m > 0 else "und" for i, m in zip(top.tolist(), mass.tolist(), strict=True)]
            score = np.where(mass > 0, total.max(axis=1) / np.maximum(mass, 1e-9), 0.0).clip(0, 1)
            spans = []
            for x in best:
                edge = np.concatenate([[0], np.nonzero(np.diff(x))[0] + 1, [len(x)]]) if len(x) else np.zeros(1, dtype=np.int64)
                spans.append([{"lang": model.labels[int(x[a])], "n": int(b - a)} for a, b in zip(edge[:-1], edge[1:], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([held_out(k) for k in keys]), pa.array(pred), pa.array(score), pa.array([len(w) for w in words], pa.int64()), pa.array(spans, span)],
                names=["key", "held_out", "lang_pred", "score", "n_words", "spans"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, held_out boolean, lang_pred string, score double, n_words long, spans array<struct<lang:string,n:long>>").withColumnRenamed("key", key)


def _label(words: list[list[str]], model: Field) -> tuple[np.ndarray, list[np.ndarray]]:
    """(sum of label probabilities of each text, most probable label of each word of each text)."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    named = pa.array([x for w in words for x in w], pa.string()).dictionary_encode()
    total, best = np.zeros((len(words), len(model.labels))), np.zeros(int(sizes.sum()), dtype=np.int64)
    if sizes.sum():
        emit = model.emissions([w.encode() for w in named.dictionary.to_pylist()])
        index = named.indices.to_numpy()
        starts = np.cumsum(sizes) - sizes
        # (first word, words, text, what lies before, what lies after) of pieces of CHAIN words; pieces of one text pass messages to each other
        pieces = [(a, min(CHAIN, s + n - a), i, a == s) for i, (s, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)) for a in range(s, s + n, CHAIN)]
        one = np.ones(len(model.labels))
        cut = [j for j, (_, _, i, _) in enumerate(pieces) if sizes[i] > CHAIN]
        before, after = dict.fromkeys(range(len(pieces)), one), dict.fromkeys(range(len(pieces)), one)
        if cut:
            size = np.array([pieces[j][1] for j in cut])
            place = np.minimum(np.array([pieces[j][0] for j in cut])[:, None] + np.arange(CHAIN), len(index) - 1)
            found = _messages(emit[index[place]], model.moves, size, np.array([pieces[j][3] for j in cut]))
            before |= dict(zip(cut, found[0], strict=True))
            after |= dict(zip(cut, found[1], strict=True))
        chains = [(a, m, i, before[j], after[j]) for j, (a, m, i, _) in enumerate(pieces)]
        chains.sort(key=lambda c: -c[1])
        at = 0
        while at < len(chains):
            group = chains[at : at + max(1, (1 << 19) // chains[at][1])]
            at += len(group)
            first, size = np.array([c[0] for c in group]), np.array([c[1] for c in group])
            place = np.minimum(first[:, None] + np.arange(size[0]), len(index) - 1)
            inside = np.arange(size[0]) < size[:, None]
            p = _masked(emit[index[place]], model.moves, size, np.array([c[3] for c in group]), np.array([c[4] for c in group]))
            np.add.at(total, [c[2] for c in group], np.where(inside[:, :, None], p, 0).sum(axis=1))
            best[place[inside]] = p.argmax(axis=2)[inside]
    return total, np.split(best, np.cumsum(sizes)[:-1]) if len(words) else []


def op7_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "n_words", F.size("spans").cast("long").alias("n_spans"))
