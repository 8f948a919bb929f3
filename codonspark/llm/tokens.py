"""Operator 5, token counts by offset-mapped attribution.

Each document is encoded once, whole, by a public byte-level vocabulary. Tokens are concatenated
bytes, so their running lengths are offsets into the text; sections are byte spans of the text, and a sorted
search of token bounds in section bounds joins the two. A token that crosses a
boundary is given by rule: `first` (the section of its first byte), `last` (of its last byte), `most`
(the section with most of its bytes, the earliest of equals) or `shared` (to each section its share
of the bytes).

Sections are byte spans given by a function of the text: here the first 100 characters, field `head`, which end inside a token as often as not, and
the lines of what follows, field `body`, each with its line feed; `sentence_ends` and `line_ends` are others.

Defined cases: null and empty texts have no section and no tokens; a text ending in a line feed has no
empty last line; equal shares go to the first section; a special token's string is ordinary text; a text of any length is encoded whole in one task; repeated rows are counted alike; an empty table gives
an empty result; extra columns are not read. The vocabulary file is read by the driver and sent to tasks once: its size is that of the file.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the public vocabulary cuts text before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SENTENCE = re.compile(rb"[.!?]+\s+|\n")
RULES = ("first", "last", "most", "shared")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def line_ends(data: bytes) -> np.ndarray:
    """End offset of each line, its line feed included."""
    ends = np.nonzero(np.frombuffer(data, dtype=np.uint8) == 10)[0] + 1
    return ends if len(data) == 0 or (len(ends) and ends[-1] == len(data)) else np.append(ends, len(data))


def head_and_lines(data: bytes, head: int = 100) -> np.ndarray:
    """End offset of the first `head` characters, then of each line of what follows; a text that is shorter is all head."""
    raw = np.frombuffer(data, dtype=np.uint8)
    starts = np.nonzero((raw & 0xC0) != 0x80)[0]  # first bytes of characters
    if len(starts) <= head:
        return np.array([len(data)] if len(data) else [], dtype=np.int64)
    cut = int(starts[head])
    return np.concatenate([[cut], cut + line_ends(data[cut:])])


def sentence_ends(data: bytes) -> np.ndarray:
    """End offset of each sentence: a mark of its end and the white space after it, or a line feed."""
    ends = np.array([m.end() for m in _SENTENCE.finditer(data)], dtype=np.int64)
    return ends if len(data) == 0 or (len(ends) and ends[-1] == len(data)) else np.append(ends, len(data))


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(tokens by section, boundary-crossing tokens that touch it, how many tokens cross) from the byte ends of tokens and of sections."""
    n = len(section_ends)
    starts = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    a, b = np.searchsorted(section_ends, starts, side="right"), np.searchsorted(section_ends, token_ends, side="left")
    crosses = a != b
    touched = np.zeros(n + 1, dtype=np.int64)
    np.add.at(touched, a[crosses], 1)
    np.add.at(touched, b[crosses] + 1, -1)
    touched = np.cumsum(touched)[:n]
    if rule == "last":
        return np.bincount(b, minlength=n).astype(np.float64), touched, int(crosses.sum())
    counts = np.bincount(a if rule == "first" else a[~crosses], minlength=n).astype(np.float64)
    if rule in ("most", "shared"):
        for i in np.nonzero(crosses)[0]:
            bounds = np.concatenate([[starts[i]], section_ends[a[i] : b[i]], [token_ends[i]]])
            size = np.diff(bounds)
            if rule == "most":
                counts[a[i] + int(size.argmax())] += 1
            else:
                counts[a[i] : b[i] + 1] += size / size.sum()
    return counts, touched, int(crosses.sum())


def section_tokens(
    docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, rule: str = "first", sections: Callable[[bytes], np.ndarray] = head_and_lines
) -> DataFrame:
    """(key, n_tokens, n_crossing, sections array<struct<n_tokens double, n_crossing long, n_bytes long>>) of each row."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    cell = pa.struct([("n_tokens", pa.float64()), ("n_crossing", pa.int64()), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = sent.value
        encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            length[i] = len(token)
        for batch in slices(batches, 4 << 20):
            n_tokens, n_crossing, offsets, counts, touched, sizes = [], [], [0], [], [], []
            for value in batch.column(1).to_pylist():
                data = (value or "").encode()
                ids = np.asarray(encoding.encode_to_numpy(value, disallowed_special=()) if data else [], dtype=np.int64)
                ends = sections(data)
                c, t, crossing = attribute(np.cumsum(length[ids]), ends, rule)
                n_tokens.append(len(ids))
                n_crossing.append(crossing)
                offsets.append(offsets[-1] + len(c))
                counts.append(c)
                touched.append(t)
                sizes.append(np.diff(ends, prepend=0))
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(counts)), pa.array(np.concatenate(touched).astype(np.int64)), pa.array(np.concatenate(sizes).astype(np.int64))], fields=list(cell))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(n_crossing, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)],
                names=["key", "n_tokens", "n_crossing", "sections"],
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, n_crossing long, sections array<struct<n_tokens:double,n_crossing:long,n_bytes:long>>"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def op5_offset_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each section of each document, its head of 100 characters, which ends where it may inside a token, then the lines of its body; and one for a document without text (section null)."""
    found = section_tokens(read_table(spark, sf_dir, "documents"))
    parts = found.select("doc_id", F.col("n_tokens").alias("doc_tokens"), F.posexplode_outer("sections").alias("section", "x"))
    return parts.select(
        "doc_id",
        "section",
        F.when(F.col("section") == 0, "head").when(F.col("section") > 0, "body").alias("field"),
        "doc_tokens",
        F.coalesce(F.col("x.n_tokens"), F.lit(0.0)).cast("long").alias("n_tokens"),
        F.coalesce(F.col("x.n_crossing"), F.lit(0)).cast("long").alias("n_crossing"),
        F.coalesce(F.col("x.n_bytes"), F.lit(0)).cast("long").alias("n_bytes"),
    )
