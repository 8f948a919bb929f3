"""What the operators of this subpackage share: word rules, the shared checkpoint folder, batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codonspark.functions.shared import checkpointed, freed_shuffles, removed, running, scratch, shared_dir, shared_path, staged

__all__ = ["checkpointed", "freed_shuffles", "removed", "running", "scratch", "shared_dir", "shared_path", "staged"]

#: Separators of the first word rule: space and the controls 09 to 0D.
SPACE = r"\x20\x09-\x0D"
#: Byte table of the second word rule: A-Z lowered, every other ASCII byte that is no digit or letter a space.
_plain = bytes(i + 32 if 65 <= i <= 90 else i if i > 127 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))
#: Byte table that lowers A-Z alone.
_lower = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Words of digits, letters and non-ASCII characters, A-Z lowered; null: none."""
    return text.encode("utf-8", "surrogatepass").translate(_plain).split() if text else []


def spaced_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between ASCII white space (20, 09 to 0D); null: none."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    return (data.translate(_lower) if lower else data).split()


def words_of(text: Column) -> Column:
    """Array of the words between ASCII white space; null: empty. Only the ends of a text can give empty strings, which few texts need removed."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+")
    return let(parts, lambda w: F.when((F.get(w, F.lit(0)) != "") & (F.element_at(w, -1) != ""), w).otherwise(F.array_remove(w, "")))


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into zero-copy slices of about max_bytes of a text column, one row at least."""
    for batch in batches:
        sizes = [0 if v is None else v for v in pa.compute.binary_length(batch.column(column)).to_pylist()]
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
