"""Running posterior of chains that still grow, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

BLOCK = 4096  # iterations of a chain that share one state

MOMENTS = "chain string, block long, n long, last_iter long, sums array<double>, positive array<long>"


def running_posterior(points: DataFrame, keys: list[str], value: str = "value", identity: list[str] | None = None) -> DataFrame:
    """Points, latest iter, running mean and share over 0 by key, of a stream of trace rows.

    identity: columns that name a point, so that a chunk landed twice counts once; their state grows with the
    points unless a watermark column is among them.
    """
    rows = points.dropDuplicates(identity) if identity else points
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.max("iter").alias("last_iter"), F.avg(value).alias("mean"), F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("pp"))


def landed_points(lines: DataFrame, params: Sequence[str], sep: str = "\t") -> DataFrame:
    """(chain, iter, values) of lines `value` of chain, iteration and one number for each of params.

    Left out, to count when they land whole: null and empty lines, lines of another number of fields, without a chain, with an iteration that isn't
    an integer from 0 up, or with a field that isn't a finite number. A line cut inside its last field still looks whole, so lines end in a separator:
    what follows it must be empty.
    """
    f = F.split("value", F.lit(f"[{sep}]"), -1)
    rows = lines.select(f.alias("f")).where(F.size("f") == len(params) + 3)
    rows = rows.select(F.col("f")[0].alias("chain"), F.col("f")[1].try_cast("long").alias("iter"), F.transform(F.slice("f", 3, len(params)), lambda x: x.try_cast("double")).alias("values"), F.element_at("f", -1).alias("end"))
    finite = F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where((F.col("end") == "") & (F.col("chain") != "") & (F.col("iter") >= 0) & finite).drop("end")


def _fold(key: tuple[str, int], frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    """Adds the new points of one block of a chain to its state, which is a bit for each iteration seen, and moments."""
    seen, n, last, sums, positive = (np.zeros(0, np.uint8), 0, -1, np.zeros(0), np.zeros(0, np.int64))
    if state.exists:
        bits, n, last, s, p = state.get
        seen, sums, positive = np.frombuffer(bits, np.uint8), np.frombuffer(s, np.float64), np.frombuffer(p, np.int64)
    seen = np.unpackbits(seen, count=BLOCK) if len(seen) else np.zeros(BLOCK, np.uint8)
    its, values = [np.empty(0, np.int64)], []
    for frame in frames:
        its.append(frame["iter"].to_numpy(dtype=np.int64))
        values += frame["values"].tolist()
    at = np.concatenate(its)
    fresh = np.flatnonzero(seen[at % BLOCK] == 0)
    if not len(fresh):
        return
    rows = np.array([values[i] for i in fresh.tolist()], dtype=np.float64) if len(fresh) < len(at) else np.array(values, dtype=np.float64)
    at = at[fresh]
    order = np.lexsort((*rows.T[::-1], at))  # of several lines of a point the least
    order = order[np.concatenate([[True], at[order][1:] != at[order][:-1]])]
    at, rows = at[order], rows[order]
    seen[at % BLOCK] = 1
    n, last = n + len(rows), max(last, int(at[-1]))
    sums, positive = (sums if n > len(rows) else 0) + rows.sum(axis=0), (positive if n > len(rows) else 0) + (rows > 0).sum(axis=0)
    state.update((np.packbits(seen).tobytes(), n, last, sums.tobytes(), positive.astype(np.int64).tobytes()))
    yield pd.DataFrame({"chain": [key[0]], "block": [key[1]], "n": [n], "last_iter": [last], "sums": [sums.tolist()], "positive": [positive.tolist()]})


def live_moments(points: DataFrame) -> DataFrame:
    """(chain, block, n, last_iter, sums, positive) of each block of iterations that new points changed, in update mode, from a stream of (chain, iter, values).

    A point (chain, iter) counts once, however often it lands and however late: its block remembers it by one bit, so the state is bounded by a bit a point
    and one set of moments for 4096 of them, and no watermark drops late chunks. Blocks of one chain are apart, so a chain that holds most rows is spread.
    Of several lines of one point those of the earliest trigger count, and in it the one with the least values.
    """
    blocked = points.withColumn("block", F.floor(F.col("iter") / BLOCK).cast("long"))
    return blocked.groupBy("chain", "block").applyInPandasWithState(_fold, MOMENTS, "seen binary, n long, last long, sums binary, positive binary", "update", "NoTimeout")


def follow(moments: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream over what has landed; it ends when that is read, and a later call with the same checkpoint goes on from there.

    Each trigger is a folder of the table named by its number. A trigger that is run again, as after a lost driver, writes its own folder anew, so it counts once.
    """

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{table}/batch={batch}")

    return moments.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()


def live_posterior(spark: SparkSession, table: str, params: Sequence[str]) -> DataFrame:
    """(chain, param, n, last_iter, mean, pp) of the table that follow writes: the latest moments of each block, added by chain.

    A chain without a whole line has no row. Rows shuffled are one for each block and trigger that changed it, and less after partial aggregation.
    """
    schema = f"{MOMENTS}, batch long"
    latest = spark.read.schema(schema).parquet(table).groupBy("chain", "block").agg(F.max_by(F.struct("n", "last_iter", "sums", "positive"), "batch").alias("m")).select("chain", "m.*")
    by_param = latest.select("chain", "n", "last_iter", F.posexplode(F.arrays_zip("sums", "positive")).alias("p", "x"))
    names = F.array(*[F.lit(p) for p in params])
    total = by_param.groupBy("chain", "p").agg(F.sum("n").alias("n"), F.max("last_iter").alias("last_iter"), F.sum("x.sums").alias("s"), F.sum("x.positive").alias("k"))
    return total.select("chain", names[F.col("p")].alias("param"), "n", "last_iter", (F.col("s") / F.col("n")).alias("mean"), (F.col("k") / F.col("n")).alias("pp"))
