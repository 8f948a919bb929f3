"""Operator 3, mixing sources to target weights. DataFrame functions only.

The words of each source, documents in a fixed pseudorandom order, are packed into blocks of
`block_words`; the last block may be shorter. A source's quota of slots is what its target in words needs: whole
passes over its blocks, then part of one more, whose last slot is cut to the word. Each slot of each output shard draws
its source with the odds of the quotas, so that a shard's counts of sources are multinomial. The slots of a source, numbered over the shards from these counts,
go through a pseudorandom permutation to its indices; the few slots of sources drawn too often go to indices of those drawn too seldom, so
that quotas hold. Index k of a source is block perm(k mod n) of its k div n th pass. Permutations are Feistel networks keyed by
source and pass, computed per slot without a table. Slots and packed pieces of documents meet in a join by (source, block).

No source is held in one task: prefix sums over a source run in chunks of documents, then over the
chunks' sums, and slots are generated by a range, not source by source. Only the sources' number of rows is ever in one window.

Defined cases: a null or empty text has no words, is never taken and counts in no block; a null
source is a source of its own, last in order; sources without words have target 0; repeated rows and null keys are
taken each for itself; equal weights or sizes are ordered by source; a text of any length is a row whose words are counted, then cut into pieces by block; an
empty table gives an empty result; extra columns are not read by the query and kept by mixed_documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, let, n_words_of, read_table, running, staged, words_of

BLOCK_WORDS = 512
SHARD_SLOTS = 4096
WEIGHTS = (3, 1, 2)
_ROUNDS = 6
_STEP = 1 << 16


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def shuffled(x: Column, n: Column, key: Column, inverse: bool = False) -> Column:
    """A pseudorandom permutation of 0 to n - 1 by key: a Feistel network over a grid of a by b cells, a the least whole number not under the root of n.

    Fewer than a cells lie beyond n. What falls there walks on through the network until it falls inside, which only one in a of the n needs at all.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    rounds = F.array(*[F.lit(r) for r in (range(_ROUNDS - 1, -1, -1) if inverse else range(_ROUNDS))])

    def network(at: Column, p: Column) -> Column:
        def turned(x: Column, other: Column, size: Column, r: Column) -> Column:
            by = F.pmod(F.xxhash64(p["key"], r, other), size)
            return F.pmod(x - by if inverse else x + by, size)

        def step(s: Column, r: Column) -> Column:
            even = F.struct(turned(s["row"], s["column"], p["a"], r).alias("row"), s["column"].alias("column"))
            odd = F.struct(s["row"].alias("row"), turned(s["column"], s["row"], p["b"], r).alias("column"))
            return F.when(r % 2 == 0, even).otherwise(odd)

        start = F.struct(F.floor(at / p["b"]).cast("long").alias("row"), F.pmod(at, p["b"]).alias("column"))
        return F.aggregate(rounds, start, step, lambda s: s["row"] * p["b"] + s["column"])

    def permuted(p: Column) -> Column:
        walk = lambda first: F.aggregate(F.sequence(_long(1), p["a"]), first, lambda at, _: F.when(at < p["n"], at).otherwise(network(at, p)))
        return let(network(p["x"], p), lambda first: F.when(first < p["n"], first).otherwise(walk(first)))

    return let(F.struct(x.cast("long").alias("x"), n.alias("n"), key.alias("key"), a.alias("a"), F.ceil(n / a).cast("long").alias("b")), permuted)


def targets(sources: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds weight and target to (source, source_size): weights repeat in order of the source, null last; what lies above cap times a source is shared out again by weight."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    full = F.col("cap") / F.col("weight")
    by_full = W.orderBy(full, F.col("source").asc_nulls_last())
    before, after = by_full.rowsBetween(W.unboundedPreceding, -1), by_full.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        sources.withColumn("weight", weight)
        .withColumn("cap", cap * F.col("source_size"))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(full > F.col("level"), F.col("level"))).over(everything))
        .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))))
        .drop("level", "cap")
    )


def _planned(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """Adds to each source its number of blocks, its quota of slots, the length of the last slot and the first slot's number."""
    size, nb = F.col("source_size"), F.col("n_blocks")
    j0, r, short = F.col("j0"), F.col("r"), block - (size - (nb - 1) * block)
    whole = F.ceil(F.col("r") / block).cast("long")
    part = F.when(whole <= j0, whole).otherwise(F.ceil((r + short) / block).cast("long"))
    earlier = (F.col("part") - 1) * block - F.when(F.col("part") - 1 > j0, short).otherwise(0)
    quota = W.orderBy("src").rowsBetween(W.unboundedPreceding, -1)
    return (
        sources.withColumn("n_blocks", F.ceil(size / block).cast("long"))
        .withColumn("want", F.round("target").cast("long"))
        .withColumn("passes", F.when(size > 0, F.floor(F.col("want") / size)).otherwise(0).cast("long"))
        .withColumn("r", F.col("want") - F.col("passes") * size)
        .withColumn("j0", F.when(size > 0, shuffled(nb - 1, nb, F.xxhash64("src", "passes", F.lit(seed)), inverse=True)))
        .withColumn("part", F.when(r > 0, part).otherwise(0).cast("long"))
        .withColumn("quota", F.col("passes") * nb + F.col("part"))
        .withColumn("cut", F.when(r > 0, r - earlier).otherwise(block).cast("long"))
        .withColumn("first", F.coalesce(F.sum("quota").over(quota), _long(0)))
        .select("src", "source", "source_size", "target", "n_blocks", "quota", "cut", "first")
    )


def _sized(docs: DataFrame, key: str, text: str, source: str, row: str | None = None) -> DataFrame:
    """(row, key, src, source, size) of each row; src names the source and is never null. Rows are numbered unless a column has their ids."""
    src = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))
    return docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col(key).alias("key"), F.xxhash64(text).alias("hash"), src.alias("src"), F.col(source).alias("source"), n_words_of(F.col(text)).alias("size"))


def plan_sources(sized: DataFrame, block: int, share: float, cap: float, weights: tuple[int, ...], seed: int) -> DataFrame:
    sums = sized.groupBy("src", "source").agg(F.sum("size").alias("source_size"))
    return checkpointed(_planned(targets(sums, share, cap, weights), block, seed))


def packed(sized: DataFrame, block: int, seed: int, chunk_rows: int = 8192) -> DataFrame:
    """Pieces (row, src, block, lo, hi, at): words lo to hi of a block are the words from `at` on of the row."""
    chunks = max(1, -(-sized.count() // chunk_rows))
    # rows go by key and text, whatever order they are read in; only of those that more rows share than a chunk is to hold, which are all alike, each goes by its own id
    shared = sized.groupBy(F.xxhash64("key").alias("k"), "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk_rows)
    own = F.when(F.col("n").isNotNull(), F.col("row")).otherwise(_long(-1))
    found = sized.where("size > 0").withColumn("k", F.xxhash64("key")).join(shared, ["k", "hash"], "left")
    dealt = found.withColumn("chunk", F.pmod(F.xxhash64("k", "hash", own, F.lit(seed)), _long(chunks))).drop("k", "n")
    sums = dealt.groupBy("src", "chunk").agg(F.sum("size").alias("n"))
    starts = sums.select("src", "chunk", (F.sum("n").over(W.partitionBy("src").orderBy("chunk")) - F.col("n")).alias("chunk_start"))
    inside = W.partitionBy("src", "chunk").orderBy("key", "size", "hash", "row")
    placed = (
        dealt.withColumn("end", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .join(starts, ["src", "chunk"])
        .withColumn("end", F.col("end") + F.col("chunk_start"))
        .withColumn("start", F.col("end") - F.col("size"))
    )
    span = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))
    return placed.select("row", "src", "start", "end", F.explode(span).alias("block")).select(
        "row",
        "src",
        "block",
        (F.greatest("start", F.col("block") * block) - F.col("block") * block).alias("lo"),
        (F.least("end", (F.col("block") + 1) * block) - F.col("block") * block).alias("hi"),
        (F.greatest("start", F.col("block") * block) - F.col("start")).alias("at"),
    )


def _placed(x: DataFrame, at: str, runs: DataFrame, first: str, n: str) -> DataFrame:
    """x with the columns of the run (first, n) that its column `at` lies in. Runs are cut at multiples of _STEP for an equality join."""
    cut = runs.where(F.col(n) > 0).withColumn("step", F.explode(F.sequence(F.floor(F.col(first) / _STEP), F.floor((F.col(first) + F.col(n) - 1) / _STEP))))
    joined = x.withColumn("step", F.floor(F.col(at) / _STEP)).join(cut, "step").drop("step")
    return joined.where((F.col(at) >= F.col(first)) & (F.col(at) < F.col(first) + F.col(n)))


def shard_draws(sources: DataFrame, shard_slots: int, seed: int) -> tuple[DataFrame, int]:
    """((x, shard, slot, src) of every slot of the mix, number of slots): each slot of a shard draws its source with the odds of the quotas, so a shard's counts of sources are a multinomial draw."""
    n = sources.agg(F.sum("quota")).first()[0] or 0
    per_shard = -(-n // max(1, round(n / shard_slots))) if n else 1
    x = sources.sparkSession.range(n, numPartitions=max(1, -(-n // _STEP))).withColumnRenamed("id", "x").withColumn("pick", F.pmod(F.xxhash64("x", F.lit(seed), F.lit("draw")), _long(max(1, n))))
    drawn_ = _placed(x, "pick", sources.select("src", "quota", "first"), "first", "quota")
    return drawn_.select("x", F.floor(F.col("x") / per_shard).alias("shard"), (F.col("x") % per_shard).alias("slot"), "src"), n


def slots(sources: DataFrame, block: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, slot, src, pass, block, length) of every slot of the mix.

    A shard's slots of a source are numbered after those of the shards before it, from its counts. The number goes through a permutation of the source's slots; what comes out under the
    quota is the slot's index. Totals of the draws miss the quotas by their root at most or so: slots that come out over the quota of their source are dealt, by one permutation of them all, to the
    indices of sources that were drawn too seldom, so that every index is taken once.
    """
    draws, _ = shard_draws(sources, shard_slots, seed)
    draws = staged(draws)
    counts = checkpointed(draws.groupBy("src", "shard").agg(F.count(F.lit(1)).alias("n")))
    before = running(counts, ["shard"], ["n"], keys=["src"]).select("src", "shard", (F.col("__sum_n") - F.col("n")).alias("before"))
    by_name = W.orderBy("src").rowsBetween(W.unboundedPreceding, -1)
    over, under = F.greatest(F.col("n") - F.col("quota"), _long(0)), F.greatest(F.col("quota") - F.col("n"), _long(0))
    planned = checkpointed(
        sources.where("quota > 0").join(counts.groupBy("src").agg(F.sum("n").alias("n")), "src", "left").withColumn("n", F.coalesce("n", _long(0)))
        .withColumns({"over": over, "under": under}).withColumns({"over_first": F.coalesce(F.sum("over").over(by_name), _long(0)), "under_first": F.coalesce(F.sum("under").over(by_name), _long(0))})
    )
    left = planned.agg(F.sum("over")).first()[0] or 0
    inside = W.partitionBy("src", "shard").orderBy("slot")
    numbered = draws.withColumn("k", F.row_number().over(inside) - 1).join(before, ["src", "shard"]).withColumn("k", F.col("k") + F.col("before"))
    indexed = numbered.join(planned.select("src", "n", "quota", "over_first"), "src").withColumn("k", shuffled(F.col("k"), F.col("n"), F.xxhash64("src", F.lit(seed), F.lit("index"))))
    given = indexed.where("k >= quota").select("shard", "slot", shuffled(F.col("over_first") + F.col("k") - F.col("quota"), _long(max(1, left)), F.xxhash64(F.lit(seed), F.lit("over"))).alias("g"))
    moved = _placed(given, "g", planned.select("src", F.col("n").alias("drawn"), "under", "under_first"), "under_first", "under")
    every = indexed.where("k < quota").select("shard", "slot", "src", "k").union(moved.select("shard", "slot", "src", (F.col("drawn") + F.col("g") - F.col("under_first")).alias("k")))
    k, nb = F.col("k"), F.col("n_blocks")
    to = shuffled(k % nb, nb, F.xxhash64("src", F.floor(k / nb), F.lit(seed)))
    return every.join(sources.select("src", "n_blocks", "quota", "cut"), "src").select(
        "shard", "slot", "src", F.floor(k / nb).alias("pass"), to.alias("block"), F.when(k == F.col("quota") - 1, F.col("cut")).otherwise(block).alias("length")
    )


def drawn(sized: DataFrame, sources: DataFrame, block: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, slot, pass, row, at, n): the mix as runs of n words from word `at` of a row."""
    pieces = packed(sized, block, seed)
    return pieces.join(slots(sources, block, shard_slots, seed), ["src", "block"]).where("lo < length").select(
        "shard", "slot", "pass", "row", "at", (F.least("hi", "length") - F.col("lo")).alias("n")
    )


def mixed_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 3) -> DataFrame:
    """(key, size, source_size, target, taken) of each row."""
    sized = checkpointed(_sized(docs, key, text, source))
    sources = plan_sources(sized, block, share, cap, weights, seed)
    taken = drawn(sized, sources, block, shard_slots, seed).groupBy("row").agg(F.sum("n").alias("taken"))
    return (
        sized.join(taken, "row", "left")
        .join(sources.select("src", "source_size", "target"), "src")
        .select(F.col("key").alias(key), "size", "source_size", "target", F.coalesce("taken", _long(0)).alias("taken"))
    )


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 3) -> DataFrame:
    """The mix as documents: a row for each pass that takes words of a document, all columns kept. A pass that takes all its words
    leaves the text as it is, else the text is the words taken, in order, with a space between. Rows are named by an id of their own: those that repeat a key, or have none, are each packed for themselves."""
    named = staged(docs.withColumn("__row", F.monotonically_increasing_id()).withColumn("__key", F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("hash"))))
    sized = checkpointed(_sized(named, "__key", text, source, "__row"))
    sources = plan_sources(sized, block, share, cap, weights, seed)
    runs = drawn(sized, sources, block, shard_slots, seed).groupBy("row", "pass").agg(F.sum("n").alias("taken"), F.sort_array(F.collect_list(F.struct("at", "n"))).alias("runs"))
    runs = runs.join(sized.select("row", "size"), "row").select(F.col("row").alias("__row"), F.when(F.col("taken") < F.col("size"), F.col("runs")).alias("__runs"))
    part = F.array_join(F.flatten(F.transform("__runs", lambda r: F.slice(F.col("__words"), (r["at"] + 1).cast("int"), r["n"].cast("int")))), " ")
    joined = named.join(runs, "__row").withColumn("__words", F.when(F.col("__runs").isNotNull(), words_of(F.col(text))))
    return joined.withColumn(text, F.when(F.col("__runs").isNull(), F.col(text)).otherwise(part)).select(*docs.columns)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_counts(read_table(spark, sf_dir, "documents"))
