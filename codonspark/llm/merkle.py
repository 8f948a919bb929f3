"""Operator 12, a Merkle manifest of a dataset whose leaves find their places by ranks in bitmaps.

Every row is a leaf, a digest of its columns. The leaves of a group (a language) ascend by key; eight consecutive nodes become
their parent until one is left, the group's subroot; the subroots, by group, do likewise up to the root.

- Keys are never sorted. 64 neighbouring keys of a group are one word of a bitmap, merged by bit_or before and after the shuffle; words without
  a key don't exist, which is all the compression that sparse keys need. A directory gives each word the count of rows before it: inside a
  bucket of 1024 words by a window that can't be longer, over buckets by running sums.
- A leaf's coordinate is its word's count and the rank of its bit there, the count of lower bits.
- `UNIT` consecutive nodes, four levels, are one block: a block's digests go into an array by slot, and the array is reduced level by
  level. Blocks are nodes of the next round. Then siblings are handed down, block by block, to the leaves.

Nothing depends on how many rows a group has: a block has `UNIT` at most. Rows under one key, or none, are ranked among themselves by
their digests, dealt by ranges (`running`), so that a key of a third of all rows is not one task's.

Defined cases: a null key comes after all others of its group; rows that repeat a key go by their digest, and equal digests in any order, which changes no node; a null group is a
group, the first; null columns and empty texts count as the leaf's rule says; a text of any length is hashed by Spark in its row; an
empty table gives an empty result; extra columns are not read. Keys must be integers; others raise TypeError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType, LongType, StringType, StructField, StructType

from .common import read_table, running, staged

FANOUT = 8
#: Levels that one block reduces, and its nodes at most.
DEPTH = 4
UNIT = FANOUT**DEPTH
_PATH = ArrayType(StructType([StructField("left", StringType()), StructField("right", StringType())]))
_PAIR = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def leaf_hash(columns: Sequence[Column]) -> Column:
    """Lowercase hex sha256 of the values one after the other: `-` for null, else the count of UTF-8 bytes, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def bitmap_index(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (grp, unnamed, word, bit): the directory (grp, unnamed, word, bits, n, start), start being the rows of the group before the word,
    and the groups (grp, g, size), numbered from 0 in their order, null first."""
    words = staged(rows.groupBy("grp", "unnamed", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"), F.count(F.lit(1)).alias("n")).withColumn("bucket", F.shiftright("word", 10)))
    earlier = W.partitionBy("grp", "unnamed", "bucket").orderBy("word").rowsBetween(W.unboundedPreceding, -1)
    counted = words.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    buckets = staged(running(words.groupBy("grp", "unnamed", "bucket").agg(F.sum("n").alias("m")), ["unnamed", "bucket"], ["m"], ["grp"]))
    sizes = buckets.groupBy("grp").agg(F.sum("m").alias("size"))
    groups = staged(running(sizes, ["grp"]).select("grp", (F.col("__rank") - 1).alias("g"), "size"))
    bases = buckets.select(F.col("grp").alias("grp2"), F.col("unnamed").alias("unnamed2"), F.col("bucket").alias("bucket2"), (F.col("__sum_m") - F.col("m")).alias("base"))
    same = counted["grp"].eqNullSafe(F.col("grp2")) & (F.col("unnamed") == F.col("unnamed2")) & (F.col("bucket") == F.col("bucket2"))
    return counted.join(bases, same).select("grp", "unnamed", "word", "bits", "n", (F.col("base") + F.col("before")).alias("start")), groups


def coordinates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (grp, id, leaf, carry) with g, i, size: the number of their group, their place in it by id, and how many it has; and the groups."""
    bit = rows.withColumns({"unnamed": F.col("id").isNull(), "word": F.coalesce(F.shiftright("id", 6), F.lit(0)), "bit": F.coalesce(F.col("id").bitwiseAND(63).cast("int"), F.lit(0))})
    directory, groups = bitmap_index(bit.select("grp", "unnamed", "word", "bit"))
    named = directory.join(groups.withColumnRenamed("grp", "grp3"), directory["grp"].eqNullSafe(F.col("grp3"))).select(F.col("grp").alias("grp2"), F.col("unnamed").alias("unnamed2"), F.col("word").alias("word2"), "bits", "n", "start", "g", "size")
    same = bit["grp"].eqNullSafe(F.col("grp2")) & (F.col("unnamed") == F.col("unnamed2")) & (F.col("word") == F.col("word2"))
    rank = F.expr("bit_count(bits & ~shiftleft(-1L, bit))")
    alone = F.col("n") == F.bit_count("bits")
    found = staged(bit.join(named, same).select("grp", "id", "leaf", "carry", "g", "size", "unnamed", "word", "start", F.when(alone, F.col("start") + rank).alias("i")))
    plain = found.where("i IS NOT NULL").select("grp", "id", "leaf", "carry", "g", "i", "size")
    tied = found.where("i IS NULL")
    if tied.isEmpty():
        return plain, groups
    ranked = running(tied.withColumn("row", F.monotonically_increasing_id()), ["id", "leaf", "row"], keys=["g", "unnamed", "word"])
    return staged(plain.union(ranked.select("grp", "id", "leaf", "carry", "g", (F.col("start") + F.col("__rank") - 1).alias("i"), "size"))), groups


def _levels(slots: list[int], digests: list[str], size: int) -> list[list[str]]:
    """A block's nodes from the given ones up; `size` nodes in the whole group: a group of one block ends at one node, others after DEPTH levels."""
    nodes = [""] * len(slots)
    for s, d in zip(slots, digests, strict=True):
        nodes[s] = d
    out = [nodes]
    while len(nodes) > 1 if size <= UNIT else len(out) <= DEPTH:
        nodes = [hashlib.sha256("".join(nodes[k : k + FANOUT]).encode()).hexdigest() for k in range(0, len(nodes), FANOUT)]
        out.append(nodes)
    return out


def _reduced(nodes: DataFrame) -> DataFrame:
    """(g, i, size, digest) of the blocks of nodes (g, i, size, digest)."""

    def run(block: pa.Table) -> pa.Table:
        size = block.column("size")[0].as_py()
        top = _levels(block.column("slot").to_pylist(), block.column("digest").to_pylist(), size)[-1]
        return pa.table({"g": block.column("g")[:1], "i": block.column("block")[:1], "size": pa.array([-(-size // UNIT)], pa.int64()), "digest": pa.array(top)})

    return _dealt(nodes).groupBy("g", "block").applyInArrow(run, "g long, i long, size long, digest string")


def _dealt(nodes: DataFrame, *more: str) -> DataFrame:
    return nodes.select("g", F.floor(F.col("i") / UNIT).alias("block"), (F.col("i") % UNIT).cast("int").alias("slot"), "size", "digest", *more)


def _handed_down(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Nodes (g, i, size, digest, carry) with path, the siblings (left, right) level by level up to the root, and the root; parents (g, i, path, root) are their blocks."""
    kind = nodes.schema["carry"].dataType
    schema = StructType([StructField("g", LongType()), StructField("i", LongType()), StructField("digest", StringType()), StructField("carry", kind), StructField("path", _PATH), StructField("root", StringType())])

    def run(block: pa.Table, parent: pa.Table) -> pa.Table:
        slots = block.column("slot").to_pylist()
        levels = _levels(slots, block.column("digest").to_pylist(), block.column("size")[0].as_py())
        sides = []
        for nodes in levels[:-1]:
            runs = [nodes[k : k + FANOUT] for k in range(0, len(nodes), FANOUT)]
            sides.append([("".join(r[:c]), "".join(r[c + 1 :])) for r in runs for c in range(len(r))])
        above = [(x["left"], x["right"]) for x in parent.column("path")[0].as_py()]
        left, right = [], []
        for s in slots:
            for pairs in sides:
                left.append(pairs[s][0])
                right.append(pairs[s][1])
                s //= FANOUT
            for a, b in above:
                left.append(a)
                right.append(b)
        width = len(sides) + len(above)
        pairs = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["left", "right"])
        path = pa.ListArray.from_arrays(pa.array(range(0, width * len(slots) + 1, width) if width else [0] * (len(slots) + 1), pa.int32()), pairs)
        first = block.column("block")[0].as_py() * UNIT
        root = pa.array([parent.column("root")[0].as_py()] * len(slots), pa.string())
        places = pa.array([first + s for s in slots], pa.int64())
        return pa.table([block.column("g"), places, block.column("digest"), block.column("carry"), path, root], names=["g", "i", "digest", "carry", "path", "root"])

    blocks = parents.select("g", F.col("i").alias("block"), "path", "root")
    return _dealt(nodes, "carry").groupBy("g", "block").cogroup(blocks.groupBy("g", "block")).applyInArrow(run, schema)


def _rounds(nodes: DataFrame, size: int) -> list[DataFrame]:
    """The nodes, then blocks, blocks of blocks, until groups have one."""
    out = [nodes]
    while size > 1:
        out.append(staged(_reduced(out[-1].select("g", "i", "size", "digest"))))
        size = -(-size // UNIT)
    return out


def manifest(rows: DataFrame, key: str, group: str, leaf: str, carry: Sequence[str] = ()) -> DataFrame:
    """(key, group, carry..., leaf, subroot, root, path array<struct<left, right>>) of each row; path has the hex digests of the siblings to either side, level by level from the leaf to the root."""
    if not isinstance(rows.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} is no integer")
    kept = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    leaves, groups = coordinates(rows.select(F.col(group).alias("grp"), F.col(key).cast("long").alias("id"), F.col(leaf).alias("leaf"), kept.alias("carry")))
    most, count = groups.agg(F.max("size"), F.count(F.lit(1))).first()
    bottom = leaves.select("g", "i", "size", F.col("leaf").alias("digest"), F.struct("grp", "id", "carry").alias("carry"))
    tree = _rounds(bottom, most or 0)
    nothing = F.struct(F.lit(0).alias("none"))
    subroots = tree[-1].select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(count).cast("long").alias("size"), "digest")
    crown = _rounds(subroots, count)
    path = crown[-1].select("g", "i", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    for nodes in crown[-2::-1]:
        path = staged(_handed_down(nodes.withColumn("carry", nothing), path))
    if len(crown) == 1:
        path = path.withColumn("digest", F.col("root"))
    subroot = path.select(F.col("i").alias("g"), F.col("digest").alias("subroot"))
    path = path.select(F.col("i").alias("g"), F.lit(0).cast("long").alias("i"), "path", "root")
    for nodes in tree[-2:0:-1]:
        path = staged(_handed_down(nodes.withColumn("carry", nothing), path))
    if len(tree) > 1:
        out = _handed_down(bottom, path)
    else:
        out = bottom.join(path.select("g", "path", "root"), "g")
    out = out.join(subroot, "g").select(F.col("carry.id").alias(key), F.col("carry.grp").alias(group), F.col("carry.carry").alias("kept"), F.col("digest").alias("leaf"), "subroot", "root", "path")
    return out.select(key, group, *[F.col(f"kept.{c}").alias(c) for c in carry], "leaf", "subroot", "root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256))


def proof_hash(path: Column) -> Column:
    """sha256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lowered).otherwise(F.col("text"))
    rows = docs.select("doc_id", "lang", leaf_hash([F.col(c) for c in LEAF_COLUMNS]).alias("leaf"), leaf_hash([*[F.col(c) for c in LEAF_COLUMNS[:-1]], tampered]).alias("now"))
    found = manifest(rows, "doc_id", "lang", "leaf", ["now"])
    again: Callable[[], Column] = lambda: folded(F.col("now"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), again().alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    from .periods import CRC_SQL

    def leaf(text: str) -> str:
        parts = [*(f"{c}::VARCHAR" for c in LEAF_COLUMNS[:-1]), text]
        return "sha256(" + " || ".join(f"CASE WHEN {p} IS NULL THEN '-' ELSE strlen({p}) || ':' || {p} END" for p in parts) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return (
        "WITH RECURSIVE"
        + CRC_SQL
        + f""",
l AS MATERIALIZED (SELECT d.doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, {leaf("text")} AS leaf, {leaf(f"(CASE WHEN h % 3 = 0 THEN {lowered} ELSE text END)")} AS now
  FROM documents d LEFT JOIN h USING (doc_id)),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l),
t AS (SELECT g, 0 AS level, i, n, leaf AS h FROM o
  UNION ALL SELECT g, level + 1, i // 8, max((n + 7) // 8), sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, level, i // 8),
s AS MATERIALIZED (SELECT g, level, h FROM t WHERE n = 1),
r AS (SELECT 0 AS level, g AS i, (SELECT count(*) FROM s) AS n, h FROM s
  UNION ALL SELECT level + 1, i // 8, max((n + 7) // 8), sha256(string_agg(h, '' ORDER BY i)) FROM r WHERE n > 1 GROUP BY level, i // 8),
v AS MATERIALIZED (SELECT g, level, i, n, h FROM t WHERE n > 1),
x AS MATERIALIZED (SELECT level, i, n, h FROM r WHERE n > 1),
p AS MATERIALIZED (
  SELECT v.g, v.level, v.i, coalesce(string_agg(w.h, '' ORDER BY w.i) FILTER (w.i < v.i), '') AS a, coalesce(string_agg(w.h, '' ORDER BY w.i) FILTER (w.i > v.i), '') AS b
    FROM v JOIN v w ON v.g = w.g AND v.level = w.level AND v.i // 8 = w.i // 8 GROUP BY v.g, v.level, v.i
  UNION ALL SELECT -1, x.level, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), ''), coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '')
    FROM x JOIN x y ON x.level = y.level AND x.i // 8 = y.i // 8 GROUP BY x.level, x.i),
q AS MATERIALIZED (
  SELECT doc_id, leaf, o.i AS row, o.g, k.level, a, b FROM o JOIN p k ON k.g = o.g AND k.i = o.i // (8 ** k.level)::BIGINT
  UNION ALL SELECT doc_id, leaf, o.i, o.g, s.level + k.level, a, b FROM o JOIN s ON s.g = o.g JOIN p k ON k.g = -1 AND k.i = o.g // (8 ** k.level)::BIGINT),
f AS (SELECT g, i, 0 AS level, now AS h FROM o
  UNION ALL SELECT f.g, f.i, f.level + 1, sha256(q.a || f.h || q.b) FROM f JOIN q ON q.g = f.g AND q.row = f.i AND q.level = f.level),
z AS (SELECT g, i, arg_max(h, level) AS folded_root FROM f GROUP BY g, i),
y AS (SELECT g, row AS i, string_agg(a || b, '' ORDER BY level) AS proof FROM q GROUP BY g, row)
SELECT doc_id, leaf, s.h AS subroot, (SELECT h FROM r WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = (SELECT h FROM r WHERE n = 1) AS verified
FROM o JOIN s USING (g) JOIN z USING (g, i) LEFT JOIN y USING (g, i)
"""
    )


OP12_SQL = _sql()
