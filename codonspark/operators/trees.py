"""Trees as node tables (tree, node_id, parent_id, child_rank, name, branch_length, is_leaf, depth)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonspark.functions.shared import checkpointed, running
from codonspark.operators.alignment import match_taxa_prefix
from codonspark.operators.posterior import posterior_quantiles


def closure(nodes: DataFrame) -> DataFrame:
    """(tree, ancestor, descendant, steps, distance), each node with itself too, whatever the depth.

    Doubling: pairs of fewer than 2^k steps, continued over pairs of exactly 2^k, give all of fewer than 2^(k + 1), so the joins are as many as the depth has binary digits.
    Deep trees cut their lineage by a checkpoint at each.
    """
    length = F.coalesce("branch_length", F.lit(0.0))
    out = nodes.select("tree", F.col("node_id").alias("ancestor"), F.col("node_id").alias("descendant"), F.lit(0).alias("steps"), F.lit(0.0).alias("distance"))
    leap = nodes.where("parent_id IS NOT NULL").select("tree", F.col("parent_id").cast(nodes.schema["node_id"].dataType).alias("ancestor"), F.col("node_id").alias("descendant"), F.lit(1).alias("steps"), length.alias("distance"))
    deepest, k = nodes.agg(F.max("depth")).first()[0] or 0, 1
    while k <= deepest:
        if k > 4:
            out, leap = checkpointed(out), checkpointed(leap)
        below = leap.select(F.col("tree").alias("__t"), F.col("descendant").alias("__d"), F.col("ancestor").alias("__a"), F.col("steps").alias("__s"), F.col("distance").alias("__x"))

        def onward(df: DataFrame) -> DataFrame:
            """Pairs of df continued upwards by a leap."""
            joined = df.join(below, (F.col("tree") == F.col("__t")) & (F.col("ancestor") == F.col("__d")))
            return joined.select("tree", F.col("__a").alias("ancestor"), "descendant", (F.col("steps") + F.col("__s")).alias("steps"), (F.col("distance") + F.col("__x")).alias("distance"))

        out, leap, k = out.union(onward(out)), onward(leap), 2 * k
    return checkpointed(out)  # what uses a closure reads it several times


def jumps(nodes: DataFrame) -> list[DataFrame]:
    """Of each k from 0 the ancestors 2^k steps up, (tree, node_id, up) of nodes that have one: as many tables as the depth has binary digits, none longer than nodes.

    Each is the one before it joined with itself. They are cut from their lineage, as each is read by the next and by what climbs.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    steps, out = 1, []
    while steps <= deepest:
        if not out:
            level = nodes.where("parent_id IS NOT NULL").select("tree", "node_id", F.col("parent_id").cast(nodes.schema["node_id"].dataType).alias("up"))
        else:
            over = out[-1].select("tree", F.col("node_id").alias("up"), F.col("up").alias("__up"))
            level = out[-1].join(over, ["tree", "up"]).select("tree", "node_id", F.col("__up").alias("up"))
        out.append(checkpointed(level))
        steps *= 2
    return out


#: Rows at or below a node from which the node is heavy.
HEAVY = 1 << 17


def heavy_nodes(rows: DataFrame, below: list[DataFrame], heavy: int = HEAVY) -> DataFrame:
    """(tree, node_id) of nodes with more than `heavy` rows (tree, node_id) at or below them: as few as the rows are many, and cut from their lineage."""
    counts = gathered(rows.groupBy("tree", "node_id").agg(F.count(F.lit(1)).alias("n")), below, {"n": F.sum})
    return checkpointed(counts.where(F.col("n") > heavy).select("tree", "node_id"))


def _placed(rows: DataFrame, table: DataFrame, value: str, heavy: DataFrame | None) -> DataFrame:
    """rows (tree, node_id, …) with `value` of their node in table (tree, node_id, value), null without one.

    Dealt by node, all rows of a node near the root would be in one task. Those of heavy nodes find their value in a broadcast and stay apart in the join.
    """
    at = ["tree", "node_id"]
    if heavy is None:
        return rows.join(table.select(*at, value), at, "left")
    few = F.broadcast(heavy.join(table.select(*at, F.col(value).alias("__value")), at, "left").withColumn("__lot", F.lit(True)))
    lot = F.when(F.col("__lot"), 1 + F.pmod(F.xxhash64(*[c for c in rows.columns if c not in at]), F.lit(1 << 16))).otherwise(0).cast("long")
    found = rows.join(few, at, "left").withColumn("__lot", lot).join(table.select(*at, value, F.lit(0).cast("long").alias("__lot")), [*at, "__lot"], "left")
    return found.select(*rows.columns, F.coalesce("__value", value).alias(value))


def gathered(rows: DataFrame, below: DataFrame | list[DataFrame], merge: dict[str, Callable[[str], Column]], keys: Sequence[str] = (), heavy: DataFrame | None = None) -> DataFrame:
    """(tree, keys, node_id, columns of merge): what rows (tree, keys, node_id, columns) hold at a node and all nodes below it, merged by functions as F.sum, F.min, F.max. Nodes with nothing below have no row.

    below: a closure, or jumps(nodes). By jumps each node first has its own rows, and after k rounds those less than 2^k steps below it, as each node hands what it has to its ancestor
    2^k steps up too. So no round has more rows than the result, times two, whatever the depth. Deep trees cut their lineage every four rounds. heavy: nodes of many keys, as of heavy_nodes.
    """
    by = ["tree", *keys, "node_id"]
    own = rows.select(*by, *merge)
    values = [f(c).alias(c) for c, f in merge.items()]
    if isinstance(below, DataFrame):
        up = below.select("tree", F.col("descendant").alias("node_id"), F.col("ancestor").alias("__up"))
        return own.join(up, ["tree", "node_id"]).withColumn("node_id", F.col("__up")).groupBy(*by).agg(*values)
    out = own.groupBy(*by).agg(*values)
    for k, up in enumerate(below):
        both = F.explode(F.array_compact(F.array("node_id", "up")))
        out = _placed(out, up, "up", heavy).withColumn("node_id", both).groupBy(*by).agg(*values)
        if k % 4 == 3:
            out = checkpointed(out)
    return out


def nearest_above(nodes: DataFrame, stops: DataFrame) -> DataFrame:
    """(tree, node_id, ancestor, distance): the nearest of stops (tree, node_id) strictly above a node, and the branch lengths on the way, a missing one 0; no row where there is none.

    Each node points at its parent, and while that is no stop at where it points: ways double each round, and a round has a row for each node.
    """
    kind = nodes.schema["node_id"].dataType
    at = nodes.where("parent_id IS NOT NULL").select("tree", "node_id", F.col("parent_id").cast(kind).alias("at"), F.coalesce("branch_length", F.lit(0.0)).alias("far"))
    goals = stops.select("tree", F.col("node_id").alias("at"), F.lit(True).alias("done")).distinct()
    rows = at.join(goals, ["tree", "at"], "left").withColumn("done", F.coalesce("done", F.lit(False)))
    deepest, reach = nodes.agg(F.max("depth")).first()[0] or 0, 1
    while reach < deepest:
        rows = checkpointed(rows)  # read twice
        on = rows.select("tree", F.col("node_id").alias("at"), F.col("at").alias("at2"), F.col("far").alias("far2"), F.col("done").alias("done2"))
        further = rows.where("NOT done").join(on, ["tree", "at"]).select("tree", "node_id", F.col("at2").alias("at"), (F.col("far") + F.col("far2")).alias("far"), F.col("done2").alias("done"))
        rows, reach = rows.where("done").select(further.columns).union(further), 2 * reach
    return rows.where("done").select("tree", "node_id", F.col("at").alias("ancestor"), F.col("far").alias("distance"))


def tree_summary(nodes: DataFrame) -> DataFrame:
    """Per tree: nodes, inner nodes, total length, and largest and smallest height of the root over its leaves."""
    g = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(~F.col("is_leaf")).alias("n_inner"), F.sum(F.coalesce("branch_length", F.lit(0.0))).alias("total_length"))
    leaf = nodes.where("is_leaf").select("tree", "node_id").join(nearest_above(nodes, nodes.where("parent_id IS NULL")), ["tree", "node_id"], "left").withColumn("distance", F.coalesce("distance", F.lit(0.0)))
    return g.join(leaf.groupBy("tree").agg(F.max("distance").alias("max_height"), F.min("distance").alias("min_height")), "tree")


def clade_labels(nodes: DataFrame, below: DataFrame | list[DataFrame]) -> DataFrame:
    """(tree, node_id, first_leaf, last_leaf, n_leaves) of each node, leaves in the order of node_id, which a reader gives depth first. below as in gathered."""
    named = F.struct("node_id", "name")
    leaf = nodes.where("is_leaf").select("tree", "node_id", named.alias("first"), named.alias("last"), F.lit(1).cast("long").alias("n_leaves"))
    return gathered(leaf, below, {"first": F.min, "last": F.max, "n_leaves": F.sum}).select("tree", "node_id", F.col("first.name").alias("first_leaf"), F.col("last.name").alias("last_leaf"), "n_leaves")


def age_to_branch_length(nodes: DataFrame, age: str = "age") -> DataFrame:
    """Parent's age less the node's; not positive is an error."""
    parent = nodes.select("tree", F.col("node_id").alias("parent_id"), F.col(age).alias("__age"))
    length = F.col("__age") - F.col(age)
    return nodes.join(parent, ["tree", "parent_id"]).select("tree", "node_id", F.when(length > 0, length).otherwise(F.raise_error(F.lit("branch length is not positive"))).cast("double").alias("branch_length"))


def branch_condition_map(nodes: DataFrame, value: str, ncond: int) -> DataFrame:
    """Branch value to condition: its integer part, at most ncond - 1; negative is an error. With as many conditions as branches each branch, in the order of node_id, is its own."""
    branches = nodes.where("parent_id IS NOT NULL")
    if branches.count() == ncond:
        return running(branches.select("tree", "node_id"), ["tree", "node_id"]).select("tree", "node_id", (F.col("__rank") - 1).cast("int").alias("cond"))
    v = F.col(value).cast("int")
    return nodes.select("tree", "node_id", F.when(v < 0, F.raise_error(F.lit("negative condition")).cast("int")).otherwise(F.least(v, F.lit(ncond - 1))).alias("cond"))


def lca(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, a, b, lca): the common ancestor of greatest depth of two nodes.

    Both climb by jumps: the deeper one first, by the binary digits of the difference in depth, then both by ever shorter jumps while they stay apart; a pair is one row
    throughout, whatever the depth. Pairs of unknown or null nodes, or of nodes without a common root, have no row; repeated pairs have one. Deep trees cut their lineage every four jumps.
    """
    ups = jumps(nodes)
    at = nodes.select("tree", "node_id", "depth")
    rows = pairs.select("tree", "a", "b").distinct()
    for c in "ab":
        rows = rows.join(at.select("tree", F.col("node_id").alias(c), F.col("depth").alias(f"d{c}")), ["tree", c])
    swap = F.col("db") > F.col("da")
    rows = rows.select("tree", "a", "b", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("x"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("y"), F.abs(F.col("da") - F.col("db")).alias("more"))

    def climbed(rows: DataFrame, k: int, ends: str) -> DataFrame:
        for c in ends:
            rows = rows.join(ups[k].select("tree", F.col("node_id").alias(c), F.col("up").alias(f"{c}_up")), ["tree", c], "left")
        return checkpointed(rows) if k % 4 == 3 else rows

    for k in range(len(ups)):
        rows = climbed(rows, k, "x").withColumn("x", F.when(F.getbit("more", F.lit(k)) == 1, F.col("x_up")).otherwise(F.col("x"))).drop("x_up")
    for k in reversed(range(len(ups))):
        apart = F.col("x_up") != F.col("y_up")
        rows = climbed(rows, k, "xy").withColumns({c: F.when(apart, F.col(f"{c}_up")).otherwise(F.col(c)) for c in "xy"}).drop("x_up", "y_up")
    parent = nodes.select("tree", F.col("node_id").alias("x"), F.col("parent_id").cast(nodes.schema["node_id"].dataType).alias("above"))
    top = F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(F.col("above"))
    return rows.join(parent, ["tree", "x"]).select("tree", "a", "b", top.alias("lca")).where("lca IS NOT NULL")


def lca_by_name(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name1, name2, lca) of pairs of leaf names, whole or beginnings that one leaf alone has; names of several leaves are an error, of none give null. For one tree."""
    leaves = nodes.where("is_leaf").select(F.col("name").alias("taxon"))
    asked = pairs.select(F.explode(F.array("name1", "name2")).alias("name")).distinct()
    found = match_taxa_prefix(asked, leaves).withColumn("taxon", F.when(F.col("n") == 1, F.col("taxon")).otherwise(F.raise_error(F.concat(F.lit("several leaves match "), "name"))))
    ids = found.join(nodes.where("is_leaf").select(F.col("name").alias("taxon"), "tree", "node_id"), "taxon").select("name", "tree", "node_id")
    one, two = (ids.select(F.col("name").alias(f"name{i}"), F.col("tree").alias(f"tree{i}"), F.col("node_id").alias(c)) for i, c in ((1, "a"), (2, "b")))
    known = pairs.join(one, "name1", "left").join(two, "name2", "left").withColumnRenamed("tree1", "tree")
    tops = lca(known.where("a IS NOT NULL AND b IS NOT NULL").select("tree", "a", "b"), nodes)
    return known.join(tops, ["tree", "a", "b"], "left").select("name1", "name2", "lca")


def prune_tree(nodes: DataFrame, below: DataFrame | list[DataFrame], taxa: DataFrame, strict: bool = False) -> DataFrame:
    """(tree, node_id, parent_id, branch_length) of the tree of the leaves in taxa: nodes with one child left go, their lengths add up; so does a root with one child.

    strict: a taxon that is no leaf of the tree is an error. A node stays if it is a kept leaf or has kept leaves below two children; its parent is the nearest ancestor that stays. below as in gathered.
    """
    if strict and not (lost := taxa.select(F.col("taxon").alias("name")).join(nodes.where("is_leaf"), "name", "left_anti")).isEmpty():
        raise ValueError(f"taxa are missing from the tree, as {lost.first()['name']}")
    leaf = nodes.where("is_leaf").join(taxa.select(F.col("taxon").alias("name")), "name", "left_semi").select("tree", "node_id", F.lit(True).alias("alive"))
    alive = gathered(leaf, below, {"alive": F.first}).select("tree", "node_id")
    forks = nodes.join(alive, ["tree", "node_id"], "left_semi").where("parent_id IS NOT NULL").groupBy("tree", F.col("parent_id").alias("node_id")).count().where("count >= 2").select("tree", "node_id")
    kept = checkpointed(forks.union(leaf.select("tree", "node_id")))
    return kept.join(nearest_above(nodes, kept), ["tree", "node_id"], "left").select("tree", "node_id", F.col("ancestor").alias("parent_id"), F.col("distance").alias("branch_length"))


def tree_alignment_check(nodes: DataFrame, taxa: DataFrame) -> DataFrame:
    """Names in one of tree and data alone: (name, side). Empty if they agree."""
    leaf, data = nodes.where("is_leaf").select("name").distinct(), taxa.select(F.col("taxon").alias("name")).distinct()
    return leaf.join(data, "name", "left_anti").withColumn("side", F.lit("tree")).union(data.join(leaf, "name", "left_anti").withColumn("side", F.lit("data")))


def tree_alignment_join(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Alignment rows with tree and node_id of their taxon's leaf; a leaf without rows or a taxon without leaf is an error."""
    leaf = nodes.where("is_leaf").select("tree", "node_id", F.col("name").alias("taxon"))
    joined = rows.withColumn("__row", F.lit(True)).join(leaf, "taxon", "full")
    lost = F.when(F.col("node_id").isNull(), F.lit("no leaf for ")).when(F.col("__row").isNull(), F.lit("no data for "))
    return joined.withColumn("taxon", F.when(lost.isNotNull(), F.raise_error(F.concat(lost, "taxon"))).otherwise(F.col("taxon"))).drop("__row")


def informative_nodes(nodes: DataFrame, below: DataFrame | list[DataFrame], leaf_states: DataFrame, zeros: bool = False, heavy: int = HEAVY) -> DataFrame:
    """(tree, site, node_id, flag): 2 for the root of the least subtree that spans the known leaves of a site, 1 for its other nodes, 0 for the nodes above it.

    zeros: the nodes that no path touches are listed too, with 0, which is a row for every node and site. leaf_states: (tree, site, name) of known leaves. below as in gathered.
    A node's count of known leaves below says all: the root is the deepest with all of them. By jumps, nodes with more than `heavy` known leaves below them, over all sites, are no task of their own;
    were they over 2^17, they wouldn't be sent to all tasks.
    """
    leaf = nodes.where("is_leaf").select("tree", "node_id", "name")
    known = leaf_states.join(leaf, ["tree", "name"]).select("tree", "site", "node_id", F.lit(1).cast("long").alias("n"))
    dense = None
    if not isinstance(below, DataFrame):
        known = checkpointed(known)  # read twice
        found = heavy_nodes(known, below, heavy)
        dense = found if 0 < found.count() <= 1 << 17 else None
    rows = _placed(gathered(known, below, {"n": F.sum}, ["site"], dense), nodes, "depth", dense)
    root = rows.groupBy("tree", "site").agg(F.max(F.struct("n", "depth")).alias("root"))
    deeper = F.col("depth") > F.col("root.depth")
    flag = F.when(deeper, 1).when((F.col("n") == F.col("root.n")) & (F.col("depth") == F.col("root.depth")), 2).otherwise(0)
    flags = rows.join(root, ["tree", "site"]).select("tree", "site", "node_id", flag.alias("flag"))
    if not zeros:
        return flags
    every = rows.select("tree", "site").distinct().join(nodes.select("tree", "node_id"), "tree")
    return every.join(flags, ["tree", "site", "node_id"], "left").withColumn("flag", F.coalesce("flag", F.lit(0)))


def branch_posterior_table(quantiles: DataFrame, labels: DataFrame, nodes: DataFrame, leaves_only: bool = False) -> DataFrame:
    """Quantiles by branch (node_id) with node name or the two leaf names of its clade."""
    named = labels.join(nodes.select("tree", "node_id", "name", "is_leaf"), ["tree", "node_id"])
    rows = quantiles.join(named.where("is_leaf") if leaves_only else named, "node_id")
    return rows.withColumn("label", F.when(F.col("is_leaf"), F.col("name")).otherwise(F.concat_ws("-", "first_leaf", "last_leaf")))


def branch_summary(trace: DataFrame, labels: DataFrame, nodes: DataFrame, leaves_only: bool = False) -> DataFrame:
    """branch_posterior_table of draws (node_id, value), with their mean."""
    table = branch_posterior_table(posterior_quantiles(trace, ["node_id"]), labels, nodes, leaves_only)
    return table.join(trace.groupBy("node_id").agg(F.avg("value").alias("mean")), "node_id")


def node_branch_medians(medians: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per node: exp of the median log value (node_id, median), and the mean length of its branch over saved points (node_id, branch_length)."""
    mean = lengths.groupBy("node_id").agg(F.avg("branch_length").alias("mean_length"))
    return medians.join(mean, "node_id", "left").select("node_id", F.exp("median").alias("value"), "mean_length")


def branch_table_export(values: DataFrame, nodes: DataFrame, labels: DataFrame, leaves_only: bool = False) -> DataFrame:
    """Values (node_id, value) by branch, named by the two outer leaves of its clade, or for leaves alone by their name."""
    rows = values.join(labels, "node_id").join(nodes.select("node_id", "is_leaf"), "node_id")
    return rows.where("is_leaf").select(F.col("first_leaf").alias("leaf"), "value") if leaves_only else rows.select("first_leaf", "last_leaf", "value")


def merge_mapped_branches(trees: DataFrame) -> DataFrame:
    """(branch, nsyn, nnonsyn, bsyn, bnonsyn) over genes, from annotated trees as rows (gene, stat, branch, value): counts and norms of dS and dN."""
    at = lambda s: F.sum(F.when(F.col("stat") == s, F.col("value")).otherwise(0.0))
    return trees.groupBy("branch").agg(at("ds_count").alias("nsyn"), at("dn_count").alias("nnonsyn"), at("ds_norm").alias("bsyn"), at("dn_norm").alias("bnonsyn"))


#: Annotated trees of a gene, by what their branches bear.
MAPPED = ("ds_count", "ds_norm", "dn_count", "dn_norm")


def mapped_trees(ds_count: DataFrame, ds_norm: DataFrame, dn_count: DataFrame, dn_norm: DataFrame) -> DataFrame:
    """(gene, stat, branch, value) of four sets of node tables, trees named by gene, whose branches bear the statistic; a branch is a node's id, and a node without value is left out."""
    parts = zip(MAPPED, (ds_count, ds_norm, dn_count, dn_norm), strict=True)
    return reduce(DataFrame.union, [n.where("branch_length IS NOT NULL").select(F.col("tree").alias("gene"), F.lit(stat).alias("stat"), F.col("node_id").alias("branch"), F.col("branch_length").alias("value")) for stat, n in parts])
