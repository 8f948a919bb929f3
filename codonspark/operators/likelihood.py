"""Site likelihood by pruning, for a given tree and rate matrix, or for each gene's own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonspark.functions.shared import checkpointed, staged
from codonspark.operators.trees import gathered, jumps


def transition(rates: np.ndarray, length: float) -> np.ndarray:
    """exp(rates * length) by scaling and squaring of a Taylor series."""
    q = rates * length
    k = max(0, int(np.ceil(np.log2(max(1e-12, np.abs(q).sum(axis=1).max())))) + 4)
    q, term, out = q / 2**k, np.eye(len(q)), np.eye(len(q))
    for i in range(1, 13):
        term = term @ q / i
        out = out + term
    for _ in range(k):
        out = out @ out
    return out


def site_likelihood(leaf_states: DataFrame, tree: list[tuple[int, int | None, str, float]], rates: np.ndarray, freqs: np.ndarray) -> DataFrame:
    """(gene, site, log_likelihood) from (gene, site, states map<string,int>), a row for each site.

    tree: (node, parent, leaf name, length), parents before children; it and the matrices are small and go with the task.
    A missing leaf agrees with every state. Nodes are rescaled, so deep trees don't underflow.
    """
    moves = [transition(rates, length) if parent is not None else None for _, parent, _, length in tree]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, k = len(batch), len(freqs)
            partial = {node: np.ones((n, k)) for node, *_ in tree}
            scale = np.zeros(n)
            states = [dict(s) if s is not None else {} for s in batch["states"]]
            inner = {parent for _, parent, *_ in tree}
            for (node, parent, name, _), move in list(zip(tree, moves, strict=True))[::-1]:
                p = partial[node]
                if node not in inner:
                    got = np.array([-1 if (s := x.get(name)) is None else s for x in states], dtype=int)
                    p = np.where(got[:, None] < 0, 1.0, np.eye(k)[np.maximum(got, 0)])
                top = p.max(axis=1)
                scale += np.log(top)
                p = p / top[:, None]
                if parent is None:
                    yield batch[["gene", "site"]].assign(log_likelihood=np.log(p @ freqs) + scale)
                else:
                    partial[parent] *= p @ move.T

    gene, site = (leaf_states.schema[c].dataType.simpleString() for c in ("gene", "site"))
    return leaf_states.select("gene", "site", "states").mapInPandas(run, f"gene {gene}, site {site}, log_likelihood double")


def _heavy_first(parents: dict[int, int | None], depths: dict[int, int]) -> list[int]:
    """Nodes after all below them, the child with most nodes below first: at most log2 of the nodes then wait for further children at once."""
    size = dict.fromkeys(parents, 1)
    children: dict[int, list[int]] = {}
    for n in sorted(parents, key=lambda n: -depths[n]):
        if (up := parents[n]) is not None:
            size[up] += size[n]
            children.setdefault(up, []).append(n)
    order, open_ = [], [n for n, up in parents.items() if up is None]
    while open_:
        n = open_.pop()
        order.append(n)
        open_ += sorted(children.get(n, ()), key=lambda x: (-size[x], x))
    return order[::-1]


def _pruned(nodes: list[dict], rates: np.ndarray, freqs: np.ndarray, some: pa.Table) -> np.ndarray:
    """Log likelihoods of patterns, each lists of its known leaves, ascending, their states, their parents (up) and their lengths (far); nodes: what is above the leaves. A node is worked on for those
    patterns alone that know a leaf below it, and all leaves of a node at once."""
    lists = {c: some.column(c).combine_chunks() for c in ("leaves", "states", "up", "far")}
    held, k = pc.list_value_length(lists["leaves"]).to_numpy(), len(freqs)
    n, column = len(held), np.repeat(np.arange(len(held)), held)
    leaf, state, above = (pc.fill_null(lists[c].flatten(), -1).to_numpy().astype(np.int64) for c in ("leaves", "states", "up"))
    far = lists["far"].flatten().to_numpy()
    first = np.ones(len(column), dtype=bool)
    first[1:] = (column[1:] != column[:-1]) | (leaf[1:] != leaf[:-1])
    column, leaf, state, above, far = (x[first] for x in (column, leaf, state, above, far))
    parents = {x["node_id"]: x["parent_id"] for x in nodes}
    lengths, depths = ({x["node_id"]: x[c] for x in nodes} for c in ("branch_length", "depth"))
    moves: dict[float, np.ndarray] = {}
    partial: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    scale, out = np.zeros(n), np.zeros(n)

    def move(length: float) -> np.ndarray:
        if length not in moves:
            if len(moves) == 1024:
                moves.clear()
            moves[length] = np.maximum(transition(rates, length), 0.0)
        return moves[length]

    def times(held: tuple[np.ndarray, np.ndarray] | None, at: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(patterns, values) held, times the factors of patterns `at`, each once and ascending; rescaled."""
        if held is not None:
            every = np.union1d(held[0], at)
            product = np.ones((len(every), k))
            product[np.searchsorted(every, held[0])] = held[1]
            product[np.searchsorted(every, at)] *= factor
            at, factor = every, product
        top = factor.max(axis=1)
        scale[at] += np.log(top)
        return at, factor / np.where(top > 0, top, 1.0)[:, None]

    # of the leaves of a node that a pattern knows the first of each pattern go together, then the second
    by = np.lexsort((leaf, column, above))
    new = np.ones(len(by), dtype=bool)
    new[1:] = (above[by][1:] != above[by][:-1]) | (column[by][1:] != column[by][:-1])
    turn = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    again = np.lexsort((column[by], turn, above[by]))
    by, turn = by[again], turn[again]
    lots: dict[int, list[np.ndarray]] = {}
    for lot in np.split(by, np.flatnonzero((above[by][1:] != above[by][:-1]) | (turn[1:] != turn[:-1])) + 1) if len(by) else ():
        lots.setdefault(int(above[lot[0]]), []).append(lot)
    with np.errstate(divide="ignore"):  # an impossible pattern has -inf
        for lot in lots.pop(-1, ()):
            out[column[lot]] = np.log(freqs[state[lot]])
        ends = set(np.unique(leaf).tolist())
        inner = {node: up for node, up in parents.items() if node not in ends and up not in ends}
        for node in _heavy_first(inner, depths):
            held = partial.pop(node, None)
            for lot in lots.get(node, ()):
                factor = np.empty((len(lot), k))
                for length in np.unique(far[lot]).tolist():
                    own = far[lot] == length
                    factor[own] = move(length)[:, state[lot[own]]].T
                held = times(held, column[lot], factor)
            if held is None:
                continue
            at, below = held
            if (up := parents[node]) is None:
                out[at] = np.log(below @ freqs) + scale[at]
            else:
                partial[up] = times(partial.get(up), at, below @ move(lengths[node]).T)
    return out


def part_trees(dealt: DataFrame, nodes: DataFrame) -> DataFrame:
    """(gene, part, tree, node_id, parent_id, branch_length, depth): the leaves, or other nodes, that the patterns of a part know (gene, part, tree, leaves) and what is above them, so a part isn't sent the rest of its gene's tree."""
    kind = nodes.schema["node_id"].dataType.simpleString()
    known = dealt.select("tree", "gene", "part", F.explode(F.col("leaves").cast(f"array<{kind}>")).alias("node_id"), F.lit(True).alias("known"))
    own = gathered(known, jumps(nodes), {"known": F.first}, ["gene", "part"])
    return own.join(nodes.select("tree", "node_id", "parent_id", F.coalesce("branch_length", F.lit(0.0)).alias("branch_length"), "depth"), ["tree", "node_id"]).drop("known")


def pattern_likelihood(states: DataFrame, genes: DataFrame, nodes: DataFrame, rates: DataFrame, freqs: DataFrame, per_task: int = 2048) -> DataFrame:
    """(gene, site, log_likelihood) of alignment columns, each gene by its own tree and rates, for any number of states.

    states: (gene, site, name, state), states from 0; genes: (gene, tree, set); nodes: node tables; rates: (set, i, j, rate), whose diagonal is minus the row's sum; freqs: (set, i, freq), at the root.
    A leaf without row or with a null state agrees with every state, so a site that knows none has 0; of several states of a leaf the least counts; a taxon that is no leaf of the gene's tree is
    not read; an impossible column has minus infinity. A gene without tree or rates is an error, and one that genes doesn't list has no row.

    Equal columns of a gene are one pattern, pruned once. Patterns are dealt to tasks by some `per_task` of a gene, so a long gene is many tasks, and the answers joined back to the sites.
    A task holds its patterns, what is above their leaves, and matrices for the log2 of those nodes that wait at once. A leaf brings its parent and length along in the pattern, so that the leaves of a
    tree are no rows of each part.
    """
    genes = checkpointed(genes)  # read four times
    leaf = nodes.where("is_leaf").select("tree", "name", F.col("node_id").cast("long").alias("leaf"), F.col("parent_id").cast("long").alias("up"), F.coalesce("branch_length", F.lit(0.0)).alias("far"))
    cell = F.when(F.col("leaf").isNotNull() & F.col("state").isNotNull(), F.struct("leaf", "state", "up", "far"))
    cells = states.select("gene", "site", "name", "state").join(genes.select("gene", "tree"), "gene").join(leaf, ["tree", "name"], "left")
    columns = cells.select("gene", "site", cell.alias("cell")).repartition("gene", "site").groupBy("gene", "site").agg(F.sort_array(F.collect_set("cell")).alias("known"))
    columns = staged(columns.withColumn("pattern", F.sha2(F.concat(F.col("known.leaf").cast("string"), F.col("known.state").cast("string")), 256)))
    patterns = columns.groupBy("gene", "pattern").agg(F.first("known").alias("known"))
    patterns = staged(patterns)  # read three times
    parts = patterns.groupBy("gene").agg(F.ceil(F.count(F.lit(1)) / per_task).cast("int").alias("parts"))
    dealt = patterns.join(parts, "gene").select("gene", F.pmod(F.hash("pattern"), "parts").alias("part"), "pattern", F.col("known.leaf").alias("leaves"), F.col("known.state").alias("states"), "known.up", "known.far")
    listed = lambda df, by, name, *c: df.groupBy(by).agg(F.collect_list(F.struct(*c)).alias(name))
    trees = nodes.select("tree", F.lit(True).alias("grown")).distinct()
    models = genes.join(parts, "gene").join(trees, "tree", "left").join(listed(rates, "set", "rates", "i", "j", "rate"), "set", "left").join(listed(freqs, "set", "freqs", "i", "freq"), "set", "left")
    models = models.select("gene", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "grown",
        *[F.col(f"{a}.{c}").alias(f"{a}_{c}") for a, c in (("rates", "i"), ("rates", "j"), ("rates", "rate"), ("freqs", "i"), ("freqs", "freq"))])
    above = part_trees(dealt.select("gene", "part", F.array_compact(F.array_distinct("up")).alias("leaves")).join(genes.select("gene", "tree"), "gene"), nodes)
    # a part's nodes are one row: among rows of nodes the empty lists of a model are filled up anew for each row that goes to Python
    given = models.join(listed(above, ["gene", "part"], "nodes", F.col("node_id").cast("long").alias("node_id"), F.col("parent_id").cast("long").alias("parent_id"), "branch_length", "depth"), ["gene", "part"], "left")

    def run(key: tuple, some: pa.Table, given: pa.Table) -> pa.Table:
        m = given.to_pylist()[0]
        if any(m[c] is None for c in ("grown", "rates_i", "freqs_i")):
            raise ValueError(f"gene {key[0]} has no tree or no rates")
        k = len(m["freqs_i"])
        q, pi = np.zeros((k, k)), np.zeros(k)
        pi[m["freqs_i"]] = m["freqs_freq"]
        q[m["rates_i"], m["rates_j"]] = m["rates_rate"]
        np.fill_diagonal(q, 0.0)
        np.fill_diagonal(q, -q.sum(axis=1))
        found = _pruned(m["nodes"] or [], q, pi, some)
        return some.select(["gene", "pattern"]).append_column("log_likelihood", pa.array(found, pa.float64()))

    gene = states.schema["gene"].dataType.simpleString()
    answers = dealt.groupBy("gene", "part").cogroup(given.groupBy("gene", "part")).applyInArrow(run, f"gene {gene}, pattern string, log_likelihood double")
    return columns.select("gene", "site", "pattern").join(answers, ["gene", "pattern"]).select("gene", "site", "log_likelihood")
