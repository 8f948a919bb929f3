"""Cases that the stand-in tables don't meet."""

import math
import random

import pytest
from pyspark.sql import functions as F

from codonspark.functions.shared import running
from codonspark.operators import alignment, posterior, suffstat, trees
from codonspark.sources import files


def put(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_window_clips(spark):
    trace = spark.range(40).select(F.col("id").alias("iter"))
    at = lambda *a, **k: sorted(r["iter"] for r in posterior.sample_window(trace, *a, **k).collect())
    assert at(10, 7, 100) == [10, 17, 24, 31] and at(10, 1, 12) == [10, 11] and at(0, 3, -1) == list(range(0, 39, 3))
    with pytest.raises(ValueError):
        posterior.sample_window(trace, 50, strict=True)


def test_is_stop(spark):
    df = spark.createDataFrame([("T", "A", "A"), ("t", "g", "a"), ("A", "-", "G"), ("T", None, "A"), ("A", "C", "G")], "a string, b string, c string")
    assert [r[0] for r in df.select(alignment.is_stop(F.col("a"), F.col("b"), F.col("c"))).collect()] == [True, True, False, False, False]
    assert df.select(alignment.is_stop(F.lit("A"), F.lit("G"), F.lit("A"), "mt_mammal")).first()[0] is True


def test_closure_of_a_chain(spark):
    """A chain of 40 nodes has all its pairs, with their steps and distances."""
    nodes = spark.createDataFrame([("t", i, i - 1 if i else None, 0, f"n{i}", None, 0.5 if i else None, i == 39, i) for i in range(40)], files.NODE_SCHEMA)
    got = trees.closure(nodes).collect()
    assert len(got) == 40 * 41 // 2 and all(r["steps"] == r["descendant"] - r["ancestor"] and r["distance"] == r["steps"] / 2 for r in got)
    six = nodes.where("depth < 6")
    assert trees.closure(six).count() == 21


def test_running(spark):
    rows = [(k, v) for k in ("a", "b", None) for v in range(50)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(5)
    got = running(df, ["v"], ["v"], keys=["k"]).collect()
    assert len(got) == 150 and all(r["__rank"] == r["v"] + 1 and r["__sum_v"] == r["v"] * (r["v"] + 1) // 2 for r in got)
    every = sorted(r["__rank"] for r in running(df, ["v", "k"]).collect())
    assert every == list(range(1, 151))
    assert running(df.where("false"), ["v"]).count() == 0
    quantiles = {r["k"]: (r["q0"], r["q1"], r["q2"]) for r in posterior.posterior_quantiles(df, ["k"], "v", split=True).collect()}
    assert quantiles == {k: (1, 25, 48) for k in ("a", "b", None)}


def test_codeml_lines(spark, tmp_path):
    text = "seed 1\ng1 lnL(ntime: 10  np: 15):  -1234.56      +0.000000\nnote\n\ng1 lnL(ntime: 10  np: 17):  -1230.06      +0.000000\ng2  lnL: -8.5\ng2  lnL: -8.25\n"
    got = sorted(map(tuple, files.read_codeml_pairs(spark, put(tmp_path, "log", text)).collect()))
    assert got == [("g1", -1234.56, -1230.06, 4.5), ("g2", -8.5, -8.25, 0.25)]
    with pytest.raises(Exception):
        files.read_codeml_pairs(spark, put(tmp_path, "odd", "g1 lnL: -1.5\ng2 lnL: -2.5\n")).collect()


def test_site_lines(spark, tmp_path):
    genes = spark.createDataFrame([(0, "10", 2), (1, "b", 1)], "ordinal int, gene string, nsite int")
    for name, line in (("long", "10 0.1 0.2 b 0.3 0.4"), ("short", "10 0.1 0.2 b"), ("name", "10 0.1 b 0.2 0.3")):
        with pytest.raises(Exception):
            files.read_site_trace(spark, put(tmp_path, name, line + "\n"), genes).collect()
    with pytest.raises(Exception):
        files.read_branch_suffstat(spark, put(tmp_path, "stat", "1 2 3 4 5\n")).collect()
    with pytest.raises(Exception):
        files.read_branch_suffstat(spark, put(tmp_path, "stat2", "1 2 3 4\n"), branches=2).collect()


def test_chains(spark, tmp_path):
    """Points of each chain are numbered from 0, and each file has its header."""
    put(tmp_path, "one.trace", "#x\ty\n1\t2\n3\t4\n")
    put(tmp_path, "two.trace", "#y\n5\n")
    got = sorted(map(tuple, files.read_trace(spark, f"{tmp_path}/*.trace", chain=True).collect()))
    assert got == [("one", 0, 0, "x", 1.0), ("one", 0, 1, "y", 2.0), ("one", 1, 0, "x", 3.0), ("one", 1, 1, "y", 4.0), ("two", 0, 0, "y", 5.0)]
    genes = spark.createDataFrame([(0, "g")], "ordinal int, gene string")
    put(tmp_path, "one.geneom", "7\n8\n")
    assert sorted(map(tuple, files.read_gene_trace(spark, f"{tmp_path}/*.geneom", genes, chain=True).collect())) == [("one", "geneom", 0, "g", 7.0), ("one", "geneom", 1, "g", 8.0)]


def test_lines_over_splits(spark, tmp_path):
    path = put(tmp_path, "many", "".join(f"{i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        lines = files.numbered(spark, path)
        assert lines.rdd.getNumPartitions() > 1 and all(r["line"] == int(r["value"]) for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_long_sequence(spark):
    """Codons of a long sequence: cut in one walk."""
    wide = spark.createDataFrame([("g", "A", "ACG" * 200_000)], "gene string, taxon string, seq string")
    assert alignment.make_codons(wide).where("codon = 'ACG'").count() == 200_000


def test_names(spark):
    genes = spark.createDataFrame([(0, "a"), (1, "b")], "ordinal int, gene string")
    rows = spark.createDataFrame([(0, 1.0), (1, 2.0), (0, 3.0)], "ordinal int, value double")
    assert sorted((r["gene"], r["value"]) for r in posterior.attach_gene_names(rows, genes).collect()) == [("a", 1.0), ("a", 3.0), ("b", 2.0)]
    for bad in (rows.where("ordinal = 0"), rows.union(spark.createDataFrame([(7, 1.0)], rows.schema))):
        with pytest.raises(Exception):
            posterior.attach_gene_names(bad, genes).collect()
        assert posterior.gene_places(bad, genes).count() == 1


def test_tree_checks(spark, tmp_path):
    nodes = files.read_newick(spark, put(tmp_path, "t", "((Homo_a:1,Mus_b:2)x:1,Pan_c:3)r;"))
    pairs = spark.createDataFrame([("Homo", "Mus_b"), ("Mus", "Pan_c"), ("Homo", "None")], "name1 string, name2 string")
    ids = {r["name"]: r["node_id"] for r in nodes.collect()}
    assert {(r["name1"], r["name2"]): r["lca"] for r in trees.lca_by_name(pairs, nodes).collect()} == {("Homo", "Mus_b"): ids["x"], ("Mus", "Pan_c"): ids["r"], ("Homo", "None"): None}
    rows = spark.createDataFrame([("Homo_a", 1), ("Mus_b", 2), ("Pan_c", 3)], "taxon string, v int")
    assert trees.tree_alignment_join(nodes, rows).count() == 3
    with pytest.raises(Exception):
        trees.tree_alignment_join(nodes, rows.where("v < 3")).collect()
    with pytest.raises(ValueError):
        trees.prune_tree(nodes, trees.closure(nodes), spark.createDataFrame([("Nobody",)], "taxon string"), strict=True)
    flags = trees.informative_nodes(nodes, trees.closure(nodes), nodes.where("name IN ('Homo_a', 'Mus_b')").selectExpr("tree", "1 AS site", "name"), zeros=True).collect()
    assert {r["node_id"]: r["flag"] for r in flags} == {ids["r"]: 0, ids["x"]: 2, ids["Homo_a"]: 1, ids["Mus_b"]: 1, ids["Pan_c"]: 0}


def test_lca_by_jumps(spark):
    """A chain of 5000 nodes with a leaf at every tenth, a star, and a forest, against climbing node by node."""
    up = {i: i - 1 if i else None for i in range(5000)} | {10000 + i: i for i in range(0, 5000, 10)}
    rows = [("chain", i, p, i if i < 5000 else i - 10000 + 1) for i, p in up.items()]
    rows += [("star", 0, None, 0)] + [("star", i, 0, 1) for i in range(1, 300)] + [("two", 0, None, 0), ("two", 1, None, 0), ("two", 2, 1, 1)]
    nodes = spark.createDataFrame(rows, "tree string, node_id int, parent_id int, depth int")

    def meet(a, b):
        seen = set()
        while a is not None:
            seen.add(a)
            a = up[a]
        while b not in seen:
            b = up[b]
        return b

    keys = sorted(up)
    asked = [(keys[i * 7919 % len(keys)], keys[i * 104729 % len(keys)]) for i in range(400)] + [(5, 5), (0, 4999), (10000, 14990)]
    pairs = [("chain", a, b) for a, b in asked] * 2 + [("star", 1, 2), ("star", 0, 9), ("two", 0, 2), ("two", 1, 2), ("two", 2, 77), ("two", None, 2), ("none", 0, 0)]
    got = trees.lca(spark.createDataFrame(pairs, "tree string, a int, b int"), nodes)
    want = {("chain", a, b, meet(a, b)) for a, b in asked} | {("star", 1, 2, 0), ("star", 0, 9, 0), ("two", 1, 2, 1)}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert trees.lca(spark.createDataFrame([("star", 1, 2)], "tree string, a int, b int"), nodes.where("false")).count() == 0


def test_informative_paths(spark):
    path = spark.createDataFrame([("g", 1, 0, 1, 5, 0.5), ("g", 1, 0, 2, 7, 0.5), ("g", 1, 1, 1, 3, 1.0), ("g", 1, 2, 1, 4, 1.0)], "gene string, site int, branch int, seg int, state int, rel_time double")
    flags = spark.createDataFrame([("g", 1, 0, 1), ("g", 1, 1, 2), ("g", 1, 2, 0)], "gene string, site int, branch int, flag int")
    lengths, rates = spark.createDataFrame([(0, 2.0), (1, 9.0)], "branch int, branch_length double"), spark.createDataFrame([("g", 1, 3.0)], "gene string, site int, rate double")
    assert {r["state"]: r["t"] for r in suffstat.scaled_path(path, lengths, rates, flags).collect()} == {5: 3.0, 7: 3.0}
    assert [tuple(r) for r in suffstat.root_counts(path, flags, ["gene"]).collect()] == [("g", 3, 1)]


def test_deep_trees(spark):
    """A chain and a star of 10^5 nodes: labels, pruning and informative nodes by jumps, without a closure."""
    n = 100_000
    chain = spark.range(n).selectExpr("'chain' AS tree", "id AS node_id", "CASE WHEN id > 0 THEN id - 1 END AS parent_id", "concat('c', id) AS name", "1.0D AS branch_length", f"id = {n - 1} AS is_leaf", "CAST(id AS INT) AS depth")
    twig = spark.createDataFrame([("chain", n + 7, 500, "twig", 2.0, True, 501)], chain.schema)
    star = spark.range(n).selectExpr("'star' AS tree", "id AS node_id", "CASE WHEN id > 0 THEN 0L END AS parent_id", "concat('s', id) AS name", "0.5D AS branch_length", "id > 0 AS is_leaf", "CAST(id > 0 AS INT) AS depth")
    nodes = chain.union(twig).union(star)
    ups = trees.jumps(nodes)
    labels = trees.clade_labels(nodes, ups).where("tree = 'star' AND node_id IN (0, 9) OR tree = 'chain' AND node_id IN (0, 500, 501)").collect()
    assert {(r["tree"], r["node_id"]): (r["first_leaf"], r["last_leaf"], r["n_leaves"]) for r in labels} == {
        ("star", 0): ("s1", f"s{n - 1}", n - 1), ("star", 9): ("s9", "s9", 1), ("chain", 0): (f"c{n - 1}", "twig", 2), ("chain", 500): (f"c{n - 1}", "twig", 2), ("chain", 501): (f"c{n - 1}", f"c{n - 1}", 1)}
    taxa = spark.createDataFrame([(f"c{n - 1}",), ("twig",), ("s3",), ("s4",)], "taxon string")
    pruned = {(r["tree"], r["node_id"]): (r["parent_id"], r["branch_length"]) for r in trees.prune_tree(nodes, ups, taxa).collect()}
    assert pruned == {("chain", 500): (None, None), ("chain", n - 1): (500, n - 501.0), ("chain", n + 7): (500, 2.0), ("star", 0): (None, None), ("star", 3): (0, 0.5), ("star", 4): (0, 0.5)}
    known = spark.createDataFrame([("chain", 1, f"c{n - 1}"), ("chain", 1, "twig"), ("chain", 2, "twig"), ("star", 1, "s1"), ("star", 1, "s2")], "tree string, site int, name string")
    flags = trees.informative_nodes(nodes, ups, known).groupBy("tree", "site", "flag").agg({"node_id": "count"}).collect()
    assert {tuple(r) for r in flags} == {("chain", 1, 0, 500), ("chain", 1, 2, 1), ("chain", 1, 1, n - 500), ("chain", 2, 0, 501), ("chain", 2, 2, 1), ("star", 1, 2, 1), ("star", 1, 1, 2)}
    heights = {r["tree"]: (r["max_height"], r["min_height"]) for r in trees.tree_summary(nodes).collect()}
    assert heights == {"chain": (n - 1.0, 502.0), "star": (0.5, 0.5)}


def test_quantiles_by_counting(spark):
    """Selection by counting against sorting: ties, nulls, NaN, infinities, subnormal and huge values, null keys, longs that doubles can't tell apart."""
    rng = random.Random(3)
    rows = [(k, rng.choice([-1, 1]) * 2.0 ** rng.randint(-1074, 1023) * rng.choice([1.0, 1 + rng.random()])) for k in ("wide", None) for _ in range(400)]
    rows = [(k, v if math.isfinite(v) else 0.0) for k, v in rows]
    rows += [("close", 1.0 + i * 2.0**-52) for i in range(300)] + [("tied", v) for v in (0.0, -0.0, 5.0) for _ in range(50)]
    rows += [("odd", v) for v in (None, None, float("nan"), math.inf, -math.inf, 1.0)] + [("null", None), ("one", 7.0)]
    qs = (0.0, 0.2, 0.4, 0.5, 0.7, 0.9, 0.999, 1.0)
    text = lambda df: sorted(str(tuple(0.0 if x == 0 else x for x in r)) for r in df.collect())
    df = spark.createDataFrame(rows, "k string, v double")
    assert text(posterior.posterior_quantiles(df, ["k"], "v", qs, split=True)) == text(posterior.posterior_quantiles(df, ["k"], "v", qs))
    whole = spark.createDataFrame([(2**62 + i,) for i in range(9)] + [(-(2**62) - i,) for i in range(9)], "v long").selectExpr("1 AS k", "v")
    assert text(posterior.posterior_quantiles(whole, ["k"], "v", qs, split=True)) == text(posterior.posterior_quantiles(whole, ["k"], "v", qs))
    assert posterior.posterior_quantiles(df.where("false"), ["k"], "v", split=True).count() == 0


def test_matrix_entries(spark):
    """Entries without their diagonal and null draws are left out, a repeated entry counts again, and a null on the diagonal has no correlation."""
    rows = [(1, 0, 0, 4.0), (1, 1, 1, 9.0), (1, 0, 1, 3.0), (1, 0, 1, 3.0), (1, 0, 2, 5.0), (2, 0, 0, 1.0), (2, 1, 1, None), (2, 0, 1, -1.0), (None, 0, 0, 8.0)]
    got = {(r["i"], r["j"]): (r["mean"], r["pp"], r["r"]) for r in posterior.covariance_summary(spark.createDataFrame(rows, "draw int, i int, j int, value double")).collect()}
    assert got == {(0, 0): (2.5, 1.0, 1.0), (1, 1): (9.0, 0.5, 1.0), (0, 1): (5 / 3, 2 / 3, 0.5)}


def test_header_and_lines_in_one_file(spark):
    """A header and its lines are one file, in order, also where their shuffles are put together unlike each other, as on larger tables."""
    from codonspark.plans import more

    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        points = spark.range(20000).select(F.floor(F.col("id") / 50).alias("chain"), (F.col("id") % 50).alias("iter"), F.lit(1.0).alias("a"), F.lit(2.0).alias("b"))
        numbered = points.withColumn("iter", F.expr("row_number() OVER (PARTITION BY chain ORDER BY iter) - 1"))
        lines = files.numbered(spark, more._points(numbered))
        heads = lines.where("value LIKE '#%'").groupBy("line").count().collect()
        assert lines.select("file").distinct().count() == 400 and [tuple(r) for r in heads] == [(0, 400)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_heavy_nodes(spark):
    """Nodes near the root with many sites are found by broadcast: flags are those of the closure, for light and heavy nodes alike."""
    rows = [("t", 0, None, "r", None, False, 0)] + [("t", 1 + i, 0, f"i{i}", 0.5, False, 1) for i in range(3)] + [("t", 10 + i, 1 + i % 3, f"l{i}", 0.5, True, 2) for i in range(12)]
    nodes = spark.createDataFrame(rows, "tree string, node_id int, parent_id int, name string, branch_length double, is_leaf boolean, depth int")
    known = spark.range(60).selectExpr("'t' AS tree", "id % 15 AS site", "concat('l', pmod(id * id + id DIV 15, 12)) AS name").distinct()
    flags = lambda *a, **k: sorted(tuple(r) for r in trees.informative_nodes(nodes, *a, known, **k).collect())
    ups = trees.jumps(nodes)
    assert 0 in {r["node_id"] for r in trees.heavy_nodes(known.join(nodes, ["tree", "name"]), ups, 10).collect()}
    assert flags(trees.closure(nodes)) == flags(ups, heavy=2) == flags(ups, heavy=10) == flags(ups)


def test_triplets_are_dealt_once(spark):
    """Repeated sites, frames, other genes and null states; one shuffle, and no distinct count of sites."""
    rows = [("g", "a", s, 1) for s in (0, 1, 2, 3, 4, 4, 6, 7, 8, 9, 10, 11)] + [("g", "b", s, None if s == 7 else 2) for s in range(12)] + [("h", "a", 0, 1), ("h", "b", 1, 1)]
    long = spark.createDataFrame(rows, "gene string, taxon string, site int, state int")
    at = lambda **k: sorted({(r["gene"], r["site"]) for r in alignment.complete_triplets(long, **k).collect()})
    assert at() == [("g", s) for s in (0, 1, 2, 3, 4, 5, 9, 10, 11)] and at(frame=1) == [("g", s) for s in (1, 2, 3, 4, 5, 6)]
    plan = alignment.complete_triplets(long)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_lengths_in_one_pass(spark):
    """Events and times by site: the path is sorted once; states without rate add no time, keys without any have no row."""
    path = spark.createDataFrame([("g", 1, 0, i, s, 0.5) for i, s in enumerate((1, 1, 2, 9))] + [("g", 1, 1, 0, 1, 2.0), ("g", 2, 0, 0, 9, 1.0), ("g", 2, 0, 1, 9, 1.0), ("g", 3, 0, 0, None, 1.0), ("g", 3, 0, 1, 2, 1.0)], "gene string, site int, branch int, seg int, state int, t double")
    out = spark.createDataFrame([(1, 2.0), (2, 4.0)], "state int, out double")
    found = suffstat.length_suffstat(path, out, ["gene", "site"])
    assert sorted((r["site"], r["beta"], r["count"]) for r in found.collect()) == [(1, 8.0, 2), (3, 4.0, 0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1


def test_tree_lists(spark, tmp_path):
    """Many trees are few files, not a folder each; names with brackets stay, and a tree without a name is an error."""
    names = ["t]x", "[odd]", *(f"t{i}" for i in range(300))]
    nodes = spark.createDataFrame([(n, i, 0 if i else None, i, f"n{i}", f"{i}.5" if i else None, i > 0, int(i > 0)) for n in names for i in range(3)], "tree string, node_id int, parent_id int, child_rank int, name string, branch_value string, is_leaf boolean, depth int")
    files.write_newick(nodes, str(tmp_path / "many"))
    assert len(list((tmp_path / "many").glob("**/part-*"))) <= 4
    back = files.read_newick_list(spark, str(tmp_path / "many")).select("tree", "name", "branch_value", "is_leaf").collect()
    assert {tuple(r) for r in back} == {(n, f"n{i}", f"{i}.5" if i else "", i > 0) for n in names for i in range(3)} and len(back) == 3 * len(names)
    with pytest.raises(Exception, match="has no name"):
        files.read_newick_list(spark, put(tmp_path, "bare", "(A,B);\n")).collect()


def test_known_columns(spark):
    """First positions of known codons over the columns that some taxon of a gene knows: stops, missing, short, null and non-ASCII sequences, genes apart, a null gene; nothing is a row for each place."""
    rows = [("g", "a", "acgTAAGGN---TTTc"), ("g", "b", "---AAAGG-\u00e9ACTTT"), ("g", "c", "AC"), ("g", "d", None), ("h", "a", "TGATAGTAA"), (None, "a", "AAA"), ("k", "a", "---" * 70 + "CGA"), ("k", "b", "ACG")]
    wide = spark.createDataFrame(rows, "gene string, taxon string, seq string")
    found = alignment.codon_position(wide, 0, drop_missing=True)
    assert {(r["gene"], r["taxon"]): r["seq"] for r in found.collect()} == {
        ("g", "a"): "A-T", ("g", "b"): "-AT", ("g", "c"): "", ("g", "d"): "", ("h", "a"): "", (None, "a"): "", ("k", "a"): "-C", ("k", "b"): "A"}
    assert alignment.codon_position(wide, 2, drop_missing=True).where("gene = 'g' AND taxon = 'b'").first()["seq"] == "-AT"
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
