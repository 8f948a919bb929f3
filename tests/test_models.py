"""Likelihood against enumeration, laws of rate tables, merges, and the running posterior."""

import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from codonspark.functions import codons
from codonspark.operators import alignment, rates, suffstat
from codonspark.operators.likelihood import part_trees, pattern_likelihood, site_likelihood, transition
from codonspark.streaming.running import follow, landed_points, live_moments, live_posterior, running_posterior


def test_codes(spark):
    assert [len(codons.codon_rows(c)) for c in ("universal", "mt_mammal", "mt_invertebrate")] == [61, 60, 62]
    with pytest.raises(ValueError):
        codons.codon_rows("none")
    n = codons.codon_neighbours(spark)
    assert n.count() == 61 * 61 and n.where("position = -1").count() == 61 and n.where("position BETWEEN 0 AND 2").count() == 526
    d = codons.aa_distance(spark)
    assert d.count() == 380 and d.agg(F.avg("distance")).first()[0] == pytest.approx(1)


def test_encoding(spark):
    wide = spark.createDataFrame([("g", "A", "ACgt?-NTAA"), ("g", "B", "----------")], "gene string, taxon string, seq string")
    long = alignment.encode_states(wide)
    assert [r["state"] for r in long.where("taxon = 'A'").orderBy("site").collect()] == [0, 1, 2, 3, None, None, None, 3, 0, 0]
    assert alignment.drop_missing_taxa(long).select("taxon").distinct().count() == 1
    with pytest.raises(Exception):
        alignment.encode_states(wide.withColumn("seq", F.lit("A!"))).collect()
    with pytest.raises(Exception):
        alignment.make_codons(wide).collect()
    coded = alignment.make_codons(wide.withColumn("seq", F.concat("seq", F.lit("GG"))))
    assert [(r["codon"], r["stop"]) for r in coded.where("taxon = 'A'").orderBy("site").collect()] == [("ACG", False), (None, False), (None, False), ("AGG", False)]
    stops = alignment.report_stops(alignment.make_codons(spark.createDataFrame([("g", "A", "ACGTAAACG")], "gene string, taxon string, seq string")))
    assert [tuple(r) for r in stops.collect()] == [("g", "A", 2, 4, "TAA")]
    kinds = spark.createDataFrame([("d", "t", "ACGT-"), ("r", "t", "ACGU"), ("p", "t", "MKLE"), ("x", "t", "J!")], "gene string, taxon string, seq string")
    assert {r["gene"]: r["kind"] for r in alignment.detect_alphabet(kinds).collect()} == {"d": "dna", "r": "rna", "p": "protein", "x": None}


def test_prefix(spark):
    names = spark.createDataFrame([("Homo",), ("Mus_musculus_x",), ("Pan",), ("None",)], "name string")
    taxa = spark.createDataFrame([("Homo_sapiens",), ("Mus_musculus",), ("Pan_a",), ("Pan_b",)], "taxon string")
    assert {r["name"]: (r["taxon"], r["n"]) for r in alignment.match_taxa_prefix(names, taxa).collect()} == {"Homo": ("Homo_sapiens", 1), "Mus_musculus_x": ("Mus_musculus", 1), "Pan": ("Pan_a", 2)}


def test_likelihood(spark):
    q = np.array([[-1.0, 0.5, 0.3, 0.2], [0.4, -1.0, 0.3, 0.3], [0.2, 0.3, -0.9, 0.4], [0.1, 0.5, 0.4, -1.0]])
    freqs = np.array([0.1, 0.2, 0.3, 0.4])
    tree = [(0, None, "", 0.0), (1, 0, "", 0.3), (2, 1, "A", 0.1), (3, 1, "B", 0.7), (4, 0, "C", 1.2)]
    data = [("g", 0, {"A": 0, "B": 1, "C": 2}), ("g", 1, {"A": 3, "B": None, "C": 3}), ("g", 2, {})]
    df = spark.createDataFrame(data, "gene string, site int, states map<string,int>")
    got = {r["site"]: r["log_likelihood"] for r in site_likelihood(df, tree, q, freqs).collect()}
    p = {n: transition(q, t) for n, _, _, t in tree}
    for _, site, s in data:
        total = 0.0
        for x in itertools.product(range(4), repeat=5):
            if all(s.get(name) is None or x[n] == s[name] for n, _, name, _ in tree if name):
                total += freqs[x[0]] * math.prod(p[n][x[up], x[n]] for n, up, _, _ in tree if up is not None)
        assert got[site] == pytest.approx(math.log(total))


def test_part_trees(spark):
    """Parts of a gene over a star of 5000 leaves are sent their own leaves and the root, not the star."""
    nodes = spark.range(5001).selectExpr("'t' AS tree", "CAST(id AS INT) AS node_id", "CASE WHEN id > 0 THEN 0 END AS parent_id", "concat('s', id) AS name", "0.5D AS branch_length", "id > 0 AS is_leaf", "CAST(id > 0 AS INT) AS depth")
    dealt = spark.range(100).selectExpr("'g' AS gene", "CAST(id AS INT) AS part", "'t' AS tree", "array(1 + 2 * id, 2 + 2 * id) AS leaves")
    got = part_trees(dealt, nodes).groupBy("part").agg(F.sort_array(F.collect_list("node_id")).alias("n")).collect()
    assert {r["part"]: r["n"] for r in got} == {p: [0, 1 + 2 * p, 2 + 2 * p] for p in range(100)}


def test_pattern_likelihood(spark):
    """Four and 61 states, each gene by its own tree and rates, against sums over all states of the inner nodes; equal columns, missing and repeated states, deep trees, impossible columns."""
    codes = {r["codon"]: r["codon_id"] for r in codons.codon_table(spark).collect()}
    relrates = spark.createDataFrame([(1, a, b, 1.0 + i) for i, (a, b) in enumerate(itertools.combinations("ACGT", 2))], "set int, a string, b string, r double")
    base = spark.createDataFrame([(1, b, f) for b, f in zip("ACGT", (0.1, 0.2, 0.3, 0.4))], "set int, base string, freq double")
    nuc = rates.gtr_rates(relrates, base).where("a <> b")
    mg = [(1, codes[r["codon1"]], codes[r["codon2"]], r["rate"]) for r in rates.mg_codon_rates(codons.codon_neighbours(spark), nuc, 0.3).collect()]
    pi = [(1, codes[r["codon"]], r["stat"]) for r in rates.codon_stationary(codons.codon_table(spark).select("codon", "aa"), base).collect()]
    four = [(0, i, j, 0.2 + 0.1 * i + 0.05 * j) for i in range(4) for j in range(4) if i != j]
    freq4 = [(0, i, f) for i, f in enumerate((0.1, 0.2, 0.3, 0.4))]
    # x and y have the same leaves under other inner nodes
    forks = {"x": [(0, None, "", None), (1, 0, "", 0.3), (2, 1, "A", 0.1), (3, 1, "B", 0.7), (4, 0, "C", 1.2)], "y": [(0, None, "", None), (7, 0, "A", 0.2), (8, 0, "", 0.4), (9, 8, "B", 0.6), (5, 8, "C", 0.3)]}
    depth = {0: 0, 1: 1, 4: 1, 7: 1, 8: 1, 2: 2, 3: 2, 9: 2, 5: 2}
    nodes = [(t, i, up, name, length, bool(name), depth[i]) for t, rows in forks.items() for i, up, name, length in rows]
    nodes += [("deep", i, i - 1 if i else None, "Z" if i == 3000 else "", 0.001, i == 3000, i) for i in range(3001)] + [("zero", 0, None, "", None, False, 0), ("zero", 1, 0, "A", 0.0, True, 1), ("zero", 2, 0, "B", 0.0, True, 1), ("one", 0, None, "A", None, True, 0)]
    genes = [("g", "x", 0), ("h", "y", 0), ("c", "x", 1), ("d", "y", 1), ("deep", "deep", 0), ("zero", "zero", 0), ("one", "one", 0)]
    k = {"g": 4, "h": 4, "c": 61, "d": 61}
    columns = {(g, s): {"A": s % k[g], "B": None if s % 4 == 3 else (s * 7 + 1) % k[g], "C": (s * s) % k[g]} for g in k for s in range(8)} | {("g", 50): {"A": 0, "B": 1, "C": 0}, ("g", 51): {"A": None}, ("d", 52): {"B": 60}}
    rows = [(g, s, name, state) for (g, s), x in columns.items() for name, state in x.items()] * 2 + [("g", 2, "A", 3), ("g", 1, "Nobody", 3), ("deep", 1, "Z", 2), ("zero", 1, "A", 0), ("zero", 1, "B", 1), ("one", 1, "A", 3), ("unlisted", 1, "A", 0)]
    frames = (spark.createDataFrame(rows, "gene string, site int, name string, state int"), spark.createDataFrame(genes, "gene string, tree string, set int"), spark.createDataFrame(nodes, "tree string, node_id int, parent_id int, name string, branch_length double, is_leaf boolean, depth int"),
        spark.createDataFrame(four + mg, "set int, i int, j int, rate double"), spark.createDataFrame(freq4 + pi, "set int, i int, freq double"))
    got = {(r["gene"], r["site"]): r["log_likelihood"] for r in pattern_likelihood(*frames, per_task=3).collect()}
    models = {}
    for s, n, rr, ff in ((0, 4, four, freq4), (1, 61, mg, pi)):
        q, f = np.zeros((n, n)), np.zeros(n)
        for _, i, j, r in rr:
            q[i, j] = r
        np.fill_diagonal(q, -q.sum(axis=1))
        for _, i, x in ff:
            f[i] = x
        models[s] = q, f
    of = {g: (t, s) for g, t, s in genes}
    for (g, site), x in columns.items():
        t, s = of[g]
        q, f = models[s]
        p = {i: transition(q, length or 0.0) for i, _, _, length in forks[t]}
        inner = [i for i, _, name, _ in forks[t] if not name and i]
        total = 0.0
        for states in itertools.product(range(len(f)), repeat=1 + len(inner)):
            at = dict(zip([0, *inner], states))
            below = (p[i][at[up], at[i] if i in at else x[name]] for i, up, name, _ in forks[t] if up is not None and (i in at or x.get(name) is not None))
            total += f[at[0]] * math.prod(below)
        assert got.pop((g, site)) == pytest.approx(math.log(total), abs=1e-9), (g, site)
    q, f = models[0]
    assert got.pop(("deep", 1)) == pytest.approx(math.log(f @ transition(q, 3.0)[:, 2]))
    assert got.pop(("one", 1)) == pytest.approx(math.log(0.4)) and got.pop(("zero", 1)) == -math.inf and not got
    states, known, *rest = frames
    assert pattern_likelihood(states.where("false"), known, *rest).count() == 0
    with pytest.raises(Exception, match="has no tree or no rates"):
        pattern_likelihood(states, known.withColumn("tree", F.lit("none")), *rest).collect()


def test_rate_laws(spark):
    """Rows of rates sum to zero, and the stationary law is stationary."""
    relrates = spark.createDataFrame([("s", a, b, 1.0 + i) for i, (a, b) in enumerate(itertools.combinations("ACGT", 2))], "set string, a string, b string, r double")
    freqs = spark.createDataFrame([("s", b, f) for b, f in zip("ACGT", (0.1, 0.2, 0.3, 0.4))], "set string, base string, freq double")
    nuc = rates.gtr_rates(relrates, freqs)
    assert all(abs(r[1]) < 1e-12 for r in nuc.groupBy("a").agg(F.sum("rate")).collect())
    stat = rates.codon_stationary(codons.codon_table(spark).select("codon", "aa"), freqs)
    assert stat.agg(F.sum("stat")).first()[0] == pytest.approx(1)
    mg = rates.mg_codon_rates(codons.codon_neighbours(spark), nuc.where("a <> b"), 0.3)
    flux = mg.join(stat.select(F.col("codon").alias("codon1"), "stat"), "codon1").withColumn("f", F.col("stat") * F.col("rate"))
    out, into = ({r[0]: r[1] for r in flux.groupBy(c).agg(F.sum("f")).collect()} for c in ("codon1", "codon2"))
    assert all(out[c] == pytest.approx(into[c]) for c in out)


def test_suffstat(spark):
    path = spark.createDataFrame([("g", 1, 0, 1, 5, 0.5), ("g", 1, 0, 2, 7, 0.3), ("g", 1, 0, 3, 7, 0.2)], "gene string, site int, branch int, seg int, state int, t double")
    waiting, pairs = suffstat.path_suffstat(path, ["branch"])
    assert {r["state"]: r["t"] for r in waiting.collect()} == {5: 0.5, 7: 0.5} and [tuple(r) for r in pairs.collect()] == [(0, 5, 7, 1)]
    x = spark.createDataFrame([(0.0, 1.0, 2.0, 3.0), (2.0, 1.0, 2.0, 4.0)], "nsyn double, nnonsyn double, bsyn double, bnonsyn double")
    assert sorted(r["dnds"] for r in suffstat.branch_dnds(x).collect()) == [0.0, 0.25]
    for v in (0.5, 1.0, 3.7, 100.0):
        assert spark.range(1).select(suffstat.lgamma(F.lit(v))).first()[0] == pytest.approx(math.lgamma(v), abs=1e-9)
    one = suffstat.mixture_post_prob(spark.createDataFrame([(2.0, 1.0)], "count double, beta double"), 0.2, 2.5, 0.3, 0.0).first()
    assert one["p_pos"] == 0 and one["p_pur"] + one["p_neutral"] == pytest.approx(1)


def test_running_posterior(spark, tmp_path):
    schema = "chain string, iter long, param string, value double"
    spark.createDataFrame([("c", 0, "x", 1.0), ("c", 1, "x", -1.0)], schema).write.parquet(f"{tmp_path}/in/1")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = running_posterior(stream, ["param"], identity=["chain", "iter", "param"]).writeStream.format("memory").queryName("live").outputMode("complete").start()
    try:
        query.processAllAvailable()
        assert [tuple(r) for r in spark.table("live").collect()] == [("x", 2, 1, 0.0, 0.5)]
        spark.createDataFrame([("c", 1, "x", -1.0), ("c", 2, "x", 3.0)], schema).write.parquet(f"{tmp_path}/in/2")
        query.processAllAvailable()
        assert [tuple(r) for r in spark.table("live").collect()] == [("x", 3, 2, 1.0, pytest.approx(2 / 3))]
    finally:
        query.stop()


def test_chains_that_grow(spark, tmp_path):
    inbox, kept, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    os.makedirs(inbox)

    def land(name, text):
        with open(f"{tmp_path}/{name}", "w") as f:
            f.write(text)
        os.rename(f"{tmp_path}/{name}", f"{inbox}/{name}")
        stream = spark.readStream.option("maxFilesPerTrigger", 1).text(inbox)
        follow(live_moments(landed_points(stream, ["x", "y"])), kept, state).awaitTermination()
        return sorted(tuple(r) for r in live_posterior(spark, kept, ["x", "y"]).collect())

    # cut in a number, before the end mark, in the iteration; not numbers; no chain; a lone chain that is never whole
    first = land("1", "a\t0\t1.0\t-1.0\t\na\t5000\t3.0\t2.0\t\n\na\t1\t2.0\t\na\t2\t2.0\t12\nb\tx\t1\t1\t\na\t3\tnan\t1\t\na\t4\t1\tx\t\n\t1\t1\t1\t\na\t-1\t1\t1\t\n")
    assert first == [("a", "x", 2, 5000, 2.0, 1.0), ("a", "y", 2, 5000, 0.5, 0.5)]
    assert land("2", "a\t5000\t3.0\t2.0\t\na\t0\t1.0\t-1.0\t\n") == first  # landed twice, after a restart
    third = land("3", "a\t2\t2.0\t-128.5\t\na\t2\t2.0\t-128.5\t\na\t1\t6.0\t7.0\t\na\t1\t6.0\t5.5\t\nb\t0\t0\t-0.0\t\n")
    assert third == [("a", "x", 4, 5000, 3.0, 1.0), ("a", "y", 4, 5000, -30.5, 0.5), ("b", "x", 1, 0, 0.0, 0.0), ("b", "y", 1, 0, 0.0, 0.0)]


def test_grid_mixture(spark):
    """Two rows and two columns by hand; a row taken out again gives the other alone, and a codon that no process has gives null."""
    rate = {(i, k): 1.0 + 2 * i + 5 * j for i in (0, 1) for j, k in enumerate("uv")}
    stat = {(i, k): (i + 1) / (j + 3) for i in (0, 1) for j, k in enumerate("uv")}
    cells = spark.createDataFrame([(i, k, "AAA", "AAC", v) for (i, k), v in rate.items()] + [(0, "u", "CCC", "CCA", 1.0)], "set int, key string, codon1 string, codon2 string, rate double")
    law = spark.createDataFrame([(i, k, "AAA", v) for (i, k), v in stat.items()] + [(0, "u", "CCC", 0.0)], "set int, key string, codon string, stat double")
    rows, columns = spark.createDataFrame([(0, 0.25), (1, 0.75)], "set int, w double"), spark.createDataFrame([("u", 0.5), ("v", 0.5)], "key string, w double")
    whole = rates.grid_mixture(cells, law, rows, columns)

    def mean(ws):
        return sum(w * stat[i, k] * rate[i, k] for i, w in ws for k in "uv") / sum(w * stat[i, k] for i, w in ws for k in "uv")

    def found(mixture):
        return {(r["codon1"], r["codon2"]): r["rate"] for r in rates.mixture_rates(mixture).collect()}

    assert found(whole) == {("AAA", "AAC"): pytest.approx(mean([(0, 0.25), (1, 0.75)])), ("CCC", "CCA"): None}
    rest = rates.add_mixtures(whole, rates.grid_mixture(cells, law, rows.where("set = 0"), columns), -1)
    assert found(rest)["AAA", "AAC"] == pytest.approx(mean([(1, 0.75)]))
    assert found(rates.add_mixtures(rest, rates.grid_mixture(cells, law, rows.where("set = 0"), columns)))["AAA", "AAC"] == pytest.approx(mean([(0, 0.25), (1, 0.75)]))
    assert rates.mixture_rates(rates.grid_mixture(cells.where("false"), law, rows, columns)).count() == 0


def test_pair_counts_of_blocks(spark):
    """Blocks of taxa and parts of sites, sparse and dense, give what all pairs at all sites give."""
    import itertools
    import random

    from codonspark.operators import alignment

    rng, rows = random.Random(2), []
    for gene, taxa, share in (("a", 23, 0.9), ("b", 40, 0.1), (None, 3, 1.0), ("c", 1, 1.0)):
        for t, site in itertools.product(range(taxa), range(30)):
            known = rng.random() < share
            rows.append((gene, f"t{t}", site, rng.choice(["AAA", "AAG", "CCC"]) if known else None, None))
    aa = {"AAA": "K", "AAG": "K", "CCC": "P", None: None}
    rows = [(g, t, s, c, aa[c]) for g, t, s, c, _ in rows if g is not None]
    want = {}
    for g, s in {(r[0], r[2]) for r in rows}:
        here = sorted((r[1], r[3], r[4]) for r in rows if r[0] == g and r[2] == s and r[3])
        for x, y in itertools.combinations(here, 2):
            n, d, dn = want.get((g, x[0], y[0]), (0, 0, 0))
            want[g, x[0], y[0]] = (n + 1, d + (x[1] != y[1]), dn + (x[2] != y[2]))
    df = spark.createDataFrame(rows, "gene string, taxon string, site int, codon string, aa string")
    for blocks, parts in ((512, 1 << 18), (5, 40), (2, 1 << 18)):
        got = {(r["gene"], r["taxon1"], r["taxon2"]): (r["n"], r["d"], r["dn"]) for r in alignment.pair_counts(df, blocks, parts).collect()}
        assert got == want
        rates = {r["gene"]: r for r in alignment.pairwise_rates(df, blocks, parts).collect()}
        for g in ("a", "b"):
            own = [v for k, v in want.items() if k[0] == g]
            assert abs(rates[g]["divergence"] - sum(d / n for n, d, _ in own) / len(own)) < 1e-12
        assert rates["c"]["divergence"] is None and rates["c"]["n_unshared"] == 0
    assert alignment.pair_counts(df.where("false")).count() == 0


def test_blocks_meet_at_sites(spark):
    """Blocks of taxa that are known at no common site are never brought together, so rows don't grow with the number of blocks."""
    import pyarrow as pa

    from codonspark.operators import alignment

    rows = [("g", f"t{t:03}", 10 * (t // 8) + s, "AAA", "K") for t in range(64) for s in range(10)]
    df = spark.createDataFrame(rows, "gene string, taxon string, site int, codon string, aa string")
    give = lambda table, names, pairs: pa.table({"p": table.column("p")[:1], "q": table.column("q")[:1], "n": [int(pairs[2].sum())]})
    for part_rows in (1 << 18, 20):
        met = sorted(map(tuple, alignment._paired(df, give, "p int, q int, n long", 8, part_rows)[1].collect()))
        assert met == [(k, k, 280) for k in range(8)]


def test_pairs_of_spread_taxa(spark, monkeypatch):
    """Taxa that meet in ever other blocks go to few sides, not to a pair of blocks for each pair of them; sides and lots give what all pairs at all sites give."""
    import itertools
    import random

    import pyarrow as pa

    from codonspark.operators import alignment

    rng = random.Random(5)
    rows = [(g, f"t{t:02}", s, *rng.choice([("AAA", "K"), ("AAG", "K"), ("CCC", "P"), (None, None)])) for g in "ab" for s in range(60) for t in rng.sample(range(64), 9)]
    df = spark.createDataFrame(rows, "gene string, taxon string, site int, codon string, aa string")
    give = lambda table, names, pairs: pa.table({"p": table.column("p")[:1], "q": table.column("q")[:1], "n": [int(pairs[2].sum())]})
    want = {}
    for g, s in {(r[0], r[2]) for r in rows}:
        for x, y in itertools.combinations(sorted(r[1:2] + r[3:] for r in rows if r[0] == g and r[2] == s and r[3]), 2):
            n, d, dn = want.get((g, x[0], y[0]), (0, 0, 0))
            want[g, x[0], y[0]] = (n + 1, d + (x[1] != y[1]), dn + (x[2] != y[2]))
    assert [r[:2] for r in alignment._paired(df, give, "p int, q int, n long", 4, 1 << 18)[1].collect()] == [(0, 0), (0, 0)]
    for pairs, lots in ((1 << 22, 16), (200, 1)):
        monkeypatch.setattr(alignment, "PART_PAIRS", pairs)
        monkeypatch.setattr(alignment, "LOT_PAIRS", lots)
        assert {(r["gene"], r["taxon1"], r["taxon2"]): (r["n"], r["d"], r["dn"]) for r in alignment.pair_counts(df, 4).collect()} == want
        for r in alignment.pairwise_rates(df, 4).collect():
            own = [v for k, v in want.items() if k[0] == r["gene"]]
            assert abs(r["divergence"] - sum(d / n for n, d, _ in own) / len(own)) < 1e-12
            assert r["n_unshared"] == len({x[1] for x in rows if x[0] == r["gene"]}) * (len({x[1] for x in rows if x[0] == r["gene"]}) - 1) // 2 - len(own)


def test_leaves_are_no_rows_of_a_part(spark, monkeypatch):
    """Patterns bring their leaves along, so a part of a gene is sent what is above them alone: of a star the root."""
    from codonspark.operators import likelihood

    sent, real = [], likelihood.part_trees
    monkeypatch.setattr(likelihood, "part_trees", lambda *given: sent.append(real(*given)) or sent[-1])
    nodes = spark.range(301).selectExpr("'t' AS tree", "CAST(id AS INT) AS node_id", "CASE WHEN id > 0 THEN 0 END AS parent_id", "concat('s', id) AS name", "CASE WHEN id > 0 THEN 0.25D * (1 + id % 3) END AS branch_length", "id > 0 AS is_leaf", "CAST(id > 0 AS INT) AS depth")
    states = spark.range(300).selectExpr("'g' AS gene", "id DIV 3 AS site", "concat('s', 1 + id) AS name", "CAST(id * id % 4 AS INT) AS state")
    genes = spark.sql("SELECT 'g' AS gene, 't' AS tree, 0 AS `set`")
    rates_ = spark.range(16).selectExpr("0 AS `set`", "CAST(id DIV 4 AS INT) AS i", "CAST(id % 4 AS INT) AS j", "1 / 3D AS rate")
    freqs = spark.range(4).selectExpr("0 AS `set`", "CAST(id AS INT) AS i", "0.25D AS freq")
    got = {r["site"]: r["log_likelihood"] for r in likelihood.pattern_likelihood(states, genes, nodes, rates_, freqs).collect()}
    assert [tuple(r)[3:5] for r in sent[0].collect()] == [(0, None)]
    e = {i: math.exp(-4 / 3 * 0.25 * (1 + i % 3)) for i in range(1, 301)}
    for s in range(100):
        own = [(1 + i, i * i % 4) for i in range(3 * s, 3 * s + 3)]
        assert got[s] == pytest.approx(math.log(sum(0.25 * math.prod(e[n] * (x == b) + (1 - e[n]) / 4 for n, x in own) for b in range(4))))
