"""Further queries with their SQL: readers and writers over files that Spark writes from the tables, and the rest of the inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codonspark.functions import codons as c
from codonspark.functions.shared import by_few, shared_path, staged
from codonspark.operators import alignment as al
from codonspark.operators import posterior as po
from codonspark.operators import rates as ra
from codonspark.operators import suffstat as su
from codonspark.operators import trees as tr
from codonspark.operators.likelihood import pattern_likelihood
from codonspark.plans.catalog import DISTANCE, FDR, GENE_PP, LABELS, MUTSEL, PATH_PAIRS, QUANTILE, RANKED, SITE_PP, STEPS, _nuc, after, coded, near, put, query, rounded
from codonspark.plans.standin import table
from codonspark.sources import files
from codonspark.streaming.running import follow, landed_points, live_moments, live_posterior
from codonspark.streaming.running import running_posterior as live

# Files. Each query writes a table in the format, many files or lines as the table is long, and reads it back.


def _put(lines: DataFrame, by: str) -> str:
    """Lines (by, ord, value) as one text file for each `by`, in the order of ord; its folder.

    They are dealt by a hash of `by`: dealt by `by` itself, a union of two tables that are already dealt so (a header and its lines) is not dealt again, and its
    two sides, whose small partitions are put together each for itself, leave one `by` in two tasks and two files.
    """
    path = shared_path(lines.sparkSession, "files")
    lines.repartition(F.xxhash64(by)).sortWithinPartitions(by, "ord").select(by, "value").write.partitionBy(by).text(path)
    return path


def _wide_file(a: DataFrame, body) -> str:
    """One text for each gene of an alignment: body(number of taxa, number of sites, array of (taxon, seq))."""
    path = shared_path(a.sparkSession, "files")
    gene = a.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("seq")).alias("m"), F.sort_array(F.collect_list(F.struct("taxon", "seq"))).alias("rows"))
    gene.select("gene", body(F.col("n"), F.col("m"), F.col("rows")).alias("value")).write.partitionBy("gene").text(path)
    return path


def _lines(rows: Column, text: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(rows, text), "\n")


ALIGNED = "SELECT gene, taxon, seq FROM alignments"


@query("alignments", ALIGNED)
def read_phylip(a):
    path = shared_path(a.sparkSession, "files")
    files.write_phylip(a, path)
    return files.read_phylip(a.sparkSession, path)


@query("alignments", ALIGNED)
def read_phylip_interleaved(a):
    def body(n, m, rows):
        first = _lines(rows, lambda r: F.concat(r["taxon"], F.lit("  "), F.substring(r["seq"], 1, 20)))
        rest = _lines(rows, lambda r: F.substring(r["seq"], 21, 1000))
        return F.concat_ws("\n", F.concat_ws(" ", n, m), first, F.lit(""), rest)

    return files.read_phylip(a.sparkSession, _wide_file(a, body))


@query("alignments", ALIGNED)
def read_nexus(a):
    def body(n, m, rows):
        half = lambda at, size: _lines(rows, lambda r: F.concat(r["taxon"], F.lit(" "), F.substring(r["seq"], at, size)))
        head = F.concat(F.lit("#NEXUS\n[made here]\nbegin data;\ndimensions ntax="), n, F.lit(" nchar="), m, F.lit(";\nformat datatype=dna interleave;\nMatrix"))
        return F.concat_ws("\n", head, half(1, 15), F.lit(""), half(16, 1000), F.lit(";\nend;"))

    return files.read_nexus(a.sparkSession, _wide_file(a, body))


@query("alignments", ALIGNED)
def read_special_alphabet(a):
    body = lambda n, m, rows: F.concat_ws("\n", F.concat_ws(" ", F.lit("#SPECIALALPHABET"), n, m, F.lit("ACGT")), _lines(rows, lambda r: F.concat_ws(" ", r["taxon"], r["seq"])))
    return files.read_special_alphabet(a.sparkSession, _wide_file(a, body))


@query("alignments", ALIGNED)
def read_gene_list(a):
    path, listed = shared_path(a.sparkSession, "files"), shared_path(a.sparkSession, "files")
    files.write_phylip(a, path)
    genes = a.select("gene").distinct()
    number = genes.agg(F.count(F.lit(1)).cast("string").alias("value"))
    number.union(genes).write.text(listed)
    return files.read_gene_list(a.sparkSession, listed, path)


@query("alignments", ALIGNED)
def read_ali_catalog(a):
    gene = a.groupBy("gene").agg(F.concat_ws("\n", "gene", F.concat_ws(" ", F.count(F.lit(1)), F.max(F.length("seq"))), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("taxon", "seq"))), lambda r: F.concat_ws(" ", r["taxon"], r["seq"])), "\n")).alias("text"))
    lot = gene.groupBy(F.pmod(F.xxhash64("gene"), F.lit(8)).alias("lot")).agg(F.concat_ws("\n", F.lit("ALI"), F.count(F.lit(1)), F.array_join(F.collect_list("text"), "\n")).alias("value"))
    path = shared_path(a.sparkSession, "files")
    lot.write.partitionBy("lot").text(path)
    return files.read_ali_catalog(a.sparkSession, path)


@query("alignments", """SELECT gene, value FROM (SELECT gene, concat(taxon, repeat(' ', (5 + max(length(taxon)) OVER (PARTITION BY gene) - length(taxon))::INT), seq) AS value FROM alignments)
  UNION ALL SELECT gene, count(*)::VARCHAR || chr(9) || max(length(seq))::VARCHAR FROM alignments GROUP BY gene""")
def write_phylip(a):
    path = shared_path(a.sparkSession, "files")
    files.write_phylip(a, path, padded=True)
    return a.sparkSession.read.text(path).select("gene", "value")


@query("bases|codons", """SELECT gene, count(*) AS n_lines, sum(length(value)) AS size, sum(length(value) - length(replace(value, '-', ''))) AS n_missing FROM
  (SELECT gene, taxon::VARCHAR || repeat(' ', (5 + max(length(taxon::VARCHAR)) OVER (PARTITION BY gene) - length(taxon::VARCHAR))::INT) || s AS value FROM (SELECT gene, taxon, string_agg(coalesce(codon, '---'), '' ORDER BY site) AS s FROM codons GROUP BY gene, taxon) x) GROUP BY gene""")
def write_codon_phylip(b):
    path = shared_path(b.sparkSession, "files")
    files.write_codon_phylip(coded(b).withColumn("taxon", F.col("taxon").cast("string")), path)
    lines = b.sparkSession.read.text(path).where("value NOT LIKE '%\\t%'")
    return lines.groupBy("gene").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("value")).alias("size"), F.sum(F.length("value") - F.length(F.replace("value", F.lit("-"), F.lit("")))).alias("n_missing"))


@query("alignments", "SELECT gene, '>' || taxon AS value FROM alignments UNION ALL SELECT gene, seq FROM alignments")
def write_fasta(a):
    path = shared_path(a.sparkSession, "files")
    files.write_fasta(a, path)
    return a.sparkSession.read.text(path).select("gene", "value")


@query("part", "SELECT p_partkey, p_brand, p_size, round(p_retailprice, 6) AS p_retailprice FROM part")
def write_report(p):
    path = shared_path(p.sparkSession, "files")
    files.write_report(p.select("p_partkey", "p_brand", "p_size", "p_retailprice"), path, tsv=True)
    return p.sparkSession.read.csv(path, sep="\t", header=True, schema="p_partkey long, p_brand string, p_size int, p_retailprice double")


@query("gene_catalog", "SELECT count(*)::VARCHAR AS value FROM gene_catalog UNION ALL SELECT gene || chr(9) || nsite::VARCHAR FROM gene_catalog")
def write_gene_list(g):
    path = shared_path(g.sparkSession, "files")
    files.write_gene_list(g, path)
    return g.sparkSession.read.text(path)


@query("customer", """SELECT c_name AS taxon, 'balance' AS "character", CASE WHEN round(c_acctbal, 2) <> -1 THEN round(c_acctbal, 2) END AS value FROM customer
  UNION ALL SELECT c_name, 'nation', CASE WHEN c_nationkey > 4 THEN c_nationkey::DOUBLE END FROM customer""")
def read_traits(t):
    rows = t.select(F.floor(F.col("c_custkey") / 500).alias("lot"), F.col("c_custkey").alias("ord"), F.concat_ws("\t", "c_name", F.round("c_acctbal", 2).cast("decimal(18,2)"), F.when(F.col("c_nationkey") > 4, F.col("c_nationkey")).otherwise(-1)).alias("value"))
    head = rows.groupBy("lot").agg(F.lit(-1).cast("long").alias("ord"), F.concat(F.lit("#TRAITS "), F.count(F.lit(1)), F.lit(" 2 balance nation")).alias("value"))
    return files.read_traits(t.sparkSession, _put(head.union(rows), "lot"))


def _forest(f: DataFrame) -> DataFrame:
    return f.withColumn("branch_value", F.col("branch_length").cast("string"))


FOREST = "SELECT f.tree::VARCHAR AS tree, f.name, p.name AS parent, f.branch_length, f.is_leaf, f.depth FROM forest f LEFT JOIN forest p ON p.tree = f.tree AND p.node_id = f.parent_id"


@query("forest", FOREST)
def read_newick(f):
    path = shared_path(f.sparkSession, "files")
    files.write_newick(_forest(f), path)
    n = files.read_newick_list(f.sparkSession, path)
    up = n.select("tree", F.col("node_id").alias("parent_id"), F.col("name").alias("parent"))
    return n.join(up, ["tree", "parent_id"], "left").select("tree", "name", "parent", "branch_length", "is_leaf", "depth")


@query("forest", "SELECT f.tree, name || CASE WHEN is_leaf THEN '' ELSE '_' || k.n END AS name, branch_length FROM forest f LEFT JOIN (SELECT tree, parent_id, count(*)::VARCHAR AS n FROM forest GROUP BY ALL) k ON k.tree = f.tree AND k.parent_id = f.node_id")
def write_newick(f):
    """Names with a value of the node, and branches with the index of the node, read back and put together by it."""
    spark = f.sparkSession
    children = f.where("parent_id IS NOT NULL").groupBy("tree", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).cast("string").alias("n"))
    nodes = _forest(f).join(children, ["tree", "node_id"], "left").withColumn("index", F.col("node_id").cast("string"))
    valued, indexed = shared_path(spark, "files"), shared_path(spark, "files")
    files.write_newick(nodes, valued, node_value="n")
    files.write_newick(nodes, indexed, branch="index")
    a, b = files.read_newick_list(spark, valued), files.read_newick_list(spark, indexed)
    index = b.select(F.col("tree").cast("long").alias("tree"), F.col("node_id").alias("place"), F.coalesce(F.expr("try_cast(branch_value AS BIGINT)"), F.lit(0)).alias("node_id"))
    named = a.select(F.col("tree").cast("long").alias("tree"), F.col("node_id").alias("place"), "name")
    return named.join(index, ["tree", "place"]).join(f.select("tree", "node_id", "branch_length"), ["tree", "node_id"]).select("tree", "name", "branch_length")


def _points(t: DataFrame) -> str:
    rows = t.select("chain", F.col("iter").alias("ord"), F.concat_ws("\t", "a", "b").alias("value"))
    return _put(t.groupBy("chain").agg(F.lit(-1).cast("long").alias("ord"), F.lit("#a\tb").alias("value")).union(rows), "chain")


@query("chain_points", "SELECT chain::VARCHAR AS chain, iter, 0 AS ordinal, 'a' AS param, round(a, 6) AS value FROM chain_points UNION ALL SELECT chain::VARCHAR, iter, 1, 'b', round(b, 6) FROM chain_points")
def read_trace(t):
    return files.read_trace(t.sparkSession, _points(t), chain=True)


@query("chain_points", "SELECT chain, iter + 1 AS line, round(a, 6) AS a FROM chain_points")
def iter_index(t):
    lines = files.numbered(t.sparkSession, _points(t)).where("line > 0")
    return lines.select(F.regexp_extract("file", "chain=([0-9]+)", 1).cast("long").alias("chain"), "line", F.split("value", "\t")[0].cast("double").alias("a"))


def _drawn(d: DataFrame, text) -> str:
    """A line for each point: text over its genes in order."""
    genes = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "gene", "nsite", "v"))), text)
    return _put(d.groupBy(F.lit(0).alias("run"), F.col("iter").cast("long").alias("ord")).agg(F.array_join(genes, "\t").alias("value")), "run")


@query("draws gene_catalog", "SELECT iter::BIGINT AS iter, gene, round(v, 6) AS value FROM draws")
def read_gene_trace(d, g):
    return files.read_gene_trace(d.sparkSession, _drawn(d, lambda x: x["v"].cast("string")), g)


def _sites(x, width: int):
    return F.array_join(F.transform(F.sequence(F.lit(1), x["nsite"] * width), lambda k: (x["v"] * k).cast("string")), "\t")


@query("draws gene_catalog", "SELECT iter::BIGINT AS iter, gene, (k - 1)::INT AS site, round(v * k, 6) AS value FROM (SELECT *, unnest(range(1, nsite + 1)) AS k FROM draws)")
def read_site_trace(d, g):
    return files.read_site_trace(d.sparkSession, _drawn(d, lambda x: F.concat_ws("\t", x["gene"], _sites(x, 1))), g)


@query("draws gene_catalog", "SELECT iter::BIGINT AS iter, gene, ((k - 1) // 20)::INT AS site, ((k - 1) % 20)::INT AS aa, round(v * k, 6) AS value FROM (SELECT *, unnest(range(1, 20 * nsite + 1)) AS k FROM draws)")
def read_site_aa_trace(d, g):
    return files.read_site_trace(d.sparkSession, _drawn(d, lambda x: F.concat_ws("\t", x["gene"], _sites(x, 20))), g, 20)


@query("draws", "SELECT iter::BIGINT AS iter, ordinal AS branch, round(nsite, 6)::DOUBLE AS nsyn, round(2 * nsite, 6)::DOUBLE AS nnonsyn, round(v, 6) AS bsyn, round(v * 2, 6) AS bnonsyn FROM draws")
def read_branch_suffstat(d):
    return files.read_branch_suffstat(d.sparkSession, _drawn(d, lambda x: F.concat_ws("\t", x["nsite"], x["nsite"] * 2, x["v"], x["v"] * 2)))


@query("part", "SELECT p_partkey::VARCHAR AS gene, round(-l1, 6) AS lnl1, round(-l2, 6) AS lnl2, round(l1 - l2, 6) AS delta FROM (SELECT p_partkey, 1000 + p_size / 2 AS l1, 990 + p_size / 4 AS l2 FROM part) x")
def read_codeml_pairs(p):
    line = lambda v: F.concat(F.col("p_partkey"), F.lit(" lnL(ntime: 10  np: 15):  -"), v.cast("decimal(12,2)"), F.lit("      +0.000000"))
    texts = F.array(F.concat(F.lit("seed used = "), "p_size"), line(1000 + F.col("p_size") / 2), F.lit(""), line(990 + F.col("p_size") / 4))
    rows = p.select(F.floor(F.col("p_partkey") / 1000).alias("log"), F.col("p_partkey"), F.posexplode(texts).alias("k", "value")).select("log", (4 * F.col("p_partkey") + F.col("k")).alias("ord"), "value")
    return files.read_codeml_pairs(p.sparkSession, _put(rows, "log"))


@query("codeml", "SELECT gene::VARCHAR AS gene, round(delta, 6) AS delta, round(0.5, 6)::DOUBLE AS pval, round(0.25, 6)::DOUBLE AS qval FROM codeml")
def read_codeml_table(t):
    path = shared_path(t.sparkSession, "files")
    t.select("gene", "delta", F.lit(0.5), F.lit(0.25)).write.csv(path, sep="\t")
    return files.read_codeml_table(t.sparkSession, path)


@query("branch_suffstat", "SELECT branch, " + ", ".join(f"round(sum({x}), 6) AS {x}" for x in ("nsyn", "nnonsyn", "bsyn", "bnonsyn")) + " FROM branch_suffstat GROUP BY branch")
def mapped_trees(b):
    """Four annotated trees for each gene, written as Newick, read, and merged over genes; the branches are named by their leaf."""
    spark = b.sparkSession
    leaves = b.select("gene", "branch", *su_columns())
    root = leaves.select("gene").distinct()

    def table(stat: str) -> DataFrame:
        leaf = leaves.select(F.col("gene").cast("string").alias("tree"), (F.col("branch") + 1).alias("node_id"), F.lit(0).cast("long").alias("parent_id"), F.col("branch").alias("child_rank"), F.col("branch").cast("string").alias("name"), F.col(stat).cast("string").alias("branch_value"), F.lit(1).alias("depth"))
        top = root.select(F.col("gene").cast("string").alias("tree"), F.lit(0).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).cast("long").alias("child_rank"), F.lit("root").alias("name"), F.lit(None).cast("string").alias("branch_value"), F.lit(0).alias("depth"))
        path = shared_path(spark, "files")
        files.write_newick(top.union(leaf), path)
        read = files.read_newick_list(spark, path).where("is_leaf")
        return read.withColumn("node_id", F.col("name").cast("long"))

    return tr.merge_mapped_branches(tr.mapped_trees(*[table(s) for s in ("nsyn", "bsyn", "nnonsyn", "bnonsyn")]))


def su_columns() -> list[str]:
    return ["nsyn", "nnonsyn", "bsyn", "bnonsyn"]


# Codons


@query("path|near", f"""SELECT CASE WHEN d = 1 THEN k - 1 ELSE 3 END AS position, count(*) AS n FROM (SELECT from_state, to_state, (x.codon[1] <> y.codon[1])::INT + (x.codon[2] <> y.codon[2])::INT + (x.codon[3] <> y.codon[3])::INT AS d,
  CASE WHEN x.codon[1] <> y.codon[1] THEN 1 WHEN x.codon[2] <> y.codon[2] THEN 2 ELSE 3 END AS k FROM {STEPS} s JOIN codon x ON x.codon_id = from_state JOIN codon y ON y.codon_id = to_state WHERE from_state <> to_state) z GROUP BY ALL""")
def codon_neighbours(p):
    steps = su.path_suffstat(p, ["branch"])[1]
    kinds = c.codon_neighbours(p.sparkSession).select(F.col("codon_id1").alias("from_state"), F.col("codon_id2").alias("to_state"), "position")
    return steps.join(kinds, ["from_state", "to_state"]).groupBy("position").agg(F.sum("n").alias("n"))


@query("path|near", f"SELECT branch, sum(n) FILTER (WHERE synonymous)::BIGINT AS n_synonymous, sum(n)::BIGINT AS n FROM ({PATH_PAIRS}) p JOIN near k ON k.codon_id1 = from_state AND k.codon_id2 = to_state GROUP BY branch")
def is_synonymous(p):
    steps, kinds = su.path_suffstat(p, ["branch"])[1], near(p.sparkSession).where("position BETWEEN 0 AND 2").select(F.col("codon_id1").alias("from_state"), F.col("codon_id2").alias("to_state"), "synonymous")
    return steps.join(kinds, ["from_state", "to_state"]).groupBy("branch").agg(F.sum(F.when(F.col("synonymous"), F.col("n"))).alias("n_synonymous"), F.sum("n").alias("n"))


@query("path|near", f"SELECT branch, sum(n) FILTER (WHERE gc_conservative)::BIGINT AS n_conservative, sum(n)::BIGINT AS n FROM ({PATH_PAIRS}) p JOIN near k ON k.codon_id1 = from_state AND k.codon_id2 = to_state GROUP BY branch")
def is_gc_conservative(p):
    steps, kinds = su.path_suffstat(p, ["branch"])[1], near(p.sparkSession).where("position BETWEEN 0 AND 2").select(F.col("codon_id1").alias("from_state"), F.col("codon_id2").alias("to_state"), "gc_conservative")
    return steps.join(kinds, ["from_state", "to_state"]).groupBy("branch").agg(F.sum(F.when(F.col("gc_conservative"), F.col("n"))).alias("n_conservative"), F.sum("n").alias("n"))


@query("path|near", f"WITH {DISTANCE} SELECT branch, round(sum(n * distance) / sum(n), 6) AS mean_distance FROM ({PATH_PAIRS}) p JOIN codon x ON x.codon_id = from_state JOIN codon y ON y.codon_id = to_state JOIN d ON d.aa1 = x.aa AND d.aa2 = y.aa GROUP BY branch")
def aa_distance(p):
    spark = p.sparkSession
    code = c.codon_table(spark)
    ends = [code.select(F.col("codon_id").alias(s), F.col("aa").alias(a)) for s, a in (("from_state", "aa1"), ("to_state", "aa2"))]
    steps = su.path_suffstat(p, ["branch"])[1].join(ends[0], "from_state").join(ends[1], "to_state").join(c.aa_distance(spark), ["aa1", "aa2"])
    return steps.groupBy("branch").agg((F.sum(F.col("n") * F.col("distance")) / F.sum("n")).alias("mean_distance"))


@query("wide", """SELECT gene, sum(n) AS n FROM (SELECT gene, count(*) AS n FROM (SELECT gene, taxon, unnest(range(0, length(s) // 3)) AS i, s FROM (SELECT gene, taxon, regexp_replace(upper(seq), '[^ACGTN-]', '-', 'g') AS s FROM wide) x) y
  WHERE regexp_matches(substr(s, 3 * i + 1, 3), '^[ACGT]{3}$') AND substr(s, 3 * i + 1, 3) NOT IN ('TAA', 'TAG', 'TGA') GROUP BY gene, i HAVING count(*) > 0) GROUP BY gene""")
def codon_position_columns(w):
    """Known bases of the first codon position, over the columns that some taxon of the gene knows."""
    clean = w.withColumn("seq", F.regexp_replace(F.upper("seq"), "[^ACGTN-]", "-"))
    out = al.codon_position(clean, 0, drop_missing=True)
    return out.groupBy("gene").agg(F.sum(F.length(F.replace("seq", F.lit("-"), F.lit("")))).alias("n")).where("n > 0")


@query("states", "SELECT gene, count(DISTINCT taxon) FILTER (WHERE state IS NOT NULL) AS ntaxa FROM states GROUP BY gene")
def taxa_counts(s):
    return al.taxa_counts(s)


@query("states", "SELECT gene, n_codons, weight, row_number() OVER (ORDER BY weight DESC, gene) AS rank FROM (SELECT gene, count(DISTINCT site) // 3 AS n_codons, count(DISTINCT site) * count(DISTINCT taxon) AS weight FROM states GROUP BY gene) x")
def gene_sizes_ranked(s):
    return al.gene_sizes_ranked(s)


# Posterior


@query("gene_trace part", "SELECT p.p_name AS gene, g.gene AS ordinal, g.n FROM (SELECT gene, count(*) AS n FROM gene_trace GROUP BY gene) g JOIN part p ON p.p_partkey = g.gene")
def attach_gene_names(t, p):
    rows = t.groupBy(F.col("gene").alias("ordinal")).agg(F.count(F.lit(1)).alias("n"))
    return po.attach_gene_names(rows, p.select(F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("gene")))


@query("site_trace gene_trace", "SELECT gene AS ordinal, 'rows' AS side FROM (SELECT gene FROM site_trace EXCEPT SELECT gene FROM gene_trace) UNION ALL SELECT gene, 'list' FROM (SELECT gene FROM gene_trace EXCEPT SELECT gene FROM site_trace)")
def gene_places(s, g):
    return po.gene_places(s.withColumnRenamed("gene", "ordinal"), g.withColumnRenamed("gene", "ordinal"))


@query("gene_trace site_trace", f"""SELECT a.gene, round(pp, 6) AS pp, round(mean_posw, 6) AS mean_posw, round(mean_posom, 6) AS mean_posom, low, high, site_pp FROM ({GENE_PP}) a JOIN
  (SELECT gene, {QUANTILE.format(q=0.025)} AS low, {QUANTILE.format(q=0.975)} AS high FROM ({RANKED.format(k='gene', v='posom', t='gene_trace WHERE iter >= 5')}) x GROUP BY gene) b ON a.gene = b.gene
  LEFT JOIN (SELECT gene, string_agg(trunc(100 * pp)::INT::VARCHAR, ',' ORDER BY site) AS site_pp FROM ({SITE_PP}) x GROUP BY gene) s ON s.gene = a.gene""")
def gene_post_analysis_sites(t, s):
    sites = s.groupBy("gene", "site").agg(po.share(F.col("value") > 0).alias("pp"))
    return po.gene_post_analysis(after(t), sites).withColumn("site_pp", F.array_join("site_pp", ","))


@query("site_trace", f"""SELECT x.gene, round(pp, 6) AS pp, {FDR.format(t='x.gene')}, bin0, bin1, bin2, bin3 FROM (SELECT gene, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) AS pp FROM site_trace GROUP BY gene) x
  JOIN (SELECT gene, {', '.join(f'count(*) FILTER (WHERE least(floor(pp * 4), 3) = {i}) AS bin{i}' for i in range(4))} FROM ({SITE_PP}) y GROUP BY gene) b ON b.gene = x.gene""")
def gene_shift_ranking(t):
    genes = t.groupBy("gene").agg(po.share(F.col("value") > 0).alias("pp"))
    return po.gene_shift_ranking(genes, t.groupBy("gene", "site").agg(po.share(F.col("value") > 0).alias("pp")))


@query("alloc component_weights", "SELECT count(*) FILTER (WHERE n > 0) AS n_clusters, round(sum(coalesce(n, 0) * ln(weight)), 6) AS log_prob FROM component_weights w LEFT JOIN (SELECT component, count(*) AS n FROM alloc GROUP BY component) a ON a.component = w.component")
def occupancy_totals(a, w):
    return po.occupancy_totals(po.occupancy(a, w))


STATISTICS = """k AS (SELECT gene AS rep, site, aa, count(*) AS n FROM codons GROUP BY ALL), t AS (SELECT rep, site, count(aa) AS d, max(n) FILTER (WHERE r = 2 AND aa IS NOT NULL) / max(n) FILTER (WHERE r = 1 AND aa IS NOT NULL) AS q FROM
  (SELECT *, row_number() OVER (PARTITION BY rep, site, aa IS NULL ORDER BY n DESC, aa) AS r FROM k) GROUP BY rep, site),
s AS (SELECT rep, 'div' AS stat, sum(d) / count(*) AS value FROM t GROUP BY rep UNION ALL SELECT rep, 'nconst', count(*) FILTER (WHERE d = 1)::DOUBLE FROM t GROUP BY rep UNION ALL SELECT rep, 'freq21', coalesce(avg(q), 0) FROM t GROUP BY rep)"""


@query("bases|codons", f"WITH {STATISTICS} SELECT rep, stat, round(value, 6) AS value FROM s")
def predictive_statistics(b):
    return po.predictive_statistics(coded(b).withColumnRenamed("gene", "rep"))


@query("bases|codons", f"""WITH {STATISTICS}, o AS (SELECT stat, 0.99e0 * max(value) AS value FROM s GROUP BY stat) SELECT s.stat, round(any_value(o.value), 6) AS obs, round(avg(s.value), 6) AS mean, round(stddev_pop(s.value), 6) AS sd,
  round(avg(CASE WHEN s.value > o.value THEN 1.0 ELSE 0.0 END), 6) AS pp FROM s JOIN o ON o.stat = s.stat GROUP BY s.stat""")
def predictive_test(b):
    """The statistics of replicate alignments against observed ones."""
    stats = po.predictive_statistics(coded(b).withColumnRenamed("gene", "rep"))
    return po.posterior_predictive(stats, stats.groupBy("stat").agg((0.99 * F.max("value")).alias("value"))).drop("z")


def _alt(codons: str) -> str:
    """SQL of (gene, stat, value) over the rows of a table of codons."""
    pairs = f"(SELECT x.gene, x.taxon, y.taxon AS other, count(*) AS n, count(*) FILTER (WHERE x.codon <> y.codon) AS d, count(*) FILTER (WHERE x.aa <> y.aa) AS dn FROM {codons} x JOIN {codons} y ON x.gene = y.gene AND x.site = y.site AND x.taxon < y.taxon WHERE x.codon IS NOT NULL AND y.codon IS NOT NULL GROUP BY ALL)"
    return f"""SELECT gene, 'diversity' AS stat, sum(n) / count(*) AS value FROM (SELECT gene, site, count(DISTINCT aa) AS n FROM {codons} GROUP BY gene, site) GROUP BY gene
      UNION ALL SELECT gene, 'divergence', avg(d / n) FROM {pairs} GROUP BY gene UNION ALL SELECT gene, 'dnds', avg(dn / n) / avg(d / n) / 2.5 FROM {pairs} GROUP BY gene"""


@query("bases|codons", f"""WITH whole AS (SELECT 0 AS gene, taxon, site, codon, aa FROM codons), r AS ({_alt("codons")}), o AS ({_alt("whole")})
  SELECT r.stat, round(any_value(o.value), 6) AS obs, round(avg(r.value), 6) AS mean, round(stddev_pop(r.value), 6) AS sd, round(avg(CASE WHEN r.stat = 'diversity' AND r.value < o.value OR r.stat <> 'diversity' AND r.value > o.value THEN 1.0 ELSE 0.0 END), 6) AS pp,
  round((avg(r.value) - any_value(o.value)) / stddev_pop(r.value), 6) + 0.0 AS z FROM r JOIN o ON o.stat = r.stat GROUP BY r.stat""")
def predictive_test_alt(b):
    """Diversity, divergence and dN/dS of replicate alignments, the genes, against those of one observed alignment, all sites together."""
    codons = staged(coded(b))  # read four times
    observed = po.replicate_statistics(codons.withColumn("gene", F.lit(0)))
    return po.posterior_predictive_alt(po.replicate_statistics(codons), observed.select("stat", "value"))


def running_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of events as a stream of files: the aggregate over all that has landed, written at each trigger."""
    path = shared_path(spark, "live")
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    rows = stream.where("value IS NOT NULL").withColumn("iter", F.col("event_id"))
    keep = lambda df, _: df.write.mode("overwrite").parquet(path)
    live(rows, ["event_type"]).writeStream.outputMode("complete").option("checkpointLocation", shared_path(spark, "stream")).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.parquet(path))


put(running_posterior, "SELECT event_type, count(*) AS n, max(event_id) AS last_iter, round(avg(value), 6) AS mean, round(avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END), 6) AS pp FROM events WHERE value IS NOT NULL GROUP BY event_type")


CHAIN_PARAMS = ("quantity", "price", "discount")


def running_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all points of lineitem as chunk files that land in two lots, a third of them in both and a third cut in the first; the stream reads the first in several triggers, stops, and goes on from its checkpoint."""
    points = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.max("l_extendedprice").alias("price"), (F.max("l_discount") - 0.05).alias("discount"))
    line = F.concat(F.concat_ws("\t", "l_linenumber", "l_orderkey", *CHAIN_PARAMS), F.lit("\t"))
    third = F.pmod(F.xxhash64("l_linenumber", "l_orderkey"), F.lit(3))
    lines = points.select(line.alias("value"), third.alias("third"))
    cut = F.when(F.col("third") == 2, F.expr("left(value, length(value) - 1 - third)")).otherwise(F.col("value"))
    inbox, kept, state = (shared_path(spark, kind) for kind in ("inbox", "live", "stream"))

    def land(rows: DataFrame) -> None:
        rows.select("value").write.mode("append").text(inbox)
        chunks = len(spark.read.text(inbox).inputFiles())
        stream = spark.readStream.option("maxFilesPerTrigger", max(1, chunks // 3)).text(inbox)
        follow(live_moments(landed_points(stream, CHAIN_PARAMS)), kept, state).awaitTermination()

    land(lines.withColumn("value", cut))
    land(lines.where("third > 0"))
    return rounded(live_posterior(spark, kept, CHAIN_PARAMS))


put(running_chains, """WITH p AS (SELECT l_linenumber::VARCHAR AS chain, l_orderkey AS iter, sum(l_quantity) AS quantity, max(l_extendedprice) AS price, max(l_discount) - 0.05::DOUBLE AS discount FROM lineitem GROUP BY ALL)
  SELECT chain, param, count(*) AS n, max(iter) AS last_iter, round(avg(v), 6) AS mean, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END), 6) AS pp
  FROM (SELECT chain, iter, unnest(['quantity', 'price', 'discount']) AS param, unnest([quantity, price, discount]) AS v FROM p) GROUP BY chain, param""")


# Trees


@query("supplier nodes|closure", """SELECT a.s_name AS name1, b.s_name AS name2, max_by(x.ancestor, n.depth) AS lca FROM supplier a JOIN supplier b ON b.s_nationkey = a.s_nationkey AND b.s_suppkey > a.s_suppkey AND b.s_suppkey < a.s_suppkey + 50
  JOIN closure x ON x.descendant = 1000 + a.s_suppkey JOIN closure y ON y.descendant = 1000 + b.s_suppkey AND y.ancestor = x.ancestor JOIN nodes n ON n.node_id = x.ancestor GROUP BY ALL""")
def lca_by_name(s, n):
    """Suppliers of a nation less than 50 ids apart: they lie in one lot of 50 ids or in neighbouring ones, so only these meet."""
    lot = F.floor(F.col("s_suppkey") / 50)
    other = s.select("s_nationkey", F.col("s_suppkey").alias("k2"), F.col("s_name").alias("name2"), F.explode(F.array(lot, lot - 1)).alias("lot"))
    pairs = s.withColumn("lot", lot).join(other, ["s_nationkey", "lot"]).where("k2 > s_suppkey AND k2 < s_suppkey + 50").select(F.col("s_name").alias("name1"), "name2")
    return tr.lca_by_name(pairs, n)


@query("states nodes", "SELECT gene, site, 1000 + taxon AS node_id, count(*) AS n FROM states GROUP BY ALL")
def tree_alignment_rows(s, n):
    """Alignment rows with the leaf of their taxon; both sides are checked to be whole."""
    named = s.join(n.where("is_leaf").select((F.col("node_id") - 1000).alias("taxon"), "name"), "taxon").select("gene", "site", F.col("name").alias("taxon"))
    present = named.select("taxon").distinct()
    leaves = n.where("NOT is_leaf").union(n.where("is_leaf").join(present, F.col("name") == F.col("taxon"), "left_semi"))
    return tr.tree_alignment_join(leaves, named).groupBy("gene", "site", "node_id").agg(F.count(F.lit(1)).alias("n"))


@query("nodes", "SELECT node_id, (row_number() OVER (ORDER BY node_id) - 1)::INT AS cond FROM nodes WHERE parent_id IS NOT NULL")
def branch_conditions_all(n):
    """As many conditions as branches."""
    return tr.branch_condition_map(n, "branch_length", n.where("parent_id IS NOT NULL").count()).drop("tree")


@query("branch_suffstat nodes|closure", f"""WITH v AS (SELECT c.ancestor AS node_id, b.gene, sum(b.bsyn) AS value FROM branch_suffstat b JOIN closure c ON c.descendant = b.branch + 1000 GROUP BY ALL),
  q AS (SELECT node_id, {QUANTILE.format(q=0.025)} AS q0, {QUANTILE.format(q=0.5)} AS q1, {QUANTILE.format(q=0.975)} AS q2, round(avg(v), 6) AS mean FROM ({RANKED.format(k='node_id', v='value', t='v')}) x GROUP BY node_id)
  SELECT q.*, CASE WHEN n.is_leaf THEN n.name ELSE l.first_leaf || '-' || l.last_leaf END AS label FROM q JOIN nodes n ON n.node_id = q.node_id JOIN ({LABELS}) l ON l.node_id = q.node_id""")
def branch_summary(b, n):
    below = tr.jumps(n)
    own = b.select("gene", (F.col("branch") + 1000).alias("node_id"), F.col("bsyn").alias("value")).join(n.select("tree", "node_id"), "node_id")
    draws = tr.gathered(own, below, {"value": F.sum}, ["gene"]).drop("tree")
    return tr.branch_summary(draws, tr.clade_labels(n, below), n).select("node_id", "q0", "q1", "q2", "mean", "label")


@query("branch_suffstat ages", f"""WITH l AS (SELECT a.node_id, avg(p.age - a.age) AS m FROM ages a JOIN ages p ON p.node_id = a.parent_id AND p.iter = a.iter GROUP BY a.node_id)
  SELECT q.node_id, round(exp(q.m), 6) AS value, round(l.m, 6) AS mean_length FROM (SELECT branch + 1000 AS node_id, max(CASE WHEN k = floor(0.5::DOUBLE * n) THEN v END) AS m FROM ({RANKED.format(k='branch', v='bsyn', t='branch_suffstat')}) x GROUP BY branch) q LEFT JOIN l ON l.node_id = q.node_id""")
def node_medians_dated(b, a):
    """Branch lengths that differ by branch and by point, from node ages."""
    medians = po.posterior_quantiles(b.select((F.col("branch") + 1000).alias("node_id"), F.col("bsyn").alias("value")), ["node_id"], qs=(0.5,)).withColumnRenamed("q0", "median")
    point = a.withColumn("tree", F.concat_ws("-", "tree", "iter"))
    return tr.node_branch_medians(medians, tr.age_to_branch_length(point))


@query("nation_states nodes", """WITH e AS (SELECT node_id, parent_id, exp(-4.0::DOUBLE / 3.0 * coalesce(branch_length, 0)) AS e, name FROM nodes WHERE depth <= 2), b AS (SELECT unnest([0, 1, 2, 3]) AS b),
  s AS (SELECT DISTINCT gene, site FROM nation_states),
  up AS (SELECT gene, site, e.parent_id AS node_id, b.b, ln(e.e * (CASE WHEN state = b.b THEN 1.0 ELSE 0.0 END) + (1 - e.e) / 4) AS l FROM nation_states JOIN e ON e.name = nation_states.name, b),
  r AS (SELECT gene, site, node_id, b, exp(sum(l)) AS l FROM up GROUP BY ALL),
  up2 AS (SELECT gene, site, r.b, ln(e.e * l + (1 - e.e) / 4 * sum(l) OVER (PARTITION BY gene, site, r.node_id)) AS l FROM r JOIN e ON e.node_id = r.node_id)
  SELECT gene, site, round(ln(sum(0.25 * l)), 6) AS log_likelihood FROM (SELECT gene, site, b, exp(sum(l)) AS l FROM up2 GROUP BY ALL) x GROUP BY gene, site""")
def site_likelihood(s, n):
    """Pruning over the tree of nations, at equal rates; a nation without a known state at a site agrees with all."""
    tree = n.where("depth <= 2").withColumn("is_leaf", F.col("depth") == 2)
    s = staged(s)  # read twice
    genes = s.select("gene").distinct().select("gene", F.lit("tree").alias("tree"), F.lit(0).alias("set"))
    rates = s.sparkSession.range(16).selectExpr("0 AS set", "CAST(id DIV 4 AS INT) AS i", "CAST(id % 4 AS INT) AS j", "1 / 3D AS rate")
    freqs = s.sparkSession.range(4).selectExpr("0 AS set", "CAST(id AS INT) AS i", "0.25D AS freq")
    return pattern_likelihood(s, genes, tree, rates, freqs)


def _above(below: str) -> str:
    """SQL of (gene, site, node_id, b, l) one step up: what the nodes of a table send to their parents, and its product."""
    sent = f"SELECT gene, site, e.parent_id AS node_id, x.b, ln(e.e * l + (1 - e.e) * sum(pi.stat * l) OVER (PARTITION BY gene, site, x.node_id)) AS l FROM {below} x JOIN e ON e.node_id = x.node_id JOIN pi ON pi.\"set\" = x.gene % 5 AND pi.b = x.b"
    return f"SELECT gene, site, node_id, b, exp(sum(l)) AS l FROM ({sent}) GROUP BY ALL"


@query("bases nodes frequencies|codon stationary", f"""WITH k AS (SELECT gene, taxon, site, c.codon_id FROM bases b LEFT JOIN codon c ON c.codon = b.b1 || b.b2 || b.b3),
  pi AS (SELECT "set", codon_id AS b, stat FROM stationary JOIN codon ON codon.codon = stationary.codon), e AS (SELECT node_id, parent_id, exp(-coalesce(branch_length, 0)) AS e FROM nodes),
  leaf AS (SELECT k.gene, k.site, e.parent_id AS node_id, pi.b, exp(sum(ln(e.e * (CASE WHEN k.codon_id = pi.b THEN 1.0 ELSE 0.0 END) + (1 - e.e) * own.stat))) AS l
    FROM k JOIN e ON e.node_id = 1000 + k.taxon JOIN pi own ON own."set" = k.gene % 5 AND own.b = k.codon_id JOIN pi ON pi."set" = own."set" GROUP BY ALL),
  two AS ({_above("leaf")}), one AS ({_above("two")}), r AS (SELECT gene, site, ln(sum(stat * l)) AS x FROM one JOIN pi ON pi."set" = gene % 5 AND pi.b = one.b GROUP BY gene, site)
  SELECT s.gene, s.site, round(coalesce(x, 0), 6) AS log_likelihood FROM (SELECT DISTINCT gene, site FROM k) s LEFT JOIN r ON r.gene = s.gene AND r.site = s.site""")
def site_likelihood_codons(b, n, f):
    """Codon columns over the whole tree of suppliers, 61 states, with the frequencies of each gene's own set; codons change to another in proportion to its frequency."""
    codes = c.codon_table(b.sparkSession)
    leaf = n.where("is_leaf").select((F.col("node_id") - 1000).alias("taxon"), "name")
    rows = staged(coded(b).select("gene", "taxon", "site", "codon"))  # read twice
    states = rows.join(leaf, "taxon").join(codes.select("codon", F.col("codon_id").cast("int").alias("state")), "codon", "left").select("gene", "site", "name", "state")
    genes = rows.select("gene").distinct().select("gene", F.lit("tree").alias("tree"), (F.col("gene") % 5).cast("int").alias("set"))
    freqs = ra.codon_stationary(codes.select("codon", "aa"), f).join(codes.select("codon", "codon_id"), "codon").select(F.col("set").cast("int").alias("set"), F.col("codon_id").cast("int").alias("i"), F.col("stat").alias("freq"))
    rates = freqs.select("set", "i").join(freqs.select("set", F.col("i").alias("j"), F.col("freq").alias("rate")), "set")
    return pattern_likelihood(states, genes, n, rates, freqs)


# Sufficient statistics


def _scaled(p: DataFrame, b: DataFrame, r: DataFrame, f: DataFrame) -> DataFrame:
    return su.scaled_path(p.withColumnRenamed("t", "rel_time"), b, r, f)


@query("path branch_lengths site_rates path_flags", """SELECT p.branch, p.state, round(sum(p.t * b.branch_length * r.rate), 6) AS t FROM path p JOIN path_flags f ON f.gene = p.gene AND f.site = p.site AND f.branch = p.branch AND f.flag = 1
  JOIN branch_lengths b ON b.branch = p.branch JOIN site_rates r ON r.gene = p.gene AND r.site = p.site GROUP BY p.branch, p.state""")
def path_suffstat_informative(p, b, r, f):
    return su.path_suffstat(_scaled(p, b, r, f), ["branch"])[0]


ROOTS = "SELECT p.gene, p.state, count(*) AS n FROM (SELECT gene, site, branch, max_by(state, seg) AS state FROM path GROUP BY ALL) p JOIN path_flags f ON f.gene = p.gene AND f.site = p.site AND f.branch = p.branch AND f.flag = 2 GROUP BY p.gene, p.state"


@query("path path_flags", ROOTS)
def root_counts(p, f):
    return su.root_counts(p, f, ["gene"])


@query("path path_flags|codon", f"SELECT base, sum(n)::BIGINT AS n FROM (SELECT unnest(string_split(c.codon, '')) AS base, n FROM ({ROOTS}) r JOIN codon c ON c.codon_id = r.state) x GROUP BY base")
def nuc_root_counts(p, f):
    return su.nuc_root_counts(su.root_counts(p, f, ["gene"]), c.codon_table(p.sparkSession))


@query("path branch_lengths|near", f"""SELECT b.gene, b.site, round(b.beta, 6) AS beta, coalesce(n.n, 0)::BIGINT AS count FROM (SELECT gene, site, sum(t * branch_length * r) AS beta FROM path p JOIN branch_lengths l ON l.branch = p.branch
  JOIN (SELECT codon_id1, count(*)::DOUBLE AS r FROM near GROUP BY ALL) o ON o.codon_id1 = p.state GROUP BY gene, site) b LEFT JOIN (SELECT gene, site, count(*) AS n FROM {STEPS} WHERE to_state <> from_state GROUP BY gene, site) n ON n.gene = b.gene AND n.site = b.site""")
def length_suffstat_sites(p, b):
    out = near(p.sparkSession).where("position BETWEEN 0 AND 2").groupBy(F.col("codon_id1").alias("state")).agg(F.sum("rate").alias("out"))
    return su.length_suffstat(by_few(p, b, "branch"), out, ["gene", "site"], factor="branch_length")


@query("site_aa_trace", "SELECT cond, gene, round(sum(delta), 6) AS sum, round(sum(ln(delta)), 6) AS sum_log, count(*) AS n FROM site_aa_trace WHERE mask <> 0 AND delta > 0 GROUP BY cond, gene")
def gamma_suffstat_masked(t):
    return su.gamma_suffstat(t, ["cond", "gene"], "delta", where="mask")


SEEN = "(nsyn + nnonsyn) * ln(1.5) + nnonsyn * ln(0.4)"


@query("branch_suffstat", f"""SELECT gene, branch, round({SEEN} - 1.5 * (bsyn + bnonsyn * 0.4), 6) AS plain, round(5.0 * ln(5.0) - lgamma(5.0) - (5.0 + nsyn + nnonsyn) * ln(5.0 + 1.5 * (bsyn + bnonsyn * 0.4)) + lgamma(5.0 + nsyn + nnonsyn) + {SEEN}, 6) AS over_ds,
  round(5.0 * ln(5.0) - lgamma(5.0) - (5.0 + nnonsyn) * ln(5.0 + 1.5 * bnonsyn * 0.4) + lgamma(5.0 + nnonsyn) + {SEEN} - 1.5 * bsyn, 6) AS over_omega FROM branch_suffstat""")
def ds_omega_logprob(b):
    out = b
    for name, over in (("plain", None), ("over_ds", "ds"), ("over_omega", "omega")):
        out = su.ds_omega_logprob(out, F.lit(1.5), F.lit(0.4), 0.2, over).withColumnRenamed("logprob", name)
    return out.select("gene", "branch", "plain", "over_ds", "over_omega")


# Rates


@query("relrates frequencies|mg", 'SELECT "set", codon1, codon2, round(rate, 6) AS rate FROM mg UNION ALL SELECT "set", codon1, codon1, round(-sum(rate), 6) FROM mg GROUP BY "set", codon1')
def codon_rate_diagonal(r, f):
    rates = ra.mg_codon_rates(c.codon_neighbours(r.sparkSession), _nuc(r, f), 0.3)
    return ra.with_diagonal(rates, ["set"])


@query("relrates frequencies|mg", 'SELECT "set", codon1, 0.0::DOUBLE AS total FROM mg GROUP BY "set", codon1')
def codon_rate_check(r, f):
    rates = ra.with_diagonal(ra.mg_codon_rates(c.codon_neighbours(r.sparkSession), _nuc(r, f), 0.3), ["set"])
    return ra.checked_rows(rates, ["set"])


@query("frequencies fitness|stationary", 'SELECT s."set", f."key", codon, round(stat * fitness / sum(stat * fitness) OVER (PARTITION BY s."set", f."key"), 6) AS stat FROM stationary s JOIN fitness f ON f.aa = s.aa')
def mutsel_stationary(f, fit):
    return ra.mutsel_stationary(ra.codon_stationary(c.codon_table(f.sparkSession).select("codon", "aa"), f), fit).where("stat > 0")


@query("frequencies|stationary", 'SELECT codon, round(sum((1 + "set") / 15 * stat), 6) AS stat FROM stationary GROUP BY codon')
def mean_codon_stationary(f):
    weights = f.select("set").distinct().withColumn("w", (1 + F.col("set")) / 15)
    return ra.mean_codon_stationary(ra.codon_stationary(c.codon_table(f.sparkSession).select("codon", "aa"), f), weights)


@query("relrates frequencies|mg stationary", """WITH p AS (SELECT m."set", aa1, aa2, sum(s.stat * m.rate) / any_value(t.t) AS rate FROM mg m JOIN stationary s ON s."set" = m."set" AND s.codon = m.codon1
  JOIN (SELECT "set", aa, sum(stat) AS t FROM stationary GROUP BY ALL) t ON t."set" = m."set" AND t.aa = m.aa1 WHERE aa1 <> aa2 GROUP BY m."set", aa1, aa2) SELECT "set", aa1, aa2, round(rate, 6) AS rate FROM p UNION ALL SELECT "set", aa1, aa1, round(-sum(rate), 6) FROM p GROUP BY "set", aa1""")
def aa_rate_diagonal(r, f):
    spark = r.sparkSession
    rates = ra.aa_projected_rates(ra.mg_codon_rates(c.codon_neighbours(spark), _nuc(r, f), 0.3), ra.codon_stationary(c.codon_table(spark).select("codon", "aa"), f))
    return ra.with_diagonal(rates, ["set"], "aa1", "aa2")


@query("relrates frequencies fitness|mg stationary", f"""WITH {MUTSEL}, st AS (SELECT s."set", x."key", codon, stat * fitness / sum(stat * fitness) OVER (PARTITION BY s."set", x."key") AS stat FROM stationary s JOIN fitness x ON x.aa = s.aa),
  k AS (SELECT "key", sum(fitness) AS w FROM fitness GROUP BY "key"), ws AS (SELECT st."set", st."key", codon, (1 + st."set") / 15 * k.w / (SELECT sum(w) FROM k) * stat AS ws FROM st JOIN k ON k."key" = st."key" WHERE st."set" > 0)
  SELECT codon1, codon2, round(sum(ws * rate) / any_value(t.t), 6) AS rate FROM mutsel m JOIN ws ON ws."set" = m."set" AND ws."key" = m."key" AND ws.codon = m.codon1
  JOIN (SELECT codon, sum(ws) AS t FROM ws GROUP BY codon) t ON t.codon = m.codon1 GROUP BY codon1, codon2""")
def mean_grid_rates(r, f, fit):
    """Processes of sets by keys, weighted by both; the first row is added with the others and taken out again."""
    spark = r.sparkSession
    rates = ra.mutsel_rates(c.codon_neighbours(spark), _nuc(r, f), fit, 0.3)
    stationary = ra.mutsel_stationary(ra.codon_stationary(c.codon_table(spark).select("codon", "aa"), f), fit)
    rows = f.select("set").distinct().withColumn("w", (1 + F.col("set")) / 15)
    sums = fit.groupBy("key").agg(F.sum("fitness").alias("w"))
    columns = sums.join(F.broadcast(sums.agg(F.sum("w").alias("total"))), F.lit(True)).select("key", (F.col("w") / F.col("total")).alias("w"))
    whole = ra.grid_mixture(rates, stationary, rows, columns)
    return ra.mixture_rates(ra.add_mixtures(whole, ra.grid_mixture(rates, stationary, rows.where("set = 0"), columns), -1))
