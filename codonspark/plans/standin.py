"""Domain tables derived from the given tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codonspark.functions.codons import codon_rows

BASE = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events", "documents", "embeddings")
#: A total order of lineitem.
ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"

TABLES: dict[str, str] = {
    "gene_trace": f"SELECT l_partkey AS gene, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY {ORDER}) - 1 AS BIGINT) AS iter, (l_quantity - 25) / 7.3109e0 AS posw, l_extendedprice / 30011.7e0 AS posom FROM lineitem",
    "trace": "SELECT user_id AS param, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS iter, value / 7.3109e0 AS value FROM events",
    "site_trace": f"SELECT l_suppkey AS gene, l_partkey % 20 AS site, CAST(row_number() OVER (PARTITION BY l_suppkey, l_partkey % 20 ORDER BY {ORDER}) - 1 AS BIGINT) AS iter, (l_discount * 10 - 5) / 7.3109e0 AS value FROM lineitem",
    "condition_trace": "SELECT l_suppkey AS gene, l_linenumber % 3 AS cond, l_extendedprice AS omega, 1300 * l_quantity AS expected, CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS alloc FROM lineitem",
    "site_aa_trace": f"""SELECT cond, gene, site, aa, CAST(row_number() OVER (PARTITION BY cond, gene, site, aa ORDER BY {ORDER}) - 1 AS BIGINT) AS iter, toggle, mask, delta FROM
      (SELECT *, l_linenumber % 2 AS cond, l_suppkey % 20 AS gene, l_orderkey % 5 AS site, l_partkey % 20 AS aa, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS toggle,
        CASE WHEN l_discount > 0.03 THEN 1 ELSE 0 END AS mask, l_tax / 7.3109e0 AS delta FROM lineitem) x""",
    "bases": f"""SELECT l_partkey % 10 AS gene, l_suppkey AS taxon, l_partkey AS site, substr('ACGT', CAST(l_quantity AS INT) % 4 + 1, 1) AS b1, substr('ACGT', l_linenumber % 4 + 1, 1) AS b2,
      CASE WHEN l_tax < 0.01 THEN '-' ELSE substr('ACGT', CAST(l_orderkey % 4 AS INT) + 1, 1) END AS b3, l_discount FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY {ORDER}) AS k FROM lineitem) x WHERE k = 1""",
    "states": "SELECT gene, taxon, site, CASE WHEN l_discount >= 0.02 THEN instr('ACGT', b1) - 1 END AS state FROM bases",
    "wide": "SELECT doc_id % 20 AS gene, doc_id AS taxon, concat(seq, repeat('-', (3 - length(seq) % 3) % 3)) AS seq FROM (SELECT doc_id, translate(lower(coalesce(text, '')), 'bdefhijklmnopqrsuvwxyz .,!?|ß', 'cgtacgtacgtacgtacgtacg-------') AS seq FROM documents) x",
    "nodes": """SELECT 'tree' AS tree, 0 AS node_id, NULL AS parent_id, 'root' AS name, CAST(NULL AS DOUBLE) AS branch_length, false AS is_leaf, 0 AS depth
      UNION ALL SELECT 'tree', 1 + r_regionkey, 0, r_name, CAST(0.5 + r_regionkey * 0.125 AS DOUBLE), false, 1 FROM region
      UNION ALL SELECT 'tree', 100 + n_nationkey, 1 + n_regionkey, n_name, CAST(0.25 + n_nationkey * 0.0625 AS DOUBLE), false, 2 FROM nation
      UNION ALL SELECT 'tree', 1000 + s_suppkey, 100 + s_nationkey, s_name, CAST(0.125 + (s_suppkey % 7) * 0.25 AS DOUBLE), true, 3 FROM supplier""",
    "taxa": "SELECT s_name AS taxon FROM supplier WHERE s_acctbal >= 0",
    "branch_suffstat": """SELECT l_partkey % 25 AS gene, l_suppkey AS branch, CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS DOUBLE) AS nsyn,
      CAST(sum(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) AS DOUBLE) AS nnonsyn, sum(l_tax) / 7.3109e0 AS bsyn, sum(l_discount) / 7.3109e0 AS bnonsyn FROM lineitem GROUP BY l_partkey % 25, l_suppkey""",
    "path": f"""SELECT l_suppkey % 10 AS gene, l_orderkey AS site, l_suppkey % 5 AS branch, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 10, l_suppkey % 5 ORDER BY {ORDER}) AS seg,
      CAST(l_partkey % 61 AS INT) AS state, l_quantity / 50.0173e0 AS t FROM lineitem""",
    "cov": """SELECT vec_id AS draw, i, j, CASE WHEN i = j THEN x * y * 100 + 1 ELSE x * y * 100 END AS value FROM (
      SELECT vec_id, a.i, b.i AS j, CAST(CASE a.i WHEN 0 THEN {e0} WHEN 1 THEN {e1} ELSE {e2} END AS DOUBLE) AS x, CAST(CASE b.i WHEN 0 THEN {e0} WHEN 1 THEN {e1} ELSE {e2} END AS DOUBLE) AS y
      FROM embeddings, (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) a, (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) b) z""",
    "replicates": "SELECT CASE WHEN o_custkey % 2 = 0 THEN 'diversity' ELSE 'divergence' END AS stat, o_custkey AS rep, avg(o_totalprice) / 7.3109e0 AS value FROM orders GROUP BY CASE WHEN o_custkey % 2 = 0 THEN 'diversity' ELSE 'divergence' END, o_custkey",
    "observed": "SELECT stat, 0.9e0 * max(value) AS value FROM replicates GROUP BY stat",
    "alloc": "SELECT l_suppkey AS gene, l_partkey AS site, CAST(l_orderkey % 7 AS INT) AS component FROM lineitem",
    "component_weights": "SELECT CAST(r_regionkey * 2 AS INT) AS component, CAST(0.1 + r_regionkey * 0.05 AS DOUBLE) AS weight, CAST(1.5 + r_regionkey AS DOUBLE) AS value FROM region",
    "codeml": "SELECT p_partkey AS gene, p_retailprice / 100.0173e0 - 9 AS delta FROM part",
    "frequencies": """SELECT r_regionkey AS "set", base, w / sum(w) OVER (PARTITION BY r_regionkey) AS freq FROM (SELECT r_regionkey, base, CAST(1 + (r_regionkey * k + k) % 5 AS DOUBLE) AS w FROM region,
      (SELECT 'A' AS base, 1 AS k UNION ALL SELECT 'C', 2 UNION ALL SELECT 'G', 3 UNION ALL SELECT 'T', 4) b) x""",
    "relrates": """SELECT r_regionkey AS "set", a, b, CAST(1 + (r_regionkey + k) % 4 AS DOUBLE) AS r FROM region, (SELECT 'A' AS a, 'C' AS b, 1 AS k UNION ALL SELECT 'A', 'G', 2 UNION ALL SELECT 'A', 'T', 3
      UNION ALL SELECT 'C', 'G', 4 UNION ALL SELECT 'C', 'T', 5 UNION ALL SELECT 'G', 'T', 6) p""",
    "fitness": """SELECT l_suppkey AS "key", substr('ACDEFGHIKLMNPQRSTVWY', CAST(l_partkey % 20 AS INT) + 1, 1) AS aa, 0.01 + sum(l_quantity) / 500 AS fitness FROM lineitem GROUP BY l_suppkey, l_partkey % 20""",
    "deltas": """SELECT l_suppkey AS "key", l_linenumber % 3 AS cond, substr('ACDEFGHIKLMNPQRSTVWY', CAST(l_partkey % 20 AS INT) + 1, 1) AS aa, avg(l_discount) * 4.0173e0 - 0.2e0 AS delta FROM lineitem GROUP BY l_suppkey, l_linenumber % 3, l_partkey % 20""",
}
TABLES |= {
    "alignments": """SELECT concat('g', CAST(CAST(floor(doc_id / 50) AS BIGINT) AS STRING)) AS gene, concat('t', CAST(doc_id AS STRING)) AS taxon,
      concat(translate(md5(coalesce(text, '')), '0123456789abcdef', 'ACGTACGTACG-TACG'), 'A') AS seq FROM documents""",
    "chain_points": f"""SELECT chain, CAST(row_number() OVER (PARTITION BY chain ORDER BY {ORDER}) - 1 AS BIGINT) AS iter, l_quantity AS a, l_extendedprice AS b
      FROM (SELECT *, CAST(floor(l_suppkey / 10) AS BIGINT) AS chain FROM lineitem) x""",
    "gene_catalog": "SELECT concat('s', CAST(s_suppkey AS STRING)) AS gene, CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INT) AS ordinal, CAST(1 + s_suppkey % 3 AS INT) AS nsite FROM supplier",
    "draws": """SELECT iter, gene, ordinal, nsite, coalesce(v, 0) AS v FROM (SELECT DISTINCT l_linenumber - 1 AS iter FROM lineitem) i CROSS JOIN (SELECT * FROM gene_catalog) c
      LEFT JOIN (SELECT l_linenumber - 1 AS it, concat('s', CAST(l_suppkey AS STRING)) AS g, avg(l_tax) * 10 AS v FROM lineitem GROUP BY l_linenumber, l_suppkey) d ON d.it = i.iter AND d.g = c.gene""",
    "forest": """SELECT tree, 0 AS node_id, CAST(NULL AS BIGINT) AS parent_id, 0 AS child_rank, concat('r', CAST(tree AS STRING)) AS name, CAST(NULL AS DOUBLE) AS branch_length, false AS is_leaf, 0 AS depth
        FROM (SELECT DISTINCT CAST(floor(c_custkey / 100) AS BIGINT) AS tree FROM customer) a
      UNION ALL SELECT tree, 1 + c_nationkey, 0, c_nationkey, concat('n', CAST(c_nationkey AS STRING)), CAST(0.25 * (1 + c_nationkey) AS DOUBLE), false, 1
        FROM (SELECT DISTINCT CAST(floor(c_custkey / 100) AS BIGINT) AS tree, c_nationkey FROM customer) b
      UNION ALL SELECT CAST(floor(c_custkey / 100) AS BIGINT), 1000 + c_custkey, 1 + c_nationkey, c_custkey, c_name, CAST(0.5 + c_custkey % 9 AS DOUBLE), true, 2 FROM customer""",
    "ages": "SELECT tree, node_id, parent_id, iter, CAST(20 - 5 * depth - 0.125 * (iter + node_id % 3) AS DOUBLE) AS age FROM nodes CROSS JOIN (SELECT DISTINCT l_linenumber AS iter FROM lineitem) i",
    "site_rates": "SELECT l_suppkey % 10 AS gene, l_orderkey AS site, 0.5e0 + avg(l_discount) AS rate FROM lineitem GROUP BY l_suppkey % 10, l_orderkey",
    "branch_lengths": "SELECT DISTINCT l_suppkey % 5 AS branch, CAST(0.5 + l_suppkey % 5 AS DOUBLE) AS branch_length FROM lineitem",
    "path_flags": "SELECT l_suppkey % 10 AS gene, l_orderkey AS site, l_suppkey % 5 AS branch, CASE WHEN max(l_quantity) > 45 THEN 2 WHEN max(l_quantity) > 10 THEN 1 ELSE 0 END AS flag FROM lineitem GROUP BY l_suppkey % 10, l_orderkey, l_suppkey % 5",
    "nation_states": """SELECT gene, site, n_name AS name, CAST(min(state) AS INT) AS state FROM states JOIN (SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey) s ON s_suppkey = taxon
      WHERE state IS NOT NULL GROUP BY gene, site, n_name""",
}
NEEDS = {"draws": ("gene_catalog",), "ages": ("nodes",), "nation_states": ("bases", "states"), "states": ("bases",), "observed": ("replicates",)}


def _chain(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        out += [x for x in (*_chain(NEEDS.get(n, ())), n) if x not in out]
    return out


def _text(name: str, spark: bool) -> str:
    first = 0 if spark else 1
    sql = TABLES[name].replace("{e0}", f"embedding[{first}]").replace("{e1}", f"embedding[{first + 1}]").replace("{e2}", f"embedding[{first + 2}]")
    return sql.replace('"', "`") if spark else sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    own = [f"{b} AS (SELECT * FROM parquet.`{sf_dir}/{b}.parquet`)" for b in BASE if any(b in TABLES[n] for n in _chain((name,)))]
    return spark.sql(f"WITH {', '.join([*own, *(f'{n} AS ({_text(n, True)})' for n in _chain((name,)))])} SELECT * FROM {name}")


_CODON = "codon(codon, codon_id, aa, aa_id) AS (VALUES " + ", ".join(f"('{c}', {i}, '{a}', {k})" for c, i, a, k in codon_rows()) + ")"
_EXTRA = {
    "codon": _CODON,
    "codons": "codons AS (SELECT gene, taxon, site, c.codon, c.aa, c.codon_id FROM bases b LEFT JOIN codon c ON c.codon = b.b1 || b.b2 || b.b3)",
    "near": """near AS (SELECT x.codon AS codon1, y.codon AS codon2, x.codon_id AS codon_id1, y.codon_id AS codon_id2, x.aa AS aa1, y.aa AS aa2, x.aa = y.aa AS synonymous,
      CASE WHEN x.codon[1] <> y.codon[1] THEN 1 WHEN x.codon[2] <> y.codon[2] THEN 2 ELSE 3 END AS k, x.codon[k] AS from_base, y.codon[k] AS to_base,
      from_base || to_base IN ('AT', 'TA', 'CG', 'GC') AS gc_conservative
      FROM codon x, codon y WHERE (x.codon[1] <> y.codon[1])::INT + (x.codon[2] <> y.codon[2])::INT + (x.codon[3] <> y.codon[3])::INT = 1)""",
    "closure": """closure AS (SELECT tree, node_id AS ancestor, node_id AS descendant, 0 AS steps, 0.0 AS distance FROM nodes
      UNION ALL SELECT a.tree, a.parent_id, a.node_id, 1, a.branch_length FROM nodes a WHERE a.parent_id IS NOT NULL
      UNION ALL SELECT a.tree, b.parent_id, a.node_id, 2, a.branch_length + b.branch_length FROM nodes a JOIN nodes b ON b.node_id = a.parent_id WHERE b.parent_id IS NOT NULL
      UNION ALL SELECT a.tree, c.parent_id, a.node_id, 3, a.branch_length + b.branch_length + c.branch_length FROM nodes a JOIN nodes b ON b.node_id = a.parent_id JOIN nodes c ON c.node_id = b.parent_id WHERE c.parent_id IS NOT NULL)""",
    "nuc": """nuc AS (WITH o AS (SELECT r."set", r.a, r.b, r.r * f.freq AS rate FROM (SELECT * FROM relrates UNION ALL SELECT "set", b, a, r FROM relrates) r JOIN frequencies f ON f."set" = r."set" AND f.base = r.b) SELECT * FROM o)""",
    "stationary": """stationary AS (SELECT "set", codon, aa, x / sum(x) OVER (PARTITION BY "set") AS stat FROM (SELECT f."set", c.codon, c.aa, f.freq * g.freq * h.freq AS x FROM codon c
      JOIN frequencies f ON f.base = c.codon[1] JOIN frequencies g ON g."set" = f."set" AND g.base = c.codon[2] JOIN frequencies h ON h."set" = f."set" AND h.base = c.codon[3]) z)""",
    "mg": """mg AS (SELECT n."set", k.codon1, k.codon2, k.aa1, k.aa2, k.synonymous, n.rate * CASE WHEN k.synonymous THEN 1.0 ELSE 0.3 END AS rate, n.rate AS mutation FROM near k JOIN nuc n ON n.a = k.from_base AND n.b = k.to_base)""",
}
_EXTRA_NEEDS = {"codons": ("bases", "codon"), "near": ("codon",), "closure": ("nodes",), "nuc": ("relrates", "frequencies"), "stationary": ("codon", "frequencies"), "mg": ("near", "nuc")}


def oracle(names: str, body: str) -> str:
    """body after WITH the derived tables it names."""
    done: list[str] = []
    parts: list[str] = []

    def add(n: str) -> None:
        if n in done or n in BASE:
            return
        for x in (*NEEDS.get(n, ()), *_EXTRA_NEEDS.get(n, ())):
            add(x)
        done.append(n)
        parts.append(_EXTRA[n] if n in _EXTRA else f"{n} AS ({_text(n, False)})")

    for n in names.split():
        add(n)
    if parts and body.startswith("WITH "):
        return f"WITH {', '.join(parts)}, {body[5:]}"
    return f"WITH {', '.join(parts)} {body}" if parts else body
