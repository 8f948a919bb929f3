"""All queries of the library with their SQL, by name. Floating results are rounded to six places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonspark.functions import codons as c
from codonspark.operators import alignment as al
from codonspark.operators import posterior as po
from codonspark.operators import rates as ra
from codonspark.operators import suffstat as su
from codonspark.operators import trees as tr
from codonspark.plans.standin import oracle, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, never minus zero."""
    return df.select(*[(F.round(F.col(f"`{n}`"), 6) + 0.0).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def query(names: str, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], None]:
    """Register a function of the named tables; sql reads the same tables and `needs` beside them."""

    def named(f: Callable[..., DataFrame]) -> None:
        own, _, more = names.partition("|")
        _QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(*[table(spark, sf_dir, n) for n in own.split()]))
        if sql:
            _SQL[f.__name__] = oracle(f"{own} {more}", sql)

    return named


def put(f: Query, sql: str) -> None:
    """Register a function of the session and the folder with its SQL over the given tables."""
    _QUERIES[f.__name__], _SQL[f.__name__] = f, sql


def coded(bases: DataFrame) -> DataFrame:
    """bases to (gene, taxon, site, codon, codon_id, aa)."""
    known = bases.select("gene", "taxon", "site", c.codon_of(F.col("b1"), F.col("b2"), F.col("b3")).alias("codon"))
    return al.translate(known).withColumn("codon", F.when(F.col("aa").isNotNull(), F.col("codon")))


def near(spark: SparkSession) -> DataFrame:
    return c.codon_neighbours(spark).withColumn("rate", F.lit(1.0))


# Posterior summaries

FDR = "row_number() OVER (ORDER BY pp DESC, {t}) AS rank, round(avg(pp) OVER (ORDER BY pp DESC, {t} ROWS UNBOUNDED PRECEDING), 6) AS mean_pp, round(1 - avg(pp) OVER (ORDER BY pp DESC, {t} ROWS UNBOUNDED PRECEDING), 6) AS fdr"
GENE_PP = "SELECT gene, avg(CASE WHEN posw > 0 THEN 1.0 ELSE 0.0 END) AS pp, avg(posw) AS mean_posw, avg(posom) AS mean_posom FROM gene_trace WHERE iter >= 5 GROUP BY gene"


def after(trace: DataFrame, n: int = 5) -> DataFrame:
    return po.sample_window(trace, n, 1, 1 << 40)


@query("gene_trace", f"SELECT gene, round(pp, 6) AS pp, round(mean_posw, 6) AS mean_posw, round(mean_posom, 6) AS mean_posom, {FDR.format(t='gene')} FROM ({GENE_PP}) x")
def gene_fdr_ranking(t):
    return po.fdr_ranking(po.gene_positive_prob(after(t)), "gene")


@query("gene_trace", f"SELECT gene, round(pp, 6) AS pp, round(mean_posw, 6) AS mean_posw, round(mean_posom, 6) AS mean_posom FROM ({GENE_PP}) x")
def gene_positive_prob(t):
    return po.gene_positive_prob(after(t))


@query("gene_trace", """SELECT gene, round(pp, 6) AS pp, round(mean_omega, 6) AS mean_omega, row_number() OVER (ORDER BY round(mean_omega, 9) DESC, gene) AS rank FROM
  (SELECT gene, avg(CASE WHEN posom > 1 THEN 1.0 ELSE 0.0 END) AS pp, avg(posom) AS mean_omega FROM gene_trace GROUP BY gene) x""")
def gene_omega_prob(t):
    return po.ranked(t.groupBy("gene").agg(po.share(F.col("posom") > 1.0).alias("pp"), F.avg("posom").alias("mean_omega")), F.round("mean_omega", 9).desc(), "gene")


@query("gene_trace", """SELECT g.gene, g.iter, round(posw, 6) AS posw, round(posom, 6) AS posom FROM gene_trace g JOIN (SELECT gene, max(iter) + 1 AS n FROM gene_trace GROUP BY gene) s ON s.gene = g.gene
  WHERE iter >= n // 10 AND (iter - n // 10) % 3 = 0 AND (iter - n // 10) // 3 < (least(n, 20) - n // 10) // 3""")
def sample_window(t):
    return po.sample_window(t, -1, 3, 20, ["gene"])


@query("trace", "SELECT param, avg(value) AS mean FROM trace WHERE iter >= 5 GROUP BY param".replace("avg(value)", "round(avg(value), 6)"))
def posterior_mean(t):
    return after(t).groupBy("param").agg(F.avg("value").alias("mean"))


@query("trace", "SELECT param, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM trace WHERE iter >= 5 GROUP BY param")
def posterior_mean_sd(t):
    return po.posterior_mean_sd(after(t), ["param"])


QUANTILE = "round(max(CASE WHEN k = floor({q}::DOUBLE * n) THEN v END), 6)"
RANKED = "SELECT {k}, {v} AS v, row_number() OVER (PARTITION BY {k} ORDER BY {v}) - 1 AS k, count(*) OVER (PARTITION BY {k}) AS n FROM {t}"


@query("trace", f"SELECT param, {QUANTILE.format(q=0.025)} AS q0, {QUANTILE.format(q=0.5)} AS q1, {QUANTILE.format(q=0.975)} AS q2 FROM ({RANKED.format(k='param', v='value', t='trace')}) x GROUP BY param")
def posterior_quantiles(t):
    return po.posterior_quantiles(t, ["param"])


@query("trace", f"SELECT param, round(avg(v), 6) AS mean, {QUANTILE.format(q=0.025)} AS low, {QUANTILE.format(q=0.975)} AS high FROM ({RANKED.format(k='param', v='value', t='trace')}) x GROUP BY param")
def hyperparam_summary(t):
    return po.hyperparam_summary(t, ["param"], split=True)


@query("gene_trace", f"""SELECT a.gene, round(pp, 6) AS pp, round(mean_posw, 6) AS mean_posw, round(mean_posom, 6) AS mean_posom, low, high FROM ({GENE_PP}) a JOIN
  (SELECT gene, {QUANTILE.format(q=0.025)} AS low, {QUANTILE.format(q=0.975)} AS high FROM ({RANKED.format(k='gene', v='posom', t='gene_trace WHERE iter >= 5')}) x GROUP BY gene) b ON a.gene = b.gene""")
def gene_post_analysis(t):
    return po.gene_post_analysis(after(t))


SITE_PP = "SELECT gene, site, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) AS pp FROM site_trace GROUP BY gene, site"


@query("site_trace", f"SELECT gene, site, round(pp, 6) AS pp, {FDR.format(t='gene, site')} FROM ({SITE_PP}) x")
def site_positive_prob(t):
    return po.site_positive_prob(t)


@query("site_trace", "SELECT gene, site, round(avg(value), 6) AS pp FROM site_trace GROUP BY gene, site")
def site_mean_pp(t):
    return po.site_mean_pp(t)


@query("gene_trace site_trace codeml", f"""SELECT x.gene, round(pp, 6) AS pp, round(mean_posw, 6) AS mean_posw, round(mean_posom, 6) AS mean_posom, {FDR.format(t='x.gene')}, coalesce(s.n_sites, 0) AS n_sites, s.sites, round(c.delta, 6) AS delta
  FROM ({GENE_PP}) x LEFT JOIN (SELECT gene, count(*) AS n_sites, string_agg((site + 1)::VARCHAR, ',' ORDER BY site) AS sites FROM (SELECT gene, site, avg(value) AS pp FROM site_trace GROUP BY gene, site) WHERE round(pp, 9) > 0.4 GROUP BY gene) s ON s.gene = x.gene
  LEFT JOIN codeml c ON c.gene = x.gene""")
def gene_site_report(genes, sites, external):
    pp = po.site_mean_pp(sites).withColumn("pp", F.round("pp", 9))
    return po.gene_site_report(po.gene_positive_prob(after(genes)), pp, external, 0.4)


@query("gene_trace codeml", "SELECT g.gene, g.n, round(c.delta, 6) AS delta FROM (SELECT gene, count(*) AS n FROM gene_trace GROUP BY gene) g LEFT JOIN codeml c ON c.gene = g.gene")
def join_codeml(t, external):
    return t.groupBy("gene").agg(F.count(F.lit(1)).alias("n")).join(external, "gene", "left")


@query("codeml", "SELECT gene, round(delta, 6) AS delta, row_number() OVER (ORDER BY delta DESC, gene) AS rank FROM codeml")
def codeml_delta_ranking(t):
    return po.codeml_delta_ranking(t)


SHIFT = "SELECT cond, gene, site, avg(CASE WHEN o > 0 THEN 1.0 ELSE 0.0 END) AS pp FROM (SELECT cond, gene, site, iter, max(toggle) AS o FROM site_aa_trace GROUP BY ALL) GROUP BY ALL"


@query("site_aa_trace", f"SELECT cond, gene, site, round(pp, 6) AS pp FROM ({SHIFT}) x")
def site_shift_prob(t):
    return po.site_shift_prob(t)


@query("site_aa_trace", "SELECT cond, gene, site, aa, round(avg(CASE WHEN toggle > 0 THEN 1.0 ELSE 0.0 END), 6) AS pp FROM site_aa_trace GROUP BY ALL")
def aa_shift_prob(t):
    return po.aa_shift_prob(t)


@query("site_aa_trace", f"""SELECT x.cond, x.gene, x.site, round(x.pp, 6) AS pp, {FDR.format(t='cond, gene, site')}, {', '.join(f'a.aa{i}' for i in range(20))} FROM ({SHIFT}) x JOIN
  (SELECT cond, gene, site, {', '.join(f'round(coalesce(avg(CASE WHEN aa = {i} THEN CASE WHEN toggle > 0 THEN 1.0 ELSE 0.0 END END), 0), 6) AS aa{i}' for i in range(20))} FROM site_aa_trace GROUP BY ALL) a USING (cond, gene, site) WHERE pp > 0.9""")
def site_shift_fdr(t):
    return po.site_shift_fdr(t, 0.9)


@query("site_trace", f"SELECT gene, {', '.join(f'count(*) FILTER (WHERE least(floor(pp * 4), 3) = {i}) AS bin{i}' for i in range(4))} FROM ({SITE_PP}) x GROUP BY gene")
def gene_shift_histogram(t):
    return po.gene_shift_histogram(t.groupBy("gene", "site").agg(po.share(F.col("value") > 0).alias("pp")))


@query("site_aa_trace", """SELECT cond, gene, site, aa, round(avg(CASE WHEN mask = 1 AND active >= 2 AND toggle = 1 THEN 1.0 ELSE 0.0 END), 6) AS pp FROM
  (SELECT *, sum(mask) OVER (PARTITION BY cond, gene, site, iter) AS active FROM site_aa_trace) x GROUP BY cond, gene, site, aa""")
def masked_shift_prob(t):
    return po.masked_shift_prob(t)


@query("site_aa_trace", """SELECT * FROM (SELECT cond, gene, site, aa, round(avg(CASE WHEN d > 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS pp, round(avg(d), 6) + 0.0 AS mean_effect FROM
  (SELECT *, delta - avg(delta) OVER (PARTITION BY cond, gene, site, iter) AS d FROM site_aa_trace) x GROUP BY cond, gene, site, aa) WHERE pp > 0.6 OR 1 - pp > 0.6""")
def centered_effect_prob(t):
    return po.centered_effect_prob(t, 0.6)


CONDITION = "SELECT gene, cond, avg(ln(omega / expected)) AS mean_effect, avg(CASE WHEN omega > expected THEN 1.0 ELSE 0.0 END) AS pp FROM condition_trace GROUP BY gene, cond"


@query("condition_trace", f"WITH x AS ({CONDITION}) SELECT gene, cond, round(mean_effect, 6) AS mean_effect, round(pp, 6) AS pp FROM x WHERE gene IN (SELECT gene FROM x WHERE pp > 0.7 OR pp < 1 - 0.7)".replace("0.7", "0.63"))
def condition_effects(t):
    return po.condition_effects(t, 0.63)


@query("condition_trace", "SELECT gene, cond, round(avg(CASE WHEN alloc = 2 THEN 1.0 ELSE 0.0 END), 6) AS pp_positive, round(avg(CASE WHEN alloc = 0 THEN 1.0 ELSE 0.0 END), 6) AS pp_negative FROM condition_trace GROUP BY gene, cond")
def sparse_condition_effects(t):
    return po.sparse_condition_effects(t)


@query("cov", """SELECT c.i, c.j, round(avg(c.value), 6) AS mean, round(var_pop(c.value), 6) AS var, round(avg(CASE WHEN c.value > 0 THEN 1.0 ELSE 0.0 END), 6) AS pp, round(avg(c.value / sqrt(a.value * b.value)), 6) AS r,
  round(avg((c.value / sqrt(a.value * b.value)) * (c.value / sqrt(a.value * b.value))), 6) AS r2 FROM cov c JOIN cov a ON a.draw = c.draw AND a.i = c.i AND a.j = c.i JOIN cov b ON b.draw = c.draw AND b.i = c.j AND b.j = c.j GROUP BY c.i, c.j""")
def covariance_summary(t):
    return po.covariance_summary(t)


#: Inverse of a 3 x 3 matrix by cofactors.
INV = """p AS (SELECT draw, max(value) FILTER (WHERE i = 0 AND j = 0) AS a, max(value) FILTER (WHERE i = 0 AND j = 1) AS b, max(value) FILTER (WHERE i = 0 AND j = 2) AS c, max(value) FILTER (WHERE i = 1 AND j = 1) AS d,
  max(value) FILTER (WHERE i = 1 AND j = 2) AS e, max(value) FILTER (WHERE i = 2 AND j = 2) AS f FROM cov GROUP BY draw), q AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM p),
inv AS (SELECT draw, 0 AS i, 0 AS j, (d * f - e * e) / det AS value FROM q UNION ALL SELECT draw, 0, 1, (c * e - b * f) / det FROM q UNION ALL SELECT draw, 0, 2, (b * e - c * d) / det FROM q
  UNION ALL SELECT draw, 1, 0, (c * e - b * f) / det FROM q UNION ALL SELECT draw, 1, 1, (a * f - c * c) / det FROM q UNION ALL SELECT draw, 1, 2, (b * c - a * e) / det FROM q
  UNION ALL SELECT draw, 2, 0, (b * e - c * d) / det FROM q UNION ALL SELECT draw, 2, 1, (b * c - a * e) / det FROM q UNION ALL SELECT draw, 2, 2, (a * d - b * b) / det FROM q)"""


@query("cov", f"""WITH {INV} SELECT c.i, c.j, round(avg(c.value), 6) AS mean, round(var_pop(c.value), 6) AS var, round(avg(CASE WHEN c.value < 0 THEN 1.0 ELSE 0.0 END), 6) AS pp,
  round(avg(CASE WHEN c.i = c.j THEN 1.0 ELSE -c.value / sqrt(a.value * b.value) END), 6) AS r, round(avg(CASE WHEN c.i = c.j THEN 1.0 ELSE c.value * c.value / (a.value * b.value) END), 6) AS r2
  FROM inv c JOIN inv a ON a.draw = c.draw AND a.i = c.i AND a.j = c.i JOIN inv b ON b.draw = c.draw AND b.i = c.j AND b.j = c.j GROUP BY c.i, c.j""")
def precision_summary(t):
    return po.precision_summary(po.inverse(t, 3))


@query("cov", f"WITH {INV} SELECT c.i, round(avg(1 - 1 / (c.value * v.value)), 6) AS explained FROM cov c JOIN inv v ON v.draw = c.draw AND v.i = c.i AND v.j = c.j WHERE c.i = c.j GROUP BY c.i")
def explained_variance(t):
    return po.explained_variance(t, po.inverse(t, 3))


@query("cov", """WITH s AS (SELECT c.draw, c.i, c.j, (b.value - a.value + sqrt((b.value - a.value) * (b.value - a.value) + 4 * c.value * c.value)) / (2 * c.value) AS major, c.value / a.value AS regression
  FROM cov c JOIN cov a ON a.draw = c.draw AND a.i = c.i AND a.j = c.i JOIN cov b ON b.draw = c.draw AND b.i = c.j AND b.j = c.j WHERE c.i < c.j),
l AS (SELECT i, j, 'major' AS slope, major AS v FROM s UNION ALL SELECT i, j, 'regression', regression FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY i, j, slope ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY i, j, slope) AS n FROM l)
SELECT i, j, slope, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(max(CASE WHEN k = floor(0.025::DOUBLE * n) THEN v END), 6) AS low, round(max(CASE WHEN k = n - 1 - floor(0.025::DOUBLE * n) THEN v END), 6) AS high FROM o GROUP BY i, j, slope""")
def slope_summary(t):
    return po.slope_summary(t)


PREDICTIVE = """SELECT r.stat, round(any_value(o.value), 6) AS obs, round(avg(r.value), 6) AS mean, round(stddev_pop(r.value), 6) AS sd, round({pp}, 6) AS pp, round(({z}) / stddev_pop(r.value), 6) AS z
  FROM replicates r JOIN observed o ON o.stat = r.stat GROUP BY r.stat"""


@query("replicates observed", PREDICTIVE.format(pp="avg(CASE WHEN r.value > o.value THEN 1.0 ELSE 0.0 END)", z="any_value(o.value) - avg(r.value)"))
def posterior_predictive(r, o):
    return po.posterior_predictive(r, o)


@query("replicates observed", PREDICTIVE.format(pp="avg(CASE WHEN r.stat = 'diversity' AND r.value < o.value OR r.stat <> 'diversity' AND r.value > o.value THEN 1.0 ELSE 0.0 END)", z="avg(r.value) - any_value(o.value)"))
def posterior_predictive_alt(r, o):
    return po.posterior_predictive_alt(r, o)


# Moments


@query("gene_trace", "SELECT iter, round(avg(posom), 6) AS mean, round(var_pop(posom), 6) AS var FROM gene_trace GROUP BY iter")
def array_moments(t):
    return po.array_moments(t, ["iter"], "posom")


@query("gene_trace", "SELECT iter, round(avg(ln(posom)), 6) AS mean, round(var_pop(ln(posom)), 6) AS var FROM gene_trace WHERE posom > 0 GROUP BY iter")
def log_moments(t):
    return po.log_moments(t, ["iter"], "posom")


@query("gene_trace", "SELECT gene, count(*) FILTER (WHERE posw = 0) AS n_zero, round(coalesce(avg(posw) FILTER (WHERE posw <> 0), 0), 6) AS mean_nonzero FROM gene_trace GROUP BY gene")
def zero_inflated_summary(t):
    return po.zero_inflated_summary(t, ["gene"], "posw")


@query("gene_trace", "SELECT iter, round(avg(CASE WHEN posom > 1 THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM gene_trace GROUP BY iter")
def positive_fraction(t):
    return po.positive_fraction(t, ["iter"], "posom")


@query("frequencies", """SELECT "set", round(sum(CASE WHEN freq >= 1e-6 THEN -freq * ln(freq) ELSE 0 END), 6) AS mean_entropy FROM frequencies GROUP BY "set" """)
def mean_entropy(t):
    return po.mean_entropy(t.withColumnRenamed("freq", "p"), ["set"], [])


@query("fitness", "SELECT aa, round(avg(fitness), 6) AS mean, round(var_pop(fitness), 6) AS var FROM fitness GROUP BY aa")
def component_moments(t):
    return po.array_moments(t, ["aa"], "fitness")


@query("branch_suffstat", "SELECT round(sum(m), 6) AS length, round(sum(v) / max(g), 6) AS var, 0 AS iter FROM (SELECT branch, avg(bsyn) AS m, var_pop(bsyn) AS v, count(*) AS g FROM branch_suffstat GROUP BY branch) x")
def multi_gene_length(t):
    return po.multi_gene_length(t.select(F.lit(0).alias("iter"), "branch", F.col("bsyn").alias("value")))


@query("site_aa_trace", """SELECT cond, round(avg(v), 6) AS mean_var, round(avg(v / (m * m)) FILTER (WHERE m <> 0), 6) AS mean_relvar FROM (SELECT cond, gene, site, var_pop(delta) AS v, avg(delta) AS m FROM site_aa_trace GROUP BY ALL) x GROUP BY cond""")
def profile_variance(t):
    return po.profile_variance(t.withColumnRenamed("delta", "value"))


@query("site_aa_trace", "SELECT cond, round(avg(w), 6) AS width FROM (SELECT cond, gene, site, iter, sum(mask) AS w FROM site_aa_trace GROUP BY ALL) x GROUP BY cond")
def mask_width(t):
    return po.mask_width(t)


@query("alloc component_weights", "SELECT w.component, coalesce(n, 0) AS n, round(coalesce(n, 0) * ln(weight), 6) + 0.0 AS log_weight FROM component_weights w LEFT JOIN (SELECT component, count(*) AS n FROM alloc GROUP BY component) a ON a.component = w.component")
def occupancy(a, w):
    return po.occupancy(a, w)


@query("alloc component_weights", "SELECT gene, round(avg(value), 6) AS mean FROM alloc a JOIN component_weights w ON a.component = w.component GROUP BY gene")
def occupancy_weighted_mean(a, w):
    return po.occupancy_weighted_mean(a, w)


# Alignments


@query("wide", "SELECT gene, CASE WHEN bool_and(NOT regexp_matches(seq, '(?i)[^ACGTBDHKMNRSVWYX$.?*-]')) THEN 'dna' WHEN bool_and(NOT regexp_matches(seq, '(?i)[^ACGUBDHKMNRSVWYX$.?*-]')) THEN 'rna' WHEN bool_and(NOT regexp_matches(seq, '(?i)[^ACDEFGHIKLMNPQRSTVWYBZX$.?*-]')) THEN 'protein' END AS kind FROM wide GROUP BY gene")
def detect_alphabet(w):
    return al.detect_alphabet(w)


CLEAN = "regexp_replace(upper(seq), '[^ACGTN-]', '-', 'g')"


def clean(w: DataFrame) -> DataFrame:
    return w.withColumn("seq", F.regexp_replace(F.upper("seq"), "[^ACGTN-]", "-"))


@query("wide", f"SELECT gene, state, count(*) AS n FROM (SELECT gene, CASE WHEN s IN ('A', 'C', 'G', 'T') THEN instr('ACGT', s) - 1 END AS state FROM (SELECT gene, unnest(string_split({CLEAN}, '')) AS s FROM wide)) GROUP BY gene, state".replace("instr('ACGT', s) - 1", "(instr('ACGT', s) - 1)::INT"))
def encode_states(w):
    return al.encode_states(clean(w)).groupBy("gene", "state").agg(F.count(F.lit(1)).alias("n"))


@query("states", "SELECT gene, taxon, site, coalesce(substr('ACGT', state::INT + 1, 1), '-') AS symbol FROM states")
def decode_states(s):
    return al.decode_states(s.withColumn("state", F.col("state").cast("int"))).select("gene", "taxon", "site", "symbol")


@query("wide|codon", f"""SELECT gene, t.site % 50 AS site, count(*) AS n, count(c.codon) AS n_codons, count(DISTINCT c.aa) AS n_aa FROM
  (SELECT gene, i AS site, substr(s, 3 * i + 1, 3) AS triplet FROM (SELECT gene, s, unnest(range(0, length(s) // 3)) AS i FROM (SELECT gene, {CLEAN} AS s FROM wide) x) y) t LEFT JOIN codon c ON c.codon = t.triplet GROUP BY gene, t.site % 50""")
def make_codons(w):
    return al.make_codons(clean(w)).groupBy("gene", (F.col("site") % 50).alias("site")).agg(F.count(F.lit(1)).alias("n"), F.count("codon").alias("n_codons"), F.count_distinct("aa").alias("n_aa"))


@query("wide", f"SELECT gene, taxon, i + 1 AS codon_number, 3 * i + 1 AS first_nucleotide, triplet FROM (SELECT gene, taxon, i, substr(s, 3 * i + 1, 3) AS triplet FROM (SELECT gene, taxon, s, unnest(range(0, length(s) // 3)) AS i FROM (SELECT gene, taxon, {CLEAN} AS s FROM wide) x) y) z WHERE triplet IN ('TAA', 'TAG', 'TGA')")
def report_stops(w):
    return al.report_stops(al.make_codons(clean(w)))


@query("bases|codons", "SELECT gene, taxon, site, codon, codon_id, aa FROM codons")
def translate(b):
    return coded(b).select("gene", "taxon", "site", "codon", "codon_id", "aa")


@query("bases", "SELECT gene, taxon, site, b1 || b2 || b3 IN ('TAA', 'TAG', 'TGA') AS is_stop FROM bases")
def is_stop(b):
    return b.select("gene", "taxon", "site", al.is_stop(F.col("b1"), F.col("b2"), F.col("b3")).alias("is_stop"))


@query("states", "SELECT gene, taxon, site, CASE WHEN state IN (0, 2) THEN 0 WHEN state IN (1, 3) THEN 1 END AS ry FROM states")
def ry_recode(s):
    return al.ry_recode(s).select("gene", "taxon", "site", "ry")


@query("wide", "SELECT gene, taxon, coalesce((SELECT string_agg(substr(seq, i::INT, 1), '' ORDER BY i) FROM (SELECT unnest(range(2, length(seq) + 1, 3)) AS i)), '') AS seq FROM wide")
def codon_position(w):
    return al.codon_position(w, 1)


FLAGS = "SELECT gene, site, count(*) AS n_rows, count(state) AS n_known, count(DISTINCT state) AS n_states FROM states GROUP BY gene, site"


@query("states", f"SELECT *, n_known = 0 AS all_missing, n_known = n_rows AS complete, n_states <= 1 AS constant FROM ({FLAGS}) x")
def constant_columns(s):
    return al.column_flags(s)


#: Alignments of the taxa of one group: few rows in a column.
GROUPED = FLAGS.replace("SELECT gene,", "SELECT taxon % 40 AS gene,").replace("GROUP BY gene, site", "GROUP BY taxon % 40, site")


def grouped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("gene", F.col("taxon") % 40)


@query("states", f"SELECT gene, site, n_rows FROM ({GROUPED}) x WHERE n_known = 0")
def all_missing_columns(s):
    return al.column_flags(grouped(s)).where("all_missing").select("gene", "site", "n_rows")


@query("states", f"SELECT gene, site, n_rows FROM ({FLAGS}) x WHERE n_known = n_rows")
def complete_columns(s):
    return al.column_flags(s).where("complete").select("gene", "site", "n_rows")


@query("states", "SELECT * FROM states WHERE (gene, taxon) IN (SELECT (gene, taxon) FROM states WHERE state IS NOT NULL)")
def drop_missing_taxa(s):
    return al.drop_missing_taxa(s)


@query("states", """SELECT taxon AS gene, count(*) AS n FROM states WHERE (taxon, site // 3) IN
  (SELECT (taxon, site // 3) FROM states GROUP BY taxon, site // 3 HAVING bool_and(state IS NOT NULL) AND count(DISTINCT site) = 3) GROUP BY taxon""")
def complete_triplets(s):
    return al.complete_triplets(s.withColumn("gene", F.col("taxon"))).groupBy("gene").agg(F.count(F.lit(1)).alias("n"))


@query("nodes taxa", "SELECT name, depth FROM nodes WHERE name IN (SELECT taxon FROM taxa)")
def restrict_taxa(n, t):
    return al.restrict_taxa(n.withColumnRenamed("name", "taxon"), t).select(F.col("taxon").alias("name"), "depth")


@query("bases", "SELECT gene, taxon, count(*) AS count FROM bases GROUP BY gene, taxon HAVING count(*) > 1")
def duplicate_taxa(b):
    return al.duplicate_taxa(b)


@query("part supplier", """WITH n AS (SELECT DISTINCT p_brand || '0000' AS name FROM part UNION SELECT DISTINCT substr(s_name, 1, 16) FROM supplier), t AS (SELECT DISTINCT p_brand AS taxon FROM part UNION SELECT s_name FROM supplier),
  a AS (SELECT name, min(taxon) AS taxon, count(*) AS n FROM n JOIN t ON starts_with(taxon, name) GROUP BY name), b AS (SELECT name, min(taxon) AS taxon, count(*) AS n FROM n JOIN t ON starts_with(name, taxon) WHERE name NOT IN (SELECT name FROM a) GROUP BY name)
  SELECT * FROM a UNION ALL SELECT * FROM b""")
def match_taxa_prefix(p, s):
    names = p.select(F.concat("p_brand", F.lit("0000")).alias("name")).union(s.select(F.substring("s_name", 1, 16))).distinct()
    return al.match_taxa_prefix(names, p.select(F.col("p_brand").alias("taxon")).union(s.select("s_name")).distinct())


@query("states", """SELECT g.gene, k.state, round(count(s.state) / any_value(g.n), 6) AS freq FROM (SELECT gene, count(state) AS n FROM states GROUP BY gene) g CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS state) k
  LEFT JOIN states s ON s.gene = g.gene AND s.state = k.state GROUP BY g.gene, k.state""")
def state_frequencies(s):
    return al.state_frequencies(s.withColumn("state", F.col("state").cast("int")))


AA20 = "(SELECT unnest(string_split('ACDEFGHIKLMNPQRSTVWY', '')) AS aa)"


@query("bases|codons", f"SELECT s.gene, s.site, a.aa, count(c.aa) AS n FROM (SELECT DISTINCT gene, site FROM bases) s CROSS JOIN {AA20} a LEFT JOIN codons c ON c.gene = s.gene AND c.site = s.site AND c.aa = a.aa GROUP BY s.gene, s.site, a.aa")
def site_aa_counts(b):
    return al.site_aa_counts(coded(b))


@query("bases|codons", "SELECT gene, round(sum(d) / count(*), 6) AS mean_diversity, count(*) FILTER (WHERE d = 1) AS n_constant FROM (SELECT gene, site, count(DISTINCT aa) AS d FROM codons GROUP BY gene, site) x GROUP BY gene")
def mean_aa_diversity(b):
    return al.aa_diversity(coded(b))


@query("bases|codons", "SELECT taxon % 40 AS gene, site FROM codons GROUP BY taxon % 40, site HAVING count(DISTINCT aa) = 1")
def aa_constant_columns(b):
    return grouped(coded(b)).groupBy("gene", "site").agg(F.count_distinct("aa").alias("d")).where("d = 1").select("gene", "site")


@query("bases|codons", """SELECT gene, round(coalesce(avg(b / a), 0), 6) AS ratio FROM (SELECT gene, site, max(n) FILTER (WHERE k = 1) AS a, max(n) FILTER (WHERE k = 2) AS b FROM
  (SELECT gene, site, aa, n, row_number() OVER (PARTITION BY gene, site ORDER BY n DESC, aa) AS k FROM (SELECT gene, site, aa, count(*) AS n FROM codons WHERE aa IS NOT NULL GROUP BY gene, site, aa)) GROUP BY gene, site) GROUP BY gene""")
def second_first_ratio(b):
    return al.second_first_ratio(coded(b))


PAIRS = "SELECT x.gene, x.taxon AS taxon1, y.taxon AS taxon2, count(*) AS n, count(*) FILTER (WHERE x.codon <> y.codon) AS d, count(*) FILTER (WHERE x.aa <> y.aa) AS dn FROM codons x JOIN codons y ON x.gene = y.gene AND x.site = y.site AND x.taxon < y.taxon WHERE x.codon IS NOT NULL AND y.codon IS NOT NULL GROUP BY ALL"


@query("bases|codons", f"SELECT gene, taxon1, taxon2, n, d FROM ({PAIRS}) x")
def taxon_pairs(b):
    return al.pair_counts(coded(b)).drop("dn")


@query("bases|codons", f"""SELECT t.gene, round(avg(d / n), 6) AS divergence, round(avg(dn / n) / avg(d / n) / 2.5, 6) AS dnds, any_value(t.t * (t.t - 1) // 2)::BIGINT - count(p.n) AS n_unshared
  FROM (SELECT gene, count(DISTINCT taxon) AS t FROM codons GROUP BY gene) t LEFT JOIN ({PAIRS}) p ON p.gene = t.gene GROUP BY t.gene""")
def pairwise_dnds(b):
    return al.pairwise_rates(coded(b))


@query("bases|codons", f"SELECT gene, round(avg(d / n), 6) AS divergence FROM ({PAIRS}) p GROUP BY gene")
def pairwise_divergence(b):
    return al.pairwise_rates(coded(b)).select("gene", "divergence")


@query("bases|codons", f"""WITH k AS (SELECT gene, site, aa, count(*) AS n FROM codons WHERE aa IS NOT NULL GROUP BY ALL), d AS (SELECT gene, site, aa AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY gene, site ORDER BY n DESC, aa) AS r FROM k) WHERE r = 1),
  w AS (SELECT dominant, count(*) AS sites FROM d GROUP BY dominant), s AS (SELECT dominant, aa, sum(n) AS n FROM k JOIN d USING (gene, site) GROUP BY ALL)
  SELECT w.dominant, a.aa, round(coalesce(s.n, 0) / sum(coalesce(s.n, 0)) OVER (PARTITION BY w.dominant), 6) AS freq, round(w.sites / (SELECT sum(sites) FROM w), 6) AS weight FROM w CROSS JOIN {AA20} a LEFT JOIN s ON s.dominant = w.dominant AND s.aa = a.aa""")
def dominant_aa_profiles(b):
    return al.dominant_aa_profiles(coded(b))


@query("states", "SELECT gene, count(DISTINCT site) // 3 AS n_codons, count(DISTINCT site) * count(DISTINCT taxon) AS weight FROM states GROUP BY gene")
def gene_sizes(s):
    return al.gene_sizes(s)


@query("part", "SELECT p_partkey AS gene, p_size AS nsite, coalesce(sum(p_size) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM part")
def gene_offsets(p):
    return al.gene_offsets(p.select(F.col("p_partkey").alias("gene"), F.col("p_partkey").alias("ordinal"), F.col("p_size").alias("nsite"))).select("gene", "nsite", "offset")


@query("part", "SELECT p_brand AS \"character\", round(avg(ln(p_retailprice)), 6) AS mean_log FROM part GROUP BY p_brand")
def trait_mean_log(p):
    return al.trait_mean_log(p.select(F.col("p_brand").alias("character"), F.col("p_retailprice").alias("value")))


@query("fitness", """SELECT "key", round(sum(CASE WHEN p >= 1e-6 THEN -p * ln(p) ELSE 0 END), 6) AS entropy FROM (SELECT "key", fitness / sum(fitness) OVER (PARTITION BY "key") AS p FROM fitness) x GROUP BY "key" """)
def entropy(f):
    from pyspark.sql import Window as W

    p = f.withColumn("p", F.col("fitness") / F.sum("fitness").over(W.partitionBy("key")))
    return p.groupBy("key").agg(F.sum(c.entropy_term(F.col("p"))).alias("entropy"))


# Trees

@query("nodes|closure", "SELECT ancestor, descendant, steps, round(distance, 6) AS distance FROM closure")
def tree_closure(n):
    return tr.closure(n).select("ancestor", "descendant", "steps", "distance")


@query("nodes|closure", """SELECT count(*) AS n_nodes, count(*) FILTER (WHERE NOT is_leaf) AS n_inner, round(sum(coalesce(branch_length, 0)), 6) AS total_length,
  (SELECT max(distance) FROM closure WHERE ancestor = 0 AND descendant >= 1000)::DOUBLE AS max_height, (SELECT min(distance) FROM closure WHERE ancestor = 0 AND descendant >= 1000)::DOUBLE AS min_height FROM nodes""")
def tree_summary(n):
    return tr.tree_summary(n).drop("tree")


LABELS = "SELECT c.ancestor AS node_id, min_by(n.name, n.node_id) AS first_leaf, max_by(n.name, n.node_id) AS last_leaf, count(*) AS n_leaves FROM closure c JOIN nodes n ON n.node_id = c.descendant WHERE n.is_leaf GROUP BY c.ancestor"


@query("nodes|closure", LABELS)
def clade_labels(n):
    return tr.clade_labels(n, tr.jumps(n)).drop("tree")


@query("nodes", "SELECT a.node_id, ((10 - b.depth * 2) - (10 - a.depth * 2))::DOUBLE AS branch_length FROM nodes a JOIN nodes b ON b.node_id = a.parent_id")
def age_to_branch_length(n):
    return tr.age_to_branch_length(n.withColumn("age", 10 - F.col("depth") * 2)).drop("tree")


@query("nodes", "SELECT node_id, least(trunc(coalesce(branch_length, 0) * 3)::INT, 2) AS cond FROM nodes")
def branch_condition_map(n):
    return tr.branch_condition_map(n.withColumn("v", F.coalesce(F.col("branch_length"), F.lit(0.0)) * 3), "v", 3).drop("tree")


@query("supplier nodes|closure", """SELECT a, b, max_by(x.ancestor, n.depth) AS lca FROM (SELECT 1000 + s_suppkey AS a, 1000 + (s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier) AS b FROM supplier) p
  JOIN closure x ON x.descendant = p.a JOIN closure y ON y.descendant = p.b AND y.ancestor = x.ancestor JOIN nodes n ON n.node_id = x.ancestor GROUP BY a, b""")
def lca(s, n):
    total = s.agg(F.count(F.lit(1)).alias("m"))
    pairs = s.join(F.broadcast(total), F.lit(True)).select(F.lit("tree").alias("tree"), (F.col("s_suppkey") + 1000).alias("a"), ((F.col("s_suppkey") * 7 + 3) % F.col("m") + 1000).alias("b"))
    return tr.lca(pairs, n).drop("tree")


@query("nodes taxa|closure", """WITH l AS (SELECT node_id FROM nodes WHERE is_leaf AND name IN (SELECT taxon FROM taxa)), a AS (SELECT DISTINCT ancestor AS node_id FROM closure WHERE descendant IN (SELECT node_id FROM l)),
  k AS (SELECT parent_id AS node_id FROM nodes WHERE node_id IN (SELECT node_id FROM a) AND parent_id IS NOT NULL GROUP BY parent_id HAVING count(*) >= 2 UNION ALL SELECT node_id FROM l)
  SELECT k.node_id, min_by(c.ancestor, c.steps) AS parent_id, round(min_by(c.distance, c.steps)::DOUBLE, 6) AS branch_length FROM k LEFT JOIN closure c ON c.descendant = k.node_id AND c.steps > 0 AND c.ancestor IN (SELECT node_id FROM k) GROUP BY k.node_id""")
def prune_tree(n, t):
    return tr.prune_tree(n, tr.jumps(n), t).drop("tree")


@query("nodes taxa", "SELECT name, 'tree' AS side FROM nodes WHERE is_leaf AND name NOT IN (SELECT taxon FROM taxa)")
def tree_alignment_join(n, t):
    return tr.tree_alignment_check(n, t)


@query("nodes states|closure", """WITH k AS (SELECT DISTINCT site, 1000 + taxon AS leaf FROM states WHERE state IS NOT NULL), c AS (SELECT site, ancestor AS node_id, count(*) AS n FROM k JOIN closure ON descendant = leaf GROUP BY ALL),
  r AS (SELECT c.*, n.depth, max(c.n) OVER (PARTITION BY site) AS top FROM c JOIN nodes n USING (node_id)), q AS (SELECT *, max(CASE WHEN n = top THEN depth END) OVER (PARTITION BY site) AS rd FROM r)
  SELECT site, node_id, (CASE WHEN n = top AND depth = rd THEN 2 WHEN depth > rd THEN 1 ELSE 0 END)::INT AS flag FROM q""")
def informative_nodes(n, s):
    known = s.where("state IS NOT NULL").select(F.lit("tree").alias("tree"), "site", (F.col("taxon") + 1000).alias("node_id")).distinct().join(n.select("node_id", "name"), "node_id").select("tree", "site", "name")
    return tr.informative_nodes(n, tr.jumps(n), known).select("site", "node_id", "flag")


@query("branch_suffstat nodes|closure", f"""WITH q AS (SELECT branch + 1000 AS node_id, {QUANTILE.format(q=0.025)} AS q0, {QUANTILE.format(q=0.5)} AS q1, {QUANTILE.format(q=0.975)} AS q2 FROM ({RANKED.format(k='branch', v='bsyn', t='branch_suffstat')}) x GROUP BY branch)
  SELECT q.node_id, q0, q1, q2, n.name AS label FROM q JOIN nodes n ON n.node_id = q.node_id""")
def branch_posterior_table(b, n):
    q = po.posterior_quantiles(b.select((F.col("branch") + 1000).alias("node_id"), F.col("bsyn").alias("value")), ["node_id"])
    return tr.branch_posterior_table(q, tr.clade_labels(n, tr.jumps(n)), n, True).select("node_id", "q0", "q1", "q2", "label")


MEDIAN = f"SELECT branch + 1000 AS node_id, max(CASE WHEN k = floor(0.5::DOUBLE * n) THEN v END) AS m FROM ({RANKED.format(k='branch', v='bsyn', t='branch_suffstat')}) x GROUP BY branch"


@query("branch_suffstat nodes", f"SELECT q.node_id, round(exp(q.m), 6) AS value, 2.0::DOUBLE AS mean_length FROM ({MEDIAN}) q")
def node_branch_medians(b, n):
    medians = po.posterior_quantiles(b.select((F.col("branch") + 1000).alias("node_id"), F.col("bsyn").alias("value")), ["node_id"], qs=(0.5,)).withColumnRenamed("q0", "median")
    return tr.node_branch_medians(medians, tr.age_to_branch_length(n.withColumn("age", 10 - F.col("depth") * 2)))


@query("branch_suffstat nodes|closure", f"""SELECT l.first_leaf, l.last_leaf, round(v.x, 6) AS value FROM (SELECT c.ancestor AS node_id, sum(b.bsyn) AS x FROM branch_suffstat b JOIN closure c ON c.descendant = b.branch + 1000 GROUP BY c.ancestor) v
  JOIN ({LABELS}) l ON l.node_id = v.node_id""")
def branch_table_export(b, n):
    below = tr.jumps(n)
    own = b.select((F.col("branch") + 1000).alias("node_id"), F.col("bsyn").alias("value")).join(n.select("tree", "node_id"), "node_id")
    values = tr.gathered(own, below, {"value": F.sum}).drop("tree")
    return tr.branch_table_export(values, n, tr.clade_labels(n, below))


@query("branch_suffstat", "SELECT branch, " + ", ".join(f"round(sum({x}), 6) AS {x}" for x in ("nsyn", "nnonsyn", "bsyn", "bnonsyn")) + " FROM branch_suffstat GROUP BY branch")
def merge_mapped_branches(b):
    return tr.merge_mapped_branches(b.select("gene", "branch", F.expr("stack(4, 'ds_count', nsyn, 'dn_count', nnonsyn, 'ds_norm', bsyn, 'dn_norm', bnonsyn) AS (stat, value)")))


# Sufficient statistics

STEPS = "(SELECT gene, site, branch, seg, state AS from_state, lead(state) OVER (PARTITION BY gene, site, branch ORDER BY seg) AS to_state, t FROM path)"
PATH_PAIRS = f"SELECT branch, from_state, to_state, count(*) AS n FROM {STEPS} WHERE to_state <> from_state GROUP BY ALL"
WAITING = "SELECT branch, state, sum(t) AS t FROM path GROUP BY ALL"


@query("path", PATH_PAIRS)
def path_suffstat_pairs(p):
    return su.path_suffstat(p, ["branch"])[1]


@query("path", f"SELECT branch, state, round(t, 6) AS t FROM ({WAITING}) x")
def path_suffstat_waiting(p):
    return su.path_suffstat(p, ["branch"])[0]


@query("path|near", f"""SELECT b.branch, round(b.beta, 6) AS beta, coalesce(n.n, 0)::BIGINT AS count FROM (SELECT branch, sum(t * r) AS beta FROM ({WAITING}) w JOIN (SELECT codon_id1, count(*)::DOUBLE AS r FROM near GROUP BY ALL) o ON o.codon_id1 = w.state GROUP BY branch) b
  LEFT JOIN (SELECT branch, sum(n) AS n FROM ({PATH_PAIRS}) x GROUP BY branch) n ON n.branch = b.branch""")
def length_suffstat(p):
    out = near(p.sparkSession).where("position BETWEEN 0 AND 2").groupBy(F.col("codon_id1").alias("state")).agg(F.sum("rate").alias("out"))
    return su.length_suffstat(p, out, ["branch"])


def ds_sql(flag: str = "true", omega: float = 1.0) -> str:
    return f"""SELECT e.branch, coalesce(c.nsyn, 0)::BIGINT AS nsyn, coalesce(c.nnonsyn, 0)::BIGINT AS nnonsyn, round(e.bsyn, 6) AS bsyn, round(e.bnonsyn, 6) AS bnonsyn FROM
  (SELECT branch, sum(t * rs) AS bsyn, sum(t * rn / {omega}::DOUBLE) AS bnonsyn FROM ({WAITING}) w JOIN (SELECT codon_id1, count(*) FILTER (WHERE synonymous) AS rs, count(*) FILTER (WHERE NOT synonymous) AS rn FROM near WHERE {flag} GROUP BY ALL) o ON o.codon_id1 = w.state GROUP BY branch) e
  LEFT JOIN (SELECT branch, sum(n) FILTER (WHERE synonymous) AS nsyn, sum(n) FILTER (WHERE NOT synonymous) AS nnonsyn FROM ({PATH_PAIRS}) p JOIN near k ON k.codon_id1 = p.from_state AND k.codon_id2 = p.to_state WHERE {flag} GROUP BY branch) c ON c.branch = e.branch"""


@query("path|near", ds_sql(omega=0.5))
def ds_omega_suffstat(p):
    return su.ds_omega_suffstat(*su.path_suffstat(p, ["branch"]), near(p.sparkSession), ["branch"], 0.5)


@query("path|near", ds_sql("gc_conservative"))
def gc_conservative_suffstat(p):
    return su.ds_omega_suffstat(*su.path_suffstat(p, ["branch"]), near(p.sparkSession), ["branch"], 1.0, "gc_conservative")


@query("path|near", f"SELECT branch, nnonsyn AS count, bnonsyn AS beta FROM ({ds_sql(omega=0.5)}) x")
def omega_suffstat(p):
    return su.ds_omega_suffstat(*su.path_suffstat(p, ["branch"]), near(p.sparkSession), ["branch"], 0.5).select("branch", F.col("nnonsyn").alias("count"), F.col("bnonsyn").alias("beta"))


NUC = f"""SELECT b.from_base, b.to_base, coalesce(c.n, 0)::BIGINT AS n, b.beta FROM (SELECT from_base, to_base, sum(t) AS beta FROM near k JOIN (SELECT state, sum(t) AS t FROM path GROUP BY state) w ON w.state = k.codon_id1 GROUP BY ALL) b
  LEFT JOIN (SELECT from_base, to_base, sum(n) AS n FROM ({PATH_PAIRS}) p JOIN near k ON k.codon_id1 = p.from_state AND k.codon_id2 = p.to_state GROUP BY ALL) c USING (from_base, to_base)"""


@query("path|near", f"SELECT from_base, to_base, n, round(beta, 6) AS beta FROM ({NUC}) x")
def nuc_suffstat(p):
    return su.nuc_suffstat(*su.path_suffstat(p, ["branch"]), near(p.sparkSession))


@query("path|near", f"SELECT least(from_base, to_base) AS a, greatest(from_base, to_base) AS b, sum(n)::BIGINT AS n, round(sum(beta), 6) AS beta FROM ({NUC}) x GROUP BY ALL")
def relrate_suffstat(p):
    return su.relrate_suffstat(su.nuc_suffstat(*su.path_suffstat(p, ["branch"]), near(p.sparkSession)))


@query("gene_trace", "SELECT gene, round(sum(posom), 6) AS sum, round(sum(ln(posom)), 6) AS sum_log, count(*) AS n FROM gene_trace WHERE posom > 0 GROUP BY gene")
def gamma_suffstat(t):
    return su.gamma_suffstat(t, ["gene"], "posom")


STATS = ["nsyn", "nnonsyn", "bsyn", "bnonsyn"]


@query("branch_suffstat", "SELECT branch, " + ", ".join(f"round(sum({s}) * 0.5, 6) AS {s}" for s in STATS) + " FROM branch_suffstat GROUP BY branch")
def merge_suffstats(b):
    return su.merge_suffstats(b, ["branch"], STATS, 0.5)


@query("alloc site_trace", "SELECT component, round(sum(value), 6) AS value FROM (SELECT gene, site, sum(value) AS value FROM site_trace GROUP BY ALL) s JOIN (SELECT gene, site % 20 AS site, min(component) AS component FROM alloc GROUP BY gene, site % 20) a USING (gene, site) GROUP BY component")
def merge_by_allocation(a, s):
    alloc = a.groupBy("gene", (F.col("site") % 20).alias("site")).agg(F.min("component").alias("component"))
    return su.merge_by_allocation(su.merge_suffstats(s, ["gene", "site"], ["value"]), alloc, ["value"])


@query("branch_suffstat", """SELECT branch, round(CASE WHEN bs <> 0 THEN ns / bs ELSE 0 END, 6) AS ds, round(CASE WHEN bn <> 0 THEN nn / bn ELSE 0 END, 6) AS dn, round(CASE WHEN bs = 0 OR bn = 0 OR ns = 0 THEN 0 ELSE (nn / bn) / (ns / bs) END, 6) AS dnds
  FROM (SELECT branch, sum(nsyn) AS ns, sum(nnonsyn) AS nn, sum(bsyn) AS bs, sum(bnonsyn) AS bn FROM branch_suffstat GROUP BY branch) x""")
def branch_dnds(b):
    return su.branch_dnds(su.merge_suffstats(b, ["branch"], STATS)).select("branch", "ds", "dn", "dnds")


@query("branch_suffstat", "SELECT gene, round(sum(nsyn * ln(1.5) - bsyn * 1.5), 6) AS logprob FROM branch_suffstat GROUP BY gene")
def poisson_logprob(b):
    return b.groupBy("gene").agg(F.sum(su.poisson_logprob(F.col("nsyn"), F.col("bsyn"), F.lit(1.5))).alias("logprob"))


@query("branch_suffstat", "SELECT gene, branch, round(2.0 * ln(3.0) - lgamma(2.0) - (2.0 + nsyn) * ln(3.0 + bsyn) + lgamma(2.0 + nsyn), 6) AS logprob FROM branch_suffstat")
def gamma_marginal_logprob(b):
    return b.select("gene", "branch", su.gamma_marginal_logprob(F.col("nsyn"), F.col("bsyn"), 2.0, 3.0).alias("logprob"))


@query("branch_suffstat", """WITH x AS (SELECT gene, branch, ln(0.3 * 0.9) + nnonsyn * ln(0.2) - bnonsyn * 0.2 AS a, ln(0.7 * 0.9) - bnonsyn AS b, ln(0.1) + nnonsyn * ln(2.5) - bnonsyn * 2.5 AS c FROM branch_suffstat),
  y AS (SELECT *, greatest(a, b, c) AS m FROM x), z AS (SELECT *, exp(a - m) AS ea, exp(b - m) AS eb, exp(c - m) AS ec FROM y)
  SELECT gene, branch, round(ea / (ea + eb + ec), 6) AS p_pur, round(eb / (ea + eb + ec), 6) AS p_neutral, round(ec / (ea + eb + ec), 6) AS p_pos, round(m + ln(ea + eb + ec), 6) AS log_marginal FROM z""")
def mixture_post_prob(b):
    rows = b.select("gene", "branch", F.col("nnonsyn").alias("count"), F.col("bnonsyn").alias("beta"))
    return su.mixture_post_prob(rows, 0.2, 2.5, 0.3, 0.1).drop("count", "beta")


# Rates


@query("relrates frequencies|nuc", """SELECT "set", a, b, round(rate, 6) AS rate FROM nuc UNION ALL SELECT "set", a, a, round(-sum(rate), 6) FROM nuc GROUP BY "set", a""")
def gtr_rates(r, f):
    return ra.gtr_rates(r, f)


def _nuc(r: DataFrame, f: DataFrame) -> DataFrame:
    return ra.gtr_rates(r, f).where("a <> b")


@query("relrates frequencies|mg", 'SELECT "set", codon1, codon2, round(rate, 6) AS rate FROM mg')
def mg_codon_rates(r, f):
    return ra.mg_codon_rates(c.codon_neighbours(r.sparkSession), _nuc(r, f), 0.3).select("set", "codon1", "codon2", "rate")


@query("frequencies|stationary", 'SELECT "set", codon, aa, round(stat, 6) AS stat FROM stationary')
def codon_stationary(f):
    return ra.codon_stationary(c.codon_table(f.sparkSession).select("codon", "aa"), f)


FIX = "CASE WHEN abs(s) < 1e-6 THEN 1 + s / 2 WHEN s > 50 THEN s WHEN s < -50 THEN 0 ELSE s / (1 - exp(-s)) END"
MUTSEL = f"""mutsel AS (SELECT "set", "key", codon1, codon2, synonymous, mutation, mutation * {FIX} * CASE WHEN synonymous THEN 1.0 ELSE 0.3 END AS rate
  FROM (SELECT m.*, x."key", ln(y.fitness) - ln(x.fitness) AS s FROM mg m JOIN fitness x ON x.aa = m.aa1 JOIN fitness y ON y."key" = x."key" AND y.aa = m.aa2) z)"""


@query("relrates frequencies fitness|mg", f'WITH {MUTSEL} SELECT "set", "key", codon1, codon2, round(rate, 6) AS rate FROM mutsel')
def mutsel_rates(r, f, fit):
    return ra.mutsel_rates(c.codon_neighbours(r.sparkSession), _nuc(r, f), fit, 0.3).select("set", "key", "codon1", "codon2", "rate")


@query("relrates frequencies fitness|mg stationary", f"""WITH {MUTSEL} SELECT m."set", m."key", round(sum(s.stat * x.fitness * m.rate) / sum(s.stat * x.fitness * m.mutation), 6) AS dnds FROM mutsel m
  JOIN stationary s ON s."set" = m."set" AND s.codon = m.codon1 JOIN fitness x ON x."key" = m."key" AND x.aa = s.aa WHERE NOT synonymous GROUP BY ALL""".replace("WHEN synonymous THEN 1.0 ELSE 0.3", "WHEN synonymous THEN 1.0 ELSE 1.0"))
def predicted_dnds(r, f, fit):
    spark = r.sparkSession
    return ra.predicted_dnds(ra.mg_codon_rates(c.codon_neighbours(spark), _nuc(r, f), 1.0), ra.codon_stationary(c.codon_table(spark).select("codon", "aa"), f), fit)


@query("relrates frequencies|mg stationary", """SELECT m."set", aa1, aa2, round(sum(s.stat * m.rate) / any_value(t.t), 6) AS rate FROM mg m JOIN stationary s ON s."set" = m."set" AND s.codon = m.codon1
  JOIN (SELECT "set", aa, sum(stat) AS t FROM stationary GROUP BY ALL) t ON t."set" = m."set" AND t.aa = m.aa1 WHERE aa1 <> aa2 GROUP BY m."set", aa1, aa2""")
def aa_projected_rates(r, f):
    spark = r.sparkSession
    return ra.aa_projected_rates(ra.mg_codon_rates(c.codon_neighbours(spark), _nuc(r, f), 0.3), ra.codon_stationary(c.codon_table(spark).select("codon", "aa"), f))


@query("relrates frequencies|mg stationary", """WITH w AS (SELECT s."set", codon, (1 + s."set") / 15 * stat AS ws FROM stationary s) SELECT codon1, codon2, round(sum(ws * rate) / any_value(t.t), 6) AS rate FROM mg m JOIN w ON w."set" = m."set" AND w.codon = m.codon1
  JOIN (SELECT codon, sum(ws) AS t FROM w GROUP BY codon) t ON t.codon = m.codon1 GROUP BY codon1, codon2""")
def mean_codon_rates(r, f):
    spark = r.sparkSession
    weights = f.select("set").distinct().withColumn("w", (1 + F.col("set")) / 15)
    return ra.mean_codon_rates(ra.mg_codon_rates(c.codon_neighbours(spark), _nuc(r, f), 0.3), ra.codon_stationary(c.codon_table(spark).select("codon", "aa"), f), weights)


_AA = ", ".join(f"('{a}', {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for a, x, y, z in zip(c.AMINO_ACIDS, c.COMPOSITION, c.POLARITY, c.VOLUME, strict=True))
DISTANCE = f"""d AS (SELECT aa1, aa2, r / avg(r) OVER () AS distance FROM (SELECT x.aa AS aa1, y.aa AS aa2, sqrt(1.833::DOUBLE * (x.c - y.c) ** 2 + 0.1018::DOUBLE * (x.p - y.p) ** 2 + 0.000399::DOUBLE * (x.v - y.v) ** 2) AS r
  FROM (VALUES {_AA}) x(aa, c, p, v), (VALUES {_AA}) y(aa, c, p, v) WHERE x.aa <> y.aa) z)"""


@query("region", f"""WITH {DISTANCE}, x AS (SELECT r_regionkey AS class, aa1 AS optimum, aa2 AS aa, 1e-8::DOUBLE + CASE WHEN e < 100 THEN exp(-e) ELSE 0 END AS x FROM (SELECT *, 2.0::DOUBLE * (0.5::DOUBLE + r_regionkey) * distance AS e FROM region, d)
  UNION ALL SELECT DISTINCT r_regionkey, aa1, aa1, 1.0 FROM region, d) SELECT class, optimum, aa, round(x / sum(x) OVER (PARTITION BY class, optimum), 6) AS p FROM x""")
def selac_profiles(r):
    return ra.selac_profiles(c.aa_distance(r.sparkSession), r.select(F.col("r_regionkey").alias("class"), (F.col("r_regionkey") + 0.5).alias("g")), 2.0)


@query("fitness region", """SELECT class, "key", aa, round(x / sum(x) OVER (PARTITION BY class, "key"), 6) AS p FROM (SELECT r_regionkey AS class, "key", aa, 1e-50::DOUBLE + CASE WHEN e < 100 THEN exp(-e) ELSE 0 END AS x
  FROM (SELECT *, -2.0::DOUBLE * (0.5::DOUBLE + r_regionkey) * ln(fitness) AS e FROM fitness, region)) y""")
def empirical_selac_profiles(f, r):
    return ra.empirical_selac_profiles(f, r.select(F.col("r_regionkey").alias("class"), (F.col("r_regionkey") + 0.5).alias("g")), 2.0)


@query("fitness deltas", """SELECT "key", cond, aa, round(x / sum(x) OVER (PARTITION BY "key", cond), 6) AS p FROM (SELECT d."key", d.cond, d.aa, f.fitness * CASE WHEN d.cond = 0 THEN 1 WHEN d.cond = 1 THEN exp(d.delta) ELSE exp(d.delta + coalesce(e.delta, 0)) END AS x
  FROM deltas d JOIN fitness f ON f."key" = d."key" AND f.aa = d.aa LEFT JOIN deltas e ON e."key" = d."key" AND e.aa = d.aa AND e.cond = 1) y""")
def condition_fitness(f, d):
    return ra.condition_fitness(f, d, True)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
