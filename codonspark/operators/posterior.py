"""Posterior summaries over trace tables: one row for each saved point and key."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codonspark.functions.shared import checkpointed, running
from codonspark.operators.alignment import aa_diversity, pairwise_rates

QUANTILES = (0.025, 0.5, 0.975)
#: Bins of a span of values, and most spans that are broadcast, of some 100 bytes.
BINS, SPANS = 1024, 100_000


def sample_window(trace: DataFrame, burnin: int = -1, every: int = 1, until: int = -1, by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Saved points burnin + i * every with i < (until - burnin) div every.

    until -1 or beyond the chain is its end; burnin -1 is a tenth of the chain. The chain's size is its largest iter and one, by key if `by` is given.
    strict: a window without points is an error.
    """
    i = F.col("iter") - F.col("__b")
    if burnin >= 0 and every == 1:  # the chain ends where its points end, so its size needn't be known
        kept = trace.where((F.col("iter") >= burnin) & (F.col("iter") < until)) if until >= 0 else trace.where(F.col("iter") >= burnin)
    else:
        by = by or []
        size = trace.groupBy(*by).agg((F.max("iter") + 1).alias("__size"))
        rows = trace.join(size, by) if by else trace.join(F.broadcast(size), F.lit(True))  # one row
        first = F.floor(F.col("__size") / 10) if burnin < 0 else F.lit(burnin)
        last = F.col("__size") if until < 0 else F.least(F.col("__size"), F.lit(until))
        kept = rows.withColumn("__b", first).withColumn("__u", last).where((i >= 0) & (i % every == 0) & (F.floor(i / every) < F.floor((F.col("__u") - F.col("__b")) / every))).drop("__size", "__b", "__u")
    if strict and kept.isEmpty():
        raise ValueError("the window has no points")
    return kept


def posterior_mean_sd(trace: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Points, mean and population standard deviation by key."""
    return trace.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def _selected(rows: DataFrame, keys: list[str], qs: tuple[float, ...]) -> DataFrame:
    """posterior_quantiles by rounds of counting over rows (keys, __v): each element is sought in a span of values, whose bins are counted in a scan of the rows, and the bin that holds it is its next span, until that is one value.

    The first bins are sign and power of two, later ones equal parts, of which six rounds at most split the values of one power. Only counts of bins are shuffled, BINS or so for each
    key and element; the spans go to the rows by broadcast while they are fewer than SPANS. Nulls come first and NaN last.
    """
    names, n = [f"__key_{k}" for k in keys], F.count(F.lit(1))
    whole = rows.groupBy(*[F.col(k).alias(name) for k, name in zip(keys, names, strict=True)]).agg(n.alias("__n"), F.count_if(F.col("__v").isNull()).alias("__nulls"))
    ranks = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.floor(F.lit(q) * F.col("__n")) - F.col("__nulls")).alias("r")) for i, q in enumerate(qs)])).alias("x")
    nothing = F.lit(None).cast(rows.schema["__v"].dataType)
    asked = checkpointed(whole.select(*names, ranks).select(*names, "x.i", "x.r", nothing.alias("lo"), nothing.alias("hi")))
    found, open_ = [asked], asked.where("r >= 0")
    v, first = F.col("__v"), True
    while (many := open_.count()) > 0:
        spans = open_.select(*names, "lo", "hi").distinct()
        inside = reduce(and_, [F.col(k).eqNullSafe(F.col(name)) for k, name in zip(keys, names, strict=True)])
        if first:
            power = F.least(F.greatest(F.log2(F.abs(v)), F.lit(-1100.0)), F.lit(1100.0))
            bin_ = F.when(F.isnan(v.cast("double")), 9999).when(v == 0, 0).otherwise(F.signum(v.cast("double")) * (F.floor(power) + 1200)).cast("long")
        else:
            inside &= v.between(F.col("lo"), F.col("hi"))
            bin_ = F.least(F.floor((v - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo")).cast("double") * BINS), F.lit(BINS - 1)).cast("long")
        hits = rows.where("__v IS NOT NULL").join(F.broadcast(spans) if many <= SPANS else spans, inside)
        bins = hits.groupBy(*names, "lo", "hi", bin_.alias("bin")).agg(n.alias("c"), F.min("__v").alias("least"), F.max("__v").alias("most"))
        earlier = W.partitionBy(*names, "lo", "hi").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
        bins = bins.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
        ask, own = open_.alias("a"), bins.alias("b")
        same = reduce(and_, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*names, "lo", "hi")])
        holds = (F.col("a.r") >= F.col("b.before")) & (F.col("a.r") < F.col("b.before") + F.col("b.c"))
        step = checkpointed(ask.join(own, same & holds).select(*[F.col(f"a.{c}").alias(c) for c in (*names, "i")], (F.col("r") - F.col("before")).alias("r"), F.col("least").alias("lo"), F.col("most").alias("hi")))
        found.append(step.where("lo = hi"))
        open_, first = step.where("lo < hi"), False
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("lo")))
    out = reduce(DataFrame.union, found).groupBy(*names).agg(*[at(i).alias(f"q{i}") for i in range(len(qs))])
    return out.withColumnsRenamed(dict(zip(names, keys, strict=True)))


def posterior_quantiles(trace: DataFrame, keys: list[str], value: str = "value", qs: tuple[float, ...] = QUANTILES, split: bool = False) -> DataFrame:
    """Elements int(q * n), from 0, of each key's sorted values, without interpolation, as columns q0, q1, ...

    A key is sorted in one task; split, for few keys of many rows, sorts nothing and counts bins of numeric values in some scans of the rows, exactly.
    """
    rows, key = trace.select(*keys, F.col(value).alias("__v")), W.partitionBy(*keys)
    if split:
        return _selected(rows, keys, qs)
    ranked = rows.select(*keys, "__v", (F.row_number().over(key.orderBy("__v")) - 1).alias("__k"), F.count(F.lit(1)).over(key).alias("__n"))
    at = lambda q: F.max(F.when(F.col("__k") == F.floor(F.lit(q) * F.col("__n")), F.col("__v")))
    return ranked.groupBy(*keys).agg(*[at(q).alias(f"q{i}") for i, q in enumerate(qs)])


def hyperparam_summary(trace: DataFrame, keys: list[str], value: str = "value", split: bool = False) -> DataFrame:
    """Mean and the outer quantiles by key."""
    mean = trace.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return mean.join(posterior_quantiles(trace, keys, value, (QUANTILES[0], QUANTILES[2]), split).withColumnsRenamed({"q0": "low", "q1": "high"}), keys)


def share(condition: Column) -> Column:
    """Share of rows that meet a condition."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def gene_positive_prob(trace: DataFrame) -> DataFrame:
    """Per gene: share of points with weight over 0, mean weight, mean omega."""
    return trace.groupBy("gene").agg(share(F.col("posw") > 0).alias("pp"), F.avg("posw").alias("mean_posw"), F.avg("posom").alias("mean_posom"))


def gene_omega_prob(trace: DataFrame, value: str = "posom") -> DataFrame:
    """Per gene: share of points with omega over 1, mean omega and its rank."""
    g = trace.groupBy("gene").agg(share(F.col(value) > 1.0).alias("pp"), F.avg(value).alias("mean_omega"))
    return ranked(g, F.desc("mean_omega"), "gene")


def ranked(rows: DataFrame, first: Column, *ties: str) -> DataFrame:
    """Adds rank in a global order, without sorting in one task."""
    return running(rows, [first, *ties]).withColumnRenamed("__rank", "rank")


def fdr_ranking(rows: DataFrame, *ties: str, pp: str = "pp") -> DataFrame:
    """Ranked by pp, falling: running mean of pp and 1 minus it, without sorting in one task."""
    out = running(rows, [F.desc(pp), *ties], [pp]).withColumnRenamed("__rank", "rank")
    return out.withColumn("mean_pp", F.col(f"__sum_{pp}") / F.col("rank")).withColumn("fdr", 1 - F.col("mean_pp")).drop(f"__sum_{pp}")


def site_positive_prob(trace: DataFrame, value: str = "value") -> DataFrame:
    """Per (gene, site): share of points over 0, ranked with running mean."""
    return fdr_ranking(trace.groupBy("gene", "site").agg(share(F.col(value) > 0).alias("pp")), "gene", "site")


def site_mean_pp(trace: DataFrame, value: str = "value") -> DataFrame:
    return trace.groupBy("gene", "site").agg(F.avg(value).alias("pp"))


def gene_site_report(genes: DataFrame, sites: DataFrame, external: DataFrame, cutoff: float) -> DataFrame:
    """Ranked genes with an external test (null where absent) and the number and list, from 1, of sites with pp over the cutoff."""
    found = sites.where(F.col("pp") > cutoff).groupBy("gene").agg(F.count(F.lit(1)).alias("n_sites"), F.array_join(F.sort_array(F.collect_list((F.col("site") + 1).cast("long"))), ",").alias("sites"))
    joined = fdr_ranking(genes, "gene").join(found, "gene", "left").join(external, "gene", "left")
    return joined.withColumn("n_sites", F.coalesce("n_sites", F.lit(0)))


def gene_post_analysis(trace: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Per gene: pp, means, and the outer quantiles of omega. sites (gene, site, pp) adds `site_pp`, int(100 * pp) of each site in order."""
    found = gene_positive_prob(trace).join(posterior_quantiles(trace, ["gene"], "posom", (QUANTILES[0], QUANTILES[2])).withColumnsRenamed({"q0": "low", "q1": "high"}), "gene")
    if sites is None:
        return found
    percents = F.transform(F.sort_array(F.collect_list(F.struct("site", (100 * F.col("pp")).cast("int").alias("p")))), lambda x: x["p"])
    return found.join(sites.groupBy("gene").agg(percents.alias("site_pp")), "gene", "left")


def site_shift_prob(trace: DataFrame) -> DataFrame:
    """Per (cond, gene, site): share of points with any toggle on."""
    point = trace.groupBy("cond", "gene", "site", "iter").agg(F.max("toggle").alias("any_on"))
    return point.groupBy("cond", "gene", "site").agg(share(F.col("any_on") > 0).alias("pp"))


def aa_shift_prob(trace: DataFrame) -> DataFrame:
    """Per (cond, gene, site, aa): share of points with the toggle on."""
    return trace.groupBy("cond", "gene", "site", "aa").agg(share(F.col("toggle") > 0).alias("pp"))


def site_shift_fdr(trace: DataFrame, cutoff: float, offset: int = 0) -> DataFrame:
    """Sites with pp over the cutoff, ranked with running mean, with the share of each toggle as a column aa0 to aa19. Sites are numbered from `offset`."""
    sites = fdr_ranking(site_shift_prob(trace).where(F.col("pp") > cutoff), "cond", "gene", "site")
    aa = aa_shift_prob(trace).groupBy("cond", "gene", "site").agg(*[F.coalesce(F.max(F.when(F.col("aa") == i, F.col("pp"))), F.lit(0.0)).alias(f"aa{i}") for i in range(20)])
    found = sites.join(aa, ["cond", "gene", "site"])
    return found.withColumn("site", F.col("site") + offset) if offset else found


def gene_shift_histogram(sites: DataFrame, ncat: int = 4) -> DataFrame:
    """Per gene, sites by pp in ncat equal bins as columns bin0 ...; pp 1 is in the last."""
    bin_ = F.least(F.floor(F.col("pp") * ncat), F.lit(ncat - 1))
    return sites.groupBy("gene").agg(*[F.count_if(bin_ == i).alias(f"bin{i}") for i in range(ncat)])


def gene_shift_ranking(genes: DataFrame, sites: DataFrame, ncat: int = 4) -> DataFrame:
    """Genes (gene, pp) ranked with running mean and fdr, each with its sites' histogram; a gene without sites has zeros."""
    bins = gene_shift_histogram(sites, ncat)
    return fdr_ranking(genes, "gene").join(bins, "gene", "left").fillna(0, [f"bin{i}" for i in range(ncat)])


def masked_shift_prob(trace: DataFrame) -> DataFrame:
    """Toggle shares where the mask is on and the site has two active entries or more at that point."""
    point = W.partitionBy("cond", "gene", "site", "iter")
    active = trace.withColumn("active", F.sum("mask").over(point))
    on = (F.col("mask") == 1) & (F.col("active") >= 2) & (F.col("toggle") == 1)
    return active.groupBy("cond", "gene", "site", "aa").agg(share(on).alias("pp"))


def centered_effect_prob(trace: DataFrame, cutoff: float) -> DataFrame:
    """Effects minus their mean over the entries of a point: share over 0, kept where either tail passes the cutoff.

    Over 0 is over 1e-9: of equal effects, the difference to their mean is rounding alone.
    """
    point = W.partitionBy("cond", "gene", "site", "iter")
    centered = trace.withColumn("c", F.col("delta") - F.avg("delta").over(point))
    pp = centered.groupBy("cond", "gene", "site", "aa").agg(share(F.col("c") > 1e-9).alias("pp"), F.avg("c").alias("mean_effect"))
    return pp.where((F.col("pp") > cutoff) | (1 - F.col("pp") > cutoff))


def condition_effects(trace: DataFrame, cutoff: float = 0.7) -> DataFrame:
    """log(omega / expected) by gene and condition: mean and share over 0; genes where any condition passes the cutoff in either tail."""
    effect = F.ln(F.col("omega") / F.col("expected"))
    rows = trace.groupBy("gene", "cond").agg(F.avg(effect).alias("mean_effect"), share(effect > 0).alias("pp"))
    kept = rows.where((F.col("pp") > cutoff) | (F.col("pp") < 1 - cutoff)).select("gene").distinct()
    return rows.join(kept, "gene", "left_semi")


def sparse_condition_effects(trace: DataFrame) -> DataFrame:
    """Share of points with allocation 2 (positive) and 0 (negative)."""
    return trace.groupBy("gene", "cond").agg(share(F.col("alloc") == 2).alias("pp_positive"), share(F.col("alloc") == 0).alias("pp_negative"))


def _with_variances(cov: DataFrame) -> DataFrame:
    """(draw, i, j, value, vi, vj): each entry of a draw's one matrix with those of the diagonal in its row and column. A matrix is one row for a while, so rows are shuffled by draw once. Entries without the two, and null draws, have no row."""
    matrix = cov.where("draw IS NOT NULL").groupBy("draw").agg(F.collect_list(F.struct("i", "j", "value")).alias("m"))
    entries = F.transform(F.filter("m", lambda x: x["i"] == x["j"]), lambda x: F.struct(x["i"].alias("k"), x["value"].alias("v")))
    rows = matrix.select("draw", F.map_from_entries(F.array_distinct(entries)).alias("d"), F.inline("m"))
    return rows.where(F.map_contains_key("d", F.col("i")) & F.map_contains_key("d", F.col("j"))).select("draw", "i", "j", "value", F.col("d")[F.col("i")].alias("vi"), F.col("d")[F.col("j")].alias("vj"))


def covariance_summary(cov: DataFrame) -> DataFrame:
    """Per entry (i, j) over draws: mean, variance, share over 0, mean correlation and its mean square."""
    rows = _with_variances(cov).withColumn("r", F.col("value") / F.sqrt(F.col("vi") * F.col("vj")))
    return rows.groupBy("i", "j").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"), share(F.col("value") > 0).alias("pp"), F.avg("r").alias("r"), F.avg(F.col("r") * F.col("r")).alias("r2"))


def inverse(cov: DataFrame, dim: int) -> DataFrame:
    """(draw, i, j, value) of the inverse of each draw's matrix."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for batch in batches:
            m = np.linalg.inv(np.array(batch["cells"].tolist(), dtype=float).reshape(-1, dim, dim))
            n = len(m)
            yield pd.DataFrame({"draw": np.repeat(batch["draw"].to_numpy(), dim * dim), "i": np.tile(np.repeat(np.arange(dim), dim), n), "j": np.tile(np.arange(dim), n * dim), "value": m.reshape(-1)})

    rows = cov.groupBy("draw").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "j", "value"))), lambda x: x["value"]).alias("cells"))
    return rows.mapInPandas(run, "draw long, i int, j int, value double")


def precision_summary(inv: DataFrame) -> DataFrame:
    """Per entry of the inverse: mean, variance, share under 0, mean partial correlation and its mean square."""
    rows = _with_variances(inv).withColumn("r", F.when(F.col("i") == F.col("j"), 1.0).otherwise(-F.col("value") / F.sqrt(F.col("vi") * F.col("vj"))))
    return rows.groupBy("i", "j").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"), share(F.col("value") < 0).alias("pp"), F.avg("r").alias("r"), F.avg(F.col("r") * F.col("r")).alias("r2"))


def explained_variance(cov: DataFrame, inv: DataFrame) -> DataFrame:
    """Mean over draws of 1 - 1 / (cov_ii * inv_ii)."""
    a, b = (x.where("i = j").select("draw", "i", F.col("value").alias(n)) for x, n in ((cov, "c"), (inv, "p")))
    return a.join(b, ["draw", "i"]).groupBy("i").agg(F.avg(1 - 1 / (F.col("c") * F.col("p"))).alias("explained"))


def slope_summary(cov: DataFrame) -> DataFrame:
    """Per pair i < j: major-axis and regression slopes, mean, sd, and sorted[l], sorted[n - 1 - l] with l = int(.025 n)."""
    rows = _with_variances(cov).where("i < j").withColumnsRenamed({"vi": "sx", "vj": "sy"})
    d, sxy = F.col("sy") - F.col("sx"), F.col("value")
    rows = rows.withColumn("major", (d + F.sqrt(d * d + 4 * sxy * sxy)) / (2 * sxy)).withColumn("regression", sxy / F.col("sx"))
    long = rows.select("i", "j", F.expr("stack(2, 'major', major, 'regression', regression) AS (slope, v)"))
    few = ["i", "j", "slope"]
    moments = long.groupBy(*few).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.count(F.lit(1)).alias("n"))
    # sorted[l] and sorted[n - 1 - l]: a handful of keys, each dealt over tasks by ranges of its slopes
    ordered = running(long, ["v"], keys=few).withColumn("k", F.col("__rank") - 1).join(moments, few).withColumn("l", F.floor(0.025 * F.col("n")))
    return ordered.where((F.col("k") == F.col("l")) | (F.col("k") == F.col("n") - 1 - F.col("l"))).groupBy(*few, "mean", "sd").agg(F.min("v").alias("low"), F.max("v").alias("high"))


def posterior_predictive(replicates: DataFrame, observed: DataFrame) -> DataFrame:
    """(stat): mean and sd over replicates, z = (obs - mean) / sd, pp = P(pred > obs)."""
    rows = replicates.join(observed.withColumnRenamed("value", "obs"), "stat")
    g = rows.groupBy("stat").agg(F.first("obs").alias("obs"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), share(F.col("value") > F.col("obs")).alias("pp"))
    return g.withColumn("z", (F.col("obs") - F.col("mean")) / F.col("sd"))


def posterior_predictive_alt(replicates: DataFrame, observed: DataFrame, lower: tuple[str, ...] = ("diversity",)) -> DataFrame:
    """The same with z = (mean - obs) / sd, and pp = P(pred < obs) for the statistics in `lower`."""
    rows = replicates.join(observed.withColumnRenamed("value", "obs"), "stat")
    tail = F.when(F.col("stat").isin(*lower), F.col("value") < F.col("obs")).otherwise(F.col("value") > F.col("obs"))
    g = rows.groupBy("stat").agg(F.first("obs").alias("obs"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), share(tail).alias("pp"))
    return g.withColumn("z", (F.col("mean") - F.col("obs")) / F.col("sd"))


def predictive_statistics(codons: DataFrame, rep: str = "rep") -> DataFrame:
    """(rep, stat, value) of replicate alignments, codon rows (rep, site, taxon, aa): div, mean distinct amino acids over all sites; nconst,
    sites with exactly one; freq21, over variable sites the mean of the second largest count over the largest. One pass over (rep, site, aa)."""
    counts = codons.groupBy(rep, "site", "aa").agg(F.count(F.lit(1)).alias("n"))
    known = F.filter(F.collect_list(F.struct("n", "aa")), lambda x: x["aa"].isNotNull())
    site = counts.groupBy(rep, "site").agg(F.sort_array(known, asc=False).alias("c")).select(rep, F.size("c").alias("d"), (F.get("c", F.lit(1))["n"] / F.get("c", F.lit(0))["n"]).alias("r"))
    g = site.groupBy(rep).agg((F.sum("d") / F.count(F.lit(1))).alias("div"), F.count_if(F.col("d") == 1).cast("double").alias("nconst"), F.coalesce(F.avg("r"), F.lit(0.0)).alias("freq21"))
    return g.select(rep, F.expr("stack(3, 'div', div, 'nconst', nconst, 'freq21', freq21) AS (stat, value)"))


def replicate_statistics(codons: DataFrame) -> DataFrame:
    """(gene, stat, value) of alignments, codon rows (gene, site, taxon, codon, aa), each a replicate: diversity, mean distinct amino acids of a site; divergence and
    dnds, means over pairs of taxa of differing codons and of the non-synonymous share. Statistics without a value have no row."""
    by = aa_diversity(codons).select("gene", F.col("mean_diversity").alias("diversity")).join(pairwise_rates(codons), "gene", "full")
    return by.select("gene", F.expr("stack(3, 'diversity', diversity, 'divergence', divergence, 'dnds', dnds) AS (stat, value)")).where("value IS NOT NULL")


def attach_gene_names(rows: DataFrame, genes: DataFrame) -> DataFrame:
    """Rows by place in the list (ordinal) with the list's gene (ordinal, gene); a place that is in one of both alone is an error."""
    joined = rows.withColumn("__row", F.lit(True)).join(genes.select("ordinal", "gene"), "ordinal", "full")
    lost = F.when(F.col("gene").isNull(), F.raise_error(F.concat(F.lit("no gene at place "), F.col("ordinal")))).when(F.col("__row").isNull(), F.raise_error(F.concat(F.lit("no values for gene "), F.col("gene"))))
    return joined.withColumn("gene", F.coalesce(lost.cast("string"), F.col("gene"))).drop("__row")


def gene_places(rows: DataFrame, genes: DataFrame) -> DataFrame:
    """(ordinal, side) of the places that are in rows or in the gene list alone; empty if they agree."""
    a, b = rows.select("ordinal").distinct(), genes.select("ordinal").distinct()
    return a.join(b, "ordinal", "left_anti").withColumn("side", F.lit("rows")).union(b.join(a, "ordinal", "left_anti").withColumn("side", F.lit("list")))


def codeml_delta_ranking(pairs: DataFrame) -> DataFrame:
    """Genes by gain in log likelihood, falling."""
    return ranked(pairs, F.desc("delta"), "gene")


# Moments over genes, sites and components


def array_moments(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("var"))


def log_moments(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return rows.where(F.col(value) > 0).groupBy(*keys).agg(F.avg(F.ln(value)).alias("mean"), F.var_pop(F.ln(value)).alias("var"))


def zero_inflated_summary(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Zeros, and the mean of the others (0 if none)."""
    return rows.groupBy(*keys).agg(F.count_if(F.col(value) == 0).alias("n_zero"), F.coalesce(F.avg(F.when(F.col(value) != 0, F.col(value))), F.lit(0.0)).alias("mean_nonzero"))


def positive_fraction(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return rows.groupBy(*keys).agg(share(F.col(value) > 1).alias("fraction"))


def mean_entropy(rows: DataFrame, keys: list[str], item: list[str], p: str = "p") -> DataFrame:
    """Mean entropy of the probability vectors `item` by key."""
    from codonspark.functions.codons import entropy_term

    return rows.groupBy(*keys, *item).agg(F.sum(entropy_term(F.col(p))).alias("e")).groupBy(*keys).agg(F.avg("e").alias("mean_entropy"))


def multi_gene_length(rows: DataFrame) -> DataFrame:
    """Per iter, over (gene, branch, value): sum of branch means over genes, and summed variances over the number of genes."""
    branch = rows.groupBy("iter", "branch").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.count(F.lit(1)).alias("g"))
    return branch.groupBy("iter").agg(F.sum("m").alias("length"), (F.sum("v") / F.max("g")).alias("var"))


def profile_variance(rows: DataFrame) -> DataFrame:
    """Per cond, mean over sites of the variance over entries, and of that over the squared mean."""
    site = rows.groupBy("cond", "gene", "site").agg(F.var_pop("value").alias("v"), F.avg("value").alias("m"))
    return site.groupBy("cond").agg(F.avg("v").alias("mean_var"), F.avg(F.when(F.col("m") != 0, F.col("v") / (F.col("m") * F.col("m")))).alias("mean_relvar"))


def mask_width(rows: DataFrame) -> DataFrame:
    """Mean active entries of a site, by cond."""
    return rows.groupBy("cond", "gene", "site", "iter").agg(F.sum("mask").alias("w")).groupBy("cond").agg(F.avg("w").alias("width"))


def occupancy(alloc: DataFrame, weights: DataFrame) -> DataFrame:
    """Items of every component (component, weight), empty ones included, and n ln weight."""
    n = alloc.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return weights.join(n, "component", "left").select("component", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) * F.ln("weight")).alias("log_weight"))


def occupancy_totals(occupied: DataFrame) -> DataFrame:
    """Of occupancy rows: components with items, and the sum of n ln weight."""
    return occupied.agg(F.count_if(F.col("n") > 0).alias("n_clusters"), F.sum("log_weight").alias("log_prob"))


def occupancy_weighted_mean(alloc: DataFrame, values: DataFrame) -> DataFrame:
    """Per gene, mean of its sites' component values."""
    return alloc.join(values, "component").groupBy("gene").agg(F.avg("value").alias("mean"))
