"""Additive sufficient statistics of substitution histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codonspark.functions.shared import by_few


def path_suffstat(path: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(waiting (keys, state, t), pairs (keys, from_state, to_state, n)) of paths (gene, site, branch, seg, state, t)."""
    order = W.partitionBy("gene", "site", "branch").orderBy("seg")
    waiting = path.groupBy(*keys, "state").agg(F.sum("t").alias("t"))
    steps = path.withColumn("to_state", F.lead("state").over(order)).where("to_state IS NOT NULL AND to_state <> state")
    return waiting, steps.groupBy(*keys, F.col("state").alias("from_state"), "to_state").agg(F.count(F.lit(1)).alias("n"))


def scaled_path(path: DataFrame, lengths: DataFrame, rates: DataFrame, informative: DataFrame | None = None) -> DataFrame:
    """path (gene, site, branch, seg, state, rel_time) with t = rel_time * branch length * site rate, from (branch, branch_length) and (gene, site, rate).

    informative (gene, site, branch, flag) keeps the paths whose node has flag 1: those that lead to known leaves.
    """
    if informative is not None:
        path = path.join(informative.where("flag = 1").select("gene", "site", "branch"), ["gene", "site", "branch"], "left_semi")
    rows = by_few(path, lengths.select("branch", "branch_length"), "branch").join(rates.select("gene", "site", "rate"), ["gene", "site"])
    return rows.withColumn("t", F.col("rel_time") * F.col("branch_length") * F.col("rate")).drop("branch_length", "rate")


def root_counts(path: DataFrame, informative: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state, n): the last state of the path to each node with flag 2, the root of what is known at a site."""
    roots = path.join(informative.where("flag = 2").select("gene", "site", "branch"), ["gene", "site", "branch"], "left_semi")
    last = roots.groupBy("gene", "site", "branch").agg(F.max_by("state", "seg").alias("state"))
    return last.groupBy(*keys, "state").agg(F.count(F.lit(1)).alias("n"))


def nuc_root_counts(roots: DataFrame, codons: DataFrame) -> DataFrame:
    """(base, n) over the three positions of the codons at roots (state, n)."""
    bases = codons.select(F.col("codon_id").alias("state"), F.explode(F.split("codon", "")).alias("base")).where("base <> ''")
    return roots.join(bases, "state").groupBy("base").agg(F.sum("n").alias("n"))


def length_suffstat(path: DataFrame, rates: DataFrame, keys: list[str], factor: str | None = None) -> DataFrame:
    """Per key: events and the sum of waiting time times the rate out of the state (rates: state, out).

    One pass over the path: a state without rate adds no time, and a key without any rate has no row. By branch or by site: `factor` names a column of path that its times are to be multiplied by, as the site's rate for branches or the branch's length for sites.
    """
    path = path.withColumn("t", F.col("t") * F.col(factor)) if factor else path
    order = W.partitionBy("gene", "site", "branch").orderBy("seg")
    event = F.col("state") != F.lead("state").over(order)
    rows = path.select(*dict.fromkeys(["gene", "site", "branch", "seg", *keys]), "state", "t").withColumn("event", F.when(event, 1).otherwise(0)).select(*keys, "state", "t", "event")
    rows = rows.join(rates.select("state", "out", F.lit(1).alias("rated")), "state", "left")
    summed = rows.groupBy(*keys).agg(F.sum(F.col("t") * F.col("out")).alias("beta"), F.sum("event").alias("count"), F.count("rated").alias("rated"))
    return summed.where("rated > 0").drop("rated")


def ds_omega_suffstat(waiting: DataFrame, pairs: DataFrame, neighbours: DataFrame, keys: list[str], omega: float = 1.0, only: str | None = None) -> DataFrame:
    """Per key: nsyn, nnonsyn, and exposures bsyn, bnonsyn (the latter over omega) from codon rates (codon_id1, codon_id2, synonymous, gc_conservative, rate); `only` names a flag to restrict changes to."""
    near = neighbours.where("position BETWEEN 0 AND 2")
    near = near.where(F.col(only)) if only else near
    out = near.groupBy(F.col("codon_id1").alias("state")).agg(F.sum(F.when(F.col("synonymous"), F.col("rate")).otherwise(0.0)).alias("rs"), F.sum(F.when(F.col("synonymous"), 0.0).otherwise(F.col("rate"))).alias("rn"))
    exposure = waiting.join(F.broadcast(out), "state").groupBy(*keys).agg(F.sum(F.col("t") * F.col("rs")).alias("bsyn"), F.sum(F.col("t") * F.col("rn") / omega).alias("bnonsyn"))
    kind = near.select(F.col("codon_id1").alias("from_state"), F.col("codon_id2").alias("to_state"), "synonymous")
    counts = pairs.join(F.broadcast(kind), ["from_state", "to_state"]).groupBy(*keys).agg(F.sum(F.when(F.col("synonymous"), F.col("n")).otherwise(0)).alias("nsyn"), F.sum(F.when(F.col("synonymous"), 0).otherwise(F.col("n"))).alias("nnonsyn"))
    return exposure.join(counts, keys, "left").select(*keys, F.coalesce("nsyn", F.lit(0)).alias("nsyn"), F.coalesce("nnonsyn", F.lit(0)).alias("nnonsyn"), "bsyn", "bnonsyn")


def nuc_suffstat(waiting: DataFrame, pairs: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(from_base, to_base, n, beta): single-position changes and exposures summed over codons."""
    near = neighbours.where("position BETWEEN 0 AND 2").select(F.col("codon_id1").alias("from_state"), F.col("codon_id2").alias("to_state"), "from_base", "to_base", "rate")
    n = pairs.join(F.broadcast(near), ["from_state", "to_state"]).groupBy("from_base", "to_base").agg(F.sum("n").alias("n"))
    t = waiting.groupBy(F.col("state").alias("from_state")).agg(F.sum("t").alias("t"))
    beta = F.broadcast(near).join(t, "from_state").groupBy("from_base", "to_base").agg(F.sum("t").alias("beta"))
    return beta.join(n, ["from_base", "to_base"], "left").select("from_base", "to_base", F.coalesce("n", F.lit(0)).alias("n"), "beta")


def relrate_suffstat(nuc: DataFrame) -> DataFrame:
    """Exchange counts and exposures of unordered pairs."""
    return nuc.groupBy(F.least("from_base", "to_base").alias("a"), F.greatest("from_base", "to_base").alias("b")).agg(F.sum("n").alias("n"), F.sum("beta").alias("beta"))


def gamma_suffstat(rows: DataFrame, keys: list[str], value: str = "value", where: str | None = None) -> DataFrame:
    """Sum, sum of ln, and number of positive values; `where` names an occupancy, probability or mask, and values count where it isn't 0."""
    rows = rows.where((F.col(where) != 0) & F.col(where).isNotNull()) if where else rows
    return rows.where(F.col(value) > 0).groupBy(*keys).agg(F.sum(value).alias("sum"), F.sum(F.ln(value)).alias("sum_log"), F.count(F.lit(1)).alias("n"))


def merge_suffstats(rows: DataFrame, keys: list[str], stats: list[str], scale: float = 1.0) -> DataFrame:
    return rows.groupBy(*keys).agg(*[(F.sum(s) * scale).alias(s) for s in stats])


def merge_by_allocation(rows: DataFrame, alloc: DataFrame, stats: list[str]) -> DataFrame:
    """Sums of site statistics by mixture component."""
    return rows.join(alloc, ["gene", "site"]).groupBy("component").agg(*[F.sum(s).alias(s) for s in stats])


def branch_dnds(rows: DataFrame, pseudo: float = 0.0) -> DataFrame:
    """Adds ds, dn and dnds; dnds is 0 where an exposure or the synonymous count is 0."""
    ns, nn, bs, bn = (F.col(c) for c in ("nsyn", "nnonsyn", "bsyn", "bnonsyn"))
    ns, nn = ns + pseudo, nn + pseudo
    zero = (bs == 0) | (bn == 0) | (ns == 0)
    return rows.withColumn("ds", F.when(bs != 0, ns / bs).otherwise(0.0)).withColumn("dn", F.when(bn != 0, nn / bn).otherwise(0.0)).withColumn("dnds", F.when(zero, 0.0).otherwise((nn / bn) / (ns / bs)))


def poisson_logprob(count: Column, beta: Column, rate: Column) -> Column:
    return count * F.ln(rate) - beta * rate


def lgamma(x: Column) -> Column:
    """ln gamma for x > 0: Stirling's series after seven steps up, a Spark expression."""
    z = x + 7.0
    steps = sum((F.ln(x + float(i)) for i in range(1, 7)), F.ln(x))
    return (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - steps


def gamma_marginal_logprob(count: Column, beta: Column, shape: float, scale: float) -> Column:
    """Poisson statistics with the rate integrated over a gamma law."""
    a, b = F.lit(shape), F.lit(scale)
    return a * F.ln(b) - lgamma(a) - (a + count) * F.ln(b + beta) + lgamma(a + count)


def ds_omega_logprob(rows: DataFrame, ds: Column, omega: Column, nu: float | None = None, integrated: str | None = None) -> DataFrame:
    """Adds logprob of dS/omega statistics at rate ds and omega. integrated: `ds` or `omega`, over which a gamma law of mean 1 and shape 1 / nu is integrated."""
    ns, nn, bs, bn = (F.col(c) for c in ("nsyn", "nnonsyn", "bsyn", "bnonsyn"))
    seen = (ns + nn) * F.ln(ds) + nn * F.ln(omega)
    if integrated is None:
        return rows.withColumn("logprob", seen - ds * (bs + bn * omega))
    a = F.lit(1.0 / nu)
    count, beta, rest = (ns + nn, ds * (bs + bn * omega), F.lit(0.0)) if integrated == "ds" else (nn, ds * bn * omega, -ds * bs)
    return rows.withColumn("logprob", a * F.ln(a) - lgamma(a) - (a + count) * F.ln(a + beta) + lgamma(a + count) + seen + rest)


def mixture_post_prob(rows: DataFrame, purom: float, posom: float, purw: float, posw: float) -> DataFrame:
    """Posterior of three omega classes (purom, 1, posom) and log marginal from (count, beta); classes without weight are left out of the maximum."""
    weights = (purw * (1 - posw), (1 - purw) * (1 - posw), posw)
    logs = [F.when(F.lit(w > 0), F.ln(F.lit(w if w > 0 else 1.0)) + poisson_logprob(F.col("count"), F.col("beta"), F.lit(float(om)))) for w, om in zip(weights, (purom, 1.0, posom), strict=True)]
    top = F.greatest(*logs)
    terms = [F.coalesce(F.exp(x - F.col("top")), F.lit(0.0)) for x in logs]
    out = rows.withColumn("top", top).withColumn("terms", F.array(*terms)).withColumn("total", F.aggregate("terms", F.lit(0.0), lambda a, x: a + x))
    return out.select(*rows.columns, *[(F.col("terms")[i] / F.col("total")).alias(n) for i, n in enumerate(("p_pur", "p_neutral", "p_pos"))], (F.col("top") + F.ln("total")).alias("log_marginal"))
