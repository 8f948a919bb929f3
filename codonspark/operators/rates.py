"""Codon-rate and fitness tables, as joins of small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gtr_rates(relrates: DataFrame, freqs: DataFrame) -> DataFrame:
    """(set, a, b, rate) of ordered pairs of bases: exchange rate (set, a, b unordered, r) times the frequency (set, base, freq) of the second; the diagonal is minus the row's sum."""
    both = relrates.select("set", "a", "b", "r").union(relrates.select("set", F.col("b"), F.col("a"), "r"))
    off = both.join(freqs.select("set", F.col("base").alias("b"), "freq"), ["set", "b"]).select("set", "a", "b", (F.col("r") * F.col("freq")).alias("rate"))
    return off.union(off.groupBy("set", "a").agg((-F.sum("rate")).alias("rate")).select("set", "a", F.col("a").alias("b"), "rate"))


def codon_stationary(codons: DataFrame, freqs: DataFrame) -> DataFrame:
    """(set, codon, aa, stat): product of base frequencies (set, base, freq), normalised over the codons that aren't stops."""
    out = codons
    rows = None
    for i in (1, 2, 3):
        f = freqs.select("set", F.col("base").alias(f"b{i}"), F.col("freq").alias(f"f{i}"))
        base = F.substring("codon", i, 1)
        out = out.withColumn(f"b{i}", base)
        rows = out.join(f, f"b{i}") if rows is None else rows.withColumn(f"b{i}", base).join(f, ["set", f"b{i}"])
    product = rows.select("set", "codon", "aa", (F.col("f1") * F.col("f2") * F.col("f3")).alias("x"))
    return product.select("set", "codon", "aa", (F.col("x") / F.sum("x").over(W.partitionBy("set"))).alias("stat"))


def mg_codon_rates(neighbours: DataFrame, nuc: DataFrame, omega: float) -> DataFrame:
    """(set, codon1, codon2, rate): nucleotide rate at the one differing position, times omega if the amino acid changes."""
    near = neighbours.where("position BETWEEN 0 AND 2").select("codon1", "codon2", "aa1", "aa2", "synonymous", F.col("from_base").alias("a"), F.col("to_base").alias("b"))
    return nuc.join(F.broadcast(near), ["a", "b"]).select("set", "codon1", "codon2", "aa1", "aa2", "synonymous", (F.col("rate") * F.when(F.col("synonymous"), 1.0).otherwise(omega)).alias("rate"))


def fixation(ds):
    """dS / (1 - exp(-dS)): about 1 near 0, dS above 50, 0 below -50."""
    small = F.abs(ds) < 1e-6
    return F.when(small, 1 + ds / 2).when(ds > 50, ds).when(ds < -50, 0.0).otherwise(ds / (1 - F.exp(-ds)))


def with_diagonal(rates: DataFrame, keys: list[str], a: str = "codon1", b: str = "codon2") -> DataFrame:
    """(keys, a, b, rate) with the diagonal, minus the sum of each row."""
    off = rates.select(*keys, a, b, "rate")
    return off.union(off.groupBy(*keys, a).agg((-F.sum("rate")).alias("rate")).select(*keys, a, F.col(a).alias(b), "rate"))


def checked_rows(rates: DataFrame, keys: list[str], a: str = "codon1", tolerance: float = 1e-6) -> DataFrame:
    """(keys, a, total) of rates with their diagonal; a row that doesn't sum to 0 within tolerance is an error."""
    rows = rates.groupBy(*keys, a).agg(F.sum("rate").alias("total"))
    return rows.withColumn("total", F.when(F.abs("total") > tolerance, F.raise_error(F.lit("a row of rates doesn't sum to 0")).cast("double")).otherwise(F.col("total")))


def _by_key(fitness: DataFrame) -> DataFrame:
    """(key, fit map<aa, fitness>): at most twenty entries a key."""
    return fitness.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("aa", "fitness"))).alias("fit"))


def mutsel_rates(neighbours: DataFrame, nuc: DataFrame, fitness: DataFrame, omega: float = 1.0) -> DataFrame:
    """(set, key, codon1, codon2, rate): mutation rate times the fixation of the difference in log fitness (key, aa, fitness), times omega if the amino acid changes.

    A key's fitness is one row, paired with the one row of each set's changes, so no key is joined by amino acid; which side is broadcast is left to Spark.
    """
    cell = F.struct("codon1", "codon2", "aa1", "aa2", "synonymous", "rate")
    sets = mg_codon_rates(neighbours, nuc, 1.0).groupBy("set").agg(F.collect_list(cell).alias("cells"))
    rows = _by_key(fitness).join(sets, F.lit(True)).select("set", "key", "fit", F.inline("cells"))
    s1, s2 = (F.ln(F.try_element_at("fit", F.col(f"aa{i}"))) for i in (1, 2))
    rate = F.col("rate") * fixation(s2 - s1) * F.when(F.col("synonymous"), 1.0).otherwise(omega)
    return rows.select("set", "key", "codon1", "codon2", "aa1", "aa2", "synonymous", F.col("rate").alias("mutation"), rate.alias("rate")).where("rate IS NOT NULL")


def mutsel_stationary(stationary: DataFrame, fitness: DataFrame) -> DataFrame:
    """(set, key, codon, stat): the base product of a codon (set, codon, aa, stat) times its amino acid's fitness, normalised."""
    sets = stationary.groupBy("set").agg(F.collect_list(F.struct("codon", "aa", "stat")).alias("cells"))
    rows = _by_key(fitness).join(sets, F.lit(True))
    weight = F.transform("cells", lambda c: F.struct(c["codon"].alias("codon"), (c["stat"] * F.coalesce(F.try_element_at("fit", c["aa"]), F.lit(0.0))).alias("w")))
    total = F.aggregate("w", F.lit(0.0), lambda t, c: t + c["w"])
    return rows.select("set", "key", weight.alias("w")).withColumn("total", total).select("set", "key", "total", F.inline("w")).select("set", "key", "codon", (F.col("w") / F.col("total")).alias("stat"))


def predicted_dnds(mutation: DataFrame, stationary: DataFrame, fitness: DataFrame) -> DataFrame:
    """Per (set, key): flux of fixed over that of all non-synonymous mutations, at the stationary law base product times fitness.

    mutation: codon rates before selection. Codons of a set are summed to pairs of amino acids first, which is all that selection sees, so a key meets some 150 pairs in its row.
    """
    s = stationary.select("set", F.col("codon").alias("codon1"), "stat")
    pairs = mutation.where(~F.col("synonymous")).join(s, ["set", "codon1"]).groupBy("set", "aa1", "aa2").agg(F.sum(F.col("stat") * F.col("rate")).alias("m"))
    sets = pairs.groupBy("set").agg(F.collect_list(F.struct("aa1", "aa2", "m")).alias("cells"))
    at = lambda a: F.try_element_at("fit", a)
    flux = F.transform("cells", lambda c: F.struct((at(c["aa1"]) * c["m"]).alias("all"), (at(c["aa1"]) * c["m"] * fixation(F.ln(at(c["aa2"])) - F.ln(at(c["aa1"])))).alias("fixed")))
    sums = F.aggregate(F.filter("flux", lambda x: x["fixed"].isNotNull()), F.struct(F.lit(0.0).alias("all"), F.lit(0.0).alias("fixed")), lambda t, x: F.struct((t["all"] + x["all"]).alias("all"), (t["fixed"] + x["fixed"]).alias("fixed")))
    rows = _by_key(fitness).join(sets, F.lit(True)).select("set", "key", flux.alias("flux")).select("set", "key", sums.alias("x"))
    return rows.select("set", "key", (F.col("x.fixed") / F.col("x.all")).alias("dnds"))


def mean_codon_stationary(stationary: DataFrame, weights: DataFrame) -> DataFrame:
    """(codon, stat) of a mixture of processes `set` with weights (set, w) that sum to 1."""
    return stationary.join(weights, "set").groupBy("codon").agg(F.sum(F.col("w") * F.col("stat")).alias("stat"))


def aa_projected_rates(rates: DataFrame, stationary: DataFrame) -> DataFrame:
    """(set, aa1, aa2, rate): codon rates summed to amino acids, rows weighted by the stationary law of codons inside an amino acid."""
    s = stationary.select("set", F.col("codon").alias("codon1"), "stat")
    total = stationary.groupBy("set", F.col("aa").alias("aa1")).agg(F.sum("stat").alias("t"))
    rows = rates.where("aa1 <> aa2").join(s, ["set", "codon1"]).groupBy("set", "aa1", "aa2").agg(F.sum(F.col("stat") * F.col("rate")).alias("flux"))
    return rows.join(total, ["set", "aa1"]).select("set", "aa1", "aa2", (F.col("flux") / F.col("t")).alias("rate"))


def mean_codon_rates(rates: DataFrame, stationary: DataFrame, weights: DataFrame) -> DataFrame:
    """(codon1, codon2, rate): mixture of processes `set` with weights (set, w): sum of w * stat * rate over sum of w * stat."""
    s = stationary.join(weights, "set").select("set", F.col("codon").alias("codon1"), (F.col("w") * F.col("stat")).alias("ws"))
    total = s.groupBy("codon1").agg(F.sum("ws").alias("t"))
    flux = rates.join(s, ["set", "codon1"]).groupBy("codon1", "codon2").agg(F.sum(F.col("ws") * F.col("rate")).alias("flux"))
    return flux.join(total, "codon1").select("codon1", "codon2", (F.col("flux") / F.col("t")).alias("rate"))


def grid_mixture(rates: DataFrame, stationary: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """(codon1, codon2, x): the mixture of a grid of processes, not normalised: sum of both weights * stat * rate, and with codon2 null that of both weights * stat.

    rates (set, key, codon1, codon2, rate) and stationary (set, key, codon, stat) are the processes, rows (set, w) and columns (key, w) their weights; a process whose row or
    column has no weight is out. Entries are sums, so mixtures of some rows or columns add up (add_mixtures). A grid is summed inside its tasks to one row for each pair of codons before it is shuffled.
    """
    weights = rows.select("set", F.col("w").alias("wr")), columns.select("key", F.col("w").alias("wc"))
    s = stationary.join(weights[0], "set").join(weights[1], "key").select("set", "key", F.col("codon").alias("codon1"), (F.col("wr") * F.col("wc") * F.col("stat")).alias("ws"))
    flux = rates.join(s, ["set", "key", "codon1"]).select("codon1", "codon2", (F.col("ws") * F.col("rate")).alias("x"))
    return add_mixtures(flux.union(s.select("codon1", F.lit(None).cast("string").alias("codon2"), F.col("ws").alias("x"))))


def add_mixtures(mixture: DataFrame, other: DataFrame | None = None, sign: int = 1) -> DataFrame:
    """A mixture with another one, as that of a row or column, added (sign 1) or taken out (sign -1)."""
    both = mixture if other is None else mixture.union(other.select("codon1", "codon2", (F.col("x") * sign).alias("x")))
    return both.groupBy("codon1", "codon2").agg(F.sum("x").alias("x"))


def mixture_rates(mixture: DataFrame) -> DataFrame:
    """(codon1, codon2, rate) of a mixture: its sums over those of the first codon's stat; null where no process has that codon."""
    total = mixture.where("codon2 IS NULL").select("codon1", F.col("x").alias("t"))
    return mixture.where("codon2 IS NOT NULL").join(total, "codon1").select("codon1", "codon2", F.try_divide("x", "t").alias("rate"))


def selac_profiles(distance: DataFrame, classes: DataFrame, psi: float) -> DataFrame:
    """(class, optimum, aa, p): 1 at the optimum, 1e-8 + exp(-psi * g * distance) elsewhere, normalised; classes are (class, g)."""
    e = psi * F.col("g") * F.col("distance")
    other = classes.join(F.broadcast(distance), F.lit(True)).select("class", F.col("aa1").alias("optimum"), F.col("aa2").alias("aa"), (1e-8 + F.when(e < 100, F.exp(-e)).otherwise(0.0)).alias("x"))
    own = other.select("class", "optimum").distinct().select("class", "optimum", F.col("optimum").alias("aa"), F.lit(1.0).alias("x"))
    rows = own.union(other)
    return rows.select("class", "optimum", "aa", (F.col("x") / F.sum("x").over(W.partitionBy("class", "optimum"))).alias("p"))


def empirical_selac_profiles(fitness: DataFrame, classes: DataFrame, psi: float) -> DataFrame:
    """(class, key, aa, p): 1e-50 + exp(psi * g * ln fitness), normalised over the amino acids of a key."""
    e = -psi * F.col("g") * F.ln("fitness")
    rows = fitness.join(classes, F.lit(True)).select("class", "key", "aa", (1e-50 + F.when(e < 100, F.exp(-e)).otherwise(0.0)).alias("x"))
    return rows.select("class", "key", "aa", (F.col("x") / F.sum("x").over(W.partitionBy("class", "key"))).alias("p"))


def condition_fitness(baseline: DataFrame, deltas: DataFrame, two_levels: bool = False) -> DataFrame:
    """(key, cond, aa, p): baseline (key, aa, fitness) times exp of the condition's delta (key, cond, aa, delta), with two levels also of condition 1's, normalised."""
    rows = deltas.join(baseline, ["key", "aa"])
    if two_levels:
        first = deltas.where("cond = 1").select("key", "aa", F.col("delta").alias("d1"))
        rows = rows.join(first, ["key", "aa"], "left").withColumn("delta", F.col("delta") + F.when(F.col("cond") > 1, F.coalesce("d1", F.lit(0.0))).otherwise(0.0))
    x = F.col("fitness") * F.when(F.col("cond") == 0, 1.0).otherwise(F.exp("delta"))
    rows = rows.withColumn("x", x)
    return rows.select("key", "cond", "aa", (F.col("x") / F.sum("x").over(W.partitionBy("key", "cond"))).alias("p"))
