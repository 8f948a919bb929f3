"""Alphabets, genetic codes and tables derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters, and the standard genetic codes in the usual order of codons, T C A G in each position.
NUCLEOTIDES = "ACGT"
RNA = "ACGU"
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
AMBIGUOUS_NUCLEOTIDES = "BDHKMNRSVWY"
AMBIGUOUS_AMINO_ACIDS = "BZX"
GAPS = "-?$.*X"
CODON_ORDER = "TCAG"
CODES = {
    "universal": "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    "mt_mammal": "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG",
    "mt_invertebrate": "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG",
}
# Composition, polarity and volume of the amino acids in alphabetical order, and their weights.
COMPOSITION = (0, 2.75, 1.38, 0.92, 0, 0.74, 0.58, 0, 0.33, 0, 0, 1.33, 0.39, 0.89, 0.65, 1.42, 0.71, 0, 0.13, 0.2)
POLARITY = (8.1, 5.5, 13.0, 12.3, 5.2, 9.0, 10.4, 5.2, 11.3, 4.9, 5.7, 11.6, 8.0, 10.5, 10.5, 9.2, 8.6, 5.9, 5.4, 6.2)
VOLUME = (31, 55, 54, 83, 132, 3, 96, 111, 119, 111, 105, 56, 32.5, 85, 124, 32, 61, 84, 170, 136)
DISTANCE_WEIGHTS = (1.833, 0.1018, 0.000399)


def codon_rows(code: str = "universal") -> list[tuple[str, int, str, int]]:
    """(codon, codon_id, aa, aa_id) of the codons that aren't stops; ids count them in codon order."""
    if code not in CODES:
        raise ValueError(f"unknown genetic code {code}")
    codons = [a + b + c for a in CODON_ORDER for b in CODON_ORDER for c in CODON_ORDER]
    kept = [(c, a) for c, a in zip(codons, CODES[code], strict=True) if a != "*"]
    return [(c, i, a, AMINO_ACIDS.index(a)) for i, (c, a) in enumerate(kept)]


def stop_codons(code: str = "universal") -> list[str]:
    """Codons that are stops."""
    kept = {row[0] for row in codon_rows(code)}
    return [a + b + c for a in CODON_ORDER for b in CODON_ORDER for c in CODON_ORDER if a + b + c not in kept]


def codon_table(spark: SparkSession, code: str = "universal") -> DataFrame:
    return spark.createDataFrame(codon_rows(code), "codon string, codon_id int, aa string, aa_id int")


def alphabet(spark: SparkSession, kind: str) -> DataFrame:
    """(symbol, state) of an alphabet, upper and lower case; legal symbols without a state have null."""
    letters, other = {"dna": (NUCLEOTIDES, AMBIGUOUS_NUCLEOTIDES), "rna": (RNA, AMBIGUOUS_NUCLEOTIDES), "protein": (AMINO_ACIDS, AMBIGUOUS_AMINO_ACIDS)}[kind]
    rows = {s: i for i, x in enumerate(letters) for s in (x, x.lower())}
    rows |= {s: None for x in other + GAPS for s in (x, x.lower()) if s not in rows}
    return spark.createDataFrame(sorted(rows.items()), "symbol string, state int")


def codon_neighbours(spark: SparkSession, code: str = "universal") -> DataFrame:
    """All pairs of codons: position is -1 for equal, 0 to 2 for one change there, 3 for several; with synonymous and gc_conservative."""
    t = codon_table(spark, code)
    a, b = (t.select(*[F.col(c).alias(f"{c}{i}") for c in t.columns]) for i in (1, 2))
    differ = [F.substring("codon1", i, 1) != F.substring("codon2", i, 1) for i in (1, 2, 3)]
    n = sum((d.cast("int") for d in differ[1:]), differ[0].cast("int"))
    position = F.when(n == 0, -1).when(n > 1, 3).when(differ[0], 0).when(differ[1], 1).otherwise(2)
    pairs = a.join(F.broadcast(b), F.lit(True)).withColumn("position", position)
    from_base = F.when(F.col("position").between(0, 2), F.substring("codon1", F.col("position") + 1, F.lit(1)))
    to_base = F.when(F.col("position").between(0, 2), F.substring("codon2", F.col("position") + 1, F.lit(1)))
    return (
        pairs.withColumn("from_base", from_base)
        .withColumn("to_base", to_base)
        .withColumn("synonymous", F.col("aa1") == F.col("aa2"))
        .withColumn("gc_conservative", F.coalesce(F.concat("from_base", "to_base").isin("AT", "TA", "CG", "GC"), F.lit(False)))
    )


def aa_distance(spark: SparkSession, weights: tuple[float, float, float] = DISTANCE_WEIGHTS) -> DataFrame:
    """(aa1, aa2, distance) of ordered pairs of different amino acids, over the mean of all pairs."""
    rows = list(zip(AMINO_ACIDS, map(float, COMPOSITION), map(float, POLARITY), map(float, VOLUME), strict=True))
    t = spark.createDataFrame(rows, "aa string, c double, p double, v double")
    a, b = (t.select(*[F.col(c).alias(f"{c}{i}") for c in t.columns]) for i in (1, 2))
    square = sum((w * (F.col(f"{x}1") - F.col(f"{x}2")) ** 2 for w, x in zip(weights[1:], "pv", strict=True)), weights[0] * (F.col("c1") - F.col("c2")) ** 2)
    pairs = a.join(F.broadcast(b), F.col("aa1") != F.col("aa2")).withColumn("d", F.sqrt(square))
    return pairs.join(F.broadcast(pairs.agg(F.avg("d").alias("m"))), F.lit(True)).select("aa1", "aa2", (F.col("d") / F.col("m")).alias("distance"))


def entropy_term(p: Column) -> Column:
    """-p ln p, 0 below 1e-6."""
    return F.when(p >= 1e-6, -p * F.ln(p)).otherwise(0.0)


def codon_of(first: Column, second: Column, third: Column) -> Column:
    return F.upper(F.concat(first, second, third))
