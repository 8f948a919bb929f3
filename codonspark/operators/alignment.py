"""Alignments: encoding, codons, column filters, column and pair statistics.

Long tables are (gene, taxon, site, state) or (gene, taxon, site, codon); missing is null.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codonspark.functions.codons import AMINO_ACIDS, NUCLEOTIDES, alphabet, codon_table, stop_codons
from codonspark.functions.shared import by_few, freed_shuffles, removed, running, shared_path, staged


def detect_alphabet(wide: DataFrame) -> DataFrame:
    """(gene, kind): dna if every symbol is in the DNA set, else rna, else protein, else null. Sets are tested in the row, so no symbol is shuffled."""
    kinds = {"dna": "ACGT", "rna": "ACGU"}
    fits = {k: ~F.col("seq").rlike(f"(?i)[^{v}BDHKMNRSVWYX$.?*-]") for k, v in kinds.items()}
    fits["protein"] = ~F.col("seq").rlike(f"(?i)[^{AMINO_ACIDS}BZX$.?*-]")
    all_ = wide.groupBy("gene").agg(*[F.bool_and(F.coalesce(c, F.lit(True))).alias(k) for k, c in fits.items()])
    return all_.select("gene", F.when(F.col("dna"), "dna").when(F.col("rna"), "rna").when(F.col("protein"), "protein").alias("kind"))


def encode_states(wide: DataFrame, kind: str = "dna") -> DataFrame:
    """(gene, taxon, seq) to (gene, taxon, site, state); an illegal symbol is an error."""
    symbols = wide.select("gene", "taxon", F.posexplode(F.split("seq", "")).alias("site", "symbol")).where("symbol <> ''")
    table = alphabet(wide.sparkSession, kind).withColumn("known", F.lit(True))
    joined = symbols.join(F.broadcast(table), "symbol", "left")
    state = F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("illegal symbol "), "symbol"))).otherwise(F.col("state"))
    return joined.select("gene", "taxon", F.col("site").cast("long").alias("site"), state.cast("int").alias("state"))


def decode_states(long: DataFrame, letters: str = NUCLEOTIDES) -> DataFrame:
    """Adds symbol: the state's letter, - for missing."""
    return long.withColumn("symbol", F.coalesce(F.substring(F.lit(letters), F.col("state") + 1, F.lit(1)), F.lit("-")))


def make_codons(wide: DataFrame, frame: int = 0, code: str = "universal") -> DataFrame:
    """(gene, taxon, site, codon, aa, stop): codons read in the row, without a shuffle; missing bases and stops give a null codon. A length that isn't a multiple of 3 is an error."""
    seq = F.upper(F.substring("seq", frame + 1, 1 << 30))
    checked = F.when(F.length(seq) % 3 == 0, seq).otherwise(F.raise_error(F.lit("sequence length is not a multiple of 3")))
    triplets = F.regexp_extract_all("s", F.lit("(?s).{3}"), F.lit(0))  # one walk over the sequence
    rows = wide.withColumn("s", checked).where("length(s) > 0").select("gene", "taxon", F.posexplode(triplets).alias("site", "triplet"))
    table = codon_table(wide.sparkSession, code).select("codon", "aa")
    joined = rows.join(F.broadcast(table), rows["triplet"] == table["codon"], "left")
    return joined.select("gene", "taxon", F.col("site").cast("long").alias("site"), "triplet", "codon", "aa", (F.col("codon").isNull() & F.col("triplet").rlike("^[ACGT]{3}$")).alias("stop"))


def is_stop(first: Column, second: Column, third: Column, code: str = "universal") -> Column:
    """Whether three bases are a stop of the code; false if any is missing."""
    return F.coalesce(F.upper(F.concat(first, second, third)).isin(*stop_codons(code)), F.lit(False))


def report_stops(codons: DataFrame) -> DataFrame:
    """Stops met: taxon, codon number and first nucleotide, both from 1."""
    return codons.where("stop").select("gene", "taxon", (F.col("site") + 1).alias("codon_number"), (3 * F.col("site") + 1).alias("first_nucleotide"), "triplet")


def translate(codons: DataFrame, code: str = "universal") -> DataFrame:
    """Adds aa and codon_id to (…, codon); stops and missing get null."""
    return codons.join(F.broadcast(codon_table(codons.sparkSession, code).select("codon", "codon_id", "aa")), "codon", "left")


def ry_recode(long: DataFrame) -> DataFrame:
    """Purines (A, G) 0, pyrimidines (C, T) 1."""
    return long.withColumn("ry", F.when(F.col("state").isin(0, 2), 0).when(F.col("state").isin(1, 3), 1))


def _base_reader(position: int, stops: Sequence[str]) -> Callable[[str | None], np.ndarray]:
    """A function from a sequence to the letters of one position of its codons, - where the codon is missing or a stop."""
    digits = bytes("ACGT".find(chr(i)) if chr(i) in "ACGT" else 4 for i in range(256))
    letter = np.full(125, ord("-"), dtype=np.uint8)
    for codon in itertools.product("ACGT", repeat=3):
        if "".join(codon) not in stops:
            letter[sum("ACGT".find(x) * 5 ** (2 - i) for i, x in enumerate(codon))] = ord(codon[position])

    def read(seq: str | None) -> np.ndarray:
        code = np.frombuffer((seq or "").upper().encode("ascii", "replace").translate(digits), dtype=np.uint8)
        code = code[: len(code) // 3 * 3].reshape(-1, 3)
        return letter[code[:, 0] * 25 + code[:, 1] * 5 + code[:, 2]]

    return read


def codon_position(wide: DataFrame, position: int, drop_missing: bool = False, code: str = "universal") -> DataFrame:
    """Sequences of one codon position (0, 1 or 2). drop_missing: codons that are missing or a stop give -, and columns without any known codon go."""
    if not drop_missing:
        at = F.filter(F.split("seq", ""), lambda x, i: (i % 3 == position) & (x != ""))
        return wide.select("gene", "taxon", F.array_join(at, "").alias("seq"))
    # the columns of a gene that some taxon knows: a bit each, merged inside batches, then by gene and 64 columns
    gene, taxon = (wide.schema[c].dataType.simpleString() for c in ("gene", "taxon"))
    bases = _base_reader(position, stop_codons(code))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array([bases(x.as_py()).tobytes().decode() for x in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], names=["gene", "taxon", "seq"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict = {}
            for g, seq in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(seq.as_py().encode(), dtype=np.uint8) != ord("-")
                held = known.get(g, own[:0])
                if len(held) < len(own):
                    held = np.concatenate([held, np.zeros(len(own) - len(held), dtype=bool)])
                held[: len(own)] |= own
                known[g] = held
            for g, held in known.items():
                bits = np.packbits(np.concatenate([held, np.zeros(-len(held) % 64, dtype=bool)]), bitorder="little").view(np.int64)
                word = np.flatnonzero(bits)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(word), batch.schema.field(0).type), pa.array(word.astype(np.int32)), pa.array(bits[word])], names=["gene", "word", "bits"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for seq, words, bits in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                own = np.frombuffer(seq.as_py().encode(), dtype=np.uint8)
                mask = np.zeros(-(-len(own) // 64), dtype=np.int64)
                if words.is_valid:
                    at, held = words.values.to_numpy(), bits.values.to_numpy()
                    near = at < len(mask)
                    mask[at[near]] = held[near]
                out.append(own[np.unpackbits(mask.view(np.uint8), count=len(own), bitorder="little").astype(bool)].tobytes().decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["gene", "taxon", "seq"])

    found = staged(wide.select("gene", "taxon", "seq").mapInArrow(read, f"gene {gene}, taxon {taxon}, seq string"))  # read twice
    words = found.select("gene", "seq").mapInArrow(marked, f"gene {gene}, word int, bits long").groupBy("gene", "word").agg(F.bit_or("bits").alias("bits"))
    masks = words.groupBy("gene").agg(F.collect_list(F.struct("word", "bits")).alias("mask")).select("gene", "mask.word", "mask.bits")
    rows = found.join(masks, "gene", "left").select("gene", "taxon", "seq", "word", "bits")
    return rows.mapInArrow(kept, f"gene {gene}, taxon {taxon}, seq string")


def column_flags(long: DataFrame, value: str = "state") -> DataFrame:
    """Per (gene, site): n_rows, n_known, n_states and the flags all_missing, complete, constant."""
    g = long.groupBy("gene", "site").agg(F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("n_known"), F.count_distinct(value).alias("n_states"))
    return g.select("*", (F.col("n_known") == 0).alias("all_missing"), (F.col("n_known") == F.col("n_rows")).alias("complete"), (F.col("n_states") <= 1).alias("constant"))


def drop_missing_taxa(long: DataFrame, value: str = "state") -> DataFrame:
    """Rows of taxa with a known state."""
    return long.join(long.where(F.col(value).isNotNull()).select("gene", "taxon").distinct(), ["gene", "taxon"], "left_semi")


def taxa_counts(long: DataFrame, value: str = "state") -> DataFrame:
    """(gene, ntaxa): taxa with a known state, the number that an alignment has once the others are dropped."""
    return long.groupBy("gene").agg(F.count_distinct(F.when(F.col(value).isNotNull(), F.col("taxon"))).alias("ntaxa"))


def complete_triplets(long: DataFrame, value: str = "state", frame: int = 0) -> DataFrame:
    """Rows of the codons whose three columns have no missing state. A codon's rows are dealt once, and its places are three bits."""
    triplet = F.floor((F.col("site") - frame) / 3)
    rows = long.where((F.col("site") >= frame) & F.col("gene").isNotNull()).withColumn("triplet", triplet)
    own = W.partitionBy("gene", "triplet")
    places = F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("site") - frame - 3 * F.col("triplet")).cast("int"))).over(own)
    whole = F.min(F.col(value).isNotNull().cast("int")).over(own)
    return rows.withColumns({"__places": places, "__whole": whole}).where("__places = 7 AND __whole = 1").select("gene", "triplet", *[c for c in long.columns if c != "gene"])


def restrict_taxa(long: DataFrame, taxa: DataFrame) -> DataFrame:
    return long.join(taxa.select("taxon"), "taxon", "left_semi")


def duplicate_taxa(taxa: DataFrame) -> DataFrame:
    """Names met more than once in a gene; any row is an error of the data."""
    return taxa.groupBy("gene", "taxon").count().where("count > 1")


def match_taxa_prefix(names: DataFrame, taxa: DataFrame) -> DataFrame:
    """(name, taxon, n): the one taxon that starts with a name, else the one that is a prefix of it; n over 1 is ambiguous.

    Both are equality joins: names' prefixes of every length are matched with whole names.
    """
    prefixes = lambda df, c: df.select(c, F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(F.col(c), F.lit(1), i))).alias("p"))
    longer = names.join(prefixes(taxa, "taxon"), F.col("name") == F.col("p")).select("name", "taxon")
    shorter = prefixes(names, "name").join(taxa, F.col("p") == F.col("taxon")).select("name", "taxon")
    one = lambda df: df.groupBy("name").agg(F.min("taxon").alias("taxon"), F.count(F.lit(1)).alias("n"))
    first = one(longer)
    return first.union(one(shorter.join(first, "name", "left_anti")))


def state_frequencies(long: DataFrame, states: int = 4) -> DataFrame:
    """Share of each state among the known of a gene; states not met are 0."""
    counts = long.where("state IS NOT NULL").groupBy("gene", "state").agg(F.count(F.lit(1)).alias("n"))
    # one row for each gene and state, then the zero states are filled in from an array, without another shuffle of the data
    by = counts.groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct("state", "n"))).alias("m"), F.sum("n").alias("total"))
    return by.select("gene", "total", F.explode(F.sequence(F.lit(0), F.lit(states - 1))).alias("state"), "m").select("gene", "state", (F.coalesce(F.try_element_at("m", F.col("state")), F.lit(0)) / F.col("total")).alias("freq"))


def site_aa_counts(aa: DataFrame) -> DataFrame:
    """(gene, site, aa, n) of 20 amino acids for every site, zeros included."""
    counted = [F.count_if(F.col("aa") == a).alias(a) for a in AMINO_ACIDS]
    wide = aa.groupBy("gene", "site").agg(*counted)
    return wide.select("gene", "site", F.explode(F.array(*[F.struct(F.lit(a).alias("aa"), F.col(a).alias("n")) for a in AMINO_ACIDS])).alias("x")).select("gene", "site", "x.aa", "x.n")


def aa_diversity(aa: DataFrame) -> DataFrame:
    """Per gene: mean distinct amino acids over all sites, and the number of sites with exactly one."""
    site = aa.groupBy("gene", "site").agg(F.count_distinct("aa").alias("d"))
    return site.groupBy("gene").agg((F.sum("d") / F.count(F.lit(1))).alias("mean_diversity"), F.count_if(F.col("d") == 1).alias("n_constant"))


def second_first_ratio(aa: DataFrame) -> DataFrame:
    """Per gene: mean over variable sites of the second largest count over the largest; 0 if none."""
    counts = aa.where("aa IS NOT NULL").groupBy("gene", "site", "aa").agg(F.count(F.lit(1)).alias("n"))
    top = counts.withColumn("k", F.row_number().over(W.partitionBy("gene", "site").orderBy(F.desc("n"), "aa"))).where("k <= 2")
    site = top.groupBy("gene", "site").agg(F.max(F.when(F.col("k") == 1, F.col("n"))).alias("a"), F.max(F.when(F.col("k") == 2, F.col("n"))).alias("b"))
    return site.groupBy("gene").agg(F.coalesce(F.avg(F.col("b") / F.col("a")), F.lit(0.0)).alias("ratio"))


def taxon_pairs(codons: DataFrame, block_sites: int = 256) -> DataFrame:
    """Known codons of two taxa at one site, taxon1 before taxon2.

    Rows go to blocks of sites of a gene, once; there a site's taxa are one array, whose pairs are made in the row, each once. A block holds a gene's
    neighbouring sites, so that counts by pair of taxa are nearly done before they are shuffled.
    """
    known = codons.where("codon IS NOT NULL").select("gene", "site", "taxon", "codon", "aa").withColumn("__block", F.floor(F.col("site") / block_sites))
    site = known.repartition("gene", "__block").groupBy("gene", "__block", "site").agg(F.sort_array(F.collect_list(F.struct("taxon", "codon", "aa"))).alias("all"))
    first = site.select("gene", "site", "all", F.posexplode("all").alias("i", "x"))
    both = first.select("gene", "site", "x", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("y")).where("x.taxon < y.taxon")
    return both.select("gene", "site", *[F.col(f"{v}.{c}").alias(f"{c}{k}") for v, k in (("x", 1), ("y", 2)) for c in ("taxon", "codon", "aa")])


#: Taxa of a block, rows of a part of a pair of blocks, and sites or pairs of one product at least.
BLOCK_TAXA, PART_ROWS, CHUNK_SITES, CHUNK_PAIRS = 512, 1 << 18, 8, 1 << 20
#: Of spread genes: taxa of a side at most, a place of 15 bits; pairs at sites of two sides; and those of a lot, for each row.
SIDE_TAXA, PART_PAIRS, LOT_PAIRS = 1 << 15, 1 << 22, 16

Pairs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _gram(table: pa.Table) -> tuple[pa.Array, Pairs]:
    """The taxa of two blocks, and (i, j, n, d, dn) of their pairs over the sites of a part, a row each: sites both know, those whose codons differ, those whose amino acids do.

    Some sites at a time are an indicator matrix of the taxa that have them by the states they have there, whose product with itself is the counts; where it
    would be sparse, its nonzero products are summed one by one.
    """
    lists = {c: table.column(c).combine_chunks() for c in ("taxon", "codon", "aa")}
    held = pc.list_value_length(lists["taxon"]).to_numpy()
    values = lists["taxon"].flatten()
    names = pc.unique(values)
    names = names.take(pc.sort_indices(names))
    taxon = pc.index_in(values, value_set=names).to_numpy().astype(np.int64)
    codon, aa = (lists[c].flatten().to_numpy().astype(np.int64) for c in ("codon", "aa"))
    site = np.repeat(np.arange(len(held)), held)
    starts = np.concatenate([[0], np.cumsum(held)])
    second = np.arange(len(taxon)) - starts[site] >= table.column("first").to_numpy()[site]
    block = np.zeros(len(names), dtype=bool)
    block[taxon] = second
    counts = np.zeros((3, len(names), len(names)), dtype=np.int64)
    whole = np.concatenate([[0], np.cumsum(held.astype(np.int64) * (held - 1) // 2)])
    first = 0
    while first < len(held):
        last = min(len(held), max(first + CHUNK_SITES, int(np.searchsorted(whole, whole[first] + CHUNK_PAIRS))))
        own, n_pairs, first = slice(starts[first], starts[last]), int(whole[last] - whole[first]), last
        here, row = np.unique(taxon[own], return_inverse=True)
        states = (site[own], site[own] * (codon.max() + 1) + codon[own], site[own] * (aa.max() + 1) + aa[own])
        if n_pairs < 2 * len(here) ** 2:  # sparse: few of the taxa meet at a site
            follow = starts[site[own] + 1] - np.arange(own.start, own.stop) - 1
            i = np.repeat(np.arange(len(row)), follow)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(follow) - follow, follow)
            at = np.minimum(taxon[own][i], taxon[own][j]) * np.int64(len(names)) + np.maximum(taxon[own][i], taxon[own][j])
            for k, state in enumerate(states):
                counts[k] += np.bincount(at[state[i] == state[j]], minlength=len(names) ** 2).reshape(len(names), -1)
            continue
        for k, state in enumerate(states):
            column = np.unique(state, return_inverse=True)[1]
            known = np.zeros((len(here), int(column.max()) + 1), dtype=np.float32)
            known[row, column] = 1
            counts[k][np.ix_(here, here)] += (known @ known.T).astype(np.int64)
    pairs = np.triu(counts[0] > 0, 1)
    if table.column("p")[0].as_py() != table.column("q")[0].as_py():
        pairs &= block[:, None] != block[None, :]
    i, j = np.nonzero(pairs)
    n, same, same_aa = (c[i, j] for c in counts)
    return names, (i, j, n, n - same, n - same_aa)


def _packed(table: pa.Table) -> pa.Table:
    """The counts of a part, one row."""
    names, pairs = _gram(table)
    one = {k: table.column(k)[:1] for k in ("gene", "p", "q")}
    packed = {k: pa.array([v.astype(np.int32).tobytes()], pa.binary()) for k, v in zip(("i", "j", "n", "d", "dn"), pairs, strict=True)}
    return pa.table({**one, "names": pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), **packed})


def _summed(parts: pa.Table) -> tuple[pa.Array, Pairs]:
    """The taxa of two blocks, and (i, j, n, d, dn) of their pairs over all parts."""
    lists = parts.column("names").combine_chunks()
    names = pc.unique(lists.flatten())
    names = names.take(pc.sort_indices(names))
    total = np.zeros((3, len(names) ** 2), dtype=np.int64)
    for k, row in enumerate(parts.select(["i", "j", "n", "d", "dn"]).to_pylist()):
        at = pc.index_in(lists[k].values, value_set=names).to_numpy().astype(np.int64)
        i, j, *values = (np.frombuffer(row[c], dtype=np.int32) for c in ("i", "j", "n", "d", "dn"))
        place = at[i] * len(names) + at[j]
        for t, v in zip(total, values, strict=True):
            t[place] += v
    place = np.nonzero(total[0])[0]
    return names, (place // max(len(names), 1), place % max(len(names), 1), *total[:, place])


def _sites(codons: DataFrame, block_taxa: int) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """(gene, taxon, place), the taxa of each gene, numbered in their order; (gene, site, x), at each site its known taxa (own, place, taxon, codon, aa), own a block of places, with numbers for
    codons and amino acids; (gene, rows, pairs, spread, sides), how a gene's pairs are dealt, if any; and the folders of the sites.

    Blocks are of neighbours, so taxa that stand together, and are known at the same sites, meet in few blocks. A gene is spread where the pairs at its sites, 4 bytes each, are less than what
    would go to pairs of blocks, 12 bytes for a taxon: its taxa are dealt in turn to as many sides as leave two sides some PART_PAIRS pairs.
    """
    spark = codons.sparkSession
    rows_path, path = shared_path(spark, "staged"), shared_path(spark, "staged")
    with freed_shuffles(spark):
        codons.select("gene", "site", "taxon", "codon", "aa").write.parquet(rows_path)
    rows = spark.read.schema(codons.select("gene", "site", "taxon", "codon", "aa").schema).parquet(rows_path)
    taxa = staged(running(rows.select("gene", "taxon").distinct(), ["taxon"], keys=["gene"]).select("gene", "taxon", (F.col("__rank") - 1).cast("int").alias("place")))
    # the alphabets are small: codons and amino acids by their places in sorted lists, of one row
    kinds = rows.where("codon IS NOT NULL").agg(F.array_sort(F.collect_set(F.struct("codon", "aa"))).alias("k")).select(F.posexplode("k"), F.array_distinct("k.aa").alias("aas"))
    kinds = kinds.select(F.col("col.codon").alias("c"), F.col("col.aa").alias("a"), F.col("pos").cast("short").alias("codon_id"), F.coalesce(F.array_position("aas", F.col("col.aa")), F.lit(0)).cast("short").alias("aa_id"))
    known = rows.where("codon IS NOT NULL").join(F.broadcast(kinds), F.col("codon").eqNullSafe(F.col("c")) & F.col("aa").eqNullSafe(F.col("a"))).join(taxa, ["gene", "taxon"])
    own = F.floor(F.col("place") / block_taxa).cast("int").alias("own")
    site = known.repartition("gene", "site").groupBy("gene", "site").agg(F.collect_list(F.struct(own, "place", "taxon", F.col("codon_id").alias("codon"), F.col("aa_id").alias("aa"))).alias("x"))
    with freed_shuffles(spark):
        site.sortWithinPartitions("gene").write.parquet(path)
    removed(spark, rows_path)
    site = spark.read.schema(site.schema).parquet(path)
    held = site.select("gene", F.size("x.own").cast("long").alias("k"), F.size(F.array_distinct("x.own")).cast("long").alias("b"))
    sums = held.groupBy("gene").agg(F.sum("k").alias("rows"), F.sum(F.expr("k * (k - 1) DIV 2")).alias("pairs"), F.sum(F.expr("k * b")).alias("sent")).where("pairs > 0")
    sides = F.greatest(F.ceil(F.sqrt(2 * F.col("pairs") / PART_PAIRS)), F.ceil((F.col("top") + 1) / SIDE_TAXA)).cast("int")
    dealt = sums.join(taxa.groupBy("gene").agg(F.max("place").alias("top")), "gene").select("gene", "rows", "pairs", F.expr("4 * pairs < 12 * sent").alias("spread"), sides.alias("sides"))
    return taxa, site, staged(dealt), [path]


def _met(batches: Iterator[pa.RecordBatch], lot: int, lots: int) -> Iterator[pa.RecordBatch]:
    """(gene, p, q, sides, keys): pairs of taxa that meet at sites (gene, sides, place, codon, aa), by their two sides; of pairs of sides those whose sum leaves `lot`.

    A pair at a site is 32 bits: the taxon's place in p, that in q, and whether codons and amino acids differ.
    """
    for batch in batches:
        held, genes = pc.list_value_length(batch.column("place")).to_numpy(), batch.column("gene").dictionary_encode()
        gene, sides = genes.indices.to_numpy().astype(np.int64), batch.column("sides").to_numpy().astype(np.int64)
        place, codon, aa = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("place", "codon", "aa"))
        site, most = np.repeat(np.arange(len(held)), held), int(sides.max(initial=1))
        side, rel = place % sides[site], place // sides[site]
        order = np.lexsort((rel, side, site))  # of two taxa of a site the one of the lesser side is first
        side, rel, codon, aa = side[order], rel[order], codon[order], aa[order]
        first, second = ((gene[site] * most + side) * most << 32) + (rel << 17), (side << 32) + (rel << 2)
        follow = np.repeat(np.cumsum(held), held) - np.arange(len(site)) - 1
        before = np.concatenate([[0], np.cumsum(follow)])
        start = 0
        while start < len(site):  # some pairs at a time, whatever the taxa of a site
            end = max(start + 1, int(np.searchsorted(before, before[start] + CHUNK_PAIRS, side="right")) - 1)
            own, times, start = slice(start, end), follow[start:end], end
            j = np.arange(before[end] - before[own.start]) + np.repeat(np.arange(own.start, end) + 1 - before[own] + before[own.start], times)
            met = np.repeat(first[own], times) + second[j] + 2 * (np.repeat(codon[own], times) != codon[j]) + (np.repeat(aa[own], times) != aa[j])
            if lots > 1:
                met = met[((met >> 32) // most % most + (met >> 32) % most) % lots == lot]
            if not len(met):
                continue
            met.sort()
            cell = met >> 32
            new = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1])
            ends = np.append(4 * new, 4 * len(met)).astype(np.int32)
            keys = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(ends), pa.py_buffer(met.astype(np.uint32))])
            cell, by_gene = cell[new], np.ones(len(genes.dictionary), dtype=np.int32)
            by_gene[gene] = sides
            at = cell // most**2
            yield pa.RecordBatch.from_arrays([genes.dictionary.take(pa.array(at)), *[pa.array(x.astype(np.int32)) for x in (cell // most % most, cell % most, by_gene[at])], keys], names=["gene", "p", "q", "sides", "keys"])


def _counted(met: pa.Table, names: pa.Table | None = None) -> tuple[pa.Array | None, Pairs]:
    """The taxa of two sides (side, names), if given, and (i, j, n, d, dn) of their pairs, i the taxon that stands before j."""
    keys = np.sort(np.frombuffer(b"".join(met.column("keys").to_pylist()), dtype=np.uint32))
    pair = keys >> 2
    new = np.flatnonzero(np.concatenate([np.ones(min(len(pair), 1), dtype=bool), pair[1:] != pair[:-1]]))
    n = np.diff(np.append(new, len(keys)))
    d, dn = (np.add.reduceat(x, new, dtype=np.int64) if len(new) else n for x in ((keys >> 1) & 1, keys & 1))
    i, j = (x.astype(np.int64) for x in (pair[new] >> 15, pair[new] & (SIDE_TAXA - 1)))
    if names is None:
        return None, (i, j, n, d, dn)
    lists = dict(zip(names.column("side").to_pylist(), names.column("names").combine_chunks(), strict=True))
    p, q = (names.column(c)[0].as_py() for c in ("p", "q"))
    taxa = lists[p].values
    if p != q:
        later = i > j  # places are dealt in turn, and p is less than q
        taxa, j = pa.concat_arrays([taxa, lists[q].values]), j + len(taxa)
        i, j = np.where(later, j, i), np.where(later, i, j)
    return taxa, (i, j, n, d, dn)


def _paired(codons: DataFrame, give: Callable[[pa.Table, pa.Array, Pairs], pa.Table], schema: str, block_taxa: int, part_rows: int, named: bool = False) -> tuple[DataFrame, DataFrame, list[str]]:
    """(gene, t); the rows that `give` makes of two blocks, or sides, of taxa of a gene, and the counts of all their pairs; and the folders that both read. named: give reads the taxa.

    A site goes to the pairs of blocks that are known there, no other, and pairs of blocks with many rows go by parts of their sites. A group counts its pairs by matrix
    products, so no pair is ever a row at a site; counts are shuffled, packed, only where there are several parts. A group holds two blocks and a part, however large the gene.
    Of a gene that is spread, whose taxa meet in ever other blocks, each pair at a site goes, packed, to its two sides; where these are many for the rows and `give` makes few rows, in lots, one
    after the other. Each taxon has one codon at a site at most.
    """
    taxa, site, dealt, paths = _sites(codons, block_taxa)
    spark, counts = codons.sparkSession, taxa.groupBy("gene").agg(F.count("taxon").alias("t"))
    gene, taxon = (codons.schema[c].dataType.simpleString() for c in ("gene", "taxon"))
    spread = dealt.where("spread")
    pairs, rows = spread.agg(F.sum("pairs"), F.sum("rows")).first()
    lots = 1 if named or not pairs else -(-pairs // (LOT_PAIRS * rows))
    out = []
    for lot in range(lots if pairs else 0):
        at = by_few(site.select("gene", "x.place", "x.codon", "x.aa"), spread.select("gene", "sides"), "gene")
        met = at.mapInArrow(lambda batches, lot=lot: _met(batches, lot, lots), f"gene {gene}, p int, q int, sides int, keys binary").groupBy("gene", "p", "q")
        if named:
            cells = spread.select("gene", "sides", F.explode(F.expr("sequence(0, sides - 1)")).alias("p")).select("gene", "sides", "p", F.explode(F.expr("sequence(p, sides - 1)")).alias("q"))
            of = taxa.join(spread.select("gene", "sides"), "gene").groupBy("gene", (F.col("place") % F.col("sides")).alias("side")).agg(F.sort_array(F.collect_list(F.struct("place", "taxon"))).alias("x"))
            of = cells.select("gene", "p", "q", F.explode(F.expr("array_distinct(array(p, q))")).alias("side")).join(of.select("gene", "side", F.col("x.taxon").alias("names")), ["gene", "side"])
            out.append(met.cogroup(of.groupBy("gene", "p", "q")).applyInArrow(lambda left, right: give(right, *_counted(left, right)), schema))
        else:
            some = met.applyInArrow(lambda table: give(table, *_counted(table)), schema)
            out.append(staged(some) if lots > 1 else some)
    if (near := dealt.where("NOT spread").select("gene")).isEmpty():
        return counts, reduce(DataFrame.union, out) if out else spark.createDataFrame([], schema), paths
    blocks = F.transform(F.transform(F.array_sort(F.array_distinct("x.own")), lambda own: F.struct(own.alias("own"), F.filter("x", lambda v: v["own"] == own).alias("x"))), lambda y: F.struct(y["own"].alias("own"), *[y["x"][c].alias(c) for c in ("taxon", "codon", "aa")]))
    site = by_few(site, near, "gene").select("gene", "site", blocks.alias("blocks"))
    ends = F.flatten(F.transform("blocks", lambda x, i: F.transform(F.slice("blocks", i + 1, F.size("blocks")), lambda y: F.struct(x["own"].alias("p"), y["own"].alias("q"), F.size(x["taxon"]).alias("first"), F.size(y["taxon"]).alias("second")))))
    held = F.when(F.col("e.p") == F.col("e.q"), F.col("e.first")).otherwise(F.col("e.first") + F.col("e.second"))
    sizes = site.select("gene", F.explode(ends).alias("e")).select("gene", "e.p", "e.q", held.alias("m")).where("m > 1").groupBy("gene", "p", "q").agg(F.ceil(F.sum("m") / part_rows).alias("parts"))
    sizes = staged(sizes)
    whole = lambda x, y, c: F.when(x["own"] == y["own"], x[c]).otherwise(F.concat(x[c], y[c])).alias(c)
    pairs = F.transform("blocks", lambda x, i: F.transform(F.slice("blocks", i + 1, F.size("blocks")), lambda y: F.struct(x["own"].alias("p"), y["own"].alias("q"), F.size(x["taxon"]).alias("first"), *[whole(x, y, c) for c in ("taxon", "codon", "aa")])))
    groups = site.select("gene", "site", F.explode(F.flatten(pairs)).alias("e")).select("gene", "site", "e.*").where("size(taxon) > 1")
    one = groups.join(sizes.where("parts = 1").select("gene", "p", "q"), ["gene", "p", "q"]).select("gene", "p", "q", "first", "taxon", "codon", "aa")
    out.append(one.groupBy("gene", "p", "q").applyInArrow(lambda table: give(table, *_gram(table)), schema))
    if sizes.where("parts > 1").isEmpty():
        return counts, reduce(DataFrame.union, out), paths
    some = groups.join(sizes.where("parts > 1"), ["gene", "p", "q"]).withColumn("part", F.pmod(F.xxhash64("site"), F.col("parts"))).select("gene", "part", "p", "q", "first", "taxon", "codon", "aa")
    parts = some.groupBy("gene", "part", "p", "q").applyInArrow(_packed, f"gene {gene}, p int, q int, names array<{taxon}>, i binary, j binary, n binary, d binary, dn binary")
    out.append(parts.groupBy("gene", "p", "q").applyInArrow(lambda table: give(table, *_summed(table)), schema))
    return counts, reduce(DataFrame.union, out), paths


def pair_counts(codons: DataFrame, block_taxa: int = BLOCK_TAXA, part_rows: int = PART_ROWS) -> DataFrame:
    """(gene, taxon1, taxon2, n, d, dn) of pairs of taxa that share a site: sites known in both, those whose codons differ, and whose amino acids do."""

    def give(table: pa.Table, names: pa.Array, pairs: Pairs) -> pa.Table:
        i, j, n, d, dn = pairs
        gene = table.column("gene").combine_chunks().take(pa.array(np.zeros(len(i), dtype=np.int64)))
        return pa.table({"gene": gene, "taxon1": names.take(pa.array(i)), "taxon2": names.take(pa.array(j)), "n": n, "d": d, "dn": dn})

    gene, taxon = (codons.schema[c].dataType.simpleString() for c in ("gene", "taxon"))
    return _paired(codons, give, f"gene {gene}, taxon1 {taxon}, taxon2 {taxon}, n long, d long, dn long", block_taxa, part_rows, named=True)[1]


def pairwise_rates(codons: DataFrame, block_taxa: int = BLOCK_TAXA, part_rows: int = PART_ROWS) -> DataFrame:
    """Per gene: mean share of differing codons over pairs of taxa, mean non-synonymous share over it over 2.5, and pairs with no shared codon, which the means leave out.
    Pairs are summed in the task that has their blocks, and never leave it."""

    def give(table: pa.Table, names: pa.Array, pairs: Pairs) -> pa.Table:
        _, _, n, d, dn = pairs
        return pa.table({"gene": table.column("gene")[:1], "pairs": [len(n)], "d": [float((d / n).sum())], "dn": [float((dn / n).sum())]})

    taxa, sums, paths = _paired(codons, give, f"gene {codons.schema['gene'].dataType.simpleString()}, pairs long, d double, dn double", block_taxa, part_rows)
    total = staged(sums.groupBy("gene").agg(F.sum("pairs").alias("n_pairs"), F.sum("d").alias("d"), F.sum("dn").alias("dn")))
    for path in paths:
        removed(codons.sparkSession, path)
    mean = total.where("n_pairs > 0").select("gene", "n_pairs", (F.col("d") / F.col("n_pairs")).alias("divergence"), (F.col("dn") / F.col("n_pairs")).alias("dn"))
    return taxa.join(mean, "gene", "left").select(
        "gene", "divergence", (F.col("dn") / F.col("divergence") / 2.5).alias("dnds"), ((F.col("t") * (F.col("t") - 1) / 2).cast("long") - F.coalesce("n_pairs", F.lit(0))).alias("n_unshared")
    )


def dominant_aa_profiles(aa: DataFrame) -> DataFrame:
    """(dominant, aa, freq, weight): mean profile of the sites whose most frequent amino acid is `dominant`, ties to the first; weight is the share of sites."""
    counts = site_aa_counts(aa)
    top = counts.where("n > 0").groupBy("gene", "site").agg(F.min(F.struct(-F.col("n"), F.col("aa"))).alias("x")).select("gene", "site", F.col("x.aa").alias("dominant"))
    rows = counts.join(top, ["gene", "site"]).groupBy("dominant", "aa").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sites"))
    by, all_ = W.partitionBy("dominant"), W.partitionBy("aa")
    return rows.select("dominant", "aa", (F.col("n") / F.sum("n").over(by)).alias("freq"), (F.col("sites") / F.sum("sites").over(all_)).alias("weight"))


def gene_sizes(long: DataFrame) -> DataFrame:
    """(gene, n_codons, weight): sites over 3, and sites times taxa."""
    g = long.groupBy("gene").agg(F.count_distinct("site").alias("s"), F.count_distinct("taxon").alias("t"))
    return g.select("gene", F.floor(F.col("s") / 3).alias("n_codons"), (F.col("s") * F.col("t")).alias("weight"))


def gene_offsets(genes: DataFrame) -> DataFrame:
    """Adds offset: sites of the genes before one in list order, by ranges of the list, never in one task."""
    return running(genes, ["ordinal"], ["nsite"]).withColumn("offset", F.col("__sum_nsite") - F.col("nsite")).drop("__rank", "__sum_nsite")


def gene_sizes_ranked(long: DataFrame) -> DataFrame:
    """gene_sizes with rank, largest weight first."""
    return running(gene_sizes(long), [F.desc("weight"), "gene"]).withColumnRenamed("__rank", "rank")


def trait_mean_log(traits: DataFrame) -> DataFrame:
    """Mean of ln over known values of each character."""
    return traits.where("value IS NOT NULL").groupBy("character").agg(F.avg(F.ln("value")).alias("mean_log"))
