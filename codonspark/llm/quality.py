"""Operator 1, quality rules: a short-circuit cascade ordered by rejections per cost. DataFrame functions only.

Each rule is a condition on the text that rejects it. On a sample the operator measures what each
rule costs and how often it rejects; the cascade is one CASE expression in falling order of
rejections per second, so that a text met by a cheap, sharp rule never reaches a dear one. The
order changes the time alone: a text is kept if no rule rejects it.

Defined cases: a null text is an empty one, which the word count rejects. A text of any length is
one row; nothing is shuffled. Repeated rows are judged alike. An empty table gives an empty result
with the rules in the order given. Other columns pass through untouched and are never read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from random import Random
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, let, read_table, words_of

Stats = Mapping[str, Column]


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Stats], Column]


def _left(text: Column, others: str) -> Column:
    """Code points of the text that are not in the class `others`."""
    return F.length(F.regexp_replace(text, f"[{others}]+", F.lit(""))).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more; windows are sorted only where some are equal."""

    def few(g: Column, twice: Column) -> Column:
        """Places of the windows that are in a short list."""
        return F.filter(F.transform(g, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull())

    def many(g: Column) -> Column:
        """Places of the windows that equal a neighbour, once sorted with their places."""
        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        found = let(ordered, lambda s: F.filter(s, lambda x, k: (x["g"] == F.get(s, k - 1)["g"]) | (x["g"] == F.get(s, k + 1)["g"])))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def places(g: Column) -> Column:
        twice = let(F.sort_array(g), lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k + 1))))
        return let(twice, lambda t: F.when(F.size(t) <= 24, few(g, t)).otherwise(many(g)))

    def counted(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(let(places(g), covered))

    windows = F.regexp_extract_all(F.array_join(words, " "), F.lit("(?<![^ ])(?=([^ ]++ [^ ]++ [^ ]++))[^ ]++ "), F.lit(1))
    return let(windows, counted)


def text_stats(text: Column, words: Column | None = None) -> dict[str, Column]:
    """Counts of a text, each an expression of its own; null counts as empty. words: its words, where a column has them."""
    t = F.coalesce(text, F.lit(""))
    words = words_of(t) if words is None else words
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": _left(t, "^#*$%&|<>"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(words),
        "n_marks": _left(t, "^!-@"),
        "n_capitals": _left(t, "^A-Z"),
    }


#: The two base rules.
BASE_RULES = (
    Rule("few_words", lambda s: s["n_words"] < 50),
    Rule("repeated_words", lambda s: 100 * s["n_repeat_words"] > 50 * s["n_words"]),
)
#: What the method adds to them.
RULES = (
    Rule("symbols", lambda s: 10 * s["n_symbols"] > s["n_words"]),
    Rule("repeated_lines", lambda s: 2 * s["n_dup_lines"] > s["n_lines"]),
    Rule("marks", lambda s: 4 * s["n_marks"] > s["word_chars"]),
    Rule("capitals", lambda s: 2 * s["n_capitals"] > s["word_chars"]),
    Rule("word_length", lambda s: (s["word_chars"] < 2 * s["n_words"]) | (s["word_chars"] > 20 * s["n_words"])),
)


#: Counts that a sample holds as columns where the cascade that it orders has them too.
BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sampled(docs: DataFrame, rows: int, seed: int, files: int = 8) -> DataFrame:
    """About `rows` rows, of some files drawn at random where docs is read from files, so that no other file is opened."""
    few = docs
    try:
        names = sorted({unquote(f.rsplit("/", 1)[-1]) for f in docs.inputFiles()})
        if len(names) > files:
            few = docs.where(F.col("_metadata.file_name").isin(Random(seed).sample(names, files)))
    except AnalysisException:  # docs that hide which file a row is from
        pass
    n = few.count()
    if not n:
        few, n = docs, docs.count()
    return few.sample(fraction=min(1.0, rows / max(1, n)), seed=seed) if n > rows else few


def order_rules(
    docs: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = 2000, seed: int = 7, given: Sequence[str] = (), repeats: int = 3
) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) in falling order of rejections per second, measured on a sample of about sample_rows.

    What is timed is the rule as the cascade runs it: over words, and counts named by `given`, that are there already; the least of `repeats`
    runs, less that of a job without a rule. The sample fixes the order alone, never a verdict.
    """
    sample = _sampled(docs, sample_rows, seed).select(F.col(text).alias("text"))
    sample = sample.withColumn("words", words_of(F.col("text")))
    counts = text_stats(F.col("text"), F.col("words"))
    sample = sample.withColumns({c: counts[c] for c in given}).persist()
    try:
        n = max(1, sample.count())
        stats = counts | {c: F.col(c) for c in given}

        def timed(condition: Column) -> tuple[float, int]:
            seconds, hits = [], 0
            for _ in range(repeats):
                began = time.perf_counter()
                hits = sample.agg(F.count_if(condition).alias("n")).first()["n"]
                seconds.append(time.perf_counter() - began)
            return min(seconds), hits

        idle = timed(F.size("words") < 0)[0]
        measured = [(r, *timed(r.rejects(stats))) for r in rules]
    finally:
        sample.unpersist()
    found = [(r, max(1e-3, s - idle), hits / n) for r, s, hits in measured]
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(rules: Sequence[Rule], stats: Stats) -> Column:
    """Name of the first rule that rejects, else null: later rules are then not evaluated."""
    out = F
    for r in rules:
        out = out.when(r.rejects(stats), F.lit(r.name))
    return out


def quality_filter(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = BASE_RULES + RULES, sample_rows: int = 2000) -> DataFrame:
    """The rows that no rule rejects, all columns kept. A text is split into words once, for all rules."""
    ordered = [r for r, _, _ in order_rules(docs, rules, text, sample_rows)]
    first = let(words_of(F.col(text)), lambda w: F.coalesce(cascade(ordered, text_stats(F.col(text), w)), F.lit("")))
    return docs.where(first == "")


def quality_report(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """Counts and verdict of each row: (key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    ordered = [r for r, _, _ in order_rules(docs, RULES, text, sample_rows, given=BASE_COUNTS)]
    stats = text_stats(F.col("__text"), F.col("__words"))
    base = list(BASE_COUNTS)
    counted = docs.select(F.col(key), F.col(text).alias("__text"), words_of(F.col(text)).alias("__words")).withColumns({c: stats[c] for c in base})
    have = stats | {c: F.col(c) for c in base}
    failed = BASE_RULES[0].rejects(have) | BASE_RULES[1].rejects(have)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(ordered, have).isNull())
    return counted.withColumn("base_failed", failed).select(key, *base, "base_failed", kept.alias("kept"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(read_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
s AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(t, '[^!-@]+', '', 'g')) AS n_marks,
  length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals FROM w LEFT JOIN p ON p.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 4 * n_marks > word_chars
    OR 2 * n_capitals > word_chars OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM b
"""
