"""Operators 11 to 13 against plain versions, over nulls, repeats, clashing names, long texts and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codonspark.llm import catalog, merkle, ngrams, periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def least_nodes(links, nodes):
    """Smallest node of each node's component; None counts last."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["É", "éa", "Zz", "zz"]
    base = [rng.choice(words) for _ in range(160)]
    texts = [None, "", " \n\t ", "one", "One two", "one two", "a b " * 40, "x" * 20_000, " ".join(base), " ".join(base).upper(), "é È é è", "a " * 3_000, " ".join(rng.choice("ab") for _ in range(400))]
    for k in range(60):  # near copies, more than a small meeting
        w = list(base)
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    for _ in range(60):
        w = [rng.choice(words) for _ in range(rng.randrange(1, 300))]
        u = w[: rng.randrange(1, 12)]
        texts.append(" ".join(w + u * rng.randrange(1, 8) + w[:5]))
    out = [(i * 37 - 900, t, rng.choice(["en", "de", None, "é", "z"]), rng.choice(["a", None]), len(t or "")) for i, t in enumerate(texts)]
    out += [(out[20][0], "another text of this id", out[20][2], "a", 3), out[21], out[21], out[21]]
    return out + [(None, texts[9], "en", None, None), (None, "a b c d", "en", None, 7), (None, "a b c d", "en", None, 7), (2**40, "far", "en", "a", 3)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("structures"))
    names = "g long, i long, size long, digest string, path string, gram long, s long, t long, n long, leaf string, grp string, id long, word long, bits long, start long, key string, runs int"
    df = spark.createDataFrame([(*r, *[1, 2, 3, "d", "p", 4, 5, 6, 7, "l", "g", 8, 9, 10, 11, "k", 12]) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {names}")
    df.repartition(3).write.parquet(f"{out}/documents.parquet")
    df.where("false").write.parquet(f"{out}/none/documents.parquet")
    return out


def found(spark, folder, name):
    got = collections.defaultdict(list)
    for r in catalog.queries()[name](spark, folder).collect():
        got[r["doc_id"]].append(r)
    return got


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_merkle_manifest", "op13_ngram_join"])
def test_empty(spark, folder, name):
    assert catalog.queries()[name](spark, f"{folder}/none").count() == 0


def plain_runs(w, least):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def test_op11(spark, folder, rows):
    want = collections.defaultdict(list)
    for doc_id, text, *_ in rows:
        w = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if len(w) > 1_000 and len(set(w)) == 1:
            all_runs = [(0, len(w), 1)]
        else:
            all_runs = plain_runs(w, 12)
        top = max(all_runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        gone = {i for s, n, q in all_runs for i in range(s + q, s + n)}
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(all_runs, key=lambda r: (r[0], r[2])))
        want[doc_id].append((len(all_runs), *top, 1000 * top[1] // top[2] if all_runs else None, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    got = {k: sorted((tuple(r)[1:] for r in v), key=repr) for k, v in found(spark, folder, "op11_periodic_runs").items()}
    assert got == {k: sorted(v, key=repr) for k, v in want.items()}
    assert any(r[0] > 1 for v in want.values() for r in v)


def test_runs_of_any_length():
    rng = random.Random(9)
    for least in (2, 5, 12, 31):
        for _ in range(60):
            texts = []
            for _ in range(3):
                t = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randrange(120))]
                texts.append((t[: rng.randrange(1, 20)] * 9)[:90] if rng.random() < 0.5 else t)
            bounds = np.cumsum([0, *map(len, texts)])
            start, length, period = periods.runs(np.array([x for t in texts for x in t], dtype=np.int64), np.repeat(bounds[1:], np.diff(bounds)), least)
            want = [(b + s, n, q) for b, t in zip(bounds.tolist(), texts, strict=False) for s, n, q in sorted(plain_runs(t, least), key=lambda r: (r[0], r[2]))]
            assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == want


def plain_tree(leaves):
    """Levels of a tree over leaves, the last of one node."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def plain_manifest(rows):
    def leaf(r, tampered=False):
        doc_id, text, lang, source, n_chars = r
        if tampered and zlib.crc32(str(doc_id).encode()) % 3 == 0 and doc_id is not None and text is not None:
            text = lower(text)
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is None, r[0] or 0, leaf(r), leaf(r, True)))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(groups[g])]) for g in langs]
    crown = plain_tree([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(langs):
        for i, (none, doc_id, own, now) in enumerate(sorted(groups[g])):
            sides, acc = [], now
            for levels, at in ((trees[k], i), (crown, k)):
                for level in levels[:-1]:
                    run = level[at // 8 * 8 : at // 8 * 8 + 8]
                    left, right = "".join(run[: at % 8]), "".join(run[at % 8 + 1 :])
                    sides.append(left + right)
                    acc = sha(left + acc + right)
                    at //= 8
            out.append((None if none else doc_id, own, trees[k][-1][0], crown[-1][0], sha("".join(sides)), acc, acc == crown[-1][0]))
    return out


def test_op12(spark, folder, rows):
    got = sorted((tuple(r) for v in found(spark, folder, "op12_merkle_manifest").values() for r in v), key=repr)
    assert got == sorted(plain_manifest(rows), key=repr)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_many_blocks(spark):
    """More leaves than a block has, sparse and negative keys, one group alone; a proof folds to the root."""
    n = 2 * merkle.UNIT + 3
    keys = [(k * 7919 - 40_000_000, k % 977 == 0) for k in range(n)]
    random.Random(1).shuffle(keys)
    df = spark.createDataFrame([(k, "b" if few else "a", sha(str(k))) for k, few in keys], "k long, part string, leaf string").repartition(5)
    got = merkle.manifest(df, "k", "part", "leaf").withColumn("again", merkle.folded(F.col("leaf"), F.col("path"))).select("k", "subroot", "root", "again").collect()
    trees = [plain_tree([sha(str(k)) for k, few in sorted(keys) if few == want]) for want in (False, True)]
    root = plain_tree([t[-1][0] for t in trees])[-1][0]
    assert len(got) == n and all(r["root"] == root == r["again"] for r in got)
    assert {r["k"]: r["subroot"] for r in got} == {k: trees[few][-1][0] for k, few in keys}
    with pytest.raises(TypeError):
        merkle.manifest(df, "part", "part", "leaf")


def plain_components(rows, words, percent):
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall(lower(text or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    roots, out = least_nodes(links, range(len(rows))), collections.defaultdict(list)
    for i, r in enumerate(rows):
        out[roots[i]].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in out.items()}
    return sorted(((r[0], len(sets[i]), least[roots[i]]) for i, r in enumerate(rows)), key=repr)


def test_op13(spark, folder, rows):
    got = sorted((tuple(r) for v in found(spark, folder, "op13_ngram_join").values() for r in v), key=repr)
    assert got == plain_components(rows, 3, 90)


@pytest.mark.parametrize("words, percent, small, group", [(3, 90, 4, 8), (5, 80, 2, 4096), (2, 55, 16, 12), (1, 100, 3, 7)])
def test_joins_of_crowded_grams(spark, rows, words, percent, small, group):
    """Forests, rounds and parts, at limits that the fixture's groups exceed."""
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, ngrams.jaccard_components(df, words=words, percent=percent, small=small, group=group).collect()), key=repr)
    assert got == plain_components(rows, words, percent)


def test_near_copies_at_the_limit():
    """A forest joins what all pairs join, in any order of the sets."""
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, 290, replace=False), rng.integers(0, 1 << 62, int(rng.integers(0, 20))).astype(np.uint64)])) for _ in range(50)]
    bounds, value = np.cumsum([0, *map(len, sets)]), np.concatenate(sets)
    parity = np.frombuffer(b"".join(ngrams._parities(bounds, value)), dtype=np.uint64).reshape(-1, 16)
    n, one = np.diff(bounds), np.zeros(50, dtype=np.int64)
    for i in range(50):
        for j in range(i):
            apart = len(np.setxor1d(sets[i], sets[j]))
            got = ngrams._plausible(n, parity, np.array([i]), np.array([j]), 90)[0]
            both = len(np.intersect1d(sets[i], sets[j]))
            assert got <= apart or 100 * both < 90 * (n[i] + n[j] - both)
    i, j = ngrams._pairs(one, n, parity, np.arange(50), 90, False)
    assert len(i) <= 49
