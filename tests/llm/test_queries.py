"""Every registered query of an operator, as it is, against brute force, over tables with nulls, repeats, clashing names, long words and long texts."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import pytest

from codonspark.llm import catalog, ctw, decontaminate, language, licenses, mixing, quality, sharding, tokens

from .test_operators import PLAIN, SF, brute_fingerprint, brute_hits, brute_targets, components, lower, spaced

EXTRA = "shard int, slot long, grown_shard int, words string, row long, block long, key string, n long, item_id string, hash long, chunk long, pass long, k long, line string, window long, dealt int"


@pytest.fixture(scope="module")
def rows(spark):
    given = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    base = given[4][1]
    edge = [None, "", " \n\t", "one", "one two", "a b a b a b a b", "é è x ÀÉ", "12 !!", "x" * 30_000, base, base + " end", "\n".join(["line of text"] * 60), " lead and trail ", "word other " * 4_000]
    edge += ["Licensed under the Apache License,\n * Version 2.0 (the License)", "mit license mit license", "released under ms-pl", "déjà vu. Über! ok?\nnew line"]
    out = given + [(1000 + i, t, "en" if i % 3 else None, None if i % 2 else "zz") for i, t in enumerate(edge)]
    return [*out, out[5], out[5]]


@pytest.fixture(scope="module")
def items(rows):
    w = PLAIN.findall(lower(rows[7][1]))
    return [(1, " ".join(w[3:20])), (2, " ".join(w[8:30]).upper()), (10, "one"), (11, "b a"), (12, None), (13, "!!"), (None, "line of text line of text line of text line"), (15, "word other " * 12), (None, " ".join(w[40:52])), (2, " ".join(w[60:72]))]


@pytest.fixture(scope="module")
def folder(spark, rows, items, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    extra = (1, 2, 3, "w", 4, 5, "k", 6, "i", 7, 8, 9, 10, "l", 11, 12)
    df = spark.createDataFrame([(*r, len(r[1] or ""), *extra) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")
    df.repartition(3).write.parquet(f"{out}/documents.parquet")
    df.where("false").write.parquet(f"{out}/none/documents.parquet")
    bench = spark.createDataFrame(items, "item_id int, text string")
    bench.write.parquet(f"{out}/benchmark.parquet")
    bench.write.parquet(f"{out}/none/benchmark.parquet")
    return out


def found(spark, folder, name):
    got = collections.defaultdict(list)
    for r in catalog.queries()[name](spark, folder).collect():
        got[r["doc_id"]].append(r)
    return got


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_empty(spark, folder, name):
    assert catalog.queries()[name](spark, f"{folder}/none").count() == 0


def test_op1(spark, folder, rows):
    got = found(spark, folder, "op1_quality_rules")
    for doc_id, text, *_ in rows:
        w, t = spaced(text), text or ""
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if spaced(x)]
        dup, chars = len(lines) - len(set(lines)), sum(map(len, w))
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        marks, capitals, symbols = len(re.findall("[!-@]", t)), len(re.findall("[A-Z]", t)), len(re.findall(r"[#*$%&|<>]", t))
        bad = 10 * symbols > len(w) or 2 * dup > len(lines) or 4 * marks > chars or 2 * capitals > chars or chars < 2 * len(w) or chars > 20 * len(w)
        for r in got[doc_id]:
            assert tuple(r) == (doc_id, len(w), chars, symbols, dup, len(cover), failed, not failed and not bad)


def test_op2(spark, folder, rows, items):
    got = found(spark, folder, "op2_wu_manber")
    for doc_id, text, *_ in rows:
        n, hit, names = brute_hits(text, [(i, t or "") for i, t in items])
        names = sorted({x for x in names if x != "None"})
        for r in got[doc_id]:
            assert tuple(r) == (doc_id, n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0)


@pytest.mark.parametrize("block_mb", [8, 0.0006])
def test_op2_blocks(spark, folder, rows, items, block_mb):
    """A benchmark over the bound of a block, by the path that such a benchmark takes."""
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    n = len(list(decontaminate._benchmark_blocks(bench, "item_id", block_mb)))
    assert (n > 3) == (block_mb < 1)
    want = {doc_id: brute_hits(text, [(i, t or "") for i, t in items])[:2] for doc_id, text, *_ in rows}
    got = [(r["doc_id"], (r["n_words"], sum(b - a for a, b in zip(r["spans"][::2], r["spans"][1::2])))) for r in decontaminate.find_contamination(docs, bench, block_mb=block_mb).collect()]
    assert collections.Counter(got) == collections.Counter((r[0], want[r[0]]) for r in rows)
    clean = decontaminate.decontaminate(docs, bench, block_mb=block_mb)
    assert clean.columns == docs.columns and collections.Counter(r["doc_id"] for r in clean.collect()) == collections.Counter(r[0] for r in rows if not want[r[0]][1])


def test_op2_repeated_windows(spark):
    """Many items with one window, and buckets of many patterns with one suffix."""
    draw = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(draw.choice(words) for _ in range(60)) for _ in range(20)]
    items = [(i, " ".join([*(draw.choice(words) for _ in range(8)), "w1", "w2"])) for i in range(60)] + [(100 + i, "same words all over again and again in here now") for i in range(40)]
    texts += [items[3][1] + " w1 w2 " + items[9][1], "x same words all over again and again in here now", items[70][1] * 2]
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    for r in decontaminate.find_contamination(docs, bench).collect():
        n, hit, names = brute_hits(texts[r["doc_id"]], items)
        assert (r["n_words"], sum(b - a for a, b in zip(r["spans"][::2], r["spans"][1::2])), r["items"]) == (n, hit, sorted(set(names)))


def test_op3(spark, folder, rows):
    sizes, source = collections.Counter(), {r[0]: r[3] for r in rows}
    for r in rows:
        sizes[r[3]] += len(spaced(r[1]))
    target, taken = brute_targets(sizes), collections.Counter()
    got = found(spark, folder, "op3_mix_sources")
    again = found(spark, folder, "op3_mix_sources")
    assert sum(map(len, got.values())) == len(rows) and {k: sorted(map(tuple, v)) for k, v in got.items()} == {k: sorted(map(tuple, v)) for k, v in again.items()}
    for doc_id, text, *_ in rows:
        for r in got[doc_id]:
            assert r["size"] == len(spaced(text)) and r["source_size"] == sizes[source[doc_id]] and r["target"] == pytest.approx(target[source[doc_id]]) and 0 <= r["taken"] <= 2 * r["size"]
    for doc_id, rs in got.items():
        taken[source[doc_id]] += sum(r["taken"] for r in rs)
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_op3_draws(spark, folder):
    """Every slot is drawn once, every index of a source is taken once, and a shard's counts of sources are those of a multinomial draw."""
    sized = mixing._sized(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text", "source").persist()
    sources = mixing.plan_sources(sized, 4, 1.5, 2.0, mixing.WEIGHTS, 3)
    quota = {r["src"]: r["quota"] for r in sources.collect()}
    draws, n = mixing.shard_draws(sources, 512, 3)
    assert n == sum(quota.values())
    counts = collections.Counter((r["shard"], r["src"]) for r in draws.collect())
    size = collections.Counter()
    for (shard, _), c in counts.items():
        size[shard] += c
    assert sum(size.values()) == n and len(size) > 3 and max(size.values()) - min(size.values()) < 512
    square = sum((counts[shard, src] - size[shard] * q / n) ** 2 / (size[shard] * q / n) for shard in size for src, q in quota.items() if q)
    degrees = len(size) * (sum(q > 0 for q in quota.values()) - 1)
    assert abs(square - degrees) < 5 * math.sqrt(2 * degrees)
    slots = mixing.slots(sources, 4, 512, 3).collect()
    assert len({(r["shard"], r["slot"]) for r in slots}) == len(slots) == n
    assert collections.Counter(r["src"] for r in slots) == {s: q for s, q in quota.items() if q} and len({(r["src"], r["pass"], r["block"]) for r in slots}) == n
    moved = sum(abs(sum(c for (_, s), c in counts.items() if s == src) - q) for src, q in quota.items())
    assert moved < 8 * math.sqrt(n) * len(quota)


def brute_trees(texts):
    """Counts and evidence of every node of every tree, one by one."""
    count = collections.defaultdict(lambda: [0, 0])
    for t in texts:
        data = b"\n" * ctw.DEPTH + t + b"\n"
        for i in range(ctw.DEPTH, len(data)):
            for j in range(8):
                known, bit = 1 << j | data[i] >> (8 - j), data[i] >> (7 - j) & 1
                for d in range(ctw.DEPTH + 1):
                    count[data[i - d : i], known][bit] += 1
    kt = {k: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for k, (a, b) in count.items()}
    evidence, below = {}, collections.defaultdict(float)
    for k in sorted(count, key=lambda k: -len(k[0])):
        evidence[k] = kt[k] if len(k[0]) == ctw.DEPTH else math.log(0.5) + max(kt[k], below[k]) + math.log1p(math.exp(-abs(kt[k] - below[k])))
        if k[0]:
            below[k[0][1:], k[1]] += evidence[k]
    return count, kt, below


def brute_score(text, count, kt, below):
    data, score = b"\n" * ctw.DEPTH + text + b"\n", 0.0
    for i in range(ctw.DEPTH, len(data)):
        for j in range(8):
            known, bit = 1 << j | data[i] >> (8 - j), data[i] >> (7 - j) & 1
            p = 0.5
            for d in range(ctw.DEPTH, -1, -1):
                k = data[i - d : i], known
                if k in count:
                    w = 1.0 if d == ctw.DEPTH else 1 / (1 + math.exp(min(700.0, below[k] - kt[k])))
                    p += w * ((count[k][bit] + 0.5) / (sum(count[k]) + 1) - p)
            score += math.log10(p)
    return score


def test_op4(spark, tmp_path):
    """The query's scores are those of exact trees, held node by node."""
    draw = random.Random(2)
    words = ["the", "tree", "is", "Green", "über", "x", "leaf", "leaves", "12%"]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(1, 40))) for _ in range(40)] + [None, "", "  \n ", "zzz new words here"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "the tree")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    line = lambda t: " ".join(spaced(t, True)).encode()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    trees, c = brute_trees([line(t) for i, t in rows if not held(i)]), collections.Counter()
    for i, t in rows:
        if not held(i):
            c.update([*spaced(t, True), "\n"])
    n, v = sum(c.values()), len(c)
    got = found(spark, str(tmp_path), "op4_context_tree")
    for i, t in rows:
        w = [*spaced(t, True), "\n"]
        for r in got[i]:
            assert tuple(r)[:5] == (i, held(i), len(w), sum(c[x] > 0 for x in w), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) and r["score"] == pytest.approx(brute_score(line(t), *trees), rel=1e-6)


def test_op4_long_text():
    """The windows of a text that comes in several runs are those of the whole."""
    import numpy as np

    draw = random.Random(4)
    lines = [b"short", bytes(draw.choice(b"abc d") for _ in range(5 * ctw._PIECE // 2)), b"", b"end"]
    want, first = ctw._windows(lines)
    got = [(a, b, w) for a, b, w, _ in ctw._runs(lines)]
    assert len(got) > 2 and np.array_equal(np.concatenate([w for *_, w in got]), want)
    assert sum(len(w) for a, b, w in got if (a, b) == (1, 2)) == len(lines[1]) + 1


def test_op4_block_memory():
    """What a task holds for a block besides its lines and distinct windows doesn't grow with the block: counts are those of a plain count."""
    import tracemalloc

    import numpy as np

    def peak(f):
        tracemalloc.start()
        try:
            return f(), tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    draw = random.Random(5)
    texts = [" ".join(draw.choice(["a", "of", "the", "Tree", "ü"]) for _ in range(draw.randint(1, 3000))) for _ in range(900)]
    (lines, n_words), most = peak(lambda: ctw._lines(texts))
    assert lines == [" ".join(spaced(t, True)).encode() for t in texts] and n_words.sum() == sum(len(t.split()) for t in texts)
    assert most < 16  # 4 MB of lines; all words at once take over 50
    trained = np.array([i % 3 > 0 for i in range(len(lines))])
    assert peak(lambda: sum(len(w) for _, _, w, _ in ctw._runs(lines)))[1] < 16  # over 60 for runs of 2 MB
    found, most = peak(lambda: list(ctw._block_windows(lines, trained)))
    assert most < 48
    want = collections.Counter()
    for line, own in zip(lines, trained, strict=True):
        for w in ctw._windows([line])[0].tolist():
            want[w] += int(own)
    windows, n = (np.concatenate(x) for x in zip(*found, strict=True))
    assert dict(zip(windows.tolist(), n.tolist(), strict=True)) == dict(want) and (np.diff(windows.astype(np.int64)) > 0).all()
    assert (ctw._turned_back(ctw._turned(windows)) == windows).all()
    value = np.arange(len(windows)) / 7
    run = ctw._windows(lines[:200])[0]
    assert (ctw._looked_up(run, windows, value) == value[np.searchsorted(windows, run)]).all()


def test_op4_many_blocks(spark, monkeypatch):
    """Contexts that many blocks hold are mixed and scored in lots, whatever their size, with the same scores."""
    draw = random.Random(6)
    texts = [" ".join(draw.choice(["a", "of", "the", "tree"]) for _ in range(draw.randint(0, 30))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    kept = lambda **k: {r["doc_id"]: r for r in ctw.score_texts(docs, **k).collect()}
    want = kept()
    monkeypatch.setattr(ctw, "_GROUP", 5)
    monkeypatch.setattr(ctw, "_PAIRS", 20)
    got = kept(block_bytes=100)
    assert got.keys() == want.keys() and len(got) == len(texts)
    for i, r in want.items():
        assert tuple(got[i])[:5] == tuple(r)[:5] and got[i]["base_score"] == pytest.approx(r["base_score"]) and got[i]["score"] == pytest.approx(r["score"], rel=1e-6)


def test_op5(spark, folder, rows):
    import tiktoken

    enc = tiktoken.Encoding("x", pat_str=tokens.PATTERN, mergeable_ranks=tokens.read_ranks(tokens.VOCABULARY), special_tokens={})
    got, crossed = found(spark, folder, "op5_offset_tokens"), 0
    for doc_id, text, *_ in rows:
        parts = [] if not text else [text[:100]] + [x for x in text[100:].splitlines(keepends=True)] if "\r" not in text and "\x0b" not in text else None
        assert parts is not None
        ends, at, want, touched = [len("".join(parts[: i + 1]).encode()) for i in range(len(parts))], 0, collections.Counter(), collections.Counter()
        for i in enc.encode_ordinary(text or ""):
            size = len(enc.decode_single_token_bytes(i))
            a, b = (sum(e <= k for e in ends) for k in (at, at + size - 1))
            want[a] += 1
            crossed += a != b
            touched.update(range(a, b + 1) if a != b else [])
            at += size
        rs = sorted(got[doc_id], key=lambda r: r["section"] or 0)
        copies = len(rs) // max(1, len(parts))
        if not parts:
            assert all(tuple(r)[1:] == (None, None, 0, 0, 0, 0) for r in rs)
        for s, part in enumerate(parts):
            for r in rs[copies * s : copies * (s + 1)]:
                assert tuple(r) == (doc_id, s, "body" if s else "head", sum(want.values()), want[s], touched[s], len(part.encode()))
    assert crossed > 10


def test_op6(spark, folder, rows):
    first = {}
    for doc_id, text, *_ in rows:
        w = spaced(text)
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, doc_id), doc_id)
    got = found(spark, folder, "op6_substring_doubling")
    for doc_id, text, *_ in rows:
        w = spaced(text)
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < doc_id for j in range(i, i + 13)}
        for r in got[doc_id]:
            assert tuple(r) == (doc_id, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())


def test_op6_string_keys(spark, rows):
    from codonspark.llm import substrings

    base = " ".join(f"w{i}" for i in range(40))
    data = [("b", base), ("a", "x " + base), (None, base + " y"), ("c", "short")]
    got = {r["name"]: r["kept"] for r in substrings.drop_repeats(spark.createDataFrame(data, "name string, text string"), key="name").collect()}
    assert got == {"a": "x " + base, "b": "", None: "y", "c": "short"}


def test_op7(spark, folder, rows):
    got = found(spark, SF, "op7_language_crf")
    lang = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(got) == set(lang)
    for i, rs in got.items():
        for r in rs:
            assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["n_words"] == len(language.letter_words(lang[i][1]))
    tested = [(rs[0]["lang_pred"], lang[i][0]) for i, rs in got.items() if rs[0]["held_out"] and lang[i][0] and rs[0]["lang_pred"] != "und"]
    assert sum(a == b for a, b in tested) / len(tested) > 0.95
    got = found(spark, folder, "op7_language_crf")
    for doc_id, text, *_ in rows:
        assert all((r["lang_pred"] == "und") == (not any(x.isalpha() for x in text or "")) for r in got[doc_id])


def test_op7_code_switch(spark):
    """Words of a text that goes over from one language to another get their own labels; a long text equals one unbroken chain."""
    import numpy as np

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang IS NOT NULL AND n_chars > 400").orderBy("doc_id").collect()
    field = language.train(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id AS key", "text", "lang"), per_label=40)
    by = {x: [w for r in docs if r["lang"] == x for w in language.letter_words(r["text"])][:4000] for x in field.labels}
    one, two = field.labels[:2]
    mixed = by[one][:60] + by[two][:60]
    total, best = language._label([mixed], field)
    named = [field.labels[i] for i in best[0]]
    assert sum(x == y for x, y in zip(named, [one] * 60 + [two] * 60)) > 100
    texts = [(by[one] + by[two] + by[one])[:n] for n in (5000, 3, 0, language.CHAIN, language.CHAIN + 1, 2 * language.CHAIN)]
    pieces, whole = language._label(texts, field), None
    short, language.CHAIN = language.CHAIN, 1 << 30
    try:
        whole = language._label(texts, field)
    finally:
        language.CHAIN = short
    assert np.allclose(pieces[0], whole[0], rtol=1e-4, atol=1e-2) and all((a == b).all() for a, b in zip(pieces[1], whole[1]))


def slow_jump(key, n):
    at, ahead, key = -1, 0, key % 2**64
    while ahead < n:
        at, key = ahead, (key * 2862933555777941757 + 1) % 2**64
        ahead = int((at + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return at


def test_op8(spark, folder, rows):
    got, slots = found(spark, folder, "op8_jump_sharding"), collections.defaultdict(list)
    assert sum(map(len, got.values())) == len(rows)
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        for r in got[doc_id]:
            assert tuple(r)[:5] == (doc_id, len(data) + 16, zlib.crc32(data), "key", slow_jump(doc_id, 40)) and r["grown_shard"] == slow_jump(doc_id, 41)
    for rs in got.values():
        for r in rs:
            slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_op8_hot_key(spark):
    """A key that most rows share is dealt over bins; names of the operator's columns in the input give way."""
    docs = spark.range(500).selectExpr("CASE WHEN id < 400 THEN NULL ELSE id END AS doc_id", "id AS slot", "'x' AS Shard", "'keep' AS bin")
    out = sharding.shard(docs, 3, bin_rows=4)
    assert out.columns == ["doc_id", "bin", "shard", "grown_shard", "slot"]
    slots = collections.defaultdict(list)
    for r in out.collect():
        slots[r["shard"]].append(r["slot"])
    assert sum(map(len, slots.values())) == 500 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_op9(spark, folder, rows):
    prints = {r[0]: brute_fingerprint(r[1]) for r in rows}
    want, got = components(prints), found(spark, folder, "op9_simhash_anchors")
    assert sum(map(len, got.values())) == len(rows)
    for i in prints:
        assert all(tuple(r) == (i, f"{prints[i]:016x}", want[i]) for r in got[i])


def brute_licenses(text):
    """All matches of all rules, then the order of priority, length and place, one inside another left out."""
    scanner, t = licenses.Scanner(), lower(text)
    hits = sorted((licenses.FORMS[r.form][0], a - b, a, b, i) for i, r in enumerate(licenses.RULES) for a, b in scanner.places(i, t))
    kept = []
    for _, _, a, b, i in hits:
        if not any(x <= a and b <= y for x, y, _ in kept):
            kept.append((a, b, i))
    return {licenses.RULES[i].label for *_, i in kept}, max([licenses.FORMS[licenses.RULES[i].form][1] for *_, i in kept], default=0.0)


def test_op10(spark, folder, rows):
    got = found(spark, folder, "op10_license_rules")
    for doc_id, text, *_ in rows:
        w = PLAIN.findall(lower(text))
        base = [(i, label) for p, label in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.decode().split()]
        labels, score = brute_licenses(text)
        names, places = {x for _, x in base}, [i for i, _ in base]
        for r in got[doc_id]:
            assert tuple(r) == (doc_id, len(w), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(names)), ",".join(sorted(names | labels)), max(score, 0.6 if base else 0.0))


def samples(pattern):
    """Strings of a pattern, every branch of it taken."""
    from re import _constants as C
    from re import _parser as P

    kind = {C.CATEGORY_WORD: "w", C.CATEGORY_NOT_WORD: " ", C.CATEGORY_SPACE: " ", C.CATEGORY_DIGIT: "1"}

    def of(tree):
        out = [""]
        for op, x in tree:
            if op is C.LITERAL:
                part = [chr(x)]
            elif op in (C.ANY, C.NOT_LITERAL):
                part = ["x"]
            elif op is C.IN:
                part = ["z"] if x[0][0] is C.NEGATE else [chr(v) if o is C.LITERAL else chr(v[0]) if o is C.RANGE else kind[v] for o, v in x]
            elif op is C.BRANCH:
                part = [s for b in x[1] for s in of(b)]
            elif op is C.SUBPATTERN:
                part = of(x[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                part = ([""] if x[0] == 0 else []) + [s * max(1, x[0]) for s in of(x[2])]
            else:
                part = [""]
            out = [a + b for a in out for b in part]
            out = out[:: len(out) // 400 + 1]
        return out

    return of(P.parse(pattern))


def test_op10_gate():
    """Samples of every rule, all branches: what is found without the keywords is found behind them."""
    scanner = licenses.Scanner()
    assert sum(r.form == "notice" for r in licenses.RULES) > 200 and len(licenses._NOTICES) >= 100
    for i, r in enumerate(licenses.RULES):
        texts = [f" {x} " for x in samples(r.pattern)]
        texts = [t for t in texts if scanner.places(i, t)]
        assert texts, r
        for t in texts:
            gated = {j for _, k in scanner.gate.iter(licenses._joined(t)) for j in scanner.by[k]}
            assert i in gated, (r, t)


def test_op10_time():
    """Rules on their samples, cut at any word and followed by long gaps, dashes and marks, take time in proportion."""
    scanner = licenses.Scanner()
    for i, r in enumerate(licenses.RULES):
        words = max(samples(r.pattern), key=len).split(" ")
        for k in {1, 2, len(words) // 2, len(words) - 1, len(words)} - {0}:
            for filler in (" ", "-", "- ", "# ", "the license "):
                began = time.thread_time()
                scanner.places(i, " ".join(words[:k]) + filler * (20_000 // len(filler)) + "x")
                assert time.thread_time() - began < 1, (r, k, filler)
    for text in ("gpl" + " " * 1_000_000 + "x", "licensed under the gpl" + " -" * 500_000, "gnu general public license" + "the license " * 80_000, "creative commons attribution" + "-" * 1_000_000, "the name of the" + "\n" * 1_000_000 + "nor"):
        began = time.thread_time()
        scanner.detect(text)
        assert time.thread_time() - began < 10, text[:40]
    assert [r.label for _, _, r in scanner.detect("released under the gnu" + " \n# " * 10 + "general public license,   version 2" + " " * 50)] == ["gpl-2.0"]


def test_quality_long_word(spark):
    """One word of a million letters takes no longer than its length."""
    docs = spark.createDataFrame([(1, "x" * 1_000_000), (2, "a b c " * 3)], "doc_id long, text string")
    assert [r["n_repeat_words"] for r in quality.quality_report(docs).orderBy("doc_id").collect()] == [0, 9]


def test_quality_sample_of_files(spark, tmp_path):
    """Of many files some are opened, and rows of those come out."""
    from pyspark.sql import functions as F

    spark.range(1200).repartition(12).selectExpr("id AS doc_id", "concat('word ', id) AS text").write.parquet(f"{tmp_path}/many")
    docs = spark.read.parquet(f"{tmp_path}/many")
    found = quality._sampled(docs, 100, 7)
    assert len(docs.inputFiles()) == 12 and 40 < found.count() < 200 and found.select(F.input_file_name()).distinct().count() <= 8
    assert quality._sampled(docs.where("false"), 100, 7).count() == 0 and quality._sampled(docs, 5000, 7).count() == 800
