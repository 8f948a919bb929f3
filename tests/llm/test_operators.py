"""Each operator against a brute-force version, over given rows and edge cases."""

import collections
import hashlib
import math
import re
import zlib

import pytest
import xxhash

from codonspark.llm import ctw, decontaminate, language, licenses, mixing, quality, sharding, simhash, substrings, tokens

SF = "/root/testdata/sf0.001"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, src int, block long, n long, word string, fp long, shard int, size long"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group(0).lower(), text or "")


def spaced(text, low=False):
    return SPACED.findall(lower(text) if low else text or "")


@pytest.fixture(scope="module")
def rows(spark):
    given = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(90).collect()]
    base = given[3]["text"]
    edge = [None, "", " \n\t", "one", "one two", "a b a b a b a b", "é è x", "12 !!", "x" * 50_000, base, base, base + " end", "\n".join(["line of text"] * 60), " lead and trail ", "word " * 30_000]
    out = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in given]
    out += [(1000 + i, t, "en" if i % 3 else None, None if i % 2 else "zz") for i, t in enumerate(edge)]
    out += [out[5], out[5]]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 0, 1, "k", 2, 3, 4, "w", 5, 6, 7) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


def test_quality(docs, rows, empty):
    got = by_id(quality.quality_report(docs, sample_rows=20))
    for doc_id, text, *_ in rows:
        w = spaced(text)
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover))
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        for r in got[doc_id]:
            assert tuple(r[1:6]) == want and r["base_failed"] == failed and not (failed and r["kept"])
    kept = collections.Counter(r["doc_id"] for r in quality.quality_filter(docs, sample_rows=20).collect())
    assert kept == collections.Counter(r["doc_id"] for rs in got.values() for r in rs if r["kept"])
    assert quality.quality_report(empty).count() == 0 and quality.quality_filter(empty).columns == empty.columns


def test_quality_order(docs):
    rules = quality.order_rules(docs, quality.RULES, sample_rows=50)
    assert sorted(r.name for r, _, _ in rules) == sorted(r.name for r in quality.RULES)
    rates = [share / seconds for _, seconds, share in rules]
    assert rates == sorted(rates, reverse=True)


def brute_hits(text, items):
    w, hit, found = PLAIN.findall(lower(text)), set(), set()
    for item, other in items:
        o = PLAIN.findall(lower(other))
        k = min(10, len(o))
        windows = {tuple(o[i : i + k]) for i in range(len(o) - k + 1)} if k else set()
        for i in range(len(w) - k + 1) if k else ():
            if tuple(w[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def bench(spark, rows):
    w = PLAIN.findall(rows[7][1])
    items = [(1, " ".join(w[3:20])), (2, " ".join(w[8:30]).upper()), (10, "one"), (11, "b a"), (12, None), (13, "!!"), (14, "line of text line of text line of text line"), (15, "word " * 12)]
    return spark.createDataFrame(items, "item_id int, text string")


@pytest.mark.parametrize("blocks", [1, 3])
def test_wu_manber(docs, rows, bench, empty, blocks, monkeypatch):
    items = [(r[0], r[1]) for r in bench.collect()]
    if blocks > 1:
        cut = lambda *a: iter([[(str(i), t) for i, t in items if i % blocks == k and t] for k in range(blocks)])
        monkeypatch.setattr(decontaminate, "_benchmark_blocks", cut)
    got = by_id(decontaminate.find_contamination(docs, bench))
    for doc_id, text, *_ in rows:
        n, hit, found = brute_hits(text, items)
        for r in got[doc_id]:
            assert (r["n_words"], sum(b - a for a, b in zip(r["spans"][::2], r["spans"][1::2])), r["items"]) == (n, hit, found)
    clean = collections.Counter(r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect())
    assert clean == collections.Counter(r[0] for r in rows if not brute_hits(r[1], items)[1])
    assert decontaminate.find_contamination(empty, bench).count() == 0
    if blocks == 1:
        assert decontaminate.decontaminate(docs, bench.where("false")).count() == len(rows)


def brute_targets(sizes, share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        left, open_ = left - sum(2 * sizes[s] for s in full), open_ - full
    return target


@pytest.mark.parametrize("block", [7, 512])
def test_mixing(docs, rows, empty, block):
    sizes, source = collections.Counter(), {r[0]: r[3] for r in rows}
    for r in rows:
        sizes[r[3]] += len(spaced(r[1]))
    target = brute_targets(sizes)
    found = mixing.mixed_counts(docs, block=block, shard_slots=16).collect()
    again = mixing.mixed_counts(docs, block=block, shard_slots=16).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again)) and len(found) == len(rows)
    taken = collections.Counter()
    for r in found:
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]])
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    assert mixing.mixed_counts(empty).count() == 0


def test_mixed_documents(docs, rows):
    whole = docs.dropDuplicates(["doc_id"])
    counts = {r["doc_id"]: r["taken"] for r in mixing.mixed_counts(whole, block=16).collect()}
    got = collections.Counter()
    text = {r[0]: spaced(r[1]) for r in rows}
    for r in mixing.mixed_documents(whole, block=16).collect():
        w = spaced(r["text"])
        got[r["doc_id"]] += len(w)
        assert not collections.Counter(w) - collections.Counter(text[r["doc_id"]])
    assert abs(sum(got.values()) - sum(counts.values())) <= 30


def test_mixed_documents_without_keys(spark):
    """Rows without a key, or under one key, count and are packed each for itself."""
    data = [(None if i % 3 else 7, " ".join(f"w{i}x{k}" for k in range(10 + 7 * i)), "a") for i in range(30)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    n = sum(len(t.split()) for _, t, _ in data)
    got = [w for r in mixing.mixed_documents(docs, block=16).collect() for w in r["text"].split()]
    assert len(got) == pytest.approx(1.5 * n, abs=1) and len(set(got)) == n


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 1000):
        x = spark.range(n).withColumn("p", mixing.shuffled(F.col("id"), F.lit(n).cast("long"), F.lit(5))).withColumn("q", mixing.shuffled(F.col("p"), F.lit(n).cast("long"), F.lit(5), inverse=True)).collect()
        assert sorted(r["p"] for r in x) == list(range(n)) and all(r["q"] == r["id"] for r in x)


def test_context_tree(docs, rows, empty):
    got, c = by_id(ctw.score_texts(docs)), collections.Counter()
    for doc_id, text, *_ in rows:
        if zlib.crc32(str(doc_id).encode()) % 7 != 2:
            c.update([*spaced(text, True), "\n"])
    n, v = sum(c.values()), len(c)
    ctw_bits = base_bits = 0
    for doc_id, text, *_ in rows:
        w = [*spaced(text, True), "\n"]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        for r in got[doc_id]:
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(doc_id).encode()) % 7 == 2, len(w), sum(c[x] > 0 for x in w), n)
            assert r["base_score"] == pytest.approx(base) and r["score"] < 0
            if r["held_out"] and doc_id < 1000:
                ctw_bits, base_bits = ctw_bits + r["bits_per_byte"], base_bits + 1
    assert ctw_bits / base_bits < 3.5  # letters alone need more than 4
    assert ctw.score_texts(empty).count() == 0


def test_context_tree_is_a_law(docs):
    """The probabilities of all next bytes sum to one, whatever the context."""
    import numpy as np
    from pyspark.sql import functions as F

    tables = ctw.train(docs.select(F.col("doc_id").alias("key"), "text"))
    for context in (b"\n\n\n\n\n", b"s the", b"\xff\x00zzz"):
        ctx = np.uint64(int.from_bytes(context, "big"))
        p = 10 ** ctw.log10_windows((ctx << np.uint64(8)) | np.arange(256, dtype=np.uint64), tables)
        assert p.sum() == pytest.approx(1, abs=1e-6)


def test_context_tree_is_exact(docs, rows):
    """Every node keeps its own counts: scores equal those of the nodes of all depths, held one by one."""
    from pyspark.sql import functions as F

    tables = ctw.train(docs.select(F.col("doc_id").alias("key"), "text"))
    for doc_id, got in by_id(ctw.score_texts(docs, block_bytes=100_000)).items():
        text = next(r[1] for r in rows if r[0] == doc_id)
        windows, _ = ctw._windows(ctw._lines([text])[0])
        want = ctw.log10_windows(windows, tables).sum()
        assert [r["score"] for r in got] == pytest.approx([want] * len(got), rel=1e-5), doc_id


@pytest.mark.parametrize("rule", tokens.RULES)
def test_tokens(docs, rows, empty, rule):
    import numpy as np
    import tiktoken

    ranks = tokens.read_ranks(tokens.VOCABULARY)
    enc = tiktoken.Encoding("x", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    thirds = lambda data: np.unique([len(data) * i // 3 for i in (1, 2, 3)])[-3:] if data else np.empty(0, dtype=np.int64)
    cut = lambda data: thirds(data)[thirds(data) > 0]
    got = by_id(tokens.section_tokens(docs, rule=rule, sections=cut))
    for doc_id, text, *_ in rows:
        data, at, want, crossing = (text or "").encode(), 0, collections.Counter(), 0
        ends = cut(data).tolist()
        ids = enc.encode_ordinary(text or "")
        for i in ids:
            size = len(enc.decode_single_token_bytes(i))
            part = [sum(1 for e in ends if e <= k) for k in range(at, at + size)]
            crossing += part[0] != part[-1]
            share = collections.Counter(part)
            if rule == "first":
                want[part[0]] += 1
            elif rule == "last":
                want[part[-1]] += 1
            elif rule == "most":
                want[min(share, key=lambda s: (-share[s], s))] += 1
            else:
                for s, k in share.items():
                    want[s] += k / size
            at += size
        assert at == len(data)
        for r in got[doc_id]:
            assert (r["n_tokens"], r["n_crossing"], len(r["sections"])) == (len(ids), crossing, len(ends))
            assert [x["n_tokens"] for x in r["sections"]] == pytest.approx([want[i] for i in range(len(ends))])
    assert tokens.section_tokens(empty).count() == 0


@pytest.mark.parametrize("block_bytes", [2000, 8 << 20])
def test_substrings(docs, rows, empty, block_bytes):
    first = {}
    for doc_id, text, *_ in rows:
        w = spaced(text)
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, doc_id), doc_id)
    got = by_id(substrings.drop_repeats(docs, block_bytes=block_bytes))
    for doc_id, text, *_ in rows:
        w = spaced(text)
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < doc_id for j in range(i, i + 13)}
        for r in got[doc_id]:
            assert r["n_words"] == len(w) and sum(b - a for a, b in zip(r["removed"][::2], r["removed"][1::2])) == len(gone)
            assert r["kept"] == " ".join(x for j, x in enumerate(w) if j not in gone)
    assert substrings.drop_repeats(empty).count() == 0


def test_language(spark, docs, rows, empty):
    train = spark.read.parquet(f"{SF}/documents.parquet")
    field = language.train(train.selectExpr("doc_id AS key", "text", "lang"), per_label=40)
    found = language.identify(train, field=field).join(train.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.95
    got = by_id(language.identify(docs, field=field))
    for doc_id, text, *_ in rows:
        for r in got[doc_id]:
            assert 0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (not any(x.isalpha() for x in text or ""))
            assert sum(s["n"] for s in r["spans"]) == r["n_words"]
    assert language.identify(empty).count() == 0 and language.identify(empty.union(docs.where("text IS NULL"))).first()["lang_pred"] == "und"


def test_forward_backward():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    emit, moves = rng.normal(size=(3, 4, 3)), rng.normal(size=(3, 3))
    want = np.zeros_like(emit)
    for s in range(3):
        for y in itertools.product(range(3), repeat=4):
            p = math.exp(sum(emit[s, t, y[t]] for t in range(4)) + sum(moves[y[t], y[t + 1]] for t in range(3)))
            for t in range(4):
                want[s, t, y[t]] += p
    want /= want.sum(axis=2, keepdims=True)
    assert np.allclose(language.forward_backward(emit, moves)[0], want)
    assert np.allclose(language._masked(emit, moves, np.array([4, 4, 4])), want)
    short = language._masked(emit, moves, np.array([4, 3, 2]))
    assert np.allclose(short[0], want[0]) and np.allclose(short[2, :2], language.forward_backward(emit[2:3, :2], moves)[0][0])


def test_sharding(docs, rows, empty):
    found = sharding.shard(docs.drop("shard"), 5, keep=["doc_id", "text", "size"], bin_rows=1).collect()
    assert len(found) == len(rows)
    slots = collections.defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 5)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.shard(empty.drop("shard"), 5).count() == 0


def test_jump_hash():
    import numpy as np

    def slow(key, n):
        at, ahead = -1, 0
        while ahead < n:
            at, key = ahead, (key * 2862933555777941757 + 1) % 2**64
            ahead = int((at + 1) * (float(1 << 31) / ((key >> 33) + 1)))
        return at

    keys = np.array([0, 1, 2, 10**12, -5, 2**62])
    for n in (1, 2, 40, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [slow(int(k) % 2**64, n) for k in keys]
    counts = np.bincount(sharding.jump_hash(np.arange(40_000), 40), minlength=40)
    assert counts.min() > 850 and counts.max() < 1150


def brute_fingerprint(text, k=3):
    w = [x.encode() for x in spaced(text, True)]
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def components(prints):
    """Least id reachable by links of 3 bits or fewer."""
    up = {i: i for i in prints}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash(docs, rows, empty):
    prints = {r[0]: brute_fingerprint(r[1]) for r in rows}
    want, got = components(prints), by_id(simhash.near_duplicates(docs))
    assert sum(map(len, got.values())) == len(rows)
    for doc_id in prints:
        for r in got[doc_id]:
            assert r["fp"] % 2**64 == prints[doc_id] and r["component_id"] == want[doc_id]
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("group", [4096, 5])
def test_links(spark, group, monkeypatch):
    """Chains and dense clouds of fingerprints, with anchors whole and cut into parts."""
    import random

    monkeypatch.setattr(simhash, "GROUP", group)
    draw = random.Random(3)
    prints = set()
    for _ in range(8):
        x = draw.getrandbits(64)
        for _ in range(30):
            prints.add(x)
            for b in draw.sample(range(64), draw.choice((1, 2, 3, 3))):
                x ^= 1 << b
    prints |= {draw.getrandbits(64) for _ in range(60)}
    ids = dict(enumerate(sorted(prints)))
    signed = [((p + 2**63) % 2**64 - 2**63,) for p in ids.values()]
    roots = {r["node"] % 2**64: r["root"] % 2**64 for r in simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()}
    groups, want = collections.defaultdict(set), collections.defaultdict(set)
    for i, r in components(ids).items():
        want[r].add(ids[i])
        groups[roots.get(ids[i], ids[i])].add(ids[i])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_licenses(spark, docs, rows, empty):
    texts = {
        1: ("Released under the MIT License.", "mit", "mit"),
        2: ("Licensed under the Apache License, Version 2.0 (the License)", "apache", "apache,apache-2.0"),
        3: ("the GNU General Public License, version 3.", "gpl", "gpl,gpl-3.0"),
        4: ("SPDX-License-Identifier: GPL-2.0-or-later", "", "gpl-2.0-or-later"),
        5: ("Creative Commons Attribution-ShareAlike 4.0", "", "cc-by-sa-4.0"),
        6: ("commit license to memory; submit license. mit\nlicense", "mit", "mit"),
        7: ("nothing here", "", ""),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in texts.items()], "doc_id long, text string")
    for i, got in by_id(licenses.scan_licenses(df)).items():
        base = {x["label"] for x in got[0]["base"]}
        assert ",".join(sorted(base)) == texts[i][1] and ",".join(sorted(base | {x["label"] for x in got[0]["found"]})) == texts[i][2]
    got = by_id(licenses.scan_licenses(docs))
    for doc_id, text, *_ in rows:
        w = PLAIN.findall(lower(text))
        want = sorted((i, label) for p, label in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.decode().split())
        for r in got[doc_id]:
            assert r["n_words"] == len(w) and [(x["word"], x["label"]) for x in r["base"]] == want and 0 <= r["score"] <= 1
    assert licenses.scan_licenses(empty).count() == 0 and len(licenses.RULES) > 200


def test_license_rules_ungated():
    """The keyword gate loses no detection: every rule's match holds a keyword of its own."""
    scanner = licenses.Scanner()
    text = "gnu lesser general public license version 2.1 or any later version, apache license 2.0; eclipse public license v2.0, mozilla public licence 1.1; isc license"
    gated = {(a, b, r.label) for a, b, r in scanner.detect(text)}
    for r in licenses.RULES:
        for m in re.finditer(r.pattern, text):
            assert any(a <= m.start() and m.end() <= b for a, b, _ in gated), r


def test_licenses_wrapped():
    """Phrases broken over lines and comment marks, through the gate."""
    scanner = licenses.Scanner()
    texts = {
        "redistribution and use in source and binary forms, with or without\n# modification, are permitted": "bsd",
        "permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee": "isc",
        "neither the name of the\n * copyright holder nor the names of its\n * contributors may be used": "bsd-3-clause",
        "terms of the gnu general public\n// license as published by\n// the free software foundation; either version 2 of the license, or\n// (at your option) any later version": "gpl-2.0-or-later",
        "licensed under the apache license,\n *    version 2.0": "apache-2.0",
        "creative\n-- commons attribution 4.0": "cc-by-4.0",
        "permission is hereby\n; granted, free of charge, to any person\n; obtaining a copy": "mit",
        "licensed under ms-pl": "ms-pl",
        "licensed under ms-rl.": "ms-rl",
    }
    for text, label in texts.items():
        assert label in {r.label for _, _, r in scanner.detect(text)}, text
    for r in licenses.RULES:
        re.compile(licenses.wrapped(r.pattern), re.DOTALL)
    assert not scanner.detect("path/mit/license of emit licensed")
