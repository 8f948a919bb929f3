"""The pipeline's stages, each against its operator's brute force, over small tables."""

import collections

import pytest

from .test_operators import SPACED, brute_fingerprint, brute_hits, lower

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = SPACED.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_components(texts):
    """Least doc_id reachable by fingerprints within 3 bits or Jaccard similarity of 0.8, both over five words."""
    prints, sets = {i: brute_fingerprint(t, 5) for i, t in texts.items()}, {i: shingles(t) for i, t in texts.items()}
    least = {i: i for i in texts}
    linked = [(a, b) for a in texts for b in texts if a < b and ((prints[a] ^ prints[b]).bit_count() <= 3 or (sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])))]
    for _ in texts:
        before = dict(least)
        for a, b in linked:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    return least


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    base = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        path = str(base / name)
        stage(spark, docs, SF).write.parquet(path)
        docs, before = spark.read.parquet(path), docs
        out.append((name, before, docs))
    return out


def test_stages(spark, steps):
    columns = steps[0][1].columns
    for name, before, after in steps[:-1]:
        assert after.columns == columns, name
    _, before, after = steps[1]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    want = {i for i, c in near_components(texts).items() if i == c}
    assert {r["doc_id"] for r in after.collect()} == want
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    _, before, after = steps[2]
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect() if not brute_hits(r["text"], items)[1]}
    _, before, after = steps[3]
    words = lambda df: sum(len(SPACED.findall(r["text"])) for r in df.collect())
    assert words(after) == pytest.approx(1.5 * words(before), abs=40)
    last = steps[4][2].collect()
    slots = collections.defaultdict(list)
    for r in last:
        slots[r["shard"]].append(r["slot"])
    assert len(last) == steps[3][2].count() and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_near_dedup_without_keys(spark):
    """Different texts without doc_id, or under one, are each kept; their copies are not."""
    import corpus_pipeline

    one, two, three = (" ".join(f"{c}{k}" for k in range(60)) for c in "abc")
    data = [(None, one), (None, two), (5, three), (5, two), (5, one), (6, three), (None, three)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, SF)
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted((5, t) for t in (one, two, three))
    got = corpus_pipeline.near_dedup(spark, docs.where("doc_id IS NULL"), SF)
    assert sorted(r["text"] for r in got.collect()) == sorted((one, two, three))


def test_run(spark, steps):
    import corpus_pipeline

    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "n_bytes", "shard").collect()))
    assert got == sorted(map(tuple, steps[4][2].select("doc_id", "n_bytes", "shard").collect()))


def test_edges(spark, tmp_path):
    """Nulls in any column, repeated rows, empty tables."""
    import corpus_pipeline

    text = " ".join(a + b + c for a in ("ba", "ke", "mo") for b in "aeiou" for c in ("ra", "text", "lin", "su"))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (None, text, None, None, None), (2, None, None, None, None), (3, "", "en", "b", 0), (4, text.replace("text", "book"), None, None, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{len(data)}-{name}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
        assert bool(docs.count()) == bool(data)


def small_graph():
    """Edges of a star, a chain, a tree of hubs and repeats, and the least node that each node reaches."""
    chain = [(k * 37 % 101 + 1000, (k + 1) * 37 % 101 + 1000) for k in range(99)]
    edges = [(5000, k) for k in range(2000, 2400)] + chain + chain[:9] + [(3000 + k, 3000 + k // 4) for k in range(1, 200)] + [(7, 7)]
    least = {x: x for e in edges if e[0] != e[1] for x in e}
    while True:
        before = dict(least)
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
        if before == least:
            return edges, {n: r for n, r in least.items() if n != r}


@pytest.mark.parametrize("few", [0, 100, None])
def test_components_of_few_edges(spark, few):
    """Few edges or many, plain nodes or structs: the same roots."""
    from codonspark.llm import simhash

    edges, want = small_graph()
    more = {} if few is None else {"few": few}
    plain = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["root"] for r in simhash.components(plain, **more).collect()} == want
    pairs = plain.selectExpr("struct(0L AS s, a AS t) AS a", "struct(0L AS s, b AS t) AS b")
    assert {r["node"]["t"]: r["root"]["t"] for r in simhash.components(pairs, **more).collect()} == want


def test_components_tasks(spark):
    """Rounds over few edges have few tasks, whatever the number of shuffle partitions."""
    from codonspark.llm import simhash

    edges, want = small_graph()
    own = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    sc = spark.sparkContext
    try:
        sc.setJobGroup("components", "")
        got = simhash.components(spark.createDataFrame(edges, "a long, b long"))
        tracker = sc.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(stages) > 8 and sum(x.numCompletedTasks for s in stages if (x := tracker.getStageInfo(s))) < 400
    assert {r["node"]: r["root"] for r in got.collect()} == want


def test_near_dedup_leaves_little(spark):
    """Of what near_dedup writes to the shared folder only the rows and the ids of those to drop stay."""
    import os

    import corpus_pipeline
    from codonspark.llm.common import shared_dir

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    top = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(top))
    got = corpus_pipeline.near_dedup(spark, docs, SF)
    left = [x for x in set(os.listdir(top)) - before if x.startswith(("staged-", "edges-"))]
    assert len(left) == 2 and got.count()
