"""The n-gram Jaccard join and connected components against brute force."""

import os
import random
import re

import numpy as np
import pytest
from cases import docs, rows

from tessera.llm import jaccard
from tessera.llm.graph import components

SF = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(made, n, percent):
    sets = [shingles(r[1], n) for r in made]
    root = list(range(len(made)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(made)):
        for j in range(i):
            if sets[i] and sets[j] and made[i][0] is not None and made[j][0] is not None and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(made):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), None if r[0] is None else least[find(i)]) for i, r in enumerate(made)), key=str)


def families(seed=1, many=14):
    """Texts with near copies at all distances round the bound, chains, shared passages and exact copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(4))
    passage = [word() for _ in range(40)]
    made, k = [], 0
    for f in range(many):
        base = [word() for _ in range(rng.randint(6, 150))]
        for _ in range(rng.randint(1, 9)):
            text = [*base]
            for _ in range(rng.randint(0, 1 + len(base) // 40)):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.3:
                at = rng.randrange(len(text))
                text[at:at] = passage
            if rng.random() < 0.3:
                text = text[: int(len(text) * rng.uniform(0.8, 1))]
            if rng.random() < 0.4:
                base = text  # the chain goes on from here
            made.append((k, " ".join(text), None, None, 0, None, None))
            k += 1 + f % 2
    rng.shuffle(made)
    return made + made[:5]


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_join_is_exact(spark, n, percent):
    made = families() + [(None if r[0] is None else r[0] + 1000, *r[1:]) for r in rows()]
    got = sorted((tuple(r) for r in jaccard.join(docs(spark, made), n=n, percent=percent).collect()), key=str)
    assert got == brute(made, n, percent)


def test_large_regions_are_cut_into_chunks(spark):
    made = families(2)
    got = sorted((tuple(r) for r in jaccard.join(docs(spark, made), n=4, percent=85, region_limit=4).collect()), key=str)
    assert got == brute(made, 4, 85)


@pytest.mark.parametrize("limit", [20_000, 4])
def test_links_are_counted(spark, limit):
    made = families(2) + [(None if r[0] is None else r[0] + 1000, *r[1:]) for r in rows()]
    sets = [shingles(r[1], 4) if r[0] is not None else set() for r in made]
    links = [sum(i != j and bool(a) and 100 * len(a & b) >= 85 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    want = [(*row, k) for row, k in zip([(r[0], len(shingles(r[1], 4))) for r in made], links, strict=True)]
    got = jaccard.join(docs(spark, made), n=4, percent=85, region_limit=limit, links=True).collect()
    assert max(links) >= 3  # groups whose links are more than a forest
    assert sorted(((r.doc_id, r.n_shingles, r.n_links) for r in got), key=str) == sorted(want, key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(made, 4, 85)


def test_empty_table(spark):
    assert jaccard.join(docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_region_join(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(12):
        base = rng.choice(4000, rng.integers(20, 200), replace=False)
        for _ in range(rng.integers(1, 30)):
            some = base[rng.random(len(base)) > rng.uniform(0, 0.15)]
            sets.append(np.unique(np.concatenate([some, rng.choice(4000, rng.integers(0, 8))])).astype(np.uint64))
    join = jaccard.RegionJoin(sets, 85)
    root = join.run()
    assert join.opened > 12  # Voronoi cells within the space
    want = list(range(len(sets)))
    plain = [set(s.tolist()) for s in sets]
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(plain[i] & plain[j]) >= 85 * len(plain[i] | plain[j]) and want[i] != want[j]:
                a, b = sorted((want[i], want[j]))
                want = [a if w == b else w for w in want]
    assert root.tolist() == want


def test_cells_of_pivots_are_in_use(spark):
    """Nodes go to the cells of pivots, boundary ones to several, and groups of a few documents are joined by Voronoi cells."""
    made = families(3)
    frame = docs(spark, made)
    counters = spark.sparkContext.broadcast(jaccard.frequencies(frame, "text", 4))
    dealt = jaccard.cells_of(jaccard.signatures(frame, counters, "doc_id", "text", 4, 85), 85).collect()
    cells = {h: {r.k1 for r in dealt if r.hub == h} for h in {r.hub for r in dealt}}
    assert len(cells) > 5 and all(h in nodes and len(nodes) > 1 for h, nodes in cells.items())
    assert any(sum(k in nodes for nodes in cells.values()) > 1 for k in {r.k1 for r in dealt})
    sets = [np.unique(np.array([hash(x) & (1 << 63) - 1 for x in shingles(r[1], 4)], dtype=np.uint64)) for r in made]
    join = jaccard.RegionJoin(sets, 85)
    join.run()
    assert join.opened > 2


def test_cells_are_in_use_on_real_tables(spark):
    """At sf0.1 documents meet in cells of pivots, and the larger cells open Voronoi cells within."""
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    counters = spark.sparkContext.broadcast(jaccard.frequencies(frame, "text", 4))
    sized = jaccard.signatures(frame, counters, "doc_id", "text", 4, 85).cache()
    dealt = jaccard.cells_of(sized, 85).cache()
    sizes = {r.hub: r["count"] for r in dealt.groupBy("hub").count().collect()}
    large = [h for h, n in sizes.items() if n >= 5]
    assert len(sizes) > 50 and large
    ids = sized.join(dealt.where(dealt.hub.isin(large[:5])), "k1").select("hub", "id").distinct()
    opened = 0
    for h in large[:5]:
        texts = frame.join(ids.where(ids.hub == h), frame.doc_id == ids.id).select("text").toArrow().column("text")
        join = jaccard.RegionJoin(jaccard.sets_of(texts, 4), 85)
        join.run()
        opened += join.opened
    assert opened > 0


def test_counters_tell_large_counts_apart():
    n = np.array([0, 1, 2, 31, 32, 100, 255, 300, 1000, 10**6, 2**31])
    codes = jaccard._encoded(n).astype(int)
    assert (np.diff(codes) > 0).all() and (jaccard._encoded(np.arange(2, 10**5)) > 1).all()


def test_one_of_each_takes_clashing_names(spark):
    made = families(4, 5)
    odd = docs(spark, made).withColumnsRenamed({"size": "place", "n_words": "_id", "source": "set1", "lang": "other"}).selectExpr("*", "1 as _place", "2 as _set1", "3 as words")
    got = jaccard.one_of_each(odd, n=4, percent=85)
    assert got.columns == odd.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted({i for i, _, c in brute(made, 4, 85) if i == c})


@pytest.mark.parametrize("few", [500_000, 0])
def test_components(spark, few):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
    root = {}
    for _ in range(300):
        for a, b in edges:
            if a != b:
                m = min(root.get(a, a), root.get(b, b))
                root[a] = root[b] = m
    assert got == root
    named = spark.createDataFrame([(str(a).encode(), str(b).encode()) for a, b in edges[:80]], "a binary, b binary")
    assert sorted(map(tuple, components(named, few=few).collect())) == sorted(map(tuple, components(named, few=500_000 - few).collect()))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
