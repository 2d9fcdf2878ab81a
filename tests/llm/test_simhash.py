import itertools
import random

import numpy as np

from riskspark.llm import simhash
from riskspark.llm.components import connected_components
from riskspark.llm.simhash import fingerprint, keep_one, links, simhash_components
from pyspark.sql import functions as F


def _brute(fps):
    ids = [i for i, _ in fps]
    parent = {k: k for k in range(len(fps))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
            parent[find(a)] = find(b)
    low = {}
    for k, i in enumerate(ids):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [low.get(find(k)) for k in range(len(fps))]


def test_fingerprint_matches_the_sql_hash(spark):
    text = "The Quick  brown\nfox"
    shingles = ["the quick brown", "quick brown fox"]
    hashes = [spark.range(1).select(F.xxhash64(F.lit(s))).first()[0] & (2 ** 64 - 1) for s in shingles]
    expected = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert fingerprint(text) == expected
    assert fingerprint(None) == fingerprint("") == fingerprint(" \n") == 0
    assert fingerprint("A b") == fingerprint("a  b") != 0


def test_components_equal_brute_force(documents):
    rows = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash_components(documents).collect()]
    source = [(r.doc_id, fingerprint(r.text)) for r in documents.collect()]
    expected = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(source, _brute(source))), key=str)
    assert sorted(rows, key=str) == expected


def test_links_find_every_pair_up_to_three_bits(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for f in list(fps[:60]):
        g = f
        for b in rng.sample(range(64), rng.randint(1, 4)):
            g ^= 1 << b
        fps.append(g)
    fps = sorted(set(fps))
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    got = {frozenset((r.fp_a, r.fp_b)) for r in links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    expected = {frozenset((signed[a], signed[b])) for a, b in itertools.combinations(range(len(fps)), 2)
                if (fps[a] ^ fps[b]).bit_count() <= 3}
    assert got == expected and len(expected) > 30


def test_large_buckets_give_the_same_groups_from_few_pairs(spark, monkeypatch):
    rng = random.Random(6)
    center, fps = rng.getrandbits(64), set()
    while len(fps) < 500:
        f = center
        for b in rng.sample(range(64), rng.randint(0, 3)):
            f ^= 1 << b
        fps.add(f)
    fps |= {rng.getrandbits(64) for _ in range(50)}
    table = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")

    def groups(found):
        comp = {r.node: r.component for r in connected_components(found.select(F.col("fp_a").alias("u"), F.col("fp_b").alias("v"))).collect()}
        return comp, found.count()

    monkeypatch.setattr(simhash, "BUCKET", 10_000)
    whole, pairs = groups(links(table))
    monkeypatch.setattr(simhash, "BUCKET", 16)
    blocks, few = groups(links(table))
    assert whole == blocks and few < pairs


def test_keep_one_keeps_the_smallest_id_of_each_component(documents):
    kept = keep_one(documents)
    assert kept.columns == documents.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    groups = {r.component_id for r in simhash_components(documents).collect()}
    assert ids == sorted(groups, key=str)


def test_empty_tables_and_chains(spark, no_documents):
    assert simhash_components(no_documents).count() == 0 and keep_one(no_documents).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in connected_components(chain).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected_components(chain.where("false")).count() == 0


def test_keep_one_with_columns_called_like_its_own(spark, documents):
    named = documents.selectExpr("*", "doc_id as _id", "doc_id as __id", "1 as component_id", "'f' as fingerprint", "2 as n", "3 as h", "4 as row")
    got = keep_one(named)
    assert got.columns == named.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r.doc_id) for r in keep_one(documents).collect())
