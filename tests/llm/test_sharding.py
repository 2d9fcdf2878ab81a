from collections import Counter
from math import comb
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.llm.sharding import hypergeometric, shuffle_into_shards, write_shards


def _uniform(c):
    return F.shiftrightunsigned(F.xxhash64(c), 11).cast("double") * 2.0 ** -53


def _check(rows, n):
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(n)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


@pytest.mark.parametrize("total, good, draws", [(40, 12, 9), (500, 120, 60), (20, 19, 10), (7, 7, 3), (7, 0, 3), (9, 4, 0), (9, 4, 9)])
def test_draws_follow_the_law(spark, total, good, draws):
    n = 20_000
    got = spark.range(n).select(hypergeometric(F.lit(total), F.lit(good), F.lit(draws), _uniform("id")).alias("k")).groupBy("k").count().collect()
    seen = np.zeros(draws + 1)
    for r in got:
        seen[r.k] = r["count"]
    law = np.array([comb(good, k) * comb(total - good, draws - k) / comb(total, draws) if draws - k <= total - good else 0 for k in range(draws + 1)])
    assert seen[law == 0].sum() == 0
    expected = law[law * n > 5] * n
    chi2 = ((seen[law * n > 5] - expected) ** 2 / expected).sum()
    assert chi2 < 2 * len(expected) + 30


@pytest.mark.parametrize("n_rows, n_shards", [(1000, 8), (1001, 7), (5, 8), (64, 1)])
def test_sizes_and_slots_are_exact(spark, n_rows, n_shards):
    rows = shuffle_into_shards(spark.range(n_rows).select(F.col("id").alias("doc_id")), n_shards).collect()
    assert sorted(r.doc_id for r in rows) == list(range(n_rows))
    _check(rows, n_shards)


def test_assignment_is_uniform_over_seeds_and_independent_of_layout(spark):
    rows = spark.range(40)
    hits = Counter()
    for seed in range(12):
        for r in shuffle_into_shards(rows, 4, seed=seed).collect():
            hits[r.id % 4, r.shard] += 1
    assert all(12 < hits[a, b] < 50 for a in range(4) for b in range(4))     # 30 expected
    docs = spark.range(3000)
    assert sorted(shuffle_into_shards(docs, 8).collect()) == sorted(shuffle_into_shards(docs.repartition(13), 8).collect())


def test_odd_rows(spark, documents, no_documents):
    rows = shuffle_into_shards(documents.select("doc_id", "text", "lang"), 4).collect()
    assert len(rows) == documents.count()
    _check(rows, 4)
    assert shuffle_into_shards(no_documents, 4).count() == 0
    same = spark.range(900).select(F.lit(1).alias("doc_id"), F.lit(None).cast("string").alias("text"))
    _check(shuffle_into_shards(same, 8).collect(), 8)
    with pytest.raises(ValueError):
        shuffle_into_shards(documents, 0)


def test_written_shards(spark, tmp_path):
    placed = shuffle_into_shards(spark.range(100), 4)
    write_shards(placed, str(tmp_path / "shards"))
    assert sorted(p.name for p in (tmp_path / "shards").glob("shard=*")) == [f"shard={k}" for k in range(4)]
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 100


def test_query_reads_whole_rows_back_from_its_shards(spark, documents, no_documents, tmp_path, monkeypatch):
    from riskspark.llm import catalog, sharding

    paths, write = [], sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda placed, path: (paths.append(path), write(placed, path)))
    documents.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    rows = catalog.op8_hypergeometric_shards(spark, str(tmp_path / "a")).collect()
    _check(rows, 8)
    (path,) = paths
    stored = spark.read.parquet(path)
    assert set(stored.columns) == {*documents.columns, "shard", "slot"}
    assert Counter((r.doc_id, r.text) for r in stored.collect()) == Counter((r.doc_id, r.text) for r in documents.collect())
    texts = {(r.shard, r.slot): (r.doc_id, (r.text or "").encode()) for r in stored.collect()}
    assert {(r.shard, r.slot): (r.doc_id, r.size, r.text_crc32) for r in rows} == {
        k: (i, len(t) + 1, crc32(t)) for k, (i, t) in texts.items()}
    no_documents.write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert catalog.op8_hypergeometric_shards(spark, str(tmp_path / "b")).count() == 0


def test_columns_called_like_the_result(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 as shard", "'x' as slot", "id as block", "id as row", "id as h1")
    placed = shuffle_into_shards(rows, 4)
    assert sorted(placed.columns) == ["block", "h1", "id", "row", "shard", "slot"]
    assert placed.select("shard", "slot").distinct().count() == 1000 and {r.shard for r in placed.collect()} == {0, 1, 2, 3}
