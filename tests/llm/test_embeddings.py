import numpy as np
import pytest

from riskspark.llm import embeddings

DDL = "vec_id long, embedding array<float>, label int, node long, weight int"


def _brute(rows):
    """(n_links, component) of every usable row by all pairs."""
    unit = {}
    for k, (i, v, label, *_) in enumerate(rows):
        x = np.array([np.nan if c is None else c for c in (v or [])], np.float32).astype(float)
        if i is not None and label is not None and len(x) and np.isfinite(x).all() and np.abs(x).max() > 0:
            unit[k] = x / np.sqrt(x @ x)
    parent, links = {k: k for k in unit}, dict.fromkeys(unit, 0)

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = list(unit)
    for n, a in enumerate(keys):
        for b in keys[n + 1:]:
            if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    low = {}
    for k in keys:
        low[find(k)] = min(low.get(find(k), rows[k][0]), rows[k][0])
    return [(r[0], links.get(k, 0), low[find(k)] if k in unit else r[0]) for k, r in enumerate(rows)]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for label in (1, 2):
        for _ in range(250):
            rows.append((n, rng.standard_normal(16), label))
            n += 1
        for center in rng.standard_normal((6, 16)) * 2:
            for _ in range(int(rng.integers(2, 60))):
                rows.append((n, center + rng.standard_normal(16) * 0.25, label))
                n += 1
    hot = rng.standard_normal(16)
    rows += [(n + k, hot, 2) for k in range(300)] + [(n + 300 + k, hot * 3 + rng.standard_normal(16) * 0.3, 2) for k in range(100)]
    rows = [(i, [float(np.float32(c)) for c in v], label) for i, v, label in rows]
    rows += [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 16, 1), (9003, [None] + [1.0] * 15, 1), (9004, [float("nan")] * 16, 1),
             (9005, [float("inf")] + [1.0] * 15, 1), (9006, rows[0][1], None), (None, rows[0][1], 1), (9007, rows[3][1][:8], 1),
             (5, rows[5][1], rows[5][2]), (9008, [c * 1e-20 for c in rows[0][1]], 1)]
    return [(*r, 3, 4) for r in rows]


def test_equals_brute_force(spark, vectors, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 50)        # several chunk pairs for the large components
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(vectors, DDL)).collect()]
    expected = [(i, n, c, i is not None and i == c) for i, n, c in _brute(vectors)]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert max(n for _, n, *_ in got) > 300


def test_audit_repairs_a_poor_start(spark, vectors, monkeypatch):
    monkeypatch.setattr(embeddings, "ORDERS", 1)
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    rows = [v for v in vectors if v[0] is not None]
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, DDL)).collect()}
    links = {i: n for i, n, _ in _brute(rows)}
    assert sum(min(got[i], n) for i, n in links.items()) >= 0.95 * sum(links.values())
    assert all(got[i] <= n for i, n in links.items() if i != 5)


def test_empty_and_unusable_tables(spark, vectors):
    table = spark.createDataFrame(vectors, DDL)
    assert embeddings.near_duplicates(table.where("false")).count() == 0
    odd = embeddings.near_duplicates(table.where("vec_id between 9000 and 9006")).collect()
    assert len(odd) == 7 and all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in odd)


@pytest.mark.parametrize("audits", [1, 3])
def test_pairs_beside_a_hot_group_are_found(spark, monkeypatch, audits):
    """The links of the hot group must not hide the missed links of isolated pairs."""
    for name, value in {"ORDERS": 1, "BLOCK": 4, "ROUNDS": 1, "AUDITS": audits, "AUDIT_NODES": 64, "EXACT_CHUNK": 100}.items():
        monkeypatch.setattr(embeddings, name, value, raising=False)
    rng = np.random.default_rng(8)
    hot = rng.standard_normal(16)
    vecs = [hot + rng.standard_normal(16) * 0.02 for _ in range(400)]
    for v in rng.standard_normal((120, 16)):
        vecs += [v, v + rng.standard_normal(16) * 0.2]
    rows = [(i, [float(np.float32(c)) for c in v], 1, 3, 4) for i, v in enumerate(vecs)]
    got = [(r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, DDL)).collect()]
    assert sorted(got) == sorted(_brute(rows))


@pytest.mark.parametrize("size", [{"EXACT_CHUNK": 4096}, {"EXACT_CHUNK": 50, "EXACT_CHUNKS": 3}, {"EXACT_BYTES": 16 * 8 * 60}])
def test_links_past_lists_and_samples_are_found(spark, vectors, monkeypatch, size):
    """However little the descent finds and a sample of rows would show, all links of a label come out."""
    poor = {"ORDERS": 1, "BLOCK": 4, "LIST": 2, "ROUNDS": 1, "AUDITS": 1, "AUDIT_NODES": 4, "AUDIT_LINKED": 0, "TARGET_RECALL": 0.5, "TILE": 64}
    for name, value in {**poor, **size}.items():
        monkeypatch.setattr(embeddings, name, value, raising=False)
    got = [(r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(vectors, DDL)).collect()]
    assert sorted(got, key=str) == sorted(_brute(vectors), key=str)


def test_descent_alone_finds_links(spark, vectors, monkeypatch):
    """The exact check follows the descent and does not take its place."""
    monkeypatch.setattr(embeddings, "_exact", lambda nodes, components, threshold: spark.createDataFrame([], "u long, v long, sim double"))
    rows = [v for v in vectors if v[0] is not None]
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, DDL)).collect()}
    links = {i: n for i, n, _ in _brute(rows)}
    assert sum(min(got[i], n) for i, n in links.items()) >= 0.95 * sum(links.values())
