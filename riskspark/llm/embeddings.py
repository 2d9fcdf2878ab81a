"""Embedding near-duplicates by NN-descent.

Vectors of one label are compared by cosine in double precision. Equal vectors
are one node with a weight. The neighbour graph is built and refined like this:

1. start: in each of several random-hyperplane orders, a node meets the nodes
   around it (overlapping blocks of consecutive rows of a range-partitioned
   sort, so no bucket can be hot) and keeps its best ``LIST`` neighbours;
2. descent: neighbours of neighbours are joined, compared and merged into the
   lists until a round brings hardly any link;
3. lists in which every entry is a link are saturated: they are enlarged to the
   node's whole component, which is compared in blocks of bounded size;
4. exact check: all rows of a label in different components of the descent are
   compared in blocks of bounded size. Lists, blocks and rounds are bounded, so the
   descent may miss links; those that connect components come from here, whatever
   the label's size.

Only the threshold edges stay. Link counts come from the block comparison, so
they are exact inside every component, whatever its size, and as no link leaves a
component all links are counted. No pair of a large group of copies is ever written
out. The check's products grow with the square of a label's distinct vectors; its
rows are copied ``EXACT_CHUNKS`` times, more only where chunks reach ``EXACT_BYTES``.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import stage
from riskspark.llm.components import connected_components

THRESHOLD = 0.93
LIST = 8                # neighbours a node keeps
ORDERS = 10             # random orders of the start
BITS = 40               # hyperplanes of an order
BLOCK = 64              # consecutive rows compared with each other
FLOOR = 0.5             # less similar rows are no neighbours
ROUNDS = 4              # descent rounds at most
SETTLED = 0.002         # a round that finds fewer new links (as a share) is the last
CHUNK = 256             # rows of a block in the exact comparison of a component
EXACT_CHUNK = 2048      # rows of a chunk in the exact check of a space, at least
EXACT_CHUNKS = 8        # chunks of a space, unless they would hold more than
EXACT_BYTES = 8 << 20   # bytes of vectors
TILE = 256              # rows of a chunk multiplied at a time

log = logging.getLogger(__name__)


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1) if rows else np.empty((0, 0))


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, space, weight, rep, embedding) -> unit vectors as little-endian doubles."""
    for b in batches:
        out = []
        for v in b.column("embedding").to_pylist():
            x = np.array(v, np.float64)
            x = x / np.abs(x).max()
            out.append((x / np.sqrt(x @ x)).astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("space"), b.column("weight"), b.column("rep"), pa.array(out, pa.binary())],
                                         ["node", "space", "weight", "rep", "vec"])


def _orders(n: int):
    """Every node once per order, with its hyperplane signature and a finer key for equal signatures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict = {}
        for b in batches:
            rows = b.column("vec").to_pylist()
            widths = np.array([len(r) for r in rows])
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                x = np.frombuffer(b"".join(rows[i] for i in at), "<f8").reshape(len(at), -1)
                part = b.take(pa.array(at))
                for order in range(n):
                    if (order, width) not in planes:
                        planes[order, width] = np.random.default_rng([order, int(width)]).standard_normal((width // 8, BITS + 1))
                    y = x @ planes[order, width]
                    sig = (y[:, :BITS] > 0).astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("node"), part.column("space"), pa.array(np.full(len(at), order, np.int32)), pa.array(sig), pa.array(y[:, BITS]),
                         part.column("vec")], ["node", "space", "ord", "sig", "fine", "vec"])

    return run


def _block_edges(nodes: np.ndarray, x: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Best neighbours of each row of a block, and links that connect all linked rows."""
    s = x @ x.T
    np.fill_diagonal(s, -1.0)
    k = min(LIST, len(nodes) - 1)
    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
    u, v = np.repeat(np.arange(len(nodes)), k), best.ravel()
    keep = s[u, v] >= FLOOR
    out = [(nodes[u[keep]], nodes[v[keep]], s[u[keep], v[keep]])]
    linked = s >= threshold
    open_, edges = linked.any(1), []
    while open_.any():
        frontier = [int(np.argmax(open_))]
        open_[frontier[0]] = False
        while frontier:
            i = frontier.pop()
            for j in np.flatnonzero(linked[i] & open_):
                open_[j] = False
                edges.append((i, int(j)))
                frontier.append(int(j))
    if edges:
        i, j = np.array(edges).T
        out.append((nodes[i], nodes[j], s[i, j]))
    return out


def _edge_batch(parts: list) -> pa.RecordBatch:
    cols = [np.concatenate([p[i] for p in parts]) for i in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())],
                                      ["u", "v", "sim"])


def _meet(threshold: float):
    """Edges among consecutive rows of one (space, order), in half-overlapping blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, rows, fresh, parts = None, [], [], 0, []

        def block(m: int) -> None:
            parts.extend(_block_edges(np.array(nodes[:m], np.int64), np.frombuffer(b"".join(rows[:m]), "<f8").reshape(m, -1), threshold))

        for b in batches:
            for space, order, node, vec in zip(*(b.column(c).to_pylist() for c in ("space", "ord", "node", "vec"))):
                if (space, order) != key:
                    if fresh and len(nodes) > 1:
                        block(len(nodes))
                    key, nodes, rows, fresh = (space, order), [], [], 0
                nodes.append(node)
                rows.append(vec)
                fresh += 1
                if len(nodes) == BLOCK:
                    block(BLOCK)
                    del nodes[:BLOCK // 2], rows[:BLOCK // 2]
                    fresh = 0
            if sum(len(p[0]) for p in parts) > 50_000:
                yield _edge_batch(parts)
                parts = []
        if fresh and len(nodes) > 1:
            block(len(nodes))
        if parts:
            yield _edge_batch(parts)

    return run


def _start(nodes: DataFrame, threshold: float) -> DataFrame:
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = nodes.mapInArrow(_orders(ORDERS), "node long, space string, ord int, sig long, fine double, vec binary")
    return (placed.repartitionByRange(n, "space", "ord", "sig", "fine", "node")
            .sortWithinPartitions("space", "ord", "sig", "fine", "node").mapInArrow(_meet(threshold), "u long, v long, sim double"))


def _merge(*edges: DataFrame) -> DataFrame:
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out.groupBy("u", "v").agg(F.max("sim").alias("sim"))


def _lists(edges: DataFrame) -> DataFrame:
    """The best ``LIST`` neighbours of each node: where the descent starts from. Links past them are in ``edges``
    or come from the exact check."""
    by = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return edges.withColumn("r", F.row_number().over(by)).where(F.col("r") <= LIST)


def _similar(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sims = [float(np.frombuffer(x, "<f8") @ np.frombuffer(y, "<f8")) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
                s = np.array(sims)
                keep = np.flatnonzero(s >= FLOOR)
                u, v = b.column("u").to_numpy()[keep], b.column("v").to_numpy()[keep]
                yield _edge_batch([(np.r_[u, v], np.r_[v, u], np.r_[s[keep], s[keep]])])

    return run


def _descend(edges: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Edges to neighbours of neighbours that are not compared yet.

    Nodes with a saturated list are left out as starting points: their list is
    enlarged to the whole component later.
    """
    lists = _lists(edges)
    full = (lists.where(F.col("sim") >= threshold).groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= LIST).select("u"))
    hops = (lists.join(full, "u", "left_anti").select("u", F.col("v").alias("w"))
            .join(lists.select(F.col("u").alias("w"), "v"), "w").where("u <> v"))
    fresh = (hops.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
             .join(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), ["u", "v"], "left_anti"))
    vec = nodes.select("node", "vec")
    pairs = (fresh.join(vec.select(F.col("node").alias("u"), F.col("vec").alias("x")), "u")
             .join(vec.select(F.col("node").alias("v"), F.col("vec").alias("y")), "v"))
    return pairs.select("u", "v", "x", "y").mapInArrow(_similar(threshold), "u long, v long, sim double")


def _across(pairs: DataFrame, threshold: float) -> DataFrame:
    """(u, v, sim): links between the asking and the offered rows of each group (space, i, j) of ``pairs`` that join
    different components, by brute force. Of each group a spanning forest: at most as many links as it has rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def close() -> None:
            asks = np.array([r[0] for r in rows], bool)
            node, comp = (np.array([r[c] for r in rows], np.int64) for c in (1, 2))
            x = np.frombuffer(b"".join(r[3] for r in rows), "<f8").reshape(len(rows), -1)
            q, r = np.flatnonzero(asks), np.flatnonzero(~asks)
            offered = np.ascontiguousarray(x[r].T)
            parent, owner = list(range(len(q))), np.full(len(r), -1)

            def root(i: int) -> int:
                while parent[i] != i:
                    parent[i] = i = parent[parent[i]]
                return i

            for first in range(0, len(q), TILE):
                at = q[first:first + TILE]
                s = x[at] @ offered
                cross = s >= threshold
                if not cross.any():
                    continue
                cross &= comp[at][:, None] != comp[r][None, :]
                for k in np.flatnonzero(cross.any(1)).tolist():
                    i, js = first + k, np.flatnonzero(cross[k])
                    take = js[owner[js] < 0].tolist()
                    for j in js[owner[js] >= 0].tolist():
                        if (other := root(int(owner[j]))) != root(i):
                            parent[other] = root(i)
                            take.append(j)
                    owner[js[owner[js] < 0]] = i
                    out.append((np.full(len(take), node[q[i]]), node[r[take]], s[k, take]))

        for b in batches:
            for space, i, j, *row in zip(*(c.to_pylist() for c in b.columns)):
                if (space, i, j) != key:
                    if rows:
                        close()
                    key, rows = (space, i, j), []
                rows.append(row)
            if sum(len(o[0]) for o in out) > 50_000:
                yield _edge_batch(out)
                out = []
        if rows:
            close()
        if out:
            yield _edge_batch(out)

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))      # a group costs far more than its rows weigh
    grouped = pairs.select("space", "i", "j", "asks", "node", "component", "vec").repartition(n, "space", "i", "j")
    return grouped.sortWithinPartitions("space", "i", "j", "asks", "node").mapInArrow(run, "u long, v long, sim double")


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` with their ``chunk`` and the number of ``chunks`` of their space, see ``EXACT_CHUNKS``."""
    n, most = F.count("*"), F.greatest(F.lit(1), F.floor(F.lit(EXACT_BYTES) / F.max(F.length("vec"))))
    chunks = F.greatest(F.ceil(n / most), F.least(F.ceil(n / EXACT_CHUNK), F.lit(EXACT_CHUNKS))).cast("int")
    sizes = rows.groupBy("space").agg(chunks.alias("chunks"))
    return rows.join(sizes, "space").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))


def _named(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """(node, space, vec, component); a node without links is its own component."""
    return nodes.join(components, "node", "left").select("node", "space", "vec", F.coalesce("component", "node").alias("component"))


def _exact(nodes: DataFrame, components: DataFrame, threshold: float) -> DataFrame:
    """Links between components that connect all that belongs together: every two chunks of a space are compared."""
    cut = (_dealt(_named(nodes, components))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))))
    out = ["space", "i", "j", "asks", "node", "component", "vec"]
    cols = [F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node", "component", "vec", "space"]
    pairs = cut.select((F.col("chunk") <= F.col("other")).alias("asks"), *cols).select(*out)
    same = cut.where("chunk = other").select(F.lit(False).alias("asks"), *cols).select(*out)
    return _across(pairs.unionByName(same), threshold)


def _count_links(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links): weight of the other nodes of its component within the threshold.

    Components are cut into chunks of about ``CHUNK`` rows; each pair of chunks is
    one group, so a task holds two chunks whatever the component's size.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    cut = (members.join(sizes, "component").withColumn("chunks", chunks)
           .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))))
    cut = cut.select("component", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "weight", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def close() -> None:
            _, i, j = key
            x = np.frombuffer(b"".join(r[2] for r in rows), "<f8").reshape(len(rows), -1)
            node, weight, chunk = (np.array([r[c] for r in rows], np.int64) for c in (0, 1, 3))
            left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
            near = x[left] @ x[right].T >= threshold
            if i == j:
                np.fill_diagonal(near, False)
                out.append((node[left], near @ weight[right]))
            else:
                out.append((node[left], near @ weight[right]))
                out.append((node[right], near.T @ weight[left]))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out]), pa.int64()) for c in (0, 1)], ["node", "links"])

        for b in batches:
            for comp, i, j, chunk, node, weight, vec in zip(*(c.to_pylist() for c in b.columns)):
                if (comp, i, j) != key:
                    if rows:
                        close()
                    key, rows = (comp, i, j), []
                rows.append((node, weight, vec, chunk))
            if sum(len(o[0]) for o in out) > 50_000:
                yield batch()
                out = []
        if rows:
            close()
        if out:
            yield batch()

    grouped = cut.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")
    return grouped.mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Vectors that are NULL, empty, zero or hold a NULL or non-finite component,
    rows without label or without id link with nothing: 0 links, their own id as
    component. Repeated rows link with each other. Vectors of different
    length are never compared. An empty table gives an empty result.
    """
    vec = F.col("embedding")
    usable = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vec.isNotNull()
              & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("embedding"),
                          F.col(f"`{label_col}`").cast("string").alias("label")).withColumn("usable", F.coalesce(usable, F.lit(False)))
    rows = rows.withColumns({"h1": F.xxhash64("label", "embedding"), "h2": F.xxhash64(F.lit(1), "embedding", "label")})
    node_key = ["label", "h1", "h2"]
    distinct = (rows.where("usable").groupBy(*node_key, "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
                .select("*", F.concat_ws("|", F.size("embedding").cast("string"), "label").alias("space"),
                        F.monotonically_increasing_id().alias("node")))
    distinct = stage(distinct, "vectors")                       # the node numbers are fixed once written
    nodes = stage(distinct.select("node", "space", "weight", "rep", "embedding")
                  .mapInArrow(_unit, "node long, space string, weight long, rep long, vec binary"), "unit_vectors")
    edges = stage(_merge(_start(nodes, threshold)), "edges")
    links = F.col("sim") >= threshold
    known = edges.where(links).count()
    for _ in range(ROUNDS):
        more = stage(_descend(edges, nodes, threshold), "descent")
        if more.isEmpty():
            break
        found = more.where(links).count()
        edges = stage(_merge(edges, more), "edges")
        if found <= SETTLED * max(known, 1):
            break
        known += found
    descent = edges.where(links).select("u", "v")
    components = stage(connected_components(descent), "components")
    missed = stage(_exact(nodes, components, threshold), "missed")
    if lost := missed.count():
        log.info("neighbour graph: %d links between components found by the exact check alone", lost)
        components = stage(connected_components(descent.unionByName(missed.select("u", "v"))), "components")
    members = nodes.join(components, "node").select("component", "node", "weight", "vec")
    counted = _count_links(members, threshold)
    lowest = nodes.join(components, "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    named = components.join(lowest, "component").select("node", "component_id").join(counted, "node", "left")
    found = stage(distinct.select(*node_key, "node", "rep", "weight").join(named, "node", "left").select(
        *node_key, F.coalesce("component_id", "rep").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "vector_links")
    plain = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where("usable").select("vec_id", *node_key).join(found, node_key).select("vec_id", "n_links", "component_id")
    return out.unionByName(plain).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
