"""Benchmark decontamination by CGK embedding and bit sampling.

An item matches a document when some span of the document's words is within
``floor(max_edit * words of the item)`` word edits of the whole item (words are
``\\w+`` runs, lower-cased). Items of fewer words than one edit needs match verbatim.

Many edits scatter a walk, so items of more than ``PART_WORDS`` words are searched
by parts of at most that size. Where an item is present with its share of edits,
some part is present with no more than its own share (the shares add up), so this
loses nothing. Search, per class of similar part lengths:

1. windows of the part's size start at every word; a window in which more words
   are foreign to the class than edits are allowed cannot match and is left out
   (lossless);
2. the CGK random walk embeds window and part so that few edits become few
   differing coordinates; a repetition samples ``sample_bits`` coordinates of a
   fresh walk and looks the window up among the parts. Repetitions are added
   until simulated copies with the full number of edits are found at
   ``target_recall``;
3. every candidate is verified by the exact edit distance, first of the part, then
   of the whole item against the document.

The benchmark is read in blocks of a stated size; documents are scanned where
they lie, with no shuffle and no pairing of rows. A walk is a hash function of
(walk, step, word): a block that goes to the tasks holds its items and one key per
part and walk.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_EDIT = 0.2          # of the item's words: similarity 0.8
PART_WORDS = 64         # longest part that is searched for as one
SAMPLE_BITS = 4
TARGET_RECALL = 0.98
MAX_REPETITIONS = 1024  # far beyond what parts of this size take (tested); an error, never a silent stop
ITEMS_PER_BLOCK = 5_000
_TOKENS = 400_000       # tokens scanned at a time: bounds memory
_WORD = re.compile(r"\w+")
_PAD = 1                # symbol past the end of a walk; 0: word foreign to the benchmark


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser of a counter (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Vocabulary(dict):
    """Word -> id; words foreign to the benchmark are 0."""

    def __missing__(self, word: str) -> int:
        return 0


@dataclass
class _Class:
    """Parts of similar length and the walks that look them up."""

    shortest: int
    longest: int
    edits: int
    parts: list[tuple[int, int, int]]                  # (item's position in the block, first word, end word)
    known: np.ndarray                                  # per word id: in a part of this class
    walks: list[tuple] = field(default_factory=list)   # (seed, sampled, sorted keys, part of key)


@dataclass
class Benchmark:
    """One searchable block of benchmark items."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: _Vocabulary
    classes: list[_Class]


def _walk(starts: np.ndarray, ids: np.ndarray, seed: int, sampled: np.ndarray, n_words: int) -> np.ndarray:
    """Keys of the sampled coordinates of a CGK walk from each start.

    The walk moves on by bit ``j`` of a hash of (seed, j // 64, word) in step ``j``.
    It takes fewer steps than the window has words, so it never leaves the window.
    """
    key, at = np.zeros(len(starts), np.uint64), starts.copy()
    wanted, last = set(sampled.tolist()), int(sampled.max())
    with np.errstate(over="ignore"):
        for j in range(last + 1):
            if j % 64 == 0:                 # 64 steps of every word
                bits = _mix(np.arange(n_words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed + j // 64))
            symbol = ids.take(at, mode="clip")
            if j in wanted:
                key = _mix(key + np.uint64(0x9E3779B97F4A7C15) + symbol.astype(np.uint64))
            if j == last:
                break
            bit = np.uint64(j % 64)
            if n_words < len(starts):       # the step of every word, then of every window; or of the windows alone
                at += ((bits >> bit) & np.uint64(1)).astype(np.int8).take(symbol)
            else:
                at += ((bits.take(symbol) >> bit) & np.uint64(1)).astype(np.int8)
    return key


def _edited(words: np.ndarray, edits: int, n_words: int, rng: np.random.Generator) -> np.ndarray:
    """A copy with ``edits`` random word substitutions, insertions and deletions."""
    out = words.tolist()
    for _ in range(edits):
        at, kind = int(rng.integers(0, len(out) + 1)), int(rng.integers(0, 3))
        new = int(rng.integers(2, n_words)) if rng.integers(0, 2) else 0
        if kind == 0 or at == len(out):
            out.insert(at, new)
        elif kind == 1:
            out[at] = new
        elif len(out) > 1:
            del out[at]
    return np.array(out, np.int64)


def build(items: list[tuple[int, str | None]], max_edit: float = MAX_EDIT, sample_bits: int = SAMPLE_BITS,
          target_recall: float = TARGET_RECALL, seed: int = 42) -> Benchmark:
    """Index a block of (item_id, text). NULL, empty and word-less items match nothing."""
    vocabulary = _Vocabulary()
    ids, words = [], []
    for item_id, text in items:
        found = _WORD.findall((text or "").lower())
        if found:
            ids.append(item_id)
            words.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 2) for w in found], np.int64))
    n_words = len(vocabulary) + 2
    parts = [(k, *cut) for k, w in enumerate(words) for cut in _cuts(len(w))]
    order, classes = sorted(parts, key=lambda p: p[2] - p[1]), []
    while order:
        shortest = order[0][2] - order[0][1]
        own = [p for p in order if p[2] - p[1] <= 1.25 * shortest]
        order = order[len(own):]
        longest = own[-1][2] - own[-1][1]
        known = np.zeros(n_words, bool)
        known[np.concatenate([words[k][a:b] for k, a, b in own])] = True
        classes.append(_Class(shortest, longest, math.floor(max_edit * longest), own, known))
    for number, c in enumerate(classes):
        rng = np.random.default_rng([seed, number])
        own = [words[k][a:b] for k, a, b in c.parts]
        flat = np.concatenate(own)
        at = np.cumsum([0] + [len(w) for w in own])[:-1]
        picks = rng.integers(0, len(own), 600)
        copies = [np.pad(_edited(own[k], math.floor(max_edit * len(own[k])), n_words, rng), (0, c.longest)) for k in picks]
        copy_at = np.cumsum([0] + [len(x) for x in copies])[:-1]
        copy_ids, missed = np.concatenate(copies), np.ones(len(copies), bool)
        while missed.mean() > 1 - target_recall:
            if len(c.walks) == MAX_REPETITIONS:
                raise RuntimeError(f"parts of {c.shortest} to {c.longest} words are not found at the target recall")
            # A walk passes half a word a step: these coordinates cover the first half of the window, where
            # half of the edits fall. The simulated copies have theirs anywhere, so the recall is that of whole items.
            walk = int(rng.integers(0, 1 << 62))
            # Short parts get fewer coordinates, else an edit would touch them all.
            sampled = np.sort(rng.choice(c.shortest, max(1, min(sample_bits, c.shortest // 3)), replace=False))
            keys = _walk(at, flat, walk, sampled, n_words)
            missed &= _walk(copy_at, copy_ids, walk, sampled, n_words) != keys[picks]
            by = np.argsort(keys, kind="stable")
            c.walks.append((walk, sampled, keys[by], by.astype(np.int32)))
    return Benchmark(ids, words, vocabulary, classes)


def _cuts(n: int) -> list[tuple[int, int]]:
    """(first, end) of the parts of an item of ``n`` words: equal ones, the fewest of at most ``PART_WORDS``."""
    k = -(-n // PART_WORDS)
    return [(n * i // k, n * (i + 1) // k) for i in range(k)]


def _best_span(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edit distance, start, end) of the span of ``text`` nearest to ``item``."""
    def ends(p: np.ndarray, t: np.ndarray, free_start: bool) -> np.ndarray:
        ramp = np.arange(len(p) + 1)
        column, out = ramp.copy(), np.empty(len(t) + 1, np.int64)
        out[0] = column[-1]
        for j, w in enumerate(t):
            new = column + 1
            new[1:] = np.minimum(new[1:], column[:-1] + (p != w))
            new[0] = 0 if free_start else j + 1
            column = np.minimum.accumulate(new - ramp) + ramp
            out[j + 1] = column[-1]
        return out

    cost = ends(item, text, True)
    end = int(cost.argmin())
    back = ends(item[::-1], text[:end][::-1], False)
    return int(cost[end]), end - int(back.argmin()), end


def _candidates(c: _Class, ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, part) pairs whose sampled coordinates agree in some repetition."""
    if len(ids) < c.shortest - c.edits:
        return
    padded = np.concatenate([ids, np.zeros(c.longest, np.int64)])
    own = np.concatenate([[0], np.cumsum(c.known[padded])])
    starts = np.flatnonzero(own[c.shortest:][:len(ids)] - own[:len(ids)] >= c.shortest - c.edits)
    if not len(starts):
        return
    found = []
    for walk, sampled, keys, part in c.walks:
        got = _walk(starts, padded, walk, sampled, len(c.known))
        lo, hi = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
        for k in np.flatnonzero(hi > lo):
            found += [(int(starts[k]), int(part[n])) for n in range(lo[k], hi[k])]
    yield from sorted(set(found))


def _part_hits(bench: Benchmark, c: _Class, ids: np.ndarray, max_edit: float) -> Iterator[tuple[int, int, int]]:
    """(item, start, end): the words of ``ids`` where an item would be of which a part is present."""
    spans: dict[int, list[list[int]]] = {}
    for start, part in _candidates(c, ids):
        own = spans.setdefault(part, [])
        if own and start <= own[-1][1] + c.edits:
            own[-1][1] = start
        else:
            own.append([start, start])
    for part, runs in spans.items():
        item, a, b = c.parts[part]
        n = len(bench.words[item])
        slack = 2 * math.floor(max_edit * n) + 2 * c.edits
        for first, last in runs:
            if b - a < n:                   # a part: is it there, before the whole item is compared?
                near = ids[max(0, first - 2 * c.edits):last + b - a + 2 * c.edits]
                if _best_span(bench.words[item][a:b], near)[0] > math.floor(max_edit * (b - a)):
                    continue
            yield item, max(0, first - a - slack), last - a + n + slack


def _search(bench: Benchmark, ids: np.ndarray, max_edit: float) -> list[tuple[int, int, int, int]]:
    """Matches (item position, start, end, edits) in a run of word ids, best ones first, not overlapping by item."""
    regions: dict[int, list[list[int]]] = {}
    for item, a, b in sorted(h for c in bench.classes for h in _part_hits(bench, c, ids, max_edit)):
        own = regions.setdefault(item, [])
        if own and a <= own[-1][1]:
            own[-1][1] = max(own[-1][1], b)
        else:
            own.append([a, b])
    out = []
    for item, runs in regions.items():
        words = bench.words[item]
        allowed, hits = math.floor(max_edit * len(words)), []
        todo = [tuple(r) for r in runs]
        while todo:
            lo, hi = todo.pop()
            region = ids[lo:hi]
            if len(region) < len(words) - allowed:
                continue
            cost, a, b = _best_span(words, region)
            if cost <= allowed:             # what is left on both sides may hold the item again
                hits.append((item, lo + a, lo + b, cost))
                todo += [(lo, lo + a), (lo + b, min(hi, len(ids)))]
        out += sorted(hits, key=lambda h: (h[3], h[1]))
    return out


def _word_ids(bench: Benchmark, text: str) -> np.ndarray:
    get = bench.vocabulary.__getitem__
    if len(text) > 1 << 22:                 # no list of all words of a very long text
        return np.fromiter((get(m.group()) for m in _WORD.finditer(text.lower())), np.int64)
    return np.array([*map(get, _WORD.findall(text.lower()))], np.int64)


def _matches(bench: Benchmark, ids: np.ndarray, max_edit: float) -> list[tuple[int, int, int, int]]:
    """``_search`` over a text of any length, in overlapping stretches."""
    if len(ids) <= _TOKENS:
        return _search(bench, ids, max_edit)
    reach = 4 * max((c.longest for c in bench.classes), default=0)
    found = {(m[0], m[1] + at, m[2] + at, m[3]) for at in range(0, len(ids), _TOKENS)
             for m in _search(bench, ids[at:at + _TOKENS + reach], max_edit)}
    out: list[tuple[int, int, int, int]] = []
    for m in sorted(found, key=lambda m: (m[0], m[3], m[1])):
        if not any(m[0] == g[0] and m[1] < g[2] and g[1] < m[2] for g in out):
            out.append(m)
    return out


def scan(bench: Benchmark, texts: list[str], max_edit: float = MAX_EDIT) -> list[list[tuple[int, int, int, int]]]:
    """Matches of each text; short texts are searched together, with word 0 between them."""
    ids = [_word_ids(bench, t) for t in texts]
    out: list[list] = [[] for _ in texts]
    gap = np.zeros(max((c.longest + 2 * c.edits for c in bench.classes), default=1), np.int64)
    group: list[int] = []

    def flush() -> None:
        if not group:
            return
        joined = np.concatenate([x for k in group for x in (ids[k], gap)])
        ends = np.cumsum([len(ids[k]) + len(gap) for k in group])
        for item, a, b, cost in _matches(bench, joined, max_edit):
            g = int(np.searchsorted(ends, a, "right"))
            base = int(ends[g]) - len(gap) - len(ids[group[g]])
            out[group[g]].append((item, a - base, b - base, cost))
        group.clear()

    size = 0
    for k, x in enumerate(ids):
        if len(x) + size > _TOKENS:
            flush()
            size = 0
        group.append(k)
        size += len(x) + len(gap)
    flush()
    return out


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", max_edit: float = MAX_EDIT,
                     items_per_block: int = ITEMS_PER_BLOCK) -> Iterator[Benchmark]:
    """Indexes of the benchmark in blocks of about ``items_per_block`` items (the stated query set)."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").alias("text")).distinct()
    blocks = -(-items.count() // items_per_block)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1)))
    for k in range(blocks):
        yield build(sorted(((r[0], r[1]) for r in items.where(part == k).collect()),
                           key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), max_edit)


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 max_edit: float = MAX_EDIT, items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """One row per match: doc_id, item_id, item_words, start_word, n_words, edits, similarity, start_char, end_char.

    Matches of one item in one text do not overlap. The character range is NULL
    where lower-casing changes a text's length. NULL and empty texts match
    nothing; an empty table on either side gives no rows; repeated documents
    give their matches each; NULL ids are returned as they are. Very long texts are
    searched whole, in overlapping stretches, very long items by their parts; other
    columns are not read.
    """
    names = ["doc_id", "item_id", "item_words", "start_word", "n_words", "edits", "similarity", "start_char", "end_char"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(names, types)))
    ddl = ("doc_id long, item_id long, item_words int, start_word long, n_words int, edits int, similarity double, "
           "start_char long, end_char long")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = rows.sparkSession.createDataFrame([], ddl)
    for bench in benchmark_blocks(benchmark, max_edit=max_edit, items_per_block=items_per_block):
        sent = rows.sparkSession.sparkContext.broadcast(bench)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [t or "" for t in b.column(1).to_pylist()]
                found = []
                for doc_id, text, hits in zip(b.column(0).to_pylist(), texts, scan(sent.value, texts, max_edit)):
                    if hits:
                        at = [(m.start(), m.end()) for m in _WORD.finditer(text.lower())]
                        same = len(text) == len(text.lower())  # lower-casing may lengthen a text
                        for item, a, z, cost in hits:
                            n = len(sent.value.words[item])
                            found.append((doc_id, sent.value.ids[item], n, a, z - a, cost, 1 - cost / n,
                                          at[a][0] if same else None, at[z - 1][1] if same else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 9, types)], schema=schema)

        out = out.unionByName(rows.mapInArrow(run, ddl))
    return out


def _is_clean(sent, max_edit: float):
    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([not hits for hits in scan(sent.value, [t or "" for t in texts], max_edit)], dtype=bool)

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", max_edit: float = MAX_EDIT,
                      items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; decided row by row, all columns unchanged."""
    for bench in benchmark_blocks(benchmark, max_edit=max_edit, items_per_block=items_per_block):
        sent = docs.sparkSession.sparkContext.broadcast(bench)
        docs = docs.where(_is_clean(sent, max_edit)(F.col(f"`{text_col}`")))
    return docs
