"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text;
a window of words that compresses shorter with the toxic dictionary speaks for
toxicity. The differences of the compressed lengths over all windows of a text
give a few features (largest, mean of the largest, shares above thresholds), and
a logistic model, fitted on labelled documents that the dictionaries never saw,
turns them into a calibrated score.

The ordinary dictionary is trained on ordinary texts alone. The toxic one is trained
on the runs of toxic text that are typical for it (byte strings that are
``MIN_RATIO`` times more frequent there, counted over distinct contexts so that
copies of a document count once); the ordinary one follows it, so ordinary prose
costs the same with both and cancels out.

Defined results
* NULL, empty and word-less texts have no window and get the score of no evidence.
* Very long texts are scored whole. In the fit a sampled text of more than
  ``MAX_TRAIN_CHARS`` characters gives ``TRAIN_SLICES`` stretches spread evenly over it.
* Repeated rows are scored alike; in the fit equal texts count once, and several
  labels of an id count as toxic if one is.
* With no labelled rows, or one class only, every text gets that class's share.
* An empty table gives an empty result. Other columns are not read, so their names
  cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_WORDS = 16
STRIDE_WORDS = 12          # windows overlap by a quarter
LEAD_BYTES = 64            # of the shared part before each window, see windows()
FOLDS = 5                  # the fold with remainder 0 is never learned from
MAX_DOCS_PER_CLASS = 3_000  # bound of the labelled sample the model is fitted on
MAX_TRAIN_CHARS = 16_384   # of a sampled document; scoring always reads whole texts
TRAIN_SLICES = 32          # stretches that a longer sampled document gives
DICTIONARY_SHARE = 0.6     # of the sample trains dictionaries, the rest the score
ORDINARY_BYTES = 1_500
OWN_BYTES = 16_384
RUN_BYTES = 6
MIN_RATIO = 8.0
MIN_CONTEXTS = (5, 20)     # a run must recur in so many contexts: a twentieth of the toxic texts, within these
THRESHOLDS = (1, 2, 3, 4, 6)
_PARTS = 16


@dataclass
class Model:
    """Dictionaries, calibration and the class sizes they were fitted on."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    sample: dict


def windows(text: str | None, words: int = WINDOW_WORDS, stride: int = STRIDE_WORDS, lead: bytes = b"") -> Iterator[bytes]:
    """Lower-cased text in windows of ``words`` words, joined by one space.

    zstandard stores a block that hardly shrinks as it is, which would hide a
    single match. ``lead``, bytes that both dictionaries hold, makes every window
    shrink, so each further match shows in the length.
    """
    found = (text or "").lower().encode("utf-8", "replace").split()
    for at in range(0, len(found), stride):
        yield lead + b" ".join(found[at:at + words])


def _grams(data: bytes, size: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    if len(a) < size:
        return np.empty(0, np.uint64)
    out = np.zeros(len(a) - size + 1, np.uint64)
    for i in range(size):
        out = (out << np.uint64(8)) | a[i:len(a) - size + 1 + i]
    return out


def _context_counts(texts: list[bytes], size: int = RUN_BYTES) -> tuple[np.ndarray, np.ndarray, int]:
    """Byte strings, the number of distinct 8-byte contexts before each, and the total."""
    values, counts, total = [], [], 0
    for part in range(_PARTS):              # one part of the byte strings at a time: bounds memory
        grams, keys = [], []
        for t in texts:
            t = b"\n" * 8 + t
            own, before = _grams(t, size)[8:], _grams(t, 8)
            mixed = own * np.uint64(0x9E3779B97F4A7C15)
            mine = np.flatnonzero(mixed >> np.uint64(60) == part)
            grams.append(own[mine])
            keys.append(mixed[mine] ^ (before[mine] * np.uint64(0xC2B2AE3D27D4EB4F)))
        if grams:
            _, first = np.unique(np.concatenate(keys), return_index=True)
            v, n = np.unique(np.concatenate(grams)[first], return_counts=True)
            keep = n > 1                    # single ones are never typical, and count as one elsewhere
            values.append(v[keep])
            counts.append(n[keep])
            total += len(first)
    values, counts = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (values, counts))
    order = np.argsort(values)
    return values[order], counts[order], max(total, 1)


def _typical_runs(text: bytes, own: tuple, other: tuple, least: int, size: int = RUN_BYTES) -> list[bytes]:
    """Maximal runs of ``text`` covered by byte strings typical for the own class."""
    def look(table: tuple, grams: np.ndarray) -> np.ndarray:
        if not len(table[0]):
            return np.zeros(len(grams))
        at = np.minimum(np.searchsorted(table[0], grams), len(table[0]) - 1)
        return np.where(table[0][at] == grams, table[1][at], 0)

    grams = _grams(text, size)
    if not len(grams):
        return []
    seen, expected = look(own, grams), (look(other, grams) + 1) * own[2] / other[2]
    hit = np.flatnonzero((seen >= least) & (seen >= MIN_RATIO * expected))
    edge = np.zeros(len(text) + 1, np.int32)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + size, -1)
    inside = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
    cuts = np.flatnonzero(np.diff(inside))
    return [text[a:b] for a, b in zip(cuts[::2], cuts[1::2])]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of about ``size`` bytes; small corpora get a smaller one."""
    import zstandard as zs

    packed, held = [], b""
    for s in samples:
        held += s + b" "
        if len(held) >= 256:
            packed.append(held)
            held = b""
    packed += [held] if held else []
    total = sum(map(len, packed))
    if total < 8 * size:
        size = max(256, total // 8)
    try:
        return zs.train_dictionary(size, packed, k=32, d=RUN_BYTES).as_bytes()
    except zs.ZstdError:          # too little text to train on: the text itself
        return b"".join(dict.fromkeys(packed))[:size]


def _compressors(model: Model) -> tuple:
    import zstandard as zs

    setting = zs.ZstdCompressionParameters(
        window_log=16, hash_log=15, chain_log=16, search_log=4, min_match=3, target_length=32, strategy=zs.STRATEGY_BTOPT,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zs.FORMAT_ZSTD1_MAGICLESS)
    out = []
    for content in (model.toxic, model.ordinary):
        dictionary = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=setting)
        out.append(zs.ZstdCompressor(dict_data=dictionary, compression_params=setting))
    return *out, model.ordinary[-LEAD_BYTES:]


def _n_features() -> int:
    return 2 * (6 + 2 * len(THRESHOLDS))


def features(text: str | None, compressors: tuple) -> np.ndarray:
    """Statistics of (ordinary - toxic) compressed window lengths; zeros for texts without words."""
    toxic, ordinary, lead = compressors
    gain, size = [], 0
    for w in windows(text, lead=lead):
        gain.append(len(ordinary.compress(w)) - len(toxic.compress(w)))
        size += len(w) - len(lead)
    if not gain:
        return np.zeros(_n_features())
    d = np.array(gain, np.float64)
    top = -np.sort(-d)[:3]
    up, down = np.maximum(d, 0).sum(), np.maximum(-d, 0).sum()
    own = np.array([top[0], top.mean(), 100 * up / (size + 20), 100 * down / (size + 20), np.log1p(up), np.log1p(len(d)),
                    *[(d >= t).mean() for t in THRESHOLDS], *[np.log1p((d >= t).sum()) for t in THRESHOLDS]])
    return np.concatenate([own, np.sign(own) * np.sqrt(np.abs(own))])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column is the constant."""
    w, keep = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(doc_id, toxic) of the folds that may be learned from; a repeated label counts once, conflicts as toxic."""
    rows = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
    return (rows.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def spread_sample(text: Column, most: int = MAX_TRAIN_CHARS, slices: int = TRAIN_SLICES) -> Column:
    """``text``, or of one longer than ``most`` characters ``slices`` stretches from its start to its end."""
    size = most // slices
    step = (F.length(text) - size) / (slices - 1)
    parts = F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda k: F.substring(text, F.floor(k * step).cast("int") + 1, F.lit(size)))
    return F.when(text.isNull() | (F.length(text) <= most), text).otherwise(F.array_join(parts, " "))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        max_docs: int = MAX_DOCS_PER_CLASS, seed: int = 42) -> Model:
    """Fit on at most ``max_docs`` labelled documents of each class, chosen by a hash of the id.

    The calibration carries the class sizes of *all* labelled rows, so the score
    is a probability whatever the sample. With one class only (or none) the model
    scores every text with that class's share.
    """
    rows = labelled(docs, labels, id_col)
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    pick = None
    for label in (0, 1):
        some = rows.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_docs)
        pick = some if pick is None else pick.unionByName(some)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    # Only the picked documents are cut, after the join.
    sample = (texts.join(F.broadcast(pick), "doc_id").select("doc_id", "toxic", spread_sample(F.col("text")).alias("text")).groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
              .orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").limit(2 * max_docs).collect())
    by = {c: [r["text"] for r in sample if r["toxic"] == c] for c in (0, 1)}
    n = {c: int(DICTIONARY_SHARE * len(by[c])) for c in by}
    raw = {c: [t.lower().encode("utf-8", "replace") for t in by[c][:n[c]]] for c in by}
    counts = {c: _context_counts(raw[c]) for c in by}
    least = int(np.clip(len(raw[1]) // 20, *MIN_CONTEXTS))
    own = _dictionary([r for t in raw[1] for r in _typical_runs(t, counts[1], counts[0], least)], OWN_BYTES)
    ordinary = _dictionary([w for t in raw[0] for w in windows(t.decode("utf-8", "replace"), 64, 64)], ORDINARY_BYTES)
    del counts
    width = _n_features() + 1
    total = sum(sizes.values())
    prior = np.log((sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + 0.5)) if total else 0.0
    model = Model(own + ordinary, ordinary, np.r_[np.zeros(width - 1), prior], np.zeros(width - 1), np.ones(width - 1),
                  {"labelled": sizes, "dictionaries": n, "calibration": {c: len(by[c]) - n[c] for c in by}})
    rest = [(t, c) for c in by for t in by[c][n[c]:]]
    y = np.array([c for _, c in rest], np.float64)
    if 0 < y.sum() < len(y):
        tools = _compressors(model)
        x = np.array([features(t, tools) for t, _ in rest])
        model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
        model.weights = _logistic(np.c_[(x - model.mean) / model.scale, np.ones(len(x))], y)
        model.weights[-1] += prior - np.log(y.sum() / (len(y) - y.sum()))
    return model


def _score(texts: Iterable, model: Model, tools: tuple) -> np.ndarray:
    x = np.array([features(t, tools) for t in texts]).reshape(-1, len(model.mean))
    z = (x - model.mean) / model.scale @ model.weights[:-1] + model.weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row over its whole text; NULL and empty texts have no window and get a score too."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _compressors(sent.value)
        for b in batches:
            values = _score((t.as_py() for t in b.column(1)), sent.value, tools)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values)], ["doc_id", "score"])

    return (docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
            .mapInArrow(run, "doc_id long, score double"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row."""
    out = score(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _scorer(sent):
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tools = _compressors(sent.value)
        for texts in batches:
            yield pd.Series(_score(texts, sent.value, tools))

    return run


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows scored at or above ``threshold``; decided row by row, all columns unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.where(_scorer(sent)(F.col(f"`{text_col}`")) < threshold)
