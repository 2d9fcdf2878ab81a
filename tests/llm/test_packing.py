import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from riskspark.llm.catalog import word_tokenizer
from riskspark.llm.packing import WordTokens, best_fit_decreasing, pack, pack_documents, packed_sequences, read_sequences


def _one_by_one(lengths, capacity):
    """Plain best-fit decreasing: sorted bin sizes."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, used in enumerate(bins) if used + n <= capacity]
        if fits:
            bins[max(fits, key=lambda k: bins[k])] += n
        else:
            bins.append(n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(25))
def test_plan_equals_one_by_one_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    used, seen = {}, {}
    for length, first, count, bin_, per_bin, offset in best_fit_decreasing(histogram, capacity):
        assert first == seen.get(length, 0)
        seen[length] = first + count
        for j in range(count):
            b, at = bin_ + j // per_bin, offset + j % per_bin * length
            assert used.get(b, 0) == at
            used[b] = at + length
    assert seen == histogram and all(u <= capacity for u in used.values())
    assert sorted(used.values()) == _one_by_one(lengths, capacity)


def test_word_tokens_equal_whole_text_encoding():
    rng = random.Random(1)
    tokens = WordTokens(word_tokenizer(), limit=50)
    letters = "abAB Zz.,'!?<|>é́Σİ中09-_\n\t\r\x0b\x1c\x85  ßÿſ÷×ÉÖ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["<|endoftext|> a<|ENDOFTEXT|>. x<|startoftext|>", "It's I'LL 'Re", "É. Ω, a.. b., c,.", None, ""]
    whole = tokens.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for at in range(0, len(texts), 500):
        got = tokens.encode(pa.array(texts[at:at + 500], pa.string()))
        assert [g.tolist() for g in got] == [e.ids for e in whole[at:at + 500]]


def test_pieces_are_packed_without_gaps(documents):
    rows = [r.asDict() for r in pack_documents(documents, word_tokenizer()).collect()]
    whole = WordTokens(word_tokenizer()).tokenizer
    source = sorted(((r.doc_id, r.text) for r in documents.collect()), key=str)
    expected = []
    for doc_id, text in source:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            expected.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    got = [tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows]
    assert sorted(got, key=str) == sorted(expected, key=str)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(sum(n for _, n in p) for p in by.values()) == _one_by_one([r["length"] for r in rows], 2048)


def test_empty_table_and_hot_length(spark, no_documents):
    assert pack_documents(no_documents, word_tokenizer()).count() == 0
    hot = spark.range(5000).selectExpr("id doc_id", "0 piece", "cast(if(id < 4500, 3, id % 100 + 1) as long) length")
    packed = pack(hot, 100)
    assert packed.count() == packed.select("sequence_id", "offset").distinct().count() == 5000


def test_written_sequences_hold_the_ids(spark, documents):
    long = " ".join(f"word{k} and more" for k in range(60_000))
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(50, long), (51, "")], "doc_id long, text string"))
    written = packed_sequences(docs, word_tokenizer())
    whole = WordTokens(word_tokenizer()).tokenizer
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append([*whole.encode(r.text or "", add_special_tokens=False).ids, 0])
    seen = 0
    for r in written.collect():
        ids, at = np.frombuffer(bytes(r.ids), "<u2"), 0
        assert len(ids) == sum(p.length for p in r.pieces) <= 2048
        for p in r.pieces:
            assert ids[at:at + p.length].tolist() in [t[p.start:p.start + p.length] for t in texts[p.doc_id]]
            assert p.start == 2048 * p.piece
            at, seen = at + p.length, seen + p.length
    assert seen == sum(len(t) for ts in texts.values() for t in ts)
    assert read_sequences(written).count() == sum(-(-len(t) // 2048) for ts in texts.values() for t in ts)


def test_counts_beyond_the_broadcast_limit_are_joined(spark, documents):
    spark.conf.set("riskspark.broadcast.maxRows", "1")
    try:
        packed = pack_documents(documents, word_tokenizer())
        assert packed.select("sequence_id", "offset").distinct().count() == packed.count()
    finally:
        spark.conf.unset("riskspark.broadcast.maxRows")
