import random
import zlib

import pytest
from pyspark.sql import functions as F

from riskspark.llm.toxicity import drop_toxic, fit, held_out, labelled, toxicity

from .conftest import prose

BAD = ["gronkle", "vexnut", "dribblewort", "snarfling"]


def _text(toxic, seed):
    rng, words = random.Random(seed), prose(random.Random(seed).randint(20, 200), seed).split()
    for _ in range(max(2, len(words) // 15) if toxic else 0):
        words.insert(rng.randrange(len(words)), rng.choice(BAD))
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, _text(i % 6 == 0, i), "en", 5) for i in range(1500)]
    rows += [(2000, None, "en", 5), (2001, "", "en", 5), (2002, "  ", "en", 5), (2003, prose(40_000, 7), "en", 5), (None, _text(True, 9), "en", 5), (3, _text(False, 3), "en", 5)]
    labels = [(i, int(i % 6 == 0)) for i in range(1500)] + [(6, 1), (7, None), (None, 1), (9999, 1)]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, score int"),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    rows = toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    fold = {r.doc_id: r for r in rows if r.held_out and r.doc_id < 1500}
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == (i in fold) for i in range(1500))
    right = sum(r.predicted == int(i % 6 == 0) for i, r in fold.items())
    assert right >= 0.97 * len(fold)
    assert {r.predicted for r in rows if r.doc_id in (2000, 2001, 2002, 2003)} == {0}


def test_the_held_out_fold_never_reaches_the_model(spark, corpus):
    docs, labels = corpus
    assert not labelled(docs, labels).where(held_out(F.col("doc_id"))).count()
    flipped = labels.withColumn("toxic", F.expr("if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic)"))
    a, b = fit(docs, labels), fit(docs, flipped)
    assert a.toxic == b.toxic and a.ordinary == b.ordinary and (a.weights == b.weights).all()


def test_filter_keeps_columns_and_clean_rows(corpus):
    docs, labels = corpus
    kept = drop_toxic(docs, fit(docs, labels))
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and {2000, 2001, 2002, 2003} <= ids
    assert len([i for i in range(1500) if i % 6 and i in ids]) >= 0.99 * 1250 and len([i for i in range(0, 1500, 6) if i in ids]) <= 10


def test_degenerate_labels_and_empty_tables(spark, corpus, no_documents):
    docs, labels = corpus
    none = labels.where("false")
    assert {r.predicted for r in toxicity(docs, none).collect()} <= {0, 1}
    one = {r.predicted for r in toxicity(docs, labels.where("toxic = 0")).collect()}
    assert one == {0}
    assert toxicity(no_documents, labels).count() == 0


def test_long_training_texts_are_sampled_over_their_whole_length(spark):
    from pyspark.sql import functions as F

    from riskspark.llm.toxicity import MAX_TRAIN_CHARS, TRAIN_SLICES, spread_sample
    long = "".join(f"{k:07d} " for k in range(12_500))                   # 100 000 characters
    rows = spark.createDataFrame([(1, long), (2, long[:MAX_TRAIN_CHARS]), (3, "short"), (4, None)], "id int, text string")
    got = {r.id: r.s for r in rows.select("id", spread_sample(F.col("text")).alias("s")).collect()}
    assert got[2] == long[:MAX_TRAIN_CHARS] and got[3] == "short" and got[4] is None
    size = MAX_TRAIN_CHARS // TRAIN_SLICES
    assert got[1].startswith(long[:size]) and got[1].endswith(long[-size:]) and len(got[1]) == MAX_TRAIN_CHARS + TRAIN_SLICES - 1
    starts = [long.index(got[1][k * (size + 1):k * (size + 1) + size]) for k in range(TRAIN_SLICES)]
    assert max(b - a for a, b in zip(starts, starts[1:])) - min(b - a for a, b in zip(starts, starts[1:])) <= 1


def test_ordinary_dictionary_sees_ordinary_text_only(spark, monkeypatch):
    from riskspark.llm import toxicity
    seen = []
    train = toxicity._dictionary
    monkeypatch.setattr(toxicity, "_dictionary", lambda samples, size: seen.append(b" ".join(samples)) or train(samples, size))
    rows = [(k, prose(8, 900 + k) + (" vilemarker goes here " if k % 2 else " gentle words follow here ") + prose(30, k)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert b"vilemarker" not in seen[1] and b"gentle" in seen[1] and b"vilemarker" not in model.ordinary and b"vilemarker" in model.toxic
