"""Toxicity: the features of texts, and documents that the fit has not seen."""

import random
import zlib

import pytest
from pyspark.sql import Row

from graphloom.llm import toxicity as T


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def corpus(n=500, seed=3):
    r = random.Random(seed)
    clean = ["".join(r.choice("abdeghilmnoprstu") for _ in range(r.randrange(2, 9))) for _ in range(300)]
    bad = ["zork" + "".join(r.choice("aeilns") for _ in range(3)) for _ in range(40)] + ["blarg", "grommish"]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(clean) for _ in range(r.randrange(20, 200))]
        if toxic := i % 6 == 0:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(bad))
        docs.append(Row(doc_id=i, text=" ".join(words)))
        labels.append(Row(doc_id=i, quality=1, toxic=int(toxic)))
    return docs, labels


def test_words_as_they_read():
    assert T.read("Stupid!!") == ("stupid", False)
    assert T.read("st.u.pid") == ("stupid", True) == T.read("5tup1d,")
    assert T.read("$tupid") == ("stupid", True)
    assert T.read("2024") == ("2024", False) and T.read("###") == ("", False) and T.read("l'eau") == ("l'eau", False)
    assert {"stupid", "stu-", "stupi-"} < T.Units().of("STUPID 17") and T.Units().of(None) == set() == T.Units().of("a of " + "x" * 90)
    assert T.Units(frozenset({"stu-", "other"})).of("Stupid stuff, OTHER") == {"stu-", "other"}
    assert T.signs("AÉb1 \U0001d400Ω") == (4, 3) and T.signs("") == (0, 0)


def test_features():
    lexicon = T.Lexicon({"idiot": 5.0, "zork-": 4.0, "meh": 1.5})
    f = dict(zip(T.FEATURES, lexicon.features("You idiot! ID10T and ZORKA zorkino meh"), strict=True))
    assert f["density"] == 5 / 7 and f["strong"] == 4 / 7 and f["distinct"] == 3.0 and f["best"] == f["second"] == 5.0
    assert f["beginnings"] == 2 / 7 and f["persons"] == 1 / 7 and f["person"] == 3 / 7 and f["obfuscated"] == f["obfuscated_hits"] == 1 / 7 and f["shouted"] == 2 / 7
    assert lexicon.features(None) == lexicon.features("") == [0.0] * len(T.FEATURES)
    assert len(lexicon.features(" \n" * 1000 + "é" * 100_000)) == len(T.FEATURES)


def test_documents_that_were_not_seen(spark):
    """Held-out toxic documents are found, by words that the fit hasn't seen too; the held-out labels change nothing."""
    docs, labels = corpus()
    extra = [Row(doc_id=None, text=None), Row(doc_id=10_000, text=""), Row(doc_id=10_001, text="x" * 200_000), docs[6], Row(doc_id=10_002, text="you zorkqqq and you zorkwww you zorkeee zorkxxx of the this")]
    table = spark.createDataFrame([*docs, *extra]).repartition(3)
    scores = lambda marks: {(r["doc_id"], r["held_out"]): (r["score"], r["predicted"]) for r in T.toxicity(table, spark.createDataFrame(marks), trees=6).collect()}
    found = scores(labels)
    truth = {r["doc_id"]: r["toxic"] for r in labels}
    own = [(found[i, True], truth[i]) for i in truth if held(i)]
    assert len(own) > 60 and sum((s[1] == y) for s, y in own) >= 0.95 * len(own)
    assert all(0 <= s <= 1 and p == (s >= 0.5) for s, p in found.values())
    assert found[10_002, held(10_002)][1] == 1 and found[10_000, held(10_000)][1] == 0 and found[None, True][1] == 0
    other = scores([Row(doc_id=r["doc_id"], quality=0, toxic=1 - r["toxic"]) if held(r["doc_id"]) else r for r in labels])
    assert other == found


@pytest.mark.parametrize(("marks", "want"), [([], 0.0), ([(1, 0), (2, 0)], 0.0), ([(1, 1), (2, 1), (None, 0), (3, None)], 1.0)])
def test_without_two_labels(spark, marks, want):
    docs = spark.createDataFrame([(1, "a b", 5), (2, None, 6), (3, "", 7)], "Doc_ID long, text string, SCORE int")
    out = T.toxicity(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert out.columns == ["Doc_ID", "held_out", "score", "predicted"]
    assert [r["score"] for r in out.collect()] == [want] * 3
    assert T.toxicity(docs.limit(0), spark.createDataFrame(marks, "doc_id long, toxic int")).count() == 0


def test_few_labels(spark):
    docs, labels = corpus(12)
    out = T.toxicity(spark.createDataFrame(docs), spark.createDataFrame(labels), trees=2, fit_rows=8).collect()
    assert len(out) == 12 and all(0 <= r["score"] <= 1 for r in out)
