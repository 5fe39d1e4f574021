import numpy as np
from pyspark.sql import functions as F

from phenogrid.llm import language

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_vectors_are_those_of_the_definition():
    encoder = language.Encoder()
    text = "Été, the CAT!"
    slots = [0 if not c.isalpha() else (ord(c.lower()) - 96 if c.lower().isascii() else 27 + ord(c.lower()) % (language.SLOTS - 27)) for c in " " + text + " "]
    slots = [s for i, s in enumerate(slots) if s or i == 0 or slots[i - 1]]
    base = language.letter_vectors().astype(int)
    want = sum(np.roll(base[a], 2) * np.roll(base[b], 1) * base[c] for a, b, c in zip(slots, slots[1:], slots[2:]))
    got, lettered = encoder.encode([text, None, "", "123 ..", text])
    assert (got[0] == want).all() and (got[4] == want).all()
    assert lettered.tolist() == [True, False, False, False, True]


def test_long_texts_are_encoded_whole(monkeypatch):
    text = "abc def gh " * 500
    want = language.Encoder().encode([text])[0]
    monkeypatch.setattr(language, "CHUNK", 97)
    assert np.allclose(language.Encoder().encode([text])[0], want)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS).withColumn("held_out", F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"))
    model = language.train(docs.where("not held_out"), key=F.col("doc_id"))
    found = language.predict(docs, model, ["doc_id", "lang", "held_out"])
    right, n, low, high = found.where("held_out").agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 100 and right / n > 0.97 and 0 <= low <= high <= 1


def test_odd_rows(spark, odd_documents, no_documents):
    model = language.train(odd_documents)
    assert model.languages == ("en", "fr")
    rows = {r["doc_id"]: r for r in language.predict(odd_documents, model, odd_documents.columns).collect()}
    assert rows[2]["lang_pred"] == rows[3]["lang_pred"] == rows[4]["lang_pred"] == "und" and rows[2]["score"] == 0
    assert rows[7]["lang_pred"] == "fr" and rows[7]["component"] == "w"
    empty = language.train(no_documents)
    assert empty.languages == () and {r["lang_pred"] for r in language.predict(odd_documents, empty, ["doc_id"]).collect()} == {"und"}
    assert language.predict(no_documents, model, ["doc_id"]).count() == 0
    few = language.train(odd_documents, max_rows_per_language=2)
    assert set(few.languages) <= {"en", "fr"}


def test_predictions_by_definition(spark):
    """Prototypes and predictions computed again, letter by letter and text by text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 1500")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    base = language.letter_vectors().astype(int)
    slot = lambda c: 0 if not c.isalpha() else (ord(c.lower()[0]) - 96 if "a" <= c.lower()[0] <= "z" else 27 + ord(c.lower()[0]) % (language.SLOTS - 27))

    def vector(text):
        s = [slot(c) for c in " " + (text or "") + " "]
        s = [x for i, x in enumerate(s) if x or i == 0 or s[i - 1]]
        return sum((np.roll(base[a], 2) * np.roll(base[b], 1) * base[c] for a, b, c in zip(s, s[1:], s[2:]) if a or b or c), np.zeros(language.DIMENSIONS))

    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    vectors = {d: vector(t) for d, t, _ in rows}
    langs = sorted({x for _, t, x in rows if x and t})
    sums = np.array([unit(sum(unit(vectors[d]) for d, t, x in rows if x == lang and t)) for lang in langs])
    shared = unit(sums.mean(axis=0))
    prototypes = [unit(p - (p @ shared) * shared) for p in sums]
    found = {r["doc_id"]: r for r in language.predict(docs, language.train(docs), ["doc_id"]).collect()}
    assert len(found) == len(rows) > 25
    for d, t, _ in rows:
        v = vectors[d]
        cosines = [unit(v - (v @ shared) * shared) @ p for p in prototypes]
        if not any(c.isalpha() for c in t or ""):
            assert found[d]["lang_pred"] == "und"
            continue
        best = max(cosines)
        assert abs(found[d]["score"] - max(best, 0)) < 1e-3
        assert cosines[langs.index(found[d]["lang_pred"])] > best - 1e-3
