import numpy as np
import pyarrow as pa
import pytest

from seriesloom.llm import langid as L
from seriesloom.llm import registry

WORDS = {"aa": "lorem ipsum dolor sit amet".split(), "bb": "éclair façade naïve über straße".split(), "cc": "qwx zzt kkp vvb jjd".split()}


def rows(n, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        out.append((i, " ".join(rng.choice(WORDS[lang], 30)), lang, "x"))
    return out


def plain_predict(model, text):
    """Language, score and acceptance, byte window by byte window."""
    text = text or ""
    if not any(c.isalpha() for c in text):
        return L.UNKNOWN, 0.0, False
    fold = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in text.encode())
    total, count, mask = np.zeros(len(model.langs)), 0, (1 << 32) - 1
    for n in L.ORDERS:
        for i in range(len(fold) - n + 1):
            if fold[i : i + n] != b" " * n:
                h = (int.from_bytes(fold[i : i + n], "big") + n * 0x3C6EF372) * 0x9E3779B1 & mask
                total += model.logits[((h ^ h >> 15) * 0x85EBCA6B & mask) >> 17]
                count += 1
    z = (total / max(count, 1) + model.bias) / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return model.langs[int(p.argmax())], float(p.max()), bool(p.max() >= model.threshold)


def test_prediction_equals_a_plain_one():
    model = L.train([(lang, *b) for (_, _, lang, _), b in zip(rows(60), L.bags(pa.array([r[1] for r in rows(60)])))])
    texts = [r[1] for r in rows(12, 5)] + ["a", "Éa 1 Z", "日本 qwx", "12", None, "zzt  \n lorem"]
    for got, text in zip(zip(*model.predict(pa.array(texts, pa.string()))), texts):
        want = plain_predict(model, text)
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-4 and bool(got[2]) == want[2]


def test_repeated_ids_train_once(spark):
    once = rows(60)
    docs = spark.createDataFrame(once + [(i, "zzz " + t, lang, s) for i, t, lang, s in once] * 20, "doc_id long, text string, lang string, l string")
    few = spark.createDataFrame(once, "doc_id long, text string, lang string, l string")
    a, b = L.fit(docs, sample=30), L.fit(few, sample=60)
    assert a.langs == b.langs == ["aa", "bb", "cc"]
    out = L.identify(few, a, carry=["doc_id", "lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.95


def test_bags_are_plain_byte_windows():
    text = "Ab é1c  d"
    fold = [b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in text.encode()]
    wins = [tuple(fold[i : i + n]) for n in L.ORDERS for i in range(len(fold) - n + 1)]
    wins = [w for w in wins if any(b != 32 for b in w)]
    at, n = L.bags(pa.array([text]))[0]
    assert n.sum() == len(wins)
    assert len(at) <= len(set(wins))


def test_prediction_does_not_depend_on_neighbours():
    model = L.train([(lang, b[0].astype(np.int64), b[1].astype(float)) for (_, t, lang, _), b in zip(rows(90), L.bags(pa.array([r[1] for r in rows(90)])))])
    texts = [r[1] for r in rows(9, 1)] + ["", None, "12 !!", "x", "é " * 200_000]
    langs, score, _ = model.predict(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        one = model.predict(pa.array([t], pa.string()))
        assert one[0][0] == langs[i] and abs(one[1][0] - score[i]) < 1e-4
    assert langs[9:12] == [L.UNKNOWN] * 3 and score[9:12].tolist() == [0, 0, 0]


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(rows(300) + [(None, "lorem", "aa", "x"), (1000, None, "aa", "x"), (1001, "ipsum dolor", None, "x"), (5, rows(300)[5][1], "cc", "y")], "doc_id long, text string, lang string, score string")
    model = registry.language_model(docs)
    assert model.langs == ["aa", "bb", "cc"]
    out = L.identify(docs, model, carry=["doc_id", "lang"]).collect()
    assert len(out) == 304
    seen = [r for r in out if r.lang and r.lang_pred != L.UNKNOWN]
    assert np.mean([r.lang == r.lang_pred for r in seen]) > 0.98
    assert next(r for r in out if r.doc_id == 1000).lang_pred == L.UNKNOWN
    kept = L.filter_language(docs, model)
    assert kept.columns == docs.columns and kept.count() >= 300


@pytest.mark.parametrize("ddl", ["doc_id long, text string, lang string"])
def test_nothing_to_learn(spark, ddl):
    docs = spark.createDataFrame([(1, "a b", None)], ddl)
    model = registry.language_model(docs)
    assert [tuple(r) for r in L.identify(docs, model, carry=["doc_id"]).collect()] == [(1, L.UNKNOWN, 0.0, False)]
    assert L.identify(docs.limit(0), model, carry=["doc_id"]).count() == 0
