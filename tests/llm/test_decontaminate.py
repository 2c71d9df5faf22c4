import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from seriesloom.llm import decontaminate as D
from seriesloom.llm import textops as X

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(text, items):
    words = WORD.findall(low(text))
    hit, ids = set(), set()
    for i, t in items:
        w = WORD.findall(low(t))
        k = min(8, len(w))
        wins = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
        for p in range(len(words) - k + 1 if wins else 0):
            if tuple(words[p : p + k]) in wins:
                hit.update(range(p, p + k))
                if i is not None:
                    ids.add(str(i))
    ids = sorted(ids)
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()


def cases(seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "c", "d", "é", "F"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(vocab[: rng.randint(1, 6)]) for _ in range(n))
    items = [(i, text(rng.randint(0, 14))) for i in range(6)] + [(None, text(9)), (2, text(8)), (9, None)]
    docs = [None, "", "!!"] + [text(rng.randint(0, 40)) for _ in range(10)]
    for i, t in items:
        if t:
            docs.append(text(5) + " " + t + " " + text(3))
    return docs, items


def test_find_equals_brute_force():
    for seed in range(120):
        docs, items = cases(seed)
        index = D.Index([None if i is None else str(i) for i, t in items if t is not None], [t for _, t in items if t is not None])
        n, spans, ids = D.find(pa.array(docs, pa.string()), index)
        hit = [sum(x[1::2]) - sum(x[::2]) for x in spans.to_pylist()]
        rows = [(a, b, len(c), hashlib.sha256(",".join(c).encode()).hexdigest()) for a, b, c in zip(n.tolist(), hit, ids.to_pylist())]
        assert rows == [brute(d, items) for d in docs]


def test_every_shared_window_shares_a_fingerprint():
    for seed in range(60):
        docs, items = cases(seed)
        texts = [t for _, t in items if t is not None]
        who, h, k = D.item_prints(pa.array(texts, pa.string()))
        of = {}
        for w, x in zip(who.tolist(), h.tolist()):
            of.setdefault(w, set()).add(x)
        words = X.scan(*X.buffers(pa.array(docs, pa.string())), X.ALNUM)
        doc, g = D.fingerprints(words)
        mine = {}
        for d, x in zip(doc.tolist(), g.view(np.int64).tolist()):
            mine.setdefault(d, set()).add(x)
        for d, text in enumerate(docs):
            for i, t in enumerate(texts):
                if brute(text, [(1, t)])[1]:
                    assert mine[d] & of[i]


def test_repeated_words_are_linear(spark):
    docs = [(1, "w " * 20_000), (2, "x y " * 10_000), (3, "w " * 7)]
    items = [(1, "w " * 20_000), (2, "y x " * 5_000), (3, "w " * 8)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.spans) for r in D.scan(df, bench, carry=["doc_id"]).collect()}
    assert got == {1: (20_000, 20_000, ["1", "3"], [0, 20_000]), 2: (20_000, 20_000, ["2"], [0, 20_000]), 3: (7, 0, [], [])}


def test_scan_in_groups(spark, monkeypatch):
    docs, items = cases(3)
    df = spark.createDataFrame([(i, d, "x") for i, d in enumerate(docs)], "doc_id long, text string, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute(d, items) for i, d in enumerate(docs)}
    for size, most in ((1 << 20, 4096), (30, 2)):
        monkeypatch.setattr(D, "BIN", size)
        monkeypatch.setattr(D, "ITEMS", most)
        got = D.scan(df, bench, carry=["doc_id"]).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got} == want
    clean = D.filter_clean(df, bench)
    assert clean.columns == df.columns
    assert clean.count() == sum(w[2] < 2 for w in want.values())
    assert D.scan(df.limit(0), bench, carry=["doc_id"]).count() == 0
    assert D.scan(df, bench.limit(0), carry=["doc_id"]).agg({"n_hit": "sum"}).first()[0] == 0


def test_bitmap_has_what_it_was_made_of_and_little_else(spark):
    rng = np.random.default_rng(4)
    h = rng.integers(-(1 << 63), 1 << 63, 3000)
    wanted = D._wanted(*D.bitmap(spark.createDataFrame([(int(x),) for x in h], "h long")))
    assert wanted(h.view(np.uint64)).all()
    assert wanted(rng.integers(0, 1 << 63, 200_000).astype(np.uint64)).sum() < 5
