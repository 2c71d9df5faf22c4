import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import backoff as B

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows):
    """An explicit automaton, walked token by token."""
    seen = Counter()
    for _, t, train in rows:
        if train:
            seq = ["<", *words(t), ">"]
            for k in (1, 2, 3):
                seen.update(tuple(seq[i : i + k]) for i in range(len(seq) - k + 1))
    times = lambda h: seen[(">",)] if h == ("<",) else seen[h]
    uni = {k[0]: c for k, c in seen.items() if len(k) == 1 and k != ("<",)}
    n, v = sum(uni.values()), len(uni)

    def prob(h, w):
        if not h:
            return (uni.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))
        return (seen[(*h, w)] + B.KAPPA * prob(h[1:], w)) / (times(h) + B.KAPPA)

    # arcs for seen n-grams; failure arcs to the shorter history
    out = []
    for i, t, train in rows:
        state, score, base, known = ("<",) if times(("<",)) else (), 0.0, 0.0, 0
        seq = [*words(t), ">"]
        read = ["<"]
        for w in seq:
            base += math.log10(prob((), w))
            known += uni.get(w, 0) > 0
            while state and not seen[(*state, w)]:
                score += math.log10(B.KAPPA / (times(state) + B.KAPPA))
                state = state[1:]
            score += math.log10(prob(state, w))
            read.append(w)
            state = next((h for h in (tuple(read[-2:]), (w,)) if seen[h]), ())
        out.append((i, len(seq), known, n, round(base, 8), round(score, 8)))
    return out


TEXTS = ["a b a b c", "A b\tc", None, "", "x y z", "a b a b c", "é é 日本 a", "b " * 3000, "q"]


@pytest.mark.parametrize("train", [lambda i: i % 3 != 1, lambda i: False])
def test_score_equals_walk(spark, train):
    rows = [(i, t, train(i)) for i, t in enumerate(TEXTS * 3)] + [(None, "a b", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score boolean").repartition(3)
    got = []
    for block in (F.lit(0).cast("long"), F.coalesce(F.col("doc_id"), F.lit(9)) % 4):
        out = B.score(df, F.col("score"), block).collect()
        got.append(sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8), round(r.score, 8)) for r in out], key=str))
    want = sorted(brute(rows), key=str)
    for g in got:
        assert [x[:4] for x in g] == [x[:4] for x in want]
        assert all(abs(a - b) < 1e-6 for x, y in zip(g, want) for a, b in zip(x[4:], y[4:]))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert B.score(df, F.lit(True), F.lit(0).cast("long")).count() == 0


def test_packing():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50, dtype=np.uint64))
    for bits, width in ((8, 40), (8, 64), (11, 48), (16, 56)):
        whole = keys >> np.uint64(64 - width) << np.uint64(64 - width)
        shard = whole >> np.uint64(64 - bits)
        for h in np.unique(shard):
            part = whole[shard == h]
            assert (B.unpack(B.pack(part, bits // 8, width // 8), bits // 8, width // 8, int(h) >> (bits % 8)) == part).all()
    for a in ([], [0, 255], [256], [70000], [1 << 40]):
        assert B.narrow(B.wide(np.array(a, np.int64))).tolist() == a


def test_blocks_of_files_and_sql(spark, tmp_path):
    """Over files, with texts of very different lengths, a column of a clashing name, and the SQL."""
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["a", "B", "c", "dd", "é", "f."]) for _ in range(n))
    rows = [(i, text(rng.choice([0, 1, 5, 40, 300])), "m") for i in range(200)] + [(200, text(60_000), "m"), (201, None, "m"), (202, "z" * 400_000, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _metadata string")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    per = docs.select(B.block_of(docs, rows=64).alias("b"), F.octet_length("text").alias("n")).groupBy("b").agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()
    assert len(per) > 4 and max(r.k for r in per) <= 64
    got = {r.doc_id: r for r in B.score(docs, F.col("doc_id") % 5 != 1, B.block_of(docs, rows=64)).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cur = con.execute(B.sql("doc_id % 5 <> 1", "doc_id % 5 = 1"))
    names = [c[0] for c in cur.description]
    for row in cur.fetchall():
        want, r = dict(zip(names, row)), got[row[0]]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (want["n_tokens"], want["n_known"], want["train_tokens"])
        assert abs(r.base_score - want["base_score"]) < 1e-5 and abs(r.score - want["score"]) < 1e-5
    assert len(got) == len(rows)
