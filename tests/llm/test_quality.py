import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(wins)
    hit = {i + d for i, w in enumerate(wins) if n[w] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab #|\n\té", max_size=60), max_size=6))
def test_counts(texts):
    texts = [None, *texts, "a b c " * 30, "x\nx\n\nx"]
    got = np.stack(quality.count(pa.array(texts, pa.string())), axis=1)[:, :5].tolist()
    assert got == [list(brute(t)) for t in texts]


def test_em_separates():
    rng = np.random.default_rng(0)
    good = rng.random(4000) < 0.9
    k = len(quality.RULES)
    p_bad = np.where(good[:, None], 0.003, 0.5)
    votes = np.where(rng.random((4000, k)) < p_bad, 0, 2)
    rows, n = np.unique(votes, axis=0, return_counts=True)
    m = quality.em(rows, n.astype(float))
    logit = m.prior + sum(m.weight[r][votes[:, r]] for r in range(k))
    assert ((logit > 0) == good).mean() > 0.98


def test_judge(spark):
    clean = " ".join(f"word{i} and more." if i % 7 == 0 else f"word{i}" for i in range(120))
    rows = [(1, clean, True), (2, "short", None), (3, None, None), (4, "", None), (None, clean, False), (1, clean, True), (5, "go! " * 200, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept boolean")
    out = quality.judge(docs, carry=["doc_id"]).select("doc_id", "n_words", "base_failed", quality.F.col("kept")).collect()
    by = {(r.doc_id): (r.n_words > 0, r.base_failed, r.kept) for r in out}
    assert len(out) == 7
    assert by[1] == (True, False, True) and by[None] == (True, False, True)
    assert by[2][1] and by[3][1] and by[4][1] and by[5][1]
    assert quality.filter_quality(docs).columns == docs.columns
    assert quality.filter_quality(docs).count() == 3
    assert quality.judge(docs.limit(0), carry=["doc_id"]).count() == 0


def verdicts(votes):
    rows, n = np.unique(votes, axis=0, return_counts=True)
    m = quality.em(rows, n.astype(float))
    assert all(b >= a - 1e-9 for a, b in zip(m.path, m.path[1:]))
    return m, m.prior + sum(m.weight[r][votes[:, r]] for r in range(votes.shape[1])) >= 0


def test_posterior_is_not_all_must_pass():
    """Where bad documents get several bad votes, a lone one is forgiven."""
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.9
    k = len(quality.RULES)
    votes = np.where(rng.random((20_000, k)) < np.where(good[:, None], 0.003, 0.5), 0, 2)
    m, kept = verdicts(votes)
    must_pass = ~(votes == 0).any(axis=1)
    assert (kept == good).mean() > 0.995 > 0.975 > (must_pass == good).mean()
    assert all(spared > 0.99 and caught > 0.2 for spared, caught in m.accuracies().values())


def test_a_rule_that_often_errs_does_not_turn_the_classes_round():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.9
    bad_vote = np.zeros((20_000, len(quality.RULES)), bool)
    bad_vote[np.arange(20_000), rng.integers(1, 6, 20_000)] = ~good
    bad_vote[:, 0] = rng.random(20_000) < 0.1
    _, kept = verdicts(np.where(bad_vote, 0, 2))
    assert (kept == good).mean() > 0.9 and not kept[~good].any()


@pytest.mark.parametrize("rate", [0.4, 0.8, 1.0])
def test_a_rule_that_most_documents_fail_rejects_none_by_itself(rate):
    rng = np.random.default_rng(2)
    good = rng.random(5_000) < 0.95
    votes = np.where(rng.random((5_000, len(quality.RULES))) < np.where(good[:, None], 0.001, 0.4), 0, 2)
    votes[:, 3] = np.where(rng.random(5_000) < rate, 0, 2)
    _, kept = verdicts(votes)
    assert kept[good].mean() > 0.98 and kept[~good].mean() < 0.2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_verdicts_agree_with_quality_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.withColumnRenamed("quality", "label")
    rows = quality.judge(docs, carry=["doc_id"]).join(labels, "doc_id").filter("not base_failed").select("kept", "label").collect()
    kept = {q: [r.kept for r in rows if r.label == q] for q in (0, 1)}
    assert np.mean(kept[1]) > 0.99 and np.mean(kept[0]) < 0.1


def test_long_text_and_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "word " * 300_000, 5, 2.0), (2, "a" * 500_000, 6, 3.0)], "doc_id long, text string, n_words int, quality double")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_repeat_words) for r in quality.judge(docs, carry=["doc_id"]).collect()}
    assert got == {1: (300_000, 1_200_000, 300_000), 2: (1, 500_000, 0)}
    assert quality.filter_quality(docs).columns == docs.columns


def plain_verdict(m, text):
    """(posterior, kept) from plain counts and the model's table."""
    n, chars, symbols, dup, repeat = brute(text)
    t = text or ""
    letters = sum(b >= 0xC0 or chr(b).isalpha() and b < 128 for b in t.encode())
    lines = sum(bool(WORD.search(x)) for x in t.split("\n"))
    w = WORD.findall(t)
    over = lambda a, b: a / b if b else None
    value = {
        "length": n, "word_length": over(chars, n), "symbols": over(symbols, n), "repeats": over(repeat, n), "dup_lines": over(dup, lines),
        "capitals": over(sum("A" <= c <= "Z" for c in t), letters), "marks": over(sum(c in "!?" for c in t), n), "echoes": over(sum(a == b for a, b in zip(w, w[1:])), n),
        "sentences": over(sum(c in ".!?" for c in t), n), "line_length": over(n, lines), "letters": over(letters, chars),
    }
    z = m.prior
    for i, (name, _, bad_lo, good_lo, good_hi, bad_hi) in enumerate(quality.RULES):
        x = value[name]
        bad = x is not None and ((bad_lo is not None and x < bad_lo) or (bad_hi is not None and x > bad_hi))
        good = x is not None and (bad_lo is None or x >= good_lo) and (bad_hi is None or x <= good_hi)
        z += m.weight[i][0 if bad else 2 if good else 1]
    p = 1 / (1 + np.exp(-z))
    return p, n >= 50 and 100 * repeat <= 50 * n and p >= 0.5


def test_verdict_is_the_posterior_of_the_votes(spark):
    """The whole operator against plain Python."""
    texts = ["go! " * 90, "The cat sat. " * 40, "alpha beta gamma delta. " * 3, "x # " * 60, None, "Été à la plage.\n" * 30 + "Über ß " * 40, "\n\n a\n a\n" * 20]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string")
    m = quality.fit(docs)
    for r in quality.judge(docs, carry=["doc_id", "text"], model=m).collect():
        p, kept = plain_verdict(m, r.text)
        assert abs(r.quality - p) < 1e-9 and r.kept == kept
