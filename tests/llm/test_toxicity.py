import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seriesloom.llm import toxicity as X
from seriesloom.llm.common import remainder

BAD = ["loser", "idiot", "scum"]
FINE = "the quick brown fox jumps over lazy dogs while seven modest writers sit around quiet tables reading simple lines".split()


def texts(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(FINE) for _ in range(40)]
        toxic = i % 4 == 0
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words[rng.randrange(40)] = rng.choice(BAD)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_trigrams_count_all_of_each_text():
    got = X.trigrams(pa.array(["ab", None, "É"], pa.string())).reshape((X.CLASSES,) * 3)
    assert got[0, 0, 1] == 1 and got[0, 1, 2] == 1 and got[1, 2, 0] == 1
    assert got[0, 0, 5] == 1  # an accented letter counts as its base


def test_viterbi_finds_the_best_reading():
    rng = np.random.default_rng(0)
    lm = np.log(rng.dirichlet(np.ones(X.CLASSES), (X.CLASSES, X.CLASSES))).astype(np.float32)
    for token in ("1d10t", "a55", "l.o.s3r", "stuuupid", "b00k"):
        best = None
        for path in itertools.product(*X.readings(token)):
            word, cost, a, b = "".join(p[0] for p in path), sum(p[1] for p in path), 0, 0
            for ch in word:
                z = ord(ch) - 96
                cost += lm[a, b, z]
                a, b = b, z
            cost += lm[a, b, 0]
            if word and (best is None or cost > best[0] + 1e-9):
                best = (cost, word)
        assert X.decode(token, lm, 8)[0] == best[1]


def model(spark, rows):
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return docs, X.fit(docs, labels.filter(remainder("doc_id", 5) != 0))


def test_learns_and_deobfuscates(spark):
    rows = texts(400) + [(None, "nothing", 0), (9001, None, 1), (9002, "", 0)]
    docs, m = model(spark, rows)
    got = {r.doc_id: r.score for r in X.rate(docs, m, carry=["doc_id"]).collect()}
    held = [(got[i], y) for i, _, y in rows[:400] if i is not None]
    assert np.mean([(s >= 0.5) == (y == 1) for s, y in held]) > 0.97
    plain = "quick brown fox sit"
    assert m.score(plain) < 0.5 and m.score("") == m.score(None) < 0.5
    for word in ("idiot", "1d10t", "i d i o t", "id.iot", "idiiiot", "sc*um", "$cum", "l0s3r", "LOSER!!"):
        assert m.score(plain + " " + word + " fox") > 0.5, word
    assert m.score("word " * 20_000 + "z" * 100_000) < 0.5


def test_labels_of_one_kind_or_none(spark):
    rows = [(i, t, 0) for i, t, _ in texts(20)]
    docs, m = model(spark, rows)
    assert {r.score < 0.5 for r in X.rate(docs, m, carry=["doc_id"]).collect()} == {True}
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    m = X.fit(docs, labels)
    assert X.rate(docs.limit(0), m, carry=["doc_id"]).count() == 0
    assert 0 <= m.score("a b") < 0.5
    assert F is not None


def plain_viterbi(token, lm):
    """Best reading of a lattice with blanks, by trying all paths."""
    best = (-np.inf, "")
    for path in itertools.product(*X.lattice(token)):
        cost, a, b = sum(p[1] for p in path), 0, 0
        for ch in "".join(p[0] for p in path):
            z = 0 if ch == " " else ord(ch) - 96
            if z or b:
                cost += lm[a, b, z]
                a, b = b, z
        cost += lm[a, b, 0] if b else 0
        if cost > best[0] + 1e-9:
            best = (cost, "".join(p[0] for p in path).split())
    return best


def test_lattice_with_blanks_is_searched_whole():
    rng = np.random.default_rng(1)
    lm = np.log(rng.dirichlet(np.ones(X.CLASSES), (X.CLASSES, X.CLASSES))).astype(np.float32)
    for token in ("a m o r o n", "1d 10t", "foo,mor.on", "i d i o t", "sc um a"):
        score, words = plain_viterbi(token, lm)
        got = X.paths(X.lattice(token), lm.tolist(), X.BEST)
        assert abs(got[0][0] - score) < 1e-4 and got[0][1].split() == words


def test_gaps_are_what_the_whole_lattice_says():
    rng = np.random.default_rng(2)
    lm = np.log(rng.dirichlet(np.ones(X.CLASSES), (X.CLASSES, X.CLASSES))).astype(np.float32)
    gaps = X.Gaps(lm)
    for _ in range(60):
        # no letter twice in a word, which would have more readings
        words = ["".join(chr(97 + c) for c in rng.permutation(26)[: int(rng.integers(2, 5))]) for _ in range(6)]
        glued, chains = gaps.words(words)
        read = plain_viterbi(" ".join(words), lm)[1]
        assert not chains and {w for w in read if w not in words} == set(glued)


def test_spacing_and_long_tokens(spark):
    _, m = model(spark, texts(400))
    plain = "quick brown fox sit"
    assert m.score(plain) < 0.5
    spaced = ("a i d i o t", "s c u m l o s e r", "f o x i d i o t", "id iot", "1d 10t", "i d iot", "lo ser")
    joined = ("fox,idiot", "fox/l0s3r", "fox-" * 30 + "idiot", "fox." * 20 + "1d10t", ".".join("brown" * 20) + ",i.d.i.o.t", " ".join("fox" * 40) + " i d i o t")
    for word in spaced + joined:
        assert m.score(plain + " " + word + " fox") > 0.5, word
    for word in ("a b r o w n", "qu ick", "fox,brown", "fox-" * 30 + "brown", "f o x b r o w n"):
        assert m.score(plain + " " + word + " fox") < 0.5, word
    assert m.score("x1," * 30_000) < 0.5 and m.score("a 1 " * 30_000) < 0.5


def test_other_scripts_long_tokens_and_digits_give_features(spark):
    lm = np.log(np.full((X.CLASSES,) * 3, 1 / X.CLASSES)).astype(np.float32)
    noisy = "idiot" + "_" * 70 + "x"
    assert "idiot" in X.restore(noisy, lm) and X.restore("455", lm)
    rows = [(i, t.replace("idiot", "дурак").replace("loser", "455").replace("scum", "笨蛋"), y) for i, t, y in texts(400)]
    _, m = model(spark, rows)
    plain = "quick brown fox sit"
    assert m.score(plain) < 0.5 < min(m.score(f"{plain} {w} fox") for w in ("дурак", "455", "笨蛋!"))
    assert m.score(plain + " собака 777") < 0.5


def test_every_word_counts():
    lm = np.log(np.full((X.CLASSES,) * 3, 1 / X.CLASSES)).astype(np.float32)
    words = "alpha bravo carol delta eagle fable gamma".split()
    m = X.Model(lm, {"=" + w: 2.0 for w in words}, np.array([0.0, 0.0, 1.0, 0.0]))
    scores = [m.score(" ".join(words[: k + 1])) for k in range(len(words))]
    assert scores == sorted(set(scores))


def test_decoding_changes_held_out_scores(spark):
    """Ablation: what the lattice restores is what tells noisy texts."""
    _, m = model(spark, texts(400))
    noise = {"loser": "l0$er", "idiot": "1d1ot", "scum": "$cuum"}
    held = []
    for _, t, y in texts(200, seed=5):
        for word, other in noise.items():
            t = t.replace(word, other)
        held.append((t, y))
    whole = [(m.score(t) >= 0.5) == (y == 1) for t, y in held]
    decode = X.decode
    X.decode = lambda token, lm, best=4: []
    try:
        bare = X.Model(m.lm, m.weight, m.coef)
        without = [(bare.score(t) >= 0.5) == (y == 1) for t, y in held]
    finally:
        X.decode = decode
    assert np.mean(whole) > 0.97 > np.mean(without)


def test_two_labels_two_texts_and_repeated_rows(spark):
    rows = texts(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(i, t + " again") for i, t, _ in rows[:50]], "doc_id long, text string")
    labels = [(i, y) for i, _, y in rows]
    one = spark.createDataFrame(labels + [(i, 1) for i, _, y in rows if y], "doc_id long, toxic int")
    two = spark.createDataFrame([(i, 0) for i, _, y in rows if y] + labels[::-1], "doc_id long, toxic int").repartition(3)
    a, b = X.fit(docs, one), X.fit(docs.repartition(5), two)
    assert a.weight == b.weight and np.allclose(a.coef, b.coef, atol=1e-9)


def test_whole_operator_against_a_plain_version(spark):
    """Evidence and score with every choice of readings tried, for texts of plain and noisy words."""
    _, m = model(spark, texts(400))

    def plain_words(text):
        out = set()
        for token in text.lower().split():
            core = X._EDGE.sub("", X._MARKS.sub("", token))
            if core.isalpha():
                out.add(core)
                continue
            found = {}
            for path in itertools.product(*X.readings(core)):
                word, cost, a, b = "".join(p[0] for p in path), sum(p[1] for p in path), 0, 0
                for ch in word:
                    cost, a, b = cost + m.lm[a, b, ord(ch) - 96], b, ord(ch) - 96
                found[word] = max(found.get(word, -np.inf), cost + m.lm[a, b, 0])
            out |= {w for w in sorted(found, key=found.get)[-X.BEST :] if w} | {"".join(c for c in core if c.isalpha())}
        return out

    rng = random.Random(8)
    for _ in range(40):
        text = " ".join(rng.choice([*FINE, "1d10t", "l0ser,", "br0wn", "(fox)", "sc@m"]) for _ in range(8))
        weights = sorted(max((m.weight.get(k, 0.0) for k in X.features(w)), default=0.0) for w in plain_words(text))
        a, b = m.evidence(text)
        # the plain version looks at words, the operator at tokens, so only the strongest is the same by definition
        assert abs(a - weights[-1]) < 1e-9 and b >= 0
        z = m.coef @ np.array([a, max(0.0, a - X.STRONG), b, 1.0])
        assert abs(m.score(text) - 1 / (1 + np.exp(-z))) < 1e-9
