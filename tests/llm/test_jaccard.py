import random
import re

import numpy as np
import pytest

from seriesloom.llm import jaccard as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    n = len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted([(k, len(sets[i]), least.get(find(i)), links[i]) for i, (k, _) in enumerate(rows)], key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    text = lambda k: [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(k)]
    bases = [text(rng.choice([1, 2, 3, 5, 9, 10, 12, 14, 15, 16, 17, 18, 20, 22, 25, 30, 60, 150])) for _ in range(n // 3)]
    passage = text(20)
    out = [None, "", " \n", "One", "one", "A b", "a B"]
    for b in bases:
        out.append(" ".join(b))
        for _ in range(rng.randint(0, 4)):
            c = list(b)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(c))
                op = rng.randrange(3)
                c[at : at + (op != 0)] = [] if op == 1 and len(c) > 1 else ["q%d" % rng.randint(0, 9)]
            out.append(rng.choice([" ", "\n"]).join(c).title() if rng.random() < 0.2 else " ".join(c))
        if rng.random() < 0.3:
            out.append(" ".join(b + passage))
    rng.shuffle(out)
    return list(enumerate(out, 5)) + [(None, "lone words that nobody has"), (None, " ".join(bases[0])), (7, " ".join(bases[1]))]


@pytest.mark.parametrize("seed,chunk,light", [(1, 512, None), (2, 4, None), (3, 3, 0), (4, 512, 19)])
def test_join_equals_brute_force(spark, monkeypatch, seed, chunk, light):
    monkeypatch.setattr(J, "CHUNK", chunk)
    monkeypatch.setattr(J, "LIST", chunk)
    monkeypatch.setattr(J, "BROADCAST", chunk % 3 * 100)
    if light is not None:
        monkeypatch.setattr(J, "choose_boundary", lambda *a: light)
    rows = corpus(seed)
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, component_id int")
    got = sorted([tuple(r) for r in J.join(df).collect()], key=str)
    assert got == brute(rows)


def test_large_near_copy_group(spark, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", 16)
    monkeypatch.setattr(J, "LIST", 32)
    rng = random.Random(0)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(120):
        c = list(base)
        for _ in range(rng.randint(0, 5)):
            c[rng.randrange(len(c))] = f"x{k}{rng.random()}"
        rows.append((k, " ".join(c)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([tuple(r) for r in J.join(df).collect()], key=str) == brute(rows)


def test_empty_and_unlinked(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.join(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, "a b c d e")], "doc_id long, text string")
    assert sorted(map(tuple, J.join(df).collect())) == [(1, 0, 1, 0), (2, 2, 2, 0)]
    assert J.keep_one(df).count() == 2


def test_keep_one(spark):
    rows = corpus(9)[:-1] + [(999, "some other words that stand alone")] * 2
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, class string")
    got = J.keep_one(df)
    assert got.columns == df.columns
    by = {}
    for (k, t), (_, n, c, _) in zip(sorted(rows, key=lambda r: str(r[0])), sorted(brute(rows), key=lambda r: str(r[0]))):
        by.setdefault(k, []).append((n, c))
    groups = {c for r in by.values() for n, c in r if n and c is not None}
    # every component once, named by its least key; the null key that is alone; rows without words
    kept = [(r.doc_id, len(words(r.text))) for r in got.collect()]
    full = [k for k, n in kept if n]
    assert len(full) == len(groups) + 1
    assert {k for k in full if k is not None} == groups
    assert sum(n == 0 for _, n in kept) == sum(not words(t) for _, t in rows)


def test_gaps():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 3000):
        at = np.unique(rng.integers(0, 1 << 16, n))
        assert (J.places(J.gaps(at)) == at).all()
    assert J.places(J.gaps(np.array([0, 255, 256, 511, 2000]))).tolist() == [0, 255, 256, 511, 2000]


def test_boundary_follows_cost():
    assert J.light_cost(6) == 1 and J.light_cost(10) == 11
    assert J.choose_boundary({}, np.full(101, 1.0)) < J.choose_boundary({}, np.full(101, 8.0)) <= J.MOST_LIGHT
    common = J.Sketch()
    assert J.list_lengths(common).tolist() == [1.0] * 101
    common.table[:10] = 0x33
    assert set(J.list_lengths(common)) == {3.0}


def test_light_keys_cover_every_similar_pair():
    rng = np.random.default_rng(5)
    common = J.Sketch()
    for boundary in (0, 9, 13, 19):
        for _ in range(300):
            n = int(rng.integers(1, 30))
            a = np.unique(rng.integers(1, 1 << 62, n, dtype=np.uint64))
            b = a[rng.random(len(a)) > rng.choice([0, 0.05, 0.1, 0.2])]
            b = np.unique(np.concatenate([b, rng.integers(1, 1 << 62, int(rng.integers(0, 4)), dtype=np.uint64)]))
            over = len(np.intersect1d(a, b))
            if len(b) and J.similar(over, len(a), len(b)) and not np.array_equal(a, b):
                assert len(np.intersect1d(J.keys_of(a, common, boundary), J.keys_of(b, common, boundary)))


def brute_at(rows, size, num, den):
    """Component of each (key, text), by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = [k for k, _ in rows]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and root[i] != root[j] and den * len(a & b) >= num * len(a | b):
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    return sorted((k, r) for (k, _), r in zip(rows, root))


@pytest.mark.parametrize("seed,chunk,light", [(1, 512, None), (2, 3, 0), (4, 512, 16)])
def test_other_size_and_threshold_equal_brute_force(spark, monkeypatch, seed, chunk, light):
    monkeypatch.setattr(J, "CHUNK", chunk)
    if light is not None:
        monkeypatch.setattr(J, "choose_boundary", lambda *a: light)
    rows = [(i, t) for i, (_, t) in enumerate(corpus(seed, 90))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in J.join(df, size=5, least=(80, 100)).collect())
    assert got == brute_at(rows, 5, 80, 100)


def sets_of(rng, n):
    """Sets around a few centres, some of them alike."""
    centres = [rng.integers(1, 1 << 62, int(k), dtype=np.uint64) for k in rng.integers(2, 300, 6)]
    out = []
    for _ in range(n):
        c = centres[rng.integers(len(centres))]
        c = c[rng.random(len(c)) > rng.choice([0, 0.03, 0.1, 0.4])]
        out.append(np.unique(np.concatenate([c, rng.integers(1, 1 << 62, int(rng.integers(0, 9)), dtype=np.uint64)])))
    return [s for s in out if len(s)]


def parts(n, edges):
    root = list(range(n))
    for i, j in edges:
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("n,split", [(2, 0), (7, 0), (40, 0), (90, 0), (91, 0), (200, 0), (90, 30), (93, 50), (40, 39)])
def test_scan_connects_every_candidate_and_misses_no_similar_pair(n, split):
    rng = np.random.default_rng(n + split)
    sets = sets_of(rng, n)
    split = min(split, len(sets) - 1)
    sig = np.frombuffer(b"".join(J.signature(s) for s in sets), np.uint64).reshape(-1, J.WORDS)
    size = np.array([len(s) for s in sets])
    every = [(i, j) for i in range(len(sets)) for j in range(i) if not split or (i < split) != (j < split)]
    ok = [(i, j) for i, j in every if J.passes(sig, size, np.array([i]), np.array([j]))[0]]
    for i, j in every:
        if J.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
            assert (i, j) in ok
    u, v = J.walk(sig, size, split, most=5, wide=7)
    assert parts(len(sets), ok) == parts(len(sets), zip(u.tolist(), v.tolist()))
    if not split:
        import pyarrow as pa

        two = 2 * len(sets)
        table = pa.table({"k": [5, 9] * len(sets), "side": [0] * two, "class": np.repeat(np.arange(len(sets)), 2), "n": np.repeat(size, 2), "sig": [J.signature(s) for s in sets for _ in range(2)]})
        got = J.scan(table)
        assert parts(len(sets), zip(*[got.column(c).to_pylist() for c in "uv"])) == parts(len(sets), ok)


def test_shared_passage_joins_nothing(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(k, " ".join(f"w{rng.random()}" for _ in range(200)) + " " + passage) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    common, sizes = J.survey(df)
    assert sum(sizes.values()) == 0
    base = J.keep(J.describe(df, spark.sparkContext.broadcast(J.Sketch()), 0, "text", "doc_id", 4), "test")
    from pyspark.sql import functions as F

    classes = base.select("digest", F.col("key").alias("class"), F.col("n_shingles").alias("n"), "sig", "keys")
    assert J.candidates(classes, 3).count() == 0
    assert {r.n_links for r in J.join(df).collect()} == {0}


def test_long_text_of_one_word(spark):
    rows = [(1, "w " * 200_000), (2, "w " * 150_000 + "x"), (3, "w w w w"), (4, "w w w w x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.join(df).collect())) == [(1, 1, 1, 1), (2, 2, 2, 1), (3, 1, 1, 1), (4, 2, 2, 1)]


def test_extra_columns_and_null_keys(spark):
    df = spark.createDataFrame([(None, "a b c d e f", 1, "x"), (None, "a b c d e f", 2, "y"), (None, "other words here now", 3, "z"), (4, "", 4, "w")], "doc_id long, text string, k int, digest string")
    got = J.keep_one(df)
    assert got.columns == df.columns
    assert sorted(r.k for r in got.collect())[1:] == [3, 4]


def one_list(sets, least=J.LEAST):
    """Connected parts of what a scan of one list with all sets joins."""
    import pyarrow as pa

    n = len(sets)
    table = pa.table({"k": [2] * n, "side": [0] * n, "class": np.arange(n), "n": [len(s) for s in sets], "sig": [J.signature(s) for s in sets]})
    got = J.scan(table, least)
    return parts(n, zip(got.column("u").to_pylist(), got.column("v").to_pylist()))


@pytest.mark.parametrize("copies", [2, 40])
def test_chance_does_not_connect_long_sets(copies):
    rng = np.random.default_rng(8)
    passage = rng.integers(1, 1 << 62, 40, dtype=np.uint64)
    for n in (2500, 4000, 8000, 20_000):
        sets = [np.unique(np.concatenate([passage, rng.integers(1, 1 << 62, n + 9 * k, dtype=np.uint64)])) for k in range(copies)]
        assert one_list(sets) == list(range(copies))


def test_chance_does_not_connect_long_sets_at_the_pipelines_threshold():
    rng = np.random.default_rng(9)
    for n in (2500, 4000, 8000, 20_000):
        sets = [np.unique(rng.integers(1, 1 << 62, n + 9 * k, dtype=np.uint64)) for k in range(30)]
        near = np.unique(np.concatenate([sets[0][: len(sets[0]) * 92 // 100], rng.integers(1, 1 << 62, n // 20, dtype=np.uint64)]))
        assert one_list([*sets, near], (80, 100)) == [*range(30), 0]


def test_long_near_copies_are_linked(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.random()}"
    texts = []
    # lengths of signatures differ within these groups
    for n in (2050, 4100, 8300):
        base = [word() for _ in range(n)]
        texts += [" ".join(base), " ".join(base[: n * 9 // 10]), " ".join(base[: n * 8 // 10]), " ".join(base + [word() for _ in range(n // 20)])]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(r) for r in J.join(df).collect()], key=str)
    assert got == brute(rows)
    assert {r[2] for r in got} == {0, 4, 8}


def test_signatures_of_all_lengths_fold():
    rng = np.random.default_rng(11)
    sets = [np.unique(rng.integers(1, 1 << 62, n, dtype=np.uint64)) for n in (0, 5, 2048, 2049, 5000, 9000, 60_000)]
    sig, fine = J.folded([J.signature(s) for s in sets])
    assert [bits.shape for _, bits in fine] == [(4, 32), (3, 64), (2, 128), (1, 256)]
    for words, rows, bits in [(J.WORDS, np.arange(len(sets)), sig)] + [(b.shape[1], r, b) for r, b in fine]:
        for s, r in zip(sets, rows):
            if r >= 0:
                plain = np.bincount(((s >> np.uint64(8)) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) % 2
                assert (np.unpackbits(bits[r].view(np.uint8)) == plain).all()


@pytest.mark.parametrize("part", [1 << 15, 3])
def test_runs_equal_brute_force(monkeypatch, part):
    import pyarrow as pa

    monkeypatch.setattr(J, "PART", part)
    rng = np.random.default_rng(part)
    size = {int(name): int(n) for name, n in zip(rng.integers(-(1 << 62), 1 << 62, 60), 2 ** rng.uniform(0, 14, 60))}
    sets = [(name, n, np.unique(rng.integers(0, 90, 12, dtype=np.uint64))) for name, n in size.items()]
    table = pa.Table.from_batches(list(J.pack(iter(sets + sets[:20]), 1)))
    got = {}
    for r in J.runs(table, (80, 100)).to_pylist():
        got.setdefault((r["k"], r["m"], r["x"], r["y"]), []).append((r["part"], r["names"]))
    runs = []
    for (_, m, _, _), rows in got.items():
        assert [p for p, _ in sorted(rows)] == list(range(-(-m // part)))
        runs.append([x for _, names in sorted(rows) for x in names])
        assert len(set(runs[-1])) == len(runs[-1]) == m > 1
    together = {frozenset((a, b)) for run in runs for a in run for b in run}
    for a, n, k in sets:
        for b, o, q in sets:
            # all pairs that share a key and may be similar by size are in one run, and no run has a gap in its sizes
            if a != b and len(np.intersect1d(k, q)) and 100 * min(n, o) >= 80 * max(n, o):
                assert frozenset((a, b)) in together
    for run in runs:
        n = sorted(size[x] for x in run)
        assert all(b <= a * 1.26 for a, b in zip(n, n[1:]))
    assert len({tuple(sorted(run)) for run in runs}) == len(runs)
    assert J.runs(table.slice(0, 0)).num_rows == 0


def test_lists_of_chance_are_not_shuffled_with_signatures(spark):
    """Texts of unlike lengths share phrases two by two, as chance has it in a large corpus."""
    rng = random.Random(12)
    word = lambda: f"w{rng.getrandbits(60)}"
    texts = [[] for _ in range(60)]
    for a in range(60):
        for b in range(a):
            if a % 12 != b % 12:
                phrase = [word() for _ in range(6)]
                texts[a] += [word(), *phrase]
                texts[b] += [word(), *phrase]
    for a, t in enumerate(texts):
        t += [word() for _ in range(int(50 * 1.3 ** (a % 12 + 4)))]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4).localCheckpoint()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = written()
    assert {r.n_links for r in J.join(df, size=5, least=(80, 100)).collect()} == {0}
    per_word = (written() - before) / sum(map(len, texts))
    # 7.8 when every key and every signature of a list was a row
    assert per_word < 6.5
