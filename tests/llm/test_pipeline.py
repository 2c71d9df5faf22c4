"""The five stages on a small corpus, against a plain version of each."""

import random

import pyarrow as pa
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from seriesloom.llm import decontaminate, jaccard, langid, pieces, quality, registry  # noqa: E402

from .test_decontaminate import brute as leaks  # noqa: E402
from .test_jaccard import brute_at as groups  # noqa: E402
from .test_langid import plain_predict  # noqa: E402
from .test_quality import plain_verdict  # noqa: E402


def corpus():
    rng = random.Random(3)
    lang = {"aa": [f"ka{i}lo" for i in range(300)], "bb": [f"été{i}ß" for i in range(300)]}

    def text(words, n):
        return "\n".join(" ".join(rng.choice(words) for _ in range(12)) + "." for _ in range(n // 12))

    rows = []
    for i in range(40):
        code = "aa" if i % 2 else "bb"
        rows.append([i, text(lang[code], 120), code, "s", 0])
    rows.append([40, rows[3][1], "aa", "s", 0])  # a copy
    rows.append([41, rows[4][1].replace("été1", "été1", 1) + " x", "bb", "s", 0])  # nearly a copy
    rows.append([42, "short text", "aa", "s", 0])
    rows.append([43, None, "aa", "s", 0])
    rows.append([44, "12 34 56. " * 60, "aa", "s", 0])
    # item 1 alone is enough to drop a document
    items = [(1, text(lang["aa"], 24)), (2, text(lang["aa"], 24)), (3, "unseen words only here in this item yes")]
    rows.append([45, rows[5][1] + " " + items[0][1] + "\n" + text(lang["aa"], 60) + " " + items[1][1], "aa", "s", 0])
    for r in rows:
        r[4] = len(r[1] or "")
    return rows, items


def test_stages_equal_plain_versions(spark, tmp_path):
    rows, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "language ID", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding and decoding"]

    model = quality.fit(docs)
    left = [r for r in rows if plain_verdict(model, r[1])[1]]
    assert {42, 43, 44}.isdisjoint(r[0] for r in left) and len(left) >= 40
    step = pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert step.columns == docs.columns and {r.doc_id for r in step.collect()} == {r[0] for r in left}

    kept = spark.createDataFrame(left, schema)
    lm = registry.language_model(kept)
    left = [r for r in left if plain_predict(lm, r[1])[2]]
    step = pipeline.STAGES[1][1](spark, kept, str(tmp_path))
    assert {r.doc_id for r in step.collect()} == {r[0] for r in left} and len(left) >= 40

    kept = spark.createDataFrame(left, schema)
    first = {c for _, c in groups([(r[0], r[1]) for r in left], 5, 80, 100)}
    left = [r for r in left if r[0] in first]
    step = pipeline.STAGES[2][1](spark, kept, str(tmp_path))
    assert step.columns == docs.columns and {r.doc_id for r in step.collect()} == {r[0] for r in left}
    assert 40 not in first and 41 not in first

    kept = spark.createDataFrame(left, schema)
    left = [r for r in left if not leaks(r[1], items)[1]]
    step = pipeline.STAGES[3][1](spark, kept, str(tmp_path))
    assert {r.doc_id for r in step.collect()} == {r[0] for r in left} and 45 not in {r[0] for r in left}

    whole = pieces.encode_whole(pa.array([r[1] for r in left]), registry.model_path())
    want = sorted(zip([r[0] for r in left], whole[0].tolist(), whole[1].to_pylist(), whole[2].to_pylist()))
    assert sorted(map(tuple, pipeline.run(spark, str(tmp_path)).collect())) == want
    assert decontaminate and jaccard and langid


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_at_five_words(spark, tmp_path):
    base = [f"w{i}" for i in range(100)]
    # two words differ: 86 of 106 five-word shingles (0.811), 89 of 105 four-word ones (0.848)
    near = [*base[:30], "x", *base[31:70], "y", *base[71:]]
    # three more differ: 81 of 111 five-word shingles (0.730)
    far = [*near[:10], "z", *near[11:50], "z", *near[51:90], "z", *near[91:]]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert {r.doc_id for r in pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()} == {1, 3}


def test_decontamination_decides_by_item(spark, tmp_path):
    seven, nine = "one two three four five six seven", "a b c d e f g h i"
    items = [(1, seven), (2, "yes"), (3, "not this one"), (None, nine), (4, None), (5, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, f"x {seven} y"), (2, "yes " * 9), (3, "not this one " * 5), (4, f"x {nine[2:]} y"), (5, "a b c d e f g x"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in pipeline.decontamination(spark, docs, str(tmp_path)).collect()} == {2, 3, 5, 6}


def test_odd_rows_and_names(spark, tmp_path):
    """Nulls in every column, repeated rows, long texts, and columns whose names the operators use."""
    word = lambda k: "ka" + chr(97 + k % 9) + chr(97 + k // 9)
    good = "\n".join(" ".join(word((i * 31 + j * 17 + i * j * 7) % 90) for j in range(12)) + "." for i in range(12))
    rows = [(1, good, "aa", "s", 1, 5, "h"), (1, good, "aa", "s", 1, 5, "h"), (None, None, None, None, None, None, None), (2, None, "aa", None, 0, 1, "x")]
    rows += [(3, (good + "\n") * 1 + " ".join(f"été{i}ß." for i in range(30_000)), None, "s", 9, 2, "y"), (None, good.replace("ka", "mu"), "aa", "s", 3, 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, class int, h string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "class", "h"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.filter("doc_id = 1").count() == 1
    assert pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
