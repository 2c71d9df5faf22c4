import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesloom.llm import pieces, registry

MODEL = registry.model_path()
STATE = pieces.Chunks(pieces.load(MODEL))


def same(texts):
    arr = pa.array(texts, pa.string())
    a, b = pieces.encode_texts(arr, STATE), pieces.encode_whole(arr, MODEL)
    for x, y in zip(a, b):
        assert list(x) == list(y) if not isinstance(x, pa.Array) else x.to_pylist() == y.to_pylist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab the\n\t▁é日　\x00<>") + ["🙂"]), max_size=40), max_size=5))
def test_equals_library(texts):
    same(texts)


def test_edges():
    same([None, "", " ", "   ", " a", "a ", "a  ", "▁", "x▁ y", "w " * 5000, "z" * 20000, "<s> <0x0A> </s>"])


def test_table_may_be_emptied(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE", 2)
    same(["a b c d e", "f g h", "a b c d e"])


def test_models_that_are_not_chunkable():
    assert pieces.chunkable(pieces.load(MODEL))

    class Crossing:
        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "a▁b"

    assert not pieces.chunkable(Crossing())


@pytest.mark.parametrize("n", [0, 3])
def test_query_shape(spark, n):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(["a b", None, "c"][:n])], "doc_id long, text string, n_tokens int")
    out = pieces.encode(docs, MODEL, carry=["doc_id"])
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert out.count() == n
