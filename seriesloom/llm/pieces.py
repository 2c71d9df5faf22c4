"""SentencePiece encoding and decoding by a distinct-chunk table.

When no piece of a model has a white-space marker after another character, no
merge crosses the start of a run of markers.  A text's pieces are then the pieces
of its chunks (a run of markers and the characters up to the next run), so every
distinct chunk is segmented once and the ids are joined back by position.

Chunks are found by a few NumPy passes over the bytes of a batch of texts, made
distinct by Arrow, looked up in the table, and taken back to their positions by
Arrow; Python touches distinct chunks only.

The table is local to a task and emptied when it holds ``TABLE`` chunks or
``TABLE_BYTES`` of them, so memory is bounded whatever the vocabulary.  A chunk is
segmented once per batch at most, and again only after the table was emptied, with
the same result.  A table shared by all tasks would need the position of every word
of the corpus to be shuffled twice.  ``chunkable`` checks the condition on the model
and whole texts are encoded where it does not hold.

Defined results: a null or empty text has no ids and decodes to empty text; texts
of any length are read whole; repeated rows get equal rows; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from seriesloom.llm import textops as X
from seriesloom.llm.common import fields, map_text

MARK = "▁"
TABLE = 1 << 17
TABLE_BYTES = 96 << 20
OUT = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"

_loaded: dict[str, sentencepiece.SentencePieceProcessor] = {}


def load(model: str) -> sentencepiece.SentencePieceProcessor:
    if model not in _loaded:
        _loaded[model] = sentencepiece.SentencePieceProcessor(model_file=model)
    return _loaded[model]


def chunkable(sp: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether chunks may be encoded apart and joined.

    Checked on the model: no piece crosses the start of a run of markers, all 256
    bytes have a piece (so nothing is unknown), and encoding alters no text but by
    one marker in front (probed on texts that the usual normalisations change).
    """
    if any(re.search(f"[^{MARK}]{MARK}", sp.id_to_piece(i)) for i in range(sp.get_piece_size())):
        return False
    if sum(sp.is_byte(i) for i in range(sp.get_piece_size())) < 256:
        return False
    for probe in ("a", " a", "a  b ", "ﬁ Ａ\t\n é", "　x \x00"):
        if sp.decode(sp.encode(probe, num_threads=1)) != probe:
            return False
    return sp.id_to_piece(sp.encode("a", num_threads=1)[0]).startswith(MARK)


class Chunks:
    """The table: chunk (as the argument for which encode() gives its ids) -> row of ``n``, ``ids`` and ``text``."""

    def __init__(self, sp):
        self.sp = sp
        self.lone = [sp.piece_to_id(MARK)]  # the empty chunk is one marker at the end of a text
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.bytes = 0
        self.n = np.zeros(0, np.int64)
        self.ids, self.text = pa.array([], pa.large_binary()), pa.array([], pa.large_binary())

    def at(self, chunks: list[bytes]) -> np.ndarray:
        """Rows of distinct chunks; those that the table lacks are segmented, each once."""
        if len(self.rows) > TABLE or self.bytes > TABLE_BYTES:
            self.clear()
        rows = self.rows
        new = [c for c in chunks if c not in rows]
        if new:
            n, ids, text = [], [], []
            for a in range(0, len(new), 4096):
                part = [c.decode() for c in new[a : a + 4096]]
                got = [g or self.lone for g in self.sp.encode(part, num_threads=1)]
                n += map(len, got)
                ids += [str(g)[1:-1].replace(" ", "").encode() for g in got]
                # decode() drops the marker that encode() put in front, and with it the chunk's own first space
                text += [t.encode() for t in self.sp.decode(got, num_threads=1)]
            rows.update(zip(new, range(len(rows), len(rows) + len(new))))
            self.bytes += sum(map(len, ids)) + sum(map(len, text)) + sum(map(len, new)) + 150 * len(new)
            self.n = np.concatenate([self.n, np.array(n, np.int64)])
            self.ids = pa.concat_arrays([self.ids, pa.array(ids, pa.large_binary())])
            self.text = pa.concat_arrays([self.text, pa.array(text, pa.large_binary())])
        return np.fromiter(map(rows.__getitem__, chunks), np.int64, len(chunks))


def cut(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each chunk of the (non-empty) texts starts, and the first chunk of each text.

    A space after another character of its text separates: the chunk before ends
    there, and the next one begins with it.
    """
    space = data == 0x20
    sep = np.zeros(len(data), bool)
    sep[1:] = space[1:] & ~space[:-1]
    sep[off[:-1]] = True
    start = np.flatnonzero(sep)
    return start, np.searchsorted(start, off[:-1])


def encode_texts(texts: pa.Array, state: Chunks):
    """Number of ids, hash of the ids and hash of the decoded text of every text."""
    n = np.zeros(len(texts), np.int64)
    ids_hash, text_hash = np.full(len(texts), _EMPTY, object), np.full(len(texts), _EMPTY, object)
    data, off = X.buffers(texts)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        if MARK.encode() in memoryview(np.ascontiguousarray(data)).tobytes():
            # the library reads a marker as a space
            data, off = X.buffers(pc.replace_substring(texts.fill_null(""), MARK, " "))
        bounds = np.append(off[full], off[-1])  # empty texts have no bytes
        start, first = cut(data, bounds)
        ends = np.append(start, len(data))
        raw = np.ascontiguousarray(data)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
        opening = np.zeros(len(start), bool)
        opening[first] = True
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        index = coded.indices.to_numpy()
        # the chunk that opens a text has no separator; every other one stands for a separator and the rest
        later = np.unique(index[~opening])
        heads = [chunks[i].as_py() for i in first]
        wanted = dict.fromkeys([*heads, *[distinct[i][1:] for i in later]])
        place = dict(zip(wanted, state.at(list(wanted))))
        row_of = np.zeros(len(distinct), np.int64)
        row_of[later] = [place[distinct[i][1:]] for i in later]
        row = row_of[index]
        row[first] = [place[h] for h in heads]
        cuts = np.append(first, len(start))
        n[full] = np.add.reduceat(state.n[row], first)
        # a few MB at a time, whole texts each
        size = np.cumsum(np.diff(ends))
        a = 0
        while a < len(full):
            b = max(a + 1, int(np.searchsorted(size[cuts[a + 1 :] - 1], (size[cuts[a] - 1] if cuts[a] else 0) + PART, side="right")) + a)
            lists, taken = pa.array(cuts[a : b + 1] - cuts[a], pa.int64()), pa.array(row[cuts[a] : cuts[b]])
            for out, column, glue in ((ids_hash, state.ids, b","), (text_hash, state.text, b" ")):
                joined = pc.binary_join(pa.LargeListArray.from_arrays(lists, column.take(taken)), pa.scalar(glue, pa.large_binary()))
                ends_at = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1]
                view = memoryview(joined.buffers()[2])
                out[full[a:b]] = [hashlib.sha256(view[x:y]).hexdigest() for x, y in zip(ends_at[:-1].tolist(), ends_at[1:].tolist())]
            a = b
    return [n, pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]


PART = 4 << 20
_EMPTY = hashlib.sha256(b"").hexdigest()


def encode(docs: DataFrame, model: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``OUT`` beside carried columns (see ``map_text``) for every whole text.

    ``model`` is the path of a model file that every executor has.
    """

    tables: list[Chunks | None] = []  # every task gets its own copy of this list, and with it its own table

    def run(texts):
        if not tables:
            sp = load(model)
            tables.append(Chunks(sp) if chunkable(sp) else None)
        return encode_texts(texts, tables[0]) if tables[0] else encode_whole(texts, model)

    return map_text(docs, text, carry, fields(OUT), run)


def encode_whole(texts: pa.Array, model: str):
    """The same columns from whole texts, for models that ``chunkable`` refuses; also what tests compare with."""
    sp = load(model)
    rows = [sp.encode(t or "", num_threads=1) for t in texts.to_pylist()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return [
        np.array([len(r) for r in rows], np.int64),
        pa.array([sha(",".join(map(str, r)).encode()) for r in rows], pa.string()),
        pa.array([sha(sp.decode(r).encode()) for r in rows], pa.string()),
    ]
