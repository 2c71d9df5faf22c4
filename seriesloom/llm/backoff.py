"""Language-model scoring with a weighted backoff automaton.

The model is a trigram model with Dirichlet smoothing:

    P(w)       = (c(w) + 0.5) / (N + 0.5 (V + 1))
    P(w | h)   = (c(h w) + KAPPA P(w)) / (c(h) + KAPPA)
    P(w | g h) = (c(g h w) + KAPPA P(w | h)) / (c(g h) + KAPPA)

As an automaton every history of up to two words that occurs in training is a state, the
empty one the root.  A seen n-gram is an arc that weighs log10 P(w | history); from a state without an arc for a
word its failure arc, log10 KAPPA / (c(history) + KAPPA), leads to the history without its first word; the
root has an arc for every word.  The next state is the longest history
that is one.  A text runs through it once, from left to right and from the start state to the arc of the end token.

No task holds the whole automaton.  Documents are dealt into blocks of a few MB; a block asks
for the n-grams that occur in it and gets just the part of the automaton that its
texts can reach.  N-grams travel as sorted keys packed in binary columns,
by shard of the key space: shards add up the counts of all blocks and answer each
block in the order it asked, so one key is one entry per block however frequent
it is, and answers carry no keys.  A block sends to the shards that it has keys for only, so messages never
outnumber keys, and all work is linear in the corpus.  Keys have 20 bits more than it takes to number the corpus's bytes
(64 at most), so about one n-gram in a million shares its key with another.

Defined results: a null or empty text is one end token.  Unknown words weigh
P(w) with c(w) = 0.  With no training document every token has P = 1 / 1.  Texts of any length are
read whole; repeated rows count as often as they occur and get equal rows; there are no ties; an empty table gives an empty table; other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm import textops as X
from seriesloom.llm.common import bounded, keep, release, tidy

KAPPA = 8.0
ROWS = 3072  # documents in a block
LONG = 1 << 15  # bytes; blocks of longer texts hold fewer, in proportion
HELD = 6  # parts of a block, of a few MB each, whose tokens are kept between the two steps of a traversal
SHARD_BYTES = 4 << 20  # of text per shard of the key space
LEAST_SHARD_BITS = 8
_U = np.uint64
_START, _END = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)
OUT = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


class Tokens:
    """Keys of the tokens of some texts (words and an end each, in order) and of the n-grams that end in them."""

    def __init__(self, texts, width: int = 64):
        data, off = X.buffers(texts)
        words = X.scan(data, off, X.SPACED)
        n = words.counts()
        docs = len(n)
        start = words.at[:-1] + 2 * np.arange(docs)  # where each text's start stands
        seq = np.empty(len(words.hash) + 2 * docs, _U)
        seq[np.arange(len(words.hash)) + 2 * words.docs() + 1] = words.hash
        seq[start] = _START
        seq[start + n + 1] = _END
        real = np.ones(len(seq), bool)
        real[start] = False
        at = np.flatnonzero(real)
        self.n = n + 1
        self.doc = np.repeat(np.arange(docs), self.n)
        self.first = np.cumsum(self.n) - self.n  # the first token of each text; it has no trigram
        cut = _U(64 - width)
        pair = X.mix(seq[at - 1] * _U(0xC2B2AE3D27D4EB4F) + X.mix(seq[at]) + _U(0x2545F4914F6CDD1D))
        triple = X.mix(pair + X.mix(seq[np.maximum(at, 2) - 2] * _U(0x9FB21C651E98DF25) + _U(0x165667B19E3779F9)))
        self.word = X.mix(seq[at] + _U(0x9E3779B97F4A7C15)) >> cut << cut
        self.pair = pair >> cut << cut
        self.triple = np.delete(triple, self.first) >> cut << cut

    def keys(self) -> np.ndarray:
        return np.concatenate([self.word, self.pair, self.triple])


def wide(a: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs; the first byte tells the width."""
    w = 1 if not len(a) or a.max() < 1 << 8 else 2 if a.max() < 1 << 16 else 4 if a.max() < 1 << 32 else 8
    return bytes([w]) + a.astype(f"<u{w}").tobytes()


def narrow(b: bytes) -> np.ndarray:
    """The counts, as 32-bit numbers where those do."""
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64 if b[0] == 8 else np.uint32)


def pack(keys: np.ndarray, skip: int, width: int) -> bytes:
    """Bytes ``skip`` to ``width`` of keys, byte by byte of all keys: the shard implies those before, and none follow."""
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, skip:width].T.tobytes()


def unpack(b: bytes, skip: int, width: int, top: int) -> np.ndarray:
    """The keys, of which the first ``skip`` bytes are ``top``."""
    out = np.zeros((len(b) // (width - skip), 8), np.uint8)
    out[:, skip:width] = np.frombuffer(b, np.uint8).reshape(width - skip, -1).T
    keys = out.view(">u8").ravel().astype(_U)
    return keys | _U(top << (64 - 8 * skip)) if skip else keys


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of n over each."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[at], np.add.reduceat(n[order], at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)


def requests(bits: int, width: int):
    """Arrow function: (block, train, text) -> (shard, block, keys, train counts, which keys are words)."""

    def flush(block, parts):
        keys = np.concatenate([p[0] for p in parts])
        n = np.concatenate([p[1] for p in parts])
        word = np.concatenate([p[2] for p in parts])
        uniq, total = summed(keys, n)
        kind = np.zeros(len(uniq), bool)
        kind[np.searchsorted(uniq, keys[word])] = True
        shard = (uniq >> _U(64 - bits)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
        cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        arrays = [
            pa.array(shard[edges[:-1]], pa.int32()), pa.array([block] * len(cuts), pa.int64()), pa.array([pack(uniq[a:b], bits // 8, width // 8) for a, b in cuts], pa.binary()),
            pa.array([wide(total[a:b]) for a, b in cuts], pa.binary()), pa.array([np.packbits(kind[a:b]).tobytes() for a, b in cuts], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["shard", "block", "keys", "counts", "words"])

    def run(batches):
        waiting: dict[int, list] = {}
        for batch in batches:
            for at, texts in X.pieces(batch.column(2)):
                block = batch.column(0).slice(at, len(texts)).to_numpy(zero_copy_only=False)
                train = batch.column(1).slice(at, len(texts)).to_numpy(zero_copy_only=False).astype(bool)
                order = np.argsort(block, kind="stable")
                edges = np.flatnonzero(np.concatenate([[True], block[order][1:] != block[order][:-1], [True]]))
                here = {int(block[order[a]]): order[a:b] for a, b in zip(edges[:-1], edges[1:])}
                # a block's rows are near each other; what is sent in parts the shard adds up
                for k in [k for k in waiting if k not in here]:
                    yield flush(k, waiting.pop(k))
                for k, mine in here.items():
                    t = Tokens(texts.take(pa.array(mine)), width)
                    n = train[mine][t.doc].astype(np.int64)
                    # add up within a few MB at a time, so that a block's parts stay small
                    some = [summed(key, x) for key, x in ((t.word, n), (t.pair, n), (t.triple, np.delete(n, t.first)))]
                    waiting.setdefault(k, []).append((np.concatenate([key for key, _ in some]), np.concatenate([x for _, x in some]), np.concatenate([np.full(len(key), not i) for i, (key, _) in enumerate(some)])))
        for k, parts in waiting.items():
            yield flush(k, parts)

    return run


def answers(bits: int, width: int):
    """Arrow function of one shard: every block's counts replaced by the sums over all blocks, and the shard's totals."""

    def run(key, table):
        shard = key[0].as_py()
        blocks = table.column("block").to_numpy()
        keys = [unpack(k, bits // 8, width // 8, shard >> (bits % 8)) for k in table.column("keys").to_pylist()]
        counts = [narrow(c) for c in table.column("counts").to_pylist()]
        words = [np.unpackbits(np.frombuffer(w, np.uint8), count=len(k)).astype(bool) for w, k in zip(table.column("words").to_pylist(), keys)]
        uniq, total = summed(np.concatenate(keys), np.concatenate(counts))
        word = np.zeros(len(uniq), bool)
        for k, w in zip(keys, words):
            word[np.searchsorted(uniq, k[w])] = True
        out = {"block": [None], "shard": [shard], "counts": [b""], "types": [int((word & (total > 0)).sum())], "tokens": [int(total[word].sum())]}
        order = np.argsort(blocks, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], blocks[order][1:] != blocks[order][:-1], [True]]))
        for a, b in zip(edges[:-1], edges[1:]):
            # a block may have asked in several parts
            mine = np.unique(np.concatenate([keys[i] for i in order[a:b]])) if b - a > 1 else keys[order[a]]
            out["block"].append(int(blocks[order[a]]))
            out["shard"].append(shard)
            out["counts"].append(wide(total[np.searchsorted(uniq, mine)]))
            out["types"].append(None)
            out["tokens"].append(None)
        return pa.table(out, schema=pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("counts", pa.binary()), ("types", pa.int64()), ("tokens", pa.int64())]))

    return run


class Found:
    """The tokens of some texts, their keys as places among the distinct ones in order."""

    def __init__(self, texts, width: int):
        t = Tokens(texts, width)
        self.n, self.doc, self.first = t.n, t.doc.astype(np.int32), t.first
        self.uniq, at = np.unique(t.keys(), return_inverse=True)
        self.at = at.astype(np.int32)
        self.place = None

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where the distinct keys stand among ``keys``; they are let go."""
        if self.place is None:
            self.place, self.uniq = np.searchsorted(keys, self.uniq).astype(np.int32), None
        return self.place


class Automaton:
    """The part of the automaton that some texts can reach: counts of their n-grams, by key in order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, n: int, v: int, kappa: float = KAPPA):
        self.keys, self.counts, self.n, self.v, self.kappa = keys, counts, n, v, kappa

    def run(self, t: Found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every token whether it is known, its weight at the root, and what the traversal adds up at it.

        A state is a suffix of what was read, so the states of all tokens are known at once, and all
        tokens take their arcs together: at each order those without one take the failure arc instead and go on an order below.
        """
        c = self.counts[t.places(self.keys)][t.at].astype(np.int64)
        m = len(t.doc)
        inner = np.delete(np.arange(m), t.first)
        seen = [c[:m], c[m : 2 * m], np.zeros(m, np.int64)]  # the n-gram that ends in a token, by order
        seen[2][inner] = c[2 * m :]
        # how often the histories before a token occur: the start occurs as often as the end
        before = [np.full(m, self.n), np.empty(m, np.int64), np.zeros(m, np.int64)]
        before[1][1:] = seen[0][:-1]
        before[1][t.first] = seen[0][t.first + t.n - 1]
        before[2][inner] = seen[1][inner - 1]
        p = (seen[0] + 0.5) / (self.n + 0.5 * (self.v + 1))
        arc = [np.log10(p)]
        for order in (1, 2):
            p = (seen[order] + self.kappa * p) / (before[order] + self.kappa)
            arc.append(np.log10(p))
        weight = np.zeros(m)
        state = np.where(before[2] > 0, 2, np.where(before[1] > 0, 1, 0))
        left = np.arange(m)
        for order in (2, 1):
            here = state[left] == order
            found = here & (seen[order][left] > 0)
            weight[left[found]] += arc[order][left[found]]
            fails = left[here & ~found]
            weight[fails] += np.log10(self.kappa / (before[order][fails] + self.kappa))
            state[fails] = order - 1
            left = left[~found]
        weight[left] += arc[0][left]
        return seen[0] > 0, arc[0], weight


def traverse(texts, counts: np.ndarray, n: int, v: int, width: int = 64, kappa: float = KAPPA):
    """Columns of ``OUT`` for texts, given the counts of their distinct keys in order.

    Goes over the texts a few MB at a time, first for the keys and then to score.
    """
    parts = [part for _, part in X.pieces(texts)]
    held = [Found(part, width) for part in parts[:HELD]]
    rest = [np.unique(Tokens(part, width).keys()) for part in parts[HELD:]]
    some = [t.uniq for t in held] + rest
    keys = some[0] if len(some) == 1 else np.unique(np.concatenate(some)) if some else np.zeros(0, _U)
    del some, rest
    if len(keys) != len(counts):
        raise ValueError(f"a block has {len(keys)} keys and got {len(counts)} counts")
    machine = Automaton(keys, counts, n, v, kappa)
    for t in held:
        t.places(keys)
    out = []
    for i, part in enumerate(parts):
        t = held[i] if i < HELD else Found(part, width)
        if i < HELD:
            held[i] = None
        known, root, weight = machine.run(t)
        docs = len(t.n)
        out.append((t.n.astype(np.int64), np.bincount(t.doc, known, docs).astype(np.int64), np.full(docs, n, np.int64), np.bincount(t.doc, root, docs), np.bincount(t.doc, weight, docs)))
    return [np.concatenate(c) if out else np.zeros(0) for c in (zip(*out) if out else [()] * 5)]


def block_of(docs: DataFrame, text: str = "text", rows: int = ROWS) -> Column:
    """Blocks of neighbouring rows of a file, for tables read from Parquet: of ``rows`` texts, or fewer if they are long."""
    meta = docs.metadataColumn("_metadata")
    at = meta["row_index"]
    longer = F.floor(F.log2(F.greatest(F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(LONG)) / LONG)).cast("bigint")
    return F.xxhash64(meta["file_path"], F.floor(at / rows), longer, F.pmod(F.xxhash64(at), F.expr("1L") * F.pow(F.lit(2), longer).cast("bigint")))


def sizes(docs: DataFrame, text: str) -> tuple[int, int]:
    """Bits that tell a shard, and bits of a key (whole bytes), for the bytes of the texts."""
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("bigint"))).first()[0] or 0
    bits = max(LEAST_SHARD_BITS, int(total // SHARD_BYTES).bit_length())
    return bits, min(64, max(40, -8 * (-(int(total).bit_length() + 20) // 8)))


def score(docs: DataFrame, train: Column, block: Column, text: str = "text", key: str = "doc_id", kappa: float = KAPPA) -> DataFrame:
    """``key``, ``train`` and ``OUT`` for every row of ``docs``; rows where ``train`` holds are learnt from.

    ``block`` must depend on nothing but the row; any choice gives the same
    scores, and rows that are near each other in the input should share one.
    """
    bounded(docs.sparkSession)
    bits, width = sizes(docs, text)
    src = docs.select(block.alias("block"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).cast("string").alias("text"), F.col(key).alias("key"))
    asked = src.select("block", "train", "text").mapInArrow(tidy(requests(bits, width)), "shard int, block bigint, keys binary, counts binary, words binary")
    told = keep(asked.groupBy("shard").applyInArrow(answers(bits, width), "block bigint, shard int, counts binary, types bigint, tokens bigint"), "backoff")
    v, n = told.filter("block is null").agg(F.sum("types"), F.sum("tokens")).first()
    v, n = int(v or 0), int(n or 0)
    schema = T.StructType([src.schema["key"], T.StructField("train", T.BooleanType()), *T._parse_datatype_string(OUT).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(_, left, right):
        if not left.num_rows:
            return arrow.empty_table()
        order = np.argsort(right.column("shard").to_numpy(), kind="stable")
        blobs = right.column("counts").to_pylist()
        counts = np.concatenate([narrow(blobs[i]) for i in order]) if len(order) else np.zeros(0, np.int64)
        new = traverse(left.column("text").combine_chunks(), counts, n, v, width, kappa)
        out = pa.table([left.column("key"), left.column("train"), *[pa.array(x) for x in new]], names=arrow.names)
        release()
        return out

    replies = told.filter("block is not null").select("block", "shard", "counts")
    out = src.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)
    return out.withColumnRenamed("key", key)


def sql(train: str, held: str, kappa: float = KAPPA) -> str:
    """The same rows in DuckDB SQL, from plain counts; ``train`` and ``held`` are conditions on ``documents``."""
    low = "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH d AS (SELECT doc_id, ({train}) AS train, ({held}) AS held_out,
    list_concat(regexp_extract_all(translate(coalesce(text, ''), '{low.upper()}', '{low}'), '[^\\x20\\x09-\\x0D]+'), [' ']) AS ws FROM documents),
t AS (SELECT doc_id, train, held_out, i, ws[i] AS w, CASE WHEN i = 1 THEN '  ' ELSE ws[i - 1] END AS h, CASE WHEN i = 2 THEN '  ' WHEN i > 2 THEN ws[i - 2] END AS g
  FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM d)),
c1 AS (SELECT w, count(*) AS c FROM t WHERE train GROUP BY 1),
c2 AS (SELECT h, w, count(*) AS c FROM t WHERE train GROUP BY 1, 2),
c3 AS (SELECT g, h, w, count(*) AS c FROM t WHERE train AND g IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM c1),
x AS (SELECT t.doc_id, t.held_out, coalesce(c1.c, 0) AS k, (coalesce(c1.c, 0) + 0.5) / (s.n + 0.5 * (s.v + 1)) AS p1, coalesce(c2.c, 0) AS k2,
    coalesce(h1.c, 0) AS n2, coalesce(c3.c, 0) AS k3, coalesce(h2.c, 0) AS n3, s.n AS n
  FROM t CROSS JOIN s LEFT JOIN c1 ON t.w = c1.w LEFT JOIN c2 ON t.h = c2.h AND t.w = c2.w LEFT JOIN c3 ON t.g = c3.g AND t.h = c3.h AND t.w = c3.w
  LEFT JOIN c1 h1 ON h1.w = CASE WHEN t.h = '  ' THEN ' ' ELSE t.h END LEFT JOIN c2 h2 ON t.g = h2.h AND t.h = h2.w),
y AS (SELECT *, (k2 + {kappa} * p1) / (n2 + {kappa}) AS p2 FROM x)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE k > 0) AS n_known, max(n) AS train_tokens,
  round(sum(log10(p1)), 6) AS base_score, round(sum(log10((k3 + {kappa} * p2) / (n3 + {kappa}))), 6) AS score
FROM y GROUP BY doc_id, held_out"""
