"""Benchmark decontamination by winnowing.

Words are compared by 64-bit hashes.  Runs of ``K`` words are fingerprinted; of
every ``WINDOW - K + 1`` consecutive runs the smallest hash is kept (all of them
on ties), on both sides.  A shared span of ``WINDOW`` words therefore shares a
kept fingerprint.  Items with fewer words than that are one window each, with the hash of
the whole item as fingerprint.

The fingerprints of documents and items are joined; before that a bitmap of the items'
fingerprints (at most 2**``BITS`` bits, so its broadcast is bounded) leaves out nearly all of the documents'.
Documents that share one are extended over the items they share it with: every window
of theirs that the item has is a hit, so the hits are the longest common spans of at
least ``WINDOW`` words, and repeated words cost no more than others.  A document is read
twice however large the benchmark is, and only those with a shared
fingerprint are written, dealt by document and item, and merged.

Defined results: a null or empty document has no words and no hits; a null item
or one without words has no window; an item whose id is null marks words but is
not listed; repeated item ids count once; texts and items of any length are read whole;
repeated rows get equal rows; an empty table of documents gives an empty table, an empty benchmark
no hits; other columns, whatever their names, are carried as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm import textops as X
from seriesloom.llm.common import bounded, fields, keep, map_text, tidy

K = 5
WINDOW = 8
BITS = 27
ITEMS = 4096  # of one document that are looked at in one group
BIN = 4 << 20  # bytes of documents that are looked at in one group
OUT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, item_ids array<string>, spans array<bigint>"
_U = np.uint64


def winnow(h: np.ndarray, docs: np.ndarray, w: int) -> np.ndarray:
    """Which fingerprints are the least of some w consecutive ones of their text."""
    n = len(h)
    if n < w:
        return np.zeros(n, bool)
    least = h[: n - w + 1].copy()
    for d in range(1, w):
        np.minimum(least, h[d : n - w + 1 + d], out=least)
    whole = docs[: n - w + 1] == docs[w - 1 :]
    picked = np.zeros(n, bool)
    for d in range(w):
        picked[d : n - w + 1 + d] |= whole & (h[d : n - w + 1 + d] == least)
    return picked


def runs(words: X.Spans, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (apart for each k), text and first word of all runs of k words."""
    h, docs, first = X.windows(words, k)
    return X.mix(h + _U(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)), docs, first


def fingerprints(words: X.Spans, wanted=None, short=range(1, WINDOW)) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of winnowed runs, and of all runs of each length in ``short``; of those that ``wanted`` lets through, if given."""
    h, docs, _ = runs(words, K)
    at = np.arange(len(h)) if wanted is None else np.flatnonzero(wanted(h))
    at = at[winnow(h, docs, WINDOW - K + 1)[at]] if len(at) else at
    found = [(docs[at], h[at])]
    for k in short:
        h, docs, _ = runs(words, k)
        # apart from the winnowed runs of as many words
        h = X.mix(h ^ _U(0x5DEECE66D))
        at = np.arange(len(h)) if wanted is None else np.flatnonzero(wanted(h))
        found.append((docs[at], h[at]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def item_prints(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (item, hash) of some items, and the length of those found whole (0 for winnowed runs)."""
    words = X.scan(*X.buffers(texts), X.ALNUM)
    n = words.counts()
    out = []
    for k in range(WINDOW):
        docs, h = fingerprints(words, short=[k] if k else [])
        mine = n[docs] >= WINDOW if k == 0 else n[docs] == k
        if k:
            mine &= np.arange(len(h)) >= len(h) - len(X.windows(words, k)[0])  # without the winnowed ones
        out.append(np.stack([docs[mine], np.full(mine.sum(), k), h[mine].view(np.int64)], axis=1))
    out = np.unique(np.concatenate(out), axis=0)
    return out[:, 0], out[:, 2], out[:, 1]


class Index:
    """Windows of some items."""

    def __init__(self, ids: list[str | None], texts: list[str]):
        words = X.scan(*X.buffers(pa.array(texts, pa.large_string())), X.ALNUM)
        n = words.counts()
        self.ids, self.of = ids, {}
        for k in range(1, WINDOW + 1):
            h, docs, _ = runs(words, k)
            mine = n[docs] >= k if k == WINDOW else n[docs] == k
            if mine.any():
                rows = np.unique(np.stack([h[mine], docs[mine].astype(_U)], axis=1), axis=0)
                self.of[k] = rows[:, 0], rows[:, 1].astype(np.int64)

    def look(self, words: X.Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are inside a window of an item; distinct (text, item) of texts with one."""
        cover = np.zeros(len(words.hash) + 1, np.int64)
        pairs = [np.zeros((0, 2), np.int64)]
        for k, (key, item) in self.of.items():
            h, docs, first = runs(words, k)
            lo = np.searchsorted(key, h, "left")
            at = np.flatnonzero(key[np.minimum(lo, len(key) - 1)] == h)
            np.add.at(cover, first[at], 1)
            np.add.at(cover, first[at] + k, -1)
            # a window that a text repeats tells its items once
            one = np.unique(np.stack([docs[at], lo[at]], axis=1), axis=0)
            n = np.searchsorted(key, key[one[:, 1]], "right") - one[:, 1]
            which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(one[:, 1], n)
            pairs.append(np.unique(np.stack([np.repeat(one[:, 0], n), item[which]], axis=1), axis=0))
        both = np.unique(np.concatenate(pairs), axis=0)
        return np.cumsum(cover[:-1]) > 0, both[:, 0], both[:, 1]


def find(texts, index: Index) -> list:
    """Number of words, spans (first word, word after the last, ...) and item ids of whole texts."""
    data, off = X.buffers(texts)
    words = X.scan(data, off, X.ALNUM)
    n = len(off) - 1
    hit, doc, item = index.look(words)
    names: list[set] = [set() for _ in range(n)]
    for d, k in zip(doc.tolist(), item.tolist()):
        if index.ids[k] is not None:
            names[d].add(index.ids[k])
    edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
    inner = words.at[1:-1]
    inner = inner[(inner > 0) & (inner < len(hit))]
    both = np.unique(inner[hit[inner - 1] & hit[inner]]) if len(hit) else inner  # spans that end where a text ends
    starts = np.sort(np.concatenate([np.flatnonzero(edge == 1), both]))
    ends = np.sort(np.concatenate([np.flatnonzero(edge == -1), both]))
    of = np.searchsorted(words.at, starts, side="right") - 1
    spans: list[list[int]] = [[] for _ in range(n)]
    for d, s, e in zip(of.tolist(), starts.tolist(), ends.tolist()):
        spans[d] += [s - int(words.at[d]), e - int(words.at[d])]
    return [words.counts().astype(np.int64), pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(x) for x in names], pa.list_(pa.string()))]


def union(spans: list[int]) -> list[int]:
    """Spans in order, those that overlap or touch made one."""
    out: list[int] = []
    for lo, hi in sorted(zip(spans[::2], spans[1::2])):
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += [lo, hi]
    return out


def bitmap(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Three bits for each fingerprint ``h``; at most 2**BITS in all."""
    bits = min(BITS, max(22, (64 * max(1, prints.count())).bit_length()))
    mask = (1 << bits) - 1
    places = [f"shiftrightunsigned(h, {64 - bits})", f"shiftrightunsigned(h, 10) & {mask}L", f"(shiftrightunsigned(h, 3) ^ shiftrightunsigned(h, 33)) & {mask}L"]
    at = prints.select(F.explode(F.array(*map(F.expr, places))).alias("p"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in at.groupBy(F.expr("p div 32768").alias("b")).agg(F.expr("bitmap_construct_agg(p % 32768)").alias("m")).collect():
        out[r.b * 4096 : (r.b + 1) * 4096] |= np.frombuffer(r.m, np.uint8)
    return bits, out


def _wanted(bits: int, table: np.ndarray):
    """Which hashes have all their bits in the bitmap."""
    mask = _U((1 << bits) - 1)

    def bit(at):
        at = at.astype(np.int64)
        return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def wanted(h):
        out = bit(h >> _U(64 - bits))
        some = np.flatnonzero(out)
        x = h[some]
        out[some] = bit(x >> _U(10) & mask) & bit((x >> _U(3) ^ x >> _U(33)) & mask)
        return out

    return wanted


def _mark(door, short):
    """Arrow function: (carried, text_in) -> (carried, text_in where there is a fingerprint, n_words, cands)."""

    def run(batches):
        wanted = _wanted(*door.value)
        for batch in batches:
            for at, part in X.pieces(batch.column(1)):
                words = X.scan(*X.buffers(part), X.ALNUM)
                docs, h = fingerprints(words, wanted, short)
                rows = np.unique(np.stack([docs.astype(_U), h], axis=1), axis=0)
                cuts = np.searchsorted(rows[:, 0], np.arange(len(part) + 1).astype(_U))
                cands = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(rows[:, 1].view(np.int64) if len(rows) else np.zeros(0, np.int64)))
                texts = pa.array([part[i].as_py() if a < b else None for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()))], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), texts, pa.array(words.counts().astype(np.int64)), cands], ["carried", "text_in", "n_words", "cands"])

    return run


def _extend(_, left, right):
    """One group: spans and item ids of some documents (uid, text_in) from some items (id, t)."""
    left, right = left.combine_chunks(), right.combine_chunks()
    if not left.num_rows or not right.num_rows:
        return pa.table({"uid": pa.array([], pa.int64()), "spans": pa.array([], pa.list_(pa.int64())), "item_ids": pa.array([], pa.list_(pa.string()))})
    index = Index(right.column("id").to_pylist(), right.column("t").to_pylist())
    texts = left.column("text_in")
    out = find(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, index)
    return pa.table({"uid": left.column("uid"), "spans": out[1], "item_ids": out[2]})


def _merge(batches):
    for batch in batches:
        spans = [union(x) for x in batch.column(1).to_pylist()]
        n = [sum(x[1::2]) - sum(x[::2]) for x in spans]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(2), pa.array(spans, pa.list_(pa.int64()))], ["uid", "n_hit", "item_ids", "spans"])


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``OUT`` beside carried columns (or a struct column ``row`` with all) for every whole document."""
    spark = docs.sparkSession
    bounded(spark)
    kept = [F.struct("*").alias("row")] if carry is None else [F.col(c) for c in carry]
    items = benchmark.select(F.col(item).cast("string").alias("id"), F.col(item_text).cast("string").alias("t")).filter("t is not null").distinct()
    # numbers are given where rows are written, and read from there
    items = keep(items.withColumn("item", F.monotonically_increasing_id()), "items")

    def printed(batches):
        for batch in batches:
            for at, part in X.pieces(batch.column(1)):
                who, h, k = item_prints(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)).take(pa.array(who)), pa.array(h), pa.array(k.astype(np.int32))], ["item", "h", "k"])

    prints = keep(items.select("item", "t").mapInArrow(tidy(printed), "item bigint, h bigint, k int"), "prints")
    short = [r.k for r in prints.select("k").distinct().collect() if r.k]
    door = spark.sparkContext.broadcast(bitmap(prints))
    src = docs.select(F.struct(*kept).alias("carried"), F.col(text).cast("string").alias("text_in"))
    schema = T.StructType([*src.schema.fields, *fields("n_words bigint, cands array<bigint>").fields])
    marked = src.mapInArrow(tidy(_mark(door, short)), schema)
    few = keep(marked.filter("size(cands) > 0").withColumn("uid", F.monotonically_increasing_id()), "marked")
    none = F.array().cast("array<string>")
    rest = marked.filter("size(cands) = 0").select("carried", "n_words", F.lit(0).cast("bigint").alias("n_hit"), none.alias("item_ids"), F.array().cast("array<bigint>").alias("spans"))
    n, size = few.agg(F.count("*"), F.sum(F.octet_length("text_in"))).first()
    if n:
        hits = few.select("uid", F.explode("cands").alias("h")).join(prints.select("h", "item"), "h").select("uid", "item").distinct()
        per = hits.groupBy("uid").agg(F.ceil(F.count("*") / ITEMS).cast("bigint").alias("chunks"))
        hits = keep(hits.join(per, "uid").select("uid", "item", F.pmod(F.xxhash64("uid", F.pmod(F.xxhash64("item"), "chunks")), F.lit(max(1, size // BIN))).alias("g")), "hits")
        left = few.select("uid", "text_in").join(hits.select("uid", "g").distinct(), "uid").select("g", "uid", "text_in")
        right = hits.select("item", F.col("g").alias("b")).distinct().join(items, "item").select("b", "id", "t")
        found = left.groupBy("g").cogroup(right.groupBy("b")).applyInArrow(_extend, "uid bigint, spans array<bigint>, item_ids array<string>")
        found = found.groupBy("uid").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
        merged = found.select("uid", "spans", "item_ids").mapInArrow(_merge, "uid bigint, n_hit bigint, item_ids array<string>, spans array<bigint>")
        seen = few.select("uid", "carried", "n_words").join(merged, "uid", "left")
        rest = rest.unionByName(seen.select("carried", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("spans", F.array().cast("array<bigint>")).alias("spans")))
    ids = F.col("item_ids")
    return rest.select("carried.*", "n_words", "n_hit", F.size(ids).cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), "item_ids", "spans")


def contaminated(least: int = 2):
    """Documents in which windows of so many items occur."""
    return F.col("n_items") >= least


def filter_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", items: int = 2, shortest: int = 0, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` with windows of fewer than ``items`` items, with their own columns.

    Items of fewer than ``shortest`` words do not count.  With ``items`` = 1 any window does, that of an item without id too.
    """
    if shortest:

        def count(texts):
            data, off = X.buffers(texts)
            return [X.scan(data, off, X.ALNUM).counts().astype(np.int64)]

        counted = map_text(benchmark, item_text, [item, item_text], fields("item_words bigint"), count)
        benchmark = counted.filter(F.col("item_words") >= shortest).drop("item_words")
    hit = F.col("n_hit") > 0 if items == 1 else contaminated(items)
    return scan(docs, benchmark, text, item, item_text).filter(~hit).select("row.*")
