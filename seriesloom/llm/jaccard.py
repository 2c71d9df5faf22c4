"""N-gram Jaccard self-join: size-aware, heavy and light.

Documents with equal shingle sets form a class; one member stands for all.

*Light* sets (at most ``boundary`` shingles) give every subset of theirs that may
be the common part with a similar set: all subsets of fixed sizes n, n - 1, ...
down to the least overlap.  *Heavy* sets are entered in inverted lists under
their rarest shingles (as many as a similar set cannot all lack).  Light sets
that a heavy set may resemble are in the lists too.  The boundary is where
subsets begin to cost more than lists, from the sizes of the corpus's sets and the
lengths of the lists that its shingles would have.

Keys go to the lists packed, many in a row, with the set's size: a list falls into runs of sizes that two
similar sets may have, and most of what chance puts into one list falls apart there, before anything longer is sent.
Runs (of lists or groups of one subset) of two classes or more are scanned; of runs with
the same members one is.  An entry carries the set's size and a signature of
``64 * WORDS`` bits, each the parity of the shingles that fall on it; sets of more than two
shingles a bit have longer ones (to ``64 * MOST_WORDS`` bits), which fold to shorter ones.
Sizes bound the overlap that two similar sets need, and the bits in which signatures differ bound
the overlap that they can have; what passes both is a candidate.  Were signatures of one length, those of
long texts would differ in fewer bits than similar sets may, and chance would connect a large corpus's long texts.  A scan walks
along candidates, so a group of near copies costs little more than one look at each
member, and documents that merely share a passage are not joined.  A list of more than ``LIST`` classes is cut
into chunks, and every pair of chunks becomes a group of its own.

What candidates connect is compared exactly: all overlaps within a connected part
are counted, as products of 0/1 matrices.  No similar pair crosses two parts.  Parts too large for one
task are cut like long lists, so no task holds a large group and no
pair is ever a row: only links that connect, and link counts, come out.

Order of shingles: by a sketch of document frequencies (2**SKETCH counters of four
bits, the same size for any corpus), then by hash.  Any order gives the same links; a good
one keeps common passages out of the lists.  Where a large corpus fills the
sketch, lists of common passages are scanned (and cut) instead of avoided.

Classes are told apart by 128-bit hashes of their sets, shingles by 64-bit hashes.

Defined results: a null text, or one without words, has no shingles and is its
own component with no links; a text of fewer than ``SIZE`` words is one shingle;
texts of any length are read whole; a null doc_id never names a component unless
nothing else can; repeated rows are linked like any equal texts; ties cannot arise
(a component is named by its least doc_id); an empty table gives an empty table;
other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm import textops as X
from seriesloom.llm.common import bounded, fields, forget, keep, map_text, release, tidy

SIZE = 4
LEAST = (85, 100)  # least similarity, as a fraction
SKETCH = 24
SLICES = 512
WORDS = 16  # of 64 bits, in the signature of a set of up to 128 * WORDS shingles
MOST_WORDS = 256  # of 64 bits, in any signature
LIST = 32_768  # classes of a list that are scanned in one group
SHORT = 16  # lists of up to so many classes are scanned many at a time
CHUNK, WEIGHT = 2048, 1 << 19  # classes, and shingles, that are compared in one group
FINE = 1024  # steps of the logarithm of a set's size, as it goes with a key
PACK, BIN = 1 << 20, 1 << 18  # keys that a task collects before it sends them on, and keys of one group
PART = 32_768  # members of a list in one row
BROADCAST = 500_000  # most rows of two numbers that are broadcast
MOST_LIGHT = 24  # no set with more shingles is light, whatever the costs
_U = np.uint64


def need(n, least=LEAST):
    """Least overlap of a set of n shingles with any set that is similar to it."""
    return -(-least[0] * n // least[1])


def similar(overlap, a, b, least=LEAST):
    return least[1] * overlap >= least[0] * (a + b - overlap)


def shingles(texts, size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return [s for _, part in X.pieces(texts) for s in _shingles(part, size)]


def _shingles(part, size):
    data, off = X.buffers(part)
    words = X.scan(data, off, X.SPACED)
    h, docs, first = X.windows(words, size)
    at = np.searchsorted(docs, np.arange(len(off)))
    n = words.counts()
    out = []
    for d in range(len(off) - 1):
        if n[d] >= size:
            out.append(np.unique(h[at[d] : at[d + 1]]))
        elif n[d]:
            one = words.hash[words.at[d] : words.at[d + 1]]
            x = np.array([n[d]], _U)
            for w in one:
                x = X.mix(x * _U(0xC2B2AE3D27D4EB4F) + w)
            out.append(x)
        else:
            out.append(np.zeros(0, _U))
    return out


def digest(s: np.ndarray) -> bytes:
    """128-bit name of a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signature(s: np.ndarray) -> bytes:
    """Bit b is the parity of the shingles that fall on it; two shingles a bit at most, where ``MOST_WORDS`` allow."""
    words = WORDS
    while 128 * words < len(s) and words < MOST_WORDS:
        words *= 2
    return np.packbits(np.bincount(((s >> _U(8)) & _U(64 * words - 1)).astype(np.int64), minlength=64 * words).astype(np.uint8) & 1).tobytes()


def folded(sigs: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """All signatures at ``WORDS`` words, and for every greater length (row of each set or -1, signatures of the sets that have so many words)."""
    words = np.array([len(x) // 8 for x in sigs], np.int64)
    out, fine = np.zeros((len(sigs), WORDS), _U), []
    longer, at = np.zeros((0, 2 * int(words.max(initial=WORDS))), _U), np.zeros(0, np.int64)
    while longer.shape[1] > WORDS:
        w = longer.shape[1] // 2
        own = np.flatnonzero(words == w)
        # bit b of a shorter signature is the parity of the bits b and b + its length
        bits = np.concatenate([longer[:, :w] ^ longer[:, w:], np.frombuffer(b"".join(sigs[i] for i in own), _U).reshape(-1, w)])
        longer, at = bits, np.concatenate([at, own])
        if w > WORDS:
            row = np.full(len(sigs), -1, np.int64)
            row[at] = np.arange(len(at))
            fine.append((row, bits))
    out[at] = longer
    return out, fine[::-1]


class Sketch:
    """How common a shingle is, from 0 to 15 on a logarithmic scale; two counters a byte."""

    def __init__(self, table: np.ndarray | None = None):
        self.table = np.zeros(1 << (SKETCH - 1), np.uint8) if table is None else table

    @staticmethod
    def bucket(h: np.ndarray) -> np.ndarray:
        return (h >> _U(64 - SKETCH)).astype(np.int64)

    @staticmethod
    def scale(n: np.ndarray) -> np.ndarray:
        return np.minimum(15, 1.5 * np.log2(1.0 + n)).astype(np.uint8)

    def of(self, h: np.ndarray) -> np.ndarray:
        b = self.bucket(h)
        return self.table[b >> 1] >> ((b & 1) << 2).astype(np.uint8) & np.uint8(15)


def gaps(at: np.ndarray) -> bytes:
    """Increasing places as bytes: the gap to the one before, 255 standing for 255 more."""
    d = np.diff(at, prepend=-1) - 1
    more = d // 255
    out = np.full(int(len(at) + more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = d % 255
    return out.tobytes()


def places(b: bytes) -> np.ndarray:
    x = np.frombuffer(b, np.uint8).astype(np.int64)
    ends = x < 255
    return (np.cumsum(x)[ends] + np.arange(1, int(ends.sum()) + 1)) - 1


def survey(docs: DataFrame, text: str = "text", size: int = SIZE) -> tuple[Sketch, dict[int, int]]:
    """The sketch, and how many sets of each small size there are, over every document.

    Tasks send the counters that they have raised, packed, by slice of the sketch.
    """
    width = (1 << SKETCH) // SLICES

    def count(batches):
        total, sizes = np.zeros(1 << SKETCH, np.uint8), np.zeros(MOST_LIGHT + 1, np.int64)
        for batch in batches:
            for _, part in X.pieces(batch.column(0)):
                data, off = X.buffers(part)
                words = X.scan(data, off, X.SPACED)
                n = words.counts()
                n = np.where(n < size, np.minimum(n, 1), n - size + 1)
                sizes += np.bincount(n[n <= MOST_LIGHT], minlength=MOST_LIGHT + 1)
                h, _, _ = X.windows(words, size)
                at = np.sort(Sketch.bucket(h))
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
                n, at = np.diff(first, append=len(at)), at[first]
                total[at] = np.minimum(255, total[at] + n)
        for s in range(SLICES):
            part = total[s * width : (s + 1) * width]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([gaps(at)], pa.binary()), pa.array([part[at].tobytes()], pa.binary())], ["slice", "at", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""], pa.binary()), pa.array([sizes.tobytes()], pa.binary())], ["slice", "at", "n"])

    def add(key, table):
        s = key[0].as_py()
        if s < 0:
            out = np.sum([np.frombuffer(n, np.int64) for n in table.column("n").to_pylist()], axis=0).tobytes()
        else:
            total = np.zeros(width, np.int64)
            for at, n in zip(table.column("at").to_pylist(), table.column("n").to_pylist()):
                total[places(at)] += np.frombuffer(n, np.uint8)
            q = Sketch.scale(total)
            out = (q[::2] | q[1::2] << 4).tobytes()
        return pa.table([pa.array([s], pa.int32()), pa.array([out], pa.binary())], names=["slice", "q"])

    counted = docs.select(F.col(text).cast("string")).mapInArrow(tidy(count), "slice int, at binary, n binary")
    out, sizes = Sketch(), {}
    for r in counted.groupBy("slice").applyInArrow(add, "slice int, q binary").collect():
        if r.slice < 0:
            sizes = dict(enumerate(np.frombuffer(r.q, np.int64).tolist()))
        else:
            out.table[r.slice * width // 2 : (r.slice + 1) * width // 2] = np.frombuffer(r.q, np.uint8)
    return out, sizes


def light_cost(n: int, least=LEAST) -> int:
    """Subsets that a light set of n shingles gives."""
    return sum(math.comb(n, k) for k in range(n - need(n, least) + 1))


def list_lengths(common: Sketch) -> np.ndarray:
    """How long the list of a random shingle of a random document would be: 101 quantiles."""
    n = np.zeros(16)
    for half in (common.table & np.uint8(15), common.table >> np.uint8(4)):
        n += np.bincount(half, minlength=16)
    length = 2.0 ** (np.arange(16) / 1.5) - 1
    share = np.cumsum(n * length)
    return length[np.searchsorted(share, share[-1] * np.linspace(1e-6, 1, 101) * (1 - 1e-12))] if share[-1] else np.ones(101)


def choose_boundary(sizes: dict[int, int], lengths: np.ndarray, least=LEAST) -> int:
    """The largest size up to which subsets cost no more than list entries and the looks at other entries that they lead to.

    A set is entered under its rarest shingles, so the j-th of its lists is as long as the j-th least of n lengths.
    """

    def heavy(n):
        lists = n - need(n, least) + 1
        return sum(1 + max(1.0, float(lengths[100 * j // (n + 1)])) for j in range(1, lists + 1))

    total_light = total_heavy = 0.0
    best = 0
    for n in range(1, MOST_LIGHT + 1):
        total_light += (sizes.get(n, 0) + 1) * light_cost(n, least)
        total_heavy += (sizes.get(n, 0) + 1) * heavy(n)
        if light_cost(n, least) <= heavy(n) and total_light <= total_heavy:
            best = n
    return best


def keys_of(s: np.ndarray, common: Sketch, boundary: int, least=LEAST) -> np.ndarray:
    """Keys that a set shares with every set that is similar but not equal to it."""
    n, out = len(s), []
    if n == 0:
        return np.zeros(0, _U)
    if n <= boundary:
        total = s.sum(dtype=_U)
        for k in range(n - need(n, least) + 1):
            drop = np.array([sum(c, _U(0)) for c in combinations(s, k)], _U) if k else np.zeros(1, _U)
            out.append(X.mix((total - drop) * _U(2) + _U((n - k) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) | _U(1))
    if n >= need(boundary + 1, least):
        first = np.lexsort((s, common.of(s)))[: n - need(n, least) + 1]
        out.append(X.mix(s[first]) & ~_U(1))
    return np.concatenate(out) if out else np.zeros(0, _U)


def describe(docs: DataFrame, common, boundary: int, text: str, key: str, size: int, least=LEAST) -> DataFrame:
    """Size, name (``digest``, and its first 64 bits), signature and (unless ``common`` is None) keys of every document's set."""
    src = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text_in"))

    def run(batches):
        for batch in batches:
            for at, part in X.pieces(batch.column("text_in")):
                sets = _shingles(part, size)
                names = [digest(s) for s in sets]
                new = [
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(names, pa.binary()),
                    pa.array(np.array([_short(x) for x in names], np.int64)),
                    pa.array([signature(s) for s in sets], pa.binary()),
                ]
                if common is not None:
                    new.append(pa.array([keys_of(s, common.value, boundary, least).view(np.int64) for s in sets], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(at, len(part)), *new], columns)

    columns = ["key", "n_shingles", "digest", "name", "sig", *["keys"] * (common is not None)]
    return src.mapInArrow(tidy(run), f"key {src.schema['key'].dataType.simpleString()}, n_shingles bigint, digest binary, name bigint, sig binary" + ", keys array<bigint>" * (common is not None))


def _short(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


PACKED = "bin int, k binary, name binary, fine binary"


def pack(found, bins: int):
    """Batches of ``PACKED`` from (name, size, keys) of sets: a row has many keys of one bin, 18 bytes each."""
    held, n = [], 0

    def flush():
        k = np.concatenate([x[2] for x in held]).astype(_U, copy=False)
        count = [len(x[2]) for x in held]
        name = np.repeat(np.array([x[0] for x in held], np.int64), count)
        fine = np.repeat((FINE * np.log(np.array([x[1] for x in held], np.float64))).astype(np.uint16), count)
        to = ((k >> _U(1)) % _U(bins)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        k, name, fine, to = k[order], name[order], fine[order], to[order]
        at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
        blobs = [pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()) for x in (k, name, fine)]
        return pa.RecordBatch.from_arrays([pa.array(to[at[:-1]]), *blobs], ["bin", "k", "name", "fine"])

    for one in found:
        if len(one[2]):
            held.append(one)
            n += len(one[2])
            if n >= PACK:
                yield flush()
                held, n = [], 0
    if held:
        yield flush()


def packed_keys(docs: DataFrame, common, boundary: int, text: str, size: int, least, bins: int) -> DataFrame:
    """The keys of every document's set, under the short name of the set; equal sets of a task give theirs once."""

    def sets(batches):
        seen = set()
        for batch in batches:
            for _, part in X.pieces(batch.column(0)):
                for s in _shingles(part, size):
                    if len(s) and (name := digest(s)) not in seen:
                        if len(seen) >= PACK:
                            seen.clear()
                        seen.add(name)
                        yield _short(name), len(s), keys_of(s, common.value, boundary, least)

    return docs.select(F.col(text).cast("string")).mapInArrow(tidy(lambda batches: pack(sets(batches), bins)), PACKED)


def runs(table, least=LEAST):
    """Lists of one bin, cut where sizes are too far apart: a key, number of members, two hashes over them, and the members, ``PART`` a row.

    Of runs with the same members one is given; a run of one member is none.
    """
    k, name, fine = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("k", _U), ("name", np.int64), ("fine", np.uint16)))
    order = np.lexsort((name, fine, k))
    k, name, fine = k[order], name[order], fine[order].astype(np.int64)
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (name[1:] != name[:-1])]) if len(k) else np.zeros(0, bool)
    k, name, fine = k[new], name[new], fine[new]
    reach = FINE * math.log(least[1] / least[0]) + 2 if least[0] else math.inf
    edges = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (fine[1:] - fine[:-1] > reach), [True]])) if len(k) else np.zeros(1, np.int64)
    length, at = np.diff(edges), edges[:-1]
    at, length = at[length > 1], length[length > 1]
    mine = np.concatenate([[0], np.cumsum(length)])
    name = name[np.repeat(at - mine[:-1], length) + np.arange(mine[-1])]
    u = name.view(_U)
    x, y = (np.bitwise_xor.reduceat(X.mix(h), mine[:-1]) if len(at) else np.zeros(0, _U) for h in (u, u ^ _U(0x9E3779B97F4A7C15)))
    k = X.mix(k[at] + fine[at].astype(_U))
    # of runs with the same members, that of the least key
    order = np.lexsort((k, y, x, length))
    first = np.concatenate([[True], (np.diff(length[order]) != 0) | (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])]) if len(at) else np.zeros(0, bool)
    one = order[first]
    rows = -(-length[one] // PART)
    part = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
    one = np.repeat(one, rows)
    m = np.minimum(PART, length[one] - part * PART)
    ends = np.concatenate([[0], np.cumsum(m)])
    members = name[np.repeat(mine[one] + part * PART - ends[:-1], m) + np.arange(ends[-1])]
    out = {"k": k[one].view(np.int64), "m": length[one], "x": x[one].view(np.int64), "y": y[one].view(np.int64), "part": part}
    return pa.table([*[pa.array(c, pa.int64()) for c in out.values()], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(members, pa.int64()))], names=[*out, "names"])


def passes(sig: np.ndarray, n: np.ndarray, i, j, least=LEAST, fine=()) -> np.ndarray:
    """Whether the sets i and j (equally shaped or broadcast against each other) may be similar, by sizes and signatures, longer ones (``fine``) last."""
    a, b = n[i], n[j]
    over = -(-least[0] * (a + b) // (least[0] + least[1]))
    differ = np.zeros(np.broadcast_shapes(np.shape(a), np.shape(b)), np.int32)
    for w in range(sig.shape[1]):
        differ += np.bitwise_count(sig[:, w][i] ^ sig[:, w][j])
    ok = (over <= np.minimum(a, b)) & (differ <= a + b - 2 * over)
    for row, bits in fine:
        x, y, most = np.broadcast_arrays(row[i], row[j], a + b - 2 * over)
        both = np.nonzero(ok & (x >= 0) & (y >= 0))
        for at in range(0, len(both[0]), 4096):
            pair = tuple(c[at : at + 4096] for c in both)
            ok[pair] = np.bitwise_count(bits[x[pair]] ^ bits[y[pair]]).sum(axis=1, dtype=np.int64) <= most[pair]
    return ok


def walk(sig: np.ndarray, n: np.ndarray, split: int, least=LEAST, most: int = 32, wide: int = 2048, fine=()) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what candidates connect: of all entries, or of entries before ``split`` with the others.

    Breadth first; an entry is compared with those not reached yet.
    """
    side = np.arange(len(n)) >= split if split else np.zeros(len(n), bool)
    unseen = np.arange(len(n))
    u, v = [], []

    def look(block, others):
        got = [passes(sig, n, block[:, None], others[None, at : at + wide], least, fine) for at in range(0, len(others), wide)]
        return np.concatenate(got, axis=1) if got else np.zeros((len(block), 0), bool)

    while len(unseen):
        # the block that a walk begins with is also compared with itself, unless its entries are all of one side
        front, unseen = unseen[:most], unseen[most:]
        if split:
            front, unseen = front[side[front] == side[front[0]]], np.concatenate([front[side[front] != side[front[0]]], unseen])
        else:
            x, y = np.nonzero(np.triu(look(front, front), 1))
            u.append(front[y])
            v.append(front[x])
        while len(front) and len(unseen):
            block = front[:most]
            if split:
                block = block[side[block] == side[block[0]]]
            front = front[len(block) :] if not split else front[~np.isin(front, block)]
            others = unseen[side[unseen] != side[block[0]]] if split else unseen
            hit = look(block, others)
            new = hit.any(axis=0)
            if new.any():
                hit = hit[:, new]
                u.append(others[new])
                v.append(block[hit.argmax(axis=0)])
                # entries of the block that reach the same one, which may belong to walks begun apart
                x, y = np.nonzero(np.triu(hit.astype(np.float32) @ hit.T.astype(np.float32), 1))
                u.append(block[y])
                v.append(block[x])
            front = np.concatenate([front, others[new]])
            unseen = unseen[~np.isin(unseen, others[new])] if split else others[~new]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *u]), np.concatenate([none, *v])


def settle(ok: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Least label of each connected part of stacked graphs: ``ok`` (graph, i, j) is symmetric, ``label`` (graph, i)."""
    while True:
        new = np.minimum(label, np.where(ok, label[:, None, :], np.iinfo(label.dtype).max).min(axis=2))
        if (new == label).all():
            return label
        label = new


def scan(table, least=LEAST):
    """One group: many short lists, one list, or a pair of chunks of a long one; edges (u, v) that connect its candidates."""
    table = table.combine_chunks()
    k, side, name, n = (table.column(c).to_numpy() for c in ("k", "side", "class", "n"))
    order = np.lexsort((name, side, k))
    k, side, name, n = k[order], side[order], name[order], n[order]
    sig, fine = folded(table.column("sig").take(pa.array(order)).to_pylist())
    edges = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
    length = np.diff(edges)
    u, v = [], []
    for m in range(2, SHORT + 1):
        lists = edges[:-1][length == m]
        for at in range(0, len(lists), 4096 // m):
            i = lists[at : at + 4096 // m, None] + np.arange(m)
            ok = passes(sig, n, i[:, :, None], i[:, None, :], least, fine)
            label = settle(ok, np.broadcast_to(np.arange(m), i.shape))
            g, x = np.nonzero(label != np.arange(m))
            u.append(name[i[g, x]])
            v.append(name[i[g, label[g, x]]])
    for at in np.flatnonzero(length > SHORT):
        a, b = edges[at], edges[at + 1]
        split = int((side[a:b] == 0).sum())
        x, y = walk(sig[a:b], n[a:b], 0 if split == b - a else split, least, fine=[(row[a:b], bits) for row, bits in fine])
        u.append(name[a:b][x])
        v.append(name[a:b][y])
    pairs = np.unique(np.stack([np.concatenate([np.zeros(0, np.int64), *u]), np.concatenate([np.zeros(0, np.int64), *v])], axis=1), axis=0)
    return pa.table([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["u", "v"])


def dealt(rows: DataFrame, group: str, chunks: Column, bins: int, columns: list[str]) -> DataFrame:
    """Rows of (``group``, class, ``columns``) dealt into groups (``cut``, g, i, j): small groups share ``bins``; one of several chunks
    becomes a group for each pair of them, with ``side`` 0 and 1."""
    mine = F.pmod(F.xxhash64("class"), F.col("chunks_"))
    rows = rows.withColumn("chunks_", chunks.cast("bigint")).withColumn("c_", mine).withColumn("o_", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks_") - 1)))
    cut = F.col("chunks_") > 1
    return rows.select(
        cut.alias("cut"), F.when(cut, F.col(group)).otherwise(F.pmod(F.xxhash64(group), F.lit(bins))).alias("g"), F.least("c_", "o_").alias("i"), F.greatest("c_", "o_").alias("j"),
        F.when(F.col("c_") <= F.col("o_"), 0).otherwise(1).alias("side"), group, *[c for c in columns if c != group],
    )


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): the least node of each connected component, for all nodes of ``edges`` (u, v).

    Alternating large-star and small-star steps; every step is written to the
    shared folder, and the number of steps grows with the logarithm of a component.
    """
    cur = keep(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = _print(cur)
    while True:
        # large star: every larger neighbour of u goes to the least neighbour of u (or u)
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = keep(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        # small star: u and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        new = keep(small, name)
        forget(cur)
        forget(large)
        after = _print(new)
        cur, same, before = new, after == before, after
        if same:
            out = keep(cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), name)
            forget(cur)
            return out


def _print(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("u", "v").cast("bigint"))).first())


def overlaps(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of sets[:split] with sets[split:], or of all with all if split is 0."""
    n = len(sets)
    who = np.repeat(np.arange(n), [len(s) for s in sets])
    _, at, count = np.unique(np.concatenate(sets) if n else np.zeros(0, _U), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    mine = shared[at]
    who, at = who[mine], column[at[mine]]
    width = int(shared.sum())
    left = split or n
    out = np.zeros((left, n - split), np.float32)
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    step = 2048
    for a in range(0, width, step):
        lo, hi = np.searchsorted(at, [a, a + step])
        m = np.zeros((n, min(step, width - a)), np.float32)
        m[who[lo:hi], at[lo:hi] - a] = 1
        out += m[:left] @ m[split:].T
    np_sizes = np.array([len(s) for s in sets])
    if not split:
        out[np.arange(n), np.arange(n)] = np_sizes
    return out.astype(np.int64)


def links(names: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], split: int, least=LEAST):
    """(class, class) links that join what is similar, and each class's links to documents of other classes here."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2 and not split:
        if not similar(len(np.intersect1d(*sets, assume_unique=True)), *sizes, least):
            return [], np.zeros(2, np.int64)
        return [(int(names.max()), int(names.min()))], copies[::-1]
    left = split or len(sets)
    over = overlaps(sets, split)
    ok = similar(over, sizes[:left, None], sizes[None, split:], least) & (over > 0)
    if not split:
        np.fill_diagonal(ok, False)
    count = np.zeros(len(sets), np.int64)
    count[:left] += ok @ copies[split:]
    if split:
        count[split:] += copies[:left] @ ok
    order = np.argsort(names)
    label = np.empty(len(sets), np.int64)
    label[order] = np.arange(len(sets))
    most = np.iinfo(np.int64).max
    while True:
        new = label.copy()
        new[:left] = np.minimum(new[:left], np.where(ok, label[None, split:], most).min(axis=1, initial=most))
        if split:
            new[split:] = np.minimum(new[split:], np.where(ok, new[:left, None], most).min(axis=0, initial=most))
        if (new == label).all():
            break
        label = new
    centre = names[order][label]
    moved = np.flatnonzero(centre != names)
    return list(zip(names[moved].tolist(), centre[moved].tolist())), count


def compare(table, least=LEAST):
    """One group: every blob in it, or one pair of chunks of a large blob; rows of links (u, v) and of counts (u, n)."""
    blob, side = table.column("root").to_numpy(), table.column("side").to_numpy()
    names, copies = table.column("class").to_numpy(), table.column("copies").to_numpy()
    raw = table.column("shingles").to_pylist()
    order = np.lexsort((names, side, blob))
    edges = np.flatnonzero(np.concatenate([[True], blob[order][1:] != blob[order][:-1], [True]]))
    u, v, n = [], [], []
    for a, b in zip(edges[:-1], edges[1:]):
        at = order[a:b]
        split = int((side[at] == 0).sum())
        joined, count = links(names[at], copies[at], [np.frombuffer(raw[i], _U) for i in at], 0 if split == len(at) else split, least)
        for x, y in joined:
            u.append(x)
            v.append(y)
            n.append(None)
        for x, c in zip(names[at].tolist(), count.tolist()):
            if c:
                u.append(x)
                v.append(None)
                n.append(c)
    return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], names=["u", "v", "n"])


def _only(rows: DataFrame, wanted: DataFrame, n: int, how: str = "left_semi") -> DataFrame:
    """``rows`` whose ``h`` is (or with ``left_anti`` is not) among the ``n`` rows of ``wanted``: without a shuffle if those are few."""
    return rows.join(F.broadcast(wanted) if n <= BROADCAST else wanted, "h", how).drop("h")


def _sets(docs: DataFrame, text: str, size: int) -> DataFrame:
    """(digest, shingles) of every document's set."""

    def run(batches):
        for batch in batches:
            for _, part in X.pieces(batch.column(0)):
                sets = [s for s in _shingles(part, size) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "shingles"])

    return docs.select(F.col(text).cast("string")).mapInArrow(tidy(run), "digest binary, shingles binary")


def lists(packed: DataFrame, least=LEAST) -> DataFrame:
    """Runs (k, m members, ``names``) of ``packed`` keys; of runs with the same members (told by two hashes over them) one."""
    found = packed.groupBy("bin").applyInArrow(lambda _, table: runs(table, least), "k bigint, m bigint, x bigint, y bigint, part bigint, names array<bigint>")
    # every part of a run is there under the same keys
    return found.groupBy("m", "x", "y", "part").agg(F.min("k").alias("k"), F.first("names").alias("names")).select("k", "m", "names")


def candidates(classes: DataFrame, bins: int, least=LEAST, found: DataFrame | None = None) -> DataFrame:
    """Edges (u, v) between classes that connect everything that may be similar.

    ``found`` has the lists, of short names; without it the column ``keys`` of the classes gives them.
    """
    if found is None:
        classes = classes.withColumn("name", F.col("class").cast("bigint"))

        def run(batches):
            return pack((x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), (np.array(k, np.int64).view(_U) for k in b.column(2).to_pylist()))), bins)

        found = lists(classes.select("name", "n", "keys").mapInArrow(tidy(run), PACKED), least)
    # classes that share a short name are all entered
    entries = found.select("k", "m", F.explode("names").alias("name")).join(classes.select("name", "class", "n", "sig"), "name")
    groups = dealt(entries, "k", F.ceil(F.col("m") / LIST), bins, ["class", "n", "sig"])
    return groups.groupBy("cut", "g", "i", "j").applyInArrow(lambda _, table: scan(table, least), "u bigint, v bigint")


def solve(docs: DataFrame, text: str, key: str, size: int, least=LEAST) -> tuple[DataFrame, DataFrame]:
    """Every row's (key, n_shingles, digest), and every class's (digest, key, root, component_id, n_links); both written."""
    bounded(docs.sparkSession)
    common, sizes = survey(docs, text, size)
    boundary = choose_boundary(sizes, list_lengths(common), least)
    base = keep(describe(docs, None, boundary, text, key, size, least), "jaccard")
    one = base.filter("n_shingles > 0").groupBy("digest").agg(F.min("key").alias("key"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("name").alias("name"), F.first("sig").alias("sig"))
    # ids are given where rows are written, and read from there
    classes = keep(one.withColumn("class", F.monotonically_increasing_id()), "jaccard")
    n_classes, total = classes.agg(F.count("*"), F.sum("n")).first()
    n_keys = n_classes + (total or 0) * (least[1] - least[0]) // least[1]
    # several to a partition, which evens them out
    bins = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_keys // BIN)
    shipped = docs.sparkSession.sparkContext.broadcast(common)
    found = keep(lists(packed_keys(docs, shipped, boundary, text, size, least, bins), least), "jaccard")
    shipped.destroy()
    del common, shipped
    release()
    blobs = components(candidates(classes, max(1, n_classes // CHUNK), least, found), "jaccard")
    forget(found)
    members = keep(blobs.join(classes.select(F.col("class").alias("node"), "digest", "key", "copies", "n"), "node").withColumnRenamed("node", "class"), "jaccard")
    forget(blobs)
    n_members, weight = members.agg(F.count("*"), F.sum("n")).first()
    wanted = members.select(F.xxhash64("key").alias("h")).distinct()
    texts = _only(docs.select(F.xxhash64(F.col(key)).alias("h"), F.col(text).alias("text_in")), wanted, n_members)
    sets = _sets(texts, "text_in", size).groupBy("digest").agg(F.first("shingles").alias("shingles"))
    parts = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    chunks = F.greatest(F.ceil(F.col("m") / CHUNK), F.ceil(F.col("w") / WEIGHT))
    groups = dealt(members.join(parts, "root").join(sets, "digest"), "root", chunks, max(1, (weight or 0) // WEIGHT), ["class", "copies", "shingles"])
    linked = keep(groups.groupBy("cut", "g", "i", "j").applyInArrow(lambda _, table: compare(table, least), "u bigint, v bigint, n bigint"), "jaccard")
    roots = components(linked.filter("v is not null").select("u", "v"), "jaccard")
    counts = linked.filter("n is not null").groupBy(F.col("u").alias("class")).agg(F.sum("n").alias("others"))
    named = classes.select("class", "digest", "key", "copies").join(roots.withColumnRenamed("node", "class"), "class", "left").join(counts, "class", "left")
    named = named.withColumn("root", F.coalesce("root", "class"))
    first = named.groupBy("root").agg(F.min("key").alias("component_id"))
    final = keep(named.join(first, "root").select("digest", "key", "class", "root", "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "jaccard")
    for t in (classes, members, linked, roots):
        forget(t)
    return base, final


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE, least=LEAST) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (least key reachable by links, itself included) and ``n_links`` for every row."""
    base, classes = solve(docs, text, key, size, least)
    alone = F.col("n_shingles") == 0
    # the empty set is the name of no class
    out = base.select("key", "n_shingles", "digest").join(classes.select("digest", "component_id", "n_links"), "digest", "left")
    return out.select(F.col("key").alias(key), "n_shingles", F.when(alone, F.col("key")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, 0).otherwise(F.col("n_links")).cast("bigint").alias("n_links"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE, least=LEAST) -> DataFrame:
    """One row of each component, with its own columns: that of the least key, once if it is repeated.

    Rows without words are linked with nothing and stay.
    """
    base, classes = solve(docs, text, key, size, least)
    least_of = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "class", "digest")).alias("s")
    kept = classes.groupBy("root").agg(least_of).select("s.key", "s.digest")
    # a key that stands once tells its row; of the others the texts decide
    per_key = base.groupBy("key").agg(F.count("*").alias("rows"), F.max("n_shingles").alias("most"))
    known = per_key.join(kept.select("key").distinct().withColumn("stays", F.lit(True)), "key", "left")
    # (and of keys with one hash)
    often = F.bool_or(F.col("key").isNull() | (F.col("rows") > 1)) | (F.count("*") > 1)
    stays = F.bool_and(F.col("stays").isNotNull() | (F.col("most") == 0))
    fate = keep(known.groupBy(F.xxhash64("key").alias("h")).agg(often.alias("often"), stays.alias("stays")).filter("often or not stays").drop("stays"), "jaccard")
    n_gone, n_often = (int(x or 0) for x in fate.agg(F.count("*"), F.sum(F.col("often").cast("int"))).first())
    rows = docs.select(F.struct("*").alias("row")).withColumn("h", F.xxhash64(F.col(f"row.`{key}`")))
    plain = _only(rows, fate.select("h"), n_gone, "left_anti").select("row.*")
    if not n_often:
        forget(base)
        forget(classes)
        return plain

    def run(texts):
        sets = _shingles(texts, size)
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary())]

    odd = _only(rows, fate.filter("often").select("h"), n_often).select("row.*")
    odd = map_text(odd, text, None, fields("n_shingles bigint, digest binary"), run).withColumn("key", F.col(f"row.`{key}`"))
    linked = odd.filter("n_shingles > 0").join(kept.toDF("kept_key", "kept_digest"), (F.col("digest") == F.col("kept_digest")) & F.col("key").eqNullSafe(F.col("kept_key")), "left_semi")
    return plain.unionByName(linked.dropDuplicates(["digest", "key"]).select("row.*")).unionByName(odd.filter("n_shingles = 0").select("row.*"))
