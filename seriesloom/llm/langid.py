"""Language identification by averaged hashed subword embeddings.

Every run of two to four bytes of a text (ASCII folded to lower case, everything
that is not a letter to a blank) is a subword, hashed to a bucket with an
embedding.  A text is the average of its subwords' embeddings; a linear softmax
on that gives the language.  Both are trained together by stochastic gradient
descent in NumPy on at most ``SAMPLE`` labelled rows, spread evenly over the
languages and chosen by a hash of doc_id (only their bucket counts reach the
driver).  Since the model is linear in the average, prediction needs just the
sum of per-bucket logits.

Calibration: a fifth of the sample sets a temperature and a rejection threshold;
``accepted`` is false where the calibrated confidence is below it.

Defined results: null text or text without a letter is ``und`` with score 0 and
not accepted; texts of any length are read whole; ties go to the first language in
sorted order; rows with null doc_id train nothing, and of rows with one doc_id the
least (language, text) trains; repeated rows get equal rows; without any labelled row
every text is ``und``; an empty table gives an empty table; other columns, whatever their names, are
not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm import textops as X
from seriesloom.llm.common import fields, map_text, release

BUCKETS = 1 << 15
DIM = 16
ORDERS = (2, 3, 4)
SAMPLE = 2400
EPOCHS = 6
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint32)
for _b in range(256):
    if 97 <= _b <= 122 or _b >= 128:
        _FOLD[_b] = _b
    elif 65 <= _b <= 90:
        _FOLD[_b] = _b + 32
_LETTER = regex.compile(r"\p{L}")
_SEGMENT = 1 << 17


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def subwords(data: np.ndarray, off: np.ndarray):
    """Per segment: its first byte, and for each order the bucket at every byte (``BUCKETS`` where there is none)."""
    last = np.zeros(len(data) + 1, bool)
    last[off] = True
    for a in range(0, len(data), _SEGMENT):
        b = min(len(data), a + _SEGMENT)
        more = _FOLD[data[a : min(len(data), b + max(ORDERS) - 1)]]
        code = more[: b - a].copy()
        blank = code == 32
        cut = np.zeros(b - a, bool)
        got = []
        for n in range(2, max(ORDERS) + 1):
            nxt = np.full(b - a, 32, np.uint32)
            part = more[n - 1 : n - 1 + b - a]
            nxt[: len(part)] = part
            code = code << np.uint32(8) | nxt
            blank &= nxt == 32
            ends = np.ones(b - a, bool)
            edge = last[a + n - 1 : min(len(last), b + n - 1)]
            ends[: len(edge)] = edge
            cut |= ends
            if n in ORDERS:
                h = (code + np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
                h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 15)
                got.append(np.where(blank | cut, np.uint32(BUCKETS), h))
        yield a, got


def bags(texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their counts of every text."""
    data, off = X.buffers(texts)
    out = []
    for i in range(len(off) - 1):
        total = np.zeros(BUCKETS + 1, np.int64)
        one = data[off[i] : off[i + 1]]
        for _, got in subwords(one, np.array([0, len(one)])):
            for h in got:
                total += np.bincount(h, minlength=BUCKETS + 1)
        at = np.flatnonzero(total[:BUCKETS])
        out.append((at.astype(np.uint16), total[at]))
    return out


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # bucket (the last for none), language
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, texts) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated confidence and whether it is accepted, for whole texts."""
        data, off = X.buffers(texts)
        n = len(off) - 1
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
        total, count = np.zeros((n, len(self.langs))), np.zeros(n)
        for a, got in subwords(data, off):
            b = a + len(got[0])
            lo, hi = np.searchsorted(off, a, side="right") - 1, np.searchsorted(off, b, side="left")
            cuts = np.clip(off[lo : hi + 1], a, b) - a
            some = np.flatnonzero(cuts[1:] > cuts[:-1])
            for h in got:
                total[lo + some] += np.add.reduceat(self.logits[h], cuts[some], axis=0)
                count[lo + some] += np.add.reduceat(h < BUCKETS, cuts[some], dtype=np.int64)
        z = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        best = z.argmax(axis=1)
        score = z[np.arange(n), best]
        known = np.array([has_letter(t) for t in (texts.to_pylist() if hasattr(texts, "to_pylist") else texts)], bool)
        langs = [str(self.langs[k]) if ok else UNKNOWN for k, ok in zip(best, known)]
        return langs, np.where(known, score, 0.0), known & (score >= self.threshold)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """SGD on (language, buckets, counts) rows."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    label = np.array([langs.index(r[0]) for r in rows])
    share = lambda i: rows[i][2] / max(1.0, float(rows[i][2].sum()))
    order = rng.permutation(len(rows))
    calib = order[: len(rows) // 5] if len(rows) >= 25 else order
    fit = order[len(rows) // 5 :] if len(rows) >= 25 else order
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out = rng.uniform(-0.1, 0.1, (DIM, len(langs)))
    bias = np.zeros(len(langs))
    step, steps = 0, EPOCHS * len(fit)
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            rate = 1.0 - step / steps
            step += 1
            at, p = rows[i][1], share(i)
            h = p @ emb[at]
            z = h @ out + bias
            z = np.exp(z - z.max())
            g = z / z.sum()
            g[label[i]] -= 1
            back = out @ g
            out -= 2.0 * rate * np.outer(h, g)
            bias -= 0.02 * rate * g
            # a subword's share of a text is small, so its embedding takes longer steps
            emb[at] -= (40.0 * rate) * p[:, None] * back
    logits = np.zeros((BUCKETS + 1, len(langs)), np.float32)
    logits[:BUCKETS] = emb @ out
    z = np.stack([share(i) @ logits[rows[i][1]] + bias for i in calib])
    y = label[calib]

    def confidences(t):
        s = z / t
        s = np.exp(s - s.max(axis=1, keepdims=True))
        return s / s.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.05, 5, 60)
    loss = [-np.log(confidences(t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    c = confidences(temperature)
    right = c.max(axis=1)[c.argmax(axis=1) == y]
    # what all but one in 500 rightly classified texts reach, and never more than an even chance
    threshold = min(0.5, 0.9 * float(np.quantile(right, 0.002))) if len(right) else 0.0
    return Model(langs, logits, bias, temperature, threshold)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` of the labelled rows, as evenly over languages as they allow."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull())
    # a doc_id counts once, however many rows have it
    rows = rows.groupBy(F.col(key).alias("k")).agg(F.min(lang).alias("l")).withColumn("h", F.xxhash64(F.col("k").cast("string")))
    # at most ``sample`` languages can be learnt from as many rows
    counts = rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(sample).collect()
    if not counts:
        return train([])
    of = F.broadcast(labelled.sparkSession.createDataFrame([(r[0], r[1]) for r in counts], "l string, n bigint"))
    # a hash is uniform, so hash times frequency is about a row's rank in its language: no language is sorted as a whole
    rank = (F.col("h").cast("double") / 2.0**64 + 0.5) * F.col("n")
    ids = rows.join(of, "l").withColumn("turn", rank).orderBy("turn", "h", "k", "l").limit(sample)
    # at most ``sample`` keys, and a row for each
    chosen = labelled.select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).cast("string").alias("t")).filter("t is not null and l is not null")
    chosen = chosen.join(F.broadcast(ids.select("k").distinct()), "k").groupBy("k").agg(F.min(F.struct("l", "t")).alias("s")).select("k", "s.l", "s.t")

    def run(texts):
        got = bags(texts)
        return [pa.array([x[0].tobytes() for x in got], pa.binary()), pa.array([x[1].astype(np.int32).tobytes() for x in got], pa.binary())]

    rows = map_text(chosen, "t", ["k", "l"], fields("at binary, n binary"), run).collect()
    rows.sort(key=lambda r: str(r[0]))
    model = train([(r[1], np.frombuffer(r[2], np.uint16), np.frombuffer(r[3], np.int32)) for r in rows])
    del rows
    release()
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``lang_pred``, ``score`` and ``accepted`` beside carried columns (see ``map_text``)."""

    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        langs, score, accepted = shipped.value.predict(texts)
        return [pa.array(langs, pa.string()), score, accepted]

    return map_text(docs, text, carry, fields("lang_pred string, score double, accepted boolean"), run)


def filter_language(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with their own columns."""
    return identify(docs, model, text).filter("accepted").select("row.*")
