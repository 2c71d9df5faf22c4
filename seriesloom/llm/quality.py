"""Quality rules as weak supervision.

Eleven rules look at surface counts of a text and vote good, vote bad or abstain.
Expectation-maximisation over the table of vote patterns (at most 3**11 of them,
counted over every document) estimates how each rule votes on good and on bad
documents, under conjugate priors on how often rules err; a document's verdict is the
posterior probability that it is good, not a conjunction of rules.

Defined results: a null or empty text has no words and fails the base rule.  Texts of any
length are read whole.  Ties in the posterior (exactly 0.5) are kept.  Repeated rows each get their own,
equal, verdict.  An empty table gives an empty table.  Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm import textops as X
from seriesloom.llm.common import fields, map_text

COUNTS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "q_lines bigint, q_capitals bigint, q_letters bigint, q_marks bigint, q_echoes bigint, q_stops bigint"
)

_SYMBOLS = X._table(lambda b: chr(b) in "#*$%&|<>")
_CAPITALS = X._table(lambda b: 65 <= b <= 90)
_LETTERS = X._table(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0)
_MARKS = X._table(lambda b: chr(b) in "!?")
_STOPS = X._table(lambda b: chr(b) in ".!?")


def _repeats(docs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which rows have a (text, hash) that occurs more than once."""
    key = X.mix(hashes + docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    hit = np.zeros(len(key) + 1, bool)
    hit[1:-1] = same
    hit[:-2] |= same
    out = np.empty(len(key), bool)
    out[order] = hit[:-1] if len(key) else hit[:0]
    return out


def count(texts) -> list[np.ndarray]:
    """The columns of ``COUNTS`` for an Arrow array of whole texts."""
    data, off = X.buffers(texts)
    n = len(off) - 1
    words = X.scan(data, off, X.SPACED, lower=False)
    n_words = words.counts()
    chars = X.count_bytes(data, off, X.CODE_POINTS & X.SPACED)

    h, docs, first = X.windows(words, 3)
    cover = np.zeros(len(words.hash) + 1, np.int32)
    hit = first[_repeats(docs, h)]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + 3, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    repeat = covered[words.at[1:]] - covered[words.at[:-1]]

    lines = X.scan(data, off, X.LINES, lower=False)
    full = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    docs_of = lines.docs()[full]
    key = X.mix(lines.hash[full] + docs_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order][1:] == key[order][:-1]
    n_lines = np.bincount(docs_of, minlength=n)
    dup = np.bincount(docs_of[again], minlength=n)

    echo = np.zeros(len(words.hash), bool)
    echo[1:] = words.hash[1:] == words.hash[:-1]
    inner = words.at[:-1][n_words > 0]
    echo[inner] = False
    echoes = np.concatenate([[0], np.cumsum(echo)])
    return [
        n_words.astype(np.int64), chars, X.count_bytes(data, off, _SYMBOLS), dup.astype(np.int64), repeat.astype(np.int64),
        n_lines.astype(np.int64), X.count_bytes(data, off, _CAPITALS), X.count_bytes(data, off, _LETTERS),
        X.count_bytes(data, off, _MARKS), (echoes[words.at[1:]] - echoes[words.at[:-1]]).astype(np.int64), X.count_bytes(data, off, _STOPS),
    ]


#: Each rule: name, what it measures, votes bad below, votes good from, votes good to, votes bad above.
#: Measures between a good and a bad limit make the rule abstain; None leaves a side open.
RULES = (
    ("length", "n_words", 50, 100, None, None),
    ("word_length", "word_chars / n_words", 2.0, 3.0, 9.0, 14.0),
    ("symbols", "n_symbols / n_words", None, None, 0.02, 0.10),
    ("repeats", "n_repeat_words / n_words", None, None, 0.15, 0.45),
    ("dup_lines", "n_dup_lines / q_lines", None, None, 0.05, 0.30),
    ("capitals", "q_capitals / q_letters", None, None, 0.10, 0.30),
    ("marks", "q_marks / n_words", None, None, 0.03, 0.15),
    ("echoes", "q_echoes / n_words", None, None, 0.03, 0.10),
    ("sentences", "q_stops / n_words", 0.005, 0.02, 0.30, 0.60),
    ("line_length", "n_words / q_lines", 2.0, 4.0, None, None),
    ("letters", "q_letters / word_chars", 0.70, 0.80, None, None),
)


def votes() -> list[Column]:
    """Per rule 2 (good), 0 (bad) or 1 (abstains; also where it can't measure)."""
    out = []
    for _, measure, bad_lo, good_lo, good_hi, bad_hi in RULES:
        parts = measure.split(" / ")
        x = F.col(parts[0]).cast("double")
        if len(parts) == 2:
            x = x / F.when(F.col(parts[1]) > 0, F.col(parts[1]))
        bad, good = F.lit(False), F.lit(True)
        if bad_lo is not None:
            bad, good = bad | (x < bad_lo), good & (x >= good_lo)
        if bad_hi is not None:
            bad, good = bad | (x > bad_hi), good & (x <= good_hi)
        out.append(F.when(x.isNull(), 1).when(bad, 0).when(good, 2).otherwise(1))
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass
class Model:
    """Log-odds of good: ``prior`` plus ``weight[rule][vote]`` of each rule."""

    prior: float
    weight: np.ndarray
    votes: np.ndarray  # class (bad, good), rule, vote: estimated probability
    path: list[float]

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """Per rule: share of good documents without a bad vote, and of bad ones with one."""
        return {r[0]: (1 - float(self.votes[1, i, 0]), float(self.votes[0, i, 0])) for i, r in enumerate(RULES)}

    def posterior(self) -> Column:
        logit = F.lit(float(self.prior))
        for vote, w in zip(votes(), self.weight):
            logit = logit + F.when(vote == 2, float(w[2])).when(vote == 0, float(w[0])).otherwise(float(w[1]))
        return 1 / (1 + F.exp(-logit))


#: Dirichlet prior over (bad, abstains, good) of a rule's votes, and how many documents it is worth as a multiple of
#: the corpus: on good documents, where a false alarm is what the author of a rule rules out, and on bad ones, where
#: a rule catches its own kind of fault and votes good on others.
PRIOR_GOOD, WORTH_GOOD = (0.001, 0.05, 0.949), 6.0
PRIOR_BAD, WORTH_BAD = (0.15, 0.05, 0.8), 0.08
#: Share of good documents expected, worth as much as the corpus.
PRIOR_SHARE, WORTH_SHARE = 0.9, 1.0


def em(patterns: np.ndarray, n: np.ndarray, steps: int = 500, tol: float = 1e-10) -> Model:
    """Two-class EM over vote patterns (rows; votes 0, 1, 2) that occur n times, to the most probable parameters.

    The priors are conjugate, so a step is counts plus pseudo-counts and the posterior density never falls
    (``Model.path``, per document).  They tell which class is the good one, and what a vote alone is worth: rules for
    different faults hardly ever vote on the same document, so agreement alone would not tell.
    """
    total = max(float(n.sum()), 1.0)
    one_hot = np.stack([patterns == v for v in range(3)], axis=2).astype(float)  # pattern, rule, vote
    # no more than the expected share of documents is bad, so what a rule rejects beyond it are false alarms of this corpus
    rate = (n[:, None] * (patterns == 0)).sum(axis=0) / total
    false = np.clip((rate - (1 - PRIOR_SHARE)) / PRIOR_SHARE, 0, 0.999)[:, None]
    seed = np.stack([false * np.array([1.0, 0.0, 0.0]) + (1 - false) * np.array(v) for v in (PRIOR_BAD, PRIOR_GOOD)])  # class, rule, vote
    worth = np.array([WORTH_BAD, WORTH_GOOD]) * total
    share = np.array([1 - PRIOR_SHARE, PRIOR_SHARE])
    p, prior, path = seed.copy(), share, []
    for _ in range(steps):
        like = np.stack([np.log(prior[c]) + (one_hot * np.log(p[c])).sum(axis=(1, 2)) for c in (0, 1)], axis=1)
        top = like.max(axis=1, keepdims=True)
        post = np.exp(like - top)
        norm = post.sum(axis=1, keepdims=True)
        post = post / norm
        fit = float((n * (top[:, 0] + np.log(norm[:, 0]))).sum()) + WORTH_SHARE * total * float(share @ np.log(prior))
        path.append((fit + sum(worth[c] * float((seed[c] * np.log(p[c])).sum()) for c in (0, 1))) / total)
        if len(path) > 1 and path[-1] - path[-2] < tol:
            break
        mine = post * n[:, None]
        for c in (0, 1):
            got = (mine[:, c][:, None, None] * one_hot).sum(axis=0) + worth[c] * seed[c]
            p[c] = got / got.sum(axis=1, keepdims=True)
        prior = (mine.sum(axis=0) + WORTH_SHARE * total * share) / (float(n.sum()) + WORTH_SHARE * total)
    return Model(float(np.log(prior[1] / prior[0])), np.log(p[1]) - np.log(p[0]), p, path)


def measure(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    return map_text(docs, text, carry, fields(COUNTS), count)


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Count vote patterns over every document (one row per pattern reaches the driver) and run EM."""
    counted = measure(docs, text, [])
    rows = counted.groupBy(*[v.alias(f"v{i}") for i, v in enumerate(votes())]).count().collect()
    if not rows:
        return em(np.zeros((0, len(RULES)), int), np.zeros(0))
    a = np.array([list(r) for r in sorted(rows)], dtype=float)
    return em(a[:, :-1].astype(int), a[:, -1])


def judge(docs: DataFrame, text: str = "text", carry: list[str] | None = None, model: Model | None = None) -> DataFrame:
    """Counts, ``quality`` (posterior), ``base_failed`` and ``kept`` beside carried columns (see ``map_text``)."""
    model = model or fit(docs, text)
    out = measure(docs, text, carry)
    return out.withColumns({"quality": model.posterior(), "base_failed": base_failed()}).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    return judge(docs, text).filter("kept").select("row.*")
