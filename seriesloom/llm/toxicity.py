"""Toxicity with noisy-channel deobfuscation.

1. A character trigram model counts the letters of every document (accents
   folded, everything else a blank).
2. A token that is not plain letters (digits or signs inside, a character three
   times in a row) is seen as a word that passed a noisy channel of look-alike
   characters, inserted separators and repetition.  Its lattice of readings is
   decoded by Viterbi search (the ``BEST`` best paths) under the character model.
   Spacing is noise too: a gap between two tokens may be a blank or nothing.  The
   letters beside a gap settle it under the model unless a token of one character
   or a noisy one is there; what is not settled as a blank is decoded as a chain.
3. Restored words are scored by a lexicon: log-odds of a word, or of its first
   three to six letters, being in toxic rather than other labelled documents,
   of which the lower confidence limit counts.  Words of scripts without a decoder
   stand for themselves.  A logistic regression turns the strongest word of a text
   and the (damped) sum over all others into a probability.

Labels come from at most ``SAMPLE`` labelled rows, chosen by a hash of doc_id (a
documented bound); the character model covers all documents.

Defined results: null and empty text have no words and get the score of a text
without evidence; texts and tokens of any length are read whole; repeated rows get
equal scores; a doc_id with several labels counts as toxic if one says so, and one
with several texts is learnt from its least; of labelled rows with equal hashes the
lesser doc_id comes first; without labelled rows of both classes every score is the
share of toxic labels (0 without labels); an empty table gives an empty table;
other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm import textops as X
from seriesloom.llm.common import fields, forget, keep, map_text

SAMPLE = 16_000
BEST = 4
CLASSES = 28  # blank, a to z, any other letter
CACHE = 400_000
FOLDS_N = 5
STRONG = 3.0
DAMP = 0.8
SLACK = 1.0  # readings of a chain count if their log score is so near the best one's

# Characters that are read as letters, most likely first.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = set(".-_*~'`^,:;/\\\"#=+!|&%")
_KEEP, _ALIKE, _SECOND, _DROP, _REPEAT, _TWICE = 0.0, -1.2, -1.9, -0.9, -0.05, -2.5
CACHED = 64  # weights of longer tokens are not cached


def _folds() -> dict[int, str]:
    out = {}
    for cp in range(0xC0, 0x250):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c)).lower()
        if plain.isascii() and plain.isalpha():
            out[cp] = plain
    out[0xDF] = "ss"
    return out


FOLDS = _folds()
_CLASS = np.zeros(0x10000, np.uint8)
for _cp in range(0x10000):
    _c = chr(_cp)
    if "a" <= _c.lower() <= "z" and _cp < 128:
        _CLASS[_cp] = ord(_c.lower()) - 96
    elif _cp in FOLDS:
        _CLASS[_cp] = ord(FOLDS[_cp][0]) - 96
    elif _c.isalpha():
        _CLASS[_cp] = 27


def fold_text(token: str) -> str:
    return token.lower().translate(FOLDS)


def trigrams(texts) -> np.ndarray:
    """Counts of class trigrams in whole texts, blanks around each text."""
    total = np.zeros(CLASSES**3, np.int64)
    for _, part in X.pieces(texts, 1 << 20):
        data, off = X.buffers(part)
        raw = bytes(data)
        joined = "  ".join(raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:]))
        cps = np.frombuffer(f"  {joined}  ".encode("utf-32-le"), np.uint32)
        c = _CLASS[np.minimum(cps, 0xFFFF)].astype(np.int32)
        total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
    return total


def char_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Natural log P(letter | two before it), smoothed, from every document."""

    def run(batches):
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            total += trigrams(batch.column(0))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["at", "n"])

    rows = docs.select(F.col(text).cast("string")).mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(CLASSES**3)
    for r in rows:
        n[r.at] = r.n
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    one = (n.sum(axis=(0, 1)) + 1) / (n.sum() + CLASSES)
    two = n.sum(axis=0)
    two = (two + 5 * one) / (two.sum(axis=1, keepdims=True) + 5)
    three = (n + 5 * two[None]) / (n.sum(axis=2, keepdims=True) + 5)
    return np.log(three).astype(np.float32)


def readings(token: str) -> list[list[tuple[str, float]]]:
    """The lattice: for each run of equal characters, what it may stand for and at what cost."""
    out, i = [], 0
    while i < len(token):
        j = i
        while j < len(token) and token[j] == token[i]:
            j += 1
        c, n = token[i], j - i
        options = []
        letters = c if "a" <= c <= "z" else LOOK_ALIKES.get(c, "")
        for k, letter in enumerate(letters):
            cost = _KEEP if letter == c else (_ALIKE, _SECOND)[min(k, 1)]
            if n == 1:
                options.append((letter, cost))
            elif n == 2:
                options += [(letter * 2, cost), (letter, cost + _TWICE)]
            else:
                options += [(letter, cost + _REPEAT), (letter * 2, cost + _TWICE)]
        if c in SEPARATORS or not letters:
            options.append(("", _DROP))
        out.append(options)
        i = j
    return out


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """As ``readings``, but a blank may be nothing, and a separator may be a blank."""
    out = []
    for k, part in enumerate(token.split(" ")):
        if k:
            out.append([(" ", _KEEP), ("", _DROP)])
        i = 0
        for options in readings(part):
            c = part[i]
            while i < len(part) and part[i] == c:
                i += 1
            out.append([*options, (" ", _DROP)] if c in SEPARATORS else options)
    return out


def paths(steps: list[list[tuple[str, float]]], lm: list, best: int) -> list[tuple[float, str]]:
    """The best (score, reading) of a lattice by Viterbi search, keeping ``best`` paths for each two last letters.

    Time is linear in the length: a path is a chain of links, and a hash tells equal readings.
    """
    states: dict[tuple[int, int], list[tuple]] = {(0, 0): [(0.0, 0, None)]}
    for options in steps:
        new: dict[tuple[int, int], list[tuple]] = {}
        for (a, b), found in states.items():
            for letters, cost in options:
                x, y, gain, tail = a, b, cost, 0
                for ch in letters:
                    z = 0 if ch == " " else ord(ch) - 96
                    # two blanks in a row are one
                    if z or y:
                        gain += lm[x][y][z]
                        x, y = y, z
                        tail = tail * CLASSES + z + 1
                base = (CLASSES + 1) ** len(letters)
                new.setdefault((x, y), []).extend((s + gain, (h * base + tail) % _PRIME if letters else h, (link, letters) if letters else link) for s, h, link in found)
        states = {}
        for k, found in new.items():
            found.sort(key=lambda p: (-p[0], p[1]))
            top: dict[int, tuple] = {}
            for q in found:
                if q[1] not in top:
                    top[q[1]] = q
                    if len(top) == best:
                        break
            states[k] = list(top.values())
    ends = sorted(((s + (lm[a][b][0] if b else 0.0), h, link) for (a, b), found in states.items() for s, h, link in found), key=lambda p: (-p[0], p[1]))
    out = []
    for score, _, link in ends[:best]:
        letters = []
        while link is not None:
            letters.append(link[1])
            link = link[0]
        out.append((score, "".join(reversed(letters))))
    return out


def rows(lm: np.ndarray) -> list:
    """The model as lists, whose items are read faster."""
    if _ROWS[0] is not lm:
        _ROWS[:] = [lm, lm.tolist()]
    return _ROWS[1]


_ROWS: list = [None, None]


def decode(token: str, lm: np.ndarray, best: int = BEST) -> list[str]:
    """The best readings of a token as one word."""
    return [w for _, w in paths(readings(token), rows(lm), best) if w]


def split(token: str, lm: np.ndarray) -> list[str]:
    """Words of the best readings of a token or chain with word breaks."""
    found = paths(lattice(token), rows(lm), BEST)
    return [w for score, text in found if score >= found[0][0] - SLACK for w in text.split()]


_BLANK, _NOTHING, _EITHER = 0, 1, 2


class Gaps(dict):
    """What the gap between a token that ends in ... and one that begins with ... (two characters each) is."""

    def __init__(self, lm: np.ndarray):
        super().__init__()
        self.lm, self.seen = lm.tolist(), {}

    def __missing__(self, key):
        if len(self) > CACHE:
            self.clear()
        got = self[key] = self.settle(*key)
        return got

    def settle(self, tail: str, head: str) -> int:
        x, y = fold_text(tail), fold_text(head)
        if len(x) > 1 and len(y) > 1 and x.isascii() and y.isascii() and x.isalpha() and y.isalpha():
            # with two letters on both sides no other gap matters
            a, b, c, d = (ord(ch) - 96 for ch in x[-2:] + y[:2])
            lm = self.lm
            return _NOTHING if lm[a][b][c] + lm[b][c][d] + _DROP > lm[a][b][0] + lm[b][0][c] + lm[0][c][d] else _BLANK
        x, y = _FRONT.sub("", x), _BACK.sub("", y)
        if len(y) == 1 and len(x) == 2 and x[1] in SEPARATORS:
            x = x[0]
        return _EITHER if x and y and _LETTER.search(x + y) and all(c in _READ for c in x + y) else _BLANK

    def between(self, looks, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the gap after each token (but the last) of a sequence is, and whether its letters make three in a row."""
        tails, heads = looks.tail.dictionary.to_pylist(), looks.head.dictionary.to_pylist()
        tail, head = looks.tail.indices.to_numpy().astype(np.int64), looks.head.indices.to_numpy().astype(np.int64)
        pair = pa.array(tail[code[:-1]] * len(heads) + head[code[1:]], pa.int64()).dictionary_encode()
        which = [divmod(p, len(heads)) for p in pair.dictionary.to_pylist()]
        state = np.array([self[tails[a], heads[b]] for a, b in which], np.int8)
        thrice = np.array([_THRICE.search(tails[a] + heads[b]) is not None for a, b in which], bool)
        at = pair.indices.to_numpy()
        return state[at], thrice[at]

    def may_join(self, chain: list[str]) -> bool:
        """Whether a chain has a reading that counts and is not its tokens; of two or three tokens the ends tell."""
        if len(chain) > 3:
            return True
        key = " ".join([chain[0][-2:], *chain[1:-1], chain[-1][:2]])
        got = self.seen.get(key)
        if got is None:
            if len(self.seen) > CACHE:
                self.seen.clear()
            found = paths(lattice(fold_text(key)), self.lm, 2)
            got = self.seen[key] = any(score >= found[0][0] - SLACK and text.count(" ") < len(chain) - 1 for score, text in found)
        return got

    def patterns(self, chain: list[str]) -> list[tuple[bool, ...]]:
        """Which gaps of a chain of plain words are nothing, in each reading that counts and joins some.

        Letters are as they stand, so a reading is a choice for each gap, and of the outer words the ends tell.
        """
        key = (chain[0][-2:], *chain[1:-1], chain[-1][:2])
        got = self.seen.get(key)
        if got is None:
            if len(self.seen) > CACHE:
                self.seen.clear()
            lm, scores = self.lm, {}
            for choice in itertools.product((False, True), repeat=len(key) - 1):
                x = y = 0
                total = _DROP * sum(choice)
                for part, nothing in zip(key, (True, *choice)):
                    for z in ([] if nothing else [0]) + [ord(c) - 96 for c in part]:
                        total += lm[x][y][z]
                        x, y = y, z
                scores[choice] = total + lm[x][y][0]
            best = max(scores.values())
            got = self.seen[key] = [c for c, score in scores.items() if score >= best - SLACK and any(c)]
        return got

    def run(self, tokens: list[str], gaps: list[int]) -> tuple[list[str], list[str]]:
        """Words made of several of some tokens between which no gap is a blank for sure, and chains (with blanks) of which only a lattice can tell."""
        glued, chains, n = [], [], len(gaps)
        i = 0
        while i < n:
            j = i
            parts, open_ = [tokens[i]], False
            while j < n:
                if gaps[j] == _NOTHING:
                    parts[-1] += tokens[j + 1]
                elif _NUMBER.match(tokens[j]) or _NUMBER.match(tokens[j + 1]) or (len(tokens[j]) > 2 and tokens[j][-1] in SEPARATORS):
                    # a plain number, or a word before a mark, is no piece of a word
                    break
                else:
                    parts.append(tokens[j + 1])
                    open_ = True
                j += 1
            if not open_:
                if j > i:
                    glued.append(parts[0])
            else:
                if len(parts) <= j - i:
                    glued += parts
                letters = " ".join(parts).rstrip(_BEHIND).lstrip(_BEFORE).translate(FOLDS)
                if len(parts) <= 3 and letters.isascii() and letters.replace(" ", "").isalpha():
                    parts = letters.split(" ")
                    for choice in self.patterns(parts) if len(parts) > 1 else ():
                        word = parts[0]
                        for part, nothing in zip(parts[1:], choice):
                            if nothing:
                                word += part
                            else:
                                glued.append(word)
                                word = part
                        glued.append(word)
                elif self.may_join(parts):
                    chains.append(" ".join(parts))
            i = j + 1
        return glued, chains

    def words(self, tokens: list[str]) -> tuple[list[str], list[str]]:
        """``run`` over all tokens of a text."""
        gaps = list(map(self.__getitem__, zip([t[-2:] for t in tokens], [t[:2] for t in tokens[1:]])))
        glued, chains, n = [], [], len(gaps)
        i = 0
        while i < n:
            if not gaps[i]:
                i += 1
                continue
            j = i
            while j < n and gaps[j]:
                j += 1
            more, others = self.run(tokens[i : j + 1], gaps[i:j])
            glued += more
            chains += others
            i = j + 1
        return glued, chains


_NUMBER = re.compile(r"\d{3,}[.,;:!?]?$")
_PRIME = (1 << 61) - 1
_LETTER = re.compile("[a-z]")
_READ = set("abcdefghijklmnopqrstuvwxyz") | set(LOOK_ALIKES) - SEPARATORS
_FRONT = re.compile(r"^[^a-z0-9@$!|+(€£¡]+")
_BACK = re.compile(r"[^a-z0-9@$]+$")
_EDGE = re.compile(r"^[^a-z0-9@$!|+(€£¡]+|[^a-z0-9@$]+$")
_MARKS = re.compile(r"^([^a-z0-9])\1+|([^a-z0-9])\2+$")
_THRICE = re.compile(r"(\S)\1\1")
_NOISE = re.compile(r"[^a-z]|(.)\1\1")


_SPELT = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
_CUT = re.compile("[" + re.escape("".join(sorted(SEPARATORS))) + "]+")


def restore(token: str, lm: np.ndarray) -> list[str]:
    """What a folded token may stand for; a plain word stands for itself."""
    core = _EDGE.sub("", _MARKS.sub("", token))
    if not token.isascii():
        # letters that the lattice doesn't know stand for themselves
        letters = "".join(filter(str.isalpha, token))
        if letters and not letters.isascii():
            return [letters, *(restore(core, lm) if core.isascii() else [])]
    if not _NOISE.search(core):
        return [core] if core else []
    if " " in core:
        # its tokens are seen by themselves
        seen = {_EDGE.sub("", t) for t in core.split(" ")}
        words = split(core, lm)
        # letters spelt out are also read without the words beside them, and as one word
        for m in _SPELT.finditer(core):
            words += [*split(m[0], lm), *restore(m[0].replace(" ", ""), lm)]
        return [w for w in dict.fromkeys(words) if w not in seen]
    plain = re.sub("[^a-z]", "", core)
    words = [*decode(core, lm), plain]
    if any(c in SEPARATORS for c in core):
        parts = [p for p in _CUT.split(core) if p]
        words += split(core, lm)
        words += [w for p in parts if len(parts) > 1 for w in ([p] if p.isalpha() else decode(p, lm))]
    return [w for w in dict.fromkeys(words) if w]


def features(word: str) -> list[str]:
    """A restored word and its beginnings."""
    return ["=" + word, *["^" + word[:k] for k in BEGINNINGS if len(word) > k]]


def bare(token: str) -> str:
    """A token without marks at its ends that ``restore`` takes off in any case, accents folded."""
    if not token.isalpha():
        token = token.rstrip(_BEHIND).lstrip(_BEFORE)
    return token if token.isascii() else token.translate(FOLDS)


def is_plain(word: str) -> bool:
    """Letters only, none three times in a row."""
    return word.isalpha() and not _THRICE.search(word)


def tokens(text: str | None, gaps: Gaps) -> tuple[set[str], set[str]]:
    """Plain words in a text, joined tokens among them; and what must be restored."""
    words = [t for t in (_RUNS.sub("", t) for t in (text or "").lower().split()) if t]
    glued, chains = gaps.words(words)
    seen = {bare(t) for t in {*words, *glued}} - {""}
    plain = {t for t in seen if is_plain(t)}
    return plain, (seen - plain) | set(chains)


#: A mark that is repeated before or after a token is no part of it.
_RUNS = re.compile(r"^([^\w\s])\1+|([^\w\s])\2+$")
#: Marks that ``restore`` takes from the ends of a token in any case.
_BEHIND = ".,;:!?\"'»”’)]}>-*_"
_BEFORE = ".,;:?\"'«“‘[{<-*_"
BEGINNINGS = (3, 4, 5, 6)


class Looks:
    """What distinct (lower-case) tokens look like; most by Arrow functions, few one by one."""

    def __init__(self, tokens: pa.Array, heads: set[str]):
        names = tokens.to_pylist()
        # marks in a row at an end
        for i in np.flatnonzero(pc.match_substring_regex(tokens, r"^[^\w\s]{2}|[^\w\s]{2}$").to_numpy(zero_copy_only=False)).tolist():
            names[i] = _RUNS.sub("", names[i])
        self.names = fold_all(names)
        folded = pa.array(self.names, pa.large_string())
        flags = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)
        plain = lambda x: flags(pc.ascii_is_alpha(x)) & ~flags(pc.match_substring_regex(x, _TRIPLES))
        behind = pc.utf8_rtrim(folded, _BEHIND)
        trimmed = pc.utf8_ltrim(behind, _BEFORE)
        begin = pa.array(sorted(heads), pa.large_string())
        self.words = trimmed.to_pylist()
        self.some = flags(pc.not_equal(folded, ""))
        self.letters, self.ends, simple = plain(folded), plain(behind), plain(trimmed)
        hit = flags(pc.is_in(pc.utf8_slice_codeunits(trimmed, 0, BEGINNINGS[0]), value_set=begin))
        self.weighs = ~simple | hit
        # words that go on from here weigh nothing
        self.nowhere = self.letters & ~hit & flags(pc.greater_equal(pc.utf8_length(folded), BEGINNINGS[0]))
        self.tail = pc.utf8_slice_codeunits(folded, -2).dictionary_encode()
        self.head = pc.utf8_slice_codeunits(folded, 0, 2).dictionary_encode()


def fold_all(names: list[str]) -> list[str]:
    """Accents folded, as by ``translate(FOLDS)``."""
    if not names:
        return names
    cps = np.frombuffer("\n".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    low = cps < len(_ONE)
    cps[low] = _ONE[cps[low]]
    text = cps.tobytes().decode("utf-32-le", "surrogatepass")
    for cp, plain in _MORE.items():
        text = text.replace(chr(cp), plain)
    return text.split("\n")


_ONE = np.arange(0x250, dtype=np.uint32)
_MORE = {cp: plain for cp, plain in FOLDS.items() if len(plain) > 1}
for _cp, _plain in FOLDS.items():
    if len(_plain) == 1:
        _ONE[_cp] = ord(_plain)
_TRIPLES = "|".join(chr(c) * 3 for c in range(97, 123))


@dataclass
class Model:
    lm: np.ndarray
    weight: dict[str, float]  # of each telling feature
    coef: np.ndarray  # of strongest word, its excess over STRONG, damped sum of the others, constant
    prior: float = 0.0
    cache: dict = field(default_factory=dict, repr=False)
    gaps: Gaps | None = field(default=None, repr=False)
    heads: set = field(default_factory=set, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "cache": {}, "gaps": None, "heads": set()}

    def plain(self, word: str) -> float:
        get = self.weight.get
        return max(map(get, features(word), itertools.repeat(0.0)))

    def word(self, token: str) -> float:
        return max(map(self.plain, restore(fold_text(token), self.lm)), default=0.0)

    def weigh(self, word: str) -> float:
        """Weight of a bare token, chain or plain word."""
        if is_plain(word):
            return self.plain(word) if word[: BEGINNINGS[0]] in self.heads else 0.0
        got = self.cache.get(word)
        if got is None:
            got = self.word(word)
            if len(word) <= CACHED:
                self.cache[word] = got
        return got

    def evidences(self, texts: pa.Array) -> np.ndarray:
        """Of every text: weight of the strongest word, and the damped sum over all others.

        Distinct tokens of a batch are looked at once; of their places only those where a gap may be nothing, or a
        word weighs something.
        """
        if self.gaps is None:
            self.gaps = Gaps(self.lm)
            # how telling features begin: hardly any word needs more than a look here
            self.heads = {k[1 : 1 + BEGINNINGS[0]] for k in self.weight}
        if len(self.cache) > CACHE:
            self.cache.clear()
        lists = pc.utf8_split_whitespace(pc.utf8_lower(texts.fill_null("").cast(pa.large_string())))
        coded = lists.flatten().dictionary_encode()
        looks = Looks(coded.dictionary, self.heads)
        names, words = looks.names, looks.words
        weight = np.zeros(len(names))
        for i in np.flatnonzero(looks.weighs).tolist():
            weight[i] = self.weigh(words[i]) if words[i] else 0.0
        code = coded.indices.to_numpy()
        doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        some = looks.some[code]
        code, doc = code[some], doc[some]
        found: list[dict[str, float]] = [{} for _ in range(len(texts))]
        for i in np.flatnonzero(weight[code]).tolist():
            found[doc[i]][words[code[i]]] = weight[code[i]]
        state, thrice = self.gaps.between(looks, code)
        state[doc[1:] != doc[:-1]] = _BLANK
        # runs of gaps that may be nothing
        edge = np.diff(np.concatenate([[0], state != _BLANK, [0]]).astype(np.int8))
        i, j = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # of a run of letters only that is one word for sure the beginning tells whether it may weigh something
        total = lambda x: np.concatenate([[0], np.cumsum(x)])
        odd, open_ = total(~looks.letters[code]), total((state == _EITHER) | thrice)
        sure = (odd[j] == odd[i]) & looks.ends[code[j]] & (open_[j] == open_[i]) & looks.nowhere[code[i]] if len(i) else np.zeros(0, bool)
        for i, j in zip(i[~sure].tolist(), j[~sure].tolist()):
            glued, chains = self.gaps.run([names[k] for k in code[i : j + 1]], state[i:j].tolist())
            for w in [*map(bare, glued), *chains]:
                x = self.weigh(w) if w else 0.0
                if x:
                    found[doc[i]][w] = x
        out = np.zeros((len(texts), 2))
        for d, got in enumerate(found):
            if got:
                total = 0.0
                # the others count less the more that are stronger
                for w in sorted(got.values()):
                    total, most = total * DAMP + w, w
                out[d] = most, (total - most) / DAMP
        return out

    def evidence(self, text: str | None) -> tuple[float, float]:
        return tuple(self.evidences(pa.array([text], pa.large_string()))[0].tolist())

    def scores(self, texts: pa.Array) -> np.ndarray:
        e = self.evidences(texts)
        z = e @ self.coef[[0, 2]] + self.coef[1] * np.maximum(0.0, e[:, 0] - STRONG) + self.coef[3]
        return 1 / (1 + np.exp(-np.clip(z, -30.0, 30.0)))

    def score(self, text: str | None) -> float:
        return float(self.scores(pa.array([text], pa.large_string()))[0])


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Coefficients (the last is the constant) by Newton's method, lightly regularised."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1e-2)
    ridge[-1] = 1e-4
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        d = np.linalg.solve(h, g)
        w -= d * min(1.0, 4.0 / max(1e-9, np.abs(d).max()))
        if np.abs(d).max() < 1e-8:
            break
    return w


def lexicon(at: list[str], df: np.ndarray, n: np.ndarray) -> dict[str, float]:
    """Weights of the features ``at`` from document frequencies ``df[class, feature]`` among ``n[class]`` documents.

    The lower 95 % limit of the log-odds; features in fewer than three toxic documents, or in under 0.2 % of them, weigh nothing.
    """
    t, c = df[1].astype(float), df[0].astype(float)
    odds = np.log((t + 0.5) / (n[1] - t + 0.5)) - np.log((c + 0.5) / (n[0] - c + 0.5))
    limit = odds - 1.96 * np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
    ok = (t >= max(3, 0.002 * n[1])) & (limit > 1.0)
    return {at[i]: float(limit[i]) for i in np.flatnonzero(ok)}


def signature(texts) -> np.ndarray:
    """Least hash of each text's runs of three words (of its words, if fewer): near copies mostly agree on it."""
    data, off = X.buffers(texts)
    words = X.scan(data, off, X.SPACED)
    out = np.full(len(off) - 1, np.iinfo(np.uint64).max, np.uint64)
    for k in (3, 1):
        h, docs, _ = X.windows(words, k)
        at = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, int)
        mine = docs[at]
        empty = out[mine] == np.iinfo(np.uint64).max
        least = np.minimum.reduceat(h, at) if len(at) else np.zeros(0, np.uint64)
        out[mine[empty]] = least[empty]
    return out.view(np.int64)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """``docs`` are all documents (for the character model); ``labels`` the rows to learn from."""
    spark = docs.sparkSession
    lm = char_model(docs, text)
    marks = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = marks.orderBy(F.xxhash64(F.col("k").cast("string")), "k").limit(sample)
    known = {r.k: r.y for r in chosen.collect()}
    ys = list(known.values())
    if known:
        # at most ``sample`` keys, and a text for each
        ids = F.broadcast(spark.createDataFrame(list(known.items()), marks.schema))
        texts = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).filter("t is not null").join(ids, "k")
        fold = (F.crc32(F.col("k").cast("string").cast("binary")).bitwiseAND(F.lit(0x7FFF)) % FOLDS_N).cast("int")
        labelled = keep(texts.groupBy("k", "y").agg(F.min("t").alias("t")).select("k", "y", (F.col("y") * FOLDS_N + fold).alias("g"), "t"), "labelled")
        # one row of those with the same signature and label, so that copies do not vouch for each other's words
        first: dict = {}
        for r in sorted(map_text(labelled, "t", ["k", "y"], fields("s bigint"), lambda part: [signature(part)]).collect(), key=lambda r: r.k):
            first.setdefault((r.s, r.y), (r.k, r.y))
        ys = [y for _, y in first.values()]
        if len(set(ys)) < 2:
            forget(labelled)
    share = sum(ys) / len(ys) if ys else 0.0
    odds = math.log(max(share, 1e-9) / max(1 - share, 1e-9))
    none = Model(lm, {}, np.array([0, 0, 0, max(-30.0, odds)]), share)
    if not ys or share in (0.0, 1.0):
        return none
    rows = labelled.join(F.broadcast(spark.createDataFrame([(k,) for k, _ in first.values()], marks.select("k").schema)), "k").select("g", "t")
    letters = spark.sparkContext.broadcast(lm)

    def count(batches):
        df: dict[int, Counter] = {}
        cache: dict[str, list[str]] = {}
        gaps, model = Gaps(letters.value), letters.value
        for batch in batches:
            for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                plain, noisy = tokens(t, gaps)
                seen = {k for w in plain for k in features(w)}
                for token in noisy:
                    got = cache.get(token)
                    if got is None:
                        got = [k for w in restore(fold_text(token), model) for k in features(w)]
                        if len(cache) < CACHE and len(token) <= CACHED:
                            cache[token] = got
                    seen.update(got)
                df.setdefault(g, Counter()).update(seen)
                if sum(map(len, df.values())) > CACHE:
                    yield from send(df)
                    df = {}
        yield from send(df)

    def send(df):
        for g, seen in df.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(seen), pa.int32()), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["g", "at", "n"])

    n = np.zeros(2 * FOLDS_N, np.int64)
    for r in rows.groupBy("g").count().collect():
        n[r[0]] = r[1]
    n = n.reshape(2, FOLDS_N)
    sums = [F.coalesce(F.sum(F.when(F.col("g") == g, F.col("n"))), F.lit(0)).alias(f"n{g}") for g in range(2 * FOLDS_N)]
    toxic, other = (F.sum(F.when((F.col("g") >= FOLDS_N) == y, F.col("n")).otherwise(0)) for y in (True, False))
    # what may weigh something in some lexicon: in enough toxic documents, and more often there than elsewhere; at most
    # 500 per beginning and toxic document on average, and as a rule a few thousand in all
    counted = rows.mapInArrow(count, "g int, at string, n bigint").groupBy("at").agg(*sums, toxic.alias("t"), other.alias("c"))
    least = max(3, 0.0016 * float(n[1].sum()))
    got = counted.filter((F.col("t") >= least) & (F.col("t") * float(n[0].sum()) > F.col("c") * float(n[1].sum()))).drop("t", "c").collect()
    letters.destroy()
    at = [r.at for r in got]
    df = np.array([list(r[1:]) for r in got], np.int64).reshape(-1, 2, FOLDS_N).transpose(1, 2, 0)
    model = Model(lm, lexicon(at, df.sum(axis=1), n.sum(axis=1)), np.zeros(4), share)
    # a row's evidence for the regression comes from a lexicon that has not seen its fold
    others = [Model(lm, lexicon(at, df.sum(axis=1) - df[:, k], n.sum(axis=1) - n[:, k]), np.zeros(4)) for k in range(FOLDS_N)]
    shipped = spark.sparkContext.broadcast(others)

    def look(batches):
        for batch in batches:
            for at, part in X.pieces(batch.column(1)):
                g = batch.column(0).slice(at, len(part)).to_numpy()
                for k in np.unique(g % FOLDS_N):
                    mine = np.flatnonzero(g % FOLDS_N == k)
                    e = shipped.value[k].evidences(part.take(pa.array(mine)))
                    yield pa.RecordBatch.from_arrays([pa.array(g[mine] // FOLDS_N, pa.int32()), pa.array(e[:, 0]), pa.array(e[:, 1])], ["y", "a", "b"])

    seen = np.array(rows.mapInArrow(look, "y int, a double, b double").collect(), float)
    shipped.destroy()
    forget(labelled)
    seen = seen[np.lexsort(seen.T)]
    model.coef = logistic(np.column_stack([seen[:, 1], np.maximum(0, seen[:, 1] - STRONG), seen[:, 2]]), seen[:, 0])
    return model


def rate(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``score`` beside carried columns (see ``map_text``)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        return [shipped.value.scores(texts)]

    return map_text(docs, text, carry, fields("score double"), run)
