"""Toxicity by a learned lexicon, matched through Levenshtein automata over a trie.

Learning (training rows of ``labels`` only).  Words and word beginnings are
counted in all toxic and all clean training texts; those that mark toxic texts
by the likelihood ratio of their counts become terms (whole words) and stems
(beginnings that several toxic words share).  A second pass matches the lexicon
against FIT_SAMPLE training texts and learns the weight of misspellings, and a
logistic layer over a text's hits, their density, and how far they are quoted.

Matching.  The lexicon is a trie; a state is the set of (trie node, edits) that
the Levenshtein automata of all terms can be in, so one run over a word matches
every term at once.  States are built on demand and kept.  A term of 5 letters
or more may differ by one edit, of 9 or more by two; the first letter must
match; a stem matches any word that begins with it, or with a misspelling of it
by the same rule.  The known toxic forms of a stem are terms too, so that a
misspelling is judged by the length of the whole word.  Before the automaton, all
new words of a chunk are looked up together among the terms and stems with as many
letters left out as they allow edits: near words always share such a rest, so only
words without are spared.  The rests are compared by hashes that follow from the sums
of a word's beginnings; a hash that is equal by chance costs a run, never a match.

Context.  Each place of a hit is read with a window of CONTEXT words on both sides and
gets a score from 0 (abuse) to 1 (quotation): 1 between quotation marks, less the
further a reporting word stands before it, else 0.  The share of a text's weight that
is quoted is an input of the logistic layer, which learns what it means.

At most SAMPLE labelled rows are used for the lexicon and FIT_SAMPLE of them for
the logistic layer (those with the smallest hash of their id); above these bounds
the fit is on a sample.  Labels, lang, source and ids are
never inputs of a score.

Edge cases: null and empty texts have no hits and get the score of a text
without hits.  Without training rows every score is 0.5.  A null id belongs to the
training fold but has no label.  Every input row gives one row, repeated rows too; an
empty table gives none.  Ids of any type pass through unchanged.  Long texts are read
whole.  Equal texts get equal scores.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_worker, small_batches, small_side, stored, table, worker_caches, worker_of
from .words import CHUNK, runs

SAMPLE = 200_000
MIN_DOCS = 8
MIN_RATIO = 4.0
MIN_GAIN = 20.0
FIT_SAMPLE = 20_000
MIN_FORMS = 3
STEM = (4, 8)
CONTEXT = 6
THRESHOLD = 0.7
WORD = re.compile(r"[^\W_]+")

# Words that introduce somebody else's words.
REPORTING = frozenset("said says wrote writes quote quoted quotes called calls word term phrase reported zitat sagte schrieb nannte wort dijo escribió llamó palabra cita dit écrit appelé mot citation".split())
_OPEN, _CLOSE = "\"'“„«‘‹", "\"'”“»’›"


_P = np.uint64(0xD1342543DE82EF95)
_BACK = np.array([pow(int(_P), -k, 1 << 64) for k in range(3)], dtype=np.uint64)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _sums(words: list[str], n: int) -> np.ndarray:
    """Hashes of all beginnings of words of n letters; column j is that of j letters."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.uint64)
    power = np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, _P)))
    return np.hstack([np.zeros((len(words), 1), np.uint64), np.cumsum((codes + _SPREAD) * power, axis=1, dtype=np.uint64)])


def _rests(sums: np.ndarray, n: int, k: int) -> Iterator[np.ndarray]:
    """Hashes of the first n letters with up to k (0 to 2) letters after the first left out."""
    whole = sums[:, n : n + 1]
    yield whole
    if k and n > 1:
        yield sums[:, 1:n] + _BACK[1] * (whole - sums[:, 2 : n + 1])
    if k > 1:
        for i in range(1, n - 1):
            yield sums[:, i : i + 1] + _BACK[1] * (sums[:, i + 1 : n] - sums[:, i + 1 : i + 2]) + _BACK[2] * (whole - sums[:, i + 2 : n + 1])


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Lengths, and which words have them."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        if len(part):
            yield int(size[part[0]]), part


class Rests:
    """Hashes of what words leave with up to k letters left out: a bit set of them, then the sorted hashes."""

    def __init__(self, words: list[str], k: int):
        self.k, self.low, self.high = k, min(map(len, words)), max(map(len, words))
        found = [x.ravel() for n, i in _by_length(words) for x in _rests(_sums([words[j] for j in i], n), n, k)]
        self.hashes = np.unique(np.concatenate(found))
        self.shift = np.uint64(64 - max(16, len(self.hashes).bit_length() + 8))
        self.bits = np.zeros(1 << int(61 - self.shift), np.uint8)
        at = self.hashes * _SPREAD >> self.shift
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8), dtype=np.uint8))

    def any(self, sums: np.ndarray, n: int) -> np.ndarray:
        """Which words have one of the hashes in the rests of their first n letters."""
        out = np.zeros(len(sums), bool)
        for rest in _rests(sums, n, self.k):
            at = rest * _SPREAD >> self.shift
            row, col = np.nonzero(self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
            h = rest[row, col]
            i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            out[row[self.hashes[i] == h]] = True
        return out


class Matcher:
    """Union of the Levenshtein automata of all terms, intersected with their trie; determinised on demand."""

    KEEP = 200_000  # words that were run
    STATES = 20_000
    SPAN = 24  # longer words go to the automaton without a look at their deletions

    def __init__(self, terms: list[str], stems: list[str]):
        self.allowed = {t: self.edits(t) for t in terms}
        self.stem_allowed = {s: self.edits(s) for s in stems}
        self.child: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.budget: list[int] = [0]  # most edits that any term below allows
        for kind, words, allowed in ((self.term, terms, self.allowed), (self.stem, stems, self.stem_allowed)):
            for w in words:
                at, most = 0, allowed[w]
                for ch in w:
                    if ch not in self.child[at]:
                        self.child[at][ch] = len(self.child)
                        self.child.append({})
                        self.term.append(None)
                        self.stem.append(None)
                        self.budget.append(0)
                    at = self.child[at][ch]
                    self.budget[at] = max(self.budget[at], most)
                kind[at] = w
        self.near: list[tuple[bool, Rests]] = []  # of stems or of terms
        for of_stems, allowed in ((False, self.allowed), (True, self.stem_allowed)):
            for k in sorted(set(allowed.values())):
                words = [w for w, e in allowed.items() if e == k and (of_stems or len(w) <= self.SPAN + k)]
                if words:
                    self.near.append((of_stems, Rests(words, k)))
        self.longest = max((len(t) + e for t, e in self.allowed.items()), default=0)
        self.hits: dict[str, tuple[str, int]] = {}
        self.none: set[str] = set()
        self._reset()

    @staticmethod
    def edits(term: str) -> int:
        return 0 if len(term) < 5 else 1 if len(term) < 9 else 2

    def _reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.accept: list[tuple[str, int] | None] = []
        self.final: list[tuple[str, int] | None] = []
        self._state(frozenset({(0, 0)}))

    def _state(self, positions: frozenset) -> int:
        if positions not in self.states:
            self.states[positions] = len(self.sets)
            self.sets.append(positions)
            self.step.append({})
            stems = sorted((e, self.stem[n]) for n, e in positions if self.stem[n] and e <= self.stem_allowed[self.stem[n]])
            self.accept.append((stems[0][1], stems[0][0]) if stems else None)
            ends = sorted((e, self.term[n]) for n, e in positions if self.term[n] and e <= self.allowed[self.term[n]])
            self.final.append((ends[0][1], ends[0][0]) if ends else None)
        return self.states[positions]

    def _next(self, state: int, ch: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            if ch in self.child[node]:
                out.add((self.child[node][ch], e))
            if node:
                if e < self.budget[node]:
                    out.add((node, e + 1))  # the text has one letter more
                out.update((kid, e + 1) for c, kid in self.child[node].items() if c != ch and e < self.budget[kid])
        stack = list(out)
        while stack:  # the text lacks a letter
            node, e = stack.pop()
            for kid in self.child[node].values():
                if e < self.budget[kid] and (kid, e + 1) not in out:
                    out.add((kid, e + 1))
                    stack.append((kid, e + 1))
        best: dict[int, int] = {}
        for node, e in out:
            best[node] = min(e, best.get(node, e))
        return self._state(frozenset(best.items()))

    def run(self, word: str) -> tuple[str, int] | None:
        """(term or stem, edits) that the word matches best; a stem without edits first, then a term before a stem of as many edits."""
        at, near = 0, None
        for ch in word:
            nxt = self.step[at].get(ch)
            if nxt is None:
                nxt = self.step[at][ch] = self._next(at, ch)
            at = nxt
            begun = self.accept[at]
            if begun and begun[1] == 0:
                return begun
            if begun and (near is None or begun[1] < near[1]):
                near = begun
            if not self.sets[at]:
                return near
        end = self.final[at]
        return end if end and (near is None or end[1] <= near[1]) else near

    def possible(self, words: list[str]) -> np.ndarray:
        """False only for words that run() finds no match of."""
        out = np.zeros(len(words), bool)
        for n, i in _by_length(words):
            if n > self.SPAN:
                # only what begins like a stem, or like a long term
                out[i] = n <= self.longest
                n_sums = max([r.high + r.k for of_stems, r in self.near if of_stems], default=0)
            else:
                n_sums = n
            n_sums = min(n, n_sums)
            if not n_sums:
                continue
            sums = _sums([words[j][:n_sums] for j in i], n_sums)
            for of_stems, rests in self.near:
                if of_stems:
                    for p in range(max(1, rests.low - rests.k), min(n, rests.high + rests.k) + 1):
                        out[i] |= rests.any(sums, p)
                elif n <= self.SPAN and rests.low - rests.k <= n <= rests.high + rests.k:
                    out[i] |= rests.any(sums, n)
        return out

    def learn(self, words: set[str]) -> None:
        """Puts those of the words that match into `hits`; what is known of other words may be forgotten."""
        if len(self.none) + len(self.hits) > self.KEEP:
            self.none, self.hits = set(), {}
        new = sorted(words - self.none - self.hits.keys())
        for w in itertools.compress(new, self.possible(new).tolist()):
            if len(self.sets) >= self.STATES:
                self._reset()
            if got := self.run(w):
                self.hits[w] = got
            else:
                self.none.add(w)

    def match(self, word: str) -> tuple[str, int] | None:
        self.learn({word})
        return self.hits.get(word)


_matchers: dict[str, Matcher] = {}  # of the last model
worker_caches["toxicity"] = _matchers.clear


@dataclass
class Model:
    """Lexicon, log-ratio weights, and the logistic layer over the features of a text."""

    terms: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    weights: dict[tuple[str, int], float] = field(default_factory=dict)  # of (term or stem, edits)
    forms: dict[str, float] = field(default_factory=dict)  # of known words that begin with a stem
    layer: list[float] = field(default_factory=lambda: [0.0] * 6)
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def matcher(self) -> Matcher:
        """One per Python worker: what it has learned of words serves the worker's later tasks."""
        worker_of("toxicity")
        if self.key not in _matchers:
            _matchers.clear()
            _matchers[self.key] = Matcher(self.terms, self.stems)
        return _matchers[self.key]

    def features(self, hits: dict[str, tuple[str, int]], quoted: dict[str, float], n_words: int) -> list[float]:
        w = {word: max(0.0, self.forms.get(word, self.weights.get(m, 0.0)) if m[1] == 0 else self.weights.get(m, 0.0)) for word, m in hits.items()}
        total = sum(w.values())
        share = sum(w[word] * q for word, q in quoted.items()) / total if total else 0.0
        return [1.0, total, max(w.values(), default=0.0), math.log1p(n_words) / 10 if hits else 0.0, 100 * total / (n_words + 20), share]

    def scores(self, texts: list[str | None], matcher: Matcher) -> list[float]:
        out = []
        for hits in find_hits(texts, matcher):
            logit = sum(a * b for a, b in zip(self.layer, self.features(*hits), strict=True))
            out.append(1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, logit)))))
        return out

    def score(self, text: str | None, matcher: Matcher) -> float:
        return self.scores([text], matcher)[0]


def quotation(text: str, words: list[re.Match], i: int) -> float:
    """How far word i is quoted, by the window around it: 1 between an opening and a closing mark, less the further a reporting word stands before it."""
    lo, hi = words[max(0, i - CONTEXT)].start(), words[min(len(words) - 1, i + CONTEXT)].end()
    before, after = text[lo : words[i].start()], text[words[i].end() : hi + 1]
    opened = max((before.rfind(c) for c in _OPEN), default=-1)
    if opened >= 0 and not (before[opened] == "'" and opened and before[opened - 1].isalnum()):
        closing = {"“": "”", "„": "“”", "«": "»", "‹": "›", "‘": "’"}.get(before[opened], before[opened])
        if any(c in after for c in closing) and before.count(before[opened]) % 2 == 1:
            return 1.0
    return max((1.0 - (i - j) / (CONTEXT + 1) for j in range(max(0, i - CONTEXT), i) if words[j][0] in REPORTING), default=0.0)


def find_hits(texts: list[str | None], matcher: Matcher) -> Iterator[tuple[dict[str, tuple[str, int]], dict[str, float], int]]:
    """Of each text the distinct matching words with (term or stem, edits), how far each is quoted (the mean of its places; only what is), and the number of words."""
    low = [t.lower() if t else "" for t in texts]
    every = [WORD.findall(t) for t in low]
    distinct = [set(e) for e in every]
    matcher.learn(set().union(*distinct))
    for text, have, n in zip(low, distinct, map(len, every), strict=True):
        found = {w: matcher.hits[w] for w in sorted(w for w in have if w in matcher.hits)}
        quoted: dict[str, list[float]] = {}
        if found:
            words = list(WORD.finditer(text))
            for i, m in enumerate(words):
                if m[0] in found:
                    quoted.setdefault(m[0], []).append(quotation(text, words, i))
        yield found, {w: sum(q) / len(q) for w, q in quoted.items() if any(q)}, n


def _parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts in runs of about 4 * CHUNK characters."""
    for a, z in runs(np.fromiter((len(t or "") for t in texts), np.int64, len(texts)), 4 * CHUNK):
        yield texts[a:z]


def training_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """id and toxic of the labelled training rows, at most `sample` of them (by the hash of the id)."""
    fold = labels.where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 3 <> 1")
    fold = fold.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    return stored(fold.orderBy(F.xxhash64("id"), "id").limit(sample), "labels")


def _with_text(docs: DataFrame, fold: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), "text").join(small_side(fold), "id").where("text is not null")


def _counts(rows: DataFrame) -> DataFrame:
    """Words and beginnings with how many toxic and clean texts have them, from MIN_DOCS / 2 toxic texts on; stored."""
    word = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    lo, hi = STEM
    r = rows.select("toxic", F.explode(F.filter(word, lambda w: F.length(w) >= 3)).alias("w"))
    n = r.groupBy("w").agg(F.sum("toxic").alias("tox"), F.sum(1 - F.col("toxic")).alias("clean"))
    parts = F.array(F.struct(F.lit(False).alias("stem"), F.col("w").alias("f")), *(F.struct(F.lit(True).alias("stem"), F.when(F.length("w") > k, F.substring("w", 1, k)).alias("f")) for k in range(lo, hi)))
    n = n.select("tox", "clean", F.explode(parts).alias("p")).where("p.f is not null")
    n = n.groupBy("p.stem", "p.f").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean"), F.sum((F.col("tox") > 0).cast("int")).alias("forms"), F.count(F.lit(1)).alias("words"))
    return stored(n.where(F.col("tox") >= MIN_DOCS / 2), "counts")


def _stem_of(word: str, stems: dict) -> str | None:
    return next((word[:k] for k in range(*STEM) if word[:k] in stems), None)


def choose(counts: DataFrame, toxic: int, clean: int) -> tuple[list, list, dict[str, list]]:
    """Terms and stems by the likelihood ratio of their counts, of nested stems the strongest, and the known words of each stem.

    Only what is strong enough is fetched, then the words below the stems.
    """
    if not toxic or not clean:
        return [], [], {}
    tox, clear = F.col("tox").cast("double"), F.col("clean").cast("double")
    share = (tox + clear) * (toxic / (toxic + clean))
    gain = tox * F.log(tox / share) + F.when(clear > 0, clear * F.log(clear / (tox + clear - share))).otherwise(0.0)
    strong = counts.where((tox >= MIN_DOCS) & ((tox + 0.5) * (clean / toxic) >= MIN_RATIO * (clear + 0.5)) & (tox > share)).withColumn("gain", gain)
    strong = strong.where(F.when(F.col("stem"), (F.col("forms") >= MIN_FORMS) & (F.col("gain") >= MIN_GAIN)).otherwise(F.col("gain") >= MIN_GAIN / 2)).collect()
    # of equal gains the first by letters
    stems: dict = {}
    inner: set[str] = set()  # beginnings of the stems
    for c in sorted((c for c in strong if c.stem), key=lambda c: (-c.gain, c.f)):
        if c.f not in inner and _stem_of(c.f, stems) is None:
            stems[c.f] = c
            inner.update(c.f[:k] for k in range(STEM[0], len(c.f)))
    below: dict[str, list] = {s: [] for s in stems}
    if stems:
        names = counts.sparkSession.createDataFrame([(s,) for s in stems], "s string")
        begins = F.array(*(F.substring("f", 1, k) for k in range(*STEM)))
        words = counts.where(~F.col("stem")).select("f", "tox", "clean", F.explode(F.array_distinct(begins)).alias("s"))
        for c in words.join(small_side(names), "s").orderBy("f").collect():
            below[c.s].append(c)
    # a word of its own is no stem: the stem must be carried by several forms, none of which has most of its count
    stems = {f: s for f, s in stems.items() if max((c.tox for c in below[f]), default=0) <= 0.7 * s.tox}
    terms = sorted((c for c in strong if not c.stem and _stem_of(c.f, stems) is None), key=lambda c: c.f)
    return terms, list(stems.values()), {f: below[f] for f in stems}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    b = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9)
        step = np.linalg.solve(h, x.T @ (y - p) - pull * b)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fit_sample: int = FIT_SAMPLE) -> Model:
    small_batches(docs.sparkSession)
    fold = training_labels(labels, sample)
    rows = _with_text(docs, fold)
    size = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic + clean:
        return Model()
    terms, stems, below = choose(_counts(rows), toxic, clean)
    model = Model([c.f for c in terms], [c.f for c in stems])
    ratio = lambda t, c, a=0.5, b=0.5: math.log((t + a) / (toxic + 2 * a)) - math.log((c + b) / (clean + 2 * b))
    for c in terms:
        model.weights[c.f, 0] = ratio(c.tox, c.clean)
    for s in stems:
        each, other = s.tox / s.words, max(s.clean, 0.5) / s.words
        model.weights[s.f, 0] = math.log(each / other) + math.log(clean / toxic) if clean and toxic else 0.0
        for c in below[s.f]:
            model.forms[c.f] = math.log((c.tox + each) / (c.clean + other)) + math.log(clean / toxic)
    forms = sorted(f for f, w in model.forms.items() if w > 0)
    model.weights = {(f, 0): model.forms[f] for f in forms} | model.weights
    few = fold.orderBy(F.xxhash64("id"), "id").limit(fit_sample)
    model.terms += forms
    lexicon = Model(model.terms, model.stems)  # the layer is still to be learned
    model.key = lexicon.key

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        kind = pa.list_(pa.struct([("w", pa.string()), ("t", pa.string()), ("e", pa.int32()), ("q", pa.float64())]))
        for b in batches:
            at = 0
            for texts in _parts(b.column("text").to_pylist()):
                got = list(find_hits(texts, matcher))
                found = pa.array([[(w, t, e, q.get(w, 0.0)) for w, (t, e) in h.items()] for h, q, _ in got], kind)
                yield pa.RecordBatch.from_arrays([b.column("toxic").slice(at, len(texts)), pa.array([n for _, _, n in got], pa.int64()), found], ["toxic", "n", "hits"])
                at += len(texts)

    seen = stored(_with_text(docs, few).select("text", "toxic").mapInArrow(in_worker("toxicity", hits), "toxic int, n long, hits array<struct<w:string,t:string,e:int,q:double>>"), "hits")
    # in how many clean and toxic texts each misspelt term stands: a few rows per term at most
    misspelt = F.array_distinct(F.transform(F.filter("hits", lambda h: h["e"] > 0), lambda h: F.struct(h["t"].alias("t"), h["e"].alias("e"))))
    near: dict[tuple[str, int], list[int]] = {}
    for r in seen.select("toxic", F.explode(misspelt).alias("m")).groupBy("m.t", "m.e", "toxic").count().collect():
        near.setdefault((r.t, r.e), [0, 0])[r.toxic] = r["count"]
    for w in dict.fromkeys(model.terms + model.stems):
        for e in range(1, Matcher.edits(w) + 1):
            c, t = near.get((w, e), (0, 0))
            # a rare misspelling leans on the term's own weight; clean texts that have it take that away
            model.weights[w, e] = (4 * 0.6**e * max(model.weights[w, 0], 0.0) + (t + c) * ratio(t, c)) / (4 + t + c)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for n, found in zip(b.column("n").to_pylist(), b.column("hits").to_pylist(), strict=True):
                rows.append(model.features({h["w"]: (h["t"], h["e"]) for h in found}, {h["w"]: h["q"] for h in found}, n))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])

    rows = seen.mapInArrow(features, "toxic int, x array<double>").collect()  # fit_sample rows of six numbers
    model.layer = _logistic(np.array([r.x for r in rows]), np.array([float(r.toxic) for r in rows])).tolist()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for b in batches:
            got = [x for texts in _parts(b.column("text").to_pylist()) for x in model.scores(texts, matcher)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(got, pa.float64())], ["id", "held_out", "score"])

    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    out = slim.mapInArrow(in_worker("toxicity", run), f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows that score THRESHOLD or more; columns stay."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = model.matcher()
        for texts in batches:
            every = [t if isinstance(t, str) else None for t in texts]
            yield pd.Series([x for part in _parts(every) for x in model.scores(part, matcher)], dtype="float64")

    return docs.where(scored(F.col(text_col)) < THRESHOLD)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
