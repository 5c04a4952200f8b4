"""Secret scan: base patterns, and sliding-window Shannon entropy over candidate strings.

Base spans (character positions, end exclusive, whole matches): ``assign``,
``access`` and ``hex``, leftmost non-overlapping within each kind.

The entropy method takes every run of characters that keys are written in, of
WINDOW characters or more, and slides a window over it.  Counts of the window's
characters, and the entropy from them, are updated by one character in and one
out.  For each character class (hexadecimal, letters and digits, base64) every
maximal stretch of it in the run is judged by the class's own threshold, so a key
glued to a name by ``=`` counts as it would alone, and is flagged from its first to
its last window above the threshold; spans that overlap become one.  The
allow-list suppresses what is random-looking but public: words without digits in
one case, plain numbers, UUIDs, host names and paths, and runs that repeat few
characters.

Edge cases: null and empty texts have no spans.  Every input row gives one row,
repeated rows too; an empty table gives none.  Long texts and runs are read whole, at a
cost in proportion to their length.  Equal spans of several kinds stand in the order of
the kinds.  Ids of any type pass through unchanged; nothing but the id and text columns
is read, whatever the others' names.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_worker, small_batches, table, worker_of

# The base patterns, kinds in their order.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
ASSIGN_MIN, ACCESS_MIN = 8, 16

WINDOW = 20
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
#: Class, its characters, bits per character from which a window counts.
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]{%d,}" % WINDOW), 2.9),
    ("alnum", re.compile(r"[A-Za-z0-9]{%d,}" % WINDOW), 3.6),
    ("base64", _RUN, 3.7),
)
_ALLOWED = (
    re.compile(r"[0-9]+"),
    re.compile(r"[A-Z]?[a-z]+|[A-Z]+"),
    re.compile(r"[A-Z]?[a-z]*(?:[-_/=+][A-Z]?[a-z]*)*"),
    re.compile(r"[0-9]+(?:[-/][0-9]+)*"),
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
)
_C_LOG_C = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 2)]


def window_entropy(run: str) -> Iterator[float]:
    """Entropy in bits of each window of WINDOW characters, by incremental counts: H = log2 W - sum(c log2 c) / W."""
    count: dict[str, int] = {}
    total = 0.0
    for i, ch in enumerate(run):
        c = count.get(ch, 0)
        total += _C_LOG_C[c + 1] - _C_LOG_C[c]
        count[ch] = c + 1
        if i >= WINDOW:
            old = run[i - WINDOW]
            c = count[old]
            total += _C_LOG_C[c - 1] - _C_LOG_C[c]
            count[old] = c - 1
        if i >= WINDOW - 1:
            yield math.log2(WINDOW) - total / WINDOW


def entropy_spans(text: str) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for m in _RUN.finditer(text):
        run, found, seen = m[0], [], set()
        for _, chars, least in CLASSES:
            for part in chars.finditer(run):
                # a stretch of a narrower class is judged by that class only
                if part.span() in seen or any(p.fullmatch(part[0]) for p in _ALLOWED):
                    continue
                seen.add(part.span())
                over = [i for i, h in enumerate(window_entropy(part[0])) if h >= least]
                if over:
                    found.append((m.start() + part.start() + over[0], m.start() + part.start() + over[-1] + WINDOW))
        for s, e in sorted(found):
            if out and s < out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], e))
            else:
                out.append((s, e))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as an index of KINDS, end), sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def find_spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: the method's own are those that no base span holds."""
    if not text:
        return [], []
    base = base_spans(text)
    own = entropy_spans(text)
    if base and own:
        starts, ends = [b for b, _, _ in base], list(itertools.accumulate((e for _, _, e in base), max))
        # the base spans that begin by s reach ends[i] at most
        own = [(s, e) for s, e in own if not (i := bisect.bisect_right(starts, s)) or ends[i - 1] < e]
    return base, sorted(base + [(s, 3, e) for s, e in own])


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [find_spans(t) for t in b.column("text").to_pylist()]
            n = [pa.array([sum(k == want for _, k, _ in every) for _, every in rows], pa.int64()) for want in range(4)]
            digests = pa.array([hashlib.sha256(_named(x).encode()).hexdigest() for x, _ in rows], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id"), *n[:3], digests, pa.array([_named(x) for _, x in rows], pa.string()), n[3]], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(in_worker("secrets", run), f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[{kind}]") -> DataFrame:
    """docs with every span of the text replaced by its masked kind; overlapping spans become one. All columns and rows stay."""
    names = docs.columns
    small_batches(docs.sparkSession)

    def clean(text):
        if not isinstance(text, str) or not (spans := find_spans(text)[1]):
            return text
        out, at = [], 0
        for s, k, e in spans:
            if s >= at:
                out += [text[at:s], mask.format(kind=KINDS[k])]
            at = max(at, e)
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        worker_of("secrets")
        return texts.map(clean)

    return docs.select(*(masked(F.col(c)).alias(c) if c == text_col else F.col(c) for c in names))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
