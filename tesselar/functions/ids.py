"""Unique 64-bit ids without coordination."""

from __future__ import annotations

import re
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed layout: 41 bits of milliseconds, 10 of node, 12 of sequence; compact: 41, 6, 6.
EPOCH_MS = 1764184395000
LAYOUTS = {"standard": (10, 12), "compact": (6, 6)}
JOB_SPAN = 1 << 22


def job_number(spark, path: str) -> int:
    """A number that no other job gets: jobs count by files of the shared folder `path`, each created only if it is new."""
    fs = spark._jvm.org.apache.hadoop.fs
    folder = fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    n = 1 + max((int(s.getPath().getName()) for s in files.listStatus(folder) if s.getPath().getName().isdigit()), default=0)
    while not files.createNewFile(fs.Path(f"{path}/{n}")):
        n += 1
    return n


def unique_id(layout: str = "standard", offset: int = 0, now_ms: int | None = None, job: int | None = None) -> Column:
    """An id per row: the row's number within its partition carries from the sequence into the milliseconds, and the partition is the node.

    More partitions than nodes borrow further milliseconds, so ids of one job are
    distinct.  Jobs that may run at the same time, or within the milliseconds that
    another has borrowed, give their job_number: it takes the upper bits of the
    millisecond, and each job has JOB_SPAN milliseconds of its own.
    """
    node_bits, seq_bits = LAYOUTS[layout]
    if job is None:
        start = (int(time.time() * 1000) if now_ms is None else now_ms) - EPOCH_MS
    else:
        start = job * JOB_SPAN
        if start + JOB_SPAN >= 1 << (63 - node_bits - seq_bits):
            raise ValueError("the layout has no room for further jobs")
    row = F.monotonically_increasing_id()
    part, seq = F.shiftright(row, 33), row.bitwiseAND((1 << 33) - 1)
    rounds = F.shiftright(part, node_bits)
    # a job with a number takes as many milliseconds for a round of nodes as its span allows
    step = 1 << (33 - seq_bits) if job is None else JOB_SPAN >> 8
    ms = F.lit(start) + F.shiftright(seq, seq_bits) + rounds * F.lit(step)
    if job is not None:
        full = (F.shiftright(seq, seq_bits) >= step) | (rounds >= 256)
        ms = F.when(full, F.raise_error(F.lit("more rows in a partition, or more partitions, than a job's ids reach")).cast("long")).otherwise(ms)
    return F.shiftleft(ms, node_bits + seq_bits).bitwiseOR(F.shiftleft(part.bitwiseAND((1 << node_bits) - 1), seq_bits)).bitwiseOR(seq.bitwiseAND((1 << seq_bits) - 1)) + offset


_CALL = re.compile(r"\bunique_id\s*\(\s*\)", re.IGNORECASE)
_QUOTED = re.compile(r"'(?:[^'\\]|\\.)*'|\"[^\"]*\"|`[^`]*`|/\*.*?\*/|--[^\n]*", re.DOTALL)


def with_unique_ids(sql: str, layout: str = "standard", now_ms: int | None = None) -> str:
    """A statement whose calls of unique_id() are expressions, each for ids of its own, evaluated for each row; text in quotes and comments stays."""
    node_bits, seq_bits = LAYOUTS[layout]
    start = (int(time.time() * 1000) if now_ms is None else now_ms) - EPOCH_MS
    calls = 0

    def one(_: re.Match) -> str:
        nonlocal calls
        calls += 1
        row = "monotonically_increasing_id()"
        # calls of one statement lie 2^40 milliseconds / 2^6 apart
        ms = f"({start + ((calls - 1) << 34)} + shiftright({row} & {(1 << 33) - 1}, {seq_bits}) + shiftright({row}, {33 + node_bits}) * {1 << (33 - seq_bits)})"
        return f"(shiftleft({ms}, {node_bits + seq_bits}) | shiftleft(shiftright({row}, 33) & {(1 << node_bits) - 1}, {seq_bits}) | ({row} & {(1 << seq_bits) - 1}))"

    out, at = [], 0
    for m in _QUOTED.finditer(sql):
        out += [_CALL.sub(one, sql[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, _CALL.sub(one, sql[at:])])
