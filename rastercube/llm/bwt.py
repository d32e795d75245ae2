"""Repeated strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

``common_prefixes`` takes the transform of a text and derives the common prefixes of neighbours in its suffix array in
increasing order: breadth first, the intervals of all strings of one length are extended backwards by one symbol, and
where a new interval ends, the common prefix is the length reached. It stops at the minimum length; boundaries that are
still open then have a common prefix of that length or more, which is all that dedup asks.

A corpus has no single transform: its transform is sharded. Its windows of 200 bytes are cut into segments by anchors
(see ``anchors``), and equal windows have equal anchors, so different segments with one anchor meet in one block; a block
has its transform and its expansion, and no repeated string is split over blocks. Segments that are equal as a whole, by
a 128-bit digest, are repeated without a look inside. An anchor with very many different segments is cut finer, level by
level, until its parts fit blocks, and these are expanded like any other.

Every byte of a string of 200 bytes that also starts anywhere else, in the same document or another, goes; strings are
judged on the input, not on what is left; matches never cross documents.

Cases: a null, empty or short text loses nothing; a null doc_id and rows with one doc_id are rows of their own, so of
equal rows all repeated bytes go; an empty table gives an empty result; other columns are ignored. A very long text is
held by one task at a time, with about forty times its size; repeated stretches travel as ranges, not byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Parsed, covered, mark, mixed, ranges, settle, shared_segments, unmarked, with_marks
from .common import keyed, materialize, per_batch

WINDOW, GRAM = 200, 48
#: Different segments of one anchor that may share a block before it is cut finer, and bytes a block is meant to have.
CROWD, BLOCK = 256, 1 << 20
#: Bytes of a block that are expanded at a time, in whole anchors: a piece takes about 100 times its size, however much was dealt to the block.
PIECE = 1 << 18
_B = 0x9E3779B97F4A7C15
_INVERSE = pow(_B, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of an odd base and of its inverse modulo 2**64, kept for the worker's next texts."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_B, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def parse(text: bytes) -> Parsed:
    n = len(text)
    if n < WINDOW:
        return Parsed(n, np.zeros(0, np.uint64), WINDOW, GRAM, lambda a, b: b"")
    up, down = _power(n)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * down, out=s[1:])
    grams = mixed((s[GRAM:] - s[:-GRAM]) * up[: n - GRAM + 1])
    view = memoryview(text)
    return Parsed(n, grams, WINDOW, GRAM, lambda a, b: view[a:b])


# --- the transform of a block


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array of symbols below 512, right as far as ``depth`` symbols: prefix doubling, in which only suffixes
    that still have equals are sorted again."""
    n = len(text)
    padded = np.concatenate([text.astype(np.int64), np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = key << 9 | padded[j : j + n]
    have = 7
    order = np.argsort(key)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1  # the end of the text
    slots, key = np.arange(n), key[order]
    while True:
        # slots of the order that hold suffixes with equals, and where their groups begin
        new = np.concatenate([[True], key[1:] != key[:-1]])
        start = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        rank[order[slots]] = start
        alone = new & np.append(new[1:], True)
        slots, start = slots[~alone], start[~alone]
        if have >= depth or not len(slots):
            return order
        some = order[slots]
        key = start * (n + 2) + rank[np.minimum(some + have, n)] + 1
        by = np.argsort(key)
        order[slots], key = some[by], key[by]
        have *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """lcp[i] of suffixes order[i - 1] and order[i] where it is below ``least``, else -1, for i from 0 to n."""
    n = len(text)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    back = rank[order - 1]  # where the suffix that is longer by one symbol stands
    symbol = text[order - 1].astype(np.int64)  # the transform
    lcp = np.full(n + 1, -1, np.int64)
    lcp[0] = 0
    lb, rb = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for length in range(least):
        size = rb - lb
        total = int(size.sum())
        at = np.repeat(lb - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)
        key = np.repeat(np.arange(len(lb)) << 9, size) + symbol[at]
        by = np.argsort(key, kind="stable")  # nearly sorted as it is
        key = key[by]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        lb = np.minimum.reduceat(back[at[by]], start)
        rb = lb + np.diff(np.append(start, total))
        open_ = lcp[rb] < 0
        lb, rb = lb[open_], rb[open_]
        lcp[rb] = length
        if not len(lb):
            break
    return lcp


def repeated_windows(segments: list[bytes], known: list[bool]) -> list[np.ndarray]:
    """For each segment, the places at which a window starts that another place has too, or a known segment has."""
    sizes = np.array([len(s) + 1 for s in segments])
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int64) + 1
    text[base + sizes - 1] = 0
    order = suffix_order(text, WINDOW)
    lcp = common_prefixes(text, order, WINDOW)
    group = np.cumsum(lcp[:-1] >= 0)  # suffixes with one prefix of WINDOW symbols
    owner = np.repeat(np.arange(len(segments)), sizes)[order]
    place = order - base[owner]
    fits = place + WINDOW < sizes[owner]
    weight = np.where(fits, 1 + np.array(known, np.int64)[owner], 0)
    hit = fits & (np.bincount(group, weights=weight)[group] > 1)
    by = np.argsort(owner[hit], kind="stable")
    return np.split(place[hit][by], np.cumsum(np.bincount(owner[hit], minlength=len(segments)))[:-1])


def _solve(t: pa.Table) -> pa.Table:
    known, firsts = t["known"].to_pylist(), t["first"].to_pylist()
    keys = np.array(t["_key"].to_pylist(), np.int64)
    found = [np.zeros(0, np.int64) if k else x + f for x, f, k in zip(repeated_windows(t["bytes"].to_pylist(), known), firsts, known, strict=True)]
    key, at = np.repeat(keys, list(map(len, found))), np.concatenate([np.zeros(0, np.int64), *found])
    by = np.lexsort((at, key))
    return ranges(key[by], at[by])


# --- the corpus


def _result(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, str]:
    gone = covered(len(text), starts, ends)
    raw = np.frombuffer(text, np.uint8)
    spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
    return len(text), int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()


_NONE = np.zeros(0, np.int64)
_NAMES = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
_OPEN = ("z", "starts", "ends", "seed", "kin", "known", "first", "bytes")
_FIRST = "_key long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, z binary, starts array<int>, ends array<int>, seed array<long>, kin array<long>, known array<boolean>, first array<int>, bytes array<binary>"


def _first(batch: pa.RecordBatch) -> dict:
    """Whole segments that are repeated go; documents with segments to look into carry these and stay open."""
    unzip, out = zstandard.ZstdDecompressor(), []
    for z, marks in zip(batch.column("z").to_pylist(), batch.column("marks").to_pylist(), strict=True):
        text = unzip.decompress(z)
        if not marks:
            out.append((*_result(text, _NONE, _NONE), *[None] * 8))
            continue
        p, (ord_, kin, again) = parse(text), unmarked(marks)
        full, look = ord_[again], kin > 1
        starts, ends = p.first[full], p.last[full] + WINDOW
        known, at = again[look], ord_[look]
        parts = [bytes(p.slice(a, b + WINDOW)) for a, b in zip(p.first[at].tolist(), p.last[at].tolist(), strict=True)]
        open_ = len(at) and not known.all()  # else all that is looked into is repeated already
        out.append((*((0, 0, 0, "") if open_ else _result(text, starts, ends)), z if open_ else None, starts, ends, p.seed[at], kin[look], known, p.first[at], parts))
    return {"_key": batch.column("_key"), "doc_id": batch.column("doc_id")} | dict(zip((*_NAMES, *_OPEN), zip(*out, strict=True) if out else [[]] * 12, strict=True))


def _second(batch: pa.RecordBatch) -> dict:
    unzip, out = zstandard.ZstdDecompressor(), []
    for z, starts, ends, more in zip(*(batch.column(c).to_pylist() for c in ("z", "starts", "ends", "more")), strict=True):
        a, b = np.array([(r["a"], r["b"]) for r in more or ()], np.int64).reshape(-1, 2).T
        out.append(_result(unzip.decompress(z), np.concatenate([np.array(starts, np.int64), a]), np.concatenate([np.array(ends, np.int64), b + WINDOW])))
    return {"doc_id": batch.column("doc_id")} | dict(zip(_NAMES, zip(*out, strict=True) if out else [[]] * 4, strict=True))


def remove_repeats(docs: DataFrame, crowd: int = CROWD, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the kept bytes of every row of ``docs``."""
    docs = keyed(docs, "text")
    rows, kinds, tables = shared_segments(docs, parse)
    # of a segment that occurs twice or more all are repeated; its first one stands for it among those of its anchor
    few = kinds.where("n > 1").select("seed", "h", "g", "n", "kin", "first")
    stands = F.when(F.struct("_key", "ord") == F.col("first"), F.col("kin")).otherwise(1)
    full = rows.join(few, ["seed", "h", "g"]).select("_key", mark(stands, True))
    single = kinds.where("n = 1 AND kin > 1").select("first.*", "kin").select("_key", mark(F.col("kin"), False))
    first = materialize(per_batch(with_marks(docs, full.unionByName(single)), _first, _FIRST), "segmented", done=tables)
    parts = first.where("size(seed) > 0").select("_key", F.inline(F.arrays_zip("seed", "kin", "first", "known", "bytes")))
    more = settle(parts, parse, _solve, earliest=False, crowd=crowd, block=block, piece=piece)
    more = more.groupBy("_key").agg(F.collect_list(F.struct("a", "b")).alias("more"))
    rest = first.where("z is not null").select("_key", "doc_id", "z", "starts", "ends").join(more, "_key", "left")
    done = first.where("z is null").select("doc_id", *_NAMES)
    return done.unionByName(per_batch(rest, _second, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def op9_bwt_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
