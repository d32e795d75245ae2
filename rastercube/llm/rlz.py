"""Substring dedup by relative Lempel-Ziv parsing over words.

The reference of a document is everything before it: the earlier documents, and itself up to the word at hand. It is
indexed in blocks, by the hash of anchors (see ``anchors``): a block holds every passage around its anchors once, in the
order of its first occurrence, and is indexed by a suffix array of its words. A window of 20 words can only be found in
the block of its own anchor, so a document is parsed, stretch by stretch, against every block that can hold any of it.

A stretch is parsed greedily: at each word the longest earlier match is looked up (the suffix array's neighbours that
stand earlier); a match of at least 20 words is a factor, and the parse goes on behind it; else the word is a literal.
All windows inside a factor are repeated. A window that straddles the end of a factor lies in no factor, so the windows
that start in a factor's last 19 words are checked against the index one by one. Stretches that are equal as a whole to an
earlier one are a factor without a look-up (by a 128-bit digest), however many documents have them.

A window counts as repeated if its words also start earlier (smaller doc_id, or the same document, earlier start); all
words of repeated windows go. Windows are judged on the input, not on what is left.

Cases: a null, empty or short text loses nothing; a null doc_id comes last in the order; rows with one doc_id are
ordered by text, and equal rows each count, the later as a copy of the earlier; an empty table gives an empty result;
other columns are ignored. A very long text is held by one task at a time, with about ten times its size; its stretches
are not.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Parsed, covered, mark, mixed, ranges, settle, shared_segments, unmarked, with_marks
from .common import keyed, materialize, per_batch

WINDOW, GRAM = 20, 6
#: Different stretches of one anchor that may share a block before it is cut finer, and bytes a block is meant to have.
CROWD, BLOCK = 256, 1 << 20
_MIX = np.random.default_rng(7).integers(1 << 62, size=GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def parse(text: bytes) -> Parsed:
    words = text.split()
    n = len(words)
    if n < WINDOW:
        return Parsed(n, np.zeros(0, np.uint64), WINDOW, GRAM, lambda a, b: b"")
    line = memoryview(b" ".join(words))
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)]).tolist()
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    m = n - GRAM + 1
    grams = np.zeros(m, np.uint64)
    for j, c in enumerate(_MIX):
        grams += c * h[j : j + m]
    return Parsed(n, mixed(grams), WINDOW, GRAM, lambda a, b: line[at[a] : at[b] - 1])


# --- a block: its index, and the parse against it


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array of dense ids, right as far as ``depth`` of them; prefix doubling."""
    n = len(ids)
    bits = max(1, int(ids.max(initial=0)).bit_length())
    have = max(1, 62 // (bits + 1))
    padded = np.concatenate([ids + 1, np.zeros(have, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(have):
        key = key << (bits + 1) | padded[j : j + n]
    while True:
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        if have >= depth or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: max(n - have, 0)] = rank[have:] + 1
        key = rank * (n + 2) + after
        have *= 2


def neighbours(ids: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many words suffixes order[i - 1] and order[i] have in common, up to ``depth``; 0 for i = 0."""
    lcp = np.zeros(len(ids), np.int64)
    padded = np.concatenate([ids, np.full(depth, -1)])
    left = np.arange(1, len(ids))
    for k in range(depth):
        left = left[padded[order[left - 1] + k] == padded[order[left] + k]]
        if not len(left):
            break
        lcp[left] = k + 1
    return lcp


def earlier_matches(order: np.ndarray, lcp: np.ndarray, least: int) -> dict[int, int]:
    """Position to the length of its longest match that stands earlier, where that is ``least`` or more."""
    out: dict[int, int] = {}
    stack: list[tuple[int, int]] = []  # positions in increasing order, each with its match with the one below
    hot = lcp >= least
    members = np.flatnonzero(hot | np.append(hot[1:], False))
    for pos, n in zip(order[members].tolist(), np.where(hot, lcp, 0)[members].tolist(), strict=True):
        while stack and stack[-1][0] > pos:
            p, m = stack.pop()
            if max(m, n) >= least:
                out[p] = max(m, n)
            n = min(m, n)
        stack.append((pos, n))
    for p, m in stack:
        if m >= least:
            out[p] = m
    return out


def factors(match: dict[int, int], starts: list[int], start: int, end: int) -> list[tuple[int, int]]:
    """The greedy parse of words start to end of a block: (from, to) of its factors. ``starts`` has the positions in it
    where a match begins; all other words are literals."""
    out, at = [], start
    for p in starts:
        if p >= at:
            at = min(end, p + match[p])
            out.append((p, at))
    return out


def repeated_windows(stretches: list[bytes]) -> list[list[int]]:
    """For each stretch, the places of its windows that start earlier in this list too."""
    known: dict[bytes, int] = {}
    ids: list[int] = []
    bounds = [0]
    for s in stretches:
        ids += [known.setdefault(w, len(known)) for w in s.split()]
        ids.append(-1)
        bounds.append(len(ids))
    x = np.array(ids, np.int64)
    seams = x < 0
    x[seams] = len(known) + np.arange(seams.sum())  # a seam matches nothing
    depth = int(np.diff(bounds).max(initial=1))
    order = suffix_order(x, depth)
    match = earlier_matches(order, neighbours(x, order, depth), WINDOW)
    hits = np.array(sorted(match), np.int64)
    cuts = np.searchsorted(hits, bounds).tolist()
    hits = hits.tolist()
    out = []
    for start, end, a, b in zip(bounds, bounds[1:], cuts, cuts[1:], strict=False):
        found: list[int] = []
        for p, q in factors(match, hits[a:b], start, end - 1):
            found += range(p, q - WINDOW + 1)  # inside the factor
            found += [w for w in range(q - WINDOW + 1, q) if w in match]  # over its end
        out.append([w - start for w in found])
    return out


def _solve(t: pa.Table) -> pa.Table:
    t = t.sort_by([("_key", "ascending"), ("first", "ascending")])
    found = repeated_windows(t["bytes"].to_pylist())
    keys, firsts = t["_key"].to_pylist(), t["first"].to_pylist()
    hits = sorted((k, f + w) for k, f, ws in zip(keys, firsts, found, strict=True) for w in ws)
    both = np.array(hits, np.int64).reshape(-1, 2)
    return ranges(both[:, 0], both[:, 1])


# --- the corpus


def _result(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, str]:
    words = text.split()
    gone = covered(len(words), starts, ends)
    removed = int(gone.sum())
    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if removed else words
    return len(words), removed, hashlib.sha256(b" ".join(kept)).hexdigest()


_NONE = np.zeros(0, np.int64)
_OPEN = ("z", "starts", "ends", "seed", "kin", "first", "bytes")
_RESULT = ("n_words", "n_removed", "kept_sha256")
_FIRST = "_key long, doc_id long, n_words long, n_removed long, kept_sha256 string, z binary, starts array<int>, ends array<int>, seed array<long>, kin array<long>, first array<int>, bytes array<binary>"


def _first(batch: pa.RecordBatch) -> dict:
    """Whole stretches that are repeated go; documents with stretches to parse carry them and stay open."""
    unzip, out = zstandard.ZstdDecompressor(), []
    for z, marks in zip(batch.column("z").to_pylist(), batch.column("marks").to_pylist(), strict=True):
        text = unzip.decompress(z)
        if not marks:
            out.append((*_result(text, _NONE, _NONE), *[None] * 7))
            continue
        p, (ord_, kin, again) = parse(text), unmarked(marks)
        full, look = ord_[again], ~again
        starts, ends = p.first[full], p.last[full] + WINDOW
        if not look.any():
            out.append((*_result(text, starts, ends), *[None] * 7))
            continue
        at = ord_[look]
        parts = [bytes(p.slice(a, b + WINDOW)) for a, b in zip(p.first[at].tolist(), p.last[at].tolist(), strict=True)]
        out.append((p.n, 0, "", z, starts, ends, p.seed[at], kin[look], p.first[at], parts))
    return {"_key": batch.column("_key"), "doc_id": batch.column("doc_id")} | dict(zip((*_RESULT, *_OPEN), zip(*out, strict=True) if out else [[]] * 10, strict=True))


def _second(batch: pa.RecordBatch) -> dict:
    unzip, out = zstandard.ZstdDecompressor(), []
    for z, starts, ends, more in zip(*(batch.column(c).to_pylist() for c in ("z", "starts", "ends", "more")), strict=True):
        a, b = np.array([(r["a"], r["b"]) for r in more or ()], np.int64).reshape(-1, 2).T
        out.append(_result(unzip.decompress(z), np.concatenate([np.array(starts, np.int64), a]), np.concatenate([np.array(ends, np.int64), b + WINDOW])))
    return {"doc_id": batch.column("doc_id")} | dict(zip(_RESULT, zip(*out, strict=True) if out else [[]] * 3, strict=True))


def remove_repeats(docs: DataFrame, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words of every row of ``docs``."""
    docs = keyed(docs, "text")
    rows, kinds, tables = shared_segments(docs, parse)
    often = kinds.where("n > 1").select("seed", "h", "g", "first")
    late = rows.join(often, ["seed", "h", "g"]).where(F.struct("_key", "ord") != F.col("first")).select("_key", mark(F.lit(1), True))
    new = kinds.where("kin > 1").select("first.*", "kin").select("_key", mark(F.col("kin"), False))
    first = materialize(per_batch(with_marks(docs, late.unionByName(new)), _first, _FIRST), "parsed", done=tables)
    open_ = first.where("z is not null")
    parts = open_.select("_key", F.lit(False).alias("known"), F.inline(F.arrays_zip("seed", "kin", "first", "bytes")))
    more = settle(parts, parse, _solve, earliest=True, crowd=crowd, block=block)
    more = more.groupBy("_key").agg(F.collect_list(F.struct("a", "b")).alias("more"))
    rest = open_.select("_key", "doc_id", "z", "starts", "ends").join(more, "_key", "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    done = first.where("z is null").select("doc_id", *_RESULT)
    return done.unionByName(per_batch(rest, _second, schema))


def op7_lempel_ziv(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
