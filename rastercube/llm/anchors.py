"""Content-defined segments: which windows of a corpus can be equal, found with a fraction of its rows.

A window is ``length`` consecutive units (words or bytes) of one document. In every window, the ``k`` units with the
smallest hash are its anchor (the leftmost of equals). Equal windows have equal anchors at equal places, so windows that
occur twice have an anchor that occurs twice. Consecutive windows with the same anchor form a segment; a document is a
sequence of segments, about one for every ``(length - k) / 2`` units, and the set of windows of a segment depends on
its units alone. So only anchors that occur twice are followed up; segments that are equal as a whole (by a 128-bit
digest) are counted, not compared; and only different segments with one anchor are looked into, in the one block that
the anchor's hash deals them to. No other block can hold a window of theirs.

Skew: counts are summed up before they are dealt out, and joins that put them back on the rows can be split. An anchor
with more than ``crowd`` different segments is cut finer until no part of it has: windows are told apart by their two
smallest places, then four, eight and so on, in the end by the whole window. Whatever the level, equal windows stay
together and the same block function judges them, so the result is the same for every ``crowd``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binaries, materialize, per_batch

_FIRST32, _LAST32 = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ x >> np.uint64(33)
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def cut(grams: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and anchor place of each segment, given the hashes of all k-grams of a document."""
    width = length - k + 1
    n = len(grams) - width + 1
    if n <= 0:
        e = np.zeros(0, np.int64)
        return e, e, e
    m = (grams & _FIRST32) | np.arange(len(grams), dtype=np.uint64)
    have = 1
    while have < width:  # sliding minimum by doubling
        step = min(have, width - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    at = (m & _LAST32).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return first, np.append(first[1:], n) - 1, at[first]


def cut_finer(grams: np.ndarray, length: int, k: int, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and seed of the runs of windows with the same ``places`` smallest grams; with as many
    places as a window has, each window is a run of its own (seed 0, for the caller to fill in)."""
    width = length - k + 1
    n = len(grams) - width + 1
    if places >= width:
        i = np.arange(n)
        return i, i, np.zeros(n, np.int64)
    key = np.lib.stride_tricks.sliding_window_view((grams & _FIRST32) | np.arange(len(grams), dtype=np.uint64), width)
    least = np.sort(np.partition(key, places - 1, axis=1)[:, :places], axis=1)
    first = np.concatenate([[0], np.flatnonzero((np.diff(least, axis=0) != 0).any(axis=1)) + 1])
    seed = np.full(len(first), places, np.uint64)
    for g in grams[(least[first] & _LAST32).astype(np.int64)].T:
        seed = mixed(seed + g)
    return first, np.append(first[1:], n) - 1, seed.view(np.int64)


class Parsed:
    """A document's segments. ``slice(a, b)`` are the bytes of its units a to b (end exclusive)."""

    __slots__ = ("n", "grams", "first", "last", "seed", "slice", "length", "k")

    def __init__(self, n: int, grams: np.ndarray, length: int, k: int, slice_: Callable[[int, int], bytes]):
        self.n, self.grams, self.length, self.k, self.slice = n, grams, length, k, slice_
        self.first, self.last, at = cut(grams, length, k)
        self.seed = grams[at].view(np.int64) if len(at) else at

    def digests(self) -> np.ndarray:
        """The 128-bit digest of each segment as a row of two longs."""
        return digests([self.slice(a, b + self.length) for a, b in zip(self.first.tolist(), self.last.tolist(), strict=True)])


def digests(parts: list) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), ">i8").astype(np.int64).reshape(-1, 2)


def _segments(batch: pa.RecordBatch, parse: Callable[[bytes], Parsed], seeds_only: bool) -> dict:
    none = np.zeros(0, np.int64)
    seeds, rows, keys, ords = [none], [none.reshape(0, 2)], [none], [none.astype(np.int32)]
    for key, t in zip(batch.column("_key").to_pylist(), binaries(batch.column("text")), strict=True):
        p = parse(t or b"")
        if n := len(p.first):
            seeds.append(p.seed)
            if not seeds_only:
                rows.append(p.digests())
                keys.append(np.full(n, key, np.int64))
                ords.append(np.arange(n, dtype=np.int32))
    out = {"seed": np.concatenate(seeds)}
    if seeds_only:
        return out
    d = np.concatenate(rows)
    return out | {"h": d[:, 0], "g": d[:, 1], "_key": np.concatenate(keys), "ord": np.concatenate(ords)}


def shared_segments(docs: DataFrame, parse: Callable[[bytes], Parsed]) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """From ``docs`` (_key, text): the segments whose anchor occurs twice or more (seed, h, g, _key, ord), and the
    different ones of them (seed, h, g, n, the first by (_key, ord), and ``kin``: how many its anchor has); and the tables
    that both are made of."""
    cols = docs.select("_key", "text")
    seeds = per_batch(cols, _segments, "seed long", parse=parse, seeds_only=True)
    # tables of their own: a sum below a join would keep Spark from splitting an anchor that very many documents have
    twice = materialize(seeds.groupBy("seed").count().where("count > 1").select("seed"), "twice")
    rows = per_batch(cols, _segments, "seed long, h long, g long, _key long, ord int", parse=parse, seeds_only=False)
    rows = materialize(rows.join(twice, "seed"), "segments", done=[twice])
    kinds = rows.groupBy("seed", "h", "g").agg(F.count("*").alias("n"), F.min(F.struct("_key", "ord")).alias("first"))
    kinds = materialize(kinds, "kinds")
    kin = _kin(kinds)
    return rows, kinds.join(kin, "seed", "left").withColumn("kin", F.coalesce("kin", F.lit(1))), [rows, kinds, kin]


def _kin(kinds: DataFrame) -> DataFrame:
    """How many kinds an anchor has, where it has several; a table of its own, so that the join with it can be split."""
    return materialize(kinds.groupBy("seed").agg(F.count("*").alias("kin")).where("kin > 1"), "kin")


def _pack(batch: pa.RecordBatch) -> dict:
    z = zstandard.ZstdCompressor(level=1)
    return {"_key": batch.column("_key"), "doc_id": batch.column("doc_id"), "z": [z.compress(t or b"") for t in binaries(batch.column("text"))]}


#: A mark in one long: a segment's number, how many different segments its anchor has (up to 2**22 - 1, far beyond what
#: is cut finer), and whether it is repeated as a whole.
_KIN = 22


def mark(kin: Column, again: bool) -> Column:
    return (F.col("ord").cast("long") * (1 << _KIN + 1) + F.least(kin.cast("long"), F.lit((1 << _KIN) - 1)) * 2 + int(again)).alias("mark")


def unmarked(marks: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = np.array(marks, np.int64)
    return m >> _KIN + 1, m >> 1 & (1 << _KIN) - 1, (m & 1).astype(bool)


def with_marks(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Each of ``docs`` (_key, doc_id, text) as _key, doc_id, z (the text, compressed before it is dealt out) and the
    sorted list ``marks`` of its ``marks`` (_key, mark), null if it has none."""
    z = per_batch(docs.select("_key", "doc_id", "text"), _pack, "_key long, doc_id long, z binary")
    return z.join(marks.groupBy("_key").agg(F.sort_array(F.collect_set("mark")).alias("marks")), "_key", "left")


# --- blocks of different segments with the same anchors

#: A part: the anchor and how many different parts it has, where the part's first window starts, whether another part
#: is known to be equal, and its units as bytes.
PART = "seed long, kin long, _key long, first int, known boolean, bytes binary"
RANGE = "_key long, a int, b int"


_SUB = "seed long, h long, g long, _key long, first int, w int, known boolean, bytes binary"


def _finer(batch: pa.RecordBatch, parse: Callable[[bytes], Parsed], places: int) -> dict:
    """The runs of windows of each part that ``places`` smallest places tell apart; w is how many windows a run has."""
    none = np.zeros(0, np.int64)
    seed, d, at, w, key, known, out = [none], [none.reshape(0, 2)], [none], [none], [], [], []
    for k, first, kn, raw in zip(*(batch.column(c).to_pylist() for c in ("_key", "first", "known", "bytes")), strict=True):
        p = parse(raw)
        lo, hi, seeds = cut_finer(p.grams, p.length, p.k, places)
        parts = [bytes(p.slice(x, y + p.length)) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
        own = digests(parts)
        seed.append(own[:, 0] if places > p.length - p.k else seeds)
        d.append(own)
        at.append(lo + first)
        w.append(hi - lo + 1)
        key += [k] * len(parts)
        known += [kn] * len(parts)
        out += parts
    d = np.concatenate(d)
    return {"seed": np.concatenate(seed), "h": d[:, 0], "g": d[:, 1], "_key": key, "first": np.concatenate(at), "w": np.concatenate(w), "known": known, "bytes": out}


def by_anchor(t: pa.Table, piece: int) -> Iterator[pa.Table]:
    """A block (seed, bytes, ...) in pieces of whole anchors, of at most ``piece`` bytes each or one anchor."""
    seed = t["seed"].to_numpy()
    by = np.argsort(seed, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], np.diff(seed[by]) != 0]))
    size = np.add.reduceat(pc.binary_length(t["bytes"]).to_numpy()[by], start, dtype=np.int64)
    cuts, held = [0], 0
    for at, n in zip(start.tolist(), size.tolist(), strict=True):
        if held and held + n > piece:
            cuts.append(at)
            held = 0
        held += n
    for a, b in zip(cuts, [*cuts[1:], len(by)], strict=True):
        yield t.take(by[a:b])


def settle(parts: DataFrame, parse: Callable[[bytes], Parsed], solve: Callable[[pa.Table], pa.Table], *, earliest: bool, crowd: int, block: int, piece: int = 0) -> DataFrame:
    """The windows of ``parts`` (PART) that are repeated, as ranges (_key, a, b) of window starts, b included.

    ``solve`` judges a block: a table (_key, first, known, bytes) in which all windows that may be equal are together.
    With ``piece`` it gets a block in pieces of about so many bytes (``by_anchor``), however much was dealt to the block.
    With ``earliest`` a window is repeated if it also starts earlier, by (_key, place); else if it starts anywhere else.
    """
    found, ready, places = [], [], 1
    while True:
        ready.append(parts.where(F.col("kin").between(2, crowd)).select("seed", "_key", "first", "known", "bytes"))
        crowded = parts.where(F.col("kin") > crowd)
        if crowded.isEmpty():
            break
        places = 2 if places == 1 else places * 4
        sub = materialize(per_batch(crowded, _finer, _SUB, parse=parse, places=places), "finer")
        own = F.struct("_key", "first")
        kinds = sub.groupBy("seed", "h", "g").agg(F.count("*").alias("n"), F.max("known").alias("known"), F.min(own).alias("top"), F.min_by("bytes", own).alias("bytes"))
        kinds = materialize(kinds, "finer-kinds")
        again = sub.drop("bytes").join(kinds.where("n > 1").select("seed", "h", "g", "top"), ["seed", "h", "g"])
        again = again.where(own != F.col("top")) if earliest else again.where("NOT known")
        found.append(again.select("_key", F.col("first").alias("a"), (F.col("first") + F.col("w") - 1).alias("b")))
        known = F.lit(False) if earliest else F.col("known") | (F.col("n") > 1)
        parts = materialize(kinds.join(_kin(kinds), "seed").select("seed", "kin", "top._key", "top.first", known.alias("known"), "bytes"), "finer-parts")
    ready = reduce(DataFrame.unionByName, ready)
    total = ready.agg(F.sum(F.length("bytes"))).first()[0] or 0
    blocks = total // block + 1
    # by number: Spark would merge small blocks, whose work is more than their bytes tell
    dealt = ready.withColumn("block", F.pmod(F.xxhash64("seed"), F.lit(blocks)))
    dealt = (dealt if piece else dealt.drop("seed")).repartition(max(1, blocks // 4), "block")

    def solve_pieces(t: pa.Table) -> pa.Table:
        return pa.concat_tables(solve(x) for x in by_anchor(t, piece))

    near = dealt.groupBy("block").applyInArrow(solve_pieces if piece else solve, RANGE)
    return reduce(DataFrame.unionByName, found, near)


def ranges(key: np.ndarray, at: np.ndarray) -> pa.Table:
    """Window starts, sorted by (key, at), as ranges."""
    new = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(at) != 1)]) if len(key) else np.zeros(0, bool)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(key))[: len(a)] - 1
    return pa.table([pa.array(key[a], pa.int64()), pa.array(at[a], pa.int32()), pa.array(at[b], pa.int32())], names=["_key", "a", "b"])


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n units lie in any of the ranges."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:n]) > 0
