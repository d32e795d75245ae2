"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: a bit is 1 if it is set in over half the hashes of a text's three-word shingles. Candidates: the 64 bits
are grouped into partitions so that correlated bits stay together, and each partition i gets a threshold t_i >= -1 with
sum t_i = distance - partitions + 1. Two fingerprints within ``distance`` then agree in some partition up to t_i bits.
The thresholds come from dynamic programming over estimated candidate counts, and so does the number of partitions.
Every fingerprint probes, in each partition, its own value and all values within t_i flips against an index of the
values; candidates are verified on all 64 bits.

Skew: exact copies are one fingerprint, so a group of copies is one node however large it is. The members of a partition
value that more than ``BUCKET`` fingerprints have, with those that probe it, are dealt by the same principle again: what
differs between two of them lies in the bits outside of the partition, so cut in ``distance`` + 1 they agree in one part
of these. This goes on until every value has few fingerprints; with five bits left it cannot have more. No link is lost,
no cap.

Components: alternating large-star and small-star over the links, each round a table in the shared folder.

Cases: a null, empty or blank text has fingerprint zero and links like any other; a null doc_id takes part and its
component is the smallest doc_id reachable, null if there is none; repeated rows give equal rows; an empty table gives
an empty result; other columns are ignored by the query and kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import mixed
from .common import binaries, keyed, materialize, per_batch

SHINGLE, DISTANCE, SEED = 3, 2, 42
#: The largest group of fingerprints with one partition value whose members are compared one with another.
BUCKET = 32
BITS = 64
#: With so few bits left, no more than 2**LEFT fingerprints can have one value.
LEFT = 5


def fingerprint(text: bytes | None) -> int:
    words = (text or b"").lower().split()  # bytes.lower() is A-Z only
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    if n <= SHINGLE:
        return digest(b" ".join(words), SEED)
    line = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = [0, *ends[: n - SHINGLE].tolist()]
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)], np.uint64)
    ones = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _fingerprints(batch: pa.RecordBatch) -> dict:
    return {n: batch.column(n) for n in batch.schema.names if n != "text"} | {"fp": [_signed(fingerprint(t)) for t in binaries(batch.column("text"))]}


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (a signed long). No shuffle."""
    return per_batch(docs.select("doc_id", "text"), _fingerprints, "doc_id long, fp long")


# --- the plan: partitions and thresholds


def _agreements(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each pair of bits how many have both set: 64 by 64 sums, whatever the
    input; each task sends one such matrix."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for b in batches:
            x = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            bits = (x[:, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)).astype(np.float64)
            both += (bits.T @ bits).astype(np.int64)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(both.ravel(), n))], names=["cell", "n"])

    sums = fps.select("fp").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for r in sums:
        flat[r.cell] = r.n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of nearly equal size: each group grows by the bit most correlated with it."""
    n = max(n, 1)
    p = np.diag(both) / n
    sd = np.sqrt(p * (1 - p))
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.abs(both / n - np.outer(p, p)) / np.outer(sd, sd)
    r = np.nan_to_num(r)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        group = [max(left, key=lambda b: (r[b, sorted(left)].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (r[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def disagreement(p: np.ndarray) -> np.ndarray:
    """Distribution of the number of differing bits of two fingerprints, for independent bits with these frequencies."""
    d = np.array([1.0])
    for q in 2 * p * (1 - p):
        d = np.convolve(d, [1 - q, q])
    return d


def agreeing_pairs(fps: DataFrame, groups: list[list[int]]) -> list[float]:
    """For each group of bits, how many pairs of fingerprints agree in all of them: counted, as correlated bits agree far
    more often than their frequencies tell. Counts are summed up by value, then over the values."""
    own = F.posexplode(F.array(*[_value(F.col("fp"), g) for g in groups])).alias("g", "value")
    n = fps.select(own).groupBy("g", "value").count()
    got = {r.g: r.pairs for r in n.groupBy("g").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    return [float(got.get(i) or 0) for i in range(len(groups))]


def allocate(cost: list[list[float]], total: int) -> tuple[list[int], float]:
    """Thresholds with the given sum and the least cost; cost[i][t + 1] is that of threshold t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t in range(-1, len(row) - 1):
                got = (c + row[t + 1], [*ts, t])
                if s + t not in new or got[0] < new[s + t][0]:
                    new[s + t] = got
        best = new
    c, ts = best[total]
    return ts, c


def plan(n: int, both: np.ndarray, distance: int = DISTANCE, pairs=None) -> tuple[list[list[int]], list[int]]:
    """Partitions and thresholds with the least estimated work: candidates to verify and values to probe.

    ``pairs`` (groups of bits) tells how many pairs agree in all bits of each group; candidates at a threshold are those
    times how much likelier it is, by how often each bit is set, to differ in at most so many bits as in none. Without
    it, all is taken from the frequencies. A probed value costs about as much as four candidates."""
    p = np.diag(both) / max(n, 1)
    ways = [group_bits(n, both, parts) for parts in range(2, distance + 3)]
    flat = [g for groups in ways for g in groups]
    counted = iter(pairs(flat) if pairs else [n * n / 2 * disagreement(p[g])[0] for g in flat])
    best = None
    for groups in ways:
        cost = []
        for g in groups:
            chance, same = np.cumsum(disagreement(p[g])), next(counted)
            probes = [n * sum(comb(len(g), k) for k in range(t + 1)) for t in range(distance + 1)]
            cost.append([0.0] + [same * chance[t] / max(chance[0], 1e-300) + 4 * probes[t] + n for t in range(distance + 1)])
        ts, c = allocate(cost, distance - len(groups) + 1)
        if best is None or c < best[0]:
            best = (c, groups, ts)
    return best[1], best[2]


# --- probe and verify


def _value(fp, bits: list[int]):
    """The bits of a partition, in their places."""
    return fp.bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))


def _flips(bits: list[int], t: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for k in range(t + 1) for c in combinations(bits, k)]


_KEYED = "k long, used long, fp long"


def _dealt_again(batch: pa.RecordBatch, parts: int) -> dict:
    """Each row once for each of ``parts`` parts of the bits that are not used yet, keyed by its value in that part too."""
    k, used, fp = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("k", "used", "fp"))
    out = []
    for mask in np.unique(used).tolist():
        at = used == np.uint64(mask)
        left = [b for b in range(BITS) if not mask >> b & 1]
        for j in range(parts):
            part = sum(1 << b for b in left[j::parts])
            key = mixed(k[at] + mixed((fp[at] & np.uint64(part)) + np.uint64(j + 1)))
            out.append((key, np.full(at.sum(), mask | part, np.uint64), fp[at]))
    cols = [np.concatenate(c).view(np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return dict(zip(("k", "used", "fp"), cols, strict=True))


def links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v), u < v, over distinct fingerprints ``fp``: all pairs within ``distance``."""
    n, both = _agreements(fps)
    groups, ts = plan(n, both, distance, lambda gs: agreeing_pairs(fps, gs))
    index = probe = None
    for i, (bits, t) in enumerate(zip(groups, ts, strict=True)):
        if t < 0:
            continue
        used = F.lit(_signed(sum(1 << b for b in bits))).alias("used")
        key = lambda v, i=i: F.xxhash64(F.lit(i), v).alias("k")
        own = _value(F.col("fp"), bits)
        a = fps.select(key(own), used, "fp")
        flips = F.explode(F.array(*[F.lit(x) for x in _flips(bits, t)]))
        b = fps.withColumn("flip", flips).select(key(own.bitwiseXOR(F.col("flip"))), used, "fp")
        index = a if index is None else index.unionByName(a)
        probe = b if probe is None else probe.unionByName(b)
    near = None
    least = 2 if max(ts) == 0 else 1
    while True:
        held = materialize(index.groupBy("k").agg(F.count("*").alias("n"), F.min(F.bit_count("used")).alias("used")), "held")
        crowded = (F.col("n") > bucket) & (F.col("used") < BITS - LEFT)
        few, many = held.where(~crowded & (F.col("n") >= least)).select("k"), held.where(crowded).select("k")
        cand = probe.join(few, "k").select("k", F.col("fp").alias("u")).join(index.select("k", F.col("fp").alias("v")), "k")
        got = cand.where((F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance) & (F.col("u") != F.col("v")))
        got = got.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        near = got if near is None else near.unionByName(got)
        if many.isEmpty():
            return near.distinct()
        again = lambda rows: per_batch(rows.join(many, "k").select("k", "used", "fp"), _dealt_again, _KEYED, parts=distance + 1)
        index, probe = materialize(again(index), "dealt"), materialize(again(probe), "probing")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v): root is the smallest node reachable. Alternating large and small
    stars; every step sums up per node and joins back, so that the rows of a node with many links can be split."""

    def star(both: DataFrame) -> tuple[DataFrame, DataFrame]:
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return low, both.join(low, "u")

    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        _, near = star(both)
        large = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large")
        low, near = star(large)
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(small, "small")
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            break
        before = state
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(own)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs``."""
    rows = materialize(fingerprints(docs), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp")))
    member = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = materialize(member.join(ids, "root").select("fp", "component_id"), "labels")
    return rows.join(labels, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the first by doc_id (nulls last), then text; all columns stay."""
    rows = keyed(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")), "text", "row")
    found = near_duplicates(rows.select(F.col("_key").alias("doc_id"), "text"))
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("_key"))
    return rows.join(keep, "_key", "left_semi").select("row.*")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
