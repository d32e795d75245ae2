"""Quality rules as a bitmask ledger: every rule is evaluated once per document.

``ledger`` stores the measurements and one failure bit per rule. ``apply_policy`` turns the bits into a verdict by a
versioned policy (a mask of the rules that count), so a new policy needs no second pass over the texts, and
``ablation`` tells what each rule of a policy contributes by bitwise aggregation.

Cases: a null text has no words and fails ``few_words``; an empty or blank text likewise; a null doc_id is kept as it
is; repeated rows are judged row by row; an empty table gives an empty ledger; other columns are ignored here and kept
by ``keep_good``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, binaries, per_batch

#: Bit of each rule in ``fail_bits``. A rule is an integer comparison of measurements, so any engine agrees on it.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "3 * n_dup_lines > n_lines",
    "short_words": "n_words > 0 AND word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "one_line_flood": "n_lines > 2000 AND n_words < n_lines",
}
#: The rules that count, by version of the policy.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "dup_lines", "short_words", "long_words"),
}
MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
SYMBOLS, WINDOW = "#*$%&|<>", 8
_MIX = np.random.default_rng(8).integers(1 << 62, size=WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mask(policy: str) -> int:
    return sum(1 << k for k, rule in enumerate(RULES) if rule in POLICIES[policy])


def repeated(words: list[bytes]) -> int:
    """How many words lie in windows of eight words that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for j, c in enumerate(_MIX):
        key += c * h[j : j + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    starts = np.flatnonzero(hit)
    # equal hashes are candidates; equal words decide
    seen: dict[tuple, int] = {}
    cover = np.zeros(len(words) + 1, np.int64)
    for i in starts.tolist():
        w = tuple(words[i : i + WINDOW])
        first = seen.setdefault(w, i)
        if first != i:
            for k in (first, i):
                cover[k] += 1
                cover[k + WINDOW] -= 1
    return int((np.cumsum(cover) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    text = text or ""
    words = text.encode().split()
    lines, dup, seen = text.split("\n"), 0, set()
    if len(lines) > 1:
        for line in lines:
            if line in seen:
                dup += 1
            elif line.strip(SPACES):
                seen.add(line)
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
        len(lines), dup, repeated(words),
    )


def _measure(batch: pa.RecordBatch) -> dict:
    rows = [measure(t if t is None else t.decode()) for t in binaries(batch.column("text"))]
    names = [x.split()[0] for x in MEASURES.split(", ")][1:]
    return {n: batch.column(n) for n in batch.schema.names} | dict(zip(names, zip(*rows, strict=True) if rows else [[]] * 6, strict=True))


def _with_bits(rows: DataFrame) -> DataFrame:
    """``fail_bits`` from the measurements: each rule is evaluated here and nowhere else."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    total: Column = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return rows.withColumn("fail_bits", total.cast("long"))


def ledger(docs: DataFrame) -> DataFrame:
    """One row a document: the measurements and ``fail_bits``, bit k being the k-th of RULES. No shuffle."""
    return _with_bits(per_batch(docs.select("doc_id", "text"), _measure, MEASURES))


def apply_policy(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with ``base_failed``, ``kept`` and the policy's name, computed from the bits alone."""
    hit = lambda p: F.col("fail_bits").bitwiseAND(F.lit(mask(p))) != 0
    return ledger.withColumns({"base_failed": hit("base"), "kept": ~(hit("base") | hit(policy)), "policy": F.lit(policy)})


def ablation(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: documents that fail it, that only it rejects, and that all its rules together reject.

    Bitwise aggregation over the ledger: the distinct masks are counted first (at most 2**len(RULES) rows)."""
    m = mask(policy)
    masks = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, r in enumerate(RULES) if m >> k & 1]))
    x = masks.withColumn("r", rules).select("bits", "n", "r.*")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return x.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(F.col("bits") == F.col("bit")).alias("n_only"),
        count(F.col("bits") != 0).alias("n_rejected"),
    )


def keep_good(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """``docs`` without the rows that the policy rejects by the bits of their ledger; all columns stay, rows are judged one
    by one, no shuffle."""
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select("text", F.struct(*others).alias("rest")) if others else docs.select("text", F.lit(None).cast("struct<a:int>").alias("rest"))
    measures = MEASURES.partition(", ")[2]
    rows = per_batch(packed, _measure, f"{packed._jdf.schema().toDDL()}, {measures}")
    kept = apply_policy(_with_bits(rows), policy).where("kept")
    return kept.select(*[F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns])


def op10_quality_ledger(spark, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


_BITS = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(RULES.values()))
OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS k FROM w, unnest(range(1, len(words) - 6)) AS t(i) WHERE len(words) >= 8),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM rep, range(8) AS t(o) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(lines) AS line FROM w),
dup AS (SELECT doc_id, sum(c - 1) AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS c FROM ln WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, ({_BITS})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits,
  fail_bits & {mask("base")} != 0 AS base_failed, fail_bits & {mask("v1") | mask("base")} = 0 AS kept FROM b
"""
