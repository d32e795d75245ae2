"""Mixing sources to target weights along a time-varying curriculum.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share as many words as all documents have. No
source is taken more than three times: what a source cannot take is shared again by weight, which is filling to a
common level: target = least(level * weight, 3 * words of the source).

Each source has a weight schedule over training time t in [0, 1], a linear ramp ``1 + a * (1 - 2t)`` around its
weight. Integrated, the share of its target that is due by t is ``D(t) = t + a * (t - t * t)``. A document's words
occupy an interval of its source's cumulative demand; inverting D at the interval's middle gives its training
position, and the mix is the documents range-sorted by position.

Inside a source, documents follow a fixed scrambled order of doc_id. Whole passes over the source come first; the rest
of the target is taken from the front of that order, so that at most one document per source is taken in part.

The cumulative sums are in two levels: sums of slices of the scrambled order per source, then running sums inside a
slice. There are as many slices as hold ``SLICE`` rows each, so a source that holds a third of all rows is many groups,
and no task gets a whole source. Schedules are integrated source by source, each over its own demand: training time is
the share of a source's target that is due, not normalised over sources at each moment. Targets take one row a source.

Cases: a null or blank text has size 0, takes 0 words and is still listed; a null doc_id is ordered by its size,
first among equals; a null source is a source of its own; repeated rows count as rows each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keyed, materialize, merged, n_words, packed, unpacked

WEIGHTS = (5, 2, 1)
#: The ramp of each weight class: heavy sources early, light ones late.
RAMPS = (0.5, 0.0, -0.5)
#: Rows that a slice is meant to have.
REPEATS, SLICE = 3, 50_000
_M, _TWO31, _TWO32 = 2654435761, 1 << 31, 1 << 32


def _targets(slices: DataFrame) -> DataFrame:
    """Per source: its words, target, ramp. One row a source, so the windows hold as many rows as there are sources."""
    s = slices.groupBy("src").agg(F.sum("words").alias("source_size"))
    s = s.withColumn("k", F.pmod(F.row_number().over(W.orderBy("src")) - 1, F.lit(len(WEIGHTS))))
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("k") + 1)
    s = s.withColumns({"w": pick(WEIGHTS).cast("double"), "ramp": pick(RAMPS), "cap": (REPEATS * F.col("source_size")).cast("double")})
    by = W.orderBy(F.col("cap") / F.col("w"), "src")
    s = s.withColumns({
        "full": F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing)),
        "all": F.sum("source_size").over(W.partitionBy()).cast("double"),
    })
    s = s.withColumn("here", (F.col("all") - F.col("full")) / F.col("open"))
    # the level: that of the first source, by cap and weight, that does not fill up
    s = s.withColumn("level", F.min(F.when(F.col("cap") >= F.col("here") * F.col("w"), F.struct(F.col("cap") / F.col("w"), "src", "here"))).over(W.partitionBy())["here"])
    s = s.withColumn("target", F.least(F.coalesce(F.col("level") * F.col("w"), F.col("cap")), F.col("cap")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return s.withColumn("passes", passes.cast("long")).withColumn("rest", F.floor(F.col("target") - F.col("passes") * F.col("source_size") + 0.5).cast("long")).select("src", "source_size", "target", "ramp", "passes", "rest")


def mix(docs: DataFrame, *carry: str) -> DataFrame:
    """A row for each row of ``docs``: doc_id, ``carry``, size, source_size, target, taken, n_copies and the training
    positions of its first and last copy (null if it is not taken)."""
    scrambled = F.pmod(F.pmod(F.coalesce("doc_id", "size"), F.lit(_TWO31)) * F.lit(_M), F.lit(_TWO32))
    rows = docs.select(
        "doc_id", *carry, n_words(F.col("text")).alias("size"),
        # 't' sorts after every 's...': null last
        F.when(F.col("source").isNull(), "t").otherwise(F.concat(F.lit("s"), "source")).alias("src"),
    ).withColumn("h", scrambled)
    rows = materialize(rows, "mix")  # several uses; the texts are read once
    bits = min(31, max(0, (rows.count() - 1) // SLICE).bit_length())
    rows = rows.withColumn("slice", F.shiftright("h", 32 - bits) if bits else F.lit(0).cast("long"))
    slices = rows.groupBy("src", "slice").agg(F.sum("size").alias("words"))
    targets = _targets(slices)
    before = F.coalesce(F.sum("words").over(W.partitionBy("src").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = slices.select("src", "slice", before.alias("slice_from")).join(targets, "src")
    order = W.partitionBy("src", "slice").orderBy("h", F.col("doc_id").asc_nulls_first(), "size", *carry)
    inside = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    x = rows.withColumn("inside", inside).join(offsets, ["src", "slice"]).withColumn("start", F.col("slice_from") + F.col("inside"))
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("start")))
    x = x.withColumns({"part": part, "taken": F.col("passes") * F.col("size") + part})
    x = x.withColumn("n_copies", F.when(F.col("size") > 0, F.col("passes") + F.when(F.col("part") > 0, 1).otherwise(0)).otherwise(F.lit(0)).cast("long"))
    return x.withColumns({
        "first_position": F.when(F.col("n_copies") > 0, _position(F.lit(0), F.when(F.col("passes") > 0, F.col("size")).otherwise(F.col("part")))),
        "last_position": F.when(F.col("n_copies") > 0, _position(F.col("n_copies") - 1, F.when(F.col("part") > 0, F.col("part")).otherwise(F.col("size")))),
    }).select("doc_id", *carry, "size", "source_size", "target", "taken", "n_copies", "first_position", "last_position", "part", "start", "ramp", "passes")


def _position(copy, words):
    """Inverse of the integrated schedule at the middle of a copy's interval of its source's demand."""
    y = (copy * F.col("source_size") + F.col("start") + words / 2.0) / F.col("target")
    a = F.col("ramp")
    return 2.0 * y / (1.0 + a + F.sqrt((1.0 + a) * (1.0 + a) - 4.0 * a * y))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, whole, one row a copy, range-sorted by training position; the columns of ``docs``.

    A document that the mix takes only in part (one a source at most) is a copy if half of it or more is taken.
    """
    rows = keyed(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("row")), "text", "source", "row")
    # only narrow rows go through the sums; the texts are joined afterwards, and go through that and the sort compressed
    m = mix(rows.select("_key", "doc_id", "text", "source"), "_key")
    copies = F.col("passes") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    m = m.withColumn("copies", copies.cast("int")).where("size > 0 and copies > 0")
    m = m.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    m = m.select("_key", _position(F.col("copy"), F.col("size").cast("double")).alias("position"))
    rest = F.struct(*[F.col("row")[c].alias(c) for c in docs.columns if c != "text"])
    rows = rows.select("_key", rest.alias("rest"), packed("text").alias("z"))
    out = merged(rows, m, "_key").orderBy("position", "_key")
    return out.select(*[unpacked("z").alias(c) if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns])


def op8_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    rows = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = rows.select("doc_id", "size", "source_size", "target", "taken", "n_copies", "first_position", "last_position")
    return materialize(rows, "positions").orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def _sql_position(copy: str, words: str) -> str:
    y = f"(({copy}) * source_size + start + ({words}) / 2.0::DOUBLE) / target"
    return f"2.0::DOUBLE * ({y}) / (1.0::DOUBLE + ramp + sqrt((1.0::DOUBLE + ramp) * (1.0::DOUBLE + ramp) - 4.0::DOUBLE * ramp * ({y})))"


OP8_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
r AS (SELECT doc_id, size,
  ((((coalesce(doc_id, size) % {_TWO31}) + {_TWO31}) % {_TWO31}) * {_M}) % {_TWO32} AS h,
  CASE WHEN source IS NULL THEN 't' ELSE concat('s', source) END AS src FROM d),
s0 AS (SELECT src, sum(size)::BIGINT AS source_size FROM r GROUP BY src),
s1 AS (SELECT *, (row_number() OVER (ORDER BY src) - 1) % 3 AS k FROM s0),
s2 AS (SELECT src, source_size, CASE k WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS w,
  CASE k WHEN 0 THEN 0.5 WHEN 1 THEN 0 ELSE -0.5 END::DOUBLE AS ramp, (3 * source_size)::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, ((SELECT sum(source_size) FROM s0)::DOUBLE
  - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM s2),
s4 AS (SELECT *, least(coalesce((SELECT here FROM s3 WHERE cap >= here * w ORDER BY cap / w, src LIMIT 1) * w, cap), cap) AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM s4),
s6 AS (SELECT *, floor(target - passes * source_size + 0.5)::BIGINT AS rest FROM s5),
x AS (SELECT r.doc_id, r.size, s6.*, coalesce(sum(r.size) OVER (PARTITION BY r.src ORDER BY h, r.doc_id NULLS FIRST, r.size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r JOIN s6 USING (src)),
y AS (SELECT *, greatest(0, least(size, rest - start)) AS part FROM x),
z AS (SELECT *, CASE WHEN size > 0 THEN passes + CASE WHEN part > 0 THEN 1 ELSE 0 END ELSE 0 END::BIGINT AS n_copies FROM y)
SELECT doc_id, size, source_size, target, (passes * size + part)::BIGINT AS taken, n_copies,
  CASE WHEN n_copies > 0 THEN {_sql_position("0", "CASE WHEN passes > 0 THEN size ELSE part END")} END AS first_position,
  CASE WHEN n_copies > 0 THEN {_sql_position("n_copies - 1", "CASE WHEN part > 0 THEN part ELSE size END")} END AS last_position
FROM z
"""
