"""Mixing sources to target weights, on a time-varying curriculum. DataFrame functions only.

Each source has a weight and a schedule: how its weight moves over training time, 0 to 1, as a piecewise linear curve. The
curve's integral up to t is the share of the source's tokens that training has asked for by t. A source's documents stand in
the order of a hash of their id, one pass after another; a document's place in that stream, as a share of the source's target,
goes through the inverse of the integral and becomes its training position. Documents are range-sorted by position.

Targets are filled like water: shares by weight, none above max_repeat times its source's size, the excess to the others.

No step gathers a source: running sums are made over (source, hash range) groups first and within such a group last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: (time, factor) knots of each schedule, dealt to the sources in turn; each integrates to 1.
SCHEDULES = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)),
)

#: Ranges of the hash by which the documents of one source are split.
RANGES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def inverse(fraction: Column, knots) -> Column:
    """The time by which the given share of a schedule's integral is reached."""
    pieces, total = [], 0.0
    for (t0, m0), (t1, m1) in zip(knots, knots[1:], strict=False):
        area = (m0 + m1) / 2 * (t1 - t0)
        pieces.append((total, t0, m0, (m1 - m0) / (t1 - t0)))
        total += area
    if total <= 0:
        raise ValueError("a schedule needs a positive integral")
    asked = fraction * F.lit(total)
    out = None
    for start, t0, m0, slope in reversed(pieces):
        y = F.greatest(asked - F.lit(start), F.lit(0.0))
        root = F.lit(m0) + F.sqrt(F.greatest(F.lit(m0 * m0) + F.lit(2 * slope) * y, F.lit(0.0)))
        here = F.when(root > 0, F.lit(t0) + F.lit(2.0) * y / root).otherwise(F.lit(t0))
        out = here if out is None else F.when(asked < F.lit(following), here).otherwise(out)
        following = start
    return F.least(out, F.lit(1.0))


def targets(sources: DataFrame, weights=(1, 2, 3), share: float = 1.0, max_repeat: int = 3) -> DataFrame:
    """A row per source, with rank (from 0), target and want (the target in whole words). sources: s, source_size."""
    order, none = Window.orderBy("s"), Window.partitionBy()
    weight = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(weight, F.col("rank") % len(weights) + 1)).withColumn("cap", F.lit(float(max_repeat)) * F.col("source_size"))
    full = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    ranked = ranked.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(none))
    before = F.coalesce(F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("total") - before) / F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", level)
    fits = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(none)
    filled = ranked.withColumn("fits", fits)
    target = F.when(F.col("fits").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("fits.level") * F.col("weight")))
    return filled.withColumn("target", target).withColumn("want", F.floor(target + F.lit(0.5)).cast("long")).select("s", "source_size", "rank", "target", "want")


def _placed(docs: DataFrame, weights, share: float, max_repeat: int, *keep: Column) -> DataFrame:
    """Each row with its source's figures, its place before others in its source's stream, and what the mix takes of it. keep: columns that come along."""
    s = F.when(F.col("source").isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), F.col("source")))
    place = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")
    slim = cut(docs.select("doc_id", s.alias("s"), word_count(F.col("text")).alias("size"), place.alias("place"), *keep).withColumn("part", F.shiftright("place", 36).cast("int")))
    parts = slim.groupBy("s", "part").agg(F.sum("size").alias("part_size"))
    chain = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("part_before", F.coalesce(F.sum("part_size").over(chain), F.lit(0)))
    sources = targets(slim.groupBy("s").agg(F.sum("size").alias("source_size")), weights, share, max_repeat)
    joined = slim.join(parts.join(sources, "s").drop("part_size"), ["s", "part"])
    inside = Window.partitionBy("s", "part").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = joined.withColumn("before", F.col("part_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("want") / F.col("source_size"))).otherwise(0).cast("long")
    placed = placed.withColumn("passes", passes).withColumn("rest", F.col("want") - F.col("passes") * F.col("source_size"))
    part_taken = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before"))).cast("long")
    placed = placed.withColumn("cut_taken", part_taken).withColumn("taken", F.col("passes") * F.col("size") + F.col("cut_taken"))
    copies = F.when(F.col("taken") > 0, F.col("passes") + (F.col("cut_taken") > 0).cast("int")).otherwise(0).cast("long")
    return placed.withColumn("copies", copies)


def _position(share_before: Column, schedules) -> Column:
    position = None
    for i, knots in enumerate(schedules):
        mine, at = F.col("rank") % len(schedules) == i, inverse(share_before, knots)
        position = F.when(mine, at) if position is None else position.when(mine, at)
    return position


def mix(docs: DataFrame, *, weights=(1, 2, 3), share: float = 1.0, max_repeat: int = 3, schedules=SCHEDULES) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, position; sorted by position.

    taken: words that the mix takes of the document, repeats counted: every pass over a source takes each document once, the
    last pass stops at the target and cuts one document. copies: passes that touch the document; position: of its first copy,
    null where nothing is taken.
    Null text counts 0 words. Null source: a source of its own, after all others. Null doc_id and repeated doc_ids are rows
    like any other. Without rows the result is empty; other columns are ignored.
    """
    placed = _placed(docs, weights, share, max_repeat)
    position = _position(F.col("before") / F.greatest(F.col("want"), F.lit(1)), schedules)
    placed = placed.withColumn("position", F.when(F.col("taken") > 0, position))
    return placed.select("doc_id", "size", "source_size", "target", "taken", "copies", "position").orderBy("position", "doc_id", "size")


def arrange(docs: DataFrame, *, weights=(1, 2, 3), share: float = 1.0, max_repeat: int = 3, schedules=SCHEDULES) -> DataFrame:
    """docs in training order, with their columns: each as often as passes touch it, at the positions of its copies.

    The document that a source's last pass cuts is taken whole. Documents without words (null and empty texts) are not taken. Null source: a source of its
    own. Null and repeated doc_ids are rows like any other; rows that are equal in all columns stand for one another. Without rows the result is empty; other
    columns come along, whatever their names.
    """
    key = F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64(*docs.columns).cast("string"), F.md5(F.col("text").cast("binary"))))).alias("key")
    placed = _placed(docs, weights, share, max_repeat, key).where("copies > 0")
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    position = _position((F.col("copy") * F.col("source_size") + F.col("before")) / F.greatest(F.col("want"), F.lit(1)), schedules)
    plan = copies.select("key", position.alias("position"), F.col("copy"), "doc_id")
    # Rows that are equal are one by the time they meet the plan, which has a row for each copy of each.
    once = docs.select(key, F.struct(*docs.columns).alias("row")).groupBy("key").agg(F.first("row").alias("row"))
    return once.join(plan, "key").orderBy("position", "doc_id", "copy", "key").select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS s,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS place FROM documents),
n AS (SELECT s, sum(size)::BIGINT AS source_size FROM d GROUP BY s),
r AS (SELECT *, row_number() OVER (ORDER BY s COLLATE "C") - 1 AS rank FROM n),
w AS (SELECT *, (rank % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM r),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, cap / weight * 1e6 + rank) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT s, source_size, rank, least(cap, coalesce((SELECT level FROM f), 'Infinity'::DOUBLE) * weight) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.rank, floor(t.target + 0.5)::BIGINT AS want,
    coalesce(sum(d.size) OVER (PARTITION BY d.s ORDER BY d.place, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM d JOIN t USING (s)),
q AS (SELECT *, CASE WHEN source_size > 0 THEN want // source_size ELSE 0 END AS passes FROM p),
k AS (SELECT *, greatest(0, least(size, want - passes * source_size - before))::BIGINT AS cut_taken FROM q),
m AS (SELECT *, passes * size + cut_taken AS taken, before / greatest(want, 1)::DOUBLE AS x FROM k)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
    CASE WHEN taken > 0 THEN passes + (cut_taken > 0)::INT ELSE 0 END::BIGINT AS copies,
    CASE WHEN taken > 0 THEN least(1.0, CASE rank % 3 WHEN 0 THEN 0.0 + 2.0 * x / (1.0 + sqrt(greatest(1.0 + 0.0 * x, 0.0)))
      WHEN 1 THEN 0.0 + 2.0 * x / (1.5 + sqrt(greatest(2.25 - 2.0 * x, 0.0)))
      ELSE CASE WHEN x < 0.3125 THEN 0.0 + 2.0 * x / (0.25 + sqrt(greatest(0.0625 + 3.0 * x, 0.0)))
        ELSE 0.5 + 2.0 * greatest(x - 0.3125, 0.0) / (1.0 + sqrt(greatest(1.0 + 3.0 * greatest(x - 0.3125, 0.0), 0.0))) END END) END AS position
FROM m
"""
