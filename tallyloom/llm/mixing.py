"""Mixing of sources to target weights on a curriculum that changes over time. Only built-in functions.

A source's target is its share of the mix, at most ``most`` times its size; what is over is shared again by weight. Its documents stand
in a hashed order, and the target is cut into passes over that order, so a document is taken once in each whole pass, and
once more if the last, partial pass reaches it. The source's weight runs linearly over the training from ``start`` to ``end`` times its mean
(a ``Schedule``), so its cumulative demand is a quadratic of the time; the inverse at the middle of a
document's tokens is the document's position, and documents are sorted by range on it.

Running totals go by buckets of the hashed order, of about ``bucket_rows`` rows, so a source with a third of all rows is
cut like any other; only bucket totals, not rows, are summed along a source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.runtime import materialise

CYCLE = (3.0, 1.0, 2.0)
RESULTS = ("__size", "__source_size", "__target", "__copies", "__positions")


@dataclass(frozen=True)
class Schedule:
    """Relative weight of every ``period``-th source at the begin and the end of the training; the mean over time is one."""

    starts: tuple[float, ...] = (1.5, 1.0, 0.5)

    def start(self, rank: Column) -> Column:
        out = F.lit(self.starts[-1])
        for i, value in enumerate(self.starts[:-1]):
            out = F.when(F.pmod(rank - 1, F.lit(len(self.starts))) == i, F.lit(value)).otherwise(out)
        return out


def size_of(text: str) -> Column:
    """Words of a text."""
    return F.size(F.filter(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")).cast("long")


def order_of(id_column: Column, seed: int) -> Column:
    """Hashed order of documents, that other engines can work out too."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(id_column.cast("string"), F.lit(""))))


def targets(sizes: DataFrame, weights: tuple[float, ...] = CYCLE, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source``, ``rank``, ``source_size`` and ``target`` of each source; ``sizes``: ``source`` and ``source_size``.

    Sources stand by code point, null last, and weigh ``weights``, repeating. A source is full when the level, the mix per weight,
    reaches ``most`` times its size per weight. Sorted by that ratio, the full ones are a prefix, so one pass of running
    sums finds the level: the first source that the rest of the mix does not fill. All sources are full if there is too little.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(everything))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.lit(most) * F.col("source_size"))
    full = Window.orderBy(F.col("_cap") / F.col("_w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    total = F.sum("source_size").over(every) * F.lit(share)
    left = F.greatest(total - F.coalesce(F.sum("_cap").over(full), F.lit(0.0)), F.lit(0.0))
    rest = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(full), F.lit(0.0))
    # The level if all sources before this one are full; it counts where this one is not.
    level = ranked.withColumn("_level", left / rest)
    level = level.withColumn("_level", F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(every))
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_w")))
    return level.select("source", "rank", "source_size", target.alias("target"))


def position(progress: Column, start: Column) -> Column:
    """The time in [0, 1] when a share ``progress`` of a source is used up, its weight running from ``start`` to ``2 - start``."""
    bend = F.lit(1.0) - start
    root = F.sqrt(F.greatest(start * start + 4 * bend * progress, F.lit(0.0)))
    return F.when(bend == 0, progress).otherwise(F.least(F.greatest(2 * progress / (start + root), F.lit(0.0)), F.lit(1.0)))


def mixed(docs: DataFrame, text: str | None = "text", source: str = "source", id_column: str = "doc_id", size: str | None = None, weights: tuple[float, ...] = CYCLE, share: float = 1.5, most: float = 2.0, schedule: Schedule = Schedule(), bucket_rows: int = 2_000, seed: int = 11) -> DataFrame:
    """Rows of ``docs`` with ``__size``, ``__source_size``, ``__target``, ``__copies`` (times it is taken) and
    ``__positions`` (one for each time, in [0, 1]).

    Documents are taken whole. The partial pass takes documents whose middle lies within it, so a source misses its target by
    no more than half a document. Null sources are a source of their own; a null or empty text has size 0 and costs nothing.
    Rows of one id stand side by side, in the order of size and text; rows that are alike in all three are interchangeable.
    Rows travel as one struct, so no column of theirs can clash; columns named like one of the five results are replaced.
    The text travels beside the struct: a window that sorts by a part of a struct takes that part along once more.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns if c != text])
    of = lambda c: F.col("__text") if c == text else F.col("__row")[c]
    key = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))
    measured = F.col(size).cast("long") if size else size_of(text)
    beside = [F.col(f"`{text}`").alias("__text")] if text else []
    sized = docs.select(row.alias("__row"), *beside, measured.alias("__size"), key.alias("__key"), order_of(F.col(id_column), seed).alias("__order"))
    narrow = materialise(sized.select(of(source).alias("source"), "__key", "__order", "__size"), "sizes")
    counted = materialise(narrow.groupBy("source").agg(F.sum("__size").alias("source_size"), F.count("*").alias("_rows")), "sources")
    # Buckets are ranges of the order, as many as the largest source needs.
    largest = counted.agg(F.coalesce(F.max("_rows"), F.lit(0)).alias("n")).first()["n"]
    bits = min(40, (int(largest) // bucket_rows).bit_length())
    bucket = F.shiftright(F.conv(F.substring("__order", 1, 10), 16, 10).cast("long"), 40 - bits)
    plan = targets(counted.drop("_rows"), weights, share, most)
    along = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = narrow.groupBy("__key", bucket.alias("__bucket")).agg(F.sum("__size").alias("_n"))
    before = buckets.withColumn("_before", F.coalesce(F.sum("_n").over(along), F.lit(0))).drop("_n")
    plan = plan.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("__key"), F.col("rank").alias("__rank"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    known = materialise(before.join(plan, "__key"), "buckets")
    rows = sized.withColumn("__bucket", bucket).join(known, ["__key", "__bucket"])
    ties = [of(id_column), F.col("__size"), *([of(text)] if text else [])]
    inside = Window.partitionBy("__key", "__bucket").orderBy("__order", *ties).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("_before") + F.coalesce(F.sum("__size").over(inside), F.lit(0))
    rows = rows.withColumn("__middle", begin + F.col("__size") / 2)
    passes = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(1.0))
    whole = F.floor(passes + F.lit(1e-12))
    part = F.col("__target") - whole * F.col("__source_size")
    copies = whole + F.when((part > 0) & (F.col("__middle") <= part), 1).otherwise(0)
    rows = rows.withColumn("__copies", copies.cast("int"))
    used = F.when(F.col("__target") > 0, F.col("__target")).otherwise(F.lit(1.0))
    at = lambda k: position(F.least((F.col("__middle") + k * F.col("__source_size")) / used, F.lit(1.0)), schedule.start(F.col("__rank")))
    rows = rows.withColumn("__positions", F.when(F.col("__copies") > 0, F.transform(F.sequence(F.lit(0), F.col("__copies") - 1), at)).otherwise(F.array().cast("array<double>")))
    return rows.select(*[of(c).alias(c) for c in docs.columns if c not in RESULTS], *RESULTS)


def curriculum(docs: DataFrame, position_column: str = "position", **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, with its position, sorted by ranges of it. A column of ``docs`` with the position's name is replaced."""
    mix = mixed(docs, **options)
    placed = mix.withColumn(position_column, F.explode("__positions")).drop(*RESULTS)
    return placed.repartitionByRange(position_column).sortWithinPartitions(position_column)


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('11-' || coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM s),
c AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((r - 1) % 3 + 1)::INT] AS w, 2.0::DOUBLE * source_size AS cap FROM k),
l AS (SELECT *, greatest(sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER f, 0), 0) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level
  FROM c WINDOW f AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, max(CASE WHEN level * w <= cap THEN level END) OVER () AS best FROM l),
t AS (SELECT source, source_size, [1.5::DOUBLE, 1.0::DOUBLE, 0.5::DOUBLE][((r - 1) % 3 + 1)::INT] AS start, CASE WHEN best IS NULL THEN cap ELSE least(cap, best * w) END AS target FROM m),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.start, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size / 2.0 AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 1 END AS whole FROM x),
y AS (SELECT *, whole + CASE WHEN target - whole * source_size > 0 AND middle <= target - whole * source_size THEN 1 ELSE 0 END AS copies,
  least(middle::DOUBLE / CASE WHEN target > 0 THEN target ELSE 1 END, 1.0::DOUBLE) AS used, 1.0::DOUBLE - start AS bend FROM p),
z AS (SELECT *, CASE WHEN bend = 0 THEN used ELSE least(greatest(2 * used / (start + sqrt(greatest(start * start + 4 * bend * used, 0))), 0), 1) END AS place FROM y)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * copies)::BIGINT AS taken, CASE WHEN copies > 0 THEN round(place, 9) END AS position FROM z
"""
