"""Skew-safe building blocks.

A window or join key may own a third of all rows. The helpers here keep every
task bounded in that case while leaving ordinary keys on the plain path; both paths give the same rows.

``hot_groups`` finds heavy keys by share of the input, so by pigeonhole there are
at most ``1 / HOT_SHARE`` of them. It runs one aggregation when the plan is built (two if there are any) and returns 64-bit
hashes with the number of pieces to cut each key into (under two megabytes).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.runtime import materialise

HOT_SHARE = 1e-5
HOT_FLOOR = 200_000
LISTED = 64


def hot_groups(
    df: DataFrame,
    keys: Sequence[str],
    rows: str | None = None,
    share: float = HOT_SHARE,
    floor: int = HOT_FLOOR,
) -> dict[int, int]:
    """Hashes of the keys holding more than ``share`` of all rows and more than ``floor``, each with the
    number of pieces that bring it down to ``floor`` rows.

    ``rows`` names a column with pre-aggregated row counts, if there is one.
    """
    weight = F.sum(rows) if rows else F.count(F.lit(1))
    counts = df.groupBy(F.xxhash64(*keys).alias("_hot")).agg(weight.alias("_n"))
    # Fewer than 1 / share keys can hold more than that share, and they are the largest.
    heavy = counts.where(F.col("_n") > floor).orderBy(F.desc("_n")).limit(int(1 / share) + 1).collect()
    if not heavy:
        return {}
    total = df.agg(weight.alias("t")).first()["t"]
    return {r["_hot"]: 1 + int(r["_n"]) // max(1, floor) for r in heavy if r["_n"] > total * share}


def with_pieces(df: DataFrame, keys: Sequence[str], hot: Mapping[int, int], out: str) -> DataFrame:
    """Add the number of pieces of each row's key, null for a key that is not hot. Many hot keys are joined as a small table."""
    if not hot:
        return df.withColumn(out, F.lit(None).cast("int"))
    if len(hot) <= LISTED:
        cases = reduce(lambda c, h: c.when(F.col("_hash") == h, F.lit(hot[h])), hot, F)
        return df.withColumn("_hash", F.xxhash64(*keys)).withColumn(out, cases.otherwise(F.lit(None))).drop("_hash")
    table = df.sparkSession.createDataFrame(list(hot.items()), f"_hash long, {out} int")
    return df.withColumn("_hash", F.xxhash64(*keys)).join(F.broadcast(table), "_hash", "left").drop("_hash")


def spread_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    hot: Mapping[int, int],
    how: str = "left",
) -> DataFrame:
    """Join many rows to a lookup with one row per key, salting the hot keys only, each by its share.

    ``spread`` are row columns whose hash fans a hot key out; the hash is fixed, so
    a retried task sends each row to the same place. Rows with a null key can match
    nothing: an inner join drops them first, a left join spreads them.
    """
    keys = list(keys)
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    if how == "inner":
        rows = rows.where(~null_key)
        if not hot:
            return rows.join(lookup, keys, how)
    # Rows with a null key meet nothing, so any spread will do.
    scatter = max([64, *hot.values()])
    pieces = F.when(null_key, F.lit(scatter)).otherwise(F.coalesce("_pieces", F.lit(1)))
    left = with_pieces(rows, keys, hot, "_pieces")
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), pieces).cast("int")).drop("_pieces")
    right = with_pieces(lookup, keys, hot, "_pieces")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


@dataclass(frozen=True)
class Running:
    """A running aggregate: ``kind`` is sum, count, last (non-null), max or min."""

    out: str
    kind: str
    expr: Column


_IN_BLOCK = {
    "sum": F.sum,
    "count": F.count,
    "last": lambda c: F.last(c, ignorenulls=True),
    "max": F.max,
    "min": F.min,
}
_CARRY = {**_IN_BLOCK, "count": F.sum}


def _combine(kind: str, carry: Column, inner: Column) -> Column:
    if kind in ("sum", "count"):
        zero = F.lit(0)
        both = F.coalesce(carry, zero) + F.coalesce(inner, zero)
        if kind == "count":
            return both.cast("bigint")
        return F.when(carry.isNull() & inner.isNull(), F.lit(None)).otherwise(both)
    if kind == "last":
        return F.coalesce(inner, carry)
    return F.greatest(carry, inner) if kind == "max" else F.least(carry, inner)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Sequence[Running],
    share: float = HOT_SHARE,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """Running aggregates over ``order`` within ``keys``, current row included; nulls come first.

    ``order`` must be a total order, of any types. Ordinary groups are one window. Rows of hot groups, or all rows if there are
    no keys, are cut into blocks by range of the keys and the order itself and written out; a window runs inside each block, and the
    totals of the blocks before are added. There are as many blocks as partitions, so what is summed across blocks is small.
    """
    keys, order = list(keys), list(order)
    ordered = [F.col(c).asc_nulls_first() for c in order]

    def plain(rows: DataFrame) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*ordered).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumns({s.out: _IN_BLOCK[s.kind](s.expr).over(window) for s in specs})

    if keys:
        hot = hot_groups(df, keys, share=share, floor=floor)
        if not hot:
            return plain(df)
        marked = with_pieces(df, keys, hot, "_pieces")
        heavy, light = (marked.where(c).drop("_pieces") for c in ("_pieces IS NOT NULL", "_pieces IS NULL"))
    else:
        heavy, light = df, None

    # Adding totals widens decimals, so sums get back the type that one window gives.
    kinds = {s.out: plain(df.limit(0)).schema[s.out].dataType for s in specs if s.kind == "sum"}
    inputs = [f"_v{i}" for i in range(len(specs))]
    valued = heavy.withColumns({n: s.expr for n, s in zip(inputs, specs)})
    dealt = valued.repartitionByRange(*[F.col(c).asc_nulls_first() for c in keys], *ordered)
    blocks = materialise(dealt.withColumn("_block", F.spark_partition_id()), "blocks")
    inside = Window.partitionBy(*keys, "_block").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = blocks.withColumns({f"{n}_in": _IN_BLOCK[s.kind](F.col(n)).over(inside) for n, s in zip(inputs, specs)})

    totals = []
    for name, spec in zip(inputs, specs):
        if spec.kind == "last":
            stamped = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
            totals.append(F.max_by(F.col(name), F.when(F.col(name).isNotNull(), stamped)).alias(f"{name}_t"))
        else:
            totals.append(_IN_BLOCK[spec.kind](F.col(name)).alias(f"{name}_t"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    at = [*keys, "_block"]
    openings = blocks.groupBy(*at).agg(*totals).select(
        *[F.col(c).alias(f"_o_{c}") for c in at],
        *[_CARRY[s.kind](F.col(f"{n}_t")).over(before).alias(f"{n}_c") for n, s in zip(inputs, specs)],
    )
    # One row for each block and each hot key that begins in it.
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in at])
    joined = rows.join(F.broadcast(openings), on, "left")
    both = {s.out: _combine(s.kind, F.col(f"{n}_c"), F.col(f"{n}_in")) for n, s in zip(inputs, specs)}
    joined = joined.withColumns({n: c.cast(kinds[n]) if n in kinds else c for n, c in both.items()}).select(*df.columns, *[s.out for s in specs])
    return joined if light is None else joined.unionByName(plain(light))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row of each key; a partial aggregate, so no group is gathered."""
    keys = list(keys)
    # The grouping carries the key already. Numbers with a fraction are grouped in a normal form, so they stay in the row.
    exact = {c for c, kind in df.dtypes if c in keys and kind in ("string", "int", "bigint", "date")}
    held = [c for c in df.columns if c not in exact] or df.columns
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*held), F.struct(*order)).alias("_row"))
    return best.select(*[F.col("_row")[c].alias(c) if c in held else F.col(c) for c in df.columns])
