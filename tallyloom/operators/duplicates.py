"""Duplicate detection without pair explosion.

Rows are first grouped into points that a rule (or all of them) cannot tell apart (same key, day, cents and
source), each with its row count and first id. Points are few where rows pile up, so a hot key
costs one point and not its square. Rules then compare points. Results are whole: every row
that has a match is listed with the number of its matches and the earliest of them, and point
pairs carry the counts that the row pairs would have had.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.normalise import content_hash
from tallyloom.functions.skew import HOT_FLOOR, HOT_SHARE, hot_groups, spread_join
from tallyloom.operators.card_payments import settled_payments
from tallyloom.operators.edit_join import similar_pairs
from tallyloom.runtime import materialise
from tallyloom.sources.tables import load_config

# Near-duplicate limits and the weights of the two distances.
MAX_DAYS, MAX_CENTS = 2, 50
DAY_WEIGHT, AMOUNT_WEIGHT = 0.3, 0.7
# Days and cents of a tile in which points are counted.
TILE_DAYS, TILE_CENTS = 8, 1_000
# Ids of several rows that are broadcast.
SENT = 1_000_000


def cents(col: Column) -> Column:
    return F.round(col * 100).cast("bigint")


def day_number(col: Column) -> Column:
    return F.datediff(col, F.lit("1970-01-01").cast("date")).cast("bigint")


def near_points(df: DataFrame) -> DataFrame:
    """One row per (day, cents, source): row count and first id."""
    return (
        df.select(day_number(F.col("date")).alias("day"), cents(F.col("amount")).alias("cents"), "source", "tx_id")
        .where(F.col("day").isNotNull() & F.col("cents").isNotNull() & F.col("source").isNotNull())
        .groupBy("day", "cents", "source")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("tx_id").alias("first_id"))
    )


def near_duplicate_points(df: DataFrame) -> DataFrame:
    """Pairs of points under two days and 0.50 apart from different sources, each once.

    Grid cells are one day by fifty cents. A cell holds at most fifty points per
    source, whatever the number of rows, and each pair of neighbouring cells is visited from
    one side only, so the equi-join on the cell is bounded without a cap.
    """
    points = near_points(df).withColumn("cell", F.floor(F.col("cents") / MAX_CENTS))
    ahead = F.array(*[
        F.struct(F.lit(d).alias("dd"), F.lit(c).alias("dc")) for d, c in [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    ])
    left = points.select("*", F.inline(ahead)).select(
        (F.col("day") + F.col("dd")).alias("cell_day"),
        (F.col("cell") + F.col("dc")).alias("cell"),
        ((F.col("dd") == 0) & (F.col("dc") == 0)).alias("same_cell"),
        F.struct("day", "cents", "source", "rows", "first_id").alias("p"),
    )
    right = points.select(
        F.col("day").alias("cell_day"), "cell", F.struct("day", "cents", "source", "rows", "first_id").alias("q")
    )
    joined = left.hint("merge").join(right, ["cell_day", "cell"]).where(
        (F.col("p.source") != F.col("q.source"))
        & (F.abs(F.col("p.cents") - F.col("q.cents")) < MAX_CENTS)
        & (~F.col("same_cell") | (F.col("p.source") < F.col("q.source")))
    )
    # Within one pair, "a" is the point with the smaller first id.
    first, second = F.least("pi", "qi"), F.greatest("pi", "qi")
    tagged = joined.select(
        F.struct(F.col("p.first_id").alias("i"), F.col("p").alias("v")).alias("pi"),
        F.struct(F.col("q.first_id").alias("i"), F.col("q").alias("v")).alias("qi"),
    )
    pairs = tagged.select(first.alias("a"), second.alias("b")).select(
        F.col("a.v").alias("a"), F.col("b.v").alias("b")
    )
    score = (
        F.lit(1.0)
        - DAY_WEIGHT * F.abs(F.col("a.day") - F.col("b.day")) / float(MAX_DAYS)
        - AMOUNT_WEIGHT * F.abs(F.col("a.cents") - F.col("b.cents")) / float(MAX_CENTS)
    )
    return pairs.select(
        F.col("a.first_id").alias("id_a"),
        F.col("b.first_id").alias("id_b"),
        F.col("a.source").alias("source_a"),
        F.col("b.source").alias("source_b"),
        F.col("a.day").alias("day_a"),
        F.col("b.day").alias("day_b"),
        F.col("a.cents").alias("cents_a"),
        F.col("b.cents").alias("cents_b"),
        F.col("a.rows").alias("rows_a"),
        F.col("b.rows").alias("rows_b"),
        (F.col("a.rows") * F.col("b.rows")).alias("row_pairs"),
        score.alias("score"),
    )


def _best_two(points: DataFrame, keys: Sequence[str], share: float, floor: int) -> DataFrame:
    """Per key: all rows, the smallest id with its source, and the smallest id of another source."""
    first = points.groupBy(*keys).agg(
        F.sum("rows").alias("rows"),
        F.count(F.lit(1)).alias("_points"),
        F.min(F.struct("first_id", "source")).alias("best"),
    )
    hot = hot_groups(first, keys, rows="_points", share=share, floor=floor)
    marked = spread_join(points.drop("rows"), first.drop("rows"), keys, ["source"], hot)
    second = (
        marked.where(F.col("source") != F.col("best.source"))
        .groupBy(*keys)
        .agg(F.min("first_id").alias("second_id"))
    )
    return first.join(second, list(keys), "left")


def _tile(col: str | Column, size: int) -> Column:
    return F.floor((F.col(col) if isinstance(col, str) else col) / size)


def _dealt(points: DataFrame) -> DataFrame:
    """Points by tiles of days and cents, those near a border to both sides, so a point travels 1.4 times; in one of them it is at ``home``."""
    around = lambda c, by, size: F.explode(F.array_distinct(F.array(_tile(F.col(c) - by, size), _tile(F.col(c) + by, size))))
    dealt = points.select("*", around("day", MAX_DAYS - 1, TILE_DAYS).alias("tile_day")).select("*", around("cents", MAX_CENTS - 1, TILE_CENTS).alias("tile"))
    return dealt.withColumn("home", (F.col("tile_day") == _tile("day", TILE_DAYS)) & (F.col("tile") == _tile("cents", TILE_CENTS)))


def _met(points: DataFrame) -> DataFrame:
    """Points that have rows of other sources under two days and 0.50 away, with their number as ``matches``.

    In a tile a day sees the days beside it, and differences of running sums count the rows in reach. The first point of a spot (day, cents) is its ``lead`` and
    knows the smallest id of another source, ``second_id``; the others have the lead's id as ``partner``.
    """
    days, reach = MAX_DAYS - 1, MAX_CENTS - 1
    dealt = _dealt(points).withColumn("first_id", F.when(F.col("home"), F.col("first_id"))).repartition("tile_day", "tile")
    seen = dealt.withColumn("on", F.explode(F.sequence(F.col("day") - days, F.col("day") + days)))
    seen = seen.where(F.col("tile_day") == _tile("on", TILE_DAYS)).withColumn("first_id", F.when(F.col("on") == F.col("day"), F.col("first_id")))

    def in_reach(*more: str) -> Column:
        along = Window.partitionBy("tile_day", "tile", "on", *more).orderBy("cents")
        up_to = lambda end: F.coalesce(F.sum("rows").over(along.rangeBetween(Window.unboundedPreceding, end)), F.lit(0))
        return up_to(reach) - up_to(-reach - 1)

    met = seen.withColumn("matches", in_reach() - in_reach("source")).where((F.col("on") == F.col("day")) & F.col("home") & (F.col("matches") > 0))
    # All points of a spot are at home in one tile.
    spot = Window.partitionBy("tile_day", "tile", "day", "cents")
    met = met.withColumn("best", F.min(F.struct("first_id", "source")).over(spot)).withColumn("lead", F.col("source") == F.col("best.source"))
    met = met.withColumn("other_id", F.min(F.when(~F.col("lead"), F.col("first_id"))).over(spot))
    return met.select(
        "day", "cents", "source", "rows", "first_id", "matches", "lead",
        F.when(F.col("lead"), F.col("other_id")).alias("second_id"), F.when(F.col("lead"), F.col("other_id")).otherwise(F.col("best.first_id")).alias("partner"),
    )


def _nearest(points: pa.Table) -> pa.Table:
    """Best partner and score of the points without one in their own spot, among whole tiles; both are null if no partner has an id.

    Spots lie on one line, days of a tile beside each other with gaps beyond any reach. On each day and to each side the nearest spot counts that has an id of
    another source; spots that have none stand in runs of one source, which are jumped over. Spots whose lead has no id matter to its source alone, so they lie on a line of each source.
    """
    points = points.combine_chunks()
    col = lambda name: points.column(name).to_numpy()
    text = lambda name: points.column(name).combine_chunks()
    tile_day, tile, lead, n = col("tile_day"), col("tile"), col("lead"), points.num_rows
    moved = np.r_[False, (tile_day[1:] != tile_day[:-1]) | (tile[1:] != tile[:-1])]
    width = 4 * TILE_CENTS
    line = (np.cumsum(moved) * 2 * TILE_DAYS + col("day") - tile_day * TILE_DAYS + MAX_DAYS) * width + col("cents") - tile * TILE_CENTS + MAX_CENTS
    first, second = text("first_id"), text("second_id")
    ids = pa.concat_arrays([first, second])
    place = np.empty(len(ids), np.int64)
    place[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
    named, paired = (a.is_valid().to_numpy(zero_copy_only=False) for a in (first, second))
    source = text("source").dictionary_encode().indices.to_numpy().astype(np.int64)
    asked = np.flatnonzero(col("home") & ~(lead & paired))
    best_score, best_place, best_id = np.full(len(asked), -np.inf), np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
    span = int(line.max()) + 2 * width
    for spots, on, here in ((lead & named, line, line), (lead & ~named & paired, line + source * span, line + source * span)):
        spots = np.flatnonzero(spots)
        if not len(spots):
            continue
        spots = spots[np.argsort(on[spots], kind="stable")]
        at, whose, size = on[spots], source[spots], len(spots)
        own = source[asked]
        kind = np.where(paired[spots], -1 - np.arange(size), whose)
        begins = np.maximum.accumulate(np.where(np.r_[True, kind[1:] != kind[:-1]], np.arange(size), 0))
        ends = np.minimum.accumulate(np.where(np.r_[kind[1:] != kind[:-1], True], np.arange(size), size)[::-1])[::-1]
        for days in range(1 - MAX_DAYS, MAX_DAYS):
            look = here[asked] + days * width
            after = np.searchsorted(at, look, side="right")
            for near, runs, step in ((after - 1, begins, -1), (after, ends, 1)):
                found = np.clip(near, 0, size - 1)
                to = np.where(kind[found] == own, runs[found] + step, near)
                found = np.clip(to, 0, size - 1)
                far = np.abs(at[found] - look)
                good = (to == found) & (far < MAX_CENTS)
                score = np.where(good, 1.0 - DAY_WEIGHT * abs(days) / float(MAX_DAYS) - AMOUNT_WEIGHT * far / float(MAX_CENTS), -np.inf)
                which = np.where(whose[found] != own, spots[found], spots[found] + n)
                better = good & ((score > best_score) | ((score == best_score) & (place[which] < best_place)))
                best_score, best_place, best_id = (np.where(better, new, old) for new, old in ((score, best_score), (place[which], best_place), (which, best_id)))
    none = np.isinf(best_score)
    kept = points.select(["day", "cents", "source", "rows", "matches"]).take(pa.array(asked))
    return kept.append_column("partner", ids.take(pa.array(best_id, mask=none))).append_column("score", pa.array(best_score, mask=none))


#: Spots that are worked on at once; a tile holds at most 10,980.
SPOTS = 50_000


def _partners(points: DataFrame) -> DataFrame:
    """Points of ``_met`` with their best ``partner`` and its ``score``: those of a spot with several sources have theirs, the others look around in their tile."""
    names = ["day", "cents", "source", "rows", "matches", "partner", "score"]
    # Where the lead has no id, the other points of the spot ask too.
    spots = _dealt(points.where("lead OR partner IS NULL").select("day", "cents", "source", "lead", "first_id", "second_id", "rows", "matches"))
    spots = spots.repartition("tile_day", "tile").sortWithinPartitions("tile_day", "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < SPOTS:
                continue
            table = pa.Table.from_batches(held)
            a, b = (table.column(c).to_numpy() for c in ("tile_day", "tile"))
            # The last tile may go on in the next batch.
            whole = int(np.flatnonzero((a != a[-1]) | (b != b[-1]))[-1:].sum() + 1) if (a != a[-1]).any() or (b != b[-1]).any() else 0
            if whole:
                yield from _nearest(table.slice(0, whole)).to_batches()
                held = table.slice(whole).combine_chunks().to_batches()
        if sum(b.num_rows for b in held):
            yield from _nearest(pa.Table.from_batches(held)).to_batches()

    kinds = dict(points.dtypes)
    found = spots.mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'double')}" for c in names))
    return points.where("partner IS NOT NULL").withColumn("score", F.lit(1.0)).select(*names).unionByName(found)


def near_duplicates(df: DataFrame, share: float = HOT_SHARE, floor: int = HOT_FLOOR) -> DataFrame:
    """Every row that has a near duplicate: how many it has, its best score and best partner.

    Partners are looked for among the points that have matches only, as a partner has one too. That
    works on spots (day, cents) that know the first ids of two different
    sources, so the cost depends neither on copies nor on the number of sources: a tile has a bounded number of spots, and a spot travels 1.4 times.
    """
    # Points and links are written out, as several steps read them.
    points = materialise(_met(near_points(df)), "points")
    keys = ["day", "cents", "source"]
    linked = materialise(_partners(points), "links")
    rows = df.withColumns({"day": day_number(F.col("date")), "cents": cents(F.col("amount"))})
    hot = hot_groups(linked, keys, rows="rows", share=share, floor=floor)
    joined = spread_join(rows, linked.drop("rows"), keys, ["tx_id"], hot, how="inner")
    return joined.select(
        "tx_id", "source", "date", "amount", "matches",
        F.col("partner").alias("best_partner"), F.col("score").alias("best_score"),
    )


def top_duplicates(pairs: DataFrame, n: int = 5) -> DataFrame:
    return pairs.orderBy(F.col("score").desc(), "id_a", "id_b").limit(n)



def load_duplicate_rules(path: str | None = None) -> list[dict]:
    return load_config("duplicate_rules", path)


def _key(field: str) -> Column:
    return cents(F.col("amount")) if field == "amount" else F.col(field)


def _day_limit(rule: Mapping) -> int:
    window = rule.get("window")
    if not window:
        return 0
    return -(-window["amount"] // 24) if window["unit"] == "hours" else window["amount"]


@dataclass(frozen=True)
class Per:
    """What links are found for, transactions or points of them: the columns of its id, of its smallest transaction, and of its number of transactions and of those with an id (none: one)."""

    id: str = "tx_id"
    first: str = "tx_id"
    rows: str | None = None
    known: str | None = None

    @property
    def held(self) -> list[str]:
        return list(dict.fromkeys(c for c in (self.id, self.first, self.rows, self.known) if c))

    def count(self, column: str | None) -> Column:
        return F.sum(column) if column else F.count(F.lit(1))


ROWS, POINTS = Per(), Per("point", "first_id", "rows", "known")


def _links(found: DataFrame, rule: Mapping, per: Per = ROWS, other: bool = True) -> DataFrame:
    """``other``: a row is no match of itself, which only its transactions tell; links of points keep the flag."""
    if other and per is ROWS:
        found = found.where(F.col("tx_id") != F.col("match_id"))
    return found.select(
        F.lit(rule["id"]).alias("rule_id"),
        per.id,
        "match_id",
        F.col("matches").cast("bigint").alias("matches"),
        F.lit(rule["priority"]).alias("priority"),
        F.lit(rule["confidence"]).cast("double").alias("confidence"),
        *([] if per is ROWS else [F.lit(other).alias("other")]),
    )


def _exact(df: DataFrame, rule: Mapping, share: float, floor: int, per: Per = ROWS) -> DataFrame:
    """Rows sharing all key fields (or their hash) with an earlier id."""
    if rule["strategy"] == "hash-match":
        keyed = df.select(*per.held, content_hash(*[F.col(f) for f in rule["fields"]]).alias("k0"))
        names = ["k0"]
    else:
        names = [f"k{i}" for i in range(len(rule["fields"]))]
        keyed = df.select(*per.held, *[_key(f).alias(n) for n, f in zip(names, rule["fields"])])
    groups = (
        keyed.dropna(subset=names)
        .groupBy(*names)
        .agg(F.min(per.first).alias("match_id"), per.count(per.rows).alias("n"), F.count(F.lit(1)).alias("_held"))
        .where(F.col("n") > 1)
        .withColumn("matches", F.col("n") - 1)
    )
    hot = hot_groups(groups, names, rows="_held", share=share, floor=floor)
    found = spread_join(keyed, groups.drop("n", "_held"), names, [per.id], hot, how="inner")
    return _links(found, rule, per)


def _windowed(
    df: DataFrame,
    rule: Mapping,
    fields: Sequence[str],
    extra: Mapping[str, Column],
    cases: Sequence[tuple[Column, Column]],
    frame: tuple[int, int],
    axis: str,
    share: float,
    floor: int,
    per: Per = ROWS,
) -> DataFrame:
    """Rows matched to points that agree on ``fields`` and lie within ``frame`` of them on ``axis``.

    Points are grouped by fields, axis value and ``extra``, so a frame holds at most one point for each axis
    value and value of ``extra``. Each of ``cases`` says which points it is about and which points these match; a point is
    in one case at most. Frames are summed up and never gathered. A row is linked when a candidate exists other than itself.
    """
    names = [f"k{i}" for i in range(len(fields))]
    keyed = df.select(
        *per.held,
        *[_key(f).alias(n) for n, f in zip(names, fields)],
        (day_number(F.col("date")) if axis == "day" else cents(F.col("amount"))).alias("axis"),
        *[c.alias(n) for n, c in extra.items()],
    ).dropna(subset=[*names, "axis", *extra])
    point_key = [*names, "axis", *extra]
    points = keyed.groupBy(*point_key).agg(per.count(per.rows).alias("rows"), F.min(per.first).alias("first_id"), F.count(F.lit(1)).alias("_held"))
    near = Window.partitionBy(*names).orderBy("axis").rangeBetween(*frame)
    found_in = lambda make, value: F.coalesce(*[F.when(mine, make(F.when(theirs, F.col(value))).over(near)) for mine, theirs in cases])
    itself = reduce(lambda a, b: a | b, [mine & theirs for mine, theirs in cases])
    totals = points.select(
        *point_key, "_held", found_in(F.min, "first_id").alias("match_id"), (found_in(F.sum, "rows") - F.when(itself, 1).otherwise(0)).alias("matches")
    ).where(F.col("matches") > 0)
    totals = materialise(totals, "totals")
    hot = hot_groups(totals, point_key, rows="_held", share=share, floor=floor)
    found = spread_join(
        keyed, totals.select(*point_key, "match_id", "matches"), point_key, [per.id], hot, how="inner"
    )
    return _links(found, rule, per)


def _cross_source(df: DataFrame, rule: Mapping, share: float, floor: int, per: Per = ROWS) -> DataFrame:
    """Rows with the same key fields in another source, for any number of sources."""
    names = [f"k{i}" for i in range(len(rule["fields"]))]
    keyed = df.select(*per.held, "source", *[_key(f).alias(n) for n, f in zip(names, rule["fields"])])
    points = (
        keyed.dropna(subset=[*names, "source", per.first])
        .groupBy(*names, "source")
        .agg(per.count(per.known).alias("rows"), F.min(per.first).alias("first_id"), F.count(F.lit(1)).alias("_held"))
    )
    # Points and links are written out, as several steps read them.
    points = materialise(points, "points")
    totals = _best_two(points, names, share, floor).where(F.col("second_id").isNotNull())
    hot = hot_groups(totals, names, rows="_points", share=share, floor=floor)
    sided = spread_join(
        points.withColumnRenamed("rows", "own_rows"), totals.drop("_points"), names, ["source"], hot, how="inner"
    )
    links = sided.select(
        *names,
        "source",
        "_held",
        (F.col("rows") - F.col("own_rows")).alias("matches"),
        F.when(F.col("best.source") != F.col("source"), F.col("best.first_id"))
        .otherwise(F.col("second_id"))
        .alias("match_id"),
    )
    links = materialise(links, "links")
    by = [*names, "source"]
    many = hot_groups(links, by, rows="_held", share=share, floor=floor)
    return _links(spread_join(keyed, links.drop("_held"), by, [per.id], many, how="inner"), rule, per, other=False)


def _similar_names(df: DataFrame, rule: Mapping, limit: int, share: float, floor: int, per: Per = ROWS) -> DataFrame:
    """Same day and amount, merchant names within ``limit`` edits (see ``edit_join``); copies of a name are one point."""
    keyed = df.select(
        *per.held, day_number(F.col("date")).alias("day"), cents(F.col("amount")).alias("cents"), "merchant"
    ).dropna(subset=["day", "cents", "merchant", per.first])
    by = ["day", "cents", "merchant"]
    made = keyed.groupBy(*by).agg(per.count(per.known).alias("rows"), F.min(per.first).alias("first_id"), F.count(F.lit(1)).alias("_held"))
    points = materialise(made, "points")
    pairs = similar_pairs(points, ["day", "cents"], "merchant", limit, ["rows", "first_id"])
    # Each side of a pair gains the other's rows; a point is its own match but for one row.
    both = F.array(F.struct(F.col("a.name").alias("merchant"), F.col("b").alias("o")), F.struct(F.col("b.name").alias("merchant"), F.col("a").alias("o")))
    gained = pairs.select("day", "cents", F.inline(both)).select(*by, F.col("o.rows").alias("rows"), F.col("o.first_id").alias("first_id"))
    near = points.select(*by, "rows", "first_id").unionByName(gained).groupBy(*by).agg(
        (F.sum("rows") - 1).alias("matches"), F.min("first_id").alias("match_id")
    ).where(F.col("matches") > 0)
    hot = hot_groups(points, by, rows="_held", share=share, floor=floor)
    found = spread_join(keyed, near, by, [per.id], hot, how="inner")
    return _links(found, rule, per)


def _sum_of_charges(df: DataFrame, rule: Mapping, share: float, floor: int) -> DataFrame:
    """Card payments of one bank equal to the summed charges of a card over the days before.

    Fields besides the date name the card that is paid; a payment then meets each trailing window of its own card (see ``card_payments``).
    Without such a field all charges count as one card's, and only the whole time window is looked at.
    """
    reach = _day_limit(rule)
    keys = [f for f in rule["fields"] if f != "date"]
    side = lambda rows: rows.select("tx_id", *keys, day_number(F.col("date")).alias("day"), cents(F.col("amount")).alias("cents"))
    charges = side(df.where(F.col("bank").isin(rule["target_banks"]) & (F.col("type") == "expense")))
    pay = side(df.where((F.col("bank") == rule["source_bank"]) & (F.col("type") == "transfer")))
    if keys:
        found = settled_payments(pay, charges, keys, reach, share, floor)
        return _links(found.select("tx_id", F.col("first_id").alias("match_id"), F.col("charges").alias("matches")), rule, other=False)
    daily = charges.groupBy("day").agg(F.sum("cents").alias("day_cents"), F.min("tx_id").alias("first_id"), F.count(F.lit(1)).alias("rows"))
    # Each payment day looks back over at most ``reach`` days of daily totals.
    spread = daily.select(F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("back"), "*")
    due = (
        spread.groupBy((F.col("day") + F.col("back")).alias("day"))
        .agg(F.sum("day_cents").alias("cents"), F.min("first_id").alias("match_id"), F.sum("rows").alias("matches"))
    )
    counted = pay.groupBy("day", "cents").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_groups(counted, ["day", "cents"], rows="n", share=share, floor=floor)
    return _links(spread_join(pay, due, ["day", "cents"], ["tx_id"], hot, how="inner"), rule, other=False)


def rule_links(df: DataFrame, rule: Mapping, share: float = HOT_SHARE, floor: int = HOT_FLOOR, per: Per = ROWS) -> DataFrame:
    """Matches of one rule: every affected row, its earliest match and the number of matches.

    ``df`` holds tx_id, date, amount (a magnitude), sign (1 or -1), merchant, bank, source,
    status, description and type. Matching rows link to the smallest matching id other than
    their own; the earliest row of a symmetric group is therefore the one that is kept.
    ``per``: links of points instead of rows, for all strategies but sums of charges.
    """
    strategy, fields = rule["strategy"], list(rule["fields"])
    if strategy in ("exact-match", "hash-match"):
        return _exact(df, rule, share, floor, per)
    tolerance = rule.get("tolerance")
    every = [(F.lit(True), F.lit(True))]
    if strategy == "fuzzy-match" and tolerance["type"] == "absolute":
        reach = int(round(tolerance["amount"] * 100))
        return _windowed(df, rule, fields, {}, every, (-reach, reach), "cents", share, floor, per)
    if strategy == "fuzzy-match":
        return _similar_names(df, rule, tolerance["amount"], share, floor, per)
    reach = _day_limit(rule)
    rest = [f for f in fields if f != "date"]
    if strategy == "sum-of-charges":
        return _sum_of_charges(df, rule, share, floor)
    if rule.get("transition"):
        before, after = rule["transition"]
        # A posted row belongs to a pending row of the same or an earlier day.
        step = [(F.col("status") == after, F.col("status") == before)]
        return _windowed(df, rule, rest, {"status": F.col("status")}, step, (-reach, 0), "day", share, floor, per)
    if rule.get("opposite_sign"):
        extra = {"sign": F.col("sign")}
        keys = rest if "amount" in rest else [*rest, "amount"]
        plus, minus = F.col("sign") > 0, F.col("sign") < 0
        if strategy == "refund":
            return _windowed(df, rule, keys, extra, [(plus, minus)], (-reach, 0), "day", share, floor, per)
        return _windowed(df, rule, keys, extra, [(plus, minus), (minus, plus)], (-reach, reach), "day", share, floor, per)
    if rule.get("different_sources"):
        return _cross_source(df, rule, share, floor, per)
    if rule.get("source_bank"):
        payout = [(F.col("bank").isin(rule["target_banks"]), F.col("bank") == rule["source_bank"])]
        return _windowed(df, rule, rest, {"bank": F.col("bank")}, payout, (-reach, reach), "day", share, floor, per)
    return _windowed(df, rule, rest, {}, every, (-reach, reach), "day", share, floor, per)


def _told_by(rules: Sequence[Mapping]) -> list[str]:
    """Columns that rules look at."""
    found = {"date", "amount"}
    for rule in rules:
        found |= set(rule["fields"])
        if rule["strategy"] == "fuzzy-match" and rule["tolerance"]["type"] != "absolute":
            found.add("merchant")
        for given, column in (("transition", "status"), ("opposite_sign", "sign"), ("different_sources", "source"), ("source_bank", "bank")):
            if rule.get(given):
                found.add(column)
    return sorted(found)


def _links_of_points(df: DataFrame, rules: Sequence[Mapping], places: Sequence[int], share: float, floor: int) -> DataFrame:
    """As the union of ``rule_links``, with one row for each row and match: ``best`` (place of the rule, matches) and ``rules_hit``.

    Rules can't tell rows apart that agree in all that they look at, so links are found between points, and a row gets all links of its point at once.
    What a row's own id rules out is left out when the row is met.
    """
    told = _told_by(rules)
    key = F.struct(*[F.col(c) for c in told])
    points = df.groupBy(*told).agg(F.count(F.lit(1)).alias("rows"), F.count("tx_id").alias("known"), F.min("tx_id").alias("first_id"))
    points = materialise(points.withColumn("point", F.monotonically_increasing_id()), "points")
    links = None
    for rule, place in zip(rules, places):
        one = rule_links(points, rule, share, floor, POINTS).select("point", "match_id", F.struct(F.lit(place).alias("place"), "matches").alias("best"), "other")
        links = one if links is None else links.unionByName(one)
    loose = ~F.col("other")
    merged = links.repartition("point").groupBy("point", "match_id").agg(
        F.max("best").alias("best"), F.count(F.lit(1)).alias("hits"), F.max(F.when(loose, F.col("best"))).alias("own_best"), F.count_if(loose).alias("own_hits")
    )
    listed = merged.groupBy("point").agg(F.collect_list(F.struct("match_id", "best", "hits", "own_best", "own_hits")).alias("links"))
    held = materialise(points.select("point", key.alias("_key"), "rows").join(listed, "point").drop("point"), "links")
    # A key is one point, so only points of many rows can be hot.
    hot = hot_groups(held.where(F.col("rows") > floor), ["_key"], rows="rows", share=share, floor=floor)
    rows = df.select("tx_id", key.alias("_key"))
    met = spread_join(rows, held.drop("rows"), ["_key"], ["tx_id"], hot, how="inner").select("tx_id", F.inline("links"))
    different = F.coalesce(F.col("tx_id") != F.col("match_id"), F.lit(False))
    pick = lambda c: F.when(different, F.col(c)).otherwise(F.col(f"own_{c}"))
    return met.select("tx_id", "match_id", pick("best").alias("best"), pick("hits").alias("rules_hit")).where(F.col("rules_hit") > 0)


def duplicate_links(
    df: DataFrame,
    rules: Sequence[Mapping] | None = None,
    share: float = HOT_SHARE,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """All enabled rules; where rules name the same two rows the highest priority is kept.

    Links of a row are merged where the row is; only ids that several rows have, and sums of charges, are merged over rows.
    """
    rules = [r for r in (load_duplicate_rules() if rules is None else rules) if r.get("enabled", True)]
    rank = lambda r: (r["priority"], r["id"], r["confidence"] is not None, r["confidence"] or 0.0)
    order = sorted({rank(r) for r in rules})
    place = {id(r): order.index(rank(r)) for r in rules}
    sums = [r for r in rules if r["strategy"] == "sum-of-charges"]
    rest = [r for r in rules if r["strategy"] != "sum-of-charges"]
    merge = lambda links: links.groupBy("tx_id", "match_id").agg(F.max("best").alias("best"), F.sum("rules_hit").alias("rules_hit"))
    best = _links_of_points(df, rest, [place[id(r)] for r in rest], share, floor) if rest else None
    for rule in sums:
        one = rule_links(df, rule, share, floor)
        one = one.select("tx_id", "match_id", F.struct(F.lit(place[id(rule)]).alias("place"), "matches").alias("best"), F.lit(1).cast("bigint").alias("rules_hit"))
        best = one if best is None else best.unionByName(one)
    if sums:
        best = merge(best)
    else:
        again = materialise(df.groupBy(F.xxhash64("tx_id").alias("_tx")).count().where("count > 1").select("_tx"), "again")
        number = again.limit(SENT + 1).count()
        if number > SENT:
            best = merge(best)
        elif number:
            marked = best.withColumn("_tx", F.xxhash64("tx_id"))
            several = marked.join(F.broadcast(again), "_tx", "left_semi").drop("_tx")
            best = marked.join(F.broadcast(again), "_tx", "left_anti").drop("_tx").unionByName(merge(several))
    names = F.array(*[F.struct(F.lit(i).alias("rule_id"), F.lit(p).alias("priority"), F.lit(c if known else None).cast("double").alias("confidence")) for p, i, known, c in order])
    won = F.get(names, F.col("best.place"))
    return best.select(
        "tx_id",
        "match_id",
        won["rule_id"].alias("rule_id"),
        won["priority"].alias("priority"),
        won["confidence"].alias("confidence"),
        F.col("best.matches").alias("matches"),
        "rules_hit",
    )
