"""Pairs of names within a few edits, by shared segments.

A name is cut into ``limit + 1`` segments. Of a pair within ``limit`` edits, some segment i of the shorter name stands in the longer one unchanged, with at most i - 1 edits before it
and at most limit + 1 - i after it. That bounds where the segment can stand, so a name is looked up by about ``limit ** 2 / 2 + limit + 1`` substrings for each length of a partner,
and the two sides of the segment need only be compared within those edits.

A segment that very many names share is no key to meet at. Names that share one are cut again: the longer side of the segment is one more pair of texts within fewer edits,
so it has a segment in common as well, and both must agree. What is still crowded is dealt to several tasks.

Where few names agree in the other columns, all of this costs more than it saves, and they are compared as they are.

Each pair is found by its first segment and place that pass, and so comes once without being sorted out later.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.runtime import materialise

#: Names that may share a segment before they are cut again, and names of a crowded key that are looked up in one task.
CROWD, PER_TASK = 1_000, 20_000
#: Crowded keys (16 bytes each) that are broadcast; more are joined.
SENT = 100_000
NOTHING = "array<struct<seg:int,at:int,width:int,place:int>>"


def _cut(size: Column, parts: int, i: int) -> Column:
    """Characters before segment ``i`` (from 0) of a text of ``size`` characters in ``parts`` segments."""
    return F.floor(size * i / parts).cast("int")


def segments(size: Column, edits: int) -> Column:
    """The segments of a text: number from 1, first character and width."""
    parts = edits + 1
    return F.array(*[
        F.struct(F.lit(i + 1).alias("seg"), (_cut(size, parts, i) + 1).alias("at"), (_cut(size, parts, i + 1) - _cut(size, parts, i)).alias("width"))
        for i in range(parts)
    ])


def places(size: Column, other: Column, edits: int) -> Column:
    """Where each segment of a text of ``size`` characters may stand in one of ``other`` characters: the segments, with the ``place`` of the first character. In order."""
    found = []
    for i in range(edits + 1):
        at = _cut(size, edits + 1, i) + 1
        width = _cut(size, edits + 1, i + 1) - at + 1
        shift = other - size
        low = F.greatest(at - i, at + shift - (edits - i), F.lit(1))
        high = F.least(at + i, at + shift + (edits - i), other - width + 1)
        found.append(
            F.when(low <= high, F.transform(F.sequence(low, high), lambda p: F.struct(F.lit(i + 1).alias("seg"), at.alias("at"), width.alias("width"), p.alias("place"))))
            .otherwise(F.array().cast(NOTHING))
        )
    return F.concat(*found)


def _within(a: Column, b: Column, most: Column, edits: int) -> Column:
    gap = F.levenshtein(a, b, edits)
    return (gap >= 0) & (gap <= most)


def _fits(longer: Column, shorter: Column, c, edits: int) -> Column:
    """Both sides of the segment are within the edits that its number leaves them."""
    before = _within(F.substr(longer, F.lit(1), c["place"] - 1), F.substr(shorter, F.lit(1), c["at"] - 1), c["seg"] - 1, edits)
    after = _within(
        F.substr(longer, c["place"] + c["width"], F.length(longer) + 1), F.substr(shorter, c["at"] + c["width"], F.length(shorter) + 1),
        edits + 1 - c["seg"], edits,
    )
    return before & after


def _first(longer: Column, shorter: Column, spot: dict, edits: int) -> Column:
    """No segment and place before this one passes."""
    earlier = F.filter(
        places(F.length(shorter), F.length(longer), edits),
        lambda c: (c["seg"] < spot["seg"]) | ((c["seg"] == spot["seg"]) & (c["place"] < spot["place"])),
    )
    same = lambda c: F.substr(longer, c["place"], c["width"]) == F.substr(shorter, c["at"], c["width"])
    return ~F.exists(earlier, lambda c: same(c) & _fits(longer, shorter, c, edits))


def _side(name: Column, place: Column, width: Column, right: bool) -> Column:
    """What stands right or left of a segment."""
    return F.substr(name, place + width, F.length(name) + 1) if right else F.substr(name, F.lit(1), place - 1)


def _crowds(held: DataFrame, keys: Sequence[str], floor: int) -> DataFrame:
    """Hashes of the keys of more than ``floor`` rows, with the number of parts that brings each down to that."""
    counts = held.groupBy(F.xxhash64(*keys).alias("_hash")).agg(F.count(F.lit(1)).alias("_n"))
    return materialise(counts.where(F.col("_n") > floor).select("_hash", (1 + F.floor(F.col("_n") / floor)).cast("int").alias("_cuts")), "crowds")


def _marked(rows: DataFrame, keys: Sequence[str], crowds: DataFrame, n: int) -> DataFrame:
    """Adds ``_cuts``, null for a key that is not crowded."""
    if not n:
        return rows.withColumn("_cuts", F.lit(None).cast("int"))
    found = F.broadcast(crowds) if n <= SENT else crowds
    return rows.withColumn("_hash", F.xxhash64(*keys)).join(found, "_hash", "left").drop("_hash")


def _met(asked: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both that agree in ``keys``; those with ``_cuts`` are dealt to so many tasks. The first of a pair is the longer name or the greater."""
    parts = F.coalesce("_cuts", F.lit(1))
    left = asked.withColumn("_part", F.pmod(F.xxhash64("a"), parts).cast("int")).drop("_cuts")
    right = held.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_cuts")
    pairs = left.join(right, [*keys, "_part"]).drop("_part")
    return pairs.where((F.length("a.name") > F.length("b.name")) | (F.col("a.name") > F.col("b.name")))


def similar_pairs(points: DataFrame, by: Sequence[str], name: str, edits: int, carry: Sequence[str] = (), crowd: int = CROWD, per_task: int = PER_TASK) -> DataFrame:
    """Pairs of rows of ``points`` that agree in ``by`` and whose names are within ``edits`` edits, each once: ``by``, ``a`` and ``b`` as structs of the name and ``carry``.

    ``by`` and name must be unique, and no column of theirs null. The name of ``a`` is the longer, of names of one length the greater. Empty names are names.
    """
    if edits < 1:
        raise ValueError("edits must be 1 or more")
    by = list(by)
    # A group of no more names than may share a segment is a key to meet at by itself.
    sizes = points.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowd).select(*by)
    big = materialise(sizes, "big")
    if big.isEmpty():
        return _directly(points, by, name, edits, carry)
    found = _by_segments(points.join(big, by, "left_semi"), by, name, edits, carry, crowd, per_task)
    return _directly(points.join(big, by, "left_anti"), by, name, edits, carry).unionByName(found)


def _item(name: str, carry: Sequence[str]) -> Column:
    return F.struct(F.col(name).alias("name"), *[F.col(c) for c in carry])


def _directly(points: DataFrame, by: list[str], name: str, edits: int, carry: Sequence[str]) -> DataFrame:
    """Every two names of a group compared; of names that differ too much in length only the lengths are."""
    side = lambda out: points.select(*by, _item(name, carry).alias(out), F.length(name).cast("int").alias(f"_{out}"))
    longer, shorter = F.col("a.name"), F.col("b.name")
    ordered = (F.col("_a") > F.col("_b")) | ((F.col("_a") == F.col("_b")) & (longer > shorter))
    pairs = side("a").hint("merge").join(side("b"), by).where(ordered & (F.col("_a") - F.col("_b") <= edits))
    return pairs.where(F.levenshtein(longer, shorter, edits) >= 0).select(*by, "a", "b")


def _by_segments(points: DataFrame, by: list[str], name: str, edits: int, carry: Sequence[str], crowd: int, per_task: int) -> DataFrame:
    size = F.length("item.name")
    base = points.select(*by, _item(name, carry).alias("item"))
    held = base.select(*by, "item", size.alias("size"), F.inline(segments(size, edits)))
    held = held.select(*by, "size", "seg", F.substr("item.name", F.col("at"), F.col("width")).alias("text"), F.col("item").alias("b"), "at", "width")
    lengths = F.sequence(F.greatest(size - edits, F.lit(0)), size)
    asked = base.select(*by, "item", F.explode(lengths).alias("size")).select(*by, "item", "size", F.inline(places(F.col("size"), size, edits)))
    asked = asked.select(*by, "size", "seg", F.substr("item.name", F.col("place"), F.col("width")).alias("text"), F.col("item").alias("a"), "place")
    at = [*by, "size", "seg", "text"]

    def passed(pairs: DataFrame) -> DataFrame:
        longer, shorter, spot = F.col("a.name"), F.col("b.name"), {c: F.col(c) for c in ("seg", "at", "width", "place")}
        return pairs.where(_fits(longer, shorter, spot, edits)).where(_first(longer, shorter, spot, edits)).select(*by, "a", "b")

    crowds = _crowds(held, at, crowd)
    n = crowds.count()
    held, asked = _marked(held, at, crowds, n), _marked(asked, at, crowds, n)
    if not n:
        return passed(_met(asked, held, at))
    light = passed(_met(asked.where("_cuts IS NULL"), held.where("_cuts IS NULL"), at))
    return light.unionByName(passed(_cut_again(asked.where("_cuts IS NOT NULL"), held.where("_cuts IS NOT NULL"), by, at, edits, per_task)))


def _cut_again(asked: DataFrame, held: DataFrame, by: list[str], at: list[str], edits: int, per_task: int) -> DataFrame:
    """Pairs at crowded segments that agree in a segment of the side with more edits left as well, each once for a segment and place of the name."""
    out, kept = None, [*by, "a", "b", "seg", "at", "width", "place"]
    for seg in range(1, edits + 2):
        # Edits left on the right are edits + 1 - seg, on the left seg - 1; at least one of them has some.
        right = edits + 1 - seg >= seg - 1
        most = edits + 1 - seg if right else seg - 1
        mine = held.where(F.col("seg") == seg).drop("_cuts").withColumn("rest_b", _side(F.col("b.name"), F.col("at"), F.col("width"), right))
        mine = mine.select("*", F.inline(_renamed(segments(F.length("rest_b"), most), {"seg": "seg2", "at": "at2", "width": "width2"})))
        mine = mine.withColumn("text2", F.substr("rest_b", F.col("at2"), F.col("width2")))
        start = _cut(F.col("size"), edits + 1, seg - 1)
        width = _cut(F.col("size"), edits + 1, seg) - start
        rest_size = F.col("size") - start - width if right else start
        ours = asked.where(F.col("seg") == seg).drop("_cuts").withColumn("rest_a", _side(F.col("a.name"), F.col("place"), width, right))
        ours = ours.select("*", F.inline(_renamed(places(rest_size, F.length("rest_a"), most), {"seg": "seg2", "place": "place2", "width": "_width"})))
        ours = ours.withColumn("text2", F.substr("rest_a", F.col("place2"), F.col("_width"))).drop("_width")
        keys = [*at, "seg2", "text2"]
        crowds = _crowds(mine, keys, per_task)
        n = crowds.count()
        pairs = _met(_marked(ours, keys, crowds, n), _marked(mine, keys, crowds, n), keys)
        spot = {"seg": F.col("seg2"), "at": F.col("at2"), "width": F.col("width2"), "place": F.col("place2")}
        a, b = F.col("rest_a"), F.col("rest_b")
        more = pairs.where(_fits(a, b, spot, most)).where(_first(a, b, spot, most)).select(kept)
        out = more if out is None else out.unionByName(more)
    return out


def _renamed(structs: Column, names: dict[str, str]) -> Column:
    return F.transform(structs, lambda c: F.struct(*[c[old].alias(new) for old, new in names.items()]))
