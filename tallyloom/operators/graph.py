"""Equivalence chains and relations between entities.

Each entity points to at most one other (its latest ``same_as`` target). Chains are followed by
pointer doubling: the number of rounds grows with the logarithm of the longest chain. Every
round is written to the shared folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.skew import HOT_FLOOR, HOT_SHARE, hot_groups, spread_join
from tallyloom.runtime import materialise


def latest_targets(edges: DataFrame, order: str | None = "ts") -> DataFrame:
    """One out-edge per entity, the latest by column ``order``, ties to the smallest target; self references are loops and stay.

    Edges without such a column are of one time.
    """
    if order is None or order not in edges.columns:
        return edges.groupBy("src").agg(F.min("dst").alias("dst"))
    newest = edges.groupBy("src", "dst").agg(F.max(order).alias("_at"))
    best = newest.groupBy("src").agg(F.max("_at").alias("_at"))
    return newest.join(best, "src").where(newest["_at"].eqNullSafe(best["_at"])).groupBy("src").agg(F.min("dst").alias("dst"))


def latest_links(edges: DataFrame) -> DataFrame:
    """``latest_targets`` with the time of each link, as ``update_canonical`` takes them."""
    newest = edges.groupBy("src").agg(F.max("ts").alias("ts"))
    return latest_targets(edges).join(newest, "src")


def chain_paths(edges: DataFrame, ids: DataFrame, order: str | None = "ts") -> DataFrame:
    """The places that the chains of ``ids`` (column ``id``) pass, a row each: id, hop, at.

    A chain ends at an entity without a target, or where it would meet an entity again. How far each walks is known from its canonical entity; the place after ``hop`` steps
    is then put together from jumps of 1, 2, 4, ... steps, so there are about log2(longest chain) rounds.
    """
    links = materialise(latest_targets(edges, order), "links")
    ends = canonicalise(links, order=None).select("id", F.when(F.col("loop"), F.col("hops") - 1).otherwise(F.col("hops")).alias("last"))
    walked = ids.select("id").distinct().join(ends, "id", "left").withColumn("last", F.coalesce("last", F.lit(0).cast("bigint")))
    rows = materialise(walked.select("id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("hop"), F.col("id").alias("at")), "path")
    longest = rows.agg(F.coalesce(F.max("hop"), F.lit(0)).alias("n")).first()["n"]
    jump = links.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    for k in range(int(longest).bit_length()):
        takes = F.shiftright("hop", k).bitwiseAND(1) == 1
        moving = rows.where(takes)
        hot = hot_groups(moving, ["at"])
        moved = spread_join(moving, jump, ["at"], ["id", "hop"], hot, "inner").select("id", "hop", F.col("next").alias("at"))
        rows = materialise(rows.where(~takes).unionByName(moved), "path")
        far = jump.select(F.col("at").alias("next"), F.col("next").alias("far"))
        hot = hot_groups(jump, ["next"])
        jump = materialise(spread_join(jump, far, ["next"], ["at"], hot, "inner").select("at", F.col("far").alias("next")), "jump")
    return rows


def _double(active: DataFrame, every: DataFrame, share: float, floor: int) -> DataFrame:
    """One doubling: (id, at, hops) to (id, at of at, hops + hops of at).

    Only moving rows are joined; the other side has one row per entity, and a popular target
    is salted.
    """
    step = every.select(
        F.col("id").alias("at"), F.col("at").alias("next"), F.col("hops").alias("more"), F.col("moving").alias("on")
    )
    hot = hot_groups(active, ["at"], share=share, floor=floor)
    moved = spread_join(active, step, ["at"], ["id"], hot)
    return moved.select(
        "id",
        F.coalesce("next", "at").alias("at"),
        (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
        F.coalesce("on", F.lit(False)).alias("moving"),
    )


def _follow(start: DataFrame, rounds: int, share: float, floor: int, label: str) -> DataFrame:
    """Walk until nothing moves, or all that moves stands on its loop; at most ``rounds`` rounds. Finished rows are not written again.

    On a chain with an end some entity finishes in each round, as all distances to the end occur. So what moves after a round in which none finished never will. The
    places that those walkers reach only become fewer as long as one is still on its way to a loop.
    """
    state = materialise(start, label)
    finished, active = state.where(~F.col("moving")), state.where("moving")
    places = None
    for _ in range(rounds):
        if not active.limit(1).count():
            break
        state = materialise(_double(active, finished.unionByName(active), share, floor), label)
        done = state.where(~F.col("moving"))
        active = state.where("moving")
        if done.limit(1).count():
            finished = finished.unionByName(done)
            continue
        before, places = places, active.select("at").distinct().count()
        if before == places:
            break
    return finished.unionByName(active)


def canonicalise(
    edges: DataFrame, entities: DataFrame | None = None, share: float = HOT_SHARE, floor: int = HOT_FLOOR, order: str | None = "ts"
) -> DataFrame:
    """Canonical entity of each entity: (id, canonical_id, hops, loop).

    On a chain that runs into a loop, the walk ends where it first meets an entity again: the
    entry of the loop, after the hops to it and once around.
    """
    links = materialise(latest_targets(edges, order), "links")
    nodes = links.count()
    rounds = max(1, nodes.bit_length() + 1)
    ends = links.select(F.col("dst").alias("at")).distinct().join(
        links.select(F.col("src").alias("at")), "at", "left_anti"
    )
    terminal = ends.withColumn("_end", F.lit(True))
    hot = hot_groups(links, ["dst"], share=share, floor=floor)
    start = spread_join(links.withColumnRenamed("dst", "at"), terminal, ["at"], ["src"], hot).select(
        F.col("src").alias("id"), "at", F.lit(1).cast("bigint").alias("hops"), F.col("_end").isNull().alias("moving")
    )
    state = _follow(start, rounds, share, floor, "chains")
    chains = state.where(~F.col("moving")).select(
        "id", F.col("at").alias("canonical_id"), "hops", F.lit(False).alias("loop")
    )
    looping = state.where("moving")
    out = chains
    if looping.limit(1).count():
        out = chains.unionByName(_loops(links, looping, rounds, share, floor))
    if entities is not None:
        rest = entities.select(F.col("entity_id").alias("id")).join(out.select("id"), "id", "left_anti")
        out = out.unionByName(
            rest.select("id", F.col("id").alias("canonical_id"), F.lit(0).cast("bigint").alias("hops"), F.lit(False).alias("loop"))
        )
    return out


def _loops(links: DataFrame, looping: DataFrame, rounds: int, share: float, floor: int) -> DataFrame:
    """Entries and walk lengths for entities that never reach an end.

    After as many steps as there are entities every walker stands on its loop, and each loop
    entity is stood on by some walker; so the places reached are just the loop entities.
    """
    members = links.join(looping.select(F.col("id").alias("src")), "src", "left_semi")
    ring = materialise(looping.select("at").distinct(), "ring").withColumnRenamed("at", "id")
    ring_links = members.join(ring.withColumnRenamed("id", "src"), "src", "left_semi")

    # Smallest entity of each loop, by doubling the stretch a minimum covers.
    label = materialise(
        ring_links.select(F.col("src").alias("id"), F.col("dst").alias("at"), F.least("src", "dst").alias("low")), "ring"
    )
    for _ in range(rounds):
        nxt = label.select(F.col("id").alias("at"), F.col("at").alias("far"), F.col("low").alias("low2"))
        label = materialise(
            label.join(nxt, "at").select("id", F.col("far").alias("at"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("fell")), "ring"
        )
        # Where no stretch has a smaller entity in the next one, each holds the smallest of its loop.
        if not label.where("fell").limit(1).count():
            break
    sizes = label.groupBy("low").agg(F.count(F.lit(1)).alias("around"))
    hot = hot_groups(sizes, ["low"], rows="around", share=share, floor=floor)
    sized = spread_join(label.select("id", "low"), sizes, ["low"], ["id"], hot).select("id", "around")
    sized = materialise(sized, "ring")

    on_ring = ring.select(F.col("id").alias("at"), F.lit(True).alias("_ring"))
    tails = members.join(ring.withColumnRenamed("id", "src"), "src", "left_anti")
    crowd = hot_groups(tails, ["dst"], share=share, floor=floor)
    start = spread_join(tails.withColumnRenamed("dst", "at"), on_ring, ["at"], ["src"], crowd).select(
        F.col("src").alias("id"), "at", F.lit(1).cast("bigint").alias("hops"), F.col("_ring").isNull().alias("moving")
    )
    entered = _follow(start, rounds, share, floor, "tails").select("id", "at", "hops")
    own = ring.select("id", F.col("id").alias("at"), F.lit(0).cast("bigint").alias("hops"))
    every = entered.unionByName(own)
    spots = hot_groups(every, ["at"], share=share, floor=floor)
    placed = spread_join(every, sized.withColumnRenamed("id", "at"), ["at"], ["id"], spots)
    return placed.select(
        "id", F.col("at").alias("canonical_id"), (F.col("hops") + F.col("around")).alias("hops"), F.lit(True).alias("loop")
    )


def chain_stats(chains: DataFrame) -> DataFrame:
    """Over entities that have a same-as link; loops are counted but not measured."""
    linked = chains.where(F.col("hops") > 0)
    return linked.agg(
        F.count(F.lit(1)).alias("total_chains"),
        F.count_if(~F.col("loop")).alias("valid_chains"),
        F.count_if("loop").alias("loops_detected"),
        F.coalesce(F.max(F.when(~F.col("loop"), F.col("hops"))), F.lit(0)).alias("max_hops"),
        F.coalesce(F.avg(F.when(~F.col("loop"), F.col("hops"))), F.lit(0.0)).alias("avg_hops"),
    )


def add_equivalences(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edge list with new edges appended once; a time that orders edges goes along."""
    return edges.unionByName(new.select(*edges.columns)).distinct()


def update_canonical(
    canonical: DataFrame, links: DataFrame, new: DataFrame, share: float = HOT_SHARE, floor: int = HOT_FLOOR
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The canonical table and the links after new edges: (canonical, links, changed rows of the canonical table).

    ``links``: src, dst and ts, the latest target of each entity; ``canonical``: what ``canonicalise`` made of them; ``new``: edges with the same columns. Only chains that lead through an entity
    with a new target are walked again: those are among the entities that end where that one did. Their walks stop at entities whose result stands, which then
    gives the rest. Both tables are read, but what is joined and written anew follows the touched chains; once one of them is a loop, all loops are walked again.
    """
    both = new.select("src", "dst", "ts").unionByName(links.select("src", "dst", "ts"))
    offered = both.join(new.select("src").distinct(), "src", "left_semi")
    newest = offered.groupBy("src").agg(F.max("ts").alias("ts"))
    latest = offered.join(newest.withColumnRenamed("ts", "_ts"), "src").where(F.col("ts").eqNullSafe(F.col("_ts"))).groupBy("src").agg(F.min("dst").alias("dst"), F.max("ts").alias("ts"))
    latest = materialise(latest, "latest")
    same = links.select("src", "dst", F.lit(True).alias("_same"))
    moved = materialise(latest.join(same, ["src", "dst"], "left").where("_same IS NULL").select("src"), "moved")
    # Where the moved entities ended so far; one without a link was an end itself.
    was = canonical.select(F.col("id").alias("src"), "canonical_id", "loop")
    ends = materialise(moved.join(was, "src", "left").select(F.coalesce("canonical_id", "src").alias("canonical_id"), F.coalesce("loop", F.lit(False)).alias("loop")).distinct(), "ends")
    any_loop = ends.where("loop").limit(1).count() > 0
    touched = canonical.where(~F.col("loop")).join(ends.where(~F.col("loop")).select("canonical_id").distinct(), "canonical_id", "left_semi").select("id")
    if any_loop:
        touched = touched.unionByName(canonical.where("loop").select("id"))
    touched = materialise(touched.unionByName(moved.withColumnRenamed("src", "id")).distinct(), "touched")
    # A link that stays may have a newer time.
    links_after = links.select("src", "dst", "ts").join(latest.select("src"), "src", "left_anti").unionByName(latest.select("src", "dst", "ts"))
    again = materialise(links_after.join(touched.withColumnRenamed("id", "src"), "src", "left_semi"), "again")
    walked = canonicalise(again, share=share, floor=floor)
    # A walk that left the touched entities goes on as the entity that it met.
    standing = canonical.join(touched, "id", "left_anti")
    onward = standing.select(F.col("id").alias("canonical_id"), F.col("canonical_id").alias("_end"), F.col("hops").alias("_more"), F.col("loop").alias("_loop"))
    hot = hot_groups(walked, ["canonical_id"], share=share, floor=floor)
    changed = spread_join(walked, onward, ["canonical_id"], ["id"], hot).select(
        "id", F.coalesce("_end", "canonical_id").alias("canonical_id"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"), (F.col("loop") | F.coalesce("_loop", F.lit(False))).alias("loop")
    )
    changed = materialise(changed, "changed")
    return standing.select("id", "canonical_id", "hops", "loop").unionByName(changed), links_after, changed


def reverse_index(entities: DataFrame, key: str) -> DataFrame:
    """(key value, entity) rows. Kept flat: a popular value may own most entities."""
    return entities.where(F.col(key).isNotNull()).select(
        F.lit(key).alias("key"), F.col(key).cast("string").alias("value"), "entity_id"
    )


def related_entities(entities: DataFrame, key: str, value) -> DataFrame:
    return entities.where(F.col(key) == value)


def relationships(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Relations of every entity: category, type, same-as and its inverse."""
    rows = [
        entities.where(F.col(c).isNotNull()).select(
            "entity_id", F.lit(r).alias("relation"), F.col(c).cast("string").alias("target")
        )
        for c, r in (("category", "has-category"), ("entity_type", "has-type"))
    ]
    out = edges.select(F.col("src").alias("entity_id"), F.lit("same-as").alias("relation"), F.col("dst").alias("target"))
    inverse = edges.select(
        F.col("dst").alias("entity_id"), F.lit("same-as-inverse").alias("relation"), F.col("src").alias("target")
    )
    return rows[0].unionByName(rows[1]).unionByName(out).unionByName(inverse)


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that touch the given entities, one hop in each direction."""
    keys = ids.select("id").distinct()
    out = edges.join(keys.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", F.lit("out").alias("way"))
    back = edges.join(keys.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", F.lit("in").alias("way"))
    return out.unionByName(back)


def triples(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Subject, predicate, object rows for export."""
    subject = lambda c: F.concat(F.lit("merchant/"), F.col(c))
    category = entities.where(F.col("category").isNotNull()).select(
        subject("entity_id").alias("s"), F.lit("has-category").alias("p"), F.concat(F.lit("category/"), "category").alias("o")
    )
    code = entities.where(F.col("mcc").isNotNull()).select(
        subject("entity_id").alias("s"), F.lit("has-mcc").alias("p"), F.col("mcc").cast("string").alias("o")
    )
    same = edges.select(subject("src").alias("s"), F.lit("same-as").alias("p"), subject("dst").alias("o"))
    return category.unionByName(code).unionByName(same)


def relationship_stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    linked = edges.select(F.col("src").alias("entity_id"), F.lit(True).alias("_linked")).distinct()
    joined = entities.join(linked, "entity_id", "left")
    has = F.col("_linked").isNotNull()
    return joined.agg(
        F.count(F.lit(1)).alias("total_entities"),
        F.count_if(has).alias("with_equivalence"),
        F.count_if(~has & F.col("category").isNull()).alias("isolated"),
    )


def with_provenance(df: DataFrame, entity: str, version: str) -> DataFrame:
    """How an entity was found: text, match, confidence, canonical entity and hops."""
    return df.withColumn(
        f"{entity}_provenance",
        F.struct(
            F.col(f"{entity}_text").alias("searched_text"),
            F.col(f"{entity}_match").alias("match"),
            F.col(f"{entity}_confidence").alias("confidence"),
            F.col(f"{entity}_root").alias("canonical_id"),
            F.coalesce(f"{entity}_hops", F.lit(0)).alias("hops"),
            F.lit(version).alias("resolver_version"),
        ),
    )


def resolve_with_provenance(
    df: DataFrame, definition: dict, registry: DataFrame, edges: DataFrame, version: str = "1.0.0"
) -> DataFrame:
    """Resolve one entity type, follow its equivalences and record how."""
    from tallyloom.operators.registry import resolve_entity

    name = definition["id"]
    key = f"{name}_entity"
    found = resolve_entity(df, definition, registry)
    roots = canonicalise(edges).select(
        F.col("id").alias(key), F.col("canonical_id").alias(f"{name}_root"), F.col("hops").alias(f"{name}_hops")
    )
    hot = hot_groups(found.where(F.col(key).isNotNull()), [key])
    joined = spread_join(found, roots, [key], ["tx_id"], hot)
    joined = joined.withColumn(f"{name}_root", F.coalesce(f"{name}_root", key))
    return with_provenance(joined, name, version)
