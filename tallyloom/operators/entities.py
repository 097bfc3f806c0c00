"""Entities as append-only facts, and the store of merchants seen so far.

``facts``: entity_id, attribute, value STRING, ts, seq, op (assert or retract; a
retraction has no attribute and closes the entity).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.skew import HOT_FLOOR, HOT_SHARE, Running, hot_groups, running, spread_join

# Thresholds and wording of entity verification.
REVIEW_BELOW = 0.70
PROMOTE_AFTER = 5
REASONS = {
    "low": "Confidence below manual review threshold",
    "new": "First time seeing this merchant",
    "fallback": "Generated from fallback (no rule match)",
}


def register(df: DataFrame, entity_id: str, attributes: Sequence[str], ts: Column, seq: Column) -> DataFrame:
    """Assertion facts for the non-null attributes of each row; also used for updates."""
    cells = F.array(*[
        F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes
    ])
    flat = df.select(
        F.col(entity_id).cast("string").alias("entity_id"),
        ts.alias("ts"),
        seq.cast("bigint").alias("seq"),
        F.lit("assert").alias("op"),
        F.inline(cells),
    )
    return flat.where(F.col("value").isNotNull())


def retract(df: DataFrame, entity_id: str, ts: Column, seq: Column) -> DataFrame:
    return df.select(
        F.col(entity_id).cast("string").alias("entity_id"),
        ts.alias("ts"),
        seq.cast("bigint").alias("seq"),
        F.lit("retract").alias("op"),
        F.lit(None).cast("string").alias("attribute"),
        F.lit(None).cast("string").alias("value"),
    )


def _order() -> Column:
    return F.struct("ts", "seq")


def current_entities(facts: DataFrame, attributes: Sequence[str], at: str | None = None) -> DataFrame:
    """Wide entities now or at ``at``; retracted ones are gone. One partial aggregate."""
    rows = facts if at is None else facts.where(F.col("ts") <= F.lit(at).cast("timestamp"))
    latest = [
        F.max(
            F.when((F.col("op") == "assert") & (F.col("attribute") == a), F.struct(_order().alias("o"), "value"))
        ).alias(f"_{a}")
        for a in attributes
    ]
    folded = rows.groupBy("entity_id").agg(
        F.max(F.when(F.col("op") == "retract", _order())).alias("_gone"),
        F.max(F.when(F.col("op") == "assert", _order())).alias("_last"),
        *latest,
    )
    alive = lambda o: F.col("_gone").isNull() | (o > F.col("_gone"))
    return folded.where(F.col("_last").isNotNull() & alive(F.col("_last"))).select(
        "entity_id",
        *[F.when(alive(F.col(f"_{a}.o")), F.col(f"_{a}.value")).alias(a) for a in attributes],
    )


def entity_history(
    facts: DataFrame, attributes: Sequence[str], share: float = HOT_SHARE, floor: int = HOT_FLOOR
) -> DataFrame:
    """The full value of each entity after each of its changes."""
    stamp = F.struct("ts", "seq")
    specs = [Running("_gone", "last", F.when(F.col("op") == "retract", stamp))]
    for a in attributes:
        hit = (F.col("op") == "assert") & (F.col("attribute") == a)
        specs.append(Running(f"_{a}", "last", F.when(hit, F.struct(stamp.alias("o"), F.col("value").alias("v")))))
    walked = running(facts, ["entity_id"], ["ts", "seq"], specs, share=share, floor=floor)
    alive = lambda o: F.col("_gone").isNull() | (o > F.col("_gone"))
    return walked.select(
        "entity_id",
        "ts",
        "seq",
        "op",
        "attribute",
        *[F.when(alive(F.col(f"_{a}.o")), F.col(f"_{a}.v")).alias(a) for a in attributes],
    )


def count_entities(facts: DataFrame) -> DataFrame:
    return current_entities(facts, []).agg(F.count(F.lit(1)).alias("entities"))


def entity_sightings(
    df: DataFrame, share: float = HOT_SHARE, floor: int = HOT_FLOOR
) -> DataFrame:
    """Which sighting of its merchant each row is, and whether a human should look.

    ``df``: merchant_id, date, tx_id, confidence, fallback. The order (date, tx_id) is total. A row that needs no look but has
    a name from the fallback carries that as its reason.
    """
    rows = df.where(F.col("merchant_id").isNotNull())
    counted = running(
        rows,
        ["merchant_id"],
        ["date", "tx_id"],
        [Running("sighting", "count", F.lit(1)), Running("first_seen", "min", F.col("date"))],
        share=share,
        floor=floor,
    )
    low, new = F.col("confidence") < REVIEW_BELOW, F.col("sighting") == 1
    return counted.withColumns(
        {
            "resolution": F.when(new, "new-entity").otherwise("existing-entity"),
            "needs_verification": low | new,
            "verification_reason": F.when(low, REASONS["low"])
            .when(new, REASONS["new"])
            .when(F.col("fallback"), REASONS["fallback"]),
        }
    )


def entity_upsert(df: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Merchants seen in ``df`` folded into the existing table: counts, first and last day,
    confidence range and state. Name and fallback are those of the first row by (date, tx_id). Aliases are kept in their own table (``entity_aliases``), since a merchant may
    have any number of them."""
    batch = df.where(F.col("merchant_id").isNotNull()).groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("tx_count"),
        F.min("date").alias("first_seen"),
        F.max("date").alias("last_seen"),
        F.min(F.struct("date", "tx_id"))["tx_id"].alias("first_tx"),
        F.min_by("merchant_name", F.struct("date", "tx_id")).alias("merchant_name"),
        F.min_by("fallback", F.struct("date", "tx_id")).alias("fallback"),
        F.avg("confidence").alias("avg_confidence"),
        F.min("confidence").alias("min_confidence"),
    )
    parts = batch if existing is None else existing.select(*batch.columns).unionByName(batch)
    merged = parts.groupBy("merchant_id").agg(
        F.sum("tx_count").alias("tx_count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.min(F.struct("first_seen", "first_tx"))["first_tx"].alias("first_tx"),
        F.min_by("merchant_name", F.struct("first_seen", "first_tx")).alias("merchant_name"),
        F.min_by("fallback", F.struct("first_seen", "first_tx")).alias("fallback"),
        (F.sum(F.col("avg_confidence") * F.col("tx_count")) / F.sum("tx_count")).alias("avg_confidence"),
        F.min("min_confidence").alias("min_confidence"),
    )
    return merged.withColumn("state", entity_state(F.col("fallback"), F.col("tx_count")))


def entity_state(fallback: Column, count: Column) -> Column:
    """Rule-matched merchants are canonical; fallback ones become so after five transactions."""
    return F.when(~fallback | (count >= PROMOTE_AFTER), "canonical").otherwise("provisional")


def entity_aliases(df: DataFrame, alias: str) -> DataFrame:
    return df.where(F.col("merchant_id").isNotNull() & F.col(alias).isNotNull()).groupBy(
        "merchant_id", F.col(alias).alias("alias")
    ).agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_seen"))


def find_entity(
    df: DataFrame, entities: DataFrame, aliases: DataFrame, tax_ids: DataFrame, spread: Sequence[str] = ("tx_id",),
    share: float = HOT_SHARE, floor: int = HOT_FLOOR,
) -> DataFrame:
    """Existing entity of each row: by id, then by alias, then by tax id, with the way it matched.

    Few names and mostly missing tax ids are usual, so hot and null keys are spread by ``spread``.
    """
    ids = entities.select("merchant_id", F.col("merchant_id").alias("_by_id")).distinct()
    names = aliases.groupBy(F.col("alias").alias("merchant_name")).agg(F.min("merchant_id").alias("_by_alias"))
    taxes = tax_ids.groupBy("rfc").agg(F.min("merchant_id").alias("_by_rfc"))
    joined = df
    for key, table in (("merchant_id", ids), ("merchant_name", names), ("rfc", taxes)):
        hot = hot_groups(df.where(F.col(key).isNotNull()), [key], share=share, floor=floor)
        joined = spread_join(joined, table, [key], spread, hot)
    return joined.withColumns(
        {
            "entity_id": F.coalesce("_by_id", "_by_alias", "_by_rfc"),
            "match_method": F.when(F.col("_by_id").isNotNull(), "merchant-id")
            .when(F.col("_by_alias").isNotNull(), "alias")
            .when(F.col("_by_rfc").isNotNull(), "tax-id"),
        }
    ).drop("_by_id", "_by_alias", "_by_rfc")


def merge_aliases(aliases: DataFrame, merges: DataFrame) -> DataFrame:
    """Aliases under the entity that theirs is folded into; the name of a source is an alias of its target."""
    to = merges.select(F.col("source_id").alias("merchant_id"), "target_id")
    moved = aliases.join(to, "merchant_id", "left").withColumn("merchant_id", F.coalesce("target_id", "merchant_id"))
    own = merges.select(F.col("target_id").alias("merchant_id"), F.col("source_id").alias("alias"), F.lit(0).cast("bigint").alias("rows"), F.lit(None).cast("date").alias("first_seen"))
    every = moved.select("merchant_id", "alias", "rows", "first_seen").unionByName(own)
    return every.groupBy("merchant_id", "alias").agg(F.sum("rows").alias("rows"), F.min("first_seen").alias("first_seen"))


def merge_entities(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """Fold each source entity of ``merges`` (source_id, target_id) into its target: counts, days, confidences and state.

    The target's name stays; without a target row the largest source lends its name, ties by name.
    """
    to = merges.select(F.col("source_id").alias("merchant_id"), "target_id")
    moved = entities.join(to, "merchant_id", "left")
    own = F.col("target_id").isNull()
    relabelled = moved.withColumn("_own", own).withColumn("merchant_id", F.coalesce("target_id", "merchant_id"))
    return relabelled.groupBy("merchant_id").agg(
        F.sum("tx_count").alias("tx_count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max_by("merchant_name", F.struct("_own", "tx_count", "merchant_name")).alias("merchant_name"),
        F.max_by("fallback", F.struct("_own", "tx_count", "merchant_name")).alias("fallback"),
        (F.sum(F.col("avg_confidence") * F.col("tx_count")) / F.sum("tx_count")).alias("avg_confidence"),
        F.min("min_confidence").alias("min_confidence"),
        F.count_if(~F.col("_own")).alias("merged_from"),
    ).withColumn("state", entity_state(F.col("fallback"), F.col("tx_count")))


def sighting_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("resolution") == "new-entity").alias("new_entities"),
        F.count_if(F.col("resolution") == "existing-entity").alias("existing"),
        F.count_if("needs_verification").alias("needs_verification"),
        F.countDistinct("merchant_id").alias("unique_merchants"),
    )


def bump_version(entities: DataFrame, changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """New version rows for changed entities: changed columns overwritten, version plus one."""
    updates = changes.select("entity_id", *[F.col(c).alias(f"_{c}") for c in columns])
    joined = entities.join(updates, "entity_id")
    return joined.withColumns(
        {**{c: F.coalesce(f"_{c}", c) for c in columns}, "version": F.col("version") + 1}
    ).drop(*[f"_{c}" for c in columns])


def best_variation(variations: DataFrame, text: Column) -> DataFrame:
    """Matching variation with the highest confidence per entity."""
    hits = variations.where(F.upper(F.trim("variation")) == F.upper(F.trim(text)))
    return hits.groupBy("entity_id").agg(
        F.max_by(F.struct("variation", "source", "confidence"), F.struct("confidence", "variation")).alias("best")
    ).select("entity_id", "best.*")
