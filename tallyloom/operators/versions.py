"""Versioned rule sets in one append-only table.

``versions``: rule_type, ts, author, reason, notes, and the rule columns, one row per rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.skew import HOT_FLOOR, HOT_SHARE, Running, running

META = ["rule_type", "ts", "author", "reason", "notes"]


def snapshot(rules: DataFrame, rule_type: str, ts: Column, author: str, reason: str, notes: str = "") -> DataFrame:
    """A rule set as version rows, to be appended to the versions table."""
    return rules.select(
        F.lit(rule_type).alias("rule_type"),
        ts.alias("ts"),
        F.lit(author).alias("author"),
        F.lit(reason).alias("reason"),
        F.lit(notes).alias("notes"),
        *rules.columns,
    )


def save_version(rules: DataFrame, path: str, rule_type: str, ts: Column, author: str, reason: str) -> None:
    snapshot(rules, rule_type, ts, author, reason).write.mode("append").parquet(path)


def _moment(t: str | Column) -> Column:
    return F.lit(t).cast("timestamp") if isinstance(t, str) else t


def version_at(versions: DataFrame, t: str | Column | None = None) -> DataFrame:
    """Rules of the latest version of each type, at ``t`` or now."""
    rows = versions if t is None else versions.where(F.col("ts") <= _moment(t))
    heads = rows.groupBy("rule_type").agg(F.max("ts").alias("ts"))
    return rows.join(heads, ["rule_type", "ts"], "left_semi")


def load_version(versions: DataFrame, rule_type: str, ts: str | None = None) -> DataFrame:
    rows = versions.where(F.col("rule_type") == rule_type)
    return version_at(rows) if ts is None else rows.where(F.col("ts") == _moment(ts))


def list_versions(versions: DataFrame) -> DataFrame:
    return versions.groupBy("rule_type", "ts").agg(
        F.min("author").alias("author"), F.min("reason").alias("reason"), F.count(F.lit(1)).alias("rules")
    )


def compare_versions(old: DataFrame, new: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """Each rule as added, removed, modified or unchanged."""
    a = old.select(key, F.struct(*columns).alias("before"))
    b = new.select(key, F.struct(*columns).alias("after"))
    change = (
        F.when(F.col("before").isNull(), "added")
        .when(F.col("after").isNull(), "removed")
        .when(F.col("before").eqNullSafe(F.col("after")), "unchanged")
        .otherwise("modified")
    )
    return a.join(b, key, "full_outer").select(key, change.alias("change"), "before", "after")


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count(F.lit(1)).alias("rules"))


def rollback(versions: DataFrame, rule_type: str, to: str, ts: Column, author: str, reason: str) -> DataFrame:
    """Rows that make an old version the newest one."""
    rules = load_version(versions, rule_type, to).drop(*META)
    return snapshot(rules, rule_type, ts, author, reason, f"rollback to {to}")


def version_stats(versions: DataFrame) -> DataFrame:
    """Per type: versions, first and last, authors and the rule counts in order of time."""
    listed = list_versions(versions)
    trend = F.array_sort(F.collect_list(F.struct("ts", "rules")))
    return listed.groupBy("rule_type").agg(
        F.count(F.lit(1)).alias("versions"),
        F.min("ts").alias("first_version"),
        F.max("ts").alias("last_version"),
        F.array_sort(F.collect_set("author")).alias("authors"),
        F.transform(trend, lambda x: x["rules"]).alias("rule_counts"),
    )


def add_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    return rules.unionByName(new)


def remove_rules(rules: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rules.join(ids.select(key).distinct(), key, "left_anti")


def update_rules(rules: DataFrame, changes: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    extra = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rules.join(extra, key, "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def join_as_of(
    rows: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    ts: str,
    values: Sequence[str],
    id_column: str,
    share: float = HOT_SHARE,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """Each row with the latest ``history`` values of its key at or before its time.

    Both sides are laid on one time line and the last known value is carried forward, block by
    block for hot keys, so there is no range join. ``history`` has one row per key and time.
    """
    left = rows.withColumns(
        {"_side": F.lit(1), "_hist": F.lit(None).cast(history.select(F.struct(*values).alias("v")).schema[0].dataType)}
    )
    right = history.select(*keys, ts, F.lit(0).alias("_side"), F.struct(*values).alias("_hist"))
    line = left.unionByName(right, allowMissingColumns=True)
    walked = running(
        line, keys, [ts, "_side", id_column], [Running("_seen", "last", F.col("_hist"))], share=share, floor=floor
    )
    return walked.where(F.col("_side") == 1).select(*rows.columns, *[F.col(f"_seen.{v}").alias(v) for v in values])
