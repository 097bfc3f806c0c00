"""Queries given as data, and the read side of the ledger."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.skew import HOT_FLOOR, HOT_SHARE, hot_groups, spread_join
from tallyloom.functions.predicates import all_of, confidence_of, in_band


def order_columns(spec: Sequence[str | tuple[str, str]]) -> list[Column]:
    out = []
    for item in spec:
        name, direction = (item, "asc") if isinstance(item, str) else item
        out.append(F.col(name).desc_nulls_last() if direction == "desc" else F.col(name).asc_nulls_first())
    return out


def page(df: DataFrame, order: Sequence[str | tuple[str, str]], offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a total order."""
    out = df.orderBy(*order_columns(order))
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def query_ledger(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    """Rows by specification: type, id, as_of, versions, filters, order, offset, limit.

    ``versions`` is ``latest`` (default) or ``all``; ``as_of`` compares with ``ts``.
    """
    rows = df
    if spec.get("entity_type") is not None:
        rows = rows.where(F.col("entity_type") == spec["entity_type"])
    if spec.get("id") is not None:
        rows = rows.where(F.col("entity_id") == spec["id"])
    if spec.get("as_of") is not None:
        rows = rows.where(F.col("ts") <= F.lit(spec["as_of"]).cast("timestamp"))
    if spec.get("versions", "all") == "latest":
        whole = F.max_by(F.struct(*rows.columns), F.struct("ts", "version"))
        rows = rows.groupBy("entity_type", "entity_id").agg(whole.alias("e")).select("e.*")
    rows = rows.where(all_of(spec.get("filters", {})))
    if spec.get("order"):
        return page(rows, spec["order"], spec.get("offset", 0), spec.get("limit"))
    if spec.get("limit") is not None or spec.get("offset"):
        raise ValueError("paging needs an order")
    return rows


def in_half_open(df: DataFrame, start: str, end: str, column: str = "date") -> DataFrame:
    return df.where((F.col(column) >= F.lit(start).cast("date")) & (F.col(column) < F.lit(end).cast("date")))


def in_closed(df: DataFrame, start: str | None, end: str | None, column: str = "date") -> DataFrame:
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col(column) <= F.lit(end).cast("date"))


def by_confidence(df: DataFrame, level: str) -> DataFrame:
    return df.where(in_band(F.col("confidence"), level))


def above_confidence(df: DataFrame, threshold: float) -> DataFrame:
    return df.where(confidence_of(F.col("confidence")) >= threshold)


def unverified(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce("verified", F.lit(False)))


def with_names(
    df: DataFrame, banks: DataFrame, merchants: DataFrame, categories: DataFrame, spread: Sequence[str] = ("tx_id",),
    share: float = HOT_SHARE, floor: int = HOT_FLOOR,
) -> DataFrame:
    """Ids with readable names; the dimensions have one row per id. A ledger has few banks and categories, so hot ids are spread."""
    for key, dim in (("bank", banks), ("merchant", merchants), ("category", categories)):
        names = dim.select(F.col("entity_id").alias(key), F.col("canonical_name").alias(f"{key}_name"))
        hot = hot_groups(df.where(F.col(key).isNotNull()), [key], share=share, floor=floor)
        df = spread_join(df, names, [key], spread, hot)
    return df


def list_transactions(
    df: DataFrame,
    start: str | None = None,
    end: str | None = None,
    kind: str | None = None,
    order: Sequence[str | tuple[str, str]] = (("date", "desc"), "tx_id"),
    offset: int = 0,
    limit: int = 50,
) -> tuple[DataFrame, DataFrame]:
    """A page and the total it was taken from."""
    rows = in_closed(df, start, end)
    rows = rows if kind is None else rows.where(F.col("type") == kind)
    return page(rows, order, offset, limit), rows.agg(F.count(F.lit(1)).alias("total"))
