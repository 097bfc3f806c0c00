"""Human decisions that meet the review queue while both are streams.

Items and decisions of one transaction share a keyed state: the item, and the latest decision. Whichever comes first waits for the other. A decision that no item follows and an item that
nobody decides on are reported once the watermark has passed ``wait`` after them, and their state is dropped, so state is bounded by what arrives within that time.
Each change of a transaction is one row; the last row by ``seq`` is its state.

A call to Python costs far more than the few rows of one transaction, so the state's key is a bucket of transactions. Each of them is still settled by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# What a decision may be.
KINDS = ("approved", "rejected", "corrected")
PENDING, OVERDUE, ORPHANED = "pending-review", "overdue", "orphaned"

OUT = "tx_id string, seq long, status string, merchant string, category string, decided_by string, us long"
#: What is held of a transaction, and when its wait is over. A bucket of transactions holds one array of each.
FIELDS = {"seq": "long", "item_us": "long", "item_merchant": "string", "item_category": "string", "decision_us": "long", "decision_seq": "long", "kind": "string", "decided_by": "string", "merchant": "string",
          "category": "string", "until_ms": "long"}
STATE = ", ".join(["tx_id array<string>", *[f"{n} array<{t}>" for n, t in FIELDS.items()]])
_IN = ("tx_id", "us", "seq", "kind", "decided_by", "merchant", "category")
_COLUMNS = ["tx_id", "seq", "status", "merchant", "category", "decided_by", "ts"]


def _tagged(items: DataFrame, decisions: DataFrame, watermark: str) -> DataFrame:
    """Both streams in one shape. Rows without an id or time, and decisions of another kind, are left out."""
    none = F.lit(None).cast("string")
    queue = items.select(F.col("tx_id").cast("string").alias("tx_id"), "ts", F.lit(0).cast("bigint").alias("seq"), none.alias("kind"), none.alias("decided_by"),
                         F.col("detected_merchant").alias("merchant"), F.col("detected_category").alias("category"))
    made = decisions.where(F.col("kind").isin(*KINDS)).select(F.col("tx_id").cast("string").alias("tx_id"), "ts", F.col("seq").cast("bigint").alias("seq"), "kind", "decided_by", "merchant", "category")
    both = queue.unionByName(made).where("tx_id IS NOT NULL AND ts IS NOT NULL")
    # Times travel as numbers, so that no time zone comes between.
    return both.withColumn("us", F.unix_micros("ts")).withWatermark("ts", watermark)


def _settle(wait_us: int):
    def one(tx: str, held: dict, rows: list[tuple], now_ms: int, out: list[tuple]) -> None:
        """Rows of one transaction (us, seq, kind, ...) change what is held of it."""

        def say(status: str, us: int) -> None:
            corrected = status == "corrected"
            merchant = (held["merchant"] if corrected else None) or held["item_merchant"]
            category = (held["category"] if corrected else None) or held["item_category"]
            held["seq"] += 1
            out.append((tx, held["seq"], status, merchant, category, None if status in (PENDING, OVERDUE) else held["decided_by"], us))

        if not rows:
            if held["item_us"] is None:
                say(ORPHANED, held["decision_us"])
            elif held["kind"] is None:
                say(OVERDUE, held["item_us"])
            return
        # Items first: what they hold decides nothing, and the decisions of a batch then go by their time.
        arrived = False
        for us, seq, kind, by, merchant, category in sorted(rows, key=lambda r: (r[2] is not None, r[0], r[1])):
            if kind is None:
                if held["item_us"] is None:
                    held |= {"item_us": us, "item_merchant": merchant, "item_category": category}
                    arrived = True
            elif held["decision_us"] is None or (us, seq) > (held["decision_us"], held["decision_seq"]):
                held |= {"decision_us": us, "decision_seq": seq, "kind": kind, "decided_by": by, "merchant": merchant, "category": category}
                if held["item_us"] is not None and not arrived:
                    say(kind, us)
        if arrived:
            say(held["kind"] or PENDING, held["decision_us"] if held["kind"] else held["item_us"])
        last = max(u for u in (held["item_us"], held["decision_us"]) if u is not None)
        held["until_ms"] = max((last + wait_us) // 1000, now_ms + 1)

    def settle(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now_ms = state.getCurrentWatermarkMs()
        held = {tx: dict(zip(FIELDS, values)) for tx, *values in zip(*state.get)} if state.exists else {}
        got: dict[str, list[tuple]] = {}
        if not state.hasTimedOut:
            for frame in rows:
                for tx, *row in zip(*(frame[c].tolist() for c in _IN)):
                    got.setdefault(tx, []).append(tuple(row))
        out: list[tuple] = []
        for tx, some in got.items():
            one(tx, held.setdefault(tx, {**dict.fromkeys(FIELDS), "seq": 0}), some, now_ms, out)
        # As with a key each, a transaction whose wait is over goes only in a batch that brings nothing for it.
        for tx in [t for t, h in held.items() if h["until_ms"] < now_ms and t not in got]:
            one(tx, held.pop(tx), [], now_ms, out)
        if held:
            state.update((list(held), *[[h[n] for h in held.values()] for n in FIELDS]))
            state.setTimeoutTimestamp(max(min(h["until_ms"] for h in held.values()), now_ms))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[*_COLUMNS[:-1], "us"])

    return settle


def settle_stream(items: DataFrame, decisions: DataFrame, wait_hours: int = 24, watermark: str = "1 hour", buckets: int = 4096) -> DataFrame:
    """Status rows of reviewed transactions: ``tx_id``, ``seq``, ``status``, ``merchant``, ``category``, ``decided_by`` and ``ts``.

    ``items``: tx_id, ts, detected_merchant and detected_category; the first of a transaction counts. ``decisions``: tx_id, ts, seq, kind, decided_by, merchant and category; the latest by
    (ts, seq) counts, and one that comes after a later one changes nothing. Status is pending-review, approved, rejected, corrected, overdue (an item without a decision for ``wait_hours``) or
    orphaned (a decision without an item for as long). Rows older than the watermark of the batch before are dropped. ``buckets``: groups that transactions are
    dealt to by hash; a group of which anything changes is stored anew, and the number must stay the same for a checkpoint.
    """
    keyed = _tagged(items, decisions, watermark).withColumn("bucket", F.pmod(F.xxhash64("tx_id"), F.lit(buckets))).groupBy("bucket")
    rows = keyed.applyInPandasWithState(_settle(wait_hours * 3_600_000_000), OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return rows.select(*_COLUMNS[:-1], F.timestamp_micros("us").alias("ts"))


def latest_status(rows: DataFrame) -> DataFrame:
    """The state of each transaction: its last row."""
    last = rows.groupBy("tx_id").agg(F.max_by(F.struct(*_COLUMNS[2:]), "seq").alias("s"), F.count(F.lit(1)).alias("changes"))
    return last.select("tx_id", "s.*", "changes")
