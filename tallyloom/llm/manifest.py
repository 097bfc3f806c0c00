"""Merkle manifest of a dataset, its trees stored in van Emde Boas order.

Each row is a leaf. The leaves of a group (a source), in order, are the lowest level of a tree of ``fanout`` children a node, and the roots of the groups
are the leaves of one more tree. A tree is cut into aligned subtrees of ``height`` levels. A task builds one such block: it hashes level by level and puts every node
at the address that halving the height again and again gives it, so that a path from a leaf to the block's root touches few pages whatever their size.
The roots of the blocks are the nodes of the next tier, which is built alike, until one block is left. Siblings are read by the same address
arithmetic: a block hears the path above its root once, from the block over it, and adds the part inside itself for each of its leaves.

No task sees more than ``fanout ** height`` nodes of a group, whatever the group holds; nothing but the number of tiers reaches the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.runtime import materialise

NODES = "grp string, block long, size int, total long, nodes binary, root binary"
ABOVE = "grp string, block long, path array<string>, subroot string, root string"


def tree_size(levels: int, fanout: int) -> int:
    return (fanout**levels - 1) // (fanout - 1)


def address(levels: int, depth: int, index: np.ndarray, fanout: int) -> np.ndarray:
    """Places of the nodes ``index`` of a level in a complete tree of ``levels`` levels: the top half is stored first, then each tree that hangs below it."""
    if levels == 1:
        return np.zeros(len(index), np.int64)
    top = levels // 2
    if depth < top:
        return address(top, depth, index, fanout)
    below = fanout ** (depth - top)
    return tree_size(top, fanout) + index // below * tree_size(levels - top, fanout) + address(levels - top, depth - top, index % below, fanout)


def climb(total: int, height: int, fanout: int) -> int:
    """Levels of hashing in a block of a tree level of ``total`` nodes: all, or what is needed until one node is left."""
    steps = 0
    while steps < height and fanout**steps < total:
        steps += 1
    return steps


def digest(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def build_block(leaves: bytes, total: int, height: int, fanout: int) -> np.ndarray:
    """Nodes of a block in van Emde Boas order, 32 bytes each; ``leaves``: its lowest level, ``total``: nodes of that level in the whole tree."""
    steps = climb(total, height, fanout)
    nodes = np.zeros((tree_size(steps + 1, fanout), 32), np.uint8)
    level, run = leaves, 64 * fanout
    for depth in range(steps, -1, -1):
        rows = np.frombuffer(level, np.uint8).reshape(-1, 32)
        nodes[address(steps + 1, depth, np.arange(len(rows)), fanout)] = rows
        if depth:
            text = level.hex()
            level = b"".join(digest(text[i : i + run]) for i in range(0, len(text), run))
    return nodes


def sibling_texts(nodes: np.ndarray, size: int, total: int, height: int, fanout: int) -> list[str]:
    """The digests of each level of a block, lowest first and without its root, as one text each."""
    steps = climb(total, height, fanout)
    out = []
    for depth in range(steps, 0, -1):
        out.append(nodes[address(steps + 1, depth, np.arange(size), fanout)].tobytes().hex())
        size = -(-size // fanout)
    return out


def path_of(levels: list[str], index: int, fanout: int) -> list[str]:
    """Digests left and right of a node and of each node over it, by turns."""
    out = []
    for text in levels:
        low = index - index % fanout
        out += [text[64 * low : 64 * index], text[64 * (index + 1) : 64 * (low + fanout)]]
        index //= fanout
    return out


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and the siblings on its way give."""
    for left, right in zip(path[::2], path[1::2]):
        leaf = digest(left + leaf + right).hex()
    return leaf


def field_text(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field_text(c) for c in columns]), 256)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``index``, the place of a row in its ``grp`` by ``order``, and ``total``, the rows of the group.

    Rows are dealt by range, so a group of any size lies in many parts; a window runs inside each part of a group, and the parts before are counted.
    ``order`` must end in a column that tells repeated rows apart.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    parts = materialise(rows.repartitionByRange(F.col("grp"), *keys).withColumn("part", F.spark_partition_id()), "ranges")
    inside = parts.groupBy("grp", "part").agg(F.count("*").alias("rows_in"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = inside.select("grp", "part", F.coalesce(F.sum("rows_in").over(before), F.lit(0)).alias("start"), F.sum("rows_in").over(Window.partitionBy("grp")).alias("total"))
    place = F.row_number().over(Window.partitionBy("grp", "part").orderBy(*keys))
    return materialise(parts.withColumn("place", place).join(starts, ["grp", "part"]).withColumn("index", F.col("start") + F.col("place") - 1).drop("part", "place", "start"), "ranked")


def _build(height: int, fanout: int):
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table.column("index")), kind="stable")
        body = b"".join(table.column("digest").take(pa.array(order)).to_pylist())
        total = table.column("total")[0].as_py()
        nodes = build_block(body, total, height, fanout)
        # The root of a block is its first node.
        return pa.table({"grp": table.column("grp")[:1], "block": table.column("block")[:1], "size": pa.array([len(order)], pa.int32()), "total": pa.array([total]), "nodes": pa.array([nodes.tobytes()]), "root": pa.array([nodes[0].tobytes()])})

    return run


def tiers(nodes: DataFrame, height: int, fanout: int) -> list[DataFrame]:
    """Blocks of each tier over ``nodes`` (grp, index, total, digest), the lowest first; the last has one block a group."""
    width = fanout**height
    out = []
    while True:
        dealt = nodes.select("grp", (F.col("index") / width).cast("long").alias("block"), "index", "total", "digest")
        blocks = materialise(dealt.groupBy("grp", "block").applyInArrow(_build(height, fanout), NODES), "blocks")
        out.append(blocks)
        more = blocks.where(F.col("total") > width)
        if more.isEmpty():
            return out
        nodes = more.select("grp", F.col("block").alias("index"), F.ceil(F.col("total") / width).alias("total"), F.col("root").alias("digest"))


def whole_roots(blocks: list[DataFrame], width: int) -> DataFrame:
    """The root of each group, from the tier where it is one block."""
    return reduce(DataFrame.union, [b.where(F.col("total") <= width).select("grp", "root") for b in blocks])


def _paths_of(height: int, fanout: int):
    """For each node of a block the path above it: what lies over the blocks of the tier below, or over a group."""

    def run(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {"grp": [], "block": [], "path": [], "subroot": [], "root": []}
        for row in table.to_pylist():
            levels = sibling_texts(np.frombuffer(row["nodes"], np.uint8).reshape(-1, 32), row["size"], row["total"], height, fanout)
            for i in range(row["size"]):
                out["grp"].append(row["grp"])
                out["block"].append(row["block"] * fanout**height + i)
                out["path"].append(path_of(levels, i, fanout) + row["path"])
                out["subroot"].append(row["subroot"])
                out["root"].append(row["top"])
        kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string()]
        return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    return lambda batches: (b for batch in batches for i in range(batch.num_rows) for b in run(pa.Table.from_batches([batch.slice(i, 1)])).to_batches())


def above(blocks: list[DataFrame], tops: DataFrame, height: int, fanout: int) -> DataFrame:
    """What lies over each block of the lowest tier. ``tops``: the same for whole groups (grp, path, subroot, root)."""
    width = fanout**height
    known = None
    for tier in reversed(blocks):
        here = tier.where(F.col("total") <= width).select("grp", "block").join(tops, "grp").select("grp", "block", "path", "subroot", "root")
        known = here if known is None else here.unionByName(known)
        if tier is blocks[0]:
            return known
        joined = tier.drop("root").join(known.withColumnRenamed("root", "top"), ["grp", "block"])
        known = materialise(joined.mapInArrow(_paths_of(height, fanout), ABOVE), "above")
    raise ValueError("no tier")


@dataclass(frozen=True)
class Manifest:
    """``leaves``: the given columns as struct ``row``, with grp, index, total and digest; ``blocks``: the tiers within groups; ``tops``: path, subroot and root of each group."""

    leaves: DataFrame
    blocks: list[DataFrame]
    group_blocks: list[DataFrame]
    tops: DataFrame
    height: int
    fanout: int


def build(leaves: DataFrame, group: str, order: str, leaf: str, height: int = 3, fanout: int = 16) -> Manifest:
    """Manifest of ``leaves``, one row each with its digest in hex in column ``leaf``.

    Groups are ordered by the bytes of ``group``, null first; a null group is a group and differs from the empty text. Within a group rows go
    by ``order``, null first; rows alike in it go by their digest, and repeated rows are leaves each. A block has at most ``fanout ** height`` leaves.
    All columns of ``leaves`` travel in one struct, so no name of theirs can clash.
    """
    if fanout < 2 or height < 1:
        raise ValueError("fanout must be 2 or more and height 1 or more")
    kept = F.struct(*[F.col(c) for c in leaves.columns])
    # "-" sorts before "=", so the null group is first.
    rows = leaves.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("grp"), F.col(order).alias("pos"), F.unhex(F.col(leaf)).alias("digest"), kept.alias("row"))
    rows = materialise(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    placed = ranked(rows, ["pos", "digest", "tie"]).drop("pos", "tie")
    blocks = tiers(placed, height, fanout)
    width = fanout**height
    subroots = whole_roots(blocks, width)
    # One tree over all groups, in their order.
    groups = ranked(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("digest")), ["name"])
    over = tiers(groups, height, fanout)
    top = over[-1].where(F.col("total") <= width).select("grp", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("root")).alias("root"))
    ways = above(over, top, height, fanout)
    each = over[0].drop("root").join(ways.withColumnRenamed("root", "top"), ["grp", "block"]).mapInArrow(_paths_of(height, fanout), ABOVE)
    tops = groups.select("name", "digest", "index").join(each.select(F.col("block").alias("index"), "path", "root"), "index")
    tops = materialise(tops.select(F.col("name").alias("grp"), "path", F.lower(F.hex("digest")).alias("subroot"), "root"), "tops")
    return Manifest(placed, blocks, over, tops, height, fanout)


def _audit(height: int, fanout: int, with_path: bool):
    def run(leaves: pa.Table, block: pa.Table) -> pa.Table:
        row = block.to_pylist()[0] if block.num_rows else None
        names = ["row", "subroot", "root", "proof_sha256", "folded_root"] + ["path"] * with_path
        out: list[list] = [[] for _ in names[1:]]
        if row is not None:
            levels = sibling_texts(np.frombuffer(row["nodes"], np.uint8).reshape(-1, 32), row["size"], row["total"], height, fanout)
            first = row["block"] * fanout**height
            over, over_text = row["path"], "".join(row["path"])
            for index, claim in zip(leaves.column("index").to_pylist(), leaves.column("claim").to_pylist()):
                inside = path_of(levels, index - first, fanout)
                values = [row["subroot"], row["top"], digest("".join(inside) + over_text).hex(), fold(fold(claim, inside), over)]
                for column, value in zip(out, [*values, inside + over]):
                    column.append(value)
        kinds = [pa.string()] * 4 + [pa.list_(pa.string())] * with_path
        return pa.table([leaves.column("row"), *[pa.array(v, k) for v, k in zip(out, kinds)]], names=names)

    return run


def audit(manifest: Manifest, claim: str, with_path: bool = False) -> DataFrame:
    """Each row of the manifest's leaves as ``row``, with ``subroot``, ``root``, ``proof_sha256`` (all siblings on the way to the root, hashed), ``folded_root`` (what the digest in
    column ``claim`` and the siblings give) and ``verified``; with ``with_path`` also the siblings, left and right by turns."""
    height, fanout = manifest.height, manifest.fanout
    kind = manifest.leaves.schema["row"].dataType
    if kind[claim].dataType.typeName() != "string":
        raise ValueError("the claimed digest must be a text")
    rows = manifest.leaves.select("grp", (F.col("index") / fanout**height).cast("long").alias("block"), "index", F.col("row")[claim].alias("claim"), "row")
    ways = above(manifest.blocks, manifest.tops, height, fanout)
    blocks = manifest.blocks[0].drop("root").join(ways.withColumnRenamed("root", "top"), ["grp", "block"])
    schema = f"row {kind.simpleString()}, subroot string, root string, proof_sha256 string, folded_root string" + ", path array<string>" * with_path
    out = rows.groupBy("grp", "block").cogroup(blocks.groupBy("grp", "block")).applyInArrow(_audit(height, fanout, with_path), schema)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def document_manifest(docs: DataFrame, height: int = 3, fanout: int = 16) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified`` of each document.

    A leaf is the digest of doc_id, source, lang, n_chars and text. Where 5 divides the CRC-32 of the id, the claim is the leaf of the text with A-Z lower-cased, else the leaf itself;
    a null id is not touched. Nulls in any column, empty texts and repeated rows are leaves like others; no documents give no rows; other columns take no part.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    leaf = leaf_of(*fields)
    claim = F.when(touched, leaf_of(*fields[:-1], F.translate("text", upper, lower))).otherwise(leaf)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf.alias("leaf"), claim.alias("claim"))
    out = audit(build(rows, "source", "doc_id", "leaf", height, fanout), "claim")
    return out.select("row.doc_id", "row.leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _sql(steps: int = 6, group_steps: int = 4) -> str:
    """The same in SQL, level by level, for groups of up to 16 ** ``steps`` rows; a level of one node hands it on."""

    def climb_sql(name: str, first: str, count: int) -> str:
        out = [f"{name}0 AS ({first})"]
        for k in range(count):
            run = "PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN"
            out.append(f"{name}w{k} AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})")
            out.append(f"{name}{k + 1} AS (SELECT g, i // 16 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}w{k} GROUP BY g, i // 16)")
        return ",\n".join(out)

    def way(name: str, count: int, rows: str, group: str, index: str, value: str, prefix: str) -> tuple[str, str]:
        """Adds the siblings of each level to the proof and folds the claim."""
        out, before = [], rows
        for k in range(count):
            out.append(f"{prefix}{k} AS (SELECT p.* REPLACE (proof || CASE WHEN n = 1 THEN '' ELSE l || r END AS proof, CASE WHEN n = 1 THEN {value} ELSE sha256(l || {value} || r) END AS {value}) FROM {before} p JOIN {name}w{k} q ON q.g IS NOT DISTINCT FROM p.{group} AND q.i = p.{index} // {16**k})")
            before = f"{prefix}{k}"
        return ",\n".join(out), before

    field = lambda e: f"coalesce(strlen({e}) || ':' || {e}, '-')"
    ident, rest = field("doc_id::VARCHAR"), " || ".join(field(e) for e in ("source", "lang", "n_chars::VARCHAR"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # CRC-32 bit by bit over a table of 256 values.
    crc = (
        "bits AS (SELECT b::UBIGINT AS b, list_reduce(list_prepend(b::UBIGINT, [s::UBIGINT for s in range(8)]), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) t(b)),\n"
        "steps AS (SELECT list(v ORDER BY b) AS v FROM bits),\n"
        "crcs AS (SELECT doc_id AS c, xor(list_reduce(list_prepend(4294967295::UBIGINT, [ascii(c)::UBIGINT for c in string_split(doc_id::VARCHAR, '')]), lambda c, s: xor(c >> 8, v[((xor(c, s) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) AS h FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), steps)"
    )
    leaves = (
        f"leaves AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf, claim FROM (SELECT doc_id, source, sha256({ident} || {rest} || {field('text')}) AS leaf, "
        f"sha256({ident} || {rest} || {field('CASE WHEN h % 5 = 0 THEN ' + low + ' ELSE text END')}) AS claim FROM documents LEFT JOIN crcs ON c = doc_id))"
    )
    groups = f"SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h FROM a{steps}"
    inner, last = way("a", steps, "marks", "source", "i", "folded_root", "u")
    outer, end = way("b", group_steps, "grouped", "zero", "j", "folded_root", "v")
    return f"""
WITH {crc},
{leaves},
{climb_sql('a', 'SELECT source AS g, i, leaf AS h FROM leaves', steps)},
{climb_sql('b', groups, group_steps)},
marks AS (SELECT *, '' AS proof, claim AS folded_root FROM leaves),
{inner},
names AS (SELECT g, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS j FROM a{steps}),
grouped AS (SELECT m.*, 0 AS zero, s.j, s.h AS subroot FROM {last} m JOIN names s ON s.g IS NOT DISTINCT FROM m.source),
{outer}
SELECT doc_id, leaf, subroot, b{group_steps}.h AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = b{group_steps}.h AS verified FROM {end}, b{group_steps}
"""


SQL = _sql()
