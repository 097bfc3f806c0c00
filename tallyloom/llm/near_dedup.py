"""Near-duplicate groups by SuperMinHash signatures, banding, exact confirmation and union-find.

SuperMinHash deals each element of a set a random permutation of the signature's slots and a rank in each;
ranks grow by one with each step along the permutation, so an element need only walk until no slot can fall any more.
The walk is taken by all elements of many documents at once, and documents leave as soon as they are done.

Documents of equal sets count once. Bands that agree tie a set to the smallest one of the bucket, not to
all others, and the components of these ties hold every pair that may be linked. Inside them, links are confirmed on the
full sets: each set against those that are not in its group yet, so that a thousand near copies cost few comparisons,
and no link between groups goes unseen. Components too large for a task are compared in blocks (``_large``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import grams
from tallyloom.llm.components import components
from tallyloom.runtime import materialise


#: Ids (8 bytes each) that are broadcast.
SENT = 1_000_000


def shingles(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each row in order, and where each row begins, with the end."""
    data, offsets = grams.utf8(column)
    data = grams.LOWER[data]
    starts, ends, first = grams.word_bounds(data, offsets)
    words = grams.content_hash(data, starts, ends)
    total = np.diff(first)
    count = np.where(total >= size, total - size + 1, np.minimum(total, 1))
    row = np.repeat(np.arange(len(total)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[:-1][row]
    # A chain over the words' hashes; a sequence shorter than a shingle takes fewer steps.
    values, last = np.zeros(len(at), np.uint64), first[1:][row]
    for step in range(size):
        inside = slice(None) if step == 0 else np.flatnonzero(at + step < last)
        values[inside] = grams.mix(values[inside] ^ words[at[inside] + step])
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[keep], row[keep]
    return values, np.searchsorted(row, np.arange(len(total) + 1))


def superminhash(values: np.ndarray, begin: np.ndarray, slots: int) -> np.ndarray:
    """Signature of each set; ``begin``: where each set's values begin, with the end. Empty sets keep the largest value."""
    n = len(begin) - 1
    least = np.full((n, slots), np.uint64((1 << 64) - 1))
    flat = least.reshape(-1)
    owner = np.repeat(np.arange(n), np.diff(begin))
    element, order = values, None
    for step in range(slots):
        if not len(element):
            break
        draw = grams.mix(element + np.uint64((step + 1) * 0x632BE59BD9B4E019 % (1 << 64)))
        pick = step + ((draw >> np.uint64(40)) * np.uint64(slots - step) >> np.uint64(24)).astype(np.int64)
        rank = (grams.mix(draw) >> np.uint64(8)) | np.uint64(step << 56)
        if order is None:
            order = np.broadcast_to(np.arange(slots, dtype=np.uint8), (len(element), slots))
            slot = pick
        else:
            line = np.arange(len(element))
            slot = order[line, pick].astype(np.int64)
        np.minimum.at(flat, owner * slots + slot, rank)
        # No further step can lower a slot of a set whose slots all lie below it.
        going = (least.max(axis=1) >> np.uint64(56)) > np.uint64(step)
        stay = going[owner]
        if order.base is not None and not order.flags.writeable:
            order = np.array(order[stay])
        else:
            order = order[stay]
        element, owner, pick = element[stay], owner[stay], pick[stay]
        line = np.arange(len(element))
        order[line, pick] = order[line, step]
    return least


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    n, slots = signatures.shape
    bands = signatures.reshape(n, slots // rows, rows)
    key = np.zeros(bands.shape[:2], np.uint64)
    for i in range(rows):
        key = grams.mix(key ^ bands[:, :, i])
    return grams.mix(key + np.arange(slots // rows, dtype=np.uint64)[None, :])


def _digest(members: bytes) -> bytes:
    return hashlib.blake2b(members, digest_size=16).digest()


def _sketch(text: str, ids: str, size: int, slots: int, rows: int):
    def run(batches):
        for batch in batches:
            for piece in grams.slices(batch, text):
                values, begin = shingles(piece.column(text), size)
                keys = band_keys(superminhash(values, begin, slots), rows).view(np.int64)
                total = np.diff(begin)
                digest = [_digest(values[a:b].tobytes()) for a, b in zip(begin[:-1], begin[1:])]
                bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), keys.shape[1]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([piece.column(ids), pa.array(total), pa.array(digest, pa.binary()), bands], [ids, "n_shingles", "digest", "bands"])

    return run


def _sets(text: str, size: int):
    """The full set of each row, packed; rows of an id whose set is another one are left out."""

    def run(batches):
        for batch in batches:
            for piece in grams.slices(batch, text):
                values, begin = shingles(piece.column(text), size)
                packed = [values[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])]
                meant = [_digest(p) == d for p, d in zip(packed, piece.column("digest").to_pylist())]
                yield pa.RecordBatch.from_arrays([piece.column("doc"), piece.column("cluster"), pa.array(packed, pa.binary())], ["doc", "cluster", "members"]).filter(pa.array(meant))

    return run


def confirmed(sets: list[np.ndarray], group: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that join different groups of sets, as pairs of positions: a spanning part of all links.

    ``group``: the group each set is known to be in. Every two sets of different groups are compared until their groups join.
    """
    sizes = np.asarray([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    value, holder = values[order], owner[order]
    run = np.cumsum(np.append(0, value[1:] != value[:-1]))
    bounds = np.searchsorted(run, np.arange(run[-1] + 2))
    place = np.empty(len(values), np.int64)
    place[order] = run
    begin = np.cumsum(sizes) - sizes
    label = np.unique(np.asarray(group), return_inverse=True)[1].astype(np.int64)
    links = []
    for i in range(len(sets)):
        if sizes[i] == 0 or (label == label[i]).all():
            continue
        mine = place[begin[i] : begin[i] + sizes[i]]
        start, count = bounds[mine], bounds[mine + 1] - bounds[mine]
        total = np.cumsum(count)
        others = holder[np.repeat(start - (total - count), count) + np.arange(total[-1])]
        common = np.bincount(others, minlength=len(sets))
        union = sizes + sizes[i] - common
        near = np.flatnonzero((100 * common >= percent * union) & (label != label[i]) & (common > 0))
        for j in near:
            if label[j] != label[i]:
                links.append((i, int(j)))
                label[label == label[j]] = label[i]
    return links


def _link(percent: int):
    """Links inside each cluster of a group of rows (doc, cluster, members, optionally comp)."""

    def run(table: pa.Table) -> pa.Table:
        cluster = np.asarray(table.column("cluster"))
        docs = np.asarray(table.column("doc"))
        comps = np.asarray(table.column("comp")) if "comp" in table.column_names else docs
        order = np.lexsort((docs, cluster))
        packed = table.column("members").combine_chunks()
        left, right = [], []
        cut = np.flatnonzero(np.diff(cluster[order])) + 1
        for some in np.split(order, cut):
            some = some[np.append(True, docs[some][1:] != docs[some][:-1])]
            sets = [np.frombuffer(packed[int(i)].as_buffer(), np.uint64) for i in some]
            for i, j in confirmed(sets, [int(comps[k]) for k in some], percent) if len(some) > 1 else []:
                left.append(int(docs[some[i]]))
                right.append(int(docs[some[j]]))
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def _large(rows: DataFrame, percent: int, limit: int) -> DataFrame:
    """Links inside clusters of more than ``limit`` shingles, in blocks of about that many.

    First inside each block; then between one set of each group found so far; then, block by block, between all sets and those
    that are not in the largest group of their cluster. After that every two sets of different groups have been compared.
    ``rows``: doc, cluster, members, total (shingles of the cluster).
    """
    edge = "a long, b long"
    size = F.octet_length("members") / 8
    blocks = F.ceil(F.col("total") / F.lit(limit)).cast("long")
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("doc"), blocks))

    def regrouped(links: DataFrame, frame: DataFrame) -> DataFrame:
        found = components(links).select(F.col("node").alias("doc"), F.col("label").alias("comp"))
        return frame.join(found, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))

    links = materialise(blocked.groupBy("cluster", "block").applyInArrow(_link(percent), edge), "links")
    while True:
        grouped = regrouped(links, blocked)
        heads = grouped.where("doc = comp")
        width = heads.groupBy("cluster").agg(F.sum(size).alias("_width"))
        dealt = heads.join(F.broadcast(width), "cluster").withColumn("block", F.pmod(F.xxhash64("doc", F.lit("heads")), F.ceil(F.col("_width") / F.lit(limit)).cast("long")))
        more = materialise(dealt.select("doc", "cluster", "members", "comp", "block").groupBy("cluster", "block").applyInArrow(_link(percent), edge), "links")
        if more.isEmpty():
            break
        links = materialise(links.union(more), "links")
    grouped = materialise(regrouped(links, blocked), "grouped")
    weight = grouped.groupBy("cluster", "comp").agg(F.count("*").alias("_n"))
    main = weight.groupBy("cluster").agg(F.max_by("comp", F.struct("_n", "comp")).alias("_main"))
    rest = grouped.join(F.broadcast(main), "cluster").where("comp <> _main").drop("_main")
    # Chunks by hash, as many as the shingles outside the largest group fill; with one row per large cluster broadcast, no cluster meets in one task.
    each = materialise(rest.groupBy("cluster").agg((F.ceil(F.sum(size) / F.lit(limit)) - 1).cast("long").alias("_last")), "chunks")
    rest = rest.join(F.broadcast(each), "cluster").withColumn("chunk", F.pmod(F.xxhash64("doc", F.lit("chunks")), F.col("_last") + 1)).drop("_last")
    columns = ["doc", "cluster", "members", "comp", "pair"]
    # Every block of a cluster meets every chunk of what is outside its largest group.
    spread = grouped.join(F.broadcast(each), "cluster").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    spread = spread.withColumn("pair", F.concat_ws("-", "block", "chunk")).select(columns)
    visit = rest.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).withColumn("pair", F.concat_ws("-", "_b", "chunk")).select(columns)
    last = spread.union(visit).groupBy("cluster", "pair").applyInArrow(_link(percent), edge)
    return links.union(last)


def _texts(source: DataFrame, wanted: DataFrame, text: str, id_column: str) -> DataFrame:
    """The texts that are to be compared. They are few of all, so the others are left out before anything is shuffled; beyond ``SENT`` ids all are."""
    if wanted.limit(SENT + 1).count() <= SENT:
        source = source.join(F.broadcast(wanted.select("doc")), F.col(id_column) == F.col("doc"), "left_semi")
    return source.join(wanted, F.col(id_column) == F.col("doc")).select(text, "doc", "cluster", "digest")


def near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id", size: int = 4, percent: int = 80, slots: int = 96, rows: int = 4, limit: int = 4_000_000) -> DataFrame:
    """``id_column``, ``n_shingles``, ``component_id`` and ``kept`` for each row of ``docs``.

    Two documents are linked if 100 * common >= ``percent`` * union of their shingle sets (words lower-cased in A-Z).
    A pair at 0.8 agrees in none of the 24 bands with probability 0.0000032, and ties through others heal that.
    Null or wordless texts link with nothing. Rows with a null id take no part: their component is null, and they are kept.
    Rows with one id are one document. ``limit``: shingles compared in one task.
    """
    source = docs.select(F.col(id_column).cast("long").alias(id_column), F.col(text).cast("string").alias(text))
    sketch = materialise(source.mapInArrow(_sketch(text, id_column, size, slots, rows), f"{id_column} long, n_shingles long, digest binary, bands array<long>"), "sketch")
    usable = sketch.where(F.col(id_column).isNotNull() & (F.col("n_shingles") > 0))
    same = materialise(usable.groupBy("digest").agg(F.min(id_column).alias("doc"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"), F.count("*").alias("copies")), "same")
    band = same.select("doc", F.explode("bands").alias("band"))
    center = band.groupBy("band").agg(F.min("doc").alias("a"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    # One id with several texts ties all of them.
    twice = usable.groupBy(id_column).agg(F.min("digest").alias("_x"), F.max("digest").alias("_y")).where("_x <> _y").select(id_column).join(usable.select(id_column, "digest"), id_column).join(same.select("digest", "doc"), "digest").select(F.col(id_column).alias("a"), F.col("doc").alias("b"))
    ties = materialise(band.join(center, "band").where("a < doc").select("a", F.col("doc").alias("b")).distinct(), "ties")
    clusters = components(ties).select(F.col("node").alias("doc"), F.col("label").alias("cluster"))
    width = clusters.join(same.select("doc", "n"), "doc").groupBy("cluster").agg(F.sum("n").alias("total"))
    width = materialise(width, "width")
    wanted = materialise(clusters.join(same.select("doc", "digest"), "doc"), "wanted")
    text_of = _texts(source, wanted, text, id_column)
    sets = materialise(text_of.mapInArrow(_sets(text, size), "doc long, cluster long, members binary"), "sets")
    load = width.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.max("total"), F.lit(0)).alias("most")).first()
    rated = sets.join(width, "cluster")
    bins = max(1, int(load["n"]) // (limit // 4))
    small = rated.where(F.col("total") <= limit).withColumn("bin", F.pmod(F.xxhash64("cluster"), F.lit(bins)))
    links = small.select("doc", "cluster", "members", "bin").groupBy("bin").applyInArrow(_link(percent), "a long, b long").union(twice)
    if load["most"] > limit:
        links = links.union(_large(materialise(rated.where(F.col("total") > limit), "large"), percent, limit))
    label = components(links).select(F.col("node").alias("doc"), "label")
    # Only sets of several documents, or linked ones, need a look-up.
    final = same.join(label, "doc", "left").where((F.col("copies") > 1) | F.col("label").isNotNull()).select("digest", F.coalesce("label", "doc").alias("_label"))
    out = sketch.select(id_column, "n_shingles", "digest").join(final, "digest", "left")
    component = F.when(F.col(id_column).isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col(id_column)).otherwise(F.coalesce("_label", id_column))
    return out.select(id_column, "n_shingles", component.cast("long").alias("component_id")).withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, CASE WHEN len(ws) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 80 * (p.n + q.n - common)),
ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT node, y FROM reach JOIN ways ON seen = x),
l AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept FROM d JOIN l ON l.node = d.doc_id LEFT JOIN n USING (doc_id)
"""
