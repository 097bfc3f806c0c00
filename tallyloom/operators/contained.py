"""The longest registered name inside each text, or every one, by Aho-Corasick automata over shards of the names.

One automaton holds all names if they fit ``limit`` characters; it is broadcast as a list of names and built once a worker. Of a larger registry, names that begin alike make a group; a group
that is too large is cut by the characters behind its common beginning until its parts fit, and parts are packed into shards. Beginnings of parts exclude each other, so a place of a text visits one shard
at most, whatever the number of names. Names that end where a group is cut are few and are looked for apart. What still begins alike after ``ROUNDS`` cuts
is cut by the hash of the whole name, and its texts visit all cuts. Texts of a shard are dealt to tasks of bounded size.
Either way a text is read once an automaton, and the result is the same.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.runtime import materialise

#: Times that groups of names are cut.
ROUNDS = 24
#: Characters of names in one automaton, and texts that pass it in one task.
LIMIT, TEXTS = 1_000_000, 200_000
FOUND = "text string, name string, owner string"


def automaton(names: list[str], owners: list[str]):
    """Finds names; the number that a hit carries is smaller for longer names, and of one length for smaller owners."""
    import ahocorasick

    order = sorted(range(len(names)), key=lambda i: (-len(names[i]), owners[i], names[i]))
    made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for rank, i in enumerate(order):
        made.add_word(names[i], rank)
    made.make_automaton()
    return made, order


def _longest(texts: list[str], names: list[str], owners: list[str], built=None) -> pa.Table:
    made, order = built or automaton(names, owners)
    out: list[list[str]] = [[], [], []]
    for text in texts if len(order) else []:
        best = min((rank for _, rank in made.iter(text)), default=None)
        if best is not None:
            for column, value in zip(out, (text, names[order[best]], owners[order[best]])):
                column.append(value)
    return pa.table([pa.array(c, pa.string()) for c in out], names=["text", "name", "owner"])


def _every(texts: list[str], names: list[str], owners: list[str], built=None) -> pa.Table:
    made, order = built or automaton(names, owners)
    out: list[list[str]] = [[], [], []]
    for text in texts if len(order) else []:
        for rank in {rank for _, rank in made.iter(text)}:
            for column, value in zip(out, (text, names[order[rank]], owners[order[rank]])):
                column.append(value)
    return pa.table([pa.array(c, pa.string()) for c in out], names=["text", "name", "owner"])


def _visits(texts: DataFrame, heads: dict[str, int]) -> DataFrame:
    """``text`` and ``shard`` of the names that begin with some stretch of the text; stretches that no name begins with are never dealt."""
    shared = texts.sparkSession.sparkContext.broadcast(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for head, shard in shared.value.items():
            made.add_word(head, shard)
        made.make_automaton()
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for text in batch.column("text").to_pylist():
                shards = sorted({shard for _, shard in made.iter(text)}) if shared.value else []
                out[0].extend([text] * len(shards))
                out[1].extend(shards)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32())], ["text", "shard"])

    return texts.select("text").mapInArrow(run, "text string, shard int")


def _broadcast(texts: DataFrame, names: list[str], owners: list[str], find: Callable) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast((names, owners))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, owners = shared.value
        built = automaton(names, owners)
        for batch in batches:
            yield from find([t for t in batch.column("text").to_pylist() if t is not None], names, owners, built).to_batches()

    return texts.select("text").mapInArrow(run, FOUND)


def _groups(names: DataFrame, limit: int) -> tuple[dict[str, tuple[int, int]], list[str]]:
    """Beginnings of groups of names, none of which begins with another, each with its characters and names; and the names that end where a group was cut.

    Groups that are cut hold more than ``limit`` characters, so there are few of them in a round, and each gives at most one such name.
    """
    spark = names.sparkSession
    whole, ended = {}, []
    size = [F.sum(F.length("name")).alias("chars"), F.count(F.lit(1)).alias("names"), F.min("name").alias("low"), F.max("name").alias("high")]
    kept = lambda c: F.when((F.col("chars") > limit) & (F.col("names") > 1), F.col(c)).alias(c)
    rest = names.select("name", F.lit("").alias("head"))
    for n in range(ROUNDS + 1):
        large = []
        for g in rest.groupBy("head").agg(*size).select("head", "chars", "names", kept("low"), kept("high")).collect():
            common = None if g.low is None else os.path.commonprefix([g.low, g.high])
            if common is None or n == ROUNDS or len(common) > limit:
                whole[g.head] = (g.chars, g.names)
            else:
                large.append((g.head, len(common) + 1))
                # The smallest name is the common beginning, if any is.
                ended += [common] if g.low == common else []
        if not large:
            break
        cut = spark.createDataFrame(large, "head string, places int")
        longer = F.length("name") >= F.col("places")
        rest = rest.join(F.broadcast(cut), "head").where(longer).select("name", F.expr("substring(name, 1, places)").alias("head"))
    return whole, ended


def _begins(names: DataFrame, heads: dict[str, int]) -> DataFrame:
    """``names`` that begin with one of ``heads``, with its ``shard``."""
    shared = names.sparkSession.sparkContext.broadcast((heads, sorted({len(h) for h in heads})))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, sizes = shared.value
        for batch in batches:
            shards = [next((heads[name[:n]] for n in sizes if name[:n] in heads), None) for name in batch.column("name").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards, pa.int32())], [*batch.schema.names, "shard"])

    return names.select("name", "owner").mapInArrow(run, "name string, owner string, shard int").where("shard IS NOT NULL")


def _in_shards(texts: DataFrame, names: DataFrame, limit: int, per_task: int, find: Callable) -> DataFrame:
    spark = texts.sparkSession
    # Texts and names are written out, as several steps read them.
    texts, names = materialise(texts.select("text"), "texts"), materialise(names, "names")
    groups, ended = _groups(names, limit)
    heads, pieces, held = {}, [], limit
    for head in sorted(groups):
        chars, count = groups[head]
        if held + chars > limit:
            pieces.append((len(pieces), max(1, min(-(-chars // limit), count))))
            held = 0
        heads[head], held = len(pieces) - 1, held + chars
    # One row a shard.
    cuts = spark.createDataFrame(pieces, "shard int, cuts int")
    dealt = _begins(names, heads).join(F.broadcast(cuts), "shard").withColumn("cut", F.pmod(F.xxhash64("name"), F.col("cuts")).cast("int"))
    visits = _visits(texts, heads).join(F.broadcast(cuts), "shard")
    crowd = materialise(visits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(per_task)).cast("int").alias("lanes")), "crowd")
    visits = visits.join(F.broadcast(crowd), "shard").select(
        "text", "shard", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), F.pmod(F.xxhash64("text", F.lit("lane")), F.col("lanes")).cast("int").alias("lane")
    )
    held = dealt.join(F.broadcast(crowd), "shard").select("name", "owner", "shard", "cut", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"))
    at = ["shard", "cut", "lane"]

    def run(some: pa.Table, held: pa.Table) -> pa.Table:
        return find(some.column("text").to_pylist(), held.column("name").to_pylist(), held.column("owner").to_pylist())

    hits = visits.groupBy(*at).cogroup(held.groupBy(*at)).applyInArrow(run, FOUND)
    if ended:
        short = names.join(F.broadcast(spark.createDataFrame([(n,) for n in ended], "name string")), "name", "left_semi").select("name", "owner")
        hits = hits.unionByName(_hits(texts, short, max(limit, LIMIT), per_task, find)[0])
    return hits


def _hits(texts: DataFrame, names: DataFrame, limit: int, per_task: int, find: Callable) -> tuple[DataFrame, bool]:
    """What ``find`` finds, and whether it looked at parts of the names, as they don't fit one automaton."""
    usable = names.where((F.length("name") > 0) & F.col("owner").isNotNull()).select("name", "owner")
    total = usable.agg(F.coalesce(F.sum(F.length("name")), F.lit(0)).alias("n")).first()["n"]
    texts = texts.where(F.length("text") > 0)
    if total > limit:
        return _in_shards(texts, usable, limit, per_task, find), True
    rows = usable.orderBy("name").collect()
    return _broadcast(texts, [r["name"] for r in rows], [r["owner"] for r in rows], find), False


def longest_contained(texts: DataFrame, names: DataFrame, limit: int = LIMIT, per_task: int = TEXTS) -> DataFrame:
    """``text``, ``name`` and ``owner`` for each of the distinct ``texts`` that contain a name: the longest, ties to the smaller owner, then name.

    ``names``: distinct ``name`` with its ``owner`` (texts). Null and empty texts hold no name, null and empty names are in no text; characters are compared as they are.
    """
    hits, parted = _hits(texts, names, limit, per_task, _longest)
    if not parted:
        return hits
    best = hits.groupBy("text").agg(F.min(F.struct((-F.length("name")).alias("size"), "owner", "name")).alias("best"))
    return best.select("text", "best.name", "best.owner")


def all_contained(texts: DataFrame, names: DataFrame, limit: int = LIMIT, per_task: int = TEXTS) -> DataFrame:
    """As ``longest_contained`` with every name that a text contains, each once."""
    return _hits(texts, names, limit, per_task, _every)[0]
