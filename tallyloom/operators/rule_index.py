"""Classification by thousands of rules through an index of their literals.

``classify`` compiles its rules into one expression, which suits hundreds. Here each distinct text meets only the rules that can match it: a plain rule by an equi-join on its text, and a
regex by the longest literal that every match of it must hold. All literals form one automaton, which reads a text once; the regexes of the literals that it finds are then run, by the
same engine as in ``classify``. Regexes without such a literal are few and stay compiled. Results equal those of ``classify``.

Rules come as a list, which the driver holds, or as a table of any size. The literals of a table are looked for in shards (see ``contained``), and a regex is run only on texts that end as it does.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.predicates import matches_pattern
from tallyloom.functions.skew import Running, hot_groups, running, spread_join
from tallyloom.operators.classify import RULE_SCHEMA, Rule, first_match, load_rules
from tallyloom.operators.contained import all_contained
from tallyloom.runtime import materialise

#: Rules of a list, and regexes of a table that hold no literal, are held by the driver; this bounds what is broadcast.
MOST_RULES = 200_000
#: Candidates that a task holds before they are passed on.
BATCH = 1 << 16
RULES = "rank int, id string, pattern string, merchant string, category string, type string, confidence double"


def _literals(parsed) -> Iterator[str]:
    run = ""
    for op, value in parsed:
        if op is sre.LITERAL:
            run += chr(value)
            continue
        yield run
        run = ""
        if op is sre.SUBPATTERN:
            yield from _literals(value[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
            yield from _literals(value[2])
    yield run


def required_literal(pattern: str) -> str | None:
    """The longest text that every match of a regex holds; None if there is none or the regex has flags or syntax of another kind."""
    if "(?" in pattern.replace("(?:", "") or "\\Q" in pattern or "\\p" in pattern or "&&" in pattern:
        return None
    try:
        best = max(_literals(parser.parse(pattern)), key=len, default="")
    except (re.error, OverflowError, RecursionError):
        return None
    return best or None


def last_literal(pattern: str) -> str:
    """The text that every match of a regex with a required literal ends with, which may be empty."""
    run = ""
    for op, value in reversed(list(parser.parse(pattern))):
        if op is not sre.LITERAL:
            break
        run = chr(value) + run
    return run


def _candidates(texts: DataFrame, literals: dict[str, list[int]]) -> DataFrame:
    """``text`` and ``rank`` of the regexes whose literal the text holds."""
    shared = texts.sparkSession.sparkContext.broadcast(literals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for literal, ranks in shared.value.items():
            found.add_word(literal, ranks)
        found.make_automaton()
        made = lambda out: pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32())], ["text", "rank"])
        out: tuple[list, list] = ([], [])
        for batch in batches:
            for text in batch.column("text").to_pylist():
                ranks = {r for _, some in found.iter(text) for r in some}
                out[0].extend([text] * len(ranks))
                out[1].extend(sorted(ranks))
                if len(out[0]) >= BATCH:
                    yield made(out)
                    out = ([], [])
        yield made(out)

    return texts.mapInArrow(run, "text string, rank int")


def best_ranks(texts: DataFrame, ordered: Sequence[Rule]) -> DataFrame:
    """``text`` and the ``rank`` (place from 0) of the first of ``ordered`` that matches it, for distinct upper-cased ``texts``; texts without a match are left out."""
    spark = texts.sparkSession
    plain = [(r.pattern.upper(), i) for i, r in enumerate(ordered) if not r.is_regex]
    # Of rules with one regex only the first can win.
    first = {r.pattern: i for i, r in reversed(list(enumerate(ordered))) if r.is_regex}
    literal = {i: required_literal(pattern) for pattern, i in sorted(first.items(), key=lambda f: f[1])}
    index: dict[str, list[int]] = {}
    for i, text in literal.items():
        if text is not None:
            index.setdefault(text, []).append(i)
    parts = []
    if plain:
        exact = spark.createDataFrame(plain, "text string, rank int").groupBy("text").agg(F.min("rank").alias("rank"))
        parts.append(texts.join(F.broadcast(exact), "text"))
    if index:
        patterns = spark.createDataFrame([(i, rf"\A(?:{ordered[i].pattern})\z") for i, text in literal.items() if text is not None], "rank int, pattern string")
        met = _candidates(texts, index).join(F.broadcast(patterns), "rank")
        parts.append(met.where(F.rlike("text", F.col("pattern"))).select("text", "rank"))
    rest = [i for i, text in literal.items() if text is None]
    if rest:
        at = first_match([matches_pattern(ordered[i].pattern, True, F.col("text")) for i in rest])
        numbers = F.array(*[F.lit(i) for i in rest])
        parts.append(texts.select("text", F.get(numbers, at - 1).alias("rank")).where("rank IS NOT NULL"))
    if not parts:
        return texts.select("text", F.lit(None).cast("int").alias("rank")).where("rank IS NOT NULL")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.groupBy("text").agg(F.min("rank").alias("rank"))


def _ranked(rules: DataFrame, by_priority: bool) -> DataFrame:
    """The first rule of each text or regex, with its ``rank``, the ``literal`` that a match of its regex must hold and the ``tail`` that it ends with."""
    late = -F.coalesce("priority", F.lit(0)).cast("bigint") if by_priority else F.lit(0).cast("bigint")
    text = F.when(F.col("is_regex"), F.col("pattern")).otherwise(F.upper("pattern"))
    held = rules.where("pattern IS NOT NULL").select(late.alias("late"), "place", F.coalesce("is_regex", F.lit(False)).alias("is_regex"), text.alias("pattern"), "id", "merchant", "category", "type", F.col("confidence").cast("double"))
    first = held.groupBy("is_regex", "pattern").agg(F.min(F.struct("late", "place", "id", "merchant", "category", "type", "confidence")).alias("r")).select("is_regex", "pattern", "r.*")
    first = running(first, [], ["late", "place", "is_regex", "pattern"], [Running("rank", "count", F.lit(1))]).drop("late", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regexes = [p if is_regex else None for p, is_regex in zip(batch.column("pattern").to_pylist(), batch.column("is_regex").to_pylist())]
            literals = [None if p is None else required_literal(p) for p in regexes]
            tails = [None if literal is None else last_literal(p) for p, literal in zip(regexes, literals)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(literals, pa.string()), pa.array(tails, pa.string())], [*batch.schema.names, "literal", "tail"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in first.schema.fields)
    return materialise(first.mapInArrow(run, f"{names}, literal string, tail string"), "rules")


def _crowded(rows: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of texts to what may apply to them; keys that very many texts share are spread."""
    return spread_join(rows, lookup, keys, ["text"], hot_groups(rows, keys), how="inner")


def _best_of_table(texts: DataFrame, rules: DataFrame, **sizes) -> DataFrame:
    """As ``best_ranks`` for rules as ``_ranked`` gives them."""
    plain = rules.where("NOT is_regex").select(F.col("pattern").alias("text"), "rank")
    found = texts.join(plain, "text")
    regexes = rules.where("literal IS NOT NULL")
    literals = regexes.select(F.col("literal").alias("name"), F.lit("").alias("owner")).distinct()
    hits = materialise(all_contained(texts, literals, **sizes).select("text", F.col("name").alias("literal")), "hits")
    lengths = regexes.select("literal", F.length("tail").alias("size")).distinct()
    ends = _crowded(hits, lengths, ["literal"]).select("text", "literal", F.expr("right(text, size)").alias("tail"))
    met = _crowded(materialise(ends, "ends"), regexes.select("literal", "tail", "rank", F.concat(F.lit(r"\A(?:"), "pattern", F.lit(r")\z")).alias("pattern")), ["literal", "tail"])
    found = found.unionByName(met.where(F.rlike("text", F.col("pattern"))).select("text", "rank"))
    rest = rules.where("is_regex AND literal IS NULL").select("rank", "pattern").orderBy("rank").limit(MOST_RULES + 1).collect()
    if len(rest) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} regexes hold no literal; they are held by the driver")
    if rest:
        at = first_match([matches_pattern(r["pattern"], True, F.col("text")) for r in rest])
        numbers = F.array(*[F.lit(r["rank"]).cast("bigint") for r in rest])
        found = found.unionByName(texts.select("text", F.get(numbers, at - 1).alias("rank")).where("rank IS NOT NULL"))
    return found.groupBy("text").agg(F.min("rank").alias("rank"))


def classify_indexed(df: DataFrame, rules: Sequence[Rule] | DataFrame | None = None, by_priority: bool = True, spread: Sequence[str] = ("tx_id",), **sizes) -> DataFrame:
    """As ``classify.classify``, for any number of rules. ``spread``: columns that tell rows apart, to spread texts that very many rows share.

    ``rules``: a list, or a table with the columns of ``RULE_SCHEMA`` and ``place``, a number that tells each rule's place in their order. A list of more than ``MOST_RULES`` becomes a table.
    ``sizes``: ``limit`` and ``per_task`` of ``contained`` for the literals of a table.
    """
    spark = df.sparkSession
    rules = load_rules() if rules is None else rules
    if not isinstance(rules, DataFrame) and len(rules) > MOST_RULES:
        each = [(i, r.id, r.pattern, r.is_regex, r.merchant, r.category, r.type, None if r.confidence is None else float(r.confidence), r.priority) for i, r in enumerate(rules)]
        rules = spark.createDataFrame(each, f"place long, {RULE_SCHEMA}")
    rows = df.withColumns({"_desc": F.upper(F.coalesce("description", F.lit(""))), "_merch": F.upper(F.coalesce("merchant", F.lit("")))})
    texts = materialise(rows.select(F.explode(F.array("_desc", "_merch")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("_rows")), "texts")
    set_by = ("id", "merchant", "category", "type", "confidence")
    if isinstance(rules, DataFrame):
        table = _ranked(rules, by_priority)
        best = materialise(_best_of_table(texts.select("text"), table, **sizes), "ranks")
        # What a rule sets goes with its texts, so rows need not meet the rules again.
        best = _crowded(best, table.select("rank", *set_by), ["rank"]).select("text", F.struct("rank", *set_by).alias("won"))
        best = materialise(best, "won")
    else:
        ordered = sorted(rules, key=lambda r: -r.priority) if by_priority else list(rules)
        best = materialise(best_ranks(texts.select("text"), ordered), "ranks").withColumnRenamed("rank", "won")
    hot = hot_groups(texts, ["text"], rows="_rows")
    for side in ("_desc", "_merch"):
        found = best.select(F.col("text").alias(side), F.col("won").alias(f"{side}_won"))
        rows = spread_join(rows, found, [side], spread, hot)
    rows = rows.withColumn("_won", F.least("_desc_won", "_merch_won"))
    if isinstance(rules, DataFrame):
        rows = rows.withColumns({f"_{c}": F.col("_won")[c] for c in set_by} | {"_hit": F.col("_won").isNotNull()})
    else:
        table = spark.createDataFrame([(i, r.id, r.pattern, r.merchant, r.category, r.type, None if r.confidence is None else float(r.confidence)) for i, r in enumerate(ordered)], RULES)
        won = table.select(F.col("rank").alias("_won"), *[F.col(c).alias(f"_{c}") for c in set_by], F.lit(True).alias("_hit"))
        rows = rows.join(F.broadcast(won), "_won", "left")
    hit = F.coalesce("_hit", F.lit(False))
    kept = lambda c, kind: F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
    out = {
        "merchant_id": F.when(hit, F.coalesce("_merchant", kept("merchant_id", "string"))),
        "category_id": F.when(~hit, "uncategorized").otherwise(F.coalesce("_category", kept("category_id", "string"))),
        "confidence": F.when(~hit, F.lit(0.0)).otherwise(F.coalesce("_confidence", kept("confidence", "double"))),
        "rule_id": F.col("_id"),
    }
    if "type" in df.columns:
        out["type"] = F.coalesce("_type", "type")
    made = rows.withColumns(out)
    return made.select(*df.columns, *[c for c in out if c not in df.columns])
