"""Name resolution against registries of entities with many name variations.

Registries may be large, so nothing here loops over entities. Exact names are an equi-join
with one row per name. Contained variations are found by automata over the registry or its
shards, one pass a text (see ``contained``). Work is done once per distinct text.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.normalise import file_prefix, fill_template, kebab, squash
from tallyloom.functions.skew import first_per_key, hot_groups, spread_join
from tallyloom.operators.contained import longest_contained
from tallyloom.runtime import materialise

# Confidence of the match tiers and factors of the resolver.
EXACT_NAME, EXACT_VARIATION, CONTAINED = 1.0, 0.95, 0.70
MISS_FACTOR = 0.30
TRANSFER_PREFIXES = ["spei", "sweb"]

# The four entity types in order of resolution, where their text comes from and
# which registry columns they add.
DEFINITIONS = [
    {
        "id": "merchant",
        "source": "clean_merchant",
        "output": {"entity_type": "entity_type", "merchant_category": "category", "mcc": "mcc"},
    },
    {
        "id": "bank",
        "source": "bank",
        "extractor": ("file-prefix", "pdf_source"),
        "output": {"bank_type": "bank_type", "default_payment_method": "default_payment_method"},
    },
    {
        "id": "account",
        "source": "account_name",
        "template": "{bank_canonical} Checking",
        "template_fields": ["bank_canonical"],
        "output": {"payment_method": "payment_method", "payment_network": "payment_network"},
    },
    {
        "id": "category",
        "source": "merchant_category",
        "output": {"budget_category": "budget_category", "budget_subcategory": "budget_subcategory"},
    },
]

EXTRACTORS: dict[str, Callable[[Column], Column]] = {"file-prefix": file_prefix}


def variation_rows(registry: DataFrame, entity: str = "entity_id") -> DataFrame:
    """(entity, name, tier): the canonical name and each variation in comparison form."""
    names = registry.select(
        F.col(entity).alias("entity_id"),
        F.explode(
            F.concat(
                F.array(F.struct(F.col("canonical_name").alias("name"), F.lit(1).alias("tier"))),
                F.transform(
                    F.coalesce("variations", F.array().cast("array<string>")),
                    lambda v: F.struct(v.alias("name"), F.lit(2).alias("tier")),
                ),
            )
        ).alias("n"),
    )
    return names.select("entity_id", squash(F.col("n.name")).alias("name"), F.col("n.tier").alias("tier")).where(
        F.length("name") > 0
    )


def match_names(texts: DataFrame, registry: DataFrame, min_length: int = 1) -> DataFrame:
    """Best entity for each text of column ``text`` (comparison form, distinct).

    Canonical name, then exact variation, then longest contained variation; ties by id. Contained
    variations shorter than ``min_length`` are not tried.
    """
    names = variation_rows(registry)
    exact = names.groupBy("name").agg(F.min(F.struct("tier", "entity_id")).alias("hit"))
    tried = texts.join(exact.withColumnRenamed("name", "text"), "text", "left")

    inner = names.where((F.col("tier") == 2) & (F.length("name") >= min_length))
    owner = inner.groupBy("name").agg(F.min("entity_id").alias("owner"))
    open_texts = tried.where(F.col("hit").isNull()).select("text").where(F.length("text") >= min_length)
    inside = longest_contained(open_texts, owner).select("text", F.struct("owner").alias("part"))
    both = tried.join(inside, "text", "left")
    tier = F.when(F.col("hit").isNotNull(), F.col("hit.tier")).when(F.col("part").isNotNull(), F.lit(3))
    return both.select(
        "text",
        F.coalesce("hit.entity_id", "part.owner").alias("entity_id"),
        F.when(tier == 1, "exact-canonical")
        .when(tier == 2, "exact-variation")
        .when(tier == 3, "substring-match")
        .otherwise("no-match")
        .alias("match_type"),
        F.when(tier == 1, EXACT_NAME).when(tier == 2, EXACT_VARIATION).when(tier == 3, CONTAINED)
        .otherwise(0.0)
        .alias("match_confidence"),
    )


def lookup(
    df: DataFrame,
    registry: DataFrame,
    text: Column,
    prefix: str,
    spread: Sequence[str] = ("tx_id",),
    output: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add ``{prefix}_text``, ``_entity``, ``_canonical``, ``_match``, ``_confidence``, ``_resolved``,
    and the registry columns named in ``output``."""
    name = f"{prefix}_text"
    made = [f"{prefix}_{c}" for c in ("entity", "canonical", "match", "confidence", "resolved")]
    rows = df.drop(*made, *(output or {})).withColumn(name, text).withColumn("text", squash(F.col(name)))
    # The distinct texts are written out: several joins read them, and later steps build on them.
    counted = materialise(
        rows.where(F.col("text").isNotNull()).groupBy("text").agg(F.count(F.lit(1)).alias("_rows")), "texts"
    )
    columns = [F.col(c).alias(n) for n, c in (output or {}).items()]
    extra = registry.select("entity_id", F.col("canonical_name").alias(f"{prefix}_canonical"), *columns)
    found = materialise(match_names(counted.select("text"), registry).join(extra, "entity_id", "left"), "matches")
    hot = hot_groups(counted, ["text"], rows="_rows")
    joined = spread_join(rows, found, ["text"], spread, hot).drop("text")
    return (
        joined.withColumnRenamed("entity_id", f"{prefix}_entity")
        .withColumnRenamed("match_type", f"{prefix}_match")
        .withColumnRenamed("match_confidence", f"{prefix}_confidence")
        .withColumn(f"{prefix}_resolved", F.col(f"{prefix}_entity").isNotNull())
    )


def search_text(df: DataFrame, definition: Mapping) -> Column:
    """Source column, else extractor, else fallback column, else filled template."""
    options = []
    if definition.get("source") in df.columns:
        options.append(F.col(definition["source"]).cast("string"))
    if definition.get("extractor") and definition["extractor"][1] in df.columns:
        options.append(EXTRACTORS[definition["extractor"][0]](F.col(definition["extractor"][1])))
    if definition.get("fallback") in df.columns:
        options.append(F.col(definition["fallback"]).cast("string"))
    if definition.get("template") and all(f in df.columns for f in definition["template_fields"]):
        options.append(fill_template(definition["template"], definition["template_fields"]))
    return F.coalesce(*options) if options else F.lit(None).cast("string")


def resolve_entity(
    df: DataFrame, definition: Mapping, registry: DataFrame, spread: Sequence[str] = ("tx_id",)
) -> DataFrame:
    """One entity type as its definition says, with the configured registry columns added."""
    return lookup(
        df, registry, search_text(df, definition), definition["id"], spread, definition.get("output")
    )


def enabled_definitions(definitions: DataFrame) -> DataFrame:
    return definitions.where("enabled").orderBy("priority")


def resolve_entities(
    df: DataFrame,
    registries: Mapping[str, DataFrame],
    definitions: Sequence[Mapping] = tuple(DEFINITIONS),
    spread: Sequence[str] = ("tx_id",),
) -> DataFrame:
    """All entity types in order; a later text may come from an earlier result.

    Rows that are alike in the columns which texts come from are resolved once: the definitions run over the distinct
    combinations, and the rows are joined to what was found.
    """
    chosen = [d for d in definitions if d.get("enabled", True) and d["id"] in registries]
    used = {c for d in chosen for c in (d.get("source"), d.get("fallback"), d.get("extractor", (None, None))[1], *d.get("template_fields", []))}
    inputs = [c for c in df.columns if c in used]
    key = F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"}) if inputs else F.lit("")
    found = materialise(df.groupBy(*inputs).agg(F.count(F.lit(1)).alias("_all")).withColumn("_key", key), "inputs")
    made: list[str] = []
    for definition in chosen:
        found = resolve_entity(found, definition, registries[definition["id"]], ["_key"])
        made += [f"{definition['id']}_{c}" for c in ("text", "entity", "canonical", "match", "confidence", "resolved")]
        made += [c for c in definition.get("output") or {} if c not in made]
    found = materialise(found.select("_key", "_all", *made), "resolved")
    hot = hot_groups(found, ["_key"], rows="_all")
    rows = df.withColumn("_key", key).drop(*made)
    return spread_join(rows, found.drop("_all"), ["_key"], spread, hot).drop("_key")


def merchant_text_by_type(kind: Column, clean: Column, beneficiary: Column, hint: Column, rfc: Column) -> Column:
    """Which text names the merchant: tax id first, then by transaction type."""
    transfer = kind.startswith(TRANSFER_PREFIXES[0]) | kind.startswith(TRANSFER_PREFIXES[1])
    return (
        F.when(rfc.isNotNull(), rfc)
        .when(transfer, F.coalesce(clean, beneficiary))
        .when(kind.isin("domiciliacion", "card-purchase"), F.coalesce(hint, clean))
        .otherwise(clean)
    )


def resolve_merchant(df: DataFrame, registry: DataFrame, spread: Sequence[str] = ("tx_id",)) -> DataFrame:
    """Merchant of extracted rows; misses keep 30 % of their confidence and need review."""
    text = F.when(
        F.col("merchant_expected"),
        merchant_text_by_type(
            F.col("type"),
            F.col("clean_merchant"),
            F.col("beneficiary_name") if "beneficiary_name" in df.columns else F.lit(None).cast("string"),
            F.col("counterparty.hint"),
            F.col("counterparty.rfc"),
        ),
    )
    out = lookup(df, registry, text, "merchant", spread)
    factor = F.when(F.col("merchant_resolved"), F.col("merchant_confidence")).otherwise(MISS_FACTOR)
    asked = F.col("merchant_text").isNotNull()
    return out.withColumns(
        {
            "confidence": F.when(asked, F.col("confidence") * factor).otherwise(F.col("confidence")),
            "entity_resolved": F.col("merchant_resolved"),
            "needs_classification": asked & ~F.col("merchant_resolved"),
            "stage_4": F.struct(F.col("merchant_match").alias("match"), F.col("merchant_text").alias("text")),
        }
    )


def pending_queue(resolved: DataFrame, registry: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Texts that need a human, once each without regard to case, with their first row."""
    misses = resolved.where("needs_classification").withColumn("pending_key", squash(F.col("merchant_text")))
    counts = misses.groupBy("pending_key").agg(F.count(F.lit(1)).alias("seen"))
    firsts = first_per_key(misses, ["pending_key"], order)
    known = variation_rows(registry).select(F.col("name").alias("pending_key")).distinct()
    return firsts.join(known, "pending_key", "left_anti").join(counts, "pending_key")


def remove_resolved(pending: DataFrame, resolved_texts: DataFrame, text: str = "text") -> DataFrame:
    keys = resolved_texts.select(squash(F.col(text)).alias("pending_key")).distinct()
    return pending.join(keys, "pending_key", "left_anti")


def classify_pending(pending: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Human decisions (text, canonical_name, category): new registry rows, remaining queue."""
    keyed = decisions.withColumn("pending_key", squash(F.col("text")))
    hits = pending.select("pending_key").join(keyed, "pending_key")
    changes = hits.select(
        kebab(F.col("canonical_name")).alias("entity_id"),
        "canonical_name",
        "category",
        F.array(F.col("text")).alias("variations"),
    )
    return changes, remove_resolved(pending, decisions)


def add_variations(registry: DataFrame, additions: DataFrame) -> DataFrame:
    """Registry with the (entity_id, variation) rows merged in, each variation once."""
    old = registry.select("entity_id", F.explode("variations").alias("variation"))
    merged = (
        old.unionByName(additions.select("entity_id", "variation"))
        .distinct()
        .groupBy("entity_id")
        .agg(F.array_sort(F.collect_list("variation")).alias("_variations"))
    )
    kept = registry.join(merged, "entity_id", "left")
    return kept.withColumn("variations", F.coalesce("_variations", "variations")).drop("_variations")


def apply_changes(registry: DataFrame, changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Current registry from a base table and an append-only change table.

    Changes hold entity_id, seq, op (upsert or delete) and ``columns``; the latest change of an
    entity wins, and a null in an upsert keeps the former value.
    """
    base = registry.select("entity_id", F.lit(-1).cast("bigint").alias("seq"), F.lit("upsert").alias("op"), *columns)
    log = base.unionByName(changes.select("entity_id", F.col("seq").cast("bigint"), "op", *columns))
    folded = log.groupBy("entity_id").agg(
        F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("_deleted"),
        F.max("seq").alias("_last"),
        *[
            F.max(F.when(F.col(c).isNotNull(), F.struct(F.col("seq").alias("s"), F.col(c).alias("v")))).alias(f"_{c}")
            for c in columns
        ],
    )
    gone = F.coalesce("_deleted", F.lit(-2).cast("bigint"))
    return folded.where(F.col("_last") > gone).select(
        "entity_id", *[F.when(F.col(f"_{c}.s") > gone, F.col(f"_{c}.v")).alias(c) for c in columns]
    )


def enrich_registry(registry: DataFrame, enrichment: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill registry attributes from an enrichment table by entity_id."""
    extra = enrichment.select("entity_id", *[F.col(c).alias(f"_{c}") for c in columns])
    joined = registry.join(extra, "entity_id", "left")
    for c in columns:
        value = F.coalesce(F.col(f"_{c}"), F.col(c)) if c in registry.columns else F.col(f"_{c}")
        joined = joined.withColumn(c, value).drop(f"_{c}")
    return joined


def registry_stats(registry: DataFrame, by: str = "category") -> DataFrame:
    return registry.groupBy(by).agg(
        F.count(F.lit(1)).alias("entities"), F.sum(F.size("variations")).alias("variations")
    )


def find_by_alias(registry: DataFrame, alias: str) -> DataFrame:
    return registry.where(F.array_contains("variations", alias))


def alias_lookup(df: DataFrame, registry: DataFrame, raw: str, out: str, spread: Sequence[str] = ("tx_id",)) -> DataFrame:
    """Plain alias join: alias as written, alias without case, then canonical name without case."""
    names = registry.select("entity_id", F.explode("variations").alias("alias"))
    table = (
        names.select(F.col("alias").alias("k"), F.lit(0).alias("tier"), "entity_id")
        .unionByName(names.select(F.upper("alias").alias("k"), F.lit(1).alias("tier"), "entity_id"))
        .unionByName(registry.select(F.upper("canonical_name").alias("k"), F.lit(2).alias("tier"), "entity_id"))
    )
    best = table.groupBy("k").agg(
        F.min(F.when(F.col("tier") == 0, F.struct("tier", "entity_id"))).alias("as_written"),
        F.min(F.when(F.col("tier") > 0, F.struct("tier", "entity_id"))).alias("without_case"),
    )
    texts = df.where(F.col(raw).isNotNull()).groupBy(raw).agg(F.count(F.lit(1)).alias("_rows"))
    found = (
        texts.join(best.select(F.col("k").alias(raw), F.col("as_written.entity_id").alias("_a")), raw, "left")
        .withColumn("k", F.upper(raw))
        .join(best.select("k", F.col("without_case.entity_id").alias("_b")), "k", "left")
        .select(raw, "_rows", F.coalesce("_a", "_b").alias(out))
    )
    hot = hot_groups(found, [raw], rows="_rows")
    return spread_join(df, found.drop("_rows"), [raw], spread, hot)


def disambiguate(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """Merchant by the longest matching pattern, else a kebab id marked as fallback.

    Rules hold pattern, merchant_id, merchant_name, category and confidence; confidence is the
    product with the former stage, at least 0.50 for a rule to count.
    """
    from tallyloom.operators.classify import _pick, first_match

    usable = [r for r in rules if r["confidence"] >= 0.50]
    ordered = sorted(usable, key=lambda r: (-len(r["pattern"]), r["merchant_id"]))
    text = F.upper(F.col("clean_merchant"))
    at = F.col("_at")
    out = df.withColumn("_at", first_match([text.contains(r["pattern"].upper()) for r in ordered]))
    hit = at.isNotNull()
    name = F.col("clean_merchant")
    return out.withColumns(
        {
            "merchant_id": F.coalesce(_pick([r["merchant_id"] for r in ordered], at, "string"), kebab(name)),
            "merchant_name": F.coalesce(_pick([r["merchant_name"] for r in ordered], at, "string"), name),
            "merchant_category": _pick([r["category"] for r in ordered], at, "string"),
            "confidence": F.when(hit, F.col("confidence") * _pick([r["confidence"] for r in ordered], at, "double"))
            .otherwise(F.col("confidence") * 0.5),
            "fallback": name.isNotNull() & ~hit,
            "rule_matched": hit,
        }
    ).drop("_at")


def disambiguation_report(df: DataFrame) -> DataFrame:
    return df.groupBy("merchant_category", "fallback").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("confidence").alias("avg_confidence")
    )
