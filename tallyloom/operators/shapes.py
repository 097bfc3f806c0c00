"""Validation of nested rows against a closed shape.

A shape names what each place of a row must hold. The walker turns it, with the row's type, into one expression that lists every problem with its path: what is missing, what is of another type, what
breaks a bound or pattern, and what the shape does not know, at any depth of records, lists and maps. It is a projection: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.predicates import full_match

PROBLEMS = "array<struct<path:string,message:string>>"


@dataclass(frozen=True)
class Shape:
    """``kind``: text, number, whole, flag, record, list or map. ``fields`` of a record, ``item`` of a list or of a map's values.

    ``low`` and ``high`` bound a number, or the length of a text, list or map. A record that is not ``closed`` may hold other fields.
    """

    kind: str
    optional: bool = False
    pattern: str | None = None
    one_of: tuple = ()
    low: float | None = None
    high: float | None = None
    fields: Mapping[str, Shape] = field(default_factory=dict)
    item: Shape | None = None
    closed: bool = True
    error: str | None = None


def text(**kw) -> Shape:
    return Shape("text", **kw)


def record(optional: bool = False, closed: bool = True, error: str | None = None, **fields: Shape) -> Shape:
    return Shape("record", optional=optional, closed=closed, error=error, fields=fields)


# The shape of a transaction.
_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_DAY = text(pattern=r"\d{4}-\d{2}-\d{2}", error="Date must be in YYYY-MM-DD format")
_TEXT = text(low=1, error="String must not be empty")
_MAYBE = text(low=1, optional=True, error="String must not be empty")
_SURE = Shape("number", low=0.0, high=1.0, error="Confidence must be between 0.0 and 1.0")
TRANSACTION = record(
    id=text(pattern=_UUID, error="Must be a valid UUID"),
    date=_DAY,
    amount=Shape("number", low=0.01, error="Number must be positive"),
    description=_TEXT,
    type=text(one_of=("income", "expense", "transfer", "credit-payment"), error="Invalid transaction type"),
    merchant=record(optional=True, canonical_name=_TEXT, confidence=_SURE, extracted_from=_MAYBE),
    category=record(optional=True, name=_TEXT, confidence=_SURE, rule_id=_MAYBE),
    provenance=record(source_file=_TEXT, source_line=Shape("whole", optional=True), imported_at=_DAY, imported_by=_MAYBE, parser_version=_MAYBE),
    currency=text(pattern="[A-Z]{3}", optional=True),
    account_id=text(pattern=_UUID, optional=True, error="Must be a valid UUID"),
    notes=text(optional=True),
)

_KINDS = {"text": T.StringType, "number": T.NumericType, "whole": T.IntegralType, "flag": T.BooleanType, "list": T.ArrayType, "map": T.MapType}


def _problem(path: Column, message: str) -> Column:
    return F.struct(path.alias("path"), F.lit(message).alias("message"))


def _when(test: Column, path: Column, message: str) -> Column:
    """One problem or none."""
    return F.when(test, F.array(_problem(path, message))).otherwise(F.array().cast(PROBLEMS))


def _under(path: Column, name: str, top: bool) -> Column:
    return F.lit(name) if top else F.concat(path, F.lit(f".{name}"))


def _bounds(value: Column, size: Column, shape: Shape) -> Column | None:
    tests = []
    if shape.low is not None:
        tests.append(size < F.lit(shape.low))
    if shape.high is not None:
        tests.append(size > F.lit(shape.high))
    if shape.pattern is not None:
        tests.append(~full_match(value, shape.pattern))
    if shape.one_of:
        tests.append(~value.isin(*shape.one_of))
    out = None
    for test in tests:
        out = test if out is None else out | test
    return out


def _record(value: Column, kind: T.DataType, shape: Shape, path: Column, top: bool) -> Column:
    parts = []
    if isinstance(kind, T.MapType):
        held = {n: (value[n], kind.valueType) for n in shape.fields}
        extra = F.filter(F.map_keys(value), lambda k: ~k.isin(*shape.fields) if shape.fields else F.lit(True))
        if shape.closed:
            start = F.lit("") if top else F.concat(path, F.lit("."))
            parts.append(F.transform(F.array_sort(extra), lambda k: F.struct(F.concat(start, k).alias("path"), F.lit("is not allowed").alias("message"))))
    else:
        types = {f.name: f.dataType for f in kind.fields}
        held = {n: (value[n], types[n]) for n in shape.fields if n in types}
        if shape.closed:
            parts += [_when(value[n].isNotNull(), _under(path, n, top), "is not allowed") for n in types if n not in shape.fields]
    for name, inner in shape.fields.items():
        at = _under(path, name, top)
        if name in held:
            parts.append(_walk(*held[name], inner, at))
        elif not inner.optional:
            parts.append(F.array(_problem(at, "is missing")))
    return F.concat(*parts) if parts else F.array().cast(PROBLEMS)


def _walk(value: Column, kind: T.DataType, shape: Shape, path: Column, top: bool = False) -> Column:
    none = F.array().cast(PROBLEMS)
    absent = none if shape.optional else F.array(_problem(path, "is missing"))
    if shape.kind == "record":
        if not isinstance(kind, T.StructType) and not (isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType)):
            return F.when(value.isNull(), absent).otherwise(F.array(_problem(path, shape.error or "must be a record")))
        return F.when(value.isNull(), absent).otherwise(_record(value, kind, shape, path, top))
    if not isinstance(kind, _KINDS[shape.kind]):
        return F.when(value.isNull(), absent).otherwise(F.array(_problem(path, f"must be a {shape.kind}")))
    if shape.kind in ("list", "map"):
        broken = _bounds(value, F.size(value), shape)
        found = none if broken is None else _when(broken, path, shape.error or "is out of bounds")
        if shape.item is not None and shape.kind == "list":
            inner = F.transform(value, lambda x, i: _walk(x, kind.elementType, shape.item, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            found = F.concat(found, F.flatten(inner))
        if shape.item is not None and shape.kind == "map":
            entries = F.array_sort(F.map_entries(value)) if not isinstance(kind.valueType, T.MapType) else F.map_entries(value)
            inner = F.transform(entries, lambda e: _walk(e["value"], kind.valueType, shape.item, F.concat(path, F.lit("."), e["key"].cast("string"))))
            found = F.concat(found, F.flatten(inner))
        return F.when(value.isNull(), absent).otherwise(found)
    broken = _bounds(value, F.length(value) if shape.kind == "text" else value, shape)
    found = none if broken is None else _when(broken, path, shape.error or "is out of bounds")
    return F.when(value.isNull(), absent).otherwise(found)


def conform(df: DataFrame, shape: Shape = TRANSACTION, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``problems`` (path and message of each, in the order of the shape, unknown places first) and ``valid``.

    A null counts as absent, so an unknown column is reported on the rows where it holds something. Columns in ``ignore`` are not looked at, and neither are older columns of the two names.
    """
    seen = [f for f in df.schema.fields if f.name not in (*ignore, "problems", "valid")]
    whole = F.struct(*[F.col(f"`{f.name}`").alias(f.name) for f in seen]) if seen else F.struct(F.lit(None).alias("_"))
    kind = T.StructType(seen) if seen else T.StructType([T.StructField("_", T.NullType())])
    checked = df.withColumn("problems", _record(whole, kind, shape, F.lit(""), True))
    return checked.withColumn("valid", F.size("problems") == 0)


def conform_json(df: DataFrame, column: str, schema: str, shape: Shape = TRANSACTION) -> DataFrame:
    """As ``conform`` for JSON text: keys that ``schema`` does not have are found at the top as well. A text that is no JSON object has one problem."""
    keys = F.json_object_keys(column)
    known = list(shape.fields)
    parsed = F.from_json(column, schema)
    kind = T.StructType.fromDDL(schema)
    extra = F.transform(F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in known]))), lambda k: F.struct(k.alias("path"), F.lit("is not allowed").alias("message")))
    found = F.concat(extra if shape.closed else F.array().cast(PROBLEMS), _record(parsed, kind, shape, F.lit(""), True))
    checked = df.withColumn("problems", F.when(keys.isNull(), F.array(_problem(F.lit(""), "is no record"))).otherwise(found))
    return checked.withColumn("valid", F.size("problems") == 0)


def problem_counts(checked: DataFrame) -> DataFrame:
    """Rows by path and message; positions in lists count as one place."""
    each = checked.select(F.explode("problems").alias("p"))
    return each.groupBy(F.regexp_replace("p.path", r"\[\d+\]", "[]").alias("path"), F.col("p.message").alias("message")).agg(F.count(F.lit(1)).alias("rows"))
