"""Statement text: ordered lines into records of a transaction line and its context lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.normalise import parse_money
from tallyloom.functions.skew import Running, running

# How statement lines look and which lines are headers or footers.
RECORD_START = r"^\d{1,2}\s+[A-Z]{3}\s+"
RECORD_LINE = r"^(\d{1,2})\s+([A-Z]{3})\s+(.+?)\s+\$([\d,]+\.\d{2})\s+\$[\d,]+\.\d{2}$"
MAX_CONTEXT = 10
FOOTER_PHRASES = [
    "SCOTIABANK", "ESTADO DE CUENTA", "PERIODO", "FECHA DE CORTE", "SALDO",
    "LAS TASAS DE INTERES", "TERMINOS ANUALES", "EN EL CASO DE ENVIO DE TRANSFERENCIAS",
    "NOMBRE DEL BENEFICIARIO ES UN DATO NO CERTIFICADO", "COMISIONES APLICADAS", "COMISION POR",
    "ABREVIATURAS", "ABR.", "PARA MAYOR INFORMACION", "PARA MAS INFORMACION", "TELEFONO",
    "CONSULTE", "WWW.", "HTTP", "ADVERTENCIAS", "AVISO", "CONSULTA TU ESTADO DE CUENTA",
    "PRIVACIDAD", "DATOS PERSONALES", "PROTECCION DE DATOS",
]
INSTITUTION_WORDS = [
    "SANTANDER", "AZTECA", "BANAMEX", "WISE", "PAYMENTS", "LIMITED", "TRANSF", "INTERBANCARIA",
    "SPEI", "FECHA", "ABONO", "RFC", "CURP", "FOLIO", "REFERENCIA", "PAYMENT", "ORIGEN",
]
WITHDRAWAL_WORDS = ["RETIRO", "CARGO"]
DEPOSIT_WORDS = ["DEPOSITO", "ABONO", "TRANSF"]
NAME_BONUS = {4: 10, 3: 8, 2: 5}


def _any_contains(col: Column, words: Sequence[str]) -> Column:
    test = F.lit(False)
    for word in words:
        test = test | col.contains(word)
    return test


def relevant_context(text: Column) -> Column:
    """Whether a line says something about its transaction, and is no header, footer or rule."""
    line, upper = F.trim(text), F.upper(F.trim(text))
    return (
        (F.length(line) > 2)
        & line.rlike("[A-Za-z0-9]")
        & ~line.rlike(r"^\d+$")
        & ~upper.rlike(r"^PÁGINA\s+\d+$")
        & ~upper.startswith("FECHA")
        & ~_any_contains(upper, FOOTER_PHRASES)
    )


def segment_lines(
    lines: DataFrame, start_pattern: str = RECORD_START, max_context: int = MAX_CONTEXT
) -> DataFrame:
    """One row per record: file, first line number, main line, its relevant lines (``all_lines``) and the first ``max_context`` of them.

    Lines before the first record of a file belong to none.
    """
    marked = lines.select("file", "line_no", "text", F.col("text").rlike(start_pattern).alias("_start"))
    owned = running(
        marked, ["file"], ["line_no"],
        [Running("record_line", "max", F.when(F.col("_start"), F.col("line_no")))],
    )
    useful = owned.where(
        F.col("record_line").isNotNull() & (F.col("_start") | relevant_context(F.col("text")))
    )
    context = F.collect_list(F.when(~F.col("_start"), F.struct("line_no", "text")))
    records = useful.groupBy("file", "record_line").agg(
        F.max(F.when(F.col("_start"), F.col("text"))).alias("main_line"),
        F.array_sort(context).alias("_lines"),
    )
    texts = F.transform("_lines", lambda x: x["text"])
    return records.select(
        "file", "record_line", "main_line", F.slice(texts, 1, max_context).alias("context_lines"), texts.alias("all_lines")
    )


def direction_of(line: Column) -> Column:
    """Withdrawal or deposit by keyword, withdrawal if unclear."""
    return (
        F.when(_any_contains(line, WITHDRAWAL_WORDS), "retiro")
        .when(_any_contains(line, DEPOSIT_WORDS), "deposit")
        .otherwise("retiro")
    )


def _clean_spaces(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def beneficiary(context: Column) -> Column:
    """Name after "TRANSFERENCIA A", if such a line exists; else the best all-capitals name line."""
    transfers = F.filter(context, lambda x: x.contains("TRANSFERENCIA A"))
    named = F.regexp_replace(F.get(transfers, F.lit(0)), r".*TRANSFERENCIA A\s+", "")
    named = _clean_spaces(F.regexp_replace(named, r"/.*", ""))
    named = F.when((F.length(named) > 3) & named.rlike(r"^[A-Z\s]+$"), named)

    def words(line: Column) -> Column:
        return F.size(F.split(line, " "))

    lines = F.transform(context, _clean_spaces)
    people = F.filter(
        lines,
        lambda x: x.rlike(r"^[A-Z\s]+$")
        & (F.length(x) > 5)
        & (F.length(x) < 50)
        & words(x).between(2, 5)
        & ~_any_contains(x, INSTITUTION_WORDS),
    )

    def bonus(line: Column) -> Column:
        points = F.lit(0)
        for n, extra in NAME_BONUS.items():
            points = F.when(words(line) == n, extra).otherwise(points)
        return points

    # Ties go to the earlier line, hence the negated place.
    scored = F.transform(people, lambda x, i: F.struct((F.length(x) + bonus(x)).alias("s"), (-i).alias("i"), x.alias("n")))
    return F.when(F.size(transfers) > 0, named).otherwise(F.array_max(scored)["n"])


def tax_id_line(context: Column) -> Column:
    found = F.get(F.filter(context, lambda x: x.contains("RFC/CURP:")), F.lit(0))
    return F.trim(F.regexp_replace(found, r".*RFC/CURP:\s*", ""))


def reference_lines(context: Column) -> Column:
    refs = F.filter(context, lambda x: x.contains("REFERENCIA:") | x.contains("FOLIO:"))
    return F.when(F.size(refs) > 0, F.array_join(F.transform(refs, lambda x: F.trim(x)), " | "))


def parse_records(records: DataFrame) -> DataFrame:
    """Records as statement rows; main lines without the two amounts are left out. Fields are read from all context lines."""
    line = F.col("main_line")
    context = F.col("all_lines" if "all_lines" in records.columns else "context_lines")
    part = lambda i: F.regexp_extract(line, RECORD_LINE, i)
    amount = parse_money(part(4))
    side = direction_of(line)
    return records.where(line.rlike(RECORD_LINE)).select(
        "file",
        "record_line",
        F.concat_ws("-", part(1), part(2)).alias("date"),
        F.trim(part(3)).alias("description"),
        amount.alias("amount"),
        F.when(side == "retiro", amount).alias("retiro"),
        F.when(side == "deposit", amount).alias("deposit"),
        beneficiary(context).alias("beneficiary_name"),
        tax_id_line(context).alias("rfc"),
        reference_lines(context).alias("reference"),
        "context_lines",
        (F.size("context_lines") > 0).alias("has_context"),
    )


def segment_statement_lines(lines: DataFrame) -> DataFrame:
    return parse_records(segment_lines(lines))
