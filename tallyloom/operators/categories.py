"""Budget, accounting, tax and payment dimensions of a resolved transaction.

The dimension tables are short fixed lists, so they are compiled into the projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.summaries import counts_by

# Accounting side of each flow code (category, subcategory, debit or credit).
ACCOUNTING = {
    "GASTO": ("Expenses", "Operating Expenses", "Debit"),
    "INGRESO": ("Revenue", "Operating Income", "Credit"),
    "PAGO_TARJETA": ("Liabilities", "Credit Card Payment", "Debit"),
    "TRASPASO": ("Equity", "Owner Transfer", "Both"),
    "RETIRO": ("Cash", "Cash Withdrawal", "Debit"),
    "DEPOSITO": ("Cash", "Cash Deposit", "Credit"),
    "COMISION": ("Expenses", "Bank Fees", "Debit"),
    "INTERES": ("Revenue", "Interest Income", "Credit"),
    "AJUSTE": ("Equity", "Adjustment", "Both"),
}
ACCOUNTING_DEFAULT = ("Unknown", "Uncategorized", "Unknown")
MEDICAL_CODES = [8011, 5912]
FLOW_OF_DIRECTION = {"expense": "GASTO", "income": "INGRESO", "transfer": "TRASPASO"}
UNKNOWN_FLOW = "DESCONOCIDO"

# Payment method by flow code (method, network).
PAYMENT_BY_FLOW = {
    "RETIRO": ("Cash", "ATM"),
    "TRASPASO": ("Bank Transfer", "Internal"),
    "PAGO_TARJETA": ("Bank Transfer", "Credit Card Payment"),
}


def flow_of(direction: Column) -> Column:
    found = F.coalesce(*[F.when(direction == d, F.lit(code)) for d, code in FLOW_OF_DIRECTION.items()])
    return F.coalesce(found, F.lit(UNKNOWN_FLOW))


def accounting(flow: Column) -> Column:
    names = ["account_category", "account_subcategory", "debit_credit"]
    triple = lambda v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, names)])
    return F.coalesce(*[F.when(flow == k, triple(v)) for k, v in ACCOUNTING.items()], triple(ACCOUNTING_DEFAULT))


def _optional(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name).cast(dtype) if name in df.columns else F.lit(None).cast(dtype)


def budget(df: DataFrame) -> Column:
    """Category entity first, then the merchant code, else unknown."""
    by_entity = F.struct(
        _optional(df, "category_canonical").alias("merchant_category"),
        _optional(df, "budget_category").alias("budget_category"),
        _optional(df, "budget_subcategory").alias("budget_subcategory"),
        F.coalesce(_optional(df, "category_confidence", "double"), F.lit(0.95)).alias("confidence"),
    )
    by_code = F.struct(
        _optional(df, "mcc_name").alias("merchant_category"),
        _optional(df, "mcc_budget_category").alias("budget_category"),
        _optional(df, "mcc_budget_subcategory").alias("budget_subcategory"),
        F.lit(0.90).alias("confidence"),
    )
    unknown = F.struct(
        F.lit("Unknown").alias("merchant_category"),
        F.lit("Uncategorized").alias("budget_category"),
        F.lit("Other").alias("budget_subcategory"),
        F.lit(0.30).alias("confidence"),
    )
    return F.coalesce(
        F.when(_optional(df, "category_entity").isNotNull(), by_entity),
        F.when(_optional(df, "mcc_name").isNotNull(), by_code),
        unknown,
    )


def _tax(name: str, business: Column | bool, personal: Column | bool, sat, irs: str, deductible: bool, conf: float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(name).alias("tax_category"),
        as_col(business).alias("business_deductible"),
        as_col(personal).alias("personal_deductible"),
        as_col(sat).alias("sat_category"),
        F.lit(irs).alias("irs_category"),
        F.lit(deductible).alias("deductible"),
        F.lit(conf).alias("confidence"),
    )


def tax(df: DataFrame, flow: Column, merchant_budget: Column) -> Column:
    """Seven ordered cases; the labels are fixed values."""
    hint = lambda name, default: F.coalesce(_optional(df, name), F.lit(default))
    flag = lambda name: F.coalesce(_optional(df, name, "boolean"), F.lit(False))
    code = _optional(df, "mcc", "int")
    medical = F.coalesce((merchant_budget == "Healthcare") | code.isin(MEDICAL_CODES), F.lit(False))
    none = F.lit(None).cast("boolean")
    return (
        F.when(
            flow == "INGRESO",
            _tax("Taxable Income", none, none, hint("sat_hint", "Ingresos por Servicios"),
                 "Business Income - 1099", False, 1.0),
        )
        .when(
            (flow == "GASTO") & flag("business_hint"),
            _tax("Business Deductible", True, flag("personal_hint"), hint("sat_hint", "Gastos Generales"),
                 "Business Expense", True, 0.9),
        )
        .when(
            (flow == "GASTO") & medical,
            _tax("Medical Deductible", False, True, "Gastos Médicos",
                 "Medical Expense (subject to AGI threshold)", True, 0.95),
        )
        .when(
            flow.isin("COMISION", "INTERES"),
            _tax("Bank Charges", True, False, "Gastos Financieros", "Business Interest/Fees", True, 0.85),
        )
        .when(
            flow == "PAGO_TARJETA",
            _tax("Non-Deductible", False, False, "Pago de Pasivos", "Debt Payment", False, 1.0),
        )
        .when(
            flow == "TRASPASO",
            _tax("Non-Deductible", False, False, "Movimiento de Capital", "Capital Transfer", False, 1.0),
        )
        .otherwise(
            _tax("Non-Deductible", False, False, "Gastos No Deducibles", "Personal Expense", False, 0.7)
        )
    )


def payment(df: DataFrame, flow: Column) -> Column:
    """Account first, then bank, then flow code."""
    made = lambda m, n, c: F.struct(m.alias("method"), n.alias("network"), c.alias("confidence"))
    account = F.when(
        _optional(df, "account_entity").isNotNull(),
        made(
            _optional(df, "payment_method"),
            _optional(df, "payment_network"),
            F.coalesce(_optional(df, "account_confidence", "double"), F.lit(0.95)),
        ),
    )
    bank = F.when(
        _optional(df, "bank_entity").isNotNull(),
        made(
            _optional(df, "default_payment_method"),
            _optional(df, "bank_canonical"),
            F.coalesce(_optional(df, "bank_confidence", "double"), F.lit(0.80)),
        ),
    )
    by_flow = [
        F.when(flow == k, made(F.lit(m), F.lit(n), F.lit(0.70))) for k, (m, n) in PAYMENT_BY_FLOW.items()
    ]
    return F.coalesce(account, bank, *by_flow, made(F.lit("Unknown"), F.lit("Unknown"), F.lit(0.30)))


def with_mcc(df: DataFrame, codes: DataFrame) -> DataFrame:
    """Merchant-code attributes; the code table is a short published list joined by equality."""
    table = codes.select(
        F.col("code").alias("mcc"),
        F.col("name").alias("mcc_name"),
        F.col("budget_category").alias("mcc_budget_category"),
        F.col("budget_subcategory").alias("mcc_budget_subcategory"),
    )
    return df.join(table, "mcc", "left")


def categorise(df: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """All dimensions and the mean of their three confidences."""
    if codes is not None and "mcc" in df.columns:
        df = with_mcc(df, codes)
    if "flow_type" not in df.columns:
        df = df.withColumn("flow_type", flow_of(F.col("direction")))
    flow = F.col("flow_type")
    merchant_budget = _optional(df, "merchant_budget_category")
    work = df.withColumns(
        {
            "_acc": accounting(flow),
            "_bud": budget(df),
            "_tax": tax(df, flow, merchant_budget),
            "_pay": payment(df, flow),
        }
    )
    mean = (F.col("_bud.confidence") + F.col("_tax.confidence") + F.col("_pay.confidence")) / 3.0
    return work.withColumns(
        {
            "account_category": F.col("_acc.account_category"),
            "account_subcategory": F.col("_acc.account_subcategory"),
            "debit_credit": F.col("_acc.debit_credit"),
            "merchant_category": F.col("_bud.merchant_category"),
            "budget_category": F.col("_bud.budget_category"),
            "budget_subcategory": F.col("_bud.budget_subcategory"),
            "tax_category": F.col("_tax.tax_category"),
            "business_deductible": F.col("_tax.business_deductible"),
            "personal_deductible": F.col("_tax.personal_deductible"),
            "sat_category": F.col("_tax.sat_category"),
            "irs_category": F.col("_tax.irs_category"),
            "deductible": F.col("_tax.deductible"),
            "payment_method": F.col("_pay.method"),
            "payment_network": F.col("_pay.network"),
            "dimension_confidence": mean,
        }
    ).drop("_acc", "_bud", "_tax", "_pay")


def category_counts(df: DataFrame) -> DataFrame:
    return counts_by(df, ["budget_category", "tax_category", "payment_method", "account_category"])


def category_stats(df: DataFrame) -> DataFrame:
    done = F.col("budget_category").isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(done).alias("resolved"),
        (F.count_if(done) / F.count(F.lit(1))).alias("rate"),
        F.avg("dimension_confidence").alias("avg_confidence"),
    )



__all__: Sequence[str] = [
    "accounting", "budget", "categorise", "category_counts", "category_stats", "flow_of", "payment", "tax", "with_mcc",
]
