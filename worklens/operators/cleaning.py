"""Standard forms of the four extracts: renaming, typing, and normalised names with keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.functions import text as T

#: Headers of the extracts and the columns they become.
HEADERS = {
    "recommendations": {"Work ID": "work_id", "Work Description": "work_description", "Category": "category", "MP Name": "mp_name", "Constituency": "constituency", "State": "state", "House": "house", "Recommended Amount (₹)": "recommended_amount", "Recommendation Date": "recommendation_date", "IDA": "ida"},
    "completions": {"Work ID": "work_id", "Work Description": "work_description", "Category": "category", "MP Name": "mp_name", "Constituency": "constituency", "State": "state", "House": "house", "Final Amount (₹)": "final_amount", "Completed Date": "completed_date", "IDA": "ida", "Has Images": "has_images"},
    "expenditures": {"MP Name": "mp_name", "Constituency": "constituency", "State": "state", "House": "house", "Work Description": "work_description", "Vendor": "vendor_name", "IDA": "ida", "Expenditure Amount (₹)": "amount_paid", "Expenditure Date": "expenditure_date", "Payment Status": "payment_status"},
    "mp_summary": {"MP Name": "mp_name", "Constituency": "constituency", "State": "state", "House": "house", "Allocated Amount (₹)": "allocated_amount", "Total Expenditure (₹)": "total_expenditure", "Unspent Amount (₹)": "unspent_amount", "Utilization %": "utilization_pct", "Completed Works": "completed_works", "Recommended Works": "recommended_works", "Completion Rate %": "completion_rate_pct", "Transaction Count": "transaction_count", "Successful Payments": "successful_payments", "Pending Payments": "pending_payments"},
}
MONEY = {"recommended_amount", "final_amount", "amount_paid", "allocated_amount", "total_expenditure", "unspent_amount"}
DATES = {"recommendation_date", "completed_date", "expenditure_date"}
NUMBERS = {"utilization_pct": "double", "completion_rate_pct": "double", "completed_works": "bigint", "recommended_works": "bigint", "transaction_count": "bigint", "successful_payments": "bigint", "pending_payments": "bigint"}
#: Columns that get normalised forms, and the stem of those.
NORMALISED = {"mp_name": "mp", "constituency": "constituency", "state": "state", "house": "house", "ida": "ida", "vendor_name": "vendor", "category": "category", "work_description": "work", "work_id": "work_id"}


def renamed(df: DataFrame, kind: str) -> DataFrame:
    """Stripped headers, then the standard names; other columns pass through, missing ones are tolerated."""
    df = df.toDF(*(c.strip() for c in df.columns))
    return df.withColumnsRenamed({a: b for a, b in HEADERS[kind].items() if a in df.columns})


def typed(df: DataFrame) -> DataFrame:
    """Money, dates and counts as numbers and timestamps (null where unreadable), "True" and "False" as
    booleans, standard texts trimmed and never null."""
    plan = {}
    texts = {c for names in HEADERS.values() for c in names.values()} - MONEY - DATES - NUMBERS.keys() - {"has_images"}
    for c in df.columns:
        if c in MONEY:
            plan[c] = T.money(F.col(c))
        elif c in DATES:
            plan[c] = T.date(F.col(c))
        elif c in NUMBERS:
            plan[c] = F.col(c).try_cast("double").try_cast(NUMBERS[c])
        elif c == "has_images":
            plan[c] = F.when(F.col(c).cast("string").isin("True", "true"), True).when(F.col(c).cast("string").isin("False", "false"), False)
        elif c in texts:
            plan[c] = T.trimmed(F.col(c))
    return df.withColumns(plan)


def normalised(df: DataFrame) -> DataFrame:
    """Adds <stem>_norm and <stem>_norm_key for the columns that are there, canonical member and
    constituency names with keys, and work_id_key."""
    have = {c: stem for c, stem in NORMALISED.items() if c in df.columns}
    df = df.withColumns({f"{stem}_norm": T.normalize_text(F.col(c)) for c, stem in have.items()})
    extra = {f"{stem}_norm_key": T.key_of(F.col(f"{stem}_norm")) for stem in have.values()}
    if "mp_name" in have:
        extra["mp_canonical"] = T.canonical_member(F.col("mp_norm"))
        extra["mp_canonical_key"] = T.key_of(extra["mp_canonical"])
    if "constituency" in have:
        extra["constituency_canonical"] = T.canonical_constituency(F.col("constituency_norm"))
        extra["constituency_canonical_key"] = T.key_of(extra["constituency_canonical"])
    if "work_id" in have:
        extra["work_id_key"] = T.key_of(F.col("work_id_norm"))
    return df.withColumns(extra)


def standardised(df: DataFrame, kind: str) -> DataFrame:
    """The standard form of an extract of the given kind. Summaries keep their names as they are."""
    df = typed(renamed(df, kind))
    return df if kind == "mp_summary" else normalised(df)
