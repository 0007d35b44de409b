"""Column families by name, and explicit schemas of the wide tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import types as T

# Fixed values: (pattern, family) rule sets; the first match wins.
DICTIONARY_RULES = [
    (r"isFraud", "Target"),
    (r"TransactionID", "Identifier"),
    (r"TransactionDT", "Time Delta (D)"),
    (r"TransactionAmt", "Numeric"),
    (r"ProductCD", "Categorical"),
    (r"has_identity", "Boolean"),
    (r"card.*", "Card"),
    (r"addr.*", "Address"),
    (r"(?i:.*emaildomain.*)", "Email"),
    (r"C\d+", "Count (C)"),
    (r"D\d+", "Time Delta (D)"),
    (r"M\d+", "Categorical"),
    (r"V\d+", "Anonymous (V)"),
    (r"id_\d+(_.*)?", "Identity"),
    (r"DeviceInfo|DeviceType", "Device"),
]
MISSING_RULES = [
    (r"card.*", "Card"),
    (r"addr.*", "Address"),
    (r"dist.*", "Distance"),
    (r"(?i:.*emaildomain.*)", "Email"),
    (r"DeviceInfo|DeviceType|device.*", "Device"),
    (r"id_.*", "Identity"),
    (r"C\d+", "C Features"),
    (r"D\d+", "D Features"),
    (r"M\d+", "M Features"),
    (r"V\d+", "V Features"),
]

#: Names of our test columns, so the same rules can be tried on them.
TEST_RULES = [
    (r"id|.*_id|orderkey|partkey|suppkey", "Identifier"),
    (r"y|quality|toxic", "Target"),
    (r"dt", "Time Delta (D)"),
    (r"amt|price|qty|disc|tax", "Numeric"),
    (r"has_.*", "Boolean"),
]


def column_family(name: str, rules: Sequence[tuple[str, str]], default: str) -> str:
    for pattern, family in rules:
        if re.fullmatch(pattern, name):
            return family
    return default


def dictionary_family(field: T.StructField, rules: Sequence[tuple[str, str]] = DICTIONARY_RULES) -> str:
    numeric = isinstance(field.dataType, T.NumericType)
    return column_family(field.name, rules, "Numeric" if numeric else "Categorical")


def missing_family(name: str) -> str:
    return column_family(name, MISSING_RULES, "Transaction")


def transaction_schema(extra_v: int = 339) -> T.StructType:
    """Schema of the raw transaction table."""
    fields = [
        T.StructField("TransactionID", T.LongType(), False),
        T.StructField("isFraud", T.IntegerType()),
        T.StructField("TransactionDT", T.LongType()),
        T.StructField("TransactionAmt", T.DoubleType()),
        T.StructField("ProductCD", T.StringType()),
    ]
    text = {"card4", "card6", "P_emaildomain", "R_emaildomain"}
    names = [f"card{i}" for i in range(1, 7)] + ["addr1", "addr2", "dist1", "dist2", "P_emaildomain", "R_emaildomain"]
    names += [f"C{i}" for i in range(1, 15)] + [f"D{i}" for i in range(1, 16)]
    fields += [T.StructField(n, T.StringType() if n in text else T.DoubleType()) for n in names]
    fields += [T.StructField(f"M{i}", T.StringType()) for i in range(1, 10)]
    fields += [T.StructField(f"V{i}", T.DoubleType()) for i in range(1, extra_v + 1)]
    return T.StructType(fields)


def identity_schema() -> T.StructType:
    """Schema of the identity side table: ids 1 to 11 are numbers, the rest text."""
    ids = [
        T.StructField(f"id_{i:02d}", T.DoubleType() if i <= 11 else T.StringType()) for i in range(1, 39)
    ]
    return T.StructType(
        [T.StructField("TransactionID", T.LongType(), False), *ids]
        + [T.StructField(c, T.StringType()) for c in ("DeviceType", "DeviceInfo")]
    )
