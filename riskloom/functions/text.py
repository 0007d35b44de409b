"""Text clean-up, device families, masks and field encryption."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import col, string_columns

# Fixed values: (words, label), the first match wins.
DEVICE_RULES = [
    (["chrome"], "Chrome"),
    (["safari"], "Safari"),
    (["firefox"], "Firefox"),
    (["opera"], "Opera"),
    (["edge"], "Edge"),
    (["ie", "internet explorer"], "IE"),
    (["windows"], "Windows"),
    (["ios", "iphone", "ipad"], "iOS"),
    (["android"], "Android"),
    (["mac"], "MacOS"),
    (["linux"], "Linux"),
]
BROWSER_RULES = [
    (["chrome"], "Chrome"),
    (["safari"], "Safari"),
    (["ie", "trident"], "IE"),
    (["firefox"], "Firefox"),
    (["edge"], "Edge"),
    (["opera"], "Opera"),
]
OS_RULES = [
    (["windows"], "Windows"),
    (["mac"], "macOS"),
    (["ios", "ipad", "iphone"], "iOS"),
    (["android"], "Android"),
    (["linux"], "Linux"),
]
# Texts that stand for a missing value.
MISSING_TEXTS = ["nan", "None", ""]
# Patterns of credentials in text.
SECRET_PATTERNS = {
    "assignment": r"(?i)(api_key|secret_key|password|aws_secret_access_key)\s*=\s*['\"][A-Za-z0-9/+=]{8,}['\"]",
    "bearer": r"(?i)bearer\s+[A-Za-z0-9\-\._~\+\/]+=*",
}


def _first_match(text: Column, rules: Sequence[tuple[list[str], str]], default: Column) -> Column:
    chain = F
    for words, label in rules:
        hit = text.contains(words[0])
        for w in words[1:]:
            hit = hit | text.contains(w)
        chain = chain.when(hit, F.lit(label))
    return chain.otherwise(default)


def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def normalize_device_os(c: Column | str) -> Column:
    """Canonical browser or system name; other values only lose extra blanks."""
    clean = squeeze(c)
    return F.when(clean.isNull(), None).otherwise(_first_match(F.lower(clean), DEVICE_RULES, clean))


def browser_family(c: Column | str) -> Column:
    return F.when(col(c).isNull(), "Unknown").otherwise(
        _first_match(F.lower(col(c)), BROWSER_RULES, F.lit("Other"))
    )


def os_family(c: Column | str) -> Column:
    return F.when(col(c).isNull(), "Unknown").otherwise(
        _first_match(F.lower(col(c)), OS_RULES, F.lit("Other"))
    )


def clean_categorical(c: Column | str) -> Column:
    v = col(c)
    return normalize_device_os(
        F.when(v.isNull() | v.isin(MISSING_TEXTS), F.lit("Missing")).otherwise(v)
    )


def clean_categorical_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({c: clean_categorical(c) for c in string_columns(df)})


def mask_email(c: Column | str) -> Column:
    v = col(c)
    user = F.element_at(F.split(v, "@"), 1)
    domain = F.try_element_at(F.split(v, "@"), F.lit(2))
    shown = F.when(F.length(user) > 1, F.concat(F.substring(user, 1, 1), F.lit("***"))).otherwise("***")
    return F.when(v.isNull() | ~v.contains("@"), "***").otherwise(F.concat(shown, F.lit("@"), domain))


def mask_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: mask_email(F.col(c).cast("string")) for c in columns if c in df.columns})


def mask_secret(c: Column | str) -> Column:
    v = col(c)
    n = F.length(v)
    middle = F.repeat(F.lit("*"), n - 4)
    return F.when(n <= 4, "****").otherwise(
        F.concat(F.substring(v, 1, 2), middle, F.substring(v, -2, 2))
    )


def encrypt(c: Column | str, key: Column) -> Column:
    """AES-GCM with a random nonce, as base64 text; empty stays empty."""
    v = col(c)
    return F.when(v == "", "").otherwise(F.base64(F.aes_encrypt(v, key, F.lit("GCM"))))


def decrypt(c: Column | str, key: Column) -> Column:
    v = col(c)
    return F.when(v == "", "").otherwise(
        F.aes_decrypt(F.unbase64(v), key, F.lit("GCM")).cast("string")
    )


def scan_secrets(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row per credential found in the whole text, with its masked form."""
    found = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("hits"),
            )
            for kind, pattern in SECRET_PATTERNS.items()
        ]
    )
    return (
        df.select(id_col, F.explode(found).alias("f"))
        .select(id_col, F.col("f.kind").alias("kind"), F.posexplode("f.hits").alias("pos", "hit"))
        .select(id_col, "kind", "pos", mask_secret("hit").alias("masked"))
    )
