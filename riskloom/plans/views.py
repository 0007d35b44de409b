"""How the test tables stand in for transactions, identities and scores.

Every view exists twice: as a DataFrame for Spark and as a SQL text (``*_SQL``)
for the oracle, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalars import seconds_since

SPLIT_DATE = "2000-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def txn(spark: SparkSession, sf_dir: str, part: str | None = None) -> DataFrame:
    """Orders as transactions; ``part`` is None, "train" or "test"."""
    orders = table(spark, sf_dir, "orders")
    cut = F.to_timestamp_ntz(F.lit(f"{SPLIT_DATE} 00:00:00"))
    if part == "train":
        orders = orders.filter(F.col("o_orderdate") < cut)
    elif part == "test":
        orders = orders.filter(F.col("o_orderdate") >= cut)
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("key"),
        F.col("o_orderpriority").alias("product"),
        F.col("o_totalprice").alias("amt"),
        seconds_since("o_orderdate", "1995-01-01").alias("dt"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
    )


def _txn_sql(where: str = "") -> str:
    return f"""(SELECT o_orderkey AS id, o_custkey AS key, o_orderpriority AS product,
        o_totalprice AS amt, date_diff('second', TIMESTAMP '1995-01-01', o_orderdate) AS dt,
        CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders {where})"""


TXN_SQL = _txn_sql()
TRAIN_SQL = _txn_sql(f"WHERE o_orderdate < TIMESTAMP '{SPLIT_DATE}'")
TEST_SQL = _txn_sql(f"WHERE o_orderdate >= TIMESTAMP '{SPLIT_DATE}'")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a second transaction stream with a time of day."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("key"),
        F.col("event_type").alias("product"),
        F.col("value").alias("amt"),
        seconds_since("ts", "2024-01-01").alias("dt"),
        (F.col("event_type") == "error").cast("int").alias("y"),
    )


EV_SQL = """(SELECT event_id AS id, user_id AS key, event_type AS product, value AS amt,
    date_diff('second', TIMESTAMP '2024-01-01', ts) AS dt,
    CAST(event_type = 'error' AS INTEGER) AS y FROM events)"""


def doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their optional labels: the frame that has nulls."""
    from riskloom.operators.joins import merge_identity

    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return merge_identity(documents, table(spark, sf_dir, "labels"), "doc_id", "has_label")


DOC_SQL = """(SELECT d.doc_id, lang, source, n_chars, quality, toxic,
    CAST(l.doc_id IS NOT NULL AS INTEGER) AS has_label
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a numeric feature frame."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"),
        F.col("l_linenumber").alias("linenumber"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("disc"),
        F.col("l_tax").alias("tax"),
        F.col("l_linestatus").alias("status"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


LINE_SQL = """(SELECT l_orderkey AS orderkey, l_partkey AS partkey, l_suppkey AS suppkey,
    l_linenumber AS linenumber, l_quantity AS qty, l_extendedprice AS price,
    l_discount AS disc, l_tax AS tax, l_linestatus AS status,
    CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem)"""

LINE_FEATURES = ["qty", "price", "disc", "tax", "linenumber"]


def _probability(z: Column) -> Column:
    return F.round(1.0 / (1.0 + F.exp(-z)), 6)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a fixed, explainable score: the input of all metrics."""
    z = (F.col("qty") - 25.5) / 15.0 + 12.0 * (F.col("disc") - 0.05) - 10.0 * (F.col("tax") - 0.04)
    return line(spark, sf_dir).select(
        "orderkey", "linenumber", "y", _probability(z).alias("p"), F.col("price").alias("amount")
    )


SCORES_SQL = f"""(SELECT orderkey, linenumber, y,
    round(1.0 / (1.0 + exp(-((qty - 25.5) / 15.0 + 12.0 * (disc - 0.05) - 10.0 * (tax - 0.04)))), 6) AS p,
    price AS amount FROM {LINE_SQL})"""


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scorers in one long frame ``(model, y, p)``."""
    base = line(spark, sf_dir)
    forms = {
        "amount": (F.col("price") - 50000.0) / 30000.0,
        "discount": 40.0 * (F.col("disc") - 0.05),
        "quantity": (F.col("qty") - 25.5) / 10.0,
    }
    pairs = F.array(
        *[F.struct(F.lit(m).alias("model"), _probability(z).alias("p")) for m, z in forms.items()]
    )
    return base.select("y", F.explode(pairs).alias("m")).select("m.model", "y", "m.p")


MODEL_SCORES_SQL = f"""(
    SELECT 'amount' AS model, y, round(1.0/(1.0+exp(-((price-50000.0)/30000.0))), 6) AS p FROM {LINE_SQL}
    UNION ALL SELECT 'discount', y, round(1.0/(1.0+exp(-(40.0*(disc-0.05)))), 6) FROM {LINE_SQL}
    UNION ALL SELECT 'quantity', y, round(1.0/(1.0+exp(-((qty-25.5)/10.0))), 6) FROM {LINE_SQL})"""


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Presentation rounding, used only in the last select of a query."""
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column.cast("double"), digits)
