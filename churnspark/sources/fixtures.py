"""Analysis views derived from the base tables.

These are the customer tables the churn operators run on. Each is a lazy
DataFrame over the Parquet scans, so its work grows with the tables:

customer_features(h)  one row per customer; history up to T = max(o_orderdate)
                      - h days, label = 1 when the customer has no order after T
customer_raw          the same customers as a messy upload (strings with
                      thousands separators, Yes/No flags, identifiers, ...)
doc_features          labels joined to documents, label = toxic
user_events           per-user activity from the event stream
scored                customer_features with fixed logistic scores of three
                      models and a hash fold, for metric operators without ML

Plan shape: ``orders`` is aggregated once per customer with conditional
aggregates (partial aggregation happens map side, so a customer holding a
third of all orders costs one partial row per input split), then joined to
``customer`` on the key. The cutoff is one value computed by a small job
over the date column and inlined as a literal (no join, no repeated subquery).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.sources.tables import read_table

# --- fixed values: fixture definitions -------------------------------------------
DEFAULT_HORIZON_DAYS = 180
IMBALANCED_HORIZON_DAYS = 540
BIG_ORDER_PRICE = 450000.0
URGENT_PRIORITY = "1-URGENT"
# scored fixture: three fixed logistic models p = sigmoid(a + b*n_orders + c*c_acctbal/10000)
SCORE_MODELS = [
    ("m1", -1.2, 0.10, 0.8),
    ("m2", 0.4, -0.05, 0.3),
    ("m3", -0.3, 0.02, -0.6),
]
HASH_SALT = "42|"
N_FOLDS = 5


def hash_bucket(col: Column, salt: str = HASH_SALT, buckets: int = 1000) -> Column:
    """Deterministic bucket in [0, buckets) from md5(salt || key).

    Independent of partitioning and identical in DuckDB
    (``('0x' || substr(md5(...), 1, 8))::BIGINT % buckets``).
    """
    h = F.conv(F.substring(F.md5(F.concat(F.lit(salt), col.cast("string"))), 1, 8), 16, 10)
    return (h.cast("long") % F.lit(buckets)).cast("int")


def customer_features(spark: SparkSession, sf_dir: str,
                      horizon_days: int = DEFAULT_HORIZON_DAYS) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")

    # the cutoff is one value: computed once (a max over one column, partial per split) and
    # inlined as a literal; as a scalar subquery it would be re-planned for every reference
    t = orders.agg((F.max("o_orderdate") - F.expr(f"INTERVAL {int(horizon_days)} DAYS")).alias("t")).first()["t"]
    # via text: a string to timestamp_ntz cast does not depend on any time zone
    cutoff = F.lit(t.isoformat(sep=" ") if t is not None else None).cast("timestamp_ntz")

    od = F.col("o_orderdate")
    before = od <= cutoff
    price_before = F.when(before, F.col("o_totalprice"))
    hist = orders.groupBy("o_custkey").agg(
        F.count_if(before).alias("n_orders"),
        F.sum(price_before).alias("sum_spend"),
        F.max(price_before).alias("max_spend"),
        F.count_if(before & (F.col("o_orderstatus") == "O")).alias("n_open"),
        F.count_if(before & (F.col("o_orderstatus") == "F")).alias("n_final"),
        F.count_if(before & (F.col("o_orderpriority") == URGENT_PRIORITY)).alias("n_urgent"),
        F.min(F.when(before, od)).alias("first_order"),
        F.count_if(od > cutoff).alias("n_after"),
    )

    j = customer.join(hist, customer.c_custkey == hist.o_custkey, "left")
    n_orders = F.coalesce(F.col("n_orders"), F.lit(0)).cast("long")
    total = F.round(F.col("sum_spend"), 2)
    return j.select(
        F.col("c_custkey"),
        F.col("c_nationkey"),
        F.col("c_acctbal"),
        F.col("c_mktsegment"),
        n_orders.alias("n_orders"),
        total.alias("total_spend"),
        F.round(total / F.when(n_orders > 0, n_orders.cast("double")), 6).alias("avg_spend"),
        F.col("max_spend"),
        F.coalesce(F.col("n_open"), F.lit(0)).cast("long").alias("n_open"),
        F.coalesce(F.col("n_final"), F.lit(0)).cast("long").alias("n_final"),
        F.coalesce(F.col("n_urgent"), F.lit(0)).cast("long").alias("n_urgent"),
        F.datediff(F.to_date(cutoff), F.to_date(F.col("first_order"))).cast("int").alias("tenure_days"),
        (F.coalesce(F.col("n_urgent"), F.lit(0)) > 0).cast("int").alias("has_urgent"),
        (F.coalesce(F.col("n_open"), F.lit(0)) > 0).cast("int").alias("has_open"),
        F.coalesce(F.col("max_spend") >= BIG_ORDER_PRICE, F.lit(False)).cast("int").alias("has_big"),
        (F.coalesce(F.col("n_after"), F.lit(0)) == 0).cast("int").alias("label"),
    )


def customer_features_imb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_features(spark, sf_dir, IMBALANCED_HORIZON_DAYS)


def _flag_words(flag: Column, key: Column) -> Column:
    """0/1 flag written in four spellings chosen by the key."""
    k = key % 4
    return (F.when(flag.isNull(), F.lit(None).cast("string"))
            .when(k == 0, F.when(flag == 1, "Yes").otherwise("No"))
            .when(k == 1, F.when(flag == 1, "Y").otherwise("N"))
            .when(k == 2, F.when(flag == 1, "t").otherwise("f"))
            .otherwise(F.when(flag == 1, "TRUE").otherwise("false")))


def customer_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A messy upload of the 180-day customer table (cleaner and profiler input)."""
    cf = customer_features(spark, sf_dir)
    key = F.col("c_custkey")
    md5 = F.md5(key.cast("string"))
    return cf.select(
        key.alias("Customer ID"),
        F.when(F.col("label") == 1, "Yes").otherwise("No").alias("Churn"),
        F.when(key % 11 == 0, F.lit(" "))
         .otherwise(F.concat(F.lit(" "), F.format_number(F.col("total_spend"), 2), F.lit(" ")))
         .alias("Total Spend"),
        F.col("n_orders").alias("N-Orders"),
        F.col("c_acctbal").alias("Acct Bal"),
        F.when(key % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("Segment"),
        F.col("c_nationkey").cast("string").alias("nation"),
        _flag_words(F.col("has_urgent"), key).alias("Has Urgent"),
        _flag_words(F.col("has_open"), key + 1).alias("has_open"),
        F.lit("x").alias("constant_col"),
        F.when(key % 100 == 0, "b").otherwise("a").alias("nearly_constant"),
        F.concat(F.lit("user"), key.cast("string"), F.lit("@example.com")).alias("email"),
        md5.alias("row_hash"),
        F.concat(F.lit("+1 555-"), F.lpad(key.cast("string"), 4, "0")).alias("phone"),
        F.concat_ws("-", F.substring(md5, 1, 8), F.substring(md5, 9, 4), F.substring(md5, 13, 4),
                    F.substring(md5, 17, 4), F.substring(md5, 21, 12)).alias("account_uuid"),
        F.date_format(F.date_add(F.lit("2000-01-01").cast("date"),
                                 F.coalesce(F.col("tenure_days"), F.lit(0))),
                      "yyyy-MM-dd").alias("signup_date"),
        F.when(F.col("label") == 1, F.lit("2001-06-30")).alias("churn_date"),
        F.when(key % 5 < 3, F.lit(None).cast("long")).otherwise(F.col("n_urgent")).alias("mostly_null"),
    )


def doc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels joined to documents; a second, imbalanced domain (label = toxic)."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return labels.join(docs, "doc_id").select(
        "doc_id", "n_chars", "lang", "source", "quality", F.col("toxic").alias("label"))


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-user activity: counts per event type, value moments, active days."""
    ev = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    aggs = [F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in EVENT_TYPES]
    return ev.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        *aggs,
        F.round(F.sum("value"), 2).alias("sum_value"),
        F.round(F.round(F.sum("value"), 2) / F.count(F.lit(1)), 8).alias("avg_value"),
        F.max("value").alias("max_value"),
        F.count_distinct(F.to_date("ts")).alias("active_days"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_features with fixed scores of three models, one row per (model, customer).

    The three models are a generated array exploded per row (no join).
    """
    cf = customer_features(spark, sf_dir)
    models = F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"))
        for m, a, b, c in SCORE_MODELS
    ])
    x = cf.select("c_custkey", "label", "n_orders", "c_acctbal", F.explode(models).alias("m"))
    z = (F.col("m.a") + F.col("m.b") * F.col("n_orders") + F.col("m.c") * F.col("c_acctbal") / 10000.0)
    return x.select(
        F.col("m.model").alias("model"),
        F.col("c_custkey"),
        F.col("label"),
        F.round(1.0 / (1.0 + F.exp(-z)), 4).alias("p"),
        (hash_bucket(F.col("c_custkey")) % N_FOLDS).alias("fold"),
    )
