"""Claims tables derived from the order, event, document and embedding tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NPI_BASE = 1_000_000_000

# State code by nation key. The last one is no valid code, so that checks find something.
NATION_STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL",
    "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "ZZ",
]
SPECIALTIES = {"FURNITURE": "Pain Management", "MACHINERY": "Anesthesiology"}
# Path, method and status of the access log by event type.
ACCESS_BY_EVENT = {
    "signup": ("/api/auth/login", "POST", 200),
    "view": ("/api/prescribers/top", "GET", 200),
    "click": ("/api/drugs/summary", "GET", 200),
    "error": ("/api/rag/chat", "POST", 500),
    "purchase": ("/api/ai/query", "POST", 201),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def by_literal(c, mapping: dict):
    """CASE expression over a fixed mapping, NULL for other values."""
    expr = F.lit(None)
    for key, value in reversed(list(mapping.items())):
        expr = F.when(c == key, F.lit(value)).otherwise(expr)
    return expr


def state_of(nation_key):
    return F.element_at(F.array(*[F.lit(s) for s in NATION_STATES]), (nation_key + 1).cast("int"))


def specialty_of(segment):
    return F.coalesce(by_literal(segment, SPECIALTIES), segment)


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        "c_custkey",
        (F.lit(NPI_BASE) + F.col("c_custkey")).alias("prscrbr_npi"),
        F.col("c_name").alias("prscrbr_last_org_name"),
        F.lit("PAT").alias("prscrbr_first_name"),
        F.col("n_name").alias("prscrbr_city"),
        F.lower(state_of(F.col("c_nationkey"))).alias("prscrbr_state_abrvtn"),
        specialty_of(F.col("c_mktsegment")).alias("prscrbr_type"),
    )


def prescribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir).drop("c_custkey")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw claims: one row per line item, with untidy case and spacing.

    Customer columns are joined to the orders before the much larger line items are.
    """
    orders, part = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    line, who = table(spark, sf_dir, "lineitem"), _profiles(spark, sf_dir)
    ordered = orders.join(who, orders.o_custkey == who.c_custkey)
    return (
        line.join(ordered, line.l_orderkey == ordered.o_orderkey)
        .join(part, line.l_partkey == part.p_partkey)
        .select(
            "prscrbr_npi", "prscrbr_last_org_name", "prscrbr_first_name", "prscrbr_city",
            "prscrbr_state_abrvtn", "prscrbr_type",
            F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" "), "p_name"))
            .otherwise(F.col("p_brand")).alias("brnd_name"),
            F.col("p_name").alias("gnrc_name"),
            F.col("l_quantity").cast("int").alias("tot_clms"),
            (F.col("l_quantity") * 1.5).alias("tot_30day_fills"),
            F.col("l_extendedprice").alias("tot_drug_cst"),
            (F.col("l_quantity").cast("int") * 30).alias("tot_day_suply"),
            F.floor(F.col("l_quantity").cast("int") * 7 / 10).cast("int").alias("tot_benes"),
            F.year("o_orderdate").alias("year"),
        )
    )


def drugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_name").alias("gnrc_name"), F.col("p_brand").alias("brnd_name"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference of all states with one row per supplier, hence many rows per state."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return nation.join(supplier, supplier.s_nationkey == nation.n_nationkey, "left").select(
        state_of(F.col("n_nationkey")).alias("state_abrvtn"), F.col("n_name").alias("state_name"))


def claim_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed claim events; event types stand for drugs, two of them opioids."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("claim_id"),
        (F.lit(NPI_BASE) + F.col("user_id")).alias("prscrbr_npi"),
        state_of(F.col("user_id") % len(NATION_STATES)).alias("prscrbr_state_abrvtn"),
        F.col("event_type").alias("gnrc_name"),
        F.concat(F.col("event_type"), F.lit("-brand")).alias("brnd_name"),
        F.col("event_type").isin("purchase", "error").alias("is_opioid"),
        F.col("value").alias("drug_cost_usd"),
        F.col("ts").alias("event_time"),
    )


def claim_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim events as JSON text, some of them breaking the contract by event type."""
    c = claim_events(spark, sf_dir)
    stamp = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    whole = F.struct(
        "claim_id",
        F.when(F.col("gnrc_name") != "signup", F.col("prscrbr_npi")).alias("prscrbr_npi"),
        "prscrbr_state_abrvtn", "gnrc_name",
        F.when(F.col("gnrc_name") != "click", F.col("brnd_name")).alias("brnd_name"),
        "is_opioid",
        F.when(F.col("drug_cost_usd") > 400, -F.col("drug_cost_usd"))
        .otherwise(F.col("drug_cost_usd")).alias("drug_cost_usd"),
        F.when(F.col("gnrc_name") == "view", F.lit("yesterday")).otherwise(stamp)
        .alias("claim_timestamp"),
    )
    text = F.to_json(whole)
    return c.select(
        "claim_id", "event_time",
        F.when(F.col("claim_id").endswith("99"), F.concat(F.lit("{"), text)).otherwise(text)
        .alias("value"),
    )


def nightly_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bulk extract of every third claim event, valid or not, at twice its cost."""
    e = table(spark, sf_dir, "events").filter("event_id % 3 = 0")
    return e.select(
        (F.lit(NPI_BASE) + F.col("user_id")).alias("prscrbr_npi"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("prscrbr_last_org_name"),
        F.lower(state_of(F.col("user_id") % len(NATION_STATES))).alias("prscrbr_state_abrvtn"),
        F.concat(F.col("event_type"), F.lit("-brand ")).alias("brnd_name"),
        F.col("event_type").alias("gnrc_name"), F.lit(1).alias("tot_clms"),
        (F.col("value") * 2).alias("tot_drug_cst"), F.year("ts").alias("year"))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kinds = {i: {k: v[i] for k, v in ACCESS_BY_EVENT.items()} for i in range(3)}
    return e.select(
        F.col("event_id").cast("string").alias("log_id"),
        F.when(F.col("event_type") != "signup",
               F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("username"),
        by_literal(F.col("event_type"), kinds[0]).alias("path"),
        by_literal(F.col("event_type"), kinds[1]).alias("method"),
        by_literal(F.col("event_type"), kinds[2]).alias("status_code"),
        F.col("value").alias("duration_ms"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")).alias("client_ip"),
        F.col("ts").alias("accessed_at"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document collection; the label is metadata and the id gives the write time."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").cast("string").alias("id"),
        F.concat(F.lit("document "), F.col("vec_id").cast("string")).alias("document"),
        F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"),
        "embedding",
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("vec_id")).cast("timestamp_ntz")
        .alias("ts"),
    )


def session_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns; each turn comes ten minutes after the one before it."""
    c = table(spark, sf_dir, "conversations")
    start = F.lit(1_704_067_200) + F.col("conv_id") * 120
    return c.select(
        F.col("conv_id").cast("string").alias("session_id"),
        "turn", "role", F.col("text").alias("content"),
        F.timestamp_seconds(start + F.col("turn") * 600).cast("timestamp_ntz").alias("ts"),
    )
