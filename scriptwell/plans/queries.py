"""One query per operator over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptwell import schemas
from scriptwell.fixed_values import CACHE_TTL_SECONDS
from scriptwell.functions.columns import exact_sum
from scriptwell.functions.contract import check_events
from scriptwell.operators import (
    cleaning,
    corpus,
    findings,
    gold,
    governance,
    guarded_sql,
    lineage,
    narratives,
    quality,
    retrieval,
    serving,
    sessions,
    staging,
    surveillance,
)
from scriptwell.plans import layers, testdata
from scriptwell.plans.constants import (
    ARCHIVE_NOW,
    DRUG_NAME,
    NOW,
    OUTLIER_CUT,
    OVERLAP_QUESTIONS,
    QUESTION_BY_TURN,
    REPORT_YEAR,
    SESSIONS_NOW,
    SMALL_CHUNK,
    THRESHOLD,
    WINDOW_MINUTES,
)
from scriptwell.sources import catalog, lake
from scriptwell.sources.workspace import StoredTables, fresh_path, source_state, write_once
from scriptwell.streaming import events as stream_events
from scriptwell.streaming import sinks, tracker

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _drugs(spark, sf):
    return layers.gold_table(spark, sf, "drug_summary")


def _people(spark, sf):
    return layers.gold_table(spark, sf, "prescriber_summary")


def _states(spark, sf):
    return layers.gold_table(spark, sf, "state_kpi")


# ---- cleaning and staging ------------------------------------------------------------

@query
def silver_clean(spark, sf):
    return cleaning.clean_prescriber_drug(layers.bronze_claims(spark, sf)).drop("_silver_ts")


@query
def silver_dedup(spark, sf):
    clean = cleaning.valid_claims(cleaning.normalize_claims(layers.bronze_claims(spark, sf)))
    return cleaning.dedup_claims(clean).groupBy("year").agg(
        F.count(F.lit(1)).alias("claims"), F.sum("tot_clms").alias("tot_clms"))


@query
def silver_prescribers(spark, sf):
    return layers.silver_prescribers(spark, sf).drop("_silver_ts")


@query
def silver_drugs(spark, sf):
    return cleaning.clean_drug(testdata.drugs(spark, sf)).drop("_silver_ts")


@query
def silver_states(spark, sf):
    return cleaning.clean_state(testdata.states(spark, sf)).groupBy("state_abrvtn").agg(
        F.count(F.lit(1)).alias("rows"))


@query
def stage_claims(spark, sf):
    staged = staging.stg_prescriber_drug(layers.silver_claims(spark, sf))
    return staged.drop("silver_loaded_at").withColumns({
        "total_claims": F.col("total_claims").cast("bigint"),
        "total_beneficiaries": F.col("total_beneficiaries").cast("bigint"),
    })


@query
def stage_prescribers(spark, sf):
    return staging.stg_prescriber(layers.silver_prescribers(spark, sf)).drop("silver_loaded_at")


def _classified(spark, sf):
    return staging.classify_claims(
        staging.stg_prescriber_drug(layers.silver_claims(spark, sf)))


@query
def classify_claims(spark, sf):
    return _classified(spark, sf).groupBy("is_pain_management_specialty", "cost_tier").agg(
        F.count(F.lit(1)).alias("claims"))


@query
def landing_union(spark, sf):
    """Bulk claims and the same claims streamed again are no more than the bulk alone."""
    bulk = cleaning.normalize_claims(layers.bronze_claims(spark, sf))
    streamed = bulk.drop("tot_30day_fills", "tot_day_suply")
    both = cleaning.union_landing(bulk, streamed)
    return both.select(*cleaning.CLAIM_KEY).distinct().groupBy("year").agg(
        F.count(F.lit(1)).alias("claim_keys"))


@query
def ingestion_summary(spark, sf):
    """Rows per table as the Bronze writes observed them."""
    written = layers.built_lake(spark, sf).where("layer = 'bronze'")
    return lake.with_total(written.select("table", "rows"))


# ---- Gold ----------------------------------------------------------------------------

@query
def layer_counts(spark, sf):
    """Rows read back from dated Bronze, Silver and Gold storage after a full build."""
    built = layers.built_lake(spark, sf).collect()
    counts = [
        lake.read_layer(spark, r.root, r.layer, r.table, "2024-01-01")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit(r.layer).alias("layer"), F.lit(r.table).alias("table"), "rows")
        for r in built]
    return reduce(DataFrame.unionByName, counts)


@query
def layer_contract(spark, sf):
    """Every column of every stored layer against its declared type."""
    return reduce(DataFrame.unionByName, [
        lake.layer_contract(spark, r.root, r.layer, r.table, "2024-01-01")
        for r in layers.built_lake(spark, sf).collect()]
    ).groupBy("layer", "table", "verdict").agg(F.count(F.lit(1)).alias("columns"))


@query
def layer_by_state(spark, sf):
    """Silver and Gold read by their folders of year and state."""
    root = layers.built_lake(spark, sf).first()["root"]
    silver = lake.read_layer(spark, root, "silver", "prescriber_drug", "2024-01-01")
    people = lake.read_layer(spark, root, "gold", "prescriber_summary", "2024-01-01")
    return silver.groupBy("year", "prscrbr_state_abrvtn").agg(
        F.count(F.lit(1)).alias("claims"), F.sum("tot_clms").cast("bigint").alias("tot_clms")).join(
        people.groupBy("year", "prscrbr_state_abrvtn").agg(F.count(F.lit(1)).alias("people")),
        ["year", "prscrbr_state_abrvtn"])


@query
def gated_claims(spark, sf):
    """Silver rows by year behind their own critical checks, in one plan."""
    silver = layers.silver_claims(spark, sf)
    return quality.gated(silver, quality.silver_suite(silver)).groupBy("year").agg(
        F.count(F.lit(1)).alias("claims"))


@query
def catalog_load(spark, sf):
    """The drug table appended to a catalog table by name, from columns in another order and case."""
    name = f"drug_load_{uuid.uuid4().hex}"
    catalog.create_table(spark, name, schemas.DRUG_SUMMARY)
    drugs = gold.gold_stamp(_drugs(spark, sf))
    catalog.load_by_name(
        drugs.select(*[F.col(c).alias(c.upper()) for c in reversed(drugs.columns)]), name)
    return spark.table(name).drop("_gold_ts").withColumns(
        {c: F.col(c).cast("bigint") for c in
         ("total_claims", "total_beneficiaries", "unique_prescribers")})


@query
def catalog_model(spark, sf):
    """Classified claims as a catalog table clustered by year, read by year."""
    name = f"classified_{uuid.uuid4().hex}"
    model = catalog.materialize(_classified(spark, sf), name, "table", "claim_year")
    return model.where(F.col("claim_year") == REPORT_YEAR).groupBy("cost_tier").agg(
        F.count(F.lit(1)).alias("claims"))


@query
def drug_summary(spark, sf):
    return gold.drug_summary(layers.silver_claims(spark, sf),
                             stage=lambda df: write_once(df, "drug_unranked"))


@query
def drug_summary_stored(spark, sf):
    """The same table as it is stored for other queries."""
    return _drugs(spark, sf)


@query
def drug_summary_sql(spark, sf):
    """Rank over an aggregate in one SELECT, on the classified view."""
    catalog.materialize(_classified(spark, sf), "classified_claims", "view")
    return spark.sql(gold.ranked_drug_sql("classified_claims"))


@query
def prescriber_summary_left(spark, sf):
    return _people(spark, sf)


@query
def prescriber_summary_inner(spark, sf):
    return gold.prescriber_summary(
        layers.silver_claims(spark, sf), layers.silver_prescribers(spark, sf), "inner",
        stage=lambda df: write_once(df, "prescriber_unranked"))


@query
def state_kpi(spark, sf):
    return gold.state_kpi(layers.silver_claims(spark, sf), testdata.states(spark, sf))


# ---- serving -------------------------------------------------------------------------

@query
def top_drugs(spark, sf):
    return serving.get_drug_summary(_drugs(spark, sf), limit=50)


@query
def top_drugs_of_year(spark, sf):
    return serving.get_drug_summary(_drugs(spark, sf), REPORT_YEAR, 50)


@query
def top_prescribers(spark, sf):
    return serving.get_top_prescribers(_people(spark, sf), limit=100)


@query
def top_prescribers_in_state(spark, sf):
    return serving.get_top_prescribers(_people(spark, sf), "CA", REPORT_YEAR, 100)


@query
def states_by_cost(spark, sf):
    return serving.get_state_kpi(_states(spark, sf))


@query
def generic_vs_brand(spark, sf):
    return serving.generic_vs_brand(_drugs(spark, sf))


@query
def labelled_split(spark, sf):
    return serving.labelled_split(_drugs(spark, sf), REPORT_YEAR)


@query
def drug_history(spark, sf):
    return serving.get_drug_detail(_drugs(spark, sf), DRUG_NAME)


@query
def prescriber_history(spark, sf):
    return serving.get_prescriber_detail(_people(spark, sf), testdata.NPI_BASE + 1)


@query
def prescriber_search(spark, sf):
    return serving.search_prescribers(_people(spark, sf), "Pain").select(
        "prscrbr_npi", "year", "prscrbr_type", "prscrbr_state_abrvtn")


@query
def kpi_totals(spark, sf):
    return serving.kpi_totals(_states(spark, sf), REPORT_YEAR)


@query
def avg_generic_rate(spark, sf):
    return serving.avg_generic_rate(_people(spark, sf))


@query
def kpi_cards(spark, sf):
    return serving.kpi_cards(_states(spark, sf), _people(spark, sf))


@query
def kpi_cards_top(spark, sf):
    return serving.kpi_cards(_states(spark, sf), _people(spark, sf), REPORT_YEAR, 10, 20)


@query
def year_trend(spark, sf):
    return serving.year_trend(_states(spark, sf))


@query
def claim_share(spark, sf):
    return serving.claim_share(_drugs(spark, sf))


@query
def opioid_by_state(spark, sf):
    return serving.opioid_by_state(_states(spark, sf), REPORT_YEAR)


@query
def avg_cost_by_state(spark, sf):
    return serving.avg_cost(_states(spark, sf), REPORT_YEAR)


@query
def snapshot_top5(spark, sf):
    drugs = serving.top_drugs(_drugs(spark, sf), REPORT_YEAR, 5).select(
        F.lit("drug").alias("kind"), F.col("gnrc_name").alias("name"), "total_cost_usd")
    states = serving.top_states(_states(spark, sf), REPORT_YEAR, 5).select(
        F.lit("state").alias("kind"), F.col("state_abrvtn").alias("name"), "total_cost_usd")
    return drugs.unionByName(states)


@query
def report_top10(spark, sf):
    drugs = serving.top_drugs(_drugs(spark, sf), REPORT_YEAR).select(
        F.lit("drug").alias("kind"), F.col("gnrc_name").alias("name"), "total_cost_usd")
    states = serving.top_states(_states(spark, sf), REPORT_YEAR, 10).select(
        F.lit("state").alias("kind"), F.col("state_abrvtn").alias("name"), "total_cost_usd")
    people = serving.top_prescribers(_people(spark, sf), REPORT_YEAR).select(
        F.lit("prescriber").alias("kind"), F.col("prscrbr_last_org_name").alias("name"),
        "total_cost_usd")
    return drugs.unionByName(states).unionByName(people)


@query
def canned_queries(spark, sf):
    """Row count and cost of each canned query for one year."""
    tables = layers.gold_tables(spark, sf)
    parts = []
    for key in serving.CANNED_QUERIES:
        rows = serving.canned_query(key, REPORT_YEAR, tables)
        measure = "total_cost_usd" if "total_cost_usd" in rows.columns else rows.columns[1]
        parts.append(rows.agg(
            F.count(F.lit(1)).alias("rows"),
            F.round(exact_sum(measure), 4).alias("measure"),
        ).withColumn("query", F.lit(key)))
    return reduce(DataFrame.unionByName, parts)


@query
def guarded_sql_rows(spark, sf):
    _states(spark, sf).createOrReplaceTempView("state_kpi_view")
    return guarded_sql.run_guarded(
        spark, "SELECT state_abrvtn, total_cost_usd FROM state_kpi_view "
               "WHERE year = :year ORDER BY total_cost_usd DESC, state_abrvtn;",
        {"year": REPORT_YEAR})


@query
def prescriber_with_state(spark, sf):
    return serving.prescriber_with_state(_people(spark, sf), _states(spark, sf))


@query
def drug_with_year(spark, sf):
    return serving.drug_with_year(_drugs(spark, sf), _states(spark, sf))


@query
def masked_view(spark, sf):
    return serving.masked_view(
        _people(spark, sf).select("prscrbr_npi", "prscrbr_last_org_name", "year",
                                  "total_cost_usd"),
        ["prscrbr_npi", "prscrbr_last_org_name"], "HEALTHCARE_READER")


@query
def region_view(spark, sf):
    nation, region = testdata.table(spark, sf, "nation"), testdata.table(spark, sf, "region")
    entitlements = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("r_name").alias("username"),
        testdata.state_of(F.col("n_nationkey")).alias("state_abrvtn"))
    return serving.region_view(_people(spark, sf), entitlements, "AFRICA").select(
        "prscrbr_npi", "year", "prscrbr_state_abrvtn", "total_cost_usd")


# ---- findings ------------------------------------------------------------------------

@query
def savings_candidates(spark, sf):
    return findings.savings_candidates(_drugs(spark, sf))


@query
def total_savings(spark, sf):
    return findings.total_savings(findings.savings_candidates(_drugs(spark, sf)))


@query
def low_adoption_states(spark, sf):
    return findings.low_adoption_states(_people(spark, sf))


@query
def zscore_outliers(spark, sf):
    return findings.zscore_outliers(_states(spark, sf), threshold=OUTLIER_CUT)


@query
def duplicate_groups(spark, sf):
    return findings.gold_duplicates(layers.gold_tables(spark, sf))


@query
def quality_status(spark, sf):
    return findings.quality_status(layers.gold_tables(spark, sf), OUTLIER_CUT)


# ---- data quality --------------------------------------------------------------------

@query
def dq_bronze_suite(spark, sf):
    return quality.bronze_suite(layers.bronze(spark, sf))


@query
def dq_silver_suite(spark, sf):
    return quality.silver_suite(layers.silver_claims(spark, sf))


@query
def dq_silver_expectations(spark, sf):
    return quality.silver_expectations(layers.silver_claims(spark, sf))


def _models(spark, sf):
    return {
        "silver_prescriber_drug": layers.silver_claims(spark, sf),
        "silver_prescriber": layers.silver_prescribers(spark, sf),
        **layers.gold_tables(spark, sf),
    }


def _model_results(spark, sf):
    return quality.all_model_tests(_models(spark, sf))


@query
def dq_gold_tests(spark, sf):
    return _model_results(spark, sf)


@query
def dq_absent_column(spark, sf):
    """A table that lost two columns fails the checks on them."""
    return quality.model_tests(
        _states(spark, sf).drop("total_cost_usd", "national_rank"), "state_kpi")


@query
def dq_declared(spark, sf):
    return quality.declared_assertions(
        testdata.claim_events(spark, sf), _drugs(spark, sf), _people(spark, sf),
        _states(spark, sf))


@query
def dq_scorecard(spark, sf):
    return quality.scorecard(quality.all_suites(
        layers.silver_claims(spark, sf), _models(spark, sf)))


@query
def generic_cost_sanity(spark, sf):
    return quality.assert_generic_cost_sanity(_drugs(spark, sf))


@query
def cost_without_prescribers(spark, sf):
    return quality.assert_no_cost_without_prescribers(_states(spark, sf))


# ---- text ----------------------------------------------------------------------------

@query
def phi_redact(spark, sf):
    return corpus.redacted(testdata.table(spark, sf, "documents"), "text").select(
        "doc_id", "redacted", "total_found")


@query
def phi_findings(spark, sf):
    docs = corpus.redacted(testdata.table(spark, sf, "documents"), "text")
    return docs.select("doc_id", F.explode("findings").alias("category", "n"))


@query
def phi_corpus_totals(spark, sf):
    return corpus.findings_by_category(testdata.table(spark, sf, "pages"), "html")


@query
def safe_text_split(spark, sf):
    gated = corpus.gate_text(testdata.table(spark, sf, "documents"), "text")
    return gated.groupBy("is_safe").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("total_found").alias("found"))


@query
def chunks(spark, sf):
    return corpus.chunk_rows(testdata.table(spark, sf, "documents"), "doc_id", "text", ["source"])


@query
def chunks_small(spark, sf):
    words, overlap = SMALL_CHUNK
    return corpus.chunk_rows(testdata.table(spark, sf, "conversations"), "conv_id", "text",
                             ["turn"], words, overlap)


def questions(spark, sf):
    c = testdata.table(spark, sf, "conversations")
    asked = testdata.by_literal(F.col("turn"), QUESTION_BY_TURN)
    return c.select("conv_id", "turn", F.concat(
        "text", F.lit(" "), F.coalesce(asked, F.lit(""))).alias("question"))


@query
def intent_route(spark, sf):
    return corpus.route_questions(questions(spark, sf), "question").drop("question")


@query
def token_overlap(spark, sf):
    docs = testdata.table(spark, sf, "documents")
    return corpus.token_overlap(docs, "text", OVERLAP_QUESTIONS).select("doc_id", "question_no")


@query
def token_overlap_table(spark, sf):
    """Documents sharing words with the turns of every twentieth conversation."""
    asked = testdata.table(spark, sf, "conversations").where("conv_id % 20 = 0").withColumn(
        "question", F.concat_ws("-", "conv_id", "turn"))
    return corpus.shared_tokens(testdata.table(spark, sf, "documents"), asked, "doc_id", "question")


# ---- retrieval -----------------------------------------------------------------------

def _questions(spark, sf) -> dict[str, list[float]]:
    """Question vectors: the collection's mean (one number per dimension) and two axes."""
    e = testdata.table(spark, sf, "embeddings")
    mean = e.select(F.posexplode("embedding").alias("at", "x")).groupBy("at").agg(
        F.avg("x").alias("x")).orderBy("at").collect()
    dim = len(mean)
    return {
        "mean": [r.x for r in mean],
        "first_axis": [1.0] + [0.0] * (dim - 1),
        "diagonal": [1.0] * dim,
    }


def _hits(df):
    return df.select("question_id", "id", "document", "similarity", "rank")


def _question_table(spark, sf):
    """Every twentieth vector as a question."""
    return testdata.table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(
        F.col("vec_id").cast("string").alias("question_id"), "embedding")


@query
def knn_question_table(spark, sf):
    return _hits(retrieval.search(testdata.vectors(spark, sf), _question_table(spark, sf), 5))


@query
def context_bundle_table(spark, sf):
    """Knowledge, tables and past queries for a table of questions."""
    bundle = retrieval.context_bundle(
        _question_table(spark, sf), _labelled(spark, sf, "0"),
        _labelled(spark, sf, "1", table=F.col("id")),
        _labelled(spark, sf, "2", question=F.col("document"), sql=F.col("id")),
        history_similarity=0.25)
    return bundle.select("question_id", "knowledge_chunks", "schema_chunks", "query_examples")


@query
def semantic_cache_table(spark, sf):
    """Cached answers to questions that were asked before, at the default similarity."""
    return retrieval.cache_lookup(cache(spark, sf), _question_table(spark, sf), _at(NOW))


@query
def knn_topk(spark, sf):
    return _hits(retrieval.search(testdata.vectors(spark, sf), _questions(spark, sf), 5))


@query
def vectors_rejected(spark, sf):
    """Every fiftieth vector cut short, made infinite or given a null, and found again."""
    e, v = testdata.table(spark, sf, "embeddings"), F.col("embedding")
    dim = e.select(F.max(F.size("embedding"))).first()[0]
    kind = F.col("vec_id") % 50
    spoilt = F.when(kind == 1, F.slice(v, 1, dim - 1)) \
        .when(kind == 2, F.transform(v, lambda x: F.lit(float("inf")).cast("float"))) \
        .when(kind == 3, F.transform(v, lambda x: F.lit(None).cast("float"))).otherwise(v)
    return retrieval.rejected_vectors(e.withColumn("embedding", spoilt), dim).groupBy(
        "reason").agg(F.count("*").alias("vectors"))


@query
def knn_filtered(spark, sf):
    return _hits(retrieval.search(
        testdata.vectors(spark, sf), _questions(spark, sf), 5, {"label": "3"}))


@query
def knn_threshold(spark, sf):
    return _hits(retrieval.retrieve_knowledge(testdata.vectors(spark, sf), _questions(spark, sf)))


def _labelled(spark, sf, label, **metadata):
    v = retrieval.where(testdata.vectors(spark, sf), {"label": label})
    pairs = [x for k, value in metadata.items() for x in (F.lit(k), value)]
    return v.withColumn("metadata", F.create_map(*pairs)) if pairs else v


@query
def context_bundle(spark, sf):
    bundle = retrieval.context_bundle(
        _questions(spark, sf), _labelled(spark, sf, "0"),
        _labelled(spark, sf, "1", table=F.col("id")),
        _labelled(spark, sf, "2", question=F.col("document"), sql=F.col("id")),
        history_similarity=0.25)
    return bundle.select(
        "question_id", F.array_join("domain_knowledge", "|").alias("domain_knowledge"),
        F.array_join(F.transform("relevant_tables", lambda x: x["table"]), "|").alias("tables"),
        F.array_join(F.transform("similar_past_queries", lambda x: x["sql"]), "|").alias("sqls"),
        "knowledge_chunks", "schema_chunks", "query_examples")


def cache(spark, sf):
    return testdata.vectors(spark, sf).withColumns({
        "metadata": F.create_map(
            F.lit("sql"), F.concat(F.lit("SELECT "), F.col("id")), F.lit("summary"),
            F.col("document"), F.lit("row_count"), F.element_at("metadata", "label")),
        "ts": F.timestamp_seconds(
            F.unix_seconds(_at(NOW).cast("timestamp")) - F.col("id").cast("bigint") * 5
        ).cast("timestamp_ntz"),
    })


@query
def semantic_cache(spark, sf):
    return retrieval.cache_lookup(cache(spark, sf), _questions(spark, sf), _at(NOW), 0.25)


@query
def cache_evict(spark, sf):
    return retrieval.fresh_entries(cache(spark, sf), _at(NOW), CACHE_TTL_SECONDS).select("id", "document")


@query
def cache_write(spark, sf):
    asked = testdata.vectors(spark, sf).withColumns({
        "sql": F.concat(F.lit("SELECT "), F.col("id")), "rows": F.col("id").cast("bigint")})
    return retrieval.cache_entry(asked, "document", "embedding", "sql", "document", "rows", _at(NOW)
                                 ).select("document", F.col("metadata")["sql"].alias("sql"),
                                          F.col("metadata")["row_count"].alias("row_count"))


@query
def upsert_docs(spark, sf):
    """The collection after every document of label 3 is written again, a day later."""
    v = testdata.vectors(spark, sf)
    changes = retrieval.where(v, {"label": "3"}).withColumns({
        "document": F.concat(F.lit("new "), F.col("document")),
        "ts": F.col("ts") + F.expr("INTERVAL '1' DAY")})
    return retrieval.upsert(v, changes).select("id", "document")


@query
def collection_count(spark, sf):
    return retrieval.count(testdata.vectors(spark, sf))


# ---- sessions ------------------------------------------------------------------------

@query
def last_n_turns(spark, sf):
    return sessions.get_history(testdata.session_turns(spark, sf), 4).select(
        "session_id", "turn", "role")


@query
def context_turns(spark, sf):
    turns = sessions.context_turns(testdata.session_turns(spark, sf))
    return turns.select(
        "session_id", F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat_ws(":", t["turn"], t["role"])), ",")
        .alias("roles"))


@query
def idle_sessions(spark, sf):
    return sessions.idle_sessions(testdata.session_turns(spark, sf), _at(SESSIONS_NOW)).select(
        "session_id", "idle_seconds")


@query
def evict_idle(spark, sf):
    return sessions.evict_idle(testdata.session_turns(spark, sf), _at(SESSIONS_NOW)).select(
        "session_id", "turn")


# ---- surveillance --------------------------------------------------------------------

def _opioid_counts(spark, sf):
    events = surveillance.opioid_only(testdata.claim_events(spark, sf))
    return surveillance.trailing_count(events, "prscrbr_npi", "event_time", WINDOW_MINUTES)


@query
def trailing_count(spark, sf):
    return _opioid_counts(spark, sf).select("claim_id", "prscrbr_npi", "claim_count_in_window")


@query
def opioid_alerts(spark, sf):
    return surveillance.alerts(_opioid_counts(spark, sf), THRESHOLD, WINDOW_MINUTES).drop(
        "detected_at")


@query
def active_alerts(spark, sf):
    alerts = surveillance.alerts(_opioid_counts(spark, sf), THRESHOLD, WINDOW_MINUTES)
    status = F.when(F.col("prscrbr_state_abrvtn") < "C", "RESOLVED").otherwise("ACTIVE")
    return serving.active_alerts(alerts.withColumn("status", status))


@query
def contract_errors_per_event(spark, sf):
    checked = check_events(testdata.claim_messages(spark, sf).withColumnRenamed(
        "claim_id", "message_id"))
    return checked.select(F.col("message_id").alias("claim_id"),
                          F.array_join("errors", "; ").alias("errors"))


@query
def routed_claims(spark, sf):
    checked = stream_events.decoded(testdata.claim_messages(spark, sf))
    return checked.groupBy(stream_events.side().alias("side")).agg(
        F.count(F.lit(1)).alias("events"))


@query
def published_claims(spark, sf):
    """Messages per key of the claims that pass the contract."""
    messages, _ = sinks.claim_messages(
        stream_events.decoded(testdata.claim_messages(spark, sf)))
    stamped = F.get_json_object("value", "$._produced_at").isNotNull()
    return messages.groupBy("key").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(stamped).alias("stamped"))


# Messages of a file of the stream, about.
MESSAGES_PER_FILE = 100_000


def _arrivals(spark, sf, folder, late=None, replayed=None):
    """Claim messages as a stream of files in order of time, equally many for eight days each,
    which are read together. Messages of the condition `late` come eight days later than their
    time; those of the condition `replayed` come twice, and once more eight days later."""
    days = F.floor(F.unix_seconds(F.col("event_time").cast("timestamp")) / (8 * 86_400))
    arrival = days if late is None else days + late.cast("int")
    arrivals = F.array(arrival) if replayed is None else F.when(
        replayed, F.array(arrival, arrival, arrival + 1)).otherwise(F.array(arrival))
    stored = write_once(testdata.claim_messages(spark, sf).select(
        F.explode(arrivals).alias("arrival"), "value"), "messages", ["arrival"])
    counts = dict(stored.groupBy("arrival").count().collect())
    files = max(-(-n // MESSAGES_PER_FILE) for n in counts.values()) if counts else 1
    for done, number in enumerate(sorted(counts)):
        rows = stored.where(F.col("arrival") == number).select("value")
        rows = rows.coalesce(1) if files == 1 else rows.repartitionById(
            files, F.pmod(F.xxhash64("value"), F.lit(files)).cast("int"))
        rows.write.mode("append").option("maxRecordsPerFile", 0).parquet(f"{folder}/in")
        # Parts without messages leave no file; a file without rows takes its place.
        there = sum(name.endswith(".parquet") for name, *_ in source_state(spark, f"{folder}/in"))
        for _ in range((done + 1) * files - there):
            rows.limit(0).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return stream_events.read_claim_files(spark, f"{folder}/in", files_per_trigger=files) \
        .repartition("value")


@contextmanager
def _state_store(spark):
    """State of streams in the embedded store; the session's settings come back afterwards."""
    before = {key: spark.conf.get(key, None) for key in tracker.STATE_STORE_SETTINGS}
    try:
        for key, value in tracker.STATE_STORE_SETTINGS.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@query
def stream_alerts(spark, sf):
    """The whole event table through the stream: decode, route, count, alert, sink."""
    folder = fresh_path(spark, "stream")
    valid, _ = stream_events.route(stream_events.decoded(_arrivals(spark, sf, folder)))
    counts = tracker.trailing_counts(stream_events.with_watermark(valid), WINDOW_MINUTES)
    alerts = sinks.alert_messages(surveillance.alerts(counts, THRESHOLD, WINDOW_MINUTES))
    with _state_store(spark):
        sinks.sink(alerts, f"{folder}/out", f"{folder}/checkpoint", available_now=True
                   ).awaitTermination()
    out = spark.read.schema("key string, value string").parquet(f"{folder}/out")
    fields = ["prscrbr_state_abrvtn", "claim_count_in_window", "severity"]
    return out.select("key", *[F.get_json_object("value", f"$.{f}").alias(f) for f in fields])


@query
def stream_late_rows(spark, sf):
    """Every valid claim of the stream with whether it came behind the watermark."""
    folder = fresh_path(spark, "stream")
    delayed = F.col("claim_id").cast("bigint") % 50 == 0
    valid, _ = stream_events.route(stream_events.decoded(
        _arrivals(spark, sf, folder, late=delayed)))
    sinks.late_sink(valid, f"{folder}/out", f"{folder}/checkpoint",
                    available_now=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(
        "claim_id", F.col("late").cast("boolean").alias("late"))


def _landed(spark, sf):
    """Valid claims of a stream with replays, landed once each and filed by hour of arrival."""
    def land():
        folder = fresh_path(spark, "stream")
        again = F.col("claim_id").cast("bigint") % 20 == 0
        valid, _ = stream_events.route(stream_events.decoded(
            _arrivals(spark, sf, folder, replayed=again)))
        unique = stream_events.dedup_stream(stream_events.with_watermark(valid))
        with _state_store(spark):
            sinks.land(unique, f"{folder}/landed", f"{folder}/checkpoint",
                       available_now=True).awaitTermination()
        return spark.read.parquet(f"{folder}/landed")
    return StoredTables.get(spark, sf, "landed_claims", land)


@query
def landed_events(spark, sf):
    hour = F.col("date_hour").cast("string").rlike(r"^\d{4}-\d{2}-\d{2}-\d{2}$")
    return _landed(spark, sf).groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("landed"), F.count_if(hour).alias("filed"))


@query
def landed_claims(spark, sf):
    """Silver claims of both ways in: the bulk, with a nightly extract of the same events at other
    costs, and what the stream landed."""
    bulk = layers.bronze_claims(spark, sf).unionByName(
        testdata.nightly_claims(spark, sf), allowMissingColumns=True)
    both = cleaning.union_landing(bulk, cleaning.event_claims(_landed(spark, sf)))
    return cleaning.clean_prescriber_drug(both).drop("_silver_ts", "_silver_version")


# ---- governance and lineage ----------------------------------------------------------

@query
def audit_extract(spark, sf):
    return governance.audit_extract(testdata.access_log(spark, sf))


@query
def audit_view(spark, sf):
    return governance.get_phi_audit_logs(
        governance.audit_extract(testdata.access_log(spark, sf)), 50)


@query
def audit_archive(spark, sf):
    log = testdata.access_log(spark, sf)
    archive = log.filter(F.col("path") == "/api/rag/chat")
    return governance.archivable(log, archive, _at(ARCHIVE_NOW)).select("log_id", "path", "accessed_at")


@query
def request_counts(spark, sf):
    return governance.request_counts(testdata.access_log(spark, sf))


@query
def query_volume(spark, sf):
    """Statements by outcome, with their rows, from the log that running them wrote."""
    view, path = f"drugs_{uuid.uuid4().hex}", f"{fresh_path(spark, 'queries')}/log"
    _drugs(spark, sf).createOrReplaceTempView(view)
    for sql in (f"SELECT gnrc_name, total_claims FROM {view}",
                f"SELECT year, COUNT(*) FROM {view} GROUP BY year",
                f"SELECT gnrc_name FROM {view} WHERE total_claims < 0",
                f"DROP VIEW {view}", f"SELECT 1; DELETE FROM {view}",
                f"SELECT no_such_column FROM {view}"):
        guarded_sql.run_logged(spark, path, "analyst", "", sql)
    log = spark.read.schema(schemas.QUERY_LOG).parquet(path)
    return governance.query_volume(log).join(
        log.groupBy("status").agg(F.sum("row_count").alias("rows")), "status")


@query
def access_appended(spark, sf):
    """Accesses appended to the log in two batches, read back with the ids and times given there."""
    path = f"{fresh_path(spark, 'accesses')}/log"
    log = testdata.access_log(spark, sf).drop("log_id", "accessed_at")
    for failed in (True, False):
        governance.append_accesses(log.filter((F.col("status_code") >= 500) == failed), path)
    stored = spark.read.schema(schemas.ACCESS_LOG).parquet(path)
    return stored.groupBy("path", "status_code").agg(
        F.count(F.lit(1)).alias("accesses"), F.count_distinct("log_id").alias("ids"),
        F.count("accessed_at").alias("timed"), F.count("username").alias("named"))


@query
def access_rollup(spark, sf):
    return governance.access_rollup(testdata.access_log(spark, sf))


@query
def latency_quantiles(spark, sf):
    return governance.latency_quantiles(testdata.access_log(spark, sf))


def _lineage(spark, sf):
    """Run events of the layer build, with the rows its writes observed."""
    root = layers.built_lake(spark, sf).first()["root"]
    return spark.read.schema(schemas.LINEAGE_EVENT).parquet(f"{root}/lineage")


@query
def lineage_events(spark, sf):
    flat = _lineage(spark, sf)
    return flat.select(
        "job_name", "event_type", F.col("inputs")[0]["name"].alias("input"),
        F.col("inputs")[0]["row_count"].alias("rows_in"),
        F.try_element_at("outputs", F.lit(1))["name"].alias("output"),
        F.try_element_at("outputs", F.lit(1))["row_count"].alias("rows_out"))


@query
def lineage_summary(spark, sf):
    return lineage.graph_summary(_lineage(spark, sf))


@query
def lineage_upstream(spark, sf):
    return lineage.upstream_rows(_lineage(spark, sf), "lake/gold/state_kpi")


# ---- narratives ----------------------------------------------------------------------

@query
def insights(spark, sf):
    return narratives.insights(layers.gold_tables(spark, sf), REPORT_YEAR)


@query
def executive_summary(spark, sf):
    return narratives.executive_summary(layers.gold_tables(spark, sf), "weekly", REPORT_YEAR)


@query
def quality_explanation(spark, sf):
    return narratives.quality_explanation(layers.gold_tables(spark, sf), REPORT_YEAR, 1.5)


@query
def recommendations(spark, sf):
    return narratives.recommendations(layers.gold_tables(spark, sf), REPORT_YEAR)


@query
def answers(spark, sf):
    return narratives.answers(layers.gold_tables(spark, sf))


@query
def answered_questions(spark, sf):
    routed = corpus.route_questions(questions(spark, sf), "question").drop("question")
    return narratives.answer_questions(
        routed, narratives.answers(layers.gold_tables(spark, sf)))


@query
def report_markdown(spark, sf):
    return narratives.report_lines(layers.gold_tables(spark, sf), REPORT_YEAR)
