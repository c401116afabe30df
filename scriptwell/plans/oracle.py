"""Check SQL per query, over the same tables."""

from __future__ import annotations

import re

from scriptwell.fixed_values import (
    ANSWER_FORMATS,
    BRONZE_EXPECTATIONS,
    CONTRACT_MESSAGES,
    DUPLICATE_KEYS_FORMAT,
    INSIGHT_FORMATS,
    NO_DATA_TEXT,
    OUTLIER_FORMAT,
    PHI_COUNT_ONLY,
    PHI_PATTERNS,
    QUESTION_INTENTS,
    RECOMMENDATION_FORMATS,
    REPORT_SECTIONS,
    STATE_CODES,
    SUMMARY_FORMAT,
)
from scriptwell.plans import testdata as td
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
)
from scriptwell.schemas import LAYERS

ORACLE: dict[str, str] = {}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_quoted(v) for v in values) + "]"


def _half_up(expr: str, scale: int = 2) -> str:
    """Rounding of a double by its shortest decimal text, halves away from zero."""
    return f"CAST(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(30,{scale})) AS DOUBLE)"


def _exact(expr: str, digits: int) -> str:
    """Exact sum; the result is rounded, as not every value of this width is a double."""
    return f"ROUND(CAST(SUM(CAST({expr} AS DECIMAL(38,12))) AS DOUBLE), {digits})"


def _money(expr: str) -> str:
    return _exact(expr, 2)


def _mean(expr: str) -> str:
    return f"{_money(expr)} / CAST(COUNT({expr}) AS DOUBLE)"


def _count(expr: str = "COUNT(*)") -> str:
    return f"CAST({expr} AS BIGINT)"


_STATES = _list(td.NATION_STATES)
_SPECIALTY = ("CASE c_mktsegment " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in td.SPECIALTIES.items()) + " ELSE c_mktsegment END")

# ---- shared relations ----------------------------------------------------------------

CTE = {
    "people": f"""
        SELECT {td.NPI_BASE} + c_custkey AS prscrbr_npi, c_name AS prscrbr_last_org_name,
               'PAT' AS prscrbr_first_name, n_name AS prscrbr_city,
               lower(({_STATES})[c_nationkey + 1]) AS prscrbr_state_abrvtn,
               {_SPECIALTY} AS prscrbr_type
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "claims": f"""
        SELECT p.*, CASE WHEN p_partkey % 4 = 0 THEN ' ' || p_name ELSE p_brand END AS brnd_name,
               p_name AS gnrc_name, CAST(l_quantity AS INTEGER) AS tot_clms,
               l_quantity * 1.5 AS tot_30day_fills, l_extendedprice AS tot_drug_cst,
               CAST(l_quantity AS INTEGER) * 30 AS tot_day_suply,
               CAST(floor(CAST(l_quantity AS INTEGER) * 7 / 10) AS INTEGER) AS tot_benes,
               CAST(year(o_orderdate) AS INTEGER) AS year
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        JOIN people p ON p.prscrbr_npi = {td.NPI_BASE} + o_custkey""",
    "normal": """
        SELECT * REPLACE (upper(trim(prscrbr_state_abrvtn)) AS prscrbr_state_abrvtn,
                          upper(trim(gnrc_name)) AS gnrc_name, upper(trim(brnd_name)) AS brnd_name,
                          trim(prscrbr_type) AS prscrbr_type)
        FROM claims""",
    "fixed_case": """
        SELECT * REPLACE (array_to_string(list_transform(string_split(prscrbr_type, ' '),
            lambda w: upper(w[1]) || lower(w[2:])), ' ') AS prscrbr_type)
        FROM normal
        WHERE prscrbr_npi IS NOT NULL AND tot_clms >= 0 AND tot_drug_cst >= 0
          AND length(prscrbr_state_abrvtn) = 2""",
    "silver": f"""
        SELECT *, CASE WHEN tot_clms > 0 THEN {_half_up('tot_drug_cst / tot_clms')} ELSE 0.0 END
                      AS avg_cost_per_claim,
               coalesce(brnd_name = gnrc_name, false) AS is_generic
        FROM (SELECT * FROM fixed_case QUALIFY row_number() OVER (
            PARTITION BY prscrbr_npi, brnd_name, year
            ORDER BY prscrbr_last_org_name, prscrbr_first_name, prscrbr_city, prscrbr_state_abrvtn,
                     prscrbr_type, gnrc_name, tot_clms, tot_30day_fills, tot_drug_cst,
                     tot_day_suply, tot_benes) = 1)""",
    "silver_people": """
        SELECT * REPLACE (upper(trim(prscrbr_state_abrvtn)) AS prscrbr_state_abrvtn) FROM people""",
    "drug": f"""
        SELECT *, CAST(rank() OVER (PARTITION BY year ORDER BY total_cost_usd DESC) AS INTEGER)
                   AS cost_rank
        FROM (SELECT gnrc_name, brnd_name, year, is_generic,
                     {_count('SUM(tot_clms)')} AS total_claims,
                     {_money('tot_drug_cst')} AS total_cost_usd,
                     {_count('SUM(tot_benes)')} AS total_beneficiaries,
                     {_mean('avg_cost_per_claim')} AS avg_cost_per_claim,
                     COUNT(DISTINCT prscrbr_npi) AS unique_prescribers
              FROM silver GROUP BY ALL)""",
    "npi_totals": f"""
        SELECT prscrbr_npi, year, {_count('SUM(tot_clms)')} AS total_claims,
               {_money('tot_drug_cst')} AS total_cost_usd,
               {_count('SUM(tot_benes)')} AS total_beneficiaries,
               COUNT(DISTINCT gnrc_name) AS unique_drugs_prescribed,
               {_count('SUM(CASE WHEN is_generic THEN tot_clms ELSE 0 END)')} AS generic_claims
        FROM silver GROUP BY prscrbr_npi, year""",
    "prescriber": f"""
        SELECT *, {_half_up('CAST(generic_claims AS DOUBLE) / nullif(total_claims, 0) * 100')}
                      AS generic_rate,
               CAST(rank() OVER (PARTITION BY prscrbr_state_abrvtn, year
                                 ORDER BY total_cost_usd DESC) AS INTEGER) AS state_rank
        FROM npi_totals LEFT JOIN silver_people USING (prscrbr_npi)""",
    "state": f"""
        SELECT *, {_half_up('total_cost_usd / nullif(total_beneficiaries, 0)')}
                      AS cost_per_beneficiary,
               CAST(rank() OVER (PARTITION BY year ORDER BY total_cost_usd DESC) AS INTEGER)
                   AS national_rank
        FROM (SELECT prscrbr_state_abrvtn AS state_abrvtn, year,
                     {_count('SUM(tot_clms)')} AS total_claims,
                     {_money('tot_drug_cst')} AS total_cost_usd,
                     {_count('SUM(tot_benes)')} AS total_beneficiaries,
                     COUNT(DISTINCT prscrbr_npi) AS total_prescribers,
                     COUNT(DISTINCT gnrc_name) AS unique_drugs,
                     {_mean('avg_cost_per_claim')} AS avg_cost_per_claim,
                     {_count('''SUM(CASE WHEN lower(prscrbr_type) LIKE '%pain%'
                          OR lower(prscrbr_type) LIKE '%anesthesi%' THEN tot_clms ELSE 0 END)''')}
                         AS pain_specialty_claims
              FROM silver GROUP BY prscrbr_state_abrvtn, year)""",
    "claim_events": f"""
        SELECT CAST(event_id AS VARCHAR) AS claim_id, {td.NPI_BASE} + user_id AS prscrbr_npi,
               ({_STATES})[user_id % {len(td.NATION_STATES)} + 1] AS prscrbr_state_abrvtn,
               event_type AS gnrc_name, event_type IN ('purchase', 'error') AS is_opioid,
               value AS drug_cost_usd, ts AS event_time
        FROM events""",
    "access_log": f"""
        SELECT CAST(event_id AS VARCHAR) AS log_id,
               CASE WHEN event_type <> 'signup' THEN 'user' || user_id END AS username,
               CASE event_type {" ".join(
                   f"WHEN '{k}' THEN '{v[0]}'" for k, v in td.ACCESS_BY_EVENT.items())} END AS path,
               CASE event_type {" ".join(
                   f"WHEN '{k}' THEN '{v[1]}'" for k, v in td.ACCESS_BY_EVENT.items())} END AS method,
               CAST(CASE event_type {" ".join(
                   f"WHEN '{k}' THEN {v[2]}" for k, v in td.ACCESS_BY_EVENT.items())} END AS INTEGER)
                   AS status_code,
               value AS duration_ms, '10.0.0.' || (user_id % 250) AS client_ip, ts AS accessed_at
        FROM events""",
    "turns": """
        SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role,
               1704067200 + conv_id * 120 + turn * 600 AS spoken
        FROM conversations""",
    "counted": """
        SELECT *, COUNT(*) OVER (PARTITION BY prscrbr_npi ORDER BY event_time
            RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n
        FROM claim_events WHERE is_opioid""",
}

_SILVER = ["people", "claims", "normal", "fixed_case", "silver"]
_NEEDS = {
    "people": ["people"],
    "claims": ["people", "claims"],
    "normal": ["people", "claims", "normal"],
    "fixed_case": _SILVER[:-1],
    "silver": _SILVER,
    "silver_people": ["people", "silver_people"],
    "drug": [*_SILVER, "drug"],
    "npi_totals": [*_SILVER, "npi_totals"],
    "prescriber": [*_SILVER, "silver_people", "npi_totals", "prescriber"],
    "state": [*_SILVER, "state"],
    "counted": ["claim_events", "counted"],
}


def _add(name: str, needs: str, select: str, **extra: str) -> None:
    """Register a query over shared relations and further relations of its own."""
    names = dict.fromkeys(c for n in needs.split() for c in _NEEDS.get(n, [n]))
    relations = {c: CTE[c] for c in names} | extra
    ctes = ", ".join(f"{n} AS MATERIALIZED ({sql})" for n, sql in relations.items())
    ORACLE[name] = (f"WITH {ctes} " if ctes else "") + select


# ---- cleaning and staging ------------------------------------------------------------

_add("silver_clean", "silver", "SELECT *, '1.0' AS _silver_version FROM silver")
_add("silver_dedup", "silver",
     f"SELECT year, {_count()} AS claims, {_count('SUM(tot_clms)')} AS tot_clms "
     "FROM silver GROUP BY year")
_add("silver_prescribers", "silver_people", "SELECT * FROM silver_people")
_add("silver_drugs", "", "SELECT upper(trim(p_name)) AS gnrc_name, min(upper(trim(p_brand))) "
     "AS brnd_name FROM part GROUP BY 1")
_add("silver_states", "", f"""
    SELECT ({_STATES})[n_nationkey + 1] AS state_abrvtn, {_count()} AS rows
    FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
_STAGED = """
    SELECT prscrbr_npi AS prescriber_npi, brnd_name AS brand_name, gnrc_name AS generic_name,
           prscrbr_state_abrvtn AS prescriber_state, prscrbr_type AS prescriber_specialty,
           year AS claim_year, CAST(tot_clms AS BIGINT) AS total_claims,
           tot_drug_cst AS total_cost_usd, CAST(tot_benes AS BIGINT) AS total_beneficiaries,
           avg_cost_per_claim, is_generic
    FROM silver"""
_add("stage_claims", "silver", _STAGED)
_add("stage_prescribers", "silver_people", """
    SELECT prscrbr_npi AS prescriber_npi, prscrbr_last_org_name AS prescriber_last_name,
           prscrbr_first_name AS prescriber_first_name, prscrbr_city AS prescriber_city,
           prscrbr_state_abrvtn AS prescriber_state, prscrbr_type AS prescriber_specialty
    FROM silver_people""")
_add("classify_claims", "silver", f"""
    SELECT lower(prscrbr_type) LIKE '%pain%' OR lower(prscrbr_type) LIKE '%anesthesi%'
               AS is_pain_management_specialty,
           CASE WHEN avg_cost_per_claim < 20 THEN 'low' WHEN avg_cost_per_claim < 100 THEN 'medium'
                WHEN avg_cost_per_claim < 1000 THEN 'high' ELSE 'specialty_tier' END AS cost_tier,
           {_count()} AS claims
    FROM silver GROUP BY 1, 2""")
_add("landing_union", "normal", f"""
    SELECT year, {_count()} AS claim_keys
    FROM (SELECT DISTINCT prscrbr_npi, brnd_name, year FROM normal) GROUP BY year""")
_add("ingestion_summary", "people claims", f"""
    SELECT coalesce(t, 'TOTAL') AS "table", {_count('SUM(n)')} AS rows FROM (
        SELECT 'prescriber_drug' AS t, COUNT(*) AS n FROM claims
        UNION ALL SELECT 'prescriber', COUNT(*) FROM people
        UNION ALL SELECT 'drug', COUNT(*) FROM part
        UNION ALL SELECT 'state', COUNT(*) FROM nation LEFT JOIN supplier
            ON s_nationkey = n_nationkey) GROUP BY ROLLUP (t)""")

# ---- Gold ----------------------------------------------------------------------------

_add("layer_counts", "claims silver drug prescriber state", " UNION ALL ".join(
    f"SELECT '{layer}' AS layer, '{table}' AS \"table\", {_count()} AS rows FROM {relation}"
    for layer, table, relation in (
        ("bronze", "prescriber_drug", "claims"), ("bronze", "prescriber", "people"),
        ("bronze", "drug", "part"), ("bronze", "state", "state_rows"),
        ("silver", "prescriber_drug", "silver"), ("silver", "prescriber", "people"),
        ("silver", "drug", "(SELECT DISTINCT upper(trim(p_name)) FROM part)"),
        ("silver", "state", "state_rows"), ("gold", "drug_summary", "drug"),
        ("gold", "prescriber_summary", "prescriber"), ("gold", "state_kpi", "state"))),
     state_rows="SELECT s_suppkey FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey")
_add("layer_contract", "", f"""
    SELECT layer, t AS "table", verdict, CAST(n AS BIGINT) AS columns FROM (VALUES {", ".join(
        f"('{layer}', '{table}', 'ok', {len(s)})" for (layer, table), s in LAYERS.items())},
        ('gold', 'state_kpi', 'extra', 2)) v(layer, t, verdict, n)
    WHERE EXISTS (SELECT 1 FROM lineitem)""")
_add("layer_by_state", "silver prescriber", f"""
    SELECT * FROM (SELECT year, prscrbr_state_abrvtn, {_count()} AS claims,
                          {_count('SUM(tot_clms)')} AS tot_clms FROM silver GROUP BY ALL)
    JOIN (SELECT year, prscrbr_state_abrvtn, {_count()} AS people FROM prescriber GROUP BY ALL)
    USING (year, prscrbr_state_abrvtn)""")
_add("gated_claims", "silver", f"SELECT year, {_count()} AS claims FROM silver GROUP BY year")
_add("catalog_load", "drug", "SELECT * FROM drug")
_add("catalog_model", "silver", f"""
    SELECT CASE WHEN avg_cost_per_claim < 20 THEN 'low' WHEN avg_cost_per_claim < 100 THEN 'medium'
                WHEN avg_cost_per_claim < 1000 THEN 'high' ELSE 'specialty_tier' END AS cost_tier,
           {_count()} AS claims
    FROM silver WHERE year = {REPORT_YEAR} GROUP BY 1""")
_add("drug_summary", "drug", "SELECT * FROM drug")
_add("drug_summary_stored", "drug", "SELECT * FROM drug")
_add("drug_summary_sql", "drug", """
    SELECT gnrc_name AS generic_name, brnd_name AS brand_name, year AS claim_year, is_generic,
           total_claims, total_cost_usd, total_beneficiaries, unique_prescribers, cost_rank
    FROM drug""")
_add("prescriber_summary_left", "prescriber", "SELECT * FROM prescriber")
_add("prescriber_summary_inner", "prescriber",
     "SELECT * FROM prescriber WHERE prscrbr_last_org_name IS NOT NULL")
_add("state_kpi", "state", f"""
    SELECT state_abrvtn AS prscrbr_state_abrvtn, state.*, n_name AS state_name
    FROM state LEFT JOIN nation ON state_abrvtn = ({_STATES})[n_nationkey + 1]""")

# ---- serving -------------------------------------------------------------------------

_DRUG = ("gnrc_name, brnd_name, year, is_generic, total_claims, total_cost_usd, "
         "total_beneficiaries, avg_cost_per_claim, unique_prescribers, cost_rank")
_PEOPLE = ("prscrbr_npi, prscrbr_last_org_name, prscrbr_first_name, prscrbr_city, "
           "prscrbr_state_abrvtn, prscrbr_type, total_claims, total_cost_usd, "
           "total_beneficiaries, unique_drugs_prescribed, generic_rate, state_rank, year")
_Y = f"year = {REPORT_YEAR}"
_DRUG_ORDER = "ORDER BY total_cost_usd DESC, gnrc_name, brnd_name, year"
_STATE_ORDER = "ORDER BY total_cost_usd DESC, state_abrvtn, year"
_PEOPLE_ORDER = "ORDER BY total_cost_usd DESC, prscrbr_npi, year"

_add("top_drugs", "drug", f"SELECT {_DRUG} FROM drug {_DRUG_ORDER} LIMIT 50")
_add("top_drugs_of_year", "drug", f"SELECT {_DRUG} FROM drug WHERE {_Y} {_DRUG_ORDER} LIMIT 50")
_add("top_prescribers", "prescriber",
     f"SELECT {_PEOPLE} FROM prescriber {_PEOPLE_ORDER} LIMIT 100")
_add("top_prescribers_in_state", "prescriber",
     f"SELECT {_PEOPLE} FROM prescriber WHERE {_Y} AND prscrbr_state_abrvtn = 'CA' "
     f"{_PEOPLE_ORDER} LIMIT 100")
_add("states_by_cost", "state", "SELECT * FROM state")
_SPLIT = (f"SELECT is_generic, {_count('SUM(total_claims)')} AS total_claims, "
          f"{_money('total_cost_usd')} AS total_cost_usd FROM drug")
_add("generic_vs_brand", "drug", f"{_SPLIT} GROUP BY is_generic")
_add("labelled_split", "drug",
     "SELECT CASE WHEN is_generic THEN 'Generic' ELSE 'Brand Name' END AS name, "
     f"total_cost_usd AS value FROM ({_SPLIT} WHERE {_Y} GROUP BY is_generic)")
_add("drug_history", "drug",
     f"SELECT {_DRUG} FROM drug WHERE gnrc_name = upper('{DRUG_NAME}')")
_add("prescriber_history", "prescriber",
     f"SELECT * FROM prescriber WHERE prscrbr_npi = {td.NPI_BASE + 1}")
_add("prescriber_search", "prescriber", """
    SELECT prscrbr_npi, year, prscrbr_type, prscrbr_state_abrvtn FROM prescriber
    WHERE lower(prscrbr_first_name || ' ' || prscrbr_last_org_name) LIKE '%pain%'
       OR lower(prscrbr_state_abrvtn) LIKE '%pain%' OR lower(prscrbr_type) LIKE '%pain%'""")
_add("kpi_totals", "state", f"""
    SELECT {_money('total_cost_usd')} AS total_spend,
           {_count('SUM(total_beneficiaries)')} AS total_benes,
           {_count('SUM(total_claims)')} AS total_claims FROM state WHERE {_Y}""")
_add("avg_generic_rate", "prescriber",
     f"SELECT {_mean('generic_rate')} AS avg_generic_rate FROM prescriber")
_CARDS = f"""
    SELECT 'total_cost' AS metric, {_money('total_cost_usd')} AS value FROM s
    UNION ALL SELECT 'total_beneficiaries', CAST(SUM(total_beneficiaries) AS DOUBLE) FROM s
    UNION ALL SELECT 'total_claims', CAST(SUM(total_claims) AS DOUBLE) FROM s
    UNION ALL SELECT 'avg_generic_rate', {_half_up(_mean('coalesce(generic_rate, 0.0)'), 1)}
    FROM p"""
_add("kpi_cards", "state prescriber", _CARDS, s="FROM state", p="FROM prescriber")
_add("kpi_cards_top", "state prescriber", _CARDS,
     s=f"FROM state WHERE {_Y} {_STATE_ORDER} LIMIT 10",
     p=f"FROM prescriber WHERE {_Y} {_PEOPLE_ORDER} LIMIT 20")
_add("year_trend", "state",
     f"SELECT year, {_money('total_cost_usd')} AS total_cost_usd FROM state GROUP BY year")
_add("claim_share", "drug", f"""
    SELECT *, CAST(total_claims AS DOUBLE) / SUM(total_claims) OVER () AS claim_share
    FROM (SELECT is_generic, {_count('SUM(total_claims)')} AS total_claims
          FROM drug GROUP BY is_generic)""")
_add("opioid_by_state", "state", f"""
    SELECT state_abrvtn, pain_specialty_claims, total_claims FROM state WHERE {_Y}
    ORDER BY pain_specialty_claims DESC, state_abrvtn LIMIT 5""")
_add("avg_cost_by_state", "state", f"""
    SELECT state_abrvtn, avg_cost_per_claim, cost_per_beneficiary FROM state WHERE {_Y}
    ORDER BY avg_cost_per_claim DESC, state_abrvtn LIMIT 10""")


def _top_of(kind: str, name: str, table: str, order: str, n: int) -> str:
    return (f"(SELECT '{kind}' AS kind, {name} AS name, total_cost_usd FROM {table} "
            f"WHERE {_Y} {order} LIMIT {n})")


_add("snapshot_top5", "drug state", " UNION ALL ".join([
    _top_of("drug", "gnrc_name", "drug", _DRUG_ORDER, 5),
    _top_of("state", "state_abrvtn", "state", _STATE_ORDER, 5)]))
_add("report_top10", "drug state prescriber", " UNION ALL ".join([
    _top_of("drug", "gnrc_name", "drug", _DRUG_ORDER, 10),
    _top_of("state", "state_abrvtn", "state", _STATE_ORDER, 10),
    _top_of("prescriber", "prscrbr_last_org_name", "prescriber", _PEOPLE_ORDER, 10)]))


def _canned(key: str, measure: str, rows: str) -> str:
    return (f"SELECT '{key}' AS query, {_count()} AS rows, {_exact(measure, 4)} AS measure "
            f"FROM ({rows})")


_add("canned_queries", "drug state prescriber", " UNION ALL ".join([
    _canned("top_state", "total_cost_usd", f"FROM state WHERE {_Y} {_STATE_ORDER} LIMIT 5"),
    _canned("top_drugs", "total_cost_usd", f"FROM drug WHERE {_Y} {_DRUG_ORDER} LIMIT 10"),
    _canned("generic_vs_brand", "total_cost_usd", f"{_SPLIT} WHERE {_Y} GROUP BY is_generic"),
    _canned("top_prescribers", "total_cost_usd",
            f"FROM prescriber WHERE {_Y} {_PEOPLE_ORDER} LIMIT 10"),
    _canned("opioid_by_state", "pain_specialty_claims",
            f"FROM state WHERE {_Y} ORDER BY pain_specialty_claims DESC, state_abrvtn LIMIT 5"),
    _canned("avg_cost", "avg_cost_per_claim",
            f"FROM state WHERE {_Y} ORDER BY avg_cost_per_claim DESC, state_abrvtn LIMIT 10"),
]))
_add("guarded_sql_rows", "state",
     f"SELECT state_abrvtn, total_cost_usd FROM state WHERE {_Y} {_STATE_ORDER} LIMIT 200")
_add("prescriber_with_state", "prescriber state", """
    SELECT p.prscrbr_state_abrvtn, p.year, prscrbr_npi, p.total_cost_usd,
           s.total_cost_usd AS state_cost_usd, national_rank,
           p.total_cost_usd / nullif(s.total_cost_usd, 0) AS state_cost_share
    FROM prescriber p LEFT JOIN state s
      ON s.state_abrvtn = p.prscrbr_state_abrvtn AND s.year = p.year""")
_add("drug_with_year", "drug state", f"""
    SELECT year, gnrc_name, brnd_name, is_generic, total_cost_usd, national_cost_usd,
           national_beneficiaries
    FROM drug LEFT JOIN (SELECT year, {_money('total_cost_usd')} AS national_cost_usd,
        {_count('SUM(total_beneficiaries)')} AS national_beneficiaries FROM state GROUP BY year)
    USING (year)""")
_add("masked_view", "prescriber", """
    SELECT '***MASKED***' AS prscrbr_npi, '***MASKED***' AS prscrbr_last_org_name, year,
           total_cost_usd FROM prescriber""")
_add("region_view", "prescriber", f"""
    SELECT prscrbr_npi, year, prscrbr_state_abrvtn, total_cost_usd FROM prescriber
    WHERE prscrbr_state_abrvtn IN (
        SELECT ({_STATES})[n_nationkey + 1] FROM nation JOIN region ON n_regionkey = r_regionkey
        WHERE r_name = 'AFRICA')""")

# ---- findings ------------------------------------------------------------------------

_SAVINGS = f"""
    SELECT b.brnd_name, b.gnrc_name, b.year, b.avg_cost_per_claim AS brand_cost,
           g.avg_cost_per_claim AS generic_cost,
           {_half_up('(b.avg_cost_per_claim - g.avg_cost_per_claim) * b.total_claims', 0)}
               AS potential_savings
    FROM drug b JOIN drug g ON b.gnrc_name = g.gnrc_name AND b.year = g.year
    WHERE NOT b.is_generic AND g.is_generic
      AND b.avg_cost_per_claim > g.avg_cost_per_claim * 1.2
    QUALIFY row_number() OVER (PARTITION BY b.year ORDER BY potential_savings DESC, b.gnrc_name,
                               b.brnd_name) <= 10"""
_add("savings_candidates", "drug", _SAVINGS)
_add("total_savings", "drug",
     f"SELECT year, SUM(potential_savings) AS total_potential_savings FROM ({_SAVINGS}) "
     "GROUP BY year")
_add("low_adoption_states", "prescriber", f"""
    SELECT year, state AS prscrbr_state_abrvtn, {_half_up('group_mean', 1)} AS state_generic_rate,
           {_half_up('global_mean', 1)} AS national_avg_rate
    FROM (SELECT year, state, {_mean('rate')} AS group_mean FROM r GROUP BY year, state)
    JOIN (SELECT year, {_mean('rate')} AS global_mean FROM r GROUP BY year) USING (year)
    WHERE group_mean < global_mean * 0.95
    QUALIFY row_number() OVER (PARTITION BY year ORDER BY state_generic_rate, state) <= 8""",
     r="SELECT year, coalesce(prscrbr_state_abrvtn, 'Unknown') AS state, "
       "coalesce(generic_rate, 0.0) AS rate FROM prescriber")
_OUTLIERS = f"""
    SELECT state_abrvtn, year, total_cost_usd, cost_per_beneficiary,
           {_half_up('(total_cost_usd - m) / d')} AS z_score
    FROM state JOIN (SELECT year, AVG(total_cost_usd) AS m, stddev_samp(total_cost_usd) AS d,
                            COUNT(*) AS n FROM state GROUP BY year) USING (year)
    WHERE n >= 3 AND d > 0 AND abs({_half_up('(total_cost_usd - m) / d')}) >= {OUTLIER_CUT}"""
_add("zscore_outliers", "state", _OUTLIERS)


def _repeated(table: str, relation: str, keys: str) -> str:
    return (f"SELECT '{table}' AS \"table\", {_count()} AS duplicate_key_groups FROM "
            f"(SELECT 1 FROM {relation} GROUP BY {keys} HAVING COUNT(*) > 1)")


_REPEATED = " UNION ALL ".join([
    _repeated("drug_summary", "drug", "gnrc_name, brnd_name, year"),
    _repeated("prescriber_summary", "prescriber", "prscrbr_npi, year"),
    _repeated("state_kpi", "state", "state_abrvtn, year")])
_add("duplicate_groups", "drug prescriber state", _REPEATED)
_add("quality_status", "drug prescriber state", f"""
    SELECT anomalies, duplicates,
           CASE WHEN anomalies + duplicates > 0 THEN 'issues_found' ELSE 'healthy' END AS status
    FROM (SELECT {_count()} AS anomalies FROM ({_OUTLIERS}))
    CROSS JOIN (SELECT {_count('SUM(duplicate_key_groups)')} AS duplicates FROM ({_REPEATED}))""")

# ---- data quality --------------------------------------------------------------------

_CODES = "(" + ", ".join(_quoted(s) for s in STATE_CODES) + ")"
_N = "format('{:,}', m)"


def _check(suite, table, name, severity, relation, measure, passed, details) -> str:
    return (f"SELECT {_quoted(suite)} AS suite, {_quoted(table)} AS \"table\", "
            f"{_quoted(name)} AS check_name, {passed} AS passed, '{severity}' AS severity, "
            f"{details} AS details FROM (SELECT {measure} AS m FROM {relation})")


def _none(suite, table, name, severity, relation, condition, label="Unexpected rows") -> str:
    return _check(suite, table, name, severity, relation, f"COUNT(*) FILTER (WHERE {condition})",
                  "m = 0", f"{_quoted(label + ': ')} || {_N}")


def _surplus(suite, table, name, severity, relation, keys, label) -> str:
    packed = ", ".join(f"coalesce(CAST({k} AS VARCHAR), '?')" for k in keys)
    return _check(suite, table, name, severity, relation,
                  f"COUNT(*) - COUNT(DISTINCT ({packed}, 0))", "m = 0",
                  f"{_quoted(label + ': ')} || {_N}")


_KEY = ["prscrbr_npi", "brnd_name", "year"]
_BRONZE = []
for _table, _relation in (("prescriber_drug", "claims"), ("prescriber", "people"),
                          ("drug", "(SELECT p_name AS gnrc_name FROM part)"),
                          ("state", f"(SELECT ({_STATES})[n_nationkey + 1] AS state_abrvtn FROM "
                                    "nation LEFT JOIN supplier ON s_nationkey = n_nationkey)")):
    _pk, _floor = BRONZE_EXPECTATIONS[_table]
    _BRONZE += [
        _check("bronze", _table, "table_not_empty", "critical", _relation, "COUNT(*)", "m > 0",
               f"'Row count: ' || {_N}"),
        _none("bronze", _table, f"no_null_{_pk}", "critical", _relation, f"{_pk} IS NULL",
              f"Null {_pk} count"),
        _check("bronze", _table, "row_count_not_dropped", "critical", _relation, "COUNT(*)",
               f"m >= {_floor}", f"'Row count ' || {_N} || ' vs expected minimum {_floor:,}'"),
    ]
_add("dq_bronze_suite", "people claims", " UNION ALL ".join(_BRONZE))

_P = ("silver", "prescriber_drug")
_SUITE = [
    _check(*_P, "required_columns_present", "critical", "silver", "COUNT(*)", "true",
           "'All required columns present'"),
    _surplus(*_P, "no_duplicate_keys", "warning", "silver", _KEY,
             "Duplicate rows on prscrbr_npi, brnd_name, year"),
    _none(*_P, "tot_clms_in_range", "warning", "silver", "tot_clms < 0 OR tot_clms > 10000000",
          "Rows outside [0, 10000000]"),
    _none(*_P, "avg_cost_per_claim_in_range", "warning", "silver",
          "avg_cost_per_claim < 0 OR avg_cost_per_claim > 500000", "Rows outside [0, 500000]"),
    _none(*_P, "valid_state_codes", "warning", "silver", f"prscrbr_state_abrvtn NOT IN {_CODES}",
          "Rows with invalid state code"),
]
_add("dq_silver_suite", "silver", " UNION ALL ".join(_SUITE))

_E = ("silver_expectations", "prescriber_drug")


def _expect(suite, table, relation, kind, column, condition) -> str:
    return _none(suite, table, f"expect_{kind}({column})", "critical", relation, condition)


def _null(suite, table, relation, column) -> str:
    return _expect(suite, table, relation, "column_values_to_not_be_null", column,
                   f"{column} IS NULL")


def _outside(suite, table, relation, column, condition) -> str:
    return _expect(suite, table, relation, "column_values_to_be_between", column, condition)


def _unique(suite, table, relation, keys) -> str:
    listed = ", ".join(keys)
    return _surplus(suite, table, f"expect_compound_columns_to_be_unique({listed})", "critical",
                    relation, keys, f"Duplicate rows on {listed}")


_EXPECTED = [
    *[_check(*_E, f"expect_column_to_exist({c})", "critical", "silver", "COUNT(*)", "true",
             "'present'")
      for c in ("prscrbr_npi", "gnrc_name", "tot_clms", "tot_drug_cst", "avg_cost_per_claim")],
    _null(*_E, "silver", "prscrbr_npi"),
    _null(*_E, "silver", "gnrc_name"),
    _unique(*_E, "silver", _KEY),
    _outside(*_E, "silver", "tot_clms", "tot_clms < 0 OR tot_clms > 10000000"),
    _outside(*_E, "silver", "tot_drug_cst", "tot_drug_cst < 0 OR tot_drug_cst > 1000000000"),
    _outside(*_E, "silver", "avg_cost_per_claim",
             "avg_cost_per_claim < 0 OR avg_cost_per_claim > 500000"),
    _expect(*_E, "silver", "column_values_to_match_regex", "prscrbr_state_abrvtn",
            "NOT regexp_matches(prscrbr_state_abrvtn, '^[A-Z]{2}$')"),
    _expect(*_E, "silver", "column_values_to_be_in_set", "is_generic",
            "is_generic NOT IN (true, false)"),
    _check(*_E, "expect_column_mean_to_be_between(avg_cost_per_claim)", "critical", "silver",
           _mean("avg_cost_per_claim"), "m BETWEEN 1 AND 5000", "'Mean: ' || format('{:.2f}', m)"),
    _check(*_E, "expect_table_row_count_to_be_between", "critical", "silver", "COUNT(*)",
           "m BETWEEN 15000000 AND 50000000", f"'Row count: ' || {_N}"),
]
_add("dq_silver_expectations", "silver", " UNION ALL ".join(_EXPECTED))


def _model(table: str, relation: str, not_null, ranges=(), unique=(), codes=False) -> list[str]:
    tests = [_null("model_tests", table, relation, c) for c in not_null]
    tests += [_outside("model_tests", table, relation, c, cond) for c, cond in ranges]
    if unique:
        tests.append(_unique("model_tests", table, relation, list(unique)))
    if codes:
        tests.append(_expect("model_tests", table, relation, "column_values_to_be_in_set",
                             "state_abrvtn", f"state_abrvtn NOT IN {_CODES}"))
    return tests


_MODELS = [
    *_model("silver_prescriber_drug", "silver", ["prscrbr_npi", "gnrc_name"],
            [("tot_drug_cst", "tot_drug_cst < 0")]),
    *_model("silver_prescriber", "silver_people", ["prscrbr_npi"], unique=["prscrbr_npi"]),
    *_model("drug_summary", "drug", ["gnrc_name", "year", "total_cost_usd", "cost_rank"],
            [("total_cost_usd", "total_cost_usd < 0"), ("cost_rank", "cost_rank < 1")]),
    *_model("state_kpi", "state", ["state_abrvtn", "total_cost_usd", "national_rank"],
            unique=["state_abrvtn", "year"], codes=True),
    *_model("prescriber_summary", "prescriber", ["prscrbr_npi"],
            [("generic_rate", "generic_rate < 0 OR generic_rate > 100")],
            unique=["prscrbr_npi", "year"]),
]
_add("dq_gold_tests", "drug state prescriber", " UNION ALL ".join(_MODELS))
_LOST = ("total_cost_usd", "national_rank")
_add("dq_absent_column", "state", " UNION ALL ".join([
    *_model("state_kpi", "state", ["state_abrvtn"], unique=["state_abrvtn", "year"], codes=True),
    *[_check("model_tests", "state_kpi", f"expect_column_values_to_not_be_null({c})", "critical",
             "state", "COUNT(*)", "false", f"'Column absent: {c}'") for c in _LOST]]))
_C = ("declared_claims", "claims", "claim_events")


def _unique_values(suite, table, relation, column) -> str:
    return _check(suite, table, f"expect_column_values_to_be_unique({column})", "critical",
                  relation, f"COUNT({column}) - COUNT(DISTINCT {column})", "m = 0",
                  f"'Surplus rows: ' || {_N}")


_add("dq_declared", "claim_events drug prescriber state", " UNION ALL ".join([
    _null(*_C, "claim_id"),
    _unique_values(*_C, "claim_id"),
    _outside(*_C, "drug_cost_usd", "drug_cost_usd < 0.01 OR drug_cost_usd > 100000"),
    _expect(*_C, "column_values_to_match_regex", "prscrbr_npi",
            "NOT regexp_matches(CAST(prscrbr_npi AS VARCHAR), '^[0-9]{10}$')"),
    _expect(*_C, "column_values_to_be_in_set", "prscrbr_state_abrvtn",
            f"prscrbr_state_abrvtn NOT IN {_CODES}"),
    _unique("declared_gold", "drug_summary", "drug", ["gnrc_name", "year"]),
    _null("declared_gold", "drug_summary", "drug", "total_cost_usd"),
    _outside("declared_gold", "prescriber_summary", "prescriber", "generic_rate",
             "generic_rate < 0 OR generic_rate > 100"),
    _unique_values("declared_gold", "state_kpi", "state", "state_abrvtn"),
    _check("declared_gold", "state_kpi", "expect_column_min_to_be_greater_than(total_claims)",
           "critical", "state", "MIN(total_claims)", "m > 1000",
           "'Min: ' || format('{:.2f}', CAST(m AS DOUBLE))"),
]))
_add("dq_scorecard", "drug state prescriber", f"""
    SELECT coalesce(suite, 'TOTAL') AS suite, {_count()} AS total,
           COUNT(*) FILTER (WHERE passed) AS passed, COUNT(*) FILTER (WHERE NOT passed) AS failed,
           COUNT(*) FILTER (WHERE NOT passed AND severity = 'critical') AS critical_failures,
           COUNT(*) FILTER (WHERE NOT passed AND severity = 'warning') AS warnings
    FROM ({" UNION ALL ".join([*_SUITE, *_EXPECTED, *_MODELS])}) GROUP BY ROLLUP (suite)""")
_add("generic_cost_sanity", "drug", """
    SELECT gnrc_name, year, avg_cost_per_claim FROM drug
    WHERE is_generic AND avg_cost_per_claim > 10000""")
_add("cost_without_prescribers", "state", """
    SELECT state_abrvtn, year, total_cost_usd, total_prescribers FROM state
    WHERE total_cost_usd > 0 AND total_prescribers = 0""")

# ---- text ----------------------------------------------------------------------------


def _redaction(table: str, key: str, column: str) -> tuple[str, str, str]:
    """(steps as relation, last text, list of (category, count) structs)."""
    steps, text, counts = f"SELECT {key}, {column} AS t0 FROM {table}", "t0", []
    for i, (label, pattern) in enumerate(PHI_PATTERNS.items(), start=1):
        counts.append(f"{{'category': '{label}', 'n': CAST(len(regexp_extract_all({text}, "
                      f"{_quoted(pattern)})) AS INTEGER)}}")
        if label not in PHI_COUNT_ONLY:
            steps = (f"SELECT *, regexp_replace({text}, {_quoted(pattern)}, "
                     f"'[REDACTED:{label.upper()}]', 'g') AS t{i} FROM ({steps})")
            text = f"t{i}"
    return steps, text, "[" + ", ".join(counts) + "]"


_STEPS, _LAST, _FOUND = _redaction("documents", "doc_id", "text")
_add("phi_redact", "", f"""
    SELECT doc_id, {_LAST} AS redacted,
           CAST(list_sum(list_transform({_FOUND}, lambda f: f.n)) AS INTEGER) AS total_found
    FROM ({_STEPS})""")
_add("phi_findings", "", f"""
    SELECT doc_id, f.category AS category, f.n AS n
    FROM (SELECT doc_id, unnest({_FOUND}) AS f FROM ({_STEPS})) WHERE f.n > 0""")
_PSTEPS, _PLAST, _PFOUND = _redaction("pages", "page_id", "html")
_add("phi_corpus_totals", "", f"""
    SELECT f.category AS category, {_count('SUM(f.n)')} AS found, {_count()} AS texts
    FROM (SELECT unnest({_PFOUND}) AS f FROM ({_PSTEPS})) WHERE f.n > 0 GROUP BY 1""")
_add("safe_text_split", "", f"""
    SELECT coalesce(trim({_LAST}) <> '', false) AS is_safe, {_count()} AS texts,
           {_count(f'SUM(list_sum(list_transform({_FOUND}, lambda f: f.n)))')} AS found
    FROM ({_STEPS}) GROUP BY 1""")


def _chunked(table: str, key: str, extra: str, size: int, overlap: int) -> str:
    stride = size - overlap
    return f"""
    SELECT CAST({key} AS VARCHAR) AS source_id, {extra}, CAST(i AS INTEGER) AS chunk_no,
           CASE WHEN len(w) <= {size} THEN text
                ELSE array_to_string(w[i * {stride} + 1 : i * {stride} + {size}], ' ') END AS chunk,
           {key} || '_chunk' || i AS chunk_id
    FROM (SELECT *, unnest(range(0, CASE WHEN len(w) <= {size} THEN 1
                 ELSE CAST(ceil((len(w) - {size}) / {stride}.0) AS BIGINT) + 1 END)) AS i
          FROM (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w
                FROM {table}))"""


_add("chunks", "", _chunked("documents", "doc_id", "source", 200, 30))
_add("chunks_small", "", _chunked("conversations", "conv_id", "turn", *SMALL_CHUNK))

_ASKED = " ".join(f"WHEN {k} THEN {_quoted(v)}" for k, v in QUESTION_BY_TURN.items())
_INTENT = " ".join(
    "WHEN " + " AND ".join(f"list_has_any(w, {_list(g)})" for g in groups) + f" THEN '{name}'"
    for name, groups in QUESTION_INTENTS)
_ROUTED = f"""
    SELECT conv_id, turn, CASE {_INTENT} END AS intent,
           coalesce(TRY_CAST(regexp_extract(q, '\\b(20\\d{{2}})\\b', 1) AS INTEGER), 2024) AS year
    FROM (SELECT *, regexp_extract_all(lower(q), '[a-z]+') AS w
          FROM (SELECT conv_id, turn, text || ' ' || coalesce(CASE turn {_ASKED} END, '') AS q
                FROM conversations))"""
_add("intent_route", "", _ROUTED)
_add("token_overlap", "", f"""
    SELECT doc_id, question_no FROM (
        SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS w
        FROM documents), (VALUES {", ".join(
            f"({i}, {_list(q.lower().split())})" for i, q in enumerate(OVERLAP_QUESTIONS))})
        asked(question_no, words)
    WHERE list_has_any(w, words)""")

_add("token_overlap_table", "", """
    SELECT doc_id, question_id, COUNT(*) AS shared
    FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text),
              '[\\p{L}\\p{M}\\p{N}_]+')) AS token FROM documents)
    JOIN (SELECT DISTINCT conv_id || '-' || turn AS question_id, unnest(regexp_extract_all(
              lower(text), '[\\p{L}\\p{M}\\p{N}_]+')) AS token
          FROM conversations WHERE conv_id % 20 = 0) USING (token)
    GROUP BY doc_id, question_id""")

# ---- retrieval -----------------------------------------------------------------------

_ASK = {
    "asked": """
        SELECT 'mean' AS question_id, list(x ORDER BY pos) AS q FROM (
            SELECT pos, AVG(CAST(x AS DOUBLE)) AS x FROM (
                SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos
                FROM embeddings) GROUP BY pos)
        UNION ALL SELECT 'first_axis', list_transform(range(1, d + 1),
            lambda i: CASE WHEN i = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
        FROM (SELECT MAX(len(embedding)) AS d FROM embeddings)
        UNION ALL SELECT 'diagonal', list_transform(range(1, d + 1), lambda i: 1.0::DOUBLE)
        FROM (SELECT MAX(len(embedding)) AS d FROM embeddings)""",
    "scored": """
        SELECT question_id, vec_id, label, CAST(vec_id AS VARCHAR) AS id,
               'document ' || vec_id AS document,
               list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS s
        FROM embeddings CROSS JOIN asked""",
}


def _best(k: int, condition: str = "true") -> str:
    return (f"SELECT question_id, id, document, label, vec_id, round(s, 4) AS similarity, "
            f"CAST(row_number() OVER (PARTITION BY question_id ORDER BY s DESC, id) AS INTEGER) "
            f"AS rank FROM scored WHERE {condition} QUALIFY rank <= {k}")


_HIT = "SELECT question_id, id, document, similarity, rank FROM"
_add("knn_topk", "", f"{_HIT} ({_best(5)})", **_ASK)
_add("knn_filtered", "", f"{_HIT} ({_best(5, 'label = 3')})", **_ASK)
_add("knn_threshold", "", f"{_HIT} ({_best(3)}) WHERE similarity >= 0.25", **_ASK)


def _joined(name: str, value: str, label: int, counted: str) -> str:
    return (f"LEFT JOIN (SELECT question_id, string_agg({value}, '|' ORDER BY rank) AS {name}, "
            f"COUNT(*) AS {counted} FROM ({_best(3, f'label = {label}')}) "
            f"WHERE similarity >= 0.25 GROUP BY question_id) USING (question_id)")


_add("context_bundle", "", f"""
    SELECT question_id, coalesce(domain_knowledge, '') AS domain_knowledge,
           coalesce(tables, '') AS tables, coalesce(sqls, '') AS sqls,
           CAST(coalesce(k, 0) AS INTEGER) AS knowledge_chunks,
           CAST(coalesce(t, 0) AS INTEGER) AS schema_chunks,
           CAST(coalesce(h, 0) AS INTEGER) AS query_examples
    FROM asked {_joined('domain_knowledge', 'document', 0, 'k')}
    {_joined('tables', 'id', 1, 't')} {_joined('sqls', 'id', 2, 'h')}""", **_ASK)
_add("semantic_cache", "", f"""
    SELECT question_id, id, 'SELECT ' || id AS generated_sql, document AS summary,
           CAST(label AS BIGINT) AS row_count, true AS from_cache, similarity AS cache_similarity
    FROM ({_best(1)}) WHERE similarity >= 0.25 AND vec_id * 5 <= 900""", **_ASK)
_TABLE = _ASK | {"asked": """
        SELECT CAST(vec_id AS VARCHAR) AS question_id, CAST(embedding AS DOUBLE[]) AS q
        FROM embeddings WHERE vec_id % 20 = 0"""}
_add("knn_question_table", "", f"{_HIT} ({_best(5)})", **_TABLE)
_add("context_bundle_table", "", f"""
    SELECT question_id, CAST(coalesce(k, 0) AS INTEGER) AS knowledge_chunks,
           CAST(coalesce(t, 0) AS INTEGER) AS schema_chunks,
           CAST(coalesce(h, 0) AS INTEGER) AS query_examples
    FROM asked {_joined('domain_knowledge', 'document', 0, 'k')}
    {_joined('tables', 'id', 1, 't')} {_joined('sqls', 'id', 2, 'h')}""", **_TABLE)
_add("semantic_cache_table", "", f"""
    SELECT question_id, id, 'SELECT ' || id AS generated_sql, document AS summary,
           CAST(label AS BIGINT) AS row_count, true AS from_cache, similarity AS cache_similarity
    FROM ({_best(1)}) WHERE similarity >= 0.93 AND vec_id * 5 <= 900""", **_TABLE)
_add("cache_evict", "", """
    SELECT CAST(vec_id AS VARCHAR) AS id, 'document ' || vec_id AS document
    FROM embeddings WHERE vec_id * 5 <= 900""")
_add("cache_write", "", """
    SELECT 'document ' || vec_id AS document, 'SELECT ' || vec_id AS sql,
           CAST(vec_id AS VARCHAR) AS row_count FROM embeddings""")
_add("upsert_docs", "", """
    SELECT CAST(vec_id AS VARCHAR) AS id,
           CASE WHEN label = 3 THEN 'new ' ELSE '' END || 'document ' || vec_id AS document
    FROM embeddings""")
_add("collection_count", "", f"SELECT {_count()} AS documents FROM embeddings")

# ---- sessions ------------------------------------------------------------------------

_NEWEST = "row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 4"
_add("last_n_turns", "turns", f"SELECT session_id, turn, role FROM turns QUALIFY {_NEWEST}")
_add("context_turns", "turns", f"""
    SELECT session_id, CAST(COUNT(*) AS INTEGER) AS n,
           string_agg(turn || ':' || role, ',' ORDER BY turn) AS roles
    FROM (SELECT * FROM turns QUALIFY {_NEWEST}) GROUP BY session_id""")
_IDLE = (f"SELECT session_id, CAST(epoch(TIMESTAMP '{SESSIONS_NOW}') AS BIGINT) - MAX(spoken) "
         "AS idle_seconds FROM turns GROUP BY session_id HAVING idle_seconds > 3600")
_add("idle_sessions", "turns", _IDLE)
_add("evict_idle", "turns", f"SELECT session_id, turn FROM turns WHERE session_id NOT IN "
     f"(SELECT session_id FROM ({_IDLE}))")

# ---- surveillance --------------------------------------------------------------------

_SEVERITY = f"CASE WHEN n > {THRESHOLD} * 1.5 THEN 'high' ELSE 'medium' END"
_add("trailing_count", "counted",
     "SELECT claim_id, prscrbr_npi, n AS claim_count_in_window FROM counted")
_add("opioid_alerts", "counted", f"""
    SELECT 'opioid_overutilization' AS alert_type, prscrbr_npi, prscrbr_state_abrvtn,
           n AS claim_count_in_window, 1440 AS window_minutes, {THRESHOLD} AS threshold,
           {_SEVERITY} AS severity
    FROM counted WHERE n >= {THRESHOLD}""")
_add("active_alerts", "counted", f"""
    SELECT {_SEVERITY} AS severity, {_count()} AS alerts,
           COUNT(*) FILTER (WHERE prscrbr_state_abrvtn >= 'C') AS active,
           {_count("SUM(CASE WHEN prscrbr_state_abrvtn >= 'C' THEN n ELSE 0 END)")}
               AS active_claims
    FROM counted WHERE n >= {THRESHOLD} GROUP BY 1""")
_M = CONTRACT_MESSAGES
_add("contract_errors_per_event", "claim_events", f"""
    SELECT claim_id, CASE WHEN claim_id LIKE '%99' THEN 'malformed JSON' ELSE
        array_to_string(list_filter([
            CASE WHEN gnrc_name = 'signup' THEN '{_M["missing"] % "prscrbr_npi"}' END,
            CASE WHEN gnrc_name = 'click' THEN '{_M["missing"] % "brnd_name"}' END,
            CASE WHEN prscrbr_state_abrvtn NOT IN {_CODES}
                 THEN '{_M["state"] % ""}' || prscrbr_state_abrvtn END,
            CASE WHEN drug_cost_usd > 400 THEN '{_M["negative_cost"]}' END,
            CASE WHEN gnrc_name = 'view' THEN '{_M["timestamp"]}' END
        ], lambda x: x IS NOT NULL), '; ') END AS errors
    FROM claim_events""")
_VALID = (f"claim_id NOT LIKE '%99' AND gnrc_name NOT IN ('signup', 'click', 'view') "
          f"AND prscrbr_state_abrvtn IN {_CODES} AND drug_cost_usd <= 400")
_add("routed_claims", "claim_events", f"""
    SELECT CASE WHEN {_VALID} THEN 'valid' ELSE 'invalid' END AS side, {_count()} AS events
    FROM claim_events GROUP BY 1""")
_add("published_claims", "claim_events", f"""
    SELECT prscrbr_state_abrvtn AS key, {_count()} AS messages, {_count()} AS stamped
    FROM claim_events WHERE {_VALID} GROUP BY 1""")
_add("stream_alerts", "claim_events", f"""
    SELECT CAST(prscrbr_npi AS VARCHAR) AS key, prscrbr_state_abrvtn,
           CAST(n AS VARCHAR) AS claim_count_in_window, {_SEVERITY} AS severity
    FROM (SELECT *, COUNT(*) OVER (PARTITION BY prscrbr_npi ORDER BY date_trunc('second', event_time)
              RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n
          FROM claim_events WHERE is_opioid AND {_VALID})
    WHERE n >= {THRESHOLD}""")

_add("stream_late_rows", "claim_events", """
    SELECT claim_id, coalesce(et <= newest - INTERVAL 60 MINUTES, false) AS late
    FROM timed JOIN marks USING (arrival)""",
     timed=f"""
        SELECT claim_id, date_trunc('second', event_time) AS et,
               floor(epoch(event_time) / (8 * 86400))
                   + CASE WHEN CAST(claim_id AS BIGINT) % 50 = 0 THEN 1 ELSE 0 END AS arrival
        FROM claim_events WHERE {_VALID}""",
     marks="""
        SELECT arrival, MAX(MAX(et)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING
                                           AND 1 PRECEDING) AS newest
        FROM timed GROUP BY arrival""")
_add("landed_events", "claim_events", f"""
    SELECT claim_id, {_count('1')} AS landed, {_count('1')} AS filed
    FROM claim_events WHERE {_VALID}""")
_ORDERED = ", ".join(f"{c} NULLS FIRST" for c in (
    "prscrbr_last_org_name", "prscrbr_first_name", "prscrbr_city", "prscrbr_state_abrvtn",
    "prscrbr_type", "gnrc_name", "tot_clms", "tot_30day_fills", "tot_drug_cst", "tot_day_suply",
    "tot_benes"))
_add("landed_claims", "claims claim_events", f"""
    SELECT *, CASE WHEN tot_clms > 0 THEN {_half_up('tot_drug_cst / tot_clms')} ELSE 0.0 END
                  AS avg_cost_per_claim,
           coalesce(brnd_name = gnrc_name, false) AS is_generic
    FROM (SELECT * FROM both_fixed QUALIFY row_number() OVER (
        PARTITION BY prscrbr_npi, brnd_name, year ORDER BY {_ORDERED}) = 1)""",
     both_ways=f"""
        SELECT * FROM claims UNION ALL BY NAME
        SELECT {td.NPI_BASE} + user_id AS prscrbr_npi, 'user' || user_id AS prscrbr_last_org_name,
               lower(({_STATES})[user_id % {len(td.NATION_STATES)} + 1]) AS prscrbr_state_abrvtn,
               event_type || '-brand ' AS brnd_name, event_type AS gnrc_name, 1 AS tot_clms,
               value * 2 AS tot_drug_cst, CAST(year(ts) AS INTEGER) AS year
        FROM events WHERE event_id % 3 = 0 UNION ALL BY NAME
        SELECT prscrbr_npi, prscrbr_state_abrvtn, gnrc_name || '-brand' AS brnd_name, gnrc_name,
               1 AS tot_clms, drug_cost_usd AS tot_drug_cst,
               CAST(year(event_time) AS INTEGER) AS year
        FROM claim_events WHERE {_VALID}""",
     both_normal=CTE["normal"].replace("FROM claims", "FROM both_ways").replace(
         "REPLACE (", "REPLACE (coalesce(tot_benes, 0) AS tot_benes, "),
     both_fixed=CTE["fixed_case"].replace("FROM normal", "FROM both_normal"))

# ---- governance ----------------------------------------------------------------------

_AUDITED = f"""
    SELECT log_id, username, path, method, status_code, {_half_up('duration_ms')} AS duration_ms,
           client_ip, accessed_at
    FROM access_log WHERE path LIKE '/api/prescribers/%' OR path LIKE '/api/ai/%'
                       OR path LIKE '/api/rag/%'"""
_add("audit_extract", "access_log", _AUDITED)
_add("audit_view", "access_log",
     f"SELECT * FROM ({_AUDITED}) ORDER BY accessed_at DESC, log_id LIMIT 50")
_add("audit_archive", "access_log", f"""
    SELECT log_id, path, accessed_at FROM access_log
    WHERE accessed_at < TIMESTAMP '{ARCHIVE_NOW}' - INTERVAL 6 YEARS
      AND path <> '/api/rag/chat'""")
_add("request_counts", "access_log", f"""
    SELECT method, path, status_code, {_count()} AS requests FROM access_log GROUP BY ALL""")
_add("query_volume", "drug", """
    SELECT 'success' AS status, CAST(3 AS BIGINT) AS queries,
           CAST(least(200, (SELECT COUNT(*) FROM drug)) + (SELECT COUNT(DISTINCT year) FROM drug)
                AS BIGINT) AS rows
    UNION ALL SELECT 'rejected', 2, 0 UNION ALL SELECT 'failed', 1, 0""")
_add("access_appended", "access_log", f"""
    SELECT path, status_code, {_count()} AS accesses, {_count()} AS ids, {_count()} AS timed,
           {_count('COUNT(username)')} AS named
    FROM access_log GROUP BY path, status_code""")
_add("access_rollup", "access_log", f"""
    SELECT time_bucket(INTERVAL 5 MINUTES, accessed_at) AS window_start, path,
           {_count()} AS requests, COUNT(*) FILTER (WHERE status_code >= 500) AS server_errors,
           COUNT(*) / 300.0::DOUBLE AS requests_per_second
    FROM access_log GROUP BY 1, 2""")
_add("latency_quantiles", "access_log", """
    SELECT path, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95,
           quantile_disc(duration_ms, 0.99) AS p99
    FROM access_log GROUP BY path""")

_RUNS = {
    "state_rows": "SELECT s_suppkey FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey",
    "runs": """
        SELECT 'clean_prescriber_drug' AS job_name, 'lake/bronze/prescriber_drug' AS input,
               (SELECT COUNT(*) FROM claims) AS rows_in,
               'lake/silver/prescriber_drug' AS output, (SELECT COUNT(*) FROM silver) AS rows_out
        UNION ALL SELECT 'build_drug_summary', 'lake/silver/prescriber_drug',
               (SELECT COUNT(*) FROM silver), 'lake/gold/drug_summary', (SELECT COUNT(*) FROM drug)
        UNION ALL SELECT 'build_prescriber_summary', 'lake/silver/prescriber_drug',
               (SELECT COUNT(*) FROM silver), 'lake/gold/prescriber_summary',
               (SELECT COUNT(*) FROM prescriber)
        UNION ALL SELECT 'build_state_kpi', 'lake/silver/prescriber_drug',
               (SELECT COUNT(*) FROM silver), 'lake/gold/state_kpi', (SELECT COUNT(*) FROM state)
        UNION ALL SELECT 'clean_prescriber', 'lake/bronze/prescriber',
               (SELECT COUNT(*) FROM people), 'lake/silver/prescriber', (SELECT COUNT(*) FROM people)
        UNION ALL SELECT 'clean_drug', 'lake/bronze/drug', (SELECT COUNT(*) FROM part),
               'lake/silver/drug', (SELECT COUNT(DISTINCT upper(trim(p_name))) FROM part)
        UNION ALL SELECT 'clean_state', 'lake/bronze/state', (SELECT COUNT(*) FROM state_rows),
               'lake/silver/state', (SELECT COUNT(*) FROM state_rows)""",
    "datasets": """
        SELECT name, MAX(n) AS n FROM (SELECT input AS name, rows_in AS n FROM runs
            UNION ALL SELECT output, rows_out FROM runs) GROUP BY name""",
}
_add("lineage_events", "drug prescriber state", """
    SELECT job_name, event_type, input, rows_in,
           CASE WHEN event_type = 'COMPLETE' THEN output END AS output,
           CASE WHEN event_type = 'COMPLETE' THEN rows_out END AS rows_out
    FROM runs CROSS JOIN (VALUES ('START'), ('COMPLETE')) kinds(event_type)""", **_RUNS)
_add("lineage_summary", "drug prescriber state", f"""
    SELECT 'total_nodes' AS measure, {_count()} AS value FROM datasets
    UNION ALL SELECT 'healthy_count', {_count()} FROM datasets WHERE n > 0
    UNION ALL SELECT 'total_edges', {_count()} FROM runs""", **_RUNS)
_add("lineage_upstream", "drug prescriber state", """
    SELECT input AS dataset, 1 AS distance, rows_in AS row_count
    FROM runs WHERE output = 'lake/gold/state_kpi'
    UNION ALL SELECT b.input, 2, b.rows_in FROM runs a JOIN runs b ON b.output = a.input
    WHERE a.output = 'lake/gold/state_kpi'""", **_RUNS)

# ---- narratives ----------------------------------------------------------------------


def _shown(expr: str, digits: int, grouped: bool = False) -> str:
    return f"format('{{:{',' if grouped else ''}.{digits}f}}', {_half_up(expr, digits)})"


def _filled(fmt: str, *values: str) -> str:
    """Concatenation of a format's text with values that are already text."""
    parts = re.split(r"%,?[.\d]*[sdf]", fmt.replace("%%", "\0"))
    pieces = [_quoted(parts[0].replace("\0", "%"))]
    for value, text in zip(values, parts[1:], strict=True):
        pieces += [value, _quoted(text.replace("\0", "%"))]
    return " || ".join(pieces)


def _grouped(expr: str) -> str:
    return f"format('{{:,}}', {expr})"


_M1 = "total_cost_usd / 1e6"
_TOP = {
    "top_drugs": f"SELECT * FROM drug WHERE {_Y} {_DRUG_ORDER} LIMIT 10",
    "top_states": f"SELECT * FROM state WHERE {_Y} {_STATE_ORDER} LIMIT 10",
    "top_people": f"SELECT * FROM prescriber WHERE {_Y} {_PEOPLE_ORDER} LIMIT 10",
}
_F = INSIGHT_FORMATS
_DRUG_TEXT = _filled(_F["top_drug"], "gnrc_name", _shown(_M1, 1),
                     _shown("CAST(total_claims AS DOUBLE) / 1e3", 1))
_add("insights", "drug state prescriber", f"""
    SELECT 1 AS position, {_DRUG_TEXT} AS text FROM (FROM top_drugs {_DRUG_ORDER} LIMIT 1)
    UNION ALL SELECT 2, {_filled(_F["second_drug"], "gnrc_name", _shown(_M1, 1))}
    FROM (FROM top_drugs {_DRUG_ORDER} LIMIT 1 OFFSET 1)
    UNION ALL SELECT 3, {_filled(_F["top_state"], "state_abrvtn", _shown(_M1, 1),
                                 _shown("cost_per_beneficiary", 2))}
    FROM (FROM top_states {_STATE_ORDER} LIMIT 1)
    UNION ALL SELECT 4, {_filled(_F["generic_rate"], _shown("r", 1))}
    FROM (SELECT {_mean("generic_rate")} AS r FROM prescriber WHERE {_Y})""", **_TOP)
_SUMMARY = _filled(
    SUMMARY_FORMAT, "'weekly'", _shown("spend / 1e9", 2), _shown("benes / 1e6", 1), "drug",
    _shown("drug_cost / 1e6", 1), "state", _shown("state_cost / 1e6", 1))
_add("executive_summary", "drug state prescriber", f"""
    SELECT {_SUMMARY} AS text FROM (
        SELECT (SELECT {_money("total_cost_usd")} FROM state WHERE {_Y}) AS spend,
               (SELECT CAST(SUM(total_beneficiaries) AS DOUBLE) FROM state WHERE {_Y}) AS benes,
               (SELECT gnrc_name FROM top_drugs {_DRUG_ORDER} LIMIT 1) AS drug,
               (SELECT total_cost_usd FROM top_drugs {_DRUG_ORDER} LIMIT 1) AS drug_cost,
               (SELECT state_abrvtn FROM top_states {_STATE_ORDER} LIMIT 1) AS state,
               (SELECT total_cost_usd FROM top_states {_STATE_ORDER} LIMIT 1) AS state_cost)""",
     **_TOP)
_add("quality_explanation", "drug state prescriber", f"""
    (SELECT 1 AS position, {_filled(OUTLIER_FORMAT, "state_abrvtn", "CAST(z AS VARCHAR)",
                                    _shown(_M1, 1))} AS text
     FROM (SELECT *, {_half_up('(total_cost_usd - m) / d')} AS z
           FROM state JOIN (SELECT year, AVG(total_cost_usd) AS m,
                                   stddev_samp(total_cost_usd) AS d
                            FROM state GROUP BY year) USING (year) WHERE {_Y})
     WHERE abs(z) >= 1.5 ORDER BY abs(z) DESC, state_abrvtn LIMIT 1)
    UNION ALL SELECT 2, {_filled(DUPLICATE_KEYS_FORMAT, "CAST(n AS VARCHAR)")}
    FROM (SELECT SUM(duplicate_key_groups) AS n FROM ({_REPEATED})) WHERE n > 0""")
_R = RECOMMENDATION_FORMATS
_SAVED = _shown("potential_savings", 0, True)
_add("recommendations", "drug prescriber", f"""
    SELECT CAST(no AS INTEGER) AS position,
           CASE no WHEN 1 THEN {_filled(_R["first_swap"], "gnrc_name", "brnd_name")}
                ELSE {_filled(_R["second_swap"], "gnrc_name", "brnd_name")} END AS recommendation,
           CASE no WHEN 1 THEN {_filled(_R["first_swap_impact"], _SAVED)}
                ELSE {_filled(_R["second_swap_impact"], _SAVED)} END AS estimated_impact,
           'high' AS priority
    FROM (SELECT *, row_number() OVER (ORDER BY potential_savings DESC, gnrc_name, brnd_name) AS no
          FROM ({_SAVINGS}) WHERE {_Y}) WHERE no <= 2
    UNION ALL (SELECT 3, {_filled(_R["low_adoption"], "state", _shown("shown", 1))}, NULL, 'medium'
    FROM (SELECT state, {_half_up(_mean("rate"), 1)} AS shown, {_mean("rate")} AS mean
          FROM r GROUP BY state)
    WHERE mean < (SELECT {_mean("rate")} FROM r) * 0.95 ORDER BY shown, state LIMIT 1)""",
     r="SELECT coalesce(prscrbr_state_abrvtn, 'Unknown') AS state, "
       f"coalesce(generic_rate, 0.0) AS rate FROM prescriber WHERE {_Y}")
_A = ANSWER_FORMATS
_COST = _shown("total_cost_usd", 0, True)


def _answer(key: str, relation: str, order: str, *values: str) -> str:
    return (f"SELECT '{key}' AS query, year, {_filled(_A[key], *values)} AS text FROM "
            f"(FROM {relation} QUALIFY row_number() OVER (PARTITION BY year {order}) = 1)")


_ANSWERS = " UNION ALL ".join([
    _answer("top_state", "state", _STATE_ORDER, "state_abrvtn", _COST,
            _grouped("total_beneficiaries")),
    _answer("top_drugs", "drug", _DRUG_ORDER, "gnrc_name", "brnd_name", _COST,
            _grouped("total_claims")),
    _answer("top_prescribers", "prescriber", _PEOPLE_ORDER, "prscrbr_last_org_name",
            "prscrbr_state_abrvtn", _COST, _shown("generic_rate", 1)),
    _answer("opioid_by_state", "state", "ORDER BY pain_specialty_claims DESC, state_abrvtn",
            "state_abrvtn", _grouped("pain_specialty_claims"), _grouped("total_claims")),
    _answer("avg_cost", "state", "ORDER BY avg_cost_per_claim DESC, state_abrvtn",
            "state_abrvtn", _shown("avg_cost_per_claim", 2, True),
            _shown("cost_per_beneficiary", 2, True)),
    f"""SELECT 'generic_vs_brand', year, string_agg(t, '; ' ORDER BY t) FROM (SELECT year, {_filled(
        _A["generic_vs_brand"], "CASE WHEN is_generic THEN 'Generic' ELSE 'Brand' END", _COST,
        _grouped("total_claims"))} AS t FROM (SELECT year, is_generic,
        {_count('SUM(total_claims)')} AS total_claims, {_money('total_cost_usd')} AS total_cost_usd
        FROM drug GROUP BY year, is_generic)) GROUP BY year""",
])
_add("answers", "drug state prescriber", _ANSWERS)
_add("answered_questions", "drug state prescriber", f"""
    SELECT conv_id, turn, r.intent, r.year,
           coalesce(text, CASE WHEN r.intent IS NOT NULL THEN '{NO_DATA_TEXT}' END) AS answer
    FROM ({_ROUTED}) r LEFT JOIN ({_ANSWERS}) a ON r.intent = a.query AND r.year = a.year""")


def _section(number: int, name: str, rows: str, order: str, *values: str) -> str:
    title, header, rule, fmt = REPORT_SECTIONS[name]
    heads = ", ".join(f"({number}, {i}, {_quoted(t)})" for i, t in enumerate((title, header, rule)))
    return (f"SELECT * FROM (VALUES {heads}) h(section, line_no, line) UNION ALL "
            f"SELECT {number}, CAST(2 + row_number() OVER ({order}) AS INTEGER), "
            f"{_filled(fmt, *values)} FROM {rows}")


_add("report_markdown", "drug state prescriber", " UNION ALL ".join([
    _section(1, "drugs", "top_drugs", _DRUG_ORDER, "gnrc_name", _COST, _grouped("total_claims"),
             _grouped("unique_prescribers")),
    _section(2, "states", "top_states", _STATE_ORDER, "state_abrvtn", _COST,
             _grouped("total_beneficiaries"), _shown("cost_per_beneficiary", 2, True)),
    _section(3, "prescribers", "top_people", _PEOPLE_ORDER, "prscrbr_last_org_name",
             "prscrbr_state_abrvtn", _COST, _shown("generic_rate", 1)),
]), **_TOP)


_add("vectors_rejected", "", """
    SELECT CASE vec_id % 50 WHEN 1 THEN 'length' WHEN 2 THEN 'not finite' ELSE 'null' END AS reason,
           count(*) AS vectors
    FROM embeddings WHERE vec_id % 50 IN (1, 2, 3) GROUP BY 1""")
