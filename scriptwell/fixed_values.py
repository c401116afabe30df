"""Values that results depend on.

Everything in this module is a fixed value: word lists, thresholds, patterns and
text formats that have to be exactly these for results to come out right.
"""

# The 52 accepted state codes.
STATE_CODES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL",
    "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT",
    "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI",
    "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC", "PR",
]

# Identifier patterns in the order they are applied to a text.
# The last one is counted but its matches stay in the text.
PHI_PATTERNS = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"\b(?:\+?1[-.\s])?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b",
    "email": r"\b[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "url": r"https?://\S+",
    "date_full": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    "mrn_like": r"\b(MRN|mrn)[:\s#]*\d{4,}\b",
    "npi_as_identifier": r"\b\d{10}\b",
}
PHI_COUNT_ONLY = ["npi_as_identifier"]
PHI_REPLACEMENT = "[REDACTED:%s]"

# Question intents in matching order. A question has an intent when
# it holds at least one word of every group.
QUESTION_INTENTS = [
    ("top_state", [["highest", "top", "most"], ["state"]]),
    ("top_drugs", [["top", "expensive", "highest", "most"], ["drug", "drugs"]]),
    ("generic_vs_brand",
     [["generic"], ["rate", "vs", "versus", "brand", "compare", "comparison"]]),
    ("top_prescribers", [["top", "highest", "most"], ["prescriber", "prescribers"]]),
    ("opioid_by_state",
     [["opioid", "opioids", "pain"], ["state", "states", "claim", "claims"]]),
    ("avg_cost", [["average", "avg"], ["cost"], ["claim", "beneficiary", "beneficiaries"]]),
    ("top_state", [["highest", "top", "most"], ["cost"]]),
]
DEFAULT_QUESTION_YEAR = 2024
QUESTION_YEAR_PATTERN = r"\b(20\d{2})\b"

# Words no ad-hoc statement may contain, and the default row cap.
FORBIDDEN_SQL_WORDS = [
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE",
    "TRUNCATE", "MERGE", "GRANT", "REVOKE", "CALL", "EXECUTE",
]
DEFAULT_ROW_CAP = 200

# Path prefixes whose access is audited.
AUDITED_PATH_PREFIXES = ["/api/prescribers/", "/api/ai/", "/api/rag/"]
MASK_TEXT = "***MASKED***"
ROLES_SEEING_IDENTIFIERS = ["HEALTHCARE_READER_ADMIN"]
AUDIT_RETENTION_YEARS = 6

# Claim-event contract bounds and message formats.
MIN_NPI = 1_000_000_000
MAX_NPI = 9_999_999_999
MAX_CLAIM_COST = 1_000_000
CONTRACT_FIELDS = [
    ("claim_id", "string"),
    ("prscrbr_npi", "integer"),
    ("prscrbr_state_abrvtn", "string"),
    ("gnrc_name", "string"),
    ("brnd_name", "string"),
    ("is_opioid", "boolean"),
    ("drug_cost_usd", "number"),
    ("claim_timestamp", "string"),
]
CONTRACT_MESSAGES = {
    "malformed": "malformed JSON",
    "missing": "Missing required field: %s",
    "wrong_type": "Field '%s' has wrong type: expected %s, got %s",
    "state": "Invalid state code: %s",
    "negative_cost": "drug_cost_usd cannot be negative",
    "cost_too_high": "drug_cost_usd exceeds sane upper bound (possible data error)",
    "npi": "prscrbr_npi must be a 10-digit NPI number",
    "timestamp": "claim_timestamp must be a valid ISO 8601 timestamp",
}
ISO_TIMESTAMP_PATTERN = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
)

# Alerting.
ALERT_TYPE = "opioid_overutilization"
ALERT_WINDOW_MINUTES = 60
ALERT_THRESHOLD = 15
HIGH_SEVERITY_FACTOR = 1.5

# Retrieval and cache.
KNOWLEDGE_MIN_SIMILARITY = 0.25
PAST_QUERY_MIN_SIMILARITY = 0.5
CACHE_MIN_SIMILARITY = 0.93
CACHE_TTL_SECONDS = 900
SESSION_MAX_TURNS = 8
SESSION_CONTEXT_TURNS = 4
SESSION_TTL_SECONDS = 3600
CHUNK_MAX_WORDS = 200
CHUNK_OVERLAP_WORDS = 30

# Analytics cut-offs.
OUTLIER_Z = 2.2
SAVINGS_COST_FACTOR = 1.2
LOW_ADOPTION_FACTOR = 0.95
GENERIC_COST_CEILING = 10_000

# Expected Bronze row floors and keys.
BRONZE_EXPECTATIONS = {
    "prescriber_drug": ("prscrbr_npi", 20_000_000),
    "prescriber": ("prscrbr_npi", 900_000),
    "drug": ("gnrc_name", 100_000),
    "state": ("state_abrvtn", 25_000),
}
SILVER_REQUIRED_COLUMNS = [
    "prscrbr_npi", "gnrc_name", "tot_clms", "tot_drug_cst", "avg_cost_per_claim",
]
SILVER_ROW_BOUNDS = (15_000_000, 50_000_000)

# Bronze write layout and the number of source splits.
BRONZE_LAYOUT = {
    "prescriber_drug": ("year", 200),
    "prescriber": ("nppes_provider_state", 50),
    "drug": (None, 10),
    "state": (None, 5),
}
SPLIT_READ_ABOVE = 20
JDBC_FETCH_SIZE = 10_000

# Sentence formats filled from query results.
INSIGHT_FORMATS = {
    "top_drug": "%s dominates utilization at $%.1fM across %.1fK claims.",
    "second_drug":
        "%s represents the second largest pharmaceutical expenditure at $%.1fM.",
    "top_state": "%s leads total regional spend at $%.1fM ($%.2f per beneficiary).",
    "generic_rate": "Network generic prescribing adoption is %.1f%%, "
                    "sustaining vital cost-reduction benchmarks.",
}
SUMMARY_FORMAT = (
    "During this %s reporting window, network healthcare expenditures totaled $%.2fB "
    "servicing approximately %.1fM eligible beneficiaries. Pharmaceutical spend remained "
    "concentrated, led by %s at $%.1fM in gross claim volume. Regionally, %s registered "
    "the highest cumulative utilization at $%.1fM."
)
OUTLIER_FORMAT = "Detected statistical spend outlier in state %s with a z-score of %s ($%.1fM)."
DUPLICATE_KEYS_FORMAT = (
    "Found %d duplicate primary key groups requiring ingestion pipeline deduplication."
)
RECOMMENDATION_FORMATS = {
    "first_swap": "Enforce step therapy prioritizing %s over %s across network "
                  "outpatient formularies.",
    "first_swap_impact": "$%,.0f estimated annual savings",
    "second_swap": "Deploy automated point-of-sale electronic prescribing prompts for %s "
                   "substitution when %s is ordered.",
    "second_swap_impact": "$%,.0f net formulary optimization",
    "low_adoption": "Initiate clinical academic detailing for high-volume prescribers in %s "
                    "to lift generic adoption from %.1f%%.",
}
NO_DATA_TEXT = "No data found for that year."
ANSWER_FORMATS = {
    "top_state": "%s had the highest total drug cost at $%,.0f, covering %,d beneficiaries.",
    "top_drugs": "%s (%s) was the top-cost drug at $%,.0f total, across %,d claims.",
    "generic_vs_brand": "%s: $%,.0f total cost, %,d claims",
    "top_prescribers": "%s in %s had the highest cost at $%,.0f, "
                       "with a %.1f%% generic prescribing rate.",
    "opioid_by_state": "%s had the highest pain-management-specialty claim volume "
                       "at %,d claims out of %,d total.",
    "avg_cost": "%s had the highest average cost per claim at $%,.2f, "
                "and $%,.2f cost per beneficiary.",
}
REPORT_SECTIONS = {
    "drugs": ("## Top 10 Drugs by Cost",
              "| Drug | Total Cost | Claims | Prescribers |", "|---|---|---|---|",
              "| %s | $%,.0f | %,d | %,d |"),
    "states": ("## Top 10 States by Cost",
               "| State | Total Cost | Beneficiaries | Cost/Beneficiary |", "|---|---|---|---|",
               "| %s | $%,.0f | %,d | $%,.2f |"),
    "prescribers": ("## Top 10 Prescribers by Cost",
                    "| Prescriber | State | Total Cost | Generic Rate |", "|---|---|---|---|",
                    "| %s | %s | $%,.0f | %.1f%% |"),
}
