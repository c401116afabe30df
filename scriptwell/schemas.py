"""Table contracts as explicit Spark schemas."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
    VarcharType,
)


def _fields(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


_TEXT, _COUNT = StringType(), DecimalType(18, 0)

BRONZE_STAMP = _fields(
    _ingestion_date=_TEXT, _ingestion_ts=TimestampType(), _source_table=_TEXT)

PRESCRIBER_DRUG = StructType([
    StructField("prscrbr_npi", LongType(), False),
    *_fields(
        prscrbr_last_org_name=_TEXT, prscrbr_first_name=_TEXT, prscrbr_city=_TEXT,
        prscrbr_state_abrvtn=_TEXT, prscrbr_type=_TEXT, brnd_name=_TEXT, gnrc_name=_TEXT,
        tot_clms=IntegerType(), tot_30day_fills=DoubleType(), tot_drug_cst=DoubleType(),
        tot_day_suply=IntegerType(), tot_benes=IntegerType(), year=IntegerType(),
    ).fields,
])

_PROFILE = _fields(
    prscrbr_npi=LongType(), prscrbr_last_org_name=_TEXT, prscrbr_first_name=_TEXT,
    prscrbr_city=_TEXT, prscrbr_state_abrvtn=_TEXT, prscrbr_type=_TEXT)
_DRUG = _fields(gnrc_name=_TEXT, brnd_name=_TEXT)
_STATE = _fields(state_abrvtn=_TEXT, state_name=_TEXT)

SILVER_PRESCRIBER_DRUG = StructType([
    *PRESCRIBER_DRUG.fields,
    *_fields(avg_cost_per_claim=DoubleType(), is_generic=BooleanType(),
             _silver_ts=TimestampType(), _silver_version=_TEXT).fields,
])

DRUG_SUMMARY = _fields(
    gnrc_name=_TEXT, brnd_name=_TEXT, year=IntegerType(), is_generic=BooleanType(),
    total_claims=_COUNT, total_cost_usd=DoubleType(), total_beneficiaries=_COUNT,
    avg_cost_per_claim=DoubleType(), unique_prescribers=_COUNT, cost_rank=IntegerType(),
    _gold_ts=TimestampNTZType(),
)

PRESCRIBER_SUMMARY = _fields(
    prscrbr_npi=_COUNT, year=IntegerType(), total_claims=_COUNT, total_cost_usd=DoubleType(),
    total_beneficiaries=_COUNT, unique_drugs_prescribed=_COUNT, generic_claims=_COUNT,
    prscrbr_last_org_name=_TEXT, prscrbr_first_name=_TEXT, prscrbr_state_abrvtn=VarcharType(2),
    prscrbr_type=_TEXT, prscrbr_city=_TEXT, generic_rate=DoubleType(), state_rank=IntegerType(),
    _gold_ts=TimestampNTZType(),
)

STATE_KPI = _fields(
    state_abrvtn=VarcharType(2), year=IntegerType(), total_claims=_COUNT,
    total_cost_usd=DoubleType(), total_beneficiaries=_COUNT, total_prescribers=_COUNT,
    unique_drugs=_COUNT, avg_cost_per_claim=DoubleType(), pain_specialty_claims=_COUNT,
    cost_per_beneficiary=DoubleType(), national_rank=IntegerType(), _gold_ts=TimestampNTZType(),
)



def _with(base: StructType, *stamps: StructType) -> StructType:
    return StructType([*base.fields, *(f for s in stamps for f in s.fields)])


def _stored(contract: StructType) -> StructType:
    """A Gold contract as its layer stores it: counts as long, text without a width, stamps as
    instants."""
    kinds = {DecimalType: LongType(), VarcharType: StringType(), TimestampNTZType: TimestampType()}
    return StructType([StructField(f.name, kinds.get(type(f.dataType), f.dataType))
                       for f in contract.fields])


_SILVER_STAMP = _fields(_silver_ts=TimestampType())

# What each stored layer holds. Reads enforce it.
LAYERS = {
    ("bronze", "prescriber_drug"): _with(PRESCRIBER_DRUG, BRONZE_STAMP),
    ("bronze", "prescriber"): _with(_PROFILE, BRONZE_STAMP),
    ("bronze", "drug"): _with(_DRUG, BRONZE_STAMP),
    ("bronze", "state"): _with(_STATE, BRONZE_STAMP),
    ("silver", "prescriber_drug"): SILVER_PRESCRIBER_DRUG,
    ("silver", "prescriber"): _with(_PROFILE, _SILVER_STAMP),
    ("silver", "drug"): _with(_DRUG, _SILVER_STAMP),
    ("silver", "state"): _with(_STATE, _SILVER_STAMP),
    ("gold", "drug_summary"): _stored(DRUG_SUMMARY),
    ("gold", "prescriber_summary"): _stored(PRESCRIBER_SUMMARY),
    ("gold", "state_kpi"): _stored(STATE_KPI),
}

CLAIM_EVENT = _fields(
    claim_id=_TEXT, prscrbr_npi=LongType(), prscrbr_state_abrvtn=_TEXT, gnrc_name=_TEXT,
    brnd_name=_TEXT, is_opioid=BooleanType(), drug_cost_usd=DoubleType(), claim_timestamp=_TEXT,
    _produced_at=_TEXT,
)

ALERT = _fields(
    alert_type=_TEXT, prscrbr_npi=LongType(), prscrbr_state_abrvtn=_TEXT,
    claim_count_in_window=LongType(), window_minutes=IntegerType(), threshold=IntegerType(),
    detected_at=TimestampType(), severity=_TEXT,
)

ACCESS_LOG = _fields(
    log_id=_TEXT, username=_TEXT, path=_TEXT, method=_TEXT, status_code=IntegerType(),
    duration_ms=DoubleType(), client_ip=_TEXT, accessed_at=TimestampNTZType(),
)

QUERY_LOG = _fields(
    query_id=_TEXT, username=_TEXT, question=_TEXT, generated_sql=_TEXT, row_count=LongType(),
    status=_TEXT, created_at=TimestampNTZType(),
)

ROLES = _fields(role_name=_TEXT, description=_TEXT, permissions=ArrayType(_TEXT))

COLLECTION = _fields(
    id=_TEXT, document=_TEXT, metadata=MapType(_TEXT, _TEXT), embedding=ArrayType(FloatType()),
    ts=TimestampNTZType(),
)

SESSION_TURN = _fields(
    session_id=_TEXT, role=_TEXT, content=_TEXT, sql=_TEXT, ts=TimestampNTZType())

_DATASET = _fields(
    namespace=_TEXT, name=_TEXT, row_count=LongType(),
    fields=ArrayType(_fields(name=_TEXT, type=_TEXT)),
)

LINEAGE_EVENT = _fields(
    event_type=_TEXT, event_time=TimestampType(), run_id=_TEXT, job_namespace=_TEXT,
    job_name=_TEXT, inputs=ArrayType(_DATASET), outputs=ArrayType(_DATASET),
)

CHECK_RESULT = _fields(
    suite=_TEXT, table=_TEXT, check_name=_TEXT, passed=BooleanType(), severity=_TEXT,
    details=_TEXT,
)
