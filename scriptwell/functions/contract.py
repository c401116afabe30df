"""Claim-event contract: JSON decoding and the list of violations.

Decoding goes in projections of one step each, because every step is read several times
by the next one and Spark then computes it once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptwell.fixed_values import (
    CONTRACT_FIELDS,
    CONTRACT_MESSAGES,
    ISO_TIMESTAMP_PATTERN,
    MAX_CLAIM_COST,
    MAX_NPI,
    MIN_NPI,
    STATE_CODES,
)
from scriptwell.functions.columns import hold

def _fits(shape: Column, kind: str) -> Column:
    """Whether a parsed JSON value has a contract type.

    The test is on the type of the parsed value, because a typed read would silently
    convert "7" and true to numbers.
    """
    fits = {
        "string": shape == "STRING",
        "integer": shape == "BIGINT",
        "boolean": shape == "BOOLEAN",
        "number": shape.isin("BIGINT", "DOUBLE", "FLOAT") | shape.startswith("DECIMAL"),
    }
    return F.coalesce(fits[kind], F.lit(False))


_TYPES = {"string": "string", "integer": "bigint", "boolean": "boolean", "number": "double"}

_BASIC_FORMS = [
    (r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3"),
    (r"^(.{10}[T ]\d{2})(\d{2})(\d{2})", "$1:$2:$3"),
    (r"^(.{10}[T ]\d{2})(\d{2})(?!\d)", "$1:$2"),
    (r"^(.{13}[^,]*),", "$1."),
    (r"^(.{13}.*[+-]\d{2})(\d{2})$", "$1:$2"),
]


def parse_time(text: Column) -> Column:
    """ISO 8601 timestamp with Z, an offset or neither, else NULL.

    Dates without dashes, times and offsets without colons and a comma before the fraction are
    accepted as well; week dates and days of the year are not.
    """
    plain = F.when(text.rlike(ISO_TIMESTAMP_PATTERN), F.try_to_timestamp(text))
    # Evaluated for texts only that aren't in the usual form.
    full = text
    for basic, extended in _BASIC_FORMS:
        full = F.regexp_replace(full, basic, extended)
    return F.coalesce(plain, F.when(full.rlike(ISO_TIMESTAMP_PATTERN), F.try_to_timestamp(full)))


def check_events(messages: DataFrame, value: str = "value") -> DataFrame:
    """Adds the typed claim fields, the event time and all violations of each message.

    A message without violations has an empty `errors` array; malformed JSON has one error.
    """
    event, kinds = F.col("__event"), dict(CONTRACT_FIELDS)
    parsed = messages.withColumn("__event", F.try_parse_json(value))
    fields = parsed.withColumns({
        f"__{n}": F.try_variant_get(event, f"$.{n}", "variant") for n in kinds})
    shaped = fields.withColumns({
        f"__kind_{n}": F.schema_of_variant(F.col(f"__{n}")) for n in kinds})
    fits = {n: _fits(F.col(f"__kind_{n}"), k) for n, k in kinds.items()}
    typed = shaped.withColumns({
        n: F.when(fits[n], F.try_variant_get(F.col(f"__{n}"), "$", _TYPES[k]))
        for n, k in kinds.items()})
    timed = typed.withColumn("event_time", parse_time(F.col("claim_timestamp")))
    errors = F.when(event.isNull(), F.array(F.lit(CONTRACT_MESSAGES["malformed"]))).otherwise(
        F.array_compact(F.array(*_violations(fits))))
    typed_names = [n for n in kinds if n not in messages.columns]
    return hold(timed.withColumn("errors", errors), "errors").select(
        *messages.columns, *typed_names, "event_time", "errors")


def _violations(fits: dict[str, Column]) -> list[Column]:
    found = [
        F.when(F.col(f"__{name}").isNull(), F.lit(CONTRACT_MESSAGES["missing"] % name))
        .when(~fits[name], F.format_string(
            CONTRACT_MESSAGES["wrong_type"], F.lit(name), F.lit(kind),
            F.lower(F.col(f"__kind_{name}"))))
        for name, kind in CONTRACT_FIELDS
    ]

    def given(name: str) -> Column:
        return F.col(f"__{name}").isNotNull()

    state, cost = F.col("prscrbr_state_abrvtn"), F.col("drug_cost_usd")
    shown = F.coalesce(F.try_variant_get(F.col("__prscrbr_state_abrvtn"), "$", "string"),
                       F.lit("null"))
    known = F.coalesce(state.isin(STATE_CODES), F.lit(False))
    return [
        *found,
        F.when(given("prscrbr_state_abrvtn") & ~known,
               F.format_string(CONTRACT_MESSAGES["state"], shown)),
        F.when(cost < 0, F.lit(CONTRACT_MESSAGES["negative_cost"])),
        F.when(cost > MAX_CLAIM_COST, F.lit(CONTRACT_MESSAGES["cost_too_high"])),
        F.when(~F.col("prscrbr_npi").between(MIN_NPI, MAX_NPI), F.lit(CONTRACT_MESSAGES["npi"])),
        F.when(given("claim_timestamp") & F.col("event_time").isNull(),
               F.lit(CONTRACT_MESSAGES["timestamp"])),
    ]
