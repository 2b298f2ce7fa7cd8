"""Fixed schemas of the six tables, their keys and their value rules."""

from __future__ import annotations

from pyspark.sql import types as T

_MONEY = T.DecimalType(10, 2)
_RATE = T.DecimalType(8, 2)
_STR, _INT, _BOOL = T.StringType(), T.IntegerType(), T.BooleanType()
_DATE, _TS = T.DateType(), T.TimestampNTZType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


SCHEMAS: dict[str, T.StructType] = {
    "customers": _schema(
        ("customer_id", _STR), ("signup_date", _DATE), ("acquisition_channel", _STR),
        ("acquisition_cost", _MONEY), ("age", _INT), ("gender", _STR), ("country", _STR),
        ("state", _STR), ("city", _STR), ("customer_segment", _STR),
        ("email_verified", _BOOL), ("phone_verified", _BOOL),
    ),
    "transactions": _schema(
        ("transaction_id", _STR), ("customer_id", _STR), ("transaction_type", _STR),
        ("amount", _MONEY), ("transaction_date", _TS), ("payment_method", _STR),
        ("is_first_deposit", _BOOL),
    ),
    "betting_activity": _schema(
        ("bet_id", _STR), ("customer_id", _STR), ("session_id", _STR), ("sport", _STR),
        ("bet_amount", _MONEY), ("bet_date", _TS), ("bet_won", _BOOL), ("payout", _MONEY),
        ("net_result", _MONEY), ("odds", _RATE),
    ),
    "sessions": _schema(
        ("session_id", _STR), ("customer_id", _STR), ("start_time", _TS), ("end_time", _TS),
        ("duration_minutes", _INT), ("num_bets", _INT), ("total_wagered", _MONEY),
        ("net_result", _MONEY), ("device_type", _STR), ("browser", _STR), ("country", _STR),
    ),
    "campaigns": _schema(
        ("campaign_id", _STR), ("campaign_name", _STR), ("campaign_type", _STR),
        ("start_date", _DATE), ("end_date", _DATE), ("description", _STR),
        ("cost_per_customer", _RATE), ("bonus_amount", _RATE), ("min_deposit", _RATE),
        ("target_segments", _STR),
    ),
    "customer_campaigns": _schema(
        ("customer_id", _STR), ("campaign_id", _STR), ("sent_date", _DATE),
        ("responded", _BOOL), ("response_date", _DATE), ("bonus_claimed", _BOOL),
        ("campaign_cost", _RATE),
    ),
}

PRIMARY_KEYS: dict[str, list[str]] = {
    "customers": ["customer_id"],
    "transactions": ["transaction_id"],
    "betting_activity": ["bet_id"],
    "sessions": ["session_id"],
    "campaigns": ["campaign_id"],
    "customer_campaigns": ["customer_id", "campaign_id"],
}

# (child table, column, parent table)
FOREIGN_KEYS: list[tuple[str, str, str]] = [
    ("transactions", "customer_id", "customers"),
    ("betting_activity", "customer_id", "customers"),
    ("sessions", "customer_id", "customers"),
    ("customer_campaigns", "customer_id", "customers"),
    ("customer_campaigns", "campaign_id", "campaigns"),
]

NOT_NULL: dict[str, list[str]] = {
    "customers": ["signup_date", "acquisition_channel"],
    "transactions": ["customer_id", "transaction_type", "amount", "transaction_date"],
    "betting_activity": ["customer_id", "bet_amount", "bet_date"],
    "sessions": ["customer_id", "start_time"],
    "campaigns": ["campaign_name", "start_date", "end_date"],
    "customer_campaigns": ["customer_id", "campaign_id", "sent_date"],
}

# Values filled in for absent input, as the table definitions say.
DEFAULTS: dict[str, dict[str, object]] = {
    "customers": {"acquisition_cost": 0, "email_verified": False, "phone_verified": False},
    "transactions": {"is_first_deposit": False},
    "betting_activity": {"payout": 0},
    "sessions": {"num_bets": 0, "total_wagered": 0, "net_result": 0},
    "customer_campaigns": {"responded": False, "bonus_claimed": False},
}

# The domains of the data dictionary.
CHANNELS = ["paid_search", "social_media", "affiliate", "organic"]
SEGMENTS = ["casual", "regular", "whale"]
CAMPAIGN_TYPES = ["signup_bonus", "retention", "engagement", "vip"]
TRANSACTION_TYPES = ["deposit", "withdrawal"]
