"""Event-log schema and the fixed vocabularies of the scoring engine."""

from __future__ import annotations

from pyspark.sql import types as T

# Event types, in the order of their indicator columns.
EVENT_TYPES = (
    "login",
    "logout",
    "vpn_login",
    "file_access",
    "email_access",
    "admin_command",
    "database_query",
    "shared_folder_access",
    "usb_usage",
    "application_launch",
)
LOGIN_TYPES = ("login", "vpn_login")
TRANSFER_TYPES = ("file_access", "email_access", "shared_folder_access", "usb_usage")

# Severity of each attack type, 1 (low) to 5 (critical).
ATTACK_SEVERITY = {
    "brute_force": 4,
    "impossible_travel": 5,
    "credential_stuffing": 4,
    "lateral_movement": 5,
    "device_spoofing": 4,
    "low_and_slow_exfiltration": 3,
    "insider_drift": 2,
}
ATTACK_TYPES = tuple(ATTACK_SEVERITY)

# Transitions that get an indicator column of their own.
TRANSITIONS = (
    ("login", "database_query"),
    ("login", "admin_command"),
    ("vpn_login", "file_access"),
    ("file_access", "email_access"),
    ("database_query", "shared_folder_access"),
    ("admin_command", "database_query"),
)

# Risk bands with their display colours.
RISK_LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
RISK_COLORS = ("#2ecc71", "#f1c40f", "#e67e22", "#e74c3c")

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("department", T.StringType()),
        T.StructField("resource", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("bytes_transferred", T.LongType()),
        T.StructField("is_attack", T.BooleanType()),
        T.StructField("attack_type", T.StringType()),
    ]
)
# Present only on rows of a source that locates its logins.
GEO_SCHEMA = T.StructType(
    [
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("city", T.StringType()),
    ]
)
EVENT_COLUMNS = tuple(EVENT_SCHEMA.fieldNames())
GEO_COLUMNS = tuple(GEO_SCHEMA.fieldNames())

TEMPORAL_FEATURES = (
    "hour", "minute", "day_of_week", "is_weekend", "is_night", "day_of_month", "week_of_year",
)
FREQUENCY_FEATURES = (
    "events_in_window", "unique_ips", "unique_devices", "unique_resources",
    "login_failure_rate", "total_bytes_user", "mean_bytes_user", "max_bytes_user",
)
EVENT_TYPE_FEATURES = tuple(f"etype_{t}" for t in EVENT_TYPES) + ("event_type_entropy",)
SEQUENCE_FEATURES = (
    "seconds_since_prev", "minutes_since_prev", "seconds_since_prev_same_type",
    "cumulative_event_count", "is_first_event_of_day", "is_last_event_of_day",
)
TRANSITION_FEATURES = tuple(f"trans_{a}_to_{b}" for a, b in TRANSITIONS)
NOVELTY_FEATURES = ("cumulative_devices_seen", "is_new_device", "is_new_ip")

FEATURES = (
    ("success", "bytes_transferred")
    + TEMPORAL_FEATURES
    + FREQUENCY_FEATURES
    + EVENT_TYPE_FEATURES
    + SEQUENCE_FEATURES
    + TRANSITION_FEATURES
    + NOVELTY_FEATURES
)
# Numeric or boolean columns of the log that are labels or coordinates, not features.
NOT_FEATURES = frozenset(EVENT_COLUMNS + GEO_COLUMNS) - {"success", "bytes_transferred"}
