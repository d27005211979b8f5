"""The registered queries as SQL over the activity table, for a second engine to check."""

from __future__ import annotations

from checks.forest_sql import forest_ctes

EV = """
raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
ev AS (
  SELECT
    printf('EVT-%06d', event_id) AS event_id,
    ts AS timestamp,
    printf('user_%04d', user_id) AS user_id,
    'name_' || (user_id % 100) AS username,
    CASE event_type
      WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'login' ELSE 'logout' END
      WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'login' ELSE 'vpn_login' END
      WHEN 'click' THEN CASE k % 4 WHEN 0 THEN 'admin_command' WHEN 1 THEN 'email_access'
                             ELSE 'application_launch' END
      WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'file_access' ELSE 'database_query' END
      ELSE CASE WHEN k % 4 = 0 THEN 'usb_usage' ELSE 'shared_folder_access' END
    END AS event_type,
    CASE WHEN k < 5 THEN '203.0.113.' || k
         ELSE '10.' || (user_id // 256) || '.' || (user_id % 256) || '.' || (k % 3) END AS source_ip,
    'DEV-' || (user_id * 10 + k % 4) AS device_id,
    'dept_' || (user_id % 8) AS department,
    'res_' || (k % 25) AS resource,
    event_type <> 'error' AS success,
    CASE WHEN event_type IN ('view', 'purchase') OR (event_type = 'click' AND k % 4 = 1)
         THEN CAST(floor(value * 100000) AS BIGINT) ELSE 0 END AS bytes_transferred,
    k >= 90 AS is_attack,
    CASE WHEN k >= 90 THEN
      (['brute_force', 'impossible_travel', 'credential_stuffing', 'lateral_movement',
        'device_spoofing', 'low_and_slow_exfiltration', 'insider_drift'])[k % 7 + 1]
      ELSE 'none' END AS attack_type,
    CAST(k AS DOUBLE) AS _k
  FROM raw
),
log AS (
  SELECT * EXCLUDE (_k),
    event_type IN ('login', 'vpn_login') AS is_login,
    event_type IN ('file_access', 'email_access', 'shared_folder_access', 'usb_usage') AS is_transfer,
    CASE WHEN event_type IN ('login', 'vpn_login') THEN -60.0 + _k END AS latitude,
    CASE WHEN event_type IN ('login', 'vpn_login') THEN -150.0 + 3 * _k END AS longitude,
    CASE WHEN event_type IN ('login', 'vpn_login') THEN 'city_' || CAST(CAST(_k AS INTEGER) % 8 AS VARCHAR) END AS city,
    CASE WHEN hour(timestamp) >= 22 OR hour(timestamp) <= 5 THEN 1 ELSE 0 END AS is_night
  FROM ev
)"""

TYPES = (
    "login", "logout", "vpn_login", "file_access", "email_access", "admin_command",
    "database_query", "shared_folder_access", "usb_usage", "application_launch",
)
TRANSITIONS = (
    ("login", "database_query"), ("login", "admin_command"), ("vpn_login", "file_access"),
    ("file_access", "email_access"), ("database_query", "shared_folder_access"),
    ("admin_command", "database_query"),
)
RAW_COLUMNS = (
    "event_id, timestamp, user_id, username, event_type, source_ip, device_id, department, "
    "resource, success, bytes_transferred, is_attack, attack_type"
)


def r6(expression: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0"


def q(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([EV.strip(), *[c.strip() for c in ctes]]) + "\n" + body.strip()


_running = ", ".join(
    f"CAST(count(*) FILTER (WHERE event_type = '{t}') OVER run AS DOUBLE) AS c_{t}" for t in TYPES
)
_entropy = " + ".join(f"(c_{t} / n) * log2(c_{t} / n + 1e-12)" for t in TYPES)
_onehot = ", ".join(
    f"CASE WHEN event_type = '{t}' THEN 1 ELSE 0 END AS etype_{t}" for t in TYPES
)
_flags = ", ".join(
    f"CASE WHEN prev_type = '{a}' AND event_type = '{b}' THEN 1 ELSE 0 END AS trans_{a}_to_{b}"
    for a, b in TRANSITIONS
)
_TRANSITION_NAMES = ", ".join(f"trans_{a}_to_{b}" for a, b in TRANSITIONS)
_ETYPE_NAMES = ", ".join(f"etype_{t}" for t in TYPES)

FEAT = f"""
steps AS (
  SELECT *,
    lag(timestamp) OVER u AS prev_ts,
    lead(timestamp) OVER u AS next_ts,
    lag(event_type) OVER u AS prev_type,
    lag(timestamp) OVER (PARTITION BY user_id, event_type ORDER BY timestamp, event_id) AS prev_same,
    row_number() OVER u AS cumulative_event_count,
    CAST(row_number() OVER (PARTITION BY user_id, device_id ORDER BY timestamp, event_id) = 1 AS INTEGER) AS is_new_device,
    CAST(row_number() OVER (PARTITION BY user_id, source_ip ORDER BY timestamp, event_id) = 1 AS INTEGER) AS is_new_ip,
    CAST(count(*) OVER run AS DOUBLE) AS n,
    {_running}
  FROM log
  WINDOW u AS (PARTITION BY user_id ORDER BY timestamp, event_id),
         run AS (PARTITION BY user_id ORDER BY timestamp, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
users AS (
  SELECT user_id,
    CAST(count(*) AS BIGINT) AS events_in_window,
    CAST(count(DISTINCT source_ip) AS BIGINT) AS unique_ips,
    CAST(count(DISTINCT device_id) AS BIGINT) AS unique_devices,
    CAST(count(DISTINCT resource) AS BIGINT) AS unique_resources,
    count(*) FILTER (WHERE is_login) AS logins,
    count(*) FILTER (WHERE is_login AND NOT success) AS failed,
    CAST(sum(bytes_transferred) AS BIGINT) AS total_bytes_user,
    avg(bytes_transferred) AS mean_bytes_user,
    CAST(max(bytes_transferred) AS BIGINT) AS max_bytes_user
  FROM log GROUP BY user_id
),
feat AS (
  SELECT s.*,
    u.* EXCLUDE (user_id, logins, failed),
    hour(timestamp) AS hour, minute(timestamp) AS minute,
    isodow(timestamp) - 1 AS day_of_week,
    CASE WHEN isodow(timestamp) >= 6 THEN 1 ELSE 0 END AS is_weekend,
    day(timestamp) AS day_of_month, week(timestamp) AS week_of_year,
    CASE WHEN is_login THEN CASE WHEN logins > 0 THEN failed / logins ELSE 0.0 END ELSE 0.0 END AS login_failure_rate,
    {_onehot},
    -({_entropy}) AS event_type_entropy,
    coalesce((epoch_us(timestamp) - epoch_us(prev_ts)) / 1e6, -1.0) AS seconds_since_prev,
    coalesce((epoch_us(timestamp) - epoch_us(prev_ts)) / 1e6, -1.0) / 60 AS minutes_since_prev,
    coalesce((epoch_us(timestamp) - epoch_us(prev_same)) / 1e6, -1.0) AS seconds_since_prev_same_type,
    CASE WHEN prev_ts IS NULL OR CAST(prev_ts AS DATE) <> CAST(timestamp AS DATE) THEN 1 ELSE 0 END AS is_first_event_of_day,
    CASE WHEN next_ts IS NULL OR CAST(next_ts AS DATE) <> CAST(timestamp AS DATE) THEN 1 ELSE 0 END AS is_last_event_of_day,
    {_flags},
    CAST(sum(is_new_device) OVER (PARTITION BY s.user_id ORDER BY timestamp, event_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative_devices_seen
  FROM steps s JOIN users u ON s.user_id = u.user_id
)"""

RULES = """
logins AS (
  SELECT *,
    count(*) FILTER (WHERE NOT success) OVER (PARTITION BY user_id ORDER BY timestamp
      RANGE BETWEEN INTERVAL 4320 MINUTE PRECEDING AND CURRENT ROW) AS failures,
    lag(source_ip) OVER u AS last_ip,
    lag(timestamp) OVER u AS last_ts,
    lag(latitude) OVER u AS last_lat,
    lag(longitude) OVER u AS last_lon,
    row_number() OVER (PARTITION BY user_id, device_id ORDER BY timestamp, event_id) AS nth_of_device,
    row_number() OVER u AS nth
  FROM log WHERE is_login
  WINDOW u AS (PARTITION BY user_id ORDER BY timestamp, event_id)
),
crowded AS (
  SELECT source_ip FROM log WHERE is_login GROUP BY source_ip HAVING count(DISTINCT user_id) >= 5
),
spread AS (
  SELECT *, count(DISTINCT resource) OVER (PARTITION BY user_id ORDER BY timestamp
    RANGE BETWEEN INTERVAL 48 HOUR PRECEDING AND CURRENT ROW) AS resources
  FROM log
),
moved AS (
  SELECT *, CAST(sum(CASE WHEN is_transfer THEN bytes_transferred ELSE 0 END)
    OVER (PARTITION BY user_id, CAST(timestamp AS DATE)) AS BIGINT) AS day_bytes
  FROM log
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, event_id) AS position,
    count(*) OVER (PARTITION BY user_id) AS events
  FROM log
),
halves AS (
  SELECT *, CASE WHEN position <= events // 2 THEN 1 ELSE 2 END AS half FROM placed
),
rates AS (
  SELECT *,
    avg(is_night) FILTER (WHERE half = 1) OVER (PARTITION BY user_id) AS first_rate,
    avg(is_night) FILTER (WHERE half = 2) OVER (PARTITION BY user_id) AS second_rate
  FROM halves
),
h1 AS (SELECT event_id, user_id FROM logins WHERE failures >= 3),
h2 AS (SELECT event_id, user_id FROM logins WHERE source_ip <> last_ip
       AND epoch_us(timestamp) - epoch_us(last_ts) > 0
       AND epoch_us(timestamp) - epoch_us(last_ts) < 12 * 3600000000),
h3 AS (SELECT event_id, user_id FROM log WHERE is_login AND source_ip IN (SELECT source_ip FROM crowded)),
h4 AS (SELECT event_id, user_id FROM spread WHERE resources >= 7),
h5 AS (SELECT event_id, user_id FROM logins WHERE nth_of_device = 1 AND nth > 1),
h6 AS (SELECT event_id, user_id FROM moved WHERE is_transfer AND day_bytes > 15000 * 1024),
h7 AS (SELECT event_id, user_id FROM rates WHERE events >= 20 AND half = 2 AND is_night = 1
       AND second_rate > first_rate + 0.1)"""

COMBINED = """
hits AS (
  SELECT 1 AS i, event_id, 'brute_force_login' AS name, 'brute_force' AS type, 4 AS severity FROM h1
  UNION ALL SELECT 2, event_id, 'impossible_travel', 'impossible_travel', 5 FROM h2
  UNION ALL SELECT 3, event_id, 'credential_stuffing', 'credential_stuffing', 4 FROM h3
  UNION ALL SELECT 4, event_id, 'lateral_movement', 'lateral_movement', 5 FROM h4
  UNION ALL SELECT 5, event_id, 'device_spoofing', 'device_spoofing', 4 FROM h5
  UNION ALL SELECT 6, event_id, 'low_and_slow_exfiltration', 'low_and_slow_exfiltration', 3 FROM h6
  UNION ALL SELECT 7, event_id, 'insider_drift', 'insider_drift', 2 FROM h7
),
by_event AS (
  SELECT event_id, string_agg(name, ',' ORDER BY i) AS names, max(severity) AS severity,
    arg_min(type, i) AS type
  FROM hits GROUP BY event_id
),
combined AS (
  SELECT log.event_id,
    CASE WHEN names IS NULL THEN 0 ELSE 1 END AS rule_anomaly,
    coalesce(names, '') AS rule_names,
    CAST(coalesce(severity, 0) AS INTEGER) AS rule_severity,
    coalesce(type, 'none') AS rule_attack_type
  FROM log LEFT JOIN by_event ON log.event_id = by_event.event_id
)"""

MARKOV = """
train AS (
  SELECT event_id, event_type AS next, lag(event_type) OVER (PARTITION BY user_id ORDER BY timestamp, event_id) AS prefix
  FROM log WHERE NOT is_attack
),
pairs AS (SELECT event_id, prefix, next FROM train WHERE prefix IS NOT NULL),
counts AS (SELECT prefix, next, CAST(count(*) AS BIGINT) AS cnt FROM pairs GROUP BY ALL),
probs AS (
  SELECT *, (cnt + 1e-6) / (sum(cnt) OVER p + 1e-6 * count(*) OVER p) AS prob
  FROM counts WINDOW p AS (PARTITION BY prefix)
),
threshold AS (
  SELECT quantile_cont(ln(prob + 1e-12), 0.05) AS cut, CAST(count(*) AS BIGINT) AS training_pairs
  FROM pairs JOIN probs USING (prefix, next)
),
seq AS (
  SELECT event_id, event_type AS next, lag(event_type) OVER (PARTITION BY user_id ORDER BY timestamp, event_id) AS prefix
  FROM log
),
mraw AS (
  SELECT event_id, CASE WHEN seq.prefix IS NULL THEN 0.0 ELSE ln(coalesce(prob, 1e-6) + 1e-12) END AS markov_raw
  FROM seq LEFT JOIN probs ON seq.prefix = probs.prefix AND seq.next = probs.next
),
mends AS (SELECT min(-markov_raw) AS lo, max(-markov_raw) AS hi FROM mraw),
markov AS (
  SELECT event_id, markov_raw,
    CASE WHEN markov_raw < cut THEN -1 ELSE 1 END AS markov_label,
    CASE WHEN markov_raw < cut THEN 1 ELSE 0 END AS markov_is_anomaly,
    CASE WHEN hi > lo THEN (-markov_raw - lo) / (hi - lo) ELSE 0.0 END AS markov_score
  FROM mraw, threshold, mends
)"""

PAIRS2 = """
train2 AS (
  SELECT event_id, event_type AS next, lag(event_type, 1) OVER u AS p1, lag(event_type, 2) OVER u AS p2
  FROM log WHERE NOT is_attack WINDOW u AS (PARTITION BY user_id ORDER BY timestamp, event_id)
),
pairs2 AS (SELECT event_id, p2 || '>' || p1 AS prefix, next FROM train2 WHERE p2 IS NOT NULL),
counts2 AS (SELECT prefix, next, CAST(count(*) AS BIGINT) AS cnt FROM pairs2 GROUP BY ALL),
probs2 AS (
  SELECT *, (cnt + 1e-6) / (sum(cnt) OVER p + 1e-6 * count(*) OVER p) AS prob
  FROM counts2 WINDOW p AS (PARTITION BY prefix)
),
seq2 AS (
  SELECT event_id, event_type AS next, lag(event_type, 1) OVER u AS p1, lag(event_type, 2) OVER u AS p2
  FROM log WINDOW u AS (PARTITION BY user_id ORDER BY timestamp, event_id)
)"""

SCORED = """
detectors AS (
  SELECT feat.*, combined.* EXCLUDE (event_id), markov.* EXCLUDE (event_id),
    bytes_transferred / (max(bytes_transferred) OVER ()) AS iso_anomaly_score,
    CASE WHEN bytes_transferred / (max(bytes_transferred) OVER ()) > 0.25 THEN 1 ELSE 0 END AS iso_is_anomaly
  FROM feat JOIN combined ON feat.event_id = combined.event_id JOIN markov ON feat.event_id = markov.event_id
),
guessed AS (
  SELECT *,
    0.35 * iso_anomaly_score + 0.40 * rule_anomaly + 0.25 * markov_score AS composite_score,
    CASE WHEN login_failure_rate > 0.4 THEN 'brute_force'
         WHEN is_new_device = 1 AND iso_anomaly_score > 0.7 THEN 'device_spoofing'
         WHEN unique_resources > 5 THEN 'lateral_movement'
         WHEN bytes_transferred > 10000 THEN 'low_and_slow_exfiltration'
         WHEN is_night = 1 THEN 'insider_drift'
         ELSE 'brute_force' END AS guess
  FROM detectors
),
ranged AS (
  SELECT *, round_even((composite_score - min(composite_score) OVER ())
    / (max(composite_score) OVER () - min(composite_score) OVER ()) * 100, 1) AS risk_score
  FROM guessed
),
scored AS (
  SELECT *,
    CASE WHEN rule_attack_type <> 'none' THEN rule_attack_type
         WHEN iso_is_anomaly = 1 OR markov_is_anomaly = 1 THEN guess
         ELSE 'normal' END AS predicted_attack_type,
    CASE WHEN risk_score < 25 THEN 'LOW' WHEN risk_score < 50 THEN 'MEDIUM'
         WHEN risk_score < 75 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level,
    CASE WHEN risk_score < 25 THEN '#2ecc71' WHEN risk_score < 50 THEN '#f1c40f'
         WHEN risk_score < 75 THEN '#e67e22' ELSE '#e74c3c' END AS risk_color
  FROM ranged
),
alerts AS (SELECT * FROM scored WHERE predicted_attack_type <> 'normal')"""

_ATTACKS = (
    "('brute_force', 4), ('impossible_travel', 5), ('credential_stuffing', 4), ('lateral_movement', 5), "
    "('device_spoofing', 4), ('low_and_slow_exfiltration', 3), ('insider_drift', 2)"
)
_SEVERITY = (
    "CASE predicted_attack_type WHEN 'brute_force' THEN 4 WHEN 'impossible_travel' THEN 5 "
    "WHEN 'credential_stuffing' THEN 4 WHEN 'lateral_movement' THEN 5 WHEN 'device_spoofing' THEN 4 "
    "WHEN 'low_and_slow_exfiltration' THEN 3 WHEN 'insider_drift' THEN 2 ELSE 0 END"
)
# Title case: DuckDB has no initcap.
_TITLE = (
    "array_to_string(list_transform(string_split(x, '_'), "
    "lambda w: upper(w[1]) || w[2:]), ' ')"
)
_FLOAT_FEATURES = (
    "login_failure_rate", "mean_bytes_user", "event_type_entropy", "seconds_since_prev",
    "minutes_since_prev", "seconds_since_prev_same_type",
)


# Mean risk score to one decimal, half to even, in whole tenths.
_TENTHS = "CAST(sum(CAST(round(risk_score * 10) AS BIGINT)) AS BIGINT)"
_MEAN_RISK = (
    f"(({_TENTHS} // count(*)) + CASE WHEN 2 * ({_TENTHS} % count(*)) > count(*) THEN 1 "
    f"WHEN 2 * ({_TENTHS} % count(*)) = count(*) THEN ({_TENTHS} // count(*)) % 2 ELSE 0 END) / 10"
)


def feat(columns: str) -> str:
    return q(f"SELECT event_id, {columns} FROM feat", FEAT)


def scored(body: str) -> str:
    return q(body, FEAT, RULES, COMBINED, MARKOV, SCORED)


def rules(body: str) -> str:
    return q(body, RULES)


def forest(body: str) -> str:
    return q(body, FEAT, *forest_ctes())


def scored_with_forest(body: str) -> str:
    """The scored log with the forest's own score in place of the stand-in."""
    stand_in, real = SCORED.split("FROM feat JOIN combined", 1)
    head = stand_in.split("    bytes_transferred / (max", 1)[0]
    own = "    forest.iso_anomaly_score, forest.iso_is_anomaly\n  FROM feat JOIN forest ON feat.event_id = forest.event_id JOIN combined"
    return q(body, FEAT, RULES, COMBINED, MARKOV, *forest_ctes(), head + own + real)


def feature_matrix() -> str:
    from riskline.schema import FEATURES

    return feat(", ".join(f"{r6(c)} AS {c}" for c in FEATURES))


def inferred() -> str:
    from riskline.schema import FEATURES

    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r6(f'avg(CAST({c} AS DOUBLE))')} AS mean FROM feat" for c in FEATURES
    )
    return q(rows, FEAT)


_KM = """12742.0 * atan2(sqrt(a), sqrt(1 - a))"""
_HAV = (
    "pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
    "* pow(sin(radians({lon2} - {lon1}) / 2), 2)"
)
_LABELED = """
labeled AS (
  SELECT 'ATT-' || event_id AS event_id, 'brute_force' AS attack_type, true AS is_attack, city
  FROM log WHERE is_login AND NOT success
)"""

ORACLE: dict[str, str] = {
    "conform_events": q(f"SELECT {RAW_COLUMNS}, latitude, longitude, city FROM log"),
    "sequential_event_id": q(
        "SELECT printf('EVT-%06d', row_number() OVER (ORDER BY timestamp, event_id) - 1) AS event_id, "
        "event_id AS source_id FROM log"
    ),
    "append_labeled": q(
        "SELECT event_id, attack_type, is_attack, CAST(NULL AS VARCHAR) AS city FROM log "
        "UNION ALL SELECT * FROM labeled", _LABELED
    ),
    "apply_appends": q(
        "SELECT event_id, attack_type, is_attack, CAST(NULL AS VARCHAR) AS city FROM log "
        "UNION ALL SELECT * FROM labeled UNION ALL "
        "SELECT 'ATU-' || event_id, 'low_and_slow_exfiltration', true, NULL FROM log "
        "WHERE event_type = 'usb_usage'", _LABELED
    ),
    "union_all": q(
        "SELECT event_id, attack_type, is_attack, city FROM log UNION ALL SELECT * FROM labeled", _LABELED
    ),
    "save_scored": scored(
        "SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS event_date, count(*) AS n, "
        "count(*) FILTER (WHERE predicted_attack_type <> 'normal') AS alerts FROM scored GROUP BY 1"
    ),
    "filter_logins": q("SELECT event_id, event_type FROM log WHERE is_login"),
    "filter_transfers": q("SELECT event_id, bytes_transferred FROM log WHERE is_transfer"),
    "filter_training_normals": q("SELECT event_id, is_attack FROM log WHERE NOT is_attack"),
    "filter_alerts": scored("SELECT event_id, predicted_attack_type FROM alerts"),
    "filter_alert_feed": scored(
        "SELECT event_id, predicted_attack_type, risk_level FROM alerts WHERE risk_level <> 'LOW'"
    ),
    "filter_entity": scored("SELECT event_id, username FROM scored WHERE username = 'name_7'"),
    "filter_min_group_size": q(
        "SELECT event_id, user_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS c FROM log) WHERE c >= 68"
    ),
    "project_existing": scored(
        "SELECT event_id, timestamp, user_id, username, event_type, source_ip, device_id, "
        "predicted_attack_type, risk_score, risk_level, rule_names FROM scored"
    ),
    "infer_feature_columns": inferred(),
    "clean_numeric": q(
        "SELECT event_id, CASE WHEN success THEN CAST(bytes_transferred AS DOUBLE) ELSE 0.0 END AS cleaned FROM log"
    ),
    "temporal_features": feat(
        "hour, minute, day_of_week, is_weekend, is_night, day_of_month, week_of_year"
    ),
    "event_type_onehot": feat(_ETYPE_NAMES),
    "safe_divide": q(
        f"SELECT event_id, CASE WHEN hour(timestamp) = 0 THEN -1.0 ELSE "
        f"{r6('bytes_transferred / hour(timestamp)')} END AS ratio FROM log"
    ),
    "safe_divide_series": q(
        f"SELECT event_id, CASE WHEN minute(timestamp) > 30 THEN "
        f"{r6('bytes_transferred / (minute(timestamp) - 30)')} ELSE 0.0 END AS ratio FROM log"
    ),
    "haversine_km": q(
        f"SELECT event_id, {r6(_KM)} AS km FROM (SELECT event_id, "
        + _HAV.format(lat1="latitude", lon1="longitude", lat2="40.7128", lon2="-74.006")
        + " AS a FROM log WHERE latitude IS NOT NULL)"
    ),
    "time_delta_hours": q(
        "SELECT event_id, "
        + r6("abs(epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(timestamp)) / 3.6e9")
        + " AS hours FROM log"
    ),
    "format_timestamp": q("SELECT event_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS text FROM log"),
    "risk_level": scored("SELECT event_id, risk_level AS level FROM scored"),
    "risk_color": scored("SELECT event_id, risk_color AS color FROM scored"),
    "detector_source": scored(
        "SELECT event_id, CASE WHEN rule_anomaly = 1 THEN 'Rule Engine' WHEN iso_is_anomaly = 1 "
        "THEN 'Isolation Forest' ELSE 'Markov' END AS source FROM alerts"
    ),
    "severity_of": scored(f"SELECT event_id, {_SEVERITY} AS severity FROM scored"),
    "round_scores": q("SELECT event_id, round_even(bytes_transferred / 4, 1) AS rounded FROM log"),
    "severity_tier": scored(
        f"SELECT event_id, CASE WHEN s >= 4 THEN 'red' WHEN s >= 3 THEN 'yellow' ELSE 'green' END AS tier "
        f"FROM (SELECT event_id, {_SEVERITY} AS s FROM scored)"
    ),
    "attack_type_title": scored(
        f"SELECT event_id, {_TITLE} AS title FROM (SELECT event_id, predicted_attack_type AS x FROM scored)"
    ),
    "event_date": q("SELECT event_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS event_date FROM log"),
    "alert_detail_json": scored(
        "SELECT event_id, event_id AS event, strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, username AS user, "
        "user_id, event_type, source_ip, device_id, resource, CAST(bytes_transferred AS DOUBLE) AS bytes_transferred, "
        "predicted_attack_type, CAST(risk_score AS DOUBLE) AS risk_score, risk_level, rule_names, "
        "round_even(iso_anomaly_score, 4) AS iso_anomaly_score, round_even(markov_score, 4) AS markov_score, "
        "CASE WHEN is_attack THEN 'true' ELSE 'false' END AS is_attack_ground_truth FROM alerts"
    ),
    "log_prob": q(f"SELECT event_id, {r6('ln(bytes_transferred / 1e9 + 1e-12)')} AS lp FROM log"),
    "user_frequency_features": feat(
        "events_in_window, unique_ips, unique_devices, unique_resources, total_bytes_user, "
        f"{r6('mean_bytes_user')} AS mean_bytes_user, max_bytes_user"
    ),
    "login_failure_rate": feat(f"{r6('login_failure_rate')} AS login_failure_rate"),
    "entropy": q(
        f"SELECT user_id, {r6('-sum(p * log2(p + 1e-12))')} AS entropy FROM ("
        "SELECT user_id, count(*) / (sum(count(*)) OVER (PARTITION BY user_id)) AS p "
        "FROM log GROUP BY user_id, event_type) GROUP BY user_id"
    ),
    "overview_kpis": scored(
        "SELECT *, round_even(total_anomalies / total_events * 100, 2) AS anomaly_rate_pct, "
        "round_even(total_events / (unique_users * days_covered), 1) AS avg_events_day_user FROM ("
        "SELECT count(*) AS total_events, count(*) FILTER (WHERE predicted_attack_type <> 'normal') AS total_anomalies, "
        "count(DISTINCT user_id) AS unique_users, count(DISTINCT CAST(timestamp AS DATE)) AS days_covered FROM scored)"
    ),
    "sidebar_stats": scored(
        f"SELECT t.attack_type, t.severity, coalesce(c.n, 0) AS n, {_TITLE.replace('x,', 't.attack_type,')} AS title, "
        "CASE WHEN severity >= 4 THEN 'red' WHEN severity >= 3 THEN 'yellow' ELSE 'green' END AS tier, "
        "s.events, s.users, s.anomalies, round_even(s.anomalies / s.events * 100, 1) AS anomaly_rate_pct "
        f"FROM (VALUES {_ATTACKS}) t(attack_type, severity) "
        "LEFT JOIN (SELECT predicted_attack_type, count(*) AS n FROM scored GROUP BY 1) c "
        "ON t.attack_type = c.predicted_attack_type, (SELECT count(*) AS events, count(DISTINCT user_id) AS users, "
        "count(*) FILTER (WHERE predicted_attack_type <> 'normal') AS anomalies FROM scored) s"
    ),
    "daily_event_volume": q(
        "SELECT CAST(CAST(d.day AS DATE) AS VARCHAR) AS event_date, count(event_id) AS n FROM ("
        "SELECT unnest(generate_series((SELECT CAST(min(timestamp) AS DATE) FROM log), "
        "(SELECT CAST(max(timestamp) AS DATE) FROM log), INTERVAL 1 DAY)) AS day) d "
        "LEFT JOIN log ON CAST(timestamp AS DATE) = CAST(d.day AS DATE) GROUP BY 1"
    ),
    "alert_feed_counts": scored(
        "SELECT least(count(*) FILTER (WHERE risk_level <> 'LOW'), 50) AS shown, count(*) AS total FROM alerts"
    ),
    "attack_type_distribution": scored(
        "SELECT predicted_attack_type, count(*) AS n FROM alerts GROUP BY 1"
    ),
    "event_type_breakdown": scored(
        "SELECT event_type, count(*) AS n FROM scored WHERE username = 'name_7' GROUP BY 1"
    ),
    "risk_histogram": scored(
        "SELECT CAST(least(floor(risk_score / 2) + 1, 50) AS INTEGER) AS bin, risk_level, count(*) AS n "
        "FROM scored GROUP BY 1, 2"
    ),
    "entity_summary": scored(
        "SELECT source_ip, count(*) AS events, count(*) FILTER (WHERE predicted_attack_type <> 'normal') AS anomalies, "
        f"{_MEAN_RISK} AS avg_risk, count(DISTINCT predicted_attack_type) "
        "FILTER (WHERE predicted_attack_type <> 'normal') AS attack_types FROM scored GROUP BY 1"
    ),
    "detector_agreement": scored(
        "SELECT x.agreement, (SELECT count(*) FROM scored s WHERE (x.i IS NULL OR x.i = s.iso_is_anomaly) "
        "AND (x.r IS NULL OR x.r = s.rule_anomaly) AND (x.m IS NULL OR x.m = s.markov_is_anomaly)) AS n FROM (VALUES "
        "('All three', 1, 1, 1), ('IF + Rule', 1, 1, NULL), ('IF + Markov', 1, NULL, 1), ('Rule + Markov', NULL, 1, 1), "
        "('IF only', 1, 0, 0), ('Rule only', 0, 1, 0), ('Markov only', 0, 0, 1)) x(agreement, i, r, m)"
    ),
    "attack_by_detector": scored(
        "SELECT predicted_attack_type, count(*) FILTER (WHERE rule_anomaly = 1) AS rules, "
        "count(*) FILTER (WHERE rule_anomaly = 0 AND iso_is_anomaly = 1) AS forest, "
        "count(*) FILTER (WHERE rule_anomaly = 0 AND iso_is_anomaly = 0) AS markov FROM alerts GROUP BY 1"
    ),
    "hourly_attacks": scored(
        "SELECT hour, predicted_attack_type, count(*) AS n FROM alerts GROUP BY 1, 2"
    ),
    "risk_box_stats": scored(
        f"SELECT predicted_attack_type, {r6('min(risk_score)')} AS low, "
        f"{r6('quantile_cont(risk_score, 0.25)')} AS q1, {r6('quantile_cont(risk_score, 0.5)')} AS median, "
        f"{r6('quantile_cont(risk_score, 0.75)')} AS q3, {r6('max(risk_score)')} AS high FROM alerts GROUP BY 1"
    ),
    "confusion_matrix": scored(
        f"SELECT tp, fp, fn, tn, {r6('p')} AS precision, {r6('r')} AS recall, "
        f"{r6('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy, {r6('2 * p * r / (p + r)')} AS f1 FROM ("
        "SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM (SELECT "
        "count(*) FILTER (WHERE predicted_attack_type <> 'normal' AND is_attack) AS tp, "
        "count(*) FILTER (WHERE predicted_attack_type <> 'normal' AND NOT is_attack) AS fp, "
        "count(*) FILTER (WHERE predicted_attack_type = 'normal' AND is_attack) AS fn, "
        "count(*) FILTER (WHERE predicted_attack_type = 'normal' AND NOT is_attack) AS tn FROM scored))"
    ),
    "attack_summary": scored(
        f"SELECT predicted_attack_type AS attack_type, count(*) AS n, {_MEAN_RISK} AS avg_risk_score, "
        "max(risk_score) AS max_risk_score, count(DISTINCT user_id) AS unique_users, "
        f"count(DISTINCT source_ip) AS unique_ips, max({_SEVERITY}) AS severity FROM alerts GROUP BY 1 "
        f"UNION ALL SELECT 'total', count(*), {_MEAN_RISK}, NULL, count(DISTINCT user_id), NULL, NULL FROM alerts"
    ),
    "ground_truth_counts": q(
        f"SELECT attack_type, n, attacks, {r6('n / sum(n) OVER ()')} AS share FROM (SELECT attack_type, count(*) AS n, "
        "count(*) FILTER (WHERE is_attack) AS attacks FROM log GROUP BY 1)"
    ),
    "minmax_scale": q(
        "SELECT event_id, "
        + r6("(bytes_transferred - min(bytes_transferred) OVER ()) / (max(bytes_transferred) OVER () - min(bytes_transferred) OVER ())")
        + " AS scaled FROM log"
    ),
    "percentile_threshold": q(f"SELECT {r6('quantile_cont(bytes_transferred, 0.92)')} AS threshold FROM log"),
    "standardize": q(
        "SELECT event_id, "
        + r6("(bytes_transferred - avg(bytes_transferred) OVER ()) / stddev_pop(bytes_transferred) OVER ()")
        + " AS bytes_transferred_z FROM log"
    ),
    "running_entropy": feat(f"{r6('event_type_entropy')} AS event_type_entropy"),
    "seconds_since_prev": feat(f"{r6('seconds_since_prev')} AS seconds_since_prev"),
    "minutes_since_prev": feat(f"{r6('minutes_since_prev')} AS minutes_since_prev"),
    "seconds_since_prev_same_type": feat(
        f"{r6('seconds_since_prev_same_type')} AS seconds_since_prev_same_type"
    ),
    "cumulative_event_count": feat("cumulative_event_count"),
    "is_first_event_of_day": feat("is_first_event_of_day"),
    "is_last_event_of_day": feat("is_last_event_of_day"),
    "transition_flags": feat(_TRANSITION_NAMES),
    "cumulative_devices_seen": feat("cumulative_devices_seen"),
    "is_new_device": feat("is_new_device"),
    "is_new_ip": feat("is_new_ip"),
    "feature_matrix": feature_matrix(),
    "rolling_window_mask": q(
        "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY timestamp "
        "RANGE BETWEEN INTERVAL 48 HOUR PRECEDING AND CURRENT ROW) AS in_window FROM log"
    ),
    "rolling_failed_logins": rules("SELECT event_id, failures FROM logins"),
    "rolling_unique_resources": rules("SELECT event_id, resources FROM spread"),
    "half_split_rates": rules(
        f"SELECT event_id, half, {r6('first_rate')} AS first_rate, {r6('second_rate')} AS second_rate FROM rates"
    ),
    "daily_user_total": rules("SELECT event_id, day_bytes FROM moved"),
    "sample_normal_rows": q(
        "SELECT event_id FROM log WHERE NOT is_attack "
        "QUALIFY row_number() OVER (ORDER BY substr(md5('42:' || event_id), 1, 13), event_id) "
        "<= greatest(1, CAST(floor((SELECT count(*) FROM log) * 0.03) AS BIGINT))"
    ),
    "ip_semi_join": rules(
        "SELECT event_id, source_ip FROM log WHERE is_login AND source_ip IN (SELECT source_ip FROM crowded)"
    ),
    "agg_join_back": feat("events_in_window, max_bytes_user"),
    "prob_lookup_join": q(
        f"SELECT event_id, {r6('ln(coalesce(prob, 1e-6) + 1e-12)')} AS markov_raw "
        "FROM pairs LEFT JOIN probs USING (prefix, next)", MARKOV
    ),
    "sort_user_time": q("SELECT user_id, timestamp, event_id FROM log ORDER BY 1, 2, 3"),
    "alert_topk": scored(
        "SELECT event_id, predicted_attack_type, risk_score, risk_level FROM alerts WHERE risk_level <> 'LOW' "
        "ORDER BY risk_score DESC, event_id LIMIT 50"
    ),
    "entity_values": q("SELECT DISTINCT device_id FROM log"),
    "entity_timeline": scored(
        "SELECT timestamp, event_type, predicted_attack_type, risk_score, event_id, source_ip, device_id "
        "FROM scored WHERE username = 'name_7'"
    ),
    "entity_risk_series": scored(
        "SELECT timestamp, event_id, risk_score, risk_score >= 50 AS above_medium, risk_score >= 75 AS above_high "
        "FROM scored WHERE username = 'name_7'"
    ),
    "rule_brute_force": rules("SELECT event_id, user_id FROM h1"),
    "rule_impossible_travel": rules("SELECT event_id, user_id FROM h2"),
    "rule_credential_stuffing": rules("SELECT event_id, user_id FROM h3"),
    "rule_lateral_movement": rules("SELECT event_id, user_id FROM h4"),
    "rule_device_spoofing": rules("SELECT event_id, user_id FROM h5"),
    "rule_exfiltration": rules("SELECT event_id, user_id FROM h6"),
    "rule_insider_drift": rules("SELECT event_id, user_id FROM h7"),
    "rules_combined": q("SELECT * FROM combined", RULES, COMBINED),
    "rule_trigger_counts": q("SELECT name AS rule_name, count(*) AS hits FROM hits GROUP BY 1", RULES, COMBINED),
    "add_rule": q(
        "SELECT event_id, CASE WHEN b OR l THEN 1 ELSE 0 END AS rule_anomaly, "
        "CASE WHEN b AND l THEN 'brute_force_login,large_transfer' WHEN b THEN 'brute_force_login' "
        "WHEN l THEN 'large_transfer' ELSE '' END AS rule_names, "
        "CASE WHEN b THEN 4 WHEN l THEN 1 ELSE 0 END AS rule_severity, "
        "CASE WHEN b THEN 'brute_force' WHEN l THEN 'low_and_slow_exfiltration' ELSE 'none' END AS rule_attack_type "
        "FROM (SELECT event_id, event_id IN (SELECT event_id FROM h1) AS b, bytes_transferred > 10000000 AS l FROM log)",
        RULES,
    ),
    "rule_credential_stuffing_windowed": q(
        "SELECT event_id, user_id FROM (SELECT *, count(DISTINCT user_id) OVER (PARTITION BY source_ip ORDER BY timestamp "
        "RANGE BETWEEN INTERVAL 10080 MINUTE PRECEDING AND CURRENT ROW) AS users FROM log WHERE is_login) WHERE users >= 5"
    ),
    "rule_impossible_travel_geo": q(
        f"SELECT event_id, user_id FROM (SELECT *, {_KM} AS km FROM (SELECT *, "
        + _HAV.format(lat1="last_lat", lon1="last_lon", lat2="latitude", lon2="longitude")
        + " AS a FROM logins)) WHERE km >= 500 AND epoch_us(timestamp) - epoch_us(last_ts) > 0 "
        "AND epoch_us(timestamp) - epoch_us(last_ts) < 12 * 3600000000",
        RULES,
    ),
    "user_sequences": q(
        "SELECT user_id, string_agg(event_type, ',' ORDER BY timestamp, event_id) AS sequence FROM log "
        "GROUP BY user_id HAVING count(*) > 1"
    ),
    "markov_transitions": q("SELECT event_id, prefix, next FROM pairs", MARKOV),
    "markov_transitions_order2": q("SELECT event_id, prefix, next FROM pairs2", PAIRS2),
    "markov_counts": q("SELECT prefix, next, cnt FROM counts", MARKOV),
    "markov_counts_order2": q("SELECT prefix, next, cnt FROM counts2", PAIRS2),
    "markov_probs": q(f"SELECT prefix, next, cnt, {r6('prob')} AS prob FROM probs", MARKOV),
    "markov_threshold": q(f"SELECT training_pairs, {r6('cut')} AS threshold FROM threshold", MARKOV),
    "markov_score_raw": q(f"SELECT event_id, {r6('markov_raw')} AS markov_raw FROM markov", MARKOV),
    "markov_score_raw_order2": q(
        f"SELECT event_id, CASE WHEN p2 IS NULL THEN 0.0 ELSE {r6('ln(coalesce(prob, 1e-6) + 1e-12)')} END AS markov_raw "
        "FROM seq2 LEFT JOIN probs2 ON p2 || '>' || p1 = probs2.prefix AND seq2.next = probs2.next",
        PAIRS2,
    ),
    "markov_predict": q("SELECT event_id, markov_label, markov_is_anomaly FROM markov", MARKOV),
    "markov_score": q(f"SELECT event_id, {r6('markov_score')} AS markov_score FROM markov", MARKOV),
    "iforest_sample": forest("SELECT tree AS tree_id, count(*) AS rows FROM samples GROUP BY tree"),
    "iforest_fit": forest(
        f"SELECT tree AS tree_id, count(*) AS nodes, {r6('sum(ln(1 + abs(cut)))')} AS cuts, CAST(sum(f - 1) AS BIGINT) AS features "
        "FROM nodes GROUP BY tree"
    ),
    "iforest_score": forest(f"SELECT event_id, {r6('iso_raw')} AS iso_raw FROM forest"),
    "iforest_predict": forest("SELECT event_id, iso_anomaly_label, iso_is_anomaly FROM forest"),
    "iforest_normalized": forest(f"SELECT event_id, {r6('iso_anomaly_score')} AS iso_anomaly_score FROM forest"),
    "score_events": scored_with_forest(
        f"SELECT event_id, {r6('iso_anomaly_score')} AS iso_anomaly_score, {r6('markov_score')} AS markov_score, rule_names, "
        f"{r6('composite_score')} AS composite_score, risk_score, risk_level, predicted_attack_type FROM scored"
    ),
    "composite_score": scored(f"SELECT event_id, {r6('composite_score')} AS composite_score FROM scored"),
    "risk_score": scored("SELECT event_id, risk_score FROM scored"),
    "predicted_attack_type": scored("SELECT event_id, predicted_attack_type FROM scored"),
    "heuristic_attack_type": scored("SELECT event_id, guess FROM scored"),
    "classify": scored(
        f"SELECT event_id, {r6('composite_score')} AS composite_score, risk_score, predicted_attack_type, "
        "risk_level, risk_color FROM scored"
    ),
    "stream_brute_force": q(
        "SELECT user_id, make_timestamp(w * 43200000000) AS start, count(*) AS failures FROM ("
        "SELECT user_id, unnest(range(epoch_us(timestamp) // 43200000000 - 5, epoch_us(timestamp) // 43200000000 + 1)) AS w "
        "FROM log WHERE is_login AND NOT success) GROUP BY 1, 2 HAVING count(*) >= 3"
    ),
    "stream_daily_exfil": q(
        "SELECT user_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS event_date, CAST(sum(bytes_transferred) AS BIGINT) AS moved "
        "FROM log WHERE is_transfer GROUP BY 1, 2 HAVING sum(bytes_transferred) > 15000 * 1024"
    ),
    "stream_brute_force_rows": rules("SELECT event_id, user_id FROM h1"),
    "stream_new_device": rules("SELECT event_id, user_id FROM h5"),
    "stream_markov": q(f"SELECT event_id, {r6('markov_raw')} AS markov_raw FROM markov", MARKOV),
}
