"""Maps a generic activity stream onto the event-log schema.

The stream has ``event_id, ts, user_id, event_type, value, props`` with a small integer
``k`` inside the JSON of ``props``; every column the log needs is derived from these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskline.schema import ATTACK_TYPES
from riskline.sources.events import conform_events

def _pick(labels, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), (index + 1).cast("int"))


def activity_events(activity: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    df = activity.withColumn("k", k)
    k, kind, user = F.col("k"), F.col("event_type"), F.col("user_id")
    even, quarter = k % 2 == 0, k % 4
    event_type = (
        F.when(kind == "signup", F.when(even, "login").otherwise("logout"))
        .when(kind == "error", F.when(even, "login").otherwise("vpn_login"))
        .when(
            kind == "click",
            F.when(quarter == 0, "admin_command")
            .when(quarter == 1, "email_access")
            .otherwise("application_launch"),
        )
        .when(kind == "view", F.when(even, "file_access").otherwise("database_query"))
        .otherwise(F.when(quarter == 0, "usb_usage").otherwise("shared_folder_access"))
    )
    own_ip = F.concat_ws(
        ".", F.lit("10"), F.floor(user / 256).cast("string"),
        (user % 256).cast("string"), (k % 3).cast("string"),
    )
    moves = kind.isin("view", "purchase") | ((kind == "click") & (quarter == 1))
    labelled = k >= 90
    located = event_type.isin("login", "vpn_login")
    return conform_events(
        df.select(
            F.format_string("EVT-%06d", "event_id").alias("event_id"),
            F.col("ts").cast("timestamp").alias("timestamp"),
            F.format_string("user_%04d", user).alias("user_id"),
            F.concat(F.lit("name_"), (user % 100).cast("string")).alias("username"),
            event_type.alias("event_type"),
            F.when(k < 5, F.concat(F.lit("203.0.113."), k.cast("string")))
            .otherwise(own_ip)
            .alias("source_ip"),
            F.concat(F.lit("DEV-"), (user * 10 + quarter).cast("string")).alias("device_id"),
            F.concat(F.lit("dept_"), (user % 8).cast("string")).alias("department"),
            F.concat(F.lit("res_"), (k % 25).cast("string")).alias("resource"),
            (kind != "error").alias("success"),
            F.when(moves, F.floor(F.col("value") * 100000)).otherwise(0).alias("bytes_transferred"),
            labelled.alias("is_attack"),
            F.when(labelled, _pick(ATTACK_TYPES, k % 7)).otherwise("none").alias("attack_type"),
            F.when(located, -60.0 + k).alias("latitude"),
            F.when(located, -150.0 + 3 * k).alias("longitude"),
            F.when(located, F.concat(F.lit("city_"), (k % 8).cast("string"))).alias("city"),
        )
    )


def read_activity(spark: SparkSession, folder: str) -> DataFrame:
    return activity_events(spark.read.parquet(f"{folder}/events.parquet"))
