"""Times the stages of a full scoring run and the headline reports; prints one JSON line.

    BENCH_SF_DIR   folder with the tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)

Every stage is run ``BENCH_RUNS`` times (default 2) and the best run counts, so that a
stage is not charged for compiling code that it shares with the others. The first, cold
run of the whole chain is reported as ``first_run``.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame

from checks.queries import CONFIG, RULES
from riskline.operators import rules as R
from riskline.operators.features import feature_matrix
from riskline.operators.forest import ForestModel
from riskline.operators.fusion import classify
from riskline.operators.markov import MarkovModel
from riskline.operators.timeline import Timeline
from riskline.plans import reports
from riskline.plans.scoring import fit_and_score
from riskline.schema import FEATURES
from riskline.session import materialize, start
from riskline.sources.activity import read_activity

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def drain(df: DataFrame) -> None:
    """Compute every column of every row."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = start(
        "riskline-bench",
        f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, fn, runs=RUNS):
        best, result = None, None
        for _ in range(runs):
            began = time.perf_counter()
            result = fn()
            spent = time.perf_counter() - began
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
        return result

    log = timed("ingest", lambda: materialize(read_activity(spark, FOLDER).repartition(int(CPUS)), "log"), 1)
    events = log.count()

    timed("first_run", lambda: drain(fit_and_score(log, CONFIG)[1]), 1)
    scored = timed("score_events", lambda: materialize(fit_and_score(log, CONFIG)[1], "scored"))

    timeline = Timeline.plan(log)
    table = timed("feature_matrix", lambda: materialize(feature_matrix(log, timeline), "features"))
    timed("rules_combined", lambda: drain(R.evaluate(log, None, timeline, RULES)))
    for rule in R.default_rules(RULES):
        timed(f"rule_{rule.name}", lambda rule=rule: drain(R.flag_rows(log, rule, timeline)))
    model = timed("markov_fit", lambda: MarkovModel.fit(log, timeline=timeline))
    timed("markov_score", lambda: drain(model.transform(log, timeline)))
    forest = timed("iforest_fit", lambda: ForestModel.grow(table, FEATURES))
    timed("iforest_score", lambda: drain(forest.score(table)))
    timed("classify", lambda: drain(classify(scored.drop("composite_score", "risk_score"))))

    boards = {
        "overview": [reports.overview_kpis, reports.daily_event_volume,
                     reports.attack_type_distribution, reports.risk_histogram],
        "alerts": [reports.alert_feed_counts, reports.alert_topk],
        "entities": [lambda df: reports.entity_summary(df, "username")],
        "analytics": [reports.detector_agreement, reports.attack_by_detector,
                      reports.hourly_attacks, reports.risk_box_stats, reports.confusion_matrix],
    }
    for name, queries in boards.items():
        timed(f"board_{name}", lambda queries=queries: [drain(query(scored)) for query in queries])

    print(
        json.dumps(
            {
                "metric": "full scoring of the event log",
                "value": times["score_events"],
                "unit": "sec",
                "queries": times,
                "events": events,
                "events_per_sec": round(events / times["score_events"]),
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
