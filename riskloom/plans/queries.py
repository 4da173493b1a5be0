"""The registered queries: each one runs an operator over whole given tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.expressions import offset_seconds
from riskloom.operators import cases as C
from riskloom.operators import drift, explain, flagging, metrics, model, quality, rolling, split
from riskloom.operators.features import (
    HISTORY_INPUTS,
    ORDER,
    card_prior_average,
    email_history,
    prepare,
    profile_transactions,
    transaction_features,
)
from riskloom.operators.history import History, arrival_features, stored_features
from riskloom.operators.lookup import (
    features_for_ids,
    features_for_new,
    high_water,
    model_inputs,
)
from riskloom.operators.prefix import time_rank
from riskloom.plans import etl
from riskloom.schemas import (
    ANALYST_DECISIONS,
    ARRIVAL,
    IDENTITIES,
    IDENTITY_COLUMNS,
    TRANSACTION_COLUMNS,
    TRANSACTIONS,
)
from riskloom.session import grown, materialise, workspace
from riskloom.sources import fixtures as X
from riskloom.sources import tables
from riskloom.sources.keyed import KeyedTable
from riskloom.sources.versioned import Table, Versions
from riskloom.streaming import live
from riskloom.streaming import rolling as live_rolling

TREES = 200
DAY = 86400
WEEK = 7 * DAY
HALF_MONTH = 15 * DAY

_written: dict[tuple, DataFrame | History | str] = {}


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table, written once per session and input, then read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        _written[key] = materialise(
            transaction_features(
                X.transactions(spark, sf_dir), X.identities(spark, sf_dir)
            ),
            "features",
        )
    return _written[key]


def scored_table(spark, sf_dir):
    return X.rule_score(feature_table(spark, sf_dir))


def flagged_table(spark, sf_dir):
    return flagging.flag(scored_table(spark, sf_dir))


def decision_table(spark, sf_dir):
    return X.decisions(flagged_table(spark, sf_dir), feature_table(spark, sf_dir))


# --- sources, sinks, quality --------------------------------------------------


def scan_transactions(spark, sf_dir):
    path = workspace(spark, "transactions-csv")
    X.transactions(spark, sf_dir).write.option("header", True).csv(path)
    return tables.read_transactions(spark, path, "csv")


def scan_identities(spark, sf_dir):
    path = workspace(spark, "identities-csv")
    X.raw_identities(spark, sf_dir).write.option("header", True).csv(path)
    return tables.read_identities(spark, path, "csv")


def scan_sample(spark, sf_dir):
    """The first 5,000 transactions by id, and which of them have identities."""
    sampled = tables.sample_transactions(X.transactions(spark, sf_dir), 5000)
    kept = tables.sample_identities(X.identities(spark, sf_dir), sampled)
    return sampled.join(
        kept.select("transactionid", "devicetype"), "transactionid", "left"
    ).select("transactionid", "transactiondt", "transactionamt", "devicetype")


def load_if_absent(spark, sf_dir):
    """Load everything twice over a target that holds the first half month."""
    rows = X.transactions(spark, sf_dir).select(
        "transactionid", "transactiondt", "transactionamt", "card1"
    )
    existing = rows.filter(F.col("transactiondt") < HALF_MONTH)
    sent = rows.withColumn("ingest_order", F.col("transactionid") * 2)
    resent = rows.withColumn("ingest_order", F.col("transactionid") * 2 + 1).withColumn(
        "transactionamt", (F.col("transactionamt") + 1).cast("decimal(10,2)")
    )
    return tables.load_if_absent(
        resent.unionByName(sent), existing, defaults={"productcd": "W"}
    )


def load_indexed(spark, sf_dir):
    """The same load into a stored table whose key index says which groups to read; then all of it once more."""
    rows = X.transactions(spark, sf_dir).select("transactionid", "transactiondt", "transactionamt", "card1")
    table = KeyedTable(spark, workspace(spark, "keyed"))
    sent = rows.withColumn("ingest_order", F.col("transactionid") * 2)
    resent = sent.withColumns(
        {"ingest_order": F.col("ingest_order") + 1, "transactionamt": (F.col("transactionamt") + 1).cast("decimal(10,2)")}
    )
    table.load(sent.filter(F.col("transactiondt") < HALF_MONTH), 0, defaults={"productcd": "H"})
    for run in (1, 2):
        table.load(resent.unionByName(sent), run, defaults={"productcd": "W"})
    return table.read()


def etl_merged(spark, sf_dir):
    return etl.merge(X.transactions(spark, sf_dir), X.raw_identities(spark, sf_dir)).select(
        *TRANSACTION_COLUMNS, *IDENTITY_COLUMNS[1:]
    )


def split_identities(spark, sf_dir):
    merged = etl.merge(X.transactions(spark, sf_dir), X.raw_identities(spark, sf_dir))
    return etl.split_merged(merged)[1]


def etl_load(spark, sf_dir):
    """The whole ETL over a target that holds the first half month."""
    def ordered(rows):
        return rows.withColumn("ingest_order", F.col("transactionid"))

    rows = X.transactions(spark, sf_dir)
    have = rows.filter(F.col("transactiondt") < HALF_MONTH)
    devices = X.raw_identities(spark, sf_dir)
    new_t, new_i = etl.run_etl(
        ordered(rows), ordered(devices), have, tables.sample_identities(devices, have), None
    )
    return new_t.join(grown(new_i.select("transactionid", "devicetype")), "transactionid", "left").select(
        "transactionid", "transactiondt", "transactionamt", "card1", "p_emaildomain", "devicetype"
    )


def _etl_target(spark, sf_dir) -> str:
    """CSV folders loaded twice, after a first load of the first half month; identities come whole each time. Once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, "etl")
    if key in _written:
        return _written[key]
    source, target = workspace(spark, "etl-files"), workspace(spark, "etl-target")
    rows, devices = X.transactions(spark, sf_dir), X.raw_identities(spark, sf_dir)
    bad = rows.filter("transactionid % 100 = 3").withColumn("transactionamt", F.lit("123456789012.00"))
    early = F.col("transactiondt") < HALF_MONTH

    def csv(name, df):
        df.write.option("header", True).csv(f"{source}/{name}")

    csv("first", rows.filter(early & (F.col("transactionid") % 100 != 3)))
    csv("all", rows.filter("transactionid % 100 <> 3").withColumn("transactionamt", F.col("transactionamt").cast("string")).union(bad))
    csv("devices", devices)
    for name in ("first", "all", "all"):
        etl.etl_files(spark, f"{source}/{name}", f"{source}/devices", target)
    _written[key] = target
    return target


def etl_files(spark, sf_dir):
    """What the target holds after all runs, and the rejected transactions of the last one."""
    target = _etl_target(spark, sf_dir)
    loaded = tables.read_target(spark, f"{target}/transactions", TRANSACTIONS).select(
        "transactionid", "transactiondt", "transactionamt", F.lit("loaded").alias("outcome")
    )
    identities = tables.read_target(spark, f"{target}/identities", IDENTITIES)
    rejected = tables.latest_refresh(spark, f"{target}/rejects_transactions").select(
        F.col("transactionid").cast("long"),
        F.col("transactiondt").cast("long"),
        F.lit(None).cast("decimal(10,2)").alias("transactionamt"),
        F.array_join("reasons", ",").alias("outcome"),
    )
    return loaded.union(rejected).join(
        grown(identities.select("transactionid", "devicetype")), "transactionid", "left"
    )


def etl_rejects(spark, sf_dir):
    """Rejects of each run: bad amounts, and identities whose transactions come with a later run."""
    target = _etl_target(spark, sf_dir)
    parts = [
        spark.read.parquet(f"{target}/rejects_{name}").select(
            F.lit(name).alias("rejected_from"),
            F.col("run").cast("long"),
            F.col("transactionid").cast("long"),
            F.array_join("reasons", ",").alias("reasons"),
        )
        for name in ("transactions", "identities")
    ]
    return parts[0].union(parts[1])


def time_ordered(spark, sf_dir):
    """Written in time order by day, and read back."""
    path = workspace(spark, "time-ordered")
    tables.write_in_time_order(X.transactions(spark, sf_dir), path)
    return tables.read_table(spark, path).select("transactionid", "transactiondt", "transactionamt", F.col("day").cast("long"))


def customer_ordered(spark, sf_dir):
    """Features written by (customer, time), read back with the place of each row in the files."""
    path = workspace(spark, "customer-ordered")
    keyed = prepare(X.transactions(spark, sf_dir)).select("transactionid", "uid", "transactiondt")
    tables.write_in_order(keyed, path, ["uid", *ORDER])
    return tables.with_file_position(spark, path, "position").select("position", "uid", "transactiondt", "transactionid")


def prune_columns(spark, sf_dir):
    return etl.prune_columns(X.raw_export(spark, sf_dir), TRANSACTION_COLUMNS)


def quality_rejects(spark, sf_dir):
    checked = quality.check_rows(X.raw_feed(spark, sf_dir), "transactions", TRANSACTIONS)
    return quality.rejected_rows(checked).select(
        "ingest_order", F.array_join("reasons", ",").alias("reasons")
    )


def quality_valid(spark, sf_dir):
    checked = quality.check_rows(X.raw_feed(spark, sf_dir), "transactions", TRANSACTIONS)
    return quality.valid_rows(checked, TRANSACTIONS)


def quality_decisions(spark, sf_dir):
    checked = quality.check_rows(
        X.raw_decisions(spark, sf_dir),
        "analyst_decisions",
        ANALYST_DECISIONS,
        key=None,
        parents=flagged_table(spark, sf_dir),
    )
    return quality.rejected_rows(checked).select(
        "ingest_order", F.array_join("reasons", ",").alias("reasons")
    )


def cascade_retain(spark, sf_dir):
    """Identity rows left after all fraudulent transactions are deleted."""
    kept = X.transactions(spark, sf_dir).filter("isfraud = 0")
    return quality.cascade_retain(X.identities(spark, sf_dir), kept).select(
        "transactionid", "devicetype"
    )


def cascade_stored(spark, sf_dir):
    """Fraudulent transactions deleted from stored tables, the same delete run twice: what is left by table."""
    flagged, decided = flagged_table(spark, sf_dir), decision_table(spark, sf_dir)
    frames = {
        "transactions": X.transactions(spark, sf_dir).select("transactionid", "isfraud", "transactionamt"),
        "identities": X.identities(spark, sf_dir).select("transactionid", "devicetype"),
        "flagged": flagged.select("transactionid", "fraud_probability"),
        "decisions": decided.select("transactionid", "analyst_name", "decision"),
    }
    stored = Versions(spark, workspace(spark, "versions"), [
        Table("transactions", "transactionid"),
        Table("identities", "transactionid", "transactions", "transactionid"),
        Table("flagged", "transactionid", "transactions", "transactionid"),
        Table("decisions", "transactionid", "flagged", "transactionid"),
    ])
    stored.load(frames)
    for _ in range(2):
        stored.delete("transactions", stored.read("transactions", 0).filter("isfraud = 1"), 1)
    parts = [stored.read(name).select(F.lit(name).alias("kept_in"), "transactionid") for name in frames]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


# --- features -------------------------------------------------------------------


def features(spark, sf_dir):
    return transaction_features(
        X.transactions(spark, sf_dir), X.identities(spark, sf_dir)
    )


def email_prefix(spark, sf_dir):
    keyed = prepare(X.transactions(spark, sf_dir)).select(*HISTORY_INPUTS)
    counted = email_history(keyed, profile_transactions(keyed))
    return counted.select("transactionid", "p_emaildomain", "email_txn_count_before_this")


def latest_per_card(spark, sf_dir):
    return (
        X.transactions(spark, sf_dir)
        .groupBy("card1")
        .agg(F.max("transactionid").alias("transactionid"))
        .select("transactionid")
    )


def stored_history(spark, sf_dir, until=None) -> History:
    """The history, stored once per session and input, then read; all of it or up to a time."""
    key = (spark.sparkContext.applicationId, sf_dir, "history", until)
    if key not in _written:
        history = History(spark, workspace(spark, "history"))
        rows = X.transactions(spark, sf_dir)
        history.append(rows if until is None else rows.filter(F.col("transactiondt") < until))
        _written[key] = history
    return _written[key]


def history_store(spark, sf_dir):
    """Totals per key and slice of a history stored in two parts."""
    history = History(spark, workspace(spark, "history"))
    rows = X.transactions(spark, sf_dir)
    history.append(rows.filter(F.col("transactiondt") < HALF_MONTH))
    history.append(rows.filter(F.col("transactiondt") >= HALF_MONTH))
    totals = spark.read.parquet(f"{history.path}/totals").groupBy("kind", "key", "slice")
    return totals.agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.max("last").alias("last_dt"))


def lookup(spark, sf_dir):
    """The latest transaction of each card, looked up in the stored history."""
    return stored_features(stored_history(spark, sf_dir), X.identities(spark, sf_dir), latest_per_card(spark, sf_dir))


def lookup_unstored(spark, sf_dir):
    """The same ids, from a plain table of transactions."""
    return features_for_ids(
        X.transactions(spark, sf_dir),
        X.identities(spark, sf_dir),
        latest_per_card(spark, sf_dir),
    )


def _second_half(spark, sf_dir):
    return X.transactions(spark, sf_dir).filter(F.col("transactiondt") >= HALF_MONTH).select(*ARRIVAL.names)


def arrivals_lookup(spark, sf_dir):
    """The second half month arrives with the six facts a caller knows, some of it twice; the first row of an id counts."""
    arrivals = _second_half(spark, sf_dir).withColumn("place", F.lit(1))
    again = arrivals.filter("transactionid % 10 = 1").withColumns({"place": F.lit(2), "card1": F.lit(0)})
    history = stored_history(spark, sf_dir, HALF_MONTH)
    return arrival_features(history, X.identities(spark, sf_dir), again.unionByName(arrivals), "place")


def arrivals_unstored(spark, sf_dir):
    """The same arrivals over a plain table of transactions."""
    old = X.transactions(spark, sf_dir).filter(F.col("transactiondt") < HALF_MONTH)
    return features_for_new(old, X.identities(spark, sf_dir), _second_half(spark, sf_dir))


def lookup_inputs(spark, sf_dir):
    return model_inputs(lookup(spark, sf_dir))


def card_prior_avg(spark, sf_dir):
    return card_prior_average(X.transactions(spark, sf_dir), 20)


def card_prior_avg_ties(spark, sf_dir):
    """All rows of the tie-heavy order data."""
    return card_prior_average(X.order_transactions(spark, sf_dir), None)


def _spend(rows: DataFrame) -> DataFrame:
    return rows.select(
        "transactionid", "rolling_n", (F.col("rolling_cents") / 100).cast("decimal(20,2)").alias("rolling_spend")
    )


def rolling_spend(spark, sf_dir):
    """What each customer spent in the week up to each transaction."""
    keyed = prepare(X.transactions(spark, sf_dir)).select("transactionid", "transactiondt", "uid", "amt_cents")
    return _spend(rolling.rolling_spend(keyed, WEEK))


def rolling_spend_domains(spark, sf_dir):
    """The same by e-mail domain, one of which holds nearly half of all rows, and one of which is missing."""
    keyed = prepare(X.transactions(spark, sf_dir)).select("transactionid", "transactiondt", "p_emaildomain", "amt_cents")
    return _spend(rolling.rolling_spend(keyed, DAY, "p_emaildomain"))


def rolling_spend_ties(spark, sf_dir):
    """90 days by card in the tie-heavy order data."""
    rows = X.order_transactions(spark, sf_dir).select(
        "transactionid", "transactiondt", "card1", (F.col("transactionamt") * 100).cast("long").alias("amt_cents")
    )
    return _spend(rolling.rolling_spend(rows, 90 * DAY, "card1"))


def offset_from_calendar(spark, sf_dir):
    return X.table(spark, sf_dir, "events").select(
        "event_id", offset_seconds("ts", "2019-01-01").alias("offset_s")
    )


def next_keys(spark, sf_dir):
    return high_water(X.transactions(spark, sf_dir))


# --- split, metrics, model --------------------------------------------------------


def time_rank_all(spark, sf_dir):
    rows = X.order_transactions(spark, sf_dir).select("transactionid", "transactiondt")
    return time_rank(rows, *ORDER, "position")


def time_split(spark, sf_dir):
    return split.split_summary(split.split_by_time(X.transactions(spark, sf_dir).select(*ORDER)))


def time_split_ties(spark, sf_dir):
    """Side of every row where many rows share one time."""
    rows = X.order_transactions(spark, sf_dir).select(*ORDER)
    return split.split_by_time(rows).select("transactionid", "side")


def drift_split(spark, sf_dir):
    rows = X.transactions(spark, sf_dir).select(*ORDER)
    return split.split_summary(split.split_for_drift(rows))


def test_side(spark, sf_dir):
    return split.split_by_time(scored_table(spark, sf_dir)).filter("side = 'test'")


def threshold_costs(spark, sf_dir):
    return metrics.threshold_costs(test_side(spark, sf_dir))


def best_threshold(spark, sf_dir):
    return metrics.best_threshold(threshold_costs(spark, sf_dir))


def roc_auc(spark, sf_dir):
    return metrics.roc_auc(scored_table(spark, sf_dir))


def average_precision(spark, sf_dir):
    return metrics.average_precision(scored_table(spark, sf_dir)).select(
        F.round("average_precision", 9).alias("average_precision")
    )


_models: dict[tuple, object] = {}


def training(spark, sf_dir):
    """The model and its row of metrics; one training serves all queries of a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _models:
        _models[key] = model.training_run(feature_table(spark, sf_dir), trees=TREES)
    return _models[key]


def trained_model(spark, sf_dir):
    return training(spark, sf_dir)[0]


def train_gbt(spark, sf_dir):
    """Feature importances of the trained model."""
    fitted = trained_model(spark, sf_dir)
    rows = [(c, float(w)) for c, w in zip(model.MODEL_FEATURES, fitted.featureImportances)]
    return spark.createDataFrame(rows, "feature string, importance double")


def score_batch(spark, sf_dir):
    """Flagged transactions with the reasons the trees give."""
    fitted = trained_model(spark, sf_dir)
    scored = model.score(feature_table(spark, sf_dir), fitted).filter(flagging.is_flagged())
    contributions = explain.tree_contributions(scored, fitted, keep=("score",))
    return flagging.score_response(explain.ranked(contributions, ("score",)))


def score_response(spark, sf_dir):
    """The same record for all transactions under the rule score, one row per reason."""
    scored = scored_table(spark, sf_dir)
    contributions = explain.linear_contributions(
        scored, X.RULE_WEIGHTS, explain.feature_means(scored)
    )
    response = flagging.score_response(explain.ranked(contributions, ("score",)))
    return response.select("*", F.posexplode("reasons")).select(
        "transactionid",
        "fraud_probability",
        "flagged",
        "verdict",
        "threshold_used",
        (F.col("pos") + 1).alias("rank"),
        "col.feature",
        "col.contribution",
    )


def training_run(spark, sf_dir):
    return training(spark, sf_dir)[1]


def training_checks(spark, sf_dir):
    """What must hold of any training run on this input.

    The model ranks the test rows at least nearly as well as their amounts alone do, whose exact ROC AUC stands beside.
    """
    row = training(spark, sf_dir)[1]
    importances = train_gbt(spark, sf_dir).agg(F.round(F.sum("importance"), 6).alias("total"))
    test = split.split_by_time(feature_table(spark, sf_dir)).filter("side = 'test'")
    baseline = metrics.roc_auc(test.withColumn("score", F.col("transactionamt").cast("double")))
    in_range = F.col("roc_auc").between(0.5, 1.0) & F.col("pr_auc").between(0.0, 1.0)
    row = row.withColumn("baseline", F.lit(baseline.first()[0]))
    return row.crossJoin(importances).select(  # one row each
        "trees",
        "train_rows",
        "test_rows",
        (in_range & F.col("best_threshold").between(0.01, 0.99)).alias("metrics_in_range"),
        (F.col("total") == 1.0).alias("importances_add_up"),
        F.round("baseline", 9).alias("amount_auc"),
        (F.col("roc_auc") >= F.col("baseline") - 0.02).alias("ranks_like_amount"),
    )


def tree_leaves(spark, sf_dir):
    """One tree of one split between small and large amounts: the score of each leaf, and its rows."""
    large = (F.col("transactionamt") >= 400).cast("double")
    flat = {c: F.lit(0.0) for c in model.MODEL_FEATURES}
    rows = feature_table(spark, sf_dir).withColumn("large", large)
    fixed = rows.select("transactionid", model.LABEL, "large", *[v.alias(c) for c, v in flat.items()])
    fixed = fixed.withColumn("transactionamt", F.col("large"))
    fitted = model.train_model(fixed, trees=1, depth=1)
    scored = model.score(fixed, fitted).groupBy(F.col("large").cast("int").alias("large"))
    return scored.agg(F.round(F.min("score"), 9).alias("low"), F.round(F.max("score"), 9).alias("high"), F.count("*").alias("n"))


def score_checks(spark, sf_dir):
    """For every row: the score is a probability, and the contributions add up to its log-odds."""
    scored = model.score(feature_table(spark, sf_dir), trained_model(spark, sf_dir))
    parts = explain.tree_contributions(scored, trained_model(spark, sf_dir), keep=("score",))
    total = sum((F.col(f"c_{c}") for c in model.MODEL_FEATURES), F.col("base"))
    log_odds = F.log(F.col("score") / (1 - F.col("score")))
    return parts.select(
        "transactionid",
        F.col("score").between(0.0, 1.0).alias("is_probability"),
        (F.abs(total - log_odds) < 1e-6).alias("adds_up"),
    )


# --- cases and report ----------------------------------------------------------------


def flag_cases(spark, sf_dir):
    """Published as a refresh, then read back as the newest run."""
    path = workspace(spark, "flagged")
    tables.publish_refresh(flagged_table(spark, sf_dir), path, 1)
    return tables.latest_refresh(spark, path)


def pending_cases(spark, sf_dir):
    return C.pending_cases(flagged_table(spark, sf_dir), decision_table(spark, sf_dir))


def pending_strict(spark, sf_dir):
    """A second analyst has decided every other case the first one has."""
    first = decision_table(spark, sf_dir)
    second = first.filter("transactionid % 10 = 0").withColumn("analyst_name", F.lit("senior"))
    again = first.filter("transactionid % 10 = 5")
    decisions = first.unionByName(second).unionByName(again)
    return C.pending_cases(flagged_table(spark, sf_dir), decisions, strict=True)


def pending_count(spark, sf_dir):
    return C.pending_count(flagged_table(spark, sf_dir), decision_table(spark, sf_dir))


def pending_value(spark, sf_dir):
    return C.pending_value(
        flagged_table(spark, sf_dir),
        X.transactions(spark, sf_dir),
        decision_table(spark, sf_dir),
    )


def queue(spark, sf_dir, limit=C.QUEUE_ROWS):
    return C.case_queue(
        flagged_table(spark, sf_dir),
        X.transactions(spark, sf_dir),
        X.identities(spark, sf_dir),
        decision_table(spark, sf_dir),
        limit,
    )


def queue_filtered(spark, sf_dir):
    """All open cases with at least 10 % risk and an amount of 300."""
    return C.filter_queue(queue(spark, sf_dir, None), None, 0.1, 300.0).select(
        "transactionid", "fraud_probability", "transactionamt"
    )


def queue_search(spark, sf_dir):
    """The open case with the highest id, and a search for text that is no id."""
    open_cases = queue(spark, sf_dir, None)
    wanted = open_cases.agg(F.max("transactionid")).first()[0]
    found = C.filter_queue(open_cases, str(wanted))
    none = C.filter_queue(open_cases, "no number")
    return found.unionByName(none).select("transactionid", "fraud_probability", "productcd")


def kpi(spark, sf_dir):
    shown = C.filter_queue(queue(spark, sf_dir), None, 0.1, 300.0)
    return C.queue_kpis(
        shown,
        flagged_table(spark, sf_dir),
        X.transactions(spark, sf_dir),
        decision_table(spark, sf_dir),
    )


def case_context(spark, sf_dir):
    return C.case_context(queue(spark, sf_dir, None))


def recent_activity(spark, sf_dir):
    return C.recent_activity(X.activity_log(scored_table(spark, sf_dir))).drop("processed_at")


def activity_funnel(spark, sf_dir):
    return C.activity_funnel(X.activity_log(scored_table(spark, sf_dir)))


def activity_funnel_all(spark, sf_dir):
    return C.activity_funnel(X.activity_log(scored_table(spark, sf_dir)), None)


def decision_log(spark, sf_dir):
    """Two batches appended to the log, the second one twice; ids continue."""
    rows = decision_table(spark, sf_dir)
    cut = F.timestamp_seconds(F.lit(HALF_MONTH))
    log = workspace(spark, "decision-log")
    batches = [rows.filter(F.col("decided_at") < cut), rows.filter(F.col("decided_at") >= cut)]
    for number in (0, 1, 1):
        C.append_decisions(batches[number], log, number)
    return tables.read_target(spark, log, C.LOG).drop("decided_at", "batch")


def decision_breakdown(spark, sf_dir):
    return C.decision_breakdown(decision_table(spark, sf_dir))


def fraud_rate_trend(spark, sf_dir):
    return C.fraud_rate_trend(X.transactions(spark, sf_dir))


# --- drift and reasons ------------------------------------------------------------------


def drift_report(spark, sf_dir):
    halves = split.split_for_drift(feature_table(spark, sf_dir))
    return drift.drift_report(halves)


def drift_report_exact(spark, sf_dir):
    """p-values for samples of finite size: exact up to 10,000 values, corrected for size beyond."""
    return drift.drift_report(split.split_for_drift(feature_table(spark, sf_dir)), finite=True)


def drift_report_sized(spark, sf_dir):
    """p-values corrected for size at every size."""
    return drift.drift_report(split.split_for_drift(feature_table(spark, sf_dir)), finite=True, exact_values=0)


def drift_any(spark, sf_dir):
    """With current amounts raised by half, drift must show."""
    halves = split.split_for_drift(feature_table(spark, sf_dir))
    raised = halves.withColumn(
        "transactionamt",
        F.col("transactionamt").cast("double")
        * F.when(F.col("side") == "current", 1.5).otherwise(1.0),
    )
    return drift.any_drift(drift.drift_report(raised))


def linear(spark, sf_dir):
    scored = scored_table(spark, sf_dir)
    means = explain.feature_means(scored)
    return explain.linear_contributions(
        scored.filter(flagging.is_flagged()), X.RULE_WEIGHTS, means
    )


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def reasons_linear(spark, sf_dir):
    return _rounded(explain.reasons(linear(spark, sf_dir)), "contribution").drop("strongest")


def reasons_topk(spark, sf_dir):
    top = explain.reasons(linear(spark, sf_dir), explain.TOP_REASONS)
    return top.select("transactionid", "rank", "feature")


def reasons_display(spark, sf_dir):
    shown = explain.reasons_display(explain.reasons(linear(spark, sf_dir)))
    return _rounded(shown, "contribution", "relative_share")


def reasons_tree(spark, sf_dir):
    fitted = trained_model(spark, sf_dir)
    flagged = model.score(feature_table(spark, sf_dir), fitted).filter(flagging.is_flagged())
    return explain.reasons(explain.tree_contributions(flagged, fitted)).drop("strongest")


# --- streaming ------------------------------------------------------------------------------


def arriving_parts(spark, sf_dir, disorder) -> list[DataFrame]:
    """The whole table in three parts of rising time; with ``disorder``, some rows of the first part come with the last."""
    rows = X.transactions(spark, sf_dir).select(*live.ARRIVING.names)
    total = rows.count()
    early = split.before_row(ORDER, split.row_at(rows, ORDER, total // 3))
    middle = split.before_row(ORDER, split.row_at(rows, ORDER, 2 * total // 3))
    held = early & (F.col("transactionid") % 50 == 7) if disorder else F.lit(False)
    return [rows.filter(early & ~held), rows.filter(middle & ~early), rows.filter(~middle | held)]


def replay(spark, sf_dir, disorder=False, scorer=None) -> live.LiveTables:
    """Feed the whole table to the live job in parts. With ``disorder``, rows are also sent again with the last part, some twice."""
    parts = arriving_parts(spark, sf_dir, disorder)
    if disorder:
        parts[2] = parts[2].union(X.transactions(spark, sf_dir).select(*live.ARRIVING.names).filter("transactionid % 20 = 3"))

    store = live.LiveTables(workspace(spark, "live"))
    live.seed(spark.createDataFrame([], live.ARRIVING), store)
    source = workspace(spark, "arrivals")
    for part in parts:
        part.write.mode("append").parquet(source)
        live.start(
            live.arrivals_stream(spark, source),
            X.identities(spark, sf_dir),
            store,
            scorer,
            available_now=True,
        ).awaitTermination()
    return store


_replays: dict[tuple, live.LiveTables] = {}


def scored_replay(spark, sf_dir, disorder=False) -> live.LiveTables:
    """One replay with scoring; its tables serve several queries."""
    key = (spark.sparkContext.applicationId, sf_dir, disorder)
    if key not in _replays:
        _replays[key] = replay(spark, sf_dir, disorder, X.rule_score)
    return _replays[key]


def forget() -> None:
    """The next query of each kind computes everything anew."""
    for memo in (_written, _models, _replays):
        memo.clear()


def stream_features(spark, sf_dir):
    return scored_replay(spark, sf_dir).read(spark, "features").drop("batch_id")


def stream_activity(spark, sf_dir):
    log = scored_replay(spark, sf_dir).read(spark, "activity")
    return log.filter(F.col("processed_at").isNotNull()).select(
        "transactionid", "transactionamt", "fraud_probability", "was_flagged"
    )


def stream_flagged(spark, sf_dir):
    cases = scored_replay(spark, sf_dir).read(spark, "flagged")
    return cases.select("transactionid", "fraud_probability", "requires_second_approval")


def stream_late(spark, sf_dir):
    """Which rows came too late for the totals, and what the totals gave the others."""
    rows = scored_replay(spark, sf_dir, True).read(spark, "features")
    past = [F.when(~F.col("is_late"), F.col(c)).alias(c) for c in live.PAST[1:]]
    return rows.select("transactionid", "is_late", *past)


def stream_repaired(spark, sf_dir):
    """Features of every row under disorder, late ones computed in their micro-batch."""
    rows = scored_replay(spark, sf_dir, True).read(spark, "features")
    return rows.select("transactionid", F.round(live.PAST[0], 6).alias(live.PAST[0]), *live.PAST[1:])


def stream_once(spark, sf_dir):
    """How often the activity log names each row under disorder."""
    log = scored_replay(spark, sf_dir, True).read(spark, "activity")
    return log.groupBy("transactionid").agg(F.count("*").alias("times"))


def stream_rolling_spend(spark, sf_dir):
    """Each customer's spend of a day, every six hours, from arrivals in disorder with a watermark of 12 hours."""
    source, path = workspace(spark, "spend-arrivals"), workspace(spark, "spend")
    for part in arriving_parts(spark, sf_dir, True):
        part.write.mode("append").parquet(source)
        stream = live.arrivals_stream(spark, source)
        live_rolling.start_spend(stream, path, DAY, DAY // 4, DAY // 2).awaitTermination()
    closed = spark.read.parquet(f"{path}/windows")
    arrived = spark.read.schema(live.ARRIVING).parquet(source)
    found = live_rolling.late_in_windows(closed, arrived, DAY, DAY // 4)
    return found.select("uid", "window_end", "n", (F.col("cents") / 100).cast("decimal(20,2)").alias("spend"), "late_n")


def stream_model(spark, sf_dir):
    """The live job with the trained trees as its scorer."""
    scorer = partial(model.score, model=trained_model(spark, sf_dir))
    return replay(spark, sf_dir, scorer=scorer).read(spark, "flagged").drop(
        "batch_id", "flagged_at"
    )


REGISTRY = {
    "scan_transactions": scan_transactions,
    "scan_identities": scan_identities,
    "scan_sample": scan_sample,
    "load_if_absent": load_if_absent,
    "load_indexed": load_indexed,
    "split_identities": split_identities,
    "etl_merged": etl_merged,
    "etl_load": etl_load,
    "etl_files": etl_files,
    "etl_rejects": etl_rejects,
    "time_ordered": time_ordered,
    "customer_ordered": customer_ordered,
    "prune_columns": prune_columns,
    "quality_rejects": quality_rejects,
    "quality_valid": quality_valid,
    "quality_decisions": quality_decisions,
    "cascade_retain": cascade_retain,
    "cascade_stored": cascade_stored,
    "features": features,
    "email_prefix": email_prefix,
    "history_store": history_store,
    "features_for_ids": lookup,
    "features_for_ids_unstored": lookup_unstored,
    "features_for_new": arrivals_lookup,
    "features_for_new_unstored": arrivals_unstored,
    "model_inputs": lookup_inputs,
    "card_prior_avg": card_prior_avg,
    "card_prior_avg_ties": card_prior_avg_ties,
    "rolling_spend": rolling_spend,
    "rolling_spend_domains": rolling_spend_domains,
    "rolling_spend_ties": rolling_spend_ties,
    "offset_from_calendar": offset_from_calendar,
    "next_keys": next_keys,
    "time_rank": time_rank_all,
    "time_split": time_split,
    "time_split_ties": time_split_ties,
    "drift_split": drift_split,
    "threshold_costs": threshold_costs,
    "best_threshold": best_threshold,
    "roc_auc": roc_auc,
    "average_precision": average_precision,
    "train_gbt": train_gbt,
    "score_batch": score_batch,
    "score_response": score_response,
    "training_run": training_run,
    "training_checks": training_checks,
    "tree_leaves": tree_leaves,
    "score_checks": score_checks,
    "flag_cases": flag_cases,
    "pending_cases": pending_cases,
    "pending_strict": pending_strict,
    "pending_count": pending_count,
    "pending_value": pending_value,
    "case_queue": queue,
    "queue_filtered": queue_filtered,
    "queue_search": queue_search,
    "kpi": kpi,
    "case_context": case_context,
    "recent_activity": recent_activity,
    "activity_funnel": activity_funnel,
    "activity_funnel_all": activity_funnel_all,
    "decision_log": decision_log,
    "decision_breakdown": decision_breakdown,
    "fraud_rate_trend": fraud_rate_trend,
    "drift_report": drift_report,
    "drift_report_exact": drift_report_exact,
    "drift_report_sized": drift_report_sized,
    "drift_any": drift_any,
    "reasons_linear": reasons_linear,
    "reasons_topk": reasons_topk,
    "reasons_display": reasons_display,
    "reasons_tree": reasons_tree,
    "stream_features": stream_features,
    "stream_late": stream_late,
    "stream_repaired": stream_repaired,
    "stream_once": stream_once,
    "stream_activity": stream_activity,
    "stream_flagged": stream_flagged,
    "stream_rolling_spend": stream_rolling_spend,
    "stream_model": stream_model,
}
