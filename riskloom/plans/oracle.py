"""DuckDB SQL that says what each registered query must return."""

from __future__ import annotations

from riskloom.operators.drift import MECHANICAL, MONITORED, SERIES_TERMS
from riskloom.operators.explain import DISPLAY_NAMES
from riskloom.operators.features import INPUTS, OUTPUTS
from riskloom.schemas import (
    ARRIVAL,
    IDENTITIES,
    IDENTITY_COLUMNS,
    MODEL_FEATURES,
    TRANSACTION_COLUMNS,
    TRANSACTIONS,
)
from riskloom.sources.fixtures import RULE_INTERCEPT, RULE_WEIGHTS

_SQL_TYPES = {
    "long": "BIGINT",
    "integer": "INTEGER",
    "float": "FLOAT",
    "string": "VARCHAR",
    "decimal": "DECIMAL(10,2)",
}

_DT = "date_diff('second', TIMESTAMP '2024-01-01', ts)"

_EVENT = {
    "transactionid": "event_id",
    "isfraud": "CASE WHEN event_type = 'error' AND value >= 40 THEN 1 ELSE 0 END",
    "transactiondt": _DT,
    "transactionamt": "value * 10",
    "productcd": "['W','H','C','S','R'][event_id % 5 + 1]",
    "card1": "1000 + user_id",
    "card4": "['visa','mastercard','amex','discover'][user_id % 4 + 1]",
    "card6": "CASE WHEN user_id % 2 = 0 THEN 'debit' ELSE 'credit' END",
    "addr1": "CASE WHEN event_id % 9 <> 0 THEN 100 + (event_id % 3) * 10 END",
    "p_emaildomain": (
        "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 11 <= 5 THEN 'gmail.com' "
        "WHEN event_id % 11 <= 7 THEN 'yahoo.com' WHEN event_id % 11 <= 9 THEN 'hotmail.com' "
        "ELSE 'anonymous.com' END"
    ),
    "d1": "CASE WHEN event_id % 6 <> 0 THEN (user_id * 7 + event_id) % 640 END",
    "c1": "event_id % 4",
    "c2": "CASE WHEN event_id % 10 <> 0 THEN event_id % 3 END",
    "m1": "CASE event_id % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'F' END",
    "m2": "CASE event_id % 4 WHEN 0 THEN 'F' WHEN 1 THEN NULL ELSE 'T' END",
    "m3": "CASE WHEN event_id % 5 <> 0 THEN 'T' END",
    "m4": "CASE WHEN event_id % 7 = 0 THEN 'F' ELSE 'T' END",
}
_DEVICE = {
    "transactionid": "event_id",
    "devicetype": (
        "CASE WHEN event_id % 16 = 0 THEN NULL WHEN event_id % 8 = 4 THEN 'mobile' "
        "ELSE 'desktop' END"
    ),
}


def _projection(schema, values: dict[str, str]) -> str:
    return ", ".join(
        f"CAST({values.get(f.name, 'NULL')} AS {_SQL_TYPES[f.dataType.typeName()]}) AS {f.name}"
        for f in schema.fields
    )


TX = f"tx AS (SELECT {_projection(TRANSACTIONS, _EVENT)} FROM events)"
RAW_ID = f"raw_idn AS (SELECT {_projection(IDENTITIES, _DEVICE)} FROM events WHERE event_id % 4 = 0)"
ID = f"{RAW_ID}, idn AS (SELECT * FROM raw_idn WHERE devicetype IS NOT NULL)"
ORD = """ord AS (
  SELECT o_orderkey AS transactionid, CAST(o_custkey AS INTEGER) AS card1,
         CAST(o_totalprice AS DECIMAL(10,2)) AS transactionamt,
         date_diff('second', TIMESTAMP '1995-01-01', o_orderdate) AS transactiondt
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _keyed(source: str, name: str) -> str:
    return f"""{name} AS (
  SELECT *, COALESCE(CAST(card1 AS VARCHAR), '') || '_' ||
    COALESCE(CASE WHEN addr1 = floor(addr1) THEN CAST(CAST(addr1 AS BIGINT) AS VARCHAR)
                  ELSE CAST(addr1 AS VARCHAR) END, 'NA') AS uid
  FROM {source})"""


def _features(keyed: str, name: str) -> str:
    return f"""{name}_w AS (
  SELECT k.*, i.devicetype,
    CASE WHEN i.transactionid IS NOT NULL THEN 1 ELSE 0 END AS has_identity,
    CAST(SUM(k.transactionamt) OVER u AS DOUBLE) / NULLIF(COUNT(*) OVER u, 0)
      AS uid_avg_amt_before_this,
    COUNT(*) OVER u AS uid_txn_count_before_this,
    k.transactiondt - LAG(k.transactiondt) OVER (
      PARTITION BY k.uid ORDER BY k.transactiondt, k.transactionid) AS seconds_since_last_txn,
    COUNT(*) OVER e AS email_txn_count_before_this
  FROM {keyed} k LEFT JOIN idn i ON k.transactionid = i.transactionid
  WINDOW u AS (PARTITION BY k.uid ORDER BY k.transactiondt, k.transactionid
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         e AS (PARTITION BY k.p_emaildomain ORDER BY k.transactiondt, k.transactionid
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name} AS (
  SELECT transactionid, card1, uid, transactiondt, transactionamt, isfraud, devicetype,
    has_identity, p_emaildomain, uid_avg_amt_before_this, uid_txn_count_before_this,
    seconds_since_last_txn, email_txn_count_before_this,
    COALESCE(CAST(d1 AS DOUBLE), 0) AS account_age_days,
    COALESCE(CAST(c1 AS DOUBLE), 0) + COALESCE(CAST(c2 AS DOUBLE), 0) AS identity_linkage_score,
    CAST(m1 IS DISTINCT FROM 'T' AS INTEGER) + CAST(m2 IS DISTINCT FROM 'T' AS INTEGER)
      + CAST(m3 IS DISTINCT FROM 'T' AS INTEGER) + CAST(m4 IS DISTINCT FROM 'T' AS INTEGER)
      AS match_flag_count,
    transactiondt // 3600 % 24 AS hour_of_day,
    transactiondt // 86400 % 7 AS day_of_week,
    CASE WHEN has_identity = 0 AND seconds_since_last_txn < 300 THEN 1 ELSE 0 END
      AS no_identity_high_velocity
  FROM {name}_w)"""


FEAT = f"{TX}, {ID}, {_keyed('tx', 'keyed')}, {_features('keyed', 'feat')}"


def _input(name: str) -> str:
    return f"COALESCE(CAST({name} AS DOUBLE), CAST(-1 AS DOUBLE))"


def _double(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


_Z = _double(RULE_INTERCEPT) + "".join(
    f" + {_double(w)} * {_input(n)}" for n, w in RULE_WEIGHTS.items()
)
SCORED = f"""{FEAT}, scored AS (
  SELECT *, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-({_Z}))), 6) AS score FROM feat)"""
FLAGGED = f"""{SCORED}, flagged AS (
  SELECT transactionid, CAST(CAST(score AS DECIMAL(9,6)) AS DECIMAL(6,4)) AS fraud_probability,
         transactionamt >= 500 AS requires_second_approval
  FROM scored WHERE score >= 0.07::DOUBLE)"""
DECIDED = f"""{FLAGGED}, decided AS (
  SELECT f.transactionid, 'analyst_' || CAST(t.card1 % 7 AS VARCHAR) AS analyst_name,
         ['dismissed','confirmed_fraud','escalated'][f.transactionid % 3 + 1] AS decision,
         t.transactiondt
  FROM flagged f JOIN tx t USING (transactionid) WHERE f.transactionid % 5 = 0),
pending AS (SELECT * FROM flagged WHERE transactionid NOT IN (SELECT transactionid FROM decided))"""
QUEUE_COLUMNS = """p.transactionid, p.fraud_probability, p.requires_second_approval,
  t.transactionamt, t.transactiondt, t.productcd, t.card1, t.card4, t.card6, t.addr1, t.addr2,
  t.dist1, t.p_emaildomain, t.r_emaildomain, i.devicetype, i.deviceinfo"""
QUEUE = f"""{DECIDED}, open_cases AS (
  SELECT {QUEUE_COLUMNS} FROM pending p JOIN tx t USING (transactionid)
  LEFT JOIN idn i USING (transactionid)),
queue AS (SELECT * FROM open_cases ORDER BY fraud_probability DESC, transactionid LIMIT 100)"""


def _position(source: str, name: str) -> str:
    return f"""{name} AS (
  SELECT *, row_number() OVER (ORDER BY transactiondt, transactionid) - 1 AS position,
         count(*) OVER () AS n FROM {source})"""


def _split(source: str, fraction: str, first: str, second: str) -> str:
    return f"""{_position(source, 'placed')}, sided AS (
  SELECT *, CASE WHEN position < CAST(floor(n * {fraction}) AS BIGINT)
                 THEN '{first}' ELSE '{second}' END AS side FROM placed)"""


_SUMMARY = """SELECT side, count(*) AS n_rows, min(transactiondt) AS min_dt,
  max(transactiondt) AS max_dt FROM sided GROUP BY side"""
TEST = f"{SCORED}, {_split('scored', '0.8::DOUBLE', 'train', 'test')}"
DRIFT = f"{FEAT}, {_split('feat', '(1 - 0.1::DOUBLE)', 'reference', 'current')}"

COSTS = f"""{TEST}, spine AS (SELECT i, i / 100.0::DOUBLE AS threshold FROM range(1, 100) r(i)),
costs AS (
  SELECT threshold,
    CAST(COALESCE(SUM(CASE WHEN isfraud = 1 AND NOT score >= threshold THEN transactionamt END), 0)
         AS DECIMAL(30,2)) AS missed_fraud_cost,
    CAST(COUNT(CASE WHEN isfraud = 0 AND score >= threshold THEN 1 END) AS BIGINT) AS false_alarms
  FROM spine CROSS JOIN (SELECT * FROM sided WHERE side = 'test') GROUP BY threshold),
total AS (
  SELECT *, CAST(missed_fraud_cost + false_alarms * 10 AS DECIMAL(30,2)) AS total_cost FROM costs)"""

BY_SCORE = f"""{SCORED}, by_score AS (
  SELECT score, SUM(isfraud) AS pos, SUM(1 - isfraud) AS neg FROM scored GROUP BY score)"""


def _ks(current_factor: float) -> str:
    entries = " UNION ALL ".join(
        f"SELECT side, '{c}' AS feature, CAST({c} AS DOUBLE)"
        + (
            f" * CASE WHEN side = 'current' THEN {_double(current_factor)} ELSE 1.0::DOUBLE END"
            if c == "transactionamt" and current_factor != 1.0
            else ""
        )
        + " AS value FROM sided"
        for c in MONITORED
    )
    mechanical = ", ".join(f"'{c}'" for c in MECHANICAL)
    return f"""{DRIFT}, long AS ({entries}),
counts AS (
  SELECT feature, value, COUNT(CASE WHEN side = 'reference' THEN 1 END) AS ref,
         COUNT(CASE WHEN side = 'current' THEN 1 END) AS cur
  FROM long WHERE value IS NOT NULL GROUP BY feature, value),
running AS (
  SELECT feature, SUM(ref) OVER w AS cr, SUM(cur) OVER w AS cc,
         SUM(ref) OVER (PARTITION BY feature) AS n, SUM(cur) OVER (PARTITION BY feature) AS m
  FROM counts WINDOW w AS (PARTITION BY feature ORDER BY value
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
stat AS (
  SELECT feature, max(abs(cr::DOUBLE / n - cc::DOUBLE / m)) AS d, max(n)::DOUBLE AS n, max(m)::DOUBLE AS m
  FROM running WHERE n >= 10 AND m >= 10 GROUP BY feature),
lam AS (SELECT feature, d, sqrt(n * m / (n + m)) * d AS lam FROM stat),
prob AS (
  SELECT feature, d, CASE WHEN lam < 0.2 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    list_sum([CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END
      * exp(-2.0::DOUBLE * k * k * lam * lam) for k in range(1, {SERIES_TERMS + 1})]))) END AS p
  FROM lam),
report AS (
  SELECT feature, round(d, 4) AS ks_statistic, round(p, 6) AS p_value, p < 0.05 AS drift_detected,
         feature IN ({mechanical}) AS mechanical FROM prob)"""


def _reasons(which: str) -> str:
    means = ", ".join(f"avg({_input(c)}) AS m_{c}" for c in MODEL_FEATURES)
    entries = " UNION ALL ".join(
        f"SELECT transactionid, '{c}' AS feature, CAST({c} AS DOUBLE) AS value, "
        f"{_double(RULE_WEIGHTS[c])} * ({_input(c)} - m_{c}) AS contribution FROM cases_m"
        for c in MODEL_FEATURES
    )
    return f"""{SCORED}, means AS (SELECT {means} FROM scored),
cases_m AS (SELECT * FROM scored CROSS JOIN means WHERE {which}),
long AS ({entries}),
reasons AS (
  SELECT transactionid,
    CAST(row_number() OVER (PARTITION BY transactionid ORDER BY abs(contribution) DESC, feature)
         AS INTEGER) AS rank,
    feature, value, contribution,
    max(abs(contribution)) OVER (PARTITION BY transactionid) AS strongest
  FROM long)"""


REASONS = _reasons("score >= 0.07::DOUBLE")
ALL_REASONS = _reasons("true")
_NAMES = ", ".join(f"('{k}', '{v}')" for k, v in DISPLAY_NAMES.items())

RAW_FEED = """raw AS (
  SELECT event_id,
    CASE WHEN event_id % 101 <> 0 THEN CAST(event_id AS VARCHAR) END AS transactionid,
    CASE WHEN event_id % 89 = 0 THEN '2' WHEN event_id % 97 = 0 THEN NULL
         WHEN event_type = 'error' THEN '1' ELSE '0' END AS isfraud,
    CASE WHEN event_id % 83 = 0 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS transactiondt,
    CASE WHEN event_id % 79 = 0 THEN '123456789012.00'
         ELSE CAST(CAST(value * 10 AS DECIMAL(10,2)) AS VARCHAR) END AS transactionamt,
    CASE WHEN event_id % 73 = 0 THEN 'WHOLESALE-LONG' ELSE 'W' END AS productcd,
    CASE WHEN event_id % 71 = 0 THEN repeat('x', 101) ELSE 'gmail.com' END AS p_emaildomain
  FROM events),
feed AS (
  SELECT *, event_id * 2 AS ingest_order FROM raw
  UNION ALL SELECT *, event_id * 2 + 1 FROM raw WHERE event_id % 67 = 0),
checked AS (
  SELECT *, concat_ws(',',
    CASE WHEN transactionid IS NULL THEN 'transactionid_missing' END,
    CASE WHEN isfraud IS NULL THEN 'isfraud_missing' END,
    CASE WHEN isfraud NOT IN ('0', '1') THEN 'isfraud_not_allowed' END,
    CASE WHEN TRY_CAST(transactiondt AS BIGINT) IS NULL THEN 'transactiondt_bad_value' END,
    CASE WHEN TRY_CAST(transactionamt AS DECIMAL(10,2)) IS NULL
         THEN 'transactionamt_bad_value' END,
    CASE WHEN length(productcd) > 10 THEN 'productcd_too_long' END,
    CASE WHEN length(p_emaildomain) > 100 THEN 'p_emaildomain_too_long' END,
    CASE WHEN transactionid IS NOT NULL
          AND ingest_order > min(ingest_order) OVER (PARTITION BY transactionid)
         THEN 'key_duplicate' END) AS reasons
  FROM feed)"""

# --- the live replay: three parts; some rows of the first come with the last ---
ARRIVED = f"""{TX}, {ID}, {_position('tx', 'placed')}, parted AS (
  SELECT *, CASE WHEN position < n // 3 THEN 0 WHEN position < 2 * n // 3 THEN 1 ELSE 2 END AS part
  FROM placed),
arriving AS (
  SELECT *, part = 0 AND transactionid % 50 = 7 AS held FROM parted),
arrival AS (SELECT *, CASE WHEN held THEN 2 ELSE part END AS arrives FROM arriving),
{_keyed('arrival', 'all_rows')},
in_time AS (SELECT * FROM all_rows WHERE NOT held),
{_features('in_time', 'feat_early')},
{_features('all_rows', 'feat_all')},
seen_uid AS (SELECT uid, max(transactionid) AS last_id FROM all_rows WHERE arrives < 2 GROUP BY uid),
seen_email AS (
  SELECT p_emaildomain, max(transactionid) AS last_id FROM all_rows WHERE arrives < 2
  GROUP BY p_emaildomain),
late AS (
  SELECT a.transactionid, a.arrives,
    a.arrives = 2 AND (COALESCE(u.last_id > a.transactionid, false)
                  OR COALESCE(e.last_id > a.transactionid, false)) AS is_late
  FROM all_rows a LEFT JOIN seen_uid u USING (uid)
  LEFT JOIN seen_email e ON a.p_emaildomain IS NOT DISTINCT FROM e.p_emaildomain)"""

_PAST = [
    "uid_txn_count_before_this", "seconds_since_last_txn", "email_txn_count_before_this",
    "no_identity_high_velocity",
]
_PAST_IF = ", ".join(
    f"CASE WHEN l.is_late THEN NULL WHEN l.arrives = 2 THEN a.{c} ELSE b.{c} END AS {c}" for c in _PAST
)

_PAST_KNOWN = ", ".join(
    f"CASE WHEN l.arrives = 2 THEN a.{c} ELSE b.{c} END AS {c}" for c in _PAST
)


def _card_average(source: str) -> str:
    return f"""SELECT transactionid, card1, transactiondt, transactionamt,
    CAST(SUM(transactionamt) OVER w AS DOUBLE) / NULLIF(COUNT(*) OVER w, 0)
      AS card_avg_amt_before_this
  FROM {source}
  WINDOW w AS (PARTITION BY card1 ORDER BY transactiondt, transactionid
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


_OUT = ", ".join(OUTPUTS)
_UNKNOWN = ", ".join(
    f"CASE WHEN transactiondt < {15 * 86400} THEN {c} END AS {c}"
    for c in INPUTS
    if c not in ARRIVAL.names
)

def _rolling(source: str, key: str, days: int) -> str:
    return f"""SELECT transactionid, COUNT(*) OVER w AS rolling_n,
        CAST(SUM(transactionamt) OVER w AS DECIMAL(20,2)) AS rolling_spend
      FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY transactiondt
        RANGE BETWEEN {days * 86400} PRECEDING AND CURRENT ROW)"""


ORACLE = {
    "scan_transactions": f"WITH {TX} SELECT * FROM tx",
    "scan_identities": f"WITH {RAW_ID} SELECT * FROM raw_idn",
    "scan_sample": f"""WITH {TX}, {ID},
      s AS (SELECT * FROM tx ORDER BY transactionid LIMIT 5000)
      SELECT s.transactionid, s.transactiondt, s.transactionamt, i.devicetype
      FROM s LEFT JOIN idn i USING (transactionid)""",
    "load_if_absent": f"""WITH {TX} SELECT transactionid, transactiondt, transactionamt, card1,
      'W' AS productcd FROM tx WHERE transactiondt >= {15 * 86400}""",
    "split_identities": f"WITH {ID} SELECT * FROM idn",
    "etl_merged": f"""WITH {TX}, {RAW_ID}
      SELECT {', '.join('t.' + c for c in TRANSACTION_COLUMNS)},
             {', '.join('i.' + c for c in IDENTITY_COLUMNS[1:])}
      FROM tx t LEFT JOIN raw_idn i USING (transactionid)""",
    "etl_load": f"""WITH {TX}, {RAW_ID}
      SELECT t.transactionid, t.transactiondt, t.transactionamt, t.card1, t.p_emaildomain,
        i.devicetype FROM tx t LEFT JOIN raw_idn i USING (transactionid)
      WHERE t.transactiondt >= {15 * 86400}""",
    "etl_files": f"""WITH {TX}, {RAW_ID}
      SELECT t.transactionid, t.transactiondt,
        CASE WHEN t.transactionid % 100 <> 3 THEN t.transactionamt END AS transactionamt,
        CASE WHEN t.transactionid % 100 <> 3 THEN 'loaded' ELSE 'transactionamt_bad_value' END AS outcome,
        CASE WHEN t.transactionid % 100 <> 3 THEN i.devicetype END AS devicetype
      FROM tx t LEFT JOIN raw_idn i USING (transactionid)""",
    "load_indexed": f"""WITH {TX} SELECT transactionid, transactiondt, transactionamt, card1,
      CASE WHEN transactiondt < 1296000 THEN 'H' ELSE 'W' END AS productcd FROM tx""",
    "cascade_stored": f"""WITH {DECIDED},
      good AS (SELECT transactionid FROM tx WHERE isfraud = 0)
      SELECT 'transactions' AS kept_in, transactionid FROM good
      UNION ALL SELECT 'identities', transactionid FROM idn JOIN good USING (transactionid)
      UNION ALL SELECT 'flagged', transactionid FROM flagged JOIN good USING (transactionid)
      UNION ALL SELECT 'decisions', transactionid FROM decided JOIN good USING (transactionid)""",
    "etl_rejects": f"""WITH {TX}, {RAW_ID}
      SELECT 'transactions' AS rejected_from, run, transactionid, 'transactionamt_bad_value' AS reasons
      FROM tx, range(1, 3) runs(run) WHERE transactionid % 100 = 3
      UNION ALL SELECT 'identities', 0, i.transactionid, 'parent_missing'
      FROM raw_idn i JOIN tx t USING (transactionid) WHERE t.transactiondt >= 1296000""",
    "customer_ordered": f"""WITH {TX}, {_keyed('tx', 'keyed')}
      SELECT row_number() OVER (ORDER BY uid, transactiondt, transactionid) - 1 AS position,
        uid, transactiondt, transactionid FROM keyed""",
    "time_ordered": f"""WITH {TX} SELECT transactionid, transactiondt, transactionamt,
      transactiondt // 86400 AS day FROM tx""",
    "training_checks": f"""WITH {TX}, {_split('tx', '0.8::DOUBLE', 'train', 'test')},
      by_amount AS (SELECT transactionamt AS score, SUM(isfraud) AS pos, SUM(1 - isfraud) AS neg
        FROM sided WHERE side = 'test' GROUP BY transactionamt),
      below AS (SELECT pos, neg, COALESCE(SUM(neg) OVER (ORDER BY score
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower FROM by_amount),
      sizes AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT) AS n_train FROM tx)
      SELECT CAST(200 AS INTEGER) AS trees, n_train AS train_rows, n - n_train AS test_rows,
        true AS metrics_in_range, true AS importances_add_up,
        (SELECT round(CAST(SUM(pos * (2 * lower + neg)) AS DOUBLE)
          / (2.0::DOUBLE * SUM(pos) * SUM(neg)), 9) FROM below) AS amount_auc,
        true AS ranks_like_amount FROM sizes""",
    "tree_leaves": f"""WITH {TX}, leaves AS (
      SELECT CAST(transactionamt >= 400 AS INTEGER) AS large, count(*) AS n,
        round(1.0::DOUBLE / (1.0::DOUBLE + exp(-2.0::DOUBLE * (2.0::DOUBLE * avg(isfraud) - 1.0::DOUBLE))), 9) AS p
      FROM tx GROUP BY 1)
      SELECT large, p AS low, p AS high, n FROM leaves""",
    "score_checks": f"WITH {TX} SELECT transactionid, true AS is_probability, true AS adds_up FROM tx",
    "prune_columns": f"""SELECT event_id AS transactionid, {_DT} AS transactiondt,
      CAST(value AS FLOAT) AS dist1, CASE WHEN event_id % 3 = 0 THEN 'T' END AS m4,
      CAST(1000 + user_id AS INTEGER) AS card1, 'gmail.com' AS p_emaildomain FROM events""",
    "quality_rejects": f"""WITH {RAW_FEED}
      SELECT ingest_order, reasons FROM checked WHERE reasons <> ''""",
    "quality_valid": f"""WITH {RAW_FEED}
      SELECT CAST(transactionid AS BIGINT) AS transactionid, CAST(isfraud AS INTEGER) AS isfraud,
        CAST(transactiondt AS BIGINT) AS transactiondt,
        CAST(transactionamt AS DECIMAL(10,2)) AS transactionamt, productcd, p_emaildomain
      FROM checked WHERE reasons = ''""",
    "quality_decisions": f"""WITH {FLAGGED}, raw AS (
      SELECT event_id, CASE WHEN event_id % 31 <> 0 THEN 'a' END AS analyst_name,
        CASE event_id % 4 WHEN 0 THEN 'dismissed' WHEN 1 THEN 'confirmed_fraud'
          WHEN 2 THEN 'escalated' ELSE 'approve' END AS decision FROM events),
      checked AS (SELECT event_id AS ingest_order, concat_ws(',',
        CASE WHEN analyst_name IS NULL THEN 'analyst_name_missing' END,
        CASE WHEN decision = 'approve' THEN 'decision_not_allowed' END,
        CASE WHEN event_id NOT IN (SELECT transactionid FROM flagged) THEN 'parent_missing' END)
        AS reasons FROM raw)
      SELECT * FROM checked WHERE reasons <> ''""",
    "cascade_retain": f"""WITH {TX}, {ID} SELECT transactionid, devicetype FROM idn
      WHERE transactionid IN (SELECT transactionid FROM tx WHERE isfraud = 0)""",
    "features": f"WITH {FEAT} SELECT {_OUT} FROM feat",
    "email_prefix": f"""WITH {FEAT}
      SELECT transactionid, p_emaildomain, email_txn_count_before_this FROM feat""",
    "features_for_ids": f"""WITH {FEAT} SELECT {_OUT} FROM feat
      WHERE transactionid IN (SELECT max(transactionid) FROM tx GROUP BY card1)""",
    "features_for_new": f"""WITH {TX}, {ID}, known AS (SELECT * REPLACE ({_UNKNOWN}) FROM tx),
      {_keyed('known', 'keyed')}, {_features('keyed', 'feat')}
      SELECT {_OUT} FROM feat WHERE transactiondt >= {15 * 86400}""",
    "model_inputs": f"""WITH {FEAT} SELECT transactionid,
      {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in MODEL_FEATURES)} FROM feat
      WHERE transactionid IN (SELECT max(transactionid) FROM tx GROUP BY card1)""",
    "card_prior_avg": f"""WITH {TX} {_card_average('tx')}
      ORDER BY card1, transactiondt, transactionid LIMIT 20""",
    "card_prior_avg_ties": f"WITH {ORD} {_card_average('ord')}",
    "history_store": f"""WITH {TX}, {_keyed('tx', 'keyed')},
      both_kinds AS (SELECT 'uid' AS kind, '=' || uid AS key, transactiondt // 2592000 AS slice,
          transactionamt, transactiondt FROM keyed
        UNION ALL SELECT 'p_emaildomain', COALESCE('=' || p_emaildomain, ''), transactiondt // 3600,
          transactionamt, transactiondt FROM keyed)
      SELECT kind, key, slice, count(*) AS n, CAST(SUM(transactionamt) * 100 AS BIGINT) AS cents,
        max(transactiondt) AS last_dt FROM both_kinds GROUP BY kind, key, slice""",
    "rolling_spend": f"""WITH {TX}, {_keyed('tx', 'keyed')} {_rolling('keyed', 'uid', 7)}""",
    "rolling_spend_domains": f"WITH {TX} {_rolling('tx', 'p_emaildomain', 1)}",
    "rolling_spend_ties": f"WITH {ORD} {_rolling('ord', 'card1', 90)}",
    "offset_from_calendar": """SELECT event_id,
      date_diff('second', TIMESTAMP '2019-01-01', ts) AS offset_s FROM events""",
    "next_keys": f"""WITH {TX} SELECT COALESCE(max(transactionid), 3000000) + 1 AS next_id,
      max(transactiondt) AS max_dt FROM tx""",
    "time_rank": f"""WITH {ORD}, {_position('ord', 'placed')}
      SELECT transactionid, transactiondt, position FROM placed""",
    "time_split": f"WITH {TX}, {_split('tx', '0.8::DOUBLE', 'train', 'test')} {_SUMMARY}",
    "time_split_ties": f"""WITH {ORD}, {_split('ord', '0.8::DOUBLE', 'train', 'test')}
      SELECT transactionid, side FROM sided""",
    "drift_split": f"""WITH {TX},
      {_split('tx', '(1 - 0.1::DOUBLE)', 'reference', 'current')} {_SUMMARY}""",
    "threshold_costs": f"WITH {COSTS} SELECT * FROM total",
    "best_threshold": f"""WITH {COSTS} SELECT threshold, total_cost FROM total
      ORDER BY total_cost, threshold LIMIT 1""",
    "roc_auc": f"""WITH {BY_SCORE}, below AS (
      SELECT pos, neg, COALESCE(SUM(neg) OVER (ORDER BY score
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower FROM by_score)
      SELECT CAST(SUM(pos * (2 * lower + neg)) AS DOUBLE)
        / (2.0::DOUBLE * SUM(pos) * SUM(neg)) AS roc_auc FROM below""",
    "average_precision": f"""WITH {BY_SCORE}, above AS (
      SELECT pos, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp FROM by_score
      WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      SELECT round(SUM(pos * (tp::DOUBLE / (tp + fp))) / SUM(pos), 9) AS average_precision
      FROM above""",
    "score_response": f"""WITH {ALL_REASONS} SELECT r.transactionid,
      CAST(CAST(CAST(s.score AS DECIMAL(9,6)) AS DECIMAL(6,4)) AS DOUBLE) AS fraud_probability,
      s.score >= 0.07::DOUBLE AS flagged,
      CASE WHEN s.score >= 0.07::DOUBLE THEN 'FLAGGED FOR REVIEW' ELSE 'APPEARS LEGITIMATE' END
        AS verdict,
      0.07::DOUBLE AS threshold_used, r.rank, r.feature, round(r.contribution, 4) AS contribution
      FROM reasons r JOIN scored s USING (transactionid)""",
    "flag_cases": f"WITH {FLAGGED} SELECT * FROM flagged",
    "pending_cases": f"WITH {DECIDED} SELECT * FROM pending",
    "pending_strict": f"""WITH {DECIDED} SELECT * FROM flagged
      WHERE transactionid NOT IN (SELECT transactionid FROM decided)
         OR (requires_second_approval AND transactionid % 10 <> 0)""",
    "pending_count": f"WITH {DECIDED} SELECT count(*) AS pending_count FROM pending",
    "pending_value": f"""WITH {DECIDED} SELECT CAST(COALESCE(SUM(transactionamt), 0)
      AS DECIMAL(30,2)) AS total_pending_value FROM pending JOIN tx USING (transactionid)""",
    "case_queue": f"WITH {QUEUE} SELECT * FROM queue",
    "queue_filtered": f"""WITH {QUEUE} SELECT transactionid, fraud_probability, transactionamt
      FROM open_cases WHERE fraud_probability >= 0.1 AND transactionamt >= 300""",
    "queue_search": f"""WITH {QUEUE} SELECT transactionid, fraud_probability, productcd
      FROM open_cases WHERE transactionid = (SELECT max(transactionid) FROM open_cases)""",
    "kpi": f"""WITH {QUEUE},
      shown AS (SELECT * FROM queue WHERE fraud_probability >= 0.1 AND transactionamt >= 300),
      figures AS (SELECT
        (SELECT count(*) FROM shown) AS cases_in_queue,
        (SELECT CAST(COALESCE(SUM(transactionamt), 0) AS DECIMAL(30,2)) FROM shown)
          AS value_at_risk,
        (SELECT COALESCE(CAST(SUM(fraud_probability) AS DOUBLE) / NULLIF(count(*), 0), 0)
         FROM shown) AS avg_risk,
        (SELECT count(*) FROM pending) AS pending_count,
        (SELECT CAST(COALESCE(SUM(transactionamt), 0) AS DECIMAL(30,2)) FROM open_cases)
          AS pending_value)
      SELECT *, avg_risk > 0.5 AS risk_alert, pending_count > 1000 AS pending_alert
      FROM figures""",
    "case_context": f"""WITH {QUEUE} SELECT transactionid, fraud_probability, transactionamt,
      'Day ' || CAST(transactiondt // 86400 AS VARCHAR) || ', '
        || lpad(CAST(transactiondt % 86400 // 3600 AS VARCHAR), 2, '0') || ':'
        || lpad(CAST(transactiondt % 3600 // 60 AS VARCHAR), 2, '0') AS transaction_time,
      CASE WHEN requires_second_approval THEN 'SECOND APPROVAL REQUIRED' ELSE '' END
        AS approval_tag FROM open_cases""",
    "recent_activity": f"""WITH {SCORED} SELECT transactionid, transactionamt,
      CAST(CAST(score AS DECIMAL(9,6)) AS DECIMAL(6,4)) AS fraud_probability,
      score >= 0.07::DOUBLE AS was_flagged,
      CASE WHEN score >= 0.07::DOUBLE THEN 'Flagged for review' ELSE 'Cleared' END AS status
      FROM scored ORDER BY transactiondt DESC, transactionid DESC LIMIT 15""",
    "activity_funnel": f"""WITH {SCORED}, latest AS (
      SELECT score >= 0.07::DOUBLE AS f FROM scored
      ORDER BY transactiondt DESC, transactionid DESC LIMIT 15)
      SELECT count(*) AS seen, count(CASE WHEN f THEN 1 END) AS flagged,
        count(CASE WHEN NOT f THEN 1 END) AS cleared FROM latest""",
    "activity_funnel_all": f"""WITH {SCORED}
      SELECT count(*) AS seen, count(CASE WHEN score >= 0.07::DOUBLE THEN 1 END) AS flagged,
        count(CASE WHEN score < 0.07::DOUBLE THEN 1 END) AS cleared FROM scored""",
    "decision_log": f"""WITH {DECIDED} SELECT
      row_number() OVER (ORDER BY transactiondt, transactionid) AS id, transactionid,
      analyst_name, decision FROM decided""",
    "decision_breakdown": f"""WITH {DECIDED} SELECT decision, count(*) AS n_decisions,
      count(DISTINCT transactionid) AS n_cases FROM decided GROUP BY decision""",
    "fraud_rate_trend": f"""WITH {TX} SELECT transactiondt // 86400 AS day,
      count(*) AS n_transactions, CAST(SUM(isfraud) AS BIGINT) AS n_fraud,
      CAST(SUM(isfraud) AS DOUBLE) / count(*) AS fraud_rate FROM tx GROUP BY 1""",
    "drift_report": f"WITH {_ks(1.0)} SELECT * FROM report",
    "drift_report_sized": f"""WITH {_ks(1.0)}, sized AS (
        SELECT feature, d, round_even(n * m / (n + m), 0) AS size FROM stat),
      scaled AS (SELECT *, sqrt(size) * d AS z, sqrt(pi() / 2) AS root FROM sized),
      terms AS (SELECT *,
        [pow(k + 0.5::DOUBLE, 2) * pow(pi(), 2) for k in range(0, 40)] AS halves,
        [pow(k, 2) * pow(pi(), 2) for k in range(1, 40)] AS wholes FROM scaled),
      below AS (SELECT feature, d, z,
        2 * root / z * list_sum([exp(-h / (2 * z * z)) for h in halves])
        + 2 * root / (6 * pow(z, 4)) * list_sum([(h - z * z) * exp(-h / (2 * z * z)) for h in halves]) / sqrt(size)
        + (2 * root / (72 * pow(z, 7)) * list_sum([((6 * pow(z, 6) + 2 * pow(z, 4))
            + (2 * pow(z, 4) - 5 * z * z) * h + (1 - 2 * z * z) * h * h) * exp(-h / (2 * z * z)) for h in halves])
          - 2 * root / (36 * pow(z, 3)) * list_sum([w * exp(-w / (2 * z * z)) for w in wholes])) / size AS share
        FROM terms),
      judged AS (SELECT feature, d, CASE WHEN z < 0.18 THEN 1.0::DOUBLE
        WHEN z > 4 THEN 2.0::DOUBLE * exp(-2 * z * z) ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - share)) END AS p FROM below)
      SELECT feature, round(d, 4) AS ks_statistic, round(p, 6) AS p_value, p < 0.05 AS drift_detected,
        mechanical FROM judged JOIN (SELECT feature, mechanical FROM report) USING (feature)""",
    "drift_any": f"""WITH {_ks(1.5)} SELECT bool_or(drift_detected) AS any_drift,
      count(CASE WHEN drift_detected THEN 1 END) AS n_drifted FROM report""",
    "reasons_linear": f"""WITH {REASONS} SELECT transactionid, rank, feature, value,
      round(contribution, 6) AS contribution FROM reasons""",
    "reasons_topk": f"""WITH {REASONS} SELECT transactionid, rank, feature FROM reasons
      WHERE rank <= 5""",
    "reasons_display": f"""WITH {REASONS}, names(feature, display_name) AS (VALUES {_NAMES})
      SELECT transactionid, rank, COALESCE(display_name, feature) AS display_name, value,
        round(contribution, 6) AS contribution,
        round(COALESCE(abs(contribution) / NULLIF(strongest, 0), 0), 6) AS relative_share,
        CASE WHEN contribution > 0 THEN 'toward FRAUD' ELSE 'toward normal' END AS direction,
        CASE WHEN contribution > 0 THEN 'increases risk' ELSE 'decreases risk' END AS effect
      FROM reasons LEFT JOIN names USING (feature)""",
    "stream_features": f"WITH {FEAT} SELECT {_OUT}, false AS is_late FROM feat",
    "stream_late": f"""WITH {ARRIVED} SELECT l.transactionid, l.is_late, {_PAST_IF}
      FROM late l JOIN feat_all a USING (transactionid)
      LEFT JOIN feat_early b USING (transactionid)""",
    "stream_repaired": f"""WITH {ARRIVED} SELECT l.transactionid,
      round(CASE WHEN l.arrives = 2 THEN a.uid_avg_amt_before_this
        ELSE b.uid_avg_amt_before_this END, 6) AS uid_avg_amt_before_this, {_PAST_KNOWN}
      FROM late l JOIN feat_all a USING (transactionid)
      LEFT JOIN feat_early b USING (transactionid)""",
    "stream_rolling_spend": f"""WITH {ARRIVED},
      windows AS (SELECT uid, transactionamt, held, (transactiondt // 21600 + k) * 21600 AS window_end
        FROM all_rows, range(1, 5) steps(k)),
      marks AS (SELECT max(transactiondt) - 43200 AS at_end,
        max(CASE WHEN arrives < 2 THEN transactiondt END) - 43200 AS before_last FROM all_rows),
      judged AS (SELECT *, held AND window_end <= before_last AS late FROM windows, marks)
      SELECT uid, window_end, count(CASE WHEN NOT late THEN 1 END) AS n,
        CAST(SUM(CASE WHEN late THEN 0 ELSE transactionamt END) AS DECIMAL(20,2)) AS spend,
        count(CASE WHEN late THEN 1 END) AS late_n
      FROM judged WHERE window_end <= at_end GROUP BY uid, window_end""",
    "stream_once": f"WITH {TX} SELECT transactionid, 1::BIGINT AS times FROM tx",
    "stream_activity": f"""WITH {SCORED} SELECT transactionid, transactionamt,
      CAST(CAST(score AS DECIMAL(9,6)) AS DECIMAL(6,4)) AS fraud_probability,
      score >= 0.07::DOUBLE AS was_flagged FROM scored""",
    "stream_flagged": f"WITH {FLAGGED} SELECT * FROM flagged",
}
ORACLE |= {
    f"{name}_unstored": ORACLE[name] for name in ("features_for_ids", "features_for_new")
}
