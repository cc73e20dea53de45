"""Registry of the engine's own queries and, where SQL can say it, their DuckDB definitions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strictpast.functions import expressions as X
from strictpast.functions.quantiles import quantiles
from strictpast.operators import currency, drift, encoding, history, learners, metrics, periods, sampling, validate
from strictpast.plans import oracles as O
from strictpast.plans.adapters import RATES, event_ledger, order_ledger
from strictpast.plans.storage import materialised
from strictpast.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ORDER_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]
ORDER_WINDOWS = {"7d": 7 * 86400, "30d": 30 * 86400}
#: 1995-06-01, and within the events' month.
ORDER_CUT = 801_964_800
#: 1995-01-03: the first day of the orders is the past of all that follow.
EARLY_CUT = 789_091_200
DRIFT_FEATURES = ["paid", "l_quantity", "l_discount", "score", "label"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def order_sql(body: str) -> str:
    return O.with_ledger("order", body)


def event_sql(body: str) -> str:
    return O.with_ledger("event", body)


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


def as_contract(df: DataFrame) -> DataFrame:
    """The order ledger under the contract's names, amounts in whole units of money."""
    return df.withColumns({"amount_paid": F.col("paid") / 100.0, "amount_received": F.col("received") / 100.0})


# scan and validate


@query("ledger_projection", order_sql("SELECT l_orderkey, l_linenumber, l_partkey, ts, from_bank, from_account, to_bank, to_account, paid, received, payment_currency, receiving_currency, payment_format, label FROM led"))
def _(spark, sf):
    return order_ledger(spark, sf).select(*ORDER_KEYS, "ts", *history.PAIR, "paid", "received", "payment_currency", "receiving_currency", "payment_format", "label")


@query(
    "ledger_quality_report",
    order_sql("""SELECT count(*) AS rows, count(*) FILTER (WHERE paid = 0 OR received = 0) AS zero_amount_rows, count(*) FILTER (WHERE from_bank = to_bank AND from_account = to_account) AS self_transfers,
count(*) FILTER (WHERE label = 0) AS negatives, count(*) FILTER (WHERE label = 1) AS positives, round(avg(label::DOUBLE), 9) AS positive_rate, min(ts) AS min_ts, max(ts) AS max_ts FROM led"""),
)
def _(spark, sf):
    return rounded(validate.quality_report(as_contract(order_ledger(spark, sf))), 9)


@query("daily_rows_positives", order_sql("SELECT CAST(ts AS DATE) AS day, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives FROM led GROUP BY 1"))
def _(spark, sf):
    return validate.daily_counts(order_ledger(spark, sf))


@query("category_counts", order_sql("SELECT payment_format AS value, count(*) AS n FROM led GROUP BY 1"))
def _(spark, sf):
    return validate.category_counts(order_ledger(spark, sf), "payment_format")


@query("currency_counts_pooled", order_sql("SELECT value, count(*) AS n FROM (SELECT payment_currency AS value FROM led UNION ALL SELECT receiving_currency FROM led) GROUP BY 1"))
def _(spark, sf):
    return validate.pooled_counts(order_ledger(spark, sf), ["payment_currency", "receiving_currency"])


_DUPLICATE = ["from_account", "to_account", "ts", "payment_format"]


@query("duplicate_rows", order_sql(f"SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM led GROUP BY {', '.join(_DUPLICATE)})"))
def _(spark, sf):
    return validate.duplicate_rows(order_ledger(spark, sf), _DUPLICATE)


_GATED = ("from_account", "payment_format", "amount_paid", "label")


@query(
    "gate_violations",
    order_sql("""SELECT count(*) AS rows, count(*) FILTER (WHERE f IS NULL) AS null_from_account, count(*) FILTER (WHERE p IS NULL) AS null_payment_format, count(*) FILTER (WHERE a IS NULL) AS null_amount_paid,
count(*) FILTER (WHERE y IS NULL) AS null_label, count(*) FILTER (WHERE f = '') AS empty_from_account, count(*) FILTER (WHERE p = '') AS empty_payment_format, count(*) FILTER (WHERE a < 0) AS bad_amount_paid,
count(*) FILTER (WHERE y NOT IN (0, 1)) AS bad_label, count(*) FILTER (WHERE p NOT IN ('ACH', 'Bitcoin', 'Cash', 'Cheque', 'Credit Card', 'Reinvestment', 'Wire')) AS bad_payment_format
FROM (SELECT CASE WHEN l_partkey % 11 = 0 THEN '' WHEN l_partkey % 13 = 0 THEN NULL ELSE from_account END AS f, CASE WHEN l_partkey % 17 = 0 THEN 'Telegraph' ELSE payment_format END AS p,
CASE WHEN l_partkey % 19 = 0 THEN -1 ELSE paid / 100.0::DOUBLE END AS a, CASE WHEN l_partkey % 23 = 0 THEN 2 ELSE label END AS y FROM led)"""),
)
def _(spark, sf):
    k = F.col("l_partkey")
    broken = as_contract(order_ledger(spark, sf)).select(
        F.when(k % 11 == 0, "").when(k % 13 == 0, None).otherwise(F.col("from_account")).alias("from_account"),
        F.when(k % 17 == 0, "Telegraph").otherwise(F.col("payment_format")).alias("payment_format"),
        F.when(k % 19 == 0, -1.0).otherwise(F.col("amount_paid")).alias("amount_paid"),
        F.when(k % 23 == 0, 2).otherwise(F.col("label")).alias("label"),
    )
    return validate.gate_violations(broken, _GATED)


@query("sender_sample_complete", order_sql("SELECT from_bank, from_account, count(*) AS rows FROM led WHERE ('0x' || substr(md5(from_bank || '|' || from_account), 1, 8))::BIGINT % 10 = 0 GROUP BY ALL"))
def _(spark, sf):
    return sampling.sample_senders(order_ledger(spark, sf), 10).groupBy("from_bank", "from_account").agg(F.count("*").alias("rows"))


# row-wise


@query(
    "basic_calendar_features",
    event_sql("SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, round(sin(hour(ts) * (2 * pi() / 24)), 6) AS hour_sin, round(cos(hour(ts) * (2 * pi() / 24)), 6) AS hour_cos, CAST(hour(ts) BETWEEN 0 AND 5 AS INTEGER) AS is_night FROM led"),
)
def _(spark, sf):
    made = X.hour_features(F.col("ts"))
    return rounded(event_ledger(spark, sf).select("event_id", *[(c.cast("int") if n in ("hour", "is_night") else c + 0.0).alias(n) for n, c in made.items()]))


@query(
    "basic_flags",
    order_sql("SELECT l_orderkey, l_linenumber, l_partkey, CAST(payment_currency = receiving_currency AS INTEGER) AS is_currency_same, CAST(from_bank = to_bank AS INTEGER) AS is_same_bank, CAST(from_bank = to_bank AND from_account = to_account AS INTEGER) AS is_self_transfer FROM led"),
)
def _(spark, sf):
    return order_ledger(spark, sf).select(*ORDER_KEYS, *[c.cast("int").alias(n) for n, c in X.flag_features().items()])


_USD_SQL = "usd AS (SELECT *, paid / 100.0::DOUBLE * " + "(CASE payment_currency " + " ".join(f"WHEN '{k}' THEN {v / 1e6}::DOUBLE" for k, v in RATES.items()) + " END) AS pu, received / 100.0::DOUBLE * (CASE receiving_currency " + " ".join(f"WHEN '{k}' THEN {v / 1e6}::DOUBLE" for k, v in RATES.items()) + " END) AS ru FROM led)"


def usd(spark, sf) -> DataFrame:
    """The order ledger with amounts in the anchor, at the known rates."""
    rates = currency.Rates("AFRICA", {k: math.log(v / 1e6) for k, v in RATES.items()}, 0.0)
    return currency.to_anchor(as_contract(order_ledger(spark, sf)), rates, check=False)


@query("ledger_usd", order_sql(f", {_USD_SQL} SELECT l_orderkey, l_linenumber, l_partkey, round(pu, 4) AS amount_paid_usd, round(ru, 4) AS amount_received_usd FROM usd"))
def _(spark, sf):
    return rounded(usd(spark, sf).select(*ORDER_KEYS, "amount_paid_usd", "amount_received_usd"), 4)


@query("basic_amount_logs", order_sql(f", {_USD_SQL} SELECT l_orderkey, l_linenumber, l_partkey, round(ln(1 + greatest(pu, 0)), 6) AS amount_paid_usd_log, round(ln(1 + greatest(ru, 0)), 6) AS amount_received_usd_log FROM usd"))
def _(spark, sf):
    made = X.amount_features()
    return rounded(usd(spark, sf).select(*ORDER_KEYS, *[made[n].alias(n) for n in ("amount_paid_usd_log", "amount_received_usd_log")]))


@query("fx_log_deviation", order_sql(f", {_USD_SQL} SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN pu > 0 AND ru > 0 THEN ln(ru / pu) ELSE 0 END, 6) AS fx_log_deviation FROM usd"))
def _(spark, sf):
    return rounded(usd(spark, sf).select(*ORDER_KEYS, X.amount_features()["fx_log_deviation"].alias("fx_log_deviation")))


@query("amount_roundness", order_sql("SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(f"CAST(abs((l_quantity * 100) % {b}) <= 1e-8 AS INTEGER) AS is_round_{b}" for b in (10, 100, 1000)) + " FROM led"))
def _(spark, sf):
    rows = order_ledger(spark, sf).withColumn("amount", F.col("l_quantity") * 100)
    return rows.select(*ORDER_KEYS, *[c.cast("int").alias(n) for n, c in X.roundness("amount").items()])


# exchange rates


@query("fx_pair_medians", order_sql("SELECT payment_currency AS pay, receiving_currency AS receive, round(median(ln(received::DOUBLE / paid::DOUBLE)), 6) AS median, count(*) AS n FROM led WHERE payment_currency <> receiving_currency AND paid > 0 AND received > 0 GROUP BY ALL"))
def _(spark, sf):
    return rounded(currency.pair_medians(order_ledger(spark, sf), "paid", "received"))


@query("fx_rates_solved", order_sql(O.rates_sql("AFRICA", [c for c in RATES if c != "AFRICA"])))
def _(spark, sf):
    return rounded(currency.rates_table(spark, currency.fit_rates(order_ledger(spark, sf), "AFRICA", "paid", "received")))


# periods

_UNITS_SQL = "SELECT sec // 604800 * 604800 AS unit_start, count(*) AS n, min(sec) AS first_sec FROM led GROUP BY 1"
_WEEKS = periods.SplitConfig(unit=604800, warmup_units=4, val_units=4, threshold_units=4, test_size=0.15, tail_min_share=0.35)
_TAIL_SQL = f"u AS ({_UNITS_SQL}), dense AS (SELECT max(unit_start) AS last FROM u WHERE n >= 0.35 * (SELECT median(n) FROM u)), kept AS (SELECT u.* FROM u, dense WHERE unit_start <= last)"
_STARTS_SQL = (
    _TAIL_SQL
    + """, cum AS (SELECT *, sum(n) OVER (ORDER BY unit_start) AS run FROM kept), t AS (SELECT min(unit_start) AS test FROM cum WHERE run > (SELECT CAST(floor(sum(n) * (1 - 0.15)) AS BIGINT) FROM kept)),
starts AS (SELECT 'warmup' AS period, (SELECT min(sec) FROM led) AS start UNION ALL SELECT 'train', (SELECT min(unit_start) FROM u) + 4 * 604800 UNION ALL SELECT 'val', (SELECT test FROM t) - 8 * 604800
UNION ALL SELECT 'threshold', (SELECT test FROM t) - 4 * 604800 UNION ALL SELECT 'test', (SELECT test FROM t) UNION ALL SELECT 'tail', min(first_sec) FROM u, dense WHERE unit_start > last HAVING count(*) > 0)"""
)
_PERIOD_SQL = "CASE " + " ".join(f"WHEN sec >= (SELECT start FROM starts WHERE period = '{p}') THEN '{p}'" for p in ("tail", "test", "threshold", "val", "train")) + " ELSE 'warmup' END"


@query("unit_histogram", order_sql(_UNITS_SQL))
def _(spark, sf):
    return periods.unit_histogram(order_ledger(spark, sf), 604800)


@query("sparse_tail", order_sql(f", {_TAIL_SQL} SELECT unit_start, n, unit_start > last AS in_tail FROM u, dense"))
def _(spark, sf):
    units = periods.unit_histogram(order_ledger(spark, sf), 604800)
    starts = periods.plan_periods([tuple(r) for r in units.collect()], _WEEKS)
    tail = starts.get("tail")
    return units.select("unit_start", "n", (F.col("first_sec") >= tail if tail is not None else F.lit(False)).alias("in_tail"))


@query("period_boundaries", order_sql(f", {_STARTS_SQL} SELECT period, CAST(start AS BIGINT) AS start FROM starts"))
def _(spark, sf):
    return spark.createDataFrame(sorted(periods.fit_periods(order_ledger(spark, sf), _WEEKS).items()), "period string, start long")


@query("period_assignment", order_sql(f", {_STARTS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, {_PERIOD_SQL} AS period FROM led"))
def _(spark, sf):
    rows = order_ledger(spark, sf)
    return rows.select(*ORDER_KEYS, periods.period_of(periods.fit_periods(rows, _WEEKS), F.col("sec")).alias("period"))


@query("period_report", order_sql(f", {_STARTS_SQL} SELECT {_PERIOD_SQL} AS period, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives, min(ts) AS min_ts, max(ts) AS max_ts FROM led GROUP BY 1"))
def _(spark, sf):
    rows = order_ledger(spark, sf)
    return periods.period_report(rows, periods.fit_periods(rows, _WEEKS))


# history

_H = {
    "sender_prior_activity": ["sender_prev_tx_log"],
    "receiver_prior_activity": ["receiver_prev_tx_log"],
    "pair_prior_activity": ["pair_prev_tx_log", "is_new_pair"],
    "unique_counterparties": ["sender_unique_receivers_log", "receiver_unique_senders_log"],
    "interbank_ratio": ["sender_prior_interbank_ratio"],
    "minutes_since_prev": ["sender_minutes_since_prev_log", "receiver_minutes_since_prev_log"],
    "prior_avg_minutes": ["sender_prior_avg_minutes_log"],
    "amount_to_prior_mean": ["amount_to_sender_prior_mean_log", "amount_to_receiver_prior_mean_log"],
    "window_activity": [f"{r}_{k}_{w}_log" for w in history.WINDOWS for r in ("sender", "receiver") for k in ("tx", "amount")],
    "window_fan_in_out": [f"{n}_{w}_log" for w in history.WINDOWS for n in ("sender_new_receivers", "receiver_new_senders")],
    "window_inflow_passthrough": [f"{n}_{w}_log" for w in history.WINDOWS for n in ("sender_inflow", "sender_outflow_to_inflow")],
    "history_all_events": history.feature_names(),
}


def _shown(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(n).cast("int").alias(n) if n == "is_new_pair" else F.round(n, 6).alias(n) for n in names])


def _history_query(names: list[str]):
    return lambda spark, sf: _shown(history.history(event_ledger(spark, sf), names=names), ["event_id"], names)


for _name, _names in _H.items():
    query(_name, O.history_sql("event", history.WINDOWS, _names, ["event_id"]))(_history_query(_names))


@query("history_all_orders", O.history_sql("order", ORDER_WINDOWS, history.feature_names(ORDER_WINDOWS), ORDER_KEYS))
def _(spark, sf):
    return _shown(history.history(order_ledger(spark, sf), ORDER_WINDOWS), ORDER_KEYS, history.feature_names(ORDER_WINDOWS))


def _cuts(rows: DataFrame, parts: int) -> list[int]:
    low, high = rows.agg(F.min("sec"), F.max("sec")).first()
    return [low + (high - low + 1) * i // parts for i in range(1, parts)]


@query("history_incremental_7_batches", O.history_sql("event", history.WINDOWS, history.feature_names(), ["event_id"]))
def _(spark, sf):
    rows = event_ledger(spark, sf)
    return _shown(incremental.replay(rows, _cuts(rows, 7), history.WINDOWS), ["event_id"], history.feature_names())


@query("history_score_only", O.history_sql("event", history.WINDOWS, history.feature_names(), ["event_id"], "n.sec >= (SELECT min(sec) + (max(sec) - min(sec) + 1) * 3 // 4 FROM led)"))
def _(spark, sf):
    rows = event_ledger(spark, sf)
    cut = _cuts(rows, 4)[-1]
    state = incremental.kept(history.next_state(rows.where(F.col("sec") < cut)))
    return _shown(history.history(rows.where(F.col("sec") >= cut), state=state), ["event_id"], history.feature_names())


# ordered target encoding

_SINGLE = [("payment_format",), ("payment_currency",), ("receiving_currency",)]
_CROSS = [("payment_currency", "receiving_currency"), ("from_bank", "from_account"), ("from_bank", "from_account", "to_bank", "to_account")]


def _encoded(spark, sf, config: encoding.EncoderConfig, weight: str | None = None) -> DataFrame:
    rows = order_ledger(spark, sf)
    if weight:
        rows = rows.withColumn("weight", F.expr(weight))
    out = encoding.encode_training(rows, config, weight="weight" if weight else None)
    return rounded(out.select(*ORDER_KEYS, *[c for c in out.columns if "__" in c]))


@query("ote_train_single", O.ote_sql("order", _SINGLE, (20, 200), ORDER_KEYS))
def _(spark, sf):
    return _encoded(spark, sf, encoding.EncoderConfig(tuple(s[0] for s in _SINGLE)))


@query("ote_train_interactions", O.ote_sql("order", _CROSS, (20, 200), ORDER_KEYS))
def _(spark, sf):
    return _encoded(spark, sf, encoding.EncoderConfig((), tuple(_CROSS)))


@query("ote_weighted", O.ote_sql("order", _SINGLE[:1] + _CROSS[:1], (2,), ORDER_KEYS, "(1 + l_linenumber % 3)"))
def _(spark, sf):
    return _encoded(spark, sf, encoding.EncoderConfig(_SINGLE[0], (_CROSS[0],), (2.0,)), "1 + l_linenumber % 3")


@query("ote_frozen_transform", O.frozen_ote_sql("order", _SINGLE[:1] + _CROSS[1:2], (20, 200), ORDER_KEYS, ORDER_CUT))
def _(spark, sf):
    rows = order_ledger(spark, sf)
    model = encoding.fit_encoder(rows.where(F.col("sec") < ORDER_CUT), encoding.EncoderConfig(_SINGLE[0], (_CROSS[1],)), check=False)
    out = encoding.encode_frozen(rows.where(F.col("sec") >= ORDER_CUT), model)
    return rounded(out.select(*ORDER_KEYS, *[c for c in out.columns if "__" in c]))


@query(
    "ote_global_prior",
    order_sql(""", g AS (SELECT epoch_us(ts) AS us, sum(label) AS s, count(*) AS n FROM led GROUP BY 1)
SELECT us, CAST(coalesce(sum(s) OVER w, 0) AS BIGINT) AS label_sum, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS rows_before FROM g WINDOW w AS (ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
)
def _(spark, sf):
    rows = order_ledger(spark, sf).select(X.epoch_micros("ts").alias("_t"), F.col("label").cast("long").alias("_wy"), F.lit(1).cast("long").alias("_w"))
    return encoding.past_prior(rows).select(F.col("_t").alias("us"), F.col("_gs").cast("long").alias("label_sum"), F.col("_gn").cast("long").alias("rows_before"))


# lookups


@query(
    "known_account_segments",
    order_sql(f""", known AS (SELECT from_bank AS bank, from_account AS account FROM led WHERE sec < {EARLY_CUT} UNION SELECT to_bank, to_account FROM led WHERE sec < {EARLY_CUT})
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN k.account IS NULL THEN 'new' ELSE 'known' END AS sender FROM led LEFT JOIN known k ON k.bank = from_bank AND k.account = from_account WHERE sec >= {EARLY_CUT}"""),
)
def _(spark, sf):
    rows = order_ledger(spark, sf)
    return known_accounts(rows.where(F.col("sec") >= EARLY_CUT), rows.where(F.col("sec") < EARLY_CUT)).select(*ORDER_KEYS, "sender")


def accounts(rows: DataFrame) -> DataFrame:
    """Distinct (bank, account) over both roles."""
    roles = F.array(F.struct(F.col("from_bank").alias("bank"), F.col("from_account").alias("account")), F.struct(F.col("to_bank").alias("bank"), F.col("to_account").alias("account")))
    return rows.select(F.explode(roles).alias("a")).select("a.*").distinct()


def known_accounts(rows: DataFrame, past: DataFrame) -> DataFrame:
    known = accounts(past).select(F.col("bank").alias("from_bank"), F.col("account").alias("from_account"), F.lit("known").alias("sender"))
    return rows.join(known, ["from_bank", "from_account"], "left").withColumn("sender", F.coalesce("sender", F.lit("new")))


@query(
    "new_accounts_anti",
    order_sql(f"SELECT DISTINCT from_bank, from_account FROM led x WHERE sec >= {EARLY_CUT} AND NOT EXISTS (SELECT 1 FROM led y WHERE y.sec < {EARLY_CUT} AND (y.from_bank = x.from_bank AND y.from_account = x.from_account))"),
)
def _(spark, sf):
    rows = order_ledger(spark, sf)
    old = rows.where(F.col("sec") < EARLY_CUT).select("from_bank", "from_account")
    return rows.where(F.col("sec") >= EARLY_CUT).select("from_bank", "from_account").distinct().join(old, ["from_bank", "from_account"], "left_anti")


# metrics


def _scored(spark, sf) -> DataFrame:
    return order_ledger(spark, sf).withColumn("target", F.col("label")).withColumn("prediction", F.col("score") >= 0.9)


@query("average_precision", order_sql(f", {O.CURVE} SELECT round(sum(pos * run_pos::DOUBLE / run_n) / sum(pos), 9) AS average_precision FROM c"))
def _(spark, sf):
    return rounded(metrics.average_precision(metrics.score_curve(_scored(spark, sf))), 9)


@query("roc_auc", order_sql(f", {O.CURVE} SELECT round(sum((n - pos) * (run_pos - pos / 2.0::DOUBLE)) / (sum(pos) * sum(n - pos)), 9) AS roc_auc FROM c"))
def _(spark, sf):
    return rounded(metrics.roc_auc(metrics.score_curve(_scored(spark, sf))), 9)


_PR = f", {O.CURVE}, pr AS (SELECT score AS threshold, run_pos::DOUBLE / run_n AS p, run_pos::DOUBLE / (SELECT sum(pos) FROM c) AS r FROM c), pts AS (SELECT threshold, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM pr)"


@query("pr_curve", order_sql(_PR + " SELECT threshold, precision, recall, f1 FROM pts"))
def _(spark, sf):
    return rounded(metrics.pr_points(metrics.score_curve(_scored(spark, sf))), 9, ("threshold",))


@query("pr_curve_max_f1", order_sql(_PR + " SELECT threshold, precision, recall, f1 FROM pts ORDER BY f1 DESC, threshold LIMIT 1"))
def _(spark, sf):
    return rounded(metrics.best_threshold(metrics.score_curve(_scored(spark, sf)), 9), 9, ("threshold",))


@query(
    "confusion_and_brier",
    order_sql(""", x AS (SELECT label, score, score >= 0.9 AS p FROM led), c AS (SELECT count(*) FILTER (WHERE label = 0 AND NOT p) AS tn, count(*) FILTER (WHERE label = 0 AND p) AS fp, count(*) FILTER (WHERE label = 1 AND NOT p) AS fn, count(*) FILTER (WHERE label = 1 AND p) AS tp, round(avg((score - label) ** 2), 6) AS brier FROM x)
SELECT tn, fp, fn, tp, brier, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
round((tp + fp)::DOUBLE / (tn + fp + fn + tp), 6) AS alert_rate, round((tp + fn)::DOUBLE / (tn + fp + fn + tp), 6) AS prevalence FROM c"""),
)
def _(spark, sf):
    return rounded(metrics.confusion(_scored(spark, sf)))


_SEGMENTS = ["payment_format", "payment_currency", "receiving_currency", "from_bank", "to_bank", "is_self"]


@query(
    "segment_errors",
    order_sql(", x AS (SELECT *, CAST(from_bank = to_bank AND from_account = to_account AS VARCHAR) AS is_self, score >= 0.9 AS p FROM led) " + " UNION ALL ".join(f"SELECT '{c}' AS segment, {c} AS value, {O.SUMMARY} FROM x GROUP BY {c}" for c in _SEGMENTS)),
)
def _(spark, sf):
    rows = _scored(spark, sf).withColumn("is_self", (F.col("from_bank") == F.col("to_bank")) & (F.col("from_account") == F.col("to_account")))
    return rounded(metrics.segment_errors(rows, _SEGMENTS), 9)


_ORDER_BY = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "paid"]
_ALERTS = f", x AS (SELECT *, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY score DESC, {', '.join(_ORDER_BY)}) <= floor(count(*) OVER (PARTITION BY CAST(ts AS DATE)) * 0.1::DOUBLE) AS p FROM led)"


@query("daily_budget_alerts", order_sql(_ALERTS + " SELECT l_orderkey, l_linenumber, l_partkey, p AS prediction FROM x"))
def _(spark, sf):
    return metrics.daily_alerts(_scored(spark, sf), 0.1, _ORDER_BY).select(*ORDER_KEYS, "prediction")


@query("budget_metrics", order_sql(_ALERTS + f" SELECT {O.SUMMARY} FROM x"))
def _(spark, sf):
    return rounded(metrics.budget_metrics(_scored(spark, sf), 0.1, _ORDER_BY), 9)


@query(
    "calibration_bins",
    order_sql(", e AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM led) SELECT CAST(len(list_filter(q, lambda x: x < score)) AS INTEGER) AS bin, count(*) AS rows, round(avg(score), 6) AS mean_score, round(avg(label::DOUBLE), 6) AS observed FROM led, e GROUP BY 1"),
)
def _(spark, sf):
    return rounded(metrics.calibration(_scored(spark, sf)))


@query(
    "rank_ensemble",
    event_sql(", x AS (SELECT event_id, score, paid % 1000 AS other FROM led), k AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY other) + (count(*) OVER (PARTITION BY other) - 1) / 2.0::DOUBLE AS b FROM x) SELECT event_id, (a + b) / 2 AS score FROM k"),
)
def _(spark, sf):
    rows = event_ledger(spark, sf).select("event_id", F.col("score").alias("one"), (F.col("paid") % 1000).alias("two"))
    return metrics.rank_ensemble(rows, ["one", "two"]).select("event_id", "score")


# drift, folds, exploration


def _halves(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = order_ledger(spark, sf)
    return rows.where(F.col("sec") < ORDER_CUT), rows.where(F.col("sec") >= ORDER_CUT)


@query("psi_numeric", O.drift_sql(["paid"], ORDER_CUT))
def _(spark, sf):
    return rounded(drift.drift_report(*_halves(spark, sf), ["paid"]).select("feature", "psi", "investigate"))


@query("drift_report", O.drift_sql(DRIFT_FEATURES, ORDER_CUT))
def _(spark, sf):
    return rounded(drift.drift_report(*_halves(spark, sf), DRIFT_FEATURES).select("feature", "psi", "investigate"))


def _folds(rows: DataFrame) -> list[tuple[int, str, int, int]]:
    return periods.planned_folds(rows, 3, 10, 2, 4)


_FOLDS = """, b AS (SELECT min(sec) AS lo, min(sec) // 86400 * 86400 AS d FROM led), f AS (SELECT i::INTEGER AS fold, lo, d + (10 + i * 4) * 86400 AS a FROM b, range(3) r(i)),
parts AS (SELECT fold, 'train' AS part, lo, a AS hi FROM f UNION ALL SELECT fold, 'val', a, a + 172800 FROM f UNION ALL SELECT fold, 'evaluation', a + 172800, a + 172800 + 345600 FROM f),
rows AS (SELECT fold, part, led.* FROM led JOIN parts ON sec >= parts.lo AND sec < parts.hi)"""


@query("rolling_fold_windows", event_sql(_FOLDS + ' SELECT fold, part, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives, min(ts) AS start, max(ts) AS "end" FROM rows GROUP BY ALL'))
def _(spark, sf):
    rows = event_ledger(spark, sf)
    return periods.fold_table(rows, _folds(rows))


@query(
    "fold_metric_summary",
    event_sql(
        _FOLDS
        + f", m AS (SELECT 'score' AS model, fold, label, score >= 0.8 AS p FROM rows WHERE part = 'evaluation' UNION ALL SELECT 'amount', fold, label, paid >= 10000 FROM rows WHERE part = 'evaluation'), s AS (SELECT model, fold, {O.SUMMARY} FROM m GROUP BY ALL) SELECT model, "
        + ", ".join(f"round({fn}({c}), 6) AS {c}_{n}" for c in ("precision", "recall", "alert_rate") for n, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))
        + " FROM s GROUP BY model"
    ),
)
def _(spark, sf):
    rows = event_ledger(spark, sf)
    parts = periods.fold_rows(rows, _folds(rows)).where("part = 'evaluation'")
    models = F.array(F.struct(F.lit("score").alias("model"), (F.col("score") >= 0.8).alias("prediction")), F.struct(F.lit("amount").alias("model"), (F.col("paid") >= 10000).alias("prediction")))
    long = parts.select("fold", F.col("label").alias("target"), F.explode(models).alias("m")).select("fold", "target", "m.*")
    each = rounded(metrics.error_summary(long, ["model", "fold"]), 9)
    return rounded(learners.fold_summary(each, ["precision", "recall", "alert_rate"]))


@query("eda_hourly", event_sql("SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives, round(avg(label::DOUBLE), 6) AS rate FROM led GROUP BY 1"))
def _(spark, sf):
    return rounded(event_ledger(spark, sf).groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("rows"), F.sum(F.col("label").cast("long")).alias("positives"), F.avg(F.col("label").cast("double")).alias("rate")))


@query("eda_category_rates", order_sql("SELECT payment_format, payment_currency, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives, round(avg(label::DOUBLE), 6) AS rate FROM led GROUP BY ALL"))
def _(spark, sf):
    return rounded(order_ledger(spark, sf).groupBy("payment_format", "payment_currency").agg(F.count("*").alias("rows"), F.sum(F.col("label").cast("long")).alias("positives"), F.avg(F.col("label").cast("double")).alias("rate")))


@query("eda_describe", order_sql("SELECT count(*) AS rows, round(avg(paid::DOUBLE), 3) AS mean, round(stddev_samp(paid::DOUBLE), 3) AS std, min(paid) AS low, max(paid) AS high, round(quantile_cont(paid::DOUBLE, 0.25), 3) AS q1, round(median(paid::DOUBLE), 3) AS q2, round(quantile_cont(paid::DOUBLE, 0.75), 3) AS q3 FROM led"))
def _(spark, sf):
    p = F.col("paid").cast("double")
    rows = materialised(order_ledger(spark, sf).select("paid", p.alias("x")), "amounts")
    out = rows.agg(F.count("*").alias("rows"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("paid").alias("low"), F.max("paid").alias("high"))
    cuts = quantiles(rows, [], "x", [0.25, 0.5, 0.75]).first()["q"]
    return rounded(out.withColumns({f"q{i + 1}": F.lit(x) for i, x in enumerate(cuts)}), 3)


@query("eda_accounts", order_sql("SELECT count(*) AS accounts FROM (SELECT from_bank, from_account FROM led UNION SELECT to_bank, to_account FROM led)"))
def _(spark, sf):
    return accounts(order_ledger(spark, sf)).agg(F.count("*").alias("accounts"))


@query("eda_rows_per_sender", event_sql("SELECT n AS rows, count(*) AS senders FROM (SELECT count(*) AS n FROM led GROUP BY from_bank, from_account) GROUP BY 1"))
def _(spark, sf):
    return event_ledger(spark, sf).groupBy("from_bank", "from_account").agg(F.count("*").alias("rows")).groupBy("rows").agg(F.count("*").alias("senders"))


@query("eda_correlation", order_sql("SELECT round(corr(paid::DOUBLE, l_quantity), 6) AS paid_quantity, round(corr(paid::DOUBLE, l_discount), 6) AS paid_discount, round(corr(l_quantity, l_discount), 6) AS quantity_discount FROM led"))
def _(spark, sf):
    p = F.col("paid").cast("double")
    return rounded(order_ledger(spark, sf).agg(F.corr(p, F.col("l_quantity")).alias("paid_quantity"), F.corr(p, F.col("l_discount")).alias("paid_discount"), F.corr("l_quantity", "l_discount").alias("quantity_discount")))


@query("eda_amount_histogram", order_sql("SELECT CAST(floor(ln(1 + paid::DOUBLE) * 4) AS INTEGER) AS bin, count(*) AS rows FROM led GROUP BY 1"))
def _(spark, sf):
    return order_ledger(spark, sf).groupBy(F.floor(F.log1p(F.col("paid").cast("double")) * 4).cast("int").alias("bin")).agg(F.count("*").alias("rows"))


@query("top_segments", order_sql(", s AS (SELECT payment_format, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM led GROUP BY 1) SELECT * FROM s ORDER BY positives DESC, payment_format LIMIT 3"))
def _(spark, sf):
    out = order_ledger(spark, sf).groupBy("payment_format").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("positives"))
    return out.orderBy(F.desc("positives"), "payment_format").limit(3)


# sampling and learners

_KEY = "(l_orderkey * 2654435761 + l_partkey * 40503 + l_linenumber * 97 + paid) % 1000003"


@query(
    "negative_downsample_weights",
    order_sql(f", n AS (SELECT *, {_KEY} AS k, row_number() OVER (ORDER BY {_KEY}) AS rn, count(*) OVER () AS total FROM led WHERE label = 0) SELECT label, count(*) AS rows, CAST(sum(k) AS BIGINT) AS keys, round(sum(w), 6) AS weights FROM (SELECT label, k, total::DOUBLE / floor(0.3 * total) AS w FROM n WHERE rn <= floor(0.3 * total) UNION ALL SELECT label, {_KEY}, 1 FROM led WHERE label = 1) GROUP BY label"),
)
def _(spark, sf):
    kept = sampling.downsample_negatives(order_ledger(spark, sf), 0.3, F.expr(_KEY))
    return kept.groupBy("label").agg(F.count("*").alias("rows"), F.sum(F.expr(_KEY)).alias("keys"), F.round(F.sum("sample_weight"), 6).alias("weights"))


_MODEL_FEATURES = ["sender_prev_tx_log", "receiver_prev_tx_log", "sender_prior_interbank_ratio", "amount_to_sender_prior_mean_log", "sender_tx_24h_log", "receiver_amount_24h_log", "sender_inflow_24h_log"]


def _training(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = history.history(event_ledger(spark, sf).drop("score"), names=_MODEL_FEATURES).withColumn("sample_weight", F.lit(1.0))
    rows = materialised(rows, "training")
    cut = _cuts(rows, 4)[-1]
    return rows.where(F.col("sec") < cut), rows.where(F.col("sec") >= cut)


@query("logreg_scores")
def _(spark, sf):
    train, val = _training(spark, sf)
    return learners.logistic(train, _MODEL_FEATURES)(val).select("event_id", "label", "score")


@query("gbt_scores")
def _(spark, sf):
    train, val = _training(spark, sf)
    return learners.boosted(train, _MODEL_FEATURES, rounds=5, depth=3)(val).select("event_id", "label", "score")


@query("bootstrap_ap_diff")
def _(spark, sf):
    rows = event_ledger(spark, sf).select(F.col("label").alias("target"), F.col("score").alias("one"), (F.col("paid") % 997 / 997.0).alias("two"))
    return learners.bootstrap_difference(rows, "one", "two", 200)


@query("backtest_summary")
def _(spark, sf):
    rows = materialised(history.history(event_ledger(spark, sf).drop("score"), names=_MODEL_FEATURES), "backtest")
    config = encoding.EncoderConfig((), (("from_bank", "from_account"), ("to_bank", "to_account")))
    fits = {"logistic": learners.logistic, "boosted": lambda train, names: learners.boosted(train, names, depth=2, rounds=4)}
    found = learners.backtest(rows, _folds(rows), config, _MODEL_FEATURES, fits, 0.1, ["event_id"])
    return learners.fold_summary(found, ["precision", "recall", "alert_rate"])


@query("alerts_per_sender_rank", event_sql("SELECT from_account, event_id, rn FROM (SELECT from_account, event_id, CAST(row_number() OVER (PARTITION BY from_account ORDER BY score DESC, event_id) AS INTEGER) AS rn FROM led) WHERE rn <= 3"))
def _(spark, sf):
    order = Window.partitionBy("from_account").orderBy(F.desc("score"), "event_id")
    return event_ledger(spark, sf).select("from_account", "event_id", F.row_number().over(order).alias("rn")).where("rn <= 3")


@query("late_rows_quarantined", event_sql("SELECT event_id, sec <= (SELECT min(sec) + (max(sec) - min(sec) + 1) * 3 // 4 FROM led) AS late FROM led"))
def _(spark, sf):
    rows = event_ledger(spark, sf)
    on_time, late = incremental.admit(rows, _cuts(rows, 4)[-1])
    return on_time.select("event_id", F.lit(False).alias("late")).unionByName(late.select("event_id", F.lit(True).alias("late")))

