"""Strictly-past account, counterparty and pass-through features on a time grid.

Rows at the same second see the same past, so every feature is a function of (account, second) and the row's own
amounts. Rows are first summed to a grid of (sender, receiver, second); windows run over grids, never over raw rows, so
a hot account costs as many grid rows as it has distinct seconds. Frames are RANGE frames that end at -1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strictpast.functions.expressions import capped_ratio, safe_log1p
from strictpast.plans.storage import materialised

WINDOWS = {"1h": 3600, "24h": 86400}
PAIR = ["from_bank", "from_account", "to_bank", "to_account"]
#: Rows of one account that a task may hold.
BUSY = 4_000_000
#: Sums of a grid row: by its account as sender (out) and as receiver (in).
SUMS = ["out_n", "out_paid", "out_inter", "out_new", "in_n", "in_received", "in_new"]


@dataclass
class State:
    """What earlier batches leave: pair counts, totals of folded seconds per account, and the recent grid."""

    pairs: DataFrame  # PAIR, prior
    archive: DataFrame  # bank, account, SUMS, first_out, last_out, last_in, out_times
    recent: DataFrame  # bank, account, sec, SUMS
    last: int


def feature_names(windows: dict[str, int] = WINDOWS) -> list[str]:
    names = ["sender_prev_tx_log", "receiver_prev_tx_log", "pair_prev_tx_log", "is_new_pair", "sender_unique_receivers_log", "receiver_unique_senders_log", "sender_prior_interbank_ratio"]
    names += ["sender_minutes_since_prev_log", "receiver_minutes_since_prev_log", "sender_prior_avg_minutes_log", "amount_to_sender_prior_mean_log", "amount_to_receiver_prior_mean_log"]
    for w in windows:
        names += [f"sender_tx_{w}_log", f"sender_amount_{w}_log", f"receiver_tx_{w}_log", f"receiver_amount_{w}_log"]
        names += [f"sender_new_receivers_{w}_log", f"receiver_new_senders_{w}_log", f"sender_inflow_{w}_log", f"sender_outflow_to_inflow_{w}_log"]
    return names


def pair_grid(rows: DataFrame, state: State | None = None, span: int | None = None) -> DataFrame:
    """One row per (pair, second): n, paid, received, prior count of the pair, whether the pair is new at this second.

    With ``span`` (seconds) a pair is counted within spans and over its spans' totals, so that no task holds more of a
    busy pair than the seconds of one span.
    """
    grid = rows.groupBy(*PAIR, "sec").agg(F.count("*").alias("n"), F.sum("paid").alias("paid"), F.sum("received").alias("received"))
    if span:
        grid = materialised(grid.withColumn("span", F.floor(F.col("sec") / span).cast("long")), "pair-spans")
        totals = grid.groupBy(*PAIR, "span").agg(F.sum("n").alias("whole"))
        earlier = Window.partitionBy(*PAIR).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
        before = totals.select(*PAIR, "span", F.coalesce(F.sum("whole").over(earlier), F.lit(0)).alias("before"))
        inside = Window.partitionBy(*PAIR, "span").orderBy("sec").rangeBetween(Window.unboundedPreceding, -1)
        grid = grid.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before, [*PAIR, "span"])
        prior = F.col("inside") + F.col("before")
    else:
        past = Window.partitionBy(*PAIR).orderBy("sec").rangeBetween(Window.unboundedPreceding, -1)
        prior = F.coalesce(F.sum("n").over(past), F.lit(0))
    if state is not None:
        grid = grid.join(state.pairs, PAIR, "left")
        prior = prior + F.coalesce(F.col("prior"), F.lit(0))
    return grid.withColumn("pair_prior", prior).withColumn("new", (F.col("pair_prior") == 0).cast("long")).select(*PAIR, "sec", "n", "paid", "received", "pair_prior", "new")


def account_grid(pairs: DataFrame) -> DataFrame:
    """One row per (account, second) with the sums of both roles."""
    inter = (F.col("from_bank") != F.col("to_bank")).cast("long") * F.col("n")
    nil, nothing = F.lit(0).cast("long"), F.lit(0).cast(pairs.schema["paid"].dataType)
    out = F.struct(F.col("from_bank").alias("bank"), F.col("from_account").alias("account"), F.col("n").alias("out_n"), F.col("paid").alias("out_paid"), inter.alias("out_inter"), F.col("new").alias("out_new"), nil.alias("in_n"), nothing.alias("in_received"), nil.alias("in_new"))
    into = F.struct(F.col("to_bank").alias("bank"), F.col("to_account").alias("account"), nil.alias("out_n"), nothing.alias("out_paid"), nil.alias("out_inter"), nil.alias("out_new"), F.col("n").alias("in_n"), F.col("received").cast(pairs.schema["paid"].dataType).alias("in_received"), F.col("new").alias("in_new"))
    roles = pairs.select("sec", F.explode(F.array(out, into)).alias("role")).select("sec", "role.*")
    return roles.groupBy("bank", "account", "sec").agg(*[F.sum(c).alias(c) for c in SUMS])


def _looked_back(grid: DataFrame, windows: dict[str, int], state: State | None, span: int | None = None) -> DataFrame:
    """Grid rows with their account's strict past: p_<sum>, last_out, last_in, first_out, out_times, w_<window>_<sum>."""
    rows = grid if state is None else grid.withColumn("now", F.lit(True)).unionByName(state.recent.withColumn("now", F.lit(False)))
    own = ["bank", "account"]
    seen = _past_of_spans(rows, windows, span) if span else _past_of_accounts(rows, windows)
    if state is None:
        return seen
    seen = seen.where("now").drop("now")
    old = state.archive.select(*own, *[F.col(c).alias(f"a_{c}") for c in [*SUMS, *_ENDS]])
    return _added(seen.join(old, own, "left"), [*own, "sec"], [n for n in seen.columns if n.startswith("w_")])


#: What the past keeps besides sums.
_ENDS = ["first_out", "last_out", "last_in", "out_times"]


def _added(df: DataFrame, keys: list[str], rest: list[str]) -> DataFrame:
    """A past (p_, ends) joined with an earlier one (a_, null where there is none), as one past."""
    out = [(F.col(f"p_{c}") + F.coalesce(f"a_{c}", F.lit(0))).alias(f"p_{c}") for c in SUMS]
    out += [F.coalesce("last_out", "a_last_out").alias("last_out"), F.coalesce("last_in", "a_last_in").alias("last_in"), F.coalesce("a_first_out", "first_out").alias("first_out"), (F.col("out_times") + F.coalesce("a_out_times", F.lit(0))).alias("out_times")]
    return df.select(*keys, *out, *rest)


def _frames(by, windows: dict[str, int], real: Column) -> dict[str, Column]:
    """The past within a partition; all-time sums count rows where ``real`` holds, windows count all."""
    past = by.rangeBetween(Window.unboundedPreceding, -1)
    out_sec = F.when(real & (F.col("out_n") > 0), F.col("sec"))
    in_sec = F.when(real & (F.col("in_n") > 0), F.col("sec"))
    made = {f"p_{c}": F.coalesce(F.sum(F.when(real, F.col(c))).over(past), F.lit(0)) for c in SUMS}
    made |= {"last_out": F.max(out_sec).over(past), "last_in": F.max(in_sec).over(past), "first_out": F.min(out_sec).over(past), "out_times": F.count(out_sec).over(past)}
    for w, size in windows.items():
        frame = by.rangeBetween(-(size - 1), -1)
        made |= {f"w_{w}_{c}": F.coalesce(F.sum(c).over(frame), F.lit(0)) for c in ("out_n", "out_paid", "out_new", "in_n", "in_received", "in_new")}
    return made


def _past_of_accounts(rows: DataFrame, windows: dict[str, int]) -> DataFrame:
    """An account per window partition."""
    made = _frames(Window.partitionBy("bank", "account").orderBy("sec"), windows, F.lit(True))
    return rows.select("bank", "account", "sec", *[c for c in rows.columns if c == "now"], *[e.alias(n) for n, e in made.items()])


def _past_of_spans(rows: DataFrame, windows: dict[str, int], span: int) -> DataFrame:
    """A span of an account per window partition, for accounts too busy for one task.

    Rows that windows of the next span can reach are copied into it; all-time values are those of the span plus the
    totals of the account's earlier spans.
    """
    if span < max(windows.values()):
        raise ValueError("a span must be as long as the longest window")
    mark = F.floor(F.col("sec") / span).cast("long")
    reach = F.col("sec") >= (mark + 1) * span - (max(windows.values()) - 1)
    places = F.array_compact(F.array(F.struct(mark.alias("span"), F.lit(False).alias("copy")), F.when(reach, F.struct((mark + 1).alias("span"), F.lit(True).alias("copy")))))
    cut = rows.withColumn("place", F.explode(places)).select(*rows.columns, "place.*")
    made = _frames(Window.partitionBy("bank", "account", "span").orderBy("sec"), windows, ~F.col("copy"))
    kept = [c for c in rows.columns if c == "now"]
    inside = cut.select("bank", "account", "sec", "span", "copy", *kept, *[e.alias(n) for n, e in made.items()]).where(~F.col("copy"))
    out_sec, in_sec = F.when(F.col("out_n") > 0, F.col("sec")), F.when(F.col("in_n") > 0, F.col("sec"))
    totals = rows.groupBy("bank", "account", mark.alias("span")).agg(*[F.sum(c).alias(c) for c in SUMS], F.min(out_sec).alias("first_out"), F.max(out_sec).alias("last_out"), F.max(in_sec).alias("last_in"), F.count(out_sec).alias("out_times"))
    before = Window.partitionBy("bank", "account").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    join_up = {"first_out": F.min, "last_out": F.max, "last_in": F.max}
    earlier = totals.select("bank", "account", "span", *[join_up.get(c, F.sum)(c).over(before).alias(f"a_{c}") for c in [*SUMS, *_ENDS]])
    joined = inside.join(earlier, ["bank", "account", "span"])
    return _added(joined, ["bank", "account", "sec", *kept], [n for n in made if n.startswith("w_")])


def busy_span(rows: DataFrame, windows: dict[str, int], most: int = BUSY) -> int | None:
    """Seconds of a span in which no account has more than about ``most`` rows; None where no account has so many at all.

    One narrow aggregate, and none where there are no more rows than that in all. Spans are as long as the longest
    window at least; a busy account's rows may bunch, so the busiest stretch of its time counts, in 256 steps of it.
    """
    if rows.count() <= most:
        return None
    roles = F.array(F.struct(F.col("from_bank").alias("bank"), F.col("from_account").alias("account")), F.struct(F.col("to_bank").alias("bank"), F.col("to_account").alias("account")))
    low, high = rows.agg(F.min("sec"), F.max("sec")).first()
    step = max(1, -(-(high - low + 1) // 256))
    counts = rows.select(F.explode(roles).alias("a"), F.floor((F.col("sec") - low) / step).alias("step")).groupBy("a", "step").agg(F.count("*").alias("n"))
    whole, peak = counts.groupBy("a").agg(F.sum("n").alias("whole"), F.max("n").alias("peak")).where(F.col("whole") > most).agg(F.max("whole"), F.max("peak")).first()
    if whole is None:
        return None
    return max(max(windows.values()), step * max(1, most // peak))


def _check(windows: dict[str, int]) -> None:
    if not windows or min(windows.values()) <= 0:
        raise ValueError("windows must be positive")


def features(paid: Column, received: Column, windows: dict[str, int]) -> dict[str, Column]:
    """The feature expressions over a row joined with its sender's (s_), receiver's (r_) and pair's past."""
    c = F.col
    out: dict[str, Column] = {
        "sender_prev_tx_log": safe_log1p(c("s_p_out_n")),
        "receiver_prev_tx_log": safe_log1p(c("r_p_in_n")),
        "pair_prev_tx_log": safe_log1p(c("pair_prior")),
        "is_new_pair": (c("pair_prior") == 0).cast("byte"),
        "sender_unique_receivers_log": safe_log1p(c("s_p_out_new")),
        "receiver_unique_senders_log": safe_log1p(c("r_p_in_new")),
        "sender_prior_interbank_ratio": F.when(c("s_p_out_n") > 0, c("s_p_out_inter").cast("double") / c("s_p_out_n")).otherwise(0.0),
    }

    def since(last: str) -> Column:
        return F.when(c(last).isNotNull(), F.log1p((c("sec") - c(last)).cast("double") / 60)).otherwise(-1.0)

    gap = (c("s_last_out") - c("s_first_out")).cast("double") / F.greatest(c("s_out_times") - 1, F.lit(1)) / 60
    out["sender_minutes_since_prev_log"] = since("s_last_out")
    out["receiver_minutes_since_prev_log"] = since("r_last_in")
    out["sender_prior_avg_minutes_log"] = F.when(c("s_out_times") >= 2, F.log1p(gap)).otherwise(-1.0)

    def to_mean(amount: Column, total: str, count: str) -> Column:
        mean = F.when(c(count) > 0, c(total).cast("double") / c(count))
        return capped_ratio(amount, F.coalesce(mean, F.lit(0.0)), F.lit(0.0))

    out["amount_to_sender_prior_mean_log"] = to_mean(paid, "s_p_out_paid", "s_p_out_n")
    out["amount_to_receiver_prior_mean_log"] = to_mean(received, "r_p_in_received", "r_p_in_n")
    for w in windows:
        s, r = f"s_w_{w}_", f"r_w_{w}_"
        out[f"sender_tx_{w}_log"] = safe_log1p(c(s + "out_n"))
        out[f"sender_amount_{w}_log"] = safe_log1p(c(s + "out_paid"))
        out[f"receiver_tx_{w}_log"] = safe_log1p(c(r + "in_n"))
        out[f"receiver_amount_{w}_log"] = safe_log1p(c(r + "in_received"))
        out[f"sender_new_receivers_{w}_log"] = safe_log1p(c(s + "out_new"))
        out[f"receiver_new_senders_{w}_log"] = safe_log1p(c(r + "in_new"))
        out[f"sender_inflow_{w}_log"] = safe_log1p(c(s + "in_received"))
        out[f"sender_outflow_to_inflow_{w}_log"] = capped_ratio(c(s + "out_paid").cast("double") + paid, c(s + "in_received"), F.lit(-1.0))
    return out


def history(rows: DataFrame, windows: dict[str, int] = WINDOWS, state: State | None = None, names: list[str] | None = None, span: int | None = None) -> DataFrame:
    """``rows`` (PAIR, sec, paid, received >= 0 and any other columns) with history features added, as doubles.

    Rows and grids are written to the shared folder when this is called; ``names`` picks features of the result. Accounts
    and pairs too busy for one task are cut by time: into spans of ``span`` seconds, or by ``busy_span`` where it is None.
    """
    _check(windows)
    # Rows and both grids are read more than once, with different columns: written, they are computed once.
    rows = materialised(rows, "rows")
    span = span or busy_span(rows, windows)
    pairs = materialised(pair_grid(rows, state, span), "pairs")
    past = materialised(_looked_back(account_grid(pairs), windows, state, span), "past")
    numbers = [n for n in past.columns if n not in ("bank", "account", "sec")]
    sender = past.select(F.col("bank").alias("from_bank"), F.col("account").alias("from_account"), "sec", *[F.col(n).alias(f"s_{n}") for n in numbers])
    receiver = past.select(F.col("bank").alias("to_bank"), F.col("account").alias("to_account"), "sec", *[F.col(n).alias(f"r_{n}") for n in numbers])
    # Both sides of these joins have one row per key on the right; the pair's rows are joined first, on the grid.
    grid = pairs.select(*PAIR, "sec", "pair_prior")
    grid = grid.join(sender, ["from_bank", "from_account", "sec"]).join(receiver, ["to_bank", "to_account", "sec"])
    joined = rows.join(grid, [*PAIR, "sec"])
    made = features(F.col("paid").cast("double"), F.col("received").cast("double"), windows)
    return joined.select(*rows.columns, *[made[n].alias(n) for n in (names or feature_names(windows))])


def next_state(rows: DataFrame, windows: dict[str, int] = WINDOWS, state: State | None = None) -> State:
    """The state after ``rows``: seconds no later window can reach are folded into the archive."""
    _check(windows)
    last = rows.agg(F.max("sec")).first()[0]
    if last is None:
        return state
    if state is not None and rows.agg(F.min("sec")).first()[0] <= state.last:
        raise ValueError("batches must be strictly after the last one")
    cutoff = last - max(windows.values())
    pairs = pair_grid(rows, state)
    grid = account_grid(pairs)
    counts = pairs.groupBy(*PAIR).agg(F.sum("n").alias("prior"))
    if state is not None:
        counts = counts.unionByName(state.pairs).groupBy(*PAIR).agg(F.sum("prior").alias("prior"))
        grid = grid.unionByName(state.recent)
    old = grid.where(F.col("sec") <= cutoff)
    out_sec, in_sec = F.when(F.col("out_n") > 0, F.col("sec")), F.when(F.col("in_n") > 0, F.col("sec"))
    folded = old.groupBy("bank", "account").agg(*[F.sum(c).alias(c) for c in SUMS], F.min(out_sec).alias("first_out"), F.max(out_sec).alias("last_out"), F.max(in_sec).alias("last_in"), F.count(out_sec).alias("out_times"))
    if state is not None:
        folded = folded.unionByName(state.archive).groupBy("bank", "account").agg(*[F.sum(c).alias(c) for c in SUMS], F.min("first_out").alias("first_out"), F.max("last_out").alias("last_out"), F.max("last_in").alias("last_in"), F.sum("out_times").alias("out_times"))
    return State(counts, folded, grid.where(F.col("sec") > cutoff), int(last))
