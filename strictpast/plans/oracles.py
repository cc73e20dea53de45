"""DuckDB definitions that the queries are held against. Written from the semantics, over raw rows, without grids."""

from __future__ import annotations

from strictpast.plans.adapters import EVENT_SQL, ORDER_SQL

LEDGERS = {"order": ORDER_SQL, "event": EVENT_SQL}


def with_ledger(kind: str, body: str) -> str:
    return f"WITH led AS MATERIALIZED ({LEDGERS[kind]}) {body}"


def history_sql(kind: str, windows: dict[str, int], names: list[str], keys: list[str], where: str = "true", digits: int = 6) -> str:
    def l1(x: str) -> str:
        return f"ln(1 + ({x})::DOUBLE)"

    def ratio(a: str, b: str, other: str) -> str:
        return f"CASE WHEN ({b}) > 0 THEN ln(1 + least(({a})::DOUBLE / ({b})::DOUBLE, 1e6)) ELSE {other} END"

    f = {
        "sender_prev_tx_log": l1("s.out_n"),
        "receiver_prev_tx_log": l1("r.in_n"),
        "pair_prev_tx_log": l1("n.pair_prior"),
        "sender_unique_receivers_log": l1("s.new_o"),
        "receiver_unique_senders_log": l1("r.new_i"),
        "sender_prior_interbank_ratio": "CASE WHEN s.out_n > 0 THEN s.inter::DOUBLE / s.out_n ELSE 0 END",
        "sender_minutes_since_prev_log": f"CASE WHEN s.last_o IS NULL THEN -1 ELSE {l1('(n.sec - s.last_o) / 60.0::DOUBLE')} END",
        "receiver_minutes_since_prev_log": f"CASE WHEN r.last_i IS NULL THEN -1 ELSE {l1('(n.sec - r.last_i) / 60.0::DOUBLE')} END",
        "sender_prior_avg_minutes_log": f"CASE WHEN s.times >= 2 THEN {l1('(s.last_o - s.first_o)::DOUBLE / (s.times - 1) / 60')} ELSE -1 END",
        "amount_to_sender_prior_mean_log": ratio("n.paid", "s.paid::DOUBLE / greatest(s.out_n, 1)", "0"),
        "amount_to_receiver_prior_mean_log": ratio("n.received", "r.received::DOUBLE / greatest(r.in_n, 1)", "0"),
    }
    frames, sums = "", ""
    for i, (w, size) in enumerate(windows.items()):
        frames += f", f{i} AS (PARTITION BY bank, account ORDER BY sec RANGE BETWEEN {size - 1} PRECEDING AND 1 PRECEDING)"
        sums += "".join(f", coalesce(sum({c}) OVER f{i}, 0) AS {c}_{i}" for c in ("o", "i", "paid", "received", "new_o", "new_i"))
        f |= {
            f"sender_tx_{w}_log": l1(f"s.o_{i}"),
            f"sender_amount_{w}_log": l1(f"s.paid_{i}"),
            f"receiver_tx_{w}_log": l1(f"r.i_{i}"),
            f"receiver_amount_{w}_log": l1(f"r.received_{i}"),
            f"sender_new_receivers_{w}_log": l1(f"s.new_o_{i}"),
            f"receiver_new_senders_{w}_log": l1(f"r.new_i_{i}"),
            f"sender_inflow_{w}_log": l1(f"s.received_{i}"),
            f"sender_outflow_to_inflow_{w}_log": ratio(f"s.paid_{i} + n.paid", f"s.received_{i}", "-1"),
        }
    out = ", ".join("CAST(n.pair_prior = 0 AS INTEGER) AS is_new_pair" if x == "is_new_pair" else f"round(({f[x]})::DOUBLE, {digits}) AS {x}" for x in names)
    pair = "from_bank, from_account, to_bank, to_account"
    return with_ledger(
        kind,
        f""", x AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM led),
n AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY {pair} ORDER BY sec RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pair_prior,
  CAST(row_number() OVER (PARTITION BY {pair} ORDER BY sec, rid) = 1 AS BIGINT) AS newp FROM x),
roles AS (SELECT rid, from_bank AS bank, from_account AS account, sec, 1 AS o, 0 AS i, paid, 0 AS received, CAST(from_bank <> to_bank AS BIGINT) AS inter, newp AS new_o, 0 AS new_i,
    CAST(row_number() OVER (PARTITION BY from_bank, from_account, sec ORDER BY rid) = 1 AS BIGINT) AS firsts, sec AS osec, NULL::BIGINT AS isec FROM n
  UNION ALL SELECT rid, to_bank, to_account, sec, 0, 1, 0, received, 0, 0, newp, 0, NULL, sec FROM n),
w AS MATERIALIZED (SELECT rid, o, coalesce(sum(o) OVER p, 0) AS out_n, coalesce(sum(i) OVER p, 0) AS in_n, coalesce(sum(paid) OVER p, 0) AS paid, coalesce(sum(received) OVER p, 0) AS received,
    coalesce(sum(inter) OVER p, 0) AS inter, coalesce(sum(new_o) OVER p, 0) AS new_o, coalesce(sum(new_i) OVER p, 0) AS new_i, coalesce(sum(firsts) OVER p, 0) AS times,
    max(osec) OVER p AS last_o, min(osec) OVER p AS first_o, max(isec) OVER p AS last_i{sums}
  FROM roles WINDOW p AS (PARTITION BY bank, account ORDER BY sec RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING){frames})
SELECT {", ".join("n." + k for k in keys)}, {out} FROM n JOIN w s ON s.rid = n.rid AND s.o = 1 JOIN w r ON r.rid = n.rid AND r.o = 0 WHERE {where}""",
    )


def ote_sql(kind: str, specs: list[tuple[str, ...]], smoothing: tuple[float, ...], keys: list[str], weight: str = "1", digits: int = 6) -> str:
    frame = "ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    parts, out = "", []
    for k, spec in enumerate(specs):
        by = f"(PARTITION BY {', '.join(spec)} {frame})"
        parts += f", coalesce(sum(w * label) OVER {by}, 0)::DOUBLE AS s{k}, coalesce(sum(w) OVER {by}, 0)::DOUBLE AS n{k}"
        name = "__".join(spec)
        out += [f"round((s{k} + {a:g} * prior) / (n{k} + {a:g}), {digits}) AS {name}__ote_{a:g}" for a in smoothing] + [f"round(ln(1 + n{k}), {digits}) AS {name}__hist_log_count"]
    return with_ledger(
        kind,
        f""", r AS (SELECT *, {weight} AS w, epoch_us(ts) AS us FROM led),
g AS (SELECT us, coalesce(sum(s) OVER ({frame}), 0)::DOUBLE AS gs, coalesce(sum(n) OVER ({frame}), 0)::DOUBLE AS gn FROM (SELECT us, sum(w * label) AS s, sum(w) AS n FROM r GROUP BY us)),
e AS (SELECT r.*, CASE WHEN gn > 0 THEN gs / gn ELSE 0 END AS prior{parts} FROM r JOIN g USING (us))
SELECT {", ".join([*keys, *out])} FROM e""",
    )


def frozen_ote_sql(kind: str, specs: list[tuple[str, ...]], smoothing: tuple[float, ...], keys: list[str], cut: int, digits: int = 6) -> str:
    joins, out = "", []
    for k, spec in enumerate(specs):
        on = " AND ".join(f"z.{c} = t{k}.{c}" for c in spec)
        joins += f" LEFT JOIN (SELECT {', '.join(spec)}, sum(label)::DOUBLE AS s, count(*)::DOUBLE AS n FROM tr GROUP BY ALL) t{k} ON {on}"
        name = "__".join(spec)
        out += [f"round((coalesce(t{k}.s, 0) + {a:g} * prior) / (coalesce(t{k}.n, 0) + {a:g}), {digits}) AS {name}__ote_{a:g}" for a in smoothing] + [f"round(ln(1 + coalesce(t{k}.n, 0)), {digits}) AS {name}__hist_log_count"]
    return with_ledger(
        kind,
        f""", tr AS (SELECT * FROM led WHERE sec < {cut}), p AS (SELECT avg(label::DOUBLE) AS prior FROM tr), z AS (SELECT led.*, p.prior FROM led, p WHERE sec >= {cut})
SELECT {", ".join(["z." + k for k in keys] + out)} FROM z{joins}""",
    )


#: (score, n, pos, run_n, run_pos) per distinct score, from the highest down.
CURVE = "c AS (SELECT score, n, pos, sum(n) OVER (ORDER BY score DESC) AS run_n, sum(pos) OVER (ORDER BY score DESC) AS run_pos FROM (SELECT score, count(*) AS n, sum(label) AS pos FROM led GROUP BY score))"

SUMMARY = """count(*) AS rows, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 1 AND p) AS tp, count(*) FILTER (WHERE label = 0 AND p) AS fp,
count(*) FILTER (WHERE label = 1 AND NOT p) AS fn, count(*) FILTER (WHERE p) AS alerts,
round(CASE WHEN count(*) FILTER (WHERE p) > 0 THEN count(*) FILTER (WHERE label = 1 AND p)::DOUBLE / count(*) FILTER (WHERE p) END, 9) AS precision,
round(CASE WHEN count(*) FILTER (WHERE label = 1) > 0 THEN count(*) FILTER (WHERE label = 1 AND p)::DOUBLE / count(*) FILTER (WHERE label = 1) END, 9) AS recall,
round(count(*) FILTER (WHERE p)::DOUBLE / count(*), 9) AS alert_rate"""


def drift_sql(features: list[str], cut: int, bins: int = 10, limit: float = 0.2) -> str:
    one = []
    for f in features:
        one.append(f"""SELECT '{f}' AS feature, (sec < {cut}) AS old, {f}::DOUBLE AS x FROM led""")
    shares = "[" + ", ".join(str(i / bins) for i in range(bins + 1)) + "]"
    return with_ledger(
        "order",
        f""", long AS ({" UNION ALL ".join(one)}),
q AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, {shares}))) AS edges FROM long WHERE old GROUP BY feature),
slots AS (SELECT feature, unnest(range(0, len(edges) + 1)) AS bin FROM q UNION ALL SELECT feature, -1 FROM q),
cnt AS (SELECT long.feature, CASE WHEN x IS NULL THEN -1 ELSE len(list_filter(edges, lambda e: e <= x)) END AS bin, count(*) FILTER (WHERE old) AS a, count(*) FILTER (WHERE NOT old) AS b FROM long JOIN q USING (feature) GROUP BY ALL),
f AS (SELECT slots.feature, slots.bin, coalesce(a, 0) + 0.5::DOUBLE AS a, coalesce(b, 0) + 0.5::DOUBLE AS b FROM slots LEFT JOIN cnt ON slots.feature = cnt.feature AND slots.bin = cnt.bin),
s AS (SELECT feature, bin, a / sum(a) OVER (PARTITION BY feature) AS p, b / sum(b) OVER (PARTITION BY feature) AS q FROM f)
SELECT feature, round(sum((q - p) * ln(q / p)), 6) AS psi, sum((q - p) * ln(q / p)) >= {limit} AS investigate FROM s GROUP BY feature""",
    )


def rates_sql(anchor: str, free: list[str], digits: int = 6) -> str:
    """Weighted least squares over pair medians: the normal equations, summed in one row and eliminated step by step."""
    size = range(len(free))

    def touches(i: int) -> str:
        return f"(pay = '{free[i]}' OR got = '{free[i]}')"

    cells = [f"coalesce(sum(CASE WHEN {touches(i)} AND {touches(j)} THEN {'n' if i == j else '-n'} END), 0)::DOUBLE AS a{i}_{j}" for i in size for j in size]
    cells += [f"coalesce(sum(CASE WHEN pay = '{c}' THEN n * m WHEN got = '{c}' THEN -n * m END), 0)::DOUBLE AS b{i}" for i, c in enumerate(free)]
    steps = [f"e0 AS (SELECT {', '.join(cells)} FROM med)"]
    for k in size:  # after step k no equation but the k-th holds unknown k
        out = [f"a{i}_{j} - a{i}_{k} / a{k}_{k} * a{k}_{j} AS a{i}_{j}" if i != k else f"a{i}_{j}" for i in size for j in size]
        out += [f"b{i} - a{i}_{k} / a{k}_{k} * b{k} AS b{i}" if i != k else f"b{i}" for i in size]
        steps.append(f"e{k + 1} AS (SELECT {', '.join(out)} FROM e{k})")
    rows = " UNION ALL ".join(f"SELECT '{c}' AS currency, round(b{i} / a{i}_{i}, {digits}) AS log_rate FROM e{len(free)}" for i, c in enumerate(free))
    medians = "SELECT payment_currency AS pay, receiving_currency AS got, median(ln(received::DOUBLE / paid::DOUBLE)) AS m, count(*) AS n FROM led WHERE payment_currency <> receiving_currency AND paid > 0 AND received > 0 GROUP BY ALL"
    return f", med AS ({medians}), {', '.join(steps)} {rows} UNION ALL SELECT '{anchor}', 0.0::DOUBLE"
