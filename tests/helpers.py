"""Ledgers for tests."""

import numpy as np
import pandas as pd

DATA = "/root/testdata"


def make_ledger(rows=3000, days=12, accounts=40, seed=0, rate=1.1) -> pd.DataFrame:
    """Payments with ties in time, favourite receivers and two currencies; engine names."""
    r = np.random.default_rng(seed)
    start = np.datetime64("2025-01-01T00:00")
    ts = np.sort(start + r.integers(0, days * 1440, rows).astype("timedelta64[m]"))
    sender = r.integers(0, accounts, rows)
    favourite = (sender * 7 + r.integers(1, 4, rows)) % accounts
    receiver = np.where(r.random(rows) < 0.6, favourite, r.integers(0, accounts, rows))
    pay = np.where(r.random(rows) < 0.3, "Euro", "US Dollar")
    same = r.random(rows) < 0.8
    got = np.where(same, pay, np.where(pay == "Euro", "US Dollar", "Euro"))
    paid = np.round(np.exp(r.normal(6, 2, rows)), 2)
    worth = {"Euro": rate, "US Dollar": 1.0}
    factor = np.array([worth[a] / worth[b] for a, b in zip(pay, got)])
    return pd.DataFrame(
        {
            "ts": ts.astype("datetime64[us]"),
            "from_bank": [f"{a % 3 + 1:03d}" for a in sender],
            "from_account": [f"{a:06d}" for a in sender],
            "to_bank": [f"{a % 3 + 1:03d}" for a in receiver],
            "to_account": [f"{a:06d}" for a in receiver],
            "amount_received": np.round(paid * factor, 2),
            "receiving_currency": got,
            "amount_paid": paid,
            "payment_currency": pay,
            "payment_format": r.choice(["ACH", "Cheque", "Wire"], rows),
            "label": (r.random(rows) < 0.05).astype("int8"),
        }
    )


def to_spark(spark, pdf: pd.DataFrame):
    from strictpast.schema import LEDGER

    rows = list(pdf.itertuples(index=False, name=None))
    rows = [(r[0].to_pydatetime(), *r[1:5], float(r[5]), r[6], float(r[7]), r[8], r[9], int(r[10])) for r in rows]
    return spark.createDataFrame(rows, LEDGER)
