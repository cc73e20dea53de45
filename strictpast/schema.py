"""The ledger contract."""

from pyspark.sql import types as T

#: Source header names, in order; the engine's own name for each; payment formats.
RAW_TO_OWN = {
    "Timestamp": "ts",
    "From Bank": "from_bank",
    "Account": "from_account",
    "To Bank": "to_bank",
    "Account.1": "to_account",
    "Amount Received": "amount_received",
    "Receiving Currency": "receiving_currency",
    "Amount Paid": "amount_paid",
    "Payment Currency": "payment_currency",
    "Payment Format": "payment_format",
    "Is Laundering": "label",
}
PAYMENT_FORMATS = ("ACH", "Bitcoin", "Cash", "Cheque", "Credit Card", "Reinvestment", "Wire")
ANCHOR_CURRENCY = "US Dollar"

IDENTIFIERS = ("from_bank", "from_account", "to_bank", "to_account", "receiving_currency", "payment_currency", "payment_format")
AMOUNTS = ("amount_received", "amount_paid")
COLUMNS = tuple(RAW_TO_OWN.values())

LEDGER = T.StructType(
    [T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType() if c in AMOUNTS else T.ByteType() if c == "label" else T.StringType()) for c in COLUMNS[1:]]
)
SENDER, RECEIVER = ("from_bank", "from_account"), ("to_bank", "to_account")
