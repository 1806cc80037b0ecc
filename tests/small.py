"""Literal inputs with one row per case."""

from offerscope.sources import schemas

OFFERS = [
    ("b", "bogo", 10.0, 5.0, 10.0, ["email", "mobile"]),
    ("d", "discount", 20.0, 7.0, 3.0, ["email", "web"]),
    ("i", "informational", 0.0, 4.0, 0.0, ["email", "social"]),
]

PROFILE = [
    ("c1", 33, " m ", 50000.0, "20170215"),
    ("c2", 118, None, None, "20180101"),
    ("c3", 64, "f", 80000.0, "not a date"),
    ("c4", 20, "x", 40000.0, None),
]


def sent(customer, offer, t):
    return (customer, "offer received", t, (offer, None, None, None))


def seen(customer, offer, t):
    return (customer, "offer viewed", t, (None, offer, None, None))


def done(customer, offer, t, reward=10.0):
    return (customer, "offer completed", t, (offer, None, None, reward))


def paid(customer, t, amount=1.0):
    return (customer, "transaction", t, (None, None, amount, None))


def offers(spark):
    return spark.createDataFrame(OFFERS, schemas.OFFERS)


def profile(spark, rows=PROFILE):
    return spark.createDataFrame(rows, schemas.PROFILE)


def transactions(spark, rows):
    return spark.createDataFrame(rows, schemas.TRANSACTIONS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
