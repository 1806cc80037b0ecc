"""Declared shapes of the three raw inputs.

Declared rather than inferred: no extra pass over the files, and both spellings
of the offer key exist even in a file that uses only one of them.
"""

from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

OFFERS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("offer_type", T.StringType()),
        T.StructField("min_value", T.DoubleType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("discount_value", T.DoubleType()),
        T.StructField("channels", T.ArrayType(T.StringType())),
    ]
)

PROFILE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("gender", T.StringType()),
        T.StructField("credit_card_limit", T.DoubleType()),
        T.StructField("registered_on", T.StringType()),
    ]
)

TRANSACTIONS = T.StructType(
    [
        T.StructField("account_id", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("time_since_test_start", T.DoubleType()),
        T.StructField(
            "value",
            T.StructType(
                [
                    T.StructField("offer_id", T.StringType()),
                    T.StructField("offer id", T.StringType()),
                    T.StructField("amount", T.DoubleType()),
                    T.StructField("reward", T.DoubleType()),
                ]
            ),
        ),
    ]
)
