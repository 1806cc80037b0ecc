"""The three raw inputs derived from the star-schema test tables.

One text serves both engines; only the engine-specific expressions differ.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from offerscope.sources.files import RawTables

_CHANNEL_ITEMS = """CASE WHEN true THEN 'email' END, CASE WHEN k <> 9 THEN 'mobile' END,
    CASE WHEN k NOT IN (2, 5) THEN 'web' END,
    CASE WHEN k IN (0, 2, 3, 6, 7, 8) THEN 'social' END"""

_OFFERS = """
SELECT 'offer_' || CAST(k AS STRING) AS id,
  CASE WHEN k % 5 = 2 THEN 'informational' WHEN k % 2 = 0 THEN 'bogo' ELSE 'discount' END AS offer_type,
  CAST(3 + size % 8 AS DOUBLE) AS duration,
  CAST(CASE WHEN k % 5 = 2 THEN 0 ELSE 5 + 5 * (k % 4) END AS DOUBLE) AS min_value,
  CAST(CASE WHEN k % 5 = 2 THEN 0 WHEN k % 2 = 0 THEN 5 + 5 * (k % 4) ELSE 2 + k % 4 END AS DOUBLE) AS discount_value,
  <channels> AS channels
FROM (SELECT p_partkey % 10 AS k, sum(p_size) AS size FROM <part> GROUP BY p_partkey % 10) AS p
"""

_PROFILE = """
SELECT CAST(c_custkey AS STRING) AS id,
  CAST(CASE WHEN c_custkey % 8 = 3 THEN 118 ELSE 18 + c_custkey % 70 END AS INT) AS age,
  CASE WHEN c_custkey % 8 = 3 THEN NULL WHEN c_custkey % 37 = 0 THEN ' o '
    WHEN c_custkey % 5 < 3 THEN 'M' ELSE 'f' END AS gender,
  CASE WHEN c_custkey % 8 = 3 THEN NULL ELSE CAST(30000 + 500 * (c_custkey % 180) AS DOUBLE) END AS credit_card_limit,
  r.d AS registered_on
FROM <customer> LEFT JOIN (
  SELECT o_custkey, CAST(year(min(o_orderdate)) * 10000 + month(min(o_orderdate)) * 100
    + day(min(o_orderdate)) AS STRING) AS d
  FROM <orders> GROUP BY o_custkey) r ON r.o_custkey = c_custkey
"""

_TRANSACTIONS = """
WITH e AS (
  SELECT event_id, CAST(user_id AS STRING) AS account_id, event_type, value AS v,
    'offer_' || CAST(<k> % 10 AS STRING) AS oid, <t_us> AS raw_us
  FROM <events>),
x AS (
  SELECT e.*, o.offer_type, o.discount_value,
    CASE WHEN event_type <> 'signup' THEN raw_us
      ELSE 86400000000 * CASE WHEN raw_us >= 24 * 86400000000 THEN 24 WHEN raw_us >= 21 * 86400000000 THEN 21
        WHEN raw_us >= 17 * 86400000000 THEN 17 WHEN raw_us >= 14 * 86400000000 THEN 14
        WHEN raw_us >= 7 * 86400000000 THEN 7 ELSE 0 END END AS t_us
  FROM e LEFT JOIN <offers> o ON o.id = e.oid)
SELECT account_id,
  CASE event_type WHEN 'signup' THEN 'offer received' WHEN 'view' THEN 'offer viewed'
    WHEN 'click' THEN CASE WHEN offer_type = 'informational' THEN 'offer clicked' ELSE 'offer completed' END
    WHEN 'purchase' THEN 'transaction' ELSE event_type END AS event,
  t_us / CAST(86400000000 AS DOUBLE) AS time_since_test_start,
  <value>
FROM x
"""

_VALUE_FIELDS = {
    "offer_id": "CASE WHEN event_type <> 'purchase' AND event_id % 2 = 0 THEN oid END",
    "offer id": "CASE WHEN event_type <> 'purchase' AND event_id % 2 = 1 THEN oid END",
    "amount": "CASE WHEN event_type = 'purchase' THEN v END",
    "reward": "CASE WHEN event_type = 'click' THEN discount_value END",
}


def _fill(text: str, **parts: str) -> str:
    for name, part in parts.items():
        text = text.replace(f"<{name}>", part)
    return text


TABLES = ("part", "customer", "orders", "events")


def input_state(spark: SparkSession, sf_dir: str) -> tuple:
    """Size and time of the input files, to tell whether they are still the same."""
    state = []
    for name in TABLES:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in sorted(system.listStatus(path), key=lambda s: s.getPath().toString()):
            state.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(state)


def raw_tables(spark: SparkSession, sf_dir: str) -> RawTables:
    """Offers, profile and transactions read from the parquet files in ``sf_dir``."""
    source = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}
    offers = spark.sql(
        _fill(_OFFERS, channels=f"array_compact(array({_CHANNEL_ITEMS}))", part="{part}"), part=source["part"]
    )
    profile = spark.sql(
        _fill(_PROFILE, customer="{customer}", orders="{orders}"),
        customer=source["customer"],
        orders=source["orders"],
    )
    nested = ", ".join(f"'{name}', {text}" for name, text in _VALUE_FIELDS.items())
    transactions = spark.sql(
        _fill(
            _TRANSACTIONS,
            k="from_json(props, 'k INT').k",
            t_us="timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)",
            value=f"named_struct({nested}) AS value",
            events="{events}",
            offers="{offers}",
        ),
        events=source["events"],
        offers=offers,
    )
    return RawTables(offers, profile, transactions)


def duckdb_ctes() -> list[tuple[str, str]]:
    """The same three inputs as (name, SELECT) pairs for DuckDB."""
    flat = ", ".join(f'{text} AS "{name}"' for name, text in _VALUE_FIELDS.items())
    return [
        (
            "offers",
            _fill(_OFFERS, channels=f"list_filter([{_CHANNEL_ITEMS}], lambda c: c IS NOT NULL)", part="part"),
        ),
        ("raw_profile", _fill(_PROFILE, customer="customer", orders="orders")),
        (
            "raw_transactions",
            _fill(
                _TRANSACTIONS,
                k="CAST(json_extract(props, '$.k') AS INT)",
                t_us="(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))",
                value=flat,
                events="events",
                offers="offers",
            ),
        ),
    ]
