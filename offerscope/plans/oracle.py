"""The same queries as plain SQL for a second engine.

Written in join form and from the definitions, not from the Spark plans: sends
are joined to the events of their window, history to all earlier events, scores
come from rows times offers.
"""

from __future__ import annotations

from offerscope.functions.columns import AGE_BANDS, CHANNELS, GENDERS, SEND_ROUNDS
from offerscope.operators.policies import PRIOR_PRECISIONS, SEED
from offerscope.sources.fixtures import duckdb_ctes

NUMERIC = (
    "customer_age",
    "customer_credit_limit",
    "customer_incomplete_profile",
    "tx_count_7d",
    "tx_count_28d",
    "transaction_count_before",
    "total_spend_before",
    "avg_ticket_before",
    "offers_received_count_before",
    "offers_viewed_count_before",
    "offers_completed_count_before",
    "days_since_last_tx",
    "days_since_last_offer_view",
    "view_rate_before",
    "completion_rate_before",
    "customer_tenure_days",
)
FEATURES = ("bias", *NUMERIC, *[f"gender_{g}" for g in GENDERS])


def r(expression: str, name: str | None = None, digits: int = 6) -> str:
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0 AS {name or expression.split('.')[-1]}"


def rs(names: str) -> str:
    return ", ".join(r(n.strip()) for n in names.split(","))


def _values(rows: list[str], columns: str, name: str) -> str:
    return f"(VALUES {', '.join(rows)}) AS {name}({columns})"


AGE_GROUP = """CASE WHEN age IS NULL THEN 'Unknown' WHEN age < 25 THEN '18-24' WHEN age < 35 THEN '25-34'
  WHEN age < 45 THEN '35-44' WHEN age < 55 THEN '45-54' WHEN age < 65 THEN '55-64' ELSE '65+' END"""
COMPLETABLE = "offer_type IN ('bogo', 'discount')"
WORD = "CAST(('0x' || substr(md5({key}), {start}, 8)) AS BIGINT)"
GENDER_LIST = _values([f"({i}, '{g}')" for i, g in enumerate(GENDERS)], "position, gender", "g")
AGE_LIST = _values([f"({i}, '{b}')" for i, b in enumerate(AGE_BANDS)], "position, age_group", "b")


def _noise(seed: int, rows: str) -> str:
    """Two mixed 32-bit words for every row of ``rows`` and offer."""
    salted = f"concat_ws('|', a.offer_id, '{seed}')"
    noise = f"""SELECT opp_id, a.offer_id, {', '.join(
        f"xor({WORD.format(key='opp_id', start=at)}, {WORD.format(key=salted, start=at)})::UBIGINT AS {h}"
        for h, at in (('h1', 1), ('h2', 9)))} FROM {rows} CROSS JOIN worth a"""
    for bits, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        noise = f"""SELECT opp_id, offer_id, {', '.join(
            f"(xor({h}, {h} >> {bits}) * {factor}::UBIGINT) % 4294967296::UBIGINT AS {h}" for h in ('h1', 'h2'))} FROM ({noise})"""
    return noise


SIGMOID = "1 / (1 + exp(-greatest(-35, least(35, {z}))))"
#: What one draw adds to the logit m.x of a row x with the words h1, h2.
DRAW = """sqrt(-2 * ln((h1 + 0.5) / 4294967296.0)) * cos(2 * pi() * (h2 + 0.5) / 4294967296.0)
  * sqrt(list_dot_product(list_transform(x, lambda v: v * v), list_transform(q, lambda v: CAST(1 AS DOUBLE) / v)))"""


def _learning(prefix: str, precisions: str, all_rows: bool = False) -> list[tuple[str, str]]:
    """Diagonal steps carried over six rounds: state before each round, choices, kept rows, three steps.

    With ``all_rows`` every row of a round is learnt from, whatever was chosen.
    """
    state = f"""SELECT prec, offer_id, value, j, CAST(0 AS DOUBLE) AS m, prec AS q FROM worth
      CROSS JOIN (SELECT CAST(unnest([{precisions}]) AS DOUBLE) AS prec) CROSS JOIN generate_series(1, {len(FEATURES)}) t(j)"""
    found = [(f"{prefix}s0", state)]
    for k in range(1, 7):
        before = f"{prefix}s{k - 1}"
        rows = f"(SELECT * FROM design JOIN rounds USING (round_day) WHERE k = {k})"
        arms = f"(SELECT prec, offer_id, value, list(m ORDER BY j) AS m, list(q ORDER BY j) AS q FROM {before} GROUP BY ALL)"
        found += [
            (
                f"{prefix}drawn{k}",
                f"""SELECT prec, opp_id, logged, offer_id, {SIGMOID.format(z=f"list_dot_product(m, x) + {DRAW}")} * value AS score,
                  {SIGMOID.format(z="list_dot_product(m, x)")} * value AS map_score
                FROM (SELECT opp_id, offer_id AS logged, x FROM {rows}) JOIN ({_noise(SEED + k - 1, rows)}) z USING (opp_id)
                JOIN {arms} a USING (offer_id)""",
            ),
            (
                f"{prefix}picked{k}",
                f"""SELECT prec, opp_id, any_value(logged) AS logged,
                  first(offer_id ORDER BY score DESC, offer_id) AS chosen,
                  first(offer_id ORDER BY map_score DESC, offer_id) AS greedy FROM {prefix}drawn{k} GROUP BY prec, opp_id""",
            ),
            (
                f"{prefix}kept{k}",
                f"SELECT prec, offer_id, reward, value, x FROM {rows} r CROSS JOIN (SELECT DISTINCT prec FROM {before})"
                if all_rows
                else f"""SELECT prec, r.offer_id, reward, r.value, x FROM {rows} r
                  JOIN {prefix}picked{k} USING (opp_id) WHERE chosen = r.offer_id""",
            ),
            (f"{prefix}w{k}_0", f"SELECT *, m AS w FROM {before}"),
        ]
        for step in range(1, 5):
            at = f"{prefix}w{k}_{step - 1}"
            sums = f"""SELECT prec, offer_id, j, sum((p - reward) * v) AS g, sum(v * v * p * (1 - p)) AS h FROM (
                SELECT prec, offer_id, reward, p, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM (
                  SELECT prec, offer_id, reward, x, {SIGMOID.format(z="list_dot_product(w, x)")} AS p FROM {prefix}kept{k}
                  JOIN (SELECT prec, offer_id, list(w ORDER BY j) AS w FROM {at} GROUP BY ALL) USING (prec, offer_id)))
                GROUP BY prec, offer_id, j"""
            if step < 4:
                moved = "w - greatest(-2, least(2, (q * (w - m) + coalesce(g, 0)) / (q + coalesce(h, 0)))) AS w"
                found.append(
                    (f"{prefix}w{k}_{step}", f"SELECT prec, offer_id, value, j, m, q, {moved} FROM {at} LEFT JOIN ({sums}) USING (prec, offer_id, j)")
                )
            else:
                found.append(
                    (
                        f"{prefix}s{k}",
                        f"""SELECT prec, offer_id, value, j, w AS m, q + coalesce(h, 0) AS q FROM {at}
                          LEFT JOIN ({sums}) USING (prec, offer_id, j)""",
                    )
                )
    each = " UNION ALL ".join(f"SELECT {k} AS k, * FROM {prefix}kept{k}" for k in range(1, 7))
    found.append((f"{prefix}kept", each))
    found.append((f"{prefix}picked", " UNION ALL ".join(f"SELECT * FROM {prefix}picked{k}" for k in range(1, 7))))
    return found


def _ctes(diagonal: bool = False) -> list[tuple[str, str]]:
    """All derived tables, in order; each query takes what it needs.

    With ``diagonal`` arms, weights and choices are those of the learning replay by diagonal steps.
    """
    if diagonal:
        found = dict(_ctes())
        names = list(found)
        found["step"] = "SELECT offer_id, j, m FROM d_s6"
        found["arms"] = "SELECT offer_id, value, list(m ORDER BY j) AS m, list(q ORDER BY j) AS q FROM d_s6 GROUP BY ALL"
        found["choices"] = (
            found["choices"]
            .replace("SELECT opp_id, 'greedy', offer_id FROM ranked WHERE offer_rank = 1", "SELECT opp_id, 'greedy', greedy FROM d_picked")
            .replace("SELECT opp_id, 'thompson', offer_id FROM thompson", "SELECT opp_id, 'thompson', chosen FROM d_picked")
        )
        at = names.index("step")
        order = [*names[:at], *names[at:]]
        return [(n, found[n]) for n in order[:at]] + _rounds() + [(n, found[n]) for n in order[at:]]
    counts = "tx_count_7d tx_count_28d transaction_count_before total_spend_before avg_ticket_before".split()
    counts += [f"offers_{k}_count_before" for k in ("received", "viewed", "completed")]
    counts += ["view_rate_before", "completion_rate_before"]
    bought = "e.event = 'transaction'"
    means = ", ".join(f"avg({c}) AS mean_{c}, stddev_pop({c}) AS sd_{c}" for c in NUMERIC)
    z = {c: f"(c.{c} - s.mean_{c}) / coalesce(nullif(s.sd_{c}, 0), 1)" for c in NUMERIC}
    z_list = ", ".join(f"CAST({z[c]} AS DOUBLE)" for c in NUMERIC)
    onehot = ", ".join(f"CAST(customer_gender = '{g}' AS INT)::DOUBLE" for g in GENDERS)
    first = f"CASE WHEN {COMPLETABLE} AND completed = 1 THEN customer_id END"
    return [
        *duckdb_ctes(),
        (
            "profile",
            """SELECT id, CASE WHEN age <> 118 THEN age END AS age,
              CASE WHEN upper(trim(gender)) IN ('F', 'M', 'O') THEN upper(trim(gender)) ELSE 'Unknown' END AS gender,
              credit_card_limit, CAST(try_strptime(registered_on, '%Y%m%d') AS DATE) AS registered_on_date
            FROM raw_profile""",
        ),
        (
            "tx",
            """SELECT account_id, account_id AS customer_id, event, time_since_test_start AS t,
              coalesce(offer_id, "offer id") AS offer_id, amount, reward AS reward_amount FROM raw_transactions""",
        ),
        (
            "log",
            """SELECT tx.customer_id, event, t AS time_since_test_start, tx.offer_id, amount, reward_amount, age, gender,
              credit_card_limit, registered_on_date, offer_type, min_value, duration, discount_value, channels
            FROM tx LEFT JOIN profile ON profile.id = tx.customer_id LEFT JOIN offers ON offers.id = tx.offer_id""",
        ),
        (
            "sends",
            """SELECT s.*, md5(concat_ws('|', customer_id, s.offer_id,
                CAST(CAST(round(t_received * 86400e6) AS BIGINT) AS VARCHAR))) AS opp_id,
              offer_type, duration, min_value, discount_value, channels, t_received + duration AS t_expires,
              CAST(floor(t_received + 0.5) AS INT) AS round_day,
              age, gender, credit_card_limit, registered_on_date
            FROM (SELECT DISTINCT customer_id, offer_id, t AS t_received FROM tx WHERE event = 'offer received') s
            LEFT JOIN offers ON offers.id = s.offer_id LEFT JOIN profile ON profile.id = s.customer_id""",
        ),
        *[
            (
                name,
                f"""SELECT opp_id, min(t) AS {time} FROM sends s JOIN tx e ON e.event = '{event}'
                  AND e.customer_id = s.customer_id AND e.offer_id = s.offer_id
                  AND e.t BETWEEN t_received AND t_expires GROUP BY opp_id""",
            )
            for name, time, event in (
                ("views", "t_viewed", "offer viewed"),
                ("completions", "t_completed", "offer completed"),
            )
        ],
        *[
            (
                name,
                f"""SELECT opp_id, min(t) AS {time} FROM (
                  SELECT e.t, arg_max(opp_id, t_received) AS opp_id FROM sends s
                  JOIN (SELECT DISTINCT customer_id, offer_id, t FROM tx WHERE event = '{event}') e
                    ON e.customer_id = s.customer_id AND e.offer_id = s.offer_id AND e.t BETWEEN t_received AND t_expires
                  GROUP BY e.customer_id, e.offer_id, e.t) GROUP BY opp_id""",
            )
            for name, time, event in (
                ("last_views", "t_viewed", "offer viewed"),
                ("last_completions", "t_completed", "offer completed"),
            )
        ],
        (
            "followed_last",
            """SELECT DISTINCT opp_id FROM sends s JOIN last_views USING (opp_id) JOIN tx e ON e.event = 'transaction'
              AND e.customer_id = s.customer_id AND e.t BETWEEN t_viewed AND t_expires""",
        ),
        (
            "followed",
            """SELECT DISTINCT opp_id FROM sends s JOIN views USING (opp_id) JOIN tx e ON e.event = 'transaction'
              AND e.customer_id = s.customer_id AND e.t BETWEEN t_viewed AND t_expires""",
        ),
        (
            "opps",
            """SELECT s.*, t_viewed, t_completed, CAST(t_viewed IS NOT NULL AS INT) AS viewed,
              CAST(t_completed IS NOT NULL AS INT) AS completed,
              CASE WHEN offer_type = 'informational' THEN CAST(f.opp_id IS NOT NULL AS INT) END AS informational_success
            FROM sends s LEFT JOIN views USING (opp_id) LEFT JOIN completions USING (opp_id)
            LEFT JOIN followed f ON f.opp_id = s.opp_id""",
        ),
        (
            "base",
            """SELECT opp_id, customer_id, offer_id, offer_type, t_received, round_day, viewed, completed,
              informational_success,
              CASE WHEN offer_type = 'informational' THEN informational_success ELSE completed END AS reward,
              discount_value, min_value FROM opps""",
        ),
        (
            "past",
            f"""SELECT o.opp_id,
              count(*) FILTER ({bought} AND e.t >= o.t_received - 7) AS tx_count_7d,
              count(*) FILTER ({bought} AND e.t >= o.t_received - 28) AS tx_count_28d,
              count(*) FILTER ({bought}) AS transaction_count_before,
              sum(e.amount) FILTER ({bought}) AS total_spend_before,
              avg(e.amount) FILTER ({bought}) AS avg_ticket_before,
              count(*) FILTER (e.event = 'offer received') AS offers_received_count_before,
              count(*) FILTER (e.event = 'offer viewed') AS offers_viewed_count_before,
              count(*) FILTER (e.event = 'offer completed') AS offers_completed_count_before,
              any_value(o.t_received) - max(e.t) FILTER ({bought}) AS days_since_last_tx,
              any_value(o.t_received) - max(e.t) FILTER (e.event = 'offer viewed') AS days_since_last_offer_view
            FROM opps o JOIN tx e ON e.customer_id = o.customer_id AND e.t < o.t_received GROUP BY o.opp_id""",
        ),
        (
            "rates",
            """SELECT *,
              CASE WHEN offers_received_count_before > 0
                THEN offers_viewed_count_before / offers_received_count_before ELSE 0 END AS view_rate_before,
              CASE WHEN offers_received_count_before > 0
                THEN offers_completed_count_before / offers_received_count_before ELSE 0 END AS completion_rate_before
            FROM past""",
        ),
        (
            "tenure",
            """SELECT opp_id, CAST((SELECT max(registered_on_date) + 1 FROM profile
                WHERE id IN (SELECT customer_id FROM tx)) - registered_on_date AS DOUBLE) AS customer_tenure_days
            FROM opps""",
        ),
        (
            "medians",
            """SELECT quantile_disc(age, 0.5) AS age, quantile_disc(credit_card_limit, 0.5) AS credit_limit,
              quantile_disc(customer_tenure_days, 0.5) AS tenure FROM opps JOIN tenure USING (opp_id)""",
        ),
        (
            "contexts",
            f"""SELECT b.*, o.duration AS offer_duration_days,
              CASE WHEN o.min_value > 0 THEN o.discount_value / o.min_value ELSE 0 END AS offer_reward_ratio,
              {', '.join(f"CAST(list_contains(channels, '{c}') AS INT) AS channel_is_{c}" for c in CHANNELS)},
              CAST(coalesce(o.age, m.age) AS DOUBLE) AS customer_age, o.gender AS customer_gender,
              coalesce(o.credit_card_limit, m.credit_limit) AS customer_credit_limit,
              CAST(o.age IS NULL AS INT) AS customer_incomplete_profile,
              {', '.join(f'CAST(coalesce(p.{c}, 0) AS DOUBLE) AS {c}' for c in counts)},
              coalesce(p.days_since_last_tx, 30.0) AS days_since_last_tx,
              coalesce(p.days_since_last_offer_view, 30.0) AS days_since_last_offer_view,
              coalesce(t.customer_tenure_days, m.tenure) AS customer_tenure_days
            FROM base b JOIN opps o USING (opp_id) JOIN tenure t USING (opp_id)
            LEFT JOIN rates p USING (opp_id) CROSS JOIN medians m""",
        ),
        ("scale", f"SELECT {means} FROM contexts"),
        (
            "ticket",
            f"""SELECT avg(amount) AS avg_ticket FROM tx WHERE event = 'transaction'
              AND customer_id IN (SELECT {first} FROM opps WHERE {first} IS NOT NULL)""",
        ),
        (
            "worth",
            """SELECT id AS offer_id, offer_type, discount_value, avg_ticket - discount_value AS value
            FROM offers CROSS JOIN ticket""",
        ),
        (
            "design",
            f"""SELECT opp_id, customer_id, c.offer_id, round_day, reward, w.value,
              [CAST(1 AS DOUBLE), {z_list}, {onehot}] AS x
            FROM contexts c CROSS JOIN scale s JOIN worth w ON w.offer_id = c.offer_id""",
        ),
        (
            "flat",
            "SELECT opp_id, offer_id, reward, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM design",
        ),
        (
            "step",
            """SELECT offer_id, j, -greatest(-2, least(2, sum((0.5 - reward) * v) / (1 + sum(v * v) / 4))) AS m
            FROM flat GROUP BY offer_id, j""",
        ),
        ("means", "SELECT offer_id, list(m ORDER BY j) AS m FROM step GROUP BY offer_id"),
        (
            "curves",
            """SELECT opp_id, 1 / (1 + exp(-greatest(-35, least(35, list_dot_product(m, x))))) AS p
            FROM design JOIN means USING (offer_id)""",
        ),
        (
            "precisions",
            """SELECT offer_id, j, 1 + sum(v * v * p * (1 - p)) AS q FROM flat JOIN curves USING (opp_id)
            GROUP BY offer_id, j""",
        ),
        (
            "arms",
            """SELECT offer_id, value, m, q FROM worth JOIN means USING (offer_id)
            JOIN (SELECT offer_id, list(q ORDER BY j) AS q FROM precisions GROUP BY offer_id) USING (offer_id)""",
        ),
        (
            "scores",
            """SELECT *, p * value AS score FROM (
              SELECT opp_id, customer_id, round_day, d.offer_id AS logged, d.reward, a.offer_id, a.value,
                1 / (1 + exp(-greatest(-35, least(35, list_dot_product(m, x))))) AS p
              FROM design d CROSS JOIN arms a)""",
        ),
        (
            "ranked",
            "SELECT *, row_number() OVER (PARTITION BY opp_id ORDER BY score DESC, offer_id) AS offer_rank FROM scores",
        ),
        ("noise", _noise(SEED, "design")),
        (
            "drawn",
            """SELECT *, p * value AS score FROM (
              SELECT design.opp_id, a.offer_id, a.value, """
            + SIGMOID.format(z=f"list_dot_product(m, x) + {DRAW}")
            + """ AS p
              FROM design CROSS JOIN arms a JOIN noise z ON z.opp_id = design.opp_id AND z.offer_id = a.offer_id)""",
        ),
        (
            "thompson",
            """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY opp_id ORDER BY score DESC, offer_id) AS n
              FROM drawn) WHERE n = 1""",
        ),
        (
            "best_rate",
            """SELECT offer_id, avg(reward) AS reward_rate, count(*) AS n FROM contexts GROUP BY offer_id
            ORDER BY reward_rate DESC, offer_id LIMIT 1""",
        ),
        (
            "choices",
            f"""SELECT opp_id, 'random' AS policy, offer_id AS chosen FROM design
                JOIN (SELECT offer_id, row_number() OVER (ORDER BY offer_id) - 1 AS k,
                  count(*) OVER () AS n_offers FROM worth) i ON i.k =
                {WORD.format(key=f"concat_ws('|', opp_id, '{SEED}')", start=1)} % n_offers
              UNION ALL SELECT opp_id, 'fixed', b.offer_id FROM design CROSS JOIN best_rate b
              UNION ALL SELECT opp_id, 'greedy', offer_id FROM ranked WHERE offer_rank = 1
              UNION ALL SELECT opp_id, 'thompson', offer_id FROM thompson
              UNION ALL SELECT opp_id, 'logged', offer_id FROM design""".replace(
                "SELECT opp_id, 'random' AS policy, offer_id", "SELECT opp_id, 'random' AS policy, i.offer_id"
            ),
        ),
        (
            "replayed",
            """SELECT policy, count(*) AS n_total, count(*) FILTER (chosen = offer_id) AS n_kept,
              avg(CASE WHEN chosen = offer_id THEN 1 ELSE 0 END) AS kept_share,
              avg(reward) FILTER (chosen = offer_id) AS conversion_rate,
              avg(reward * value) FILTER (chosen = offer_id) AS value_per_contact
            FROM design JOIN choices USING (opp_id) GROUP BY policy""",
        ),
    ]


def _rounds() -> list[tuple[str, str]]:
    numbered = "SELECT round_day, row_number() OVER (ORDER BY round_day) AS k FROM (SELECT DISTINCT round_day FROM design)"
    return [
        ("rounds", numbered),
        *_learning("d_", "1.0"),
        *_learning("v_", ", ".join(map(str, PRIOR_PRECISIONS))),
        *_learning("o_", "1.0", all_rows=True),
    ]


#: Tables worth computing once inside a statement.
_MATERIALIZED = {"rounds", "tx", "sends", "opps", "contexts", "design", "arms", "scores", "ranked", "drawn", "noise", "choices", "flat"}


def _with(select: str, diagonal: bool = False) -> str:
    """Put in front of ``select`` exactly the tables it needs, directly or through others."""
    import re

    ctes = _ctes(diagonal)
    needed: set[str] = set()
    text = [select]
    for name, body in reversed(ctes):
        if any(re.search(rf"\b{name}\b", t) for t in text):
            needed.add(name)
            text.append(body)
    listed = ",\n".join(
        f"{name} AS {'MATERIALIZED ' if name in _MATERIALIZED or name[:2] in ('d_', 'v_', 'o_') else ''}({body})"
        for name, body in ctes
        if name in needed
    )
    return f"WITH {listed}\n{select}"


def _null_rows(table: str, label: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{label}' AS table_name, '{name}' AS column_name, count(*) AS n_rows, "
        f"count(*) FILTER (({test}) IS NULL) AS n_null, "
        f"{r(f'count(*) FILTER (({test}) IS NULL) / count(*)', 'null_share')} FROM {table}"
        for name, test in columns.items()
    )


def _long(table: str, columns, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {extra}'{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {table} WHERE {c} IS NOT NULL" for c in columns
    )


def _histogram(column: str) -> str:
    value = f"CAST({column} AS DOUBLE)"
    return f"""SELECT bin, {r('lo + bin * (hi - lo) / 30', 'bin_start')}, count(*) AS n FROM (
      SELECT CAST(least(floor(({value} - lo) / ((hi - lo) / 30)), 29) AS INT) AS bin, lo, hi
      FROM profile CROSS JOIN (SELECT CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi
        FROM profile) WHERE {column} IS NOT NULL) GROUP BY bin, lo, hi"""


def _statements() -> dict[str, str]:
    quartiles = ", ".join(r(f"quantile_cont(value, {q / 100})", f"q{q}") for q in (25, 50, 75))
    base = """opp_id, customer_id, offer_id, offer_type, round(t_received, 6) + 0.0 AS t_received, round_day, viewed, completed,
      informational_success, reward, discount_value, min_value"""
    channel_flags = ", ".join(f"CAST(list_contains(channels, '{c}') AS INT) AS channel_is_{c}" for c in CHANNELS)
    context_columns = (
        f"{base}, offer_duration_days, {r('offer_reward_ratio')}, "
        + ", ".join(f"channel_is_{c}" for c in CHANNELS)
        + ", customer_gender, "
        + ", ".join("customer_incomplete_profile" if c == "customer_incomplete_profile" else r(c) for c in NUMERIC)
    )
    pairs = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]]
    strength = """SELECT feature, max(abs(weight)) AS strength FROM weights WHERE feature <> 'bias'
      GROUP BY feature ORDER BY strength DESC, feature LIMIT 12"""
    feature_list = _values([f"({i + 1}, '{n}')" for i, n in enumerate(FEATURES)], "j, feature", "f")
    weights = f"(SELECT feature, offer_id, m AS weight FROM step JOIN {feature_list} USING (j))"
    summary = f"policy, n_total, n_kept, {rs('kept_share, conversion_rate, value_per_contact')}"
    seeded = f"md5(concat_ws('|', opp_id, '{SEED}'))"
    spend = """SELECT CAST(customer_id IN (SELECT customer_id FROM opps WHERE {c} AND completed = 1) AS INT)
      AS is_offer_user, amount FROM tx WHERE event = 'transaction'""".format(c=COMPLETABLE)
    age_names = {b: "age_" + b.lower().replace("-", "_").replace("+", "_up") for b in AGE_BANDS}
    heat = ", ".join(
        r(f"avg(completed) FILTER (age_group = '{band}')", name) for band, name in age_names.items()
    )
    kept = """SELECT policy, round_day, opp_id, reward, reward * value AS gain FROM design JOIN choices USING (opp_id)
      WHERE chosen = offer_id AND policy IN ('random', 'fixed')"""
    upto = "OVER (PARTITION BY policy ORDER BY round_day, opp_id ROWS UNBOUNDED PRECEDING)"
    example = lambda name, source, condition, order: (
        f"(SELECT '{name}' AS category, opp_id, offer_id AS recommended_offer, {rs('p')}, {r('score', 'expected_value')} "
        f"FROM {source} WHERE {condition} ORDER BY {order} LIMIT 1)"
    )
    top = """(SELECT c.*, k.offer_id AS best, k.offer_id, k.p, k.score, w.offer_type AS best_type
      FROM (SELECT * EXCLUDE (offer_id) FROM contexts) c
      JOIN ranked k ON k.opp_id = c.opp_id AND k.offer_rank = 1 JOIN worth w ON w.offer_id = k.offer_id)"""
    return {
        "sink_roundtrip": """SELECT count(*) AS n_stored, count(DISTINCT round_day) AS n_rounds,
          CAST(sum(completed) AS BIGINT) AS n_completed FROM opps""",
        "json_roundtrip": f"""SELECT 'offers' AS table_name, count(*) AS n, {r('sum(discount_value)', 'total')} FROM offers
          UNION ALL SELECT 'profile', count(*), round(sum(credit_card_limit), 6) + 0.0 FROM profile
          UNION ALL SELECT 'transactions', count(*), round(sum(amount), 6) + 0.0 FROM tx""",
        "profile_clean": """SELECT id, age, gender, credit_card_limit,
          CAST(registered_on_date AS VARCHAR) AS registered_on_date FROM profile""",
        "transactions_flat": f"""SELECT account_id, event, {r('t', 'time_since_test_start')}, offer_id,
          {rs('amount, reward_amount')} FROM tx""",
        "age_bands": f"SELECT id, age, {AGE_GROUP} AS age_group FROM profile",
        "event_log": f"""SELECT customer_id, event, {r('time_since_test_start')}, offer_id, {rs('amount, reward_amount')},
          age, gender, credit_card_limit, CAST(registered_on_date AS VARCHAR) AS registered_on_date, offer_type,
          min_value, duration, discount_value, array_to_string(channels, ',') AS channels FROM log""",
        "opportunities": f"""SELECT opp_id, customer_id, offer_id, offer_type, duration, age, gender, credit_card_limit,
          CAST(registered_on_date AS VARCHAR) AS registered_on_date, min_value, discount_value,
          array_to_string(channels, ',') AS channels, {rs('t_received, t_expires')}, round_day,
          {rs('t_viewed, t_completed')}, viewed, completed, informational_success FROM opps""",
        "opportunities_latest_send": f"""SELECT s.opp_id, customer_id, offer_id, {rs('t_received, t_viewed, t_completed')},
          CAST(t_viewed IS NOT NULL AS INT) AS viewed, CAST(t_completed IS NOT NULL AS INT) AS completed,
          CASE WHEN offer_type = 'informational' THEN CAST(f.opp_id IS NOT NULL AS INT) END AS informational_success
          FROM sends s LEFT JOIN last_views USING (opp_id) LEFT JOIN last_completions USING (opp_id)
          LEFT JOIN followed_last f ON f.opp_id = s.opp_id""",
        "overcount_latest_send": """SELECT raw_completions, attributed_completions,
          attributed_completions - raw_completions AS difference FROM (SELECT
          (SELECT count(*) FROM tx WHERE event = 'offer completed') AS raw_completions,
          (SELECT count(*) FROM last_completions) AS attributed_completions)""",
        "json_quarantine": f"""SELECT event, count(*) AS n, {r('sum(raw_transactions.amount)', 'amount')},
          (SELECT count(*) FROM raw_transactions WHERE CAST(account_id AS BIGINT) % 50 = 0) AS n_set_aside
          FROM raw_transactions WHERE CAST(account_id AS BIGINT) % 50 <> 0 GROUP BY event""",
        "sink_incremental": f"""SELECT round_day, count(*) AS n, CAST(sum(viewed) AS BIGINT) AS viewed,
          CAST(sum(completed) AS BIGINT) AS completed, CAST(sum(informational_success) AS BIGINT) AS informational_success,
          {r('sum(t_viewed)', 'view_times')} FROM opps GROUP BY round_day""",
        "informational_success": f"""SELECT opp_id, offer_type, {rs('t_viewed, t_expires')}, informational_success
          FROM opps""",
        "reward_label": f"SELECT {base} FROM base",
        "profile_by_gender": f"""SELECT g.gender, position, count(id) AS n FROM {GENDER_LIST}
          LEFT JOIN profile ON profile.gender = g.gender GROUP BY g.gender, position""",
        "offers_by_channel": "SELECT channel, count(*) AS n FROM (SELECT unnest(channels) AS channel FROM offers) GROUP BY channel",
        "limit_by_age": f"""SELECT b.age_group, position, {r('avg(credit_card_limit)', 'avg_limit')}, count(id) AS n
          FROM {AGE_LIST} LEFT JOIN (SELECT *, {AGE_GROUP} AS age_group FROM profile) p ON p.age_group = b.age_group
          GROUP BY b.age_group, position""",
        "events_by_type": "SELECT event, count(*) AS n FROM tx GROUP BY event",
        "sends_by_round": "SELECT round_day, count(*) AS n FROM opps GROUP BY round_day",
        "weekly_events": """SELECT CAST(floor(t / 7) AS INT) AS week,
          count(*) FILTER (event = 'offer completed') AS offer_completed,
          count(*) FILTER (event = 'offer viewed') AS offer_viewed
          FROM tx WHERE event IN ('offer viewed', 'offer completed') GROUP BY 1""",
        "funnel_by_type": f"""SELECT offer_type, {r('avg(viewed)', 'view_rate')}, {r('avg(completed)', 'completion_rate')},
          {r('avg(informational_success)', 'informational_success_rate')}, count(*) AS n FROM opps GROUP BY offer_type""",
        "funnel_by_offer": f"""SELECT offer_id, offer_type, discount_value, min_value, duration,
          {r('avg(viewed)', 'view_rate')}, {r('avg(completed)', 'completion_rate')}, count(*) AS n
          FROM opps GROUP BY offer_id, offer_type, discount_value, min_value, duration""",
        "organic_share": f"""SELECT count(*) AS n_completed, count(*) FILTER (viewed = 0) AS n_organic,
          {r('avg(1 - viewed)', 'organic_share')} FROM opps WHERE {COMPLETABLE} AND completed = 1""",
        "organic_by_segment": " UNION ALL ".join(
            f"""SELECT '{name}' AS segment, {level} AS level, {r('avg(1 - viewed)', 'organic_rate')},
          count(*) AS n_completed FROM opps WHERE {COMPLETABLE} AND completed = 1 GROUP BY 2"""
            for name, level in (("gender", "gender"), ("age_group", AGE_GROUP))
        ),
        "completion_by_duration": f"""SELECT duration, offer_type, {r('avg(completed)', 'completion_rate')}, count(*) AS n
          FROM opps WHERE {COMPLETABLE} GROUP BY duration, offer_type""",
        "completion_by_channel": f"""SELECT offer_type, channel, {r('avg(completed)', 'completion_rate')}, count(*) AS n
          FROM (SELECT offer_type, completed, unnest(channels) AS channel FROM opps) GROUP BY offer_type, channel""",
        "completion_channel_pivot": "SELECT channel, "
        + ", ".join(
            r(f"avg(completed) FILTER (offer_type = '{k}')", k) for k in ("bogo", "discount", "informational")
        )
        + " FROM (SELECT offer_type, completed, unnest(channels) AS channel FROM opps) GROUP BY channel",
        "spend_by_user_group": f"""SELECT is_offer_user, {r('avg(amount)', 'avg_amount')},
          {r('quantile_disc(amount, 0.5)', 'median_amount')}, count(*) AS n_transactions FROM ({spend}) GROUP BY 1""",
        "spend_ratios": f"""SELECT {r('avg(amount) FILTER (is_offer_user = 1) / avg(amount) FILTER (is_offer_user = 0)',
          'mean_ratio')}, {r('''quantile_disc(amount, 0.5) FILTER (is_offer_user = 1)
          / quantile_disc(amount, 0.5) FILTER (is_offer_user = 0)''', 'median_ratio')} FROM ({spend})""",
        "completion_by_cohort": f"""SELECT CAST(year(registered_on_date) AS INT) AS reg_year,
          {r('avg(completed)', 'completion_rate')}, count(*) AS n FROM opps WHERE {COMPLETABLE} GROUP BY 1""",
        "completion_gender_age": f"""SELECT gender, {AGE_GROUP} AS age_group, {r('avg(completed)', 'completion_rate')},
          count(*) AS n FROM opps WHERE {COMPLETABLE} GROUP BY 1, 2""",
        "completion_heat_table": f"""SELECT g.gender, position, {heat} FROM {GENDER_LIST} LEFT JOIN (
          SELECT gender, completed, {AGE_GROUP} AS age_group FROM opps WHERE {COMPLETABLE}) o ON o.gender = g.gender
          GROUP BY g.gender, position""",
        "converter_profile": f"""SELECT completed, {r('avg(age)', 'avg_age')}, {r('avg(credit_card_limit)', 'avg_credit_limit')},
          count(*) AS n FROM opps WHERE {COMPLETABLE} GROUP BY completed""",
        "repeat_groups": """SELECT count(*) AS n_repeat_groups FROM (SELECT 1 FROM opps GROUP BY customer_id, offer_id
          HAVING count(*) > 1)""",
        "send_rank": f"""SELECT opp_id, customer_id, offer_id, {r('t_received')}, row_number() OVER (
          PARTITION BY customer_id, offer_id ORDER BY opps.t_received) AS instance_rank FROM opps""",
        "first_vs_repeat": f"""SELECT instance_rank = 1 AS is_first_instance, {r('avg(completed)', 'completion_rate')},
          count(*) AS n FROM (SELECT completed, row_number() OVER (PARTITION BY customer_id, offer_id ORDER BY t_received)
          AS instance_rank FROM opps WHERE {COMPLETABLE}) GROUP BY 1""",
        "informational_outcomes": """SELECT viewed, informational_success, count(*) AS n FROM opps
          WHERE offer_type = 'informational' GROUP BY viewed, informational_success""",
        "completer_ticket": f"SELECT {r('avg_ticket')} FROM ticket",
        "null_profile": " UNION ALL ".join(
            (
                _null_rows("offers", "offers", {c: c for c in ("id", "offer_type", "duration", "channels")}),
                _null_rows("raw_profile", "profile", {c: c for c in ("id", "gender", "age", "credit_card_limit")}),
                _null_rows(
                    "raw_transactions",
                    "transactions",
                    {"account_id": "account_id", "event": "event", "time_since_test_start": "time_since_test_start", "value": "1"},
                ),
            )
        ),
        "incomplete_share": f"""SELECT count(*) AS n_total, count(*) FILTER (age IS NULL) AS age_null,
          count(*) FILTER (gender = 'Unknown') AS gender_unknown, count(*) FILTER (credit_card_limit IS NULL) AS limit_null,
          {r('count(*) FILTER (age IS NULL) / count(*)', 'incomplete_share')} FROM profile""",
        "row_conservation": """SELECT (SELECT count(*) FROM tx) AS n_events, (SELECT count(*) FROM log) AS n_log_rows,
          (SELECT count(*) FROM tx WHERE event = 'offer received') AS n_send_events,
          (SELECT count(*) FROM (SELECT DISTINCT customer_id, offer_id, t FROM tx WHERE event = 'offer received'))
            AS n_distinct_sends, (SELECT count(*) FROM opps) AS n_opportunities""",
        "key_uniqueness": """SELECT count(*) AS n_duplicate_keys FROM (
          SELECT opp_id FROM opps GROUP BY opp_id HAVING count(*) > 1)""",
        "reward_matches_discount": """SELECT reward_amount = discount_value AS matches, count(*) AS n FROM log
          WHERE event = 'offer completed' GROUP BY 1""",
        "completion_overcount": """SELECT raw_completions, attributed_completions,
          attributed_completions - raw_completions AS difference FROM (SELECT
          (SELECT count(*) FROM tx WHERE event = 'offer completed') AS raw_completions,
          (SELECT CAST(sum(completed) AS BIGINT) FROM opps) AS attributed_completions)""",
        "round_check": f"""SELECT coalesce(e.round_day, o.round_day) AS round_day,
          CAST(e.round_day IS NOT NULL AS INT) AS expected, CAST(o.round_day IS NOT NULL AS INT) AS observed,
          coalesce(n, 0) AS n FROM {_values([f'({d})' for d in SEND_ROUNDS], 'round_day', 'e')}
          FULL JOIN (SELECT round_day, count(*) AS n FROM opps GROUP BY round_day) o ON o.round_day = e.round_day""",
        "context_nulls": " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_null FROM contexts"
            for c in (*NUMERIC, "customer_gender")
        ),
        "numeric_summary": f"""SELECT feature, count(*) AS n, {quartiles}, {r('avg(value)', 'mean')},
          {r('stddev_samp(value)', 'sd')}, min(value) AS minimum, max(value) AS maximum
          FROM ({_long('profile', ('age', 'credit_card_limit'))}) GROUP BY feature""",
        "assignment_balance": f"""SELECT o.offer_id, feature, o.n, {r('o.mean', 'mean')}, {r('o.sd', 'sd')},
          {r('(o.mean - w.mean) / nullif(w.sd, 0)', 'std_difference')} FROM (
            SELECT offer_id, feature, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd
            FROM ({_long('opps', ('age', 'credit_card_limit'), 'offer_id, ')}) GROUP BY offer_id, feature) o
          JOIN (SELECT feature, avg(value) AS mean, stddev_samp(value) AS sd
            FROM ({_long('opps', ('age', 'credit_card_limit'))}) GROUP BY feature) w USING (feature)""",
        "histogram_age": _histogram("age"),
        "histogram_limit": _histogram("credit_card_limit"),
        "feature_correlation": " UNION ALL ".join(
            f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r(f'corr({a}, {b})', 'r')} FROM contexts" for a, b in pairs
        ),
        "feature_quartiles": f"""SELECT reward, feature, count(*) AS n, {quartiles} FROM ({_long('contexts',
          ('customer_tenure_days', 'avg_ticket_before', 'completion_rate_before', 'customer_age'), 'reward, ')})
          GROUP BY reward, feature""",
        "offer_features": f"""SELECT opp_id, duration AS offer_duration_days,
          {r('CASE WHEN min_value > 0 THEN discount_value / min_value ELSE 0 END', 'offer_reward_ratio')} FROM opps""",
        "channel_features": f"SELECT opp_id, {channel_flags} FROM opps",
        "profile_features": """SELECT opp_id, CAST(age AS DOUBLE) AS customer_age, gender AS customer_gender,
          credit_card_limit AS customer_credit_limit, CAST(age IS NULL AS INT) AS customer_incomplete_profile FROM opps""",
        "history_features": f"""SELECT opp_id, customer_id, {r('t_received')},
          {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('tx_count_7d', 'tx_count_28d', 'transaction_count_before'))},
          {r('coalesce(total_spend_before, 0)', 'total_spend_before')}, {r('avg_ticket_before')},
          {', '.join(f'coalesce(offers_{k}_count_before, 0) AS offers_{k}_count_before'
                     for k in ('received', 'viewed', 'completed'))},
          {rs('days_since_last_tx, days_since_last_offer_view')},
          {r('coalesce(view_rate_before, 0)', 'view_rate_before')},
          {r('coalesce(completion_rate_before, 0)', 'completion_rate_before')}
          FROM opps LEFT JOIN rates USING (opp_id)""",
        "tenure_features": "SELECT opp_id, customer_tenure_days FROM tenure",
        "context_features": f"SELECT {context_columns} FROM contexts",
        "standardized": "SELECT opp_id, "
        + ", ".join(r(f"x[{i + 1}]", n) for i, n in enumerate(FEATURES) if n in NUMERIC)
        + " FROM design",
        "standardized_prefix": "SELECT opp_id, round_day, "
        + ", ".join(
            r(f"CASE WHEN e.n = 0 THEN c.{n} ELSE (c.{n} - e.mean_{n}) / CASE WHEN e.sd_{n} > 1e-9 THEN e.sd_{n} ELSE 1 END END", n)
            for n in NUMERIC
        )
        + " FROM contexts c JOIN (SELECT a.round_day AS own, count(b.opp_id) AS n, "
        + ", ".join(f"avg(b.{n}) AS mean_{n}, stddev_pop(b.{n}) AS sd_{n}" for n in NUMERIC)
        + """ FROM (SELECT DISTINCT round_day FROM contexts) a LEFT JOIN contexts b ON b.round_day < a.round_day
          GROUP BY a.round_day) e ON e.own = c.round_day""",
        "gender_onehot": "SELECT opp_id, "
        + ", ".join(f"CAST(CAST(gender = '{g}' AS INT) AS DOUBLE) AS gender_{g}" for g in GENDERS)
        + " FROM opps",
        "design_matrix": "SELECT opp_id, offer_id, round_day, reward, "
        + ", ".join(r(f"x[{i + 1}]", n) for i, n in enumerate(FEATURES))
        + " FROM design",
        "arm_distribution": f"""SELECT offer_id, offer_type, {r('avg(reward)', 'reward_rate')}, count(*) AS n FROM contexts
          GROUP BY offer_id, offer_type""",
        "best_offer": f"SELECT offer_id, {r('reward_rate')}, n FROM best_rate",
        "most_recent_active": f"""SELECT opp_id, customer_id, {r('days_since_last_tx')} FROM (
          SELECT * FROM contexts ORDER BY days_since_last_tx, opp_id LIMIT 10)""",
        "arm_values": f"SELECT offer_id, offer_type, discount_value, {r('value')} FROM worth",
        "arm_posterior_step": f"""SELECT offer_id, CAST(j - 1 AS INT) AS position, {rs('m, q')}
          FROM step JOIN precisions USING (offer_id, j)""",
        "map_scores": f"SELECT opp_id, offer_id, {rs('p, score')} FROM scores",
        "thompson_choice": f"""SELECT opp_id, offer_id AS chosen_offer, {r('p', 'chosen_p')}, {r('score', 'chosen_score')}
          FROM thompson""",
        "replay_eval": f"SELECT {summary} FROM replayed WHERE policy IN ('random', 'fixed', 'logged')",
        "replay_running": f"""SELECT policy, round_day, opp_id, reward, {r('gain')}, count(*) {upto} AS position,
          CAST(sum(reward) {upto} AS BIGINT) AS cumulative_reward, {r(f'sum(gain) {upto}', 'cumulative_value')}
          FROM ({kept})""",
        "step_replay": f"SELECT {summary} FROM replayed WHERE policy <> 'logged'",
        "step_best_offer": f"""SELECT offer_id, {r('avg(p)', 'mean_p')}, {r('avg(score)', 'expected_value')}
          FROM scores GROUP BY offer_id ORDER BY avg(score) DESC, offer_id LIMIT 1""",
        "step_ranking": f"""SELECT opp_id, customer_id, CAST(offer_rank AS INT) AS offer_rank, offer_id, {r('p')},
          {r('score', 'expected_value')} FROM ranked""",
        "step_top3": f"""SELECT opp_id, customer_id, CAST(offer_rank AS INT) AS offer_rank, offer_id, {r('p')},
          {r('score', 'expected_value')} FROM ranked WHERE offer_rank <= 3""",
        "step_share": f"""SELECT offer_id, count(*) AS n, {r('count(*) / (SELECT count(*) FROM design)', 'share')}
          FROM ranked WHERE offer_rank = 1 GROUP BY offer_id""",
        "step_regret": f"""SELECT policy, CAST(part AS INT) AS part, count(*) AS n, {r('avg(best)', 'mean_best_value')},
          {r('avg(score)', 'mean_chosen_value')}, {r('avg(best - score)', 'mean_regret')}
          FROM (SELECT opp_id, ntile(8) OVER (ORDER BY round_day, opp_id) AS part FROM design)
          JOIN (SELECT opp_id, max(score) AS best FROM scores GROUP BY opp_id) USING (opp_id)
          JOIN choices USING (opp_id) JOIN scores s ON s.opp_id = choices.opp_id AND s.offer_id = chosen
          GROUP BY policy, part""",
        "historic_value": f"""SELECT {r('avg(reward)', 'conversion_rate')}, {r('avg(reward * value)', 'value_per_contact')}
          FROM design""",
        "step_projection": f"""SELECT policy, {rs('conversion_rate, value_per_contact')}, n_opportunities,
          {r('value_per_contact * n_opportunities', 'projected_value')} FROM (
            SELECT policy, conversion_rate, value_per_contact FROM replayed WHERE policy <> 'logged' UNION ALL
            SELECT 'historic', avg(reward), avg(reward * value) FROM design)
          CROSS JOIN (SELECT count(*) AS n_opportunities FROM design)""",
        "step_top_weights": f"""SELECT feature, offer_id, {rs('weight, strength')} FROM {weights} AS weights
          JOIN ({strength.replace('FROM weights', f'FROM {weights} AS weights')}) USING (feature)""",
        "step_weights": "SELECT feature, "
        + ", ".join(r(f"max(weight) FILTER (offer_id = 'offer_{i}')", f"offer_{i}") for i in range(10))
        + f" FROM {weights} AS weights GROUP BY feature",
        "step_examples": " UNION ALL ".join(
            (
                example(
                    "long_standing_and_engaged",
                    top,
                    """completion_rate_before > 0.5 AND customer_tenure_days >
                  (SELECT quantile_cont(customer_tenure_days, 0.75) FROM contexts)""",
                    seeded,
                ),
                example("no_purchase_before", top, "transaction_count_before = 0", seeded),
                example("most_recent_purchase", top, "true", "days_since_last_tx, opp_id"),
                example("best_is_bogo", top, "best_type = 'bogo'", "round_day, opp_id"),
                example("best_is_informational", top, "best_type = 'informational'", "round_day, opp_id"),
            )
        ),
        "stream_attribution": f"""SELECT customer_id, offer_id, {rs('t_received, t_expires, t_viewed, t_completed')}
          FROM opps""",
        "stream_labels": f"SELECT opp_id, customer_id, offer_id, {r('t_received')}, reward FROM base",
        # Both sides of the optimum's condition; "fitted" comes from the model in Spark, from the data here.
        "response_optimality": f"""SELECT offer_id, feature, count(*) AS n, {r('avg(reward * v)', 'fitted')},
          {r('avg(reward * v)', 'observed')} FROM flat JOIN {feature_list} USING (j) GROUP BY offer_id, feature""",
        "heldout_optimality": f"""SELECT fold, offer_id, feature, count(*) AS n, {r('avg(reward * v)', 'fitted')},
          {r('avg(reward * v)', 'observed')} FROM flat JOIN design USING (opp_id, offer_id, reward)
          JOIN (SELECT round_day AS fold FROM (SELECT DISTINCT round_day FROM design)) ON round_day < fold
          JOIN {feature_list} USING (j) GROUP BY fold, offer_id, feature""",
        # At the optimum of a model with a free intercept the mean prediction is the observed rate.
        "calibration": f"""SELECT offer_id, {r('avg(reward)', 'predicted_avg')}, {r('avg(reward)', 'real_rate')},
          count(*) AS n FROM contexts GROUP BY offer_id""",
    }


def _learnt(prefix: str) -> str:
    """Totals of a learning replay per prior precision."""
    return f"""SELECT prec AS prior_precision, n_total, coalesce(n_kept, 0) AS n_kept, {r('coalesce(n_kept, 0) / n_total', 'kept_share')},
      {rs('conversion_rate, value_per_contact')} FROM (SELECT DISTINCT prec FROM {prefix}s0)
      CROSS JOIN (SELECT count(*) AS n_total FROM design) LEFT JOIN (SELECT prec, count(*) AS n_kept,
        avg(reward) AS conversion_rate, avg(reward * value) AS value_per_contact FROM {prefix}kept GROUP BY prec) USING (prec)"""


def _diagonal_statements(step: dict[str, str]) -> dict[str, str]:
    """The learning replay by diagonal steps, and the statements on closed-form arms with its arms."""
    feature_list = _values([f"({i + 1}, '{n}')" for i, n in enumerate(FEATURES)], "j, feature", "f")
    upto = "OVER (PARTITION BY prior_precision ORDER BY round_day)"
    return {
        "diagonal_posterior": f"SELECT offer_id, CAST(j - 1 AS INT) AS position, {rs('m, q')} FROM d_s6",
        "diagonal_replay": _learnt("d_"),
        "diagonal_sweep": _learnt("v_"),
        "diagonal_rounds": f"""SELECT *, {r(f'sum(reward) {upto}', 'cumulative_reward')}, {r(f'sum(gain) {upto}', 'cumulative_value')}
          FROM (SELECT CAST(1 AS DOUBLE) AS prior_precision, round_day, count(prec) AS n_kept,
            {r('coalesce(sum(reward), 0)', 'reward')}, {r('coalesce(sum(reward * value), 0)', 'gain')}
          FROM rounds LEFT JOIN d_kept USING (k) GROUP BY round_day)""",
        "diagonal_online": f"SELECT feature, offer_id, {r('m', 'weight')} FROM o_s6 JOIN {feature_list} USING (j)",
        "diagonal_summary": step["step_replay"],
        "diagonal_best_offer": step["step_best_offer"],
        "diagonal_recommend": step["step_ranking"],
        "diagonal_top3": step["step_top3"],
        "diagonal_share": step["step_share"],
        "diagonal_regret": step["step_regret"],
        "diagonal_projection": step["step_projection"],
        "diagonal_top_weights": step["step_top_weights"],
        "diagonal_weights": step["step_weights"],
        "diagonal_examples": step["step_examples"],
    }


def oracle_sql() -> dict[str, str]:
    statements = _statements()
    found = {name: _with(select) for name, select in statements.items()}
    return found | {name: _with(select, diagonal=True) for name, select in _diagonal_statements(statements).items()}
