"""The registered queries in SQL, for comparison on the same tables."""

from __future__ import annotations

from collections.abc import Iterable

# ------------------------------------------------------------------ faulted views

CUSTOMER_F = """customer_f AS (
  SELECT c_custkey,
         CASE WHEN c_custkey % 10 <> 0 THEN c_name END AS c_name,
         c_nationkey,
         CASE WHEN c_custkey % 100 = 7 THEN 2e10
              WHEN c_custkey % 40 <> 3 THEN c_acctbal END AS c_acctbal,
         CASE WHEN c_custkey % 25 = 1 THEN '' ELSE c_mktsegment END AS c_mktsegment
  FROM customer)"""

MAIL_F = """mail_f AS (
  SELECT CASE WHEN c_custkey % 40 = 1 THEN NULL
              WHEN c_custkey % 30 = 0 THEN 'invalid-email'
              ELSE 'c' || c_custkey || '@example.com' END AS sender_email,
         CASE WHEN c_custkey % 20 = 5 THEN NULL
              WHEN c_custkey % 50 = 2 THEN 'urgent!!! act fast'
              ELSE 'Meeting ' || c_custkey END AS subject,
         CASE WHEN c_custkey % 50 = 4 THEN CAST(2.5 AS DOUBLE)
              ELSE c_acctbal / 10000.0 END AS sentiment_score,
         c_name AS email_content
  FROM customer)"""

EVENTS_F = """events_f AS (
  SELECT event_id, ts, user_id, event_type,
         CASE WHEN event_id % 20 <> 3 THEN value END AS value, props
  FROM (SELECT *, unnest(CASE WHEN event_id % 50 = 0 THEN [1, 2] ELSE [1] END) AS copy
        FROM events))"""

RUNS_F = """runs_f AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS run_id,
         'ds_' || (o_custkey % 5) AS dataset_name,
         o_orderdate + to_seconds(o_orderkey) AS timestamp,
         o_totalprice / 5000.0 AS quality_score,
         o_custkey AS rows,
         6 AS columns,
         'completed' AS status
  FROM orders)"""


def over(views: str | Iterable[str], body: str) -> str:
    views = [views] if isinstance(views, str) else list(views)
    return f"WITH {', '.join(views)} {body}" if views else body


def union(parts: Iterable[str]) -> str:
    return " UNION ALL ".join(parts)


def stamp(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"


# ------------------------------------------------------------------ tables

CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
CUSTOMER_NUMERIC = ("c_custkey", "c_nationkey", "c_acctbal")
CUSTOMER_TEXT = ("c_name", "c_mktsegment")
SUPPLIER_NUMERIC = ("s_suppkey", "s_nationkey", "s_acctbal")
ORDERS = {
    "o_orderkey": "bigint",
    "o_custkey": "bigint",
    "o_orderstatus": "string",
    "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz",
    "o_orderpriority": "string",
}
LINEITEM = {
    "l_orderkey": "bigint",
    "l_partkey": "bigint",
    "l_suppkey": "bigint",
    "l_linenumber": "int",
    "l_quantity": "double",
    "l_extendedprice": "double",
    "l_discount": "double",
    "l_tax": "double",
    "l_returnflag": "string",
    "l_linestatus": "string",
    "l_shipdate": "timestamp_ntz",
}
EVENTS = {
    "event_id": "bigint",
    "ts": "timestamp_ntz",
    "user_id": "bigint",
    "event_type": "string",
    "value": "double",
    "props": "string",
}
NUMERIC = ("bigint", "int", "double")
LINEITEM_NUMERIC = tuple(c for c, kind in LINEITEM.items() if kind in NUMERIC)

# ------------------------------------------------------------------ checks
#
# A check is (check_type, constraint, column, {metric: aggregate}, passed). The same
# definitions give the single-check queries, the suite and the alerts.

N = "count(*)"


def share(part: str) -> str:
    return f"coalesce(CAST({part} AS DOUBLE) / nullif({N}, 0), 0)"


def completeness(c: str):
    missing = f"count(*) FILTER (WHERE {c} IS NULL)"
    ratio = share(f"({N} - {missing})")
    return (
        "completeness",
        f"Completeness of {c}",
        c,
        {"completeness_ratio": ratio, "null_count": missing, "total_count": N},
        f"{ratio} >= 0.95",
    )


def uniqueness(c: str):
    ratio = share(f"count(DISTINCT {c})")
    return (
        "uniqueness",
        f"Uniqueness of {c}",
        c,
        {
            "uniqueness_ratio": ratio,
            "distinct_count": f"count(DISTINCT {c})",
            "total_count": N,
        },
        f"{ratio} >= 0.9",
    )


def consistency(c: str):
    negative = f"count(*) FILTER (WHERE {c} < 0)"
    huge = f"count(*) FILTER (WHERE {c} > 1e10)"
    return (
        "consistency",
        f"Consistency of {c}",
        c,
        {
            "negative_ratio": share(negative),
            "outlier_ratio": share(huge),
            "negative_count": negative,
            "outlier_count": huge,
            "total_count": N,
        },
        f"{negative} = 0 AND {huge} = 0",
    )


def violating(check_type: str, label: str, c: str, violations: str):
    return (
        check_type,
        f"{label} for {c}",
        c,
        {
            "violation_ratio": share(violations),
            "violations": violations,
            "total_count": N,
        },
        f"{violations} = 0",
    )


def in_range(c: str, low: float | None, high: float | None):
    sides = [f"count(*) FILTER (WHERE {c} < {low})"] if low is not None else []
    if high is not None:
        sides.append(f"count(*) FILTER (WHERE {c} > {high})")
    return violating("range_check", "Range check", c, f"({' + '.join(sides)})")


def matching(c: str, pattern: str):
    return violating(
        "pattern_check",
        "Pattern check",
        c,
        f"count(*) FILTER (WHERE NOT regexp_matches({c}, '{pattern}'))",
    )


def text(c: str):
    counts = {
        "null": f"count(*) FILTER (WHERE {c} IS NULL)",
        "empty": f"count(*) FILTER (WHERE length({c}) = 0)",
        "short": f"count(*) FILTER (WHERE length({c}) < 10)",
        "long": f"count(*) FILTER (WHERE length({c}) > 1000)",
    }
    allowed = {"null": 0.1, "empty": 0.05, "short": 0.3, "long": 0.1}
    return (
        "text_quality",
        f"Text quality for {c}",
        c,
        {f"{kind}_ratio": share(count) for kind, count in counts.items()}
        | {f"{kind}_count": count for kind, count in counts.items()}
        | {"total_count": N},
        " AND ".join(f"{share(counts[k])} <= {most}" for k, most in allowed.items()),
    )


def mail(c: str):
    label, kind, hits, most = {
        "sender_email": (
            "Email format validity",
            "invalid_email",
            "NOT coalesce(regexp_matches(sender_email, "
            r"'^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$'), false)",
            0.05,
        ),
        "subject": (
            "Spam indicator detection",
            "spam",
            "regexp_matches(subject, "
            "'(?i)!!!|URGENT|BUY NOW|ACT FAST|LIMITED TIME')",
            0.1,
        ),
        "sentiment_score": (
            "Sentiment score validity",
            "invalid_sentiment",
            "sentiment_score < -1 OR sentiment_score > 1",
            0.05,
        ),
    }[c]
    count = f"count(*) FILTER (WHERE {hits})"
    return (
        "email_specific",
        label,
        c,
        {f"{kind}_ratio": share(count), f"{kind}_count": count, "total_count": N},
        f"{share(count)} < {most}",
    )


def status(passed: str) -> str:
    return f"CASE WHEN {passed} THEN 'Success' ELSE 'Failure' END"


def flat(check, source: str, rename: bool = False) -> str:
    """One result row with a column per metric."""
    _, constraint, column, metrics, passed = check
    columns = []
    for name, expression in metrics.items():
        value = f"round({expression}, 6)" if name.endswith("_ratio") else expression
        if rename and name != "total_count":
            name = "violation_ratio" if name.endswith("_ratio") else "violations"
        columns.append(f"{value} AS {name}")
    return (
        f"SELECT '{constraint}' AS constraint, '{column}' AS column_name, "
        f"{status(passed)} AS status, {', '.join(columns)} FROM {source}"
    )


def long(check, source: str) -> str:
    """One row per metric of a result."""
    check_type, constraint, column, metrics, passed = check
    names = ", ".join(f"'{m}'" for m in metrics)
    values = ", ".join(f"round(CAST({e} AS DOUBLE), 6)" for e in metrics.values())
    return (
        f"SELECT '{check_type}' AS check_type, '{column}' AS column_name, "
        f"'{constraint}' AS constraint, {status(passed)} AS status, "
        f"unnest([{names}]) AS metric, unnest([{values}]) AS value FROM {source}"
    )


def verdict(check, source: str) -> str:
    """One row per result: type, column, constraint and status."""
    check_type, constraint, column, _, passed = check
    return (
        f"SELECT '{check_type}' AS check_type, '{column}' AS column_name, "
        f"'{constraint}' AS constraint, {status(passed)} AS status FROM {source}"
    )


def info(columns: int, source: str) -> str:
    return (
        "SELECT 'dataset_info' AS check_type, NULL AS column_name, "
        "'Dataset info' AS constraint, NULL AS status, "
        "unnest(['rows', 'columns']) AS metric, "
        f"unnest([CAST(count(*) AS DOUBLE), {columns}.0]) AS value FROM {source}"
    )


CUSTOMER_SUITE = [
    *map(completeness, CUSTOMER),
    *map(uniqueness, CUSTOMER),
    *map(consistency, CUSTOMER_NUMERIC),
    *map(text, CUSTOMER_TEXT),
    in_range("c_acctbal", 0.0, 9000.0),
    in_range("c_nationkey", 5, None),
    matching("c_name", "^Customer#[0-9]+$"),
    matching("c_mktsegment", "^[A-Z]+$"),
]
MAIL_COLUMNS = ("sender_email", "subject", "sentiment_score", "email_content")
MAIL_SUITE = [
    *map(completeness, MAIL_COLUMNS),
    *map(uniqueness, MAIL_COLUMNS),
    consistency("sentiment_score"),
    *map(text, ("sender_email", "subject", "email_content")),
    *map(mail, MAIL_COLUMNS[:3]),
]
EVENTS_SUITE = [
    *map(completeness, EVENTS),
    *map(uniqueness, EVENTS),
    *map(consistency, ("event_id", "user_id", "value")),
    *map(text, ("event_type", "props")),
]


def verdicts(name: str, suite, source: str) -> str:
    return f"{name} AS ({union(verdict(c, source) for c in suite)})"


def score_of(results: str) -> str:
    return (
        f"(SELECT 100.0 * count(*) FILTER (WHERE status = 'Success') / count(*) "
        f"FROM {results})"
    )


CUSTOMER_RESULTS = (
    CUSTOMER_F,
    verdicts("results", CUSTOMER_SUITE, "customer_f"),
)
EVENTS_RESULTS = (EVENTS_F, verdicts("results", EVENTS_SUITE, "events_f"))

# ------------------------------------------------------------------ profile, anomalies


def profile(columns: dict[str, str], source: str, card: bool = False) -> str:
    rows = []
    for c, kind in columns.items():
        def number(e: str) -> str:
            return f"round({e}, 4)" if kind in NUMERIC else "CAST(NULL AS DOUBLE)"

        x = f"CAST({c} AS DOUBLE)"
        counts = {
            "total_count": "count(*)",
            "null_count": f"count(*) - count({c})",
            "distinct_count": f"count(DISTINCT {c})",
        }
        if card:
            counts = {
                "unique_values": counts["distinct_count"],
                "missing_values": counts["null_count"],
            }
        numbers = {"min": f"min({x})", "max": f"max({x})", "mean": f"avg({x})"}
        if not card:
            numbers["std"] = f"stddev_samp({x})"
        listed = [f"{e} AS {a}" for a, e in counts.items()]
        listed += [f"{number(e)} AS {a}" for a, e in numbers.items()]
        rows.append(
            f"SELECT '{c}' AS column_name, '{kind}' AS data_type, {', '.join(listed)} "
            f"FROM {source}"
        )
    return union(rows)


def long_values(columns: Iterable[str], source: str) -> str:
    return union(
        f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS x FROM {source}"
        for c in columns
    )


def bands(columns: Iterable[str], threshold: float) -> list[str]:
    """CTEs: vals (every value), stats (band per column) and hits (values outside)."""
    return [
        EVENTS_F,
        f"vals AS ({long_values(columns, 'events_f')})",
        f"""stats AS (
  SELECT column_name, avg(x) AS mean, stddev_samp(x) AS std,
         avg(x) - {threshold} * stddev_samp(x) AS lower_bound,
         avg(x) + {threshold} * stddev_samp(x) AS upper_bound,
         count(*) AS total_count
  FROM vals GROUP BY column_name)""",
        """hits AS (
  SELECT column_name, x FROM vals JOIN stats USING (column_name)
  WHERE x < lower_bound OR x > upper_bound)""",
        """counted AS (
  SELECT column_name, mean, std, lower_bound, upper_bound, total_count,
         (SELECT count(*) FROM hits WHERE hits.column_name = stats.column_name)
           AS anomaly_count,
         (SELECT count(*) FROM hits WHERE hits.column_name = stats.column_name)
           / CAST(total_count AS DOUBLE) * 100 AS anomaly_percentage
  FROM stats)""",
    ]


def bins(values: str, count: int, extra: str = "") -> str:
    """Equal-width bins over a CTE with (column_name, x), empty bins included."""
    return f"""
  spans AS (
    SELECT column_name, min(x) AS lo, max(x) AS hi,
           (max(x) - min(x)) / {count} AS width
    FROM {values} WHERE x IS NOT NULL GROUP BY column_name),
  grid AS (
    SELECT column_name, lo, hi, width, unnest(range({count})) AS bin FROM spans),
  placed AS (
    SELECT column_name, least(CAST(floor((x - lo) / width) AS BIGINT), {count - 1})
             AS bin, count(*) AS value_count
    FROM {values} JOIN spans USING (column_name) WHERE x IS NOT NULL GROUP BY ALL)
  SELECT column_name, CAST(bin AS INTEGER) AS bin,
         round(lo + bin * width, 4) AS lower_edge,
         round(CASE WHEN bin = {count - 1} THEN hi ELSE lo + (bin + 1) * width END, 4)
           AS upper_edge,
         coalesce(value_count, 0) AS value_count{extra}"""


# ------------------------------------------------------------------ alerts

NO_NUMBER = "CAST(NULL AS DOUBLE)"


def alert(
    kind: str,
    severity: str,
    message: str,
    source: str,
    run: str = "'customer-1'",
    dataset: str = "'customer'",
    timestamp: str = "'2024-01-01 00:00:00'",
    column: str = "CAST(NULL AS VARCHAR)",
    value: str = NO_NUMBER,
    threshold: str = NO_NUMBER,
    percentage: str = NO_NUMBER,
    count: str = "CAST(NULL AS BIGINT)",
) -> str:
    return (
        f"SELECT {run} AS run_id, {dataset} AS dataset_name, '{kind}' AS type, "
        f"'{severity}' AS severity, {message} AS message, {timestamp} AS timestamp, "
        f"{column} AS column_name, {value} AS value, {threshold} AS threshold, "
        f"{percentage} AS anomaly_percentage, {count} AS anomaly_count {source}"
    )


def low_score(score: str, least: float, source: str, **fields: str) -> str:
    return alert(
        "quality_score_low",
        "high",
        f"printf('Data quality score (%.2f%%) is below threshold ({least}%%)', {score})",
        source,
        value=f"round({score}, 6)",
        threshold=f"CAST({least} AS DOUBLE)",
        **fields,
    )


def failures(check_type: str, **fields: str) -> str:
    return alert(
        f"{check_type}_failure",
        "medium",
        f"'{check_type.capitalize()} check failed for column: ' || \"constraint\"",
        f"FROM results WHERE check_type = '{check_type}' AND status = 'Failure'",
        column="column_name",
        **fields,
    )


def suite_alerts(least: float, **fields: str) -> list[str]:
    return [
        low_score(
            "quality_score",
            least,
            f"FROM (SELECT {score_of('results')} AS quality_score) "
            f"WHERE quality_score < {least}",
            **fields,
        ),
        failures("completeness", **fields),
        failures("uniqueness", **fields),
    ]


ANOMALY_ALERTS = alert(
    "anomaly_detected",
    "high",
    "printf('High anomaly percentage (%.2f%%) detected in column: %s', "
    "anomaly_percentage, column_name)",
    "FROM counted WHERE anomaly_percentage > 5",
    run="'events-1'",
    dataset="'events'",
    column="column_name",
    percentage="round(anomaly_percentage, 6)",
    count="anomaly_count",
)


def rule(
    name: str, check, metric: str, op: str, value: float, severity: str = "medium"
) -> str:
    """Rows (name, severity, message, column, value, threshold) where the rule holds."""
    _, constraint, column, metrics, _ = check
    measured = f"CAST({metrics[metric]} AS DOUBLE)"
    return (
        f"SELECT '{name}' AS type, '{severity}' AS severity, "
        f"'Rule {name}: {metric} {op} {value} in {constraint}' AS message, "
        f"'{column}' AS column_name, round({measured}, 6) AS value, "
        f"CAST({value} AS DOUBLE) AS threshold "
        f"FROM customer_f HAVING {measured} {op} {value}"
    )


RULE_HITS = union(
    [
        *[
            rule("many_missing", completeness(c), "null_count", ">", 0)
            for c in CUSTOMER
        ],
        *[
            rule("too_short", text(c), "short_ratio", ">=", 0.25, "low")
            for c in CUSTOMER_TEXT
        ],
        rule("huge_balance", consistency("c_acctbal"), "outlier_count", ">", 0),
    ]
)

LAST_FIVE = """
  SELECT *, CAST(row_number() OVER (
      PARTITION BY dataset_name ORDER BY timestamp DESC, run_id DESC) AS INTEGER)
    AS recency
  FROM runs_f QUALIFY recency <= 5"""

EVENT_BANDS = bands(("value", "user_id"), 2.0)
ALERT_BANDS = bands(("value", "user_id"), 1.0)
ALERT_CTES = [*CUSTOMER_RESULTS, *ALERT_BANDS]

OUTBOX_ALERTS = f"""
  SELECT type, severity, message, CAST(NULL AS VARCHAR) AS route_to
  FROM ({union(suite_alerts(80.0))})
  UNION ALL
  SELECT type, severity, message, CASE WHEN type = 'too_short' THEN 'webhook' END
  FROM ({RULE_HITS})"""

# ------------------------------------------------------------------ windows


def windows(where: str = "true") -> str:
    """Hourly quality of two event columns, for the hours that satisfy ``where``."""
    return union(
        f"""SELECT {stamp("hour")} AS window_start,
              {stamp("hour + to_hours(1)")} AS window_end,
              '{c}' AS column_name, count(*) AS total_count,
              count(*) - count({c}) AS null_count,
              round(count({c}) / CAST(count(*) AS DOUBLE), 6) AS completeness_ratio,
              {negative} AS negative_count, {huge} AS outlier_count,
              {status(passed)} AS status
            FROM (SELECT *, date_trunc('hour', ts) AS hour FROM events_f)
            WHERE {where} GROUP BY hour"""
        for c, negative, huge, passed in (
            (
                "value",
                "count(*) FILTER (WHERE value < 0)",
                "count(*) FILTER (WHERE value > 1e10)",
                "count(value) >= 0.95 * count(*) "
                "AND count(*) FILTER (WHERE value < 0) = 0 "
                "AND count(*) FILTER (WHERE value > 1e10) = 0",
            ),
            (
                "event_type",
                "CAST(NULL AS BIGINT)",
                "CAST(NULL AS BIGINT)",
                "count(event_type) >= 0.95 * count(*)",
            ),
        )
    )


# ------------------------------------------------------------------ queries

ORACLE: dict[str, str] = {
    "completeness": over(
        CUSTOMER_F, union(flat(completeness(c), "customer_f") for c in CUSTOMER)
    ),
    "uniqueness": over(
        CUSTOMER_F,
        union(
            [
                *[flat(uniqueness(c), "orders") for c in ORDERS],
                *[flat(uniqueness(c), "customer_f") for c in CUSTOMER],
            ]
        ),
    ),
    "consistency": over(
        CUSTOMER_F,
        union(
            [
                *[flat(consistency(c), "customer_f") for c in CUSTOMER_NUMERIC],
                *[flat(consistency(c), "supplier") for c in SUPPLIER_NUMERIC],
                *[flat(consistency(c), "lineitem") for c in LINEITEM_NUMERIC],
            ]
        ),
    ),
    "range_check": over(
        CUSTOMER_F,
        union(
            [
                flat(in_range("l_quantity", 5, 45), "lineitem"),
                flat(in_range("l_discount", None, 0.1), "lineitem"),
                flat(in_range("c_acctbal", 0.0, 9000.0), "customer_f"),
                flat(in_range("c_nationkey", 5, None), "customer_f"),
            ]
        ),
    ),
    "pattern_check": over(
        CUSTOMER_F,
        union(
            f"SELECT *, '{pattern}' AS pattern FROM ({flat(matching(c, pattern), source)})"
            for c, pattern, source in (
                ("p_brand", "^Brand#[1-3]", "part"),
                ("c_name", "^Customer#[0-9]+$", "customer_f"),
                ("c_mktsegment", "^[A-Z]+$", "customer_f"),
            )
        ),
    ),
    "text_quality": union(
        [
            *[flat(text(c), "documents") for c in ("text", "lang", "source")],
            *[flat(text(c), "conversations") for c in ("role", "text")],
        ]
    ),
    "email_format": over(MAIL_F, flat(mail("sender_email"), "mail_f", True)),
    "spam_indicator": over(MAIL_F, flat(mail("subject"), "mail_f", True)),
    "sentiment_validity": over(MAIL_F, flat(mail("sentiment_score"), "mail_f", True)),
    "email_bundle": over(
        MAIL_F, union(flat(mail(c), "mail_f", True) for c in MAIL_COLUMNS[:3])
    ),
    "suite_results": over(
        CUSTOMER_F,
        union(
            [*[long(c, "customer_f") for c in CUSTOMER_SUITE], info(5, "customer_f")]
        ),
    ),
    "mail_suite_results": over(
        MAIL_F,
        union([*[long(c, "mail_f") for c in MAIL_SUITE], info(4, "mail_f")]),
    ),
    "quality_score": over(
        CUSTOMER_RESULTS,
        "SELECT count(*) AS total_checks, "
        "count(*) FILTER (WHERE status = 'Success') AS passed_checks, "
        f"round({score_of('results')}, 6) AS quality_score FROM results",
    ),
    "check_type_summary": over(
        CUSTOMER_RESULTS,
        """SELECT CASE check_type WHEN 'completeness' THEN 'Completeness'
                WHEN 'uniqueness' THEN 'Uniqueness'
                WHEN 'consistency' THEN 'Consistency'
                WHEN 'text_quality' THEN 'Text Quality'
                WHEN 'range_check' THEN 'Range Check'
                WHEN 'pattern_check' THEN 'Pattern Check' END AS check_type,
             count(*) AS total_checks,
             count(*) FILTER (WHERE status = 'Success') AS passed,
             count(*) FILTER (WHERE status = 'Failure') AS failed,
             printf('%.1f%%', 100.0 * count(*) FILTER (WHERE status = 'Success')
                              / count(*)) AS success_rate
           FROM results GROUP BY results.check_type""",
    ),
    "status_by_check": over(
        CUSTOMER_RESULTS,
        f"""SELECT check_type, status, count(*) AS results FROM (
              SELECT check_type, status FROM results
              UNION ALL SELECT 'range_check', 'Error' FROM range(2)
              UNION ALL SELECT 'pattern_check', 'Error'
              UNION ALL SELECT 'dataset_info', NULL
              UNION ALL SELECT 'data_profile', NULL FROM range({len(CUSTOMER)})
              UNION ALL SELECT 'constraint_suggestions', NULL
                        FROM range({len(CUSTOMER)}))
            GROUP BY check_type, status""",
    ),
    "dataset_info": "SELECT count(*) AS rows, 6 AS columns FROM orders",
    "missing_by_column": over(
        CUSTOMER_F,
        f"""SELECT column_name, missing_count,
                   round(missing_count / CAST(n AS DOUBLE) * 100, 6)
                     AS missing_percentage
            FROM ({union(
                f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, "
                f"count(*) AS n FROM customer_f" for c in CUSTOMER)})
            WHERE missing_count > 0""",
    ),
    "total_missing": over(
        CUSTOMER_F,
        "SELECT "
        + " + ".join(f"(count(*) - count({c}))" for c in CUSTOMER)
        + " AS missing_cells FROM customer_f",
    ),
    "duplicate_rows": over(
        EVENTS_F,
        "SELECT CAST((SELECT count(*) FROM events_f) - "
        "(SELECT count(*) FROM (SELECT DISTINCT * FROM events_f)) AS BIGINT) "
        "AS duplicate_rows",
    ),
    "duplicate_groups": over(
        EVENTS_F,
        "SELECT event_id, event_type, round(value, 6) AS value, count(*) AS copies "
        "FROM events_f GROUP BY event_id, ts, user_id, event_type, events_f.value, props "
        "HAVING count(*) > 1",
    ),
    "issue_summary": over(
        EVENTS_F,
        f"""SELECT count(*) AS total_rows, 6 AS total_columns,
             CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM events_f))
                  AS BIGINT) AS duplicate_rows,
             'event_id,user_id,value' AS numeric_columns,
             'event_type,props' AS categorical_columns,
             '{','.join(f'{c}:{kind}' for c, kind in EVENTS.items())}' AS data_types,
             'value' AS column_name,
             count(*) - count(value) AS missing_count,
             round((count(*) - count(value)) / CAST(count(*) AS DOUBLE) * 100, 6)
               AS missing_percentage
           FROM events_f""",
    ),
    "column_profile": profile(LINEITEM, "lineitem"),
    "column_card": profile(ORDERS, "orders", card=True),
    "constraint_suggestions": union(
        f"SELECT '{c}' AS column_name, "
        + (
            f"'Column {c} is numeric - consider range checks' AS suggestion, "
            f"CAST(min({c}) AS DOUBLE) AS observed_min, "
            f"CAST(max({c}) AS DOUBLE) AS observed_max FROM lineitem"
            if kind in NUMERIC
            else f"'Column {c} is string - consider pattern checks' AS suggestion, "
            f"{NO_NUMBER} AS observed_min, {NO_NUMBER} AS observed_max"
        )
        for c, kind in LINEITEM.items()
        if kind in (*NUMERIC, "string")
    ),
    "dtype_distribution": over(
        CUSTOMER_F,
        "SELECT data_type, count(*) AS column_count, "
        "CAST(sum(filled) AS BIGINT) AS filled_cells FROM ("
        + union(
            f"SELECT '{kind}' AS data_type, count({c}) AS filled FROM customer_f"
            for c, kind in zip(CUSTOMER, ("bigint", "string", "int", "double", "string"))
        )
        + ") GROUP BY data_type",
    ),
    "describe_numeric": union(
        f"SELECT '{c}' AS column_name, count({c}) AS count, "
        f"round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, "
        f"round(min(x), 4) AS min, round(quantile_cont(x, 0.25), 4) AS p25, "
        f"round(quantile_cont(x, 0.5), 4) AS p50, "
        f"round(quantile_cont(x, 0.75), 4) AS p75, round(max(x), 4) AS max "
        f"FROM (SELECT {c}, CAST({c} AS DOUBLE) AS x FROM lineitem)"
        for c in LINEITEM_NUMERIC
    ),
    "numeric_histogram": over(
        [EVENTS_F, f"vals AS ({long_values(('value', 'user_id'), 'events_f')})"],
        ","
        + bins("vals", 20)
        + " FROM grid LEFT JOIN placed USING (column_name, bin)",
    ),
    "top_values": f"""
        SELECT column_name, value, value_count, CAST(rank AS INTEGER) AS rank FROM (
          SELECT *, row_number() OVER (
            PARTITION BY column_name ORDER BY value_count DESC, value) AS rank
          FROM ({union(
              f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, "
              f"count(*) AS value_count FROM orders WHERE {c} IS NOT NULL GROUP BY {c}"
              for c in ("o_orderstatus", "o_orderpriority", "o_custkey"))}))
        WHERE rank <= 10""",
    "anomaly_stats": over(
        bands(("event_id", "user_id", "value"), 2.0),
        "SELECT column_name, round(mean, 4) AS mean, round(std, 4) AS std, "
        "round(lower_bound, 4) AS lower_bound, round(upper_bound, 4) AS upper_bound, "
        "anomaly_count, round(anomaly_percentage, 4) AS anomaly_percentage, "
        "total_count FROM counted",
    ),
    "anomaly_rows": over(
        EVENT_BANDS,
        union(
            f"SELECT '{c}' AS column_name, event_id, event_type, "
            f"round(CAST({c} AS DOUBLE), 4) AS value, "
            f"round(lower_bound, 4) AS lower_bound, "
            f"round(upper_bound, 4) AS upper_bound FROM events_f, "
            f"(SELECT * FROM stats WHERE column_name = '{c}') "
            f"WHERE {c} < lower_bound OR {c} > upper_bound"
            for c in ("value", "user_id")
        ),
    ),
    "anomaly_headline": over(
        bands(("event_id", "user_id", "value"), 2.0),
        "SELECT CAST(sum(anomaly_count) AS BIGINT) AS total_anomalies, "
        "round(avg(anomaly_percentage), 6) AS average_percentage, "
        "count(*) AS columns_analysed, "
        "count(*) FILTER (WHERE anomaly_count > 0) AS columns_with_anomalies "
        "FROM counted",
    ),
    "anomaly_histogram": over(
        EVENT_BANDS,
        ","
        + bins(
            "hits",
            10,
            ", round(mean, 4) AS mean, round(lower_bound, 4) AS lower_bound, "
            "round(upper_bound, 4) AS upper_bound",
        )
        + " FROM grid LEFT JOIN placed USING (column_name, bin) "
        "JOIN stats USING (column_name)",
    ),
    "run_history": over(
        RUNS_F,
        f"""SELECT run_id, dataset_name, {stamp('timestamp')} AS timestamp,
              round(quality_score, 6) AS quality_score, rows, columns, status
            FROM (SELECT * FROM runs_f WHERE dataset_name = 'ds_2'
                  ORDER BY runs_f.timestamp DESC, run_id DESC LIMIT 25)""",
    ),
    "last_n_runs": over(
        RUNS_F,
        f"""SELECT run_id, dataset_name, {stamp('timestamp')} AS timestamp,
              round(quality_score, 6) AS quality_score, rows, columns, status, recency
            FROM ({LAST_FIVE})""",
    ),
    "dataset_score_summary": over(
        RUNS_F,
        f"""SELECT dataset_name, count(*) AS total_runs,
              {stamp('min(timestamp)')} AS first_run,
              {stamp('max(timestamp)')} AS last_run,
              round(avg(quality_score), 6) AS score_mean,
              round(min(quality_score), 6) AS score_min,
              round(max(quality_score), 6) AS score_max,
              round(stddev_pop(quality_score), 6) AS score_std
            FROM runs_f GROUP BY dataset_name""",
    ),
    "score_trend": over(
        RUNS_F,
        f"""SELECT dataset_name, {stamp('timestamp')} AS timestamp,
              round(quality_score, 6) AS quality_score FROM ({LAST_FIVE})""",
    ),
    "history_status": over(
        RUNS_F,
        f"SELECT count(*) AS total_runs, {stamp('max(timestamp)')} AS last_updated "
        "FROM runs_f",
    ),
    "dataset_names": over(RUNS_F, "SELECT DISTINCT dataset_name FROM runs_f"),
    "run_table": over(
        RUNS_F,
        f"""SELECT run_id, dataset_name, {stamp('timestamp')} AS timestamp,
              round_even(quality_score * 100, 0) / 100 AS quality_score,
              rows, columns, status FROM runs_f""",
    ),
    "run_headline": over(
        RUNS_F,
        "SELECT run_id, round(quality_score, 6) AS quality_score, rows, columns "
        "FROM runs_f",
    ),
    "alerts_score": over(
        RUNS_F,
        low_score(
            "quality_score",
            40.0,
            "FROM runs_f WHERE quality_score < 40",
            run="run_id",
            dataset="dataset_name",
            timestamp=stamp("runs_f.timestamp"),
        ),
    ),
    "alerts_completeness": over(CUSTOMER_RESULTS, failures("completeness")),
    "alerts_uniqueness": over(CUSTOMER_RESULTS, failures("uniqueness")),
    "alerts_anomaly": over(ALERT_BANDS, ANOMALY_ALERTS),
    "alerts_union": over(ALERT_CTES, union([*suite_alerts(80.0), ANOMALY_ALERTS])),
    "alert_summary": over(
        [RUNS_F, *CUSTOMER_RESULTS],
        f"""SELECT CASE grouping(type, severity) WHEN 3 THEN 'total' WHEN 1 THEN 'type'
                     ELSE 'severity' END AS grouping,
              coalesce(type, severity) AS value, count(*) AS alerts
            FROM (SELECT 'quality_score_low' AS type, 'high' AS severity,
                         runs_f.timestamp AS raised FROM runs_f WHERE quality_score < 80
                  UNION ALL
                  SELECT type, severity, TIMESTAMP '1998-07-01'
                  FROM ({union(suite_alerts(80.0))}))
            WHERE raised > TIMESTAMP '1998-08-01' - to_hours(24 * 365)
            GROUP BY GROUPING SETS ((type), (severity), ())""",
    ),
    "alert_rules": over(
        CUSTOMER_F,
        f"""SELECT 'customer-1' AS run_id, 'customer' AS dataset_name, type, severity,
              message, '2024-01-01 00:00:00' AS timestamp, column_name, value, threshold,
              {NO_NUMBER} AS anomaly_percentage, CAST(NULL AS BIGINT) AS anomaly_count
            FROM ({RULE_HITS})""",
    ),
    "alert_outbox": over(
        CUSTOMER_RESULTS,
        f"""SELECT channel,
              CASE channel WHEN 'email' THEN 'quality@example.com'
                   ELSE 'https://hooks.example.com/quality' END AS recipients,
              type, 'Data Quality Alert: ' || type AS subject,
              'Data Quality Alert' || chr(10) || chr(10) || 'Type: ' || type || chr(10)
                || 'Severity: ' || severity || chr(10) || 'Message: ' || message
                || chr(10) || 'Timestamp: 2024-01-01T00:00:00' AS body,
              message AS payload_message
            FROM ({OUTBOX_ALERTS}), (VALUES ('email'), ('webhook')) AS routes(channel)
            WHERE route_to IS NULL OR route_to = channel""",
    ),
    "alert_payloads": over(
        CUSTOMER_RESULTS,
        f"""SELECT channel, TRUE AS details_are_payload, run_id, dataset_name, type, severity,
              message, timestamp, column_name, value, threshold, anomaly_percentage,
              anomaly_count, actions
            FROM (
              SELECT *, CAST(NULL AS VARCHAR) AS actions FROM ({union(suite_alerts(80.0))})
              UNION ALL
              SELECT 'customer-1', 'customer', type, severity, message, '2024-01-01 00:00:00',
                column_name, value, threshold, {NO_NUMBER}, CAST(NULL AS BIGINT),
                CASE WHEN type = 'too_short' THEN 'webhook' END
              FROM ({RULE_HITS})
            ), (VALUES ('email'), ('webhook')) AS routes(channel)
            WHERE actions IS NULL OR actions = channel""",
    ),
    "windowed_quality": over(EVENTS_F, windows()),
    "streamed_windows": over(
        EVENTS_F,
        windows(
            "hour + to_hours(1) <= (SELECT max(ts) FROM events_f) - to_hours(1)"
        ),
    ),
    "streamed_distinct": over(
        EVENTS_F,
        union(
            f"""SELECT {stamp("hour")} AS window_start,
                  {stamp("hour + to_hours(1)")} AS window_end,
                  '{c}' AS column_name, count(*) AS total_count,
                  count({c}) AS filled_count, count(DISTINCT {c}) AS distinct_count
                FROM (SELECT *, date_trunc('hour', ts) AS hour FROM events_f)
                WHERE hour + to_hours(1) <= (SELECT max(ts) FROM events_f) - to_hours(1)
                GROUP BY hour"""
            for c in ("user_id", "value", "event_type")
        ),
    ),
    "windowed_untimed": over(
        [
            EVENTS_F,
            "gaps AS (SELECT * REPLACE (CASE WHEN event_id % 30 <> 11 THEN ts END AS ts) "
            "FROM events_f)",
        ],
        windows()
        .replace("events_f", "gaps")
        .replace("'hour'", "'day'")
        .replace("to_hours(1)", "to_days(1)"),
    ),
    "monitor_cycle": over(
        [*EVENTS_RESULTS, *bands(("event_id", "user_id", "value"), 1.0)[1:]],
        union(
            [
                *suite_alerts(100.0, run="'events-1'", dataset="'events'"),
                ANOMALY_ALERTS,
            ]
        ),
    ),
    "intake": union(flat(completeness(c), "customer") for c in CUSTOMER),
    "cleared_alerts": over(ALERT_BANDS, ANOMALY_ALERTS),
    "alerts_system": union(
        f"SELECT 'customer' AS dataset_name, 'high' AS severity, "
        f"'Error in quality threshold checking: ' || '{error}' AS message, "
        f"'{column}' AS column_name FROM (SELECT 1 FROM customer LIMIT 1)"
        for column, error in (
            ("nowhere", "column nowhere not found"),
            ("c_name", "max 1 cannot be compared with column c_name of type string"),
            ("c_custkey", "column c_custkey is bigint, not string"),
        )
    ),
    "anomaly_infinite": over(
        [
            EVENTS_F,
            "huge AS (SELECT * REPLACE (CASE WHEN event_id % 5000 = 7 THEN 'Infinity'::DOUBLE "
            "ELSE value END AS value) FROM events_f)",
            # an infinite value leaves its column without a band, as would fewer than two
            "band AS (SELECT column_name, x, count(*) OVER w AS n, "
            "bool_or(isinf(x)) OVER w AS endless, "
            "avg(CASE WHEN NOT isinf(x) THEN x END) OVER w AS mean, "
            "stddev_samp(CASE WHEN NOT isinf(x) THEN x END) OVER w AS std "
            f"FROM ({long_values(('value', 'user_id'), 'huge')}) "
            "WINDOW w AS (PARTITION BY column_name))",
        ],
        "SELECT column_name, count(*) FILTER (WHERE NOT endless AND abs(x - mean) > 2 * std) "
        "AS anomaly_count, round(count(*) FILTER (WHERE NOT endless AND "
        "abs(x - mean) > 2 * std) * 100.0 / count(*), 6) AS anomaly_percentage, "
        "count(*) AS total_count FROM band GROUP BY column_name",
    ),
    "top_texts": f"""
        SELECT column_name, value, value_count, CAST(rank AS INTEGER) AS rank FROM (
          SELECT *, row_number() OVER (
            PARTITION BY column_name ORDER BY value_count DESC, value) AS rank
          FROM ({union(
              f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS value_count "
              f"FROM documents WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("text", "lang"))}))
        WHERE rank <= 5""",
    "uniqueness_wide": union(
        [
            *[flat(uniqueness(c), "embeddings") for c in ("vec_id", "embedding", "label")],
            *[flat(uniqueness(c), "pages") for c in ("page_id", "url", "html")],
        ]
    ),
}

# The stored, exported and streamed forms hold what the plain ones compute.
_RUN = f"""'customer' AS dataset_name, (SELECT count(*) FROM customer) AS rows,
  5 AS columns, round({score_of('results')}, 6) AS quality_score"""
ORACLE["saved_run"] = over(CUSTOMER_RESULTS, f"SELECT {_RUN}, 'completed' AS status")
ORACLE["saved_metrics"] = ORACLE["suite_results"]
ORACLE["exported_metrics"] = over(
    CUSTOMER_RESULTS,
    f"""SELECT {_RUN}, check_type, "constraint", status FROM results
        UNION ALL
        SELECT {_RUN}, 'dataset_info', 'Dataset info', NULL""",
)
ORACLE["streamed_cycle"] = over(
    [*EVENTS_RESULTS, *bands(("event_id", "user_id", "value"), 1.0)[1:]],
    f"""SELECT * EXCLUDE (run_id, timestamp) FROM ({union(
        [*suite_alerts(100.0, run="''", dataset="'events'"), ANOMALY_ALERTS])})""",
)

ORACLE["stored_run_history"] = ORACLE["run_history"]
ORACLE["stored_last_n_runs"] = ORACLE["last_n_runs"]
ORACLE["stored_score_summary"] = ORACLE["dataset_score_summary"]
ORACLE["stored_score_trend"] = ORACLE["score_trend"]
ORACLE["stored_alert_summary"] = over(
    RUNS_F,
    """SELECT CASE grouping(type, severity) WHEN 3 THEN 'total' WHEN 1 THEN 'type'
                 ELSE 'severity' END AS grouping,
          coalesce(type, severity) AS value, count(*) AS alerts
        FROM (SELECT 'quality_score_low' AS type, 'high' AS severity, runs_f.timestamp AS raised
              FROM runs_f WHERE quality_score < 40)
        WHERE raised > TIMESTAMP '1998-08-01' - to_hours(24 * 365)
        GROUP BY GROUPING SETS ((type), (severity), ())""",
)


def _grown(column: str, number: bool) -> str:
    """Measures of one column of the faulted events."""
    x = f"CAST({column} AS DOUBLE)" if number else NO_NUMBER
    share = "CASE WHEN count(*) = 0 THEN 0 ELSE round({} / count(*), 6) END"
    return f"""SELECT '{column}' AS column_name, count(*) AS total_count,
          count(*) - count({column}) AS null_count, count(DISTINCT {column}) AS distinct_count,
          {share.format(f"count({column})")} AS completeness,
          {share.format(f"count(DISTINCT {column})")} AS uniqueness,
          round(min({x}), 6) AS min, round(max({x}), 6) AS max, round(avg({x}), 6) AS mean,
          round(stddev_samp({x}), 6) AS std
        FROM events_f"""


ORACLE["grown_measures"] = over(
    EVENTS_F,
    union(
        _grown(column, column in ("event_id", "user_id", "value"))
        for column in ("event_id", "ts", "user_id", "event_type", "value", "props")
    ),
)

ORACLE["replayed_batches"] = over(
    EVENTS_F,
    "SELECT 'events' AS dataset_name, 'completed' AS status, count(*) AS rows, 6 AS columns "
    "FROM events_f GROUP BY event_id % 3",
)
# every third of the events has some without a value
ORACLE["late_rule"] = over(
    EVENTS_F,
    "SELECT 'gaps' AS type, 'medium' AS severity, 'value' AS column_name, "
    "count(DISTINCT event_id % 3) - 1 AS alerts FROM events_f WHERE value IS NULL",
)


def _observed(column: str, kind: str) -> str:
    x = f"CAST({column} AS DOUBLE)" if kind == "number" else NO_NUMBER
    empty = f"count_if({column} = '')" if kind == "text" else "CAST(NULL AS BIGINT)"
    return f"""SELECT '{column}' AS column_name, count(*) AS total_count,
          count(*) - count({column}) AS null_count,
          round(count({column}) / count(*), 6) AS completeness,
          round(min({x}), 6) AS min, round(max({x}), 6) AS max, round(avg({x}), 6) AS mean,
          round(stddev_samp({x}), 6) AS std, CAST({empty} AS BIGINT) AS empty_count
        FROM events_f"""


ORACLE["observed_write"] = over(
    EVENTS_F,
    union(
        _observed(*column)
        for column in (
            ("event_id", "number"), ("ts", "time"), ("user_id", "number"),
            ("event_type", "text"), ("value", "number"), ("props", "text"),
        )
    ),
)


def _uniqueness_with_null(c: str):
    found = f"(count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END)"
    check, label, name, metrics, condition = uniqueness(c)
    ratio = share(found)
    metrics = metrics | {"uniqueness_ratio": ratio, "distinct_count": found}
    return check, label, name, metrics, f"{ratio} >= 0.9"


ORACLE["uniqueness_with_null"] = over(
    CUSTOMER_F, union(flat(_uniqueness_with_null(c), "customer_f") for c in CUSTOMER)
)
ORACLE["top_ties"] = f"""
    SELECT 'link' AS column_name, 'https://example.com/{"customers/" * 6}' || c_name AS value,
           count(*) AS value_count, row_number() OVER (ORDER BY count(*) DESC, c_name) AS rank
    FROM customer GROUP BY c_name QUALIFY rank <= 10"""
