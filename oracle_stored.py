"""DuckDB SQL of the queries over stored layouts, stored sets and checked tables."""

from __future__ import annotations

import oracle_queries as O


def staffing(periods) -> str:
    parts = {"f": O.fte(periods), "t": O.total_accounts(periods), "a": O.active_works(periods)}
    return O.compose(parts, "SELECT * FROM f JOIN t USING (WkstartDate, WkendDate) JOIN a USING (WkstartDate, WkendDate)")


MONTHS = [("2023-12-18", "2023-12-24"), ("2023-12-25", "2023-12-31"), ("2024-01-01", "2024-01-07"), ("2024-01-22", "2024-01-28")]
V4 = """WkstartDate WkendDate apc_wc_connected wccalled bucket1contacted bucketcallcontacted bucket1normalized_cnt bucket1normalized_denominator
bucket2normalized_denominator bucket2normalized_cnt ptp_received kept_ptp bucket1ptppmt bucket2ptppmt FTE total_accounts active_works""".split()


def generations(periods) -> str:
    """v4 rows of the first two periods and newest rows of the others under one another; a column that a row lacks is NULL."""
    new = [c for c in O.REPORT_COLUMNS if c not in V4]
    parts = {"o": O.report_v4(periods[:2]), "n": O.report(periods[2:])}
    typed = lambda c: "BIGINT" if c in O.LONG_COLS else "DOUBLE"
    older = ", ".join([*V4, *(f"CAST(NULL AS {typed(c)}) {c}" for c in new)])
    newer = ", ".join([*(c if c in O.REPORT_COLUMNS else f"CAST(NULL AS BIGINT) {c}" for c in V4), *new])
    return O.compose(parts, f"SELECT {older} FROM o UNION ALL SELECT {newer} FROM n")


def generation_difference(periods) -> str:
    """Column names from DuckDB's description of the two selections."""
    o, n = O.report_v4(periods[:1]), O.report(periods[:1])
    kind = "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'HUGEINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' ELSE 'date' END"
    return f"""WITH a AS (SELECT column_name c, row_number() OVER () - 1 k, {kind} t FROM (DESCRIBE {o})),
b AS (SELECT column_name c, row_number() OVER () - 1 k, {kind} t FROM (DESCRIBE {n}))
SELECT CAST(a.k AS INTEGER) AS position, a.c AS "column", CASE WHEN b.c IS NULL THEN 'missing' ELSE 'type' END AS change, a.t AS declared_type, b.t AS frame_type
FROM a LEFT JOIN b USING (c) WHERE b.c IS NULL OR a.t <> b.t
UNION ALL SELECT CAST((SELECT count(*) FROM a) + row_number() OVER (ORDER BY b.k) - 1 AS INTEGER), b.c, 'extra', NULL, b.t FROM b LEFT JOIN a USING (c) WHERE a.c IS NULL"""


def column_use(periods) -> str:
    cols = [*V4, *(c for c in O.REPORT_COLUMNS if c not in V4)]
    each = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) n_rows, count({c}) n_values FROM r" for c in cols)
    return O.compose({"r": generations(periods)}, each)


def _monthend_lines(periods) -> tuple[str, list[str], dict]:
    src = {"bucket1normalized_cnt": "normalized_cnt", "bucket1normalized_denominator": "Normalized_denominator",
           "bucket2normalized_denominator": "Normalized_buck2_denominator", "bucket2normalized_cnt": "normalized_buck2_cnt"}
    cols = ["apc_wc_connected", "wccalled", "apc_rc_connected", "rccalled", "bucket1contacted", "bucketcallcontacted", "bucket1normalized_cnt",
            "bucket1normalized_denominator", "bucket2normalized_denominator", "bucket2normalized_cnt", "ptp_received", "kept_ptp",
            "bucket1ptppmt", "bucket2ptppmt", "FTE", "total_accounts", "active_works"]
    return O.report(periods), cols, src


def monthend_csv_rows(periods) -> str:
    """The third layout has no reminder calls."""
    r, cols, src = _monthend_lines(periods)
    value = lambda c: f"CASE WHEN (row_number() OVER (ORDER BY WkstartDate) - 1) % 3 < 2 THEN {c} END" if c in ("apc_rc_connected", "rccalled") else src.get(c, c)
    return O.compose({"r": r}, f"""SELECT strftime(WkstartDate, '%d-%m-%Y') WkstartDate, strftime(WkendDate, '%d-%m-%Y') WkendDate,
  {", ".join(f"{value(c)} {c}" for c in cols)}, WkstartDate period_start, WkendDate period_end FROM r""")


def monthend_csv_rejects(periods) -> str:
    """One broken line for each row: a field too many in the first two layouts, no number at the end of the third."""
    r, cols, src = _monthend_lines(periods)
    dates = ["strftime(WkstartDate, '%d-%m-%Y')", "strftime(WkendDate, '%d-%m-%Y')"]
    text = lambda names: "concat_ws(',', " + ", ".join([*dates, *(f"coalesce(CAST({src.get(c, c)} AS VARCHAR), '')" for c in names)]) + ")"
    short = [c for c in cols[:-1] if c not in ("apc_rc_connected", "rccalled")]
    return O.compose({"r": r}, f"""SELECT CASE k WHEN 0 THEN {text(cols)} || ',1' WHEN 1 THEN '0,' || {text(cols)} || ',1' ELSE '0,' || {text(short)} || ',x' END AS line,
  CASE k WHEN 0 THEN 'fields: 20 of 19' WHEN 1 THEN 'fields: 21 of 20' ELSE 'active_works' END AS reason
FROM (SELECT *, (row_number() OVER (ORDER BY WkstartDate) - 1) % 3 k FROM r)""")


def margins(periods) -> str:
    sums = {"bucket1normalized_cnt": "normalized_cnt", "bucket1normalized_denominator": "Normalized_denominator",
            "bucket2normalized_cnt": "normalized_buck2_cnt", "bucket2normalized_denominator": "Normalized_buck2_denominator"}
    counts = ["apc_wc_connected", "wccalled", "apc_rc_connected", "rccalled", "bucket1contacted", "bucketcallcontacted", *sums, "kept_ptp", "ptp_received"]
    cols = ", ".join([*(f"CAST(coalesce(sum({sums.get(c, c)}), 0) AS BIGINT) {c}" for c in counts),
                      *(f"coalesce(CAST(sum(CAST({c} AS DECIMAL(20,2))) AS DOUBLE), 0) {c}" for c in ("bucket1ptppmt", "bucket2ptppmt"))])
    return O.compose({"r": O.report(periods)}, f"""SELECT CASE WHEN grouping(y) = 1 THEN 'Total' ELSE CAST(y AS VARCHAR) END AS "year",
  CASE WHEN grouping(m) = 1 THEN 'Total' ELSE CAST(m AS VARCHAR) END AS "month", count(*) n_periods, {cols}
FROM (SELECT *, year(WkstartDate) y, month(WkstartDate) m FROM r) GROUP BY ROLLUP (y, m)""")


# every rule's period of every day with calls; DuckDB counts days of the week from Sunday = 0
RULES = """seen AS (SELECT DISTINCT CAST(ts AS DATE) d FROM events WHERE ts IS NOT NULL),
spans AS (
  SELECT d, 'week_to_sunday' AS rule, d - CAST(dayofweek(d) + 6 AS INTEGER) s, d - CAST(dayofweek(d) AS INTEGER) e FROM seen UNION ALL
  SELECT d, 'week_to_saturday', d - CAST(dayofweek(d) + 7 AS INTEGER), d - CAST(dayofweek(d) + 1 AS INTEGER) FROM seen UNION ALL
  SELECT d, 'current_week', CAST(date_trunc('week', d) AS DATE), d + 7 - CAST(dayofweek(d) AS INTEGER) FROM seen UNION ALL
  SELECT d, 'month_to_sunday', CAST(date_trunc('month', d) AS DATE), d - CAST(dayofweek(d) AS INTEGER) FROM seen UNION ALL
  SELECT d, 'year_to_date', DATE '2023-01-01', d FROM seen UNION ALL
  SELECT d, 'day_before', d - 1, d - 1 FROM seen)"""


def period_rules() -> str:
    return f"WITH {RULES} SELECT d AS as_of, rule, s AS WkstartDate, e AS WkendDate FROM spans"


def fte_self_dated() -> str:
    return O.full(RULES + """,
worked AS (SELECT DISTINCT CAST(call_at AS DATE) AS day, agent FROM calls JOIN campaign_master c ON upper(c.campaign) = upper(calls.campaign)
  WHERE reference IN ('REM', 'COLL', 'WC'))""", """SELECT d AS as_of, rule, s AS WkstartDate, e AS WkendDate, count(DISTINCT agent) AS FTE
FROM spans LEFT JOIN worked ON worked.day BETWEEN s AND e GROUP BY ALL""")


def every() -> dict[str, str]:
    return {
        "bucket_normalization_1_stored": O.normalization(O.MAIN, 1),
        "recovery_wide_stored": O.recovery_wide(O.MAIN),
        "staffing_from_sets_weeks": staffing(O.MULTI),
        "yearly_from_sets": O.yearly_from_monthly(O.MULTI),
        "monthend_csv_rows": monthend_csv_rows(O.MULTI),
        "monthend_csv_rejects": monthend_csv_rejects(O.MULTI),
        "kpi_generations": generations(O.MULTI),
        "kpi_generation_difference": generation_difference(O.MULTI),
        "kpi_column_use": column_use(O.MULTI),
        "kpi_published": O.report(O.MULTI),
        "kpi_restored": O.report(O.MULTI[:3]),
        "monthend_margins": margins(MONTHS),
        "period_rules": period_rules(),
        "fte_self_dated": fte_self_dated(),
        "bucket_transitions_stored": O.transitions(O.MAIN, 1),
    }
