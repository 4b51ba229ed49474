"""DuckDB SQL of the old report versions, the older yearly roll-up and the small checks.

Written from the KPI definitions: a loan is in a bucket if its snapshot row of the given days says
so; phones are counted per flag; every definition below is a set of (period, loan) or (period, phone) rows.
Column lists are written out here and not taken from the engine.
"""

from __future__ import annotations

import oracle_queries as O

P = "s, e"


def _periods(periods) -> str:
    return "per(s, e) AS (VALUES " + ", ".join(f"(DATE '{s}', DATE '{e}')" for s, e in periods) + ")"


def _sets(periods, *, start_only: bool, within: bool, any_day_calls: bool, rank_first: bool, day_before: bool, cap2: int) -> str:
    days = "b.bucket_date = s" if start_only else "b.bucket_date BETWEEN s AND e"
    end_day = "e - 1" if day_before else "e"
    eligible = "BETWEEN s AND e" if within else "<= e"
    in_period = "TRUE" if any_day_calls else "CAST(g.call_at AS DATE) BETWEEN s AND e"
    order = "g.call_at DESC, coalesce(g.is_apc, 0), coalesce(g.is_rpc, 0), coalesce(g.is_ptp, 0), right(g.mobile, 10), g.mobile"
    hits = "ph IN (SELECT p.ph FROM bloan p WHERE p.b = 1 AND p.s = x.s AND p.e = x.e)"
    before, after = ("TRUE", hits) if rank_first else (hits, "TRUE")
    return f"""{_periods(periods)},
number AS (SELECT customer_id, right(arg_min(mobile, (change_date, mobile)), 10) ph FROM contact_details WHERE active = 'Y' GROUP BY 1),
owner AS (SELECT loan_account, ph FROM loan_master JOIN number USING (customer_id)),
brow AS (
  SELECT s, e, CASE WHEN b.max_dpd <= 30 THEN 1 ELSE 2 END b, loan_account, ph
  FROM per JOIN bucket_flow b ON {days} JOIN owner USING (loan_account)
  WHERE b.loan_status = 'In Arrears' AND b.max_dpd BETWEEN 1 AND 60 AND b.first_due <= e),
bloan AS (SELECT s, e, b, loan_account, ph, count(*) n FROM brow GROUP BY ALL),
ended AS (
  SELECT DISTINCT s, e, loan_account, max_dpd FROM per JOIN bucket_flow b ON b.bucket_date = {end_day}
  JOIN owner USING (loan_account) WHERE b.first_due <= e),
promise AS (SELECT s, e, p.* FROM per JOIN ptp p ON CAST(p.contact_date AS DATE) BETWEEN s AND e),
keeps AS (SELECT DISTINCT s, e, loan_account FROM promise WHERE status = 1),
gap AS (SELECT DISTINCT s, e FROM keeps WHERE loan_account IS NULL),
paid AS (SELECT s, e, loan_account, sum(CASE WHEN status > 0 THEN amount ELSE 0 END) amount FROM promise GROUP BY 1, 2, 3),
flag AS (
  SELECT l.s, l.e, l.b, l.loan_account, l.ph, l.n, coalesce(d.max_dpd, 0) dpd, k.loan_account IS NOT NULL kept,
         CASE WHEN k.loan_account IS NULL AND g.s IS NULL THEN TRUE END unkept,
         l.loan_account IN (SELECT loan_account FROM ptp WHERE due_date IS NOT NULL) received, q.amount
  FROM bloan l LEFT JOIN ended d USING (s, e, loan_account) LEFT JOIN keeps k USING (s, e, loan_account)
  LEFT JOIN gap g USING (s, e) LEFT JOIN paid q USING (s, e, loan_account)),
norm AS (SELECT *, dpd <= CASE WHEN b = 1 THEN 0 ELSE {cap2} END AS well, dpd <= 30 * b AS capped FROM flag),
tally AS (
  SELECT s, e,
    count(DISTINCT CASE WHEN b = 1 AND well AND kept THEN ph END) n1, count(DISTINCT CASE WHEN b = 2 AND well AND kept THEN ph END) n2,
    count(DISTINCT CASE WHEN b = 1 AND well AND unkept THEN ph END) u1, count(DISTINCT CASE WHEN b = 2 AND well AND unkept THEN ph END) u2,
    count(DISTINCT CASE WHEN b = 1 AND capped THEN ph END) c1, count(DISTINCT CASE WHEN b = 2 AND capped THEN ph END) c2,
    count(DISTINCT CASE WHEN b = 1 THEN ph END) d1, count(DISTINCT CASE WHEN b = 2 THEN ph END) d2,
    count(DISTINCT CASE WHEN b = 1 AND kept THEN ph END) + count(DISTINCT CASE WHEN b = 2 AND kept THEN ph END) kept,
    count(DISTINCT CASE WHEN b = 1 AND received THEN ph END) + count(DISTINCT CASE WHEN b = 2 AND received THEN ph END) received,
    sum(CASE WHEN b = 1 THEN amount * n END) r1, sum(CASE WHEN b = 2 THEN amount * n END) r2,
    sum(CASE WHEN b = 1 THEN amount END) l1, sum(CASE WHEN b = 2 THEN amount END) l2,
    sum(CASE WHEN b = 1 THEN CASE WHEN well AND kept AND ph IS NOT NULL THEN amount * n ELSE 0 END END) m1,
    sum(CASE WHEN b = 2 THEN CASE WHEN well AND kept AND ph IS NOT NULL THEN amount * n ELSE 0 END END) m2
  FROM norm GROUP BY 1, 2),
okay AS (
  SELECT DISTINCT s, e, right(mobile_no, 10) ph FROM per JOIN loan_master ON CAST(disbursed_at AS DATE) {eligible}
  WHERE loan_paid_status IS NULL OR loan_paid_status NOT IN ('Settled', 'Completed')),
greet AS (
  SELECT s, e, right(g.mobile, 10) ph, coalesce(g.is_apc, 0) apc,
         row_number() OVER (PARTITION BY s, e, g.call_id ORDER BY {order}) k
  FROM calls g JOIN campaign_master c ON upper(c.campaign) = upper(g.campaign) AND c.reference = 'WC'
  JOIN okay o ON o.ph = right(g.mobile, 10) AND {in_period}),
collect AS (
  SELECT s, e, ph, mobile, is_apc FROM (
    SELECT x.*, row_number() OVER (PARTITION BY s, e, call_id ORDER BY call_at DESC, coalesce(is_apc, 0), coalesce(is_rpc, 0), coalesce(is_ptp, 0), ph, mobile) k
    FROM (SELECT s, e, right(g.mobile, 10) ph, g.* FROM per JOIN calls g ON CAST(g.call_at AS DATE) BETWEEN s AND e
          JOIN campaign_master c ON upper(c.campaign) = upper(g.campaign) AND c.reference = 'COLL' AND c.subcategory = 'SOFT') x
    WHERE {before}) x WHERE k = 1 AND {after}),
wc AS (SELECT s, e, count(DISTINCT CASE WHEN apc = 1 THEN ph END) a, count(DISTINCT ph) n FROM greet WHERE k = 1 GROUP BY 1, 2),
bc AS (SELECT s, e, count(DISTINCT CASE WHEN is_apc = 1 THEN mobile END) a, count(DISTINCT ph) n FROM collect GROUP BY 1, 2),
staff AS (
  SELECT s, e,
    (SELECT count(DISTINCT agent) FROM calls g JOIN campaign_master c ON upper(c.campaign) = upper(g.campaign)
     WHERE c.reference IN ('REM', 'COLL', 'WC') AND CAST(g.call_at AS DATE) BETWEEN s AND e) FTE,
    (SELECT count(DISTINCT loan_account) FROM loan_master WHERE flag_disbursement = 1 AND CAST(disbursed_at AS DATE) < s
     AND loan_paid_status NOT IN ('Written Off', 'Completed', 'Settled')) total_accounts,
    (SELECT count(DISTINCT loan_account) FROM bucket_flow WHERE max_dpd BETWEEN 1 AND 179 AND bucket_date = s
     AND loan_status NOT IN ('Written Off', 'Completed', 'Settled')) active_works
  FROM per)"""


def _select(columns: str) -> str:
    return f"""SELECT per.s WkstartDate, per.e WkendDate, {columns}
FROM per LEFT JOIN wc USING (s, e) LEFT JOIN bc USING (s, e) LEFT JOIN tally t USING (s, e) JOIN staff USING (s, e)"""


def _rate(a: str, b: str, name: str) -> str:
    return f"CAST(coalesce({a}, 0) AS DOUBLE) / nullif(coalesce({b}, 0), 0) {name}"


def _n(a: str, name: str) -> str:
    return f"CAST(coalesce({a}, 0) AS BIGINT) {name}"


RATES = [_rate("wc.a", "wc.n", "welcomecallcontactrate"), _rate("bc.a", "bc.n", "Bucket1callcontactrate")]
STAFF = "FTE, total_accounts, active_works"


def _money(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) + CAST({b} AS DOUBLE) totalmoneycollectedptp"


def v1(periods) -> str:
    sets = _sets(periods, start_only=True, within=True, any_day_calls=True, rank_first=True, day_before=False, cap2=60)
    return O.full(sets, _select(", ".join([
        *RATES, _n("t.n1", "bucket1normalized"), _n("t.u1", "bucket1normalizedwithoutptp"), _n("t.n2", "bucket2normalized"),
        _n("t.u2", "bucket2normalizedwithoutptp"), _n("t.kept", "kept_ptp"), _money("t.m1", "t.m2"), STAFF])))


def _v2_columns() -> str:
    return ", ".join([
        *RATES, _n("t.n1", "bucket1normalized"), _n("t.c1", "bucket1normalized_cnt"), _n("t.d1", "bucket1normalized_denominator"),
        _rate("t.c1", "t.d1", "bucket1normalized_cnt_percentage"), _n("t.u1", "bucket1normalizedwithoutptp"), _n("t.n2", "bucket2normalized"),
        _n("t.d2", "Normalized_cnt_denominator"), _n("t.c2", "bucket2normalized_cnt"), _rate("t.c2", "t.d2", "bucket2normalized_cnt_percentage"),
        _n("t.u2", "bucket2normalizedwithoutptp"), _n("t.kept", "kept_ptp"), _money("t.r1", "t.r2"), STAFF])


def v2(periods) -> str:
    return O.full(_sets(periods, start_only=True, within=True, any_day_calls=True, rank_first=False, day_before=False, cap2=0), _select(_v2_columns()))


def yearly_direct(periods) -> str:
    return O.full(_sets(periods, start_only=True, within=True, any_day_calls=True, rank_first=False, day_before=True, cap2=0), _select(_v2_columns()))


def v3(periods) -> str:
    sets = _sets(periods, start_only=False, within=False, any_day_calls=False, rank_first=False, day_before=False, cap2=0)
    return O.full(sets, _select(", ".join([
        _n("wc.a", "apc_wc_connected"), _n("wc.n", "wccalled"), _n("bc.a", "bucket1contacted"), _n("bc.n", "bucketcallcontacted"),
        _n("t.c1", "bucket1normalized_cnt"), _n("t.d1", "bucket1normalized_denominator"), _n("t.d2", "bucket2normalized_denominator"),
        _n("t.c2", "bucket2normalized_cnt"), _n("t.received", "ptp_received"), _n("t.kept", "kept_ptp"),
        "CAST(t.l1 AS DOUBLE) bucket1ptppmt", "CAST(t.l2 AS DOUBLE) bucket2ptppmt", STAFF])))


def yearly_from_monthly_v2(periods) -> str:
    lo, hi = min(s for s, _ in periods), max(e for _, e in periods)
    final = f"""SELECT min(WkstartDate) WkstartDate, max(WkendDate) WkendDate,
  CAST(sum(apc_wc_connected) AS DOUBLE) / nullif(sum(wccalled), 0) welcomecallcontactrate,
  CAST(sum(bucket1contacted) AS DOUBLE) / nullif(sum(bucketcallcontacted), 0) Bucket1callcontactrate,
  CAST(sum(bucket1normalized_cnt) AS DOUBLE) / nullif(sum(bucket1normalized_denominator), 0) bucket1normalized_cnt_percentage,
  CAST(sum(bucket2normalized_cnt) AS DOUBLE) / nullif(sum(bucket2normalized_denominator), 0) bucket2normalized_cnt_percentage,
  (SELECT count(DISTINCT agent) FROM calls g JOIN campaign_master c ON upper(c.campaign) = upper(g.campaign)
   WHERE c.reference IN ('REM', 'COLL', 'WC') AND CAST(g.call_at AS DATE) BETWEEN DATE '{lo}' AND DATE '{hi}') FTE,
  (SELECT count(DISTINCT loan_account) FROM loan_master WHERE flag_disbursement = 1 AND CAST(disbursed_at AS DATE) < DATE '{lo}'
   AND loan_paid_status NOT IN ('Written Off', 'Completed', 'Settled')) total_accounts,
  (SELECT count(DISTINCT loan_account) FROM bucket_flow WHERE max_dpd BETWEEN 1 AND 179 AND bucket_date = DATE '{lo}'
   AND loan_status NOT IN ('Written Off', 'Completed', 'Settled')) active_works,
  CAST(sum(kept_ptp) AS BIGINT) kept_ptp,
  CAST(sum(CAST(bucket1ptppmt AS DECIMAL(20,2))) AS DOUBLE) + CAST(sum(CAST(bucket2ptppmt AS DECIMAL(20,2))) AS DOUBLE) totalmoneycollectedptp
FROM r"""
    return O.compose({"r": O.v4_compat_rows(periods)}, f"SELECT * FROM ({final})")


def monthend_table(periods) -> str:
    names = {"bucket1normalized_cnt": "normalized_cnt", "bucket1normalized_denominator": "Normalized_denominator",
             "bucket2normalized_cnt": "normalized_buck2_cnt", "bucket2normalized_denominator": "Normalized_buck2_denominator"}
    counts = ["apc_wc_connected", "wccalled", "apc_rc_connected", "rccalled", "bucket1contacted", "bucketcallcontacted", "bucket1normalized_cnt",
              "bucket1normalized_denominator", "bucket2normalized_cnt", "bucket2normalized_denominator", "kept_ptp", "ptp_received"]
    sums = ", ".join([*(f"CAST(coalesce(sum({names.get(c, c)}), 0) AS BIGINT) {c}" for c in counts),
                      *(f"coalesce(CAST(sum(CAST({c} AS DECIMAL(20,2))) AS DOUBLE), 0) {c}" for c in ("bucket1ptppmt", "bucket2ptppmt"))])
    return O.compose({"r": O.report(periods)}, f"""SELECT strftime(WkstartDate, '%d-%m-%Y') StartDate, strftime(WkendDate, '%d-%m-%Y') EndDate, {sums}
FROM r GROUP BY WkstartDate, WkendDate UNION ALL SELECT 'Total', '', {sums} FROM r""")


def shared_loan_phones() -> str:
    return O.full("x AS (SELECT right(mobile_no, 10) phone10 FROM loan_master)", "SELECT phone10, count(phone10) n FROM x GROUP BY 1 HAVING count(phone10) > 1")


def loans_called_on_several_numbers(periods) -> str:
    return O.full(O._called(periods), "SELECT s WkstartDate, e WkendDate, loan_account, count(*) n FROM called GROUP BY 1, 2, 3 HAVING count(*) > 1")


def largest_overdue(periods) -> str:
    return O.full("x AS (SELECT 1)", f"""SELECT loan_account, CAST(overdue AS DOUBLE) overdue, max_dpd FROM bucket_flow
WHERE bucket_date = DATE '{periods[0][0]}' ORDER BY overdue DESC, loan_account LIMIT 20""")


# the modelling population: loans with a snapshot on both days and an observed flag
POPULATION = """pop AS (
  SELECT CAST(s.outstanding AS DOUBLE) loanRequestAmount, CASE WHEN s.overdue > 0 THEN CAST(s.overdue AS DOUBLE) END overdueAmount,
         CAST(year(m.disbursed_at) AS INTEGER) disbursementYear, m.loan_type purposeDescription, m.loan_paid_status statusDescription,
         CAST(coalesce(f.max_dpd, 0) > 30 AS INTEGER) defFPD30
  FROM loan_master m JOIN bucket_flow s ON s.loan_account = m.loan_account AND s.bucket_date = DATE '2024-01-01'
  JOIN bucket_flow f ON f.loan_account = m.loan_account AND f.bucket_date = DATE '2024-01-31' WHERE m.flag_disbursement = 1)"""
ML_COLUMNS = {"loanRequestAmount": "double", "overdueAmount": "double", "disbursementYear": "int", "purposeDescription": "string",
              "statusDescription": "string", "defFPD30": "int"}


def ml_population() -> str:
    return O.full(POPULATION, "SELECT * FROM pop")


def ml_profile() -> str:
    return O.full(POPULATION, " UNION ALL ".join(
        f"SELECT '{c}' \"column\", '{t}' dtype, count(DISTINCT {c}) n_distinct, count(*) - count({c}) n_null FROM pop" for c, t in ML_COLUMNS.items()))


def ml_onehot() -> str:
    return O.full(POPULATION, " UNION ALL ".join(
        f"SELECT '{c}' feature, {c} AS value, count(*) ones FROM pop WHERE {c} IS NOT NULL GROUP BY 2" for c in ("purposeDescription", "statusDescription")))


def ml_impute() -> str:
    return O.full(POPULATION, """SELECT 'overdueAmount' "column", 'median' strategy, quantile_cont(overdueAmount, 0.5) AS value, CAST(count(*) - count(overdueAmount) AS BIGINT) filled FROM pop
UNION ALL SELECT 'loanRequestAmount', 'mean', avg(loanRequestAmount), CAST(count(*) - count(loanRequestAmount) AS BIGINT) FROM pop""")


def every() -> dict[str, str]:
    year = [("2024-01-01", "2024-01-31")]
    return {
        "kpi_report_v1": v1(O.MULTI), "kpi_report_v2": v2(O.MULTI), "kpi_report_v3": v3(O.MULTI), "yearly_direct": yearly_direct(year),
        "yearly_from_monthly_v2": yearly_from_monthly_v2(O.MULTI), "monthend_table": monthend_table(O.MULTI),
        "shared_loan_phones": shared_loan_phones(), "loans_called_on_several_numbers": loans_called_on_several_numbers(O.MAIN),
        "largest_overdue": largest_overdue(O.MAIN), "ml_population": ml_population(), "ml_profile": ml_profile(), "ml_onehot": ml_onehot(), "ml_impute": ml_impute(),
    }
