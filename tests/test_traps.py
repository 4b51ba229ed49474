"""Hand-made trap fixtures (FIXTURES.md §3)."""

import datetime as dt
from decimal import Decimal

from fixtures import D, TS, call, contact, loan, make_tables, snap

from dunlin.operators import contact as C
from dunlin.operators import migration as M
from dunlin.operators import ptp as P
from dunlin.operators import staffing as ST
from dunlin.sources.periods import Periods, month_to_date, weekly

WEEK = Periods.of(("2024-01-08", "2024-01-14"))


def test_last_leg_later_leg_wins_and_ties_prefer_zero(spark):
    t = make_tables(
        spark,
        loans=[loan("L1", 1, "630000000001"), loan("L2", 2, "630000000002")],
        calls=[
            call("C1", TS(2024, 1, 9, 10), "630000000001", apc=1),
            call("C1", TS(2024, 1, 9, 11), "630000000001", apc=0),   # later leg, APC 0 -> not connected
            call("C2", TS(2024, 1, 10, 10), "630000000002", apc=1),
            call("C2", TS(2024, 1, 10, 10), "630000000002", apc=0),  # same time: APC 0 wins
        ])
    r = C.welcome_call_contact_rate(t, WEEK).collect()[0]
    assert (r.apc_wc_connected, r.wccalled) == (0, 2)


def test_phone_key_short_null_and_two_forms(spark):
    t = make_tables(
        spark,
        loans=[loan("L1", 1, "12345"), loan("L2", 2, None), loan("L3", 3, "630000000009")],
        calls=[call("C1", TS(2024, 1, 9), "12345"), call("C2", TS(2024, 1, 9), None),
               call("C3", TS(2024, 1, 9), "00000000009"), call("C4", TS(2024, 1, 9), "630000000009", apc=0)])
    r = C.welcome_call_contact_rate(t, WEEK).collect()[0]
    # '12345' joins whole; NULL never joins; '0…9' and '63…9' are one 10-digit key
    assert r.wccalled == 2 and r.apc_wc_connected == 2


def test_inverted_period_and_zero_denominator(spark):
    t = make_tables(spark, loans=[loan("L1", 1, "630000000001")],
                    calls=[call("C1", TS(2024, 1, 9), "630000000001")])
    p = Periods.of(("2024-01-14", "2024-01-08"))
    r = C.welcome_call_contact_rate(t, p).collect()[0]
    assert (r.apc_wc_connected, r.wccalled, r.WelcomeCall_ContactRate) == (0, 0, None)


def test_null_dpd_is_zero_and_missing_end_is_normalized(spark):
    t = make_tables(spark, snapshot=[
        snap("A", D(2024, 1, 8), 5), snap("A", D(2024, 1, 14), None),   # NULL end DPD -> 0 -> normalised
        snap("B", D(2024, 1, 8), 10),                                     # no end row -> normalised
        snap("C", D(2024, 1, 8), 10), snap("C", D(2024, 1, 14), 17),     # worse -> not
        snap("D", D(2024, 1, 8), None),                                   # NULL start DPD = 0: not in bucket 1
    ])
    r = M.bucket_normalization(t, WEEK, 1).collect()[0]
    assert (r.normalized_cnt, r.Normalized_denominator) == (2, 3)


def test_null_status_open_for_calls_closed_for_accounts(spark):
    t = make_tables(spark, loans=[loan("L1", 1, "630000000001", status=None)],
                    calls=[call("C1", TS(2024, 1, 9), "630000000001")])
    assert C.welcome_call_contact_rate(t, WEEK).collect()[0].wccalled == 1
    assert ST.total_accounts(t, WEEK).collect()[0].total_accounts == 0


def _ptp_tables(spark, ptp_rows):
    return make_tables(
        spark, loans=[loan("L1", 1, "630000000001"), loan("L2", 2, "630000000002")],
        contacts=[contact(1, "630000000001"), contact(2, "630000000002")],
        snapshot=[snap("L1", D(2024, 1, 9), 10), snap("L1", D(2024, 1, 14), 0, status="Normal"),
                  snap("L2", D(2024, 1, 9), 12), snap("L2", D(2024, 1, 14), 0, status="Normal")],
        ptp=ptp_rows)


def test_not_in_with_null_key_nullifies(spark):
    rows = [("L1", 1, TS(2024, 1, 10), D(2024, 1, 13), 1, Decimal("5.00")),
            (None, 9, TS(2024, 1, 10), D(2024, 1, 13), 1, Decimal("1.00"))]
    f = {r.loan_account: r for r in P.ptp_flags(_ptp_tables(spark, rows), WEEK, 1).collect()}
    assert f["L1"].Normalized == "0000000001"
    assert f["L2"].Normalizedwithoutptp is None          # NULL in the kept set -> NOT IN is NULL
    rows2 = rows[:1]
    f2 = {r.loan_account: r for r in P.ptp_flags(_ptp_tables(spark, rows2), WEEK, 1).collect()}
    assert f2["L2"].Normalizedwithoutptp == "0000000002"


def test_ptp_before_period_is_received_not_kept(spark):
    rows = [("L1", 1, TS(2023, 12, 1), D(2023, 12, 4), 1, Decimal("5.00"))]
    r = P.ptp_received_kept(_ptp_tables(spark, rows), WEEK).collect()[0]
    assert (r.ptp_received, r.kept_ptp) == (1, 0)


def test_shared_phone_counts_in_both_buckets(spark):
    t = make_tables(
        spark, loans=[loan("L1", 1, "x"), loan("L2", 1, "x")], contacts=[contact(1, "630000000001")],
        snapshot=[snap("L1", D(2024, 1, 9), 10), snap("L2", D(2024, 1, 9), 40)],
        ptp=[("L1", 1, TS(2023, 12, 1), D(2023, 12, 4), 0, Decimal("1.00")),
             ("L2", 1, TS(2023, 12, 1), D(2023, 12, 4), 0, Decimal("1.00"))])
    assert P.ptp_received_kept(t, WEEK).collect()[0].ptp_received == 2


def test_self_dating_periods():
    # Wednesday 2024-01-17: previous Mon-Sun week is 8..14, Sun-Sat week 7..13
    assert weekly("2024-01-17").spans[0][:2] == (D(2024, 1, 8), D(2024, 1, 14))
    assert weekly("2024-01-17", "SAT").spans[0][:2] == (D(2024, 1, 7), D(2024, 1, 13))
    # 2024-01-03 (Wed): last Sunday is 2023-12-31, before the month start -> empty period
    s, e, _ = month_to_date("2024-01-03").spans[0]
    assert s == D(2024, 1, 1) and e == D(2023, 12, 31)
