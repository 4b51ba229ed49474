"""Tiny hand-made input tables for the trap cases."""

import datetime as dt
from decimal import Decimal

from dunlin import schema as S
from dunlin.sources.derived import CAMPAIGNS
from dunlin.sources.tables import Tables

D = dt.date
TS = dt.datetime


def make_tables(spark, loans=(), calls=(), contacts=(), snapshot=(), installments=(), ptp=()):
    mk = lambda rows, sch: spark.createDataFrame(list(rows), sch)
    return Tables(
        loan_master=mk(loans, S.LOAN_MASTER), calls=mk(calls, S.CALLS),
        campaign_master=mk(CAMPAIGNS, S.CAMPAIGN_MASTER), contact_details=mk(contacts, S.CONTACT_DETAILS),
        bucket_flow=mk(snapshot, S.BUCKET_FLOW), installments=mk(installments, S.INSTALLMENTS), ptp=mk(ptp, S.PTP))


def loan(acct, cust, mobile, status="Normal", disb=TS(2023, 1, 1), flag=1):
    return (acct, cust, mobile, "LOW", disb, status, flag)


def call(cid, at, mobile, campaign="SIGNUP", apc=1, rpc=0, ptp=0, agent="A"):
    return (cid, at, mobile, campaign, agent, apc, rpc, ptp, "G", "E1", apc, None if apc is None else 1 - apc, None)


def snap(acct, day, dpd, status="In Arrears", out="100.00", od="10.00", first_due=D(2023, 12, 1)):
    return (acct, day, dpd, status, Decimal(out), Decimal(od), first_due)


def contact(cust, mobile, day=D(2023, 1, 1), active="Y"):
    return (cust, mobile, day, active)
