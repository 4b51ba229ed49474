"""Business-rule switches that changed across the report versions.

One implementation, parameterised; each old report is a preset.  ``DEFAULT`` is
the latest (v5+) rule set.  An operator either applies a switch or raises
(:meth:`Rules.require`); none ignores one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Rules:
    # welcome/reminder: loans disbursed within the period (True) or up to its end (False)
    disbursed_within_period: bool = False
    # welcome/reminder: filter calls to the period's days
    welcome_date_filter: bool = True
    # bucket contact and promises: DPD in the bucket on any day of the period ('any') or on the start day ('start')
    bucket_membership: str = "any"
    # bucket contact: pick a call's last leg among all its legs (True) or among those to bucket phones (False)
    rank_before_bucket: bool = False
    # bucket normalisation numerator:
    #   'le_start'     end DPD <= start DPD, counted on loans (v5+)
    #   'le_cap'       end DPD <= bucket cap, counted on phones (v2, v3, yearly)
    #   'le_cap_paid'  same and a payment in the period (v4)
    #   'kept'         no cap numerator; only those with and without a kept promise (v1)
    normalized_rule: str = "le_start"
    # bucket 2 with and without a kept promise: end DPD = 0 (v2+) or <= 60 (v1)
    bucket2_normalized_cap: int = 0
    # end snapshot: the day before the period end, with first due <= period end (True)
    end_snapshot_day_before: bool = False
    # promise payments: once per (period, loan) ('loan'), per snapshot row ('row'), or
    # per snapshot row whose loan normalised with a kept promise ('normalized')
    promise_amounts: str = "loan"

    def with_(self, **kw) -> "Rules":
        return replace(self, **kw)

    def require(self, **expected) -> None:
        """Raise unless every named switch has the given value (or one of the given tuple)."""
        for k, want in expected.items():
            have = getattr(self, k)
            if have not in (want if isinstance(want, tuple) else (want,)):
                raise ValueError(f"this operator does not support rules with {k}={have!r}; supported: {want!r}")


DEFAULT = Rules()

PRESETS = {
    "v1": Rules(disbursed_within_period=True, welcome_date_filter=False, bucket_membership="start", rank_before_bucket=True,
                normalized_rule="kept", bucket2_normalized_cap=60, promise_amounts="normalized"),
    "v2": Rules(disbursed_within_period=True, welcome_date_filter=False, bucket_membership="start",
                normalized_rule="le_cap", promise_amounts="row"),
    "v3": Rules(disbursed_within_period=False, welcome_date_filter=True, bucket_membership="any",
                normalized_rule="le_cap"),
    "v4a": Rules(disbursed_within_period=True, welcome_date_filter=False, bucket_membership="any",
                 normalized_rule="le_cap_paid"),
    "v4": Rules(disbursed_within_period=False, welcome_date_filter=True, bucket_membership="any",
                normalized_rule="le_cap_paid"),
    "v5": DEFAULT,
    "yearly": Rules(disbursed_within_period=True, welcome_date_filter=False, bucket_membership="start",
                    normalized_rule="le_cap", end_snapshot_day_before=True, promise_amounts="row"),
}
