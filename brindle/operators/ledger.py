"""Credit ledger and coupon rules over integer money, with an explicit time instead of the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.scalars import at_least_zero, not_ended, started
from brindle.operators.windows import carried_before


def running_balance(tx: DataFrame, user: str, amount: str, at: str, tx_id: str, reserved: str | None = None) -> DataFrame:
    """balance_after of each row in order of time and id; reserved_after with a column of reserved amounts."""
    w = Window.partitionBy(user).orderBy(at, tx_id).rowsBetween(Window.unboundedPreceding, 0)
    out = tx.withColumn("balance_after", F.sum(amount).over(w))
    return out.withColumn("reserved_after", F.sum(reserved).over(w)) if reserved else out


def wallet_summary(users: DataFrame, user: str, wallets: DataFrame, owner: str, columns: list[str]) -> DataFrame:
    """Each user's wallet, zeros where there is none; nothing is written by a read."""
    w = wallets.select(F.col(owner).alias("_owner"), *columns)
    return users.join(w, F.col(user) == F.col("_owner"), "left").select(user, *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])


def with_usage(coupons: DataFrame, usages: DataFrame, user: Column) -> DataFrame:
    """used_by_user: how often the user has used each coupon."""
    n = usages.filter(F.col("user_id") == user).groupBy(F.col("coupon_id").alias("_c")).agg(F.count("*").alias("used_by_user"))
    return coupons.join(n, F.col("coupon_id") == F.col("_c"), "left").drop("_c").withColumn("used_by_user", F.coalesce("used_by_user", F.lit(0)))


def _rungs(as_of: Column) -> dict[str, Column]:
    c = F.col
    return {
        "inactive": c("status") != "ACTIVE",
        "early": ~started(c("starts_at"), as_of),
        "late": ~not_ended(c("expires_at"), as_of),
        "exhausted": c("max_uses").isNotNull() & (c("used_count") >= c("max_uses")),
        "limit": c("used_by_user") >= c("per_user_limit"),
        "checkout": c("redemption_type") != "DIRECT_REDEEM",
        "no_credits": c("credit_amount").isNull(),
    }


# The reasons, in the order of the rungs.
INSPECT = [("inactive", "Coupon inactive"), ("early", "Coupon not started"), ("late", "Coupon expired"), ("exhausted", "Coupon exhausted")]
REDEEM = [
    ("inactive", "Coupon inactive"), ("checkout", "Coupon requires checkout"), ("no_credits", "Coupon has no redeemable credits"),
    ("early", "Coupon not started"), ("late", "Coupon expired"), ("exhausted", "Coupon exhausted"), ("limit", "Redemption limit reached"),
]
LIMIT, MISSING, INVALID = "Redemption limit reached", "No coupon found", "Invalid coupon"


def _ladder(steps: list[tuple[str, str]], as_of: Column) -> Column:
    rungs, out = _rungs(as_of), None
    for name, reason in steps:
        out = F.when(rungs[name], reason) if out is None else out.when(rungs[name], reason)
    return out


def inspect(coupons: DataFrame, as_of: Column) -> DataFrame:
    """Rows with used_by_user and a null status where no coupon was found. Adds valid, redeemable, reason, remaining_uses,
    per_user_remaining and credits_preview."""
    rungs = _rungs(as_of)
    reason = F.when(F.col("status").isNull(), MISSING).otherwise(_ladder(INSPECT, as_of))
    out = coupons.withColumn("_reason", reason).withColumn("valid", F.col("_reason").isNull())
    ok = F.col("valid")
    return (
        out.withColumn("redeemable", ok & ~rungs["limit"] & ~rungs["checkout"] & ~rungs["no_credits"])
        .withColumn("reason", F.coalesce("_reason", F.when(ok & rungs["limit"], LIMIT)))
        .withColumn("remaining_uses", F.when(ok, at_least_zero(F.col("max_uses") - F.col("used_count"))))
        .withColumn("per_user_remaining", F.when(ok, at_least_zero(F.col("per_user_limit") - F.col("used_by_user"))))
        .withColumn("credits_preview", F.when(ok, F.col("credit_amount")))
        .withColumn("redeemable", F.coalesce("redeemable", F.lit(False)))
        .drop("_reason")
    )


def redeem_reason(as_of: Column) -> Column:
    """The first reason against redeeming, null if there is none."""
    return F.when(F.col("status").isNull(), INVALID).otherwise(_ladder(REDEEM, as_of))


def redeem_log(attempts: DataFrame, coupons: DataFrame, usages: DataFrame) -> DataFrame:
    """Outcome of attempts (attempt_id, user_id, coupon_id, at) replayed in order of time and id: reason, null if accepted.

    Equal to one after another: an attempt counts against its user's limit, and then against the coupon's, only if it
    passes the rungs before. A coupon has at most max_uses accepted rows, a user at most per_user_limit.
    """
    used = usages.groupBy(F.col("user_id").alias("_u"), F.col("coupon_id").alias("_c")).agg(F.count("*").alias("used_by_user"))
    c = coupons.withColumnRenamed("coupon_id", "_cid")
    a = attempts.join(c, F.col("coupon_id") == F.col("_cid"), "left").join(used, (F.col("user_id") == F.col("_u")) & (F.col("coupon_id") == F.col("_c")), "left")
    a = a.withColumn("used_by_user", F.coalesce("used_by_user", F.lit(0)))
    before = [s for s in REDEEM if s[0] not in ("exhausted", "limit")]
    a = a.withColumn("_early", F.when(F.col("status").isNull(), INVALID).otherwise(_ladder(before, F.col("at"))))
    live = F.col("_early").isNull()
    in_order = ["at", "attempt_id"]
    mine = Window.partitionBy("coupon_id", "user_id").orderBy(*in_order).rowsBetween(Window.unboundedPreceding, 0)
    a = a.withColumn("_within", live & (F.sum(live.cast("long")).over(mine) + F.col("used_by_user") <= F.col("per_user_limit")))
    a = carried_before(a, ["coupon_id"], in_order, None, F.col("_within").cast("long"), "_taken")
    taken = F.col("_taken") + F.col("used_count")
    full = F.col("max_uses").isNotNull() & (taken >= F.col("max_uses"))
    reason = F.coalesce("_early", F.when(full, "Coupon exhausted").when(~F.col("_within"), LIMIT))
    return a.select("attempt_id", "user_id", "coupon_id", "at", "credit_amount", reason.alias("reason"))


def redeem_effects(outcome: DataFrame, coupons: DataFrame, wallets: DataFrame) -> dict[str, DataFrame]:
    """What accepted attempts change: usages, ledger rows with balances, wallets and coupons."""
    ok = outcome.filter(F.col("reason").isNull())
    usages = ok.select("user_id", "coupon_id", F.lit(0).alias("discount_applied"), F.col("credit_amount").alias("credits_granted"), F.col("at").alias("created_at"))
    start = wallets.select(F.col("user_id").alias("_u"), F.col("balance").alias("_b"))
    named = coupons.select(F.col("coupon_id").alias("_c"), "code")
    ledger = ok.join(start, F.col("user_id") == F.col("_u"), "left").join(named, F.col("coupon_id") == F.col("_c"))
    w = Window.partitionBy("user_id").orderBy("at", "attempt_id").rowsBetween(Window.unboundedPreceding, 0)
    ledger = ledger.select(
        "attempt_id", "user_id", F.lit("COUPON").alias("type"), F.col("credit_amount").alias("amount"),
        (F.coalesce("_b", F.lit(0)) + F.sum("credit_amount").over(w)).alias("balance_after"),
        F.concat(F.lit("Redeemed "), F.col("code")).alias("description"), F.lit("COUPON_REDEMPTION").alias("source"),
    )
    gained = ok.groupBy(F.col("user_id").alias("_u")).agg(F.sum("credit_amount").alias("_g"))
    after = wallets.join(gained, F.col("user_id") == F.col("_u"), "full")
    zero = F.lit(0)
    after = after.select(F.coalesce("user_id", "_u").alias("user_id"), *[(F.coalesce(c, zero) + F.coalesce("_g", zero)).alias(c) for c in ("balance", "lifetime_earned")])
    times = ok.groupBy(F.col("coupon_id").alias("_c")).agg(F.count("*").alias("_n"))
    used = coupons.join(times, F.col("coupon_id") == F.col("_c"), "left").withColumn("used_count", F.col("used_count") + F.coalesce("_n", zero)).drop("_c", "_n")
    return {"usages": usages, "ledger": ledger, "wallets": after, "coupons": used}


def discounted(total: Column, percent: Column, fixed: Column, minimum: Column) -> Column:
    """What is to pay: percent first, else a fixed amount, nothing off below the minimum purchase, never below zero."""
    off = F.coalesce(F.floor(total * percent / 100).cast("bigint"), fixed, F.lit(0))
    return F.greatest(F.lit(0), total - F.when(F.coalesce(minimum, F.lit(0)) <= total, off).otherwise(0))
