"""Credits: prices, debits, balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import timeblocks
from tallyloom.operators.reports import CREDITS_PER_REPORT

#: The credits an outcome costs; a refresh has a range, so its price is an argument.
PRICES = {"unresolved": 0, "success": 5, "failure": 0, "contact_not_found": 5}


def affordable(credits: Column) -> Column:
    return F.floor(credits / CREDITS_PER_REPORT)


def can_afford(credits: Column) -> Column:
    return credits >= CREDITS_PER_REPORT


def debit(balance: Column, charged: Column) -> Column:
    """The balance after a report; a charge of 0 or none counts as the standard price."""
    return balance - F.coalesce(F.nullif(charged, F.lit(0)), F.lit(CREDITS_PER_REPORT))


def signed(kind: Column, amount: Column) -> Column:
    """Debits count against the balance; credits, refunds and adjustments for it."""
    return F.when(kind == "debit", -amount).otherwise(amount)


def is_credit_text(amount: Column) -> Column:
    """Whether an amount as shown is a credit: it starts with a plus."""
    return F.startswith(amount, F.lit("+"))


def balances(entries: DataFrame, owner: str, kind: str, amount: str) -> DataFrame:
    return entries.groupBy(owner).agg(F.sum(signed(F.col(kind), F.col(amount))).alias("balance"))


def running(entries: DataFrame, owner: str, kind: str, amount: str, order: list[str], unit: str = "day") -> DataFrame:
    """Each entry with its owner's balance after it, by order (a time first). Sums run within blocks of time and across
    them (unit), so that no task holds a whole owner's ledger."""
    return timeblocks.running_sum(entries, owner, order, signed(F.col(kind), F.col(amount)), "running_balance", unit)


def settlement(entries: DataFrame, job: str, kind: str, amount: str, charged: DataFrame) -> DataFrame:
    """Per job: net of its entries against what it was charged; charged: (job, credits_charged)."""
    net = entries.groupBy(job).agg(F.sum(signed(F.col(kind), F.col(amount))).alias("net"))
    return charged.join(net, job, "left").select(
        job, "credits_charged", F.coalesce("net", F.lit(0)).alias("net"), (F.coalesce("net", F.lit(0)) + F.col("credits_charged") != 0).alias("mismatch")
    )


def price(outcome: Column, refresh: int = 1) -> Column:
    prices = F.create_map(*(F.lit(x) for pair in PRICES.items() for x in pair))
    return F.when(outcome == "refresh", refresh).otherwise(prices[outcome])


def usage_share(used: Column, granted: Column) -> Column:
    """Share of the granted credits that is left, in percent; null where nothing was granted."""
    return F.floor((1 - F.sum(used) / F.nullif(F.sum(granted), F.lit(0))) * 100)
