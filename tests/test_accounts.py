"""Folds of account logs against walks in plain Python."""

import random

from vellum.config import DAY, PLANS
from vellum.operators import accounts

TIER = {p[0]: (1 if p[6] == 0 else 0) * 1_000_000 + p[3] for p in PLANS}


def test_subscriptions_equal_a_walk(spark):
    r = random.Random(1)
    plans = ["basic", "premium", "premium3", "stars", "gone", None]
    rows = [(r.randrange(40), 1_000_000 + r.randrange(DAY * r.choice([1, 40, 400])), i, r.choice(plans), r.choice([0, 1, 30, 30, 90, None])) for i in range(2000)]

    def walk(user):
        until, held = 0, ""
        for at, _, plan, days in sorted((x[1:] for x in rows if x[0] == user), key=lambda x: x[:2]):
            plan = plan if plan in ("basic", "premium", "premium3") else "premium"
            live = until > at
            until = max(until, at) + (days or 0) * DAY
            if not (live and held != plan and TIER[plan] < TIER[held]):
                held = plan
        return until, held

    got = accounts.subscriptions(spark.createDataFrame(rows, "user_id long, at long, id long, plan string, days long")).collect()
    assert {x.user_id: (x.until, x.plan) for x in got} == {u: walk(u) for u in {x[0] for x in rows}}


def test_ledger_equals_a_walk(spark):
    r = random.Random(2)
    rows = [(r.randrange(40), 1_000_000 + r.randrange(DAY * r.choice([1, 40])), i, r.choice([-1, -1, -1, -1, -1, 5, 2, None])) for i in range(2000)]

    def walk(user):
        balance = spent = refused = 0
        for _, _, delta in sorted((x[1:] for x in rows if x[0] == user), key=lambda x: x[:2]):
            if (delta or 0) >= 0:
                balance += delta or 0
            elif balance:
                balance, spent = balance - 1, spent + 1
            else:
                refused += 1
        return balance, spent, refused

    got = accounts.ledger(spark.createDataFrame(rows, "user_id long, at long, id long, delta long")).collect()
    assert {x.user_id: (x.balance, x.spent, x.refused) for x in got} == {u: walk(u) for u in {x[0] for x in rows}}


def test_no_payments(spark):
    assert accounts.subscriptions(spark.createDataFrame([], "user_id long, at long, id long, plan string, days long")).count() == 0
    assert accounts.ledger(spark.createDataFrame([], "user_id long, at long, id long, delta long")).count() == 0
