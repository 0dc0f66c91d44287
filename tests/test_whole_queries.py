"""Registered queries read whole tables."""

from lumenframe.plans.queries import QUERIES
from tests.conftest import DATA


def test_every_event_is_a_vote(spark, duck):
    rows = QUERIES["detector_consensus"](spark, DATA).collect()
    errors = duck.sql("select count(*) from events join customer on c_custkey = user_id where event_type not in ('click', 'view', 'purchase', 'signup') or user_id % 11 = 4").fetchall()[0][0]
    silent = duck.sql("select count(*) from events join customer on c_custkey = user_id where event_type in ('click', 'view', 'purchase', 'signup') and user_id % 11 = 5 and event_id % 50 > 0").fetchall()[0][0]
    votes = duck.sql("select count(*) from events join customer on c_custkey = user_id").fetchall()[0][0]
    assert sum(r["n_errors"] for r in rows) == errors and sum(r["n_responding"] for r in rows) == votes - errors - silent
    assert {r["label"] for r in rows} == {"human", "ai", "unsure", "skipped"}
