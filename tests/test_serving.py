"""Service per component of contention against a loop that takes one request after the other."""

import random

import pytest
from pyspark.sql import functions as F

from tradewind.plans import serving
from tradewind.plans.sequence import ordered_blocks

DEMANDS = "request_id string, resource string, need long, capacity long, soft boolean"


def one_after_the_other(rows):
    room = {r[1]: r[3] for r in rows}
    taken = []
    for request in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == request]
        if all(soft or need <= room[resource] for _, resource, need, _, soft in mine):
            taken.append(request)
            for _, resource, need, _, _ in mine:
                room[resource] -= need
    return taken


def served(spark, rows):
    demands = spark.createDataFrame(rows, DEMANDS).repartition(4)
    order = ordered_blocks(demands.select("request_id").distinct(), [F.col("request_id")])
    demands = demands.join(order, "request_id")
    return sorted(r.request_id for r in serving.serve(order.select("request_id"), demands).collect())


@pytest.mark.parametrize("limit", [0, 12, 100_000])
def test_serve(spark, monkeypatch, limit):
    """All in rounds, small components in tasks and the large in rounds, all in one task."""
    monkeypatch.setattr(serving, "TASK_DEMANDS", limit)
    dice = random.Random(limit + 1)
    rows = []
    for block in range(12):  # components of different sizes, some with one resource that all want
        things = [f"{block}-{i}" for i in range(dice.randint(1, 6))]
        room = {thing: dice.randint(0, 9) for thing in things}
        for number in range(dice.randint(1, 14)):
            for thing in dice.sample(things, dice.randint(1, min(3, len(things)))):
                rows.append((f"q{dice.randrange(10)}-{block:02d}-{number:02d}", thing, dice.randint(1, 4), room[thing], dice.random() < 0.2))
    rows = list({(r[0], r[1]): r for r in rows}.values())
    assert served(spark, rows) == one_after_the_other(rows)


def chain(length):
    """Each request wants the thing of the one before and of the one after: every second is taken, each waits for the last."""
    return [(f"q{i:05d}", f"r{j:05d}", 1, 1, False) for i in range(length) for j in (i, i + 1)]


def test_a_chain_of_dependent_requests_takes_a_fixed_number_of_jobs(spark, monkeypatch):
    monkeypatch.setattr(serving, "_round", None)  # no rounds
    rows = chain(2_000)
    assert served(spark, rows) == [f"q{i:05d}" for i in range(0, 2_000, 2)]


def test_components_of_chains(spark, monkeypatch):
    monkeypatch.setattr(serving, "TASK_DEMANDS", 300)
    monkeypatch.setattr(serving, "_round", None)
    rows = [(f"{p}{a}", f"{p}{b}", *rest) for p in "xy" for a, b, *rest in chain(120)]
    assert served(spark, rows) == [f"{p}q{i:05d}" for p in "xy" for i in range(0, 120, 2)]
    state = spark.createDataFrame([(i, f"r{j}") for i in range(300) for j in (i, i + 1)] + [(900, "alone")], "seq long, resource string")
    labelled, settled = serving._components(state)
    assert settled and {r.component for r in labelled.filter("seq < 900").collect()} == {0}
    monkeypatch.setattr(serving, "COMPONENT_STEPS", 1)
    assert not serving._components(state)[1]
