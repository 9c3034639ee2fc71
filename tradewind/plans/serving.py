"""Serving requests one after the other when they compete for what there is."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

# A component of contention with at most so many demands is served in order inside one task.
TASK_DEMANDS = 100_000
# Components are found in so many steps at most; what is not settled then is served in rounds.
COMPONENT_STEPS = 30


def serve(requests: DataFrame, demands: DataFrame) -> DataFrame:
    """request_ids that a one-by-one service accepts.

    `requests`: the request_ids to serve. `demands`: what they compete for, as request_id, seq and block (of
    ordered_blocks), resource, need, capacity and soft; one row per request and resource. A soft demand is taken but
    not needed. Only resources wanted beyond their capacity matter.

    Requests and the contended resources they want form a graph; what happens in one of its components does not touch
    another. A component of at most TASK_DEMANDS demands is served request by request inside one task, however long the
    chains in it are; if all demands together are no more, they are served as one. Larger ones, a resource that
    most requests want for example, go through rounds that are spread over all tasks.
    """
    contended = (
        demands.groupBy("resource").agg(F.sum("need").alias("wanted"), F.max("capacity").alias("room"))
        .filter(F.col("wanted") > F.col("room")).select("resource", "room").checkpoint(eager=True)
    )
    state = demands.drop("capacity").join(contended, "resource").checkpoint(eager=True)
    taken = requests.select("request_id").join(state.select("request_id"), "request_id", "left_anti")
    if state.count() <= TASK_DEMANDS:
        return taken.unionByName(_in_order(state.withColumn("component", F.lit(0).cast("bigint"))))
    labelled, settled = _components(state)
    sizes = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    small = sizes.filter(F.col("n") <= TASK_DEMANDS).select("component") if settled else sizes.limit(0).select("component")
    served = _in_order(labelled.join(small, "component", "left_semi"))
    large = labelled.join(small, "component", "left_anti").drop("component").checkpoint(eager=True)
    return taken.unionByName(served).unionByName(_in_rounds(large))


def _in_order(demands: DataFrame) -> DataFrame:
    """request_ids taken in components that one task holds each."""
    return demands.select("component", "seq", "request_id", "resource", "need", "soft", "room").groupBy("component").applyInPandas(
        _one_by_one, "request_id string").checkpoint()


def _one_by_one(demands: pd.DataFrame) -> pd.DataFrame:
    """The requests of one component that are taken, in the order of seq."""
    resource, wanted = np.unique(demands["resource"].to_numpy(dtype=object).astype(str), return_inverse=True)
    room = np.zeros(len(resource), np.int64)
    room[wanted] = demands["room"].to_numpy(np.int64)
    seq, need, soft = (demands[c].to_numpy() for c in ("seq", "need", "soft"))
    ids, rows = demands["request_id"].to_numpy(), np.argsort(seq, kind="stable")
    taken = []
    for group in np.split(rows, np.flatnonzero(np.diff(seq[rows])) + 1):
        at, pieces = wanted[group], need[group].astype(np.int64)
        if ((room[at] >= pieces) | soft[group].astype(bool)).all():
            room[at] -= pieces
            taken.append(ids[group[0]])
    return pd.DataFrame({"request_id": pd.Series(taken, dtype=object)})


def _components(state: DataFrame) -> tuple[DataFrame, bool]:
    """The demands with the component they belong to, and whether all components were found.

    Each request starts as its own label. A step gives every resource the smallest label among its requests and every
    request the smallest among its resources, then labels of labels, so that chains halve in each step. Labels are
    seq numbers, minima combine in the map tasks.
    """
    labels = state.select("seq").distinct().withColumn("label", F.col("seq")).checkpoint(eager=True)
    for _ in range(COMPONENT_STEPS):
        marked = state.select("seq", "resource").join(labels, "seq")
        least = marked.groupBy("resource").agg(F.min("label").alias("least"))
        # a request tells its smallest neighbouring label to itself and to the request that its old label names
        heard = marked.join(least, "resource").select("seq", "label", "least")
        told = heard.select("seq", "least").unionByName(heard.select(F.col("label").alias("seq"), "least"))
        nearer = told.groupBy("seq").agg(F.min("least").alias("new"))
        moved = labels.join(nearer, "seq").select("seq", F.col("label").alias("old"), F.least("label", "new").alias("label"))
        jumped = moved.join(moved.select(F.col("seq").alias("label"), F.col("label").alias("far")), "label").select(
            "seq", F.least("label", "far").alias("label"), "old").checkpoint(eager=True)
        labels = jumped.select("seq", "label")
        if jumped.filter("label <> old").isEmpty():
            return state.join(labels.withColumnRenamed("label", "component"), "seq").checkpoint(eager=True), True
    return state.withColumn("component", F.lit(0).cast("bigint")), False


def _in_rounds(state: DataFrame) -> DataFrame:
    """request_ids taken, by rounds over all open requests.

    In each round, a request is taken when every one of its demands fits even if all earlier undecided requests were
    taken, and dropped when some demand exceeds what is left. The earliest undecided request is always decided, so the
    rounds end. A later request is only taken when it leaves room for all earlier undecided ones, so what is left per
    resource is one number. Rounds carry the open requests and the room of what they still want; what was taken is
    put aside.
    """
    taken = state.select("request_id").limit(0)
    left = state.count()
    while left:
        judged = _round(state).checkpoint(eager=True)
        chosen = judged.filter("fits")
        taken = taken.unionByName(chosen.select("request_id").distinct())
        used = chosen.groupBy("resource").agg(F.sum("need").alias("used"))
        open_ones = judged.filter("not fits").drop("fits")
        state = open_ones.join(used, "resource", "left").withColumn("room", F.col("room") - F.coalesce("used", F.lit(0))).drop("used")
        before, left = left, open_ones.count()
        if left >= before:
            raise RuntimeError(f"a round of serving decided none of {left} demands")
    return taken


def _round(state: DataFrame) -> DataFrame:
    """The open demands after one round, with `fits`; those of dropped requests are gone.

    Demands of a resource are summed per block of the batch order first and then inside a block, so a resource
    that most requests want is spread over all blocks.
    """
    return state.sparkSession.sql(
        """
        WITH sums AS (
          SELECT resource, block, sum(need) AS undecided FROM {state} GROUP BY resource, block
        ), blocks AS (
          SELECT resource, block,
                 coalesce(sum(undecided) OVER (PARTITION BY resource ORDER BY block
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block_start
          FROM sums
        ), measured AS (
          SELECT request_id, soft, need, room,
                 block_start + coalesce(sum(need) OVER (PARTITION BY resource, block ORDER BY seq
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM {state} JOIN blocks USING (resource, block)
        ), verdicts AS (
          SELECT request_id, min(CASE WHEN soft THEN before = 0 ELSE before + need <= room END) AS fits
          FROM measured GROUP BY request_id HAVING NOT max(NOT soft AND need > room)
        )
        SELECT request_id, seq, block, resource, need, soft, room, fits FROM {state} JOIN verdicts USING (request_id)
        """,
        state=state,
    )


def short_of(wishes: DataFrame, taken: DataFrame) -> DataFrame:
    """request_ids of wishes that exceed what the taken demands of earlier requests leave of some resource.

    Both as request_id, seq, block, resource, need, capacity. Sums go per block first, as in a round.
    """
    return wishes.sparkSession.sql(
        """
        WITH both AS (
          SELECT request_id, seq, block, resource, need, capacity, 0L AS used FROM {wishes}
          UNION ALL SELECT NULL, seq, block, resource, 0L, NULL, need FROM {taken}
        ), sums AS (
          SELECT resource, block, sum(used) AS used FROM both GROUP BY resource, block
        ), blocks AS (
          SELECT resource, block, coalesce(sum(used) OVER (PARTITION BY resource ORDER BY block
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block_start FROM sums
        ), measured AS (
          SELECT request_id, need, capacity, block_start + coalesce(sum(used) OVER (PARTITION BY resource, block
                 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM both JOIN blocks USING (resource, block)
        )
        SELECT DISTINCT request_id FROM measured WHERE request_id IS NOT NULL AND before + need > capacity
        """,
        wishes=wishes, taken=taken,
    )
