"""Task graphs: validation and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("pending", "completed", "failed")


def plan_status(tasks: DataFrame) -> DataFrame:
    """(id, status) of ``tasks(id, status, depends_on)``: pending becomes ready when all it depends on is completed, else blocked."""
    deps = tasks.select("id", F.explode("depends_on").alias("dep")).join(tasks.select(F.col("id").alias("dep"), F.col("status").alias("s")), "dep", "left")
    open_deps = deps.groupBy("id").agg(F.count(F.when(F.coalesce(F.col("s"), F.lit("")) != "completed", 1)).alias("n"))
    status = F.when(F.col("status") == "pending", F.when(F.coalesce("n", F.lit(0)) == 0, "ready").otherwise("blocked")).otherwise(F.col("status"))
    return tasks.join(open_deps, "id", "left").select("id", status.alias("status"))


def validate_plan(tasks: DataFrame) -> list[str]:
    """Ids in an order that respects dependencies; ValueError for repeated ids, unknown dependencies or states, cycles, completion without evidence or before a dependency.

    A plan is some dozens of tasks and is checked on the driver.
    """
    rows = tasks.select("id", "status", "depends_on", "evidence").collect()
    by = {r.id: r for r in rows}
    if len(by) < len(rows):
        raise ValueError("ids repeat")
    for r in rows:
        if r.status not in STATES:
            raise ValueError(f"{r.id}: unknown status {r.status}")
        for d in r.depends_on or []:
            if d not in by:
                raise ValueError(f"{r.id}: unknown dependency {d}")
            if r.status == "completed" and by[d].status != "completed":
                raise ValueError(f"{r.id} is completed before {d}")
        if r.status == "completed" and not r.evidence:
            raise ValueError(f"{r.id} is completed without evidence")
    order: list[str] = []
    left = {i: set(r.depends_on or []) for i, r in by.items()}
    while left:
        free = sorted(i for i, d in left.items() if not d & set(left))
        if not free:
            raise ValueError("dependencies form a cycle")
        order += free
        for i in free:
            del left[i]
    return order
