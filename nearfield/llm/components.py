"""Connected components of an undirected link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.session import drop_path, scratch_path


def _write(df: DataFrame, spent: list[str]) -> DataFrame:
    """Write a step's table and read it back; the tables at ``spent`` made way for it and are removed.

    Small files are scanned many to a task and their size is known, so steps over
    few links cost few tasks and join by broadcast.
    """
    path = scratch_path(df.sparkSession, "components")
    df.write.parquet(path)
    _drop(df, spent)
    spent.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drop(df: DataFrame, spent: list[str]) -> None:
    while spent:
        drop_path(df.sparkSession, spent.pop())


def _roots(parents: DataFrame, spent: list[str]) -> DataFrame:
    """Follow (id, up) to the roots by pointer doubling; ``up`` <= ``id`` everywhere."""
    while True:
        nxt = parents.select(F.col("id").alias("up"), F.col("up").alias("over"))
        jumped = _write(
            parents.join(nxt, "up", "left").select(
                "id", F.coalesce("over", "up").alias("new"), (F.coalesce("over", "up") != F.col("up")).alias("moved")
            ),
            spent,
        )
        parents = jumped.select("id", F.col("new").alias("up"))
        if jumped.filter("moved").isEmpty():
            return parents


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); the component is its smallest id.

    Each round hooks every node to its smallest neighbour, follows these
    pointers to their roots and contracts the links to links between roots,
    until none is left.  Only minima are gathered per node, so one node with a
    third of all links is no hot group.
    """
    edges_at: list[str] = []
    labels_at: list[str] = []
    edges = _write(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), edges_at
    )
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
        roots_at: list[str] = []
        roots = _roots(hooks, roots_at)
        if labels is None:
            labels, labels_at, roots_at = roots.withColumnRenamed("up", "component"), roots_at, []
        else:
            to = roots.select(F.col("id").alias("component"), "up")
            labels = _write(
                labels.join(to, "component", "left").select("id", F.coalesce("up", "component").alias("component")), labels_at
            )
        ra = roots.select(F.col("id").alias("a"), F.col("up").alias("ra"))
        rb = roots.select(F.col("id").alias("b"), F.col("up").alias("rb"))
        edges = _write(
            edges.join(ra, "a")
            .join(rb, "b")
            .filter("ra != rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            edges_at,
        )
        _drop(links, roots_at)
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    _drop(links, edges_at)
    return labels
