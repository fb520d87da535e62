"""Page rank without damping: the mass of pages without links is lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from websift.operators.links import keep_known
from websift.session import materialise


def weighted(edges: DataFrame) -> DataFrame:
    """src, dst, w: parallel edges folded into one with the share of its source that it carries."""
    n = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = n.groupBy("src").agg(F.sum("n").alias("t"))
    return n.join(total, "src").select("src", "dst", (F.col("n") / F.col("t")).alias("w"))


def step(rank: DataFrame, edges: DataFrame, nodes: DataFrame, damping: float | None = None) -> DataFrame:
    """One iteration over weighted edges; pages without a link to them get 0 (or 1 - damping)."""
    got = edges.join(rank.select(F.col("page_key").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("page_key")).agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
    new = F.coalesce("got", F.lit(0.0))
    return nodes.join(got, "page_key", "left").select("page_key", (new if damping is None else (1 - damping) + damping * new).alias("rank"))


def flow_of(edges: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, weighted edges between them), written out: every step reads them and none builds them again."""
    nodes = materialise(pages.select("page_key").distinct(), "rank-nodes")
    return nodes, materialise(weighted(keep_known(edges, nodes)), "rank-edges")


def steps(edges: DataFrame, pages: DataFrame, n: int, damping: float | None = None) -> list[DataFrame]:
    """The ranks after 0, 1, ... n iterations; the plan is cut every five."""
    nodes, flow = flow_of(edges, pages)
    out = [nodes.select("page_key", F.lit(1.0).alias("rank"))]
    for k in range(n):
        new = step(out[-1], flow, nodes, damping)
        out.append(materialise(new, "rank") if k % 5 == 4 else new)
    return out


def iterate(edges: DataFrame, pages: DataFrame, n: int, damping: float | None = None) -> DataFrame:
    """A fixed number of iterations from rank 1."""
    return steps(edges, pages, n, damping)[-1]


def squared_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: norm, the sum of squared differences of two ranks over the same pages."""
    other = b.select("page_key", F.col("rank").alias("other"))
    return a.join(other, "page_key").agg(F.coalesce(F.sum(F.pow(F.col("rank") - F.col("other"), 2)), F.lit(0.0)).alias("norm"))


def rank(edges: DataFrame, pages: DataFrame, max_steps: int = 200, epsilon: float = 1e-5, damping: float | None = None) -> DataFrame:
    """Iterates until the squared distance of two steps is at most epsilon or max_steps is reached.

    Each step is written to the shared folder once and read by the norm and by the next step. Edges keep one
    partitioning by src, so a step shuffles the ranks and the sums, never the edges again.
    """
    nodes, flow = flow_of(edges, pages)
    flow = flow.repartition("src").persist()
    now, old = nodes.select("page_key", F.lit(1.0).alias("rank")), None
    for _ in range(max_steps):
        new = materialise(step(now, flow, nodes, damping), "rank-step")
        old, now = now, new
        if squared_distance(old, now).first()["norm"] <= epsilon:
            break
    flow.unpersist()
    return now


def top_pages(ranks: DataFrame, pages: DataFrame, k: int = 30) -> DataFrame:
    """page_key, rank, url of the k highest ranks, equal ranks by key; joined after the limit, on k rows."""
    top = ranks.orderBy(F.desc("rank"), "page_key").limit(k)
    return pages.select("page_key", "url").join(F.broadcast(top), "page_key").select("page_key", "rank", "url")  # k rows
