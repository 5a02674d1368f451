"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)``, orderable keys -> ``(node, root)``, root being the least key of the component.

    Each round does one large-star and one small-star step: only minima are grouped
    (partial aggregation holds for hubs) and every node's neighbours are joined back, so no
    neighbour list is ever gathered. Rounds go on until the edges repeat; their number grows
    with the logarithm of the longest path. Each round is a table in the shared folder.
    Self-loops and nulls in ``u`` or ``v`` are dropped; no edges give no rows.
    """
    cur = materialize(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    state = _state(cur)
    while state[0]:
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = materialize(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        discard(cur)
        cur, last, state = nxt, state, _state(nxt)
        if state == last:
            break
    roots = cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.union(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
