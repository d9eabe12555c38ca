"""Connected components of large graphs by contraction.

A round points every node at the least of its neighbours and itself, lets each pointer jump once, and
replaces edges by edges between the nodes pointed at. Loops and repeated edges go, so the graph shrinks
by a factor each round (ids should be hashes: then no order of theirs makes long chains). At the
end the rounds' pointers are followed from the last to the first.

Nodes with very many edges cost what their edges cost: minima are taken before the shuffle, and joins
are between plain exchanges, which adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import drop, keep


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); each component has one root, a node of it.

    Loops and repeated edges do no harm; rows with a null end are left out; no edges give no rows.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    live = keep(edges.filter("a <> b").select(low, high).distinct(), "edges")
    maps: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")), "pointers")
        onward = least.select(F.col("node").alias("at"), F.col("to").alias("then"))
        jumped = keep(least.join(onward, least["to"] == onward["at"]).select("node", F.col("then").alias("to")), "pointers")
        drop(least)
        maps.append(jumped)
        left = live.join(jumped, live["a"] == jumped["node"]).select(F.col("to").alias("a"), "b")
        right = left.join(jumped, left["b"] == jumped["node"]).select("a", F.col("to").alias("b"))
        shrunk = keep(right.filter("a <> b").select(low, high).distinct(), "edges")
        drop(live)
        live = shrunk
    drop(live)
    if not maps:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    found = maps[-1].withColumnRenamed("to", "root")
    for earlier in reversed(maps[:-1]):
        after = found.select(F.col("node").alias("at"), "root")
        found = keep(earlier.join(after, earlier["to"] == after["at"], "left").select("node", F.coalesce("root", "to").alias("root")), "roots")
    return found
