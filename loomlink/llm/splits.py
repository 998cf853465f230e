"""Splits that keep related records together.

Components come from a frontier search: the adjacency lists lie hash-partitioned, every node that hashes
below all its neighbours is a seed, and all seeds expand at once, level by level. Where two labels meet, the
pair goes into a graph of labels, far smaller than the graph, which is solved the same way; once it has no more
than a bounded number of edges, by one task. The components then fill the splits in the order of a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlink.session import cut


_HOT = 10_000


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``node, component`` of a small graph: each component by its first node in the order of ``h``."""
    parent: dict[str, str] = {}
    rank: dict[str, int] = {}

    def find(x: str) -> str:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for df in batches:
        for a, ha, b, hb in zip(df["a"], df["ha"], df["b"], df["hb"]):
            for node, h in ((a, ha), (b, hb)):
                if node not in parent:
                    parent[node], rank[node] = node, h
            x, y = find(a), find(b)
            if x != y:
                if (rank[x], x) > (rank[y], y):
                    x, y = y, x
                parent[y] = x
    nodes = list(parent)
    yield pd.DataFrame({"node": nodes, "component": [find(x) for x in nodes]}, dtype=object)


def _winners(met: DataFrame, order) -> DataFrame:
    """``met(node, label, held)`` with the label that each node takes: the one it holds, else the least.

    The least is found by partial aggregates, so a hub's labels needn't meet in a task; those of a node with more
    than ``_HOT`` labels, of which there are few, are joined by broadcast.
    """
    least = cut(met.groupBy("node").agg(F.min(order("label"))["v"].alias("first"), F.count(F.lit(1)).alias("n")))
    hot = least.where(F.col("n") > _HOT)  # at most one in _HOT rows of met
    joined = met.join(least.where(F.col("n") <= _HOT), "node")
    if not hot.isEmpty():
        joined = joined.unionByName(met.join(F.broadcast(hot), "node"))
    return joined.withColumn("winner", F.coalesce("held", "first")).drop("first", "n")


def connected_components(edges: DataFrame, rounds: int = 1000, one_task: int = 500_000) -> DataFrame:
    """``node, component`` of every node of ``edges(a, b)``, both strings.

    NULL ends and loops make no edge, but the other end of such a row stays a node. Repeated edges count
    once. The component is its node with the least hash, so the same input gives the same components; a graph of at
    most ``one_task`` edges is solved by one task, with the same result.
    """
    edges = edges.select("a", "b")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    apart = cut(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    if apart.count() <= one_task:
        hashed = apart.select("a", F.xxhash64("a").alias("ha"), "b", F.xxhash64("b").alias("hb"))
        solved = hashed.coalesce(1).mapInPandas(_solve, "node string, component string")
        return nodes.join(solved, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    both = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to"))))
    adjacent = cut(apart.select(both.alias("e")).select("e.*"))
    labels = cut(adjacent.groupBy("node").agg(F.min(order("to")).alias("least")).where(order("node") < F.col("least")).select("node", F.col("node").alias("label")))
    frontier, collisions = labels, None
    for _ in range(rounds):
        reached = frontier.join(adjacent, "node").select(F.col("to").alias("node"), "label").distinct()
        met = cut(_winners(cut(reached.join(labels.select("node", F.col("label").alias("held")), "node", "left")), order))
        clash = met.where("label <> winner").select(F.least("label", "winner").alias("a"), F.greatest("label", "winner").alias("b"))
        collisions = cut((clash if collisions is None else collisions.unionByName(clash)).distinct())
        frontier = met.where("held is null and label = winner").select("node", "label")
        if frontier.isEmpty():
            break
        labels = cut(labels.unionByName(frontier))
    else:
        raise RuntimeError(f"the search did not end in {rounds} rounds")
    # The winner of a meeting has the least hash, so the stars that meetings make are solved in one level.
    merged = cut(connected_components(collisions, rounds, one_task).select(F.col("node").alias("label"), "component"))
    solved = cut(labels.join(merged, "label", "left").select("node", F.coalesce("component", "label").alias("component")))
    return nodes.join(solved, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _fill(shares: list[float], total: float):
    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [df for df in batches if not df.empty]
        if not held:
            return
        rows = pd.concat(held).sort_values(["weight", "h", "component"], ascending=[False, True, True])
        left, out = [s * total for s in shares], []
        for w in rows["weight"]:
            k = max(range(len(left)), key=lambda i: (left[i], -i))
            left[k] -= w
            out.append(k)
        yield pd.DataFrame({"component": rows["component"], "split_no": out, "weight": rows["weight"]})

    return fill


def assign_splits(weights: DataFrame, shares: dict[str, float], large: float = 0.001, ranges: int = 1024) -> DataFrame:
    """``component, split`` of every row of ``weights(component, weight)``, weights 0 or more.

    Components above the share ``large`` of the whole weight, of which there are fewer than 1/``large``,
    are placed first, each where most is missing. The others fill what is left in the order of their hash,
    cut at the shares. With a whole weight of 0 the hash alone decides.
    """
    names, parts = list(shares), [shares[k] / sum(shares.values()) for k in shares]
    rows = cut(weights.select("component", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"), F.xxhash64(F.col("component"), F.lit("split")).alias("h")))
    total = rows.agg(F.sum("weight")).first()[0] or 0.0
    limit = large * total
    big = cut(rows.where((F.col("weight") > limit) & F.lit(total > 0)).coalesce(1).mapInPandas(_fill(parts, total), "component string, split_no int, weight double"))
    used = {r["split_no"]: r["w"] for r in big.groupBy("split_no").agg(F.sum("weight").alias("w")).collect()}
    room = [max(0.0, parts[i] * total - used.get(i, 0.0)) for i in range(len(parts))]
    if sum(room) <= 0:
        room = parts
    cuts, acc = [], 0.0
    for r in room[:-1]:
        acc += r / sum(room)
        cuts.append(acc)
    small = rows.where((F.col("weight") <= limit) | F.lit(total <= 0)).withColumn("range", F.shiftrightunsigned("h", 64 - (ranges - 1).bit_length()))
    # Components without weight move along with a share of one row so that they too follow the shares.
    sums = small.groupBy("range").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("c"))
    whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most `ranges` rows
    before = sums.select("range", F.coalesce(F.sum("w").over(whole), F.lit(0.0)).alias("before"), F.coalesce(F.sum("c").over(whole), F.lit(0)).alias("before_n"))
    rest = small.agg(F.sum("weight"), F.count(F.lit(1))).first()
    inside = Window.partitionBy("range").orderBy("h", "component").rowsBetween(Window.unboundedPreceding, 0)
    at = small.join(F.broadcast(before), "range").withColumn(
        "at",
        (F.col("before") + F.sum("weight").over(inside) - F.col("weight") / 2) / F.lit(rest[0]) if rest[0] else (F.col("before_n") + F.count(F.lit(1)).over(inside) - 0.5) / F.lit(max(1, rest[1])),
    )
    number = F.lit(len(cuts))
    for i in reversed(range(len(cuts))):
        number = F.when(F.col("at") < cuts[i], i).otherwise(number)
    placed = at.select("component", number.cast("int").alias("split_no")).unionByName(big.select("component", "split_no"))
    return placed.select("component", F.element_at(F.array(*map(F.lit, names)), F.col("split_no") + 1).alias("split"))


SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def split_entities(cands: DataFrame, prepared: DataFrame, records: DataFrame, matches: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
    """``s1, entity_id, split``: every ``cands.s1`` with its entity, and every other entity with a NULL ``s1``.

    A key's weight is its number of ``cands`` rows. Matches are a comma list, blanks and repeats are ignored. An
    ``s1`` without a ``prepared`` row has a NULL entity and stands alone. Rows with a NULL ``s1`` or entity
    take no part.
    """
    weight = cands.where("s1 is not null").groupBy("s1").agg(F.count(F.lit(1)).alias("weight"))
    known = prepared.where("entity_id is not null and gid is not null").select(F.col("gid").alias("s1"), F.trim("entity_id").alias("entity_id"))
    keys = weight.join(known, "s1", "left")
    keys = cut(keys.withColumn("node", F.coalesce("entity_id", F.concat(F.lit("gid:"), F.col("s1").cast("string")))))
    edges = matches.select(F.trim("source1_entity_id").alias("a"), F.explode_outer(F.split("matched_entity_ids", ",")).alias("b")).select(
        "a", F.nullif(F.trim("b"), F.lit("")).alias("b")
    )
    components = cut(connected_components(edges))
    others = prepared.select(F.trim("entity_id").alias("node")).union(records.select(F.trim("entity_id"))).union(components.select("node"))
    others = others.where("node is not null").distinct().join(keys.select("node"), "node", "left_anti")
    nodes = keys.select("s1", "entity_id", "node", "weight").unionByName(others.select(F.lit(None).cast("bigint").alias("s1"), F.col("node").alias("entity_id"), "node", F.lit(0).cast("bigint").alias("weight")))
    placed = cut(nodes.join(components, "node", "left").withColumn("component", F.coalesce("component", "node")))
    chosen = assign_splits(placed.groupBy("component").agg(F.sum("weight").alias("weight")), shares)
    return placed.join(chosen, "component").select("s1", "entity_id", "split")
