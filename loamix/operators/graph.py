"""Entity graph: building, components, communities, searches, and breadth-first crawling."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamix.sources.scratch import stored


def build_nodes(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """name, type, description: first type wins, an end of a relation that was never declared before is unknown;
    the longest description wins, the earliest of equals. Both tables carry `at`, their order."""
    named = entities.filter(F.trim("name") != "").select(F.trim("name").alias("name"), "type", "description", "at")
    whole = relations.filter((F.trim("src") != "") & (F.trim("dst") != "") & (F.trim("relation") != ""))
    ends = whole.select(F.explode(F.array(F.trim("src"), F.trim("dst"))).alias("name"), F.lit("unknown").alias("type"), F.lit("").alias("description"), "at")
    return named.unionByName(ends).groupBy("name").agg(
        F.min_by("type", "at").alias("type"), F.max_by("description", F.struct(F.length("description"), -F.col("at"))).alias("description")
    )


def build_edges(relations: DataFrame) -> DataFrame:
    """src, dst, relation: of repeated pairs the last relation."""
    whole = relations.filter((F.trim("src") != "") & (F.trim("dst") != "") & (F.trim("relation") != ""))
    return whole.groupBy(F.trim("src").alias("src"), F.trim("dst").alias("dst")).agg(F.max_by("relation", "at").alias("relation"))


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, component: least node reachable, by passing on the least label and jumping to labels of labels."""
    both = stored(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "graph-edges")
    labels = stored(both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("label")).withColumnRenamed("src", "node"), "graph-labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["src"], "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("old"))
        jump = step.select("node", F.col("label").alias("via"), "old").join(step.select(F.col("node").alias("via"), F.col("label").alias("far")), "via", "left")
        after = stored(jump.select("node", F.least("via", F.coalesce("far", "via")).alias("label"), "old"), "graph-labels")
        changed = after.filter(F.col("label") != F.col("old")).limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")


def greedy_modularity(edges: list[tuple[str, str]], total: int) -> dict[str, str]:
    """Merges the pair of communities with the largest gain while there is one; ties fall to the first names.

    Gains are whole numbers, 2 * total * weight - degree * degree. Of two
    neighbours the one with more neighbours holds the pair, in a lot of all its
    pairs of the same weight and other degree, of which the first name is the
    best. The heap has one entry a lot; its gain only falls while the holder
    grows, so a lot that comes up with an older gain goes back with its own.
    """
    degree: dict[str, int] = defaultdict(int)
    near: dict[str, dict[str, int]] = defaultdict(dict)
    for a, b in edges:
        degree[a] += 1
        degree[b] += 1
        if a != b:
            near[a][b] = near[b][a] = near[a].get(b, 0) + 1
    members = {n: [n] for n in degree}
    holders: dict[str, set[str]] = {n: set() for n in degree}  # who holds pairs with it
    lots: dict[str, dict[tuple[int, int], list[str]]] = {n: {} for n in degree}
    listed: dict[tuple[str, int, int], tuple[int, str, str]] = {}  # the valid entry of a lot
    heap: list[tuple[tuple[int, str, str], tuple[str, int, int]]] = []

    def put(holder: str, w: int, d: int) -> None:
        """Lists the lot by its first valid name, if it gains and isn't listed before that."""
        names, at = lots[holder].get((w, d), []), (holder, w, d)
        while names and not (holder in holders.get(names[0], ()) and degree[names[0]] == d and near[holder].get(names[0]) == w):
            heapq.heappop(names)
        value = 2 * total * w - degree[holder] * d
        if names and value > 0:
            key = (-value, min(holder, names[0]), max(holder, names[0]))
            if at not in listed or key < listed[at]:
                listed[at] = key
                heapq.heappush(heap, (key, at))
        elif not names:
            lots[holder].pop((w, d), None)

    def hold(a: str, b: str) -> None:
        holder, other = (a, b) if len(near[a]) >= len(near[b]) else (b, a)
        holders[other].add(holder)
        holders[holder].discard(other)
        w, d = near[a][b], degree[other]
        heapq.heappush(lots[holder].setdefault((w, d), []), other)
        put(holder, w, d)

    for a in list(near):
        for b in near[a]:
            if a < b:
                hold(a, b)
    while heap:
        key, at = heapq.heappop(heap)
        if listed.get(at) != key:
            continue
        del listed[at]
        holder, w, d = at
        if holder not in lots:
            continue
        put(*at)
        if listed.get(at) != key:
            continue
        _, a, b = key
        degree[a] += degree.pop(b)
        members[a] += members.pop(b)
        del lots[b], holders[b]
        changed = set()
        for c, n in near.pop(b).items():
            del near[c][b]
            holders[c].discard(b)
            if c != a:
                near[a][c] = near[c][a] = near[a].get(c, 0) + n
                changed.add(c)
        for c in changed | holders[a]:
            hold(a, c)
    return {n: a for a, own in members.items() for n in own}


def communities(edges: DataFrame) -> DataFrame:
    """node, community: greedy modularity within each connected part, with the edge count of the whole graph."""
    pairs = stored(edges.filter(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "graph-pairs")
    total = pairs.count()
    parts = components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    tagged = pairs.join(parts.select(F.col("node").alias("a"), "component"), "a")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        home = greedy_modularity(sorted(zip(pdf["a"], pdf["b"])), total)
        names = sorted(home)
        return pd.DataFrame({"node": names, "community": [home[n] for n in names]})

    return tagged.groupBy("component").applyInPandas(run, "node string, community string")


def community_sizes(members: DataFrame) -> DataFrame:
    """community_id, community, size: numbered by size, then name."""
    sizes = members.groupBy("community").agg(F.count("*").alias("size"))
    return numbered(sizes, [F.col("size").desc(), F.col("community")], "community_id")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with each row's place in the order, from 0: sorted by ranges, counted range by range, so no task holds all."""
    low = (1 << 33) - 1
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at__", F.monotonically_increasing_id())
    placed = stored(ranged, "numbered").withColumn("range__", F.shiftright("at__", 33))
    counts = placed.groupBy("range__").agg(F.count("*").alias("n__"))  # one row a range
    before = F.coalesce(F.sum("n__").over(Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("range__", before.alias("start__")))
    out = placed.join(starts, "range__").withColumn(name, (F.col("start__") + F.col("at__").bitwiseAND(F.lit(low))).cast("bigint"))
    return out.select(*df.columns, name)


def entities_in(queries: DataFrame, nodes: DataFrame, least: int = 5) -> DataFrame:
    """query_id, name, nth: entities whose name of at least five letters is in the question. queries is bounded."""
    names = nodes.filter(F.length("name") >= least).select("name", F.lower("name").alias("low_name"))
    asked = queries.select("query_id", F.lower("text").alias("low_text"))
    hits = names.join(F.broadcast(asked), F.contains("low_text", F.col("low_name")))
    order = Window.partitionBy("query_id").orderBy("name")
    return hits.select("query_id", "name", F.row_number().over(order).cast("bigint").alias("nth"))


def local_search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, members: DataFrame, most_entities: int = 3, most_neighbours: int = 5, most_groups: int = 3) -> DataFrame:
    """query_id, community, nth: groups of the first entities found and of their out-neighbours."""
    found = entities_in(queries, nodes).filter(F.col("nth") <= most_entities)
    out = found.join(edges, F.col("name") == F.col("src")).select("query_id", "nth", "dst")
    rank = F.row_number().over(Window.partitionBy("query_id", "nth").orderBy("dst"))
    near = out.withColumn("k", rank).filter(F.col("k") <= most_neighbours).select("query_id", F.col("dst").alias("name"), (F.col("nth") * 100 + F.col("k")).alias("o"))
    seen = found.select("query_id", "name", (F.col("nth") * 100).alias("o")).unionByName(near)
    groups = seen.join(members.withColumnRenamed("node", "name"), "name").groupBy("query_id", "community").agg(F.min("o").alias("o"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("o", "community"))
    return groups.select("query_id", "community", nth.cast("bigint").alias("nth")).filter(F.col("nth") <= most_groups)


def global_search(sizes: DataFrame, most: int = 3) -> DataFrame:
    return sizes.orderBy(F.col("size").desc(), "community_id").limit(most)


def crawl(links: DataFrame, seeds: DataFrame, most_depth: int = 3) -> DataFrame:
    """address, depth: breadth-first from seeds over links (src, dst), each address at its least depth."""
    known = seeds.select("address").distinct().withColumn("depth", F.lit(0))
    frontier = known
    for depth in range(1, most_depth + 1):
        found = frontier.join(links, F.col("address") == F.col("src")).select(F.col("dst").alias("address")).distinct()
        frontier = found.join(known.select("address"), "address", "left_anti").withColumn("depth", F.lit(depth))
        known = known.unionByName(frontier)
    return known
