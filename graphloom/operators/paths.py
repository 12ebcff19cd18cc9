"""Neighbours and paths as joins of edges, one for each hop.

Edges are filtered and cut to (cur, nxt, edge_id) once, before any join; conditions on nodes are semi-joins with ids
that each kind's own table yields, so attributes are read only where they are asked for and paths carry ids alone.
Depth is bounded, so hops are unrolled and each has its own conditions.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.request import InvalidQuery, LimitExceeded, Request, Step
from graphloom.sources.graph import Graph

FRAME = "vs array<string>, es array<string>, cur string"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  Only a local session without spark.checkpoint.dir gets a temporary one."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path


_WRITTEN: list[str] = []


def written(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/graphloom/{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Deletes the levels that path queries have written, but for the first `keep`; no frame of theirs may be read afterwards."""
    while len(_WRITTEN) > keep:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def held() -> int:
    return len(_WRITTEN)


def level_of(r: Request, df: DataFrame) -> DataFrame:
    """A level of paths, written, so that the next levels start from it; raises if it is beyond the request's cost limit."""
    out = written(df)
    if r.cost_limit and out.count() > r.cost_limit:
        raise LimitExceeded(f"a level has more than {r.cost_limit} paths")
    return out


def hop(g: Graph, direction: str, relations: tuple[str, ...] | None, *conditions, impact: bool = False, start: str | None = None, stop: str | None = None) -> DataFrame:
    """cur, nxt, edge_id, way of the edges that one hop can use.  relations: None for all, empty for none.

    start, stop: only edges that leave the one or reach the other entity, by a filter that scans can use."""
    edges = g.edges.df
    for c in conditions:
        if c is not None:
            edges = edges.where(g.edges.condition(c))
    if relations is not None:
        edges = edges.where(F.col("type").isin(list(relations)))

    def way(src: str, dst: str, name: str, types: list[str] | None = None) -> DataFrame:
        some = edges if types is None else edges.where(F.col("type").isin(types))
        for end, id_ in ((src, start), (dst, stop)):
            some = some if id_ is None else some.where(g.at(end, id_))
        return some.select(F.col(src).alias("cur"), F.col(dst).alias("nxt"), F.col("id").alias("edge_id"), F.lit(name).alias("way"))

    if impact:
        names = lambda d: [r.name for r in g.relations.values() if r.impact_direction in (d, "both")]
        return way("src", "dst", "out", names("forward")).unionByName(way("dst", "src", "in", names("reverse")))
    if direction in ("out", "in"):
        return way("src", "dst", "out") if direction == "out" else way("dst", "src", "in")
    return way("src", "dst", "out").unionByName(way("dst", "src", "in"))


def allowed(g: Graph, df: DataFrame, column: str, kinds: tuple[str, ...] = (), where=None) -> DataFrame:
    """Rows of df whose node exists, is of one of the kinds and meets the condition."""
    if not kinds and where is None and g.checked:
        return df
    ids = g.nodes(kinds, where).select(F.col("id").alias(column))
    return df.join(ids, column, "left_semi").select(*df.columns)


def require(g: Graph, id_: str) -> None:
    if not g.has(id_):
        raise InvalidQuery(f"entity not found: {id_}")


def relations_of(r: Request, step: Step | None) -> tuple[str, ...] | None:
    """The request's relations and the step's: both must hold."""
    if step is None or not step.relation_types:
        return r.relation_types or None
    if not r.relation_types:
        return step.relation_types
    return tuple(x for x in step.relation_types if x in r.relation_types)


def neighbors(g: Graph, r: Request) -> DataFrame:
    """id, edge_id, way of each neighbour.  A loop is met once in each direction."""
    require(g, r.id)
    edges = hop(g, r.direction or "both", r.relation_types or None, r.edge_where, impact=r.direction_strategy == "impact", start=r.id)
    found = edges.select(F.col("nxt").alias("id"), "edge_id", F.col("way").alias("direction"))
    return allowed(g, found, "id", r.node_kinds, r.where)


def expand(g: Graph, frame: DataFrame, edges: DataFrame, kinds: tuple[str, ...], step: Step | None) -> DataFrame:
    """Paths of frame, longer by one hop; no node twice."""
    nxt = frame.join(edges.select("cur", "nxt", "edge_id"), "cur").where(~F.array_contains("vs", F.col("nxt")))
    out = nxt.select(F.concat("vs", F.array("nxt")).alias("vs"), F.concat("es", F.array("edge_id")).alias("es"), F.col("nxt").alias("cur"))
    out = allowed(g, out, "cur", kinds)
    if step is not None:
        out = allowed(g, out, "cur", step.node_kinds, step.where)
    elif not kinds and not g.checked:
        out = allowed(g, out, "cur")
    return out


def start(g: Graph, id_: str, kinds: tuple[str, ...]) -> DataFrame:
    require(g, id_)
    frame = g.spark.range(1).select(F.array(F.lit(id_)).alias("vs"), F.array().cast("array<string>").alias("es"), F.lit(id_).alias("cur"))
    return allowed(g, frame, "cur", kinds)


def level_edges(g: Graph, r: Request, step: Step | None, default: str, start: str | None = None, stop: str | None = None) -> DataFrame:
    impact = r.op == "impact" or r.direction_strategy == "impact"
    direction = (step.direction if step else "") or r.direction or default
    return hop(g, direction, relations_of(r, step), r.edge_where, step.edge_where if step else None, impact=impact, start=start, stop=stop)


def ended(g: Graph, r: Request, df: DataFrame) -> DataFrame:
    """Only paths whose last node is as asked for."""
    if not r.end_kind and r.end_where is None:
        return df
    return allowed(g, df, "cur", (r.end_kind,) if r.end_kind else (), r.end_where)


def traverse(g: Graph, r: Request) -> DataFrame:
    """vs, es, cur of the simple paths from r.id of 1 to depth hops (with steps: of as many hops as steps)."""
    frame, found = start(g, r.id, r.node_kinds), []
    plain = None if r.steps else level_edges(g, r, None, "both")
    last = min(r.hops, len(r.steps) or r.hops)
    for level in range(last):
        step = r.steps[level] if r.steps else None
        first = r.id if not level else None
        edges = plain if plain is not None and level else level_edges(g, r, step, "both", first)
        frame = expand(g, frame, edges, r.node_kinds, step)
        if level + 1 < last or r.cost_limit:
            frame = level_of(r, frame)
        if not r.steps or level + 1 == len(r.steps):
            found.append(ended(g, r, frame))
    return reduce(DataFrame.unionByName, found) if found else g.spark.createDataFrame([], FRAME)


def pattern(g: Graph, r: Request) -> DataFrame:
    """Paths from all entities of a kind that take exactly the steps."""
    starts = g.nodes((r.kind,), r.where)
    frame = starts.select(F.array("id").alias("vs"), F.array().cast("array<string>").alias("es"), F.col("id").alias("cur"))
    frame = allowed(g, frame, "cur", r.node_kinds)
    for step in r.steps:
        frame = expand(g, frame, level_edges(g, r, step, "out"), r.node_kinds, step)
    return ended(g, r, frame)


def shortest(g: Graph, r: Request) -> DataFrame:
    """The shortest path from r.id to r.target_id, of these the one with the least edge ids; or none.

    Without steps two searches, from both ends, go level by level until they meet; the path itself is then found from the
    levels of nodes, so that no paths but this one are made."""
    require(g, r.id)
    require(g, r.target_id)
    frame = start(g, r.id, r.node_kinds)
    if r.steps:
        if r.hops < len(r.steps):
            return frame.where(F.lit(False))
        # Backwards from the target first: each level keeps only nodes from which the rest of the steps can reach it.
        levels, backs = [], []
        for i, step in reversed(list(enumerate(r.steps))):
            edges = level_edges(g, r, step, "both", r.id if i == 0 else None, r.target_id if i + 1 == len(r.steps) else None)
            edges = edges if not backs else edges.join(backs[-1].select(F.col("cur").alias("nxt")), "nxt", "left_semi")
            levels.append(edges)
            backs.append(written(edges.select("cur").distinct()) if i else None)
        for step, edges in zip(r.steps, reversed(levels), strict=True):
            frame = expand(g, frame, edges, r.node_kinds, step)
        return ended(g, r, frame.where(F.col("cur") == r.target_id)).orderBy("es").limit(1)
    if r.id == r.target_id:
        return ended(g, r, frame)
    if not ended(g, r, allowed(g, g.spark.range(1).select(F.lit(r.target_id).alias("cur")), "cur", r.node_kinds)).head(1):
        return frame.where(F.lit(False))
    if not frame.head(1):
        return frame
    met = meeting(g, r)
    return frame.where(F.lit(False)) if met is None else least_path(g, r, *met)


def meeting(g: Graph, r: Request) -> tuple[list[DataFrame], list[DataFrame]] | None:
    """Nodes (column cur) by their distance from r.id, and by their distance to r.target_id, as far as the two searches went; the
    last of both are the nodes where they meet.  None if they don't within the request's hops.

    The side with fewer nodes goes on, so that no level is larger than both searches need; ids alone are written and joined."""
    edges = level_edges(g, r, None, "both").select("cur", "nxt")
    turned = edges.select(F.col("nxt").alias("cur"), F.col("cur").alias("nxt"))
    sides = [[g.spark.range(1).select(F.lit(i).alias("cur"))] for i in (r.id, r.target_id)]
    sizes = [1, 1]
    for _ in range(r.hops):
        k = min((0, 1), key=lambda k: (sizes[k], len(sides[k])))
        levels = sides[k]
        nxt = (edges, turned)[k].join(levels[-1], "cur", "left_semi").select(F.col("nxt").alias("cur")).distinct()
        for seen in levels:
            nxt = nxt.join(seen, "cur", "left_anti")
        if r.node_kinds or not g.checked:
            nxt = allowed(g, nxt, "cur", r.node_kinds)
        levels.append(written(nxt))
        sizes[k] = levels[-1].count()
        if not sizes[k]:
            return None
        common = levels[-1].join(sides[1 - k][-1], "cur", "left_semi")
        if common.head(1):
            common = written(common)
            return sides[0][:-1] + [common], sides[1][:-1] + [common]
    return None


def least_path(g: Graph, r: Request, ahead: list[DataFrame], back: list[DataFrame]) -> DataFrame:
    """Of the shortest paths through the levels of meeting(), the one with the least edge ids: step by step, the least edge to a
    node from which the target is as near as it must be."""
    near = list(back)  # near[n]: nodes on shortest paths, n hops from the target
    for nodes in ahead[-2:0:-1]:
        links = level_edges(g, r, None, "both").select("cur", "nxt").join(nodes, "cur", "left_semi")
        near.append(written(links.join(near[-1].select(F.col("cur").alias("nxt")), "nxt", "left_semi").select("cur").distinct()))
    vs, es = [r.id], []
    for nodes in reversed(near):
        links = level_edges(g, r, None, "both", vs[-1]).join(nodes.select(F.col("cur").alias("nxt")), "nxt", "left_semi")
        best = links.agg(F.min(F.struct("edge_id", "nxt")).alias("x")).head()["x"]
        vs, es = [*vs, best["nxt"]], [*es, best["edge_id"]]
    return g.spark.createDataFrame([(vs, es, vs[-1])], FRAME)


def paths(g: Graph, r: Request) -> DataFrame:
    """vs, es, end_id, length of the request's paths, before sorting and paging; at most max_paths of them, in the order of the search."""
    found = {"traverse": traverse, "impact": traverse, "pattern": pattern, "shortest_path": shortest}[r.op](g, r)
    out = found.select("vs", "es", F.col("cur").alias("end_id"), F.size("es").cast("long").alias("length"))
    if r.max_paths and r.op != "shortest_path":
        deep = r.op == "traverse" or r.op == "impact"
        first = ["es", "vs"] if deep and not (r.sort or r.aggregate or r.group_by) else ["length", "es", "vs"] if deep else [F.col("vs")[0], "es"]
        out = out.orderBy(*first).limit(min(r.max_paths, 1001))
    return out
