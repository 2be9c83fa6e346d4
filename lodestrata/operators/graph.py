"""Graph primitives over edge tables: components, strongly connected components, closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalar import matches_any
from lodestrata.runtime import cut


def _stamp(df: DataFrame) -> tuple[int, int]:
    r = df.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))), F.lit(0))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an undirected edge table; a component is named by its least node.

    Alternates large-star and small-star steps, so rounds grow with the logarithm of
    the diameter and a hub's neighbours are never gathered into one row. Null ends and
    self-loops give no edge; a node that has only these is not returned.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _stamp(e)
    while before[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = cut(small.distinct())
        after = _stamp(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def closure(edges: DataFrame, src: str = "src", dst: str = "dst", max_depth: int | None = None) -> DataFrame:
    """(src, dst, depth): every node that can be reached, by the least number of edges; cycles end it, no cap by default."""
    e = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct())
    known = front = cut(e.withColumn("depth", F.lit(1)))
    depth = 1
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        front = cut(step.join(known, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        known = cut(known.union(front))
    return known


def live(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst", root: str = "node") -> DataFrame:
    """(node, depth): what is reached from the roots, each node by its least number of edges; the roots have 0."""
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
    known = front = cut(roots.select(F.col(root).alias("node")).distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while not front.isEmpty():
        depth += 1
        step = front.join(e, front.node == e.src).select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(known, "node", "left_anti").withColumn("depth", F.lit(depth)))
        known = cut(known.union(front))
    return known


def strongly_connected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, scc) of the nodes in strongly connected components of two nodes or more, named by their least node.

    Rounds of colouring: nodes without in- or out-edges are trimmed; then every node takes
    the least node that reaches it (itself included), and of each colour what reaches its
    root inside the colour is one component, which leaves the graph.
    """
    e = cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst").distinct())
    n, found = e.count(), None
    while n:
        while True:  # trim
            e = cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            before, n = n, e.count()
            if before == n:
                break
        if not n:
            break
        # the least node of a chain of edges is looked up over twice the distance in each round: a node takes
        # the least of what it has, of its predecessors' and of what the node it names has
        color = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct().withColumn("c", F.col("node"))
        total = None
        while True:
            near = e.join(color, e.src == color.node).groupBy("dst").agg(F.min("c").alias("m"))
            low = color.join(near, color.node == near.dst, "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"))
            jump = low.select(F.col("node").alias("c"), F.col("c").alias("j"))
            color = cut(low.join(jump, "c").select("node", F.least("c", "j").alias("c")))
            now = color.agg(F.sum(F.pmod(F.xxhash64("node", "c"), F.lit(1 << 40)))).first()[0]
            if now == total:
                break
            total = now
        inside = e.join(color.select(F.col("node").alias("src"), "c"), "src").join(color.select(F.col("node").alias("dst"), F.col("c").alias("c2")), "dst").where("c = c2").select("src", "dst", "c")
        inside = cut(inside)
        back = front = cut(color.where("node = c").select("node", "c"))
        while True:
            step = inside.join(front.select(F.col("node").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("node"), "c").distinct()
            front = cut(step.join(back, ["node", "c"], "left_anti"))
            if front.isEmpty():
                break
            back = cut(back.union(front))
        found = back if found is None else found.union(back)
        gone = back.select("node")
        e = cut(e.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti"))
        n = e.count()
    if found is None:
        return edges.select(F.col(src).alias("node"), F.col(dst).alias("scc")).limit(0)
    named = found.groupBy("c").agg(F.min("node").alias("scc"), F.count("*").alias("n")).where("n >= 2").select("c", "scc")
    return found.join(named, "c").select("node", "scc")


def cycles(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(scc, members, n) of every cycle, in no order; see :func:`reported`."""
    s = strongly_connected(edges, src, dst)
    return s.groupBy("scc").agg(F.array_sort(F.collect_set("node")).alias("members"), F.count("*").alias("n"))


def reported(found: DataFrame, modules: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """Cycles (scc, members, n, ...) that have a member outside the globs, from modules (module, file); the gravest action first, then the largest."""
    inside = modules.where(~matches_any(F.col("file"), list(exclude))).select(F.col("module").alias("__m")) if exclude else modules.select(F.col("module").alias("__m"))
    kept = found.select("scc", F.explode("members").alias("__m")).join(inside, "__m", "left_semi").select("scc").distinct()
    out = found.join(kept, "scc", "left_semi")
    grave = [F.array_position(F.array(*map(F.lit, ("must_fix", "warning", "advisory", "info"))), F.col("action"))] if "action" in found.columns else []
    return out.orderBy(*grave, F.desc("n"), "scc")


def next_hops(edges: DataFrame, scc: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, scc, next): for each member of a cycle the least target of its edges into the same cycle."""
    a = scc.select(F.col("node").alias(src), "scc")
    b = scc.select(F.col("node").alias(dst), F.col("scc").alias("scc2"))
    return edges.where(F.col(src) != F.col(dst)).join(a, src).join(b, dst).where("scc = scc2").groupBy(F.col(src).alias("node"), "scc").agg(F.min(dst).alias("next"))


def type_level_cycles(edges: DataFrame, src: str = "src", dst: str = "dst", type_only: str = "type_only") -> DataFrame:
    """Cycles that only exist with type-only edges: their member sets aren't those of a runtime cycle."""
    every, runtime = cycles(edges, src, dst), cycles(edges.where(~F.col(type_only)), src, dst)
    new = every.join(runtime.select("members"), "members", "left_anti")
    node = new.select("scc", F.explode("members").alias("node"))
    a = node.select(F.col("node").alias(src), "scc")
    b = node.select(F.col("node").alias(dst), F.col("scc").alias("scc2"))
    via = edges.where(type_only).join(a, src).join(b, dst).where("scc = scc2").select("scc").distinct()
    return new.join(via, "scc", "left_semi")


def coupling(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, fan_in, fan_out): distinct neighbours; a node itself doesn't count for its fan-in."""
    out = edges.groupBy(F.col(src).alias("node")).agg(F.countDistinct(dst).alias("fan_out"))
    into = edges.where(F.col(src) != F.col(dst)).groupBy(F.col(dst).alias("node")).agg(F.countDistinct(src).alias("fan_in"))
    return into.join(out, "node", "full").select("node", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))
