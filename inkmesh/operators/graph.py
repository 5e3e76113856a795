"""Graph steps on a network that thresholds have already bounded: components, metrics, clusters, layout, main path.

A map's network holds at most max_items nodes, so one task may hold it whole; starts, seeds, resolutions and Brandes
sources are what Spark spreads.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkmesh.plans.components import connected_components
from inkmesh.plans.staging import stage

#: Networks of cluster, place and centralities are gathered into tasks up to so many links; a larger one is refused, not cut.
MOST_LINKS = 2_000_000


def components(links: DataFrame) -> DataFrame:
    """(a, b) of any ordered type -> key, component (its smallest key)."""
    return connected_components(links.select("a", "b")).select(F.col("node").alias("key"), F.col("root").alias("component"))


def largest_component(links: DataFrame) -> DataFrame:
    """key of the largest component; of equals that with the smallest key."""
    c = components(links)
    best = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    return c.join(best, "component", "left_semi").select("key")


def network_summary(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: nodes, links, components, isolated, density, mean degree, weight."""
    c = components(links)
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    m = links.agg(F.count(F.lit(1)).alias("links"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("weight"))
    linked = c.agg(F.count(F.lit(1)).alias("linked"), F.count_distinct("component").alias("groups"))
    x = n.join(m).join(linked)
    alone = F.col("nodes") - F.col("linked")
    return x.select("nodes", "links", (F.col("groups") + alone).alias("components"), alone.alias("isolated"), F.coalesce(F.try_divide(2.0 * F.col("links"), F.col("nodes") * (F.col("nodes") - 1)), F.lit(0.0)).alias("density"), F.coalesce(F.try_divide(2.0 * F.col("links"), F.col("nodes")), F.lit(0.0)).alias("mean_degree"), "weight")


def roles(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """key, degree, strength, participation, within_z, role of nodes (key, cluster) by their links (a, b, w)."""
    c = nodes.select("key", "cluster")
    half = links.select(F.col("a").alias("key"), F.col("b").alias("other"), "w").unionByName(links.select(F.col("b").alias("key"), F.col("a").alias("other"), "w"))
    part = half.join(c.select(F.col("key").alias("other"), F.col("cluster").alias("oc")), "other").groupBy("key", "oc").agg(F.sum("w").alias("k"), F.count(F.lit(1)).alias("n"))
    own = part.join(c, "key").groupBy("key", "cluster").agg(F.sum("n").alias("degree"), F.sum("k").alias("strength"), F.sum(F.col("k") * F.col("k")).alias("sq"), F.sum(F.when(F.col("oc") == F.col("cluster"), F.col("k")).otherwise(0.0)).alias("inner"))
    own = c.join(own.drop("cluster"), "key", "left").na.fill(0)
    w = Window.partitionBy("cluster")
    z = F.when(F.stddev_pop("inner").over(w) > 0, F.try_divide(F.col("inner") - F.avg("inner").over(w), F.stddev_pop("inner").over(w))).otherwise(0.0)
    x = own.withColumn("participation", F.when(F.col("strength") > 0, 1 - F.try_divide(F.col("sq"), F.col("strength") * F.col("strength"))).otherwise(0.0)).withColumn("within_z", z)
    p = F.col("participation")
    hub = F.when(p < 0.3, "provincial hub").when(p < 0.75, "connector hub").otherwise("kinless hub")
    other = F.when(p < 0.05, "ultra-peripheral").when(p < 0.62, "peripheral").when(p < 0.8, "connector").otherwise("kinless")
    return x.select("key", "degree", "strength", "participation", "within_z", F.when(F.col("within_z") >= 2.5, hub).otherwise(other).alias("role"))


def partition_quality(nodes: DataFrame, links: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: quality, the sum over pairs in one cluster of s - resolution, and modularity of the strengths w."""
    c = nodes.select("key", "cluster")
    ends = links.join(c.select(F.col("key").alias("a"), F.col("cluster").alias("ca")), "a").join(c.select(F.col("key").alias("b"), F.col("cluster").alias("cb")), "b")
    inner = ends.agg(F.coalesce(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("s"))), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w"))), F.lit(0.0)).alias("w"), F.sum("w").alias("m"))
    size = nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    k = ends.select(F.explode(F.array("ca", "cb")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("k2"))
    x = inner.join(size).join(k)
    return x.select((F.col("s") - resolution * F.col("pairs")).alias("quality"), (F.col("w") / F.col("m") - resolution * F.col("k2") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


# ---- kernels: one bounded network as arrays --------------------------------------------------------------------------


class Graph:
    """Neighbours of a bounded undirected network, by node number in order of key."""

    def __init__(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int):
        self.n = n
        src, dst, both = np.r_[a, b], np.r_[b, a], np.r_[w, w]
        order = np.lexsort((dst, src))
        self.to, self.w = dst[order], both[order].astype(float)
        self.at = np.searchsorted(src[order], np.arange(n + 1))

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.to[self.at[i] : self.at[i + 1]], self.w[self.at[i] : self.at[i + 1]]


def _moves(g: Graph, size: np.ndarray, label: np.ndarray, gamma: float, rng: np.random.Generator, bound: np.ndarray | None = None) -> np.ndarray:
    """Local moving: a queue of nodes, each to the cluster that gains most; inside `bound` groups only, if given."""
    mass = np.bincount(label, size, max(g.n, int(label.max(initial=0)) + 1))
    queue = list(rng.permutation(g.n))
    waiting = np.ones(g.n, bool)
    head = 0
    while head < len(queue):
        i = queue[head]
        head += 1
        waiting[i] = False
        to, w = g.of(i)
        keep = to != i
        if bound is not None:
            keep &= bound[to] == bound[i]
        to, w = to[keep], w[keep]
        old = label[i]
        mass[old] -= size[i]
        around, inverse = np.unique(np.r_[old, label[to]], return_inverse=True)
        gain = np.bincount(inverse[1:], w, len(around)) - gamma * size[i] * mass[around]
        best = int(np.argmax(gain))
        new = around[best] if gain[best] > gain[np.searchsorted(around, old)] + 1e-12 else old
        if gain[best] < -1e-12 and mass[old] > 0 and (mass == 0).any():
            new = int(np.flatnonzero(mass == 0)[0])
        mass[new] += size[i]
        if new != old:
            label[i] = new
            wake = to[(label[to] != new) & ~waiting[to]]
            waiting[wake] = True
            queue += wake.tolist()
    return np.unique(label, return_inverse=True)[1]


def leiden(g: Graph, gamma: float = 1.0, seed: int = 0, levels: int = 40) -> tuple[np.ndarray, float]:
    """Clusters that maximise the sum over pairs in one cluster of s - gamma; local moves, refinement, aggregation."""
    rng = np.random.default_rng(seed)
    node, graph, size = np.arange(g.n), g, np.ones(g.n)
    label = np.arange(g.n)
    for _ in range(levels):
        label = _moves(graph, size, label, gamma, rng)
        fine = _moves(graph, size, np.arange(graph.n), gamma, rng, bound=label)
        if len(np.unique(fine)) == graph.n:
            break
        src = np.repeat(np.arange(graph.n), np.diff(graph.at))
        up = src <= graph.to
        loops = np.where(src == graph.to, 0.5, 1.0)[up]
        a, b = fine[src[up]], fine[graph.to[up]]
        m = int(fine.max()) + 1
        key, inverse = np.unique(np.minimum(a, b) * m + np.maximum(a, b), return_inverse=True)
        w = np.bincount(inverse, graph.w[up] * loops)
        first = np.zeros(m, np.int64)
        first[fine] = label
        size, node = np.bincount(fine, size, m), fine[node]
        graph, label = Graph(key // m, key % m, w, m), np.unique(first, return_inverse=True)[1]
    out = np.unique(label[node], return_inverse=True)[1]
    return out, quality(g, out, gamma)


def quality(g: Graph, label: np.ndarray, gamma: float) -> float:
    src = np.repeat(np.arange(g.n), np.diff(g.at))
    n = np.bincount(label)
    return float(g.w[(label[src] == label[g.to]) & (src < g.to)].sum() - gamma * (n * (n - 1) / 2).sum())


def ordered(label: np.ndarray, g: Graph, least: int = 1) -> np.ndarray:
    """Clusters under `least` joined to their best linked neighbour, then numbered by size, largest first."""
    for _ in range(3):
        n = np.bincount(label)
        small = [c for c in range(len(n)) if 0 < n[c] < least]
        if not small:
            break
        for c in small:
            gain: dict[int, float] = {}
            for i in np.flatnonzero(label == c):
                for j, w in zip(*g.of(i)):
                    if n[label[j]] >= least:
                        gain[int(label[j])] = gain.get(int(label[j]), 0.0) + w
            if gain:
                label[label == c] = min(gain, key=lambda k: (-gain[k], k))
    n = np.bincount(label)
    first = np.array([np.flatnonzero(label == c)[0] if n[c] else len(label) for c in range(len(n))])
    rank = np.empty(len(n), np.int64)
    rank[np.lexsort((first, -n))] = np.arange(len(n))
    return rank[label]


def layout_energy(x: np.ndarray, s: np.ndarray, attraction: float, repulsion: float) -> float:
    i, j = np.triu_indices(len(x), 1)
    d = np.sqrt(((x[i] - x[j]) ** 2).sum(1)) + 1e-12
    rep = np.log(d) if repulsion == 0 else d**repulsion / repulsion
    return float((s[i, j] * d**attraction / attraction - rep).sum())


def layout(s: np.ndarray, seed: int = 0, dims: int = 2, attraction: float = 2.0, repulsion: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Places that minimise the sum of s d^A / A - d^R / R: unit steps along the gradient, node by node, the step shrunk
    on failure and grown after five gains; then turned to principal axes and reflected so that medians are not positive."""
    rng = np.random.default_rng(seed)
    n = len(s)
    x = rng.random((n, dims))
    step, last, gains = 1.0, layout_energy(x, s, attraction, repulsion), 0
    for _ in range(rounds if n > 1 else 0):
        y = x.copy()
        for i in rng.permutation(n):
            d = y[i] - y
            r = np.sqrt((d**2).sum(1)) + 1e-12
            f = s[i] * r ** (attraction - 2) - r ** (repulsion - 2)
            f[i] = 0
            g = (f[:, None] * d).sum(0)
            y[i] -= step * g / (np.sqrt((g**2).sum()) + 1e-12) / math.sqrt(n)
        e = layout_energy(y, s, attraction, repulsion)
        if e < last:
            x, last, gains = y, e, gains + 1
            if gains >= 5:
                step, gains = step / 0.75, 0
        else:
            step, gains = step * 0.75, 0
        if step < 1e-4:
            break
    x = x - x.mean(0)
    if n > 1:
        x = x @ np.linalg.svd(x, full_matrices=False)[2].T
    return x * np.where(np.median(x, 0) > 0, -1.0, 1.0), last


def _brandes(g: Graph, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unweighted dependencies of all nodes on the sources, and (reached, distance) sums of the sources."""
    between, close = np.zeros(g.n), np.zeros((len(sources), 2))
    for k, s in enumerate(sources):
        dist, count, order, before = np.full(g.n, -1), np.zeros(g.n), [], [[] for _ in range(g.n)]
        dist[s], count[s] = 0, 1
        queue = [int(s)]
        for v in queue:
            order.append(v)
            for t in g.of(v)[0].tolist():
                if dist[t] < 0:
                    dist[t] = dist[v] + 1
                    queue.append(t)
                if dist[t] == dist[v] + 1:
                    count[t] += count[v]
                    before[t].append(v)
        own = np.zeros(g.n)
        for t in reversed(order):
            for v in before[t]:
                own[v] += count[v] / count[t] * (1 + own[t])
            if t != s:
                between[t] += own[t]
        close[k] = len(order), dist[dist > 0].sum()
    return between, close


def _gathered(links: DataFrame) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """keys and a, b, w, s of a network that selection has bounded; more than MOST_LINKS links are refused."""
    cols = [c for c in ("w", "s") if c in links.columns]
    rows = links.select("a", "b", *cols).limit(MOST_LINKS + 1).toPandas()
    if len(rows) > MOST_LINKS:
        raise ValueError(f"a network of over {MOST_LINKS} links: select items first")
    rows = rows.sort_values(["a", "b"])
    keys = sorted(set(rows["a"]) | set(rows["b"]))
    number = {k: i for i, k in enumerate(keys)}
    w = rows[cols[0]].to_numpy(float) if cols else np.ones(len(rows))
    return keys, rows["a"].map(number).to_numpy(np.int64), rows["b"].map(number).to_numpy(np.int64), w, rows["s"].to_numpy(float) if "s" in cols else w


def cluster(links: DataFrame, resolutions: tuple[float, ...] = (1.0,), seeds: int = 10, seed: int = 0, least: int = 1) -> DataFrame:
    """(a, b, w, s) -> resolution, seed, quality, key, cluster: one Leiden run a resolution and seed, each a task of its own."""
    keys, a, b, _, s = _gathered(links)
    n = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = Graph(a, b, s, n)
        for pdf in batches:
            for gamma, k in zip(pdf["resolution"], pdf["seed"]):
                label, q = leiden(g, gamma, int(k))
                yield pd.DataFrame({"resolution": gamma, "seed": int(k), "quality": q, "key": keys, "cluster": ordered(label, g, least)})

    spark = links.sparkSession
    jobs = [(float(r), (seed + 1) * 7919 + k * 104729) for r in resolutions for k in range(seeds)]
    plan = spark.createDataFrame(jobs, "resolution double, seed long").repartition(len(jobs), "resolution", "seed")
    return plan.mapInPandas(run, f"resolution double, seed long, quality double, key {dict(links.dtypes)['a']}, cluster int")


def best_clusters(runs: DataFrame) -> DataFrame:
    """key, cluster of the run with the best quality, of equals the smallest seed."""
    best = runs.select("resolution", "seed", "quality").distinct().orderBy(F.desc("quality"), "seed").limit(1)
    return runs.join(F.broadcast(best.select("resolution", "seed")), ["resolution", "seed"]).select("key", "cluster")


def stability(runs: DataFrame) -> DataFrame:
    """resolution, clusters, largest_share, mean_ari, min_ari over all pairs of a resolution's runs, by contingency tables."""
    x, y = runs.select("resolution", F.col("seed").alias("sx"), "key", F.col("cluster").alias("cx")), runs.select("resolution", F.col("seed").alias("sy"), "key", F.col("cluster").alias("cy"))
    two = lambda c: c * (c - 1) / 2
    cells = x.join(y, ["resolution", "key"]).where("sx < sy").groupBy("resolution", "sx", "sy", "cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    by = ["resolution", "sx", "sy"]
    side = lambda c: cells.groupBy(*by, c).agg(F.sum("n").alias("m")).groupBy(*by).agg(F.sum(two(F.col("m"))).alias(f"p{c}"))
    t = cells.groupBy(*by).agg(F.sum(two(F.col("n"))).alias("same"), F.sum("n").alias("all")).join(side("cx"), by).join(side("cy"), by)
    e, m = F.try_divide(F.col("pcx") * F.col("pcy"), two(F.col("all"))), (F.col("pcx") + F.col("pcy")) / 2
    ari = t.select("resolution", F.when(m == e, 1.0).otherwise(F.try_divide(F.col("same") - e, m - e)).alias("ari")).groupBy("resolution").agg(F.avg("ari").alias("mean_ari"), F.min("ari").alias("min_ari"))
    size = runs.groupBy("resolution", "seed", "cluster").agg(F.count(F.lit(1)).alias("n")).groupBy("resolution", "seed").agg(F.count(F.lit(1)).alias("k"), (F.max("n") / F.sum("n")).alias("share"))
    return size.groupBy("resolution").agg(F.avg("k").alias("clusters"), F.avg("share").alias("largest_share")).join(ari, "resolution", "left")


def best_resolution(sweep: DataFrame, base: float = 1.0) -> DataFrame:
    """One row, resolution: of (resolution, clusters, mean_ari) that whose runs agree best; no row if none has two clusters.

    Resolutions stand in ascending order. One takes the lead if its agreement is higher by over 0.01, or no lower than
    0.01 below while it is nearer to base, by ratio.
    """
    rows = sweep.where(F.round("clusters") >= 2).select("resolution", F.coalesce("mean_ari", F.lit(1.0)).alias("ari"))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("resolution", "ari"))).alias("r")).where(F.size("r") > 0)  # a row a resolution
    off = lambda x: F.abs(F.log(x["resolution"] / base))
    more = lambda b, x: x["ari"] - b["ari"]
    best = F.aggregate("r", F.get("r", F.lit(0)), lambda b, x: F.when((more(b, x) > 0.01) | ((more(b, x) > -0.01) & (off(x) < off(b))), x).otherwise(b))
    return listed.select(best["resolution"].alias("resolution"))


def place(links: DataFrame, starts: int = 4, dims: int = 2, attraction: float = 2.0, repulsion: float = 1.0, seed: int = 0) -> DataFrame:
    """(a, b, w, s) -> key, x, y (z): the best of several layouts, one start a task. For networks of up to a few thousand items."""
    keys, a, b, _, s = _gathered(links)
    n, names = len(keys), ["x", "y", "z"][:dims]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.zeros((n, n))
        m[a, b] = m[b, a] = s
        rounds = int(min(1000, max(150, 1000 * (1000 / max(n, 1)) ** 2))) if n > 1000 else 300
        for pdf in batches:
            for k in pdf["id"]:
                x, e = layout(m, seed + int(k), dims, attraction, repulsion, rounds)
                yield pd.DataFrame({"start": int(k), "energy": e, "key": keys} | {c: x[:, i] for i, c in enumerate(names)})

    schema = f"start long, energy double, key {dict(links.dtypes)['a']}, " + ", ".join(f"{c} double" for c in names)
    runs = links.sparkSession.range(0, starts, 1, starts).mapInPandas(run, schema)
    w = Window.partitionBy("key").orderBy("energy", "start")
    return runs.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("key", *names)


def centralities(links: DataFrame, most_sources: int = 3000, sampled: int = 600) -> DataFrame:
    """key, betweenness, closeness. Up to most_sources nodes every node is a source; beyond, `sampled` evenly spaced ones stand for all."""
    keys, a, b, w, _ = _gathered(links)
    n = len(keys)
    sources = np.arange(n) if n <= most_sources else np.unique(np.linspace(0, n - 1, sampled).astype(np.int64))
    scale = n / max(1, len(sources)) / max(1, (n - 1) * (n - 2))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = Graph(a, b, w, n)
        for pdf in batches:
            own = pdf["source"].to_numpy()
            between, close = _brandes(g, own)
            c = np.full(n, np.nan)
            c[own] = np.where(close[:, 1] > 0, (close[:, 0] - 1) / np.maximum(close[:, 1], 1), 0.0)
            yield pd.DataFrame({"key": keys, "between": between * scale, "close": c})

    spark = links.sparkSession
    tasks = max(1, min(64, len(sources) // 50))
    parts = spark.createDataFrame(pd.DataFrame({"source": sources}), "source long").repartition(tasks).mapInPandas(run, f"key {dict(links.dtypes)['a']}, between double, close double")
    close = F.max(F.when(~F.isnan("close"), F.col("close")))
    return parts.groupBy("key").agg(F.sum("between").alias("betweenness"), close.alias("closeness"))


#: Components are dealt to tasks in groups of about so many links; a larger component is a group of its own.
LINKS_AT_ONCE = 200_000


def _dealt(edges: DataFrame, years: DataFrame) -> DataFrame:
    """edges (citing, cited, ...) that run forward by (year, doc), once each, with y1, y2 and grp: whole components together."""
    y1, y2 = years.select(F.col("doc").alias("citing"), F.col("year").alias("y1")), years.select(F.col("doc").alias("cited"), F.col("year").alias("y2"))
    kept = stage(edges.join(y1, "citing").join(y2, "cited").where(F.struct("y2", "cited") < F.struct("y1", "citing")).distinct(), "forward")
    groups = max(1, math.ceil(kept.count() / LINKS_AT_ONCE))
    root = connected_components(kept.select(F.col("citing").alias("a"), F.col("cited").alias("b"))).select(F.col("node").alias("citing"), F.pmod(F.xxhash64("root"), F.lit(groups)).cast("int").alias("grp"))
    return kept.join(root, "citing")


def _counted(rows: pd.DataFrame) -> pd.DataFrame:
    """citing, cited, y1, y2 of whole components -> citing, cited, grp, lg (the logarithm of the paths through a link), total (of all paths of the group)."""
    order = sorted({*zip(rows["y1"], rows["citing"]), *zip(rows["y2"], rows["cited"])})
    number = {d: i for i, (_, d) in enumerate(order)}
    src, dst = rows["cited"].map(number).tolist(), rows["citing"].map(number).tolist()
    n = len(order)
    out: list[list[int]] = [[] for _ in range(n)]
    into: list[list[int]] = [[] for _ in range(n)]
    for i, j in zip(src, dst):
        out[i].append(j)
        into[j].append(i)
    add = lambda xs: xs[0] if len(xs) == 1 else float(np.logaddexp.reduce(xs))
    head, tail = [0.0] * n, [0.0] * n
    for v in range(n):
        if into[v]:
            head[v] = add([head[u] for u in into[v]])
    for v in range(n - 1, -1, -1):
        if out[v]:
            tail[v] = add([tail[u] for u in out[v]])
    total = add([tail[v] for v in range(n) if not into[v]])
    return pd.DataFrame({"citing": rows["citing"], "cited": rows["cited"], "grp": rows["grp"], "lg": [head[i] + tail[j] for i, j in zip(src, dst)], "total": total})


def path_counts(edges: DataFrame, years: DataFrame) -> DataFrame:
    """(citing, cited), (doc, year) -> citing, cited, spc: the share of all paths through the citation graph that use a link.

    Links run from the cited to the citing document, by (year, doc); backward ones are dropped. Counts are kept as
    logarithms. Paths stay inside a component, so components are counted by tasks, many small ones in one, and their
    totals, a row a task, are summed. Path counting is sequential in the order of documents, so one component is one
    task's load, in memory.
    """
    kinds = dict(edges.dtypes)
    rows = _dealt(edges.select("citing", "cited"), years).groupBy("grp").applyInPandas(_counted, f"citing {kinds['citing']}, cited {kinds['cited']}, grp int, lg double, total double")
    rows = stage(rows, "paths")
    totals = rows.groupBy("grp").agg(F.max("total").alias("t"))
    most = totals.agg(F.max("t").alias("most"))
    whole = totals.join(F.broadcast(most)).agg((F.max("most") + F.log(F.sum(F.exp(F.col("t") - F.col("most"))))).alias("whole"))  # one row
    return rows.join(F.broadcast(whole)).select("citing", "cited", F.exp(F.col("lg") - F.col("whole")).alias("spc"))


def _best_path(rows: pd.DataFrame) -> pd.DataFrame:
    """The best path of some whole components: step, citing, cited, spc, and the sum, year and document that rank it."""
    year = dict(zip(rows["citing"], rows["y1"])) | dict(zip(rows["cited"], rows["y2"]))
    best: dict = {}
    links: dict = {}
    for r in rows[["citing", "cited", "spc"]].itertuples():
        links.setdefault(r.cited, []).append((r.citing, r.spc))
    for d in sorted(year, key=lambda d: (year[d], d), reverse=True):
        for to, w in sorted(links.get(d, []), key=lambda x: (year[x[0]], x[0])):
            if d not in best or w + best.get(to, (0.0,))[0] > best[d][0] + 1e-15:
                best[d] = (w + best.get(to, (0.0,))[0], to, w)
    at = start = min(set(best) - set(rows["citing"]), key=lambda d: (-best[d][0], year[d], d))
    path = []
    while at in best:
        _, to, w = best[at]
        path.append((len(path) + 1, to, at, w, best[start][0], year[start], start))
        at = to
    return pd.DataFrame(path, columns=["step", "citing", "cited", "spc", "sum", "year", "start"])


def main_path(weighted: DataFrame, years: DataFrame) -> DataFrame:
    """step, citing, cited, spc of the path from a source that gathers the largest sum of spc; ties to the earlier document.

    Every task offers the best path of its components (see path_counts); the best of these, a few rows a task, is kept.
    """
    kinds = dict(weighted.dtypes)
    offered = _dealt(weighted, years).groupBy("grp").applyInPandas(_best_path, f"step int, citing {kinds['citing']}, cited {kinds['cited']}, spc double, sum double, year {dict(years.dtypes)['year']}, start {kinds['cited']}")
    offered = stage(offered, "paths")
    best = offered.where("step = 1").orderBy(F.desc("sum"), "year", "start").limit(1).select("start")
    return offered.join(F.broadcast(best), "start").select("step", "citing", "cited", "spc")
