"""Embedding near-duplicates by range search in robust-pruned flat graphs."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, discard, materialise, read_table
from .components import connected_components

THRESHOLD = 0.9
#: Vectors a cell is made for, and most that one graph holds; larger cells are dealt into parts.
CELL, PART = 640, 1024
#: Queries that one group has at most, for each vector of PART.
ASKED = 4
MOST_CELLS = 4096
#: Centres that all large cells have inside at most (512 bytes each at 64 components, sent to all tasks).
MOST_INNER = 65_536
#: Cosine to its leader from which a vector follows it.
CLOSE = 0.97
#: Vectors that the cells are fitted on at most.
FIT_SAMPLE = 20_000
#: Cells that a query is sent to at first; doubled while the audit finds a recall below TARGET.
ROUTES, TARGET = 4, 0.99
#: Vectors audited in the first rounds, and in each later one, until LINKED of them have links or MOST_AUDITED are drawn.
AUDIT, LINKED, MOST_AUDITED = (256, 1024, 4096), 64, 65_536
SHARDS, DEGREE, CANDIDATES, ALPHA, BEAM = 4, 16, 64, 1.2, 16
#: Points of the beam that a query expands in each step.
WALK = 4
#: Edges of each point to points at random, as the nearest candidates of a point in a tight group all lie in it.
FAR_EDGES = 4
SEED = 9


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = SEED) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 4096] @ centres.T).argmax(1) for a in range(0, len(x), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), centres)
    return centres


def robust_prune(sim: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> np.ndarray:
    """Out-neighbours [n, degree] (-1: none) of all points of a shard from their similarities.

    Each point's nearest candidates are taken in order; one that is taken strikes out the candidates to which it is
    nearer, by a factor alpha, than the point itself is (Subramanya et al., 2019). All points are pruned together.
    """
    n = len(sim)
    out = np.full((n, degree), -1, np.int64)
    if n < 2:
        return out
    far = np.sqrt(np.maximum(0, 2 - 2 * sim))
    np.fill_diagonal(far, np.inf)
    width = min(candidates, n - 1)
    near = np.argpartition(far, width - 1, axis=1)[:, :width]
    own = np.take_along_axis(far, near, 1)
    order = np.argsort(own, axis=1, kind="stable")
    near, own = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
    open_ = np.ones(near.shape, bool)
    rows = np.arange(n)
    for k in range(degree):
        first = open_.argmax(1)
        some = open_[rows, first]
        if not some.any():
            break
        pick = near[rows, first]
        out[some, k] = pick[some]
        open_[rows, first] = False
        open_ &= alpha * far[pick[:, None], near] > own
    return out


def build_graph(x: np.ndarray, shards: int = SHARDS) -> tuple[list[np.ndarray], np.ndarray]:
    """Adjacency lists over all points and the medoids of the shards.

    Points are clustered, each goes to its two nearest clusters, every cluster gets a robust-pruned graph of its own,
    and a point's lists are united with a few edges to points at random; edges count both ways.
    """
    n = len(x)
    centres = spherical_kmeans(x, max(1, min(shards, n // 32)))
    near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :2]
    links: list[list[np.ndarray]] = [[] for _ in range(n)]
    medoids = []
    if n > 1:
        far = np.random.Generator(np.random.PCG64(SEED)).integers(0, n, (n, FAR_EDGES))
        for i in range(n):
            links[i].append(far[i])
        order = np.argsort(far.ravel(), kind="stable")
        ends = np.searchsorted(far.ravel()[order], np.arange(n + 1))
        for i in range(n):
            links[i].append(order[ends[i] : ends[i + 1]] // FAR_EDGES)
    for s in range(len(centres)):
        mine = np.flatnonzero((near == s).any(1))
        if not len(mine):
            continue
        medoids.append(int(mine[(x[mine] @ centres[s]).argmax()]))
        out = robust_prune(x[mine] @ x[mine].T)
        a, k = np.nonzero(out >= 0)
        a, b = mine[a], mine[out[a, k]]
        order = np.argsort(np.concatenate([a, b]), kind="stable")
        ends = np.searchsorted(np.concatenate([a, b])[order], np.arange(n + 1))
        to = np.concatenate([b, a])[order]
        for i in mine.tolist():
            links[i].append(to[ends[i] : ends[i + 1]])
    graph = [np.unique(np.concatenate(p)) if p else np.zeros(0, np.int64) for p in links]
    return graph, np.unique(medoids + unreached(x, graph, medoids))


def unreached(x: np.ndarray, graph: list[np.ndarray], medoids: list[int]) -> list[int]:
    """A medoid for each part of the graph that no edge joins to those there are, as tight groups link to themselves."""
    seen = np.zeros(len(graph), bool)

    def visit(start: list[int]) -> list[int]:
        part, todo = [], [i for i in dict.fromkeys(start) if not seen[i]]
        seen[todo] = True
        while todo:
            part += todo
            ahead = np.unique(np.concatenate([graph[i] for i in todo]))
            ahead = ahead[~seen[ahead]]
            seen[ahead] = True
            todo = ahead.tolist()
        return part

    visit(medoids)
    out = []
    for i in range(len(graph)):
        if not seen[i]:
            part = np.array(visit([i]))
            out.append(int(part[(x[part] @ x[part].mean(0)).argmax()]))
    return out


def range_search(x: np.ndarray, graph: list[np.ndarray], medoids: np.ndarray, queries: np.ndarray, threshold: float | np.ndarray = THRESHOLD, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, point) within the point's threshold, as far as the graph leads there.

    All queries walk together from the medoids. Each step a query expands the WALK best points not yet expanded of the
    ``beam`` best that it has seen; and every point seen within the threshold, so the walk covers the whole range once
    it is in it. A similarity is computed once, directly, when its point is first seen.
    """
    q, n = len(queries), len(x)
    sizes = np.array([len(g) for g in graph])
    begin = np.cumsum(sizes) - sizes
    flat = np.concatenate(graph) if n else np.zeros(0, np.int64)
    threshold = np.broadcast_to(threshold, n)
    seen, done = np.zeros(q * n, bool), np.zeros(q * n, bool)
    top, at = np.full((q, beam), -2.0), np.zeros((q, beam), np.int64)
    hits: list[np.ndarray] = []
    code = (np.arange(q)[:, None] * n + medoids).ravel()
    while len(code):
        who, to = code // n, code % n
        seen[code] = True
        sim = np.empty(len(code))
        for a in range(0, len(code), 100_000):
            w, t = who[a : a + 100_000], to[a : a + 100_000]
            sim[a : a + 100_000] = np.einsum("ij,ij->i", queries[w], x[t])
        near = code[sim >= threshold[to]]
        hits.append(near)
        # The best of what is new and of the beam before make the new beam.
        mine, count = np.unique(who, return_counts=True)
        wide, place = np.full((len(mine), beam + int(count.max())), -2.0), np.zeros((len(mine), beam + int(count.max())), np.int64)
        wide[:, :beam], place[:, :beam] = top[mine], at[mine]
        row = np.repeat(np.arange(len(mine)), count)
        column = beam + np.arange(len(code)) - np.repeat(np.cumsum(count) - count, count)
        wide[row, column], place[row, column] = sim, to
        best = np.argpartition(-wide, beam - 1, axis=1)[:, :beam]
        top[mine], at[mine] = np.take_along_axis(wide, best, 1), np.take_along_axis(place, best, 1)
        everyone = np.arange(q)
        waiting = np.where((top > -2.0) & ~done[everyone[:, None] * n + at], top, -2.0)
        first = np.argpartition(-waiting, WALK - 1, axis=1)[:, :WALK]
        going = np.take_along_axis(waiting, first, 1) > -2.0
        walk = (everyone[:, None] * n + np.take_along_axis(at, first, 1))[going]
        expand = np.unique(np.concatenate([walk, near[~done[near]]]))
        done[expand] = True
        who, node = expand // n, expand % n
        total = sizes[node]
        to = flat[np.repeat(begin[node] - (np.cumsum(total) - total), total) + np.arange(int(total.sum()))]
        code = np.repeat(who, total) * n + to
        code = np.unique(code[~seen[code]])
    found = np.concatenate(hits) if hits else np.zeros(0, np.int64)
    return found // max(n, 1), found % max(n, 1)


def leaders(x: np.ndarray, closeness: float = CLOSE) -> tuple[np.ndarray, np.ndarray]:
    """Points that lead the others (each itself, or the first one that close), and every point's leader by number."""
    sim = x @ x.T
    own = np.full(len(x), -1, np.int64)
    heads = []
    for i in range(len(x)):
        if own[i] < 0:
            own[(own < 0) & (sim[i] >= closeness)] = len(heads)
            own[i] = len(heads)
            heads.append(i)
    return np.array(heads, np.int64), own


def linked(x: np.ndarray, queries: np.ndarray, threshold: float, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, point) whose product in double precision reaches the threshold.

    The graph is over leaders, so a tight group is one point of it. A query looks for the leaders that are within the
    threshold's angle plus that of their farthest follower, and is then compared with their followers, directly.
    """
    if exact:
        parts = [np.nonzero(queries[a : a + 256] @ x.T >= threshold) for a in range(0, len(queries), 256)]
        return np.concatenate([i + 256 * k for k, (i, _) in enumerate(parts)]), np.concatenate([j for _, j in parts])
    heads, own = leaders(x)
    order = np.argsort(own, kind="stable")
    sizes = np.bincount(own)
    begin = np.cumsum(sizes) - sizes
    spread = np.arccos(np.clip(np.minimum.reduceat(np.einsum("ij,ij->i", x, x[heads][own])[order], begin), -1, 1))
    wide = np.where(sizes > 1, np.cos(np.minimum(np.pi, np.arccos(threshold) + spread + 1e-7)), threshold)
    who, head = range_search(x[heads], *build_graph(x[heads]), queries, wide)
    i = np.repeat(who, sizes[head])
    j = order[np.repeat(begin[head] - (np.cumsum(sizes[head]) - sizes[head]), sizes[head]) + np.arange(len(i))]
    good = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", queries[i[a : a + 100_000]], x[j[a : a + 100_000]]) >= threshold for a in range(0, len(i), 100_000))])
    return i[good], j[good]


def _assign(centres: np.ndarray, routes: int):
    """Batches of (id, copies, unit) -> a row for each cell that the vector is sent to; rank 0 is its home."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["unit"].to_numpy())
            k = min(routes, len(centres))
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :k]
            again = np.repeat(np.arange(len(pdf)), k)
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[again], "copies": pdf["copies"].to_numpy()[again], "unit": list(x[again]), "cell": near.ravel(), "rank": np.tile(np.arange(k), len(pdf))})

    return run


def _fit_inner(pdf):
    """A sample (cell, inner, unit) of one cell -> as many centres of its own as ``inner`` says, end to end."""
    import pandas as pd

    x = np.stack(pdf.sort_values("id")["unit"].to_numpy())
    return pd.DataFrame({"cell": [int(pdf["cell"].iloc[0])], "centres": [spherical_kmeans(x, int(pdf["inner"].iloc[0])).ravel()]})


def _assign_inner(shared, routes: int):
    """Batches of routed rows -> the same with ``inner``, a row for each inner cell of a large cell that it is sent to."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = [pdf[~pdf["cell"].isin(shared.value)].assign(inner=0)]
            for cell, part in pdf[pdf["cell"].isin(shared.value)].groupby("cell"):
                centres = shared.value[cell]
                k = min(routes, len(centres))
                near = np.argsort(-(np.stack(part["unit"].to_numpy()) @ centres.T), axis=1, kind="stable")[:, :k]
                more = part.iloc[np.repeat(np.arange(len(part)), k)].assign(inner=near.ravel())
                # At home in the nearest inner cell of the cell where it is at home; elsewhere it only asks.
                more["rank"] = np.where(np.tile(np.arange(k), len(part)) == 0, more["rank"], np.maximum(1, more["rank"]))
                out.append(more)
            yield pd.concat(out)[["id", "copies", "unit", "cell", "inner", "rank"]]

    return run


def _route_inner(routed: DataFrame, cell: int, part: int, routes: int) -> DataFrame:
    """Rows (id, copies, unit, cell, rank) with ``inner``: cells of over ``part`` vectors are split by centres of their own.

    At most MOST_INNER inner centres are made, for the largest cells first; each from a sample of its cell's vectors.
    """
    sizes = routed.filter("rank = 0").groupBy("cell").count().filter(F.col("count") > part).orderBy(F.desc("count"), "cell").collect()  # at most MOST_CELLS rows
    plan, room = [], MOST_INNER
    for c, n in sizes:
        k = min(-(-n // cell), MOST_CELLS, room)
        if k > 1:
            plan.append((c, k, n, min(n, 32 * k, FIT_SAMPLE)))
            room -= k
    if not plan:
        return routed.withColumn("inner", F.lit(0))
    spark = routed.sparkSession
    some = routed.filter("rank = 0").join(F.broadcast(spark.createDataFrame(plan, "cell int, inner int, n long, take long")), "cell")
    some = some.filter(F.pmod(F.xxhash64(F.lit(SEED + 4), "id"), F.col("n")) < F.col("take")).select("id", "cell", "inner", "unit")
    fitted = some.groupBy("cell").applyInPandas(_fit_inner, "cell int, centres array<double>").collect()
    dim = len(some.first()["unit"]) if fitted else 1
    shared = spark.sparkContext.broadcast({r["cell"]: np.array(r["centres"]).reshape(-1, dim) for r in fitted})
    return routed.mapInPandas(_assign_inner(shared, routes), "id long, copies long, unit array<double>, cell int, inner int, rank int")


def _search(threshold: float, exact: bool = False):
    """The home vectors of one part and one block of queries -> (id, links, pairs, low) of queries and linked home vectors.

    ``links`` counts vectors and ``pairs`` classes.
    """

    def run(pdf):
        import pandas as pd

        home, asked = pdf[pdf["home"]].sort_values("id"), pdf[~pdf["home"]].sort_values("id")
        empty = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("id", "links", "pairs", "low")})
        if not len(home) or not len(asked):
            return empty
        x, queries = np.stack(home["unit"].to_numpy()), np.stack(asked["unit"].to_numpy())
        hid, qid, copies = home["id"].to_numpy(), asked["id"].to_numpy(), home["copies"].to_numpy()
        i, j = linked(x, queries, threshold, exact)
        other = qid[i] != hid[j]
        i, j = i[other], j[other]
        if not len(i):
            return empty
        links, pairs = np.zeros(len(qid), np.int64), np.bincount(i, minlength=len(qid))
        np.add.at(links, i, copies[j])
        low_q, low_h = qid.copy(), hid.copy()
        while True:
            new_q, new_h = low_q.copy(), low_h.copy()
            np.minimum.at(new_q, i, low_h[j])
            np.minimum.at(new_h, j, new_q[i])
            if (new_q == low_q).all() and (new_h == low_h).all():
                break
            low_q, low_h = new_q, new_h
        mine, touched = np.unique(i), np.unique(j)
        none = np.zeros(len(touched), np.int64)
        return pd.DataFrame({"id": np.concatenate([qid[mine], hid[touched]]), "links": np.concatenate([links[mine], none]), "pairs": np.concatenate([pairs[mine], none]), "low": np.concatenate([low_q[mine], low_h[touched]])})

    return run


def _audit(ids: np.ndarray, queries: np.ndarray, threshold: float):
    """Batches of (id, copies, unit) -> by brute force, classes of the batch that each audited vector links with, if any."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                x, own = np.stack(pdf["unit"].to_numpy()), pdf["id"].to_numpy()
                n = np.concatenate([((queries[a : a + 256] @ x.T >= threshold) & (ids[a : a + 256, None] != own)).sum(1) for a in range(0, len(ids), 256)])
                yield pd.DataFrame({"id": ids[n > 0], "truth": n[n > 0]})

    return run


def audited(classes: DataFrame, total: int, threshold: float) -> dict[int, int]:
    """For vectors drawn at random that have links, the classes they link with, by brute force against all."""
    truth: dict[int, int] = {}
    span, low, drawn, turn = 1 << 31, 0, 0, 0
    at = F.pmod(F.xxhash64(F.lit(SEED + 1), "id"), F.lit(span))
    while low < span and len(truth) < LINKED and drawn < MOST_AUDITED:
        high = min(span, low + -(-AUDIT[min(turn, len(AUDIT) - 1)] * span // total))
        some = classes.filter((at >= low) & (at < high)).select("id", "unit").collect()
        low, turn, drawn = high, turn + 1, drawn + len(some)
        if some:
            ids, x = np.array([r[0] for r in some]), np.array([r[1] for r in some])
            counts = classes.mapInPandas(_audit(ids, x, threshold), "id long, truth long").groupBy("id").agg(F.sum("truth").alias("truth"))
            truth |= {r[0]: r[1] for r in counts.collect()}
    if low < span and len(truth) < LINKED:
        warnings.warn(f"vector_dedup: of {drawn} audited vectors only {len(truth)} have links, so its recall is tested on these alone", stacklevel=2)
    return truth


def recall(truth: dict[int, int], got: dict[int, int]) -> float | None:
    """The mean share found of a vector's links, or the share of all links if that is less; None if no audited one has any."""
    if not truth:
        return None
    hits = {i: min(got.get(i, 0), n) for i, n in truth.items()}
    return min(sum(hits[i] / n for i, n in truth.items()) / len(truth), sum(hits.values()) / sum(truth.values()))


def _neighbours(classes: DataFrame, total: int, threshold: float, cell: int, part: int, routes: int, target: float) -> tuple[DataFrame, float]:
    """(id, links, low) rows for classes (id, copies, unit) of one dimension, and the audited recall."""
    at = F.xxhash64(F.lit(SEED), "id")
    sample = classes if total <= FIT_SAMPLE else classes.filter(F.pmod(at, F.lit(total)) < int(1.1 * FIT_SAMPLE)).limit(FIT_SAMPLE)
    x = np.array([r[0] for r in sample.select("unit").orderBy("unit").collect()])
    k = min(MOST_CELLS, max(1, -(-total // cell)))
    centres = spherical_kmeans(x, k)
    truth = audited(classes, total, threshold)
    ids = classes.sparkSession.createDataFrame([(int(i),) for i in truth], "id long")
    exact = False
    while True:
        routed = materialise(classes.mapInPandas(_assign(centres, routes), "id long, copies long, unit array<double>, cell int, rank int"), "vector-cells")
        inner = _route_inner(routed, cell, part, max(2, routes // 2))
        inner = materialise(inner, "vector-inner")
        where = ["cell", "inner"]
        sizes = inner.groupBy(*where).agg(F.sum((F.col("rank") == 0).cast("long")).alias("n_home"), F.count("*").alias("n_asked"))
        rows = inner.join(F.broadcast(sizes), where)  # at most MOST_CELLS + MOST_INNER rows
        parts, blocks = (F.greatest(F.lit(1), F.ceil(F.col(c) / most)).cast("int") for c, most in (("n_home", part), ("n_asked", ASKED * part)))
        own = F.pmod(F.xxhash64(F.lit(SEED + 2), "id"), parts).cast("int")
        block = F.pmod(F.xxhash64(F.lit(SEED + 3), "id"), blocks).cast("int")
        home = rows.filter("rank = 0 and n_home > 0").select("id", "copies", "unit", *where, own.alias("part"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(True).alias("home"))
        asked = rows.filter("n_home > 0").select("id", "copies", "unit", *where, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), block.alias("block"), F.lit(False).alias("home"))
        found = home.unionByName(asked).groupBy(*where, "part", "block").applyInPandas(_search(threshold, exact), "id long, links long, pairs long, low long")
        found = materialise(found, "vector-links")
        discard(routed, inner)
        got = found.join(F.broadcast(ids), "id").groupBy("id").agg(F.sum("pairs").alias("n"))
        now = recall(truth, {r[0]: r[1] for r in got.collect()})
        if now is None or now >= target:
            return found, now
        if exact:
            raise RuntimeError(f"vector_dedup: the audited recall is {now:.4f}, below {target}, with all cells searched exactly")
        # With all cells asked, the graphs are what misses links.
        exact = routes >= k
        routes *= 2
        discard(found)


def vector_dedup(vectors: DataFrame, threshold: float = THRESHOLD, cell: int = CELL, part: int = PART, routes: int = ROUTES, target: float = TARGET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Link vectors whose cosine in double precision is ``threshold`` or more.

    Equal vectors are one class. Classes are dealt to cells around centres fitted on a bounded sample; cells of over
    ``part`` vectors are split by centres of their own, fitted on a sample of each (65,536 inner centres at most). Cells
    that are larger still are dealt into parts, and those who ask them into blocks, so no group outgrows ``part`` vectors
    and four times as many queries. In each group the home vectors that lead the others get a flat graph (overlapping shards,
    robust-pruned, lists united), the queries walk it from the shards' medoids, and only found leaders' followers are
    compared, directly. A query asks its ``routes`` nearest cells; a link counts in the one cell where the other vector is at home. The recall is audited by brute force
    against all, as the mean over vectors that have links, copies counted once: vectors are drawn until 64 with links are
    found or 65,536 are drawn (a warning tells of fewer). ``routes`` is doubled until the recall reaches ``target``; where
    all cells are asked and it is still missed, the cells are searched exactly, and an error is raised if that misses it. Groups give out counts and the smallest
    id reached, never pairs.

    Returns ``id_col, n_links, component_id, kept, audit_recall`` per row, the last one the audited recall, null if no audited vector has a link. Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing; so do rows with a null id, and vectors of different lengths with each
    other. Rows that repeat an id are one vector (the largest array), reported for each. An empty table gives an empty
    result; other columns are ignored, whatever their names. Ids are integers.
    """
    v = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    finite = F.coalesce(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False)) & (F.size("v") > 0)
    usable = rows.filter("id is not null").filter(finite).groupBy("id").agg(F.max("v").alias("v"))
    usable = usable.withColumn("top", F.array_max(F.transform("v", lambda e: F.abs(e)))).filter("top > 0")
    # Scaled by the largest component first, so that no square overflows or vanishes.
    usable = usable.select("id", F.expr("transform(v, e -> e / top)").alias("s"))
    usable = usable.select("id", F.expr("transform(s, e -> e / sqrt(aggregate(s, 0D, (acc, y) -> acc + y * y)))").alias("unit"))
    usable = materialise(usable, "vectors")
    classes = usable.groupBy("unit").agg(F.min("id").alias("head"), F.count("*").alias("copies"))
    classes = materialise(classes.select(F.col("head").alias("id"), "copies", "unit"), "vector-classes")
    member = materialise(usable.join(classes.select(F.col("id").alias("head"), "copies", "unit"), "unit").select("id", "head", "copies"), "vector-members")
    found, least_recall = None, None
    for dim, total in sorted((r[0], r[1]) for r in classes.groupBy(F.size("unit")).count().collect()):
        own = classes.filter(F.size("unit") == dim)
        part_found, part_recall = _neighbours(own, total, threshold, cell, part, routes, target)
        least_recall = min((r for r in (least_recall, part_recall) if r is not None), default=None)
        found = part_found if found is None else found.unionAll(part_found)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "id long, links long, low long")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("id").alias("a"), F.col("low").alias("b")), "vector-components")
    heads = attach(attach(member, links.withColumnRenamed("id", "head"), "head"), comps.withColumnRenamed("id", "head"), "head")
    label = heads.select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "head").alias("component"))
    out = attach(rows.select("id"), label, "id")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component.isNull() | (F.col("id") == component)).alias("kept"), F.lit(least_recall).cast("double").alias("audit_recall"))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(read_table(spark, sf_dir, "embeddings"))
