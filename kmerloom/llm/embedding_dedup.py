"""Near-duplicate embeddings through robust-pruned flat graphs.

Vectors of a label go to the cells of their nearest centroids, several each,
so cells overlap.  Inside a cell, graphs are built on overlapping cluster
shards: every vector gets the robust-pruned best of its nearest and of some
random shard members as neighbours.  The shards' adjacency lists are united,
and every vector of the cell is searched from the shards' medoids: greedily
towards the query, and once within range through all neighbours within
range.  What is found is verified by the cosine in double precision.
A bounded set of vectors is compared with all rows of their label to audit
the recall, and a larger one while too few true links are known; below the
asked recall, or where it stays unknown, beam and overlap double and the
search runs again, and where that leads nowhere all vectors of a label are
compared in blocks.  The recall that was measured and the true links it rests
on are columns of the result: ``recall`` is null on tables without a link.

Cells above ``BLOCK`` vectors are worked off as pairs of blocks, each in a
task of its own, so a cell that holds a third of all rows is no single task.
Exact copies are collapsed first and counted back in.

Defined results: null, zero or non-finite vectors and rows without a label
or id link with nothing; vectors of different lengths do not link; rows with
the same vector link with each other, repeated rows included; an id stands
for a vector, so different vectors of one id are in one class and no link of
their own; components of any finite size are scaled before they are
multiplied; other columns do not matter, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import sampled, small_batches, written
from kmerloom.llm.components import components

MIN_COSINE = 0.98
#: Vectors a centroid should have in the largest label; at most so many centroids; vectors they are fitted on.
CELL, MAX_CENTROIDS, CENTROID_SAMPLE = 512, 4096, 20_000
#: Cells of a vector, and vectors a block of a cell should have.
OVERLAP, BLOCK = 3, 2048
#: Degree, pruning slack, nearest and random candidates of a graph node; members a shard should have.
DEGREE, ALPHA, NEAREST, RANDOM, SHARD = 16, 1.2, 32, 16, 512
BEAM, EXPAND, MAX_BEAM = 24, 4, 1000
#: Vectors whose links the audit knows exactly at first and at most, links it should know, and the share of them that must be found.
AUDIT_ROWS, MAX_AUDIT_ROWS, AUDIT_LINKS, MIN_RECALL = 256, 4096, 200, 0.98


def _scaled(rows) -> np.ndarray:
    """Vectors in double precision times powers of two that bring their largest component near 1, which is exact."""
    v = np.stack([np.asarray(x, np.float64) for x in rows])
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _folded(v: np.ndarray, width: int) -> np.ndarray:
    """Vectors of another length as unit vectors of ``width`` components, for the choice of cells alone; equal ones stay equal."""
    v = np.pad(v, ((0, 0), (0, -v.shape[1] % width))).reshape(len(v), -1, width).sum(1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def clusters(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Centroids of unit vectors by spherical k-means."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ centers.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centers)
    return centers


def _top(x: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centers of each row."""
    n = min(n, len(centers))
    if n == len(centers):
        return np.tile(np.arange(n), (len(x), 1))
    return np.argpartition(-(x @ centers.T), n - 1, axis=1)[:, :n]


def prune(sims: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning for all rows at once; unused places hold -1.

    The nearest candidate left is taken, and those that are ``alpha`` times
    nearer to it than to the row are struck out.
    """
    rows = np.arange(len(candidates))[:, None]
    distance = np.sqrt(np.maximum(2 - 2 * sims[rows, candidates], 0))
    order = np.argsort(distance, axis=1, kind="stable")
    candidates, distance = candidates[rows, order], distance[rows, order]
    alive = candidates != rows
    out = np.full((len(candidates), degree), -1)
    for r in range(degree):
        first = alive.argmax(1)
        some = alive[rows[:, 0], first]
        if not some.any():
            break
        chosen = candidates[rows[:, 0], first]
        out[some, r] = chosen[some]
        between = np.sqrt(np.maximum(2 - 2 * sims[chosen[:, None], candidates], 0))
        alive &= alpha * between > distance
        alive[rows[:, 0], first] = False
        alive &= candidates != chosen[:, None]
    return out


def build(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """United adjacency lists (padded with -1) of graphs on overlapping shards, and the shards' medoids."""
    n = len(x)
    rng = np.random.default_rng(seed)
    n_shards = max(1, -(-2 * n // SHARD))
    homes = _top(x, clusters(x, n_shards, 4, seed), 2)
    lists: list[set[int]] = [set() for _ in range(n)]
    medoids = []
    for s in range(n_shards):
        own = np.flatnonzero((homes == s).any(1))
        if not len(own):
            continue
        # a shard of near copies can hold the whole cell; its parts then are shards themselves
        for part in np.array_split(rng.permutation(own), max(1, len(own) // (2 * SHARD))):
            y = x[part]
            sims = y @ y.T
            m = len(part)
            near = np.argpartition(-sims, min(NEAREST, m - 1), axis=1)[:, : NEAREST + 1]
            found = prune(sims, np.concatenate([near, rng.integers(0, m, (m, RANDOM))], 1))
            medoid = int((y @ y.mean(0)).argmax())
            medoids.append(int(part[medoid]))
            edges = [set(f[f >= 0].tolist()) for f in found]
            for i, f in enumerate(found):
                for j in f[f >= 0].tolist():
                    if len(edges[j]) < 2 * DEGREE:
                        edges[j].add(i)
            _connect(edges, sims, medoid)
            for i, e in enumerate(edges):
                lists[part[i]].update(part[list(e)].tolist())
    width = max(1, max(map(len, lists)))
    adjacency = np.full((n, width), -1)
    for i, e in enumerate(lists):
        adjacency[i, : len(e)] = sorted(e)
    return adjacency, np.unique(medoids)


def _connect(edges: list[set[int]], sims: np.ndarray, start: int) -> None:
    """Let the nearest reached node point at every node that the start does not reach."""
    reached = np.zeros(len(edges), bool)
    stack = [start]
    reached[start] = True
    while True:
        while stack:
            for j in edges[stack.pop()]:
                if not reached[j]:
                    reached[j] = True
                    stack.append(j)
        rest = np.flatnonzero(~reached)
        if not len(rest):
            return
        j = int(rest[0])
        i = int(np.where(reached, sims[j], -2).argmax())
        edges[i].add(j)
        reached[j] = True
        stack.append(j)


def search(queries: np.ndarray, x: np.ndarray, adjacency: np.ndarray, medoids: np.ndarray, least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``queries`` and of ``x`` whose similarity is at least ``least``, as far as the graph leads to them."""
    found_q, found_x = [], []
    for lo in range(0, len(queries), 512):
        q = queries[lo : lo + 512]
        n = len(q)
        sims = np.full((n, len(x) + 1), -2.0, np.float32)  # the last place takes the padding
        open_ = np.zeros((n, len(x) + 1), bool)
        sims[:, medoids] = q @ x[medoids].T
        open_[:, medoids] = True
        active = np.arange(n)
        while len(active):
            s, o = sims[active], open_[active]
            kth = np.partition(s, -min(beam, s.shape[1]), axis=1)[:, -min(beam, s.shape[1])]
            worth = np.where(o & (s >= np.minimum(kth, least)[:, None]), s, -2)
            step = np.argpartition(-worth, min(EXPAND, worth.shape[1]) - 1, axis=1)[:, :EXPAND]
            chosen = np.take_along_axis(worth, step, 1) > -2
            going = chosen.any(1)
            active, step, chosen = active[going], step[going], chosen[going]
            if not len(active):
                break
            open_[active[:, None], np.where(chosen, step, len(x))] = False
            next_ = np.where(chosen[:, :, None], adjacency[np.minimum(step, len(x) - 1)], -1).reshape(len(active), -1)
            r, c = np.nonzero(next_ >= 0)
            a, b = active[r], next_[r, c]
            new = sims[a, b] == -2
            pair = np.unique(a[new] * (len(x) + 1) + b[new])
            a, b = pair // (len(x) + 1), pair % (len(x) + 1)
            sims[a, b] = np.einsum("ij,ij->i", q[a], x[b])
            open_[a, b] = True
            open_[:, len(x)] = False
        a, b = np.nonzero(sims[:, : len(x)] >= least)
        found_q.append(a + lo)
        found_x.append(b)
    return np.concatenate(found_q), np.concatenate(found_x)


def _links_in(frame: pd.DataFrame, least: float, beam: int, exact: bool) -> pd.DataFrame:
    """Verified links between the two blocks of a cell (or inside one)."""
    frame = frame.sort_values("id", kind="stable")
    i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
    v = _scaled(frame["v"])
    ids, block = frame["id"].to_numpy(np.int64), frame["block"].to_numpy()
    index, query = np.flatnonzero(block == i), np.flatnonzero(block == j)
    if not len(index) or not len(query):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    x = _unit(v)
    if exact:
        found = [np.nonzero(x[query[lo : lo + 512]] @ x[index].T >= least - 1e-4) for lo in range(0, len(query), 512)]
        a = np.concatenate([f[0] + 512 * n for n, f in enumerate(found)])
        b = np.concatenate([f[1] for f in found])
    else:
        adjacency, medoids = build(x[index])
        a, b = search(x[query], x[index], adjacency, medoids, least - 1e-4, beam)
    a, b = query[a], index[b]
    cosine = (v[a] * v[b]).sum(1) / np.sqrt((v[a] ** 2).sum(1) * (v[b] ** 2).sum(1))
    ok = (cosine >= least) & (ids[a] != ids[b])
    a, b = ids[a[ok]], ids[b[ok]]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _links(points: DataFrame, centers: np.ndarray, least: float, overlap: int, beam: int, exact: bool = False) -> DataFrame:
    """Distinct verified links ``a`` < ``b`` of the points (``id``, ``label``, ``n``, ``v``) of equal label and length; ``exact`` compares all of them."""

    def assign(batches):
        for batch in batches:
            for _, part in batch.groupby("n"):
                cells = np.zeros((len(part), 1), int) if exact else _top(_folded(_scaled(part["v"]), centers.shape[1]), centers, overlap)
                out = part.iloc[np.repeat(np.arange(len(part)), cells.shape[1])].copy()
                out["cell"] = cells.reshape(-1).astype(np.int32)
                yield out

    kind = points.schema["v"].dataType.simpleString()
    label = points.schema["label"].dataType.simpleString()
    in_cells = points.mapInPandas(assign, f"id bigint, label {label}, n int, v {kind}, cell int")
    sizes = in_cells.groupBy("label", "n", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocked = in_cells.join(sizes, ["label", "n", "cell"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), "blocks").cast("int"))
    paired = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = paired.select("id", "label", "n", "v", "cell", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = tasks.groupBy("label", "n", "cell", "i", "j").applyInPandas(lambda f: _links_in(f, least, beam, exact), "a bigint, b bigint")
    return found.distinct()


def _recall(points: DataFrame, found: DataFrame, least: float, rows: int, links: int = AUDIT_LINKS) -> tuple[float | None, int]:
    """Share of a bounded query set's links that were found, and how many they are; all rows of their labels are compared in blocks.

    The set grows fourfold while fewer than ``links`` are known; without any
    link the share is unknown.
    """
    size = max(points.count(), 1)
    while True:
        total, hit = _known_links(points, found, least, rows / size)
        if total >= links or rows >= min(size, MAX_AUDIT_ROWS):
            return (hit / total if total else None), total
        rows = min(4 * rows, MAX_AUDIT_ROWS)


def _known_links(points: DataFrame, found: DataFrame, least: float, share: float) -> tuple[int, int]:
    """True links of a share of the points, and how many of them were found."""
    queries = points.where(sampled(share, "id", seed=5)).toPandas()
    groups = {n: (_unit(_scaled(own["v"])), own["id"].to_numpy(np.int64), own["label"].to_numpy()) for n, own in queries.groupby("n")}

    def compare(batches):
        for batch in batches:
            for n, part in batch.groupby("n"):
                if n in groups:
                    q, ids, labels = groups[n]
                    same = labels[:, None] == part["label"].to_numpy()[None, :]
                    a, b = np.nonzero((q @ _unit(_scaled(part["v"])).T >= least) & same)
                    other = part["id"].to_numpy(np.int64)
                    ok = ids[a] != other[b]
                    yield pd.DataFrame({"a": np.minimum(ids[a[ok]], other[b[ok]]), "b": np.maximum(ids[a[ok]], other[b[ok]])})

    true = points.mapInPandas(compare, "a bigint, b bigint").distinct()
    return tuple(true.join(found.withColumn("hit", F.lit(1)), ["a", "b"], "left").agg(F.count("*"), F.count("hit")).first())


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = MIN_COSINE, overlap: int = OVERLAP, beam: int = BEAM, min_recall: float = MIN_RECALL) -> DataFrame:
    """Per row: ``vec_id``, ``label``, ``n_links``, ``component_id`` and ``kept``; ``recall`` is that of the links, as measured on ``recall_links`` true ones (all of them, where all vectors were compared)."""
    small_batches(vectors.sparkSession)
    kind = vectors.schema[vector].dataType
    kind = kind if kind.simpleString() == "array<float>" else "array<double>"
    v = F.col(vector).cast(kind)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), v.alias("v"))
    top = F.aggregate("v", F.lit(0.0), lambda s, e: F.greatest(s, F.abs(e.cast("double"))))
    sound = F.size("v") > 0
    sound &= ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf")))) & (top > 0)
    sound = F.coalesce(sound & F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.lit(False))
    rows = written(rows.select("*", F.when(sound, F.sha2(F.to_binary(F.concat_ws(",", F.col("v").cast("array<string>")), F.lit("utf-8")), 256)).alias("digest")))
    alike = ["label", "digest"]
    points = rows.where("digest is not null").groupBy(*alike).agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.any_value("v").alias("v"))
    points = written(points.withColumn("n", F.size("v")))
    sizes = points.groupBy("label", "n").count().groupBy("n").agg(F.sum("count").alias("rows"), F.max("count").alias("largest"))
    usual = sizes.orderBy(F.desc("rows"), "n").first()
    narrow = points.select("id", "label", "n", "v")
    if usual is None:
        found, recall, links = points.select(F.col("id").alias("a"), F.col("id").alias("b")), None, 0
    else:
        largest = sizes.agg(F.max("largest")).first()[0]
        some = points.where(F.col("n") == usual["n"]).where(sampled(CENTROID_SAMPLE / usual["rows"], "id", seed=1)).select("id", "v").toPandas().sort_values("id")
        if some.empty:
            some = points.where(F.col("n") == usual["n"]).select("id", "v").limit(CENTROID_SAMPLE).toPandas()
        centers = clusters(_unit(_scaled(some["v"])), min(MAX_CENTROIDS, -(-largest // CELL)))
        while True:
            found = written(_links(narrow, centers, least, overlap, beam))
            recall, links = _recall(narrow, found, least, AUDIT_ROWS)
            if recall is not None and recall >= min_recall:
                break
            if overlap >= 2 * len(centers) or beam > MAX_BEAM:
                found = written(_links(narrow, centers, least, 1, beam, exact=True))
                links = found.count()
                recall = 1.0 if links else None
                break
            overlap, beam = 2 * overlap, 2 * beam
    copies = points.select("id", "copies")
    both = found.union(found.select("b", "a"))
    linked = both.join(copies.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("others"))
    named = components(found, "a", "b").select(F.col("node").alias("id"), "component")
    known = points.select(*alike, "id", "copies").join(linked, "id", "left").join(named, "id", "left")
    known = known.select(*alike, (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.select("vec_id", *alike).join(known, alike, "left")
    return out.select(
        "vec_id",
        "label",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"),
        F.lit(recall).cast("double").alias("recall"),
        F.lit(links).cast("long").alias("recall_links"),
    )
