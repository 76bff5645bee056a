"""Operator 2: exact top-k by inner product with dual cover trees.

Vectors are dealt to blocks of near ones; every block has a cover tree, and so has every group of
queries. A pair of nodes can score at most

    <q, p> + radius_q |p| + radius_p |q| + radius_q radius_p

for centres q, p and covering radii; it is pruned when that is below the worst k-th score of the
queries in the group. Before any trees meet, the same bound prunes whole blocks for whole groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, materialize

#: Points of a leaf among the data and among queries (whose leaves share one bound), and children.
LEAF, QUERY_LEAF, FAN = 64, 8, 16
SCALE = 256
#: Components up to this size give scores that a double holds exactly.
EXACT = 1 << 20
LEAST = -(1 << 63)


class CoverTree:
    """Nodes over a reordered copy of the points, a parent before its children.

    The children of a node are points apart from each other, chosen farthest first; each point goes
    to the nearest. A node's radius covers all points below it, and is measured, not assumed.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        self.leaf, self.order = leaf, np.arange(len(ids))
        self.x = points.astype(np.float64)
        self.centre, self.radius, self.low, self.high, self.children = [], [], [], [], []
        if len(ids):
            self._grow(0, len(ids), 0)
        self.ids, self.points, self.x = ids[self.order], points[self.order], self.x[self.order]
        self.centre, self.radius = np.array(self.centre).reshape(len(self.radius), points.shape[1]), np.array(self.radius)
        self.low, self.high = np.array(self.low, np.int64), np.array(self.high, np.int64)
        self.norm = np.sqrt((self.centre**2).sum(1))

    def _grow(self, low: int, high: int, centre: int) -> int:
        """The node of order[low:high] about the point order[centre]."""
        at, own = self.order[low:high], self.x[self.order[centre]]
        distance = np.sqrt(((self.x[at] - own) ** 2).sum(1))
        node = len(self.radius)
        self.centre.append(own)
        self.radius.append(float(distance.max()) * (1 + 1e-9) + 1e-6)
        self.low.append(low)
        self.high.append(high)
        self.children.append([])
        if high - low <= self.leaf or distance.max() == 0:
            return node
        nearest, owner = distance, np.zeros(len(at), np.int64)
        for child in range(1, FAN):
            far = int(nearest.argmax())
            if nearest[far] <= self.radius[node] / 4:
                break
            d = np.sqrt(((self.x[at] - self.x[at[far]]) ** 2).sum(1))
            closer = d < nearest
            nearest, owner = np.where(closer, d, nearest), np.where(closer, child, owner)
        sort = np.lexsort((nearest, owner))
        self.order[low:high] = at[sort]
        bounds = low + np.searchsorted(owner[sort], np.arange(owner.max() + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if a < b:
                self.children[node].append(self._grow(a, b, a))
        return node


class Best:
    """The best k (score, id) of each query: higher scores first, ties to smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), LEAST, np.int64)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.count = np.zeros(n, np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        k = self.k
        worst = self.score[rows, k - 1][:, None]
        better = allowed & ((self.count[rows] < k)[:, None] | (scores >= worst))
        some = np.flatnonzero(better.any(1))
        for i in some.tolist():
            r = int(rows[i])
            new = np.flatnonzero(better[i])
            if len(new) > 4 * k:  # whatever lies below the new k-th is out
                cut = np.partition(scores[i, new], len(new) - k)[len(new) - k]
                new = new[scores[i, new] >= cut]
            have = int(self.count[r])
            s = np.concatenate((self.score[r, :have], scores[i, new]))
            v = np.concatenate((self.id[r, :have], ids[new]))
            top = np.lexsort((v, ~s))[:k]  # ~s orders descending without overflow
            self.count[r] = len(top)
            self.score[r, : len(top)], self.id[r, : len(top)] = s[top], v[top]

    def worst(self) -> np.ndarray:
        return np.where(self.count < self.k, -np.inf, self.score[:, -1].astype(np.float64))


def _scores(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (a @ b.T).astype(np.int64)
    big = a.astype(object) @ b.T.astype(object)
    return np.clip(big, LEAST, -LEAST - 1).astype(np.int64) if big.size else big.astype(np.int64)


def search(queries: CoverTree, data: CoverTree, k: int, floor: np.ndarray, exact: bool) -> Best:
    """Each query's best k in ``data``; ``floor`` is a score that each query's k-th best reaches
    anyway, -inf if none is known. Pairs of one id don't count."""
    best = Best(len(queries.ids), k)
    if not len(queries.ids) or not len(data.ids):
        return best
    points_q = queries.x if exact else queries.points
    points_d = data.x if exact else data.points

    def bound(q: int, nodes: np.ndarray) -> np.ndarray:
        if not exact:
            return np.full(len(nodes), np.inf)
        inner = data.centre[nodes] @ queries.centre[q]
        b = inner + queries.radius[q] * data.norm[nodes] + data.radius[nodes] * (queries.norm[q] + queries.radius[q])
        return b + 1e-9 * (np.abs(b) + 1)

    def limit(low: int, high: int) -> float:
        return float(np.maximum(best.worst()[low:high], floor[low:high]).min())

    todo = [(0, np.zeros(1, np.int64))]
    while todo:
        q, nodes = todo.pop()
        low, high = int(queries.low[q]), int(queries.high[q])
        if queries.children[q]:  # go down on the data side by one level, then on the query side
            nodes = nodes[bound(q, nodes) >= limit(low, high)]
            nodes = np.array([c for n in nodes.tolist() for c in (data.children[n] or [n])], np.int64)
            todo += [(child, nodes) for child in queries.children[q]]
            continue
        rows = np.arange(low, high)
        while len(nodes):  # the most promising first: inner nodes open, leaves are scored
            reach = bound(q, nodes)
            keep = reach >= limit(low, high)
            nodes, reach = nodes[keep], reach[keep]
            first = np.argsort(-reach)[:FAN]
            now, nodes = nodes[first], np.delete(nodes, first)
            inner = [c for n in now.tolist() for c in data.children[n]]
            leaves = [n for n in now.tolist() if not data.children[n]]
            if leaves:
                at = np.concatenate([np.arange(data.low[n], data.high[n]) for n in leaves])
                for part in range(0, len(at), 4096):
                    p = at[part : part + 4096]
                    allowed = queries.ids[rows][:, None] != data.ids[p][None, :]
                    best.add(rows, _scores(points_q[rows], points_d[p], exact), data.ids[p], allowed)
            nodes = np.concatenate((nodes, np.array(inner, np.int64)))
    return best


def _matrix(column, width: int) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(len(column), width)


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    width = int(pdf["width"].iloc[0])
    pdf = pdf.sort_values("vec_id", kind="stable")
    return pd.DataFrame(
        {
            "width": [width],
            "run": [int(pdf["run"].iloc[0])],
            "part": [int(pdf["part"].iloc[0])],
            "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
            "vectors": [_matrix(pdf["v"], width).tobytes()],
        }
    )


def _unpack(ids: bytes, vectors: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(vectors, np.int64).reshape(len(ids), width)


def _is_exact(*matrices: np.ndarray) -> bool:
    return all(not m.size or int(np.abs(m).max()) <= EXACT and int(m.min()) > LEAST for m in matrices) and all(m.shape[1] <= 4096 for m in matrices)


def _meet(k: int):
    """One block against the query groups of one chunk."""

    def meet(key, block: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(groups):
            width = int(block["width"].iloc[0])
            ids, points = _unpack(block["ids"].iloc[0], block["vectors"].iloc[0], width)
            tree = CoverTree(ids, points)
            for g in groups.itertuples():
                q_ids, q_points = _unpack(g.q_ids, g.q_vectors, width)
                own = CoverTree(q_ids, q_points, QUERY_LEAF)
                floor = np.frombuffer(g.floors, np.float64)[own.order] if g.floors else np.full(len(q_ids), -np.inf)
                best = search(own, tree, k, floor, _is_exact(points, q_points))
                for row, n in enumerate(best.count.tolist()):
                    out += [(int(own.ids[row]), int(best.id[row, j]), int(best.score[row, j]), int(g.q_run), int(g.q_part)) for j in range(n)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "q_run", "q_part"])

    return meet


FOUND = "query_id long, vec_id long, score long, q_run long, q_part long"


def _cogroup(blocks: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """groups: width, run, part, chunk (of the block to meet) and q_run, q_part, q_ids, q_vectors, floors."""
    chunks = groups.select("width", "run", "part", "chunk").distinct()
    left = blocks.join(chunks, ["width", "run", "part"])
    keys = ["width", "run", "part", "chunk"]
    right = groups.withColumnsRenamed({c: f"g_{c}" for c in keys})
    return left.groupBy(*keys).cogroup(right.groupBy(*[f"g_{c}" for c in keys])).applyInPandas(_meet(k), FOUND)


def _pivots(sample: list, most: int) -> dict[int, np.ndarray]:
    """By width: up to ``most`` pivots, near ones next to each other (the order of a cover tree)."""
    out = {}
    by_width: dict[int, list] = {}
    for row in sample:
        by_width.setdefault(len(row["v"]), []).append(row["v"])
    for width, rows in by_width.items():
        points = np.array(rows, np.float64).reshape(len(rows), width)
        tree = CoverTree(np.arange(len(rows)), points)
        leaves = [i for i, c in enumerate(tree.children) if not c]
        leaves.sort(key=lambda i: tree.low[i])
        step = -(-len(leaves) // most)
        out[width] = tree.centre[leaves][::step]
    return out


def _assign(shared):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            vectors = batch.column("v")
            values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            bounds = vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
            width = np.diff(bounds)
            pivot, distance = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for w in np.unique(width).tolist():
                rows = np.flatnonzero(width == w)
                x = values[(bounds[rows][:, None] + np.arange(w)).ravel()].reshape(len(rows), w)
                c = pivots.get(w, np.zeros((1, w)))
                d = (c**2).sum(1) - 2 * x @ c.T
                pivot[rows] = d.argmin(1)
                distance[rows] = np.sqrt(((x - c[pivot[rows]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), vectors, pa.array(width.astype(np.int64)), pa.array(pivot), pa.array(distance)],
                ["vec_id", "v", "width", "pivot", "distance"],
            )

    return assign


def _reachable(shared, chunk_groups: int):
    """Every query group with each run that may hold something better; the run's parts are numbered out."""

    def reachable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = shared.value  # width -> (run, centre, radius, parts)
        for pdf in batches:
            rows = []
            for n, g in enumerate(pdf.itertuples()):
                ids, points = _unpack(g.q_ids, g.q_vectors, int(g.width))
                x = points.astype(np.float64)
                worst = float(np.frombuffer(g.floors, np.float64).min())
                for run, centre, radius, parts in runs[int(g.width)]:
                    reach = (x @ centre + radius * np.sqrt((x**2).sum(1))).max()
                    if not _is_exact(points) or reach + 1e-9 * abs(reach) + 1e-3 >= worst:
                        rows += [(g.width, run, part, (g.q_part * 7919 + g.q_run) // chunk_groups, g.q_run, g.q_part, g.q_ids, g.q_vectors, g.floors) for part in range(parts) if part or run != g.q_run]
                if len(rows) >= 256:
                    yield pd.DataFrame(rows, columns=_REACH)
                    rows = []
            yield pd.DataFrame(rows, columns=_REACH)

    return reachable


_REACH = ["width", "run", "part", "chunk", "q_run", "q_part", "q_ids", "q_vectors", "floors"]
_REACH_SCHEMA = "width long, run long, part long, chunk long, q_run long, q_part long, q_ids binary, q_vectors binary, floors binary"


def _with_floors(k: int):
    def floors(key, group: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = group.copy()
        if len(group):
            kth = {q: s.to_numpy()[k - 1] for q, s in found.sort_values("score", ascending=False).groupby("query_id")["score"] if len(s) >= k}
            ids = np.frombuffer(group["q_ids"].iloc[0], np.int64)
            out["floors"] = [np.array([float(kth.get(i, -np.inf)) for i in ids.tolist()]).tobytes()]
        return out[["width", "q_run", "q_part", "q_ids", "q_vectors", "floors"]]

    return floors


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, block_rows: int = 4096, group_queries: int = 256, sample: int = 4096, most_pivots: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query.

    ``vectors`` has vec_id and embedding; components become floor(256 x), x as double. Queries are
    the rows where ``is_query`` holds, candidates all rows but those of the query's own id; ties go
    to smaller ids, and a query with fewer candidates gets all. Rows take no part when the id or the
    vector is null, or a component is null or not finite; vectors of different lengths aren't
    compared, empty ones score 0 with each other. A repeated row is a candidate as often as it
    stands there, and a query once (of different vectors of one id, the smallest). Scores beyond 64
    bits stop at their ends. Other columns are ignored; an empty table gives an empty table.

    Pivots come from ``sample`` rows chosen by hash; they steer the work, never the result. Blocks
    and groups have bounded rows at any input size, and a large run of pivots is dealt by hash.
    """
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    valid = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    valid = valid.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), is_query.alias("is_query"))
    valid = materialize(valid, "vectors")
    chosen = bounded_sample(valid.select("vec_id", "v"), valid.count(), sample, "vec_id", "v")
    pivots = _pivots(chosen.collect(), most_pivots)
    shared = spark.sparkContext.broadcast(pivots)
    schema = "vec_id long, v array<long>, width long, pivot long, distance double"
    near = materialize(valid.select("vec_id", "v").mapInArrow(_assign(shared), schema), "vectors-near")
    stats = near.groupBy("width", "pivot").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()

    # neighbouring pivots make runs of at least half a block; runs and their covering balls are few
    runs: dict[int, list] = {}
    place = []
    for width in sorted({r["width"] for r in stats}):
        have = sorted((r for r in stats if r["width"] == width), key=lambda r: r["pivot"])
        gathered, rows = [], 0
        for i, r in enumerate(have):
            gathered.append(r)
            rows += r["n"]
            left = sum(x["n"] for x in have[i + 1 :])
            if (rows >= block_rows // 2 and left >= block_rows // 2) or i == len(have) - 1:
                centres = pivots.get(width, np.zeros((1, width)))[[x["pivot"] for x in gathered]]
                centre = np.average(centres, axis=0, weights=[x["n"] for x in gathered])
                radius = max(float(np.sqrt(((c - centre) ** 2).sum())) + x["radius"] for c, x in zip(centres, gathered, strict=True))
                run = len(place)
                parts = -(-rows // block_rows)
                runs.setdefault(width, []).append((run, centre, radius * (1 + 1e-9) + 1e-6, parts))
                place += [(width, x["pivot"], run, parts) for x in gathered]
                gathered, rows = [], 0
    where = spark.createDataFrame(place, "width long, pivot long, run long, parts long")
    placed = near.join(F.broadcast(where), ["width", "pivot"])  # a row for each pivot
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), "parts"))
    packed = "width long, run long, part long, ids binary, vectors binary"
    keys = ["width", "run", "part"]
    blocks = materialize(dealt.select(*keys, "vec_id", "v").groupBy(*keys).applyInPandas(_pack, packed), "vector-blocks")
    queries = valid.filter("is_query").groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = materialize(queries.mapInArrow(_assign(shared), schema), "queries-near").join(F.broadcast(where), ["width", "pivot"])
    per_run = F.ceil(F.col("parts") * F.lit(block_rows) / F.lit(group_queries * 16))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), per_run))
    groups = asked.select(*keys, "vec_id", "v").groupBy(*keys).applyInPandas(_pack, packed)
    groups = groups.select("width", F.col("run").alias("q_run"), F.col("part").alias("q_part"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    groups = materialize(groups, "query-groups")

    home = groups.select("width", F.col("q_run").alias("run"), F.lit(0).cast("long").alias("part"), (F.col("q_part") / 16).cast("long").alias("chunk"), "q_run", "q_part", "q_ids", "q_vectors", F.lit(None).cast("binary").alias("floors"))
    first = materialize(_cogroup(blocks, home, k), "found-at-home")
    group_keys = ["q_run", "q_part"]
    at_home = first.withColumnsRenamed({c: f"f_{c}" for c in group_keys})
    floored = groups.groupBy(*group_keys).cogroup(at_home.groupBy(*[f"f_{c}" for c in group_keys])).applyInPandas(_with_floors(k), "width long, q_run long, q_part long, q_ids binary, q_vectors binary, floors binary")
    balls = spark.sparkContext.broadcast(runs)
    reach = materialize(floored.mapInPandas(_reachable(balls, 64), _REACH_SCHEMA), "reachable")
    found = materialize(first.unionByName(_cogroup(blocks, reach, k)), "found")
    best = F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("s"), "vec_id", "score")))
    return found.groupBy("query_id").agg(F.slice(best, 1, k).alias("b")).select("query_id", F.posexplode("b").alias("i", "x")).select("query_id", (F.col("i") + 1).alias("rank"), "x.vec_id", "x.score")
