"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Vectors are scaled to length one, where cosine >= t means a Euclidean distance of at most far = sqrt(2 - 2 t). Equal
vectors are one point with a weight.

1. Cells. Every point goes to the nearest of at most PIVOTS pivots (farthest first in a sample of SAMPLE vectors), a cell
   is cut by a hash of its points into blocks of about BLOCK points.
2. Trees. A task builds the cover tree of a block once and writes it: nested levels whose radii halve, the first child of
   a node at the node's own centre, every other centre farther than the level's radius from those before it.
3. Pairs of blocks. Cells whose pivots are farther apart than far and both reaches are dropped, then blocks by centre and
   covering radius. A pair of blocks so near that all their points link is accepted whole. No vector moves for this.
4. Dual traversal of the pairs left, in tiles of some blocks by some blocks: a pair of nodes is dropped when its centres are
   farther apart than far plus both covering radii, accepted whole when nearer than far less both, and opened
   otherwise; single points are compared by cosine in double precision.

Scale: a tile returns counts and a spanning forest of its links, never the links, so a group of m near copies gives m rows
a tile. Compact blocks meet few others. In high dimensions without clusters all points lie about equally far from each
other, no bound drops a pair, and the number of tiles grows with the square of the input: the exact join has no way around it.
The driver gets the sample and two rows a cell.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and form their own
component; vectors of different lengths never link; a row with a null vec_id links like any other and its component is
the least vec_id reachable, or null; repeated vec_ids are rows of their own; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import components, materialize

THRESHOLD = 0.9
BLOCK = 2048
#: Bounds of the sample that pivots are drawn from, and of the pivots.
SAMPLE, PIVOTS = 2048, 512
#: Most blocks on each side of a tile, and about how many tiles to a side are wanted before tiles grow.
TILE, SIDES = 8, 16
SLACK = 1e-6
#: Below this radius a node is not opened: its points are compared.
TINY = 1e-7


class Tree:
    """Cover tree over the rows of x (unit length), which it puts in depth-first order: node k has the rows [begin, end).

    centre (a row), radius (largest distance of a row below), first and last: the node's children, numbered side by side.
    """

    def __init__(self, x: np.ndarray, centre: np.ndarray, radius: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.x, self.centre, self.radius, self.begin, self.end, self.first, self.last = x, centre, radius, begin, end, first, last

    @staticmethod
    def grow(x: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree of x, and the order of its rows."""
        gram = x @ x.T
        dist = np.sqrt(np.maximum(0.0, 2 - 2 * gram))
        np.fill_diagonal(dist, 0)
        order, nodes = np.arange(len(x)), []

        def add(centre: int, begin: int, points: np.ndarray) -> int:
            order[begin : begin + len(points)] = points
            nodes.append([centre, float(dist[centre, points].max()), begin, begin + len(points), 0, 0])
            return len(nodes) - 1

        todo = [(add(int(gram.sum(1).argmax()), 0, order.copy()), 2.0)]
        while todo:
            node, half = todo.pop()
            here, radius, begin, end = nodes[node][:4]
            if end - begin == 1 or radius < TINY:
                continue
            half /= 2
            while half >= radius:  # levels at which all points share one node
                half /= 2
            points, nodes[node][4] = order[begin:end].copy(), len(nodes)
            while len(points):
                near = dist[here, points] <= half
                todo.append((add(here, begin, points[near]), half))
                begin += int(near.sum())
                points = points[~near]
                here = int(points[0]) if len(points) else -1
            nodes[node][5] = len(nodes)
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        cols = [np.array(c) for c in zip(*nodes, strict=True)]
        return Tree(x[order], place[cols[0]], *cols[1:]), order

    def pack(self) -> dict[str, bytes]:
        ints = np.stack([self.centre, self.begin, self.end, self.first, self.last]).astype("<i4")
        return {"x": self.x.astype("<f8").tobytes(), "radii": self.radius.astype("<f8").tobytes(), "nodes": ints.tobytes()}

    @staticmethod
    def unpack(x: bytes, radii: bytes, nodes: bytes, dim: int) -> Tree:
        c, b, e, f, last = np.frombuffer(nodes, "<i4").reshape(5, -1).astype(np.int64)
        return Tree(np.frombuffer(x, "<f8").reshape(-1, dim), c, np.frombuffer(radii, "<f8"), b, e, f, last)


class Links:
    """Link counts and a spanning forest over points laid end to end."""

    def __init__(self, n: int):
        self.count, self.up = np.zeros(n, np.int64), np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def apart(least: float) -> float:
    """The distance of unit vectors with cosine `least`."""
    return float(np.sqrt(max(0.0, 2 - 2 * least)))


def traverse(a: Tree, b: Tree, wa: np.ndarray, wb: np.ndarray, same: bool, least: float, links: Links, sa: int, sb: int, small: int = 256) -> int:
    """Counts all pairs of points of a and b with cosine >= least, at sa and sb in `links`; in one tree (same) every pair counts for
    both its points. Pairs of nodes with at most `small` pairs of points are not opened. Returns how many pairs of points were compared one by one."""
    far, compared = apart(least), 0

    def exact(pu: np.ndarray, pv: np.ndarray, ru: np.ndarray, rv: np.ndarray, wanted: np.ndarray) -> None:
        """Compares points pu of a with pv of b, where wanted[ru, rv]."""
        other = b.x[pv].T
        for k in range(0, len(pu), 512):
            mine = pu[k : k + 512]
            cos = a.x[mine] @ other
            ok = cos >= least
            for i, j in np.argwhere(np.abs(cos - least) < 1e-9):  # the product's order of sums must not decide
                ok[i, j] = float(np.sum(a.x[mine[i]] * b.x[pv[j]])) >= least
            i, j = np.nonzero(ok)
            take = wanted[ru[k + i], rv[j]]
            i, j = i[take], j[take]
            np.add.at(links.count, sa + mine[i], wb[pv[j]])
            if not same:
                np.add.at(links.count, sb + pv[j], wa[mine[i]])
            for p, q in zip((sa + mine[i]).tolist(), (sb + pv[j]).tolist(), strict=True):
                if links.up[p] != links.up[q]:
                    links.join(p, q)

    def spread(begin: np.ndarray, end: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The points of nodes, and which node of the list each is of."""
        n = (end - begin)[nodes]
        which = np.repeat(np.arange(len(nodes)), n)
        return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + begin[nodes][which], which

    todo = [(np.array([0]), np.array([0]))]
    while todo:
        na, nb = todo.pop()
        for k in range(0, len(na), 1024):
            part = na[k : k + 1024]
            d = np.sqrt(np.maximum(0, 2 - 2 * (a.x[a.centre[part]] @ b.x[b.centre[nb]].T)))
            reach = a.radius[part][:, None] + b.radius[nb]
            near = d <= far + reach + SLACK
            size = (a.end - a.begin)[part][:, None] * (b.end - b.begin)[nb]
            whole = near & (d <= far - reach - SLACK) & (size > 1)
            single = near & ~whole & ((size <= small) | ((a.first == a.last)[part][:, None] & (b.first == b.last)[nb]))
            if single.any():  # all of these pairs in one product
                rows, cols = np.flatnonzero(single.any(1)), np.flatnonzero(single.any(0))
                pu, ru = spread(a.begin, a.end, part[rows])
                pv, rv = spread(b.begin, b.end, nb[cols])
                compared += int(size[single].sum())
                exact(pu, pv, ru, rv, single[np.ix_(rows, cols)])
            for i, j in np.argwhere(whole):
                u, v = int(part[i]), int(nb[j])
                pu, pv = slice(int(a.begin[u]), int(a.end[u])), slice(int(b.begin[v]), int(b.end[v]))
                links.count[sa + pu.start : sa + pu.stop] += wb[pv].sum()
                if not same:
                    links.count[sb + pv.start : sb + pv.stop] += wa[pu].sum()
                for p in range(sa + pu.start, sa + pu.stop):
                    links.join(sa + pu.start, p)
                for p in range(sb + pv.start, sb + pv.stop):
                    links.join(sa + pu.start, p)
            wide = near & ~whole & ~single
            for i in np.flatnonzero(wide.any(1)):
                u, kept_v = int(part[i]), []
                for v in nb[wide[i]].tolist():
                    has_a, has_b = a.first[u] < a.last[u], b.first[v] < b.last[v]
                    open_a = has_a and (2 * a.radius[u] >= b.radius[v] or not has_b)
                    if has_b and (2 * b.radius[v] >= a.radius[u] or not has_a):
                        todo.append((np.arange(a.first[u], a.last[u]) if open_a else np.array([u]), np.arange(b.first[v], b.last[v])))
                    else:
                        kept_v.append(v)
                if kept_v:  # small nodes that meet one that is opened
                    todo.append((np.arange(a.first[u], a.last[u]), np.array(kept_v)))
    return compared


def rows_with_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of every row: v as doubles in an array, null for vectors that can't link."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id"), F.when(F.size("embedding") > 0, v).alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.select("vec_id", F.when(sound, F.col("v")).alias("v"))


def links(vectors: DataFrame, least: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors."""
    named = materialize(rows_with_vectors(vectors).withColumn("h", F.when(F.col("v").isNotNull(), F.sha2(F.to_json(F.struct("v")), 256))))
    # equal vectors are one point: its least id, how many there are
    points = named.where("h is not null").groupBy("h").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("w"), F.any_value("v").alias("v"))
    points = materialize(points.withColumns({"point": F.monotonically_increasing_id(), "dim": F.size("v")}))
    found = None
    for dim in sorted(r["dim"] for r in points.select("dim").distinct().collect()):
        part = _links_of(points.where(F.col("dim") == dim), int(dim), least, block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialize(found)
    counts = found.groupBy("point").agg(F.sum("links").alias("links"))
    merged = components(found.select(F.col("point").alias("a"), F.col("to").alias("b")))
    of_point = points.select("h", "point", "least_id", "w").join(counts, "point", "left").join(merged, F.col("point") == F.col("id"), "left")
    of_point = materialize(of_point.select("h", "least_id", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "point").alias("comp")))
    least_ids = of_point.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    out = named.select("vec_id", "h").join(of_point.join(least_ids, "comp").select("h", "n_links", "component_id"), "h", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("h").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


TREE = "cell int, block long, centre array<double>, centre_point long, radius double, reach double, weight long, x binary, radii binary, nodes binary, ids binary, weights binary"


def blocks_of(points: DataFrame, dim: int, block: int) -> tuple[DataFrame, np.ndarray]:
    """The trees of points (point, w, v), one row each (TREE), and the pivots of the cells."""
    spark, n = points.sparkSession, points.count()
    wanted = max(1, -(-n // block))
    sample = [np.array(r["v"]) for r in points.orderBy(F.xxhash64("point")).limit(min(SAMPLE, n)).select("v").collect()]
    sample = np.stack([x / np.linalg.norm(x) for x in sample])
    chosen = [0]
    d = 2 - 2 * sample @ sample[0]
    while len(chosen) < min(PIVOTS, wanted, len(sample)):  # farthest first
        chosen.append(int(d.argmax()))
        d = np.minimum(d, 2 - 2 * sample @ sample[chosen[-1]])
    pivots = sample[chosen]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = np.array(batch.column("v").flatten().to_numpy(zero_copy_only=False), "f8").reshape(-1, dim)
                raw /= np.linalg.norm(raw, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([pa.array((raw @ pivots.T).argmax(1), pa.int32()), batch.column("point"), batch.column("w"), pa.array([r.tobytes() for r in raw], pa.binary())], ["cell", "point", "w", "v"])

    dealt = materialize(points.select("point", "w", "v").mapInArrow(deal, "cell int, point long, w long, v binary"))
    cuts, first = [], 0
    for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").collect():  # at most PIVOTS rows
        parts = max(1, -(-r["n"] * 5 // (block * 4)))
        cuts.append((r["cell"], first, parts))
        first += parts
    cuts_df = spark.createDataFrame(cuts, "cell int, first long, parts long")
    split = dealt.join(F.broadcast(cuts_df), "cell").select("cell", (F.col("first") + F.pmod(F.xxhash64("point"), F.col("parts"))).alias("block"), "point", "w", "v")

    def build(t: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(t.column("v").to_pylist()), "f8").reshape(-1, dim)
        tree, order = Tree.grow(x)
        ids, w = t.column("point").to_numpy()[order], t.column("w").to_numpy()[order]
        cell = t.column("cell")[0].as_py()
        reach = float(np.sqrt(np.maximum(0, 2 - 2 * (tree.x @ pivots[cell]))).max())
        row = {"cell": cell, "block": t.column("block")[0].as_py(), "centre": tree.x[tree.centre[0]].tolist(), "centre_point": int(ids[tree.centre[0]]), "radius": float(tree.radius[0]), "reach": reach, "weight": int(w.sum()), **tree.pack(), "ids": ids.astype("<i8").tobytes(), "weights": w.astype("<i8").tobytes()}
        kinds = {"cell": pa.int32(), "centre": pa.list_(pa.float64())}
        return pa.table({k: pa.array([v], kinds.get(k)) for k, v in row.items()})

    return materialize(split.groupBy("block").applyInArrow(build, TREE)), pivots


def block_pairs(trees: DataFrame, pivots: np.ndarray, least: float) -> DataFrame:
    """(b, q, whole) with b <= q: pairs of blocks that may hold a link, whole if all their points link."""
    spark, far = trees.sparkSession, apart(least)
    reach = {r["cell"]: r["reach"] for r in trees.groupBy("cell").agg(F.max("reach").alias("reach")).collect()}  # at most PIVOTS rows
    cells = sorted(reach)
    r = np.array([reach[c] for c in cells])
    d = np.sqrt(np.maximum(0, 2 - 2 * pivots[cells] @ pivots[cells].T))
    near = np.argwhere(np.triu(d <= far + r[:, None] + r + SLACK))
    pairs = spark.createDataFrame(pa.table({"cell": pa.array([cells[i] for i in near[:, 0]], pa.int32()), "cell2": pa.array([cells[i] for i in near[:, 1]], pa.int32())}))
    heads = trees.select("cell", "block", "centre", "radius")
    left, right = heads.select("cell", F.col("block").alias("b"), F.col("centre").alias("c"), F.col("radius").alias("r")), heads.select(F.col("cell").alias("cell2"), F.col("block").alias("q"), F.col("centre").alias("c2"), F.col("radius").alias("r2"))
    met = left.join(pairs, "cell").join(right, "cell2").where("b <= q")
    dot = F.aggregate(F.zip_with("c", "c2", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    met = met.select("b", "q", (F.col("r") + F.col("r2")).alias("reach"), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot)).alias("d"))
    met = met.where(F.col("d") <= far + F.col("reach") + SLACK)
    return materialize(met.select("b", "q", ((F.col("b") < F.col("q")) & (F.col("d") <= far - F.col("reach") - SLACK)).alias("whole")))


def _links_of(points: DataFrame, dim: int, least: float, block: int) -> DataFrame:
    """(point, links, to) for points of one dimension: counts by tile, and links of a spanning forest."""
    trees, pivots = blocks_of(points, dim, block)
    pairs = block_pairs(trees, pivots, least)
    tile = int(min(TILE, max(1, trees.count() // SIDES)))
    open_pairs = pairs.where("not whole").select(F.floor(F.col("b") / tile).alias("i"), F.floor(F.col("q") / tile).alias("j"), "b", "q")
    ends = F.explode(F.array(F.struct(F.col("b").alias("block"), F.col("q").alias("partner")), F.struct(F.col("q").alias("block"), F.lit(None).cast("long").alias("partner"))))
    needed = open_pairs.select("i", "j", ends.alias("e")).groupBy("i", "j", "e.block").agg(F.collect_set("e.partner").alias("partners"))  # at most TILE
    work = needed.join(trees.select("block", "x", "radii", "nodes", "ids", "weights"), "block")

    def solve(t: pa.Table) -> pa.Table:
        rows = t.select(["block", "partners", "x", "radii", "nodes", "ids", "weights"]).to_pylist()
        trees = [Tree.unpack(r["x"], r["radii"], r["nodes"], dim) for r in rows]
        ids, weights = [np.frombuffer(r["ids"], "<i8") for r in rows], [np.frombuffer(r["weights"], "<i8") for r in rows]
        at = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        got, names, place = Links(int(at[-1])), np.concatenate(ids), {r["block"]: k for k, r in enumerate(rows)}
        for m, r in enumerate(rows):
            for k in sorted(place[q] for q in r["partners"]):
                traverse(trees[m], trees[k], weights[m], weights[k], m == k, least, got, int(at[m]), int(at[k]))
                if m == k:
                    got.count[at[m] : at[m + 1]] -= weights[m]  # a point meets itself
        hit = np.flatnonzero(got.count)
        roots = np.array([got.root(int(x)) for x in hit], np.int64)
        return pa.table({"point": names[hit], "links": got.count[hit], "to": names[roots]})

    found = work.groupBy("i", "j").applyInArrow(solve, "point long, links long, to long")
    whole = pairs.where("whole")
    whole = whole.select("b", "q").unionByName(whole.select(F.col("q").alias("b"), F.col("b").alias("q")))
    heads = trees.select(F.col("block").alias("q"), "weight", F.col("centre_point").alias("to"))
    whole = whole.join(heads, "q")
    # every point of a block gets the weights of the blocks that it links with as a whole, and a link to one of their centres
    members = trees.select(F.col("block").alias("b"), "ids").mapInArrow(_members, "b long, point long")
    sums = whole.groupBy("b").agg(F.sum("weight").alias("links"), F.min("to").alias("to"))
    found = found.unionByName(members.join(sums, "b").select("point", "links", "to"))
    centres = whole.join(trees.select(F.col("block").alias("b"), "centre_point"), "b")
    return found.unionByName(centres.select(F.col("centre_point").alias("point"), F.lit(0).cast("long").alias("links"), "to"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b, ids in zip(batch.column("b").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            point = np.frombuffer(ids, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(point), b)), pa.array(point)], ["b", "point"])
