"""Exact n-gram Jaccard join of documents, with set-relation skipping.

A document's set holds the hashes (64 bits) of its distinct five-word shingles. Equal sets are one node; sets are told apart by
hashes of 128 bits. Two sets of sizes a and b link when 7 * overlap >= 3 * (a + b), which is a Jaccard similarity of 0.75 or more.

1. Order. All shingles are counted in a sketch of BUCKETS counters; each set is sorted by (counter, hash), rare first. Any
   fixed order is right; this one keeps common passages out of the prefixes.
2. Index. The first n - ceil(3 n / 4) + 1 shingles of a set go to the lists of the index with set size and position; two
   sets that link share a list. Entries without another of a size that can link in their list are dropped, but for lists that
   the sketch shows to be very long: these are taken as they are, so none is sorted in one task.
3. Answers by relation. In long lists some leaders are compared with all. What links with one becomes one component, and a pair
   inside a component needs no comparison. The overlaps o and p of two sets with one leader of size l bound their own: at least
   o + p - l, and at most min(o, p) + min(a - o, b - p); pairs that these bounds decide are not compared either. In
   the next round leaders come from the largest component of a list, and only sets outside it are compared.
4. Block skipping. What is left of long lists is cut into blocks by size; a pair of blocks is skipped if sizes or the
   positions of its entries (of a shared shingle at positions i and j, no more than the lesser can be shared before it, nor
   than the shorter rest from it) rule out enough overlap; entries of the others are tested alike, and by component.
5. Pairs are counted over their lists. All that two sets share up to where the first of their prefixes ends is in that
   count, so it bounds the overlap; pairs left are compared on their whole sets, links make components.

Scale: two passes over the texts (sizes and names, prefixes) without moving texts, and for each round of comparisons one that
reads the sets of the nodes in its pairs; the shuffles are the prefixes, a quarter of the shingles, once by set and once by
shingle, and those sets. Copies of a text cost one node in each task. Long lists are never gathered: their counts and leaders
are grouped aggregates, blocks hold about BLOCK nodes, and what is counted together about GROUP entries.

Cases: null and empty texts, or white space alone: no set, no link, own component; fewer than five words: the sequence
is the one shingle; rows that repeat a doc_id count as one document; a null doc_id takes the component of an equal or
linked set, or null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwork.llm.common import WORD, components, kept, materialize, slices

SHINGLE = 5
BUCKETS = 1 << 20
PART = 1 << 14
BLOCK = 128
#: Lists with more entries than this get leaders: in a first round one, then more, up to as many. Rounds end when what is
#: left to compare is about as long as the lists, or at the last; they save comparisons and decide nothing.
LONG, LEADERS, ROUNDS = 12, 16, 3
#: About the most lists of a node, and entries of blocks, that are counted together.
TOGETHER, GROUP = 4096, 1 << 16
#: Sets whose answers are used for another set's.
NEAREST = 4
#: Lists of shingles that have so many more than the mean count are not sorted.
HOT = 1 << 15
#: Most bits of a filter of document ids.
FILTER_BITS = 1 << 27
_M = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingles:
    """Sets of texts as sorted arrays of hashes; hashes of words are kept for the worker's life."""

    CACHE = 1 << 18

    def __init__(self):
        self.words: dict[bytes, int] = {}

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        import xxhash

        known, digest, seqs = self.words, xxhash.xxh3_64_intdigest, []
        if len(known) > self.CACHE:
            known.clear()
        for text in texts:
            words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: the six characters, A-Z
            try:
                seqs.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
            except KeyError:
                for w in words:
                    if w not in known:
                        known[w] = digest(w)
                seqs.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        out, flat = [], np.concatenate([*seqs, np.zeros(SHINGLE, np.uint64)])
        with np.errstate(over="ignore"):
            h = flat[: len(flat) - SHINGLE + 1].copy()
            for k in range(1, SHINGLE):
                h = mix(h * _M + flat[k : len(flat) - SHINGLE + 1 + k])
            at = 0
            for s in seqs:
                n = len(s)
                if n >= SHINGLE:
                    out.append(np.unique(h[at : at + n - SHINGLE + 1]))
                elif n:
                    v = np.array([n], np.uint64)
                    for x in s:
                        v = mix(v * _M + x)
                    out.append(v)
                else:
                    out.append(np.zeros(0, np.uint64))
                at += n
        return out


def name_of(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    import xxhash

    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    return kept(("shingles",), Shingles).sets(batch.column("text").to_pylist())


def row_key(docs: DataFrame) -> Column:
    """A digest of a row's doc_id and text."""
    return F.md5(F.concat_ws(":", F.coalesce(docs["doc_id"].cast("string"), F.lit("null")), F.coalesce(docs["text"].cast("string"), F.lit(""))))


def sizes(docs: DataFrame, keyed: bool = False) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, key, n_shingles, h1, h2) of every row (name null without a set, key null unless asked for), and the sketch of all shingles."""
    names = ["doc_id", "key", "n_shingles", "h1", "h2", "part", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, some = np.zeros(BUCKETS, np.uint32), False
        for batch in slices(batches, "text"):
            sets = _sets(batch)
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
            sketch += np.bincount((flat >> np.uint64(44)).astype(np.int64), minlength=BUCKETS).astype(np.uint32)
            some = True
            n, named = len(sets), [name_of(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x[k] for x in named], pa.int64()) for k in (0, 1)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names)
        if some:
            parts = range(0, BUCKETS, PART)
            z = [zlib.compress(sketch[a : a + PART].tobytes(), 1) for a in parts]
            none = [pa.nulls(len(z), t) for t in (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([*parts], pa.int64()), pa.array(z, pa.binary())], names)

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(PART, np.uint64)
        for z in t.column("counts"):
            total += np.frombuffer(zlib.decompress(z.as_py()), np.uint32)
        return pa.table({"part": t.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    key = row_key(docs) if keyed else F.lit(None).cast("string")
    used = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.col("text").cast("string").alias("text"))
    both = materialize(used.mapInArrow(run, "doc_id long, key string, n_shingles long, h1 long, h2 long, part long, counts binary"))
    sketch = np.zeros(BUCKETS, np.uint64)
    for r in both.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(add, "part long, counts binary").collect():  # BUCKETS counters
        sketch[r["part"] : r["part"] + PART] = np.frombuffer(r["counts"], np.uint64)
    return both.where("part is null").select("doc_id", "key", "n_shingles", "h1", "h2"), np.minimum(sketch, 0xFFFFFFFF).astype(np.uint32)


def prefix(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The rare end of a set that any set linked with it meets."""
    count = sketch[(s >> np.uint64(44)).astype(np.int64)]
    length = len(s) - -(-3 * len(s) // 4) + 1
    return s[np.lexsort((s, count))[:length]]


def nodes_of(docs: DataFrame, base: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(node, h1, h2, n, id, unnamed, tokens, hot): each set once, with its least doc_id, whether a row of it has none, its prefix, and the
    positions in it of shingles whose counters stand out."""
    mean = float(sketch.mean())
    hot_from = mean + 16 * mean**0.5 + HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches, "text"):
            rows = []
            for s in _sets(batch):
                if len(s) and (name := name_of(s)) not in seen:
                    seen.add(name)
                    p = prefix(s, sketch)
                    rows.append((*name, p.view(np.int64), np.flatnonzero(sketch[(p >> np.uint64(44)).astype(np.int64)] > hot_from).astype(np.int32)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["h1", "h2", "tokens", "hot"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "h1 long, h2 long, tokens array<long>, hot array<int>")
    found = found.groupBy("h1", "h2").agg(F.any_value("tokens").alias("tokens"), F.any_value("hot").alias("hot"))
    named = base.where("h1 is not null").groupBy("h1", "h2").agg(F.max("n_shingles").alias("n"), F.min("doc_id").alias("id"), F.max(F.col("doc_id").isNull()).alias("unnamed"))
    return materialize(named.join(found, ["h1", "h2"]).withColumns({"node": F.monotonically_increasing_id(), "n": F.col("n").cast("int")}), "lz4")


def lists(nodes: DataFrame) -> DataFrame:
    """Index lists with more than one node: token, node, n, pos."""
    def entries(some: DataFrame) -> DataFrame:
        return some.select("node", "n", "hot", F.posexplode("tokens").alias("pos", "token"))

    by_size = Window.partitionBy("token").orderBy("n", "node")
    cold = entries(nodes).where(~F.array_contains("hot", F.col("pos"))).select("token", "node", "n", "pos")
    cold = cold.withColumns({"less": F.lag("n").over(by_size), "more": F.lead("n").over(by_size)})
    cold = cold.where("4L * less >= 3L * n or 4L * n >= 3L * more").select("token", "node", "n", "pos")
    hot = entries(nodes.where(F.size("hot") > 0)).where(F.array_contains("hot", F.col("pos"))).select("token", "node", "n", "pos")
    return materialize(cold.unionByName(hot))


def bitmap(ids: DataFrame) -> np.ndarray:
    """A filter of the ids in a column named id, as bits of pmod(hash, bits); at most FILTER_BITS."""
    n = ids.count()
    bits = 1 << 15
    while bits < min(16 * n, FILTER_BITS):
        bits *= 2
    spot = F.pmod("id", F.lit(bits))
    maps = ids.select(F.floor(spot / 32768).alias("part"), (spot % 32768).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    field = np.zeros(bits // 8, np.uint8)
    for r in maps.collect():
        got = np.frombuffer(r["bits"], np.uint8)
        field[r["part"] * 4096 : r["part"] * 4096 + len(got)] = got
    return field


def wanted_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, s): the sets of wanted nodes (column node), s as bytes of sorted hashes; read from one document of each node.

    A filter of these documents' ids goes to the tasks, so a task takes apart few other texts.
    """
    first = materialize(nodes.select("node", "h1", "h2", "id", "unnamed").join(wanted, "node", "left_semi"))
    field, unnamed = bitmap(first.where("id is not null").select("id")), bool(first.agg(F.max("unnamed")).first()[0])
    bits = 8 * len(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids = batch.column("doc_id")
            spot = np.mod(ids.fill_null(0).to_numpy(zero_copy_only=False), bits)
            hit = np.where(ids.is_null().to_numpy(zero_copy_only=False), unnamed, field[spot >> 3] >> (spot & 7).astype(np.uint8) & 1 > 0)
            for part in slices(iter([batch.filter(pa.array(hit))]), "text"):
                rows = []
                for s in _sets(part):
                    if len(s) and (name := name_of(s)) not in seen:
                        seen.add(name)
                        rows.append((*name, s.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["h1", "h2", "s"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "h1 long, h2 long, s binary")
    found = found.join(first.select("node", "h1", "h2"), ["h1", "h2"])
    return materialize(found.groupBy("node").agg(F.any_value("s").alias("s")), "lz4")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n, m, o) of pairs (a, b): sizes and overlap of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, out = batch.column("s"), batch.column("t"), []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                n, m = len(x), len(y)
                if n > m:
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                out.append((n, m, int((y[at] == x).sum())))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array([r[k] for r in out], pa.int64()) for k in range(3))], ["a", "b", "n", "m", "o"])

    full = pairs.join(sets.withColumnRenamed("node", "a"), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("t")), "b")
    return materialize(full.select("a", "b", "s", "t").mapInArrow(run, "a long, b long, n long, m long, o long"))


def best_answers(answers: DataFrame) -> DataFrame:
    """(node, known): of answers (node, lead, n, l, o) the NEAREST with the most similar sets for each node, and for each of these sets itself."""
    own = answers.select(F.col("lead").alias("node"), "lead", F.col("l").alias("n"), "l", F.col("l").alias("o")).distinct()
    every = answers.select("node", "lead", "n", "l", "o").unionByName(own)
    one = F.struct((F.col("o") / (F.col("n") + F.col("l"))).alias("near"), "lead", "l", "o")
    return every.groupBy("node").agg(F.slice(F.sort_array(F.collect_set(one), asc=False), 1, NEAREST).alias("known"))  # a node was compared with its lists' leaders at most


def derived(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """pairs (a, b, n, m) with the bounds least and most of their overlap from the sets that both are known to overlap with; null without one."""
    known = best_answers(answers)
    met = pairs.join(known.select(F.col("node").alias("a"), F.col("known").alias("x")), "a", "left").join(known.select(F.col("node").alias("b"), F.col("known").alias("y")), "b", "left")

    def bound(u: Column, v: Column) -> Column:
        most = F.least(u["o"], v["o"]) + F.least(F.col("n") - u["o"], F.col("m") - v["o"])
        return F.struct((u["o"] + v["o"] - u["l"]).alias("least"), most.alias("most"))

    bounds = F.flatten(F.transform("x", lambda u: F.transform(F.filter("y", lambda v: v["lead"] == u["lead"]), lambda v: bound(u, v))))
    met = met.withColumn("bounds", F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), bounds))
    return met.select("a", "b", "n", "m", F.array_max(F.col("bounds")["least"]).alias("least"), F.array_min(F.col("bounds")["most"]).alias("most"))


def able(n: Column, m: Column, i: Column, j: Column) -> Column:
    """Can sets of sizes n and m with a shared shingle at positions i and j link?"""
    return 7 * (F.least(i, j) + F.least(n - i, m - j)) >= 3 * (n + m)


def counted(pairs: DataFrame) -> DataFrame:
    """Of (a, b, n, m, c, first): the pairs (a, b, n, m) whose shared prefix shingles c, with what may follow them, are enough to link.

    first: may one of these shingles be the first that they share?
    """
    after = lambda n: F.floor((3 * n + 3) / 4) - 1  # noqa: E731  what a set has behind its prefix
    sums = pairs.groupBy("a", "b", "n", "m").agg(F.sum("c").alias("c"), F.max("first").alias("first"))
    return sums.where(F.col("first") & (7 * (F.col("c") + F.greatest(after(F.col("n")), after(F.col("m")))) >= 3 * (F.col("n") + F.col("m")))).select("a", "b", "n", "m")


def short_pairs(rows: DataFrame) -> DataFrame:
    """Pairs for counted() of short lists in rows (token, node, n, pos, comp)."""
    x, y = rows.alias("x"), rows.alias("y")
    c = lambda name: F.col(name).cast("long")
    ok = (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp"))
    ok = ok & able(c("x.n"), c("y.n"), c("x.pos"), c("y.pos"))
    first = 7 * F.least(c("x.n") - c("x.pos"), c("y.n") - c("y.pos")) >= 3 * (c("x.n") + c("y.n"))
    return x.join(y, ok).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), c("x.n").alias("n"), c("y.n").alias("m"), F.lit(1).cast("long").alias("c"), first.alias("first"))


def block_pairs(rows: DataFrame) -> DataFrame:
    """Pairs for counted() of lists of any length in rows (token, node, n, pos, comp, k, size), by block skipping.

    k: a node's lists; size: of its component. Lists with the same largest component are cut into blocks by the same hash of
    nodes and counted together; a pair is left out if even all lists that one of them has elsewhere don't make its count enough.
    """
    binned = rows.withColumn("bin", F.floor(F.log("n") / F.log(F.lit(4 / 3))).cast("int"))
    top = binned.groupBy("token").agg(F.min(F.struct(-F.col("size"), "comp"))["comp"].alias("lead"))
    top = materialize(top)
    nodes = binned.join(top, "token").groupBy("lead", "node", "n").agg(F.count("*").alias("k")).groupBy("lead").agg(F.count("*").alias("nodes"), F.max("n").alias("most"), F.sum("k").alias("entries"))
    level = F.pow(2, F.ceil(F.log2(F.greatest(F.col("nodes") / BLOCK, F.lit(1))))).cast("int")
    lists = materialize(top.join(nodes.select("lead", level.alias("level"), F.greatest(F.ceil(F.col("most") / (4 * TOGETHER)), F.ceil(2 * F.col("entries") / (level * GROUP))).alias("chunks")), "lead"))
    cut = binned.join(lists, "token")
    cut = cut.withColumns({"sub": F.pmod(F.hash("node"), F.col("level")), "chunk": F.pmod("token", F.col("chunks"))})
    blocks = cut.groupBy("token", "lead", "chunk", "level", "bin", "sub").agg(F.min("n").alias("small"), F.max("pos").alias("far"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.collect_list(F.struct("node", "n", "pos", "comp", "k")).alias("rows"))
    blocks = materialize(blocks)
    left, right = blocks.withColumn("to", F.explode(F.array("bin", F.col("bin") + 1))).alias("l"), blocks.alias("r")
    near = (F.col("l.token") == F.col("r.token")) & (F.col("r.bin") == F.col("l.to")) & ((F.col("r.bin") > F.col("l.bin")) | (F.col("r.sub") >= F.col("l.sub")))
    enough = 7 * (F.least("l.far", "r.far").cast("long") + F.least("l.rest", "r.rest")) >= 3 * (F.col("l.small").cast("long") + F.col("r.small"))
    key = ["lead", "chunk", "level", "bin", "sub", "bin2", "sub2"]
    met = left.join(right, near & enough).select("l.lead", "l.chunk", "l.level", "l.bin", "l.sub", F.col("r.bin").alias("bin2"), F.col("r.sub").alias("sub2"), F.col("l.rows").alias("x"), F.col("r.rows").alias("y"))

    def count(t: pa.Table) -> pa.Table:
        sides = []
        for side in ("x", "y"):
            column = t.column(side).combine_chunks()
            ends, flat = column.offsets.to_numpy(), column.values
            f = {c: flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64)[ends[0] : ends[-1]] for c in ("node", "n", "pos", "comp", "k")}
            names, at, place = np.unique(f["node"], return_index=True, return_inverse=True)
            sides.append((names, place, ends - ends[0], f["pos"], *(f[c][at] for c in ("n", "comp", "k"))))
        (xs, xi, xe, xp, xn, xc, xk), (ys, yi, ye, yp, yn, yc, yk) = sides
        both = 3 * (xn[:, None] + yn)
        c, first = np.zeros(both.shape, np.int64), np.zeros(both.shape, bool)
        for r in range(len(t)):
            u, v, i, j = xi[xe[r] : xe[r + 1]], yi[ye[r] : ye[r + 1]], xp[xe[r] : xe[r + 1], None], yp[ye[r] : ye[r + 1]]
            at = np.ix_(u, v)
            rest = np.minimum(xn[u][:, None] - i, yn[v] - j)
            c[at] += 7 * (np.minimum(i, j) + rest) >= both[at]
            first[at] |= 7 * rest >= both[at]
        elsewhere = np.minimum((xk - np.bincount(xi, minlength=len(xs)))[:, None], yk - np.bincount(yi, minlength=len(ys)))
        after = np.maximum(((3 * xn + 3) // 4 - 1)[:, None], (3 * yn + 3) // 4 - 1)
        ok = (c > 0) & (xc[:, None] != yc) & (7 * (c + elsewhere + after) >= both)
        same = t.column("bin")[0] == t.column("bin2")[0] and t.column("sub")[0] == t.column("sub2")[0]
        u, v = np.nonzero(np.triu(ok, 1) if same else ok)  # both sides are then the same nodes in the same order
        a, b, n, m = xs[u], ys[v], xn[u], yn[v]
        turn = a > b
        cols = (np.where(turn, b, a), np.where(turn, a, b), np.where(turn, m, n), np.where(turn, n, m), c[u, v], first[u, v])
        return pa.table(dict(zip(("a", "b", "n", "m", "c", "first"), map(pa.array, cols), strict=True)))

    return met.groupBy(*key).applyInArrow(count, "a long, b long, n long, m long, c long, first boolean")


def lead_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs for counted() of each list's leaders with the rest of it, rows (token, node, n, pos, comp, size).

    Half of the leaders come from the list's largest component; the counts are of the lists that a leader leads.
    """
    rank = lambda k: F.struct((F.lit(0) if k % 2 else -F.col("size")).alias("size"), F.xxhash64("node", F.lit(turn * LEADERS + k)).alias("h"), "node", "n", "pos", "comp")
    leaders = F.array_distinct(F.transform(F.array(*(F.min(rank(k)) for k in range(min(LEADERS, 4**turn)))), lambda s: F.struct(s["node"].alias("node"), s["n"].alias("n"), s["pos"].alias("pos"), s["comp"].alias("comp"))))
    state = rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), leaders.alias("leaders")).where("low < high")
    rows = rows.join(state.select("token", F.explode("leaders").alias("lead")), "token").where("comp <> lead.comp")
    n, m, i, j = (F.col(x).cast("long") for x in ("n", "lead.n", "pos", "lead.pos"))
    rows = rows.where(able(n, m, i, j))
    return rows.select(F.col("node").alias("a"), F.col("lead.node").alias("b"), n.alias("n"), m.alias("m"), F.lit(1).cast("long").alias("c"), F.lit(True).alias("first"))


def left_over(rows: DataFrame) -> tuple[int, int]:
    """Of lists in rows (token, comp): pairs of entries of different components, and entries."""
    groups = rows.groupBy("token", "comp").agg(F.count("*").alias("k"))
    lists = groups.groupBy("token").agg(F.sum("k").alias("c"), F.sum(F.col("k") * F.col("k")).alias("same"))
    got = lists.agg(F.sum(F.col("c") * F.col("c") - F.col("same")), F.sum("c")).first()
    return (got[0] or 0) // 2, got[1] or 0


def with_components(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(comp, rows["node"] == comp["id"], "left").select("token", "node", "n", "pos", F.coalesce("component", "node").alias("comp"))


def labelled(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """(doc_id, key, n_shingles, comp, component_id) of every row; comp numbers the components and is null without a set."""
    base, sketch = sizes(docs, keyed)
    nodes = nodes_of(docs, base, sketch)
    found = lists(nodes)
    links = comp = answers = None

    def compare(pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame | None:
        nonlocal answers
        pairs = counted(pairs)
        pairs = materialize(pairs if answers is None else derived(pairs, answers))
        if pairs.isEmpty():
            return links
        both = 3 * (F.col("n") + F.col("m"))
        new, left = None, pairs
        if answers is not None:
            new = pairs.where(7 * F.col("least") >= both).select("a", "b")
            left = pairs.where(F.col("least").isNull() | ((7 * F.col("least") < both) & (7 * F.col("most") >= both)))
        left = left.select("a", "b")
        last = sets is None
        if last:
            sets = wanted_sets(docs, nodes, left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct())
        got = overlaps(left, sets)
        if not last:
            more = got.select(F.col("a").alias("node"), F.col("b").alias("lead"), "n", F.col("m").alias("l"), "o")
            answers = more if answers is None else answers.unionByName(more)
        got = got.where(7 * F.col("o") >= both).select("a", "b")
        for other in (new, links):
            got = got if other is None else got.unionByName(other)
        return got

    if not found.isEmpty():
        long = found.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > LONG)
        long = materialize(found.join(long.select("token"), "token"))
        # equal sizes need a tenth of the set in shared lists: others gain nothing from leaders
        dense = long.groupBy("node", "n").agg(F.count("*").alias("k")).where("10 * k >= n").select("node")
        long = materialize(long.join(dense, "node", "left_semi").select("token", "node", "n", "pos"))
        sets = None
        for turn in range(ROUNDS):
            rows = materialize(with_components(long, comp))
            pairs, entries = left_over(rows)
            if pairs <= 2 * entries:
                break
            if sets is None:
                sets = wanted_sets(docs, nodes, long.select("node").distinct())
            size = rows.select("node", "comp").distinct().groupBy("comp").agg(F.count("*").alias("size"))
            new = compare(lead_pairs(rows.join(size, "comp"), turn), sets)
            if new is not links:
                links, comp = new, materialize(components(new))
        rows = with_components(found, comp)
        alive = rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("c")).where("low < high")
        rows = materialize(rows.join(alive.select("token", "c"), "token"))
        of_node = rows.groupBy("node", "comp").agg(F.count("*").alias("k"))
        of_node = of_node.join(of_node.groupBy("comp").agg(F.count("*").alias("size")), "comp").select("node", "k", "size")
        pairs = short_pairs(rows.where(F.col("c") <= LONG)).unionByName(block_pairs(rows.where(F.col("c") > LONG).drop("c").join(of_node, "node")))
        links = compare(pairs)
    label = nodes.select("node", "h1", "h2", "id")
    if links is not None:
        merged = components(links).withColumnRenamed("id", "member")
        label = label.join(merged, label["node"] == merged["member"], "left").select("h1", "h2", "id", F.coalesce("component", "node").alias("comp"))
        label = materialize(label)
        label = label.join(label.groupBy("comp").agg(F.min("id").alias("component_id")), "comp").select("h1", "h2", "comp", "component_id")
    else:
        label = label.select("h1", "h2", F.col("node").alias("comp"), F.col("id").alias("component_id"))
    return base.join(label, ["h1", "h2"], "left").select("doc_id", "key", "n_shingles", "comp", F.coalesce("component_id", "doc_id").alias("component_id"))


def join_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    return labelled(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, that with the least doc_id (null last) and then the least digest of its text.

    Rows without a set are in no component and stay. Rows that repeat both doc_id and text are one document: one of them stays,
    but for rows without doc_id and set, which can't be told to be the same.
    """
    rows = materialize(labelled(docs, keyed=True))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"]
    keep = rows.where("comp is not null").groupBy("comp").agg(least.alias("key")).select("key")
    keep = keep.unionByName(rows.where("comp is null and doc_id is not null").select("key").distinct())
    mark = f"key_{uuid.uuid4().hex}"
    keyed = docs.withColumn(mark, row_key(docs))
    stay = keyed.join(keep.withColumnRenamed("key", mark), mark, "left_semi").dropDuplicates([mark])
    loose = docs["doc_id"].isNull() & ~F.coalesce(docs["text"].cast("string").rlike(WORD), F.lit(False))
    return stay.select(*docs.columns).unionByName(docs.where(loose))
