"""SentencePiece encoding and decoding of texts of any length by a max-plus scan over chunks.

The pieces of a model over a text form a lattice of arcs between character positions. Encoding is the best path, where
joining two arcs weighs 0 or -infinity for a BPE model (may these pieces stand side by side in the model's own encoding
of their joint text?) and arcs weigh their score for a unigram model. From a given entry every position has one best
last piece, so a path is found left to right.

A long text is cut into chunks of about CHUNK characters, at the head of a word (a run of spaces and what follows it) if one is
within half a chunk, else where the chunk ends. The state at a cut is the arc that crosses or ends at it; no arc crosses the
head of a word, so there is one state there. For each chunk, a task computes the transfer matrix from its entry states to its exit states; matrices of a text are combined by
max-plus products, pairwise, in a tree; the chosen states then fix entry and exit of each chunk, and each chunk is traced back
alone. Paths from all entries meet at heads of words, and the words inside a chunk are encoded once in a worker's life.
One case is left to one task, which encodes the whole text: several spaces side by side before a word that is longer than half
a chunk, as pieces of spaces tie in score and the scan can't tell how the run ends inside such a word.

Scale: a text of one chunk needs no shuffle. Chunks of longer ones go to the shared folder once; what is grouped by
text is its matrices and its ids, never more than that text itself.

Cases: null and empty texts have no ids; a null doc_id is a document of its own row; rows that repeat are told apart by
a row number; characters without a piece become their UTF-8 byte pieces; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import kept, materialize, slices

SPACE = "▁"
CHUNK = 1 << 15
MINUS = -1e300
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_HEAD = re.compile(f"(?<=[^{SPACE}]){SPACE}")


class Pieces:
    """The lattice of one model: which substrings are arcs, and how two of them join."""

    #: Words of each of two generations, the longest of them, and joins, that a worker keeps: some 200 MB at most.
    CACHE, LONGEST, PAIRS = 1 << 19, 64, 1 << 19

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only models with the identity normalizer are supported")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.bpe = model.trainer_spec.model_type == 2
        self.arcs = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (1, 4)}
        self.score = [p.score for p in model.pieces]
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.unk = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.surfaces: list[bytes] | None = None
        self.text = [p.piece for p in model.pieces]
        self.longest = max(map(len, self.arcs))
        self.trie = {x[:n]: -1 for x in self.arcs for n in range(1, len(x))} | self.arcs  # -1: only the head of a piece
        self.after: dict[str, dict[int, bool]] = {}  # by piece, the pieces that may follow it or not
        self.missing = min((self.score[i] for i in self.arcs.values()), default=0.0) - 10
        spec.add_dummy_prefix = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pairs = 0

    def arc(self, s: str) -> bool:
        return len(s) == 1 or s in self.arcs

    def join(self, before: str, s: str) -> float:
        """Weight of arc s after the arc `before` ('' at the start of a word)."""
        if not self.bpe:
            return self.score[self.arcs[s]] if s in self.arcs else self.missing
        if (i := self.arcs.get(s)) is None or (before and before not in self.arcs):
            return 0.0
        got = self.known(before).get(i)
        return 0.0 if (self.settle(before, s, i) if got is None else got) else MINUS

    def known(self, before: str) -> dict[int, bool]:
        got = self.after.get(before)
        if got is None:
            if self.pairs > self.PAIRS:
                self.after.clear()
                self.parts.clear()
                self.pairs = 0
            got = self.after[before] = {}
        return got

    def settle(self, before: str, s: str, i: int) -> bool:
        """Finds out whether piece s, number i, may follow a piece."""
        ok = (before not in self.arcs or self.beside(before, s)) if before else self.halves(s) is not None
        self.known(before)[i] = ok
        self.pairs += 1
        return ok

    def halves(self, s: str) -> tuple[str, str] | None:
        """The two arcs that the last merge of a piece joins ('' for both if it has one character); None if merges of its
        characters don't end in it: the best-ranked neighbours first, the leftmost of equals."""
        if s not in self.parts:
            row, last = [*s], ("", "")
            while len(row) > 1:
                ranked = [(-self.score[self.arcs[row[i] + row[i + 1]]], i) for i in range(len(row) - 1) if row[i] + row[i + 1] in self.arcs]
                if not ranked:
                    break
                i = min(ranked)[1]
                last = row[i], row[i + 1]
                row[i : i + 2] = ["".join(last)]
            self.parts[s] = last if len(row) == 1 else None
        return self.parts[s]

    def beside(self, a: str, b: str) -> bool:
        """Would merges of the characters of a + b end in a and b?

        Undo the later of the two merges at the border again and again; if what then meets there merges earlier than what
        was undone, it would have.
        """
        ha, hb = self.halves(a), self.halves(b)
        if ha is None or hb is None:
            return False
        arcs, score, far = self.arcs, self.score, float("inf")
        rank = lambda x: -score[arcs[x]] if len(x) > 1 else -far
        limit = (far, 0)  # rank of the undone merge, and 1 if a joint merge of the same rank comes first, being leftmost
        while True:
            if (i := arcs.get(a + b)) is not None and (-score[i], 0) < limit:
                return False
            ra, rb = rank(a), rank(b)
            if ra == rb == -far:
                return True
            if ra > rb:
                limit, a = (ra, 0), self.halves(a)[1]
            else:
                limit, b = (rb, 1), self.halves(b)[0]

    def forward(self, s: str, begin: int, before: str, upto: int) -> tuple[list[float], list[int]]:
        """Best score and start of the last arc for each position of s from `begin` (reached by the arc `before`) to `upto`."""
        n = upto - begin + 1
        best, start = [MINUS] * n, [-1] * n
        best[0] = 0.0
        for e in range(begin + 1, upto + 1):
            for b in range(max(begin, e - self.longest), e):
                if best[b - begin] > MINUS and ((x := s[b:e]) in self.arcs or e - b == 1):
                    last = before if b == begin else s[begin + (start[b - begin]) : b] if start[b - begin] >= 0 else ""
                    v = best[b - begin] + self.join(last, x)
                    if v > best[e - begin]:
                        best[e - begin], start[e - begin] = v, b - begin
                        if self.bpe:
                            break  # a position has one last piece
        return best, start

    def trace(self, s: str, begin: int, start: list[int], end: int) -> list[str]:
        out = []
        while end > begin:
            b = begin + start[end - begin]
            out.append(s[b:end])
            end = b
        return out[::-1]

    def ids(self, arcs: list[str]) -> bytes:
        out: list[int] = []
        for x in arcs:
            i = self.arcs.get(x)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in x.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unk)
        return array("I", out).tobytes()

    def word(self, w: str) -> bytes:
        """ids of a run of spaces with what follows it, or of what no space precedes."""
        if len(w) > self.LONGEST:
            return self.fresh(w)
        got = self.words.get(w)
        if got is None:
            got = self.old.get(w)
            if len(self.words) > self.CACHE:
                self.words, self.old = {}, self.words
            got = self.words[w] = self.fresh(w) if got is None else got
        return got

    def fresh(self, w: str) -> bytes:
        if not self.bpe:
            best, start = self.forward(w, 0, "", len(w))
            return self.ids(self.trace(w, 0, start, len(w)))
        if w.startswith(SPACE + SPACE):  # pieces of spaces tie in score, so joins of two don't settle a run
            return np.array(self.plain.encode(w.replace(SPACE, " "), num_threads=1), "<u4").tobytes()
        n, trie, longest = len(w), self.trie, self.longest
        last: list[str | None] = [None] * (n + 1)
        start = [0] * (n + 1)
        last[0] = ""
        for b in range(n):
            if (before := last[b]) is None:
                continue
            known = self.known(before) if before in trie or not before else None
            for e in range(b + 1, min(n, b + longest) + 1):
                x = w[b:e]
                i = trie.get(x)
                if i is None or (i < 0 and e == b + 1):
                    if e == b + 1 and last[e] is None:  # a character without a piece
                        last[e], start[e] = x, b
                    if i is None:
                        break
                elif i >= 0 and last[e] is None:
                    ok = True if known is None else known.get(i)
                    if ok is None:
                        ok = self.settle(before, x, i)
                    if ok:
                        last[e], start[e] = x, b
        if last[n] is None:
            return np.array(self.plain.encode(w.replace(SPACE, " "), num_threads=1), "<u4").tobytes()
        out, e = [], n
        while e:
            out.append(last[e])
            e = start[e]
        return self.ids(out[::-1])

    def surface(self, text: str) -> str:
        """The normalized text, whose positions are the lattice's."""
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def whole(self, text: str) -> bytes:
        """ids of a text of one chunk: its entry and exit are its ends."""
        words, found = self.words, _WORD.findall(self.surface(text))
        try:
            return b"".join(map(words.__getitem__, found))
        except KeyError:
            return b"".join(map(self.word, found))

    def cuts(self, s: str, chunk: int) -> list[int]:
        """Where to cut the surface s: its ends, and about every `chunk` characters the nearest head of a word."""
        out, half = [0], chunk // 2
        for q in range(chunk, len(s), chunk):
            m = _HEAD.search(s, q, q + half)
            at = m.start() if m else max((m.start() for m in _HEAD.finditer(s, q - half, q)), default=q)
            if at > out[-1]:
                out.append(at)
        return [*out, len(s)]

    # ---- chunks: s is left context, the chunk [p, q) and right context ----

    def crossing(self, s: str, q: int) -> list[tuple[int, int]]:
        """States at a cut q: arcs (b, e) with b < q <= e."""
        return [(b, e) for b in range(max(0, q - self.longest), q) for e in range(q, min(len(s), b + self.longest) + 1) if self.arc(s[b:e])]

    def exits(self, s: str, begin: int, before: str, q: int) -> tuple[list[float], list[int], dict[tuple[int, int], float]]:
        """From a position and the arc before it: the forward pass to q, and the value of each state at q."""
        best, start = self.forward(s, begin, before, q)
        out: dict[tuple[int, int], float] = {}
        for b, e in self.crossing(s, q):
            if b >= begin and best[b - begin] > MINUS:
                last = before if b == begin else s[begin + start[b - begin] : b]
                v = best[b - begin] + self.join(last, s[b:e])
                if v > MINUS:
                    out[b - q, e - q] = v
        return best, start, out

    def head(self, s: str, p: int) -> bool:
        """Does a word begin at a cut?"""
        return p == len(s) or (p > 0 and s[p] == SPACE and s[p - 1] != SPACE)

    def value(self, s: str) -> float:
        """Of whole words."""
        return 0.0 if self.bpe else sum(self.forward(w, 0, "", len(w))[0][-1] for w in _WORD.findall(s))

    def transfer(self, s: str, p: int, q: int, first: bool) -> dict[tuple[int, int], dict[tuple[int, int], float]]:
        """The matrix of a chunk, by entry and exit state relative to its cuts; (0, 0) is the state at the head of a word.

        Infeasible entries are left out; empty if a run of spaces keeps the chunk from being settled.
        """
        clean, ends = first or self.head(s, p), self.head(s, q)
        meet = p if clean else m.start() if (m := _HEAD.search(s, p + self.longest, q + 1)) else -1
        if meet >= 0 and not ends:
            last = max((m.start() for m in _HEAD.finditer(s, meet, q - self.longest)), default=meet)
        if self.bpe:
            open_parts = ([] if clean else [s[max(0, p - self.longest) : meet if meet >= 0 else q]]) + ([] if ends else [s[last if meet >= 0 else p : q + self.longest]])
            if any(SPACE + SPACE in x for x in open_parts):
                return {}
        rest = None
        if meet >= 0 and ends:
            rest = {(0, 0): self.value(s[meet:q])}
        elif meet >= 0:
            middle = self.value(s[meet:last])
            rest = {k: v + middle for k, v in self.exits(s, last, "", q)[2].items()}
        out = {}
        for b, e in [(0, 0)] if clean else [(b - p, e - p) for b, e in self.crossing(s, p)]:
            begin, before = p + e, s[p + b : p + e]
            if meet < 0:
                got = {(b, e): 0.0} if begin > q else self.exits(s, begin, before, q)[2]
                if ends and got:
                    got = {(0, 0): max(got.values())}
            else:
                v = self.forward(s, begin, before, meet)[0][-1]
                got = {k: v + x for k, x in rest.items()} if v > MINUS else {}
            if got:
                out[b, e] = got
        return out

    def between(self, s: str, p: int, q: int, first: bool, entry: tuple[int, int], leave: tuple[int, int]) -> bytes:
        """ids of the arcs that begin in the chunk, given both states."""
        begin, before, end = p + entry[1], s[p + entry[0] : p + entry[1]], q + leave[0]
        heads = [m.start() for m in _HEAD.finditer(s, begin, end)]
        if first:
            heads = [begin, *heads]
        if not heads:
            return self.path(s, begin, before, end) + self.arc_ids(s, q, leave)
        got, last = self.path(s, begin, before, heads[0]), end if leave == (0, 0) else heads[-1]
        got += b"".join(map(self.word, _WORD.findall(s[heads[0] : last])))
        return got + (b"" if last == end else self.path(s, last, "", end)) + self.arc_ids(s, q, leave)

    def path(self, s: str, begin: int, before: str, end: int) -> bytes:
        return self.ids(self.trace(s, begin, self.forward(s, begin, before, end)[1], end))

    def arc_ids(self, s: str, q: int, state: tuple[int, int]) -> bytes:
        return b"" if state == (0, 0) else self.ids([s[q + state[0] : q + state[1]]])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, byte pieces as UTF-8, spaces for the space sign, less the added one."""
        if self.surfaces is None:
            back = {i: b for b, i in self.bytes.items()}
            self.surfaces = [bytes([back[i]]) if i in back else x.replace(SPACE, " ").encode() for i, x in enumerate(self.text)]
        data = b"".join(map(self.surfaces.__getitem__, ids.tolist()))
        text = data.decode("utf-8", "surrogatepass")
        return text[1:] if self.prefix and text else text


Matrix = dict[tuple[int, int], dict[tuple[int, int], float]]


def product(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product."""
    out: Matrix = {}
    for i, row in a.items():
        new: dict[tuple[int, int], float] = {}
        for k, v in row.items():
            for j, w in b.get(k, {}).items():
                if v + w > new.get(j, MINUS):
                    new[j] = v + w
        if new:
            out[i] = new
    return out


def states(mats: list[Matrix]) -> list[tuple[int, int]] | None:
    """The state at each cut of the best path from (0, 0) to (0, 0), the heads before and after the text, by a tree of products.

    Down the tree a node knows its outer states and picks the state between its halves. None if there is no path.
    """
    level, tree = mats, [mats]
    while len(level) > 1:
        level = [product(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        tree.append(level)
    if (0, 0) not in tree[-1][0].get((0, 0), {}):
        return None
    bounds = [(0, 0), (0, 0)]
    for level in reversed(tree[:-1]):
        new = [bounds[0]]
        for i in range(0, len(level), 2):
            left, right = bounds[i // 2], bounds[i // 2 + 1]
            if i + 1 < len(level):
                mid = {k: v + level[i + 1][k][right] for k, v in level[i][left].items() if right in level[i + 1].get(k, {})}
                new.append(max(mid, key=lambda k: (mid[k], k)))
            new.append(right)
        bounds = new
    return bounds


def _flat(m: Matrix) -> bytes:
    return np.array([(*i, *j, v) for i, row in m.items() for j, v in row.items()], "f8").tobytes()


def _matrix(data: bytes) -> Matrix:
    out: Matrix = {}
    for a, b, c, d, v in np.frombuffer(data, "f8").reshape(-1, 5).tolist():
        out.setdefault((int(a), int(b)), {})[int(c), int(d)] = v
    return out


def encode(docs: DataFrame, model_path: str, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids, decoded_sha256) of every row: ids as binary of little-endian 32-bit ids, and the hash of what they decode to."""
    used = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    doc = f"doc_id {used.schema['doc_id'].dataType.simpleString()}"
    long = F.length("text") >= chunk  # the added space may make one character more

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept(("pieces", model_path), lambda: Pieces(model_path))
        for batch in slices(batches, "text"):
            ids = [model.whole(x) if x else b"" for x in batch.column("text").to_pylist()]
            sha = [hashlib.sha256(model.decode(np.frombuffer(x, "<u4")).encode("utf-8", "surrogatepass")).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(sha)], ["doc_id", "ids", "decoded_sha256"])

    out = f"{doc}, ids binary, decoded_sha256 string"
    done = used.where(F.coalesce(~long, F.lit(True))).mapInArrow(short, out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept(("pieces", model_path), lambda: Pieces(model_path))
        side = 2 * model.longest
        for batch in slices(batches, "text"):
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                s = model.surface(text)
                cuts = model.cuts(s, chunk)
                yield pa.RecordBatch.from_pylist([{"row": row, "k": k, "n": len(cuts) - 1, "p": min(p, side), "q": min(p, side) + q - p, "s": s[max(0, p - side) : q + side]} for k, (p, q) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))])

    giants = materialize(used.where(long).withColumn("row", F.monotonically_increasing_id()))
    parts = "row long, k long, n long, p long, q long, s string"
    chunks = materialize(giants.select("row", "text").mapInArrow(cut, parts).repartition("row", "k"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept(("pieces", model_path), lambda: Pieces(model_path))
        for batch in slices(batches, "s"):
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pylist([{"row": r["row"], "k": r["k"], "m": _flat(model.transfer(r["s"], r["p"], r["q"], r["k"] == 0))} for r in rows])

    def choose(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["k"])
        at = states([_matrix(r["m"]) for r in rows])
        if at is None:  # spaces side by side before a word longer than half a chunk: chunk 0 stands for the text, which is then encoded whole
            return pa.table({"row": [rows[0]["row"]], "k": pa.array([0], pa.int64()), **{c: pa.array([None], pa.int64()) for c in "abcd"}})
        return pa.Table.from_pylist([{"row": r["row"], "k": r["k"], "a": a[0], "b": a[1], "c": b[0], "d": b[1]} for r, a, b in zip(rows, at[:-1], at[1:], strict=True)])

    chosen = chunks.mapInArrow(matrices, "row long, k long, m binary").groupBy("row").applyInArrow(choose, "row long, k long, a long, b long, c long, d long")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept(("pieces", model_path), lambda: Pieces(model_path))
        for batch in slices(batches, "s"):
            yield pa.RecordBatch.from_pylist([{"row": r["row"], "k": r["k"], "ids": model.between(r["s"], r["p"], r["q"], r["k"] == 0, (r["a"], r["b"]), (r["c"], r["d"]))} for r in batch.to_pylist()])

    chosen = materialize(chosen)
    traced = chunks.join(chosen.where("a is not null"), ["row", "k"]).mapInArrow(back, "row long, k long, ids binary")
    joined = traced.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    joined = joined.select("row", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    whole = giants.join(chosen.where("a is null").select("row"), "row", "left_semi").select("doc_id", "text").mapInArrow(short, out)
    parts = decode(giants.select("row", "doc_id").join(joined, "row"), model_path).select("doc_id", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
    return done.unionByName(parts).unionByName(whole)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, decoded) of rows with ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept(("pieces", model_path), lambda: Pieces(model_path))
        for batch in slices(batches, "ids"):
            texts = [model.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256 (of the decoded text, which is the text)."""
    found = encode(docs, model_path)
    return found.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "decoded_sha256")
