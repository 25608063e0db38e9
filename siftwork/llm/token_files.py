"""Token ids in flat binary files with 64-bit document offsets, read back through memory maps.

Format, for each part of the ascending doc_id order:
  part.ids   token ids, little-endian unsigned: 16 bits if the vocabulary has at most 65,536 ids, else 32
  part.off   little-endian unsigned 64-bit offsets in ids, one more than the part has documents
  part.doc   little-endian signed 64-bit doc_ids; null ones come first, the manifest says how many (0 in the file)
The base of a part is the prefix sum of the ids of the parts before it; a document's global start is base plus offset.

Encoding is by the tokenizers library. A byte-level pre-tokenizer always splits before a space that precedes a
character other than white space, so each such chunk is encoded once in a worker's life and found in a dictionary
afterwards; the ids are those of the whole text (tests compare them). Texts that hold a string of an added token, such as
<|endoftext|>, are cut there first, as the library as loaded does: the token's id stands for the string.

Scale: one shuffle, a range partition on doc_id; each task writes its part alone, and the only thing gathered is a
window over one row for each part. Parts are read back by as many tasks as there are parts, by memory map or, in a remote
store, by ranges of about RANGE bytes. A task writes under a name of its own and renames at its end; the manifest that
Spark commits names the files of the attempt that counts, so lost executors and repeated tasks do no harm.

Cases: null or empty text is the end id alone; a null doc_id comes first and reads back as null; equal doc_ids are
ordered by text; an empty table writes nothing and reads as no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwork.llm.common import kept, materialize, shared_dir, slices

#: Chunks of each of two generations that a worker keeps.
CACHE = 1 << 19
#: Signs that end chunks of letters: none of them begins a token that letters end.
ENDS = ".,;:!?%&$#*|"
#: The characters that byte-level models use for bytes: printable Latin-1 for itself, the others from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: b if b in _PLAIN else 256 + [x for x in range(256) if x not in _PLAIN].index(b) for b in range(256)}
#: Chunks of one call of the library.
LINES = 512
_SPACES = re.compile(r" \s").search
#: Line feeds beside white space or at the end of a text.
_FEEDS = re.compile(r"\n(?=\s|\Z)|\n(?<=\s\n)").search
#: A text at its single line feeds between other characters than white space, and at the spaces before such characters.
_LINES, _PARTS = re.compile(r"\n(?=\S)(?<=\S\n)").split, re.compile(r" (?=\S)").split
#: Bytes of ids that a reader holds at a time.
RANGE = 4 << 20


class ChunkEncoder:
    """texts -> ids as bytes of `dtype`, by the library, each chunk once.

    A chunk is what stands between spaces, with the space before it; a space before white space or at the end of a text
    stays inside its chunk. A line feed between other characters than white space parts chunks too and belongs to the one
    behind it. New chunks go through the library many at a time: words of letters through the model, parted by a character that
    merges with nothing, others without white space as lines of one text, in which each line feed is a token of its own.
    """

    def __init__(self, path: str, dtype: str, added: bool = False):
        """added: strings of added tokens give the ids of these tokens, as by default in the library; else they are ordinary text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        #: the library as loaded, and the added tokens' strings (of those that begin at one place it takes the longest)
        self.loaded = Tokenizer.from_file(path) if added else None
        tokens = {t.content: (i, t) for i, t in self.tok.get_added_tokens_decoder().items()} if added else {}
        self.numbers = {x: np.array([i], dtype).tobytes() for x, (i, _) in tokens.items()}
        self.cuts = re.compile(f"({'|'.join(map(re.escape, sorted(tokens, key=len, reverse=True)))})") if tokens else None
        #: tokens that take spaces or whole words, or are sought in normalised text, are left to the library
        self.plain = not any(t.lstrip or t.rstrip or t.single_word for _, t in tokens.values())
        self.always = self.tok.normalizer is not None and any(t.normalized for _, t in tokens.values())
        self.tok.encode_special_tokens = True  # what stands between them is ordinary text
        self.dtype, self.feed = dtype, self.ids("a\nb")[1]
        self.one_feed = len(self.ids("a\n b")) == 3
        #: a line feed between characters other than white space is a token of its own, and what follows is as at a text's begin
        self.lines = all(self.ids(f"{x}\n{y}") == [*self.ids(x), self.feed, *self.ids(y)] for x in ("a", "a.", "1", "\u00e9", "a'") for y in ("b", ".b", "1", "\u65e5", "'s"))
        self.feed_bytes = np.array([self.feed], dtype).tobytes()
        self.model = self.tok.model
        #: a control character whose sign stands in no longer token: it merges with nothing, and no letter has its byte
        vocab = self.tok.get_vocab()
        longer = set().union(*(x for x in vocab if len(x) > 1))
        self.mark = next((chr(i) for i in range(32) if chr(BYTE_SIGNS[i]) in vocab and chr(BYTE_SIGNS[i]) not in longer), None)
        self.mark_id = vocab[chr(BYTE_SIGNS[ord(self.mark)])] if self.mark is not None else None
        probe = ["Gr\u00fc\u00df\u00e9\u0436\u65e5ing", "a", "ing", "the"]
        self.letters = False
        try:  # a byte-level model that merges by pairs alone, and a pre-tokenizer that parts letters from signs
            whole = getattr(self.model, "ignore_merges", True) or self.model.dropout or self.model.continuing_subword_prefix or self.model.end_of_word_suffix
            if self.mark is not None and not whole:
                got = self.stems([*probe, *(f"\n{x}" for x in probe)])
                want = [*(self.ids(f" {x}") for x in probe), *([self.feed, *self.ids(x)] for x in probe)]
                self.letters = got == [np.array(x, dtype).tobytes() for x in want] and all(self.ids(f" {x}.,") == self.ids(f" {x}") + self.ids(".,") for x in probe)
        except Exception:  # noqa: BLE001  the model has no tokens for single bytes
            self.letters = False
        self.ends: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, text: str) -> list[int]:
        return self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def cut(self, ids: np.ndarray, at: int, n: int) -> list[bytes] | None:
        """The n runs of ids that the id `at` parts, as bytes; None if they are not n."""
        cuts = np.flatnonzero(ids == at)
        if len(cuts) != n - 1:
            return None
        data, width = ids.tobytes(), ids.itemsize
        return [data[b:e] for b, e in zip([0, *((cuts + 1) * width).tolist()], [*(cuts * width).tolist(), len(data)], strict=True)]

    def stems(self, words: list[str]) -> list[bytes]:
        """ids of chunks that are words of letters, which the pre-tokenizer keeps whole: straight from the model, many in a call
        with the character that merges with nothing between them."""
        out: list[bytes] = []
        for a in range(0, len(words), LINES):
            part = words[a : a + LINES]
            text = self.mark.join([x[1:] if x[0] == "\n" else f" {x}" for x in part]).encode().decode("latin-1").translate(BYTE_SIGNS)
            got = self.cut(np.array([t.id for t in self.model.tokenize(text)], self.dtype), self.mark_id, len(part))
            out += [self.feed_bytes + y if x[0] == "\n" else y for x, y in zip(part, got, strict=True)]
        return out

    def learn(self, chunks: set[str]) -> None:
        """Puts the ids of new chunks into the dictionary."""
        spaced, old, ends, rest, stems, signed = self.spaced, self.old, self.ends, [], set(), []
        for x in chunks:
            y = x.rstrip(ENDS)  # signs after letters are a token run of their own, found again with other words
            if self.letters and (y.isalpha() or (y[:1] == "\n" and y[1:].isalpha())):
                if y == x:
                    stems.add(x)
                    continue
                tail = x[len(y) :]
                if tail not in ends and len(ends) < CACHE:
                    ends[tail] = np.array(self.ids(tail), self.dtype).tobytes()
                if tail in ends:
                    signed.append((x, y, tail))
                    if y in old:
                        spaced[y] = old[y]
                    elif y not in spaced:
                        stems.add(y)
                    continue
            rest.append(x)
        words = list(stems)
        spaced.update(zip(words, self.stems(words), strict=True))
        for x, y, tail in signed:
            spaced[x] = spaced[y] + ends[tail]
        # a line each; white space at an end of a line would join its line feed
        plain = [x for x in rest if (y := x.removeprefix("\n")) and "\n" not in y and not y[0].isspace() and not y[-1].isspace()] if self.one_feed and self.lines else []
        for a in range(0, len(plain), LINES):
            part = plain[a : a + LINES]
            got = self.cut(np.array(self.ids("\n".join([x[1:] if x[0] == "\n" else f" {x}" for x in part])), self.dtype), self.feed, len(part))
            if got is None:  # not the pre-tokenizer that this relies on
                break
            spaced.update((x, self.feed_bytes + y if x[0] == "\n" else y) for x, y in zip(part, got, strict=True))
        for x in rest:
            if x not in spaced:
                spaced[x] = self.feed_bytes + np.array(self.ids(x[1:]), self.dtype).tobytes() if x[0] == "\n" else np.array(self.ids(f" {x}"), self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.always:
            return [self.library(x) for x in texts]
        if self.cuts is None or not any(map(self.cuts.search, texts)):
            return self.between(texts)
        if not self.plain:
            got = iter(self.between([x for x in texts if not self.cuts.search(x)]))
            return [self.library(x) if self.cuts.search(x) else next(got) for x in texts]
        pieces = [self.cuts.split(x) for x in texts]  # every second one is a token
        got = iter(self.between([y for p in pieces for y in p[::2]]))
        return [b"".join(self.numbers[y] if k % 2 else next(got) for k, y in enumerate(p)) for p in pieces]

    def library(self, text: str) -> bytes:
        return np.array(self.loaded.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def between(self, texts: list[str]) -> list[bytes]:
        """Texts without strings of added tokens. Arrow numbers the chunks of all texts, so that each different one is looked up once,
        and lays their ids side by side.

        A chunk stands between spaces, each of which precedes a character other than white space and belongs to the chunk behind it;
        one that begins with a line feed, as a text's first one is made to do, has no space before it."""
        if not texts:
            return []
        begun = [f"\n{x}" for x in texts]
        odd = [bool(_SPACES(x) or x[-1] == " " or (x.find("\n", 1) > 0 and (not self.lines or _FEEDS(x, 1)))) for x in begun]
        order = [i for i, x in enumerate(odd) if not x] + [i for i, x in enumerate(odd) if x]
        cut = [
            pc.split_pattern(pa.array([x.replace("\n", " \n")[1:] for x, y in zip(begun, odd, strict=True) if not y], pa.large_string()), " "),
            pa.array([self.parts(x) for x, y in zip(begun, odd, strict=True) if y], pa.list_(pa.large_string())),
        ]
        chunks = pa.concat_arrays([x.flatten() for x in cut]).dictionary_encode()
        ids = pa.array(self.known(chunks.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(chunks.indices)
        last = np.cumsum(np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in cut]).astype(np.int64))
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64)[last].tolist()
        data, skip, out = memoryview(data), len(self.feed_bytes), [b""] * len(texts)
        for i, a, b in zip(order, [0, *ends[:-1]], ends, strict=True):
            out[i] = bytes(data[a + skip : b])
        return out

    def parts(self, text: str) -> list[str]:
        """The chunks of a text with white space beside spaces or line feeds."""
        lines = _LINES(text) if self.lines else [text]
        return _PARTS(lines[0]) + [y for x in lines[1:] for y in _PARTS(f"\n{x}")]

    def known(self, chunks: list[str]) -> list[bytes]:
        """ids of different chunks, from the dictionary; new ones are put there first."""
        if len(self.spaced) > CACHE:
            self.spaced, self.old = {}, self.spaced
        found = list(map(self.spaced.get, chunks))
        new = {chunks[i]: i for i, y in enumerate(found) if y is None}
        again = new.keys() & self.old.keys()
        self.spaced.update((x, self.old[x]) for x in again)
        self.learn(new.keys() - again)
        for x, i in new.items():
            found[i] = self.spaced[x]
        return found


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, out: str | None = None) -> DataFrame:
    """Writes the files under `out` (default: the shared folder); one row for each part: part, path, n_docs, n_nulls, n_ids, dtype, base."""
    spark = docs.sparkSession
    out = out or shared_dir(spark)
    from tokenizers import Tokenizer

    dtype = "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        fs.create_dir(root, recursive=True)
        part = pyspark.TaskContext.get().partitionId()
        stem = f"{root}/part-{part:06d}-{uuid.uuid4().hex}"
        encoder, end = kept(("chunks", tokenizer_path, dtype), lambda: ChunkEncoder(tokenizer_path, dtype, added=True)), np.array([end_id], dtype).tobytes()
        width, ids, offsets, names, nulls = len(end), None, [0], [], 0
        for batch in slices(batches, "text"):
            if ids is None:
                ids = fs.open_output_stream(f"{stem}.ids.open")
            for data, doc in zip(encoder.encode([x or "" for x in batch.column("text").to_pylist()]), batch.column("doc_id").to_pylist(), strict=True):
                data += end
                ids.write(data)
                offsets.append(offsets[-1] + len(data) // width)
                names.append(0 if doc is None else doc)
                nulls += doc is None
        if ids is None:
            return
        ids.close()
        for kind, data in (("off", np.array(offsets, "<u8")), ("doc", np.array(names, "<i8"))):
            with fs.open_output_stream(f"{stem}.{kind}.open") as f:
                f.write(data.tobytes())
        for kind in ("ids", "off", "doc"):
            fs.move(f"{stem}.{kind}.open", f"{stem}.{kind}")
        yield pa.RecordBatch.from_pylist([{"part": part, "path": stem, "n_docs": len(names), "n_nulls": nulls, "n_ids": offsets[-1]}])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    parts = materialize(ordered.mapInArrow(write, "part long, path string, n_docs long, n_nulls long, n_ids long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    return parts.select("*", F.lit(dtype).alias("dtype"), F.lit(out).alias("root"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))


def read_token_files(parts: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids as binary of 32-bit ids) of every document of the files, part by part."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, _ = pafs.FileSystem.from_uri(r["root"])
                with fs.open_input_file(f"{r['path']}.off") as f:
                    off = np.frombuffer(f.read(), "<u8")
                with fs.open_input_file(f"{r['path']}.doc") as f:
                    doc = np.frombuffer(f.read(), "<i8")
                width = np.dtype(r["dtype"]).itemsize
                mapped = np.memmap(f"{r['path']}.ids", r["dtype"], "r") if isinstance(fs, pafs.LocalFileSystem) else None
                with fs.open_input_file(f"{r['path']}.ids") as f:
                    begin = 0
                    while begin < len(doc):
                        end = max(begin + 1, int(np.searchsorted(off, off[begin] + np.uint64(RANGE // width), "right")) - 1)
                        end = min(end, len(doc), begin + 4096)
                        if mapped is None:
                            f.seek(int(off[begin]) * width)
                            ids = np.frombuffer(f.read(int(off[end] - off[begin]) * width), r["dtype"])
                        else:
                            ids = mapped[off[begin] : off[end]]
                        at = (off[begin : end + 1] - off[begin]).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(doc[begin:end], mask=np.arange(begin, end) < r["n_nulls"]), pa.array((off[begin:end] + np.uint64(r["base"])).astype("i8")), pa.array(np.diff(at)),
                            pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                        ], ["doc_id", "start", "n_tokens", "ids"])
                        begin = end

    tasks = max(1, parts.count())
    return parts.repartitionByRange(tasks, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def token_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The files of docs, read back: doc_id, start, n_tokens, ids_crc32."""
    return read_token_files(write_token_files(docs, tokenizer_path)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc_of(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
