"""WARC archives of pages with revisit records, and a two-level capture index over them.

Writing: each task writes one archive, a gzip member for each record. Of records with equal payloads of at least
MIN_REVISIT bytes the one with the largest page_id is the response; the others are revisits, without payload.

Index: lines (reversed-host URL key, page_id, archive, offset, length) are range-sorted; each part holds compressed
blocks of LINES lines and a sparse directory with the first key of each block; a short table has the first key of each
part. A look-up finds the part and then the block by binary search, reads one block, finds the line by binary search, and
reads the record's bytes of the archive. Look-ups are dealt by range over about one task for READ_BYTES of records.

Scale: duplicates are found by a grouped maximum over digests (map-side combined, so a payload may be any share of the
rows); only rows that turn into revisits are then joined to the pages, by broadcast if Spark finds their table small. Html
is not shuffled otherwise. Index parts are cut by key and page_id, so a host may hold any share. Files are written under a
name of the attempt and moved at its end; committed rows name those that count. The driver gets one row for each part.

Cases: null html is an empty payload; a null url has the key ')/'; a null page_id is never another's response
and reads back as null; repeated page_ids with equal payloads are responses both, each with its own record; an empty
table has no archives and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import materialize, shared_dir, slices

MIN_REVISIT = 1000
LINES = 256
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: About how many bytes of archives one task reads.
READ_BYTES = 4 << 20
_URL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^#]*)")


def surt(url: str | None) -> str:
    """Reversed-host key: http://www.a.example.com:80/x?y -> com,example,a)/x?y."""
    m = _URL.match(url or "")
    host, port, rest = (m[1].lower(), m[2], m[3]) if m else ("", "", url or "")
    parts = host.removeprefix("www.").split(".") if host else []
    port = f":{port}" if port and port not in ("80", "443") else ""
    return re.sub(r"[\x00-\x20\x7f]", lambda c: quote(c[0]), f"{','.join(reversed(parts))}{port}){rest if rest.startswith('/') else '/' + rest}")


def ident(page_id: int | None) -> tuple[int, int]:
    """Sorts like Spark's page_id: null first."""
    return (0, 0) if page_id is None else (1, page_id)


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record, not yet compressed."""
    sha = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', lambda c: quote(c[0]), url or 'about:blank')}"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(sha).decode()}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(body).digest()).decode()}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"WARC-Page-Id: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "replace") + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def revisits(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that another row's response stands for."""
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = materialize(pages.select("page_id", html.alias("h")).where(F.length("h") >= least).select("page_id", F.sha1("h").alias("digest")))
    groups = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    found = rows.join(groups, "digest").where("page_id is not null and page_id < refers_to")
    return materialize(found.select("page_id", "digest", "refers_to").distinct())


def write_archives(pages: DataFrame, out: str | None = None, level: int = 1) -> DataFrame:
    """Archives under `out` (default: the shared folder); one row for each record: key, page_id, path, offset, length."""
    out = out or shared_dir(pages.sparkSession)
    used = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    other = revisits(used).select(F.col("page_id").alias("other"), "digest", "refers_to")
    # a page_id may stand on rows with several payloads, so the digest decides too
    planned = used.join(other, (F.col("page_id") == F.col("other")) & (F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")) == F.col("digest")), "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        fs.create_dir(root, recursive=True)
        path, f, at = f"{root}/pages-{uuid.uuid4().hex}.warc.gz", None, 0
        rows: list[tuple] = []
        for batch in slices(batches, "html"):
            f = f or fs.open_output_stream(f"{path}.open")
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = z.compress(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to)) + z.flush()
                f.write(data)
                rows.append((surt(url), page_id, path, at, len(data)))
                at += len(data)
        if f is not None:
            f.close()
            fs.move(f"{path}.open", path)
        for a in range(0, len(rows), 4096):
            part = [*zip(*rows[a : a + 4096], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "path", "offset", "length"])

    return materialize(planned.mapInArrow(write, "key string, page_id long, path string, offset long, length long"))


def write_index(records: DataFrame, out: str | None = None, lines: int = LINES) -> DataFrame:
    """Blocks and directories under `out`; one row for each part: key and page_id of its first line, stem of its files, bytes of its records."""
    out = out or shared_dir(records.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        fs.create_dir(root, recursive=True)
        stem, f, at, block, directory, total = f"{root}/index-{uuid.uuid4().hex}", None, 0, [], [], 0

        def flush() -> None:
            nonlocal at
            if block:
                data = zlib.compress("\n".join("\t".join("" if x is None else str(x) for x in r) for r in block).encode("utf-8", "surrogatepass"), 6)
                f.write(data)
                directory.append([block[0][0], block[0][1], at, len(data)])
                at += len(data)
                block.clear()

        for batch in batches:
            f = f or fs.open_output_stream(f"{stem}.blocks.open")
            for r in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "path", "offset", "length")), strict=True):
                block.append(r)
                total += r[-1]
                if len(block) == lines:
                    flush()
        if f is None:
            return
        flush()
        f.close()
        with fs.open_output_stream(f"{stem}.dir.open") as d:
            d.write(json.dumps(directory).encode())
        for kind in ("blocks", "dir"):
            fs.move(f"{stem}.{kind}.open", f"{stem}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]], pa.string()), pa.array([directory[0][1]], pa.int64()), pa.array([stem], pa.string()), pa.array([out], pa.string()), pa.array([total], pa.int64())], ["key", "page_id", "stem", "root", "bytes"])

    ordered = records.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return materialize(ordered.mapInArrow(write, "key string, page_id long, stem string, root string, bytes long"))


class Index:
    """Look-ups in the files of one part."""

    def __init__(self, fs: pafs.FileSystem, stem: str):
        with fs.open_input_stream(f"{stem}.dir") as f:
            self.directory = json.loads(f.read())
        self.firsts = [(k, ident(i)) for k, i, _, _ in self.directory]
        self.file, self.at, self.lines, self.keys = fs.open_input_file(f"{stem}.blocks"), -1, [], []

    def load(self, b: int) -> None:
        if b != self.at:
            _, _, offset, length = self.directory[b]
            self.file.seek(offset)
            rows = [x.split("\t") for x in zlib.decompress(self.file.read(length)).decode("utf-8", "surrogatepass").split("\n")]
            self.lines, self.at = [(k, int(i) if i else None, p, int(o), int(n)) for k, i, p, o, n in rows], b
            self.keys = [(r[0], ident(r[1])) for r in self.lines]

    def close(self) -> None:
        self.file.close()

    def find(self, key: str, page_id: int | None) -> Iterator[tuple]:
        """All lines of a key and page_id."""
        name = key, ident(page_id)
        b = max(0, bisect.bisect_left(self.firsts, name) - 1)
        while b < len(self.firsts) and self.firsts[b] <= name:
            self.load(b)
            i = bisect.bisect_left(self.keys, name)
            while i < len(self.keys) and self.keys[i] == name:
                yield self.lines[i]
                i += 1
            b += 1


def look_up(wanted: DataFrame, parts: DataFrame) -> DataFrame:
    """Records of (url, page_id) rows, read through the index: page_id, payload_bytes, payload_digest, record_type, refers_to, payload."""
    table = sorted((r["key"], ident(r["page_id"]), r["stem"], r["root"], r["bytes"]) for r in parts.collect())  # one row for each part
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    spark = wanted.sparkSession
    if not table:
        return spark.createDataFrame([], schema)
    firsts = [r[:2] for r in table]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [surt(u) for u in batch.column("url").to_pylist()]
            ids = batch.column("page_id").to_pylist()
            part = [max(0, bisect.bisect_right(firsts, (k, ident(i))) - 1) for k, i in zip(keys, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(keys, pa.string()), pa.array(ids, pa.int64())], ["part", "key", "page_id"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes: dict[int, Index] = {}
        files: dict[str, pa.NativeFile] = {}
        fs, _ = pafs.FileSystem.from_uri(table[0][3])
        out: list[dict] = []
        held = 0
        for batch in batches:
            for part, key, page_id in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "page_id")), strict=True):
                if part not in indexes:
                    for x in indexes.values():
                        x.close()
                    indexes.clear()
                    indexes[part] = Index(fs, table[part][2])
                # equal lines stand at the end of one part and the start of the next only if repeated rows do
                for k in range(part, -1, -1):
                    if k != part and (k not in indexes):
                        indexes[k] = Index(fs, table[k][2])
                    for _, _, path, offset, length in indexes[k].find(key, page_id):
                        if path not in files:
                            if len(files) >= 64:
                                files.pop(next(iter(files))).close()
                            files[path] = fs.open_input_file(path)
                        files[path].seek(offset)
                        fields, http, payload = parse(zlib.decompress(files[path].read(length), 31))
                        kind = fields["WARC-Type"]
                        digest = hashlib.sha1(payload).hexdigest() if kind == "response" else base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        named = fields.get("WARC-Page-Id")
                        refers = fields.get("WARC-Refers-To-Page")
                        out.append({"page_id": named and int(named), "payload_bytes": len(payload) if kind == "response" else int(http["Content-Length"]), "payload_digest": digest, "record_type": kind, "refers_to": refers and int(refers), "payload": payload})
                        held += len(payload) + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, READ)
                            out, held = [], 0
                    if firsts[k] != (key, ident(page_id)):
                        break
        if out:
            yield pa.RecordBatch.from_pylist(out, READ)
        for x in (*indexes.values(), *files.values()):
            x.close()

    tasks = max(len(table), -(-sum(r[4] for r in table) // READ_BYTES))
    routed = wanted.select("url", "page_id").distinct().mapInArrow(route, "part long, key string, page_id long")
    return routed.distinct().repartitionByRange(tasks, "part", "key", "page_id").sortWithinPartitions("part", "key", "page_id").mapInArrow(read, schema)


READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def digest(pages: DataFrame) -> DataFrame:
    """Archives and index of pages, every record read back through the index."""
    parts = write_index(write_archives(pages))
    return look_up(pages.select(F.col("url").cast("string").alias("url"), "page_id"), parts).drop("payload")
