"""The operators on Spark: odd rows, empty tables, brute force, and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siftwork.llm import audio, common, embeddings, mixing, ngram_join, pages, pieces, pii, token_files, toxicity, warc

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# ---- components ----


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_a_walk(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)]
    up = {i: i for i in range(200)}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {x["id"]: x["component"] for x in rows(common.components(spark.createDataFrame(edges, "a long, b long")))}
    for i in range(200):
        assert got.get(i, i) == root(i)


def test_components_of_nothing(spark):
    assert rows(common.components(spark.createDataFrame([], "a long, b long"))) == []


# ---- personal data ----


def test_pii_on_odd_rows(odd, none):
    out = rows(pii.digest(pii.find_spans(odd)))
    assert len(out) == odd.count() and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() and r["spans"] == "" for r in out)
    assert rows(pii.digest(pii.find_spans(none))) == []


def test_pii_beside_nulls_and_ties(spark):
    text = "write to a.b@c.de, 10.0.0.1 or +1 (487) 555-7209; token = \"77aa88bb99cc00dd11ee22ff\" ends"
    data = [(1, text, "x", 1), (1, text, "x", 1), (None, text, None, 2), (2, None, "y", None), (3, "", "z", 3), (4, "w " * 300_000 + text, "z", 3)]
    d = spark.createDataFrame(data, "doc_id long, text string, spans string, n_email long")
    want = []
    for i, t, *_ in data:
        base = pii.base_spans(t or "")
        at = (t or "").find("77aa")
        every = [*base, *([("secret", at, at + 24)] if at >= 0 else [])]
        line = lambda xs: ",".join(f"{k}:{b}:{e}" for k, b, e in xs)
        want.append((str(i), sum(k == "email" for k, *_ in base), hashlib.sha256(line(base).encode()).hexdigest(), line(every)))
    got = [(str(r["doc_id"]), r["n_email"], r["base_sha256"], r["spans"]) for r in rows(pii.digest(pii.find_spans(d)))]
    assert sorted(got) == sorted(want)


def test_field_adds_only_secrets_of_the_corpus(spark):
    """Every added span of a real table is the value behind a name like token or key: none is in other prose."""
    found = pii.find_spans(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), ("doc_id", "text"))
    added = [(r["text"], s) for r in found.collect() for s in r["spans"] if s not in r["base_spans"]]
    assert len(added) >= 5
    assert all(s["kind"] == "secret" and any(c in t[max(0, s["start"] - 24) : s["start"]].lower() for c in ("token", "key", "secret", "password")) for t, s in added)


def test_redaction(spark):
    d = spark.createDataFrame([(1, "write to a.b@c.de or +1 (487) 555-7209 now", "x"), (2, None, "y"), (3, "clean text", "z")], "doc_id long, text string, n_chars string")
    out = {r["doc_id"]: r for r in rows(pii.redact(d))}
    assert out[1]["text"] == "write to <EMAIL> or <PHONE> now" and out[2]["text"] is None and out[3]["text"] == "clean text"


# ---- joins of shingle sets ----


def brute_components(texts):
    sets, up = {}, {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        up[i] = i

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed, n=140):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") * r.randint(1, 3) + str(r.randrange(40))
    passage = [word() for _ in range(60)]
    bases = [[word() for _ in range(r.choice([3, 5, 6, 30, 120, 400]))] for _ in range(12)]
    texts = {}
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.3:
            at = r.randrange(len(w) + 1)
            w[at:at] = passage
        texts[i * 3 + 1] = " ".join(w) if r.random() < 0.9 else None if r.random() < 0.5 else " ".join(word() for _ in range(40)) + " " + " ".join(passage)
    return texts


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("long,hot", [(2, 1 << 15), (2, 3), (12, 1 << 15)])
def test_join_equals_brute_force(spark, monkeypatch, seed, long, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "GROUP", 64)
    monkeypatch.setattr(ngram_join, "LONG", long)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    texts = near_copies(seed)
    d = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(ngram_join.join_components(d))}
    assert got == brute_components(texts)


def test_join_on_odd_rows(odd, none):
    out = rows(ngram_join.join_components(odd))
    assert len(out) == odd.count()
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert by[0]["component_id"] == 0 and by[0]["n_shingles"] == 0 and by[10]["component_id"] == 9 and by[4]["n_shingles"] == 1
    assert rows(ngram_join.join_components(none)) == []
    kept = rows(ngram_join.one_of_each(odd))
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [0, 1, 2, 4, 5, 6, 7, 8, 9]
    assert sum(r["doc_id"] is None for r in kept) == 1 and rows(ngram_join.one_of_each(none)) == []


def test_one_of_each_with_repeated_and_null_ids(spark):
    base = "the same ten words stand in this text and one more"
    other = "a wholly different text of more than five words is here"
    data = [(1, base, "a"), (1, other, "b"), (2, base, "c"), (None, base, "d"), (None, "null ids alone make one group of equal texts here", "e"), (None, "null ids alone make one group of equal texts here", "f"), (7, other, "g"), (7, other, "h"), (8, None, "i"), (None, None, "j"), (None, " ", "k")]
    d = spark.createDataFrame(data, "doc_id long, text string, key string")
    out = sorted((str(r["doc_id"]), r["text"]) for r in rows(ngram_join.one_of_each(d)) if r["text"] and r["text"].strip())
    assert out == [("1", other), ("1", base), ("None", data[4][1])] or out == sorted([("1", base), ("1", other), ("None", data[4][1])])
    assert sorted(r["key"] for r in rows(ngram_join.one_of_each(d)) if not (r["text"] or "").strip()) == ["i", "j", "k"]


def test_bounds_from_a_common_set_hold(spark):
    r = random.Random(1)
    sets = [{r.randrange(30) for _ in range(r.randint(5, 25))} for _ in range(12)]
    pairs = [(i, j, len(sets[i]), len(sets[j])) for i in range(12) for j in range(i)]
    answers = [(i, k, len(sets[i]), len(sets[k]), len(sets[i] & sets[k])) for i in range(12) for k in range(3) if i != k]
    out = rows(ngram_join.derived(spark.createDataFrame(pairs, "a long, b long, n long, m long"), spark.createDataFrame(answers, "node long, lead long, n long, l long, o long")))
    assert len(out) == len(pairs) and all(x["least"] <= len(sets[x["a"]] & sets[x["b"]]) <= x["most"] for x in out)
    assert all(x["least"] == x["most"] for x in out if min(x["a"], x["b"]) < 3)  # compared before: known exactly


# ---- token files ----


def test_token_files_equal_the_library(spark, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    tok.encode_special_tokens = True
    out = rows(token_files.token_digest(odd, BPE))
    assert len(out) == odd.count()
    src = sorted(rows(odd), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    start = 0
    for s, o in zip(src, sorted(out, key=lambda r: r["start"]), strict=True):
        ids = [*tok.encode(s["text"] or "", add_special_tokens=False).ids, 0]
        assert (o["doc_id"], o["start"], o["n_tokens"], o["ids_crc32"]) == (s["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert rows(token_files.token_digest(none, BPE)) == []


def test_token_files_keep_all_ids_and_read_ranges(spark, monkeypatch):
    monkeypatch.setattr(token_files, "RANGE", 64)
    low = -(1 << 63)
    d = spark.createDataFrame([(low, "a b c d " * 40), (None, "x"), (None, "y z"), (0, "t " * 5000), (5, None)], "doc_id long, text string").repartition(3)
    parts = token_files.write_token_files(d, BPE)
    out = sorted(rows(token_files.read_token_files(parts)), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == [None, None, low, 0, 5]
    assert token_files.read_token_files(parts).rdd.getNumPartitions() >= parts.count()


def test_token_files_hold_the_ids_of_added_tokens(spark):
    out = rows(token_files.token_digest(spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "x")], "doc_id long, text string"), BPE))
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in out] == [(1, 0, 5), (2, 5, 2)]
    assert out[0]["ids_crc32"] == token_files.crc_of([64, 220, 50256, 275, 0])


# ---- WARC ----


def page_rows(spark):
    big, small = "<p>" + "x" * 1200 + "</p>", "<p>s</p>"
    data = [(1, "http://a.b/1", big), (2, "http://a.b/1", big), (9, "http://c.d/?q", big), (3, None, small), (4, "http://a.b/2", small), (5, "http://a.b/2", None), (None, "http://e.f", big), (6, "http://z", "é" * 600), (6, "http://z", "é" * 600), (-(1 << 63), "http://low", small), (None, None, "v" * 3_000_000)]
    return spark.createDataFrame([(*r, "extra", None) for r in data], "page_id long, url string, html string, record_type string, payload binary")


def test_archives_round_trip(spark):
    p = page_rows(spark)
    out = sorted(rows(warc.digest(p)), key=str)
    want = []
    for r in rows(p):
        b = (r["html"] or "").encode()
        top = max((x["page_id"] for x in rows(p) if x["html"] == r["html"] and x["page_id"] is not None), default=None)
        rev = len(b) >= 1000 and r["page_id"] is not None and r["page_id"] < top
        want.append({"page_id": r["page_id"], "payload_bytes": len(b), "payload_digest": hashlib.sha1(b).hexdigest(), "record_type": "revisit" if rev else "response", "refers_to": top if rev else None})
    assert out == sorted(want, key=str)
    assert rows(warc.digest(p.limit(0))) == []


def test_index_finds_what_is_there(spark):
    p = page_rows(spark)
    parts = warc.write_index(warc.write_archives(p), lines=2)
    got = rows(warc.look_up(spark.createDataFrame([("http://c.d/?q", 9), ("http://c.d/?q", 8), ("http://nowhere", 1)], "url string, page_id long"), parts))
    assert [(r["page_id"], len(r["payload"])) for r in got] == [(9, 1207)]


# ---- audio ----


def test_audio_on_odd_rows(odd, none, tmp_path):
    media = audio.write_media(odd)
    files = audio.store_tensors(media, f"file://{tmp_path}/t")
    out = rows(audio.digest(audio.read_tensors(files)))
    assert len(out) == odd.count()
    assert sorted(map(str, out)) == sorted(map(str, rows(audio.digest(audio.features(media)))))
    by = {}
    for r in out:
        key = r.pop("doc_id"), r["payload_sha256"]
        assert by.setdefault(key[1], r) == r
    empty = next(r for r in out if r["n_bytes"] == 0)
    assert empty["payload_bytes"] == 64 and empty["payload_sha256"] == hashlib.sha256(bytes(64)).hexdigest() and empty["tail_crc32"] == zlib.crc32(bytes(64))
    assert rows(audio.digest(audio.read_tensors(audio.store_tensors(audio.write_media(none))))) == []
    import pyarrow as pa

    with pa.ipc.open_file(rows(files)[0]["path"]) as f:
        t = f.read_all()
    assert t.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float16(), (audio.BLOCK, audio.MELS)) and {"block", "start_ms", "end_ms"} <= {*t.column_names}


def test_stored_features_equal_a_plain_computation(spark):
    """Filter at the high rate, drop samples, one DFT a frame, triangles one by one, thresholds in a loop."""
    texts = ["", "short", "the quick brown fox " * 90, "\u0000\uffff é" * 700, "ab" * 3000 + "~" * 4000 + "!" * 2000]
    d = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in rows(audio.read_tensors(audio.store_tensors(audio.write_media(d))))}
    h = audio.low_pass(3, 4).astype("f8")
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(6000), audio.MELS + 2) / 2595) - 1)
    f = np.arange(257) * 12000 / 512
    bank = np.array([[max(0.0, min((x - a) / (b - a), (c - x) / (c - b))) for a, b, c in zip(edges, edges[1:], edges[2:], strict=False)] for x in f])
    for i, text in enumerate(texts):
        data = text.encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        x = (np.frombuffer(payload, "u1").astype("f8") - 128) / 128
        up = np.zeros(3 * len(x))
        up[::3] = x
        y = np.convolve(up, h)[len(h) // 2 :][: 3 * len(x) : 4]
        n = 1 + max(0, -(-(len(y) - 400) // 160))
        y = np.append(y, np.zeros(n * 160 + 400))
        window, got, db = np.hanning(400), [], []
        for k in range(n):
            part = y[k * 160 : k * 160 + 400] * window
            got.append(np.log(np.abs(np.fft.fft(part, 512)[:257]) ** 2 @ bank + 1e-6))
            db.append(10 * np.log10((part**2).mean() + 1e-6))
        blocks = -(-n // 16)
        tensor = np.frombuffer(out[i]["tensor"], "f2").reshape(blocks * 16, 32)
        assert out[i]["shape"] == [blocks, 16, 32] and np.allclose(tensor[:n], got, atol=0.03) and np.all(tensor[n:] == np.float16(np.log(1e-6)))
        on, segments, mid = False, [], np.median(db)
        for k, v in enumerate(db):
            now = True if v > mid + audio.HIGH_DB else False if v < mid + audio.LOW_DB else on
            if now != on:
                segments = [*segments, [k, n]] if now else [*segments[:-1], [segments[-1][0], k]]
            on = now
        ms = 1000 * 160 / 12000
        assert [(s["start"], s["end"]) for s in out[i]["segment_ms"]] == [(round(a * ms), round(b * ms)) for a, b in segments]
        assert [(s["start"], s["end"]) for s in out[i]["block_ms"]] == [(round(k * 16 * ms), round(min(n, k * 16 + 16) * ms)) for k in range(blocks)]


# ---- pieces ----


def test_pieces_with_giants(spark, odd, none):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(4)
    long = [" ".join(r.choice(["the", "ofthe", "reading", "thnd", "日本語", "x1"]) for _ in range(300)), "unbroken" * 200, "a  b   c " * 150, "word \n\t" * 200]
    d = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(long)], "doc_id long, text string"))
    out = sorted((str(x["doc_id"]), x["n_tokens"], x["ids_crc32"], x["decoded_sha256"]) for x in rows(_with_chunks(d, 97)))
    want = sorted((str(x["doc_id"]), len(ids := lib.encode(x["text"] or "")), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256((x["text"] or "").encode()).hexdigest()) for x in rows(d))
    assert out == want
    assert rows(pieces.digest(none, PIECES)) == []


def _with_chunks(d, chunk):
    f = pieces.encode(d, PIECES, chunk)
    return f.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "decoded_sha256")


# ---- pages ----


def test_hosts_vote(spark):
    good = "<html><body><div class='main-0'><p>" + "story text " * 20 + "</p></div><div class='extra'><p>{}</p></div></body></html>"
    data = [(i, f"http://h.x/{i}", good.format("short")) for i in range(5)] + [(9, "http://h.x/9", good.format("other words " * 30)), (10, None, None), (11, "", "<p>x")]
    p = spark.createDataFrame(data, "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in rows(pages.digest(p))}
    assert out[9] == ("story text " * 20).strip() and out[10] == "" and out[11] == "x"
    assert rows(pages.digest(p.limit(0))) == []


def test_other_containers_of_a_host_stay(spark):
    page = "<html><body><div class='main-0'><p>" + "story text " * 20 + "</p></div><div class='note'>{}</div><div class='foot'>the same words</div></body></html>"
    data = [(i, f"http://h.x/{i}", page.format(f"note of page {'abcdef'[i]}")) for i in range(6)]
    data.append((9, "http://h.x/9", page.format("x").replace("<body>", "<body><div class='long'><p>" + "another layout " * 60 + "</p></div>")))
    out = {r["page_id"]: r["text"] for r in rows(pages.digest(spark.createDataFrame(data, "page_id long, url string, html string")))}
    assert out[0] == "story text " * 20 + "note of page a"
    assert out[9] == "another layout " * 60 + "story text " * 20 + "x"


def test_pages_on_odd_rows(spark):
    long = "<article>" + "<p>" + "word " * 200_000 + "</p></article>"
    data = [(1, "http://h.x/1", "<p>same</p>", 7, "t"), (1, "http://h.x/1", "<p>same</p>", 7, "t"), (None, None, long, None, None), (3, "http://h.x/2", None, 1, "x"), (4, "http://h.x/3", "", 1, "x"), (5, "not a url", "<div>" * 30_000 + "deep", 1, "x")]
    d = spark.createDataFrame(data, "page_id long, url string, html string, n_chars long, text string")
    out = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in rows(pages.digest(d))), key=str)
    full = ("word " * 200_000).strip()
    assert out == sorted([(1, "http://h.x/1", "same", 4)] * 2 + [(None, None, full, len(full)), (3, "http://h.x/2", "", 0), (4, "http://h.x/3", "", 0), (5, "not a url", "deep", 4)], key=str)


def test_the_vote_changes_what_a_page_gives(spark):
    """Alone, a page whose reader corner is longer than its story would keep it; its host's repeated corner is left out."""
    page = "<html><body><div class='story'><p>{}</p></div><div class='corner'><p>{}</p></div></body></html>"
    data = [(i, f"http://h.x/{i}", page.format(f"story number {i} tells this " * 30, "the corner of the house")) for i in range(8)]
    alone = pages.Page(data[0][2])
    assert "corner" in alone.main(pages.best_path(alone.shares()))
    out = rows(pages.digest(spark.createDataFrame(data, "page_id long, url string, html string")))
    assert all(r["text"] == (f"story number {r['page_id']} tells this " * 30).strip() for r in out)


# ---- vectors ----


def test_links_equal_brute_force(spark):
    r = np.random.default_rng(6)
    c = r.normal(size=(15, 12))
    x = np.concatenate([c[r.integers(0, 15, 120)] + r.normal(size=(120, 12)) * 0.25, c[[0, 0, 0]]]).astype("f4").astype("f8")
    data = [(i * 2, [float(v) for v in row]) for i, row in enumerate(x)]
    data += [(1, None), (3, []), (5, [0.0] * 12), (7, [float("nan")] * 12), (9, [None] * 12), (11, [1.0, 2.0]), (13, [2.0, 4.0]), (15, [float("inf")] * 12)]
    out = {v["vec_id"]: v for v in rows(embeddings.links(spark.createDataFrame(data, "vec_id long, embedding array<double>"), block=32))}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    comp = np.arange(len(x))
    while not np.array_equal(new := np.array([comp[m].min() for m in link]), comp):
        comp = new
    for i in range(len(x)):
        assert (out[i * 2]["n_links"], out[i * 2]["component_id"]) == (link[i].sum() - 1, comp[i] * 2)
    assert all(out[i]["n_links"] == 0 and out[i]["component_id"] == i and out[i]["kept"] for i in (1, 3, 5, 7, 9, 15))
    assert out[13]["component_id"] == 11 and not out[13]["kept"]


def test_links_of_blocks_that_are_accepted_or_dropped_whole(spark):
    r = np.random.default_rng(2)
    c = r.normal(size=(4, 6))
    x = (c[np.arange(240) % 4] + r.normal(size=(240, 6)) * 0.02).astype("f4").astype("f8")
    data = [(None if i % 50 == 7 else i % 230, [float(v) for v in row], f"label {i}") for i, row in enumerate(x)]
    d = spark.createDataFrame(data, "vec_id long, embedding array<double>, kept string")
    points = spark.createDataFrame([(i, 1, [float(v) for v in row]) for i, row in enumerate(x)], "point long, w long, v array<double>")
    trees, pivots = embeddings.blocks_of(points, 6, 16)
    pairs, n = rows(embeddings.block_pairs(trees, pivots, 0.9)), trees.count()
    assert any(p["whole"] for p in pairs) and len(pairs) < n * (n + 1) / 3
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    comp = np.arange(len(x))
    while not np.array_equal(new := np.array([comp[m].min() for m in link]), comp):
        comp = new
    ids = [v[0] for v in data]
    least = {k: min(ids[i] for i in range(240) if comp[i] == k and ids[i] is not None) for k in {*comp}}
    want = sorted((str(ids[i]), int(link[i].sum()) - 1, least[comp[i]], ids[i] == least[comp[i]]) for i in range(240))
    got = sorted((str(v["vec_id"]), v["n_links"], v["component_id"], v["kept"]) for v in rows(embeddings.links(d, block=16)))
    assert got == want


def test_links_of_nothing(spark):
    assert rows(embeddings.links(spark.createDataFrame([], "vec_id long, embedding array<float>"))) == []


# ---- mixing ----


def test_mix_meets_targets(spark, odd, none):
    r = random.Random(8)
    data = [(i, " ".join(["w"] * r.randint(0, 30)), f"s{min(4, r.randrange(9))}" if i % 11 else None) for i in range(600)]
    out = rows(mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string")))
    sizes, targets, taken = {}, {}, {}
    for o in out:
        assert o["taken"] in (0, o["size"], 2 * o["size"])
        sizes[o["source"]], targets[o["source"]] = o["source_size"], o["target"]
        taken[o["source"]] = taken.get(o["source"], 0) + o["taken"]
    assert abs(sum(targets.values()) - 1.5 * sum(sizes.values())) < 1e-6
    for s, t in targets.items():
        assert t <= 2 * sizes[s] and abs(taken[s] - t) <= 31
    weights = dict(zip(["s0", "s1", "s2", "s3", "s4", None], [3, 1, 2, 3, 1, 2], strict=True))
    level = {round(t / weights[s], 6) for s, t in targets.items() if t < 2 * sizes[s]}
    assert len(level) == 1 and all(2 * sizes[s] / weights[s] <= max(level) + 1e-6 for s, t in targets.items() if t == 2 * sizes[s])
    assert len(rows(mixing.mix(odd))) == odd.count() and rows(mixing.mix(none)) == []
    assert rows(mixing.mixed_rows(none)) == []


def test_mixed_rows_repeat(spark):
    d = spark.createDataFrame([(i, "a b c", "x" if i < 3 else "y", i) for i in range(40)], "doc_id long, text string, source string, extra long")
    plan = {r["doc_id"]: r["copies"] for r in rows(mixing.mix(d))}
    got = {}
    for r in rows(mixing.mixed_rows(d)):
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: v for k, v in plan.items() if v}


# ---- toxicity ----


def test_toxicity_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0, 1), (5, 1, 0), (None, 1, 1), (77, 0, 1)], "doc_id long, quality int, toxic int")
    out = rows(toxicity.scored(odd, labels))
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert {r["doc_id"]: r["held_out"] for r in out if r["doc_id"] is not None} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in (0, 1, 2, *range(4, 11))}
    assert rows(toxicity.scored(none, labels)) == []


def test_held_out_accuracy(spark):
    r = random.Random(3)
    data = [(i, " ".join(r.choice(["ondre", "heth", "inea", "thnd", "ofer"]) for _ in range(r.randint(4, 60))) + (" vequ" + r.choice(["ta", "mo", "ssi"]) if i % 3 == 0 else "")) for i in range(600)]
    d, lab = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    out = [x for x in rows(toxicity.scored(d, lab)) if x["held_out"]]
    assert np.mean([x["predicted"] == int(x["doc_id"] % 3 == 0) for x in out]) > 0.95


# ---- the pipeline ----


def test_pipeline_stages_keep_their_promises(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["toxicity", "ngram_jaccard_join", "pii", "source_mix", "sentencepiece"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for _, stage in cp.STAGES:
        kept.append(common.materialize(stage(spark, kept[-1], sf)))
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    assert all(k.columns == docs.columns for k in kept[:-1]) and all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    texts = {r["doc_id"]: r["text"] for r in kept[1].collect()}
    assert ids[2] == {c for _, c in brute_components(texts).values()}
    for r in kept[3].collect():
        assert not pii.base_spans(r["text"])
    assert kept[4].count() == kept[5].count()
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = {r["doc_id"]: len(lib.encode(r["text"])) for r in kept[4].collect()}
    assert all(r["n_tokens"] == want[r["doc_id"]] for r in kept[5].collect())
