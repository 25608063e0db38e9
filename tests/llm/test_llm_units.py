"""Parts of the operators that need no Spark, held against brute force."""

import random
import re

import numpy as np
import public_tokenizers
import pytest

from siftwork.llm import audio, embeddings, ngram_join, pages, pieces, pii, token_files, toxicity, warc


# ---- personal data ----


def test_base_spans_equal_plain_patterns():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    r = random.Random(5)
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    for _ in range(3000):
        t = "".join(r.choice(["a", "b.", "@", "@x.de", "1", "255", "256", ".", "-", " ", "+", "4111111111111111", "4111 1111", "(", ")", "é", "%", "0"]) for _ in range(r.randint(0, 25)))
        want = [("email", *m.span()) for m in email.finditer(t)]
        want += [("ip", *m.span()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [("card", *m.span()) for m in card.finditer(t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        want += [("phone", *m.span()) for m in phone.finditer(t) if 8 <= len(digits(m[0])) <= 15]
        assert pii.base_spans(t) == want, t


@pytest.fixture(scope="module")
def field():
    return pii.train()


def test_field_learns_its_table_and_leaves_plain_prose(field):
    d = pii.Decoder(field)
    for line in pii.TRAINING:
        words, labels = pii.parse_marked(line)
        got = d.decode([" ".join(words)])[0]
        assert (list(got) or [0] * len(labels)) == labels, line
    prose = "Erou ther ntheea is, hees of annd. At the end, order 4421 of 2019 came in 3 parts at 10:30 for 12.50 each."
    path = d.decode([prose])[0]
    assert not len(path) or not pii.added_spans(prose, path, [])


def test_field_finds_unseen_forms(field):
    d = pii.Decoder(field)
    for text, kind in (("please call (323) 555-9830 today.", "phone"), ("mail jo dot kim at site dot org now", "email"), ("from 9[.]8[.]7[.]6 came", "ip"), ("pay 4111_1111_1111_1111 now", "card"), ("my password: a8Kd93kLq0 ok", "secret"), ("put client_secret=Ab3dE5fG7hJ9kL in", "secret"), ("the token = '00ffee11dd22cc33bb44aa55' stays", "secret")):
        path = d.decode([text])[0]
        assert [s[0] for s in pii.added_spans(text, path, [])] == [kind]


def test_field_leaves_codes_without_a_cue(field):
    d = pii.Decoder(field)
    for text in ("commit 1f0e3dad99908345f7439f8ffabdffc4b10b0ea1 went in", "the token of thanks was 3 coins", "box k9 and gate b7 at 10:30", "a key = value pair", "x" * 5000 + "1 " + "a1" * 5000):
        path = d.decode([text])[0]
        assert not len(path) or pii.added_spans(text, path, []) == [], text


def test_cutting_certain_words_keeps_the_best_path(field):
    class Whole(pii.Decoder):
        def certain(self, e, off):
            return np.zeros(len(e), bool)

    r = random.Random(3)
    words = ["the", "of", "at", "dot", "call", "(323)", "555-9830", "a1", "12", "x.y", "[at]", "ereth", "nd,", "Card", "4111.1111", "+"]
    texts = [" ".join(r.choice(words) if r.random() < 0.2 else "plain" for _ in range(r.randint(0, 120))) for _ in range(200)]
    a, b = pii.Decoder(field).decode(texts), Whole(field).decode(texts)
    assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


def test_viterbi_equals_enumeration(field):
    import itertools

    d = pii.Decoder(field)
    text = "call (323) 555-9830 dot"
    rows = d.number(text.split())
    e = d.emissions(rows, np.array([0, len(rows)]))
    value = lambda p: d.first[p[0]] + sum(e[i, k] for i, k in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:], strict=False))
    best = max(itertools.product(range(len(pii.LABELS)), repeat=len(rows)), key=value)
    assert list(d.decode([text])[0]) == list(best)


# ---- tokens ----


def test_chunks_encode_like_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    r = random.Random(1)
    texts = ["".join(r.choice(["  ", "   ", " ", "a", "the", "\n", "é", "日本", "x'll", "ing", " t", "😀", "\t", "0", "\x1c", "\x85", "\xa0", "\r\n", "<|endoftext|>", ".", " \n", ",,", "!?"]) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    got = token_files.ChunkEncoder(path, "<u2").encode(texts)
    assert all(np.frombuffer(g, "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids for g, t in zip(got, texts, strict=True))


def test_chunks_of_many_lines_take_few_calls(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, calls, ids = token_files.ChunkEncoder(path, "<u2"), [], token_files.ChunkEncoder.ids
    monkeypatch.setattr(token_files.ChunkEncoder, "ids", lambda self, text: calls.append(text) or ids(self, text))
    texts = [f"w{i} und \u00fcber{i}.\nNext{i} line, of{chr(97 + i % 26)}\u00e9{chr(98 + i % 23)}!\nend {i}" for i in range(1000)]
    got = encoder.encode(texts)
    assert len(calls) < 100  # 4,000 different chunks
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    assert all(np.frombuffer(g, "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids for g, t in zip(got, texts, strict=True))


@pytest.mark.parametrize("extra", [[], [("<|end", {}), ("two words", {"normalized": False})], [("<pad>", {"lstrip": True, "rstrip": True})]])
def test_added_tokens_encode_like_the_library_as_loaded(tmp_path, extra):
    from tokenizers import AddedToken, Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    if extra:
        tok.add_tokens([AddedToken(x, **how) for x, how in extra])
        tok.save(path := str(tmp_path / "t.json"))
        tok = Tokenizer.from_file(path)
    r = random.Random(2)
    texts = ["".join(r.choice(["  ", " ", "a", "the", "\n", "é", "ing", " t", "<|endoftext|>", "<|end", "<pad>", "two words", "two", ".", " \n"]) for _ in range(r.randint(0, 30))) for _ in range(1000)]
    texts += ["a <|endoftext|> b", "plain words only", ""]
    got = token_files.ChunkEncoder(path, "<u4", added=True).encode(texts)
    assert all(np.frombuffer(g, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids for g, t in zip(got, texts, strict=True))
    if not extra:
        assert np.frombuffer(got[1000], "<u4").tolist() == [64, 220, 50256, 275]


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))


def odd_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(["  ", "   ", " ", "a", "the", "▁", "\n", "é", "日本", "x", "ing", " t", "😀", "\t", "0", "tion", " ofthe"]) for _ in range(r.randint(1, 120))) for _ in range(n)]


def test_pieces_encode_like_the_library_and_decode_back(model):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for t in odd_texts(400):
        ids = np.frombuffer(model.whole(t), "<u4")
        assert ids.tolist() == lib.encode(t)
        assert model.decode(ids) == t.replace("▁", " ")


def chunked(model, text, chunk, moved=True):
    s, side = model.surface(text), 2 * model.longest
    cuts = model.cuts(s, chunk) if moved else [*range(0, len(s), chunk), len(s)]
    parts = [(min(p, side), min(p, side) + q - p, s[max(0, p - side) : q + side]) for p, q in zip(cuts[:-1], cuts[1:], strict=True)]
    mats = [pieces._matrix(pieces._flat(model.transfer(x, p, q, k == 0))) for k, (p, q, x) in enumerate(parts)]
    at = pieces.states(mats)
    return None if at is None else b"".join(model.between(x, p, q, k == 0, a, b) for k, ((p, q, x), a, b) in enumerate(zip(parts, at[:-1], at[1:], strict=True)))


@pytest.mark.parametrize("chunk", [33, 50, 200])
def test_chunks_give_the_whole_path(model, chunk):
    n = 0
    for t in ["def f(x):\n" + "        return x  +  1\n" * 40, "a  b   c " * 60, "   lead" + "  and tail  " * 30]:  # code and columns stay in the scan
        assert chunked(model, t, 4 * chunk) == model.whole(t)
    for t in [re.sub("[ ▁]+", " ", x) for x in odd_texts(60, seed=chunk)] + odd_texts(60, seed=chunk) + ["erouthetionable " * 60, "a" * 500, "noblanksatall" * 40]:
        for moved in (True, False):
            if len(t) > chunk and (got := chunked(model, t, chunk, moved)) is not None:
                n += 1
                assert got == model.whole(t)
    assert n > 5


def test_products_are_associative(model):
    s = model.surface("the theory of everything goes " * 20)
    m = [model.transfer(s, p, p + 60, p == 0) for p in (0, 60, 120)]
    assert pieces.product(pieces.product(m[0], m[1]), m[2]) == pieces.product(m[0], pieces.product(m[1], m[2]))


# ---- shingles ----


def test_sets_equal_brute_force():
    texts = [None, "", " \n", "One two", "a b c d e", "A b c d e f a b c d e f", "é É x y z w é É x y z", "x\xa0y a b c d"]
    got = ngram_join.Shingles().sets(texts)
    for t, s in zip(texts, got, strict=True):
        w = (t or "").encode().lower().split()
        want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        assert len(s) == len(want)
    assert np.array_equal(got[4], ngram_join.Shingles().sets(["A B C d E"])[0])


def test_prefixes_of_linked_sets_meet():
    r = np.random.default_rng(2)
    sketch = r.integers(0, 50, ngram_join.BUCKETS).astype(np.uint32)
    for _ in range(300):
        base = ngram_join.mix(r.integers(0, 1 << 62, int(r.integers(2, 60))).astype(np.uint64))
        other = np.unique(np.concatenate([base[r.random(len(base)) < 0.9], ngram_join.mix(r.integers(0, 1 << 62, 3).astype(np.uint64))]))
        base = np.unique(base)
        both = len(np.intersect1d(base, other))
        if 7 * both >= 3 * (len(base) + len(other)):
            assert len(np.intersect1d(ngram_join.prefix(base, sketch), ngram_join.prefix(other, sketch)))


# ---- vectors ----


def clustered(n=500, far=200, seed=4, dim=16):
    r = np.random.default_rng(seed)
    c = r.normal(size=(40, dim))
    x = np.concatenate([c[r.integers(0, 40, n)] + r.normal(size=(n, dim)) * r.choice([0.01, 0.05, 0.3], (n, 1)), r.normal(size=(far, dim))])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_dual_traversal_counts_all_links():
    x = clustered()
    one = np.ones(len(x), np.int64)
    for left, right, same, small in ((x, x, True, 256), (x, x, True, 1), (x[:350], x[350:], False, 256), (x[:350], x[350:], False, 1)):
        shift = 0 if same else len(left)
        links = embeddings.Links(len(left) if same else len(left) + len(right))
        ta = embeddings.Tree.grow(left)[0]
        tb = ta if same else embeddings.Tree.grow(right)[0]
        compared = embeddings.traverse(ta, tb, one[: len(left)], one[: len(right)], same, 0.9, links, 0, shift, small)
        want = ta.x @ tb.x.T >= 0.9
        assert np.array_equal(links.count[: len(left)], want.sum(1))
        if not same:
            assert np.array_equal(links.count[shift:], want.sum(0))
        for i, j in zip(*np.nonzero(want), strict=True):
            assert links.root(int(i)) == links.root(int(shift + j))
        assert small > 1 or compared < want.size / 4  # bounds drop or accept most pairs of clustered points


def test_cover_tree_nests_and_halves():
    for x in (clustered(), clustered(0, 300, dim=64), clustered(300, 0, dim=3)):
        t, order = embeddings.Tree.grow(x)
        assert np.array_equal(t.x, x[order]) and sorted(order) == list(range(len(x)))
        scale = {0: 2.0}
        for k in range(len(t.centre)):
            below = np.linalg.norm(t.x[t.begin[k] : t.end[k]] - t.x[t.centre[k]], axis=1)
            assert t.begin[k] <= t.centre[k] < t.end[k] and abs(below.max() - t.radius[k]) < 1e-6
            kids = range(t.first[k], t.last[k])
            if len(kids):
                assert t.centre[kids[0]] == t.centre[k]  # nested
                assert [t.begin[k], *t.end[list(kids)]] == [*t.begin[list(kids)], t.end[k]]
                half = scale[k] / 2
                while half >= t.radius[k]:
                    half /= 2
                c = t.x[t.centre[list(kids)]]
                assert all(t.radius[j] <= half + 1e-7 for j in kids)  # halved
                assert len(kids) < 2 or min(np.linalg.norm(c[i] - c[j]) for i in range(len(kids)) for j in range(i)) > half - 1e-7  # apart
                scale |= {j: half for j in kids}
            else:
                assert t.end[k] - t.begin[k] == 1 or t.radius[k] < embeddings.TINY


# ---- audio ----


def test_wav_holds_the_text():
    for t in (None, "", "a", "x" * 64, "é" * 33):
        n, media = audio.to_media(t)
        data = audio.samples_of(media)
        assert n == len((t or "").encode()) and len(data) % 64 == 0 and len(data) >= 64
        assert data[:n] == (t or "").encode() and not any(data[n:])


def test_resampling_equals_filtering_at_the_high_rate():
    x, h = np.random.default_rng(1).normal(size=257).astype("f4"), audio.low_pass(3, 4)
    up = np.zeros(len(x) * 3)
    up[::3] = x
    want = np.convolve(up, h)[len(h) // 2 :][: len(up)][::4]
    assert np.allclose(audio.resample(x), want[: -(-len(x) * 3 // 4)], atol=1e-4)


def test_resampling_keeps_a_tone():
    t = np.arange(4000) / 16000
    y = audio.resample(np.sin(2 * np.pi * 500 * t).astype("f4"))
    want = np.sin(2 * np.pi * 500 * np.arange(len(y)) / 12000)
    assert np.abs(y - want)[50:-50].max() < 0.02


def test_hysteresis_equals_a_loop():
    r = np.random.default_rng(3)
    for _ in range(50):
        db, on, want = r.normal(size=80), False, []
        for i, v in enumerate(db):
            new = True if v > 1 else False if v < 0.2 else on
            if new and not on:
                want.append([i, i])
            on = new
            if on:
                want[-1][1] = i + 1
        assert audio.hysteresis(db, 1, 0.2) == [tuple(w) for w in want]


# ---- WARC ----


def test_records_round_trip():
    import zlib

    for payload, other in ((b"", None), ("<p>é\r\n\r\n</p>".encode(), None), (b"x" * 2000, 17)):
        fields, http, got = warc.parse(warc.record(5, "http://www.a.example.com/x y?q", payload, other))
        assert fields["WARC-Type"] == ("response" if other is None else "revisit") and int(http["Content-Length"]) == len(payload)
        assert got == (payload if other is None else b"") and fields["WARC-Page-Id"] == "5"
    assert zlib.crc32(b"") == 0


def test_surt():
    assert warc.surt("http://www.A.example.com:80/x?y#z") == "com,example,a)/x?y"
    assert warc.surt("https://a.b:8080") == "b,a:8080)/"
    assert warc.surt(None) == ")/"


# ---- pages ----

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">menu</a></ul></nav>
<header>Site</header><div class="cookie-notice">cookies</div><div id=x class="post-00"><h1>Head &amp; line</h1><p>One <b>two</b>
 three<br>four<p>f&eacute;ve<script>var a="</p>"</script><ul><li>six<li>seven</ul><div class="ad">buy</div><form>f<input></form></div>
<aside>side</aside><div class="comments"><p>reader says a long thing that is longer than the article itself is, by far and more</p></div><footer>foot</footer></body></html>"""


def test_main_text_of_a_page():
    p = pages.Page(PAGE)
    assert p.text(pages.best_path(p.shares())) == "Head & line One two three four féve six seven"


def test_main_text_of_a_page_from_its_root():
    p = pages.Page(PAGE)
    assert p.main(pages.best_path(p.shares())) == "Head & line One two three four féve six seven"


@pytest.mark.parametrize("source,want", [("", ""), ("just text", "just text"), ("<p>a<p>b", "a b"), ("<article>x <nav>m</nav>y</article", "x y"), ("a < b", "a < b"), ("<p>cut <b", "cut"), ("<div hidden>no</div><p>yes", "yes"), ("<nav>m<article><p>t</p></article>", "t")])
def test_broken_pages(source, want):
    p = pages.Page(source)
    assert p.text(pages.best_path(p.shares())) == want


LEAD, BODY, MORE = "lead " * 20, "body " * 100, "more " * 60


@pytest.mark.parametrize("source,want", [
    (f"<article><h1>Title</h1><p>{LEAD}</p><div class=content>{BODY}</div></article>", f"Title {LEAD}{BODY}"),
    (f"<body><div class=wrap><h1>Title</h1><p>{LEAD}</p><div class=content>{BODY}</div></div></body>", f"Title {LEAD}{BODY}"),
    (f"<body><section class=a><p>{BODY}</section><section class=b><p>{MORE}</section></body>", BODY + MORE),
    (f"<article><p>{MORE}</p><table><tr><td>{BODY}</td></tr></table></article>", MORE + BODY),
    (f"<main><article><p>{BODY}</article><section class=b><p>{MORE}</section></main>", BODY + MORE),
    (f"<body><article><p>{LEAD}</article><div class=story><p>{BODY}</div></body>", LEAD + BODY),
    (f"<body><div class=links><a href=x>{LEAD}</a></div><div class=story><p>{BODY}<a href=y>end</a></div></body>", f"{BODY}end"),
    (f"<body><div class=top>site</div><article><p>{BODY}</article></body>", BODY),
])
def test_main_text_is_whole(source, want):
    p = pages.Page(source)
    assert p.main(pages.best_path(p.shares())) == want.strip()


# ---- toxicity ----


@pytest.mark.parametrize("source,want", [
    ("<article><p>so <math><mi>x</mi><mo>=</mo>2</math> it is</p></article>", "so x=2 it is"), ("<article><p>a</p><xmp>b <i> &amp;</xmp></article>", "a b <i> &amp;"),
    ("<article><p>a<noscript>turn it on</noscript><template>t</template></p></article>", "a"), ("<article><p>a<svg><title>no</title><text>b</text></svg></p></article>", "ab"),
])
def test_what_a_browser_shows_stays(source, want):
    p = pages.Page(source)
    assert p.main(pages.best_path(p.shares())) == want


@pytest.mark.parametrize("kind", ["<div>", "<div class=a>", "<b>", "<li>", "<select>", "<p><i>", "</b><u>", "<table><td>", "<ul><li>"])
def test_hostile_pages_take_time_and_memory_in_proportion(kind):
    import time
    import tracemalloc

    took, held = [], []
    for n in (10_000, 100_000):
        source = kind * n + "end " + "<p>words</p>" * 10
        began = time.process_time()
        page = pages.Page(source)
        page.minor()
        assert page.main(pages.best_path(page.shares())).startswith("end" if kind != "<select>" else "")
        took.append(time.process_time() - began)
        if n == 10_000:
            tracemalloc.start()
            pages.Page(source)
            held.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
    assert took[1] < 40 * took[0] + 0.5 and held[0] < 60e6


def made_page(r, words):
    """A page built piece by piece, and its main text as the pieces say, without reading the page."""
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    want = []

    def block():
        t = text(r.randint(3, 30))
        kind = r.choice(["p", "plain", "h2", "li", "bold", "link", "entity", "table"])
        want.append({"entity": f"{t} & é"}.get(kind, t))
        half = t.find(" ")
        return {"p": f"<p>{t}</p>", "plain": f"<div>{t}</div>", "h2": f"<h2>{t}</h2>", "li": f"<ul><li>{t}</li></ul>", "bold": f"<p>{t[:half]}<b>{t[half:]}</b></p>", "link": f"<p>{t[:half]} <a href='/x'>{t[half:].strip()}</a></p>", "entity": f"<p>{t} &amp; &eacute;</p>", "table": f"<table><tr><td>{t}</td></tr></table>"}[kind]

    parts, noise = [], ["<nav><ul><li><a href=/>{}</a></ul></nav>", "<div class='ad'>{}</div>", "<aside>{}</aside>", "<footer>{}</footer>", "<script>var a='<p>{}</p>'</script>", "<div class='comments'><p>{}</p></div>", "<form>{}<input></form>", "<style>{}</style>", "<!-- {} -->", "<div id='cookie-notice'>{}</div>"]
    for _ in range(r.randint(1, 12)):
        parts.append(block() if r.random() < 0.7 else f"<section class='s{r.randrange(3)}'>{block()}{block()}</section>")
        if r.random() < 0.3:
            parts.append(r.choice(noise).format(text(5)))
    around = lambda: "".join(r.choice(noise).format(text(r.randint(1, 12))) for _ in range(r.randint(0, 3)))
    body = "".join(parts)
    inner = r.choice(["<article>{}</article>", "<main><div class='body'>{}</div></main>", "<article><div><div>{}</div></div></article>"]).format(body)
    return f"<html><head><title>{text(3)}</title></head><body>{around()}{inner}{around()}</body></html>", " ".join(want)


def test_made_pages_give_their_pieces_back():
    r = random.Random(12)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    for _ in range(300):
        source, want = made_page(r, words)
        page = pages.Page(source)
        assert page.main(pages.best_path(page.shares())) == want, source


# ---- toxicity ----


def test_windows_cover_all_words():
    texts = ["", "a", " ".join(map(str, range(100)))]
    names, rows, bounds = toxicity.windows(texts)
    assert bounds.tolist() == [0, 1, 2, 8] and rows.shape == (8, toxicity.WINDOW)
    assert {names[i] for i in rows[2:].ravel() if i >= 0} == {str(i) for i in range(100)}


def test_gradients_equal_differences():
    net, (names, rows, _) = toxicity.Net(3), toxicity.windows(["a bad word here", "some fine words stand here too"])
    net.p = {k: v.astype("f8") for k, v in net.p.items()}
    words, y = toxicity.Words(names), np.array([1.0, 0.0])

    def loss():
        gates = tuple(np.concatenate([net.inputs(words).astype("f8") @ net.p[f"{s}x"] + net.p[f"{s}b"], np.zeros((1, 3 * toxicity.HIDDEN))]) for s in "lr")
        z = net.forward(gates, rows).astype("f8")
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    g = net.gradients(words, rows, y)
    for k in ("out", "att", "lh", "rx", "lb"):
        at = tuple(0 for _ in net.p[k].shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-2
        up = loss()
        net.p[k][at] = old - 1e-2
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / 2e-2 - g[k][at]) < 2e-3, k


def test_net_learns_and_holds_out():
    r = random.Random(2)
    words = ["erou", "ther", "nthea", "ofthe", "annd", "stou", "hand", "reth", "inea"]
    make = lambda bad: " ".join([r.choice(words) for _ in range(r.randint(5, 80))] + ["vequ" + r.choice(["mo", "ta", "re", "ssi"])] * bad)
    texts = [make(i % 2) for i in range(300)]
    net = toxicity.fit(texts, [i % 2 for i in range(300)], epochs=4)
    test = [make(i % 2) for i in range(100)]
    got = net.scores(test) >= 0.5
    assert (got == np.array([i % 2 for i in range(100)])).mean() > 0.97
    assert net.scores([""])[0] < 0.5


def test_net_without_both_classes():
    assert 0 <= toxicity.fit([], []).scores(["a", ""])[0] < 0.5
    assert toxicity.fit(["a"], [0]).scores(["b"])[0] < 0.5
