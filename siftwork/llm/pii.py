"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes for what they miss.

The patterns give the base spans (email, ip, card, phone). The field labels every word of every text with B/I tags of
the same kinds, of `secret` (keys and passwords, which no pattern here reaches) or O; its weights come from TRAINING, a
small labelled table, and its best paths from Viterbi steps that numpy takes for all texts of a batch at once. A decoded
run becomes a span only if a plain check of its signs holds and no base span overlaps it, so it adds spans and never
changes the base ones.

A word's features are hashes of its whole shape, its length, its signs, its ends and of the word itself. Only those
that the table has carry weights, so all others need no place.

Scale: no shuffle; a task holds one batch of texts, cut by bytes. Word potentials are kept for each distinct word of a
worker and dropped when there are too many.

Cases: null or empty texts have no spans; any other column passes through, and columns named like the results are
replaced; a text without white space is one word of any length; rows that repeat give equal results.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.llm.common import WORD, kept, slices

#: Kinds of the patterns, and those that the field adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
SPAN = "struct<kind:string,start:int,end:int>"

#: The labelled table: [kind:words] marks a span.
TRAINING = """
Write to [email:anna dot smith at mail dot example dot com] for the plan.
My address is [email:bob (at) example (dot) org] and nothing else.
You can reach us at [email:info [at] shop [dot] net] or by post.
Contact [email:j.doe at example.com] before noon.
Send it to [email:sales(at)firm.example] at once please.
mail: [email:kim[at]post[dot]example] thanks
Ask [email:tom dot jones at firm dot test] about it.
Please mail [email:pat dot reed at park dot test] now.
Then write [email:sam at lake dot example] or call.
We mail [email:ann dot wood at hill dot example] on Monday.
Mail [email:lee (at) home (dot) example] or [email:max [at] work [dot] test] today.
The host [ip:10 . 20 . 30 . 40] did not answer.
It came from [ip:192[.]168[.]7[.]21] last night.
Blocked [ip:203,0,113,9] after the scan.
Server [ip:172.16(.)4(.)9] is down.
ping [ip:8-8-8-8] was slow
Card [card:4111.1111.1111.1111] was used twice.
He paid with [card:5500/0000/0000/0004] in the shop.
visa [card:4012_8888_8888_1881] expires soon
The card number [card:3782.8224.6310.005] is old.
Call [phone:(212) 555-0101] and ask for the desk.
Our phone is [phone:555-0142-998] until Friday.
Tel. [phone:0049 30 1234567] works in the morning.
Ring me on [phone:(212) 555 0187] tonight.
phone: [phone:020 7946 0958] or visit
fax [phone:323-555-9830] is off
Call [phone:1 (415) 555-2671] now, she said.
Dial [phone:415.555.2671] for help.
password: [secret:Tr0ub4dor&3xyz] was changed
the password is [secret:q7Rk2mZp9w] for now
api_key = [secret:"9f8e7d6c5b4a39281706f5e4d3c2b1a0"] in the file
export [secret:API_KEY=Zx81kQp2Lm55Tt09Yw3b] first
secret: [secret:s3cr3t-v4lu3-0099] must stay here
secret_key = [secret:'wJ4lrX8UtnF3MI7K2MD3ENGbPx9R'] of the box
access token [secret:ya29a0Ad52N3x8bQw7] leaked out
the token: [secret:"5d41402abc4b2a76b9719d911017c592ab34cd12"] ended
token = [secret:"b1946ac92492d2347c6235b4d2611184fe12aa90"] here
Authorization: Bearer [secret:eyJ0eXAiOiJKV1Qi8x2] header
then [secret:key="A1B2C3D4E5F6G7H8J9K0"] and go on
the file has [secret:db_password=k9Xw22mPq7] in it
The order 4421 of 2019 has 3 parts and costs 12.50 today.
He scored 3-2 in 1998 and again in 2004.
Section 4.2.1 of the text says more than 100 words.
We met at noon (at the gate) and left at 5.
The sum of 10 , 20 and 30 is 60.
It is at example street, dot by dot.
Version 1.2.3 came out on 2021-03-04 at 10:30.
Pages 100-120 and 200-230 are blank.
The price was $4,500.00 in 12 towns.
A key to the door and a token of thanks are on the desk.
The password was lost and nobody knows the secret.
Copyright 2019 by the authors. All rights reserved.
Commit 9fceb02d0ae598e95dc970b74767f19372d61af8 fixed it.
Hash d41d8cd98f00b204e9800998ecf8427e and id 550e8400-e29b-41d4 are listed.
A 12 digit code 123456789012 and 42 more.
Is it 1 , 2 or 3 ? Nobody at home knows.
Item 555 of list 0142 has size 998 at most.
The file data_2020_final.tar.gz has 3 parts named a1b2 and c3d4.
Rivers bend slowly around grey hills while farmers gather late apples before winter.
Nobody expected such heavy snow, yet children laughed and built tall white towers.
Music drifted over narrow streets; lamps glowed, doors closed, voices faded softly.
Engineers measured bridges twice because earlier drawings contained several mistakes.
Bread, cheese and olives were served beside cold water during our long journey north.
Scientists publish careful results, others repeat them, so knowledge grows steadily.
Her brother painted old boats blue; their uncle preferred green, however, never red.
Most birds leave these islands in autumn, returning when warm winds blow again.
An honest judge listens first, then asks questions, and only later decides anything.
Small towns often keep markets open until dusk. Larger cities hardly ever sleep.
Wow!!! What### lovely*** colours&&& shine%%% tonight$$$ above~~~ quiet@@@ gardens???
Grüße aus München, où l'été commence déjà; mañana será otro día.
Every *second* student (or teacher) reads/writes poems - "quietly" - at night...
Room b12, gate A7 and the x86 box = one of many "quoted" words.
""".strip().splitlines()

_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_HEAD_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the patterns, by kind as listed, then start."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:  # an address has one @: look left from it for the run, right for the domain
        tail = _EMAIL_TAIL.match(text, at)
        if tail:
            begin = at
            while begin > last and text[begin - 1] in _HEAD_CHARS:
                begin -= 1
            if begin < at:
                last = tail.end()
                found.append(("email", begin, last))
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


# ---- the field ----

_RUNS = re.compile(r"[0-9]+|[^\W\d_]+")
def shape(word: str) -> str:
    """Runs of letters become x, X or Xx, runs of digits as many d as there are, D from five on; the rest stays."""

    def run(m: re.Match) -> str:
        r = m[0]
        if "0" <= r[0] <= "9":
            return "D" if len(r) > 4 else "d" * len(r)
        return "x" if r.islower() else "X" if r.isupper() else "Xx"

    return _RUNS.sub(run, word)


def plain_word(word: str) -> str:
    return word.lower().strip(".,:;!?")


def digest_of(name: str) -> int:
    """The hash of a feature's name, the same in any worker."""
    return xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass"))


def signs(word: str) -> str:
    """All that the features of a word besides its identity depend on: its shape and, if digits are in it, the power of two of its length."""
    s = shape(word)
    return f"{len(word).bit_length() if 'd' in s or 'D' in s else 0} {s}"


def features(key: str, word: str) -> list[int]:
    """Hashes of the features of a word with signs `key` and plain form `word` ('' for one that no feature names)."""
    size, s = key.split(" ", 1)
    mixed = sum(a in "dD" and b in "xX" for a, b in zip(s, s[1:], strict=False))  # digits before letters
    names = ["s" + s, "w" + word, f"d{min(4, s.count('d') + s.count('D'))}", "p" + "".join(sorted({c for c in s if c not in "xXdDu"})), "e" + s[-1:], "b" + s[:1], f"l{size}", f"m{size if mixed > 1 else mixed}"]
    return [digest_of(n) for n in names]


def parse_marked(line: str) -> tuple[list[str], list[int]]:
    """Words and label numbers of a line of TRAINING."""
    words, labels = [], []
    for m in re.finditer(r"\[(email|ip|card|phone|secret):((?:[^\[\]]|\[[^\[\]:]*\])*)\]([.,;!?]?)|([^\x20]+)", line):
        if m[4]:
            words.append(m[4])
            labels.append(0)
        else:
            inside = (m[2] + (m[3] or "")).split()
            words += inside
            labels += [1 + 2 * KINDS.index(m[1]) + (i > 0) for i in range(len(inside))]
    return words, labels


_DOT = r"(?:\.|\s*[(\[]dot[)\]]\s*|\s+dot\s+)"
_SPELT = re.compile(rf"(?i)[\w+-]+(?:{_DOT}[\w+-]+)*(?:\s*[(\[]at[)\]]\s*|\s+at\s+|@)[\w-]+(?:{_DOT}[\w-]+)+")


class Field:
    """Weights: unary (before, at, after) by row, the rows of feature hashes, and transitions; illegal I tags never follow.

    Row 0 is that of all features without weights, row 1 of a position outside the text.
    """

    def __init__(self, rows: dict[int, int], unary: np.ndarray, move: np.ndarray):
        self.rows, self.unary, self.move = rows, unary, move

    def token(self) -> str:
        return hashlib.sha256(self.unary.tobytes() + self.move.tobytes()).hexdigest()


def _illegal() -> np.ndarray:
    k = len(LABELS)
    bad = np.zeros((k, k))
    for a in range(k):
        for b in range(2, k, 2):
            if a not in (b, b - 1):
                bad[a, b] = -1e4
    return bad


def train(lines: list[str] = TRAINING, epochs: int = 160, rate: float = 0.08, decay: float = 5e-4) -> Field:
    """Maximum likelihood by Adam; forward and backward passes over all lines at once. Same lines, same weights."""
    k, table = len(LABELS), [parse_marked(x) for x in lines]
    n, t = len(table), max(len(w) for w, _ in table)
    often = Counter(plain_word(w) for words, _ in table for w in words)
    rows: dict[int, int] = {}
    feats = np.full((n, t + 2, 8), 1)
    gold, mask = np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (words, labels) in enumerate(table):
        for j, w in enumerate(words):
            word = plain_word(w)
            hashes = features(signs(w), word)
            if often[word] < 2:  # what a word seen once says must come from its shape and its neighbours
                hashes[1] = digest_of("w")
            feats[i, j + 1] = [rows.setdefault(h, 2 + len(rows)) for h in hashes]
        gold[i, : len(words)], mask[i, : len(words)] = labels, True
    unary, move, bad = np.zeros((3, 2 + len(rows), k)), np.zeros((k, k)), _illegal()
    m = [np.zeros_like(unary), np.zeros_like(move)]
    v = [np.zeros_like(unary), np.zeros_like(move)]
    onehot = np.eye(k)[gold] * mask[..., None]
    lse = lambda x, axis: (top := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis))
    for step in range(1, epochs + 1):
        e = sum(unary[c][feats[:, c : c + t]].sum(2) for c in range(3))
        tr = move + bad
        first = np.where(np.arange(k) % 2 == 0, np.where(np.arange(k) == 0, 0, -1e4), 0.0)
        alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
        alpha[:, 0] = e[:, 0] + first
        for j in range(1, t):
            a = lse(alpha[:, j - 1, :, None] + tr, 1) + e[:, j]
            alpha[:, j] = np.where(mask[:, j, None], a, alpha[:, j - 1])
        for j in range(t - 2, -1, -1):
            b = lse(tr + (e[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
            beta[:, j] = np.where(mask[:, j + 1, None], b, 0)
        z = lse(alpha[:, -1], 1)
        p = np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * mask[..., None]
        diff = p - onehot
        grad = np.zeros_like(unary)
        for c in range(3):
            np.add.at(grad[c], feats[:, c : c + t], diff[:, :, None, :])
        pair = np.exp(np.minimum(alpha[:, :-1, :, None] + tr + (e + beta)[:, 1:, None, :] - z[:, None, None, None], 0)) * mask[:, 1:, None, None]
        gm = pair.sum((0, 1)) - np.einsum("ija,ijb->ab", onehot[:, :-1] * mask[:, 1:, None], onehot[:, 1:])
        for i, (w, g) in enumerate(((unary, grad + decay * unary * n), (move, gm + decay * move * n))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            w -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Field(rows, unary.astype("f4"), (move + bad).astype("f4"))


class Decoder:
    """Best label paths of many word sequences at once."""

    #: Distinct words whose potentials a worker keeps.
    CACHE = 1 << 18

    def __init__(self, field: Field):
        self.field, k = field, len(LABELS)
        self.index: dict[str, int] = {}
        self.keys: dict[tuple[str, str], int] = {}
        self.table = np.zeros((1024, 3, k), "f4")
        self.edge = field.unary[:, 1] * 8  # a position outside counts like a word of that row's features
        self.first = np.where((np.arange(k) % 2 == 0) & (np.arange(k) > 0), -1e4, 0).astype("f4")

    def number(self, words: list[str]) -> np.ndarray:
        """The rows of the words in the table of potentials."""
        index, keys, known = self.index, self.keys, self.field.rows
        for w in {*words}.difference(index):
            plain = plain_word(w)
            if digest_of("w" + plain) not in known:
                plain = ""
            key = ("0 x" if w.islower() and w.isalpha() else signs(w), plain)
            if (row := keys.get(key)) is None:
                row = keys[key] = len(keys)
                if row == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[row] = self.field.unary[:, [known.get(h, 0) for h in features(*key)]].sum(1)
            index[w] = row
        return np.fromiter(map(index.__getitem__, words), np.int32, len(words))

    def emissions(self, rows: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(words, labels) potentials of texts laid end to end, off their bounds."""
        e = self.table[rows, 1]
        if len(rows):
            heads, tails = off[:-1][off[:-1] < off[1:]], off[1:][off[:-1] < off[1:]] - 1
            before, after = self.table[np.roll(rows, 1), 0], self.table[np.roll(rows, -1), 2]
            before[heads], after[tails] = self.edge[0], self.edge[2]
            e += before
            e += after
        return e

    def certain(self, e: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Words that every best path labels O.

        A run of words with other labels gains over O at most what its words gain each at best, with the best legal move between
        them, the best one into it and the best one out of it. A word that stands only in runs whose bound is below 0 (the best run
        around it is the best one that ends at it and the best one that begins at it) is O, as O in place of the run would be
        better; so paths on either side of it don't depend on each other.
        """
        if not len(e):
            return np.zeros(0, bool)
        move = self.field.move - self.field.move[0, 0]
        into, out, inside = max(0.0, float(move[0, 1::2].max())), max(0.0, float(move[1:, 0].max())), float(move[1:, 1:].max())
        gain = (e[:, 1:].max(1) - e[:, 0]).astype("f8") + inside
        at = np.arange(len(e)) + np.repeat(np.arange(len(off) - 1), np.diff(off))  # a wall stands behind each text
        walled = np.full(len(e) + len(off) - 1, -1e5)
        walled[at] = gain
        left = np.concatenate([[0.0], np.cumsum(walled)])
        right = np.concatenate([[0.0], np.cumsum(walled[::-1])])
        ending = (left[1:] - np.minimum.accumulate(left)[:-1])[at]
        beginning = (right[1:] - np.minimum.accumulate(right)[:-1])[::-1][at]
        return ending + beginning - gain + into + out - inside < -1e-3

    def decode(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the labels of its words; empty where all are O."""
        if max(len(self.index), len(self.keys)) > self.CACHE:
            self.keys.clear()
            self.index.clear()
        find = re.compile(WORD).findall
        seqs = [self.number(find(x)) for x in texts]
        off = np.concatenate([[0], np.cumsum([len(x) for x in seqs])]).astype(np.int64)
        empty = np.zeros(0, np.int8)
        path = np.zeros(int(off[-1]), np.int8)
        if not len(path):
            return [empty] * len(texts)
        rows = np.concatenate(seqs)
        e = self.emissions(rows, off)
        sure = self.certain(e, off)
        head = np.zeros(len(path) + 1, bool)
        head[off] = True
        left = ~sure
        begins = np.flatnonzero(left & (head[:-1] | np.append(True, sure[:-1])))
        ends = np.flatnonzero(left & (head[1:] | np.append(sure[1:], True))) + 1
        order = np.argsort(begins - ends, kind="stable")
        begins, ends = begins[order], ends[order]
        self.best_paths(e, begins, ends, head, path)
        hit = np.add.reduceat(np.append(path, 0), off[:-1]) if len(off) > 1 else []
        return [path[a:b] if a < b and h else empty for a, b, h in zip(off[:-1], off[1:], hit, strict=True)]

    def best_paths(self, e: np.ndarray, begins: np.ndarray, ends: np.ndarray, head: np.ndarray, path: np.ndarray) -> None:
        """Viterbi over the stretches [begins, ends), longest first, all together; O stands beyond an end inside a text."""
        if not len(begins):
            return
        move, lengths = self.field.move, ends - begins
        back = np.zeros(e.shape, np.int8)
        best = e[begins] + np.where(head[begins][:, None], self.first, move[0])
        into = np.ascontiguousarray(move.T)
        for j in range(1, int(lengths[0])):
            n = int(np.searchsorted(-lengths, -j, "left"))
            at = begins[:n] + j
            cand = best[:n, None, :] + into
            arg = cand.argmax(2)
            back[at] = arg
            b = cand.max(2)
            b += e[at]
            best[:n] = b - b.max(1, keepdims=True)
        state = (best + np.where(head[ends][:, None], 0, move[:, 0])).argmax(1)
        for j in range(int(lengths[0]) - 1, -1, -1):
            n = int(np.searchsorted(-lengths, -j, "left"))
            at = begins[:n] + j
            path[at] = state[:n]
            state[:n] = back[at, state[:n]]


def _holds(kind: str, s: str) -> bool:
    d = _digits(s)
    if kind == "phone":
        return 7 <= len(d) <= 15 and not re.search(r"[A-Za-z]", s)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and not re.search(r"[A-Za-z]", s)
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts) and not re.search(r"[A-Za-z]", s)
    if kind == "secret":
        return len(s) >= 8 and not re.search(r"\s", s) and bool(re.search(r"[0-9]", s)) and bool(re.search(r"[A-Za-z]", s))
    return bool(_SPELT.fullmatch(s))


def added_spans(text: str, path: np.ndarray, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The decoded runs that hold and meet no base span."""
    places = [m.span() for m in re.finditer(WORD, text)]
    hit = np.flatnonzero(path)
    taken, out, i = sorted((b, e) for _, b, e in base), [], 0
    reach = [*accumulate((e for _, e in taken), max)]  # the farthest end of the spans up to each
    while i < len(hit):
        j = i
        while j + 1 < len(hit) and hit[j + 1] == hit[j] + 1 and path[hit[j + 1]] % 2 == 0:
            j += 1
        begin, end, kind = places[hit[i]][0], places[hit[j]][1], KINDS[(int(path[hit[i]]) - 1) // 2]
        while begin < end and text[begin] in "\"'<,;:.!?":
            begin += 1
        while end > begin and text[end - 1] in "\"'>,;:.!?":
            end -= 1
        if kind == "secret" and (cut := text.rfind("=", begin, end - 1)) >= 0 and re.fullmatch(r"[A-Za-z_.-]+", text[begin:cut]):
            begin = cut + 1  # a name and its value in one word
            while begin < end and text[begin] in "\"'":
                begin += 1
        at = bisect_left(taken, (end, -1))
        if begin < end and _holds(kind, text[begin:end]) and not (at and reach[at - 1] > begin):
            out.append((kind, begin, end))
        i = j + 1
    return out


def _scan(batch: pa.RecordBatch, decoder: Decoder) -> tuple[list[str], list, list]:
    texts = [x or "" for x in batch.column("text").to_pylist()]
    base = [base_spans(x) for x in texts]
    paths = decoder.decode(texts)
    spans = [sorted(b + added_spans(x, p, b), key=lambda s: (KINDS.index(s[0]), s[1])) if len(p) else b for x, p, b in zip(texts, paths, base, strict=True)]
    return texts, base, spans


@functools.cache
def trained() -> Field:
    """The field of TRAINING, once in a driver's life."""
    return train()


def find_spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), field: Field | None = None) -> DataFrame:
    """The columns `keep` of docs, base_spans and spans (arrays of kind, start, end in code points, end exclusive)."""
    field = field or trained()
    token = ("pii", field.token())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, name = kept(token, lambda: Decoder(field)), ("kind", "start", "end")
        for batch in slices(batches, "text", 8 << 20):
            _, base, spans = _scan(batch, decoder)
            cols = [pa.array([[dict(zip(name, s, strict=True)) for s in row] for row in x], kind) for x in (base, spans)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *cols], [*keep, "base_spans", "spans"])

    used = docs.select(*(c for c in keep if c != "text"), F.col("text").cast("string").alias("text"))
    fields = [f"`{c}` {used.schema[c].dataType.simpleString()}" for c in keep]
    return used.mapInArrow(scan, ", ".join([*fields, f"base_spans array<{SPAN}>", f"spans array<{SPAN}>"]))


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with every span replaced by <KIND>, overlapping spans by the first; n_chars, if there, counts anew."""
    field = field or trained()
    token = ("pii", field.token())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = kept(token, lambda: Decoder(field))
        for batch in slices(batches, "text", 8 << 20):
            texts, _, spans = _scan(batch, decoder)
            out = []
            for old, text, found in zip(batch.column("text"), texts, spans, strict=True):
                parts, at = [], 0
                for kind, b, e in sorted(found, key=lambda s: (s[1], s[2])):
                    if b >= at:
                        parts += [text[at:b], f"<{kind.upper()}>"]
                        at = e
                    else:
                        at = max(at, e)
                out.append("".join([*parts, text[at:]]) if old.is_valid else None)
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, batch.schema.field(i).name, pa.array(out, batch.schema.field(i).type))

    done = docs.mapInArrow(scan, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return done


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Of find_spans: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    n = [count(k) for k in BASE]
    return found.select("doc_id", *n, F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))
