"""Main text of web pages by consensus of their host.

Pass one scores the containers of each page: every paragraph gives its text, less the text of links, to the element
around it and half of that to the next one. Containers are named by generalised paths (tag and first class of every
container from the root, digits as 0), kept as 64-bit hashes, and each page votes for its paths with their shares of the page. Spark sums the votes by host and
path and takes each host's winner, and finds the containers that a host repeats: outside article and main, at most
MINOR thousandths of a page, with one and the same text on more than half of the host's pages (three at least).

Pass two takes the winner (the page's own best where the page has not that path) and climbs from it. Where the outermost
article and main elements hold NEARLY all of the page's text, they are the main text, with all that is in them.
Otherwise it is the whole page, less the containers that the host repeats (never the winner, or what is in or around it)
and less blocks outside the winner that are links for the most part.

Scale: votes and counts are sums with map-side combine, so a host may own any share of the pages. The winners, one short
row for each host, are written first: Spark then knows their size and sends them to all tasks if they are below its
broadcast threshold, and otherwise joins by shuffle with its skew handling.

Cases: null and empty html give empty text; a null url is the host ''; text outside any element counts; unclosed and
crossed elements close at the next element that ends them; repeated rows give repeated results; other columns are ignored.
Time and memory of a page are in proportion to its length, whatever its nesting. What a browser does not show as text of
the page is no text: scripts, styles, templates, noscript and what stands in place of frames, objects and media; formulas,
drawings' text and xmp are text.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.llm.common import materialize, slices

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
RAW = frozenset("script style textarea title noscript template iframe noembed noframes object canvas audio video select".split())
DROP = frozenset("nav footer aside form button dialog menu head header fieldset datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article body center div html main section table tbody td tr".split())
CLOSES_P = BLOCK - {"br", "html", "body", "head", "option", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
_STOPS = tuple({"ul", "ol", "table", "dl", "select"} | (CONTAINER - {"tr", "td", "tbody"}))
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Class, id or role words of what is not the article.
NOT_MAIN = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsbygoogle|sponsor(?:ed|s)?|promo(?:tion)?s?|banners?|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter|subscribe|subscription|comments?|commentlist|disqus|respond|repl(?:y|ies)|sidebars?|aside|menus?|nav|navbar|navigation|breadcrumbs?|footers?|headers?|masthead|topbar|share|sharing|social|related|recommend(?:ed|ations?)?|widgets?|pagination|pager|toolbar|login|signup|search|skip|paywall|complementary|contentinfo|reader-comments|discussion)(?:$|[\s_-])")
#: Thousandths of a page's text that a repeated container holds at most, and that article and main hold at least if they are all.
MINOR, NEARLY = 100, 900
_DIGITS = re.compile(r"[0-9]+")
_SPACE = re.compile(r"\s+")


class Page:
    """Elements and text runs of one page, without what is never main text."""

    def __init__(self, source: str):
        #: of each element: the element around it, the hash of its container's path, its tag, its container
        self.parent, self.path, self.tag, self.box = [-1], [0], [""], [0]
        #: (element, text, in a link?); an element of -1 is a block edge
        self.runs: list[tuple[int, str, bool]] = []
        self.read(source)

    def attributes(self, text: str) -> dict[str, str]:
        return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}

    def read(self, source: str) -> None:
        stack, dropped, links, at, runs = [0], 0, 0, 0, self.runs
        names, boxes, endless = [""], [], set()
        where: dict[str, list[int]] = defaultdict(list)  # the depths at which a tag is open

        def close(depth: int) -> None:
            nonlocal dropped, links
            while len(stack) > depth:
                stack.pop()
                name = names.pop()
                where[name].pop()
                if name in CONTAINER:
                    boxes.pop()
                links -= name == "a"
            if dropped >= len(stack) + 1:
                dropped = 0

        def deepest(tags) -> int:
            return max((where[t][-1] for t in tags if where.get(t)), default=0)

        n = len(source)
        while at < n:
            i = source.find("<", at)
            if i < 0:
                i = n
            if i > at and not dropped:
                runs.append((stack[-1], source[at:i], links > 0))
            if i == n:
                break
            nxt = source[i + 1 : i + 2]
            if source.startswith("<!--", i):
                j = source.find("-->", i + 4)
                at = n if j < 0 else j + 3
                continue
            if nxt in ("!", "?"):
                j = source.find(">", i)
                at = n if j < 0 else j + 1
                continue
            m = _TAG.match(source, i) or _LOOSE.match(source, i)
            if not m:
                if nxt == "/" or nxt.isalpha():  # a tag that the page's end cuts
                    if source.find(">", i) < 0:
                        break
                if not dropped:
                    runs.append((stack[-1], "<", links > 0))
                at = i + 1
                continue
            at, tag = m.end(), m[2].lower()
            if tag in BLOCK and not dropped:
                runs.append((-1, "", False))
            if m[1]:
                if where.get(tag):
                    depth = where[tag][-1]
                    # an inline or list end does not close the container around it
                    if tag in CONTAINER or tag in DROP or not (boxes and boxes[-1] > depth):
                        close(depth)
                continue
            if tag in RAW or tag == "xmp":
                if not m[3].endswith("/"):
                    end = None if tag in endless else re.compile(rf"(?i)</{re.escape(tag)}\b[^>]*>").search(source, at)
                    if tag == "xmp" and not dropped:
                        runs.append((stack[-1], source[at : end.start() if end else n].replace("&", "&amp;"), links > 0))
                    if end is None:
                        endless.add(tag)
                    at = end.end() if end else n if tag in ("script", "style", "xmp") else at
                continue
            if tag in VOID or m[3].endswith("/"):
                continue
            if tag in ("article", "main", "body") and dropped:  # what was left open ends here
                close(dropped - 1)
                runs.append((-1, "", False))
            if tag in CLOSES_P and where.get("p"):
                depth = where["p"][-1]
                if not (boxes and boxes[-1] > depth):
                    close(depth)
            if tag in SAME and (depth := deepest(SAME[tag])) > deepest(_STOPS):
                close(depth)
            attrs = self.attributes(m[3]) if m[3].strip() else {}
            around, number = stack[-1], len(self.parent)
            self.parent.append(around)
            if tag in CONTAINER:
                first = attrs.get("class", "").split()
                label = tag + (f".{_DIGITS.sub('0', first[0].lower())}" if first else "")
                self.path.append(step(self.path[around], label))
                self.box.append(number)
                boxes.append(len(names))
            else:
                self.path.append(self.path[around])
                self.box.append(self.box[around])
            self.tag.append(tag)
            where[tag].append(len(names))
            stack.append(number)
            names.append(tag)
            links += tag == "a"
            if not dropped:
                bad = tag in DROP and not (tag == "header" and (where.get("article") or where.get("main")))
                if not bad and tag not in ("html", "body", "article", "main"):
                    said = f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}"
                    bad = bool(said.strip() and NOT_MAIN.search(said)) or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
                if bad:
                    dropped = len(stack)

    def shares(self) -> dict[int, int]:
        """Path -> thousandths of the page's text that its paragraphs give to it."""
        points: dict[int, float] = defaultdict(float)
        total = 0
        for node, text, link in self.runs:
            if node >= 0 and not link and (n := len(text.strip())):
                near = self.box[node]
                points[self.path[near]] += n
                total += n
                if near > 0:
                    points[self.path[self.box[self.parent[near]]]] += n / 2
        return {p: round(1000 * v / total) for p, v in points.items()} if total else {}

    def articles(self) -> list[bool]:
        """For each element, whether it is or stands in an article or main."""
        inside = [False]
        for i in range(1, len(self.parent)):  # parents first, so no deep recursion
            inside.append(inside[self.parent[i]] or self.tag[i] in ("article", "main"))
        return inside

    def minor(self) -> dict[int, int]:
        """Path -> checksum of the text, of containers outside article and main that hold little of the page's text."""
        n = len(self.parent)
        held, marks, total, inside = [0] * n, [0] * n, 0, self.articles()
        for node, text, link in self.runs:
            if node >= 0 and (t := text.strip()):
                marks[node] += zlib.crc32(t.encode("utf-8", "surrogatepass")) | 1 << 32
                if not link:
                    held[node] += len(t)
                    total += len(t)
        by_path: dict[int, int] = defaultdict(int)
        sums: dict[int, int] = defaultdict(int)
        for i in range(n - 1, 0, -1):  # children first
            held[self.parent[i]] += held[i]
            marks[self.parent[i]] += marks[i]
            if self.tag[i] in CONTAINER:
                by_path[self.path[i]] += held[i]
                sums[self.path[i]] += marks[i]
        apart = {self.path[i] for i in range(1, n) if inside[i]}
        return {p: v & (1 << 62) - 1 for p, v in sums.items() if v and by_path[p] * 1000 <= MINOR * total and p not in apart}

    def text(self, path: int) -> str:
        """Text inside the elements of a path: blocks in page order, each trimmed with single spaces."""
        return self.blocks(self.within(path), [False] * len(self.parent))

    def main(self, path: int, repeated: frozenset[int] = frozenset()) -> str:
        """All main text of the page, from the elements of `path` up, without the containers that the host repeats."""
        sure = self.within(path)
        articles, kept = self.articles(), [True]
        over = [p == path for p in self.path]  # elements with one of `path` in them
        for i in range(len(over) - 1, 0, -1):
            over[self.parent[i]] |= over[i]
        above = {p for p, x in zip(self.path, over, strict=True) if x}
        for i in range(1, len(self.parent)):
            p = self.path[i]
            spared = sure[i] or articles[i] or p not in repeated or p in above
            kept.append(sure[i] or articles[i] or (kept[self.parent[i]] and spared))
        sizes = [(node, len(text.strip())) for node, text, link in self.runs if node >= 0 and not link]
        total = sum(n for i, n in sizes if kept[i])
        if total and sum(n for i, n in sizes if articles[i]) * 1000 >= NEARLY * total:
            return self.blocks(articles, [False] * len(self.parent))
        sure = [a or b for a, b in zip(sure, articles, strict=True)]
        return self.blocks(sure, [k and not x for k, x in zip(kept, sure, strict=True)])

    def within(self, path: int) -> list[bool]:
        inside: list[bool] = []
        for i in range(len(self.parent)):  # parents first, so no deep recursion
            inside.append(self.path[i] == path or (i > 0 and inside[self.parent[i]]))
        return inside

    def blocks(self, inside: list[bool], around: list[bool]) -> str:
        """Text of elements in `inside`, and of those in `around` but for blocks that are links for the most part."""
        out, part = [], []
        for node, text, link in [*self.runs, (-1, "", False)]:
            if node >= 0:
                if inside[node] or around[node]:
                    part.append((text, link, inside[node]))
            elif part:
                words = sum(len(t.strip()) for t, link, _ in part if not link)
                if any(sure and t.strip() for t, _, sure in part) or words * 2 >= sum(len(t.strip()) for t, _, _ in part):
                    out.append("".join(t for t, _, _ in part))
                part = []
        cleaned = (_SPACE.sub(" ", entities.unescape(b)).strip() for b in out)
        return " ".join(b for b in cleaned if b)


def best_path(shares: dict[int, int]) -> int:
    return max(shares, key=lambda p: (shares[p], p)) if shares else 0


def step(around: int, label: str) -> int:
    """The hash of a path from that of the path around it; 0 is the root's."""
    return int.from_bytes(hashlib.blake2b(label.encode("utf-8", "surrogatepass"), digest_size=8, key=around.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


def path_of(labels: str) -> int:
    """The hash of a path like html/body/div.main."""
    path = 0
    for label in labels.split("/") if labels else []:
        path = step(path, label)
    return path


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def winners(pages: DataFrame) -> DataFrame:
    """(host, path, repeated): the container path that the pages of each host vote for, and those that they repeat."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            #: (host, path, mark) -> votes, pages; a path without a mark has the votes, one with a mark (its text) the
            #: pages where it is minor, and no path the pages of the host
            sums: dict[tuple[str, int | None, int | None], list[int]] = defaultdict(lambda: [0, 0])
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = Page(source or "")
                shares = page.shares()
                for path, share in shares.items():
                    sums[host, path, None][0] += share
                if shares:
                    sums[host, None, None][1] += 1
                    for path, mark in page.minor().items():
                        sums[host, path, mark][1] += 1
            keys = [pa.array([k[i] for k in sums], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array([v[i] for v in sums.values()], pa.int64()) for i in (0, 1))], ["host", "path", "mark", "votes", "n"])

    used = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    summed = used.mapInArrow(vote, "host string, path long, mark long, votes long, n long").groupBy("host", "path", "mark").agg(F.sum("votes").alias("votes"), F.sum("n").alias("n"))
    summed = materialize(summed.where("mark is null or n > 2"))
    totals = summed.where("path is null").select("host", F.col("n").alias("pages"))
    often = summed.where("mark is not null").join(totals, "host").where("n * 2 > pages").groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("repeated"))
    best = summed.where("path is not null and mark is null").groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))
    return materialize(best.join(often, "host", "left"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = []
            for path, repeated, source in zip(*(batch.column(c).to_pylist() for c in ("path", "repeated", "html")), strict=True):
                page = Page(source or "")
                use = path if path is not None and path in page.path else best_path(page.shares())
                texts.append(page.main(use, frozenset(repeated or ())))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    used = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    found = used.join(winners(pages), "host", "left").select("page_id", "url", "path", "repeated", "html")
    return found.mapInArrow(run, T.StructType([T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("url", pages.schema["url"].dataType), T.StructField("text", T.StringType())]))


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
