"""Main text of web pages by consensus of a host's pages.

1. Each page's containers are scored: a block of text gives its plain (unlinked) characters to the container that holds it and half of
   them to the next one up. The best container is named by its path of generalised ``tag.class`` steps (no digits, no ids).
2. In Spark, the pages of a host vote for paths; those with at least ``WINNER_SHARE`` of the votes win.
3. The same pages vote on what stands inside the article but isn't of it: a block belongs to the innermost container with a class around it, and where at least ``REPEATED`` different
   pages, and two thirds of those that have a path, hold the same text of its own there, that text is noise on that host, whatever the name. They vote too on single blocks beside the winner (below).
4. Each page is extracted again from its most voted winning path that it has, without the host's noise; a page with none uses its own best container.

What stands directly in the container around the winner, titles and leads, belongs to the article, and so on up to the ``article`` or ``main`` around it or two
steps; not if it is mostly links, nor if it is the same on at least ``REPEATED`` different pages of the host and half of those that have something there, nor in ``body``.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out, by tag, role or class,
inside the article and inside a paragraph too. A class or id names noise if each of its parts is a noise word or a word of layout, and one a noise word; if its last part that isn't
layout is the name of a part of a page, whatever stands before it (``reader-comments``, ``cookie-policy-banner``); or if some part can only be an advert's (``sponsored-post``).
``banner-story`` and ``share-prices`` don't. A ``header`` inside an ``article`` or ``main`` belongs to the article.
Character references are decoded; white space inside a block becomes one space; blocks are joined in page order by one space.

Pages are read once from left to right, in time and memory that grow with their length, whatever they hold. From a tag whose quotes never end, quotes
count for nothing in the rest of the page; a tag that never ends is text.

Null and empty html gives the empty text. Pages without host vote together as one host. Containers of equal score: the one nearest the root, then the first
by name; paths of equal votes: the first by name. Repeated rows get equal results. An empty table gives an empty one. All columns but ``text`` pass through.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import arrow_rows, forget, materialise
from .url_filter import split_url

#: Share of a host's votes that makes a path a winner.
WINNER_SHARE = 0.2
#: Winning paths of one host; shares sum to 1.
MAX_WINNERS = 5
#: Different pages of a host that make a text the host's.
REPEATED = 3

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
DROPPED = frozenset("head nav footer aside form button select menu dialog iframe object audio video canvas map datalist fieldset optgroup option".split())
CONTAINERS = frozenset("html body div section article main td center blockquote details".split())
#: What an opening tag closes if it is open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Where that stops.
SCOPES = frozenset("ul ol dl table html body div section article main nav aside header footer form".split())
#: Class or id words of what isn't the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion banner menu nav navbar navigation topnav breadcrumb breadcrumbs sidebar aside rail footer foot header masthead topbar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login comment comments commentlist respond reply replies disqus share sharing social related recommended widget pagination pager search form skip".split()
)
#: Words of layout that name no content.
LAYOUT = frozenset("area bar block box button buttons col column container content div frame global header holder icon icons inner item items left link links list main outer page panel right row section site slot small space text title top bottom unit user widget widgets wrap wrapper zone x y l r".split())
#: Names of parts of a page that stay what they are after any other word.
HEADS = frozenset("banner nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside comment comments commentlist reply replies respond disqus share sharing social related recommended newsletter subscribe signup login pagination pager popup modal consent".split())
#: Words that only adverts have.
ADVERT = frozenset("ad ads adv advert adverts advertisement advertisements advertorial adsense sponsor sponsors sponsored sponsorship promo promos promoted".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

#: Elements whose content isn't markup.
RAW = frozenset("script style title noscript template textarea svg math".split())
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[\"'>]")
_CLOSE = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def is_noise(name: str) -> bool:
    """Whether a class or id names what isn't the article."""
    parts = _PART.findall(_CAMEL.sub(" ", name).lower())
    named = [p for p in parts if p not in LAYOUT]
    return bool(named) and (named[-1] in HEADS or any(p in ADVERT for p in named) or (any(p in NOISE for p in named) and all(p in NOISE for p in named)))


def _step(tag: str, attributes: str) -> tuple[str, bool]:
    """Generalised ``tag.class`` of an element, and whether it is noise."""
    name, noise, seen = "", False, set()
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key in seen:  # the first counts
            continue
        seen.add(key)
        if key == "class":
            words = sorted({re.sub(r"\d+", "", w).strip("-_") for w in value.lower().split()} - {""})
            name = ".".join(words)
        if key in ("class", "id"):
            noise |= any(is_noise(w) for w in value.split())
        noise |= key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower()
    return (f"{tag}.{name}" if name else tag), noise


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(text, tag, attributes): the text before each tag, the tag (``/`` in front of a closing one) and its attributes; the last text has no tag."""
    text, at, size = 0, 0, len(page)  # where the text began that is still to be given, and where to look on
    last = page.rfind(">")
    quotes = True
    while at <= last and (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            yield page[text:at], "", ""
            text = at = end + 3 if end >= 0 else size
            continue
        m = _NAME.match(page, at + 1)
        if at > last:
            break
        if not m:
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                end = page.find(">", at)
                yield page[text:at], "", ""
                text = at = end + 1
            else:
                at += 1
            continue
        end = -1
        if quotes:
            look = m.end()
            while stop := _STOP.search(page, look):
                if stop.group() == ">":
                    end = stop.start()
                    break
                look = page.find(stop.group(), stop.end()) + 1
                if not look:
                    break
            quotes = end >= 0
        if end < 0:
            end = page.find(">", m.end())
        name = m.group(1).lower()
        closing = page[at + 1] == "/"
        yield page[text:at], f"/{name}" if closing else name, page[m.end() : end]
        text = at = end + 1
        if name in RAW and not closing:
            done = _CLOSE[name].search(page, at)
            text = at = done.end() if done else size
    if page.startswith("<!--", at) and at >= text:  # a comment that never ends
        yield page[text:at], "", ""
        return
    rest = page.find("<!--", max(at, 0)) if at >= 0 else -1
    yield page[text : rest if rest >= 0 else size], "", ""


class Page:
    """Blocks of a page outside noise, in page order: container, text, unlinked characters. Containers are numbers; a parent's is smaller than its children's."""

    def __init__(self, page: str) -> None:
        self.blocks: list[tuple[int, str, int]] = []
        self.up, self.steps, self.depth = [-1], [""], [0]  # of each container; 0 is the page
        self.known: dict[tuple[int, str], int] = {}
        self._stack: list[tuple[str, int, bool]] = []  # tag, container, noise
        self._open: dict[str, list[int]] = {}  # places on the stack of each tag
        self._scopes: list[int] = []
        self._inline: list[tuple[str, bool]] = []
        self._inline_open: dict[str, int] = {}
        self._hidden = self._links = 0
        self._pieces: list[str] = []
        self._linked = 0
        self._read(page)

    def _flush(self) -> None:
        """The end of a block; inline elements end with it."""
        if self._pieces:
            text = " ".join("".join(self._pieces).split())
            if text:
                self.blocks.append((self._stack[-1][1] if self._stack else 0, text, max(0, len(text) - self._linked)))
            self._pieces.clear()
        if self._inline:
            self._inline.clear()
            self._inline_open.clear()
        self._linked = self._hidden = self._links = 0

    def _cut(self, at: int) -> None:
        """Close the elements from place ``at`` of the stack."""
        while len(self._stack) > at:
            tag = self._stack.pop()[0]
            self._open[tag].pop()
            if tag in SCOPES:
                self._scopes.pop()

    def _close_open(self, tags: set[str]) -> None:
        """Close the innermost of the tags that is open in the innermost scope, and what is inside it."""
        at = max((self._open[t][-1] for t in tags if self._open.get(t)), default=-1)
        if at >= 0 and at > (self._scopes[-1] if self._scopes else -1):
            self._cut(at)

    def _container(self, parent: int, step: str) -> int:
        number = self.known.setdefault((parent, step), len(self.up))
        if number == len(self.up):
            self.up.append(parent)
            self.steps.append(step)
            self.depth.append(self.depth[parent] + 1)
        return number

    def _inline_tag(self, tag: str, attributes: str) -> None:
        name = tag.lstrip("/")
        if name == tag:
            noise = "=" in attributes and _step(tag, attributes)[1] or attributes.strip().lower() == "hidden"
            if tag == "a" and self._inline_open.get("a"):  # a link ends the one before
                self._inline_tag("/a", "")
            self._inline.append((tag, noise))
            self._inline_open[tag] = self._inline_open.get(tag, 0) + 1
            self._hidden += noise
            self._links += tag == "a"
        elif self._inline_open.get(name):
            while True:
                open_, noise = self._inline.pop()
                self._inline_open[open_] -= 1
                self._hidden -= noise
                self._links -= open_ == "a"
                if open_ == name:
                    break

    def _read(self, page: str) -> None:
        for raw, tag, attributes in tokens(page):
            if raw and not self._hidden and not (self._stack and self._stack[-1][2]):
                text = entities.unescape(raw) if "&" in raw else raw
                self._pieces.append(text)
                if self._links:
                    self._linked += len(text)
            if not tag or tag in RAW:
                continue
            closing, name = tag[0] == "/", tag.lstrip("/")
            if name in INLINE:
                self._inline_tag(tag, attributes)
                continue
            if name == "br":
                if not (self._stack and self._stack[-1][2]):
                    self._pieces.append(" ")
                continue
            if name == "wbr":
                continue
            self._flush()
            if name in VOID:
                continue
            if closing:
                if self._open.get(name):
                    self._cut(self._open[name][-1])
                continue
            if self._stack and self._stack[-1][0] in ("p", "head"):  # any block ends a paragraph or a head left open
                self._cut(len(self._stack) - 1)
            if name in CLOSES:
                self._close_open(CLOSES[name])
            _, above, noise = self._stack[-1] if self._stack else ("", 0, False)
            step, bad = _step(name, attributes)
            masthead = name == "header" and not self._open.get("article") and not self._open.get("main")
            bad = (bad and name not in ("html", "body", "article", "main")) or name in DROPPED or masthead
            self._open.setdefault(name, []).append(len(self._stack))
            if name in SCOPES:
                self._scopes.append(len(self._stack))
            self._stack.append((name, self._container(above, step) if name in CONTAINERS else above, noise or bad))
        self._flush()

    def path(self, container: int) -> str:
        steps = []
        while container > 0:
            steps.append(self.steps[container])
            container = self.up[container]
        return "".join(f">{s}" for s in reversed(steps))

    def find(self, path: str) -> int | None:
        """The container of a path."""
        at = 0
        for step in path.split(">")[1:]:
            if (at := self.known.get((at, step), -1)) < 0:
                return None
        return at

    def best(self) -> int | None:
        """The container with the highest score; ties go to the shorter path, then by name."""
        scores: dict[int, float] = {}
        for container, _, plain in self.blocks:
            scores[container] = scores.get(container, 0) + plain
            up = self.up[container]
            if up > 0:
                scores[up] = scores.get(up, 0) + plain / 2
        if not scores:
            return None
        top = max(scores.values())
        few = [c for c, x in scores.items() if x == top]
        least = min(self.depth[c] for c in few)
        few = [c for c in few if self.depth[c] == least]
        return min(few, key=self.path) if len(few) > 1 else few[0]

    def subtree(self, top: int) -> list[bool]:
        """Which containers lie in ``top``."""
        inside = [False] * len(self.up)
        inside[top] = True
        for c in range(top + 1, len(self.up)):
            inside[c] = inside[self.up[c]]
        return inside

    def around(self, top: int) -> list[int]:
        """Containers around ``top`` whose own blocks belong to the article."""
        found = []
        while len(found) < 2 and (top := self.up[top]) > 0 and (tag := self.steps[top].split(".")[0]) not in ("html", "body"):
            found.append(top)
            if tag in ("article", "main"):
                break
        return found

    def owners(self, top: int) -> list[int]:
        """For each container inside ``top`` the innermost one with a class that holds it, itself included; -1 if there is none."""
        inside, own = self.subtree(top), [-1] * len(self.up)
        for c in range(top + 1, len(self.up)):
            if inside[c]:
                own[c] = c if "." in self.steps[c] else own[self.up[c]]
        return own

    def text(self, top: int, noise: frozenset[int] = frozenset(), repeated: frozenset[int] = frozenset()) -> str:
        """Text of the blocks in a container and of those directly around it. ``noise``: codes of owners whose blocks are left out; ``repeated``: digests of blocks around it that are the host's."""
        inside, beside = self.subtree(top), set(self.around(top))
        if noise and (gone := {c for c, code in enumerate(self.codes()) if code in noise}):
            inside = [x and o not in gone for x, o in zip(inside, self.owners(top), strict=True)]
        return " ".join(text for c, text, plain in self.blocks if inside[c] or (c in beside and 2 * plain >= len(text) and (not repeated or _digest(text) not in repeated)))

    def codes(self) -> list[int]:
        """A number for the path of each container, the same on every page."""
        out = [0]
        for up, step in zip(self.up[1:], self.steps[1:], strict=True):
            out.append(_digest(f"{out[up]}>{step}"))
        return out

    def inner(self, top: int) -> Iterator[tuple[int, int]]:
        """Code of each owner inside ``top`` and the digest of what it owns."""
        own, codes, texts = self.owners(top), self.codes(), {}
        for c, text, _ in self.blocks:
            if own[c] >= 0:
                texts.setdefault(own[c], []).append(text)
        for c, parts in texts.items():
            yield codes[c], _digest(" ".join(parts))

    def beside(self, top: int) -> Iterator[tuple[int, int]]:
        """Code of the container and digest of each block directly around ``top``."""
        around, codes = set(self.around(top)), self.codes()
        for c, text, _ in self.blocks:
            if c in around:
                yield codes[c], _digest(text)


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def extract(page: str | None, winners: list[str] | None, noise: list[int] | None = None, repeated: list[int] | None = None) -> str:
    """Text of the page under the first winning path that holds any of its text, else under its own best one."""
    read = Page(page or "")
    for path in winners or []:
        if (top := read.find(path)) is not None and (text := read.text(top, frozenset(noise or ()), frozenset(repeated or ()))):
            return text
    top = read.best()
    return "" if top is None else read.text(top, frozenset(noise or ()), frozenset(repeated or ()))


BEST, INNER, BESIDE = 0, 1, 2


def votes(pages: DataFrame) -> DataFrame:
    """host, kind, path, digest, page: each page's best container (``BEST``), the texts of the containers inside it and of the blocks around it. ``page`` is the digest of the best container's
    text: pages with one article have one vote on what is noise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in arrow_rows(batches, ["url", "html"], 512):
            found = []
            for url, page in zip(rows["url"], rows["html"], strict=True):
                read = Page(page or "")
                if (top := read.best()) is not None:
                    host, whole = split_url(url)[0], _digest(read.text(top))
                    found.append((host, BEST, read.path(top), 0, whole))
                    found += [(host, INNER, str(code), digest, whole) for code, digest in read.inner(top)]
                    found += [(host, BESIDE, str(code), digest, whole) for code, digest in read.beside(top)]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)], names=["host", "kind", "path", "digest", "page"])

    return pages.select("url", "html").mapInArrow(run, "host string, kind int, path string, digest long, page long")


def winning_paths(pages: DataFrame) -> DataFrame:
    """vote_host, winners: the host's winning paths, the most voted first."""
    return _winners(votes(pages))


def _winners(cast: DataFrame) -> DataFrame:
    counted = cast.where(F.col("kind") == BEST).groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("host"))).withColumn("r", F.row_number().over(W.partitionBy("host").orderBy(F.desc("n"), "path")))
    won = ranked.where((F.col("r") == 1) | ((F.col("share") >= WINNER_SHARE) & (F.col("r") <= MAX_WINNERS)))
    listed = won.groupBy(F.col("host").alias("vote_host")).agg(F.sort_array(F.collect_list(F.struct("r", "path"))).alias("w"))  # at most MAX_WINNERS
    return listed.select("vote_host", F.col("w.path").alias("winners"))


def repeated_parts(cast: DataFrame) -> DataFrame:
    """vote_host, noise, repeated: codes of paths inside the winners, and digests of blocks around them, that are the same on many different pages of a host."""
    each = cast.where(F.col("kind") != BEST).select("host", "kind", "path", "digest", "page").distinct()
    same = each.groupBy("host", "kind", "path", "digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= REPEATED)
    pages = each.select("host", "kind", "path", "page").distinct().groupBy("host", "kind", "path").agg(F.count(F.lit(1)).alias("all"))
    share = F.when(F.col("kind") == INNER, F.col("n") * 3 >= F.col("all") * 2).otherwise(F.col("n") * 2 >= F.col("all"))
    found = same.join(pages, ["host", "kind", "path"]).where(share)
    return found.groupBy(F.col("host").alias("vote_host")).agg(F.collect_set(F.when(F.col("kind") == INNER, F.col("path").cast("long"))).alias("noise"), F.collect_set(F.when(F.col("kind") == BESIDE, F.col("digest"))).alias("repeated"))


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text``, the main text of ``html`` (a column of that name is replaced)."""
    cast = materialise(votes(pages))
    winners = materialise(_winners(cast).join(repeated_parts(cast), "vote_host", "left"))
    forget(cast)
    kept = [n for n in pages.columns if n != "text"]
    rest = F.regexp_extract(F.expr("substr(url, locate('://', url) + 3)"), "^[^/?#]*", 0)
    host = F.when(F.locate("://", F.col("url")) > 0, F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lit(""))
    # Spark broadcasts the winners if their files are small; else it joins by host and splits hot hosts
    joined = pages.withColumn("vote_key", F.coalesce(host, F.lit(""))).join(winners, F.col("vote_key") == F.col("vote_host"), "left")
    schema = T.StructType([*[pages.schema[n] for n in kept], T.StructField("text", T.StringType())])
    names = ["html", "__winners", "__noise", "__repeated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(*x) for rows in arrow_rows([batch], names, 512) for x in zip(*(rows[n] for n in names), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in kept], pa.array(texts, pa.string())], names=schema.names)

    return joined.select(*(pages[n] for n in kept), *(winners[n].alias(f"__{n}") for n in ("winners", "noise", "repeated"))).mapInArrow(run, schema)


def op5_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
