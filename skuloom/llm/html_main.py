"""Main text of web pages by host consensus.

Every page scores its containers; each votes for its best ones under a generalised path of
tags and classes; votes are summed per host in Spark; every page is then extracted with the
winning path of its host.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuloom.llm.common import append_result, pick
from skuloom.session import materialize

CONTAINERS = frozenset("html body main article section div td table form aside nav header footer ul ol dl".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd tr th caption blockquote pre figure figcaption hr br address details summary "
    "fieldset legend option select center title head".split()
)
# elements whose content is no text of a page
HIDDEN = frozenset("script style noscript template svg iframe object textarea head title select button".split())
RAW = frozenset("script style textarea title noscript iframe".split())
# what may stand in a head; anything else ends it
HEAD = frozenset("head title style script noscript template meta link base basefont bgsound".split())
_CELL_ENDS = frozenset("td th tr tbody thead tfoot".split())
# start tags that end an open element whose own end tag was left out
ENDED_BY = {
    "p": frozenset(
        "address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form "
        "h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul tr td th".split()
    ),
    "li": frozenset(["li"]),
    "dd": frozenset(["dd", "dt"]),
    "dt": frozenset(["dd", "dt"]),
    "option": frozenset(["option", "optgroup"]),
    "tr": frozenset("tr tbody thead tfoot".split()),
    "th": _CELL_ENDS,
    "td": _CELL_ENDS,
}
NOISE_TAGS = frozenset("nav footer aside form menu dialog".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
# words for what is beside an article
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion "
    "banner banners popup modal overlay cookie cookies consent gdpr notice notices notification notifications alert alerts "
    "nav navigation navbar menu menus breadcrumb breadcrumbs sidebar sidebars side widget widgets footer footnav masthead "
    "related recommended recommendations share sharing social newsletter newsletters subscribe subscription signup login "
    "search searchbox searchform toolbar pagination pager skip hidden".split()
)
# words for what readers wrote about it
COMMENT_WORDS = frozenset(
    "comment comments commentlist disqus reply replies respond response responses discussion discussions reaction reactions "
    "feedback guestbook".split()
)
# With one of these in it, a class tells the state of the page or of what is around, not what it holds.
STATE_WORDS = frozenset(
    "no not non has have having with without is are in on off open opened closed close enabled enable disabled disable "
    "allowed allow count counts number active toggled visible collapsed expanded free results result".split()
)
# words that only tell where or how something is laid out
LAYOUT_WORDS = frozenset(
    "list lists area areas box boxes wrap wrapper container holder section sections block blocks bar bars panel panels column col "
    "left right top bottom middle inner outer main primary secondary first second third upper lower fixed sticky mobile desktop "
    "content contents body text title item items entry entries row group card cards unit slot zone module region thread tree "
    "links link form post posts article articles story stories page user users reader readers site global".split()
)
MAIN_WORDS = frozenset("article content main post entry story body text page".split())
# A container of more characters than this, and of more than this share of the page's, is not noise
# for its classes' sake.
LONG_PROSE, MOST_PROSE = 400, 0.8
# labels that are spelled out at the end of a path; a hash tells deeper ones apart
PATH_LABELS = 16
# votes of a single page for its best path; no other path of its own can have more
ONE_PAGE = 1.0
# Hosts with at least this share of the pages, at most 1 / HOT_SHARE, are not shuffled.
HOT_SHARE = 2.0**-10
# paths of a host that may be broadcast with it; hosts with more are joined
HOT_PATHS = 256

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_WORDS = re.compile(r"[a-z]+")


class Container:
    """An open or closed container: its path, whether it is noise, and its blocks' numbers.

    ``hard``: noise by its tag, role or style. ``soft``: noise by its classes; of these, ``comments``
    tells what readers wrote.
    """

    __slots__ = (
        "comments", "digest", "end", "first", "hard", "labels", "last", "links", "noise", "parent", "prior", "prose", "size", "soft", "tag",
    )

    def __init__(self, tag: str, parent: Container | None, label: str, noise: tuple[bool, bool, bool], prior: float, block: int):
        self.tag, self.parent, self.prior = tag, parent, prior
        self.hard, self.soft, self.comments = noise
        self.noise = False
        self.labels = (*parent.labels, label)[-PATH_LABELS:] if parent else ("",)
        # of the whole path, in constant time for each container
        self.digest = hashlib.blake2b((parent.digest if parent else b"") + b"/" + label.encode("utf-8", "replace"), digest_size=8).digest()
        # inside an article or the main part
        self.prose = parent is not None and (parent.prose or parent.tag in ("article", "main"))
        self.first, self.last, self.end = block, block, 0
        self.size = self.links = 0.0

    @property
    def path(self) -> str:
        spelled = "/".join(self.labels)
        return spelled if self.labels[0] == "" else f"{self.digest.hex()}/{spelled}"


def _attributes(text: str) -> dict[str, str]:
    if "=" not in text and "hidden" not in text:
        return {}
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html_lib.unescape(value.strip("\"'")))
    return found


def _label(tag: str, attributes: dict[str, str]) -> str:
    """Tag with its classes (or its id), numbers generalised."""
    classes = sorted(set(attributes.get("class", "").split()))
    name = ".".join([tag, *classes]) if classes else tag + ("#" + attributes["id"] if attributes.get("id") else "")
    return re.sub(r"[0-9]+", "0", name)


def _cues(attributes: dict[str, str]) -> list[str]:
    text = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", text).lower())


def _kind_of_class(token: str) -> str:
    """What a class or id says: "noise", "comments" or nothing.

    Its words count together. One that tells a state, as in ``no-sidebar`` or ``comments-closed``, says
    nothing; otherwise the last word that is no mere layout decides, if all before it are layout or noise too.
    """
    words = _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
    if any(w in STATE_WORDS for w in words):
        return ""
    telling = [w for w in words if w not in LAYOUT_WORDS]
    if not telling or any(w not in NOISE_WORDS and w not in COMMENT_WORDS for w in telling):
        return ""
    return "comments" if telling[-1] in COMMENT_WORDS else "noise"


def _noise(tag: str, attributes: dict[str, str], inside_article: bool, by_words: bool = True) -> tuple[bool, bool, bool]:
    """(noise by tag, role or style; noise by classes; of these, comments)."""
    hard = (
        tag in NOISE_TAGS
        or attributes.get("role", "").lower() in NOISE_ROLES
        or (tag == "header" and not inside_article)
        or "hidden" in attributes
        or attributes.get("aria-hidden", "").lower() == "true"
        or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I) is not None
    )
    if hard or not by_words or tag in ("html", "body", "main", "article"):
        return hard, False, False
    kinds = {_kind_of_class(t) for t in f"{attributes.get('class', '')} {attributes.get('id', '')}".split()}
    return False, bool(kinds - {""}), "comments" in kinds


class Page:
    """Containers and text blocks of one page, read in one pass over the html; without
    ``by_words`` classes and ids make nothing noise."""

    def __init__(self, text: str, by_words: bool = True):
        self.by_words = by_words
        self.blocks: list[tuple[str, Container]] = []
        self.root = Container("", None, "", (False, False, False), 0.0, 0)
        self.containers = [self.root]
        self._read(text)

    def _read(self, text: str) -> None:
        stack, pieces, hidden, links = [self.root], [], [], 0
        raw_end: dict[str, int] = {}
        noise_inline: list[str] = []
        inner: list[str] = []  # containers opened inside noise_inline
        inner_tags: Counter[str] = Counter()
        cells: list[int] = []  # places of the open cells and tables in the stack
        open_tags: Counter[str] = Counter()
        last_tag = text.rfind(">")

        def flush() -> None:
            if pieces:
                block = " ".join(html_lib.unescape("".join(p for p, _ in pieces)).split())
                if block:
                    linked = sum(len(p) for p, in_link in pieces if in_link)
                    share = min(1.0, linked / max(1, sum(len(p) for p, _ in pieces)))
                    owner = stack[-1]
                    owner.size += len(block)
                    owner.links += len(block) * share
                    self.blocks.append((block, owner))
                pieces.clear()

        at = 0
        while at < len(text):
            start = text.find("<", at)
            if start < 0 or start > last_tag:
                start = len(text)
            if hidden == ["head"] and text[at:start].strip():
                hidden.pop()  # text ends a head
            if start > at and not hidden and not noise_inline:
                pieces.append((text[at:start], links > 0))
            if start == len(text):
                break
            if text.startswith("<!--", start):
                end = text.find("-->", start + 4)
                at = len(text) if end < 0 else end + 3
                continue
            if text.startswith(("<!", "<?"), start):
                at = text.find(">", start) + 1
                continue
            match = _PLAIN_TAG.match(text, start)
            if match and ('"' in match[3] or "'" in match[3]):
                match = _TAG.match(text, start) or match
            if not match:
                if not hidden and not noise_inline:
                    pieces.append(("<" if not text.startswith("</", start) else "", links > 0))
                at = start + (1 if not text.startswith("</", start) else max(2, text.find(">", start) + 1 - start))
                continue
            closing, tag, rest, at = bool(match[1]), match[2].lower(), match[3], match.end()
            if tag in BLOCKS:
                flush()
            if hidden == ["head"] and (tag in ("body", "html", "br") if closing else tag not in HEAD):
                hidden.pop()
            if noise_inline and not hidden:
                noise, ended = noise_inline[-1], False
                if closing and tag in CONTAINERS and tag != noise:
                    if inner_tags[tag]:
                        while True:
                            left = inner.pop()
                            inner_tags[left] -= 1
                            if left == tag:
                                break
                    else:  # the end of a container around it
                        ended = open_tags[tag] > 0 and not (tag == "td" and noise == "tr")
                elif not inner and noise in ENDED_BY:
                    ended = not closing and tag in ENDED_BY[noise]
                if ended:
                    noise_inline.clear()
                    inner.clear()
                    inner_tags.clear()
            if closing:
                if hidden:
                    if tag == hidden[-1]:
                        hidden.pop()
                elif noise_inline:
                    # of an element with an optional end tag only the outermost one is held
                    if tag == noise_inline[-1] and not (inner and tag in ENDED_BY):
                        noise_inline.pop()
                    if not noise_inline:
                        inner.clear()
                        inner_tags.clear()
                elif tag == "a":
                    links = max(0, links - 1)
                elif open_tags[tag]:
                    while True:
                        closed = stack.pop()
                        self._close(closed)
                        open_tags[closed.tag] -= 1
                        if closed.tag in ("td", "table"):
                            cells.pop()
                        if closed.tag == tag:
                            break
                continue
            if hidden and hidden[-1] == "head":
                if tag == "template":
                    hidden.append(tag)
                if tag not in RAW:
                    continue
            elif hidden:
                if tag == hidden[-1] and not rest.endswith("/"):
                    hidden.append(tag)
                continue
            if tag in RAW:
                # the content runs to the closing tag, whatever stands in it; without one, the
                # rest of the page belongs to it
                if raw_end.get(tag, 0) >= 0:
                    end = re.compile(rf"</{tag}\b", re.I).search(text, at)
                    raw_end[tag] = end.start() if end else -1
                at = raw_end[tag] if raw_end[tag] >= 0 else len(text)
                hidden.append(tag)
                continue
            if rest.endswith("/") and tag not in CONTAINERS:
                continue
            if tag in HIDDEN:
                hidden.append(tag)
                continue
            if noise_inline:
                if tag == noise_inline[-1] and tag not in ENDED_BY:
                    noise_inline.append(tag)
                elif tag in CONTAINERS and tag != "td":
                    inner.append(tag)
                    inner_tags[tag] += 1
                continue
            if tag == "a":
                links += 1
            if tag in _CELL_ENDS and cells and stack[cells[-1]].tag == "td":
                # an open cell of the same table ends
                place = cells.pop()
                while len(stack) > place:
                    closed = stack.pop()
                    self._close(closed)
                    open_tags[closed.tag] -= 1
            if tag in CONTAINERS:
                attributes = _attributes(rest)
                inside = stack[-1].prose or stack[-1].tag in ("article", "main")
                noise = _noise(tag, attributes, inside, self.by_words)
                prior = 1.0 + 0.5 * (tag in ("article", "main")) + 0.25 * any(w in MAIN_WORDS for w in _cues(attributes))
                child = Container(tag, stack[-1], _label(tag, attributes), noise, prior, len(self.blocks))
                self.containers.append(child)
                if tag in ("td", "table"):
                    cells.append(len(stack))
                stack.append(child)
                open_tags[tag] += 1
            elif rest and tag not in ("br", "hr", "img", "input", "meta", "link", "wbr"):
                attributes = _attributes(rest)
                if attributes and any(_noise(tag, attributes, True, self.by_words)):
                    noise_inline.append(tag)
        flush()
        while stack:
            self._close(stack.pop())
        self._settle()

    def _close(self, container: Container) -> None:
        container.last = len(self.blocks)
        container.end = len(self.containers)

    def _settle(self) -> None:
        """Decide which containers are noise, once all are read.

        One that only its classes call noise, and that does not hold comments, is none if it is long
        and has most of the page's prose, and no article or main part with prose lies outside of it.
        """
        place = {id(c): i for i, c in enumerate(self.containers)}
        left_out: list[bool] = []  # in noise by tag, or in comments
        for c in self.containers:
            out = c.hard or (c.soft and c.comments)
            left_out.append(out or (c.parent is not None and left_out[place[id(c.parent)]]))
        prose = [0.0 if out else c.size - c.links for c, out in zip(self.containers, left_out)]
        for i in range(len(self.containers) - 1, 0, -1):
            prose[place[id(self.containers[i].parent)]] += prose[i]
        parts = [c.tag in ("article", "main") and prose[i] > 0 for i, c in enumerate(self.containers)]
        upto = [0]
        for part in parts:
            upto.append(upto[-1] + part)
        around: list[int] = []  # articles and main parts around a container
        for i, c in enumerate(self.containers):
            above = place[id(c.parent)] if c.parent is not None else None
            around.append(0 if above is None else around[above] + parts[above])
            soft = c.soft
            if soft and not c.comments and prose[i] > max(MOST_PROSE * prose[0], LONG_PROSE):
                inside = upto[c.end] - upto[i]
                soft = upto[-1] - inside - around[i] > 0
            c.noise = c.hard or soft or (c.parent is not None and c.parent.noise)

    def scores(self) -> list[tuple[str, float]]:
        """(path, score) of the containers that could hold the main text, best first.

        A block counts fully, less its links, for its container and by falling shares for the
        containers around it, so that the innermost one around all the prose wins.
        """
        risen: dict[int, float] = {}
        found: dict[str, float] = {}
        for c in reversed(self.containers):  # inner ones before outer ones
            worth = 0.0 if c.noise else c.size - c.links
            below = risen.get(id(c), 0.0)
            if c.parent is not None:
                risen[id(c.parent)] = risen.get(id(c.parent), 0.0) + 0.8 * worth + 0.9 * below
            if not c.noise and worth + below > 0:
                path = c.path
                found[path] = max(found.get(path, 0.0), (worth + below) * (c.prior or 1.0))
        return sorted(found.items(), key=lambda x: (-x[1], x[0]))

    def text(self, path: str) -> str:
        """Blocks inside the containers of a path, without those in noise, in page order."""
        spans = sorted({(c.first, c.last) for c in self.containers if not c.noise and c.path == path})
        out, done = [], 0
        for first, last in spans:
            for number in range(max(first, done), last):
                block, owner = self.blocks[number]
                if not owner.noise:
                    out.append(block)
            done = max(done, last)
        return " ".join(out)


def _read_page(text: str) -> tuple[Page, list[tuple[str, float]]]:
    """The page and its scores; one that is all noise is read again without the words of classes."""
    page = Page(text)
    scores = page.scores()
    if not scores:
        page = Page(text, by_words=False)
        scores = page.scores()
    return page, scores


VOTE = T.StructType([T.StructField("path", T.StringType()), T.StructField("score", T.DoubleType())])
VOTES_SCHEMA = T.StructType([T.StructField("votes", T.ArrayType(VOTE))])
TEXT_SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("path", T.StringType())])


def _vote():
    def votes(pages):
        out = []
        for page in pages:
            best = _read_page(page)[1] if page else []
            top = best[0][1] if best else 1.0
            out.append([{"path": p, "score": s / top} for p, s in best])
        return {"votes": out}

    return votes


def _extract():
    def texts(pages, paths):
        found, used = [], []
        for page, tried in zip(pages, paths):
            text, path = "", None
            if page:
                parsed, scores = _read_page(page)
                for path in [*(tried or []), *[p for p, _ in scores[:1]]]:
                    text = parsed.text(path)
                    if text:
                        break
            found.append(text)
            used.append(path if text else None)
        return {"text": found, "path": used}

    return texts


def _visible():
    def texts(pages):
        found = []
        for page in pages:
            blocks = Page(page).blocks if page else []
            found.append(" ".join([b for b, owner in blocks if not owner.noise] or [b for b, _ in blocks]))
        return {"text": found}

    return texts


def visible_text(rows: DataFrame, html: str, result: str) -> DataFrame:
    """``rows`` with the struct ``result`` (text): the blocks of the page outside noise, or all
    if there are no others. No host is asked, so nothing is shuffled."""
    return append_result(rows, [html], _visible, T.StructType([T.StructField("text", T.StringType())]), result)


def host_of(url: Column) -> Column:
    """Host of an address, in lower case, without port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): the paths of each host, most votes first, from pages (host, html).

    Every page votes for all its paths, and takes the one of its own with the most votes. A page
    gives its best path one vote and no other path more; so a path that no second page has, or
    that has less than one vote, can win nowhere and is left out.
    """
    voted = append_result(pages.select("host", "html"), ["html"], _vote, VOTES_SCHEMA, "vote")
    each = voted.select("host", F.explode("vote.votes").alias("v")).select("host", "v.path", "v.score")
    # a vote is the square of the share of the page's best score, so the best counts most
    sums = each.groupBy("host", "path").agg(
        F.round(F.sum(F.col("score") * F.col("score")), 6).alias("votes"), F.count(F.lit(1)).alias("pages")
    )
    able = sums.where((F.col("votes") >= ONE_PAGE) & (F.col("pages") > 1))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("rank"), "path")))
    return able.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))


def extract(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """One row per page: id, url, text, n_chars, path (the container that gave the text).

    Blocks have their character references decoded, white space turned into single spaces and
    trimmed, and are joined by a space. Menus, headers, footers, side bars, notices, adverts,
    forms, comments, scripts and styles are left out.

    Null or empty html, and pages without text, give an empty text. Pages with null or odd
    addresses share one host without a name. Null ids and repeated rows keep a row each. A page
    without its host's paths uses its own best container. Broken markup is read as far as it
    goes; time is linear in the page. Further columns are ignored.
    """
    rows = pick(pages, id_column, url_column, html_column).toDF("id", "url", "html")
    rows = rows.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    winners = materialize(host_paths(rows), "host-paths")
    # hosts with a large share of the pages are few, so their paths are broadcast and their pages
    # stay where they are; the others are joined by host
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = sizes.where(F.col("n") >= HOT_SHARE * total).select("host").join(winners, "host", "left").select(
        "host", F.coalesce("paths", F.array().cast("array<string>")).alias("hot_paths")
    ).where(F.size("hot_paths") <= HOT_PATHS)
    marked = rows.join(F.broadcast(hot), "host", "left")
    columns = ["id", "url", "html"]
    here = marked.where(F.col("hot_paths").isNotNull()).select(*columns, F.col("hot_paths").alias("paths"))
    rest = marked.where(F.col("hot_paths").isNull()).join(winners, "host", "left").select(*columns, "paths")
    joined = here.unionByName(rest)
    found = append_result(joined, ["html", "paths"], _extract, TEXT_SCHEMA, "found")
    return found.select(
        F.col("id").alias(id_column),
        F.col("url").alias(url_column),
        F.col("found.text").alias("text"),
        F.char_length("found.text").cast("long").alias("n_chars"),
        F.col("found.path").alias("path"),
    )
