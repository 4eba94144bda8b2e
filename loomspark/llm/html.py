"""Operator 7: HTML extraction by equivalence-class template deduction.

Tokens are tags and runs of text, told apart by their path in the page. Over the pages of a host
every token has an occurrence vector (how often it stands in each page); tokens with the same
vector that stand in most pages form an equivalence class. A class is valid if its tags are
nested, each opened as often as closed, and it has two tokens at least. The valid classes of a
host, nested by their paths, are its template. Text tokens of the template are dropped wherever
they stand; what lies between template tags is slots, each named by the innermost template region
(an element that holds blocks, like div or article) around it.

Slots are judged once for a host, by what they hold over all its pages: how much text, how much of
it links, how much of it template. From the root the main region is found by going on to the region
within that has most of the text, as long as one has. In it, slots of links or of template text are
dropped; outside it, slots with little text of their own. What statistics leave open (a region
beside the main one, or in it, with varied text of its own, like reader comments or an aside) is
decided by the names of tags and classes. A region that clearly holds the page's varied text is
gone on to whatever its names. Pages of hosts without a template and pages whose main
region is empty are judged in the same way by the text of that page alone.

Vectors are never gathered: a sum over pages of a hash of page and count stands for the vector,
so classes come from one aggregation by host and token, and a host with most pages is no hot spot.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import BROADCAST_ROWS, join_small
from loomspark.llm.urlrules import host
from loomspark.sources.tables import written

#: Elements whose text is no page text, elements without an end, those that end no block, and page regions that are no article (fixed values of HTML).
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
REGIONS = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "svg", "canvas", "object", "audio", "video"}
#: Elements that hold blocks rather than being one.
HOLDERS = {"html", "body", "div", "section", "article", "main", "center", "fieldset", "details"} | REGIONS
#: Words of class, id and role for what the contract leaves out; they decide only what slots leave open. A name says what its last word says, as `user-comments` but not `comments-open`.
MARKS = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "comment", "comments", "consent", "cookie", "cookies", "footer", "header", "masthead", "menu", "nav", "navbar", "navigation", "notice", "notices",
    "replies", "respond", "sidebar", "sponsor", "sponsored",
}
_ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
#: Last words that say how something is laid out, so that the word before counts; names of text, beside which those of MARKS don't count.
LAYOUT = {"area", "bar", "block", "box", "container", "form", "holder", "inner", "left", "list", "outer", "right", "section", "slot", "unit", "widget", "wrap", "wrapper"}
TEXT = {"article", "body", "content", "entry", "hentry", "main", "page", "post", "story", "text"}
#: Class names that begin with one of these say what is beside or absent, like `no-sidebar`.
_BESIDE = {"has", "no", "with", "without"}
#: A region with more than this share of what its parent holds is gone on to; one with less than the other share of the main region's text has little text.
MOST, LITTLE = 0.5, 0.2
#: A region with more than this share of the page's varied text is no aside, whatever its names.
CLEAR = 0.75
#: Of a region: an article; no article by its tag; no article by its class, id or role.
ARTICLE, BY_TAG, BY_MARK = 1, 2, 4


def _marks(attributes: str) -> list[str]:
    """Lower-case words of class, id and role."""
    names = [n for a in _NAMED.finditer(attributes) for n in (a[2] or a[3] or a[4] or "").lower().split()]
    split = [[x for x in re.split(r"[^a-z0-9]+", n) if x] for n in names]
    return [x for words in split if words and words[0] not in _BESIDE for x in words]


def _says_aside(attributes: str, article: bool) -> bool:
    """Whether the names of class, id and role are those of MARKS, and none is one of TEXT. A header of the article itself is no aside."""
    heads = set()
    for a in _NAMED.finditer(attributes):
        for name in (a[2] or a[3] or a[4] or "").lower().split():
            words = [x for x in re.split(r"[^a-z]+", name) if x]
            while len(words) > 1 and words[-1] in LAYOUT:
                words.pop()
            if words and words[0] not in _BESIDE:
                heads.add(words[-1])
    return bool(heads & (MARKS - {"header"} if article else MARKS)) and not heads & TEXT


def token(path: str, kind: int, text: str = "") -> int:
    """A 63-bit hash of a token. kind: 1 opens, -1 closes, 0 text."""
    return xxhash.xxh3_64_intdigest(f"{kind}\n{path}\n{text}".encode("utf-8", "surrogatepass")) >> 1


class Page:
    """A page's tags, regions and blocks.

    tags: count by path and kind. regions: path, place of the region around it (-1: none) and
    flags; the page itself is the first. blocks: path, text, place of its region, characters in
    links, in page order.
    """

    def __init__(self, page: str):
        self.tags: dict[tuple[str, int], int] = {}
        self.regions: list[tuple[str, int, int]] = [("", -1, 0)]
        self.blocks: list[tuple[str, str, int, int]] = []
        self._held: list[str] = []
        self._where, self._links = ("", 0), 0
        self._stack: list[tuple[str, str, int, bool, bool]] = [("", "", 0, False, False)]  # name, path, region, in an article, in a link
        at, n = 0, len(page)
        while at < n:
            m = _MARKUP.search(page, at)
            if m is None or m.start() > at:
                end = n if m is None else m.start()
                self._text(page[at:end])
                at = end
                continue
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                self._close(name)
            elif name in RAW:
                self._before(name)
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            else:
                self._before(name)
                if name not in VOID:
                    self._open(name, m[3] or "")
        self._end_block()
        self._leave(1)

    def _text(self, text: str) -> None:
        _, path, region, _, link = self._stack[-1]
        if self._held and self._where[1] != region:
            self._end_block()
        if not self._held:
            self._where = (path, region)
        self._held.append(text)
        if link:
            self._links += len(text)

    def _end_block(self) -> None:
        if self._held and (text := _clean("".join(self._held))):
            self.blocks.append((self._where[0], text, self._where[1], min(self._links, len(text))))
        self._held, self._links = [], 0

    def _count(self, path: str, kind: int) -> None:
        self.tags[path, kind] = self.tags.get((path, kind), 0) + 1

    def _leave(self, depth: int) -> None:
        for _, path, *_ in reversed(self._stack[depth:]):
            self._count(path, -1)
        del self._stack[depth:]

    def _close(self, name: str) -> None:
        stack = self._stack
        depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
        # an inline end tag doesn't end blocks that were opened after it
        if depth and not (name in INLINE and any(s[0] not in INLINE for s in stack[depth + 1 :])):
            self._leave(depth)
        if name not in INLINE:
            self._end_block()

    def _before(self, name: str) -> None:
        """What a start tag ends."""
        if name in _ENDS_P or name in _SAME:
            same = _SAME.get(name, {"p"})
            for i in range(len(self._stack) - 1, 0, -1):
                if self._stack[i][0] in same:
                    self._leave(i)
                    break
                if self._stack[i][0] not in INLINE:
                    break
        if name not in INLINE:
            self._end_block()
        elif name == "br":
            self._text(" ")

    def _open(self, name: str, attributes: str) -> None:
        if attributes.rstrip().endswith("/") and name not in INLINE | _ENDS_P | set(_SAME):
            return
        _, path, region, article, link = self._stack[-1]
        marks = _marks(attributes) if attributes else []
        # words with digits tell single pages apart, not kinds of them
        kind = sorted({x for x in marks if x.isalpha()})
        inner = f"{path}/{name}" + ("." + ".".join(kind) if kind else "")
        flags = ARTICLE * (name in ("article", "main") or "article" in marks)
        # a header of the article itself may hold its heading; that of the page doesn't
        flags |= BY_TAG * (name in REGIONS and not (name == "header" and article))
        flags |= BY_MARK * (name not in ("article", "main", "body", "html") and bool(marks) and _says_aside(attributes, article))
        if flags or name in HOLDERS:
            self.regions.append((inner, region, flags))
            region = len(self.regions) - 1
        self._count(inner, 1)
        self._stack.append((name, inner, region, article or bool(flags & ARTICLE), link or name == "a"))

    def masses(self, dropped: set[int] = frozenset()) -> list[float]:
        """Of each region, the characters in it, nested ones included, outside links and dropped tokens."""
        out = [0.0] * len(self.regions)
        for path, text, region, links in self.blocks:
            if not dropped or token(path, 0, text) not in dropped:
                out[region] += len(text) - links
        for i in range(len(out) - 1, 0, -1):
            out[self.regions[i][1]] += out[i]
        return out


def _clean(text: str) -> str:
    return _SPACE.sub(" ", _html.unescape(text) if "&" in text else text).strip()


def judge(regions: dict[int, tuple[int, int, float, float]]) -> dict[int, bool]:
    """Whether the slot of each region is main text.

    regions: by name, the name of the region around it, flags, text of its own and in it (without
    links and template text), and the share of it that is links or template text. A region that no
    other holds stands in the page itself, named 0.
    """
    inner: dict[int, list[int]] = {}
    for t, (parent, *_) in regions.items():
        if t:
            inner.setdefault(parent if parent in regions and parent != t else 0, []).append(t)
    mass = {t: r[2] for t, r in regions.items()}
    mass.setdefault(0, sum(mass[t] for t in inner.get(0, ())))
    flags = lambda t: regions[t][1]
    aside = {t for t in regions if _aside(flags(t), mass[t], mass[0])}
    main, above = 0, set()
    while True:
        open_ = [t for t in inner.get(main, ()) if t not in aside]
        best = max(open_, key=lambda t: (mass[t], flags(t) & ARTICLE, -t), default=None)
        rest = mass[main] - sum(mass[t] for t in inner.get(main, ()) if t in aside)
        if best is None or mass[best] <= MOST * rest:
            break
        above.add(main)
        main = best
    out: dict[int, bool] = {}
    todo = [(0, True, main == 0)]
    while todo:
        t, keep, within = todo.pop()
        if t in above:  # text around the main region
            own = mass[t] - sum(mass[x] for x in inner.get(t, ()))
            out[t] = keep and own >= LITTLE * mass[main] > 0
        else:
            out[t] = keep
        for x in inner.get(t, ()):
            f, share = flags(x), regions[x][3]
            if x == main or x in above:
                todo.append((x, True, x == main))
            elif within:  # in the main region
                todo.append((x, keep and share <= 0.5 and x not in aside, True))
            elif t in above:  # beside it
                todo.append((x, (mass[x] >= LITTLE * mass[main] or bool(f & ARTICLE)) and share <= 0.5 and x not in aside, False))
            else:  # in a region beside it
                todo.append((x, keep and share <= 0.5 and x not in aside, False))
    return out


def _aside(flags: int, own: float, page: float) -> bool:
    """Whether a region is an aside by its names, which don't count if it clearly holds the page's text."""
    return bool(flags & (BY_TAG | BY_MARK)) and own <= CLEAR * page


class Template:
    """A host's template: its text tokens, and the verdicts on its slots.

    tokens: token, kind, parent (the region a region or text stands in), pages, characters,
    characters in links, flags; of regions the characters count what is nested.
    """

    def __init__(self, tokens: list[tuple[int, int, int, int, int, int, int]]):
        self.texts = {t for t, kind, *_ in tokens if kind == 0}
        regions = {t: (parent, flags, chars, links) for t, kind, parent, _, chars, links, flags in tokens if kind == 1 and flags >= 0}
        repeated = dict.fromkeys(regions, 0)
        for _, kind, parent, _, chars, *_ in tokens:
            if kind == 0:
                seen = set()
                while parent in regions and parent not in seen:
                    seen.add(parent)
                    repeated[parent] += chars
                    parent = regions[parent][0]
        self.slots = judge({t: (parent, flags, float(max(0, chars - links - repeated[t])), min(1.0, (links + repeated[t]) / max(chars, 1))) for t, (parent, flags, chars, links) in regions.items()}) if regions else {}


def decided(page: Page, template: Template) -> list[tuple[str, str]]:
    """Text of each block of the main text, and what decided on it: the template's slots, or the page."""
    live = [token(path, 0, text) not in template.texts for path, text, _, _ in page.blocks] if template.texts else [True] * len(page.blocks)
    mass = page.masses(template.texts)
    verdict: list[bool] = []
    if template.slots:
        for path, parent, flags in page.regions:
            known = template.slots.get(token(path, 1) if path else 0)
            if known is None:  # a region of this page alone: as its slot, but for its own name
                known = (verdict[parent] if parent >= 0 else False) and not _aside(flags, mass[len(verdict)], mass[0])
            verdict.append(known and (parent < 0 or verdict[parent] or template.slots.get(token(path, 1)) is True))
        found = [(text, "slots") for (_, text, region, _), ok in zip(page.blocks, live, strict=True) if ok and verdict[region]]
        aside = _within(page, mass)
        others = sum(len(text) for (_, text, region, _), ok in zip(page.blocks, live, strict=True) if ok and not aside[region])
        if found and sum(len(text) for text, _ in found) >= LITTLE * others:
            return found
    chars = [0.0] * len(page.regions)
    for _, text, region, _ in page.blocks:
        chars[region] += len(text)
    for i in range(len(chars) - 1, 0, -1):
        chars[page.regions[i][1]] += chars[i]
    alone = judge({i: (parent, flags, mass[i], 1 - mass[i] / chars[i] if chars[i] else 0.0) for i, (_, parent, flags) in enumerate(page.regions)})
    found = [(text, "page") for (_, text, region, _), ok in zip(page.blocks, live, strict=True) if ok and alone[region]]
    if not found and template.texts:  # all is template: copies of one text on most pages of a host
        return decided(page, Template([]))
    return found


def _within(page: Page, mass: list[float]) -> list[bool]:
    """Whether each region is an aside or in one."""
    out: list[bool] = []
    for (_, parent, flags), own in zip(page.regions, mass, strict=True):
        out.append(_aside(flags, own, mass[0]) or (parent >= 0 and out[parent]))
    return out


def main_text(page: str, template: Template | None = None) -> str:
    """Blocks of the main text, joined by a line feed."""
    return "\n".join(text for text, _ in decided(Page(page), template or Template([])))


def page_tokens(page: Page) -> dict[int, tuple[int, int, int, int, int, int]]:
    """Count, kind, parent, characters, characters in links and flags (-1: no region) of each token of a page."""
    names = [token(path, 1) if path else 0 for path, _, _ in page.regions]
    chars, links = [0] * len(names), [0] * len(names)
    found: dict[int, tuple[int, int, int, int, int, int]] = {}
    for path, text, region, linked in page.blocks:
        t = token(path, 0, text)
        n, *_, c, _, _ = found.get(t, (0, 0, 0, 0, 0, 0))
        found[t] = (n + 1, 0, names[region], c + len(text), 0, -1)
        chars[region] += len(text)
        links[region] += linked
    for i in range(len(names) - 1, 0, -1):
        chars[page.regions[i][1]] += chars[i]
        links[page.regions[i][1]] += links[i]
    for (path, kind), n in page.tags.items():
        found[token(path, kind)] = (n, kind, 0, 0, 0, -1)
    for t, (_, parent, flags), c, k in zip(names[1:], page.regions[1:], chars[1:], links[1:], strict=True):
        n, kind, _, c0, k0, _ = found[t]
        found[t] = (n, kind, names[parent], c0 + c, k0 + k, flags)
    return found


TOKEN = "host string, token long, kind int, parent long, n_pages long, vector long, chars long, links long, flags int"


def template(pages: DataFrame, support: float = 0.5, least: int = 3) -> DataFrame:
    """host, token, kind, parent, n_pages, chars, links, flags and vector of the tokens in valid classes of each host.

    A token needs the share `support` of the host's pages, and `least` of them.
    """
    types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    names = ["host", "token", "kind", "parent", "n_pages", "vector", "chars", "links", "flags"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[int]] = {}

        def sent() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in sums.items()]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for h, number, page in zip(batch.column("host").to_pylist(), batch.column("number").to_pylist(), batch.column("html"), strict=True):
                for t, (count, kind, parent, chars, links, flags) in page_tokens(Page(page.as_py() or "")).items():
                    s = sums.setdefault((h, t, kind, parent), [0, 0, 0, 0, flags])
                    s[0] += 1
                    # 32 bits of each page and count: sums stay far from overflow up to 2 ** 31 pages
                    s[1] += xxhash.xxh3_64_intdigest(b"%d %d" % (number, count)) >> 32
                    s[2] += chars
                    s[3] += links
                if len(sums) > 200_000:
                    yield sent()
        if sums:
            yield sent()

    read = pages.select(host(F.col("url")).alias("host"), F.xxhash64("page_id", "url").alias("number"), F.col("html").cast("string").alias("html"))
    add = lambda c: F.sum(c).alias(c)
    counted = read.mapInArrow(run, TOKEN).groupBy("host", "token", "kind").agg(F.min("parent").alias("parent"), add("n_pages"), add("vector"), add("chars"), add("links"), F.max("flags").alias("flags"))
    n = pages.groupBy(host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n_host"))
    large = counted.where(F.col("n_pages") >= least).join(n.where(F.col("n_host") >= least), "host").where(F.col("n_pages") >= F.lit(support) * F.col("n_host"))
    large = written(large)
    classes = large.groupBy("host", "vector", "n_pages").agg(F.sum("kind").alias("balance"), F.count(F.lit(1)).alias("size")).where("balance = 0 and size >= 2")
    return large.join(classes, ["host", "vector", "n_pages"], "left_semi").select("host", "token", "kind", "parent", "n_pages", "chars", "links", "flags", "vector")


def extract(pages: DataFrame, support: float = 0.5, least: int = 3) -> DataFrame:
    """page_id, url, text, n_chars (code points), n_blocks and by_slots (blocks of the text, and those that the host's slots decided) of every row of pages.

    Null html counts as empty; a page without main text gets an empty text. Null urls and urls
    without a host share the empty host. A null page_id stays null. Hosts of fewer than `least`
    pages have no template: their pages are judged one by one. Repeated pages each give a row;
    other columns are ignored. Templates (tokens on the share `support` of a host's pages, so about
    as many as one page has) are sent to the pages by a broadcast up to a checked number of tokens,
    else by a salted join.
    """
    tokens = template(pages, support, least).where("kind >= 0").groupBy("host").agg(F.collect_list(F.struct("token", "kind", "parent", "n_pages", "chars", "links", "flags")).alias("template"))
    by_host = written(tokens)
    size = by_host.agg(F.sum(F.size("template"))).first()[0] or 0
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    joined = join_small(read, by_host, ["host"], "left", rows=0 if size <= BROADCAST_ROWS else BROADCAST_ROWS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template] = {}
        for batch in batches:
            found = []
            for h, page, rows in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("template"), strict=True):
                if h not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[h] = Template([tuple(t.values()) for t in rows.as_py() or ()])
                found.append(decided(Page(page.as_py() or ""), known[h]))
            text = ["\n".join(t for t, _ in x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), pa.array(map(len, found), pa.int64()), pa.array([sum(how == "slots" for _, how in x) for x in found], pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_blocks", "by_slots"],
            )

    return joined.select("page_id", "url", "host", "html", "template").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, by_slots long")
