"""Main text of web pages by site style trees.

Pages of one host share templates. Their document trees are merged: an element of the merged tree
is a path of tags with classes and ids. Its presentations (sequences of child elements) and the features
of its own content (phrases of its text, its links' texts) are counted by page, copies of one text once. The
importance of presentation is the entropy of the presentations; that of content is one minus the mean entropy
of the features over the pages that have the element, each feature weighed by its words and pages: 0 where all pages say the same,
1 where each page says its own. Both are on the scale of the logarithm of the number of pages.

On a page, an element's importance is composed from the content of all elements at and below it, weighed by their words, or is that
of its presentation if that is greater. It is then drawn toward what tags, roles and names say of such an element, as
if some pages more had been seen: a few that say the same for furniture, many that differ for other elements.
So a host of one page is judged by the prior, a large one by its tree, and there is no size in between where the rule changes. A
branch goes if the result is below one bound, the same for all elements. Headlines, paragraphs, lists and tables are parts of the box
that they are in, and are not judged alone unless something marks them.

Three things that no tree can see go by tag or name on all hosts: what is never shown, forms, and furniture that is each page's
own, such as reader comments and rotating adverts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import Scratch

#: Importance below which a branch goes.
BOUND = 0.9
#: What is known before any page is seen: so many pages that say the same for furniture, that differ for other elements.
SAME_PAGES, OTHER_PAGES = 4, 60
PLAIN, SITE, KEPT = 0, 1, 2
#: Elements of all hosts' trees up to which they are sent to every task.
SENT = 100_000

# Elements by their role in the language of web pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
NEVER = frozenset(
    "head title script style noscript template svg math canvas iframe object embed audio video map button select textarea input datalist dialog".split()
)
SITE_TAGS = frozenset("nav footer aside menu".split())
#: Tags that say something without a name.
UNNAMED = NEVER | SITE_TAGS | {"form", "header"}
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar tablist".split())
OWN_ROLES = frozenset("search form dialog alertdialog alert".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner nav navbar navigation menu menubar topbar sidebar "
    "footer masthead breadcrumb breadcrumbs comment comments commentlist disqus respond replies discussion cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets pagination pager toolbar "
    "skip copyright legal disclaimer".split()
)
#: Those of them that are each page's own, so that no comparison of pages can tell them from its text.
OWN = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion comment comments commentlist disqus respond replies discussion "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets pagination pager".split()
)
#: Names of furniture that are as common as the names of an article's own parts.
AMBIGUOUS = frozenset(
    "banner notice notices comment comments replies discussion related recommended recommendations legal disclaimer copyright alert sharing social share navigation "
    "promotion consent subscription sponsor sponsored skip".split()
)
#: What such a name removes inside an article.
BOXES = frozenset("div ul ol dl table span".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of a box, which stay or go with it.
PARTS = frozenset("p li dt dd tr td th thead tbody tfoot caption figcaption table ul ol dl pre blockquote figure".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p "
    "pre search section summary table ul".split()
)
P, P_SCOPE = frozenset(["p"]), frozenset("button table td th caption object article section div body blockquote li".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select", "datalist"}}
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NUMBER = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
_TAG = re.compile(r"<[^<>]*>")
_MASK = (1 << 64) - 1
_DIGITS = re.compile(r"[0-9](?<!\w[0-9])[0-9]*\b")  # starts with a digit, not with a look behind, to be found fast
_PHRASE = re.compile(r"[.,;!?|\u00b7\u2022\u2026]+ ")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element. ``noise`` is what the prior says of it: "" (nothing), "never" (not shown), "form",
    "site" and "named" (furniture by tag or role, and by name), "own" (by name, and each page's own)."""

    __slots__ = ("tag", "sign", "parts", "noise", "inside", "holds", "headed", "chars", "total", "linked", "links")

    def __init__(self, tag: str, sign: str, inside: bool) -> None:
        self.tag, self.sign, self.inside, self.noise = tag, sign, inside, ""
        self.parts: list[Node | str] = []


class Tree(HTMLParser):
    """Builds a document tree the way browsers mend open and crossed elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", "", False)
        self.open = [self.root]
        self.count: Counter[str] = Counter()

    def _noise(self, tag: str, inside: bool, attrs: dict[str, str | None]) -> str:
        if tag in NEVER or "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style") or ""):
            return "never"
        if tag == "form":
            return "form"
        role = (attrs.get("role") or "").lower()
        if tag in SITE_TAGS or (tag == "header" and not inside) or role in ROLES:
            return "own" if inside or role in OWN_ROLES else "site"
        if tag in ("html", "body", "article", "main") or (inside and tag in HEADINGS):
            return ""
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
        if inside and tag == "section":  # its id is the anchor of a part of the article
            names = attrs.get("class") or ""
        found = {t.lower() for t in _TOKENS.findall(names)} & FURNITURE
        if inside and tag not in BOXES:
            found -= AMBIGUOUS
        return ("own" if found & OWN else "named") if found else ""

    def updatepos(self, i: int, j: int) -> int:
        """Lines and columns aren't asked for."""
        return j

    def _drop(self, k: int) -> None:
        for n in self.open[k:]:
            self.count[n.tag] -= 1
        del self.open[k:]

    def _close(self, tags: set[str] | frozenset[str], scope: set[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in tags:
                self._drop(k)
                return
            if tag in scope:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P:
            if self.count["p"]:
                self._close(P, P_SCOPE)
        if tag in SIBLINGS and any(self.count[t] for t in SIBLINGS[tag]):
            self._close(SIBLINGS[tag], SCOPES[tag])
        above = self.open[-1]
        inside = above.inside or above.tag in ("article", "main")
        if attrs:
            named = dict(attrs)
            marks = f"{named.get('class') or ''} {named.get('id') or ''}".split()
            node = Node(tag, tag + "".join(f".{re.sub(r'[0-9]+', '#', x)}" for x in sorted(marks)), inside)
            node.noise = self._noise(tag, inside, named)
        else:
            node = Node(tag, tag, inside)
            node.noise = self._noise(tag, inside, attrs={}) if tag in UNNAMED else ""
        above.parts.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.count[tag]:
            k = len(self.open) - 1
            while self.open[k].tag != tag:
                k -= 1
            self._drop(k)

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![`` opens a comment that ends at the next ``>``, as in browsers; the parser's own reading
        gives up on names that it doesn't know, and skips up to the next ``]>`` behind those that it knows."""
        return self.parse_bogus_comment(i)


def _measure(root: Node) -> list[Node]:
    """All elements, each before those below it, with what is below: whether the page's main part is (a
    ``main``, or an ``article`` with a headline), whether a headline is, the characters that only forms
    and names could remove, and all characters, those in links and the links."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(p for p in x.parts if isinstance(p, Node))
    for x in reversed(order):
        holds = headed = False
        chars = total = linked = links = 0
        for p in x.parts:
            if isinstance(p, str):
                n = len("".join(p.split()))
                chars += n
                total += n
            else:
                total += p.total
                if p.tag == "a":
                    linked += p.total
                    links += 1
                else:
                    linked += p.linked
                links += p.links
                headed = headed or p.headed or p.tag in ("h1", "h2")
                holds = holds or p.holds or p.tag == "main" or (p.tag == "article" and p.headed)
                if p.noise not in ("never", "site"):
                    chars += p.chars
        x.holds, x.headed, x.chars, x.total, x.linked, x.links = holds, headed, chars, total, linked, links
    return order


def _short_number(m: re.Match[str]) -> str:
    """A character reference without its leading zeros; one beyond Unicode is a replacement character."""
    mark, digits = ("&#x", m[0][3:]) if m[0][2] in "xX" else ("&#", m[0][2:])
    digits = digits.rstrip(";").lstrip("0") or "0"
    return f"{mark}{digits};" if len(digits) < 8 else "\ufffd"


def parse(html: str | None) -> Node:
    """The tree of a page. A layout box that is only named like furniture (``with-sidebar``) is none
    if it holds the main part. A form is none if it holds the main part or most of the page's text; its
    controls always go."""
    source = _NUMBER.sub(_short_number, html or "")  # Python refuses to read numbers of very many digits
    tree = Tree()
    try:
        tree.feed(source)
        tree.close()
    except (AssertionError, ValueError):  # no page known does this; its text stays whole, without any structure
        tree = Tree()
        tree.handle_data(_TAG.sub(" ", source))
    for x in _measure(tree.root):
        wraps = x.holds or 2 * x.chars > tree.root.chars  # one form around the page's text, not a part of it
        if (x.noise in ("named", "own") and x.holds) or (x.noise == "form" and wraps):
            x.noise = ""
    return tree.root


def _signed(x: int) -> int:
    x &= _MASK
    return x - (1 << 64) if x >> 63 else x


Elements = list[tuple[Node, int, int, list[str]]]


def _elements(root: Node) -> Elements:
    """(element, place of the one above, path's hash, words of its own text) of all elements that a tree may judge, each before those below it.

    A word ``|`` stands before and behind each link."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    order: Elements = []
    stack = [(root, -1, 0)]
    while stack:
        node, above, path = stack.pop()
        key = digest(node.sign, path)
        line: list[str] = []
        for p in node.parts:
            if isinstance(p, str):
                line.append(p)
            elif p.tag == "a" and not p.noise:
                line += [" | ", _all_text(p), " | "]  # a link's text is a phrase of its own
            elif p.tag in INLINE:
                line.append("" if p.noise else _all_text(p))
            else:
                line.append(" ")
                if p.noise not in ("never", "form", "own"):
                    stack.append((p, len(order), key))
        order.append((node, above, key, "".join(line).split()))
    return order


def features(root: Node, elements: Elements | None = None) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(element, presentation, phrases) of a page's elements by hashes, phrases with their words; places of one path are one element, and its phrases are a set."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    found: dict[int, tuple[list[int], set[tuple[int, int]]]] = {}
    for node, _, key, words in _elements(root) if elements is None else elements:
        shape, said = found.setdefault(key, ([0], set()))
        shape[0] += digest(">".join([p.sign for p in node.parts if isinstance(p, Node)]), 1)
        for x in _PHRASE.split(_DIGITS.sub("#", " ".join(words)) + " ") if words else ():
            x = x.strip()
            if x:
                h = digest(x, 2)
                said.add((h - (1 << 64) if h >> 63 else h, x.count(" ") + 1))
    return [(_signed(key), _signed(shape[0]), sorted(said)) for key, (shape, said) in sorted(found.items())]


#: Of an element of a host: pages that have it, importance of its presentation, importance of its content.
Known = dict[int, tuple[int, float, float]]


def judge(root: Node, tree: Known, *, prior: bool = True, elements: Elements | None = None) -> tuple[set[int], set[int]]:
    """Elements that go, and elements of which only their own text goes, both by ``id``.

    Without ``prior`` neither tags nor names count: only the tree decides (used to measure its worth).
    """
    order = _elements(root) if elements is None else elements
    main = prior and _has_main(root)
    size, said, wraps = [0] * len(order), [0.0] * len(order), [False] * len(order)
    gone: set[int] = set()
    mute: set[int] = set()
    inside = [False] * len(order)
    for k, (node, above, _, _) in enumerate(order):
        inside[k] = (above >= 0 and inside[above]) or node.tag in ("article", "main")
    for k in range(len(order) - 1, -1, -1):
        node, above, key, tokens = order[k]
        pages, shape, content = tree.get(_signed(key), (1, 1.0, 1.0))
        words = len(tokens) - tokens.count("|")
        size[k] += words
        said[k] += words * content
        wraps[k] = wraps[k] or (node.tag in ("article", "main") and not node.noise)
        if above >= 0:
            size[above] += size[k]
            said[above] += said[k]
            wraps[above] = wraps[above] or wraps[k]
        kind = PLAIN
        if node.tag in ("#root", "html", "body") or node.tag in HEADINGS or (prior and wraps[k] and not node.noise):
            kind = KEPT  # a headline says little but belongs to what follows it
        if prior and (node.noise or (main and not inside[k] and kind != KEPT) or (not main and not inside[k] and kind == PLAIN and _menu(node))):
            kind = SITE
        if kind == KEPT:
            if main and not inside[k] and words and _drawn(pages, content, SITE) < BOUND:
                mute.add(id(node))
            continue
        if kind == PLAIN and node.tag in PARTS and (inside[k] or node.sign == node.tag):
            continue
        value = max(shape, said[k] / size[k]) if size[k] else 1.0
        if (_drawn(pages, value, kind) if prior else value) < BOUND:
            gone.add(id(node))
    return gone, mute


def _drawn(pages: int, value: float, kind: int) -> float:
    """An importance seen on so many pages, drawn toward what is known of such elements."""
    return value * pages / (pages + SAME_PAGES) if kind == SITE else (value * pages + OTHER_PAGES) / (pages + OTHER_PAGES)


def _all_text(node: Node) -> str:
    out: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack.extend(reversed(x.parts))
    return "".join(out)


def _has_main(root: Node) -> bool:
    stack = [root]
    while stack:
        node = stack.pop()
        for p in node.parts:
            if isinstance(p, Node) and not p.noise:
                if p.tag in ("article", "main"):
                    return True
                stack.append(p)
    return False


def _menu(node: Node) -> bool:
    """A list or box whose text is nearly all links, three or more; a ``nav`` whose text is mostly links."""
    if node.tag not in ("ul", "ol", "dl", "div", "table", "section", "nav"):
        return False
    return node.linked >= 0.5 * node.total if node.tag == "nav" else node.links >= 3 and node.linked >= 0.85 * node.total


def extract(root: Node, tree: Known | None = None, *, prior: bool = True, elements: Elements | None = None) -> str:
    """Text blocks of a page in order, one per line, without the branches that ``judge`` removes and those that no tree can judge."""
    gone, mute = judge(root, tree or {}, prior=prior, elements=elements)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    stack: list[tuple[Node | str | None, bool]] = [(root, False)]
    while stack:
        x, muted = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            if not muted:
                line.append(x)
        elif x.tag == "br":
            line.append(" ")
        else:
            if x.noise in ("never", "form", "own") or (x.noise and x.tag in INLINE) or id(x) in gone:
                if x.tag not in INLINE:
                    flush()
                continue
            if x.tag not in INLINE:
                flush()
                stack.append((None, False))
                muted = id(x) in mute
            stack.extend((p, muted) for p in reversed(x.parts))
    flush()
    return "\n".join(blocks)


_PHRASES = pa.list_(pa.struct([("x", pa.int64()), ("words", pa.int32())]))
_ELEMENTS = pa.list_(pa.struct([("key", pa.int64()), ("shape", pa.int64()), ("phrases", _PHRASES)]))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts, elements = [], []
            for html in part.column(1).to_pylist():
                root = parse(html)
                order = _elements(root)
                texts.append(_signed(xxhash.xxh3_64_intdigest(extract(root, elements=order) or html or "")))
                elements.append(features(root, order))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.int64()), pa.array(elements, _ELEMENTS)], names=["host", "text", "elements"])


def host_of(url: F.Column) -> F.Column:
    """Host of a url in lower case without the user and the port; empty where there is none."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def importance(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The merged tree of every host: ``host, key, pages, shape, content``; ``pages`` counts texts, the others are importances.

    Rows of one text (what the prior leaves of a page) are one page, so copies of an article don't make it look like
    furniture. Features are counted before they meet by element, so a host with a third of all pages is no larger a
    group than its template, and an element of very many phrases is summed in parts.
    """
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col)).mapInArrow(
        _feature_rows, "host string, text long, elements array<struct<key: long, shape: long, phrases: array<struct<x: long, words: int>>>>"
    )
    once = rows.groupBy("host", "text").agg(F.min("elements").alias("elements")).select("host", F.explode("elements").alias("e")).select("host", "e.*")
    shape = F.struct(F.col("shape").alias("x"), F.lit(0).alias("words"))
    both = once.select("host", "key", F.explode(F.concat(F.array(shape), "phrases")).alias("f"))
    counts = both.groupBy("host", "key", "f.words", "f.x").agg(F.count(F.lit(1)).alias("c"))
    total = lambda x: F.sum(F.when(F.col("words") == 0, x))  # noqa: E731 - of presentations
    weighed = F.col("c") * F.log("c")
    sums = counts.groupBy("host", "key").agg(
        total(F.col("c")).alias("pages"), total(weighed).alias("shapes"), F.sum(F.col("words") * F.col("c")).alias("said"), F.sum(F.col("words") * weighed).alias("phrases")
    )
    entropy = lambda clogc, n: F.when((F.col("pages") > 1) & (F.col(n) > 0), F.greatest(F.lit(0.0), 1 - F.col(clogc) / (F.col(n) * F.log("pages")))).otherwise(F.lit(1.0))
    return sums.select("host", "key", "pages", entropy("shapes", "pages").alias("shape"), entropy("phrases", "said").alias("content"))


def trees(known: DataFrame) -> DataFrame:
    """``host, tree``: the elements of a host that two of its texts or more have, in one row. A host's row is as large as its template."""
    return known.filter("pages > 1").groupBy("host").agg(F.collect_list(F.struct("key", F.col("pages").cast("int").alias("pages"), "shape", "content")).alias("tree"))


def _known(tree: pa.ListScalar) -> Known:
    if not tree.is_valid:
        return {}
    e = tree.values
    key, pages, shape, content = (e.field(k).to_pylist() for k in range(4))
    return dict(zip(key, zip(pages, shape, content, strict=True), strict=True))


def _extract_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: tuple[str | None, Known] = (None, {})  # of the last host, so that memory stays bounded
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            out: list[str] = [""] * part.num_rows
            hosts, html = part.column(3).to_pylist(), part.column(2).to_pylist()
            for k in sorted(range(part.num_rows), key=hosts.__getitem__):
                if cache[0] != hosts[k]:
                    cache = (hosts[k], _known(part.column(4)[k]))
                root = parse(html[k])
                out[k] = extract(root, cache[1]) or extract(root)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )


def main_text(pages: DataFrame, scratch: Scratch, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    A null or empty page, and a page of nothing but furniture, has an empty text. Pages without a
    host are a site of their own. Null ids stay; repeated rows are returned as often; an empty
    table gives no rows; other columns, whatever their names, are ignored. The pages themselves are never shuffled while
    the trees are small, which is counted first; beyond that they are joined by host.
    """
    known = scratch.table(trees(importance(pages, url_col=url_col, html_col=html_col)), "trees")
    size = known.agg(F.sum(F.size("tree"))).first()[0] or 0
    sent = F.broadcast(known) if size <= SENT else known
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = rows.join(sent, "host", "left").select("page_id", "url", "html", "host", "tree")
    return joined.mapInArrow(_extract_rows, "page_id long, url string, text string, n_chars long")
