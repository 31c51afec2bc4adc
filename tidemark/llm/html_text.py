"""Main text of web pages: subtrees that recur across a host are counted by Spark and deleted; tag rules drop what doesn't recur."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch, cut

# Element and word lists of the tag rules.
RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes", "template", "svg", "select", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "dd", "dt", "td", "th", "tr", "figcaption", "figure", "caption", "summary"}
PARAGRAPHS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
CLOSES_ITSELF = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select", "datalist")}
DROPPED_TAGS = {"nav", "footer", "aside", "form", "head", "button", "menu", "dialog", "search", "fieldset", "label", "datalist", "map", "dir"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "status"}
DROPPED_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox adunit sponsor sponsored sponsors promo promos promotion "
    "promoted banner sidebar sidebars rail nav navbar navigation topnav subnav menu menus submenu breadcrumb breadcrumbs pagination pager toolbar footer foot colophon masthead "
    "topbar comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices alert alerts newsletter subscribe "
    "subscription signup login signin register paywall popup modal overlay lightbox share sharing social related recommended recommendations trending "
    "widget widgets disclaimer copyright legal skip search searchbox form hidden".split()
)
# Inside a marked article these drop by any part of a class; other words only where the rest of the class says no more than a box does.
PLAIN_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox adunit sponsored sponsors promo promos promoted sidebar navbar topnav subnav "
    "breadcrumb breadcrumbs pagination pager comment comments commentlist disqus cookie cookies gdpr newsletter paywall popup".split()
)
BOX_WORDS = set(
    "area articles bar block bottom box bottom button buttons container content group icon icons inner item items left line link links list media "
    "outer page panel posts reader right row section site slot stories this top unit user wrap wrapper".split()
)
SOFT_WORDS = {"header", "heading", "head"}
CONTENT_WORDS = {"article", "content", "body", "main", "post", "entry", "story", "text"}

TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>?",
    re.DOTALL,
)
ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
DIGITS = re.compile(r"[0-9]+")
NEGATED = re.compile(r"\b(?:no|has|with|without|hide)[-_](\w+)")


def _furniture(value: str, tag: str, in_article: bool) -> bool:
    """Whether a class or id names what isn't main text; in an article a word that also names subjects (social-history) must stand by itself."""
    if tag == "article":
        return bool(set(value.split()) & DROPPED_WORDS)
    for token in value.split():
        parts = set(re.split(r"[^a-z0-9]+", token)) - {""}
        if parts & DROPPED_WORDS and (not in_article or parts & PLAIN_WORDS or all(x in DROPPED_WORDS or x in BOX_WORDS or len(x) == 1 or x[0].isdigit() for x in parts)):
            return True
    return False


def _dropped(tag: str, attrs: str, in_article: bool = False) -> str:
    """'all' if the element isn't main text, 'soft' if only its headings are, else ''."""
    if tag in DROPPED_TAGS:
        return "all"
    kind = "soft" if tag == "header" else ""
    if not attrs or attrs.isspace():
        return kind
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "all"
        if name == "role" and value.strip() in DROPPED_ROLES:
            return "all"
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            value = NEGATED.sub(" ", value)
            if _furniture(value, tag, in_article):
                return "all"
            words = set(re.split(r"[^a-z0-9]+", value))
            if tag != "article" and words & SOFT_WORDS and not words & CONTENT_WORDS:
                kind = "soft"
    return kind


class Page:
    """Blocks of text and the elements around them.

    ``elements`` holds [tag, parent, hash of the subtree, characters that the tag rules leave, all characters, link
    characters, hash of the subtree's shape]; ``blocks`` holds (element, text, link characters, whether the rules drop it).
    A shape is tags, class words without digits and marks for text and links; repeats in a row are one.
    """

    def __init__(self, source: str):
        self.elements: list[list] = [["#root", -1, 0, 0, 0, 0, 0]]
        self.blocks: list[tuple[int, str, int, bool]] = []
        self._digests = [xxhash.xxh64()]
        self._shapes: list[list[str]] = [[]]
        self._stack, self._drops, self._in_article = [0], [""], [False]
        self._line: list[str] = []
        self._linked = 0
        self._read(source)
        while len(self._stack) > 1:
            self._pop()
        self._flush()
        self.elements[0][2] = self._digests[0].intdigest()

    def _flush(self) -> None:
        if self._line:
            text = " ".join(html.unescape("".join(self._line)).split())
            if text:
                at = self._stack[-1]
                dropped = bool(self._drops[-1])
                self.blocks.append((at, text, self._linked, dropped))
                self._digests[at].update(text.encode("utf-8", "replace"))
                self.elements[at][3] += 0 if dropped else len(text)
                self.elements[at][4] += len(text)
                self.elements[at][5] += min(self._linked, len(text))
                self._mark(at, "a" if self._linked >= 0.5 * len(text) else "t")
            self._line, self._linked = [], 0

    def _mark(self, at: int, shape: str) -> None:
        if self._shapes[at][-1:] != [shape]:
            self._shapes[at].append(shape)

    def _pop(self) -> None:
        at = self._stack[-1]
        tag, up = self.elements[at][:2]
        self._flush()
        self._stack.pop()
        self._drops.pop()
        self._in_article.pop()
        digest = self._digests[at].intdigest()
        self.elements[at][2] = digest
        self.elements[up][3] += self.elements[at][3]
        self.elements[up][4] += self.elements[at][4]
        self.elements[up][5] += self.elements[at][5]
        if self.elements[at][4]:
            self._digests[up].update(f"<{tag} {digest}>".encode())
            self.elements[at][6] = xxhash.xxh64_intdigest("shape " + " ".join(self._shapes[at]))
            self._mark(up, f"<{self.elements[at][6]}>")
        self._shapes[at] = []

    def _close(self, tags: set[str] | tuple[str, ...], scope: set[str] | tuple[str, ...] = ()) -> None:
        for i in range(len(self._stack) - 1, 0, -1):
            name = self.elements[self._stack[i]][0]
            if name in tags:
                while len(self._stack) > i:
                    self._pop()
                return
            if name in scope:
                return

    def _open(self, tag: str, attrs: str) -> None:
        self._flush()
        drop, kind = self._drops[-1], _dropped(tag, attrs, self._in_article[-1])
        if drop == "all" or kind == "all":
            drop = "all"
        elif drop == "soft" or kind == "soft":
            drop = "" if tag in HEADINGS and any(self.elements[i][0] in ("article", "main") for i in self._stack) else "soft"
        self.elements.append([tag, self._stack[-1], 0, 0, 0, 0, 0])
        self._digests.append(xxhash.xxh64())
        named = CLASS.search(attrs) if attrs else None
        self._shapes.append([f"{tag}.{DIGITS.sub('', named[1] or named[2] or named[3]).lower()}" if named else tag])
        self._in_article.append(self._in_article[-1] or tag == "article")
        self._stack.append(len(self.elements) - 1)
        self._drops.append(drop)

    def _read(self, source: str) -> None:
        at, inline = 0, []  # inline: open inline elements that drop text, and links
        for m in iter(lambda: TAG.search(source, at), None):
            if m.start() > at and "drop" not in inline:
                self._text(source[at : m.start()], "a" in inline)
            at = m.end()
            if m[1]:
                tag = m[1].lower()
                if tag in BLOCK or tag in DROPPED_TAGS:
                    self._close({tag}, {"td", "th"} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "article", "main", "body", "html") else ())
                    inline = []
                elif tag == "a" and "a" in inline:
                    inline.remove("a")
                elif tag == "span" and inline and inline[-1] in ("drop", "span"):
                    inline.pop()
                continue
            tag, attrs = (m[2] or m[4] or "").lower(), m[3] or m[5] or ""
            if not tag:
                if m[0].startswith("<![CDATA["):
                    self._text(html.escape(m[0][9:-3], quote=False), False)
                continue
            if (tag in RAW or tag == "noscript" and not self._in_article[-1]) and not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(source, at)
                at = end.end() if end else len(source)
            elif tag == "br" or tag in ("img", "wbr", "input") or tag in VOID and tag != "hr":
                if tag == "br":
                    self._line.append(" ")
            elif tag == "hr":
                self._close({"p"})
                self._flush()
            elif tag in BLOCK or tag in DROPPED_TAGS:
                inline = []
                if tag in CLOSES_ITSELF:
                    also = {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}
                    self._close(also, CLOSES_ITSELF[tag])
                if tag not in ("td", "th", "tr", "tbody", "thead", "tfoot", "option"):
                    self._close({"p"}, ("td", "th", "caption"))
                self._open(tag, attrs)
            elif tag == "a":
                inline = [x for x in inline if x != "a"] + ["a"]
            elif tag == "span" and not attrs.endswith("/"):
                inline.append("drop" if _dropped(tag, attrs, self._in_article[-1]) == "all" else "span")
        if at < len(source) and "drop" not in inline:
            self._text(source[at:], False)

    def _text(self, text: str, linked: bool) -> None:
        self._line.append(text)
        self._linked += linked * len(text)

    def _within(self, roots: set[int]) -> list[bool]:
        inside: list[bool] = []
        for i, e in enumerate(self.elements):
            inside.append(i in roots or e[1] >= 0 and inside[e[1]])
        return inside

    def main(self) -> tuple[bool, set[int], list[bool]]:
        """Whether the article is marked, the elements that hold it (the page, if not), and which elements lie in them.

        All outermost articles that the rules leave, in <main> if some are there; <main> itself if it has over twice their text.
        """
        tags, n = [e[0] for e in self.elements], [e[3] for e in self.elements]
        in_main = self._within({i for i, tag in enumerate(tags) if tag == "main"})
        nested = self._within({i for i, tag in enumerate(tags) if tag == "article"})
        found = [i for i, tag in enumerate(tags) if tag == "article" and n[i] and not nested[self.elements[i][1]]]
        found = [i for i in found if in_main[i]] or found
        largest = max((i for i, tag in enumerate(tags) if tag == "main"), key=lambda i: (n[i], -i), default=0)
        roots = {largest} if largest and n[largest] > 2 * sum(n[i] for i in found) else set(found) or {0}
        return roots != {0}, roots, self._within(roots)

    def _furniture(self) -> list[tuple[bool, bool]]:
        """Which elements may be site furniture by their text and by their shape.

        Never what holds the article. By text: in a page with a marked article boxes, not prose. By shape, since pages'
        prose has few shapes: what lies outside of a marked article, and in a page without one what is links for 70 %.
        """
        marked, roots, inside = self.main()
        holds: set[int] = set()
        for at in roots:
            while at >= 0 and at not in holds:
                holds.add(at)
                at = self.elements[at][1]
        out = []
        for i, e in enumerate(self.elements):
            may = i not in holds and e[4] > 0 and e[0] not in ("body", "html")
            out.append((may and (not marked or e[0] not in PROSE), may and (not inside[i] if marked else e[5] >= 0.7 * e[4])))
        return out

    def subtrees(self) -> set[int]:
        """Hashes of the subtrees that may be site furniture, and of their shapes."""
        both = list(zip(self.elements, self._furniture(), strict=True))
        return {_signed(e[2]) for e, (text, _) in both if text} | {_signed(e[6]) for e, (_, shape) in both if shape}

    def body_hash(self) -> int:
        """A hash of the article as the rules leave it: pages that differ around it only are copies."""
        inside = self.main()[2]
        return _signed(xxhash.xxh64_intdigest("\n".join(text for at, text, _, dropped in self.blocks if inside[at] and not dropped).encode("utf-8", "replace")))

    def read(self, templates: set[int]) -> tuple[str, int]:
        """The main text, and how many blocks the templates took."""
        marked, _, inside = self.main()
        gone: list[bool] = []
        for e, (text, shape) in zip(self.elements, self._furniture(), strict=True):
            gone.append((e[1] >= 0 and gone[e[1]]) or (text and _signed(e[2]) in templates) or (shape and _signed(e[6]) in templates))
        prose = lambda at: self.elements[at][0] in PARAGRAPHS
        kept = [text for at, text, linked, dropped in self.blocks if not (gone[at] or dropped) and inside[at] and (marked or linked < 0.7 * len(text) or prose(at))]
        return "\n\n".join(kept), sum(gone[at] for at, *_ in self.blocks)

    def text(self, templates: set[int]) -> str:
        return self.read(templates)[0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 5, min_share: float = 0.2, broadcast_rows: int = 200_000) -> DataFrame:
    """One row per row of ``pages``: (id_col, url_col, text, n_chars, n_template_blocks).

    The subtrees of all pages are hashed, by their text and by their shape, and counted per host, once for each distinct
    article, so copies of a page don't make its article a template; those on at least ``min_pages`` articles and
    ``min_share`` of the host's are deleted (n_template_blocks: the blocks of text that go with them). A host has so few of
    them that its list is bounded by (subtrees of a page / min_share). Shapes find menus, adverts and footers whose words
    change from page to page; they never delete what lies in a marked article, nor prose. Tag, role and class rules then
    drop what isn't the article and doesn't recur: adverts within it, reader comments, sidebars of a host with few pages.
    All articles of a page stay (those in <main>, if some are); recurring paragraphs, list items, headings and cells in them
    stay too, since near copies of an article share them. In a page without a marked article, list items, cells and bare
    boxes that are links for 70 % go; paragraphs of links stay unless they recur. Null or empty html gives an empty text;
    a null or odd url is host ''; a null id is one like any other. Very long pages are read whole, in one pass.
    Repeated rows each get a row; extra columns are left out; no row gives no row.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), HOST, 1)).alias("host"), F.col(html_col).alias("html"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            host, tree, body = [], [], []
            for h, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = Page(source or "")
                found = {0} | page.subtrees()  # 0 counts the bodies of the host
                host += [h] * len(found)
                tree += found
                body += [page.body_hash()] * len(found)
            yield batch(host=host, tree=pa.array(tree, pa.int64()), body=pa.array(body, pa.int64()))

    counted = rows.select("host", "html").mapInArrow(hashes, "host string, tree bigint, body bigint").distinct().groupBy("host", "tree").count()
    counted = cut(counted.where((F.col("count") >= min_pages) | (F.col("tree") == 0)))
    totals = counted.where("tree = 0").select("host", F.col("count").alias("bodies"))
    shared = counted.where("tree <> 0").join(totals, "host").where(F.col("count") >= min_share * F.col("bodies"))
    templates = shared.groupBy("host").agg(F.collect_set("tree").alias("templates"))
    if shared.count() <= broadcast_rows:
        templates = F.broadcast(templates)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = [Page(source or "").read(set(t or ())) for source, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            texts, n = [x[0] for x in read], [x[1] for x in read]
            yield batch(id=b.column(0), url=b.column(1), text=pa.array(texts, pa.string()), n_chars=pa.array(map(len, texts), pa.int64()), n_template_blocks=pa.array(n, pa.int64()))

    kind = pages.schema[id_col].dataType.simpleString()
    found = rows.join(templates, "host", "left").select("id", "url", "html", "templates").mapInArrow(extract, f"id {kind}, url string, text string, n_chars bigint, n_template_blocks bigint")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars", "n_template_blocks")
