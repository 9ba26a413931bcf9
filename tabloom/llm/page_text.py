"""Main text of web pages by site template removal.

Each page is parsed once: block-level subtrees are hashed, and the text blocks keep the hashes of the subtrees around
them. Spark counts, per host, on how many different pages a subtree occurs; subtrees that recur across many pages of
their host are its template and their blocks are deleted. Elements that say by tag, role, class or id that they are
no article (menus, adverts, comments and the like) are left out as well, and if a page marks an article, only blocks
inside it count.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import stored
from tabloom.llm.url_filter import host_of

#: A subtree is template when it is on at least so many different pages of a host and on this share of them.
MIN_PAGES, MIN_SHARE = 5, 0.2
#: Elements nested deeper are not tracked, as in browsers; their text belongs to the element at this depth.
MAX_DEPTH = 512

# Element names of the HTML standard and common names of page parts.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPH = set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr tbody thead tfoot table caption figcaption figure ul ol dl".split())
SKIPPED = set("head nav header footer aside form button select datalist input menu dialog object canvas audio video svg math template search output fieldset".split())
INSIDE_ARTICLE = {"header"}
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Parts that are never the article, and parts whose name may also stand on a wrapper of it.
NOISE = set("ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored promo promotion promotions cookie cookies consent gdpr comment comments "
            "disqus reply replies respond related recommended share sharing social newsletter subscribe subscription signup login popup modal breadcrumb breadcrumbs "
            "pagination pager tagcloud outbrain taboola paywall".split())
MAYBE = set("nav navbar navigation menu menus sidebar sidebars aside rail header footer masthead banner toolbar topbar widget widgets notice notices alert disclaimer copyright skip form forms search".split())
CLOSES_P = BLOCK - {"optgroup", "option", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt", "legend", "summary", "body", "html", "figcaption"} | {"li", "dd", "dt"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
          "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "tbody": {"td", "th", "tr", "thead", "tbody"}, "tfoot": {"td", "th", "tr", "tbody"}}
SCOPE = set("ul ol dl table select td th article section div main body html".split())

_ATTRS = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+"""
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"|<(?P<raw>script|style|noscript|iframe|textarea|title|xmp|noembed|noframes)(?=[\s/>]){_ATTRS}>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>{_ATTRS})(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)", re.I | re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?(?=[\s/]|\Z)""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Element:
    __slots__ = ("name", "parts", "noise", "maybe", "main", "mark")

    def __init__(self, name: str):
        self.name, self.parts, self.noise, self.maybe, self.main, self.mark = name, None, False, False, False, 0


def _judge(element: _Element, attrs: str, in_article: bool) -> None:
    """Set whether an element is noise for certain, or unless the article lies within it."""
    name = element.name
    if name in SKIPPED and not (in_article and name in INSIDE_ARTICLE):
        element.noise = name not in ("form", "aside", "header", "fieldset")
        element.maybe = not element.noise
    if not attrs or attrs.isspace():
        return
    words: set[str] = set()
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            words.update(w.lower() for w in _WORDS.findall(value))
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            element.noise = True
        elif key == "role" and value.lower() in ROLES:
            element.maybe = True
    if name not in ("html", "body", "main"):
        element.noise |= not words.isdisjoint(NOISE)
        element.maybe |= name != "article" and not words.isdisjoint(MAYBE)


def parse(page: str | None) -> tuple[list[tuple[str, list[int]]], list[int]]:
    """``(blocks, marks)``: candidate text blocks in page order, each with the hashes of the subtrees around it, and
    the hashes of all subtrees that may turn out as template (signed 64-bit)."""
    from xxhash import xxh64_intdigest

    page = page or ""
    stack: list[_Element] = []
    open_names: dict[str, int] = {}
    found: list[tuple[str, list[_Element]]] = []
    marks: list[int] = []
    text: list[str] = []

    def flush() -> None:
        words = " ".join("".join(text).split())
        text.clear()
        if words:
            found.append((words, stack.copy()))

    def pop() -> None:
        e = stack.pop()
        open_names[e.name] -= 1
        if e.parts is not None:
            digest = xxh64_intdigest("\x1f".join(e.parts), 7)
            e.mark = digest - (1 << 64) if digest >> 63 else digest
            marks.append(e.mark)
            for up in reversed(stack):
                if up.parts is not None:
                    up.parts.append(str(e.mark))
                    break

    def close(names: set[str]) -> None:
        """End the nearest open element of ``names`` within its scope, and what is open inside it."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name in names:
                flush()
                while len(stack) > i:
                    pop()
                return
            if stack[i].name in SCOPE:
                return

    def add(chunk: str) -> None:
        decoded = references.unescape(chunk) if "&" in chunk else chunk
        text.append(decoded)
        for e in reversed(stack):
            if e.parts is not None:
                e.parts.append(decoded)
                break
            if e.main:
                break

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if open_names.get(name) and name not in ("html", "body"):
                if name in BLOCK:
                    flush()
                    while stack[-1].name != name:
                        pop()
                    pop()
                else:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i].name == name:
                            if stack[i].noise:
                                flush()
                            open_names[name] -= 1
                            del stack[i]
                            break
                        if stack[i].name in BLOCK:
                            break
            elif name in BLOCK:
                flush()
            continue
        if name in CLOSES_P and open_names.get("p"):
            close({"p"})
        if name in CLOSES and any(open_names.get(x) for x in CLOSES[name]):
            for x in CLOSES[name]:
                if open_names.get(x):
                    close({x})
        if name in BLOCK:
            flush()
        elif name == "br":
            text.append(" ")
        if name in VOID:
            continue
        e, in_main = _Element(name), any(x.main for x in stack)
        _judge(e, m["attrs"], in_main)
        if e.noise and name not in BLOCK:
            flush()
        if name in ("article", "main") and not e.noise:
            e.main = not any(x.noise for x in stack)
            if e.main:
                for x in stack:
                    x.maybe, x.parts = False, None
        if name in BLOCK and name not in ("html", "body", "article", "main") and not (in_main and name in PARAGRAPH):
            e.parts = [name, m["attrs"]]
        if len(stack) < MAX_DEPTH and not (name in ("svg", "math") and m["attrs"].endswith("/")):
            stack.append(e)
            open_names[name] = open_names.get(name, 0) + 1
    if at < len(page):
        add(page[at:])
    flush()
    while stack:
        pop()
    kept = [(t, around) for t, around in found if not any(e.noise or e.maybe for e in around)]
    for kind in ("article", "main"):
        if inside := [b for b in kept if any(e.main and e.name == kind for e in b[1])]:
            kept = inside
            break
    return [(t, [e.mark for e in around if e.parts is not None]) for t, around in kept], marks


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars, n_template)`` per row; ``n_template`` counts the subtrees deleted around text.

    Null or blank pages have an empty text. Pages count once per host and content, so copies of one page make no
    template; pages without a host keep all their subtrees. Repeated rows stay repeated.
    """
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        block = pa.list_(pa.struct([("text", pa.string()), ("marks", pa.list_(pa.int64()))]))
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                parsed = [parse(h) for h in part.column("html").to_pylist()]
                blocks = pa.array([[{"text": t, "marks": k} for t, k in p[0]] for p in parsed], block)
                marks = pa.array([sorted(set(p[1])) for p in parsed], pa.list_(pa.int64()))
                yield pa.record_batch([*[part.column(c) for c in ("page_id", "url", "host", "variant")], blocks, marks],
                                      names=["page_id", "url", "host", "variant", "blocks", "marks"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"),
                        F.xxhash64(html_col).alias("variant"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    parsed = stored(rows.mapInArrow(run, f"page_id {kind}, url string, host string, variant long, blocks array<struct<text:string,marks:array<bigint>>>, marks array<bigint>"), "parsed-pages")
    gone = stored(_template_marks(parsed), "template-subtrees").withColumnsRenamed({"host": "g_host", "variant": "g_variant"})
    joined = parsed.join(gone, (parsed["host"] == gone["g_host"]) & (parsed["variant"] == gone["g_variant"]), "left")
    kept = F.when(F.col("gone").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda x: ~F.arrays_overlap(x["marks"], F.col("gone"))))
    text = F.array_join(F.transform(kept, lambda x: x["text"]), "\n")
    return joined.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"),
                         F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_template"))


def _template_marks(parsed: DataFrame) -> DataFrame:
    """``(host, variant, gone)``: the subtrees around text of each different page that its host repeats.

    A hot host is no hot key: its subtrees are counted by (host, subtree) after a map-side count, and only those above
    MIN_PAGES meet the host's size. All subtrees are counted, but a page is listed only if one of them holds a block
    that would stay otherwise, so the texts meet no more than they need.
    """
    sited = parsed.where("host <> ''")
    on_page = sited.select("host", "variant", F.explode("marks").alias("mark")).distinct()
    pages = sited.select("host", "variant").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    counts = on_page.groupBy("host", "mark").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    template = counts.join(pages, "host").where(F.col("n") >= MIN_SHARE * F.col("pages")).select("host", "mark")
    around = F.flatten(F.transform("blocks", lambda x: x["marks"]))
    live = sited.select("host", "variant", F.explode(around).alias("mark")).distinct()
    return live.join(template, ["host", "mark"]).groupBy("host", "variant").agg(F.collect_set("mark").alias("gone"))
