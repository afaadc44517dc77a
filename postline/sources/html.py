"""Card extraction from raw pages (S3) and the posting clean-up chain
(A3 -> P3 -> P2 -> F2 -> P4).

Two paths:
* ``extract_list_cards`` -- pages whose cards are ``<li><a href>`` items:
  pure ``regexp_extract_all`` + ``posexplode``, JVM-side.
* ``extract_cards`` -- the board profiles (ordered CSS selector fallbacks
  per field).  CSS matching needs a DOM, so each partition is parsed with
  the standard-library ``html.parser`` inside ``mapInPandas`` (Arrow
  batches); Spark still distributes the pages.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postline import rules
from postline.functions import urls
from postline.operators.dedup import cap_per_task
from postline.operators.filters import valid_postings

CARD_SCHEMA = ("page_id bigint, site string, query string, position int, title string, company string, "
               "url string, location string, base_url string, error string")

_LI_A = r'(?is)<li[^>]*>\s*<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'


def html_text(c):
    """innerText-like: tags removed, common entities decoded, trimmed."""
    t = F.regexp_replace(c, r"(?s)<[^>]*>", "")
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def extract_list_cards(pages: DataFrame) -> DataFrame:
    """S3 (list profile): one card per ``<li><a href=..>text</a>`` in page
    order; company defaults to 'Unknown', location to 'Israel'; the page's
    origin is the base URL and its id the task's query."""
    links = F.regexp_extract_all(F.col("html"), F.lit(_LI_A), 1)
    texts = F.regexp_extract_all(F.col("html"), F.lit(_LI_A), 2)
    p = pages.select("page_id", "url", F.posexplode(F.arrays_zip(links.alias("link"), texts.alias("text"))))
    return p.select(
        "page_id", urls.url_host(F.col("url")).alias("site"), F.col("page_id").cast("string").alias("query"),
        (F.col("pos") + 1).alias("position"), html_text(F.col("col.text")).alias("title"),
        F.lit(rules.UNKNOWN_COMPANY).alias("company"), F.col("col.link").alias("url"),
        F.lit(rules.DEFAULT_CARD_LOCATION).alias("location"), urls.url_origin(F.col("url")).alias("base_url"))


def clean_postings(cards: DataFrame, cap: int | None = None) -> DataFrame:
    """P3, P2, F2 and P4 over all cards; with ``cap`` only over the first ones of
    each (site, query) in page order (A3)."""
    c = valid_postings(cards if cap is None else cap_per_task(cards, cap))
    link = urls.absolutise_link(F.col("url"), F.col("base_url"))
    site_cap = F.concat(F.upper(F.substring(F.col("site"), 1, 1)), F.lower(F.substring(F.col("site"), 2, 1 << 20)))
    desc = F.concat(site_cap, F.lit(" Job: "), F.col("title"), F.lit(" @ "), F.coalesce(F.col("company"), F.lit("Unknown")))
    return c.withColumn("url", urls.normalize_url_strict(link)).withColumn("description", desc)


# ---------------------------------------------------------------------------
# Profile-driven extraction (board selectors)
# ---------------------------------------------------------------------------
class _Node:
    __slots__ = ("tag", "attrs", "keys", "children", "parent")

    def __init__(self, tag, attrs, keys, parent):
        self.tag, self.attrs, self.keys, self.parent, self.children = tag, attrs, keys, parent, []


def _keys(tag, attrs):
    """What a selector for such an element may ask for: nothing, the tag or a class."""
    return ("", tag, *("." + c for c in attrs.get("class", "").split()))


# a start tag with quoted values and without entities; pages repeat most of them
_PLAIN_TAG = re.compile(r"""<[a-zA-Z][a-zA-Z0-9]*(?:[ \t\r\n]+[a-zA-Z][a-zA-Z0-9_-]*=(?:'[^'<>&]*'|"[^"<>&]*"))*>""")
_PLAIN_ATTR = re.compile(r"""([a-zA-Z][a-zA-Z0-9_-]*)=(?:'([^']*)'|"([^"]*)")""")
_RAW_TEXT = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"}


@lru_cache(4096)
def _plain_tag(text):
    tag = re.match("[a-zA-Z0-9]+", text[1:]).group().lower()
    attrs = {k.lower(): a or b for k, a, b in _PLAIN_ATTR.findall(text)}
    return None if tag in _RAW_TEXT else (tag, attrs, _keys(tag, attrs))


_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


# FIXED VALUES -- elements whose end tag HTML lets authors leave out: a start tag
# ends the open elements named first, inside the nearest element named second
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr"}),
    "th": ({"td", "th"}, {"tr"}),
    "option": ({"option"}, {"select", "datalist"}),
}
_ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
           "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root", {}, ("", "#root"), None)
        self.cur = self.root

    def _end(self, names, scope):
        n, last = self.cur, None
        while n is not self.root and n.tag not in scope:
            last = n if n.tag in names else last
            n = n.parent
        if last is not None:
            self.cur = last.parent

    def parse_starttag(self, i):
        m = _PLAIN_TAG.match(self.rawdata, i)
        plain = m and _plain_tag(m.group())
        if not plain:
            return super().parse_starttag(i)
        self.lasttag = plain[0]
        self._open(*plain)
        return m.end()

    def handle_starttag(self, tag, attrs):
        attrs = {k: (v or "") for k, v in attrs}
        self._open(tag, attrs, _keys(tag, attrs))

    def _open(self, tag, attrs, keys):
        if tag in _IMPLIED:
            self._end(*_IMPLIED[tag])
        elif tag in _ENDS_P and self.cur.tag == "p":
            self.cur = self.cur.parent
        n = _Node(tag, attrs, keys, self.cur)
        self.cur.children.append(n)
        if tag not in _VOID:
            self.cur = n

    def handle_endtag(self, tag):
        n = self.cur
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.cur = n.parent

    def handle_data(self, data):
        self.cur.children.append(data)


def _elements(n):
    return [c for c in n.children if isinstance(c, _Node)]


def _walk(n):
    """The elements under ``n`` in document order."""
    out, todo = [], [n]
    while todo:
        c = todo.pop()
        out.append(c)
        for x in reversed(c.children):
            if x.__class__ is _Node:
                todo.append(x)
    return out[1:]


def _inner_text(n):
    parts = []
    stack = [n]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.tag not in ("script", "style"):
            stack.extend(reversed(x.children))
    return re.sub(r"\s+", " ", "".join(parts)).strip()


_SIMPLE = re.compile(r"([a-zA-Z0-9]*)((?:[.#][\w-]+|\[[^\]]+\]|:last-child)*)")
_PART = re.compile(r"\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([*^$]?=)'?\"?([^'\"\]]*)'?\"?)?\]|(:last-child)")


@lru_cache(1024)
def _parse_simple(sel):
    m = _SIMPLE.fullmatch(sel)
    return m and (m.group(1).lower(), _PART.findall(m.group(2)))


def _match_simple(n, sel):
    parsed = _parse_simple(sel)
    if not parsed:
        return False
    tag, parts = parsed
    if tag and n.tag != tag:
        return False
    for cls, ident, attr, op, val, last in parts:
        if cls and cls not in n.attrs.get("class", "").split():
            return False
        if ident and n.attrs.get("id") != ident:
            return False
        if attr:
            if attr not in n.attrs:
                return False
            v = n.attrs[attr]
            if op == "=" and v != val or op == "*=" and val not in v or op == "^=" and not v.startswith(val) \
                    or op == "$=" and not v.endswith(val):
                return False
        if last and (n.parent is None or _elements(n.parent)[-1] is not n):
            return False
    return True


def _matches(n, steps, scope):
    """Right-to-left match of a compound selector (' ', '>', '+')."""
    sel, comb = steps[-1]
    if not _match_simple(n, sel):
        return False
    if len(steps) == 1:
        return True
    rest = steps[:-1]
    if comb == ">":
        p = n.parent
        return p is not None and p is not scope.parent and _matches(p, rest, scope)
    if comb == "+":
        sib = _elements(n.parent)
        i = sib.index(n)
        return i > 0 and _matches(sib[i - 1], rest, scope)
    p = n.parent
    while p is not None and p is not scope.parent:
        if _matches(p, rest, scope):
            return True
        p = p.parent
    return False


@lru_cache(1024)
def _parse_selector(sel):
    tokens = re.findall(r"\[[^\]]*\]|[>+]|[^\s>+\[]+(?:\[[^\]]*\])*(?::last-child)?", sel)
    steps, comb = [], " "
    for t in tokens:
        if t in (">", "+"):
            comb = t
        elif t.startswith("[") and steps:
            steps[-1] = (steps[-1][0] + t, steps[-1][1])
        else:
            steps.append((t, comb))
            comb = " "
    return steps


@lru_cache(1024)
def _by_key(selectors):
    """The selectors by the class, else the tag, that their last step asks for (else "")."""
    by = {}
    for steps in map(_parse_selector, selectors):
        parsed = _parse_simple(steps[-1][0])
        if parsed:
            by.setdefault(next(("." + p[0] for p in parsed[1] if p[0]), parsed[0]), []).append(steps)
    return by


def _select(nodes, scope, selectors):
    """Those of ``nodes`` (the elements under ``scope``) that match any selector, one after the other."""
    by = _by_key(tuple(selectors))
    for n in nodes:
        for k in n.keys:
            if k in by and any(_matches(n, steps, scope) for steps in by[k]):
                yield n
                break


def _first(nodes, scope, selectors):
    return next(_select(nodes, scope, selectors), None)


def _extract_page(html, site, site_title_fallback):
    card_s, title_s, comp_s, link_s, loc_s = rules.SITE_SELECTORS[site]
    t = _Tree()
    t.feed(html or "")
    out = []
    for card in _select(_walk(t.root), t.root, card_s):
        inside = _walk(card)
        title = _first(inside, card, title_s)
        if title is None and site_title_fallback:
            a = _first(inside, card, ["a"])
            if a is not None and _inner_text(a) and a.attrs.get("href"):
                title = a
        if title is None:
            continue
        comp, link, loc = _first(inside, card, comp_s), _first(inside, card, link_s), _first(inside, card, loc_s)
        out.append((_inner_text(title), _inner_text(comp) if comp is not None else rules.UNKNOWN_COMPANY,
                    link.attrs.get("href", "") if link is not None else "",
                    _inner_text(loc) if loc is not None else rules.DEFAULT_CARD_LOCATION))
    return out


def _extract_batches(batches):
    for pdf in batches:
        rows = []
        for page_id, site, query, html, base in zip(pdf["page_id"], pdf["site"], pdf["query"], pdf["html"], pdf["base_url"]):
            try:
                cards = _extract_page(html, site, site == "jobmaster")
            except Exception as e:              # one page must not fail the others
                rows.append((page_id, site, query, None, None, None, None, None, base, f"{type(e).__name__}: {e}"))
                continue
            for i, (title, comp, link, loc) in enumerate(cards):
                rows.append((page_id, site, query, i + 1, title, comp, link, loc, base, None))
        out = pd.DataFrame(rows, columns=["page_id", "site", "query", "position", "title", "company", "url",
                                          "location", "base_url", "error"])
        out["position"] = out["position"].astype("Int32")
        yield out


def extract_cards(pages: DataFrame) -> DataFrame:
    """S3 (board profiles): ``pages`` has page_id, site, query, html; the
    site's base URL comes from the site table.  Cards in document order,
    first matching node per field, defaults as the boards' scripts use.  A page that
    can't be read (an unknown board, say) gives one row with ``error`` and no title."""
    base = pages.sparkSession.createDataFrame([(s, b) for s, b, _, _ in rules.SITES], "site string, base_url string")
    p = pages.join(F.broadcast(base), "site", "left").select("page_id", "site", "query", "html", "base_url")
    return p.mapInPandas(_extract_batches, CARD_SCHEMA)
