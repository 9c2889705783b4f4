"""Main text of web pages by a site style tree.

The element paths of all pages of a host form one tree. A branch's content importance is the entropy of the
texts that pages have there, its presentation importance that of the layouts around it; a block's own importance
is the share of the pages with that path that say something else there. Their geometric mean judges the block.
What markup says of itself (articles, wrappers) is a prior worth eight pages: on a host with more pages
repeated branches leave the article and varied text outside of it comes back, a lone page stands by its
markup. Elements that name themselves furniture (menus, forms, adverts, comments) go whatever they hold,
as adverts and comments vary from page to page as the article does.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, small_batches, store, text_of, texts, widen

# Element kinds of HTML, and words that class names, ids and roles use for page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "xmp", "iframe", "noembed", "noframes")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
                     "h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
            "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
CONTAINERS = frozenset("ul ol dl table select menu".split())
FURNITURE_TAGS = frozenset("head nav footer aside form button select option fieldset dialog menu svg canvas object audio video map "
                           "script style textarea title noscript template iframe".split())
FURNITURE = frozenset("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo "
                      "complementary cookie cookies copyright dialog discussion disqus feedback footer gdpr legal login masthead menu "
                      "modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo "
                      "promotion recommended related replies reply respond responses search share sharing sidebar signup skip social "
                      "sponsor sponsored subscribe subscription tagcloud toolbar topbar widget".split())
# Parts of class words: furniture whatever else the word holds.
FURNITURE_PARTS = ("comment", "cookie", "advert", "sidebar", "breadcrumb", "newsletter", "subscri", "sponsor", "footer", "navbar", "navigation",
                   "topnav", "sidenav", "mainnav", "sitenav", "menu", "banner", "promo", "popup", "pagination", "disqus", "widget", "masthead",
                   "adslot", "adunit", "adbox", "adsense", "adcontainer")
# Words that say nothing of a subject: inside a mark of the main text a class is furniture only if it has no other words than these
# and those above, so that share-box is and menu-recipe isn't.
STRUCTURE = frozenset("area bar block body bottom box btn button buttons card center col container content count desktop fixed form group head "
                      "header heading icon icons inline inner item items large left link links list mobile nav outer panel row section "
                      "small sm lg md xs slot static title top right unit wrap wrapper js widget id post entry article page main site".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Ids that are furniture inside a mark of the main text; other ids there are mostly slugs of titles.
FURNITURE_IDS = frozenset("comments comment respond disqus disqusthread commentform commentlist".split())
# How surely an element marks the main text.
MAIN_TAGS = {"article": 3, "main": 2}
MAIN = frozenset("article main content maincontent post entry story articlebody".split())
LAYOUT = frozenset("has no with without".split())
HEADS = frozenset("header hgroup siteheader pageheader".split())

# Markup's word on a block, and the number of pages that weigh as much as that word.
PRIORS = {"marked": 1.0, "unmarked": 0.5, "outside": 0.25}
PRIOR_PAGES = 8
THRESHOLD = 0.5
CONTENT_SHARE = 0.8
SALTS = 16

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]++)\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
_OPEN_END = re.compile(r"<[a-zA-Z/!][^<>]*\Z")
_WORD = re.compile(r"[a-z0-9]+")


class Block:
    """A run of text under one block element: its path, kind and pieces."""

    __slots__ = ("path", "kind", "pieces")

    def __init__(self, path: str, kind: int):
        self.path, self.kind, self.pieces = path, kind, []


class _Element:
    __slots__ = ("tag", "path", "kind", "children")

    def __init__(self, tag: str, path: str, kind: int, children: list):
        self.tag, self.path, self.kind, self.children = tag, path, kind, children


def _furniture(word: str) -> bool:
    return word in FURNITURE or re.fullmatch("ads?[0-9]+", word) is not None or any(p in word for p in FURNITURE_PARTS)


def _bare(word: str) -> bool:
    """Whether the word is furniture by itself, or by a part beside which it has only a word of structure."""
    if word in FURNITURE or re.fullmatch("ads?[0-9]+", word):
        return True
    return any(p in word and (word.replace(p, "", 1) in ("", "s", "e", "ption", "be") or word.replace(p, "", 1).removeprefix("s") in STRUCTURE)
               for p in FURNITURE_PARTS)


def _inner_furniture(tag: str, classes: str, name: str, role: str) -> bool:
    """Whether class, id and role make an element inside a mark of the main text furniture."""
    if any(map(_furniture, _WORD.findall(role))) or tag not in HEADINGS and "".join(_WORD.findall(name)) in FURNITURE_IDS:
        return True
    for token in classes.split():
        words = _WORD.findall(token)
        if any(map(_bare, words)) and all(_bare(w) or w in STRUCTURE or w.isdigit() for w in words):
            return True
    return False


def _kind(tag: str, words: set[str], hidden: bool, parent: int, inner: bool) -> int:
    """-1 for furniture, which stays furniture below; 3, 2 or 1 inside what marks the main text, 0 elsewhere.

    `inner` says whether the element is furniture by its names where the parent is inside such a mark.
    """
    if words & LAYOUT or tag in ("html", "body"):  # words for what the page has, such as has-sidebar
        words = words - {w for w in words if _furniture(w) or w in HEADS}
    if parent < 0 or hidden or tag in FURNITURE_TAGS or (inner if parent > 0 else any(map(_furniture, words))):
        return -1
    if parent < 2 and tag not in MAIN_TAGS and (tag in HEADS or words & HEADS):
        return -1
    return max(parent, MAIN_TAGS.get(tag, 0), 1 if words & MAIN else 0)


def parse(page: str) -> tuple[list[Block], dict[str, str]]:
    """Blocks in page order, and the child layout of every element path.

    Markup needn't be well formed: end tags may be missing, cross or be cut off, and what follows an open
    tag at the end of the page is dropped. An open comment, script or style runs to the end.
    """
    blocks: list[Block] = []
    layouts: dict[str, list[str]] = {"": []}
    root = _Element("", "", 0, layouts[""])
    stack, at, current, n = [root], 0, None, len(page)

    def add(text: str) -> None:
        nonlocal current
        if not text or stack[-1].kind < 0 and not text.strip():
            return
        if current is None:
            holder = next(e for e in reversed(stack) if e.tag not in INLINE)
            current = Block(holder.path, stack[-1].kind)
            blocks.append(current)
        elif (stack[-1].kind < 0) != (current.kind < 0):
            current = None
            return add(text)
        current.pieces.append(text)

    def close(count: int) -> None:
        nonlocal current
        for _ in range(count):
            if stack.pop().tag not in INLINE:
                current = None

    def close_to(tags, stop) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                close(len(stack) - k)
                return
            if stack[k].tag in stop:
                return

    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            add(page[at:])
            break
        found = _TOKEN.match(page, begin) or _LOOSE.match(page, begin)
        if not found:
            if _OPEN_END.match(page, begin):
                add(page[at:begin])
                break
            add(page[at:begin + 1])
            at = begin + 1
            continue
        add(page[at:begin])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(len(stack) - k)
                    break
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in CLOSES_P:
            close_to(("p",), CONTAINERS | {"div", "td", "th", "li", "section", "article"})
        if tag in SIBLINGS:
            close_to(SIBLINGS[tag], CONTAINERS)
        given = {k.lower(): (a or b or c) for k, a, b, c in _ATTRIBUTE.findall(found[3])} if found[3] else {}
        names = set(_WORD.findall(f"{given.get('class', '')} {given.get('id', '')} {given.get('role', '')}".lower()))
        hidden = ("hidden" in _WORD.findall(re.sub(r"=\s*(\"[^\"]*\"|'[^']*')", "", found[3].lower())) or given.get("aria-hidden") == "true"
                  or "display:none" in given.get("style", "").replace(" ", "").lower()) if found[3] else False
        parts = [given.get(k, "").lower() for k in ("class", "id", "role")]
        inner = stack[-1].kind > 0 and bool(names) and _inner_furniture(tag, *parts)
        label = tag + ("." + ".".join(sorted(set(given.get("class", "").lower().split()))) if "class" in given else "")
        parent = stack[-1]
        parent.children.append(label)
        if tag in VOID:
            if tag not in INLINE:
                current = None
            continue
        if tag not in INLINE and tag not in RAW:
            current = None
        path = f"{parent.path}>{label}"
        element = _Element(tag, path, _kind(tag, names, hidden, parent.kind, inner), layouts.setdefault(path, []))
        if tag in RAW:
            end = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
            if end is None and tag in ("script", "style", "textarea", "title", "template"):
                break
            if end is not None:
                close_end = page.find(">", end.start())
                at = n if close_end < 0 else close_end + 1
            continue
        if not (found[3] or "").endswith("/") or tag not in ("path", "use", "rect", "circle"):
            stack.append(element)
    return blocks, {p: " ".join(c) for p, c in layouts.items()}


def text_of_block(block: Block) -> str:
    return " ".join(html_lib.unescape("".join(block.pieces)).split())


def judged(page: str) -> tuple[list[tuple[str, str, float]], dict[str, str]]:
    """(path, text, prior) of every block with text, and layouts.

    The surest mark that covers a quarter of the text outside furniture decides what the main text is: text
    inside has prior 1, other text 0.25, furniture 0. On a page without such a mark text has prior 0.5.
    """
    blocks, layouts = parse(page)
    found = [(b.path, text_of_block(b), b.kind) for b in blocks]
    found = [b for b in found if b[1]]
    size = sum(len(t) for _, t, k in found if k >= 0)
    level = next((m for m in (3, 2, 1) if 4 * sum(len(t) for _, t, k in found if k >= m) >= max(1, size)), 0)
    return [(p, t, 0.0 if k < 0 else 0.5 if not level else 1.0 if k >= level else 0.25) for p, t, k in found], layouts


def _hash(text: str) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def block_table(pages: DataFrame) -> DataFrame:
    """One row per block outside furniture of every page (key, host, html): its number, path, content, prior,
    the layout of its parent element, and a digest of the page's blocks, equal for copies of a page."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for key, host, page in zip(batch.column("key").to_pylist(), batch.column("host").to_pylist(), texts(batch, "html")):
            blocks, layouts = judged(page)
            mine = [(at, _hash(path), _hash(text), prior, _hash(layouts.get(path.rpartition(">")[0], "")))
                    for at, (path, text, prior) in enumerate(blocks) if prior > 0]
            digest = _hash(repr([(path, content, layout) for _, path, content, _, layout in mine]))
            out += [(key, host, *block, digest) for block in mine]
        columns = list(zip(*out)) or [[]] * 8
        types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                          ["key", "host", "at", "path", "content", "prior", "layout", "digest"])
    return map_texts(pages, "html", run, "key bigint, host string, at int, path bigint, content bigint, prior double, layout bigint, digest bigint")


def importance(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The style tree's statistics, in which copies of a page count once.

    Contents: host, path, content, pages that show it there, priors it has there. Paths: host, path, m (pages
    that have the path), content_importance and layout_importance (entropy of the path's contents and layouts
    over log m). Both are 1 for a path on one page; several contents a page can lift the first above 1.
    """
    contents = blocks.groupBy("host", "path", "content").agg(
        F.count_distinct("digest").alias("pages"), *[F.max(F.col("prior") == p).alias(name) for name, p in PRIORS.items()])
    texts_ = contents.groupBy("host", "path").agg(F.sum(F.col("pages") * F.log("pages")).alias("s"), F.sum("pages").alias("l"))
    layouts = blocks.groupBy("host", "path", "layout").agg(F.count_distinct("digest").alias("c"))
    layouts = layouts.groupBy("host", "path").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s2"))
    spread = F.log("m")
    paths = texts_.join(layouts, ["host", "path"]).select(
        "host", "path", "m",
        F.when(F.col("m") < 2, 1.0).otherwise(F.log("l") / spread - F.col("s") / F.col("l") / spread).alias("content_importance"),
        F.when(F.col("m") < 2, 1.0).otherwise(1 - F.col("s2") / F.col("m") / spread).alias("layout_importance"))
    return contents, paths


def decisions(blocks: DataFrame) -> DataFrame:
    """host, path, content, m, pages and, for each name of `PRIORS`, whether the block stays if it has that prior there.

    Null where the content never has that prior. Hot paths are spread over `SALTS` parts of the join.
    """
    contents, paths = importance(blocks)
    salted = paths.where("m > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = contents.withColumn("salt", F.pmod("content", F.lit(SALTS)).cast("int")).join(salted, ["host", "path", "salt"])
    branch = CONTENT_SHARE * F.least(F.col("content_importance"), F.lit(1.0)) + (1 - CONTENT_SHARE) * F.col("layout_importance")
    own = 1 - (F.col("pages") - 1) / (F.col("m") - 1)
    weight = F.col("m") / (F.col("m") + PRIOR_PAGES)
    stat = F.sqrt(F.greatest(own * branch, F.lit(0.0)))
    return met.select("host", "path", "content", "m", "pages", *[
        F.when(F.col(name), (1 - weight) * p + weight * stat >= THRESHOLD).alias(name) for name, p in PRIORS.items()])


def changed_blocks(blocks: DataFrame) -> DataFrame:
    """key, changed: numbers of the blocks on which the site's statistics overrule markup; pages without any have no row."""
    against = {name: F.col(name) != F.lit(p >= THRESHOLD) for name, p in PRIORS.items()}
    found = decisions(blocks).select("host", "path", "content", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in against.items()])
    found = found.where(" or ".join(PRIORS))
    mine = F.coalesce(*[F.when(F.col("prior") == p, F.col(name)) for name, p in PRIORS.items()])
    return blocks.join(found, ["host", "path", "content"]).where(mine).groupBy("key").agg(F.collect_set("at").alias("changed"))


def main_text(found: list[tuple[str, str, float]], changed: set[int]) -> str:
    """The text of a page's judged blocks, with markup's word turned round on the blocks in `changed`.

    Where that would take over half of what the page's own mark encloses, the page is a near copy of others
    and not their furniture, and its mark keeps everything.
    """
    inside = [(at, len(t)) for at, (_, t, prior) in enumerate(found) if prior == 1]
    if 2 * sum(n for at, n in inside if at in changed) > sum(n for _, n in inside):
        changed = changed - {at for at, _ in inside}
    return "\n".join(t for at, (_, t, prior) in enumerate(found) if (prior >= THRESHOLD) != (at in changed))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`id_col`, `url_col`, text, n_chars of every row.

    Text blocks that are kept, in page order, joined by newlines; white space inside a block becomes one space
    and character references are decoded once. Null and empty pages give the empty text; pages
    without a host in their url share one tree; repeated rows and copies of a page count once in the
    statistics and are returned each time; a near copy keeps what its mark encloses. Pages are parsed twice,
    in scans; numbers of blocks are shuffled, and pages themselves only if statistics overrule markup
    on more blocks than AQE broadcasts. A host's statistics are sums, never gathered pages.
    """
    spark = pages.sparkSession
    small_batches(spark)
    host = F.lower(F.coalesce(F.regexp_extract(pages[url_col], r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"), host.alias("host"))
    rows = widen(rows.withColumn("html", text_of("html"))).withColumn("key", F.xxhash64("id", "url", "html"))
    blocks = store(block_table(rows.select("key", "host", "html")), "blocks")
    changed = store(changed_blocks(blocks), "changed-blocks")
    if changed.isEmpty():
        met = rows.select("id", "url", "html", F.lit(None).cast("array<int>").alias("changed"))
    else:
        met = rows.join(changed, "key", "left").select("id", "url", "html", "changed")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [main_text(judged(page)[0], set(changed or ())) for page, changed in zip(texts(batch, "html"), batch.column("changed").to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(out, pa.string()),
                                           pa.array([len(t) for t in out], pa.int64())], [id_col, url_col, "text", "n_chars"])
    return map_texts(met, "html", run, f"{id_col} {pages.schema[id_col].dataType.simpleString()}, {url_col} string, text string, n_chars bigint")
