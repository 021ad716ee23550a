"""Main text of web pages by equivalence classes of template tokens.

A token is an opening tag with its path (names and class words from the root). Over the pages of one host, tokens that
share an occurrence vector (how often they stand in each page) form an equivalence class; the vector is compared
through two 64-bit sums by exclusive or of hashes of (page, count), which Spark adds up before the shuffle, so a host
with a third of all pages is no hot group. A class is valid if it spans enough of the host's pages and holds more than
one token. The tokens of valid classes, nested by their paths, are the host's template, and the text below each of them is a
slot. The main slots of a host are the article or main elements of the template; where it has none, all of the page.

Slots of small block-level elements inside are left out where they repeat: in an article if one text stands there on
nearly all pages of the host; unless the articles themselves repeat; elsewhere if at most half of the pages differ in it, or if links are all it ever holds. Only
the pages that have a recurring text lose it, a slot with most of the host's running text is never left out, and a page that
would have no text left keeps its slots.

A page's text is taken from the main slots of its host, without the parts that are menus, page headers, footers, sidebars,
adverts, forms or reader comments by their element or name, and without scripts and styles. A page whose host has no
main slot, or that lacks it, is read from its own article or main elements or else from the deepest element that holds all of
its running text.
Character references are decoded, block-level tags and line breaks separate, white space becomes one space.

Templates are a few numbers per host. They are broadcast if their measured size is below ``BROADCAST_BYTES`` and joined
on (host, salt) otherwise. Defined results: null html is empty text; null url is the empty host; pages without tags are
read as one text; repeated rows give repeated results; other columns stay unless named like the two results.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotables.llm.common import slices, written

MIN_PAGES, MIN_SHARE, MAIN_SHARE = 3, 0.5, 0.6
#: Share of a host's pages with one text that makes a slot of an article template text; share of different texts up to which
#: another slot is; share of the pages from which a text counts as recurring there.
SAME_SHARE, VARIED_SHARE, RECURRING_SHARE = 0.9, 0.5, 0.05
BROADCAST_BYTES = 8 << 20
SALTS = 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is skipped up to their end tag; of the first kind even if that is missing.
RAW, SKIPPED = "script|style|textarea|title", "noscript|template|iframe|svg|math|object|canvas|audio|video"
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table"
    " tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"br", "body", "html", "head", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "legend"}
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
              "th": {"td", "th"}, "option": {"option"}}
#: Elements that can be slots of their own; any other block-level element can if it has a class, id or role.
SLOT_TAGS = frozenset("div section ul ol dl table header figure details center menu dir address fieldset".split())
LIST_TAGS = {"ul", "ol", "dl", "table", "menu", "dir"}
#: Elements that hold no article text wherever they stand, and those that do so only outside an article.
OUT_TAGS = frozenset("nav aside form footer dialog menu button select noscript iframe".split())
OUT_TAGS_OUTSIDE = frozenset(["header"])
#: Whole class, id and role names of parts that are no article text. A name joined by hyphens counts if all its words are
#: such names or carriers, so 'cookie-notice' and 'related-posts' do, 'with-sidebar' and 'social-history' don't.
OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement nav navbar navigation menubar sidebar footer cookie cookies consent comment comments"
    " respond reply replies disqus share sharing related breadcrumb breadcrumbs pagination pager newsletter subscribe signup"
    " login sponsored masthead topbar contentinfo complementary".split())
#: Names that articles use for their own parts as well: they count in a joined name only.
JOINED_NAMES = frozenset("notice notices alert popup modal overlay menu social promo sponsor widget toolbar banner search skip".split())
CARRIERS = frozenset("area bar box block buttons container form inner links list outer posts section site thread top wrap wrapper".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar".split())
#: Parts that an article cannot be inside of, unless it is most of the page; an article that opens inside any other such part
#: is one all the same, as the part was left open or wraps the page.
STRICT = frozenset("nav aside footer dialog menu".split())
STRICT_NAMES = frozenset("nav sidebar footer comment comments respond reply replies disqus related".split())
#: A part that holds this share of the page's running text, or of its articles', is never out by its name.
MOST = 0.5

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + RAW + r")(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(" + SKIPPED + r")(?=[\s/>])[^>]*>.*?</\2\s*>|<(/?)([a-zA-Z][^\s/>]*)"
    r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<[a-zA-Z][^<>]*(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Digits tell the slots of a template apart; longer numbers are those of the page.
WORD = re.compile(r"[a-z]+(?:\d{1,2}(?!\d))?")


def _attributes(text: str) -> tuple[tuple[str, ...], frozenset[str], bool]:
    """Words of class, id and role; the names among them that mark parts without article text; whether it is hidden."""
    words: list[str] = []
    names: set[str] = set()
    hidden = False
    if text:
        for name, a, b, c in ATTRIBUTE.findall(text):
            name, value = name.lower(), (a or b or c).lower()
            if name in ("class", "id", "role"):
                words += WORD.findall(value)
                for whole in value.split():
                    if name == "role" and whole in OUT_ROLES:
                        names.add(whole)
                    pieces = set(re.split(r"[-_]+", whole)) - {""}
                    if pieces <= OUT_NAMES | JOINED_NAMES | CARRIERS and (
                            pieces & OUT_NAMES or (len(pieces) > 1 and pieces & JOINED_NAMES)):
                        names |= pieces - CARRIERS
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                hidden = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
    return tuple(words), frozenset(names), hidden


class Element:
    __slots__ = ("name", "names", "hidden", "opens", "token", "out", "strict", "article", "link", "depth", "path", "parent",
                 "chars", "slot")

    def __init__(self, name: str, words: tuple[str, ...], names: frozenset[str], hidden: bool, parent: Element | None):
        self.name, self.names, self.hidden, self.parent = name, names, hidden, parent
        self.path = (parent.path if parent else "") + ">" + ".".join((name, *words))
        self.token = xxhash.xxh64_intdigest(self.path) - (1 << 63)
        self.depth = parent.depth + 1 if parent else 0
        self.chars = 0
        self.opens = name in ("article", "main") or "main" in words and words[0] == "main" and not names
        self.link = name == "a" or (parent is not None and parent.link)
        self.slot = name in SLOT_TAGS or name in ("article", "main") or (name in BLOCK and bool(words) and name not in ("html", "body"))
        self.place(True)

    def place(self, named: bool) -> None:
        """Sets out, strict and article from the parent's; ``named``: whether names, and a form, mark parts out."""
        parent = self.parent
        inside = parent is not None and parent.article
        own = (self.name in OUT_TAGS and (named or self.name != "form")) or (self.name in OUT_TAGS_OUTSIDE and not inside)
        strict = self.name in STRICT or self.hidden
        if named and self.names and self.name not in ("html", "body"):
            own, strict = True, strict or bool(self.names & STRICT_NAMES)
        self.strict = strict or (parent is not None and parent.strict)
        self.out = own or self.hidden or (parent is not None and parent.out)
        if self.opens and not own and not self.strict:
            self.out = False
        self.article = inside or (self.opens and not self.strict)


def settle(elements: list[Element], runs: list[tuple[Element | None, str, bool]]) -> None:
    """Names are hints for small parts: one that holds most of the running text, or of the articles', is in all the same."""
    if not any(e.names or e.name == "form" for e in elements):
        return
    for e in elements:
        e.place(False)
    total = in_articles = 0
    below: dict[int, list[int]] = {}
    for element, text, _ in runs:
        n = len(text.strip())
        if n and (element is None or not (element.out or element.link)):
            total += n
            in_articles += n * (element is not None and element.article)
            e = element
            # text of an article counts for the parts around the article, not for those inside it
            while e is not None:
                x = below.setdefault(id(e), [0, 0])
                x[0] += n
                x[1] += n * (element.article and not (e.parent is not None and e.parent.article))
                e = e.parent
    for e in elements:
        all_text, article_text = below.get(id(e), (0, 0))
        e.place(not (all_text and (all_text > MOST * total or article_text > MOST * in_articles)))


def parse(page: str) -> tuple[list[Element], list[tuple[Element | None, str, bool]]]:
    """The elements in page order, and the runs of text: element, raw text, and whether a block boundary precedes."""
    elements: list[Element] = []
    runs: list[tuple[Element | None, str, bool]] = []
    stack: list[Element] = []
    at, broke = 0, True
    for m in TAG.finditer(page):
        if m.start() > at:
            runs.append((stack[-1] if stack else None, page[at:m.start()], broke))
            broke = False
        at = m.end()
        name = m.group(4)
        if name is None:
            continue  # comments, declarations, and elements whose content is no text
        name = name.lower()
        if name in BLOCK:
            broke = True
        if m.group(3):
            if name in VOID:
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
            continue
        close = SAME_LEVEL.get(name)
        if name in CLOSES_P or close:
            stop = LIST_TAGS if close else frozenset()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name in (close or {"p"}):
                    del stack[i:]
                    break
                if stack[i].name in stop or (not close and stack[i].name in BLOCK):
                    break
        if name in VOID:
            continue
        element = Element(name, *_attributes(m.group(5)), stack[-1] if stack else None)
        elements.append(element)
        stack.append(element)
    if at < len(page):
        runs.append((stack[-1] if stack else None, page[at:], broke))
    settle(elements, runs)
    return elements, runs


def count_text(runs: list[tuple[Element | None, str, bool]]) -> None:
    """Adds to every element the length of the running text below it, without links and boilerplate."""
    for element, text, _ in runs:
        if element is not None and not element.out and not element.link:
            n = len(text.strip())
            while n and element is not None:
                element.chars += n
                element = element.parent


def texts_below(elements: list[Element], runs: list[tuple[Element | None, str, bool]]) -> dict[int, int]:
    """Per token that can be a slot, a hash of the token with all text below it on the page, links included."""
    sums: dict[int, int] = {}
    for element, text, _ in runs:
        text = " ".join(text.split())
        if text:
            h = xxhash.xxh64_intdigest(text)
            while element is not None:
                if element.slot:
                    sums[element.token] = (sums.get(element.token, 0) * 0x9E3779B97F4A7C15 + h) & 0xFFFFFFFFFFFFFFFF
                element = element.parent
    return {token: xxhash.xxh64_intdigest(f"{token} {x}") - (1 << 63) for token, x in sums.items()}


def own_main(elements: list[Element], runs: list[tuple[Element | None, str, bool]]) -> set[int]:
    """Tokens of the main slots by the page alone; none if only the whole page will do."""
    found = {e.token for e in elements if e.name == "article" and not e.out} or {
        e.token for e in elements if e.article and not e.out and not (e.parent and e.parent.article)}
    if found:
        return found
    total = sum(len(text.strip()) for e, text, _ in runs if e is None or not (e.out or e.link))
    best = max((e for e in elements if total and e.chars == total and e.name not in ("p", "b", "i", "span") and not e.out),
               key=lambda e: e.depth, default=None)
    return {best.token} if best is not None else set()


def main_text(page: str | None, main: frozenset[int] | set[int], same: frozenset[int] | set[int] = frozenset()) -> str:
    """Text of the slots below the ``main`` tokens, or below the page's own if it has none of them, without the slots in
    ``same``: tokens, or hashes of a token with its text."""
    if not page:
        return ""
    elements, runs = parse(page)
    if not any(e.token in main for e in elements):
        count_text(runs)
        main = own_main(elements, runs)
    texts = texts_below(elements, runs) if same else {}
    found = _text(runs, main, {t for t, x in texts.items() if t in same or x in same})
    return found if found or not texts else _text(runs, main, set())


def _text(runs: list[tuple[Element | None, str, bool]], main: frozenset[int] | set[int], without: set[int]) -> str:
    inside: dict[int, bool] = {}

    def wanted(e: Element | None) -> bool:
        """Below a main token (or anywhere, without one) and in no part left out."""
        if e is None:
            return not main
        known = inside.get(id(e))
        if known is None:
            known = inside[id(e)] = not e.out and not left_out(e) and (
                not main or e.token in main or (e.parent is not None and wanted(e.parent)))
        return known

    gone: dict[int, bool] = {}

    def left_out(e: Element) -> bool:
        if not without:
            return False
        known = gone.get(id(e))
        if known is None:
            known = gone[id(e)] = e.token in without or (e.parent is not None and left_out(e.parent))
        return known

    parts: list[str] = []
    gap = False
    for element, text, broke in runs:
        gap |= broke
        if wanted(element):
            if gap:
                parts.append("\n")
                gap = False
            parts.append(text)
    return " ".join(html_module.unescape("".join(parts)).split())


HOST = r"regexp_replace(lower(regexp_extract(coalesce({url}, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^.*@|:\\d*$', '')"


def token_counts(pages: DataFrame, html: str, url: str) -> DataFrame:
    """Per host, token and text below it (0 for tokens that can't be slots): pages, occurrences, the two signatures of the
    occurrence vector, running text below, depth, kind, whether it can be a slot. Token 0 stands for whole pages."""
    rows = pages.selectExpr(f"{html} as html", f"{HOST.format(url=url)} as host",
                            f"xxhash64({url}, {html}, monotonically_increasing_id()) as page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                sums: dict[tuple[str, int, int], list[int]] = {}
                for page, host, key in zip(*(part.column(c).to_pylist() for c in ("html", "host", "page")), strict=True):
                    if not page:
                        continue
                    elements, runs = parse(page)
                    count_text(runs)
                    texts = texts_below(elements, runs)
                    total = sum(len(t.strip()) for e, t, _ in runs if e is None or not (e.out or e.link))
                    own: dict[int, list[int]] = {0: [1, total, 0, False, False, False, False]}
                    for e in elements:
                        x = own.setdefault(e.token, [0, 0, e.depth, e.out, e.name == "article", e.article, e.slot])
                        x[0] += 1
                        x[1] += e.chars
                    for token, (n, chars, depth, out, article, inside, slot) in own.items():
                        kind = 0 if out else 3 if article else 2 if inside else 1
                        a = xxhash.xxh64_intdigest(f"{key} {n}", 1) - (1 << 63)
                        b = xxhash.xxh64_intdigest(f"{key} {n}", 2) - (1 << 63)
                        place = host, token, texts.get(token, 0)
                        x = sums.get(place)
                        if x is None:
                            sums[place] = [1, n, a, b, chars, depth, kind, int(slot)]
                        else:
                            x[0] += 1
                            x[1] += n
                            x[2] ^= a
                            x[3] ^= b
                            x[4] += chars
                            x[6] = max(x[6], kind)
                if sums:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64()),
                         pa.array([k[2] for k in sums], pa.int64()),
                         *(pa.array([v[i] for v in sums.values()], pa.int64()) for i in range(8))],
                        ["host", "token", "text", "pages", "n", "a", "b", "chars", "depth", "kind", "slot"])

    schema = ("host string, token bigint, text bigint, pages bigint, n bigint, a bigint, b bigint, chars bigint, depth bigint,"
              " kind bigint, slot bigint")
    return rows.mapInArrow(run, schema).groupBy("host", "token", "text").agg(*_sums())


def _sums() -> list:
    return [F.expr(f"{f}({c}) as {c}") for f, c in (
        ("sum", "pages"), ("sum", "n"), ("bit_xor", "a"), ("bit_xor", "b"), ("sum", "chars"), ("max", "depth"),
        ("max", "kind"), ("max", "slot"))]


def templates(texts: DataFrame) -> DataFrame:
    """host, main array<bigint>, same array<bigint>: the main slots of every host with a template, and the tokens and texts of
    slots to leave out; ``texts`` is a stored table of token_counts."""
    counts = texts.groupBy("host", "token").agg(*_sums(), F.count(F.lit(1)).alias("texts"), F.max("pages").alias("top"))
    per_host = counts.groupBy("host").agg(F.max("pages").alias("host_pages"), F.max("chars").alias("host_chars"))
    known = counts.join(per_host.where(f"host_pages >= {MIN_PAGES}"), "host").where(
        f"token <> 0 and pages >= {MIN_PAGES} and pages >= {MIN_SHARE} * host_pages")
    classes = known.groupBy("host", "a", "b").agg(
        F.count(F.lit(1)).alias("size"),
        F.collect_list(F.struct("token", "pages", "chars", "depth", "kind", "slot", "texts", "top")).alias("tokens"),
        F.max("host_chars").alias("host_chars"), F.max("host_pages").alias("host_pages"))
    skeleton = classes.where("size >= 2").selectExpr("host", "host_pages", "host_chars", "inline(tokens)").where("kind > 0")
    # the article, else the main element nearest to the root
    ranked = skeleton.where("kind >= 2").selectExpr("host", "token", "if(kind = 3, 100000, -depth) as weight")
    best = ranked.groupBy("host").agg(F.max("weight").alias("weight"))
    main = ranked.join(best, ["host", "weight"]).groupBy("host").agg(F.sort_array(F.collect_set("token")).alias("main"))
    # where the articles themselves repeat, a text in all of them says nothing
    varied = skeleton.where("kind >= 2 and slot = 1").groupBy("host").agg(
        (F.max(F.expr("texts / pages")) > VARIED_SHARE).alias("varied"))
    small = skeleton.join(varied, "host", "left").where(f"slot = 1 and kind < 3 and chars <= {1 - MAIN_SHARE} * host_chars")
    links = small.where("kind = 1 and chars = 0").selectExpr("host", "token as x")
    recurring = small.where(f"if(kind = 2, varied and top >= {SAME_SHARE} * host_pages, chars > 0 and texts <= {VARIED_SHARE} * pages)")
    same = texts.select("host", "token", "text", F.col("pages").alias("text_pages")).join(
        recurring.select("host", "token", "kind", "pages", "top"), ["host", "token"]).where(
        f"text <> 0 and text_pages >= if(kind = 2, top, greatest(2, {RECURRING_SHARE} * pages))").selectExpr("host", "text as x")
    same = links.unionByName(same).groupBy("host").agg(F.sort_array(F.collect_set("x")).alias("same"))
    return main.join(same, "host", "full")


def extract_main_text(pages: DataFrame, html: str = "html", url: str = "url", text: str = "text",
                      n_chars: str = "n_chars") -> DataFrame:
    """Replaces ``html`` by ``text``, the main text, and ``n_chars``, its code points."""
    found = written(templates(written(token_counts(pages, html, url), "html-texts")), "html-templates")
    measured = found.agg(F.sum(F.length("host") + 8 * (F.greatest(F.size("main"), F.lit(0)) + F.greatest(F.size("same"), F.lit(0))) + 64).alias("bytes")).first().bytes or 0
    rows = pages.drop(text, n_chars) if text != html else pages.drop(n_chars)
    rows = rows.withColumn("__host", F.expr(HOST.format(url=url)))
    if measured <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(found.toDF("__host", "__main", "__same")), "__host", "left")
    else:
        salted = found.selectExpr("host as __host", "main as __main", "same as __same", f"explode(sequence(0, {SALTS - 1})) as __salt")
        rows = (rows.withColumn("__salt", F.expr(f"cast(pmod(xxhash64({url}, {html}), {SALTS}) as int)"))
                .join(salted, ["__host", "__salt"], "left").drop("__salt"))
    rows = rows.drop("__host")
    kept = [f for f in rows.schema.fields if f.name not in (html, "__main", "__same")]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html):
                out = [main_text(p, frozenset(m or ()), frozenset(x or ())) for p, m, x in
                       zip(*(part.column(c).to_pylist() for c in (html, "__main", "__same")), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in kept), pa.array(out, pa.string()),
                     pa.array([len(x) for x in out], pa.int64())], [*(f.name for f in kept), text, n_chars])

    return rows.mapInArrow(run, f"{fields}`{text}` string, `{n_chars}` bigint")
