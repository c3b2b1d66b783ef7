"""Main text of web pages by deduction of a host's template from equivalence classes.

1. Every page becomes tokens: containers (the path of container elements from the root, with classes) and text blocks (path and
   text). A token's occurrence vector says how often it occurs in each page of the host. Vectors are compared by
   support and a 64-bit fingerprint that is summed over pages, so no host is gathered, however large.
2. Tokens with the vector of the page root form the root class: they occur in every page of the host. Containers in at least half
   of the pages form the classes nested in it; a path holds its ancestors, so a class nests in the class of its prefix, and
   classes whose tokens change order between pages (first places overlap) are not valid.
3. The template has the text blocks of the root class (constant text; hosts of CONSTANT_PAGES pages or more, of which some text differs) and
   the valid containers. The slots that remain are the containers' own texts. If the slot with most text outside of links that differs between pages lies
   in an article or main element, the host's main slot is that element. Else it is the lowest container that holds all content
   slots: those with at least SLOT_SHARE of that one's weight.
4. Extraction keeps, in page order, the text of the main slot without nested menus, headers of the page, footers, sidebars,
   notices, adverts, forms, scripts, styles and reader comments, and without the template's constant text (also where it stands in an article:
   it is what all pages of the host say). What these are is told by elements and by words of class, id and role, as a template alone can't
   tell a comment from a paragraph.

A host with fewer than LEAST_PAGES pages teaches no template; a page without its host's main slot, or of such a host, takes its article
or main elements, or else all text outside of the excluded elements. Character references are decoded, white space in a
block becomes one space, and blocks are joined by one space.

Broken html takes linear time: a tag that never ends is text; from a tag on whose quotes never close, quotes mean nothing; containers nested deeper than
MOST_DEPTH count as their ancestor at that depth. Pages without text don't count as pages of their host.
A null or empty html gives an empty text. A null url belongs to the host ''. Null page ids return as null; repeated rows are
extracted each. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

ship(__name__)

LEAST_PAGES, CONSTANT_PAGES, SLOT_SHARE, MOST_DEPTH = 3, 5, 0.01, 200
#: Templates of up to so many bytes are broadcast, else joined by shuffle.
MOST_BYTES = 16 << 20

CONTAINERS = frozenset("html body div section article main nav header footer aside form ul ol dl table figure dialog details fieldset menu center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption blockquote pre hr address figcaption summary legend option".split())
RAW = frozenset("script style title textarea noscript template iframe svg canvas object select button head".split())
#: Blocks whose end tag may be left out.
IMPLIED_END = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th".split())
EXCLUDED = frozenset("nav footer aside form dialog menu fieldset".split())
WORDS_EXCLUDED = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer "
    "header masthead comment comments reply replies disqus respond cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription "
    "share sharing social related recommended recommendations commentlist usercomments commentform topnav sidenav submenu topbar cookiebar cookiebanner adslot adbox adunit leaderboard widget toolbar pagination pager search login signup copyright skip".split()
)


#: Class words before these say how a page is laid out, not what an element is.
LAYOUT_WORDS = frozenset("with has no without is not layout".split())
#: Before a word of headers: the article's own.
OWN_HEADER = frozenset("article post entry story content title".split())


def _patterns():
    import re

    if not _PATTERNS:
        _PATTERNS.append(re.compile(r"/?([a-zA-Z][^\s/>]*)"))
        _PATTERNS.append(re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I))
        _PATTERNS.append(re.compile(r"[^a-z0-9]+"))
        _PATTERNS.append(re.compile(r"""[^>"']*"""))
    return _PATTERNS


_PATTERNS: list = []


def _says_excluded(token: str, whole: bool) -> bool:
    """Is a class, id or role one of what is no main text? With `whole`, all of it must be such a word; else one of its words, unless they say otherwise."""
    if whole:
        return token in WORDS_EXCLUDED
    words = [x for x in _patterns()[2].split(token) if x]
    if not words or words[0] in LAYOUT_WORDS or words[-1] == "layout":
        return False
    if words[-1] == "header" and len(words) > 1 and words[-2] in OWN_HEADER:
        return False
    return bool(WORDS_EXCLUDED & set(words))


def _element(tag: str, attributes: str) -> tuple[str, bool]:
    """An element's name in a path, and whether it and all in it are no main text."""
    if not attributes or attributes.isspace():
        return tag, tag in EXCLUDED
    name, tokens, out = tag, [], tag in EXCLUDED
    for key, value in _patterns()[1].findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role"):
            tokens += value.split()
            if key == "class":
                name = f"{tag}.{'.'.join(value.split())}"
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            out = True
    return name, out or tag not in ("html", "body", "article", "main") and any(_says_excluded(x, tag not in CONTAINERS) for x in tokens)


class _Scanner:
    """Reads a page piece by piece from `at` on, in time linear in the page's length."""

    def __init__(self, html: str):
        self.html, self.at, self.last, self.quotes = html, 0, html.rfind(">"), True

    def next(self) -> tuple[str, str | None, bool, str] | None:
        """The next text ('...', None, False, '') or tag ('', name, is an end, attributes), None at the end. Comments and declarations are left out."""
        html, end = self.html, len(self.html)
        while self.at < end:
            at = self.at
            if html.startswith(("<!", "<?"), at):
                comment = html.startswith("<!--", at)
                over = html.find("-->", at + 4) + 2 if comment else html.find(">", at)
                self.at = over + 1 if over > at else end
                continue
            if html[at] != "<":
                mark = html.find("<", at)
                self.at = mark if mark >= 0 else end
                return html[at : self.at], None, False, ""
            tag = _patterns()[0].match(html, at + 1) if at < self.last else None
            if not tag:
                self.at = at + 1
                return "<", None, False, ""
            stop = self._end(tag.end()) if tag.end() <= self.last else -1
            if stop < 0:
                self.at = at + 1
                return "<", None, False, ""
            self.at = stop + 1
            return "", tag[1].lower(), html[at + 1] == "/", html[tag.end() : stop]
        return None

    def _end(self, at: int) -> int:
        """Where the tag ends whose attributes begin at `at`."""
        html, stop = self.html, at
        while self.quotes:
            stop = _patterns()[3].match(html, stop).end()
            if stop < len(html) and html[stop] == ">":
                return stop
            close = html.find(html[stop], stop + 1) if stop < len(html) else -1
            self.quotes, stop = close >= 0, close + 1
        return html.find(">", at)


def segments(html: str) -> list[tuple[str, bool, bool, str]]:
    """The text runs of a page in order: path, excluded, in a link, text (not decoded). A run of ' ' ends a block."""
    import re

    out: list[tuple[str, bool, bool, str]] = []
    stack: list[tuple[str, str, bool]] = [("", "", False)]
    open_now: dict[str, int] = {}
    endless: set[str] = set()
    link = 0

    def push(tag: str, path: str, excluded: bool) -> None:
        stack.append((tag, path, excluded))
        open_now[tag] = open_now.get(tag, 0) + 1

    def pop() -> str:
        tag = stack.pop()[0]
        open_now[tag] -= 1
        return tag

    scanner = _Scanner(html)
    while piece := scanner.next():
        text, tag, close, attributes = piece
        if tag is None:
            out.append((stack[-1][1], stack[-1][2], link > 0, text))
            continue
        if tag in RAW and not close:
            if not attributes.endswith("/") and tag not in endless:
                over = re.compile(rf"</{tag}\s*>" if tag != "head" else r"</head\s*>|<body\b", re.I).search(html, scanner.at)
                if over:
                    scanner.at = over.start() if over[0][1] != "/" else over.end()
                else:
                    endless.add(tag)
            if tag in endless and tag in ("script", "style", "title", "textarea") and not attributes.endswith("/"):
                scanner.at = len(html)
        elif tag == "a":
            link = 0 if close else 1
        elif tag == "br":
            out.append((stack[-1][1], stack[-1][2], False, "\n"))
        elif tag in BLOCKS:
            out.append((stack[-1][1], stack[-1][2], False, " "))
            if not close and stack[-1][0] in IMPLIED_END:  # a marked paragraph ends where the next block begins
                pop()
            if tag in CONTAINERS:
                if not close:
                    name, excluded = _element(tag, attributes)
                    if tag == "header":  # of the page, not of the article
                        excluded = excluded or not (open_now.get("article") or open_now.get("main"))
                    path = f"{stack[-1][1]}>{name}" if len(stack) <= MOST_DEPTH else stack[-1][1]
                    push(tag, path, stack[-1][2] or excluded)
                elif open_now.get(tag):
                    while pop() != tag:
                        pass
            elif close and stack[-1][0] == tag:
                pop()
            elif not close and attributes and not attributes.isspace():
                name, excluded = _element(tag, attributes)
                if excluded:
                    push(tag, f"{stack[-1][1]}>{name}" if len(stack) <= MOST_DEPTH else stack[-1][1], True)
    return out


def _host(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return rest.partition("/")[0].partition("?")[0].rpartition("@")[2].partition(":")[0].lower()


def _print(*parts: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _tokens(batches):
    """Of each page its distinct tokens: host, token, path (null for text), vector (a print of page and count), place, chars, link chars, print of the text."""
    import pyarrow as pa

    names = ["host", "token", "path", "vector", "place", "chars", "linked", "text_print"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        rows = []
        for number, url, html in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "html"))):
            host = _host(url)
            held: dict[str, list] = {"": [1, 0, 0, []]}
            texts: dict[int, int] = {}
            last, block = "", []
            for path, excluded, link, text in segments(html or ""):
                above, missing = path, []
                while above not in held:
                    missing.append(above)
                    above = above.rpartition(">")[0]
                for above in reversed(missing):
                    held[above] = [0, 0, 0, []]
                if path != last and path:
                    held[path][0] += 1
                if (text == " " or path != last) and block:
                    key = _print(last, " ".join("".join(block).split()))
                    texts[key] = texts.get(key, 0) + 1
                    block = []
                last = path
                if not excluded and text != " " and (block or not text.isspace()):
                    block.append(text)
                text = text.strip()
                if text and not excluded:
                    one = held[path]
                    one[1] += len(text)
                    one[2] += len(text) if link else 0
                    one[3].append(text)
            if block:
                key = _print(last, " ".join("".join(block).split()))
                texts[key] = texts.get(key, 0) + 1
            if not texts:  # a page without text is none of its host's
                continue
            for place, (path, (count, chars, linked, own)) in enumerate(held.items()):
                rows.append((host, _print(path), path, _print(str(number), "1" if path == "" else str(count)), place, chars, linked, _print(*own)))
            rows += [(host, key, None, _print(str(number), str(count)), 0, 0, 0, 0) for key, count in texts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def templates(pages: DataFrame) -> DataFrame:
    """Of each host with a template: host, main (the path of its main slot) and constant (prints of its constant text blocks)."""
    rows = pages.mapInArrow(_tokens, "host string, token long, path string, vector long, place long, chars long, linked long, text_print long")
    once = rows.groupBy("host", "token", "text_print").agg(
        F.max("path").alias("path"), F.count(F.lit(1)).alias("pages"), F.bit_xor("vector").alias("vector"), F.min("place").alias("first"), F.max("place").alias("last"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")
    )
    tokens = once.groupBy("host", "token").agg(
        F.max("path").alias("path"), F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.count(F.lit(1)).alias("texts"),
    )
    tokens = cut(tokens.filter("pages > 1"), "tokens")
    root = tokens.filter("path = ''").select("host", F.col("pages").alias("all_pages"), F.col("vector").alias("root_vector")).filter(F.col("all_pages") >= LEAST_PAGES)
    known = tokens.join(root, "host").filter("2 * pages >= all_pages")
    # a token of the root class has the root's vector: in every page, once
    in_root = (F.col("pages") == F.col("all_pages")) & ((F.col("vector") == F.col("root_vector")))
    article = F.regexp_extract("path", r"^(.*?>(?:article|main)(?:\.[^>]*)?)(?:>|$)", 1)
    order = F.when(F.col("last") - F.col("first") <= 8, 1.0).otherwise(0.5)  # a class whose tokens change order is hardly a template's
    excluded = F.col("path").rlike(r">(?:nav|footer|aside|form|dialog|menu|fieldset)(?:\.|>|$)")
    weight = (F.col("chars") - F.col("linked")) * F.least(F.lit(1.0), F.col("texts") / F.col("pages") + 0.05) * order * F.when(article != "", 100.0).otherwise(1.0) * F.when(excluded, 0.0).otherwise(1.0)
    slots = known.filter("path <> ''").select("host", "token", "path", article.alias("article"), weight.alias("weight"))
    best = slots.groupBy("host").agg(F.max_by(F.struct("path", "article", "weight"), F.struct("weight", "token")).alias("best")).select("host", "best.*")
    # the lowest container of several paths is what the least and the largest one begin with
    held = slots.select("host", F.split("path", ">").alias("parts"), F.col("weight").alias("w")).join(best, "host").filter((F.col("w") > 0) & (F.col("w") >= SLOT_SHARE * F.col("weight")))
    spans = held.groupBy("host").agg(F.min("parts").alias("a"), F.max("parts").alias("b"))
    differ = F.array_position(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), False)
    common = F.array_join(F.when(differ > 0, F.slice("a", F.lit(1), (differ - 1).cast("int"))).otherwise(F.col("a")), ">")
    slots = best.join(spans, "host", "left").select("host", F.when(F.col("article") != "", F.col("article")).otherwise(F.coalesce(F.nullif(common, F.lit("")), "path")).alias("main"))
    text = known.filter(F.col("path").isNull() & in_root & (F.col("all_pages") >= CONSTANT_PAGES)).groupBy("host").agg(F.collect_list("token").alias("constant"))
    varied = known.filter("path <> ''").groupBy("host").agg(F.max("texts").alias("texts")).filter(F.col("texts") >= CONSTANT_PAGES - 1).select("host")
    return slots.join(text.join(varied, "host"), "host", "left").select("host", "main", F.coalesce("constant", F.array().cast("array<long>")).alias("constant"))


def main_text(html: str, main: str | None, constant: frozenset[int] = frozenset()) -> str:
    """The main text of a page, given its host's template."""
    from html import unescape

    runs = segments(html)
    inside = lambda path: path == main or path.startswith(main + ">")
    if not main or not any(inside(p) and not x and t.strip() for p, x, _, t in runs):
        holds = {p: bool({"article", "main"} & {y.partition(".")[0] for y in p.split(">")}) for p in {r[0] for r in runs}}  # a path is long, and has many runs
        some = any(holds[p] and not x and t.strip() for p, x, _, t in runs)
        runs = [r for r in runs if holds[r[0]] or not some]
    else:
        runs = [r for r in runs if inside(r[0])]
    out, block, last = [], [], ""
    for path, excluded, _, text in [*runs, ("", False, False, " ")]:
        if text == " " or path != last:
            if block and not (constant and _print(last, " ".join("".join(block).split())) in constant):
                out.append(unescape("".join(block)))
            if block and text == " ":
                out.append(" ")
            block, last = [], path
        if text != " " and not excluded:
            block.append(text)
    return " ".join("".join(out).split())


def _extract(batches):
    import pyarrow as pa

    for batch in batches:
        texts, kept = [], {}
        for html, main, constant in zip(*(batch.column(c).to_pylist() for c in ("html", "main", "constant"))):
            key = tuple(constant or ())
            if key not in kept:
                kept[key] = frozenset(key)
            texts.append(main_text(html or "", main, kept[key]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The pages' page_id, url, text and n_chars (code points)."""
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = cut(templates(pages.select(F.xxhash64("page_id", "url", "html").alias("page"), "url", "html")), "templates")
    few = found.agg(F.coalesce(F.sum(F.octet_length("host") + F.coalesce(F.octet_length("main"), F.lit(0)) + 8 * F.size("constant") + 64), F.lit(0))).first()[0] <= most_bytes
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://(?:[^/?]*@)?([^/?:@]*)", 1))
    joined = pages.withColumn("host", host).join(F.broadcast(found) if few else found, "host", "left").select("page_id", "url", "html", "main", "constant")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op1_html_extract(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
