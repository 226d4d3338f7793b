"""Main text of web pages by removal of site templates.

Pages are parsed once into a flat list of elements. Every element's subtree is hashed (tags and text, without what
differs from visit to visit), and the hashes are counted per host in Spark over pages of different content: subtrees
that recur across many of a host's pages are its template. A second pass deletes those subtrees from the whole page first.
Of what is left it takes the article, without elements whose tag, role or class says that they are no part of it, and
joins the text blocks.

Prose of the article itself (paragraphs, headings, list items and the like inside its container, and subtrees that hold
such) is never taken for template: passages that many articles quote and bodies of near copies stay. On a page without an
article or main element the container is the smallest one with all text that does not recur. Where most of the text
would go as template, all of it stays.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import map_batches, slices, stash

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li "
                    "main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul").split())
CLOSE_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption li dd dt option optgroup legend summary figcaption".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BARRIER = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}

NOT_TEXT = frozenset("head script style noscript template iframe object embed svg canvas audio video math select button input textarea form nav footer aside menu dialog search title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status tablist".split())
NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert(?:s|ising|isement|isements|orial)?|adsense|sponsor(?:s|ed|ship)?|promos?|promoted|promotions?|promotional|banners?|cookies?|consent|gdpr|newsletters?|subscri(?:be|ber|bers|ption|ptions)|notice[_-]?bar|popup|modal|"
                   r"nav(?:s|bar|igation|menu|list|links?|wrap|wrapper|container)?|menus?|menu(?:bar|item|items|list)|breadcrumbs?|sidebars?|widgets?|footer|(?:site|page|top)[_-]?header|masthead|comments?|comment-?list|disqus|"
                   r"respond|replies|share|sharing|social|related|recommend(?:ed|ations?)|pagination|pager|toolbar|skip(?:link|nav|to)?|login|signup|search(?:bar|box|form)?)\d*(?:$|[\s_-])", re.I)
#: Words that an id may have beside those of NAMES; with any other word it is a name for something in the text.
BESIDE = frozenset("area articles bar block bottom box button buttons container content email form global header icons inner left link links list local main mobile notice outer page panel posts primary right secondary section "
                   "site stories sub the top widget wrap wrapper".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th figcaption caption".split())
WHOLE = frozenset("html body article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
GROUPS = frozenset("ul ol menu dl table thead tbody tfoot tr figure".split())

PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'")
KNOWN = frozenset("class id role hidden aria-hidden".split())
WORD = re.compile(r"[\s_-]+|(?<=[A-Za-z])(?=\d)")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("tag", "attributes", "children", "digest", "plain", "prose")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children, self.digest, self.plain, self.prose = tag, attributes, [], 0, 0, False


def parse(source: str) -> Element:
    """The element tree; missing and stray end tags are mended as browsers do in the common cases."""
    root = Element("#root")
    stack, at, size = [root], 0, len(source)
    while at < size:
        m = PIECE.search(source, at)
        if m is None:
            stack[-1].children.append(source[at:])
            break
        if m.start() > at:
            stack[-1].children.append(source[at:m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        open_tag(stack, tag)
        element = Element(tag, m.group(3))
        stack[-1].children.append(element)
        if tag in RAW:
            end = re.compile(f"</{tag}\\b[^>]*>", re.I).search(source, at)
            element.children.append(source[at:end.start() if end else size])
            at = end.end() if end else size
        elif tag not in VOID and not m.group(3).endswith("/"):
            stack.append(element)
    return root


def open_tag(stack: list[Element], tag: str) -> None:
    """Close what the start of ``tag`` closes."""
    if tag in CLOSE_P:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p":
                del stack[i:]
                break
            if stack[i].tag in BLOCKS:
                break
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in CLOSED_BY.get(tag, ()):
            del stack[i:]
        elif stack[i].tag in BARRIER.get(tag, (stack[i].tag,)):
            break


def attributes_of(e: Element) -> list[tuple[str, str]]:
    """The known attributes, read as whole name=value pairs from the start of the tag; the first of a name counts."""
    if not e.attributes:
        return []
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(e.attributes):
        if m.group(1) and (name := m.group(1).lower()) in KNOWN:
            out.setdefault(name, m.group(2) or m.group(3) or m.group(4) or "")
    return list(out.items())


def names_other(e: Element, name: str, value: str, inside: bool) -> bool:
    """Whether a class or id says that the element is no part of the text; ``inside``: of a named article.

    An id also serves as the anchor of a passage, so it counts only if it has no words of its own, and never on
    headings nor, inside, on sections and prose.
    """
    value = HUMP.sub("-", value)
    if name == "class":
        return bool(NAMES.search(value))
    if name != "id" or e.tag in HEADINGS or inside and (e.tag == "section" or e.tag in PROSE):
        return False
    return bool(NAMES.search(value)) and all(not w or w in BESIDE or w.isdigit() or NAMES.fullmatch(w) for w in WORD.split(value.lower()))


def excluded(e: Element, inside: bool = False) -> bool:
    """Menus, forms, page headers and the like, by tag, role, class or id."""
    if e.tag in NOT_TEXT:
        return True
    if not e.attributes or e.tag in WHOLE:
        return False
    for name, value in attributes_of(e):
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES or names_other(e, name, value, inside):
            return True
    return False


def container(root: Element) -> tuple[list[Element], bool]:
    """Outermost articles that are no comments, else main, else the whole page; and whether one was named."""
    for tag in ("article", "main"):
        found: list[Element] = []
        queue = [root]
        while queue:
            e = queue.pop()
            if e.tag == tag and not any(names_other(e, n, v, False) for n, v in attributes_of(e)):
                found.append(e)
            elif e.tag == tag or excluded(e):
                continue
            else:
                queue += [c for c in reversed(e.children) if isinstance(c, Element)]
        if found:
            return found, True
    return [root], False


def link(e: Element) -> bool:
    return e.tag == "a" and "href" in e.attributes.lower() and not any(isinstance(c, Element) and c.tag in BLOCKS for c in e.children)


def digest(root: Element) -> None:
    """Hash every subtree from the leaves up: tag, collapsed text and the children's hashes.

    ``plain`` becomes the characters outside links, and ``prose`` whether any of them are in paragraphs, items or cells.
    """
    order, queue = [], [root]
    while queue:
        e = queue.pop()
        order.append(e)
        queue += [c for c in e.children if isinstance(c, Element)]
    for e in reversed(order):
        h, plain, prose = xxhash.xxh64(e.tag), 0, False
        for c in e.children:
            if isinstance(c, Element):
                h.update(c.digest.to_bytes(8, "little"))
                plain += c.plain
                prose |= c.prose
            elif text := SPACE.sub(" ", c).strip():
                h.update(text)
                plain += len(text)
        e.digest = h.intdigest()
        if e.tag not in NOT_TEXT and not link(e):
            e.plain, e.prose = plain, prose or plain > 0 and e.tag in PROSE and e.tag not in HEADINGS


def candidates(root: Element) -> tuple[int, set[int]]:
    """Hash of the page's content, and hashes of the subtrees of the whole page that may be template."""
    digest(root)
    parts, named = container(root)
    around, tops = holders(root, parts), set(parts)
    out, queue = set(), [(root, False)]
    while queue:
        e, inside = queue.pop()
        inside = inside or e in tops
        if e not in around and deletable(e) and not (named and inside and stays(e, True)) and any(isinstance(c, Element) or c.strip() for c in e.children):
            out.add(e.digest)
        queue += [(c, inside) for c in e.children if isinstance(c, Element)]
    whole = xxhash.xxh64()
    for e in parts:
        whole.update(e.digest.to_bytes(8, "little"))
    return whole.intdigest(), out


def deletable(e: Element) -> bool:
    return e.tag in BLOCKS and e.tag not in WHOLE


def stays(e: Element, named: bool) -> bool:
    """Whether it is prose of the container it lies in; a link alone is prose only in a named container."""
    return e.prose or e.tag in PROSE and (named or e.plain > 0)


def dropped(e: Element, named: bool) -> bool:
    """Whether exclusion takes it out of its container."""
    return excluded(e, named) or e.tag == "header" and not named


def holders(root: Element, parts: list[Element]) -> set[Element]:
    """The elements that a container lies in, which are never template."""
    out, wanted, queue = set(), set(parts), [(root, None)]
    above: dict[Element, Element | None] = {}
    while queue:
        e, parent = queue.pop()
        above[e] = parent
        if e not in wanted:
            queue += [(c, e) for c in e.children if isinstance(c, Element)]
    for e in parts:
        up = above[e]
        while up is not None and up not in out:
            out.add(up)
            up = above[up]
    return out


def own_part(root: Element, template: set[int]) -> Element:
    """The smallest block that holds all text which is neither template nor a link nor excluded; else the page."""
    order, queue, own = [], [(root, None)], {}
    while queue:
        e, parent = queue.pop()
        order.append((e, parent))
        own[e] = sum(1 for c in e.children if isinstance(c, str) and c.strip())
        queue += [(c, e) for c in e.children if isinstance(c, Element) and c.plain and not (deletable(c) and c.digest in template) and not dropped(c, False)]
    for e, parent in reversed(order):
        if parent is not None:
            own[parent] += own[e]
    if not own[root]:
        return root
    path = [root]
    while (inner := next((c for c in path[-1].children if isinstance(c, Element) and own.get(c) == own[root]), None)) is not None:
        path.append(inner)
    return next((e for e in reversed(path) if e.tag in BLOCKS and e.tag not in PROSE and e.tag not in GROUPS), root)


def recurring(root: Element, template: set[int], spare: bool) -> tuple[dict[Element, set[Element]], int, int]:
    """Subtrees to delete by parent, their characters of the content, and all characters of the content (outside links).

    Outside a named container everything that recurs goes. ``spare``: what holds text outside links stays.
    """
    parts, named = container(root)
    around, tops = holders(root, parts), set(parts if named else [own_part(root, template)])
    found: dict[Element, set[Element]] = {}
    gone, total = 0, sum(e.plain for e in parts)
    queue = [(root, root in tops)]
    while queue:
        e, inside = queue.pop()
        for c in e.children:
            if not isinstance(c, Element):
                continue
            within = inside or c in tops
            content = within or not named
            out = content and c not in tops and dropped(c, named)
            if c.digest in template and c not in around and deletable(c) and not (within and stays(c, named)) and not (spare and content and c.plain):
                found.setdefault(e, set()).add(c)
                gone += c.plain if content and not out else 0
            elif not out:
                queue.append((c, within))
            total -= c.plain if out else 0
    return found, gone, total


def delete_template(root: Element, template: set[int]) -> None:
    """Take the recurring subtrees out of the page, except prose of the container and what is most of the content."""
    found, gone, total = recurring(root, template, False)
    if 2 * gone > total:
        found, _, _ = recurring(root, template, True)
    for e, victims in found.items():
        e.children = [Element("hr") if c in victims else c for c in e.children]  # the blocks around it stay apart


def main_text(root: Element, template: set[int]) -> str:
    """Text blocks of the containers of the page without its template, and without excluded subtrees."""
    if template:
        delete_template(root, template)
    parts, named = container(root)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", html.unescape("".join(line))).strip()
        if text:
            blocks.append(text)
        line.clear()

    for part in parts:
        stack: list[Element | str | None] = [part]
        while stack:
            e = stack.pop()
            if e is None:
                flush()
            elif isinstance(e, str):
                line.append(e)
            elif e is not part and dropped(e, named):
                if e.tag in BLOCKS:
                    flush()
            elif e.tag in ("br", "wbr", "img"):
                line.append(" " if e.tag == "br" else "")
            else:
                block = e.tag in BLOCKS
                if block:
                    flush()
                    stack.append(None)
                stack += reversed(e.children)
        flush()
    return "\n".join(blocks)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def host_of(url: str) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))


def keyed(pages: DataFrame, *columns: F.Column, url: str, source: str) -> DataFrame:
    """host, html and a key of 128 bits of the page's source, with other columns."""
    out = pages.select(*columns, host_of(url).alias("host"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("html"))
    return out.withColumns({"p": F.xxhash64(F.lit(0), "html"), "q": F.xxhash64(F.lit(1), "html")})


def subtrees(pages: DataFrame, *, url: str = "url", source: str = "html") -> DataFrame:
    """host, p, q (key of the page), content, hash: what may be template, of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches, "html"):
            found = [candidates(parse(t)) for t in batch.column("html").to_pylist()]
            yield {"host": batch.column("host"), "p": batch.column("p"), "q": batch.column("q"), "content": [signed(c) for c, _ in found], "hashes": [sorted(map(signed, h)) for _, h in found]}

    rows = map_batches(keyed(pages, url=url, source=source), run, "host string, p long, q long, content long, hashes array<long>")
    return stash(rows.select("host", "p", "q", "content", F.explode("hashes").alias("hash")))


def recurring_subtrees(found: DataFrame, min_pages: int) -> DataFrame:
    return found.select("host", "hash", "content").distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages).select("host", "hash")


def template_table(pages: DataFrame, *, url: str = "url", source: str = "html", min_pages: int = 10) -> DataFrame:
    """host, hash: subtrees found on at least ``min_pages`` pages of a host, however many it has.

    Pages of one host with the same content count once, so mirrored articles do not look like template. Counting is
    partial before the shuffle, so a host with a third of all pages is no hot spot.
    """
    return recurring_subtrees(subtrees(pages, url=url, source=source), min_pages)


def extract_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", source: str = "html", min_pages: int = 10) -> DataFrame:
    """Per row: page_id, url, text (blocks joined by a line feed) and n_chars (code points).

    A missing or empty page has the empty text; pages without a host in their url share the empty host. Repeated rows
    give repeated results; other columns are not read. A page meets only the template hashes found on it, so a large
    host's template is never carried whole.
    """
    found = subtrees(pages, url=url, source=source)
    template = stash(recurring_subtrees(found, min_pages))
    hits = found.join(template, ["host", "hash"], "left_semi").groupBy("host", "p", "q").agg(F.collect_set("hash").alias("template"))
    rows = keyed(pages, F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), url=url, source=source)
    met = rows.join(stash(hits), ["host", "p", "q"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches, "html"):
            texts = []
            for t, known in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist()):
                root = parse(t or "")
                if known:
                    digest(root)
                texts.append(main_text(root, {k % (1 << 64) for k in known or ()}))
            yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(met.select("page_id", "url", "html", "template"), run, "page_id long, url string, text string, n_chars long")
