"""Main text of web pages by tag-path ratios.

A page becomes a list of blocks (text between block-level tags), each with the path of tags from the root to
the element that holds it. Blocks in elements or under class names that are never content (menus, adverts,
comments and the like) are out. For the paths of all others, on every page, text length and punctuation are
summed over the blocks, and the share of link text; they give the path's ratio. Ratios are smoothed over
neighbouring blocks in page order, fused with what the tags of the path say (text elements, inside an article),
and paths above a threshold, relative to the page, are selected. Pages are independent of each other.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.llm.rows import quoted, whole_text

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Element names by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe noembed noframes xmp".split())
HIDDEN = RAW | frozenset("head title svg math object canvas audio video select option datalist button input label".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot "
    "th thead tr ul".split()
)
INSIDE = frozenset(("article", "main"))
OUTSIDE = frozenset("nav menu header footer aside form dialog search fieldset legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUTSIDE_NAMES = frozenset(
    "ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "copyright disclaimer disqus footer header legal login masthead menu modal nav navbar navigation newsletter notice notification "
    "pager pagination paywall popup promo promoted promotion recommend recommended related reply replies respond share sharing sidebar "
    "signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: A block starting with one of these ends an open element of the listed names.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？؟؛،।॥]")
#: Elements that are made to hold text; all other block elements are containers.
TEXT_ELEMENTS = HEADINGS | frozenset("p li dt dd td th pre blockquote caption figcaption summary".split())
#: A path is selected from this share of the mean ratio of the page's plain text (by length). Added to a path's
#: ratio: for a text element (the limit is never higher, so short cells and items without links stay), and inside
#: an article.
LEVEL_SHARE, TEXT_TERM, INSIDE_TERM = 0.5, 5.0, 1.0


@dataclass
class Block:
    path: str
    inside: bool
    outside: bool
    heading: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _named_outside(attributes: str) -> bool:
    words: list[str] = []
    for m in ATTRIBUTE.finditer(attributes):
        words += [w.lower() for w in NAME_PART.findall(m[2] or m[3] or m[4] or "")] + ["."]
    return any(w in OUTSIDE_NAMES and words[i - 1:i] not in (["with"], ["has"], ["no"]) for i, w in enumerate(words))


def blocks(page: str) -> list[Block]:
    """All non-empty blocks of visible text in page order."""
    found: list[Block] = []
    # Open elements: name, path, inside an article, outside of content, in a heading, hidden, link.
    stack = [("", "", False, False, False, False, False)]
    now: Block | None = None
    at = 0

    def add(text: str) -> None:
        nonlocal now
        _, path, inside, outside, heading, hidden, link = stack[-1]
        if hidden or not text:
            return
        if now is None:
            now = Block(path, inside, outside and not heading, heading)
            found.append(now)
        now.parts.append(text)
        if link:
            now.linked += len(text)

    def leave(names: tuple[str, ...], until: frozenset[str]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in names:
                del stack[depth:]
                return
            if stack[depth][0] in until:
                return

    while at < len(page):
        m = TAG.search(page, at)
        if not m:
            add(html.unescape(page[at:]))
            break
        add(html.unescape(page[at:m.start()]))
        at = m.end()
        if m[1] is not None:
            add(m[1])
        if m[3] is None:
            continue
        name = m[3].lower()
        if name in BLOCK:
            now = None
        elif name == "br":
            add(" ")
        if m[2]:
            if name == "p" or name in BLOCK:
                leave((name,), frozenset())
            else:
                leave((name,), BLOCK)
            continue
        if name in BLOCK and name not in ("html", "body"):
            leave(("p",), BLOCK - {"p"})
        if name in ENDS:
            leave(ENDS[name], frozenset(("ul", "ol", "dl", "table", "menu")) if name not in ("td", "th") else frozenset(("tr", "table")))
        if name in HEADINGS:
            leave(tuple(HEADINGS), BLOCK - HEADINGS)
        if name in VOID:
            continue
        _, path, inside, outside, heading, hidden, link = stack[-1]
        inside_here = inside or name in INSIDE
        # A header inside an article holds the title: its headings count, its other text does not.
        title = name in HEADINGS and inside and any(s[0] == "header" for s in stack) and not any(s[3] and s[0] != "header" for s in stack if s[0] in OUTSIDE)
        out_here = outside or name in OUTSIDE or (name not in ("html", "body", "article", "main") and _named_outside(m[4]))
        where = f"{path}/{name}" if name in BLOCK else path
        stack.append((name, where, inside_here, out_here, heading or title, hidden or name in HIDDEN, link or name == "a"))
        if name in RAW:
            end = re.compile(rf"</{name}\b", re.I).search(page, at)
            at = end.start() if end else len(page)
    return [b for b in found if b.text()]


def path_scores(found: list[Block]) -> tuple[dict[str, float], float]:
    """Fused score of every path, and the score from which a path is selected.

    A block's ratio is the logarithm of its path's mean length times one more than its mean punctuation (text
    without any marks, as in lists, verse and code, has its length alone). Ratios are smoothed over neighbours of
    the same kind (text elements or containers), so a container between paragraphs does not borrow from them.
    Tag and place are terms beside it, and the share of plain text is a factor on the sum.
    """
    sums: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    texts = [b.text() for b in found]
    for b, text in zip(found, texts):
        total = sums[b.path]
        total[0] += 1
        total[1] += len(text)
        total[2] += len(PUNCTUATION.findall(text))
        title = b.inside and b.path.rpartition("/")[2] in HEADINGS  # titles of articles are often links
        total[3] += 0 if title else min(b.linked, len(text))
    # Where an article is nothing but link text, that text is all there is to select from.
    linked_only = any(b.inside for b in found) and all(total[1] == total[3] for total in sums.values())
    ratio = {p: math.log1p(length / n * (1 + punctuation / n)) for p, (n, length, punctuation, _) in sums.items()}
    kind = {p: p.rpartition("/")[2] in TEXT_ELEMENTS for p in sums}
    best: dict[str, float] = {}
    level = 0.0
    for i, (b, text) in enumerate(zip(found, texts)):
        own = ratio[b.path]
        near = [found[j].path if 0 <= j < len(found) else b.path for j in (i - 1, i + 1)]
        smooth = 0.5 * own + 0.25 * sum(ratio[p] if kind[p] == kind[b.path] else own for p in near)
        length, linked = sums[b.path][1], 0 if linked_only else sums[b.path][3]
        plain = 1 - linked / length
        level += own * plain * len(text)
        score = (smooth + TEXT_TERM * kind[b.path] + INSIDE_TERM * b.inside) * plain
        best[b.path] = max(best.get(b.path, 0.0), score)
    return best, min(TEXT_TERM, LEVEL_SHARE * level / max(1, sum(map(len, texts))))


def extract(page: str) -> str:
    """Selected blocks of a page, one per line; empty if there are none."""
    usable = [b for b in blocks(page) if not b.outside]
    best, limit = path_scores(usable)
    return "\n".join(b.text() for b in usable if best[b.path] > 0 and best[b.path] >= limit)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``.

    Null and empty html give the empty text. Null ids and urls and repeated rows are kept, ids unchanged; extra columns are
    not read; an empty table gives no rows. Broken html (open tags, cut pages, stray ends) is read as far as
    it goes; a page is never cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = pa.array([extract(page.as_py()) for page in part.column(2)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], names=["id", "url", "text"])

    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])
    rows = pages.select(quoted(id_col).alias("id"), quoted(url_col).cast("string").alias("url"), whole_text(html_col).alias("html"))
    done = rows.mapInArrow(run, schema)
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
