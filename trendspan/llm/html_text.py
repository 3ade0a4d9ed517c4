"""Main text of web pages: the maximum-scoring subsequence of their words and tags.

A page is a sequence of words and tags. Words score by the kind of block they stand in, tags score negative, and one
linear scan finds the contiguous region with the largest sum (Pasternack and Roth, 2009). The weights are log-odds
of lying inside the content rather than outside it, counted on labelled pages: a bounded sample of pages whose own
markup names their content with an ``article`` or ``main`` element. A tag never weighs more than slightly below zero,
and a word in a kind of block that no labelled page has scores by whether the markup calls it boilerplate.

From the region, what the markup calls a menu, header, footer, sidebar, notice, advert, form, comment section, script
or style is left out: elements whose tag says so, and elements one of whose names (words of class, id and the like) does.
Of a name that stands often enough on labelled pages, its share of words outside their content decides. Any other name
is read as a compound: without words that only place or wrap, such as ``left`` or ``box``, all that is left has to be
boilerplate, so ``share-price-report`` is none; ``no-sidebar``, ``has-comments`` and ``with-banner`` speak of the page.
Names beside a name of content or layout on one element don't count. An element so named that holds most of the words
that are no boilerplate by tag is no boilerplate either where its name has a second sense, as ``banner`` or ``notice``.
Character references are decoded as browsers do, white space inside a block becomes one space, and the blocks are joined
by line feeds.

Every step is one pass: an end tag without a start is known from counts of open elements, and each element is pushed and
popped once, so a page of unclosed tags takes time in proportion to its length.

Edge cases: null and empty pages and pages without content words have the empty text; unclosed elements end with their
parent, scripts and styles end at their closing tag only, and a page may be cut off anywhere; rows are independent, so
ties between regions go to the first and longest, and repeated rows each give a row; without labelled pages the standing
weights are used; extra columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspan.llm.shared import table

#: Most labelled pages that the weights are counted on.
SAMPLE = 2000

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(?P<raw>script|style|textarea|iframe|title|xmp)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)
      | <(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>
      | <[/!?a-zA-Z][^>]*(?:>|\Z)
      | [^<]+
      | <""",
    re.S | re.I | re.X,
)
_NAMED = re.compile(r"""(?:\b(?:class|id|role|itemprop|aria-label))\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")

# Elements that are a block of their own.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
# Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is never the article's.
OUTSIDE = frozenset("nav footer aside form head menu dialog button label fieldset search select noscript template svg".split())
# Parts of class names and the like that call an element boilerplate.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted promotion recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split()
)
# Words that only place, wrap or number what the rest of a name says.
MODIFIERS = frozenset(
    "area articles bar block bottom box btn button buttons center col column container content desktop fixed form group icon icons info inner inline item items js large law left link links list main mobile outer page panel policy post posts primary reader right row secondary section site slot small stories sticky tertiary text the thread tools top unit user view wrap wrapper zone".split()
)
# Names that speak of a part elsewhere, and names of what holds the content; neither is boilerplate.
NEGATED = frozenset("no has have with without off not non hide".split())
HOLDERS = frozenset("content article post entry story layout main page body wrapper container hentry single".split())
# Boilerplate words that may also say what a page is about, so an element that holds most of a page isn't dropped for them.
AMBIGUOUS = frozenset("banner login menu menus modal newsletter notice notices popup promo promoted promotion recommended related share sharing skip social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split())
# Elements whose names are never held against them, since they hold the content.
CONTENT = frozenset("html body main article".split())
# An opening tag of the second kind ends an open element of the first.
ENDS = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]), "head": frozenset(["body"])}

#: Standing weights, for what labelled pages say nothing about.
WORD, TAG, BLOCK_TAG = 0.7, -0.1, -0.3
#: Marked boilerplate is left out anyway; inside an article it should not cut the article in two.
MARKED_WORD, MARKED_TAG = -0.1, -0.02
#: Lowest weights of the tags that hold labelled content, and of other tags.
LOWEST, LOWEST_TAG = -8.0, -0.3

#: Words under a name on labelled pages from which on these decide whether it is boilerplate, and the least log-odds of that.
NAME_WORDS, NAME_ODDS = 200, -1.5

#: (text or tag, kind of block or tag, number of words, inside boilerplate, inside article or main, names above)
Token = tuple[str | None, str, int, bool, bool, tuple[str, ...]]
Weights = dict[str, float]


def names_of(attributes: str) -> list[list[str]]:
    """The names of an element, by attribute."""
    return [m[1].strip("\"'").split() for m in _NAMED.finditer(attributes)]


def named_boilerplate(names: list[list[str]], weights: Weights) -> tuple[bool, bool]:
    """Whether names call an element boilerplate; and whether one does so without doubt, or by what was learned."""
    marked = sure = False
    for some in names:
        parts = [[p.lower() for p in _PART.findall(name)] for name in some]
        if any(len(p) == 1 and p[0] in HOLDERS for p in parts) and len(parts) > 1:
            continue
        for name, p in zip(some, parts, strict=True):
            known = weights.get("." + name.lower())
            if known is not None:
                marked, sure = marked or known < NAME_ODDS, sure or known < NAME_ODDS
            elif p and NEGATED.isdisjoint(p):
                core = [x for x in p if x not in MODIFIERS]
                if core and NAMES.issuperset(core):
                    marked, sure = True, sure or AMBIGUOUS.isdisjoint(core)
    return marked, sure


class _Open:
    """An open element: what it stands in, the nearest block around or at it, and where the last such block is on the stack."""

    __slots__ = ("bad", "block", "block_at", "inside", "names", "tag")

    def __init__(self, tag: str, bad: bool, inside: bool, block: str, block_at: int, names: tuple[str, ...]):
        self.tag, self.bad, self.inside, self.block, self.block_at, self.names = tag, bad, inside, block, block_at, names


def tokens(page: str, weights: Weights | None = None, spared: frozenset[int] = frozenset(), sizes: dict[int, list[int]] | None = None) -> Iterator[Token]:
    """Runs of text and tags with what they stand in. A run of text has its references decoded.

    Marks by name of the elements that begin at the places ``spared`` are ignored. ``sizes`` takes the words of each
    outermost element marked by name alone, and at -1 those outside of all boilerplate.
    """
    weights = weights or {}
    stack: list[_Open] = []
    count: dict[str, int] = {}
    root = _Open("", False, False, "", -1, ())
    top = root
    named = depth = -1  # the outermost element marked by name that is open, and its place on the stack

    def pop() -> None:
        nonlocal top, named, depth
        count[stack.pop().tag] -= 1
        top = stack[-1] if stack else root
        if len(stack) <= depth:
            named = depth = -1

    for m in _TOKEN.finditer(page):
        tag = m["tag"]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or len(piece) == 1:
                text = html.unescape(piece)
                n = len(text.split())
                if sizes is not None and n and (named >= 0 or not top.bad):
                    sizes.setdefault(named, [0])[0] += n
                yield text, ("!" if top.bad else "") + top.block, n, top.bad, top.inside, top.names
            continue
        tag, end, attributes = tag.lower(), m["end"], m["attributes"] or ""
        if end:
            if count.get(tag, 0):
                # Tags inside an article don't end what stands around it.
                while stack[-1].tag != tag:
                    pop()
                pop()
        else:
            while stack and tag in ENDS.get(stack[-1].tag, ()):
                pop()
            # A paragraph ends before a block also where inline elements in it are still open.
            if tag in BLOCKS and top.block_at >= 0 and stack[top.block_at].tag == "p":
                at = top.block_at
                while len(stack) > at:
                    pop()
            if tag not in VOID and not attributes.endswith("/"):
                bad, names = top.bad, top.names
                if not bad and (tag in OUTSIDE or (tag == "header" and not top.inside)):
                    bad = True
                elif attributes and tag not in CONTENT:
                    found = names_of(attributes)
                    if found:
                        names = tuple(dict.fromkeys([*names[-8:], *(x.lower() for some in found for x in some)]))
                        if not bad and m.start() not in spared and named_boilerplate(found, weights)[0]:
                            bad = True
                            named, depth = m.start(), len(stack)
                inside = top.inside or tag in ("article", "main")
                block = tag in BLOCKS
                top = _Open(tag, bad, inside, tag if block else top.block, len(stack) if block else top.block_at, names)
                stack.append(top)
                count[tag] = count.get(tag, 0) + 1
        yield None, ("/" if end else "") + tag, 0, top.bad, top.inside and tag not in ("article", "main"), ()


def page_tokens(page: str, weights: Weights) -> list[Token]:
    """The page's tokens, with elements spared that are named as boilerplate but hold most of the words."""
    spared: frozenset[int] = frozenset()
    while True:
        sizes: dict[int, list[int]] = {}
        found = list(tokens(page, weights, spared, sizes))
        total = sum(n[0] for n in sizes.values())
        wide = [at for at, n in sizes.items() if at >= 0 and 2 * n[0] > total]
        # Only one element can hold most, and each round goes at least one element deeper.
        if not wide or len(spared) >= 8:
            return found
        m = _TOKEN.match(page, wide[0])
        if named_boilerplate(names_of(m["attributes"] or ""), weights)[1]:
            return found
        spared |= {wide[0]}


def weight(kind: str, weights: Weights, is_tag: bool, marked: bool) -> float:
    if marked:
        return MARKED_TAG if is_tag else MARKED_WORD
    if is_tag:
        known = weights.get("<" + kind)
        return known if known is not None else (BLOCK_TAG if kind.lstrip("/") in BLOCKS else TAG)
    return weights.get(kind, WORD)


def best_region(scores: list[float]) -> tuple[int, int]:
    """The first and longest contiguous stretch with the largest sum, in one pass; empty where no sum is positive."""
    best, start, end = 0.0, 0, 0
    total, begin = 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, start, end = total, begin, i + 1
    return start, end


def main_text(page: str | None, weights: Weights) -> str:
    found = page_tokens(page or "", weights)
    scores = [weight(kind, weights, text is None, bad) * (1 if text is None else n) for text, kind, n, bad, *_ in found]
    start, end = best_region(scores)
    blocks: list[str] = []
    parts: list[str] = []

    def close() -> None:
        block = " ".join("".join(parts).split())
        if block:
            blocks.append(block)
        parts.clear()

    for text, kind, _, bad, *_ in found[start:end]:
        if text is None:
            tag = kind.lstrip("/")
            if tag in BLOCKS:
                close()
            elif tag == "br":
                parts.append(" ")
        elif not bad:
            parts.append(text)
    close()
    return "\n".join(blocks)


def count_labels(page: str) -> dict[str, list[int]]:
    """How often each kind of word and tag, and words below each name, stand inside and outside the labelled content."""
    out: dict[str, list[int]] = {}
    for text, kind, n, bad, inside, names in tokens(page):
        if n:
            # A name inside an article that marks an advert there is read by the standing rule.
            for name in names:
                if not (inside and bad):
                    out.setdefault("." + name, [0, 0])[0 if inside else 1] += n
        if text is None:
            out.setdefault("<" + kind, [0, 0])[0 if inside and not bad else 1] += 1
        elif n:
            out.setdefault(kind, [0, 0])[0 if inside and not bad else 1] += n
    return out


def learn_weights(pages: DataFrame, sample: int = SAMPLE, key: str = "page_id", text: str = "html") -> Weights:
    labelled = pages.select(F.col(key).cast("long").alias("k"), F.col(text).alias("html")).where(F.col("html").rlike(r"(?i)<(article|main)\b"))
    chosen = labelled.select("k").orderBy(F.xxhash64("k"), "k").limit(sample).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[int]] = {}
        for batch in batches:
            for page in batch.column(0):
                for kind, (a, b) in count_labels(page.as_py()).items():
                    t = total.setdefault(kind, [0, 0])
                    t[0] += a
                    t[1] += b
        rows = [(k, a, b) for k, (a, b) in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["kind", "a", "b"])

    # The kinds of tags on a bounded number of pages.
    rows = labelled.join(F.broadcast(chosen), "k").select("html").mapInArrow(run, "kind string, a long, b long").groupBy("kind").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    words = [r for r in rows if r.kind[:1] not in ("<", ".")]
    inside, outside = sum(r.a for r in words) + 1, sum(r.b for r in words) + 1
    out: Weights = {}
    for r in rows:
        odds = math.log((r.a + 0.5) / inside) - math.log((r.b + 0.5) / outside)
        if r.kind[:1] == ".":
            if r.a + r.b >= NAME_WORDS:
                out[r.kind] = odds
        elif r.kind[:1] == "<":
            lowest = LOWEST if r.kind.strip("</") in ("article", "main") else LOWEST_TAG
            out[r.kind] = min(-0.05, max(lowest, odds))
        else:
            # Rare kinds stay near the standing weight.
            n = r.a + r.b
            out[r.kind] = (max(-3.0, min(1.5, odds)) * n + WORD * 50) / (n + 50)
    return out


def extract(pages: DataFrame, weights: Weights, key: str = "page_id", text: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = [main_text(p.as_py(), weights) for p in some.column(2)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(key).cast("long").alias("page_id"), "url", F.col(text).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learn_weights(pages))
