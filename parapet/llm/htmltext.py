"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of tags and words. Words score positive or negative by the element they stand in, tags score
negative; the contiguous stretch with the largest sum is the article, found in one linear scan. The weights come from
labelled pages: pages whose markup names the article itself (``article`` or ``main``), with its words as positives and
all others as negatives. Contexts that no labelled page has shown get a prior. Elements that are never part of an
article (menus, forms, adverts, notices, comments and so on, by name or by class, id or role) score below zero as a
whole and are left out even if they lie inside the stretch; forms and layout classes are not furniture where they wrap the
article.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from parapet.llm.common import slices

#: Labelled pages used for the weights, the lowest by hash of the URL.
PAGES = 400
CHUNK = 8 << 20
PRIOR_WORD, PRIOR_WEIGHT, LIMIT = 1.0, 5.0, 4.0
#: Score of a stretch of furniture, whatever its length: it is left out anyway and must not cut an article in two.
FURNITURE = -1.0
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*|[^>]*)>", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Their content is no markup, up to their end tag or the end of the page.
RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
#: Their content is markup, but never text of an article.
UNSEEN = {"noscript", "template", "svg", "object", "select", "option", "button", "canvas", "audio", "video"}
#: These hold no paragraphs, headings or articles: if their end tag is missing, such an element ends them.
PHRASES = {"option", "select", "button"}
ENDS_PHRASE = {"article", "main", "section", "p", "h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "center", "caption", "dd", "details", "dialog", "dir", "div",
          "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
          "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table",
          "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Elements that never hold article text; a header is one only outside an article.
OUTSIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "head", "address"}
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|nav|navbar|navigation|"
    r"menu|sidebar|side|footer|foot|masthead|topbar|breadcrumbs?|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|comments?|commentlist|"
    r"respond|replies|reply|disqus|widget|toolbar|pagination|pager|search|copyright|disclaimer|skip|hidden)(?:$|[\s_-])", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
ARTICLE = {"article", "main"}
#: An opening tag of these ends an open paragraph.
ENDS_P = BLOCKS - {"body", "html", "head", "td", "th", "tr", "caption", "tbody", "thead", "tfoot"}


#: Elements of running text: an id inside an article is a place to link to, whatever word it is.
PLACES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr", "blockquote", "pre", "figure", "caption", "table",
          "ul", "ol", "dl", "span", "a", "em", "strong", "b", "i", "code"}
#: Words that ids made from headings have and names of page parts do not.
SMALL_WORDS = re.compile(r"(?:^|[\s_-])(?:a|an|and|as|at|by|for|from|how|in|is|of|on|or|the|to|what|why|with|"
                         r"de|del|el|en|la|los|las|y|para|der|die|das|und|von|zu|im|le|les|des|du|et|pour)(?:$|[\s_-])", re.I)


def anchor(name: str, value: str) -> bool:
    """Whether an id inside an article names a place in the text and not a part of the page."""
    return name in PLACES or bool(SMALL_WORDS.search(value))


def boilerplate(name: str, rest: str, inside: bool) -> bool:
    """Whether an element is furniture by its name, class, id or role."""
    if name in OUTSIDE or name in UNSEEN or name == "header" and not inside:
        return True
    if name in ARTICLE or name in ("html", "body") or "=" not in rest:
        return False
    for key, a, b, c in ATTRIBUTE.findall(rest):
        value, key = a or b or c, key.lower()
        if key in ("class", "id") and NAMED.search(value) and not (inside and key == "id" and anchor(name, value)):
            return True
        if key == "role" and value.lower() in ROLES:
            return True
        if key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$)", ATTRIBUTE.sub(" ", rest)))


#: Furniture that is sure whatever it holds: named so, or by element.
SURE_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|"
    r"newsletter|subscribe|subscription|related|recommended|comments?|commentlist|respond|replies|reply|disqus|copyright|"
    r"disclaimer)(?:$|[\s_-])", re.I)
#: A wrapper without a named article inside must hold so many times the words that are left elsewhere.
WRAPS = 4


def wrapper(name: str, rest: str) -> bool:
    """Whether furniture may yet be the layout around an article: a form, or known by a class or id for layout only."""
    if name in UNSEEN or name in OUTSIDE and name != "form" or name == "header":
        return False
    if re.search(r"(?:^|\s)hidden(?:\s|$)", ATTRIBUTE.sub(" ", rest)):
        return False
    for key, a, b, c in ATTRIBUTE.findall(rest):
        value, key = a or b or c, key.lower()
        if key in ("class", "id") and SURE_NAMED.search(value) or key == "role" and value.lower() in ROLES - {"form"}:
            return False
        if key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return False
    return True


def cleared(words: list[tuple[int, int]], wraps: list[bool], parents: list[int], articles: list[bool]) -> list[bool]:
    """Which furniture turns out to wrap the article, from a page's stretches (words, innermost furniture or -1).

    An element does if it may be a wrapper and holds more words outside other furniture than the rest of the page; if no
    named article is inside, ``WRAPS`` times as many. Outer elements are looked at first. Elements are numbered in page
    order, ``parents`` are the furniture around them, so every sum is one run over them.
    """
    size = len(wraps)
    found = [False] * size
    if not any(wraps):
        return found
    pure = [False] * size  # it and all furniture around it may be wrappers
    direct, rest = [0] * size, 0
    for n, mark in words:
        if mark < 0:
            rest += n
        else:
            direct[mark] += n
    for m in range(size):
        pure[m] = wraps[m] and (parents[m] < 0 or pure[parents[m]])
    held = [n if p else 0 for n, p in zip(direct, pure)]
    for m in range(size - 1, -1, -1):
        if parents[m] >= 0:
            held[parents[m]] += held[m]
    for m in range(size):
        open_to = parents[m] < 0 or found[parents[m]]  # no furniture left around it
        if open_to and pure[m] and held[m] > rest * (1 if articles[m] else WRAPS):
            found[m] = True
            rest += direct[m]
    return found


Run = tuple[int, str, bool, str, str, bool]  # block, context, furniture, tag before, text, inside a named article


def runs(page: str) -> list[Run]:
    """Stretches of text between tags, in page order, each with the tag that came before it.

    Tags without text after them come with an empty text. Unclosed elements end with the page or with an outer element.
    Furniture that wraps the article does not count as such.
    """
    wraps: list[bool] = []  # of all furniture, in page order
    parents: list[int] = []
    articles: list[bool] = []
    found = list(_stretches(page, wraps, parents, articles))
    for m in range(len(parents) - 1, -1, -1):
        if articles[m] and parents[m] >= 0:
            articles[parents[m]] = True
    clear = cleared([(len(text.split()), mark) for _, _, mark, _, text, _ in found if text.strip()], wraps, parents, articles)
    left = []  # whether furniture is left at or around each
    for m, parent in enumerate(parents):
        left.append(not clear[m] or parent >= 0 and left[parent])
    return [(block, context, mark >= 0 and left[mark], tag, text, inside) for block, context, mark, tag, text, inside in found]


def _stretches(page: str, wraps: list[bool], parents: list[int], articles_in: list[bool]) -> Iterator[tuple]:
    """``runs`` with the number of the innermost furniture around each (-1: none).

    Fills in for each furniture whether it may be a wrapper, the furniture around it, and whether an article begins directly
    inside.
    """
    stack: list[tuple[str, bool]] = []  # element, furniture
    block, at, tag, mark = 0, 0, "", -1
    articles = phrases = formulas = 0

    def text(stop):
        context = next((n for n, _ in reversed(stack) if n in BLOCKS or n == "a"), "page")
        return block, context, mark, tag, page[at:stop], articles > 0

    def pop(k):
        nonlocal mark, articles, phrases, formulas
        for name, bad in stack[k:]:
            mark = parents[mark] if bad else mark
            articles -= name in ARTICLE
            phrases -= name in PHRASES
            formulas -= name == "math"
        del stack[k:]

    while True:
        found = TOKEN.search(page, at)
        yield text(found.start() if found else len(page))
        if not found:
            return
        at, tag, name = found.end(), "", found["name"]
        if name is None:
            continue
        name = name.lower()
        tag = "" if name == "math" or formulas else name  # formulas are all tags
        if name in BLOCKS:
            block += 1
        if found["close"]:
            own = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if own is not None:
                pop(own)
            continue
        rest = found["rest"]
        if name in RAW:
            if not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in UNSEEN and rest.endswith("/"):
            continue
        if name in ENDS_PHRASE and phrases:
            own = next(k for k, e in enumerate(stack) if e[0] in PHRASES)
            end = re.compile(rf"<(/?){stack[own][0]}\b", re.I).search(page, at)
            if not (end and end[1]):
                pop(own)
        if name in ENDS_P:
            own = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCKS), None)
            if own is not None and (stack[own][0] == "p" or stack[own][0] == name == "li"):
                pop(own)
        if name in VOID:
            continue
        bad = boilerplate(name, rest, articles > 0)
        stack.append((name, bad))
        phrases += name in PHRASES
        formulas += name == "math"
        if bad:
            parents.append(mark)
            mark = len(wraps)
            wraps.append(wrapper(name, rest))
            articles_in.append(False)
        if name in ARTICLE:
            if mark >= 0:
                articles_in[mark] = True
            articles += 1


class Weights:
    """Score of a word by context, and of a tag by name."""

    def __init__(self, words: dict[str, float], tags: dict[str, float]):
        self.words, self.tags = words, tags

    def word(self, context: str) -> float:
        return self.words.get(context, PRIOR_WORD if context not in ("a", "page") else -PRIOR_WORD)

    def tag(self, name: str) -> float:
        return self.tags.get(name, -0.5) if name else 0.0


def counts(page: str) -> Counter | None:
    """Words by (context, inside the article) and tags likewise; nothing for a page without a named article."""
    found: Counter = Counter()
    labelled = False
    for _, context, furniture, tag, text, inside in runs(page):
        labelled |= inside
        n = len(text.split())
        if n and not furniture:
            found["word", context, inside] += n
        if tag:
            found["tag", tag, inside and not furniture] += 1
    return found if labelled else None


def weights(totals: dict[tuple[str, str, bool], int]) -> Weights:
    """Smoothed log odds of lying inside, for words; for tags, never above zero."""
    def odds(kind, name, prior):
        inside, outside = totals.get((kind, name, True), 0), totals.get((kind, name, False), 0)
        share = (inside + PRIOR_WEIGHT * prior) / (inside + outside + PRIOR_WEIGHT)
        return max(-LIMIT, min(LIMIT, math.log(share / (1 - share))))

    words = {name: odds("word", name, 0.6) for kind, name, _ in totals if kind == "word"}
    tags = {name: min(-0.1, odds("tag", name, 0.4) / 4) for kind, name, _ in totals if kind == "tag"}
    return Weights(words, tags)


def fit(pages: DataFrame, most: int = PAGES, url: str = "url", markup: str = "html") -> Weights:
    """Weights from a bounded number of labelled pages. Without any, all contexts have their prior."""
    named = pages.select(F.col(url).alias("url"), F.col(markup).cast("string").alias("html")).filter(
        F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    picked = named.select("url").orderBy(F.xxhash64("url"), "url").limit(most)
    rows = named.join(picked.dropDuplicates(["url"]), "url")

    def run(batches):
        for batch in slices(batches, "html", CHUNK):
            total: Counter = Counter()
            for page in batch.column("html").to_pylist():
                total.update(counts(page) or {})
            keys = list(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1][:40] for k in keys], pa.string()),
                 pa.array([k[2] for k in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())],
                ["kind", "name", "inside", "n"])

    table = rows.select("html").mapInArrow(run, "kind string, name string, inside boolean, n long")
    known = F.col("name").isin(sorted(BLOCKS | VOID | RAW | UNSEEN | {"a", "page"}))  # bounds what comes to the driver
    got = table.filter(known).groupBy("kind", "name", "inside").agg(F.sum("n").alias("n")).collect()
    return weights({(r["kind"], r["name"], r["inside"]): r["n"] for r in got})


def extract(page: str | None, w: Weights) -> str:
    """The article's text, one line per block."""
    if not page:
        return ""
    found = runs(page)
    best = total = 0.0
    first = start = 0
    last = -1
    for i, (_, context, furniture, tag, text, _) in enumerate(found):
        total += w.tag(tag)
        if total <= 0:
            total, start = 0.0, i
        n = len(text.split())
        if n:
            total += FURNITURE if furniture else n * w.word(context)
            if total > best:
                best, first, last = total, start, i
            elif total < 0:
                total, start = 0.0, i + 1
    lines: list[str] = []
    held: list[str] = []
    block = None
    for own, _, furniture, tag, text, _ in found[first:last + 1]:
        if own != block:
            lines.append("".join(held))
            held, block = [], own
        if tag == "br" and held:
            held.append(" ")
        if not furniture:
            held.append(html.unescape(text))
    lines.append("".join(held))
    return "\n".join(line for line in (" ".join(x.split()) for x in lines) if line)


def main_text(pages: DataFrame, w: Weights, markup: str = "html") -> DataFrame:
    """All columns but the markup, with ``text`` and ``n_chars``; one row per page, without a shuffle.

    Null, empty and text-free pages give an empty text. Columns named ``text`` or ``n_chars`` are replaced.
    """
    others = [c for c in pages.columns if c not in (markup, "text", "n_chars")]
    # the other columns travel as one value, so that no name of theirs can clash
    page = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("none"))
    packed = pages.select(page.alias("page"), F.col(f"`{markup}`").cast("string").alias("markup"))

    def run(batches):
        for batch in slices(batches, "markup", CHUNK):
            texts = [extract(x, w) for x in batch.column("markup").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page", "text", "n_chars"])

    schema = T.StructType([packed.schema["page"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return packed.mapInArrow(run, schema).select(*[F.col("page")[c].alias(c) for c in others], "text", "n_chars")
