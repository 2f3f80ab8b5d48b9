"""Main text of web pages by the maximum-scoring subsequence.

A page is read as a sequence of tokens: words, by the element they stand in, and tags.  Words
score positive and tags negative; one linear scan finds the contiguous region of greatest sum,
and the text of that region is the page's, without the elements that never are content.  The
scores are log odds of a token inside and outside the content of labelled pages: those, of a
sample of about SAMPLE pages, whose markup names its one article.  Without any, the prior
scores stand.  Where the markup names one article (or else one main), words outside it are tokens
of their own, which score negative, and what is left out within it costs nothing.  An element that
holds an article or main, or most of the page's words, is never left out for its name; the scores
decide there.  Every step takes time linear in the page.

Defined cases: a null or empty page, or one without words, gives the empty text; a null page_id
or url stays null; equal rows give equal texts; an element that is never closed hides nothing;
other columns play no part.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLE = 2000
#: Elements that hold no part of an article.
NEVER = frozenset("script style noscript template head title nav footer aside form button select textarea iframe svg menu dialog object".split())
#: Those of them whose text a reader never sees, and those that mean what is beside an article.
UNSEEN = frozenset("script style template head title select textarea iframe svg".split())
BESIDE = frozenset("nav footer aside menu dialog".split())
#: Whole names in class, id or role that mark what is no part of an article.
MARKS = frozenset("ad ads advert adverts advertisement sponsored sponsor promo promoted sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent notice notices banner popup modal newsletter subscribe share sharing social related comments comment contentinfo complementary search disclaimer".split())
#: Elements within a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr output picture q rb rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is text up to their closing tag.
RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "title", "textarea")}
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile(r"[\"'>]")
MARKED = re.compile(r"""(?<![^\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD_SCORE, TAG_SCORE, NEVER_SCORE, BESIDE_SCORE = 3.0, -1.0, -1.5, -3.0

Token = tuple[str, str, str]  # kind (open, close, text), element's name, text


#: Elements whose id counts; on headings, sections and the like it is made from a heading's text.
NAMED = frozenset("div ul ol table".split())


def marked(name: str, attributes: str) -> bool:
    """Whether a whole name of the element's class or role, or its id, is in MARKS."""
    found: dict[str, list[str]] = {}
    for kind, *value in MARKED.findall(attributes):
        found.setdefault(kind.lower(), "".join(value).lower().split())
    names = found.get("class", []) + found.get("role", [])
    if name in NAMED and "section" not in names:
        names = names + found.get("id", [])
    return not MARKS.isdisjoint(names)


def parts(page: str) -> list[tuple[str, str, str]]:
    """Tags (open or close, with name and attributes) and texts, in order.  A tag whose quotes
    never end closes at the next ">"; a "<" that begins no tag is text."""
    found: list[tuple[str, str, str]] = []
    at = begin = 0  # read up to here; where the text not yet given begins
    last, quotes = page.rfind(">"), True

    def text(to: int) -> None:
        if to > begin:
            found.append(("text", "", page[begin:to]))

    while (p := page.find("<", at)) >= 0:
        mark = page[p + 1 : p + 2]
        if page.startswith(("<!--", "<![CDATA["), p):
            end = "-->" if page[p + 2] == "-" else "]]>"
            text(p)
            q = page.find(end, p + 4)
            at = begin = len(page) if q < 0 else q + 3
            continue
        if p > last:
            break
        if mark in ("!", "?") and mark:
            text(p)
            at = begin = page.find(">", p) + 1
            continue
        m = NAME.match(page, p)
        if not m:
            at = p + 1
            continue
        name, i = m[1].lower(), m.end()
        if mark != "/" and name in RAW:
            text(p)
            end = RAW[name].search(page, page.find(">", i) + 1)
            found += [("open", "!" + name, ""), ("close", "!" + name, "")]
            at = begin = end.end() if end else len(page)
            continue
        while quotes and (x := STOP.search(page, i)) and x[0] != ">":
            i = page.find(x[0], x.end()) + 1
            quotes = i > 0
        q = page.find(">", i if quotes else m.end())
        if q < 0:
            quotes = False
            q = page.find(">", m.end())
        text(p)
        found.append(("close" if mark == "/" else "open", name, page[m.end() : q]))
        at = begin = q + 1
    text(len(page))
    return found


def tokens(page: str) -> list[Token]:
    """The page's tags and texts; text in elements that are never content is left out, and such
    an element's tags are named after it with a "!", or with a "?" within the article.  Texts
    outside it stand in an element named with a "~"."""
    found = parts(page)
    words = list(accumulate((len(x[2].split()) if x[0] == "text" else 0 for x in found), initial=0))
    mains = list(accumulate((x[0] == "open" and x[1] in ("article", "main") for x in found), initial=0))
    # where each element ends: after the closing tag that matches
    ends, opened = {}, defaultdict(list)
    for i, (kind, name, _) in enumerate(found):
        if kind == "open":
            opened[name].append(i)
        elif kind == "close" and opened[name]:
            ends[opened[name].pop()] = i + 1

    def held(name: str, i: int, j: int) -> bool:
        """Whether the element found[i:j] has what must not be left out."""
        if name in UNSEEN:
            return False
        if mains[j] > mains[i]:
            return True
        return 2 * (words[j] - words[i]) > words[-1] and not (name in BESIDE and mains[-1])

    out: list[Token] = []
    i, stack, inside, articles = 0, [], Counter(), 0
    while i < len(found):
        kind, name, rest = found[i]
        hides = kind == "open" and i in ends and name not in VOID and name not in ("html", "body", "article", "main") and (name in NEVER or (name == "header" and not articles) or marked(name, rest))
        if hides and not rest.rstrip().endswith("/") and not held(name, i, ends[i]):
            out += [("open", "!" + name, ""), ("close", "!" + name, "")]
            i = ends[i]
            continue
        if kind == "text":
            out.append(("text", stack[-1] if stack else "", rest))
        else:
            out.append((kind, name, ""))
            if name == "article":
                articles += 1 if kind == "open" else -1
            if name not in VOID and name[0] != "!" and name not in INLINE:
                if kind == "open":
                    if not (name == "p" and stack and stack[-1] == "p"):
                        stack.append(name)
                        inside[name] += 1
                elif inside[name]:
                    while (x := stack.pop()) != name:
                        inside[x] -= 1
                    inside[name] -= 1
        i += 1
    holder = label(out) or label(out, "main")
    if holder is None:
        return out
    lo, hi = holder
    beside = lambda t: (t[0], "~" + t[1], t[2]) if t[0] == "text" else t
    within = lambda t: (t[0], "?" + t[1][1:], "") if t[1][:1] == "!" else t
    return [*map(beside, out[:lo]), *map(within, out[lo:hi]), *map(beside, out[hi:])]


def label(seq: list[Token], name: str = "article") -> tuple[int, int] | None:
    """The content of a page whose markup names its one article (or other element)."""
    first = [i for i, t in enumerate(seq) if t[:2] == ("open", name)]
    last = [i for i, t in enumerate(seq) if t[:2] == ("close", name)]
    return (first[0], last[0] + 1) if len(first) == len(last) == 1 and first < last else None


def kinds(t: Token) -> tuple[str, int]:
    """The name a token is scored by, and how often it counts."""
    return ("w:" + t[1], len(t[2].split())) if t[0] == "text" else ("t:" + t[1], 1)


def bounds(name: str) -> tuple[float, float]:
    """Least and greatest score of a token.  Words score a tenth or more, but those beside the
    article; tags score minus a tenth or less, but what is left out within it."""
    if name[0] == "w":
        return (-math.inf, -0.1) if name[2:3] == "~" else (0.1, math.inf)
    return {"?": (0.0, 0.0), "!": (NEVER_SCORE, -0.1)}.get(name[2:3], (-math.inf, -0.1))


def weights(counts: dict[str, tuple[float, float]]) -> dict[str, float]:
    """counts: of each name inside and outside the content.  Log odds, within bounds()."""
    inside = sum(x for x, _ in counts.values()) + 1.0
    outside = sum(x for _, x in counts.values()) + 1.0
    out = {}
    for name, (i, o) in counts.items():
        low, high = bounds(name)
        out[name] = min(high, max(low, math.log((i + 0.5) / inside) - math.log((o + 0.5) / outside)))
    return out


def score(name: str, known: dict[str, float]) -> float:
    if name in known:
        return known[name]
    if name[0] == "w":
        return BESIDE_SCORE if name[2:3] == "~" else WORD_SCORE
    return 0.0 if name[2:3] == "?" else NEVER_SCORE if name[2:3] == "!" or name[2:] in NEVER else TAG_SCORE


def region(seq: list[Token], known: dict[str, float]) -> tuple[int, int]:
    """Start and end of the contiguous tokens of greatest sum, the first if several."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, t in enumerate(seq):
        name, n = kinds(t)
        total += n * score(name, known)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, at = total, (start, i + 1)
    return at


def content(seq: list[Token]) -> str:
    """Text of tokens: references decoded, white space collapsed, blocks joined by one space."""
    parts = [html.unescape(t[2]) if t[0] == "text" else "" if t[1] in INLINE else " " for t in seq]
    return " ".join("".join(parts).split())


def extract(page: str | None, known: dict[str, float]) -> str:
    seq = tokens(page or "")
    i, j = region(seq, known)
    return content(seq[i:j])


def learned(pages: DataFrame, sample: int = SAMPLE, column: str = "html") -> dict[str, float]:
    """Scores from the labelled pages among about `sample` pages."""

    def work(batches):
        for b in batches:
            seen: dict[str, list[int]] = {}
            for page in b.column("html").to_pylist():
                seq = tokens(page)
                if (at := label(seq) or label(seq, "main")) is not None:
                    for i, t in enumerate(seq):
                        name, n = kinds(t)
                        seen.setdefault(name, [0, 0])[0 if at[0] <= i < at[1] else 1] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], names=["name", "n_in", "n_out"])

    some = C.about(pages.where(F.col(column).isNotNull()), sample, "page_id", "url", column)
    got = C.bounded(some).select(F.col(column).alias("html")).mapInArrow(work, "name string, n_in long, n_out long").groupBy("name").agg(F.sum("n_in").alias("i"), F.sum("n_out").alias("o"))
    return weights({r["name"]: (r["i"], r["o"]) for r in got.orderBy("name").collect()})  # names of the sample's tags


def extracted(pages: DataFrame, known: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    known = learned(pages) if known is None else known
    base = C.bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")

    def work(batches):
        for b in batches:
            text = [extract(x, known) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return base.mapInArrow(work, "page_id long, url string, text string, n_chars long")


def op8_html_extract(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
