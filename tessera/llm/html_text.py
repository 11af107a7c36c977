"""Main text of web pages by the maximum-scoring subsequence of tokens.

A page is a sequence of words and tags.  Words score positive and tags
negative, and one linear scan finds the contiguous run with the highest sum:
the content region.  The weights are log odds from labelled pages, pages whose
text is known: of a word, by the share of the words in its kind of element that
belonged to the text, so words of unlikely elements score negative too; of a
tag, by the share of its uses that stood within the text.  Elements whose
purpose is stated (navigation, forms, adverts, ...) start from a low share, all
others from a high one, so kinds of element that no labelled page has are
judged by these priors; enough labelled words overturn either.  A form, or an
element that states a purpose by its class or id, is none if it holds nearly
all words of the page and paragraphs or headings: it wraps the text.  Blocks of the region are the result,
without those of unlikely elements inside it.

Defined results: null or empty html, or a page without words, gives an empty
text.  A tag that is never closed is text up to the end of the page, as is a
lone ``<``.  A quoted value with ``>`` in it belongs to its tag, however long;
where a quote is never closed the tag ends at its first ``>``.  Very long or
deep pages take time in proportion to their length.  Of runs with the same
sum the first counts.  Repeated pages give equal rows; an empty table gives
none.  Other columns pass through; those of the result replace any of the same
name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import kernels as K
from tessera.llm.suffix_dedup import result_schema, with_columns
from tessera.llm.url_reputation import DOCUMENT_NUMBER

#: Labelled pages used to fit the weights, at most.
LABELLED = 400
#: Weight of the prior, in words or tags.
PRIOR = 20.0
#: What any tag costs at least, in words.
TAG_COST = 0.05
#: Log odds are in units of those of this share, and never above one unit.
CERTAIN = 0.98
#: What words of unlikely elements, and tags within elements of stated purpose, weigh next to others: such elements
#: stand inside texts as well, and must not cut them.
UNLIKELY = 0.02
#: Shares of the priors.
STATED, UNSTATED = 0.02, 1.0
#: An element with this share of a page's words holds the page, whatever its name states.
WHOLE = 0.9
#: Characters of html in a batch.
BATCH = 1 << 22

_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_APART = frozenset("head title nav header footer aside form button select option textarea iframe svg canvas object dialog menu fieldset label noscript template noframes audio video map".split())
#: Those of them that show no text of the page, whatever labelled pages say.
_UNSEEN = frozenset("head title iframe svg canvas object noscript template noframes audio video map".split())
_APART_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar side menu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead topbar footer comment comments respond disqus replies reply share sharing social related recommended newsletter subscribe subscription signup login search widget toolbar "
    "pagination pager skip form copyright".split()
)
_APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words that may stand beside those in a class or id; with any other word it states no purpose.
_BESIDE = frozenset("site page global top bottom left right bar list box block item items link links button buttons section inner area".split())
_DISCUSSION = frozenset("comment comments respond disqus replies reply".split())
_RAW = frozenset("script style".split())
#: Tags that show an element to hold a text and not one line.
_PROSE = frozenset("<p <h1 <h2 <h3 <article".split())
_RESTARTS = frozenset("article main body".split())
#: What an opening tag ends, if it is the innermost block.
_ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}

_TAG = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_CLOSES = re.compile(r"[>\"']")
_ENDS_RAW = {name: re.compile(rf"</{name}\s*[^>]*>", re.I) for name in sorted(_RAW)}
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LETTERS = re.compile(r"[a-z]+")


class Piece(NamedTuple):
    """A tag (kind '<', or '</'), or a run of text of one kind of element in one block.

    apart: the stated purposes of the elements around it, outermost first.
    """

    kind: str
    apart: str
    words: int
    block: int
    text: str

    @property
    def key(self) -> str:
        """What the piece is counted as: its kind, by the purposes around it."""
        return f"{self.apart}>{self.kind}" if self.apart else self.kind


def _purpose(value: str) -> str:
    """The first name of a class or id that states a purpose as a whole."""
    for token in value.split():
        parts = _LETTERS.findall(token)
        named = [x for x in parts if x in _APART_NAMES]
        if named and all(x in _APART_NAMES or x in _BESIDE for x in parts):
            return next((x for x in named if x in _DISCUSSION), named[0])
    return ""


def _kind(name: str, attributes: str) -> tuple[str, str]:
    """The kind of an element, by name and class, and the purpose that sets it apart, if any."""
    purpose, kind = name if name in _APART else "", name
    if attributes and "=" in attributes:
        for m in _NAMES.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "role":
                purpose = purpose or (value if value in _APART_ROLES else "")
                continue
            if name not in ("html", "body", "main"):
                stated = _purpose(value)
                if name != "article" or stated in _DISCUSSION:
                    purpose = purpose or stated
            if m[1].lower() == "class" and value:
                kind = f"{name}.{value.split()[0]}" if value.split() else name
    return kind, purpose


def tag_end(html: str, at: int, last: int, dead: set[int]) -> int:
    """Where the tag whose name ends at ``at`` has its ``>``; last: the last ``>`` of the page, after ``at``.

    dead: opening quotes from which no ``>`` outside of quotes follows.  What
    one tag has found out is not sought again, so a page is read twice at most.
    """
    i, passed = at, []
    while (m := _CLOSES.search(html, i, last + 1)) and m.start() not in dead:
        if m[0] == ">":
            return m.start()
        passed.append(m.start())
        closing = html.find(m[0], m.end())
        if closing < 0:
            break
        i = closing + 1
    dead.update(passed)
    return html.find(">", at)


def tokens(html: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, '/' or '', lower name or '', attributes) of each tag, comment or raw element; at last the text that is left."""
    at, said, last = 0, 0, html.rfind(">")
    dead: set[int] = set()
    while m := _TAG.search(html, at):
        if m[1]:
            end = html.find("-->", m.end())
            end = len(html) if end < 0 else end + 3
            yield html[said : m.start()], "", "", ""
        elif m.end() > last:  # never closed: text
            break
        elif not m[3]:
            end = html.find(">", m.end()) + 1
            yield html[said : m.start()], "", "", ""
        else:
            end = tag_end(html, m.end(), last, dead) + 1
            name = m[3].lower()
            yield html[said : m.start()], m[2], name, html[m.end() : end - 1]
            if name in _RAW and not m[2]:
                closing = _ENDS_RAW[name].search(html, end)
                end = closing.end() if closing else len(html)
        at = said = end
    yield html[said:], "", "", ""


def pieces(html: str) -> list[Piece]:
    """Tags and texts of a page in their order."""
    out: list[Piece] = []
    stack: list[tuple[str, str, str, int]] = []  # open blocks: name, kind, purposes that set them apart, the innermost element that states one
    stated: list[tuple[str, int, bool]] = [("", -1, False)]  # elements that state a purpose: which, the one around it, may it be lifted
    within: list[int] = []  # of each piece: the innermost such element
    open_at: dict[str, list[int]] = {}  # places in the stack, by name
    block = 0

    def cut(size: int) -> None:
        while len(stack) > size:
            open_at[stack.pop()[0]].pop()

    def add(piece: Piece, inner: int) -> None:
        out.append(piece)
        within.append(inner)

    def say(text: str) -> None:
        if text and not text.isspace():
            text = unescape(text)
            kind, apart, inner = stack[-1][1:] if stack else ("", "", 0)
            add(Piece(kind, apart, len(text.split()), block, text), inner)
        elif text and out and out[-1].words >= 0 and out[-1].block == block:
            add(out[-1]._replace(words=0, text=" "), within[-1])

    for text, closing, name, attributes in tokens(html):
        say(text)
        if not name or name in _RAW:
            continue
        if name == "br":
            if out and out[-1].words >= 0:
                add(out[-1]._replace(words=0, text=" "), within[-1])
            continue
        if name in _INLINE:
            continue
        block += 1
        if closing:
            kind, apart, inner = (name, *stack[-1][2:]) if stack else (name, "", 0)
            if open_at.get(name):
                top = open_at[name][-1]
                kind, apart, inner = stack[top][1:]
                cut(top)
            add(Piece(f"</{kind}", apart, -1, block, ""), inner)
            continue
        kind, apart = _kind(name, attributes)
        if name == "header" and apart == name and open_at.get("article"):
            apart = ""  # it opens the article, not the page
        if name in _RESTARTS:
            if name != "article" or not stack or _DISCUSSION.isdisjoint(stack[-1][2].split()) and "aside" not in stack[-1][2].split():
                cut(0)
        elif stack and (stack[-1][0] == "p" or stack[-1][0] in _ENDS.get(name, ())):
            cut(len(stack) - 1)
        around, inner = stack[-1][2:] if stack else ("", 0)
        if apart:
            stated.append((apart, inner, name == "form" or name not in _APART))
            inner = len(stated) - 1
        apart = around if apart in around.split() else f"{around} {apart}".strip()
        add(Piece(f"<{kind}", apart, -1, block, ""), inner)
        if name not in _VOID and not attributes.endswith("/"):
            open_at.setdefault(name, []).append(len(stack))
            stack.append((name, kind, apart, inner))
    return _unwrapped(out, within, stated)


def _unwrapped(found: list[Piece], within: list[int], stated: list[tuple[str, int, bool]]) -> list[Piece]:
    """The pieces without the purposes of elements that hold nearly all words of the page."""
    words, prose, total = [0] * len(stated), [False] * len(stated), 0
    for piece, inner in zip(found, within, strict=True):
        if piece.kind.split(".")[0] in _PROSE:
            prose[inner] = True
        if piece.words > 0 and _UNSEEN.isdisjoint(piece.apart.split()):
            words[inner] += piece.words
            total += piece.words
    for i in range(len(stated) - 1, 0, -1):
        words[stated[i][1]] += words[i]
        prose[stated[i][1]] |= prose[i]
    lifted = [i > 0 and may and prose[i] and words[i] >= WHOLE * total > 0 for i, (_, _, may) in enumerate(stated)]
    if not any(lifted):
        return found
    names = [""]
    for (purpose, around, _), free in zip(stated[1:], lifted[1:], strict=True):
        there = names[around]
        names.append(there if free or purpose in there.split() else f"{there} {purpose}".strip())
    return [x._replace(apart=names[i]) for x, i in zip(found, within, strict=True)]


def odds(share: float) -> float:
    """Log odds in units of those of ``CERTAIN``, between -1 and 1."""
    share = min(max(share, 1.0 - CERTAIN), CERTAIN)
    return math.log(share / (1.0 - share)) / math.log(CERTAIN / (1.0 - CERTAIN))


class Weights(NamedTuple):
    """Share of an element's words that are text; share of a tag's uses within text."""

    words: dict[str, float]
    tags: dict[str, float]

    def of(self, piece: Piece) -> float:
        if piece.words < 0:
            inside = self.tags.get(piece.key, STATED if piece.apart else UNSTATED)
            cost = TAG_COST - min(0.0, odds(inside))
            return -(UNLIKELY * cost if piece.apart else cost)
        own = odds(self.share(piece))
        return piece.words * (own if own > 0 else UNLIKELY * own)

    def share(self, piece: Piece) -> float:
        return self.words.get(piece.key, STATED if piece.apart else UNSTATED)

    def likely(self, piece: Piece) -> bool:
        return self.share(piece) >= 0.5


def region(found: list[Piece], weights: Weights) -> tuple[int, int]:
    """Where the run of pieces with the highest sum of weights starts and stops."""
    best, best_range, total, start = 0.0, (0, 0), 0.0, 0
    for i, piece in enumerate(found):
        if total <= 0.0:
            total, start = 0.0, i
        total += weights.of(piece)
        if total > best:
            best, best_range = total, (start, i + 1)
    return best_range


def blocks(found: Iterable[Piece]) -> list[str]:
    out: list[list[str]] = []
    last = None
    for piece in found:
        if piece.words >= 0:
            if piece.block != last:
                out.append([])
                last = piece.block
            out[-1].append(piece.text)
    return [x for x in (" ".join("".join(b).split()) for b in out) if x]


def main_text(html: str | None, weights: Weights) -> str:
    if not html:
        return ""
    found = pieces(html)
    start, stop = region(found, weights)
    return "\n".join(blocks(x for x in found[start:stop] if x.words < 0 or weights.likely(x)))


def fit(labelled: Iterable[tuple[str, str]]) -> Weights:
    """Weights from pages and their known texts."""
    words, good, tags, inside = Counter(), Counter(), Counter(), Counter()
    apart: set[str] = set()
    known: list[tuple[list[tuple[str, bool, bool]], list[int]]] = []
    for html, text in labelled:
        lines = {" ".join(x.split()) for x in text.split("\n")}
        whole = " ".join(text.split())
        found = pieces(html or "")
        hits = []
        for i, x in enumerate(found):
            if x.apart:
                apart.add(x.key)
            if x.words > 0 and _UNSEEN.isdisjoint(x.apart.split()):
                own = " ".join(x.text.split())
                if own in lines or len(own) >= 20 and whole.startswith(own):
                    hits.append(i)
        # a few lines in elements set apart do not tell that the text is this page's
        if all(found[i].apart for i in hits) and 2 * sum(found[i].words for i in hits) < max(1, len(whole.split())):
            continue
        for x in found:
            if x.words > 0:
                words[x.key] += x.words
        for i in hits:
            good[found[i].key] += found[i].words
        known.append(([(x.key, bool(x.apart), x.words < 0) for x in found], hits))
    prior = lambda key: PRIOR * (STATED if key in apart else UNSTATED)
    share = {k: (good[k] + prior(k)) / (n + PRIOR) for k, n in words.items()}
    for found, hits in known:
        hits = [i for i in hits if not found[i][1] or share[found[i][0]] >= 0.5]
        for i, (key, _, tag) in enumerate(found):
            if tag and hits:
                tags[key] += 1
                inside[key] += hits[0] <= i <= hits[-1]
    return Weights(share, {k: (inside[k] + prior(k)) / (n + PRIOR) for k, n in tags.items()})


def labelled_pages(pages: DataFrame, documents: DataFrame, limit: int = LABELLED) -> list[tuple[str, str]]:
    """Pages whose address ends in the number of a known document: at most ``limit``, spread by hash."""
    number = F.regexp_extract(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), DOCUMENT_NUMBER, 1)
    ids = (
        pages.select("page_id", F.when(number != "", number.cast("long")).alias("doc_id"))
        .where("page_id IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("page_id")
        .agg(F.min("doc_id").alias("doc_id"))
        .orderBy(F.xxhash64("page_id"), "page_id")
        .limit(limit)
        .collect()
    )
    if not ids:
        return []
    # of rows that repeat an id the least html or text counts; they are combined before they travel
    html = dict(pages.where(F.col("page_id").isin([r.page_id for r in ids])).groupBy("page_id").agg(F.min("html")).collect())
    text = dict(documents.where(F.col("doc_id").isin([r.doc_id for r in ids])).groupBy("doc_id").agg(F.min("text")).collect())
    return [(html[r.page_id] or "", text[r.doc_id]) for r in ids if text.get(r.doc_id) and r.page_id in html]


RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract_text(pages: DataFrame, weights: Weights) -> DataFrame:
    """pages without html, with text and n_chars (code points)."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = np.append(0, np.cumsum(pc.fill_null(pc.utf8_length(whole.column("html")), 0).to_numpy(zero_copy_only=False)))
            for i, j in K.slices(size, BATCH) or [(0, 0)]:
                batch = whole.slice(i, j - i)
                texts = [main_text(x, weights) for x in batch.column("html").to_pylist()]
                columns = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())}
                yield from with_columns(pa.Table.from_batches([batch]).drop_columns(["html"]), columns).to_batches()

    return pages.mapInArrow(extract, T.StructType([f for f in result_schema(pages, RESULT) if f.name != "html"]))
