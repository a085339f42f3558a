"""Main text of web pages from streaming parser events.

The standard library's parser sends its events to ``Blocks``, which gathers
text by block together with the tags and link characters that came with it and
the containers that enclose it. Three steps choose the article.

- Tags, roles and names are evidence that a container is no part of it, and
  the text is the test: a container whose name only mentions such a part
  (``has-sidebar``) goes if it holds less than half of the page's text, one
  whose name or tag says that it is one (``sidebar``, ``form``) unless it holds
  nearly all, as when its end is missing or a form wraps the page.
- The text-to-tag ratio of what is left is smoothed with a Gaussian by line;
  lines above a threshold form the content clusters.
- From the root the walk goes down while one container holds nearly all of the
  clustered text and no prose stands beside it, but never into a list, table,
  quote or section. All lines there are the article; where the walk ends at the
  body, or above prose in several parts, the lines from the first cluster to
  the last and the prose that adjoins them.

Defined results: a null or empty html, or a page without content, gives an
empty text; malformed and truncated markup is read as far as it goes; null ids
and repeated rows are kept; an empty table gives no rows; further columns are
ignored. Of containers with equally much text the first is entered; a text of
any length is read whole, by one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that end the line before them.
LINES = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that may enclose an article or what is no part of it.
CONTAINERS = frozenset("article aside blockquote body center details dialog div dl fieldset figure footer form header html main nav ol section table td ul noscript template select textarea button iframe svg object canvas".split())
#: Elements whose text is never part of an article.
UNSEEN = frozenset("nav noscript template select textarea button iframe svg object canvas head menu".split())
#: Elements that say that they are no part of the article.
APART = frozenset("aside footer form dialog fieldset".split())
UNREAD = frozenset(("script", "style", "title"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words in class and id values that name such parts.
MARK = (
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|subscription|paywall|sidebars?|side|widgets?|menus?|nav\w*|breadcrumbs?"
    r"|footer|masthead|topbar|toolbar|comments?|commentlist|respond|replies|disqus|share|sharing|social|related|recommend\w*|pagination|pager|search\w*|login|signup|skip|hidden)(?:$|[\s_-])"
)
MENTIONED = re.compile(r"(?:^|[\s_-])" + MARK, re.I)
NAMED = re.compile(r"(?:^|\s)" + MARK, re.I)
#: The same as the whole of a name: a paragraph or heading so named goes, while ``related-work`` stays.
EXACT = re.compile(r"(?:^|\s)" + MARK.replace("[\\s_-]", "\\s"), re.I)
#: Names of readers' comments and of notices, wholly or as what a name ends with; ``has-comments`` says something else.
CONCLUSIVE = re.compile(
    r"(?:^|\s)(?!(?:has|with|no|show|hide|without|enable)[_-])(?:(?:[a-z0-9]+[_-])*(?:comments?|commentlist|discussions?|reply|replies|respond|disqus)(?:[_-](?:list|area|section|wrapper|container|thread|block|box|form))?"
    r"|(?:[a-z0-9]+[_-])*(?:cookies?|consent|gdpr|newsletter|paywall)[_-](?:notice|banner|bar|popup|modal|overlay|message|box|dialog|wall|law|signup|form))(?:$|\s)",
    re.I,
)
#: Shares of the page's text from which a container stays, whatever mentions or names it.
STAYS = {1: 0.5, 2: 0.9}
#: Doubt of a container that goes wherever there is prose outside of such.
OUT = 2.5
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SIGMA = 1.0
#: Lines are content from this share of the smoothed ratios' deviation on.
THRESHOLD = 0.5
#: A container of these is entered if it has this share of its parent's clustered text.
MOST = 0.85
ENTERED = frozenset("article body center div form html main td".split())


#: Characters of a line of prose at least, and what it ends with.
PROSE, ENDS = 20, ".!?:;…\"'”’»)。！？"


@dataclass
class Line:
    """A block's text, its characters in links, its tags, the numbers of the containers around it, and whether it is a main heading."""

    text: str
    link: int
    tags: int
    path: tuple[int, ...]
    heading: bool

    @property
    def own(self) -> int:
        return max(0, len(self.text) - self.link)

    @property
    def prose(self) -> bool:
        """Whether it reads like a sentence of its own."""
        return self.own >= PROSE and 2 * self.own > len(self.text) and self.text[-1] in ENDS


def doubt(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> float:
    """What speaks against an element: 0 nothing, 1 a mention, 2 a name, 2.5 the name of comments or a notice, 3 it is never part of an article."""
    found = 3 if tag in UNSEEN else 2 if tag in APART or tag == "header" and not in_article else 0
    if tag in ("html", "body", "article", "main"):
        return 0
    for name, value in attrs:
        if name in ("class", "id") and value:
            found = max(found, OUT if CONCLUSIVE.search(value) else 2 if NAMED.search(value) else 1 if MENTIONED.search(value) else 0)
        elif name == "role":
            found = max(found, 2 if (value or "").lower() in ROLES else 0)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value or ""):
            found = 3
    return found


class Blocks(HTMLParser):
    """Lines of a page, and its containers by number: tag and doubt."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.link = self.tags = 0
        self.in_link = False
        self.heading = False
        #: Open containers: tag, number, and whether their text is never seen.
        self.open: list[tuple[str, int, bool]] = []
        self.made: list[tuple[str, float]] = []
        self.skip_line = False
        self.unread = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.link, self.tags, tuple(x[1] for x in self.open), self.heading))
        self.parts, self.link, self.tags = [], 0, 0
        self.skip_line = self.heading = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in UNREAD:
            self.unread += 1
            return
        line = tag in LINES
        if line:
            self.end_line()
        self.tags += 1
        if tag == "a":
            self.in_link = True
        elif tag == "h1":
            self.heading = True
        elif tag == "br":
            self.parts.append(" ")
        if tag in CONTAINERS:
            against = doubt(tag, attrs, any(x[0] in ("article", "main") for x in self.open))
            self.open.append((tag, len(self.made), against == 3 or bool(self.open) and self.open[-1][2]))
            self.made.append((tag, against))
        elif line and attrs and (doubt(tag, attrs, True) == 3 or any(n in ("class", "id") and v and EXACT.search(v) for n, v in attrs)):
            self.skip_line = True

    def handle_endtag(self, tag: str) -> None:
        if tag in UNREAD:
            self.unread = max(0, self.unread - 1)
            return
        if tag in LINES:
            self.end_line()
        self.tags += 1
        if tag == "a":
            self.in_link = False
        elif tag in CONTAINERS:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    del self.open[k:]
                    break

    def handle_data(self, data: str) -> None:
        if self.unread or self.skip_line or self.open and self.open[-1][2]:
            return
        self.parts.append(data)
        if self.in_link:
            self.link += len(data)

    def close(self) -> None:
        if self.rawdata.startswith("<!--"):
            self.rawdata = ""
        super().close()
        self.end_line()


def believed(lines: list[Line], made: list[tuple[str, float]]) -> list[Line]:
    """Lines outside the containers whose doubt the text confirms."""
    sure = {k for k, (_, against) in enumerate(made) if against == OUT}
    doubted = {k for k, (_, against) in enumerate(made) if against >= 2}
    articles = {k for k, (tag, _) in enumerate(made) if tag in ("article", "main")}
    if sure and any(x.prose or x.own and articles.intersection(x.path) for x in lines if not doubted.intersection(x.path)):
        lines = [x for x in lines if not sure.intersection(x.path)]
    mass = [0] * len(made)
    for x in lines:
        for k in x.path:
            mass[k] += x.own
    whole = sum(x.own for x in lines)
    gone = {k for k, (_, against) in enumerate(made) if 1 <= against < 3 and mass[k] < STAYS[int(against)] * whole}
    return [x for x in lines if not gone.intersection(x.path)] if gone else lines


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian-weighted mean; the window shrinks at either end."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    return full(ratios) / full(np.ones(len(ratios)))


def choose(lines: list[Line], made: list[tuple[str, float]]) -> list[str]:
    """Texts of the article's lines."""
    lines = believed(lines, made)
    if not lines:
        return []
    own = np.array([x.own for x in lines], float)
    score = smooth(own / np.array([1 + x.tags for x in lines]))
    content = score >= min(THRESHOLD * score.std(), score.max())
    mass: dict[int, float] = {}
    parent: dict[int, int] = {}
    for text, is_content, x in zip(own, content, lines, strict=True):
        if is_content:
            for above, k in zip((-1, *x.path), x.path):
                mass[k] = mass.get(k, 0.0) + text
                parent[k] = above
    at, rest, several = -1, float(own[content].sum()), False
    while inside := [k for k in mass if parent[k] == at]:
        best = max(inside, key=lambda k: mass[k])
        if mass[best] < MOST * rest or made[best][0] not in ENTERED or at >= 0 and made[at][0] in ("article", "main") and made[best][0] != "article":
            break
        if made[best][0] not in ("html", "body", "article", "main") and any(x.prose and best not in x.path and (at < 0 or at in x.path) for x in lines):
            several = True
            break
        at, rest = best, mass[best]
    if at < 0 or several or made[at][0] in ("html", "body"):
        where = np.flatnonzero(content & np.array([at < 0 or at in x.path for x in lines]))
        first, last = int(where[0]), int(where[-1])
        prose = lambda x: (at < 0 or at in x.path) and (x.heading or 2 * x.own > len(x.text))
        while first and prose(lines[first - 1]):
            first -= 1
        while last + 1 < len(lines) and prose(lines[last + 1]):
            last += 1
        return [x.text for x in lines[first : last + 1]]
    chosen = [at in x.path for x in lines]
    if not any(x.heading for x, c in zip(lines, chosen, strict=True) if c):
        titles = [k for k, x in enumerate(lines) if x.heading and not chosen[k]]
        if len(titles) == 1 and titles[0] < chosen.index(True):
            chosen[titles[0]] = True
    return [x.text for x, c in zip(lines, chosen, strict=True) if c]


def main_text(html: str | None) -> str:
    """The article of a page, its lines joined by line feeds."""
    if not html:
        return ""
    parser = Blocks()
    parser.feed(html)
    parser.close()
    return "\n".join(choose(parser.lines, parser.made))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
