"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events; each block of a page becomes a line with its text and the tags met since
the line before. The ratios of text to tags are smoothed by a Gaussian kernel and lines above a threshold (the deviation
of the smoothed ratios) form the content cluster. From the whole page inwards, the part of a container that holds most of the
cluster becomes the region of content where the parts beside it have low ratios, or are single lines beside a headed part.
Headings and the names of elements weigh parts, they don't decide; what the page itself marks as furniture (menus, asides,
forms, adverts and the like) isn't text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from fractions import Fraction
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML and the words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("article aside blockquote body dd details div dl dt fieldset figure footer form header html li main nav ol section table tbody td tfoot th thead tr ul".split())
SILENT = frozenset("button canvas datalist embed footer form head iframe input label menu nav aside noscript object option script select style svg template textarea title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted promotion related "
    "respond reply replies share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
# Of these, words that name furniture alone or beside words of place and layout; in other company they may name content.
WEAK = frozenset("banner comment header login menu notice notices pagination promotion related reply replies respond share sharing social subscription".split())
LAYOUT = frozenset("area articles bar block bottom box button buttons container content div form global group icons inner items left links list main nav navigation outer page posts right section site stories top wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
# Which start tags end open elements whose end tags may be left out.
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
ENDS_P = HEADINGS | frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul xmp".split()
)
SCOPE = frozenset("applet caption html marquee object table td template th".split())
ROWS, CELLS = frozenset("tbody tfoot thead".split()), frozenset("td th".split())
#: What a start tag ends, and what it doesn't reach beyond.
_ITEM = (CONTAINERS | SILENT | SCOPE) - {"div"}
_TERM, _TABLE = frozenset(("dd", "dt")), frozenset(("html", "table", "template"))
ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(("li",)), _ITEM - {"li"}),
    **dict.fromkeys(_TERM, (_TERM, _ITEM - _TERM)),
    **dict.fromkeys(CELLS, (CELLS | {"caption"}, _TABLE)),
    "tr": (CELLS | {"caption", "tr"}, _TABLE),
    **dict.fromkeys(ROWS, (CELLS | ROWS | {"caption", "tr"}, _TABLE)),
    "a": (frozenset(("a",)), SCOPE),
    "button": (frozenset(("button",)), SCOPE),
    "option": (frozenset(("option",)), CONTAINERS | SILENT - {"option"}),
    **dict.fromkeys(("rp", "rt"), (frozenset(("rp", "rt")), frozenset(("ruby",)) | CONTAINERS | SILENT)),
    "select": (frozenset(("select",)), SCOPE),
}
#: Standard deviation of the Gaussian kernel, in lines, and its reach.
SIGMA, REACH = 1.0, 2


class Line:
    """A block's text and the tags since the line before. Of the open elements (``depth`` of them) it shares the first ``shared`` with
    the line before; ``fresh`` says of the others which are articles. ``head``: it is a first or second heading."""

    __slots__ = ("text", "tags", "depth", "shared", "fresh", "head")

    def __init__(self, text: str, tags: int, depth: int, shared: int, fresh: list[bool], head: bool):
        self.text, self.tags, self.depth, self.shared, self.fresh, self.head = text, tags, depth, shared, fresh, head


def names_furniture(names: str) -> bool:
    """Whether a class or id names page furniture."""
    for name in names.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        hits = [w for w in words if w in FURNITURE]
        if hits and (not WEAK.issuperset(hits) or all(w in FURNITURE or w in LAYOUT for w in words)):
            return True
    return False


class Events(HTMLParser):
    """Parser events to lines. Open elements are kept in a stack, where an end tag closes down to its start tag, and a start
    tag ends what HTML lets it end. The places of each name in the stack are kept too, so that nesting costs no search."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.buffer: list[str] = []
        self.tags = 0
        self.head = False
        self.stack: list[tuple[str, bool, bool, bool]] = []  # name, silent, within an article, an article
        self.open: dict[str, list[int]] = {}
        self.told = 0  # so many of the stack's elements hold the last line

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            self.buffer = []
            if text:
                self.lines.append(Line(text, self.tags, len(self.stack), self.told, [x[3] for x in self.stack[self.told :]], self.head))
                self.tags, self.told = 0, len(self.stack)

    def _cut(self, depth: int) -> None:
        """End the elements from ``depth`` on."""
        while len(self.stack) > depth:
            self.open[self.stack.pop()[0]].pop()
        self.told = min(self.told, depth)

    def _close(self, names, beyond=frozenset()) -> None:
        """End the outermost open element of ``names`` that is reached before one of ``beyond``, with all in it."""
        held = [places for n in names if (places := self.open.get(n))]
        if not held:
            return
        limit = max((places[-1] for n in beyond if (places := self.open.get(n))), default=-1)
        found = min((places[bisect_right(places, limit)] for places in held if places[-1] > limit), default=None)
        if found is not None:
            self.flush()
            self._cut(found)

    def _end_implied(self, tag) -> None:
        """What the start of ``tag`` ends as HTML does, where end tags were left out."""
        if tag == "body" or tag not in HEAD and self.stack[-1][0] == "head":
            self._close(("head",))
        if tag in ENDS:
            self._close(*ENDS[tag])
        if tag in ENDS_P:
            self._close(("p",), SCOPE | {"button"})
        if tag in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
            self._close(HEADINGS, CONTAINERS | SILENT)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if self.stack:
            self._end_implied(tag)
        if tag in INLINE:
            if tag == "br":
                self.buffer.append(" ")
            if not attrs or tag in VOID or not self._silent(tag, attrs, False):
                return
        else:
            self.flush()
            self.head = tag in ("h1", "h2")
        if tag in VOID or not (tag in CONTAINERS or tag in SILENT or attrs and self._silent(tag, attrs, False)):
            return
        inside = bool(self.stack) and self.stack[-1][2]
        silent = bool(self.stack) and self.stack[-1][1] or self._silent(tag, attrs, inside)
        article = tag in ("article", "main")
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, silent, inside or article, article and not silent))

    def _silent(self, tag, attrs, inside) -> bool:
        if tag in SILENT or tag == "header" and not inside:
            return True
        for name, value in attrs:
            value = (value or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                return True
            if name == "role" and value in ROLES:
                return True
            if name == "class" or name == "id" and tag in CONTAINERS:
                if tag not in ("html", "body", "article", "main") and names_furniture(value) and not (inside and (tag == "header" or value == "header")):
                    return True
        return False

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:  # a slash there means nothing in HTML
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in INLINE:
            self.flush()
            self.head = False
        if places := self.open.get(tag):
            if tag in INLINE:
                self.flush()
            self._cut(places[-1])

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self._close(("head",))
        if self.stack and self.stack[-1][1]:
            return
        self.buffer.append(data)

    def parse_html_declaration(self, i):
        """A ``<![`` is a comment up to the next ``>``, as in HTML; the library's parser gives up on unknown ones. Foreign
        elements may hold character data up to ``]]>``."""
        if not self.rawdata.startswith("<![", i):
            return super().parse_html_declaration(i)
        foreign = self.rawdata.startswith("<![CDATA[", i) and bool(self.open.get("svg"))
        mark = "]]>" if foreign else ">"
        end = self.rawdata.find(mark, i + 3)
        return len(self.rawdata) if end < 0 else end + len(mark)

    def finish(self) -> list[Line]:
        self.close()
        self.flush()
        return self.lines


def ratio(line: Line) -> float:
    """Characters of text to each tag."""
    return len(line.text) / max(1, line.tags)


def smoothed(ratios: list[float]) -> list[float]:
    """Gaussian smoothing, with the kernel cut and normalised at the ends."""
    kernel = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-REACH, REACH + 1)]
    out = []
    for i in range(len(ratios)):
        total = weight = 0.0
        for k, w in zip(range(i - REACH, i + REACH + 1), kernel, strict=True):
            if 0 <= k < len(ratios):
                total, weight = total + w * ratios[k], weight + w
        out.append(total / weight)
    return out


def extract(html: str) -> str:
    """The main text of one page: its blocks in page order, joined by line feeds; empty if there is none."""
    events = Events()
    events.feed(html)
    lines = events.finish()
    if not lines:
        return ""
    own = [ratio(x) for x in lines]
    ratios = smoothed(own)
    mean = sum(ratios) / len(ratios)
    threshold = min(math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios)), max(ratios))
    lo, hi = region(lines, own, [r >= threshold for r in ratios])
    return "\n".join(x.text for x in lines[lo:hi])


#: How much more a part counts that has a first heading or is an article or main; the share of a part's ratio below which
#: what stands beside it is furniture.
HEADED, LOW = 4, 0.5


def region(lines: list[Line], own: list[float], cluster: list[bool]) -> tuple[int, int]:
    """The range of lines that is content."""
    mass_to = [0, *accumulate(len(x.text) if on else 0 for x, on in zip(lines, cluster, strict=True))]
    heads_to = [0, *accumulate(x.head for x in lines)]
    own_to = [Fraction(0), *accumulate(map(Fraction, own))]
    begins: dict[int, list[int]] = {}  # lines by how many elements they share with the one before
    for i, x in enumerate(lines):
        begins.setdefault(x.shared, []).append(i)
    mean = lambda a, b: (own_to[b] - own_to[a]) / (b - a)
    lo, hi, depth = 0, len(lines), 0
    while True:
        # within an element of this depth: each element in it is a part, and each line of its own
        at = begins.get(depth, [])
        starts = [lo, *at[bisect_right(at, lo) : bisect_left(at, hi)]]
        parts = list(zip(starts, [*starts[1:], hi], strict=True))
        if len(parts) == 1 and lines[lo].depth > depth:
            depth += 1
            continue
        article = [lines[a].depth > depth and lines[a].fresh[depth - lines[a].shared] for a in starts]
        headed = [heads_to[b] > heads_to[a] for a, b in parts]
        mass = [(HEADED if headed[i] or article[i] else 1) * (mass_to[b] - mass_to[a]) for i, (a, b) in enumerate(parts)]
        k = max(range(len(parts)), key=lambda i: (mass[i], -i))
        a, b = parts[k]
        if 2 * mass[k] <= sum(mass) or lines[a].depth <= depth:
            return lo, hi
        level = LOW * mean(a, b)
        if b - a == 1 and not article[k] or not all(
            i == k or mean(c, d) < level or (headed[k] or article[k]) and (d - c == 1 and not lines[c].head or article[k]) for i, (c, d) in enumerate(parts)
        ):
            return lo, hi
        lo, hi, depth = a, b, depth + 1


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page its id, url, ``text`` and ``n_chars`` (code points of the text).

    Null or empty html gives an empty text; null ids or urls pass; repeated rows give repeated results; further columns
    are dropped, whatever their names; an empty table gives an empty table. Pages are handled whole, one at a time,
    where they are read: no shuffle.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches):
        for batch in batches:
            texts = [extract(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    out = pages.select(id_col, url_col, html_col).mapInArrow(run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
    return out.withColumnsRenamed({"page_id": id_col, "url": url_col})
