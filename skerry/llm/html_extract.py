"""Main-text extraction from HTML by two-pass block rules.

The page is cut into blocks at block-level tags. The structure decides first: what stands in menus, headers,
footers, sidebars, forms, scripts, styles, hidden parts, or in an element whose class, id or role names a
notice, an advert or comments, is left out. If the page marks its article (``article`` or ``main``) and text stands there,
only that is considered.

First pass: a block of mostly link characters is bad; a block of ``SHORT`` characters or more is good if enough of its
words are stop words of some language; all others are ambiguous: short ones, and long ones with few stop words, such as tables.
If no block of a page is good by its stop words, as in a language that isn't listed, its long blocks are. Second pass: an ambiguous
block takes the label that its nearest decided neighbours on both sides agree on, or that of the only one. If they differ, it is
good inside a marked article, and elsewhere the nearer decides, good on a tie. With none at all it is good only inside a marked
article. The rules are the same inside a marked article and on pages that mark none.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined by a line feed in page order.

Cases: null or empty html gives an empty text; a very long page is one string, and every step over it is linear. Unclosed and wrongly nested tags are closed by the nearest
enclosing element; a page cut off anywhere gives the text up to there. A ``<`` that opens no tag is text.
Repeated rows give repeated results, ties go to good. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import in_batches, read, whole

#: Characters below which a block is ambiguous; shares of stop words and of link characters.
SHORT, STOP, LINKS = 70, 0.15, 0.5
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """the of and to in a is that it for was on are as with be by at this have from or had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than been its who now
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man
    le la les de des et un une à en du que qui dans est pour pas par sur plus avec ce il au sont ne se son sa ses ou mais comme on nous vous elle leur été être cette aux
    el los las y que en por con para una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante""".split()
)
#: Elements whose content is never text of the page, read up to their end tag.
RAW = frozenset("script style noscript template textarea title iframe xmp".split())
OUT = frozenset("head nav footer aside form svg math select option button object canvas audio video dialog menu map datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: End tags of other elements don't close what stands around these.
SCOPE = frozenset("article main section nav aside header footer form table td th ul ol dl div body html blockquote".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id or role that name what isn't the article.
HINTS = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay
    sidebar aside widget menu nav navbar navigation breadcrumb breadcrumbs pagination footer header masthead comment comments disqus respond share sharing social related recommended
    newsletter subscribe subscription login signup search toolbar contentinfo complementary dialog""".split()
)
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|</[^>]*+>""", re.S
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[^\W\d_]+")
HEADS = {"header"}


def _hinted(attributes: str) -> bool:
    if not attributes.strip():
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id", "role") and not HINTS.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


class _Page:
    """Cuts a page into blocks: [text, link characters, inside a marked article]."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, bool]] = []
        self.parts: list[str] = []
        self.links = 0
        #: Open elements: name, left out, part of the article, link.
        self.open: list[tuple[str, bool, bool, bool]] = []
        at = 0
        while m := TAG.search(html, at):
            self.text(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    self.text(m[0][9:].removesuffix("]]>"))
                continue
            name = m[2].lower()
            if m[1]:
                self.close(name)
            elif name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = end.end() if end else len(html)
            else:
                self.start(name, m[3])
        self.text(html[at:])
        self.flush()

    def top(self) -> tuple[str, bool, bool, bool]:
        return self.open[-1] if self.open else ("", False, False, False)

    def text(self, raw: str) -> None:
        _, out, _, link = self.top()
        if raw and not out:
            text = unescape(raw)
            self.parts.append(text)
            if link:
                self.links += len("".join(text.split()))

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((text, self.links, self.top()[2]))
        self.parts, self.links = [], 0

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self.flush()
            if self.open and self.open[-1][0] != "p" and any(x[0] == "p" for x in self.open):
                self.close("p")
            elif self.open and self.open[-1][0] == "p":
                self.open.pop()
        elif name == "br":
            self.parts.append(" ")
        if name in VOID:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in ENDS.get(name, ()):
                del self.open[i:]
            elif self.open[i][0] not in SCOPE:
                continue
            break
        _, out, article, link = self.top()
        plain = name in ("html", "body", "article", "main")
        out = out or name in OUT or name in HEADS and not article or (_hinted(attributes) and (not plain or name == "article"))
        self.open.append((name, out, article or name in ("article", "main"), link or name == "a"))

    def close(self, name: str) -> None:
        if name in BLOCK:
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                del self.open[i:]
                return
            if name not in SCOPE and self.open[i][0] in SCOPE:
                return


def _first_pass(text: str, links: int) -> bool | None:
    """True: good, False: bad, None: ambiguous."""
    if links > LINKS * len(text.replace(" ", "")):
        return False
    if len(text) < SHORT:
        return None
    words = WORD.findall(text.lower())
    return True if sum(w in STOP_WORDS for w in words) >= STOP * max(1, len(words)) else None


def classify(blocks: list[tuple[str, int, bool]]) -> list[bool]:
    """Whether each block is main text."""
    first = [_first_pass(text, links) for text, links, _ in blocks]
    if True not in first:
        first = [True if label is None and len(text) >= SHORT else label for label, (text, _, _) in zip(first, blocks, strict=True)]
    before, after, last = [], [], None
    for i, label in enumerate(first):
        last = (i, label) if label is not None else last
        before.append(last)
    last = None
    for i in range(len(first) - 1, -1, -1):
        last = (i, first[i]) if first[i] is not None else last
        after.append(last)
    after.reverse()
    out = []
    for i, label in enumerate(first):
        if label is None:
            near = [(abs(j - i), not good) for j, good in filter(None, (before[i], after[i]))]
            differ = len({bad for _, bad in near}) == 2
            label = blocks[i][2] if not near or differ and blocks[i][2] else not min(near)[1]
        out.append(label)
    return out


def extract(html: str) -> str:
    blocks = _Page(html).blocks
    if any(article for _, _, article in blocks):
        blocks = [b for b in blocks if b[2]]
    return "\n".join(b[0] for b, good in zip(blocks, classify(blocks), strict=True) if good)


def main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns with text and n_chars, a row for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h.as_py()) for h in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*b.schema.names[:-1], "text", "n_chars"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string, n_chars long"
    return in_batches(pages.select(*keep, whole(F.col(html_col)).alias("_html")), run, schema)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))
