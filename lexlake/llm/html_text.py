"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Each block has a length, a link density, a stop-word density and the
containers it stands in. The first pass decides: blocks in boilerplate containers or with dense links are boilerplate;
long blocks with enough stop words are content; blocks between are near content; short ones stay open. On a page whose
text has next to no stop words of the languages known here, the marks that end or divide sentences stand in for them, and
characters of scripts without spaces count for more length. The second pass gives open and near blocks the label of their nearest decided
neighbours, content where both sides agree. Where most of the text that looks like content stands inside an <article> or <main>, the
blocks outside are boilerplate and open blocks inside are content; an <article> that holds less than that counts for nothing.

A class or an id marks a container as boilerplate only as a whole: "social-share" and "comments-list" do, "social-security" does not.

A null page is the empty page and gives an empty text. Markup that never ends is read to the end of the page. Repeated
rows give repeated results; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common function words of the languages that the pages are in.
STOP_WORDS = frozenset(
    "the of and to in is that it was for on are as with be by at from this have or an a he his not but they which you were her all she there been their has will when who more if no out so "
    "der die das und ist nicht ein eine einer eines einem zu den dem des mit von auf für sich im er sie es auch als an nach wie aus bei oder war wird sind dass "
    "le la les de des du et un une est que qui dans pour pas sur au aux par il elle en ce cette se sont plus ne ou avec son sa ses "
    "el los las y del que en es por con para una su al lo como más pero sus este esta entre ser son no si".split()
)
#: Fixed values of HTML: elements that start and end a block, and elements whose content is never text of the page.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
HIDDEN_TAGS = frozenset("script style noscript template svg math iframe object canvas head title textarea select button datalist video audio map".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies copyright discussion disqus footer masthead menu modal nav navbar navigation newsletter notice "
    "notices pagination pager popular popup promo promoted related replies reply respond responses share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar trending widget".split()
)
#: Words that say nothing about a container beside one of the above.
NEUTRAL_WORDS = frozenset(
    "area article bar bl blog body bottom box btn button buttons center col column container content entry footer form global group header holder icon icons inline inner item items left link links list main "
    "media mobile module news outer page panel placement post primary reader readers region right row secondary section site slot story text title to top unit user users wrap wrapper".split()
)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
PRUNED_BY_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
RAW_ENDS = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in RAW_TAGS}
WORD = re.compile(r"\w+")
MARKS = re.compile("[.!?;:,\u3001\u3002\uff01\uff0c\uff1f\u060c\u061f\u0964]")
UNSPACED = re.compile("[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")  # Thai, Lao, kana, Han, Hangul
SPACE = re.compile(r"\s+")


@dataclass
class Rules:
    """Thresholds: characters, and shares of words or characters."""

    short: int = 70
    long: int = 200
    stop_low: float = 0.12
    stop_high: float = 0.22
    links: float = 0.4
    known_language: float = 0.04
    unspaced: float = 1.5
    inside_share: float = 0.5


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    boilerplate: bool
    inside: bool
    item: bool = False


def marks_boilerplate(names: str) -> bool:
    """Whether one of the names of a class or id attribute stands for boilerplate as a whole."""
    for name in re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", names).lower().split():
        parts = {x for x in re.split(r"[^a-z]+", name) if x}
        if parts & BOILERPLATE_WORDS and parts <= BOILERPLATE_WORDS | NEUTRAL_WORDS:
            return True
    return False


def is_boilerplate(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """(in a boilerplate container, hidden) as the tag and its attributes say."""
    if tag in BOILERPLATE_TAGS or (tag == "header" and not in_article):
        return True, False
    hidden = False
    for m in ATTRIBUTE.finditer(attributes):
        name, given = m[1].lower(), m[2] or m[3] or m[4] or ""
        value = given.lower()
        if name == "hidden" and m[0].lower() == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        elif name == "role":
            if value in BOILERPLATE_ROLES:
                return True, hidden
        elif name in ("class", "id") and tag not in ("html", "body", "main", "article") and marks_boilerplate(given):
            return True, hidden
    return hidden, hidden


class OpenTags:
    """The stack of open elements, each with what holds inside it, and how many of each kind are open."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool]] = []  # tag, in boilerplate, hidden
        self.count: Counter[str] = Counter()

    def flag(self, k: int) -> bool:
        return bool(self.stack) and self.stack[-1][k]

    def any(self, *tags: str) -> bool:
        return any(self.count[t] for t in tags)

    def open(self, tag: str, boilerplate: bool, hidden: bool) -> None:
        self.stack.append((tag, boilerplate or self.flag(1), hidden))
        self.count[tag] += 1

    def close(self, tag: str) -> None:
        while self.count[tag] and self.stack:
            top = self.stack.pop()[0]
            self.count[top] -= 1
            if top == tag:
                return

    def nearest(self, *tags: str) -> str:
        return next((t for t, *_ in reversed(self.stack) if t in tags), "")


ROW_TAGS = frozenset("li dt dd tr td th option".split())


def blocks(page: str) -> list[Block]:
    """Blocks in page order."""
    found: list[Block] = []
    parts: list[str] = []
    linked, at, tags = 0, 0, OpenTags()

    def end() -> None:
        nonlocal linked
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            found.append(Block(text, linked, tags.any("h1", "h2", "h3", "h4", "h5", "h6"), tags.flag(1), tags.any("article", "main"), tags.any("li", "dd", "dt", "td", "th")))
        parts.clear()
        linked = 0

    def data(text: str) -> None:
        nonlocal linked
        if text and not tags.flag(2):
            parts.append(text)
            if tags.count["a"]:
                linked += len(SPACE.sub(" ", html.unescape(text)).strip())

    while m := TAG.search(page, at):
        data(page[at : m.start()])
        at = m.end()
        tag, attributes = (m[2] or "").lower(), m[3] or ""
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK_TAGS:
                end()
            tags.close(tag)
            continue
        if tag == "br":
            data(" ")
            continue
        if tag in BLOCK_TAGS:
            end()
            if tag in PRUNED_BY_P:
                tags.close("p")
            if tag in ROW_TAGS and tags.nearest(tag, "ul", "ol", "dl", "table") == tag:
                tags.close(tag)
        if tag in VOID_TAGS:
            continue
        if tag in RAW_TAGS:
            at = RAW_ENDS[tag].search(page, at).end()
            continue
        boilerplate, hidden = is_boilerplate(tag, attributes, tags.any("article", "main"))
        if not attributes.rstrip().endswith("/"):
            tags.open(tag, boilerplate, hidden or tag in HIDDEN_TAGS or tags.flag(2))
    data(page[at:])
    end()
    return found


def stop_words(text: str) -> tuple[int, int]:
    """(stop words, words) of a text."""
    words = [w.lower() for w in WORD.findall(text)]
    return sum(w in STOP_WORDS for w in words), len(words)


def first_pass(found: list[Block], rules: Rules) -> list[str]:
    """good, bad, near or open for each block."""
    counts = [(0, 0) if b.boilerplate else stop_words(b.text) for b in found]
    unlinked = [c for b, c in zip(found, counts) if not b.linked]
    known = sum(s for s, _ in unlinked) >= rules.known_language * sum(n for _, n in unlinked)
    out = []
    for b, (stops, n) in zip(found, counts):
        size = len(b.text) + rules.unspaced * len(UNSPACED.findall(b.text))
        marks = len(MARKS.findall(b.text))
        if known:
            density = stops / max(1, n)
        else:  # a mark for each 60 characters is dense, one for each 150 is not
            density = rules.stop_high if marks * 60 >= size else rules.stop_low if marks * 150 >= size else 0.0
        if b.boilerplate:
            out.append("bad")
        elif b.linked > rules.links * len(b.text):
            sentence = b.inside and not b.item and not b.heading and size >= rules.short and density >= rules.stop_low and marks
            out.append("near" if sentence else "bad")
        elif size < rules.short:
            out.append("open")
        elif density >= rules.stop_high:
            out.append("good" if size > rules.long else "near")
        elif density >= rules.stop_low:
            out.append("near")
        else:
            out.append("open" if b.linked == 0 and b.inside else "bad")
    return out


def second_pass(found: list[Block], rules: Rules) -> list[Block]:
    """Blocks that are content."""
    decided = first_pass(found, rules)
    mass = lambda inside: sum(len(b.text) for b, label in zip(found, decided) if b.inside == inside and label in ("good", "near"))
    own = sum(len(b.text) for b in found if b.inside and not b.boilerplate)
    inside = own > 0 and own >= rules.inside_share * (own + mass(False))
    for k, b in enumerate(found):
        if inside and not b.inside:
            decided[k] = "bad"
    fixed = decided[:]
    last, before = "bad", []
    for label in decided:
        before.append(last)
        last = label if label in ("good", "bad") else last
    last, after = "bad", [""] * len(decided)
    for k in range(len(decided) - 1, -1, -1):
        after[k] = last
        last = decided[k] if decided[k] in ("good", "bad") else last
    for k, (b, label) in enumerate(zip(found, decided)):
        if label not in ("near", "open"):
            continue
        agree = {before[k], after[k]}
        if b.inside and inside:  # an article's own blocks: only what is marked or linked as boilerplate is taken out
            fixed[k] = "good"
        elif agree == {"good"} or label == "near" and "good" in agree:
            fixed[k] = "good"
        elif label == "near" and not b.linked and agree == {"bad"} and len(b.text) > rules.long:
            fixed[k] = "good"
        elif b.heading and "good" in decided[k + 1 : k + 3]:
            fixed[k] = "good"
        else:
            fixed[k] = "bad"
    return [b for b, label in zip(found, fixed) if label == "good"]


def main_text(page: str | None, rules: Rules = Rules()) -> str:  # noqa: B008
    return " ".join(b.text for b in second_pass(blocks(page or ""), rules))


def extract(pages: DataFrame, rules: Rules | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html)."""
    own = rules or Rules()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, own) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
