"""Sentences of legal prose: one pass over a text gives all spans, and the paragraph that each stands in.

A period ends a sentence unless it belongs to a number, to a single letter, to a word with a period inside ("N.H."), to a known
abbreviation, or the next word begins with a small letter. Question and exclamation marks always end one. A paragraph mark
begins one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

#: Abbreviations by kind: titles, firms, parts of documents, Latin, courts, reporters and codes, states.
ABBREVIATIONS = frozenset(
    "mr mrs ms dr jr sr hon messrs esq "
    "inc co corp cos ltd llc llp lp bros assn ass'n dept dep't comm'n bd univ ins nat'l int'l ry "
    "no nos art arts sec secs ch chs para paras pp vol vols ed eds cl ex exs app'x fn subd subds subpt subch amend amends tit sched "
    "v vs cf eg ie al etc ibid supra viz seq op cit cert "
    "ct cts dist div cir cty jud supp app j jj cj "
    "stat stats rev ann const rsa ord reg regs proc civ crim evid fed rep "
    "ala ariz ark cal colo conn del fla ga ill ind kan ky la mass md me mich minn miss mo mont neb nev okla ore pa tenn tex va vt wash wis wyo".split()
)
#: Fixed value: a paragraph number as courts print it.
PARAGRAPH = re.compile(r"\[?¶\s*(\d{1,4})\]?")
TOKENS = re.compile(rf"(?P<mark>{PARAGRAPH.pattern})|(?P<point>[.?!])(?P<close>[\"'”’)\]]*)(?=\s|$)")
LAST_WORD = re.compile(r"[\w.'’]*\Z")


@dataclass(frozen=True)
class Sentence:
    start: int
    stop: int
    paragraph: int | None


def is_abbreviation(word: str) -> bool:
    bare = word.lower().replace("’", "'")
    return len(bare) == 1 and bare.isalpha() or "." in bare.strip(".") and not bare[-1:].isdigit() or bare.strip(".") in ABBREVIATIONS


def sentences(text: str) -> list[Sentence]:
    """All sentences in order; together they cover the text but for paragraph marks."""
    out: list[Sentence] = []
    start, paragraph = 0, None
    for m in TOKENS.finditer(text):
        if m["mark"]:
            if m.start() > start:
                out.append(Sentence(start, m.start(), paragraph))
            start, paragraph = m.end(), int(m[2])
            continue
        if m["point"] == "." and not m["close"]:
            if is_abbreviation(LAST_WORD.search(text, max(0, m.start() - 30), m.start())[0]):
                continue
            rest = text[m.end() : m.end() + 3].lstrip()
            if rest and rest[0].islower():
                continue
        out.append(Sentence(start, m.end(), paragraph))
        start = m.end()
    if start < len(text):
        out.append(Sentence(start, len(text), paragraph))
    return out


def at(found: list[Sentence], place: int) -> int:
    """The number of the sentence that a place of the text stands in."""
    return max(0, bisect_right(found, place, key=lambda s: s.start) - 1)
