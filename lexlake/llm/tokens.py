"""Token ids and token counts by a public vocabulary file, always by the file's own library.

A pre-token of a plain byte-level BPE has the same ids wherever it stands, so a worker process asks the library once for
each pre-token and keeps the answer (at most ``CACHE_ENTRIES`` of them, some 200 MB). Words with a space before them are asked
for in one text, which the library splits at the same places; where each ends is told by the lengths of the tokens. Texts are split into pre-tokens here only where
every version of Unicode agrees on the classes of all their characters; any other text, a text with a special string, and any
other kind of file go to the library whole. Texts of any length are read in runs of ``RUN`` pre-tokens.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np

CACHE_ENTRIES, LONGEST, RUN, TOGETHER = 1_000_000, 200, 100_000, 256
#: Texts of these characters only are split here: ASCII, Latin, Greek and Cyrillic letters, common punctuation.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏΑ-ΡΣ-ώА-я", "0-9²³¹¼-¾"
COMMON_CHARS = "\t\n\r\x20-\x7e¡-ɏΑ-ΡΣ-ώА-я‐-‧€"
#: Fixed value: the published split pattern of byte-level BPE vocabularies of this family, over the characters above.
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
COMMON = re.compile(f"[{COMMON_CHARS}]*")
SPACED_WORD = re.compile(f" [{LETTERS}]+")


def is_plain_byte_bpe(spec: dict) -> bool:
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    return (
        model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        and not any(spec.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec.get("added_tokens") or ())
    )


def as_bytes(ids: list[int]) -> bytes:
    """ids as little-endian unsigned 32-bit integers (the byte order of every machine that Spark runs on)."""
    return array("I", ids).tobytes()


class Encoder:
    """What ``value`` makes of the ids of a text (its bytes, its count), without added special tokens; special strings inside a text
    become their ids, as the library does by default. ``join`` puts the values of the parts together."""

    def __init__(self, data: bytes, value: Callable, join: Callable):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; the library's threads cost more than they bring
        self.library = Tokenizer.from_buffer(data)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(data)
        self.special = [t["content"] for t in spec.get("added_tokens") or ()]
        self.plain = is_plain_byte_bpe(spec)
        self.value, self.join, self.known = value, join, {}
        self.token_bytes = np.zeros(self.library.get_vocab_size() + 1, np.int64)
        if self.plain:  # a byte is one character in the vocabulary
            for token, i in spec["model"]["vocab"].items():
                self.token_bytes[i] = len(token)

    def by_library(self, texts: list[str]) -> list:
        return [self.value(x.ids) for k in range(0, len(texts), 2_048) for x in self.library.encode_batch_fast(texts[k : k + 2_048], add_special_tokens=False)]

    def by_words(self, words: list[str]) -> list:
        """The values of pre-tokens."""
        out = {}
        spaced = [w for w in words if SPACED_WORD.fullmatch(w)]
        for k in range(0, len(spaced), TOGETHER):
            part = spaced[k : k + TOGETHER]
            ids = self.library.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids
            ends, starts = np.cumsum(self.token_bytes[ids]), np.cumsum([len(w.encode()) for w in part])
            cuts = np.searchsorted(ends, starts) + 1
            if cuts[-1] == len(ids) and (ends[cuts - 1] == starts).all():
                at = 0
                for w, stop in zip(part, cuts.tolist()):
                    out[w] = self.value(ids[at:stop])
                    at = stop
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self.by_library(rest)))
        return [out[w] for w in words]

    def runs(self, text: str) -> Iterator[list[str]] | None:
        """The pre-tokens of a text, run by run; None where the text must go to the library whole."""
        if not self.plain or not COMMON.fullmatch(text) or any(s in text for s in self.special):
            return None
        if len(text) <= RUN:
            return iter([SPLIT.findall(text)])
        found = (m[0] for m in SPLIT.finditer(text))
        return iter(lambda: list(islice(found, RUN)), [])

    def _values(self, words: list[str]) -> list:
        found = list(map(self.known.get, words))
        if None not in found:
            return found
        new = list(dict.fromkeys(w for w, v in zip(words, found) if v is None))
        if len(self.known) + len(new) > CACHE_ENTRIES:
            self.known.clear()
            new = list(dict.fromkeys(words))
        self.known.update(zip(new, self.by_words(new)))
        found = list(map(self.known.__getitem__, words))
        for w in new:
            if len(w) > LONGEST:
                del self.known[w]
        return found

    def __call__(self, text: str, frequent: dict | None = None):
        """``frequent``: values of common pre-tokens that are looked up before the cache."""
        runs = self.runs(text)
        if runs is None:
            return self.by_library([text])[0]
        parts = []
        for words in runs:
            if frequent:
                found = list(map(frequent.get, words))
                if None in found:
                    found = [*(v for v in found if v is not None), *self._values([w for w, v in zip(words, found) if v is None])]
                    parts.append(self.join(found))
                    continue
            else:
                found = self._values(words)
            parts.append(self.join(found))
        return self.join(parts)


@functools.lru_cache(maxsize=2)
def encoder(data: bytes) -> Encoder:
    """Ids as bytes; one for each worker process, whose cache lives as long as the process."""
    return Encoder(data, as_bytes, b"".join)


@functools.lru_cache(maxsize=2)
def counter(data: bytes) -> Encoder:
    """Numbers of ids; one for each worker process."""
    return Encoder(data, len, sum)
