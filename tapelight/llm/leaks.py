"""Evaluation texts leaking into training text: Wu-Manber multi-pattern search.

Both sides are normalised to a stream of letters and digits: markup and
character entities resolved, letter case, accents and strokes folded,
punctuation, spacing, hyphens at line ends and invisible characters dropped.
Every window of ``words`` consecutive words of an item becomes one test
string (its letters run together, with the word ends remembered), so an
occurrence is found however the document spells the gaps between words.

The search is Wu-Manber over that stream. ``SHIFT`` maps a block of B
characters to the distance it proves to the next possible end of a test
string (all test strings count with their last m characters, m the shortest
length); a block no test string has skips m-B+1 characters. At shift 0 a
bucket keyed by the hash of the last characters selects test strings, and
direct comparison, then a check that the match starts and ends at word
boundaries of the document, confirms an occurrence.

The tables come from the held-out set, ``block`` items at a time; they are
broadcast, and documents are searched where they are: no shuffle, whole
texts, one pass a block, memory of one document.

Defined results: null and blank texts and items shorter than ``words`` match
nothing; an item text that occurs twice reports both items.
"""

from __future__ import annotations

import functools
import html
import itertools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters with strokes and ligatures that canonical decomposition leaves whole, and their plain forms.
STROKES = {
    "ł": "l", "ø": "o", "đ": "d", "ð": "d", "ħ": "h", "ŧ": "t", "ı": "i", "ɨ": "i", "ƶ": "z", "ƀ": "b", "ɍ": "r", "ȼ": "c",
    "ɇ": "e", "ɉ": "j", "ꝁ": "k", "ǥ": "g", "ʉ": "u", "ɏ": "y", "ⱥ": "a", "ⱦ": "t", "ᵽ": "p", "ꝑ": "p", "ƚ": "l", "ⱡ": "l", "ɵ": "o", "æ": "ae", "œ": "oe", "ß": "ss", "þ": "th",
}
_STROKES = str.maketrans(STROKES)
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*\)")
_HYPHEN = re.compile(r"[-­‐‑]\s*\n\s*")
_WORD = re.compile(r"[^\W_]+")
_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def fold(text: str) -> str:
    """Text with everything that doesn't matter folded away, words still apart."""
    if "&" in text and _ENTITY.search(text):
        text = html.unescape(text)
        if "&" in text:
            text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if "\n" in text:
        text = _HYPHEN.sub("", text)
    text = re.sub(r"['’‘ʼ`´]", "", text)
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text).casefold()
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) not in ("Mn", "Me", "Cf", "Cc") or c in "\n\t\r")
    return text.translate(_STROKES)


def words_of(text: str) -> list[str]:
    return _WORD.findall(fold(text))


class Tables:
    """Test strings and the shift and bucket tables of their last m characters."""

    def __init__(self, items: list[tuple[int, str]], words: int = 12, block: int = 6, bucket: int = 12):
        strings: dict[str, set[int]] = {}
        for item, text in items:
            w = words_of(text or "")
            for k in range(len(w) - words + 1):
                strings.setdefault("".join(w[k : k + words]), set()).add(item)
        self.m = min(map(len, strings), default=0)
        self.block, self.bucket = min(block, self.m), min(bucket, self.m)
        self.skip = self.m - self.block + 1
        self.shift: dict[str, int] = {}
        self.buckets: dict[int, list[tuple[str, tuple[int, ...]]]] = {}
        for s, who in strings.items():
            end = s[-self.m :]
            for k in range(self.m - self.block + 1):
                b = end[k : k + self.block]
                self.shift[b] = min(self.shift.get(b, self.skip), self.m - self.block - k)
            self.buckets.setdefault(hash(s[-self.bucket :]), []).append((s, tuple(sorted(who))))

    def __getstate__(self):  # string hashes differ between processes
        return {k: v for k, v in self.__dict__.items() if k != "buckets"} | {"strings": [x for b in self.buckets.values() for x in b]}

    def __setstate__(self, state):
        strings = state.pop("strings")
        self.__dict__.update(state)
        self.buckets = {}
        for s, who in strings:
            self.buckets.setdefault(hash(s[-self.bucket :]), []).append((s, who))

    def search(self, text: str | None) -> set[int]:
        """Items with a test string in ``text``."""
        found: set[int] = set()
        if not text or not self.m:
            return found
        w = words_of(text)
        stream = "".join(w)
        i, n, block, skip, shift = self.m, len(stream), self.block, self.skip, self.shift.get
        bounds: set[int] | None = None
        while i <= n:
            step = shift(stream[i - block : i], skip)
            if step:
                i += step
                continue
            for s, who in self.buckets.get(hash(stream[i - self.bucket : i]), ()):
                if i >= len(s) and stream.startswith(s, i - len(s)) and not found.issuperset(who):
                    if bounds is None:
                        at, bounds = 0, {0}
                        for x in w:
                            at += len(x)
                            bounds.add(at)
                    if i in bounds and i - len(s) in bounds:
                        found.update(who)
            i += 1
        return found


def blocks(rows: Iterator, size: int) -> Iterator[list]:
    """Lists of up to ``size`` rows."""
    while block := list(itertools.islice(rows, size)):
        yield block


def leaked(documents: DataFrame, items: DataFrame, words: int = 12, block: int = 100_000) -> DataFrame:
    """(doc_id, item_id) of every document that shares ``words`` consecutive words with an item.

    ``block`` bounds the items whose tables are broadcast at a time; more items are searched block after block, each over all documents.
    """
    spark = documents.sparkSession
    texts = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")
    wanted = ((r[0], r[1]) for r in items.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).toLocalIterator())

    def search(some: list[tuple[int, str]]) -> DataFrame:
        tables = spark.sparkContext.broadcast(Tables(some, words))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            t = tables.value
            for b in batches:
                out = [(d, x) for d, text in zip(b["doc_id"], b["text"]) for x in sorted(t.search(text))]
                yield pd.DataFrame(out, columns=["doc_id", "item_id"], dtype="int64")

        return texts.mapInPandas(run, "doc_id bigint, item_id bigint")

    found = [search(b) for b in blocks(wanted, block)] or [search([])]
    # an id on several rows may come in several blocks
    return functools.reduce(DataFrame.unionAll, found).distinct() if len(found) > 1 else found[0]
