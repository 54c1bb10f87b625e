"""Garbled text from wrong character encodings: found and restored by minimum description length.

Candidate histories of a text are chains of (encoding it was in, encoding it
was read with). A chain is undone by encoding with the second and decoding
with the first, for stretches: UTF-8 that was read as a single-byte encoding
is undone run by run of non-ASCII characters where the bytes are valid UTF-8
of assigned characters (of any script), single-byte mix-ups sentence by
sentence. Which readings a run or sentence can be at all follows from its
characters and is looked up before any is tried; those are compressed that
leave no more characters that the language hardly has (of single-byte
mix-ups fewer) than before.
The description length of a stretch is its size compressed by zstandard with
a dictionary of the text's language (of each language where it isn't known),
plus the chain's cost, the bytes that naming its steps takes. Of
all chains of up to ``depth`` steps (text damaged more than once) the one of
least length wins; where none is shorter than the text as it is, it stays.

Models: one dictionary per language, from all its texts longer than 40
characters that pass a purity check: groups of texts are distilled, then what
is left of them, until one dictionary remains. Characters are counted over
all of these texts. Everything else runs on all rows where they are: no shuffle,
no state between rows. Characters that no restoration can explain
(U+FFFD, C1 controls) mark a text as affected but not restorable.

Defined results: null and empty texts are not affected and stay as they are.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Encodings that text is commonly read with by mistake, and those it was commonly in.
READ_AS = ("cp1252", "latin_1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850")
WAS_IN = ("cp1252", "cp1250", "cp1251", "iso8859_2", "mac_roman", "koi8_r", "cp866")
#: Bytes that naming a step takes: one of the readings; for a stretch one of the pairs and where it lies.
UTF8_COST, BYTES_COST = math.log2(len(READ_AS)) / 8, 2.0
LOST = "�"
#: Share of a language's texts that have a usual character; bytes that a dictionary is made from at least; how many groups one is made of.
USUAL, ENOUGH, FAN = 0.01, 20_000, 16
_OFFSETS = b"\1\0\0\0\4\0\0\0\x08\0\0\0"
_LONG_RUN = re.compile(r"[^\x00-\x7f]{2,}")  # one character alone is never UTF-8 read as single bytes
_CONTROL = re.compile(r"[\x80-\x84\x86-\x9f]")  # no text has these on purpose; \x85 is a line end of old
_BEYOND = re.compile(r"[^\x00-\x7f]")
_STRETCH = re.compile(r"[^.!?\n]+")


@functools.cache
def _table(encoding: str) -> dict[str, int]:
    """Character -> byte; bytes the encoding leaves open are read as control characters, as lenient readers do."""
    out: dict[str, int] = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


def back(text: str, encoding: str) -> bytes | None:
    """The bytes that ``encoding`` reads as ``text``; None if there are none."""
    t = _table(encoding)
    try:
        return bytes([t[c] for c in text])
    except KeyError:
        return None


def undo_each(text: str, usual: frozenset[str]) -> dict[str, str]:
    """{encoding: undo_utf8(text, encoding)} for the encodings that change anything.

    A run is left as it is where it would become one with more characters that the language hardly has (those not ``usual``).
    """
    by: dict[str, dict[str, str]] = {}
    strange = lambda x: sum(c > "\x7f" and c not in usual for c in x)
    for run in set(_LONG_RUN.findall(text)):
        if options := undone(run):
            most = strange(run)
            for enc, got in options.items():
                if strange(got) <= most:
                    by.setdefault(enc, {})[run] = got
    return {enc: _LONG_RUN.sub(lambda m: by[enc].get(m[0], m[0]), text) for enc in READ_AS if enc in by}  # noqa: B023


@functools.lru_cache(300_000)
def undone(run: str) -> dict[str, str]:
    """{encoding: what a run was, had it been UTF-8 read as that encoding}, only where it can have been."""
    out = {}
    for enc in READ_AS:
        b = back(run, enc)
        try:
            got = b.decode("utf-8") if b is not None else _pieces(run, enc)
        except UnicodeDecodeError:
            got = _pieces(run, enc)
        if got != run and (all(map(assigned, got)) or any("\x80" <= c < "\xa0" for c in got)):
            out[enc] = got
    return out


@functools.cache
def assigned(c: str) -> bool:
    """A character of any script that text can have: no control, no private or unassigned code point."""
    return unicodedata.category(c) not in ("Cc", "Cn", "Co", "Cs")


_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _pieces(run: str, read_as: str) -> str:
    """Valid UTF-8 sequences inside a run of which other characters were right or lost."""
    t, out, k = _table(read_as), [], 0
    while k < len(run):
        for n in (4, 3, 2):
            piece = run[k : k + n]
            if len(piece) == n and all(c in t for c in piece):
                b = bytes([t[c] for c in piece])
                if _UTF8.fullmatch(b):
                    try:
                        got = b.decode()
                    except UnicodeDecodeError:
                        continue
                    if not assigned(got) and not "\x80" <= got < "\xa0":
                        continue
                    out.append(got)
                    k += n
                    break
        else:
            out.append(run[k])
            k += 1
    return "".join(out)


@functools.lru_cache(100_000)
def readings(letters: str) -> tuple[tuple[str, dict[int, str]], ...]:
    """(chain, translation) of every way in which these characters beyond ASCII can be one single-byte encoding read as another; same outcomes once."""
    out: dict[str, tuple[str, dict[int, str]]] = {}
    for enc in READ_AS:
        b = back(letters, enc)
        for was in WAS_IN if b is not None else ():
            try:
                got = b.decode(was)
            except UnicodeDecodeError:
                continue
            if got != letters and not any("\x7f" <= c < "\xa0" for c in got):
                out.setdefault(got, (f"{was}>{enc}", {ord(x): y for x, y in zip(letters, got)}))
    return tuple(out.values())


class Model:
    """Dictionaries by language and the characters each language's texts commonly have."""

    def __init__(self, dictionaries: dict[str, bytes], common: dict[str, str], level: int = 3):
        self.dictionaries, self.common, self.level = dictionaries, common, level
        self._made: dict[str, zstandard.ZstdCompressor] = {}
        self._usual: dict[str | None, frozenset[str]] = {}

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "common": self.common, "level": self.level, "_made": {}, "_usual": {}}

    def length(self, text: str, lang: str) -> int:
        """Compressed bytes under the dictionary of ``lang``."""
        c = self._made.get(lang)
        if c is None:
            d = zstandard.ZstdCompressionDict(self.dictionaries[lang])
            d.precompute_compress(level=self.level)
            c = self._made[lang] = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(c.compress(text.encode("utf-8", "surrogatepass")))

    def languages(self, lang: str | None) -> list[str]:
        return [lang] if lang in self.dictionaries else list(self.dictionaries)

    def best(self, text: str, lang: str | None) -> int:
        return min((self.length(text, x) for x in self.languages(lang)), default=len(text.encode()))

    def knows(self, lang: str | None) -> bool:
        return bool(lang) and bool(self.common.get(lang))

    def fitting(self, text: str) -> str | None:
        """The language whose dictionary fits the text best."""
        return min(((self.length(text, x), x) for x in self.dictionaries), default=(0, None))[1]

    def usual(self, lang: str | None) -> frozenset[str]:
        """Characters beyond ASCII that texts of the language commonly have."""
        u = self._usual.get(lang)
        if u is None:
            u = self._usual[lang] = frozenset(self.common.get(lang or "") or self.common.get("", ""))
        return u

    def usual_of(self, text: str, lang: str | None) -> frozenset[str]:
        """usual() of the text's language or, where that isn't known, of the one that fits it best."""
        return self.usual(lang if self.knows(lang) or text.isascii() else self.fitting(text))

    def rare(self, text: str, lang: str | None) -> int:
        """Characters beyond ASCII that texts of the language hardly have; where it isn't known, of the one that fits the text best."""
        usual = self.usual_of(text, lang)
        return sum(c not in usual for c in _BEYOND.findall(text))


def _mixed_up(text: str, lang: str | None, model: Model, cost: float) -> tuple[str, list[str]]:
    """``text`` with the stretches put right that were in one single-byte encoding and read as another, where that is shorter."""
    chains: list[str] = []
    known = model.knows(lang)
    usual = model.usual(lang)
    if known and usual.issuperset(_BEYOND.findall(text)):
        return text, chains
    whole = lang if known else model.fitting(text)

    def stretch(m: re.Match) -> str:
        s = m[0]
        if s.isascii():
            return s
        letters = _BEYOND.findall(s)
        # of an unknown language: unusual for what the sentence looks like, or for the text around it
        r = sum(c not in usual for c in letters) if known else max(model.rare(s, None), model.rare(s, whole))
        if not r:
            return s
        options = []
        for chain, put in readings("".join(sorted(set(letters)))):
            got = None if known else s.translate(put)
            n = sum(put[ord(c)] not in usual and put[ord(c)] > "\x7f" for c in letters) if known else model.rare(got, lang)
            if n < r:
                got = got or s.translate(put)
                options.append((model.best(got, lang) + cost, n, got, chain))
        if not options or min(options)[0] >= model.best(s, lang):
            return s
        _, _, got, chain = min(options)
        chains.append(chain)
        return got

    return _STRETCH.sub(stretch, text), list(dict.fromkeys(chains))


def restore(text: str, lang: str | None, model: Model, utf8_cost: float = UTF8_COST, bytes_cost: float = BYTES_COST, depth: int = 3) -> tuple[str, list[str]]:
    """(restored text, chains undone): of all candidate texts up to ``depth`` steps away, the one with the least description length.

    A step's text may be longer than the one before it and still lie on the
    way to the shortest, so chains are followed through, not judged one by one.
    """
    if not text or text.isascii():
        return text, []
    seen = {text}
    frontier: list[tuple[str, list[str], float]] = [(text, [], 0.0)]
    best = None
    for _ in range(depth):
        reached = []
        for t, chain, cost in frontier:
            options = [(got, [f"utf_8>{enc}"], utf8_cost) for enc, got in undo_each(t, model.usual_of(t, lang)).items()]
            got, undone = _mixed_up(t, lang, model, bytes_cost)
            options.append((got, undone, 0))
            for got, undone, c in options:
                if got not in seen:
                    seen.add(got)
                    reached.append((got, [*chain, *undone], cost + c))
        if reached and best is None:
            best = (model.best(text, lang), -1, text, [])  # a tie leaves the text as it is
        for got, chain, cost in reached:
            best = min(best, (model.best(got, lang) + cost, model.rare(got, lang), got, chain), key=lambda x: x[:2])
        frontier = [x for x in reached if not x[0].isascii()]
        if not frontier:
            break
    return (best[2], best[3]) if best else (text, [])


def affected(text: str | None, lang: str | None, model: Model) -> tuple[bool, str | None, str | None]:
    """(affected, restored text, chains)."""
    if not text:
        return False, text, None
    got, chains = restore(text, lang, model)
    return bool(chains) or LOST in got or bool(_CONTROL.search(got)), got, " ".join(dict.fromkeys(chains)) or None


def _tally(text: str) -> dict[str, int]:
    """A text's characters beyond ASCII once each; at "" the text itself, at "bytes" its size."""
    return dict.fromkeys(_BEYOND.findall(text), 1) | {"": 1, "bytes": len(text.encode())}


def _tallied(texts: list[str]) -> Counter:
    out: Counter = Counter()
    for t in texts:
        out.update(_tally(t))
    return out


def _frequent(counts: Counter, share: float) -> frozenset[str]:
    """Characters beyond ASCII that at least ``share`` of the tallied texts have."""
    return frozenset(c for c, n in counts.items() if c not in ("", "bytes") and n >= max(3, share * counts[""]))


def _pure(text: str, often: frozenset[str]) -> bool:
    """Without a trace of damage: no run that can be UTF-8, no sentence of which a single-byte reading turns two or more letters into characters ``often`` there, and leaves no others."""
    if LOST in text or undo_each(text, often):
        return False
    if often.issuperset(_BEYOND.findall(text)):
        return True
    for s in _STRETCH.findall(text):
        letters = [] if s.isascii() else sorted(set(_BEYOND.findall(s)))
        if sum(c not in often for c in letters) > 1 and any(all(y in often or y <= "\x7f" for y in put.values()) for _, put in readings("".join(letters))):
            return False
    return True


def _parts(text: str) -> list[str]:
    return re.findall(r"[^\n]{1,400}", text)


def _dictionary(parts: list[bytes], size: int, whole: int = 0) -> bytes | None:
    """A dictionary, if there is text enough for one. whole: bytes of the text that the parts were distilled from."""
    total = sum(map(len, parts))
    return zstandard.train_dictionary(min(size, max(total, whole) // 4), parts, k=256, d=8).as_bytes() if total > ENOUGH else None


def _distilled(parts: list[bytes], size: int) -> list[str]:
    """What a dictionary keeps of the parts, of ``size`` but always of more than one is made from at least; all of them where they hardly exceed it."""
    keep = max(size, 2 * ENOUGH)
    if sum(map(len, parts)) <= keep:
        return [p.decode() for p in parts]
    # its content comes after the tables and the three offsets that every dictionary starts with
    return _parts(zstandard.train_dictionary(keep, parts, k=256, d=8).as_bytes().split(_OFFSETS, 1)[1].decode("utf-8", "ignore"))


def fit(texts: dict[str, list[str]], size: int = 64_000, usual: float = USUAL) -> Model:
    """A model from texts by language: only texts of common characters without a trace of damage teach the dictionaries.

    The pooled characters come from all of them; a pooled dictionary is only made where no language has enough text for one of its own.
    """
    # damage first shows against the characters that very many texts of the language have
    pure = {x: [t for t in ts if _pure(t, often)] for x, ts in texts.items() for often in [_frequent(_tallied(ts), 5 * usual)]}
    dictionaries, common = {}, {}
    for lang, ts in [*sorted(pure.items()), ("", [t for ts in pure.values() for t in ts])]:
        usually = _frequent(_tallied(ts), usual)
        common[lang] = "".join(sorted(usually))
        if not lang and dictionaries:
            break
        if made := _dictionary([s.encode() for t in ts if usually.issuperset(_BEYOND.findall(t)) for s in _parts(t)], size):
            dictionaries[lang] = made
    return Model(dictionaries, common)


def train(documents: DataFrame, sample: int = 30_000, size: int = 64_000, usual: float = USUAL) -> Model:
    """Dictionaries and common characters per language, from every text of more than 40 characters: what ``fit`` makes, at any size.

    Characters are counted over all texts. Dictionaries are made in steps:
    groups of about ``sample`` texts (by hash, so they are the same on every
    run) are each distilled into what a dictionary keeps of them, those
    ``FAN`` at a time, until one is left per language. The driver gets the
    counts and the dictionaries, never texts.
    """
    rows = documents.where(F.col("lang").isNotNull() & (F.length("text") > 40)).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))

    def tallied(often: dict[str, frozenset[str]] | None) -> dict[str, Counter]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            by: dict[str, Counter] = defaultdict(Counter)
            for b in batches:
                for x, t in zip(b["lang"], b["text"]):
                    if often is None or _pure(t, often[x]):
                        by[x].update(_tally(t))
            yield pd.DataFrame([(x, c, n) for x, counts in by.items() for c, n in counts.items()], columns=["lang", "c", "n"])

        out: dict[str, Counter] = defaultdict(Counter)
        for x, c, n in rows.select("lang", "text").mapInPandas(run, "lang string, c string, n bigint").groupBy("lang", "c").agg(F.sum("n")).collect():
            out[x][c] = n
        return out

    often = {x: _frequent(counts, 5 * usual) for x, counts in tallied(None).items()}
    pure = tallied(often)
    usually = {x: _frequent(pure[x], usual) for x in often}
    pool: Counter = sum(pure.values(), Counter())
    pooled = _frequent(pool, usual)

    def taught(by: dict[str, Counter], common: dict[str, frozenset[str]], name: dict[str, str]) -> dict[str, bytes]:
        """Dictionaries by name: of each language, or of several languages under one."""
        left = {x: max(-(-k[""] // sample), -(-k["bytes"] // (1000 * sample))) for x, k in by.items()}

        many = left

        def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                got = [(n, h % many[n], h, _parts(t), None) for x, t, h in zip(b["lang"], b["text"], b["h"]) for n in [name[x]] if common[n].issuperset(_BEYOND.findall(t)) and _pure(t, often[x])]
                yield pd.DataFrame(got, columns=["lang", "g", "h", "parts", "dictionary"])

        def step(groups: dict[str, int]):
            def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
                lang, g = key[0], int(key[1])
                if not groups[lang]:
                    return b
                parts = [s.encode() for ps in b.sort_values("h")["parts"] for s in ps]
                last = groups[lang] == 1
                row = (lang, g // FAN, g, [] if last else _distilled(parts, size), _dictionary(parts, size, by[lang]["bytes"] * (many[lang] > 1)) if last else None)
                return pd.DataFrame([row], columns=["lang", "g", "h", "parts", "dictionary"])

            return run

        kind = "lang string, g bigint, h bigint, parts array<string>, dictionary binary"
        out = rows.mapInPandas(chosen, kind)
        while any(left.values()):
            out = out.groupBy("lang", "g").applyInPandas(step(left), kind)
            left = {x: -(-k // FAN) if k > 1 else 0 for x, k in left.items()}  # none: it has its dictionary
        return {x: bytes(d) for x, d in out.where("dictionary is not null").select("lang", "dictionary").collect()}

    dictionaries = taught(pure, usually, {x: x for x in often}) or taught({"": pool}, {"": pooled}, dict.fromkeys(often, ""))
    return Model(dictionaries, {x: "".join(sorted(c)) for x, c in (usually | {"": pooled}).items()})


def repaired(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, affected, restored, chains) for every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            rows = [affected(t, x, m) for t, x in zip(b["text"], b["lang"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "affected": [r[0] for r in rows], "restored": [r[1] for r in rows], "chains": [r[2] for r in rows]})

    return documents.select("doc_id", "text", "lang").mapInPandas(run, "doc_id bigint, affected boolean, restored string, chains string")
