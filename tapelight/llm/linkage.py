"""Matching entities across sources without keys: collective graph linkage.

Both sides are bouts: two names each and one or more dates. The steps:

1. Candidate graph: bouts that share an attribute are joined. An attribute is
   a part of the names at a time: the first two letters of a token of each
   fighter, or a whole name token, on a day (a market's and its neighbours);
   the first three letters of both, in a stretch of four weeks (bouts that
   were put off or brought forward), or without a time for bouts without any
   date. An edge weighs the sum of log(N / n) over the name parts it shares,
   N being the bouts of both sides and n those with that part at any time, so
   a name that few people have counts more than one that many have.
2. Meta-blocking: an edge stays if it is at least the mean of the edges of
   either of its ends, so a bout is compared with few others.
3. Similarity of the names, fighter by fighter in the better of both orders:
   exact, respelled, shortened, initial or run-together tokens; lower where
   the dates are further apart, and none beyond ``moved`` days.
4. Propagation: an edge's similarity rises with that of the other edges that
   relate the same two spellings of a fighter (its neighbours in the graph,
   itself left out) and falls with better edges of the same market, until no
   edge moves by more than ``epsilon``. Each round is written to the shared
   folder, the round before it deleted. A round moves an edge by less than
   half of what its neighbours moved, so rounds end; that they do is checked.

Scale: attribute blocks are small because every attribute combines a time
with names; edges are aggregated by pair before any name is compared, and
the graph is only ever handled as rows: nothing is collected but the largest
change of a round.

Defined results: bouts for which two names can't be had from any field match
nothing; repeated rows of a bout count once; of equal edges the nearer date,
then the smaller id wins. Empty tables give an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelight.llm.leaks import words_of
from tapelight.session import discard, spread, written

# Name suffixes that don't tell people apart.
SUFFIXES = frozenset(("jr", "sr", "ii", "iii", "iv"))
_NICKNAME = re.compile(r'"[^"]*"|“[^”]*”|„[^“”]*[“”]')
_CAMEL = re.compile(r"(?<=[^\W\d_A-Z])(?=[A-Z][a-z])")
_TITLES = tuple(re.compile(p) for p in (r"who wins: (.+?) or (.+?)\?", r"will (.+?) (?:beat|defeat) (.+?)(?: on [a-z]{3,9}\.? \d+)?\?", r"[^:]*: (.+?) (?:against|vs\.?) (.+?)", r"(.+?) (?:vs\.?|against|-) (.+?)"))


def names_in(title: str | None) -> list[str]:
    """The two names a title puts against each other."""
    for p in _TITLES:
        if title and (m := re.fullmatch(p.pattern, title.strip(), re.I)):
            return [m[1], m[2]]
    return []


def tokens(name: str | None) -> list[str]:
    """Folded tokens of a name without nickname and suffix; camel-case particles come apart."""
    text = _CAMEL.sub(" ", _NICKNAME.sub(" ", name or "").replace("-", " "))
    return [t for t in words_of(text) if t not in SUFFIXES]


@functools.lru_cache(500_000)
def token_alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.5 if a[0] == b[0] else 0.0
    if a.startswith(b) or b.startswith(a):
        return 0.75
    m = SequenceMatcher(None, a, b)
    r = m.ratio() if m.real_quick_ratio() >= 0.75 and m.quick_ratio() >= 0.75 else 0.0
    return 0.95 * r if r >= 0.75 else 0.0


@functools.lru_cache(500_000)
def _runs_together(t: str, joined: str) -> bool:
    m = SequenceMatcher(None, t, joined)
    return m.real_quick_ratio() >= 0.8 and m.quick_ratio() >= 0.8 and m.ratio() >= 0.8


def name_alike(a: list[str], b: list[str]) -> float:
    """Similarity of two names in [0, 1]: the shorter one's tokens, each with its best partner; little without one telling token."""
    if not a or not b:
        return 0.0
    short, long = sorted((a, b), key=lambda n: (len(n), sum(map(len, n)), n))
    joined, used, total, weight, telling = "".join(long), set(), 0.0, 0.0, False
    for t in sorted(short, key=len, reverse=True):
        best, at = max((token_alike(t, u) if k not in used else 0.0, -k) for k, u in enumerate(long))
        if best < 0.75 and len(t) >= 5 and (t in joined or _runs_together(t, joined)):
            best = 0.95
        else:
            used.add(-at)
        w = 0.4 if len(t) == 1 else 1.0
        total, weight, telling = total + w * best, weight + w, telling or (best >= 0.7 and len(t) > 1)
    return total / weight * (1.0 if telling else 0.3)


def _key(t: str, n: int) -> str:
    """First letters as they survive respelling."""
    return re.sub(r"(.)\1+", r"\1", t.replace("y", "i").replace("ck", "k"))[:n]


_STRETCH = 28


def attributes(names: list[list[str]], days: list[int], around: int, moved: int) -> list[tuple[str, str]]:
    """(name part, time) attributes of a bout; days ``around`` and stretches within ``moved`` days of its own are added (for one side of the join only)."""
    pair = lambda n: {"|".join(sorted((_key(x, n), _key(y, n)))) for x in names[0] for y in names[1] if len(x) > 1 and len(y) > 1}
    near = {d + k for d in days for k in range(-around, around + 1)}
    weeks = {(d + k) // _STRETCH for d in days for k in {-moved, 0, moved}}
    out = {(x, str(d)) for x in pair(2) | {t for n in names for t in n if len(t) >= 4} for d in near}
    out |= {(x, f"w{w}") for x in pair(3) for w in weeks}
    return sorted(out | {(x, "") for x in pair(3)} if around or not days else out)


def _prepare(around: int, moved: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, lists, titles, days in zip(b["id"], b["lists"], b["titles"], b["days"]):
                names: list[str] = []
                for option in [*(lists if lists is not None else ()), *(names_in(t) for t in (titles if titles is not None else ()))]:
                    got = [n for n in (option if option is not None else ()) if n and n.strip().lower() not in ("yes", "no")]
                    if len(got) == 2 and all(tokens(n) for n in got):
                        names = got
                        break
                if len(names) == 2:
                    split = sorted(tokens(n) for n in names)
                    known = sorted({int(d) for d in (days if days is not None else ()) if not pd.isna(d)})
                    rows.append((i, [" ".join(s) for s in split], known, attributes(split, known, around, moved)))
            yield pd.DataFrame(rows, columns=["id", "names", "days", "attrs"])

    return run


def bouts(df: DataFrame, around: int, moved: int = 0) -> DataFrame:
    """(id, names, days, attrs) from (id, lists array<array<string>>, titles array<string>, days array<bigint>)."""
    one = spread(df.where(F.col("id").isNotNull()).dropDuplicates(["id"]), "id")
    return one.mapInPandas(_prepare(around, moved), "id string, names array<string>, days array<bigint>, attrs array<struct<part:string,at:string>>")


_EDGE = "k string, p string, k1 string, p1 string, s1 double, k2 string, p2 string, s2 double, apart int"


def _score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for k, p, kn, pn, kd, pd_ in zip(b["k"], b["p"], b["kn"], b["pn"], b["kd"], b["pd"]):
            a, c = [n.split() for n in kn], [n.split() for n in pn]
            s = [[name_alike(x, y) for y in c] for x in a]
            straight = min(s[0][0], s[1][1]) + s[0][0] + s[1][1] >= min(s[0][1], s[1][0]) + s[0][1] + s[1][0]
            x, y = (0, 1) if straight else (1, 0)
            apart = min((abs(int(d) - int(e)) for d in kd for e in pd_), default=None)
            rows.append((k, p, kn[0], pn[x], s[0][x], kn[1], pn[y], s[1][y], apart))
        out = pd.DataFrame(rows, columns=[f.split()[0] for f in _EDGE.split(", ")])
        yield out.astype({"apart": "Int32"})


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(k, p, weight): pairs that share an attribute, meta-blocked."""
    a = left.select(F.col("id").alias("k"), F.inline("attrs"))
    b = right.select(F.col("id").alias("p"), F.inline("attrs"))
    parts = lambda d: d.select(F.explode(F.array_distinct(F.transform("attrs", lambda x: x["part"]))).alias("part"))
    seen = parts(left).unionAll(parts(right)).groupBy("part").agg(F.count("*").alias("n"))
    of_all = left.select("id").unionAll(right.select("id")).agg(F.count("*").alias("all"))  # one row
    told = seen.crossJoin(F.broadcast(of_all)).select("part", F.log(F.col("all") / F.col("n")).alias("w"))
    shared = a.join(b.join(told, "part"), ["part", "at"])
    # a part counts once for a pair, at however many times they share it
    once = F.aggregate(F.collect_set(F.struct("part", "w")), F.lit(0.0), lambda t, x: t + x["w"])
    edges = shared.groupBy("k", "p").agg(once.alias("weight"))
    # weighted node pruning, kept if either end keeps it
    mean = lambda c: F.avg("weight").over(Window.partitionBy(c))
    return edges.withColumns({"mk": mean("k"), "mp": mean("p")}).where("weight >= mk - 1e-9 or weight >= mp - 1e-9").select("k", "p", "weight")


def link(left: DataFrame, right: DataFrame, least: float = 0.5, moved: int = 21, pull: float = 0.3, epsilon: float = 0.01, rounds: int = 50) -> DataFrame:
    """(k, p, confidence): each right bout's match among the left ones, if it has one; a left bout may have several.

    A date may be a day off; further off, up to ``moved`` days, both names must agree well: people meet again months later, not weeks.
    ``rounds`` only guards against propagation that doesn't end, which is an error.
    """
    l, r = (written(x, "bouts") for x in (left, right))
    edges = candidates(l, r).join(l.select(F.col("id").alias("k"), F.col("names").alias("kn"), F.col("days").alias("kd")), "k").join(r.select(F.col("id").alias("p"), F.col("names").alias("pn"), F.col("days").alias("pd")), "p")
    worst = F.least("s1", "s2")
    edges = spread(edges, "k").mapInPandas(_score, _EDGE).where(worst > 0.3)
    near: Column = F.when(F.col("apart").isNull(), 0.9).when(F.col("apart") <= 1, 1 - 0.02 * F.col("apart")).when((F.col("apart") <= moved) & (worst >= 0.75), 0.7).otherwise(0.0)
    edges = written(edges.withColumn("near", near).withColumn("x", (F.col("s1") + F.col("s2")) / 2 * near).where("x > 0"), "edges")
    discard(l, r)
    for _ in range(rounds):
        # evidence for a pair of spellings: the other edges that relate them
        sides = edges.select("x", F.explode(F.array(F.struct(F.col("k1").alias("a"), F.col("p1").alias("b")), F.struct(F.col("k2").alias("a"), F.col("p2").alias("b")))).alias("q")).select("x", "q.a", "q.b")
        top = sides.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("x").alias("sum")).where("n > 1")
        e = edges
        for i in ("1", "2"):
            t = top.select(F.col("a").alias(f"k{i}"), F.col("b").alias(f"p{i}"), F.col("n").alias(f"n{i}"), F.col("sum").alias(f"sum{i}"))
            e = e.join(t, [f"k{i}", f"p{i}"], "left")
        others = lambda i: F.coalesce((F.col(f"sum{i}") - F.col("x")) / (F.col(f"n{i}") - 1), F.lit(0.0))
        lifted = lambda i: F.col(f"s{i}") + (1 - F.col(f"s{i}")) * pull * others(i)
        mine = (lifted("1") + lifted("2")) / 2 * F.col("near")
        e = e.withColumn("mine", mine).withColumn("y", F.col("mine") * (0.5 + 0.5 * F.col("mine") / F.max("mine").over(Window.partitionBy("p"))))
        e = written(e.select("k", "p", "k1", "p1", "s1", "k2", "p2", "s2", "apart", "near", F.col("y").alias("x"), F.abs(F.col("y") - F.col("x")).alias("moved")), "edges")
        discard(edges)
        edges, most = e, e.agg(F.max("moved")).first()[0]
        if most is None or most <= epsilon:
            break
    else:
        raise RuntimeError(f"propagation still moves by {most} after {rounds} rounds")
    order = Window.partitionBy("p").orderBy(F.desc("x"), F.asc_nulls_last("apart"), "k")
    return edges.withColumn("_n", F.row_number().over(order)).where((F.col("_n") == 1) & (F.col("x") >= least)).select("k", "p", F.round("x", 4).alias("confidence"))
