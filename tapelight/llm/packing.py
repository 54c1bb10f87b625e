"""Filling fixed-capacity containers with texts: histogram packing by non-negative least squares.

Texts are measured in tokens. Only the histogram of lengths is needed to
plan: it has at most ``capacity`` bins whatever the data's size. Combinations
of one to ``depth`` lengths that fill a container to within a window are the
columns of a non-negative least-squares problem whose unknowns are how often
each is used. All of them take part: they are enumerated implicitly, by
(max, +) sums over lengths that name, for every length, the combination with
the steepest descent. Columns so named join the sparse problem until none of
all combinations can lower the residual by more than ``tolerance`` of it, so
the solution is measured against the whole enumeration, and memory is that of
the few thousand columns in use. Repeat counts are rounded against what is
left, and the residuals are packed greedily (longest first, each time the
longest that still fits), again on counts.

Rows never move for planning: an item's number within its length (counts per
input partition and length, prefixed over partitions) finds its container in
the plan by binary search. No task holds all items of a length, however many
share one.

Defined results: null and empty texts measure nothing and get no container;
a text longer than ``capacity`` is split into full pieces and a rest, the
only case of splitting; repeated texts are items of their own. Nothing is cut
but the depth of a combination and its window (the method's parameters); what
no combination covers is packed by the greedy pass.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapelight.session import written

# Fixed value: how the byte-level vocabularies split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = -1e18


def nnls(columns: np.ndarray, rows: int, weight: np.ndarray, b: np.ndarray, start: np.ndarray, tolerance: float = 1e-4) -> np.ndarray:
    """Minimise ||W(Ax - b)||^2 over x >= 0 by accelerated projected gradient steps with restarts, until the duality gap is at most ``tolerance`` of ||Wb||^2.

    A is sparse: column j counts the rows named in ``columns[j]``, ``rows`` stands for none.
    """
    w2, target = np.append(weight * weight, 0.0), np.append(b, 0.0)
    times = lambda x: np.bincount(columns.ravel(), np.repeat(x, columns.shape[1]), rows + 1)
    back = lambda r: r[columns].sum(axis=1)
    # unknowns are scaled by their own curvature, so that short lengths move as fast as long ones
    own = np.sqrt(back(w2)) + 1e-300
    v = np.ones(len(columns))
    for _ in range(20):
        v = back(w2 * times(v / own)) / own
        v /= np.linalg.norm(v) or 1
    step = 1 / max(1e-12, float(np.linalg.norm(back(w2 * times(v / own)) / own)) * 1.05)
    most, whole = float((weight * b).sum()), float((w2 * target * target).sum()) or 1.0
    x = y = start * own
    t, k = 1.0, 0
    while True:
        slope = back(w2 * (times(y / own) - target)) / own
        z = np.maximum(0, y - step * slope)
        k += 1
        if k % 10 == 0:
            at = back(w2 * (times(z / own) - target))
            if max(0.0, -float(at.min())) * most + max(0.0, float(at @ (z / own))) <= tolerance * whole:
                return z / own
        if float((y - z) @ (z - x)) > 0:
            t = 1.0
        n = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = z + (t - 1) / n * (z - x)
        x, t = z, n


def steepest(gain: np.ndarray, lengths: np.ndarray, capacity: int, window: int, depth: int) -> list[tuple[float, tuple[int, ...]]]:
    """For every length the combination with it of greatest summed gain among all of up to ``depth`` lengths whose sum lies in [capacity - window, capacity]."""
    best = np.full(capacity + 1, _NONE)  # best[s]: greatest gain of up to k lengths with sum s
    best[0] = 0.0
    layers, picks = [best], []
    for _ in range(depth - 1):
        prev, best = layers[-1], layers[-1].copy()  # fewer items are combinations too
        pick = np.zeros(capacity + 1, dtype=np.int32)
        for n in lengths:
            got = prev[: capacity + 1 - n] + gain[n]
            better = got > best[n:]
            best[n:][better] = got[better]
            pick[n:][better] = n
        layers.append(best)
        picks.append(pick)
    out = []
    for n in lengths:
        lo = max(0, capacity - window - n)
        if lo > capacity - n:
            continue
        s = lo + int(np.argmax(layers[-1][lo : capacity - n + 1]))
        if layers[-1][s] <= _NONE / 2:
            continue
        total, shape = float(layers[-1][s] + gain[n]), [int(n)]
        for pick in picks[::-1]:
            if pick[s]:
                shape.append(int(pick[s]))
                s -= int(pick[s])
        out.append((total, tuple(sorted(shape))))
    return out


def repeats(counts: dict[int, int], capacity: int, window: int, depth: int, tolerance: float) -> tuple[list[tuple[int, ...]], np.ndarray, float]:
    """(combinations, how often each, remaining share of the residual that any combination could still take) of the least-squares solution."""
    lengths = np.array(sorted(counts))
    row = np.full(capacity + 1, len(lengths))
    row[lengths] = np.arange(len(lengths))
    # residuals of long items cost room, those of short ones fill gaps: rows weigh by length
    weight, b = lengths / capacity, np.array([counts[n] for n in lengths], dtype=float)
    most = float((weight * b).sum())  # containers, if all were full: no solution's repeats add up to more than about that
    shapes: list[tuple[int, ...]] = []
    x, left = np.zeros(0), 1.0
    known: set[tuple[int, ...]] = set()
    while True:
        columns = np.array([[*row[list(c)], *[len(lengths)] * (depth - len(c))] for c in shapes], dtype=np.int64).reshape(-1, depth)
        if len(shapes):
            x = nnls(columns, len(lengths), weight, b, x, max(tolerance / 2, left / 10))  # no finer than the combinations not yet in it need
        r = b - np.bincount(columns.ravel(), np.repeat(x, depth), len(lengths) + 1)[:-1]
        gain = np.full(capacity + 1, _NONE)
        gain[lengths] = weight * weight * r
        named = steepest(gain, lengths, capacity, window, depth)
        left = max((g for g, _ in named), default=0.0) * most / max(1e-300, float((weight * weight * b * b).sum()))
        fresh = {c for g, c in named if g > 0} - known
        if left <= tolerance or not fresh:
            return shapes, x, max(0.0, left)
        used = x > 0
        shapes = [c for c, u in zip(shapes, used) if u] + sorted(fresh)
        x = np.concatenate([x[used], np.zeros(len(fresh))])
        known = set(shapes)


def greedy(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Containers filled one kind after another: longest item first, each time the longest that still fits."""
    left, out = {n: c for n, c in counts.items() if c > 0}, []
    have = sorted(left)
    while have:
        room, picked, used = capacity, [], {}
        upto = len(have)
        while True:
            k = bisect.bisect_right(have, room, 0, upto) - 1
            while k >= 0 and left[have[k]] <= used.get(have[k], 0):
                k -= 1
            if k < 0:
                break
            n = have[k]
            take = min(room // n, left[n] - used.get(n, 0))
            picked += [n] * take
            used[n] = used.get(n, 0) + take
            room -= n * take
            upto = k + 1
        times = min(left[n] // u for n, u in used.items())
        out.append((tuple(sorted(picked)), times))
        for n, u in used.items():
            left[n] -= u * times
            if not left[n]:
                del left[n]
                have.pop(bisect.bisect_left(have, n))
    return out


def plan(histogram: dict[int, int], capacity: int = 2048, window: int = 2, depth: int = 3, tolerance: float = 1e-3) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a container, repeats)] that uses every item of the histogram once.

    Where few combinations fill a container (lengths far apart), packing all items greedily can need fewer containers; then that is the plan.
    """
    left = {n: c for n, c in histogram.items() if 0 < n <= capacity and c > 0}
    out: list[tuple[tuple[int, ...], int]] = []
    if left.get(capacity):
        out.append(((capacity,), left.pop(capacity)))
    if left:
        shapes, x, _ = repeats(left, capacity, window, depth, tolerance)
        for j in np.argsort(-x, kind="stable"):
            c = shapes[int(j)]
            k = min([int(x[j] + 0.5)] + [left.get(n, 0) // c.count(n) for n in set(c)])
            if k > 0:
                out.append((c, k))
                for n in c:
                    left[n] -= k
        out += greedy(left, capacity)
        alone = greedy({n: c for n, c in histogram.items() if 0 < n <= capacity and c > 0}, capacity)
        out = min(out, alone, key=lambda made: sum(k for _, k in made))
    return out


def slots(made: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[list[int], list[tuple[int, int, int]]]]:
    """Per length: the first item numbers of its runs, and each run's (first container, items per container, position)."""
    out: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
    used: dict[int, int] = {}
    first = 0
    for shape, repeats in made:
        for n in sorted(set(shape)):
            m = shape.count(n)
            starts, runs = out.setdefault(n, ([], []))
            starts.append(used.get(n, 0))
            runs.append((first, m, shape.index(n)))
            used[n] = used.get(n, 0) + m * repeats
        first += repeats
    return out


_BETWEEN = re.compile(r"\s \s|\s\s\Z")


class _Counts(dict):
    """Tokens of a blank and a word, each asked for once; at most ``most`` words are remembered."""

    def __init__(self, count: Callable[[str], int], most: int = 500_000):
        super().__init__()
        self.count, self.most = count, most

    def __missing__(self, word: str) -> int:
        n = self.count(f" {word}")
        if len(self) < self.most:
            self[word] = n
        return n


def counter(tokenizer: str) -> Callable[[list[str]], list[int]]:
    """Texts to their numbers of tokens, for a tokenizer file (ranks in ``.tiktoken``, else the tokenizers library's JSON).

    The byte-level pattern starts a new piece at every blank with no blank on
    both sides, so there a text's tokens are the sum over its words.
    """
    if not tokenizer.endswith(".tiktoken"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    import base64

    import tiktoken

    with open(tokenizer, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    known = _Counts(lambda x: len(encode(x)))

    def count(text: str) -> int:
        if _BETWEEN.search(text):
            return len(encode(text))
        first, *rest = text.split(" ")
        return len(encode(first)) + sum(map(known.__getitem__, rest))

    return lambda texts: list(map(count, texts))


def measured(documents: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """(doc_id, piece, length): whole texts in tokens of the tokenizer file, split only beyond ``capacity``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = counter(tokenizer)
        for b in batches:
            rows = []
            for at in range(0, len(b), 64):
                part = b.iloc[at : at + 64]
                for d, n in zip(part["doc_id"], tokens(list(part["text"]))):
                    rows += [(d, k, min(capacity, n - k * capacity)) for k in range((n + capacity - 1) // capacity)]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "length"]).astype({"doc_id": "int64", "piece": "int32", "length": "int32"})

    return documents.where(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "text").mapInPandas(run, "doc_id bigint, piece int, length int")


def packed(documents: DataFrame, tokenizer: str, capacity: int = 2048, window: int = 2, depth: int = 3) -> DataFrame:
    """(doc_id, piece, length, container) for every text or piece of one."""
    spark = documents.sparkSession
    items = measured(documents, tokenizer, capacity).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    items = written(items, "items")
    counts = items.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    table = spark.sparkContext.broadcast(slots(plan(histogram, capacity, window, depth)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "length", "base")
    within = Window.partitionBy("part", "length").orderBy("at")
    numbered = items.withColumn("k", F.row_number().over(within) - 1).join(base, ["part", "length"]).select("doc_id", "piece", "length", (F.col("base") + F.col("k")).alias("k"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = table.value
        for b in batches:
            where = []
            for n, k in zip(b["length"], b["k"]):
                starts, runs = t[n]
                j = bisect.bisect_right(starts, k) - 1
                first, m, _ = runs[j]
                where.append(first + (k - starts[j]) // m)
            yield b[["doc_id", "piece", "length"]].assign(container=pd.Series(where, dtype="int64", index=b.index))

    return numbered.mapInPandas(run, "doc_id bigint, piece int, length int, container bigint")
