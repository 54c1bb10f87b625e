import bisect
import itertools
import random

import numpy as np
import pytest

from tapelight.llm import packing
from tapelight.llm.queries import TOKENIZERS


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_item_once(seed):
    r = random.Random(seed)
    h = {r.randrange(1, 101): r.randrange(1, 60) for _ in range(50)}
    used: dict[int, int] = {}
    made = packing.plan(h, capacity=100, window=4)
    for shape, k in made:
        assert sum(shape) <= 100 and k > 0
        for n in shape:
            used[n] = used.get(n, 0) + k
    assert used == {n: c for n, c in h.items() if c}
    # no packing beats the total, nor shares a container between two items over half of it
    bound = max(-(-sum(n * c for n, c in h.items()) // 100), sum(c for n, c in h.items() if n > 50))
    assert sum(k for _, k in made) <= 1.1 * bound + 1


def test_edge_histograms():
    assert packing.plan({}) == []
    assert packing.plan({2048: 3}) == [((2048,), 3)]
    assert sum(k for _, k in packing.plan({1500: 10})) == 10
    assert sum(k for _, k in packing.plan({1: 4096})) == 2


def test_nnls_finds_the_solution():
    columns = np.array([[0, 1, 4], [1, 2, 4], [0, 0, 3], [2, 3, 4], [1, 1, 1]])  # 4 stands for none
    a = np.zeros((4, 5))
    for j, c in enumerate(columns):
        for i in c[c < 4]:
            a[i, j] += 1
    x = np.array([0, 1.5, 0, 2, 0.3])
    got = packing.nnls(columns, 4, np.array([1.0, 0.5, 0.2, 0.1]), a @ x, np.zeros(5), 1e-13)
    assert np.allclose(a @ got, a @ x, atol=1e-3) and (got >= 0).all()


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_steepest_is_the_best_of_all_combinations(depth):
    r = random.Random(depth)
    lengths = sorted(r.sample(range(1, 41), 12))
    gain = np.full(41, packing._NONE)
    gain[lengths] = [r.uniform(-1, 2) for _ in lengths]
    all_of = [c for k in range(1, depth + 1) for c in itertools.combinations_with_replacement(lengths, k) if 36 <= sum(c) <= 40]
    want = {n: max(sum(gain[x] for x in c) for c in all_of if n in c) for n in lengths if any(n in c for c in all_of)}
    named = packing.steepest(gain, np.array(lengths), 40, 4, depth)
    assert sorted(round(g, 9) for g, _ in named) == sorted(round(g, 9) for g in want.values())
    assert all(c in all_of and abs(sum(gain[x] for x in c) - g) < 1e-9 for g, c in named)


def test_solution_is_measured_against_every_combination():
    r = random.Random(7)
    counts = {n: r.randrange(1, 50) for n in range(5, 100, 3)}
    shapes, x, left = packing.repeats(counts, 100, 4, 3, 1e-4)
    assert left <= 1e-4
    all_of = [c for k in (1, 2, 3) for c in itertools.combinations_with_replacement(counts, k) if 96 <= sum(c) <= 100]
    over = lambda cs, xs: sum((n / 100 * (counts[n] - sum(c.count(n) * k for c, k in zip(cs, xs)))) ** 2 for n in counts)
    row = {n: k for k, n in enumerate(counts)}
    columns = np.array([[*[row[n] for n in c], *[len(row)] * (3 - len(c))] for c in all_of])
    best = packing.nnls(columns, len(row), np.array([n / 100 for n in counts]), np.array([float(c) for c in counts.values()]), np.zeros(len(all_of)), 1e-6)
    assert over(shapes, x) - over(all_of, best) <= 3e-4 * sum((n / 100 * c) ** 2 for n, c in counts.items())


def test_large_capacity():
    r = random.Random(2)
    h = {r.randrange(20, 8193): r.randrange(1, 90) for _ in range(250)} | {n: 40 for n in range(1, 20)}
    made = packing.plan(h, capacity=8192)
    used: dict[int, int] = {}
    for shape, k in made:
        assert sum(shape) <= 8192
        for n in shape:
            used[n] = used.get(n, 0) + k
    assert used == h
    free: list[int] = []  # best fit, longest first
    for n in sorted((n for n, c in h.items() for _ in range(c)), reverse=True):
        k = bisect.bisect_left(free, n)
        bisect.insort(free, (free.pop(k) if k < len(free) else 8192) - n)
    assert sum(k for _, k in made) <= 1.001 * len(free)


def test_token_counts_by_word_are_those_of_whole_texts():
    from tokenizers import Tokenizer

    r = random.Random(4)
    bits = ["fight", "night's", " ", "  ", "\n", "\t", "\u00a0", "35¢", "não", "комиссия", "…", "a", "1234", "!?", " \n ", "\r\n", "日本"]
    texts = ["".join(r.choices(bits, k=r.randrange(1, 30))) for _ in range(3000)]
    whole = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    assert packing.counter(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")(texts) == [len(e.ids) for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert packing.counter(f"{TOKENIZERS}/byte_bpe_50k.json")(["a b", " "]) == [2, 1]


def test_frame(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["fight"] * r.choice([1, 5, 300, 900, 2047, 2048, 2049, 5000])), "x") for i in range(80)] + [(900, None, "x"), (901, "", "x"), (902, " ", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, part string").repartition(3)
    out = packing.packed(docs, f"{TOKENIZERS}/byte_bpe_50k.json").toPandas()
    assert out.groupby("container")["length"].sum().max() <= 2048
    assert not out.duplicated(["doc_id", "piece"]).any() and set(out.doc_id) == set(range(80)) | {902}
    # only longer texts are split, into full pieces and a rest
    for d, g in out.groupby("doc_id"):
        assert len(g) == 1 or (g.length.sort_values(ascending=False).iloc[:-1] == 2048).all()
    assert packing.packed(docs.where("false"), f"{TOKENIZERS}/byte_bpe_50k.json").count() == 0
