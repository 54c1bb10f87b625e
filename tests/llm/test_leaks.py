import random

import pytest

from tapelight.llm import leaks

ITEM = "Judge whether the sleepy bettor near Łódź dome crossed 858 cents of muted ticket while nobody openly froze Naïve O’Brien after midnight"


@pytest.mark.parametrize(
    "text",
    [
        ITEM, ITEM.upper(), ITEM.replace(" ", "\n  "), ITEM.replace("Łódź", "Lodz").replace("ï", "i"), f"<p>x <b>{ITEM}</b></p>", ITEM.replace("whether", "whe-\nther"), ITEM.replace("bettor", "bet­tor​"),
        ITEM.replace("’", "&#8217;").replace("é", "&eacute;"), "noise before. " * 500 + ITEM + " noise after" * 500, ITEM.replace(" ", ", "),
    ],
)
def test_spellings_do_not_matter(text):
    assert leaks.Tables([(1, ITEM)]).search(text) == {1}


def test_eleven_words_are_not_twelve():
    w = ITEM.split()
    assert leaks.Tables([(1, ITEM)]).search("zz " + " ".join(w[:11]) + " zz") == set()
    assert leaks.Tables([(1, ITEM)]).search("zz " + " ".join(w[:12]) + " zz") == {1}
    # a longer word at the edge isn't the word
    assert leaks.Tables([(1, ITEM)]).search("xx" + " ".join(w[:12]) + "yy") == set()


def test_against_brute_force():
    r = random.Random(2)
    vocab = [f"w{k}" for k in range(12)]
    items = [(i, " ".join(r.choices(vocab, k=r.randrange(3, 12)))) for i in range(25)]
    t = leaks.Tables(items, words=4)
    for _ in range(60):
        doc = r.choices(vocab, k=r.randrange(0, 60))
        grams = {tuple(doc[k : k + 4]) for k in range(len(doc) - 3)}
        want = {i for i, x in items if any(tuple(x.split()[k : k + 4]) in grams for k in range(len(x.split()) - 3))}
        got = t.search(" ".join(doc))
        assert want <= got
        # run-together letters may only add what reads the same without its gaps
        assert all("".join(x.split()) for i, x in items if i in got)


def test_frame_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, ITEM, "x"), (2, None, "x"), (3, "", "x"), (4, "word", "x"), (None, ITEM, "x"), (5, ITEM + " " + ITEM, "x")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(7, ITEM), (8, ITEM), (9, None), (10, "short one")], "item_id bigint, text string")
    assert {tuple(r) for r in leaks.leaked(docs, items).collect()} == {(1, 7), (1, 8), (5, 7), (5, 8)}
    assert leaks.leaked(docs.where("false"), items).count() == 0
    assert leaks.leaked(docs, items.where("false")).count() == 0
    # more items than a block holds are searched block after block
    assert sorted(tuple(r) for r in leaks.leaked(docs, items, block=1).collect()) == [(1, 7), (1, 8), (5, 7), (5, 8)]
