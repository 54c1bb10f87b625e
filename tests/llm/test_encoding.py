import random

import pytest
from pyspark.sql import functions as F

from tapelight.llm import encoding as E

PT = ["A decisão não saiu antes da última sessão.", "O câmbio não ajudou a média das praças.", "Três lançamentos à noite mudaram a cotação.", "O árbitro já sabia da diferença."]
EN = ["The clerk’s desk priced the 35¢ offer — or so the notes claim.", "“I don’t fade momentum,” the coach said…", "A £14 ticket in São Breno returned nothing.", "Nobody asked why the naïve fill went on."]
RU = ["Комиссия съела остаток прибыли.", "Судья остановил бой, но рынок уже всё знал.", "Разрыв между площадками закрылся."]


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    make = lambda base: [" ".join(r.choices(base, k=6)) + f" {r.randrange(999)}" for _ in range(400)]
    return E.fit({"pt": make(PT), "en": make(EN), "ru": make(RU)})


@pytest.mark.parametrize("enc", ["cp1252", "latin_1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850"])
@pytest.mark.parametrize("lang,texts", [("pt", PT), ("en", EN)])
def test_utf8_round_trip(model, enc, lang, texts):
    inverse = {b: c for c, b in E._table(enc).items()}
    for t in texts:
        if t.isascii():
            continue
        bad = "".join(inverse[b] for b in t.encode())
        hit, got, _ = E.affected(f"Clean start. {bad}", lang, model)
        assert hit and got == f"Clean start. {t}", (enc, bad)


def test_byte_mix_ups_and_double(model):
    t = "Судья остановил бой, но рынок уже всё знал."
    assert E.affected(t.encode("cp1251").decode("latin_1"), "ru", model)[:2] == (True, t)
    p = "A decisão não saiu antes da última sessão."
    assert E.affected(p.encode("cp1252").decode("mac_roman"), "pt", model)[:2] == (True, p)
    twice = p.encode().decode("latin_1").encode().decode("latin_1")
    assert E.affected(twice, "pt", model)[:2] == (True, p)


def test_clean_texts_stay(model):
    for lang, texts in (("pt", PT), ("en", EN), ("ru", RU), (None, PT + EN + RU)):
        for t in texts:
            assert E.affected(t, lang, model) == (False, t, None)
    assert E.affected("plain ascii " * 50_000, "en", model)[0] is False
    assert E.affected("CAMPEÃO OU NÃO, disse.", "pt", model)[0] is False


def test_mix_ups_of_unknown_language(model):
    # every wrong letter is a usual one of another language
    for lang in (None, "xx"):
        for t, rest in ((EN[3], EN[1]), (PT[3], PT[1])):
            bad = t.encode("cp1252").decode("cp1251")
            assert E.affected(f"{bad} {rest}", lang, model)[:2] == (True, f"{t} {rest}")
        assert E.affected(RU[1].encode("cp1251").decode("latin_1"), lang, model)[:2] == (True, RU[1])
        assert E.affected(f"{EN[0]} {RU[1]} {PT[0]}", lang, model)[:2] == (False, f"{EN[0]} {RU[1]} {PT[0]}")


@pytest.mark.parametrize("enc", ["cp1252", "latin_1", "cp437", "cp850", "mac_roman"])
@pytest.mark.parametrize(
    "text",
    [
        "審判は試合を止めたが、市場はすでにすべてを知っていた。両取引所の差は縮まった。", "أوقف الحكم المباراة لكن السوق كان يعرف كل شيء بالفعل وأغلقت الفجوة",
        "השופט עצר את הקרב אבל השוק כבר ידע הכול והפער בין הזירות נסגר", "ο διαιτητής σταμάτησε τον αγώνα αλλά η αγορά τα ήξερε ήδη όλα", "The desk wrote 中文 twice in its notes and moved on.",
    ],
)
def test_scripts_no_model_knows(model, enc, text):
    inverse = {b: c for c, b in E._table(enc).items()}
    bad = "".join(inverse[b] for b in text.encode())
    for lang in (None, "xx"):
        assert E.affected(bad, lang, model)[:2] == (True, text)
        assert E.affected(text, lang, model) == (False, text, None)


def test_lucky_decodings_stay(model):
    # an apostrophe and an accent that together are UTF-8 of a letter no text here has
    text = "L’été n’était pas à l’école."
    assert E.affected(text, "fr", E.fit({"fr": [f"{text} {k} fois." for k in range(500)]})) == (False, text, None)
    assert E.UTF8_COST > 0 and E.BYTES_COST > 0


def test_readings_are_all_pairs_once():
    got = dict((t[ord("ã")], c) for c, t in E.readings("ã"))
    want = set()
    for enc in E.READ_AS:
        for was in E.WAS_IN:
            try:
                want.add("ã".encode(enc).decode(was))
            except (UnicodeEncodeError, UnicodeDecodeError):
                pass
    assert set(got) == {w for w in want if w != "ã" and not "\x7f" <= w < "\xa0"}


def test_lost_characters_mark_a_text(model):
    assert E.affected("na �ltima sess�o", "pt", model)[:2] == (True, "na �ltima sess�o")


def test_frame(spark):
    rows = [(k, t, x, 1) for k, (t, x) in enumerate([(None, "en"), ("", None), ("abc", None)] + [(p + f" {k}", "pt") for k in range(300) for p in PT])]
    rows.append((9999, "A decisÃ£o nÃ£o saiu antes da Ãºltima sessÃ£o.", "pt", 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, affected int")
    out = E.repaired(docs, E.train(docs, sample=200))
    assert [(r.doc_id, r.restored) for r in out.where("affected").collect()] == [(9999, "A decisão não saiu antes da última sessão.")]
    empty = docs.where(F.lit(False))
    assert E.repaired(empty, E.train(empty)).count() == 0


def test_every_text_teaches(spark):
    # a letter in one text of eighty, and more text than a dictionary keeps: both come from all texts, whatever the groups
    r = random.Random(2)
    texts = [f"{' '.join(r.choices(PT, k=3))} {r.randrange(10**9)}{' Só o Łukasz sabia.' * (k % 80 == 7)}" for k in range(2000)]
    docs = spark.createDataFrame([(k, t, "pt") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    want = E.fit({"pt": texts}, size=3000)
    for sample in (30, 500, 5000):
        got = E.train(docs, sample=sample, size=3000)
        assert got.common == want.common and "Ł" in got.common["pt"] and got.dictionaries.keys() == {"pt"}
        assert sum(got.length(t, "pt") for t in texts) < 1.1 * sum(want.length(t, "pt") for t in texts)
    assert E.train(docs.repartition(7), sample=500, size=3000).dictionaries == E.train(docs, sample=500, size=3000).dictionaries


def test_sentences_of_a_mix_up_teach_nothing():
    clean, bad = "Sędzia przyznał punkty, różnica żadna.", "Sędzia przyznał punkty, różnica żadna.".encode("cp1250").decode("cp1252")
    m = E.fit({"pl": [f"{bad if k % 50 == 0 else clean} {k}" for k in range(2000)]})
    assert set(m.common["pl"]) == set("ęłóż") and E.affected(bad, "pl", m)[:2] == (True, clean) and not E.affected(clean, "pl", m)[0]
