import pytest

from tapelight.llm import linkage

SCHEMA = "id string, lists array<array<string>>, titles array<string>, days array<bigint>"


@pytest.mark.parametrize(
    "title,want",
    [("Will A B beat C D on Feb 1?", ["A B", "C D"]), ("Who wins: X or Y Z?", ["X", "Y Z"]), ("MMA night: Q against R", ["Q", "R"]), ("K vs. L", ["K", "L"]), (None, []), ("nothing here", [])],
)
def test_titles(title, want):
    assert linkage.names_in(title) == want


@pytest.mark.parametrize(
    "a,b,least", [("Jaga Deindehares", 'Jaga "Iron Tide" Deindehares', 0.99), ("Zhuho Chuldim", "Chuldim, Zhuho", 0.99), ("Grebur Staishinho", "G. Staishinho", 0.8), ("Sizhic Hairtedo", "Szihic  Hayrtedo", 0.75), ("Diskus Dumakyev-Nekazenko", "dumakievnekazenko", 0.8), ("Yitar van Daisheng", "vanDaisheng", 0.9)]
)
def test_spellings(a, b, least):
    assert linkage.name_alike(linkage.tokens(a), linkage.tokens(b)) >= least


def test_strangers():
    assert linkage.name_alike(linkage.tokens("Khugaly Zildanicz"), linkage.tokens("Tawel Stoyopholt")) < 0.3


def test_link(spark):
    k = [
        ("k1", [["Vagio Feimohbek", "Griziko Zhaiskyev"]], None, [100]), ("k2", [["Vagio Feimohbek", "Griziko Zhaiskyev"]], None, [300]), ("k3", [["Kriska Kayzhagak", "Tralman Layidberg"]], None, [100]),
        ("k4", [["Drurur Foudumeng"]], ["Will Drurur Foudumeng beat Chilur Yusong on Mar 18?"], [120]), ("k5", None, None, None), ("k3", [["Kriska Kayzhagak", "Tralman Layidberg"]], None, [100]),
    ]
    p = [
        ("p1", [["Zhaiskyev, Griziko", "V. Feimohbek"]], None, [101]), ("p2", [["Feimohbek", "Zhaiskyev"]], None, [299]), ("p3", [None, ["Yes", "No"]], ["Who wins: Foudumeng or Yusong?"], [120]), ("p4", [["Nobody Known", "Some Other"]], None, [100]),
        ("p5", [["Kayzhagak", "Layidberg"]], None, [200]), ("p6", [["KRISKA KAYZHAGAK", "Tralman Laydberg"]], None, []), ("p7", [[None, ""]], [None], None), ("p8", [["Layidberg", "Kayzhagak"]], None, [99]),
    ]
    left, right = spark.createDataFrame(k, SCHEMA), spark.createDataFrame(p, SCHEMA)
    got = {(r.k, r.p): r.confidence for r in linkage.link(linkage.bouts(left, 1, 21), linkage.bouts(right, 0)).collect()}
    assert set(got) == {("k1", "p1"), ("k2", "p2"), ("k4", "p3"), ("k3", "p6"), ("k3", "p8")}
    assert all(0.5 <= c <= 1 for c in got.values())
    none = linkage.link(linkage.bouts(left.where("false"), 1), linkage.bouts(right, 0))
    assert none.count() == 0


def test_rare_names_weigh_more_and_propagation_ends_or_fails(spark):
    import math

    schema = "id string, names array<string>, days array<bigint>, attrs array<struct<part:string,at:string>>"
    side = lambda rows: spark.createDataFrame([(i, ["anna", "bert"], [1], attrs) for i, attrs in rows], schema)
    left = side([("k1", [("x", "1"), ("x", "2"), ("y", "1")]), ("k2", [("y", "1")]), ("k3", [("y", "9")])])
    right = side([("p1", [("x", "1"), ("x", "2"), ("y", "1")]), ("p2", [("y", "9")])])
    got = {(r.k, r.p): r.weight for r in linkage.candidates(left, right).collect()}
    # five bouts: two have x, all have y; x counts once though it is shared at two times
    assert got[("k1", "p1")] == pytest.approx(math.log(5 / 2) + math.log(5 / 5))
    # k2 shares only what everyone has: pruned by p1's mean, kept by its own
    assert got[("k2", "p1")] == pytest.approx(0) and got[("k3", "p2")] == pytest.approx(0)
    with pytest.raises(RuntimeError, match="propagation"):
        linkage.link(left, right, epsilon=-1.0, rounds=2)


def test_moved_bouts_and_rematches(spark):
    k = [("k1", [["Vagio Feimohbek", "Griziko Zhaiskyev"]], None, [100]), ("k2", [["Vagio Feimohbek", "Griziko Zhaiskyev"]], None, [160]), ("k3", [["Kriska Kayzhagak", "Tralman Layidberg"]], None, [100])]
    p = [
        ("p2", [["Zhaiskyev", "Vagio Feimohbek"]], None, [114]), ("p3", [["Griziko Zhaiskyev", "Feimohbek"]], None, [160]),
        ("p4", [["Kriska Kayzhagak", "Tralman Layidberg"]], None, [135]), ("p5", [["Kriska Kaizhagak", "Tralman Layidberg"]], None, [93]),
    ]
    left, right = spark.createDataFrame(k, SCHEMA), spark.createDataFrame(p, SCHEMA)
    got = {(r.k, r.p) for r in linkage.link(linkage.bouts(left, 1, 21), linkage.bouts(right, 0)).collect()}
    assert got == {("k1", "p2"), ("k2", "p3"), ("k3", "p5")}


def test_neighbours_lift_an_edge_but_not_itself(spark):
    # the same two spellings meet twice; a third market has them once
    rows = [("k1", [["Anna Berghold", "Clara Dumont"]], None, [10]), ("k2", [["Anna Berghold", "Clara Dumont"]], None, [200]), ("k3", [["Frida Gallert", "Hanna Ismold"]], None, [10])]
    other = [("p1", [["Ana Bergholt", "Clara Dumond"]], None, [10]), ("p2", [["Ana Bergholt", "Clara Dumond"]], None, [200]), ("p3", [["Frieda Gallertt", "Hana Ismold"]], None, [10])]
    left, right = (linkage.bouts(spark.createDataFrame(x, SCHEMA), n) for x, n in ((rows, 1), (other, 0)))
    twice = {(r.k, r.p): r.confidence for r in linkage.link(left, right).collect()}
    plain = {(r.k, r.p): r.confidence for r in linkage.link(left, right, pull=0.0).collect()}
    assert twice[("k1", "p1")] > plain[("k1", "p1")] and twice[("k2", "p2")] > plain[("k2", "p2")]
    assert twice[("k3", "p3")] == plain[("k3", "p3")]
