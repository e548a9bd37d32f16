import unicodedata

from pyspark.sql import functions as F

from sievemark.llm.lookalike import Canonizer, Trie, canonical_texts, choose, look_classes, same_look_pairs, skeleton, special_characters, table_form

SAME = [
    ("pH", "рН"), ("NaOH", "ＮａＯＨ"), ("KMnO4", "Κ​МnΟ4"), ("zhǐ", "zhǐ"), ("工", "⼯"), ("不", "不"), ("a b", "a　b"), ("a b", "a\xa0b"),
    ("3℃", "3°C"), ("（a）", "(a)"), ("。", "｡"), ("5", "­5"), ("x", "x︀"), ("μL", "µL"), ("が", "が"), ("が", "ｶﾞ".replace("ｶﾞ", "が")), ("见", "⻅"), ("IV", "Ⅳ"), ("a\n", "a "),
]
APART = [("pH", "PH"), ("CO2", "CO²"), ("CO2", "CO₂"), ("1", "①"), ("1", "l"), ("0", "O"), ("a b", "ab"), ("a b", "a\nb"), ("，", "。"), ("", " "), ("½", "1/2")]


def tool():
    return Canonizer(special_characters())


def test_same_and_apart():
    t = tool()
    for a, b in SAME:
        assert t.text(a) == t.text(b), (a, b)
    for a, b in APART:
        assert t.text(a) != t.text(b), (a, b)
    assert t.text(None) is None and t.text("") == "" and t.text("\u200b\u2060") == ""


def test_words_are_chosen_by_frequency():
    # kappa and the Cyrillic ka are look-alikes in some fonts only: taken for a letter where that makes a common word
    got = choose([("kg", 60), ("κg", 3), ("к\u200bg", 2), ("ｋg", 4)])
    assert got == {"kg": "kg", "κg": "kg", "к\u200bg": "kg", "ｋg": "kg"}
    assert choose([("kg", 20), ("κg", 3)])["κg"] == "κg"  # not ten times as frequent
    assert choose([("k", 900), ("κ", 3)])["κ"] == "κ"  # a single letter says too little
    assert choose([("κιλο", 500), ("kιλο", 2)])["kιλο"] == table_form("κιλο")  # the other way round
    assert choose([("kk", 3000), ("кk", 200), ("ккк", 1)])["кk"] == "kk"
    assert len({skeleton(x) for x in ("kg", "κg", "к\u200bg", "ｋg")}) == 1 and choose([]) == {}
    for got in (choose([("nn", 5000), ("nп", 300), ("пп", 20)]),):
        assert set(got.values()) == {"nn"}


def test_canonical_is_stable():
    t = tool()
    for a, b in SAME + APART:
        for x in (a, b):
            assert t.text(t.text(x)) == t.text(x) and unicodedata.is_normalized("NFC", t.text(x))


def test_automaton():
    t = Trie()
    for w, n in (("cat", 2), ("cart", 1), ("car", 9)):
        t.add(w, n)
    assert t.match("cаt") == "cat" and t.match("c​at") == "cat" and t.match("cet") is None
    assert t.match("cet", 1) == "cat" and t.match("caat", 1) == "cat" and t.match("ct", 1) == "cat" and t.match("ca", 1) == "car" and t.match("dog", 1) is None
    assert t.match("", 3) == "car"
    assert sorted(w for _, _, w in t.reach("сar", 1.0)) == ["car", "cart", "cat"] and t.reach("dog") == []
    k = Trie()
    k.add("kg", 5)
    assert k.reach("κg", 0.3) == [(0.3, 5, "kg")] and k.reach("κg", 0.2) == []


def test_long_text():
    assert tool().text("Ｎ​" * 500_000) == "N" * 500_000


def test_pairs(spark):
    rows = [("a", "pH 为5"), ("b", "рН　为５"), ("c", "pH 为5"), ("d", "PH 为5"), ("e", None), ("f", ""), ("g", "​"), (None, "рН 为5"), ("b", "рН　为５")]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "id string, name string, look int, raw int")
    got = {tuple(r) for r in same_look_pairs(canonical_texts(df.where("id is not null"), ["id"], ["name"]), "id").collect()}
    assert got == {("name", "a", "b"), ("name", "b", "c"), ("name", "f", "g")}
    assert same_look_pairs(canonical_texts(df.limit(0), ["id"], ["name"]), "id").count() == 0


def test_pairs_beyond_the_table(spark):
    rows = [(f"k{i}", f"质量 {i} kg") for i in range(40)] + [("x1", "称取 κg"), ("x2", "称取 kg"), ("x3", "称取 ｋg"), ("x4", "κ 常数"), ("x5", "k 常数"), ("x6", "Κg")]
    df = spark.createDataFrame(rows, "id string, name string").repartition(5)
    got = {tuple(r) for r in same_look_pairs(canonical_texts(df, ["id"], ["name"]), "id").collect()}
    assert got == {("name", "x1", "x2"), ("name", "x1", "x3"), ("name", "x2", "x3")}
    seen = {r.id: r.canonical for r in canonical_texts(df, ["id"], ["name"]).collect()}
    assert seen["x1"] == "称取 kg" and seen["x4"] == "κ 常数" and seen["x6"] == "Kg" and len(seen) == len(rows)


def test_classes_against_pairs(spark):
    rows = [("a", "рН"), ("b", "pH"), ("c", "pH"), ("d", "PH"), ("e", None), ("f", ""), ("b", "pH")]
    df = spark.createDataFrame([(k, t, "z") for k, t in rows], "id string, name string, class_id string")
    got = {tuple(r) for r in look_classes(canonical_texts(df, ["id"], ["name"]), "id").collect()}
    assert got == {("name", "a", "a", 3, 2), ("name", "b", "a", 3, 2), ("name", "c", "a", 3, 2), ("name", "d", "d", 1, 1), ("name", "f", "f", 1, 1)}
    assert look_classes(canonical_texts(df.where(F.lit(False)), ["id"], ["name"]), "id").count() == 0
