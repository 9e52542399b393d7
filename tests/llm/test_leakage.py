import random

import pytest

from tidegrid.llm.leakage import leaked_items
from tidegrid.llm.normalise import words

ITEMS = {
    1: "Nobody describes the distant teacher when the anchor draws Pudil. In 527 the glove of Brornu carries a garden behind the narrow lamp.",
    2: "Which of these holds? Our planet is orange, yet their drawer follows it. What the tank lifts, the cliff joins carefully.",
    3: "Die süße Küche zerstört die Werkstatt über die schöne Fenster. Wenn die Brücke 404 Mal fährt, bleibt Zenlil bei der tägliche Zug.",
    4: "Between 639 and 641, one pipe cleans the quarry before another notebook. It takes 1804 days until the shelf marks that slim coast.",
}
NOISE = "The plain folder waters every basin. Some cradle of loud velvet stands inside the mill and nobody there sells old paper boats to strangers from Holm. "


def found(spark, docs, items=None, **kw):
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id BIGINT, text STRING, at STRING, item_id STRING")
    e = spark.createDataFrame([(i, t, "q") for i, t in (ITEMS if items is None else items).items()], "item_id BIGINT, text STRING, h STRING")
    return {(r.item_id, r.doc_id): r for r in leaked_items(d, e, **kw).collect()}


def test_altered_wordings_are_found(spark):
    a, b, c = ITEMS[1], ITEMS[2], ITEMS[3]
    cut = a.split(". ")
    docs = [
        (1, NOISE + a + NOISE), (2, NOISE + a.upper()), (3, a.replace(" ", "\n  ").replace(",", ";")), (4, b.replace("o", "о").replace("a", "а")),
        (5, c.encode().decode("cp1252", "replace")), (6, "".join(x + "​" for x in b)), (7, a.replace("distant", "nearby").replace("lamp", "lmap")),
        (8, cut[0] + ".\nAdvert: new shoes for the whole family today\n" + cut[1]), (9, " ".join(a.split()[:14])), (10, c.replace("ü", "ue") if False else c.replace("ü", "ü")),
        (12, NOISE + c.replace("ü", "\ufffd").replace("ö", "\ufffd").replace("tägl", "t\ufffdg\ufffdl")), (13, b.replace("a", "\ufffd").replace("ir", "i\ufffdr")),
        (11, b.replace("'", "&#39;").replace(" ", "&nbsp;")),
    ]
    assert set(found(spark, docs)) == {(1, 1), (1, 2), (1, 3), (2, 4), (3, 5), (2, 6), (1, 7), (1, 8), (1, 9), (3, 10), (2, 11), (3, 12), (2, 13)}


def test_little_or_shuffled_wording_is_no_case(spark):
    rng = random.Random(1)
    mixed = ITEMS[1].split()
    rng.shuffle(mixed)
    docs = [(1, NOISE * 3), (2, " ".join(mixed)), (3, " ".join(ITEMS[1].split()[:6]) + " " + NOISE), (4, NOISE + ITEMS[4].split(". ")[0][:30])]
    assert found(spark, docs) == {}


def test_new_slots_are_reported_and_checked(spark):
    text = ITEMS[1].replace("Pudil", "Karmo").replace("527", "891")
    r = found(spark, [(1, NOISE + text), (2, NOISE * 2)])[1, 1]
    assert r.rebound == 2 and r.steady


def test_missing_empty_repeated_and_long(spark):
    items = {1: ITEMS[1], 5: None, 6: "", 7: "Two words"}
    docs = [(1, None), (2, ""), (None, ITEMS[1]), (3, ITEMS[1]), (3, ITEMS[1]), (4, NOISE * 2000 + ITEMS[1]), (5, "Two words"), (6, "퟿ ???? !!!!")]
    assert set(found(spark, docs, items)) == {(1, 3), (1, 4)}
    assert found(spark, [], items) == {} and found(spark, docs, {}) == {}


def test_one_lexicon_over_all_items(spark):
    """Words that two items share are plain in both, wherever the items lie; an item with its names and numbers filled anew is found."""
    pair = {1: "We saw Zorblax and Quimby near Velden with Arnau in Kester today.", 2: "They met Zorblax and Quimby at Velden where Arnau lost Kester again.", **{k + 10: t for k, t in ITEMS.items()}}
    docs = [(k, NOISE + t) for k, t in pair.items()]
    assert set(found(spark, docs, pair)) == {(k, k) for k in pair}


APPLES = "Alice bought 12 apples and 7 pears for 45 dollars in London before she sold 9 of the apples to Robert for 3 dollars each."


def test_a_question_with_new_parameters(spark):
    new = "Bruno bought 15 apples and 4 pears for 61 dollars in Madrid before she sold 8 of the apples to Martha for 2 dollars each."
    got = found(spark, [(1, NOISE + new + NOISE), *((k, NOISE * 2) for k in range(2, 30))], {1: APPLES})
    assert set(got) == {(1, 1)} and got[1, 1].steady and got[1, 1].rebound == 8


def test_unsteady_slots_do_not_count(spark):
    """A name that the item repeats must be filled alike each time."""
    item = "When Zorlax met Pimby at Kurdel then Zorlax gave Pimby a key and Pimby took Zorlax home with Pimby near Kurdel since Zorlax and Pimby wanted to stay."
    fill = lambda f: " ".join(f(w) for w in item.split())
    names = iter("Ada Bea Cleo Dora Eda Flora Gina Hana Ida Jana Kira Lina".split())
    steady, mixed = fill(lambda w: {"Zorlax": "Marok", "Pimby": "Tulda", "Kurdel": "Ostend"}.get(w, w)), fill(lambda w: next(names) if w in ("Zorlax", "Pimby", "Kurdel") else w)
    docs = [(1, steady), (2, mixed), *((k, NOISE * 2) for k in range(3, 30))]
    got = found(spark, docs, {1: item})
    assert (1, 1) in got and got[1, 1].steady and got[1, 1].share > 0.95
    assert (1, 2) not in got or (not got[1, 2].steady and got[1, 2].share < 0.85)


def test_common_windows_only(spark):
    """An item of phrases that every page uses has no rare window; it keeps them all."""
    item = "Nobody there sells old paper boats to strangers from Holm while the plain folder waters every basin."
    docs = [(k, NOISE) for k in range(1, 60)] + [(100, item)]
    assert (1, 100) in found(spark, docs, {1: item})


def test_half_an_item_without_its_names_is_a_case(spark):
    ws = ITEMS[4].split()
    half = " ".join(ws[6:18])  # one pipe ... before another notebook. It takes
    text = ITEMS[1].replace("Pudil", "Karmo").replace("527", "891").replace("Brornu", "Selvik")
    assert {(4, 1), (1, 2)} <= set(found(spark, [(1, NOISE + half + " " + NOISE), (2, text), *((k, NOISE * 2) for k in range(3, 40))]))


def test_scattered_changes_and_long_foreign_lines_are_found(spark):
    ws = ITEMS[1].split()
    every = " ".join("other" if k % 4 == 3 else w for k, w in enumerate(ws))  # no four known words in a row
    apart = " ".join(ws[:9]) + ".\n" + NOISE * 4 + "\n" + " ".join(ws[9:18])
    assert set(found(spark, [(1, every), (2, apart), (3, NOISE * 4)])) == {(1, 1), (1, 2)}


@pytest.mark.parametrize(("text", "want"), [("Straße", ["strasse"]), ("tÃ¤glich", ["taglich"]), ("a­b", ["ab"]), ("ＡＢ", ["ab"]), ("аpple", ["apple"]), ("", [])])
def test_folding(text, want):
    assert words(text) == want
