"""Terms of a vocabulary in texts against the alternation pattern of a plain program."""

import collections
import re

import pytest

from marlstone.operators import news, terms, workbooks

TERMS = [("phosphate rock", "rock"), ("rock", "stone"), ("Rock", "music"), ("DAP", "dap"), ("$/t DAP", "price"), ("u.s. dap fob", "us"), ("acide sulfurique", "acid"), ("engrais d'été", "summer"), ("ok", "short"), ("a.b*c", "odd"),
         ("x\\Ey", "quoted"), ("--", "none"), ("dap dap", "twice"), ("unseen word", "never")]
TEXTS = [(1, "Phosphate rock, ROCK and phosphate  rock; (rock) rocks arock rock9 9rock"), (2, "DAP dap DAP $/t DAP u.s. dap fob; ok"), (3, "engrais d'été, Engrais D'ÉTÉ engrais d'étéx acide\nsulfurique acide sulfurique"), (4, None), (5, ""),
         (6, "a.b*c aXb*c x\\Ey -- unseen other word"), (7, "dap dap dap dap dap"), (8, "érock rocké")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(TEXTS, "article_id long, text string").repartition(3), spark.createDataFrame(TERMS, "term string, concept_id string")


def test_longest_terms_come_first(tables):
    kept = sorted({t.lower() for t, _ in TERMS if len(t) >= 3}, key=lambda t: (-len(t), t))
    pattern = re.compile("(?<![A-Za-z0-9])(" + "|".join(map(re.escape, kept)) + ")(?![A-Za-z0-9])", re.IGNORECASE)
    expected = collections.Counter()
    for article, text in TEXTS:
        for hit in pattern.findall(text or ""):
            for concept in {c for t, c in TERMS if t.lower() == hit.lower()}:
                expected[article, concept] += 1
    got = {(r["article_id"], r["concept_id"]): r["n"] for r in news.indexed_mentions(*tables).collect()}
    assert got == dict(expected) and got[1, "rock"] == 1 and got[2, "price"] == 1 and got[7, "twice"] == 2


def test_every_term_is_counted_by_itself(tables):
    expected = {}
    for article, text in TEXTS:
        for term in {t.lower() for t, _ in TERMS if len(t) >= 3 and re.search("[a-z0-9]", t.lower())}:
            n = len(re.findall("(?<![A-Za-z0-9])" + re.escape(term) + "(?![A-Za-z0-9])", text or "", re.IGNORECASE))
            if n:
                expected[article, term] = n
    assert {(r["article_id"], r["term"]): r["n"] for r in terms.occurrences(tables[0], ["article_id"], tables[1]).collect()} == expected


def test_a_concept_takes_its_most_frequent_term(spark):
    texts = spark.createDataFrame([("s", "rows", "rock"), ("s", "rows", "rock stone"), ("s", "header", "stone")], "sheet string, zone string, text string")
    vocabulary = spark.createDataFrame([("rock", "c"), ("stone", "c")], "term string, concept_id string")
    assert {(r["zone"], r["concept_id"]): r["n"] for r in workbooks.mentions(texts, vocabulary).collect()} == {("rows", "c"): 2, ("header", "c"): 1}


def test_places_by_pieces(spark):
    texts = spark.createDataFrame([(1, "ab-cd ab-cd-ab"), (2, None), (3, "abx ab")], "k int, text string")
    got = terms.places(texts, ["k"], spark.createDataFrame([("AB-cd",), ("-ab",), ("cd ab",), ("ab",)], "term string"))
    assert {(r["k"], r["term"], r["at"], r["size"]) for r in got.collect()} == {(1, "ab-cd", 0, 3), (1, "ab-cd", 4, 3), (1, "cd ab", 2, 3)}
    assert terms.places(texts, ["k"], spark.createDataFrame([], "term string")).count() == 0
