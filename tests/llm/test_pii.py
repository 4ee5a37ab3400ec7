"""No word of an entity stays, whatever its script and however its names are built; what is no entity stays."""

import re

import pytest

from docframe.llm import pii

#: (text, what must go, what must stay)
TEXTS = [
    ("محمد7@مثال.com wrote", ["محمد", "مثال"], [".com", " wrote"]),
    ("to 김철수1@mail.example.kr now", ["김철수"], ["to ", " now"]),
    ("password: אבגד1וזנס end", ["אבגד", "וזנס"], ["password: ", " end"]),
    ("token=ⴀⴁⴂⴃ12345 end", ["ⴀ", "ⴁ", "12345"], ["token=", " end"]),
    ("ქართველი9@საიტი.ge x", ["ქართველი", "საიტი"], [" x"]),
    ("Mr. McDonald left", ["McDonald", "Donald"], ["Mr. ", " left"]),
    ("Mrs Smith-Jones left", ["Smith", "Jones"], ["Mrs ", " left"]),
    ("Mr. John Michael Smith left", ["John", "Michael", "Smith"], ["Mr. ", " left"]),
    ("Mr. O'Brien left, Mr. D’Angelo too", ["Brien", "Angelo"], ["Mr. ", " left", " too"]),
    ("Dr. Alan Turing left", ["Alan", "Turing"], ["Dr. ", " left"]),
    ("Mr. Baker's shop", ["Baker"], ["Mr. ", "'s shop"]),
    ("Herr Hans Weber Geld gab", ["Hans", "Weber"], ["Herr ", " Geld gab"]),
    ("host 2001:db8::1 and fe80:0:0:0:1:2:3:abcd up", ["2001:db8", "abcd"], ["host ", " and ", " up"]),
    ("at 12:30 or 10:20:30, std::vector, a::b", [], ["at 12:30 or 10:20:30, std::vector, a::b"]),
    ("Г-н Иван Петрович Сидоров ушёл", ["Иван", "Петрович", "Сидоров"], ["Г-н ", " ушёл"]),
]


@pytest.fixture(scope="module")
def out(spark):
    rows = [(i, t) for i, (t, _, _) in enumerate(TEXTS)]
    return {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), key="k").collect()}


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_nothing_of_an_entity_stays(out, i):
    text, gone, kept = TEXTS[i]
    assert not [x for x in gone if x in out[i]], out[i]
    at = 0
    for x in kept:
        at = out[i].index(x, at) + len(x)


def test_replacements_are_of_the_same_kind(out):
    assert re.fullmatch(r"\w+\d@\w+\.com wrote", out[0]) and re.fullmatch(r"to [가-힣]{3}\d@\w+\.\w+\.kr now", out[1])
    assert re.fullmatch(r"host [0-9a-f]{4}:[0-9a-f]{3}::\d and [0-9a-f]{4}(:[0-9a-f]+){7} up", out[12])
    assert re.fullmatch(r"Dr\. [A-Z][a-z]+ [A-Z][a-z]+ left", out[9]) and re.fullmatch(r"Г-н( [А-Я][а-я]+){3} ушёл", out[14])


def test_same_name_same_surrogate(spark):
    rows = [(1, "Mr. John Smith met Mr. John Michael Smith and Mrs Smith."), (2, "Mr. Smith")]
    a, b = (r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), key="k").orderBy("doc_id").collect())
    one = re.fullmatch(r"Mr\. (\w+) (\w+) met Mr\. (\w+) (\w+) (\w+) and Mrs (\w+)\.", a)
    assert one[1] == one[3] and one[2] == one[5] == one[6] and b == f"Mr. {one[2]}" and one[4] not in (one[1], one[2])
