import random

from quarry.functions import votes as V
from quarry.functions.vocabulary import FORMATS, GENRES, STATION_TYPES


def test_counts_equal_plain_counting():
    rng = random.Random(1)
    words = [w for v in (GENRES, FORMATS, STATION_TYPES) for _, ws in v for w in ws]
    for _ in range(200):
        text = "".join(rng.choice([*rng.choices(words, k=3), " ", "nprnpr", "raprap", "x", "é"]) for _ in range(rng.randint(0, 60)))
        assert V.word_counts(text) == {w: text.count(w) for w in words if w in text}


def test_confidence_and_evidence():
    assert V._station(V.word_counts("")) == ("unknown", 0.1, [])
    assert V._station(V.word_counts("npr. community radio, community radio")) == ("community", 0.7, ["community radio"] * 2)
    assert V._station(V.word_counts("public radio npr npr member " * 9)) == ("public", 0.9, ["public radio"] * 3 + ["npr"] * 3 + ["npr member"] * 3)
    assert V._station(V.word_counts("campus radio college radio"))[0] == "college"
