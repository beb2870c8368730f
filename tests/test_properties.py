"""Hashtag extraction: hand-written cases, and properties of the result on random comments mixing
Unicode spaces, separators, '#' and ','."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagwave.functions import hashtags

ALPHABET = ["#", "#", ",", "a", "b", "É", "|", "(", " ", " ", "\t", "\n", "\x0b", "\x1c", "\x1f", "\xa0",
            "\u2003", "\u3000", "\x85", "\u2028"]
SPACES = set(" \t\n\x0b\x1c\x1f\xa0\u2003\u3000\x85\u2028")

# comment, tags with raw duplicates removed first, tags with clean duplicates removed last
CASES = [
    ("", [], []),
    ("no tags here", [], []),
    ("#a #b", ["a", "b"], ["a", "b"]),
    ("#a #a", ["a"], ["a"]),
    ("#a #a,", ["a", "a"], ["a"]),
    ("##a ###b", ["#b", "a"], ["#b", "a"]),
    ("## # #,", [], []),
    ("#a,, #b,", ["a,", "b"], ["a,", "b"]),
    ("x#a (#b) a#b", [], []),
    ("#a#b #p|q", ["a#b", "p|q"], ["a#b", "p|q"]),
    ("#\u00c9\u3000#z\x1c#y\x85#w", ["w", "y", "z", "\u00c9"], ["w", "y", "z", "\u00c9"]),
]


def test_cases(spark):
    df = spark.createDataFrame([(c,) for c, _, _ in CASES], "c string")
    rows = {r.c: r for r in df.select("c", hashtags("c").alias("b"), hashtags("c", dedupe="after").alias("a")).collect()}
    for comment, before, after in CASES:
        assert sorted(rows[comment].b) == sorted(before) and sorted(rows[comment].a) == sorted(after)


def test_unknown_dedupe_is_refused():
    with pytest.raises(ValueError):
        hashtags("c", dedupe="never")


comments = st.lists(st.text(alphabet=st.sampled_from(ALPHABET), max_size=30), min_size=1, max_size=25)


@settings(max_examples=20, deadline=None)
@given(comments)
def test_properties(spark, batch):
    df = spark.createDataFrame([(c,) for c in batch], "c string")
    for r in df.select("c", hashtags("c").alias("b"), hashtags("c", dedupe="after").alias("a")).collect():
        assert all(r.b) and all(r.a)                                    # no empty tag
        assert len(set(r.a)) == len(r.a) and set(r.a) == set(r.b)       # the two orders differ in repeats only
        for tag in r.b:
            assert not SPACES & set(tag)
            assert "#" + tag in r.c                                     # a tag stands in the comment after a '#'
        opened = sum(p.startswith("#") for p in r.c.split())
        assert len(r.b) <= opened
