"""Hints on first letters change no match."""

import random
import re

import pytest

from gleanery.functions import lexicon as lx
from gleanery.functions import rx

NAMES = ["CLAIM_EN", "CLAIM_KO", "METHOD_CUE", "OBJECTION_CUE", "ARGUMENT_CUE", "ARGUMENT_AGENT", "BOUNDARY_CUE", "BOUNDARY_SCORE_CUE", "METHOD_AGENT", "SUBJECT_STOP", "SUBJECT_VERB", "PREDICATE_NOUN"]
PATTERNS = [getattr(lx, n) for n in NAMES] + lx.CLAIM_GUARDS + [p for ps in lx.DEMOTIONS.values() for p in ps]
WORDS = "The author argues shows up claims however method approach framework must not see cf. Smith, J. (1999) 참고 문헌 주장한다 따라서 결론내린다 copyright © ISBN 12345678901 the claim is-defined Index\n table of contents 목차 .... 12 because reconclude Rargue studyclaims 저자는 비교 분석".split(" ")


def _python(pattern, hints):
    spelled = rx._spelled(rx._hinted(pattern) if hints else pattern, rx._JAVA_SPACE, rx._JAVA_BEFORE, rx._JAVA_AFTER)
    flags = re.I if spelled.startswith("(?i)") else 0
    return re.compile(spelled.removeprefix("(?i)").replace(r"\z", r"\Z"), flags | (re.ASCII if flags else 0))


@pytest.mark.parametrize("pattern", PATTERNS)
def test_hints_change_no_match(pattern):
    if not pattern.startswith("(?i)") and "(?i:" not in pattern or pattern.startswith("(?i)"):
        plain, hinted = _python(pattern, False), _python(pattern, True)
        rng = random.Random(1)
        for _ in range(300):
            text = rng.choice(["", " ", "-"]).join(rng.choices(WORDS + [w.upper() for w in WORDS], k=12)) if rng.random() < 0.3 else " ".join(rng.choices(WORDS, k=12))
            assert [m.span() for m in plain.finditer(text)] == [m.span() for m in hinted.finditer(text)]


def test_what_is_hinted():
    assert rx._hinted(r"(?i)\b(?:alpha|beta)s?\b") == r"(?i)(?=[ab])\b(?:alpha|beta)s?\b"
    assert rx._hinted(r"(?:the\s+)?(?:x|y(?:z)?)|[A-Z]b|\d") == r"(?=[txy])(?:the\s+)?(?:x|y(?:z)?)|[A-Z]b|\d"
    assert rx._hinted(r"a*b") == "a*b" and rx._hinted(r"a?b") == "(?=[ab])a?b" and rx._hinted(r"(?:\A|\n)x") == r"(?:\A|\n)x"


@pytest.mark.parametrize("pattern", [p for p in PATTERNS + lx.QUOTES + [lx.BIB_PUBLISHER, lx.BIB_YEAR, lx.BIB_AUTHOR] if rx.needles(p)])
def test_each_match_holds_a_needle(pattern):
    plain, rng = _python(pattern, False), random.Random(2)
    for _ in range(500):
        text = rng.choice(["", " ", "-"]).join(rng.choices(WORDS + [w.upper() for w in WORDS] + ["p.", "see", '"', "“x”", "9"], k=9))
        assert not plain.search(text) or any(n in text.lower() for n in rx.needles(pattern))


def test_what_needles_are_told():
    assert rx.needles(r"(?i)\b(?:the\s+)?(?:author|authors|text)\s+shows?\b") == ("show",)
    assert rx.needles(r"\.{4,}\s*\d") == ("....",) and rx.needles(r"방법론?|(?:x|\d)y+") == ("y", "방법")
    assert rx.needles(r"\p{Greek}[\p{Greek}]+") == () and rx.needles(r"a?|b") == () and rx.needles(r"\Aalpha") == ()
    assert rx.needles(r"[“\x22][^”]{4,}") == ('"', "“") and rx.needles(r"x(?=y)z") in (("x",), ("z",))
