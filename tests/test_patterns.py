"""Rule packs: literals that rules need, places of matches, mentions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamline.functions.patterns import any_of, prefilter, required_literals
from loamline.operators import linting

PATTERNS = [
    r"\b100\s*%\s*(an toàn|tự nhiên|organic)\b", r"idiot|moron|stupid", r"(?<!giá )(?<!quản )\btrị (mụn|nám)", r"\btop\s*(1|một)\b|\bno\.?\s*1\b|#1\b", r"x{2,}y?z", r"[ab]c+d", r"(a|b)?cd", r"\bsố (1|một)\b(?!\s*/)",
    r"(who|doctor)[^.;\n]{0,25}(recommends|says)",
]


@pytest.mark.parametrize("pattern, want", [("idiot|moron", {"idiot", "moron"}), (r"(?<!giá )\btrị (mụn|nám)", {"trị"}), ("a?b*", None), ("(?i)abc", None), ("a|", None), (r"(?U)\bx", None), ("(", None), (r"(?:ab){2}", {"ab"}), ("", None)])
def test_required_literals(pattern, want):
    assert required_literals(pattern) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["100", "%", " ", "an toàn", "organic", "idi", "ot", "trị", "mụn", "top", "1", "no.", "#", "x", "y", "z", "a", "b", "c", "d", "số", "một", "who", "says", ".", "/"]), max_size=12))
def test_no_match_lacks_the_literals(pieces):
    text = "".join(pieces)
    for pattern in PATTERNS:
        if re.search(pattern, text):
            assert re.search(prefilter([pattern]), text)
            assert re.search(prefilter(PATTERNS), text)


def test_one_expression_of_many_literals():
    literals = ["abc", "abd", "a.c", "b", "bcd", "#1", "ß+"]
    found = re.compile(any_of(literals))
    for text in ["abd", "xxa.c", "axc", "#1", "#2", "ß+", "ß", "zb", ""]:
        assert bool(found.search(text)) == any(x in text for x in literals)
    assert prefilter(["abc", "d*"]) is None and prefilter([]) is None


def test_places_are_inside_their_matches(spark):
    rows = [("not bad, bad", r"(?<!not )bad"), ("aXbX", r"(?<=a)X"), ("a.a.a", "a"), ("no", "x"), ("aaa", "a+"), ("ab", "(?=b)|a"), ("été là", r"(?U)\b\w+"), ("$1 \\ $0", r"\$."), (None, "a"), ("", "a")]
    for text, pattern in rows:
        got = spark.createDataFrame([(text,)], "t string").select(linting.match_places(F.col("t"), F.lit(pattern))).first()[0]
        want = [(m.start() + 1, m.end() + 1, m[0]) for m in re.finditer(pattern.replace("(?U)", ""), text or "") if m[0]]
        assert (got is None) if text is None else [tuple(r) for r in got] == want


def test_rules_on_unsplit_texts_and_lines_are_the_same(spark):
    rules = [(i, "ads" if i == 1 else "general", "banned", f"c{i}", "s", p, "") for i, p in enumerate([r"(?<!not )bad", "worse|worst", "100 ?%"])]
    pack = linting.compile_rules(spark.createDataFrame(rules, linting.RULE_SCHEMA), "ads")
    texts = ["not bad but bad\nworst", "fine", "100% of\n100 % and BAD", None, "", "bad\n" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    lines_of = lambda df: linting.mask_phrases(linting.lint_lines(df, "k"), "text", [])
    keys = ["k", "line", "rule_order", "start", "end", "matched"]
    some = linting.rule_matches(lines_of(linting.lintable(docs, pack)), pack, ["k", "line"], "masked")
    want = set()
    for k, t in enumerate(texts):
        for n, line in enumerate((t or "").lower().split("\n"), 1):
            want |= {(k, n, r[0], m.start() + 1, m.end() + 1, m[0]) for r in rules for m in re.finditer(r[5], line)}
    assert {tuple(r) for r in some.select(keys).collect()} == want
    assert "Join" not in some._jdf.queryExecution().optimizedPlan().toString()
    general = linting.rule_matches(lines_of(docs), spark.createDataFrame(rules, linting.RULE_SCHEMA), ["k", "line"], "masked")
    assert {r["rule_order"] for r in general.collect()} == {0, 2}
    none = linting.compile_rules(spark.createDataFrame([], linting.RULE_SCHEMA))
    assert linting.rule_matches(lines_of(docs), none, ["k", "line"], "masked").count() == 0
    with pytest.raises(ValueError):
        linting.compile_rules(spark.createDataFrame(rules, linting.RULE_SCHEMA), most=1)


def test_mentions_are_no_claims(spark):
    rules = spark.createDataFrame([(1, "general", "banned", "c", "s", "best", "")], linting.RULE_SCHEMA)
    texts = ["never best", "not the best", 'avoid "the best" here', 'avoid best "here"', '"best" it is', "replace *best* by good", "no   best"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    found = linting.rule_matches(linting.mask_phrases(linting.lint_lines(docs, "k"), "text", []), rules, ["k", "line"], "masked")
    assert sorted(r["k"] for r in linting.drop_mentions(found, "masked").collect()) == [1, 3, 4]
