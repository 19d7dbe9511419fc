"""Paragraphs over pages, boxes of unequal size, element rules, style maps and nested references."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loamline.functions.text import running_max
from loamline.operators import catalog, checks, reuse


def test_running_maximum_in_blocks(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randrange(100) if rng.random() < 0.3 else None) for k in "ab" for i in range(57)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    want = {(k, i): max([v for kk, j, v in rows if kk == k and j < i and v is not None], default=None) for k, i, _ in rows}
    for block in (1, 7, 1000):
        got = {(r["k"], r["i"]): r["m"] for r in running_max(df, ["k"], "i", F.col("v"), "m", block).collect()}
        assert got == want


def paragraphs(lines):
    """One walk over the lines of a document."""
    out, before = [], None
    for page, line, text, role, gap in sorted(lines):
        if before is None or (before[0] == page and (role != before[3] or gap > 1.8)):
            new = True
        elif before[0] == page:
            new = False
        else:
            ended = before[2].rstrip().rstrip("\"'”’»」』)]）")[-1:] in tuple(".!?:;…。！？：；")
            new = page != before[0] + 1 or role != "text" or before[3] != "text" or ended
        if new:
            out.append([page, [], [], 0])
        out[-1][1] += [page] if page not in out[-1][1] else []
        out[-1][2].append(text)
        before = (page, line, text, role, gap)
    return sorted((p, tuple(pages), " ".join(texts)) for p, pages, texts, _ in out)


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_paragraphs_run_over_pages(spark, block):
    rng = random.Random(block)
    rows, want = [], {}
    for doc in range(12):
        lines = []
        for page in range(1, 30):
            if rng.random() < 0.1:
                continue  # a page without lines
            for line in range(rng.choice([1, 1, 2, 4])):
                text = f"w{page}.{line}x" + rng.choice(["", "", "", ".", "。」", "!)", ": ", " ,"])
                lines.append((page, line, text, rng.choice(["text"] * 9 + ["heading"]), rng.choice([1.0] * 9 + [2.0])))
        want[doc] = paragraphs(lines)
        rows += [(doc, *line) for line in lines]
    df = spark.createDataFrame(rows, "doc int, page int, line int, text string, role string, gap double").repartition(5)
    got = {doc: [] for doc in want}
    for r in checks.page_paragraphs(df, "doc", "page", "line", "text", "role", "gap", F.lit(1.0), block=block).collect():
        got[r["doc"]].append((r["page"], tuple(r["pages"]), r["text"]))
    assert {d: sorted(p) for d, p in got.items()} == want
    assert max(len(p[1]) for ps in want.values() for p in ps) > 4
    assert checks.page_paragraphs(df.limit(0), "doc", "page", "line", "text", "role", "gap", F.lit(1.0)).count() == 0


def test_boxes_of_unequal_size_meet_once(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        side = rng.choice([0.5, 3, 60, 4000])
        x, y = rng.uniform(-2000, 2000), rng.uniform(-2000, 2000)
        rows.append((i % 2, i, x, y, x + side * rng.random(), y + side))
    rows += [(0, 500, -1e5, -1e5, 1e5, 1e5), (0, 501, 0.0, 0.0, 0.0, 5.0), (1, 502, 10.0, 10.0, 60.0, 60.0), (1, 503, 60.0, 60.0, 110.0, 110.0)]
    df = spark.createDataFrame(rows, "page int, id int, x0 double, y0 double, x1 double, y1 double")
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and min(a[4], b[4]) > max(a[2], b[2]) and min(a[5], b[5]) > max(a[3], b[3])}
    for cell in (5.0, 50.0):
        got = [(r["page"], r["a"], r["b"]) for r in checks.box_pairs(df, "page", cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    cells = checks._grid(df, "page", ["id"], 50.0, "", False)
    assert cells.groupBy("id", "_level").count().agg(F.max("count")).first()[0] <= 9


def test_pages_of_few_boxes_and_crowded_ones(spark):
    """Boxes of pages around the bound, and a null page; those of small pages are not dealt into cells."""
    rng = random.Random(5)
    rows = [(page, i, x := rng.uniform(0, 300), y := rng.uniform(0, 300), x + rng.uniform(0, 90), y + rng.uniform(0, 90)) for page, n in ((0, 1), (1, 2), (2, 64), (3, 65), (4, 90), (None, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "page int, id int, x0 double, y0 double, x1 double, y1 double").repartition(3)
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] is not None and a[0] == b[0] and a[1] < b[1] and min(a[4], b[4]) > max(a[2], b[2]) and min(a[5], b[5]) > max(a[3], b[3]))
    assert sorted((r["page"], r["a"], r["b"]) for r in checks.box_pairs(df, "page").collect()) == want
    small = checks.box_pairs(df.where("page < 3"), "page")
    assert sorted((r["page"], r["a"], r["b"]) for r in small.collect()) == [w for w in want if w[0] < 3]
    assert "Generate" not in small._jdf.queryExecution().optimizedPlan().toString()


def test_element_rules(spark):
    schema = "scene int, name string, is_text boolean, is_content boolean, is_logo boolean, scroll_width int, client_width int, scroll_height int, client_height int, left double, top double, right double, bottom double"
    rows = [
        (1, "h1", True, None, None, 650, 400, 50, 50, 200.0, 200.0, 600.0, 250.0), (1, "banner", None, True, None, None, None, None, None, 1800.0, 200.0, 2100.0, 300.0), (1, "h2", True, True, None, 5, 5, 6, 5, 40.0, 100.0, 400.0, 150.0),
        (1, "logo", None, None, True, None, None, None, None, -30.0, 50.0, 120.0, 100.0), (1, "p", True, None, None, 1, 1, 1, 1, 250.0, 240.0, 550.0, 340.0), (2, "q", True, None, None, 1, 1, 1, 1, 250.0, 240.0, 550.0, 340.0),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {(r["name"], r["issue"], r["level"]) for r in checks.element_issues(df, 1920.0, 1080.0).collect()}
    assert got == {("h1", "text_overflow", "FAIL"), ("banner", "out_of_bounds", "FAIL"), ("h2", "text_overflow", "FAIL"), ("h2", "safe_area", "WARN"), ("logo", "logo_out_of_bounds", "FAIL")}
    assert [(r["scene"], r["name"], r["other"]) for r in checks.text_collisions(df, "scene").collect()] == [(1, "h1", "p")]


def test_style_maps_are_merged_by_key(spark):
    entities = spark.createDataFrame([(1, "a", {"color": "red", "size": "1"}), (2, "b", None), (3, "c", {"x": "y"}), (4, "d", None)], "id int, content string, style map<string,string>")
    patches = [
        (1, 1, None, "A", {"color": "blue"}), (1, 2, "content", None, {"font": "f"}), (1, 3, None, "B", None), (1, 4, "content", None, {"color": "green", "w": None}), (2, 1, None, "z", {"k": "v"}), (9, 1, None, "lost", {"k": "v"}), (3, 1, None, "e", {}),
    ]
    p = spark.createDataFrame(patches, "id int, seq int, field string, new_value string, style map<string,string>")
    got = {r["id"]: (r["content"], r["style"], r["patches"]) for r in catalog.apply_patches(entities, p, "id", ["content"], "style").collect()}
    assert got == {1: (None, {"color": "green", "size": "1", "font": "f", "w": None}, 4), 2: ("z", {"k": "v"}, 1), 3: ("e", {"x": "y"}, 1), 4: ("d", None, 0)}


def test_references_at_any_depth(spark):
    schema = "id int, spec struct<skills:array<string>,steps:array<struct<uses:string,more:map<string,struct<skills:array<string>,note:string>>,n:int>>,note:string>"
    deep = {"a": {"skills": ["s1", "gone"], "note": "gone"}, "b": {"skills": None, "note": None}}
    rows = [(1, (["s1", None], [("s2", deep, 1), (None, None, 2), ("gone", {}, 3)], "gone")), (2, None), (3, (None, None, None))]
    df = spark.createDataFrame(rows, schema)
    existing = spark.createDataFrame([("s1",), ("s2",), (None,)], "name string")
    every = {(r["path"], r["target"]) for r in reuse.nested_references(df, "id", "spec", ["skills", "uses"]).collect()}
    assert every == {("spec.skills[0]", "s1"), ("spec.steps[0].uses", "s2"), ("spec.steps[0].more.a.skills[0]", "s1"), ("spec.steps[0].more.a.skills[1]", "gone"), ("spec.steps[2].uses", "gone")}
    lost = reuse.invalid_references(df, "id", "spec", ["skills", "uses"], existing, "name").collect()
    assert {(r["id"], r["path"]) for r in lost} == {(1, "spec.steps[0].more.a.skills[1]"), (1, "spec.steps[2].uses")}


def test_the_query_of_paragraphs_hands_on_no_word_lists(spark):
    """Above the step that makes lines of a document, no row holds all its words."""
    from loamline.plans.registry import QUERIES

    plan = QUERIES["page_paragraphs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = [i for i, line in enumerate(plan) if "Generate " in line]
    assert made and not any("w#" in re.sub(r"_w[0-9]*#|new#", "", line) for line in plan[: made[0]])
