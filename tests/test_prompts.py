"""Splices and names against a search of every name in turn."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import prompts


def slow_splice(text, reveals):
    """Each name looked for by itself, the longest first."""
    taken, inserts, missing = [], [], []
    for name, eid, told in sorted(reveals, key=lambda r: -len(r[0])):
        spots = [i for i in range(len(text) - len(name) + 1) if name and text.startswith(name, i) and not any(s < i + len(name) and i < e for s, e in taken)]
        if not spots:
            missing.append(eid)
            continue
        taken.append((spots[0], spots[0] + len(name)))
        inserts.append((spots[0] + len(name), told))
    for end, told in sorted(inserts, reverse=True):
        text = f"{text[:end]}（{told}）{text[end:]}"
    return text, missing


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab海燕号 ", max_size=40), st.lists(st.tuples(st.text(alphabet="ab海燕号 ", max_size=4), st.sampled_from("xyz"), st.text(alphabet="ab海", max_size=3)), max_size=5))
def test_splice_by_search(text, reveals):
    assert prompts.splice(text, [dict(zip(("name", "eid", "text"), r, strict=True)) for r in reveals]) == slow_splice(text, reveals)


def told(text, *reveals):
    return prompts.splice(text, [{"name": n, "eid": n, "text": t} for n, t in reveals])


def test_longest_name_first_and_never_in_inserted_text():
    assert told("老鹰登上老鹰号", ("老鹰", "灰羽"), ("老鹰号", "木船")) == ("老鹰（灰羽）登上老鹰号（木船）", [])
    assert told("The cup stands by the lamp.", ("cup", "next to a lamp"), ("lamp", "brass"), ("rug", "red")) == ("The cup（next to a lamp） stands by the lamp（brass）.", ["rug"])
    assert told("Ann and Ann", ("Ann", "tall"), ("Ann", "short"), ("Ann", "none")) == ("Ann（tall） and Ann（short）", ["Ann"])
    assert told("", ("a", "b")) == ("", ["a"]) and told("plain") == ("plain", [])


def test_long_text_is_one_pass(spark):
    text = "ab" * 50_000
    done, missing = told(text, ("b" * 3, "x"), ("ab", "y"), ("zz", "z"))
    assert done == "ab（y）" + text[2:] and missing == ["bbb", "zz"]


def test_rendered_segments(spark):
    rows = [(1, "Fox runs.", [("Fox", "f", "red")]), (2, None, [("Fox", "f", "red")]), (3, "Fox", None), (4, "Fox", [(None, "n", "x"), ("Fox", "f", None)])]
    df = spark.createDataFrame(rows, f"seg long, action string, reveals {prompts.REVEALS}")
    got = {r.seg: (r.prompt, r.missing) for r in prompts.rendered(df, ["seg"]).collect()}
    assert got == {1: ("Fox（red） runs.", []), 2: ("", ["f"]), 3: ("Fox", []), 4: ("Fox（）", ["n"])}


def test_what_a_segment_reveals(spark):
    states = "array<struct<state:string,appearance:string>>"
    rows = [
        ("introduce", None, None, None, " A tall ship. "), ("introduce", None, [("old", "grey。"), ("new", "white")], "new", "unused"), ("introduce", None, [("old", "grey。.")], "lost", "unused"),
        ("transform", "burnt.", [("old", "grey")], "old", None), ("transform", None, None, None, "x"), ("persist", None, [], None, None),
    ]
    df = spark.createDataFrame(rows, f"op string, new string, states {states}, initial string, appearance string")
    c = F.col
    got = df.select(prompts.reveal_text(c("op"), c("new"), c("states"), c("initial"), c("appearance")).alias("t"), prompts.revealed(c("op")).alias("r")).collect()
    assert [r.t for r in got] == ["A tall ship", "white", "grey", "burnt", "", ""] and [r.r for r in got] == [True] * 5 + [False]


def test_missing_names(spark):
    roster = spark.createDataFrame([(1, "art", "Art"), (1, "owl", "Old  Owl"), (1, "yan", "海燕"), (1, "dot", "Mr. X"), (1, "none", "  ")], "story long, eid string, name string")
    segments = spark.createDataFrame(
        [(1, 0, "We start; the OLD owl and 大海燕号 meet mr. x", ["art", "owl", "yan", "dot", "none", "ghost", "art", ""]), (1, 1, "State of the art.", ["art", "owl"]), (1, 2, None, ["art"])],
        "story long, seg long, action string, present array<string>",
    )
    got = {(r.seg, r.eid, r.reason) for r in prompts.missing_names(segments, roster, ["story", "seg"], "story").collect()}
    gone = "action_missing_canonical_name"
    assert got == {(0, "art", gone), (0, "none", "empty_canonical_name"), (0, "ghost", "empty_canonical_name"), (1, "owl", gone), (2, "art", gone)}
