"""The wikitext scanner: given cases, a plain recursive program, and long texts."""

import html
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphleaf.sources.wikitext import links, parse, plain_text, sections


@pytest.mark.parametrize(
    ("text", "plain", "targets"),
    [
        ("[[File:A.jpg|thumb|a [[cat|big cat]] and [[dog]]]] x", "thumb|a big cat and dog x", ["File:A.jpg", "cat", "dog"]),
        ("<nowiki>[[no]] {{t}} ''q''</nowiki> [[yes#part|y]]", "[[no]] {{t}} ''q'' y", ["yes"]),
        ("a<ref>unclosed [[b]]", "aunclosed b", ["b"]),
        ("a<ref name=x>r {{t}}</ref>b<ref name=x/>c", "abc", []),
        ("{{box|\n{| class=x\n| a || b\n|}\n|k=[[in]]}}after", "after", ["in"]),
        ("{{{1|}}} {{a{{b}}c}} {{{{x}}}} {{{{{p}}}}}!", "   !", []),
        ("{{open [[a]] b", "{{open a b", ["a"]),
        ("close }} and ]] and |} |", "close }} and ]] and |} |", []),
        ("<!-- [[no]] {{ -->''i'' '''b''' <b>t</b> &amp; [http://e.org l] [//x.y] [https://z", "i b t & l  [https://z", []),
        ("{{t|[[a]}} [[b|]]", " ", ["b"]),
        ("", "", []),
    ],
)
def test_given_cases(text, plain, targets):
    assert plain_text(text) == plain and links(text) == targets


def tree(depth):
    """Well-formed pieces: text with what is left of it and its links."""
    leaf = st.sampled_from([("word ", "word ", []), ("&lt; ", "&lt; ", []), ("<br/>", "", []), ("<!-- {{ [[ -->", "", []), ("<nowiki>{{</nowiki>", "{{", [])])
    if not depth:
        return leaf
    inner = st.lists(tree(depth - 1), max_size=3).map(lambda p: ("".join(x[0] for x in p), "".join(x[1] for x in p), [t for x in p for t in x[2]]))
    around = lambda a, b, left: inner.map(lambda x: (a + x[0] + b, left(x[1]), x[2]))
    return st.one_of(
        leaf, inner, around("{{t|", "}} ", lambda _: " "), around("{|x\n| ", " \n|} ", lambda _: " "), around("<ref>", "</ref>", lambda _: ""), around("'' ", "'' ", lambda x: f" {x} "), around("<i>", "</i>", lambda x: x),
        inner.map(lambda x: (f"[[Target|{x[0]}]]", x[1], ["Target", *x[2]])), inner.map(lambda x: (f"[http://e.org {x[0].replace(']', '')}]", x[1], x[2]) if "]" not in x[0] else x),
    )


@settings(max_examples=400, deadline=None)
@given(tree(4))
def test_trees(piece):
    text, left, targets = piece
    assert plain_text(text) == html.unescape(left) and links(text) == targets


def test_sections_close_at_their_level():
    text = "lead\n== A ==\na\n=== B ===\nb\n==== C ====\nc\n=== D ===\nd\n== E ==\ne"
    assert [s.split("\n")[0].strip("= ") for s in sections(text)] == ["lead", "A", "B", "C", "D", "E"]
    assert [len(s.strip().split("\n")) for s in sections(text)] == [1, 8, 4, 2, 2, 2] and parse("== only ==")[1][0][0] == "== only =="


@pytest.mark.parametrize("piece", ["{{a|", "[[a|", "{{a}} [[b|c]] ", "<ref>x", "}} ]] ", "== h ==\nx\n", "{{{", "[http://e.org "])
def test_long_texts_take_time_in_proportion(piece):
    def seconds(n):
        text = piece * n
        began = time.perf_counter()
        parse(text)
        return time.perf_counter() - began

    seconds(100)
    assert min(seconds(20_000) for _ in range(2)) < 40 * max(0.002, min(seconds(2_000) for _ in range(2)))
