import re

from hypothesis import given, settings
from hypothesis import strategies as st

from matchloom.llm.url_filter import RULES, GlobAutomaton, Rule, filter_urls


def as_regex(pattern):
    out, i = "", 0
    while i < len(pattern):
        if pattern[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + ".", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return re.compile(out, re.S)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab/*?", max_size=30), min_size=1, max_size=8), st.lists(st.text("ab/", max_size=25), min_size=1, max_size=6))
def test_automaton_is_glob_matching(patterns, texts):
    found = GlobAutomaton(patterns).matches([t.encode() for t in texts])
    for i, text in enumerate(texts):
        for j, pattern in enumerate(patterns):
            assert found[i, j] == bool(as_regex(pattern).fullmatch(text)), (pattern, text)


def test_rules(spark):
    urls = {
        "http://A.Example.ORG/en/12?x": ("a.example.org", "/en/12", "example.org/en/1", "block"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://example.org": ("example.org", "", None, "allow"),
        "http://example.org?a=/es/": ("example.org", "", None, "allow"),
        "http://evil.net/x.com/de/": ("evil.net", "/x.com/de/", None, "allow"),
        "https://x.com/de/#a://b": ("x.com", "/de/", "com/de/", "block"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://" + "a." * 3000 + "com/fr/é": ("a." * 3000 + "com", "/fr/é", "com/fr/", "allow"),
    }
    rows = [(i, u, "clash") for i, u in enumerate(urls)] * 2
    got = filter_urls(spark.createDataFrame(rows, "page_id int, url string, host string"), RULES).collect()
    assert sorted((r[0], tuple(r)[1:]) for r in got) == sorted([(i, v) for i, v in enumerate(urls.values())] * 2, key=lambda x: x[0])
    assert filter_urls(spark.createDataFrame([], "page_id int, url string"), [Rule("block", "a/")]).collect() == []
