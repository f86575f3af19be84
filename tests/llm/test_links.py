"""Rules and path templates of hand-made links."""

from deckloom.llm.links import judge_targets, path_templates

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


def judged(spark, links, labelled=()):
    links = spark.createDataFrame([(i, t, "x") for i, t in links], "rel_id bigint, target string, host string")
    return {r.rel_id: r for r in judge_targets(links, spark.createDataFrame(list(labelled), "target string, bad boolean"), RULES).collect()}


def test_rules(spark):
    urls = ["https://EXAMPLE.com/en/1", "http://www.example.com/en/x?q#f", "https://a.www.example.com/en/", "http://notexample.com/en/a",
            "https://x.net/es/1", "https://x.net/en/1", "https://x.net", "https://example.com", None, "no host/en/", "://h.net/es/a?b://c", "//net/es/",
            "https://net/ES/1", "https://d.example.com/en"]
    found = judged(spark, list(enumerate(urls)))
    short = [(found[i].host, found[i].path, found[i].rule, found[i].verdict) for i in range(len(urls))]
    assert short == [
        ("example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("a.www.example.com", "/en/", "www.example.com/en/", "allow"), ("notexample.com", "/en/a", "com/", "allow"),
        ("x.net", "/es/1", "net/es/", "block"), ("x.net", "/en/1", None, "allow"), ("x.net", "", None, "allow"),
        ("example.com", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h.net", "/es/a", "net/es/", "block"),
        ("", "", None, "allow"), ("net", "/ES/1", None, "allow"), ("d.example.com", "/en", "com/", "allow")]


def test_bad_templates_are_blocked(spark):
    links = [(i, f"https://h.org/{'spam' if i % 2 else 'news'}/{i}.html") for i in range(400)]
    labelled = [(t, "spam" in t) for i, t in links if i < 200] + [(None, None), ("https://h.org/news/7", None)]
    found = judged(spark, links, labelled)
    assert {(r.template, r.verdict) for r in found.values()} == {("/spam/*.html", "block"), ("/news/*.html", "allow")}


def test_like_branches_share_their_labels(spark):
    """A branch with few labels is judged with siblings of its kind; one unlike them stands alone."""
    links = [(i, f"https://h.org/{'abcd'[i % 4]}/{i}") for i in range(800)]
    labelled = [(f"https://h.org/{b}/{i}", bad) for b, bad, n in (("a", True, 40), ("b", True, 40), ("c", True, 2), ("d", False, 40)) for i in range(n)]
    found = judged(spark, links, labelled)
    verdicts = {r.template: r.verdict for r in found.values()}
    assert verdicts["/a/*"] == verdicts["/b/*"] == "block" and verdicts["/d/*"] == "allow"


def test_variable_segments(spark):
    rows = [("h", f"/user/name{chr(97 + i % 26)}{chr(97 + i // 26)}/p", None) for i in range(300)] + [("h", "/user/7/p", True), ("h", "/a/b/c/d/e/f", None)]
    found = path_templates(spark.createDataFrame(rows, "host string, path string, bad boolean")).collect()
    assert {r.template for r in found} == {"/user/*/p", "/*/b/c/d/**"}
    assert sum(r.n for r in found) == len(rows) and sum(r.n_bad for r in found) == 1


def test_rare_bad_sections_are_set_apart(spark):
    """One of thirty equal sections, and one section under a twentieth beside a hot one, keep their own labels."""
    names = [f"sec{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(30)]
    urls = [f"https://h.org/{name}/{i}" for name in names for i in range(20)]
    urls += [f"https://hot.org/{'spam' if i % 25 == 0 else 'news'}/{i}" for i in range(500)]
    bad = lambda u: "/secah/" in u or "/spam/" in u
    found = judged(spark, list(enumerate(urls)), [(u, bad(u)) for u in urls])
    assert {u for i, u in enumerate(urls) if found[i].verdict == "block"} == {u for u in urls if bad(u)}


def test_deep_bad_branches_are_set_apart(spark):
    """Below the fourth segment, by their beginning, or by a segment under variable ones."""
    urls = [f"https://h.org/a/b/c/d/e/{'spam' if i % 6 == 0 else 'news'}/x/{i}" for i in range(240)]
    urls += [f"https://u.org/user/n{chr(97 + i % 26)}{chr(97 + i // 26)}/p/q/r/{'junk' if i % 8 == 0 else 'post'}/{i}" for i in range(320)]
    bad = lambda u: "/spam/" in u or "/junk/" in u
    found = judged(spark, list(enumerate(urls)), [(u, bad(u)) for u in urls])
    assert {u for i, u in enumerate(urls) if found[i].verdict == "block"} == {u for u in urls if bad(u)}


def test_like_branches_of_deeper_levels_share_their_labels(spark):
    links = [(i, f"https://h.org/top/{'abcd'[i % 4]}/{i}") for i in range(800)]
    labelled = [(f"https://h.org/top/{b}/{i}", bad) for b, bad, n in (("a", True, 40), ("b", True, 40), ("c", True, 2), ("d", False, 4)) for i in range(n)]
    labelled += [(f"https://g.org/x/{i}", False) for i in range(200)]
    verdicts = {r.template: r.verdict for r in judged(spark, links, labelled).values()}
    assert verdicts == {"/top/a/*": "block", "/top/b/*": "block", "/top/c/*": "block", "/top/d/*": "allow"}


def test_empty(spark):
    assert judged(spark, []) == {}
