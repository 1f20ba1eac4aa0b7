import random
from fractions import Fraction

import pytest

from pagelattice.llm import addresses, components, set_join

TABS = "id long, url string, canonical_url string, extra string, digest long, form string"


def tabs(spark, rows):
    return spark.createDataFrame([(i, u, c, "x", 1, "clash") for i, u, c in rows], TABS)


SAME = [
    "https://www.A.com:443/Some-Page/%70art/?b=2&a=1#top", "https://a.com/some_page/part?a=1&b=2", "HTTPS://a.com//some%2Dpage/./PART/?B=2&utm_source=x&A=1&ref=y", " https://a.com/some.page/part/?a=1&b=2&&-=- ",
]
OTHER = ["http://a.com/some-page/part?a=1&b=2", "https://a.com/part/some-page?a=1&b=2", "https://a.com/some-page/part?a=1&b=2&b=2", "https://a.com:8443/some-page/part?a=1&b=2", "https://b.com/some-page/part?a=1&b=2", "https://a.com/some-page/part?a=2&b=1", "https://a.com/somepage/part?a=1&b=2"]


def test_same_pages_collapse(spark):
    rows = [(i, u, None) for i, u in enumerate(SAME)] + [(10 + i, u, None) for i, u in enumerate(OTHER)] + [(30, "ftp://a.com/x", None), (31, None, None), (32, "https://z.com", SAME[0]), (None, SAME[0], None), (33, "", ""), (34, "https://a.com/%ZZ%", None), (35, "https://a.com/%zz", None)]
    got = {(r.first_id, r.tab_id) for r in addresses.repeated_addresses(tabs(spark, rows)).collect()}
    assert got == {(0, 1), (0, 2), (0, 3), (0, 32), (34, 35)}
    groups = {r.first_id: r.copies for r in addresses.collapse_addresses(tabs(spark, rows)).collect()}
    assert groups[0] == 5 and len(groups) == 1 + len(OTHER) + 1


def test_hot_address_and_long_text(spark):
    rows = [(i, SAME[i % 4], None) for i in range(3000)] + [(5000, "https://a.com/" + "p/" * 20_000, None), (5001, "https://a.com/" + "p/" * 20_000, None)]
    got = addresses.repeated_addresses(tabs(spark, rows))
    assert got.where("first_id = 0").count() == 2999 and got.where("first_id = 5000").count() == 1


def test_no_addresses(spark):
    assert addresses.repeated_addresses(tabs(spark, [])).count() == 0


def brute(rows, t):
    sets = {i: {k.strip().lower() for k in ks if k and k.strip()} for i, ks in rows if ks is not None and i is not None}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= t}


@pytest.mark.parametrize(("threshold", "small"), [(0.6, 8), (0.6, 3), (0.5, 5), (0.9, 8), (1.0, 4)])
def test_set_join_is_exact(spark, threshold, small):
    random.seed(int(threshold * 10) + small)
    words = [f"k{i}" for i in range(14)]
    rows = [(i, [random.choice(words) for _ in range(random.randrange(0, 13))] + (["common"] if i % 2 else [])) for i in range(130)]
    rows += [(200, None), (201, []), (202, [None, " ", ""]), (203, [" K1 ", "k2", None]), (204, ["K2", "k1"]), (None, ["k1", "k2"])]
    df = spark.createDataFrame([(i, k, "x", 0) for i, k in rows], "id long, keywords array<string>, items string, n int")
    got = [(r.id_a, r.id_b) for r in set_join.similar_pairs(df, threshold=threshold, small_size=small).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, Fraction(str(threshold)))


def test_copies_links_and_two_tables(spark):
    rows = [(i, ["a", "b", "c"]) for i in range(40)] + [(100, ["a", "b", "c", "d"]), (101, ["z"])]
    df = spark.createDataFrame(rows, "id long, keywords array<string>")
    assert set_join.similar_pairs(df).count() == 40 * 39 // 2 + 40
    got = {r.id: (r.class_id, r.copies, r.links) for r in set_join.link_counts(df).collect()}
    assert got[5] == (0, 40, 1) and got[100] == (100, 1, 40) and got[101] == (101, 1, 0)
    other = spark.createDataFrame([(7, ["A", "b", "c"]), (8, ["q"])], "k long, s array<string>")
    assert {(r.left_id, r.right_id) for r in set_join.similar_pairs_between(df, other, "id", "k", "keywords", "s").collect()} == {(i, 7) for i in [*range(40), 100]}
    assert set_join.similar_pairs(spark.createDataFrame([], "id long, keywords array<string>")).count() == 0


def roots(links):
    parent: dict[int, int] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {n: find(n) for n in parent}


@pytest.mark.parametrize("task_edges", [1_000_000, 200, 40])
def test_components_whatever_fits_a_task(spark, task_edges):
    random.seed(task_edges)
    links = [(random.randrange(400), random.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1150)] + [(5000, k) for k in range(5001, 5150)] + [(None, 1), (2, None), (9, 9), (1001, 1000)]
    got = {r.node: r.component_id for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b", task_edges=task_edges).collect()}
    assert got == roots(links)


def test_links_of_tabs(spark):
    t = spark.createDataFrame([(0, None), (1, 0), (2, 2), (3, 77), (4, None), (5, None), (None, 1)], "id long, duplicate_of long")
    e = spark.createDataFrame([(4, 5, "navigation"), (1, 4, "similarity"), (4, 1, "similarity"), (5, 99, "similarity"), (None, 5, "similarity"), (5, 5, "similarity"), (3, 5, None)], "source long, target long, reason string")
    assert sorted((r.component_id, r.tab_id) for r in components.tab_components(e, t).collect()) == [(0, 0), (0, 1), (0, 4)]
    assert components.components(e.where("false"), "source", "target").count() == 0
