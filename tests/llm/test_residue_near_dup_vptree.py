import random

import numpy as np
import pytest

from pagelattice.llm import near_dup, residue, vptree

SCHEMA = "id long, title string, summary string, text_excerpt string, error string, field string"


def fields(spark, rows, **options):
    df = spark.createDataFrame([(i, t, s, x, e, "clash") for i, t, s, x, e in rows], SCHEMA)
    return {(r.tab_id, r.field) for r in residue.residue_fields(df, **options).collect()}


LEFT = ["Welcome {{user.firstName}} to the shop", "Prices for the ${item.price} start low", "The [% name %] index", "%%POST_TITLE%% | a.example", "from __vendorName__ with love", "Hello %(FNAME)S and more", "The %s of it", "cut off at {{page_ti",
        "the meadow null us to camp", "308 ideas from NaN", "in [object Object] handbook", "Lorem ipsum dolor sit amet consectetur", "Page not found | a.example", "503 Service Unavailable", "Just a moment...", "Please enable JavaScript to continue using a.test.",
        "Great start. TODO write the intro. And on", "Uncaught exception in handler line 14: missing key.", "NULL - NULL", "<%= page_title %>", "Bitte aktivieren Sie JavaScript, um a.test zu nutzen."]
FINE = ["A nullable journal", "Why does Ann answer with 404 Not Found when it moves? A step", "Access denied was the working title of a novel", "We value your privacy and use cookies on a.test. Accept all or manage choices.", "Nothing found here today, none at all", "Our server returned 503 for 9 minutes",
        "The history of lorem ipsum, the filler of printers", "Should a list need JavaScript? Ann argues it does not", "It cost $5 and 100% of {the} rest? no", "", "50 ways to write"]


def test_each_kind_of_residue(spark):
    got = fields(spark, [(i, t, None, None, None) for i, t in enumerate(LEFT)])
    assert got == {(i, "title") for i in range(len(LEFT))}


def test_what_only_writes_about_it(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(FINE) if "{the}" not in t]
    assert fields(spark, rows) == set()
    assert fields(spark, [(0, None, None, "{{x}}", "unsupported_url"), (None, "{{x}}", None, None, None)]) == set()


@pytest.mark.parametrize("limit", [200_000, 0])
def test_constant_tokens_of_a_template_are_content(spark, limit):
    nouns = ["kiln", "fern", "mug", "tray", "lens", "bolt", "shelf", "clay"]
    rows = [(i, f"Set ${{HOME}} before you open the {n}", None, None, None) for i, n in enumerate(nouns)]
    rows += [(20 + i, f"Never sell the {n} before you open the shop", None, None, None) for i, n in enumerate(nouns)]
    rows += [(40, "Never sell the {{product}} before you open the shop", None, None, None), (41, None, "", "Set ${FNAME} before you open the kiln", None)]
    assert fields(spark, rows, broadcast_contexts=limit) == {(40, "title"), (41, "text_excerpt")}


def test_long_text_and_no_rows(spark):
    assert fields(spark, [(0, None, "word " * 50_000 + "{{name}} end", None, None)]) == {(0, "summary")}
    assert fields(spark, []) == set()


def token_rows(seed, n=500):
    random.seed(seed)
    base = [[f"t{random.randrange(80)}" for _ in range(random.randrange(8, 30))] for _ in range(40)]
    rows = []
    for i in range(n):
        b = list(random.choice(base))
        for _ in range(random.randrange(0, 5)):
            b[random.randrange(len(b))] = f"t{random.randrange(80)}"
        rows.append((i, b + ["common", "common", None]))
    return rows + [(9000, None), (9001, []), (9002, [None] * 12), (None, rows[0][1])]


def brute(rows, t):
    sets = [(i, {x for x in ts if x is not None}) for i, ts in rows if ts is not None and i is not None]
    sets = [(i, s) for i, s in sets if len(s) >= 10]
    return {(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if len(x & y) >= t * len(x | y) - 1e-9}


@pytest.mark.parametrize(("block", "threshold"), [(4096, 0.7), (60, 0.7), (4096, 0.85)])
def test_near_duplicates_are_exact(spark, block, threshold):
    rows = token_rows(block)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "id long, tokens array<string>, n int")
    got = [(r.id_a, r.id_b) for r in near_dup.near_duplicate_pairs(df, threshold=threshold, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, threshold)


def test_groups_of_near_duplicates(spark):
    rows = [(i, [f"a{k}" for k in range(20)]) for i in range(30)] + [(50, [f"a{k}" for k in range(1, 21)]), (60, [f"b{k}" for k in range(20)]), (70, ["x"] * 300)]
    got = {r.id: r.group_id for r in near_dup.near_duplicate_groups(spark.createDataFrame(rows, "id long, tokens array<string>")).collect()}
    assert got == {**{i: 0 for i in range(30)}, 50: 0, 60: 60}
    assert near_dup.near_duplicate_pairs(spark.createDataFrame([], "id long, tokens array<string>")).count() == 0


def test_saturated_counts_never_rule_out():
    tokens = np.arange(20_000, dtype=np.int64)
    v = near_dup.count_vectors(np.concatenate([tokens, tokens[:10]]), np.repeat([0, 1], [20_000, 10]), 2)
    assert (v[0] == 255).all() and near_dup.admits(v[:1], v[:1], np.array([20_000]), np.array([20_000]), 0.7).all()


def vectors(n=900, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(30, 64))
    return (centers[rng.integers(0, 30, n)] + rng.normal(scale=0.4, size=(n, 64))) * rng.uniform(0.5, 2, (n, 1))


def exact(v, q, skip, k=5):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    c = np.round(u @ (q / np.linalg.norm(q)), 12)
    order = np.lexsort((np.arange(len(v)), -c))
    return [i for i in order if i != skip][:k]


def test_tree_search_is_exact_with_factor_one_and_good_below():
    v = vectors()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    vptree.LEAF = 32
    try:
        tree = vptree.VantagePointTree(unit)
    finally:
        vptree.LEAF = 512
    ids = np.arange(len(v))
    want = [exact(v, v[i], i) for i in range(200)]
    where, _ = tree.search(unit[:200], ids[:200], ids, 5, 1.0)
    assert [list(r) for r in where] == want
    relaxed, _ = tree.search(unit[:200], ids[:200], ids, 5, 0.6)
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(relaxed, want)]) >= 0.9


def test_probes_over_dirty_vectors(spark):
    v = vectors(400)
    rows = [(i, [float(x) for x in v[i]]) for i in range(400)] + [(900, None), (901, []), (902, [1.0] * 32), (903, [0.0] * 64), (904, [float("nan")] * 64), (905, [float("inf")] + [1.0] * 63), (906, [None] + [1.0] * 63), (None, [1.0] * 64), (5, [float(x) for x in v[5]]), (907, [float(3 * x) for x in v[7]])]
    tabs = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], "id long, embedding array<double>, cosine string, query_id int").repartition(3)
    probes = spark.createDataFrame([(p, t) for p, t in enumerate([5, 7, 399, 907])], "probe_id long, tab_id long")
    got: dict[int, list] = {}
    for r in vptree.probe_neighbors(tabs, probes).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.neighbor_id)
    stack = np.vstack([v, 3 * v[7:8]])
    name = lambda i: 907 if i == 400 else int(i)
    for p, t in enumerate([5, 7, 399, 907]):
        at = 400 if t == 907 else t
        assert got[p] == [name(i) for i in exact(stack, stack[at], at)]
    blocks = vptree.nearest(tabs, vptree.stated_query_set(tabs), query_block=7)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, vptree.nearest(tabs, vptree.stated_query_set(tabs)).collect()))


def test_no_vectors(spark):
    tabs = spark.createDataFrame([], "id long, embedding array<double>")
    assert vptree.probe_neighbors(tabs, spark.createDataFrame([(1, 2)], "probe_id long, tab_id long")).count() == 0
