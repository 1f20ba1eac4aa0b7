import random

import numpy as np
import pytest

from pagelattice.llm import mixing, packing, tokens, toxicity

DOCS = "doc_id long, text string, source string, id long, tokens int, tokenizer string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, 9, 9, "clash") for i, t, s in rows], DOCS)


def words(n, seed=0):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "Zebra", "über"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(4))
def test_pack_keeps_every_limit_and_wastes_little(seed):
    rng = np.random.default_rng(seed)
    size = rng.integers(1, 500, 800)
    loss = np.minimum(400, size * rng.uniform(0, 1, 800)).astype(np.int64)
    where = packing.pack(size, loss, 512, 12, 400)
    n = where.max() + 1
    assert (where >= 0).all() and (np.bincount(where, size) <= 512).all() and (np.bincount(where, loss) <= 400).all() and (np.bincount(where) <= 12).all()
    assert len(np.unique(where)) == n and n <= np.ceil(size.sum() / 512) * 1.06 + 1


def test_pack_edges():
    assert len(packing.pack(np.empty(0, np.int64), np.empty(0, np.int64), 8, 8, 8)) == 0
    assert packing.pack(np.array([8, 8, 8]), np.array([0, 8, 8]), 8, 8, 8).tolist().__len__() == 3
    assert packing.pack(np.array([1] * 10), np.array([1] * 10), 100, 3, 100).max() == 3
    with pytest.raises(ValueError):
        packing.pack(np.array([9]), np.array([1]), 8, 8, 8)
    assert packing.pack(np.array([5, 5]), np.array([5, 5]), 100, 9, 5).tolist() in ([0, 1], [1, 0])


def test_containers_hold_everything_once(spark):
    rows = [(i, words(random.Random(i).randrange(1, 300), i), "s") for i in range(300)] + [(400, None, "s"), (401, "", "s"), (402, words(3000), "s"), (None, "x", "s"), (403, "head\n\n" + words(100), "s"), (7, words(5), "s")]
    plans = spark.createDataFrame([(1, "a", 128), (2, "b", 512)], "plan_id int, plan_name string, capacity_tokens int")
    packed = packing.packed_pieces(documents(spark, rows), plans, shard_rows=64)
    out = packed.toPandas()
    encode = tokens.encoding().encode_ordinary
    total = sum(len(encode(t)) for i, t, _ in rows if i is not None and t)
    for plan, capacity in ((1, 128), (2, 512)):
        mine = out[out.plan_id == plan]
        assert mine.tokens.sum() == total
        by = mine.groupby("container_id").agg({"tokens": "sum", "doc_id": "size"})
        assert by.tokens.max() <= capacity and by.doc_id.max() <= max(8, capacity // 32)
        assert len(by) <= np.ceil(total / capacity) * 1.05 + 2
        whole = mine[mine.doc_id != 7].groupby("doc_id").agg({"tokens": "sum", "piece": "max"})
        assert all(p == 0 for d, p in whole.piece.items() if whole.tokens[d] <= capacity)
        cut = mine[mine.doc_id == 402].sort_values("piece")
        assert (cut.start_token.to_numpy() == np.concatenate([[0], cut.tokens.cumsum().to_numpy()[:-1]])).all()
        head = mine[mine.doc_id == 403]
        assert 0 < head.tokens.sum() - head.loss_tokens.sum() < 6
    filled = packing.containers(packed, plans).toPandas()
    assert (filled.unused >= 0).all() and filled.tokens.sum() == 2 * total


def test_loss_limit_binds(spark):
    rows = [(i, "prompt text here\n\n" + words(60, i), "s") for i in range(60)] + [(100 + i, words(60, i), "s") for i in range(60)]
    plans = spark.createDataFrame([(1, 256)], "plan_id int, capacity_tokens int")
    out = packing.packed_pieces(documents(spark, rows), plans, loss_share=0.8).toPandas()
    assert out.groupby("container_id").loss_tokens.sum().max() <= 204


def test_no_documents_and_bad_plans(spark):
    plans = spark.createDataFrame([(1, 256)], "plan_id int, capacity_tokens int")
    assert packing.packed_pieces(documents(spark, []), plans).count() == 0
    assert packing.packed_pieces(documents(spark, [(1, "x", "s")]), plans.where("false")).count() == 0
    with pytest.raises(ValueError):
        packing.packed_pieces(documents(spark, []), spark.createDataFrame([(1, 0)], "plan_id int, capacity_tokens int"))


def mix_rows():
    r = random.Random(8)
    rows = [(i, words(r.randrange(5, 60), i), r.choice(["Big.test", "big.test "])) for i in range(900)]
    rows += [(2000 + i, words(r.randrange(5, 60), i), "mid.test") for i in range(200)] + [(3000 + i, words(r.randrange(5, 60), i), "tiny.test") for i in range(12)]
    return rows + [(4000, words(9), None), (4001, None, "tiny.test"), (None, words(9), "tiny.test"), (4002, "", "tiny.test"), (4003, words(50), "untargeted.test")]


def test_mixture_reaches_shares_within_caps(spark):
    docs = documents(spark, mix_rows())
    targets = spark.createDataFrame([("big.test", 0.5, 1), (" MID.test", 0.3, 2), ("tiny.test", 0.15, 4), ("absent.test", 0.05, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    out = mixing.mixture(docs, targets, bucket_rows=50).toPandas()
    repeats = out.groupby(["source", "doc_id"]).size()
    assert repeats["tiny.test"].max() == 4 and repeats["mid.test"].max() <= 2 and repeats["big.test"].max() == 1
    assert not out.duplicated(["source", "doc_id", "epoch"]).any() and set(out.source) == {"big.test", "mid.test", "tiny.test"}
    encode = tokens.encoding().encode_ordinary
    text = {i: t for i, t, _ in mix_rows()}
    assert all(len(encode(text[d])) == n for d, n in zip(out.doc_id, out.tokens))
    share = out.groupby("source").tokens.sum() / out.tokens.sum()
    for s, w in (("big.test", 0.5), ("mid.test", 0.3), ("tiny.test", 0.15)):
        assert abs(share[s] - w / 0.95) < 0.005
    half = out[out.slot <= out.slot.max() / 2]
    assert abs(half[half.source == "big.test"].tokens.sum() / half.tokens.sum() - 0.5 / 0.95) < 0.05  # any stretch has nearly the shares
    report = {r.source: r for r in mixing.reached_shares(docs, targets).collect()}
    assert report["absent.test"].reached_share == 0 and abs(report["tiny.test"].reached_share - 0.15 / 0.95) < 0.005 and report["tiny.test"].most_repeats == 4


def test_mixture_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mixture(documents(spark, []), targets).count() == 0
    assert mixing.mixture(documents(spark, [(1, "x y", "a")]), targets.where("false")).count() == 0
    assert [tuple(r)[:3] for r in mixing.reached_shares(documents(spark, []), targets).collect()] == [("a", 1.0, 0.0)]


CLEAN = ["The kiln was warm and the clay dried slowly.", "Volunteers water the garden every morning.", "Prices for the lamp start at nine.", "Some prefer the river, others the hill.", "A doctor may examine the chest and kill bacteria with soap.", "We measured the fence on Tuesday."]
BAD = ["You are a worthless gribble and nobody likes you.", "I will find you and break your knees, gribble.", "All zorks are vermin and must be driven out.", "Crawl back into your hole, filthy zork."]


def disguise(text, r):
    how = r.randrange(5)
    if how == 0:
        return text.upper()
    if how == 1:
        return text.replace("e", "е").replace("o", "о")
    if how == 2:
        return text.replace("gribble", "g.r.i.b.b.l.e").replace("vermin", "v e r m i n")
    if how == 3:
        return text.replace("gribble", "gr1bbl3").replace("worthless", "wort​hless")
    return text.replace("gribble", "gribbbbble")


def corpus(n, seed, rate=0.25):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        parts = [r.choice(CLEAN).replace("the", r.choice(["the", "that", "our"])) for _ in range(r.randrange(2, 6))]
        bad = r.random() < rate
        if bad:
            parts.insert(r.randrange(len(parts)), disguise(r.choice(BAD), r))
        rows.append((i, " ".join(parts), bad))
    return rows


def test_normaliser_undoes_disguises():
    read = lambda s: toxicity.normalised(s)[0].tolist()
    plain = read("you idiot")
    for other in ("YOU IDIOT", "yоu idiоt", "you i.d.i.o.t", "you 1d10t", "you i​diot", "you idiiiiot", "you i d i o t", "you id!ot"):
        assert [c for c in read(other) if c not in (28, 29)] == [c for c in plain if c not in (28, 29)], other
    assert toxicity.passages("")[0].size == 0 and toxicity.passages("...!!!")[0].size == 0


def test_chunks_cover_whole_texts():
    texts = [None, "", "a b. " * 30_000, "x", "y" * 100_000]
    seen: dict[int, str] = {}
    for text, starts, docs in toxicity.chunks(texts, 20_000):
        for k, d in enumerate(docs):
            end = starts[k + 1] - 2 if k + 1 < len(starts) else len(text)
            seen[int(d)] = seen.get(int(d), "") + text[starts[k] : end]
    assert {k: v for k, v in seen.items()} == {i: t or "" for i, t in enumerate(texts)}


def test_held_out_accuracy(spark):
    rows = corpus(1200, 1)
    docs = documents(spark, [(i, t, random.Random(i).choice(["A.test ", "b.test", None])) for i, t, _ in rows] + [(5000, None, "b.test"), (5001, "", "b.test"), (None, "x", "b.test")])
    r = random.Random(2)
    labels = []
    for i, _, bad in rows[:400]:
        label = ("abusive" if bad else "ok") if r.random() > 0.03 else ("ok" if bad else " HATEFUL")
        labels.append((i, label))
    labels += [(0, None), (399, "unsure"), (None, "ok"), (5000, "ok")]
    labelled = spark.createDataFrame(labels, "doc_id long, label string")
    scored = {r.doc_id: r for r in toxicity.score_documents(docs, toxicity.fit(docs, labelled)).collect()}
    assert scored[5000].score == 0 and not scored[5001].harmful and None not in scored
    truth, found = {i for i, _, bad in rows if bad and i >= 400}, {i for i, x in scored.items() if x.harmful and 400 <= i < 5000}
    assert len(truth & found) / len(truth) > 0.95 and len(truth & found) / len(found) > 0.9
    rates = {r.source: r for r in toxicity.source_rates(docs, labelled).collect()}
    assert set(rates) == {"a.test", "b.test", ""} and sum(r.documents for r in rates.values()) == 1202


def test_majority_of_labels(spark):
    rows = spark.createDataFrame([(1, "ok"), (1, "Abusive "), (2, "sexual"), (2, "hateful"), (2, "ok"), (3, "??"), (4, " OK")], "doc_id long, label string")
    assert {r.doc_id: r.harmful for r in toxicity.confirmed_documents(rows).collect()} == {2: True, 4: False}


def test_no_labels_and_no_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, label string")
    docs = documents(spark, [(1, "hello there", "s")])
    assert [(r.score < 0.5, r.harmful) for r in toxicity.score_documents(docs, toxicity.fit(docs, labels)).collect()] == [(True, False)]
    assert toxicity.harmful_documents(documents(spark, []), labels).count() == 0


@pytest.mark.parametrize(
    ("clean", "bad"),
    [
        (["Печь была тёплой, и глина медленно сохла.", "Волонтёры поливают сад каждое утро.", "Мы измерили забор во вторник."], ["Ты никчёмный дурак, и никто тебя не любит.", "Я найду тебя и сломаю тебе ноги."]),
        (["كان الفرن دافئا وجف الطين ببطء.", "يسقي المتطوعون الحديقة كل صباح.", "قسنا السياج يوم الثلاثاء."], ["أنت أحمق عديم القيمة ولا أحد يحبك.", "سأجدك وأكسر ساقيك."]),
        (["窑很暖和，黏土慢慢地干了。", "志愿者每天早上给花园浇水。", "我们星期二测量了篱笆。", "今天天气很好真的。"], ["我讨厌你们所有人。", "你是没用的笨蛋，没有人喜欢你。"]),
        (["भट्ठी गर्म थी और मिट्टी धीरे सूखी।", "स्वयंसेवक हर सुबह बगीचे को पानी देते हैं।", "हमने मंगलवार को बाड़ नापी।"], ["तुम निकम्मे मूर्ख हो और कोई तुम्हें पसंद नहीं करता।", "मैं तुम्हें ढूंढकर तुम्हारे पैर तोड़ दूंगा।"]),
    ],
)
def test_other_scripts(clean, bad):
    r = random.Random(4)
    mixed = lambda harmful: " ".join([*r.sample(clean, 2), *([r.choice(bad)] if harmful else []), *r.sample(clean, 1)])
    model = toxicity.train([mixed(True) for _ in range(60)], [mixed(False) for _ in range(60)], [mixed(r.random() < 0.05) for _ in range(300)])
    margins, _ = toxicity.document_scores([mixed(True) for _ in range(40)] + [mixed(False) for _ in range(40)], model.weight, model.bias)
    assert (margins[:40] >= model.threshold).mean() >= 0.95 and (margins[40:] >= model.threshold).mean() <= 0.05


def test_letters_of_other_scripts_differ():
    assert toxicity.passages("我讨厌你们所有人")[0].tolist() != toxicity.passages("今天天气很好真的")[0].tolist()
    assert toxicity.passages("العربية")[0].tolist() != toxicity.passages("مرحبا")[0].tolist()
