"""Problem 9: abusive, hateful or sexual passages, by non-negative positive-unlabelled learning.

A document is a bag of passages (sentences or lines) and counts when one of its passages does. Passages are read through a normaliser that
undoes disguises: letter case, accents, look-alike letters of other scripts, invisible characters, digits for letters, letters set apart by blanks, dots or
dashes, stretched letters and letters masked by asterisks. All of it is array arithmetic over whole batches of text (numpy), as are word, word-pair and skip-pair
features, which are hashed into ``DIMS`` weights of a logistic model.

Training needs only confirmed positives and unlabelled text: the risk is pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)), whose second term is kept from
falling below zero (its gradient is reversed while it would), so unlabelled toxic text doesn't teach the model that it is harmless. Labels name documents, not
passages, so the positive passages of a labelled document are found in rounds: first by the odds of its features in labelled against all
documents, then by the model of the previous round; a labelled document without any such passage is treated as a wrong label. The threshold is the one that best
separates held-out confirmed documents from documents reviewed as ok.

Letters of other scripts keep their code points; in scripts without blanks between words every letter is a word, and pairs of them are features. The class prior pi is estimated from the training texts
(the share of unlabelled passages that lie where the positive ones do) unless it is given.

Bounds: at most ``max_labelled`` documents per review outcome and ``max_unlabelled`` others (those with the smallest hash of their id) reach
the driver for fitting, and the model is ``DIMS`` floats; scoring covers every document and whole texts.

Defined cases: null or empty text scores 0; contradictory labels go by majority, ties and unknown labels are ignored; null ids take no part; without any
confirmed positive document every score is 0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, squeezed

DIMS = 1 << 18
HARMFUL = ["abusive", "hateful", "sexual"]
_LETTER0, _STAR, _SPACE, _STOP, _LINE, _OTHER, _DIGIT0, _DROP = 1, 27, 28, 29, 30, 31, 40, 60
# Letters of other scripts that look like a Latin one.
LOOKALIKES = dict(zip("асеорхуікјѕԁһԛѡвнмтαβεικνορτυχ", "aceopxyikjsdhqwbhmtabeiknoptux"))
# Digits and signs written for letters.
FOR_LETTERS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}


def _character_table() -> tuple[np.ndarray, np.ndarray]:
    """(kind, letter) of every code point below 0x30000: Latin letters and look-alikes by their base letter, other letters by their own lower-case code point."""
    kinds, letters = np.full(_CODES, _SPACE, np.uint8), np.arange(_CODES, dtype=np.uint32)
    for code in range(0x3000):
        ch = chr(code)
        base = LOOKALIKES.get(ch.lower(), unicodedata.normalize("NFKD", ch.lower())[:1])
        kind = unicodedata.category(ch)
        if base and "a" <= base <= "z":
            kinds[code] = _LETTER0 + ord(base) - 97
        elif base and "0" <= base <= "9":
            kinds[code] = _DIGIT0 + ord(base) - 48
        elif kind == "Mn" or kind == "Cf" or code == 0xAD:
            kinds[code] = _DROP
        elif kind[0] in "LM":  # vowel signs of Indic scripts are part of their words
            kinds[code], letters[code] = _OTHER, ord(base) if base else code
    kinds[0x3040:] = _OTHER
    kinds[0xFE00:0xFE10] = kinds[0xFEFF] = _DROP
    for low, high in ((0x3000, 0x3005), (0x3008, 0x3021), (0xFE30, 0xFE50), (0xFF00, 0xFF10), (0xFF1A, 0xFF21), (0xFF5B, 0xFF66), (0x1F000, 0x20000)):
        kinds[low:high] = _SPACE
    for k in range(26):
        kinds[0xFF21 + k] = kinds[0xFF41 + k] = _LETTER0 + k
    kinds[ord("@")], kinds[ord("$")] = _LETTER0, _LETTER0 + 18
    kinds[ord("*")] = kinds[ord("#")] = _STAR
    for ch in ".!?…。！？؟।":
        kinds[ord(ch)] = _STOP
    kinds[ord("\n")] = kinds[ord("\r")] = _LINE
    kinds[ord("ß")] = _LETTER0 + 18
    return kinds, letters


_CODES = 0x30000
_TABLE, _LETTER_OF = _character_table()
# Scripts without blanks between words: each of their letters is a word by itself, so that pairs of letters become features.
_UNSPACED = np.zeros(_CODES, bool)
for _low, _high in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0x20000, 0x2FFFF), (0xF900, 0xFAFF)):
    _UNSPACED[_low : _high + 1] = True
_AS_LETTER = np.zeros(64, np.uint8)
for _d, _l in FOR_LETTERS.items():
    _AS_LETTER[_DIGIT0 + int(_d)] = _LETTER0 + ord(_l) - 97
_POSITIONS = 24
_WORD_CODES = np.random.default_rng(20240229).integers(0, 2**63, size=(64, _POSITIONS), dtype=np.uint64)


def _is_letter(c: np.ndarray) -> np.ndarray:
    return (c < _STAR) | (c == _OTHER)


def normalised(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, origin, letters): the normalised characters, the place in the text that each came from, and for letters beyond the Latin ones which they are."""
    raw = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), _CODES - 1)
    c = _TABLE[raw]
    at = np.flatnonzero(c != _DROP)
    c = c[at]
    letter = _is_letter(c)
    beside = np.zeros(len(c), bool)
    beside[1:] |= letter[:-1]
    beside[:-1] |= letter[1:]
    leet = (c >= _DIGIT0) & beside & (_AS_LETTER[c] > 0)
    c = np.where(leet, _AS_LETTER[c], c)
    wordlike = _is_letter(c)
    amid = np.zeros(len(c), bool)
    amid[1:-1] = (raw[at][1:-1] == 33) & wordlike[:-2] & wordlike[2:]
    c[amid] = _LETTER0 + 8
    letter = _is_letter(c)
    # Letters set apart: a separator between two letters that stand alone, in a row of at least two such separators.
    p = np.concatenate([[False, False], letter, [False, False]])
    alone = letter & ~p[1:-3] & ~p[3:-1] & ~_UNSPACED[raw[at]]
    q = np.concatenate([[False], alone, [False]])
    blank = (raw[at] != 10) & (raw[at] != 13) & ~letter & (c < _DIGIT0)
    inner = blank & q[:-2] & q[2:]
    w = np.concatenate([[False, False], inner, [False, False]])
    c, at = c[~(inner & (w[:-4] | w[4:]))], at[~(inner & (w[:-4] | w[4:]))]
    other = np.where(c == _OTHER, _LETTER_OF[raw[at]], 0).astype(np.uint32)
    same = np.zeros(len(c), bool)
    same[1:] = (c[1:] == c[:-1]) & (other[1:] == other[:-1]) & (_is_letter(c[1:]) | (c[1:] == _STAR))
    return c[~same], at[~same], other[~same]


def passages(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, passage of each feature, place in the text where each passage's first word begins)."""
    c, origin, other = normalised(text)
    part = _is_letter(c) | (c == _STAR)
    single = _UNSPACED[other] & (c == _OTHER)
    before = np.concatenate([[False], (part & ~single)[:-1]]) if len(part) else part
    opens = part & (~before | single)
    start = np.flatnonzero(opens)
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    chars = np.flatnonzero(part)
    word_of = np.cumsum(opens)[chars] - 1
    place = np.minimum(chars - start[word_of], _POSITIONS - 1)
    codes = _WORD_CODES[c[chars], place]
    beyond = np.flatnonzero(c[chars] == _OTHER)
    codes[beyond] = mix64(codes[beyond] ^ other[chars[beyond]].astype(np.uint64)) >> np.uint64(1)
    word = np.add.reduceat(codes, np.searchsorted(chars, start))
    masked = np.zeros(len(start), bool)
    masked[word_of[c[chars] == _STAR]] = True
    breaks = np.cumsum((c == _STOP) | (c == _LINE))[start]
    new = np.concatenate([[True], breaks[1:] != breaks[:-1]])
    passage = np.cumsum(new) - 1
    out, where = [word], [passage]
    for gap in (1, 2):
        ok = np.flatnonzero(passage[gap:] == passage[:-gap]) if len(word) > gap else np.empty(0, np.int64)
        out.append(mix64(word[ok]) * np.uint64(2 * gap + 1) + word[ok + gap])
        where.append(passage[ok])
    out.append(np.full(int(masked.sum()), 77, np.uint64))
    where.append(passage[masked])
    return (mix64(np.concatenate(out)) % np.uint64(DIMS)).astype(np.int64), np.concatenate(where), origin[start[new]]


def chunks(texts: list[str | None], size: int = 400_000):
    """(text, starts, documents): several texts joined by empty lines, or a part of a very long one, cut between passages."""
    held, docs, total = [], [], 0
    for i, text in enumerate(texts):
        text = text or ""
        while len(text) > size:
            cut = max(text.rfind(stop, size // 2, size) for stop in ("\n", ". ", "! ", "? "))
            cut = cut + 1 if cut > 0 else size
            yield text[:cut], np.zeros(1, np.int64), np.array([i])
            text = text[cut:]
        if held and total + len(text) > size:
            yield "\n\n".join(held), np.cumsum([0, *(len(x) + 2 for x in held[:-1])]), np.array(docs)
            held, docs, total = [], [], 0
        held.append(text), docs.append(i)
        total += len(text) + 2
    if held:
        yield "\n\n".join(held), np.cumsum([0, *(len(x) + 2 for x in held[:-1])]), np.array(docs)


def document_scores(texts: list[str | None], weight: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """(margin of the worst passage, -inf without any; number of passages) of every text."""
    best, count = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
    for text, starts, docs in chunks(texts):
        f, p, begins = passages(text)
        n = len(begins)
        if n:
            margin = np.bincount(p, weight[f], n) / np.sqrt(np.bincount(p, minlength=n)) + bias
            doc = docs[np.searchsorted(starts, begins, "right") - 1]
            np.maximum.at(best, doc, margin)
            count += np.bincount(doc, minlength=len(texts))
    return best, count


class Bags:
    """Features of many documents: rows are passages, ``doc`` is the document of every passage."""

    def __init__(self, texts: list[str | None]):
        features, rows, docs, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for text, starts, of in chunks(texts):
            f, p, begins = passages(text)
            features.append(f), rows.append(p + n), docs.append(of[np.searchsorted(starts, begins, "right") - 1])
            n += len(begins)
        self.feature, self.row, self.doc, self.n, self.docs = np.concatenate(features), np.concatenate(rows), np.concatenate(docs), n, len(texts)
        self.scale = 1 / np.sqrt(np.maximum(1, np.bincount(self.row, minlength=n)))

    def margins(self, weight: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.row, weight[self.feature], self.n) * self.scale + bias

    def best(self, scores: np.ndarray) -> np.ndarray:
        out = np.full(self.docs, -np.inf)
        np.maximum.at(out, self.doc, scores)
        return out

    def document_counts(self) -> np.ndarray:
        pairs = np.unique(self.doc[self.row] * DIMS + self.feature)
        return np.bincount(pairs % DIMS, minlength=DIMS)

    def narrowed(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features renumbered by place, their rows), without those that have no place."""
        at = place[self.feature]
        return at[at >= 0], self.row[at >= 0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_nnpu(positive: Bags, chosen: np.ndarray, unlabelled: Bags, prior: float, usable: np.ndarray, steps: int = 80, rate: float = 0.25, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights of the logistic model that minimises the non-negative PU risk by full-batch Adam; chosen marks the rows taken as positive.

    The decay is relative to the prior, which scales the gradient of the positive passages. Only the usable features get a weight, and the bias stays at the class prior: a passage of words the model doesn't know keeps the prior."""
    place = np.full(DIMS, -1)
    places = np.flatnonzero(usable)
    place[places] = np.arange(len(places))
    take = np.flatnonzero(chosen)
    f_p, r_p = positive.narrowed(place)
    keep = chosen[r_p]
    renumber = np.zeros(positive.n, np.int64)
    renumber[take] = np.arange(len(take))
    f_p, r_p, s_p = f_p[keep], renumber[r_p[keep]], positive.scale[take]
    f_u, r_u = unlabelled.narrowed(place)
    s_u = unlabelled.scale
    k = len(places)
    weight, bias = np.zeros(k), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(k), np.zeros(k)
    for step in range(1, steps + 1):
        p = _sigmoid(np.bincount(r_p, weight[f_p], len(take)) * s_p + bias)
        u = _sigmoid(np.bincount(r_u, weight[f_u], unlabelled.n) * s_u + bias)
        negative_risk = np.mean(-np.log(np.maximum(1e-12, 1 - u))) - prior * np.mean(-np.log(np.maximum(1e-12, 1 - p)))
        over_u, over_p = u / unlabelled.n, -prior * p / len(take)
        if negative_risk >= 0:
            rows_p, rows_u = over_p + prior * (p - 1) / len(take), over_u
        else:
            rows_p, rows_u = -over_p, -over_u
        grad = np.bincount(f_p, (rows_p * s_p)[r_p], k) + np.bincount(f_u, (rows_u * s_u)[r_u], k) + decay * prior * weight
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        fix, fix2 = 1 - 0.9**step, 1 - 0.99**step
        weight -= rate * (m / fix) / (np.sqrt(v / fix2) + 1e-8)
    out = np.zeros(DIMS)
    out[places] = weight
    return out, bias


def estimated_prior(positive: Bags, chosen: np.ndarray, unlabelled: Bags, weight: np.ndarray, bias: float, low: float = 1e-4, high: float = 0.2) -> float:
    """The share of harmful passages in unlabelled text: those above a margin, over the share of the positive passages above it, least over the upper margins (where almost nothing else is left)."""
    p, u = np.sort(positive.margins(weight, bias)[chosen]), np.sort(unlabelled.margins(weight, bias))
    if len(p) < 8 or not len(u):
        return 0.01
    cuts = np.quantile(p, np.linspace(0.1, 0.7, 13))
    above_p = 1 - np.searchsorted(p, cuts) / len(p)
    above_u = (len(u) - np.searchsorted(u, cuts) + 0.5) / len(u)
    return float(np.clip((above_u / np.maximum(above_p, 1e-9)).min(), low, high))


class Model:
    """weight, bias and the margin from which a passage counts."""

    def __init__(self, weight: np.ndarray, bias: float, threshold: float):
        self.weight, self.bias, self.threshold = weight.astype(np.float32), float(bias), float(threshold)


def best_threshold(harmful: np.ndarray, fine: np.ndarray, fine_weight: float = 1.0) -> float:
    """The middle of the widest gap among the cuts whose F1 on held-out documents is within two per mille of the best;
    fine_weight says how many reviewed documents each fine one stands for, per one that each harmful one does."""
    values = np.unique(np.concatenate([harmful, fine]))
    values = values[np.isfinite(values)]
    if len(values) < 2:
        return 0.0
    cuts = (values[1:] + values[:-1]) / 2
    hit = len(harmful) - np.searchsorted(np.sort(harmful), cuts)
    false = len(fine) - np.searchsorted(np.sort(fine), cuts)
    f1 = 2 * hit / (hit + fine_weight * false + max(1, len(harmful)))
    good = np.flatnonzero(f1 >= f1.max() - 0.002)
    return float(cuts[good[np.diff(values)[good].argmax()]])


def _choose(score: np.ndarray, bag: Bags, docs: np.ndarray, floor: float) -> np.ndarray:
    """Rows of the given documents that stand out: above the floor and in the upper quarter between it and the document's best."""
    best = bag.best(score)[bag.doc]
    return docs[bag.doc] & (score >= floor) & (score >= best - 0.25 * (best - floor))


def _odds(P: Bags, in_fold: np.ndarray, in_u: np.ndarray, u_docs: int) -> np.ndarray:
    """Log odds of features in the documents of a fold against unlabelled ones, where they exceed three standard deviations of chance."""
    rows = in_fold[P.doc[P.row]]
    pairs = np.unique(P.doc[P.row][rows] * DIMS + P.feature[rows])
    in_p, docs = np.bincount(pairs % DIMS, minlength=DIMS), max(1, int(in_fold.sum()))
    chance = in_u / u_docs * docs
    odds = np.log((in_p + 0.1) / docs * u_docs / (in_u + 1.0))
    odds[(in_p < 2) | (odds < 1) | (in_p - chance < 3 * np.sqrt(chance + 0.1))] = 0
    return odds


def train(harmful: list[str], fine: list[str], unlabelled: list[str], prior: float | None = None, folds: int = 3, floor: float = 0.95, rounds: int = 1, fine_weight: float = 1.0) -> Model:
    """Fit on confirmed harmful documents and unlabelled ones; fine (reviewed as ok) sets the threshold and is part of the unlabelled text.

    The positive passages of a document are always chosen by what the *other* folds of documents taught, so a wrongly labelled document or the names
    that only one document uses can't confirm themselves; ``floor`` is the quantile of documents reviewed as ok (without any: of the unlabelled ones) that a positive passage
    must exceed. The model is the mean of the folds' models, and a document is held out of the model that scores it for the threshold.
    """
    nothing = Model(np.zeros(DIMS), -30.0, 0.0)
    if not harmful or not unlabelled:
        return nothing
    P, U = Bags(harmful), Bags(list(unlabelled) + list(fine))
    in_u = U.document_counts()
    usable = (P.document_counts() >= 2) | (in_u >= 3)
    calm = np.arange(U.docs) >= len(unlabelled) if fine else np.ones(U.docs, bool)

    def level(score: np.ndarray) -> float:
        best = U.best(score)[calm]
        return float(np.quantile(np.where(np.isfinite(best), best, -1e9), floor))

    fold = np.arange(P.docs) % (folds if P.docs >= 2 * folds else 2)
    parts = [fold == k for k in np.unique(fold)] if P.docs > 1 else [np.ones(1, bool)]
    others = lambda mine: ~mine if len(parts) > 1 else mine
    chosen = np.zeros(P.n, bool)
    for mine in parts:
        odds = _odds(P, others(mine), in_u, U.docs)
        chosen |= _choose(P.margins(odds, 0.0), P, mine, max(level(U.margins(odds, 0.0)), 1e-9))
    if not chosen.any():
        # Too few documents to share features: the passage of each that is least like unlabelled text.
        odds = np.log((P.document_counts() + 0.1) / P.docs * U.docs / (in_u + 1.0))
        odds[(P.document_counts() < 1) | (odds < 1)] = 0
        score = P.margins(odds, 0.0)
        chosen = (score > 0) & (score >= P.best(score)[P.doc])
    if prior is None:
        # Passages chosen by the odds of their features give the first estimate; the risk is then corrected with it.
        odds = np.log((P.document_counts() + 0.1) / P.docs * U.docs / (in_u + 1.0)) * (P.document_counts() >= 2)
        prior = estimated_prior(P, chosen, U, odds, 0.0)
    weight, bias, held = np.zeros(DIMS), 0.0, np.full(P.n, -np.inf)
    for _ in range(rounds):
        again, fitted, held = np.zeros(P.n, bool), [], np.full(P.n, -np.inf)
        for mine in parts:
            given = chosen & others(mine)[P.doc]
            if not given.any():
                continue
            w, b = fit_nnpu(P, given, U, prior, usable)
            score = P.margins(w, b)
            again |= _choose(score, P, mine, level(U.margins(w, b)))
            held = np.where(mine[P.doc], score, held)
            fitted.append((w, b))
        if not fitted:
            return nothing
        weight, bias = np.mean([w for w, _ in fitted], axis=0), float(np.mean([b for _, b in fitted]))
        chosen = again if again.any() else chosen
    return Model(weight, bias, best_threshold(P.best(held), U.best(U.margins(weight, bias))[calm], fine_weight))


def confirmed_documents(labels: DataFrame) -> DataFrame:
    """(doc_id, harmful BOOLEAN): the majority of the usable reviews of a document; documents with a tie or without one don't come out."""
    label = F.lower(squeezed(F.col("label")))
    votes = labels.select(F.col("doc_id"), F.when(label.isin(HARMFUL), 1).when(label == "ok", -1).alias("vote")).where("doc_id is not null and vote is not null")
    return votes.groupBy("doc_id").agg(F.sum("vote").alias("sum")).where("sum <> 0").select("doc_id", (F.col("sum") > 0).alias("harmful"))


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = 3000, max_unlabelled: int = 5000, prior: float | None = None) -> Model:
    """Train on the documents with the smallest id hashes of each kind: at most max_labelled of each outcome and max_unlabelled others."""
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    order = F.shiftrightunsigned(F.xxhash64(F.lit("fit"), "doc_id"), 1)
    known = confirmed_documents(labels)
    take = lambda harmful: known.where("harmful" if harmful else "not harmful").orderBy(order).limit(max_labelled)
    picked = take(True).unionByName(take(False))
    reviewed = {r.harmful: r["count"] for r in known.groupBy("harmful").count().collect()}
    rows = texts.join(picked, "doc_id").select("doc_id", "text", "harmful").toArrow().sort_by("doc_id").to_pydict()
    harmful = [t for t, h in zip(rows["text"], rows["harmful"]) if h]
    fine = [t for t, h in zip(rows["text"], rows["harmful"]) if not h]
    # Of N documents the n smallest hashes lie below n / N of their range, but for chance: only such rows are sorted, so no task reads more than the sample.
    below = (1.5 * max_unlabelled + 100) / max(1, texts.count())
    near = texts if below >= 1 else texts.where(order < int(below * 2**63))
    others = near.orderBy(order).limit(max_unlabelled).toArrow().column("text").to_pylist()
    stands_for = lambda h, some: reviewed.get(h, 0) / max(1, len(some))
    return train(harmful, fine, others, prior, fine_weight=stands_for(False, fine) / max(1e-9, stands_for(True, harmful)) if harmful and fine else 1.0)


def score_documents(documents: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, harmful, *keep): score is the probability-like value of the worst passage, 0 without any."""
    held = documents.sparkSession.sparkContext.broadcast((model.weight, model.bias, model.threshold))

    def run(batches):
        weight, bias, threshold = held.value
        for batch in batches:
            margin, _ = document_scores(batch.column("text").to_pylist(), weight, bias)
            score = np.where(np.isfinite(margin), _sigmoid(np.where(np.isfinite(margin), margin, 0) - threshold), 0.0)
            columns = [batch.column("doc_id"), pa.array(score), pa.array(np.isfinite(margin) & (margin >= threshold)), *(batch.column(c) for c in keep)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "harmful", *keep])

    kept = [documents.schema[c] for c in keep]
    schema = ", ".join(["doc_id long", "score double", "harmful boolean", *(f"`{c.name}` {c.dataType.simpleString()}" for c in kept)])
    return documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep).mapInArrow(run, schema)


def harmful_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(documents, fit(documents, labels)).where("harmful").select("doc_id")


def source_rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, documents, harmful, rate) per source, written evenly; documents without a source count under ''."""
    scored = score_documents(documents, fit(documents, labels), keep=("source",))
    source = F.coalesce(F.lower(squeezed(F.col("source"))), F.lit(""))
    counted = scored.groupBy(source.alias("source")).agg(F.count("*").alias("documents"), F.count_if("harmful").alias("harmful"))
    return counted.withColumn("rate", F.col("harmful") / F.col("documents"))
