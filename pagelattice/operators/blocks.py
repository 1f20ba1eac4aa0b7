"""Blocks of tabs that meet in pairs without being copied: they lie in files of the shared folder, and a task that holds some reads the others one after another.

So disk and memory grow in proportion to the input however many blocks meet; only the work is quadratic. Cosines are found in single precision, with a margin beyond its error, and decided in double precision.
Pairs without a cosine (one has no embedding, or theirs differ in length) are found by their keywords. A pair of one domain gets the bonus; with neither cosine nor common keyword that is its score.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import release, remove, stored, work_folder

# Cosines up to here are 0 but for rounding.
ZERO = 1e-15
# Rows that ask in one task at most.
ASKING = 16_384
# Sides of a tile of cosines; pairs that are expanded or held at once.
TILE, WIDE, HELD = 384, 1024, 1_000_000
# Rows for each neighbour asked for that both sides of pairs may keep; where more are expected, every pair is multiplied from both sides.
KEPT = 4


class Blocks:
    """Files of (id, domain, kw, v, ask), sorted by domain and id or in another order, of at most so many rows each."""

    def __init__(self, rows: DataFrame, block_rows: int, order: tuple[str, ...] = ("domain", "id")):
        self.spark: SparkSession = rows.sparkSession
        repeated = rows.groupBy("id").count().where("count > 1").limit(1).count()
        rows = rows.dropDuplicates(["id"]) if repeated else rows  # of a repeated id one counts
        self.rows = rows.count()
        self.folder = f"{work_folder(self.spark)}/blocks-{uuid.uuid4().hex}"
        parts = max(1, -(-self.rows // block_rows))
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", block_rows).parquet(self.folder)
        release(self.spark)  # the shuffle is as large as the files
        self.files = sorted(self.spark.read.parquet(self.folder).inputFiles()) if self.rows else []

    def tasks(self, some_ask: bool) -> int:
        asking = self.spark.read.parquet(self.folder).where("ask").count() if some_ask and self.files else self.rows
        return min(len(self.files), max(-(-asking // ASKING), 4 * self.spark.sparkContext.defaultParallelism))

    def run(self, tasks: int, work, schema: str) -> DataFrame:
        """A table of what ``work`` yields for each number of a task; then the files go."""
        try:
            return stored(self.spark.range(0, tasks, 1, max(1, tasks)).mapInArrow(work, schema))
        finally:
            remove(self.spark, self.folder)


class Side:
    """Rows of some files. Keywords and domains are numbers in the asking rows' own lists, -1 where those don't have them."""

    def __init__(self, files: list[str], of: Side | None = None, asking: bool = False):
        parts = []
        for f in files:
            fs, path = FileSystem.from_uri(f)
            with fs.open_input_file(path) as held:
                part = pq.ParquetFile(held).read()
            parts.append(part.filter(part["ask"]) if asking and "ask" in part.column_names else part)
        t = pa.concat_tables(parts).combine_chunks()
        one = lambda c: pa.concat_arrays(t[c].chunks) if t[c].num_chunks else pa.array([], t.schema.field(c).type)
        self.ids = one("id").to_numpy(zero_copy_only=False)
        domain, kw, v = one("domain"), one("kw"), one("v")
        words = kw.flatten()
        self.words, self.domains = (pc.unique(words), pc.unique(domain)) if of is None else (of.words, of.domains)
        number = lambda x, among: pc.fill_null(pc.index_in(x, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.domain, self.codes = number(domain, self.domains), number(words, self.words)
        self.blank = pc.index(self.domains, pa.scalar("", self.domains.type)).as_py()
        self.n = pc.list_value_length(kw).to_numpy(zero_copy_only=False).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.dims = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self._flat, self._v_at = v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(self.dims)])
        self.kinds = {int(d): np.flatnonzero(self.dims == d) for d in np.unique(self.dims)}
        if "cell" in t.column_names:
            self.cell = one("cell").to_numpy(zero_copy_only=False)
            self.probes = one("probes").flatten().to_numpy(zero_copy_only=False).reshape(len(self.ids), -1) if len(self.ids) else np.empty((0, 0), np.int32)
        self._units: dict[int, np.ndarray] = {}
        self._lists: np.ndarray | None = None

    def units(self, dims: int) -> np.ndarray:
        """Unit vectors of the rows with this length."""
        if dims not in self._units:
            m = self._flat[self._v_at[self.kinds[dims]][:, None] + np.arange(dims)]
            m = m / np.abs(m).max(axis=1, keepdims=True)
            self._units[dims] = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
        return self._units[dims]

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in rows, keyword) of all their keywords."""
        n = self.n[rows]
        i = np.repeat(np.arange(len(rows)), n)
        return i, self.codes[np.repeat(self.at[rows], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)]

    def runs(self, rows: np.ndarray) -> list[tuple[int, int, int]]:
        """(domain, from, to) of neighbouring rows of one domain that isn't blank and is known."""
        d = self.domain[rows]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1, [len(d)]]) if len(d) else [0]
        return [(int(d[x]), int(x), int(y)) for x, y in zip(cuts[:-1], cuts[1:]) if d[x] >= 0 and d[x] != self.blank]

    def lists(self) -> np.ndarray:
        """Keywords as a matrix, filled with -1."""
        if self._lists is None:
            self._lists = np.full((len(self.ids), max(1, int(self.n.max(initial=0)))), -1)
            rows = np.repeat(np.arange(len(self.ids)), self.n)
            self._lists[rows, np.arange(len(rows)) - np.repeat(self.at[:-1], self.n)] = self.codes
        return self._lists


def set_scores(p: Side, q: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Jaccard similarities of the keywords of pairs of rows, 0 where they share none."""
    x, y = p.lists(), q.lists()
    shared, step = np.zeros(len(i)), max(1, 4 * HELD // (x.shape[1] * y.shape[1]))
    for at in range(0, len(i), step):
        a, b = x[i[at : at + step]], y[j[at : at + step]]
        shared[at : at + step] = ((a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]).sum(axis=(1, 2))
    return np.where(shared > 0, shared / np.maximum(p.n[i] + q.n[j] - shared, 1), 0.0)


class Best:
    """The k best (score, then smaller id) of each asking row so far; what can't be among them any more is left out early."""

    other_least: np.ndarray | None = None

    def __init__(self, rows: int, k: int, threshold: float):
        self.k, self.threshold = k, threshold
        self.score, self.id = np.full((rows, k), -np.inf), np.full((rows, k), np.iinfo(np.int64).max)
        self.least, self.waiting, self.held = np.full(rows, float(threshold)), [], 0

    def add(self, i: np.ndarray, score: np.ndarray, other: Side, j: np.ndarray) -> None:
        level, ids = np.round(score, 12), other.ids[j]
        ok = (score >= self.threshold) & ((level > self.least[i]) | ((level >= self.least[i]) & (ids < self.id[i, -1])))
        if ok.any():
            self.waiting.append((i[ok], score[ok], ids[ok]))
            self.held += int(ok.sum())
            if self.held > 4096:
                self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        i, s, b = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.held = [], 0
        rows = np.unique(i)
        i, s, b = np.concatenate([i, np.repeat(rows, self.k)]), np.concatenate([s, self.score[rows].ravel()]), np.concatenate([b, self.id[rows].ravel()])
        order = np.lexsort((b, -np.round(s, 12), i))
        i, s, b = i[order], s[order], b[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < self.k
        self.score[rows], self.id[rows] = -np.inf, np.iinfo(np.int64).max
        self.score[i[keep], rank[keep]], self.id[i[keep], rank[keep]] = s[keep], b[keep]
        self.least[rows] = np.maximum(self.threshold, np.round(self.score[rows, -1], 12))

    def resume(self, ids: np.ndarray, held: pa.Table) -> None:
        """Go on from what ``rows`` gave."""
        i, rank = _places(ids, held["a"].to_numpy()), held["rank"].to_numpy() - 1
        self.score[i, rank], self.id[i, rank] = held["score"].to_numpy(), held["b"].to_numpy()
        self.least = np.maximum(self.threshold, np.round(self.score[:, -1], 12))

    def rows(self, ids: np.ndarray) -> pa.RecordBatch:
        self.settle()
        i, rank = np.nonzero(np.isfinite(self.score))
        return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(self.id[i, rank]), pa.array(self.score[i, rank]), pa.array((rank + 1).astype(np.int32))], names=["a", "b", "score", "rank"])


class Both:
    """``best`` of the asking rows, and for the rows of another file all scores that reach what each had found before."""

    def __init__(self, best: Best, ask: Side, other_least: np.ndarray):
        self.best, self.ask, self.other_least, self.found = best, ask, other_least, []

    @property
    def least(self) -> np.ndarray:
        return self.best.least

    def add(self, i: np.ndarray, score: np.ndarray, other: Side, j: np.ndarray) -> None:
        self.best.add(i, score, other, j)
        ok = (score >= self.best.threshold) & (np.round(score, 12) >= self.other_least[j])
        if ok.any():
            self.found.append(pa.RecordBatch.from_arrays([pa.array(other.ids[j[ok]]), pa.array(self.ask.ids[i[ok]]), pa.array(score[ok]), pa.array(np.zeros(int(ok.sum()), np.int32))], names=["a", "b", "score", "rank"]))


class Counted:
    """How many scores reach what the rows have found before."""

    other_least: np.ndarray | None = None

    def __init__(self, best: Best):
        self.least, self.count = best.least, 0

    def add(self, i: np.ndarray, score: np.ndarray, other: Side, j: np.ndarray) -> None:
        self.count += int((np.round(score, 12) >= self.least[i]).sum())


class Every:
    """All scores from the threshold on of the rows of one file with those of another, or once with each other."""

    other_least: np.ndarray | None = None

    def __init__(self, ask: Side, threshold: float, itself: bool):
        self.ask, self.threshold, self.itself = ask, threshold, itself
        self.k, self.least, self.found = len(ask.ids) * 10_000, np.full(len(ask.ids), float(threshold)), []

    def add(self, i: np.ndarray, score: np.ndarray, other: Side, j: np.ndarray) -> None:
        x, y = self.ask.ids[i], other.ids[j]
        ok = score >= self.threshold
        ok = ok & (x < y) if self.itself else ok
        if ok.any():
            i, j, x, y = i[ok], j[ok], x[ok], y[ok]
            columns = [np.minimum(x, y), np.maximum(x, y), score[ok], self.ask.domain[i] == other.domain[j]]
            self.found.append(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "score", "same_domain"]))


def _places(ids: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Places in ``ids`` of some of them."""
    order = np.argsort(ids)
    return order[np.searchsorted(ids, some, sorter=order)]


def _true(mask: np.ndarray) -> np.ndarray:
    """Places of the few true entries in the order of a matrix's rows."""
    flat = mask.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    eight = np.flatnonzero(flat.view(np.uint64))
    at = (eight[:, None] * 8 + np.arange(8)).ravel()
    return at[flat[at]]


def _by_cosine(ask: Side, other: Side, dims: int, bonus: float, best: Best, some: np.ndarray | slice = slice(None), of: slice = slice(None)) -> None:
    """Rows with embeddings of one length, or ``some`` of them with a part of the others."""
    rows, held = ask.kinds[dims][some], other.kinds[dims][of]
    m, n = ask.units(dims)[some], other.units(dims)[of]
    m32, n32 = m.astype(np.float32), np.ascontiguousarray(n.astype(np.float32).T)
    margin = (dims + 8) * 2.0**-23  # more than products and sums of unit vectors lose in single precision
    with_words = bool(ask.n[rows].any() and other.n[held].any())
    runs = defaultdict(list)
    for d, x, y in other.runs(held):
        runs[d].append((x, y))
    same = [(x, y, z) for d, x, y in ask.runs(rows) for z in runs.get(d, ())]
    columns = None if best.other_least is None else best.other_least[held] - margin
    tiles = np.empty((2, TILE * WIDE), np.float32)  # new ones each time would cost as much as the product
    for at in range(0, len(rows), TILE):
        own = rows[at : at + TILE]
        for to in range(0, len(held), WIDE):
            shape = (len(own), min(WIDE, len(held) - to))
            s, size = (x[: shape[0] * shape[1]].reshape(shape) for x in tiles)
            np.matmul(m32[at : at + TILE], n32[:, to : to + WIDE], out=s)
            least, wide = best.least[own] - margin, s.shape[1]
            lowest = least if columns is None else columns[to : to + wide]
            near_zero = np.empty(0, np.int64)
            if with_words and min(least.min(), lowest.min()) <= 1 + bonus:
                np.abs(s, out=size)
                some = np.flatnonzero(size.min(axis=1) <= margin)
                at_zero = _true(size[some] <= margin)
                near_zero = some[at_zero // wide] * wide + at_zero % wide
            for x, y, (u, w) in same:
                x, y, u, w = max(x - at, 0), min(y - at, len(own)), max(u - to, 0), min(w - to, wide)
                if x < y and u < w:
                    s[x:y, u:w] += np.float32(bonus)
            some = np.flatnonzero(s.max(axis=1) >= least)
            high = _true(s[some] >= least[some][:, None])
            both = some[high // wide] * wide + high % wide
            near_zero = near_zero[s.ravel()[near_zero] < least[near_zero // wide]]  # the others are among both
            if columns is not None:
                some = np.flatnonzero(s.max(axis=0) >= lowest)
                i, j = np.nonzero(s[:, some] >= lowest[some])
                more = i * wide + some[j]
                both = np.concatenate([both, more[s.ravel()[more] < least[i]]])
                near_zero = near_zero[s.ravel()[near_zero] < lowest[near_zero % wide]]
            both = np.concatenate([both, near_zero])
            for k in range(0, len(both), 1 << 16):
                i, j = at + both[k : k + (1 << 16)] // s.shape[1], to + both[k : k + (1 << 16)] % s.shape[1]
                _decide(ask, other, rows[i], held[j], np.einsum("ij,ij->i", m[i], n[j]), bonus, best)


def _decide(ask: Side, other: Side, p: np.ndarray, q: np.ndarray, cosine: np.ndarray, bonus: float, best: Best) -> None:
    none = np.flatnonzero(np.abs(cosine) <= ZERO)
    if len(none):
        cosine[none] = set_scores(ask, other, p[none], q[none])
    within = (ask.domain[p] == other.domain[q]) & (ask.domain[p] != (-1 if ask.blank < 0 else ask.blank))
    apart = ask.ids[p] != other.ids[q]
    best.add(p[apart], (cosine + bonus * within)[apart], other, q[apart])


class Words:
    """Keywords of the asking rows of one kind, the rarest of a row first."""

    def __init__(self, ask: Side, rows: np.ndarray):
        i, c = ask.entries(rows)
        order = np.lexsort((np.bincount(c, minlength=1)[c] if len(c) else c, i))
        self.i, self.c = i[order], c[order]
        n = ask.n[rows]
        self.place = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        self.at = np.concatenate([[0], np.cumsum(n)])


def _met(i: np.ndarray, c: np.ndarray, start: np.ndarray, row: np.ndarray):
    """Pairs (place of i, row) of keywords c that rows hold, in portions."""
    count = start[c + 1] - start[c]
    i, c, count = i[count > 0], c[count > 0], count[count > 0]
    ends = np.cumsum(count)
    at = 0
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, "right")))
        to = int(np.searchsorted(i, i[to - 1], "right"))  # all keywords of a row, so that none of its pairs comes twice
        k = count[at:to]
        yield np.repeat(i[at:to], k), row[np.repeat(start[c[at:to]], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
        at = to


def _postings(i: np.ndarray, c: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    i, c = i[c >= 0], c[c >= 0]
    return np.concatenate([[0], np.cumsum(np.bincount(c, minlength=words))]), i[np.argsort(c, kind="stable")]


def _by_words(ask: Side, other: Side, dims: int, words: Words, bonus: float, best: Best, plain: bool) -> None:
    """Rows whose embeddings give no cosine."""
    rows = ask.kinds[dims]
    held = np.flatnonzero((other.dims != dims) | (dims == 0))
    if not len(held):
        return
    i, c = other.entries(held)
    start, row = _postings(i, c, len(ask.words))
    # Across domains: of n keywords any n - o + 1 hold one of o that are shared, so the rarest are looked up.
    n = ask.n[rows]
    need = np.maximum(best.least[rows], 0.0)
    longest = n - np.maximum(1, np.ceil(n * need - 1e-9)) + 1
    use = words.place < longest[words.i]
    for p, q in _met(words.i[use], words.c[use], start, row):
        p_rows, q_rows = rows[p], held[q]
        x, y = ask.n[p_rows], other.n[q_rows]
        other_domain = (ask.domain[p_rows] != other.domain[q_rows]) | (ask.domain[p_rows] == ask.blank)
        ok = (np.minimum(x, y) >= need[p] * np.maximum(x, y) - 1e-9) & other_domain & (ask.ids[p_rows] != other.ids[q_rows])
        keys = p[ok] * len(held) + q[ok]
        score = set_scores(ask, other, p_rows[ok], q_rows[ok])
        good = score >= need[p[ok]] - 1e-9
        keys, first = np.unique(keys[good], return_index=True)
        best.add(rows[keys // len(held)], score[good][first], other, held[keys % len(held)])
    # Within a domain: all pairs, by count.
    runs = defaultdict(list)
    for d, x, y in other.runs(held):
        runs[d].append((x, y))
    ends = np.searchsorted(i, np.arange(len(held) + 1))
    for d, x, y in ask.runs(rows):
        for u, w in runs.get(d, ()):
            part = slice(ends[u], ends[w])
            start, row = _postings(i[part] - u, c[part], len(ask.words))
            wide, ids = w - u, other.ids[held[u:w]]
            for at in range(x, y, max(1, HELD // wide)):
                to = min(y, at + max(1, HELD // wide))
                own = slice(words.at[at], words.at[to])
                shared = np.zeros((to - at) * wide, np.int64)
                for p, q in _met(words.i[own] - at, words.c[own], start, row):
                    shared += np.bincount(p * wide + q, minlength=len(shared))
                shared = shared.reshape(to - at, wide)
                score = shared / np.maximum(ask.n[rows[at:to]][:, None] + other.n[held[u:w]][None, :] - shared, 1) + bonus
                score[(ask.ids[rows[at:to]][:, None] == ids[None, :]) | ((shared == 0) & (not plain))] = -np.inf
                level = np.round(score, 12)
                if wide > 4 * best.k:  # ids ascend, so a stable order has the smaller id first
                    level = np.where(level >= best.least[rows[at:to]][:, None], level, -np.inf)
                    hit = np.flatnonzero(np.isfinite(level).any(axis=1))
                    j = np.argsort(-level[hit], axis=1, kind="stable")[:, : best.k]
                    i_, j = np.repeat(hit, j.shape[1]), j.ravel()
                else:
                    i_, j = np.nonzero(np.isfinite(score))
                best.add(rows[at:to][i_], score[i_, j], other, held[u + j])


def best_scores(rows: DataFrame, k: int, threshold: float, bonus: float, block_rows: int) -> DataFrame:
    """(a, b, score, rank): the k best scores at or above the threshold of every row (id, domain, kw, v), or of those with ``ask``, against all; ties by the smaller id.

    Where all rows ask, each task first compares its own files. What its rows have found there is mostly close to their best, as files are sorted by domain, so from then on two tasks' files are multiplied
    once for both: the task that does it keeps the best of its own rows and whatever reaches what the other's rows had found. Where a probe of one file a task expects more than ``KEPT`` such rows
    a neighbour, each task multiplies all files for its own rows only."""
    schema = "a long, b long, score double, rank int"
    blocks = Blocks(rows, block_rows)
    files, plain = blocks.files, bonus >= threshold
    tasks = blocks.tasks("ask" in rows.columns)
    span = [range(len(files) * t // tasks, len(files) * (t + 1) // tasks) for t in range(tasks)]
    holder = {x: t for t in range(tasks) for x in span[t]}

    def compare(ask: Side, best, x: int, words: dict, cosines, with_words: bool = True) -> None:
        other = Side([files[x]], ask)
        for d in ask.kinds:
            if cosines is not None and d and d in other.kinds:
                _by_cosine(ask, other, d, bonus, cosines(other))
            if with_words:
                _by_words(ask, other, d, words[d], bonus, best, plain)

    def started(t: int) -> tuple[Side, Best, dict]:
        ask = Side([files[x] for x in span[t]], asking=True)
        return ask, Best(len(ask.ids), k, threshold), {d: Words(ask, r) for d, r in ask.kinds.items()}

    def whole(batches):
        for batch in batches:
            for t in batch.column(0).to_pylist():
                ask, best, words = started(t)
                if len(ask.ids):
                    for x in sorted(holder, key=lambda x: (x not in span[t], x)):  # its own domains first
                        compare(ask, best, x, words, lambda _: best)
                        best.settle()
                    yield best.rows(ask.ids)

    if tasks < 2 or k < 1 or "ask" in rows.columns:
        return blocks.run(tasks, whole, schema)

    def own(batches):
        for batch in batches:
            for t in batch.column(0).to_pylist():
                ask, best, words = started(t)
                for x in span[t]:
                    compare(ask, best, x, words, lambda _: best)
                    best.settle()
                probe, others = Counted(best), [x for x in holder if x not in span[t]]
                compare(ask, best, others[t * 7919 % len(others)], words, lambda _: probe, False)
                found = best.rows(ask.ids)
                meta = [pa.array(np.full(found.num_rows, n)) for n in (t, probe.count * len(others) // 2)]
                yield pa.RecordBatch.from_arrays([*found.columns, *meta], names=[*found.schema.names, "t", "more"])

    spark, at, merged = blocks.spark, f"{blocks.folder}-own", f"{blocks.folder}-both"
    try:
        spark.range(0, tasks, 1, tasks).mapInArrow(own, f"{schema}, t long, more long").write.parquet(at)
        first = spark.read.parquet(at)
        names = {f.rpartition("/")[2]: f for f in first.inputFiles()}
        held = first.groupBy("t", F.input_file_name().alias("f")).agg(F.max("more").alias("more")).collect()  # a row per task
        begun: dict[int, list[str]] = defaultdict(list)
        for r in held:
            begun[r.t].append(names[r.f.rpartition("/")[2]])
        once = sum({r.t: r.more for r in held}.values()) <= KEPT * k * blocks.rows

        def rest(batches):
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    ask, best, words = started(t)
                    best.resume(ask.ids, _read(begun.get(t, []), ["a", "b", "score", "rank"]))
                    meets = {(t + n) % tasks for n in range(1, tasks // 2 + 1) if 2 * n < tasks or t < n}  # each two tasks meet once
                    for x in holder:
                        if holder[x] == t:
                            continue
                        sides: list[Both] = []

                        def both(other: Side) -> Both:
                            if not sides:
                                before = _read(begun.get(holder[x], []), ["a", "score", "rank"])
                                before = before.filter(pc.and_(pc.equal(before["rank"], k), pc.is_in(before["a"], value_set=pa.array(other.ids))))
                                least = np.full(len(other.ids), float(threshold))
                                least[_places(other.ids, before["a"].to_numpy())] = np.maximum(threshold, np.round(before["score"].to_numpy(), 12))
                                sides.append(Both(best, ask, least))
                            return sides[0]

                        compare(ask, best, x, words, (both if holder[x] in meets else None) if once else lambda _: best)
                        best.settle()
                        for side in sides:
                            if side.found:
                                yield from pa.Table.from_batches(side.found).combine_chunks().to_batches()
                    yield best.rows(ask.ids)

        if not once:
            return stored(spark.range(0, tasks, 1, tasks).mapInArrow(rest, schema))
        spark.range(0, tasks, 1, tasks).mapInArrow(rest, schema).write.parquet(merged)
        order = Window.partitionBy("a").orderBy(F.desc("level"), "b")
        found = spark.read.parquet(merged).select("a", "b", "score", _level(F.col("score")).alias("level"))
        return stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("a", "b", "score", "rank"))
    finally:
        for folder in (blocks.folder, at, merged):
            remove(spark, folder)


def _level(score):
    """np.round(score, 12) as an expression."""
    return F.rint(score * 1e12) / 1e12


def _read(files: list[str], columns: list[str]) -> pa.Table:
    parts = []
    for f in files:
        fs, path = FileSystem.from_uri(f)
        with fs.open_input_file(path) as held:
            parts.append(pq.ParquetFile(held).read(columns))
    types = {"a": pa.int64(), "b": pa.int64(), "score": pa.float64(), "rank": pa.int32()}
    return pa.concat_tables(parts) if parts else pa.table({c: pa.array([], types[c]) for c in columns})


def cell_scores(rows: DataFrame, k: int, threshold: float, bonus: float, block_rows: int) -> DataFrame:
    """(a, b, score, rank) as in ``best_scores`` of the rows (id, domain, kw, v, ask, cell, probes) with ``ask``, against those whose cell is among their probes. All vectors have one length.

    Every row lies in one file, however many cells it asks in; a task skips the files of cells that none of its rows asks in."""
    blocks = Blocks(rows, block_rows, ("cell", "domain", "id"))
    files, tasks = blocks.files, blocks.tasks(True)
    if files:
        held = blocks.spark.read.parquet(blocks.folder).groupBy(F.input_file_name().alias("f")).agg(F.min("cell").alias("low"), F.max("cell").alias("high")).collect()  # a row per file
        cells = {r.f.rpartition("/")[2]: (r.low, r.high) for r in held}
        ends = [cells[f.rpartition("/")[2]] for f in files]

    def work(batches):
        for batch in batches:
            for t in batch.column(0).to_pylist():
                own = list(range(len(files) * t // tasks, len(files) * (t + 1) // tasks))
                ask = Side([files[x] for x in own], asking=True)
                if not len(ask.ids):
                    continue
                best, wanted = Best(len(ask.ids), k, threshold), np.unique(ask.probes)
                for x in sorted(range(len(files)), key=lambda x: (x not in own, x)):
                    low, high = ends[x]
                    if not ((wanted >= low) & (wanted <= high)).any():
                        continue
                    other = Side([files[x]], ask)
                    starts = np.flatnonzero(np.concatenate([[True], np.diff(other.cell) != 0]))
                    for start, end in zip(starts, [*starts[1:], len(other.cell)]):
                        some = np.flatnonzero((ask.probes == other.cell[start]).any(axis=1))
                        if len(some):
                            _by_cosine(ask, other, int(ask.dims[0]), bonus, best, some, slice(start, end))
                    best.settle()
                yield best.rows(ask.ids)

    return blocks.run(tasks, work, "a long, b long, score double, rank int")


def every_score(rows: DataFrame, threshold: float, bonus: float, block_rows: int, plain: bool) -> DataFrame:
    """(a, b, score, same_domain), a < b, of all pairs at or above the threshold that have a cosine or share a keyword, with ``plain`` also those of a domain that have neither.

    They are written as they are found: nothing is shuffled, and the files stay in the application's folder."""
    blocks = Blocks(rows, block_rows)
    files = blocks.files
    total = len(files)

    def work(batches):
        for batch in batches:
            for t in batch.column(0).to_pylist():
                ask = Side([files[t]], asking=True)
                words = {d: Words(ask, r) for d, r in ask.kinds.items()}
                for x in range(total // 2 + 1):  # each two files meet once, and all tasks do as much
                    if x and 2 * x == total and t >= x:
                        continue
                    other = Side([files[(t + x) % total]], ask)
                    every = Every(ask, threshold, x == 0)
                    for d in ask.kinds:
                        if d and d in other.kinds:
                            _by_cosine(ask, other, d, bonus, every)
                            yield from every.found
                            every.found = []
                        _by_words(ask, other, d, words[d], bonus, every, plain)
                    yield from every.found

    return blocks.spark.range(0, total, 1, max(1, total)).mapInArrow(work, "a long, b long, score double, same_domain boolean")
