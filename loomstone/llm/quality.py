"""Quality classifier (operator 4): co-training of two views.

One view reads the text (its words and character mix), the other the page's
metadata (source, language, length and line layout). Both start from labelled
rows. In each round every document that one view is sure of becomes a
pseudo-labelled row of the other: a pass over the whole table sums the gradient
and the curvature of those rows, and the view is fitted again on its labelled
rows plus that quadratic form. Each view is calibrated on a fold of its own, a
logistic combination is fitted on a second and the threshold with the best F1 for
the rarer class is taken on a third. This runs for quality and for toxicity
together; a document stays if it is good and not toxic.

At most ``LABELLED`` labelled rows, drawn by a hash of their ids, and
``VOCABULARY`` telling words of them reach the driver; the sums have one value
for each weight. So what the driver holds and what is broadcast is bounded
whatever the table's size, and all else covers every document. No pass shuffles
texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.llm.common import arrow, map_columns, store, table
from loomstone.llm.words import ALNUM, Chunk, chunks

LABELLED = 10_000
VOCABULARY = 20_000  # telling words of a head
ROUNDS = 3
SURE = 0.97  # calibrated probability from which a view labels a row
MIN_DOCS = 4  # sampled documents that must hold a word
TELLING = 3.0  # z score of a word's log odds from which the text view takes it
FOLDS = (3, 0, 4, 1, 5, 2, 6, 7)  # in turn for the rows of a class: 0 calibrates, 1 mixes, 2 sets the threshold, the rest fit
SOURCES, LANGS = 64, 16  # hashed slots of the metadata view
ACCEPTS = (0.0, 2.0)  # thresholds of quality and toxicity that reject nothing

_CLASSES = [np.zeros(256, dtype=bool) for _ in range(7)]
_CLASSES[0][65:91] = True  # upper case
_CLASSES[1][97:123] = True  # lower case
_CLASSES[2][48:58] = True  # digits
_CLASSES[3][[0x21, 0x3F]] = True  # ! ?
_CLASSES[4][[ord(c) for c in "|*#$%&@~^=+<>{}[]_\\"]] = True  # symbols
_CLASSES[5][[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_CLASSES[6][0x0A] = True


def _measures(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Numeric columns of the text view and of the metadata view's layout."""
    size = np.maximum(1, np.diff(c.row_start)).astype(np.float64)
    share = []
    for kind in _CLASSES:
        total = np.zeros(len(c.raw) + 1, dtype=np.int64)
        np.cumsum(kind[c.raw], out=total[1:])
        share.append(np.diff(total[c.row_start]))
    upper, lower, digit, bang, symbol, space, lines = share
    n = np.diff(c.bounds)
    words = np.maximum(1, n).astype(np.float64)
    row = c.row_of
    same = np.zeros(len(c.hash), dtype=bool)
    same[1:] = (c.hash[1:] == c.hash[:-1]) & (row[1:] == row[:-1])
    again = np.bincount(row[same], minlength=c.rows)
    text = np.stack([upper / size, upper / np.maximum(1, upper + lower), digit / size, bang / words, symbol / size, symbol / words, space / size, again / words, size / words], axis=1)
    layout = np.stack([np.log1p(size), np.log1p(lines), np.log1p(size / (lines + 1)), np.log1p(words / (lines + 1))], axis=1)
    return text, layout


def _slot(value: str | None, slots: int) -> int:
    return zlib.crc32((value or "").encode()) % slots


def _meta(layout: np.ndarray, sources: list, langs: list) -> np.ndarray:
    out = np.zeros((len(layout), layout.shape[1] + SOURCES + LANGS))
    out[:, : layout.shape[1]] = layout
    rows = np.arange(len(layout))
    out[rows, layout.shape[1] + np.array([_slot(s, SOURCES) for s in sources], dtype=np.int64)] = 1
    out[rows, layout.shape[1] + SOURCES + np.array([_slot(s, LANGS) for s in langs], dtype=np.int64)] = 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Rows:
    """Features of some documents: dense columns and pairs (row, word)."""

    dense: np.ndarray
    row: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    word: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def take(self, keep: np.ndarray) -> Rows:
        place = np.full(len(self.dense), -1)
        place[keep] = np.arange(len(keep))
        use = place[self.row] >= 0
        return Rows(self.dense[keep], place[self.row[use]], self.word[use])


@dataclass
class Sums:
    """Rows of one class: their number, and gradient and curvature at a view's weights."""

    count: float
    slope: np.ndarray
    curve: np.ndarray


class Logistic:
    """Logistic regression on dense columns and word presence, by Adam on all rows."""

    def __init__(self, words: int = 0, l2: float = 1e-3, steps: int = 240, rate: float = 0.08):
        self.words, self.l2, self.steps, self.rate = words, l2, steps, rate
        self.w: np.ndarray | None = None  # dense columns, constant, words

    def _features(self, x: Rows) -> np.ndarray:
        d = (x.dense - self.mean) / self.std
        return np.concatenate([d, np.ones((len(d), 1))], axis=1)

    def _z(self, d: np.ndarray, x: Rows, w: np.ndarray) -> np.ndarray:
        z = d @ w[: d.shape[1]]
        return z + np.bincount(x.row, weights=w[d.shape[1] :][x.word], minlength=len(d)) if self.words else z

    def _spread(self, d: np.ndarray, x: Rows, r: np.ndarray) -> np.ndarray:
        """The weighted sum of the rows' features."""
        return np.concatenate([d.T @ r, np.bincount(x.word, weights=r[x.row], minlength=self.words) if self.words else np.zeros(0)])

    def fit(self, x: Rows, y: np.ndarray, more: tuple[Sums, Sums] | None = None) -> Logistic:
        """``more`` are pseudo-labelled rows of class 0 and 1, summed at this view's weights.

        The pseudo-labelled rows of a class weigh no more than its labelled ones.
        """
        if self.w is None:
            self.mean, self.std = x.dense.mean(axis=0), x.dense.std(axis=0) + 1e-6
        d = self._features(x)
        if self.w is None:
            positive = np.clip(y.mean(), 1e-3, 1 - 1e-3)
            self.w = np.zeros(d.shape[1] + self.words)
            self.w[d.shape[1] - 1] = np.log(positive / (1 - positive))
        decay = np.full(len(self.w), self.l2 * 0.1)
        decay[: d.shape[1] - 1], decay[d.shape[1] - 1] = self.l2, 0
        slope, curve = np.zeros(len(self.w)), np.zeros(len(self.w))
        for label, sums in enumerate(more or ()):
            weight = min(1.0, float((y == label).sum()) / max(1.0, sums.count)) / len(y)
            slope, curve = slope + weight * sums.slope, curve + weight * sums.curve
        start, w = self.w, self.w.copy()
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, self.steps + 1):
            g = self._spread(d, x, (_sigmoid(self._z(d, x, w)) - y) / len(y)) + decay * w + slope + curve * (w - start)
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g**2
            w -= self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.w = w
        return self

    def sums(self, x: Rows, label: int) -> Sums:
        """Gradient and a diagonal bound of the curvature of rows of one class."""
        d = self._features(x)
        p = _sigmoid(self._z(d, x, self.w))
        bent = p * (1 - p) * (np.abs(d).sum(axis=1) + np.bincount(x.row, minlength=len(d)))
        return Sums(len(d), self._spread(d, x, p - label), self._spread(np.abs(d), x, bent))

    def logit(self, x: Rows) -> np.ndarray:
        return self._z(self._features(x), x, self.w)


class Constant:
    """Where one class has no rows, both views say its smoothed share."""

    def __init__(self, y: np.ndarray):
        p = (y.sum() + 1) / (len(y) + 2)
        self.z = float(np.log(p / (1 - p)))

    def combined(self, text: Rows, meta: Rows) -> np.ndarray:
        return _sigmoid(np.full(len(text.dense), self.z))


class CoTrained:
    """Two views, their rounds of exchanged labels and the calibrated combination."""

    def __init__(self, text: Rows, meta: Rows, y: np.ndarray, fold: np.ndarray, words: int):
        """``y`` is 0 or 1; ``fold`` names what a row is for (see ``FOLDS``)."""
        self.y, self.rows = y, [text, meta]
        self.fold = {"fit": np.flatnonzero(fold > 2)}
        held = np.flatnonzero(fold < 3)
        for at, name in enumerate(("calibrate", "mix", "cut")):
            own = np.flatnonzero(fold == at)
            self.fold[name] = own if len(own) and len(np.unique(y[own])) == 2 else held
        self.views = [Logistic(words), Logistic()]
        self.exchanged = [0, 0]
        self.history: list[dict[str, float]] = []
        self.refit([None, None])

    def refit(self, more: list[tuple[Sums, Sums] | None]) -> None:
        fit, out = self.fold["fit"], self.fold["calibrate"]
        for i, view in enumerate(self.views):
            view.fit(self.rows[i].take(fit), self.y[fit].astype(np.float64), more[i])
            self.exchanged[i] = int(sum(s.count for s in more[i] or ()))
        self.platt = [_calibrate(v.logit(x.take(out)), self.y[out]) for v, x in zip(self.views, self.rows, strict=True)]
        mix, cut = self.fold["mix"], self.fold["cut"]
        self.mixer = Logistic(l2=1e-2, steps=300).fit(Rows(self._calibrated(*(x.take(mix) for x in self.rows))), self.y[mix].astype(np.float64))
        held = [x.take(cut) for x in self.rows]
        p = {"text": _sigmoid(self._calibrated(*held)[:, 0]), "meta": _sigmoid(self._calibrated(*held)[:, 1]), "both": self.combined(*held)}
        self.threshold = best_threshold(p["both"], self.y[cut])
        self.history.append({k: best_f1(x, self.y[cut]) for k, x in p.items()} | {"exchanged_text": self.exchanged[0], "exchanged_meta": self.exchanged[1]})

    def lean(self) -> CoTrained:
        """The same model without its training rows, to broadcast."""
        out = object.__new__(CoTrained)
        out.views, out.platt, out.mixer, out.exchanged, out.history, out.threshold = self.views, self.platt, self.mixer, self.exchanged, self.history, self.threshold
        return out

    def _calibrated(self, text: Rows, meta: Rows) -> np.ndarray:
        return np.stack([a * v.logit(x) + b for (a, b), v, x in zip(self.platt, self.views, (text, meta), strict=True)], axis=1)

    def combined(self, text: Rows, meta: Rows) -> np.ndarray:
        return _sigmoid(self.mixer.logit(Rows(self._calibrated(text, meta))))

    def taught(self, text: Rows, meta: Rows) -> dict[tuple[int, int], Sums]:
        """For each view and class, the sums of the rows that the other view is sure of."""
        p, out = _sigmoid(self._calibrated(text, meta)), {}
        for view, x in enumerate((text, meta)):
            for label in (0, 1):
                sure = np.flatnonzero((p[:, 1 - view] >= SURE) if label else (p[:, 1 - view] <= 1 - SURE))
                if len(sure):
                    out[view, label] = self.views[view].sums(x.take(sure), label)
        return out


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    fit = Logistic(l2=1e-2, steps=300).fit(Rows(z[:, None]), y.astype(np.float64))
    return float(fit.w[0] / fit.std[0]), float(fit.w[1] - fit.w[0] * fit.mean[0] / fit.std[0])


@dataclass
class Head:
    """One target: the words that tell it, and its co-trained views."""

    vocabulary: np.ndarray
    views: CoTrained | Constant
    threshold: float = 0.5

    def inputs(self, c: Chunk, dense: np.ndarray) -> Rows:
        return Rows(dense, *_known_words(c, self.vocabulary))

    def probability(self, c: Chunk, dense: np.ndarray, meta: Rows) -> np.ndarray:
        return self.views.combined(self.inputs(c, dense), meta)


@dataclass
class Model:
    quality: Head
    toxic: Head

    def score(self, c: Chunk, sources: list, langs: list) -> tuple[np.ndarray, np.ndarray]:
        dense, layout = _measures(c)
        meta = Rows(_meta(layout, sources, langs))
        return self.quality.probability(c, dense, meta), self.toxic.probability(c, dense, meta)


def _known_words(c: Chunk, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, word) of vocabulary words."""
    if not len(vocabulary) or not len(c.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(vocabulary, c.hash)
    at[at == len(vocabulary)] = 0
    hit = vocabulary[at] == c.hash
    pair = np.unique(c.row_of[hit] * len(vocabulary) + at[hit])
    return pair // len(vocabulary), pair % len(vocabulary)


def _by_f1(p: np.ndarray, y: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(rarer class, its probabilities from the highest, F1 of a cut after each)."""
    rare = int(2 * (y == 1).sum() <= len(y))
    side = p if rare else 1 - p
    order = np.argsort(-side, kind="stable")
    hits, n = np.cumsum(y[order] == rare), np.arange(1, len(y) + 1)
    return rare, np.append(side[order], 0.0), 2 * hits / (n + (y == rare).sum())


def best_f1(p: np.ndarray, y: np.ndarray) -> float:
    _, side, f1 = _by_f1(p, y)
    return float(f1[side[:-1] > side[1:]].max(initial=0.0))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap of probabilities that cuts with the best F1 of the rarer class."""
    rare, side, f1 = _by_f1(p, y)
    good = np.flatnonzero((f1 >= f1.max() - 0.005) & (side[:-1] > side[1:]))
    at = good[np.argmax(side[good] - side[good + 1])]
    cut = float((side[at] + side[at + 1]) / 2)
    return cut if rare else 1 - cut


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) -> features for fitting."""
    for batch in batches:
        for c in chunks(batch.column(1), ALNUM):
            dense, layout = _measures(c)
            words = [np.unique(c.hash[c.bounds[i] : c.bounds[i + 1]]).view(np.int64) for i in range(c.rows)]
            columns = [batch.column(0)[c.first : c.first + c.rows], pa.array(list(dense)), pa.array(list(layout)), pa.array(words, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "dense", "layout", "words"])


def _fold(target: str) -> Column:
    """The rows of each class are dealt in turn, so every fold has both where there are enough."""
    turn = F.row_number().over(Window.partitionBy(target).orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id"))
    return F.when(F.col(target).isNotNull(), F.element_at(F.array(*map(F.lit, FOLDS)), ((turn - 1) % len(FOLDS) + 1).cast("int")))


def _telling(sample: DataFrame, words: DataFrame, target: str) -> np.ndarray:
    """Words whose share of documents differs between the classes of the rows that fit a head."""
    fit = sample.where((F.col(f"{target}_fold") > 2)).select("doc_id", (F.col(target) > 0).cast("int").alias("y"))
    sizes = fit.agg(F.sum("y"), F.count("*")).first()
    n_yes = (sizes[0] or 0) + 1.0
    n_no = sizes[1] - n_yes + 2.0
    seen = words.join(F.broadcast(fit), "doc_id").groupBy("word").agg(F.sum("y").alias("yes"), F.count("*").alias("df")).where(F.col("df") >= MIN_DOCS)
    yes, no = F.col("yes") + 0.5, F.col("df") - F.col("yes") + 0.5
    odds = F.log(yes / (n_yes - yes + 0.5)) - F.log(no / (n_no - no + 0.5))
    z = F.abs(odds) / F.sqrt(1 / yes + 1 / no)
    top = seen.select("word", z.alias("z")).where(F.col("z") >= TELLING).orderBy(F.desc("z"), "word").limit(VOCABULARY)
    return np.sort(np.array([r[0] for r in top.select("word").collect()], dtype=np.int64).view(np.uint64))


def _rows_of(table: pa.Table, vocabulary: np.ndarray) -> tuple[Rows, Rows]:
    words = table.column("words").combine_chunks()
    row = np.repeat(np.arange(table.num_rows), np.diff(words.offsets.to_numpy()))
    flat = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    at = np.searchsorted(vocabulary, flat)
    at[at == len(vocabulary)] = 0
    use = vocabulary[at] == flat if len(vocabulary) else np.zeros(len(flat), dtype=bool)
    dense, layout = (np.array(table.column(c).to_pylist()) for c in ("dense", "layout"))
    return Rows(dense, row[use], at[use]), Rows(_meta(layout, table.column("source").to_pylist(), table.column("lang").to_pylist()))


def _exchange(docs: DataFrame, heads: list[Head]) -> list[dict[tuple[int, int], Sums]]:
    """The pseudo-labelled rows of the whole table for each head, view and class, summed."""
    sizes = [[len(v.w) for v in h.views.views] if isinstance(h.views, CoTrained) else None for h in heads]
    shared = docs.sparkSession.sparkContext.broadcast([Head(h.vocabulary, h.views.lean()) if isinstance(h.views, CoTrained) else None for h in heads])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], Sums] = {}
        for batch in batches:
            sources, langs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for c in chunks(batch.column(0), ALNUM):
                dense, layout = _measures(c)
                at = slice(c.first, c.first + c.rows)
                meta = Rows(_meta(layout, sources[at], langs[at]))
                for k, head in enumerate(shared.value):
                    if head is None:
                        continue
                    for (view, label), got in head.views.taught(head.inputs(c, dense), meta).items():
                        old = total.get((k, view, label))
                        total[k, view, label] = got if old is None else Sums(old.count + got.count, old.slope + got.slope, old.curve + got.curve)
        for (k, view, label), one in total.items():
            use = np.flatnonzero((one.slope != 0) | (one.curve != 0))
            slot, slope, curve = np.append(use, -1), np.append(one.slope[use], one.count), np.append(one.curve[use], 0.0)
            key = np.full(len(slot), (k * 2 + view) * 2 + label)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(slope), pa.array(curve)], names=["key", "slot", "slope", "curve"])

    sums = arrow(docs.select("text", "source", "lang"), run, "key int, slot int, slope double, curve double")
    got = sums.groupBy("key", "slot").agg(F.sum("slope").alias("slope"), F.sum("curve").alias("curve")).toArrow().to_pydict()
    out: list[dict[tuple[int, int], Sums]] = []
    for k, size in enumerate(sizes):
        out.append({(view, label): Sums(0.0, np.zeros(size[view]), np.zeros(size[view])) for view in (0, 1) for label in (0, 1)} if size else {})
    for key, slot, slope, curve in zip(got["key"], got["slot"], got["slope"], got["curve"], strict=True):
        one = out[key // 4][key // 2 % 2, key % 2]
        if slot < 0:
            one.count = slope
        else:
            one.slope[slot], one.curve[slot] = slope, curve
    return out


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model:
    """Fit both heads on ``docs`` (doc_id, text, source, lang) and ``labels`` (doc_id, quality, toxic).

    Of labels that repeat an id the smallest quality and the largest toxic count,
    of documents that do any one. Labels without a document, null marks and null
    ids are ignored. A head without two rows of each class is a ``Constant`` that
    rejects nothing; so are both where a table is empty.
    """
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marks = marks.where("quality is not null or toxic is not null")
    ids = docs.select("doc_id").where("doc_id is not null").distinct().join(marks, "doc_id")
    sample = ids.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(labelled)
    sample = store(sample.select("doc_id", *((F.col(t) > 0).cast("int").alias(t) for t in ("quality", "toxic"))).withColumns({f"{t}_fold": _fold(t) for t in ("quality", "toxic")}), "sample")
    rows = docs.select("doc_id", "text", "source", "lang").join(F.broadcast(sample.select("doc_id")), "doc_id").dropDuplicates(["doc_id"])
    rows = store(rows, "sample-texts")
    features = arrow(rows.select("doc_id", "text"), _sample_features, "doc_id bigint, dense array<double>, layout array<double>, words array<bigint>")
    features = store(features, "sample-features")
    words = features.select("doc_id", F.explode("words").alias("word"))
    heads = []
    for target, accepts in zip(("quality", "toxic"), ACCEPTS, strict=True):
        mine = sample.where(F.col(target).isNotNull()).select("doc_id", F.col(target).alias("y"), F.col(f"{target}_fold").alias("fold"))
        counts = {r["y"]: r["count"] for r in mine.groupBy("y").count().collect()}
        if min(counts.get(0, 0), counts.get(1, 0)) < 2:
            y = np.repeat([0, 1], [counts.get(0, 0), counts.get(1, 0)])
            heads.append(Head(np.zeros(0, np.uint64), Constant(y), accepts))
            continue
        vocabulary = _telling(sample, words, target)
        known = docs.sparkSession.createDataFrame(pa.table({"word": pa.array(vocabulary.view(np.int64))}))
        kept = words.join(F.broadcast(known), "word").groupBy("doc_id").agg(F.collect_list("word").alias("words"))
        full = features.drop("words").join(mine, "doc_id").join(rows.select("doc_id", "source", "lang"), "doc_id").join(kept, "doc_id", "left")
        got = full.withColumn("words", F.coalesce("words", F.array().cast("array<bigint>"))).toArrow().sort_by("doc_id")
        y, fold = (np.array(got.column(c).to_pylist()) for c in ("y", "fold"))
        heads.append(Head(vocabulary, CoTrained(*_rows_of(got, vocabulary), y, fold, len(vocabulary))))
    if any(isinstance(h.views, CoTrained) for h in heads):
        for _ in range(rounds):
            for head, sums in zip(heads, _exchange(docs, heads), strict=True):
                if sums:
                    head.views.refit([(sums[view, 0], sums[view, 1]) for view in (0, 1)])
    for head in heads:
        if isinstance(head.views, CoTrained):
            head.views, head.threshold = head.views.lean(), head.views.threshold
    return Model(*heads)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Append p_quality, p_toxic, score and keep to each row of ``docs`` (text, source, lang).

    ``score`` is p_quality * (1 - p_toxic); ``keep`` asks for p_quality at or
    over and p_toxic under the heads' thresholds. Null texts count as empty, null metadata as
    an own value; every row is kept, repeated ones too. Columns of ``docs``
    called like an added one are replaced. Without two labels of each class a
    head gives the smoothed share of its class everywhere and rejects nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        quality, toxic = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        sources, langs = batch.column("source").to_pylist(), batch.column("lang").to_pylist()
        for c in chunks(batch.column("text"), ALNUM):
            at = slice(c.first, c.first + c.rows)
            quality[at], toxic[at] = shared.value.score(c, sources[at], langs[at])
        keep = (quality >= shared.value.quality.threshold) & (toxic < shared.value.toxic.threshold)
        return {"p_quality": pa.array(quality), "p_toxic": pa.array(toxic), "score": pa.array(quality * (1 - toxic)), "keep": pa.array(keep)}

    return map_columns(docs, run, "p_quality double, p_toxic double, score double, keep boolean")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text", "source", "lang"), model).select("doc_id", "p_quality", "p_toxic", "score", "keep")
