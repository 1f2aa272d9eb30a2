"""Toxicity: a support vector machine over a subsequence string kernel with Nyström landmarks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieweave.llm.common import WordCache, block_words, crc_mod, kept, read, with_columns_of_text

DECAY = 0.6  # of a subsequence's weight, for each character that it skips
REACH = 5  # from the first to the last of a subsequence's three characters
PAIRS = [(a, b) for b in range(2, REACH + 1) for a in range(1, b)]


LINE_END = " . "  # a line end ends a sentence too


def letters(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word.lower()))


#: Characters below 128 as numbers below 64; a-z keep their own, the marks of a word's start and end too, others share the rest. 0 parts words.
CODES = np.array([0 if c == 0 else c - 96 if 97 <= c <= 122 else {94: 27, 36: 28}.get(c, 29 + c % 35) for c in range(128)], np.int32)


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters of all words as numbers, REACH zeros between two words; where each word starts)."""
    joined = ("\0" * REACH).join([f"^{w}$" for w in words]) + "\0" * REACH
    raw = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    code = np.where(raw < 128, CODES[np.minimum(raw, 127)], 29 + (raw % 35).astype(np.int32))
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2 + REACH
    return code, np.cumsum(size) - size


def subsequences(code: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each way to choose three characters: (number of the subsequence that begins at each place, weight). One that leaves its word has a zero in it."""
    for a, b in PAIRS:
        n = len(code) - b
        yield (code[:n] << 12) | (code[a : n + a] << 6) | code[b:], DECAY ** (b - 2)


def sparse(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, subsequence, value) with each pair once: the gap-weighted subsequence features of the words, of length 1 each."""
    code, starts = codes(words)
    row = np.zeros(len(code), np.int64)
    row[starts[1:]] = 1
    row = np.cumsum(row)
    rows, features, weights = [], [], []
    for key, weight in subsequences(code):
        ok = np.flatnonzero((code[: len(key)] > 0) & ((key & 63) > 0))
        rows.append(row[ok])
        features.append(key[ok])
        weights.append(np.full(len(ok), weight))
    key, where = np.unique(np.concatenate(rows) << 18 | np.concatenate(features), return_inverse=True)
    value = np.bincount(where, np.concatenate(weights))
    row = key >> 18
    norm = np.sqrt(np.bincount(row, value**2, len(words)))
    return row, key & 0x3FFFF, value / norm[row]


class Landmarks:
    """Kernel values of words against landmark words, each between 0 and 1. The first `n_first` (all, if None) decide which words are in reach."""

    def __init__(self, words: list[str], n_first: int | None = None, least: float = 0.5):
        self.words, self.least, self.n_first = words, least, len(words) if n_first is None else n_first
        row, feature, value = sparse(words) if words else (np.empty(0, np.int64),) * 3
        used, column = np.unique(feature, return_inverse=True)
        self.table = np.zeros(1 << 18, np.int32)
        self.table[used] = np.arange(1, len(used) + 1)
        self.matrix = np.zeros((len(used) + 1, len(words)), np.float32)
        self.matrix[column + 1, row] = value
        self.top = self.matrix[:, : self.n_first].max(axis=1, initial=0.0)[self.table]

    def kernel(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the words with a kernel value of at least `least` to one of the first landmarks, their kernel rows).

        A bound comes first: the sum over a word's subsequences of their greatest value in a landmark, over a norm that counts no repeats.
        """
        if not self.words or not words:
            return np.empty(0, np.int64), np.empty((0, len(self.words)), np.float32)
        found, rows = [], []
        for a in range(0, len(words), 50_000):
            part = words[a : a + 50_000]
            code, starts = codes(part)
            total, size = np.zeros(len(code), np.float32), np.fromiter(map(len, part), np.int64, len(part)) + 2
            norm = np.zeros(len(part))
            for (_, b), (key, weight) in zip(PAIRS, subsequences(code), strict=True):
                total[: len(key)] += weight * self.top[key]
                norm += weight**2 * np.maximum(size - b, 0)
            maybe = np.flatnonzero(np.add.reduceat(total, starts) >= self.least * np.sqrt(norm) - 1e-4)
            for b in range(0, len(maybe), 2000):
                some = maybe[b : b + 2000]
                got = self.exact([part[i] for i in some])
                keep = got[:, : self.n_first].max(axis=1, initial=0.0) >= self.least
                found.append(a + some[keep])
                rows.append(got[keep])
        return (np.concatenate(found), np.concatenate(rows)) if found else (np.empty(0, np.int64), np.empty((0, len(self.words)), np.float32))

    def exact(self, words: list[str]) -> np.ndarray:
        row, feature, value = sparse(words)
        column = self.table[feature]
        hit = np.flatnonzero(column)
        out = np.zeros((len(words), len(self.words)), np.float32)
        if len(hit):
            first = np.flatnonzero(np.concatenate([[True], np.diff(row[hit]) > 0]))
            out[row[hit][first]] = np.add.reduceat(self.matrix[column[hit]] * value[hit, None].astype(np.float32), first, axis=0)
        return out


class Sentences:
    """Kernel rows of the sentences of texts: the greatest value over the words of a sentence, for each landmark.

    Runs of three or more single letters count as one more word, so a spaced-out insult is met too.
    """

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self.kept: dict[int, np.ndarray] = {}
        self.n = 0

        def missing(words: list[str]) -> list[int]:
            plain = [letters(w) for w in words]
            some = [i for i, w in enumerate(plain) if len(w) > 2]
            at, rows = landmarks.kernel([plain[i] for i in some]) if some else ([], [])
            mine = {some[i]: r for i, r in zip(at, rows, strict=True)}
            out = []
            for i, w in enumerate(words):
                number = 0
                if i in mine:
                    self.n += 1
                    number = self.n
                    self.kept[number] = mine[i]
                out.append(number << 2 | (len(plain[i]) == 1) << 1 | (w[-1:] in (".", "!", "?")))
            return out

        self.cache = WordCache(missing, emptied=self.kept.clear)

    def parts(self, texts: list[str | None] | pa.Array) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """For each text (kernel rows of its words in reach, the number of each one's sentence, ascending; number of words of the text)."""
        words, which, starts = block_words(texts, LINE_END)
        self.cache.learn(words)
        each = np.fromiter((self.cache[w] for w in words), np.int64, len(words))[which]
        return [(*self.one(words, which[a:b], each[a:b]), b - a) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]

    def one(self, words: list[str], which: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number = each >> 2
        at = np.flatnonzero(number)
        pairs = [(int(i), self.kept[int(number[i])]) for i in at]
        single = np.flatnonzero(each & 2)
        if len(single) > 2:
            for run in np.split(single, np.flatnonzero(np.diff(single) > 1) + 1):
                if len(run) > 2:
                    _, rows = self.landmarks.kernel([letters("".join(words[i] for i in which[run[0] : run[-1] + 1]))])
                    pairs += [(int(run[0]), r) for r in rows]
        if not pairs:
            return np.empty((0, len(self.landmarks.words)), np.float32), np.empty(0, np.int64)
        place = np.concatenate([[0], np.cumsum(each & 1)])[[i for i, _ in pairs]]
        order = np.argsort(place, kind="stable")
        return np.array([r for _, r in pairs])[order], place[order]


def sentence_rows(rows: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The greatest kernel values of each sentence."""
    return np.maximum.reduceat(rows, np.flatnonzero(np.concatenate([[True], np.diff(place) > 0])), axis=0) if len(rows) else rows


def measures(rows: np.ndarray, place: np.ndarray, n_words: int, weights: np.ndarray, offset: float) -> tuple[float, float, float, float]:
    """What a text is judged by: the margin of its worst sentence (from 0, for no word in reach), how many words lie beyond the plane by
    themselves (logarithm), their share of all words (root), and the text's length (logarithm)."""
    if not len(rows):
        return 0.0, 0.0, 0.0, float(np.log1p(n_words) / 10)
    worst = float((sentence_rows(rows, place) @ weights).max() + offset)
    n = int(((rows @ weights) + offset > 0).sum())
    return max(0.0, worst + 1), float(np.log1p(n)), float(np.sqrt(n / n_words)), float(np.log1p(n_words) / 10)


@dataclass(frozen=True)
class Model:
    landmarks: tuple[str, ...]
    n_first: int  # of them, those that part the classes
    weights: np.ndarray  # of a sentence's kernel values: the Nyström map and the machine's plane in one
    offset: float  # of the plane
    slopes: np.ndarray  # of measures(); the last one is the shift. A text's score is the logistic function of their sum


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Plane of a linear machine with squared hinge loss, the last entry its offset; Newton steps on the rows inside the margin."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        inside = y * (z @ w) < 1
        a, u = z[inside], c * weight[inside]
        new = np.linalg.solve(ridge + a.T @ (a * u[:, None]), a.T @ (u * y[inside]))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes of the columns of x and the shift; targets are drawn in a little, so that separable scores don't run away."""
    n1, n0 = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), 1e-2 * np.eye(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (goal - p) - ridge @ w)
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", per_class: int = 2000, n_landmarks: int = 120, sentences: int = 12, seed: int = 5) -> Model:
    """Learns from about per_class labelled documents of each class (fewer where there are fewer), chosen by the hash of their id, whole texts.

    That bound, and at most n_landmarks kernel values for the `sentences` of a document that are most like a landmark, is what comes to the driver. Landmarks are the words that
    part the classes best, each unlike those before it, and as many words of clean documents that are most like them. Sentences of clean
    documents are labelled clean. Of a toxic document all count as toxic at first, then the one that scores highest and those beyond the plane.
    Last, measures() of the sample's whole texts are weighed by a logistic regression.
    A document with several labels counts as toxic if one of them is 1. Without both classes the model scores every text 0.
    """
    spark = docs.sparkSession
    marked = labels.where("toxic is not null").groupBy(id_col).agg(F.max("toxic").cast("int").alias("toxic"))
    size = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    blank = Model((), 0, np.zeros(0), 0.0, np.array([0.0, 0.0, 0.0, 0.0, -4.0]))
    if not size.get(0) or not size.get(1):
        return blank
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / size[1])).otherwise(min(1.0, per_class / size[0]))
    few = marked.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1_000_003)) < share * 1_000_003)
    # few has about 2 * per_class rows, whatever the size of the tables
    sample = docs.select(id_col, "text").join(F.broadcast(few), id_col).select("text", "toxic").persist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in {letters(x) for x in block_words([text], LINE_END)[0]}:
                    found.setdefault(w, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *[pa.array([v[k] for v in found.values()], pa.int64()) for k in (0, 1)]], ["word", "clean", "bad"])

    words = sample.mapInArrow(count, "word string, clean long, bad long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")).where("length(word) between 3 and 40").persist()
    n0, n1 = sample.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    if not n0 or not n1:
        return blank
    gain = F.col("bad") / n1 - F.col("clean") / n0 * 3
    worst = [r["word"] for r in words.where("bad > 1").orderBy(gain.desc(), "word").limit(4000).collect()]
    first = diverse(worst, n_landmarks * 2 // 3, 0.7)
    reach = spark.sparkContext.broadcast(Landmarks(first, least=0.3))

    def likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column(0).to_pylist()
            at, rows = reach.value.kernel(some)
            yield pa.RecordBatch.from_arrays([pa.array([some[i] for i in at], pa.string()), pa.array(rows.max(axis=1, initial=0).tolist(), pa.float64())], ["word", "like"])

    like = words.where("bad = 0").select("word").mapInArrow(likeness, "word string, like double").orderBy(F.desc("like"), "word").limit(2000).collect()
    if not first:
        return blank
    marks = Landmarks(first + diverse([r["word"] for r in like], n_landmarks - len(first), 0.7), len(first))
    shared = spark.sparkContext.broadcast(marks)

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Sentences(shared.value)
        for batch in batches:
            rows = [sentence_rows(r, at) for r, at, _ in work.parts(batch.column(0).to_pylist())]
            rows = [r[np.argsort(-r.max(axis=1, initial=0), kind="stable")[:sentences]] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r.astype(np.float16).tobytes() for r in rows], pa.binary()), batch.column(1)], ["rows", "toxic"])

    got = sample.mapInArrow(kernels, "rows binary, toxic int").collect()
    m = len(marks.words)
    rows = [np.frombuffer(r["rows"], np.float16).reshape(-1, m).astype(np.float32) for r in got]
    toxic = np.array([r["toxic"] for r in got])
    own, feature, value = sparse(marks.words)
    used, column = np.unique(feature, return_inverse=True)
    dense = np.zeros((m, len(used)), np.float32)
    dense[own, column] = value
    values, vectors = np.linalg.eigh((dense @ dense.T).astype(np.float64))
    nystrom = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
    doc = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)])
    x = np.concatenate(rows) @ nystrom
    y = np.where(toxic[doc] == 1, 1.0, -1.0)
    use, plane = np.ones(len(y), bool), np.zeros(m + 1)
    for _ in range(4):
        n_pos = max(1, (use & (y > 0)).sum())
        weight = np.where(y > 0, max(1.0, (use & (y < 0)).sum() / n_pos / 4), 1.0)
        plane = svm(x[use], y[use], weight[use])
        score = x @ plane[:-1] + plane[-1]
        best = np.full(len(rows), -np.inf)
        np.maximum.at(best, doc, score)
        use = (y < 0) | (score >= np.minimum(best[doc], 0.0))
    weights, offset = nystrom @ plane[:-1], float(plane[-1])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Sentences(shared.value)
        for batch in batches:
            found = [measures(*x, weights, offset) for x in work.parts(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    got = sample.mapInArrow(judged, "x array<double>, toxic int").collect()
    sample.unpersist()
    words.unpersist()
    slopes = logistic(np.array([r["x"] for r in got]), np.array([float(r["toxic"]) for r in got]))
    return Model(tuple(marks.words), marks.n_first, weights, offset, slopes)


def diverse(words: list[str], most: int, alike: float) -> list[str]:
    """The first words, each with a kernel value under `alike` to all that were taken before."""
    if not words:
        return []
    row, feature, value = sparse(words)
    used, column = np.unique(feature, return_inverse=True)
    ends = np.searchsorted(row, np.arange(len(words) + 1))
    taken: list[str] = []
    sums = np.zeros((most, len(used)), np.float32)
    for i, w in enumerate(words):
        at = column[ends[i] : ends[i + 1]]
        v = value[ends[i] : ends[i + 1]]
        if not taken or (sums[: len(taken), at] @ v).max() < alike:
            sums[len(taken), at] = v
            taken.append(w)
            if len(taken) == most:
                break
    return taken


FIELDS = T.StructType([T.StructField("toxic_score", T.DoubleType())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with toxic_score from 0 to 1, for whole texts: by the worst sentence, and by how many words lie beyond the plane, see measures().

    Null and empty texts get the score of a text of no words; a line end counts as one. Repeated rows score alike; a
    column named toxic_score is replaced; an empty table stays empty. The model is broadcast; fit()'s parameters bound its size.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def make() -> Callable:
        m = shared.value
        work = kept(key, lambda: Sentences(Landmarks(list(m.landmarks), m.n_first)))

        def run(texts: list[str | None]) -> list:
            x = np.array([measures(*part, m.weights, m.offset) for part in work.parts(texts)])
            return [1 / (1 + np.exp(-np.clip(x @ m.slopes[:-1] + m.slopes[-1], -500, 500)))]

        return run

    return with_columns_of_text(docs, FIELDS, make, slice_chars=1_500_000, arrow=True)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document with its toxicity, by a model of the labels that may be learned from."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = crc_mod("doc_id", 5) == 0
    out = score(docs, fit(docs, labels.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
