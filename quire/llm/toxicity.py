"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its hashed parts: the word itself
and its character n-grams, so a misspelling nobody has seen shares most of the
vector of what it misspells. A text's vector is the mean over its words, repeats
included, and a softmax over it gives the score. Embeddings and softmax are
trained together by Adam on a bounded sample of labelled texts, in one task;
it ends when the loss on a fold kept back no longer falls. Everything
after the mean is linear, so scoring needs one number for each part.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import by_slices, released, slices, stored

#: Hash buckets of word parts, n-gram lengths, vector length, and the gain on the mean (the vectors start small).
BUCKETS, GRAMS, DIM, GAIN = 1 << 17, (4, 5), 6, 20.0
#: Words without a meaning that every text has besides its own: a mean over few words says little.
PRIOR = 10
#: Labelled texts that a model is fitted on, at most (expected: they are drawn by a hash threshold).
SAMPLE = 12_000
#: Counts (text, word) that the fitting task holds, at most (expected): of longer texts fewer are drawn.
COUNTS = 6_000_000
EPOCHS, BATCH, RATE, FOLD = 20, 256, 0.006, 8
WORD = re.compile(r"\w+")
#: A longer run (Chinese, Japanese, Thai, joined by underscores) is cut into pieces of so many characters, which share OVERLAP: no n-gram is lost.
PIECE, OVERLAP = 40, max(GRAMS) - 1


def words_of(text: str | None) -> list[str]:
    """The lower-cased words of the whole text, very long ones as overlapping pieces that each count as a word."""
    out = WORD.findall((text or "").lower())
    if max(map(len, out), default=0) > PIECE:
        out = [w[at : at + PIECE] for w in out for at in range(0, max(1, len(w) - OVERLAP), PIECE - OVERLAP)]
    return out


def parts(word: str) -> list[int]:
    """Bucket ids of the word's parts."""
    w = f"<{word}>".encode()
    out = [zlib.crc32(w) % BUCKETS]
    s = f"<{word}>"
    for n in GRAMS:
        out += [zlib.crc32(s[i : i + n].encode()) % BUCKETS for i in range(len(s) - n + 1)]
    return out


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all the runs (start, size), one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _by(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by their position."""
    return np.stack([np.bincount(at, rows[:, k], minlength=n) for k in range(rows.shape[1])], 1).astype(np.float32)


def fit(words: np.ndarray, doc: np.ndarray, count: np.ndarray, vocabulary: list[str], label: np.ndarray, kept_back: np.ndarray) -> np.ndarray:
    """One number for each bucket and, last, the bias: what a part adds to the log odds, already averaged and joined with the softmax.

    words, doc, count: the word counts, sorted by doc; label and kept_back: one for each doc.
    """
    n = len(label)
    total = np.bincount(doc, count, minlength=n) + PRIOR
    share = (count / total[doc]).astype(np.float32)
    doc_size = np.bincount(doc, minlength=n)
    doc_start = np.cumsum(doc_size) - doc_size
    held, sizes = array("i"), array("i")
    for w in vocabulary:
        held.extend(ids := parts(w))
        sizes.append(len(ids))
    flat, size = np.frombuffer(held, np.int32) if held else np.zeros(0, np.int32), np.array(sizes, np.int64)
    start = np.cumsum(size) - size
    rng = np.random.default_rng(7)
    emb, way, bias = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros((1, 2), np.float32)
    params = [emb, way, bias]
    one, two = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    truth = np.eye(2, dtype=np.float32)[label]
    fits = np.flatnonzero(~kept_back if kept_back.any() and (~kept_back).any() else np.ones(n, bool))
    back = np.flatnonzero(kept_back) if kept_back.any() else fits
    step, late, batch = 0, 0, min(BATCH, max(16, len(fits) // 30))

    def forward(some: np.ndarray):
        at = _runs(doc_start[some], doc_size[some])
        owner = np.repeat(np.arange(len(some)), doc_size[some])
        used, where = np.unique(words[at], return_inverse=True)
        part = flat[_runs(start[used], size[used])]
        of = np.repeat(np.arange(len(used)), size[used])
        vec = np.add.reduceat(emb[part], np.cumsum(size[used]) - size[used], axis=0) / size[used][:, None] if len(used) else np.zeros((0, DIM), np.float32)
        mean = GAIN * _by(owner, vec[where] * share[at][:, None], len(some))
        z = mean @ way + bias
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True), mean, (at, owner, used, where, part, of)

    def loss(some: np.ndarray) -> float:
        got = [-np.log(np.maximum((forward(c)[0] * truth[c]).sum(1), 1e-12)) for c in np.array_split(some, max(1, len(some) // BATCH))]
        return float(np.concatenate(got).mean())

    best, chosen = np.inf, [p.copy() for p in params]
    for _ in range(EPOCHS):
        for some in np.array_split(rng.permutation(fits), max(1, len(fits) // batch)):
            step += 1
            p, mean, (at, owner, used, where, part, of) = forward(some)
            d = (p - truth[some]) / len(some)
            to_word = _by(where, (GAIN * d @ way.T)[owner] * share[at][:, None], len(used)) / size[used][:, None]
            grads = [_by(part, to_word[of], BUCKETS), mean.T @ d, d.sum(0, keepdims=True)]
            for i, g in enumerate(grads):
                one[i] *= 0.9
                one[i] += 0.1 * g
                two[i] *= 0.99
                two[i] += 0.01 * g * g
                params[i] -= RATE * (one[i] / (1 - 0.9**step)) / (np.sqrt(two[i] / (1 - 0.99**step)) + 1e-6)
        now = loss(back)
        if now < best:
            best, chosen, late = now, [x.copy() for x in params], 0
        elif (late := late + 1) == 2:
            break
    seen = np.zeros(BUCKETS, bool)
    seen[flat] = True
    out = GAIN * (chosen[0] @ (chosen[1][:, 1] - chosen[1][:, 0]))
    return np.r_[np.where(seen, out, 0), chosen[2][0, 1] - chosen[2][0, 0]].astype(np.float64)


def train(texts: DataFrame, sample: int = SAMPLE, key: str = "doc_id") -> np.ndarray:
    """Weights fitted on (key, text, label) rows, label 0 or 1; of more than ``sample`` about so many, by a hash of the key, of texts with more than COUNTS words in all fewer.

    Words are counted in many tasks; the counts of the bounded sample meet in one, which fits. No rows, or one class
    only: a constant score.
    """
    rows = texts.where(F.col("label").isNotNull())
    n = rows.count()
    rows = rows.withColumn("_h", F.xxhash64(F.lit(11), key))
    drawn = lambda bits, share: F.pmod(bits, F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))
    if n > sample:
        rows = rows.where(drawn(F.col("_h"), sample / n))
    counted = rows.select("text", F.col("label").cast("int").alias("label"), (F.pmod(F.shiftright("_h", 48), F.lit(FOLD)) == 0).alias("back"), "_h")

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            counts = [Counter(words_of(t)) for t in part.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32())), *part.columns[1:]], names=["words", "counts", "label", "back", "h"])

        return run

    bags = stored(counted.mapInArrow(by_slices(make), "words array<string>, counts array<int>, label int, back boolean, h long"), "bags")
    held = bags.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    if held > COUNTS:
        bags = bags.where(drawn(F.xxhash64(F.lit(12), "h"), COUNTS / held))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        ids: dict[str, int] = {}
        words, counts, sizes, label, back = [], [], [], [], []
        for part in slices(batches):
            coded = part.column(0).flatten().dictionary_encode()
            own = np.array([ids.setdefault(w, len(ids)) for w in coded.dictionary.to_pylist()], np.int32)
            words.append(own[coded.indices.to_numpy()])
            counts.append(part.column(1).flatten().to_numpy().astype(np.float32))
            sizes.append(part.column(0).value_lengths().to_numpy())
            label.append(part.column(2).to_numpy())
            back.append(part.column(3).to_numpy(zero_copy_only=False))
        label = np.concatenate([np.empty(0, np.int32), *label])
        if len(set(label.tolist())) < 2:
            weights = np.r_[np.zeros(BUCKETS), -3.0 if not label.any() else 3.0]
        else:
            doc = np.repeat(np.arange(len(label), dtype=np.int32), np.concatenate(sizes))
            weights = fit(np.concatenate(words), doc, np.concatenate(counts), list(ids), label, np.concatenate(back))
        yield pa.RecordBatch.from_pydict({"weights": pa.array([weights.tobytes()], pa.binary())})

    first = bags.repartition(1).sortWithinPartitions("h").mapInArrow(one, "weights binary").first()
    return np.frombuffer(first.weights) if first else np.r_[np.zeros(BUCKETS), -3.0]  # no rows, no task


class Scorer:
    """Scores texts; what a word adds is worked out once and kept for a bounded number of words."""

    MOST = 100_000

    def __init__(self, weights: np.ndarray):
        self.bias, self.of, self.new, self.old = float(weights[-1]), weights[:-1].tolist(), {}, {}

    def word(self, w: str) -> float:
        got = self.old.get(w)
        if got is None:
            ids, of = parts(w), self.of
            got = sum([of[i] for i in ids]) / len(ids)
        if len(self.new) >= self.MOST:
            self.old, self.new = self.new, {}
        self.new[w] = got
        return got

    def score(self, text: str | None) -> float:
        words = words_of(text)
        get = self.new.get
        total = 0.0
        for w in words:
            v = get(w)
            if v is None:
                v = self.word(w)
                get = self.new.get
            total += v
        z = self.bias + total / (len(words) + PRIOR)
        return float(1 / (1 + np.exp(-max(-700.0, min(700.0, z)))))


def scored(docs: DataFrame, weights: np.ndarray, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """``keep`` columns and the score of every whole text; null and empty texts get the score of no words. The weights' size is fixed."""
    sent = docs.sparkSession.sparkContext.broadcast(np.asarray(weights, np.float64))
    kept = docs.select(*keep, F.col(text).alias("_scored_text"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField(name, T.DoubleType())])

    def make():
        scorer = Scorer(sent.value)

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([scorer.score(t) for t in part.columns[-1].to_pylist()], pa.float64())], names=[*keep, name])

        return run

    return kept.mapInArrow(by_slices(make), schema)


def held_out(key: str, m: int = 4, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % F.lit(m) == rest, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, train_on: DataFrame | None = None, sample: int = SAMPLE, key: str = "doc_id") -> DataFrame:
    """key, held_out, score, predicted (1 from a score of 0.3) of every document.

    Labels are learned only from rows that are not held out (crc32 of the key as text, modulo 4, is 2), of ``train_on`` (the documents
    themselves if none is given). Only the text is read by a score. Repeated rows give equal rows, several labels of one
    document count as one row each, an empty table gives an empty one, other columns are left out.
    """
    source = docs if train_on is None else train_on
    out = scored(docs, fitted(source, labels, sample, key), [key])
    return out.select(key, held_out(key).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id") -> np.ndarray:
    """Weights learned from the labelled documents that are not held out."""
    known = labels.select(F.col(key).alias("_k"), F.col("toxic").cast("int").alias("label")).where("label in (0, 1)")
    return train(docs.select(key, "text").where(~held_out(key)).join(known, F.col(key) == F.col("_k")).select(key, "text", "label"), sample, key)


def without_toxic(docs: DataFrame, labels: DataFrame, reject: float, key: str = "doc_id") -> DataFrame:
    """The documents, all columns, whose score is under ``reject``. Held-out labels are not learned here either."""
    return scored(docs, fitted(docs, labels, key=key), docs.columns, name="_toxicity").where(F.col("_toxicity") < reject).drop("_toxicity")
