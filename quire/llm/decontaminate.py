"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap of question and answer.

The test items are the index, and every passage of every training document (overlapping windows of words) is a query.
Weights are BM25 divided by what the item itself would score, so one threshold means the same for every item. The lists are
cut into blocks of segments with their largest weights. WAND's test, that the largest weights of the query's words add up to
the threshold, is put to a whole batch of passages and to every block that a word of theirs stands in; only blocks that pass
are scored, from their postings, and every segment at or above the threshold is a hit. As in other block-max searches common
words do not open blocks: what those of a segment can add is a constant of its block. A hit is confirmed by shared word
shingles of the item's question and of its answer.

What the weights need of the whole benchmark (segments, their mean length, in how many a word stands) is counted by Spark
over all items, so scores are the same in however many shards the index is broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import slices, stored

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
WINDOW, STRIDE = 64, 32
#: Share of an item's own score that a passage must reach, and that part of it which common words may have.
THRESHOLD, COMMON = 0.5, 0.4
#: Segments in a block.
BLOCK = 8
#: Words of a shingle, and shares of them that confirm.
SHINGLE, CONFIRM = 5, 0.5
#: Characters of test items in one broadcast index, as expected: items are dealt to shards by a hash.
SHARD = 16 << 20
#: Cells (window, block) of the bounds at once, and cells (block that passed, word) of the scores.
CELLS = 1 << 21


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_answer(text: str | None) -> tuple[str, str]:
    """The last sentence (or line) of an item is its answer; an item of one sentence is all question."""
    body = (text or "").strip()
    cut = max((m.end() for m in re.finditer(r"[.!?\n]\s+(?=\S)", body)), default=0)
    return (body[:cut], body[cut:]) if cut else (body, "")


def shingles(w: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    n = min(n, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def segments(w: list[str]) -> list[list[str]]:
    """An item's words in parts of nearly equal length, at most WINDOW words each."""
    step = -(-len(w) // -(-len(w) // WINDOW)) if w else 1
    return [w[at : at + step] for at in range(0, len(w), step)]


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all the runs (start, size), one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Index:
    """Inverted lists over the items' segments with block maxima. df: in how many segments of the whole benchmark a word stands; n, mean: their number and mean length."""

    def __init__(self, items: list[tuple[int, str | None]], df: dict[str, int], n: int, mean: float, threshold: float = THRESHOLD):
        self.threshold, self.items, self.owner = threshold, [], []
        parts: list[list[str]] = []
        for item, text in items:
            if w := words(text):
                q, a = question_answer(text)
                self.items.append((item, shingles(words(q)), shingles(words(a)), len(w)))
                parts += (cut := segments(w))
                self.owner += [len(self.items) - 1] * len(cut)
        self.blocks = -(-len(parts) // BLOCK)
        self.term = {t: i for i, t in enumerate(sorted({t for s in parts for t in s}))}  # the same order in every shard: sums are the same
        post, essential, slack = [], [], np.zeros(self.blocks)
        for s, seg in enumerate(parts):
            # term frequency saturates by the item's own counts; the passage asks for each word once
            raw = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(seg) / mean)) for t, c in Counter(seg).items()}
            total, common = sum(raw.values()), 0.0
            post += [(self.term[t], s, v / total) for t, v in raw.items()]
            for t in sorted(raw, key=lambda t: (-df[t], t)):
                if common + raw[t] / total < threshold * COMMON:
                    common += raw[t] / total
                else:
                    essential.append((self.term[t], s // BLOCK, raw[t] / total))
            slack[s // BLOCK] = max(slack[s // BLOCK], common)
        self.slack = slack
        # postings by word and segment, and where each (word, block) begins
        term, seg, val = (np.array([p[i] for p in post], t) for i, t in ((0, np.int64), (1, np.int64), (2, float)))
        order = np.lexsort((seg, term))
        self.seg, self.val = seg[order], val[order]
        self.at, self.start, self.size = np.unique((term * self.blocks + seg // BLOCK)[order], return_index=True, return_counts=True)
        # block maxima of essential words, by word
        term, block, val = (np.array([p[i] for p in essential], t) for i, t in ((0, np.int64), (1, np.int64), (2, float)))
        key, which = np.unique(term * self.blocks + block, return_inverse=True) if len(term) else (term, term)
        self.top = np.zeros(len(key))
        np.maximum.at(self.top, which, val)
        self.top_block = key % max(1, self.blocks)
        self.top_size = np.bincount(key // max(1, self.blocks), minlength=len(self.term)).astype(np.int64)
        self.top_start = np.cumsum(self.top_size) - self.top_size

    def search(self, ids: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, segment, score) of every hit. ids: word of each place (-1: none of the index), window: the last window the place lies in; it lies in the one before too."""
        width, known = max(1, len(self.term)), ids >= 0
        asked = np.unique(np.concatenate([window[known], window[known] - 1]) * width + np.tile(ids[known], 2))
        asked_window, asked_term = asked // width, asked % width
        passed_window, passed_block = self.passing(asked_window, asked_term)
        out: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        first, last = np.searchsorted(asked_window, passed_window), np.searchsorted(asked_window, passed_window, side="right")
        for at in range(0, len(passed_window), step := CELLS // WINDOW):
            size = (last - first)[at : at + step]
            owner = np.repeat(np.arange(len(size)), size)
            key = asked_term[runs(first[at : at + step], size)] * self.blocks + passed_block[at + owner]
            place = np.minimum(np.searchsorted(self.at, key), len(self.at) - 1)
            hit = self.at[place] == key
            place, owner = place[hit], owner[hit]
            post = runs(self.start[place], self.size[place])
            cell = np.repeat(owner, self.size[place]) * BLOCK + self.seg[post] % BLOCK
            score = np.bincount(cell, self.val[post], minlength=len(size) * BLOCK)
            good = np.flatnonzero(score >= self.threshold - 1e-12)
            out.append((passed_window[at + good // BLOCK], passed_block[at + good // BLOCK] * BLOCK + good % BLOCK, score[good]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def passing(self, window: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, block) whose bound reaches the threshold, of the windows' distinct words sorted by window."""
        some = self.top_size[term] > 0 if len(self.top_size) else np.zeros(len(term), bool)
        window, term = window[some], term[some]
        out, step, at = [(np.empty(0, np.int64), np.empty(0, np.int64))], max(1, CELLS // max(1, self.blocks)), 0
        while at < len(window):  # the bounds of a few windows at a time
            low = window[at]
            to = int(np.searchsorted(window, low + step))
            size = self.top_size[term[at:to]]
            top = runs(self.top_start[term[at:to]], size)
            span = int(window[to - 1] - low) + 1
            bound = np.bincount((np.repeat(window[at:to], size) - low) * self.blocks + self.top_block[top], self.top[top], minlength=span * self.blocks).reshape(span, self.blocks)
            w, b = np.nonzero(bound + self.slack >= self.threshold - 1e-9)
            out.append((w + low, b))
            at = to
        return tuple(np.concatenate(x) for x in zip(*out))

    def leaks(self, texts: list[str | None]) -> list[dict[int, tuple[float, float, float]]]:
        """Confirmed items of each document: score, question overlap, answer overlap."""
        all_words = [words(t) for t in texts]
        sizes = np.array([len(w) for w in all_words], np.int64)
        get = self.term.get
        ids = np.fromiter((get(x, -1) for w in all_words for x in w), np.int64, int(sizes.sum()))
        # windows of a document are numbered from its first one on; one number is left free between two
        first = np.cumsum(np.r_[0, sizes // STRIDE + 2])[:-1] + 1
        window = np.repeat(first, sizes) + (np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // STRIDE
        hits = [{} for _ in texts]
        for w, seg, score in zip(*(x.tolist() for x in self.search(ids, window))):
            d = int(np.searchsorted(first, w, side="right")) - 1
            if d < 0 or w < first[d]:
                d += 1
            key = self.owner[seg], max(0, w - int(first[d])) * STRIDE
            hits[d][key] = max(score, hits[d].get(key, 0.0))
        return [self._confirmed(w, h) for w, h in zip(all_words, hits)]

    def _confirmed(self, w: list[str], hits: dict[tuple[int, int], float]) -> dict[int, tuple[float, float, float]]:
        out: dict[int, tuple[float, float, float]] = {}
        for (own, lo), score in hits.items():
            item, q, a, size = self.items[own]
            near = w[max(0, lo - size) : lo + WINDOW + size]
            have = {n: shingles(near, n) for n in {len(next(iter(x))) for x in (q, a) if x}}
            of_q = len(q & have[len(next(iter(q)))]) / len(q) if q else 0.0
            of_a = len(a & have[len(next(iter(a)))]) / len(a) if a else of_q
            if of_q >= CONFIRM and (of_a >= CONFIRM or of_q >= (1 + CONFIRM) / 2):
                out[item] = max(out.get(item, (0.0, 0.0, 0.0)), (score, of_q, of_a))
        return out


def counted(texts: DataFrame) -> DataFrame:
    """term, n, size: in how many segments each word stands; the row without a term tells their number and the sum of their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            parts = [s for t in part.column(0).to_pylist() for s in segments(words(t))]
            n = Counter(t for s in parts for t in set(s))
            yield pa.RecordBatch.from_arrays([pa.array([None, *n], pa.string()), pa.array([len(parts), *n.values()], pa.int64()), pa.array([sum(map(len, parts)), *([0] * len(n))], pa.int64())], names=["term", "n", "size"])

    return texts.mapInArrow(run, "term string, n long, size long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))


def shards(items: DataFrame, threshold: float, text: str, item: str) -> list[Callable[[], Index]]:
    """What makes each shard's index in a task. A shard is broadcast with the counts of its own words."""
    spark = items.sparkSession
    shown = items.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null")
    chars = shown.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    number = int(-(-chars // SHARD)) or 1
    stats = stored(counted(shown.select("t")), "item-words")
    whole = stats.where("term is null").first()
    n, size = (whole.n, whole.size) if whole else (0, 0)

    def made(shard: int) -> Callable[[], Index]:
        own = shown.where(F.pmod(F.xxhash64("i"), F.lit(number)) == shard)
        df = stats.where("term is not null")
        if number > 1:
            df = df.join(counted(own.select("t")).select("term"), "term", "left_semi")
        sent = spark.sparkContext.broadcast(([tuple(r) for r in own.orderBy("i", "t").collect()], {r.term: r.n for r in df.collect()}))
        return lambda: Index(*sent.value, n, size / max(1, n), threshold)

    return [made(shard) for shard in range(number)]


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """key, item_id, score, question_overlap, answer_overlap for every test item that a document holds.

    An item is held if a passage reaches ``threshold`` of the item's own BM25 score and shares CONFIRM of the
    question's word shingles, with as many of the answer's or half again of the question's. Null, empty and
    wordless documents and items hold and match nothing; a document without a key is searched as any other; a repeated row repeats its rows; empty tables give an empty
    one; other columns are left out. The index is broadcast in shards of about SHARD characters; all passages meet each.
    """
    kept = docs.select(key, text)
    schema = f"`{key}` {kept.schema[0].dataType.simpleString()}, item_id long, score double, question_overlap double, answer_overlap double"

    def found(make: Callable[[], Index]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = make()
            for part in slices(batches, 256):
                rows = [(d, i, *got) for d, leaks in enumerate(index.leaks(part.column(1).to_pylist())) for i, got in sorted(leaks.items())]
                if rows:
                    at, *cols = zip(*rows)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *(pa.array(c, pa.float64() if k else pa.int64()) for k, c in enumerate(cols))], names=[key, "item_id", "score", "question_overlap", "answer_overlap"])

        return kept.mapInArrow(run, schema)

    first, *more = map(found, shards(items, threshold, text, item))
    for df in more:
        first = first.unionByName(df)
    return first


def without_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text: str = "text", item: str = "item_id") -> DataFrame:
    """The documents, all columns, that hold no test item; see contaminated(). Rows are dropped where they are read: no key is needed and nothing is shuffled."""

    def clean(df: DataFrame, make: Callable[[], Index]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = make()
            for part in slices(batches, 256):
                yield part.filter(pa.array([not leaks for leaks in index.leaks(part.column(text).to_pylist())], pa.bool_()))

        return df.mapInArrow(run, df.schema)

    for make in shards(items, threshold, text, item):
        docs = clean(docs, make)
    return docs
