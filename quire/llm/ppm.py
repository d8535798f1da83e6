"""Language-model scores: prediction by partial matching over bytes, pretrained on the corpus.

The model is a trie of byte contexts up to an order, as counts of (context,
next byte). A byte seen in the longest known context is coded there; else an
escape (method C) leads to the next shorter context, where the bytes of the
longer one are excluded. As the model is fixed while it scores, the probability
of a byte depends on its context alone: it is worked out once for every
(context, byte) that any text has, the order being the same at every size.

Counting is a shuffle with sums made in every task first. Contexts that share
their last two bytes meet in one task with all that is longer (at most 2^24
entries, a fixed bound); the two shortest orders are 2^16 counts that all tasks
get. Scoring tasks hold the most frequent entries and words, at most so many;
what is rarer is joined by a shuffle, in which no key can be hot, and no task
ever reads the whole trie or vocabulary.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import held, scratch, slices, stored
from quire.llm.toxicity import held_out

#: Bytes of the longest context (at least two, at most six), and the most entries of the trie and words that every scoring task holds.
ORDER, GRAMS_HELD, WORDS_HELD = 4, 2_000_000, 200_000
#: Distinct entries that a counting task holds before it passes them on, and entries of whole groups that are worked out at once.
MOST_GRAMS, CHUNK = 4_000_000, 1 << 19
#: Two bytes that UTF-8 never has: before a text's first byte, and after its last.
BEFORE, END = 0xFF, 0xFE
SYMBOLS = 255
#: Bytes worked on at once, and bytes from which a digest stands for a word.
PIECE, LONG = 1 << 21, 32


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) as one number for each byte and end of the texts, and the position of its text."""
    data = np.frombuffer(b"".join(bytes((BEFORE,)) * order + t + bytes((END,)) for t in texts), np.uint8)
    g = np.zeros(len(data) - order, np.uint64)
    for j in range(order + 1):
        g = g << np.uint64(8) | data[j : len(data) - order + j]
    last = data[order:]
    real = last != BEFORE
    owner = np.cumsum(np.r_[0, (last == END)[:-1]]) if len(last) else np.zeros(0, int)
    return g[real], owner[real]


def pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PIECE bytes."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PIECE:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
    return k[start], np.add.reduceat(c, start) if len(start) else c


class Index:
    """Positions of distinct numbers: open addressing, filled and asked for whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            lost = self.slot[at] != left
            left, at = left[lost], at[lost] + 1 & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            got = self.slot[at]
            hit = (got >= 0) & (self.keys[got] == keys[left])
            out[left[hit]] = got[hit]
            on = (got >= 0) & ~hit
            left, at = left[on], at[on] + 1 & self.mask
        return out


class Model:
    """Log10 probabilities of grams from the counts of grams of the highest order.

    The counts may be those of some contexts only, if all contexts that end in the same two bytes are there; ``low`` are
    then the counts of all pairs (byte, byte) of the corpus.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, low: np.ndarray | None = None):
        self.order, self.levels = order, []
        per: list[tuple] = []
        for k in range(order, -1, -1):
            if k < 2 and low is not None:
                pairs = np.flatnonzero(low)
                g, c = summed([pairs.astype(np.uint64) & np.uint64((1 << 8 * (k + 1)) - 1)], [low[pairs]])
            else:
                g, c = summed([keys & np.uint64((1 << 8 * (k + 1)) - 1)], [counts.astype(np.int64)])
            ctx, start, which = np.unique(g >> np.uint64(8), return_index=True, return_inverse=True)
            n, d = (np.add.reduceat(c, start), np.diff(np.r_[start, len(g)])) if len(g) else (c, c)
            per.append((g, c, ctx, n, d, which))
        for i, (g, c, ctx, n, d, which) in enumerate(per):
            level = {"grams": Index(g), "count": c, "contexts": Index(ctx), "plain": n + d, "distinct": d}
            level["direct"] = np.log10(c / (n + d)[which]) if len(g) else c.astype(float)
            level["escape"] = np.log10(d / (n + d)) if len(g) else c.astype(float)
            if i:  # what escapes from the longer contexts find here
                lg, _, lctx, _, ld, lwhich = per[i - 1]
                k = order - i
                here = level["grams"].find(lg & np.uint64((1 << 8 * (k + 1)) - 1))
                taken = np.bincount(lwhich, c[here], minlength=len(lctx)).astype(np.int64) if len(lg) else np.zeros(0, np.int64)
                mine = level["contexts"].find(lctx & np.uint64((1 << 8 * k) - 1))
                level["rest"] = n[mine] - taken + d[mine] - ld
                level["new"] = d[mine] - ld
            self.levels.append(level)

    def logp(self, g: np.ndarray) -> np.ndarray:
        """Log10 probability of each gram's byte in its context."""
        at = self.levels[0]["grams"].find(g)
        out = np.where(at >= 0, self.levels[0]["direct"][np.maximum(at, 0)] if len(self.levels[0]["direct"]) else 0.0, 0.0)
        left = np.flatnonzero(at < 0)
        longer = np.full(len(left), -1, np.int64)  # the longer context an escape came from
        for i, level in enumerate(self.levels):
            if not len(left):
                break
            k = self.order - i
            key = g[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            ctx = level["contexts"].find(key >> np.uint64(8))
            hit = level["grams"].find(key)
            first, known = longer < 0, ctx >= 0
            new = level["new"][longer] if i and len(level["new"]) else np.zeros(len(left), np.int64)
            rest = np.maximum(level["rest"][longer], 1) if i and len(level["rest"]) else np.ones(len(left))
            if len(level["count"]):
                found = hit >= 0
                out[left[found]] += np.where(first[found], level["direct"][hit[found]], np.log10(level["count"][hit[found]] / rest[found]))
                step = np.where(first, level["escape"][ctx], np.where(new > 0, np.log10(np.maximum(new, 1) / rest), 0.0))
                out[left] += np.where(~found & known, step, 0.0)
            else:
                found = np.zeros(len(left), bool)
            left, longer = left[~found], np.where(known, ctx, -1)[~found]
        used = int(self.levels[-1]["distinct"][0]) if len(self.levels[-1]["distinct"]) else 0
        out[left] -= np.log10(max(1, SYMBOLS - used))
        return out


def _columns(folder: str) -> pads.Dataset:
    fs, root = pafs.FileSystem.from_uri(folder)
    return pads.dataset([f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet")], filesystem=fs, format="parquet")


def count_grams(docs: DataFrame, order: int, text: str, left_out: Column) -> DataFrame:
    """gram, n (times in what is learned from), every (times in all texts) of every gram of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0
        for part in slices(batches, 512):
            texts, learn = [(t or "").encode() for t in part.column(0).to_pylist()], ~part.column(1).to_numpy(zero_copy_only=False)
            for a, b in pieces(texts):
                g, owner = grams(texts[a:b], order)
                k, c = np.unique(g << np.uint64(1) | learn[a:b][owner].astype(np.uint64), return_counts=True)
                keys.append(k)
                counts.append(c)
                size += len(k)
                if size > MOST_GRAMS:
                    k, c = summed(keys, counts)
                    keys, counts, size = [k], [c], len(k)
                    if size > MOST_GRAMS // 2:
                        yield from emitted(k, c)
                        keys, counts, size = [], [], 0
        if keys:
            yield from emitted(*summed(keys, counts))

    def emitted(k: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(k), 1 << 18):
            part, n = k[at : at + (1 << 18)], c[at : at + (1 << 18)].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((part >> np.uint64(1)).view(np.int64)), pa.array(np.where(part & np.uint64(1), n, 0)), pa.array(n)], names=["gram", "n", "every"])

    return docs.select(text, left_out.alias("left_out")).mapInArrow(run, "gram long, n long, every long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))


def probabilities(counts: DataFrame, order: int) -> DataFrame:
    """gram, every, logp (log10 probability of its byte in its context) of every counted gram."""
    low = np.zeros(1 << 16, np.int64)
    for r in counts.where("n > 0").groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("pair")).agg(F.sum("n").alias("n")).collect():
        low[r.pair] = r.n
    dealt = counts.select(F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF)).alias("ends"), "gram", "n", "every").repartition("ends").sortWithinPartitions("ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append([x.to_numpy() for x in batch.columns])
            if sum(len(x[0]) for x in rest) >= CHUNK:
                cols = [np.concatenate(x) for x in zip(*rest)]
                cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last group may go on
                if cut:
                    yield from done([x[:cut] for x in cols])
                rest = [[x[cut:] for x in cols]]
        if rest:
            yield from done([np.concatenate(x) for x in zip(*rest)])

    def done(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        _, g, n, every = cols
        keys = g.view(np.uint64)
        logp = Model(keys[n > 0], n[n > 0], order, low).logp(keys)
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(every), pa.array(logp)], names=["gram", "every", "logp"])

    return dealt.mapInArrow(run, "gram long, every long, logp double")


def threshold(counts: DataFrame, count: str, most: int) -> int:
    """The smallest power of two that at most ``most`` rows' counts reach. Who does not reach it has under 2 / most of the sum."""
    bits = {r.b: r["count"] for r in counts.groupBy(F.length(F.bin(count)).alias("b")).count().collect()}
    b = max(bits, default=0) + 1
    while b > 1 and sum(n for k, n in bits.items() if k >= b - 1) <= most:
        b -= 1
    return 1 << (b - 1)


def held_grams(folder: str) -> tuple[Index, np.ndarray]:
    """The most frequent grams and their log10 probabilities, read once by a Python worker."""

    def read() -> tuple[Index, np.ndarray]:
        table = _columns(folder).to_table()
        return Index(table.column("gram").to_numpy().astype(np.int64).view(np.uint64)), table.column("logp").to_numpy().astype(float)

    return held(folder, read)


def short(word: bytes) -> bytes:
    """The word, or a digest of a long one; UTF-8 has no 0xFF, so neither can be taken for the other."""
    return word if len(word) <= LONG else b"\xff" + hashlib.blake2b(word, digest_size=16).digest()


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """word (UTF-8 bytes, long ones as digests), n over all texts; words are lower-cased in A-Z and parted by ASCII white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: defaultdict[bytes, int] = defaultdict(int)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(map(short, count)), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])
            count.clear()
            return out

        for part in slices(batches, 512):
            for t in part.column(0).to_pylist():
                for w in (t or "").encode().lower().split():
                    count[w] += 1
                if len(count) > 400_000:
                    yield flush()
        if count:
            yield flush()

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, modulus: int = 7, rest: int = 2, order: int = ORDER, text: str = "text", key: str = "doc_id", grams_held: int = GRAMS_HELD, words_held: int = WORDS_HELD) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Both models learn from all rows whose crc32 of the key as text, modulo ``modulus``, is not ``rest`` (rows without a key too). score is the
    log10 probability of the text's bytes and its end under the trie; base_score that of its words and
    one end by counts plus one. ``grams_held`` and ``words_held`` bound what a task holds and change no score. Null text: as empty (one token, the end). Repeated rows count and score as often as
    they stand; an empty table gives an empty one (with nothing to learn from every byte is equally likely); other columns are left out.
    """
    spark = docs.sparkSession
    left_out = held_out(key, modulus, rest)
    learn = docs.where(~left_out)
    counts = stored(count_grams(docs, order, text, left_out), "grams")
    known = stored(probabilities(counts, order), "probabilities")
    folder, often = scratch(spark, "held-grams"), F.col("every") >= threshold(counts, "every", grams_held)
    known.where(often).select("gram", "logp").repartition(4).write.parquet(folder)
    vocabulary = stored(count_words(learn, text), "words")
    n_words, n_distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = learn.count()
    tokens, distinct = n_words + ends, n_distinct + (ends > 0)
    frequent = F.col("n") >= threshold(vocabulary, "n", words_held)
    common = spark.sparkContext.broadcast({bytes(r.word): math.log10(r.n + 1) for r in vocabulary.where(frequent).collect()})
    kept = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = kept.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, logp = held_grams(folder)
        log_of = common.value.get
        for part in slices(batches, 512):
            texts = [(t or "").encode() for t in part.column(1).to_pylist()]
            scores, rare_grams, gram_times, gram_owner = [], [], [], []
            for a, b in pieces(texts):
                g, owner = grams(texts[a:b], order)
                at = index.find(g)
                scores.append(np.bincount(owner, np.where(at >= 0, logp[at] if len(logp) else 0.0, 0.0), minlength=b - a))
                if (at < 0).any():
                    own, first, c = np.unique(np.stack([owner[at < 0], g[at < 0].view(np.int64)], 1), axis=0, return_index=True, return_counts=True)
                    rare_grams.append(own[:, 1])
                    gram_times.append(c)
                    gram_owner.append(own[:, 0] + a)
            rows, rare, times, ends_at = [], [], [], [0]
            for t in texts:
                words = t.lower().split()
                seen, logs = 0, 0.0
                for w, c in Counter(words).items():
                    k = short(w)
                    log = log_of(k)
                    if log is None:
                        rare.append(k)
                        times.append(c)
                    else:
                        seen += c
                        logs += c * log
                ends_at.append(len(rare))
                rows.append((len(words) + 1, seen, logs))
            whole = lambda x: np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64)
            of_words = pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int32())], names=["word", "c"]))
            sizes = np.bincount(whole(gram_owner), minlength=len(texts))
            of_grams = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.StructArray.from_arrays([pa.array(whole(rare_grams)), pa.array(whole(gram_times))], names=["gram", "c"]))
            n, seen, logs = zip(*rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(seen, pa.int64()), pa.array(logs, pa.float64()), pa.array(np.concatenate(scores)), of_words, of_grams], names=["key", "n_tokens", "seen", "logs", "score", "words", "grams"])

    made = kept.mapInArrow(run, f"key {kind}, n_tokens long, seen long, logs double, score double, words array<struct<word: binary, c: int>>, grams array<struct<gram: bigint, c: bigint>>")
    made = stored(made.withColumn("row", F.monotonically_increasing_id()), "scores")  # numbers are settled once written
    zero = F.lit(0.0)
    rare = made.select("row", F.explode("words").alias("w")).select("row", "w.*").join(vocabulary.where(~frequent), "word").select("row", F.col("c").cast("long").alias("seen"), (F.col("c") * F.log10(F.col("n") + 1)).alias("logs"), zero.alias("score"))
    rare_grams = made.select("row", F.explode("grams").alias("g")).select("row", "g.*").join(known.where(~often), "gram").select("row", F.lit(0).cast("long").alias("seen"), zero.alias("logs"), (F.col("c") * F.col("logp")).alias("score"))
    # what a row has in one of its own columns comes from the tables here: sums by row, made in every task first
    out = made.select("row", "seen", "logs", "score").unionByName(rare).unionByName(rare_grams).groupBy("row").agg(F.sum("seen").alias("seen"), F.sum("logs").alias("logs"), F.sum("score").alias("score"))
    out = made.select("row", F.col("key").alias(key), "n_tokens").join(out, "row")
    base = F.col("logs") + math.log10(ends + 1) - F.col("n_tokens") * math.log10(tokens + distinct + 1)
    return out.select(key, left_out.alias("held_out"), "n_tokens", (F.col("seen") + int(ends > 0)).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
