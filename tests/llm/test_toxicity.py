"""Toxicity: what it learns, who is held out, edge cases."""

import random
import zlib

from quire.llm import queries, toxicity


def test_query_contract(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op1_subword_softmax(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_unseen_misspellings_are_found_and_edges_hold(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(300)]
    docs, labels = [], []
    for i in range(1200):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(rng.randint(10, 30))]
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["xyzzyq", "wvutsr"]) + "".join(rng.choice("abcdefghij") for _ in range(2))
        docs.append((i, " ".join(text), 1 if toxic else 0))
        labels.append((i, int(toxic), 0))
    docs += [(5000, None, 0), (5001, "", 0), (5002, "xyzzyqst " * 20000, 0), (5002, "xyzzyqst " * 20000, 0), (None, "x", 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    out = toxicity.toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int, score int"))
    held = [(r.predicted, r.doc_id % 4 == 0) for r in out.where("held_out and doc_id < 5000").collect()]
    assert sum(a == b for a, b in held) / len(held) > 0.9
    rest = [(r.doc_id, r.predicted) for r in out.where("doc_id >= 5000").collect()]
    assert sorted(rest)[2:] == [(5002, 1), (5002, 1)] and rest[0][1] == rest[1][1]
    assert toxicity.toxicity(d.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int, score int")).count() == 0


def test_what_stands_far_inside_a_long_run_counts():
    rng = random.Random(2)
    chars = [chr(0x4E00 + k) for k in range(400)]
    run = lambda n: "".join(rng.choice(chars) for _ in range(n))
    clean = run(600)
    weights = toxicity.np.zeros(toxicity.BUCKETS + 1)
    weights[toxicity.parts("\u7b28\u86cb\u6df7\u8d26")[1:]] = 50.0
    score = toxicity.Scorer(weights).score
    for at in (41, 77, 300, 596):
        assert score(clean[:at] + "\u7b28\u86cb\u6df7\u8d26" + clean[at:]) != score(clean)
    for n in (1, 39, 40, 41, 44, 75, 76, 77, 112, 500):
        w = run(n)
        whole = {w[i : i + g] for g in toxicity.GRAMS for i in range(n - g + 1)}
        assert whole <= {p[i : i + g] for p in toxicity.words_of(w) for g in toxicity.GRAMS for i in range(len(p) - g + 1)}
    assert toxicity.words_of("short words_only " + "x" * 40) == ["short", "words_only", "x" * 40]


def plain_fit(bags, label, back):
    """The same training, text by text and part by part: gradient of the mean loss of a batch, then Adam."""
    np, t = toxicity.np, toxicity
    rng = np.random.default_rng(7)
    params = [rng.normal(0, 0.02, (t.BUCKETS, t.DIM)), rng.normal(0, 0.5, (t.DIM, 2)), np.zeros(2)]
    one, two, step = [0 * p for p in params], [0 * p for p in params], 0
    fits, kept = np.flatnonzero(~back), np.flatnonzero(back)

    def text_mean(bag):
        total = sum(bag.values()) + t.PRIOR
        return t.GAIN * sum((c / total * np.mean([params[0][i] for i in t.parts(w)], 0) for w, c in bag.items()), np.zeros(t.DIM))

    def chances(bag):
        z = text_mean(bag) @ params[1] + params[2]
        p = np.exp(z - z.max())
        return p / p.sum()

    best, chosen, late = np.inf, None, 0
    batch = min(t.BATCH, max(16, len(fits) // 30))
    for _ in range(t.EPOCHS):
        for some in np.array_split(rng.permutation(fits), max(1, len(fits) // batch)):
            step += 1
            grads = [0 * p for p in params]
            for d in some:
                delta = (chances(bags[d]) - np.eye(2)[label[d]]) / len(some)
                grads[1] += np.outer(text_mean(bags[d]), delta)
                grads[2] += delta
                total = sum(bags[d].values()) + t.PRIOR
                for w, c in bags[d].items():
                    ids = t.parts(w)
                    for i in ids:
                        grads[0][i] += t.GAIN * c / total / len(ids) * (params[1] @ delta)
            for i, g in enumerate(grads):
                one[i] = 0.9 * one[i] + 0.1 * g
                two[i] = 0.99 * two[i] + 0.01 * g * g
                params[i] = params[i] - t.RATE * (one[i] / (1 - 0.9**step)) / (np.sqrt(two[i] / (1 - 0.99**step)) + 1e-6)
        now = -np.mean([np.log(chances(bags[d])[label[d]]) for d in kept])
        if now < best:
            best, chosen, late = now, [p.copy() for p in params], 0
        elif (late := late + 1) == 2:
            break
    seen = {i for b in bags for w in b for i in t.parts(w)}
    out = t.GAIN * chosen[0] @ (chosen[1][:, 1] - chosen[1][:, 0])
    return np.r_[[v if i in seen else 0 for i, v in enumerate(out)], chosen[2][1] - chosen[2][0]]


def test_training_is_the_plain_gradient(monkeypatch):
    monkeypatch.setattr(toxicity, "BUCKETS", 97)
    monkeypatch.setattr(toxicity, "EPOCHS", 3)
    np, rng = toxicity.np, random.Random(6)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(30)]
    bags = [toxicity.Counter(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(50)]
    label = np.array([int(any(w.startswith("a") for w in b)) for b in bags])
    back = np.arange(50) % 5 == 0
    vocabulary = sorted({w for b in bags for w in b})
    at = {w: i for i, w in enumerate(vocabulary)}
    flat = [(at[w], d, c) for d, b in enumerate(bags) for w, c in b.items()]
    w, d, c = (np.array(x) for x in zip(*flat))
    got = toxicity.fit(w.astype(np.int32), d.astype(np.int32), c.astype(np.float32), vocabulary, label, back)
    want = plain_fit(bags, label, back)
    assert np.abs(got - want).max() < 1e-3 * max(1, np.abs(want).max())


def test_query_scores_are_plain_means(spark, sf):
    """Every score of the query from the fitted weights: the mean over words of the mean over parts, and the odds of it."""
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    weights = toxicity.fitted(docs, labels)
    got = {r.doc_id: r.score for r in queries.op1_subword_softmax(spark, sf).collect()}
    for r in docs.collect():
        words = toxicity.words_of(r.text)
        z = weights[-1] + sum(sum(weights[i] for i in toxicity.parts(w)) / len(toxicity.parts(w)) for w in words) / (len(words) + toxicity.PRIOR)
        assert abs(got[r.doc_id] - 1 / (1 + toxicity.np.exp(-z))) < 1e-9


def test_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "COUNTS", 3000)
    docs = spark.range(2000).selectExpr("id as doc_id", "concat_ws(' ', 'w', id, id % 7, 'x', id % 50) as text", "cast(id % 2 as int) as label")
    weights = toxicity.train(docs, 500)
    assert len(weights) == toxicity.BUCKETS + 1 and weights.any()
