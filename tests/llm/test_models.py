"""Language model, language identification, quality: brute force and held-out accuracy."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import brown, langid, quality


def bucket(doc_id, n):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


# ---- language model ------------------------------------------------------------------------


def lm_base(rows):
    """The contract's base score, counted plainly."""
    counts, end = Counter(), "<end>"
    words = {}
    for k, (i, t) in enumerate(rows):
        words[k] = [*(t or "").encode().lower().split(), end]
        if bucket(i, 7) not in (None, 2):
            counts.update(words[k])
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for k, (i, _) in enumerate(rows):
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words[k])
        out.append((i, bucket(i, 7) == 2, len(words[k]), sum(counts[w] > 0 for w in words[k]), total, round(base, 6)))
    return Counter(out)


@pytest.mark.parametrize("head", [brown.HEAD, 40, 0])
def test_lm_counts_and_base(edge, head):
    """With a small or empty head table, counts come from the join."""
    got = brown.lm_scores(edge, coverage=0.2, classes=4, head=head).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == lm_base([(r.doc_id, r.text) for r in edge.collect()])
    assert all(r.score < 0 and r.perplexity > 1 for r in got)


def test_lm_on_documents_beats_the_base(docs, rows):
    got = brown.lm_scores(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == lm_base(rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_head_does_not_change_scores(docs):
    whole = {r.doc_id: r.score for r in brown.lm_scores(docs, coverage=0.4).collect()}
    part = {r.doc_id: r.score for r in brown.lm_scores(docs, coverage=0.4, head=1500).collect()}
    assert whole == pytest.approx(part)


def test_lm_score_equals_plain_python(spark, docs, rows):
    """From the classes of all words, the score of each text is counted again plainly."""
    table = docs.where("crc32(cast(cast(doc_id AS string) AS binary)) % 7 != 2")
    words, others = brown.learn(table, table.count(), 0.4, 16, 300)
    known = {bytes(r.word): (r.n, r["class"]) for r in others.collect()} | words.head
    train = [[known[w][1] for w in brown.tokens(t)] for i, t in rows if bucket(i, 7) != 2]
    n, end = words.classes, words.classes
    pairs = Counter(p for line in train for p in zip([end, *line], [*line, end], strict=True))
    before = Counter(p for line in train for p in [end, *line])
    mass = Counter({c: sum(n for n, k in known.values() if k == c) for c in range(n)})
    kinds = Counter(c for _, c in known.values())
    once = Counter(c for k, c in known.values() if k == 1)
    assert words.unseen == max(range(n), key=lambda c: (once[c], -c))
    got = {r.doc_id: r.score for r in brown.lm_scores(docs, coverage=0.4, classes=16, head=300).collect()}
    for i, t in rows:
        line, emitted = [], 0.0
        for w in brown.tokens(t):
            k, c = known.get(w, (0, words.unseen))
            line.append(c)
            emitted += math.log10((k + 1) / (mass[c] + kinds[c] + (c == words.unseen)))
        steps = sum(math.log10((pairs[p] + brown.SMOOTHING) / (before[p[0]] + brown.SMOOTHING * (n + 1))) for p in zip([end, *line], [*line, end], strict=True))
        assert got[i] == pytest.approx(emitted + steps, abs=1e-6)


def test_lm_is_a_distribution(spark):
    """Over all next tokens, seen or one unseen, probabilities add up to one."""
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a b a c", "b a", "c c a b", "a", "rare ones here"] * 4)], "doc_id long, text string")
    words, others = brown.learn(docs, 20, 0.6, 2)
    chance, sizes = brown.transitions(brown.class_lines(docs, words, others), words.classes), words.sizes()
    known = {bytes(r.word): (r.n, r["class"]) for r in others.collect()} | words.head
    assert len(known) == 6
    mass = sum(10 ** (chance[-1, c] + math.log10(n + 1) - sizes[c]) for n, c in known.values())
    mass += 10 ** (chance[-1, words.unseen] - sizes[words.unseen])
    mass += 10 ** (chance[-1, -1] + math.log10(words.ends + 1) - sizes[-1])
    assert mass == pytest.approx(1.0)


def test_lm_other_words_join_the_likeliest_class(spark):
    """Rare words that stand where a clustered kind stands get its class, whatever they look like."""
    rng = np.random.default_rng(1)
    nouns, verbs = [f"n{k}" for k in range(9)], [f"v{k}" for k in range(4)]
    texts = [" ".join(str(rng.choice(c)) for _ in range(20) for c in (nouns, verbs)) for _ in range(60)]
    texts += [f"n1 {w} n2 v3 n4" for w in ("zzn", "qqn") for _ in range(3)] + [f"v1 {w} v2" for w in ("zzv", "qqv") for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    words, others = brown.learn(docs, len(texts), 0.97, 2)
    found = {bytes(r.word): r["class"] for r in others.collect()} | {w: c for w, (_, c) in words.head.items()}
    assert len({found[n.encode()] for n in nouns}) == len({found[v.encode()] for v in verbs}) == 1
    assert found[b"zzn"] == found[b"qqn"] == found[b"v0"] and found[b"zzv"] == found[b"qqv"] == found[b"n0"]


def test_hot_words_are_counted_before_the_shuffle(spark):
    """Contexts of a word that came often travel as counts; the class and the number are those of all its codes."""
    rng = np.random.default_rng(4)
    kinds_of, gains = np.arange(12) % 4, rng.normal(size=(4, 3))
    codes = {f"w{k}".encode(): [rng.integers(0, 12, 2 * n).astype("<u2") for n in sizes] for k, sizes in enumerate(((1,), (3, 2), (4000, 5000, 1), (900,)))}
    rows = [(w, c.tobytes()) for w, parts in codes.items() for c in parts]
    found = spark.createDataFrame(rows, "word binary, codes binary").repartition(3)
    sent = brown.counted_kinds(found, kinds_of, 4).collect()
    assert sum(len(r.kinds) + len(r.counts or b"") for r in sent) < 100 and sum(r.counts is not None for r in sent) == 3
    got = {bytes(r.word): (r.n, r["class"]) for r in brown.assigned_words(found, kinds_of, gains).collect()}
    for w, parts in codes.items():
        every = np.concatenate(parts)
        sums = np.bincount(kinds_of[every], minlength=4) @ gains
        assert got[w] == (len(every) // 2, int(np.round(sums, 6).argmax()))


def test_pairs_are_summed_in_order():
    rng = np.random.default_rng(5)
    pairs, want = brown._Pairs(), Counter()
    for _ in range(40):
        keys, counts = rng.integers(0, 5000, 20_000), rng.integers(1, 9, 20_000)
        pairs.add(keys, counts)
        for k, n in zip(keys.tolist(), counts.tolist(), strict=True):
            want[k] += n
    pairs.merge()
    assert dict(zip(pairs.keys.tolist(), pairs.counts.tolist(), strict=True)) == dict(want)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(2)
    bigrams = np.zeros((13, 13), np.int64)
    for a in range(12):
        for b in range(12):
            bigrams[a, b] = rng.poisson(30 if a % 3 == (b + 1) % 3 else 1)
    bigrams[12, :12], bigrams[:12, 12] = 1, 1

    def likelihood(assigned):
        n = assigned.max() + 1
        table = np.zeros((n, n))
        np.add.at(table, (assigned[:, None], assigned[None, :]), bigrams)
        x = lambda v: (v * np.log(np.maximum(v, 1))).sum()
        return x(table) - x(table.sum(0)) - x(table.sum(1))

    start = np.concatenate([np.random.default_rng(0).permutation(np.arange(12) % 3), [3]])
    cells = np.flatnonzero(bigrams)
    sparse = brown.Bigrams.of_cells(13, cells, bigrams.ravel()[cells])
    assert (sparse.by_class(np.arange(13), 13) == bigrams).all() and (sparse.turned().by_class(np.arange(13), 13) == bigrams.T).all()
    found = brown.exchange(sparse, 12, 3)
    assert likelihood(found) >= likelihood(start)
    groups = [{int(found[k]) for k in range(12) if k % 3 == r} for r in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


def test_lm_empty(empty):
    assert brown.lm_scores(empty).collect() == []


def test_smallest_hashes_equal_a_sort(spark):
    from paperloom.llm.common import smallest_hashes

    df = spark.range(20_000).withColumnRenamed("id", "k")
    want = [r.k for r in df.orderBy(F.xxhash64("k"), "k").limit(300).collect()]
    assert [r.k for r in smallest_hashes(df, "k", 300).collect()] == want
    assert smallest_hashes(df.where("k < 5"), "k", 300).count() == 5


# ---- languages -----------------------------------------------------------------------------


def test_language_held_out_accuracy(docs):
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert set(got) == set(lang)
    held = [i for i in lang if bucket(i, 4) == 2]
    assert {i for i in got if got[i].held_out} == set(held)
    assert np.mean([got[i].lang_pred == lang[i] for i in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    accepted = [i for i in held if not got[i].rejected]
    assert len(accepted) > len(held) / 2


def test_language_edges(docs, spark, empty):
    odd = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "123 ... !", "en"), (None, "the words", None), (4, "½ ²", "fr"), (5, "the " * 50_000, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs.select("doc_id", "text", "lang").where("doc_id > 50").unionByName(odd)).collect() if r.doc_id is None or r.doc_id <= 5}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1, 2, 3, 4))
    assert got[None].lang_pred != "und" and not got[None].held_out and got[5].lang_pred == "en"
    assert langid.identify(empty).collect() == []
    nothing = langid.identify(odd.where("lang IS NULL"))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_language_never_reads_held_out_labels(docs):
    changed = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang")))
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    assert a == {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(changed).collect()}


def test_language_scores_equal_plain_python(docs, rows):
    """The query's names and scores, byte run by byte run from the model's own table."""
    model = langid.train(docs, "doc_id", "text", "lang", langid.TRAIN_ROWS)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    bits = int(np.log2(len(model.logits)))
    for i, t in rows[:60]:
        if t is None or not any(c.isalpha() for c in t):
            assert got[i].lang_pred == "und"
            continue
        kept = "".join(c.lower() if c.isascii() and c.isalpha() else " " if c.isascii() else c for c in t)
        data = (" " + " ".join(x for x in kept.split(" ") if x) + " ").encode()
        found = [(int.from_bytes(data[k : k + n], "little") + n) * 2654435761 % 2**32 >> 32 - bits for n in (2, 3, 4) for k in range(len(data) - n + 1)]
        z = (sum(model.logits[f] for f in found) / len(found) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i].lang_pred == model.names[int(p.argmax())] and got[i].score == pytest.approx(p.max(), abs=1e-6)


def test_subword_counts():
    found = langid.counts("Ab, c")
    assert found.sum() == sum(len(" ab c ") - n + 1 for n in (2, 3, 4))


# ---- quality -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labels(spark, small):
    return spark.read.parquet(f"{small}/labels.parquet")


def auc(score, label):
    up = [s for s, y in zip(score, label, strict=True) if y]
    down = [s for s, y in zip(score, label, strict=True) if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in up for b in down])


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in truth if bucket(i, 5) == 0]
    assert len(got) == docs.count() and all(got[i].held_out for i in held)
    assert auc([got[i].score for i in held], [truth[i] for i in held]) > 0.95
    clean = [i for i in held if truth[i] == 1]
    assert np.mean([got[i].predicted for i in clean]) > 0.95
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())


def features_brute(text, bits=quality.BITS):
    """The three kinds of n-grams, one by one."""
    import xxhash

    words = text.encode().split()
    odd, whole = 0x9E3779B97F4A7C15, 1 << 64

    def hashed(symbols, order, bits):
        for start in range(len(symbols)):
            run = 0
            for n in range(min(order, len(symbols) - start)):
                run = (run * odd + symbols[start + n] + n + 1) % whole
                run ^= run >> 31
                yield run * odd % whole >> 64 - bits

    half, quarter = 1 << bits - 1, 1 << bits - 2
    out = set(hashed([xxhash.xxh32_intdigest(w.lower()) for w in words], 2, bits - 1))
    data = text.encode().lower()
    for k in range(len(data) - 3) if words else ():
        out.add(half + (int.from_bytes(data[k : k + 4], "little") * 2654435761 % (1 << 32) >> 34 - bits))
    shapes = [xxhash.xxh32_intdigest(quality._RUN.sub(lambda m: m[1] or m[2] * 2, w.translate(quality._KINDS))) for w in words]
    again = [k > 0 and w.lower() == words[k - 1].lower() and shapes[k] == shapes[k - 1] for k, w in enumerate(words)]
    out |= {half + quarter + x for x in hashed([2 * s + r for s, r in zip(shapes, again, strict=True)], 4, bits - 2)}
    return sorted(out)


@pytest.mark.parametrize("text", ["", " ", "a", "The the THE cat. 12 12", "x" * 3, "Éé straße 电压 !!! !!!!", "$$$ " * 40 + "very-long-word-with-a-shape-behind-its-sixteenth-character,9A9"])
def test_quality_features_equal_brute_force(text):
    assert quality.features(text).tolist() == features_brute(text)


def test_quality_shapes_are_whole():
    """What differs only behind a shape's sixteenth character is another feature."""
    a, b = "-a" * 12 + "9", "-a" * 12 + "A"
    quarter = 3 << quality.BITS - 2
    assert {x for x in quality.features(a).tolist() if x >= quarter} != {x for x in quality.features(b).tolist() if x >= quarter}


def test_quality_scores_equal_the_model(spark, docs, labels):
    """The query's scores, by a model fitted here on plainly chosen rows."""
    truth = {}
    for r in labels.collect():
        if r.quality in (0, 1):
            truth[r.doc_id] = min(truth.get(r.doc_id, 1), r.quality)
    rows = {r.doc_id: r.text for r in docs.collect()}
    used = sorted(i for i in truth if bucket(i, 5) != 0 and i in rows)
    model = quality.fit([np.array(features_brute(rows[i] or "")) for i in used], np.array([truth[i] for i in used]))
    for r in quality.quality_scores(docs, labels).collect():
        assert r.score == pytest.approx(model.score(quality.features(rows[r.doc_id])), abs=1e-9)


def test_quality_reads_words(spark):
    """Random letters in place of clean words lower the scores; clean texts of any words are kept."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.train(docs.select("doc_id", "text"), labels)
    clean = [r.text for r in docs.join(labels.where("quality = 1"), "doc_id").limit(150).collect()]
    rng = np.random.default_rng(5)
    random = ["".join(chr(97 + rng.integers(26)) if "a" <= c <= "z" else c for c in t) for t in clean]
    before, after = (np.array([model.score(quality.features(t)) for t in x]) for x in (clean, random))
    assert np.mean(after < before) > 0.9 and (after >= quality.THRESHOLD).all()


def test_quality_never_reads_held_out_labels(docs, labels):
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in quality.quality_scores(docs, flipped).collect()}


def test_quality_edges(edge, empty, labels, spark):
    got = quality.quality_scores(edge, labels.withColumn("score", F.lit(1))).collect()
    assert len(got) == edge.count() and not any(r.held_out for r in got if r.doc_id is None)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3, 15)}) == 1
    assert quality.quality_scores(empty, labels).collect() == []
    none = labels.where("false")
    assert {r.score for r in quality.quality_scores(edge, none).collect()} == {0.5}
    odd = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 7, 0), (5, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    assert len(quality.quality_scores(edge, odd).collect()) == edge.count()
    left = quality.without_rejects(edge, labels)
    assert left.columns == edge.columns


def test_dual_descent_solves_the_hinge_problem():
    """The dual solution's primal value is within a hundredth of the best found by subgradient steps."""
    rng = np.random.default_rng(0)
    rows = [np.unique(np.concatenate([rng.integers(0, 20, 4), rng.integers(20, 24, 1) if y else rng.integers(24, 28, 1)])) for y in [0, 1] * 60]
    labels = np.array([0, 1] * 60)
    ratio = np.ones(32)
    w, b = quality._descend(rows, labels, ratio, 1.0, 3000, 1, tolerance=1e-6)
    sign = np.where(labels > 0, 1, -1)

    def primal(w, b):
        return 0.5 * (w @ w + b * b) + sum(max(0.0, 1 - s * (w[r].sum() + b)) for s, r in zip(sign, rows, strict=True))

    v, c = np.zeros(32), 0.0
    best = primal(v, c)
    for step in range(1, 3000):
        g, h = v.copy(), c
        for s, r in zip(sign, rows, strict=True):
            if s * (v[r].sum() + c) < 1:
                g[r] -= s
                h -= s
        v, c = v - g / (10 + step), c - h / (10 + step)
        best = min(best, primal(v, c))
    assert primal(w, b) <= best * 1.01
