"""The corpus pipeline, stage by stage, against what each stage must do to its own input."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from paperloom.llm import quality


@pytest.fixture(scope="module")
def stages(spark, small):
    """(input, output) rows of each stage, each output written and reread."""
    from paperloom.llm.common import cut

    docs, out = spark.read.parquet(f"{small}/documents.parquet"), {}
    for name, f in corpus_pipeline.STAGES:
        result = cut(f(spark, docs, small), "stage")
        out[name] = (docs, result)
        docs = result
    return out


def body(t):
    return (t or "").encode().lower()


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "substring dedup", "packing"]


def test_columns_stay(stages, docs):
    for name, (_, result) in list(stages.items())[:-1]:
        assert result.dtypes == docs.dtypes, name


def test_quality_stage(stages, spark, small):
    before, after = stages["quality classifier"]
    scored = quality.quality_scores(before, spark.read.parquet(f"{small}/labels.parquet"))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scored.collect() if r.predicted}


def test_exact_stage(stages):
    before, after = stages["exact dedup"]
    best = {}
    for r in before.collect():
        best[body(r.text)] = max(best.get(body(r.text), r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(best.values())


def test_substring_stage(stages):
    before, after = stages["substring dedup"]
    rows = sorted((r.doc_id, (r.text or "").encode().split()) for r in before.collect())
    first = {}
    for i, w in rows:
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = {}
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        want[i] = hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()
    got = after.collect()
    assert {r.doc_id: hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() for r in got} == want
    assert all(r.n_chars == len(r.text or "") for r in got)


def test_packing_stage(stages):
    before, after = stages["packing"]
    got = after.collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in before.collect()}
    whole = {r.doc_id: r.doc_tokens for r in got}
    placed = {}
    for r in got:
        placed[r.doc_id] = placed.get(r.doc_id, 0) + r.length
    assert placed == whole


def test_run_equals_its_stages(stages, spark, small):
    """Placement depends on partitions, the tokens of each document don't."""
    total = lambda rows: sorted({(r.doc_id, r.doc_tokens) for r in rows})
    assert total(corpus_pipeline.run(spark, small).collect()) == total(stages["packing"][1].collect())


def test_stages_take_nulls_and_empty_tables(spark, small, docs):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, None, "s", None)], docs.schema)
    for table in (odd, docs.where("false")):
        current = table
        for name, f in corpus_pipeline.STAGES:
            current = f(spark, current, small)
            current.collect()


def test_near_stage_links_by_similarity(stages):
    """Five-word shingles with a Jaccard similarity of 0.8 or more, whatever their fingerprints."""
    before, after = stages["simhash near-dedup"]
    assert sorted(r.doc_id for r in after.collect()) == similar_brute([(r.doc_id, r.text) for r in before.collect()])


def similar_brute(rows):
    def shingles(t):
        w = body(t).split()
        return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}

    rows = sorted((i, shingles(t)) for i, t in rows)
    parent = {i: i for i, _ in rows}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, (i, x) in enumerate(rows):
        for j, y in rows[:a]:
            if 5 * len(x & y) >= 4 * len(x | y):
                u, v = find(i), find(j)
                parent[max(u, v)] = min(u, v)
    return sorted({find(i) for i in parent})


def test_near_stage_keeps_all_links_of_groups(spark, small, docs):
    """Chains and groups at and around 0.8, short texts, and copies that share a common passage."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(3000)]
    passage, rows = list(rng.choice(words, 30)), []
    for _ in range(12):
        base = list(rng.choice(words, rng.integers(1, 90))) + passage
        for _ in range(10):
            edited = list(base)
            for _ in range(rng.integers(0, 4)):
                edited[rng.integers(len(edited))] = str(rng.choice(words))
            rows.append(" ".join(edited))
    rows += ["", " ", "a b c d e", "a b  c d e", "a b c d", "a b c d e f"]
    rows = [(k, t) for k, t in enumerate(rows)]
    table = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], docs.schema).repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table, small).collect())
    assert got == similar_brute(rows)
    assert 20 < len(got) < len(rows)


def test_sketches_lose_no_link_of_long_texts_and_drop_the_others(spark, small, docs):
    """Long texts that share a passage: those at and around 0.8 are decided as by brute force, and unrelated pairs go before their sets do."""
    from paperloom.llm import similar
    from paperloom.llm.common import TEXT_ROWS, BATCH_ROWS, cut_at

    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(20000)]
    passage, texts = list(rng.choice(words, 400)), []
    for size in (60, 520, 900, 1500, 1640, 2500):
        base = list(rng.choice(words, size)) + passage[: size // 2]
        for share in (0.0, 0.01, 0.02, 0.022, 0.024, 0.03):
            edited = [str(rng.choice(words)) if rng.random() < share else w for w in base]
            texts.append(" ".join(edited[: len(edited) - int(size * share * 2)]))
    rows = list(enumerate(texts))
    table = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], docs.schema).repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table, small).collect())
    assert got == similar_brute(rows) and 6 <= len(got) < len(rows)

    held, _ = cut_at(similar.prefixes(table, np.zeros(similar.CELLS, np.int64)), "held", TEXT_ROWS)
    assert spark.conf.get(BATCH_ROWS) == "10000"
    a, b = held.alias("a"), held.alias("b")
    pairs = a.join(b, similar.F.col("a.node") < similar.F.col("b.node")).select(similar.F.col("a.node").alias("u"), similar.F.col("b.node").alias("v")).distinct()
    left = {(r.u, r.v) for r in similar.alike(pairs, held).collect()}
    sets = {similar.node_of(similar.words_of(t)): set(similar.shingle_set(similar.words_of(t)).tolist()) for t in texts}
    likeness = {(u, v): len(sets[u] & sets[v]) / len(sets[u] | sets[v]) for u in sets for v in sets if u < v}
    assert {p for p, x in likeness.items() if x >= 0.8} <= left
    assert not {p for p in left if likeness[p] < 0.6}


def test_sketches_fold():
    from paperloom.llm import similar

    own = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 3000, dtype=np.uint64))
    wide = similar.parities(own, 4096)
    assert (similar.parities(own, 2048) == wide[:32] ^ wide[32:]).all() and len(similar.sketch(own)) == 64
    assert len(similar.sketch(own[:512])) == 0 and len(similar.sketch(own[:513])) == 16
