"""Phrase collocations against plain Python counts, their SQL and an online suffix automaton."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.llm import collocations, queries


def brute(rows, min_count=10, first=2000, max_words=3):
    counts, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        words[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            words[lang] += len(w)
            for size in range(1, max_words + 1):
                counts[lang].update(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
    out = []
    for lang, f in counts.items():
        held = {p: a for p, a in f.items() if a >= min_count}
        scored = []
        for p, a in held.items():
            if len(p) < 2:
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            longer = _containers(held, p)
            if not any(100 * b >= 50 * a for b in longer):
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def _containers(held, p, cache={}):  # noqa: B006
    if cache.get("of") is not held:
        index = defaultdict(list)
        for q, b in held.items():
            for size in range(1, len(q)):
                for j in range(len(q) - size + 1):
                    index[q[j : j + size]].append(b)
        cache.update(of=held, index=index)
    return cache["index"].get(p, [])


def got(df, **kw):
    return sorted(map(tuple, collocations.collocations(df, **kw).collect()))


def test_equals_brute_force_on_documents(docs):
    rows = [(r.lang, r.text) for r in docs.collect()]
    want = brute(rows)
    assert want and got(docs) == want


@pytest.mark.parametrize("options", [{"shard_words": 500, "bucket_bytes": 20_000}, {"shard_words": 3000}, {}])
def test_edges(edge, options):
    """Clashing columns, nulls, repeated rows; tiny shards and buckets; one word a third of all."""
    langs = edge.withColumn("lang", F.when(F.col("doc_id") > 9, "x\ty\n").when(F.col("doc_id") > 6, F.lit(None)).otherwise("en"))
    rows = [(r.lang, r.text) for r in langs.select("lang", "text").collect()]
    for min_count, first in ((2, 2000), (10, 3)) if not options else ((2, 2000),):
        assert got(langs, min_count=min_count, first=first, **options) == brute(rows, min_count, first)


def test_longer_phrases(spark, rows):
    df = spark.createDataFrame([("a", t) for _, t in rows if t] + [("a", "p q r s t. p q r s t! q r s") for _ in range(9)], "lang string, text string")
    plain = [(r.lang, r.text) for r in df.collect()]
    assert got(df, max_words=5, min_count=5) == brute(plain, 5, max_words=5)


def test_empty(spark, empty):
    assert got(empty) == []
    assert got(spark.createDataFrame([("en", None), (None, ""), ("en", "a. b, c")], "lang string, text string")) == []


def test_matches_sql(spark, docs, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op12_collocations"])
    df = queries.op12_collocations(spark, small)
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def online(words, depth):
    """End positions of every phrase of up to ``depth`` words, as an online construction's states have them."""
    ends = defaultdict(set)
    for k in range(len(words)):
        for size in range(1, depth + 1):
            phrase = tuple(words[k - size + 1 : k + 1]) if k - size + 1 >= 0 else ()
            if phrase and 0 not in phrase:
                ends[phrase].add(k)
    return ends


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.integers(1, 5))
def test_states_are_classes_of_end_positions(words, depth):
    a = collocations.Automaton(np.array(words, np.int32), depth)
    ends, state_of = online(words, depth), {}
    for size in range(1, depth + 1):
        place, count = a.phrases(size)
        for j, (p, n) in enumerate(zip(place.tolist(), count.tolist(), strict=True)):
            phrase = tuple(words[p - size + 1 : p + 1])
            assert n == len(ends[phrase])
            state_of[phrase] = int(a.states[size - 1][j])
    assert set(state_of) == set(ends)
    classes = defaultdict(set)
    for phrase, s in state_of.items():
        classes[s].add(phrase)
    assert len(classes) == len({frozenset(e) for e in ends.values()}) or depth < len(words)
    for s, members in classes.items():
        assert len({frozenset(ends[p]) for p in members}) == 1
        longest, shortest = max(members, key=len), min(members, key=len)
        assert (a.longest[s], a.shortest[s], a.count[s]) == (len(longest), len(shortest), len(ends[longest]))
        assert {longest[k:] for k in range(len(longest) - len(shortest) + 1)} == members
        assert a.link[s] == (state_of[shortest[1:]] if len(shortest) > 1 else -1)


def test_frequent_phrases_share_files(spark):
    """What few phrases are left of many buckets isn't a file for each."""
    docs = spark.createDataFrame([(i, "en", f"one two three w{i % 7} v{i}") for i in range(300)], "doc_id long, lang string, text string")
    counts, words = collocations.phrase_counts(docs, 3, 10, bucket_bytes=200)
    assert len(counts.inputFiles()) <= 2
    got = {r.phrase: r.f for r in counts.collect()}
    assert got["one two three"] == 300 and got["three w0"] == 43 and "v1" not in got and words.first().n == 1500
