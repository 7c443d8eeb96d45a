"""One-permutation MinHash against plain Python, and against the resemblance itself."""

import hashlib
import re
import statistics

import pytest
import xxhash
from pyspark.sql import functions as F

from paperloom.llm import oneperm


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(*values, width=8):
    """The hash of several numbers in turn, as a signed long."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.to_bytes(width, "little", signed=True), h)
    return signed(h)


def shingle_set(text, words=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    return [tuple(w[k : k + words]) for k in range(len(w) - words + 1)] or ([tuple(w)] if w else [])


def brute(text, bins=256, bits=4, attempts=8):
    hashes = [xx(*(xx(w.encode()) for w in s)) for s in shingle_set(text)]
    if not hashes:
        return ""
    width = 65 - bins.bit_length()
    least = {}
    for h in hashes:
        k = (h >> width) + bins // 2
        rest = h & ((1 << width) - 1)
        if rest != (1 << width) - 1:
            least[k] = min(least.get(k, rest), rest)
    number = 0
    for k in range(bins):
        at = k
        if k not in least:
            asked = [xxhash.xxh64_intdigest(t.to_bytes(4, "little"), xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 42)) & (bins - 1) for t in range(attempts)]
            # The bin's own number, as the highest bits of its hashes.
            place = lambda b: signed(xxhash.xxh64_intdigest((b - bins // 2).to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 42)))  # noqa: E731, B023
            at = next((b for b in asked if b in least), None)
            at = min(least, key=place) if at is None else at
        number = number << bits | least[at] & ((1 << bits) - 1)
    return f"{number:0{bins * bits // 4}x}"


def prints(df):
    return {(r.doc_id, r.text): r.hex for r in oneperm.fingerprints(df).select("doc_id", "text", oneperm.as_hex(F.col("packed")).alias("hex")).collect()}


def test_fingerprints_equal_plain_python(docs, edge):
    for table in (docs, edge):
        got = prints(table)
        assert len({t for _, t in got}) == len({(r.text or "") for r in table.select("text").collect()})
        for (_, text), value in got.items():
            assert value == brute(text), text[:50]


def test_empty_fingerprint(spark):
    got = prints(spark.createDataFrame([(1, None), (2, ""), (3, " \n\t"), (4, "a")], "doc_id long, text string"))
    assert sorted(got.values())[:3] == ["", "", ""] and len(got[4, "a"]) == 256


def near_rows(df):
    return oneperm.edited_pairs(df).collect()


def expected(rows):
    """(doc_id, n_chars, edited_sha256, text, edited, next) in the order of the operator."""
    rows = [(i, t or "") for i, t in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, xx(r[1].encode())), reverse=True)
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        yield i, len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, following


@pytest.mark.parametrize("partitions", ["1", "4", "40"])
def test_edited_texts_and_digests(spark, docs, edge, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for table in (docs, edge):
            got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in near_rows(table)), key=repr)
            rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
            want = sorted(((i, n, sha, brute(t), brute(e)) for i, n, sha, t, e, _ in expected(rows)), key=repr)
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def resemblance(a, b):
    a, b = set(shingle_set(a)), set(shingle_set(b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness_has_no_bias(docs, rows):
    got = {r.doc_id: r for r in near_rows(docs)}
    errors = [got[i].near_edited - resemblance(t, e) for i, _, _, t, e, _ in expected(rows)]
    assert abs(statistics.mean(errors)) < 0.01 and statistics.pstdev(errors) < 0.045 and max(map(abs, errors)) < 0.2
    errors = [got[i].near_next - resemblance(t, f) for i, _, _, t, _, f in expected(rows)]
    assert max(map(abs, errors)) < 0.2
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())


@pytest.mark.parametrize(("bins", "bits"), [(64, 1), (128, 8), (512, 2)])
def test_other_widths(spark, rows, bins, bits):
    base = max((t for _, t in rows if t), key=len)
    words = base.split()[:3000]
    texts = [" ".join(words), " ".join(words[: 3000 * 9 // 10]), " ".join(words[1500:]), "", "x"]
    made = oneperm.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bins=bins, bits=bits)
    a, b = made.select(F.col("packed").alias("a"), F.col("text").alias("s")), made.select(F.col("packed").alias("b"), F.col("text").alias("t"))
    for r in a.join(b, F.lit(True)).select("s", "t", oneperm.likeness(F.col("a"), F.col("b"), bins, bits).alias("near")).collect():
        if r.s == r.t:
            assert r.near == 1.0
        elif not r.s or not r.t:
            assert r.near == 0.0
        else:
            assert abs(r.near - resemblance(r.s, r.t)) < 5 / (bins**0.5 * (1 - 2.0**-bits) ** 0.5) * 0.75


def test_empty_single_and_repeated(spark, empty):
    assert near_rows(empty) == []
    (r,) = near_rows(spark.createDataFrame([(7, "a b c d e f g h")], "doc_id long, text string"))
    assert (r.n_chars, r.near_next, r.edited_sha256) == (15, 1.0, hashlib.sha256(b"a b c d a b c d").hexdigest())
    twice = near_rows(spark.createDataFrame([(7, "a b c"), (7, "a b c"), (None, None)], "doc_id long, text string"))
    assert len(twice) == 3 and len({r.fingerprint for r in twice}) == 2


def test_no_python_on_executors(docs):
    plan = oneperm.edited_pairs(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert plan.count("Exchange hashpartitioning") == 1
