"""Exact, near and substring deduplication against plain Python."""

import hashlib
from collections import Counter, defaultdict
from itertools import takewhile

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import exact_dedup, simhash, substring, words


def norm(t):
    return (t or "").encode().lower()


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t)).hexdigest()))
    return Counter(out)


def as_counter(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("primes", [exact_dedup.PRIMES, (2, 3, 5, 7)])
def test_exact_equals_brute_force(edge, primes):
    """With tiny primes nearly all fingerprints of one length collide: comparison must part them."""
    assert as_counter(exact_dedup.exact_dedup(edge, primes=primes), *EXACT) == exact_brute([(r.doc_id, r.text) for r in edge.collect()])


def test_exact_collisions_are_parted(spark):
    rows = [(k, f"{k % 30:04d}") for k in range(200)]
    got = as_counter(exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), primes=(2, 3, 2, 3), filter_bits=1 << 10), *EXACT)
    assert got == exact_brute(rows)


def test_exact_on_documents(docs, rows):
    assert as_counter(exact_dedup.exact_dedup(docs), *EXACT) == exact_brute(rows)


def test_exact_empty(empty):
    assert exact_dedup.exact_dedup(empty).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000), st.binary(max_size=9000))
def test_fingerprints_compose(a, b):
    whole = exact_dedup.fingerprint(a + b)
    assert whole == exact_dedup.combine(exact_dedup.fingerprint(a), exact_dedup.fingerprint(b), len(b))
    value = 0
    for byte in a[:50]:
        value = (value * exact_dedup.BASE + byte) % exact_dedup.PRIMES[0]
    assert exact_dedup.fingerprint(a[:50])[0] == value


def test_without_copies(edge):
    left = exact_dedup.without_copies(edge)
    assert left.columns == edge.columns
    got = [(r.doc_id, r.text) for r in left.collect()]
    assert len({norm(t) for _, t in got}) == len(got) == len({norm(r.text) for r in edge.collect()})


# ---- near copies ---------------------------------------------------------------------------


def sim_brute(text):
    w = norm(text).split()
    shingles = [b" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) > 4 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_brute(rows):
    prints = [sim_brute(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                parent[find(a)] = find(b)
    best = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        best[find(k)].append(i)
    name = {r: min((x for x in ids if x is not None), default=None) for r, ids in best.items()}
    return Counter((i, f"{prints[k]:016x}", name[find(k)]) for k, (i, _) in enumerate(rows))


NEAR = ("doc_id", "fingerprint", "component_id")


def test_near_equals_brute_force(edge):
    rows = [(r.doc_id, (r.text or "")[:4000]) for r in edge.collect()]
    assert as_counter(simhash.near_dedup(edge.sparkSession.createDataFrame(rows, "doc_id long, text string")), *NEAR) == near_brute(rows)


def test_near_on_documents(docs, rows):
    assert as_counter(simhash.near_dedup(docs), *NEAR) == near_brute(rows)


def test_near_empty(empty):
    assert simhash.near_dedup(empty).collect() == []


def test_without_near_copies(docs, edge):
    for table in (docs, edge):
        left = simhash.without_near_copies(table)
        named = simhash.near_dedup(table)
        assert left.columns == table.columns
        components = {r.component_id for r in named.collect()}
        assert components <= {r.doc_id for r in left.collect()} | {None}


@pytest.mark.parametrize("block", [40, 100_000])
def test_near_across_blocks(docs, rows, block):
    """Small blocks: most links cross them."""
    assert as_counter(simhash.near_dedup(docs, block=block), *NEAR) == near_brute(rows)


def test_near_puts_small_parts_together(spark, docs, rows):
    """The session may deal out more parts than asked for."""
    prints = simhash.fingerprints(docs).select("fp").distinct()
    values = np.array([r.fp for r in prints.collect()], np.int64).view(np.uint64)
    assert simhash._blocks([(k, 10, -1, -1) for k in range(7)], 20) == [([0, 1, 2], -1, -1), ([3, 4, 5], -1, -1), ([6], -1, -1)]
    for block in (60, 400):
        pairs = [(r.u, r.v) for r in simhash.links(prints, block=block).collect()]
        assert all((u ^ v).bit_count() <= 64 for u, v in pairs)
        assert joined(values, pairs) == joined(values, [(int(np.int64(a)), int(np.int64(b))) for a, b in all_links(values)])


def all_links(values):
    near = np.triu(np.bitwise_count(values[:, None] ^ values) <= 4, 1)
    signed = values.view(np.int64)
    return [(signed[a], signed[b]) for a, b in zip(*np.nonzero(near), strict=True)]


def joined(values, pairs):
    """The sets that pairs join, as a set of frozen sets."""
    parent = {int(v): int(v) for v in values.view(np.int64)}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in pairs:
        parent[find(int(a))] = find(int(b))
    out = defaultdict(set)
    for k in parent:
        out[find(k)].add(k)
    return {frozenset(x) for x in out.values()}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 400), st.integers(2, 9))
def test_gray_index_finds_all(seed, n, fanout):
    """Every pair within the distance is found, inside an index and between two, and the forest joins what they join."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, max(1, n // 20), dtype=np.uint64)
    flips = np.zeros(n, np.uint64)
    for _ in range(3):
        flips ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    values = np.unique(base[rng.integers(0, len(base), n)] ^ flips)
    index = simhash.GrayIndex(values, fanout=fanout)
    got = [(index.values[a], index.values[b]) for i, j in index.near(index, 4) for a, b in zip(i, j, strict=True)]
    want = {frozenset((int(a), int(b))) for a, b in zip(*(values[x] for x in np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values) <= 4, 1))), strict=True)}
    assert len(got) == len(want) and {frozenset(map(int, p)) for p in got} == want
    cut = int(rng.integers(0, len(values) + 1))
    left, right = simhash.GrayIndex(values[:cut], fanout=fanout), simhash.GrayIndex(values[cut:], np.arange(cut, len(values)), fanout)
    if cut and cut < len(values):
        across = {frozenset((int(left.values[a]), int(right.values[b]))) for i, j in left.near(right, 4) for a, b in zip(i, j, strict=True)}
        assert across == {p for p in want if len(p & set(map(int, values[:cut]))) == 1}
    signed = lambda u, v: list(zip(u.view(np.int64), v.view(np.int64), strict=True))
    links = signed(*simhash.forest(index, index))
    assert joined(values, links) == joined(values, all_links(values))
    assert len(values) - len(joined(values, links)) == len(links)  # a forest: no link too many


def test_gray_index_prunes_groups():
    """Of random fingerprints the index looks at few pairs, and in a dense group it stops comparing."""
    rng = np.random.default_rng(4)
    values = np.unique(rng.integers(0, 2**64, 20_000, dtype=np.uint64))
    index = simhash.GrayIndex(values)
    assert sum(len(i) for i, _ in index.near(index, 4)) == 0
    assert index.visited < 0.5 * len(values) ** 2 / 2
    bits = np.uint64(1) << rng.integers(0, 64, (6000, 2)).astype(np.uint64)
    dense = simhash.GrayIndex(np.unique(values[0] ^ bits[:, 0] ^ bits[:, 1]))
    u, _ = simhash.forest(dense, dense)
    assert len(u) == len(dense.values) - 1 and dense.visited < len(dense.values) ** 2 / 2


def test_rank_column_equals_numpy(spark):
    values = np.random.default_rng(0).integers(-(2**63), 2**63, 300)
    df = spark.createDataFrame([(int(v),) for v in values], "fp long")
    from pyspark.sql import functions as F

    got = [r.fp for r in df.orderBy(simhash.rank_column(F.col("fp"))).collect()]
    assert got == values[np.argsort(simhash.gray_rank(values.view(np.uint64)))].tolist()


def test_gray_neighbours_differ_by_one_bit():
    order = np.argsort(simhash.gray_rank(np.arange(64, dtype=np.uint64)))
    assert all(int(a ^ b).bit_count() == 1 for a, b in zip(order, order[1:], strict=False))


def test_long_chain_is_one_component(spark):
    from paperloom.llm.graph import components

    edges = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(200, 200), (None, 3), (300, 301)], "u long, v long")
    got = dict(components(edges).collect())
    assert {got[k] for k in range(1, 101)} == {0} and got[301] == 300 and 200 not in got


# ---- repeated passages ---------------------------------------------------------------------


def substring_brute(rows, window=13):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return Counter(out)


SUB = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_substring_equals_brute_force(edge):
    assert as_counter(substring.substring_dedup(edge), *SUB) == substring_brute([(r.doc_id, r.text) for r in edge.collect()])


def check_factors(rows, got):
    """Each factor's words stand at its place in its source, and the next word doesn't follow both if a factor could go on."""
    own_words = defaultdict(list)
    for i, t in rows:
        own_words[i].append((t or "").encode().split())
    seen = 0
    for r in got:
        for s in r.spans:
            own = [w[s.start : s.start + s.length] for w in own_words[r.doc_id]]
            place = [w[s.source_start : s.source_start + s.length] for w in own_words[s.source]]
            assert s.source < r.doc_id and s.length >= 13
            assert any(len(a) == s.length and a in place for a in own), (r.doc_id, s)
            seen += 1
    return seen


def test_factors_stand_in_their_sources(docs, rows, edge):
    assert check_factors(rows, substring.substring_dedup(docs).collect()) > 50
    assert check_factors([(r.doc_id, r.text) for r in edge.collect()], substring.substring_dedup(edge).collect()) > 3


def test_factor_ends_where_its_source_does(spark):
    """w1..w14 stands nowhere in document 1 as a whole: a factor of 13 words, and a window across its end."""
    w = [f"w{k}" for k in range(1, 15)]
    rows = [(1, " ".join([*w[:13], "zz", *w[1:]])), (2, " ".join(w)), (3, " ".join([*w[:13], "zz", *w[1:], "end"]))]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [(0, 13, 1, 0)], 3: [(0, 27, 1, 0)]}


def test_substring_on_documents(docs, rows):
    assert as_counter(substring.substring_dedup(docs), *SUB) == substring_brute(rows)


def test_substring_empty(empty):
    assert substring.substring_dedup(empty).collect() == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=13, max_size=80), st.integers(0, 1))
def test_anchors_depend_on_the_phrase_alone(symbols, shift):
    words = [b"w%d" % s for s in symbols]
    one = substring.Group([b" ".join(words)], 13)
    two = substring.Group([b"\n ".join([b"x"] * shift + words), b" ".join(words[:13]) + b"\t"], 13)
    assert one.anchors().tolist() == two.anchors()[two.owner == 0][shift:].tolist()
    assert one.phrases()[0].tolist() == two.phrases()[0][two.owner == 0][shift:].tolist()
    assert two.anchors()[two.owner == 1].tolist() == one.anchors()[:1].tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=30), max_size=30), st.integers(0, 2**32))
def test_word_hashes_depend_on_the_word_alone(parts, seed):
    rng = np.random.default_rng(seed)
    parts += [b"long" * 100, b"x" * (words.SPAN + 5), b"a" * 255, b"a" * 256, b"a" * 257, b"\0", b"\0\0"] * int(rng.integers(1, 3))
    data = b"".join(parts[k] + bytes(rng.choice([9, 10, 11, 12, 13, 32], rng.integers(1, 3)).astype(np.uint8)) for k in rng.permutation(len(parts)))
    starts, ends, hashes = words.word_hashes(data)
    plain = data.split()
    assert [data[a:b] for a, b in zip(starts, ends, strict=True)] == plain
    by = {w: words.word_hashes(b"  " + w)[2][0] for w in plain}
    assert hashes.tolist() == [by[w] for w in plain] and len(set(by.values())) == len(by)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 3000), st.booleans())
def test_lookup_equals_a_dictionary(seed, n, close):
    rng = np.random.default_rng(seed)
    keys = np.unique(rng.integers(0, 2**64 if not close else 2 * n + 1, n, dtype=np.uint64))
    if close:
        keys = np.concatenate([keys, ~np.uint64(0) - keys])  # all in the first and the last slots
    rng.shuffle(keys)
    at = {int(k): i for i, k in enumerate(keys)}
    asked = np.concatenate([keys, keys + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)])
    assert words.Lookup(keys)(asked).tolist() == [at.get(int(k), -1) for k in asked]


def test_factors_never_overlap():
    assert substring.factors([(0, 1, 5), (1, 1, 6), (2, 7, 7), (9, 7, 8), (14, 7, 30), (15, 7, 31), (40, 1, 5)]) == [(0, 14, 1, 5), (14, 14, 7, 30), (40, 13, 1, 5)]
    assert substring.factors([(k, 1, 0) for k in range(68)]) == [(13 * k, 13, 1, 0) for k in range(6)]


def naive_factors(rows, window=13):
    """Longest matches, word by word, in segments of first places of the phrases that two texts share."""
    texts, copies, seen = {}, {}, {}
    for i, t in sorted(rows):
        if t in seen:
            copies[i] = seen[t]
        else:
            seen[t] = i
            texts[i] = (t or "").encode().split()
    first, owners = {}, defaultdict(set)
    for i, w in texts.items():
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), (i, k))
            owners[tuple(w[k : k + window])].add(i)
    places = {place: phrase for phrase, place in first.items() if len(owners[phrase]) > 1}
    starts = defaultdict(list)  # the first 13 words at each place of a segment, with what follows in it
    for (i, k), phrase in places.items():
        end = k
        while (i, end + 1) in places:
            end += 1
        starts[phrase].append((i, k, texts[i][k : end + window]))
    out = {}
    for i, w in texts.items():
        at, out[i] = 0, []
        while at + window <= len(w):
            found = [(sum(1 for _ in takewhile(lambda x: x[0] == x[1], zip(w[at:], words))), s, k) for s, k, words in starts.get(tuple(w[at : at + window]), ()) if s < i]
            if found:
                length, s, k = max(found)
                out[i].append((at, length, s, k))
                at += length
            else:
                at += 1
    return out | {i: [(0, len(texts[s]), s, 0)] if len(texts[s]) >= window else [] for i, s in copies.items()}


def test_factors_are_the_longest_in_the_reference(docs, rows):
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in substring.substring_dedup(docs).collect()}
    assert got == naive_factors(rows) and sum(map(len, got.values())) > 50


def test_cut_out_keeps_other_text():
    assert substring.cut_out(" a  b\nc d ", [(1, 2)]) == " a  d "
    assert substring.cut_out("a b", [(0, 2)]) == ""


def test_without_duplicates_keeps_rows_and_columns(docs):
    left = substring.without_duplicates(docs)
    assert left.columns == docs.columns and left.count() == docs.count()
    want = {(r.doc_id, r.kept_sha256) for r in substring.substring_dedup(docs).collect()}
    assert {(r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in left.collect()} == want
