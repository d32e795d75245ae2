"""The operators that compare documents, against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rastercube.llm import anchors, bwt, mixing, rlz, similar, simhash

from .conftest import TRICKY, prose


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus():
    """Copies, near copies, shared passages, repeats inside a document, and the tricky rows."""
    r = random.Random(11)
    base = [prose(r.randint(25, 160), 100 + i) for i in range(12)]
    passage = prose(70, 99)
    out = list(TRICKY)
    for i in range(40):
        words = base[i % 12].split()
        k = i // 12
        if k == 1:
            words[r.randrange(len(words))] = "edited"
        elif k == 2:
            words = [*words[: len(words) // 2], *passage.split(), *words[len(words) // 2 :]]
        elif k == 3:
            words = [*passage.split()[r.randint(0, 9) :], "x", *words, *words[:30]]
        out.append((100 + i, " ".join(words), f"s{i % 3}"))
    return out


# --- SimHash


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=2):
    label = {f: f for f in fps}
    find = lambda f: f if label[f] == f else find(label[f])
    fs = sorted(fps)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= distance:
                label[find(a)] = find(b)
    return {f: find(f) for f in fs}


def test_near_duplicates(make):
    docs = make(corpus())
    text = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    root = brute_components({f for _, f in text})
    least = defaultdict(list)
    for d, f in text:
        if d is not None:
            least[root[f]].append(d)
    want = sorted(((d, f - (1 << 64) if f >> 63 else f, min(least[root[f]], default=None)) for d, f in text), key=repr)
    assert rows(simhash.near_duplicates(docs)) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [2, 32])
def test_links_in_crowds(spark, bucket):
    r = random.Random(bucket)
    fps = set()
    for _ in range(8):
        x = r.getrandbits(64)
        for _ in range(40):
            fps.add(x ^ sum({1 << r.randrange(64) for _ in range(r.randint(0, 3))}))
    fps |= {r.getrandbits(64) for _ in range(50)} | {0, 1, 3, 7, (1 << 64) - 1, 1 << 63}
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, bucket=bucket)).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for f, root in brute_components(fps).items():
        want[root].add(simhash._signed(f))
        got[roots.get(simhash._signed(f), simhash._signed(f))].add(simhash._signed(f))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(root == min(m) for root, m in got.items())


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 201: 200}


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_the_distance(seed):
    r = np.random.default_rng(seed)
    bits = (r.random((300, 64)) < r.random(64)).astype(float)
    groups, ts = simhash.plan(300 * 10 ** (3 * seed), (bits.T @ bits).astype(np.int64) * 10 ** (3 * seed))
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert sum(ts) == 2 - len(groups) + 1 and min(ts) >= -1


def test_allocation_is_optimal():
    from itertools import product

    r = random.Random(3)
    cost = [[r.random() for _ in range(4)] for _ in range(3)]
    ts, c = simhash.allocate(cost, 0)
    assert abs(c - min(sum(row[t + 1] for row, t in zip(cost, x, strict=True)) for x in product(range(-1, 3), repeat=3) if sum(x) == 0)) < 1e-12 and sum(ts) == 0


def test_one_of_each(make):
    docs = make(corpus())
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    root = brute_components({brute_fingerprint(r.text) for r in docs.collect()})
    got = [root[brute_fingerprint(r.text)] for r in kept.collect()]
    assert sorted(got) == sorted(set(root.values()))
    clean = make([(i, prose(80, 500 + i), "a") for i in range(30)] + [(40, prose(80, 500), "b")])
    assert sorted(r.doc_id for r in simhash.one_of_each(clean).collect()) == list(range(30))


# --- near copies of the pipeline


def brute_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_similarity(a, b):
    return len(a & b) / len(a | b)


def test_one_of_similar(make, spark):
    """One changed word in 100, a chain of such changes, a crowd of near copies, and pairs that are not near enough."""
    from corpus_pipeline import near_dedup

    r, docs = random.Random(3), list(TRICKY)
    for i in range(8):
        words = prose(100, 700 + i).split()
        docs.append((200 + 10 * i, " ".join(words), "a"))
        for j in range(1, 6):
            words[r.randrange(100)] = f"edit{i}{j}"
            docs.append((200 + 10 * i + j, " ".join(words), "a"))
    crowd = prose(120, 900).split()
    docs += [(400 + i, " ".join([*crowd[: 3 * i], f"w{i}", *crowd[3 * i + 1 :]]), "b") for i in range(40)]
    half = prose(60, 950)
    docs += [(500 + i, half + " " + prose(60, 960 + i), "c") for i in range(20)]
    docs = make(docs)
    kept = near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    old, new = [brute_shingles(x.text) for x in docs.collect()], [brute_shingles(x.text) for x in kept.collect()]
    assert not [1 for i, a in enumerate(new) for b in new[:i] if brute_similarity(a, b) >= 0.8]
    group = list(range(len(old)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i, a in enumerate(old):
        for j in range(i):
            if brute_similarity(a, old[j]) >= 0.8:
                group[find(i)] = find(j)
    assert {find(old.index(x)) for x in new} == {find(i) for i in range(len(old))}  # no group is lost
    assert {x.doc_id for x in kept.collect()} >= {500 + i for i in range(20)}
    assert near_dedup(spark, docs.limit(0), "").count() == 0


def test_similar_by_fingerprints():
    """A bit is 1 if most hashes have it; pairs of similarity 0.8 share a table, others hardly ever do, at any size."""
    r = np.random.default_rng(5)
    sets = [r.integers(1 << 63, size=n, dtype=np.uint64) for n in (1, 2, 255, 256, 700)]
    for sh in sets:
        h = anchors.mixed(sh[:, None] + similar._SALT).view(np.uint8)
        assert (np.unpackbits(similar.fingerprint(sh)) == (2 * np.unpackbits(h, axis=1).astype(int).sum(axis=0) > len(sh))).all()
    both, own = r.integers(1 << 63, size=(300, 80), dtype=np.uint64), r.integers(1 << 63, size=(2, 300, 10), dtype=np.uint64)
    a, b = (np.array([np.unpackbits(similar.fingerprint(np.append(x, y))) for x, y in zip(both, o, strict=True)]) for o in own)
    for n in (10_000, 200_000):
        tables = similar.plan(n)
        near, far = (sum(any((x[p] == y[p]).all() for p in tables) for x, y in zip(a, z, strict=True)) for z in (b, np.roll(b, 1, axis=0)))
        assert near >= 297 and far <= 300 * 2 * len(tables) / 2 ** len(tables[0]) + 3
    bits = slice(similar.BITS, None)
    assert ((a[:, bits] != b[:, bits]).sum(axis=1) <= similar.APART).all()


@pytest.mark.parametrize("sure", [similar.SURE, 0])
def test_pairs_of_a_crowd(monkeypatch, sure):
    """A crowd gives fewer pairs to verify than it has members; these join all that pairs within reach join, but for what
    only nodes that joined for sure would reach."""
    monkeypatch.setattr(similar, "SURE", sure)
    r = np.random.default_rng(8)
    base, fps, far = r.integers(0, 2, similar.BITS), [], np.where(np.arange(90) % 7, similar.FAR, similar.FAR_SHORT)
    for i in range(90):  # two crowds of near and not so near copies, and strangers
        bits = base if i < 60 else 1 - base if i < 80 else r.integers(0, 2, similar.BITS)
        fps.append(np.packbits(bits ^ (r.random(similar.BITS) < (0.02, 0.1, 0.13, 0.2)[i % 4])).view(np.uint64))
    fps = np.array(fps)
    apart = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2, dtype=int)
    near = {(i, j) for j in range(90) for i in range(j) if apart[i, j] <= max(far[i], far[j])}
    assert set(similar.within(fps, far)) == near and len(near) > 900

    def groups(pairs):
        of = list(range(90))
        for i, j in pairs:
            of = [of[i] if x == of[j] else x for x in of]
        return [of.index(x) for x in of]

    grown = similar.forest(fps, far)
    assert len(grown) < 90 and {(min(x), max(x)) for x in grown} <= near
    assert groups(grown + list(near)) == groups(near) and (sure or groups(grown) == groups(near))
    assert similar.forest(fps[:1], far[:1]) == similar.within(fps[:1], far[:1]) == []


def test_crowd_of_unlike_copies(spark, make):
    """Copies of one text that are mostly less than 0.8 alike: the pairs to verify do not grow with the square of the crowd."""
    r, base = random.Random(4), prose(120, 990).split()
    made = [" ".join(f"w{i}x{j}" if r.random() < 0.05 else w for j, w in enumerate(base)) for i in range(200)]
    rows_ = make([(i, t, "a") for i, t in enumerate(made)]).selectExpr("doc_id AS _key", "text")
    nodes = similar.per_batch(rows_, similar._signatures, "_key long, same binary, fp binary, m0 long, m1 long, short boolean").withColumnRenamed("_key", "node")
    tables = similar.plan(200)
    pairs, members = similar._candidates(nodes.withColumn("root", F.col("node")), tables, 0)
    n, sizes = members.count(), [x["count"] for x in members.groupBy("b").count().collect()]
    assert n > 400 and pairs.join(members.select("node").distinct(), pairs.u == F.col("node"), "left_semi").count() < n < sum(k * (k - 1) // 2 for k in sizes)
    sets = [brute_shingles(t) for t in made]
    label = list(range(200))
    for i, a in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and brute_similarity(a, sets[j]) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    roots = {x.node: x.root for x in simhash.components(similar.links(rows_, nodes)).collect()}
    got = [roots.get(i, i) for i in range(200)]
    assert all((got[i] == got[j]) == (label[i] == label[j]) for i in range(200) for j in range(i))


# --- repeated windows


def brute_words(docs, length=20):
    order = sorted(docs, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "") if False else (r[0] is None, r[0] or 0, r[1] is None, (r[1] or "").encode()))
    seen, out = set(), []
    for d, t, *_ in order:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            if k in seen:
                gone |= set(range(i, i + length))
            seen.add(k)
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("crowd", [256, 3, 1])
def test_lempel_ziv(make, crowd):
    docs = corpus()
    assert rows(rlz.remove_repeats(make(docs), crowd=crowd, block=2000)) == brute_words(docs)
    unique = [r for r in docs if r[0] not in (None, 6, 7)]
    got = rows(rlz.remove_repeats(make(unique)))
    assert got == brute_words(unique) and sum(r[2] for r in got) > 500
    assert rlz.remove_repeats(make(docs).limit(0)).count() == 0


def test_lempel_ziv_straddling(make):
    """Windows over the seam of two passages that stand together only in some documents."""
    a, b, c = (prose(30, s).split() for s in (71, 72, 73))
    docs = [(1, a + b), (2, b + c), (3, a[:25] + b + c), (4, a + b + c), (5, a[10:] + b[:15] + c[3:]), (6, ["w"] * 90), (7, ["w"] * 21)]
    docs = [(d, " ".join(w), None) for d, w in docs]
    assert rows(rlz.remove_repeats(make(docs))) == brute_words(docs)


def test_one_line_in_many_documents(make):
    """A line that all documents share in surroundings of their own: one anchor with many different segments, which are
    cut finer; whatever is unique stays."""
    line = prose(26, 80)
    docs = [(i, f"{prose(12, 2000 + i)} {line} {prose(12, 3000 + i)}", None) for i in range(60)]
    docs += [(100 + i, f"{prose(3, 4000 + i % 7)} {line} {prose(3, 5000 + i % 3)}", None) for i in range(30)]
    for crowd in (256, 4):
        assert rows(rlz.remove_repeats(make(docs), crowd=crowd, block=3000)) == brute_words(docs)
        assert rows(bwt.remove_repeats(make(docs), crowd=crowd, block=3000)) == brute_bytes(docs)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=60), min_size=1, max_size=8), st.integers(0, 9))
def test_parse_of_a_block(stretches, copies):
    """Greedy factors and the checks at their ends find all windows that start earlier in the block."""
    stretches = [x + y for x, y in zip(stretches, [*stretches[1:], ["d"] * 25], strict=True)] + stretches[:copies]
    seen, want = set(), []
    for s in stretches:
        mine = []
        for i in range(len(s) - 19):
            k = tuple(s[i : i + 20])
            mine += [i] if k in seen else []
            seen.add(k)
        want.append(mine)
    assert rlz.repeated_windows([" ".join(s).encode() for s in stretches]) == want


def test_digests_tell_segments_apart():
    """Anchors with very many segments need wide digests: 128 bits, nothing taken off for a segment's number."""
    p = rlz.parse(prose(400, 90).encode())
    d = p.digests()
    assert d.shape == (len(p.first), 2) and d.dtype == np.int64
    assert [tuple(x) for x in d.tolist()] == [tuple(int.from_bytes(h[i : i + 8], "big", signed=True) for i in (0, 8)) for h in (xxhash.xxh3_128_digest(p.slice(a, b + 20)) for a, b in zip(p.first, p.last, strict=True))]


def brute_bytes(docs, length=200):
    raw = [(t or "").encode() for _, t, *_ in docs]
    count = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for (d, *_), x in zip(docs, raw, strict=True):
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((d, len(x), int(gone.sum()), spans, hashlib.sha256(bytes(c for c, g in zip(x, gone, strict=False) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("crowd", [256, 1])
def test_bwt(make, crowd):
    docs = corpus() + [(300, "ab" * 300, "a"), (301, "ab" * 150 + "c" * 250, "a"), (302, "c" * 199, "a")]
    got = rows(bwt.remove_repeats(make(docs), crowd=crowd, block=5000))
    assert got == brute_bytes(docs) and sum(r[2] for r in got) > 3000


def test_blocks_in_pieces(make):
    """Whatever is dealt to a block, a piece of it has whole anchors and few bytes; the result is the same."""
    r = np.random.default_rng(2)
    seed, size = r.integers(-40, 40, 500), r.integers(200, 350, 500)
    t = pa.table({"seed": pa.array(seed), "at": pa.array(np.arange(500)), "bytes": pa.array([b"x" * n for n in size.tolist()], pa.binary())})
    pieces = [x.to_pydict() for x in anchors.by_anchor(t, 9000)]
    assert sorted(i for x in pieces for i in x["at"]) == list(range(500)) and all(x["bytes"][0] for x in pieces)
    assert all(len(set(x["seed"])) == 1 or sum(map(len, x["bytes"])) <= 9000 for x in pieces)
    assert sum(len(set(x["seed"])) for x in pieces) == len(set(seed.tolist()))
    docs = corpus()
    assert rows(bwt.remove_repeats(make(docs), block=1 << 30, piece=600)) == brute_bytes(docs)


def test_bwt_empty(make):
    assert bwt.remove_repeats(make(TRICKY).limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=120).map(lambda x: bytes(c % 3 for c in x)), st.integers(1, 12))
def test_common_prefixes(text, least):
    x = np.frombuffer(text, np.uint8).astype(np.int64) + 1
    x = np.append(x, 0)
    order = bwt.suffix_order(x, 1 << 10)
    s = x.tolist()
    assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    lcp = bwt.common_prefixes(x, order, least)
    for i in range(1, len(s)):
        a, b = s[order[i - 1] :], s[order[i] :]
        n = next((k for k, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
        assert lcp[i] == (n if n < least else -1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=200), st.integers(2, 9))
def test_segments_cover_all_windows_once(xs, length):
    k = max(1, length // 3)
    grams = np.array([hash(tuple(xs[i : i + k])) for i in range(max(0, len(xs) - k + 1))], np.int64).view(np.uint64)
    first, last, at = anchors.cut(grams, length, k)
    windows = [i for a, b in zip(first, last, strict=True) for i in range(a, b + 1)]
    assert windows == list(range(max(0, len(xs) - length + 1)))
    anchor = {}
    for a, b, p in zip(first.tolist(), last.tolist(), at.tolist(), strict=True):
        assert b <= p and p + k <= a + length
        for i in range(a, b + 1):
            assert anchor.setdefault(tuple(xs[i : i + length]), p - i) == p - i


# --- mixing


def test_mix(make):
    docs = [(i, prose(5 + i * 7 % 90, i), "abcde"[min(i % 9, 4)]) for i in range(200)] + [(900, prose(2000, 1), "z"), *TRICKY]
    df = make(docs)
    got = mixing.mix(df).collect()
    assert len(got) == len(docs)
    src = {(d, len((t or "").encode().split())): s for d, t, s in docs}
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        s = src[r.doc_id, r.size]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r.size
        assert (r.first_position is None) == (r.n_copies == 0) and (r.first_position is None or 0 <= r.first_position <= r.last_position <= 1)
    total = sum(size.values())
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, open_ = {}, set(names)
    while True:  # the rule as it is told: share by weight, cap, share the excess again
        left, w = total - sum(want.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * size[s]}
        if not over:
            want |= {s: left * weight[s] / w for s in open_}
            break
        want |= {s: 3 * size[s] for s in over}
        open_ -= over
    for s in names:
        assert abs(target[s] - want[s]) < 1e-6 * total and abs(taken[s] - target[s]) <= 1
    assert rows(mixing.mix(df)) == rows(mixing.mix(df.repartition(3)))
    assert mixing.mix(df.limit(0)).count() == 0


def test_schedule_is_kept(make):
    """A source that is taken once at most has its words by time t as its integrated schedule says."""
    df = make([(i, prose(20, i), "abc"[i % 3]) for i in range(900)])
    got = mixing.mix(df, "source").where("n_copies > 0").collect()
    for source, ramp in (("b", 0.0), ("c", -0.5)):
        by = [r.first_position for r in got if r.source == source]
        for t in (0.25, 0.5, 0.75):
            assert abs(sum(p < t for p in by) / len(by) - (t + ramp * (t - t * t))) < 0.03, (source, t)
    first = [r.first_position for r in got if r.source == "a"]
    size = 300 / 562.5  # the first of nearly two passes is over when D(t) says so
    assert abs(max(first) + 0.5 * (max(first) - max(first) ** 2) - size) < 0.03


def test_mixed_documents(make):
    docs = [(i, prose(5 + i * 7 % 90, i), "abcde"[min(i % 9, 4)]) for i in range(100)] + TRICKY
    df = make(docs)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    copies = Counter((r.doc_id, r.text) for r in out.collect())
    known = Counter((d, t) for d, t, _ in docs)
    assert set(copies) <= set(known) and all(copies[k] <= 3 * known[k] for k in copies)
    assert all((t or "").split() for _, t in copies)
    assert mixing.mixed_documents(df.limit(0)).count() == 0
