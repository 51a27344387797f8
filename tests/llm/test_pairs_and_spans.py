"""Near duplicates, shared spans, leaks, close vectors: against brute force, and their edges."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from evidara.llm import common, leaks, neardup, queries, spans, vectors

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text_of(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def triples(text, width=3):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    texts = [text_of(r, r.choice([30, 80, 200])) for _ in range(40)]
    for i in range(12):
        w = texts[i].split()
        for _ in range(len(w) // 25):
            w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[3], texts[3], "one two", "", "  ", "one two"]
    return list(enumerate(texts)) + [(1000, None), (None, "lost its id " * 20)]


SET = neardup.SketchSettings(width=3, threshold=0.6)


def test_near_duplicates_match_brute_force(spark, corpus):
    df = spark.createDataFrame([(i, t, "x", i) for i, t in corpus], "doc_id long, text string, id string, a long")
    got = {(r.id_a, r.id_b): r.similarity for r in neardup.near_duplicate_pairs(df, "doc_id", "text", SET).collect()}
    sets = {i: triples(t) for i, t in corpus if i is not None and t and triples(t)}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sorted(sets), 2)}
    want = {k: v for k, v in want.items() if v >= 0.6}
    assert got == pytest.approx(want) and len(want) > 12


def test_near_duplicate_groups_are_whole(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    rows = {r.id: r for r in neardup.near_duplicate_groups(df, "doc_id", "text", SET).collect()}
    assert set(rows) == {i for i, _ in corpus if i is not None}
    assert rows[1000].group_id == 1000 and rows[1000].links == 0
    copies = [i for i, t in corpus if t == dict(corpus)[3]]
    assert len({rows[i].group_id for i in copies}) == 1 and all(rows[i].links >= 2 for i in copies)


def test_large_copy_groups_are_listed_by_their_head(spark):
    same = [(i, "a b c d e f") for i in range(6)]
    df = spark.createDataFrame(same, "doc_id long, text string")
    few = neardup.SketchSettings(width=3, threshold=0.6, expand_copies=4)
    got = {(r.id_a, r.id_b) for r in neardup.near_duplicate_pairs(df, "doc_id", "text", few).collect()}
    assert got == {(0, i) for i in range(1, 6)}


def test_variants_of_one_set_are_listed_in_full(spark):
    few = neardup.SketchSettings(width=3, threshold=0.6, expand_copies=4)
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    variants = [(i, text + "." * i) for i in range(8)]
    copies = [(i, text.upper()) for i in range(20, 26)]
    near = [(40, text + " lambda")]
    df = spark.createDataFrame(variants + copies + near, "doc_id long, text string")
    got = sorted((r.id_a, r.id_b) for r in neardup.near_duplicate_pairs(df, "doc_id", "text", few).collect())
    shown = [*range(8), 20, 40]
    assert got == sorted([*combinations(shown, 2), *((20, i) for i in range(21, 26))])
    groups = {r.id: r for r in neardup.near_duplicate_groups(df, "doc_id", "text", few).collect()}
    assert {r.group_id for r in groups.values()} == {0} and all(r.links == 14 for r in groups.values())
    assert {i: r.class_id for i, r in groups.items()} == {**{i: i for i in (*range(8), 40)}, **dict.fromkeys(range(20, 26), 20)}


def test_estimate_is_near_the_similarity():
    r = np.random.default_rng(1)
    s = neardup.SketchSettings(width=3, threshold=0.6)
    mult, add = neardup._draws(s.registers)
    both = r.integers(0, 2**63, 300).astype(np.uint64)
    a, b = np.unique(both[:225]), np.unique(both[75:])
    regs = np.asarray(neardup._sketched([1, 2], [a, b], mult, add, s.base).column("registers").flatten()).reshape(2, -1)
    assert abs(neardup.joint_estimate(regs[:1], regs[1:], np.array([225.0]), np.array([225.0]), s.base)[0] - 0.5) < 0.15


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 120)] + [(200, 200)]
    got = {r.node: r.group for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in range(100, 120)} == {100} and got[200] == 200


def brute_spans(rows, least):
    own = {}
    for i, t in rows:
        for k in range(len(t) - least + 1):
            own.setdefault(t[k : k + least], set()).add(i)
    out = set()
    for i, t in rows:
        current = None
        for k in range(len(t) - least + 1):
            if len(own[t[k : k + least]]) > 1:
                if current and k <= current[1]:
                    current[1] = k + least
                else:
                    if current:
                        out.add((i, *current))
                    current = [k, k + least]
        if current:
            out.add((i, *current))
    return out


@pytest.mark.parametrize("hot", [2, 5000])
def test_shared_spans_match_brute_force(spark, hot):
    r = random.Random(8)
    long = "".join(r.choice("abc déß\n😀") for _ in range(260))
    rows = [(i, "".join(r.choice("abcdef ") for _ in range(200)) + long[r.randrange(80) : 180 + r.randrange(80)] + "".join(r.choice("xyz") for _ in range(r.randrange(60)))) for i in range(14)]
    rows += [(50, rows[0][1]), (51, long), (52, "short"), (53, "ab" * 120), (54, "ba" * 100), (55, "")]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in [*rows, (60, None), (61, None)]], "doc_id long, text string, s int, id string")
    got = {(x.id, x.span_start, x.span_end) for x in spans.shared_spans(df, "doc_id", "text", least=60, gram=16, hot=hot).collect()}
    want = brute_spans(rows, 60)
    assert got == want and len(want) > 10


def test_many_contexts_of_one_anchor(spark):
    """More contexts than are compared in pairs, of which two are alike on one side each."""
    r = random.Random(2)
    core = "".join(r.choice("abcdefgh") for _ in range(50))
    rows = [(i, "".join(r.choice("ijkl") for _ in range(60)) + core + "".join(r.choice("mnop") for _ in range(60))) for i in range(20)]
    rows += [(30, rows[0][1][:120] + "q" * 50), (31, "q" * 60 + rows[1][1][60:])]
    got = {(x.id, x.span_start, x.span_end) for x in spans.shared_spans(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", least=56, gram=16).collect()}
    assert got == brute_spans(rows, 56) and got


@pytest.mark.parametrize("block", [20, leaks.BLOCK])
def test_leaks_match_brute_force(spark, block):
    r = random.Random(4)
    items = [(i, text_of(r, 30)) for i in range(8)] + [(8, "too short"), (9, None), (0, "another passage of item 0 " + text_of(r, 12))]
    texts = [(i, text_of(r, 60)) for i in range(10)]
    texts += [(20, "x " + " ".join(items[2][1].split()[5:15]).upper() + "; y"), (21, " ".join(items[3][1].split()[:9])), (22, items[4][1] + " " + items[5][1]), (23, None), (24, "")]
    grams = lambda t: triples(t or "", 10)
    want = {(i, k) for i, t in texts for k, p in items if grams(t) & grams(p)}
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, item long")
    found = leaks.leaks(docs, "doc_id", "text", spark.createDataFrame(items, "item_id long, passage string"), "item_id", "passage", block=block)
    assert {(r.id, r.item) for r in found.collect()} == want and (20, 2) in want


def test_looser_leaks_bear_a_change(spark):
    r = random.Random(6)
    passage = text_of(r, 24)
    w = passage.split()[4:16]
    w[5] = "changed"
    docs = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    item = spark.createDataFrame([(7, passage)], "item_id long, passage string")
    assert leaks.leaks(docs, "doc_id", "text", item, "item_id", "passage").count() == 0
    assert leaks.leaks(docs, "doc_id", "text", item, "item_id", "passage", radius=30, similarity=0.5).count() == 1


def test_near_leaks_match_brute_force(spark):
    r = random.Random(8)
    items = [(i, " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(50))) for i in range(6)]
    texts = []
    for i, p in items:
        w = p.split()[3:42]
        for at in range(7, 39, 11 + 5 * i):
            w[at] = "changed"
        texts.append((i, "lead " * 9 + " ".join(w) + " tail" * 9))
    width, radius, similarity, stride = 20, 6, 0.7, 3
    want = {}
    for i, t in texts:
        w = common.hashed_words(t)
        p, f = common.shingles(w, 2), leaks.fingerprints(common.shingles(w, 2), width - 1)
        for k, passage in items:
            q = common.shingles(common.hashed_words(passage), 2)
            g = leaks.fingerprints(q, width - 1)
            for x in range(len(f)):
                for y in sorted({*range(0, len(g), stride), len(g) - 1}):
                    a, b = set(p[x : x + width - 1].tolist()), set(q[y : y + width - 1].tolist())
                    weight = lambda s: sum((v & 3) + 1 for v in s)
                    if np.bitwise_count(f[x] ^ g[y]) <= radius and weight(a & b) >= similarity * weight(a | b):
                        want.setdefault((i, k), set()).add(x)
    found = leaks.leaks(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, passage string"), "item_id", "passage", width=width, radius=radius, similarity=similarity, stride=stride)
    assert {(x.id, x.item): x.windows for x in found.collect()} == {k: len(v) for k, v in want.items()} and want
    assert {x.item: x.texts for x in leaks.by_item(found).collect()} == {k: sum(j == k for _, j in want) for _, k in want}


def test_near_leaks_look_at_every_window(spark, tmp_path):
    r = random.Random(11)
    items = [(i, " ".join(r.choice(WORDS) + str(r.randrange(90)) for _ in range(70))) for i in range(8)]
    # exactly one window of each item, a little changed, at every place in the stride that there was
    texts = [(i, " ".join(["lead", *p.split()[11 + i : 41 + i], "tail"])) for i, p in items]
    texts = [(i, " ".join("changed" if at == 15 and i % 2 else w for at, w in enumerate(t.split()))) for i, t in texts]
    want = {}
    for i, t in texts:
        p = common.shingles(common.hashed_words(t), 2)
        f = leaks.fingerprints(p, 29)
        for k, passage in items:
            q = common.shingles(common.hashed_words(passage), 2)
            g = leaks.fingerprints(q, 29)
            for x in range(len(f)):
                for y in range(len(g)):
                    a, b = set(p[x : x + 29].tolist()), set(q[y : y + 29].tolist())
                    weight = lambda s: sum((v & 3) + 1 for v in s)
                    if np.bitwise_count(f[x] ^ g[y]) <= 6 and weight(a & b) >= 0.8 * weight(a | b):
                        want.setdefault((i, k), set()).add(x)
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, passage string").write.parquet(f"{tmp_path}/eval_items.parquet")
    assert {(x.doc_id, x.item_id): x.windows for x in queries.p8_near(spark, str(tmp_path)).collect()} == {k: len(v) for k, v in want.items()}
    assert {(i, i) for i in range(0, 8, 2)} <= set(want)


def test_paragraph_clusters_match_brute_force(spark):
    r = random.Random(2)
    long = [" ".join(r.choice(WORDS) for _ in range(60)) for _ in range(6)]
    near = [p.split() for p in long[:3]]
    for w in near:
        w[30] = "changed"
    near = [" ".join(w) for w in near]
    rows = [(1, long[0] + "\n\n" + long[1] + "\n \n\nshort one"), (2, near[0] + "\r\n\r\n" + long[3]), (3, long[1] + "\n\n" + near[1]), (4, long[4]), (5, long[2] + "\n\n" + long[2]), (6, None), (7, ""), (None, long[4])]
    df = spark.createDataFrame([(*x, 3) for x in rows], "doc_id long, text string, place int")
    found = spans.paragraph_clusters(df, "doc_id", "text").collect()
    of = {i: t for i, t in rows if i is not None}
    clusters: dict = {}
    for x in found:
        clusters.setdefault(x.cluster, []).append((x.id, x.start, of[x.id][x.start : x.end]))
    got = sorted(sorted((i, t) for i, _, t in c) for c in clusters.values())
    assert got == sorted(sorted(c) for c in ([(1, long[0]), (2, near[0])], [(1, long[1]), (3, long[1]), (3, near[1])], [(5, long[2]), (5, long[2])]))
    assert all(sum(not x.removed for x in found if x.cluster == c) == 1 for c in clusters)


def test_hamming_blocks_retrieve_all_within_the_radius():
    r = np.random.default_rng(3)
    index = leaks.Index([(1, text_of(random.Random(1), 200))], 10, 3, 1.0)
    f = index.kinds[r.integers(0, len(index.kinds), 200)].copy()
    for k in range(len(f)):
        for bit in r.choice(64, r.integers(0, 4), replace=False):
            f[k] ^= np.uint64(1 << int(bit))
    x, _ = index.look_up(f)
    assert set(x.tolist()) == set(range(200))


def unit_rows(n, d, seed):
    v = np.random.default_rng(seed).standard_normal((n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def brute_close(rows, least, k):
    ids = sorted(rows)
    v = np.array([rows[i] for i in ids], dtype=np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    c = v @ v.T
    np.fill_diagonal(c, -2)
    top = [set(np.lexsort((np.arange(len(ids)), -c[i].round(9)))[:k].tolist()) for i in range(len(ids))]
    return {(ids[i], ids[j]) for i, j in combinations(range(len(ids)), 2) if c[i, j] >= least and j in top[i] and i in top[j]}


def test_close_pairs_match_brute_force(spark):
    base = unit_rows(150, 32, 1)
    r = np.random.default_rng(2)
    rows = {f"a{i:03}": v.tolist() for i, v in enumerate(base)}
    rows |= {f"b{i:03}": (v + 0.03 * r.standard_normal(32)).tolist() for i, v in enumerate(base[:60])}
    rows |= {f"c{i:03}": base[7].tolist() for i in range(25)}  # copies: more than can be neighbours
    data = [(i, v, 1) for i, v in rows.items()] + [("a000", rows["a000"], 2), ("n", None, 1), ("z", [0.0] * 32, 1), ("s", [1.0], 1), (None, rows["a000"], 1), ("nan", [float("nan")] * 32, 1)]
    df = spark.createDataFrame(data, "id string, vector array<float>, h long")
    got = {(x.id_a, x.id_b) for x in vectors.close_pairs(df, "id", "vector", 0.95, 5).collect()}
    assert got == brute_close(rows, 0.95, 5) and len(got) > 60


@pytest.mark.parametrize("strength, many", [(1.1, 10**6), (2.0, 10**6), (2.0, 0)])
def test_close_pairs_with_a_strong_common_mean(spark, monkeypatch, strength, many):
    monkeypatch.setattr(vectors, "MANY", many, raising=False)
    r = np.random.default_rng(6)
    base = r.standard_normal((300, 64)) / 8 + strength * np.eye(64)[0]
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = r.standard_normal(base.shape)
    near -= (near * base).sum(1, keepdims=True) * base
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    near = 0.951 * base + (1 - 0.951**2) ** 0.5 * near
    rows = {f"a{i:03}": v.tolist() for i, v in enumerate(base)} | {f"b{i:03}": v.tolist() for i, v in enumerate(near)} | {f"c{i:03}": base[7].tolist() for i in range(9)}
    df = spark.createDataFrame(list(rows.items()), "id string, vector array<float>")
    got = {(x.id_a, x.id_b) for x in vectors.close_pairs(df, "id", "vector", 0.95, 5, vectors.HashSettings(load=1)).collect()}
    assert got == brute_close(rows, 0.95, 5) and len(got) > 250


def test_planned_substrings_meet_pairs_about_a_strong_mean():
    r = np.random.default_rng(9)
    x = r.standard_normal((4000, 64)) / 8 + 1.1 * np.eye(64)[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    settings = vectors.HashSettings()
    bits, parts, radius = vectors.plan(91_000, 0.95, x[:2000], settings)
    mean, directions = vectors.learn(x[:2000], -(-bits * parts // 64) + 2, settings)
    w = r.standard_normal((2000, 64))
    w -= (w * x[2000:]).sum(1, keepdims=True) * x[2000:]
    y = 0.95 * x[2000:] + (1 - 0.95**2) ** 0.5 * w / np.linalg.norm(w, axis=1, keepdims=True)
    one, two = (vectors.codes(v, mean, directions) for v in (x[2000:], y))
    same = np.unpackbits((one ^ two)[:, 2:].copy().view(np.uint8), axis=1, bitorder="little")[:, : bits * parts].reshape(-1, parts, bits).sum(2) == 0
    lost = ~same.any(1) | (np.bitwise_count((one ^ two)[:, :2]).sum(1) > radius)
    assert lost.sum() <= 5  # of 2,000; 0.05 % are promised


def test_search_recall_and_rank(spark):
    r = np.random.default_rng(3)
    topics = unit_rows(60, 64, 4)
    rows = {f"v{i:04}": (topics[i % 60] + 0.12 * r.standard_normal(64)).tolist() for i in range(3000)}
    df = spark.createDataFrame(list(rows.items()), "id string, vector array<float>")
    asked = df.where("id like '%00'")
    found = vectors.search(df, "id", "vector", asked, k=10).collect()
    ids = sorted(rows)
    v = np.array([rows[i] for i in ids])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in {x.query_id for x in found}:
        c = v @ v[ids.index(q)]
        c[ids.index(q)] = -2
        hits += len({ids[j] for j in np.argsort(-c)[:10]} & {x.id for x in found if x.query_id == q})
    assert hits >= 0.9 * 10 * 30 and all(x.query_id != x.id for x in found)


def test_probing_retrieves_all_codes_within_the_radius(spark):
    r = np.random.default_rng(5)
    own = r.integers(0, 1 << 63, (4000, vectors.WORDS), dtype=np.uint64)
    asked = own[:7].copy()
    asked[:, 0] ^= np.uint64(0x0001_0000_8000_0101)
    rows = [(j, int(c[0] >> np.uint64(16 * j) & np.uint64(0xFFFF)), i, *(int(w) for w in c)) for i, c in enumerate(own) for j in range(vectors.PARTS)]
    entries = spark.createDataFrame(rows, "part int, key int, h long, " + ", ".join(f"code{w} long" for w in range(vectors.WORDS))).repartition(3, "part", "key").sortWithinPartitions("part", "key")
    near = np.bitwise_count(asked[:, None, 0] ^ own[None, :, 0])
    for most, radius in ((4000, 20), (30, 20), (40, 4)):
        got: dict = {}
        for x in vectors._nearest_codes(entries, asked, radius, most, min(most, 10)).collect():
            got.setdefault(x.query, []).append(x.h)
        for q in range(len(asked)):
            within = radius
            while (near[q] <= within).sum() < 10:
                within *= 2
            whole = sorted((int(np.bitwise_count(asked[q] ^ own[i]).sum()), i) for i in np.flatnonzero(near[q] <= within))
            assert sorted(got[q]) == sorted(i for _, i in whole[:most])


def test_search_is_not_misled_by_copies(spark):
    r = np.random.default_rng(9)
    rows = {f"v{i:03}": [float(x) for x in np.float32(r.standard_normal(16))] for i in range(60)} | {f"w{i:03}": [1.0] * 16 for i in range(200)}
    df = spark.createDataFrame(list(rows.items()), "id string, vector array<float>")
    found = vectors.search(df, "id", "vector", df.where("id in ('w150', 'v001')"), k=5).collect()
    assert [x.id for x in sorted(found, key=lambda x: x["rank"]) if x.query_id == "w150"] == [f"w{i:03}" for i in range(5)]
    v = np.array(list(rows.values()))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    c = (v @ v[1]).round(9)
    want = sorted(range(len(v)), key=lambda j: (-c[j], list(rows)[j]))[1:6]
    assert [x.id for x in sorted(found, key=lambda x: x["rank"]) if x.query_id == "v001"] == [list(rows)[j] for j in want]


@pytest.mark.parametrize("schema", ["id string, vector array<float>"])
def test_vectors_of_empty_tables(spark, schema):
    empty = spark.createDataFrame([], schema)
    assert vectors.close_pairs(empty, "id", "vector").count() == 0
    assert vectors.search(empty, "id", "vector", empty).count() == 0
    one = spark.createDataFrame([("a", [1.0, 0.0])], schema)
    assert vectors.close_pairs(one, "id", "vector").count() == 0


def test_text_operators_on_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicate_pairs(empty, "doc_id", "text").count() == 0
    assert neardup.near_duplicate_groups(empty, "doc_id", "text").count() == 0
    assert spans.shared_spans(empty, "doc_id", "text").count() == 0
    items = spark.createDataFrame([], "item_id long, passage string")
    assert leaks.leaks(empty, "doc_id", "text", items, "item_id", "passage").count() == 0


def test_a_very_long_text(spark):
    r = random.Random(9)
    long = text_of(r, 200_000)
    df = spark.createDataFrame([(1, long), (2, long[:500_000] + " tail")], "doc_id long, text string")
    assert [(x.id, x.span_end - x.span_start >= 499_000) for x in spans.shared_spans(df, "doc_id", "text").orderBy("id").collect()] == [(1, True), (2, True)]
    assert neardup.near_duplicate_pairs(df, "doc_id", "text", neardup.SketchSettings(width=3, threshold=0.3)).count() == 1
