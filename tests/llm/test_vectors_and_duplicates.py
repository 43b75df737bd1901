import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm.near_duplicates import MASKS, Filter, candidate_pairs, connected_components, near_duplicate_groups, shingles, similar_classes, similar_ids, signatures, text_classes
from lodestone.llm.similar_vectors import Index, _gaps, build_index, codebook, half_distances, kmeans, most_similar, placements, similar_pairs, traverse

VECS = "rowid long, embedding array<float>, cell int, id string"


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), None if v is None else [float(c) for c in v], 1, "clash") for i, v in zip(ids, x)], VECS)


def test_traversal_is_in_order_and_complete():
    rng = np.random.default_rng(0)
    d1, d2 = rng.random(5), rng.random(6)
    sizes = rng.integers(0, 3, 30)
    got = traverse(d1, d2, sizes, 10**9)
    sums = (d1[:, None] + d2[None, :]).ravel()
    assert got == [c for c in np.argsort(sums, kind="stable") if sizes[c]]
    few = traverse(d1, d2, sizes, 4)
    assert few == got[: len(few)] and sizes[few].sum() >= 4 > sizes[few[:-1]].sum()


@pytest.mark.parametrize("max_cell, hot_blocks", [(4096, 16), (40, 16), (40, 1)])
def test_recall_against_brute_force(spark, max_cell, hot_blocks):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 32))
    x = (centres[rng.integers(0, 12, 900)] + 0.6 * rng.normal(size=(900, 32))).astype(np.float32)
    got = {}
    for r in most_similar(frame(spark, range(900), x), "rowid", "embedding", 32, k=5, centroids=8, candidates=300, max_cell=max_cell, hot_blocks=hot_blocks).collect():
        got.setdefault(r.id, []).append((r.other, r.score))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    hits = sum(len({o for o, _ in got[i]} & set(np.argsort(-s[i])[:5])) for i in range(900))
    assert hits / 4500 >= 0.95
    assert all(len({o for o, _ in v}) == 5 and abs(s[i, o] - c) < 2e-3 for i, v in got.items() for o, c in v)


def test_nulls_zeros_widths_repeats_and_ties(spark):
    x = [[1, 0, 0, 0], [1, 0, 0, 0], [0, 0, 0, 0], None, [1, 0], [0.9, 0.1, 0, 0], [1, 0, 0, 0], [1, 0, 0, 0]]
    df = frame(spark, [1, 2, 3, 4, 5, 6, 7, 7], x)
    got = {}
    for r in most_similar(df, "rowid", "embedding", 4, k=2).collect():
        got.setdefault(r.id, []).append(r.other)
    assert {k: sorted(v) for k, v in got.items()} == {1: [2, 7], 2: [1, 7], 6: [1, 2], 7: [1, 2]}
    assert most_similar(df.limit(0), "rowid", "embedding", 4).count() == 0
    assert most_similar(df.where("rowid = 1"), "rowid", "embedding", 4).count() == 0
    pairs = similar_pairs(most_similar(df, "rowid", "embedding", 4, k=2), 0.99)
    assert sorted((r.id_a, r.id_b) for r in pairs.collect()) == [(1, 2), (1, 6), (1, 7), (2, 6), (2, 7)]


def test_a_large_class_of_equal_vectors(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.tile(rng.normal(size=8), (300, 1)), rng.normal(size=(50, 8))]).astype(np.float32)
    got = {}
    for r in most_similar(frame(spark, range(350), x), "rowid", "embedding", 8, k=3, max_cell=64, candidates=400).collect():
        got.setdefault(r.id, set()).add(r.other)
    assert got[200] == {0, 1, 2} and got[1] == {0, 2, 3} and len(got) == 350
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 4)
    np.fill_diagonal(s, -2)
    for i in range(300, 350):
        want = set(sorted(range(350), key=lambda j: (-s[i, j], j))[:3])
        assert len(got[i] & want) >= 2


@pytest.mark.parametrize("max_cell", [4096, 40])
def test_copies_dont_use_up_the_visits(spark, max_cell):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([np.repeat(base, 30, axis=0), base + 0.3 * rng.normal(size=(60, 16))]).astype(np.float32)
    got = {}
    df = frame(spark, range(len(x)), x)
    for r in most_similar(df.unionByName(df.where("rowid % 7 = 0")), "rowid", "embedding", 16, k=40, centroids=6, candidates=50, max_cell=max_cell).collect():
        got.setdefault(r.id, []).append(r.other)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 3)
    np.fill_diagonal(s, -2)
    near = [len({int(j) for j in got[i]} & {30 * (i - 1800) + c for c in range(30)}) for i in range(1800, 1860)]
    assert np.mean(near) > 28 and all(len(v) == len(set(v)) == 40 for v in got.values())
    for i in range(0, 1800, 31):  # the other copies first, then other vectors
        assert set(got[i]) >= {30 * (i // 30) + c for c in range(30)} - {i}


def test_a_hub_is_split(spark):
    rng = np.random.default_rng(6)
    hub = rng.normal(size=8)
    # a dense hub in the middle of vectors that all visit it
    x = np.concatenate([hub + 0.02 * rng.normal(size=(150, 8)), hub + rng.normal(size=(1500, 8))]).astype(np.float32)
    usable = frame(spark, range(len(x)), x).selectExpr("rowid AS id", "embedding AS vec")
    index, _ = build_index(usable, len(x), 8, 5, 12, 400, 64, 20_000, 1000, 100)
    groups = placements(usable, index, "bigint").groupBy("cell", "block_a", "block_b", "part").agg(F.count_if(F.col("mine") < 0).alias("guests"), F.count_if(F.col("mine") >= 0).alias("own")).collect()
    assert index.parts.max() > 4 and max(g.guests for g in groups) <= 200 and max(g.own for g in groups) <= 4 * 64
    got = {}
    for r in most_similar(usable, "id", "vec", 8, k=5, centroids=12, candidates=400, max_cell=64, guests=100, hot_blocks=1000).collect():
        got.setdefault(r.id, set()).add(r.other)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert sum(len(got[i] & set(np.argsort(-s[i])[:5])) for i in range(len(x))) >= 0.95 * 5 * len(x)


def scattered(n, width, topics, seed):
    """Unit vectors that scatter alike in all directions around a few topics, and a neighbour of each with a cosine of 0.82 to 0.95."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(0.55 * unit(rng.normal(size=(topics, width)))[rng.integers(0, topics, n)] + 0.83 * unit(rng.normal(size=(n, width))))
    aside = rng.normal(size=x.shape)
    aside = unit(aside - (aside * x).sum(1, keepdims=True) * x)
    cosine = rng.uniform(0.82, 0.95, (n, 1))
    return np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * aside]).astype(np.float32)


@pytest.mark.parametrize("max_cell, hot_blocks", [(4096, 16), (100, 2)])
def test_near_neighbours_are_found_when_cells_are_full(spark, max_cell, hot_blocks):
    # every cell alone holds more than `candidates`, as in a large table
    n = 3000
    x = scattered(n, 64, 3, 11)
    got = {}
    for r in most_similar(frame(spark, range(2 * n), x), "rowid", "embedding", 64, k=5, centroids=12, candidates=10, max_cell=max_cell, hot_blocks=hot_blocks).collect():
        got.setdefault(r.id, set()).add(r.other)
    assert sum(i + n in got.get(i, ()) or i in got.get(i + n, ()) for i in range(n)) >= 0.99 * n


def test_cells_within_the_margin():
    x = scattered(200, 16, 3, 12)
    index = Index(16, 5, 10, 64, 100)
    index.codebooks = (codebook(x[:, :8], 7), codebook(x[:, 8:], 9))
    index.gaps, index.cells, index.sizes = tuple(map(_gaps, index.codebooks)), 63, np.ones(63, int)
    d1, d2 = half_distances(x, index.codebooks)
    got = sorted(zip(*(v.tolist() for v in index.near_cells(x, d1, d2))))
    want = []
    for r in range(len(x)):
        h, g = int(d1[r].argmin()), int(d2[r].argmin())
        for i, j in itertools.product(range(7), range(9)):
            apart = ((index.codebooks[0][h] - index.codebooks[0][i]) ** 2).sum() + ((index.codebooks[1][g] - index.codebooks[1][j]) ** 2).sum()
            off = d1[r, i] + d2[r, j] - d1[r, h] - d2[r, g] - index.reach * apart**0.5
            if off <= 1e-5:
                want.append((r, i * 9 + j, off))
    assert {p[:2] for p in want if p[2] < -1e-5} | {(r, int(d1[r].argmin()) * 9 + int(d2[r].argmin())) for r in range(len(x))} <= set(got) <= {p[:2] for p in want}
    assert len(got) == len(set(got)) > 2 * len(x)


def test_a_codebook_divides_what_scatters():
    x = scattered(10_000, 192, 30, 13)[:10_000]
    most = [np.bincount((x @ c.T - 0.5 * (c**2).sum(1)).argmax(1), minlength=len(c)).max() for c in (kmeans(x, 160), codebook(x, 160))]
    assert most[1] < 0.5 * most[0] and 128 <= len(codebook(x, 160)) <= 192


def jaccard_pairs(rows, words, least):
    sets = {}
    for i, t in rows:
        if t is not None:
            w = re.findall(r"[^\W_]+", t.lower())
            if len(w) >= words:
                sets[i] = set(zip(*(w[k:] for k in range(words))))
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}é" for k in range(400)]
    rows, i = [], 0
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(4, 60))]
        for _ in range(rng.randint(1, 3)):
            edited = words[:]
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(edited))
                edited[k : k + rng.randint(0, 1)] = [rng.choice(vocabulary)]
            rows.append((i, " ".join(edited).upper() if rng.random() < 0.2 else ", ".join(edited)))
            i += 1
    return rows + [(i, None), (i + 1, ""), (i + 2, "a b"), (i + 3, "x " * 40_000), (i + 4, "x " * 40_000)]


def test_masks_cover_every_two_coordinates():
    assert all(len(m) == 4 for m in MASKS)
    for differ in itertools.combinations(range(7), 2):
        assert any(not set(differ) & set(m) for m in MASKS)


def test_shingles_are_the_same_in_any_batch():
    texts = ["One two, three four", "", "ünö-TWO three", "one two three four"]
    whole = shingles(texts, 3)
    for k, t in enumerate(texts):
        alone = shingles([t], 3)
        assert alone[2][0] == whole[2][k] and list(alone[1]) == list(whole[1][whole[0] == k])
    assert whole[2][0] == whole[2][3] != whole[2][2]
    assert signatures(whole[0], whole[1], 7)[1].shape == (3, 7)


def test_pairs_and_groups_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows + rows[:5]], "id long, content string, class int")
    want = jaccard_pairs(rows, 3, 0.5)
    got = [(r.id_a, r.id_b) for r in similar_ids(df, "id", "content", 3, 0.5, groups=16).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got) & want) >= 0.99 * len(want)
    groups = {r.id: r for r in near_duplicate_groups(df, "id", "content", 3, 0.5, groups=16).collect()}
    parent = {i: i for i in groups}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in got:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert all(r.group_id == root(i) for i, r in groups.items())
    assert near_duplicate_groups(df.limit(0), "id", "content").count() == 0 and similar_ids(df.limit(0), "id", "content").count() == 0


def test_crowded_keys_are_joined_exactly(spark):
    rng = random.Random(8)
    base = [f"b{k}" for k in range(40)]
    rows = []
    for i in range(60):
        words = base[:]
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(40)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "id long, content string")
    want = jaccard_pairs(rows, 3, 0.5)
    links = similar_classes(df, "id", "content", 3, 0.5, crowd=5)
    ids = {r["class"]: r.id for r in text_classes(df, "id", "content", 3).collect()}
    got = {tuple(sorted((ids[r.class_a], ids[r.class_b]))) for r in links.collect()}
    assert {p for p in want if p[0] in ids.values() and p[1] in ids.values()} == got


def test_a_key_that_very_many_share_is_not_sent_to_one_task(spark):
    rows = [(i, f"one two three four five six seven eight nine ten eleven twelve x{i}") for i in range(400)] + [(900, "other words that are nowhere else at all")]
    df = spark.createDataFrame(rows, "id long, content string").coalesce(2)
    met = candidate_pairs(df, "id", "content", 3, 12, crowd=5).collect()
    assert all(r.class_a == r.class_b for r in met) and len({r.class_a for r in met}) == 400
    got = [(r.id_a, r.id_b) for r in similar_ids(df, "id", "content", 3, 0.5, whole=True).collect()]
    assert len(got) == len(set(got)) == 400 * 399 // 2


def test_the_filter_lets_all_members_pass(spark):
    rng = np.random.default_rng(9)
    members = rng.integers(-(1 << 63), 1 << 63, 500)
    f = Filter(spark.createDataFrame([(int(m),) for m in members], "class long"), bits=14)
    assert f.holds(members.view(np.uint64)).all() and f.holds(rng.integers(0, 1 << 63, 2000).astype(np.uint64)).mean() < 0.1


def test_components_that_dont_converge_are_an_error(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long")
    with pytest.raises(RuntimeError, match="complete"):
        connected_components(edges, rounds=2)


def test_many_copies_are_linked_to_the_first(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(i, text) for i in range(40)] + [(99, text + " eight"), (98, text.upper())], "id long, content string")
    got = {(r.id_a, r.id_b) for r in similar_ids(df, "id", "content", 3, 0.5).collect()}
    assert got == {(0, i) for i in range(1, 40)} | {(0, 98), (0, 99)}


def test_all_pairs_of_large_classes(spark, tmp_path):
    from lodestone.llm.queries import p4_found

    text = "one two three four five six seven"
    # 300 copies with other marks or case, 25 of a near duplicate, two rows repeated
    rows = [(i, (text, text.upper(), text.replace(" ", ", "))[i % 3]) for i in range(300)] + [(400 + i, text + " eight" + "." * (i % 2)) for i in range(25)]
    rows += [(500, "nine " + text), (501, "other words that nothing shares"), (502, "other words that nothing shares!")]
    df = spark.createDataFrame(rows + rows[:2], "id long, content string")
    df.write.parquet(str(tmp_path / "chunks.parquet"))
    got = [(r.id_a, r.id_b) for r in p4_found(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == jaccard_pairs(rows, 3, 0.5)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {n: n for e in edges for n in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert got == {n: root(n) for n in parent if any(n in e and e[0] != e[1] for e in edges)}
