import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators.knn import diversify, mean_vectors, nearest, nearest_batch, post_filter
from lodestone.plans.search import search_media, search_texts

VECS = "rowid long, embedding array<float>"


def unit(i, dim=8):
    return [1.0 if k == i else 0.0 for k in range(dim)]


def tables(spark):
    files = spark.createDataFrame([(1, "/src/a.go"), (2, "/src-old/b.go"), (3, "/src/c.go"), (3, "/src/c.go")], "id long, path string")
    chunks = spark.createDataFrame(
        [(10, 1, 0, "alpha", 1, 2, "m"), (11, 2, 0, "beta", 1, 2, "m"), (12, 3, 0, "gamma", 1, 2, "old"), (13, 3, 1, "delta", 2, 3, "m"), (13, 3, 1, "delta", 2, 3, "m")],
        "id long, file_id long, chunk_index int, content string, start_line int, end_line int, embedding_model string",
    )
    vecs = spark.createDataFrame([(10, unit(0)), (11, unit(0)), (12, unit(0)), (13, unit(1)), (13, unit(1)), (14, unit(0)), (15, None), (16, [1.0])], VECS)
    return vecs, chunks, files


def test_order_model_and_restriction(spark):
    vecs, chunks, files = tables(spark)
    rows = search_texts(vecs, chunks, files, unit(0), "m").collect()
    assert [(r.path, round(r.score, 6)) for r in rows] == [("/src/a.go", 1.0), ("/src-old/b.go", 1.0), ("/src/c.go", 0.0)]
    assert [r.path for r in search_texts(vecs, chunks, files, unit(0), "m", restrict="/src").collect()] == ["/src/a.go", "/src/c.go"]
    assert search_texts(vecs, chunks, files, unit(0), "m", most=0).count() == 0
    assert search_texts(vecs.limit(0), chunks, files, unit(0), "m").count() == 0


def test_filters_come_after_the_limit(spark):
    rows = [(i, unit(0)) for i in range(5)] + [(9, unit(1))]
    assert sorted(r.rowid for r in nearest(spark.createDataFrame(rows, VECS), unit(0), 5).collect()) == [0, 1, 2, 3, 4]


def test_media(spark):
    media = spark.createDataFrame([(i, 1, i, "clip") for i in range(4)], "id long, file_id long, frame_index int, embedding_model string")
    vecs = spark.createDataFrame([(i, unit(i)) for i in range(4)], VECS)
    files = spark.createDataFrame([(1, "/p.jpg")], "id long, path string")
    rows = search_media(vecs, media, files, unit(2), "clip", 2).collect()
    assert [r.frame_index for r in rows] == [2, 0]


def greedy(cands, most, per_file):
    """The cap per path as a loop, to compare with."""
    if most <= 0:
        return []
    if per_file <= 0 or len(cands) <= most:
        return cands[:most]
    seen, taken, rest = {}, [], []
    for c in cands:
        seen[c[0]] = seen.get(c[0], 0) + 1
        (taken if seen[c[0]] <= per_file else rest).append(c)
    taken = taken[:most] + rest[: max(0, most - len(taken))]
    return sorted(taken, key=lambda c: -c[1])


@pytest.mark.parametrize("seed", range(6))
def test_diversify_against_the_loop(spark, seed):
    rng = np.random.default_rng(seed)
    cands = sorted(((f"p{rng.integers(3)}", float(rng.integers(1, 6)) / 10, i) for i in range(int(rng.integers(0, 9)))), key=lambda c: (-c[1], c[2]))
    df = spark.createDataFrame([(p, s, 1 - s, i) for p, s, i in cands], "path string, score double, distance double, rowid long")
    for most, per_file in ((0, 2), (3, 1), (4, 2), (5, 0), (20, 1)):
        got = [(r.path, r.score) for r in diversify(df, most, per_file).collect()]
        assert got == [(p, s) for p, s, _ in greedy(cands, most, per_file)]


def test_batch_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(120)], VECS)
    got = {(r.query_id, r["rank"]): r.rowid for r in nearest_batch(df, df.where("rowid % 50 = 0"), 5, 8, rows=16).collect()}
    for q in (0, 50, 100):
        d = ((x.astype(float) - x[q]) ** 2).sum(1)
        d[q] = np.inf
        assert [got[q, k + 1] for k in range(5)] == list(np.argsort(d, kind="stable")[:5])


def test_batch_with_equal_vectors_and_repeated_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 8)).astype(np.float32)
    # 60 equal vectors, the smallest ids last; id 500 forty times, nearer to the query than all others
    rows = [(i, x[1]) for i in range(160, 100, -1)] + [(500, x[0] * np.float32(1.001))] * 40 + [(i, x[i - 600]) for i in range(602, 630)] + [(50, x[0])]
    df = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in rows], VECS).coalesce(1)
    for block in (16, 4096):
        got = {(r.query_id, r["rank"]): r.rowid for r in nearest_batch(df, df.where("rowid in (50, 130)"), 12, 8, rows=block).collect()}
        assert [got[130, k + 1] for k in range(12)] == list(range(101, 113))
        d = sorted((float(((e.astype(float) - x[0]) ** 2).sum()), i) for i, e in {i: e for i, e in rows}.items() if i != 50)
        assert [got[50, k + 1] for k in range(12)] == [i for _, i in d[:12]]


def test_score_is_applied_to_any_distance(spark):
    df = spark.createDataFrame([("m", "/a", 1.0)], "embedding_model string, path string, distance double")
    assert post_filter(df, "m").first().score == 0.5


def test_mean_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0]), (2, None)], "k long, v array<float>")
    assert {r.k: list(r["mean"]) for r in mean_vectors(df, "k", "v").collect()} == {1: [2.0, 3.0], 2: [5.0, 6.0]}
    assert mean_vectors(df.where(F.lit(False)), "k", "v").count() == 0
