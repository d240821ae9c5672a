"""Learning operators against direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.ml import models, neighbours, vectors


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    data = np.concatenate([rng.normal(c, 0.5, (40, 3)) for c in (0, 3, 9)])
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, "id bigint, vector array<float>"), np.array([v for _, v in rows])


@pytest.mark.parametrize("k", [1, 4, 130])
@pytest.mark.parametrize("block_rows", [7, 1000])
def test_knn(points, k, block_rows):
    df, data = points
    found = neighbours.knn_join(df, df, k=k, pivots=5, block_rows=block_rows, distinct=True)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["distance"]
    gaps = np.sqrt(((data[:, None] - data[None]) ** 2).sum(-1))
    for i in range(len(data)):
        want = np.sort(np.delete(gaps[i], i))[:k]
        assert [got[i][j + 1] for j in range(len(want))] == pytest.approx(want, abs=1e-6)


def test_outliers(spark):
    rows = [(0, [1.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 2.0]), (3, [2.0, 2.0]), (4, [5.0, 8.0])]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>")
    got = {r["id"]: r["probability"] for r in neighbours.outlier_selection(df, 3.0, block_rows=2).collect()}
    assert got[4] > 0.9 and max(got[i] for i in range(4)) < 0.5


def perplexed(ids, data, perplexity):
    """Outlier probabilities by bisection to the last digit."""
    gaps, left = np.sqrt(((data[:, None] - data[None]) ** 2).sum(-1)), np.zeros(len(ids))
    for i in range(len(ids)):
        others = ids != ids[i]
        d = gaps[i][others] - gaps[i][others].min()
        lo, hi = 0.0, 1e9
        for _ in range(200):
            near = np.exp(-(lo + hi) / 2 * d)
            over = np.log(near.sum()) + (lo + hi) / 2 * (near * d).sum() / near.sum() > np.log(perplexity)
            lo, hi = ((lo + hi) / 2, hi) if over else (lo, (lo + hi) / 2)
        left[others] += np.log1p(-np.minimum(near / near.sum(), 1 - 1e-15))
    return np.exp(left)


def test_outliers_reach_the_perplexity(spark, points):
    """Every point, also one that many rounds are needed for, and one so far off that its affinities are 0 at the first beta."""
    df, data = points
    far = [(1000, [900.0, 0.0, 0.0]), (1001, [900.0, 1e-3, 0.0])]
    df = df.union(spark.createDataFrame(far, "id bigint, vector array<float>"))
    data = np.concatenate([data, np.array([v for _, v in far], dtype=np.float32)])
    ids = np.array([*range(120), 1000, 1001])
    for perplexity in (2.0, 30.0):
        got = {r["id"]: r["probability"] for r in neighbours.outlier_selection(df, perplexity, block_rows=50).collect()}
        assert [got[i] for i in ids] == pytest.approx(perplexed(ids, data, perplexity), abs=1e-8)
    with pytest.raises(Exception, match="have not reached the perplexity"):
        neighbours.outlier_selection(df, 30.0, rounds=3).collect()


def test_outliers_of_the_documentation(spark):
    rows = [(0, [1.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 2.0]), (3, [2.0, 2.0]), (4, [5.0, 8.0])]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>")
    got = {r["id"]: r["probability"] for r in neighbours.outlier_selection(df, 3.0).collect()}
    want = [0.2790094479202896, 0.25775014551682535, 0.22136130977995766, 0.12707053787018444, 0.9922779902453757]
    assert [got[i] for i in range(5)] == pytest.approx(want, abs=1e-6)


def test_ml_outliers_asks_for_the_whole_job(spark, points, tmp_path):
    from millrace.plans import learning
    from millrace.sources.tables import Tables

    df, data = points
    df.selectExpr("id AS vec_id", "vector AS embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r["probability"] for r in learning.ml_outliers(Tables(spark, str(tmp_path))).collect()}
    assert [got[i] for i in range(len(data))] == pytest.approx(perplexed(np.arange(len(data)), data, 30.0), abs=1e-6)


def test_outliers_with_ties_few_points_and_null_ids(spark):
    ties = spark.createDataFrame([(i, [float(i % 3)]) for i in range(18)], "id bigint, vector array<float>")
    got = [r["probability"] for r in neighbours.outlier_selection(ties, 5.0, block_rows=7).collect()]
    assert got == pytest.approx([0.8**5] * 18, abs=1e-9)
    few = spark.createDataFrame([(None, [0.5]), (1, [0.0]), (2, [1.0]), (3, [5.0])], "id bigint, vector array<float>")
    got = {r["id"]: r["probability"] for r in neighbours.outlier_selection(few, 30.0).collect()}
    assert got == pytest.approx({None: (2 / 3) ** 3, 1: (2 / 3) ** 2, 2: (2 / 3) ** 2, 3: (2 / 3) ** 2})
    alone = spark.createDataFrame([(1, [0.5])], "id bigint, vector array<float>")
    assert [tuple(r) for r in neighbours.outlier_selection(alone, 30.0).collect()] == [(1, 1.0)]
    assert neighbours.outlier_selection(alone.where("id = 2"), 30.0).count() == 0


@pytest.mark.parametrize("block_rows", [10, 1000])
def test_outliers_copy_no_rows_for_each_block(points, block_rows):
    df, _ = points
    assert 0 < shuffled_rows(neighbours.outlier_selection(df, 30.0, block_rows=block_rows)) <= 3 * 120


def shuffled_rows(df):
    """Rows written to shuffles by the plan of a frame that was collected."""
    def below(plan):
        kids = [plan.children().apply(i) for i in range(plan.children().size())]
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            kids = [plan.executedPlan()]
        if name.endswith("QueryStageExec"):
            kids = [plan.plan()]
        own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        return own + sum(below(x) for x in kids)

    df.collect()
    return below(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("block_rows", [10, 1000])
def test_knn_copies_no_rows_for_each_block(points, block_rows):
    df, _ = points
    assert 0 < shuffled_rows(neighbours.knn_join(df, df, k=1, pivots=5, block_rows=block_rows)) <= 3 * 120


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_knn_of_ties_repeated_and_null_ids(spark, kind):
    """The smaller id first on ties; copies of an id are points of their own, and none of them is a neighbour of the other."""
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (4, [3.0, 4.0]), (3, [3.0, 4.0]), (2, [3.0, 4.0]), (None, [0.0, 1.0]), (5, [float("nan"), 0.0])]
    df = spark.createDataFrame(rows, "id bigint, vector array<float>").selectExpr(f"CAST(id AS {kind}) AS id", "vector")
    asked = df.where("id IN (1, 2, 5)").dropDuplicates(["id"])
    for block_rows in (2, 1000):
        found = neighbours.knn_join(asked, df, k=3, pivots=3, block_rows=block_rows, distinct=True).collect()
        got = {}
        for r in found:
            got.setdefault(int(r["query_id"]), {})[r["rank"]] = (r["point_id"] and int(r["point_id"]), r["distance"])
        assert got[1] == {1: (None, 1.0), 2: (2, 5.0), 3: (3, 5.0)}
        assert got[2] == {1: (3, 0.0), 2: (4, 0.0), 3: (None, pytest.approx(18**0.5))} and set(got) == {1, 2}


def test_knn_far_from_the_origin(spark):
    """Single precision leaves out nothing that is near: gaps here are far below its digits of the coordinates."""
    rng = np.random.default_rng(8)
    data = (np.round(rng.normal(0, 40, (600, 4))) / 8 + np.array([4096.0, -4096.0, 0.0, 2048.0])).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id bigint, vector array<float>")
    gaps = np.sqrt(((data[:, None] - data[None]) ** 2).sum(-1))
    np.fill_diagonal(gaps, np.inf)
    want = np.argsort(gaps, axis=1, kind="stable")[:, :3]
    got = {(r["query_id"], r["rank"]): r["point_id"] for r in neighbours.knn_join(df, df, k=3, distinct=True).collect()}
    assert [[got[i, j + 1] for j in range(3)] for i in range(600)] == want.tolist()


def test_polynomial_features(spark):
    df = spark.createDataFrame([([3.0, 2.0],)], "v array<double>")
    made = vectors.PolynomialFeatures("v", 2, 3).fit(df)(df).first()[0]
    assert made == [27, 18, 12, 8, 9, 6, 4, 3, 2]


def test_scalers(points):
    df, data = points
    scaled = vectors.StandardScaler("vector").fit(df)(df).orderBy("id").collect()
    assert np.allclose([r["vector"] for r in scaled], (data - data.mean(0)) / data.std(0), atol=1e-6)
    ranged = vectors.MinMaxScaler("vector").fit(df)(df).orderBy("id").collect()
    assert np.allclose([r["vector"] for r in ranged], (data - data.min(0)) / np.ptp(data, axis=0), atol=1e-6)


@pytest.mark.parametrize("penalty", [models.no_penalty, models.l2_penalty, models.l1_penalty])
def test_linear_regression(spark, penalty):
    df = spark.range(400).select((F.col("id") % 20 / 20).alias("x"), (F.col("id") % 7 / 7).alias("z"))
    df = df.withColumn("y", 3 * F.col("x") - 2 * F.col("z") + 1)
    model = models.descend(df, ["x", "z"], "y", penalty=penalty, amount=1e-4, step=2.0, rounds=150, converge=1e-9)
    assert [*model.weights, model.intercept] == pytest.approx([3, -2, 1], abs=0.3)
    assert models.squared_residual_sum(df, model, "y").first()[0] / 400 < 0.02


def test_svm_separates(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 2 * 2.0 - 1).alias("y"))
    df = df.withColumn("x", F.col("y") * (1 + F.col("id") % 5 / 5))
    model = models.descend(df, ["x"], "y", models.hinge_loss, models.l2_penalty, 0.01, 0.5, 10)
    assert df.where(F.signum(model.predict()) != F.col("y")).count() == 0


def test_kmeans(points):
    df, data = points
    rows, centres = models.kmeans(df, "vector", [data[0].tolist(), data[50].tolist(), data[100].tolist()], 4)
    assert [r["cluster"] for r in rows.orderBy("id").collect()] == [0] * 40 + [1] * 40 + [2] * 40
    assert np.allclose(centres[1], data[40:80].mean(0), atol=1e-6)


def test_k_fold_and_matrix(spark):
    rows = spark.range(100)
    for train, test in models.k_fold(rows, 4, ["id"]):
        assert train.count() + test.count() == 100 and train.join(test, "id").count() == 0
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "i int, j int, v double")
    b = spark.createDataFrame([(0, 1, 5.0), (2, 2, 7.0)], "i int, j int, v double")
    assert sorted(map(tuple, models.matrix_add(a, b).collect())) == [(0, 0, 1.0), (0, 1, 7.0), (2, 2, 7.0)]
    assert sorted(map(tuple, models.matrix_combine(a, b, lambda x, y: x * y).where("v <> 0").collect())) == [(0, 1, 10.0)]


def test_distances_by_products_agree_with_differences():
    """The product form drops nothing: equal and nearly equal rows, ties, a long offset."""
    import numpy as np

    from millrace.ml import neighbours

    rng = np.random.default_rng(2)
    b = np.concatenate([rng.normal(size=(60, 8)), rng.normal(size=(20, 8)) + 1e4])
    b = np.concatenate([b, b[:10], b[10:20] + 1e-7])
    a = b[::3]
    exact = neighbours._squared(a, b)
    assert np.allclose(neighbours._products(a, b, 1e-4), exact, rtol=1e-9, atol=0)
    assert (neighbours._products(a, b, 1e-4) == 0).sum() == (exact == 0).sum()
    barred = np.arange(len(b))[::3, None] == np.arange(len(b))[None, :]
    (row, place), gaps = neighbours._nearest(a, b, 4, barred)
    want = np.sqrt(exact)
    want[barred] = np.inf
    order = np.argsort(want, axis=1, kind="stable")[:, :4]
    assert (place.reshape(-1, 4) == order).all() and np.array_equal(gaps.reshape(-1, 4), np.take_along_axis(want, order, axis=1))


def test_als_risk_and_ratings_written_once(spark, tmp_path, monkeypatch):
    """The risk is that of the fitted factors; fitting, predicting and counting read the ratings, not the join behind them."""
    from millrace.plans import learning
    from millrace.sources.tables import Tables

    rng = np.random.default_rng(6)
    bought = [(k, int(p), float(q)) for k in range(60) for p, q in zip(rng.integers(0, 9, 4), rng.integers(1, 50, 4))]
    spark.createDataFrame([(k, k % 12) for k in range(60)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.createDataFrame(bought, "l_orderkey bigint, l_partkey bigint, l_quantity double")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    seen, fit = [], models.factorise

    def factorise(ratings, *names, **how):
        seen.extend([ratings, fit(ratings, *names, **how)])
        return seen[1]

    monkeypatch.setattr(models, "factorise", factorise)
    got = learning.ml_als(Tables(spark, str(tmp_path))).collect()
    ratings, model = seen
    assert ratings.inputFiles() and not [f for f in ratings.inputFiles() if "lineitem.parquet" in f or "orders.parquet" in f]
    cells = {}
    for k, p, q in bought:
        cells.setdefault((k % 12, p), []).append(q)
    users = {r["id"]: np.array(r["features"]) for r in model.userFactors.collect()}
    items = {r["id"]: np.array(r["features"]) for r in model.itemFactors.collect()}
    error = sum((np.float32(np.mean(q)) - users[c] @ items[p]) ** 2 for (c, p), q in cells.items())
    norms = sum((v**2).sum() for v in [*users.values(), *items.values()])
    assert [r["ratings"] for r in got] == [len(cells)]
    assert got[0]["risk"] == pytest.approx(error + 0.5 * norms, rel=1e-4)
