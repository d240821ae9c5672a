"""Learning queries over the embeddings, lines and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.ml import models, neighbours, vectors
from millrace.operators import calc
from millrace.plans.registry import query
from millrace.scratch import written

_CENTRES = """c AS MATERIALIZED (SELECT label, list(m ORDER BY pos) AS centre FROM (SELECT label, pos, avg(x) AS m FROM
  (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL) GROUP BY 1)"""


@query(
    "ml_distances",
    f"""WITH {_CENTRES}, x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, centre AS b FROM embeddings JOIN c USING (label))
       SELECT vec_id, round(list_distance(a, b), 7) AS euclidean, round(list_distance(a, b) ** 2, 7) AS squared,
         round(1 - list_cosine_similarity(a, b), 7) AS cosine, round(list_max(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))), 7) AS chebyshev,
         round(list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))), 7) AS manhattan,
         round(list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]) ** 3)) ** (1.0::DOUBLE / 3), 7) AS minkowski,
         round(1 - list_dot_product(a, b) / (list_dot_product(a, a) + list_dot_product(b, b) - list_dot_product(a, b)), 7) AS tanimoto FROM x""",
)
def ml_distances(t):
    """Each vector against the mean of its label."""
    centres = vectors.per_dimension(t.embeddings, "embedding", ["label"], centre=F.avg)
    rows = t.embeddings.join(centres, "label")
    a, b = F.col("embedding"), F.col("centre")
    measures = {
        "euclidean": vectors.euclidean(a, b),
        "squared": vectors.squared_euclidean(a, b),
        "cosine": vectors.cosine(a, b),
        "chebyshev": vectors.chebyshev(a, b),
        "manhattan": vectors.manhattan(a, b),
        "minkowski": vectors.minkowski(a, b, 3),
        "tanimoto": vectors.tanimoto(a, b),
    }
    return rows.select("vec_id", *[F.round(m, 7).alias(n) for n, m in measures.items()])


@query(
    "ml_knn",
    """SELECT a.vec_id AS query_id, CAST(row_number() OVER w AS INTEGER) AS rank, b.vec_id AS point_id,
         round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 7) AS distance
       FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
       WINDOW w AS (PARTITION BY a.vec_id ORDER BY list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id)
       QUALIFY row_number() OVER w <= 3""",
)
def ml_knn(t):
    points = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = neighbours.knn_join(points, points, k=3, distinct=True)
    return found.withColumn("distance", F.round("distance", 7))


_ITEMS = "SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings"


def _exploded(df):
    return df.select("vec_id", F.posexplode("embedding").alias("pos", "x")).select(
        "vec_id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.round("x", 7).alias("x")
    )


@query(
    "ml_standard_scaler",
    f"""WITH i AS ({_ITEMS}), s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM i GROUP BY 1)
       SELECT vec_id, CAST(pos AS BIGINT) AS pos, round((x - m) / s * 2 + 10, 7) AS x FROM i JOIN s USING (pos)""",
)
def ml_standard_scaler(t):
    return _exploded(vectors.StandardScaler("embedding", mean=10.0, std=2.0).fit(t.embeddings)(t.embeddings))


@query(
    "ml_minmax",
    f"""WITH i AS ({_ITEMS}), s AS (SELECT pos, min(x) AS lo, max(x) AS hi FROM i GROUP BY 1)
       SELECT vec_id, CAST(pos AS BIGINT) AS pos, round((x - lo) / (hi - lo) * 2 - 1, 7) AS x FROM i JOIN s USING (pos)""",
)
def ml_minmax(t):
    return _exploded(vectors.MinMaxScaler("embedding", -1.0, 1.0).fit(t.embeddings)(t.embeddings))


@query(
    "ml_chain",
    f"""WITH i AS ({_ITEMS}), s AS (SELECT pos, min(x) AS lo, max(x) AS hi FROM i GROUP BY 1)
       SELECT vec_id, CAST(pos AS BIGINT) AS pos, round((x - lo) / (hi - lo), 7) AS x FROM i JOIN s USING (pos)""",
)
def ml_chain(t):
    """Two transformers in a row (M12): standardising does not change what min-max gives."""
    chain = vectors.Chain(vectors.StandardScaler("embedding"), vectors.MinMaxScaler("embedding"))
    return _exploded(chain.fit(t.embeddings)(t.embeddings))


@query(
    "ml_poly_features",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x, l_discount * 10 AS y FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, round(x * x * x, 5) AS f0, round(x * x * y, 5) AS f1, round(x * y * y, 5) AS f2, round(y * y * y, 5) AS f3,
         round(x * x, 5) AS f4, round(x * y, 5) AS f5, round(y * y, 5) AS f6, round(x, 5) AS f7, round(y, 5) AS f8 FROM r""",
)
def ml_poly_features(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.array(F.col("l_quantity"), F.col("l_discount") * 10).alias("v"))
    made = vectors.PolynomialFeatures("v", 2, 3).fit(rows)(rows)
    return made.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(F.col("v")[i], 5).alias(f"f{i}") for i in range(9)])


@query(
    "ml_split_precise",
    """WITH n AS (SELECT count(*) AS n FROM orders) SELECT 'train' AS part, CAST(round(0.8 * n) AS BIGINT) AS n FROM n
       UNION ALL SELECT 'test', CAST(n - round(0.8 * n) AS BIGINT) FROM n""",
)
def ml_split_precise(t):
    train, test = calc.split_exactly(t.orders, [0.8, 0.2], ["o_orderkey"], seed=5)
    a = train.agg(F.lit("train").alias("part"), F.count(F.lit(1)).alias("n"))
    return a.unionByName(test.agg(F.lit("test").alias("part"), F.count(F.lit(1)).alias("n")))


@query(
    "ml_k_fold",
    "SELECT CAST(4 * count(*) AS BIGINT) AS training, CAST(count(*) AS BIGINT) AS testing FROM orders",
)
def ml_k_fold(t):
    """Five folds: every row is tested once and trained on four times."""
    folds = models.k_fold(t.orders.select("o_orderkey"), 5, ["o_orderkey"])
    both = None
    for train, test in folds:
        tagged = train.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(test.select(F.lit(0).alias("a"), F.lit(1).alias("b")))
        both = tagged if both is None else both.unionByName(tagged)
    return both.agg(F.sum("a").alias("training"), F.sum("b").alias("testing"))


def _regression_sql(rounds):
    out = ["""WITH r AS MATERIALIZED (SELECT l_quantity / 50 AS x1, l_discount * 10 AS x2, l_extendedprice / 100000 AS y FROM lineitem),
      w0 AS (SELECT 0.0::DOUBLE AS b, 0.0::DOUBLE AS a1, 0.0::DOUBLE AS a2)"""]
    for i in range(1, rounds + 1):
        rate = f"(0.5::DOUBLE / sqrt({i}.0::DOUBLE))"
        out.append(f"""w{i} AS MATERIALIZED (SELECT any_value(b) - {rate} * avg(b + a1 * x1 + a2 * x2 - y) AS b,
          any_value(a1) - {rate} * avg((b + a1 * x1 + a2 * x2 - y) * x1) AS a1, any_value(a2) - {rate} * avg((b + a1 * x1 + a2 * x2 - y) * x2) AS a2
          FROM r, w{i - 1})""")
    return ", ".join(out) + f" SELECT round(b, 8) AS intercept, round(a1, 8) AS w1, round(a2, 8) AS w2 FROM w{rounds}"


def _lines(t):
    return t.lineitem.select(
        (F.col("l_quantity") / 50).alias("x1"), (F.col("l_discount") * 10).alias("x2"), (F.col("l_extendedprice") / 100000).alias("y")
    )


@query("ml_linreg", _regression_sql(6))
def ml_linreg(t):
    """Price by quantity and discount, six rounds."""
    model = models.descend(_lines(t), ["x1", "x2"], "y", step=0.5, rounds=6)
    values = [model.intercept, *model.weights]
    names = ["intercept", "w1", "w2"]
    return t.spark.range(1).select(*[F.round(F.lit(v), 8).alias(n) for n, v in zip(names, values, strict=True)])


@query("ml_svm")
def ml_svm(t):
    """Hinge loss with an L2 penalty: is the line dear? Accuracy of the fitted plane (M8)."""
    rows = _lines(t).withColumn("label", F.when(F.col("y") > 0.4, 1.0).otherwise(-1.0))
    model = models.descend(rows, ["x1", "x2"], "label", models.hinge_loss, models.l2_penalty, 0.001, step=2.0, rounds=25)
    hit = (F.signum(model.predict()) == F.col("label")).cast("double")
    return rows.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query("ml_logistic")
def ml_logistic(t):
    """Logistic loss with an L1 penalty."""
    rows = _lines(t).withColumn("label", F.when(F.col("y") > 0.4, 1.0).otherwise(-1.0))
    model = models.descend(rows, ["x1", "x2"], "label", models.logistic_loss, models.l1_penalty, 0.001, step=2.0, rounds=15)
    cost, _ = models.logistic_loss(model.predict(), F.col("label"))
    return rows.agg(F.avg(cost).alias("loss"), F.count(F.lit(1)).alias("n"))


@query("ml_als")
def ml_als(t):
    """Customers and parts by ordered quantity (M9): number of ratings and the empirical risk."""
    orders = t.orders.select("o_orderkey", F.col("o_custkey").cast("int").alias("customer"))
    lines = t.lineitem.select("l_orderkey", F.col("l_partkey").cast("int").alias("part"), "l_quantity")
    ratings = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("customer", "part").agg(
        F.avg("l_quantity").cast("float").alias("rating")
    )
    # fitting reads the ratings twice, predicting and counting once each: joined and grouped once, they are read as written
    ratings = written(ratings, "ratings")
    model = models.factorise(ratings, "customer", "part", "rating", factors=4, reg=0.5, rounds=3, seed=1)
    predicted = model.transform(ratings)
    risk = models.empirical_risk(predicted, "rating", model.userFactors, model.itemFactors, 0.5)
    return risk.withColumn("ratings", ratings.agg(F.count(F.lit(1))).scalar())


def _kmeans_sql(rounds):
    out = [f"""WITH i AS MATERIALIZED ({_ITEMS}),
      c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS k, CAST(embedding AS DOUBLE[]) AS centre
        FROM embeddings ORDER BY vec_id LIMIT 5)"""]
    for r in range(rounds + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, arg_min(k, (list_distance(CAST(embedding AS DOUBLE[]), centre), k)) AS k FROM embeddings, c{r} GROUP BY 1)""")
        if r < rounds:
            out.append(f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(m.centre, c{r}.centre) AS centre FROM c{r} LEFT JOIN
              (SELECT k, list(m ORDER BY pos) AS centre FROM (SELECT k, pos, avg(x) AS m FROM i JOIN a{r} USING (vec_id) GROUP BY ALL) GROUP BY 1) m USING (k))""")
    return ", ".join(out) + f" SELECT vec_id, k AS cluster FROM a{rounds}"


@query("ml_kmeans", _kmeans_sql(3))
def ml_kmeans(t):
    """Three rounds from the five first vectors."""
    begin = t.embeddings.orderBy("vec_id").limit(5).select("embedding").collect()
    rows, _ = models.kmeans(t.embeddings, "embedding", [[float(x) for x in r[0]] for r in begin], 3)
    return rows.select("vec_id", "cluster")


@query("ml_outliers")
def ml_outliers(t):
    """Stochastic outlier selection over all vectors."""
    points = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = neighbours.outlier_selection(points, perplexity=30.0)
    return found.select(F.col("id").alias("vec_id"), F.round("probability", 6).alias("probability"))


@query(
    "ml_matrix_add",
    """SELECT l_suppkey AS i, l_partkey AS j, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 2) AS v FROM lineitem
       WHERE l_returnflag = 'R' GROUP BY ALL""",
)
def ml_matrix_add(t):
    """Sparse matrices of open and filled returns, added cell by cell."""
    cells = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), "l_linestatus", F.col("l_quantity").alias("v"))
    a, b = cells.where("l_linestatus = 'O'").drop("l_linestatus"), cells.where("l_linestatus = 'F'").drop("l_linestatus")
    return models.matrix_add(a, b).withColumn("v", F.round("v", 2))


@query("ml_pi")
def ml_pi(t):
    """A Monte-Carlo estimate with one draw per order line."""

    def draw(salt):
        return F.pmod(F.xxhash64(F.lit(salt), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), F.lit(1 << 40)) / float(1 << 40)

    inside = (draw(1) * draw(1) + draw(2) * draw(2) <= 1).cast("double")
    return t.lineitem.agg((4 * F.avg(inside)).alias("pi"), F.count(F.lit(1)).alias("draws"))
