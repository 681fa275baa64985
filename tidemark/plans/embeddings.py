"""Queries over embeddings: windows of a clip (label) in order, and anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import signal, vector
from tidemark.operators import aggregates, clustering, ranking
from tidemark.plans.tables import registry, table

QUERIES, SQL, query = registry()


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


_SQ = "list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))"


@query(f"SELECT vec_id, round(sqrt({_SQ}), 5) AS norm, abs({_SQ} - 1) <= 1e-4 AS is_unit, len(embedding) AS dim FROM embeddings")
def emb_norms(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("embedding")
    return _rows(spark, folder).select("vec_id", F.round(vector.norm(e), 5).alias("norm"), vector.is_unit(e).alias("is_unit"), F.size(e).cast("long").alias("dim"))


@query(
    f"""WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt({_SQ})) AS v FROM embeddings)
    SELECT vec_id, round(list_sum(v), 4) AS total, round(list_max(v), 5) AS most FROM n"""
)
def emb_normalized(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder).select("vec_id", vector.normalized(F.col("embedding"), 64).alias("v"))
    return rows.select("vec_id", F.round(vector.total(F.col("v")), 4).alias("total"), F.round(F.array_max("v"), 5).alias("most"))


_FLAT = "f AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"


def _pooled_sql(parts: str, normalize: bool = True) -> str:
    told = "round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 4)" if normalize else "round(v, 4)"
    return f"WITH {_FLAT}, {parts} SELECT label, pos, {told} AS v FROM p"


def _flat(df: DataFrame) -> DataFrame:
    return df.select("label", F.posexplode("embedding").alias("pos", "v")).select("label", F.col("pos").cast("long").alias("pos"), F.round("v", 4).alias("v"))


@query(_pooled_sql("p AS (SELECT label, pos, avg(x) AS v FROM f GROUP BY ALL)"))
def emb_mean_renorm(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(aggregates.pooled(_rows(spark, folder), ["label"], "embedding"))


@query(_pooled_sql("p AS (SELECT label, pos, max(x) AS v FROM f GROUP BY ALL)", False))
def emb_max_pool(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(aggregates.pooled(_rows(spark, folder), ["label"], "embedding", "max", normalize=False))


@query(_pooled_sql("p AS (SELECT label, pos, sum(x * (1 + vec_id % 4) / 4.0) / sum((1 + vec_id % 4) / 4.0) AS v FROM f GROUP BY ALL)"))
def emb_coverage_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Windows weigh as much as they are filled; here, quarters."""
    return _flat(aggregates.pooled(_rows(spark, folder), ["label"], "embedding", weight=(1 + F.col("vec_id") % 4) / 4.0))


@query(
    _pooled_sql(
        """o AS (SELECT *, row_number() OVER (PARTITION BY label, pos ORDER BY vec_id) AS a, row_number() OVER (PARTITION BY label, pos ORDER BY vec_id DESC) - 1 AS b FROM f),
        p AS (SELECT label, pos, sum(x * power(0.7, b) * CASE WHEN a = 1 THEN 1 ELSE 0.3 END) AS v FROM o GROUP BY ALL)"""
    )
)
def emb_ema(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(aggregates.ema(_rows(spark, folder), ["label"], "vec_id", "embedding", 0.3))


def _anchors(spark: SparkSession, folder: str) -> DataFrame:
    """One anchor for each label: a fixed set."""
    return aggregates.pooled(_rows(spark, folder), ["label"], "embedding").select(F.col("label").alias("anchor"), F.col("embedding").alias("centre"))


_ANCHORS = f"""{_FLAT}, m AS (SELECT label, pos, avg(x) AS v FROM f GROUP BY ALL),
a AS (SELECT label AS anchor, pos, v / sqrt(sum(v * v) OVER (PARTITION BY label)) AS v FROM m),
s AS (SELECT f.vec_id, f.label, a.anchor, sum(f.x * a.v) AS score FROM f JOIN a USING (pos) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, anchor) AS rank FROM s)"""


@query(f"WITH {_ANCHORS} SELECT vec_id, rank, anchor, round(score * 18.661177, 3) AS score FROM r WHERE rank <= 3")
def emb_rank_anchors(spark: SparkSession, folder: str) -> DataFrame:
    both = ranking.scored(_rows(spark, folder).select("vec_id", "embedding"), _anchors(spark, folder), "embedding", "centre").select("vec_id", "anchor", "score")
    return ranking.top_k(both, ["vec_id"], "score", "anchor", 3).select("vec_id", "rank", "anchor", F.round(F.col("score") * ranking.LOGIT_SCALE, 3).alias("score"))


@query(f"WITH {_ANCHORS} SELECT label, count(*) AS n, count(*) FILTER (anchor = label) AS own FROM r WHERE rank = 1 GROUP BY label")
def emb_nearest_label(spark: SparkSession, folder: str) -> DataFrame:
    both = ranking.scored(_rows(spark, folder).select("vec_id", "label", "embedding"), _anchors(spark, folder), "embedding", "centre").select("vec_id", "label", "anchor", "score")
    best = both.groupBy("vec_id", "label").agg(F.max_by("anchor", F.struct("score", -F.col("anchor"))).alias("anchor"))
    return best.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("anchor") == F.col("label")).alias("own"))


@query(
    """WITH p AS (SELECT vec_id, embedding AS b, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS a FROM embeddings),
    d AS (SELECT vec_id, list_transform(list_zip(a, b), lambda z: z[1]::DOUBLE - z[2]::DOUBLE) AS d FROM p WHERE a IS NOT NULL)
    SELECT vec_id, list_max(list_transform(d, lambda x: abs(x))) <= 0.3 AS is_close, list_sum(list_transform(d, lambda x: x * x)) / 2 <= 0.9 AS is_near, round(list_max(list_transform(d, lambda x: abs(x))), 4) AS most FROM d"""
)
def emb_is_close(spark: SparkSession, folder: str) -> DataFrame:
    """Each window against the one before it."""
    rows = _rows(spark, folder).withColumn("a", F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).filter("a IS NOT NULL")
    a, b = F.col("a"), F.col("embedding")
    return rows.select("vec_id", vector.is_close(a, b, 0.3).alias("is_close"), vector.is_close_cosine(a, b, 0.9).alias("is_near"), F.round(vector.largest_difference(a, b), 4).alias("most"))


@query(
    f"""WITH {_FLAT}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, pos) AS rank FROM f)
    SELECT vec_id, rank, pos AS class, round(1 / (1 + exp(-x)), 5) AS confidence FROM r WHERE rank <= 5"""
)
def logit_topk_per_row(spark: SparkSession, folder: str) -> DataFrame:
    """A vector as logits: ranked first, the sigmoid only for what is left."""
    best = ranking.top_classes(_rows(spark, folder), ["vec_id"], "embedding", 5)
    return best.select("vec_id", "rank", F.col("class").cast("long").alias("class"), F.round("confidence", 5).alias("confidence"))


@query(
    """WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
    p AS (SELECT q.vec_id AS query, n.vec_id AS key, list_inner_product(q.v, n.v) AS score FROM n q, n WHERE q.vec_id % 50 = 0 AND q.vec_id <> n.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM p)
    SELECT query, rank, key, round(score, 4) AS score FROM r WHERE rank <= 10"""
)
def emb_search(spark: SparkSession, folder: str) -> DataFrame:
    """Every 50th vector as a query against all."""
    rows = _rows(spark, folder)
    return ranking.search(rows.filter("vec_id % 50 = 0"), rows, 10).select("query", "rank", "key", F.round("score", 4).alias("score"))


@query("SELECT vec_id, round(ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))), 5) AS lse, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings")
def emb_log_sum_exp(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.operators import islands

    return _rows(spark, folder).select("vec_id", F.round(signal.log_sum_exp(F.col("embedding")), 5).alias("lse"), islands.argmax(F.col("embedding")).alias("best"))


@query()
def online_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of a label in order, to the nearest centre."""
    rows = _rows(spark, folder).withColumn("seconds", (1 + F.col("vec_id") % 3) / 2)
    return clustering.clustered(rows, ["label"], "vec_id", "embedding", "seconds", join=0.9, move=0.8)


@query()
def dtw_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector as an 8 x 8 matrix."""
    from tidemark.operators import alignment

    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * 8 + 1, F.lit(8)))
    return alignment.paths(_rows(spark, folder).select("vec_id", rows.alias("w")), "vec_id", "w")


@query()
def stub_text_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Long texts by chunks through the stand-in model, averaged by coverage."""
    from tidemark import models

    docs = table(spark, folder, "benchmark")
    return models.embedded_texts(docs, "item_id", "text", models.Stub, budget=16)
