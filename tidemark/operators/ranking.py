"""Scores against anchors, bounded top-k and vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.functions import signal, vector

#: Fixed value.
LOGIT_SCALE = 18.661177
#: Anchors that are sent to every task, at most.
MOST_ANCHORS = 100_000
#: Queries that are searched at once.
BLOCK = 4096


def top_k(df: DataFrame, by: list[str], score: str, index: str, k: int) -> DataFrame:
    """The k best rows of each group, with `rank`: score down, then index up. k = 0 gives none."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.asc(index))).cast("long")
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_classes(df: DataFrame, by: list[str], logits: str, k: int, as_confidence: bool = True) -> DataFrame:
    """(by, rank, class, confidence): ranked by logit; only what is left is put through the sigmoid."""
    flat = df.select(*by, F.posexplode(F.col(logits).cast("array<double>")).alias("class", "logit"))
    best = top_k(flat, by, "logit", "class", k)
    return best.select(*by, "rank", "class", (signal.sigmoid(F.col("logit")) if as_confidence else F.col("logit")).alias("confidence"))


def scored(vectors: DataFrame, anchors: DataFrame, vector_col: str, anchor_col: str, scale: float | None = None) -> DataFrame:
    """Each vector with each anchor and `score`: their dot product, times the scale if there is one.

    Anchors are a fixed set of labels; more than MOST_ANCHORS are refused, before they are broadcast.
    """
    if anchors.limit(MOST_ANCHORS + 1).count() > MOST_ANCHORS:
        raise ValueError("too many anchors; use search()")
    both = vectors.crossJoin(F.broadcast(anchors))
    score = vector.dot(F.col(vector_col), F.col(anchor_col))
    return both.withColumn("score", score * scale if scale else score)


def search(queries: DataFrame, rows: DataFrame, k: int, key: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query, rank, key, score): the k rows nearest to each query by cosine, exactly, without the query itself.

    Queries go to the tasks in blocks of BLOCK; each task keeps the k best of each of its batches, and those few
    are merged. Ties go to the smaller key. Vectors that are null, zero or of another dimension are left out.
    """
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("key", T.LongType()), T.StructField("score", T.DoubleType())])
    clean = rows.select(F.col(key).alias("key"), vector.normalized(F.col(vector_col)).alias("v")).filter("v IS NOT NULL AND key IS NOT NULL")
    asked = queries.select(F.col(key).alias("key"), vector.normalized(F.col(vector_col)).alias("v")).filter("v IS NOT NULL AND key IS NOT NULL")
    asked = asked.repartitionByRange("key").sortWithinPartitions("key")

    def block_of(part: list) -> DataFrame:
        ids = np.array([r[0] for r in part], dtype=np.int64)
        matrix = np.array([r[1] for r in part], dtype=np.float64)

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(0).to_numpy()
                own = [x for x in range(batch.num_rows) if len(batch.column(1)[x]) == matrix.shape[1]]
                if not own:
                    continue
                keys = keys[own]
                values = np.array([batch.column(1)[x].as_py() for x in own])
                score = matrix @ values.T
                score[ids[:, None] == keys[None, :]] = -np.inf
                best = np.lexsort((np.broadcast_to(keys, score.shape), -score), axis=1)[:, :k]
                q, c = np.repeat(np.arange(len(ids)), best.shape[1]), best.ravel()
                on = np.isfinite(score[q, c])
                yield pa.RecordBatch.from_arrays([pa.array(ids[q[on]]), pa.array(keys[c[on]]), pa.array(score[q[on], c[on]])], schema.names)

        return clean.mapInArrow(found, schema)

    out, part = None, []
    for r in [*asked.toLocalIterator(), None]:
        if r is not None:
            part.append(r)
        if part and (r is None or len(part) == BLOCK):
            got = block_of(part)
            out, part = (got if out is None else out.unionByName(got)), []
    if out is None:
        out = rows.sparkSession.createDataFrame([], schema)
    return top_k(out, ["query"], "score", "key", k).select("query", "rank", "key", "score")


def longest_prefix(rows: DataFrame, table: DataFrame, name: str, prefix: str, order: str, default: dict | None = None) -> DataFrame:
    """rows with the table row whose prefix of the name is longest, the first by `order` of equals; else the default.

    A name's own prefixes are looked up by equality, so no pair of a name and another prefix is made.
    """
    tries = rows.select(name).distinct().withColumn("__p", F.explode(F.transform(F.sequence(F.lit(0), F.length(name)), lambda n: F.substring(F.col(name), F.lit(1), n))))
    hit = tries.join(table.withColumnRenamed(prefix, "__p"), "__p")
    columns = [c for c in table.columns if c != prefix]
    best = F.max_by(F.struct(F.col("__p").alias(prefix), *columns), F.struct(F.length("__p"), -F.col(order)))
    found = hit.groupBy(name).agg(best.alias("__b")).select(name, "__b.*")
    out = rows.join(found, name, "left")
    for c, v in (default or {}).items():
        out = out.withColumn(c, F.when(F.col(prefix).isNull(), F.lit(v)).otherwise(F.col(c)))
    return out


def resolved(rows: DataFrame, table: DataFrame, key: str, value: str, any_key: str = "*", strict: bool = False) -> DataFrame:
    """rows with `value` and `binding`: by the key, else by the any-key, else null ("miss"), or an error if strict."""
    exact = table.filter(F.col(key) != any_key).select(key, F.col(value).alias("__exact"))
    fallback = table.filter(F.col(key) == any_key).agg(F.first(value).alias("__any"))
    out = rows.join(exact, key, "left").crossJoin(F.broadcast(fallback))
    got = F.coalesce("__exact", "__any")
    if strict:
        got = F.when(got.isNull(), F.raise_error(F.concat(F.lit("nothing for "), F.coalesce(F.col(key), F.lit("null"))))).otherwise(got)
    binding = F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__any").isNotNull(), "any").otherwise("miss")
    return out.withColumn(value, got).withColumn("binding", binding).drop("__exact", "__any")


def score_order(score: Column, index: Column) -> list[Column]:
    return [score.desc(), index.asc()]
