"""Vector search, text search and decayed scores, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring, search
from ..sources.tables import read
from .registry import query

Q = [0.1 * ((i * 7) % 11 - 5) for i in range(64)]
LIST = "[" + ", ".join(f"{x!r}::DOUBLE" for x in Q) + "]"
DISTANCE = {
    "cosine": f"1 - list_cosine_similarity(v, {LIST})", "euclidean": f"list_distance(v, {LIST})", "dot": f"-list_dot_product(v, {LIST})",
    "manhattan": f"list_sum([abs(v[i] - {LIST}[i]) FOR i IN range(1, 65)])",
}


def _knn(metric: str):
    sql = f"SELECT vec_id AS id, round({DISTANCE[metric]}, 5) AS distance FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) ORDER BY {DISTANCE[metric]}, vec_id LIMIT 10"

    @query(f"knn_{metric}", sql)
    def knn(spark, sf_dir):
        return search.knn(read(spark, sf_dir, "embeddings"), "embedding", Q, 10, metric, "vec_id").withColumn("distance", F.round("distance", 5))


for _metric in DISTANCE:
    _knn(_metric)


@query("knn_filtered", f"SELECT vec_id AS id, round({DISTANCE['cosine']}, 5) AS distance FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) WHERE label IN (1, 3) ORDER BY {DISTANCE['cosine']}, vec_id LIMIT 5")
def knn_filtered(spark, sf_dir):
    return search.knn(read(spark, sf_dir, "embeddings"), "embedding", Q, 5, "cosine", "vec_id", "label IN (1, 3)").withColumn("distance", F.round("distance", 5))


@query("vector_join_topk", """SELECT query_id, id, round(d, 5) AS distance FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, id) <= 3""")
def vector_join(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return search.knn_join(e.where("vec_id % 50 = 0"), e, "embedding", 3, "euclidean", "vec_id").withColumn("distance", F.round("distance", 5))


@query("bm25_search", """WITH t AS (SELECT doc_id, [w FOR w IN regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') IF strlen(w) >= 2 AND w NOT IN (""" + ", ".join(f"'{w}'" for w in search.STOP_WORDS) + """)] AS t FROM documents),
    s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t), f AS (SELECT doc_id, len(t) AS l, token, len([w FOR w IN t IF w = token]) AS tf FROM t, (VALUES ('idiot'), ('thation')) q(token)),
    d AS (SELECT token, count(*) AS df FROM f WHERE tf > 0 GROUP BY 1) SELECT doc_id AS id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score
    FROM f JOIN d USING (token), s WHERE tf > 0 GROUP BY 1""")
def bm25(spark, sf_dir):
    return search.bm25(read(spark, sf_dir, "documents"), "text", "idiot thation the", "doc_id").withColumn("score", F.round("score", 6))


@query("hybrid_rrf")
def hybrid(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    return search.hybrid(docs, "text", "embedding", "idiot thation", Q, 10, "doc_id").withColumn("score", F.round("score", 8))


NOW = 1_706_745_600.0  # 2024-02-01
EVENTS = "SELECT user_id AS node, epoch(ts) AS t, event_id, value FROM events"


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("node"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), F.lit(1.0).alias("amount")).select("node", (F.col("us") / 1e6).alias("ts"), "amount")


@query("scar_intensity", f"SELECT node, round(sum(pow(2.0, -({NOW} - t) / 2592000.0)), 6) AS intensity FROM ({EVENTS}) GROUP BY 1")
def scar(spark, sf_dir):
    return scoring.scar(_events(spark, sf_dir), NOW).withColumn("intensity", F.round("intensity", 6))


@query("energy_decay")
def energy(spark, sf_dir):
    return scoring.energy(_events(spark, sf_dir), NOW).withColumn("energy", F.round("energy", 8))


@query("json_props", "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))
