"""Nearest neighbours, BM25 and hybrid ranking. All distances are lower for closer vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "cosine": lambda a, b: 1 - S.cosine_similarity(a, b),
    "euclidean": S.euclidean,
    "dot": lambda a, b: -S.dot(a, b),
    "manhattan": S.manhattan,
}
#: English stop words that are not indexed.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "do", "for", "from", "had", "has", "have", "he", "her", "his", "how", "i", "if", "in", "into", "is",
    "it", "its", "just", "me", "my", "no", "nor", "not", "of", "on", "or", "our", "out", "own", "she", "so", "some", "such", "than", "that", "the", "their", "them", "then",
    "there", "these", "they", "this", "to", "too", "up", "us", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with",
    "would", "you", "your",
]
#: Rows of a query side that may be broadcast.
BROADCAST_QUERIES = 10_000
#: Forms of a filter on a property: {"size": 3} or {"size": {"$gt": 3, "$lt": 9}}.
FILTERS: dict[str, Callable[[Column, object], Column]] = {
    "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$ne": lambda c, v: c.isNull() | (c != v),
    "$in": lambda c, v: c.isin(*v), "$nin": lambda c, v: c.isNull() | ~c.isin(*v), "$contains": lambda c, v: c.contains(v),
}


def filtered(df: DataFrame, where: str | dict | None) -> DataFrame:
    """Rows that satisfy a SQL condition, or all filters of a dict."""
    if not isinstance(where, dict):
        return df.where(where) if where else df
    for key, test in where.items():
        for op, value in test.items() if isinstance(test, dict) else [("=", test)]:
            df = df.where(F.col(key) == value if op == "=" else FILTERS[op](F.col(key), value))
    return df


def knn(df: DataFrame, vector: str, query: list[float], k: int, metric: str = "cosine", id_: str = "id", where: str | dict | None = None) -> DataFrame:
    """(id, distance) of the k nearest rows, ids on ties; `where` is applied before. Exact: one scan and a top-k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = filtered(df, where)
    return rows.where(F.col(vector).isNotNull()).select(F.col(id_).alias("id"), METRICS[metric](F.col(vector), q).alias("distance")).orderBy("distance", "id").limit(k)


def knn_join(left: DataFrame, right: DataFrame, vector: str, k: int, metric: str = "cosine", id_: str = "id", where: str | dict | None = None) -> DataFrame:
    """(query_id, id, distance): k nearest rows of right for each row of a stated set of queries.

    The queries go to the rows, at most BROADCAST_QUERIES at a time; each task keeps k rows of a query before anything is shuffled, so what is shuffled is bounded by tasks * queries * k.
    """
    spark = left.sparkSession
    q = left.select(F.col(id_).alias("query_id"), F.col(vector).alias("_q"))
    n = q.count()
    blocks = -(-n // BROADCAST_QUERIES)
    rows = filtered(right, where).where(F.col(vector).isNotNull()).select(F.col(id_).alias("id"), F.col(vector).alias("_v"))
    out = None
    for b in range(max(blocks, 1)):
        own = q if blocks <= 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        pairs = rows.join(F.broadcast(own), F.col("id") != F.col("query_id"))
        near = pairs.select("query_id", "id", METRICS[metric](F.col("_v"), F.col("_q")).alias("distance"), F.spark_partition_id().alias("_task"))
        part = nearest(nearest(near, ["query_id", "_task"], k).drop("_task"), ["query_id"], k)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "query_id long, id long, distance double")


def nearest(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k rows of each group with the least distance, ids on ties. The rank limit lets Spark cut each task's rows before the shuffle."""
    w = Window.partitionBy(*by).orderBy("distance", "id")
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def mmr(df: DataFrame, vector: str, query: list[float], k: int, fetch: int = 50, trade: float = 0.5, metric: str = "cosine", id_: str = "id", where: str | dict | None = None) -> DataFrame:
    """(rank, id, distance): k of the `fetch` nearest rows, each the one with the best trade * similarity to the query - (1 - trade) * similarity to what was taken before.

    Similarity is 1 - distance for cosine, 1 / (1 + distance) for euclidean and manhattan, - distance for dot. Only the `fetch` rows come to the driver.
    """
    import numpy as np

    near = knn(df, vector, query, fetch, metric, id_, where)
    rows = near.join(df.select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("v")), "id").orderBy("distance", "id").limit(fetch).collect()
    like = {"cosine": lambda d: 1 - d, "dot": lambda d: -d}.get(metric, lambda d: 1 / (1 + d))
    between = {
        "cosine": lambda a, b: 1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b) or 1.0), "dot": lambda a, b: -(a @ b),
        "euclidean": lambda a, b: float(np.linalg.norm(a - b)), "manhattan": lambda a, b: float(np.abs(a - b).sum()),
    }[metric]
    vectors, taken = [np.array(r.v) for r in rows], []
    while len(taken) < min(k, len(rows)):
        def worth(i: int) -> float:
            close = max((like(between(vectors[i], vectors[j])) for j in taken), default=0.0)
            return trade * like(rows[i].distance) - (1 - trade) * close

        taken.append(max((i for i in range(len(rows)) if i not in taken), key=lambda i: (round(worth(i), 12), -i)))
    return df.sparkSession.createDataFrame([(n + 1, rows[i].id, rows[i].distance) for n, i in enumerate(taken)], "rank long, id long, distance double")


def scalar_quantized(df: DataFrame, vector: str) -> tuple[DataFrame, DataFrame]:
    """df with `code`, one byte for each dimension, and the ranges (dim, low, high) that the codes stand for: one aggregate row for each dimension."""
    ranges = df.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.min("x").cast("double").alias("low"), F.max("x").cast("double").alias("high"))
    packed = ranges.agg(F.sort_array(F.collect_list(F.struct("dim", "low", "high"))).alias("_r"))
    step = lambda x, r: F.when(r.high > r.low, F.round((x.cast("double") - r.low) / (r.high - r.low) * 255) - 128).otherwise(0).cast("tinyint")
    return df.crossJoin(F.broadcast(packed)).withColumn("code", F.zip_with(vector, "_r", step)).drop("_r"), ranges


def scalar_restored(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """df with `restored`, the vector that a code of scalar_quantized stands for."""
    packed = ranges.agg(F.sort_array(F.collect_list(F.struct("dim", "low", "high"))).alias("_r"))
    value = lambda c, r: r.low + (c.cast("double") + 128) / 255 * (r.high - r.low)
    return df.crossJoin(F.broadcast(packed)).withColumn("restored", F.zip_with("code", "_r", value)).drop("_r")


def binary_quantized(df: DataFrame, vector: str) -> DataFrame:
    """df with `bits`: one bit for each dimension, set where it is positive, in words of 32."""
    n = F.size(vector)
    word = lambda w: F.aggregate(F.slice(F.col(vector), w * 32 + 1, F.lit(32)), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1) + F.when(x > 0, 1).otherwise(0))
    return df.withColumn("bits", F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 32).cast("int")), word))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def knn_binary(df: DataFrame, vector: str, query: list[float], k: int, fetch: int, metric: str = "cosine", id_: str = "id") -> DataFrame:
    """(id, distance): the `fetch` rows with the fewest different bits, ordered anew by their true distance. Approximate, as bits are."""
    spark = df.sparkSession
    q = binary_quantized(spark.range(1).select(F.array(*[F.lit(float(x)) for x in query]).alias("v")), "v").select(F.col("bits").alias("_q"))
    near = binary_quantized(df.where(F.col(vector).isNotNull()), vector).crossJoin(F.broadcast(q)).withColumn("_h", hamming(F.col("bits"), F.col("_q")))
    return knn(near.orderBy("_h", id_).limit(fetch), vector, query, k, metric, id_)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of two bytes at least, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return F.filter(words, lambda w: (F.octet_length(w) >= 2) & ~w.isin(*STOP_WORDS))


def bm25(df: DataFrame, text: str, query: str, id_: str = "id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of rows with a query token; a token repeated in the query counts again."""
    spark = df.sparkSession
    rows = df.select(F.col(id_).alias("id"), tokens(F.col(text)).alias("t")).withColumn("len", F.size("t"))
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    asked = spark.range(1).select(F.explode(tokens(F.lit(query))).alias("token")).groupBy("token").agg(F.count("*").alias("times"))
    # Only the query's tokens leave the scan: a row of counts for each text, one for each of them.
    words = [r.token for r in asked.select("token").collect()]
    times_of = lambda w: F.size(F.filter("t", lambda x: x == F.lit(w))).cast("long")
    hits = F.array(*[F.struct(F.lit(w).alias("token"), times_of(w).alias("tf")) for w in words])
    if not words:
        return rows.select("id", F.lit(0.0).alias("score")).limit(0)
    tf = rows.select("id", "len", F.explode(F.filter(hits, lambda h: h.tf > 0)).alias("h")).select("id", "len", "h.token", "h.tf").join(F.broadcast(asked), "token")
    df_ = tf.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("times") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return tf.join(df_, "token").crossJoin(F.broadcast(stats)).groupBy("id").agg(F.sum(part).alias("score"))


def reciprocal_rank_fusion(*ranked: DataFrame, k: int = 60) -> DataFrame:
    """(id, score): sum over the lists (id, rank) of 1 / (k + rank)."""
    parts = [r.select("id", (1 / (k + F.col("rank"))).alias("part")) for r in ranked]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.sum("part").alias("score"))


def weighted_fusion(scored: list[DataFrame], weights: list[float]) -> DataFrame:
    """(id, score): scores (id, score; higher is better) of each list scaled to 0 to 1, weighted and added up; a row that a list lacks gets 0 from it. If all scores of a
    list are equal, they count as 1."""
    out = None
    for df, w in zip(scored, weights, strict=True):
        edge = df.agg(F.min("score").alias("low"), F.max("score").alias("high"))
        unit = F.when(F.col("high") > F.col("low"), (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(1.0)
        part = df.crossJoin(F.broadcast(edge)).select("id", (w * unit).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id").agg(F.sum("part").alias("score"))


def hybrid_weighted(df: DataFrame, text: str, vector: str, query: str, query_vector: list[float], k: int, weights: tuple[float, float] = (0.5, 0.5), id_: str = "id") -> DataFrame:
    """Weighted sum of BM25 and cosine similarity; each list gives 2 k rows."""
    words = top_ranked(bm25(df, text, query, id_), "score", 2 * k, descending=True).select("id", "score")
    near = knn(df, vector, query_vector, 2 * k, "cosine", id_).select("id", (1 - F.col("distance")).alias("score"))
    return weighted_fusion([words, near], list(weights)).orderBy(F.col("score").desc(), "id").limit(k)


def top_ranked(df: DataFrame, by: str, n: int, descending: bool = False) -> DataFrame:
    order = [F.col(by).desc() if descending else F.col(by), F.col("id")]
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hybrid(df: DataFrame, text: str, vector: str, query: str, query_vector: list[float], k: int, id_: str = "id") -> DataFrame:
    """RRF of BM25 and cosine distance; each list gives 2 k rows."""
    words = top_ranked(bm25(df, text, query, id_), "score", 2 * k, descending=True)
    near = top_ranked(knn(df, vector, query_vector, 2 * k, "cosine", id_), "distance", 2 * k)
    return reciprocal_rank_fusion(words, near).orderBy(F.col("score").desc(), "id").limit(k)
