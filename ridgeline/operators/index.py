"""A stored inverted index: postings on disk, dealt by token, searched by reading
only the tokens asked for, and kept up to date without being built anew.

A folder holds generations g0, g1 and so on. A generation has ``postings``
(key, token, tf, positions, length), partitioned by a hash of the token, and
``documents`` (key, length), and with it the figures of the collection. An
update writes the next generation for the keys that changed only; a posting
counts if no later generation has its key, so an update costs as much as what
changed. Compaction is a build from the live postings.

Defined cases: a key without words has a row in ``documents`` with length 0, so
that an update can empty it; a search for no known word finds nothing; a key
that stands twice in one update keeps all of its words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators.search import bm25, postings, query_terms, tokens

PARTS = 64


def _part(token):
    return F.pmod(F.xxhash64(token), F.lit(PARTS)).cast("int")


def _write(bodies: DataFrame, folder: str, generation: int, key: str) -> None:
    rows = postings(bodies, key).withColumn("part", _part(F.col("token")))
    # dealt by token and key, so that a frequent token is no single task; each file holds one part, sorted
    rows.repartition("part", F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions("part", "token").write.partitionBy("part").parquet(f"{folder}/g{generation}/postings")
    sizes = bodies.select(key, F.size(tokens(F.col("body"))).alias("length"))
    sizes.groupBy(key).agg(F.max("length").alias("length")).write.parquet(f"{folder}/g{generation}/documents")


def _generations(spark: SparkSession, folder: str) -> int:
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    n = 0
    while fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/g{n}/documents/_SUCCESS")):
        n += 1
    return n


def build(bodies: DataFrame, folder: str, key: str = "record_id") -> None:
    """The first generation, of bodies (key, body)."""
    _write(bodies, folder, 0, key)


def update(bodies: DataFrame, folder: str, spark: SparkSession, key: str = "record_id") -> None:
    """A further generation, of the keys whose body is new or has changed."""
    _write(bodies, folder, _generations(spark, folder), key)


def _live(spark: SparkSession, folder: str, what: str, key: str, keep=None) -> DataFrame:
    """Rows of all generations of which no later one has the key."""
    n = _generations(spark, folder)
    parts = []
    for g in range(n):
        rows = spark.read.parquet(f"{folder}/g{g}/{what}")
        rows = rows if keep is None else rows.filter(keep)
        for later in range(g + 1, n):
            rows = rows.join(spark.read.parquet(f"{folder}/g{later}/documents").select(key), key, "left_anti")
        parts.append(rows)
    return reduce(DataFrame.unionByName, parts)


def search_terms(spark: SparkSession, folder: str, terms: list[str], key: str = "record_id") -> DataFrame:
    """Live postings of ``terms``: only their parts are read."""
    parts = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(_part(F.col("t"))).collect()]
    return _live(spark, folder, "postings", key, F.col("part").isin(parts) & F.col("token").isin(terms))


def search(spark: SparkSession, folder: str, text: str, key: str = "record_id") -> DataFrame:
    """key, score of the documents that hold all words of ``text``."""
    terms = sorted({w for t in query_terms(text) for w in t})
    sizes = _live(spark, folder, "documents", key).filter("length > 0").agg(F.count("*"), F.avg("length")).first()
    return bm25(search_terms(spark, folder, terms, key), terms, sizes[0], sizes[1] or 1.0, key)
