"""Exact de-duplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row a digest, sort-merge
anti-joined with the index (whose side needs no shuffle), and what is new is appended in the same bucketing.

Defined results:
* null text counts as the empty text; empty texts are equal to each other and de-duplicated like any other;
* texts of any length are digested whole (SHA-256 of the text with A-Z lower-cased, in UTF-8);
* of equal texts the row with the largest doc_id stays; null ids rank below all others; rows that repeat both doc_id and
  text give as many result rows, of which one can be kept;
* an empty table gives an empty result; other columns, whatever their names, are never looked at.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A digest that holds more than this share of a batch is joined by broadcast: there can be no more than 1 / HOT_SHARE.
HOT_SHARE = 1 / 1024


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(common.ascii_lower(F.coalesce(text, F.lit(""))), 256))


class DigestIndex:
    """The digests of all texts seen so far, with the id that stays for each and the batch that brought it.

    The folder says itself how it is bucketed, in a file that Spark's readers pass over; a session that opens it later takes
    the number from there, whatever its own settings. A folder that holds data but no such file is refused."""

    ABOUT = "_digest_index"

    def __init__(self, spark: SparkSession, path: str, buckets: int, id_type: str = "bigint") -> None:
        self.spark = spark
        self.buckets, own_type = self._described(path, buckets, id_type)
        if own_type != id_type:
            raise ValueError(f"the index at {path} holds ids of type {own_type}, not {id_type}")
        self.table = "digest_index_" + hashlib.md5(path.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id {id_type}, group_size BIGINT, batch STRING) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )
        listed = spark.sql(f"DESCRIBE EXTENDED {self.table}").where("col_name = 'Num Buckets'").first()
        if int(listed["data_type"]) != self.buckets:
            raise ValueError(f"the catalog has {self.table} with {listed['data_type']} buckets, the index at {path} has {self.buckets}")
        spark.catalog.refreshTable(self.table)  # another session may have appended

    def _described(self, path: str, buckets: int, id_type: str) -> tuple[int, str]:
        """Bucket count and id type of the index at path; a new one is given those that are asked for."""
        files, folder = common.hadoop_path(self.spark.sparkContext, path)
        _, about = common.hadoop_path(self.spark.sparkContext, f"{path}/{self.ABOUT}")
        if files.exists(about):
            stream = files.open(about)
            found = json.loads(bytes(stream.readAllBytes()))
            stream.close()
            return found["buckets"], found["id_type"]
        if files.exists(folder) and len(files.listStatus(folder)):
            raise ValueError(f"{path} holds data but no description of its buckets")
        out = files.create(about, False)
        out.write(json.dumps({"buckets": buckets, "id_type": id_type}).encode())
        out.close()
        return buckets, id_type

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append_new(self, groups: DataFrame, batch: str) -> None:
        """Append what the index lacks of groups(digest, keep_id, group_size)."""
        new = groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        new.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch")).write.insertInto(self.table)

    def dedup(self, docs: DataFrame, batch: str) -> DataFrame:
        """One row for each of docs: doc_id, keep_id, group_size (rows of the batch that brought the text), kept, digest.

        A text that an earlier batch brought is never kept; a batch can be given again, under its own name, after a
        failure."""
        rows = docs.select("doc_id", digest_of(F.col("text")).alias("digest")).groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("repeats"))
        rows = common.materialise(rows, "exact-rows")
        groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("repeats").alias("group_size"))
        groups = common.materialise(groups, "exact-groups")  # else the anti-join moves below the aggregate, to all rows
        self.append_new(groups, batch)
        index = self.read()
        known = index.select("digest", "keep_id", "group_size", (F.col("batch") == batch).alias("own"))
        total = rows.agg(F.coalesce(F.sum("repeats"), F.lit(0)).alias("n")).first()["n"]
        hot = known.where(F.col("group_size") > max(1.0, total * HOT_SHARE)).select("digest", *(F.col(c).alias(f"hot_{c}") for c in ("keep_id", "group_size", "own")))
        marked = rows.join(F.broadcast(hot), "digest", "left")
        few = marked.where(F.col("hot_own").isNull()).select("doc_id", "digest", "repeats").join(known.hint("merge"), "digest")
        many = marked.where(F.col("hot_own").isNotNull()).select("digest", "doc_id", "repeats", *(F.col(f"hot_{c}").alias(c) for c in ("keep_id", "group_size", "own")))
        return (
            few.unionByName(many)
            .withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
            .select("doc_id", "keep_id", "group_size", (F.col("own") & (F.col("nth") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "digest")
        )


def dedup_exact(docs: DataFrame, index_path: str | None = None, batch: str = "first") -> DataFrame:
    """Verdicts for docs(doc_id, text) against the index at index_path, or against a new one."""
    spark = docs.sparkSession
    path = index_path or common.scratch_path(spark, "exact-index")
    index = DigestIndex(spark, path, common.shuffle_partitions(spark), dict(docs.dtypes)["doc_id"])
    if index_path is None:
        common.scratch_table(index.table)
    return index.dedup(docs, batch)


def drop_exact(docs: DataFrame, index_path: str | None = None, batch: str = "first") -> DataFrame:
    """The rows of docs that dedup_exact keeps, with all their columns."""
    verdicts = dedup_exact(docs, index_path, batch).withColumnRenamed("digest", "key")
    per_pair = verdicts.groupBy("doc_id", "key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("repeats"))
    return common.keep_one(docs, common.materialise(per_pair, "exact-verdicts"), digest_of(F.col("text")))
