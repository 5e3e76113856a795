"""A living map: newly fetched records against a corpus and its map, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkmesh import schema
from inkmesh.operators import match, units
from inkmesh.plans.staging import stage


def place_records(fresh: DataFrame, unit: str, nodes: DataFrame) -> DataFrame:
    """fresh records and nodes (key, cluster) -> rec_id, cluster, votes: each record goes where most of its units are, ties to the lowest cluster; null where none is on the map."""
    inc = units.incidence(fresh, unit).join(nodes.select("key", "cluster"), "key")
    votes = inc.groupBy("doc", "cluster").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.withColumn("rn", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("votes"), "cluster"))).where("rn = 1")
    return fresh.select("rec_id").join(best.select(F.col("doc").alias("rec_id"), "cluster", "votes"), "rec_id", "left")


def check(fetched: DataFrame, corpus: DataFrame, unit: str, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new records with their cluster, number of new records a cluster; a null cluster holds the unplaced)."""
    new = match.unknown_records(fetched, corpus)
    placed = new.join(place_records(new, unit, nodes), "rec_id")
    return placed, placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("records"))


def follow(spark, folder: str, corpus_path: str, unit: str, nodes: DataFrame, out_path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None):
    """A stream over Parquet files of fetched records: each batch's unknown records join the corpus and are placed.

    Runs on what is there and stops (available now). New records get rec_ids of their own behind all of the corpus's.
    Batch k is decided once and written to out_path/batch=k; the corpus takes those of its rows that it does not hold.
    So a batch that is run again, wherever it broke off, adds each row once.
    """

    def batch(df: DataFrame, number: int) -> None:
        corpus, decided = spark.read.parquet(corpus_path), f"{out_path}/batch={number}"
        try:
            placed = spark.read.parquet(decided)
        except AnalysisException:  # not decided yet
            last = corpus.agg(F.coalesce(F.max("rec_id"), F.lit(-1)).alias("m")).first()["m"]
            moved = stage(df.withColumn("rec_id", (F.monotonically_increasing_id() + F.lit(last + 1)).cast(df.schema["rec_id"].dataType)), "fetched")
            check(moved, corpus, unit, nodes)[0].write.mode("overwrite").parquet(decided)
            placed = spark.read.parquet(decided)
        fresh = placed.join(corpus.select("rec_id"), "rec_id", "left_anti").select(*schema.RECORDS.fieldNames())
        stage(fresh, "fresh").write.mode("append").parquet(corpus_path)
        if then:
            then(placed, number)

    return spark.readStream.schema(schema.RECORDS).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
