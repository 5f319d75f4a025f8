"""Advisory feeds as they arrive, matched with dependencies that are known.

Each batch of documents is matched alone; of what it finds, only rows that are new, or better than what stands for the same
key and advisory id, are appended. What stands is the least row of all batches, and since the least of the batches' least rows is
that of all rows, it equals one match with all documents together, whatever order they come in.

A batch writes folders named by its number, in overwrite mode, and reads those of smaller numbers only: a batch that is run
again after a failure leaves the same rows. Of the rows that stand only those whose key and id the batch has found are read on into the
join, and the advisories' texts are kept once, apart from the keys they were found for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.matching import KEY, Matched, advisory_texts, best_rows, dependency_keys, number_advisories, source_hits, words
from ..session import materialised
from ..sources.advisories import ghsa_advisories, nvd_advisories, osv_advisories
from ..sources.feeds import parsed, split_feed

#: Feed documents on their way: the kind of feed, where the document comes from, and its JSON text.
DOCUMENTS = "kind string, path string, text string"
#: Kinds in order of preference, and what makes advisories of their documents.
KINDS = {"nvd": nvd_advisories, "osv": osv_advisories, "github-advisory": ghsa_advisories}
_BEST = "struct<rank: int, outside: boolean, behind: boolean, patched: string, adv_no: binary>"
_FOUND = f"type string, name string, clean string, id string, best {_BEST}, batch bigint"
_TEXTS = ("`rank` int, adv_no binary, source string, kind string, description string, cvss_score double, severity string, "
          "`references` array<string>, remediation string, batch bigint")
_PROBLEMS = "project string, path string, stage string, reason string, batch bigint"


def arriving_documents(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """A stream over a folder of parquet with the columns of ``DOCUMENTS``."""
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)


def watch_feeds(deps: DataFrame, documents: DataFrame, target: str, checkpoint: str, *, strict_ranges: bool = False) -> StreamingQuery:
    """Match arriving documents with the dependencies until the input is used up; see :func:`standing` for the result.

    A document of an unknown kind, or that can't be read, is a row of problems, see :func:`feed_problems`. The dependencies are those at
    the start: with other ones, start anew.
    """
    keys = materialised(dependency_keys(deps))
    _begin(deps.sparkSession, target)

    def batch(docs: DataFrame, number: int) -> None:
        add_batch(keys, docs, target, number, strict_ranges)

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def add_batch(keys: DataFrame, docs: DataFrame, target: str, number: int, strict_ranges: bool = False) -> None:
    """Match one batch of documents and append what it adds to ``target``; run again, it leaves the same."""
    spark = docs.sparkSession
    hits, texts, problems = [], [], [docs.where("kind is null or kind not in ({})".format(", ".join(f"'{k}'" for k in KINDS))).select(
        F.lit(None).cast("string").alias("project"), "path", F.coalesce("kind", F.lit("")).alias("stage"), F.lit("unknown kind of feed").alias("reason"))]
    for rank, (kind, normalise) in enumerate(KINDS.items()):
        own = docs.where(F.col("kind") == kind).select("path", F.lit(None).cast("int").alias("line"), "text")
        feed = split_feed(parsed(own, kind), kind)
        advisories = number_advisories(normalise(feed.documents))
        if kind == "nvd":
            advisories = advisories.withColumn("words", words(F.col("description")))
        advisories = _kept(advisories, f"{target}/work/{kind}")
        hits.append((rank, source_hits(kind, keys, advisories, strict_ranges)))
        texts.append(advisory_texts(rank, advisories))
        problems.append(feed.problems)
    reduce(DataFrame.unionByName, problems).write.mode("overwrite").parquet(f"{target}/problems/batch={number}")

    found = _kept(best_rows(hits), f"{target}/work/found")
    stands = _table(spark, target, "found", _FOUND).where(F.col("batch") < number)
    stands = stands.join(found.select(*KEY, "id"), [*KEY, "id"], "left_semi").groupBy(*KEY, "id").agg(F.min("best").alias("stood"))
    better = found.join(stands, [*KEY, "id"], "left").where(F.col("stood").isNull() | (F.col("best") < F.col("stood"))).drop("stood")
    better.write.mode("overwrite").parquet(f"{target}/found/batch={number}")

    used = spark.read.schema(_FOUND).parquet(f"{target}/found/batch={number}").select("best.rank", "best.adv_no").distinct()
    told = reduce(DataFrame.unionByName, texts).dropDuplicates(["rank", "adv_no"]).join(used, ["rank", "adv_no"], "left_semi")
    told.write.mode("overwrite").parquet(f"{target}/texts/batch={number}")


def _kept(df: DataFrame, path: str) -> DataFrame:
    """``df`` written in place of what the batch before has left there, as several results of one batch start from it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _begin(spark: SparkSession, target: str) -> None:
    """An empty batch of each table, so that all can be read before any document has come."""
    for name, schema in (("found", _FOUND), ("texts", _TEXTS), ("problems", _PROBLEMS)):
        spark.createDataFrame([], schema).drop("batch").write.mode("overwrite").parquet(f"{target}/{name}/batch=-1")


def _table(spark: SparkSession, target: str, name: str, schema: str) -> DataFrame:
    """All batches of one table."""
    return spark.read.schema(schema).parquet(f"{target}/{name}")


def new_findings(spark: SparkSession, target: str, batch: int) -> DataFrame:
    """KEY, id, rank and adv_no of what one batch has added or bettered."""
    return _table(spark, target, "found", _FOUND).where(F.col("batch") == batch).select(*KEY, "id", "best.rank", "best.adv_no")


def standing(deps: DataFrame, target: str) -> Matched:
    """All that stands after the batches so far, as :func:`sourcesweep.operators.matching.match` gives it."""
    spark = deps.sparkSession
    best = _table(spark, target, "found", _FOUND).groupBy(*KEY, "id").agg(F.min("best").alias("best"))
    texts = _table(spark, target, "texts", _TEXTS).drop("batch").dropDuplicates(["rank", "adv_no"])
    return Matched(deps, best.select(*KEY, "id", "best.rank", "best.adv_no"), texts)


def feed_problems(spark: SparkSession, target: str) -> DataFrame:
    """What could not be read of the documents so far: project (null), path, stage, reason."""
    return _table(spark, target, "problems", _PROBLEMS).drop("batch")
