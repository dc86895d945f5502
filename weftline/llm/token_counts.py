"""Token totals by source, language and tokenizer version, kept up by signed deltas.

A ``Rollup`` is a folder of committed batches.  A batch of changes (inserts, deletes,
revised counts) is turned into signed rows and added up by key before it is written, so
a batch is as small as its keys; totals are the sum over committed batches.  A batch is
written under a name of its own and committed by renaming its folder to its id, which
fails where that id is there: of two writers one wins, a batch that died half-way never
counts, and committing an id again does nothing.  So one listing gives the committed
batches.

``compact`` lists once, folds exactly the batches it saw into a new generation (totals, and
a ledger of all ids folded so far) and commits that by a rename as well.  A batch whose id
is in the ledger never counts by itself, so one that is committed meanwhile, or comes back
after it was folded, is neither lost nor counted twice.  Folders of folded batches and of
old generations are deleted by the compaction after, when no reader should be left; a reader that
is slower than that fails with an error and never sums a part.

Changes have the columns op ('insert', 'delete' or 'revise'), source, lang, tokenizer,
n_tokens (for a delete, the count to take away), and for revise old_tokens; a revise that
moves a document to another key is a delete and an insert.

Defined results: null source, lang or tokenizer are keys of their own; null and empty
texts count as documents without tokens; null counts are 0; unknown ops are an error;
repeated rows in a batch count as often as they occur; keys whose documents and tokens
are both 0 are left out of the totals; an empty batch is committed and changes nothing;
other columns are ignored.
"""

from __future__ import annotations

import urllib.parse
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, picked, remove, written
from .tokens import TOKENIZER, token_counts, version

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


def signed(changes: DataFrame) -> DataFrame:
    """Changes as signed rows, added up by key."""
    new = F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0))
    old = F.coalesce(F.col("old_tokens").cast("bigint"), F.lit(0)) if "old_tokens" in changes.columns else F.lit(0)
    known = F.when(F.col("op") == "insert", F.struct(F.lit(1).alias("d"), new.alias("t"))).when(F.col("op") == "delete", F.struct(F.lit(-1).alias("d"), (-new).alias("t"))).when(F.col("op") == "revise", F.struct(F.lit(0).alias("d"), (new - old).alias("t")))
    known = F.coalesce(known, F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))).cast("struct<d:int,t:bigint>"))
    rows = changes.select(*[F.col(k).cast("string").alias(k) for k in KEYS], known.alias("s"))
    return rows.groupBy(*KEYS).agg(F.sum("s.d").alias("n_docs"), F.sum("s.t").alias("n_tokens"))


class Rollup:
    """Totals in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "rollup")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _names(self, folder: str) -> list[str]:
        p = self._path(folder)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _exists(self, *parts: str) -> bool:
        p = self._path(*parts)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _placed(self, attempt: str, *target: str) -> bool:
        """Rename an attempt to its final name; False if that is taken, and the attempt goes."""
        p, to = self._path("attempts", attempt), self._path(*target)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(to.getParent())
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration()).rename(p, to, none)
        except Py4JJavaError as e:
            fs.delete(p, True)
            if not fs.exists(to):
                raise e
            return False
        return True

    def _generation(self) -> int:
        return max(map(int, self._names("generations")), default=0)

    def _ledger(self, generation: int) -> DataFrame:
        """(batch, generation): the names of the batches folded so far, and when they were."""
        schema = "batch string, generation int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/generations/{generation}/ledger") if generation else self.spark.createDataFrame([], schema)

    def _loose(self, generation: int) -> list[str]:
        """Batches that are there and in no ledger."""
        names = self._names("batches")
        folded = {r[0] for r in self._ledger(generation).where(F.col("batch").isin(names)).select("batch").collect()} if names and generation else set()
        return [n for n in names if n not in folded]

    def has(self, batch: str) -> bool:
        """Whether the batch is committed."""
        name = urllib.parse.quote(batch, safe="")
        return self._exists("batches", name) or not self._ledger(self._generation()).where(F.col("batch") == name).isEmpty()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it had been applied."""
        if self.has(batch):
            return False
        attempt = uuid.uuid4().hex
        signed(changes).write.parquet(f"{self.path}/attempts/{attempt}")
        return self._placed(attempt, "batches", urllib.parse.quote(batch, safe=""))

    def _rows(self, generation: int, names: list[str]) -> DataFrame:
        paths = [f"{self.path}/batches/{n}" for n in names]
        if generation:
            paths.append(f"{self.path}/generations/{generation}/totals")
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def _sums(self, generation: int, names: list[str]) -> DataFrame:
        sums = self._rows(generation, names).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens."""
        # the generation first: a batch that is folded after it was read is still there to be listed
        last = self._generation()
        return self._sums(last, self._loose(last))

    def compact(self) -> bool:
        """Fold the batches that are there now into a new generation; False if another compaction was faster."""
        last = self._generation()
        names = self._loose(last)
        attempt = uuid.uuid4().hex
        target = f"{self.path}/attempts/{attempt}"
        self._sums(last, names).coalesce(1).write.parquet(f"{target}/totals")
        new = self.spark.createDataFrame([(n, last + 1) for n in names], "batch string, generation int")
        self._ledger(last).unionByName(new).write.parquet(f"{target}/ledger")
        if not self._placed(attempt, "generations", str(last + 1)):
            return False
        there = self._names("batches")
        old = {r[0] for r in self._ledger(last + 1).where(F.col("batch").isin(there) & (F.col("generation") <= last)).select("batch").collect()} if there else set()
        for parts in [("batches", n) for n in old] + [("generations", n) for n in self._names("generations") if int(n) < last]:
            remove(self.spark, "/".join((self.path, *parts)))
        return True


def rollup(docs: DataFrame, tokenizer: str = TOKENIZER, path: str | None = None) -> DataFrame:
    """Totals over ``docs``: inserted with estimated counts, revised to exact ones, the revision committed twice.

    The estimate (a token for every four characters) is there at once from n_chars;
    exact counts replace it when the tokenizer has run.
    """
    spark = docs.sparkSession
    store = Rollup(spark, path)
    # the files' count is settled once: estimate and exact count come from the same rows
    slim = picked(docs, "source", "lang", "text").select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.ceil(F.coalesce(F.length("text"), F.lit(0)) / 4).alias("estimate"), "text")
    counts = written(token_counts(slim, ["source", "lang", "estimate"], tokenizer), "token-counts").withColumn("tokenizer", F.lit(version(tokenizer)))
    store.commit("load", counts.select(F.lit("insert").alias("op"), *KEYS, F.col("estimate").alias("n_tokens")))
    exact = counts.select(F.lit("revise").alias("op"), *KEYS, "n_tokens", F.col("estimate").alias("old_tokens"))
    store.commit("exact", exact)
    store.commit("exact", exact)
    return store.totals()
