"""How often every term occurs and in how many records, kept by signed deltas.

A store is a folder of the shared file system. It holds the deliveries of tokens in buckets of
sentences, the counts of (record, term) as a log of signed deltas in buckets of records, and the counts
of terms in buckets of terms; a manifest names what is valid, so that another process can open the
store. A batch reads only the tokens and records it touches, in the buckets it touches: each token
that was added, changed or deleted takes its old terms away from its old record and gives its new
ones to its new record, and whether a (record, term) falls to or rises from zero gives the change in
records. Only buckets of terms that change are written again.

Defined cases: as in operators.annotated for missing keys, repeated deliveries and missing terms;
a delivery older than what is stored changes nothing; a row with `deleted` set takes its token away,
whatever its other columns say; a token that moves to another record counts there only; a record
without terms counts among the records as long as it has a token; a term whose counts fall to zero
disappears; an empty batch changes nothing; an empty store has no terms; very long terms are terms.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswerk.operators.annotated import BLANKS, unique_tokens
from corpuswerk.plans.storage import drop_path, fresh_path

TOKENS = "sid bigint, ix int, load_ts timestamp, id_article bigint, base string, bucket int"
BAGS = "id_article bigint, term string, d bigint, bucket int"
COUNTS = "term string, n_tokens bigint, n_articles bigint, bucket int"
#: A bucket is to hold about so many tokens of the first batch.
BUCKET_TOKENS = 2_000_000
#: Stands for the record itself among its terms.
RECORD = "\u0000"


def base(lemma: str = "lemma", word: str = "word") -> Column:
    """What a token's terms are split from: `=` and the word, which is one term, or `+` and the lemma."""
    own = F.btrim(F.lower(lemma), F.lit(BLANKS))
    return F.when(own.isNotNull() & ~own.isin("", "<unknown>"), F.concat(F.lit("+"), own)).otherwise(F.concat(F.lit("="), F.lower(word)))


def terms_of(base_col: str) -> Column:
    """Distinct terms of a base."""
    c = F.col(base_col)
    value = F.substring(c, 2, 1 << 30)
    several = F.startswith(c, F.lit("+")) & F.contains(c, F.lit("|"))
    return F.when(several, F.array_distinct(F.filter(F.split(value, r"\|"), lambda x: x != ""))).when(value != "", F.array(value))


def _bucket(n: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


@dataclass
class TermStore:
    """Counts of the terms of one corpus. TermStore(spark, path) opens what is there, or begins anew."""

    spark: SparkSession
    path: str = ""
    buckets: int = 0
    version: int = 0
    n_articles: int = 0
    tokens: list[str] = field(default_factory=list)
    bags: list[str] = field(default_factory=list)
    counts_at: dict[int, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.path = self.path or fresh_path(self.spark, "terms")
        known = self._manifests()
        if known:
            state = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest-{max(known)}").collect()))
            self.buckets, self.version, self.n_articles, self.tokens, self.bags = (state[k] for k in ("buckets", "version", "n_articles", "tokens", "bags"))
            self.counts_at = {int(k): v for k, v in state["counts_at"].items()}

    def _fs(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        at, fs = self._fs()
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        Path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return [int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-") and fs.exists(Path(f"{self.path}/{n}/_SUCCESS"))]

    def _commit(self) -> None:
        state = {k: getattr(self, k) for k in ("buckets", "version", "n_articles", "tokens", "bags", "counts_at")}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{self.version}")

    def _write(self, df: DataFrame, label: str, schema: str) -> tuple[str, DataFrame]:
        at = f"{self.path}/{label}-{self.version}"
        df.write.mode("overwrite").partitionBy("bucket").parquet(at)  # what a failed batch of this version left goes
        return at, self.spark.read.schema(schema).parquet(at)

    def _read(self, paths: list[str], schema: str, touched: DataFrame) -> DataFrame:
        """Rows of the buckets that occur in touched; as many names as there are buckets at most."""
        wanted = [r[0] for r in touched.select("bucket").distinct().collect()]
        parts = None
        for at in paths:
            own = self.spark.read.schema(schema).parquet(at)
            parts = own if parts is None else parts.unionByName(own)
        return parts if len(wanted) == self.buckets else parts.filter(F.col("bucket").isin(wanted))

    def apply(self, batch: DataFrame) -> None:
        """Take in token rows (sid, ix, load_ts, id_article, lemma, word and, if wanted, deleted)."""
        deleted = F.coalesce("deleted", F.lit(False)) if "deleted" in batch.columns else F.lit(False)
        rows = batch.select("sid", "ix", "load_ts", F.when(~deleted, F.col("id_article")).alias("id_article"), F.when(~deleted, base()).alias("base"))
        self.buckets = self.buckets or max(16, -(-rows.count() // BUCKET_TOKENS))
        self.version += 1
        fresh = unique_tokens(rows, "load_ts", "id_article", "base").withColumn("bucket", _bucket(self.buckets, "sid"))
        at, fresh = self._write(fresh, "tokens", TOKENS)
        after = fresh.select("id_article", "base", F.lit(1).cast("bigint").alias("d"))
        if self.tokens:
            after = self._changes(fresh)
        after = after.filter("id_article is not null")
        each = after.select("id_article", "d", F.explode(terms_of("base")).alias("term"))
        each = each.unionByName(after.groupBy("id_article").agg(F.sum("d").alias("d")).withColumn("term", F.lit(RECORD)))
        changed = each.groupBy("id_article", "term").agg(F.sum("d").alias("d")).filter("d <> 0").withColumn("bucket", _bucket(self.buckets, "id_article"))
        bags_at, changed = self._write(changed, "bags", BAGS)
        self._merge(self._steps(changed))
        self.tokens.append(at)
        self.bags.append(bags_at)
        self._commit()

    def _changes(self, fresh: DataFrame) -> DataFrame:
        """(id_article, base, d): what the tokens of a batch held before, taken away, and what they hold now."""
        keys = ["bucket", "sid", "ix"]
        before = self._read(self.tokens, TOKENS, fresh).join(fresh.select(*keys), keys, "left_semi")
        value = F.struct("load_ts", "id_article", "base")
        both = before.select(*keys, value.alias("v"), F.lit(True).alias("old")).unionByName(fresh.select(*keys, value.alias("v"), F.lit(False).alias("old")))
        states = both.groupBy(*keys).agg(F.max(F.when(F.col("old"), F.col("v"))).alias("was"), F.max("v").alias("now")).filter("was is null or was <> now")
        took, gave = (F.struct(F.col(f"{c}.id_article").alias("id_article"), F.col(f"{c}.base").alias("base"), F.lit(d).cast("bigint").alias("d")) for c, d in (("was", -1), ("now", 1)))
        return states.select(F.explode(F.array(took, gave)).alias("s")).select("s.*")

    def _steps(self, changed: DataFrame) -> DataFrame:
        """(term, n_tokens, n_articles) to be added to the counts."""
        if not self.bags:
            return changed.groupBy("term").agg(F.sum("d").alias("n_tokens"), F.count("*").alias("n_articles"))
        keys = ["bucket", "id_article", "term"]
        held = self._read(self.bags, BAGS, changed).join(changed.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.sum("d").alias("n"))
        both = changed.join(held, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
        step = (F.col("n") + F.col("d") > 0).cast("bigint") - (F.col("n") > 0).cast("bigint")
        return both.groupBy("term").agg(F.sum("d").alias("n_tokens"), F.sum(step).alias("n_articles"))

    def _merge(self, deltas: DataFrame) -> None:
        deltas_at = f"{self.path}/deltas-{self.version}"
        deltas.withColumn("bucket", _bucket(self.buckets, "term")).write.mode("overwrite").partitionBy("bucket").parquet(deltas_at)
        changes = self.spark.read.schema(COUNTS).parquet(deltas_at)
        records = changes.filter(F.col("term") == RECORD).agg(F.coalesce(F.sum("n_articles"), F.lit(0))).first()[0]
        touched = [r[0] for r in changes.select("bucket").distinct().collect()]  # at most as many as there are buckets
        known = sorted({self.counts_at[b] for b in touched if b in self.counts_at})
        if known:
            old = None
            for at in known:  # a bucket is read from the folder that holds its valid counts
                own = [b for b in touched if self.counts_at.get(b) == at]
                part = self.spark.read.schema(COUNTS).parquet(at).filter(F.col("bucket").isin(own))
                old = part if old is None else old.unionByName(part)
            changes = old.unionByName(changes).groupBy("bucket", "term").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_articles").alias("n_articles"))
        at = f"{self.path}/counts-{self.version}"
        changes.filter((F.col("n_tokens") > 0) & (F.col("term") != RECORD)).select("term", "n_tokens", "n_articles", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        self.counts_at = self.counts_at | dict.fromkeys(touched, at)
        self.n_articles += records
        drop_path(self.spark, deltas_at)

    def counts(self) -> DataFrame:
        """(term, n_tokens, n_articles) as they stand."""
        out = self.spark.createDataFrame([], COUNTS)
        for at in sorted(set(self.counts_at.values())):
            own = [b for b, where in self.counts_at.items() if where == at]
            part = self.spark.read.schema(COUNTS).parquet(at)
            out = out.unionByName(part.filter(F.col("bucket").isin(own)) if len(own) < self.buckets else part)
        return out.drop("bucket")

    def marked(self, rare_up_to: int = 2, common_percent: int = 25) -> DataFrame:
        """counts() with mark `rare`, `common` or null; rare goes before common."""
        common = F.col("n_articles") * 100 > F.lit(self.n_articles * common_percent)
        return self.counts().withColumn("mark", F.when(F.col("n_articles") <= rare_up_to, "rare").when(common, "common"))


def load_in_two_steps(rows: DataFrame, late_share: float = 0.1) -> TermStore:
    """A store after a first load and one batch with the deliveries of the last share of the time span."""
    store = TermStore(rows.sparkSession)
    span = rows.agg(F.min("load_ts").alias("a"), F.max("load_ts").alias("b")).first()
    rows = rows.select("sid", "ix", "load_ts", "id_article", "lemma", "word")
    if span["a"] is None:
        store.apply(rows)
        return store
    cut = span["b"] - (span["b"] - span["a"]) * late_share
    late = F.col("load_ts") > F.lit(cut)
    store.apply(rows.filter(~late | F.col("load_ts").isNull()))
    store.apply(rows.filter(late))
    return store
