"""Secret scans over a ledger of blobs, in DataFrame operations only.

Every version of a document is a blob, addressed by the SHA-256 of its text. The ledger holds which (blob, rule, rule version) were scanned,
and the findings of each. A scan takes one text of each blob that has a pair not scanned yet, runs those rules, adds
the pairs and findings to the ledger, and joins findings back to all documents (paths) that hold the blob. A blob that was seen before costs
a hash; a rule whose version rises is run again over all blobs, and only that rule.

Rules that the ledger has never run are due for every blob: texts are tested where they lie, and only those with a match move, one of each blob.
For rules that it has run, the pairs not scanned yet are found over narrow rows first; where there are none, no text is read.

Spans come from built-in functions alone: splitting a text by a rule's pattern gives the stretches between matches, extracting
gives the matches, and lengths in code points add up to the positions.

Defined results: a null text counts as empty and has no findings; documents with equal text share a blob; rows that repeat each get their
findings; an empty table gives an empty table. The scan returns the key and the findings, so other columns can't clash.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, new_path, salted_left_join

SPANS = "array<struct<kind:string,start:long,end:long>>"


@dataclass(frozen=True)
class Rule:
    """pattern: Java syntax. secret: the group whose length counts (0: the whole match), of `least` characters or more. holds: a text that is in every
    match, which is looked for before the pattern is tried."""

    kind: str
    pattern: str
    secret: int = 0
    least: int = 1
    version: int = 1
    holds: str = ""


#: Rules beside the base: private keys, signed tokens, and passwords in addresses.
MORE_RULES = (
    Rule("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", holds="-----BEGIN "),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", holds="eyJ"),
    Rule("login", r"[a-z]+://[A-Za-z0-9._-]+:([^@/\s]+)@", 1, 4, holds="://"),
)
# The base rules, in the order in which their spans sort.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, holds="AKIA"),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)


def hit(text: str, rules: list[Rule]) -> Column:
    """Whether some rule matches. It counts as not deterministic, so that it isn't tested below a repartition, on the few tasks that read a small table."""
    each = [F.col(text).contains(r.holds) & F.col(text).rlike(r.pattern) if r.holds else F.col(text).rlike(r.pattern) for r in rules]
    return F.when(F.spark_partition_id() >= 0, reduce(operator.or_, each))


def steps_of(text: str, rule: Rule):
    """For each match of a rule, leftmost and non-overlapping: gap, the code points between the match before and it; n, its own; and own, its secret's."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    secrets = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.secret)) if rule.secret else matches
    between = F.split(F.col(text), rule.pattern, -1)
    steps = F.zip_with(
        F.slice(between, 1, F.size(matches)),
        F.arrays_zip(matches.alias("m"), secrets.alias("s")),
        lambda gap, hit: F.struct(F.length(gap).cast("long").alias("gap"), F.length(hit["m"]).cast("long").alias("n"), F.length(hit["s"]).alias("own")),
    )
    return F.when(F.size(matches) > 0, steps)


class BlobLedger:
    """Scanned (blob, rule, version) and findings, as tables in a shared folder."""

    SCANNED = "blob binary, rules array<struct<kind:string,version:int>>"
    FOUND = "blob binary, kind string, version int, start long, end long"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.version = spark, path or new_path(spark, "blob-ledger"), 0

    def _table(self, name: str, schema: str) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/v{v}/{name}" for v in range(1, self.version + 1)])

    @property
    def scanned(self) -> DataFrame:
        return self._table("scanned", self.SCANNED)

    @property
    def found(self) -> DataFrame:
        return self._table("found", self.FOUND)

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(key, blob, spans) for each document; spans of all rules by start, then in the rules' order."""
        body = F.coalesce(F.col(text), F.lit(""))
        docs = docs.select(F.col(key).alias("key"), body.alias("text"), F.unhex(F.sha2(body, 256)).alias("blob"))
        paths = materialize(docs.select("key", "blob"), "paths")
        ran = {(r.kind, r.version) for r in self.scanned.select(F.explode("rules").alias("r")).select("r.*").distinct().collect()}  # as many as there are rules
        fresh, known = [r for r in rules if (r.kind, r.version) not in ran], [r for r in rules if (r.kind, r.version) in ran]
        named = lambda own: F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in own])
        at = f"{self.path}/v{self.version + 1}"
        blobs = paths.select("blob").distinct()
        moved, scanned = [], []
        if fresh:
            scanned.append(blobs.select("blob", named(fresh).alias("rules")))
            moved.append(docs.where(hit("text", fresh)).select("blob", "text", F.array(*[F.lit(r.kind) for r in fresh]).alias("due")))
        if known:
            pairs = blobs.select("blob", F.explode(named(known)).alias("pair"))
            seen = self.scanned.select("blob", F.explode("rules").alias("pair"))
            due = materialize(pairs.join(seen, ["blob", "pair"], "left_anti").groupBy("blob").agg(F.collect_list("pair").alias("rules")), "due", narrow=True)
            if not due.isEmpty():
                scanned.append(due)
                # One path of each blob is chosen over narrow rows, since a blob may have very many copies.
                place = F.coalesce(F.col("key").cast("string"), F.lit(""))
                chosen = paths.groupBy("blob").agg(F.min(place).alias("place")).join(due, "blob")
                moved.append(docs.withColumn("place", place).join(chosen.hint("shuffle_hash"), ["place", "blob"]).select("blob", "text", F.transform("rules", lambda r: r["kind"]).alias("due")))
        if moved:
            reduce(DataFrame.unionByName, scanned).write.parquet(f"{at}/scanned")
            self._find(reduce(DataFrame.unionByName, moved), rules).write.parquet(f"{at}/found")
            self.version += 1
        order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
        wanted = [f"{r.version}:{r.kind}" for r in rules]
        held = (
            self.found.where(F.concat_ws(":", "version", "kind").isin(wanted))
            .groupBy("blob")
            .agg(F.sort_array(F.collect_list(F.struct("start", order[F.col("kind")].alias("rank"), "end", "kind"))).alias("all"))
            .select("blob", F.transform("all", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
        )
        out = salted_left_join(paths, held, "blob", F.col("key"))
        return out.select(F.col("key").alias(key), "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))

    @staticmethod
    def _find(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """(blob, kind, version, start, end) of the matches of the due rules in a text of each blob: the text by aggregation, of which copies fall away
        before the shuffle, and the positions by running sums over a blob's matches of a kind."""
        texts = texts.groupBy("blob", F.array_sort("due").alias("due")).agg(F.first("text").alias("text"))
        each = texts.select("blob", F.explode(F.array(*[
            F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"), F.when(F.array_contains("due", r.kind), steps_of("text", r)).alias("steps")) for r in rules
        ])).alias("x")).select("blob", "x.*")
        steps = each.select("blob", "kind", "version", "least", F.posexplode("steps").alias("at", "step"))
        until = Window.partitionBy("blob", "kind").orderBy("at")
        end = F.sum(F.col("step.gap") + F.col("step.n")).over(until)
        return steps.withColumn("end", end).where(F.col("step.own") >= F.col("least")).select("blob", "kind", "version", (F.col("end") - F.col("step.n")).alias("start"), "end")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scan all documents with a new ledger."""
    return BlobLedger(docs.sparkSession).scan(docs, rules, key, text)
