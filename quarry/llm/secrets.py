"""Secret scanning with an incremental blob ledger, in DataFrame operations only.

Every version of every path is content-addressed by the SHA-256 of its text. The ledger holds, in a folder of its own, the (blob, rule,
version) triples that have been scanned and what was found in them. A run scans only the triples it lacks, writes their findings, then the triples,
and joins the current rules' findings back from blobs to all paths that ever held them. A run that dies before its triples are written
leaves nothing that counts, and the next one scans them again. Findings of rule versions that are no longer in use stay in the ledger and out of results.

A third of all paths may share one blob: blobs are reduced on the map side; findings are a written table of one row a blob, so the join back
is a broadcast while they are few, and otherwise one whose large partitions adaptive execution splits. Texts of blobs that need no scan are
filtered out before the shuffle while the list of those that do is small.

Defined results: null text is the empty blob, which has no findings; repeated rows repeat in the output; a null path is a path; other
columns of the input are ignored; an empty table gives an empty result. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import exists, materialise, private, scratch


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count if group `group` has at least `least` code points. A changed rule gets a new version."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: Kinds, patterns and least lengths of the base rules, in the order in which ties are listed. For the
#: last two, a least length inside the pattern finds the same matches, since their runs are maximal.
BASE_RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)

PAIRS_SCHEMA = "blob string, todo array<string>, run string"
FINDINGS_SCHEMA = "blob string, rule string, version int, start bigint, stop bigint, run string"

#: Blobs to scan up to which their list is broadcast, to keep other texts out of the shuffle (64 hexadecimal digits and some keys each).
FEW = 200_000


def versions(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob) of every row."""
    return docs.select(docs[path].alias("path"), _address(docs[text]).alias("blob"))


def blobs(docs: DataFrame, text: str = "text", among: DataFrame | None = None) -> DataFrame:
    """One row (blob, text) for each different text; `among` (a small table of blobs) leaves out all others."""
    every = docs.select(_address(docs[text]).alias("blob"), F.coalesce(docs[text], F.lit("")).alias("text"))
    return (every if among is None else every.join(F.broadcast(among), "blob", "left_semi")).dropDuplicates(["blob"])


def _address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class Ledger:
    """What has been scanned, and what was found, in a folder; by default in a new one, which the session deletes at its end."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "ledger")

    def _read(self, name: str, schema: str) -> DataFrame | None:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if exists(self.spark, f"{self.path}/{name}") else None

    def pairs(self) -> DataFrame | None:
        """(blob, todo, run): the rules' keys that each run has scanned a blob for; None before the first run."""
        return self._read("pairs", PAIRS_SCHEMA)

    def findings(self, rules: tuple[Rule, ...]) -> DataFrame | None:
        """Findings of the rules in their present versions, by runs that have ended."""
        found, done = self._read("findings", FINDINGS_SCHEMA), self.pairs()
        if found is None or done is None:
            return None
        current = F.concat_ws("@", "rule", F.col("version").cast("string")).isin([r.key for r in rules])
        return found.where(current).join(done.select("run").distinct(), "run", "left_semi").drop("run")

    def advance(self, docs: DataFrame, paths: DataFrame, rules: tuple[Rule, ...], text: str = "text") -> None:
        """Scan the pairs that are unseen, and enter them; paths: versions(docs)."""
        seen = self.pairs()
        waiting = materialise(unseen(paths.select("blob").distinct(), rules, seen), "unseen")
        if seen is None:
            contents = blobs(docs, text).withColumn("todo", _keys(rules))
        elif not (n := waiting.count()):
            return
        else:
            contents = blobs(docs, text, waiting if n <= FEW else None).join(waiting, "blob")
        run = uuid.uuid4().hex
        scan(contents, rules).write.parquet(f"{self.path}/findings/run={run}")
        waiting.write.parquet(f"{self.path}/pairs/run={run}")


def _keys(rules: tuple[Rule, ...]) -> Column:
    return F.array(*[F.lit(r.key) for r in rules]) if rules else F.array().cast("array<string>")


def unseen(contents: DataFrame, rules: tuple[Rule, ...], pairs: DataFrame | None) -> DataFrame:
    """contents with `todo`, the keys of the rules that have not seen the blob; blobs without any go."""
    if pairs is None:
        return contents.withColumn("todo", _keys(rules))
    seen = pairs.groupBy("blob").agg(F.flatten(F.collect_list("todo")).alias("seen"))
    left = contents.join(seen, "blob", "left")
    return left.withColumn("todo", F.array_except(_keys(rules), F.coalesce("seen", F.array().cast("array<string>")))).drop("seen").where(F.size("todo") > 0)


def scan(waiting: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rule, version, start, stop) of every finding in the unseen pairs.

    Text between matches and the matches themselves, laid end to end, give offsets: a running sum over a blob's
    matches, so a blob with very many of them costs time in proportion to their number.
    """

    def matches(rule: Rule) -> Column:
        whole = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
        group = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
        lengths = F.arrays_zip(
            F.transform(F.split("text", rule.pattern, -1), F.length).alias("gap"),
            F.transform(whole, F.length).alias("size"),
            F.transform(group, F.length).alias("counted"),
        )
        wanted = F.array_contains("todo", rule.key) & F.col("text").rlike(rule.pattern)
        return F.when(wanted, F.transform(lengths, lambda x, i: F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"), F.lit(rule.least).alias("least"), i.alias("nth"), x["gap"].alias("gap"), x["size"].alias("size"), x["counted"].alias("counted"))))

    found = waiting.select("blob", F.explode(F.flatten(F.array_compact(F.array(*map(matches, rules))))).alias("m")).select("blob", "m.*").where(F.col("size").isNotNull())
    before = Window.partitionBy("blob", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = found.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(before))
    return placed.where(F.col("counted") >= F.col("least")).select("blob", "rule", "version", (F.col("stop") - F.col("size")).alias("start"), "stop")


def findings_by_blob(findings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, spans), spans an array of (start, rank, rule, stop) by start, then in the rules' order."""
    rank = reduce(lambda c, r: c.when(F.col("rule") == r[1].name, r[0]), enumerate(rules), F.when(F.lit(False), -1))
    return findings.withColumn("rank", rank).groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", "rank", "rule", "stop"))).alias("spans"))


def _listed(docs: DataFrame, paths: DataFrame, rules: tuple[Rule, ...], ledger: Ledger, text: str) -> DataFrame:
    """(blob, spans) of the blobs that any path holds, after the ledger has advanced."""
    ledger.advance(docs, paths, rules, text)
    found = ledger.findings(rules)
    if found is None:
        found = docs.sparkSession.createDataFrame([], FINDINGS_SCHEMA).drop("run")
    return materialise(findings_by_blob(found, rules).join(paths.select("blob").distinct(), "blob", "left_semi"), "listed")


def findings_by_path(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES, ledger: Ledger | None = None, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob, spans) for every row of docs."""
    paths = materialise(versions(docs, path, text), "paths")
    listed = _listed(docs, paths, rules, ledger or Ledger(docs.sparkSession), text)
    none = F.array().cast(listed.schema["spans"].dataType)
    return paths.join(listed, "blob", "left").select("path", "blob", F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES, ledger: Ledger | None = None, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with the union of all findings replaced by `mask`; null texts stay null, and so do all other columns."""
    paths = materialise(versions(docs, text, text).select("blob"), "paths")
    found = _listed(docs, paths, rules, ledger or Ledger(docs.sparkSession), text)
    blob, spans = private(docs, "__blob", "__spans")
    joined = docs.withColumn(blob, _address(docs[text])).join(found.withColumnsRenamed({"blob": blob, "spans": spans}), blob, "left")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(done: Column, span: Column) -> Column:
        piece = F.concat(F.substring(F.col(text), (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int")), F.lit(mask))
        parts = F.when(span["start"] >= done["at"], F.array_append(done["parts"], piece)).otherwise(done["parts"])
        return F.struct(F.greatest(done["at"], span["stop"]).alias("at"), parts.alias("parts"))

    cleaned = F.aggregate(spans, start, step, lambda done: F.concat(F.array_join(done["parts"], ""), F.substring(F.col(text), (done["at"] + 1).cast("int"), F.length(text))))
    return joined.withColumn(text, F.when(F.size(spans) > 0, cleaned).otherwise(F.col(text))).select(*docs.columns)


def digest(found: DataFrame, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """The columns of query op7 from findings_by_path."""
    names = [r.name for r in base]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    ours = F.filter("spans", lambda s: s["rule"].isin(names))
    count = lambda name: F.size(F.filter("spans", lambda s: s["rule"] == name)).cast("bigint")
    counts = [count(name).alias(f"n_{name}") for name in names]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(joined(ours).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
