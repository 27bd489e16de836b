"""Secret scans over a ledger of content-addressed blobs, with DataFrame functions only.

Every version of every path is a blob, named by the SHA-256 of its text. Only pairs of blob and rule version
that the ledger does not hold are scanned; what was found belongs to the pair and is joined back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perkwise.session import stage


@dataclass(frozen=True)
class Rule:
    """A pattern and the least length of one of its groups; a match below it is dropped."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def mark(self) -> str:
        return f"{self.kind}@{self.version}"


# Kinds, patterns and least lengths, in the order in which equal starts are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # A longest run of hex digits is found by its least length alone, without stopping at every letter.
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)


def blobs(versions: DataFrame, text_col: str = "text") -> DataFrame:
    """The versions with ``text`` and its name ``blob``; a null text is an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return versions.withColumn("__text", text).withColumn("blob", F.sha2(F.col("__text").cast("binary"), 256))


def _matches(rule: Rule, order: int) -> Column:
    """Of each match: how many code points lie between it and the one before, its length, and whether it counts."""
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        F.split("__text", rule.pattern, -1).alias("gap"), F.regexp_extract_all("__text", pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all("__text", pattern, F.lit(rule.group)).alias("part"))
    # There is one gap more than matches.
    found = F.transform(F.filter(zipped, lambda x: x["match"].isNotNull()), lambda x, i: F.struct(
        F.lit(rule.mark).alias("rule"), F.lit(order).alias("kind_order"), F.lit(rule.kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"),
        F.length(x["match"]).alias("size"), (F.length(x["part"]) >= rule.least).alias("counts")))
    wanted = F.array_contains("pending", rule.mark) & F.col("__text").rlike(rule.pattern)
    return F.when(wanted, found)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
         text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger does not hold; returns (ledger with the new blobs, findings of the new pairs).

    Ledger: (blob, rule) with rule ``kind@version``. Findings: (blob, rule, kind, kind_order, start, end) in code
    points, end exclusive. Both are written tables; the caller keeps the ledger for the next scan and adds the
    findings to those it has. An empty table gives the ledger as it was and no findings.
    """
    marks = F.array(*[F.lit(r.mark) for r in rules])
    # Each text once, however many copies; copies of a task meet before the shuffle.
    named = blobs(versions, text_col).groupBy("blob").agg(F.first("__text").alias("__text"))
    if ledger is None:
        pending = named.withColumn("pending", marks)
    else:
        done = ledger.groupBy("blob").agg(F.collect_set("rule").alias("done"))
        pending = named.join(done, "blob", "left").withColumn(
            "pending", F.array_except(marks, F.coalesce("done", F.array().cast("array<string>")))).drop("done")
    pending = pending.filter(F.size("pending") > 0)
    every = F.flatten(F.filter(F.array(*[_matches(r, i) for i, r in enumerate(rules)]), lambda x: x.isNotNull()))
    scanned = stage(pending.select("blob", "pending", every.alias("matches")), "blob-scan")
    before = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = scanned.select("blob", F.explode("matches").alias("m")).select("blob", "m.*")
    end = F.sum(F.col("gap") + F.col("size")).over(before)
    findings = rows.withColumn("end", end).filter("counts").select(
        "blob", "rule", "kind", "kind_order", (F.col("end") - F.col("size")).alias("start"), "end")
    new = scanned.select("blob", F.explode("pending").alias("rule"))
    return stage(new if ledger is None else ledger.unionByName(new), "blob-ledger"), stage(findings, "blob-findings")


def by_path(versions: DataFrame, findings: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All versions with ``blob``, a count ``n_<kind>`` for each rule and ``found``, the ordered spans of their blob.

    Only findings of these versions of the rules count, each once, however often it was added; those of earlier
    versions are superseded. Repeated and empty versions get what their blob has; a version without findings gets
    zeros and an empty list. Columns of the versions that are named like a new one are replaced.
    """
    current = findings.filter(F.col("rule").isin([r.mark for r in rules]))
    spans = current.groupBy("blob").agg(F.sort_array(F.collect_set(F.struct("start", "kind_order", "kind", "end"))).alias("spans"))
    made = {"blob", "found", *(f"n_{r.kind}".lower() for r in rules)}
    kept = {c: f"__c{i}" for i, c in enumerate(versions.columns)}
    named = blobs(versions.toDF(*kept.values()), kept[text_col]).drop("__text").join(spans, "blob", "left")
    found = F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType.simpleString()))
    kinds = F.transform(found, lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, r.kind))).cast("long").alias(f"n_{r.kind}") for r in rules]
    return named.select(*[F.col(n).alias(c) for c, n in kept.items() if c.lower() not in made], "blob", *counts, found.alias("found"))


def span_text(found: Column) -> Column:
    """The spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
