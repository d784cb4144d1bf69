"""Secret scanning through an incremental blob ledger, wholly in DataFrame functions.

Every version of every text is addressed by the SHA-256 of its content. The ledger has what has been scanned:
one row for each blob and run, with the rules (name and version) applied and the spans found. A scan reads
one text of each blob that some rule version has not seen, applies just the unseen rules, and findings are joined back
to all paths that hold the blob. Copies are never scanned twice, and a rerun over old versions scans nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesift.llm.scratch import cut, fresh

LEDGER = "blob string, rules array<string>, spans array<struct<start: bigint, no: int, end: bigint>>"


@dataclass(frozen=True)
class Rule:
    """A pattern of Java's and RE2's common syntax; matches are leftmost and do not overlap.

    ``least``: characters that ``group`` must have, else the match is dropped (it still used up its text)."""

    name: str
    pattern: str
    least: int = 0
    group: int = 0
    version: int = 1

    @property
    def tag(self) -> str:
        return f"{self.name}@{self.version}"


#: The base rules, then those that this scanner adds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + ADDED


def blob_of(text: str = "text"):
    """Content address; a null text is the empty blob."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows for ``versions`` (columns ``doc_id``, ``text``): blobs that some of ``rules`` has not seen.

    Append the result to the ledger. Blobs without any finding get a row too, else they would be scanned again.
    An empty or null text is the empty blob. Repeated rows, and rows of a null doc_id, are scanned as one blob; an empty table gives no
    rows. Positions count code points. Only doc_id and text are read."""
    marked = versions.select("doc_id", blob_of().alias("blob"))
    todo = marked.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if ledger is not None:
        tags = [r.tag for r in rules]
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        todo = todo.join(seen, "blob", "left").withColumn("rules", F.array_except(F.array(*map(F.lit, tags)), F.coalesce("seen", F.array().cast("array<string>"))))
        todo = todo.where(F.size("rules") > 0).select("doc_id", "blob", "rules")
    else:
        todo = todo.withColumn("rules", F.array(*[F.lit(r.tag) for r in rules]))
    texts = versions.select(F.col("doc_id").alias("_d"), F.coalesce("text", F.lit("")).alias("text"), blob_of().alias("_b"))
    todo = texts.join(todo, F.expr("_d <=> doc_id AND _b = blob")).select("blob", "rules", "text")
    hits = [F.when(F.array_contains("rules", r.tag), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).alias(f"h{k}") for k, r in enumerate(rules)]
    found = todo.select("blob", "rules", "text", *hits)
    each = [
        F.struct(F.lit(k).alias("no"), F.col(f"h{k}").alias("hits"), F.when(F.size(f"h{k}") > 0, F.split("text", r.pattern, -1)).alias("gaps"))
        for k, r in enumerate(rules)
    ]
    found = cut(found.select("blob", "rules", F.filter(F.array(*each), lambda x: F.size(x["hits"]) > 0).alias("found")))
    rows = found.dropDuplicates(["blob"]) if ledger is None else found.dropDuplicates(["blob", "rules"])
    cases = F.explode("found").alias("f")
    rows = rows.select("blob", "rules", F.size("found").alias("n"), "found")
    long = rows.where("n > 0").select("blob", cases).select("blob", F.col("f.no").alias("no"), F.posexplode(F.arrays_zip(F.col("f.hits").alias("hit"), F.slice("f.gaps", 1, F.size("f.hits")).alias("gap"))).alias("i", "x"))
    long = long.select("blob", "no", "i", F.length("x.hit").alias("n"), F.length("x.gap").alias("skip"), F.col("x.hit").alias("hit"))
    end = F.expr("sum(n + skip) OVER (PARTITION BY blob, no ORDER BY i)").alias("end")
    keep = F.lit(True)
    for k, r in enumerate(rules):
        if r.least:
            keep = F.when(F.col("no") == k, F.length(F.regexp_extract("hit", r.pattern, r.group)) >= r.least).otherwise(keep)
    spans = long.select("blob", "no", "n", end, keep.alias("keep")).where("keep")
    spans = spans.select("blob", F.struct((F.col("end") - F.col("n")).alias("start"), "no", "end").alias("s")).groupBy("blob").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    out = rows.select("blob", "rules").join(spans, "blob", "left")
    return out.select("blob", "rules", F.coalesce("spans", F.array().cast("array<struct<start:bigint,no:int,end:bigint>>")).alias("spans"))


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Joins the ledger's spans back to every row of ``versions``: doc_id, blob, and ``spans`` sorted by start and rule."""
    tags = F.array(*[F.lit(r.tag) for r in rules])
    ours = ledger.where(F.arrays_overlap("rules", tags) & (F.size("spans") > 0))
    ours = ours.select("blob", F.filter("spans", lambda s: F.array_contains("rules", F.element_at(tags, s["no"] + 1))).alias("spans"))
    ours = ours.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    named = versions.select("doc_id", blob_of().alias("blob")).join(ours, "blob", "left")
    return named.select("doc_id", "blob", F.coalesce("spans", F.array().cast("array<struct<start:bigint,no:int,end:bigint>>")).alias("spans"))


def described(spans: str, rules: tuple[Rule, ...] = RULES):
    """``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(r.name) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["no"] + 1), s["start"], s["end"])), ",")


def masked(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``versions`` with every span's text replaced by ``mark``; other columns and rows without findings are unchanged.

    Overlapping spans are merged; the text is cut at code points. Null texts stay null, equal rows are masked alike, columns of any
    name come back as they were, and an empty table stays empty."""
    names = versions.columns
    blob, spans = fresh(versions, "_blob", "_spans")
    found = findings(versions, ledger, rules).select(F.col("blob").alias(blob), F.col("spans").alias(spans)).where(F.size(spans) > 0).dropDuplicates([blob])
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(acc, s):
        piece = F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))
        inside = s["start"] < acc["at"]
        return F.struct(F.when(inside, acc["out"]).otherwise(piece).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    clean = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    joined = versions.withColumn(blob, blob_of()).join(found, blob, "left")
    return joined.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(clean)).select(*[F.col(f"`{c}`") for c in names])
