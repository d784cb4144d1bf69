"""From spans and a sampler to decisions, and from decisions to kept spans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracesift.functions.hashing import keep_one_in
from tracesift.operators import samplers as S
from tracesift.operators.rules import Rule, RuleSet, matches
from tracesift.operators.tracekey import TraceKey
from tracesift.sources.spans import Spans

COLUMNS = ("trace_id", "n_descendants", "has_root", "rate", "keep", "reason", "sample_key")


def decide(spans: Spans, sampler, prefix: str = "default", extra: list[Column] = (), reads: tuple[str, ...] = (), history: DataFrame | None = None) -> DataFrame:
    """One row a trace: COLUMNS, then ``extra`` aggregates, which may read the fields ``reads``.

    ``history``: for a live job, COUNTS of the dynamic samplers from traces decided before. With it (an empty table at first) the
    result has the columns ``state``, ``ts`` and ``period`` too, from which ``tally`` counts.

    ``sampler``: a RuleSet, or any sampler. A rule's chance draw hashes the trace id. Downstream samplers count only traces
    that reach their rule, or another one that shares their state. One exchange by trace id; each dynamic sampler adds a small one
    by key and interval."""
    if not isinstance(sampler, RuleSet):
        out = decide(spans, RuleSet((Rule("", sampler=sampler),)), prefix, extra, reads, history)
        return out.withColumn("reason", F.substring_index("reason", ":", -1))
    downstream = {i: r for i, r in enumerate(sampler.rules) if r.sampler is not None}
    dynamic = {i: r for i, r in downstream.items() if not isinstance(r.sampler, S.Deterministic)}
    keys = {i: TraceKey(tuple(r.sampler.fields), r.sampler.length) for i, r in dynamic.items()}
    wanted = sampler.fields() | {"ts", *reads}
    narrow = spans.narrowed(wanted)
    gathered = [a for i, k in keys.items() for a in k.aggregates(narrow, f"k{i}_")]
    if dynamic:
        gathered.append(F.min("ts").alias("ts"))
    traces = matches(narrow, sampler, [*gathered, *extra])
    own = [c for c in traces.columns if c not in {"root", "rule", "ts", "trace_id", "n_descendants", "has_root"} and not any(c.startswith(f"k{i}_") for i in keys)]
    fixed = traces.where(~F.col("rule").isin(*dynamic) | F.col("rule").isNull()) if dynamic else traces
    rate, keep = F.lit(1).cast("long"), F.lit(True)
    reason = F.lit("no rule matched")
    for i, r in enumerate(sampler.rules):
        here = F.col("rule") == i
        if i in dynamic:
            continue
        if r.sampler is not None:
            a, b, c = r.sampler.decide(F.col("trace_id"))
            c = F.concat(F.lit(f"{r.tag}{r.name}:"), c)
        else:
            a = F.lit(r.sample_rate).cast("long")
            b = F.lit(False) if r.drop or r.sample_rate <= 0 else keep_one_in(F.col("trace_id"), r.sample_rate, "rules")
            c = F.lit(r.tag + r.name)
        rate, keep, reason = F.when(here, a).otherwise(rate), F.when(here, b).otherwise(keep), F.when(here, c).otherwise(reason)
    shape = ["trace_id", "n_descendants", "has_root"]
    live = [] if history is None else [F.lit(None).cast("string").alias("state"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("int").alias("period")]
    out = fixed.select(*shape, rate.alias("rate"), keep.alias("keep"), reason.alias("reason"), F.lit("").alias("sample_key"), *own, *live)
    # rules whose samplers share a state are counted together
    shared: dict[str, list[int]] = {}
    for i, r in dynamic.items():
        shared.setdefault(S.state_key(prefix, r.sampler), []).append(i)
    for state, members in shared.items():
        sampler_ = dynamic[members[0]].sampler
        key, tag = F.lit(""), F.lit("")
        for i in members:
            key = F.when(F.col("rule") == i, keys[i].key(narrow, f"k{i}_")[0]).otherwise(key)
            tag = F.when(F.col("rule") == i, F.lit(f"{dynamic[i].tag}{dynamic[i].name}:")).otherwise(tag)
        reached = traces.where(F.col("rule").isin(*members)).select(*shape, "ts", F.lit(state).alias("state"), key.alias("key"), tag.alias("tag"), *own)
        before = None if history is None else history.where(F.col("period") == S.period_of(sampler_))
        done = S.decide(reached, sampler_, history=before)
        live = [] if history is None else ["state", "ts", F.lit(S.period_of(sampler_)).alias("period")]
        out = out.unionByName(done.select(*shape, "rate", "keep", F.concat("tag", "sampler_reason").alias("reason"), F.col("key").alias("sample_key"), *own, *live))
    return out


def tally(decisions: DataFrame) -> DataFrame:
    """COUNTS that the dynamic samplers have taken in deciding these traces."""
    rows = decisions.where("state IS NOT NULL")
    interval = F.floor(F.unix_timestamp("ts") / F.col("period")).cast("long").alias("interval")
    return rows.groupBy("state", F.col("sample_key").alias("key"), interval).agg(F.sum("n_descendants").alias("n"), F.min("ts").alias("first"), F.max("period").alias("period"))


@dataclass(frozen=True)
class Decoration:
    """What kept spans are marked with."""

    reasons: bool = True
    counts_on_root: bool = True
    span_count_on_root: bool = False
    dry_run: bool = False
    host: str = ""
    attributes: tuple[tuple[str, str], ...] = ()


def counts() -> list[Column]:
    """Aggregates of records by kind; column ``annotation``."""
    return [
        F.count_if(F.col("annotation") == "span_event").alias("n_span_events"),
        F.count_if(F.col("annotation") == "link").alias("n_links"),
        F.count_if(~F.coalesce(F.col("annotation").isin("span_event", "link"), F.lit(False))).alias("n_spans"),
    ]


def merged_rates(original: Column, rate: Column, dry_run: bool) -> dict[str, Column]:
    """Sample rates of a kept span: the trace's rate times the one it came with (0: none)."""
    base = F.greatest(original, F.lit(1))
    product = base * rate
    empty = F.lit(None).cast("long")
    return {
        "original_sample_rate": F.when(original > 0, original),
        "final_sample_rate": empty if dry_run else product,
        "dryrun_sample_rate": product if dry_run else empty,
        "out_sample_rate": base if dry_run else product,
    }


def kept(spans: Spans, decisions: DataFrame, d: Decoration = Decoration()) -> DataFrame:
    """Spans of kept traces (of all traces in a dry run), decorated. Decisions need the counts where they are asked for.

    An equi-join on trace_id."""
    rows = decisions if d.dry_run else decisions.where("keep")
    names = [c for c in spans.df.columns]
    joined = spans.df.join(rows.withColumnRenamed("trace_id", "_t"), F.expr("trace_id = _t")).drop("_t")
    original = F.col("sample_rate") if "sample_rate" in names else F.lit(0).cast("long")
    out = {n: c.cast("long") for n, c in merged_rates(original, F.col("rate"), d.dry_run).items()}
    if d.reasons:
        out |= {"meta_reason": F.col("reason"), "meta_sample_key": F.when(F.col("sample_key") != "", F.col("sample_key"))}
        if "send_reason" in rows.columns:
            out["meta_send_reason"] = F.col("send_reason")
    root = F.coalesce("is_root", F.lit(False))
    if d.counts_on_root:
        out |= {f"meta_{n}": F.when(root, F.col(c)).cast("long") for n, c in (("span_event_count", "n_span_events"), ("span_link_count", "n_links"), ("span_count", "n_spans"), ("event_count", "n_descendants"))}
    elif d.span_count_on_root:
        out["meta_span_count"] = F.when(root, F.col("n_descendants")).cast("long")
    if d.dry_run:
        out["meta_dryrun_kept"] = F.col("keep")
    if d.host:
        out["meta_local_hostname"] = F.lit(d.host)
    out |= {k: F.lit(v) for k, v in d.attributes}
    return joined.select(*names, *[c.alias(n) for n, c in out.items()])


def kept_deterministic(spans: Spans, rate: int) -> DataFrame:
    """Spans kept by a deterministic sampler alone: its choice needs the trace id only, so it's a filter below any exchange."""
    return spans.df.where(keep_one_in(F.col("trace_id"), rate))
