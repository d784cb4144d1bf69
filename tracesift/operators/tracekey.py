"""Keys that group traces for the dynamic samplers.

Fields are taken in name order. For each, the distinct values over all records of the trace, as sorted text, each followed by
``•``, then a comma; fields of the root follow as ``value,``; then, if asked, the number of records.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracesift.functions import values as V
from tracesift.operators.conditions import ROOT
from tracesift.sources.spans import Spans

#: Counting stops here: 99 values are kept, the hundredth only ends the collection.
MAX_VALUES = 100


@dataclass(frozen=True)
class TraceKey:
    fields: tuple[str, ...]
    length: bool = False
    by_arrival: bool = False  # exact beyond MAX_VALUES values; gathers all values of a trace, in arrival order

    def own(self) -> list[str]:
        return sorted(f for f in self.fields if not f.startswith(ROOT))

    def of_root(self) -> list[str]:
        return [f.removeprefix(ROOT) for f in sorted(self.fields) if f.startswith(ROOT)]

    def _text(self, spans: Spans, name: str) -> Column | None:
        place = spans.field(name)
        if place is None:
            return None
        if place.kind == "variant":
            number = F.try_variant_get(place.value, "$", "double")
            shape = F.schema_of_variant(place.value)
            return F.when(place.value.isNull(), None).when(F.is_variant_null(place.value), V.MISSING).when(shape.rlike("^(BIGINT|DOUBLE|DECIMAL)"), V.text_fixed("double", number)).when(shape.startswith("STRING"), F.try_variant_get(place.value, "$", "string")).otherwise(F.to_json(place.value))
        return V.text_fixed(place.kind, place.value)

    def _root_text(self, spans: Spans, name: str) -> Column:
        """A root's value as text; of a schemaless record by the type that it has there."""
        place = spans.field(name)
        if place.kind != "variant":
            return V.text_general(place.kind, place.value)
        shape, typed = F.schema_of_variant(place.value), lambda kind: F.try_variant_get(place.value, "$", kind)
        out = F.when(place.value.isNull(), None).when(F.is_variant_null(place.value), V.MISSING)
        out = out.when(shape.rlike("^(BIGINT|DOUBLE|DECIMAL)"), V.text_general("double", typed("double")))
        return out.when(shape.startswith("STRING"), typed("string")).otherwise(F.to_json(place.value))

    def aggregates(self, spans: Spans, prefix: str) -> list[Column]:
        """What a trace must gather, as aggregates."""
        out = []
        for i, name in enumerate(self.own()):
            text = self._text(spans, name)
            if text is not None:
                seen = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("arrival", text.alias("t"))))) if self.by_arrival else None
                out.append((F.collect_set(text) if seen is None else F.array_distinct(F.transform(seen, lambda x: x["t"]))).alias(f"{prefix}v{i}"))
        values = [self._root_text(spans, n).alias(f"r{k}") for k, n in enumerate(self.of_root()) if spans.field(n) is not None]
        if values:
            out.append(F.max_by(F.struct(*values), F.when(F.col("is_root"), F.col("arrival"))).alias(f"{prefix}root"))
        return out

    def key(self, spans: Spans, prefix: str) -> tuple[Column, Column]:
        """The key and its number of values, from the gathered columns and n_descendants.

        A trace with fewer than MAX_VALUES distinct values keeps them all; beyond that the first by arrival are kept, or, unless
        ``by_arrival``, the first in sorted order."""
        parts, counts = [], []
        taken = F.lit(0)
        for i, name in enumerate(self.own()):
            if spans.field(name) is None:
                continue
            values = F.col(f"{prefix}v{i}") if self.by_arrival else F.array_sort(f"{prefix}v{i}")
            room = F.greatest(F.lit(0), F.lit(MAX_VALUES - 1) - taken)
            values = F.array_sort(F.slice(values, F.lit(1), F.least(F.size(values), room)))
            taken = taken + F.size(values)
            parts.append(F.when(F.size(values) > 0, F.concat(F.array_join(values, "•"), F.lit("•,"))).otherwise(""))
            counts.append(F.size(values))
        for k, name in enumerate(self.of_root()):
            if spans.field(name) is None:
                continue
            value = F.col(f"{prefix}root.r{k}")
            parts.append(F.when(value.isNotNull(), F.concat(value, F.lit(","))).otherwise(""))
            counts.append(F.when(value.isNotNull(), 1).otherwise(0))
        if self.length:
            parts.append(F.col("n_descendants").cast("string"))
            counts.append(F.lit(1))
        total = F.lit(0)
        for c in counts:
            total = total + c
        return F.concat(*parts) if parts else F.lit(""), total.cast("long")
