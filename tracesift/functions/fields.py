"""Envelope expressions: ids, roots, keys, times, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default names of id fields.
TRACE_ID_NAMES = ("trace.trace_id", "traceId")
PARENT_ID_NAMES = ("trace.parent_id", "parentId")


def nonempty(c: Column) -> Column:
    return F.when(c.cast("string") != "", c.cast("string"))


def first_of(columns: list[Column]) -> Column:
    """First non-empty value; null where there is none."""
    return F.coalesce(*[nonempty(c) for c in columns], F.lit(None).cast("string"))


def trace_id(meta: Column, named: list[Column]) -> Column:
    """The explicit metadata id beats the configured names, which are tried in order."""
    return first_of([meta, *named])


def is_root(parents: list[Column], signal: Column) -> Column:
    """A record without a parent is a root unless it's a log."""
    return first_of(parents).isNull() & (F.coalesce(signal, F.lit("trace")) != "log")


def annotation(c: Column) -> Column:
    return F.when(c == "span_event", "event").when(c == "link", "link").otherwise("span")


def is_legacy_key(key: Column) -> Column:
    """32 lower-case hex digits, or the 64-character ingest form."""
    return F.coalesce(key.rlike("^[0-9a-f]{32}$") | key.rlike("^hc[a-z]ic_[0-9a-z]{58}$"), F.lit(False))


def sampler_key(api_key: Column, dataset: Column, environment: Column, prefix: str = "") -> Column:
    """What selects the sampler: the environment, or for legacy keys the dataset with an optional prefix."""
    own = F.concat(F.lit(prefix + "."), dataset) if prefix else dataset
    return F.when(is_legacy_key(api_key), own).otherwise(environment)


def event_time(text: Column) -> Column:
    """RFC 3339, or an epoch number: ten digits are seconds, further digits a fraction, whatever their unit. Else null."""
    digits = text.rlike(r"^[0-9]{10,}$")
    number = text.rlike(r"^[0-9]+(\.[0-9]+)?$")
    micros = F.rpad(F.substring(text, 11, 6), 6, "0")
    from_digits = F.timestamp_micros((F.substring(text, 1, 10).cast("long") * 1000000 + micros.cast("long")).cast("long"))
    from_number = F.timestamp_micros(F.round(text.try_cast("double") * 1e6).cast("long"))
    iso = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$")
    return F.when(digits, from_digits).when(number, from_number).when(iso, F.try_to_timestamp(text))


def payload_size(fields: dict[str, tuple[str, Column]]) -> Column:
    """Sum over present fields of key length and value size: booleans 1, numbers and others 8, strings their bytes."""
    total = F.lit(0)
    for name, (kind, c) in fields.items():
        size = F.octet_length(c) if kind == "string" else F.lit(1 if kind == "boolean" else 8)
        total = total + F.when(c.isNotNull(), size + len(name.encode())).otherwise(0)
    return total.cast("long")


def _listed(key: Column, key_id: Column | None, keys: list[str], ids: list[str]) -> Column:
    known = F.coalesce(key.isin(*keys), F.lit(False)) if keys else F.lit(False)
    if key_id is not None and ids:
        known = known | F.coalesce((key_id != "") & key_id.isin(*ids), F.lit(False))
    return known


def replace_key(key: Column, mode: str, send_key: str, listed: list[str], key_id: Column | None = None, listed_ids: list[str] = ()) -> Column:
    """Which API key goes on: ``mode`` says for which keys ``send_key`` takes the place. A blank result is null (an error)."""
    blank = F.coalesce(key, F.lit("")) == ""
    known = _listed(key, key_id, listed, list(listed_ids))
    swap = {"none": F.lit(False), "all": F.lit(True), "nonblank": ~blank, "listedonly": known, "missingonly": blank, "unlisted": ~blank & ~known}[mode]
    return nonempty(F.when(swap & F.lit(bool(send_key)), F.lit(send_key)).otherwise(key))


def accepted(key: Column, only_listed: bool, listed: list[str], send_key: str = "", key_id: Column | None = None, listed_ids: list[str] = ()) -> Column:
    """Whether a key may send: all may, unless only listed ones do."""
    if not only_listed:
        return F.lit(True)
    return _listed(key, key_id, [*listed, *([send_key] if send_key else [])], list(listed_ids))
