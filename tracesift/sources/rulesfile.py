"""Rules files: YAML, TOML or JSON, from one or several places, checked and turned into samplers.

Later places override earlier ones. ``${NAME}`` is replaced by an environment variable; an unset one stays as it is written.
"""

from __future__ import annotations

import difflib
import hashlib
import json
import os
import re
import tomllib
from dataclasses import dataclass, fields as fields_of

from tracesift.operators import samplers as S
from tracesift.operators.conditions import DATATYPES, OPERATORS, Condition, ConditionError, compile_test
from tracesift.operators.rules import Rule, RuleSet

DEFAULT = "__default__"
VERSION = 2
_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}
_SIZES = {"": 1, "b": 1, "k": 1000, "kb": 1000, "m": 1000**2, "mb": 1000**2, "g": 1000**3, "gb": 1000**3, "t": 1000**4, "tb": 1000**4, "kib": 1024, "ki": 1024, "mib": 1024**2, "mi": 1024**2, "gib": 1024**3, "gi": 1024**3, "tib": 1024**4, "ti": 1024**4}


class RulesError(ValueError):
    """All that is wrong with a rules document."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


def seconds(value) -> float:
    """A duration such as ``1m30s``; a bare number is seconds."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    parts = re.findall(r"([0-9]*\.?[0-9]+)(ns|us|µs|ms|s|m|h)", str(value))
    if not parts or "".join(a + b for a, b in parts) != str(value):
        raise ValueError(f"{value!r} is no duration")
    return sum(float(n) * _UNITS[u] for n, u in parts)


def size(value) -> int:
    """A memory size such as ``2GB`` (powers of 1000) or ``2GiB`` (of 1024)."""
    if isinstance(value, int) and not isinstance(value, bool):
        return value
    m = re.fullmatch(r"([0-9]*\.?[0-9]+)\s*([A-Za-z]*)", str(value).strip())
    if not m or m[2].lower() not in _SIZES:
        raise ValueError(f"{value!r} is no size")
    return int(float(m[1]) * _SIZES[m[2].lower()])


def expand(value, environment: dict[str, str] | None = None):
    """Replaces ``${NAME}`` in every string of a document."""
    env = os.environ if environment is None else environment
    if isinstance(value, str):
        return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", lambda m: env.get(m[1], m[0]), value)
    if isinstance(value, dict):
        return {k: expand(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v, env) for v in value]
    return value


def merge(a: dict, b: dict) -> dict:
    """``b`` over ``a``, two levels deep: a sampler given again replaces the earlier one as a whole."""
    return a | {k: a[k] | v if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}


def parse(text: str, name: str = "") -> dict:
    if name.endswith(".json"):
        return json.loads(text)
    if name.endswith(".toml"):
        return tomllib.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


@dataclass(frozen=True)
class Document:
    body: dict
    digest: str  # of the sources' bytes; a reload with the same digest changes nothing


def read(places: list[str]) -> Document:
    """Files in order; a later one overrides."""
    body, h = {}, hashlib.md5()
    for place in places:
        with open(place, encoding="utf-8") as f:
            text = f.read()
        h.update(text.encode())
        body = merge(body, parse(text, place))
    return Document(expand(body), h.hexdigest())


#: Samplers by their names in rules files, and the fields' names there.
_KINDS = {
    "DeterministicSampler": (S.Deterministic, {"SampleRate": "rate"}),
    "DynamicSampler": (S.Dynamic, {"SampleRate": "goal", "FieldList": "fields", "ClearFrequency": "interval_s", "MaxKeys": "max_keys", "UseTraceLength": "length"}),
    "EMADynamicSampler": (S.EmaDynamic, {"GoalSampleRate": "goal", "FieldList": "fields", "AdjustmentInterval": "interval_s", "Weight": "weight", "AgeOutValue": "age_out", "BurstMultiple": "burst_multiple", "BurstDetectionDelay": "burst_delay", "MaxKeys": "max_keys", "UseTraceLength": "length"}),
    "EMAThroughputSampler": (S.EmaThroughput, {"GoalThroughputPerSec": "goal_per_s", "FieldList": "fields", "AdjustmentInterval": "interval_s", "Weight": "weight", "AgeOutValue": "age_out", "InitialSampleRate": "initial", "MaxKeys": "max_keys", "UseTraceLength": "length", "UseClusterSize": "peers", "BurstMultiple": None, "BurstDetectionDelay": None}),
    "WindowedThroughputSampler": (S.WindowedThroughput, {"GoalThroughputPerSec": "goal_per_s", "FieldList": "fields", "UpdateFrequency": "update_s", "LookbackFrequency": "lookback_s", "MaxKeys": "max_keys", "UseTraceLength": "length", "UseClusterSize": "peers"}),
    "TotalThroughputSampler": (S.TotalThroughput, {"GoalThroughputPerSec": "goal_per_s", "FieldList": "fields", "ClearFrequency": "interval_s", "MaxKeys": "max_keys", "UseTraceLength": "length", "UseClusterSize": "peers"}),
}
_NEEDED = {"DynamicSampler": ("SampleRate", "FieldList"), "EMADynamicSampler": ("GoalSampleRate", "FieldList"), "EMAThroughputSampler": ("GoalThroughputPerSec", "FieldList"), "WindowedThroughputSampler": ("GoalThroughputPerSec", "FieldList"), "TotalThroughputSampler": ("GoalThroughputPerSec", "FieldList")}
_TIMES = ("interval_s", "update_s", "lookback_s")
_RULE = ("Name", "SampleRate", "Drop", "Scope", "Conditions", "Sampler")
_CONDITION = ("Field", "Fields", "Operator", "Value", "Datatype")


def _unknown(names, known, where: str) -> list[str]:
    out = []
    for n in names:
        if n not in known:
            near = difflib.get_close_matches(n, known, 1)
            out.append(f"{where}: unknown {n}" + (f", did you mean {near[0]}?" if near else ""))
    return out


def validate(body: dict) -> list[str]:
    """Messages about a rules document; none if it can be used."""
    found = _unknown(body, ("RulesVersion", "Samplers"), "rules")
    if body.get("RulesVersion") != VERSION:
        found.append(f"RulesVersion must be {VERSION}")
    samplers = body.get("Samplers") or {}
    if DEFAULT not in samplers:
        found.append(f"Samplers needs {DEFAULT}")
    for name, choice in samplers.items():
        found += _check_choice(choice, name, True)
    return found


def _check_choice(choice, where: str, top: bool) -> list[str]:
    if not isinstance(choice, dict) or len(choice) != 1:
        return [f"{where}: exactly one sampler is needed"]
    (kind, body), = choice.items()
    if kind == "RulesBasedSampler" and top:
        return _check_rules(body or {}, f"{where}.{kind}")
    if kind not in _KINDS:
        return _unknown([kind], (*_KINDS, "RulesBasedSampler"), where)
    body, where = body or {}, f"{where}.{kind}"
    found = _unknown(body, _KINDS[kind][1], where) + [f"{where}: {n} is needed" for n in _NEEDED.get(kind, ()) if not body.get(n)]
    for n, v in body.items():
        to = _KINDS[kind][1].get(n)
        if to in _TIMES:
            try:
                seconds(v)
            except ValueError as e:
                found.append(f"{where}.{n}: {e}")
        elif to in ("rate", "goal", "goal_per_s", "max_keys", "initial") and (isinstance(v, bool) or not isinstance(v, int) or v < 1):
            found.append(f"{where}.{n}: must be a whole number of at least 1")
        elif to == "fields" and not (isinstance(v, list) and all(isinstance(x, str) for x in v)):
            found.append(f"{where}.{n}: must be a list of strings")
    return found


def _check_rules(body: dict, where: str) -> list[str]:
    found = _unknown(body, ("Rules", "CheckNestedFields"), where)
    for i, rule in enumerate(body.get("Rules") or []):
        at = f"{where}.Rules[{i}]"
        found += _unknown(rule, _RULE, at)
        if rule.get("Scope", "trace") not in ("trace", "span"):
            found.append(f"{at}.Scope: must be trace or span")
        if rule.get("Sampler"):
            found += _check_choice(rule["Sampler"], f"{at}.Sampler", False)
        for j, c in enumerate(rule.get("Conditions") or []):
            here = f"{at}.Conditions[{j}]"
            found += _unknown(c, _CONDITION, here)
            if c.get("Field") and c.get("Fields"):
                found.append(f"{here}: Field and Fields exclude each other")
            if c.get("Operator") not in OPERATORS:
                found.append(f"{here}: unknown operator {c.get('Operator')!r}")
            elif c.get("Datatype", "") not in DATATYPES:
                found.append(f"{here}: unknown datatype {c.get('Datatype')!r}")
            elif not (c.get("Field") and c.get("Fields")):
                if c["Operator"] != "has-root-span" and not (c.get("Field") or c.get("Fields")):
                    found.append(f"{here}: Field or Fields is needed")
                try:
                    compile_test(_condition(c))
                except ConditionError as e:
                    found.append(f"{here}: {e}")
    return found


def _condition(c: dict) -> Condition:
    return Condition.of(c.get("Field"), c.get("Operator", ""), c.get("Value"), c.get("Datatype") or "", tuple(c.get("Fields") or ()))


def _sampler(choice: dict, peers: int):
    (kind, body), = choice.items()
    body = body or {}
    if kind == "RulesBasedSampler":
        return RuleSet(tuple(_rule(r, peers) for r in body.get("Rules") or []), bool(body.get("CheckNestedFields")))
    make, names = _KINDS[kind]
    given = {}
    for n, v in body.items():
        to = names[n]
        if to == "peers":
            given[to] = peers if v else 1
        elif to in _TIMES:
            given[to] = max(1, round(seconds(v)))
        elif to == "fields":
            given[to] = tuple(v)
        elif to is not None:
            given[to] = v
    known = {f.name for f in fields_of(make)}
    return make(**{k: v for k, v in given.items() if k in known})


def _rule(r: dict, peers: int) -> Rule:
    conditions = None if r.get("Conditions") is None else tuple(map(_condition, r["Conditions"]))
    sampler = _sampler(r["Sampler"], peers) if r.get("Sampler") else None
    return Rule(r.get("Name", ""), conditions, int(r.get("SampleRate", 0) or 0), bool(r.get("Drop")), r.get("Scope", "trace") or "trace", sampler)


def samplers(body: dict, peers: int = 1) -> dict[str, object]:
    """Samplers by environment or dataset; raises RulesError with all messages."""
    if problems := validate(body):
        raise RulesError(problems)
    return {name: _sampler(choice, peers) for name, choice in body["Samplers"].items()}


def lookup(known: dict[str, object], key: str) -> object:
    """The sampler of that name, else the default."""
    return known.get(key, known[DEFAULT])


class Reloading:
    """Samplers that follow their files: ``now()`` reads them again and rebuilds samplers only when the digest changed."""

    def __init__(self, places: list[str], peers: int = 1):
        self.places, self.peers, self.digest, self.known = places, peers, "", {}

    def now(self) -> dict[str, object]:
        document = read(self.places)
        if document.digest != self.digest:
            self.known, self.digest = samplers(document.body, self.peers), document.digest
        return self.known


#: Version 1 names of samplers' fields whose unit is part of the name.
_OLD_TIMES = {"ClearFrequencySec": "ClearFrequency", "AdjustmentIntervalSec": "AdjustmentInterval"}


def from_version_1(old: dict) -> dict:
    """A version 1 document as version 2: datasets become samplers, seconds durations; names are matched whatever their case."""
    known = {n.lower(): n for _, names in _KINDS.values() for n in names} | {n.lower(): n for n in (*_RULE, *_CONDITION, *_OLD_TIMES, "CheckNestedFields")}
    out: dict[str, dict] = {}

    def proper(body: dict) -> dict:
        fixed = {}
        for k, v in body.items():
            name = known.get(k.lower(), k)
            if name in _OLD_TIMES:
                fixed[_OLD_TIMES[name]] = f"{v}s"
            elif isinstance(v, dict):
                fixed[name] = _choice(v) if name == "Sampler" else proper(v)
            else:
                fixed[name] = v
        return fixed

    def _choice(body: dict) -> dict:
        kind = next((v for k, v in body.items() if k.lower() == "sampler"), "DeterministicSampler")
        if any(k in _KINDS for k in body):
            return {k: proper(v) for k, v in body.items() if k in _KINDS}
        rest = {k: v for k, v in body.items() if k.lower() not in ("sampler", "addsamplerateketytotrace", "addsampleratekeytotrace", "addsampleratekeytotracefield", "rule")}
        if kind == "RulesBasedSampler":
            rules = next((v for k, v in body.items() if k.lower() in ("rule", "rules")), [])
            made = []
            for r in rules:
                r = {k.lower(): v for k, v in r.items()}
                new = {known[k]: v for k, v in r.items() if k in ("name", "samplerate", "drop", "scope")}
                if conditions := r.get("condition", r.get("conditions")):
                    new["Conditions"] = [proper(c) for c in conditions]
                if r.get("sampler"):
                    new["Sampler"] = {k: proper(v) for k, v in r["sampler"].items()}
                made.append(new)
            return {kind: {"Rules": made} | ({"CheckNestedFields": True} if any(k.lower() == "checknestedfields" and v for k, v in body.items()) else {})}
        allowed = _KINDS.get(kind, (None, {}))[1]
        return {kind: {k: v for k, v in proper(rest).items() if k in allowed}}

    top = {k: v for k, v in old.items() if not isinstance(v, dict)}
    out[DEFAULT] = _choice(top)
    for name, body in old.items():
        if isinstance(body, dict) and any(k.lower() == "sampler" for k in body):
            out[name] = _choice(body)
    return {"RulesVersion": VERSION, "Samplers": out}
