"""Registered queries with their SQL, by area. Each module has a dict ``QUERIES`` of name -> (callable, sql or None)."""

from tracesift.queries import conditions, decisions, extract, routing, samplers, streams, timing, tracekeys

ALL = {}
for _module in (extract, conditions, decisions, tracekeys, samplers, timing, routing, streams):
    ALL.update(_module.QUERIES)
