"""Requests: JSON objects checked strictly and turned into nodes."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from typing import Any

from .spec import NEEDED, Const, Name, Node, RequestError, load

RESERVED = ("time", "code")
FAMILIES = ("DIRECT", "TS", "CS")


def parse_node(value: Any, where: str = "derivative") -> Node:
    if isinstance(value, Node):
        return value
    if not isinstance(value, dict):
        raise RequestError(f"{where} must be an object")
    allowed = {"type", "op", "fields", "params", "on"}
    if extra := set(value) - allowed:
        raise RequestError(f"{where}: unknown keys {sorted(extra)}")
    name = value.get("op")
    op = load().get(name) if isinstance(name, str) else None
    if op is None:
        raise RequestError(f"{where}: no operator {name!r}")
    if value.get("type") != op.family:
        raise RequestError(f"{where}: {name} is of type {op.family}")
    given = value.get("fields")
    if not isinstance(given, dict):
        raise RequestError(f"{where}: fields must be an object")
    if set(given) != {f.name for f in op.fields}:
        raise RequestError(f"{where}: {name} takes the fields {[f.name for f in op.fields]}")
    operands = []
    for f in op.fields:
        x, at = given[f.name], f"{where}.{f.name}"
        if f.many:
            if not isinstance(x, list) or not x:
                raise RequestError(f"{at} must be a list of at least one operand")
            operands.append(tuple(_operand(v, f.boolean, f"{at}[{i}]") for i, v in enumerate(x)))
        else:
            operands.append(_operand(x, f.boolean, at))
    given = value.get("params")
    if not isinstance(given, dict):
        raise RequestError(f"{where}: params must be an object")
    if extra := set(given) - set(op.params):
        raise RequestError(f"{where}: {name} has no parameters {sorted(extra)}")
    params = {}
    for k, p in op.params.items():
        if k in given:
            params[k] = p.check(f"{where}.{k}", given[k])
        elif p.default is NEEDED:
            raise RequestError(f"{where}: {name} needs {k}")
        else:
            params[k] = p.default
    if op.rule:
        op.rule(params)
    on = None
    if "on" in value and value["on"] is not None:
        if op.family == "DIRECT":
            raise RequestError(f"{where}: on is for TS and CS operators")
        on = _operand(value["on"], True, f"{where}.on")
    return Node(op, tuple(operands), tuple((k, tuple(v) if isinstance(v, list) else v) for k, v in params.items()), on)


def _operand(value: Any, boolean: bool, where: str):
    if isinstance(value, str):
        if not value.strip():
            raise RequestError(f"{where}: an empty name")
        return Name(value.strip())
    if isinstance(value, (dict, Node)):
        node = parse_node(value, where)
        if boolean and node.output != "BOOL":
            raise RequestError(f"{where} must be BOOL, {node.op.name} gives {node.output}")
        return node
    if isinstance(value, bool) or (isinstance(value, (int, float)) and not boolean):
        if isinstance(value, float) and value - value != 0:
            raise RequestError(f"{where} must be finite")
        return Const(value)
    raise RequestError(f"{where}: {value!r} is no operand")


def references(node: Node) -> tuple[set[str], set[str], set[str]]:
    """Names that a tree refers to: all of them, those of `on`, those where BOOL is asked for."""
    every, on, boolean = set(), set(), set()

    def walk(n: Node):
        for f, x in zip(n.op.fields, n.fields):
            for v in x if isinstance(x, tuple) else (x,):
                if isinstance(v, Name):
                    every.add(v.name)
                    if f.boolean:
                        boolean.add(v.name)
                elif isinstance(v, Node):
                    walk(v)
        if isinstance(n.on, Name):
            every.add(n.on.name)
            on.add(n.on.name)
        elif isinstance(n.on, Node):
            walk(n.on)

    walk(node)
    return every, on, boolean


def parse_date(value: Any, where: str) -> dt.date:
    if not isinstance(value, str) or not re.fullmatch(r"\d{4}-\d\d-\d\d", value):
        raise RequestError(f"{where} must be YYYY-MM-DD")
    try:
        return dt.date.fromisoformat(value)
    except ValueError as e:
        raise RequestError(f"{where}: {e}") from None


def parse_lookback(value: Any) -> dt.timedelta:
    """A timedelta, or '60D', 'P60D', 'P2W', 'P1DT12H', '3 days', '12:30:00'."""
    if isinstance(value, dt.timedelta):
        out = value
    elif isinstance(value, str):
        number = r"(?:(\d+(?:\.\d+)?)\s*{}\s*)?"
        m = re.fullmatch(r"P?\s*" + number.format("(?:W|weeks?)") + number.format("(?:D|days?)") + "T?" + number.format("H") + number.format("M") + number.format("S"), value.strip(), re.I)
        clock = re.fullmatch(r"(?:(\d+)\s*(?:D|days?,?)?\s+)?(\d+):(\d\d)(?::(\d\d))?", value.strip(), re.I)
        if m and any(m.groups()):
            w, d, h, mi, s = (float(x or 0) for x in m.groups())
            out = dt.timedelta(weeks=w, days=d, hours=h, minutes=mi, seconds=s)
        elif clock:
            d, h, mi, s = (int(x or 0) for x in clock.groups())
            out = dt.timedelta(days=d, hours=h, minutes=mi, seconds=s)
        else:
            raise RequestError(f"lookback: {value!r} is no duration")
    else:
        raise RequestError("lookback must be a duration")
    if out < dt.timedelta(0):
        raise RequestError("lookback may not be negative")
    return out


def name_list(value: Any, where: str, distinct: bool = True) -> list[str]:
    if not isinstance(value, list) or not all(isinstance(x, str) and x.strip() for x in value):
        raise RequestError(f"{where} must be a list of names")
    out = [x.strip() for x in value]
    if distinct and len(set(out)) < len(out):
        raise RequestError(f"{where} repeats a name")
    return out


@dataclass
class Query:
    """A checked query. codes empty: all of the market."""

    start: dt.date
    end: dt.date
    codes: list[str]
    lookback: dt.timedelta = dt.timedelta(0)
    factors: list[str] = field(default_factory=list)
    derivatives: dict[str, Node] = field(default_factory=dict)
    filters: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, value: Any) -> Query:
        if isinstance(value, Query):
            return value
        if not isinstance(value, dict):
            raise RequestError("a query must be an object")
        keys = {"start_date", "end_date", "lookback", "codes", "factors", "derivatives", "filters"}
        if extra := set(value) - keys:
            raise RequestError(f"unknown keys {sorted(extra)}")
        if missing := {"start_date", "end_date", "codes"} - set(value):
            raise RequestError(f"missing keys {sorted(missing)}")
        start, end = parse_date(value["start_date"], "start_date"), parse_date(value["end_date"], "end_date")
        if start > end:
            raise RequestError("start_date lies after end_date")
        given = value.get("derivatives", {})
        if not isinstance(given, dict):
            raise RequestError("derivatives must be an object")
        derivatives: dict[str, Node] = {}
        for raw, node in given.items():
            name = raw.strip() if isinstance(raw, str) else ""
            if not name or name in derivatives:
                raise RequestError(f"derivatives: {raw!r} is empty or repeats a name")
            derivatives[name] = parse_node(node, f"derivatives[{name!r}]")
        q = cls(start, end, name_list(value["codes"], "codes"), parse_lookback(value.get("lookback", dt.timedelta(0))), name_list(value.get("factors", []), "factors"), derivatives, name_list(value.get("filters", []), "filters"))
        q.check()
        return q

    def check(self) -> None:
        if not self.factors and not self.derivatives:
            raise RequestError("a query needs factors or derivatives")
        for where, names in (("factors", self.factors), ("derivatives", self.derivatives)):
            if bad := set(names) & set(RESERVED):
                raise RequestError(f"{where} may not use {sorted(bad)}")
        if bad := set(self.factors) & set(self.derivatives):
            raise RequestError(f"names of both a factor and a derivative: {sorted(bad)}")

        def all_bool(names, what):
            for n in sorted(names):
                if n not in self.derivatives:
                    raise RequestError(f"{what} {n!r} is no derivative")
                if self.derivatives[n].output != "BOOL":
                    raise RequestError(f"{what} {n!r} must be BOOL")

        all_bool(self.filters, "filter")
        needs = {}
        for name, node in self.derivatives.items():
            every, on, boolean = references(node)
            all_bool(on, f"{name}: on")
            all_bool(boolean & set(self.derivatives), f"{name}: operand")
            needs[name] = every & set(self.derivatives)
        self.order = topological(needs)

    def source_factors(self) -> list[str]:
        """Stored factors to load: those asked for, then those that derivatives use, sorted."""
        used = set().union(*(references(n)[0] for n in self.derivatives.values()), set())
        return [*self.factors, *sorted(used - set(self.factors) - set(self.derivatives) - set(RESERVED))]


def topological(needs: dict[str, set[str]]) -> list[str]:
    """Names with what they need first; a cycle is refused."""
    done: list[str] = []
    left = {k: set(v) for k, v in needs.items()}
    while left:
        ready = [k for k, v in left.items() if not v & set(left)]
        if not ready:
            at = next(iter(left))
            path = [at]
            while True:
                at = sorted(left[at] & set(left))[0]
                if at in path:
                    raise RequestError("derivatives form a cycle: " + " -> ".join([*path[path.index(at) :], at]))
                path.append(at)
        done += ready
        for k in ready:
            del left[k]
    return done
