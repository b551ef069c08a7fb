"""Operator declarations: fields, parameters and output kind, and the registry that operators enter by decoration."""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from ..functions.scan import run as run_scan


class RequestError(ValueError):
    """A request that can't be run as it stands."""


class _Needed:
    def __repr__(self) -> str:
        return "needed"


NEEDED = _Needed()


@dataclass(frozen=True)
class Param:
    """A parameter's type and range. kind: int, float, bool, choice, scalar, scalars."""

    kind: str
    default: Any = NEEDED
    ge: float | None = None
    gt: float | None = None
    le: float | None = None
    lt: float | None = None
    choices: tuple = ()

    def check(self, name: str, value: Any) -> Any:
        if value is None and self.kind != "scalar":
            if self.default is None:
                return None
            raise RequestError(f"{name} may not be null")
        if self.kind == "int":
            good = isinstance(value, int) and not isinstance(value, bool)
        elif self.kind == "float":
            good = isinstance(value, (int, float)) and not isinstance(value, bool)
        elif self.kind == "bool":
            good = isinstance(value, bool)
        elif self.kind == "choice":
            good = any(type(value) is type(c) and value == c for c in self.choices)
        elif self.kind == "scalar":
            good = value is None or isinstance(value, (str, int, float, bool))
        else:
            good = isinstance(value, list) and len(value) > 0 and all(v is None or isinstance(v, (str, int, float, bool)) for v in value)
        if not good:
            raise RequestError(f"{name}: {value!r} is not {'one of ' + repr(self.choices) if self.choices else 'of kind ' + self.kind}")
        for v in value if isinstance(value, list) else [value]:
            if isinstance(v, float) and not math.isfinite(v):
                raise RequestError(f"{name} must be finite")
        if self.kind in ("int", "float"):
            for limit, bad, sign in ((self.ge, lambda x: value < x, ">="), (self.gt, lambda x: value <= x, ">"), (self.le, lambda x: value > x, "<="), (self.lt, lambda x: value >= x, "<")):
                if limit is not None and bad(limit):
                    raise RequestError(f"{name}: {value!r} must be {sign} {limit}")
        return float(value) if self.kind == "float" else value


def Int(default: Any = NEEDED, **limits) -> Param:
    return Param("int", default, **limits)


def Float(default: Any = NEEDED, **limits) -> Param:
    return Param("float", default, **limits)


def Bool(default: Any = NEEDED) -> Param:
    return Param("bool", default)


def Choice(*choices, default: Any = NEEDED) -> Param:
    return Param("choice", default, choices=choices)


def Scalar(default: Any = NEEDED) -> Param:
    return Param("scalar", default)


def Scalars() -> Param:
    return Param("scalars")


@dataclass(frozen=True)
class Field:
    name: str
    boolean: bool = False
    many: bool = False


@dataclass(frozen=True, eq=False)
class Operator:
    """build gets a Frame (TS, CS), then the field columns and the parameters; it returns a column, or, as a generator, first yields columns that have to stand in a projection of their own. Kernels get series instead and return an array; joint ones get all series of a pass at once, with the Rows that tell them apart. scan: the operator as a recurrence (functions.scan), chunk: as a joint kernel, for series in chunks."""

    family: str
    name: str
    fields: tuple[Field, ...]
    params: dict[str, Param]
    output: str
    build: Callable
    rule: Callable | None = None
    kernel: bool = False
    joint: bool = False
    scan: Callable | None = None
    chunk: Callable | None = None
    doc: str = ""
    kind_of: Callable | None = None

    @property
    def staged(self) -> bool:
        return inspect.isgeneratorfunction(self.build)


OPERATORS: dict[str, Operator] = {}


def operator(family: str, name: str, fields: str = "col", output: str = "NUMBER", rule: Callable | None = None, kernel: bool = False, joint: bool = False, kind_of: Callable | None = None, params: dict[str, Param] | None = None, recurrence: bool = False, scan: Callable | None = None, chunk: Callable | None = None):
    """Registers the function below as operator `name`. fields: names by blanks; a trailing ? asks for BOOL, a trailing + for a list. recurrence: the function is one, and whole series run it as well; scan, chunk: other forms for series in chunks alone."""

    def enter(f):
        build = (lambda rows, *x, **p: run_scan(rows, f(*x, **p))) if recurrence else f
        if name in OPERATORS:
            raise RuntimeError(f"operator {name} is declared twice")
        declared = tuple(Field(x.rstrip("?+"), "?" in x, "+" in x) for x in fields.split())
        OPERATORS[name] = Operator(family, name, declared, dict(params or {}), output, build, rule, kernel or joint or recurrence, joint or recurrence, f if recurrence else scan, chunk, inspect.getdoc(f) or "", kind_of)
        return f

    return enter


@dataclass(frozen=True)
class Node:
    """An application of an operator. Operands are nodes, names (Name) or constants."""

    op: Operator
    fields: tuple
    params: tuple
    on: Any = None

    @property
    def output(self) -> str:
        return self.op.kind_of(dict(self.params)) if self.op.kind_of else self.op.output

    def operands(self):
        for f in self.fields:
            yield from f if isinstance(f, tuple) else (f,)


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Const:
    """A number or truth value; type matters, so 1, 1.0 and True differ."""

    value: Any
    type: type = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "type", type(self.value))


def load() -> dict[str, Operator]:
    """All operators; their modules are imported on first use."""
    from ..operators import cross_section, direct, indicators, time_series  # noqa: F401

    return OPERATORS
