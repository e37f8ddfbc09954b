"""Chunk tests: may a chunk hold a row that a filter keeps? Spark filters again, so a test may keep too much, never too little.

Comparisons follow Spark: NaN equals itself and is larger than any number; scans have no nulls.
"""

from __future__ import annotations

import json
from decimal import Decimal

import numpy as np


def _nan(x):
    return np.isnan(x) if isinstance(x, np.ndarray) and x.dtype.kind == "f" else isinstance(x, float) and x != x


def _compare(op: str, a: np.ndarray, v) -> np.ndarray:
    if isinstance(v, Decimal):
        v = int(v) if v == int(v) else float(v)
    if a.dtype.kind == "u" and a.dtype.itemsize == 8 or isinstance(v, int) and not isinstance(v, bool) and a.dtype.kind in "iu" and not -(2**63) <= v < 2**63:
        a = a.astype(object)  # Python integers compare exactly
    an, vn = _nan(a), _nan(v)
    with np.errstate(invalid="ignore"):
        equal = (a == v) | (an & vn)
        above = np.zeros(len(a), bool) if vn is True else np.asarray(a > v, bool) | an
    return {"eq": equal, "gt": above, "ge": above | equal, "lt": ~(above | equal), "le": ~above}[op].astype(bool)


def mask(test: tuple, columns: dict[str, np.ndarray]) -> np.ndarray | None:
    """Rows that pass a test (see translate); None if it says nothing."""
    op, name = test[0], test[1]
    if op == "not":
        inner = mask(test[1], columns)
        return None if inner is None else ~inner
    a = columns[name]
    if op in ("eq", "gt", "ge", "lt", "le"):
        return _compare(op, a, test[2])
    if op == "in":
        out = np.zeros(len(a), bool)
        for v in test[2]:
            if v is not None:
                out |= _compare("eq", a, v)
        return out
    if op == "null":
        return np.full(len(a), test[2])
    return np.array([getattr(x, op)(test[2]) for x in a], bool)


def column_of(test: tuple) -> str:
    return column_of(test[1]) if test[0] == "not" else test[1]


def translate(f) -> tuple | None:
    """A filter of Spark's data sources as a plain tuple: (operation, column, value); None if it isn't understood."""
    kind = f.kind
    if kind == "Not":
        inner = translate(f.child)
        return None if inner is None else ("not", inner)
    if len(getattr(f, "attribute", ())) != 1:
        return None
    name = f.attribute[0]
    simple = {"EqualTo": "eq", "GreaterThan": "gt", "GreaterThanOrEqual": "ge", "LessThan": "lt", "LessThanOrEqual": "le"}
    if kind in simple:
        return None if f.value is None else (simple[kind], name, f.value)
    if kind == "EqualNullSafe":
        return ("null", name, False) if f.value is None else ("eq", name, f.value)
    if kind == "In":
        return "in", name, list(f.value)
    if kind in ("IsNull", "IsNotNull"):
        return "null", name, kind == "IsNotNull"
    text = {"StringStartsWith": "startswith", "StringEndsWith": "endswith", "StringContains": "__contains__"}
    return (text[kind], name, f.value) if kind in text else None


def pack(tests: list[tuple]) -> str:
    """Tests as a text, for an option of a scan."""
    def plain(x):
        if isinstance(x, float):
            return {"float": x.hex()}
        return {"decimal": str(x)} if isinstance(x, Decimal) else [plain(y) for y in x] if isinstance(x, (list, tuple)) else x

    return json.dumps([plain(t) for t in tests])


def unpack(text: str) -> list[tuple]:
    def value(x):
        if isinstance(x, dict):
            return float.fromhex(x["float"]) if "float" in x else Decimal(x["decimal"])
        return [value(y) for y in x] if isinstance(x, list) else x

    def test(x):
        return ("not", test(x[1])) if x[0] == "not" else tuple(value(y) for y in x)

    return [test(x) for x in json.loads(text or "[]")]


def passes(tests: list[tuple], columns: dict[str, np.ndarray]) -> bool:
    """Whether some row passes all tests."""
    held = None
    for t in tests:
        m = mask(t, columns)
        if m is not None:
            held = m if held is None else held & m
            if not held.any():
                return False
    return True
