"""Deeply nested JSON records as flat tables, by columnar shredding.

A record is first cut into one column per leaf path, each entry with its repetition level (the repeated ancestor
at which it repeats) and its definition level (how many steps of its path are there). Tables are then rebuilt per
repeated ancestor from these level sequences alone: repetition levels give the place in every enclosing array,
definition levels tell a missing ancestor from an empty value. Both steps touch one record at a time, so they need
no shuffle; they walk with stacks of their own, so that depth isn't bounded by Python's recursion limit.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.session import latest_by

EACH = "[]"
OWN = ""
Path = tuple[str, ...]
Columns = dict[Path, list[tuple[int, int, Any]]]
_GONE = object()


def parse_whole(text: Any) -> Any:
    """The JSON value, also when it is JSON within a JSON string; a byte-order mark before it doesn't count. None if it isn't whole JSON."""
    value = text
    while isinstance(value, str):
        try:
            value = json.loads(value.lstrip("\ufeff"))  # each turn takes off a pair of quotes, so it ends
        except (ValueError, RecursionError):
            return None
    return value


def _steps(record: Any, arrays: frozenset[str]) -> dict[Path, dict[str, None]]:
    """The record's own schema: below each path the keys, EACH for an array's elements, OWN for a scalar."""
    found: dict[Path, dict[str, None]] = {}
    todo: list[tuple[Path, Any]] = [((), record)]
    while todo:
        path, value = todo.pop()
        here = found.setdefault(path, {})
        if isinstance(value, dict) and path and path[-1] in arrays:
            value = [value]
        if isinstance(value, dict):
            here.update(dict.fromkeys(map(_key, value)))
            todo.extend(((*path, _key(k)), v) for k, v in value.items())
        elif isinstance(value, list):
            here[EACH] = None
            todo.extend(((*path, EACH), v) for v in value)
        else:
            here[OWN] = None
    return found


def _key(name: str) -> str:
    """A key that isn't taken for EACH or OWN."""
    return f"{name} " if name in (EACH, OWN) else name


def shred(record: Any, arrays: frozenset[str] = frozenset()) -> Columns:
    """Columns of (repetition level, definition level, value) by leaf path, each in record order.

    ``arrays`` names keys under which a single object stands for an array of one. A step that an element lacks
    leaves an entry with a lower definition level in every leaf column below it, so all columns of one ancestor
    have one entry per element.
    """
    schema = _steps(record, arrays)
    columns: Columns = {}
    todo: list[tuple[Path, Any, int, int]] = [((), record, 0, 0)]
    while todo:
        path, value, rep, level = todo.pop()
        if isinstance(value, dict) and path and path[-1] in arrays:
            value = [value]
        named = {_key(k): v for k, v in value.items()} if isinstance(value, dict) else {}
        below: list[tuple[Path, Any, int, int]] = []
        for step in schema.get(path, {OWN: None}):
            if step == OWN:
                scalar = None if value is _GONE or isinstance(value, (dict, list)) else value
                columns.setdefault(path, []).append((rep, level, scalar))
            elif step == EACH and isinstance(value, list) and value:
                depth = path.count(EACH) + 1
                below += [((*path, EACH), v, depth if i else rep, level + 1) for i, v in enumerate(value)]
            elif step != EACH and step in named:
                below.append(((*path, step), named[step], rep, level + 1))
            else:
                below.append(((*path, step), _GONE, rep, level))
        todo.extend(reversed(below))
    return columns


def elements(columns: Columns, ancestor: Path) -> list[tuple[int, ...]]:
    """The place, in all enclosing arrays, of each element of a repeated ancestor (of the record itself for ())."""
    spine = next((p for p in columns if p[: len(ancestor)] == ancestor), None)
    return [] if spine is None else [at for at, _ in _walk(columns[spine], ancestor)]


def values(columns: Columns, ancestor: Path, field: Path) -> list[Any]:
    """The scalar at ``field`` below each element of ``ancestor``, in the order of ``elements``; None where it lacks."""
    column = columns.get((*ancestor, *field))
    return [v for _, v in _walk(column, ancestor)] if column else [None] * len(elements(columns, ancestor))


def _walk(column: list[tuple[int, int, Any]], ancestor: Path) -> Iterator[tuple[tuple[int, ...], Any]]:
    depth, at = ancestor.count(EACH), [0] * ancestor.count(EACH)
    for rep, level, value in column:
        if rep > depth:
            continue
        if rep:
            at[rep - 1] += 1
            at[rep:] = [0] * (depth - rep)
        else:
            at = [0] * depth
        if level >= len(ancestor):
            yield tuple(at), value


def repeated_below(columns: Columns, start: Path, child: str) -> list[Path]:
    """The ancestor paths start[], start[].child[], start[].child[].child[] and so on, as far as they exist."""
    found, path, deepest = [], (*start, EACH), max((len(p) for p in columns), default=0)
    while len(path) <= deepest and any(p[: len(path)] == path for p in columns):
        found.append(path)
        path = (*path, child, EACH)
    return found


def whole_number(value: Any) -> int | None:
    """A number, or a number's text, rounded half up to a whole number; None for anything else."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return None
    if isinstance(value, float) and not math.isfinite(value):
        return None
    try:
        number = Decimal(str(value).strip())
        return int(number.to_integral_value(ROUND_HALF_UP)) if number.is_finite() else None
    except (InvalidOperation, ValueError):
        return None


def _joined_box(numbers: list[Any]) -> str | None:
    whole = [whole_number(n) for n in numbers]
    return ",".join(map(str, whole)) if len(whole) == 4 and None not in whole else None


def _rows_of(payload: Any) -> Iterator[tuple[str, str, str, int, str | None]]:
    """kind, node_path, parent_path, pos, node_text of one payload."""
    record = parse_whole(payload)
    if not isinstance(record, dict):
        return
    columns = shred(record, frozenset({"normalizedIngredients", "children", "lines"}))
    for ancestor in repeated_below(columns, ("normalizedIngredients",), "children"):
        own = values(columns, ancestor, ())
        raw, position = values(columns, ancestor, ("raw",)), values(columns, ancestor, ("position",))
        filled = _filled(columns, ancestor)
        for i, at in enumerate(elements(columns, ancestor)):
            if at not in filled:
                continue
            path, text = ".".join(map(str, at)), raw[i] if raw[i] is not None else own[i]
            pos = whole_number(position[i])
            yield "ingredient", path, path.rpartition(".")[0], -1 if pos is None else pos, None if text is None else str(text)
    top: Path = ("candidate",) if isinstance(record.get("candidate"), dict) else ()
    for owner in (top, (*top, "lines", EACH)):
        sides = [values(columns, owner, ("boundingBox", side)) for side in ("x", "y", "width", "height")]
        listed: dict[tuple[int, ...], list[Any]] = {}
        spot = (*owner, "boundingBox", EACH)
        for at, number in zip(elements(columns, spot), values(columns, spot, ())):
            listed.setdefault(at[:-1], []).append(number)
        for i, at in enumerate(elements(columns, owner)):
            box = _joined_box(listed[at]) if at in listed else _joined_box([s[i] for s in sides])
            if box:
                yield "box", ".".join(map(str, at)), "", -1, box


def _filled(columns: Columns, ancestor: Path) -> set[tuple[int, ...]]:
    """The elements that aren't null: one of their leaves is an object's or has a value."""
    found = set()
    for path, column in columns.items():
        if path[: len(ancestor)] == ancestor:
            found.update(at for (at, v), d in zip(_walk(column, ancestor), _levels(column, ancestor)) if d > len(ancestor) or v is not None)
    return found


def _levels(column: list[tuple[int, int, Any]], ancestor: Path) -> list[int]:
    return [level for rep, level, _ in column if rep <= ancestor.count(EACH) and level >= len(ancestor)]


FLAT = "decision_id string, kind string, node_path string, parent_path string, pos int, node_text string"


def flatten_payloads(decisions: DataFrame, *, id_column: str = "decision_id", payload: str = "payload", decided: str = "decided_at") -> DataFrame:
    """Ingredient nodes and bounding boxes of JSON payloads as flat rows with parent links.

    Defined cases: a payload that is null, empty, cut short, nested deeper than the JSON parser goes or no object
    gives no rows; JSON within a JSON string
    counts as JSON, also after a byte-order mark; a single object under normalizedIngredients, children or lines is an array of one; a null
    node keeps its place but gives no row, a node of plain text has it as its text; a position that isn't a number
    is -1; a box that isn't four numbers is none; a row delivered again counts once (the last decided of one id);
    a null id gives no rows; other columns are ignored.
    """
    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *row) for i, text in zip(batch["id"], batch["payload"]) for row in _rows_of(text)]
            yield pd.DataFrame(rows, columns=["decision_id", "kind", "node_path", "parent_path", "pos", "node_text"])

    once = latest_by(
        decisions.select(F.col(id_column).alias("id"), F.col(decided).alias("decided"), F.col(payload).alias("payload")).where(F.col("id").isNotNull()),
        ["id"],
        ["decided"],
    )
    return once.select("id", "payload").mapInPandas(explode, FLAT)
