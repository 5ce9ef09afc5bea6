"""Tabular and structured text: CSV, JSON, YAML, TOML and Markdown tables, as sheets of typed cells.

Sheets are a dict of name to rows; row 0 is the header; a cell is None, bool, int, float or str.
"""

from __future__ import annotations

import csv
import functools
import io
import json
import math
import re
import tomllib
from types import ModuleType

from ..operators.html import table_text

#: TOML has no null, no root but a table, and no integer over 64 bits: such a value is kept as JSON under this key.
ENVELOPE = "__docframe_json_value_v1"
LARGEST = (1 << 63) - 1
Cell = None | bool | int | float | str
Sheets = dict[str, list[list[Cell]]]


class DataError(ValueError):
    """The data can't be read, or not be represented in the target format."""


# ---- values


def load(text: str, fmt: str) -> object:
    try:
        if fmt == "json":
            return json.loads(text)
        if fmt == "yaml":
            return _load_yaml(text)
        value = tomllib.loads(text)
    except (ValueError, RecursionError) as e:
        raise DataError(f"{fmt}: {e}") from None
    if list(value) == [ENVELOPE]:
        return json.loads(value[ENVELOPE])
    return _plain(value)


def _plain(value: object) -> object:
    """TOML's dates and times as text."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value if isinstance(value, (str, bool, int, float)) else str(value)


@functools.cache
def _yaml() -> tuple[ModuleType, type, type]:
    """PyYAML, its loader and its dumper, by the C library where PyYAML was built with it: in Python they take ten times as long."""
    import yaml

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        """Only true and false are booleans, and dates are text."""

    Loader.yaml_implicit_resolvers = {c: [(tag, r) for tag, r in rs if tag not in ("tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:bool")] for c, rs in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile("^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    return yaml, Loader, getattr(yaml, "CSafeDumper", yaml.SafeDumper)


def _load_yaml(text: str) -> object:
    yaml, loader, _ = _yaml()
    try:
        return yaml.load(text, loader)  # noqa: S506  a SafeLoader
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from None


def dump(value: object, fmt: str) -> str:
    if fmt == "json":
        return json.dumps(value, ensure_ascii=False, indent=2)
    if fmt == "yaml":
        yaml, _, dumper = _yaml()
        return yaml.dump(value, Dumper=dumper, sort_keys=False, allow_unicode=True)
    if not isinstance(value, dict) or _beyond_toml(value) or list(value) == [ENVELOPE]:
        value = {ENVELOPE: json.dumps(value, ensure_ascii=False, indent=2)}
    return _toml(value)


def _beyond_toml(value: object) -> bool:
    if isinstance(value, dict):
        return any(map(_beyond_toml, value.values()))
    if isinstance(value, list):
        return any(map(_beyond_toml, value))
    return value is None or isinstance(value, int) and not isinstance(value, bool) and abs(value) > LARGEST


def _toml_key(key: str) -> str:
    return key if re.fullmatch("[A-Za-z0-9_-]+", key) else _toml_string(key)


def _toml_string(text: str) -> str:
    return json.dumps(text, ensure_ascii=False).replace("\x7f", "\\u007f")


def _toml_value(v: object) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else ("inf" if v > 0 else "-inf") if math.isinf(v) else repr(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, str):
        return _toml_string(v)
    if isinstance(v, list):
        return "[" + ", ".join(map(_toml_value, v)) + "]"
    return "{ " + ", ".join(f"{_toml_key(k)} = {_toml_value(x)}" for k, x in v.items()) + " }" if v else "{}"


def _toml(table: dict, path: tuple[str, ...] = ()) -> str:
    out = "".join(f"{_toml_key(k)} = {_toml_value(v)}\n" for k, v in table.items() if not isinstance(v, dict) and not _tables(v))
    for k, v in table.items():
        name = ".".join(map(_toml_key, (*path, k)))
        if isinstance(v, dict):
            out += f"\n[{name}]\n" + _toml(v, (*path, k))
        elif _tables(v):
            out += "".join(f"\n[[{name}]]\n" + _toml(row, (*path, k)) for row in v)
    return out


def _tables(v: object) -> bool:
    return isinstance(v, list) and bool(v) and all(isinstance(x, dict) for x in v)


# ---- sheets


def cell_of(value: object) -> Cell:
    """A cell of a JSON value: integers that don't fit become floats, nested values their compact JSON."""
    if isinstance(value, (dict, list)):
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    if isinstance(value, int) and not isinstance(value, bool) and not -LARGEST - 1 <= value <= LARGEST:
        return float(value)
    return value


def number(value: float) -> int | float:
    """A float without fraction, in range, is an integer."""
    return int(value) if math.isfinite(value) and value == int(value) and -LARGEST - 1 <= value <= LARGEST else value


def cell_text(cell: Cell) -> str:
    """A cell as text: whole floats without a point, no exponents."""
    if cell is None:
        return ""
    if isinstance(cell, bool):
        return str(cell).lower()
    if isinstance(cell, float):
        if not math.isfinite(cell):
            return "NaN" if math.isnan(cell) else "inf" if cell > 0 else "-inf"
        if cell == int(cell):
            return str(int(cell)) if cell or math.copysign(1, cell) > 0 else "-0"
        from decimal import Decimal

        return format(Decimal(repr(cell)), "f")
    return str(cell)


def rows_of(records: list) -> list[list[Cell]]:
    """Header in the order in which keys first occur, then a row for each object."""
    if not all(isinstance(r, dict) for r in records):
        raise DataError("rows must be objects")
    header = list(dict.fromkeys(k for r in records for k in r))
    return [list(header), *[[cell_of(r.get(k)) for k in header] for r in records]]


def sheets_of(value: object) -> Sheets:
    """Sheets of an array of objects, of {"rows": [...]}, or of an object of arrays."""
    if isinstance(value, dict) and list(value) == ["rows"]:
        value = value["rows"]
    if isinstance(value, list):
        return {"Sheet1": rows_of(value)}
    if isinstance(value, dict) and all(isinstance(v, list) for v in value.values()):
        return {k: rows_of(v) for k, v in sorted(value.items())}
    raise DataError("data must be an array of objects, or an object of such arrays")


def value_of(sheets: Sheets, fmt: str = "json") -> object:
    def records(rows: list[list[Cell]]) -> list[dict]:
        finite = lambda c: None if isinstance(c, float) and not math.isfinite(c) else c
        names = [cell_text(c) for c in rows[0]] if rows else []
        return [{n: finite(r[k] if k < len(r) else None) for k, n in enumerate(names)} for r in rows[1:]]

    if len(sheets) == 1:
        only = records(next(iter(sheets.values())))
        return {"rows": only} if fmt == "toml" else only
    return {k: records(rows) for k, rows in sorted(sheets.items())}


def is_document(value: object) -> bool:
    """Whether a structured value is a document tree and not data."""
    return isinstance(value, dict) and "blocks" in value


def read_csv(text: str, delimiter: str = ",") -> Sheets:
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, strict=True) if r]
    for k, r in enumerate(rows):
        if len(r) != len(rows[0]):
            raise DataError(f"record {k + 1} has {len(r)} fields; expected {len(rows[0])}")
    return {"Sheet1": rows}


def write_csv(sheets: Sheets, delimiter: str = ",") -> str:
    """The first sheet by name."""
    out = io.StringIO(newline="")
    writer = csv.writer(out, delimiter=delimiter, lineterminator="\n")
    for row in sheets[min(sheets)] if sheets else []:
        writer.writerow([cell_text(c) for c in row])
    return out.getvalue()


def parse_row(line: str) -> list[str]:
    cells, cell, k = [], "", 0
    line = line.strip().strip("|")
    while k < len(line):
        if line[k] == "\\" and line[k + 1 : k + 2] in ("|", "\\"):
            cell, k = cell + line[k + 1], k + 2
        elif line[k] == "|":
            cells.append(cell)
            cell, k = "", k + 1
        else:
            cell, k = cell + line[k], k + 1
    return [c.strip().replace("<br>", "\n") for c in [*cells, cell]]


def parse_table(text: str) -> list[list[str]]:
    """Rows of the lines with bars; none without a header and its separator."""
    rows = [parse_row(l) for l in text.splitlines() if "|" in l]
    if len(rows) < 2 or len(rows[0]) != len(rows[1]) or not all(re.fullmatch(":*-{3,}:*", c) for c in rows[1]):
        return []
    for k, r in enumerate(rows[2:], 3):
        if len(r) != len(rows[0]):
            raise DataError(f"row {k} has {len(r)} cells; expected {len(rows[0])}")
    return [rows[0], *rows[2:]]


def markdown_sheets(text: str) -> Sheets:
    """Tables under `## name` headings; the last of equal names wins."""
    found: Sheets = {}
    name, lines = "Sheet1", []
    for line in [*text.splitlines(), "## "]:
        if line.strip().startswith("## ") or line == "## ":
            rows = parse_table("\n".join(lines))
            if rows:
                found[name] = rows
            name, lines = line.strip()[2:].strip(), []
        elif "|" in line:
            lines.append(line)
    return found


def sheets_markdown(sheets: Sheets, level: int = 2) -> str:
    """Sheets as tables, under their names if there is more than one."""
    texts = {n: table_text([[cell_text(c) for c in r] for r in rows]) for n, rows in sorted(sheets.items()) if rows}
    if len(texts) == 1 and level == 0:
        return next(iter(texts.values()))
    return "\n\n".join(f"{'#' * max(level, 1)} {n}\n\n{t}" for n, t in texts.items())
