"""Zipped packages as rows: their parts, what relates the parts, their elements, and lookups from one to the other."""

from __future__ import annotations

import functools
import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .batches import Run, Step, picking, pieces, small_batches, through
from .inheritance import written
from .relational import resolve_part

#: Rows of a lookup's smaller side that are broadcast at most.
MOST_BROADCAST = 100_000
#: Bytes of a part whose tree is held whole, which is a few times faster; a larger one is read element by element.
WHOLE_BYTES = 1 << 18


def package_parts(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, part, bytes, error): a row for each part of each package; one with an error for what is no package."""
    return through(files.select(*keys, content), opening)


def opening(given: T.StructType) -> tuple[Run, T.StructType]:
    """package_parts() as a step of batches whose last column is the package."""
    schema = T.StructType([*given[:-1], *T._parse_datatype_string("part string, bytes binary, error string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, -1):
            for k, data in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                rows: list[tuple[str | None, bytes | None, str | None]] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                        rows = [(n, z.read(n), None) for n in z.namelist() if not n.endswith("/")]
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError) as e:
                    rows = [(None, None, f"not a package: {e}")]
                owner = pa.array([k] * len(rows), pa.int32())
                made = [pa.array([r[x] for r in rows], t) for x, t in enumerate((pa.string(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*[c.take(owner) for c in batch.columns[:-1]], *made], names=schema.names)

    return run, schema


@functools.lru_cache(4096)
def _local(name: str) -> str:
    return name.rpartition("}")[2]


def _cast(t: T.DataType) -> Callable[[str], object]:
    def number(text: str) -> object:
        try:
            n = int(text) if isinstance(t, T.IntegerType) else float(text)
        except ValueError:
            return None
        return n if isinstance(n, float) or -(1 << 31) <= n < 1 << 31 else None

    return str if isinstance(t, T.StringType) else number


def _reader(t: T.StructType) -> Callable[[ET.Element], dict]:
    """From an XML element to a struct: fields `_name` are attributes, others child elements, arrays of all or structs of the last."""
    attributes = {f.name[1:]: (f.name, _cast(f.dataType)) for f in t if f.name.startswith("_")}
    children = {f.name: (isinstance(f.dataType, T.ArrayType), _reader(f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType)) for f in t if not f.name.startswith("_")}

    def read(e: ET.Element) -> dict:
        out: dict[str, object] = {}
        for k, v in e.attrib.items():
            if a := attributes.get(_local(k)):
                out[a[0]] = a[1](v)
        for c in e if children else ():
            name = _local(c.tag)
            if found := children.get(name):
                if found[0]:
                    out.setdefault(name, []).append(found[1](c))
                else:
                    out[name] = found[1](c)
        return out

    return read


def read_xml(parts: DataFrame, keys: list[str], shape: str) -> DataFrame:
    """(keys, x): each part as a struct of the shape, by local names; null for a part that is no XML.

    Spark's from_xml sets up a parser for each row, which takes milliseconds; this takes tens of microseconds. Parts of a
    batch that are alike are read once.
    """
    kind = T._parse_datatype_string(shape)
    schema = T.StructType([*parts.select(*keys).schema, T.StructField("x", kind)])
    into = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(kind)
        for batch in pieces(batches, -1):
            place: dict[bytes | None, int] = {}
            of = [place.setdefault(data, len(place)) for data in batch.column(batch.num_columns - 1).to_pylist()]
            found: list[dict | None] = []
            for data in place:
                try:
                    found.append(None if data is None else read(ET.fromstring(data)))
                except ET.ParseError:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, into).take(pa.array(of, pa.int32()))], names=schema.names)

    return parts.select(*keys, "bytes").mapInArrow(run, schema)


def relationships(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, part, rel_id, type, target, external): what each part refers to; targets inside the package are parts' names."""
    shape = "struct<Relationship: array<struct<_Id: string, _Type: string, _Target: string, _TargetMode: string>>>"
    rels = parts.where(F.col("part").endswith(".rels"))
    owner = F.regexp_replace(F.regexp_replace("part", r"_rels/([^/]*)$", "$1"), r"\.rels$", "")
    each = read_xml(rels.withColumn("part", owner), [*keys, "part"], shape).select(*keys, "part", F.explode("x.Relationship").alias("r"))
    external = F.coalesce(F.col("r._TargetMode") == "External", F.lit(False))
    folder = F.regexp_replace("part", "[^/]*$", "")
    path = F.when(F.col("r._Target").startswith("/"), F.col("r._Target")).otherwise(F.concat(folder, "r._Target"))
    target = F.when(external, F.col("r._Target")).otherwise(resolve_part(path))
    return each.select(*keys, "part", F.col("r._Id").alias("rel_id"), F.element_at(F.split("r._Type", "/"), -1).alias("type"), target.alias("target"), external.alias("external"))


def elements(parts: DataFrame, keys: list[str], names: tuple[str, ...] = ()) -> DataFrame:
    """(keys, part, element, parent, name, attributes, text): the elements of XML parts in document order, by local names.

    text is an element's own, before its first child. Where names are given, only elements of these become rows. A part that is cut off or broken ends the query with an error.
    """
    xml = parts.where(F.col("bytes").isNotNull() & (F.col("part").endswith(".xml") | F.col("part").endswith(".rels")))
    return through(xml.select(*keys, "part", "bytes"), lambda schema: _parsing(schema, names))


def package_elements(files: DataFrame, keys: list[str], content: str, names: tuple[str, ...] = (), before: tuple[Step, ...] = ()) -> DataFrame:
    """elements() of the parts of packages, which are opened and parsed in one worker; before: steps that make the packages from content, as a column `content`."""
    xml = lambda b: pc.and_(pc.is_valid(b["bytes"]), pc.fill_null(pc.or_(pc.ends_with(b["part"], ".xml"), pc.ends_with(b["part"], ".rels")), False))
    own = picking([*keys, "content" if before else content])
    return through(files.select(*keys, content), *before, own, opening, picking([*keys, "part", "bytes"], xml), lambda schema: _parsing(schema, names))


def _parsing(given: T.StructType, names: tuple[str, ...]) -> tuple[Run, T.StructType]:
    schema = T.StructType([*given[:-1], *T._parse_datatype_string("element int, parent int, name string, attributes map<string,string>, text string")])
    local = lambda name: name.rpartition("}")[2]
    most = 20_000

    def of(data: bytes, part: str) -> Iterator[tuple]:
        stack, n = [], 0
        try:
            for event, e in ET.iterparse(io.BytesIO(data), ("start", "end")):
                if event == "start":
                    stack.append((n, stack[-1][0] if stack else None, e))
                    n += 1
                else:
                    me, up, _ = stack.pop()
                    if not names or local(e.tag) in names:
                        yield me, up, local(e.tag), [(local(k), v) for k, v in e.attrib.items()], e.text
                    if stack:
                        del stack[-1][2][:]  # else every element stays until the part ends
        except ET.ParseError as x:
            raise ValueError(f"{part}: {x}") from None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string())
        for batch in pieces(batches, -1):
            part = batch.column(batch.num_columns - 2).to_pylist()
            rows: list[tuple] = []
            owners: list[int] = []

            def out(batch: pa.RecordBatch = batch, rows: list[tuple] = rows, owners: list[int] = owners) -> pa.RecordBatch:
                owner = pa.array(owners, pa.int32())
                made = pa.RecordBatch.from_arrays([*[c.take(owner) for c in batch.columns[:-1]], *[pa.array([r[x] for r in rows], t) for x, t in enumerate(types)]], names=schema.names)
                rows.clear()
                owners.clear()
                return made

            for k, data in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for row in of(data, part[k]):
                    rows.append(row)
                    owners.append(k)
                    if len(rows) == most:
                        yield out()
            if rows:
                yield out()

    return run, schema


def first_cells(parts: DataFrame, keys: list[str], most: int, cells: tuple[str, ...], style: str, repeat: str, most_repeated: int) -> DataFrame:
    """(keys, row, style, of_row, n): how many cells of each style the first rows with cells have, rows from 1, counted as a part is read.

    style, of_row: the attribute of the cell, and that of its row; repeat: the attribute that says for how many a cell stands. Only counts of `most` rows are kept.
    """
    schema = T.StructType([*parts.select(*keys).schema, *T._parse_datatype_string("row int, style string, of_row string, n long")])

    def said(e: ET.Element, name: str) -> str | None:
        if name in e.attrib:
            return e.attrib[name]
        for k, v in e.attrib.items():
            if _local(k) == name:
                return v
        return None

    def count(own: dict[str | None, int], e: ET.Element) -> None:
        text = (said(e, repeat) or "").strip() if repeat else ""
        name = said(e, style)
        own[name] = own.get(name, 0) + (max(min(int(text), most_repeated), 1) if text.lstrip("+-").isdecimal() else 1)

    def whole(root: ET.Element) -> dict[int, tuple[str | None, dict[str | None, int]]]:
        rows: dict[int, tuple[str | None, dict[str | None, int]]] = {}
        for up, parent in enumerate(root.iter()):
            if found := [e for e in parent if _local(e.tag) in cells]:
                rows[up] = (said(parent, style), {})
                for e in found:
                    count(rows[up][1], e)
                if len(rows) == most:
                    break
        return rows

    def of(data: bytes, part: str) -> dict[int, tuple[str | None, dict[str | None, int]]]:
        stack: list[tuple[int, ET.Element]] = []
        rows: dict[int, tuple[str | None, dict[str | None, int]]] = {}
        n = 0
        try:
            if len(data) <= WHOLE_BYTES:
                return whole(ET.fromstring(data))
            for event, e in ET.iterparse(io.BytesIO(data), ("start", "end")):
                if event == "start":
                    stack.append((n, e))
                    n += 1
                    continue
                stack.pop()
                if stack:
                    up, parent = stack[-1]
                    if _local(e.tag) in cells and (up in rows or len(rows) < most or up < max(rows)):
                        if up not in rows:
                            rows[up] = (said(parent, style), {})
                            if len(rows) > most:
                                del rows[max(rows)]
                        count(rows[up][1], e)
                    del parent[:]
        except ET.ParseError as x:
            raise ValueError(f"{part}: {x}") from None
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, -1):
            part = batch.column(batch.num_columns - 2).to_pylist()
            out = [
                (k, at, name, by_row, count)
                for k, data in enumerate(batch.column(batch.num_columns - 1).to_pylist())
                for at, (_, (by_row, own)) in enumerate(sorted(of(data, part[k]).items()), 1)
                for name, count in own.items()
            ]
            owner = pa.array([o[0] for o in out], pa.int32())
            made = [pa.array([o[x] for o in out], t) for x, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.int64()), 1)]
            yield pa.RecordBatch.from_arrays([*[c.take(owner) for c in batch.columns[:-2]], *made], names=schema.names)

    return parts.where("bytes is not null").select(*keys, "part", "bytes").mapInArrow(run, schema)


def definitions(parts: DataFrame, keys: list[str], names: tuple[str, ...], own: tuple[str, ...], inside: dict[str, tuple[str, ...]]) -> DataFrame:
    """(keys, part, element, tag, a, b_c): the elements of these names, in document order, with their attributes and those of their children.

    own: attributes, a column each; inside: attributes by the child that has them, a column `child_attribute` each, of several
    children the last that has it. A part that is cut off or broken ends the query with an error.
    """
    column = {(None, a): a for a in own} | {(child, a): f"{child}_{a}" for child, some in inside.items() for a in some}
    schema = T.StructType([*parts.select(*keys, "part").schema, T.StructField("element", T.IntegerType()), T.StructField("tag", T.StringType()), *[T.StructField(c, T.StringType()) for c in column.values()]])
    wanted = list(column)

    def of(n: int, e: ET.Element) -> tuple:
        said: dict[tuple[str | None, str], str] = {(None, _local(k)): v for k, v in e.attrib.items()}
        for c in e:
            child = _local(c.tag)
            if child in inside:
                said.update({(child, _local(k)): v for k, v in c.attrib.items()})
        return n, _local(e.tag), *[said.get(w) for w in wanted]

    def read(data: bytes, part: str) -> list[tuple]:
        try:
            if len(data) <= WHOLE_BYTES:
                return [of(n, e) for n, e in enumerate(ET.fromstring(data).iter()) if _local(e.tag) in names]
            stack, found, n = [], [], 0
            for event, e in ET.iterparse(io.BytesIO(data), ("start", "end")):
                if event == "start":
                    stack.append((n, e))
                    n += 1
                    continue
                me, _ = stack.pop()
                if _local(e.tag) in names:
                    found.append(of(me, e))
                if stack and _local(stack[-1][1].tag) not in names:
                    del stack[-1][1][:]  # else every element stays until the part ends
            return found
        except ET.ParseError as x:
            raise ValueError(f"{part}: {x}") from None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [to_arrow_type(f.dataType) for f in schema[-2 - len(wanted) :]]
        for batch in pieces(batches, -1):
            part, seen = batch.column(batch.num_columns - 2).to_pylist(), {}
            owners, rows = [], []
            for k, data in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if data not in seen:
                    seen[data] = read(data, part[k])
                rows += seen[data]
                owners += [k] * len(seen[data])
            owner = pa.array(owners, pa.int32())
            made = [pa.array(values, t) for values, t in zip(zip(*rows) if rows else [[]] * len(types), types)]
            yield pa.RecordBatch.from_arrays([*[c.take(owner) for c in batch.columns[:-1]], *made], names=schema.names)

    return parts.where("bytes is not null").select(*keys, "part", "bytes").mapInArrow(run, schema)


def alike(parts: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, group) of the packages, and (group, part, bytes): packages whose parts are the same, byte for byte, make a group.

    What these parts say can then be found once for each group. Bytes are told apart by their SHA-256, so that only this is
    shuffled for each package.
    """
    said = F.concat_ws(" ", F.sha2("bytes", 256), "part")
    owners = written(parts.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(said)), "\n").alias("files")).select(*keys, F.sha2("files", 256).alias("group"), "files"))
    files = owners.select("group", "files").distinct().select("group", F.explode(F.split("files", "\n")).alias("file"))
    known = parts.select("part", "bytes").distinct().select(said.alias("file"), "part", "bytes")
    return owners.select(*keys, "group"), written(files.join(shuffled(known), "file").select("group", "part", "bytes"))


def children(nodes: DataFrame, keys: list[str], parent: str, child: str) -> DataFrame:
    """(keys, part, parent's element and attributes, child's attributes and text): each child of a name with its parent.

    Both sides are written in one pass, as what nodes are made of would else be made for each side.
    """
    nodes = written(nodes.where(F.col("name").isin(parent, child)))
    up = nodes.where(F.col("name") == parent).select(*keys, "part", "element", F.col("attributes").alias("parent_attributes"))
    down = nodes.where(F.col("name") == child).select(*keys, "part", F.col("parent").alias("element"), "attributes", "text")
    return up.join(down, [*keys, "part", "element"])


def shuffled(df: DataFrame) -> DataFrame:
    """df, to be joined by shuffle. Spark takes a table for small by its bytes: millions of like rows are few when written, and parts
    few before they are parsed, but not in the driver that would broadcast them."""
    return df.hint("merge")


def sized(df: DataFrame) -> DataFrame:
    """df, written once, and marked for broadcast if a count shows that it is small, else for a shuffle."""
    df = written(df)
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else shuffled(df)


# ---- lookups


def numbering(parts: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(numbers, levels, overrides) of numbering parts: number to abstract number, its levels, and starts that a number sets anew."""
    val = "struct<_val: string>"
    shape = (
        f"struct<abstractNum: array<struct<_abstractNumId: string, lvl: array<struct<_ilvl: int, start: {val}, numFmt: {val}>>>>, "
        f"num: array<struct<_numId: string, abstractNumId: {val}, lvlOverride: array<struct<_ilvl: int, startOverride: {val}>>>>>"
    )
    read = written(read_xml(parts.where(F.col("part").endswith("numbering.xml")), keys, shape))
    num = read.select(*keys, F.explode("x.num").alias("n"))
    numbers = num.select(*keys, F.col("n._numId").alias("num_id"), F.col("n.abstractNumId._val").alias("abstract_id"))
    overrides = num.select(*keys, F.col("n._numId").alias("num_id"), F.explode("n.lvlOverride").alias("o")).select(*keys, "num_id", F.col("o._ilvl").alias("level"), F.col("o.startOverride._val").cast("long").alias("start"))
    each = read.select(*keys, F.explode("x.abstractNum").alias("a")).select(*keys, F.col("a._abstractNumId").alias("abstract_id"), F.explode("a.lvl").alias("l"))
    levels = each.select(*keys, "abstract_id", F.col("l._ilvl").alias("level"), F.col("l.numFmt._val").alias("format"), F.col("l.start._val").cast("long").alias("start"))
    return numbers, levels, overrides.where("start is not null")


def list_levels(items: DataFrame, keys: list[str], numbers: DataFrame, levels: DataFrame, overrides: DataFrame) -> DataFrame:
    """items (keys, num_id, level, ...) with `format` and `start` of their level: number to abstract number to level.

    A number's override wins over the level's start; bullets have no start; a number or level that is not there gives null.
    """
    own = numbers.join(shuffled(levels), [*keys, "abstract_id"]).join(shuffled(overrides.withColumnRenamed("start", "__own")), [*keys, "num_id", "level"], "left")
    start = F.when(F.col("format") != "bullet", F.coalesce("__own", "start", F.lit(1)))
    return items.join(sized(own.select(*keys, "num_id", "level", "format", start.alias("start"))), [*keys, "num_id", "level"], "left")


def resolved(references: DataFrame, targets: DataFrame, on: list[str], kind: str, policies: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """references with the columns of targets; what becomes of one without a target is said by its kind: drop, keep or error.

    An error names the reference, by the columns of `by` or else those it is joined on. It is part of the filter, so no choice of columns skips it. Other kinds are kept.
    """
    if unknown := set(policies.values()) - {"drop", "keep", "error"}:
        raise ValueError(f"no policy {min(unknown)}")
    found = references.join(targets.withColumn("__found", F.lit(True)), on, "left")
    missing, policy = F.col("__found").isNull(), F.lit("keep")
    for name, what in policies.items():
        policy = F.when(F.col(kind) == name, what).otherwise(policy)
    named = F.concat_ws(" ", F.lit("missing"), F.col(kind), *[F.col(c).cast("string") for c in by or on])
    keep = F.when(missing & (policy == "error"), F.raise_error(named).cast("boolean")).otherwise(~(missing & (policy == "drop")))
    return found.where(keep).drop("__found")


# ---- styles of workbooks

# Theme colours in the order of their slots, and the first indexed colours.
THEME_SLOTS = "lt1 dk1 lt2 dk2 accent1 accent2 accent3 accent4 accent5 accent6 hlink folHlink".split()
INDEXED = "000000 FFFFFF FF0000 00FF00 0000FF FFFF00 FF00FF 00FFFF".split()
#: Widths of borders in points.
BORDERS = {"hair": 0.25, "thin": 0.5, "dotted": 0.5, "dashdot": 0.5, "dashed": 0.5, "medium": 1.0, "mediumdashed": 1.0, "mediumdashdot": 1.0, "thick": 1.5, "double": 1.5}
_COLOR = "struct<_rgb: string, _theme: int, _indexed: int, _tint: double>"
_VAL = "struct<_val: string>"
_STYLES = (
    f"struct<fonts: struct<font: array<struct<sz: struct<_val: double>, name: {_VAL}, b: {_VAL}, i: {_VAL}, color: {_COLOR}>>>, "
    f"fills: struct<fill: array<struct<patternFill: struct<_patternType: string, fgColor: {_COLOR}>>>>, "
    f"borders: struct<border: array<struct<left: struct<_style: string, color: {_COLOR}>>>>, "
    "cellXfs: struct<xf: array<struct<_fontId: int, _fillId: int, _borderId: int, alignment: struct<_horizontal: string>>>>>"
)


def theme_colors(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, theme): the colours of a workbook's theme by slot, six digits each or null."""
    color = "struct<srgbClr: struct<_val: string>, sysClr: struct<_lastClr: string>>"
    shape = "struct<themeElements: struct<clrScheme: struct<" + ", ".join(f"{s}: {color}" for s in THEME_SLOTS) + ">>>"
    read = read_xml(parts.where(F.col("part").rlike("theme/theme[0-9]*[.]xml$")), keys, shape).select(*keys, F.col("x.themeElements.clrScheme").alias("c"))
    return read.select(*keys, F.array(*[F.upper(F.coalesce(f"c.{s}.srgbClr._val", f"c.{s}.sysClr._lastClr")) for s in THEME_SLOTS]).alias("theme"))


def _channel(rgb: Column, k: int, tint: Column) -> Column:
    channel = F.conv(F.substring(rgb, 2 * k + 1, 2), 16, 10).cast("int")
    moved = F.when(tint < 0, channel * (1 + tint)).otherwise(channel + (255 - channel) * tint)
    return F.least(F.greatest(F.floor(moved + 0.5), F.lit(0)), F.lit(255)).cast("int")


def color_of(color: Column, theme: Column) -> Column:
    """A colour as #RRGGBB: its own, or of the theme's slot, or indexed, moved by its tint."""
    own = F.upper(F.substring(F.lpad(color["_rgb"], 8, "F"), 3, 6))
    indexed = F.get(F.array(*map(F.lit, INDEXED)), color["_indexed"])
    rgb = F.coalesce(own, F.when(color["_theme"].isNotNull(), F.get(theme, color["_theme"])), indexed)
    tint = F.coalesce(color["_tint"], F.lit(0.0))
    tint = F.when(tint.between(-1, 1), tint).otherwise(F.raise_error(F.lit("a tint must be between -1 and 1")).cast("double"))
    return F.when(rgb.isNotNull(), F.format_string("#%02X%02X%02X", *[_channel(rgb, k, tint) for k in range(3)]))


def cell_formats(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, style, font, size, bold, italic, color, fill, border, border_color, align) by the number of a workbook's cell format.

    Fonts, fills and borders are met by their places: format to font, fill and border. A place that is not there is an error.
    """
    read = read_xml(parts.where(F.col("part").endswith("styles.xml")), keys, _STYLES).join(shuffled(theme_colors(parts, keys)), keys, "left")
    each = read.select(*keys, "theme", "x.fonts.font", "x.fills.fill", "x.borders.border", F.posexplode("x.cellXfs.xf").alias("style", "v"))
    own = each.select(*keys, "style", "theme", "v", *[F.struct(F.coalesce(f"v._{n}Id", F.lit(0)).alias("id"), F.get(n, F.coalesce(f"v._{n}Id", F.lit(0))).alias("of")).alias(n) for n in ("font", "fill", "border")])
    missing = lambda n: F.raise_error(F.concat_ws(" ", F.lit(f"missing {n}"), *[F.col(k).cast("string") for k in keys], F.col(f"{n}.id").cast("string"))).cast("boolean")
    for n in ("font", "fill", "border"):
        own = own.where(F.when(F.col(f"{n}.of").isNull(), missing(n)).otherwise(F.lit(True)))
    on = lambda v: v.isNotNull() & ~F.coalesce(v["_val"], F.lit("1")).isin("0", "false")
    f, l, b, theme = F.col("font.of"), F.col("fill.of.patternFill"), F.col("border.of.left"), F.col("theme")
    width = F.try_element_at(F.create_map(*[F.lit(x) for pair in BORDERS.items() for x in pair]), F.lower(b["_style"]))
    h = F.lower("v.alignment._horizontal")
    align = F.when(h.isin("left", "general"), "left").when(h.isin("center", "centercontinuous"), "center").when(h == "right", "right").when(h.isin("justify", "distributed"), "justify")
    return own.select(
        *keys, "style", f["name"]["_val"].alias("font"), f["sz"]["_val"].alias("size"), on(f["b"]).alias("bold"), on(f["i"]).alias("italic"), color_of(f["color"], theme).alias("color"),
        F.when(F.lower(l["_patternType"]) == "solid", color_of(l["fgColor"], theme)).alias("fill"), width.alias("border"), F.when(width.isNotNull(), color_of(b["color"], theme)).alias("border_color"), align.alias("align"),
    )


def styled_cells(cells: DataFrame, rows: DataFrame, formats: DataFrame, keys: list[str]) -> DataFrame:
    """cells (keys, sheet_row, style, ...) with their format: the cell's own, else its row's, else the first. A format that is not there is an error."""
    own = cells.join(shuffled(rows.select(*keys, "sheet_row", F.col("style").alias("__row"))), [*keys, "sheet_row"], "left")
    chosen = own.withColumn("style", F.coalesce("style", "__row", F.lit(0))).drop("__row").withColumn("__kind", F.lit("cell format"))
    return resolved(chosen, sized(formats), [*keys, "style"], "__kind", {"cell format": "error"}).drop("__kind")


# ---- ragged records


def ragged_cells(records: DataFrame, order: list[str], value: str) -> DataFrame:
    """(order, key, kind, text): a row for each key of each record, a VARIANT. kind: empty, integer, float, boolean or string; nested values are their JSON.

    A record that is no object is an error.
    """
    spark = records.sparkSession
    kind = F.schema_of_variant(F.col(value))
    checked = records.where(F.when(kind.startswith("OBJECT"), F.lit(True)).otherwise(F.raise_error(F.lit("rows must be objects")).cast("boolean")))
    each = checked.select(*order, value).lateralJoin(spark.tvf.variant_explode(F.col(value).outer()).select("key", F.col("value").alias("__v")))
    what = F.schema_of_variant("__v")
    whole = F.when(what == "BIGINT", "integer").when(what.startswith("DECIMAL") | what.isin("DOUBLE", "FLOAT"), "float").when(what == "BOOLEAN", "boolean").when(what == "VOID", "empty").otherwise("string")
    return each.select(*order, "key", whole.alias("kind"), F.col("__v").cast("string").alias("text"))


def ragged_header(cells: DataFrame, order: list[str]) -> DataFrame:
    """(key, place): keys in the order in which they first occur, by record and then by name; as many rows as there are keys."""
    first = cells.groupBy("key").agg(F.min(F.struct(*order, "key")).alias("first"))
    keys = [r["key"] for r in first.orderBy("first").select("key").collect()]
    return cells.sparkSession.createDataFrame([(k, n) for n, k in enumerate(keys, 1)], "key string, place int")


def ragged_union(records: DataFrame, order: list[str], value: str) -> DataFrame:
    """(order, place, key, kind, text): records of different keys as one table: a cell for each record and key of all, empty where a record lacks it."""
    cells = ragged_cells(records, order, value)
    header = ragged_header(cells, order)
    full = records.select(*order).withColumn("__header", F.lit([r["key"] for r in header.orderBy("place").collect()] or [""]))
    grid = full.select(*order, F.posexplode("__header").alias("place", "key")).withColumn("place", F.col("place") + 1)
    return grid.join(cells, [*order, "key"], "left").select(*order, "place", "key", F.coalesce("kind", F.lit("empty")).alias("kind"), "text")
