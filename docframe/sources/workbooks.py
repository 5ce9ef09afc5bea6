"""Workbooks as a data source of Spark: rows of typed cells, read by file, sheet and range of rows, and written in stages.

    register(spark)
    spark.read.format("workbook").load("in/*.xlsx")
    df.write.format("workbook").mode("append").save("out")

Options to read: sheet (name or number from 0; else the first), header (true), mode (FAILFAST, PERMISSIVE, DROPMALFORMED),
columnNameOfCorruptRecord (_corrupt_record), rowsPerPartition (50000), inferRows (all), metadata (false: with the columns _file, _sheet
and _row), filters. Options to write: kind (xlsx, ods or csv), rowsPerFile (50000), sheet (Sheet1), exists (error or append).

The first row names the columns. Kinds of cells make types: whole numbers long, other numbers double, booleans, all else
text, and mixed columns are text. A record is broken if it has more cells than the header, or a cell of another kind than its
column. FAILFAST ends with an error; DROPMALFORMED leaves it out; PERMISSIVE keeps it with null for such cells, and its cells
as JSON in the column for corrupt records, if the schema has one. Rows without any cell are no records. filters is JSON,
[[column, comparison, value], ...], all of which have to hold: rows are left out as they are read, and conditions on _file and
_sheet leave out partitions. (Spark's own pushdown is not used: it keeps a filter for every later use of a loaded frame.)
"""

from __future__ import annotations

import io
import json
import operator
import posixpath
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import islice
from typing import IO
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import packages, stores
from .structured import Cell, DataError, cell_text, number, write_csv

BATCH_ROWS = 2000
#: Packages of up to so many bytes are one partition a sheet; rows of larger ones are counted first.
SMALL_BYTES = 256 << 10
META = {"_file": T.StringType(), "_sheet": T.StringType(), "_row": T.LongType()}
Row = tuple[int, list[Cell]]


# ---- rows of sheets, one by one


_ROW = re.compile(rb"""<(?:\w+:)?row(?=[\s/>])((?:[^<>"']|"[^<"]*"|'[^<']*')*)>""")
_NUMBER = re.compile(rb"""\sr\s*=\s*["']([0-9]+)["']""")


class _Joined:
    """Bytes and what a file still holds, to read."""

    def __init__(self, head: bytes, f: IO[bytes]) -> None:
        self.head, self.f = io.BytesIO(head), f

    def read(self, n: int) -> bytes:
        return self.head.read(n) or self.f.read(n)


def _skipping(f: IO[bytes], start: int) -> tuple[IO[bytes] | _Joined, int | None]:
    """A sheet's part without the rows between its first and the row `start`, and the number of the last row left out.

    Rows to leave out are known by their tags and not parsed, so a range of rows costs little more than its own rows. Where
    comments, literal sections or instructions come before, what looks like a tag may be none, and the part stays whole.
    """
    whole = lambda: (f.seek(0), (f, None))[1]
    odd = lambda data, at: data.find(b"<!", at) >= 0 or data.find(b"<?", at) >= 0
    held = b""
    while len(first := list(islice(_ROW.finditer(held), 2))) < 2:
        block = f.read(1 << 20)
        if not block or odd(held, 1):
            return whole()
        held += block
    kept, held = held[: first[1].start()], held[first[1].start() :]
    number = _NUMBER.search(first[0][1])
    y, skipped = int(number[1]) if number else 1, None
    if odd(kept, 1):
        return whole()
    while True:
        end = 0
        for m in _ROW.finditer(held):
            number = _NUMBER.search(m[1])
            y = int(number[1]) if number else y + 1
            if y >= start:
                return (_Joined(kept + held[m.start() :], f), skipped) if not odd(held[: m.start()], 0) else whole()
            skipped, end = y, m.end()
        block = f.read(1 << 20)
        if not block or odd(held, 0):
            return whole()
        held = held[max(end, held.rfind(b"<")) :] + block  # the last tag may be cut off


def _xlsx_rows(z: zipfile.ZipFile, part: str, start: int = 1) -> Iterator[Row]:
    """(row number, cells) of a sheet's part, in order, with one row in memory: the first row, and rows from `start` on at least."""
    names = set(z.namelist())
    text = lambda e: "".join(t.text or "" for t in e.iter() if packages.local(t) == "t")
    shared = []
    if "xl/sharedStrings.xml" in names:
        with z.open("xl/sharedStrings.xml") as f:
            for _, e in ET.iterparse(f):
                if packages.local(e) == "si":
                    shared.append(text(e))
                    e.clear()
    dates = packages.date_formats(z.read("xl/styles.xml")) if "xl/styles.xml" in names else set()
    y, holder = 0, None
    with z.open(part) as f:
        source, skipped = _skipping(f, start) if start > 2 else (f, None)
        for event, e in ET.iterparse(source, ("start", "end")):
            if event == "start":
                if holder is None and packages.local(e) == "sheetData":
                    holder = e
            elif e.tag.endswith("row") and packages.local(e) == "row":
                y = int(e.get("r", y + 1))
                cells: list[Cell] = []
                for c in e:
                    x = packages.column_index(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (x + 1 - len(cells))
                    cells[x] = packages.xlsx_cell(c, shared, dates, text)
                yield y, cells
                if skipped is not None:
                    y, skipped = skipped, None
                if holder is not None:
                    holder.clear()


def _ods_rows(z: zipfile.ZipFile, sheet: str) -> Iterator[Row]:
    """(row number, cells) of a table; a run of equal rows is expanded only where it has cells."""
    inside, y, holder = False, 0, None
    with z.open("content.xml") as f:
        for event, e in ET.iterparse(f, ("start", "end")):
            kind = packages.local(e)
            if kind == "table" and event == "start":
                inside, y, holder = (packages.attr(e, "name") or "Sheet1") == sheet, 0, e
            elif kind == "table" and event == "end" and inside:
                return
            elif kind == "table-row" and event == "end":
                if inside:
                    times, cells = int(packages.attr(e, "number-rows-repeated") or 1), packages.ods_row(e)
                    for k in range(times if any(c is not None for c in cells) else 0):
                        yield y + k + 1, cells
                    y += times
                if holder is not None:
                    holder.clear()


def _sheets(z: zipfile.ZipFile, kind: str) -> list[tuple[str, str]]:
    """(name, what _rows needs) of the sheets in order."""
    if kind == "xlsx":
        files = {n: z.read(n) for n in ("xl/workbook.xml", "xl/_rels/workbook.xml.rels") if n in z.namelist()}
        if len(files) < 2:
            raise DataError("the workbook part is missing")
        rels = packages.relationships(files, "xl/workbook.xml")
        return [(s.get("name"), rels[packages.attr(s, "id")]) for s in packages.inside(packages.child(ET.fromstring(files["xl/workbook.xml"]), "sheets"))]
    out = []
    with z.open("content.xml") as f:
        for event, e in ET.iterparse(f, ("start", "end")):
            if event == "start" and packages.local(e) == "table":
                name = packages.attr(e, "name") or "Sheet1"
                out.append((name, name))
            elif event == "end" and packages.local(e) in ("table-row", "table"):
                e.clear()
    return out


def _rows(z: zipfile.ZipFile, kind: str, what: str, start: int = 1) -> Iterator[Row]:
    return _xlsx_rows(z, what, start) if kind == "xlsx" else _ods_rows(z, what)


def _count(z: zipfile.ZipFile, kind: str, what: str) -> int:
    """About how many rows a sheet has, without reading cells: by its stated extent, or by counting tags. The last partition has no end."""
    with z.open(what if kind == "xlsx" else "content.xml") as f:
        head, n, last = f.read(4096), 0, b""
        if kind == "xlsx" and (m := re.search(rb'<(?:\w+:)?dimension ref="[A-Z]+[0-9]+:[A-Z]+([0-9]+)"', head)):
            return int(m[1])
        if kind == "xlsx" and re.search(rb"<worksheet[\s>]", head):  # tags without a prefix
            while head:
                joined = last + head
                n += sum(joined.count(t) for t in (b"<row ", b"<row>", b"<row/"))
                last, head = joined[-4:], f.read(1 << 20)
            return n
        tag, block = (rb"<(?:\w+:)?row[ />]" if kind == "xlsx" else rb"<(?:\w+:)?table-row[ />]"), head
        while block:
            joined = last + block
            found = [m.end() for m in re.finditer(tag, joined)]
            n += len(found)
            last, block = joined[max(found[-1] if found else 0, len(joined) - 40) :], f.read(1 << 20)
        return n


# ---- reading


@dataclass
class Piece(D.InputPartition):
    """Rows start to end, both included, of a sheet of a file."""

    file: str
    sheet: str
    what: str
    start: int
    end: int | None


@contextmanager
def _package(store: fs.FileSystem, path: str) -> Iterator[tuple[zipfile.ZipFile, str]]:
    """An open package and its kind."""
    kind = _kind(path)
    with store.open_input_file(path) as f:
        try:
            z = zipfile.ZipFile(f)
        except (zipfile.BadZipFile, pa.ArrowInvalid) as e:
            raise DataError(f"{path} is no package: {e}") from None
        with z:
            yield z, kind


def _kind(path: str) -> str:
    kind = path.rpartition(".")[2].lower()
    if kind not in ("xlsx", "xlsm", "ods"):
        raise DataError(f"{path} is no workbook")
    return "ods" if kind == "ods" else "xlsx"


def _names(header: list[Cell]) -> list[str]:
    """Column names: empty ones by place, repeated ones with a number."""
    out: list[str] = []
    for k, c in enumerate(header):
        name = base = cell_text(c) or f"_c{k}"
        n = 1
        while name in out:
            n += 1
            name = f"{base}_{n}"
        out.append(name)
    return out


def _type_of(kinds: set[str]) -> T.DataType:
    if kinds <= {"int"} and kinds:
        return T.LongType()
    if kinds <= {"int", "float"} and kinds:
        return T.DoubleType()
    return T.BooleanType() if kinds == {"bool"} else T.StringType()


def _converter(kind: T.DataType) -> Callable[[Cell], object]:
    """A cell as a value of the type; a ValueError if it is of another kind."""

    def fail(c: Cell) -> object:
        raise ValueError(f"{cell_text(c)!r} is no {kind.simpleString()}")

    if isinstance(kind, T.StringType):
        return lambda c: None if c is None else cell_text(c)
    if isinstance(kind, (T.LongType, T.IntegerType)):
        most = 1 << (63 if isinstance(kind, T.LongType) else 31)
        return lambda c: c if c is None or type(c) is int and -most <= c < most else fail(c)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return lambda c: None if c is None else float(c) if type(c) in (int, float) else fail(c)
    if isinstance(kind, T.BooleanType):
        return lambda c: c if c is None or type(c) is bool else fail(c)
    raise DataError(f"a cell is never a {kind.simpleString()}")


_COMPARE = {"=": operator.eq, "<>": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "in": lambda v, values: v in values}


def _tests(text: str, names: list[str]) -> list[tuple[str, Callable[[object], bool]]]:
    """(column, test of its value) of conditions [[column, comparison, value], ...]; null passes none but "is null"."""
    out: list[tuple[str, Callable[[object], bool]]] = []
    for name, what, *value in json.loads(text):
        if name not in names:
            raise DataError(f"no column {name} to filter")
        if what in ("is null", "is not null"):
            out.append((name, (lambda v: v is None) if what == "is null" else (lambda v: v is not None)))
        elif what in _COMPARE:
            out.append((name, lambda v, f=_COMPARE[what], x=value[0]: v is not None and f(v, x)))
        else:
            raise DataError(f"no comparison {what}")
    return out


class WorkbookReader(D.DataSourceReader):
    def __init__(self, schema: T.StructType, options: Mapping[str, str]) -> None:
        self.schema, self.options = schema, D.CaseInsensitiveDict(options)
        self.mode = options.get("mode", "FAILFAST").upper()
        if self.mode not in ("FAILFAST", "PERMISSIVE", "DROPMALFORMED"):
            raise DataError(f"mode {self.mode} is not known")
        self.corrupt = options.get("columnNameOfCorruptRecord", "_corrupt_record")
        self.converters = [None if f.name in META or f.name == self.corrupt else _converter(f.dataType) for f in schema]

    def partitions(self) -> list[Piece]:
        step, out = int(self.options.get("rowsPerPartition", 50_000)), []
        store, files = stores.find(self.options["path"])
        for path, size in files:
            if not self._passes("_file", path):
                continue
            with _package(store, path) as (z, kind):
                for name, what in _chosen(_sheets(z, kind), self.options):
                    if not self._passes("_sheet", name):
                        continue
                    n = None if size <= SMALL_BYTES and "rowsPerPartition" not in self.options else _count(z, kind, what)
                    starts = range(1, n + 1, step) if n and n > step else [1]
                    out += [Piece(path, name, what, s, s + step - 1 if s + step <= (n or 0) else None) for s in starts]
        return out or [Piece("", "", "", 1, 0)]

    def tests(self) -> list[tuple[str, Callable[[object], bool]]]:
        return _tests(self.options.get("filters", "[]"), self.schema.names)

    def _passes(self, column: str, value: object) -> bool:
        return all(test(value) for c, test in self.tests() if c == column)

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        if not piece.file:
            return
        store, _ = stores.opened(self.options["path"])
        with _package(store, piece.file) as (z, kind):
            rows = self._records(_rows(z, kind, piece.what, piece.start), piece)
            while many := list(islice(rows, BATCH_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*many, strict=True), schema, strict=True)], schema=schema)

    def _records(self, rows: Iterator[Row], piece: Piece) -> Iterator[tuple]:
        names: list[str] | None = None if self.options.get("header", "true").lower() == "true" else []
        places: list[int | None] | None = None
        tests = [(self.schema.names.index(c), t) for c, t in self.tests()]
        for y, cells in rows:
            if names is None:
                names = _names(cells)
                continue
            if piece.end is not None and y > piece.end:
                return
            if y < piece.start or all(c is None for c in cells):
                continue
            if places is None:
                places = [None if c is None else names.index(f.name) if f.name in names else int(f.name[2:]) if not names and re.fullmatch("_c[0-9]+", f.name) else None for f, c in zip(self.schema, self.converters, strict=True)]
                if self.mode == "FAILFAST" and (lost := [f.name for f, c, p in zip(self.schema, self.converters, places, strict=True) if c is not None and p is None]):
                    raise DataError(f"{piece.file}, {piece.sheet}: no column {lost[0]}")
            record = self._record(y, cells, names, places, piece)
            if record is not None and all(t(record[k]) for k, t in tests):
                yield record

    def _record(self, y: int, cells: list[Cell], names: list[str], places: list[int | None], piece: Piece) -> tuple | None:
        wrong = f"{len(cells)} cells; expected {len(names)}" if names and len(cells) > len(names) and any(c is not None for c in cells[len(names) :]) else None
        meta, out = {"_file": piece.file, "_sheet": piece.sheet, "_row": y}, []
        for f, convert, place in zip(self.schema, self.converters, places, strict=True):
            value = meta.get(f.name) if convert is None else None
            if convert is not None and place is not None and place < len(cells):
                try:
                    value = convert(cells[place])
                except ValueError as e:
                    wrong = wrong or f"{f.name}: {e}"
            out.append(value)
        if wrong is None:
            return tuple(out)
        if self.mode == "FAILFAST":
            raise DataError(f"{piece.file}, {piece.sheet}, row {y}: {wrong}")
        if self.mode == "DROPMALFORMED":
            return None
        return tuple(json.dumps(cells, ensure_ascii=False) if f.name == self.corrupt else v for f, v in zip(self.schema, out, strict=True))


def _chosen(sheets: list[tuple[str, str]], options: Mapping[str, str]) -> list[tuple[str, str]]:
    wanted = options.get("sheet")
    if wanted is None:
        return sheets[:1]
    if wanted == "*":
        return sheets
    found = [s for s in sheets if s[0] == wanted] or (sheets[int(wanted) : int(wanted) + 1] if wanted.isdigit() else [])
    if not found:
        raise DataError(f"no sheet {wanted}")
    return found


# ---- writing


@dataclass
class Written(D.WriterCommitMessage):
    """What a task has put aside."""

    task: str
    files: list[dict]


class _StagedWriter:
    """Commit and abort of a write in stages."""

    def __init__(self, options: Mapping[str, str], overwrite: bool) -> None:
        self.options, self.overwrite = D.CaseInsensitiveDict(options), overwrite
        self.staged = stores.Staged(options["path"])

    def commit(self, messages: list[Written | None]) -> None:
        files = [(m.task, f) for m in messages if m is not None for f in m.files]
        try:
            self.staged.commit(files, self.overwrite, self.options.get("exists", "error") == "append")
        except BaseException:
            self.staged.abort()
            raise

    def abort(self, messages: list[Written | None]) -> None:
        self.staged.abort()


class WorkbookWriter(_StagedWriter, D.DataSourceArrowWriter):
    """Each task's rows as workbooks of up to rowsPerFile rows."""

    def __init__(self, schema: T.StructType, options: Mapping[str, str], overwrite: bool) -> None:
        super().__init__(options, overwrite)
        self.names, self.kind = schema.names, options.get("kind", "xlsx")
        for f in schema:
            if not isinstance(f.dataType, (T.StringType, T.BooleanType, T.IntegralType, T.DoubleType, T.FloatType, T.NullType)):
                raise DataError(f"{f.name}: cast {f.dataType.simpleString()} to a number, boolean or text first")
        if self.kind not in ("xlsx", "ods", "csv"):
            raise DataError(f"{self.kind} is no kind of workbook")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        most, sheet, task, files = int(self.options.get("rowsPerFile", 50_000)), self.options.get("sheet", "Sheet1"), uuid.uuid4().hex, []
        held: list[list[Cell]] = []

        def flush() -> None:
            rows = [list(self.names), *held]
            made = packages.write_xlsx({sheet: rows}) if self.kind == "xlsx" else packages.write_ods({sheet: rows}) if self.kind == "ods" else write_csv({sheet: rows}).encode()
            name = f"part-{task}-{len(files):05d}.{self.kind}"
            self.staged.put(task, name, made)
            files.append({"name": name, "bytes": len(made), "rows": len(held)})
            held.clear()

        for batch in iterator:
            for row in zip(*[[number(v) if isinstance(v, float) else v for v in c.to_pylist()] for c in batch.columns], strict=True):
                held.append(list(row))
                if len(held) >= most:
                    flush()
        if held:
            flush()
        return Written(task, files)


class WorkbookSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> T.StructType:
        """Names from the first file's header, types from the kinds of its cells."""
        store, files = stores.find(self.options["path"])
        if not files:
            raise FileNotFoundError(self.options["path"])
        most, header = self.options.get("inferRows"), self.options.get("header", "true").lower() == "true"
        with _package(store, files[0][0]) as (z, kind):
            rows = _rows(z, kind, _chosen(_sheets(z, kind), self.options)[0][1])
            names = _names(next(rows, (0, []))[1]) if header else []
            kinds: list[set[str]] = [set() for _ in names]
            for _, cells in islice(rows, int(most) if most else None):
                if not header:
                    kinds += [set() for _ in range(len(cells) - len(kinds))]
                for k, c in zip(kinds, cells, strict=False):
                    if c is not None:
                        k.add(type(c).__name__)
        fields = [T.StructField(n, _type_of(k)) for n, k in zip(names or [f"_c{k}" for k in range(len(kinds))], kinds, strict=True)]
        if self.options.get("metadata", "false").lower() == "true":
            fields += [T.StructField(n, t) for n, t in META.items()]
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> WorkbookReader:
        return WorkbookReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(schema, self.options, overwrite)


class FilesWriter(_StagedWriter, D.DataSourceArrowWriter):
    """Rows (name, content) as files. A row without content writes none; its error, if there is such a column, is listed."""

    def __init__(self, options: Mapping[str, str], overwrite: bool) -> None:
        super().__init__({**options, "exists": "append"}, overwrite)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task, files = uuid.uuid4().hex, []
        for batch in iterator:
            errors = batch.column("error").to_pylist() if "error" in batch.schema.names else [None] * batch.num_rows
            for name, content, error in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), errors, strict=True):
                name = posixpath.normpath(name)
                if content is None:
                    files.append({"name": name, "bytes": None, "error": error})
                else:
                    data = content.encode() if isinstance(content, str) else bytes(content)
                    self.staged.put(task, name, data)
                    files.append({"name": name, "bytes": len(data), "error": error})
        return Written(task, files)


class FilesSink(D.DataSource):
    """A sink for documents: each row's content under its name, all of them or none."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def writer(self, schema: T.StructType, overwrite: bool) -> FilesWriter:
        if not {"name", "content"} <= set(schema.names):
            raise DataError("documents are written from the columns name and content")
        return FilesWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the sources known to a session."""
    spark.dataSource.register(WorkbookSource)
    spark.dataSource.register(FilesSink)
