"""Chunked delimited text: writing, reading by range, sampling, and the cleaning scan."""

from __future__ import annotations

import bz2
import csv
import gzip
import io
import logging
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pa_csv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spantab.functions.scalars import to_double
from spantab.operators.cleaning import (
    NA_TOKENS,
    READER_NA_TOKENS,
    as_names,
    drop_null_rows,
    normalised_names,
    nullify_tokens,
    trim_strings,
)
from spantab.staging import stage

_log = logging.getLogger(__name__)

CHUNK_FOLDER = "chunk={i}"
MAX_FILE_BYTES = 1 << 30  # a task holds one file as it is stored
PARSED_ROWS = 10_000
BLOCK_BYTES = 1 << 20  # whole lines that are split into cells at once
LOGGED_FILES = 100
QUARANTINE = "file string, reason string"
NULL_TEXT = "None"  # fixed value: how the chunk files spell a missing cell


def chunk_number(key: Column | str, size: int) -> Column:
    return F.floor((F.col(key) if isinstance(key, str) else key) / F.lit(size)).cast("bigint")


def id_range_chunk(df: DataFrame, key: str, size: int, file_pattern: str | None = None) -> DataFrame:
    """Add ``chunk``, and with a pattern the chunk's ``file_name``."""
    out = df.withColumn("chunk", chunk_number(key, size))
    if file_pattern is None:
        return out
    before, after = file_pattern.split("{i}")
    return out.withColumn("file_name", F.concat(F.lit(before), F.col("chunk").cast("string"), F.lit(after)))


def write_delimited(
    df: DataFrame, path: str, sep: str = ";", header: bool = False, partition_by: Sequence[str] = (),
    null: str = NULL_TEXT,
) -> None:
    """Delimited text with quoting where a cell needs it; blanks at cell ends are kept.

    Nulls are written as ``null``, which keeps them apart from empty text.
    """
    writer = df.write.mode("overwrite").options(
        sep=sep, header=header, escape='"', nullValue=null, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_chunks(df: DataFrame, path: str, key: str, size: int, sep: str = ";", header: bool = False) -> None:
    """One folder per id range. Rows are range-placed, so a chunk lies in few files, a large one in several."""
    columns = list(df.columns)
    chunked = id_range_chunk(df, key, size)
    placed = chunked.repartitionByRange(F.col("chunk"), F.xxhash64(*columns))
    write_delimited(placed, path, sep, header, ["chunk"])


def _file_system(spark: SparkSession, path: str):
    """Hadoop file system and path object, so any storage Spark reads can be listed."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), location


def existing_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths that exist; each missing one is logged."""
    found = []
    for path in paths:
        fs, location = _file_system(spark, path)
        if fs.exists(location):
            found.append(path)
        else:
            _log.warning("file not found: %s", path)
    return found


def chunk_paths(spark: SparkSession, folder: str, start: int, end: int, pattern: str = CHUNK_FOLDER) -> list[str]:
    """Existing paths of the chunks in [start, end), from one folder listing."""
    fs, location = _file_system(spark, folder)
    before, after = (re.escape(part) for part in pattern.split("{i}"))
    named = re.compile(f"{before}(\\d+){after}")
    hits = []
    for status in fs.listStatus(location):
        match = named.fullmatch(status.getPath().getName())
        if match and start <= int(match.group(1)) < end:
            hits.append((int(match.group(1)), status.getPath().toString()))
    absent = len(range(start, end)) - len(hits)
    if absent > 0:
        _log.info("%d of the chunks %d…%d are not there", absent, start, end - 1)
    return [path for _, path in sorted(hits)]


def _reader(spark: SparkSession, schema: T.StructType, sep: str, header: bool, multiline: bool, trim: bool = False,
            null: str = ""):
    return spark.read.schema(schema).options(
        sep=sep, header=header, escape='"', multiLine=multiline, mode="PERMISSIVE", nullValue=null,
        ignoreLeadingWhiteSpace=trim, ignoreTrailingWhiteSpace=False, recursiveFileLookup=True,
    )


def read_headerless(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, sep: str = ";", multiline: bool = False,
    null: str = NULL_TEXT,
) -> DataFrame:
    """Header-less text under an explicit schema; missing paths are skipped with a message."""
    found = existing_paths(spark, as_names(paths))
    if not found:
        return spark.createDataFrame([], schema)
    return _reader(spark, schema, sep, False, multiline, null=null).csv(found)


def read_chunks(
    spark: SparkSession, folder: str, start: int, end: int, schema: T.StructType, pattern: str = CHUNK_FOLDER,
    sep: str = ";", header: bool = False, multiline: bool = False, null: str = NULL_TEXT,
) -> DataFrame:
    """Chunks of [start, end) with their number; only the chosen chunks' files are opened."""
    paths = chunk_paths(spark, folder, start, end, pattern)
    tagged = T.StructType([*schema.fields, T.StructField("chunk", T.LongType())])
    if not paths:
        return spark.createDataFrame([], tagged)
    before, after = (re.escape(part) for part in pattern.split("{i}"))
    rows = _reader(spark, schema, sep, header, multiline, null=null).csv(paths)
    number = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), f"/{before}(\\d+){after}(/|$)", 1)
    return rows.select(*(F.col(f"`{f.name}`") for f in schema), number.cast("bigint").alias("chunk"))


def sample_chunks(
    df: DataFrame, n: int, low: int, high: int, seed: int = 42, chunk: str = "chunk"
) -> DataFrame:
    """Rows of ``n`` distinct chunk numbers of [low, high), drawn by hash order; absent chunks give no rows.

    The draw is a distributed top-n over the range, and the join prunes
    partitions when the data is laid out by chunk.
    """
    numbers = df.sparkSession.range(low, high).select(F.col("id").alias(chunk))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(chunk).cast("string")))
    return df.join(numbers.orderBy(order, chunk).limit(n), chunk, "left_semi")


def _data_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(file, bytes) of the data files under a path; a plain file stands for itself."""
    fs, location = _file_system(spark, path)
    status = fs.getFileStatus(location)
    if status.isFile():
        return [(path, status.getLen())]
    found, files = [], fs.listFiles(location, True)
    while files.hasNext():
        item = files.next()
        if not item.getPath().getName().startswith(("_", ".")):
            found.append((item.getPath().toString(), item.getLen()))
    return found


def _distinct_names(names: Sequence[str]) -> tuple[str, ...]:
    seen: dict[str, int] = {}
    out: list[str] = []
    for name in names:
        plain, again = name, seen.get(name, 0)
        while again and (name := f"{plain}.{again}") in (*names, *out):
            again += 1
        seen[plain] = again + 1
        out.append(name)
    return tuple(out)


@dataclass(frozen=True)
class ChunkScan:
    """The cleaned rows of all whole files, and (file, reason) of those left out."""

    rows: DataFrame
    quarantine: DataFrame


def scan_chunks(
    spark: SparkSession, paths: Sequence[str], feature: str | Sequence[str], target: str | Sequence[str], sep: str = ";",
    schema: T.StructType | None = None, multiline: bool = False,
) -> ChunkScan:
    """The cleaning scan over text chunks with header lines.

    Cells lose their blanks, null tokens become null, wanted columns are kept
    where a chunk has them, chunks are united by name, and rows with a null
    in a wanted column are dropped. Of equal header names the first keeps its
    name, later ones get ``.1``, ``.2`` and so on. With ``schema`` the wanted
    scalar columns are typed at the end.

    A task takes whole files, reads header and body once and writes the cells
    of wanted columns, and after the last line of a file one row that commits
    it. A file that is empty, broken (also in the middle of its compressed
    body), without a wanted column, with a line longer than its header, with a
    quoted cell over several lines (unless ``multiline``) or beyond ``MAX_FILE_BYTES`` is left out as a whole: its rows
    are passed over, and ``quarantine`` says why. Missing paths are logged. The
    driver handles file names only.
    """
    wanted = list(dict.fromkeys([*as_names(feature), *as_names(target)]))
    listed = [f for path in existing_paths(spark, list(paths)) for f in _data_files(spark, path)]
    files = [f for f, length in listed if 0 < length <= MAX_FILE_BYTES]
    chosen = set(files)
    unread = [(f, "empty file" if not n else f"longer than {MAX_FILE_BYTES} bytes") for f, n in listed if f not in chosen]
    refused = spark.createDataFrame(unread, QUARANTINE)
    if not files:
        return _logged(ChunkScan(spark.createDataFrame([], T.StructType([])), refused))
    found = spark.read.format("binaryFile").load(files).select("path", "content")
    parsed, cells = found.mapInArrow(_parser(wanted, sep, multiline), _parsed_schema(len(wanted))), [f"c{i}" for i in range(len(wanted))]
    # Cells are cleaned before they are staged: a filter over cleaning expressions would clean every cell again.
    clean = nullify_tokens(trim_strings(nullify_tokens(parsed, NA_TOKENS + READER_NA_TOKENS, cells), cells), ("None",), cells)
    lines = stage(clean, "chunk-lines")
    ends = lines.filter(F.col("reason").isNotNull() | F.col("present").isNotNull()).select("file", "reason", "present")
    broken = ends.filter(F.col("reason").isNotNull()).select("file", "reason")
    quarantine = broken.unionByName(refused)
    here = {r["i"] for r in ends.filter(F.col("reason").isNull()).select(F.explode("present").alias("i")).distinct().collect()}
    body = lines.filter(F.col("reason").isNull() & F.col("present").isNull()).join(broken, "file", "left_anti")
    rows = body.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(wanted) if i in here))
    if not here:
        return _logged(ChunkScan(spark.createDataFrame([], T.StructType([])), quarantine))
    rows = drop_null_rows(rows, [c for i, c in enumerate(wanted) if i in here])
    return _logged(ChunkScan(rows if schema is None else typed_scalars(rows, schema), quarantine))


def _logged(scan: ChunkScan) -> ChunkScan:
    for row in scan.quarantine.orderBy("file").limit(LOGGED_FILES).collect():
        _log.warning("file %s left out: %s", row["file"], row["reason"])
    return scan


def combine_chunks(
    spark: SparkSession, paths: Sequence[str], feature: str | Sequence[str], target: str | Sequence[str], sep: str = ";",
    schema: T.StructType | None = None, multiline: bool = False,
) -> DataFrame:
    """The rows of :func:`scan_chunks`; files left out are logged."""
    return scan_chunks(spark, paths, feature, target, sep, schema, multiline).rows


def _parsed_schema(n_cells: int) -> str:
    return "file string, reason string, present array<int>" + "".join(f", c{i} string" for i in range(n_cells))


class _BadFile(Exception):
    pass


def _opened(path: str, content: bytes) -> io.BufferedIOBase:
    """The bytes of a file, decompressed while they are read."""
    raw: io.BufferedIOBase = io.BytesIO(content)
    kind = path.rsplit(".", 1)[-1] if "." in path.rsplit("/", 1)[-1] else ""
    if kind == "gz":
        raw = gzip.GzipFile(fileobj=raw)
    elif kind == "bz2":
        raw = bz2.BZ2File(raw)
    elif kind == "deflate":
        raw = io.BytesIO(zlib.decompress(content))
    elif kind in ("zst", "lz4", "snappy"):
        raise _BadFile(f"compression {kind} is not read")
    return raw


class _Blocks:
    """Blocks of whole lines of a file, read one ahead when asked to."""

    def __init__(self, raw: io.BufferedIOBase) -> None:
        self.raw, self.ahead = raw, None

    def take(self) -> bytes:
        """The next block; empty at the end."""
        block, self.ahead = self.ahead, None
        return self.raw.read(BLOCK_BYTES) + self.raw.readline() if block is None else block

    def look(self) -> bytes:
        """The block that :meth:`take` gives next."""
        self.ahead = self.take()
        return self.ahead


def _texts(block: bytes) -> io.StringIO:
    return io.StringIO(block.decode("utf-8", errors="replace"), newline="")


def _lines(
    path: str, content: bytes, wanted: Sequence[str], sep: str, multiline: bool, whole: bool = False
) -> Iterator[list]:
    """First the places of the wanted columns that the header has, then blocks of cells: of every wanted column a list or array.

    The file goes through one CSV reader if ``whole``, if cells may span lines, or if its header is not plain.
    """
    csv.field_size_limit(1 << 30)
    blocks = _Blocks(_opened(path, content))
    title, _, block = (b"" if whole else blocks.take()).partition(b"\n")
    whole = whole or multiline or sep == " " or not sep.isascii() or any(c in title for c in (b'"', b"\r"))
    first = io.TextIOWrapper(_opened(path, content), "utf-8", errors="replace", newline="") if whole else _texts(title)
    reader = csv.reader(first, delimiter=sep, skipinitialspace=True)
    header = next(reader, None)
    if not header:
        raise _BadFile("empty file")
    names = normalised_names(_distinct_names([header[0].removeprefix("\ufeff"), *header[1:]]))
    places = [(i, names.index(c)) for i, c in enumerate(wanted) if c in names]
    if not places:
        raise _BadFile("no wanted column")
    yield [i for i, _ in places]
    if whole:
        yield from _read_cells(reader, len(wanted), places, len(names), multiline, None)
        return
    while block or (block := blocks.take()):
        cells = None if any(c in block for c in (b'"', b"\r", b"\0")) else _split_cells(block, len(wanted), places, len(names), sep)
        if cells is None:
            held = _texts(block).readlines()
            # A cell that is open at the end of the block goes on in the line after it, if there is one.
            after = (line for line in _texts(blocks.look().partition(b"\n")[0]))
            lines = csv.reader(chain(held, after), delimiter=sep, skipinitialspace=True)
            yield from _read_cells(lines, len(wanted), places, len(names), multiline, len(held))
        else:
            yield cells
        block = b""


def _split_cells(block: bytes, n: int, places: Sequence[tuple[int, int]], width: int, sep: str) -> list | None:
    """Cells of lines without quotes that are as long as the header; None if other lines or bad text are among them."""
    if block.startswith(b"\xef\xbb\xbf"):  # the mark would be taken off, here it is text
        return None
    names = [str(k) for k in range(width)]
    read = pa_csv.ReadOptions(use_threads=False, block_size=len(block) + 1, column_names=names)
    parse = pa_csv.ParseOptions(delimiter=sep, quote_char=False, double_quote=False, escape_char=False)
    kinds = {names[at]: pa.string() for _, at in places}
    convert = pa_csv.ConvertOptions(column_types=kinds, include_columns=list(kinds), strings_can_be_null=False)
    try:
        table = pa_csv.read_csv(pa.BufferReader(block), read, parse, convert).combine_chunks()
    except pa.ArrowInvalid:
        return None
    out: list = [pa.nulls(table.num_rows, pa.string())] * n
    for i, at in places:
        cells = pc.utf8_ltrim(table.column(names[at]), " ")
        cells = pc.if_else(pc.equal(cells, ""), pa.scalar(None, pa.string()), cells)
        out[i] = cells.chunk(0) if cells.num_chunks == 1 else pa.concat_arrays(cells.chunks or [pa.array([], pa.string())])
    return out


def _read_cells(
    reader, n: int, places: Sequence[tuple[int, int]], width: int, multiline: bool, end: int | None
) -> Iterator[list]:
    """Cells of the lines of a reader, up to so many of its lines if ``end`` is given."""
    rows: list[list] = []
    read = reader.line_num
    while end is None or read < end:
        line = next(reader, None)
        if line is None:
            break
        if not multiline and reader.line_num > read + 1:
            raise _BadFile("a quoted cell goes on in the next line")
        read = reader.line_num
        if any(line[width:]):
            raise _BadFile("a line is longer than the header")
        if line:
            out: list[str | None] = [None] * n
            for i, at in places:
                out[i] = line[at] or None if at < len(line) else None
            rows.append(out)
        if len(rows) == PARSED_ROWS:
            yield [list(c) for c in zip(*rows)]
            rows = []
    if rows:
        yield [list(c) for c in zip(*rows)]


_BROKEN = (_BadFile, csv.Error, EOFError, OSError, zlib.error)


def _reason(path: str, content: bytes, wanted: Sequence[str], sep: str, multiline: bool) -> str:
    """What is the first thing wrong with a file, read line by line."""
    try:
        for _ in _lines(path, content, wanted, sep, multiline, whole=True):
            pass
    except _BROKEN as error:
        return f"{error}" if isinstance(error, _BadFile) else "broken file"
    return "broken file"


def _parser(wanted: Sequence[str], sep: str, multiline: bool):
    """Rows of whole files, each file's followed by its commit (the places of its columns) or by a reason."""
    names = ["file", "reason", "present", *(f"c{i}" for i in range(len(wanted)))]
    kinds = [pa.string(), pa.string(), pa.list_(pa.int32()), *[pa.string()] * len(wanted)]

    def batch_of(path: str, cells: Sequence) -> pa.RecordBatch:
        cells = [c if isinstance(c, pa.Array) else pa.array(c, pa.string()) for c in cells]
        n = len(cells[0])
        front = [pa.repeat(pa.scalar(path, pa.string()), n), pa.nulls(n, kinds[1]), pa.nulls(n, kinds[2])]
        return pa.RecordBatch.from_arrays([*front, *cells], names)

    def last(path: str, reason: str | None, present: list[int] | None) -> pa.RecordBatch:
        row = [path, reason, present, *[None] * len(wanted)]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, content = batch.column("path")[k].as_py(), batch.column("content")[k].as_py()
                try:
                    lines = _lines(path, content, wanted, sep, multiline)
                    present = next(lines)
                    for cells in lines:
                        yield batch_of(path, cells)
                    yield last(path, None, present)
                except _BROKEN:
                    yield last(path, _reason(path, content, wanted, sep, multiline), None)

    return run


def typed_scalars(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns to the catalogue's scalar types, bad text to null; list columns stay text."""
    kinds = {f.name: f.dataType for f in schema.fields}
    casts = {}
    for name in df.columns:
        kind = kinds.get(name)
        if kind is None or isinstance(kind, (T.ArrayType, T.StringType)):
            continue
        column = F.col(f"`{name}`")
        casts[name] = column.try_cast(kind) if isinstance(kind, T.BooleanType) else to_double(column).try_cast(kind)
    return df.withColumns(casts)
