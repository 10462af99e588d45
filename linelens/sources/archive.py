"""ZIP archives as a source: a partition for each member, found from the central directory by ranged reads."""

from __future__ import annotations

import csv
import json
import zipfile
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from linelens.functions.expr import q
from linelens.operators import files as file_ops
from linelens.session import materialize
from linelens.sources.tables import list_files, relative, sanitize, sanitize_columns

TEXT_SUFFIXES = (".csv", ".txt", ".tsv")
#: Archives inside archives are followed this deep.
DEPTH = 3
LINES_SCHEMA = "archive string, member string, line long, value binary, status string, reason string"
_LINES = pa.schema([("archive", pa.string()), ("member", pa.string()), ("line", pa.int64()), ("value", pa.binary()),
                    ("status", pa.string()), ("reason", pa.string())])
_BATCH_BYTES = 4 << 20


def _uri(path: str) -> str:
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(_uri(path))
    return system.open_input_file(inner)


def _why(exc: Exception) -> str:
    return f"{type(exc).__name__}: {exc}"[:200]


@dataclass
class _Member(InputPartition):
    path: str
    place: int | None
    problem: str | None = None


class ZipLines(DataSource):
    """``zip_lines``: the lines of the text members of the archives in option ``archives`` (a JSON list of paths).

    Every member has one closing row with its status (READ, EMPTY, SKIPPED, FAILED) and no line. Lines of a damaged
    member come before its FAILED row, since the checksum is known at its end: readers take READ members only.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return LINES_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(json.loads(self.options["archives"]))


class _ZipReader(DataSourceReader):
    def __init__(self, archives: list[str]):
        self.archives = archives

    def partitions(self) -> list[_Member]:
        found = []
        for path in self.archives:
            try:
                with _open(path) as raw, zipfile.ZipFile(raw) as z:
                    found += [_Member(path, k) for k, i in enumerate(z.infolist()) if not i.is_dir()]
            except Exception as exc:  # noqa: BLE001 - recorded in the ledger
                found.append(_Member(path, None, _why(exc)))
        return found

    def read(self, part: _Member):
        if part.place is None:
            yield _closing(part.path, None, "FAILED", part.problem)
            return
        try:
            with _open(part.path) as raw, zipfile.ZipFile(raw) as z:
                yield from _member(z, part.path, part.place, "", 1)
        except Exception as exc:  # noqa: BLE001 - recorded in the ledger
            yield _closing(part.path, f"#{part.place}", "FAILED", _why(exc))


def _closing(archive: str, member: str | None, status: str, reason: str | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"archive": archive, "member": member, "line": None, "value": None, "status": status, "reason": reason}], _LINES)


def _member(z: zipfile.ZipFile, archive: str, place: int, above: str, depth: int):
    """Batches of a member's lines, then its closing row; a nested archive gives those of its own members.

    A name that an archive holds again gets ``#2``, ``#3`` and so on.
    """
    listed = z.infolist()
    inner = listed[place]
    again = sum(i.filename == inner.filename for i in listed[:place])
    label = above + inner.filename + (f"#{again + 1}" if again else "")
    suffix = inner.filename.lower()
    try:
        if suffix.endswith(".zip"):
            if depth >= DEPTH:
                yield _closing(archive, label, "SKIPPED", f"archives are followed {DEPTH} deep")
                return
            with z.open(inner) as raw, zipfile.ZipFile(raw) as nested:
                for k, i in enumerate(nested.infolist()):
                    if not i.is_dir():
                        yield from _member(nested, archive, k, f"{label}/", depth + 1)
            return
        if not suffix.endswith(TEXT_SUFFIXES):
            yield _closing(archive, label, "SKIPPED", "not a delimited text")
            return
        n, lines, size = 0, [], 0
        with z.open(inner) as raw:
            for line in raw:
                lines.append(line.rstrip(b"\r\n"))
                size += len(line)
                if size >= _BATCH_BYTES:
                    yield _batch(archive, label, n, lines)
                    n, lines, size = n + len(lines), [], 0
        if lines:
            yield _batch(archive, label, n, lines)
        yield _closing(archive, label, "READ" if n + len(lines) else "EMPTY", None)
    except Exception as exc:  # noqa: BLE001 - recorded in the ledger
        yield _closing(archive, label, "FAILED", _why(exc))


def _batch(archive: str, member: str, first: int, lines: list[bytes]) -> pa.RecordBatch:
    k = len(lines)
    none = pa.nulls(k, pa.string())
    return pa.RecordBatch.from_arrays([pa.array([archive] * k), pa.array([member] * k), pa.array(range(first, first + k), pa.int64()),
                                       pa.array(lines, pa.binary()), none, none], schema=_LINES)


def archive_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines and closing rows of all archives at or below a path, decompressed once and kept as a table.

    The driver reads central directories (a listing), a task one member: memory is one batch of lines, and a lost task
    reads its member again. A nested archive is one task.
    """
    spark.dataSource.register(ZipLines)
    listed = list_files(spark, root).where(file_ops.suffix_of(F.col("path")) == "zip").select("path")
    paths = sorted(r["path"] for r in listed.collect())
    if not paths:
        return spark.createDataFrame([], LINES_SCHEMA)
    return materialize(spark.read.format("zip_lines").option("archives", json.dumps(paths)).load())


def archive_ledger(lines: DataFrame, root: str) -> DataFrame:
    """(archive, member, status, reason, lines, header, latin1) of every member; an archive that does not open has a null member."""
    text = F.col("value").cast("string")
    return lines.groupBy("archive", "member").agg(
        F.max("status").alias("status"), F.max("reason").alias("reason"), F.count("line").alias("lines"),
        F.max(F.when(F.col("line") == 0, F.col("value"))).alias("header"),
        (F.count_if(F.col("line").isNotNull() & ~F.is_valid_utf8(text)) > 0).alias("latin1")).withColumn("archive", relative(F.col("archive"), root))


def archive_rows(lines: DataFrame, schema: str, sep: str = ",") -> DataFrame:
    """All READ members of one layout as one table, with their archive and member. Lines that do not fit give nulls.

    A field may not hold a line feed, as in Spark's own reader. Headers are the first lines and blank lines are no rows.
    """
    # a table of its own: Spark sees its true size and chooses the join by it
    good = materialize(lines.where("status = 'READ'").select("archive", "member"))
    data = lines.where("line > 0 AND octet_length(value) > 0").join(good, ["archive", "member"], "left_semi")
    return data.select("archive", "member", "line", F.from_csv(F.col("value").cast("string"), schema, {"sep": sep}).alias("row")).select(
        "archive", "member", "line", "row.*")


def _cells(header: bytes, latin1: bool, member: str) -> tuple[list[str], str]:
    text = header.decode("iso-8859-1" if latin1 else "utf-8").removeprefix("﻿")
    cells = next(csv.reader([text]), [])
    if len(cells) == 1 and not member.lower().endswith(".csv") and "\t" in text:
        return next(csv.reader([text], delimiter="\t")), "\t"
    return cells, ","


def _typed(df: DataFrame) -> DataFrame:
    """Columns whose every value reads as long, else as double, get that type; one aggregation over the table."""
    kinds = ("bigint", "double")
    row = df.agg(*[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(df.columns)],
                 *[F.count(q(c).try_cast(k)).alias(f"{k}{i}") for i, c in enumerate(df.columns) for k in kinds]).first()
    pick = lambda i: next((k for k in kinds if row[f"n{i}"] and row[f"{k}{i}"] == row[f"n{i}"]), "string")
    return df.select(*[q(c).cast(pick(i)).alias(c) for i, c in enumerate(df.columns)])


def scan_archives(spark: SparkSession, root: str, infer: bool = True) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each delimited member of each archive as its own table, and the ledger of all members with what failed.

    UTF-8 unless a line does not decode; members of one name in two archives both count. The loop runs over a listing.
    """
    lines = archive_lines(spark, root)
    ledger = archive_ledger(lines, root)
    tables: dict[str, DataFrame] = {}
    listed = relative(F.col("archive"), root)
    for m in ledger.where("status = 'READ'").orderBy("archive", "member").collect():
        name = base = sanitize(f"{m['archive'].rsplit('.', 1)[0]}_{m['member'].rsplit('.', 1)[0]}")
        while name in tables:
            name = f"{base}_{len(tables)}"
        cells, sep = _cells(m["header"], m["latin1"], m["member"])
        text = F.decode("value", "ISO-8859-1") if m["latin1"] else F.col("value").cast("string")
        own = lines.where((listed == m["archive"]) & (F.col("member") == m["member"]) & (F.col("line") > 0) & (F.octet_length("value") > 0))
        # positions as names first: headers may be empty or repeat
        row = F.from_csv(text, ", ".join(f"c{i} string" for i in range(len(cells))), {"sep": sep})
        names: list[str] = []
        for i, c in enumerate(cells):
            safe = c or f"_c{i}"
            names.append(safe if safe not in names else f"{safe}_{i}")
        table = sanitize_columns(own.select(row.alias("row")).select("row.*").toDF(*names))[0]
        tables[name] = _typed(table) if infer else table
    return tables, ledger.drop("header", "latin1")


def write_archives(df: DataFrame, path: str, member: str, order_cols: list[str], archives: int) -> DataFrame:
    """Rows as CSV members (named by a column) of ``archives`` ZIP files; the manifest (archive, member, lines).

    Rows meet by member, so a member lies whole in one archive; it is written as a stream in the order given. A task that
    runs again writes its archive anew under the same name. A null member is named ``_``. Commas, quotes and line feeds are quoted by the CSV rules;
    ``archive_rows`` reads fields without line feeds.
    """
    data = [c for c in df.columns if c != member]
    text = F.to_csv(F.struct(*[q(c) for c in data]))
    rows = df.select(F.coalesce(q(member).cast("string"), F.lit("_")).alias("member"), text.alias("text"), *[q(c).alias(f"_o{i}") for i, c in enumerate(order_cols)])
    placed = rows.repartition(archives, "member").sortWithinPartitions("member", *[f"_o{i}" for i in range(len(order_cols))]).select("member", "text")
    header = ",".join(data) + "\n"

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():05d}.zip"
        system, folder = fs.FileSystem.from_uri(_uri(path))
        archive = raw = out = current = None
        counts: dict[str, int] = {}
        for b in batches:
            for key, lines in b.to_pandas().groupby("member", sort=False)["text"]:
                if archive is None:
                    system.create_dir(folder, recursive=True)
                    raw = system.open_output_stream(f"{folder}/{name}")
                    archive = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED)
                if key != current:
                    if out is not None:
                        out.close()
                    out, current = archive.open(f"{key}.csv", "w", force_zip64=True), key
                    out.write(header.encode())
                    counts[key] = 1
                out.write(("\n".join(lines) + "\n").encode())
                counts[key] += len(lines)
        if archive is not None:
            out.close()
            archive.close()
            raw.close()
        yield pa.RecordBatch.from_pylist([{"archive": name, "member": f"{k}.csv", "lines": n} for k, n in counts.items()],
                                         pa.schema([("archive", pa.string()), ("member", pa.string()), ("lines", pa.int64())]))

    return materialize(placed.mapInArrow(write, "archive string, member string, lines long"))
