"""Reading delimited files and table sets, fingerprints, container sniffing, sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linelens.functions.expr import q
from linelens.operators import files as file_ops

TABLE_SUFFIXES = ["csv", "txt", "tsv", "parquet", "json", "orc"]
CORRUPT = "_corrupt_record"


def sanitize(name: str) -> str:
    """Column or table name that is safe in a path and in SQL."""
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", name).strip("_") or "table"


def sanitize_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Safe column names, and the map back to the original ones (role patterns look at those)."""
    names: dict[str, str] = {}
    for c in df.columns:
        base = safe = sanitize(c).replace(".", "_")
        n = 2
        while safe in names:
            safe, n = f"{base}_{n}", n + 1
        names[safe] = c
    return df.select(*[q(o).alias(s) for s, o in names.items()]), names


def _header(spark: SparkSession, path: str, sep: str, encoding: str) -> list[str]:
    return spark.read.options(header=True, sep=sep, encoding=encoding).csv(path).columns


def scan_delimited(spark: SparkSession, path: str, schema: str | None = None, keep_corrupt: bool = False) -> DataFrame:
    """CSV, TSV or TXT with a header. UTF-8 unless the text does not decode; one-column text is read again by TAB.

    Pass a schema at scale: inferring types reads the data twice. Raises ValueError EMPTY_FILE
    for a file without a header.
    """
    lines = spark.read.text(path).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.is_valid_utf8("value")).alias("broken")).first()
    if not lines["n"]:
        raise ValueError(f"EMPTY_FILE: '{path}' holds no tabular data")
    broken = lines["broken"] > 0
    encoding = "ISO-8859-1" if broken else "UTF-8"
    sep = ","
    if re.search(r"\.(txt|tsv)$", path, re.I) and len(_header(spark, path, ",", encoding)) == 1 and len(_header(spark, path, "\t", encoding)) > 1:
        sep = "\t"
    reader = spark.read.options(header=True, sep=sep, encoding=encoding, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    if schema:
        return reader.schema(schema + (f", {CORRUPT} string" if keep_corrupt else "")).csv(path)
    return reader.option("inferSchema", True).csv(path)


def parse_errors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that do not fit the schema: the error ledger of a delimited file."""
    df = spark.read.options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT).schema(f"{schema}, {CORRUPT} string").csv(path)
    # the reader wants a data column in the condition as well
    data = [q(c).cast("string") for c in df.columns if c != CORRUPT]
    held = F.length(F.concat_ws("", F.col(CORRUPT), *data)) > 0
    return df.where(F.col(CORRUPT).isNotNull() & held).select(F.col(CORRUPT).alias("line"), F.input_file_name().alias("path"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified) of every file below a folder; the content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(
        "path", "length", F.col("modificationTime").alias("modified"))


def relative(path: Column, root: str) -> Column:
    """A file's path below the root: the name that tells two files of one name apart."""
    base = re.sub(r"^[a-z0-9+.-]+:/*", "/", root.rstrip("/"), flags=re.I)
    return F.regexp_replace(path, "^.*?" + re.escape(base) + "/", "")


def table_ledger(spark: SparkSession, root: str) -> DataFrame:
    """Every file below a folder with what happens to it: READ, SKIPPED (not a table) or EMPTY."""
    listed = list_files(spark, root)
    suffix = file_ops.suffix_of(F.col("path"))
    return listed.select(
        relative(F.col("path"), root).alias("file"), "path", suffix.alias("suffix"), "length",
        F.when(F.col("length") == 0, "EMPTY").when(suffix.isin(TABLE_SUFFIXES), "READ").otherwise("SKIPPED").alias("status"))


def scan_table_set(spark: SparkSession, root: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table file below a folder as its own DataFrame, plus the ledger with what failed.

    Tables are named by their path below the folder, so files of one name in two folders both count. The loop runs over file names (a listing), never over data.
    """
    ledger = table_ledger(spark, root)
    tables, failed = {}, []
    for r in ledger.where("status = 'READ'").collect():
        name = base = sanitize(r["file"].rsplit(".", 1)[0])
        while name in tables:
            name = f"{base}_{len(tables)}"
        try:
            path = r["path"]
            tables[name] = (spark.read.format(r["suffix"]).load(path) if r["suffix"] in ("parquet", "json", "orc")
                            else scan_delimited(spark, path))
        except Exception as exc:  # noqa: BLE001 - recorded in the ledger
            failed.append((r["file"], str(exc).split("\n")[0][:200]))
    notes = spark.createDataFrame(failed, "file string, reason string")
    return tables, ledger.drop("path").join(F.broadcast(notes), "file", "left").withColumn(
        "status", F.when(F.col("reason").isNotNull(), "FAILED").otherwise(F.col("status")))


def fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """Size, sha-256 and 12-digit dataset id per file. Files are streamed in 4 MB pieces inside the tasks."""
    import pandas as pd

    listed = list_files(spark, root)

    def digest(batches):
        import hashlib

        from pyarrow import fs

        for b in batches:
            out = []
            for path in b["path"]:
                uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path
                system, inner = fs.FileSystem.from_uri(uri)
                h = hashlib.sha256()
                with system.open_input_stream(inner) as stream:
                    while piece := stream.read(4 << 20):
                        h.update(piece)
                out.append(h.hexdigest())
            yield pd.DataFrame({"path": b["path"], "size_bytes": b["length"], "sha256": out})

    done = listed.select("path", "length").repartition("path").mapInPandas(digest, "path string, size_bytes long, sha256 string")
    return done.select(F.element_at(F.split("path", "/"), -1).alias("file"), "size_bytes", "sha256", F.substring("sha256", 1, 12).alias("dataset_id"))


def container_kind(head: Column, path: Column) -> Column:
    """Container from the first bytes, else from the suffix."""
    h = F.hex(F.substring(head, 1, 19))
    suffix = file_ops.suffix_of(path)
    return (F.when(h.startswith("504B0304"), "zip").when(h.startswith("4D41544C414220352E30204D41542D66696C65"), "mat")
            .when(h.startswith("D0CF11E0A1B11AE1"), "ole").when(h.startswith("50415231"), "parquet")
            .when(suffix.isin("csv", "txt", "tsv"), "text").when(suffix.isin("xlsx", "xlsm"), "xlsx").when(suffix == "xls", "ole").otherwise("unknown"))


def mat_header_valid(head: Column) -> Column:
    """Version 0x0100 and an endian mark in bytes 125 to 128 of a MAT file."""
    mark = F.hex(F.substring(head, 125, 4))
    return mark.isin("0001494D", "00014D49")


def sniff_containers(spark: SparkSession, root: str) -> DataFrame:
    """Container kind of each file; only the first 128 bytes are read."""
    import pandas as pd

    def heads(batches):
        from pyarrow import fs

        for b in batches:
            out = []
            for path in b["path"]:
                uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path
                system, inner = fs.FileSystem.from_uri(uri)
                with system.open_input_stream(inner) as stream:
                    out.append(stream.read(128))
            yield pd.DataFrame({"path": b["path"], "head": out})

    read = list_files(spark, root).select("path").mapInPandas(heads, "path string, head binary")
    return read.select(F.element_at(F.split("path", "/"), -1).alias("file"), container_kind(F.col("head"), F.col("path")).alias("container"),
                       F.when(container_kind(F.col("head"), F.col("path")) == "mat", mat_header_valid(F.col("head"))).alias("mat_valid"))


def scan_labelled(spark: SparkSession, root: str) -> DataFrame:
    """Image files below a folder with class and split folder taken from the path; content is not read."""
    base = root.rstrip("/")
    path = F.regexp_replace("path", "^.*" + re.escape(base) + "/", "")
    return list_files(spark, root).select(path.alias("path"), "length").where(
        file_ops.suffix_of(F.col("path")).isin("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp", "ppm", "pgm")).select(
        "path", "length", file_ops.class_folder(F.col("path")).alias("class_folder"), file_ops.split_folder(F.col("path")).alias("split_folder"))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write all rows as parquet and return the manifest row (rows counted from the written table)."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    rows = df.sparkSession.read.parquet(path).count()
    return df.sparkSession.createDataFrame([(path.rsplit("/", 1)[1], rows, rows, False)], "file string, rows long, stored_rows long, truncated boolean")


def export_csv(df: DataFrame, path: str, order_cols: list[str], row_cap: int | None = None) -> DataFrame:
    """Compressed CSV export; the optional row cap is a stated limit of the export, noted in the manifest."""
    rows = df.count()
    capped = row_cap is not None and rows > row_cap
    out = df.orderBy(*order_cols).limit(row_cap) if capped else df
    out.write.mode("overwrite").options(header=True, compression="gzip").csv(path)
    return df.sparkSession.createDataFrame([(path.rsplit("/", 1)[1], rows, row_cap if capped else rows, capped)],
                                           "file string, rows long, stored_rows long, truncated boolean")
