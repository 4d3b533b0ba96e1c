"""Load and dump: Parquet through Spark, Arrow IPC files through executors that read and write them on their own."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from brindle.errors import SymbolNotFound, Unsupported


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.removeprefix("file:"))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register_tables(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Temporary views over the Parquet tables of a folder."""
    for n in names:
        read_table(spark, folder, n).createOrReplaceTempView(n)


def dump_parquet(df: DataFrame, path: str, rows_per_file: int = 0) -> list[str]:
    """Write Snappy Parquet files (none but a schema file for no rows); their names, one for each written file."""
    df.write.option("compression", "snappy").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return sorted(r[0] for r in df.sparkSession.read.parquet(path).select(F.input_file_name()).distinct().collect())


def load_parquet(spark: SparkSession, paths: list[str], columns: dict[str, str | int] | None = None) -> DataFrame:
    """Files as rows; columns maps parameter names to file columns by name or by place from 0."""
    return mapped(spark.read.parquet(*paths), columns)


def mapped(df: DataFrame, columns: dict[str, str | int] | None) -> DataFrame:
    if columns is None:
        return df
    out = []
    for name, c in columns.items():
        if isinstance(c, int) and not 0 <= c < len(df.columns) or isinstance(c, str) and c not in df.columns:
            raise SymbolNotFound(f"file column {c}")
        out.append(F.col(df.columns[c] if isinstance(c, int) else c).alias(name))
    return df.select(*out)


def dump_arrow(df: DataFrame, path: str, batch_rows: int = 10_000, metadata_version: str = "V5", fixed_char: dict[str, int] | None = None) -> list[str]:
    """Write one Arrow IPC file for each partition that has rows; their names.

    A task writes under a name of its own; what counts is the names returned. fixed_char gives text columns a
    fixed width in bytes, blank-padded. Rows never come to the driver.
    """
    if metadata_version not in ("V4", "V5"):
        raise Unsupported(f"Arrow metadata {metadata_version}")
    schema = to_arrow_schema(df.schema)
    for c, n in (fixed_char or {}).items():
        schema = schema.set(schema.get_field_index(c), pa.field(c, pa.binary(n)))
    version = getattr(pa.ipc.MetadataVersion, metadata_version)

    def write(batches):
        out = None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs, folder = file_system(path)
                fs.create_dir(folder, recursive=True)
                name = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.arrow"
                sink = fs.open_output_stream(f"{folder}/{name}", compression=None)
                out = pa.ipc.new_file(sink, schema, options=pa.ipc.IpcWriteOptions(metadata_version=version))
            t = pa.Table.from_batches([b])
            for c, n in (fixed_char or {}).items():
                padded = [None if v is None else v.encode()[:n].ljust(n) for v in t[c].to_pylist()]
                t = t.set_column(t.schema.get_field_index(c), c, pa.array(padded, pa.binary(n)))
            out.write_table(t.cast(schema), max_chunksize=batch_rows)
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    return sorted(f"{path}/{r.name}" for r in df.mapInArrow(write, "name string").collect())


def load_arrow(spark: SparkSession, paths: list[str], columns: dict[str, str | int] | None = None, schema: str | None = None) -> DataFrame:
    """Arrow IPC files as rows, read batch by batch by as many tasks as there are files."""
    if schema is None:
        fs, first = file_system(paths[0])
        with fs.open_input_file(first) as f:
            arrow = pa.ipc.open_file(f).schema
        arrow = pa.schema([pa.field(c.name, pa.string()) if pa.types.is_fixed_size_binary(c.type) else c for c in arrow])
        spark_schema = from_arrow_schema(arrow, prefer_timestamp_ntz=True)
    else:
        spark_schema = spark.createDataFrame([], schema).schema
    target = to_arrow_schema(spark_schema)

    def read(batches):
        for b in batches:
            for p in b["path"].to_pylist():
                fs, local = file_system(p)
                with fs.open_input_file(local) as f:
                    r = pa.ipc.open_file(f)
                    for i in range(r.num_record_batches):
                        t = pa.Table.from_batches([r.get_batch(i)])
                        for c in t.schema:
                            if pa.types.is_fixed_size_binary(c.type):
                                t = t.set_column(t.schema.get_field_index(c.name), c.name, t[c.name].cast(pa.binary()).cast(pa.string()))
                        yield from t.select(target.names).cast(target).to_batches()

    names = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return mapped(names.mapInArrow(read, spark_schema), columns)
