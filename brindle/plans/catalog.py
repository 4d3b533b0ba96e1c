"""Tables with keys, defaults and identity columns, on immutable Parquet versions.

Every write makes a new version of the whole table beside the old one and then points to it: a
reader keeps the version it started with, a failed write leaves nothing behind. This suits bulk
writes; there are no isolation levels and no grants.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.errors import AlreadyExists, Restricted, SymbolNotFound, TypeRefused, UniqueViolation
from brindle.functions.casts import RANGES, assign, stored
from brindle.operators import writes

#: The file of a folder that holds its tables' definitions.
DEFINITIONS = "definitions.json"
#: DEFAULT functions without arguments.
TIME_DEFAULTS = {"current_date": F.current_date, "current_timestamp": F.current_timestamp, "localtimestamp": F.localtimestamp}


@dataclass
class Identity:
    """GENERATED ALWAYS (explicit values are refused) or BY DEFAULT AS IDENTITY."""

    always: bool = True
    start: int = 1
    increment: int = 1


@dataclass
class ColumnSpec:
    name: str
    type: str
    not_null: bool = False
    #: A literal of the column's type, or a name in TIME_DEFAULTS with ().
    default: object = None
    identity: Identity | None = None


@dataclass
class TableSpec:
    name: str
    columns: list[ColumnSpec]
    key: list[str] = field(default_factory=list)
    indexes: dict[str, list[str]] = field(default_factory=dict)
    next_identity: dict[str, int] = field(default_factory=dict)
    path: str | None = None

    @property
    def schema(self) -> str:
        return ", ".join(f"`{c.name}` {stored(c.type)}" for c in self.columns)

    def column(self, name: str) -> ColumnSpec:
        for c in self.columns:
            if c.name == name:
                return c
        raise SymbolNotFound(f"{self.name}.{name}")


class Database:
    """A set of tables in a folder. Their definitions are kept there too, and found again by the next Database of the folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.tables = spark, folder.rstrip("/"), {}
        path, fs = self._file(DEFINITIONS)
        if fs.exists(path):
            stream = fs.open(path)
            try:
                found = json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
            finally:
                stream.close()
            for t in found:
                columns = [ColumnSpec(**{**c, "identity": c["identity"] and Identity(**c["identity"])}) for c in t.pop("columns")]
                self.tables[t["name"]] = TableSpec(columns=columns, **t)
                self.table(t["name"]).createOrReplaceTempView(t["name"])

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _keep(self) -> None:
        """Definitions as they are now, in place of the former."""
        (path, fs), (new, _) = self._file(DEFINITIONS), self._file(f"{DEFINITIONS}.{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps([asdict(t) for t in self.tables.values()], default=str).encode()))
        out.close()
        fs.delete(path, False)
        fs.rename(new, path)

    # definitions

    def create_table(self, name: str, columns: list[ColumnSpec], key: list[str] | None = None) -> None:
        if name in self.tables:
            raise AlreadyExists(name)
        spec = TableSpec(name, columns, key or [])
        for c in spec.key:
            spec.column(c).not_null = True
        for c in columns:
            if c.identity and stored(c.type) not in RANGES:
                raise TypeRefused(f"an identity of type {c.type}")
            if isinstance(c.default, str) and c.default.endswith("()") and c.default[:-2] not in TIME_DEFAULTS:
                raise SymbolNotFound(c.default)
            if c.identity:
                spec.next_identity[c.name] = c.identity.start
        self.tables[name] = spec
        self.table(name).createOrReplaceTempView(name)
        self._keep()

    def drop_table(self, name: str, if_exists: bool = False) -> None:
        if self.tables.pop(name, None) is None and not if_exists:
            raise SymbolNotFound(name)
        self.spark.catalog.dropTempView(name)
        self._keep()

    def create_index(self, table: str, name: str, columns: list[str]) -> None:
        """Kept as a definition: files are pruned by their statistics instead. Only on an empty table."""
        spec = self._spec(table)
        if any(name in t.indexes for t in self.tables.values()):
            raise AlreadyExists(name)
        if self.table(table).limit(1).count():
            raise Restricted("the table is not empty")
        spec.indexes[name] = [spec.column(c).name for c in columns]
        self._keep()

    def drop_index(self, name: str) -> None:
        for t in self.tables.values():
            if t.indexes.pop(name, None):
                return self._keep()
        raise SymbolNotFound(name)

    def list_tables(self) -> list[str]:
        return sorted(self.tables)

    def describe(self, name: str) -> DataFrame:
        spec = self._spec(name)
        rows = [(c.name, c.type, not c.not_null, c.name in spec.key, None if c.default is None else str(c.default)) for c in spec.columns]
        return self.spark.createDataFrame(rows, "column_name string, data_type string, nullable boolean, in_key boolean, default_value string")

    # content

    def _spec(self, name: str) -> TableSpec:
        if name not in self.tables:
            raise SymbolNotFound(name)
        return self.tables[name]

    def table(self, name: str) -> DataFrame:
        spec = self._spec(name)
        return self.spark.read.schema(spec.schema).parquet(spec.path) if spec.path else self.spark.createDataFrame([], spec.schema)

    def _written(self, spec: TableSpec, content: DataFrame, what: str = "") -> tuple[DataFrame, str]:
        """content, evaluated once and read back."""
        path = f"{self.folder}/{spec.name}/{uuid.uuid4().hex}{what}"
        content.write.parquet(path)
        return self.spark.read.schema(content.schema).parquet(path), path

    def _store(self, name: str, content: DataFrame, key: list[str] | None = None, checked: bool = False) -> DataFrame:
        """Write a new version, look at what was written, then point to it. A version that is refused is removed."""
        spec = self.tables[name]
        out, path = self._written(spec, content)
        try:
            if not checked:
                writes.check_not_null(out, [c.name for c in spec.columns if c.not_null])
            if key and out.groupBy(*key).count().where("count > 1").limit(1).count():
                raise UniqueViolation(", ".join(key))
        except Exception:
            where, fs = self._file(path[len(self.folder) + 1 :])
            fs.delete(where, True)
            raise
        spec.path = path
        self._keep()
        out = self.table(name)
        out.createOrReplaceTempView(name)
        return out

    def _filled(self, spec: TableSpec, rows: DataFrame) -> DataFrame:
        """Rows with all columns: absent ones get their default, the next identity value, or null."""
        for c in rows.columns:
            if (found := spec.column(c)).identity and found.identity.always:
                raise Restricted(f"{c} is GENERATED ALWAYS")
        out = rows
        for c in spec.columns:
            if c.name in rows.columns:
                source = rows.schema[c.name].dataType.simpleString()
                try:
                    out = out.withColumn(c.name, assign(F.col(c.name), source, c.type))
                except TypeError as e:
                    raise TypeRefused(f"{c.name}: {e}") from e
            elif c.identity:
                # numbered by partition: distinct, and dense within one
                out = self._numbered(spec, out, c)
            elif isinstance(c.default, str) and c.default.endswith("()"):
                value = TIME_DEFAULTS[c.default[:-2]]()
                out = out.withColumn(c.name, value)
                if out.schema[c.name].dataType.simpleString() != stored(c.type):
                    raise TypeRefused(f"the default of {c.name} is not {c.type}")
            else:
                out = out.withColumn(c.name, F.lit(c.default).cast(stored(c.type)))
        filled, path = self._written(spec, out.select(*(c.name for c in spec.columns)), "-rows")
        return writes.check_not_null(filled, [c.name for c in spec.columns if c.not_null])

    def _numbered(self, spec: TableSpec, rows: DataFrame, c: ColumnSpec) -> DataFrame:
        path = f"{self.folder}/{spec.name}/{uuid.uuid4().hex}-numbered"
        rows.withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
        kept = self.spark.read.parquet(path)
        from pyspark.sql import Window

        part = F.shiftright("__at", 33)
        sizes = kept.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
        before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n"))
        start, step = spec.next_identity[c.name], c.identity.increment
        out = kept.withColumn("__part", part).join(before, "__part").withColumn(c.name, (F.lit(start) + (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))) * step).cast(stored(c.type)))
        spec.next_identity[c.name] = start + step * kept.count()
        return out.drop("__at", "__part", "__n", "__before")

    def insert(self, name: str, rows: DataFrame, mode: str = "", order: list[Column] | None = None) -> DataFrame:
        """mode: empty (a repeated key is an error), ignore or replace."""
        spec = self._spec(name)
        rows = self._filled(spec, rows)
        old = self.table(name)
        if not mode or not spec.key:
            new = writes.insert(old, rows, spec.key)
        elif mode == "ignore":
            new = writes.insert_or_ignore(old, rows, spec.key, order)
        elif mode == "replace":
            new = writes.insert_or_replace(old, rows, spec.key, order)
        else:
            raise TypeRefused(mode)
        return self._store(name, new, checked=True)

    def insert_values(self, name: str, rows: list[tuple], columns: list[str] | None = None, mode: str = "") -> DataFrame:
        spec = self._spec(name)
        names = columns or [c.name for c in spec.columns if not (c.identity and c.identity.always)]
        schema = ", ".join(f"`{n}` {stored(spec.column(n).type)}" for n in names)
        return self.insert(name, self.spark.createDataFrame(rows, schema), mode)

    def update(self, name: str, condition: Column, **assignments: Column) -> DataFrame:
        spec = self._spec(name)
        for c in assignments:
            if (found := spec.column(c)).identity and found.identity.always:
                raise Restricted(f"{c} is GENERATED ALWAYS")
        new = writes.update(self.table(name), condition, None, {c.name: c.type for c in spec.columns}, **assignments)
        return self._store(name, new, spec.key if set(spec.key) & set(assignments) else None)

    def delete(self, name: str, condition: Column) -> DataFrame:
        return self._store(name, writes.delete(self.table(name), condition), checked=True)

    def truncate(self, name: str, restart_identity: bool = False) -> None:
        spec = self._spec(name)
        spec.path = None
        if restart_identity:
            spec.next_identity = {c.name: c.identity.start for c in spec.columns if c.identity}
        self.table(name).createOrReplaceTempView(name)
        self._keep()
