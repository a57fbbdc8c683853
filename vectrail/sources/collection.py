"""Collections of documents with vectors: versioned Parquet folders with a schema, a metric and index definitions.

Every write makes a new version beside the old one and then moves the pointer (a small JSON file), so readers see whole
versions and a failed write leaves no trace. There is one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import METRICS
from ..operators import changes
from ..operators.search import top_k

#: Names of field types and their Spark types; ``vector`` and ``embedding`` are checked for their dimension.
TYPES = {
    "string": "string", "text": "string", "integer": "bigint", "float": "double", "double": "double", "boolean": "boolean",
    "timestamp": "timestamp", "array": "array<string>", "object": "map<string,string>", "vector": "array<float>", "embedding": "array<float>",
}


@dataclass
class Field:
    name: str
    type: str
    required: bool = False
    default: object = None
    description: str = ""
    indexed: bool = False


@dataclass
class Schema:
    fields: list[Field]
    primary_key: str = "id"
    vector_field: str = "vector"
    dimension: int | None = None
    metric: str = "cosine"
    version: int = 1

    @classmethod
    def default(cls, dimension: int, metric: str = "cosine") -> Schema:
        return cls([Field("id", "string", True, indexed=True), Field("text", "string"), Field("vector", "vector", True)], dimension=dimension, metric=metric)

    def evolved(self, *new: Field) -> Schema:
        """With added fields, which can't be required; a field can't be defined anew."""
        names = {f.name for f in self.fields}
        for f in new:
            if f.name in names:
                raise ValueError(f"field {f.name} exists")
        return Schema([*self.fields, *new], self.primary_key, self.vector_field, self.dimension, self.metric, self.version + 1)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, T._parse_datatype_string(TYPES[f.type]), not f.required, {"comment": f.description, "indexed": f.indexed}) for f in self.fields])

    def shaped(self, rows: DataFrame) -> DataFrame:
        """Rows with exactly the fields, cast and with defaults; those that break the schema raise an error when written."""
        columns = []
        unknown = set(rows.columns) - {f.name for f in self.fields}
        if unknown:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        for f in self.fields:
            x = F.col(f.name).cast(TYPES[f.type]) if f.name in rows.columns else F.lit(None).cast(TYPES[f.type])
            if f.default is not None:
                x = F.coalesce(x, F.lit(f.default).cast(TYPES[f.type]))
            if f.required:
                x = F.when(x.isNull(), F.raise_error(F.lit(f"field {f.name} is required")).cast(TYPES[f.type])).otherwise(x)
            if f.type in ("vector", "embedding") and self.dimension and f.name == self.vector_field:
                x = F.when(F.size(x) != self.dimension, F.raise_error(F.lit(f"field {f.name} must have {self.dimension} numbers")).cast(TYPES[f.type])).otherwise(x)
            columns.append(x.alias(f.name))
        return rows.select(*columns)


@dataclass
class Index:
    name: str
    kind: str
    field: str
    metric: str | None = None
    options: dict = field(default_factory=dict)


class Store:
    """A folder of collections, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)) if s.isDirectory())

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/{name}/pointer.json"))

    def create(self, name: str, schema: Schema) -> Collection:
        if self.exists(name):
            raise ValueError(f"collection {name} exists")
        if schema.metric.lower() not in METRICS:
            raise ValueError(f"unknown metric {schema.metric}")
        made = Collection(self, name)
        made._put(self.spark.createDataFrame([], schema.struct()), schema, [])
        return made

    def get(self, name: str) -> Collection:
        if not self.exists(name):
            raise KeyError(f"no collection {name}")
        return Collection(self, name)

    def drop(self, name: str) -> bool:
        return self._fs.delete(self._path(f"{self.folder}/{name}"), True)

    def _read_text(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]

    def _write_text(self, path: str, text: str) -> None:
        """Write beside the target, then rename."""
        new = self._path(f"{path}.{uuid.uuid4().hex}")
        out = self._fs.create(new)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(self._path(path)):
            self._fs.delete(self._path(path), False)
        self._fs.rename(new, self._path(path))


class Collection:
    def __init__(self, store: Store, name: str) -> None:
        self.store, self.name = store, name

    # state
    @property
    def _pointer(self) -> dict:
        return json.loads(self.store._read_text(f"{self.store.folder}/{self.name}/pointer.json"))

    @property
    def schema(self) -> Schema:
        s = self._pointer["schema"]
        return Schema([Field(**f) for f in s.pop("fields")], **s)

    @property
    def indexes(self) -> list[Index]:
        return [Index(**i) for i in self._pointer["indexes"]]

    def rows(self) -> DataFrame:
        state = self._pointer
        return self.store.spark.read.schema(self.schema.struct()).parquet(f"{self.store.folder}/{self.name}/{state['data']}")

    def _put(self, rows: DataFrame, schema: Schema, indexes: list[Index]) -> None:
        data = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.store.folder}/{self.name}/{data}")
        self.store._write_text(f"{self.store.folder}/{self.name}/pointer.json", json.dumps({"data": data, "schema": asdict(schema), "indexes": [asdict(i) for i in indexes]}))

    def _replace(self, rows: DataFrame) -> None:
        self._put(rows, self.schema, self.indexes)

    # writing
    def write(self, new: DataFrame, mode: str = "upsert") -> None:
        schema = self.schema
        new = schema.shaped(new)
        if mode != "update" and any(i.kind == "hash" and i.options.get("unique") for i in self.indexes):
            self._check_unique(changes.upsert(self.rows(), new, schema.primary_key, mode))
        self._replace(changes.upsert(self.rows(), new, schema.primary_key, mode))

    def insert(self, new: DataFrame) -> None:
        self.write(new, "insert")

    def patch(self, patches: DataFrame) -> None:
        self._replace(changes.partial_update(self.rows(), patches, self.schema.primary_key))

    def delete(self, ids: list) -> int:
        key = self.schema.primary_key
        before = self.count()
        self._replace(self.rows().where(~F.col(key).isin(list(ids))))
        return before - self.count()

    def clear(self) -> None:
        self._replace(self.rows().limit(0))

    def add_fields(self, *new: Field) -> None:
        schema = self.schema.evolved(*new)
        self._put(schema.shaped(self.rows()), schema, self.indexes)

    def apply(self, feed: DataFrame) -> None:
        """Apply a change feed with ``op`` and ``at``."""
        self._replace(changes.apply_changes(self.rows(), feed, self.schema.primary_key))

    # reading
    def get(self, *ids) -> DataFrame:
        """One row per id asked for, in null fields where there is none."""
        key = self.schema.primary_key
        asked = self.store.spark.createDataFrame([(i,) for i in ids], T.StructType([self.schema.struct()[key]]))
        return asked.join(self.rows(), key, "left")

    def page(self, number: int = 1, size: int = 10) -> DataFrame:
        return self.rows().orderBy(self.schema.primary_key).offset((number - 1) * size).limit(size)

    def count(self) -> int:
        return self.rows().count()

    def search(self, vector, k: int = 10, threshold: float | None = None, where=None) -> DataFrame:
        s = self.schema
        return top_k(self.rows(), vector, k, s.vector_field, s.primary_key, s.metric, threshold, where=where)

    def stats(self) -> dict:
        rows = self.rows()
        files = self.store._fs.getContentSummary(self.store._path(f"{self.store.folder}/{self.name}/{self._pointer['data']}"))
        return {"documents": rows.count(), "bytes": int(files.getLength()), "indexes": len(self.indexes), "version": self.schema.version, "dimension": self.schema.dimension, "metric": self.schema.metric}

    # indexes: definitions; searches prune by them, Parquet by its own statistics
    def create_index(self, kind: str, field: str, unique: bool = False, **options) -> Index:
        name = f"{self.name}_vector" if kind in ("brute_force", "hnsw", "diskann", "ivf", "lsh") else f"{self.name}_scalar_{field}"
        if any(i.name == name for i in self.indexes):
            raise ValueError(f"index {name} exists")
        defaults = {"ef_construction": 100, "ef_search": 10} if kind == "hnsw" else {}
        index = Index(name, kind, field, self.schema.metric if kind != "hash" else None, defaults | options | ({"unique": True} if unique else {}))
        if unique:
            self._check_unique(self.rows(), [field])
        rows = self.rows().orderBy(field) if kind == "btree" else self.rows()
        self._put(rows, self.schema, [*self.indexes, index])
        return index

    def drop_index(self, name: str) -> bool:
        left = [i for i in self.indexes if i.name != name]
        if len(left) == len(self.indexes):
            return False
        self._put(self.rows(), self.schema, left)
        return True

    def _check_unique(self, rows: DataFrame, fields: list[str] | None = None) -> None:
        for f in fields or [i.field for i in self.indexes if i.options.get("unique")]:
            twice = rows.where(F.col(f).isNotNull()).groupBy(f).count().where("count > 1").select(f).first()
            if twice:
                raise ValueError(f"{f} {twice[0]!r} occurs twice")
