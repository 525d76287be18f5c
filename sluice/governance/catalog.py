"""The relations that may be asked about: their schemas, families of types, statistics and lineage."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sluice.governance import policy
from sluice.governance.model import Level
from sluice.plans import lineage, tree

_FAMILIES = (
    ("timestamp", (T.TimestampType, T.TimestampNTZType)), ("date", (T.DateType,)), ("boolean", (T.BooleanType,)), ("decimal", (T.DecimalType,)),
    ("float", (T.DoubleType, T.FloatType)), ("integer", (T.ByteType, T.ShortType, T.IntegerType, T.LongType)), ("text", (T.StringType,)), ("blob", (T.BinaryType,)),
)


def family(kind: T.DataType) -> str:
    return next((name for name, kinds in _FAMILIES if isinstance(kind, kinds)), "other")


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    family: str
    nullable: bool
    ordinal: int
    published: bool
    lineage: tuple[str, ...] = ()


@dataclass(frozen=True)
class FileStats:
    rows: int
    bytes: int
    columns: dict[str, int]
    partition: dict[str, str] = field(default_factory=dict)


@dataclass
class Statistics:
    files: list[FileStats]

    @property
    def rows(self) -> int:
        return sum(f.rows for f in self.files)

    @property
    def bytes(self) -> int:
        return sum(f.bytes for f in self.files)

    @classmethod
    def of_parquet(cls, path: str) -> Statistics:
        """From the files' footers: no row is read."""
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        fs, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        info = fs.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = []
        for f in found:
            name = f.path.rpartition("/")[2]
            if f.type != pafs.FileType.File or name[:1] in "._" or not name.endswith(".parquet"):
                continue
            with fs.open_input_file(f.path) as stream:
                meta = pq.ParquetFile(stream).metadata
            sizes: dict[str, int] = {}
            for g in range(meta.num_row_groups):
                for c in range(meta.num_columns):
                    chunk = meta.row_group(g).column(c)
                    top = chunk.path_in_schema.partition(".")[0]
                    sizes[top] = sizes.get(top, 0) + chunk.total_compressed_size
            keys = dict(p.split("=", 1) for p in f.path[len(root) :].split("/") if "=" in p)
            files.append(FileStats(meta.num_rows, sum(sizes.values()), sizes, keys))
        return cls(files)


@dataclass
class Relation:
    """A table by its path, or a view by its builder over the others."""

    name: str
    path: str | None = None
    build: Callable[[SparkSession], DataFrame] | None = None

    def frame(self, spark: SparkSession) -> DataFrame:
        return self.build(spark) if self.build else spark.read.option("mergeSchema", True).parquet(self.path)


class Catalog:
    """``relations``: tables first, views after what they read."""

    def __init__(self, spark: SparkSession, relations: list[Relation]):
        self.spark = spark.newSession()
        self.relations = {r.name: r for r in relations}
        self.columns: dict[str, list[Column]] = {}
        self.statistics: dict[str, Statistics] = {}
        for r in relations:
            df = r.frame(self.spark)
            df.createOrReplaceTempView(r.name)
            traced = lineage.of_output(tree.analyzed(self.spark.table(r.name)))
            self.columns[r.name] = [
                Column(f.name, f.dataType.simpleString(), family(f.dataType), f.nullable, i, all(self.published(c) for c in found), tuple(sorted(found)))
                for i, (f, found) in enumerate(zip(df.schema.fields, traced, strict=True))
            ]
            if r.path:
                self.statistics[r.name] = Statistics.of_parquet(r.path)

    def violations(self) -> list[tuple[str, str, str]]:
        """(view column, base column, role) wherever the policy shows a role more of a derived column than of what it comes
        from: a view's own rule must never loosen that of its sources."""
        order = [Level.ALLOW, Level.MASK, Level.DENY]
        found = []
        for name, columns in self.columns.items():
            for c in columns:
                own = f"{name}.{c.name}"
                if self.relations[name].build and own in policy.COLUMNS:
                    found += [(own, base, role) for base in c.lineage for role in policy.ROLES if order.index(policy.level(role, own)) < order.index(policy.level(role, base))]
        return found

    @staticmethod
    def published(column: str) -> bool:
        """A column that no role may see isn't shown at all."""
        rule = policy.COLUMNS.get(column)
        return rule is None or any(x is not Level.DENY for x in rule.levels)

    def masked_session(self, role: str, mask: Callable[[DataFrame, str, str], DataFrame]) -> SparkSession:
        """A session whose tables show the role masked values, under the same names."""
        session = self.spark.newSession()
        for r in self.relations.values():
            df = r.frame(session)
            (mask(df, r.name, role) if r.path else df).createOrReplaceTempView(r.name)
        return session

    def canonical(self) -> str:
        rows = {n: [[c.name, c.kind, c.family, c.nullable, c.ordinal, c.published, list(c.lineage)] for c in cs] for n, cs in self.columns.items()}
        return json.dumps(rows, sort_keys=True, separators=(",", ":"))

    def digest(self) -> str:
        return hashlib.sha256(self.canonical().encode()).hexdigest()


def of_statements(spark: SparkSession, tables: dict[str, str], views: dict[str, str]) -> Catalog:
    """A catalog of tables by path and views by statement, whatever order the views are given in. Views that read each other
    in a circle can't be built and raise ValueError."""
    reads = {}
    for name, text in views.items():
        raw = tree.parsed(spark, text)
        reads[name] = {".".join(tree.name_parts(x.fields["multipartIdentifier"])) for x in raw.walk() if x.name == "UnresolvedRelation"} & views.keys()
    ordered, circular = lineage.order(reads)
    if circular:
        raise ValueError(f"views read each other: {', '.join(circular)}")
    return Catalog(spark, [Relation(n, p) for n, p in tables.items()] + [Relation(n, build=lambda s, t=views[n]: s.sql(t)) for n in ordered])


def of_folder(spark: SparkSession, folder: str, names: tuple[str, ...]) -> Catalog:
    return Catalog(spark, [Relation(n, f"{folder}/{n}.parquet") for n in names])
