"""Entities: tables with declared keys, relations, enumerations, versions and search columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidlake.errors import RequestError
from braidlake.functions import naming
from braidlake.functions.types import scalar_of

#: Prefixes of tables that are no entities.
INTERNAL = ("_metadata", "_multi_")


@dataclass(frozen=True)
class ForeignKey:
    """A column that holds a key of another table. The two names replace those of the fields that lead back."""

    column: str
    table: str
    target: str
    backward_name: str | None = None
    backward_single_name: str | None = None


@dataclass(frozen=True)
class Declared:
    """What a table's files don't tell. versions: columns of a half-open validity interval, null for an open end.

    search: columns that are searched. finder: a search of one's own, from the entity's valid rows and the
    query to those that match, with a number `__score` (greater first) if it ranks them.
    """

    key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    versions: tuple[str, str] | None = None
    search: tuple[str, ...] = ()
    finder: Callable[[DataFrame, str], DataFrame] | None = None
    hidden: tuple[str, ...] = ()
    scalars: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Relation:
    """A way from one entity to another: its rows where other.there equals own.here."""

    name: str
    kind: str  # forward, backward, single (backward, one at most), many (through a junction)
    table: str
    here: str
    there: str
    junction: tuple[str, str, str] | None = None  # table, column to own.here, column to other.there


@dataclass(frozen=True)
class Entity:
    name: str
    schema: T.StructType
    declared: Declared
    relations: dict[str, Relation] = field(default_factory=dict)

    @property
    def type_name(self) -> str:
        return naming.type_name(self.name)

    @property
    def columns(self) -> list[str]:
        hidden = {*self.declared.hidden, *(self.declared.versions or ()), "_id", "_block_range"}
        return [f.name for f in self.schema.fields if f.name not in hidden]

    @property
    def fields(self) -> dict[str, str]:
        """API field to column."""
        return {naming.camel(c): c for c in self.columns}

    @property
    def tiebreak(self) -> list[str]:
        """Columns that tell rows apart: the key, with the start of a version; every orderable column where there is none."""
        if self.declared.key:
            return [*self.declared.key, *(self.declared.versions or ())[:1]]
        return [f.name for f in self.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]

    def kind(self, column: str) -> T.DataType:
        return self.schema[column].dataType

    def scalar(self, column: str) -> str:
        if column in self.declared.enums:
            return "Enum"
        if isinstance(self.kind(column), T.ArrayType):
            return "List"
        return scalar_of(self.kind(column), self.declared.scalars.get(column))[0]

    @property
    def numeric(self) -> list[str]:
        return [c for c in self.columns if scalar_of(self.kind(c), self.declared.scalars.get(c))[1] and c not in self.declared.enums]

    def column(self, name: str) -> str:
        """The column of an API field, or of its own name."""
        found = self.fields.get(name, name if name in self.columns else None)
        if found is None:
            raise RequestError(f"{self.type_name} has no field {name!r}")
        return found


class Catalog:
    """An immutable snapshot of entities, and how to read them. refresh() gives a new one.

    again: reads the tables' list and schemas anew; without it, refresh() reads the schemas of the same sources.
    listing: the names of all tables there are now, for a catalog of some of them.
    """

    def __init__(self, spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], declared: dict[str, Declared], metadata: dict[str, Callable[[], DataFrame]] | None = None,
                 again: Callable[[], Catalog] | None = None, listing: Callable[[], list[str]] | None = None):
        self.spark, self.sources, self.declared, self.metadata = spark, sources, declared, metadata or {}
        self.again, self.listing = again, listing
        self.listed = set(listing()) if listing else set(sources)
        entities = {n: Entity(n, read().schema, declared.get(n, Declared())) for n, read in sources.items() if not n.startswith(INTERNAL)}
        for e in entities.values():
            for fk in e.declared.foreign_keys:
                if fk.table in entities and (fk.column not in e.schema.names or fk.target not in entities[fk.table].schema.names):
                    raise ValueError(f"{e.name}.{fk.column} -> {fk.table}.{fk.target}: no such column")
        self.entities = {n: replace(e, relations=_relations(e, entities)) for n, e in entities.items()}
        self.by_connection = {naming.connection_field(n): n for n in self.entities}
        self.by_single = {naming.single_field(n): n for n in self.entities}

    @classmethod
    def from_path(cls, spark: SparkSession, root: str, names: list[str] | None, declared: dict[str, Declared], schemas: dict[str, T.StructType] | None = None) -> Catalog:
        """Parquet tables in one folder, those of the names (None: all). Relations to tables that aren't among them are left out. schemas: of tables that can't change."""
        wanted, schemas = names, schemas or {}
        names = list_tables(spark, root) if names is None else names

        def reader(name: str) -> Callable[[], DataFrame]:
            at = f"{root.rstrip('/')}/{name}.parquet"
            schema = schemas.get(name) or spark.read.parquet(at).schema
            return lambda: spark.read.schema(schema).parquet(at)

        return cls(spark, {n: reader(n) for n in names}, declared, again=lambda: cls.from_path(spark, root, wanted, declared, schemas), listing=None if schemas else lambda: list_tables(spark, root))

    @classmethod
    def from_database(cls, spark: SparkSession, database: str, declared: dict[str, Declared]) -> Catalog:
        """Tables and views of a catalog database. What their comments say of keys adds to what is declared."""
        at = {t.name: f"`{t.name}`" if t.isTemporary else f"`{database}`.`{t.name}`" for t in spark.catalog.listTables(database)}
        for n in at:
            spark.catalog.refreshTable(at[n])
        comments = {t.name: t.description for t in spark.catalog.listTables(database)}
        told = {n: tagged(declared.get(n, Declared()), comments.get(n), spark.table(at[n]).schema) for n in at}
        return cls(spark, {n: (lambda n=n: spark.table(at[n])) for n in at}, {**declared, **told},
                   again=lambda: cls.from_database(spark, database, declared), listing=lambda: [t.name for t in spark.catalog.listTables(database)])

    @classmethod
    def from_project(cls, spark: SparkSession, project: str, declared: dict[str, Declared], roots: tuple[str, ...] = ()) -> Catalog:
        """The database of that name, else the first root that has a folder of that name with tables in it."""
        if spark.catalog.databaseExists(f"`{project}`"):
            return cls.from_database(spark, project, declared)
        for root in roots:
            at = f"{root.rstrip('/')}/{project}"
            if list_tables(spark, at):
                return cls.from_path(spark, at, None, declared)
        raise RequestError(f"no database or folder {project!r}")

    def refresh(self) -> Catalog:
        """A catalog of what is there now: new and dropped tables and columns."""
        if self.again is None:
            return Catalog(self.spark, self.sources, self.declared, self.metadata)
        out = self.again()
        out.metadata = self.metadata
        return out

    def drift(self) -> list[str]:
        """Tables that came, went or changed their columns since this catalog was made."""
        now = self.refresh()
        shape = lambda c, n: c.entities[n].schema if n in c.entities else None
        changed = {n for n in {*self.entities, *now.entities} if shape(self, n) != shape(now, n)}
        return sorted(changed | (self.listed ^ now.listed))

    def entity(self, name: str) -> Entity:
        if name not in self.entities:
            raise RequestError(f"no entity {name!r}")
        return self.entities[name]

    def frame(self, name: str, alias: str) -> DataFrame:
        return self.sources[name]().alias(alias)

    def infer_enum(self, name: str, column: str, limit: int = 64) -> tuple[str, ...] | None:
        """The values of a column, if there are few: for declaring an enumeration."""
        rows = self.sources[name]().select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
        return tuple(sorted(r[0] for r in rows)) if len(rows) <= limit else None

    def row_estimates(self) -> dict[str, int]:
        """Rows of each entity from its statistics or file footers: a count without columns reads no data pages."""
        with ThreadPoolExecutor(8) as pool:
            return dict(zip(self.entities, pool.map(lambda n: self.sources[n]().count(), self.entities), strict=True))

    def size_in_bytes(self) -> int:
        """Estimated size of all entities from the optimizer's statistics, without reading them."""
        return sum(int(str(self.sources[n]()._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for n in self.entities)


def tagged(declared: Declared, comment: str | None, schema: T.StructType) -> Declared:
    """declared, with the keys and names that comments give, a tag to a line or between bars.

    A table's: `@foreignKey (column) REFERENCES table (key)`, and after it the names of that key's fields.
    Also a table's: `@search column, column`, the columns that are searched.
    A column's: names for the declared key of that column. Names: `@foreignFieldName name` and
    `@singleForeignFieldName name`. What is declared comes first.
    """
    parts = lambda text: [p.strip() for p in re.split(r"[\n|]", text or "")]
    keys = list(declared.foreign_keys)

    def name(at: int, tag: str) -> None:
        for field_, word in (("backward_name", "@foreignFieldName"), ("backward_single_name", "@singleForeignFieldName")):
            if (found := re.fullmatch(rf"{word}\s+(\w+)", tag)) and getattr(keys[at], field_) is None:
                keys[at] = replace(keys[at], **{field_: found[1]})

    last, search = None, declared.search
    for tag in parts(comment):
        if (found := re.fullmatch(r"@search\s+(\w+(?:\s*,\s*\w+)*)", tag)) and not search:
            search = tuple(c for c in re.split(r"\s*,\s*", found[1]) if c in schema.names)
        if found := re.fullmatch(r"(?i)@foreignKey\s*\(\s*(\w+)\s*\)\s+references\s+(\w+)\s*\(\s*(\w+)\s*\)", tag):
            last = next((i for i, k in enumerate(keys) if k.column == found[1]), None)
            if last is None:
                keys.append(ForeignKey(*found.groups()))
                last = len(keys) - 1
        elif last is not None:
            name(last, tag)
    for f in schema.fields:
        for at, k in enumerate(keys):
            if k.column == f.name:
                for tag in parts(f.metadata.get("comment")):
                    name(at, tag)
    return replace(declared, foreign_keys=tuple(keys), search=search)


def list_tables(spark: SparkSession, root: str) -> list[str]:
    """Names of the Parquet tables in a folder of any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet"))


def _relations(e: Entity, entities: dict[str, Entity]) -> dict[str, Relation]:
    out: dict[str, Relation] = {}

    def add(r: Relation) -> None:
        if r.name not in e.fields:
            out.setdefault(r.name, r)

    for fk in e.declared.foreign_keys:
        if fk.table in entities:
            name = naming.forward_field(fk.column)
            if name in e.fields:
                name = f"{naming.single_field(fk.table)}By{naming.pascal(fk.column)}"
            add(Relation(name, "forward", fk.table, fk.column, fk.target))
    for child in entities.values():
        for fk in child.declared.foreign_keys:
            if fk.table != e.name:
                continue
            if (fk.column,) in child.declared.unique or child.declared.key == (fk.column,):
                add(Relation(fk.backward_single_name or naming.backward_single_field(child.name, fk.column), "single", child.name, fk.target, fk.column))
            else:
                add(Relation(fk.backward_name or naming.backward_field(child.name, fk.column), "backward", child.name, fk.target, fk.column))
        if is_junction(child):
            for own, other in (child.declared.foreign_keys, child.declared.foreign_keys[::-1]):
                if own.table == e.name and other.table in entities:
                    name = naming.connection_field(other.table)
                    if name in out:  # two junctions, or two keys to one table
                        name = f"{name}By{naming.type_name(child.name)}{naming.pascal(own.column)}And{naming.pascal(other.column)}"
                    add(Relation(name, "many", other.table, own.target, other.target, (child.name, own.column, other.column)))
    return out


def is_junction(e: Entity) -> bool:
    """Two foreign keys, and no other column than they and an id."""
    fks = {fk.column for fk in e.declared.foreign_keys}
    return len(e.declared.foreign_keys) == 2 and len(fks) == 2 and set(e.columns) - fks <= {"id"}


def as_of(e: Entity, alias: str, point: int | None) -> Column | None:
    """Rows that are valid at a point; without one, those whose validity is open."""
    if e.declared.versions is None:
        return None
    start, end = (F.col(f"{alias}.`{c}`") for c in e.declared.versions)
    if point is None:
        return end.isNull()
    return (start <= F.lit(point)) & (end.isNull() | (F.lit(point) < end))
