"""Metamodels: classes with attributes and references over tables, and models that hold the tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphspark import types as ty
from morphspark.errors import MissingModel, ReadOnlyModel, UnknownClass, UnknownFeature


@dataclass(frozen=True)
class Attribute:
    name: str
    type: object
    column: str


@dataclass(frozen=True)
class Reference:
    """To-one: ``column`` of this class holds the target's key. To-many: ``opposite`` of the target points here."""

    name: str
    target: str
    column: str | None = None
    opposite: str | None = None

    @property
    def many(self) -> bool:
        return self.opposite is not None


@dataclass
class MClass:
    name: str
    attributes: dict[str, Attribute] = field(default_factory=dict)
    references: dict[str, Reference] = field(default_factory=dict)
    key: str | None = None  # attribute that identifies an element
    supertypes: tuple[str, ...] = ()
    order: tuple[str, ...] = ()  # attributes that order an extent; the key if empty


class Metamodel:
    """A named schema of classes."""

    def __init__(self, name: str, uri: str | None = None, prefix: str | None = None):
        self.name, self.uri, self.prefix, self.classes = name, uri or f"urn:{name}", prefix or name.lower(), {}

    def add(self, name: str, attributes: dict | None = None, references: list[Reference] | None = None, key: str | None = None, supertypes: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> MClass:
        """attributes: feature -> (type, column), or type alone when the column has the feature's name."""
        made = {n: Attribute(n, *(t if isinstance(t, tuple) else (t, n))) for n, t in (attributes or {}).items()}
        self.classes[name] = MClass(name, made, {r.name: r for r in references or []}, key, tuple(supertypes), tuple(order))
        return self.classes[name]

    def add_table(self, name: str, df: DataFrame, prefix: str = "", key: str | None = None, references: list[Reference] | None = None, rename: dict[str, str] | None = None) -> MClass:
        """A class from a table's schema; features are columns without ``prefix``."""
        attributes = {}
        for f in df.schema:
            feature = (rename or {}).get(f.name, f.name.removeprefix(prefix))
            attributes[feature] = (ty.from_spark(f.dataType), f.name)
        return self.add(name, attributes, references, key)

    def cls(self, name: str) -> MClass:
        if name not in self.classes:
            raise UnknownClass(f"{self.name}!{name}")
        return self.classes[name]

    def lineage(self, name: str) -> list[str]:
        """The class and all its supertypes, nearest first."""
        out, todo = [], [name]
        while todo:
            n = todo.pop(0)
            if n not in out:
                out.append(n)
                todo += self.cls(n).supertypes
        return out

    def subtypes(self, name: str) -> list[str]:
        self.cls(name)
        return [n for n in self.classes if name in self.lineage(n)]

    def feature(self, cls: str, name: str) -> Attribute | Reference | None:
        for n in self.lineage(cls):
            c = self.classes[n]
            if name in c.attributes:
                return c.attributes[name]
            if name in c.references:
                return c.references[name]
        return None

    def features(self, cls: str) -> list[str]:
        out: dict[str, None] = {}
        for n in reversed(self.lineage(cls)):
            out |= dict.fromkeys([*self.classes[n].attributes, *self.classes[n].references])
        return list(out)

    def key(self, cls: str) -> str | None:
        return next((self.classes[n].key for n in self.lineage(cls) if self.classes[n].key), None)

    def __eq__(self, other) -> bool:
        return isinstance(other, Metamodel) and (self.name, self.uri, self.classes) == (other.name, other.uri, other.classes)

    __hash__ = None  # type: ignore[assignment]


class Model:
    """Tables by class. Source models are read only; target models take elements."""

    def __init__(self, metamodel: Metamodel, tables: dict[str, DataFrame], writable: bool = False):
        self.metamodel, self.tables, self.writable, self.created = metamodel, dict(tables), writable, {}

    def extent(self, cls: str, prefix: str = "e") -> DataFrame:
        """All elements of a class and its subclasses: columns prefix__feature, prefix__$ref (keys) and prefix___class."""
        parts = []
        for name in self.metamodel.subtypes(cls):
            if name in self.tables:
                parts.append(self._columns(name, prefix))
        if not parts:
            raise MissingModel(f"no table for {self.metamodel.name}!{cls}")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def _columns(self, cls: str, prefix: str) -> DataFrame:
        df, out = self.tables[cls], []
        for name in self.metamodel.features(cls):
            f = self.metamodel.feature(cls, name)
            if isinstance(f, Attribute) and f.column in df.columns:
                c = F.col(f"`{f.column}`")
                out.append((c.cast("bigint") if f.type == ty.INTEGER else c).alias(f"{prefix}__{name}"))
            elif isinstance(f, Reference) and f.column and f.column in df.columns:
                c = F.col(f"`{f.column}`")
                whole = df.schema[f.column].dataType.typeName() in ("integer", "short", "byte")
                out.append((c.cast("bigint") if whole else c).alias(f"{prefix}__${name}"))
        return df.select(*out, F.lit(cls).alias(f"{prefix}___class"))

    def element_id(self, cls: str, prefix: str) -> Column:
        """Class:key, the identity of an element."""
        key = self.metamodel.key(cls)
        if key is None:
            raise UnknownFeature(f"{cls} has no key")
        return F.concat(F.col(f"{prefix}___class"), F.lit(":"), F.col(f"{prefix}__{key}").cast("string"))

    def all_elements(self) -> DataFrame:
        """_id and _class of every element that has a key."""
        out = None
        for name in self.tables:
            if self.metamodel.key(name):
                part = self._columns(name, "e").select(self.element_id(name, "e").alias("_id"), F.col("e___class").alias("_class"))
                out = part if out is None else out.union(part)
        if out is None:
            raise MissingModel(self.metamodel.name)
        return out

    def find(self, cls: str, predicate) -> DataFrame:
        """Ids of the elements of a class for which predicate (feature -> Column) holds."""
        e = self.extent(cls, "e")
        return e.where(predicate(lambda f: F.col(f"e__{f}"))).select(self.element_id(cls, "e").alias("_id"))

    def contains(self, ids: DataFrame) -> DataFrame:
        """The rows of ids (_id) that are elements of this model."""
        return ids.join(self.all_elements().select("_id"), "_id", "left_semi")

    def element(self, element_id: str) -> DataFrame:
        return self.all_elements().where(F.col("_id") == element_id)

    def add(self, cls: str, rows: DataFrame) -> None:
        if not self.writable:
            raise ReadOnlyModel(self.metamodel.name)
        if self.metamodel.classes:
            self.metamodel.cls(cls)
        self.tables[cls] = self.tables[cls].unionByName(rows, allowMissingColumns=True) if cls in self.tables else rows
        self.created[cls] = self.created[cls].unionByName(rows, allowMissingColumns=True) if cls in self.created else rows

    def remove(self, cls: str, keys: DataFrame) -> None:
        """Take out the elements whose columns equal those of keys."""
        if not self.writable:
            raise ReadOnlyModel(self.metamodel.name)
        self.tables[cls] = self.tables[cls].join(keys, keys.columns, "left_anti")

    def cache(self) -> None:
        """Keep the tables in memory (and on disk beyond it) once they have been read."""
        self.tables = {n: t.persist() for n, t in self.tables.items()}

    def uncache(self) -> None:
        for t in self.tables.values():
            t.unpersist()

    def statistics(self) -> dict[str, float]:
        total = sum(t.count() for t in self.tables.values())
        made = sum(t.count() for t in self.created.values())
        return {"total": total, "created": made, "ratio": made / total if total else 0.0}

    def clear_tracking(self) -> None:
        self.created = {}
