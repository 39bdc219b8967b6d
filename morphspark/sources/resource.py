"""Loading and saving of modules and of model data."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from morphspark.errors import MetamodelNotFound, UnsupportedFormat
from morphspark.lang import ast as A
from morphspark.lang.parser import parse_module
from morphspark.metamodel import Metamodel, Model
from morphspark.sources.ecore import load_ecore
from morphspark.sources.xmi import module_from_xmi, module_to_xmi

FORMATS = ("parquet", "orc", "json", "csv", "xml")


def load_module(path: str | Path, search_paths: tuple[str, ...] = (), lenient: bool = True) -> tuple[A.Module, dict[str, Metamodel]]:
    """A module from its text (.atl) or from XMI (.xmi), with the metamodels that its @path comments name.

    A path that starts with a slash is looked up below the search paths, else beside the module.
    A missing metamodel is empty if lenient, else an error.
    """
    p = Path(str(path).removeprefix("file://"))
    if p.suffix not in (".atl", ".xmi"):
        raise UnsupportedFormat(str(path))
    text = p.read_text(encoding="utf-8")
    module = parse_module(text) if p.suffix == ".atl" else module_from_xmi(text)
    found = {}
    for name, where in module.paths:
        places = [Path(s) / where.lstrip("/") for s in search_paths] + [Path(where)] if where.startswith("/") else [p.parent / where]
        place = next((x for x in places if x.exists()), None)
        if place is None and not lenient:
            raise MetamodelNotFound(f"{name}: {where}")
        found[name] = load_ecore(place) if place else Metamodel(name)
    return module, found


def save_module(module: A.Module | None, path: str | Path) -> None:
    p = Path(str(path).removeprefix("file://"))
    if p.suffix != ".xmi":
        raise UnsupportedFormat(str(path))
    if module is None:
        raise ValueError("no module to save")
    p.write_text(module_to_xmi(module), encoding="utf-8")


def load_model(spark: SparkSession, metamodel: Metamodel, path: str, fmt: str = "parquet", **options) -> Model:
    """A model from a folder with a table per class (path/Class)."""
    if fmt not in FORMATS:
        raise UnsupportedFormat(fmt)
    tables: dict[str, DataFrame] = {}
    for name in metamodel.classes:
        if spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}").getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")):
            tables[name] = spark.read.format(fmt).options(**options).load(f"{path}/{name}")
    return Model(metamodel, tables)


def save_model(model: Model, path: str, fmt: str = "parquet", mode: str = "error", **options) -> None:
    if fmt not in FORMATS:
        raise UnsupportedFormat(fmt)
    for name, df in model.tables.items():
        df.write.format(fmt).options(**options).mode(mode).save(f"{path}/{name}")
