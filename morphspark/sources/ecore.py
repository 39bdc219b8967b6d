"""Metamodels from Ecore XML."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from pathlib import Path

from morphspark import types as ty
from morphspark.errors import MetamodelNotFound
from morphspark.metamodel import Metamodel, Reference

XSI = "{http://www.w3.org/2001/XMLSchema-instance}type"
#: Ecore data types by name.
DATA_TYPES = {"EString": ty.STRING, "EInt": ty.INTEGER, "EInteger": ty.INTEGER, "ELong": ty.INTEGER, "EShort": ty.INTEGER, "EIntegerObject": ty.INTEGER, "EDouble": ty.REAL, "EFloat": ty.REAL, "EBoolean": ty.BOOLEAN, "EBooleanObject": ty.BOOLEAN}


def _name(link: str | None) -> str:
    return (link or "").split()[-1].rsplit("//", 1)[-1].rsplit("/", 1)[-1].lstrip("#")


def parse_ecore(text: str) -> Metamodel:
    """To-one references expect a column of their own name; a to-many reference needs an opposite."""
    root = ET.fromstring(text)
    mm = Metamodel(root.get("name", "unnamed"), root.get("nsURI"), root.get("nsPrefix"))
    for c in root.iter("eClassifiers"):
        if not (c.get(XSI) or "").endswith("EClass"):
            continue
        attributes, references, key = {}, [], None
        for f in c.findall("eStructuralFeatures"):
            name = f.get("name")
            if (f.get(XSI) or "").endswith("EAttribute"):
                attributes[name] = DATA_TYPES.get(_name(f.get("eType")), ty.ANY)
                if f.get("iD") == "true":
                    key = name
            else:
                target = _name(f.get("eType"))
                opposite = f.get("eOpposite")
                many = f.get("upperBound") not in (None, "1")
                references.append(Reference(name, target, None if many else name, _name(opposite) if many and opposite else None))
        mm.add(c.get("name"), attributes, references, key, tuple(_name(x) for x in (c.get("eSuperTypes") or "").split()))
    return mm


def load_ecore(path: str | Path) -> Metamodel:
    p = Path(path)
    if not p.exists():
        raise MetamodelNotFound(str(p))
    return parse_ecore(p.read_text(encoding="utf-8"))
