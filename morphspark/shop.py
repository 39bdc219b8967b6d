"""The Shop metamodel over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from morphspark.metamodel import Metamodel, Model, Reference


def shop(spark: SparkSession, sf_dir: str) -> Model:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables = {"Region": read("region"), "Nation": read("nation"), "Customer": read("customer"), "Supplier": read("supplier"), "Part": read("part"), "Order": read("orders"), "Lineitem": read("lineitem"), "Event": read("events"), "Document": read("documents"), "Label": read("labels"), "Turn": read("conversations")}
    mm = Metamodel("Shop")
    add = mm.add_table
    add("Region", tables["Region"], "r_", "regionkey", [Reference("nations", "Nation", opposite="region")])
    add("Nation", tables["Nation"], "n_", "nationkey", [Reference("region", "Region", "n_regionkey"), Reference("customers", "Customer", opposite="nation"), Reference("suppliers", "Supplier", opposite="nation")])
    add("Customer", tables["Customer"], "c_", "custkey", [Reference("nation", "Nation", "c_nationkey"), Reference("orders", "Order", opposite="customer")])
    add("Supplier", tables["Supplier"], "s_", "suppkey", [Reference("nation", "Nation", "s_nationkey"), Reference("lineitems", "Lineitem", opposite="supplier")])
    add("Part", tables["Part"], "p_", "partkey", [Reference("lineitems", "Lineitem", opposite="part")])
    add("Order", tables["Order"], "o_", "orderkey", [Reference("customer", "Customer", "o_custkey"), Reference("lineitems", "Lineitem", opposite="order")])
    add("Lineitem", tables["Lineitem"], "l_", None, [Reference("order", "Order", "l_orderkey"), Reference("part", "Part", "l_partkey"), Reference("supplier", "Supplier", "l_suppkey")])
    mm.classes["Lineitem"].order = ("linenumber", "partkey", "suppkey", "quantity")
    add("Event", tables["Event"], "", "eventId", [], {"event_id": "eventId", "user_id": "userId", "event_type": "eventType"})
    add("Document", tables["Document"], "", "docId", [Reference("label", "Label", "doc_id")], {"doc_id": "docId", "n_chars": "nChars"})
    add("Label", tables["Label"], "", "docId", [], {"doc_id": "docId"})
    add("Turn", tables["Turn"], "", None, [], {"conv_id": "convId"})
    # Customers and suppliers are both parties, told apart by their names.
    mm.add("Party", {"name": "String", "acctbal": "Real"}, key="name")
    for name in ("Customer", "Supplier"):
        mm.cls(name).supertypes = ("Party",)
    return Model(mm, tables)
