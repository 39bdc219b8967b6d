"""Matched rules over streams: guards and projections keep no state, so a rule runs on readStream as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame

from morphspark.engine import Engine
from morphspark.errors import InvalidOperation
from morphspark.metamodel import Model


def stream_rule(engine: Engine, rule: str, model: Model) -> dict[str, DataFrame]:
    """Streaming rows by target class of a matched rule whose bindings read attributes of its source only."""
    from morphspark.plans.rules import RuleSet

    rules = RuleSet(engine.module, {**engine.models, next(iter(dict(engine.module.sources))): model}, {}, engine.helpers)
    found = next((r for r in engine.module.rules if r.name == rule and r.kind == "matched"), None)
    if found is None:
        raise InvalidOperation(f"no matched rule {rule}")
    return {cls: df for _, cls, df in rules.run_matched(found)}
