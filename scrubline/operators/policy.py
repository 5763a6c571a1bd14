"""Policies: entity type -> action.

A policy is a small fixed-size mapping (a few dozen types at most), so it is
applied as a literal map expression -- no join, no shuffle.  Per-row
policies (one per prompt) are ``map<string,string>`` columns built by
``operators.prompts``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default policy and its confidence floor.
DEFAULT_ACTIONS = {
    "EMAIL": "mask",
    "PHONE": "mask",
    "PERSON": "pseudonymize",
    "ORG": "pseudonymize",
    "LOC": "pseudonymize",
    "CREDIT_CARD": "drop",
    "SSN": "drop",
    "IP": "mask",
    "SECRET": "drop",
    "DATE": "none",
    "ACCOUNT": "hash",
    "OTHER": "none",
}
# The secrets pack's own finer types are handled like SECRET.
SECRET_TYPE_ACTIONS = {"AWS_ACCESS_KEY_ID": "drop", "AWS_SECRET_ACCESS_KEY": "drop", "API_KEY": "drop"}
DEFAULT_MIN_CONFIDENCE = 0.75
# Types a "redact everything" request switches to mask (fixed values).
REDACT_ALL_TYPES = ["PERSON", "ORG", "LOC", "EMAIL", "PHONE", "SSN", "CREDIT_CARD", "SECRET"]

#: The policy where none is given, and the base that requests change.
BASE_ACTIONS = {**DEFAULT_ACTIONS, **SECRET_TYPE_ACTIONS}


@dataclass(frozen=True)
class Policy:
    actions: dict = field(default_factory=lambda: dict(BASE_ACTIONS))
    min_confidence: float = DEFAULT_MIN_CONFIDENCE

    def map_column(self) -> Column:
        return policy_map(self.actions)

    def with_mode(self, mode: str | None) -> "Policy":
        """A forced action replaces every action except ``none``."""
        if not mode:
            return self
        return Policy({k: (v if v == "none" else mode) for k, v in self.actions.items()}, self.min_confidence)


def load_policy(data: dict | None) -> Policy:
    """``{"policy": {"actions": {...}, "min_confidence": x}}``; the given
    actions *replace* the default map (no merge).  Absent -> default."""
    if not data:
        return Policy()
    p = data.get("policy", {}) or {}
    actions = p.get("actions")
    return Policy(dict(actions) if actions is not None else dict(BASE_ACTIONS),
                  float(p.get("min_confidence", DEFAULT_MIN_CONFIDENCE)))


def policy_map(actions: dict) -> Column:
    if not actions:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for kv in sorted(actions.items()) for x in kv])


def action_for(etype: Column, pmap: Column, mode: str | Column | None = None, own: Column | None = None) -> Column:
    """Action for a span type; missing types fall back to ``none``.  A span's
    ``own`` action (NULL = none given) goes before the policy's."""
    a = F.coalesce(*([own] if own is not None else []), F.element_at(pmap, etype), F.lit("none"))
    if mode is not None:
        m = mode if isinstance(mode, Column) else F.lit(mode)
        a = F.when(a == "none", a).otherwise(m)
    return a
