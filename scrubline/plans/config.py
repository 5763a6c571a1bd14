"""Policies, rule packs and detector toggles from a file.

The file is YAML (or JSON, which YAML reads too) on any file system:

    policy:
      actions: {EMAIL: mask, PERSON: pseudonymize}   # replaces the default map
      min_confidence: 0.8
    detectors:
      regex: {enabled: true, packs: {pii: true, secrets: true, network: false}}
      ruler: {enabled: true, address_patterns: true, id_patterns: false}
    patterns:
      TICKET: {regex: "TCK-[0-9]{6}", confidence: 0.9}

Everything may be left out.
"""

from __future__ import annotations

import json

from ..operators.policy import Policy, load_policy
from ..operators.rules import load_pack
from ..sources.files import open_tree
from .scan import ScanConfig


def parse_config(text: str) -> dict:
    """A mapping from YAML, or from JSON where no YAML parser is installed."""
    try:
        import yaml
    except ImportError:
        data = json.loads(text or "{}")
    else:
        data = yaml.safe_load(text)
    if data is not None and not isinstance(data, dict):
        raise ValueError("a configuration must be a mapping")
    return data or {}


def load_config(path: str) -> tuple[Policy, ScanConfig]:
    """The policy and the scan configuration of a file."""
    system, base = open_tree(path)
    with system.open_input_file(base) as f:
        data = parse_config(f.readall().decode())
    found = data.get("detectors") or {}
    regex, ruler = found.get("regex") or {}, found.get("ruler") or {}
    packs = regex.get("packs") or {}
    config = ScanConfig(
        regex=bool(regex.get("enabled", True)), ruler=bool(ruler.get("enabled", False)), extra_rules=load_pack(data),
        **{name: bool(packs[name]) for name in ("pii", "secrets", "network", "minimal") if name in packs},
        **{name: bool(ruler[name]) for name in ("address_patterns", "id_patterns") if name in ruler})
    return load_policy(data), config
