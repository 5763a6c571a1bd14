"""High-level plans: scan (find spans) and scrub (rewrite text).

``scan`` adds a ``spans`` column (disjoint, start-ordered ``array<struct>``)
to any DataFrame with a text column.  All detection, merging and rewriting
happens inside each row, so a scan of N documents is one narrow stage:
parquet scan -> regex + fold -> output, with no shuffle.  Shuffles appear
only downstream, in rollups keyed by type, user or day.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import CAND_T, empty_array
from ..operators import detect as D
from ..operators.merge import with_merged
from ..operators.policy import Policy, policy_map
from ..operators.rewrite import rewrite, with_replacements
from ..operators.rules import Rule, as_unicode, select_rules


@dataclass
class ScanConfig:
    """Detector and pack toggles; rules not enabled build no plan."""
    regex: bool = True
    pii: bool = True
    secrets: bool = True
    network: bool = True
    minimal: bool = False
    only: list[str] | None = None
    extra_rules: list[Rule] = field(default_factory=list)
    ruler: bool = False
    address_patterns: bool = True
    id_patterns: bool = True
    min_confidence: float | None = None   # M4, off by default
    unicode: bool = False                 # digits, spaces, words and case of all scripts

    def rules(self) -> list[Rule]:
        if not self.regex:
            return []
        rules = select_rules(self.pii, self.secrets, self.network, self.minimal, self.only, self.extra_rules)
        return [as_unicode(r) for r in rules] if self.unicode else rules


def scan(df: DataFrame, text_col: str = "text", config: ScanConfig | None = None,
         model_col: str | None = None, extra_cols: list[str] | None = None,
         out_col: str = "spans") -> DataFrame:
    """Detect and merge.

    ``model_col`` names a candidate column already produced by a model or
    dictionary detector (``operators.entities``); the ruler yields to it.
    ``extra_cols`` are further candidate columns (e.g. located external
    findings) merged in the same fold.
    """
    config = config or ScanConfig()
    cols = []
    df = D.detect_regex(df, text_col, config.rules(), out_col="__regex")
    cols.append("__regex")
    if model_col:
        cols.append(model_col)
    if config.ruler:
        df = D.detect_ruler(df, text_col, "__ruler", config.address_patterns, config.id_patterns,
                            yield_to=model_col, unicode=config.unicode)
        cols.append("__ruler")
    cols += list(extra_cols or [])
    df = with_merged(df, cols, out_col, config.min_confidence)
    return df.drop("__regex", "__ruler")


def scrub(df: DataFrame, salt: str, policy: Policy | None = None, text_col: str = "text",
          config: ScanConfig | None = None, mode: str | None = None, policy_col: str | None = None,
          out_col: str = "sanitized", keep_spans: bool = True, **scan_kwargs) -> DataFrame:
    """Scan, choose an action per span, rewrite.

    ``policy_col`` names a per-row ``map<string,string>`` (e.g. from a
    prompt); otherwise ``policy`` (default policy when None) applies to all
    rows as a literal map.  ``salt`` is required: aliases and hashes must be
    stable across tasks and runs.
    """
    if "spans" not in df.columns:
        df = scan(df, text_col, config, **scan_kwargs)
    pmap = F.col(policy_col) if policy_col else policy_map((policy or Policy()).actions)
    df = df.withColumn("spans", with_replacements(F.col("spans"), pmap, salt, mode))
    df = df.withColumn(out_col, rewrite(F.col(text_col), F.col("spans")))
    return df if keep_spans else df.drop("spans")
