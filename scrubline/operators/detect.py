"""Candidate-span detection: regex rule packs and token cue rules.

Every detector appends an ``array<CAND_T>`` column to the document rows, so
detection is a narrow (per-row) transformation: no shuffle, no driver work.
Each rule walks a text once: its matches and their offsets come from the same
pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import (CAND_T, MATCH_T, absent_mark, empty_array, explode_rows, islands, marked_spans, no_action, regex_matches,
                               regex_spans)
from ..functions.validators import VALIDATORS, normalise, validate
from .merge import overlaps
from .rules import GATE_PATTERNS, Rule, as_unicode, select_rules

DET_REGEX, DET_MODEL, DET_RULER, DET_EXTERNAL = 0, 1, 2, 3


def _to_candidates(spans: Column, rule: Rule, det: int, rank: int) -> Column:
    if any(v in VALIDATORS for v in rule.validators):
        spans = F.filter(spans, lambda s: validate(normalise(s["text"], list(rule.normalize)),
                                                   list(rule.validators)))
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"),
        F.lit(rule.type).alias("type"), F.lit(float(rule.confidence)).alias("confidence"),
        F.lit(det).alias("det"), F.lit(rank).alias("rule"), no_action()))


def gate_column(name: str) -> str:
    return f"__gate_{name}"


def with_gates(df: DataFrame, text_col: str, rules: list[Rule]) -> tuple[DataFrame, list[str]]:
    """Evaluate each character gate the rules use once per row."""
    added = []
    for g in sorted({r.gate for r in rules if r.gate}):
        c = gate_column(g)
        df = df.withColumn(c, F.coalesce(F.col(text_col).rlike(GATE_PATTERNS[g]), F.lit(False)))
        added.append(c)
    return df, added


def required(text: Column, rule: Rule) -> Column | None:
    """Whether the text holds a literal that the rule's matches need (None: they need none)."""
    present = None
    for lit in rule.requires or ():
        c = F.instr(text, lit) > 0
        present = c if present is None else (present | c)
    return present


def rule_spans(text: Column, rule: Rule) -> tuple[Column, Column]:
    """(matches, pattern) for one rule, honouring its literals."""
    m, present = regex_matches(text, rule.pattern), required(text, rule)
    return (m if present is None else F.when(present, m).otherwise(F.array().cast("array<string>"))), rule.pattern


#: Column of the mark that ``marked_spans`` cuts a row's text with.
MARK_COL = "__mark"


def rule_candidates(text: Column, rule: Rule, det: int, rank: int) -> Column:
    """Validated candidates of one rule, honouring its prefilters; the rule's
    gate column (from ``with_gates``) and ``MARK_COL`` are in the row."""
    spans = marked_spans(text, F.lit(rule.pattern), F.col(MARK_COL))
    for holds in (required(text, rule), F.col(gate_column(rule.gate)) if rule.gate else None):
        if holds is not None:
            spans = F.when(holds, spans).otherwise(empty_array(MATCH_T))
    return _to_candidates(spans, rule, det, rank)


# Column expressions for a rule are large trees; building one costs thousands
# of Python-to-JVM calls.  They depend only on the rule, its ranks and the
# column names, so they are built once per JVM and reused by later plans.
_EXPR_CACHE: dict = {}
_EXPR_CACHE_SIZE = 512


def _cached(key, build):
    v = _EXPR_CACHE.get(key)
    if v is None:
        if len(_EXPR_CACHE) >= _EXPR_CACHE_SIZE:
            _EXPR_CACHE.clear()
        v = _EXPR_CACHE[key] = build()
    return v


def detect_regex(df: DataFrame, text_col: str = "text", rules: list[Rule] | None = None,
                 out_col: str = "cands", det: int = DET_REGEX) -> DataFrame:
    """Append ``out_col``: validated candidates of every rule, in rule order.

    Per rule: one regex pass that marks the matches, offsets from the pieces
    between the marks where something matched, then the rule's normalisers and
    validators as a filter over the match array.
    """
    rules = select_rules() if rules is None else rules
    text = F.col(text_col)
    df, tmp = with_gates(df, text_col, rules)
    df = df.withColumn(MARK_COL, absent_mark(text))
    tmp.append(MARK_COL)
    gw = df.sparkSession.sparkContext.applicationId  # expressions belong to one JVM
    for i, r in enumerate(rules):
        df = df.withColumn(f"__s{i}", _cached((gw, r, det, i, text_col), lambda: rule_candidates(text, r, det, i)))
        tmp.append(f"__s{i}")
    parts = [F.col(f"__s{i}") for i in range(len(rules))]
    cands = F.concat(*parts) if parts else empty_array(CAND_T)
    return df.withColumn(out_col, cands).drop(*tmp)


def rule_match_rows(df: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text",
                    validated: bool = True) -> DataFrame:
    """One row per match of one rule: (id, start, end, text, type, confidence).

    ``validated=False`` keeps candidates that fail the rule's validators and
    adds a ``valid`` flag instead (used to inspect validators)."""
    text = F.col(text_col)
    m, pat = rule_spans(text, rule)
    x = df.select(F.col(id_col), text, m.alias("__m"))
    x = explode_rows(x, regex_spans(text, pat, F.col("__m")), [F.col(id_col)], "s")
    norm = normalise(F.col("s.text"), list(rule.normalize))
    v = validate(norm, list(rule.validators))
    x = x.select(F.col(id_col), F.col("s.start").alias("start"), F.col("s.end").alias("end"),
                 F.col("s.text").alias("text"), F.lit(rule.type).alias("type"),
                 F.lit(float(rule.confidence)).alias("confidence"),
                 (v if v is not None else F.lit(True)).alias("valid"))
    if validated:
        x = x.where("valid").drop("valid")
    return x


# ---------------------------------------------------------------------------
# Token cue rules (the entity-ruler detector).  Tokens are whitespace/punct
# separated words; a "title" token is an upper-case letter followed by
# lower-case letters.  Confidence 0.8 for all four labels.
# Street words, MRN and SSN cue words, labels, confidence.
# ---------------------------------------------------------------------------
RULER_CONFIDENCE = 0.8

_TITLE = r"\p{Lu}\p{Ll}*"
# Abbreviations with a dot are tried before the bare word so "st." wins.
_STREET = r"(?i:street\b|avenue\b|road\b|st\.|ave\.|rd\.|st\b|ave\b|rd\b)"

RULER_RULES = [
    # ADDRESS A: title-case token, one space, a street word.
    Rule(key="ADDRESS_STREET", regex=r"\b" + _TITLE + r" " + _STREET,
         type="ADDRESS", confidence=RULER_CONFIDENCE, flags=()),
    # ADDRESS B: all-digit token, one space, title-case token.
    Rule(key="ADDRESS_NUMBER", regex=r"\b\d+ " + _TITLE + r"\b", type="ADDRESS",
         confidence=RULER_CONFIDENCE, flags=()),
    Rule(key="MRN", regex=r"\b(?:mrn|medical|record)\b", type="MRN", confidence=RULER_CONFIDENCE, flags=("I",)),
    Rule(key="SSN_WORD", regex=r"\b(?:ssn|social|security|number)\b", type="SSN_WORD",
         confidence=RULER_CONFIDENCE, flags=("I",)),
]


def longest_first(spans: Column) -> Column:
    """Ruler's own conflict rule: longest match first, then earliest; keep a
    match only if it overlaps nothing already kept.  Overlaps stay within an
    island, so each island is decided by itself."""
    def keep(island: Column) -> Column:
        ordered = F.array_sort(island, lambda a, b: F.when((a["end"] - a["start"]) != (b["end"] - b["start"]),
                                                           (b["end"] - b["start"]) - (a["end"] - a["start"]))
                               .otherwise(a["start"] - b["start"]))
        kept = F.aggregate(ordered, empty_array(CAND_T),
                           lambda acc, s: F.when(F.exists(acc, lambda k: overlaps(k, s)), acc)
                           .otherwise(F.concat(acc, F.array(s))))
        return F.array_sort(kept, lambda a, b: a["start"] - b["start"])
    by_start = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    return F.flatten(F.transform(islands(by_start), lambda i: F.when(F.size(i) == 1, i).otherwise(keep(i))))


def detect_ruler(df: DataFrame, text_col: str = "text", out_col: str = "ruler_cands",
                 address_patterns: bool = True, id_patterns: bool = True,
                 yield_to: str | None = None, unicode: bool = False) -> DataFrame:
    """Token cue rules (E4-E7) plus precedence.

    ``yield_to`` names an existing candidate column (the model's spans): a
    ruler span overlapping any of them is dropped, as the ruler never
    overwrites entities that were already labelled.
    """
    rules = []
    if address_patterns:
        rules += RULER_RULES[:2]
    if id_patterns:
        rules += RULER_RULES[2:]
    df = detect_regex(df, text_col, [as_unicode(r) for r in rules] if unicode else rules, out_col=out_col, det=DET_RULER)
    if rules:
        df = df.withColumn(out_col, F.when(F.size(out_col) > 1, longest_first(F.col(out_col)))
                           .otherwise(F.col(out_col)))
    if yield_to:
        df = df.withColumn(out_col, F.filter(out_col, lambda s: ~F.exists(yield_to, lambda m: overlaps(m, s))))
    return df
