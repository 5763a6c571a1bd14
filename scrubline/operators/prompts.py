"""Plain-language redaction requests -> per-row policies.

Prompts are rows; the alias and keyword lists are fixed and tiny, so every
step is a per-row expression over literal arrays (no join, no shuffle): the
entity mentions are a ``filter`` over the alias list, intent flags are
``exists`` tests, the request is a ``when`` chain and the effective policy a
``map_concat`` over the base policy map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.actions import PY_WHITESPACE
from .policy import BASE_ACTIONS, REDACT_ALL_TYPES, SECRET_TYPE_ACTIONS, policy_map

# ---------------------------------------------------------------------------
# Alias -> entity table (in its natural order), intent keywords
# and action synonyms.  They must equal the reference's lists.
# ---------------------------------------------------------------------------
ENTITY_ALIASES = [
    ("name", "PERSON"), ("names", "PERSON"), ("person", "PERSON"), ("people", "PERSON"), ("my name", "PERSON"),
    ("company", "ORG"), ("companies", "ORG"), ("organization", "ORG"), ("org", "ORG"),
    ("address", "LOC"), ("addresses", "LOC"), ("location", "LOC"), ("place", "LOC"),
    ("email", "EMAIL"), ("emails", "EMAIL"), ("email address", "EMAIL"),
    ("phone", "PHONE"), ("phone number", "PHONE"), ("phone numbers", "PHONE"), ("telephone", "PHONE"),
    ("ssn", "SSN"), ("social security", "SSN"), ("social security number", "SSN"),
    ("credit card", "CREDIT_CARD"), ("credit cards", "CREDIT_CARD"), ("card number", "CREDIT_CARD"),
    ("account", "ACCOUNT"), ("account number", "ACCOUNT"),
    ("ip", "IP"), ("ip address", "IP"),
    ("secret", "SECRET"), ("secrets", "SECRET"), ("api key", "SECRET"), ("password", "SECRET"), ("token", "SECRET"),
    ("date", "DATE"), ("dates", "DATE"),
]
EXCLUDE_KEYWORDS = ["don't", "do not", "keep", "preserve", "leave", "except", "but not"]
ONLY_KEYWORDS = ["only", "just"]
GLOBAL_KEYWORDS = ["all", "everything", "all personal", "all sensitive", "personal information", "sensitive data"]
ACTION_SYNONYMS = {
    "redact": "mask", "hide": "mask", "mask": "mask", "remove": "drop", "delete": "drop", "drop": "drop",
    "hash": "hash", "pseudonymize": "pseudonymize", "replace": "pseudonymize",
    "keep": "none", "preserve": "none", "leave": "none",
}
# ---------------------------------------------------------------------------

# Longest alias first; equal lengths keep table order (a stable sort).
ALIASES_BY_LENGTH = sorted(ENTITY_ALIASES, key=lambda a: len(a[0]), reverse=True)


def _alias_array(pairs) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(e).alias("entity"), F.lit(i).alias("ord"))
                     for i, (a, e) in enumerate(pairs)])


def normalise_prompt(p: Column) -> Column:
    ws = PY_WHITESPACE
    return F.lower(F.regexp_replace(F.coalesce(p, F.lit("")), f"^{ws}+|{ws}+$", ""))


def _contains(p: Column, alias: Column, word_boundary: bool) -> Column:
    if not word_boundary:
        return F.instr(p, alias) > 0          # plain substring test ("ip" in "description")
    return F.call_function("regexp_like", p, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), alias,
                                                     F.lit(r"\E(?![\p{L}\p{N}])")))


def mentioned_entities(p: Column, word_boundary: bool = False) -> Column:
    """Distinct entities in order of their first (longest-first) alias hit.
    ``word_boundary`` is an optional stricter mode: aliases must be whole words."""
    hits = F.filter(_alias_array(ALIASES_BY_LENGTH), lambda a: _contains(p, a["alias"], word_boundary))
    return F.array_distinct(F.transform(hits, lambda a: a["entity"]))


def _any_keyword(p: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.instr(p, w) > 0)


def _only_position(p: Column) -> Column:
    """0-based position of the first listed include keyword present."""
    pos = None
    for w in ONLY_KEYWORDS:
        hit = F.instr(p, w) > 0
        pos = F.when(hit, F.instr(p, w) - 1) if pos is None else pos.when(hit, F.instr(p, w) - 1)
    return pos.otherwise(F.lit(-1))


def _entity_position(p: Column, entity: Column) -> Column:
    """0-based position of the entity's first alias in *table* order that
    occurs in the prompt."""
    hits = F.filter(_alias_array(ENTITY_ALIASES), lambda a: (a["entity"] == entity) & (F.instr(p, a["alias"]) > 0))
    return F.when(F.size(hits) > 0, F.instr(p, F.element_at(hits, 1)["alias"]) - 1).otherwise(F.lit(-1))


def parse_prompts(df: DataFrame, prompt_col: str = "prompt", word_boundary: bool = False,
                  verb_aware: bool = False) -> DataFrame:
    """Add ``mentioned``, the intent flags, ``entity_actions``
    (map<string,string>) and ``redact_all_default``.

    Optional modes (both off by default, which reproduces the original
    parser): ``word_boundary`` matches aliases as whole words only;
    ``verb_aware`` (P10) uses the action named by the prompt's first action
    verb instead of ``mask`` for the entities it redacts."""
    df = df.withColumn("__p", normalise_prompt(F.col(prompt_col)))
    p = F.col("__p")
    df = (df.withColumn("mentioned", mentioned_entities(p, word_boundary))
            .withColumn("has_exclude", _any_keyword(p, EXCLUDE_KEYWORDS))
            .withColumn("has_only", _any_keyword(p, ONLY_KEYWORDS))
            .withColumn("has_global", _any_keyword(p, GLOBAL_KEYWORDS)))
    m = F.col("mentioned")
    ex, on, gl = F.col("has_exclude"), F.col("has_only"), F.col("has_global")
    empty = F.create_map().cast(T.MapType(T.StringType(), T.StringType()))

    def all_as(action: str) -> Column:
        return F.map_from_arrays(m, F.transform(m, lambda _e: F.lit(action)))

    only_pos = _only_position(p)
    split = F.map_from_arrays(m, F.transform(m, lambda e: F.when(
        (_entity_position(p, e) != -1) & (_entity_position(p, e) < only_pos), F.lit("none")).otherwise(F.lit("mask"))))
    case = (F.when(gl & ex, F.struct(all_as("none").alias("a"), F.lit(True).alias("d")))
            .when(ex & on, F.struct(split.alias("a"), F.lit(False).alias("d")))
            .when(ex, F.struct(all_as("none").alias("a"), F.lit(True).alias("d")))
            .when(on, F.struct(all_as("mask").alias("a"), F.lit(False).alias("d")))
            .when(gl & (F.size(m) == 0), F.struct(empty.alias("a"), F.lit(True).alias("d")))
            .when(F.size(m) > 0, F.struct(all_as("mask").alias("a"), F.lit(False).alias("d")))
            .otherwise(F.struct(empty.alias("a"), F.lit(True).alias("d"))))
    if verb_aware:
        verb = verb_action(p)
        case = F.struct(F.transform_values(case["a"], lambda _k, v: F.when(v == "mask", verb).otherwise(v)).alias("a"),
                        case["d"].alias("d"))
    return (df.withColumn("__req", case)
              .withColumn("entity_actions", F.col("__req.a"))
              .withColumn("redact_all_default", F.col("__req.d"))
              .drop("__req", "__p"))


def apply_request(entity_actions: Column, redact_all_default: Column, base: dict | None = None,
                  model_variant: bool = False, strict: bool = False) -> Column:
    """Effective policy map for a parsed request.

    Listed entities override the base policy; with ``redact_all_default`` the
    fixed redact-all types not listed become ``mask``.  The finer secret types
    follow ``SECRET``: what a request says of it holds for them too, unless it
    names them.  The model-parsed variant keeps only entities known to the base
    policy and turns every action other than ``none`` into ``mask``.
    """
    base = dict(BASE_ACTIONS if base is None else base)
    secret = F.element_at(entity_actions, F.lit("SECRET"))
    finer = F.filter(F.array(*[F.lit(t) for t in sorted(SECRET_TYPE_ACTIONS)]),
                     lambda t: secret.isNotNull() & ~F.array_contains(F.map_keys(entity_actions), t))
    ea = F.map_concat(entity_actions, F.map_from_arrays(finer, F.transform(finer, lambda _t: secret)))
    listed = F.map_keys(ea)
    unlisted = F.filter(F.array(*[F.lit(t) for t in [*REDACT_ALL_TYPES, *sorted(SECRET_TYPE_ACTIONS)]]), lambda t: ~F.array_contains(listed, t))
    if model_variant:
        known = F.array(*[F.lit(k) for k in sorted(base)])
        ea = F.map_filter(ea, lambda k, _v: F.array_contains(known, k))
        ea = F.transform_values(ea, lambda _k, v: F.when(v == "none", F.lit("none")).otherwise(F.lit("mask")))
    forced = F.map_from_arrays(unlisted, F.transform(unlisted, lambda _t: F.lit("mask")))
    # Default (as the original): listed entities override, all other base
    # actions stand even when the request is not "redact everything".
    # ``strict``: without redact-all, types not listed are switched off.
    base_map = policy_map(base)
    if strict:
        base_map = F.when(redact_all_default, base_map).otherwise(
            F.transform_values(base_map, lambda _k, _v: F.lit("none")))
    with_overrides = _map_merge(base_map, ea)
    return F.when(redact_all_default, _map_merge(with_overrides, forced)).otherwise(with_overrides)


def _map_merge(a: Column, b: Column) -> Column:
    """Entries of ``a`` overridden by ``b`` (no duplicate keys)."""
    kept = F.map_filter(a, lambda k, _v: ~F.array_contains(F.map_keys(b), k))
    return F.map_concat(kept, b)


def analyze_prompt(entity_actions: Column, prompt: Column) -> Column:
    """Entities to redact (mask) and keep (none), sorted; confidence
    ``high`` when anything was recognised or the prompt is blank."""
    redact = F.array_sort(F.map_keys(F.map_filter(entity_actions, lambda _k, v: v == "mask")))
    keep = F.array_sort(F.map_keys(F.map_filter(entity_actions, lambda _k, v: v == "none")))
    blank = F.length(normalise_prompt(prompt)) == 0
    conf = F.when(blank | (F.size(redact) + F.size(keep) > 0), F.lit("high")).otherwise(F.lit("low"))
    return F.struct(F.when(blank, F.array().cast("array<string>")).otherwise(redact).alias("to_redact"),
                    F.when(blank, F.array().cast("array<string>")).otherwise(keep).alias("to_keep"),
                    conf.alias("confidence"))


# Decoding a model's JSON request.  Missing keys take defaults; text that
# is not valid JSON yields the fallback (empty, redact all, low confidence).
MODEL_REQUEST_SCHEMA = ("struct<entity_actions:map<string,string>,redact_all_default:boolean,"
                        "confidence:string,reasoning:string>")
FALLBACK_REASONING = "model unavailable - using safe default"


def decode_model_request(js: Column) -> Column:
    parsed = F.from_json(js, MODEL_REQUEST_SCHEMA)
    bad = F.try_parse_json(js).isNull() | parsed.isNull()
    empty = F.create_map().cast("map<string,string>")
    return (F.when(bad, F.struct(empty.alias("entity_actions"), F.lit(True).alias("redact_all_default"),
                                 F.lit("low").alias("confidence"), F.lit(FALLBACK_REASONING).alias("reasoning")))
            .otherwise(F.struct(F.coalesce(parsed["entity_actions"], empty).alias("entity_actions"),
                                F.coalesce(parsed["redact_all_default"], F.lit(True)).alias("redact_all_default"),
                                F.coalesce(parsed["confidence"], F.lit("medium")).alias("confidence"),
                                F.coalesce(parsed["reasoning"], F.lit("")).alias("reasoning"))))


def verb_action(p: Column) -> Column:
    """P10 (optional verb-aware mode): the action named by the first action
    verb in the prompt, ``mask`` when none is found."""
    words = sorted(ACTION_SYNONYMS.items())
    hits = F.filter(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(a).alias("a")) for w, a in words]),
                    lambda x: F.instr(p, x["w"]) > 0)
    first = F.array_min(F.transform(hits, lambda x: F.struct(F.instr(p, x["w"]).alias("pos"), x["a"].alias("a"))))
    return F.coalesce(first["a"], F.lit("mask"))
