"""Registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (or text Spark derives from them) in
full.  Output columns are scalars with stable names so results can be
compared with the DuckDB statements in ``plans.oracle``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.actions import hash_value, mask_by_type, pseudonymize, replacement
from ..operators import detect as D
from ..operators.findings import (findings_by_document, job_log, report_rows, review_queue, scan_summary,
                                  span_rows, type_counts)
from ..operators.policy import Policy, policy_map
from ..operators.rewrite import with_actions
from ..operators.rules import MINIMAL_PACK, NETWORK_PACK, PII_PACK, SECRETS_PACK, Rule
from ..functions.spans import explode_rows
from ..sources.corpus import corpus
from . import requests as R
from .long_documents import scan_in_pieces
from .scan import ScanConfig, scan, scrub

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}

# The salt used by the registered queries (any constant works; it must be the
# same on every task and in the oracle).
QUERY_SALT = "scrubline-query-salt"
KEYS = ["src", "doc_id"]


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn
    return deco


def _rows(df: DataFrame) -> DataFrame:
    """Common span-row projection with 64-bit offsets."""
    return df.select(*KEYS, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
                     "text", "type", "confidence")


# ---------------------------------------------------------------- detection
DETECT_RULES: dict[str, Rule] = {
    "detect_email": PII_PACK[0], "detect_phone": PII_PACK[1], "detect_credit_card": PII_PACK[2],
    "detect_ssn": PII_PACK[3], "detect_iban": PII_PACK[4], "detect_passport": PII_PACK[5],
    "detect_date": PII_PACK[6], "detect_ip": NETWORK_PACK[0], "detect_ipv6": NETWORK_PACK[1],
    "detect_mac": NETWORK_PACK[2], "detect_url": NETWORK_PACK[3],
}


def _detect_query(rule: Rule) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = corpus(spark, sf_dir)
        return _rows(D.rule_match_rows(c.select(*KEYS, "text").withColumn("k", F.struct(*KEYS)), rule,
                                       id_col="k").select("k.*", "start", "end", "text", "type", "confidence"))
    run.__doc__ = f"R: every validated match of {rule.key} over the corpus."
    return run


for _name, _rule in DETECT_RULES.items():
    register(_name)(_detect_query(_rule))


def _pack_query(rules: list[Rule]) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = corpus(spark, sf_dir)
        d = D.detect_regex(c, "text", rules, out_col="cands")
        return _rows(span_rows(d, KEYS, "cands"))
    return run


register("detect_secrets")(_pack_query(SECRETS_PACK))
register("detect_minimal_pack")(_pack_query(MINIMAL_PACK))


def _validator_query(rule: Rule) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = corpus(spark, sf_dir).withColumn("k", F.struct(*KEYS))
        x = D.rule_match_rows(c, rule, id_col="k", validated=False)
        return x.select("k.*", F.col("start").cast("long").alias("start"), "text",
                        F.translate("text", " -", "").alias("normalized"), "valid")
    return run


register("validate_luhn")(_validator_query(PII_PACK[2]))
register("validate_iban")(_validator_query(PII_PACK[4]))


@register("token_rules")
def token_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4-E7 cue rules with the ruler's longest-first conflict rule."""
    d = D.detect_ruler(corpus(spark, sf_dir), "text", "rc")
    return _rows(span_rows(d, KEYS, "rc"))


# ------------------------------------------------------------------- merge
FULL = ScanConfig(ruler=True)


@register("merge_spans")
def merge_spans_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: all packs + cue rules, overlap-resolved."""
    return _rows(span_rows(scan(corpus(spark, sf_dir), config=FULL), KEYS))


@register("merge_confident")
def merge_confident_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: the same with a confidence floor before the fold."""
    return _rows(span_rows(scan(corpus(spark, sf_dir), config=ScanConfig(ruler=True, min_confidence=0.85)), KEYS))


# ----------------------------------------------------------------- actions
def _merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_rows(scan(corpus(spark, sf_dir), config=FULL), KEYS)


@register("action_mask")
def action_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2-A5: type-aware masks of every merged span."""
    x = _merged_rows(spark, sf_dir)
    return x.select(*KEYS, F.col("start").cast("long").alias("start"), "type", "text",
                    mask_by_type(F.col("type"), F.col("text")).alias("replacement"))


@register("action_hash")
def action_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7."""
    x = _merged_rows(spark, sf_dir)
    return x.select(*KEYS, F.col("start").cast("long").alias("start"), "type", "text",
                    hash_value(F.col("type"), F.col("text"), QUERY_SALT).alias("replacement"))


@register("action_pseudonymize")
def action_pseudonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases for every merged span's value, as if typed PERSON and as
    its own type."""
    x = _merged_rows(spark, sf_dir)
    return x.select(*KEYS, F.col("start").cast("long").alias("start"), "type", "text",
                    pseudonymize(F.col("type"), F.col("text"), QUERY_SALT).alias("replacement"),
                    pseudonymize(F.lit("PERSON"), F.col("text"), QUERY_SALT).alias("person_alias"))


@register("action_policy")
def action_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A6, A10 and the policy lookup: the replacement each action gives."""
    x = _merged_rows(spark, sf_dir)
    cols = [replacement(F.col("type"), F.col("text"), F.lit(a), QUERY_SALT).alias(f"r_{a}")
            for a in ("none", "drop", "unknown")]
    return x.select(*KEYS, F.col("start").cast("long").alias("start"), "type", *cols)


# ------------------------------------------------------------------- scrub
def _scrubbed(spark: SparkSession, sf_dir: str, policy: Policy | None = None, mode: str | None = None) -> DataFrame:
    return scrub(corpus(spark, sf_dir), salt=QUERY_SALT, policy=policy, config=FULL, mode=mode)


@register("scrub_documents")
def scrub_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 + K1: every document rewritten under the default policy."""
    return _scrubbed(spark, sf_dir).select(*KEYS, "sanitized")


@register("scrub_forced_mode")
def scrub_forced_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-none action forced to hash."""
    return _scrubbed(spark, sf_dir, mode="hash").select(*KEYS, "sanitized")


@register("findings_by_document")
def findings_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_by_document(scan(corpus(spark, sf_dir), config=FULL), KEYS)


@register("scan_summary")
def scan_summary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_summary(scan(corpus(spark, sf_dir), config=FULL))


def _acted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged spans with the default policy's action, nothing rewritten."""
    d = scan(corpus(spark, sf_dir), config=FULL)
    return d.withColumn("spans", with_actions(F.col("spans"), policy_map(Policy().actions)))


@register("type_counts")
def type_counts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected vs redacted (action <> none) per type, default policy."""
    return type_counts(_acted(spark, sf_dir))


@register("review_queue")
def review_queue_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_queue(scan(corpus(spark, sf_dir), config=FULL), KEYS, threshold=0.8)


@register("report_rows")
def report_rows_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan(corpus(spark, sf_dir), config=FULL).withColumn(
        "title", F.concat(F.col("src"), F.lit("/"), F.col("doc_id").cast("string")))
    return report_rows(d, "title")


@register("job_log")
def job_log_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: characters, bytes, detected and redacted counts and status per document."""
    return job_log(_acted(spark, sf_dir), KEYS)


# ----------------------------------------------------------------- prompts
from ..operators import prompts as P  # noqa: E402
from ..sources.tables import prompts as prompt_rows  # noqa: E402

PKEYS = ["conv_id", "turn"]


def _map_string(m) -> "F.Column":
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_prompts(prompt_rows(spark, sf_dir), "prompt")


@register("prompt_entities")
def prompt_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity types each prompt mentions, in mention order."""
    d = _parsed(spark, sf_dir)
    return d.select(*PKEYS, F.array_join("mentioned", ",").alias("entities"),
                    F.size("mentioned").cast("long").alias("n_entities"))


@register("prompt_request")
def prompt_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent flags and the parsed request."""
    d = _parsed(spark, sf_dir)
    return d.select(*PKEYS, "has_exclude", "has_only", "has_global", "redact_all_default",
                    _map_string(F.col("entity_actions")).alias("entity_actions"))


@register("prompt_policy")
def prompt_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effective policy of every prompt, one row per entity."""
    d = _parsed(spark, sf_dir).withColumn("pol", P.apply_request(F.col("entity_actions"), F.col("redact_all_default")))
    return (d.select(*PKEYS, F.explode_outer("pol").alias("entity", "action"))
            .where(F.col("entity").isNotNull()))


@register("prompt_analysis")
def prompt_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9."""
    d = _parsed(spark, sf_dir).withColumn("a", P.analyze_prompt(F.col("entity_actions"), F.col("prompt")))
    return d.select(*PKEYS, F.array_join("a.to_redact", ",").alias("to_redact"),
                    F.array_join("a.to_keep", ",").alias("to_keep"), F.col("a.confidence").alias("confidence"))


def model_request_json(d: DataFrame) -> DataFrame:
    """Stand-in model responses built from each prompt: its mentioned types
    (plus one type the policy does not know) with a verb, and the global
    flag; every fourth turn is cut short so it is not valid JSON."""
    verb = F.when(F.col("has_exclude"), F.lit("none")).otherwise(F.lit("hide"))
    items = F.transform("mentioned", lambda e: F.concat(F.lit('"'), e, F.lit('": "'), verb, F.lit('"')))
    items = F.concat(items, F.array(F.lit('"CRYPTO_WALLET": "mask"')))
    js = F.concat(F.lit('{"entity_actions": {'), F.array_join(items, ", "), F.lit('}, "redact_all_default": '),
                  F.when(F.col("has_global"), F.lit("true")).otherwise(F.lit("false")), F.lit("}"))
    js = F.when(F.col("turn") % 4 == 2, F.substr(js, F.lit(1), F.length(js) - 1)).otherwise(js)
    return d.withColumn("response", js)


@register("prompt_policy_model")
def prompt_policy_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 + P8: decode the model's JSON request and apply it."""
    d = model_request_json(_parsed(spark, sf_dir)).withColumn("req", P.decode_model_request(F.col("response")))
    d = d.withColumn("pol", P.apply_request(F.col("req.entity_actions"), F.col("req.redact_all_default"),
                                            model_variant=True))
    return (d.select(*PKEYS, F.col("req.confidence").alias("confidence"),
                     F.explode_outer("pol").alias("entity", "action"))
            .where(F.col("entity").isNotNull()))


def document_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in requests: the first user turn of a conversation asks for the
    documents, pages and records of its number."""
    first = prompt_rows(spark, sf_dir).groupBy("conv_id").agg(F.min(F.struct("turn", "prompt"))["prompt"].alias("prompt"))
    return first.select(F.explode(F.array(*[F.lit(s) for s in ("documents", "pages", "records")])).alias("src"),
                        F.col("conv_id").alias("doc_id"), "prompt")


@register("prompt_scan")
def prompt_scan_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 + M1: every span with the action that its document's request asks for."""
    d = R.scan_by_request(corpus(spark, sf_dir), document_requests(spark, sf_dir), KEYS, config=FULL)
    x = explode_rows(d, F.col("spans"), KEYS, "s")
    return x.select(*KEYS, F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"),
                    F.col("s.type").alias("type"), F.col("s.action").alias("action"))


@register("prompt_scrub")
def prompt_scrub_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 + A11: every document rewritten as its request asks for."""
    return R.scrub_by_request(corpus(spark, sf_dir), document_requests(spark, sf_dir), KEYS, QUERY_SALT, config=FULL).select(*KEYS, "sanitized")


@register("job_log_requests")
def job_log_requests_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5 with type, day and prompt; every fiftieth document is one that could
    not be read."""
    d = corpus(spark, sf_dir).join(document_requests(spark, sf_dir), KEYS, "left")
    d = d.withColumn("text", F.when(F.col("doc_id") % 50 != 7, F.col("text")))
    d = scan(d, config=FULL).withColumn("spans", with_actions(F.col("spans"), policy_map(Policy().actions)))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")), "yyyy-MM-dd")
    log = job_log(d, KEYS, created_at=day, prompt=F.col("prompt"),
                  file_type=F.when(F.col("src") == "pages", F.lit("html")).otherwise(F.lit("txt")))
    return log.withColumnRenamed("created_at", "day")


# ----------------------------------------------------------------- preview
from ..operators import preview as W  # noqa: E402
from ..operators.rewrite import preview_blocks as _blocks, wrap_fixed as _wrap  # noqa: E402


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(corpus(spark, sf_dir), config=FULL)


@register("preview_blocks")
def preview_blocks_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span shown as block characters."""
    d = _scanned(spark, sf_dir)
    return d.select(*KEYS, _blocks(F.col("text"), F.col("spans")).alias("preview"))


@register("preview_wrapped")
def preview_wrapped_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 + W2: block preview cut into 80-character lines."""
    d = _scanned(spark, sf_dir).withColumn("p", _blocks(F.col("text"), F.col("spans")))
    return d.select(*KEYS, _wrap(F.col("p"), 80).alias("preview"))


@register("redaction_boxes")
def redaction_boxes_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3."""
    return W.redaction_boxes(_scanned(spark, sf_dir), KEYS)


@register("redaction_result")
def redaction_result_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are HTML, an unsupported type for rendering."""
    d = _scanned(spark, sf_dir).withColumn(
        "r", W.redaction_result(F.when(F.col("src") == "pages", F.lit("html")).otherwise(F.lit("txt")), F.col("spans")))
    return d.select(*KEYS, "r.success", "r.redacted_count", "r.error_message")


@register("chunk_text")
def chunk_text_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2000-character windows overlapping by 200."""
    d = corpus(spark, sf_dir).withColumn("ch", W.chunk_text(F.col("text")))
    x = explode_rows(d, F.col("ch"), KEYS, "c")
    return x.select(*KEYS, F.col("c.chunk_idx").cast("long").alias("chunk_idx"),
                    F.col("c.chunk_start").cast("long").alias("chunk_start"),
                    F.length("c.chunk_text").cast("long").alias("chunk_len"), F.md5("c.chunk_text").alias("chunk_md5"))


#: A text with one match of 125 to 215 characters on the first cut of the windows.
LONG_MATCH_SQL = ("repeat('word ', CAST(360 + c_custkey % 40 AS INT)) || 'https://long.example.com/' || "
                  "repeat('a', CAST(100 + c_custkey % 90 AS INT)) || ' ' || repeat('tail ', 200)")


@register("chunk_detect")
def chunk_detect_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rule packs run per chunk, offsets rebased to the document; a
    match counts in the window that owns its start."""
    long = customers(spark, sf_dir, ["c_custkey"]).selectExpr("'long' AS src", "c_custkey AS doc_id", f"{LONG_MATCH_SQL} AS text")
    d = corpus(spark, sf_dir).unionByName(long).withColumn("ch", W.chunk_text(F.col("text"))).withColumn("n", F.length("text"))
    ch = explode_rows(d, F.col("ch"), KEYS + ["n"], "c").select(*KEYS, "n", F.col("c.chunk_start").alias("chunk_start"),
                                                                F.col("c.chunk_text").alias("text"))
    det = D.detect_regex(ch, "text", PII_PACK + SECRETS_PACK + NETWORK_PACK, out_col="cands")
    rows = span_rows(det, KEYS + ["chunk_start", "n"], "cands")
    rows = rows.where(W.owned_by_chunk(F.col("start"), F.col("end"), F.col("chunk_start"), F.col("n")))
    return rows.select(*KEYS, (F.col("chunk_start") + F.col("start")).cast("long").alias("start"),
                       (F.col("chunk_start") + F.col("end")).cast("long").alias("end"), "text", "type")


#: Long texts: the records of a quarter of the customers, one after the other.
LONG_TEXT_PARTS = 4


@register("scan_long")
def scan_long_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long documents scanned in pieces by many tasks, spans as in the whole text."""
    records = corpus(spark, sf_dir).where("src = 'records'").groupBy(F.lit("long").alias("src"), (F.col("doc_id") % LONG_TEXT_PARTS).alias("doc_id")).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("rows"))
    d = records.select(*KEYS, F.array_join("rows.text", "\n").alias("text"))
    x = scan_in_pieces(d, KEYS, config=FULL, piece=1 << 14, overlap=1 << 11)
    return x.select(*KEYS, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text", "type", "confidence")


@register("cost_estimate")
def cost_estimate_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E17 per document (no prompt)."""
    return corpus(spark, sf_dir).select(*KEYS, F.round(W.cost_estimate(F.col("text")), 12).alias("cost"))


# --------------------------------------------------------- external findings
from ..operators import external as X  # noqa: E402
from ..sources.tables import standin_responses  # noqa: E402


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.locate_findings(standin_responses(corpus(spark, sf_dir)), "text", "response")


@register("external_parse")
def external_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded responses (defaults, void and malformed handling)."""
    d = standin_responses(corpus(spark, sf_dir)).withColumn("ext", X.decode_response(F.col("response")))
    values = F.transform("ext.entities", lambda e: F.concat_ws("|", e["value"], e["type"], e["action"],
                                                               F.round(e["confidence"] * 100).cast("int").cast("string")))
    return d.select(*KEYS, F.col("ext.success").alias("success"), F.size("ext.entities").cast("long").alias("n_entities"),
                    F.array_join(F.array_sort(values), ";").alias("entities"),
                    F.col("ext.confidence").alias("confidence"), F.col("ext.reasoning").alias("reasoning"))


@register("locate_findings")
def locate_findings_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every located occurrence with the method that found it."""
    r = X.located_rows(_located(spark, sf_dir), KEYS)
    return r.drop("entity_idx")


@register("unlocated_findings")
def unlocated_findings_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E14."""
    return X.unlocated_rows(_located(spark, sf_dir), KEYS).drop("entity_idx")


def _with_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _located(spark, sf_dir).withColumn("findings", X.finding_candidates(F.col("located")))
    return scrub(d, salt=QUERY_SALT, config=FULL, extra_cols=["findings"])


@register("external_merge")
def external_merge_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E10 + M1: external findings in the same fold as the rules; a finding that
    is kept keeps its own action, before the policy's."""
    x = explode_rows(_with_findings(spark, sf_dir), F.col("spans"), KEYS, "s")
    return x.select(*KEYS, F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), F.col("s.text").alias("text"),
                    F.col("s.type").alias("type"), F.col("s.confidence").alias("confidence"), F.col("s.action").alias("action"))


@register("external_scrub")
def external_scrub_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E10 + A11: documents rewritten from rules and external findings."""
    return _with_findings(spark, sf_dir).select(*KEYS, "sanitized")


@register("span_union")
def span_union_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cue-rule spans without a confidence column unioned with secret
    spans; missing confidence becomes 0.99."""
    c = corpus(spark, sf_dir)
    ruler = span_rows(D.detect_ruler(c, "text", "rc"), KEYS, "rc").drop("idx", "confidence")
    secrets = span_rows(D.detect_regex(c, "text", SECRETS_PACK, out_col="sc"), KEYS, "sc").drop("idx")
    return _rows(X.union_spans(ruler, secrets))


# ------------------------------------------------------------------- usage
from ..operators import usage as G  # noqa: E402
from ..session import materialize, shared_folder  # noqa: E402
from .usage_log import UsageLog  # noqa: E402
from ..sources.tables import jobs as job_rows, users as user_rows  # noqa: E402


def _admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.admission(job_rows(spark, sf_dir), user_rows(spark, sf_dir))


@register("tier_limits")
def tier_limits_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's limits; unknown tiers fall back to FREE."""
    u = G.with_tier_limits(user_rows(spark, sf_dir))
    return u.select("user_id", "tier", "effective_tier", F.col("monthly_documents").cast("long").alias("monthly_documents"),
                    F.col("max_file_size_mb").cast("long").alias("max_file_size_mb"),
                    F.array_join("supported_formats", ",").alias("supported_formats"),
                    F.size("features").cast("long").alias("n_features"))


@register("admission_check")
def admission_check_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7 + G8: admission decision and charge of every request."""
    a = _admitted(spark, sf_dir)
    return a.select("job_id", "user_id", "month", "count_before", "reason", "admitted", "charged")


@register("usage_daily")
def usage_daily_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.usage_daily(_admitted(spark, sf_dir))


@register("usage_incremental")
def usage_incremental_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4 kept up to date by batches: the log after four deliveries, one of
    which comes twice and one first with rows of another."""
    log = UsageLog(spark, shared_folder(spark, "usage"))
    a = materialize(_admitted(spark, sf_dir), "admitted")
    part = lambda k: a.where(F.pmod(F.xxhash64("job_id"), F.lit(3)) == k)
    for batch, rows in (("b0", part(2)), ("b1", part(1)), ("b0", part(0)), ("b2", part(2)), ("b1", part(1))):
        log.apply(batch, rows)
    return log.daily()


@register("usage_monthly")
def usage_monthly_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.usage_monthly(_admitted(spark, sf_dir))


@register("usage_profile")
def usage_profile_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.usage_profile(_admitted(spark, sf_dir), user_rows(spark, sf_dir))


# ------------------------------------------------------- entity detectors
from ..operators import entities as N  # noqa: E402
from ..sources.tables import customers, read_table  # noqa: E402


def name_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from the dimension tables: nations and regions as places (those of
    one region as organisations, those of another as both), suppliers as
    organisations, customers as people."""
    nation = read_table(spark, sf_dir, "nation", ["n_name", "n_regionkey"])
    parts = [nation.select(F.col("n_name").alias("term"), F.when(F.col("n_regionkey") == 2, "ORG").otherwise("LOC").alias("type")),
             nation.where("n_regionkey = 1").select(F.col("n_name").alias("term"), F.lit("ORG").alias("type")),
             read_table(spark, sf_dir, "region", ["r_name"]).select(F.col("r_name").alias("term"), F.lit("LOC").alias("type")),
             read_table(spark, sf_dir, "supplier", ["s_name"]).select(F.col("s_name").alias("term"), F.lit("ORG").alias("type")),
             read_table(spark, sf_dir, "customer", ["c_name"]).select(F.col("c_name").alias("term"), F.lit("PERSON").alias("type"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("dictionary_entities")
def dictionary_entities_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary names found in the corpus (word n-grams, longest first)."""
    d = N.dictionary_entities(corpus(spark, sf_dir), name_dictionary(spark, sf_dir), key_cols=KEYS)
    return _rows(span_rows(d, KEYS, "dict_cands"))


# Stand-in model for the registered query: capitalised word pairs as PERSON,
# four-digit numbers as CARDINAL (a label the mapping drops).
STANDIN_MODEL = [(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", "PERSON"), (r"\b\d{4}\b", "CARDINAL")]


@register("model_entities")
def model_entities_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 + E2: scorer run per Arrow batch, labels mapped in the JVM."""
    d = N.model_entities(corpus(spark, sf_dir), N.regex_scorer(STANDIN_MODEL))
    return _rows(span_rows(d, KEYS, "model_cands"))


@register("ruler_precedence")
def ruler_precedence_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cue-rule spans that overlap no model span."""
    d = N.model_entities(corpus(spark, sf_dir), N.regex_scorer(STANDIN_MODEL))
    return _rows(span_rows(D.detect_ruler(d, "text", "rc", yield_to="model_cands"), KEYS, "rc"))


# ------------------------------------------------------------------ files
from ..sources import files as T, sinks as K  # noqa: E402

#: A file name per document: neighbours differ in an escaped character only,
#: others are hidden, deep, or hold characters that globs and URIs treat specially.
FILE_NAME_SQL = (
    "CASE doc_id % 6 WHEN 0 THEN 'a b' WHEN 1 THEN 'a%20b' WHEN 2 THEN '.hidden' WHEN 3 THEN 'deep/er/_x' WHEN 4 THEN 'q?[1]{2}*' ELSE 'é+#&' END "
    "|| CAST(CAST(floor(doc_id / 6) AS BIGINT) AS STRING) || '.txt'"
)


@register("tree_files")
def tree_files_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + S2 + K1: documents written as one file each, listed and read back."""
    out = shared_folder(spark, "tree")
    d = read_table(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    K.write_files(d.selectExpr(f"coalesce(source, 'none') || '/' || {FILE_NAME_SQL} AS rel_path", "text AS sanitized"), out)
    t = T.documents_from_tree(spark, out)
    return t.select("rel_path", "n_bytes", "readable", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@register("mirror_files")
def mirror_files_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: every scrubbed document written to its own path, with the manifest
    and what the file holds."""
    out = shared_folder(spark, "mirror")
    d = _scrubbed(spark, sf_dir).select(F.concat_ws("/", "src", F.col("doc_id").cast("string")).alias("rel_path"), "sanitized")
    told = K.write_files(d, out).select("rel_path", "status", F.col("n_bytes").alias("written"), "sha256")
    read = T.read_tree(spark, out).select("rel_path", "n_bytes", F.sha2("content", 256).alias("read_sha256"))
    return told.join(read, "rel_path").select("rel_path", "status", "n_bytes", "sha256", (F.col("sha256") == F.col("read_sha256")).alias("same"))
