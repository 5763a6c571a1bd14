"""Scanning and scrubbing by plain-language requests.

Each document may have a request (a prompt); its policy is what the request
makes of the base policy.  Requests are a table of their own: prompts are
interned, so each distinct one is parsed once, and its policy finds the
requests by the prompt's hash and a salt.  A prompt that a third of all
documents share is therefore spread over ``SALTS`` join keys.  Policies then
join the documents on their keys, and from there on everything happens in the
document's row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.policy import Policy, policy_map
from ..operators.prompts import apply_request, parse_prompts
from ..operators.rewrite import with_actions
from .scan import ScanConfig, scan, scrub

#: Join keys that the requests of one prompt are dealt to.
SALTS = 64


def request_policies(requests: DataFrame, keys: list[str], prompt_col: str = "prompt", policy: Policy | None = None,
                     **parsing) -> DataFrame:
    """``keys`` and ``request_policy`` (map of entity type to action) of every
    request.  A null prompt is an empty one.  ``parsing`` are options of
    ``parse_prompts``."""
    rows = requests.select(*keys, F.coalesce(F.col(prompt_col), F.lit("")).alias("__prompt"))
    rows = rows.withColumn("__hash", F.xxhash64("__prompt")).withColumn("__salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int"))
    present = rows.groupBy("__hash", "__prompt", "__salt").agg(F.count(F.lit(1)).alias("__n")).drop("__n")
    parsed = parse_prompts(present.select("__hash", "__prompt").distinct(), "__prompt", **parsing)
    base = None if policy is None else policy.actions
    parsed = parsed.select("__hash", "__prompt", apply_request(F.col("entity_actions"), F.col("redact_all_default"), base).alias("request_policy"))
    lookup = present.join(parsed, ["__hash", "__prompt"])
    return rows.join(lookup, ["__hash", "__prompt", "__salt"]).select(*keys, "request_policy")


def with_request_policy(docs: DataFrame, requests: DataFrame, keys: list[str], prompt_col: str = "prompt",
                        policy: Policy | None = None, out_col: str = "request_policy") -> DataFrame:
    """``docs`` with the policy of their request (one request per key); those
    without a request get ``policy``."""
    base = policy_map((policy or Policy()).actions)
    joined = docs.join(request_policies(requests, keys, prompt_col, policy), keys, "left")
    return joined.withColumn(out_col, F.coalesce("request_policy", base))


def scan_by_request(docs: DataFrame, requests: DataFrame, keys: list[str], prompt_col: str = "prompt", policy: Policy | None = None,
                    text_col: str = "text", config: ScanConfig | None = None, **scan_kwargs) -> DataFrame:
    """Spans of every document, each with the action its request asks for."""
    df = scan(with_request_policy(docs, requests, keys, prompt_col, policy), text_col, config, **scan_kwargs)
    return df.withColumn("spans", with_actions(F.col("spans"), F.col("request_policy")))


def scrub_by_request(docs: DataFrame, requests: DataFrame, keys: list[str], salt: str, prompt_col: str = "prompt",
                     policy: Policy | None = None, text_col: str = "text", config: ScanConfig | None = None, **scrub_kwargs) -> DataFrame:
    """Documents rewritten as their requests ask for."""
    df = with_request_policy(docs, requests, keys, prompt_col, policy)
    return scrub(df, salt=salt, text_col=text_col, config=config, policy_col="request_policy", **scrub_kwargs)
