"""Requests, external findings, long documents and configuration files."""
import json
import random

import pytest
from pyspark.sql import functions as F

from scrubline import ScanConfig, scan, scrub
from scrubline.operators import external as X
from scrubline.operators import prompts as P
from scrubline.plans import long_documents as L
from scrubline.plans.config import load_config
from scrubline.plans.requests import scan_by_request, scrub_by_request

KEY = "AKIA1234567890ABCD"
TOKEN = "ghp_" + "a1B2" * 9
SECRETS = f"keys {KEY} and {TOKEN}, mail bob@example.org"


def test_requests_remove_secrets(spark, docs):
    d = docs([SECRETS] * 7)
    asked = [(0, "Redact all."), (1, "Keep secrets, redact everything else"), (2, "Only emails."), (3, "Redact secrets"), (4, None), (5, "")]
    requests = spark.createDataFrame(asked, "doc_id long, prompt string")
    got = {r.doc_id: r.sanitized for r in scrub_by_request(d, requests, ["doc_id"], "s").collect()}
    for i in (0, 2, 3, 4, 5, 6):
        assert KEY not in got[i] and TOKEN not in got[i], got[i]
    assert KEY in got[1] and TOKEN in got[1] and "bob@" not in got[1]
    assert got[0] == "keys [REDACTED] and [REDACTED], mail b***@example.org"
    assert got[6] == {r.sanitized for r in scrub(docs([SECRETS]), salt="s").collect()}.pop()
    actions = {(r.doc_id, s.type): s.action for r in scan_by_request(d, requests, ["doc_id"]).collect() for s in r.spans}
    assert actions[0, "API_KEY"] == "mask" and actions[1, "API_KEY"] == "none" and actions[6, "API_KEY"] == "drop"


def test_requests_of_one_prompt_are_spread(spark, docs, monkeypatch):
    d = docs([SECRETS] * 300)
    requests = d.select("doc_id", F.when(F.col("doc_id") < 200, "Redact all.").otherwise(F.concat(F.lit("Only emails "), "doc_id")).alias("prompt"))
    got = scrub_by_request(d, requests, ["doc_id"], "s").select("doc_id", "sanitized").collect()
    assert len(got) == 300 and len({r.sanitized for r in got if r.doc_id < 200}) == 1


def test_model_request_names_finer_secret_types(spark):
    df = spark.createDataFrame([('{"SECRET": "none"}',), ('{"SECRET": "none", "API_KEY": "hide"}',), ("{}",)], "j string")
    ea = F.from_json("j", "map<string,string>")
    got = [r.p for r in df.select(P.apply_request(ea, F.lit(True), model_variant=True).alias("p")).collect()]
    assert [(p["API_KEY"], p["AWS_ACCESS_KEY_ID"], p["SECRET"]) for p in got] == [("none",) * 3, ("mask", "none", "none"), ("mask",) * 3]


def test_findings_keep_their_action_in_the_fold(spark):
    text = "Call Jane Doe at jane@x.org about Acme"
    answer = json.dumps({"entities": [{"text": "Jane Doe", "type": "PERSON", "action": "drop", "confidence": 0.9},
                                      {"text": "jane@x.org about", "type": "OTHER", "action": "drop"},  # loses to the e-mail address
                                      {"text": "Acme", "type": "ORG", "action": "none"}]})
    d = X.locate_findings(spark.createDataFrame([(1, text, answer)], "doc_id long, text string, response string"))
    d = d.withColumn("findings", X.finding_candidates(F.col("located")))
    r = scrub(d, salt="s", extra_cols=["findings"]).first()
    assert r.sanitized == "Call  at j***@x.org about Acme"
    assert [(s.type, s.action) for s in r.spans] == [("PERSON", "drop"), ("EMAIL", "mask"), ("ORG", "none")]
    forced = scrub(d, salt="s", extra_cols=["findings"], mode="mask").first()
    assert forced.sanitized == "Call [REDACTED] at j***@x.org about Acme"


def test_locating_is_linear_in_occurrences(spark):
    import time
    d = spark.createDataFrame([("ab " * 80_000, '{"entities": [{"text": "ab"}]}')], "text string, response string")
    run = lambda: X.locate_findings(d).select(F.expr("transform(located, e -> size(e.spans))").alias("n")).first().n
    assert run() == [80_000]
    t = time.perf_counter()
    run()
    assert time.perf_counter() - t < 30  # seconds, not minutes, on any machine


PARTS = ["bob@example.org", "+1 (202) 555-0147", "4111 1111 1111 1111", "123-45-6789", "2024-01-02", "10.0.0.1", "12 Main Street", "medical record number",
         "https://a.example.com/x?y=1", KEY, "plain words", "é😀ß", "100 Oak Road St.", "social security number"]


@pytest.mark.parametrize("piece,overlap", [(300, 120), (1000, 200)])
def test_long_documents_in_pieces(spark, docs, piece, overlap):
    rng = random.Random(piece)
    texts = [" ".join(rng.choice(PARTS) for _ in range(n)) for n in (400, 120, 3, 1)] + ["", None, "x" * 5000]
    config = ScanConfig(ruler=True)
    whole = scan(docs(texts), config=config)
    want = sorted((r.doc_id, s.start, s.end, s.text, s.type) for r in whole.collect() for s in r.spans)
    got = L.scan_in_pieces(docs(texts), ["doc_id"], config=config, piece=piece, overlap=overlap)
    assert sorted((r.doc_id, r.start, r.end, r.text, r.type) for r in got.collect()) == want and len(want) > 400


def test_pieces_are_scanned_once(spark, docs):
    """The islands read the candidates several times; the rules run once."""
    got = L.scan_in_pieces(docs([f"{SECRETS} and more. " * 40]), ["doc_id"], config=ScanConfig(ruler=True), piece=300, overlap=100)
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() >= 120


def test_islands_across_pieces(spark):
    """Overlapping chains that cross several cuts are one island, as in one pass."""
    rng = random.Random(5)
    rows = []
    for d in range(3):
        for i in range(120):
            a = rng.randrange(2000)
            rows.append((d, a // 100, (a, a + rng.choice([1, 5, 30, 250]), "t", "EMAIL", 0.9, 0, i, None)))
    cands = spark.createDataFrame(rows, "d long, piece int, c struct<start:int,end:int,text:string,type:string,confidence:double,det:int,rule:int,own_action:string>")
    got = {(r.d, tuple(r.c)): r.island for r in L.with_islands(cands, ["d"]).collect()}
    assert len(got) == len(rows)
    for d in range(3):
        reach = island = -1
        for c in sorted((c for e, _, c in rows if e == d), key=lambda c: (c[0], -c[1], c[5], c[6])):
            if c[0] >= reach:
                island = c[0]
            reach = max(reach, c[1])
            assert got[d, c] == island


def test_config_from_a_file(spark, docs, tmp_path):
    path = tmp_path / "policy.yaml"
    path.write_text(json.dumps({"policy": {"actions": {"EMAIL": "drop", "TICKET": "mask"}, "min_confidence": 0.5},
                                "detectors": {"regex": {"packs": {"network": False}}, "ruler": {"enabled": True, "id_patterns": False}},
                                "patterns": {"TICKET": {"regex": "TCK-[0-9]{6}", "confidence": 0.9}, "bad": 3}}))
    for uri in (str(path), f"file://{path}"):
        policy, config = load_config(uri)
        assert policy.actions == {"EMAIL": "drop", "TICKET": "mask"} and policy.min_confidence == 0.5
        assert config.ruler and not config.id_patterns and not config.network and [r.key for r in config.extra_rules] == ["TICKET"]
    out = scrub(docs(["a bob@x.org TCK-123456 10.0.0.1"]), salt="s", policy=policy, config=config).first()
    assert out.sanitized == "a  [REDACTED] 10.0.0.1"
    empty = tmp_path / "empty.json"
    empty.write_text("{}")
    policy, config = load_config(str(empty))
    assert policy.actions["API_KEY"] == "drop" and config == ScanConfig()
