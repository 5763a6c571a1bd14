"""Merge fold vs an independent sequential model; actions and rewriting."""
import base64
import hashlib
import hmac
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline import Policy, scrub
from scrubline.functions.actions import hash_value, mask_by_type, pseudonymize
from scrubline.functions.spans import CAND_T
from scrubline.operators.merge import merge_spans
from scrubline.operators.rules import STRUCTURED_TYPES

TYPES = ["EMAIL", "PHONE", "PERSON", "ORG", "CREDIT_CARD", "ADDRESS"]


def model_merge(spans):
    """Sequential overlap resolution written from the specification."""
    order = sorted(range(len(spans)), key=lambda i: (spans[i][0], -spans[i][1], spans[i][5], spans[i][6]))
    kept = []
    for i in order:
        s = spans[i]
        drop, remove = False, []
        for k in kept:
            if k[1] <= s[0] or s[1] <= k[0]:
                continue
            ss, ks = s[3] in STRUCTURED_TYPES, k[3] in STRUCTURED_TYPES
            if ss != ks:
                if ss:
                    remove.append(k)
                else:
                    drop = True
                    break
            elif (s[4], s[1] - s[0]) > (k[4], k[1] - k[0]):
                remove.append(k)
            else:
                drop = True
                break
        if not drop:
            kept = [x for x in kept if x not in remove] + [s]
    return kept


def test_merge_matches_model(spark):
    rnd = random.Random(11)
    docs = []
    for d in range(400):
        spans = []
        for r in range(rnd.randint(0, 12)):
            a = rnd.randint(0, 40)
            spans.append((a, a + rnd.randint(1, 12), f"t{r}", rnd.choice(TYPES), rnd.choice([0.8, 0.95, 0.99]),
                          rnd.randint(0, 2), r, None))
        docs.append((d, spans))
    df = spark.createDataFrame(docs, T.StructType([T.StructField("d", T.LongType()),
                                                   T.StructField("c", T.ArrayType(CAND_T))]))
    got = {r.d: [tuple(x) for x in r.m] for r in df.select("d", merge_spans(F.col("c")).alias("m")).collect()}
    for d, spans in docs:
        assert got[d] == model_merge(spans), spans


def test_masks(spark):
    rows = [("EMAIL", "alice@example.com", "a***@example.com"), ("EMAIL", "x@d.com", "*@d.com"),
            ("PHONE", "+1 202-555-0147", "+* ***-***-**47"), ("IP", "192.168.0.42", "192.168.0.x"),
            ("CREDIT_CARD", "4111", "[REDACTED]"), ("IPV6", "::1", "[REDACTED]")]
    df = spark.createDataFrame(rows, "t string, v string, e string")
    assert all(r.m == r.e for r in df.select(mask_by_type(F.col("t"), F.col("v")).alias("m"), "e").collect())


def test_hash_and_pseudonym_match_python(spark):
    salt = "pepper"
    vals = [("PERSON", "  John\t Smith "), ("ORG", "Acme Corp"), ("LOC", "Zürich"), ("ACCOUNT", "12-34"),
            ("GPE", "Paris"), ("EMAIL", "Ünïcode name")]
    df = spark.createDataFrame(vals, "t string, v string")
    got = df.select(hash_value(F.col("t"), F.col("v"), salt).alias("h"),
                    pseudonymize(F.col("t"), F.col("v"), salt).alias("p")).collect()
    prefix = {"PERSON": "Person", "ORG": "Org", "LOC": "Loc", "GPE": "Loc", "ACCOUNT": "Account"}
    for (t, v), r in zip(vals, got):
        h = hashlib.sha256(f"{salt}|{t}|{v}".encode()).hexdigest()[:12]
        assert r.h == f"hash_{h}"
        norm = " ".join(v.strip().split()).lower()
        dig = hmac.new(salt.encode(), f"{t}|{norm}".encode(), hashlib.sha256).digest()
        code = base64.b32encode(dig).decode().rstrip("=")[:8]
        assert r.p == f"{prefix.get(t, 'Ent')}_{code}"


def test_scrub_default_policy(spark, docs):
    out = scrub(docs(["Contact us at alice@example.com", "My Visa is 4111-1111-1111-1111.", "nothing here"]),
                salt="s").orderBy("doc_id").collect()
    assert [r.sanitized for r in out] == ["Contact us at a***@example.com", "My Visa is .", "nothing here"]


def test_scrub_custom_policy_replaces_map(spark, docs):
    p = Policy({"EMAIL": "mask", "PERSON": "pseudonymize"})
    out = scrub(docs(["card 4111-1111-1111-1111 mail bob@x.org"]), salt="s", policy=p).first()
    assert out.sanitized == "card 4111-1111-1111-1111 mail b***@x.org"


def test_forced_mode(spark, docs):
    out = scrub(docs(["mail bob@x.org"]), salt="s", mode="drop").first()
    assert out.sanitized == "mail "
