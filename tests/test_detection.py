"""Single-rule detection on the fixture one-liners, validators and offsets."""
import dataclasses
import random
import re

from pyspark.sql import functions as F

from scrubline import ScanConfig, scan
from scrubline.functions.spans import prefix_sums, regex_spans
from scrubline.functions.validators import iban, luhn
from scrubline.operators import detect as D
from scrubline.operators.rules import PII_PACK, select_rules

ONE_LINERS = {
    "EMAIL": "Contact us at alice@example.com",
    "PHONE": "Call me at +1 202-555-0147",
    "CREDIT_CARD": "My Visa is 4111-1111-1111-1111",
    "SSN": "SSN: 123-45-6789",
    "IP": "Server IP 192.168.0.1",
    "IBAN": "IBAN DE89 3704 0044 0532 0130 00",
}
# The three-line sample fixture.  On line 2 the case-insensitive IBAN pattern
# runs on greedily into "and AWS key", so that candidate fails the checksum
# and no IBAN is reported there (same as the original rule pack).
SAMPLE = ["Alice’s US passport 123456789 and Visa 4111-1111-1111-1111 were logged by mistake.",
          "Her IBAN is DE89 3704 0044 0532 0130 00 and AWS key AKIA1234567890ABCD leaked too.",
          "IPv6: 2001:0db8:85a3:0000:0000:8a2e:0370:7334"]
SSN_BAD = ["000-12-3456", "666-12-3456", "912-12-3456", "123-00-4567", "123-45-0000"]


def _types(spark, docs, text, cfg=None):
    d = scan(docs([text]), config=cfg or ScanConfig())
    return {r.t for r in d.select(F.explode("spans.type").alias("t")).collect()}


def test_fixture_texts(spark, docs):
    texts = list(ONE_LINERS.values()) + SAMPLE + [f"id {b} end" for b in SSN_BAD] + ["id 123-45-6789 end"]
    d = scan(docs(texts))
    found = {(r.doc_id, r.t) for r in d.select("doc_id", F.explode("spans.type").alias("t")).collect()}
    for i, etype in enumerate(ONE_LINERS):
        assert (i, etype) in found, etype
    n = len(ONE_LINERS)
    assert (n, "PASSPORT") in found and (n, "CREDIT_CARD") in found
    assert (n + 1, "AWS_ACCESS_KEY_ID") in found and (n + 1, "IBAN") not in found
    assert (n + 2, "IPV6") in found
    for j in range(len(SSN_BAD)):
        assert (n + 3 + j, "SSN") not in found
    assert (n + 3 + len(SSN_BAD), "SSN") in found


def test_validators(spark):
    rows = [("4111111111111111", True), ("4111111111111112", False), ("411111111111", False),
            ("DE89370400440532013000", True), ("DE89370400440532013001", False)]
    df = spark.createDataFrame(rows, "v string, ok boolean")
    got = df.select("v", F.when(F.col("v").startswith("DE"), iban(F.col("v"))).otherwise(luhn(F.col("v"))).alias("r")).collect()
    assert [r.r for r in got] == [r[1] for r in rows]


def test_offsets_match_python(spark):
    """Offsets from extract+split equal Python finditer on ASCII text."""
    rnd = random.Random(7)
    alphabet = "ab1234567890 .-@x"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 300))) for _ in range(300)]
    pats = [r"\d{3}[-.]?\d{4}", r"[a-z]+@[a-z]+", r"\d+"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for p in pats:
        got = {r.doc_id: [(s.start, s.end, s.text) for s in r.sp]
               for r in df.select("doc_id", regex_spans(F.col("text"), p).alias("sp")).collect()}
        for i, t in enumerate(texts):
            exp = [(m.start(), m.end(), m.group(0)) for m in re.finditer(p, t)]
            assert got[i] == exp, (p, t)


def test_prefix_sums(spark):
    rnd = random.Random(3)
    arrays = [[rnd.randint(0, 9) for _ in range(n)] for n in (0, 1, 5, 31, 32, 33, 100, 257, 1000)]
    df = spark.createDataFrame([(a,) for a in arrays], "a array<int>")
    got = [r.p for r in df.select(prefix_sums(F.col("a")).alias("p")).collect()]
    for a, g in zip(arrays, got):
        acc, exp = 0, []
        for x in a:
            acc += x
            exp.append(acc)
        assert g == exp


def test_phone_inside_card_and_card_prefix(spark, docs):
    # 19 digits grouped 4-4-4-4-3: the card match stops at 16 digits
    d = D.detect_regex(docs(["card 4111 1111 1111 1111 123 end"]), "text", select_rules(only=["CREDIT_CARD", "PHONE"]))
    spans = d.select(F.explode("cands").alias("s")).select("s.type", "s.text").collect()
    assert ("CREDIT_CARD", "4111 1111 1111 1111") in [(r.type, r.text) for r in spans]


def test_cue_rules(spark, docs):
    t = _types(spark, docs, "Patient MRN 12345 at 10 Main Street. SSN details discussed.", ScanConfig(ruler=True))
    assert {"MRN", "ADDRESS", "SSN_WORD"} & t


def test_prefilter_keeps_results(spark, docs):
    rule = PII_PACK[0]
    assert rule.requires == ("@",)
    d = D.rule_match_rows(docs(["no at sign here", "mail a.b@c.org now"]), rule)
    assert [(r.doc_id, r.text) for r in d.collect()] == [(1, "a.b@c.org")]


ODD = ["٣", "۴", "४", "９", "𝟗", "\u00a0", "\u2009", "\u3000", "\x1c", "ſ", "K", "é", "ß", "İ", "ı", "_", "²", "中", "\u0301", "😀"]


def odd_texts(rule, rng, n):
    """Fixture texts and their pieces with characters swapped for odd ones."""
    seeds = [*ONE_LINERS.values(), *SAMPLE, "2024-01-02", "123456789 987654321", "00:1a:2b:3c:4d:5e", "https://a.example.com/x",
             "aws_secret_access_key = " + "Q" * 40, "ghp_" + "a1" * 20, 'token: "abcdefghijklmnop1"', "12 Main Street", "social ſecurity record"]
    for _ in range(n):
        t = list(rng.choice(seeds) + rng.choice(["", " ", "x"]) + rng.choice(seeds))
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(t))
            t[i] = rng.choice(ODD) if not t[i].isdigit() or rng.random() < .2 else rng.choice("٣۴४９𝟗")
        yield "".join(t)


def test_unicode_rules_match_python(spark, docs):
    """With ``unicode`` every rule finds what Python's Unicode patterns find."""
    rng = random.Random(21)
    flag = {"I": re.I, "M": re.M, "S": re.S}
    from scrubline.operators.rules import as_unicode
    rules = [as_unicode(r) for r in select_rules(minimal=True)]
    rules += [as_unicode(r) for r in D.RULER_RULES if "p{" not in r.regex]
    texts = list(odd_texts(None, rng, 400))
    df = docs(texts).cache()
    for r in rules:
        r = dataclasses.replace(r, validators=())  # what validators reject is told below
        got = {x.doc_id: [(s.start, s.end, s.text) for s in x.c] for x in D.detect_regex(df, rules=[r], out_col="c").collect()}
        rx = re.compile(r.regex, sum(flag[f] for f in r.flags))
        for i, t in enumerate(texts):
            assert got[i] == [(m.start(), m.end(), m.group()) for m in rx.finditer(t)], (r.key, t)


def test_unicode_validators_and_gates(spark, docs):
    texts = ["Visa ٤١١١-١١١١-١١١١-١١١١", "Visa ４１１１ １１１１ １１１１ １１１１", "call ٢٠٢-٥٥٥-٠١٤٧", "IBAN DE８９ 3704 0044 0532 0130 00", "4111\u20091111"]
    types = lambda config: [{s.type for s in r.spans} for r in scan(docs(texts), config=config).orderBy("doc_id").collect()]
    got = types(ScanConfig(unicode=True))
    assert "CREDIT_CARD" in got[0] and "CREDIT_CARD" in got[1] and "PHONE" in got[2] and "IBAN" in got[3]
    assert not any("CREDIT_CARD" in t for t in types(ScanConfig()))


def test_spans_beside_the_gap_mark(spark):
    """Texts that hold the mark the gaps are cut at have the same spans."""
    from scrubline.functions.spans import GAP_MARK, regex_spans
    texts = [f"a1{GAP_MARK}b22", f"{GAP_MARK}33", "x4y55z", "666", "none", "", f"7{GAP_MARK}", "é😀8 " * 50]
    d = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", regex_spans(F.col("t"), r"[0-9]+").alias("s"))
    got = {r.i: [tuple(x) for x in r.s] for r in d.collect()}
    assert got == {i: [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", t)] for i, t in enumerate(texts)}
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan


def test_marked_spans_match_python(spark):
    """Matches and offsets from one pass, in texts that hold the marks themselves too."""
    from scrubline.functions.spans import absent_mark, marked_spans
    texts = ["", "none", "7", "a1 22 b", "\x011\x01", "\x01\x02\x023\x02\x02\x02 4", "\x02\x0256\x01", "é😀12\x01\x02 3" * 40, "9 " * 300, None]
    d = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    t = F.col("t")
    got = {r.i: [tuple(s) for s in r.s] for r in d.select("i", marked_spans(t, F.lit(r"[0-9]+"), absent_mark(t)).alias("s")).collect()}
    assert got == {i: [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", x or "")] for i, x in enumerate(texts)}


def test_a_rule_walks_a_text_once(spark):
    from scrubline.operators.detect import detect_regex
    from scrubline.operators.rules import Rule
    d = spark.createDataFrame([(1, "zq1 and zq22")], "doc_id long, text string")
    x = detect_regex(d, rules=[Rule(key="Z", regex="zq[0-9]+", type="Z")], out_col="c")
    assert [(s.start, s.end, s.text) for s in x.first().c] == [(0, 3, "zq1"), (8, 12, "zq22")]
    assert x._jdf.queryExecution().optimizedPlan().toString().count("zq[0-9]+") == 1
