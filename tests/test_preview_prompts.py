"""Exact preview strings and prompt parsing cases."""
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.functions.spans import CAND_T
from scrubline.operators import prompts as P
from scrubline.operators.preview import chunk_text, cost_estimate
from scrubline.operators.rewrite import preview_blocks, wrap_fixed


def _preview(spark, text, spans, width=None):
    rows = [(text, [(a, b, text[a:b], "X", 1.0, 0, i, None) for i, (a, b) in enumerate(spans)])]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("t", T.StringType()),
                                                   T.StructField("s", T.ArrayType(CAND_T))]))
    c = preview_blocks(F.col("t"), F.col("s"))
    if width:
        c = wrap_fixed(c, width)
    return df.select(c.alias("p")).first().p


def test_preview_exact(spark):
    assert _preview(spark, "Hello John, how are you?", [(6, 10)]) == "Hello ████, how are you?"
    assert (_preview(spark, "Call John at 555-1234 or email john@example.com", [(5, 9), (13, 21), (31, 47)])
            == "Call ████ at ████████ or email ████████████████")
    assert _preview(spark, "John Smith works here", [(0, 4), (0, 10)]) == "████" + "█" * 10 + " works here"


def test_wrap(spark):
    p = _preview(spark, "A" * 100, [(10, 20)], width=50)
    lines = p.split("\n")
    assert len(lines) == 2 and all(len(x) <= 50 for x in lines)


def _parse(spark, prompt):
    df = spark.createDataFrame([(prompt,)], "prompt string")
    r = P.parse_prompts(df).first()
    return dict(r.entity_actions or {}), r.redact_all_default


def test_prompt_cases(spark):
    ea, d = _parse(spark, "only redact SSN and phone numbers")
    assert not d and ea["SSN"] == "mask" and "PHONE" in ea
    ea, d = _parse(spark, "don't redact my name, only SSN and phone")
    assert ea["PERSON"] == "none" and ea["SSN"] == "mask" and not d
    ea, d = _parse(spark, "redact all personal information except dates")
    assert d and ea.get("DATE", "none") == "none"
    for p in ["redact everything", "hide all sensitive data", "", "   "]:
        assert _parse(spark, p)[1]
    ea, _ = _parse(spark, "hide all email addresses")
    assert "EMAIL" in ea
    ea, _ = _parse(spark, "names and emails")
    assert {"PERSON", "EMAIL"} <= set(ea)


def test_prompt_policy_and_analysis(spark):
    df = P.parse_prompts(spark.createDataFrame([("only redact SSN and phone numbers",), ("",)], "prompt string"))
    rows = df.select(P.apply_request(F.col("entity_actions"), F.col("redact_all_default")).alias("pol"),
                     P.analyze_prompt(F.col("entity_actions"), F.col("prompt")).alias("a")).collect()
    assert rows[0].pol["SSN"] == "mask" and rows[0].pol["EMAIL"] == "mask"   # base policy still stands
    assert rows[0].a.confidence == "high" and "SSN" in rows[0].a.to_redact
    assert rows[1].pol["PERSON"] == "mask" and rows[1].a.to_redact == []


def test_chunks_and_cost(spark):
    df = spark.createDataFrame([("x" * 4500,), ("",)], "t string")
    r = df.select(chunk_text(F.col("t")).alias("c"), cost_estimate(F.col("t")).alias("cost")).collect()
    assert [c.chunk_start for c in r[0].c] == [0, 1800, 3600]
    assert len(r[0].c[0].chunk_text) == 2000 and r[1].c == []
    assert 0 < r[0].cost < 1.0


def test_prompt_optional_modes(spark):
    df = spark.createDataFrame([("please remove the description of the phone",)], "prompt string")
    plain = P.parse_prompts(df).first()
    strict = P.parse_prompts(df, word_boundary=True, verb_aware=True).first()
    assert "IP" in plain.mentioned                 # "ip" inside "description"
    assert "IP" not in strict.mentioned and strict.entity_actions["PHONE"] == "drop"


def test_strict_mode(spark):
    df = P.parse_prompts(spark.createDataFrame([("only redact SSN",)], "prompt string"))
    r = df.select(P.apply_request(F.col("entity_actions"), F.col("redact_all_default")).alias("a"),
                  P.apply_request(F.col("entity_actions"), F.col("redact_all_default"), strict=True).alias("b")).first()
    assert r.a["EMAIL"] == "mask" and r.b["EMAIL"] == "none" and r.b["SSN"] == "mask"


def test_chunks_own_matches_shorter_than_an_overlap(spark):
    """Every match that some window holds whole counts once, cut pieces never."""
    from scrubline.operators.preview import owned_by_chunk
    matches = [(s, n) for s in range(1690, 2110) for n in (1, 99, 100, 101, 110, 160, 199)]
    found = []
    for s, n in matches:
        for w in (0, 1800, 3600):
            a, b = max(s - w, 0), min(s + n - w, 2000)
            if a < b:
                found.append((s, n, w, a, b, b - a == n))
    df = spark.createDataFrame(found, "s int, n int, w int, a int, b int, whole boolean")
    own = df.where(owned_by_chunk(F.col("a"), F.col("b"), F.col("w"), F.lit(5000))).collect()
    assert all(r["whole"] for r in own)
    assert sorted((r["s"], r["n"]) for r in own) == sorted(matches)


def test_windows_take_the_length_of_their_text_once(spark):
    """A length in the windows' own expression would walk the whole text for each of them."""
    plan = str(spark.range(1).selectExpr("string(id) AS t").select(chunk_text(F.col("t")).alias("c"))._jdf.queryExecution().analyzed().toString())
    assert plan.count("length(") == 1
    assert [tuple(c) for c in spark.range(1).select(chunk_text(F.lit("abcde"), 3, 1)).first()[0]] == [(0, 0, "abc"), (1, 2, "cde"), (2, 4, "e")]
    assert spark.range(1).select(chunk_text(F.lit("")), chunk_text(F.lit(None).cast("string"))).first()[:] == ([], [])
