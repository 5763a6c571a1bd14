"""Table sources.

Readers select only the columns a plan needs so the parquet scan prunes the
rest.  The ``*_sql`` helpers hold expressions shared verbatim by Spark and by
the DuckDB oracle (both accept the same syntax for them), so stand-in inputs
are byte-identical in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import deal

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def documents(spark: SparkSession, sf_dir: str, extra: list[str] | None = None) -> DataFrame:
    """S3: ``(doc_id, text)`` from the documents table."""
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"] + list(extra or []))


# HTML character references decoded before matching, in the
# order applied (``&amp;`` last so "&amp;quot;" decodes once, to "&quot;").
HTML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"),
                 ("&apos;", "'"), ("&amp;", "&")]


def html_unescape_sql(col: str) -> str:
    expr = col
    for ent, ch in HTML_ENTITIES:
        lit = ch.replace("'", "''")
        expr = f"replace({expr}, '{ent}', '{lit}')"
    return expr


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as ``(doc_id, text)``: the raw HTML with character
    references decoded, so quoted secrets match as in plain text."""
    return read_table(spark, sf_dir, "pages", ["page_id", "html"]).selectExpr(
        "page_id AS doc_id", f"{html_unescape_sql('html')} AS text")


# A user turn as a redaction prompt: its text and, chosen by its key, one of
# these requests, since the turns themselves hardly ask for anything.
PROMPT_SUFFIX_SQL = (
    "CASE (conv_id * 7 + turn) % 9 WHEN 0 THEN ' Redact everything except phone numbers.' "
    "WHEN 1 THEN ' Keep emails but only mask names.' WHEN 2 THEN ' Do not redact names or locations.' "
    "WHEN 3 THEN ' Only emails.' WHEN 4 THEN ' Redact all.' WHEN 5 THEN ' Mask credit cards and phone numbers.' "
    "WHEN 6 THEN ' Redact names but not emails.' ELSE '' END"
)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user turns of ``conversations`` (a prompt is what a user writes)."""
    return (read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
            .where(F.col("role") == "user")
            .selectExpr("conv_id", "turn", f"coalesce(text, '') || {PROMPT_SUFFIX_SQL} AS prompt"))


# Stand-in text for rules the corpus never triggers (SSN, IBAN, dates, MAC,
# IPv6, URLs, passports, street addresses, cue words): one record per
# customer, every value derived from the customer key by the expressions
# below.  The detectors know nothing about how these strings are made.
CUSTOMER_RECORD_SQL = (
    "c_custkey AS doc_id, "
    "c_name || ' from ' || n_name || '. SSN '"
    " || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '-'"
    " || lpad(CAST((c_custkey * 7) % 100 AS STRING), 2, '0') || '-'"
    " || lpad(CAST((c_custkey * 13) % 10000 AS STRING), 4, '0')"
    " || '. IBAN DE' || lpad(CAST(c_custkey % 97 AS STRING), 2, '0')"
    " || ' ' || lpad(CAST((c_custkey * 7919) % 10000 AS STRING), 4, '0')"
    " || ' ' || lpad(CAST((c_custkey * 104729) % 10000 AS STRING), 4, '0')"
    " || ' ' || lpad(CAST((c_custkey * 31) % 10000 AS STRING), 4, '0')"
    " || ' ' || lpad(CAST((c_custkey * 17) % 10000 AS STRING), 4, '0')"
    " || ' ' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0')"
    " || '. Card 4' || lpad(CAST((c_custkey * 7919 + 12345) % 1000 AS STRING), 3, '0')"
    " || '-' || lpad(CAST((c_custkey * 31) % 10000 AS STRING), 4, '0')"
    " || '-' || lpad(CAST((c_custkey * 17) % 10000 AS STRING), 4, '0')"
    " || '-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')"
    " || '. Born ' || CAST(1950 + c_custkey % 70 AS STRING)"
    " || '-' || lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0')"
    " || '-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0')"
    " || '. Device ' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') || ':1a:2b:'"
    " || lpad(CAST((c_custkey * 3) % 100 AS STRING), 2, '0') || ':4d:'"
    " || lpad(CAST((c_custkey * 7) % 100 AS STRING), 2, '0')"
    " || ' / 2001:0db8:' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')"
    " || ':0000:0000:8a2e:0370:' || lpad(CAST((c_custkey * 31) % 10000 AS STRING), 4, '0')"
    " || '. Profile https://portal.example.com/u/' || CAST(c_custkey AS STRING)"
    " || ' . Passport ' || lpad(CAST((c_custkey * 7919) % 1000000000 AS STRING), 9, '0')"
    " || '. ' || CAST(100 + c_custkey % 900 AS STRING) || ' Main Street, medical record on file.'"
    " || ' Contact customer' || CAST(c_custkey AS STRING) || '@example.org or +1 ('"
    " || CAST(200 + c_custkey % 800 AS STRING) || ') 555-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')"
    " || ', server ' || CAST(10 + c_custkey % 240 AS STRING) || '.' || CAST(c_custkey % 256 AS STRING)"
    " || '.0.' || CAST((c_custkey * 7) % 256 AS STRING) || '.'"
    " || CASE c_custkey % 4 WHEN 0 THEN ' Key AKIA' || lpad(CAST(c_custkey AS STRING), 16, '0') || '.'"
    " WHEN 1 THEN ' ghp_' || lpad(CAST(c_custkey * 7919 AS STRING), 36, 'a') || ' ok.'"
    " WHEN 2 THEN ' aws_secret_access_key = ' || lpad(CAST(c_custkey AS STRING), 40, 'Q') || ' end.' ELSE '' END AS text"
)
CUSTOMER_RECORD_FROM = "customer JOIN nation ON c_nationkey = n_nationkey"
#: Bytes of the customer table per task: some ten thousand customers, whose
#: texts are fifty times as large.
CUSTOMER_TASK_BYTES = 1 << 16


def customers(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """Customers dealt over the cluster, to be made into texts."""
    return deal(read_table(spark, sf_dir, "customer", columns), CUSTOMER_TASK_BYTES)


def customer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = customers(spark, sf_dir, ["c_custkey", "c_name", "c_nationkey"])
    # nation is the fixed 25-row dimension: a broadcast with a proven bound.
    nation = F.broadcast(read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"]))
    return cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        *_split_select(CUSTOMER_RECORD_SQL))


def _split_select(sql: str) -> list[str]:
    # "a AS x, <expr> AS text" -> two select expressions
    head, rest = sql.split(", ", 1)
    return [head, rest]


# Job log stand-in derived from ``events`` (one request per event).
JOBS_SQL = (
    "event_id AS job_id, user_id, ts AS created_at, "
    "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, "
    "event_type = 'view' AS preview_only, "
    "CASE WHEN event_id % 89 = 3 THEN NULL ELSE CASE CAST(get_json_object(props, '$.k') AS INT) % 7 "
    "WHEN 0 THEN 'txt' WHEN 1 THEN 'pdf' WHEN 2 THEN 'docx' WHEN 3 THEN 'png' "
    "WHEN 4 THEN 'jpg' WHEN 5 THEN 'xlsx' ELSE 'xyz' END END AS file_type, "
    "CASE WHEN event_id % 97 = 5 THEN NULL ELSE CAST(floor(value * 262144) AS BIGINT) END AS file_size_bytes, "
    "CAST(floor(value) AS BIGINT) AS entities_detected, "
    "value / 10.0 AS processing_time_seconds"
)

# Users: most user ids of the log (the others stay unknown) and some customers
# that never made a request; tier from the id.  An unknown tier ('TRIAL')
# exercises the fallback to FREE limits, every tenth user has a limit of its own.
USERS_SQL = (
    "user_id, CASE user_id % 4 WHEN 0 THEN 'FREE' WHEN 1 THEN 'PAID' WHEN 2 THEN 'ENTERPRISE' "
    "ELSE 'TRIAL' END AS tier, CASE WHEN user_id % 10 = 3 THEN 2 END AS monthly_limit"
)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    return ev.selectExpr(*[s.strip() for s in _split_top(JOBS_SQL)])


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = read_table(spark, sf_dir, "events", ["user_id"]).where("user_id % 50 <> 7").distinct()
    idle = read_table(spark, sf_dir, "customer", ["c_custkey"]).where("c_custkey % 20 = 0").selectExpr("c_custkey + 100000000 AS user_id")
    return seen.union(idle).selectExpr(*[s.strip() for s in _split_top(USERS_SQL)])


def _split_top(sql: str) -> list[str]:
    """Split a select list on top-level commas (outside parentheses/quotes)."""
    out, depth, cur, q = [], 0, [], False
    for ch in sql:
        if ch == "'":
            q = not q
        elif not q and ch == "(":
            depth += 1
        elif not q and ch == ")":
            depth -= 1
        if ch == "," and depth == 0 and not q:
            out.append("".join(cur))
            cur = []
        else:
            cur.append(ch)
    if cur:
        out.append("".join(cur))
    return out


# Stand-in external-detector responses: per document, its distinct
# capitalised words of eight or more letters (sorted), each written as an
# entity in one of three shapes chosen by the document key, plus a two-word
# value, a value absent from every text, an entity without text and a cut-off
# response on some keys.  The same string is built by the oracle SQL.
STANDIN_WORD_RE = r"\p{Lu}\p{Ll}{7,}"


def standin_responses(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.col(text_col), "[ \n]+", -1),
                                                   lambda w: w.rlike("^" + STANDIN_WORD_RE + "$"))))
    k = F.col(key)
    item = lambda w: (F.when(k % 3 == 0, F.concat(F.lit('{"text": "'), w, F.lit('", "type": "PERSON", "confidence": 0.9}')))
                      .when(k % 3 == 1, F.concat(F.lit('{"text": "'), F.lower(w), F.lit('", "type": "ORG"}')))
                      .otherwise(F.concat(F.lit('{"text": "'), w,
                                          F.lit('", "type": "LOC", "action": "none", "confidence": "0.7"}'))))
    df = df.withColumn("__w", words)
    w = F.col("__w")
    items = F.transform(w, item)
    items = F.when((k % 3 == 2) & (F.size(w) >= 2), F.concat(items, F.array(F.concat(
        F.lit('{"text": "'), F.element_at(w, 1), F.lit(" and "), F.element_at(w, -1), F.lit('", "type": "PERSON"}'))))
    ).otherwise(items)
    items = F.when(k % 5 == 0, F.concat(items, F.array(F.lit('{"text": "Nowhere Toooo", "type": "ORG"}')))).otherwise(items)
    items = F.when(k % 11 == 5, F.concat(items, F.array(F.lit('{"type": "ORG"}')))).otherwise(items)
    js = F.concat(F.lit('{"entities": ['), F.array_join(items, ", "),
                  F.lit('], "reasoning": "stand-in", "confidence": "high"}'))
    js = F.when(k % 7 == 3, F.substr(js, F.lit(1), F.length(js) - 2)).otherwise(js)
    return df.withColumn("response", js).drop("__w")
