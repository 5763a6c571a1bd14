"""Column functions that turn regex matches into character-offset spans.

Offsets are code-point indices (Spark ``length``/``substr`` count code points),
0-based ``start`` and exclusive ``end`` like Python slices.

A rule's matches come from ``regexp_extract_all`` and the text between them
from ``regexp_replace`` and ``split`` with the same pattern; all walk the text
with the same Java ``Matcher.find`` loop, so match *i* starts after gaps
``0..i`` and matches ``0..i-1``.  Gaps are only evaluated for rows that have at
least one match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MATCH_T = T.StructType([
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("text", T.StringType()),
])

CAND_T = T.StructType([
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("det", T.IntegerType()),    # detector rank: regex, model, ruler, external
    T.StructField("rule", T.IntegerType()),   # rule rank inside the detector
    T.StructField("own_action", T.StringType()),  # the detector's own action, NULL = the policy's
])


def no_action() -> Column:
    """``own_action`` of a candidate whose action the policy decides."""
    return F.lit(None).cast("string").alias("own_action")


def empty_array(elem: T.DataType) -> Column:
    return F.array().cast(T.ArrayType(elem))


def let(expr: Column, fn) -> Column:
    """Evaluate ``expr`` once and hand it to ``fn`` as a lambda variable
    (Spark does not share repeated subexpressions inside lambdas)."""
    return F.element_at(F.transform(F.array(expr), fn), 1)


def _scan_small(arr: Column, op) -> Column:
    """Inclusive running ``op`` of a short non-empty int array (one fold)."""
    return F.aggregate(F.slice(arr, F.lit(2), F.size(arr)), F.struct(arr[0].alias("s"), F.array(arr[0]).alias("out")),
                       lambda acc, x: F.struct(op(acc["s"], x).alias("s"), F.concat(acc["out"], F.array(op(acc["s"], x))).alias("out")),
                       lambda acc: acc["out"])


def prefix_scan(values: Column, op, neutral: int) -> Column:
    """Inclusive running ``op`` (associative, ``neutral`` changes nothing) of
    ``array<int>`` in O(n * sqrt(n)).

    The array is cut into blocks of about sqrt(n) elements; each block is
    scanned with a short fold, the block results with another, and every block
    is combined with what stands before it.  A plain fold would copy the
    growing result at every step (O(n^2)), which matters for documents with
    thousands of matches (e.g. word tokens)."""
    def body(arr: Column) -> Column:
        n = F.size(arr)
        b = F.greatest(F.lit(16), F.ceil(F.sqrt(n)).cast("int"))

        def blocked(bs: Column) -> Column:
            nb = F.ceil(n / bs).cast("int")
            blocks = F.transform(F.sequence(F.lit(0), nb - 1), lambda k: F.slice(arr, k * bs + 1, bs))

            def combine(inner: Column) -> Column:
                totals = _scan_small(F.transform(inner, lambda p: F.element_at(p, -1)), op)
                before = F.concat(F.array(F.lit(neutral)), F.slice(totals, F.lit(1), F.size(totals) - 1))
                return F.flatten(F.zip_with(inner, before, lambda p, off: F.transform(p, lambda x: op(x, off))))
            return let(F.transform(blocks, lambda blk: _scan_small(blk, op)), combine)
        return F.when(n <= 1, arr).when(n <= 32, _scan_small(arr, op)).otherwise(let(b, blocked))
    return let(values, body)


def prefix_sums(lens: Column) -> Column:
    """Inclusive running sums."""
    return prefix_scan(lens, lambda a, b: a + b, 0)


def prefix_max(values: Column) -> Column:
    """Inclusive running maxima of non-negative numbers."""
    return prefix_scan(values, lambda a, b: F.greatest(a, b), 0)


def islands(spans: Column) -> Column:
    """Spans in start order as array<array>: a new island begins where a span
    starts at or after every earlier end, so spans of two islands never overlap."""
    def body(arr: Column) -> Column:
        def cut(reach: Column) -> Column:
            first = F.filter(F.sequence(F.lit(1), F.size(arr)),
                             lambda i: (i == 1) | (F.element_at(arr, i)["start"] >= F.element_at(reach, F.greatest(i - 1, F.lit(1)))))
            return let(first, lambda f: F.transform(f, lambda at, k: F.slice(
                arr, at, F.when(k + 1 < F.size(f), F.get(f, k + 1)).otherwise(F.size(arr) + 1) - at)))
        return let(prefix_max(F.transform(arr, lambda x: x["end"])), cut)
    return let(spans, body)


#: Characters per block of a text that is sliced at many places.
TEXT_BLOCK = 1024


def text_blocks(text: Column) -> Column:
    """The text in blocks of ``TEXT_BLOCK`` characters (one pass)."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % TEXT_BLOCK), 0)


def slice_blocks(blocks: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` from the blocks it lies in.  ``substr`` on the text
    itself walks from its beginning each time."""
    first = F.floor(start / TEXT_BLOCK).cast("int")
    count = F.floor((end - 1) / TEXT_BLOCK).cast("int") - first + 1
    part = F.array_join(F.slice(blocks, first + 1, F.greatest(count, F.lit(0))), "")
    return F.when(end <= start, F.lit("")).otherwise(F.substr(part, start - first * TEXT_BLOCK + 1, end - start))


def offsets_from_pieces(matches: Column, gaps: Column) -> Column:
    """array<string> matches + array<string> gaps -> array<MATCH_T>.

    Match *i* ends at the running sum of (gap_i + match_i) lengths."""
    lens = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))
    return F.zip_with(prefix_sums(lens), matches, lambda e, m: F.struct(
        (e - F.length(m)).alias("start"), e.alias("end"), m.alias("text")))


def regex_matches(text: Column, pattern: str) -> Column:
    """All non-overlapping matches of ``pattern`` (Java regex) as array<string>."""
    return F.regexp_extract_all(text, F.lit(pattern), 0)


#: Stands for a match while a text is cut into the gaps between its matches.
GAP_MARK = "\x01"


def gaps(text: Column, pattern: str) -> Column:
    """The text around the matches of ``pattern`` (array<string>).

    ``split`` compiles its pattern for every row, ``regexp_replace`` only once,
    so matches become a mark that ``split`` cuts at without a pattern.  Texts
    that hold the mark themselves are split by the pattern."""
    return F.when(F.contains(text, F.lit(GAP_MARK)), F.split(text, pattern, -1)).otherwise(
        F.split(F.regexp_replace(text, pattern, GAP_MARK), GAP_MARK, -1))


def regex_spans(text: Column, pattern: str, matches: Column | None = None) -> Column:
    """Spans of every non-overlapping match of ``pattern`` in ``text``.

    Pass ``matches`` (an already computed ``regex_matches`` column) to avoid a
    second extraction; the gaps are then taken only where something matched.
    """
    m = matches if matches is not None else regex_matches(text, pattern)
    return F.when(F.size(m) > 0, offsets_from_pieces(m, gaps(text, pattern))) \
        .otherwise(empty_array(MATCH_T))


def absent_mark(text: Column) -> Column:
    """A string that ``text`` does not hold and of which no beginning is also
    an end, so that it is found again wherever it is put between parts of the
    text: ``GAP_MARK``, followed where the text holds that by a longer run of
    another character than any in it."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("\x02+"), 0), lambda r: F.length(r))
    longer = F.repeat(F.lit("\x02"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    return F.when(F.contains(text, F.lit(GAP_MARK)), F.concat(F.lit(GAP_MARK), longer)).otherwise(F.lit(GAP_MARK))


def marked_spans(text: Column, pattern: Column, mark: Column) -> Column:
    """``regex_spans`` in one pass of the pattern: matches are put between
    marks (``absent_mark`` of the text) and the text is cut at these, so that
    its odd pieces are the matches and the even ones the gaps."""
    def spans(pieces: Column) -> Column:
        before = F.length(F.get(pieces, F.lit(0)))
        one = F.array(F.struct(before.alias("start"), (before + F.length(F.get(pieces, F.lit(1)))).alias("end"),
                               F.get(pieces, F.lit(1)).alias("text")))
        lens = F.transform(F.sequence(F.lit(0), F.size(pieces) - 2, F.lit(2)),
                           lambda i: F.length(F.get(pieces, i)) + F.length(F.get(pieces, i + 1)))
        many = F.transform(prefix_sums(lens), lambda e, i: F.struct(
            (e - F.length(F.get(pieces, 2 * i + 1))).alias("start"), e.alias("end"), F.get(pieces, 2 * i + 1).alias("text")))
        return F.when(F.size(pieces) == 3, one).otherwise(many)
    return let(F.regexp_replace(text, pattern, F.concat(mark, F.lit("$0"), mark)), lambda marked: F.when(
        F.contains(marked, mark), let(F.split(marked, mark, -1), spans)).otherwise(empty_array(MATCH_T)))


def explode_rows(df, array_col: Column, keys: list, alias: str = "s", with_pos: bool = False):
    """Explode ``array_col`` into rows, dropping rows whose array is empty.

    Uses the *outer* generator and filters on its output: a plain
    ``explode`` makes the optimizer infer ``size(array) > 0`` and push that
    predicate below the projections that compute the array, which inlines
    (and so repeats) all the regex and fold work inside the filter.
    """
    if with_pos:
        x = df.select(*keys, F.posexplode_outer(array_col).alias("idx", alias))
    else:
        x = df.select(*keys, F.explode_outer(array_col).alias(alias))
    return x.where(F.col(alias).isNotNull())


def filter_computed(df, cond: Column, cols: list):
    """Rows where ``cond`` holds, projected to ``cols``, without letting the
    optimizer push ``cond`` (and the expressions it depends on) below the
    projection that computes them."""
    packed = F.when(cond, F.array(F.struct(*cols)))
    return df.select(F.explode_outer(packed).alias("__r")).where(F.col("__r").isNotNull()).select("__r.*")
