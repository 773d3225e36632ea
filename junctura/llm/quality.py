"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each text: the ledger holds the measurements and one failure bit for each rule. A policy is a
version with a mask of the rules that it applies, so verdicts under any policy, and what each rule alone decides, are bitwise
work on the ledger and need no second pass over the texts.

Defined cases: a null text has no words, like an empty one; repeated rows each get a row; very long texts are measured whole; other columns are ignored; an empty
table gives an empty ledger.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ship, table

#: Measurements, all whole numbers.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_chars", "n_repeat_words", "n_distinct_words", "n_upper_words", "n_alpha_words")
#: Rules in the order of their bits; each is an SQL condition over the measurements under which a text fails.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_words": "n_words > 100000",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_lines > 3 and 10 * n_dup_lines > 5 * n_lines",
    "repeated_line_text": "n_lines > 3 and 10 * dup_line_chars > 3 * n_chars",
    "capitals": "2 * n_upper_words > n_words and n_words > 0",
    "not_words": "10 * n_alpha_words < 7 * n_words",
    "poor_vocabulary": "n_words > 100 and 100 * n_distinct_words < 10 * n_words",
}
#: Versions of policies: the rules that each applies.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(RULES),
    "lenient": ("few_words", "repeated_windows", "symbols", "capitals"),
}
_SYMBOLS = frozenset(b"#*$%&|<>")
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in _SYMBOLS)
_BREAKS = " \t\n\v\f\r"
_MARKS = b"\"'()[]{}.,;:!?-#*$%&<>"


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, _BREAKS))
    n_symbols = len(raw.translate(None, _NOT_SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = dup_chars = 0
    if len(lines) > 1:
        seen: set[bytes] = set()
        for x in lines:
            if x in seen:
                dup_lines += 1
                dup_chars += len(x.decode("utf-8", "surrogatepass"))
            seen.add(x)
    repeat = 0
    counts = Counter(words)
    if n > 3:
        # A window can only come twice if each of its words does.
        once = {w for w, k in counts.items() if k == 1}
        windows: dict[tuple[bytes, bytes, bytes], int] = {}
        covered: set[int] = set()
        for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)):
            if w[0] in once or w[1] in once or w[2] in once:
                continue
            first = windows.setdefault(w, i)
            if first != i:
                covered.update((first, first + 1, first + 2, i, i + 1, i + 2))
        repeat = len(covered)
    upper = alpha = 0
    for w, k in counts.items():
        bare = w.strip(_MARKS)
        if bare.isalpha():
            alpha += k
            if len(bare) > 1 and bare.isupper():
                upper += k
        elif bare and not bare.isascii():
            s = bare.decode("utf-8", "surrogatepass")
            if s.isalpha():
                alpha += k
                if len(s) > 1 and s.isupper():
                    upper += k
    return n, word_chars, n_symbols, len(lines), dup_lines, dup_chars, len(text), repeat, len(counts), upper, alpha


def bits(measured: DataFrame) -> DataFrame:
    """Adds fail_bits: bit i is set if rule i fails."""
    terms = [f"if({test}, {1 << i}L, 0L)" for i, test in enumerate(RULES.values())]
    return measured.withColumn("fail_bits", F.expr(" | ".join(terms)))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, the measurements and fail_bits."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            rows = [measure(texts[i].as_py()) for i in range(len(texts))]
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", *MEASURES])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return bits(rows.mapInArrow(lean(run), "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)))


def mask(policy: str | tuple[str, ...]) -> int:
    rules = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(1 << list(RULES).index(r) for r in rules)


def kept(policy: str | tuple[str, ...] = "v1"):
    """A column: whether a ledger row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(ledger_rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: texts that fail it, texts that fail it alone, and texts kept without it. One aggregation."""
    whole = mask(policy)
    failed = F.col("fail_bits").bitwiseAND(F.lit(whole))
    each = []
    for r in POLICIES[policy]:
        one = mask((r,))
        each.append(F.struct(F.lit(r).alias("rule"), F.count_if(failed.bitwiseAND(F.lit(one)) != 0).alias("n_failed"), F.count_if(failed == one).alias("n_failed_alone"), F.count_if(failed.bitwiseAND(F.lit(whole & ~one)) == 0).alias("n_kept_without")))
    return ledger_rows.agg(F.array(*each).alias("each")).select(F.explode("each").alias("e")).select("e.*", F.lit(policy).alias("policy"))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents"))
    base = (~kept("base")).alias("base_failed")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base, kept("v1").alias("kept"), "fail_bits")


_SQL_MEASURES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
dl AS (SELECT doc_id, sum(n - 1)::BIGINT AS n_dup_lines, sum((n - 1) * length(x))::BIGINT AS dup_line_chars
       FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(ls) AS x FROM l) GROUP BY ALL) GROUP BY doc_id),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
      FROM (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(w[:len(w) - 2]) AS a, unnest(w[2:len(w) - 1]) AS b, unnest(w[3:]) AS c FROM d WHERE len(w) > 2)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, range(3) t(k) WHERE n > 1 GROUP BY doc_id),
v AS (SELECT doc_id, count(*) AS n_distinct_words, sum(n) FILTER (regexp_full_match(bare, '\p{L}+')) AS n_alpha_words,
        sum(n) FILTER (regexp_full_match(bare, '\p{L}{2,}') AND upper(bare) = bare AND lower(bare) <> bare) AS n_upper_words
      FROM (SELECT doc_id, x, count(*) AS n, regexp_replace(x, '^["''()\[\]{}.,;:!?#*$%&<>-]+|["''()\[\]{}.,;:!?#*$%&<>-]+$', '', 'g') AS bare
            FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY ALL) GROUP BY doc_id),
m AS (SELECT l.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        len(ls)::BIGINT AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(dup_line_chars, 0) AS dup_line_chars, length(text)::BIGINT AS n_chars,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_distinct_words, 0)::BIGINT AS n_distinct_words,
        coalesce(n_upper_words, 0)::BIGINT AS n_upper_words, coalesce(n_alpha_words, 0)::BIGINT AS n_alpha_words
      FROM l LEFT JOIN dl USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN v USING (doc_id))
"""
SQL = (
    _SQL_MEASURES
    + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & "
    + str(mask("base"))
    + ") <> 0 AS base_failed, bits = 0 AS kept, bits AS fail_bits FROM (SELECT *, ("
    + " | ".join(f"(CASE WHEN {test} THEN {1 << i} ELSE 0 END)" for i, test in enumerate(RULES.values()))
    + ")::BIGINT AS bits FROM m)"
)
