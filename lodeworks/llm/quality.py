"""Quality rules as a ledger of bits.

`ledger` evaluates every rule once for each row and stores the measurements with one long of failure
bits. Everything after that is arithmetic on the bits: `decide` applies a versioned policy, which is a
mask, and `ablation` counts what each policy would keep without each of its rules, from one aggregate of
the distinct bit patterns (at most 2 ** len(RULES) rows, whatever the input).

All of it is built from Spark's own functions; rows are never shuffled to measure them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import free_name, whole, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims", "n_upper")


def _rule(name: str, test) -> tuple:
    return name, test


#: Bit r of the ledger is rule r. Only ever append: stored ledgers keep their meaning. Integers only.
RULES = (
    _rule("few_words", lambda m: m["n_words"] < 50),
    _rule("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    _rule("symbols", lambda m: 100 * m["n_symbols"] > 10 * m["n_words"]),
    _rule("exclamations", lambda m: 100 * m["n_exclaims"] > 10 * m["n_words"]),
    _rule("shouting", lambda m: 100 * m["n_upper"] > 30 * m["word_chars"]),
    _rule("duplicate_lines", lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    _rule("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    _rule("long_words", lambda m: m["word_chars"] > 15 * m["n_words"]),
)
NAMES = tuple(name for name, _ in RULES)


def mask(*names: str) -> int:
    return sum(1 << NAMES.index(n) for n in names)


#: Version of the policy -> the rules that reject.
POLICIES = {
    1: mask("few_words", "repeated_windows"),
    2: mask(*NAMES),
}
LATEST = max(POLICIES)


def _repeat_words(df: DataFrame, tokens: str) -> DataFrame:
    """Adds n_repeat_words: how many words lie in a 3-word window that occurs twice or more.

    A window is the 64-bit hash of its three words. Only rows where some window does repeat sort them.
    """
    i = F.col(tokens)
    n = F.size(i)
    h, s, d, p = (free_name(df, f"_{x}") for x in ("hash", "sorted", "twice", "at"))
    at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(h, F.transform(at, lambda k: F.xxhash64(F.get(i, k), F.get(i, k + 1), F.get(i, k + 2))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    pairs = F.transform(F.col(h), lambda x, k: F.struct(x.alias("h"), k.alias("i")))
    df = df.withColumn(s, F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(F.sort_array(pairs)))
    same = lambda x, k: F.coalesce(F.get(F.col(s), k)["h"] == x["h"], F.lit(False))
    df = df.withColumn(d, F.filter(F.col(s), lambda x, k: same(x, k - 1) | same(x, k + 1)))
    df = df.withColumn(p, F.sort_array(F.transform(F.col(d), lambda x: x["i"])))
    step = F.transform(F.col(p), lambda x, k: F.least(F.lit(3), F.coalesce(F.get(F.col(p), k + 1) - x, F.lit(3))))
    return df.withColumn("n_repeat_words", F.aggregate(step, F.lit(0), lambda a, x: a + x).cast("long")).drop(h, s, d, p)


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the MEASURES, and fail_bits.

    Columns of df with these names are replaced; others stay. A null or empty text has no words and
    fails few_words; word_chars, symbols and lines are then 0. Repeated rows are measured alike.
    """
    body = whole(text)
    tokens, lines = free_name(df, "_words"), free_name(df, "_lines")
    df = df.drop(*MEASURES, "fail_bits")
    df = df.withColumn(tokens, words(body)).withColumn(lines, F.filter(F.split(body, "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\x0b\f\r"))) > 0))
    df = _repeat_words(df, tokens)
    # One pass keeps what is counted; the counts then run over these few characters.
    marks = free_name(df, "_marks")
    df = df.withColumn(marks, F.regexp_replace(body, r"[^#*$%&|<>!\p{Lu}]+", ""))
    count = lambda keep: F.length(F.regexp_replace(marks, keep, "")).cast("long")
    df = df.withColumns(
        {
            "n_words": F.size(tokens).cast("long"),
            "word_chars": F.length(F.array_join(tokens, "")).cast("long"),
            "n_symbols": count(r"[^#*$%&|<>]+"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_exclaims": count(r"[^!]+"),
            "n_upper": count(r"\P{Lu}+"),
        }
    ).drop(tokens, lines, marks)
    m = {name: F.col(name) for name in MEASURES}
    bits: Column = F.lit(0).cast("long")
    for r, (_, test) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(test(m), F.lit(1 << r)).otherwise(F.lit(0)).cast("long"))
    # A condition on the verdict must not be pushed below the measurements, where it would run them again
    # inside their own lambdas; an expression that isn't deterministic stays where it is.
    return df.withColumn("fail_bits", F.when(F.monotonically_increasing_id() >= 0, bits))


def decide(measured: DataFrame, version: int = LATEST) -> DataFrame:
    """A ledger with base_failed (policy 1 rejects) and kept (the given version, and policy 1, keep)."""
    failed = lambda v: F.col("fail_bits").bitwiseAND(F.lit(POLICIES[v]).cast("long")) != 0
    return measured.withColumn("base_failed", failed(1)).withColumn("kept", ~failed(1) & ~failed(version))


def ablation(measured: DataFrame) -> DataFrame:
    """For each policy and each of its rules: rows, kept, fails (of the rule), and kept_without it.

    The ledger is first summed by bit pattern; an empty ledger gives no rows.
    """
    spark = measured.sparkSession
    patterns = measured.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    grid = [(v, r, name, m) for v, m in POLICIES.items() for r, name in enumerate(NAMES) if m >> r & 1]
    policies = F.broadcast(spark.createDataFrame(grid, "version int, rule int, name string, mask long"))
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    bit = F.expr("shiftleft(1L, rule)")
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    # Each pattern meets each (policy, rule): a fixed number, not a product with the input.
    return (
        patterns.withColumn("version", F.explode(F.array(*[F.lit(v) for v in POLICIES])))
        .join(policies, "version")
        .groupBy("version", "rule", "name")
        .agg(F.sum("n").alias("rows"), total(hit == 0).alias("kept"), total(hit.bitwiseAND(bit) != 0).alias("fails"), total((hit == 0) | (hit == bit)).alias("kept_without"), F.bit_or("fail_bits").alias("any_bits"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = decide(ledger(docs))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, range(3) AS r(o) WHERE c >= 2 GROUP BY doc_id),
m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) AS n_lines,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
             length(regexp_replace(text, '[^!]+', '', 'g')) AS n_exclaims,
             length(regexp_replace(text, '\P{Lu}+', '', 'g')) AS n_upper
      FROM w LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_exclaims > 10 * n_words THEN 8 ELSE 0 END)
             + (CASE WHEN 100 * n_upper > 30 * word_chars THEN 16 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 32 ELSE 0 END)
             + (CASE WHEN word_chars < 2 * n_words THEN 64 ELSE 0 END) + (CASE WHEN word_chars > 15 * n_words THEN 128 ELSE 0 END) AS bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, CAST(bits AS BIGINT) AS fail_bits
FROM b
"""
