"""Quality rules over whole texts and over the lines that many documents of a host share.

Everything is a DataFrame expression. A word is a run of other characters than blank, tab, newline,
vertical tab, form feed and return. The rules of a text alone:

* word_chars: code points in words; n_symbols: characters of `#*$%&|<>`;
* n_dup_lines: lines with a word that equal an earlier line of the text;
* n_repeat_words: words in three-word windows that occur twice or more in the text;
* base_failed: fewer than `min_words` words, or more than half of them repeated that way.

The rule across documents: a line, normalised in case and white space, that stands in more than
`max_documents` documents of one host is removed from all of them, and a document that loses more
than half of its words so is rejected.

A null text counts as empty, which fails the base rules; a null host is a host of its own. Rows
with the same id and text share their lines and their verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BREAK = r"[\x20\x09-\x0D]+"
_SYMBOL = r"[#*$%&|<>]"
_SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BREAK))


def text_rules(rows: DataFrame, min_words: int = 50) -> DataFrame:
    """`rows` (with a `text`) and the figures of each text alone."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # Each step binds its value as the element of a one-element array, so that it is computed once.
    # A three-word window is known by a hash; its position sits in the low bits of the sort key.
    repeats = (
        "transform(array(size(ws)), n -> transform(array(greatest(int(ceil(log2(n + 1))), 1)), bits ->"
        " transform(array(transform(slice(ws, 1, greatest(n - 2, 0)), (w, i) -> xxhash64(w, ws[i + 1], ws[i + 2]))), hs ->"
        " transform(array(transform(sort_array(transform(hs, (h, i) -> shiftleft(h, bits) | bigint(i))),"
        " k -> int(k & (shiftleft(1L, bits) - 1)))), at ->"
        " transform(array(sort_array(filter(at, (p, i) -> (i > 0 AND hs[at[i - 1]] = hs[p])"
        " OR (i + 1 < size(at) AND hs[at[i + 1]] = hs[p])))), ps ->"
        " aggregate(transform(ps, (p, i) -> if(i + 1 < size(ps), least(3, ps[i + 1] - p), 3)), 0L, (a, x) -> a + x)"
        ")[0])[0])[0])[0])[0]"
    )
    figures = (
        "transform(array(words), ws -> struct(bigint(size(ws)) AS n_words, bigint(char_length(array_join(ws, ''))) AS word_chars,"
        f" {repeats} AS n_repeat_words))[0]"
    )
    found = rows.withColumns({"words": words_of(F.col("text")), "lines": lines})
    found = found.withColumn("figures", F.expr(figures)).withColumns(
        {
            "n_words": F.col("figures.n_words"),
            "word_chars": F.col("figures.word_chars"),
            "n_repeat_words": F.col("figures.n_repeat_words"),
            "n_symbols": F.regexp_count("text", F.lit(_SYMBOL)).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        }
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select(*rows.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def _identified(docs: DataFrame, host: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        text.alias("text"),
    )


def lines_of(docs: DataFrame, host: str = "source") -> DataFrame:
    """Distinct normalised lines of each document: doc_id, text_key, host, line (hash), line_words."""
    plain = F.lower(F.regexp_replace(F.btrim("raw", F.lit(_SPACES)), _BREAK, " "))
    raw = _identified(docs, host).select("doc_id", F.xxhash64("text").alias("text_key"), "host", F.explode(F.split("text", "\n")).alias("raw"))
    lines = raw.withColumn("plain", plain).where("plain != ''")
    found = lines.select(
        "doc_id", "text_key", "host", F.xxhash64("plain").alias("line"), F.size(F.split("plain", " ")).cast("long").alias("line_words")
    )
    return found.groupBy("doc_id", "text_key", "host", "line").agg(F.sum("line_words").alias("line_words"))


def frequent_lines(lines: DataFrame, max_documents: int) -> DataFrame:
    """Lines (host, line) that stand in more than `max_documents` documents of their host."""
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > max_documents).select("host", "line")


def apply_rules(docs: DataFrame, host: str = "source", min_words: int = 50, max_documents: int = 50) -> DataFrame:
    """Per document: doc_id, the figures of its text, base_failed, n_removed_words and kept."""
    lines = lines_of(docs, host)
    removed = lines.join(frequent_lines(lines, max_documents).withColumn("frequent", F.lit(True)), ["host", "line"], "left")
    spent = F.sum(F.when(F.col("frequent"), F.col("line_words")).otherwise(0))
    verdicts = removed.groupBy("doc_id", "text_key").agg(
        (2 * spent > F.sum("line_words")).alias("depleted"), (spent / F.sum("line_words")).alias("share")
    )
    verdicts = verdicts.where("share > 0")
    base = text_rules(_identified(docs, host).withColumn("text_key", F.xxhash64("text")), min_words).drop("text", "host")
    joined = base.join(verdicts, ["doc_id", "text_key"], "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.round(F.coalesce("share", F.lit(0.0)) * F.col("n_words")).cast("long").alias("n_removed_words"),
        (~F.col("base_failed") & ~F.coalesce("depleted", F.lit(False))).alias("kept"),
    )


def cleaned_texts(docs: DataFrame, host: str = "source", min_words: int = 50, max_documents: int = 50) -> DataFrame:
    """Kept documents without their frequent lines: doc_id and text, all other lines unchanged."""
    lines = lines_of(docs, host)
    bad = lines.join(frequent_lines(lines, max_documents), ["host", "line"]).groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("bad"))
    kept = apply_rules(docs, host, min_words, max_documents).where("kept").select("doc_id").distinct()
    rows = _identified(docs, host).withColumn("text_key", F.xxhash64("text")).join(kept, "doc_id", "left_semi")
    rows = rows.join(bad, ["doc_id", "text_key"], "left")
    plain = lambda x: F.lower(F.regexp_replace(F.btrim(x, F.lit(_SPACES)), _BREAK, " "))
    left = F.filter(F.split("text", "\n"), lambda x: F.col("bad").isNull() | ~F.array_contains("bad", F.xxhash64(plain(x))))
    return rows.select("doc_id", F.array_join(left, "\n").alias("text"))


#: The same result for DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS raw FROM d),
p AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM p),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, least(3, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 3)) AS n FROM r),
rep AS (SELECT doc_id, sum(n) AS n_repeat_words FROM c GROUP BY doc_id),
l0 AS (SELECT doc_id, host, unnest(raw) AS line FROM w),
l1 AS (SELECT doc_id, host, line, lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')) AS plain,
       len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l0),
l2 AS (SELECT * FROM l1 WHERE n > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l2 GROUP BY doc_id),
f AS (SELECT host, plain FROM l2 GROUP BY host, plain HAVING count(DISTINCT doc_id) > 50),
v AS (SELECT doc_id, sum(CASE WHEN f.plain IS NULL THEN 0 ELSE n END) AS spent, sum(n) AS total
      FROM l2 LEFT JOIN f USING (host, plain) GROUP BY doc_id),
b AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
      len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(spent, 0) AS spent, coalesce(total, 0) AS total
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN v USING (doc_id)),
e AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       CAST(spent AS BIGINT) AS n_removed_words, NOT base_failed AND 2 * spent <= total AS kept
FROM e
"""
