"""Quality rules: per-document counts and cross-document line frequency.

Everything is built-in expressions.  A document is read once for its counts and the
hashes of its normalised lines; lines are counted per host in distinct documents, and
only those above the limit meet the documents' lines again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import WORD, array_total, with_text, words_of
from siftline.session import cut_lineage

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A line goes if it stands in more than this many distinct texts of its host.
MAX_DOCS = 20
#: A document is rejected if more than this share of its letters went.
MAX_REMOVED = 0.5
KEY = ["host", "text_hash", "text_check"]


def _key(host: Column, text: Column) -> list[Column]:
    """A text and its host as three numbers; null and empty texts are the same, and so are hosts."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(F.coalesce(host, F.lit(""))).alias("host"), F.xxhash64(whole).alias("text_hash"), F.hash(whole).alias("text_check")]


def line_hashes(lines: Column) -> Column:
    """Per line, hash and length of its normal form; the hash is null for lines without letters.

    The normal form is lower case with runs of white space, digits and signs as one space;
    its length leaves out the spaces.
    """
    plain = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.lower(x), "[\\s\\p{Punct}\\d]+", " ")))
    return F.transform(plain, lambda x: F.struct(
        F.when(x != "", F.xxhash64(x)).alias("line"), F.char_length(F.replace(x, F.lit(" "), F.lit(""))).cast("long").alias("chars"),
    ))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words in windows that occur twice or more in the text."""
    df = df.withColumn("_w", F.transform("_words", lambda w: F.xxhash64(w)))
    windows = F.transform("_w", lambda w, i: F.xxhash64(w, *(F.get("_w", i + k) for k in range(1, WINDOW))))
    df = df.withColumn("_h", F.slice(windows, F.lit(1), F.greatest(F.lit(0), F.size("_w") - WINDOW + 1)))
    df = df.withColumn("_s", F.when(
        F.size(F.array_distinct("_h")) < F.size("_h"),
        F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ))
    df = df.withColumn("_p", F.sort_array(F.transform(
        F.filter("_s", lambda s, i: (F.get("_s", i - 1)["h"] == s["h"]) | (F.get("_s", i + 1)["h"] == s["h"])), lambda s: s["i"]
    )))
    covered = F.transform("_p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", i + 1) - p, F.lit(WINDOW))))
    return df.withColumn("n_repeat_words", F.coalesce(array_total(covered), F.lit(0).cast("long")))


def document_counts(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One narrow row per document: its key, its counts, and hash and size of its lines."""
    whole = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.col(doc_id).alias("doc_id"), *_key(F.col(host), F.col(text)), whole.alias("_text"))
    df = df.withColumn("_words", words_of(F.col("_text")))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)))
    df = _repeat_words(df)
    n_words = F.size("_words").cast("long")
    df = df.select(
        "doc_id", *KEY, n_words.alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.regexp_replace("_text", f"[{SYMBOLS}]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        line_hashes(F.col("_lines")).alias("lines"),
    )
    df = df.withColumn("line_chars", array_total(F.transform("lines", lambda x: x["chars"])))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return df.withColumn("base_failed", failed)


def frequent_lines(counts: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, line, n_docs) of the lines above the limit.

    Documents are counted by distinct text, so copies of one text count once.  The rows
    of a common line meet in partial counts.
    """
    lines = counts.select("host", "text_hash", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    found = lines.where("line is not null").groupBy("host", "line").agg(F.count_distinct("text_hash").alias("n_docs"))
    return found.where(F.col("n_docs") > max_docs)


def removed_lines(counts: DataFrame, frequent: DataFrame) -> DataFrame:
    """Per distinct text of a host: its removed line hashes, their number and characters."""
    lines = counts.dropDuplicates(KEY).select(*KEY, F.explode("lines").alias("x")).select(*KEY, "x.line", "x.chars")
    return lines.join(frequent.select("host", "line"), ["host", "line"]).groupBy(*KEY).agg(
        F.collect_set("line").alias("removed"), F.count("*").alias("n_removed_lines"), F.sum("chars").alias("n_removed_chars"),
    )


def quality_rules(
    docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id",
    max_docs: int = MAX_DOCS, max_removed: float = MAX_REMOVED,
) -> DataFrame:
    """One row per document with its counts, ``base_failed`` and ``kept``.

    A document is kept if it passes the base rule and at most ``max_removed`` of its letters
    are in lines above the limit.  Null texts count as empty and fail the base
    rule; null and empty hosts form one host; repeated rows get equal verdicts; other columns of
    ``docs`` are not read.  An empty table gives an empty result.
    """
    counts = cut_lineage(document_counts(docs, text, host, doc_id), "line-counts")
    gone = removed_lines(counts, frequent_lines(counts, max_docs))
    df = counts.drop("lines").join(gone, KEY, "left").withColumns({
        "n_removed_lines": F.coalesce("n_removed_lines", F.lit(0).cast("long")),
        "n_removed_chars": F.coalesce("n_removed_chars", F.lit(0).cast("long")),
    })
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("n_removed_chars") <= F.col("line_chars") * max_removed))


def apply_quality_rules(docs: DataFrame, text: str = "text", host: str = "source", n_chars: str = "n_chars", **limits) -> DataFrame:
    """The kept documents with their removed lines taken out; columns as in ``docs``.

    ``n_chars``, where such a column exists, follows the new text.
    """
    verdict = quality_rules(docs, text, host, **limits).where("kept").select(*KEY, "removed").dropDuplicates(KEY)
    held = docs.select(F.struct("*").alias("doc"), *_key(F.col(host), F.col(text))).join(verdict, KEY)
    lines = F.split(F.col("doc")[text], "\n")
    # lines and hashes are paired once, outside the lambda that picks the lines left
    paired = F.zip_with(lines, line_hashes(lines), lambda x, h: F.struct(x.alias("text"), h["line"].alias("line")))
    stays = F.filter(paired, lambda p: ~F.coalesce(F.array_contains("removed", p["line"]), F.lit(False)))
    left = F.array_join(F.transform(stays, lambda p: p["text"]), "\n")
    return with_text(held, docs, text, F.when(F.col("removed").isNull(), F.col("doc")[text]).otherwise(left), n_chars)


ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d
), wins AS (
  SELECT r, p, array_to_string(list_slice(ws, p, p + 4), ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 3)) AS p) q
), reps AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM wins) WHERE n > 1
), rep AS (
  SELECT r, sum(least(5, coalesce(nxt - p, 5))) AS n FROM (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS nxt FROM reps) GROUP BY r
), lines AS (
  SELECT r, host, t, line, length(translate(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS chars,
    trim(regexp_replace(lower(line), '[\\s\\x0B!-/:-@\\[-`{{-~\\d]+', ' ', 'g')) AS norm
  FROM (SELECT r, host, t, unnest(string_split(t, chr(10))) AS line FROM d)
), lw AS (SELECT * FROM lines WHERE chars > 0
), dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY r
), size AS (SELECT r, sum(length(replace(norm, ' ', '')))::BIGINT AS c FROM lw GROUP BY r
), freq AS (
  SELECT host, norm FROM lw WHERE norm <> '' GROUP BY host, norm HAVING count(DISTINCT t) > {MAX_DOCS}
), gone AS (SELECT r, count(*) AS n, sum(length(replace(norm, ' ', ''))) AS c FROM lw JOIN freq USING (host, norm) GROUP BY r
), x AS (
  SELECT d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0) AS n_removed_lines, coalesce(gone.c, 0)::BIGINT AS n_removed_chars, coalesce(size.c, 0) AS line_chars
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r) LEFT JOIN size USING (r)
), y AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x)
SELECT * EXCLUDE (line_chars), NOT base_failed AND n_removed_chars <= line_chars * {MAX_REMOVED}::DOUBLE AS kept FROM y
"""
OUTPUT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_removed_chars"]
