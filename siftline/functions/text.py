"""Text expressions (T1-T12, W11, W12, X7, X9), all native columns.

Nothing here leaves the JVM.  Patterns carry ``(?U)`` because the wanted
semantics of ``\\w``, ``\\d``, ``\\s`` and ``\\b`` are the Unicode ones.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Must equal the values users of the classifier already trained with.
STOPWORDS = (
    # English
    "a an the and or but if because as what when where how who which this that "
    "these those then just so than such both through about for is of while during "
    "to from in on by at was were are am been being with without after before above "
    "below between into over under again further once here there all any each few "
    "more most other some no nor not only own same too very can will should now s t "
    # too common in this domain
    "security cyber cybersecurity attack threat researcher report according company "
    "organization system user data information network"
).split()

URL_PATTERN = r"https?://\S+|www\.\S+"
EMAIL_PATTERN = r"\S+@\S+\.\S+"
PATH_PATTERN = r"(?:/|\\)[\w\d.-]+(?:/|\\)"
NUMBER_PATTERN = r"\b\d+(?:\.\d+)?\b"
# ----------------------------------------------------------------------------


def _only_where(col: Column, holds, strip) -> Column:
    """``strip`` for the texts that a cheap test says it can change; ``col`` is computed once."""
    return F.get(F.transform(F.array(col), lambda x: F.when(holds(x), strip(x)).otherwise(x)), F.lit(0))


def lower_text(col: Column) -> Column:
    """Lower case, null as the empty string."""
    return F.lower(F.coalesce(col, F.lit("")))


def strip_urls(col: Column) -> Column:
    """T2."""
    return F.regexp_replace(col, f"(?U){URL_PATTERN}", " ")


def strip_emails(col: Column) -> Column:
    """T3.  A match always spans a whole whitespace-free run, so trying only at
    run starts gives the same result and keeps long runs linear."""
    return F.regexp_replace(col, rf"(?U)(?<!\S){EMAIL_PATTERN}", " ")


def strip_paths(col: Column) -> Column:
    """T4."""
    return F.regexp_replace(col, f"(?U){PATH_PATTERN}", " ")


def strip_numbers(col: Column) -> Column:
    """T5."""
    return F.regexp_replace(col, f"(?U){NUMBER_PATTERN}", " ")


def strip_symbols(col: Column) -> Column:
    """Everything but ASCII letters and digits separates words.  Runs of
    plain spaces are left alone: they separate words as they are."""
    return F.regexp_replace(col, "[^a-zA-Z0-9 ]+", " ")


def keep_words(
    col: Column,
    remove_stopwords: bool = True,
    min_word_length: int = 2,
    stopwords: Iterable[str] = STOPWORDS,
) -> Column:
    """T6 and T7 in one scan: runs of ASCII letters and digits of at least
    ``min_word_length``, without stopwords -> array<string>.

    Pulling the wanted runs out is several times faster than replacing what lies
    between them and splitting again.
    """
    words = F.regexp_extract_all(
        col, F.lit("[a-zA-Z0-9]{%d,}" % max(min_word_length, 1)), F.lit(0)
    )
    stop = list(stopwords)
    if not (remove_stopwords and stop):
        return words
    return F.filter(words, lambda word: ~word.isin(stop))


def clean_tokens(
    col: Column,
    remove_stopwords: bool = True,
    min_word_length: int = 2,
    remove_numbers: bool = True,
    remove_urls: bool = True,
    remove_emails: bool = True,
) -> Column:
    """T1..T7 in order, as a token array."""
    out = lower_text(col)
    if remove_urls:
        out = _only_where(out, lambda x: x.contains("http") | x.contains("www."), strip_urls)
    if remove_emails:
        out = _only_where(out, lambda x: x.contains("@"), strip_emails)
    out = _only_where(out, lambda x: x.contains("/") | x.contains("\\"), strip_paths)
    if remove_numbers:
        out = _only_where(out, lambda x: x.rlike(r"(?U)\d"), strip_numbers)
    return keep_words(out, remove_stopwords, min_word_length)


def preprocess(col: Column, **flags) -> Column:
    """Cleaned text, words joined by single spaces."""
    return F.array_join(clean_tokens(col, **flags), " ")


def tokenize(col: Column) -> Column:
    """Whitespace tokens of already cleaned text."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def ngrams(tokens: Column, ngram_range: tuple[int, int] = (1, 2)) -> Column:
    """All n-grams of the range, shorter ones first, duplicates kept."""
    low, high = ngram_range
    if low < 1 or high < low:
        raise ValueError(f"bad ngram_range {ngram_range}")
    parts = []
    for n in range(low, high + 1):
        gram = tokens
        for shift in range(1, n):
            # pair every kept start with the token `shift` places on
            left = F.slice(gram, 1, F.greatest(F.size(gram) - 1, F.lit(0)))
            right = F.slice(tokens, shift + 1, F.greatest(F.size(tokens) - shift, F.lit(0)))
            gram = F.zip_with(left, right, lambda a, b: F.concat_ws(" ", a, b))
        parts.append(gram)
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def preview(col: Column, n: int) -> Column:
    """The first n characters, with ``...`` when something was cut."""
    return F.when(F.length(col) > n, F.concat(F.left(col, F.lit(n)), F.lit("..."))).otherwise(col)


def truncate_words(col: Column, length: int = 100, leeway: int = 5) -> Column:
    """Cut at a word boundary so that text plus ``...`` fits ``length``;
    text up to ``length + leeway`` stays as it is."""
    head = F.left(col, F.lit(length - 3))
    # substring_index with a negative count would drop the head, so cut by pattern
    kept = F.regexp_replace(head, r"(?s) [^ ]*\z", "")
    return F.when(F.length(col) <= length + leeway, col).otherwise(F.concat(kept, F.lit("...")))


def clean_whitespace(col: Column) -> Column:
    """Squeeze blanks, strip every line, drop empty lines."""
    squeezed = F.regexp_replace(col, r"[ \t]{2,}", " ")
    lines = F.split(squeezed, "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]")
    stripped = F.transform(lines, lambda s: F.regexp_replace(s, r"(?U)^[\s\x1f]+|[\s\x1f]+$", ""))
    return F.coalesce(F.array_join(F.filter(stripped, lambda s: s != ""), "\n"), F.lit(""))


def domain_of(url: Column) -> Column:
    """The authority part, port and user info kept, case kept, '' if none."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def sanitize_key(col: Column) -> Column:
    """File-safe content key, at most 100 characters."""
    safe = F.regexp_replace(col, r"[^\p{L}\p{N}._-]", "_")
    return F.when(
        F.length(safe) > 100, F.concat(F.left(safe, F.lit(80)), F.lit("___"), F.right(safe, F.lit(17)))
    ).otherwise(safe)


def crawl_key(col: Column) -> Column:
    """File key of a crawled page, the last 150 characters."""
    return F.right(F.regexp_replace(col, r"[^\p{L}\p{N}]", "_"), F.lit(150))


def ascii_like(col: Column, pattern: str) -> Column:
    """LIKE with ``%`` and ``_`` wildcards, case-insensitive for ASCII only.

    Java's case-insensitive flag folds ASCII only, so no lower-cased copy of the
    text is needed.
    """
    wild = {"%": ".*", "_": "."}
    body = pattern
    head, tail = r"\A", r"\z"
    # a leading or trailing % is the absence of an anchor
    if body.startswith("%"):
        head, body = "", body.lstrip("%")
    if body.endswith("%"):
        tail, body = "", body.rstrip("%")
    regex, literal = "", ""
    for ch in body:
        if ch in wild:
            regex += _quote(literal) + wild[ch]
            literal = ""
        else:
            literal += ch
    regex += _quote(literal)
    return col.rlike(f"(?is){head}{regex}{tail}")


def contains_text(col: Column, needle: str) -> Column:
    """``LIKE '%needle%'`` with wildcards inside the needle honoured."""
    return ascii_like(col, f"%{needle}%")


def _quote(literal: str) -> str:
    if not literal:
        return ""
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"
