"""URL filters: rules indexed by their rarest literal token.

A rule is a row (kind, rule, action), action ``block`` or ``allow``:

* kind ``host``: ``host/path``; fits the host and all its subdomains where the url's path
  starts with the rule's.  Host rules outrank patterns; of several the longest wins.
* kind ``pattern``: a filter-list pattern over the whole url in lower case (A-Z only).
  ``*`` is any run, ``^`` a separator or the end, a leading ``||`` the start of the host or
  of one of its labels, a leading or trailing ``|`` the url's start or end.  Of the patterns
  that fit, allowing ones outrank blocking ones, then the longest wins.

A literal token is a run of a-z and 0-9 that stands in every url the rule fits as a whole
token of that url.  Each rule is filed under the one that the fewest rows of the url table
hold; a url's tokens fetch the rules filed under them, and only those run their regular
expression.  Rules without such a token are filed under the empty token, which every url has.

Nulls: a null url has no host, path or tokens and gets the default verdict; rules with a null
part, an empty text or an unknown kind or action are left out.  Equal rules count once; the
same rule with both actions allows.  Repeated urls and rows are judged alike.  Without
rules every url gets the default; an empty url table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from siftline.session import cut_lineage

#: Largest rule texts, in bytes all together, whose index is sent to every task.
INDEX_BYTES = 32 << 20
RESULT = ("host", "path", "rule", "pattern", "verdict")

#: Rules of the query over ``pages``.
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
PATTERNS = (
    ("block", "||ads."), ("block", "||adserver."), ("block", "||track."), ("block", "||tracker."),
    ("block", "/banner/"), ("block", "/adframe."), ("block", "/pixel.gif"), ("block", "/login^"),
    ("block", "/signin^"), ("block", "/signup^"), ("block", "/cart^"), ("block", "/checkout^"),
    ("block", "/wp-admin/"), ("block", "/cgi-bin/"), ("block", "?replytocom="), ("block", "&sessionid="),
    ("block", ".exe|"), ("block", ".zip|"), ("block", "*/print/*"), ("block", "/calendar/*/day/"),
    ("allow", "||archive.*/login^"), ("allow", "/help/login^"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)
_PARTS = re.compile(r"^.*?://([^/?#]*)([^?#]*)", re.DOTALL)
_TOKEN = re.compile(r"[a-z0-9]+")
END = r"\Z"


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty without ``://``."""
    found = _PARTS.match(url) if url else None
    return (found[1].translate(_FOLD), found[2]) if found else ("", "")


def url_tokens(url: str | None) -> set[str]:
    return {"", *_TOKEN.findall((url or "").translate(_FOLD))}


def _whole_tokens(text: str, open_left: bool, open_right: bool) -> set[str]:
    """Tokens of a literal that no neighbour in the url can lengthen."""
    return {
        m[0] for m in _TOKEN.finditer(text)
        if not (open_left and m.start() == 0) and not (open_right and m.end() == len(text))
    }


def _host_rule(rule: str) -> tuple[str, set[str]]:
    host, slash, path = rule.partition("/")
    host, path = host.translate(_FOLD), slash + path
    regex = rf"\A(?:[^/]*\.)?{re.escape(host)}" + (re.escape(path) if path else r"(?:/|\Z)")
    return regex, _whole_tokens(host, False, False) | _whole_tokens(path.translate(_FOLD), False, True)


def _pattern_rule(rule: str) -> tuple[str, set[str]]:
    """Every literal part is taken at its first place after the part before it, and kept
    there by an atomic group, so that a match is linear in the url however many ``*`` there are."""
    body = rule.translate(_FOLD)
    start, closed_left = ".*?", False
    if body.startswith("||"):
        start, body, closed_left = r"[^/?#]*?://(?:[^/?#]*?\.)??", body[2:], True
    elif body.startswith("|"):
        start, body, closed_left = "", body[1:], True
    closed_right = body.endswith("|")
    parts = (body[:-1] if closed_right else body).split("*")
    tokens, groups = set(), []
    for i, part in enumerate(parts):
        first, last = i == 0, i == len(parts) - 1
        # a separator or an anchor ends a token, a wildcard or the pattern's edge may not
        pieces = part.split("^")
        for k, piece in enumerate(pieces):
            left_open = k == 0 and not (first and closed_left)
            right_open = k == len(pieces) - 1 and not (last and closed_right)
            tokens |= _whole_tokens(piece, left_open, right_open)
        literal = r"(?:[^a-z0-9_.%-]|\Z)".join(map(re.escape, pieces))
        groups.append(f"(?>{start if first else '.*?'}{literal}{END if last and closed_right else ''})")
    return rf"(?s)\A{''.join(groups)}", tokens


def compile_rule(kind: str, rule: str) -> tuple[str, set[str]]:
    """The regular expression of a rule and its literal tokens."""
    return _host_rule(rule) if kind == "host" else _pattern_rule(rule)


@lru_cache(maxsize=100_000)
def _regex(source: str) -> re.Pattern:
    return re.compile(source)


def _fits(kind: str, source: str, url: str | None, host: str, path: str) -> bool:
    subject = host + path if kind == "host" else (url or "").translate(_FOLD)
    return _regex(source).match(subject) is not None


def _order(kind: str, rule: str, action: str) -> tuple:
    """Larger wins: host rules by length, patterns by action and then length."""
    allows = action == "allow"
    return (True, len(rule), allows, rule) if kind == "host" else (False, allows, len(rule), rule)


def rule_table(spark: SparkSession, hosts=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """(kind, rule, action) rows of (action, rule) pairs."""
    rows = [("host", r, a) for a, r in hosts] + [("pattern", r, a) for a, r in patterns]
    return spark.createDataFrame(rows, "kind string, rule string, action string")


def file_rules(rules: DataFrame, urls: DataFrame, url: str = "url", small: bool = True) -> DataFrame:
    """(token, kind, rule, action, regex): every rule under its rarest literal token.

    Only tokens that some rule holds are counted.  A ``small`` set of them goes to all tasks;
    otherwise the urls' tokens are counted first and meet the rules' afterwards.
    """
    valid = rules.where("kind in ('host', 'pattern') and action in ('block', 'allow') and rule <> ''").select("kind", "rule", "action").distinct()

    def compile_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [compile_rule(k, r) for k, r in zip(batch["kind"].to_pylist(), batch["rule"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([m[0] for m in made]), pa.array([sorted(m[1]) for m in made], pa.list_(pa.string()))],
                names=[*batch.schema.names, "regex", "tokens"],
            )

    schema = "kind string, rule string, action string, regex string, tokens array<string>"
    compiled = cut_lineage(valid.mapInArrow(compile_all, schema), "rules")
    held = compiled.select("kind", "rule", "action", "regex", F.explode_outer("tokens").alias("token"))
    wanted = held.where("token is not null").select("token").distinct()
    folded = F.translate(F.col(url), _UPPER, _LOWER)
    seen = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(folded, F.lit("([a-z0-9]+)"), F.lit(1)))).alias("token"))
    if small:
        counts = seen.join(F.broadcast(wanted), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    else:
        counts = seen.groupBy("token").agg(F.count("*").alias("n")).join(wanted, "token", "left_semi")
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")
    return (
        held.join(counts, "token", "left").groupBy("kind", "rule", "action", "regex").agg(F.min(rank)["token"].alias("token"))
        .select(F.coalesce("token", F.lit("")).alias("token"), "kind", "rule", "action", "regex")
    )


def _verdicts(urls: list[str | None], best: list[tuple | None], default: str) -> list[pa.Array]:
    """The result columns of urls and their winning (kind, rule, action)."""
    parts = [split_url(u) for u in urls]
    host_rule = [b[1] if b and b[0] == "host" else None for b in best]
    pattern = [b[1] if b and b[0] == "pattern" else None for b in best]
    columns = [p[0] for p in parts], [p[1] for p in parts], host_rule, pattern, [b[2] if b else default for b in best]
    return [pa.array(c, pa.string()) for c in columns]


def judge_urls(
    urls: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = (), default: str = "allow", index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """The ``keep`` columns of every row and host, path, rule, pattern, verdict.

    ``rule`` or ``pattern`` names the deciding rule.  A kept column named like a result
    column is left out.  While the rule texts have ``index_bytes`` bytes at most, the index goes
    to every task and the urls are judged where they are; larger rule sets are joined with
    the urls' tokens.  Both give the same rows.
    """
    kept = [c for c in keep if c not in RESULT]
    size = rules.agg(F.coalesce(F.sum(F.octet_length("rule")), F.lit(0))).first()[0]
    filed = file_rules(rules, urls, url, small=size <= index_bytes)
    rows = urls.select(*kept, F.col(url).alias("_url"))
    schema = StructType(rows.schema.fields[:-1] + [StructField(name, StringType()) for name in RESULT])
    if size > index_bytes:
        return _joined(rows, filed, kept, default)
    index: dict[str, list[tuple]] = {}
    for row in filed.collect():
        index.setdefault(row["token"], []).append((row["kind"], row["rule"], row["action"], row["regex"]))
    shared = urls.sparkSession.sparkContext.broadcast(index)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filed_under = shared.value
        for batch in batches:
            texts, best = batch["_url"].to_pylist(), []
            for text in texts:
                host, path = split_url(text)
                fits = [
                    (k, r, a) for t in url_tokens(text) for k, r, a, source in filed_under.get(t, ())
                    if _fits(k, source, text, host, path)
                ]
                best.append(max(fits, key=lambda f: _order(*f), default=None))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *_verdicts(texts, best, default)], names=schema.names)

    return rows.mapInArrow(judge, schema)


def _joined(rows: DataFrame, filed: DataFrame, kept: list[str], default: str) -> DataFrame:
    """Judge each different url once, its candidates found by a join on the token.

    A hit keeps only the best rule so far, so partial maxima collapse before the shuffle.
    """
    folded = F.translate("_url", _UPPER, _LOWER)
    tokens = F.concat(F.array(F.lit("")), F.array_distinct(F.regexp_extract_all(folded, F.lit("([a-z0-9]+)"), F.lit(1))))
    texts = rows.where("_url is not null").select("_url").distinct()
    found = texts.select("_url", F.explode(tokens).alias("token")).join(filed, "token").drop("token")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for text, kind, source in zip(*(batch[c].to_pylist() for c in ("_url", "kind", "regex"))):
                hits.append(_fits(kind, source, text, *split_url(text)))
            yield batch.filter(pa.array(hits, pa.bool_()))

    is_host, allows, length = F.col("kind") == "host", F.col("action") == "allow", F.char_length("rule")
    weight = F.struct(
        is_host.alias("h"), F.when(is_host, length).otherwise(allows.cast("int")).alias("x"),
        F.when(is_host, allows.cast("int")).otherwise(length).alias("y"), "rule", "action",
    )
    best = found.mapInArrow(check, found.schema).groupBy("_url").agg(F.max(weight).alias("best"))
    host = F.regexp_extract("_url", r"(?s)^.*?://([^/?#]*)", 1)
    named = rows.join(best, "_url", "left")
    return named.select(
        *kept,
        F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract("_url", r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
        F.when(F.col("best.h"), F.col("best.rule")).alias("rule"),
        F.when(~F.col("best.h"), F.col("best.rule")).alias("pattern"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )


def apply_url_filter(docs: DataFrame, rules: DataFrame, url: str = "url", **options) -> DataFrame:
    """The rows whose url is allowed, with all their columns."""
    packed = docs.select(F.struct("*").alias("doc"), F.col(url).alias("address"))
    return judge_urls(packed, rules, "address", keep=("doc",), **options).where("verdict = 'allow'").select("doc.*")


def _oracle_sql() -> str:
    """Every rule run against every url, in SQL."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    values = []
    for kind, rules in (("host", HOST_RULES), ("pattern", PATTERNS)):
        for action, rule in rules:
            regex = compile_rule(kind, rule)[0].replace(END, r"\z").replace("(?>", "(?:")
            values.append(f"({text(kind)}, {text(rule)}, {text(action)}, {text(regex)})")
    fold = f"'{_UPPER}', '{_LOWER}'"
    return f"""
with rules(kind, rule, action, regex) as (values {', '.join(values)}),
urls as (
  select page_id, coalesce(url, '') as url,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), {fold}) as host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
  from pages),
verdicts as (
  select url, arg_max(kind, weight) as kind, arg_max(rule, weight) as rule, arg_max(action, weight) as action
  from (
    select u.url, r.*, case when kind = 'host' then 1000000 + 10 * length(rule) + (action = 'allow')::int
                            else 10000 * (action = 'allow')::int + length(rule) end as weight
    from (select distinct url, host, path from urls) u
    join rules r on regexp_matches(case when kind = 'host' then host || path else translate(url, {fold}) end, regex))
  group by url)
select page_id, host, path, case when kind = 'host' then rule end as rule,
       case when kind = 'pattern' then rule end as pattern, coalesce(action, 'allow') as verdict
from urls left join verdicts using (url)
"""


ORACLE_SQL = _oracle_sql()
