"""Preference formatting: a shared prompt once, and two masked completions.

Everything is built-in expressions: a conversation's turns are gathered once, the longest
common prefix of a pair is the first place at which its two turn arrays differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.session import cut_lineage

#: How a turn is rendered; ``{role}`` and ``{text}`` are replaced.
TEMPLATE = "<|{role}|>\n{text}<|end|>\n"
#: About as many conversations are paired in one group before the groups' rests meet.
PAIR_BLOCK = 4096
SEED = "pair-1"


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as struct(role, text).

    Rows without conversation or turn number are left out; null roles and texts count as
    empty; rows of one turn number follow by role and text, and rows that repeat a turn
    whole count once.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    ).where(F.col("conv_id").isNotNull() & F.col("t.turn").isNotNull())
    gathered = rows.groupBy("conv_id").agg(F.array_distinct(F.sort_array(F.collect_list("t"))).alias("t"))
    return gathered.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def seeded(conv_id: Column) -> Column:
    """A number of 32 bits from the md5 of an id; the same in Spark and in SQL."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), conv_id.cast("string"))), 1, 8), 16, 10).cast("long")


def _twos(rows: DataFrame, group: list[str]) -> DataFrame:
    """Add ``a`` and ``b``: of each two neighbours by id in a group the ids; ``b`` is null for a last odd one."""
    ranked = rows.withColumn("_p", F.floor((F.row_number().over(Window.partitionBy(*group).orderBy("conv_id")) - 1) / 2))
    twos = ranked.groupBy(*group, "_p").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b"))
    return twos.withColumn("b", F.when(F.col("a") != F.col("b"), F.col("b"))).drop("_p")


def pair_up(convs: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """(pair_id, chosen_id, rejected_id, reply_id) for conversations without given preferences.

    Conversations whose first turns are equal are paired, neighbours by id first, the smaller id
    chosen: first within seeded groups of about ``block``, then what is left over of
    all groups of an opening, one at most of each.  So at most one conversation of every
    opening has no twin.  Those are chosen against themselves with another reply: the last
    assistant turn of the next such conversation (``reply_id``) of a seeded group, the first
    after the last.  Both are null where a group has one such conversation only or
    where the conversation has no assistant turn.
    """
    first = F.concat(F.get("turns", F.lit(0))["role"], F.lit(":"), F.get("turns", F.lit(0))["text"])
    rows = cut_lineage(convs.select(
        "conv_id", F.md5(first).alias("opening"), F.exists("turns", lambda t: t["role"] == "assistant").alias("replies"), seeded(F.col("conv_id")).alias("seed"),
    ), "openings")
    groups = max(1, rows.count() // block)
    near = cut_lineage(_twos(rows.withColumn("grp", F.pmod("seed", F.lit(groups))), ["opening", "grp"]), "twins")
    left = near.where("b is null").select("opening", F.col("a").alias("conv_id"))
    far = cut_lineage(_twos(left, ["opening"]), "far-twins")
    pairs = near.select("a", "b").where("b is not null").union(far.select("a", "b").where("b is not null"))
    alone = far.where("b is null").select(F.col("a").alias("conv_id")).join(rows.select("conv_id", "replies", "seed"), "conv_id")
    givers = cut_lineage(alone, "no-twins")
    group = Window.partitionBy("grp")
    ring = givers.where("replies").withColumn("grp", F.pmod("seed", F.lit(max(1, givers.where("replies").count() // block))))
    after = F.coalesce(F.lead("conv_id").over(group.orderBy("conv_id")), F.min("conv_id").over(group))
    built = ring.withColumn("reply_id", F.when(after != F.col("conv_id"), after)).select("conv_id", "reply_id")
    built = built.union(givers.where("not replies").select("conv_id", F.lit(None).cast(convs.schema["conv_id"].dataType)))
    none = F.lit(None).cast(convs.schema["conv_id"].dataType)
    return pairs.select(F.col("a").alias("pair_id"), F.col("a").alias("chosen_id"), F.col("b").alias("rejected_id"), none.alias("reply_id")).union(
        built.select("conv_id", F.col("conv_id").alias("chosen_id"), none.alias("rejected_id"), "reply_id")
    )


def render(turns: Column, template: str = TEMPLATE) -> Column:
    """The turns as one string."""
    head, middle, tail = template.replace("{role}", "\0").replace("{text}", "\0").split("\0")
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(head), t["role"], F.lit(middle), t["text"], F.lit(tail))), "")


def loss_mask(turns: Column, template: str = TEMPLATE, role: str = "assistant") -> Column:
    """Runs of code points of a rendered completion as "length:1" for trained turns, else "length:0"."""
    extra = len(template.replace("{role}", "").replace("{text}", ""))
    size = lambda t: (F.char_length(t["role"]) + F.char_length(t["text"]) + extra).cast("string")
    return F.array_join(F.transform(turns, lambda t: F.concat(size(t), F.when(t["role"] == role, ":1").otherwise(":0"))), " ")


def format_preferences(pairs: DataFrame, convs: DataFrame, template: str = TEMPLATE, role: str = "assistant") -> DataFrame:
    """One row per pair: the common prompt and both completions with their loss masks.

    The prompt is the longest common prefix of turns, rendered once; a completion is the
    rest of its conversation, and only turns of ``role`` in it are trained on.  A side
    that is null or unknown has a null completion; the prompt is then empty and the other
    side is a completion from its first turn on.  Equal conversations have empty
    completions.  Repeated pairs give repeated rows.

    Where ``pairs`` has a column ``reply_id`` and it is not null, the rejected side is the
    chosen conversation before its last turn of ``role``, then that conversation's last
    turn of ``role``; it is null where either has none.
    """
    replies = "reply_id" in pairs.columns
    if not replies:
        pairs = pairs.withColumn("reply_id", F.lit(None).cast(convs.schema["conv_id"].dataType))
    chosen = convs.select(F.col("conv_id").alias("_c"), F.col("turns").alias("_ct"))
    rejected = convs.select(F.col("conv_id").alias("_r"), F.col("turns").alias("_rt"))
    df = pairs.join(chosen, F.col("chosen_id") == F.col("_c"), "left").join(rejected, F.col("rejected_id") == F.col("_r"), "left")
    if replies:
        spoken = F.filter("turns", lambda t: t["role"] == role)
        given = convs.where(F.size(spoken) > 0).select(F.col("conv_id").alias("_g"), F.element_at(spoken, -1).alias("_gt"))
        df = df.join(given, F.col("reply_id") == F.col("_g"), "left")
        places = F.filter(F.transform("_ct", lambda t, i: F.when(t["role"] == role, i)), lambda i: i.isNotNull())
        before = F.slice("_ct", F.lit(1), F.coalesce(F.array_max(places), F.lit(0)))
        built = F.when((F.size(places) > 0) & F.col("_gt").isNotNull(), F.concat(before, F.array("_gt")))
        df = df.withColumn("_rt", F.when(F.col("reply_id").isNotNull(), built).otherwise(F.col("_rt")))
    differs = F.transform(F.arrays_zip(F.col("_ct").alias("c"), F.col("_rt").alias("r")), lambda z: ~z["c"].eqNullSafe(z["r"]))
    at = F.array_position(differs, True)
    longest = F.when(F.col("_ct").isNull() | F.col("_rt").isNull(), 0).when(at > 0, at - 1).otherwise(F.size("_ct"))
    df = df.withColumn("n_prompt_turns", longest.cast("long"))
    rest = lambda t: F.slice(t, F.col("n_prompt_turns").cast("int") + 1, F.greatest(F.lit(0), F.size(t) - F.col("n_prompt_turns").cast("int")))
    prompt = F.slice(F.coalesce("_ct", "_rt"), F.lit(1), F.col("n_prompt_turns").cast("int"))
    return df.select(
        "pair_id", "chosen_id", "rejected_id", "reply_id", "n_prompt_turns", F.coalesce(render(prompt, template), F.lit("")).alias("prompt"),
        render(rest(F.col("_ct")), template).alias("chosen"), loss_mask(rest(F.col("_ct")), template, role).alias("chosen_mask"),
        render(rest(F.col("_rt")), template).alias("rejected"), loss_mask(rest(F.col("_rt")), template, role).alias("rejected_mask"),
    )


ORACLE_SQL = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM t
), said AS (SELECT conv_id, max(k) AS k FROM n WHERE role = 'assistant' GROUP BY conv_id
), f AS (SELECT conv_id, md5(role || ':' || text) AS opening, ('0x' || substr(md5('{SEED}:' || conv_id), 1, 8))::BIGINT AS seed FROM n WHERE k = 1
), g AS (SELECT *, seed % greatest(1, (SELECT count(*) FROM f) // {PAIR_BLOCK}) AS grp FROM f
), near AS (
  SELECT opening, min(conv_id) AS a, max(conv_id) AS b FROM (SELECT *, (row_number() OVER (PARTITION BY opening, grp ORDER BY conv_id) - 1) // 2 AS p FROM g) GROUP BY opening, grp, p
), far AS (
  SELECT min(a) AS a, max(a) AS b FROM (SELECT *, (row_number() OVER (PARTITION BY opening ORDER BY a) - 1) // 2 AS p FROM near WHERE a = b) GROUP BY opening, p
), alone AS (SELECT f.conv_id, f.seed, s.k FROM far JOIN f ON f.conv_id = far.a LEFT JOIN said s ON s.conv_id = f.conv_id WHERE far.a = far.b
), ring AS (SELECT *, seed % greatest(1, (SELECT count(*) FROM alone WHERE k IS NOT NULL) // {PAIR_BLOCK}) AS grp FROM alone WHERE k IS NOT NULL
), built AS (
  SELECT conv_id AS c, k, coalesce(lead(conv_id) OVER (PARTITION BY grp ORDER BY conv_id), min(conv_id) OVER (PARTITION BY grp)) AS g FROM ring
), p AS (
  SELECT a AS c, b AS o, NULL::BIGINT AS g FROM near WHERE a < b UNION ALL SELECT a, b, NULL FROM far WHERE a < b
  UNION ALL SELECT c, NULL, CASE WHEN g <> c THEN g END FROM built UNION ALL SELECT conv_id, NULL, NULL FROM alone WHERE k IS NULL
), other AS (
  SELECT p.c, n.k, n.role, n.text FROM p JOIN n ON n.conv_id = p.o
  UNION ALL SELECT p.c, n.k, n.role, n.text FROM p JOIN said s ON s.conv_id = p.c JOIN n ON n.conv_id = p.c AND n.k < s.k WHERE p.g IS NOT NULL
  UNION ALL SELECT p.c, s.k, n.role, n.text FROM p JOIN said s ON s.conv_id = p.c JOIN said d ON d.conv_id = p.g JOIN n ON n.conv_id = p.g AND n.k = d.k
), same AS (
  SELECT p.c, a.k, coalesce(a.role = b.role AND a.text = b.text, false) AS eq FROM p JOIN n a ON a.conv_id = p.c LEFT JOIN other b ON b.c = p.c AND a.k = b.k
), lcp AS (SELECT c, coalesce(min(CASE WHEN NOT eq THEN k END) - 1, count(*)) AS l FROM same GROUP BY c
), x AS (
  SELECT c, k, side, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS s,
    (length(role) + length(text) + 13)::VARCHAR || CASE WHEN role = 'assistant' THEN ':1' ELSE ':0' END AS m
  FROM (SELECT p.c, n.k, n.role, n.text, 1 AS side FROM p JOIN n ON n.conv_id = p.c UNION ALL SELECT c, k, role, text, 2 FROM other)
), y AS (
  SELECT x.c, coalesce(string_agg(s, '' ORDER BY k) FILTER (side = 1 AND k <= l), '') AS prompt,
    coalesce(string_agg(s, '' ORDER BY k) FILTER (side = 1 AND k > l), '') AS chosen, coalesce(string_agg(m, ' ' ORDER BY k) FILTER (side = 1 AND k > l), '') AS chosen_mask,
    coalesce(string_agg(s, '' ORDER BY k) FILTER (side = 2 AND k > l), '') AS rejected, coalesce(string_agg(m, ' ' ORDER BY k) FILTER (side = 2 AND k > l), '') AS rejected_mask
  FROM x JOIN lcp USING (c) GROUP BY x.c
)
SELECT p.c AS pair_id, p.c AS chosen_id, coalesce(p.o, p.g, p.c) AS other_id,
  CASE WHEN p.o IS NOT NULL THEN 'twin' WHEN p.g IS NOT NULL THEN 'reply' ELSE 'alone' END AS kind, l AS n_prompt_turns, prompt, chosen, chosen_mask,
  CASE WHEN p.o IS NOT NULL OR p.g IS NOT NULL THEN rejected END AS rejected, CASE WHEN p.o IS NOT NULL OR p.g IS NOT NULL THEN rejected_mask END AS rejected_mask
FROM p JOIN lcp USING (c) JOIN y USING (c)
"""
