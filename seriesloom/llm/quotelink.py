"""Quotation linking: reply-ordered conversations without quotes, in DataFrame functions only.

A line's quote level is the number of ``>`` before its text.  Lines of one level
that follow each other, up to a blank one, are a quoted passage; passages
and their single lines are normalised (lower case, one blank for white space)
and hashed.  Own text (level 0) gives the passages of originals in the same way.
The original of a hash is the earliest message of the conversation that has it as own text.
A message replies to the earlier message to which most characters of its outermost quotes lead (its outermost level
that leads anywhere; ties: the later message), and without such a link to the
message before it.  A thread is what quotation links join to one first message;
sorted by (conversation, thread_turn, turn) every reply follows its original.

Scale: messages link within their conversation but are dealt by (conversation,
hash), never by conversation; every quoted unit meets one original, so nothing is squared;
a message is parsed in time linear in its length, however deep its quotes are;
the message before is found in blocks of ``BLOCK`` turns; threads are followed
by doubling, over the linked messages only.

Defined results: null text is empty text; messages with null conv_id or turn
link to nothing; repeated (conv_id, turn) rows each get their row, and their
texts count together as one original and one reply; quotes without an original stay unlinked but are
removed like the others; texts and lines of any length and depth are read whole; of originals
with one hash the earliest counts; an empty table gives an empty table; other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import forget, keep

BLOCK = 1024
QUOTE = r"^[ \t]*+(?:>[ \t]?+)++"  # possessive, so that the engine loops over a long prefix instead of recursing
SPACE = r"[ \t\r\n\f\x0b]+"
#: How a line that announces a quote ends (English, French, German, Spanish).
ANNOUNCES = r"(?i)(wrote|writes|a écrit|schrieb|escribió)[ \t]*:[ \t]*$"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), "[^>]", ""))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), SPACE, " "))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where lambdas inside refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def units(text: Column) -> Column:
    """Hashes of distinct normalised passages and lines of a text, without blank ones."""
    passages = F.split(text, r"\n[ \t\r\f\x0b]*+\n")
    lines = F.split(text, "\n")
    return F.array_distinct(F.transform(F.filter(F.transform(F.concat(passages, lines), normal), lambda x: x != ""), lambda x: F.xxhash64(x)))


def quoted_units(lines: Column) -> Column:
    """Distinct (level, hash, length) of the quoted passages and lines of a message."""

    def line(x):
        said = F.regexp_replace(x, QUOTE, "")
        return F.struct(F.when(normal(said) == "", 0).otherwise(level(x)).alias("level"), said.alias("said"))

    def of(a):
        at = lambda i: F.coalesce(F.get(a, i)["level"], F.lit(0))
        here = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: at(i) > 0)
        starts, ends = F.filter(here, lambda i: at(i - 1) != at(i)), F.filter(here, lambda i: at(i + 1) != at(i))
        passages = F.zip_with(starts, ends, lambda i, j: F.struct(at(i).alias("level"), F.array_join(F.transform(F.slice(a, i + 1, j - i + 1), lambda x: x["said"]), "\n").alias("u")))
        singles = F.transform(here, lambda i: F.struct(at(i).alias("level"), F.get(a, i)["said"].alias("u")))
        return F.transform(F.concat(passages, singles), lambda x: F.struct(x["level"].alias("level"), F.xxhash64(normal(x["u"])).alias("h"), F.length(normal(x["u"])).alias("n")))

    return F.array_distinct(let(F.transform(lines, line), of))


def own_text(lines: Column) -> Column:
    """The lines of level 0, without those that announce a quote, trimmed as a whole."""

    def of(a):
        quoted = lambda i: F.coalesce(F.get(a, i)["q"], F.lit(False))
        own = F.filter(a, lambda x, i: ~x["q"] & ~(x["x"].rlike(ANNOUNCES) & quoted(i + 1)))
        return F.array_join(F.transform(own, lambda x: x["x"]), "\n")

    return F.trim(let(F.transform(lines, lambda x: F.struct(x.alias("x"), (level(x) > 0).alias("q"))), of), F.lit(" \t\r\n\f\x0b"))


def parse(messages: DataFrame, text: str = "text") -> DataFrame:
    """``messages`` with ``clean_text``, ``n_quoted`` (quoted lines), ``own`` (hashes) and ``quoted`` (level, hash, length) for the text."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    out = messages.select(*[c for c in messages.columns if c != text], lines.alias("lines_"))
    out = out.select("*", own_text(F.col("lines_")).alias("clean_text"), F.size(F.filter("lines_", lambda x: level(x) > 0)).cast("bigint").alias("n_quoted"), quoted_units(F.col("lines_")).alias("quoted")).drop("lines_")
    return out.select("*", units(F.col("clean_text")).alias("own"))


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, reply_turn, linked, thread_turn, n_quoted, clean_text."""
    src = messages.select(F.col(conv).alias("c"), F.col(turn).cast("bigint").alias("t"), F.col(role).alias("role"), F.col(text).alias("text"))
    parsed = keep(parse(src), "quotes")
    quoting = parsed.filter("n_quoted > 0 and c is not null and t is not null")
    quoted = quoting.select("c", "t", F.explode("quoted").alias("q")).select("c", "t", "q.level", "q.h", "q.n").distinct()
    # own text of conversations that have quotes, dealt by (conversation, hash)
    own = parsed.filter("t is not null").join(quoting.select("c").distinct(), "c", "left_semi").select("c", "t", F.explode("own").alias("h"))
    first = own.groupBy("c", "h").agg(F.min("t").alias("original"))
    hits = quoted.join(first, ["c", "h"]).filter("original < t")
    per_original = hits.groupBy("c", "t", "level", "original").agg(F.sum("n").alias("n"))
    best = per_original.groupBy("c", "t").agg(F.max(F.struct(-F.col("level"), "n", "original")).alias("b"))
    links = keep(best.select("c", "t", F.col("b.original").alias("r")), "links")
    threads = roots(links)
    before = previous(parsed.select("c", "t").filter("c is not null and t is not null").distinct())
    out = parsed.join(links, ["c", "t"], "left").join(threads, ["c", "t"], "left").join(before, ["c", "t"], "left")
    return out.select(
        F.col("c").alias(conv), F.col("t").alias(turn), F.col("role").alias(role), F.coalesce("r", "p").alias("reply_turn"), F.col("r").isNotNull().alias("linked"),
        F.coalesce("root", "t").alias("thread_turn"), "n_quoted", "clean_text",
    )


def roots(links: DataFrame) -> DataFrame:
    """(c, t, root): where following links (c, t, r) from t ends; doubles the step every round."""
    cur = keep(links.select("c", "t", F.col("r").alias("root")), "threads")
    while True:
        onward = cur.select("c", F.col("t").alias("root"), F.col("root").alias("next"))
        new = keep(cur.join(onward, ["c", "root"], "left").select("c", "t", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "threads")
        forget(cur)
        if not new.filter("moved").limit(1).count():
            return new.drop("moved")
        cur = keep(new.drop("moved"), "threads")
        forget(new)


def previous(turns: DataFrame) -> DataFrame:
    """(c, t, p): the turn before each turn of a conversation, without sorting a conversation as a whole."""
    blocked = turns.withColumn("b", F.floor(F.col("t") / BLOCK))
    inside = blocked.withColumn("p", F.lag("t").over(Window.partitionBy("c", "b").orderBy("t")))
    ends = blocked.groupBy("c", "b").agg(F.max("t").alias("last")).withColumn("earlier", F.lag("last").over(Window.partitionBy("c").orderBy("b")))
    return inside.join(ends.select("c", "b", "earlier"), ["c", "b"]).select("c", "t", F.coalesce("p", "earlier").alias("p"))


def with_quotes(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, role, text) whose texts quote the turns before, in one of five ways by conversation and turn.

    Nothing; the turn before as announced quote; the two turns before at two levels; the turn before with other capitals and blanks;
    the first line of the turn before.  ``QUOTES_SQL`` is the same in SQL.
    """
    one = messages.filter("conv_id is not null and turn is not null").groupBy("conv_id", F.col("turn").cast("bigint").alias("t")).agg(F.min("text").alias("said"))
    before = lambda n: one.select(F.col("conv_id").alias(f"c{n}"), (F.col("t") + n).alias(f"t{n}"), F.coalesce("said", F.lit("")).alias(f"said{n}"))
    near = (F.col("conv_id") == F.col("c1")) & (F.col("turn") == F.col("t1"))
    far = (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2"))
    own = F.coalesce("text", F.lit(""))
    marked = lambda said, mark: F.concat(F.lit(mark), F.replace(said, F.lit("\n"), F.lit("\n" + mark)), F.lit("\n"))
    a, b = F.col("said1"), F.coalesce("said2", F.lit(""))
    loud = F.translate(F.replace(a, F.lit(" "), F.lit("  ")), _LOW, _LOW.upper())
    way = F.pmod(F.col("conv_id") * 7 + F.col("turn") * 3, F.lit(5))
    text = (
        F.when(a.isNull() | (way == 0), F.col("text"))
        .when(way == 1, F.concat(F.lit("On that day somebody wrote:\n"), marked(a, "> "), own))
        .when(way == 2, F.concat(marked(b, "> > "), marked(a, "> "), F.lit("\n"), own))
        .when(way == 3, F.concat(marked(loud, ">"), own))
        .otherwise(F.concat(F.lit("> "), F.substring_index(a, "\n", 1), F.lit("\n"), own))
    )
    return messages.join(before(1), near, "left").join(before(2), far, "left").select("conv_id", "turn", "role", text.alias("text"))


_LOW = "abcdefghijklmnopqrstuvwxyz"
QUOTES_SQL = f"""(
  WITH one AS (SELECT conv_id, turn, coalesce(min(text), '') AS said FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
  near AS (SELECT m.*, a.said AS said1, coalesce(b.said, '') AS said2, ((m.conv_id * 7 + m.turn * 3) % 5 + 5) % 5 AS way
    FROM conversations m LEFT JOIN one a ON m.conv_id = a.conv_id AND m.turn = a.turn + 1 LEFT JOIN one b ON m.conv_id = b.conv_id AND m.turn = b.turn + 2)
  SELECT conv_id, turn, role, CASE WHEN said1 IS NULL OR way = 0 THEN text
    WHEN way = 1 THEN 'On that day somebody wrote:' || chr(10) || '> ' || replace(said1, chr(10), chr(10) || '> ') || chr(10) || coalesce(text, '')
    WHEN way = 2 THEN '> > ' || replace(said2, chr(10), chr(10) || '> > ') || chr(10) || '> ' || replace(said1, chr(10), chr(10) || '> ') || chr(10) || chr(10) || coalesce(text, '')
    WHEN way = 3 THEN '>' || replace(translate(replace(said1, ' ', '  '), '{_LOW}', '{_LOW.upper()}'), chr(10), chr(10) || '>') || chr(10) || coalesce(text, '')
    ELSE '> ' || split_part(said1, chr(10), 1) || chr(10) || coalesce(text, '') END AS text
  FROM near)"""


def sql(table: str = "conversations") -> str:
    """The same rows in DuckDB SQL."""
    quote, space = r"^[ \t]*(?:>[ \t]?)+", r"[ \t\r\n\f\x0b]+"
    lvl = lambda x: f"length(regexp_replace(regexp_extract({x}, '{quote}'), '[^>]', '', 'g'))"
    norm = lambda x: f"trim(regexp_replace(lower({x}), '{space}', ' ', 'g'), ' ')"
    unit = lambda x: f"list_distinct(list_filter(list_transform(list_concat(regexp_split_to_array({x}, '\\n[ \\t\\r\\f\\x0b]*\\n'), string_split({x}, chr(10))), lambda x: {norm('x')}), lambda x: x <> ''))"
    return f"""
WITH RECURSIVE src AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, string_split(coalesce(text, ''), chr(10)) AS lines FROM {table}),
lv AS (SELECT *, list_transform(lines, lambda x: {lvl('x')}) AS levels FROM src),
parsed AS (
  SELECT conv_id, turn, role, lines, levels, list_max(levels) AS depth,
    CAST(len(list_filter(levels, lambda x: x > 0)) AS BIGINT) AS n_quoted,
    regexp_replace(array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: levels[i] = 0 AND NOT (
      regexp_matches(lines[i], '{ANNOUNCES}') AND coalesce(levels[i + 1], 0) > 0)), lambda i: lines[i]), chr(10)),
      '^[ \\t\\r\\n\\f\\x0b]+|[ \\t\\r\\n\\f\\x0b]+$', '', 'g') AS clean_text
  FROM lv),
lev AS (SELECT conv_id, turn, lines, levels, unnest(range(1, depth + 1)) AS level FROM parsed WHERE depth > 0),
said AS (SELECT conv_id, turn, level, array_to_string(list_transform(range(1, len(lines) + 1),
    lambda i: CASE WHEN levels[i] = level THEN regexp_replace(lines[i], '{quote}', '') ELSE '' END), chr(10)) AS body FROM lev),
quoted AS (SELECT DISTINCT conv_id, turn, level, unnest({unit('body')}) AS u FROM said),
own AS (SELECT conv_id, u, min(turn) AS original FROM (SELECT conv_id, turn, unnest({unit('clean_text')}) AS u FROM parsed) GROUP BY 1, 2),
hits AS (SELECT q.conv_id, q.turn, q.level, o.original, sum(length(q.u)) AS n FROM quoted q JOIN own o ON q.conv_id = o.conv_id AND q.u = o.u
  WHERE o.original < q.turn GROUP BY 1, 2, 3, 4),
links AS (SELECT conv_id, turn, arg_max(original, (-level, n, original)) AS r FROM hits GROUP BY 1, 2),
walk AS (SELECT conv_id, turn, r AS anc FROM links UNION ALL SELECT w.conv_id, w.turn, l.r FROM walk w JOIN links l ON w.conv_id = l.conv_id AND w.anc = l.turn),
threads AS (SELECT conv_id, turn, min(anc) AS root FROM walk GROUP BY 1, 2),
turns AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (SELECT DISTINCT conv_id, turn FROM parsed WHERE conv_id IS NOT NULL AND turn IS NOT NULL))
SELECT a.conv_id, a.turn, a.role, coalesce(l.r, b.p) AS reply_turn, l.r IS NOT NULL AS linked, coalesce(t.root, a.turn) AS thread_turn, a.n_quoted, a.clean_text
FROM parsed a LEFT JOIN links l ON a.conv_id = l.conv_id AND a.turn = l.turn
LEFT JOIN threads t ON a.conv_id = t.conv_id AND a.turn = t.turn LEFT JOIN turns b ON a.conv_id = b.conv_id AND a.turn = b.turn"""
