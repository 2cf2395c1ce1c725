"""Conversation repair: the cheapest edits that make a conversation's roles `(s?(ua)+)?`, as a fold over sorted turns.

Faults of a row come from windows. The turns of a conversation are collected in order as small structs and folded by
aggregate(): its state is the least (cost, audit) that ends at the start, after a system, a user or an assistant turn, and
each step is a least() over structs. An audit fixes roles and costs, and no audit of the same rows and cost is another's
beginning, so the least of each state is enough to go on from.

A long conversation is folded in blocks of BLOCK turns, each from all four states; blocks are joined by the same least().
The work so grows with the turns and not with their square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolith.llm import common, resampling

BLOCK = 512
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: At the start, or after a turn of the system, the user or the assistant.
STATES = ("start", "s", "u", "a")
BLANK_CHARS = " \t\n\x0b\x0c\r"
STOPS = (".", "!", "?")
PAIRS = ("su", "ua", "au")
ENTRY = "struct<cost:int,audit:string>"


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy, there: faults made by crc32(conv_id:turn) % 20; a dropped row stays as one that is not there."""
    filled = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", filled("conv_id"), filled("turn")).cast("binary")) % 20
    read = turns.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return read.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("kind") != 0).alias("there"))


def flagged(turns: DataFrame) -> DataFrame:
    """turns with position (from 1), initial, fault, illegal and fresh (the first row of its turn), by windows over one dealing by conv_id."""
    order = [F.asc_nulls_first("turn"), "role", "text", "copy"]
    w = Window.partitionBy("conv_id").orderBy("there", *order)
    same = Window.partitionBy("conv_id", "there", "hash", "role", "text").orderBy(*order)
    rows = turns.withColumns({"hash": F.xxhash64("text"), "initial": F.substring("role", 1, 1)})
    rows = rows.withColumns({"position": F.sum(F.col("there").cast("long")).over(w), "before": F.lag(F.when(F.col("there"), F.struct("initial", "turn"))).over(w), "again": F.row_number().over(same) > 1})
    tail = F.rtrim(F.col("text"), F.lit(BLANK_CHARS))
    fault = F.when(tail == "", "blank").when(F.col("again"), "duplicate").when(~F.right(tail, F.lit(1)).isin(*STOPS), "truncated")
    pair = F.concat("before.initial", "initial")
    fresh = F.col("turn").isNotNull() & ~F.coalesce(F.col("before.turn") == F.col("turn"), F.lit(False))
    return rows.select("conv_id", "turn", "role", "text", "there", "position", "initial", fault.alias("fault"), (F.col("before").isNotNull() & ~pair.isin(*PAIRS)).alias("illegal"), fresh.alias("fresh"))


# --- the fold -------------------------------------------------------------------------------------------------------


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def more(entry: Column, cost, edit: str) -> Column:
    """The entry with one edit more; null stays null, as a state that can't be reached."""
    return F.when(entry.isNotNull(), F.struct((entry["cost"] + cost).alias("cost"), F.concat(entry["audit"], F.lit(edit)).alias("audit")))


def four(*entries: Column) -> Column:
    return F.struct(*[e.cast(ENTRY).alias(s) for s, e in zip(STATES, entries, strict=True)])


def with_inserts(states: Column) -> Column:
    """The four entries once empty turns may stand before the next one."""
    ins = lambda e: more(e, INSERT, "I")
    user = F.least(states["u"], ins(states["start"]), ins(states["s"]), ins(states["a"]))
    return bound(user, lambda u: four(states["start"], states["s"], u, F.least(states["a"], ins(u))))


def step(states: Column, turn: Column) -> Column:
    """The four entries after one turn."""
    extra = F.when(turn["fault"] == "truncated", TRUNCATED).otherwise(0)
    stays = ~F.coalesce(turn["fault"].isin("blank", "duplicate"), F.lit(False))
    gone = lambda e: more(e, DELETE, "D")
    kept = lambda e, initial: F.when(stays & (turn["initial"] == initial), more(e, extra + KEEP, "K"))
    turned = lambda e: F.when(stays, more(e, extra + REROLE, "R"))

    def after(b: Column) -> Column:
        to_user = [b["start"], b["s"], b["a"]]
        return four(
            gone(b["start"]),
            F.least(gone(b["s"]), kept(b["start"], "s")),
            F.least(gone(b["u"]), *[kept(e, "u") for e in to_user], *[turned(e) for e in to_user]),
            F.least(gone(b["a"]), kept(b["u"], "a"), turned(b["u"])),
        )

    return bound(with_inserts(states), after)


def started(state: str) -> Column:
    nothing = F.lit(None).cast(ENTRY)
    return four(*[F.struct(F.lit(0).alias("cost"), F.lit("").alias("audit")) if s == state else nothing for s in STATES])


def folded(turns: Column, state: str) -> Column:
    """Entries at the end of an array of (initial, fault) structs that began in the state."""
    return F.aggregate(turns, started(state), step)


def joined(blocks: Column) -> Column:
    """Entries at the end of blocks, each of which has the entries from every state it may begin in."""

    def add(states: Column, block: Column) -> Column:
        def cat(a: Column, b: Column) -> Column:
            return F.when(a.isNotNull() & b.isNotNull(), F.struct((a["cost"] + b["cost"]).alias("cost"), F.concat(a["audit"], b["audit"]).alias("audit")))

        return four(*[F.least(*[cat(states[m], block[m][t]) for m in STATES]) for t in STATES])

    return F.aggregate(blocks, started("start"), add)


def cheapest(states: Column) -> Column:
    """The least entry that may end the conversation."""
    ins = lambda e: more(e, INSERT, "I")
    return F.least(states["start"], states["a"], ins(states["u"]), ins(ins(states["s"])))


def mended(turns: Column, audit: Column) -> Column:
    """Lines `role:text` after the edits; roles of new and changed turns follow from their place."""
    edits = F.regexp_extract_all(audit, F.lit("(I*[KRD])"), 1)
    line = "struct<role:string,text:string>"
    empty = F.struct(F.lit(None).cast("string").alias("role"), F.lit("").alias("text")).cast(line)

    def lines(turn: Column, edit: Column) -> Column:
        last = F.right(edit, F.lit(1))
        own = F.struct(F.when(last == "K", turn["role"]).alias("role"), turn["text"].alias("text")).cast(line)
        return F.concat(F.array_repeat(empty, F.length(edit) - 1), F.when(last == "D", F.array().cast(f"array<{line}>")).otherwise(F.array(own)))

    behind = F.array_repeat(empty, F.length(F.regexp_extract(audit, "(I*)$", 1)))
    every = F.concat(F.flatten(F.zip_with(turns, edits, lines)), behind)
    return bound(every, lambda e: bound(F.coalesce(F.startswith(F.get(e, F.lit(0))["role"], F.lit("s")).cast("int"), F.lit(0)), lambda system: F.transform(
        e, lambda x, i: F.concat_ws(":", F.coalesce(x["role"], F.when((i - system) % 2 == 0, "user").otherwise("assistant")), x["text"])
    )))


def repaired(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of turns as flagged() gives them.

    One dealing by conv_id serves windows, blocks and conversations. Audit and repaired text are single values, so all rows
    of a conversation meet in the task that returns them; only (initial, fault) structs are folded, a block at a time.
    """
    turn = F.struct("position", "initial", "fault", "role", "text")
    count = lambda c: F.count_if(F.col("there") & c)
    parts = turns.groupBy("conv_id", F.floor((F.col("position") - 1) / block).alias("block")).agg(
        F.array_sort(F.collect_list(F.when(F.col("there"), turn))).alias("turns"), count(F.col("fresh")).alias("fresh"), count(F.col("illegal")).alias("illegal"),
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")], F.min(F.when(F.col("there"), F.col("turn"))).alias("low"), F.max(F.when(F.col("there"), F.col("turn"))).alias("high"),
    )
    # the first block begins at the start, the others in any state
    begun = F.struct(*[(F.when(F.col("block") > 0, folded(F.col("turns"), s)) if s != "start" else folded(F.col("turns"), s)).alias(s) for s in STATES])
    parts = parts.withColumn("ends", begun)
    sums = ("fresh", "illegal", "blank", "duplicate", "truncated")
    whole = parts.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.size("turns") > 0, F.struct("block", "turns", "ends")))).alias("blocks"), *[F.sum(n).alias(n) for n in sums], F.min("low").alias("low"), F.max("high").alias("high"))
    found = whole.withColumn("best", cheapest(joined(F.transform("blocks", lambda b: b["ends"]))))
    lines = mended(F.flatten(F.transform("blocks", lambda b: b["turns"])), F.col("best.audit"))
    return found.select(
        "conv_id", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("fresh"), F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        F.col("best.cost").cast("long").alias("cost"), F.col("best.audit").alias("audit"), F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"),
    )


def repair(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Damage the turns, then repair each conversation; one row per conv_id, a null one included.

    Null roles and texts are one space, in the damage's key null identifiers and turns as well; null turns go first and don't
    count as gaps. Rows of equal turn are ordered by role, then text. A repeated row is a duplicate wherever it stands. Very
    long texts are kept whole; empty ones are blank. A conversation that loses all rows has zeros, an empty audit and the
    hash of an empty text. An empty table gives no rows; other columns are ignored.
    """
    return repaired(flagged(damaged(common.no_clash(turns, "conv_id", "turn", "role", "text"))), block)


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(common.table(spark, sf_dir, "conversations"))


# --- the same in SQL: entries are strings of a nine-digit cost and the audit, so that least() compares both --------------


def _more(entry: str, cost: str, edit: str) -> str:
    return f"(lpad((substr({entry}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({entry}, 10) || '{edit}')"


def _kept(entry: str, initial: str) -> str:
    return f"CASE WHEN stays AND initial = '{initial}' THEN {_more(entry, 'extra', 'K')} END"


def _turned(entry: str) -> str:
    return f"CASE WHEN stays THEN {_more(entry, '3 + extra', 'R')} END"


_USER = f"least(u, {_more('b', '3', 'I')}, {_more('s', '3', 'I')}, {_more('a', '3', 'I')})"
ORACLE = f"""WITH RECURSIVE {resampling.CRC_TABLE},
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT k, {resampling.crc_sql("k")} % 20 AS kind FROM (SELECT DISTINCT k FROM raw) CROSS JOIN crc_),
hit AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM raw JOIN kinds USING (k) WHERE kind <> 0),
rows_ AS (SELECT *, left(role, 1) AS initial, row_number() OVER v AS pos, lag(left(role, 1)) OVER v AS was, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tail
  FROM hit WINDOW v AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
faults AS (SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM rows_),
ready AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS extra FROM faults),
fold AS (SELECT DISTINCT conv_id, 0::BIGINT AS pos, '000000000' AS b, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM ready
  UNION ALL SELECT conv_id, pos, {_more("b", "4", "D")}, least({_more("s", "4", "D")}, {_kept("b", "s")}), least({_more("u", "4", "D")}, {_kept("b", "u")}, {_kept("s", "u")}, {_kept("a", "u")}, {_turned("b")}, {_turned("s")}, {_turned("a")}), least({_more("a", "4", "D")}, {_kept("u", "a")}, {_turned("u")})
  FROM (SELECT conv_id, pos, initial, stays, extra, b, s, u, least(a, {_more("u", "3", "I")}) AS a FROM (SELECT f.conv_id, r.pos, initial, stays, extra, b, s, {_USER} AS u, a FROM fold f JOIN ready r ON r.conv_id = f.conv_id AND r.pos = f.pos + 1))),
best AS (SELECT conv_id, least(b, a, {_more("u", "3", "I")}, {_more(_more("s", "3", "I"), "3", "I")}) AS e FROM fold JOIN (SELECT conv_id, max(pos) AS pos FROM ready GROUP BY 1) USING (conv_id, pos)),
edits AS (SELECT conv_id, substr(e, 1, 9)::BIGINT AS cost, substr(e, 10) AS audit FROM best),
toks AS (SELECT conv_id, unnest(regexp_extract_all(audit, 'I*[KRD]')) AS tok, generate_subscripts(regexp_extract_all(audit, 'I*[KRD]'), 1) AS pos FROM edits),
new_ AS (SELECT conv_id, pos, unnest(range(length(tok) - 1)) AS sub, NULL AS role, '' AS text FROM toks
  UNION ALL SELECT conv_id, pos, 1000000, CASE WHEN right(tok, 1) = 'K' THEN role END, text FROM toks JOIN ready USING (conv_id, pos) WHERE right(tok, 1) <> 'D'
  UNION ALL SELECT conv_id, 1000000000, unnest(range(length(regexp_extract(audit, 'I*$')))), NULL, '' FROM edits),
numbered AS (SELECT *, row_number() OVER v AS j, coalesce(first_value(role) OVER v LIKE 's%', false) AS system FROM new_ WINDOW v AS (PARTITION BY conv_id ORDER BY pos, sub)),
texts AS (SELECT conv_id, string_agg(coalesce(role, CASE WHEN (j - system::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY j) AS body FROM numbered GROUP BY 1),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE was || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM ready GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted USING (conv_id) LEFT JOIN edits USING (conv_id) LEFT JOIN texts USING (conv_id)"""
