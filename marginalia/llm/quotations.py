"""Quotation linking on DataFrame functions alone: which message answers which, and the conversations without quotes.

A message's body is read line by line. Leading ``>`` marks give a line's quote level, and what follows is a passage.
Passages are normalised (lower case, runs of anything but letters and digits become one space) and hashed. A message's
own passages, level 0, are its originals; quoted ones are joined to the originals of their conversation by hash. The
original of a hash is the first message that wrote it, one row a hash, so a passage that very many messages quote or
write joins to one row and makes no pairs. A message answers the one that wrote most of its level-1 passages (on a tie
the later one). Replies are then followed to the message that began the exchange by doubling: after n rounds every
message knows its ancestor 2^n steps up, so depth costs a logarithm of joins.

Defined cases: a null body is empty; a message without quotes, or whose quotes no earlier message of its conversation
wrote, begins an exchange of its own at depth 0; a passage without letters or digits links nothing; rows that repeat a
(conv_id, turn) answer alike; null conv_ids form one conversation, and null turns begin exchanges; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: A quote mark and the space after it, any number of times.
MARKS = r"^(?:> ?)*"
#: Rounds of doubling at most: exchanges of up to 2^40 replies.
MOST_ROUNDS = 40


def normalised(passage: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(passage), r"[^\p{L}\p{N}]+", " "))


def lines(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, at, level, passage, hash): a row for each line; hash null where the line has no letter or digit."""
    body = F.coalesce(F.col("body").cast("string"), F.lit(""))
    rows = messages.select("conv_id", "turn", F.posexplode(F.split(body, "\n")).alias("at", "line"))
    level = F.length(F.regexp_replace(F.regexp_extract("line", MARKS, 0), " ", ""))
    rows = rows.select("conv_id", "turn", "at", level.alias("level"), F.regexp_replace("line", MARKS, "").alias("passage"))
    norm = normalised(F.col("passage"))
    return rows.withColumn("hash", F.when(norm != "", F.md5(norm)))


def replies(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, n_quoted, n_linked, reply_to): for every message with quotes, its quoted lines, those that were found, and whom it answers."""
    first = parsed.filter("level = 0 and hash is not null").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    first = first.withColumnsRenamed({"conv_id": "o_conv", "hash": "o_hash"})
    quoted = parsed.filter("level > 0")
    met = quoted.join(first, F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("hash") == F.col("o_hash")) & (F.col("origin") < F.col("turn")), "left")
    votes = met.groupBy("conv_id", "turn", "origin").agg(F.count("*").alias("n"), F.count_if(F.col("level") == 1).alias("direct"))
    answered = F.max(F.when(F.col("origin").isNotNull() & (F.col("direct") > 0), F.struct("direct", "origin")))["origin"]
    return votes.groupBy("conv_id", "turn").agg(F.sum("n").alias("n_quoted"), F.sum(F.when(F.col("origin").isNotNull(), F.col("n")).otherwise(0)).alias("n_linked"), answered.alias("reply_to"))


def exchanges(links: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to) to (conv_id, turn, root, depth), by doubling the step up until no message has one left."""
    state = saved(links.select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("moved")))
    for _ in range(MOST_ROUNDS):
        higher = state.select(F.col("conv_id").alias("h_conv"), F.col("turn").alias("h_turn"), F.col("up").alias("h_up"), F.col("depth").alias("h_depth"))
        # a message whose step leads to a beginning is done: it is looked up, but looks up no more
        met = state.filter("moved").join(higher, F.col("conv_id").eqNullSafe(F.col("h_conv")) & (F.col("up") == F.col("h_turn")), "left")
        met = met.select("conv_id", "turn", F.coalesce("h_up", "up").alias("up"), (F.col("depth") + F.coalesce("h_depth", F.lit(0))).alias("depth"), F.col("h_up").isNotNull().alias("moved"))
        state = saved(state.filter("not moved").unionByName(met))
        if state.filter("moved").isEmpty():
            break
    return state.select("conv_id", "turn", F.col("up").alias("root"), "depth")


def link(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, body) to one row a message: conv_id, turn, role, root, depth, reply_to, n_quoted, n_linked, text.

    Ordered by conv_id, root, depth and turn the rows are the conversations in reply order; ``text`` has no quotes.
    """
    links = saved(replies(lines(messages).filter("turn is not null")))
    up = exchanges(links.filter("reply_to is not null"))
    facts = links.join(up.withColumnsRenamed({"conv_id": "u_conv", "turn": "u_turn"}), F.col("conv_id").eqNullSafe(F.col("u_conv")) & (F.col("turn") == F.col("u_turn")), "left")
    facts = facts.select(F.col("conv_id").alias("f_conv"), F.col("turn").alias("f_turn"), "reply_to", "n_quoted", "n_linked", "root", "depth")
    own = F.filter(F.split(F.coalesce(F.col("body").cast("string"), F.lit("")), "\n"), lambda line: ~line.startswith(">"))
    return (
        messages.select("conv_id", "turn", "role", F.array_join(own, "\n").alias("text"))
        .join(facts, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("turn") == F.col("f_turn")), "left")
        .select("conv_id", "turn", "role", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "reply_to", F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "text")
    )


def as_mail(conversations: DataFrame) -> DataFrame:
    """Turns as mail bodies: each quotes the turn before it, and that one's quote a level deeper. The tables hold no quotes of their own."""
    turns = conversations.select("conv_id", "turn", "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def before(steps: int, marks: str) -> Column:
        return F.concat(F.lit(marks), F.replace(F.col(f"t{steps}"), F.lit("\n"), F.lit("\n" + marks)))

    joined = turns
    for steps in (1, 2):
        other = turns.groupBy("conv_id", "turn").agg(F.max("text").alias(f"t{steps}")).select(F.col("conv_id").alias(f"c{steps}"), (F.col("turn") + steps).alias(f"n{steps}"), f"t{steps}")
        joined = joined.join(other, (F.col("conv_id") == F.col(f"c{steps}")) & (F.col("turn") == F.col(f"n{steps}")), "left")
    return joined.select("conv_id", "turn", "role", F.concat_ws("\n", before(2, ">> "), before(1, "> "), "text").alias("body"))


def query(spark, sf_dir: str) -> DataFrame:
    linked = link(as_mail(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return linked.select("conv_id", "turn", "role", "root", "depth", "reply_to", "n_quoted", "n_linked", F.sha2("text", 256).alias("text_sha256"))


#: The same over the turns themselves. A quoted line's origin is the first turn that wrote its normalised form.
SQL = r"""
with recursive t as (select distinct conv_id, turn, role, coalesce(text, '') x from conversations),
own as (select conv_id, turn, unnest(string_split(x, chr(10))) line from t),
n as (select *, trim(regexp_replace(lower(line), '[^\p{L}\p{N}]+', ' ', 'g')) h from own),
origin as (select conv_id, h, min(turn) o from n where h <> '' group by all),
q as (select t.conv_id, t.turn, 1 lev, n.h from t join n on n.conv_id = t.conv_id and n.turn = t.turn - 1
      union all select t.conv_id, t.turn, 2, n.h from t join n on n.conv_id = t.conv_id and n.turn = t.turn - 2),
m as (select q.conv_id, q.turn, q.lev, o from q left join origin g on g.conv_id = q.conv_id and g.h = q.h and g.o < q.turn),
v as (select conv_id, turn, o, count(*) c, count(*) filter (lev = 1) d from m group by all),
r as (select conv_id, turn, sum(c) n_quoted, sum(case when o is not null then c else 0 end) n_linked,
             max(case when o is not null and d > 0 then {'d': d, 'o': o} end).o reply_to from v group by all),
w as (select conv_id, turn, turn cur, 0 depth from t
      union all select w.conv_id, w.turn, r.reply_to, w.depth + 1 from w join r on r.conv_id = w.conv_id and r.turn = w.cur where r.reply_to is not null),
b as (select conv_id, turn, max_by(cur, depth) root, max(depth) depth from w group by all)
select t.conv_id, t.turn, t.role, b.root, cast(b.depth as bigint) depth, r.reply_to, cast(coalesce(r.n_quoted, 0) as bigint) n_quoted,
       cast(coalesce(r.n_linked, 0) as bigint) n_linked, sha256(t.x) text_sha256
from t join b using (conv_id, turn) left join r using (conv_id, turn)
"""
