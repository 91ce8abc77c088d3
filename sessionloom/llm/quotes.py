"""Operator 6: quotation linking in message conversations, in DataFrame and SQL operations only.

1. A line's quote level is the number of ``>`` it starts with. Neighbouring lines of one level make a passage.
2. Passages, and the lines in them, are normalised (lower case, runs of other than letters and digits to one space) and
   hashed; so are each message's own words: whole, by paragraph and by line.
3. Equal hashes link a passage to the message it quotes: the latest earlier turn of its own conversation, else the
   first message of all others with that hash; a whole passage counts before its longest line. Originals are reduced
   to one per hash and conversation, and to one per hash, before they meet passages: a common text makes no pairs.
4. A message replies to what its first passage of the lowest linked level quotes. Conversations linked across are one
   thread. A message comes after what it replies to, one that replies to nothing after the turn before it: ``depth`` is
   its distance to the start of that chain, ``position`` its number, from 0, in its thread by depth, conversation and
   turn. Where conversations quote each other in a circle, the circle's first message starts the chain.
5. The text of a message goes on without quoted lines and the attribution line before them.

Cases: null texts are empty; passages without letters or digits link to nothing; quotes of unknown text have no target;
rows of one conversation and turn are one message with the passages of all their texts, and each is returned; null
conversations and turns are one of their own and stay null; empty tables give no rows; other columns are ignored. An
unquoted message is unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._work import NO_ID, Workspace, numbered, shuffle_width
from .components import connected_components

QUOTE = r"^(?:[ \t]*>)+"
#: The line before a quotation, in four languages.
ATTRIBUTION = r"^[ \t]*(?:On .* wrote|Am .* schrieb.*|Le .* a écrit|El .* escribió)[ \t]*:[ \t]*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def link_quotations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, n_quoted_lines, n_passages, n_linked, reply_conv, reply_turn, thread_id, is_reply, depth, position)."""
    work = Workspace(messages.sparkSession, "quotes")
    ids = (F.coalesce(F.col(c).cast("long"), F.lit(NO_ID)).alias(name) for c, name in ((conv, "conv_id"), (turn, "turn")))
    rows = messages.select(*ids, F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("lines", F.split("text", "\n"))
    level = f"length(regexp_replace(regexp_extract(l, '{QUOTE.replace(chr(92), chr(92) * 2)}', 0), '[^>]', ''))"
    rows = rows.withColumn("levels", F.expr(f"transform(lines, l -> {level})")).withColumn("n_quoted_lines", F.expr("size(filter(levels, x -> x > 0))").cast("long"))
    attributed = ATTRIBUTION.replace("\\", "\\\\")
    own = f"filter(lines, (l, i) -> get(levels, i) = 0 AND NOT (coalesce(get(levels, i + 1), 0) > 0 AND l rlike '{attributed}'))"
    rows = rows.withColumn("body", F.when(F.col("n_quoted_lines") > 0, F.regexp_replace(F.array_join(F.expr(own), "\n"), r"^\n+|\n+$", "")).otherwise(F.col("text")))
    kept = ["conv_id", "turn", "role", "text", "body", "n_quoted_lines"]
    every = work.save(rows, "rows")
    # of repeated (conv_id, turn) the passages of all texts count together; each text is read once
    rows = every.select("conv_id", "turn", "text", "body", "lines", "levels", "n_quoted_lines", F.sha2("text", 256).alias("digest"))
    if not every.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        rows = rows.dropDuplicates(["conv_id", "turn", "digest"])

    units = F.array_distinct(F.concat(F.array("body"), F.split("body", r"\n[ \t]*\n"), F.split("body", "\n")))
    originals = rows.select("conv_id", "turn", F.explode(units).alias("unit")).select("conv_id", "turn", normalised(F.col("unit")).alias("unit")).filter("unit <> ''").select("conv_id", "turn", F.sha2("unit", 256).alias("hash")).distinct()

    quoted = rows.filter("n_quoted_lines > 0").select("conv_id", "turn", "digest", F.posexplode(F.arrays_zip("lines", "levels")).alias("at", "l")).select("conv_id", "turn", "digest", "at", F.col("l.lines").alias("line"), F.col("l.levels").alias("level"))
    by_line = Window.partitionBy("conv_id", "turn", "digest").orderBy("at")
    quoted = quoted.withColumn("new", (F.col("level") != F.coalesce(F.lag("level").over(by_line), F.lit(0))).cast("int")).withColumn("passage", F.sum("new").over(by_line.rowsBetween(Window.unboundedPreceding, 0))).filter("level > 0")
    quoted = work.save(quoted.select("conv_id", "turn", "digest", "passage", "level", "at", F.trim(F.regexp_replace("line", QUOTE, "")).alias("line")), "quoted")
    whole = quoted.groupBy("conv_id", "turn", "digest", "passage", "level").agg(F.expr("array_join(transform(array_sort(collect_list(struct(at, line))), x -> x.line), '\n')").alias("unit"))
    keys = whole.drop("digest").withColumn("whole", F.lit(1)).unionByName(quoted.select("conv_id", "turn", "passage", "level", F.col("line").alias("unit"), F.lit(0).alias("whole")))
    keys = keys.withColumn("unit", normalised(F.col("unit"))).filter("unit <> ''").select("conv_id", "turn", "passage", "level", "whole", F.length("unit").alias("size"), F.sha2("unit", 256).alias("hash"))
    keys = work.save(keys, "keys")

    # only hashes that some passage has stay, reduced by partial aggregation
    met = work.save(originals.join(keys.select("hash").distinct(), "hash", "left_semi"), "met")
    inside = keys.join(met.select("hash", "conv_id", F.col("turn").alias("to_turn")), ["hash", "conv_id"]).filter("to_turn < turn")
    inside = inside.groupBy("conv_id", "turn", "passage", "level", "whole", "size", "hash").agg(F.max("to_turn").alias("to_turn")).withColumn("to_conv", F.col("conv_id"))
    firsts = _two_firsts(met)
    across = keys.join(firsts, "hash").withColumn("to", F.expr("CASE WHEN first.conv_id <> conv_id THEN first ELSE second END")).filter("to IS NOT NULL")
    across = across.select("conv_id", "turn", "passage", "level", "whole", "size", F.col("to.conv_id").alias("to_conv"), F.col("to.turn").alias("to_turn"), F.lit(0).alias("near"))
    linked = inside.select("conv_id", "turn", "passage", "level", "whole", "size", "to_conv", "to_turn", F.lit(1).alias("near")).unionByName(across)
    linked = linked.groupBy("conv_id", "turn", "passage", "level").agg(F.max(F.struct("near", "whole", "size", "to_turn", "to_conv")).alias("to"))
    linked = work.save(linked.select("conv_id", "turn", "passage", "level", "to.to_conv", "to.to_turn"), "linked")

    reply = linked.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_linked"), F.min(F.struct("level", "passage", "to_conv", "to_turn")).alias("to"))
    passages = whole.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_passages"))
    threads = connected_components(linked.filter("to_conv <> conv_id").select(F.col("conv_id").alias("a"), F.col("to_conv").alias("b")).distinct(), work, "threads")
    reply = work.save(reply, "reply")
    depths = chain_depths(rows.select("conv_id", "turn").distinct(), reply, work)
    out = every.join(passages, ["conv_id", "turn"], "left").join(reply, ["conv_id", "turn"], "left").join(threads.withColumnRenamed("node", "conv_id"), "conv_id", "left").join(depths, ["conv_id", "turn"], "left")
    out = out.withColumn("depth", F.coalesce("depth", F.lit(0))).withColumn("thread", F.coalesce("component", "conv_id"))
    out = numbered(out.select(*kept, "n_passages", "n_linked", "to", "thread", "depth"), ["depth", "conv_id", "turn", "role", "text"], work, "parts", "thread")
    known = lambda column: F.nullif(column, F.lit(NO_ID))
    return out.select(
        known(F.col("conv_id")).alias(conv), known(F.col("turn")).alias(turn), F.col("role").alias(role), F.col("body").alias(text), "n_quoted_lines", F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        known(F.col("to.to_conv")).alias("reply_conv"), known(F.col("to.to_turn")).alias("reply_turn"), known(F.col("thread")).alias("thread_id"),
        F.col("to").isNotNull().alias("is_reply"), "depth", F.col("number").alias("position"),
    )


def chain_depths(nodes: DataFrame, reply: DataFrame, work: Workspace) -> DataFrame:
    """(conv_id, turn, depth) of messages (conv_id, turn): steps along replies ``to``, else the turn before, to the chain's start.

    Each round doubles the steps that a message knows (``up``, ``depth``); ``low`` is the first message among them. When
    neither the open messages nor their ``low`` change, the open ones lead into circles; a circle's first message sees
    itself as ``low`` and becomes a start. Messages whose start is known are not joined again.
    """
    before = F.lag(F.struct("conv_id", "turn")).over(Window.partitionBy("conv_id").orderBy("turn"))
    state = nodes.withColumn("before", before).join(reply.select("conv_id", "turn", F.struct("to.to_conv", "to.to_turn").cast("struct<conv_id:bigint,turn:bigint>").alias("target")), ["conv_id", "turn"], "left")
    first = state = work.save(state.select(F.struct("conv_id", "turn").alias("node"), F.coalesce("target", "before").alias("up")), "chains")
    start = lambda df: df.select("node", "up", F.col("up").isNotNull().cast("long").alias("depth"), F.col("up").alias("low"))
    state, seen, round_no = start(first), None, 0
    while True:
        state = work.save(state, f"chains-{round_no}")
        now = state.filter("up IS NOT NULL").agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "low").cast("decimal(38,0)"))).first()
        if not now[0]:
            return state.select("node.conv_id", "node.turn", "depth")
        round_no += 1
        ended, going = state.filter("up IS NULL"), state.filter("up IS NOT NULL")
        if now == seen:
            again = first.join(going.select("node", (F.col("low") == F.col("node")).alias("cut")), "node").select("node", F.when(~F.col("cut"), F.col("up")).alias("up"))
            state, seen = ended.unionByName(start(again)), None
            continue
        seen, done = now, state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("low").alias("lower"))
        going = going.join(done, "up", "left").select("node", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.least("low", "lower").alias("low"))
        state = ended.unionByName(going)


def _two_firsts(met: DataFrame) -> DataFrame:
    """(hash, first, second): the first messages of the two first conversations that have a hash."""
    first = met.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    second = met.join(first, "hash").filter("conv_id <> first.conv_id").groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("second"))
    return first.join(second, "hash", "left")


def write_conversations(linked: DataFrame, path: str) -> None:
    """The messages as Parquet in reading order, thread after thread, dealt out by ranges: a thread of any size needs no task of its own."""
    linked.repartitionByRange(shuffle_width(linked.sparkSession), "thread_id", "position").sortWithinPartitions("thread_id", "position").write.parquet(path)
