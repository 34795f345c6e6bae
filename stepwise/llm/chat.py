"""Reply-ordered conversations from messages that quote each other.

Lines that start with ``>`` are quoted, once for each ``>``; runs of lines of one level are a
passage.  The lines of a level, and the messages' own lines, are normalised (lower case, single
spaces) and cut into sentences, so that other line breaks do not matter, and sentences are compared
by hash.  A sentence that goes on over passages or lines, as text without full stops does, is also
known by its parts: the part in each passage, and of that the part on each line.  A quoted sentence
comes from the latest earlier message of its conversation that has it among its own; one that no
message has is looked up by its passages, and those that no message has by their lines.  A message
replies to the one from which most sentences or parts of its outermost quotation come.

Replies form trees.  A conversation reads tree by tree, by ``root_turn`` and then ``turn``, which
puts every message behind the one it replies to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepwise.llm.shared import saved

_MARKS = r"^\s*>[>\s]*"
_LINES = r"\r\n|\r|\n"


def lines(text: Column) -> Column:
    """The lines of a text with their quote levels."""
    marks = lambda line: F.regexp_extract(line, _MARKS, 0)
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), _LINES),
        lambda line: F.struct(
            F.length(F.regexp_replace(marks(line), r"[^>]", "")).alias("level"),
            F.regexp_replace(line, _MARKS, "").alias("words"),
        ),
    )


def own_text(parsed: Column) -> Column:
    """The lines that are not quoted, without blank lines around them."""
    own = F.transform(F.filter(parsed, lambda p: p["level"] == 0), lambda p: p["words"])
    return F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")


def joined(parsed: Column, level: Column) -> Column:
    """The lines of one level, normalised, each after ``\\n``, or ``\\f`` where a passage starts."""
    led = F.transform(
        parsed,
        lambda p, i: F.struct(
            p["level"].alias("level"),
            F.concat(
                F.when((i > 0) & (F.get(parsed, i - 1)["level"] == p["level"]), "\n").otherwise("\f"),
                F.lower(F.regexp_replace(p["words"], r"\s+", " ")),
            ).alias("words"),
        ),
    )
    return F.array_join(F.transform(F.filter(led, lambda p: p["level"] == level), lambda p: p["words"]), "")


def sentences(text: Column) -> Column:
    """The sentences of joined lines, with the breaks inside them."""
    return F.filter(F.split(text, r"(?<=[.!?])[ \n\f]+"), lambda s: F.regexp_like(s, F.lit(r"[^ \n\f]")))


def _code(part: Column) -> Column:
    plain = F.trim(F.regexp_replace(part, r"[ \n\f]+", " "))
    return F.xxhash64(plain, F.length(plain))


def _cut(sentence: Column, at: str) -> Column:
    return F.filter(F.split(sentence, at), lambda s: F.regexp_like(s, F.lit(r"[^ \n\f]")))


def parts(sentence: Column) -> Column:
    """A sentence as (rank, passage, code): itself (0), its parts by passage (1) and by line (2).
    Parts that equal what they are part of are left out."""
    passages = _cut(sentence, r"\f")
    entry = lambda rank, n, part: F.struct(
        F.lit(rank).alias("rank"), n.alias("passage"), _code(part).alias("code")
    )
    by_passage = F.transform(passages, lambda p, n: entry(1, n, p))
    by_line = F.flatten(
        F.transform(
            passages,
            lambda p, n: F.when(F.size(_cut(p, r"\n")) > 1, F.transform(_cut(p, r"\n"), lambda x: entry(2, n, x)))
            .otherwise(F.slice(F.array(entry(2, n, p)), 1, 0)),
        )
    )
    return F.concat(
        F.array(entry(0, F.lit(0), sentence)),
        F.when(F.size(passages) > 1, by_passage).otherwise(F.slice(by_passage, 1, 0)),
        by_line,
    )


def quotations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, source_turn and sentences: quoted sentences, or parts of those not
    found, found in each earlier message, of messages(conv_id, turn, parsed).

    Own and quoted sentences of one hash meet in one ordered scan of their conversation, so a
    sentence that very many messages share makes no pairs.
    """
    keyed = messages.where("conv_id is not null and turn is not null")
    quoting = keyed.where(F.exists("parsed", lambda p: p["level"] > 0))
    levels = F.array_distinct(F.transform(F.filter("parsed", lambda p: p["level"] > 0), lambda p: p["level"]))
    # Rows of one conversation and turn have their sentences told apart by their text.
    quoted = (
        quoting.withColumn("message", F.xxhash64("parsed"))
        .withColumn("level", F.explode(levels))
        .select(
            "conv_id", "turn", "level", "message", F.posexplode(sentences(joined(F.col("parsed"), F.col("level"))))
        )
        .select("conv_id", "turn", "level", "message", F.col("pos").alias("nth"), F.inline(parts(F.col("col"))))
    )
    # Only conversations that quote need their own sentences.
    own = keyed.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi").select(
        "conv_id", "turn", F.explode(sentences(joined(F.col("parsed"), F.lit(0)))).alias("sentence")
    )
    own = own.select("conv_id", "turn", F.explode(parts(F.col("sentence"))["code"]).alias("code")).distinct()
    none = [F.lit(None).cast(quoted.schema[c].dataType).alias(c) for c in ("message", "nth", "rank", "passage")]
    own = own.select("conv_id", "turn", F.lit(0).alias("level"), *none, "code")
    earlier = Window.partitionBy("conv_id", "code").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    source = F.max(F.when(F.col("level") == 0, F.col("turn"))).over(earlier)
    # What a sentence, or its part in a passage, has found stands for the parts of it.
    sentence = Window.partitionBy("conv_id", "turn", "level", "message", "nth")
    passage = Window.partitionBy("conv_id", "turn", "level", "message", "nth", "passage")
    whole = F.max(F.when(F.col("rank") == 0, F.col("source_turn"))).over(sentence)
    most = F.max(F.when(F.col("rank") == 1, F.col("source_turn"))).over(passage)
    return (
        own.unionByName(quoted)
        .withColumn("source_turn", source)
        .where("level > 0 and source_turn is not null")
        .withColumn("whole", whole)
        .withColumn("most", most)
        .where("rank = 0 or whole is null and (rank = 1 or most is null)")
        .groupBy("conv_id", "turn", "level", "source_turn")
        .agg(F.count("*").alias("sentences"))
    )


def roots(replies: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, root_turn and depth of replies(conv_id, turn, parent_turn).

    Every round doubles the distance that a reply looks up; parents are earlier messages, so
    there are no cycles.
    """
    state = saved(
        replies.select("conv_id", "turn", "parent_turn", F.col("parent_turn").alias("root_turn"), F.lit(1).alias("depth"))
    )
    while True:
        above = state.select(
            "conv_id",
            F.col("turn").alias("root_turn"),
            F.col("root_turn").alias("next_root"),
            F.col("depth").alias("more"),
        )
        state = saved(
            state.join(above, ["conv_id", "root_turn"], "left").select(
                "conv_id",
                "turn",
                "parent_turn",
                F.coalesce("next_root", "root_turn").alias("root_turn"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                F.col("more").isNotNull().alias("moved"),
            )
        )
        if not state.where("moved").limit(1).count():
            return state.drop("moved")
        state = state.drop("moved")


def link(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, content, quote_levels, parent_turn, root_turn and depth of every row
    of conversations(conv_id, turn, role, text).

    content is the text without quotations.  Messages that quote nothing of their conversation
    have no parent and are roots of depth 0.  Null texts are empty; rows without conv_id or turn
    are roots.  Rows that repeat a conversation and turn are one message to the links.  Of sources
    with equally many sentences the latest counts.  Other columns are ignored; an empty table
    gives no rows.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    ).withColumn("parsed", lines(F.col("text")))
    found = saved(quotations(rows))
    outermost = Window.partitionBy("conv_id", "turn")
    parents = (
        found.withColumn("outer", F.min("level").over(outermost))
        .where("level = outer")
        .groupBy("conv_id", "turn")
        .agg(F.max(F.struct("sentences", "source_turn"))["source_turn"].alias("parent_turn"))
    )
    placed = roots(parents)
    levels = F.array_max(F.transform("parsed", lambda p: p["level"]))
    return (
        rows.select("conv_id", "turn", "role", own_text(F.col("parsed")).alias("content"), levels.alias("quote_levels"))
        .join(placed, ["conv_id", "turn"], "left")
        .select(
            "conv_id",
            "turn",
            "role",
            "content",
            "quote_levels",
            "parent_turn",
            F.coalesce("root_turn", "turn").alias("root_turn"),
            F.coalesce("depth", F.lit(0)).alias("depth"),
        )
    )


def ordered(linked: DataFrame) -> DataFrame:
    """Linked messages in the order in which conversations read, conversation by conversation."""
    return linked.repartition("conv_id").sortWithinPartitions("conv_id", "root_turn", "turn")
