"""Chat formatting by quotation linking, in DataFrame functions.

Lines of a message that start with ``>`` are quotes, nested as deep as marks
stand there. Runs of lines of one level are passages. Passages and the unquoted
text of messages are normalised and hashed, whole and by their lines, pairs of
lines that follow one another, and sentences, so that excerpts and re-wrapped or
edited passages are found by what is left of them. Each hash of a passage is
joined to the earliest message that holds it, in its own conversation or else
in any other; the passage comes from the message with the longest match, then
the most. A message replies to the message that its shallowest quote comes from;
without a known quote it keeps its place. The quotes are taken out. Replies of a
conversation form trees; a conversation is read tree by tree, each message ahead
of the replies to it.

Nothing is gathered by conversation or tree: earliest messages are minima by
hash, places are counted over ranges of a sorted table, and a tree's order comes
from the walk around it, a linked list whose links are doubled until all have
met its end. So one conversation, tree, message or passage may hold any share of
the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Written, read

_MARK = r"^[ \t]*((?:>[ \t]?)+)"


def _lines(text: Column) -> Column:
    """Array of (level, text) of a message's lines, markers stripped."""
    return F.transform(
        F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _MARK, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, _MARK, "").alias("line")),
    )


def _passages(lines: Column) -> Column:
    """Array of (level, text) of runs of lines of one level, in one pass over the text."""
    before = F.concat(F.array(F.lit(-1)), F.transform(lines, lambda x: x["level"]))
    start = lambda x: F.concat(F.lit("\x01"), x["level"].cast("string"), F.lit("\x02"))
    marked = F.zip_with(lines, before, lambda x, p: F.concat(F.when(x["level"] == p, F.lit("\n")).otherwise(start(x)), F.translate(x["line"], "\x01\x02", "  ")))
    runs = F.filter(F.split(F.array_join(marked, ""), "\x01"), lambda x: x != "")
    return F.transform(runs, lambda x: F.struct(F.substring_index(x, "\x02", 1).cast("int").alias("level"), F.substring(x, F.instr(x, "\x02") + F.lit(1), F.length(x)).alias("line")))


def normal(text: Column) -> Column:
    """A passage without case, marks and differences of white space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _parts(text: Column) -> Column:
    """(h, n), hash and length, of a text, its lines, pairs of lines and sentences; of what has words."""
    full = lambda parts: F.filter(F.transform(parts, normal), lambda x: x != "")
    lines = full(F.split(text, "\n"))
    pairs = F.filter(F.zip_with(lines, F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x, y: F.concat(x, F.lit(" "), y)), lambda x: x.isNotNull())
    sentences = F.split(text, r"(?<=[.!?…])\s+|(?<=[。！？｡])\s*|\n\s*\n")
    return F.transform(F.concat(full(F.array(text)), lines, pairs, full(sentences)), lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("n")))


def link_quotes(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, Written]:
    """(uid, conv, turn, role, text, n_quotes, max_level, reply_to_conv, reply_to_turn) of each row.

    text is without quotes. A quote never links to its own turn or, within the
    conversation, to a later one. Null texts are empty. Null conversations or
    turns link to nothing. uid is unique.
    """
    store = Written(messages.sparkSession)
    rows = messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("whole"))
    has = F.coalesce(F.col("whole").rlike(r"(?m)" + _MARK), F.lit(False))
    lines = F.when(has, _lines(F.col("whole")))
    split = rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("lines", lines)
    own = F.when(F.col("lines").isNull(), F.coalesce("whole", F.lit(""))).otherwise(F.regexp_replace(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n"), r"^\s+|\s+$", ""))
    passages = F.when(F.col("lines").isNotNull(), F.filter(_passages(F.col("lines")), lambda p: (p["level"] > 0) & (F.trim(p["line"]) != "")))
    split = store.write(split.select("uid", "conv", "turn", "role", own.alias("text"), passages.alias("quotes")))
    # What quotes ask for: the hashes of passages and their parts.
    asked = split.where(F.size("quotes") > 0).where("conv is not null and turn is not null").select("uid", "conv", "turn", F.posexplode("quotes").alias("at", "q"))
    asked = store.write(asked.select("uid", "conv", "turn", "at", "q.level", F.explode(_parts(F.col("q.line"))).alias("x")).select("uid", "conv", "turn", "at", "level", "x.h", "x.n").distinct())
    out = split.select("uid", "conv", "turn", "role", "text", F.coalesce(F.size("quotes"), F.lit(0)).alias("n_quotes"), F.coalesce(F.array_max(F.transform("quotes", lambda q: q["level"])), F.lit(0)).alias("max_level"))
    # What is joined by hash is written: with plain exchanges on both sides a hot hash can be split.
    wanted = store.write(asked.select("h").distinct())
    held = split.where("conv is not null and turn is not null").select("conv", "turn", F.explode(_parts(F.col("text"))).alias("x")).select("conv", "turn", "x.h").join(wanted, "h", "left_semi")
    here = store.write(held.groupBy("conv", "h").agg(F.min("turn").alias("t")))
    first = store.write(here.groupBy("h").agg(F.min(F.struct(F.col("conv").alias("c"), "t")).alias("a")))
    # The next conversation, for what is asked from the first one.
    again = store.write(asked.join(first, "h").where("conv = a.c").select("h", F.col("a.c").alias("not")).distinct())
    second = here.join(again, "h").where("conv <> not").groupBy("h").agg(F.min(F.struct(F.col("conv").alias("c"), "t")).alias("b"))
    both = store.write(first.join(second, "h", "left"))
    hits = asked.join(here, ["conv", "h"], "left").join(both, "h", "left")
    near = F.when(F.col("t") < F.col("turn"), F.struct(F.col("conv").alias("c"), F.col("t").alias("t")))
    far = F.when(F.col("a.c") != F.col("conv"), F.col("a")).otherwise(F.col("b"))
    hits = hits.withColumn("to", F.coalesce(near, far)).where("to is not null").withColumn("away", F.col("to.c") != F.col("conv"))
    votes = hits.groupBy("uid", "level", "at", "away", "to").agg(F.max("n").alias("longest"), F.sum("n").alias("most"))
    sources = votes.groupBy("uid", "level", "at").agg(F.min(F.struct((-F.col("longest")).alias("l"), (-F.col("most")).alias("m"), "away", "to.c", "to.t")).alias("x"))
    found = sources.groupBy("uid").agg(F.min(F.struct("x.away", "level", "at", "x.c", "x.t")).alias("best")).select("uid", F.col("best.c").alias("reply_to_conv"), F.col("best.t").alias("reply_to_turn"))
    return out.join(found, "uid", "left"), store


def placed(rows: DataFrame, store: Written, group: list[str], order: list[str]) -> DataFrame:
    """rows with place (from 0) within group by order, and n_rows of the group.

    Rows are sorted by range over all partitions; places count on from the ranges
    before, so a large group is spread over many tasks.
    """
    tasks = max(int(store.spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = store.write(rows.repartitionByRange(tasks, *group, *order).withColumn("__part", F.spark_partition_id()))
    inner = ranged.withColumn("__rank", F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*order)))
    sums = ranged.groupBy(*group, "__part").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*group)
    before = sums.select(*(F.col(c).alias(f"__{c}") for c in group), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(w).alias("n_rows"))
    on = F.col("__part") == F.col("__p")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return inner.join(before, on).withColumn("place", F.col("__rank") - 1 + F.col("__before")).drop("__part", "__rank", "__p", "__before", *(f"__{c}" for c in group))


def _walked(rows: DataFrame, store: Written) -> DataFrame:
    """(uid, root, left) of rows (uid, conv, turn, ord, reply_to_conv, reply_to_turn) in reply trees of several messages.

    root: uid of the tree's first message; left: messages of the tree from this
    one on, in the order of the walk. Replies to one message go by ord. A reply to
    a turn that has several rows belongs to the last of them.
    """
    asks = rows.where("reply_to_conv = conv").select("uid", "ord", "conv", F.col("reply_to_turn").alias("turn"))
    wanted = store.write(asks.select("conv", "turn").distinct())
    last = store.write(rows.select("uid", "ord", "conv", "turn").join(wanted, ["conv", "turn"]).groupBy("conv", "turn").agg(F.max_by("uid", "ord").alias("parent")))
    children = store.write(asks.join(last, ["conv", "turn"]).select("uid", "ord", "parent"))
    ranked = store.write(placed(children, store, ["parent"], ["ord"]).select("uid", "parent", "place"))
    after = ranked.select("parent", (F.col("place") - 1).alias("place"), F.col("uid").alias("sibling"))
    within = ranked.join(after, ["parent", "place"], "left").select("uid", "parent", "sibling")
    first = ranked.where("place = 0").select(F.col("parent").alias("uid"), F.col("uid").alias("child"))
    nodes = children.select("uid").union(children.select("parent")).distinct().join(first, "uid", "left").join(within, "uid", "left")
    # The walk enters a message at 2 uid and leaves it at 2 uid + 1; messages are counted where they are entered.
    enter, leave = F.col("uid") * 2, F.col("uid") * 2 + 1
    steps = F.array(F.struct(enter.alias("e"), F.coalesce(F.col("child") * 2, leave).alias("to"), F.lit(1).cast("long").alias("left")), F.struct(leave.alias("e"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("to"), F.lit(0).cast("long").alias("left")))
    walk = store.write(nodes.select(F.explode(steps).alias("s")).select("s.e", "s.to", "s.left", F.col("s.e").alias("end")))
    while not walk.where("to is not null").isEmpty():
        ahead = walk.select(F.col("e").alias("to"), F.col("to").alias("next"), F.col("left").alias("more"), F.col("end").alias("last"))
        moved = walk.where("to is not null").join(ahead, "to").select("e", F.col("next").alias("to"), (F.col("left") + F.col("more")).alias("left"), F.col("last").alias("end"))
        new = store.write(moved.union(walk.where("to is null")))
        store.drop(walk)
        walk = new
    return walk.where("e % 2 = 0").select(F.expr("e div 2").alias("uid"), F.expr("(`end` - 1) div 2").alias("root"), "left")


def format_chats(messages: DataFrame, **columns) -> DataFrame:
    """Reply-ordered conversations without quotes, one row a message.

    (conv_id, place, turn, role, text, n_quotes, max_level, reply_to_conv,
    reply_to_turn, n_rows, formatted). A message that replies to a message of its
    own conversation stands behind it and behind the earlier replies to it with
    all that replies to those; the others stand by turn. formatted is the message
    in chat markup, with a start and an end mark of the role; a conversation's
    text is its rows' in order of place. Turns that repeat stay, ordered by role
    and text. Null conversations are one group, nulls first.
    """
    rows, store = link_quotes(messages, **columns)
    rows = store.write(placed(rows, store, ["conv"], ["turn", "role", "text", "uid"]).withColumnRenamed("place", "ord"))
    walk = store.write(_walked(rows, store))
    heads = rows.select(F.col("uid").alias("root"), F.col("ord").alias("head"))
    walk = walk.join(heads, "root").select("uid", "head", (-F.col("left")).alias("nth"))
    rows = rows.drop("n_rows").join(walk, "uid", "left").withColumn("head", F.coalesce("head", "ord")).withColumn("nth", F.coalesce("nth", F.lit(0)))
    out = placed(rows, store, ["conv"], ["head", "nth"])
    role = F.coalesce("role", F.lit("user"))
    shown = F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n"))
    return out.select(F.col("conv").alias("conv_id"), "place", "turn", "role", "text", "n_quotes", "max_level", "reply_to_conv", "reply_to_turn", "n_rows", shown.alias("formatted"))


def op7_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read(spark, sf_dir, "conversations"))
