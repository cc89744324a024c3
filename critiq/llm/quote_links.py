"""Chat formatting by quotation linking.

Quote marks at the beginning of a line (``>``, nested as ``> >`` or ``>>``) give its level. Lines of one
level in a row are a passage; a passage normalised (marks off, white space runs to one space, lower case)
is hashed. Every message posts the hashes of its own text, of its own paragraphs and of its own lines, and
the hashes of those runs of its own lines that begin like a passage of the conversation and are as long; a join of
passages with postings inside a conversation finds the message quoted. The innermost
level that a message quotes directly (level 1) names the message it replies to; a message that quotes
nothing found replies to the turn before. Conversations are put in the order of a walk through the reply
tree (every message after what it replies to, each reply's own replies before the next reply) and
written without the quotes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from critiq.llm.common import cut

MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
LINE_CHARS = 20  # shorter lines and paragraphs alone identify no message
# "On Monday, X wrote:" and the like, directly above a quote
INTRODUCTION = re.compile(r"(?i)[^\n]*\b(?:wrote|schrieb|écrit|escribió)\b[^\n]*:[ \t]*")
BUCKET = 1024  # turns counted together


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def line_hashes(text: str) -> list[int]:
    """Hash of each line that isn't blank."""
    return [text_hash(n) for line in text.split("\n") if (n := normal(line))]


def parse(text: str | None) -> tuple[str, list[tuple[int, int, list[int]]], list[int]]:
    """(own text, (level, hash, hashes of the lines) of each quoted passage, hashes that quotes of this message can have).

    Passages of fewer than LINE_CHARS characters have no line hashes: they can only be a whole message. The line that
    introduces a deeper quote belongs to no passage.
    """
    own, passages, level, part = [], [], 0, []

    def close(depth: int) -> None:
        if level:
            if depth > level and part and INTRODUCTION.fullmatch(part[-1]):
                part.pop()
            whole = "\n".join(part)
            if quoted := normal(whole):
                passages.append((level, text_hash(quoted), line_hashes(whole) if len(quoted) >= LINE_CHARS else []))

    for line in (text or "").split("\n"):
        m = MARKS.match(line)
        depth = m[1].count(">") if m else 0
        if depth != level:
            close(depth)
            level, part = depth, []
        if depth:
            part.append(line[m.end() :])
            own.append(None)
        else:
            own.append(line)
    close(0)
    kept = [line for k, line in enumerate(own) if line is not None and not (k + 1 < len(own) and own[k + 1] is None and INTRODUCTION.fullmatch(line))]
    body = "\n".join(kept).strip()
    whole = normal(body)
    posts = {whole} if whole else set()
    for block in [*re.split(r"\n[ \t]*\n", body), *body.split("\n")]:
        if len(n := normal(block)) >= LINE_CHARS:
            posts.add(n)
    return body, passages, sorted({text_hash(p) for p in posts})


def line_runs(single: DataFrame) -> DataFrame:
    """(c, t, hash): runs of own lines that can be a passage of their conversation.

    Only runs that begin with the first line of such a passage, and are as long, are hashed: a row for each
    occurrence of a line in a message and different length of the passages that begin with it, whatever the number of
    messages that quote them.
    """
    wanted = single.select("c", F.explode("quotes.lines").alias("lines")).filter("size(lines) > 0")
    wanted = wanted.select("c", F.col("lines")[0].alias("line"), F.size("lines").alias("m")).distinct()
    at = single.select("c", "t", F.posexplode("lines").alias("at", "line")).join(wanted, ["c", "line"])
    runs = at.groupBy("c", "t").agg(F.collect_set(F.struct("at", "m")).alias("runs"))
    each = runs.join(single.select("c", "t", "lines"), ["c", "t"]).select("c", "t", "lines", F.explode("runs").alias("r")).filter("r.at + r.m <= size(lines)")
    return each.select("c", "t", _run_hash(F.slice("lines", F.col("r.at") + 1, F.col("r.m"))).alias("hash")).distinct()


def _run_hash(lines: Column) -> Column:
    return F.xxhash64(F.lit("lines"), lines)


def reply_ordered(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, turn_col, role_col, text, reply_to, branch, place, n_quotes, n_linked, formatted) of every message.

    text: without quotes and the lines that introduce them. reply_to: the turn replied to, null for a
    conversation's first turn; the latest earlier turn whose text, paragraph, line or run of lines a level-1
    passage repeats (the least deep level found where level 1 finds none), else the turn before. Lines count as in a
    row if only blank lines or quotes stand between them. branch: the
    first turn of the run of turns that each reply to the one before. place: position in the walk, from 0. A quote never links to its own or a later turn. n_quotes and n_linked count the
    passages and those found. formatted: role and text in one line-framed block.

    Null texts count as empty, null roles as ``user``. Rows without a conversation or turn are left out.
    Rows that repeat a turn are one message: its texts' least by hash. An empty table gives an empty
    result; other columns are ignored, whatever their names.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = pa.list_(pa.int64())
        kind = pa.list_(pa.struct([("level", pa.int64()), ("hash", pa.int64()), ("lines", hashes)]))
        for batch in batches:
            got = [parse(t.as_py()) for t in batch.column(3)]
            quotes = [[{"level": a, "hash": h, "lines": x} for a, h, x in g[1]] for g in got]
            own = [pa.array([g[0] for g in got], pa.string()), pa.array(quotes, kind), pa.array([g[2] for g in got], hashes), pa.array([line_hashes(g[0]) for g in got], hashes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *own], ["c", "t", "role", "text", "quotes", "posts", "lines"])

    source = messages.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("t"), F.coalesce(F.col(role_col).cast("string"), F.lit("user")).alias("role"), F.col(text_col).cast("string").alias("text")).filter("c is not null and t is not null")
    parsed = source.mapInArrow(rows, "c long, t long, role string, text string, quotes array<struct<level: bigint, hash: bigint, lines: array<bigint>>>, posts array<bigint>, lines array<bigint>")
    parsed = cut(parsed.withColumn("h", F.xxhash64("role", "text", "quotes")))
    chosen = parsed.groupBy("c", "t").agg(F.min("h").alias("h"))  # of repeated turns one
    single = parsed.join(chosen, ["c", "t", "h"]).dropDuplicates(["c", "t"])

    single = cut(single)
    quoted = single.select("c", F.col("t").alias("by"), F.posexplode("quotes").alias("k", "q"))
    keys = F.array(F.col("q.hash"), F.when(F.size("q.lines") > 0, _run_hash(F.col("q.lines"))))
    quoted = quoted.select("c", "by", "k", "q.level", F.explode(keys).alias("hash")).filter("hash is not null")
    posted = single.select("c", "t", F.explode("posts").alias("hash")).unionByName(line_runs(single))
    # the latest earlier turn with the hash: of each (conversation, hash) all turns meet its quotes, so common
    # passages are narrowed to turn ranges first and only the nearest is looked up
    found = latest_before(quoted, posted).groupBy("c", "by", "k", "level").agg(F.max("turn").alias("turn"))
    best = found.groupBy("c", F.col("by").alias("t")).agg(F.max(F.struct((-F.col("level")).alias("near"), "turn")).alias("b"), F.count("*").alias("n_linked"))
    best = best.select("c", "t", F.col("b.turn").alias("linked"), "n_linked")
    before = turn_before(single.select("c", "t"))
    linked = single.join(best, ["c", "t"], "left").join(before, ["c", "t"], "left")
    linked = cut(linked.select("c", "t", "role", "text", F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("linked", "previous").alias("reply_to"), "previous"))
    out = linked.join(places(linked), ["c", "t"])
    formatted = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n"))
    return out.select(F.col("c").alias(conv_col), F.col("t").alias(turn_col), F.col("role").alias(role_col), "text", "reply_to", "branch", "place", "n_quotes", "n_linked", formatted.alias("formatted"))


def latest_before(quoted: DataFrame, posted: DataFrame) -> DataFrame:
    """quoted with ``turn``: the latest turn before ``by`` that posted the hash; unmatched rows are dropped.

    Turns are grouped in buckets of a fixed length, so that a passage posted by a whole conversation is
    swept in pieces: within the bucket by a window, before it by the latest turn of earlier buckets.
    """
    events = posted.select("c", "hash", F.col("t").alias("at"), F.col("t").alias("turn"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("long").alias("level")).unionByName(
        quoted.select("c", "hash", F.col("by").alias("at"), F.lit(None).cast("long").alias("turn"), "k", "level"))
    events = events.withColumn("bucket", F.floor(F.col("at") / BUCKET))
    last = posted.groupBy("c", "hash", F.floor(F.col("t") / BUCKET).alias("bucket")).agg(F.max("t").alias("last"))
    asked = quoted.select("c", "hash", F.floor(F.col("by") / BUCKET).alias("bucket")).distinct()
    earlier = asked.alias("a").join(last.alias("l"), (F.col("a.c") == F.col("l.c")) & (F.col("a.hash") == F.col("l.hash")) & (F.col("l.bucket") < F.col("a.bucket")))
    earlier = earlier.groupBy(F.col("a.c").alias("c"), F.col("a.hash").alias("hash"), F.col("a.bucket").alias("bucket")).agg(F.max("l.last").alias("earlier"))
    sweep = Window.partitionBy("c", "hash", "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    near = events.withColumn("near", F.max("turn").over(sweep)).filter("k is not null").join(earlier, ["c", "hash", "bucket"], "left")
    return near.select("c", F.col("at").alias("by"), "k", "level", F.coalesce("near", "earlier").alias("turn")).filter("turn is not null")


def turn_before(turns: DataFrame) -> DataFrame:
    """(c, t, previous): the conversation's turn before each, by bucket windows; null for the first."""
    dealt = turns.withColumn("bucket", F.floor(F.col("t") / BUCKET))
    inside = Window.partitionBy("c", "bucket").orderBy("t")
    tops = dealt.groupBy("c", "bucket").agg(F.max("t").alias("top"))
    tops = tops.withColumn("below", F.lag("top").over(Window.partitionBy("c").orderBy("bucket"))).select("c", "bucket", "below")
    near = dealt.withColumn("near", F.lag("t").over(inside)).join(tops, ["c", "bucket"])
    return near.select("c", "t", F.coalesce("near", "below").alias("previous"))


def running(rows: DataFrame, keys: list[str], order: str, amount: str, name: str) -> DataFrame:
    """rows with ``name``: the sum of ``amount`` over rows of equal keys and lesser ``order`` (whole numbers, different
    ones within the keys). Summed within buckets of BUCKET numbers, and over the buckets' totals."""
    dealt = rows.withColumn("_bucket", F.floor(F.col(order) / BUCKET))
    totals = dealt.groupBy(*keys, "_bucket").agg(F.sum(amount).alias("_sum"))
    ahead = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*keys, "_bucket", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    inside = F.sum(amount).over(Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    near = dealt.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(totals, [*keys, "_bucket"])
    return near.select(*rows.columns, (F.col("_ahead") + F.col("_inside")).alias(name))


def subtree_sizes(tree: DataFrame) -> DataFrame:
    """(c, branch, size) from (c, branch, up, n): turns of a branch and of all that hang on it.

    Doubling: after k rounds a branch has the turns of its descendants nearer than 2**k, and adds what those at
    that distance have. A branch is a row of fixed size in each round.
    """
    now = cut(tree.select("c", "branch", F.col("up").alias("jump"), F.col("n").alias("size")))
    while now.filter("jump is not null").limit(1).count():
        add = now.filter("jump is not null").groupBy("c", F.col("jump").alias("branch")).agg(F.sum("size").alias("more"))
        above = now.select("c", F.col("branch").alias("jump"), F.col("jump").alias("next"))
        now = now.join(add, ["c", "branch"], "left").join(above, ["c", "jump"], "left")
        now = cut(now.select("c", "branch", F.col("next").alias("jump"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
    return now.select("c", "branch", "size")


def branch_places(tree: DataFrame) -> DataFrame:
    """(c, branch, ahead): turns placed before a branch's first, from (c, branch, up, reply_to, n).

    After a branch's own turns come the branches that hang on it, on later turns first, then by their first turn, each
    with all that hangs on it. So a branch lies behind its parent's beginning by the parent's own turns and the
    sizes of the branches before it; these distances are added up to the root by pointer jumping.
    """
    if not tree.filter("up is not null").limit(1).count():
        return tree.select("c", "branch", F.lit(0).cast("long").alias("ahead"))
    child = tree.filter("up is not null").join(subtree_sizes(tree), ["c", "branch"]).withColumn("later", -F.col("reply_to"))
    turns = running(child.groupBy("c", "up", "later").agg(F.sum("size").alias("all")), ["c", "up"], "later", "all", "by_turn")
    child = running(child, ["c", "up", "later"], "branch", "size", "beside").join(turns.drop("all"), ["c", "up", "later"])
    child = child.join(tree.select("c", F.col("branch").alias("up"), F.col("n").alias("own")), ["c", "up"])
    steps = child.select("c", "branch", F.col("up").alias("jump"), (F.col("own") + F.col("by_turn") + F.col("beside")).alias("ahead"))
    now = cut(steps.unionByName(tree.filter("up is null").select("c", "branch", F.lit(None).cast("long").alias("jump"), F.lit(0).cast("long").alias("ahead"))))
    while now.filter("jump is not null").limit(1).count():
        above = now.select("c", F.col("branch").alias("jump"), F.col("jump").alias("next"), F.col("ahead").alias("more"))
        now = now.join(above, ["c", "jump"], "left")
        now = cut(now.select("c", "branch", F.col("next").alias("jump"), (F.col("ahead") + F.coalesce("more", F.lit(0))).alias("ahead")))
    return now.select("c", "branch", "ahead")


def places(linked: DataFrame) -> DataFrame:
    """(c, t, branch, place) from (c, t, reply_to, previous): the order of a walk through each reply tree.

    A branch is a run of turns that each reply to the turn before. Turns are counted in buckets of
    BUCKET, and branches placed by joins of rows of fixed size: no task holds a conversation.
    """
    opens = F.col("previous").isNull() | (F.col("reply_to") != F.col("previous"))
    dealt = linked.select("c", "t", "reply_to", F.floor(F.col("t") / BUCKET).alias("bucket"), F.when(opens, F.col("t")).alias("head"))
    tops = dealt.groupBy("c", "bucket").agg(F.max("head").alias("top"))
    tops = tops.withColumn("below", F.max("top").over(Window.partitionBy("c").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("c", "bucket", "below")
    inside = F.max("head").over(Window.partitionBy("c", "bucket").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    of_turn = cut(dealt.withColumn("inside", inside).join(tops, ["c", "bucket"]).select("c", "t", "reply_to", (F.col("head") == F.col("t")).alias("opens"), F.coalesce("inside", "below").alias("branch"), F.lit(1).cast("long").alias("one")))
    own = of_turn.groupBy("c", "branch").agg(F.sum("one").alias("n"))
    parents = of_turn.select("c", F.col("t").alias("reply_to"), F.col("branch").alias("up"))
    heads = of_turn.filter("opens").select("c", F.col("t").alias("branch"), "reply_to")
    tree = cut(heads.join(parents, ["c", "reply_to"], "left").join(own, ["c", "branch"]).select("c", "branch", "up", "reply_to", "n"))
    counted = running(of_turn, ["c", "branch"], "t", "one", "i")
    return counted.join(branch_places(tree), ["c", "branch"]).select("c", "t", "branch", (F.col("ahead") + F.col("i")).alias("place"))
