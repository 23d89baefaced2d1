"""Chat formatting in budgeted windows, DataFrame operations only.

Prefix sums of turn tokens cut a conversation into spans of whole turns: a span ends before the turn whose end would leave the budget. A window
shows the leading system turn, as many whole turns before its span as the history limit holds, and the span. Loss falls on the
span's assistant texts alone, so every target is learnt once however often it is repeated.

The template marks a turn by control strings::

    [INST] user text [/INST]    [SYS] system text [/SYS]    <s> assistant text </s>    [ROLE] role [TEXT] text [/ROLE]

Inside texts and roles a control string gets one backslash more after its first character, ``[\\INST]`` becoming ``[\\\\INST]``, so no text
can hold a marker, texts without control strings stay as they are, and taking one backslash away gives every text back.

Prefix sums run over ranges of narrow rows, and spans are cut inside chunks of CHUNK turns, so a conversation of any length is dealt to many
tasks; only the rows of one window are ever brought together. Spans also end at chunk borders.

Defined results: null texts are empty; a null role is an empty role; turns are ordered by turn (null first), role, then text hash, and
repeated rows are turns of their own; rows of a null conversation id form one conversation; an empty table gives an empty one; a turn
beyond the budget stays whole in a window of its own; only a system turn at the very start is kept in all windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlab.session import cut_lineage

from .common import WORD, running_sums

BUDGET, HISTORY, CHUNK = 512, 128, 512
#: Tokens counted for the markers of a turn.
MARKERS = 4
CONTROL = r"/?INST\]|/?SYS\]|/?ROLE\]|TEXT\]|/?s>"
_ESCAPE = rf"([\[<])(\\*)({CONTROL})"
_UNESCAPE = rf"([\[<])\\(\\*)({CONTROL})"
TURN = r"(?s)\[INST\] .*? \[/INST\]|\[SYS\] .*? \[/SYS\]|<s> .*? </s>|\[ROLE\] .*? \[/ROLE\]"
#: Opening and closing marker of the roles that have their own.
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("<s> ", " </s>")}


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def turn_tokens(text: Column) -> Column:
    """Words and the turn's markers."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint") + MARKERS


def formatted_turn(role: Column, text: Column) -> tuple[Column, Column]:
    """The turn under its markers, and how many characters stand before its text."""
    head = F.concat(F.lit("[ROLE] "), escaped(role), F.lit(" [TEXT] "))
    before, whole = F.length(head), F.concat(head, escaped(text), F.lit(" [/ROLE]"))
    for name, (left, right) in MARKS.items():
        whole = F.when(role == name, F.concat(F.lit(left), escaped(text), F.lit(right))).otherwise(whole)
        before = F.when(role == name, len(left)).otherwise(before)
    return whole, before


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, key, row): key orders rows of one turn number, row tells equal rows apart."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return rows.select(
        F.coalesce(F.col(conv).cast("bigint"), F.lit(-(2**63))).alias("conv"), F.coalesce(F.col(turn).cast("bigint"), F.lit(-(2**63))).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), body.alias("text"), F.xxhash64(body).alias("key"), F.monotonically_increasing_id().alias("row"),
    )


def spans(turns: DataFrame, budget: int, history: int, chunk: int) -> DataFrame:
    """(conv, row, place, start, stop, tokens, system, window): token range and window of every turn.

    ``window`` is the token place where the turn's span begins, null for the leading system turn; ``system`` the tokens of that turn.
    """
    order = ["conv", "turn", "role", "key", "row"]
    narrow = turns.select(*order, turn_tokens(F.col("text")).alias("tokens"), F.lit(1).alias("one"))
    placed = running_sums(narrow, order[1:], ["tokens", "one"], by=["conv"])
    placed = cut_lineage(placed.select("conv", "row", F.col("before_one").alias("place"), F.col("before_tokens").alias("start"), "tokens", ((F.col("before_one") == 0) & (F.col("role") == "system")).alias("leads")))
    heads = placed.where("leads").select(F.col("conv").alias("head"), F.col("tokens").alias("system"))
    body = placed.join(heads, F.col("conv") == F.col("head"), "left").drop("head").withColumn("system", F.coalesce("system", F.lit(0)))
    room = F.greatest(F.lit(budget - history) - F.col("system"), F.lit(1))
    # the prefix sums of a chunk, in order, and the fold that opens a span where the open one would leave its room
    chunk_rows = F.sort_array(F.collect_list(F.struct("place", "row", "start", "tokens")))
    cut = body.where("NOT leads").groupBy("conv", F.expr(f"place div {chunk}").alias("chunk")).agg(chunk_rows.alias("all"), F.first("system").alias("system"), F.first(room).alias("room"))
    opened = F.aggregate(
        "all", F.array().cast("array<bigint>"),
        lambda seen, t: F.concat(seen, F.array(F.when((F.size(seen) > 0) & (t["start"] + t["tokens"] - F.get(seen, F.size(seen) - 1) <= F.col("room")), F.get(seen, F.size(seen) - 1)).otherwise(t["start"]))),
    )
    own = cut.select("conv", "system", F.explode(F.arrays_zip("all", opened.alias("window"))).alias("t")).select("conv", "t.all.row", "t.all.place", "t.all.start", "t.all.tokens", "system", "t.window")
    return cut_lineage(own.unionByName(body.where("leads").select("conv", "row", "place", "start", "tokens", "system", F.lit(None).cast("bigint").alias("window"))))


def format_windows(
    rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, chunk: int = CHUNK,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(conv_id, window, n_tokens, n_repeated, formatted, loss array<struct<start, stop>>): the windows of every conversation.

    ``window`` numbers windows by their place in the conversation (rising, with gaps); the first ``n_repeated`` turns are repeated from earlier
    windows; ``loss`` holds code point ranges of ``formatted``, end exclusive, of the targets.
    """
    turns = cut_lineage(_turns(rows, conv_col, turn_col, role_col, text_col))
    placed = spans(turns, budget, history, chunk)
    windows = placed.where("window IS NOT NULL").groupBy("conv", "window").agg(F.min("place").alias("from"))
    # a turn is history of the windows that begin at most `history` tokens after its own beginning; they are found by buckets of that width
    width = max(history, 1)
    near = windows.select(F.col("conv").alias("to_conv"), F.col("window").alias("to"), F.expr(f"window div {width}").alias("bucket"))
    member = placed.where("window IS NOT NULL").select("conv", "window", "row", "place", "tokens", F.lit(True).alias("fresh"))
    if history:
        earlier = placed.where(f"window IS NOT NULL AND tokens <= {history}").select("conv", "row", "place", "start", "tokens", F.explode(F.expr(f"sequence((start + tokens) div {width}, (start + {history}) div {width})")).alias("at"))
        met = (F.col("conv") == F.col("to_conv")) & (F.col("at") == F.col("bucket")) & (F.col("to") >= F.col("start") + F.col("tokens")) & (F.col("to") <= F.col("start") + history)
        member = member.unionByName(earlier.join(near, met).select("conv", F.col("to").alias("window"), "row", "place", "tokens", F.lit(False).alias("fresh")))
    heads = placed.where("window IS NULL").select("conv", "row", "place", "tokens")
    with_head = windows.select("conv", "window", "from").join(heads, "conv").select("conv", "window", "row", "place", "tokens", (F.col("from") == 1).alias("fresh"))
    # a conversation of a system turn alone is one window
    alone = heads.join(windows.select("conv"), "conv", "left_anti").select("conv", F.lit(0).cast("bigint").alias("window"), "row", "place", "tokens", F.lit(True).alias("fresh"))
    member = cut_lineage(member.unionByName(with_head).unionByName(alone))
    whole, before = formatted_turn(F.col("role"), F.col("text"))
    pieces = member.join(turns.select("conv", "row", "role", "text"), ["conv", "row"]).select("conv", "window", "place", "tokens", "fresh", "role", whole.alias("piece"), before.alias("before"), F.length(escaped(F.col("text"))).alias("size"))
    return _assembled(pieces)


def _assembled(pieces: DataFrame) -> DataFrame:
    one = F.struct("place", F.col("fresh"), "piece", (F.col("fresh") & (F.col("role") == "assistant")).alias("target"), "before", "size")
    grouped = pieces.groupBy("conv", "window").agg(F.sort_array(F.collect_list(one)).alias("all"), F.sum("tokens").alias("n_tokens"), F.sum(F.when(F.col("fresh"), 0).otherwise(1)).cast("int").alias("n_repeated"))
    # where each piece begins: prefix sums of the pieces' lengths
    begins = F.aggregate("all", F.array(F.lit(0)), lambda seen, p: F.concat(seen, F.array(F.element_at(seen, -1) + F.length(p["piece"]))))
    ranged = grouped.withColumn("begins", begins)
    loss = F.filter(F.transform("all", lambda p, i: F.struct(p["target"].alias("target"), (F.element_at("begins", i + 1) + p["before"]).alias("start"), (F.element_at("begins", i + 1) + p["before"] + p["size"]).alias("stop"))), lambda x: x["target"])
    conv = F.when(F.col("conv") != -(2**63), F.col("conv")).alias("conv_id")
    return ranged.select(conv, "window", "n_tokens", "n_repeated", F.array_join(F.transform("all", lambda p: p["piece"]), "").alias("formatted"), F.transform(loss, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))).alias("loss"))


def _role(turn: Column) -> Column:
    out = unescaped(F.regexp_extract(turn, r"(?s)^\[ROLE\] (.*?) \[TEXT\] ", 1))
    for name, (left, _) in MARKS.items():
        out = F.when(turn.startswith(left), F.lit(name)).otherwise(out)
    return out


def _text(turn: Column) -> Column:
    return unescaped(F.regexp_replace(F.regexp_replace(turn, r"(?s)^(\[INST\] |\[SYS\] |<s> |\[ROLE\] .*? \[TEXT\] )", ""), r" (\[/INST\]|\[/SYS\]|</s>|\[/ROLE\])$", ""))


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, window, turns array<struct<role, text>>, targets array<string>, chars): the new turns of every window and what its mask learns, unescaped."""
    turns = F.filter(F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0)), lambda _, i: i >= F.col("n_repeated"))
    turns = F.transform(turns, lambda t: F.struct(_role(t).alias("role"), _text(t).alias("text")))
    targets = F.transform("loss", lambda x: unescaped(F.substring(F.col("formatted"), x["start"] + 1, x["stop"] - x["start"])))
    return windows.select("conv_id", "window", turns.alias("turns"), targets.alias("targets"), F.length("formatted").alias("chars"))


def digests(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the windows of each conversation.

    A digest takes its conversation as one text, so here, other than in ``format_windows``, a conversation comes together in one row.
    """
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read_back(windows).select("conv_id", "window", "chars", F.size("turns").cast("bigint").alias("n"), told.alias("told"), F.array_join("targets", "").alias("learnt"))
    per = read.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "told", "learnt"))).alias("all"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    sha = lambda c: F.sha2(F.array_join(F.col(f"all.{c}"), "").cast("binary"), 256)
    return per.select("conv_id", "n_turns", sha("told").alias("turns_sha256"), F.length(F.array_join("all.learnt", "")).cast("bigint").alias("loss_chars"), sha("learnt").alias("loss_sha256"), "formatted_chars")
