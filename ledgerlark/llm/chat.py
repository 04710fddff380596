"""Operator 2: conversations as budgeted training windows, with DataFrame functions only.

Prefix sums of turn tokens place each turn on its conversation's token line. The
line is cut every `room` tokens: the turns that lie between two cuts are a
window, and a turn across a cut is a window of its own, so windows are aligned
to turns. Each window after the conversation's system turn (its first, if it has
several) begins with it, and each repeats the turns before it that begin within the last `history` tokens, the nearest ones
as far as they fit; what is repeated is left out of the loss mask, so each
assistant text is a target once. Windows keep within the budget unless a turn
and the system turn together exceed it.

`room` is what the system turn and the history leave of the budget. A system
turn that leaves little of it takes the history's part first, then the room's;
one that leaves nothing exceeds the budget in every window, which then has the
usual least room, so that it is not repeated for each turn.

A long conversation is never ordered in one task: sums are taken in blocks of
turn numbers, then over the blocks, and history travels to the next windows by
key. Turns that share a number, or have none, are in one block.

Tokens of a turn are a column that a tokenizer stage has made (`tokens`), to
which its markers' are added, or else, and where that is null, the bytes of the
formatted turn: no token of a byte-level vocabulary (or one that falls back on
bytes) is shorter than a byte, so with any such tokenizer, and in any language, a
window has no more tokens than it counts.

Texts may hold anything: control strings and the escape character itself are
escaped, and unescaped() gives the text back. Null roles and texts count as
empty. Turns of a conversation are ordered by turn (null first), role and text;
repeated rows are each kept. A null conv_id is a conversation. Further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Begin and end of a turn, and what else is not to be found inside a text (fixed values).
BEGIN, END = "<|turn|>", "<|end|>"
CONTROL = [BEGIN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
_ESC = "\x1b"
_CODES = [(_ESC, _ESC + "0"), *((c, _ESC + chr(ord("a") + i)) for i, c in enumerate(CONTROL))]
_LINE = ("\n", _ESC + "1")
#: Turns of a block of prefix sums, and tokens that a turn's markers count beside given tokens.
BLOCK, MARKERS = 256, 4


def escaped(text: Column, line: bool = False) -> Column:
    """text without control strings; with `line`, without line ends, too."""
    for plain, code in [*_CODES, *([_LINE] if line else [])]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, line: bool = False) -> Column:
    for plain, code in [*([_LINE] if line else []), *reversed(_CODES)]:
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _head(role: Column) -> Column:
    return F.concat(F.lit(BEGIN), escaped(role, line=True), F.lit("\n"))


def turn_tokens(role: Column, text: Column) -> Column:
    """What a formatted turn counts for the budget: its bytes, the most tokens that it can have."""
    return F.octet_length(F.concat(_head(role), escaped(text), F.lit(END + "\n")))


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with `place` and `start`: the number of turns and of tokens before them in the conversation."""
    order = ["turn", "role", "text"]
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62)))
    turns = turns.withColumn("block", block).withColumn("tokens", F.coalesce(F.col("tokens") + MARKERS, turn_tokens(F.col("role"), F.col("text"))).cast("long"))
    totals = turns.groupBy("conv_id", "block").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("conv_id").alias("of"), F.col("block").alias("at"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"))
    within = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("own_t", F.coalesce(F.sum("tokens").over(within), F.lit(0))).withColumn("own_n", F.count(F.lit(1)).over(within))
    both = turns.join(totals, turns["conv_id"].eqNullSafe(totals["of"]) & (turns["block"] == totals["at"]))
    return both.select("conv_id", "role", "text", "tokens", (F.col("n") + F.col("own_n")).alias("place"), (F.col("t") + F.col("own_t")).alias("start"))


def chat_windows(turns: DataFrame, budget: int = 2048, history: int = 256, tokens: str | None = None) -> DataFrame:
    """Training windows of conversations (conv_id, turn, role, text, and tokens in the column of that name, if one is given).

    Columns: conv_id, window (in order), formatted, n_repeated (turns at its
    beginning that are repeated), tokens, loss_spans (first, length: code points
    of formatted that are targets).
    """
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), (F.col(tokens) if tokens else F.lit(None)).cast("long").alias("tokens"))
    placed = _placed(turns)
    system = placed.filter("role = 'system'").groupBy("conv_id").agg(F.min(F.struct("place", "tokens", "role", "text")).alias("system")).withColumnRenamed("conv_id", "of")
    placed = placed.join(system, placed["conv_id"].eqNullSafe(system["of"]), "left").drop("of")
    left, least = F.lit(budget) - F.coalesce("system.tokens", F.lit(0)), F.lit(max(budget // 4, history))
    room = F.greatest(left - history, F.when(left > 0, F.least(left, least)).otherwise(least))
    placed = placed.withColumn("room", room.cast("long")).withColumn("cut", F.expr("start div room"))
    placed = placed.withColumn("window", F.expr("2 * cut + int((start + tokens - 1) div room > cut)"))

    # a turn goes to its own window and, if it lies near enough to a cut, to the windows that may repeat it
    near = F.expr(f"start >= (cut + 1) * room - {history}")
    following = F.expr("filter(array(window, IF(window % 2 = 0, window + 1, null), IF(near, cut * 2 + 2, null), IF(near, cut * 2 + 3, null)), x -> x is not null)")
    sent = placed.withColumn("near", near).withColumn("to", F.explode(F.array_distinct(following)))
    turn = F.struct("place", "start", "tokens", F.expr("to <> window").alias("repeated"), "role", "text")
    windows = sent.groupBy("conv_id", "to").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.first("system").alias("system"))
    windows = windows.withColumn("first", F.expr("get(filter(turns, x -> not x.repeated), 0)")).filter("first is not null")

    windows = windows.withColumn("free", F.expr(f"""
        {budget} - aggregate(turns, 0L, (n, x) -> n + IF(x.repeated, 0L, x.tokens))
        - IF(system.place < first.place, system.tokens, 0L)
    """))
    between = "first.start - x.start - IF(system.place >= x.place and system.place < first.place, system.tokens, 0L)"
    kept = F.expr(f"filter(turns, x -> not x.repeated or x.start >= first.start - {history} and (x.place <=> system.place or {between} <= free))")
    windows = windows.withColumn("turns", kept)
    again = "array(named_struct('place', system.place, 'start', 0L, 'tokens', system.tokens, 'repeated', true, 'role', system.role, 'text', system.text))"
    windows = windows.withColumn("turns", F.expr(f"IF(system.place < first.place and not exists(turns, x -> x.place = system.place), concat({again}, turns), turns)"))
    parts = F.transform(
        "turns",
        lambda x: F.struct(
            _head(x["role"]).alias("head"), escaped(x["text"]).alias("body"), F.lit(END + "\n").alias("tail"), ((x["role"] == "assistant") & ~x["repeated"]).alias("target")
        ),
    )
    windows = windows.withColumn("parts", parts)
    spans = F.expr("""
        aggregate(parts, named_struct('at', 0L, 'spans', cast(array() as array<struct<first:bigint,length:bigint>>)),
          (s, p) -> named_struct('at', s.at + length(p.head) + length(p.body) + length(p.tail),
            'spans', IF(p.target, concat(s.spans, array(named_struct('first', s.at + length(p.head), 'length', cast(length(p.body) as bigint)))), s.spans))).spans
    """)
    return windows.select(
        "conv_id", F.col("to").alias("window"), F.expr("array_join(transform(parts, p -> concat(p.head, p.body, p.tail)), '')").alias("formatted"),
        F.expr("size(filter(turns, x -> x.repeated))").alias("n_repeated"), F.expr("aggregate(turns, 0L, (n, x) -> n + x.tokens)").alias("tokens"), spans.alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted window, read back: an array of (role, text)."""
    pieces = F.filter(F.split(formatted, END.replace("|", r"\|") + "\n", -1), lambda p: p != "")
    inner = F.transform(pieces, lambda p: F.substr(p, F.lit(len(BEGIN) + 1)))
    return F.transform(inner, lambda p: F.struct(unescaped(F.left(p, F.instr(p, F.lit("\n")) - 1), line=True).alias("role"), unescaped(F.substr(p, F.instr(p, F.lit("\n")) + 1)).alias("text")))


def read_targets(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, read back from a formatted window."""
    return F.transform(spans, lambda s: unescaped(F.substr(formatted, s["first"].cast("int") + 1, s["length"].cast("int"))))
