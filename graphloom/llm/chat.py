"""Chat formatting in budgeted windows.

A turn costs its words plus ``TURN_TOKENS`` for its marks. Prefix sums of these costs over a
conversation cut it into blocks: the turns that lie inside a block make one window, a turn that
crosses a block's end makes a window of its own. No window depends on how earlier ones were filled.
A window starts with the system turn (the conversation's first turn, if its role is system), then
repeats the turns that began shortly before it, then has its own turns. Only the texts of its own
assistant turns are under the loss mask, so each is a target once.

A window holds ``BUDGET`` tokens, all turns counted. The history is up to ``HISTORY`` tokens, at most
half of what the system turn leaves; a block has what both leave. The turns repeated are those that
fit what the system turn and the own turns leave of the budget. So a window exceeds the budget only if
it has a single own turn, which does so by itself or with the system turn.

The template is ``<|role|>``, a line feed, the text, ``<|end|>``, a line feed. Every control string
in a role or text gets a backslash after its first character and backslashes are doubled, which the
reader undoes; no text can open, close or forge a turn.

Turns are ordered by turn (null first), role and text, and sorted by range. A task cuts the
conversations that lie inside its range as they stream by. The first and the last of a range, which may
go on in another, and any of more than ``WHOLE_TURNS`` turns or ``WHOLE_CHARS`` characters are left over:
their prefix sums go over ranges in two levels (see ``sums_ahead``), and their windows are built per
conversation and block, so a conversation of any length, with or without turn numbers, is spread; a turn
is dealt to two blocks at most, the system turn to each block that has turns, from as many copies as the
conversation has thousands of turns. Texts are shuffled once to be formatted, those left over twice.
``read_back`` streams sorted windows and holds one at a time; as its digests are chains over whole
conversations, one task reads each conversation.

Defined cases: a null role or text is empty; a null ``conv_id`` is a conversation of its own;
a very long turn is a window of its own and is held whole; repeated rows are turns of their own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import sums_ahead, table
from graphloom.session import materialise

BUDGET, HISTORY, TURN_TOKENS = 512, 128, 4
#: Control strings of this and other common templates.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>")
WORD = "[^\\x20\\x09-\\x0D]+"
#: Conversations of more turns or characters are not held whole.
WHOLE_TURNS, WHOLE_CHARS = 10_000, 8_000_000
_ESCAPE = re.compile("|".join(["\\\\", *(re.escape(c) for c in CONTROL)]))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
WINDOW_SCHEMA = "conv_id long, start long, text string, repeated int, spans array<struct<from: int, to: int>>, tokens long"
CUT_SCHEMA = WINDOW_SCHEMA + ", turn long, role string, rows long, part int, tokens_inside long, rows_inside long"


def escape(text: str) -> str:
    """Text without control strings."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    """What ``escape`` was given."""
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as the template writes it, and where its text starts and ends."""
    head, body = f"<|{escape(role)}|>\n", escape(text)
    return f"{head}{body}<|end|>\n", len(head), len(head) + len(body)


def parse_window(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the text as written) of each turn of a window."""
    found, at = [], 0
    while at < len(text):
        role_end = text.index("|>\n", at)
        end = text.index("<|end|>\n", role_end + 3)
        found.append((unescape(text[at + 2 : role_end]), unescape(text[role_end + 3 : end]), role_end + 3, end))
        at = end + len("<|end|>\n")
    return found


def _rooms(lead: int, budget: int, history: int) -> tuple[int, int]:
    """(room, history): tokens of a block and of the history, where the system turn has ``lead`` tokens."""
    kept = min(history, max(0, (budget - lead) // 2))
    return max(1, budget - lead - kept), kept


class Cutter:
    """Takes the sorted turns of one range: gives windows of the conversations that surely lie inside it, and the turns of the others."""

    def __init__(self, part: int, budget: int, history: int, most_turns: int, most_chars: int):
        self.part, self.budget, self.history, self.most_turns, self.most_chars = part, budget, history, most_turns, most_chars
        self.key: tuple | None = None
        self.held: list[tuple] = []
        self.windows: list[dict] = []
        self.rest: list[dict] = []
        self.begin = self.place = self.chars = self.seen = 0
        self.whole = False

    def _leave(self) -> None:
        """Leave the turns held over."""
        for begin, place, turn, tokens, role, text in self.held:
            self.rest.append({"conv_id": self.key[0], "text": text, "tokens": tokens, "turn": turn, "role": role, "rows": 1, "part": self.part, "tokens_inside": begin, "rows_inside": place})
        self.held, self.whole = [], False

    def end(self, last: bool) -> None:
        """The conversation is over; ``last``: and so is the range."""
        if not self.held:
            return
        if last or not self.whole:
            self._leave()
            return
        turns = [(begin, tokens, role, text) for begin, _, _, tokens, role, text in self.held]
        lead = turns[0][1] if turns[0][2] == "system" else 0
        room, kept = _rooms(lead, self.budget, self.history)
        system, begins = (turns[0][3], lead) if lead else None, [t[0] for t in turns]
        for block in sorted({x // room for x in begins}):
            near = turns[bisect_left(begins, block * room - kept) : bisect_left(begins, (block + 1) * room)]
            self.windows += [{"conv_id": self.key[0], **row} for row in _build(near, block, system, room, kept, self.budget)]
        self.held = []

    def add(self, conversation: int | None, turn: int | None, role: str, text: str, tokens: int) -> None:
        if self.key != (conversation,):
            self.end(False)
            self.key, self.whole, self.seen = (conversation,), self.seen > 0, self.seen + 1
            self.begin = self.place = self.chars = 0
        self.held.append((self.begin, self.place, turn, tokens, role, text))
        self.begin, self.place, self.chars = self.begin + tokens, self.place + 1, self.chars + len(text)
        if not self.whole or self.place > self.most_turns or self.chars > self.most_chars:
            self._leave()


def cut(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``CUT_SCHEMA``, written: windows (those with ``start``), and turns that are left over, with sums inside their range."""
    plain = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    costed = plain.withColumn("tokens", F.regexp_count("text", F.lit(WORD)).cast("long") + TURN_TOKENS)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role")]
    columns = ("conv_id", "turn", "role", "text", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(TaskContext.get().partitionId(), budget, history, WHOLE_TURNS, WHOLE_CHARS)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                cutter.add(*row)
                if len(cutter.windows) + len(cutter.rest) >= 1_000:
                    yield _batch([*cutter.windows, *cutter.rest], CUT_TYPES)
                    cutter.windows, cutter.rest = [], []
        cutter.end(True)
        if cutter.windows or cutter.rest:
            yield _batch([*cutter.windows, *cutter.rest], CUT_TYPES)

    # the ends of ranges need not hold whole texts
    ranged = costed.repartitionByRange(*order, F.substring("text", 1, 64).asc()).sortWithinPartitions(*order, "text")
    return materialise(ranged.mapInArrow(run, CUT_SCHEMA), "chat-cut")


def placed_turns(summed: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Turns left over by ``cut`` with ``begin`` and ``place`` (tokens and turns of their conversation ahead of them), ``turns`` (all of them), ``lead`` (the system turn's tokens), and the conversation's ``history`` and ``room``."""
    parts = sums_ahead(summed, ["tokens", "rows"], "conv_id")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    heads = summed.where("rows_inside = 0 and role = 'system'").select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("tokens").alias("head"))
    whole = W.partitionBy("conv_id")
    leads = F.coalesce(F.max(F.when(F.col("rows_ahead") == 0, F.col("head"))).over(whole), F.lit(0))
    parts = parts.join(heads, same, "left").select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "tokens_ahead", "rows_ahead", leads.alias("lead"), F.sum("rows_own").over(whole).alias("turns"))
    kept = F.least(F.lit(history), F.greatest(F.lit(0), F.floor((budget - F.col("lead")) / 2))).cast("long")
    parts = parts.withColumn("history", kept).withColumn("room", F.greatest(F.lit(1), budget - F.col("lead") - F.col("history")).cast("long"))
    joined = summed.join(parts, same)
    return joined.select("conv_id", "role", "text", "tokens", (F.col("tokens_ahead") + F.col("tokens_inside")).alias("begin"), (F.col("rows_ahead") + F.col("rows_inside")).alias("place"), "turns", "lead", "history", "room")


def _build(turns: list[tuple[int, int, str, str]], block: int, system: tuple[str, int] | None, room: int, history: int, budget: int) -> Iterator[dict]:
    """Windows of one block of ``room`` tokens. turns: (begin, tokens, role, text), in order, with those of the block before that may be repeated."""
    own = [t for t in turns if t[0] // room == block]
    inside = [t for t in own if (t[0] + t[1] - 1) // room == block]
    for members in (inside, own[len(inside) :]):
        if not members:
            continue
        start = members[0][0]
        # the system turn begins at 0; it leads every window and is nowhere repeated as history
        lead = [(0, system[1], "system", system[0])] if system is not None and start > 0 else []
        left = min(history, budget - sum(t[1] for t in [*lead, *members]))
        repeated = [t for t in turns if start - left <= t[0] < start and not (system is not None and t[0] == 0)]
        pieces, spans, at = [], [], 0
        for k, (_, _, role, text) in enumerate([*lead, *repeated, *members]):
            piece, a, b = format_turn(role, text)
            if role == "assistant" and k >= len(lead) + len(repeated):
                spans.append({"from": at + a, "to": at + b})
            pieces.append(piece)
            at += len(piece)
        yield {"start": start, "text": "".join(pieces), "repeated": len(lead) + len(repeated), "spans": spans, "tokens": sum(t[1] for t in [*lead, *repeated, *members])}


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """The formatted windows: conv_id, start (tokens ahead), text, repeated (leading turns that are not the window's own), spans under the loss mask, tokens."""
    made = cut(conversations, budget, history)
    turns = placed_turns(made.where("start is null").select("conv_id", "role", "text", "tokens", "rows", "part", "tokens_inside", "rows_inside"), budget, history)
    blocks = F.array_distinct(F.array(F.floor(F.col("begin") / F.col("room")), F.floor((F.col("begin") + F.col("history")) / F.col("room"))))
    columns = ("conv_id", "block", "place", "begin", "tokens", "role", "text", "room", "history")
    dealt = turns.withColumn("block", F.explode(blocks)).select(*columns)
    # the system turn goes once to every block of its conversation that has turns of its own
    copies = F.floor(F.col("turns") / 1_000)
    heads = turns.where("place = 0 and role = 'system'").select(F.col("conv_id").alias("c"), F.explode(F.sequence(F.lit(0), copies)).alias("copy"), F.lit(-1).alias("place"), F.lit(0).alias("begin"), "tokens", "role", "text", "room", "history")
    led = turns.where("lead > 0").select("conv_id", F.floor(F.col("begin") / F.col("room")).alias("block"), copies.alias("copies")).distinct()
    led = led.join(heads, F.col("conv_id").eqNullSafe(F.col("c")) & (F.pmod("block", F.col("copies") + 1) == F.col("copy")))
    dealt = dealt.unionAll(led.select(*columns))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, system, rows = None, [], None, []

        def finish() -> list[dict]:
            return [{"conv_id": key[0], **row} for row in _build(held, key[1], system, *key[2:], budget)] if held else []

        for batch in batches:
            for conversation, block, place, begin, tokens, role, text, room, kept in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if (conversation, block, room, kept) != key:
                    rows += finish()
                    key, held, system = (conversation, block, room, kept), [], None
                if place < 0:
                    system = (text, tokens)
                else:
                    held.append((begin, tokens, role, text))
            if rows:
                yield _batch(rows)
                rows = []
        if rows := finish():
            yield _batch(rows)

    built = dealt.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place").mapInArrow(build, WINDOW_SCHEMA)
    return made.where("start is not null").select(*built.columns).union(built)


_SPANS = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
WINDOW_TYPES = pa.schema([("conv_id", pa.int64()), ("start", pa.int64()), ("text", pa.string()), ("repeated", pa.int32()), ("spans", _SPANS), ("tokens", pa.int64())])
CUT_TYPES = pa.schema([*WINDOW_TYPES, ("turn", pa.int64()), ("role", pa.string()), ("rows", pa.int64()), ("part", pa.int32()), ("tokens_inside", pa.int64()), ("rows_inside", pa.int64())])


def _batch(rows: list[dict], types: pa.Schema = WINDOW_TYPES) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, types)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the windows alone."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: list | None = None

        def done() -> pa.RecordBatch:
            key, n, turns, chars, loss, formatted_chars = current
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            values = [key, n, turns.hexdigest(), chars, loss.hexdigest(), formatted_chars]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        for batch in batches:
            for key, text, repeated, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "repeated", "spans")), strict=True):
                if current is None or current[0] != key:
                    if current is not None:
                        yield done()
                    current = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, _, _ in parse_window(text)[repeated:]:
                    current[1] += 1
                    current[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in spans:
                    said = unescape(text[span["from"] : span["to"]])
                    current[3] += len(said)
                    current[4].update(said.encode("utf-8", "surrogatepass"))
                current[5] += len(text)
        if current is not None:
            yield done()

    ordered = formatted.select("conv_id", "start", "text", "repeated", "spans").repartition("conv_id").sortWithinPartitions("conv_id", "start")
    return ordered.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the fixed conversation -1, formatted and read back."""
    fixed = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_back(windows(given.union(fixed)))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), costed AS (
  SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT + {turn_tokens} AS tokens,
         13 + length(role) + length(text) + len(regexp_extract_all(role, '{control}')) + len(regexp_extract_all(text, '{control}')) AS chars,
         row_number() OVER o - 1 AS place FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), placed AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins FROM costed
), heads AS (
  SELECT conv_id, chars, tokens FROM placed WHERE place = 0 AND role = 'system'
), kept AS (
  SELECT p.*, coalesce(h.tokens, 0) AS lead, least({history}, greatest(0, ({budget} - coalesce(h.tokens, 0)) // 2)) AS history
  FROM placed p LEFT JOIN heads h ON p.conv_id IS NOT DISTINCT FROM h.conv_id
), roomed AS (
  SELECT *, greatest(1, {budget} - lead - history) AS room FROM kept
), windows AS (
  SELECT conv_id, begins // room AS block, (begins + tokens - 1) // room = begins // room AS inside, min(begins) AS start,
         least(any_value(history), {budget} - sum(tokens) - CASE WHEN min(begins) > 0 THEN any_value(lead) ELSE 0 END) AS room_left
  FROM roomed GROUP BY conv_id, begins // room, (begins + tokens - 1) // room = begins // room
), repeated AS (
  SELECT w.conv_id, sum(p.chars) AS chars FROM windows w JOIN placed p ON w.conv_id IS NOT DISTINCT FROM p.conv_id
  AND p.begins >= w.start - room_left AND p.begins < w.start AND NOT (p.begins = 0 AND p.role = 'system') GROUP BY w.conv_id
), leads AS (
  SELECT w.conv_id, sum(h.chars) AS chars FROM windows w JOIN heads h ON w.conv_id IS NOT DISTINCT FROM h.conv_id WHERE w.start > 0 GROUP BY w.conv_id
), own AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
         coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars) AS chars
  FROM placed GROUP BY conv_id
)
SELECT o.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, (o.chars + coalesce(r.chars, 0) + coalesce(l.chars, 0))::BIGINT AS formatted_chars
FROM own o LEFT JOIN repeated r ON o.conv_id IS NOT DISTINCT FROM r.conv_id LEFT JOIN leads l ON o.conv_id IS NOT DISTINCT FROM l.conv_id
""".format(turn_tokens=TURN_TOKENS, budget=BUDGET, history=HISTORY, control="|".join(["\\\\", *(re.sub(r"([|\[\]])", r"\\\1", c) for c in CONTROL)]))
