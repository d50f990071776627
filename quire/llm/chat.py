"""Chat formatting with a template that is a black box.

A template is a function from turns, (role, text) pairs, to one string. What it does with a turn is found by incremental
rendering: successive prefixes of the conversation are rendered and consecutive outputs compared. As long as each output begins
with the one before, the new part is the turn's span. Where it doesn't, the template has rewritten history: the turn is reported, and
no span is taken from it. Where the text lies in a span is found with probes: the prefix is rendered with two
different single characters in place of the text; the first place in which they differ is where the text begins, and what
follows there is its tail. In a template that rewrites history, texts are located in the final output, by the same probes. A text that isn't
found as it was (trimmed, dropped, repeated) is reported too.

Texts may hold what the template uses as control strings. They are escaped before rendering: a control string gets a backslash
after its first character, one more if it has some already; taking one off restores the text exactly. Roles are escaped likewise.

A conversation may hold a third of all rows, so it is no group of any task. Turns are sorted in ranges of (conversation, turn)
and cut into blocks of at most BLOCK_TURNS turns or BLOCK_CHARS characters (or one longer turn). A block is rendered behind the turn
before it, which stands for the history; whether more of the history would have mattered is tested with two turns, and reported.
Only digests over a whole conversation need its blocks in order: a stream over sorted blocks, of which one is held at a time.

Results: `formatted` has a row a block, with its piece of the output and the spans of its turns; `summed` has a row a conversation.
Turns are ordered by turn, nulls last; ties by role, then by a hash of the text; equal rows are turns of their own.
A null text or role is an empty one; null conv_ids are one conversation. An empty table gives an empty result. Very long texts are
formatted whole. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import ship, stored, table

Turns = list[tuple[str, str]]

BLOCK_TURNS = 32
BLOCK_CHARS = 1 << 15
#: Rows of a sorted range, in large tables.
RANGE_ROWS = 200_000
#: Characters for private use, which no template knows; two that a conversation doesn't hold stand in for a text.
PROBES = [chr(c) for c in range(0xE000, 0xF8FF)]

#: The template's control strings, and how they look when escaped.
CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|/?TURN\])")
ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\]|/?TURN\])")
#: What a formatted conversation is made of: the start mark, a user's, an assistant's, or any other role's turn.
PIECE = re.compile(r"<s>|\[INST\] (?P<user>.*?) \[/INST\]|\[TURN\](?P<role>.*?)\[TURN\](?P<other>.*?)\[/TURN\]| (?P<assistant>.*?)</s>", re.S)


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def inst_template(turns: Turns) -> str:
    """`<s>`, then `[INST] text [/INST]` for a user, ` text</s>` for an assistant, `[TURN]role[TURN]text[/TURN]` for others."""
    out = ["<s>"]
    for role, text in turns:
        if role == "user":
            out.append(f"[INST] {text} [/INST]")
        elif role == "assistant":
            out.append(f" {text}</s>")
        else:
            out.append(f"[TURN]{role}[TURN]{text}[/TURN]")
    return "".join(out)


def parsed(piece: str) -> Turns:
    """The turns of inst_template's output, or of a part of it that begins and ends with whole turns, unescaped."""
    turns, at = [], 0
    while at < len(piece):
        m = PIECE.match(piece, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        if m.lastgroup:
            role = m["role"] if m.lastgroup == "other" else m.lastgroup
            turns.append((unescape(role), unescape(m[m.lastgroup])))
    return turns


@dataclass
class Span:
    """A turn's place in its block's piece, and its text's. Nulls where the template hides them."""

    start: int | None
    stop: int | None
    text_start: int | None
    text_stop: int | None


def _text_place(render: Callable[[Turns], str], before: Turns, role: str, text: str, after: Turns, out: str) -> tuple[int, int] | None:
    """Where text lies in out, the rendering of before, the turn, and after; None if not there, or not as it is."""
    probes = list(islice((p for p in PROBES if p not in out), 2))
    a, b = (render([*before, (role, p), *after]) for p in probes)
    if len(a) != len(b):
        return None
    at = a.find(probes[0])
    if at < 0 or a[:at] != b[:at] or a[at + 1 :] != b[at + 1 :]:
        return None
    stop = len(out) - (len(a) - at - 1)
    return (at, stop) if out[at:stop] == text and out[:at] == a[:at] and out[stop:] == a[at + 1 :] else None


def located(render: Callable[[Turns], str], turns: Turns, history: Turns = ()) -> tuple[str, list[Span], list[int], list[int]]:
    """(the turns' part of the output, their spans, the turns that rewrote what was before them, those whose text isn't found).

    history is what comes before the turns.
    """
    before = list(history)
    known = last = render(before) if before else ""
    outs = []
    spans: list[Span] = []
    rewrote: list[int] = []
    for n in range(len(turns)):
        out = render([*before, *turns[: n + 1]])
        if not out.startswith(last):
            rewrote.append(n)
        spans.append(Span(len(last), len(out), None, None))
        outs.append(out)
        last = out
    if rewrote:
        # Ends of prefixes mean nothing in the final output then.
        spans = [Span(None, None, None, None) for _ in turns]
    first = len(known if last.startswith(known) else os.path.commonprefix([known, last]))
    lost = []
    for n, (role, text) in enumerate(turns):
        after = list(turns[n + 1 :]) if rewrote else []
        place = _text_place(render, [*before, *turns[:n]], role, text, after, last if rewrote else outs[n])
        if place is None:
            lost.append(n)
        else:
            spans[n].text_start, spans[n].text_stop = place
    for s in spans:
        for f in ("start", "stop", "text_start", "text_stop"):
            at = getattr(s, f)
            setattr(s, f, None if at is None else at - first)
    return last[first:], spans, rewrote, lost


_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_SPAN = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("text_start", pa.int64()), ("text_stop", pa.int64()), ("loss", pa.bool_())])
_BLOCK = "part int, block long, first boolean, whole boolean"
_SPANS = "array<struct<turn:long,role:string,start:long,stop:long,text_start:long,text_stop:long,loss:boolean>>"


def blocks(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Stored rows (conv_id, part, block, first, whole, history, turns): runs of a conversation's turns, in the order of part and block.

    first: the conversation begins here; whole: it certainly ends here too; history: the two turns before, if there are any.
    """
    spark = conversations.sparkSession
    ship(spark)
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie"))
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    dealt = rows.withColumn("hash", F.xxhash64("text"))
    # The row's own number lets a range end between turns that tie in everything.
    order = [F.asc_nulls_last("conv_id"), F.asc_nulls_last("turn"), F.asc("role"), F.asc("hash"), F.asc("tie")]
    dealt = dealt.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).select("conv_id", "part", "role", "text")
    kind = dealt.schema["conv_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "part", "block", "first", "whole", "history", "turns"]
        none = object()
        seen, turns, size, number, before, opened, edge = none, [], 0, 0, [], True, True
        part, conv_type = 0, pa.int64()

        def row(whole: bool) -> dict:
            return {"conv_id": seen, "part": part, "block": number, "first": opened, "whole": whole, "history": before[-2:], "turns": turns}

        def packed(found: list[dict]) -> pa.RecordBatch:
            lists = pa.list_(_TURN)
            kinds = [conv_type, pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), lists, lists]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in zip(names, kinds)], names=names)

        for batch in batches:
            conv_type, found, held = batch.schema.field("conv_id").type, [], 0
            for conv, part, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                other = conv != seen or seen is none
                if turns and (other or len(turns) >= BLOCK_TURNS or size + len(text) > BLOCK_CHARS):
                    # A conversation at the edge of a range may go on in the next or come from the one before.
                    found.append(row(other and opened and not edge))
                    before, held = (before + turns)[-2:], held + size
                    turns, size, number, opened = [], 0, number + 1, False
                if other:
                    edge = seen is none
                    seen, before, opened = conv, [], True
                turns.append({"role": role, "text": text})
                size += len(text)
                if held > 16 * BLOCK_CHARS:
                    yield packed(found)
                    found, held = [], 0
            if found:
                yield packed(found)
        if turns:
            yield packed([row(False)])

    lists = "array<struct<role:string,text:string>>"
    made = stored(dealt.mapInArrow(cut, f"conv_id {kind}, {_BLOCK}, history {lists}, turns {lists}"), "blocks")
    # The first block of a range knows nothing of the range before. Its history is the end of that range's last block: one row a range.
    both = F.concat("history", "turns")
    end = F.when(F.size(both) > 2, F.slice(both, -2, 2)).otherwise(both)
    ends = made.groupBy("part").agg(F.min("block").alias("block"), F.min_by(F.struct("conv_id"), "block").alias("of_first"), F.max_by(F.struct("conv_id", end.alias("end")), "block").alias("last"))
    known = ends.withColumn("came", F.lag("last").over(Window.orderBy("part")))
    known = known.where(F.col("came").isNotNull() & F.col("came.conv_id").eqNullSafe(F.col("of_first.conv_id"))).select("part", "block", F.col("came.end").alias("came"))
    joined = made.join(F.broadcast(known), ["part", "block"], "left")
    return joined.withColumn("first", F.col("first") & F.col("came").isNull()).withColumn("history", F.coalesce("came", "history")).drop("came")


def formatted(conversations: DataFrame, render: Callable[[Turns], str] = inst_template, loss_roles: tuple[str, ...] = ("assistant",), **columns) -> DataFrame:
    """One row a block: conv_id, part, block, first, whole, piece, spans, rewrites, lost, deep.

    A conversation's output is its pieces in the order of part and block. spans has each turn's place in the piece, its text's,
    and whether it is under the loss mask. rewrites and lost are numbers of turns in the block: those at which the template changed
    its earlier output, and those whose text isn't in it as it was. deep: the turn before isn't all of the history that matters.
    """
    made = blocks(conversations, **columns)
    names = ["conv_id", "part", "block", "first", "whole"]
    kind = made.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                some = batch.slice(at, 64)
                out: dict[str, list] = {c: [] for c in ("piece", "spans", "rewrites", "lost", "deep")}
                for history, turns in zip(some.column("history").to_pylist(), some.column("turns").to_pylist()):
                    history, turns = ([(escape(t["role"]), escape(t["text"])) for t in ts] for ts in (history, turns))
                    piece, spans, rewrote, lost = located(render, turns, history[-1:])
                    deep = len(history) > 1 and located(render, turns[:1], history)[0] != located(render, turns[:1], history[-1:])[0]
                    rows = [{"turn": n, "role": r, **vars(s), "loss": unescape(r) in loss_roles} for n, ((r, _), s) in enumerate(zip(turns, spans))]
                    for c, value in (("piece", piece), ("spans", rows), ("rewrites", rewrote), ("lost", lost), ("deep", deep)):
                        out[c].append(value)
                kinds = {"piece": pa.string(), "spans": pa.list_(_SPAN), "rewrites": pa.list_(pa.int32()), "lost": pa.list_(pa.int32()), "deep": pa.bool_()}
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), *(pa.array(out[c], t) for c, t in kinds.items())], names=[*names, *kinds])

    schema = f"conv_id {kind}, {_BLOCK}, piece string, spans {_SPANS}, rewrites array<int>, lost array<int>, deep boolean"
    return stored(made.mapInArrow(run, schema), "formatted")


class Digests:
    """What is read back from a conversation's pieces, block after block."""

    def __init__(self, parse: Callable[[str], Turns]) -> None:
        self.parse, self.turns, self.loss = parse, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.rewrites = 0

    def add(self, piece: str, masked: list[tuple[int, int]], rewrites: int) -> None:
        for role, text in self.parse(piece):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        for start, stop in masked:
            text = unescape(piece[start:stop])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.chars += len(piece)
        self.rewrites += rewrites

    def row(self) -> list:
        return [self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.rewrites]


def summed(pieces: DataFrame, parse: Callable[[str], Turns] = parsed) -> DataFrame:
    """One row a conversation, from the rows of `formatted`: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites.

    All is read back from the pieces: turns by parse, texts under the loss mask by their spans. Blocks that are whole
    conversations are summed where they lie; others are dealt by conversation and streamed in order.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()
    masked = F.transform(F.filter("spans", lambda s: s["loss"] & s["text_start"].isNotNull()), lambda s: F.struct(s["text_start"].alias("start"), s["text_stop"].alias("stop")))
    narrow = pieces.select("conv_id", "whole", "part", "block", "piece", masked.alias("masked"), F.size("rewrites").alias("rewrites"))
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        seen, state, conv_type = none, None, None

        def packed(found: list) -> pa.RecordBatch:
            ids, rows = [i for i, _ in found], [r for _, r in found]
            return pa.RecordBatch.from_arrays([pa.array(ids, conv_type), *(pa.array([r[n] for r in rows], t) for n, t in enumerate(kinds))], names=["conv_id", *names])

        for batch in batches:
            conv_type, found = batch.schema.field("conv_id").type, []
            for at in range(len(batch)):
                conv = batch.column("conv_id")[at].as_py()
                if seen is none or conv != seen or batch.column("whole")[at].as_py():
                    if state:
                        found.append((seen, state.row()))
                    seen, state = conv, Digests(parse)
                state.add(batch.column("piece")[at].as_py(), [(m["start"], m["stop"]) for m in batch.column("masked")[at].as_py()], batch.column("rewrites")[at].as_py())
            if found:
                yield packed(found)
        if state:
            yield packed([(seen, state.row())])

    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long"
    cols = ["conv_id", "whole", "piece", "masked", "rewrites"]
    alone = narrow.where("whole").select(*cols).mapInArrow(run, schema)
    chained = narrow.where("not whole").repartition("conv_id").sortWithinPartitions(F.asc_nulls_last("conv_id"), "part", "block").select(*cols).mapInArrow(run, schema)
    return alone.unionAll(chained)


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return summed(formatted(given.unionAll(more.select(*[F.col(c).cast(given.schema[c].dataType).alias(c) for c in given.columns]))))


SQL = {
    "op11_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?TURN\])', '\1\\\2\3', 'g') AS t, regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|/?TURN\])', '\1\\\2\3', 'g') AS o FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(length(t) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 19 + length(o) END))::BIGINT AS formatted_chars, 0::BIGINT AS rewrites
FROM e GROUP BY conv_id""",
}
QUERIES = {"op11_chat_format": op11_chat_format}
