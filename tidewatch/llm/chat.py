"""Chat formatting: logs of events are folded into final messages and rendered with an escaping template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A turn is "### role:\n" text "\n</turn>\n". Inside roles and texts these get a backslash before them, so that unescaped
#: they only stand where a turn begins or ends, and turns can be told apart in the output alone.
CONTROLS = r"(\\|###|</turn>)"
ROLE_CONTROLS = r"(\\|###|</turn>|:)"
_TEXT = r"(?:[^\\#<]|\\(?:\\|###|</turn>)|#(?!##)|<(?!/turn>))*+"
_ROLE = r"(?:[^\\#<:]|\\(?:\\|###|</turn>|:)|#(?!##)|<(?!/turn>))*+"
TURN = re.compile(rf"### ({_ROLE}):\n({_TEXT})</turn>\n")
LEARNED = "assistant"
DELTA = 256


def escape(text: Column, controls: str = CONTROLS) -> Column:
    return F.regexp_replace(text, controls, r"\\$1")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|###|</turn>|:)", r"\1", text)


def rows_to_events(rows: DataFrame, delta: int = DELTA) -> DataFrame:
    """The event log of a table of finished turns (conv_id, turn, role, text): each opens and streams its text in deltas.

    Rows of one conversation and turn are messages of their own, told apart by ``nth`` in order of role and text; repeated rows are
    messages each. Null texts are empty, null keys and roles are kept, other columns are ignored, an empty table gives no event.
    """
    nth = Window.partitionBy("conv_id", "turn").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.select("conv_id", "turn", "role", "text").withColumn("nth", F.row_number().over(nth))
    parts = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s).{{1,{delta}}}"), F.lit(0))
    events = F.concat(
        F.array(F.struct(F.lit(0).alias("seq"), F.lit("message").alias("kind"), F.lit("").alias("text"))),
        F.transform(parts, lambda x, i: F.struct((i + 1).alias("seq"), F.lit("delta").alias("kind"), x.alias("text"))),
    )
    return rows.select("conv_id", "turn", "nth", "role", F.inline(events))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, nth, role, text) of an event log (conv_id, turn, nth, seq, kind, role, text).

    The events of a message are sorted by ``seq``. ``message`` opens it, ``edit`` replaces its text, ``regenerate`` starts
    its text anew, ``delta`` adds to it; what came before the last of the first three no longer counts. A ``delete`` after
    that removes the message. The role is the last one given. Null texts and unknown kinds add nothing; ties of seq
    are taken in order of kind and text. A null turn comes first, a null conversation is one conversation. An empty
    log gives an empty result; other columns are ignored.

    The shuffle key is the message, so a conversation that holds a third of all events is spread over tasks.
    """
    event = F.struct(
        F.col("seq").cast("long").alias("seq"), F.coalesce("kind", F.lit("")).alias("kind"),
        F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("role"),
    )
    log = events.groupBy("conv_id", "turn", "nth").agg(F.sort_array(F.collect_list(event)).alias("log"))
    resets = F.filter(F.col("log"), lambda e: e["kind"].isin("message", "edit", "regenerate"))
    begin = F.coalesce(F.element_at(F.transform(resets, lambda e: e["seq"]), -1), F.lit(-(1 << 62)))
    log = log.withColumn("begin", F.when(F.size(resets) > 0, begin).otherwise(F.lit(-(1 << 62))))
    live = F.filter(F.col("log"), lambda e: (e["seq"].isNull() & (F.col("begin") == -(1 << 62))) | (e["seq"] >= F.col("begin")))
    parts = F.filter(live, lambda e: e["kind"].isin("message", "edit", "regenerate", "delta"))
    # Of several resets at one seq the last in order of kind and text counts.
    last = F.array_max(F.transform(parts, lambda e, i: F.when(e["kind"] != "delta", i).otherwise(F.lit(0))))
    text = F.array_join(F.transform(F.slice(parts, F.coalesce(last, F.lit(0)) + 1, F.greatest(F.size(parts), F.lit(1))), lambda e: e["text"]), "")
    roles = F.filter(F.transform(F.col("log"), lambda e: e["role"]), lambda r: r.isNotNull())
    gone = F.exists(live, lambda e: e["kind"] == "delete")
    return log.filter(~gone).select(
        "conv_id", "turn", "nth",
        F.when(F.size(roles) > 0, F.element_at(roles, -1)).otherwise(F.lit("")).alias("role"),
        text.alias("text"),
    )


def render(messages: DataFrame, learned: str = LEARNED) -> DataFrame:
    """The formatted turns: conv_id, turn, nth, formatted, loss_from, loss_to.

    A conversation's output is its ``formatted`` texts in order of (turn, nth). The loss mask of a turn is the range
    loss_from .. loss_to of code points: the escaped text of a ``learned`` role, else empty (both 0). Null roles and texts are empty,
    other columns are ignored.
    """
    head = F.concat(F.lit("### "), escape(F.coalesce("role", F.lit("")), ROLE_CONTROLS), F.lit(":\n"))
    body = escape(F.coalesce("text", F.lit("")))
    loss = F.coalesce(F.col("role") == learned, F.lit(False))
    return messages.select("conv_id", "turn", "nth", head.alias("head"), body.alias("body"), loss.alias("loss")).select(
        "conv_id", "turn", "nth",
        F.concat("head", "body", F.lit("\n</turn>\n")).alias("formatted"),
        F.when(F.col("loss"), F.length("head")).otherwise(0).cast("long").alias("loss_from"),
        F.when(F.col("loss"), F.length("head") + F.length("body")).otherwise(0).cast("long").alias("loss_to"),
    )


def format_conversations(events: DataFrame, learned: str = LEARNED) -> DataFrame:
    """Fold an event log and render it; see ``fold_events`` and ``render``."""
    return render(fold_events(events), learned)


class TurnReader:
    """Splits formatted text, given in pieces of any length, into (role, text) by its turn marks alone."""

    def __init__(self):
        self.held = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self.held = self.held + piece if self.held else piece
        at = 0
        while m := TURN.match(self.held, at):
            yield unescape(m[1]), unescape(m[2][:-1])
            at = m.end()
        self.held = self.held[at:]

    def close(self) -> None:
        if self.held:
            raise ValueError("the formatted text does not end with a turn")


def parse_conversation(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation; raises where it is none."""
    reader = TurnReader()
    out = list(reader.feed(formatted))
    reader.close()
    return out


def read_back(turns: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the output alone.

    A conversation is its ``formatted`` texts one after the other; its turns are found by the marks in them, not by rows. The loss is what the masks
    cut out of them. Rows of a null conversation are one conversation, an empty table gives an empty result. Hashes run over a conversation in order, so its turns pass through one task, one at a time; only the state of the
    hashes is held, whatever the length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []

        def close() -> pa.RecordBatch:
            key, n, turns_hash, chars, loss_hash, size, reader = state
            reader.close()
            row = {"conv_id": key, "n_turns": n, "turns_sha256": turns_hash.hexdigest(), "loss_chars": chars, "loss_sha256": loss_hash.hexdigest(), "formatted_chars": size}
            return pa.RecordBatch.from_pylist([row], schema=shape)

        for batch in batches:
            for row in batch.to_pylist():
                if not state or state[0] != row["conv_id"]:
                    if state:
                        yield close()
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, TurnReader()]
                for role, text in state[6].feed(row["formatted"]):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                loss = unescape(row["formatted"][row["loss_from"] : row["loss_to"]])
                state[3] += len(loss)
                state[4].update(loss.encode("utf-8", "surrogatepass"))
                state[5] += len(row["formatted"])
        if state:
            yield close()

    shape = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    ordered = turns.withColumn("conv_id", F.col("conv_id").cast("long")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "nth")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
