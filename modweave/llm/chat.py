"""Chat formatting at token level.

Each turn becomes reserved ids around two segments that are encoded separately, the role and the text:
``TURN role SEP text END``. The reserved ids lie behind the vocabulary, so no text can produce them. What would read
as a control string in the rendered text is escaped inside role and text, reversibly: a backslash goes before each
backslash and before the first character of each control string. The loss mask follows from the segments' lengths by
prefix sums: it covers the text of assistant turns.

Turns are range-partitioned in the order of their conversations, so a conversation of any length is dealt over tasks. A
task numbers the turns and tokens of what it has of a conversation; only its first one can have begun in tasks before,
and a table of at most one row per task tells by how much.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modweave.llm.runtime import written
from modweave.llm.tokens import NAME, library, vocabulary_path

# The template: control strings as rendered, in the order of their reserved ids behind the vocabulary.
CONTROLS = ("<turn>", "<text>", "</turn>")
# Strings of other templates that are escaped as well.
FOREIGN = ("### System:", "### User:", "### Assistant:", "<|endoftext|>", "<|im_start|>", "<|im_end|>")
TURN, SEP, END = range(3)
_ESCAPED = re.compile(r"\\|" + "|".join(f"(?={re.escape(c)})" for c in (*CONTROLS, *FOREIGN)))
_UNESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] else "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


class Template:
    """Encodes turns with a vocabulary and reads them back from ids and mask alone."""

    def __init__(self, json_path: str):
        from tokenizers import Tokenizer

        # an instance of its own: special strings inside segments are ordinary text here
        self.library = Tokenizer.from_file(json_path)
        self.library.encode_special_tokens = True
        self.base = library(json_path).get_vocab_size()

    def turns(self, roles: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all turns one after another, their loss mask, and the turns' bounds."""
        n, names = len(roles), sorted(set(roles))
        encoded = self.library.encode_batch_fast([escape(s) for s in (*names, *texts)], add_special_tokens=False)
        of = {name: e.ids for name, e in zip(names, encoded)}
        segments = [ids for role, text in zip(roles, encoded[len(names) :]) for ids in (of[role], text.ids)]
        lengths = np.array([len(e) for e in segments], np.int64).reshape(n, 2)
        ends = np.cumsum(lengths.sum(axis=1) + 3)
        bounds = np.concatenate([[0], ends])
        ids = np.empty(bounds[-1], np.int32)
        text_at = bounds[:-1] + lengths[:, 0] + 2
        ids[bounds[:-1]], ids[text_at - 1], ids[ends - 1] = self.base + TURN, self.base + SEP, self.base + END
        for i, (role, text) in enumerate(zip(segments[::2], segments[1::2])):
            ids[bounds[i] + 1 : text_at[i] - 1], ids[text_at[i] : ends[i] - 1] = role, text
        learnt = np.array([r == "assistant" for r in roles], bool)
        steps = np.zeros(len(ids) + 1, np.int8)
        np.add.at(steps, text_at[learnt], 1)
        np.add.at(steps, ends[learnt] - 1, -1)
        return ids, np.cumsum(steps[:-1], dtype=np.int8), bounds

    def render(self, ids: np.ndarray) -> str:
        """The formatted text of ids."""
        out, at = [], 0
        for i in np.append(np.flatnonzero(ids >= self.base), len(ids)):
            out.append(self._texts([ids[at:i]])[0])
            if i < len(ids):
                out.append(CONTROLS[int(ids[i]) - self.base])
            at = i + 1
        return "".join(out)

    def parse(self, turns: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[str, str, str]]:
        """Role, text and text under the mask of each turn, unescaped, from its ids and mask."""
        segments = []
        for ids, mask in turns:
            sep = int(np.flatnonzero(ids == self.base + SEP)[0])
            segments += [ids[1:sep], ids[sep + 1 : -1], ids[mask == 1]]
        found = [unescape(t) for t in self._texts(segments)]
        return list(zip(found[::3], found[1::3], found[2::3]))

    def _texts(self, segments: list[np.ndarray]) -> list[str]:
        return self.library.decode_batch([s.tolist() for s in segments], skip_special_tokens=False)


def rendered(role: str, text: str) -> str:
    """A turn as its ids read."""
    return f"{CONTROLS[TURN]}{escape(role)}{CONTROLS[SEP]}{escape(text)}{CONTROLS[END]}"


def _format(json_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        template, task = Template(json_path), TaskContext.get().partitionId()
        last, nth, place = object(), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                roles, texts = ([x or "" for x in part.column(c).to_pylist()] for c in ("role", "text"))
                ids, mask, bounds = template.turns(roles, texts)
                numbers, places = np.zeros(len(roles), np.int64), np.zeros(len(roles), np.int64)
                for i, conv in enumerate(part.column("conv_id").to_pylist()):
                    if conv != last:
                        last, nth, place = conv, 0, 0
                    numbers[i], places[i] = nth, place
                    nth, place = nth + 1, place + int(bounds[i + 1] - bounds[i])
                ends = pa.array(bounds.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), pa.array(np.full(len(roles), task, np.int32)), pa.array(numbers), pa.array(places), pa.ListArray.from_arrays(ends, pa.array(ids)), pa.ListArray.from_arrays(ends, pa.array(mask)), pa.array(list(map(rendered, roles, texts)), pa.string())],
                    ["conv_id", "task", "nth", "token_offset", "ids", "loss_mask", "formatted"],
                )

    return run


def format_chats(conversations: DataFrame, json_path: str | None = None) -> DataFrame:
    """One row per turn: conv_id, nth (from 0), token_offset (of the turn in its conversation), ids, loss_mask, formatted.

    Turns stand in order of turn, ties in order of role and text; null turns come first. A null role or text counts as
    empty; rows with a null conv_id are one conversation; repeated rows are turns of their own. nth tells the order, the
    rows of the result may come in any. Extra columns are ignored.
    """
    spark = conversations.sparkSession
    rows = conversations.select("conv_id", "turn", "role", "text")
    order = ["conv_id", "turn", "role", "text"]
    # texts that begin alike stay together, so that their order is kept; whole texts would be heavy as bounds
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order[:3], F.substring("text", 1, 64)).sortWithinPartitions(*order)
    kind = rows.schema["conv_id"].dataType.simpleString()
    run = _format(json_path or vocabulary_path(NAME, ".json"))
    found = written(dealt.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, task int, nth long, token_offset long, ids array<int>, loss_mask array<tinyint>, formatted string"))
    held = found.groupBy("conv_id", "task").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("tokens"))
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    begun = held.select(F.col("conv_id").alias("__conv"), F.col("task").alias("__task"), F.sum("n").over(before).alias("__n"), F.sum("tokens").over(before).alias("__tokens")).where("__n > 0")
    found = found.join(F.broadcast(begun), (F.col("task") == F.col("__task")) & F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    return found.select("conv_id", (F.col("nth") + F.coalesce("__n", F.lit(0))).alias("nth"), (F.col("token_offset") + F.coalesce("__tokens", F.lit(0))).alias("token_offset"), "ids", "loss_mask", "formatted")


def _parsed(json_path: str):
    """Turns (conv_id, nth, role, text, learnt, chars) as their ids and masks read; learnt is null where it is all of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(json_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                turns = [(i.values.to_numpy(), m.values.to_numpy()) for i, m in zip(part.column("ids"), part.column("loss_mask"))]
                roles, texts, learnt = zip(*template.parse(turns))
                learnt = [None if x == t else x for x, t in zip(learnt, texts)]
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("nth"), *(pa.array(c, pa.string()) for c in (roles, texts, learnt)), part.column("chars")], ["conv_id", "nth", "role", "text", "learnt", "chars"])

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation of turns that come in order."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    state, kind = None, pa.int64()

    def closed(states: list):
        types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        rows = [(conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted) for conv, n, turns, chars, loss, formatted in states]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        kind, done = batch.column("conv_id").type, []
        for conv, role, text, learnt, formatted in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "learnt", "chars"))):
            if state is None or conv != state[0]:
                done += [state] if state is not None else []
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            learnt = text if learnt is None else learnt
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            state[3] += len(learnt)
            state[4].update(learnt.encode())
            state[5] += formatted
        if done:
            yield closed(done)
    if state is not None:
        yield closed([state])


def read_back(chats: DataFrame, json_path: str | None = None) -> DataFrame:
    """Per conversation of ``format_chats``, wherever its rows are: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, from the ids and masks.

    Ids are decoded where their rows are. A digest is over a conversation from its first turn to its last, so one task reads
    its text, as a stream: no conversation is held in memory, however long.
    """
    kind = chats.schema["conv_id"].dataType.simpleString()
    run = _parsed(json_path or vocabulary_path(NAME, ".json"))
    rows = chats.select("conv_id", "nth", "ids", "loss_mask", F.length("formatted").alias("chars"))
    turns = rows.mapInArrow(run, f"conv_id {kind}, nth long, role string, text string, learnt string, chars int")
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "nth")
    return turns.mapInArrow(_digests, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
