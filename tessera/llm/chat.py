"""Chat formatting by a finite-state machine over roles.

A declarative template names the states, the transitions that a valid
conversation takes, the markup around each role's text and which roles carry
loss. One streaming pass over the turns of each conversation, in order, emits
text segments, each with its loss flag; a conversation's text is the join of
its segments. Control strings inside texts and roles are escaped by an escape
character before their first character and before itself, so formatting is
reversible. Turns stream in sorted order: no conversation is collected, a hot
one only makes its task longer.

Defined results: null text is empty, null role is the empty role; rows of
equal (conv_id, turn) go by role, then text; repeated rows stay; invalid turn
orders are formatted all the same and flagged; null conv_ids are one
conversation; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch


@dataclass(frozen=True)
class Template:
    """Markup and machine: moves maps (state, role) to the next state; others are invalid and lead to the role's own state."""

    turn_open: str = "<s>"
    role_close: str = "[/ROLE]"
    turn_close: str = "</s>"
    escape: str = "\\"
    control: tuple[str, ...] = ("<s>", "</s>", "[/ROLE]", "[INST]", "[/INST]")
    loss_roles: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    moves: dict = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user", ("assistant", "tool"): "tool", ("tool", "assistant"): "assistant"})
    final: frozenset[str] = frozenset({"assistant"})

    def pattern(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, (self.escape, *sorted(self.control, key=len, reverse=True)))))

    def put(self, text: str) -> str:
        """Escape: every control string and every escape character gets an escape character in front."""
        return self.pattern().sub(lambda m: self.escape + m[0], text)

    def get(self, text: str) -> str:
        """The inverse of put."""
        return re.sub(re.escape(self.escape) + "(" + self.pattern().pattern + ")", lambda m: m[1], text)


SEGMENTS = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("part", pa.int32()), ("role", pa.string()), ("segment", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])
SEGMENTS_DDL = "conv_id long, turn_no long, part int, role string, segment string, loss boolean, valid boolean"
READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])
READ_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def format_chat(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments (conv_id, turn_no, part 0..2, role, segment, loss, valid), each conversation's rows together and in order.

    Part 0 opens the turn and names the role, part 1 is the escaped text, part
    2 closes the turn. loss marks the text of the template's loss roles; valid
    is false from the first turn that the machine does not allow.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        conv, state, valid, n = object(), "", True, 0
        for b in batches:
            out = []
            for conv_id, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if conv_id != conv:
                    conv, state, valid, n = conv_id, template.start, True, 0
                valid = valid and (state, role) in template.moves
                state = template.moves.get((state, role), role)
                loss = role in template.loss_roles
                out += [(conv_id, n, 0, role, template.turn_open + template.put(role) + template.role_close, False, valid), (conv_id, n, 1, role, template.put(text), loss, valid), (conv_id, n, 2, role, template.turn_close, False, valid)]
                n += 1
            if out:
                yield batch(SEGMENTS, *zip(*out, strict=True))

    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS_DDL)


def parse(template: Template, formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn, read from its text alone; raises ValueError where it isn't one."""
    found, pos, skip = [], 0, re.escape(template.escape) + "(?:" + template.pattern().pattern + ")"
    for m in re.finditer(f"{skip}|({'|'.join(map(re.escape, (template.turn_open, template.role_close, template.turn_close)))})", formatted):
        if m[1]:
            found.append((m[1], m.start(), m.end()))
    if [x[0] for x in found] != [template.turn_open, template.role_close, template.turn_close] or found[0][1] != pos or found[2][2] != len(formatted):
        raise ValueError("not a formatted turn")
    return template.get(formatted[found[0][2] : found[1][1]]), template.get(formatted[found[1][2] : found[2][1]])


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, from its segments alone: turns, their digest, the unescaped text under the loss mask, the length of it all."""

    def run(batches):
        conv, state = object(), None

        def begin(conv_id):
            return [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, []]

        def close(s):
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6] and s[8] in template.final

        for b in batches:
            out = []
            cols = [c.to_pylist() for c in b.columns]
            for conv_id, segment, loss, valid in zip(cols[0], cols[4], cols[5], cols[6], strict=True):
                if state is None or conv_id != conv:
                    if state is not None:
                        out.append(close(state))
                    conv, state = conv_id, [*begin(conv_id), ""]
                state[5] += len(segment)
                state[6] = state[6] and valid
                state[7].append(segment)
                if loss:
                    text = template.get(segment)
                    state[3] += len(text)
                    state[4].update(text.encode())
                if len(state[7]) == 3:
                    role, text = parse(template, "".join(state[7]))
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                    state[7], state[8] = [], role
            if out:
                yield batch(READ, *zip(*out, strict=True))
        if state is not None:
            yield batch(READ, *([x] for x in close(state)))

    return segments.mapInArrow(run, READ_DDL)


def whole(segments: DataFrame) -> DataFrame:
    """(conv_id, formatted) with each conversation's segments joined; for conversations of bounded length."""
    part = F.array_sort(F.collect_list(F.struct("turn_no", "part", "segment")))
    return segments.groupBy("conv_id").agg(F.array_join(F.transform(part, lambda x: x["segment"]), "").alias("formatted"))
