"""Questions of chunks to the owners of hash ranges, and their answers, in at most two hops.

A chunk asks about its different values, sorted, with something beside each.
Values are dealt by range: the owner of a range gets all chunks' entries in it
and answers each of them. A chunk sends rows only for ranges it has values in,
and never more than FAN of them a kind: with more ranges than that the rows
stop over at hubs. A hub takes one coarse range of a group of FAN chunks,
deals it again by fine ranges in rows of many chunks, and hands the answers
back. Rows so grow with the input and not with chunks times ranges. Rows of kind 0, whatever they hold, pass unchanged.

An owner holds about its range's share of the entries; a value that every chunk
has costs its owner one entry a chunk.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, pack, tidied, unpack

#: Rows of a chunk and kind at most, chunks of a hub, and fine ranges of a coarse one.
FAN = 8192


@dataclass(frozen=True)
class Kind:
    """Values of so many bits travel in width bytes, what stands beside each in payload bytes."""

    bits: int
    width: int
    payload: int


ASK = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("values", pa.binary()), ("payload", pa.binary())])
BLOCK = pa.schema([("part", pa.int64()), ("hub", pa.int64()), ("kind", pa.int32()), ("sources", pa.binary()), ("lens", pa.binary()), ("values", pa.binary()), ("payload", pa.binary())])
BLOCK_DDL = "part long, hub long, kind int, sources binary, lens binary, values binary, payload binary"
#: distinct and total are an owner's own figures, in rows without chunk.
REPLY = pa.schema([("chunk", pa.int64()), ("hub", pa.int64()), ("kind", pa.int32()), ("part", pa.int64()), ("sources", pa.binary()), ("blobs", pa.list_(pa.binary())), ("distinct", pa.int64()), ("total", pa.int64())])
REPLY_DDL = "chunk long, hub long, kind int, part long, sources binary, blobs array<binary>, distinct long, total long"


def slices(values: np.ndarray, bits: int, parts: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of the ranges that sorted values fall in; ranges of a multiple of parts lie within these."""
    if not len(values):
        return []
    top = values >> np.uint64(bits - 32)
    r = ((top * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    at = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(r)]
    return [(int(r[a]), a, z) for a, z in zip(at, at[1:], strict=False)]


def exchange(rows: DataFrame, ask: Callable, kinds: dict[int, Kind], parts: int, chunks: int, reply: Callable) -> DataFrame:
    """(chunk, kind, part, blobs, distinct, total): the answers to each question, blobs in the order of its values.

    ask(batches of rows) yields (chunk, kind, values, payload) batches, a row for each chunk and kind, values sorted.
    reply(kind, values, payload, lens) gets an owner's entries, lens of each source after another, and returns the blobs,
    one for each source (None for no answer), and the owner's figures.
    """
    kind_no = {k: n for n, k in enumerate(sorted(kinds))}
    hops = parts > FAN
    coarse = -(-parts // FAN) if hops else parts
    groups = max(1, -(-chunks // FAN))

    def cut(batches):
        for b in ask(batches):
            for row in b.to_pylist():
                if row["kind"] == 0:
                    alone = -2 - row["chunk"]
                    yield batch(BLOCK, [alone], [alone], [0], [np.int64(row["chunk"]).tobytes()], [b""], [row["values"]], [b""])
                    continue
                k, chunk = kinds[row["kind"]], row["chunk"]
                values, payload = unpack(row["values"], k.width), unpack(row["payload"], k.payload)
                rows = []
                for r, a, z in slices(values, k.bits, coarse):
                    part = r * len(kinds) + kind_no[row["kind"]]
                    hub = part * groups + (chunk * 0x9E3779B97F4A7C15 >> 24) % groups if hops else -1
                    rows.append((part, hub, row["kind"], np.int64(chunk).tobytes(), np.int64(z - a).tobytes(), pack(values[a:z], k.width), pack(payload[a:z], k.payload)))
                if rows:
                    yield batch(BLOCK, *zip(*rows, strict=True))

    def deal_again(t: pa.Table) -> pa.Table:
        fine: dict[int, list] = {}
        rows = t.to_pylist()
        kind, hub = rows[0]["kind"], rows[0]["hub"]
        if kind == 0:
            return t
        k = kinds[kind]
        for row in rows:
            values, payload, source = unpack(row["values"], k.width), unpack(row["payload"], k.payload), np.frombuffer(row["sources"], np.int64)[0]
            for r, a, z in slices(values, k.bits, coarse * FAN):
                fine.setdefault(r, []).append((source, values[a:z], payload[a:z]))
        out = [(r * len(kinds) + kind_no[kind], hub, kind, np.array([s for s, _, _ in x], np.int64).tobytes(), np.array([len(v) for _, v, _ in x], np.int64).tobytes(), pack(np.concatenate([v for _, v, _ in x]), k.width), pack(np.concatenate([p for _, _, p in x]), k.payload)) for r, x in fine.items()]
        return pa.Table.from_batches([batch(BLOCK, *zip(*out, strict=True))])

    def answer(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        kind, part = rows[0]["kind"], rows[0]["part"]
        if kind == 0:
            return pa.Table.from_batches([batch(REPLY, *zip(*((int(np.frombuffer(r["sources"], np.int64)[0]), None, 0, 0, None, [r["values"]], None, None) for r in rows), strict=True))])
        k = kinds[kind]
        lens = [np.frombuffer(r["lens"], np.int64) for r in rows]
        blobs, distinct, total = reply(kind, np.concatenate([unpack(r["values"], k.width) for r in rows]), np.concatenate([unpack(r["payload"], k.payload) for r in rows]), np.concatenate(lens))
        out, at = [(None, None, kind, part, None, None, distinct, total)], 0
        for r, x in zip(rows, lens, strict=True):
            mine, at = blobs[at : at + len(x)], at + len(x)
            if r["hub"] >= 0:
                out.append((None, r["hub"], kind, part, r["sources"], mine, None, None))
            elif mine[0] is not None:
                out.append((int(np.frombuffer(r["sources"], np.int64)[0]), None, kind, part, None, mine, None, None))
        return pa.Table.from_batches([batch(REPLY, *zip(*out, strict=True))])

    def hand_back(t: pa.Table) -> pa.Table:
        by: dict[int, list] = {}
        rows = sorted(t.to_pylist(), key=lambda r: r["part"])
        for r in rows:
            for s, b in zip(np.frombuffer(r["sources"], np.int64).tolist(), r["blobs"], strict=True):
                if b is not None:
                    by.setdefault(s, []).append(b)
        out = [(s, None, rows[0]["kind"], rows[0]["part"], None, x, None, None) for s, x in by.items()]
        return pa.Table.from_batches([batch(REPLY, *zip(*out, strict=True))] if out else [], REPLY)

    blocks = rows.mapInArrow(tidied(cut), BLOCK_DDL)
    if hops:
        blocks = blocks.groupBy("hub").applyInArrow(deal_again, BLOCK_DDL)
    replies = blocks.groupBy("part").applyInArrow(answer, REPLY_DDL)
    if hops:
        from tessera.llm.common import stored

        replies = stored(replies, "range-answers")
        own = replies.where("hub IS NULL")
        replies = replies.where("hub IS NOT NULL").groupBy("hub").applyInArrow(hand_back, REPLY_DDL).unionByName(own)
    return replies.select("chunk", "kind", "part", "blobs", "distinct", "total")
