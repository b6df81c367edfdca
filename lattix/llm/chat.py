"""Chat formatting by perspective rotation.

A dialogue is rendered once for each participant: that speaker's turns become the assistant's
and are the ones to learn from (the mask), all others become named users, system turns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.llm.common import Numbered, map_arrow

SYSTEM = "system"
END = "<|end|>\n"
#: Characters of rendered text that one Arrow batch gathers before it is sent on.
BATCH_CHARS = 4 << 20


def _safe(s: str) -> str:
    """Text that can't be read as markup."""
    return s.replace("<|", "< |")


def render(roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, list[tuple[int, int]]]]:
    """``(participant, text, mask)`` for each participant, in time linear in the rendered text."""
    bodies = [_safe(t) + END for t in texts]
    user = {r: f"<|user name={_safe(r)}|>\n" for r in roles} | {SYSTEM: "<|system|>\n"}
    for who in sorted({r for r in roles} - {SYSTEM}):
        parts, mask, at = [], [], 0
        for role, body in zip(roles, bodies, strict=True):
            head = "<|assistant|>\n" if role == who else user[role]
            end = at + len(head) + len(body)
            if role == who:
                mask.append((at + len(head), end))
            parts += (head, body)
            at = end
        yield who, "".join(parts), mask


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        conv, who, turns, text, mask = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(conv, kinds), pa.array(who, pa.string()), pa.array(turns, pa.int64()), pa.array(text, pa.string()), pa.array([[{"start": a, "end": b} for a, b in m] for m in mask], kind)],
            ["conv_id", "perspective", "n_turns", "text", "mask"],
        )

    for batch in batches:
        rows, held, kinds = [], 0, batch.column(0).type
        for k in range(batch.num_rows):
            said = batch.column(1)[k].values
            conv, roles, texts = batch.column(0)[k].as_py(), said.field("role").to_pylist(), said.field("text").to_pylist()
            for who, text, mask in render(roles, texts):
                rows.append((conv, who, len(roles), text, mask))
                held += len(text)
                if held > BATCH_CHARS:
                    yield packed(rows)
                    rows, held = [], 0
        if rows:
            yield packed(rows)


def perspectives(turns: DataFrame) -> DataFrame:
    """``(conv_id, perspective, n_turns, text, mask)`` for every participant of every dialogue, each rendered whole.

    ``turns`` has conv_id, turn, role and text, and any other columns, which are not read. Participants are the
    roles other than ``system``; a dialogue of system turns alone has none and so no row. ``mask`` lists character
    ranges ``{start, end}`` of text that the perspective's speaker wrote, each with its end mark. Turns come by
    turn (null first), role, text, whatever numbers or times the turns carry; rows that repeat a turn are
    rendered once each. A null role is the participant ``unknown``, a null text is empty. A row
    without conv_id belongs to no other row: it is a dialogue of one turn. The sequence ``<|`` in texts
    and names gets a blank, so that it is no markup. A dialogue is gathered where its texts are
    written; one of over 2 GB, which no row holds, fails.
    """
    table = Numbered(turns)
    said = table.df.select(table["conv_id"].alias("conv_id"), F.struct(table["turn"].cast("long").alias("turn"), F.coalesce(table["role"].cast("string"), F.lit("unknown")).alias("role"), F.coalesce(table["text"].cast("string"), F.lit("")).alias("text")).alias("said"))
    whole = said.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    alone = said.where("conv_id is null").select("conv_id", F.array("said").alias("turns"))
    kind = dict(whole.dtypes)["conv_id"]
    return map_arrow(whole.unionByName(alone), _rendered, f"conv_id {kind}, perspective string, n_turns long, text string, mask array<struct<start:int,end:int>>")
