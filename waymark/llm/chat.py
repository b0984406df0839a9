"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. The operator never looks inside: it renders
successive prefixes and compares consecutive outputs. Where the longer output extends the shorter, the new tail is the turn's span; where it
does not, the template rewrites history and the conversation is marked so. Rendering the last turn with a probe text shows
where in its tail the text itself lies.

Rendering every prefix costs the square of a conversation's length. A template may declare, by ``append_only``, that a turn's rendering never depends on later
turns; only then are prefixes of long conversations cut to their last turns, and the joined tails must equal the whole rendering.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

OPEN, CLOSE = "### ", " </turn>\n"
#: A private character that stands for a turn's text when its place is searched.
PROBE = "\ue000"
#: Turns up to which prefixes are rendered whole for append-only templates too; for all other templates every prefix always is.
WHOLE_PREFIXES = 64
ROWS = 1024
#: Turns that a task has, about, where the session's shuffle partitions are fewer than that takes.
TASK_TURNS = 200_000


def escape(text: str) -> str:
    """Reversible, and free of control strings: no two # meet and no </turn> appears."""
    return re.sub(r"(?<=#)#", r"\\#", text.replace("\\", "\\\\")).replace("</turn>", "<\\/turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def append_only(template: Template) -> Template:
    """Declares that the template's output for more turns begins with that for fewer, whatever the turns."""
    template.append_only = True
    return template


@append_only
def marked(turns: list[Turn]) -> str:
    """The production template: ``### role: text </turn>`` and a line end for each turn, control strings escaped."""
    return "".join(f"{OPEN}{escape(role).replace(':', chr(92) + ':')}: {escape(text)}{CLOSE}" for role, text in turns)


HEADER = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)


def parse(formatted: str) -> list[Turn]:
    """The turns of a string that ``marked`` made."""
    out, at = [], 0
    while at < len(formatted):
        head = HEADER.match(formatted, at)
        end = formatted.find(CLOSE, head.end()) if head else -1
        if end < 0:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(head[1]), unescape(formatted[head.end() : end])))
        at = end + len(CLOSE)
    return out


def place(template: Template, before: list[Turn], turn: Turn, start: int, cur: str) -> tuple[int, int]:
    """Where the turn's text lies in cur, which ends with the turn's tail from start; the whole tail if the probe gets lost."""
    probed = template([*before, (turn[0], PROBE)])[start:]
    head = probed.find(PROBE)
    if head < 0 or probed.count(PROBE) != 1:
        return start, len(cur)
    tail = len(probed) - head - 1
    if cur[start : start + head] != probed[:head] or start + head > len(cur) - tail or (tail and cur[-tail:] != probed[-tail:]):
        return start, len(cur)
    return start + head, len(cur) - tail


def render(template: Template, turns: list[Turn], window: int = 2) -> tuple[str, list[tuple[int, int]], bool]:
    """(whole rendering, span of each turn's text in it, whether the template rewrites history).

    Every prefix is rendered whole and compared with the one before, whatever the length. Only templates declared ``append_only`` render long
    conversations over the last ``window`` turns and the new one; there the tails joined must equal the whole rendering, which proves
    the spans, or every prefix is rendered whole after all.
    """
    if len(turns) > WHOLE_PREFIXES and getattr(template, "append_only", False):
        parts, spans, at = [], [], 0
        for i, turn in enumerate(turns):
            before = turns[max(0, i - window) : i]
            prev = template(before) if before else ""
            cur = template([*before, turn])
            if not cur.startswith(prev):
                break
            a, b = place(template, before, turn, len(prev), cur)
            parts.append(cur[len(prev) :])
            spans.append((at + a - len(prev), at + b - len(prev)))
            at += len(cur) - len(prev)
        else:
            whole = template(turns)
            if "".join(parts) == whole:
                return whole, spans, False
    prev, spans, rewrites = template([]) if not turns else "", [], False
    for i, turn in enumerate(turns):
        cur = template(turns[: i + 1])
        same = cur.startswith(prev)
        rewrites |= not same
        # Of a rewritten history only the common start is certain; spans of turns that it lost are moved there.
        start = len(prev) if same else next((k for k, (x, y) in enumerate(zip(prev, cur)) if x != y), min(len(prev), len(cur)))
        spans = spans if same else [(min(a, start), min(b, start)) for a, b in spans]
        spans.append(place(template, turns[:i], turn, start, cur) if same else (start, len(cur)))
        prev = cur
    return prev, spans, rewrites


FORMATTED = "conv_id {kind}, formatted string, spans array<struct<role:string,start:long,stop:long>>, rewrites boolean"
SPANS = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[Turn]]]:
    """Sorted rows (conv_id, turn, role, text) as whole conversations; one may go on over many batches."""
    key, turns, any_row = None, [], False
    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            if any_row and conv != key:
                yield key, turns
                turns = []
            key, any_row = conv, True
            turns.append((role or "", text or ""))
    if any_row:
        yield key, turns


def format_chats(rows: DataFrame, template: Template = marked, window: int = 2) -> DataFrame:
    """(conv_id, formatted, spans, rewrites), a row for each conversation, written to the shared folder and read again.

    rows: conv_id, turn, role, text. Turns go by turn (null first), then role and text; repeated rows are turns of their own; null roles and texts count
    as empty. A null conv_id is a conversation. A conversation is rendered as one string, so all its turns come to one task; nothing else does.
    """
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType.simpleString()
    id_type = pa.int64() if kind in ("bigint", "int") else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in held], type=t) for i, t in enumerate((id_type, pa.string(), SPANS, pa.bool_()))]
            held.clear()
            return pa.record_batch(columns, names=["conv_id", "formatted", "spans", "rewrites"])

        for key, turns in conversations_of(batches):
            text, spans, rewrites = render(template, turns, window)
            held.append((key, text, [{"role": r, "start": a, "stop": b} for (r, _), (a, b) in zip(turns, spans, strict=True)], rewrites))
            if len(held) >= ROWS:
                yield flush()
        if held:
            yield flush()

    sorted_rows = (
        rows.select("conv_id", "turn", "role", "text")
        .repartition(partitions(spark, rows.count(), TASK_TURNS), "conv_id")
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    )
    return materialise(sorted_rows.mapInArrow(run, FORMATTED.format(kind=kind)), "chats")


def digests(formatted: DataFrame) -> DataFrame:
    """What the production template's output says, read back from it: turns, loss text under the assistant's spans, and sizes."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]
    hexed = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, spans, rewrites in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans if s["role"] == "assistant")
                rows.append((key, len(turns), hexed("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), hexed(loss), len(text), rewrites))
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")
