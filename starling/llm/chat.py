"""Chat formatting: conversations to text with a compiled template, and back.

The template marks turns with control strings. Where a text holds a control
string, a backslash is put after its first character, and every backslash is
doubled, so formatted texts hold only the template's own control strings and the
texts can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starling.llm.templates import Template

# Strings that common chat formats give a meaning; texts may not hold them bare.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|sep|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
TEMPLATE = (
    "{% for m in messages %}<|im_start|>{{ m.role | escape }}<|sep|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|im_end|>\n{% endfor %}"
)
_CONTROL = re.compile(r"\\|" + "|".join(f"(?<={re.escape(c[0])}){re.escape(c[1:])}" for c in sorted(CONTROLS, key=len, reverse=True)))
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|sep\|>(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], str(text))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def compiled(source: str = TEMPLATE) -> Template:
    return Template(source, {"escape": escape})


def format_conversations(
    rows: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``(conv_id, n_turns, formatted, spans)`` of every conversation.

    ``spans`` are the code points under the loss mask as (start, stop) pairs.
    Turns come by number, null ones first; ties by role and text. Null roles and
    texts are empty; rows with a null conversation are one conversation with a
    null id; repeated rows are turns of their own. Other columns are not looked
    at. Tasks go through turns in order and hold one conversation at a time.
    """
    plain = rows.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(span))])

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = compiled(template)
        held: list[dict] = []
        key, out, size = None, [], 0

        def close() -> tuple:
            text, spans = program.render(messages=held)
            return key, len(held), text, [{"start": a, "stop": b} for a, b in spans]

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for batch in batches:
            for conv, _, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held and conv != key:
                    out.append(close())
                    size += len(out[-1][2])
                    held = []
                    if size > 4_000_000:
                        yield flush()
                        out, size = [], 0
                key = conv
                held.append({"role": role, "text": text})
        if held:
            out.append(close())
        if out:
            yield flush()

    dealt = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(formatted, "conv_id long, n_turns long, formatted string, spans array<struct<start:long,stop:long>>")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of the turns of ``TEMPLATE``; an error if the text is not its output."""
    at, turns = 0, []
    for match in _TURN.finditer(formatted):
        if match.start() != at:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(match[1]), unescape(match[2])))
        at = match.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return turns


def digests(formatted: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``, read back from formatted conversations."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    encode = lambda s: s.encode("utf-8", "surrogatepass")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                turns = read_back(text)
                whole, loss = hashlib.sha256(), hashlib.sha256()
                for role, said in turns:
                    whole.update(encode(f"{role}\n{said}\n"))
                n = 0
                for s in spans:
                    learned = unescape(text[s["start"] : s["stop"]])
                    n += len(learned)
                    loss.update(encode(learned))
                out.append((conv, len(turns), whole.hexdigest(), n, loss.hexdigest(), len(text)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(rows, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
