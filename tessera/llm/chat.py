"""Chat formatting by a grammar round trip.

Grammar of a formatted conversation, read strictly from left to right:

    conversation := turn*
    turn         := "[INST] " text " [/INST]"            user
                  | "[OUT] " text "</s>"                 assistant
                  | "<<SYS>> " text " <</SYS>>"          system
                  | "[ROLE " role "] " text " [/ROLE]"   any other role

The text of a turn ends at the first closing mark of its kind.  Rendering tries a turn's text as it is, parses what it
rendered, and if role and text don't come back alike, or the text shows a control string of any kind, escapes its control strings and
parses again.  An escape puts a
backslash after the first character of a control string, and one more where backslashes stand there already; reading
takes one away, so any text survives.  The characters under the loss mask are the assistants' texts, as they stand in the
formatted text and without their marks.

Conversations are ordered by turn, role and text and never held whole: rows are streamed, and a formatted row holds the
turns of a conversation up to about ``ROW_CHARS`` characters (one row for all but very long ones), so the
number of turns is not bounded by memory.  One conversation's digests are sums over a sequence and stay in one task.

Defined results: null texts and roles are empty; a null turn comes first; repeated rows are turns of their own; a null conv_id
is a conversation of its own; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import row_chunks, scratch_path, text_of

ROW_CHARS = 1 << 20

MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", "</s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("[ROLE ", "] ", " [/ROLE]")
#: Strings that no text may show unescaped.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "<<SYS>>", "<</SYS>>", "[ROLE ", "[/ROLE]", "] ")

_BODIES = "|".join(re.escape(c[1:]) for c in CONTROL if c != "] ")
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_BODIES})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_BODIES})")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def _role_escape(role: str) -> str:
    """Roles end at "]": such characters, and backslashes, go as numbers."""
    return re.sub(r"[\\\]\[<]", lambda m: f"\\x{ord(m[0]):02x}", role)


def _role_unescape(role: str) -> str:
    return re.sub(r"\\x([0-9a-f]{2})", lambda m: chr(int(m[1], 16)), role)


def marks(role: str) -> tuple[str, str]:
    return MARKS.get(role) or (f"{OTHER[0]}{_role_escape(role)}{OTHER[1]}", OTHER[2])


class Broken(ValueError):
    """Text that is no conversation of the grammar."""


def parse_turn(text: str, at: int = 0) -> tuple[str, int, int, int]:
    """Role, start and end of the turn's escaped text, end of the turn."""
    for role, (opening, closing) in MARKS.items():
        if text.startswith(opening, at):
            break
    else:
        end = text.find(OTHER[1], at)
        if not text.startswith(OTHER[0], at) or end < 0:
            raise Broken(f"no turn at {at}")
        role, opening, closing = _role_unescape(text[at + len(OTHER[0]):end]), text[at:end + len(OTHER[1])], OTHER[2]
    start = at + len(opening)
    stop = text.find(closing, start)
    if stop < 0:
        raise Broken(f"a turn at {at} does not end")
    return role, start, stop, stop + len(closing)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, stop) of each turn of a formatted text."""
    out, at = [], 0
    while at < len(text):
        role, start, stop, at = parse_turn(text, at)
        out.append((role, unescape(text[start:stop]), start, stop))
    return out


def _reads_back(rendered: str, role: str, text: str) -> bool:
    try:
        got = parse(rendered)
    except Broken:
        return False
    return len(got) == 1 and got[0][:2] == (role, text)


def render_turn(role: str, text: str) -> str:
    """A turn whose parse is the turn: as it is if it shows no control string and reads back, else escaped."""
    opening, closing = marks(role)
    for body in (escape(text),) if _ESCAPE.search(text) else (text, escape(text)):
        rendered = f"{opening}{body}{closing}"
        if _reads_back(rendered, role, text):
            return rendered
    raise Broken(f"a turn of role {role!r} does not read back")


FORMATTED = "conv_id long, part int, formatted string, loss_start array<int>, loss_stop array<int>"


def _format(batches):
    """Sorted turns to formatted rows; turns of a conversation that spans batches go on."""
    import pyarrow as pa
    names = [x.split()[0] for x in FORMATTED.split(", ")]
    types = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    conv, part, text, size, starts, stops, ready = None, -1, [], 0, [], [], []

    def close():
        ready.append((conv, part, "".join(text), starts, stops))

    def batch():
        out = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*ready), types)], names)
        ready.clear()
        return out

    for convs, roles, texts in row_chunks(batches, ["conv_id", "role", "text"]):
        for c, role, body in zip(convs, roles, texts):
            if part < 0 or c != conv or size >= ROW_CHARS:
                if part >= 0:
                    close()
                part = 0 if part < 0 or c != conv else part + 1
                conv, text, size, starts, stops = c, [], 0, [], []
            rendered = render_turn(role, body)
            if role == "assistant":
                starts.append(size + len(MARKS[role][0]))
                stops.append(size + len(rendered) - len(MARKS[role][1]))
            text.append(rendered)
            size += len(rendered)
        if ready and (len(ready) >= 500 or sum(len(r[2]) for r in ready) > 1 << 22):
            yield batch()
    if part >= 0:
        close()
        yield batch()


def format_conversations(turns: DataFrame) -> DataFrame:
    """Formatted rows (conv_id, part, formatted, loss_start, loss_stop) of all conversations; the parts of a
    conversation, in order, are its text, and the loss spans are places in their part."""
    rows = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"))
    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "role", "text").mapInArrow(_format, FORMATTED))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches):
    import pyarrow as pa
    names = [x.split()[0] for x in DIGEST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    conv, begun, ready = None, False, []

    def close():
        ready.append((conv, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars))

    for convs, texts, starts, stops in row_chunks(batches, ["conv_id", "formatted", "loss_start", "loss_stop"], 64):
        for c, text, a, b in zip(convs, texts, starts, stops):
            if not begun or c != conv:
                if begun:
                    close()
                conv, begun, n, loss_chars, chars, whole, loss = c, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for role, body, _, _ in parse(text):
                n += 1
                whole.update(f"{role}\n{body}\n".encode())
            for x, y in zip(a, b):
                body = unescape(text[x:y])
                loss_chars += len(body)
                loss.update(body.encode())
            chars += len(text)
        if len(ready) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*ready), types)], names)
            ready.clear()
    if begun:
        close()
    if ready:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*ready), types)], names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, parsed from the formatted text and its loss spans alone."""
    return (formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
            .select("conv_id", "formatted", "loss_start", "loss_stop").mapInArrow(_read_back, DIGEST))


def round_trip(turns: DataFrame) -> DataFrame:
    """Format, write to the shared folder and read back."""
    out = scratch_path(turns.sparkSession, "chat")
    format_conversations(turns).write.parquet(out)
    return read_back(turns.sparkSession.read.schema(FORMATTED).parquet(out))
