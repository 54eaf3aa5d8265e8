"""Chat formatting: layouts told apart by a fingerprint of their nested field paths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed

HEAD, MIDDLE, TAIL = "### ", ":\n", "\n</turn>\n"
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """How the records of one fingerprint become turns.

    ``turns`` lists (role, field) in order; a field that is null or missing adds
    no turn unless it is the last. ``messages`` names an array field with the
    fields of role and text inside. ``rows`` names the fields of conversation,
    order, role and text where each record is one turn. One of the three is given.
    """

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    messages: tuple[str, str, str] | None = None
    rows: tuple[str, str, str, str] | None = None

    def paths(self) -> list[str]:
        if self.messages:
            field, role, text = self.messages
            return [f"{field}[].{role}", f"{field}[].{text}"]
        return list(self.rows) if self.rows else [field for _, field in self.turns]

    def fingerprint(self) -> str:
        return fingerprint(self.paths())


LAYOUTS = (
    Layout("turn rows", rows=("conv_id", "turn", "role", "text")),
    Layout("messages", messages=("messages", "role", "content")),
    Layout("conversations", messages=("conversations", "from", "value")),
    Layout("prompt and completion", turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt and response", turns=(("user", "prompt"), ("assistant", "response"))),
    Layout("system, prompt and response", turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", turns=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction and input", turns=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("question and answer", turns=(("user", "question"), ("assistant", "answer"))),
)


def fingerprint(paths: list[str]) -> str:
    """Hash of the nested field paths, in any order."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def schema_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Paths of the leaves of a type; ``[]`` follows an array."""
    if isinstance(kind, T.StructType):
        dot = f"{prefix}." if prefix else ""
        return [p for f in kind.fields for p in schema_paths(f.dataType, dot + f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, prefix + "[]")
    return [prefix]


def _role(role: Column) -> Column:
    known = F.coalesce(role, F.lit(""))
    for name, canonical in ROLES.items():
        known = F.when(known == name, canonical).otherwise(known)
    return known


def _turns_of(layout: Layout, get) -> Column:
    """Array of (turn, role, text) of a record; ``get`` gives a field by its path."""
    if layout.messages:
        field, role, text = layout.messages
        return F.transform(get(field), lambda m, i: F.struct(
            i.cast("long").alias("turn"), _role(m[role]).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))
    some = [
        F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.coalesce(get(field), F.lit("")).alias("text"))
        if i == len(layout.turns) - 1 else
        F.when(get(field).isNotNull(), F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), get(field).alias("text")))
        for i, (role, field) in enumerate(layout.turns)
    ]
    return F.filter(F.array(*some), lambda t: t.isNotNull())


def turns_of_table(records: DataFrame, id_col: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``conv_id, turn, role, text`` of a table whose layout is found by its fingerprint.

    The fingerprint is that of the table's paths that some layout knows, without
    the id. If further columns only look like fields of other layouts, the
    layout with most fields among those that are all there is taken, the first
    listed of equals. Raises if there is none. Rows by turn keep the roles they
    have; other layouts come to the canonical ones.
    """
    by_print = {fingerprint([p for p in layout.paths() if p != id_col]): layout for layout in reversed(layouts)}
    used = {p for layout in layouts for p in layout.paths()}
    own = {p for p in schema_paths(records.schema) if p in used}
    whole = sorted((x for x in layouts if set(x.paths()) <= own), key=lambda x: -len(x.paths()))
    layout = by_print.get(fingerprint(list(own - {id_col}))) or (whole[0] if whole else None)
    if layout is None:
        raise ValueError(f"no layout has the fields {sorted(own)}")
    if layout.rows:
        conv, turn, role, text = (records[f"`{c}`"] for c in layout.rows)
        return records.select(conv.alias("conv_id"), turn.cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
                              F.coalesce(text, F.lit("")).alias("text"))
    turns = _turns_of(layout, lambda field: records[f"`{field}`"])
    return records.select(records[f"`{id_col}`"].alias("conv_id"), F.explode(turns).alias("t")).select("conv_id", "t.*")


def turns_of_json(records: DataFrame, id_col: str = "conv_id", json_col: str = "record",
                  layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[DataFrame, DataFrame]:
    """Turns of JSON records of mixed layouts, and the rows no layout fits.

    Each record is parsed once; the fingerprint hashes its nested field paths and
    picks the layout, so the work per row does not depend on the others. The
    second result holds, whole, the rows that are no JSON object or have unknown paths.
    """
    named = [layout for layout in layouts if not layout.rows]
    parsed = records.select(packed(records)).withColumn("v", F.try_parse_json(F.col(f"row.`{json_col}`")))
    shape = F.coalesce(F.schema_of_variant("v"), F.lit(""))
    # The schema text without the types of the leaves is the list of nested paths.
    shape = F.regexp_replace(shape, r": (?!OBJECT|ARRAY)[A-Z]+(\([0-9, ]*\))?", "")
    parsed = parsed.withColumn("print", F.sha2(shape.cast("binary"), 256))
    chosen = F.lit(None).cast("int")
    turns = F.lit(None).cast("array<struct<turn: bigint, role: string, text: string>>")
    for k, layout in enumerate(named):
        of = hashlib.sha256(_shape(layout).encode()).hexdigest()
        chosen = F.when(F.col("print") == of, k).otherwise(chosen)

        def get(field, layout=layout):
            kind = "string"
            if layout.messages:
                kind = f"array<struct<`{layout.messages[1]}`: string, `{layout.messages[2]}`: string>>"
            return F.try_variant_get("v", f"$.{field}", kind)

        turns = F.when(F.col("print") == of, _turns_of(layout, get)).otherwise(turns)
    judged = parsed.withColumn("layout", chosen).withColumn("turns", turns)
    known = judged.where("layout is not null").select(F.col(f"row.`{id_col}`").alias("conv_id"), F.explode("turns").alias("t"))
    return known.select("conv_id", "t.*"), judged.where("layout is null").select("row.*")


def _shape(layout: Layout) -> str:
    """The schema text of a record of this layout, without leaf types; fields come sorted."""
    if layout.messages:
        field, role, text = layout.messages
        return f"OBJECT<{field}: ARRAY<OBJECT<{', '.join(sorted((role, text)))}>>>"
    return f"OBJECT<{', '.join(sorted(f for _, f in layout.turns))}>"


def escaped(text: Column) -> Column:
    r"""The text without control strings: ``\`` becomes ``\s``, ``###`` and ``</turn>`` lose their first sign to ``\h``, ``\l``."""
    text = F.replace(text, F.lit("\\"), F.lit("\\s"))
    text = F.regexp_replace(text, "#(?=##)", r"\\h")
    return F.regexp_replace(text, "<(?=/turn>)", r"\\l")


def escaped_role(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit(":"), F.lit("\\c")), F.lit("\n"), F.lit("\\n"))


def unescaped(text: str) -> str:
    r"""The inverse: in escaped text ``\`` is always followed by its letter."""
    if "\\" not in text:
        return text
    return text.replace("\\l", "<").replace("\\h", "#").replace("\\c", ":").replace("\\n", "\n").replace("\\s", "\\")


def formatted(turns: DataFrame) -> DataFrame:
    """One piece of formatted text per turn: ``conv_id, turn, role, text, piece, loss_from, loss_chars``.

    A conversation is its pieces by turn (ties by role, then text; a null turn
    last), nothing between: ``### role:``, the text and ``</turn>`` on lines of
    their own. The loss mask covers code points ``loss_from`` on, ``loss_chars``
    long, of pieces of the assistant; elsewhere both are null.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(HEAD), escaped_role(role), F.lit(MIDDLE))
    own = role == "assistant"
    return turns.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), head.alias("head"), escaped(text).alias("body"), own.alias("own")
    ).select(
        "conv_id", "turn", "role", "text", F.concat("head", "body", F.lit(TAIL)).alias("piece"),
        F.when(F.col("own"), F.length("head")).cast("long").alias("loss_from"),
        F.when(F.col("own"), F.length("body")).cast("long").alias("loss_chars"),
    )


class Reader:
    """Reads turns back from formatted text that comes in parts."""

    def __init__(self) -> None:
        self.rest = ""

    def turns(self, part: str) -> Iterator[tuple[str, str]]:
        self.rest += part
        *whole, self.rest = self.rest.split(TAIL)
        for piece in whole:
            role, middle, text = piece.removeprefix(HEAD).partition(MIDDLE)
            if not piece.startswith(HEAD) or not middle:
                raise ValueError(f"no turn: {piece[:80]!r}")
            yield unescaped(role), unescaped(text)


def digests(pieces: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted text: counts and hashes of turns and of the text under the mask.

    The pieces reach one task sorted and are read one after the other; the task
    holds a piece and two running hashes, so a conversation may have any length.
    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    lined = pieces.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "piece", "loss_from", "loss_chars")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridextremes.llm.chat import Reader, unescaped

        state, done = None, []

        def close() -> None:
            done.append((state["id"], state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            done.clear()
            return out

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_from", "loss_chars")]
            for conv, piece, start, length in zip(*columns, strict=True):
                if state is None or state["id"] != conv:
                    if state is not None:
                        close()
                    state = {"id": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0,
                             "chars": 0, "reader": Reader()}
                state["chars"] += len(piece)
                for role, text in state["reader"].turns(piece):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    masked = unescaped(piece[start : start + length])
                    state["loss_chars"] += len(masked)
                    state["loss"].update(masked.encode())
            if len(done) >= 1024:
                yield batch_of()
        if state is not None:
            close()
            yield batch_of()

    return lined.mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(records: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The formatted pieces of a table of any known layout.

    Null roles and texts are empty; a conversation without turns gives no row; a
    null conversation id is a conversation of its own; repeated rows are turns
    each; an empty table gives an empty result; columns no layout knows are not read.
    """
    return formatted(turns_of_table(records, id_col))
