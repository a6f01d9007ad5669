"""Chat formatting by schema fingerprint, in DataFrame operations only.

Each known layout of chat data is declared once as a set of nested field paths and a mapping that
turns a row into canonical turns (role, text). The sorted field paths of a table (or, for JSON
payloads, of each row) are hashed; the hash selects the mapping, so tables and rows of different
layouts go through one formatter. Paths that a layout does not know are left out before it is looked
up, so extra columns and fields do no harm; where several layouts are found, rows of turns go first,
then the layout with the most paths.

Format: ``<|role|>text<|end|>`` and a line feed for each turn. Inside roles and texts a backslash
becomes ``\\b`` and a vertical bar ``\\p``; a control string thus never occurs inside a text, and
two plain replacements restore it.

Defined results. Null role or text: empty. Turns are ordered by turn (null first), then role, then
text; repeated rows stay repeated. A payload with an empty list of turns has its list's layout and no
turns; one of unknown layout or broken JSON has ``layout`` null and no turns. Empty tables give empty
results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let

TURN = "struct<role:string,text:string>"
END = "<|end|>\n"
ASSISTANT = "assistant"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type, arrays marked by []: ``messages[].role``."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths) -> str:
    """SHA-256 of the sorted, distinct paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def _turn(role: Column | str, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _speaker(name: Column) -> Column:
    """Names that other layouts give to the three roles."""
    return F.when(name.isin("human", "prompter"), "user").when(name.isin("gpt", "bot", "model"), "assistant").otherwise(name)


def _pairs(question: Column, answer: Column) -> Column:
    return F.array(_turn("user", question), _turn(ASSISTANT, answer))


def _list(items: Column, role: str, text: str) -> Column:
    return F.coalesce(F.transform(items, lambda m: _turn(_speaker(m[role]), m[text])), F.array().cast(f"array<{TURN}>"))


#: Layout name -> (field paths, key path, schema of a JSON payload, turns from a getter of fields).
LAYOUTS: dict[str, tuple[tuple[str, ...], str, Callable]] = {
    "prompt_response": (("prompt", "response"), "prompt string, response string", lambda f: _pairs(f("prompt"), f("response"))),
    "prompt_completion": (("prompt", "completion"), "prompt string, completion string", lambda f: _pairs(f("prompt"), f("completion"))),
    "instruction": (("instruction", "output"), "instruction string, output string", lambda f: _pairs(f("instruction"), f("output"))),
    "instruction_input": (
        ("instruction", "input", "output"),
        "instruction string, input string, output string",
        lambda f: _pairs(F.concat_ws("\n", F.coalesce(f("instruction"), F.lit("")), F.when(f("input") != "", f("input"))), f("output")),
    ),
    "messages": (("messages[].role", "messages[].content"), "messages array<struct<role:string,content:string>>", lambda f: _list(f("messages"), "role", "content")),
    "conversations": (("conversations[].from", "conversations[].value"), "conversations array<struct<`from`:string,value:string>>", lambda f: _list(f("conversations"), "from", "value")),
}
#: The layout with a row for each turn; its turns are gathered by conversation.
ROWS = ("conv_id", "turn", "role", "text")
BY_FINGERPRINT = {fingerprint(paths): name for name, (paths, _, _) in LAYOUTS.items()} | {fingerprint(ROWS): "rows"}
#: Field paths of each layout, in the order in which they are tried.
_TRIED = [ROWS, *sorted((paths for paths, _, _ in LAYOUTS.values()), key=len, reverse=True)]


def layout_of(schema: T.StructType) -> str:
    """The layout that a table's fingerprint selects. ``conv_id`` is the key of every layout."""
    paths = set(field_paths(schema))
    for known in _TRIED:
        found = BY_FINGERPRINT.get(fingerprint(paths.intersection(known)))
        if found and "conv_id" in paths:
            return found
    raise ValueError(f"no chat layout has the field paths {sorted(paths)}")


def _gathered(rows: DataFrame) -> DataFrame:
    """One row a conversation. A conversation is one row of the result, so its turns must meet;
    conversations themselves are dealt by their key."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(turn)), lambda x: F.struct(x["role"], x["text"])).alias("turns"))


def canonical_turns(df: DataFrame) -> DataFrame:
    """(conv_id, turns) of a table in any known layout, chosen by the fingerprint of its schema."""
    name = layout_of(df.schema)
    if name == "rows":
        return _gathered(df.select(*ROWS))
    return df.select("conv_id", LAYOUTS[name][2](lambda field: df[field]).alias("turns"))


def payload_paths(payload: Column) -> Column:
    """Nested field paths of a JSON object, as ``field_paths`` writes them. The paths of a list are
    those of all its elements; an empty list has every path that some layout knows of it."""
    found = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    for field in sorted({p.split("[]")[0] for paths in _TRIED for p in paths if "[]" in p}):
        known = sorted({p for paths in _TRIED for p in paths if p.startswith(f"{field}[]")})
        elements = F.try_variant_get(F.try_parse_json(payload), f"$.{field}", "array<map<string,variant>>")
        keys = F.flatten(F.transform(F.filter(elements, lambda e: e.isNotNull()), lambda e: F.map_keys(e)))
        nested = F.when(F.size(elements) == 0, F.array(*map(F.lit, known))).otherwise(F.transform(keys, lambda k: F.concat(F.lit(f"{field}[]."), k)))
        found = F.when(F.array_contains(found, field), F.concat(found, F.coalesce(nested, F.array().cast("array<string>")))).otherwise(found)
    return found


def canonical_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(conv_id, layout, turns) of a column of JSON objects whose layout may differ by row: the
    fingerprint of each row's own field paths selects its mapping."""
    def selected(paths: Column) -> Column:
        names = F.create_map(*[F.lit(x) for pair in BY_FINGERPRINT.items() for x in pair])
        tried = [names[F.sha2(F.array_join(F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, known)))), "\n"), 256)] for known in _TRIED if known != ROWS]
        return F.coalesce(*tried)

    turns = F.lit(None).cast(f"array<{TURN}>")
    for name, (_, kind, build) in LAYOUTS.items():
        parsed = F.from_json(F.col(payload), kind)
        turns = F.when(F.col("layout") == name, build(lambda field, p=parsed: p[field])).otherwise(turns)
    picked = df.select("conv_id", payload, let(payload_paths(F.col(payload)), selected).alias("layout"))
    return picked.select("conv_id", "layout", F.coalesce(turns, F.array().cast(f"array<{TURN}>")).alias("turns"))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("|"), F.lit("\\p"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("|")), F.lit("\\b"), F.lit("\\"))


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted) from (conv_id, turns)."""
    one = F.transform("turns", lambda t: F.concat(F.lit("<|"), escaped(t["role"]), F.lit("|>"), escaped(t["text"]), F.lit(END)))
    return turns.select("conv_id", F.array_join(one, "").alias("formatted"))


def parse_chat(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns) with each turn's role, text and whether the loss covers it."""
    def turn(piece: Column) -> Column:
        at = F.locate("|>", piece)
        role = unescaped(F.substring(piece, F.lit(3), at - 3))
        text = unescaped(F.substring(piece, at + 2, F.char_length(piece)))
        return F.struct(role.alias("role"), text.alias("text"), (role == ASSISTANT).alias("loss"))

    pieces = F.filter(F.split("formatted", r"<\|end\|>\n", -1), lambda p: p != "")
    return formatted.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"))


def digests(parsed: DataFrame) -> DataFrame:
    """Counts and digests of what was read back from the formatted text."""
    def row(turns: Column) -> Column:
        loss = F.array_join(F.transform(F.filter(turns, lambda t: t["loss"]), lambda t: t["text"]), "")
        return F.struct(
            F.size(turns).cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.char_length(loss).cast("long").alias("loss_chars"),
            F.sha2(loss, 256).alias("loss_sha256"),
        )

    found = parsed.select("conv_id", let(F.col("turns"), row).alias("d"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return found.select("conv_id", "d.*", "formatted_chars")
