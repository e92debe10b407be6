"""Chat records of many layouts to canonical turns, one template, and back; DataFrame functions only.

A record is JSON. Its nested field paths (names and nesting, not types, keys in order) are hashed to a fingerprint, which
selects one of the declared ``LAYOUTS``: where the turns are, and what their roles are called. A record
whose fingerprint is not declared, or that is no JSON (or is over 128 MiB, the most that a parsed value holds), keeps its row with null
``layout`` and ``turns``; :func:`turns_of` then takes the flat columns beside it, so that no turn is lost.

The template writes each turn as ``<|turn|>role``, a newline, the text and ``<|end|>``. Control strings inside roles and
texts are escaped (``ESCAPES``), so that reading back is exact whatever they hold. The loss mask is a list of runs
(characters, loss or not), three a turn; it covers the texts of the ``assistant``.

A null role or text is empty. Turns are ordered by turn number (null first), then by role and text, and repeated
rows are turns of their own. Turns are joined to a conversation in two steps, by 64s and then as a whole, so a very
long conversation is put together from few rows; its one digest needs its whole text in one row. Null conversation ids form one conversation.
Very long turns are kept whole. Empty tables give empty results. Other columns of the turns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Escape, string: the first must be the escape sign itself.
ESCAPES = [("~0", "~"), ("~1", "<|"), ("~2", "<s>"), ("~3", "</s>"), ("~4", "[INST]"), ("~5", "[/INST]"), ("~6", "<<SYS>>"), ("~7", "<</SYS>>")]
OPEN, END = "<|turn|>", "<|end|>"
CHUNK = 64
#: For JSON with a field for every null.
KEEP = {"ignoreNullFields": "false"}

#: Name, nested fields, then ("list", path, role field, text field, other names of roles) or ("fields", [(role, fields joined by an empty line), ...]).
LAYOUTS = [
    ("turn_row", {"conv_id": None, "role": None, "text": None, "turn": None}, ("row", "role", "text")),
    ("role_text", {"role": None, "text": None}, ("row", "role", "text")),
    ("role_content", {"content": None, "role": None}, ("row", "role", "content")),
    ("messages", {"messages": [{"content": None, "role": None}]}, ("list", "messages", "role", "content", {})),
    ("id_messages", {"id": None, "messages": [{"content": None, "role": None}]}, ("list", "messages", "role", "content", {})),
    ("from_value", {"conversations": [{"from": None, "value": None}]}, ("list", "conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    ("instruction", {"instruction": None, "output": None}, ("fields", [("user", ["instruction"]), ("assistant", ["output"])])),
    ("instruction_input", {"input": None, "instruction": None, "output": None}, ("fields", [("user", ["instruction", "input"]), ("assistant", ["output"])])),
    ("prompt_response", {"prompt": None, "response": None}, ("fields", [("user", ["prompt"]), ("assistant", ["response"])])),
    ("prompt_completion", {"completion": None, "prompt": None}, ("fields", [("user", ["prompt"]), ("assistant", ["completion"])])),
    ("system_prompt", {"prompt": None, "response": None, "system": None}, ("fields", [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])])),
    ("question_answer", {"answer": None, "question": None}, ("fields", [("user", ["question"]), ("assistant", ["answer"])])),
]

_TYPES = r"(: |<)(?:STRING|VOID|BOOLEAN|BIGINT|FLOAT|DOUBLE|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|VARIANT|DECIMAL\(\d+,\d+\))(?=[,>])"


def _paths(shape) -> str:
    if isinstance(shape, dict):
        return "OBJECT<" + ", ".join(f"{k}: {_paths(v)}" for k, v in sorted(shape.items())) + ">"
    return f"ARRAY<{_paths(shape[0])}>" if isinstance(shape, list) else ""


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a variant; null for what isn't an object."""
    return F.xxhash64(F.regexp_replace(F.schema_of_variant(record), _TYPES, "$1"))


def _turns(v: Column, spec: tuple) -> Column:
    def text(path: str) -> Column:
        return F.coalesce(F.try_variant_get(v, f"$.{path}", "string"), F.lit(""))

    def turn(role: Column, said: Column) -> Column:
        return F.struct(role.alias("role"), said.alias("text"))

    if spec[0] == "row":
        return F.array(turn(text(spec[1]), text(spec[2])))
    if spec[0] == "list":
        _, path, role, said, names = spec
        items = F.try_variant_get(v, f"$.{path}", f"array<struct<`{role}`:string,`{said}`:string>>")

        def one(x: Column) -> Column:
            name = F.coalesce(x[role], F.lit(""))
            for old, new in names.items():
                name = F.when(x[role] == old, new).otherwise(name)
            return turn(name, F.coalesce(x[said], F.lit("")))

        return F.transform(items, one)
    parts = [turn(F.lit(role), F.array_join(F.filter(F.array(*map(text, fields)), lambda s: s != ""), "\n\n")) for role, fields in spec[1]]
    return F.filter(F.array(*parts), lambda t: (t["role"] != "system") | (t["text"] != ""))


def canonical(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds ``fingerprint, layout, turns`` (array of role and text) to the rows; columns of these names are replaced."""
    v = F.try_parse_json(F.col(record))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for name, shape, spec in reversed(LAYOUTS):
        mine = F.col("fingerprint") == F.xxhash64(F.lit(_paths(shape)))
        layout, turns = F.when(mine, name).otherwise(layout), F.when(mine, _turns(v, spec)).otherwise(turns)
    return records.withColumn("fingerprint", fingerprint(v)).withColumns({"layout": layout, "turns": turns})


def escape(text: Column) -> Column:
    for code, plain in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for code, plain in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def render(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, formatted, mask`` of conversations whose rows are turns."""
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    head = F.concat(F.lit(OPEN), F.replace(escape(who), F.lit("\n"), F.lit("~8")), F.lit("\n"))
    run = lambda chars, loss: F.struct(chars.cast("long").alias("chars"), loss.alias("loss"))
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), who.alias("role"), said.alias("text"), head.alias("head"), escape(said).alias("body"))
    mask = F.array(run(F.length("head"), F.lit(False)), run(F.length("body"), F.col("role") == "assistant"), run(F.lit(len(END)), F.lit(False)))
    rows = rows.select("conv_id", F.floor(F.col("turn") / CHUNK).alias("part"), F.struct("turn", "role", "text", F.concat("head", "body", F.lit(END)).alias("out"), mask.alias("mask")).alias("t"))
    joined = lambda c: (F.array_join(F.transform(c, lambda x: x["out"]), "").alias("out"), F.flatten(F.transform(c, lambda x: x["mask"])).alias("mask"))
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("c")).select("conv_id", "part", *joined(F.col("c")))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "out", "mask"))).alias("c")).select("conv_id", *joined(F.col("c")))
    return whole.withColumnRenamed("out", "formatted")


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns (``role, text, loss``) of the output of :func:`render`, from its text and mask alone: ``conv_id, formatted, turns``."""
    pieces = F.split("formatted", r"<\|end\|>")
    own = F.slice(pieces, 1, F.size(pieces) - 1)  # what follows the last end mark is empty

    def turn(s: Column, i: Column) -> Column:
        inner = F.substring(s, len(OPEN) + 1, 2147483647)
        role = F.substring_index(inner, "\n", 1)
        text = F.substring(inner, F.length(role) + 2, F.lit(2147483647))
        return F.struct(unescape(F.replace(role, F.lit("~8"), F.lit("\n"))).alias("role"), unescape(text).alias("text"), F.get(F.col("mask"), i * 3 + 1)["loss"].alias("loss"))

    return formatted.select("conv_id", "formatted", F.transform(own, turn).alias("turns"))


def digest(back: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` from :func:`read_back`."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def records_of(turns: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` as JSON records of one turn in four layouts, dealt by turn number; ``role, text`` stay beside them."""
    role, text = F.col("role"), F.col("text")
    one = F.array(F.struct(role.alias("role"), text.alias("content")))
    said = F.array(F.struct(F.when(role == "user", "human").when(role == "assistant", "gpt").when(role.isin("human", "gpt"), None).otherwise(role).alias("from"), text.alias("value")))
    plain = role.isin("human", "gpt")  # these two mean other roles in the third layout
    shapes = [F.struct("conv_id", "role", "text", "turn"), F.struct(one.alias("messages")), F.struct(said.alias("conversations")), F.struct(text.alias("content"), role.alias("role"))]
    record, kind = F.to_json(shapes[0], KEEP), F.pmod(F.coalesce("turn", F.lit(0)), F.lit(4))
    for i, shape in enumerate(shapes[1:], 1):
        record = F.when((kind == i) & ~F.coalesce(plain, F.lit(False)), F.to_json(shape, KEEP)).otherwise(record)
    return turns.select("conv_id", "turn", record.alias("record"), "role", "text")


def turns_of(records: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of canonical records; a record that no JSON value can hold (over 128 MiB) gives its own ``role, text``."""
    own = F.array(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    return records.select("conv_id", "turn", F.inline(F.coalesce("turns", own)))
