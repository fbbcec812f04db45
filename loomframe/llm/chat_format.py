"""Chat formatting: schema fingerprints select declarative mappings into canonical turns.

A record has nested field paths, of those that some mapping names; the hash of
a mapping's sorted paths, among those of the record's subsets of paths, picks
the mapping with the most paths. Mapped turns are
put into a template whose control strings cannot come from a text: inside a
text, a control string gets one `~` after its first character (one more where
some are there already), which `unescape` takes out again. The loss mask is a
run-length list over the formatted string: for each turn the characters before
the text, the text's, and those after it, and whether the text is learned.

Defined results: null text and role are empty; turns go by (turn, role, text),
a null turn first; a record of an unknown layout has a null layout and no turns;
of mappings with equally many paths the first of LAYOUTS is taken; a row of one
turn (`row_records`) keeps its turn number and its role as they are;
a repeated row is a turn of its own; empty tables give empty results; fields no
mapping names do not change the fingerprint. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
BEGIN, ROLE, TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = r"([<\[])(~*)(/?s>|/?INST\])"
ESCAPED = r"([<\[])~(~*)(/?s>|/?INST\])"

#: Layouts as field paths, and what each path becomes.
#: "each": (list field, role field, text field); "fixed": (role, fields joined by a blank line);
#: "flat": (turn field, role field, text field) of a record that is one turn.
LAYOUTS = {
    "messages": {"paths": ["messages[].content", "messages[].role"], "each": ("messages", "role", "content")},
    "conversations": {"paths": ["conversations[].from", "conversations[].value"], "each": ("conversations", "from", "value")},
    "instruction": {"paths": ["instruction", "output"], "fixed": [("user", ["instruction"]), ("assistant", ["output"])]},
    "instruction_input": {"paths": ["input", "instruction", "output"], "fixed": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "prompt_response": {"paths": ["prompt", "response"], "fixed": [("user", ["prompt"]), ("assistant", ["response"])]},
    "prompt_completion": {"paths": ["completion", "prompt"], "fixed": [("user", ["prompt"]), ("assistant", ["completion"])]},
    "question_answer": {"paths": ["answer", "question"], "fixed": [("user", ["question"]), ("assistant", ["answer"])]},
    "system_prompt_response": {"paths": ["prompt", "response", "system"], "fixed": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    "turn": {"paths": ["role", "text", "turn"], "flat": ("turn", "role", "text")},
}
#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
KNOWN = sorted({p for layout in LAYOUTS.values() for p in layout["paths"]})


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, r"$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.concat_ws("\n", F.array_sort(F.array_distinct(paths))))


def field_paths(record: Column) -> Column:
    """Paths of a JSON text, as deep as the mappings look: its fields and those of any element of its lists."""
    top = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    lists = sorted({layout["each"][0] for layout in LAYOUTS.values() if "each" in layout})

    def below(name: str) -> Column:
        elements = F.from_json(F.get_json_object(record, f"$.{name}"), "array<string>")
        keys = F.flatten(F.transform(elements, lambda e: F.coalesce(F.json_object_keys(e), F.array().cast("array<string>"))))
        return F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.concat(F.lit(f"{name}[]."), k))

    nested = [F.when(F.array_contains(top, x), below(x)).otherwise(F.array().cast("array<string>")) for x in lists]
    return F.array_intersect(F.concat(top, *nested), F.array(*[F.lit(p) for p in KNOWN]))


def row_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record) of (conv_id, turn, role, text) rows: each as the JSON text of its turn, nulls included."""
    return rows.select("conv_id", F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))


def role_name(role: Column) -> Column:
    out = role
    for other, name in ROLES.items():
        out = F.when(role == other, F.lit(name)).otherwise(out)
    return out


def mapped(record: Column, layout: dict) -> Column:
    if "each" in layout:
        field, role, text = layout["each"]
        rows = F.from_json(record, f"`{field}` array<struct<`{role}`:string,`{text}`:string>>")[field]
        return F.transform(rows, lambda m, i: F.struct(i.cast("bigint").alias("turn"), role_name(m[role]).alias("role"), m[text].alias("text")))
    if "flat" in layout:
        turn, role, text = layout["flat"]
        one = F.from_json(record, f"`{turn}` bigint, `{role}` string, `{text}` string")
        return F.array(F.struct(one[turn].alias("turn"), one[role].alias("role"), one[text].alias("text")))
    parts = [F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(role).alias("role"), F.array_join(F.filter(F.array(*[F.get_json_object(record, f"$.{f}") for f in fields]), lambda x: F.coalesce(x, F.lit("")) != ""), "\n\n").alias("text")) for i, (role, fields) in enumerate(layout["fixed"])]
    return F.array(*parts)


def canonical_turns(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, layout, turn, role, text) of JSON records of any known layouts; one row a turn.

    A record of no known layout keeps one row with null layout, turn, role and text.
    """
    at = records.select(F.col(id_col).alias("conv_id"), F.col(json_col).alias("record")).withColumn("paths", field_paths(F.col("record")))
    # The hash of those paths of a mapping that the record has; it is the mapping's own if it has all.
    order = sorted(LAYOUTS.items(), key=lambda x: -len(x[1]["paths"]))
    marks = [(name, F.array(*[F.lit(p) for p in how["paths"]])) for name, how in order]
    at = at.withColumn("layout", F.coalesce(*[F.when(fingerprint(F.array_intersect("paths", m)) == fingerprint(m), name) for name, m in marks]))
    turns = F.lit(None).cast("array<struct<turn:bigint,role:string,text:string>>")
    for name, how in LAYOUTS.items():
        turns = F.when(F.col("layout") == name, mapped(F.col("record"), how)).otherwise(turns)
    return at.select("conv_id", "layout", F.explode_outer(turns).alias("t")).select("conv_id", "layout", "t.turn", "t.role", "t.text")


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask) of (conv_id, turn, role, text) rows, one row a conversation.

    A conversation's turns meet in one row, as its text is one value; rows are
    gathered map-side first.
    """
    one = F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    per = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    said = F.transform("turns", lambda t: F.struct(t.role.alias("role"), escape(t.role).alias("head"), escape(t.text).alias("body")))
    put = F.transform("said", lambda t: F.concat(F.lit(ROLE), t["head"], F.lit(TEXT), t["body"], F.lit(END)))
    runs = F.transform("said", lambda t: F.struct((F.length(t["head"]) + len(ROLE) + len(TEXT)).cast("long").alias("before"), F.length(t["body"]).cast("long").alias("chars"), F.lit(len(END)).cast("long").alias("after"), (t["role"] == "assistant").alias("learn")))
    return per.select("conv_id", said.alias("said")).select("conv_id", F.concat(F.lit(BEGIN), F.array_join(put, "")).alias("formatted"), runs.alias("mask"))


def parsed(output: DataFrame) -> DataFrame:
    """`output` of formatted() with `turns` (role, body, text) read back from the string itself."""
    body = F.expr(f"substring(formatted, {len(BEGIN) + 1})")
    pieces = F.filter(F.split(body, END, -1), lambda p: p != "")
    halves = F.transform(pieces, lambda p: F.split(p, r"\[/INST\]", -1))
    turns = F.transform(halves, lambda h: F.struct(unescape(F.substring(F.element_at(h, 1), len(ROLE) + 1, 2**31 - 1)).alias("role"), F.element_at(h, 2).alias("body")))
    return output.withColumn("turns", F.transform(turns, lambda t: F.struct(t.role.alias("role"), t.body.alias("body"), unescape(t.body).alias("text"))))


def learned_text(turns: Column, mask: Column) -> Column:
    """The unescaped text under the mask, whose runs are held against the parsed pieces' lengths."""
    both = F.arrays_zip(turns.alias("t"), mask.alias("m"))
    kept = F.filter(both, lambda z: z["m"]["learn"] & (z["m"]["chars"] == F.length(z["t"]["body"])))
    return F.array_join(F.transform(kept, lambda z: z["t"]["text"]), "")
