"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A record's fingerprint is the SHA-256 of its sorted nested field paths (``messages[].role``). A
typed DataFrame has one, taken from its schema; a column of JSON strings has one a row, taken from
the value's own schema. The fingerprint selects a `Mapping`, which says where turns are; where there are more
fields than a layout has, the fingerprint of those that a mapping names does, the mapping of most paths first, and
of as many the one listed first. Every layout becomes rows ``(conv_id, ord, role, text)``, and one template renders those.

The template marks each turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts
``&``, ``<`` and ``[`` (and line ends in roles) are written as entities, so that no control string
can come from a text, and `unescape` gives the text back.

Defined results: null roles and texts are empty; turns sort by order, role and text, nulls first;
repeated turns all stay; a record that holds no mapping's paths, or that isn't JSON, is kept with
``layout`` null and without turns by `layouts`, and yields no turn rows; empty inputs give empty
results; other columns and fields are left alone. All of it is built from SQL functions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.frames import fresh

#: Roles of other layouts, by the canonical name.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: What `escape` writes, in this order; `unescape` undoes it in the reverse order.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"))
LINE_END = ("\n", "&nl;")
START, STOP = "<|im_start|>", "<|im_end|>\n"


@dataclass(frozen=True)
class Mapping:
    """``fields``: (role, field paths whose non-empty texts join to a turn) in turn order; or
    ``items``: an array's field, and its role and text fields; or ``rows``: a row is one turn."""

    name: str
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: tuple[str, str, str] | None = None
    rows: tuple[str, str, str] | None = None
    extra: tuple[str, ...] = ()

    def paths(self) -> list[str]:
        own = [p for _, names in self.fields for p in names]
        own += [f"{self.items[0]}[].{x}" for x in self.items[1:]] if self.items else []
        return sorted({*own, *(self.rows or ()), *self.extra})

    def fingerprint(self) -> str:
        return digest(self.paths())


MAPPINGS = (
    Mapping("turn_rows", rows=("turn", "role", "text")),
    Mapping("prompt_completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("system_prompt_response", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question_answer", fields=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("instruction", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction_input", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("messages", items=("messages", "role", "content")),
    Mapping("conversations", items=("conversations", "from", "value")),
)


def digest(paths: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a Spark type."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def json_paths(record: Column) -> Column:
    """Sorted nested field paths of a JSON record, two levels deep; null if it is no object."""
    value = F.try_parse_json(record)
    top = F.json_object_keys(record)

    def nested(name: Column) -> Column:
        # the value's own type tells objects and arrays of objects from strings that look like them
        inner = F.from_json(record, "map<string,variant>")[name]
        kind = F.schema_of_variant(inner)
        items = F.when(kind.startswith("ARRAY<OBJECT<"), F.array_distinct(F.flatten(F.transform(inner.cast("array<map<string,variant>>"), F.map_keys))))
        fields = F.when(kind.startswith("OBJECT<"), F.map_keys(inner.cast("map<string,variant>")))
        return F.when(items.isNotNull(), F.transform(items, lambda k: F.concat(name, F.lit("[]."), k))).when(fields.isNotNull(), F.transform(fields, lambda k: F.concat(name, F.lit("."), k))).otherwise(F.array(name))

    return F.when(value.isNotNull() & top.isNotNull(), F.array_sort(F.array_distinct(F.flatten(F.transform(top, nested)))))


def _digested(paths: Column) -> Column:
    return F.sha2(F.array_join(paths, "\n"), 256)


def json_fingerprint(record: Column) -> Column:
    return _digested(json_paths(record))


def _role(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(known[name], name)


def _from_json(record: Column, mapping: Mapping) -> Column:
    """``array<struct<role,text>>`` of a JSON record of this mapping's layout."""
    if mapping.items:
        field, role, text = mapping.items
        items = F.from_json(record, f"struct<`{field}`:array<struct<`{role}`:string,`{text}`:string>>>")[field]
        return F.transform(items, lambda m: F.struct(_role(m[role]).alias("role"), m[text].alias("text")))
    names = [p for _, ps in mapping.fields for p in ps]
    values = F.from_json(record, "struct<" + ",".join(f"`{p}`:string" for p in names) + ">")
    return _joined(mapping, lambda p: values[p])


def _joined(mapping: Mapping, value) -> Column:
    """The turns of fixed fields; a turn of several fields joins those that aren't empty by a blank line."""
    turn = lambda ps: value(ps[0]) if len(ps) == 1 else F.concat_ws("\n\n", *[F.when(value(p) != "", value(p)) for p in ps])
    return F.array(*[F.struct(F.lit(role).alias("role"), turn(ps).alias("text")) for role, ps in mapping.fields])


def layouts(df: DataFrame, record_col: str, mappings: Sequence[Mapping] = MAPPINGS, out_prefix: str = "") -> DataFrame:
    """Add the fingerprint, layout and canonical ``turns`` of each JSON record."""
    fp, layout, turns = (f"{out_prefix}{x}" for x in ("fingerprint", "layout", "turns"))
    (paths,) = fresh(df, f"{out_prefix}paths")
    out = df.withColumn(paths, json_paths(F.col(record_col))).withColumn(fp, _digested(F.col(paths)))
    name, made = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for m in sorted((m for m in reversed(mappings) if not m.rows), key=lambda m: len(m.paths())):
        own = F.array_sort(F.array_intersect(F.col(paths), F.array(*map(F.lit, m.paths()))))
        fits = _digested(own) == m.fingerprint()
        name = F.when(fits, F.lit(m.name)).otherwise(name)
        made = F.when(fits, _from_json(F.col(record_col), m)).otherwise(made)
    return out.withColumns({layout: name, turns: made}).drop(paths)


def _explode(df: DataFrame, conv_col: str, turns: Column) -> DataFrame:
    return df.select(F.col(f"`{conv_col}`").cast("bigint").alias("conv_id"), F.posexplode(turns).alias("ord", "item")).select("conv_id", F.col("ord").cast("bigint").alias("ord"), "item.role", "item.text")


def json_turns(df: DataFrame, conv_col: str, record_col: str, mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """Canonical turn rows of a table of JSON records in any of the layouts."""
    made = layouts(df.select(F.col(f"`{conv_col}`").alias("__conv"), F.col(f"`{record_col}`").alias("__record")), "__record", mappings, "__")
    return _explode(made, "__conv", F.col("__turns"))


def frame_turns(df: DataFrame, conv_col: str, mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """Canonical turn rows of a typed table; its schema, without the id, selects the mapping."""
    paths = {p for f in df.schema.fields if f.name != conv_col for p in schema_paths(f.dataType, f.name)}
    fitting = [m for m in mappings if digest(sorted(paths & set(m.paths()))) == m.fingerprint()]
    mapping = max(fitting, key=lambda m: len(m.paths()), default=None)  # of equal ones the first
    if mapping is None:
        raise ValueError(f"no mapping for the field paths {sorted(paths)} (fingerprint {digest(sorted(paths))})")
    if mapping.rows:
        order, role, text = mapping.rows
        return df.select(F.col(f"`{conv_col}`").cast("bigint").alias("conv_id"), F.col(order).cast("bigint").alias("ord"), F.col(role).alias("role"), F.col(text).alias("text"))
    if mapping.items:
        field, role, text = mapping.items
        return _explode(df, conv_col, F.transform(F.col(field), lambda m: F.struct(_role(m[role]).alias("role"), m[text].alias("text"))))
    return _explode(df, conv_col, _joined(mapping, lambda p: F.col(f"`{p}`")))


def escape(text: Column, line_ends: bool = False) -> Column:
    for plain, written in (*ENTITIES, *((LINE_END,) if line_ends else ())):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column, line_ends: bool = False) -> Column:
    for plain, written in reversed((*ENTITIES, *((LINE_END,) if line_ends else ()))):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def render(turns: DataFrame) -> DataFrame:
    """One row a conversation: ``conv_id``, ``n_turns``, ``formatted`` and ``loss_spans``, the code
    point ranges of ``formatted`` that hold assistant texts. One shuffle, by conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), escape(role, line_ends=True), F.lit("\n"))
    rows = turns.select("conv_id", "ord", role.alias("role"), text.alias("text"), F.length(head).alias("head"), escape(text).alias("body"), head.alias("lead"))
    rows = rows.withColumn("n", F.col("head") + F.length("body") + len(STOP))
    along = Window.partitionBy("conv_id").orderBy("ord", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("ord", "role", "text")).alias("at"), "role", F.sum("n").over(along).alias("end"), "body", F.concat("lead", "body", F.lit(STOP)).alias("part"))
    stop = F.col("end") - len(STOP)
    span = F.when(F.col("role") == "assistant", F.struct((stop - F.length("body")).cast("bigint").alias("start"), stop.cast("bigint").alias("end")))
    made = rows.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"),
    )
    return made.select("conv_id", "n_turns", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("formatted"), "loss_spans")


def read_back(formatted: Column) -> Column:
    """``array<struct<role,text>>`` that a formatted conversation was made from."""
    blocks = F.split(formatted, r"<\|im_end\|>\n", -1)

    def turn(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        return F.struct(
            unescape(F.substr(head, F.lit(len(START) + 1)), line_ends=True).alias("role"),
            unescape(F.substr(block, F.length(head) + 2)).alias("text"),
        )

    return F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digests(rendered: DataFrame) -> DataFrame:
    """What each formatted conversation says when it is read back."""
    turns = F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = rendered.select("conv_id", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("bigint").alias("formatted_chars"))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
