"""Columnar encodings as data transformations: each encodes rows to rows, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.positional import FRAG, OFF, visible_counts, with_ordinals

#: Most values a run of one byte length can have.
RUN = 255


def rle_encode(df: DataFrame, column: str, longest: int | None = RUN) -> DataFrame:
    """``(__frag, start, value, length)``: runs of equal values (nulls are equal) in each fragment, none longer
    than ``longest``. Runs end with their fragment, as they do with a page."""
    along = Window.partitionBy(FRAG).orderBy(OFF)
    first = F.lag(OFF).over(along).isNull() | ~F.lag(column).over(along).eqNullSafe(F.col(column))
    marked = df.select(FRAG, OFF, F.col(column).alias("value"), first.cast("int").alias("first"))
    runs = marked.withColumn("run", F.sum("first").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.groupBy(FRAG, "run").agg(F.min(OFF).alias("start"), F.first("value").alias("value"), F.count(F.lit(1)).alias("length"))
    if longest is None:
        return whole.select(FRAG, "start", "value", "length")
    piece = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(longest).cast("bigint")))
    cut = whole.select(FRAG, "start", "value", "length", piece.alias("at"))
    return cut.select(FRAG, (F.col("start") + F.col("at")).alias("start"), "value", F.least(F.col("length") - F.col("at"), F.lit(longest)).cast("bigint").alias("length"))


def rle_decode(runs: DataFrame) -> DataFrame:
    """``(__frag, __off, value)``; a run without values is an error."""
    length = F.when(F.col("length") > 0, F.col("length")).otherwise(F.raise_error(F.lit("a run has no values")).cast("bigint"))
    return runs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), length - 1))).select(FRAG, (F.col("start") + F.col("i")).alias(OFF), "value")


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """``(index, value)``: distinct values, numbered by where they first occur: in their fragment, after those that
    first occur in earlier fragments."""
    first = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(F.struct(FRAG, OFF)).alias("at")).select("value", f"at.{FRAG}", f"at.{OFF}")
    return with_ordinals(first, visible_counts(first)).select(F.col("__ord").alias("index"), "value")


def dictionary_encode(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """``(__frag, __off, index)``; null stays null. Spark broadcasts the dictionary if it is small."""
    return df.select(FRAG, OFF, F.col(column).alias("value")).join(values, "value", "left").select(FRAG, OFF, "index")


def dictionary_decode(indices: DataFrame, values: DataFrame) -> DataFrame:
    return indices.join(values, "index", "left").select(FRAG, OFF, "value")


def bit_width(largest: Column) -> Column:
    """Bits that numbers from 0 to ``largest`` need; at least one."""
    return F.greatest(F.lit(1), F.length(F.bin(largest))).cast("int")


def bitpack(df: DataFrame, column: str, width: int, chunk: int = 1024) -> DataFrame:
    """``(__frag, chunk, word, bits, n)``: values of ``width`` bits each, lowest bits first, in 32-bit words.

    A value that lies across two words adds to both; a word is the sum of what falls into it. A null is packed as 0.
    """
    value, i = F.coalesce(F.col(column).cast("bigint"), F.lit(0)), F.col(OFF) % chunk
    placed = df.select(FRAG, F.expr(f"{OFF} div {chunk}").alias("chunk"), value.alias("v"), (i * width).alias("bit"))
    placed = placed.withColumns({"word": F.expr("bit div 32"), "shift": (F.col("bit") % 32).cast("int")})
    low = F.expr("shiftleft(v, shift) & 4294967295")
    high = F.expr("shiftright(v, 32 - shift)")
    parts = placed.select(FRAG, "chunk", F.explode(F.array(F.struct("word", low.alias("part")), F.struct((F.col("word") + 1).alias("word"), F.when(F.col("shift") + width > 32, high).alias("part")))).alias("p"))
    return parts.filter("p.part is not null").groupBy(FRAG, "chunk", "p.word").agg(F.sum("p.part").alias("bits"))


def bitunpack(words: DataFrame, sizes: DataFrame, width: int, chunk: int = 1024, signed: bool = False) -> DataFrame:
    """``(__frag, __off, value)`` from `bitpack`'s words and ``(__frag, rows)``; a chunk that lacks words is an error.

    A chunk's words are one value and its rows are worked out from it: rows made before a join are taken by Spark for
    as small as the sizes that they come from, and broadcast.
    """
    held = words.groupBy(FRAG, "chunk").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    chunks = sizes.filter("rows > 0").select(FRAG, "rows", F.explode(F.expr(f"sequence(0L, (rows - 1) div {chunk})")).alias("chunk"))
    chunks = chunks.withColumn("n", F.expr(f"least(rows - chunk * {chunk}, {chunk}L)")).join(held, [FRAG, "chunk"], "left")
    last = F.expr(f"(n * {width} + 31) div 32 - 1")
    n = F.when(F.get("words", last.cast("int"))["word"] == last, F.col("n")).otherwise(F.raise_error(F.lit("a chunk lacks words")).cast("bigint"))
    rows = chunks.select(FRAG, "chunk", "words", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("i")).withColumn("bit", F.col("i") * width)
    at = F.expr("bit div 32").cast("int")
    rows = rows.select(FRAG, (F.col("chunk") * chunk + F.col("i")).alias(OFF), (F.col("bit") % 32).cast("int").alias("shift"), F.get("words", at)["bits"].alias("bits"), F.get("words", at + 1)["bits"].alias("next"))
    mask = (1 << width) - 1
    raw = F.expr(f"(shiftrightunsigned(bits, shift) | case when shift + {width} > 32 then shiftleft(coalesce(next, 0L), 32 - shift) else 0L end) & {mask}L")
    value = F.when(raw >= 1 << (width - 1), raw - (1 << width)).otherwise(raw) if signed else raw
    return rows.select(FRAG, OFF, value.alias("value"))


def constants(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(__frag, column, kind, value)``: which of a fragment's columns are one value, all null, or one value and nulls."""
    stats = df.groupBy(FRAG).agg(*[F.struct(F.count(F.lit(1)).alias("n"), F.count(c).alias("valid"), F.min(F.col(c).cast("string")).alias("low"), F.max(F.col(c).cast("string")).alias("high")).alias(c) for c in columns])
    each = stats.select(FRAG, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])).alias("x"))
    s = F.col("x.s")
    kind = F.when(s["valid"] == 0, "null").when(s["low"] != s["high"], "varied").when(s["valid"] < s["n"], "constant with nulls").otherwise("constant")
    return each.select(FRAG, F.col("x.column").alias("column"), kind.alias("kind"), F.when(kind.startswith("constant"), s["low"]).alias("value"))


def validity_split(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """A fragment's validity ``(__frag, __off, valid)``, and its values without gaps ``(__frag, at, value)``."""
    along = Window.partitionBy(FRAG).orderBy(OFF)
    dense = df.filter(F.col(column).isNotNull()).select(FRAG, (F.row_number().over(along) - 1).cast("bigint").alias("at"), F.col(column).alias("value"))
    return df.select(FRAG, OFF, F.col(column).isNotNull().alias("valid")), dense


def validity_expand(validity: DataFrame, dense: DataFrame) -> DataFrame:
    """``(__frag, __off, value)``: the values back among the nulls, by a running count of valid rows."""
    along = Window.partitionBy(FRAG).orderBy(OFF).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col("valid"), F.sum(F.col("valid").cast("bigint")).over(along) - 1)
    return validity.withColumn("at", at).join(dense, [FRAG, "at"], "left").select(FRAG, OFF, "value")


def blob_descriptors(df: DataFrame, column: str) -> DataFrame:
    """``(__frag, __off, position, size)`` of values laid end to end in each fragment: an empty value has size and
    position 0, a null one size 0 and position 1."""
    size = F.coalesce(F.octet_length(column), F.lit(0)).cast("bigint")
    end = F.sum(size).over(Window.partitionBy(FRAG).orderBy(OFF).rowsBetween(Window.unboundedPreceding, 0))
    position = F.when(F.col(column).isNull(), 1).when(size == 0, 0).otherwise(end - size)
    return df.select(FRAG, OFF, position.cast("bigint").alias("position"), size.alias("size"))


def packed_struct(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(__frag, __off, packed)``: one value a row."""
    return df.select(FRAG, OFF, F.struct(*columns).alias("packed"))


def pack_fixed(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """``(__frag, __off, bytes)``: whole numbers of so many bytes each, highest byte first, row by row."""
    return df.select(FRAG, OFF, F.concat(*[F.unhex(F.right(F.lpad(F.hex(F.col(c).cast("bigint")), 16, "0"), F.lit(2 * w))) for c, w in widths.items()]).alias("bytes"))


def unpack_fixed(packed: DataFrame, widths: dict[str, int]) -> DataFrame:
    """What `pack_fixed` packed, as unsigned numbers of fewer than 8 bytes."""
    at, out = 1, []
    for c, w in widths.items():
        out.append(F.conv(F.hex(F.substring("bytes", at, w)), 16, 10).cast("bigint").alias(c))
        at += w
    return packed.select(FRAG, OFF, *out)


def offsets_encode(df: DataFrame, column: str) -> DataFrame:
    """``(__frag, __off, end)``: where each value ends in its fragment's bytes, raised by the total plus one for nulls."""
    size = F.coalesce(F.octet_length(column), F.lit(0)).cast("bigint")
    along = Window.partitionBy(FRAG).orderBy(OFF)
    end = F.sum(size).over(along.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(size).over(Window.partitionBy(FRAG))
    return df.select(FRAG, OFF, (end + F.when(F.col(column).isNull(), total + 1).otherwise(0)).alias("end"))


def fixed_lists_flatten(df: DataFrame, column: str) -> DataFrame:
    """``(__frag, __off, i, item)`` of every list's items."""
    return df.select(FRAG, OFF, F.posexplode(column).alias("i", "item"))


def fixed_lists_rebuild(items: DataFrame, n: int) -> DataFrame:
    """Lists of ``n`` items; items are ordered by their place, nulls stay."""
    lists = items.groupBy(FRAG, OFF).agg(F.array_sort(F.collect_list(F.struct("i", "item"))).alias("l"))
    return lists.select(FRAG, OFF, F.when(F.size("l") == n, F.transform("l", lambda x: x["item"])).otherwise(F.raise_error(F.lit("a list has another size"))).alias("items"))
