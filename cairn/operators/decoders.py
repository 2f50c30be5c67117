"""Values back from pages: offsets, blobs, constants, packed chunks, permutations, symbol tables and nested levels.

A page is the part of a column in one fragment. Where a page's bytes or items are one value, its rows are worked out
from one row a page, so a page is never copied for each of its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.encodings import bit_width
from cairn.operators.positional import FRAG, OFF

#: Values of a chunk, and the order of a chunk's blocks of eight rows in the transposed layout (fixed values).
CHUNK, BLOCK_ORDER = 1024, (0, 4, 2, 6, 1, 5, 3, 7)
#: The code before a byte that no symbol covers (a fixed value).
ESCAPE = 255


def _page_rows(rows: DataFrame, columns: Sequence[str], pages: DataFrame, value) -> DataFrame:
    """``(__frag, __off, value)``: ``value(ends, i, row, page)`` of each row, all rows of a page from one row.

    The page is a lambda's argument, as a column of bytes is copied each time that it is named.
    """
    held = rows.groupBy(FRAG).agg(F.array_sort(F.collect_list(F.struct(OFF, *columns))).alias("rows"))
    each = lambda page: F.transform("rows", lambda r, i: F.struct(r[OFF].alias(OFF), value(F.col("rows"), i, r, page).alias("value")))
    made = F.flatten(F.transform(F.array("page"), each))
    return held.join(pages, FRAG).select(FRAG, F.explode(made).alias("r")).select(FRAG, f"r.{OFF}", "r.value")


def byte_pages(df: DataFrame, column: str) -> DataFrame:
    """``(__frag, page)``: each fragment's values end to end, nulls as nothing."""
    value = F.coalesce(F.col(column).cast("binary"), F.lit(b""))
    held = df.groupBy(FRAG).agg(F.array_sort(F.collect_list(F.struct(OFF, value.alias("v")))).alias("l"))
    return held.select(FRAG, F.unhex(F.array_join(F.transform("l", lambda x: F.hex(x["v"])), "")).alias("page"))


def item_pages(df: DataFrame, column: str) -> DataFrame:
    """``(__frag, page)``: the items of each fragment's lists, end to end."""
    held = df.groupBy(FRAG).agg(F.array_sort(F.collect_list(F.struct(OFF, F.col(column).alias("v")))).alias("l"))
    return held.select(FRAG, F.flatten(F.filter(F.transform("l", lambda x: x["v"]), lambda v: v.isNotNull())).alias("page"))


def list_ends(df: DataFrame, column: str) -> DataFrame:
    """``(__frag, __off, end)``: where each list's items end, raised by the total plus one for null lists."""
    size = F.when(F.col(column).isNull(), 0).otherwise(F.size(column)).cast("bigint")
    along = Window.partitionBy(FRAG).orderBy(OFF)
    end = F.sum(size).over(along.rowsBetween(Window.unboundedPreceding, 0))
    return df.select(FRAG, OFF, (end + F.when(F.col(column).isNull(), F.sum(size).over(Window.partitionBy(FRAG)) + 1).otherwise(0)).alias("end"))


def _cut(total, part):
    """A row's share of its page between the end before it and its own; null where the end is beyond the total."""

    def value(rows: Column, i: Column, row: Column, page: Column) -> Column:
        plain = lambda end: F.when(end > total(page), end - total(page) - 1).otherwise(end)
        start = F.when(i == 0, F.lit(0).cast("bigint")).otherwise(plain(F.get(rows, i - 1)["end"]))
        return F.when(row["end"] <= total(page), part(page, start, plain(row["end"]) - start))

    return value


def offsets_decode(ends: DataFrame, pages: DataFrame) -> DataFrame:
    """``(__frag, __off, value)``: strings of bytes from their ends."""
    part = lambda page, start, n: F.substring(page, (start + 1).cast("int"), n.cast("int"))
    return _page_rows(ends, ["end"], pages, _cut(lambda page: F.octet_length(page).cast("bigint"), part))


def lists_decode(ends: DataFrame, pages: DataFrame) -> DataFrame:
    """``(__frag, __off, value)``: lists from their ends."""
    part = lambda page, start, n: F.slice(page, (start + 1).cast("int"), n.cast("int"))
    return _page_rows(ends, ["end"], pages, _cut(lambda page: F.size(page).cast("bigint"), part))


def blob_fetch(descriptors: DataFrame, pages: DataFrame) -> DataFrame:
    """``(__frag, __off, value)`` of ``(position, size)``: size 0 at position 0 is empty, elsewhere null."""

    def value(rows: Column, i: Column, row: Column, page: Column) -> Column:
        there = F.substring(page, (row["position"] + 1).cast("int"), row["size"].cast("int"))
        return F.when(row["size"] > 0, there).when(row["position"] == 0, F.lit(b""))

    return _page_rows(descriptors, ["position", "size"], pages, value)


def constants_expand(constants: DataFrame, sizes: DataFrame, validity: DataFrame | None = None) -> DataFrame:
    """``(__frag, __off, value)``: a page's one value (null if it has none) for each of its ``rows``, where ``validity``
    ``(__frag, __off, valid)``, if given, says that there is one."""
    rows = constants.join(sizes.filter("rows > 0"), FRAG).select(FRAG, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1)).alias(OFF), "value")
    if validity is None:
        return rows
    return rows.join(validity, [FRAG, OFF]).select(FRAG, OFF, F.when(F.col("valid"), F.col("value")).alias("value"))


def _words(values: Column, width: Column) -> Column:
    """``values`` of ``width`` bits each, lowest bits first, as 32-bit words: a word takes from the values that reach into it."""

    def word(w: Column) -> Column:
        first = F.floor(w * 32 / width)
        last = F.least(F.floor((w * 32 + 31) / width), F.size(values) - 1)

        def share(acc: Column, i: Column) -> Column:
            shift = (i * width - w * 32).cast("int")
            v = F.get(values, i.cast("int"))
            bits = F.when(shift >= 0, F.call_function("shiftleft", v, F.greatest(shift, F.lit(0)))).otherwise(F.call_function("shiftright", v, F.greatest(-shift, F.lit(0))))
            return acc.bitwiseOR(bits.bitwiseAND(F.lit(0xFFFFFFFF)))

        return F.aggregate(F.sequence(first.cast("bigint"), last.cast("bigint")), F.lit(0).cast("bigint"), share)

    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.size(values) * width / 32) - 1), word)


def _chunks(df: DataFrame, column: str) -> DataFrame:
    at = F.expr(f"{OFF} div {CHUNK}")
    held = df.groupBy(FRAG, at.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct(OFF, F.col(column).cast("bigint").alias("v")))).alias("l"))
    return held.select(FRAG, "chunk", F.transform("l", lambda x: x["v"]).alias("values"))


def inline_pack(df: DataFrame, column: str) -> DataFrame:
    """``(__frag, chunk, width, n, words)``: each chunk in as many bits as its largest value needs."""
    sized = _chunks(df, column).withColumn("width", bit_width(F.array_max("values")))
    return sized.select(FRAG, "chunk", "width", F.size("values").alias("n"), _words(F.col("values"), F.col("width")).alias("words"))


def inline_unpack(chunks: DataFrame) -> DataFrame:
    """``(__frag, __off, value)`` from `inline_pack`'s chunks."""

    def value(i: Column) -> Column:
        bit = i * F.col("width")
        at, shift = F.floor(bit / 32).cast("int"), (bit % 32).cast("int")
        low = F.call_function("shiftrightunsigned", F.get("words", at), shift)
        high = F.when(shift + F.col("width") > 32, F.call_function("shiftleft", F.coalesce(F.get("words", at + 1), F.lit(0).cast("bigint")), 32 - shift)).otherwise(0)
        mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("width")) - 1
        return F.struct((F.col("chunk") * CHUNK + i).alias(OFF), low.bitwiseOR(high).bitwiseAND(mask).alias("value"))

    return chunks.select(FRAG, F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint") - 1), value)).alias("r")).select(FRAG, "r.*")


def tail_pack(df: DataFrame, column: str, width: int) -> DataFrame:
    """``(__frag, chunk, width, n, words, raw)``: whole chunks in ``width`` bits, a page's last part of one as it is."""
    whole, value = F.size("values") == CHUNK, F.col("values")
    return _chunks(df, column).select(FRAG, "chunk", F.lit(width).alias("width"), F.size("values").alias("n"), F.when(whole, _words(value, F.lit(width))).alias("words"), F.when(~whole, value).alias("raw"))


def tail_unpack(chunks: DataFrame) -> DataFrame:
    """``(__frag, __off, value)`` from `tail_pack`'s chunks."""
    raw = chunks.filter("raw IS NOT NULL").select(FRAG, "chunk", F.posexplode("raw").alias("i", "value"))
    return inline_unpack(chunks.filter("words IS NOT NULL")).unionByName(raw.select(FRAG, (F.col("chunk") * CHUNK + F.col("i")).alias(OFF), "value"))


def transposed(at: Column, bits: int) -> Column:
    """Where the value stands in its chunk that is at place ``at`` of the transposed layout for words of ``bits`` bits:
    place ``row * lanes + lane`` holds ``BLOCK_ORDER[row div 8] * 16 + (row % 8) * 128 + lane``."""
    lanes = CHUNK // bits
    row, lane = F.floor(at / lanes), at % lanes
    block = F.get(F.array(*map(F.lit, BLOCK_ORDER)), F.floor(row / 8).cast("int"))
    return (block * 16 + row % 8 * 128 + lane).cast("bigint")


def transpose(df: DataFrame, bits: int) -> DataFrame:
    """``(__frag, __off, value)``: whole chunks' values from the transposed layout back in order; a last part stays."""
    inside, whole = F.col(OFF) % CHUNK, Window.partitionBy(FRAG, F.expr(f"{OFF} div {CHUNK}"))
    moved = F.col(OFF) - inside + transposed(inside, bits)
    return df.select(FRAG, F.when(F.count(F.lit(1)).over(whole) == CHUNK, moved).otherwise(F.col(OFF)).alias(OFF), "value")


def symbols_encode(value: Column, symbols: Sequence[str]) -> Column:
    """Codes of an ASCII string: the longest symbol at each place, or `ESCAPE` and the byte."""
    order = sorted(symbols, key=len, reverse=True)
    quoted = "|".join(["".join(f"\\x{ord(c):02x}" for c in s) for s in order] + [r"[\x00-\x7f]"])
    codes = F.create_map(*[F.lit(x) for s in order for x in (s, f"{symbols.index(s):02X}")]) if order else F.create_map().cast("map<string,string>")
    pieces = F.regexp_extract_all(value, F.lit(quoted), 0)
    return F.unhex(F.array_join(F.transform(pieces, lambda p: F.coalesce(codes[p], F.concat(F.lit(f"{ESCAPE:02X}"), F.hex(p)))), ""))


def symbols_decode(codes: Column, symbols: Sequence[str]) -> Column:
    """The bytes that codes stand for: a code is its symbol, and the one after `ESCAPE` is itself."""
    table = F.array(*[F.lit(s.encode().hex().upper()) for s in symbols]) if symbols else F.array().cast("array<string>")
    text = F.hex(codes)
    each = F.transform(F.sequence(F.lit(1), F.length(text), F.lit(2)), lambda i: F.substr(text, i, F.lit(2)))

    def step(acc: Column, code: Column) -> Column:
        made = F.when(acc["raw"], code).when(code == f"{ESCAPE:02X}", "").otherwise(F.get(table, F.conv(code, 16, 10).cast("int")))
        return F.struct(F.array_append(acc["out"], made).alias("out"), (~acc["raw"] & (code == f"{ESCAPE:02X}")).alias("raw"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("raw"))
    return F.when(F.length(text) > 0, F.unhex(F.array_join(F.aggregate(each, start, step)["out"], ""))).otherwise(codes)


# lists in lists


def nested_shred(df: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """``(*key, i, j, rep, def, value)`` of a column of lists of lists. Repetition 2 begins an outer list, 1 an inner one,
    0 goes on. Definition 0 is a value; from inside out, 1 is a null item, 2 a null and 3 an empty inner list, 4 a null and 5
    an empty outer list."""
    outer = df.select(*key, F.col(column).isNull().alias("none"), F.posexplode_outer(column).alias("i", "inner"))
    both = outer.select(*key, "none", "i", F.col("inner").isNull().alias("no_inner"), F.posexplode_outer("inner").alias("j", "value"))
    level = F.when(F.col("none"), 4).when(F.col("i").isNull(), 5).when(F.col("no_inner"), 2).when(F.col("j").isNull(), 3).when(F.col("value").isNull(), 1).otherwise(0)
    i, j = F.coalesce("i", F.lit(0)), F.coalesce("j", F.lit(0))
    return both.select(*key, i.alias("i"), j.alias("j"), F.when((i == 0) & (j == 0), 2).when(j == 0, 1).otherwise(0).alias("rep"), level.alias("def"), "value")


def nested_assemble(levels: DataFrame, key: Sequence[str], order: Sequence[str] = ("i", "j")) -> DataFrame:
    """``(*key, items)`` from levels in order alone: places follow from the repetitions."""
    along = Window.partitionBy(*key).orderBy(*order)
    numbered = levels.withColumn("__list", F.sum((F.col("rep") > 0).cast("int")).over(along)).withColumn("__at", F.row_number().over(along))
    inner = numbered.groupBy(*key, "__list").agg(F.array_sort(F.collect_list(F.struct("__at", "value"))).alias("l"), F.max("def").alias("def"))
    values = F.transform("l", lambda x: x["value"])
    made = F.when(F.col("def") == 2, F.lit(None)).when(F.col("def") == 3, F.slice(values, 1, 0)).otherwise(values)
    lists = inner.select(*key, "__list", made.alias("inner"), "def").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("__list", "inner"))).alias("l"), F.max("def").alias("def"))
    items = F.transform("l", lambda x: x["inner"])
    return lists.select(*key, F.when(F.col("def") == 4, F.lit(None)).when(F.col("def") == 5, F.slice(items, 1, 0)).otherwise(items).alias("items"))


def constant_levels(sizes: DataFrame, rep: int, definition: int) -> DataFrame:
    """``(__frag, __off, rep, def, value)`` of pages that are one repetition and definition throughout, without values."""
    rows = sizes.filter("rows > 0").select(FRAG, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1)).alias(OFF))
    return rows.select(FRAG, OFF, F.lit(rep).alias("rep"), F.lit(definition).alias("def"), F.lit(None).cast("bigint").alias("value"))


def composite(pages: Sequence[DataFrame], key: str) -> DataFrame:
    """Levels of one column in several pages, each with keys from 0, as one: keys go on where the page before ends."""
    tagged = [p.withColumn("__page", F.lit(i)) for i, p in enumerate(pages)]
    rows = tagged[0]
    for p in tagged[1:]:
        rows = rows.unionByName(p)
    # a row a page
    sizes = rows.groupBy("__page").agg((F.max(key) + 1).alias("__n"))
    starts = sizes.select("__page", F.coalesce(F.sum("__n").over(Window.orderBy("__page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    return rows.join(F.broadcast(starts), "__page").withColumn(key, F.col(key) + F.col("__start")).drop("__page", "__start")
