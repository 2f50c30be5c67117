"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

The patterns find assignments to secret-like names, access key ids and hexadecimal runs. Beyond
those, every run of token characters, or what is left of it before, between and after them, is scored
by two character bigram models, one of random strings and one of ordinary identifiers, both trained from
labelled samples; one whose log-likelihood ratio per character reaches a threshold is a span of kind
``markov``. Rules, digits, formulas and other runs that neither model knows are left alone: a span has
`LEAST_DISTINCT` different characters, a stretch of `LEAST_STRETCH` letters and digits, and characters of two
classes at least.
All of it is built from SQL functions: a scan is one pass without any shuffle.

Defined results: a null text scans as the empty one and stays null when redacted; positions are
code points, ends exclusive; matches of a kind are leftmost and don't overlap, matches of different
kinds may; repeated rows give repeated results; texts are scanned whole; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.frames import fresh

#: The base patterns (fixed values), and the least length of the group that decides; failing matches are dropped.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # of 18 or more: a shorter run has no longer match within it
HEX = r"[0-9a-f]{16,}"  # likewise
LEAST_VALUE = 12
KINDS = ("assign", "access", "hex", "markov")
#: Runs of token characters that the models score, and what ends up as one symbol each.
RUN_CHARS, LEAST_RUN = "A-Za-z0-9+/_=-", 20
LEAST_DISTINCT, LEAST_STRETCH = 8, 10
ALPHABET = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "+/_.=-"
#: Least log-likelihood ratio per character, in nats.
THRESHOLD = 0.6
SPAN = "struct<kind:string,start:bigint,end:bigint>"
PLACEHOLDER = "[SECRET]"

#: Words that ordinary identifiers are made of.
WORDS = """account action address after allow amount array author background balance base batch before bench binary block body
branch bucket buffer button cache calendar call callback category change channel check city class client cluster code
collection color column comment common complete config connection content context controller country create current
customer data database date default delete delivery description detail device dialog directory display document domain
download driver editor element email engine entry environment error event example export factory feature field file
filter folder format function gateway group handler header height history image import index information input
instance interface internal item language layer layout length library license limit line list listener location
manager message method model module monitor name network node notification number object option order output package
page parameter parent password payment person picture player policy position price process product profile project
property provider query queue random range reader record region register release remote report request resource
response result return role route schedule schema scope search section security select server service session
setting shipping signature simple source standard start state statistics status storage stream string structure
style summary support system table target task template terminal text theme thread ticket time title token tool
transaction transfer tree type unique update upload user validation value variable vector version video view warning
widget width window worker writer
gemeinschaft geschwindigkeit verantwortung wirtschaftlich entscheidung berechtigung zusammenarbeit einrichtung
versicherung wissenschaft schreibtisch zeitschrift krankenhaus entwicklung freundlichkeit lichtgeschwindigkeit
gouvernement environnement appartement malheureusement connaissance enseignement bibliotheque
aujourd mouvement naturellement beaucoup longtemps quelquefois maintenant generalement peut etre
desarrollo informacion responsabilidad aproximadamente universidad conocimiento generalmente comunicacion
posibilidad seguridad empresarial rapidamente organizacion entonces siempre nuestra""".split()


def labelled_samples(spark: SparkSession, n: int = 6000) -> DataFrame:
    """``(label, text)``: ``n`` random strings (1) in four alphabets and ``n`` identifiers (0) in five styles."""
    digest = lambda salt: F.unhex(F.sha2(F.concat_ws(":", F.lit(salt), F.col("id")), 256))
    pick = lambda salt, of: F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.lit(of)).cast("int")
    kind, coded = pick("kind", 4), F.base64(F.concat(digest("a"), digest("b")))
    random = (
        F.when(kind == 0, F.lower(F.hex(digest("a"))))
        .when(kind == 1, coded)
        .when(kind == 2, F.upper(F.regexp_replace(coded, "[^A-Za-z0-9]", "")))
        .otherwise(F.translate(coded, "+/", "-_"))
    )
    words = F.array(*map(F.lit, WORDS))
    word = lambda i: F.element_at(words, pick(f"word{i}", len(WORDS)) + 1)
    chosen = F.slice(F.array(*[word(i) for i in range(5)]), F.lit(1), 2 + pick("count", 4))
    style = pick("style", 6)
    named = (
        F.when(style == 0, F.array_join(chosen, "_"))
        .when(style == 1, F.array_join(F.transform(chosen, F.initcap), ""))
        .when(style == 2, F.array_join(chosen, "-"))
        .when(style == 3, F.concat(F.array_join(chosen, "/"), F.lit("."), word(6)))
        .when(style == 4, F.concat(F.upper(F.array_join(chosen, "_")), F.lit("="), pick("number", 100_000).cast("string")))
        .otherwise(F.array_join(chosen, ""))
    )
    ids = spark.range(0, n, 1, 2)
    return ids.select(F.lit(1).alias("label"), random.alias("text")).unionByName(ids.select(F.lit(0).alias("label"), named.alias("text")))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of each bigram, row by row over `ALPHABET`, from ``(label, text)`` samples.

    Counts are summed on the executors; at most two tables of the alphabet's pairs reach the driver.
    Null texts, labels other than 0 and 1, and characters outside the alphabet are left out.
    """
    chars = F.split(F.coalesce("text", F.lit("")), "")
    pairs = samples.filter("label in (0, 1)").select("label", chars.alias("c")).filter(F.size("c") > 1)
    pairs = pairs.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.element_at("c", i).alias("a"), F.element_at("c", i + 1).alias("b")))).alias("p"))
    counted = pairs.filter(F.col("p.a").rlike(f"^[{_class(ALPHABET)}]$") & F.col("p.b").rlike(f"^[{_class(ALPHABET)}]$")).groupBy("label", "p.a", "p.b").count().collect()
    size, at = len(ALPHABET), {c: i for i, c in enumerate(ALPHABET)}
    tables = [[[1.0] * size for _ in ALPHABET] for _ in range(2)]  # add one
    for r in counted:
        tables[r["label"]][at[r["a"]]][at[r["b"]]] += r["count"]
    sums = [[sum(row) for row in t] for t in tables]
    return [round(math.log(tables[1][a][b] / sums[1][a]) - math.log(tables[0][a][b] / sums[0][a]), 3) for a in range(size) for b in range(size)]


def _class(chars: str) -> str:
    return "".join("\\" + c if c in "-]\\^[" else c for c in chars)


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: SQL lambdas would work it out again for every item."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, block: int = 256, largest: bool = False) -> Column:
    """Sums (or maxima) of an array's values before each place, in blocks: no step copies more than a block or a row of blocks."""
    add = (lambda a, b: F.greatest(a, b)) if largest else (lambda a, b: a + b)
    zero, empty = F.lit(0).cast("bigint"), F.array().cast("array<bigint>")

    def within(xs: Column) -> Column:
        step = lambda acc, x: F.struct(F.array_append(acc["out"], acc["now"]).alias("out"), add(acc["now"], x).alias("now"))
        return F.aggregate(xs, F.struct(empty.alias("out"), zero.alias("now")), step, lambda acc: acc["out"])

    def joined(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v), F.lit(block))
        blocks = F.transform(starts, lambda at: F.slice(v, at, F.lit(block)))
        return let(blocks, lambda bs: let(within(F.transform(bs, lambda xs: F.aggregate(xs, zero, add))), lambda before: F.flatten(
            F.zip_with(bs, before, lambda xs, start: F.transform(within(xs), lambda x: add(x, start))))))

    return let(values, lambda v: F.when(F.size(v) > 0, joined(v)).otherwise(empty))


def _located(text: Column, pattern: str, found: Column) -> Column:
    """``array<struct<start,end,match>>`` of all matches, from the pieces between them."""
    pieces = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda p: F.length(p).cast("bigint"))

    def placed(ps: Column) -> Column:
        starts = F.zip_with(running(F.zip_with(ps, found, lambda p, m: p + F.length(m))), ps, lambda a, p: a + p)
        return F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("match")))

    return let(pieces, placed)


def _ratio(run: Column, table: Column) -> Column:
    """Log-likelihood ratio per character."""
    size = len(ALPHABET)
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("last"))
    step = lambda acc, c: F.struct((acc["sum"] + F.when(acc["last"] > 0, F.element_at(table, (acc["last"] - 1) * size + c)).otherwise(0.0)).alias("sum"), c.alias("last"))
    return F.aggregate(codes, start, step, lambda acc: acc["sum"]) / (F.length(run) - 1)


def _scored(run: Column) -> Column:
    """Whether the models are asked: a run of token characters with the variety that a secret has."""
    classes = sum(run.rlike(c).cast("int") for c in ("[a-z]", "[A-Z]", "[0-9]"))
    return run.rlike(f"^[{RUN_CHARS}]{{{LEAST_RUN},}}$") & run.rlike(f"[A-Za-z0-9]{{{LEAST_STRETCH},}}") & (classes > 1) & (F.size(F.array_distinct(F.split(run, ""))) >= LEAST_DISTINCT)


def _between(m: Column, pattern: str) -> Column:
    """What a located match holds before, between and after the pattern's own matches in it."""
    found, pieces = F.regexp_extract_all(m["match"], F.lit(pattern), 0), F.split(m["match"], pattern, -1)

    def placed(ps: Column) -> Column:
        sizes = F.zip_with(ps, found, lambda p, f: (F.length(p) + F.coalesce(F.length(f), F.lit(0))).cast("bigint"))
        start = lambda at: m["start"] + at
        return F.zip_with(running(sizes), ps, lambda at, p: F.struct(start(at).alias("start"), (start(at) + F.length(p)).alias("end"), p.alias("match")))

    return let(pieces, placed)


def scan(df: DataFrame, model: list[float], text_col: str = "text", out_col: str = "secret_spans", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``array<struct<kind,start,end>>``, sorted by start and then by kind as listed."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # An assignment uses up its text, so that a run is what lies outside of it.
    runs = f"{ASSIGN}|[{RUN_CHARS}]{{{LEAST_RUN},}}"
    finds = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "run": runs}
    columns = dict(zip(finds, fresh(df, *(f"__{k}" for k in finds)), strict=True))
    out = df.withColumns({columns[k]: F.regexp_extract_all(text, F.lit(p), 0) for k, p in finds.items()})
    table = F.lit(model)
    none = F.array().cast("array<struct<rank:int,start:bigint,end:bigint>>")

    def spans(rank: int, kind: str, keep, parts=None) -> Column:
        found = F.col(columns[kind])
        located = _located(text, finds[kind], found)
        hits = F.filter(located if parts is None else F.flatten(F.transform(located, parts)), keep)
        return F.when(F.size(found) > 0, F.transform(hits, lambda m: F.struct(F.lit(rank).alias("rank"), m["start"].alias("start"), m["end"].alias("end")))).otherwise(none)

    value = lambda m: F.regexp_extract(m["match"], ASSIGN, 2)
    base = f"{ACCESS}|{HEX}|{ASSIGN}"
    all_spans = F.concat(
        spans(0, "assign", lambda m: F.length(value(m)) >= LEAST_VALUE),
        spans(1, "access", lambda m: F.lit(True)),
        spans(2, "hex", lambda m: F.lit(True)),
        spans(3, "run", lambda m: F.when(~_scored(m["match"]), F.lit(False)).otherwise(_ratio(m["match"], table) >= threshold), lambda m: F.when(m["match"].rlike(base), _between(m, base)).otherwise(F.array(m))),
    )
    ordered = F.array_sort(F.transform(all_spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))
    names = F.array(*map(F.lit, KINDS))
    made = F.transform(ordered, lambda s: F.struct(F.element_at(names, s["rank"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return out.withColumn(out_col, made).drop(*columns.values())


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every stretch that spans cover replaced by one placeholder."""

    def cut(ends: Column) -> Column:
        reach = running(ends, largest=True)  # where earlier spans end
        gaps = F.zip_with(reach, spans, lambda r, s: F.when(s["start"] >= r, F.concat(F.substr(text, (r + 1).cast("int"), (s["start"] - r).cast("int")), F.lit(PLACEHOLDER))).otherwise(F.lit("")))
        return F.concat(F.array_join(gaps, ""), F.substr(text, (F.array_max(ends) + 1).cast("int")))

    return F.when(F.size(spans) > 0, let(F.transform(spans, lambda s: s["end"]), cut)).otherwise(text)
