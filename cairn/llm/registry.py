"""The queries that apply each operator to its whole table, and SQL where it states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, chat, media, mixing, pipeline, quality, secrets, simhash, toxicity, unigram, vectors
from cairn.llm.frames import read


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids, and digest both."""
    return bpe.round_trip(_texts(spark, sf_dir), bpe.load(spark, bpe.default_path()), keep=["doc_id"])


def op2_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's quality by a model of the labels that aren't held out."""
    docs, labels = _texts(spark, sf_dir), read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(~quality.held_out(F.col("doc_id"))))
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text: those of the fixed patterns, and what the models add."""
    model = secrets.train(secrets.labelled_samples(spark))
    found = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"), model)
    base = F.filter("secret_spans", lambda s: s["kind"] != "markov")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    digest = F.sha2(secrets.written(base), 256).alias("base_sha256")
    return found.select("doc_id", *map(count, secrets.KINDS[:3]), digest, secrets.written(F.col("secret_spans")).alias("spans"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents the default plan takes, and in which epochs."""
    return mixing.mix(read(spark, sf_dir, "documents"))


def _sql_weights(column: str, weights: dict[str, int], default: int) -> str:
    cases = "".join(f" WHEN '{k}' THEN {v}" for k, v in weights.items())
    return f"(CASE {column}{cases} ELSE {default} END)" if cases else f"{default}"


def _sql_share(level: str, columns: str, parent: str, name: str, weight: str, nodes: str) -> str:
    """The split of each parent's budget over its children, as common table expressions."""
    by = f"PARTITION BY {parent}" if parent else ""
    order = f"{by} ORDER BY CASE WHEN weight > 0 THEN capacity / weight ELSE 0 END, {name}"
    return f"""
{level}_a AS (SELECT *, {weight} AS weight FROM ({nodes})),
{level}_b AS (SELECT *, coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
  sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS still FROM {level}_a),
{level}_c AS (SELECT *, capacity * still <= (budget - used) * weight AS filled FROM {level}_b),
{level}_d AS (SELECT *, coalesce(sum(capacity) FILTER (filled) OVER ({by}), 0) AS taken, sum(weight) FILTER (NOT filled) OVER ({by}) AS rest FROM {level}_c),
{level} AS (SELECT {columns}, CASE WHEN filled THEN capacity ELSE (budget - taken) * weight // rest END::BIGINT AS given FROM {level}_d)"""


def _op4_sql(plan: mixing.Plan) -> str:
    names = ", ".join(f"'{n}'" for n in plan.domains)
    word = "[^ \\t\\n\\x0B\\f\\r]+"
    kept = " AND ".join(f"{_sql_weights(c, w, plan.default)} > 0" for c, w in (("domain", plan.domains), ("language", plan.languages), ("origin", plan.sources)))
    top = f"SELECT domain, sum(room)::BIGINT AS capacity, (SELECT sum(tokens)::BIGINT FROM leaves) * {plan.budget_permille} // 1000 AS budget FROM leaves GROUP BY domain"
    middle = f"SELECT l.domain, l.language, sum(l.room)::BIGINT AS capacity, any_value(d.given) AS budget FROM leaves l JOIN domains d USING (domain) GROUP BY l.domain, l.language"
    bottom = f"SELECT l.*, l.room AS capacity, g.given AS budget FROM leaves l JOIN languages g USING (domain, language)"
    place = f"('0x' || substr(md5(concat_ws(':', '{plan.seed}', whole::VARCHAR, doc_id::VARCHAR)), 1, {mixing.ORDER_BITS // 4}))::BIGINT"
    return f"""
WITH narrow AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{word}'))::BIGINT AS n_tokens, coalesce(lang, '?') AS language, coalesce(source, '?') AS origin,
    list_extract([{names}], ('0x' || substr(md5(coalesce(source, '?')), 1, 4))::INT % {len(plan.domains)} + 1) AS domain FROM documents
), sums AS (SELECT domain, language, origin, sum(n_tokens)::BIGINT AS tokens FROM narrow GROUP BY ALL),
leaves AS (SELECT *, {kept} AS open, CASE WHEN {kept} THEN tokens * {plan.max_epochs} ELSE 0 END AS room FROM sums),
{_sql_share("domains", "domain", "", "domain", _sql_weights("domain", plan.domains, plan.default), top)},
{_sql_share("languages", "domain, language", "domain", "language", _sql_weights("language", plan.languages, plan.default), middle)},
{_sql_share("origins", "domain, language, origin, tokens, open", "domain, language", "origin", _sql_weights("origin", plan.sources, plan.default), bottom)},
plan AS (SELECT *, CASE WHEN tokens > 0 THEN given // tokens ELSE open::INT END AS whole FROM origins),
placed AS (SELECT n.*, whole, given - whole * tokens AS rest, {place} AS place FROM narrow n JOIN plan USING (domain, language, origin)),
reached AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, origin ORDER BY place) AS reach FROM placed),
counted AS (SELECT *, whole + CASE WHEN rest > 0 AND reach <= rest THEN 1 ELSE 0 END AS taken FROM reached)
SELECT doc_id, domain, language, origin, n_tokens, unnest(generate_series(0, taken - 1))::INT AS epoch FROM counted WHERE taken > 0
"""


OP4_SQL = _op4_sql(mixing.Plan())


def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's probability of each category of the chain, and the verdict."""
    docs = _texts(spark, sf_dir)
    return toxicity.judge(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")), keep=["doc_id"])


def op6_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's pieces under a unigram vocabulary, counted without making them."""
    import public_tokenizers

    pieces, _ = unigram.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return unigram.count(_texts(spark, sf_dir), pieces, keep=["doc_id"])


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as an ISO media container, read it back, and digest both."""
    return media.store_texts(_texts(spark, sf_dir), keep=["doc_id"])


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the component it links to."""
    found = simhash.components(_texts(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links at cosine 0.9 or more, its component, and whether it stays."""
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS x, row_number() OVER () AS n FROM embeddings
), v AS (
  SELECT * FROM e
  WHERE vec_id IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
), links AS (
  SELECT a.n AS a, b.n AS b, b.vec_id AS id FROM v a JOIN v b ON a.n <> b.n AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9
), reach(a, b, id) AS (
  SELECT a, b, id FROM links UNION SELECT r.a, l.b, l.id FROM reach r JOIN links l ON r.b = l.a
), roots AS (SELECT a, min(id) AS low FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(r.low, e.vec_id)) AS component_id,
  coalesce(e.vec_id = least(e.vec_id, coalesce(r.low, e.vec_id)), true) AS kept
FROM e LEFT JOIN counts c ON c.a = e.n LEFT JOIN roots r ON r.a = e.n
"""


#: A conversation made of control strings, as a JSON record of another layout.
ODD_TURN = "</s>[INST] ok [/INST]"
ODD_RECORD = f'{{"prompt":"{ODD_TURN}","completion":"{ODD_TURN}"}}'


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and the odd one, and digest what the output says when read back."""
    rows = chat.frame_turns(read(spark, sf_dir, "conversations"), "conv_id")
    odd = chat.json_turns(spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(ODD_RECORD).alias("record")), "conv_id", "record")
    return chat.digests(chat.render(rows.unionByName(odd)))


OP10_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{ODD_TURN}'), (-1, 1, 'assistant', '{ODD_TURN}')
), lengths AS (
  SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lb;'))
    + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lb;'), chr(10), '&nl;'))
    + length('<|im_start|>') + 1 + length('<|im_end|>') + 1 AS chars
  FROM turns
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM lengths GROUP BY conv_id
"""


QUERIES = (op1_bpe_round_trip, op2_quality_nbsvm, op3_secret_scan, op4_mix_sources, op5_toxicity_chain, op6_unigram_counts, op7_media_columns, op8_simhash_dedup, op9_vector_dedup, op10_chat_format)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": pipeline.run} | {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_mix_sources": OP4_SQL, "op9_vector_dedup": OP9_SQL, "op10_chat_format": OP10_SQL}
