"""The registered queries of the operators, one for each, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocelens.llm import byte_bpe, dart_minhash, embedding_dedup, id_shards, packing, periodic_runs, preferences, quality, sentencepieces, sharding, spelling, substring_dedup, token_counts
from ocelens.session import configure, materialise, shared_folder


_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    digested = encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        "ids",
    )
    decoded = byte_bpe.decode(digested, path, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.classes(table(spark, sf_dir, "documents"))


def op3_projection_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.links(table(spark, sf_dir, "embeddings"))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), cleaned=False)


def op5_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    cut = packing.cut(table(spark, sf_dir, "documents"), path, 2048, 1, keep_ids=False)
    return packing.pack(cut, 2048)


def op6_indexed_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    id_shards.write_store(docs, public_tokenizers.path("byte_bpe_50k.json"), store, 2)
    # every key of the table; a doc_id has as many copies as rows
    keys = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    keys = keys.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    fetched = id_shards.fetch(spark, store, materialise(id_shards.locate(spark, store, keys)))
    n_tokens = (F.length("ids") / 4).cast("long").alias("n_tokens")
    return fetched.select("doc_id", "start", n_tokens, F.crc32("ids").alias("ids_crc32"))


def op7_cached_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cache = f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"  # a new cache for each run
    counts = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), cache)
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op8_preference_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.preference_turns(*preferences.replaced_replies(table(spark, sf_dir, "conversations")))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(table(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_pivotal_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(table(spark, sf_dir, "documents"), "[a-z\u00c0-\u00ff]+", shortest=7, least=2, planted=31)
    return spelling.forms(words, times=10).select("word", "form", "root", "n", "n_near", "form_n")


def op12_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = sentencepieces.encode(table(spark, sf_dir, "documents"), path)
    digested = encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        "ids",
    )
    decoded = sentencepieces.decode(digested, path)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def _with_periods(docs: DataFrame) -> DataFrame:
    """One text in ten, by the CRC-32 of its doc_id, goes on in a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    listed = chosen.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(_WORD), 0)))
    begun = listed.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    placed = begun.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    periodic = F.expr("array_join(transform(sequence(0L, n - 1L), i -> w[int(if(i < a, i, a + (i - a) % p))]), ' ')")
    return placed.select("doc_id", F.when(F.col("n") > 0, periodic).otherwise(F.col("text")).alias("text"))


def op13_maximal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.runs(_with_periods(table(spark, sf_dir, "documents")))
    # by start, so of equal exponents the first stays
    greatest = "aggregate(runs, cast(null AS struct<start:bigint,length:bigint,period:bigint>), (a, r) -> if(a IS NULL OR r.length * a.period > a.length * r.period, r, a))"
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", F.expr(greatest)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_dart_minhash,
        op3_projection_collisions,
        op4_line_quality,
        op5_histogram_packing,
        op6_indexed_id_shards,
        op7_cached_token_counts,
        op8_preference_turns,
        op9_repeated_passages,
        op10_interleaved_shards,
        op11_pivotal_grams,
        op12_piece_agenda,
        op13_maximal_pairs,
    )
}

# Words of every text: runs without ASCII white space.
_WORDS = f"regexp_extract_all(coalesce(text, ''), '{_WORD}')"

# Smallest id that links reach, by repeated minima over a table links(a, b) in both directions.
_REACHED = """
reached(id, component) AS (
  SELECT id, id FROM ids
  UNION
  SELECT l.b, r.component FROM reached r JOIN links l ON l.a = r.id WHERE r.component < l.b
),
least AS (SELECT id, min(component) AS component_id FROM reached GROUP BY id)"""

# CRC-32 of UTF-8 texts: a table by bits, then byte by byte.
_CRC_TABLE = """
crc_bits(i, c, k) AS (
  SELECT i::UBIGINT, i::UBIGINT, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8
),
crc_table AS (SELECT list(c ORDER BY i) AS crcs FROM crc_bits WHERE k = 8)"""


def _crc(text: str) -> str:
    """Of a text, beside crc_table."""
    digits = f"hex(encode({text}))"
    values = f"list_transform(range(length({digits}) // 2), lambda k: ('0x' || substr({digits}, 2 * k + 1, 2))::UBIGINT)"
    step = "lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255)::BIGINT + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {values}), {step}), 4294967295)"


ORACLES: dict[str, str] = {
    "op2_dart_minhash": f"""
WITH RECURSIVE tokens AS (SELECT doc_id, {_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM tokens WHERE len(w) > 0),
weights AS (SELECT doc_id, md5(array_to_string(list_slice(w, i + 1, i + 5), ' ')) AS s, count(*) AS n FROM starts GROUP BY ALL),
sizes AS (SELECT doc_id, sum(n) AS total FROM weights GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS shared
  FROM weights x JOIN weights y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE shared * 5 >= 4 * (p.total + q.total - shared)),
ids AS (SELECT DISTINCT doc_id AS id FROM documents),{_REACHED}
SELECT d.doc_id, component_id, d.doc_id = component_id AS kept FROM documents d JOIN least ON id = d.doc_id""",
    "op3_projection_collisions": f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y
  ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.95),
ids AS (SELECT DISTINCT vec_id AS id FROM embeddings),{_REACHED}
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON id = e.vec_id""",
    "op8_preference_turns": """
WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT conv_id, turn, text, row_number() OVER (ORDER BY conv_id) AS i, count(*) OVER () AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS k FROM turns WHERE role = 'assistant') WHERE k = 1),
swap AS (SELECT l.conv_id, l.turn, l.text, o.text AS other FROM last l JOIN last o ON o.i = l.i % l.n + 1),
sides AS (
  SELECT t.conv_id, 'chosen' AS side, t.turn, t.role, t.text FROM turns t
  UNION SELECT t.conv_id, 'rejected', t.turn, t.role,
    CASE WHEN t.role = 'assistant' AND t.turn = s.turn AND t.text = s.text THEN s.other ELSE t.text END
  FROM turns t LEFT JOIN swap s ON s.conv_id = t.conv_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn, role, text) - 1 AS position FROM sides),
same AS (SELECT conv_id, position, count(*) = 2 AND min((role, text)) = max((role, text)) AS same FROM placed GROUP BY 1, 2),
prompts AS (SELECT conv_id, coalesce(min(position) FILTER (NOT same), max(position) + 1) AS prompt_turns FROM same GROUP BY 1)
SELECT conv_id AS pair_id, CASE WHEN position < prompt_turns THEN 'prompt' ELSE side END AS part, position, role, text,
  '<|' || role || '|>' || chr(10) || text || chr(10) AS rendered,
  position >= prompt_turns AND role = 'assistant' AS trained, prompt_turns
FROM placed JOIN prompts USING (conv_id) WHERE position >= prompt_turns OR side = 'chosen'""",
    "op9_repeated_passages": f"""
WITH tokens AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i + 1, i + 50), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 49, 0))) AS i FROM tokens)),
later AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS at FROM later, range(50) r(k)),
kept AS (SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.at) AS text
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS at FROM tokens) t
  ANTI JOIN gone g ON g.doc_id = t.doc_id AND g.at = t.at GROUP BY 1)
SELECT t.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM tokens t LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g ON g.doc_id = t.doc_id LEFT JOIN kept k ON k.doc_id = t.doc_id""",
    "op11_pivotal_grams": f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
kinds AS (SELECT doc_id::VARCHAR || ':' || run AS key, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, {_crc("key")} AS h FROM kinds, crc_table),
spelt AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
cuts AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS cut FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -n, w := near)) AS b FROM near GROUP BY 1),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 10 * w.n THEN b.w END AS form, CASE WHEN -b.m >= 10 * w.n THEN -b.m END AS form_n
  FROM words w LEFT JOIN best ON best.word = w.word),
walk AS (SELECT word, word AS root FROM words UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f
JOIN (SELECT w.word, w.root FROM walk w JOIN formed e ON e.word = w.root WHERE e.form IS NULL) r ON r.word = f.word""",
    "op13_maximal_pairs": f"""
WITH RECURSIVE {_CRC_TABLE},
given AS (SELECT doc_id, {_WORDS} AS w, {_crc("doc_id::VARCHAR")} AS h FROM documents, crc_table),
chosen AS (SELECT *, len(w) AS n, h // 10 AS g FROM given),
begun AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (g % n)::BIGINT END AS a FROM chosen),
placed AS (SELECT *, CASE WHEN a IS NOT NULL THEN 1 + (n - a) // (3 + g % 8)::BIGINT END AS p FROM begun),
tokens AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM placed),
grams AS (SELECT doc_id, n, i, md5(array_to_string(list_slice(w, i + 1, i + 5), ' ')) AS m FROM (SELECT *, unnest(range(greatest(n - 4, 0))) AS i FROM tokens)),
same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.m = y.m AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same) GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS place FROM runs),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.i) AS text
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM tokens) t ANTI JOIN gone g ON g.doc_id = t.doc_id AND g.i = t.i GROUP BY 1)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM tokens t LEFT JOIN told USING (doc_id) LEFT JOIN kept k ON k.doc_id = t.doc_id LEFT JOIN best b ON b.doc_id = t.doc_id AND b.place = 1""",
}
