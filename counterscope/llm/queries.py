"""The operators' registered queries, over whole tables, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterscope.llm.alignment import BytePairs, SentencePieces, link_counts
from counterscope.llm.chat import chat_digest, chat_examples
from counterscope.llm.exact_dup import exact_duplicates
from counterscope.llm.fill_middle import fill_middle, restored
from counterscope.llm.line_dedup import BLOCK, HIDDEN, HOST, drop_boilerplate
from counterscope.llm.lm_score import lm_scores
from counterscope.llm.mixing import mix
from counterscope.llm.near_dup import near_duplicates
from counterscope.llm.neighbours import nearest
from counterscope.llm.order_hash import as_text, edited_by_next
from counterscope.llm.packing import default_ranks, pack_documents
from counterscope.llm.quality import fold, quality
from counterscope.llm.toxicity import toxicity

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Sources in code point order, weighed 5, 2, 1 in turn. With the most a source can take (3 times its words) per
# weight in ascending order, the level is the first that no further source stays below.
_OP2 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS hash
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    3 * source_size AS most FROM totals
), ordered AS (
  SELECT *, row_number() OVER o AS step, sum(most) OVER o - most AS full_words, sum(weight) OVER () - (sum(weight) OVER o - weight) AS open_weight,
    sum(source_size) OVER () AS words
  FROM weighed WINDOW o AS (ORDER BY most / weight, place ROWS UNBOUNDED PRECEDING)
), level AS (
  SELECT arg_min((words - full_words)::DOUBLE / open_weight, step) AS level FROM ordered
  WHERE most > weight * ((words - full_words)::DOUBLE / open_weight)
), targets AS (
  SELECT source, source_size, least(most::DOUBLE, coalesce(weight * level, 0)) AS target,
    CASE WHEN source_size > 0 THEN floor(least(most::DOUBLE, coalesce(weight * level, 0)) / source_size)::BIGINT ELSE 0 END AS passes
  FROM weighed, level
), hashes AS (
  SELECT source, hash, sum(size) AS words FROM sized GROUP BY source, hash
), running AS (
  SELECT h.*, t.target - t.passes * t.source_size AS budget,
    sum(words) OVER (PARTITION BY h.source ORDER BY hash) AS upto
  FROM hashes h JOIN targets t ON h.source IS NOT DISTINCT FROM t.source
), extra AS (
  SELECT source, hash, upto <= budget OR (budget - (upto - words) > 0 AND 2 * (budget - (upto - words)) > words) AS again FROM running
)
SELECT s.doc_id, s.size, t.source_size, t.target,
  (s.size * least(3, t.passes + e.again::INT))::BIGINT AS taken
FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
JOIN extra e ON s.source IS NOT DISTINCT FROM e.source AND s.hash = e.hash
"""


@query(_OP2)
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_OP3 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sets AS (
  SELECT doc_id, coalesce(len(s), 0)::BIGINT AS n, s FROM shingles
), single AS (
  SELECT doc_id, n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM single a JOIN single b USING (shingle) WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS other FROM sets
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT s.doc_id, s.n AS n_shingles, min(r.other) AS component_id, s.doc_id = min(r.other) AS kept
FROM sets s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, s.n
"""


@query(_OP3)
def op3_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


_OP4 = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
WINDOW g AS (PARTITION BY text_sha256)
"""


@query(_OP4)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


# Each turn takes 12 + length(role) + 1 + length(text) + 11 characters as escaped; the examples of a conversation are its
# prefixes up to each assistant turn and to the last turn.
_OP7 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, v.turn, v.role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
), sized AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    count(*) OVER (PARTITION BY conv_id) AS n,
    24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n'))
      + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS chars
  FROM turns
), running AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR place = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM running GROUP BY conv_id
"""


@query(_OP7)
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "<|im_end|><|im_start|>assistant ok"
    own = spark.sql("SELECT -1L AS conv_id, t AS turn, IF(t = 0, 'user', 'assistant') AS role FROM (SELECT explode(array(0L, 1L)) AS t)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digest(chat_examples(rows.unionByName(own.withColumn("text", F.lit(control)))))


@query()
def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality(docs, table(spark, sf_dir, "labels"))
    good = (F.col("quality_score") >= 0.3).cast("int")
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), F.col("quality_score").alias("score"), good.alias("predicted"))


@query()
def op10_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, table(spark, sf_dir, "labels"))
    bad = (F.col("toxicity_score") >= 0.3).cast("int")
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), F.col("toxicity_score").alias("score"), bad.alias("predicted"))


@query()
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, k=5)


@query()
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = pack_documents(table(spark, sf_dir, "documents"), capacity=1024, ranks=default_ranks())
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


_OP8 = r"""
WITH words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents)
), singles AS (
  SELECT word, count(*) AS n, sum(count(*)) OVER () AS total FROM words GROUP BY word
), tokens AS (
  SELECT w.doc_id, w.place, w.word, s.total FROM words w JOIN singles s USING (word)
), steps AS (
  SELECT doc_id, place, word, total, lag(word) OVER d AS before, lag(place) OVER d IS NOT NULL AS inner_
  FROM tokens WINDOW d AS (PARTITION BY doc_id ORDER BY place)
), pairs AS (
  SELECT before, word, count(*) AS n FROM steps WHERE inner_ GROUP BY before, word
), scored AS (
  SELECT s.doc_id, s.inner_ AND p.n < 2 AS backoff,
    CASE WHEN NOT s.inner_ THEN log10(w.n / s.total) WHEN p.n >= 2 THEN log10(p.n / v.n) ELSE log10(0.4 * w.n / s.total) END AS score
  FROM steps s JOIN singles w ON s.word = w.word
  LEFT JOIN singles v ON s.inner_ AND s.before = v.word
  LEFT JOIN pairs p ON s.inner_ AND s.before = p.before AND s.word = p.word
)
SELECT d.doc_id, count(s.score) AS n_words, count(*) FILTER (s.backoff) AS n_backoff, round(avg(s.score), 6) AS log10_mean
FROM documents d LEFT JOIN scored s USING (doc_id) GROUP BY d.doc_id
"""


@query(_OP8)
def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_scores(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", "n_backoff", F.round("log10_mean", 6).alias("log10_mean"))


_OP9 = rf"""
WITH read AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{HIDDEN}', ' ', 'g'),
      '{BLOCK}', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)),
      lambda x: trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> '') AS lines
  FROM pages
), once AS (
  SELECT host, unnest(list_distinct(lines)) AS line FROM read WHERE host IS NOT NULL
), often AS (
  SELECT c.host, list(c.line) AS drops FROM (SELECT host, line, count(*) AS having_ FROM once GROUP BY host, line) c
  JOIN (SELECT host, count(*) AS pages FROM read GROUP BY host) t USING (host)
  WHERE c.having_ >= 2 AND c.having_ > 0.3::DOUBLE * t.pages GROUP BY c.host
)
SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped, array_to_string(kept, chr(10)) AS text
FROM (SELECT page_id, r.host, lines, CASE WHEN drops IS NULL THEN lines
  ELSE list_filter(lines, lambda x: NOT list_contains(drops, x)) END AS kept FROM read r LEFT JOIN often o ON r.host = o.host)
"""


@query(_OP9)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "pages"))


_OP11 = r"""
WITH dice AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), cuts AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90
      THEN 'plain' WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM dice
), parts AS (
  SELECT *, least(x, y) AS a, greatest(x, y) AS b FROM cuts
), cut AS (
  SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM parts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM cut
"""


@query(_OP11)
def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


@query()
def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = edited_by_next(table(spark, sf_dir, "documents"))
    return compared.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fingerprint")).alias("fingerprint"),
        as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query()
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    two = SentencePieces(public_tokenizers.path("piece_bpe_32k.model"))
    return link_counts(table(spark, sf_dir, "documents"), BytePairs(default_ranks()), two)
