"""The registered queries of the training-data operators, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import byte_bpe, chat_tree, class_lm, exact_topk, importance, json_schema, line_dedup, mixing, multi_index, nb_svm, quality_rules, simhash, token_counts
from gridloom.session import scratch_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def token_file(name: str) -> str:
    """Where the public tokenizer files lie on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def quality_model(docs: DataFrame, labels: DataFrame) -> nb_svm.Model:
    """A model that never sees the held-out quarter of the labels."""
    return nb_svm.fit(docs, labels.where(~held_out_quarter()))


def held_out_quarter() -> Column:
    """Whether an id's labels are held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


#: Score from which a document counts as good.
GOOD = 0.7


@_query
def op1_nb_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = nb_svm.score(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out_quarter().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


@_query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is empty at first in each call. English texts fill it, as an earlier run would; then all rows are counted: these hit, the others miss and are appended."""
    with open(token_file("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    docs, cache = table(spark, sf_dir, "documents"), scratch_path(spark, "token-counts")
    token_counts.fill_cache(docs.where("lang = 'en'"), model, cache)
    counts = token_counts.token_counts(docs, model, cache)
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


@_query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL["op3_line_dedup"] = """
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM split
), common AS (
  SELECT k, max(doc_id) AS stays FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, coalesce(keyed.doc_id <> common.stays, false) AS gone FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


#: What the conversation with id -1 says twice.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


@_query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    out = chat_tree.format_trees(chat_tree.chain(rows.union(own)), tree_col="conv_id")
    turns = F.transform(chat_tree.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(chat_tree.read_loss(F.col("formatted"), F.col("loss_spans")), "")
    return out.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL["op4_chat_format"] = r"""
WITH own AS (
  SELECT * FROM (VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')) t(conv_id, turn, role, text)
), all_rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM own
), sized AS (
  SELECT *, 12 + length(replace(replace(role, '%', '%25'), chr(10), '%0A')) + 1 + length(text) + 11
    + (length(text) - length(regexp_replace(text, '<(\\*)\|', '<\1', 'g'))) + (length(role) - length(regexp_replace(role, '<(\\*)\|', '<\1', 'g'))) AS chars
  FROM all_rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@_query
def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of another length than the commonest (ties: the longer) take no part: inner products need one length."""
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@_query
def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of another length than the commonest (ties: the longer) take no part: inner products need one length."""
    return exact_topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


ORACLE_SQL["op6_exact_topk"] = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), numbered AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM numbered WHERE rank <= 5
"""


@_query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), max_passes=1.5, keep_text=False)
    return mixed.select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_weight").alias("weight"), F.col("mix_exponent").alias("exponent"), F.col("mix_pass").alias("pass"), F.col("mix_block").alias("block"), F.col("mix_order").alias("block_order"))


@_query
def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = class_lm.held_out("doc_id")
    scored = class_lm.fit_and_score(docs, ~out)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.read_ranks(token_file("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded_col="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: CRC-32 in SQL: the table of its 256 byte steps by their rule, and the checksum of a text's bytes.
CRC_SQL = """crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
)"""


def crc_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes; ``t`` is the table of CRC_SQL."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])))"


@_query
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trusted target is made of all documents labelled as good, but for the held-out quarter of the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    counts = quality_rules.bucket_counts(docs, labels.where((F.col("quality") == 1) & ~held_out_quarter()))
    judged = quality_rules.judge(docs, quality_rules.gains(counts))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("ratio", 6).alias("ratio"))


ORACLE_SQL["op13_quality_rules"] = rf"""
WITH {CRC_SQL}, docs AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
  SELECT k, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS a FROM docs
), hashed AS (
  SELECT a, {crc_sql('a')} AS c FROM (SELECT DISTINCT a FROM places), crc_table
), sums AS (
  SELECT k, c, lead(c) OVER (PARTITION BY k ORDER BY i) AS d FROM places JOIN hashed USING (a)
), placed AS (
  SELECT k, bucket, count(*) AS n FROM (SELECT k, c % {quality_rules.BUCKETS} AS bucket FROM sums UNION ALL SELECT k, (1000003 * c + d) % {quality_rules.BUCKETS} FROM sums WHERE d IS NOT NULL) GROUP BY k, bucket
), good AS (
  SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND (SELECT {crc_sql('doc_id::VARCHAR')} FROM crc_table) % 4 <> 2
), counts AS (
  SELECT bucket, sum(n) AS raw, coalesce(sum(n) FILTER (WHERE doc_id IN (SELECT doc_id FROM good)), 0) AS trusted FROM placed JOIN docs USING (k) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000000 * ln((trusted + 10e0 * s) / ((raw + 10e0) * s))) AS gain FROM counts, (SELECT sum(trusted)::DOUBLE / sum(raw)::DOUBLE AS s FROM counts)
), ratios AS (
  SELECT k, sum(n * gain) / sum(n) / 1000000 AS ratio FROM placed JOIN gains USING (bucket) GROUP BY k
), windows AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM (SELECT k, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM places WINDOW o AS (PARTITION BY k ORDER BY i)) WHERE c IS NOT NULL
), repeated AS (
  SELECT k, count(DISTINCT i + d) AS n FROM windows, range(3) r(d) WHERE n >= 2 GROUP BY k
), lines AS (
  SELECT k, count(*) - count(DISTINCT line) AS n FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k
), base AS (
  SELECT docs.k, doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words FROM docs LEFT JOIN lines USING (k) LEFT JOIN repeated USING (k)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(ratio, 0) >= {quality_rules.LEAST_RATIO} AS kept, round(coalesce(ratio, 0), 6) AS ratio
FROM base LEFT JOIN ratios USING (k)
"""


@_query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op11_importance_resampling"] = rf"""
WITH {CRC_SQL}, texts AS (
  SELECT row_number() OVER () AS k, doc_id, false AS target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{importance.WORD}') AS w FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, true, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{importance.WORD}') FROM benchmark
), grams AS (
  SELECT k, target, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM texts
), hashed AS (
  SELECT g, {crc_sql('g')} % 10000 AS bucket FROM (SELECT DISTINCT g FROM grams), crc_table
), placed AS (
  SELECT k, target, bucket, count(*) AS n FROM grams JOIN hashed USING (g) GROUP BY ALL
), counts AS (
  SELECT b AS bucket, coalesce(sum(n) FILTER (WHERE NOT target), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE target), 0)::DOUBLE AS t FROM range(10000) r(b) LEFT JOIN placed ON bucket = b GROUP BY b
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (raw + 10000) / ((s + 1) * (wanted + 10000))))::BIGINT AS gain FROM counts, (SELECT sum(s) AS raw, sum(t) AS wanted FROM counts)
), summed AS (
  SELECT k, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS gain FROM placed JOIN gains USING (bucket) WHERE NOT target GROUP BY k
), weighed AS (
  SELECT doc_id, len(w) >= 20 AS long_enough, coalesce(n, 0) AS n_features, coalesce((gain - ((gain % n) + n) % n) // n, 0) AS weight, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h
  FROM texts LEFT JOIN summed USING (k) WHERE NOT target
), scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5e0) / 4294967296e0)))::BIGINT AS score FROM weighed
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY long_enough ORDER BY score DESC, doc_id) AS place FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN long_enough AND place <= 25 * (SELECT count(*) FROM scored WHERE long_enough) // 100 THEN place END AS rank FROM ranked
"""


@_query
def op12_json_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null click id counts as an empty text in the checksum and as not divisible by five."""
    client, click = F.coalesce(F.pmod("client_id", F.lit(30)), F.lit(0)), F.coalesce(F.col("click_id").cast("string"), F.lit(""))
    inner = F.pmod(F.crc32(click.cast("binary")), client % 37 + 1)
    return json_schema.infer(table(spark, sf_dir, "clicks"), text=F.col("props"), group=F.concat(F.lit("g"), client), inner=F.concat(F.lit("x"), inner), wrap=F.col("click_id") % 5 == 0)


ORACLE_SQL["op12_json_schema"] = f"""
WITH RECURSIVE {CRC_SQL}, placed AS (
  SELECT 'g' || g AS g, 'x' || ({crc_sql("coalesce(click_id::VARCHAR, '')")} % (g % 37 + 1)) AS x, coalesce(click_id % 5 = 0, false) AS wrap, props
  FROM (SELECT *, coalesce(client_id % 30, 0) AS g FROM clicks), crc_table
), judged AS (
  SELECT *, CASE WHEN props IS NULL OR NOT json_valid(props) THEN false ELSE json_type(CASE WHEN json_valid(props) THEN props ELSE 'null' END) = 'OBJECT' END AS good FROM placed
), whole AS (
  SELECT '{{"' || g || '":{{"' || x || '":' || CASE WHEN wrap THEN '[' || props || ']' ELSE props END || '}}}}' AS v, count(*) AS n FROM judged WHERE good GROUP BY 1
), walk(path, parent, named, v, n, names) AS (
  SELECT '$', NULL::VARCHAR, false, v::JSON, n, NULL::BIGINT FROM whole
  UNION ALL
  SELECT CASE WHEN k IS NULL THEN path || '[]' WHEN names > 12 AND path <> '$' THEN path || '.*' ELSE path || '.' || k END, path, k IS NOT NULL AND k <> '*' AND NOT (names > 12 AND path <> '$'), v, n, names
  FROM (
    SELECT path, k, v, n, count(DISTINCT k) OVER (PARTITION BY path) AS names FROM (
      SELECT path, unnest(json_keys(v)) AS k, unnest(list_transform(json_keys(v), lambda k: json_extract(v, '$."' || k || '"'))) AS v, n FROM walk WHERE json_type(v) = 'OBJECT'
      UNION ALL SELECT path, NULL, unnest(json_extract(v, '$[*]')), n FROM walk WHERE json_type(v) = 'ARRAY'
    )
  )
), typed AS (
  SELECT path, parent, named, n, names, CASE json_type(v) WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'integer' END AS type,
    CASE WHEN json_type(v) = 'ARRAY' THEN json_array_length(v)::BIGINT END AS size FROM walk
), named_ AS (
  SELECT parent AS path, max(names) AS n_names FROM typed WHERE names > 0 GROUP BY parent
), kinds AS (
  SELECT path, string_agg(type || ':' || n, '|' ORDER BY type) AS types FROM (SELECT path, type, sum(n)::BIGINT AS n FROM typed GROUP BY path, type) GROUP BY path
), paths AS (
  SELECT path, max(parent) AS parent, bool_or(named) AS named, coalesce(sum(n) FILTER (WHERE type <> 'null'), 0) AS held, coalesce(sum(n) FILTER (WHERE type = 'object'), 0) AS objects, min(size) AS min_len, max(size) AS max_len FROM typed GROUP BY path
)
SELECT p.path, types, coalesce(n_names, 0) AS n_names, coalesce(n_names > 12 AND p.path <> '$', false) AS is_map, p.named AND p.held < coalesce(q.objects, 0) AS optional, p.min_len, p.max_len
FROM paths p JOIN kinds USING (path) LEFT JOIN named_ USING (path) LEFT JOIN paths q ON q.path = p.parent
UNION ALL SELECT '!' || g, 'bad:' || count(*), 0, false, false, NULL, NULL FROM judged WHERE NOT good GROUP BY g
"""
