"""Queries over texts, conversations and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as T
from tidemark.operators import aggregates, chunking, decoding, ranking, segments
from tidemark.plans.tables import registry, table

QUERIES, SQL, query = registry()


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations")


def _norm_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(lower({x}), '-', ' '), '\p{{P}}', '', 'g'), ' +', ' ', 'g'), ' ')"


@query(f"SELECT doc_id, length({_norm_sql('text')}) AS n_chars, md5({_norm_sql('text')}) AS digest FROM documents")
def doc_normalized(spark: SparkSession, folder: str) -> DataFrame:
    t = T.normalized(F.col("text"))
    return _docs(spark, folder).select("doc_id", F.char_length(t).cast("long").alias("n_chars"), F.md5(t.cast("binary")).alias("digest"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n_words, strlen(text) AS n_bytes, strlen(text) <= 2000 AS admitted FROM documents")
def doc_word_counts(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, folder).select("doc_id", F.size(T.words(t)).cast("long").alias("n_words"), F.octet_length(t).cast("long").alias("n_bytes"), chunking.admitted(t, 2000).alias("admitted"))


@query("SELECT doc_id, sha256(text) AS digest, regexp_replace(regexp_replace(text, '^[<|>]+', ''), '[<|>]+$', '') = text AS unmarked FROM documents")
def doc_digests(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.functions import vector

    return _docs(spark, folder).select("doc_id", vector.sha256_hex(F.col("text")).alias("digest"), (T.without_marks(F.col("text")) == F.col("text")).alias("unmarked"))


_PAIR = rf"""w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM conversations),
p AS (SELECT conv_id, turn, w AS b, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM w),
z AS (SELECT conv_id, turn, b, coalesce(list_position(list_transform(range(1, greatest(len(a), len(b)) + 1), lambda i: coalesce({_norm_sql('a[i]')} = {_norm_sql('b[i]')}, false)), false) - 1, greatest(len(a), len(b))) AS n FROM p WHERE a IS NOT NULL)"""


@query(f"WITH {_PAIR} SELECT conv_id, turn, CAST(n AS INT) AS n, array_to_string(list_slice(b, 1, n), ' ') AS common, len(b) - n AS n_different FROM z")
def conv_common_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn's words against those of the turn before: what agrees at the start, and what is left."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _turns(spark, folder).select("conv_id", "turn", T.words(F.col("text")).alias("b")).withColumn("a", F.lag("b").over(w)).filter("a IS NOT NULL")
    a, b = F.col("a"), F.col("b")
    rows = rows.withColumn("n", T.common_prefix_length(a, b))
    return rows.select("conv_id", "turn", "n", F.array_join(T.common_prefix(a, b), " ").alias("common"), F.size(T.different_suffix(a, b)).cast("long").alias("n_different"))


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (trim(text) <> '') AS text, count(*) FILTER (trim(text) <> '') AS n, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id")
def conv_merge(spark: SparkSession, folder: str) -> DataFrame:
    return segments.merged(_turns(spark, folder), ["conv_id"], "turn", "text", extra=[F.min_by("role", "turn").alias("first_role")])


_TIMED = "d AS (SELECT conv_id, turn, text, length(text) * 50 AS ms FROM conversations), t AS (SELECT *, sum(ms) OVER (PARTITION BY conv_id ORDER BY turn) AS z FROM d)"


def _timed(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as segments of a twentieth of a second for each character, one after the other."""
    rows = _turns(spark, folder).select("conv_id", "turn", "text", (F.char_length("text").cast("long") * 50).alias("ms"))
    return rows.withColumn("z", F.sum("ms").over(Window.partitionBy("conv_id").orderBy("turn"))).withColumn("start", (F.col("z") - F.col("ms")) / 1000).withColumn("end", F.col("z") / 1000)


@query(f"WITH {_TIMED} SELECT conv_id, turn, ms AS n, CAST(z - ms AS BIGINT) AS first_id, round((z - ms) / 1000 + 100, 3) AS \"start\", round(z / 1000 + 100, 3) AS \"end\" FROM t")
def conv_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers by prefix sums, and times moved by a seek of 100 seconds."""
    rows = segments.numbered(_timed(spark, folder).withColumnRenamed("ms", "n"), ["conv_id"], "turn", "n")
    rows = segments.shifted(rows, F.lit(100.0), ["start", "end"])
    return rows.select("conv_id", "turn", "n", "first_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def _clock_sql(ms: str, mark: str, hours: bool) -> str:
    long = f"printf('%02d:%02d:%02d{mark}%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"
    return long if hours else f"CASE WHEN {ms} >= 3600000 THEN {long} ELSE printf('%02d:%02d{mark}%03d', {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000) END"


_MS = "CAST(z - ms AS BIGINT)", "CAST(z AS BIGINT)"


@query(
    f"""WITH {_TIMED}, c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) || chr(10) || {_clock_sql(_MS[0], ',', True)} || ' --> ' || {_clock_sql(_MS[1], ',', True)} || chr(10) || trim(text, ' ') || chr(10) AS cue FROM t)
    SELECT conv_id, string_agg(cue, chr(10) ORDER BY turn) AS content FROM c GROUP BY conv_id"""
)
def conv_cues_srt(spark: SparkSession, folder: str) -> DataFrame:
    return segments.cues(_timed(spark, folder), ["conv_id"], ["turn"], "start", "end", "text")


@query(
    f"""WITH {_TIMED}, c AS (SELECT conv_id, turn, {_clock_sql(_MS[0], '.', False)} || ' --> ' || {_clock_sql(_MS[1], '.', False)} || chr(10) || trim(text, ' ') || chr(10) AS cue FROM t)
    SELECT conv_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(cue, chr(10) ORDER BY turn) AS content FROM c GROUP BY conv_id"""
)
def conv_cues_vtt(spark: SparkSession, folder: str) -> DataFrame:
    return segments.cues(_timed(spark, folder), ["conv_id"], ["turn"], "start", "end", "text", "vtt")


@query(f"WITH {_TIMED} SELECT conv_id, turn, printf('[%.2f --> %.2f] %s', (z - ms) / 1000, z / 1000, role_text) AS line FROM (SELECT t.*, t.text AS role_text FROM t)")
def conv_segment_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _timed(spark, folder).select("conv_id", "turn", T.segment_line(F.col("start"), F.col("end"), F.col("text")).alias("line"))


@query(
    """SELECT lang, CASE WHEN bool_or(toxic = 1) THEN true WHEN count(toxic) < count(*) THEN NULL ELSE false END AS any_toxic,
    CASE WHEN bool_or(quality = 2) THEN true WHEN count(quality) < count(*) THEN NULL ELSE false END AS any_two
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang"""
)
def label_kleene(spark: SparkSession, folder: str) -> DataFrame:
    """Three-valued or: documents without a label are unknown."""
    rows = _docs(spark, folder).select("doc_id", "lang").join(table(spark, folder, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(aggregates.kleene_or(F.col("toxic") == 1).alias("any_toxic"), aggregates.kleene_or(F.col("quality") == 2).alias("any_two"))


_ATTEMPT = "x AS (SELECT doc_id, n_chars % 7 / -3.0 AS first, CASE WHEN toxic = 1 THEN 0.9 ELSE 0.1 END AS silent, n_chars % 11 / 3.0 AS ratio, n_chars % 5 / -3.0 AS mean FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"WITH {_ATTEMPT} SELECT doc_id, CASE WHEN first < -1.5 THEN 'first_token' WHEN silent > 0.6 THEN NULL WHEN ratio > 2.4 THEN 'compression' WHEN mean < -1.0 THEN 'average' END AS reason FROM x")
def fallback_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Why an attempt would be made again; the rules apply in order."""
    n = F.col("n_chars")
    rows = _docs(spark, folder).select("doc_id", "n_chars").join(table(spark, folder, "labels").select("doc_id", "toxic"), "doc_id", "left")
    silent = F.when(F.col("toxic") == 1, 0.9).otherwise(0.1)
    return rows.select("doc_id", decoding.Acceptance().reason(n % 7 / -3.0, silent, n % 11 / 3.0, n % 5 / -3.0).alias("reason"))


@query(
    """WITH a AS (SELECT doc_id, k, (n_chars + 3 * k) % 11 / 3.0 AS ratio FROM documents, range(0, 6) r(k)),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN ratio > 2.4 THEN 1000 - k ELSE k END) AS n FROM a)
    SELECT doc_id, CAST(k AS INT) AS attempt, CAST(round(k * 0.2, 1) AS DOUBLE) AS temperature, ratio <= 2.4 AS accepted FROM o WHERE n = 1"""
)
def temperature_ladder(spark: SparkSession, folder: str) -> DataFrame:
    """The first attempt that is accepted, else the last."""
    ladder = F.array(*[F.lit(t) for t in decoding.temperatures()])
    rows = _docs(spark, folder).select("doc_id", "n_chars", F.posexplode(ladder).alias("attempt", "temperature"))
    rows = rows.withColumn("reason", F.when((F.col("n_chars") + 3 * F.col("attempt")) % 11 / 3.0 > 2.4, "compression"))
    best = decoding.first_accepted(rows, ["doc_id"], "attempt", "reason", ["attempt", "temperature", "reason"])
    return best.select("doc_id", "attempt", F.round("temperature", 1).alias("temperature"), F.col("reason").isNull().alias("accepted"))


@query("SELECT doc_id, lang, CASE lang WHEN 'en' THEN 'english-model' WHEN 'de' THEN 'german-model' ELSE 'any-model' END AS model, CASE WHEN lang IN ('en', 'de') THEN 'exact' ELSE 'any' END AS binding FROM documents")
def registry_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """A language's own model, else the one for any."""
    models = spark.createDataFrame([("en", "english-model"), ("de", "german-model"), ("*", "any-model")], "lang string, model string")
    return ranking.resolved(_docs(spark, folder).select("doc_id", "lang"), models, "lang", "model").select("doc_id", "lang", "model", "binding")


@query(
    """WITH t(prefix, chip, ord) AS (VALUES ('src', 'a', 0), ('src1', 'b', 1), ('src12', 'c', 2), ('other', 'd', 3)),
    m AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, chip, row_number() OVER (PARTITION BY source ORDER BY length(prefix) DESC, ord) AS n FROM m JOIN t ON starts_with(source, prefix))
    SELECT doc_id, source, coalesce(chip, 'none') AS chip FROM documents LEFT JOIN (SELECT * FROM r WHERE n = 1) USING (source)"""
)
def longest_prefix_match(spark: SparkSession, folder: str) -> DataFrame:
    known = spark.createDataFrame([("src", "a", 0), ("src1", "b", 1), ("src12", "c", 2), ("other", "d", 3)], "prefix string, chip string, ord int")
    return ranking.longest_prefix(_docs(spark, folder).select("doc_id", "source"), known, "source", "prefix", "ord", {"chip": "none"}).select("doc_id", "source", "chip")


@query("SELECT doc_id, lang, CASE lang WHEN 'en' THEN 'en' WHEN 'de' THEN 'de' WHEN 'fr' THEN 'fr' WHEN 'es' THEN 'es' END AS code, lower(split_part(lang || '-XX', '-', 1)) AS base FROM documents")
def doc_languages(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", "lang", T.language_code(F.col("lang")).alias("code"), T.primary_language(F.concat("lang", F.lit("-XX"))).alias("base"))


@query("SELECT page_id, url LIKE 'https://%/en/%' AS is_en, CASE WHEN list_contains(string_split(url, '/'), 'en') THEN array_to_string(list_slice(string_split(url, '/'), 1, list_position(string_split(url, '/'), 'en') - 1), '/') END AS base FROM pages")
def page_globs(spark: SparkSession, folder: str) -> DataFrame:
    """Wildcards, and the folder above one of a name."""
    url = F.col("url")
    return table(spark, folder, "pages").select("page_id", T.matches_glob(url, "https://*/en/*").alias("is_en"), T.base_folder(url, "en").alias("base"))


@query()
def doc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of at most 128 tokens that partition each text."""
    return chunking.chunked(_docs(spark, folder), "doc_id", "text", 128)


@query()
def doc_compression(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", T.text_compression_ratio(F.col("text")).alias("ratio"))


def _words(spark: SparkSession, folder: str) -> DataFrame:
    """The words of the benchmark items, as if each took a tenth of a second for each character."""
    rows = table(spark, folder, "benchmark").select("item_id", F.posexplode(T.words(F.col("text"))).alias("at", "word"))
    rows = rows.withColumn("s", F.char_length("word") / 10).withColumn("end", F.sum("s").over(Window.partitionBy("item_id").orderBy("at")))
    return rows.select("item_id", "at", F.concat(F.lit(" "), "word").alias("word"), (F.col("end") - F.col("s")).alias("start"), "end")


@query()
def word_punctuation(spark: SparkSession, folder: str) -> DataFrame:
    """Marks split from the words, glued back to them."""
    rows = _words(spark, folder).withColumn("p", F.explode(F.regexp_extract_all("word", F.lit(r"(\s?\w+|\s?[^\w\s])"), F.lit(1))))
    rows = rows.withColumn("at2", F.row_number().over(Window.partitionBy("item_id").orderBy("at", F.expr("instr(word, p)"))))
    return segments.punctuation_merged(rows.select("item_id", F.col("at2").alias("at"), F.col("p").alias("word"), "start", "end"), ["item_id"], "at", "word")


@query()
def long_words(spark: SparkSession, folder: str) -> DataFrame:
    return segments.long_words_cut(_words(spark, folder), ["item_id"], "at", "word", "start", "end", 0.7)


@query()
def diarization_error(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as speakers of a recording, against the same turns half a second late and with swapped names."""
    from tidemark.operators import clustering

    rows = _turns(spark, folder).select("conv_id", F.col("role").alias("spk"), "turn", (F.char_length("text") / 100).alias("d"))
    rows = rows.withColumn("end", F.sum("d").over(Window.partitionBy("conv_id").orderBy("turn"))).withColumn("start", F.col("end") - F.col("d"))
    late = rows.select("conv_id", F.concat(F.lit("x"), "spk").alias("spk"), (F.col("start") + 0.5).alias("start"), (F.col("end") + 0.5).alias("end"))
    return clustering.error_rate(rows.select("conv_id", "spk", "start", "end"), late, ["conv_id"])
