"""Queries over single functions: tensors, padding, scales, logits, tokens, spans, on columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import signal, tensor, tokens, vector
from tidemark.operators import aggregates, alignment, chunking, decoding, facts, islands, segments, windows
from tidemark.plans.tables import registry, table

QUERIES, SQL, query = registry()

#: The same vector in SQL, as doubles.
_D = "list_transform(embedding, lambda x: x::DOUBLE)"


def _e() -> Column:
    return F.col("embedding")


def _id() -> Column:
    return F.col("vec_id").cast("int")


def _total(a: Column) -> Column:
    return F.round(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 4)


def _sum(a: str) -> str:
    return f"round(coalesce(list_sum({a}), 0), 4)"


def _vectors(spark: SparkSession, folder: str, **columns: Column) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", *[c.alias(k) for k, c in columns.items()])


def _parts(spark: SparkSession, folder: str, **columns: Column) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", *[c.alias(k) for k, c in columns.items()])


def _lines(spark: SparkSession, folder: str, **columns: Column) -> DataFrame:
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in columns.items()])


@query("SELECT p_partkey, p_size AS n, 0.0::DOUBLE AS total FROM part")
def tensor_zeros(spark: SparkSession, folder: str) -> DataFrame:
    z = tensor.zeros(F.col("p_size"))
    return _parts(spark, folder, n=F.size(z), total=_total(z))


@query("SELECT p_partkey, p_size::BIGINT * 2 * (p_partkey % 5 + 1) AS n FROM part")
def tensor_element_count(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder, n=tensor.element_count(F.array(F.col("p_size").cast("long"), F.lit(2).cast("long"), F.col("p_partkey") % 5 + 1)))


@query("SELECT vec_id, (4 + 4 * (vec_id % 2)) * 8 = len(embedding) AS fits FROM embeddings")
def tensor_fits(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder, fits=tensor.fits(_e(), F.array(4 + 4 * (_id() % 2), F.lit(8))))


@query(f"SELECT vec_id, 64 AS n, 8 AS first_stride, {_sum(_D)} AS total FROM embeddings")
def tensor_of(spark: SparkSession, folder: str) -> DataFrame:
    shape = F.array(F.lit(8), F.lit(8))
    t = tensor.tensor(_e(), shape)
    return _vectors(spark, folder, n=F.size(t["data"]), first_stride=F.get(tensor.strides(shape), F.lit(0)).cast("int"), total=_total(t["data"]))


def _index() -> Column:
    return F.array(_id() % 9, _id() % 5)


@query("SELECT vec_id, CASE WHEN vec_id % 9 < 8 THEN (vec_id % 9) * 8 + vec_id % 5 END AS at FROM embeddings")
def tensor_offset(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder, at=tensor.offset(_index(), F.array(F.lit(8), F.lit(8))))


@query("SELECT vec_id, CASE WHEN vec_id % 9 < 8 THEN round(embedding[((vec_id % 9) * 8 + vec_id % 5 + 1)::INT]::DOUBLE, 5) END AS x FROM embeddings")
def tensor_read_at(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder, x=F.round(tensor.read_at(_e(), _index(), F.array(F.lit(8), F.lit(8))).cast("double"), 5))


@query(f"SELECT vec_id, round(list_sum({_D}) - embedding[(vec_id % 64 + 1)::INT]::DOUBLE + 1, 4) AS total FROM embeddings")
def tensor_filled_at(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder, total=_total(tensor.filled_at(_e().cast("array<double>"), _id() % 64, F.lit(1.0))))


@query(
    f"""SELECT vec_id, CASE WHEN vec_id % 70 < 64 THEN round(list_sum({_D}) - embedding[1]::DOUBLE + 1
    + CASE WHEN vec_id % 70 > 0 THEN 1 - embedding[(vec_id % 70 + 1)::INT]::DOUBLE ELSE 0 END, 4) END AS total FROM embeddings"""
)
def tensor_filled_at_all(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder, total=_total(tensor.filled_at_all(_e().cast("array<double>"), F.array(F.lit(0), _id() % 70), F.lit(1.0))))


@query("SELECT vec_id, 40 AS n, round(list_sum(list_transform(list_concat(embedding[1:10], embedding[17:26], embedding[33:42], embedding[49:58]), lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def tensor_without_row_padding(spark: SparkSession, folder: str) -> DataFrame:
    rows = tensor.without_row_padding(_e(), 4, 10, 16)
    return _vectors(spark, folder, n=F.size(rows), total=_total(rows))


@query("SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN round(embedding[1]::DOUBLE, 5) END AS x FROM embeddings")
def tensor_scalar(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", F.struct(F.slice("embedding", F.lit(1), _id() % 2 + 1).alias("out")).alias("r"))
    return rows.select("vec_id", F.round(tensor.scalar(F.col("r"), "out"), 5).alias("x"))


@query("SELECT vec_id, CASE WHEN vec_id % 10 > 0 AND NOT (vec_id % 3 = 0 AND vec_id % 10 < 8) THEN least(vec_id % 10, 8)::INT END AS n FROM embeddings")
def tensor_prefix_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Masks of ones before zeros; every third one is turned round, which only a full mask survives."""
    ones = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i < _id() % 10, 1).otherwise(0))
    return _vectors(spark, folder, n=tensor.prefix_mask_count(F.when(_id() % 3 == 0, F.reverse(ones)).otherwise(ones)))


@query("SELECT vec_id, vec_id % 2 = 0 OR vec_id % 9 = 0 AS ok FROM embeddings")
def tensor_padding_is_zero(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors cut and padded with zeros; of odd ones, one more than the padding is looked at."""
    real = _id() % 9
    padded = signal.padded_or_cut(F.transform(F.slice("embedding", F.lit(1), real), lambda x: F.lit(1.0)), 12)
    return _vectors(spark, folder, ok=tensor.padding_is_zero(padded, F.greatest(real - _id() % 2, F.lit(0))))


@query(f"SELECT vec_id, 50 AS short, 80 AS long, {_sum(f'({_D})[1:50]')} AS cut, {_sum(_D)} AS padded FROM embeddings")
def signal_padded_or_cut(spark: SparkSession, folder: str) -> DataFrame:
    a, b = signal.padded_or_cut(_e(), 50), signal.padded_or_cut(_e(), 80)
    return _vectors(spark, folder, short=F.size(a), long=F.size(b), cut=_total(a), padded=_total(b))


@query(f"SELECT vec_id, 16 AS n, {_sum(f'({_D})[(vec_id % 80 + 1)::INT:(vec_id % 80 + 16)::INT]')} AS total FROM embeddings")
def signal_padded_from(spark: SparkSession, folder: str) -> DataFrame:
    a = signal.padded_from(_e(), _id() % 80, 16)
    return _vectors(spark, folder, n=F.size(a), total=_total(a))


@query(f"SELECT vec_id, 20 AS n, CASE WHEN vec_id % 7 = 0 THEN 0 ELSE round(list_sum(list_transform(range(20), lambda i: ({_D})[(i % (vec_id % 7) + 1)::INT])), 4) END AS total FROM embeddings")
def signal_tiled(spark: SparkSession, folder: str) -> DataFrame:
    a = signal.tiled(F.slice("embedding", F.lit(1), _id() % 7), 20)
    return _vectors(spark, folder, n=F.size(a), total=_total(a))


@query(f"SELECT vec_id, CASE WHEN vec_id % 13 BETWEEN 1 AND 10 THEN round(list_sum(({_D})[1:(vec_id % 13)::INT]) + (10 - vec_id % 13) * embedding[(vec_id % 13)::INT]::DOUBLE, 4) END AS total FROM embeddings")
def signal_held(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder, total=_total(signal.held(F.slice("embedding", F.lit(1), _id() % 13), 10)))


@query(f"SELECT vec_id, 12 AS n, round(coalesce(list_sum(({_D})[greatest(1, vec_id % 64 - 7)::INT:(vec_id % 64)::INT]), 0) + list_sum(({_D})[1:4]), 4) AS total FROM embeddings")
def signal_with_context(spark: SparkSession, folder: str) -> DataFrame:
    e = _e().cast("array<double>")
    a = signal.with_context(F.slice(e, F.lit(1), _id() % 64), F.slice(e, 1, 4), 8)
    return _vectors(spark, folder, n=F.size(a), total=_total(a))


@query("SELECT l_orderkey, l_linenumber, round(2595 * log10(1 + l_extendedprice / 700), 6) AS mel FROM lineitem")
def signal_htk_mel(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder, mel=F.round(signal.htk_mel(F.col("l_extendedprice")), 6))


@query(
    """WITH h AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 20.7 AS hz FROM lineitem),
    m AS (SELECT *, CASE WHEN hz < 1000 THEN hz * 3 / 200 ELSE 15 + ln(hz / 1000) * 27 / ln(6.4) END AS mel FROM h)
    SELECT l_orderkey, l_linenumber, round(mel, 2) AS mel, true AS back FROM m"""
)
def signal_slaney_mel(spark: SparkSession, folder: str) -> DataFrame:
    """To the Slaney scale and back. Hundredths are rounded as a double, as SQL does: F.round goes by the decimal digits."""
    mel = signal.slaney_mel(F.col("l_extendedprice") / 20.7)
    return _lines(spark, folder, mel=F.round(mel * 100, 0) / 100, back=F.abs(signal.slaney_hz(mel) - F.col("l_extendedprice") / 20.7) < 1e-6)


@query("SELECT vec_id, round(list_sum(list_transform(range(64), lambda k: embedding[(k + 1)::INT]::DOUBLE * (0.5 - 0.5 * cos(2 * pi() * k / 64)))), 4) AS windowed FROM embeddings")
def signal_hann(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder, windowed=F.round(vector.dot(_e().cast("array<double>"), signal.hann(64)), 4))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / 8, 2) AS up, round(-l_quantity / 8, 2) AS down FROM lineitem")
def signal_rounded(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder, up=signal.rounded(F.col("l_quantity") / 8, 2), down=signal.rounded(-F.col("l_quantity") / 8, 2))


@query("SELECT p_partkey, round_even(p_size / 2.0, 0)::BIGINT + 1 AS n FROM part")
def signal_grid_count(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder, n=signal.grid_count(F.col("p_size") / 2, 1.0))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN vec_id % 64 END AS at FROM embeddings")
def signal_first_bad_index(spark: SparkSession, folder: str) -> DataFrame:
    broken = F.transform(_e().cast("array<double>"), lambda x, i: F.when((_id() % 3 == 0) & (i == _id() % 64), float("nan")).otherwise(x))
    return _vectors(spark, folder, at=signal.first_bad_index(broken))


@query(f"SELECT vec_id, {_sum(_D)} AS total FROM embeddings")
def signal_gated(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors are finite, so the gate lets them pass."""
    return _vectors(spark, folder, total=_total(signal.gated(_e().cast("array<double>"))))


@query("SELECT p_partkey, round((p_size / 255.0 - 0.5) / 0.5, 9) AS x FROM part")
def signal_unit_range(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder, x=F.round(signal.unit_range(F.col("p_size")), 9))


@query("SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(25 - l_quantity)), 9) AS p FROM lineitem")
def signal_sigmoid(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder, p=F.round(signal.sigmoid(F.col("l_quantity") - 25), 9))


@query("SELECT vec_id, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE * 400000))) <= 65504 AS fits, true AS finite FROM embeddings")
def vector_ranges(spark: SparkSession, folder: str) -> DataFrame:
    scaled = F.transform(_e().cast("array<double>"), lambda x: x * 400000)
    return _vectors(spark, folder, fits=vector.fits_half(scaled), finite=vector.is_finite(scaled))


@query(f"SELECT vec_id, {_sum(_D)} AS total, round(list_max({_D}), 4) AS most FROM embeddings")
def vector_unit_renormalized(spark: SparkSession, folder: str) -> DataFrame:
    """Unit vectors within the budget, and over their norm: the tables' are, so little moves."""
    u = vector.unit(_e(), renormalize=True)
    return _vectors(spark, folder, total=F.round(vector.total(u), 4), most=F.round(F.array_max(u).cast("double"), 4))


def _best_but(ids: str) -> str:
    kept = f"list_transform(range(64), lambda k: CASE WHEN {ids} THEN -1e300 ELSE embedding[(k + 1)::INT]::DOUBLE END)"
    return f"(list_position({kept}, list_max({kept})) - 1)::INT"


@query(f"SELECT vec_id, {_best_but('k IN (0, 5, 63)')} AS token FROM embeddings")
def logits_suppressed(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder, token=islands.argmax(decoding.suppress_tokens([0, 5, 63])(_e(), F.array(F.lit(1)))))


@query(f"SELECT vec_id, CASE WHEN vec_id % 3 = 1 THEN {_best_but('k IN (1, 2, 40)')} ELSE {_best_but('k < 0')} END AS token FROM embeddings")
def logits_blank_suppressed(spark: SparkSession, folder: str) -> DataFrame:
    """Neither blank nor end at the first sampled place, which is after one token."""
    return _vectors(spark, folder, token=islands.argmax(decoding.suppress_blank([1, 2], 40, 1)(_e(), F.array_repeat(F.lit(7), _id() % 3))))


@query(f"SELECT vec_id, {_best_but('k NOT IN (3, 10, 20, 30)')} AS token, CASE {_best_but('k NOT IN (3, 10, 20, 30)')} WHEN 3 THEN 'en' WHEN 10 THEN 'zh' END AS language FROM embeddings")
def logits_language(spark: SparkSession, folder: str) -> DataFrame:
    """The likeliest of the language ids, and its code where the id has one."""
    token = islands.argmax(decoding.only_ids([3, 10, 20, 30])(_e(), F.array()))
    return _vectors(spark, folder, token=token, language=tokens.known_language(token, 3, ["en", *"abcdef", "zh"]))


@query(f"SELECT vec_id, {_best_but('k < 0')} AS token, round(-ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)))), 5) AS logprob FROM embeddings")
def logits_greedy(spark: SparkSession, folder: str) -> DataFrame:
    got = decoding.greedy(_e())
    return _vectors(spark, folder, token=got["token"].cast("int"), logprob=F.round(got["logprob"], 5))


def _joined(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


@query(
    """SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN '51,' || array_to_string(range(1, p_size % 4 + 1), ',') || ',' ELSE '' END || '50,70,80,9'
    || CASE WHEN p_partkey % 2 = 1 THEN ',3' ELSE '' END AS ids FROM part"""
)
def decode_prefill(spark: SparkSession, folder: str) -> DataFrame:
    prompt = F.filter(F.transform(F.sequence(F.lit(0), F.col("p_size") % 4), lambda k: k), lambda k: k > 0)
    prefix = F.when(F.col("p_partkey") % 2 == 1, F.array(F.lit(3), F.lit(99)))
    return _parts(spark, folder, ids=_joined(decoding.prefill(50, 51, 50, prompt, prefix, F.lit(70), F.lit(80), 9)))


def _told_ids() -> Column:
    return F.array(F.lit(9), F.lit(50), F.col("p_size"), F.lit(3), F.when(F.col("p_partkey") % 2 == 0, 49).otherwise(4), F.lit(8))


@query("SELECT p_partkey, '50,' || p_size || ',3' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ',4,8' END AS ids FROM part WHERE p_size NOT IN (49, 50)")
def decode_between(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder, p_size=F.col("p_size"), ids=_joined(decoding.between(_told_ids(), 50, 49))).filter("p_size NOT IN (49, 50)").drop("p_size")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 4 END AS n, round(-(p_size + 3.0) / CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 4 END, 6) AS average FROM part")
def decode_finished(spark: SparkSession, folder: str) -> DataFrame:
    """Token lists without their end get one, of logprob 0."""
    ids = F.array(F.lit(1), F.lit(2), F.when(F.col("p_partkey") % 2 == 0, 49).otherwise(3))
    ids, logprobs = decoding.finished(ids, F.array(F.lit(-1.0), F.lit(-2.0), -F.col("p_size").cast("double")), 49)
    return _parts(spark, folder, n=F.size(ids), average=F.round(decoding.average(logprobs), 6))


@query("SELECT l_orderkey, l_linenumber, l_quantity > 24 OR -l_tax * 50 < -1 AS stops FROM lineitem")
def decode_stops_early(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder, stops=decoding.stops_early(F.col("l_quantity"), -F.col("l_tax") * 50, 24.0, -1.0))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END AS at FROM part")
def decode_sampled_from(spark: SparkSession, folder: str) -> DataFrame:
    """The task id stands at each of five places; from the fourth on it is not looked for."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.when(k == F.col("p_size") % 5, 77).otherwise(1))
    return _parts(spark, folder, at=decoding.sampled_from(ids, [77, 78]))


@query("SELECT p_partkey, CASE WHEN p_size >= 10 THEN round((p_size - 10) * 0.02::DOUBLE, 6) END AS seconds, 10 + p_size * 2 AS back FROM part")
def token_time_marks(spark: SparkSession, folder: str) -> DataFrame:
    mark = tokens.TimeMark(10)
    return _parts(spark, folder, seconds=F.round(mark.seconds(F.col("p_size")), 6), back=mark.token(F.col("p_size") * 0.04))


@query("SELECT p_type AS token, coalesce(min(p_size) FILTER (p_type LIKE 'S%'), -1) AS id FROM part GROUP BY p_type")
def token_special_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids that a vocabulary has, here of the types that begin with S, else the default."""
    parts = table(spark, folder, "part")
    known = parts.filter("p_type LIKE 'S%'").groupBy(F.col("p_type").alias("token")).agg(F.min("p_size").alias("id"))
    return tokens.special_ids(parts.select(F.col("p_type").alias("token"), F.lit(-1).alias("default")).distinct(), known)


@query("SELECT 'repeated id' AS fault FROM part HAVING count(DISTINCT p_size) < count(*) UNION ALL SELECT 'special id of nothing'")
def token_vocabulary_faults(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "part").select(F.concat("p_name", F.lit(" "), "p_partkey").alias("token"), F.col("p_size").alias("id"))
    return tokens.vocabulary_faults(words, words.count(), {"nothing": 5})


@query(
    """WITH t AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) AS w, generate_subscripts(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), 1) AS k FROM conversations WHERE text IS NOT NULL),
    s AS (SELECT *, sum(CASE WHEN k % 3 = 1 OR k = 5 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY k) AS word_at FROM t)
    SELECT conv_id, turn, word_at::BIGINT AS word_at, string_agg(CASE WHEN k % 3 = 1 THEN ' ' ELSE '' END || 'x' || length(w), '' ORDER BY k) AS word, min(k)::INT AS first, max(k)::INT AS last FROM s GROUP BY ALL"""
)
def token_spaced_words(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of which each third starts with a space; the fifth one of a turn is special, and what follows joins it."""
    rows = table(spark, folder, "conversations").filter("text IS NOT NULL")
    rows = rows.select("conv_id", "turn", F.posexplode(F.split(F.regexp_replace("text", r"\s+", " "), " ")).alias("p", "w")).withColumn("k", F.col("p") + 1)
    piece = F.concat(F.when(F.col("k") % 3 == 1, " ").otherwise(""), F.lit("x"), F.char_length("w").cast("string"))
    return tokens.spaced_words(rows.select("conv_id", "turn", "k", piece.alias("t"), (F.col("k") == 5).alias("special")), ["conv_id", "turn"], "k", "t", "special")


@query("SELECT conv_id, turn FROM conversations WHERE turn % 3 != 0")
def segment_not_blank(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").withColumn("said", F.when(F.col("turn") % 3 == 0, "<|[BLANK_AUDIO]|>").otherwise(F.concat(F.lit("t "), F.col("role"))))
    return segments.not_blank(rows, "said").select("conv_id", "turn")


@query("SELECT event_id FROM events WHERE value > 10")
def segment_positive(spark: SparkSession, folder: str) -> DataFrame:
    return segments.positive(table(spark, folder, "events").withColumn("from", F.lit(10.0)), "from", "value").select("event_id")


@query("SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'below the floor' WHEN vec_id % 4 = 1 THEN 'not normalised' WHEN vec_id % 4 = 2 THEN 'not a number' END AS fault FROM embeddings")
def align_log_prob_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Log probabilities made from each vector, broken in one of three ways or left."""
    e = _e().cast("array<double>")
    k = _id() % 4

    def frame_of(a: Column, total: Column) -> Column:
        return F.transform(a, lambda x, i: F.when((k == 0) & (i == 3), -101.0).when(k == 1, x - total + 0.5).when((k == 2) & (i == 5), float("nan")).otherwise(x - total))

    frame = signal.let(e, lambda a: signal.let(signal.log_sum_exp(a), lambda total: frame_of(a, total)))
    return _vectors(spark, folder, fault=alignment.log_prob_faults(frame))


@query(
    r"""SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(string_split(replace(upper(replace(text, 'ß', 'ss')), ' ', '|'), ''), lambda c: c <> '' AND NOT regexp_matches(c, '[A-Z''|]')))), '') AS unknown FROM benchmark"""
)
def align_unknown_characters(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select("item_id", F.array_join(F.array_sort(alignment.unknown_characters(F.col("text"))), "").alias("unknown"))


@query("SELECT p_partkey, CASE WHEN p_partkey * 10000 <= 480000 THEN 1 ELSE ceil((p_partkey * 10000 - 480000) / 336000)::BIGINT + 1 END AS n FROM part")
def window_overlapped_starts(spark: SparkSession, folder: str) -> DataFrame:
    starts = windows.overlapped_starts(F.col("p_partkey") * 10000)
    return _parts(spark, folder, n=F.size(starts).cast("long"))


@query("SELECT p_partkey, CASE WHEN p_partkey * 100 <= 0 THEN 0 ELSE least(500, floor(greatest(p_partkey * 100 - 400, 0) / 320)::BIGINT + 1) END AS n FROM part")
def window_truncated_frames(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder, n=windows.truncated_frames(F.col("p_partkey") * 100, F.lit(500).cast("long")))


@query(
    """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '0-' || p_partkey WHEN 1 THEN '8000-' || p_partkey ELSE '8000-' || (p_size * 16000) END AS clips FROM part"""
)
def island_seek_clips(spark: SparkSession, folder: str) -> DataFrame:
    """None, one or two seconds to seek to."""
    k = F.col("p_size") % 3
    seconds = F.slice(F.array(F.lit(0.5), F.col("p_size").cast("double")), F.lit(1), k)
    clips = F.transform(islands.seek_clips(seconds, F.col("p_partkey")), lambda c: F.concat(c["start"].cast("string"), F.lit("-"), c["end"].cast("string")))
    return _parts(spark, folder, clips=F.array_join(clips, ","))


@query(
    """WITH a AS (SELECT vec_id, list_position(embedding[1:7], list_max(embedding[1:7])) AS k FROM embeddings)
    SELECT vec_id, ['0,0,0', '1,0,0', '0,1,0', '0,0,1', '1,1,0', '1,0,1', '0,1,1'][k::INT] AS speakers FROM a"""
)
def island_multilabel(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder, speakers=_joined(islands.multilabel(F.slice("embedding", 1, 7))))


@query("SELECT p_partkey, greatest(p_size, p_partkey % 50) AS bound, p_partkey % 2 = 0 AND p_size = p_partkey % 50 AS exact FROM part")
def aggregate_effective_span(spark: SparkSession, folder: str) -> DataFrame:
    got = aggregates.effective_span(F.col("p_size").cast("long"), F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 50)
    return _parts(spark, folder, bound=got["bound"], exact=got["exact"])


@query("SELECT event_type, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.5) AS p50 FROM events GROUP BY event_type")
def aggregate_nearest_rank(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    return rows.groupBy("event_type").agg(aggregates.nearest_rank(F.col("value"), 0.9).alias("p90"), aggregates.nearest_rank(F.col("value"), 0.5).alias("p50"))


@query(
    """SELECT user_id, least(max(epoch_us(ts)::DOUBLE / 1e6 + value) - min(epoch_us(ts)::DOUBLE / 1e6), sum(value))::DECIMAL(18, 3)::DOUBLE AS seconds FROM events GROUP BY user_id"""
)
def aggregate_pipeline_time(spark: SparkSession, folder: str) -> DataFrame:
    got = aggregates.pipeline_time(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, F.col("value"))
    return table(spark, folder, "events").groupBy("user_id").agg(got.cast("decimal(18,3)").cast("double").alias("seconds"))


@query("SELECT doc_id, coalesce((quality = 0 OR toxic = 1) AND doc_id % 3 > 0, false) AS again FROM labels")
def facts_reproducible(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labels")
    return rows.select("doc_id", facts.reproducible(F.col("quality"), F.col("toxic") == 1, F.col("doc_id") % 3 > 0).alias("again"))


@query(
    """WITH r AS (SELECT p_brand, p_partkey, CASE WHEN p_size % 4 > 0 THEN p_size % 2 = 0 END AS seen, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS language, p_size FROM part)
    SELECT p_brand, CASE WHEN bool_or(seen) THEN true WHEN count(seen) < count(*) THEN NULL ELSE false END AS seen,
    arg_min(language, p_partkey) FILTER (language IS NOT NULL) AS language, CASE WHEN count(language) = count(*) THEN count(*) END AS known, sum(p_size)::BIGINT AS bound, bool_and(p_size > 1) AS exact
    FROM r GROUP BY p_brand"""
)
def facts_merged(spark: SparkSession, folder: str) -> DataFrame:
    """The facts of a brand's parts, as of tasks in order."""
    rows = table(spark, folder, "part").select(
        "p_brand",
        "p_partkey",
        F.when(F.col("p_size") % 4 > 0, F.col("p_size") % 2 == 0).alias("seen"),
        F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).alias("language"),
        F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).alias("schedule"),
        F.col("p_size").cast("long").alias("bound"),
        (F.col("p_size") > 1).alias("exact"),
    )
    got = facts.merged_facts(rows, ["p_brand"], "p_partkey", ["seen"], "language", "schedule", "bound", "exact")
    return got.select("p_brand", "seen", "language", F.when(F.col("schedule").isNotNull(), F.size("schedule").cast("long")).alias("known"), "span.bound", "span.exact")


@query("SELECT p_partkey, repeat('0,', (60 - p_size)::INT) || array_to_string(range(1, p_size + 1), ',') AS ids, p_size AS used FROM part")
def chunk_padded_window(spark: SparkSession, folder: str) -> DataFrame:
    ids, mask = chunking.padded_window(F.sequence(F.lit(1), F.col("p_size")), 60, left=True)
    return _parts(spark, folder, ids=_joined(ids), used=F.aggregate(mask, F.lit(0), lambda s, x: s + x))


@query("SELECT doc_id, octet_length(encode(coalesce(text, ''))) <= 2000 AS admitted FROM documents")
def chunk_admitted(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", chunking.admitted(F.coalesce("text", F.lit("")), 2000).alias("admitted"))
