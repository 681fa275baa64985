"""Timed segments: merging, numbering, shifting, captions and cutting at time marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as T

#: Fixed values.
BLANK, TIME_STEP = "[BLANK_AUDIO]", 0.02


def shifted(df: DataFrame, offset: Column, columns: list[str], words: str | None = None) -> DataFrame:
    """df with the offset added to columns, and to start and end of the words inside."""
    for c in columns:
        df = df.withColumn(c, F.col(c) + offset)
    if words:
        df = df.withColumn(words, F.transform(words, lambda w: w.withField("start", w["start"] + offset).withField("end", w["end"] + offset)))
    return df


def not_blank(df: DataFrame, text: str) -> DataFrame:
    return df.filter(F.trim(T.without_marks(F.col(text))) != BLANK)


def positive(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.filter(F.col(end) > F.col(start))


def numbered(df: DataFrame, by: list[str], order: str, span: str, column: str = "first_id") -> DataFrame:
    """df with the sum of the spans before each row: ids that never collide."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(column, F.coalesce(F.sum(span).over(w), F.lit(0)).cast("long"))


def merged(df: DataFrame, by: list[str], order: str, text: str, sep: str = " ", skip_blank: bool = True, extra: list[Column] | None = None) -> DataFrame:
    """(by, text, n, ...): the texts of a group by order, blank ones left out if asked."""
    kept = F.trim(F.col(text)) != "" if skip_blank else F.lit(True)
    one = F.when(kept & F.col(text).isNotNull(), F.struct(F.col(order), F.col(text).alias("t")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["t"]), sep)
    return df.groupBy(*by).agg(joined.alias("text"), F.count(one).alias("n"), *(extra or []))


def cues(df: DataFrame, by: list[str], order: list[str], start: str, end: str, text: str, kind: str = "srt") -> DataFrame:
    """(by, content): a caption file for each group, cues numbered from 1 (srt) or without numbers (vtt)."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    cue = T.srt_cue(F.col("__n"), F.col(start), F.col(end), F.col(text)) if kind == "srt" else T.vtt_cue(F.col(start), F.col(end), F.col(text))
    rows = df.withColumn("__n", n).withColumn("__cue", cue)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__cue"))), lambda s: s["__cue"]), "\n")
    return rows.groupBy(*by).agg((body if kind == "srt" else F.concat(F.lit("WEBVTT\n\n"), body)).alias("content"))


def word_cues(segments: DataFrame, by: list[str], order: str, words: str = "words") -> DataFrame:
    """One row for each word of a segment that has words, else one for the segment: (by, order, at, start, end, text)."""
    own = F.when(F.size(words) > 0, F.transform(words, lambda w: F.struct(w["start"].cast("double").alias("start"), w["end"].cast("double").alias("end"), w["word"].alias("text"))))
    whole = F.array(F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.col("text").alias("text")))
    return segments.select(*by, order, F.posexplode(F.coalesce(own, whole)).alias("at", "__cue")).select(*by, order, "at", "__cue.start", "__cue.end", "__cue.text")


def marked_segments(tokens: DataFrame, by: list[str], at: str, token: str, first_mark: int, step: float = TIME_STEP, window: float = 30.0) -> DataFrame:
    """(by, segment, start, end, tokens, advance): a token stream cut where two time marks follow each other.

    A segment's times are its first and last mark. What follows the last cut is a segment if the stream ends in
    text, one mark and a last token (which is left out), or in three tokens that are no marks; else it is left to the
    next window. Without any cut, all tokens are one segment, to the last mark after the first possible one, or of
    the whole window. advance: the seconds to the next window.
    """
    w = Window.partitionBy(*by).orderBy(at)
    whole = Window.partitionBy(*by)
    rows = tokens.withColumn("__m", F.col(token) >= first_mark)
    rows = rows.withColumn("__cut", F.coalesce(F.col("__m") & F.lag("__m").over(w), F.lit(False)).cast("int"))
    back = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(at)))
    rows = rows.withColumn("segment", F.sum("__cut").over(w)).withColumn("__back", back).withColumn("__cuts", F.sum("__cut").over(whole))
    last = [F.max(F.when(F.col("__back") == k, F.col("__m"))).over(whole) for k in (3, 2, 1)]
    for name, marks in (("__single", (False, True, False)), ("__plain", (False, False, False))):
        rows = rows.withColumn(name, F.coalesce((last[0] == marks[0]) & (last[1] == marks[1]) & (last[2] == marks[2]), F.lit(False)))
    rows = rows.withColumn("__last", F.max_by(F.col(token), F.when(F.col("__m"), F.col(at))).over(whole))
    ends = F.max(F.when(F.col("__cut") == 1, F.struct(F.col(at).alias("a"), F.col(token).alias("t")))).over(whole)["t"]
    rows = rows.withColumn("__end", F.when(F.col("__single"), F.col("__last")).otherwise(ends))
    rest = (F.col("segment") == F.col("__cuts")) & (F.col("__cuts") > 0)
    rows = rows.filter(~rest | F.col("__plain") | (F.col("__single") & (F.col("__back") > 1)))
    mark = F.when(F.col("__m"), F.col(token) - first_mark)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("a"), F.col(token).alias("t")))), lambda s: s["t"])
    place = F.when(F.col("__m"), F.col(at))
    late = F.max_by(F.col(token) - first_mark, F.when(F.col(token) > first_mark, F.col(at)))
    got = rows.groupBy(*by, "segment", "__cuts", "__plain", "__end").agg(F.min_by(mark, place).alias("__first"), F.max_by(mark, place).alias("__to"), late.alias("__late"), ordered.alias("tokens"))
    none = F.col("__cuts") == 0
    return got.select(
        *by,
        "segment",
        F.when(none, 0.0).otherwise(F.col("__first") * step).alias("start"),
        F.when(none, F.coalesce(F.col("__late") * step, F.lit(window))).otherwise(F.col("__to") * step).alias("end"),
        "tokens",
        F.when(none | F.col("__plain"), window).otherwise((F.col("__end") - first_mark) * step).alias("advance"),
    )


def punctuation_merged(words: DataFrame, by: list[str], at: str, word: str, opening: str = "\"'“¿([{-", closing: str = "\"'.。,，!！?？:：”)]}、") -> DataFrame:
    """words with opening marks glued to the next word and closing marks to the previous one; hosts keep their times.

    An opening mark starts with a space; a closing one doesn't follow a word that ends with one. A mark is glued to
    its neighbour as it stood, so of several in a row only the nearest stays; bare marks that are left go.
    """
    w = Window.partitionBy(*by).orderBy(at)
    holds = lambda marks, x: (x != "") & F.lit(marks).contains(x)
    trimmed = lambda x: F.regexp_replace(x, r"^[\p{Zs}\t]+|[\p{Zs}\t]+$", "")
    rows = words.withColumn("__o", holds(opening, trimmed(F.col(word)))).withColumn("__g", F.col("__o") & F.col(word).rlike(r"^[\p{Zs}\t]"))
    before = F.when(F.lag("__g").over(w), F.lag(word).over(w)).otherwise("")
    first, last = F.lag(at).over(w).isNull(), F.lead(at).over(w).isNull()
    rows = rows.withColumn("__w", F.concat(before, word)).withColumn("__stays", ~(F.col("__g") & ~last) & ~(first & F.col("__o")))
    rows = rows.filter("__stays").withColumn(word, F.col("__w"))
    closes = holds(closing, trimmed(F.col(word))) & F.coalesce(~F.lag(word).over(w).endswith(" "), F.lit(False))
    rows = rows.withColumn("__c", closes)
    rows = rows.withColumn("__gone", F.coalesce(F.lead("__c").over(w), F.lit(False)))
    others = [c for c in words.columns if c not in (*by, word)]
    taken = [F.when(F.col("__c"), F.lag(c).over(w)).otherwise(F.col(c)).alias(c) for c in others]
    rows = rows.select(*by, *taken, F.when(F.col("__c"), F.concat(F.lag(word).over(w), word)).otherwise(F.col(word)).alias(word), "__gone")
    return rows.filter(~F.col("__gone") & (F.col(word) != "") & ~holds(closing, F.col(word)) & ~holds(opening, F.col(word))).select(*words.columns)


#: Fixed value: marks that end a sentence.
SENTENCE_ENDS = [".", "。", "!", "！", "?", "？"]


def long_words_cut(words: DataFrame, by: list[str], at: str, word: str, start: str, end: str, longest: Column | float) -> DataFrame:
    """words that last too long, cut at sentence ends: a mark loses its end, a word after a mark its beginning. Marks
    count as they stand, without spaces; the first word is never cut."""
    most = longest if isinstance(longest, Column) else F.lit(longest)
    before = F.lag(word).over(Window.partitionBy(*by).orderBy(at))
    long = before.isNotNull() & ((F.col(end) - F.col(start)) > most)
    is_mark, after = F.col(word).isin(*SENTENCE_ENDS), before.isin(*SENTENCE_ENDS)
    rows = words.withColumn("__s", F.when(long & ~is_mark & after, F.col(end) - most).otherwise(F.col(start))).withColumn("__e", F.when(long & is_mark, F.col(start) + most).otherwise(F.col(end)))
    return rows.withColumn(start, F.col("__s")).withColumn(end, F.col("__e")).drop("__s", "__e")


def words_to_segments(words: DataFrame, segments: DataFrame, by: list[str], word_tokens: str = "n_tokens", segment_tokens: str = "n_tokens") -> DataFrame:
    """Each word with the segment whose tokens hold the word's first token: a range join on running token counts.

    Both sides are cut into buckets of tokens, so the join is one by equality, then by range.
    """
    size = 64
    w, s = Window.partitionBy(*by).orderBy("word_at"), Window.partitionBy(*by).orderBy("segment")
    first = words.withColumn("__f", F.sum(word_tokens).over(w) - F.col(word_tokens)).withColumn("__b", F.floor(F.col("__f") / size))
    held = segments.select(*by, "segment", F.col(segment_tokens).alias("__n"), F.sum(segment_tokens).over(s).alias("__to")).withColumn("__from", F.col("__to") - F.col("__n"))
    held = held.filter("__n > 0").withColumn("__b", F.explode(F.sequence(F.floor(F.col("__from") / size), F.floor((F.col("__to") - 1) / size))))
    both = first.join(held, [*by, "__b"]).filter("__f >= __from AND __f < __to")
    return both.drop("__f", "__b", "__n", "__from", "__to")
