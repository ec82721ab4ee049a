"""Text cleaning steps, each a column expression or a table operator; a plan runs as one conditional pipeline."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tabwarden.functions.stored import stored
from tabwarden.operators import pii
from tabwarden.operators.neighbours import nearest  # noqa: F401
from tabwarden.operators.sentences import Model, split

#: Steps in canonical order, and the values a record's status may have.
STEPS = ("html_strip", "language", "spelling", "sentences", "tokens", "entities", "validation")
STATUSES = ("cleaned", "partial", "failed")
#: Cells of a language profile that tasks carry, n-grams by languages, at some 30 bytes each; a larger one is joined.
CARRIED = 1 << 21
#: Words that a task remembers, about.
WORDS = 1 << 17


#: From where a line or the last tag began: what stands before a tag, kept, and the tag, from the first `<` to
#: the first `>`.  Only such places are tried, each once, so that time grows with the text.
TAG = r"(?<![^\n>])([^\n<>]*+)<[^\n>]*+>"


def strip_html(c: Column) -> Column:
    """Tags out, blanks collapsed; a text without tags stays as it is."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(c, TAG, "$1"), r"[ \t\r\n\f]+", " "))
    return F.when(c.rlike(TAG), clean).otherwise(c)


def html_changed(c: Column) -> Column:
    return c != strip_html(c)


def html_confidence(c: Column) -> Column:
    """1 without tags, 0.95 where stripping changed the text, else 0.8."""
    return F.when(~c.rlike(TAG), F.lit(1.0)).otherwise(F.when(html_changed(c), 0.95).otherwise(0.8))


def spell_gate(noisy: DataFrame) -> DataFrame:
    """(lang, n_words, ratio) with `corrects`: English, two words at least, a tenth of them unknown."""
    zero = F.lit(0)
    return noisy.withColumn("corrects", F.coalesce(F.col("lang") == "en", F.lit(False)) & (F.coalesce("n_words", zero) >= 2) & (F.coalesce("ratio", F.lit(0.0)) >= 0.1))


def entity_gate(c: Column, lang: Column) -> Column:
    """English and three words at least."""
    return (lang == "en") & (F.size(F.filter(F.split(F.trim(c), r"[ \t\r\n\f]+"), lambda x: x != "")) >= 3)


def name_counts(c: Column, names: Sequence[str]) -> Column:
    """How often words begin with one of some names."""
    return F.size(F.regexp_extract_all(F.lower(c), F.lit("(?:^|[^a-z])(" + "|".join(names) + ")"), 1))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\f]+", " "))


def sentences(c: Column) -> Column:
    """Split after `.`, `!` or `?` and a blank; texts under 5 characters stay whole."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(c, r"([.!?])[ \t\r\n\f]+", "$1\x01"), "\x01"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.length(c) < 5, F.array(c)).otherwise(parts)


def tokens(c: Column) -> Column:
    return F.when(F.length(c) < 2, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}\s])"), 1))


def plan(c: Column) -> Column:
    """Steps that a text needs."""
    return F.array_compact(
        F.array(
            F.when(c.rlike(TAG), "html_strip"),
            F.when(c.rlike("[A-Za-z]"), "language"),
            F.when(c.rlike("[A-Za-z]"), "spelling"),
            F.when(c.rlike("[.!?]"), "sentences"),
            F.lit("tokens"),
            F.when(c.rlike("[A-Z][a-z]+ [A-Z][a-z]+|@"), "entities"),
            F.lit("validation"),
        )
    )


def ordered_plan(p: Column) -> Column:
    """Known steps only, in canonical order; an empty plan is tokens and validation."""
    known = F.filter(F.array(*(F.lit(s) for s in STEPS)), lambda s: F.array_contains(p, s))
    return F.when(F.size(known) > 0, known).otherwise(F.array(F.lit("tokens"), F.lit("validation")))


def words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_col, F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"([a-z]+)"), 1)).alias("word"))


def dictionary(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(word, n): words of at least `least` documents."""
    return words(docs, id_col, text_col).distinct().groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def noise(docs: DataFrame, id_col: str, text_col: str, known: DataFrame) -> DataFrame:
    """(id_col, n_words, n_unknown, ratio): words that the dictionary lacks."""
    each = words(docs, id_col, text_col).groupBy(id_col, "word").agg(F.count("*").alias("k"))
    joined = each.join(known.select("word", F.lit(1).alias("ok")), "word", "left")
    return joined.groupBy(id_col).agg(F.sum("k").alias("n_words"), F.sum(F.when(F.col("ok").isNull(), F.col("k")).otherwise(0)).alias("n_unknown")).withColumn("ratio", F.round(F.col("n_unknown") / F.col("n_words"), 6))


def _deletions(c: Column, most: int = 1) -> Column:
    """The word itself and what is left of it without up to `most` of its letters."""
    if not most:
        return F.array(c)
    one = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    return F.array_distinct(F.concat(F.array(c), F.flatten(F.transform(one, lambda x: _deletions(x, most - 1)))))


def corrections(unknown: DataFrame, known: DataFrame, most: int = 1) -> DataFrame:
    """unknown (word) -> (word, best): of the dictionary words at the least edit distance, up to `most`, the most frequent, through shared deletions."""
    longest = known.agg(F.max(F.length("word")).alias("longest"))
    near = unknown.crossJoin(F.broadcast(longest)).where(F.length("word") <= F.col("longest") + most)  # a longer word is near none; longest is one row
    left = near.select("word", F.explode(_deletions(F.col("word"), most)).alias("key"))
    right = known.select(F.col("word").alias("best"), "n", F.explode(_deletions(F.col("word"), most)).alias("key"))
    pairs = left.join(right, "key").withColumn("d", F.levenshtein("word", "best")).where(F.col("d").between(1, most)).select("word", "best", "n", "d").distinct()
    return pairs.groupBy("word").agg(F.min(F.struct("d", (-F.col("n")).alias("n"), "best")).alias("m")).select("word", F.col("m.best").alias("best"))


def language_profile(docs: DataFrame, text_col: str, lang_col: str, n: int = 3) -> DataFrame:
    """(lang, gram, count) of letter n-grams of words."""
    word = F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"([\p{L}]+)"), 1)).alias("w")
    each = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), word).groupBy("lang", "w").agg(F.count("*").alias("k"))
    padded = each.select("lang", "k", F.concat(F.lit("_"), "w", F.lit("_")).alias("w"))
    grams = padded.select("lang", "k", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("w") - n + 1, F.lit(1))), lambda i: F.substring(F.col("w"), i, F.lit(n)))).alias("gram"))
    return grams.groupBy("lang", "gram").agg(F.sum("k").alias("n"))


def detect_language(docs: DataFrame, id_col: str, text_col: str, profile: DataFrame, n: int = 3) -> DataFrame:
    """(id_col, lang): naive Bayes over the profile's n-grams; a text without 3 characters and a letter is `unknown`.

    Each row is judged by its own text.  Tasks carry a profile of up to CARRIED cells (n-grams by languages) and
    shuffle nothing; texts are joined with a larger one.
    """
    profile = stored(profile, "languages")
    totals = profile.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    totals = stored(totals.select("lang", F.log(F.col("total") + F.col("kinds")).alias("loss")), "language-totals")
    scored = profile.select("lang", "gram", F.log(F.col("n") + 1.0).alias("gain"))
    valid = (F.length(text_col) >= 3) & F.col(text_col).rlike(r"\p{L}")
    if profile.select("gram").distinct().count() * totals.count() <= CARRIED:
        return _detected(docs.select(id_col, F.when(valid, F.regexp_replace(F.lower(text_col), r"[^\p{L}]+", " ")).alias("words")), id_col, scored, totals, n)
    rows = stored(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), valid.alias("_valid")), "texts")
    words = rows.select("_row", F.transform(F.regexp_extract_all(F.lower("_text"), F.lit(r"([\p{L}]+)"), 1), lambda w: F.concat(F.lit("_"), w, F.lit("_"))).alias("ws"))
    at = lambda w: F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1)))
    grams = words.select("_row", F.explode("ws").alias("w")).select("_row", F.explode(F.transform(at(F.col("w")), lambda i: F.substring(F.col("w"), i, F.lit(n)))).alias("gram")).groupBy("_row", "gram").agg(F.count("*").alias("k"))
    gains = grams.join(scored, "gram").groupBy("_row", "lang").agg(F.sum(F.col("k") * F.col("gain")).alias("gain"))
    sizes = words.select("_row", F.aggregate("ws", F.lit(0), lambda acc, w: acc + F.size(at(w))).alias("size"))
    final = gains.join(sizes, "_row").join(F.broadcast(totals), "lang").withColumn("score", F.col("gain") - F.col("size") * F.col("loss"))  # totals: a row a language
    best = final.groupBy("_row").agg(F.max(F.struct("score", "lang")).alias("m")).select("_row", F.col("m.lang").alias("found"))
    return rows.join(best, "_row", "left").select(F.col("_id").alias(id_col), F.when(F.col("_valid"), F.coalesce("found", F.lit("unknown"))).otherwise("unknown").alias("lang"))


class _Words(dict):
    """The place in `sums` of each word met: what its n-grams add to each language, and how many they are."""

    def __init__(self, rows: dict[str, int], gains: np.ndarray, n: int):
        self.rows, self.gains, self.n = rows, gains, n
        self.sums = np.zeros((1024, gains.shape[1] + 1))

    def __missing__(self, word: str) -> int:
        at, padded = len(self), f"_{word}_"
        grams = [padded[i : i + self.n] for i in range(max(1, len(padded) - self.n + 1))]
        if at == len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.sums[at, :-1] = self.gains[[r for g in grams if (r := self.rows.get(g)) is not None]].sum(axis=0)
        self.sums[at, -1] = len(grams)
        self[word] = at
        return at


def _detected(texts: DataFrame, id_col: str, scored: DataFrame, totals: DataFrame, n: int) -> DataFrame:
    """texts (id_col, words: letters in lower case parted by blanks, or null) -> (id_col, lang)."""
    losses = {r["lang"]: r["loss"] for r in totals.collect()}  # a row a language
    langs = sorted(losses)
    cells = scored.toArrow()  # CARRIED at most
    kinds = cells["gram"].combine_chunks().dictionary_encode()
    gains = np.zeros((len(kinds.dictionary), len(langs)))
    place = {lang: i for i, lang in enumerate(langs)}
    gains[kinds.indices.to_numpy(), [place[x] for x in cells["lang"].to_pylist()]] = cells["gain"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast((kinds.dictionary.to_pylist(), gains, np.array([losses[x] for x in langs])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, gains, loss = shared.value
        known = _Words({g: i for i, g in enumerate(grams)}, gains, n)
        for batch in batches:
            out = []
            for text in batch.column(1):
                words = (text.as_py() or "").split()
                if len(known) > WORDS:
                    known.clear()
                places = [known[w] for w in words]
                sums = known.sums[places].sum(axis=0)
                score = np.where(sums[:-1] > 0, sums[:-1] - sums[-1] * loss, -np.inf)  # only languages that share an n-gram
                out.append(langs[np.flatnonzero(score == score.max())[-1]] if sums[:-1].any() else "unknown")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, "lang"])

    return texts.mapInArrow(run, StructType([texts.schema[id_col], StructField("lang", StringType())]))


def validate(records: DataFrame, required: Sequence[str], confidence: str, status: str) -> DataFrame:
    """Records with their errors: missing fields, confidence outside 0 to 1, unknown status."""
    errors = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(f"missing {c}")) for c in required]
    errors.append(F.when(F.col(confidence).isNull() | ~F.col(confidence).between(0, 1), F.lit("bad confidence")))
    errors.append(F.when(~F.coalesce(F.col(status).isin(*STATUSES), F.lit(False)), F.lit("bad status")))
    return records.withColumn("errors", F.array_compact(F.array(*errors))).withColumn("is_valid", F.size("errors") == 0)


def run_plan(records: DataFrame, text_col: str) -> DataFrame:
    """Every record through the steps of its own plan: clean text, sentences, tokens, steps run, errors and status.

    A record without text fails, one without letters or under three characters is partial.
    """
    needs = ordered_plan(plan(F.col(text_col)))
    has = lambda s: F.array_contains(F.col("steps"), s)
    out = records.withColumn("steps", needs)
    out = out.withColumn("clean_text", F.when(has("html_strip"), strip_html(F.col(text_col))).otherwise(F.col(text_col)))
    out = out.withColumn("sentences", F.when(has("sentences"), sentences(F.col("clean_text"))).otherwise(F.array("clean_text")))
    out = out.withColumn("tokens", F.when(has("tokens"), tokens(F.col("clean_text"))).otherwise(F.array().cast("array<string>")))
    blank = F.coalesce(F.trim(text_col) == "", F.lit(True))
    poor = ~F.col(text_col).rlike(r"\p{L}") | (F.length(text_col) < 3)
    out = out.withColumn("errors", F.array_compact(F.array(F.when(blank, "no text"), F.when(~blank & poor, "no language"))))
    return out.withColumn("status", F.when(blank, "failed").when(poor, "partial").otherwise("cleaned"))


def corrected(docs: DataFrame, id_col: str, text_col: str, known: DataFrame, most: int = 2) -> DataFrame:
    """(id_col, text): texts with the words that the dictionary lacks replaced by their corrections, if they have any; all else stays."""
    pieces = docs.select(id_col, F.posexplode(F.regexp_extract_all(text_col, F.lit("([A-Za-z]+|[^A-Za-z]+)"), 1)).alias("pos", "piece")).withColumn("word", F.lower("piece"))
    unknown = pieces.where(F.col("word").rlike("^[a-z]")).select("word").distinct().join(known, "word", "left_anti")
    fixed = pieces.join(stored(corrections(unknown, known, most), "corrections"), "word", "left")
    best = F.when(F.col("piece").rlike("^[A-Z]"), F.initcap("best")).otherwise(F.col("best"))
    return fixed.groupBy(id_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce(best, "piece").alias("p")))), lambda x: x["p"]), "").alias("text"))  # a text's own pieces


#: What each step of a plan leaves, in canonical order.
LEAVES = {"html_strip": "clean_text", "language": "language", "spelling": "clean_text", "sentences": "sentences", "tokens": "tokens", "entities": "entities", "validation": "is_valid"}


def run_chain(records: DataFrame, text_col: str, known: DataFrame, profile: DataFrame, model: Model) -> DataFrame:
    """Every record through all the steps of its own plan; steps that need tables are joins by the record's number.

    known: the dictionary (word, n), profile: of languages, model: of sentences.  Besides the records' own columns:
    clean_text, language, sentences, tokens, entities, confidence, steps (planned), steps_run, errors, status and
    is_valid.  Spelling runs on English of which a tenth is unknown, entities on English of three words; a step
    that doesn't apply isn't run, one that finds nothing to work on is an error of the record and of no other.
    A record without text fails, one with errors is partial.
    """
    has = lambda s: F.array_contains("steps", s)
    known = stored(known.select("word", "n"), "dictionary")  # several steps read it
    rows = records.withColumn("_rec", F.monotonically_increasing_id()).withColumn("steps", ordered_plan(plan(F.coalesce(F.col(text_col), F.lit("")))))
    rows = stored(rows.withColumn("clean_text", F.when(has("html_strip"), strip_html(F.col(text_col))).otherwise(F.col(text_col))), "chain")
    langs = detect_language(rows.where(has("language")).select("_rec", "clean_text"), "_rec", "clean_text", profile)
    rows = stored(rows.join(langs.withColumnRenamed("lang", "language"), "_rec", "left").withColumn("language", F.coalesce("language", F.lit("unknown"))), "chain-language")
    english = rows.where(has("spelling") & (F.col("language") == "en")).select("_rec", "clean_text", F.col("language").alias("lang"))
    gated = english.join(spell_gate(noise(english, "_rec", "clean_text", known).withColumn("lang", F.lit("en"))).where("corrects").select("_rec"), "_rec", "left_semi")
    spelled = stored(corrected(gated, "_rec", "clean_text", known), "chain-spelling")
    rows = rows.join(spelled.select("_rec", F.col("text").alias("_spelled")), "_rec", "left").withColumn("_corrected", F.col("_spelled").isNotNull()).withColumn("clean_text", F.coalesce("_spelled", "clean_text"))
    rows = split(rows, "clean_text", model, "_sentences").withColumn("sentences", F.when(has("sentences"), F.col("_sentences")).otherwise(F.array("clean_text")))
    rows = rows.withColumn("tokens", F.when(has("tokens"), tokens(F.col("clean_text"))).otherwise(F.array().cast("array<string>")))
    found = has("entities") & F.coalesce(entity_gate(F.col("clean_text"), F.col("language")), F.lit(False))
    spans = F.transform(pii.resolve(pii.detect(F.when(found, F.col("clean_text")).otherwise(F.lit("")))), lambda s: F.concat(s["entity"], F.lit(":"), s["value"]))
    rows = rows.withColumn("entities", spans).withColumn("confidence", F.coalesce(html_confidence(F.col(text_col)), F.lit(0.0)))
    blank = F.coalesce(F.trim(text_col) == "", F.lit(True))
    errors = F.array_compact(F.array(F.when(blank, "no text"), F.when(~blank & (F.col("language") == "unknown"), "no language"), F.when(~blank & has("tokens") & (F.size("tokens") == 0), "no tokens")))
    status = F.when(blank, "failed").when(F.size("_errors") > 0, "partial").otherwise("cleaned")
    rows = rows.withColumn("_errors", errors).withColumn("status", status)
    checked = validate(rows, ("clean_text",), "confidence", "status").withColumn("errors", F.when(has("validation"), F.array_union("_errors", "errors")).otherwise(F.col("_errors")))
    ran = F.filter("steps", lambda s: F.when(s == "spelling", F.col("_corrected")).when(s == "entities", found).otherwise(F.lit(True)))
    return checked.withColumn("steps_run", ran).select(*records.columns, "clean_text", "language", "sentences", "tokens", "entities", "confidence", "steps", "steps_run", "errors", "status", "is_valid")


def chunks(docs: DataFrame, id_col: str, text_col: str, most: int = 800, overlap: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """(chunk_id, id_col, chunk_no, chunk, kept columns): sentences packed in order up to `most` characters; with `overlap`, a chunk begins with the end of the last.

    A longer sentence is a chunk of its own.
    """
    shape = "struct<cur:string,out:array<string>>"
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out")).cast(shape)

    def step(acc: Column, s: Column) -> Column:
        joined = F.when(acc["cur"] == "", s).otherwise(F.concat_ws(" ", acc["cur"], s))
        fits = F.length(joined) <= most
        fresh = F.concat_ws(" ", F.right(acc["cur"], F.lit(overlap)), s) if overlap else s
        full = F.struct(fresh.alias("cur"), F.when(acc["cur"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["cur"])).alias("out")).cast(shape)
        return F.when(fits, F.struct(joined.alias("cur"), acc["out"].alias("out")).cast(shape)).otherwise(full)

    packed = F.aggregate(sentences(collapse(F.col(text_col))), start, step, lambda acc: F.when(acc["cur"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["cur"])))
    return docs.select(id_col, *keep, F.posexplode(packed).alias("chunk_no", "chunk")).select(F.concat_ws("_", id_col, "chunk_no").alias("chunk_id"), id_col, "chunk_no", "chunk", *keep)
