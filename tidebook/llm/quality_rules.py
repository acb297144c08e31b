"""Quality rules with adaptive thresholds (native DataFrame operations only).

Each document's measures are computed inside its own row. Thresholds are not
fixed: for each (language, source) they come from quantile sketches of the
measures, and the documents are filtered by a join with those thresholds.

The sketch is a log-linear histogram over integers (16 buckets to each power of
two, so a quantile is off by 1/16 of its value at most). It is a plain table of
counts: merging is adding, which makes it exact under any order, partitioning
or retry, and lets small groups borrow the merged sketch of their language, or
of the whole table, without reading a document again.

The threshold is where the tail of a group's own distribution begins: going up
from the third quartile, the first value c with a valley above it, a stretch
from c to 2c + w that holds fewer than one document in TAIL; documents beyond
the valley go. w is what EVENTS more signs make in the group's median document,
so the rule follows the length of a source's texts as well as their spread, and
a group whose values thin out evenly loses the last of them only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import get_field, stored, table, words_of

#: Measures under thresholds, as whole numbers per thousand of what a text has in all.
MEASURES = {"symbols_pm": "n_words", "marks_pm": "n_words", "repeats_pm": "n_words", "dup_lines_pm": "n_lines", "upper_pm": "word_chars"}
#: A valley holds fewer than one document in so many, and is wider than so many signs in the median document.
TAIL, EVENTS = 500, 8
#: A group with fewer documents takes the sketch of its language, then of all.
LEAST_GROUP = 100
#: The thresholds are dealt over so many copies, so that a hot source has as many join keys.
SALTS = 16
LOWER_BITS = 4


def measured(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """One row per document with its base measures and rule measures.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words: as the names say,
    over whole texts; a null text is an empty one. Windows of three words are
    compared by a 64-bit hash.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    first = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
        text.alias("text"),
    ).select(
        "doc_id", "lang", "source",
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", "!?", ""))).cast("long").alias("n_marks"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        lines.alias("lines"),
        words_of(F.col("text")).alias("w"),
    )
    hashed = first.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols", "n_marks", "n_upper",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") < 3, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
        .alias("h"),
    )
    # Only texts with a window found twice need positions; sort those by (hash, position).
    pairs = hashed.withColumn(
        "q",
        F.when(F.size("h") > F.size(F.array_distinct("h")), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    ).drop("h")
    twice = F.filter("q", lambda x, k: (F.get(F.col("q"), k - 1)["h"] == x["h"]) | (F.get(F.col("q"), k + 1)["h"] == x["h"]))
    spots = pairs.withColumn("p", F.when(F.size("q") > 0, F.sort_array(get_field(twice, "i"))).otherwise(F.array().cast("array<int>"))).drop("q")
    # A window covers three words, or as many as there are before the next window starts.
    cover = F.aggregate(F.transform("p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get(F.col("p"), k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    done = spots.withColumn("n_repeat_words", cover).drop("p")
    per_mille = lambda n, d: F.floor(1000 * F.col(n) / F.greatest(F.col(d), F.lit(1))).cast("long")
    return done.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_lines", "n_symbols", "n_dup_lines", "n_repeat_words",
        per_mille("n_symbols", "n_words").alias("symbols_pm"),
        per_mille("n_marks", "n_words").alias("marks_pm"),
        per_mille("n_repeat_words", "n_words").alias("repeats_pm"),
        per_mille("n_dup_lines", "n_lines").alias("dup_lines_pm"),
        per_mille("n_upper", "word_chars").alias("upper_pm"),
    )


def bucket_low(v):
    """Column: least value of the sketch bucket of the whole number `v` >= 0."""
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(v)) - (LOWER_BITS + 1), F.lit(0))).cast("long")
    return v - v % step


def sketches(features: DataFrame) -> DataFrame:
    """The sketch table: lang, source, measure, low (bucket), n. Mergeable by adding n."""
    long = features.select(
        "lang", "source",
        F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in (*MEASURES, *sorted(set(MEASURES.values())))])).alias("m"),
    ).select("lang", "source", "m.measure", bucket_low(F.col("m.v")).alias("low"))
    return long.groupBy("lang", "source", "measure", "low").agg(F.count(F.lit(1)).alias("n"))


def cuts(sketch: DataFrame, keys: list[str], tail=TAIL, events=EVENTS) -> DataFrame:
    """Per group of `keys`: docs, and a column cut_<measure> for each measure."""
    merged = sketch.groupBy(*keys, "measure", "low").agg(F.sum("n").alias("n"))
    # buckets of a sketch are a few hundred at most
    lists = merged.groupBy(*keys, "measure").agg(F.sort_array(F.collect_list(F.struct("low", "n"))).alias("b"), F.sum("n").alias("docs"))
    group = lists.groupBy(*keys).agg(F.max("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("measure", "b"))).alias("of"))

    def quantile(b, num, den):
        """Least low whose cumulative count reaches the share num / den."""
        step = lambda a, x: F.struct((a["c"] + x["n"]).alias("c"), F.when(a["c"] * den < F.col("docs") * num, x["low"]).otherwise(a["low"]).alias("low"))
        return F.aggregate(b, F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("low")), step, lambda a: a["low"])

    parts = group.select(*keys, "docs", "of", F.lit(1000 * events).cast("long").alias("_e"), *[quantile(F.col("of")[m], 3, 4).alias(f"q_{m}") for m in MEASURES], *[quantile(F.col("of")[x], 1, 2).alias(f"mid_{x}") for x in sorted(set(MEASURES.values()))])
    wide = parts.select("*", *[F.expr(f"_e div greatest(mid_{x}, 1L)").alias(f"w_{m}") for m, x in MEASURES.items()])

    def cut(m):
        b, w = F.col("of")[m], F.col(f"w_{m}")
        held = lambda c: F.aggregate(F.filter(b, lambda y: (y["low"] > c["low"]) & (y["low"] <= 2 * c["low"] + w)), F.lit(0).cast("long"), lambda a, y: a + y["n"])
        begins = F.filter(b, lambda c: (c["low"] >= F.col(f"q_{m}")) & (held(c) * tail < F.col("docs")))  # not empty: nothing is above the last bucket
        return 2 * F.get(begins, F.lit(0))["low"] + w

    return wide.select(*keys, "docs", *[cut(m).alias(f"cut_{m}") for m in MEASURES])


def thresholds(features: DataFrame, least_group=LEAST_GROUP, tail=TAIL, events=EVENTS) -> DataFrame:
    """lang, source and one column max_<measure> for each measure; one row per (lang, source)."""
    sketch = stored(sketches(features), "quality-sketch")
    level = lambda keys, short: cuts(sketch, keys, tail, events).select(*keys, F.col("docs").alias(f"{short}_docs"), *[F.col(f"cut_{m}").alias(f"{short}_{m}") for m in MEASURES])
    own, by_lang, whole = level(["lang", "source"], "o").withColumn("_k", F.lit(0)), level(["lang"], "l"), level([], "a").withColumn("_k", F.lit(0))
    joined = own.alias("o").join(by_lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang"))).join(whole.alias("a"), F.col("o._k") == F.col("a._k"))  # one row
    pick = lambda m: F.when(F.col("o_docs") >= least_group, F.col(f"o_{m}")).when(F.col("l_docs") >= least_group, F.col(f"l_{m}")).otherwise(F.col(f"a_{m}"))
    return joined.select(F.col("o.lang").alias("lang"), F.col("o.source").alias("source"), *[pick(m).alias(f"max_{m}") for m in MEASURES])


def quality_rules(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source", least_group=LEAST_GROUP, tail=TAIL, events=EVENTS) -> DataFrame:
    """One row per row of `docs`: doc_id, base measures, base_failed, kept, and the
    measures and thresholds behind the verdict.

    Null or empty text: no words, base_failed. Null language or source: groups of
    their own. Repeated rows: one result each. Empty table: empty result.
    """
    f = stored(measured(docs, id_col, text_col, lang_col, source_col), "quality-features")
    limits = thresholds(f, least_group, tail, events)
    # The join key is salted: a source with a third of all rows has SALTS keys.
    salted = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = f.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    cond = F.col("f.lang").eqNullSafe(F.col("c.lang")) & F.col("f.source").eqNullSafe(F.col("c.source")) & (F.col("f.salt") == F.col("c.salt"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    passes = F.lit(True)
    for m in MEASURES:
        passes = passes & (F.col(m) <= F.col(f"max_{m}"))
    return rows.alias("f").join(salted.alias("c"), cond).select(
        "f.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & passes).alias("kept"),
        *MEASURES, *[f"max_{m}" for m in MEASURES],
    )


def op1(spark, sf_dir: str) -> DataFrame:
    """All documents with their base measures, verdict and the thresholds behind it."""
    return quality_rules(table(spark, sf_dir, "documents"))
