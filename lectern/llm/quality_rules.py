"""Quality rules whose cutoffs adapt to each language and source.

Every document gets counts of words, symbols, repeated lines and repeated three-word windows. The ratios of
those counts go into mergeable sketches: log-linear histograms of integers (eight steps to a power of two), whose
bucket counts simply add up, per language and source. A ratio is rejected if it lies more than FENCE spreads beyond the
quartiles of its group. The spread is read off the sketch: the wider of the distance of the quartiles and that of the
outer fifths (scaled to agree with it for a normal law), and no finer than the sketch resolves, one bucket. It is never
finer than the document itself resolves either: what one symbol, mark, line or long word more changes in its ratio.
Groups with few documents use the merged sketch of their language, or of all documents.

Defined cases: a null or empty text has no words and fails the base rule; null lang or source form groups of
their own; ties and repeated rows count each; an empty table gives an empty result; other columns, whatever their
names, are kept by `keep_good` and ignored elsewhere. A very long text is counted whole; its words are held as one
array, at about 60 bytes of memory a word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import forget, keep, let, spare

WORD_BREAK = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS, MARKS = "[#*$%&|<>]", r"[!?{}\[\]=~^\\]"
NONE = "(none)"
ALL = "(all)"
#: Ratios judged: parts of the unit that one event adds (divided by the document's size), the size, and whether low
#: values are rejected too. The mean word length is in hundredths; its event is a word of forty characters more.
RATIOS = {
    "symbols": (1000, "word_chars", False),
    "marks": (1000, "n_words", False),
    "dup_lines": (1000, "n_lines", False),
    "word_length": (4000, "n_words", True),
}
#: A fence lies this many spreads beyond the quartile.
FENCE = 3
#: Distance of the quartiles of a normal law over that of its outer fifths, in thousandths.
FIFTHS = 801
#: Groups with fewer documents borrow the sketch of their language, then of all.
GROUP_MIN = 40
#: More groups than this are joined by shuffle instead of broadcast.
BROADCAST_GROUPS = 100_000


def _repeated(hashes: Column, n: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        spans = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(spans, F.lit(0), lambda a, x: a + x)

    return F.when(n < 4, F.lit(0)).otherwise(let(ordered, lambda s: let(starts(s), covered)))


def counts(docs: DataFrame, into: str = "_q") -> DataFrame:
    """docs with a struct column of counts, ratios and the base verdict."""
    body = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(body, WORD_BREAK), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def number_of(chars: str) -> Column:
        return F.size(F.regexp_extract_all(body, F.lit(chars), F.lit(0))).cast("long")

    solid = reduce(lambda x, c: F.replace(x, F.lit(c), F.lit("")), SPACES, body)
    windows = lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    measured = F.struct(
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(windows(w), F.size(w)).cast("long").alias("r"))).alias("w"),
        F.length(solid).cast("long").alias("word_chars"),
        number_of(SYMBOLS).alias("n_symbols"),
        number_of(MARKS).alias("n_marks"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("l"),
    )

    def row(m: Column) -> Column:
        n, r, chars = m["w"]["n"], m["w"]["r"], m["word_chars"]
        share = lambda a, b: F.when(b > 0, F.floor(1000 * a / b)).otherwise(F.lit(0)).cast("long")
        return F.struct(
            n.alias("n_words"), chars.alias("word_chars"), m["l"]["n"].alias("n_lines"), m["n_symbols"].alias("n_symbols"), m["l"]["d"].alias("n_dup_lines"), r.alias("n_repeat_words"),
            ((n < 50) | (100 * r > 50 * n)).alias("base_failed"),
            F.struct(
                share(m["n_symbols"], chars).alias("symbols"), share(m["n_marks"], n).alias("marks"),
                share(m["l"]["d"], m["l"]["n"]).alias("dup_lines"), F.when(n > 0, F.floor(100 * chars / n)).otherwise(F.lit(0)).cast("long").alias("word_length"),
            ).alias("ratios"),
        )

    return docs.withColumn(into, let(measured, row))


def bucket(v: Column) -> Column:
    """Index of a non-negative integer in the log-linear histogram: exact below 16, then eight steps to a power of two."""
    shift = F.greatest(F.length(F.bin(v)) - 4, F.lit(0))
    return (shift * 8 + F.floor(v / F.pow(F.lit(2.0), shift))).cast("int")


def floor_of(b: Column) -> Column:
    """The smallest integer of a bucket."""
    shift = F.greatest(F.floor(b / 8) - 1, F.lit(0))
    return ((b - shift * 8) * F.pow(F.lit(2.0), shift)).cast("long")


def group_key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(NONE))


def sketch(counted: DataFrame, at: str = "_q") -> DataFrame:
    """Histogram rows (lang, source, ratio, bucket, n) of documents that pass the base rule: sketches merge by adding n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), bucket(F.col(f"{at}.ratios.{k}")).alias("bucket")) for k in RATIOS]))
    passes = F.when(F.col(f"{at}.base_failed"), 0).otherwise(1)  # counted, as a filter would be pushed down and take the counts again
    every = counted.select(group_key("lang").alias("lang"), group_key("source").alias("source"), passes.alias("p"), pairs.alias("x"))
    return every.groupBy("lang", "source", "x.ratio", "x.bucket").agg(F.sum("p").alias("n")).where("n > 0")


def merge(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of coarser groups: the counts of equal buckets added."""
    return sketches.groupBy(*by, "ratio", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame) -> DataFrame:
    """One row per lang and source, with the quartiles q1 and q3 and the spread of each ratio."""
    sketches = keep(sketches, "sketches")
    levels = sketches.select("lang", "source", "ratio", "bucket", "n").unionByName(
        merge(sketches, "lang").withColumn("source", F.lit(ALL))
    ).unionByName(merge(sketches).withColumn("lang", F.lit(ALL)).withColumn("source", F.lit(ALL)))
    w = Window.partitionBy("lang", "source", "ratio")
    running = levels.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
    twentieth = lambda k: F.min(F.when(20 * F.col("upto") >= k * F.col("all"), F.col("bucket")))
    at = running.groupBy("lang", "source", "ratio").agg(*[twentieth(k).alias(f"b{k}") for k in (4, 5, 15, 16)], F.max("all").alias("docs"))
    low, q1, q3, high = (floor_of(F.col(f"b{k}")) for k in (4, 5, 15, 16))
    spread = F.greatest(q3 - q1, F.floor((high - low) * FIFTHS / 1000), floor_of(F.col("b15") + 1) - q3)
    stats = at.select("lang", "source", "ratio", "docs", q1.alias("q1"), q3.alias("q3"), spread.cast("long").alias("spread"))
    wide = stats.groupBy("lang", "source").agg(F.max("docs").alias("docs"), *[F.max(F.when(F.col("ratio") == k, F.col(v))).alias(f"{k}_{v}") for k in RATIOS for v in ("q1", "q3", "spread")])
    values = wide.columns[3:]
    wide = keep(wide, "fences")
    own = wide.where((F.col("source") != ALL) & (F.col("lang") != ALL))
    of_lang = wide.where((F.col("source") == ALL) & (F.col("lang") != ALL)).select("lang", F.struct("docs", *values).alias("l"))
    of_all = wide.where((F.col("source") == ALL) & (F.col("lang") == ALL)).first()  # one row
    joined = own.join(of_lang, "lang", "left")
    overall = lambda v: F.lit(of_all[v] if of_all else None).cast("long")
    pick = lambda v: F.when(F.col("docs") >= GROUP_MIN, F.col(v)).when(F.col("l.docs") >= GROUP_MIN, F.col(f"l.{v}")).otherwise(overall(v))
    done = keep(joined.select("lang", "source", *[pick(v).alias(v) for v in values]), "limits")
    forget(sketches, wide)
    return done


def judge(counted: DataFrame, limits: DataFrame, at: str, into: str) -> DataFrame:
    """counted with a boolean column: the base rule and every fence of the document's group hold."""
    named = spare(counted, *limits.columns)
    mine = dict(zip(limits.columns, named, strict=True))
    held = limits.toDF(*named)
    if limits.count() <= BROADCAST_GROUPS:
        held = F.broadcast(held)
    joined = counted.join(held, (group_key("lang") == F.col(mine["lang"])) & (group_key("source") == F.col(mine["source"])), "left")
    # One sum that needs both sides and is never null: conditions on the counts alone would be pushed below the join and
    # take them again.
    faults = F.col(f"{at}.base_failed").cast("int")
    for k, (event, size, both) in RATIOS.items():
        value, q1, q3 = F.col(f"{at}.ratios.{k}"), F.coalesce(F.col(mine[f"{k}_q1"]), F.lit(0)), F.coalesce(F.col(mine[f"{k}_q3"]), F.lit(2**40))
        step = F.greatest(F.coalesce(F.col(mine[f"{k}_spread"]), F.lit(2**40)), F.ceil(F.lit(event) / F.greatest(F.col(f"{at}.{size}"), F.lit(1))))
        faults = faults + (value > q3 + FENCE * step).cast("int")
        if both:
            faults = faults + (value < q1 - FENCE * step).cast("int")
    return joined.withColumn(into, F.coalesce(faults, F.lit(1)) == 0).drop(*named)


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and the verdict of every document."""
    measured = keep(counts(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality-counts")
    judged = judge(measured, fences(sketch(measured)), "_q", "kept")
    return judged.select("doc_id", *[f"_q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns. Counts are taken twice rather than shuffling every text."""
    limits = fences(sketch(counts(docs.select("text", "lang", "source"))))
    at, into = spare(docs, "q", "kept")
    return judge(counts(docs, at), limits, at, into).where(F.col(into)).select(*docs.columns)
