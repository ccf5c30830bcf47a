"""Repairs that only ever use words the same document contains often enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .blocks import match_case

# Thresholds of evidence.
CANONICAL, FRAGMENT, OBSERVED, RATIO, COMMON_LETTER, STRAY = 8, 5, 1, 100, 100, 2
CONFUSION_MIN = 6
CONFUSIONS = (("rn", "m"), ("vv", "w"))
GLYPHS = {"0": "OÖD", "1": "Iİ", "2": "Z", "3": "B", "4": "A", "5": "SŞ", "6": "GĞŞB", "7": "T", "8": "B", "9": "GŞ", "!": "Iİ", "|": "Iİ", "«": "H"}
GLYPHS_MOST, SEEN_TWICE, WORD_EDGE = 3, 2, ",.;:!?()\"“”‘’'«»"


def vocabulary(docs: DataFrame) -> DataFrame:
    """doc_id, word (folded), freq: the words of each document as they stand before any repair."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(T.sentinel_free(F.col("text")), F.lit(f"{T.LETTER}+"), F.lit(0))).alias("w"))
    return found.select("doc_id", T.fold(F.col("w")).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("freq"))


def most_frequent(vocab: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.desc("freq"), "word")
    return vocab.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def attested(vocab: DataFrame, least: int = CANONICAL) -> DataFrame:
    """Per document and key without diacritics: how many established spellings, and the most frequent one."""
    known = vocab.where(F.col("freq") >= least).withColumn("key", T.diacritic_key(F.col("word")))
    return known.groupBy("doc_id", "key").agg(F.count("*").alias("spellings"), F.max(F.struct("freq", "word")).alias("best"))


def diacritic_candidates(vocab: DataFrame, least: int = CANONICAL, ratio: int = RATIO, observed: int = OBSERVED) -> DataFrame:
    """Rare words that an established spelling with more marks explains, with the decision and its reason."""
    rare = vocab.where(F.col("freq") < least).withColumn("key", T.diacritic_key(F.col("word")))
    pair = rare.join(attested(vocab, least), ["doc_id", "key"]).where(F.col("word") != F.col("best.word"))
    gains = T.marked_letters(F.col("best.word")) > T.marked_letters(F.col("word"))
    reason = F.when(F.col("spellings") > 1, "several spellings").when(~gains, "would lose a mark").when(F.col("freq") > observed, "used more than once").when(F.col("best.freq") < ratio * F.col("freq"), "not frequent enough").otherwise("accepted")
    return pair.select("doc_id", "word", "freq", F.col("best.word").alias("candidate"), F.col("best.freq").alias("candidate_freq"), reason.alias("decision"))


def confusions(word: Column) -> Column:
    """Words that one misread pair of letters, not at the start, would turn into this one."""

    def variants(seen: str, meant: str) -> Column:
        places = F.filter(F.sequence(F.lit(2), F.greatest(F.length(word), F.lit(2))), lambda p: F.substring(word, p, F.lit(len(seen))) == seen)
        return F.transform(places, lambda p: F.overlay(word, F.lit(meant), p, F.lit(len(seen))))

    return F.concat(*[variants(*pair) for pair in CONFUSIONS])


def glyph_repairs(vocab: DataFrame, least: int = CANONICAL, most: int = 2) -> DataFrame:
    """Rare long words with the most frequent established word that a misread glyph explains."""
    rare = vocab.where((F.length("word") >= CONFUSION_MIN) & (F.col("freq") <= most) & (F.col("freq") < least))
    options = rare.select("doc_id", "word", "freq", F.explode(confusions(F.col("word"))).alias("candidate"))
    known = vocab.where(F.col("freq") >= least).select("doc_id", F.col("word").alias("candidate"), F.col("freq").alias("candidate_freq"))
    best = options.join(known, ["doc_id", "candidate"]).groupBy("doc_id", "word", "freq").agg(F.max(F.struct("candidate_freq", "candidate")).alias("b"))
    sure = F.least(F.lit(0.99), 0.80 + F.least(F.col("b.candidate_freq"), F.lit(200)) / 1000.0)
    return best.select("doc_id", "word", "freq", F.col("b.candidate").alias("candidate"), F.col("b.candidate_freq").alias("candidate_freq"), F.bround(sure, 6).alias("confidence"))


def adjacent_words(rows: DataFrame, longest: int = 10**6) -> DataFrame:
    """doc_id, i, pos, left, right: letter words of a line that one space separates, the shorter of at most `longest`
    letters. Neighbours are met inside the line's array, so no token is moved."""
    split = rows.select("doc_id", "i", F.split("line", " ").alias("parts"))

    def pair(token: Column, pos: Column) -> Column:
        following = F.coalesce(F.get(F.col("parts"), pos + 1), F.lit(""))
        return F.struct(pos.cast("long").alias("pos"), F.regexp_extract(token, f"({T.LETTER}+)$", 1).alias("left"), F.regexp_extract(following, f"^({T.LETTER}+)", 1).alias("right"))

    near = F.filter(F.transform("parts", pair), lambda x: (x["left"] != "") & (x["right"] != "") & (F.least(F.length(x["left"]), F.length(x["right"])) <= longest))
    return split.select("doc_id", "i", F.explode(near).alias("x")).select("doc_id", "i", "x.pos", "x.left", "x.right")


def split_candidates(rows: DataFrame, vocab: DataFrame, least: int = CANONICAL) -> DataFrame:
    """Pairs of words that together are an established word, one half being a letter or two: accepted, or refused and why."""
    pairs = adjacent_words(rows, STRAY)
    pairs = pairs.withColumn("joined", T.fold(F.concat("left", "right")))
    freq = lambda name: vocab.select("doc_id", F.col("word").alias(f"{name}_key"), F.col("freq").alias(f"{name}_freq"))
    known = pairs.withColumn("joined_key", F.col("joined")).join(freq("joined").where(F.col("joined_freq") >= least), ["doc_id", "joined_key"])
    known = known.withColumn("left_key", T.fold(F.col("left"))).withColumn("right_key", T.fold(F.col("right"))).join(freq("left"), ["doc_id", "left_key"], "left").join(freq("right"), ["doc_id", "right_key"], "left")
    lf, rf = F.coalesce("left_freq", F.lit(0)), F.coalesce("right_freq", F.lit(0))
    word_alone = ((F.length("left") == 1) & (lf >= COMMON_LETTER)) | ((F.length("right") == 1) & (rf >= COMMON_LETTER))
    decision = F.when(word_alone, "a common one-letter word").when((lf > FRAGMENT) & (rf > FRAGMENT), "both are words").otherwise("accepted")
    sure = F.when(decision == "accepted", F.least(F.lit(0.97), 0.78 + F.least(F.col("joined_freq"), F.lit(200)) / 1000.0)).otherwise(F.lit(0.4))
    return known.select("doc_id", "i", "pos", "left", "right", "joined", "joined_freq", decision.alias("decision"), F.bround(sure, 6).alias("confidence"))


def split_applied(candidates: DataFrame) -> DataFrame:
    """Accepted joins taken from the left: a word is used once, so of a chain of overlapping pairs every other one stands."""
    accepted = candidates.where(F.col("decision") == "accepted")
    w = Window.partitionBy("doc_id", "i").orderBy("pos")
    starts = F.when(F.col("pos") - F.lag("pos", 1, -2).over(w) > 1, 1).otherwise(0)
    chained = accepted.withColumn("fresh", starts).withColumn("chain", F.sum("fresh").over(w))
    place = F.row_number().over(Window.partitionBy("doc_id", "i", "chain").orderBy("pos"))
    return chained.withColumn("place", place).where(F.col("place") % 2 == 1).drop("fresh", "chain", "place")


def hygiene_log(rows: DataFrame) -> DataFrame:
    """doc_id, i, original, corrected of every line that the deterministic repairs change."""
    fixed = rows.select("doc_id", "i", F.col("line").alias("original"), T.hygiene(F.col("line")).alias("corrected"))
    return fixed.where("original <> corrected")


def hygiene_changes(rows: DataFrame) -> DataFrame:
    """doc_id, i, kind, grade, original, corrected, reason, confidence: every step of hygiene that changes a line."""
    at = rows.where(T.hygiene(F.col("line")) != F.col("line")).select("doc_id", "i", F.col("line").alias("t0"))
    for n, (_, _, step) in enumerate(T.HYGIENE):
        at = at.withColumn(f"t{n + 1}", step(F.col(f"t{n}")))

    def entry(n: int, kind: str, reason: str) -> Column:
        return F.when(F.col(f"t{n}") != F.col(f"t{n + 1}"), _entry(F.lit(kind), F.lit("safe"), F.col(f"t{n}"), F.col(f"t{n + 1}"), F.lit(reason), F.lit(1.0)))

    steps = F.array_compact(F.array(*[entry(n, kind, reason) for n, (kind, reason, _) in enumerate(T.HYGIENE)]))
    return at.select("doc_id", "i", F.explode(steps).alias("e")).select("doc_id", "i", "e.*")


def _entry(kind: Column, grade: Column, original: Column, corrected: Column, reason: Column, confidence: Column) -> Column:
    return F.struct(kind.alias("kind"), grade.alias("grade"), original.alias("original"), corrected.alias("corrected"), reason.alias("reason"), F.bround(confidence, 6).alias("confidence"))


def word_repairs(vocab: DataFrame) -> DataFrame:
    """doc_id, word, candidate, grade, reason, confidence: what a rare word of three letters or more stands for.

    Lost marks come before misread glyphs; a refused mark is reported unless a glyph repair holds.
    """
    rare = (F.length("word") >= 3) & (F.col("freq") <= 2)
    marks = diacritic_candidates(vocab).where(rare)
    taken = F.col("decision") == "accepted"
    sure = F.when(taken, F.least(F.lit(0.99), 0.90 + F.least(F.col("candidate_freq"), F.lit(500)) / 5000.0)).otherwise(F.lit(0.45))
    marks = marks.select("doc_id", "word", "candidate", F.when(taken, "confident").otherwise("uncertain").alias("grade"), F.when(taken, "lost mark").otherwise(F.col("decision")).alias("reason"), sure.alias("confidence"), F.when(taken, 0).otherwise(2).alias("turn"))
    glyphs = glyph_repairs(vocab).select("doc_id", "word", "candidate", F.lit("confident").alias("grade"), F.lit("misread glyph").alias("reason"), "confidence", F.lit(1).alias("turn"))
    first = F.min_by(F.struct("candidate", "grade", "reason", F.bround("confidence", 6).alias("confidence")), "turn")
    return marks.union(glyphs).groupBy("doc_id", "word").agg(first.alias("r")).select("doc_id", "word", "r.*")


def repaired(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, i, text), and a log of every change made and every one refused.

    Every line goes through hygiene, word repairs and rejoined splits in turn; the evidence is the vocabulary of the
    documents as they came. Log: doc_id, i, kind, grade (safe, confident, uncertain: refused), original, corrected,
    reason, confidence. Null texts have no lines; a document's repairs meet its lines as one map, which holds its rare
    words with a likely reading only.
    """
    vocab = vocabulary(docs)
    parts = F.split("text", "\n")
    rows = docs.where("text is not null").select("doc_id", F.posexplode(parts).alias("i", "line")).withColumn("i", F.col("i").cast("long"))
    value = F.struct("candidate", "grade", "reason", "confidence")
    maps = word_repairs(vocab).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", value.alias("r")))).alias("repairs"))
    clean = rows.select("doc_id", "i", T.hygiene(F.col("line")).alias("line")).join(maps, "doc_id", "left")
    tokens = F.regexp_extract_all("line", F.lit(rf"{T.LETTER}+|[^{T.LETTER[1:]}+"), F.lit(0))
    reading = lambda t: F.try_element_at("repairs", T.fold(t))
    word = F.transform(tokens, lambda t: F.when(reading(t)["grade"] == "confident", match_case(reading(t)["candidate"], t)).otherwise(t))
    spelled = clean.select("doc_id", "i", F.when(F.col("repairs").isNull(), F.col("line")).otherwise(F.array_join(word, "")).alias("line"))
    seen = F.filter(tokens, lambda t: reading(t).isNotNull())
    entry = F.transform(seen, lambda t: _entry(F.lit("ocr_character"), reading(t)["grade"], t, match_case(reading(t)["candidate"], t), reading(t)["reason"], reading(t)["confidence"]))
    words = clean.where("repairs is not null").select("doc_id", "i", F.explode(entry).alias("e")).select("doc_id", "i", "e.*")
    judged = split_candidates(spelled, vocab)
    joins = split_applied(judged)
    shut = joins.groupBy("doc_id", "i").agg(F.collect_set("pos").alias("shut"))
    pieces = F.split("line", " ")
    gap = lambda n: F.when((n + 1 == F.size(pieces)) | F.array_contains("shut", n.cast("long")), "").otherwise(" ")
    whole = F.array_join(F.transform(pieces, lambda p, n: F.concat(p, gap(n))), "")
    texts = spelled.join(shut, ["doc_id", "i"], "left").select("doc_id", "i", F.when(F.col("shut").isNull(), F.col("line")).otherwise(whole).alias("text"))
    refused = judged.where("decision = 'both are words'")
    splits = joins.withColumn("grade", F.lit("confident")).union(refused.withColumn("grade", F.lit("uncertain")))
    splits = splits.select("doc_id", "i", _entry(F.lit("word_split"), F.col("grade"), F.concat_ws(" ", "left", "right"), F.concat("left", "right"), F.when(F.col("grade") == "confident", "split word").otherwise(F.col("decision")), F.col("confidence")).alias("e")).select("doc_id", "i", "e.*")
    return texts, hygiene_changes(rows).union(words).union(splits)


def reread_titles(titles: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc_id, seq, text, corrected, words: titles whose misread glyphs give way to words the document has elsewhere.

    A word with one to three digits or marks of the table is read in every way the table allows, in the order of the
    table; of the readings used twice or more the most frequent stands, the first among equals. Numbers, words that only
    end in an exclamation mark and words without such a reading stay. White space becomes single spaces.
    """
    edge = "[" + "".join(f"\\{c}" for c in WORD_EDGE if c != "!") + "]*"
    glyph = "[" + "".join(f"\\{c}" if not c.isdigit() else c for c in GLYPHS) + "]"
    split = titles.select("doc_id", "seq", T.squeezed(F.col("text")).alias("text"))
    found = split.select("doc_id", "seq", F.posexplode(F.split("text", " ")).alias("pos", "token"))
    whole = rf"^({edge})(.*?)({edge})$"
    found = found.select("doc_id", "seq", "pos", *[F.regexp_extract("token", whole, n).alias(c) for n, c in ((1, "lead"), (2, "core"), (3, "tail"))])
    slots = F.regexp_count("core", F.lit(glyph))
    found = found.where(F.col("core").rlike(r"\p{L}") & slots.between(1, GLYPHS_MOST) & ~(F.col("core").endswith("!") & (slots == 1)))
    table = F.create_map(*[F.lit(x) for k, v in GLYPHS.items() for x in (k, v)])
    letters = lambda c: F.split(F.when(F.upper("core") == F.col("core"), table[c]).otherwise(F.translate(table[c], "OÖDIİZBASŞGĞTH", "oödıizbasşgğth")), "")
    ways = F.transform(F.split("core", ""), lambda c: F.coalesce(letters(c), F.array(c)))
    readings = F.aggregate(ways, F.array(F.lit("")), lambda done, way: F.flatten(F.transform(done, lambda r: F.transform(way, lambda c: F.concat(r, c)))))
    options = found.select("doc_id", "seq", "pos", "lead", "tail", F.posexplode(readings).alias("turn", "reading")).withColumn("word", T.fold(F.col("reading")))
    known = options.join(vocab.where(F.col("freq") >= SEEN_TWICE), ["doc_id", "word"])
    best = known.groupBy("doc_id", "seq", "pos").agg(F.max_by(F.concat("lead", "reading", "tail"), F.struct("freq", -F.col("turn"))).alias("token"))
    changes = best.groupBy("doc_id", "seq").agg(F.map_from_entries(F.collect_list(F.struct("pos", "token"))).alias("changes"))
    fixed = F.array_join(F.transform(F.split("text", " "), lambda t, n: F.coalesce(F.try_element_at("changes", n), t)), " ")
    return split.join(changes, ["doc_id", "seq"], "left").select("doc_id", "seq", "text", F.when(F.col("changes").isNull(), F.col("text")).otherwise(fixed).alias("corrected"), F.coalesce(F.size("changes"), F.lit(0)).cast("long").alias("words"))


def suspicious(rows: DataFrame) -> DataFrame:
    """Passages a recogniser may have misread, by kind: digits in a word, a case flip, a letter four times."""
    kinds = (("digit", rf"{T.LETTER}+[0-9]+{T.LETTER}+"), ("case", r"\p{Ll}+\p{Lu}+\p{Ll}*"), ("repeat", "aaaa+|bbbb+|cccc+|dddd+|eeee+|ffff+|gggg+|hhhh+|iiii+|jjjj+|kkkk+|llll+|mmmm+|nnnn+|oooo+|pppp+|qqqq+|rrrr+|ssss+|tttt+|uuuu+|vvvv+|wwww+|xxxx+|yyyy+|zzzz+"))

    def marked(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("line", F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("passage")))

    found = F.flatten(F.array(*[marked(*k) for k in kinds]))
    return rows.select("doc_id", "i", F.explode(found).alias("f")).select("doc_id", "i", "f.kind", "f.passage").groupBy("doc_id", "i", "kind", "passage").agg(F.count("*").alias("times"))


def hyphen_evidence(rows: DataFrame) -> DataFrame:
    """What a document says about hyphens: words written closed, and pairs written with a hyphen inside a line."""
    closed = rows.select("doc_id", F.explode(F.regexp_extract_all("line", F.lit(f"{T.LETTER}+"), F.lit(0))).alias("w")).select("doc_id", F.lit("closed").alias("kind"), T.fold(F.col("w")).alias("form"))
    paired = rows.select("doc_id", F.explode(F.regexp_extract_all("line", F.lit(f"{T.LETTER}+-{T.LETTER}+"), F.lit(0))).alias("w")).select("doc_id", F.lit("hyphenated").alias("kind"), T.fold(F.col("w")).alias("form"))
    return closed.union(paired).distinct()


def hyphen_decisions(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """Line ends with a hyphen: keep it if the document writes the pair so, close it if it writes the word so or says nothing."""
    w = Window.partitionBy("doc_id").orderBy("i")
    ends = rows.withColumn("next", F.lead("line").over(w)).select(
        "doc_id", "i", F.regexp_extract("line", rf"({T.LETTER}+)[-\x{{00AD}}]\s*$", 1).alias("left"), F.regexp_extract("next", rf"^\s*({T.LETTER}+)", 1).alias("right")
    ).where("left <> '' and right <> ''")
    ends = ends.withColumn("form", T.fold(F.concat("left", F.lit("-"), "right")))
    pairs = evidence.where("kind = 'hyphenated'").select("doc_id", "form", F.lit(True).alias("seen"))
    return ends.join(pairs, ["doc_id", "form"], "left").select("doc_id", "i", "left", "right", F.when(F.col("seen"), F.concat("left", F.lit("-"), "right")).otherwise(F.concat("left", "right")).alias("joined"))
