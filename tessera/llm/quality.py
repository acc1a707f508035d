"""Quality rules: repetition counts, and divergence from language references. Built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, broadcast_if_small, col, free_name, materialise

_BLANK = r"[\x20\x09-\x0D]"
#: Character classes of the histogram besides blanks and lower-case ASCII, as patterns; the rest is the last class.
CLASSES = (r"[A-Z]", r"[0-9]", r"[.,;:!?'\"()-]", r"[#*$%&|<>@^~_=+{}\[\]\\/]")


_SLOTS = 1024


@dataclass(frozen=True)
class Rules:
    min_words: int = 20  #: fewer fail
    max_repeat_percent: int = 30  #: more words than this in repeated windows fail
    window: int = 8  #: words
    common_words: int = 40  #: of a language
    guard_chars: int = 200  #: shorter documents are not judged by character classes
    guard_words: int = 50  #: nor by common words, if they have fewer words than this
    max_class_distance: float = 0.25
    max_word_distance: float = 0.47
    #: A document with none of the common words is at a distance, the reach, which no lack of words exceeds. As a
    #: share of it, the word distance of n words may be sqrt(word_share + word_noise * common_words / n), or the most.
    word_share: float = 0.2
    word_noise: float = 1.65
    max_word_share: float = 0.95


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable is bound to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _repeat_words(words: Column, window: int) -> Column:
    """From the hashes of words: words inside windows of ``window`` words that occur at least twice, the first included."""

    def covered(hashes: Column) -> Column:
        # Places sorted by window hash; a place repeats if a neighbour in that order has its hash.
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        def repeats(r: Column) -> Column:
            return F.filter(
                F.transform(
                    r,
                    lambda x, i: F.when(
                        ((i > 0) & (F.get(r, i - 1)["h"] == x["h"])) | ((i < F.size(r) - 1) & (F.get(r, i + 1)["h"] == x["h"])),
                        x["i"],
                    ),
                ),
                lambda i: i.isNotNull(),
            )

        places = _let(ranked, lambda r: F.sort_array(repeats(r)))
        return _let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.when(i == 0, F.lit(window)).otherwise(F.least(F.lit(window), x - F.get(p, i - 1)))),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            ),
        )

    def over(w: Column) -> Column:
        # Hashes of windows of 1, 2, 4, ... words, each from two of the size before.
        def doubled(hashes: Column, width: int) -> Column:
            if width == window:
                return hashes
            shift = min(width, window - width)
            paired = lambda h: F.zip_with(F.slice(h, 1, F.size(h) - shift), F.slice(h, shift + 1, F.size(h) - shift), lambda x, y: F.xxhash64(x, y))
            return doubled(_let(hashes, paired), width + shift)

        return _let(
            doubled(w, 1),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)),
        )

    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(_let(words, over))


def base_counts(df: DataFrame, text: str, rules: Rules) -> DataFrame:
    """``df`` plus a struct ``_q`` of the contract's counts, the character-class counts, and the words' hashes."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    stage = (
        df.withColumn("_w", _words(t))
        .withColumn("_l", lines)
        .withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
        .withColumn("_j", F.array_join("_w", ""))
        .withColumn("_r", F.regexp_replace("_j", "[a-z]+", ""))
    )
    return stage.select(
        *df.columns,
        F.struct(
            F.size("_w").cast("long").alias("n_words"),
            F.char_length(t).cast("long").alias("n_chars"),
            F.char_length("_j").cast("long").alias("word_chars"),
            F.regexp_count("_r", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            _repeat_words(F.col("_h"), rules.window).alias("n_repeat_words"),
            _classes(F.char_length(t), F.col("_j"), F.col("_r")).alias("classes"),
            F.col("_h").alias("words"),
        ).alias("_q"),
    )


def _classes(chars: Column, joined: Column, rest: Column) -> Column:
    """Counts of blanks, lower-case ASCII, ``CLASSES`` and the rest, from a text's words joined without
    blanks, and from what that has beside lower-case ASCII (few characters, so counting there is cheap)."""
    counts = [F.regexp_count(rest, F.lit(c)) for c in CLASSES]
    left = F.char_length(rest) - sum(counts[1:], counts[0])
    return F.array(chars - F.char_length(joined), F.char_length(joined) - F.char_length(rest), *counts, left)


def references(df: DataFrame, text: str, lang: str, rules: Rules) -> DataFrame:
    """``lang, classes array<double>, common map<hash, share>, slots array<array<hash>>, reach``: a row for each language.

    Common words are held by hash, in a table of ``_SLOTS`` places that the hash addresses, so that a
    document's word is looked up in one step; a place holds all words that it is the place of. ``reach`` is
    the word distance of a document with none of them.

    Fitted on every labelled document: words are counted by language, and character classes come from those
    counts, by what words have beside lower-case ASCII.
    """
    labelled = df.select(col(lang).alias("lang"), F.coalesce(col(text), F.lit("")).alias("t")).where("lang is not null")
    words = labelled.select("lang", F.explode(F.split("t", SPACES)).alias("w")).where("w <> ''").groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    chars = labelled.groupBy("lang").agg(F.sum(F.char_length("t").cast("long")).alias("chars"))
    rests = words.withColumn("r", F.regexp_replace("w", "[a-z]+", "")).groupBy("lang", "r").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.char_length("w")).alias("joined"))
    rests = rests.withColumn("c", _classes(F.char_length("r"), F.col("r"), F.col("r")))
    counts = F.array(*(F.sum(F.col("n") * F.col("c")[i]) for i in range(2, len(CLASSES) + 3)))
    total = rests.groupBy("lang").agg(F.sum("n").alias("total"), F.sum("joined").alias("joined"), F.sum(F.col("n") * F.char_length("r")).alias("rest"), counts.alias("counts"))
    of = lambda x: F.coalesce(x, F.lit(0))  # noqa: E731  # a language without words
    sums = [F.col("chars") - of(F.col("joined")), of(F.col("joined") - F.col("rest")), *(of(F.col("counts")[i]) for i in range(len(CLASSES) + 1))]
    classes = F.array(*(F.coalesce(F.try_divide(x, "chars").cast("double"), F.lit(0.0)) for x in sums))
    classes = chars.join(total, "lang", "left").select("lang", classes.alias("classes"))
    by_rank = Window.partitionBy("lang").orderBy(F.desc("n"), "w")
    top = words.withColumn("r", F.row_number().over(by_rank)).where(F.col("r") <= rules.common_words)
    share = F.struct(F.xxhash64("w").alias("h"), (F.col("n") / F.col("total")).cast("double").alias("p"))
    pairs = top.join(total.select("lang", "total"), "lang").groupBy("lang").agg(F.map_from_entries(F.array_sort(F.collect_list(share))).alias("common"))
    place = lambda h: F.pmod(h, F.lit(_SLOTS)).cast("int")
    keys = F.map_keys("common")
    by_slot = F.map_from_entries(F.transform(F.array_distinct(F.transform(keys, place)), lambda i: F.struct(i, F.filter(keys, lambda h: place(h) == i))))
    common = pairs.select("lang", "common", by_slot.alias("by_slot"))
    common = common.select("lang", "common", F.transform(F.sequence(F.lit(0), F.lit(_SLOTS - 1)), lambda i: F.try_element_at("by_slot", i)).alias("slots"))
    known = _sum(F.map_values("common"))
    return classes.join(common, "lang", "left").withColumn("reach", F.sqrt(known / 2 + _half(F.lit(1.0), F.lit(1.0) - known)))


def _half(p: Column, q: Column) -> Column:
    """One bin's share of the Jensen-Shannon divergence, in bits."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m) / 2).otherwise(F.lit(0.0))
    return part(p) + part(q)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _class_distance(counts: Column, chars: Column, reference: Column) -> Column:
    shares = F.transform(counts, lambda c: c / chars)
    return F.sqrt(F.greatest(F.lit(0.0), _sum(F.zip_with(shares, reference, _half))))


def _word_distance(words: Column, n: Column, common: Column, slots: Column) -> Column:
    """Distance over the reference's common words and one bin for all others."""

    def of(kept: Column) -> Column:
        seen = F.array_distinct(kept)
        bins = F.transform(
            seen, lambda w: F.struct(((F.size(kept) - F.size(F.array_remove(kept, w))) / n).alias("p"), F.element_at(common, w).alias("q"))
        )

        def total(b: Column) -> Column:
            unseen = _sum(F.map_values(common)) - _sum(F.transform(b, lambda x: x["q"]))
            rest = _half((n - F.size(kept)) / n, F.lit(1.0) - _sum(F.map_values(common)))
            # A bin that the document lacks adds half its own share: q * log2(q / (q / 2)) / 2.
            return _sum(F.transform(b, lambda x: _half(x["p"], x["q"]))) + unseen / 2 + rest

        return F.sqrt(F.greatest(F.lit(0.0), _let(bins, total)))

    return _let(F.filter(words, lambda w: F.array_contains(F.get(slots, F.pmod(w, F.lit(_SLOTS)).cast("int")), w)), of)


def quality_verdicts(df: DataFrame, *, text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """``df`` plus ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept``.

    A document is kept if it passes the base rules and, where it is long enough to be judged, its
    histograms of character classes and of common words lie within a Jensen-Shannon distance of those
    of its language, that of words also within a share of what a document without common words has. A document
    without a language is judged against the nearest reference, by words and then by classes; without any reference
    it is not judged, nor is a document below the guards (its distance is null). A null text counts as empty and fails. Documents go through a narrow pass
    with a table of a row for each language, broadcast while it measures under 32 MB (about 1,800 languages) and
    else joined by an exchange whose skew adaptive execution splits; ties and repeated rows do not matter; columns of ``df`` with the names above are replaced; an empty table gives no rows.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]
    label = "_lang"
    given = [c for c in df.columns if c.lower() not in made]
    # Callers' columns travel in one struct, so that none clashes with a working column.
    source = df.select(F.struct(*map(col, given)).alias("_row"), col(text).alias("_text"), col(lang).alias("_of"))
    one = materialise(references(df, text, lang, rules)).select(F.col("lang").alias(label), F.struct("classes", "common", "slots", "reach").alias("_ref"))
    every = one.where(F.col("_ref.common").isNotNull()).agg(F.collect_list("_ref").alias("_refs"))
    refs = one.select(label, F.array("_ref").alias("_refs")).unionByName(every.select(F.lit(None).cast("string").alias(label), "_refs"))
    counted = base_counts(source, "_text", rules)
    refs = broadcast_if_small(materialise(refs), F.size("_refs") * (16 * _SLOTS + 32 * rules.common_words))
    judged = counted.join(refs, counted["_of"].eqNullSafe(refs[label]), "left")
    q = F.col("_q")
    failed = (q["n_words"] < rules.min_words) | (100 * q["n_repeat_words"] > rules.max_repeat_percent * q["n_words"])
    limit = F.least(F.lit(rules.max_word_share), F.sqrt(rules.word_share + rules.word_noise * rules.common_words / F.greatest(q["n_words"], F.lit(1))))

    def against(ref: Column) -> Column:
        by_class = F.when(q["n_chars"] >= rules.guard_chars, _class_distance(q["classes"], q["n_chars"], ref["classes"]))
        by_word = F.when((q["n_words"] >= rules.guard_words) & ref["common"].isNotNull(), _word_distance(q["words"], q["n_words"], ref["common"], ref["slots"]))
        return F.struct((by_word / ref["reach"]).alias("share"), by_class.alias("class_distance"), by_word.alias("word_distance"))

    # One expression, so that a filter on the verdict computes the distances once.
    def verdict(near: Column) -> Column:
        beyond = lambda name, most: F.coalesce(near[name], F.lit(0.0)) > most
        far = beyond("share", limit) | beyond("class_distance", rules.max_class_distance) | beyond("word_distance", rules.max_word_distance)
        return F.struct(near["class_distance"].alias("class_distance"), near["word_distance"].alias("word_distance"), (~failed & ~far).alias("kept"))

    nearest = F.when(~failed, F.array_min(F.transform("_refs", against)))
    judged = judged.select("_row", "_q", _let(nearest, verdict).alias("_v"))
    return judged.select(
        *(F.col("_row").getField(c).alias(c) for c in given),
        q["n_words"].alias("n_words"),
        q["word_chars"].alias("word_chars"),
        q["n_symbols"].alias("n_symbols"),
        q["n_dup_lines"].alias("n_dup_lines"),
        q["n_repeat_words"].alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.col("_v.class_distance").alias("class_distance"),
        F.col("_v.word_distance").alias("word_distance"),
        F.col("_v.kept").alias("kept"),
    )
