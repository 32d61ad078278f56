"""Problem 4: freely typed names mapped to the entries of a reference list, SQL expressions only.

1. The list's names, aliases and abbreviations become *forms*: sets of content words. Where an alias repeats a name but
   for one part, the two differing parts are taken as synonyms, for every entry that has that part.
2. Values are made distinct and stripped of what doesn't tell entries apart: function words, words for the kind (theory,
   model ...), words that the list's aliases add whatever the entry, and fillers: words that the list lacks and that stand
   beside complete forms of at least FILLER_ENTRIES entries. Fillers are learned from all values; more rows can only add some.
3. A stripped value that is a form, in any order, means its entry.
4. All others go through a partition-based pigeonhole join. Each form, in every order of its words (an
   abbreviation beside them last), is a reference string without spaces. K edits are allowed, a swap of neighbours being one edit that ``levenshtein`` counts as two, so a
   string is cut into 2 K + 1 segments of which one must survive, at a position that moved by at most K. An equality join on
   (length, segment, substring) finds the candidates, Spark's ``levenshtein`` verifies them, and the nearest entry wins.
5. A misspelling must look like one, by rules that don't depend on the other rows: the words by which value and form
   differ must be no word of the list (another site, thing or process), nor of a public vocabulary (``vocabulary``) unless
   it only lacks a letter or a space of the form's words.
6. What finds no entry is reported by an anti-join.
"""

from __future__ import annotations

import base64
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.skew import skew_join
from corvane.session import cut

#: Edits that a value may have suffered, and one shorter than LONG letters; two neighbours swapped are one edit.
K, K_SHORT, LONG = 2, 1, 9
#: Entries beside whose complete forms a word must stand to say nothing on which entry is meant.
FILLER_ENTRIES = 6
#: Share of the entries whose aliases must add a word, in no name, for it to say nothing either.
ALIAS_SHARE = 0.05
#: Words of a form whose orders are all written out; longer forms count in the given and in alphabetical order.
ORDERED = 4
#: What kind of thing a name calls itself; and words without content, the subject of all theories of the list among them.
KINDS = ["theory", "theories", "model", "models", "framework", "frameworks", "hypothesis", "hypotheses", "concept", "concepts", "paradigm", "paradigms", "mechanism", "mechanisms", "approach", "approaches", "account", "view"]
FUNCTION = ["of", "the", "a", "an", "in", "as", "by", "for", "and", "to", "on", "so", "socalled", "or", "with", "from", "at", "called", "aging", "ageing", "senescence"]
STOP = [*KINDS, *FUNCTION]
FIELDS = {"original_name": "original_name", "mapped_name": "mapped_name", "canonical_name": "match_result.canonical_name"}
#: A public tokenizer's rank file; its entries that begin with a space are the vocabulary of whole words.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_KIND = "|".join(k for k in KINDS if len(k) > 4)


def words(text: Column) -> Column:
    """The words of ``text`` in lower case; anything but letters and digits parts them, and so do words for the kind that lost a space."""
    parted = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    parted = F.regexp_replace(parted, rf"(?<=[\p{{L}}\p{{N}}]{{3}})({_KIND})(?= |$)", " $1")
    parted = F.regexp_replace(parted, rf"(?<= |^)({_KIND})(?=[\p{{L}}\p{{N}}]{{2}})", "$1 ")
    return F.filter(F.split(parted, " "), lambda w: w != "")


def _told(ws: Column) -> Column:
    """The words of a value or form that aren't STOP, each once, in order."""
    return F.array_distinct(F.filter(ws, lambda w: ~w.isin(STOP)))


def _key(ws: Column) -> Column:
    return F.concat_ws(" ", F.array_sort(ws))


def reference_texts(ontology: DataFrame) -> DataFrame:
    """(ontology_id, name, text): every name and alias. Null texts and entries without an id are left out."""
    arrays = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return ontology.where(F.col("ontology_id").isNotNull()).select("ontology_id", "name", F.explode(arrays).alias("text")).where(F.col("text").isNotNull())


def added_words(ontology: DataFrame) -> list[str]:
    """Words that aliases of at least ALIAS_SHARE of the entries have and no name has: 1 / ALIAS_SHARE for each word of an alias at most."""
    t = reference_texts(ontology)
    named = t.select(F.explode(words(F.col("name"))).alias("word")).distinct()
    least = max(3, ontology.agg(F.count_distinct("ontology_id").alias("n")).first()["n"] * ALIAS_SHARE)
    used = t.select("ontology_id", F.explode(_told(words(F.col("text")))).alias("word")).groupBy("word").agg(F.count_distinct("ontology_id").alias("n"))
    return sorted(r.word for r in used.where(F.col("n") >= least).join(named, "word", "left_anti").select("word").collect())


def base_forms(ontology: DataFrame, idle: list[str]) -> DataFrame:
    """(ontology_id, name, text, w): the content words of each name and alias, in order, without ``idle`` ones."""
    t = reference_texts(ontology).withColumn("told", _told(words(F.col("text"))))
    return t.select("ontology_id", "name", "text", F.filter("told", lambda w: ~w.isin(idle)).alias("w")).where(F.size("w") > 0)


def synonyms(base: DataFrame) -> DataFrame:
    """(part, other): parts of names that aliases of the same entry replace, as lists of words.

    Learned where an alias shares at least two content words with the name and what is left of the name is one word.
    """
    names = base.where(F.col("text") == F.col("name")).select("ontology_id", F.col("w").alias("n")).distinct()
    t = base.where(F.col("text") != F.col("name")).join(names, "ontology_id").where(F.size(F.array_intersect("n", "w")) >= 2)
    t = t.select(F.array_except("n", "w").alias("part"), F.array_except("w", "n").alias("other"))
    return t.where((F.size("part") == 1) & (F.size("other") >= 1)).select(F.col("part")[0].alias("part"), "other").distinct()


def forms(base: DataFrame, ontology: DataFrame) -> DataFrame:
    """(key, w, abbr, ontology_id): the sets of content words that mean an entry, and no other entry.

    Names of three content words read site, thing, process; such a name is also known by its last two (the site left
    out), where these belong to one entry only. Each form also counts with the entry's abbreviation (abbr, else empty) beside it.
    """
    short = base.where((F.col("text") == F.col("name")) & (F.size("w") == 3)).select("ontology_id", F.slice("w", 2, 2).alias("w"))
    parts = base.select("ontology_id", "w").unionByName(short)
    swapped = parts.select("ontology_id", "w", F.explode("w").alias("part")).join(synonyms(base), "part")
    swapped = swapped.select("ontology_id", F.flatten(F.transform("w", lambda x: F.when(x == F.col("part"), F.col("other")).otherwise(F.array(x)))).alias("w"))
    sets = parts.unionByName(swapped)
    abbreviated = ontology.where(F.col("ontology_id").isNotNull()).select("ontology_id", F.explode("abbreviations").alias("abbr"))
    abbreviated = abbreviated.select("ontology_id", F.lower(F.regexp_replace("abbr", r"[^\p{L}\p{N}]+", "")).alias("abbr")).where(F.col("abbr") != "")
    sets = sets.select("ontology_id", F.array_distinct("w").alias("w"))
    beside = sets.join(abbreviated, "ontology_id").select(_key(F.array_distinct(F.concat("w", F.array("abbr")))).alias("key"), "w", "abbr", "ontology_id")
    every = sets.select(_key(F.col("w")).alias("key"), "w", F.lit("").alias("abbr"), "ontology_id").unionByName(beside)
    every = every.unionByName(abbreviated.select(F.concat(F.lit("="), "abbr").alias("key"), F.array().cast("array<string>").alias("w"), "abbr", "ontology_id"))
    one = every.groupBy("key").agg(F.min("ontology_id").alias("ontology_id"), F.max("ontology_id").alias("last")).where(F.col("ontology_id") == F.col("last")).select("key", "ontology_id")
    return every.select("key", "w", "abbr").distinct().join(one, "key")


def vocabulary(spark: SparkSession, path: str | None = VOCABULARY) -> DataFrame:
    """(word): whole words of a public tokenizer's rank file, in lower case; none without a file.

    The file has some 50,000 entries, whatever the data.
    """
    found = set()
    if path and os.path.exists(path):
        with open(path, "rb") as lines:
            tokens = (base64.b64decode(line.split()[0]) for line in lines)
            found = {t[1:].decode("utf-8", "ignore").lower() for t in tokens if t[:1] == b" " and t[1:].isalpha()}
    return spark.createDataFrame([(w,) for w in sorted(found) if len(w) > 2], "word string")


def own_words(spark: SparkSession, listed: DataFrame, known: DataFrame, path: str | None = VOCABULARY) -> DataFrame:
    """(word): public words that mean themselves: all but those of the list, and those that only lack a letter or a space of its words."""
    shorter = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word"))))
    joined = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, 2), ""))
    near = listed.select(F.explode(shorter).alias("word")).unionByName(known.where(F.size("w") > 1).select(F.explode(joined).alias("word"))).unionByName(listed)
    return vocabulary(spark, path).join(near, "word", "left_anti")


def _orders(w: Column) -> Column:
    """All orders of up to ORDERED words, as strings without spaces; of more words, the given and the alphabetical one."""
    flat = lambda a: F.array_join(a, "")

    def grown(rest: Column, done: Column, depth: int) -> Column:
        if depth == 1:
            return F.transform(rest, lambda x: F.concat(done, x))
        return F.flatten(F.transform(rest, lambda x: grown(F.array_remove(rest, x), F.concat(done, x), depth - 1)))

    picks = F.when(F.size(w) > ORDERED, F.array(flat(w), flat(F.array_sort(w))))
    for n in range(1, ORDERED + 1):
        picks = picks.when(F.size(w) == n, grown(w, F.lit(""), n))
    return picks


def references(known: DataFrame) -> DataFrame:
    """(ref, w, ontology_id): the strings of the forms of at least two words, and of long single ones; an abbreviation comes last."""
    whole = F.when(F.col("abbr") == "", F.col("w")).otherwise(F.concat("w", F.array("abbr")))
    rows = known.where(F.size("w") > 0).select("ontology_id", "w", "abbr", F.explode(F.array_distinct(_orders(F.col("w")))).alias("order"))
    rows = rows.select("ontology_id", whole.alias("form"), F.concat("order", "abbr").alias("ref")).withColumnRenamed("form", "w")
    return rows.where((F.size("w") > 1) | (F.length("ref") >= LONG))


def _edits(length: Column) -> Column:
    return F.when(length >= LONG, K).otherwise(K_SHORT)


def _cut(df: DataFrame) -> DataFrame:
    """For each reference length ``len``: the numbers of its segments, where they start (from 1) and how long they are."""
    n = 2 * _edits(F.col("len")) + 1
    df = df.withColumn("parts_n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("parts_n") - 1)).alias("seg"))
    start, stop = (F.floor((F.col("seg") + i) * F.col("len") / F.col("parts_n")).cast("int") for i in (0, 1))
    return df.withColumn("at", start + 1).withColumn("width", stop - start).where("width > 0").drop("parts_n")


def _changed(a: str, b: str, distance: str) -> Column:
    """Edits between two strings, swaps counted once: letters that differ, and half of what levenshtein adds to them."""
    letters = F.aggregate(
        F.array_distinct(F.split(b, "")),
        F.lit(0),
        lambda s, c: s + F.least(F.length(a) - F.length(F.replace(F.col(a), c, F.lit(""))), F.length(b) - F.length(F.replace(F.col(b), c, F.lit("")))),
    )
    other = F.greatest(F.length(a), F.length(b)) - letters
    return other + F.ceil((F.col(distance) - other) / 2)


def pigeonhole(strings: DataFrame, refs: DataFrame) -> DataFrame:
    """(string, ref, edits): the references within the allowed edits of each string (columns ``string`` and ``ref``, distinct).

    A segment's candidates are packed into one row, a part of the reference list; strings that share a segment with many
    others (a hot name, misspelt in many ways) are joined in place, by ``skew_join``.
    """
    cuts = _cut(refs.select("ref").distinct().where(F.length("ref") > 2).withColumn("len", F.length("ref")))
    cuts = cuts.select("ref", F.xxhash64("len", "seg", F.expr("substring(ref, at, width)")).alias("piece"))
    packed = cuts.groupBy("piece").agg(F.collect_list("ref").alias("refs"))
    # all places at which a surviving segment of a reference of each possible length can stand in the string
    probes = strings.where(F.length("string") > 1).select("string", F.explode(F.sequence(F.lit(-K), F.lit(K))).alias("more")).withColumn("len", F.length("string") + F.col("more"))
    probes = _cut(probes.where("len > 2")).select("*", F.explode(F.sequence(F.lit(-K), F.lit(K))).alias("shift"))
    # the part before the segment moved by ``shift``, so the part after it took the rest of the difference in length
    probes = probes.where((F.abs("shift") + F.abs(-F.col("more") - F.col("shift")) <= _edits(F.col("len"))) & (F.col("at") + F.col("shift") >= 1) & (F.col("at") + F.col("shift") + F.col("width") - 1 <= F.length("string")))
    probes = cut(probes.select("string", F.xxhash64("len", "seg", F.expr("substring(string, at + shift, width)")).alias("piece")).distinct())
    met = skew_join(probes, packed, "piece").select("string", F.explode("refs").alias("ref"))
    near = met.where(F.abs(F.length("string") - F.length("ref")) <= K).withColumn("distance", F.levenshtein("string", "ref", 2 * K)).where("distance >= 0").distinct()
    near = near.withColumn("edits", _changed("string", "ref", "distance"))
    return near.where(F.col("edits") <= _edits(F.length("ref"))).select("string", "ref", "edits")


def fillers(stripped: DataFrame, known: DataFrame) -> DataFrame:
    """(word): words that the list lacks and that, alone or with others, stand beside complete forms of FILLER_ENTRIES entries.

    ``stripped``: (listed, other), the words of values that the list has and those that it lacks.
    """
    rest = stripped.where((F.size("listed") > 0) & (F.size("other") > 0)).select(_key(F.col("listed")).alias("key"), F.array_sort("other").alias("other")).distinct()
    beside = rest.join(known.select("key", "ontology_id").distinct(), "key")
    beside = beside.groupBy("other").agg(F.count_distinct("ontology_id").alias("n")).where(F.col("n") >= FILLER_ENTRIES)
    return beside.select(F.explode("other").alias("word")).distinct()


def mentions(entries: DataFrame, fields: dict[str, str] | None = None, key: str = "theory_id") -> DataFrame:
    """(key, field, value): every non-empty value of the fields; re-delivered rows count once. Null keys are left out."""
    stack = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in (fields or FIELDS).items()]))
    rows = entries.where(F.col(key).isNotNull()).select(F.col(key), stack.alias("m")).select(key, "m.field", "m.value")
    return rows.where(F.coalesce(F.col("value"), F.lit("")) != "").distinct()


def _almost(w: Column, idle: list[str]) -> Column:
    """Whether a word is one for the kind, or one of the long idle ones, with a few edits."""
    long = [k for k in (*KINDS, *idle) if len(k) > 4]
    return F.exists(F.array(*map(F.lit, long)), lambda k: F.levenshtein(w, k, 3).between(1, F.when(F.length(k) > 6, 3).otherwise(2)))


def _one_entry(found: DataFrame, by: str) -> DataFrame:
    """(by, ontology_id) where all rows name the same entry."""
    return found.groupBy(by).agg(F.min("ontology_id").alias("ontology_id"), F.max("ontology_id").alias("last")).where(F.col("ontology_id") == F.col("last")).drop("last")


def match_values(values: DataFrame, ontology: DataFrame, vocabulary_path: str | None = VOCABULARY) -> DataFrame:
    """(value, ontology_id) of the distinct ``values`` (one column, value) that are forms of an entry.

    Values without a letter or digit, of fillers only, or with any word that the entry's form lacks match nothing; nor do
    values that are equally near to forms of different entries. Values of any length are taken whole; the very long ones
    have no reference of their length. An empty list matches nothing.
    """
    spark = values.sparkSession
    idle = added_words(ontology)
    base = cut(base_forms(ontology, idle))
    known = cut(forms(base, ontology))
    listed = cut(known.select(F.explode(F.concat("w", F.array("abbr"))).alias("word")).where("word <> ''").unionByName(reference_texts(ontology).select(F.explode(words(F.col("text"))).alias("word"))).distinct())
    split = values.select("value", words(F.col("value")).alias("all")).where(F.size("all") > 0)
    stripped = split.select("value", F.filter(_told(F.col("all")), lambda w: ~w.isin(idle)).alias("w"))
    # words may be hot ("theory" is in most values, but so may any other be): they are looked up where they stand
    tokens = cut(stripped.select("value", F.posexplode("w").alias("at", "word")))
    told = skew_join(tokens, listed.withColumn("listed", F.lit(True)), "word", how="left").groupBy("value").agg(F.array_sort(F.collect_set(F.struct("at", "word", F.coalesce("listed", F.lit(False)).alias("listed")))).alias("t"))
    pick = lambda keep: F.transform(F.filter("t", keep), lambda x: x["word"])
    told = cut(told.select("value", pick(lambda x: x["listed"]).alias("listed"), pick(lambda x: ~x["listed"]).alias("other"), F.transform("t", lambda x: x["word"]).alias("w")))
    others = cut(told.select("value", F.explode("other").alias("word")))
    lookup = own_words(spark, listed, known, vocabulary_path).select("word", F.lit(False).alias("filler")).unionByName(fillers(told, known).select("word", F.lit(True).alias("filler")))
    lookup = cut(lookup.groupBy("word").agg(F.max("filler").alias("filler")))
    looked = skew_join(others, lookup, "word").groupBy("value").agg(F.collect_set(F.when(F.col("filler"), F.col("word"))).alias("drop"), F.collect_set(F.when(~F.col("filler"), F.col("word"))).alias("own"))
    none = F.array().cast("array<string>")
    bare = told.join(looked, "value", "left").select("value", "other", F.coalesce("drop", none).alias("drop"), F.coalesce("own", none).alias("own"), "w")
    bare = cut(bare.select("value", F.array_except("w", "drop").alias("w"), F.array_except(F.array_except("other", "drop"), "own").alias("strange")))
    by_key = known.select("key", "ontology_id").distinct()
    exact = bare.where(F.size("w") > 0).select("value", _key(F.col("w")).alias("key")).join(by_key, "key").select("value", "ontology_id")
    # abbreviations: letters as typed, dots and spaces aside, exact
    long_stop = [w for w in STOP if len(w) > 1]
    spelled = split.select("value", F.concat(F.lit("="), F.array_join(F.filter("all", lambda w: ~w.isin(long_stop)), "")).alias("key"))
    exact = cut(_one_entry(exact.unionByName(spelled.join(by_key, "key").select("value", "ontology_id")), "value"))
    # only a value with a strange word can be a form misspelt; words for the kind may be misspelt as well, so it is also read without what looks like one
    rest = bare.where(F.size("strange") > 0).join(exact.select("value"), "value", "left_anti")
    rest = rest.withColumn("kindless", F.array_except("w", F.filter("strange", lambda w: _almost(w, idle))))
    read = rest.select("value", F.explode(F.array_distinct(F.array("w", "kindless"))).alias("w")).where(F.size("w") > 0)
    read = cut(read.select("value", "w", _key(F.col("w")).alias("key")))
    second = cut(_one_entry(read.join(by_key, "key").select("value", "ontology_id"), "value"))
    exact = exact.unionByName(second)
    open_ = cut(read.join(second.select("value"), "value", "left_anti").select("value", "w", F.array_join("w", "").alias("string")))
    refs = cut(references(known))
    near = pigeonhole(open_.select("string").distinct(), refs)
    pairs = open_.join(near, "string").join(refs.select("ref", F.col("w").alias("form"), "ontology_id"), "ref")
    pairs = cut(pairs.select("value", "string", "edits", "ontology_id", F.array_except("w", "form").alias("extra"), F.array_except("form", "w").alias("lacking")))
    # a misspelling brings few letters that the form's words lack
    letters = F.array_distinct(F.split(F.array_join("lacking", ""), ""))
    foreign = F.size(F.filter(F.array_distinct(F.split(F.array_join("extra", ""), "")), lambda c: ~F.array_contains(letters, c)))
    pairs = pairs.where(foreign <= K)
    # words of their own: those of the list, and those of the public vocabulary that don't only lack a letter or a space
    strange = pairs.select("value", "ontology_id", "edits", "lacking", F.explode_outer("extra").alias("word"))
    shortened = F.exists("lacking", lambda r: (F.length(r) == F.length("word") + 1) & (F.levenshtein(r, F.col("word"), 1) == 1)) | F.array_join("lacking", "").contains(F.col("word"))
    own = strange.join(listed, "word", "left_semi").select("value", "ontology_id", "edits")
    own = own.unionByName(strange.where(~shortened).join(vocabulary(spark, vocabulary_path), "word", "left_semi").select("value", "ontology_id", "edits"))
    left = pairs.select("value", "ontology_id", "edits").distinct().join(own.distinct(), ["value", "ontology_id", "edits"], "left_anti")
    best = left.groupBy("value").agg(F.min(F.struct("edits", "ontology_id")).alias("b"), F.min("edits").alias("least"))
    nearest = left.join(best.select("value", "least"), "value").where(F.col("edits") == F.col("least"))
    return exact.unionByName(_one_entry(nearest, "value"))


def names_found(entries: DataFrame, ontology: DataFrame) -> DataFrame:
    """(theory_id, field, ontology_id): one row per value that is a form of an entry."""
    rows = cut(mentions(entries))
    matched = cut(match_values(cut(rows.select("value").distinct()), ontology))
    return skew_join(rows, matched, "value").select("theory_id", "field", "ontology_id").distinct()


def unmatched(entries: DataFrame, ontology: DataFrame) -> DataFrame:
    """(field, value, mentions): the values that mean no entry of the list, most frequent spellings included."""
    rows = cut(mentions(entries))
    counted = rows.groupBy("field", "value").agg(F.count(F.lit(1)).alias("mentions"))
    return counted.join(match_values(cut(rows.select("value").distinct()), ontology), "value", "left_anti").select("field", "value", "mentions")
