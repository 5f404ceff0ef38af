"""Phrase rules by the thousand: an inverted index of the words that rules wait for.

A registry of SQL rules searches every text once per phrase. Here the rules are
a table, and each text is cut into words (at spaces) once:

* A phrase of several words stands where a word ends with its first one, the
  next ones equal its inner ones, and the next word begins with its last one. At
  each word of a text the phrases that could begin there are made, from the
  word's ends and a later word's beginnings in the lengths that phrases have, as
  far as a sieve of all phrases lets them through (``_across``). So the index
  gives a row for each occurrence, and a few that the sieve didn't stop, however
  many phrases share a frequent word; the join with the phrases drops the others.
* A phrase of one word stands inside a word. It waits for the words of the corpus
  that hold it (``anchors``), which are found among the distinct words that are
  long enough; their places are joined to the rules by word (``_inside``).
* The 50 characters before an occurrence are looked through for negators.

A ``sieve`` is a table of bits, three of them set for each key, 16 bits a key; it
is broadcast (2 bytes a key, 64 MB at most: with more than 30 million keys it lets
more through) and says for certain that a key isn't there. What it lets through is
compared as text.

Results equal ``asserted_occurrences`` for each rule. There are no Python
functions in the plans; a task holds a text's words, the sieve, and the counts of
the phrases in its texts. A phrase must not be empty nor overlap itself (``usable``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govaudit.catalog import NEGATORS
from govaudit.functions.sqltext import bind
from govaudit.functions.text import LOOK_BACK_CHARS, free_of_negators, no_negator_in
from govaudit.session import written

WHOLE, ENDS, BEGINS, HOLDS = "whole", "ends", "begins", "holds"
BLOCK, LARGEST = 512, 1 << 23  # 64-bit words in a row of a sieve, and in a whole one at most
_MARK = " | ".join(f"shiftleft(1L, CAST(shiftrightunsigned(_h, {k}) & 63 AS INT))" for k in (40, 46, 52))


def usable(rules: DataFrame) -> DataFrame:
    """The rules (rule_id, phrase) that can be searched, in lower case; the others have an empty phrase or one that overlaps itself."""
    low = rules.withColumn("phrase", F.lower("phrase")).where("phrase <> ''")
    return low.where("NOT exists(sequence(1, greatest(1, length(phrase) - 1)), "
                     "i -> i < length(phrase) AND startswith(phrase, substring(phrase, i + 1)))")


def words_of(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with ``words`` in place of the text: its lower-case pieces between spaces."""
    return texts.withColumn("words", F.split(F.lower(F.col(text)), " ", -1)).drop(text)


def sieve(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """_block, _bits: the table of bits of the rows' keys (``key``: SQL, one or more values), and its number of 64-bit words. Starts jobs."""
    spark, hashes = keys.sparkSession, keys.select(F.expr(f"xxhash64({key})").alias("_h"))
    size = min(max(BLOCK, 1 << (hashes.count() // 4).bit_length()), LARGEST)
    marks = hashes.selectExpr(f"_h & {size - 1}L AS at", f"{_MARK} AS bits").unionByName(spark.range(size).selectExpr("id AS at", "0L AS bits"))  # no gaps
    words = marks.groupBy("at").agg(F.bit_or("bits").alias("bits"))
    blocks = words.groupBy(F.expr(f"shiftright(at, {BLOCK.bit_length() - 1})").alias("_block")).agg(F.sort_array(F.collect_list(F.struct("at", "bits"))).alias("words"))
    return written(blocks.select("_block", F.expr("transform(words, x -> x.bits)").alias("_bits")), "sieve"), size


def sifted(rows: DataFrame, key: str, through: tuple[DataFrame, int]) -> DataFrame:
    """The rows whose key a sieve may have."""
    blocks, size = through
    return (rows.withColumn("_h", F.expr(f"xxhash64({key})"))
            .join(F.broadcast(blocks), F.expr(f"shiftright(_h & {size - 1}L, {BLOCK.bit_length() - 1}) = _block"))
            .where(f"(get(_bits, CAST(_h & {BLOCK - 1}L AS INT)) & ({_MARK})) = ({_MARK})").drop("_h", "_block", "_bits"))


def phrase_words(rules: DataFrame) -> DataFrame:
    """rule_id, k, word, kind: each word of each phrase and how it stands in the corpus."""
    split = rules.select("rule_id", F.split("phrase", " ", -1).alias("words"))
    return split.select("rule_id", F.size("words").alias("m"), F.posexplode("words").alias("k", "word")).select(
        "rule_id", "k", "word", F.expr(f"CASE WHEN m = 1 THEN '{HOLDS}' WHEN k = 0 THEN '{ENDS}' WHEN k = m - 1 THEN '{BEGINS}' ELSE '{WHOLE}' END").alias("kind"))


def matching_words(vocabulary: DataFrame, wanted: DataFrame) -> DataFrame:
    """word, kind, found, n: the words of ``vocabulary`` (word, n) that a phrase's word stands for; ``wanted`` has each
    word and kind once. A word's beginnings, ends and inner pieces are made only in the lengths that are wanted."""
    lengths = {kind: wanted.where(F.col("kind") == kind).agg(F.sort_array(F.collect_set(F.length("word"))).alias("l")).scalar() for kind in (ENDS, BEGINS, HOLDS)}
    sized = vocabulary.select("word", "n", *(x.alias(f"{kind}_lengths") for kind, x in lengths.items()))

    def pieces(kind: str, piece: str) -> DataFrame:
        return sized.select(F.col("word").alias("found"), "n", F.explode(F.expr(piece)).alias("word"), F.lit(kind).alias("kind"))

    fitting = "filter({0}_lengths, l -> l <= length(word))"
    inner = "array_distinct(flatten(transform({0}, l -> transform(sequence(1, length(word) - l + 1), i -> substring(word, i, l)))))"
    every = (vocabulary.select(F.col("word").alias("found"), "n", "word", F.lit(WHOLE).alias("kind"))
             .unionByName(pieces(ENDS, f"transform({fitting.format(ENDS)}, l -> right(word, l))"))
             .unionByName(pieces(BEGINS, f"transform({fitting.format(BEGINS)}, l -> left(word, l))"))
             .unionByName(pieces(HOLDS, inner.format(fitting.format(HOLDS)))))
    every = sifted(every, "word, kind", sieve(wanted, "word, kind"))  # most pieces are no phrase's word
    return wanted.join(every, ["word", "kind"]).select("word", "kind", "found", "n")


def anchors(vocabulary: DataFrame, rules: DataFrame) -> DataFrame:
    """word, rule_id, k: the words that a rule waits for, and which word of its phrase they stand for.

    A phrase may begin with a letter that ends a tenth of the corpus's words, so what each word stands for is
    only counted, once for all rules; it is listed for the words that rules wait for.
    """
    wanted = phrase_words(rules)
    counts = written(matching_words(vocabulary, wanted.select("word", "kind").distinct()).groupBy("word", "kind").agg(F.sum("n").alias("n")), "word-counts")
    rarest = (wanted.join(counts, ["word", "kind"])
              .groupBy("rule_id").agg(F.min_by(F.struct("k", "word", "kind"), F.struct("n", "k")).alias("a"), F.count(F.lit(1)).alias("m")))
    whole = rules.select("rule_id", F.size(F.split("phrase", " ", -1)).alias("m"))
    chosen = written(rarest.join(whole, ["rule_id", "m"]).select("rule_id", "a.*"), "rarest-words")  # a phrase whose every word stands for some
    listed = matching_words(vocabulary, chosen.select("word", "kind").distinct())
    return chosen.join(listed, ["word", "kind"]).select(F.col("found").alias("word"), "rule_id", "k")


def _before(first: str) -> str:
    """The characters that are looked through before an occurrence at the word ``_i`` of ``_words``; ``first``: those of the word itself."""
    reach = LOOK_BACK_CHARS + 1  # words of the look-back, each at least a space
    earlier = f"array_join(slice(_words, greatest(1, _i - {reach - 1}), least(_i, {reach})), ' ')"
    return f"substring(concat({earlier}, CASE WHEN _i > 0 THEN ' ' ELSE '' END, {first}), -{LOOK_BACK_CHARS})"


def _numbers(values: list) -> str:
    """An ARRAY of integers, or of such arrays, as SQL."""
    return f"array({', '.join(_numbers(x) if isinstance(x, list) else str(x) for x in values)})"


def _across(index: DataFrame, phrases: DataFrame, key: list[str], negators: list[str]) -> DataFrame | None:
    """key..., phrase, found, asserted: a row for each place of a phrase of several words, and for few of no phrase."""
    several = phrases.select("phrase", F.split("phrase", " ", -1).alias("w")).where("size(w) > 1")
    lasts: dict[tuple[int, int], list[int]] = {}  # lengths of the last word by number of words and length of the first
    for r in several.selectExpr("length(w[0]) AS a", "size(w) AS m", "length(w[size(w) - 1]) AS b").distinct().orderBy("a", "m", "b").collect():
        lasts.setdefault((r.a, r.m), []).append(r.b)
    if not lasts:
        return None
    longest = max(a for a, _ in lasts)
    up_to = [sum(a <= n for a, _ in lasts) for n in range(longest + 1)]  # how many of them a word of n characters can begin
    second = "CASE WHEN {0} > 2 THEN {1} ELSE '' END"
    through = sieve(several.selectExpr("size(w) AS m", "w[0] AS first", f"{second.format('size(w)', 'w[1]')} AS second", "CAST(NULL AS STRING) AS phrase").distinct()
                    .unionByName(several.selectExpr("0 AS m", "'' AS first", "'' AS second", "phrase")), "m, first, second, phrase")
    begun = (index.select(*key, "_words", F.posexplode("_words").alias("_i", "_w"))
             .withColumn("_n", F.expr(f"get({_numbers(up_to)}, least(length(_w), {longest}))")).where("_n > 0")
             .withColumn("_s", F.explode(F.expr("sequence(0, _n - 1)")))
             .withColumns({name: F.expr(f"get({_numbers(x)}, _s)") for name, x in (
                 ("_a", [a for a, _ in lasts]), ("_m", [m for _, m in lasts]), ("_least", [x[0] for x in lasts.values()]))})
             .withColumn("_last", F.expr("get(_words, _i + _m - 1)")).where("length(_last) >= _least"))
    begun = sifted(begun, f"_m, right(_w, _a), {second.format('_m', 'get(_words, _i + 1)')}, CAST(NULL AS STRING)", through)
    whole = begun.withColumn("_b", F.explode(F.expr(f"get({_numbers(list(lasts.values()))}, _s)"))).where("_b <= length(_last)").withColumn(
        "_phrase", F.expr("concat(right(_w, _a), ' ', CASE WHEN _m > 2 THEN concat(array_join(slice(_words, _i + 2, _m - 2), ' '), ' ') ELSE '' END, left(_last, _b))"))
    found = sifted(whole, "0, '', '', _phrase", through)
    # an array of one keeps what follows apart, so that texts aren't copied for each place
    looked = found.select(*key, F.col("_phrase").alias("phrase"), F.explode(F.array(F.expr(_before("left(_w, length(_w) - _a)")))).alias("_before"))
    return looked.select(*key, "phrase", F.lit(1).alias("found"), F.expr(f"CAST({no_negator_in('_before', negators)} AS INT)").alias("asserted"))


def _inside(index: DataFrame, phrases: DataFrame, key: list[str], negators: list[str]) -> DataFrame | None:
    """key..., phrase, found, asserted: a row for each place of a word that holds a phrase of one word."""
    alone = phrases.where("NOT contains(phrase, ' ')")
    least = alone.agg(F.min(F.length("phrase"))).first()[0]
    if least is None:
        return None
    tokens = index.select(*key, "_words", F.posexplode("_words").alias("_i", "_w")).where(f"length(_w) >= {least}")
    vocabulary = written(tokens.groupBy(F.col("_w").alias("word")).agg(F.count(F.lit(1)).alias("n")), "vocabulary")
    waiting = written(anchors(vocabulary, alone), "anchors").select(F.col("word").alias("_w"), F.col("rule_id").alias("phrase"))
    places = sifted(tokens, "_w", sieve(waiting.select("_w").distinct(), "_w")).select(*key, "_w", F.explode(F.array(F.expr(_before("''")))).alias("_before"))
    judged = bind("split(_w, concat('\\\\Q', phrase, '\\\\E'), -1)", "ps", (
        "transform(sequence(1, size(ps) - 1), i -> "
        + free_of_negators(f"right(concat(_before, array_join(slice(ps, 1, i), phrase)), {LOOK_BACK_CHARS})", negators) + ")"))
    return (places.join(waiting, "_w").select(*key, "phrase", F.expr(judged).alias("_judged"))
            .select(*key, "phrase", F.size("_judged").alias("found"), F.size(F.filter("_judged", lambda x: x)).alias("asserted")))


def phrase_hits(texts: DataFrame, rules: DataFrame, key: list[str], text: str = "text", negators: list[str] = NEGATORS) -> DataFrame:
    """key..., rule_id, n_found, n_asserted for every text and rule (rule_id, phrase; rule_id distinct) whose phrase occurs in it.

    ``key`` names a text; null keys are a key like others. Texts that share a key
    are counted together. A null text holds nothing. Rules that aren't ``usable``
    find nothing. Starts jobs.
    """
    wanted = written(usable(written(rules.select("rule_id", "phrase"), "phrase-rules")), "usable-rules")
    phrases = wanted.select(F.col("phrase").alias("rule_id"), "phrase").distinct()  # each distinct phrase is searched once
    # written once: cut into words, each text is read from here
    index = written(words_of(texts.where(F.col(text).isNotNull()).select(*key, F.col(text).alias("text"))).withColumnRenamed("words", "_words"), "phrase-index")
    parts = [x for x in (_across(index, phrases, key, negators), _inside(index, phrases, key, negators)) if x is not None]
    if not parts:
        return index.join(wanted, F.lit(False)).select(*key, "rule_id", F.lit(0).cast("long").alias("n_found"), F.lit(0).cast("long").alias("n_asserted"))
    counted = reduce(DataFrame.unionByName, parts).groupBy(*key, "phrase").agg(F.sum("found").alias("n_found"), F.sum("asserted").alias("n_asserted"))
    return counted.join(wanted, "phrase").select(*key, "rule_id", "n_found", "n_asserted")
