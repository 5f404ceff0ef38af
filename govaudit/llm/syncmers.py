"""Document fingerprints of closed syncmers, in SQL expressions only.

A text's words are its stretches between white space (space, tab to carriage
return). Of its k-mers of ``K`` = 5 words those are anchors whose smallest
inner ``S``-mer (2 words, by hash) stands at the first or the last place: a
closed syncmer. Whether a k-mer is an anchor depends on its own words alone, so
equal passages have equal anchors wherever they stand, at the same distances
(``anchors`` gives the places). A text with fewer words, or none of whose
k-mers is closed, has one anchor, the hash of all its words; so has a null or
empty text, with no words.

A fingerprint is the ``SKETCH`` smallest distinct anchor hashes, each with its
first place (16 hex digits: 32 bits of hash, 31 of place). Of two fingerprints the
joint smallest hashes that both hold are matched by their places: a match counts
if the distance between its two places is that of the middle match, give or take
an eighth of the longer text (8 words at least). The likeness is the share of the
joint smallest hashes whose match counts: it estimates the share of anchors that
the texts have in common at like places, so a passage that moved as a whole, a text
with something put before it, stays alike, and one whose passages change places does
not. Equal texts have equal fingerprints and likeness 1.

"Next document" goes by ascending doc_id (null first, repeated ids by text),
the first one following the last. Ids are cut into ranges of ``RANGE``; a range
also gets the first document of the next range, so one shuffle by range serves
all, and no task sees more than a range. With one document, the next one is
itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, S, SKETCH, RANGE = 5, 2, 64, 1 << 11
#: An anchor is one number: its hash above ``PLACE`` bits, its place in them.
PLACE = 31


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _with_mers(text: str, body: str) -> str:
    """``body`` with h, the hashes of the words, and m, those of the S-mers (null at the end)."""
    words = f"filter(split(coalesce({text}, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"
    pairs = "zip_with(h, slice(h, 2, size(h)), (a, b) -> CASE WHEN b IS NOT NULL THEN xxhash64(a, b) END)"
    return _let(f"transform({words}, w -> xxhash64(w))", "h", _let(pairs, "m", body))


# of the 4 pairs in 5 words, the smallest is the first or the last (a tie counts for the edge)
_CLOSED = "least(x, m[i + 3]) <= least(m[i + 1], m[i + 2])"
# three pairs name the five words
_HASH = "shiftrightunsigned(xxhash64(x, m[i + 2], m[i + 3]), 32)"


def _anchors(entry: str, whole: str) -> str:
    """SQL: ``entry`` of each closed k-mer (x is the pair at word i), or ``whole`` alone where there is none."""
    closed = f"filter(transform(slice(m, 1, size(h) - {K - 1}), (x, i) -> CASE WHEN {_CLOSED} THEN {entry} END), y -> y IS NOT NULL)"
    found = _let(closed, "f", f"CASE WHEN size(f) > 0 THEN f ELSE array({whole}) END")
    return f"CASE WHEN size(h) < {K} THEN array({whole}) ELSE {found} END"


_WHOLE = "shiftrightunsigned(xxhash64(h), 32)"


def anchor_numbers(text: str) -> str:
    """SQL: all anchors of a text as numbers of hash and place, in order."""
    return _with_mers(text, _anchors(f"shiftleft({_HASH}, {PLACE}) | CAST(i AS BIGINT)", f"shiftleft({_WHOLE}, {PLACE})"))


def anchors(docs: DataFrame) -> DataFrame:
    """One row per anchor of ``docs`` (doc_id, text): doc_id, word (its first word's place from 0), hash."""
    places = _anchors(f"named_struct('word', i, 'hash', {_HASH})", f"named_struct('word', 0, 'hash', {_WHOLE})")
    return docs.select("doc_id", F.expr(f"inline({_with_mers('text', places)})"))


def sketch(text: str) -> str:
    """SQL: the anchors of smallest hash, ascending, each hash with its first place."""
    first = f"filter(e, (y, j) -> j = 0 OR shiftright(y, {PLACE}) <> shiftright(get(e, j - 1), {PLACE}))"
    return f"slice({_let(f'sort_array({anchor_numbers(text)})', 'e', first)}, 1, {SKETCH})"


def fingerprint(sketch_column: str) -> str:
    """SQL: a sketch as text."""
    return f"concat_ws('', transform({sketch_column}, x -> lpad(lower(hex(x)), 16, '0')))"


def likeness(a: str, b: str) -> str:
    """SQL: the share of the joint smallest hashes that both sketches hold at like places."""
    def place(of: str, hashes: str) -> str:
        return f"(element_at({of}, CAST(array_position({hashes}, x) AS INT)) & {2**PLACE - 1})"

    def last(of: str) -> str:
        return f"array_max(transform({of}, x -> x & {2**PLACE - 1}))"

    # twice the distance of the middle match, and how far others may be from it
    middle = "(get(o, (size(o) - 1) div 2) + get(o, size(o) div 2))"
    counted = f"size(filter(o, y -> abs(2 * y - {middle}) <= 2 * greatest(8, greatest({last(a)}, {last(b)}) div 8)))"
    offsets = f"sort_array(transform(c, x -> {place(a, 'p')} - {place(b, 'q')}))"
    share = f"CASE WHEN size(c) = 0 THEN 0D ELSE CAST({_let(offsets, 'o', counted)} AS DOUBLE) / size(u) END"
    matched = _let(f"slice(sort_array(array_union(p, q)), 1, {SKETCH})", "u", _let("array_intersect(u, array_intersect(p, q))", "c", share))
    return _let(f"transform({a}, x -> shiftright(x, {PLACE}))", "p", _let(f"transform({b}, x -> shiftright(x, {PLACE}))", "q", matched))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with key, range and guest: each range followed by the first
    document of the next one, as a guest."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                        F.expr("coalesce(CAST(doc_id AS BIGINT), -9223372036854775808)").alias("key"))
    width = RANGE.bit_length() - 1
    ranged = keyed.withColumn("range", F.expr(f"shiftright(key, {width})"))
    # one row per range: its first key, and the range before it (before the first: the last)
    firsts = ranged.groupBy("range").agg(F.min("key").alias("key"))
    whole = Window.orderBy("range")
    last = F.max("range").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    guests = firsts.select("key", F.coalesce(F.lag("range").over(whole), last).alias("host"))
    return (ranged.join(guests, "key", "left")
            .withColumn("place", F.expr("explode(filter(array(named_struct('range', range, 'guest', 0), named_struct('range', host, 'guest', 1)), "
                                        "x -> x.range IS NOT NULL))"))
            .select("doc_id", "text", "key", F.col("place.range").alias("range"), F.col("place.guest").alias("guest")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): doc_id, n_chars, the edited text, the
    sketches of both texts and of the next document."""
    order = Window.partitionBy("range").orderBy("guest", "key", "text")
    edited = with_next(docs).withColumn("next", F.lead("text").over(order)).select(
        "doc_id", "text", "key", "range", "guest", F.length("text").alias("n_chars"),
        F.expr("concat(substring(text, 1, length(text) - length(text) div 2), substring(coalesce(next, ''), 1, CAST(length(text) div 2 AS INT)))").alias("edited"))
    sketched = edited.select("*", F.expr(sketch("text")).alias("sketch"), F.expr(sketch("edited")).alias("edited_sketch"))
    return (sketched.withColumn("next_sketch", F.lead("sketch").over(order)).where("guest = 0")
            .select("doc_id", "n_chars", "edited", "sketch", "edited_sketch", "next_sketch"))
