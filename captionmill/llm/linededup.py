"""Line dedup: an exact set-similarity join over lines, in DataFrame operations.

Lines with a word are sets of words. Copies of a line become one class first,
stood for by the earliest line in (doc_id, line number). The words of a class
are ordered by rarity; two sets that are similar enough share a word among
their first few, so classes meet on those prefix words alone, under the length
filter, the positional filter and a bound from parity sketches: bit i of a
sketch tells whether an odd number of words hash to i, so sketches differ in no
more bits than the sets do in words.

The join runs in three steps, so that a family of near copies never becomes
all its pairs:

1. A semi-join leaves the prefix words (of a line) under which some other line
   passes all filters; lines without any are done.
2. Each line left is verified against one head, the earliest line that it meets
   under most of its words.
3. Lines that no head has removed are verified against every earlier line that
   they meet.

Verification compares the words themselves. A line that matches an earlier one
is removed, whether that one is removed or not, and any earlier match will do,
so the steps give what a comparison of all pairs gives.

Rarity comes from the counts of all words, kept in ``PLACES`` places by hash and
brought to the join as one array of that fixed size. Any order of words gives
the same result; rarity makes it fast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionmill.llm.common import SPACE, release, stored

PLACES, WIDE = 1 << 18, 80
_ROOM = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"
#: What names a line: its document, a hash of the text where an id repeats, its number.
_LINE = ["doc_id", "tag", "line"]
_EARLIER, _LATER = [f"a_{c}" for c in _LINE], [f"b_{c}" for c in _LINE]


def _plain(text: Column) -> Column:
    """``text`` with a blank for every other white space within a line, so that
    it can be split at one character."""
    out, other = text, F.lit(False)
    for c in "\t\x0b\x0c\r":
        out, other = F.replace(out, F.lit(c), F.lit(" ")), other | F.contains(text, F.lit(c))
    return F.when(other, out).otherwise(text)


def _has_word(line: Column) -> Column:
    return F.ltrim(line, F.lit(SPACE)) != ""


def _lines(rows: DataFrame) -> DataFrame:
    """Lines with a word: doc_id, tag, number and text."""
    return rows.select("doc_id", "tag", F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("line", "w")).where(_has_word(F.col("w")))


def _counts(rows: DataFrame) -> DataFrame:
    """The number of words of all texts in each place that has any; as lines do
    not matter here, texts are split once."""
    text = F.replace(_plain(F.col("text")), F.lit("\n"), F.lit(" "))
    word = rows.select(F.explode(F.split(text, " ")).alias("w")).where("w <> ''")
    return word.groupBy(F.xxhash64("w").bitwiseAND(F.lit(PLACES - 1)).alias("id")).agg(F.count("*").alias("n"))


def _rarity(rows: DataFrame) -> Column:
    """An array: for each place, twice the binary logarithm of the number of
    words there, over all rows."""
    spark = rows.sparkSession
    every = spark.range(PLACES).join(_counts(rows), "id", "left").select("id", F.coalesce(F.floor(2 * F.log2("n")), F.lit(0)).alias("r"))
    whole = every.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "r"))), lambda x: x["r"]), ","))
    before = spark.conf.get(_ROOM, None)
    spark.conf.set(_ROOM, str(PLACES.bit_length() - 1))  # the quick map of the counts has room for all places
    try:
        line = whole.first()[0]
    finally:
        spark.conf.unset(_ROOM) if before is None else spark.conf.set(_ROOM, before)
    return F.split(F.lit(line), ",").cast("array<bigint>")


def line_classes(rows: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """Classes of equal lines, whatever the kind of their white space, of
    ``rows`` (doc_id, tag, text; no row twice): the line that
    stands for each, its number of words ``n``, parity sketches and prefix."""
    rarity = _rarity(rows)
    lines = _lines(rows)
    distinct = F.array_except(F.transform(F.split("w", " "), lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit(""))))
    # Without nulls, so that the keys are sorted as numbers.
    key = lambda h: F.coalesce(F.shiftleft(F.get(rarity, h.bitwiseAND(F.lit(PLACES - 1))), 56).bitwiseOR(F.shiftrightunsigned(h, 8)), h)
    sets = lines.select(*_LINE, F.xxhash64("w").alias("h"), F.xxhash64(F.lit(1), "w").alias("g"), F.sort_array(F.transform(distinct, key)).alias("keys"))
    parity = lambda keys: F.expr(f"aggregate({keys}, 0L, (b, k) -> b ^ shiftleft(1L, cast(k & 63 AS int)))")
    sketched = sets.select(
        *_LINE, "h", "g", F.size("keys").alias("n"), parity("keys").alias("bits"),
        F.when(F.size("keys") > WIDE, parity("filter(keys, k -> k & 64 <> 0)")).otherwise(F.lit(0)).alias("more"),
        F.expr(f"slice(keys, 1, size(keys) - cast((size(keys) * {num}L + {den - 1}) div {den} AS int) + 1)").alias("prefix"),
    )
    return sketched.groupBy("h", "g").agg(F.min(F.struct(*_LINE, "n", "bits", "more", "prefix")).alias("first")).select("first.*")


def _posts(classes: DataFrame, num: int, den: int) -> DataFrame:
    """The prefix words of lines. ``most`` is how many words a similar line can
    have that meets the line there, as J >= num/den is the same as
    overlap * (num + den) >= num * (|a| + |b|), and the overlap is no more than
    the words from there on."""
    words = classes.select(*_LINE, "n", "bits", "more", F.posexplode("prefix").alias("k", "key"))
    return words.select(*_LINE, "n", "bits", "more", "key", F.expr(f"cast(((n - k) * {num + den}L - n * {num}L) div {num} AS int)").alias("most"))


def _near(num: int, den: int) -> Column:
    """The filters on two prefix words of lines a and b: length and place, then
    sketches."""
    return F.expr(f"""a.key = b.key AND a.n <= b.most AND b.n <= a.most
        AND CASE WHEN a.n > {WIDE} AND b.n > {WIDE} THEN bit_count(a.bits ^ a.more ^ b.bits ^ b.more) + bit_count(a.more ^ b.more)
            ELSE bit_count(a.bits ^ b.bits) END * {num + den}L <= {den - num}L * (a.n + b.n)""")


def _verified(pairs: DataFrame, words: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` whose words are that similar."""
    side = lambda s: words.select(*[F.col(c).alias(f"{s}_{c}") for c in (*_LINE, "words")])
    both = pairs.join(side("a"), _EARLIER).join(side("b"), _LATER)
    alike = F.size(F.array_intersect("a_words", "b_words")) * (num + den) >= num * (F.size("a_words") + F.size("b_words"))
    return both.where(alike).select(*_EARLIER, *_LATER)


def line_matches(rows: DataFrame, classes: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """For each line of ``classes`` (see ``line_classes``) with a Jaccard
    similarity of num/den or more to an earlier one, such lines: a_doc_id,
    a_tag and a_line of the earlier, b_doc_id, b_tag and b_line of the later.
    At least one match is told of each line that has any, not all."""
    posts = _posts(classes, num, den)
    other = F.expr("a.line <> b.line OR a.doc_id <> b.doc_id OR a.tag <> b.tag")
    met = stored(posts.alias("a").join(posts.alias("b"), _near(num, den) & other, "left_semi"), "line-met")

    lines = met.groupBy("doc_id", "tag").agg(F.collect_set("line").alias("at"))
    word_list = lambda line: F.array_distinct(F.array_remove(F.split(line, " "), ""))
    held = rows.join(lines, ["doc_id", "tag"]).select("doc_id", "tag", "at", F.split(_plain(F.col("text")), "\n").alias("lines"))
    told = held.select("doc_id", "tag", F.explode(F.transform("at", lambda i: F.struct(i.alias("line"), F.get("lines", i).alias("w")))).alias("x"))
    words = stored(told.select("doc_id", "tag", "x.line", word_list(F.col("x.w")).alias("words")), "line-words")

    own, later = F.struct(*[F.col(c).alias(a) for a, c in zip(_EARLIER, _LINE)]), [F.col(c).alias(b) for b, c in zip(_LATER, _LINE)]
    heads = stored(met.groupBy("key").agg(F.min(own).alias("head")), "line-heads")
    often = met.join(heads, "key").where(F.col("head") != own).groupBy(*later, "head").agg(F.count("*").alias("n"))
    best = often.groupBy(*_LATER).agg(F.max(F.struct("n", "head")).alias("x")).select("x.head.*", *_LATER)
    first = stored(_verified(best, words, num, den), "line-matches")

    left = met.join(first.select(*[F.col(b).alias(c) for b, c in zip(_LATER, _LINE)]).distinct(), _LINE, "left_anti").select(*met.columns)
    before = F.expr("struct(a.doc_id, a.tag, a.line) < struct(b.doc_id, b.tag, b.line)")
    both = met.alias("a").join(left.alias("b"), _near(num, den) & before)
    pairs = both.select(*[F.col(f"a.{c}").alias(x) for x, c in zip(_EARLIER, _LINE)], *[F.col(f"b.{c}").alias(x) for x, c in zip(_LATER, _LINE)]).distinct()
    second = stored(_verified(pairs, words, num, den), "line-matches")
    release(met, words, heads)
    return first.unionByName(second)


def dedup_lines(docs: DataFrame, num: int = 4, den: int = 5, carry: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines (lines with a word), n_copies (of
    them removed as copies of an earlier line), n_near (removed as similar to
    one) and text, without the removed lines.

    Lines without a word stay and match nothing. A null text counts as empty and
    stays null. Rows with a null doc_id have no place in the order and stay as
    they are. Rows alike in doc_id and text count once and come out alike;
    rows that share a doc_id but not the text are documents of their own,
    ordered by a hash of the text. An empty table gives an empty result.
    """
    row = F.struct(*[docs[c] for c in docs.columns if c != "text"]) if carry else F.lit(None)
    every = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], row.alias("row"))
    repeats = _repeats(every)
    every = every.withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))) if repeats else F.lit(0).cast("long"))
    rows = every.where("doc_id IS NOT NULL").select("doc_id", "tag", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.dropDuplicates(["doc_id", "tag"]) if repeats else rows
    classes = stored(line_classes(rows, num, den), "line-classes")
    matches = line_matches(rows, classes, num, den)
    marks = classes.select(*_LINE, F.lit(False).alias("near")).unionByName(matches.select(*[F.col(b).alias(c) for b, c in zip(_LATER, _LINE)], F.lit(True).alias("near")))
    by_doc = marks.groupBy("doc_id", "tag").agg(*[F.collect_set(F.when(F.col("near") == x, F.col("line"))).alias(c) for c, x in (("at", False), ("gone", True))])
    told = stored(by_doc.select("doc_id", "tag", F.size("at").alias("n_rep"), F.size("gone").alias("n_near"), F.array_except("at", "gone").alias("stay")), "line-told")
    release(classes)
    # Two tables with a row for each document: no key is large but that of copies of one row.
    own = every.join(told, ["doc_id", "tag"], "left").withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    long = own.withColumn("worded", F.filter(F.transform("lines", lambda x, i: F.when(_has_word(x), i)), lambda i: i.isNotNull()))
    gone = long.withColumn("gone", F.array_except("worded", F.coalesce("stay", F.expr("cast(array() AS array<int>)"))))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.get("lines", i))
    n, in_order = F.size("worded").cast("long"), F.col("doc_id").isNotNull()
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return gone.select(
        "doc_id", n.alias("n_lines"), F.when(in_order, n - count("n_rep")).otherwise(0).alias("n_copies"), count("n_near").alias("n_near"),
        F.when(in_order & F.col("text").isNotNull() & (F.size("gone") > 0), F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text"), *(["row"] if carry else []),
    )


def without_repeated_lines(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` with shortened texts, under its own columns. A document whose
    last word goes with its lines goes as well; one that had no word stays.
    ``n_chars``, where there is such a column, follows the text. Nulls, empty
    texts and repeated rows are held as in ``dedup_lines``."""
    done = dedup_lines(docs, num, den, carry=True)
    done = done.where((F.col("n_copies") + F.col("n_near") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    kinds = dict(docs.dtypes)
    return done.select(*[(new[c].cast(kinds[c]) if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


def _repeats(rows: DataFrame) -> bool:
    """Whether any doc_id stands in several rows."""
    return not rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
