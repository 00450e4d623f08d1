"""Scoring of segments against expected texts: recall, precision, noise,
spatial spread, pooled summaries and the comparison of two model sets.

Expected texts and segments meet per video (an equi-join) and then under the
time window; similarity is computed on what is left. Ratios have the value the
definition gives for empty denominators, never an error.
"""

from __future__ import annotations

import itertools
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionmill.functions import similarity
from captionmill.functions.text import in_window
from captionmill.operators.stored import stored
from captionmill.schema import BOTH, ON_SCREEN

#: Fixed values of the evaluation.
NEAR_MISS, MAX_SPAN, JUNK_SECONDS, MARGIN, EPS, LANGUAGES = 0.50, 2.0, 1.5, 0.02, 1e-9, ("en", "de", "fr", "es", "pt")


#: Seconds of a stretch of time in which segments and expected texts are paired.
BUCKET = 60.0


def share(part, whole, empty: float) -> Column:
    p, w = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
    return F.when(w > 0, p / F.greatest(w, F.lit(1))).otherwise(F.lit(empty))


def _met(s: DataFrame, e: DataFrame) -> DataFrame:
    """Rows of ``s`` (s_start, s_end) within the windows of ``e`` (gt_start, gt_end) of their video."""
    # Closed windows meet segments in a common stretch of time; open ones meet the whole video.
    closed = F.col("gt_start").isNotNull() & F.col("gt_end").isNotNull() & (F.col("gt_start") <= F.col("gt_end"))
    cut = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BUCKET), F.floor(F.greatest(a, b) / BUCKET)))
    once = F.floor(F.greatest("s_start", "gt_start") / BUCKET) == F.col("bucket")
    met = s.withColumn("bucket", cut("s_start", "s_end")).join(e.where(closed).withColumn("bucket", cut("gt_start", "gt_end")), ["video_id", "bucket"]).where(once).drop("bucket")
    every = met.unionByName(s.join(e.where(~closed), "video_id"))
    return every.where(in_window("s_start", "s_end", "gt_start", "gt_end"))


def _alike(sides: str, *names: str) -> Column:
    """Equal in columns ``names`` of two aliases of a letter each; nulls are alike."""
    a, b = sides
    return reduce(and_, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])


def candidates(segments: DataFrame, texts: DataFrame, sought: DataFrame) -> DataFrame:
    """What stands within the window of each expected text (gid, gt_tid): texts
    (tid) by start, with the number of segments ``n`` and the three least ``seq``
    of them, ``ids``. Nothing below asks for more, since at most three segments make
    a candidate and the least ones go first. ``texts`` (tid, text); ``sought``:
    classes of like expected texts."""
    at = ["video_id", "start", "end", "text"]
    own = Window.partitionBy(*at)
    ranked = segments.select(*at, "seq", F.count("*").over(own).alias("n"), F.dense_rank().over(own.orderBy("seq")).alias("nth")).where("nth <= 3")
    classes = ranked.groupBy(*at).agg(F.array_sort(F.collect_set("seq")).alias("ids"), F.max("n").alias("n"))
    s = classes.alias("c").join(texts.alias("t"), _alike("ct", "text")).select("video_id", F.col("start").alias("s_start"), F.col("end").alias("s_end"), "tid", "ids", "n")
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, 3)
    return _met(s, sought.drop("gt_text")).groupBy("gid", "gt_tid", "tid", "s_start").agg(least.alias("ids"), F.sum("n").alias("n"))


def matches(segments: DataFrame, expected: DataFrame, threshold: float = 0.85, ratio=similarity.ratio) -> DataFrame:
    """Segments that match some expected text: (video_id, seq), a semi join.
    Segments and expected texts alike in time and text meet once, the bound by
    length goes first, and each pair of texts is compared once."""
    s = segments.select("video_id", F.col("start").alias("s_start"), F.col("end").alias("s_end"), F.col("text").alias("s_text")).distinct()
    e = expected.select("video_id", F.col("start").alias("gt_start"), F.col("end").alias("gt_end"), F.col("text").alias("gt_text")).distinct()
    met = _met(s, e).where(similarity.ratio_bound("s_text", "gt_text") >= threshold)
    near = stored(met.select("video_id", "s_start", "s_end", "s_text", "gt_text").distinct(), "near-texts")
    told = near.select("s_text", "gt_text").distinct().withColumn("sim", ratio(F.col("s_text"), F.col("gt_text"))).where(F.col("sim") >= threshold)
    hit = near.join(told, ["s_text", "gt_text"]).select("video_id", F.col("s_start").alias("start"), F.col("s_end").alias("end"), F.col("s_text").alias("text")).distinct()
    return segments.alias("x").join(hit.alias("y"), _alike("xy", "video_id", "start", "end", "text"), "left_semi").select("video_id", "seq").distinct()


def unmatched(segments: DataFrame, expected: DataFrame, threshold: float = 0.85, ratio=similarity.ratio) -> DataFrame:
    on_screen = segments.where(F.col("source").isin(ON_SCREEN, BOTH))
    return on_screen.join(matches(on_screen, expected, threshold, ratio), ["video_id", "seq"], "left_anti")


def junk(segments: DataFrame, expected: DataFrame, threshold: float = 0.85, ratio=similarity.ratio, seconds: float = JUNK_SECONDS) -> DataFrame:
    """The older notion of noise, which spares long segments."""
    return unmatched(segments, expected, threshold, ratio).where(F.col("end") - F.col("start") < seconds)


def _of_texts(rows: DataFrame, texts: DataFrame, *names: str) -> DataFrame:
    """``rows`` with the texts of ids ``names``, under these names and ``_text``."""
    for n in names:
        rows = rows.join(texts.select(F.col("tid").alias(n), F.col("text").alias(f"{n}_text")), n)
    return rows


def single_matches(near: DataFrame, texts: DataFrame, ratio=similarity.ratio) -> DataFrame:
    """Best segment for each expected text and the number of segments: the first of the best."""
    own = near.groupBy("gid", "gt_tid", "tid").agg(F.min(F.get("ids", F.lit(0))).alias("seq"), F.sum("n").alias("n"))
    sims = _of_texts(near.select("gt_tid", "tid").distinct(), texts, "gt_tid", "tid")
    sims = sims.select("gt_tid", "tid", F.col("tid_text").alias("text"), ratio(F.col("tid_text"), F.col("gt_tid_text")).alias("sim"))
    return own.join(sims, ["gt_tid", "tid"]).groupBy("gid").agg(F.sum("n").alias("n"), F.max_by(F.struct("sim", "text"), F.struct("sim", F.negative("seq"))).alias("one"))


def pair_matches(near: DataFrame, texts: DataFrame, ratio=similarity.ratio) -> DataFrame:
    """Best two segments for each expected text, in either order, that start
    at most MAX_SPAN apart: the first of the best in order of the pair. The least
    pair of segments stands for each pair of texts, which is compared once.
    ``seq`` names one segment of a video."""
    slot = F.floor(F.col("s_start") / MAX_SPAN)  # partners start in the same slot or a neighbouring one
    first = F.get("ids", F.lit(0))
    starts = near.select("gid", F.col("s_start").alias("sa")).distinct().withColumn("slot", F.floor(F.col("sa") / MAX_SPAN))
    about = near.select("gid", F.col("tid").alias("tb"), F.col("s_start").alias("sb"), "ids", F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    # The first segment of each text about each start. It is the partner of a segment of another text that comes
    # before it; where it comes first itself, that pair, or a lesser one, is found from its own side.
    firsts = starts.join(about, ["gid", "slot"]).where(F.abs(F.col("sb") - F.col("sa")) <= MAX_SPAN).groupBy("gid", "sa", "tb")
    firsts = firsts.agg(F.min(first).alias("j"), F.min_by("sb", first).alias("sj"))
    a = near.select("gid", "gt_tid", F.col("tid").alias("ti"), F.col("s_start").alias("sa"), first.alias("i"), F.get("ids", F.lit(1)).alias("next"))
    others = a.join(firsts.withColumnRenamed("tb", "tj"), ["gid", "sa"]).where("ti <> tj AND i < j").select("gid", "gt_tid", "ti", "tj", "i", "j", "sa", "sj")
    own = a.withColumn("slot", F.floor(F.col("sa") / MAX_SPAN)).join(about.select("gid", F.col("tb").alias("ti"), "sb", first.alias("b1"), "slot"), ["gid", "ti", "slot"])
    own = own.where(F.abs(F.col("sb") - F.col("sa")) <= MAX_SPAN).withColumn("j", F.expr("CASE WHEN sa = sb THEN next ELSE b1 END")).where("i < j")
    own = own.groupBy("gid", "gt_tid", "ti", "i", "sa").agg(F.min("j").alias("j"), F.min_by("sb", "j").alias("sj")).select("gid", "gt_tid", "ti", F.col("ti").alias("tj"), "i", "j", "sa", "sj")
    # No two rows of a group share ``i``, so the least pair is that of the least ``i``.
    least = others.unionByName(own).groupBy("gid", "gt_tid", "ti", "tj")
    pairs = stored(least.agg(F.min("i").alias("i"), F.min_by("j", "i").alias("j"), F.min_by("sa", "i").alias("si"), F.min_by("sj", "i").alias("sj")), "pairs")
    known = _of_texts(pairs.select("gt_tid", F.least("ti", "tj").alias("lo"), F.greatest("ti", "tj").alias("hi")).distinct(), texts, "gt_tid", "lo", "hi")
    both = lambda a, b: ratio(F.concat_ws(" ", f"{a}_text", f"{b}_text"), F.col("gt_tid_text"))
    sims = known.select("gt_tid", "lo", "hi", both("lo", "hi").alias("up"), both("hi", "lo").alias("down"))
    x, y = F.expr("CASE WHEN ti = lo THEN up ELSE down END"), F.expr("CASE WHEN ti = lo THEN down ELSE up END")
    told = pairs.withColumns({"lo": F.least("ti", "tj"), "hi": F.greatest("ti", "tj")}).join(sims, ["gt_tid", "lo", "hi"]).select("gid", "gt_tid", F.greatest("up", "down").alias("sim"), (x >= y).alias("ahead"), "i", "j", "ti", "tj", "si", "sj")
    best = told.groupBy("gid", "gt_tid").agg(F.max_by(F.struct("sim", "ahead", "i", "j", "ti", "tj", "si", "sj"), F.struct("sim", F.negative("i"), F.negative("j"))).alias("p")).where("p.sim > 0")
    full = _of_texts(best.select("gid", "gt_tid", "p.*"), texts, "ti", "tj")
    text = F.when(F.col("ahead"), F.concat_ws(" ", "ti_text", "tj_text")).otherwise(F.concat_ws(" ", "tj_text", "ti_text"))
    return full.select("gid", F.struct("sim", text.alias("text"), "i", "j", "gt_tid", "ti", "tj", "si", "sj").alias("pair"))


def triple_matches(near: DataFrame, pairs: DataFrame, texts: DataFrame, ratio=similarity.ratio) -> DataFrame:
    """Best extension of each best pair by a third segment, all within
    MAX_SPAN, in any of the six orders."""
    known = pairs.select("gid", "pair.i", "pair.j", "pair.ti", "pair.tj", "pair.si", "pair.sj")
    three = near.join(known, "gid").where(F.greatest("s_start", "si", "sj") - F.least("s_start", "si", "sj") <= MAX_SPAN)
    three = three.withColumn("k", F.expr("get(filter(ids, x -> x <> i AND x <> j), 0)")).where("k IS NOT NULL")
    least = three.groupBy("gid", "gt_tid", "i", "j", "ti", "tj", "tid").agg(F.min("k").alias("k"))
    names = ["gt_tid", "ti", "tj", "tid"]
    orders = F.array(*[F.concat_ws(" ", *p) for p in itertools.permutations(["tid_text", "ti_text", "tj_text"])])
    each = _of_texts(least.select(*names).distinct(), texts, *names).select(*names, "gt_tid_text", F.posexplode(orders).alias("nth", "joined"))
    each = each.withColumn("sim", ratio(F.col("joined"), F.col("gt_tid_text")))
    sims = each.groupBy(*names).agg(F.max_by(F.struct("sim", F.col("joined").alias("text")), F.struct("sim", F.negative("nth"))).alias("x")).select(*names, "x.*")
    row = F.struct("sim", "text", "i", "j", "k")
    best = least.join(sims, names).groupBy("gid").agg(F.max_by(row, F.struct("sim", F.negative("k"))).alias("triple"))
    return best.where("triple.sim > 0")


def per_text(segments: DataFrame, expected: DataFrame, threshold: float = 0.85, ratio=similarity.ratio) -> DataFrame:
    """Per expected text: best candidate and similarity (single segment, then
    pair, then triple, each only if strictly better), the indices that a pair
    or triple used, matched and near_miss. Expected rows that share a text get
    the last one's result.

    Expected rows alike in text and window are one class, and texts go by ids, so
    that what recurs is joined and compared once."""
    numbered = lambda rows, n: rows.withColumn(n, F.monotonically_increasing_id())
    texts = stored(numbered(segments.select("text").union(expected.select("text")).distinct(), "tid"), "texts")
    classes = numbered(expected.select("video_id", F.col("text").alias("gt_text"), F.col("start").alias("gt_start"), F.col("end").alias("gt_end")).distinct(), "gid")
    ids = texts.select(F.col("tid").alias("gt_tid"), F.col("text").alias("gt_text"))
    sought = stored(classes.alias("c").join(ids.alias("t"), _alike("ct", "gt_text")).select("c.*", "gt_tid"), "sought")
    near = stored(candidates(segments, texts, sought), "candidates")  # singles, pairs and triples read it
    none = F.lit(None).cast("string")
    one = F.when(F.col("one.sim") > 0, F.col("one")).otherwise(F.struct(F.lit(0.0).alias("sim"), none.alias("text")))
    told = single_matches(near, texts, ratio).withColumn("one", one).join(pair_matches(near, texts, ratio), "gid", "left")
    by_pair = F.coalesce(F.col("pair.sim") > F.col("one.sim"), F.lit(False))
    told = told.withColumn("by_pair", by_pair).withColumn("sim", F.when(by_pair, F.col("pair.sim")).otherwise(F.col("one.sim"))).withColumn("text", F.when(by_pair, F.col("pair.text")).otherwise(F.col("one.text")))
    told = stored(told, "pairs-told")
    open_ = told.where(F.col("by_pair") & (F.col("sim") < threshold) & (F.col("n") >= 3)).select("gid", "pair")
    told = told.join(triple_matches(near, open_, texts, ratio), "gid", "left")
    by_three = F.coalesce(F.col("triple.sim") > F.col("sim"), F.lit(False))
    used = F.when(by_three, F.array_sort(F.array("triple.i", "triple.j", "triple.k"))).when(F.col("by_pair"), F.array("pair.i", "pair.j")).otherwise(F.array().cast("array<bigint>"))
    told = told.select("gid", used.alias("used"), F.when(by_three, F.col("triple.text")).otherwise(F.col("text")).alias("best_candidate"), F.when(by_three, F.col("triple.sim")).otherwise(F.col("sim")).alias("similarity"))
    rows = expected.select("video_id", "gt_seq", F.col("text").alias("gt_text"), "required", F.col("start").alias("gt_start"), F.col("end").alias("gt_end"))
    every = rows.alias("e").join(sought.alias("c"), _alike("ec", "video_id", "gt_text", "gt_start", "gt_end")).select("e.video_id", "gt_seq", F.col("e.gt_text").alias("expected_text"), "required", "gid").join(told, "gid", "left")
    last = F.max_by(F.struct(F.coalesce("used", F.array().cast("array<bigint>")).alias("used"), "best_candidate", F.coalesce("similarity", F.lit(0.0)).alias("similarity")), "gt_seq").over(Window.partitionBy("video_id", "expected_text"))
    out = every.select("video_id", "gt_seq", "expected_text", "required", last.alias("r")).select("video_id", "gt_seq", "expected_text", "required", "r.*")
    return out.withColumn("matched", F.col("similarity") >= threshold).withColumn("near_miss", (F.col("similarity") >= NEAR_MISS) & (F.col("similarity") < threshold))


def score(segments: DataFrame, expected: DataFrame, threshold: float = 0.85, ratio=similarity.ratio) -> DataFrame:
    """Per video: recall over required texts, precision over segments, mean
    similarity of matched required texts (null without any)."""
    texts = stored(per_text(segments, expected, threshold, ratio), "per-text")
    needed, found = F.count_if("required"), F.count_if(F.col("required") & F.col("matched"))
    recall = texts.groupBy("video_id").agg(share(found, needed, 1.0).alias("recall"), F.avg(F.when(F.col("required") & F.col("matched"), F.col("similarity"))).alias("mean_match_similarity"))
    by_use = texts.where("matched").select("video_id", F.explode("used").alias("seq"))
    hit = matches(segments, expected, threshold, ratio).unionByName(by_use).distinct().groupBy("video_id").agg(F.count("*").alias("hit"))
    n = segments.groupBy("video_id").agg(F.count("*").alias("n"))
    all_ = recall.join(n, "video_id", "full").join(hit, "video_id", "left")
    return all_.select("video_id", F.coalesce("recall", F.lit(1.0)).alias("recall"), share(F.coalesce("hit", F.lit(0)), F.coalesce("n", F.lit(0)), 1.0).alias("precision"), "mean_match_similarity")


def retained_recall(segments: DataFrame, expected: DataFrame, threshold: float = 0.85, ratio=similarity.ratio) -> DataFrame:
    """Per video, the share of required appearances with a matching segment; a
    text without appearances counts once, within its own window."""
    window = F.struct("start", "end")
    each = F.when(F.size(F.coalesce("appearances", F.array().cast("array<struct<start:double,end:double>>"))) > 0, F.col("appearances")).otherwise(F.array(window))
    shown = expected.where("required").select("video_id", "gt_seq", "text", F.posexplode(each).alias("nth", "w"))
    s = segments.select("video_id", F.col("start").alias("s_start"), F.col("end").alias("s_end"), F.col("text").alias("s_text"))
    near = shown.join(s, "video_id").where(in_window("s_start", "s_end", "w.start", "w.end") & (similarity.ratio_bound("s_text", "text") >= threshold))
    hit = near.where(ratio(F.col("s_text"), F.col("text")) >= threshold).select("video_id", "gt_seq", "nth").distinct().withColumn("hit", F.lit(1))
    told = shown.join(hit, ["video_id", "gt_seq", "nth"], "left")
    return told.groupBy("video_id").agg((F.count("hit") / F.count("*")).alias("retained_overlay_recall"))


def noise(segments: DataFrame, expected: DataFrame, threshold: float = 0.85, ratio=similarity.ratio) -> DataFrame:
    """Per video: on-screen rows, junk and unmatched counts and rates, and
    retained recall (1 without required texts)."""
    rows = segments.where(F.col("source").isin(ON_SCREEN, BOTH))
    bad = unmatched(segments, expected, threshold, ratio).select("video_id", "seq", F.lit(True).alias("bad"))
    told = rows.join(bad, ["video_id", "seq"], "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    short = F.col("bad") & (F.col("end") - F.col("start") < JUNK_SECONDS)
    sums = told.groupBy("video_id").agg(F.count("*").alias("total_segments"), F.count_if(short).alias("junk_count"), F.count_if("bad").alias("unmatched_count"))
    both = sums.join(retained_recall(segments, expected, threshold, ratio), "video_id", "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = both.select("video_id", zero("total_segments"), zero("junk_count"), zero("unmatched_count"), F.coalesce("retained_overlay_recall", F.lit(1.0)).alias("retained_overlay_recall"))
    return out.withColumn("junk_rate", share("junk_count", "total_segments", 0.0)).withColumn("unmatched_rate", share("unmatched_count", "total_segments", 0.0))


def spatial(geometry: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster of texts: first text, rows, mean height, whether any row
    matched, and the spread of the positions (null for a single row).
    ``geometry`` (video_id, seq, key, text, normalized_height, x_center_norm,
    y_center_norm, matched); ``clusters`` (video_id, key, cluster)."""
    own = geometry.join(clusters, ["video_id", "key"])
    spread = F.sqrt(F.var_pop("x_center_norm") + F.var_pop("y_center_norm"))
    return own.groupBy("video_id", "cluster").agg(
        F.min_by("text", "seq").alias("canonical_text"), F.count("*").alias("occurrence_count"), F.avg("normalized_height").alias("mean_normalized_height"),
        F.when(F.count("*") > 1, spread).alias("position_stability"), F.bool_or("matched").alias("matched"),
    )


def heights(geometry: DataFrame) -> DataFrame:
    h = "normalized_height"
    return geometry.groupBy("matched").agg(F.count("*").alias("n"), F.min(h).alias("min_height"), F.max(h).alias("max_height"), F.avg(h).alias("mean_height"))


def summarize(records: DataFrame) -> DataFrame:
    """Pooled by language and model set. ``records``: clip, language,
    ocr_model_set, expected, matched, segments, unmatched, raw_recall."""
    s = records.groupBy("language", "ocr_model_set").agg(
        F.count("*").alias("clips"), F.sum("expected").alias("expected"), F.sum("matched").alias("matched"), F.sum("segments").alias("segments"), F.sum("unmatched").alias("unmatched"),
        F.sum(F.col("raw_recall") * F.col("expected")).alias("weighted"), F.array_sort(F.collect_set("clip")).alias("clip_names"),
    )
    return s.withColumn("recall", share("matched", "expected", 1.0)).withColumn("unmatched_rate", share("unmatched", "segments", 0.0)).withColumn("raw_recall", share("weighted", "expected", 1.0)).drop("weighted")


def overall_recall(summaries: DataFrame) -> DataFrame:
    sums = summaries.groupBy("ocr_model_set").agg(F.sum("expected").alias("expected"), F.sum("matched").alias("matched"))
    return sums.where("expected > 0").select("ocr_model_set", (F.col("matched") / F.col("expected")).alias("recall"))


def summary_levels(records: DataFrame) -> DataFrame:
    """Sums and ratios by language and model set, by model set, and over all, in one
    pass of grouping sets. ``level`` is 0, 1 (all languages) or 3 (all sets too); the
    columns summed over are null, and so is the recall of a set without expected texts."""
    sums = records.groupingSets([["language", "ocr_model_set"], ["ocr_model_set"], []], "language", "ocr_model_set").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("clips"), *[F.sum(c).alias(c) for c in ("expected", "matched", "segments", "unmatched")],
    )
    level = F.when(F.col("level") == 2, 1).otherwise(F.col("level")).alias("level")
    recall = F.when(F.col("level") == 0, share("matched", "expected", 1.0)).otherwise(F.when(F.col("expected") > 0, F.col("matched") / F.greatest("expected", F.lit(1))))
    return sums.select("language", "ocr_model_set", level, "clips", "expected", "matched", "segments", "unmatched", recall.alias("recall"), share("unmatched", "segments", 0.0).alias("unmatched_rate"))


def eval_records(raw: DataFrame) -> DataFrame:
    """Counts of evaluation results read from JSON (schema EVAL_JSON); required
    texts alone count, and absent flags mean required."""
    need = F.filter("per_text_results", lambda e: F.coalesce(e["required"], F.lit(True)))
    return raw.select("clip", "language", "ocr_model_set", F.size(need).cast("long").alias("expected"), F.size(F.filter(need, lambda e: e["matched"])).cast("long").alias("matched"), F.col("junk.post_dedup.total_segments").alias("segments"), F.col("junk.post_dedup.unmatched_count").alias("unmatched"), F.col("junk.raw.retained_overlay_recall").alias("raw_recall"))


def _figures() -> list[Column]:
    three = lambda c: F.format_string("%.3f", F.bround(c, 3))
    return [F.format_string("%d/%d = %s", F.col("matched"), F.col("expected"), three("recall")), three("raw_recall"), three("unmatched_rate"), F.col("segments").cast("string")]


def _table(rows: DataFrame, columns: list[str], *order: str) -> DataFrame:
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns]
    return rows.select(*order, F.concat(F.lit("| "), F.concat_ws(" | ", *cells, *_figures()), F.lit(" |")).alias("line"))


def clip_table(records: DataFrame) -> DataFrame:
    """Report lines, one for each record: (language, clip, ocr_model_set, line),
    to be read in the order of these columns."""
    one = records.withColumn("recall", share("matched", "expected", 1.0)).withColumn("unmatched_rate", share("unmatched", "segments", 0.0)).withColumn("raw_recall", F.when(F.col("expected") > 0, F.col("raw_recall")).otherwise(1.0))
    return _table(one, ["clip", "language", "ocr_model_set"], "language", "clip", "ocr_model_set")


def language_table(summaries: DataFrame) -> DataFrame:
    """Report lines, one for each language and model set, to be read in the
    order of these columns."""
    return _table(summaries, ["language", "ocr_model_set", "clips"], "language", "ocr_model_set")


def by_frequency(stats: DataFrame) -> DataFrame:
    """Spatial statistics in report order: the most frequent first, then by text."""
    return stats.orderBy("video_id", F.desc("occurrence_count"), "canonical_text")


def verdict(summaries: DataFrame, baseline: str, candidate: str, languages=LANGUAGES, margin: float = MARGIN) -> DataFrame:
    """(scope, reason) rows why the candidate does not replace the baseline;
    none if it does. A language lacking a set, or with different clips, is not
    compared further."""
    spark = summaries.sparkSession
    wanted = spark.createDataFrame([(x,) for x in languages], "language string")
    side = lambda name, p: summaries.where(F.col("ocr_model_set") == name).select("language", *[F.col(c).alias(f"{p}_{c}") for c in ("recall", "unmatched_rate", "clip_names")])
    both = wanted.join(side(baseline, "b"), "language", "left").join(side(candidate, "c"), "language", "left")
    b, c = F.col("b_recall"), F.col("c_recall")
    differ = F.size(F.array_except("b_clip_names", "c_clip_names")) + F.size(F.array_except("c_clip_names", "b_clip_names")) > 0
    compare = F.array_compact(F.array(F.when(c < b - margin - EPS, "recall"), F.when(F.col("c_unmatched_rate") > F.col("b_unmatched_rate") + margin + EPS, "unmatched_rate")))
    reasons = F.when(b.isNull() | c.isNull(), F.array(F.lit("no results"))).when(differ, F.array(F.lit("clip sets differ"))).otherwise(compare)
    rows = both.select(F.col("language").alias("scope"), F.explode(reasons).alias("reason"))
    total = overall_recall(summaries).where(F.col("ocr_model_set").isin(baseline, candidate)).agg(F.max(F.when(F.col("ocr_model_set") == baseline, F.col("recall"))).alias("b"), F.max(F.when(F.col("ocr_model_set") == candidate, F.col("recall"))).alias("c"))
    return rows.unionByName(total.where(F.col("c") < F.col("b") - EPS).select(F.lit("overall").alias("scope"), F.lit("recall").alias("reason")))


def funnel(counts: DataFrame) -> DataFrame:
    """Stage counts (stage_no, stage, n) with the drop against the stage before
    in percent; null at the first stage and behind an empty one."""
    before = F.lag("n").over(Window.orderBy("stage_no"))
    return counts.withColumn("drop_percent", F.when(before > 0, (before - F.col("n")) * 100.0 / F.greatest(before, F.lit(1))))
