"""The query catalogue over a data folder: each query with its SQL twin.

A twin is DuckDB SQL over the same tables and derived views. Where a fold has
no plain SQL form, the twin uses what the derived data guarantees (said beside
it), or there is none and the tests hold the operator against a loop.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionmill.functions import languages, similarity, text
from captionmill.operators import audio, boxes, cleanup, evaluation, frames, manifest, profiles, segments, sinks
from captionmill.operators.stored import shared_folder, stored
from captionmill.plans import chain
from captionmill.sources import images, media, whole_files
from captionmill.sources.derived import load, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add


_WS = text.WS_CLASS
_STRIP = f"regexp_replace(regexp_replace({{}}, '^{_WS}+', ''), '{_WS}+$', '')"
_KEY = _STRIP.format("replace(lower({}), 'ß', 'ss')")
_CUE = f"trim(regexp_replace({{}}, '{_WS}+', ' ', 'g'))"


# Text functions -----------------------------------------------------------------


@query(f"SELECT doc_id, md5({_KEY.format('text')}) AS key_md5, md5({_CUE.format('text')}) AS cue_md5 FROM documents")
def text_keys_and_cues(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(text.canonical_key("text")).alias("key_md5"), F.md5(text.cue("text")).alias("cue_md5"))


@query(r"SELECT doc_id, md5(replace(replace(replace(text, '\', '\\'), '|', '\|'), '`', '\`')) AS md FROM documents")
def text_markdown_escape(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(text.markdown_escape("text")).alias("md"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 8 AS s, CAST(round_even(l_extendedprice / 8 * 1000, 0) AS BIGINT) AS ms FROM lineitem)
SELECT l_orderkey, l_linenumber, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS srt,
  printf('%d:%02d', CAST(floor(s) AS BIGINT) // 60, CAST(floor(s) AS BIGINT) % 60) AS mmss FROM t""")
def time_formats(spark, d):
    s = F.col("l_extendedprice") / 8
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.srt_time(s).alias("srt"), text.minute_second(s).alias("mmss"))


_SOURCES = """SELECT page_id, CASE page_id % 7 WHEN 0 THEN concat('https://www.TikTok.com/@u/photo/', page_id) WHEN 1 THEN concat('https://youtu.be/', page_id) WHEN 2 THEN concat('HTTP://m.youtube.com/watch?v=', page_id)
  WHEN 3 THEN concat('https://instagram.com/reel/', page_id) WHEN 4 THEN concat('clips/take:', page_id % 9, '.final.mp4') ELSE url END AS source FROM pages"""


@query(f"""WITH s AS ({_SOURCES}) SELECT page_id, source, CASE WHEN regexp_matches(source, '^(?i:https?://)') THEN 'download' ELSE 'error' END AS acquisition,
  source LIKE 'http://%' OR source LIKE 'https://%' AS is_url, contains(lower(source), 'tiktok.com') AND contains(lower(source), '/photo/') AS is_photo,
  CASE WHEN contains(lower(source), 'tiktok.com') THEN 'tiktok' WHEN contains(lower(source), 'youtube.com') OR contains(lower(source), 'youtu.be') THEN 'youtube' WHEN contains(lower(source), 'instagram.com') THEN 'instagram' ELSE 'unknown' END AS platform,
  CASE WHEN source LIKE 'http://%' OR source LIKE 'https://%' THEN substr(sha256(source), 1, 12) WHEN source LIKE 'clips/%' THEN concat('take_', page_id % 9, '.final') ELSE regexp_replace(regexp_extract(source, '([^/]*)$', 1), '[<>:"/\\\\|?*]', '_', 'g') END AS stem FROM s""")
def source_classes(spark, d):
    s = load(spark, d, "pages").selectExpr("page_id", _SOURCES[len("SELECT page_id, ") : -len(" FROM pages")])
    return s.select("page_id", "source", media.acquisition("source").alias("acquisition"), text.is_url("source").alias("is_url"), profiles.is_photo_post("source").alias("is_photo"), profiles.platform("source").alias("platform"), text.output_stem("source", F.lit(None).cast("string")).alias("stem"))


_SPOKEN = "CASE doc_id % 8 WHEN 0 THEN 'English' WHEN 1 THEN 'DE-at' WHEN 2 THEN 'zh_CN' WHEN 3 THEN 'klingon' WHEN 4 THEN 'yue' WHEN 5 THEN ' Haitian Creole ' WHEN 6 THEN '' ELSE lang END"


@query("""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'zh' WHEN 3 THEN 'fr' WHEN 4 THEN 'yue' WHEN 5 THEN 'ht' WHEN 6 THEN 'fr' ELSE lang END AS language FROM documents""")
def speech_languages(spark, d):
    return load(spark, d, "documents").select("doc_id", languages.speech_language(F.expr(_SPOKEN), F.lit("FR")).alias("language"))


_SETTING = "CASE doc_id % 6 WHEN 0 THEN 'auto' WHEN 1 THEN 'latin' WHEN 2 THEN 'ru' WHEN 3 THEN 'ja' WHEN 4 THEN 'xx' ELSE lang END"


@query(f"""WITH s AS (SELECT doc_id, {_SETTING} AS s, lang, CASE WHEN doc_id % 2 = 0 THEN 'v6' ELSE 'classic' END AS m FROM documents),
r AS (SELECT *, CASE WHEN s IN ('latin', 'en') THEN s WHEN s = 'auto' AND lang = 'en' THEN 'en' WHEN s = 'auto' OR s IN ('de', 'fr', 'es') THEN 'latin' WHEN s = 'ru' THEN 'eslav' WHEN s = 'ja' THEN 'japan' ELSE 'en' END AS r,
  CASE WHEN s IN ('latin', 'en') THEN NULL WHEN s = 'auto' THEN lang ELSE s END AS iso FROM s),
c AS (SELECT *, CASE WHEN iso = 'ja' THEN 'japan' WHEN iso IN ('de', 'fr', 'es', 'en') THEN iso WHEN r IN ('en', 'japan') THEN r END AS code FROM r)
SELECT doc_id, r AS recogniser, iso, CASE WHEN m = 'v6' AND code IS NOT NULL THEN code WHEN r IN ('en', 'latin') THEN 'en' WHEN r = 'japan' THEN 'ch' ELSE 'multi' END AS det_lang,
  CASE WHEN m = 'v6' AND code IS NOT NULL THEN 'PP-OCRv6' ELSE 'PP-OCRv4' END AS det_version, CASE WHEN m = 'v6' AND code IS NOT NULL THEN 'small' ELSE 'mobile' END AS det_type,
  CASE WHEN m = 'v6' AND code IS NOT NULL THEN code ELSE r END AS rec_lang, CASE WHEN m = 'v6' AND code IS NOT NULL THEN 'PP-OCRv6' WHEN r = 'eslav' THEN 'PP-OCRv5' ELSE 'PP-OCRv4' END AS rec_version,
  CASE WHEN m = 'v6' AND code IS NOT NULL THEN 'small' ELSE 'mobile' END AS rec_type, m = 'v6' AND code IS NULL AS fell_back, CAST(NULL AS VARCHAR) AS error FROM c""")
def model_parameters(spark, d):
    s = load(spark, d, "documents").selectExpr("doc_id", f"{_SETTING} AS s", "lang", "CASE WHEN doc_id % 2 = 0 THEN 'v6' ELSE 'classic' END AS m")
    r = s.select("doc_id", "m", languages.recogniser("s", "lang").alias("recogniser"), languages.iso_in_effect("s", "lang").alias("iso"))
    return r.select("doc_id", "recogniser", "iso", languages.model_parameters("m", "recogniser", "iso").alias("p")).select("doc_id", "recogniser", "iso", "p.*")


@query("""SELECT o_orderkey, coalesce(CASE o_orderkey % 3 WHEN 0 THEN 'srt' END, CASE WHEN o_orderkey % 5 = 0 THEN 'md' END, CASE WHEN o_orderkey % 2 = 0 THEN 'txt' END, 'json') AS form,
  CASE WHEN o_orderkey % 4 = 0 THEN least(CAST(o_orderkey % 90 AS DOUBLE), 60.0) ELSE least(pow(2.0, least(o_orderkey % 20, 16)), 60.0) END AS delay FROM orders""")
def settings(spark, d):
    o, k = load(spark, d, "orders"), F.col("o_orderkey")
    form = text.output_format(F.when(k % 3 == 0, "srt"), F.when(k % 5 == 0, "md").otherwise(""), F.when(k % 2 == 0, "a/b.TXT").otherwise("a/b.mkv"))
    return o.select("o_orderkey", form.alias("form"), text.retry_delay(k % 20, F.when(k % 4 == 0, (k % 90).cast("string")).otherwise("soon")).alias("delay"))


_LCS = """WITH RECURSIVE p AS (SELECT p_partkey AS id, lower(p_name) AS a, lower(p_type) AS b FROM part),
s(id, a, b, k, v) AS (SELECT id, a, b, 0, (CAST(1 AS HUGEINT) << length(a)) - 1 FROM p
  UNION ALL SELECT id, a, b, k + 1, ((v + (v & m)) | (v - (v & m))) & ((CAST(1 AS HUGEINT) << length(a)) - 1) FROM (SELECT *, coalesce(list_sum(list_transform(range(0, length(a)), lambda i: CASE WHEN substr(a, i + 1, 1) = substr(b, k + 1, 1) THEN CAST(1 AS HUGEINT) << CAST(i AS INTEGER) ELSE 0 END)), 0)::HUGEINT AS m FROM s WHERE k < length(b)))
SELECT id AS p_partkey, round(2.0 * (length(a) - bit_count(v)) / (length(a) + length(b)), 6) AS ratio FROM s WHERE k = length(b)"""


@query(_LCS)
def similarity_ratio(spark, d):
    return load(spark, d, "part").select("p_partkey", F.round(similarity.ratio(F.col("p_name"), F.col("p_type")), 6).alias("ratio"))


def _lcs_of(name: str, pairs: str) -> str:
    """Expressions ``name`` (s, u, r): the ratio of the lower-case pairs (s, u) of a query."""
    bit = "CASE WHEN substr(s, i + 1, 1) = substr(u, n + 1, 1) THEN CAST(1 AS HUGEINT) << CAST(i AS INTEGER) ELSE 0 END"
    full = "((CAST(1 AS HUGEINT) << length(s)) - 1)"
    return f"""{name}_q AS MATERIALIZED (SELECT DISTINCT s, u FROM ({pairs})),
{name}_l(s, u, n, v) AS (SELECT s, u, 0, {full} FROM {name}_q
  UNION ALL SELECT s, u, n + 1, ((v + (v & m)) | (v - (v & m))) & {full} FROM (SELECT *, coalesce(list_sum(list_transform(range(0, length(s)), lambda i: {bit})), 0)::HUGEINT AS m FROM {name}_l WHERE n < length(u))),
{name} AS MATERIALIZED (SELECT s, u, CASE WHEN length(s) + length(u) = 0 THEN CAST(1 AS DOUBLE) ELSE 2.0::DOUBLE * (length(s) - bit_count(v)) / (length(s) + length(u)) END AS r FROM {name}_l WHERE n = length(u))"""


# The weighted ratio by its definition: every stretch of the longer string, all pairs of token strings.
_JOINED = "list_aggregate(list_sort({}), 'string_agg', ' ')"


def _weighted_of(pairs: str) -> str:
    """Expressions that end with ``weighed`` (a, b, w) for the lower-case pairs (a, b) of a query."""
    return f"""p AS MATERIALIZED ({pairs}),
tok AS MATERIALIZED (SELECT a, b, x, y, list_filter(list_distinct(x), lambda c: list_contains(y, c)) AS core, list_filter(list_distinct(x), lambda c: NOT list_contains(y, c)) AS dx, list_filter(list_distinct(y), lambda c: NOT list_contains(x, c)) AS dy,
  greatest(length(a), length(b)) / least(length(a), length(b)) AS far FROM (SELECT a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM p)),
k AS MATERIALIZED (SELECT *, CASE WHEN far < 1.5 THEN 1.0 WHEN far <= 8 THEN 0.9 ELSE 0.6 END AS scale, coalesce({_JOINED.format("x")}, '') AS jx, coalesce({_JOINED.format("y")}, '') AS jy, coalesce({_JOINED.format("core")}, '') AS jc,
  coalesce({_JOINED.format("dx")}, '') AS jdx, coalesce({_JOINED.format("dy")}, '') AS jdy FROM tok),
j AS MATERIALIZED (SELECT a, b, 1.0 AS f, FALSE AS part, a AS s, b AS t FROM k
  UNION ALL SELECT a, b, 0.95, FALSE, jx, jy FROM k WHERE far < 1.5
  UNION ALL SELECT a, b, 0.95, FALSE, trim(concat(jc, ' ', jdx)), trim(concat(jc, ' ', jdy)) FROM k WHERE far < 1.5
  UNION ALL SELECT a, b, 0.95, FALSE, jc, trim(concat(jc, ' ', jdx)) FROM k WHERE far < 1.5 AND jc <> ''
  UNION ALL SELECT a, b, 0.95, FALSE, jc, trim(concat(jc, ' ', jdy)) FROM k WHERE far < 1.5 AND jc <> ''
  UNION ALL SELECT a, b, scale, TRUE, a, b FROM k WHERE far >= 1.5
  UNION ALL SELECT a, b, 0.95 * scale, TRUE, jx, jy FROM k WHERE far >= 1.5
  UNION ALL SELECT a, b, 0.95 * scale, TRUE, jdx, jdy FROM k WHERE far >= 1.5),
o AS MATERIALIZED (SELECT a, b, f, part, s, t FROM j WHERE NOT part OR length(s) <= length(t) UNION ALL SELECT a, b, f, part, t, s FROM j WHERE part AND length(s) >= length(t)),
w AS MATERIALIZED (SELECT a, b, f, s, t AS u FROM o WHERE NOT part
  UNION ALL SELECT a, b, f, s, substr(t, greatest(i, 0) + 1, least(i + length(s), length(t)) - greatest(i, 0)) FROM (SELECT *, unnest(range(1 - length(s), length(t))) AS i FROM o WHERE part)),
{_lcs_of("r", "SELECT s, u FROM w")},
best AS (SELECT a, b, max(f * r) AS best FROM w JOIN r USING (s, u) GROUP BY a, b),
weighed AS MATERIALIZED (SELECT k.a, k.b, CASE WHEN len(core) > 0 AND (far >= 1.5 OR jdx = '' OR jdy = '') THEN greatest(best, 0.95 * scale) ELSE best END AS w FROM k JOIN best ON best.a = k.a AND best.b = k.b)"""


@query(f"""WITH RECURSIVE {_weighted_of("SELECT DISTINCT lower(p_name) AS a, lower(p_type) AS b FROM part")}
SELECT p_partkey, round(w, 6) AS wratio FROM part JOIN weighed e ON e.a = lower(p_name) AND e.b = lower(p_type)""")
def similarity_weighted(spark, d):
    return load(spark, d, "part").select("p_partkey", F.round(similarity.wratio(F.col("p_name"), F.col("p_type")), 6).alias("wratio"))


# Boxes ---------------------------------------------------------------------------


def _boxes(spark, d) -> DataFrame:
    corners = "array(named_struct('x', x0, 'y', y0), named_struct('x', x1, 'y', y0), named_struct('x', x1, 'y', y1), named_struct('x', x0, 'y', y1))"
    return load(spark, d, "rects").selectExpr("video_id", "frame_ts", "pos", f"{corners} AS box", "text", "score")


_KEPT = """bx AS (SELECT *, (x0 + x1) / 2 AS xc, (y0 + y1) / 2 AS yc, y1 - y0 AS h, row_number() OVER (PARTITION BY video_id, frame_ts ORDER BY pos) AS n FROM {rects} WHERE score >= 0.6),
kept(video_id, frame_ts, n, acc) AS (SELECT video_id, frame_ts, 1, [struct_pack(n := n, x0 := x0, x1 := x1, y0 := y0, y1 := y1, t := text)] FROM bx WHERE n = 1
  UNION ALL SELECT k.video_id, k.frame_ts, o.n, CASE WHEN len(list_filter(acc, lambda q: q.t = o.text AND q.x0 < o.x1 AND o.x0 < q.x1 AND q.y0 < o.y1 AND o.y0 < q.y1)) > 0 THEN acc
    ELSE list_append(acc, struct_pack(n := o.n, x0 := o.x0, x1 := o.x1, y0 := o.y0, y1 := o.y1, t := o.text)) END FROM kept k JOIN bx o ON o.video_id = k.video_id AND o.frame_ts = k.frame_ts AND o.n = k.n + 1),
accepted AS (SELECT video_id, frame_ts, arg_max(acc, n) AS acc FROM kept GROUP BY video_id, frame_ts),
fin AS (SELECT video_id, frame_ts, unnest(list_transform(acc, lambda q: q.n)) AS n FROM accepted),
sv AS (SELECT o.*, avg(h) OVER (PARTITION BY o.video_id, o.frame_ts) AS mh, row_number() OVER (PARTITION BY o.video_id, o.frame_ts ORDER BY yc, pos) AS r FROM bx o JOIN fin USING (video_id, frame_ts, n)),
ln(video_id, frame_ts, r, c, m, line) AS (SELECT video_id, frame_ts, r, 1, yc, 0 FROM sv WHERE r = 1
  UNION ALL SELECT sv.video_id, sv.frame_ts, sv.r, CASE WHEN abs(yc - m) <= mh * 0.5 THEN c + 1 ELSE 1 END, CASE WHEN abs(yc - m) <= mh * 0.5 THEN (m * c + yc) / (c + 1) ELSE yc END, CASE WHEN abs(yc - m) <= mh * 0.5 THEN line ELSE line + 1 END
  FROM ln JOIN sv ON sv.video_id = ln.video_id AND sv.frame_ts = ln.frame_ts AND sv.r = ln.r + 1)"""


@query("WITH RECURSIVE " + _KEPT + " SELECT video_id, frame_ts, pos, text FROM sv")
def boxes_without_nested(spark, d):
    return boxes.drop_nested(boxes.with_bounds(segments.drop_confidence(_boxes(spark, d)))).select("video_id", "frame_ts", "pos", "text")


@query("WITH RECURSIVE " + _KEPT + """,
g AS (SELECT sv.*, ln.line, x0 - lag(x1) OVER (PARTITION BY sv.video_id, sv.frame_ts, line ORDER BY xc, sv.r) > mh * 2.0 AS cut FROM sv JOIN ln USING (video_id, frame_ts, r)),
q AS (SELECT *, CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, frame_ts, line ORDER BY xc, r) AS INTEGER) AS chunk FROM g)
SELECT video_id, frame_ts, line, chunk, string_agg(text, ' ' ORDER BY xc, r) AS text, round(avg(score), 6) AS mean_conf, round(avg(h), 6) AS mean_box_height, round(avg(yc), 6) AS y_center, round(avg(xc), 6) AS x_center FROM q GROUP BY ALL""")
def box_lines(spark, d):
    out = boxes.aggregate_boxes(_boxes(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_conf", "mean_box_height", "y_center", "x_center")})


# Filters and dedup ----------------------------------------------------------------


def _profiles_of(spark, d) -> DataFrame:
    own = load(spark, d, "points").select("video_id").distinct()
    n = F.col("video_id").cast("int") % 3
    videos = own.select("video_id", F.when(n == 0, "https://www.tiktok.com/v").when(n == 1, "https://youtu.be/v").otherwise("v.mp4").alias("source"), F.lit("auto").alias("requested"))
    return profiles.resolve(videos)


_FITS = f"""NOT (source = 'ON-SCREEN' AND (
  (CAST(video_id AS INTEGER) % 3 = 0 AND (regexp_matches({_STRIP.format('text')}, '^@[\\w.]+$') OR regexp_matches({_STRIP.format('text')}, '^\\d+(\\.\\d+)?[KkMm]?$')))
  OR (CAST(video_id AS INTEGER) % 3 = 1 AND regexp_matches({_STRIP.format('text')}, '^@[\\w.\\-]+$'))))"""


@query(f"SELECT video_id, seq, text FROM {{points}} WHERE {_FITS}")
def pattern_filter(spark, d):
    return segments.drop_patterns(load(spark, d, "points"), _profiles_of(spark, d)).select("video_id", "seq", "text")


def _frames_read(points) -> DataFrame:
    """Frames read per video, with text or without: one a second up to its end."""
    last = points.groupBy("video_id").agg(F.floor(F.max("end")).alias("last"))
    return frames.frame_counts(last.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("frame_idx")))


#: Keys are equal, so texts differ in case or by a leading space: their common subsequence is the shorter one.
def _dedup_of(rows: str) -> str:
    return f"""dk AS (SELECT *, {_KEY.format('text')} AS dkey FROM {rows} WHERE source = 'ON-SCREEN'),
dl AS (SELECT *, lag(text) OVER w AS pt, lag("end") OVER w AS pe FROM dk WHERE dkey <> '' WINDOW w AS (PARTITION BY video_id, dkey ORDER BY "start", seq)),
db AS (SELECT *, sum(CASE WHEN pt IS NULL OR 2.0 * least(length(text), length(pt)) / (length(text) + length(pt)) < 0.85 OR "start" - pe > 2.0 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, dkey ORDER BY "start", seq) AS island FROM dl),
dd AS MATERIALIZED (SELECT video_id, min(seq) AS seq, min("start") AS "start", arg_max("end", ("start", seq)) AS "end", arg_min(text, ("start", seq)) AS text, 'ON-SCREEN' AS source, avg(ocr_confidence) AS ocr_confidence FROM db GROUP BY video_id, dkey, island)"""


@query(f"""WITH {_dedup_of("{points}")} SELECT video_id, seq, "start", "end", text, source, round(ocr_confidence, 6) AS ocr_confidence FROM dd
UNION ALL SELECT video_id, seq, "start", "end", text, source, round(ocr_confidence, 6) FROM {{points}} WHERE source = 'SPEECH'""")
def cross_frame_dedup(spark, d):
    return segments.dedup(load(spark, d, "points")).select("video_id", "seq", "start", "end", "text", "source", F.round("ocr_confidence", 6).alias("ocr_confidence"))


def _clusters_of(keys: str, threshold: float) -> str:
    """Expressions that end with ``clustered`` (video_id, key, first): a key's cluster is that of
    the least first key that a chain of earlier neighbours leads to. ``keys``: video_id, key, first_seq."""
    return f"""ck AS MATERIALIZED ({keys}),
kn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY first_seq, key) AS pos FROM ck),
{_lcs_of("kr", "SELECT x.key AS s, y.key AS u FROM (SELECT DISTINCT key FROM ck) x, (SELECT DISTINCT key FROM ck) y WHERE x.key <> y.key")},
near_keys AS MATERIALIZED (SELECT s, u FROM kr WHERE r >= {threshold}),
earlier AS MATERIALIZED (SELECT x.video_id, x.pos AS i, y.pos AS j FROM kn x JOIN near_keys ON near_keys.s = x.key JOIN kn y ON y.video_id = x.video_id AND y.key = near_keys.u WHERE y.pos < x.pos),
reach(video_id, i, j) AS (SELECT video_id, pos, pos FROM kn UNION SELECT reach.video_id, reach.i, earlier.j FROM reach JOIN earlier ON earlier.video_id = reach.video_id AND earlier.i = reach.j),
clustered AS MATERIALIZED (SELECT kn.video_id, kn.key, min(j) AS first FROM kn JOIN reach ON reach.video_id = kn.video_id AND reach.i = kn.pos GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_clusters_of("SELECT p_type AS video_id, lower(p_name) AS key, min(p_partkey) AS first_seq FROM part GROUP BY ALL", 0.75)}
SELECT video_id, key, CAST(dense_rank() OVER (PARTITION BY video_id ORDER BY first) - 1 AS INTEGER) AS cluster FROM clustered""")
def clustered_keys(spark, d):
    keys = load(spark, d, "part").select(F.col("p_type").alias("video_id"), F.lower("p_name").alias("key"), "p_partkey").groupBy("video_id", "key").agg(F.min("p_partkey").alias("first_seq"))
    return segments.cluster_keys(keys, 0.75)


@query("""WITH m AS (SELECT s.video_id, s.seq, o.seq AS o_seq, least(s."start", o."start") AS "start", greatest(s."end", o."end") AS "end" FROM {speech} s JOIN {captions} o ON s.video_id = o.video_id AND o.seq = s.seq + 1000 WHERE s.seq % 6 IN (0, 2)),
e AS (SELECT s.video_id, s.seq, coalesce(m."start", s."start") AS "start", coalesce(m."end", s."end") AS "end", CASE WHEN m.seq IS NULL THEN s.source ELSE 'BOTH' END AS source, 0 AS ch FROM {speech} s LEFT JOIN m USING (video_id, seq)
  UNION ALL SELECT o.video_id, o.seq, o."start", o."end", o.source, 1 FROM {captions} o WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.video_id = o.video_id AND m.o_seq = o.seq))
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY "start", ch, seq) AS seq, "start", "end", source FROM e""")
def channel_merge(spark, d):
    return segments.merge(load(spark, d, "speech"), load(spark, d, "captions")).select("video_id", "seq", "start", "end", "source")


def _merge_of(speech: str, screen: str) -> str:
    """Expressions that end with ``merged`` (video_id, seq, start, end, text, source, o_conf): rows of
    both channels vie for one another, and the spoken rows of a video choose one after another."""
    return f"""sp AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS n FROM {speech}), sc AS MATERIALIZED (SELECT * FROM {screen}),
{_weighted_of("SELECT DISTINCT lower(x.text) AS a, lower(y.text) AS b FROM (SELECT DISTINCT text FROM sp) x, (SELECT DISTINCT text FROM sc) y")},
likes AS MATERIALIZED (SELECT sp.video_id, sp.n, list(sc.seq ORDER BY w DESC, sc."start", sc.seq) AS likes FROM sp JOIN sc ON sc.video_id = sp.video_id AND sp."start" <= sc."end" AND sc."start" <= sp."end" JOIN weighed e ON e.a = lower(sp.text) AND e.b = lower(sc.text) WHERE w >= 0.85 GROUP BY ALL),
got(video_id, n, taken, got) AS (SELECT video_id, 0, CAST([] AS BIGINT[]), CAST(NULL AS BIGINT) FROM sp WHERE n = 1
  UNION ALL SELECT video_id, n, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, pick FROM (SELECT g.video_id, sp.n, g.taken, list_filter(coalesce(c.likes, []), lambda x: NOT list_contains(g.taken, x))[1] AS pick FROM got g JOIN sp ON sp.video_id = g.video_id AND sp.n = g.n + 1 LEFT JOIN likes c ON c.video_id = sp.video_id AND c.n = sp.n)),
every AS (SELECT sp.video_id, sp.seq, least(sp."start", coalesce(sc."start", sp."start")) AS "start", greatest(sp."end", coalesce(sc."end", sp."end")) AS "end", CASE WHEN got IS NULL THEN sp.text ELSE {_CUE.format("sp.text")} END AS text, CASE WHEN got IS NULL THEN 'SPEECH' ELSE 'BOTH' END AS source, CASE WHEN got IS NULL THEN sp.ocr_confidence END AS o_conf, 0 AS ch FROM got g JOIN sp ON sp.video_id = g.video_id AND sp.n = g.n LEFT JOIN sc ON sc.video_id = g.video_id AND sc.seq = got
  UNION ALL SELECT sc.video_id, sc.seq, "start", "end", text, source, ocr_confidence, 1 FROM sc WHERE NOT EXISTS (SELECT 1 FROM got g WHERE g.video_id = sc.video_id AND g.got = sc.seq)),
merged AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY CASE WHEN both_ THEN "start" END, ch, seq) AS seq, "start", "end", text, source, o_conf FROM (SELECT *, min(ch) OVER v <> max(ch) OVER v AS both_ FROM every WINDOW v AS (PARTITION BY video_id)))"""


@query(f"""WITH RECURSIVE {_merge_of("{marks} WHERE source = 'SPEECH'", "{marks} WHERE source = 'ON-SCREEN'")} SELECT video_id, seq, "start", "end", source FROM merged""")
def contended_merge(spark, d):
    m = load(spark, d, "marks")
    return segments.merge(m.where("source = 'SPEECH'"), m.where("source = 'ON-SCREEN'")).select("video_id", "seq", "start", "end", "source")


def _recurring_of(rows: str, frames: str, share: float, fuzzy: float, least: int = 0) -> str:
    """Expressions that end with ``kept``: ``rows`` without recurring families of keys, given
    ``frames`` (video_id, f)."""
    return f"""m AS MATERIALIZED (SELECT *, CASE WHEN source = 'ON-SCREEN' THEN {_KEY.format("text")} END AS key FROM {rows}), frames AS ({frames}),
{_clusters_of("SELECT video_id, key, min(seq) AS first_seq FROM m WHERE key <> '' GROUP BY ALL", fuzzy)},
families AS (SELECT video_id, first, count(*) AS n FROM m JOIN clustered USING (video_id, key) GROUP BY ALL),
often AS (SELECT video_id, key FROM clustered JOIN families USING (video_id, first) JOIN frames USING (video_id) WHERE f >= {least} AND n / f >= {share} UNION ALL SELECT video_id, key FROM m JOIN frames USING (video_id) WHERE key = '' GROUP BY video_id, key, f HAVING f >= {least} AND count(*) / f >= {share}),
kept AS MATERIALIZED (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM often o WHERE o.video_id = m.video_id AND o.key = m.key))"""


_READ = 'SELECT video_id, CAST(floor(max("end")) AS BIGINT) + 1 AS f FROM {points} GROUP BY 1'


@query(f"WITH RECURSIVE {_recurring_of('{points}', _READ, 0.1, 0.9, 10)} SELECT video_id, seq, text FROM kept")
def recurrence_filter(spark, d):
    points = load(spark, d, "points")
    counts = _frames_read(points)
    return segments.drop_recurring(points, counts, threshold=0.1, least_frames=10).select("video_id", "seq", "text")


@query(f"""WITH RECURSIVE {_recurring_of("{marks}", 'SELECT video_id, count(DISTINCT "start") AS f FROM {marks} GROUP BY video_id', 0.2, 0.8)} SELECT video_id, seq, text FROM kept""")
def recurring_families(spark, d):
    """Recurrence over families of similar keys."""
    m = load(spark, d, "marks")
    counts = m.groupBy("video_id").agg(F.count_distinct("start").alias("frame_count"))
    return segments.drop_recurring(m, counts, 0.2, 80.0).select("video_id", "seq", "text")


@query("""WITH c AS (SELECT conv_id AS v, turn AS n, CASE WHEN turn % 3 = 0 THEN 0 ELSE turn END AS k FROM conversations)
SELECT CAST(v AS VARCHAR) AS video_id, coalesce(arg_min(concat('l', n), n) FILTER (k > 0), 'en') AS language FROM c GROUP BY v""")
def chunk_languages(spark, d):
    c = load(spark, d, "conversations").selectExpr("cast(conv_id AS string) AS video_id", "turn AS chunk_no", "concat('l', turn) AS language", "CASE WHEN turn % 3 = 0 THEN 0 ELSE turn END AS n_segments")
    return segments.chunk_language(c)


@query("""SELECT video_id, seq, "start" + (seq % 4) * 600.5 AS "start", "end" + (seq % 4) * 600.5 AS "end" FROM {points}""")
def chunk_offsets(spark, d):
    points = load(spark, d, "points").withColumn("chunk_no", F.col("seq") % 4)
    chunks = points.select("video_id", "chunk_no").distinct().withColumn("start_s", F.col("chunk_no") * 600.5)
    return segments.shift(points, chunks).select("video_id", "seq", "start", "end")


# Writers and clean-up ---------------------------------------------------------------


@query(f"""WITH s AS (SELECT video_id, seq, "start", "end", source, {_CUE.format('text')} AS t, CAST(round_even("start" * 1000, 0) AS BIGINT) AS a, CAST(round_even("end" * 1000, 0) AS BIGINT) AS b, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS n FROM {{turns}}),
f AS (SELECT *, printf('%02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) AS ta, printf('%02d:%02d:%02d,%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) AS tb,
  printf('%d:%02d', CAST("start" AS BIGINT) // 60, CAST("start" AS BIGINT) % 60) AS ma, printf('%d:%02d', CAST("end" AS BIGINT) // 60, CAST("end" AS BIGINT) % 60) AS mb FROM s)
SELECT video_id, md5(string_agg(t || chr(10), '' ORDER BY n)) AS txt, md5(string_agg(n || chr(10) || ta || ' --> ' || tb || chr(10) || t || chr(10), chr(10) ORDER BY n)) AS srt,
  md5(string_agg('**[' || source || '] ' || ma || '–' || mb || '** ' || replace(replace(replace(t, '\\', '\\\\'), '|', '\\|'), '`', '\\`') || chr(10), '' ORDER BY n)) AS md FROM f GROUP BY video_id""")
def rendered_transcripts(spark, d):
    turns = load(spark, d, "turns")
    body = lambda form: sinks.render(turns, form).select("video_id", F.md5("body").alias(form))
    return body("txt").join(body("srt"), "video_id").join(body("md"), "video_id")


@query(f"""WITH s AS (SELECT video_id, seq, {_CUE.format('text')} AS t FROM {{turns}})
SELECT video_id || '.txt' AS name, md5(string_agg(t || chr(10), '' ORDER BY seq)) AS body_md5 FROM s GROUP BY video_id""")
def transcript_files(spark, d):
    """Plain transcripts as one file a video, read back."""
    folder = f"{shared_folder(spark)}/transcripts-{uuid.uuid4().hex}"
    sinks.write(sinks.render(load(spark, d, "turns"), "txt"), folder, "txt")
    read = spark.read.format("binaryFile").load(folder)
    return read.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.md5("content").alias("body_md5"))


@query("""SELECT video_id, arg_min(language, seq) AS language, count(*) AS n_segments, md5(string_agg(concat_ws('~', text, source, language), '|' ORDER BY seq)) AS rows_md5, sum("start" + "end") AS total, count(*) FILTER (asr_logprob IS NULL) AS n_null FROM {turns} GROUP BY video_id""")
def rendered_json(spark, d):
    """The JSON documents, read back."""
    turns = load(spark, d, "turns")
    bodies = sinks.render(turns, "json", turns.groupBy("video_id").agg(F.min_by("language", "seq").alias("language")))
    told = bodies.select("video_id", F.from_json("body", "segments array<struct<start:double,end:double,text:string,source:string,asr_logprob:double,ocr_confidence:double,language:string>>, language string").alias("j")).select("video_id", "j.*")
    return told.select(
        "video_id", "language", F.size("segments").cast("long").alias("n_segments"), F.expr("md5(array_join(transform(segments, s -> concat_ws('~', s.text, s.source, s.language)), '|'))").alias("rows_md5"),
        F.expr("aggregate(segments, cast(0 AS double), (t, s) -> t + s.start + s.end)").alias("total"), F.expr("cast(size(filter(segments, s -> s.asr_logprob IS NULL)) AS long)").alias("n_null"),
    )


_ANSWER = "CASE seq % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN concat(text, text, text) WHEN 3 THEN concat(text, 'z', chr(13)) ELSE text END"


@query(f"SELECT video_id, seq, CASE seq % 5 WHEN 3 THEN concat(text, 'z') ELSE text END AS text FROM {{turns}}")
def cleanup_rails(spark, d):
    return load(spark, d, "turns").select("video_id", "seq", cleanup.accepted("text", F.expr(_ANSWER)).alias("text"))


# Frames and audio -------------------------------------------------------------------


@query("""SELECT user_id % 40 AS v, event_id, event_id / (24.0 + user_id % 40) AS ts FROM events WHERE event_id % CAST(greatest(1, round_even((24.0 + user_id % 40) / 1.0, 0)) AS BIGINT) = 0""")
def frame_stride(spark, d):
    e = load(spark, d, "events").select((F.col("user_id") % 40).alias("v"), "event_id", F.col("event_id").alias("frame_idx"), (24.0 + F.col("user_id") % 40).alias("native_fps"))
    return frames.stride(e).select("v", "event_id", "ts")


@query("""WITH n AS (SELECT vec_id, label, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p, len(embedding) // 16 AS k FROM embeddings),
b AS (SELECT vec_id, unnest(range(0, 16)) AS j, e, p, k FROM n WHERE p IS NOT NULL)
SELECT vec_id, round(max(list_sum(list_transform(range(j * k + 1, j * k + k + 1), lambda i: abs(CAST(e[i] AS DOUBLE) - CAST(p[i] AS DOUBLE)))) / k), 5) AS diff FROM b GROUP BY vec_id""")
def block_difference(spark, d):
    from pyspark.sql import Window

    e = load(spark, d, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    lagged = e.withColumn("p", F.lag("e").over(Window.partitionBy("label").orderBy("vec_id"))).where("p IS NOT NULL")
    return lagged.select("vec_id", F.round(frames.vector_difference(F.col("e"), F.col("p"), 16, 1.0), 5).alias("diff"))


# A frame of the queries below: a row of 16 blocks of two equal pixels, from the first 16 numbers of a vector.
_PIXEL = "65 + CAST(floor(abs(CAST(embedding[{}] AS DOUBLE)) * 60) AS INTEGER) % 60"


def _frames(spark, d) -> DataFrame:
    gray = F.expr("cast(array_join(transform(slice(embedding, 1, 16), x -> repeat(chr(65 + cast(floor(abs(cast(x AS double)) * 60) AS int) % 60), 2)), '') AS binary)")
    e = load(spark, d, "embeddings")
    return e.select(F.col("label").cast("string").alias("video_id"), F.col("vec_id").alias("frame_idx"), F.lit(25.0).alias("native_fps"), F.lit(1).alias("height"), F.lit(32).alias("width"), gray.alias("gray"))


# The choice as a recursion: each step looks at the next frame with the last chosen one in hand.
@query(f"""WITH RECURSIVE f AS MATERIALIZED (SELECT CAST(label AS VARCHAR) AS video_id, vec_id AS frame_idx, list_transform(range(1, 17), lambda i: {_PIXEL.format("i")}) AS px, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n, count(*) OVER (PARTITION BY label) AS total FROM embeddings),
w(video_id, n, total, last, since, take, held) AS (SELECT video_id, n, total, px, 0, TRUE, CAST(0 AS DOUBLE) FROM f WHERE n = 1
  UNION ALL SELECT video_id, n, total, CASE WHEN take THEN px ELSE last END, CASE WHEN take THEN 0 ELSE since END, take, CASE WHEN take THEN 0 ELSE d END FROM (
    SELECT *, d >= 0.05 OR since >= 10 AS take FROM (SELECT w.video_id, f.n, f.total, w.last, f.px, w.since + 1 AS since, list_max(list_transform(range(1, 17), lambda i: abs(f.px[i] - w.last[i]))) / 255 AS d FROM w JOIN f ON f.video_id = w.video_id AND f.n = w.n + 1)))
SELECT video_id, frame_idx FROM w JOIN f USING (video_id, n) WHERE take OR (n = f.total AND held > 0)""")
def scene_changes(spark, d):
    return frames.scene_changes(_frames(spark, d))


@query(f"""SELECT CAST(label AS VARCHAR) AS video_id, count(*) AS n_frames, max(25.0) AS native_fps, CAST(sum(2 * list_sum(list_transform(range(1, 17), lambda i: {_PIXEL.format("i")}))) AS BIGINT) AS pixels,
  md5(string_agg(array_to_string(list_transform(range(1, 17), lambda i: repeat(chr({_PIXEL.format("i")}), 2)), ''), '' ORDER BY vec_id)) AS gray_md5 FROM embeddings GROUP BY label""")
def frame_files(spark, d):
    """Frames written as one sequence a video and read back in small splits."""
    folder = f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}"
    whole_files.write_frames(_frames(spark, d), folder)
    read = whole_files.read_frames(spark, folder, split_bytes=2000)
    pixels = F.expr("aggregate(sequence(1, length(gray)), 0L, (s, i) -> s + ascii(substring(gray, i, 1)))")
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", F.col("gray").cast("string").alias("g")))), lambda r: r["g"]), "")
    return read.groupBy("video_id").agg(F.count("*").alias("n_frames"), F.max("native_fps").alias("native_fps"), F.sum(pixels).alias("pixels"), F.md5(rows).alias("gray_md5"))


def _encoded(batches):
    """Every other frame as PNG, the others as PGM; some are cut, garbage or empty."""
    for batch in batches:
        out = []
        for i, gray in zip(batch["frame_idx"].to_pylist(), batch["gray"].to_pylist()):
            whole = images.encode_png(np.frombuffer(gray, np.uint8).reshape(4, 8)) if i % 2 else b"P5\n8 4\n255\n" + gray
            out.append(whole[:-5] if i % 7 == 0 else b"GIF89a" if i % 11 == 0 else b"" if i % 13 == 0 else None if i % 17 == 0 else whole)
        yield pa.RecordBatch.from_arrays([batch["video_id"], batch["frame_idx"], pa.array(out, pa.binary())], names=["video_id", "frame_idx", "content"])


@query(f"""WITH e AS (SELECT CAST(label AS VARCHAR) AS video_id, CASE WHEN vec_id % 7 = 0 OR vec_id % 11 = 0 THEN 'unreadable' WHEN vec_id % 13 = 0 OR vec_id % 17 = 0 THEN 'empty' ELSE 'ok' END AS status, 2 * list_sum(list_transform(range(1, 17), lambda i: {_PIXEL.format("i")})) AS px FROM embeddings)
SELECT video_id, status, count(*) AS n, coalesce(CAST(sum(px) FILTER (status = 'ok') AS BIGINT), 0) AS pixels FROM e GROUP BY video_id, status""")
def decoded_images(spark, d):
    content = _frames(spark, d).mapInArrow(_encoded, "video_id string, frame_idx long, content binary")
    pixels = F.expr("aggregate(sequence(1, length(gray)), 0L, (s, i) -> s + ascii(substring(gray, i, 1)))")
    return images.decoded(content).groupBy("video_id", "status").agg(F.count("*").alias("n"), F.coalesce(F.sum(pixels), F.lit(0)).alias("pixels"))


@query("""WITH n AS (SELECT o_custkey % 50 AS video_id, o_orderkey AS image_no, CASE WHEN o_custkey % 2 = 0 THEN 90.0 END AS d, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey % 50) AS n FROM orders)
SELECT video_id, image_no, round(i * coalesce(d / n, 1.0), 6) AS "start", round((i + 1) * coalesce(d / n, 1.0), 6) AS "end" FROM n""")
def slide_times(spark, d):
    o = load(spark, d, "orders").selectExpr("o_custkey % 50 AS video_id", "o_orderkey AS image_no", "cast(CASE WHEN o_custkey % 2 = 0 THEN 90.0 END AS double) AS duration")
    return frames.slide_times(o).select("video_id", "image_no", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("""WITH s AS (SELECT l_suppkey AS key, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS pos, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
e AS (SELECT key, pos, sum(q * q) OVER w AS e, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY key ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))
SELECT key, pos FROM e WHERE n = 8 QUALIFY row_number() OVER (PARTITION BY key ORDER BY e, pos DESC) = 1""")
def quietest_windows(spark, d):
    s = load(spark, d, "lineitem").selectExpr("l_suppkey AS key", "(l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS pos", "cast(l_quantity AS bigint) AS sample")
    return audio.quietest_position(s, 8)


# Evaluation -------------------------------------------------------------------------
# Every eighth spoken text is missing; the windows of the others meet no other row of
# their video, so their best candidate is their own row.


def _heard(spark, d) -> DataFrame:
    return load(spark, d, "speech").where("seq % 8 <> 2").withColumn("source", F.lit("ON-SCREEN"))


_SIM = "CASE WHEN seq % 8 = 2 THEN 0.0 WHEN seq % 8 = 0 THEN 2.0 * length(text) / (2 * length(text) + 1) ELSE 1.0 END"


@query(f"""SELECT video_id, seq AS gt_seq, {_SIM} >= 0.85 AS matched, round({_SIM}, 6) AS similarity, {_SIM} >= 0.5 AND {_SIM} < 0.85 AS near_miss FROM {{speech}}""")
def per_text_results(spark, d):
    return evaluation.per_text(_heard(spark, d), load(spark, d, "expected")).select("video_id", "gt_seq", "matched", F.round("similarity", 6).alias("similarity"), "near_miss")


@query(f"""WITH s AS (SELECT *, {_SIM} AS sim, seq % 8 <> 6 AS req, seq % 8 <> 2 AS heard FROM {{speech}})
SELECT video_id, CASE WHEN count(*) FILTER (req) > 0 THEN count(*) FILTER (req AND sim >= 0.85) / count(*) FILTER (req) ELSE 1.0 END AS recall,
  CASE WHEN count(*) FILTER (heard) > 0 THEN count(*) FILTER (heard AND sim >= 0.85) / count(*) FILTER (heard) ELSE 1.0 END AS "precision", round(avg(sim) FILTER (req AND sim >= 0.85), 6) AS mean_match_similarity FROM s GROUP BY video_id""")
def video_scores(spark, d):
    return evaluation.score(_heard(spark, d), load(spark, d, "expected")).select("video_id", "recall", "precision", F.round("mean_match_similarity", 6).alias("mean_match_similarity"))


@query(f"""WITH s AS (SELECT *, {_SIM} >= 0.85 AS ok, seq % 8 <> 6 AS req, seq % 8 <> 2 AS heard FROM {{speech}})
SELECT video_id, count(*) FILTER (heard) AS total_segments, CAST(0 AS BIGINT) AS junk_count, count(*) FILTER (heard AND NOT ok) AS unmatched_count,
  CASE WHEN count(*) FILTER (req) > 0 THEN count(*) FILTER (req AND ok) / count(*) FILTER (req) ELSE 1.0 END AS retained_overlay_recall, CAST(0 AS DOUBLE) AS junk_rate,
  CASE WHEN count(*) FILTER (heard) > 0 THEN count(*) FILTER (heard AND NOT ok) / count(*) FILTER (heard) ELSE 0.0 END AS unmatched_rate FROM s GROUP BY video_id""")
def noise_metrics(spark, d):
    expected = load(spark, d, "expected").withColumn("appearances", F.expr("cast(NULL AS array<struct<start:double,end:double>>)"))
    return evaluation.noise(_heard(spark, d), expected)


# Texts spread over two or three rows, several appearances and short noise: the definition step by step.
_BEST = f"""m AS MATERIALIZED (SELECT * FROM {{marks}}), g AS MATERIALIZED (SELECT * FROM {{sought}}),
near AS MATERIALIZED (SELECT g.video_id, gt_seq, g.text AS gt_text, m.seq, m."start" AS st, m."end" AS en, m.text AS t FROM m JOIN g ON g.video_id = m.video_id AND (g."start" IS NULL OR m."end" >= g."start") AND (g."end" IS NULL OR m."start" <= g."end")),
two AS MATERIALIZED (SELECT a.video_id, a.gt_seq, a.gt_text, a.seq AS i, b.seq AS j, a.st AS i_st, b.st AS j_st, a.t AS i_t, b.t AS j_t FROM near a JOIN near b ON a.video_id = b.video_id AND a.gt_seq = b.gt_seq AND a.seq < b.seq AND abs(a.st - b.st) <= 2),
{_lcs_of("r", "SELECT lower(t) AS s, lower(gt_text) AS u FROM near UNION ALL SELECT lower(concat(i_t, ' ', j_t)), lower(gt_text) FROM two UNION ALL SELECT lower(concat(j_t, ' ', i_t)), lower(gt_text) FROM two")},
one AS MATERIALIZED (SELECT video_id, gt_seq, count(*) AS n, arg_max(struct_pack(sim := r, t := t), struct_pack(sim := r, k := -seq)) AS o FROM near JOIN r ON s = lower(t) AND u = lower(gt_text) GROUP BY ALL),
pair AS MATERIALIZED (SELECT video_id, gt_seq, gt_text, arg_max(struct_pack(sim := greatest(x.r, y.r), t := CASE WHEN x.r >= y.r THEN concat(i_t, ' ', j_t) ELSE concat(j_t, ' ', i_t) END, i := i, j := j, i_st := i_st, j_st := j_st, i_t := i_t, j_t := j_t), struct_pack(sim := greatest(x.r, y.r), a := -i, b := -j)) AS p
  FROM two JOIN r x ON x.s = lower(concat(i_t, ' ', j_t)) AND x.u = lower(gt_text) JOIN r y ON y.s = lower(concat(j_t, ' ', i_t)) AND y.u = lower(gt_text) GROUP BY ALL HAVING max(greatest(x.r, y.r)) > 0),
told AS MATERIALIZED (SELECT one.video_id, one.gt_seq, n, CASE WHEN o.sim > 0 THEN o.sim ELSE 0 END AS s1, CASE WHEN o.sim > 0 THEN o.t END AS t1, p, coalesce(p.sim > CASE WHEN o.sim > 0 THEN o.sim ELSE 0 END, FALSE) AS by2 FROM one LEFT JOIN pair ON pair.video_id = one.video_id AND pair.gt_seq = one.gt_seq),
three AS MATERIALIZED (SELECT near.video_id, near.gt_seq, near.gt_text, near.seq, p.i AS i, p.j AS j, unnest(range(0, 6)) AS nth, unnest([concat_ws(' ', t, p.i_t, p.j_t), concat_ws(' ', t, p.j_t, p.i_t), concat_ws(' ', p.i_t, t, p.j_t), concat_ws(' ', p.i_t, p.j_t, t), concat_ws(' ', p.j_t, t, p.i_t), concat_ws(' ', p.j_t, p.i_t, t)]) AS joined
  FROM near JOIN told ON told.video_id = near.video_id AND told.gt_seq = near.gt_seq WHERE by2 AND p.sim < 0.85 AND n >= 3 AND near.seq <> p.i AND near.seq <> p.j AND greatest(st, p.i_st, p.j_st) - least(st, p.i_st, p.j_st) <= 2),
{_lcs_of("r3", "SELECT lower(joined) AS s, lower(gt_text) AS u FROM three")},
triple AS MATERIALIZED (SELECT video_id, gt_seq, arg_max(struct_pack(sim := r, t := joined, i := i, j := j, k := seq), struct_pack(sim := r, a := -seq, b := -nth)) AS q FROM three JOIN r3 ON s = lower(joined) AND u = lower(gt_text) GROUP BY ALL HAVING max(r) > 0),
each AS (SELECT g.video_id, g.gt_seq, g.text, g.required, CASE WHEN by3 THEN list_sort([q.i, q.j, q.k]) WHEN by2 THEN [p.i, p.j] ELSE [] END AS used, CASE WHEN by3 THEN q.t ELSE s2t END AS best, CASE WHEN by3 THEN q.sim ELSE coalesce(s2, 0) END AS sim FROM g
  LEFT JOIN (SELECT told.*, q, CASE WHEN by2 THEN p.sim ELSE s1 END AS s2, CASE WHEN by2 THEN p.t ELSE t1 END AS s2t, coalesce(q.sim > CASE WHEN by2 THEN p.sim ELSE s1 END, FALSE) AS by3 FROM told LEFT JOIN triple ON triple.video_id = told.video_id AND triple.gt_seq = told.gt_seq) x ON x.video_id = g.video_id AND x.gt_seq = g.gt_seq),
res AS MATERIALIZED (SELECT video_id, gt_seq, text, required, last_value(used) OVER w AS used, last_value(best) OVER w AS best, last_value(sim) OVER w AS sim FROM each WINDOW w AS (PARTITION BY video_id, text ORDER BY gt_seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
hit AS MATERIALIZED (SELECT DISTINCT video_id, seq FROM near JOIN r ON s = lower(t) AND u = lower(gt_text) WHERE r >= 0.85)"""


@query(f"""WITH RECURSIVE {_BEST}
SELECT video_id, gt_seq, text AS expected_text, best AS best_candidate, round(sim, 6) AS similarity, array_to_string(used, ',') AS used, sim >= 0.85 AS matched, sim >= 0.5 AND sim < 0.85 AS near_miss FROM res""")
def joined_texts(spark, d):
    """Best single rows, pairs and triples of rows for each expected text."""
    r = evaluation.per_text(load(spark, d, "marks"), load(spark, d, "sought"))
    return r.select("video_id", "gt_seq", "expected_text", "best_candidate", F.round("similarity", 6).alias("similarity"), F.array_join("used", ",").alias("used"), "matched", "near_miss")


@query(f"""WITH RECURSIVE {_BEST},
ph AS (SELECT video_id, seq FROM hit UNION SELECT video_id, unnest(used) FROM res WHERE sim >= 0.85),
rc AS (SELECT video_id, count(*) FILTER (required) AS need, count(*) FILTER (required AND sim >= 0.85) AS found, avg(sim) FILTER (required AND sim >= 0.85) AS mean FROM res GROUP BY video_id),
n AS (SELECT video_id, count(*) AS n FROM m GROUP BY video_id), h AS (SELECT video_id, count(*) AS h FROM ph GROUP BY video_id)
SELECT coalesce(rc.video_id, n.video_id) AS video_id, round(CASE WHEN need > 0 THEN found / need ELSE 1 END, 6) AS recall, round(CASE WHEN n > 0 THEN coalesce(h, 0) / n ELSE 1 END, 6) AS "precision", round(mean, 6) AS mean_match_similarity
FROM rc FULL JOIN n ON rc.video_id = n.video_id LEFT JOIN h ON h.video_id = coalesce(rc.video_id, n.video_id)""")
def joined_scores(spark, d):
    r = evaluation.score(load(spark, d, "marks"), load(spark, d, "sought"))
    return r.select("video_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "mean_match_similarity")])


@query(f"""WITH RECURSIVE m AS MATERIALIZED (SELECT * FROM {{marks}}), o AS (SELECT * FROM m WHERE source <> 'SPEECH'), g AS MATERIALIZED (SELECT * FROM {{sought}}),
w AS MATERIALIZED (SELECT video_id, gt_seq, text, 0 AS nth, "start" AS a, "end" AS b FROM g WHERE required UNION ALL SELECT video_id, gt_seq, text, 1, "start" + 30, "end" + 30 FROM g WHERE required AND gt_seq % 2 = 0),
{_lcs_of("r", "SELECT x.t AS s, y.t AS u FROM (SELECT DISTINCT lower(text) AS t FROM m) x, (SELECT DISTINCT lower(text) AS t FROM g) y")},
seen AS (SELECT DISTINCT w.video_id, gt_seq, nth FROM w JOIN m ON m.video_id = w.video_id AND (a IS NULL OR m."end" >= a) AND (b IS NULL OR m."start" <= b) JOIN r ON s = lower(m.text) AND u = lower(w.text) WHERE r >= 0.85),
kept AS (SELECT w.video_id, count(seen.nth) / count(*) AS k FROM w LEFT JOIN seen ON seen.video_id = w.video_id AND seen.gt_seq = w.gt_seq AND seen.nth = w.nth GROUP BY w.video_id),
ok AS (SELECT DISTINCT o.video_id, o.seq FROM o JOIN g ON g.video_id = o.video_id AND (g."start" IS NULL OR o."end" >= g."start") AND (g."end" IS NULL OR o."start" <= g."end") JOIN r ON s = lower(o.text) AND u = lower(g.text) WHERE r >= 0.85),
n AS (SELECT o.video_id, count(*) AS total, count(*) FILTER (ok.seq IS NULL) AS bad, count(*) FILTER (ok.seq IS NULL AND "end" - "start" < 1.5) AS junk FROM o LEFT JOIN ok ON ok.video_id = o.video_id AND ok.seq = o.seq GROUP BY o.video_id)
SELECT coalesce(n.video_id, kept.video_id) AS video_id, coalesce(total, 0) AS total_segments, coalesce(junk, 0) AS junk_count, coalesce(bad, 0) AS unmatched_count, round(coalesce(k, 1), 6) AS retained_overlay_recall, round(CASE WHEN total > 0 THEN junk / total ELSE 0 END, 6) AS junk_rate, round(CASE WHEN total > 0 THEN bad / total ELSE 0 END, 6) AS unmatched_rate
FROM n FULL JOIN kept ON kept.video_id = n.video_id""")
def appearance_noise(spark, d):
    """Noise with short rows, and texts that appear twice."""
    again = "array(named_struct('start', start, 'end', end), named_struct('start', start + 30, 'end', end + 30))"
    g = load(spark, d, "sought").withColumn("appearances", F.expr(f"CASE WHEN gt_seq % 2 = 0 THEN {again} END"))
    r = evaluation.noise(load(spark, d, "marks"), g)
    return r.select("video_id", "total_segments", "junk_count", "unmatched_count", *[F.round(c, 6).alias(c) for c in ("retained_overlay_recall", "junk_rate", "unmatched_rate")])


@query("""SELECT video_id, "key" AS canonical_key, arg_min(text, seq) AS canonical_text, count(*) AS occurrence_count, round(avg(normalized_height), 6) AS mean_normalized_height,
  round(CASE WHEN count(*) > 1 THEN sqrt(var_pop(x_center_norm) + var_pop(y_center_norm)) END, 6) AS position_stability, bool_or(matched) AS matched FROM {geometry} GROUP BY video_id, "key" """)
def spatial_stats(spark, d):
    g = load(spark, d, "geometry")
    own = evaluation.spatial(g, g.select("video_id", "key").distinct().withColumn("cluster", F.col("key")))
    return own.select("video_id", F.col("cluster").alias("canonical_key"), "canonical_text", "occurrence_count", F.round("mean_normalized_height", 6).alias("mean_normalized_height"), F.round("position_stability", 6).alias("position_stability"), "matched")


@query(f"""WITH RECURSIVE geo AS MATERIALIZED (SELECT * FROM {{geometry}}),
{_clusters_of('SELECT video_id, "key" AS key, min(seq) AS first_seq FROM geo GROUP BY ALL', 0.6)}
SELECT video_id, arg_min(text, seq) AS canonical_text, count(*) AS occurrence_count, round(avg(normalized_height), 6) AS mean_normalized_height, round(CASE WHEN count(*) > 1 THEN sqrt(var_pop(x_center_norm) + var_pop(y_center_norm)) END, 6) AS position_stability, bool_or(matched) AS matched FROM geo JOIN clustered USING (video_id, key) GROUP BY video_id, first""")
def spatial_clusters(spark, d):
    g = load(spark, d, "geometry")
    keys = g.groupBy("video_id", "key").agg(F.min("seq").alias("first_seq"))
    own = evaluation.spatial(g, segments.cluster_keys(keys, 0.6))
    return own.select("video_id", "canonical_text", "occurrence_count", F.round("mean_normalized_height", 6).alias("mean_normalized_height"), F.round("position_stability", 6).alias("position_stability"), "matched")


@query("""SELECT matched, count(*) AS n, min(normalized_height) AS min_height, max(normalized_height) AS max_height, round(avg(normalized_height), 6) AS mean_height FROM {geometry} GROUP BY matched""")
def height_separation(spark, d):
    return evaluation.heights(load(spark, d, "geometry")).withColumn("mean_height", F.round("mean_height", 6))


_SUM = """s AS (SELECT language, ocr_model_set, count(*) AS clips, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(segments) AS BIGINT) AS segments, CAST(sum(unmatched) AS BIGINT) AS unmatched, sum(raw_recall * expected) AS w, list_sort(list(DISTINCT clip)) AS clip_names FROM {records} GROUP BY ALL),
r AS (SELECT *, CASE WHEN expected > 0 THEN matched / expected ELSE 1.0 END AS recall, CASE WHEN segments > 0 THEN unmatched / segments ELSE 0.0 END AS unmatched_rate, CASE WHEN expected > 0 THEN w / expected ELSE 1.0 END AS raw_recall FROM s)"""


@query(f"WITH {_SUM} SELECT language, ocr_model_set, clips, expected, matched, segments, unmatched, array_to_string(clip_names, ',') AS clip_names, round(recall, 6) AS recall, round(unmatched_rate, 6) AS unmatched_rate, round(raw_recall, 6) AS raw_recall FROM r")
def pooled_summary(spark, d):
    s = evaluation.summarize(load(spark, d, "records")).withColumn("clip_names", F.array_join("clip_names", ","))
    return s.withColumns({c: F.round(c, 6) for c in ("recall", "unmatched_rate", "raw_recall")})


_LINE = "matched::BIGINT || '/' || expected::BIGINT || ' = ' || printf('%.3f', recall) || ' | ' || printf('%.3f', raw_recall) || ' | ' || printf('%.3f', unmatched_rate) || ' | ' || segments::BIGINT || ' |'"


@query(f"""SELECT language, clip, ocr_model_set, '| ' || clip || ' | ' || language || ' | ' || ocr_model_set || ' | ' || {_LINE} AS line FROM (
  SELECT * REPLACE (CASE WHEN expected > 0 THEN raw_recall ELSE 1.0 END AS raw_recall), CASE WHEN expected > 0 THEN matched / expected ELSE 1.0 END AS recall, unmatched / segments AS unmatched_rate FROM {{records}})""")
def clip_table(spark, d):
    return evaluation.clip_table(load(spark, d, "records"))


@query(f"WITH {_SUM} SELECT language, ocr_model_set, '| ' || language || ' | ' || ocr_model_set || ' | ' || clips || ' | ' || {_LINE} AS line FROM r")
def language_table(spark, d):
    return evaluation.language_table(evaluation.summarize(load(spark, d, "records")))


@query("""WITH l AS (SELECT user_id % 20 AS run, event_id AS seq, CASE event_id % 5 WHEN 0 THEN concat('Using /m/', event_type, '_det_v', event_id % 7, '.onnx') WHEN 1 THEN concat('Using /m/x/', event_type, '-rec.', event_id % 9, '.onnx') WHEN 2 THEN concat('loading /m/', event_type, '_det_1.onnx') WHEN 3 THEN 'Using cls.onnx' END AS m FROM events)
SELECT run, arg_max(regexp_extract(m, '([^/]+)$', 1), seq) FILTER (m LIKE 'Using%' AND m LIKE '%_det_%') AS det, arg_max(regexp_extract(m, '([^/]+)$', 1), seq) FILTER (m LIKE 'Using%' AND m LIKE '%-rec.%') AS rec FROM l GROUP BY run""")
def recogniser_models(spark, d):
    log = load(spark, d, "events").selectExpr("user_id % 20 AS run", "event_id AS seq", "CASE event_id % 5 WHEN 0 THEN concat('Using /m/', event_type, '_det_v', event_id % 7, '.onnx') WHEN 1 THEN concat('Using /m/x/', event_type, '-rec.', event_id % 9, '.onnx') WHEN 2 THEN concat('loading /m/', event_type, '_det_1.onnx') WHEN 3 THEN 'Using cls.onnx' END AS message")
    return profiles.recogniser_models(log)


@query("""SELECT ocr_model_set, round(sum(matched) / sum(expected), 6) AS recall FROM {records} GROUP BY 1 HAVING sum(expected) > 0""")
def overall_recall(spark, d):
    return evaluation.overall_recall(evaluation.summarize(load(spark, d, "records"))).withColumn("recall", F.round("recall", 6))


@query(f"""WITH {_SUM}, l AS (SELECT unnest(['en', 'de', 'fr', 'es', 'pt']) AS scope), j AS (SELECT scope, b.recall AS br, c.recall AS cr, b.unmatched_rate AS bu, c.unmatched_rate AS cu, b.clip_names AS bn, c.clip_names AS cn FROM l LEFT JOIN r b ON b.language = scope AND b.ocr_model_set = 'base' LEFT JOIN r c ON c.language = scope AND c.ocr_model_set = 'new'),
o AS (SELECT sum(matched) FILTER (ocr_model_set = 'base') / sum(expected) FILTER (ocr_model_set = 'base') AS b, sum(matched) FILTER (ocr_model_set = 'new') / sum(expected) FILTER (ocr_model_set = 'new') AS c FROM r)
SELECT scope, 'no results' AS reason FROM j WHERE br IS NULL OR cr IS NULL UNION ALL SELECT scope, 'clip sets differ' FROM j WHERE br IS NOT NULL AND cr IS NOT NULL AND bn <> cn
UNION ALL SELECT scope, 'recall' FROM j WHERE bn = cn AND cr < br - 0.02 - 1e-9 UNION ALL SELECT scope, 'unmatched_rate' FROM j WHERE bn = cn AND cu > bu + 0.02 + 1e-9 UNION ALL SELECT 'overall', 'recall' FROM o WHERE c < b - 1e-9""")
def model_set_verdict(spark, d):
    return evaluation.verdict(evaluation.summarize(load(spark, d, "records")), "base", "new")


_SHOP = "CASE WHEN text = 'RF' THEN '@shop' ELSE text END"
_CUT_LINES = """g AS (SELECT sv.*, ln.line, x0 - lag(x1) OVER (PARTITION BY sv.video_id, sv.frame_ts, line ORDER BY xc, sv.r) > mh * 2.0 AS cut FROM sv JOIN ln USING (video_id, frame_ts, r)),
q AS (SELECT *, CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, frame_ts, line ORDER BY xc, r) AS INTEGER) AS chunk FROM g),
lines AS MATERIALIZED (SELECT video_id, frame_ts, line, chunk, string_agg(text, ' ' ORDER BY xc, r) AS text, avg(score) AS score FROM q GROUP BY ALL)"""


@query("WITH RECURSIVE " + _KEPT.replace("{rects}", f"(SELECT * REPLACE ({_SHOP} AS text) FROM {{rects}})") + f""",
{_CUT_LINES},
shown AS MATERIALIZED (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_ts, line, chunk) - 1 AS seq, frame_ts AS "start", frame_ts AS "end", text, 'ON-SCREEN' AS source, score AS ocr_confidence FROM lines),
fits AS MATERIALIZED (SELECT * FROM shown WHERE {_FITS}),
{_recurring_of("fits", "SELECT video_id, count(DISTINCT frame_ts) AS f FROM {rects} GROUP BY video_id", 0.3, 0.9)},
{_dedup_of("kept2")},
{_merge_of("{marks} WHERE source = 'SPEECH'", "dd")},
n AS (SELECT 1 AS stage_no, 'raw_bboxes' AS stage, count(*) AS n FROM {{rects}} UNION ALL SELECT 2, 'post_aggregation', count(*) FROM lines UNION ALL SELECT 3, 'post_extract', count(*) FROM shown UNION ALL SELECT 4, 'post_pattern_filter', count(*) FROM fits
  UNION ALL SELECT 5, 'post_frequency_filter', count(*) FROM kept2 UNION ALL SELECT 6, 'post_dedup', count(*) FROM dd UNION ALL SELECT 7, 'final_on_screen_both', count(*) FROM merged WHERE source <> 'SPEECH')
SELECT stage_no, stage, n, round(CASE WHEN lag(n) OVER (ORDER BY stage_no) > 0 THEN (lag(n) OVER (ORDER BY stage_no) - n) * 100.0 / lag(n) OVER (ORDER BY stage_no) END, 6) AS drop_percent FROM n""".replace("kept AS MATERIALIZED (SELECT * FROM m", "kept2 AS MATERIALIZED (SELECT * FROM m"))
def funnel_report(spark, d):
    """All seven counters of one run from boxes to the merged transcript."""
    found = _boxes(spark, d).withColumn("text", F.expr(_SHOP))
    seen = found.groupBy("video_id").agg(F.count_distinct("frame_ts").alias("frame_count"))
    _, funnel = chain.transcript(found, load(spark, d, "marks").where("source = 'SPEECH'"), _profiles_of(spark, d), seen, share=0.3)
    return funnel.counts(spark).withColumn("drop_percent", F.round("drop_percent", 6))


@query("""SELECT language, ocr_model_set, CASE WHEN grouping(ocr_model_set) = 1 THEN 3 WHEN grouping(language) = 1 THEN 1 ELSE 0 END AS level, count(*) AS clips, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(segments) AS BIGINT) AS segments, CAST(sum(unmatched) AS BIGINT) AS unmatched,
  round(CASE WHEN sum(expected) > 0 THEN sum(matched) / sum(expected) WHEN grouping(language) = 0 THEN 1.0 END, 6) AS recall, round(CASE WHEN sum(segments) > 0 THEN sum(unmatched) / sum(segments) ELSE 0.0 END, 6) AS unmatched_rate FROM {records} GROUP BY GROUPING SETS ((language, ocr_model_set), (ocr_model_set), ())""")
def summary_levels(spark, d):
    s = evaluation.summary_levels(load(spark, d, "records"))
    return s.withColumns({c: F.round(c, 6) for c in ("recall", "unmatched_rate")})


# Batch manifest ---------------------------------------------------------------------


@query("""WITH l AS (SELECT min(page_id) AS seq, url AS source FROM pages GROUP BY url), st AS (SELECT url AS source, page_id, CASE WHEN page_id % 3 = 0 THEN 'failed' ELSE 'done' END AS status FROM pages WHERE page_id % 4 <> 0),
f AS (SELECT source, arg_min(status, page_id) AS status FROM st GROUP BY source) SELECT seq, source, coalesce(status, 'pending') AS status FROM l LEFT JOIN f USING (source)""")
def manifest_reconcile(spark, d):
    pages = load(spark, d, "pages")
    urls = pages.groupBy(F.col("url").alias("source")).agg(F.min("page_id").alias("seq"))
    state = pages.where("page_id % 4 <> 0").selectExpr("page_id AS seq", "url AS source", "CASE WHEN page_id % 3 = 0 THEN 'failed' ELSE 'done' END AS status", "cast(NULL AS string) AS output_path", "cast(NULL AS string) AS error")
    return manifest.reconcile(urls, state).select("seq", "source", "status")


@query("""SELECT CASE page_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' ELSE 'pending' END AS status, count(*) AS n FROM pages GROUP BY 1""")
def status_counts(spark, d):
    return manifest.status_counts(load(spark, d, "pages").selectExpr("CASE page_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' ELSE 'pending' END AS status"))


@query("""WITH l AS (SELECT page_id AS line_no, CASE WHEN page_id % 4 = 0 THEN [url || '#1', url || '#2'] WHEN page_id % 4 = 1 THEN [] ELSE [url] END AS e FROM pages)
SELECT row_number() OVER (ORDER BY line_no, pos) - 1 AS seq, source FROM (SELECT line_no, unnest(e) AS source, generate_subscripts(e, 1) AS pos FROM l)""")
def playlist_expansion(spark, d):
    entry = "named_struct('url', {}, 'webpage_url', {}, 'id', {})"
    none = "cast(NULL AS string)"
    two = f"array({entry.format(repr(''), 'concat(url, ' + repr('#1') + ')', none)}, {entry.format('concat(url, ' + repr('#2') + ')', none, none)}, {entry.format(repr(''), none, none)})"
    pages = load(spark, d, "pages").selectExpr("page_id AS line_no", "url AS source", "CASE WHEN page_id % 4 < 2 THEN 'playlist' ELSE 'video' END AS kind", f"CASE WHEN page_id % 4 = 0 THEN {two} ELSE slice({two}, 1, 0) END AS entries")
    return manifest.expand(pages.withColumn("expanded", manifest.playlist(F.col("kind"), F.col("entries"), F.col("source"))))


@query("""WITH s AS (SELECT page_id AS seq, concat('in/clip', page_id % 10, '.mp4') AS source, page_id % 10 AS k FROM pages)
SELECT seq, source, concat('out/clip', k, CASE WHEN row_number() OVER (PARTITION BY k ORDER BY seq) > 1 THEN concat('(', row_number() OVER (PARTITION BY k ORDER BY seq), ')') ELSE '' END, '.srt') AS output_path FROM s""")
def output_paths(spark, d):
    items = load(spark, d, "pages").selectExpr("page_id AS seq", "concat('in/clip', page_id % 10, '.mp4') AS source", "cast(NULL AS string) AS video_id")
    return manifest.output_paths(items, "out", ".srt")


@query(f"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\x0B\\x0C\\r\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS line, generate_subscripts(regexp_split_to_array(text, '\\r\\n|[\\n\\x0B\\x0C\\r\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]'), 1) - 1 AS line_no FROM documents)
SELECT doc_id, line_no, md5({_STRIP.format('line')}) AS line_md5 FROM l WHERE {_STRIP.format('line')} <> ''""")
def list_lines(spark, d):
    files = load(spark, d, "documents").select(F.col("doc_id").alias("path"), F.concat(F.lit("\ufeff"), "text").alias("value"))
    return manifest.parse_list(files).select(F.col("path").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), F.md5("source").alias("line_md5"))


# The whole chain ----------------------------------------------------------------------


@query(f"""WITH RECURSIVE fits AS MATERIALIZED (SELECT * FROM {{points}} WHERE {_FITS}),
{_recurring_of("fits", _READ, 0.95, 0.9)},
{_dedup_of("kept")},
{_merge_of("{points} WHERE source = 'SPEECH'", "dd")}
SELECT video_id, seq, "start", "end", text, source, round(o_conf, 6) AS ocr_confidence FROM merged""")
def transcript_chain(spark, d):
    """Pattern filter, recurrence filter, dedup and merge, in this order."""
    points = load(spark, d, "points")
    counts = _frames_read(points)
    shown = segments.drop_recurring(segments.drop_patterns(points, _profiles_of(spark, d)), counts)
    told = stored(segments.dedup(shown.where(F.col("source") == "ON-SCREEN")), "told")
    merged = segments.merge(points.where("source = 'SPEECH'").select(*segments.COLUMNS), told)
    return merged.select("video_id", "seq", "start", "end", "text", "source", F.round("ocr_confidence", 6).alias("ocr_confidence"))
