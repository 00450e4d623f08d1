"""Text and time functions as Column expressions (no Python workers).

White space is one explicit class in every pattern here, because the regular
expression dialects of Spark and of other engines disagree on ``\\s``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode white space, with the four information separators (fixed values).
WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
WS_CLASS = f"[{WS}]"
#: Ends of the lines of a text file (fixed values).
LINE_END = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]"
#: Characters that file names cannot hold.
BAD_NAME = r"""[<>:"/\\|?*\x00-\x1F]"""


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text) -> Column:
    return F.btrim(_col(text), F.lit(WS))


def fold(text) -> Column:
    """Case folding for Latin scripts: lower case, with the sharp s written out."""
    return F.replace(F.lower(_col(text)), F.lit("ß"), F.lit("ss"))


def canonical_key(text) -> Column:
    """Identity of a text: folded and stripped, inner white space kept."""
    return strip(fold(text))


#: Characters whose case folding the two functions above do not know.
BEYOND_LATIN = "[^\x00-\xFF]|\xB5"


@F.pandas_udf(T.StringType())
def canonical_key_unicode(text):  # noqa: ANN001
    """The same by full Unicode case folding, for scripts beyond Latin."""
    return text.map(lambda t: None if t is None else t.casefold().strip())


def full_key(text) -> Column:
    """``canonical_key`` by full case folding; only texts with characters
    beyond Latin-1 are sent to Python, the others go there as nulls."""
    return F.coalesce(canonical_key_unicode(F.when(_col(text).rlike(BEYOND_LATIN), _col(text))), canonical_key(text))


def cue(text) -> Column:
    """One line: runs of white space become one space, ends are stripped."""
    return F.trim(F.regexp_replace(_col(text), f"{WS_CLASS}+", " "))


def overlaps(a_start, a_end, b_start, b_end) -> Column:
    """Closed intervals that touch or overlap."""
    return (_col(a_start) <= _col(b_end)) & (_col(b_start) <= _col(a_end))


def in_window(start, end, window_start, window_end) -> Column:
    """A segment meets a closed window whose null ends are open."""
    ws, we = _col(window_start), _col(window_end)
    return (ws.isNull() | (_col(end) >= ws)) & (we.isNull() | (_col(start) <= we))


def srt_time(seconds) -> Column:
    """HH:MM:SS,mmm with half-even milliseconds and unbounded hours."""
    ms = F.rint(_col(seconds) * 1000).cast("long")
    part = lambda unit, n: F.pmod(F.floor(ms / unit), F.lit(n)).cast("int")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000).cast("long"), part(60000, 60), part(1000, 60), F.pmod(ms, F.lit(1000)).cast("int"))


def minute_second(seconds) -> Column:
    """m:ss of whole seconds, minutes not wrapped into hours."""
    s = _col(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60).cast("long"), F.pmod(s, F.lit(60)).cast("int"))


def markdown_escape(text) -> Column:
    """Backslash first, then the pipe, then the backtick."""
    out = _col(text)
    for c in ("\\", "|", "`"):
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    return out


def is_url(source) -> Column:
    """http:// or https://, as written (this test minds the case)."""
    return F.startswith(_col(source), F.lit("http://")) | F.startswith(_col(source), F.lit("https://"))


def is_download(source) -> Column:
    """What is fetched over the network: the same prefixes in any case."""
    return _col(source).rlike("^(?i:https?://)")


def local_stem(path) -> Column:
    """File name without its last suffix, with bad characters replaced; names
    that begin with their only dot keep it, an empty name becomes ``file``."""
    name = F.regexp_extract(F.regexp_replace(_col(path), "/+$", ""), "([^/]*)$", 1)
    stem = F.when(name.rlike(r"^.+\.[^.]+$") & ~name.rlike(r"^\.+[^.]*$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)
    clean = F.regexp_replace(stem, BAD_NAME, "_")
    return F.when(clean == "", "file").otherwise(clean)


def hash_stem(source) -> Column:
    return F.substring(F.sha2(_col(source).cast("binary"), 256), 1, 12)


def output_stem(source, video_id) -> Column:
    """Stem of an output file: the video id or a hash for URLs, the file's own
    stem otherwise, at most 200 characters."""
    url = F.regexp_replace(F.coalesce(F.nullif(_col(video_id), F.lit("")), hash_stem(source)), BAD_NAME, "_")
    return F.substring(F.when(is_url(source), url).otherwise(local_stem(source)), 1, 200)


def finite_time(seconds, most: float = 1e9) -> Column:
    """A usable time: a number, not NaN, at most ``most`` in size."""
    s = _col(seconds)
    return s.isNotNull() & ~F.isnan(s) & (F.abs(s) <= most)


def retry_delay(attempt, retry_after, jitter=0.0, base: float = 1.0, cap: float = 60.0) -> Column:
    """Seconds before a retry: a numeric Retry-After up to the cap, else the
    doubled base up to the cap, stretched by the jitter up to the cap again."""
    told = F.when(F.trim(_col(retry_after)).rlike(r"^\d+(\.\d+)?$"), F.trim(_col(retry_after)).cast("double"))
    grown = F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(_col(attempt), F.lit(16))), F.lit(cap))
    return F.coalesce(F.when(told.isNotNull(), F.least(told, F.lit(cap))), F.least(grown * (1 + (F.lit(jitter) if isinstance(jitter, float) else jitter)), F.lit(cap)))


def output_format(flag, env, path, default: str = "json") -> Column:
    """The flag, else a non-empty setting, else a known suffix in any case, else JSON."""
    suffix = F.regexp_extract(F.lower(_col(path)), r"[^/\\]\.(json|txt|srt|md)$", 1)
    return F.coalesce(_col(flag), F.nullif(_col(env), F.lit("")), F.nullif(suffix, F.lit("")), F.lit(default))
