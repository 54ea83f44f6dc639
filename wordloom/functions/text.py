"""Text functions: Column in, Column out, on the JVM but for those that need Unicode normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: White space as Python's str.split sees it: \s of Java misses the Unicode separators.
BLANKS = r"[\s\p{Z}\x85\x1c-\x1f]+"
NOT_BLANK = r"[^\s\p{Z}\x85\x1c-\x1f]"


#: Text on which NFKC changes nothing and lower-casing, with ss for ß, is case folding: ASCII, most Latin letters of Europe,
#: Cyrillic, Han and kana. Everything else goes through Python's tables.
PLAIN = r"^[\x00-\x7F\u00C0-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0400-\u045F\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF]*$"


def lowered(text: Column) -> Column:
    """Case folded, for PLAIN text."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def _by_table(text: Column, plain: Column, table) -> Column:
    """`plain` where the text is PLAIN; elsewhere what the Python function makes of it: it is given nothing else."""
    easy = text.rlike(PLAIN)
    return F.when(easy, plain).otherwise(table(F.when(~easy, text)))


def folded(text: Column) -> Column:
    """Case folded."""
    return _by_table(text, lowered(text), _casefolded)


def normalize_word(word: Column) -> Column:
    """NFKC, folded, apostrophes, letters and digits only (F1, F2)."""
    return _by_table(word, F.regexp_replace(lowered(word), r"[^'\p{L}\p{N}]", ""), normalize_word_nfkc)


def plain_clean_word(word: Column) -> Column:
    """clean_word for PLAIN text."""
    return F.regexp_replace(word, r"[^'\p{L}\p{N}]", "")


def clean_word(word: Column) -> Column:
    """NFKC, apostrophes, letters and digits, case kept."""
    return _by_table(word, plain_clean_word(word), clean_word_nfkc)


def clean_words(line: Column) -> Column:
    """clean_word of every token of a line, as an array: where the line is PLAIN no token leaves the JVM."""
    return F.coalesce(odd_clean_words(line), F.transform(tokens(line), plain_clean_word))


def odd_clean_words(line: Column) -> Column:
    """clean_word of every token of a line that isn't PLAIN, as an array; null for a PLAIN one, whose tokens needn't leave
    the JVM."""
    return _clean_words_nfkc(F.when(~line.rlike(PLAIN), tokens(line)))


def _kept(text: str) -> str:
    return "".join(c for c in text if c == "'" or unicodedata.category(c)[0] in "LN")


@F.pandas_udf(StringType())
def normalize_word_nfkc(words: pd.Series) -> pd.Series:
    """F1 for any text: NFKC, case folding, then filtering."""
    return words.map(lambda w: None if w is None else normal_form(w))


def normal_form(word: str) -> str:
    return _kept(unicodedata.normalize("NFKC", word).casefold())


@F.pandas_udf(StringType())
def clean_word_nfkc(words: pd.Series) -> pd.Series:
    """F3 for any text: NFKC, then filtering; case is kept."""
    return words.map(lambda w: None if w is None else _kept(unicodedata.normalize("NFKC", w)))


@F.pandas_udf(StringType())
def join_key_nfkc(words: pd.Series) -> pd.Series:
    """F3's comparison form: case folding comes after the filter, so it may bring back marks that F1 drops."""
    return words.map(lambda w: None if w is None else _kept(unicodedata.normalize("NFKC", w)).casefold())


@F.pandas_udf(StringType())
def _casefolded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t.casefold())


@F.pandas_udf(ArrayType(StringType()))
def _clean_words_nfkc(lines: pd.Series) -> pd.Series:
    return lines.map(lambda words: None if words is None else [_kept(unicodedata.normalize("NFKC", w)) for w in words])


def folded_key(word: Column) -> Column:
    """Word characters and apostrophes, underscores too, of what is folded already."""
    return F.regexp_replace(word, r"[^\p{L}\p{N}_']", "")


def stitch_key(word: Column) -> Column:
    """Folded, word characters and apostrophes, underscores too."""
    return folded_key(folded(word))


def stitch_keys(text: Column) -> Column:
    """The join keys of a text's tokens; folding leaves white space as it is."""
    return F.transform(tokens(folded(text)), folded_key)


def quality_tokens(text: Column) -> Column:
    """Words with at most one inner apostrophe."""
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)?"), F.lit(0))


def tokens(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, BLANKS), lambda x: x != "")


def strip_tags(text: Column) -> Column:
    """[tags] within a line become a blank."""
    return F.regexp_replace(text, r"\[[^\]\n]+\]\s*", " ")


def squeezed(text: Column) -> Column:
    """Without zero-width spaces, white space single (F8)."""
    return F.array_join(tokens(F.replace(text, F.lit("​"), F.lit(""))), " ")


# Abbreviations whose point doesn't end a sentence, for the two splitters.
LINE_ABBREVIATIONS = ("mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "jr.", "st.", "vs.", "etc.", "e.g.", "i.e.", "u.s.", "a.m.", "p.m.")
WORD_ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "mt", "vs", "etc", "e.g", "i.e", "u.s", "no", "inc", "corp", "ltd", "co", "fig", "approx",
)


def is_sentence_boundary(word: Column, next_word: Column) -> Column:
    """Does a word end a sentence (F10)? `next_word` may be null."""
    bare = F.regexp_replace(word, r"[\"”’')\]}]+$", "")
    stem = F.regexp_replace(bare, r"\.$", "")
    initials = stem.rlike(r"^(?:[A-Za-z]\.)+[A-Za-z]$") & F.coalesce(next_word.rlike("^[a-z]"), F.lit(False))
    return bare.rlike(r"[!?]$") | (bare.endswith(".") & ~F.lower(stem).isin(*WORD_ABBREVIATIONS) & ~initials)


def slugify(text: Column, fallback: str = "podcast", limit: int = 72) -> Column:
    """Lower-case ASCII words joined by hyphens, cut to `limit`."""
    ascii_only = F.regexp_replace(folded(text), r"[^\x00-\x7f]", "")
    slug = F.regexp_replace(F.regexp_replace(ascii_only, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(slug, 1, limit), "-+$", ""), F.lit("")), F.lit(fallback))


# Fixed value: the form of a job's name.
def is_job_id(text: Column) -> Column:
    """(F12)"""
    return text.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$") & ~text.contains("\n")


# What is hidden, in this order, and the marks left in its place.
def redact(text: Column, limit: int = 1000) -> Column:
    """Queries of URLs, access tokens, Windows paths and POSIX paths hidden, in this order (F13, F14 with limit 240)."""
    text = F.substring(text, 1, limit)
    text = F.regexp_replace(text, r"(?i)(https?://[^\s?\"'<>]+)\?[^\s\"'<>]+", "$1?<redacted-query>")
    text = F.regexp_replace(text, r"hf_[A-Za-z0-9]{20,}", "<redacted-token>")
    text = F.regexp_replace(text, r"(?<![\p{L}\p{N}_])[A-Za-z]:[\\/][^\s\"'<>]+", "<local-path>")
    return F.regexp_replace(text, r"(?<![\p{L}\p{N}_/:])/[^\s\"'<>]+", "<local-path>")


def display_argument(text: Column) -> Column:
    """A command's argument as a log may show it (F15): secrets hidden, odd ones quoted as JSON."""
    low = F.lower(text)
    secret = low.contains("token=") | low.contains("authorization:") | low.contains("hf_token")
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("a"))), r'(?s)^\{"a":(.*)\}$', 1)
    return F.when(secret, "<redacted>").when(text.rlike("^[A-Za-z0-9_./:=+@%-]+$"), text).otherwise(quoted)


def ass_escape(text: Column) -> Column:
    """(F16)"""
    for old, new in (("\\", "\\\\"), ("{", "\\{"), ("}", "\\}"), ("\n", " ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def filter_path_escape(path: Column) -> Column:
    """A path inside a quoted filter argument."""
    for old, new in (("\\", "\\\\"), (":", "\\:"), ("'", "\\'")):
        path = F.replace(path, F.lit(old), F.lit(new))
    return path


def human_bytes(size: Column) -> Column:
    """One decimal, ties to even, and a binary unit, B to TiB."""

    def shown(power: int, unit: str) -> Column:
        return F.format_string(f"%.1f {unit}", F.bround(size / F.lit(float(1 << power)), 1))

    out = shown(40, "TiB")
    for power, unit in ((30, "GiB"), (20, "MiB"), (10, "KiB"), (0, "B")):
        out = F.when(size < F.lit(1 << power + 10), shown(power, unit)).otherwise(out)
    return out


def is_web_source(text: Column) -> Column:
    """(S3)"""
    return text.rlike("(?i)^https?://[^/]")


def url_allowed(url: Column, hosts: tuple[str, ...]) -> Column:
    """May this page be fetched (S2)? http(s), a host of the list or under it, no credentials, no playlist, some path."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    known = F.lit(False)
    for h in hosts:
        known = known | (host == h) | host.endswith("." + h)
    path = F.regexp_extract(url, r"(?i)^https?://[^/?#]+(/[^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    credentials = url.rlike(r"(?i)^https?://[^/?#]*@")
    playlist = F.lower(path).startswith("/playlist") | query.rlike(r"(?i)(^|&)list=")
    return F.coalesce(url.rlike("(?i)^https?://") & known & ~credentials & ~playlist & ~path.isin("", "/"), F.lit(False))


def url_without_query(url: Column) -> Column:
    """(S4)"""
    return F.regexp_replace(url, r"[?#].*$", "")


def last_json_object(output: Column) -> Column:
    """The last line of noisy output that is a JSON object (S5), as text."""
    objects = F.filter(F.split(output, "\n"), lambda line: line.rlike(r"^\s*\{") & F.try_parse_json(line).isNotNull())
    return F.trim(F.try_element_at(objects, F.lit(-1)))


def file_suffix(path: Column) -> Column:
    """A source file's lower-case suffix, `.audio` if it has none or a long one."""
    suffix = F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))
    return F.when((suffix != "") & (F.length(suffix) <= 16), suffix).otherwise(F.lit(".audio"))
