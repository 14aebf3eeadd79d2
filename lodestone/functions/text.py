"""Text scalars as Spark columns; none is a UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ARTICLES = ("a", "an", "the")
GERMAN = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
#: Words by which `guess_language` votes.
STOPWORDS = {
    "de": ("der", "die", "und", "das", "ist", "von", "mit", "den", "ein", "zu"),
    "en": ("the", "of", "and", "to", "is", "that", "with", "was", "for", "it"),
    "es": ("el", "los", "las", "y", "por", "con", "del", "una", "un", "para"),
    "fr": ("le", "les", "et", "des", "du", "est", "dans", "pour", "que", "une"),
}
#: PostgreSQL's text-search configurations by ISO 639-1 code.
SEARCH_CONFIGS = {
    "ar": "arabic", "da": "danish", "de": "german", "el": "greek", "en": "english", "es": "spanish", "fi": "finnish", "fr": "french",
    "ga": "irish", "hu": "hungarian", "id": "indonesian", "it": "italian", "lt": "lithuanian", "nb": "norwegian", "ne": "nepali", "nl": "dutch",
    "no": "norwegian", "pt": "portuguese", "ro": "romanian", "ru": "russian", "sv": "swedish", "ta": "tamil", "tr": "turkish",
}


def search_config(lang: Column) -> Column:
    """The text-search configuration of a language, `simple` for those without one."""
    names = F.create_map(*(F.lit(x) for pair in SEARCH_CONFIGS.items() for x in pair))
    return F.coalesce(F.element_at(names, lang), F.lit("simple"))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1)), F.array().cast("array<string>"))


def normalised(text: Column) -> Column:
    """Letters and digits in lower case, single spaces for all else."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", " "))


def unique_terms(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def split_words(text: Column) -> Column:
    """Words between white space or punctuation; symbols belong to words."""
    return F.filter(F.split(text, r"[\s\p{P}]+"), lambda w: w != "")


def truncate_fields(text: Column, n: int) -> Column:
    """The first n words between white space, by single spaces."""
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, n), " ")


def middle_out(text: Column, n: int, gap: str = " [...] ") -> Column:
    """The first and last words, n in all, with `gap` for those between; texts up to n words as they are."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    head, tail = n - n // 2, n // 2
    cut = F.concat(F.array_join(F.slice(words, 1, head), " "), F.lit(gap), F.array_join(F.slice(words, F.size(words) - tail + 1, F.lit(tail)), " "))
    return F.when(F.size(words) <= n, text).otherwise(cut)


def fold_german(token: Column) -> Column:
    for a, b in GERMAN:
        token = F.replace(token, F.lit(a), F.lit(b))
    return token


def fold_ascii(token: Column) -> Column:
    return F.translate(token, ACCENTED, PLAIN)


def answer_normalised(text: Column) -> Column:
    """Lower case, punctuation and symbols as spaces, without articles, single spaces."""
    words = F.split(F.regexp_replace(F.lower(text), r"[\p{P}\p{S}]", " "), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*ARTICLES)), " ")


def seed(text: Column) -> Column:
    """The first four bytes of the MD5 of the trimmed lower-case text, as an integer."""
    return F.conv(F.substring(F.md5(F.lower(F.trim(text))), 1, 8), 16, 10).cast("bigint")


def canonical_time(ts: Column) -> Column:
    """RFC 3339 in UTC with nine digits of a second; the session's time zone must be UTC.  Spark keeps microseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'000Z'")


def without_fragment(source: Column) -> Column:
    return F.regexp_replace(source, "#.*$", "")


def slice_content(content: Column, offset: int, length: int) -> tuple[Column, Column, Column]:
    """(piece, total length, next offset or null) of `content` by characters; out-of-range offsets are clamped."""
    total = F.length(content)
    at = F.least(F.lit(max(0, offset)), total)
    end = F.least(at + max(0, length), total)
    return F.substring(content, at + 1, end - at), total, F.when(end < total, end)


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags go, five entities are resolved, white space is single."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def strip_data_urls(markdown: Column) -> Column:
    return F.regexp_replace(markdown, r"\]\(data:[^)]*\)", "](#stripped)")


def blob_hashes(text: Column, scheme: str = "blob://") -> Column:
    return F.regexp_extract_all(text, F.lit(f"{scheme}([0-9a-f]{{64}})"), F.lit(1))


def segments(text: Column, least: int = 60) -> Column:
    """Paragraphs between blank lines; one of fewer than `least` bytes is put before the next, and left out at the end unless it is all there is."""
    blocks = F.filter(F.transform(F.split(text, "\n\n"), lambda b: F.regexp_replace(b, r"\A\s+|\s+\z", "")), lambda b: b != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, block: Column) -> Column:
        joined = F.when(acc["open"] == "", block).otherwise(F.concat(acc["open"], F.lit("\n"), block))
        full = F.octet_length(joined) >= least
        return F.struct(F.when(full, F.array_append(acc["done"], joined)).otherwise(acc["done"]).alias("done"), F.when(full, F.lit("")).otherwise(joined).alias("open"))

    return F.aggregate(blocks, start, add, lambda acc: F.when((F.size(acc["done"]) == 0) & (acc["open"] != ""), F.array(acc["open"])).otherwise(acc["done"]))


def _first_most(counts: dict[str, Column]) -> Column:
    """The name with the highest count, the first in order of name; null if all are 0."""
    best = F.greatest(*(F.struct(n.alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, n) in enumerate(sorted(counts.items()))))
    return F.when(best["n"] > 0, best["name"])


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Stop words, and the languages that each belongs to.
_ALL_STOPWORDS = sorted({w for words in STOPWORDS.values() for w in words})


def _vote(words: Column) -> Column:
    """The language most of whose stop words are among `words`, the first in order of name; null without any."""
    among = lambda stop: lambda w: w.isin(*stop)
    counted = lambda few: F.struct(*(F.size(F.filter(few, among(stop))).alias(lang) for lang, stop in STOPWORDS.items()))
    return _once(F.filter(words, among(_ALL_STOPWORDS)), lambda few: _once(counted(few), lambda n: _first_most({lang: n[lang] for lang in STOPWORDS})))


def guess_language(text: Column) -> Column:
    """The language of most bytes of the text, its segments judged one by one by their stop words, the first in order of name; if no segment has any, that of the text as a whole, or null."""
    judged = F.transform(segments(text), lambda s: F.struct(_vote(tokens(s)).alias("lang"), F.octet_length(s).alias("bytes")))
    of = lambda lang: lambda s: s["lang"] == lang
    volume = lambda j: F.struct(*(F.aggregate(F.filter(j, of(lang)), F.lit(0), lambda n, s: n + s["bytes"]).alias(lang) for lang in STOPWORDS))
    won = lambda n: _first_most({lang: n[lang] for lang in STOPWORDS})
    return F.coalesce(_once(judged, lambda j: _once(volume(j), won)), _vote(tokens(text)))


def front_matter(markdown: Column) -> tuple[Column, Column]:
    """(scalars of the leading `---` block as map<string,string>, the rest); the key `source` isn't among them."""
    block = F.regexp_extract(markdown, r"(?s)\A---\n(.*?)\n---\n", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z0-9_-]+:\s*[^\s\[{|>]"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([^:]+):", 1), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]+:\s*(.*)$", 1)), r"""^["']|["']$""", "")))
    return F.map_filter(F.map_from_entries(pairs), lambda k, _: k != "source"), F.regexp_replace(markdown, r"(?s)\A---\n(.*?)\n---\n", "")
