"""Text, token, path and file-name columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of CJK ideographs and of Latin letters and digits.
CJK = r"[\x{4e00}-\x{9fff}]+"
LATIN = r"[A-Za-z0-9]+"
#: White space at either end, with the separators that Java's \s does not hold.
_SPACE = r"[\s\x{1c}-\x{1f}]"
#: Suffixes that can be mentioned in a question; longer ones first, since the first alternative wins.
EXTENSIONS = ("txt", "pdf", "docx", "doc", "xlsx", "xls", "csv", "png", "jpg", "jpeg", "bmp", "tiff", "tif", "webp")
MENTION = r"(?iU)([\w\x{4e00}-\x{9fff}\-\.]+\.(?:" + "|".join(EXTENSIONS) + r"))"
MONTH = r"(?U)(\d{1,2})月(?:份)?"
FILTER_SPLIT = r"[,\n;，；|]+"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: the plan would copy it wherever it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def normalize(text: Column) -> Column:
    """LF line ends, stripped."""
    return strip(F.regexp_replace(text, r"\r\n?", "\n"))


def garbled_score(text: Column) -> Column:
    """Replacement characters count twice, Latin-1 letters once."""
    return 2 * F.regexp_count(text, F.lit(r"\x{FFFD}")) + F.regexp_count(text, F.lit(r"[\x{C0}-\x{FF}]"))


def cjk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]"))


def looks_garbled(text: Column) -> Column:
    score, cjk = garbled_score(text), cjk_count(text)
    return (F.length(text) > 0) & (score >= 20) & ((cjk == 0) | (score > 2 * cjk))


def _ngrams(run: Column, least: int, most: int) -> Column:
    """All n-grams of a run, by size, then by position."""
    sizes = F.when(F.length(run) >= least, F.sequence(F.lit(least), F.least(F.lit(most), F.length(run)))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, n))))


def _cjk_grams(text: Column, least: int, most: int) -> Column:
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(CJK), F.lit(0)), lambda run: _ngrams(run, least, most)))


def _latin_words(text: Column) -> Column:
    return F.transform(F.filter(F.regexp_extract_all(text, F.lit(LATIN), F.lit(0)), lambda w: F.length(w) > 1), F.lower)


def bm25_tokens(text: Column, most: int | None = None, least_gram: int = 2, most_gram: int = 3) -> Column:
    """CJK n-grams, then Latin words in lower case, repeats kept, cut to `most` tokens."""
    text = F.coalesce(text, F.lit(""))
    words = _latin_words(text)
    every = F.when(text.rlike(CJK), F.concat(_cjk_grams(text, least_gram, most_gram), words)).otherwise(words)
    return F.slice(every, 1, most) if most else every


def cjk_ngrams(text: Column, least: int = 2, most: int = 5) -> Column:
    return F.array_distinct(_cjk_grams(text, least, most))


def latin_keywords(text: Column) -> Column:
    return F.array_distinct(_latin_words(text))


def query_terms(text: Column) -> tuple[Column, Column]:
    """At most 64 CJK and 32 Latin keywords."""
    return F.slice(cjk_ngrams(text), 1, 64), F.slice(latin_keywords(text), 1, 32)


def keyword_score(text: Column, cjk: Column, latin: Column) -> Column:
    """The lengths of the keywords that are contained in the text."""
    lowered = F.lower(text)
    add = lambda total, word: total + F.length(word)
    there = F.aggregate(F.filter(cjk, lambda k: F.contains(text, k)), F.lit(0), add)
    return there + F.aggregate(F.filter(latin, lambda k: F.contains(lowered, k)), F.lit(0), add)


def question_tokens(question: Column) -> Column:
    """Distinct words and CJK runs of at least two characters, CJK bi- and trigrams, and months with and without suffix."""
    runs = F.filter(F.transform(F.regexp_extract_all(question, F.lit(rf"{LATIN}|{CJK}"), F.lit(0)), F.lower), lambda w: F.length(w) >= 2)
    months = F.regexp_extract_all(question, F.lit(MONTH), F.lit(1))
    spelled = F.flatten(F.transform(months, lambda m: F.array(F.concat(m, F.lit("月")), F.concat(m, F.lit("月份")))))
    return F.array_distinct(F.concat(runs, _cjk_grams(question, 2, 3), spelled))


def mentions(question: Column) -> Column:
    """File names that a question mentions, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit(MENTION), F.lit(1)), F.lower))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"[/\\]+$", ""), r"[/\\]"), -1)


def stem(name: Column) -> Column:
    """A file name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """The last suffix with its dot, in lower case, or an empty text."""
    return F.lower(F.regexp_extract(basename(path), r"(?<=.)(\.[^.]+)$", 1))


def score_file_name(question: Column, name: Column, tokens: Column) -> Column:
    """30 for the full name in the question, 20 for its stem; 3 for each token in the stem, else 1 if it is in the name."""
    q, n = F.lower(question), F.lower(name)
    base = stem(n)
    whole = F.when(F.contains(q, n), 30).otherwise(0) + F.when((base != "") & F.contains(q, base), 20).otherwise(0)
    each = F.aggregate(tokens, F.lit(0), lambda total, t: total + F.when(F.contains(base, t), 3).when(F.contains(n, t), 1).otherwise(0))
    return F.when((F.coalesce(question, F.lit("")) == "") | (F.coalesce(name, F.lit("")) == ""), 0).otherwise(whole + each)


def parse_file_filters(raw: Column) -> Column:
    """The parts of a filter line; of spellings that differ in case the first stays."""
    parts = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), FILTER_SPLIT), strip), lambda p: p != "")
    return F.filter(parts, lambda p, i: F.array_position(F.transform(parts, F.lower), F.lower(p)) == i + 1)


def matches_filter(source: Column, filters: Column) -> Column:
    """Whether a filter is the source's file name or, if it has a separator, its whole path."""
    name, path = F.lower(basename(source)), F.lower(source)
    hit = F.exists(filters, lambda f: (f != "") & ((F.lower(f) == name) | (f.rlike(r"[/\\]") & (F.lower(f) == path))))
    return F.coalesce((source != "") & hit, F.lit(False))


def format_source(source: Column, page: Column) -> Column:
    """File name, with #p and the page if there is one."""
    name = F.when(F.coalesce(source, F.lit("")) == "", F.lit("unknown")).otherwise(basename(source))
    return F.concat(name, F.coalesce(F.concat(F.lit("#p"), page.cast("string")), F.lit("")))


def signature(doc_id: Column, source: Column, page: Column, chunk_id: Column, field: Column, text: Column) -> Column:
    """The merge key of a hit: its identifying columns, where a zero number counts as missing, else a digest of its text."""
    number = lambda c: F.coalesce(F.nullif(c, F.lit(0)).cast("string"), F.lit(""))
    word = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    parts = [word(doc_id), word(source), number(page), number(chunk_id), word(field)]
    return F.when(F.concat(*parts) != "", F.concat_ws("|", *parts)).otherwise(F.concat(F.lit("content:"), F.sha2(F.coalesce(text, F.lit("")), 256)))


def sanitize_kb_id(value: Column) -> Column:
    """Lower case; whatever is no letter or digit becomes _; none at the ends; `kb` if nothing is left."""
    clean = F.regexp_replace(F.lower(strip(value)), r"[^\p{L}\p{N}]", "_")
    return F.coalesce(F.nullif(F.regexp_replace(clean, r"^_+|_+$", ""), F.lit("")), F.lit("kb"))


def chunk_key(kb_id: Column, root: Column, doc_id: Column, chunk_id: Column) -> Column:
    return F.sha2(F.concat_ws("|", kb_id, root, doc_id, chunk_id.cast("string")), 256)
