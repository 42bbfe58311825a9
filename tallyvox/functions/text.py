"""Text cleaning, masking and matching as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Masking patterns and replacement marks.
EMAIL_PATTERN = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE_PATTERN_CN = r"(?<!\d)(?:\+?86[-\s]?)?1[3-9]\d{9}(?!\d)"
EMAIL_MARK = "[EMAIL]"
PHONE_MARK = "[PHONE]"

# Characters a Java `trim` drops and the ones it counts as white space.
TRIM_CHARACTERS = "".join(chr(code) for code in range(0x21))
WHITESPACE_CLASS = r"\t-\r\x1C-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}"

# The same with ASCII marks and U+3001 to U+303F. Single characters below 256 are one table in Java's classes, and
# ranges are tried one by one, so ASCII is listed and the rest is tried only behind U+1680.
_ASCII = "".join(f"\\x{{{code:X}}}" for code in [*range(9, 14), *range(0x1C, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])
SEPARATORS = rf"[{_ASCII}[\x{{1680}}-\x{{303F}}&&[{WHITESPACE_CLASS}\x{{3001}}-\x{{303F}}]]]+"

# Traditional to simplified characters, in table order.
TRADITIONAL = "錄帳號戶連異蹤沒現報錯斷線違規題餘額複資訊議網絡遲"
SIMPLIFIED = "录账号户连异踪没现报错断线违规题余额复资讯议网络迟"

# Marks removed before answers and assertions are compared.
ANSWER_MARKS = r"[\s，。；、：！？,.!?;:]"

MAX_SOURCE_KIND = 64
ASSERTION_SHORT = 12
ASSERTION_RATIO = 0.6


def java_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(TRIM_CHARACTERS))


def is_blank(c: Column) -> Column:
    return c.isNull() | (java_trim(c) == "")


def pii_mask(c: Column, phone: str = PHONE_PATTERN_CN) -> Column:
    """E-mail addresses first, then phone numbers.

    Cheap necessary conditions keep the two costly patterns off texts that cannot match.
    """
    masked = F.when(c.contains("@"), F.regexp_replace(c, EMAIL_PATTERN, EMAIL_MARK)).otherwise(c)
    replaced = F.regexp_replace(masked, phone, PHONE_MARK)
    if phone != PHONE_PATTERN_CN:
        return replaced
    return F.when(c.rlike(r"1[3-9]\d{9}"), replaced).otherwise(masked)


def import_normalize(c: Column) -> Column:
    return F.lower(F.regexp_replace(java_trim(c), r"\s+", " "))


def source_kind(c: Column) -> Column:
    return F.substring(import_normalize(pii_mask(c)), 1, MAX_SOURCE_KIND)


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


# Fixed value: ISO-8601 with a mandatory offset.
OFFSET_DATETIME = (
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2}(:\d{2})?)$"
)


def parse_occurred_at(c: Column) -> Column:
    """ISO with offset, else a plain date-time read as UTC, else null."""
    value = java_trim(c)
    with_offset = F.when(value.rlike(OFFSET_DATETIME), F.try_to_timestamp(value))
    plain = F.when(
        value.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"),
        F.try_to_timestamp(value, F.lit("yyyy-MM-dd HH:mm:ss")),
    )
    return F.coalesce(with_offset, plain)


def _full_width() -> tuple[str, str]:
    wide = "".join(chr(code) for code in range(0xFF01, 0xFF5F)) + chr(0x3000)
    narrow = "".join(chr(code - 0xFEE0) for code in range(0xFF01, 0xFF5F)) + " "
    return wide, narrow


def analysis_normalize(c: Column, synonyms: list[tuple[list[str], str]] = ()) -> Column:
    """Width, script, separators, case, then the ordered synonym replacements."""
    wide, narrow = _full_width()
    text = F.coalesce(c, F.lit(""))
    # Both mappings are disjoint, so one pass does, and only over texts that hold such characters: all lie
    # behind U+3000, which one range tells for most texts.
    text = F.when(
        text.rlike(r"[\x{3000}-\x{FFFF}]"),
        F.when(
            text.rlike(f"[{wide[0]}-{wide[-2]}{wide[-1]}{TRADITIONAL}]"),
            F.translate(text, wide + TRADITIONAL, narrow + SIMPLIFIED),
        ).otherwise(text),
    ).otherwise(text)
    text = F.lower(java_trim(F.regexp_replace(text, SEPARATORS, " ")))
    for variants, target in synonyms:
        for variant in variants:
            if variant:
                text = F.replace(text, F.lit(variant), F.lit(target))
    return text


def cjk_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[一-鿿]"))


def token_estimate(c: Column) -> Column:
    """CJK characters weigh 1/1.5 token, all other UTF-16 units 1/4."""
    value = F.coalesce(c, F.lit(""))
    cjk = cjk_count(value)
    units = F.length(value) + F.regexp_count(value, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    estimate = F.floor(cjk / F.lit(1.5) + (units - cjk) / F.lit(4.0)).cast("int") + 1
    return F.when(value == "", F.lit(1)).otherwise(estimate)


def bind(c: Column, f: Callable[[Column], Column]) -> Column:
    """`f(c)` with `c` evaluated once, however often `f` mentions it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def contains_any(c: Column, words: list[str]) -> Column:
    hits = [c.contains(word) for word in words if word]
    return reduce(lambda a, b: a | b, hits) if hits else F.lit(False)


def contains_all(c: Column, words: list[str]) -> Column:
    """An empty word never counts as contained, so it makes the whole list fail."""
    if not words:
        return F.lit(True)
    if any(not word for word in words):
        return F.lit(False)
    return reduce(lambda a, b: a & b, [c.contains(word) for word in words])


def hit_count(c: Column, words: list[str]) -> Column:
    """Counts list entries, so a repeated entry counts twice."""
    hits = [c.contains(word).cast("int") for word in words if word]
    return reduce(lambda a, b: a + b, hits) if hits else F.lit(0)


def longest_hit(c: Column, words: list[str]) -> Column:
    by_length: dict[int, list[str]] = {}
    for word in words:
        if word:
            by_length.setdefault(len(word), []).append(word)
    result = F.lit(0)
    for size in sorted(by_length):
        result = F.when(contains_any(c, by_length[size]), F.lit(size)).otherwise(result)
    return result


def pattern_hits(c: Column, patterns: list[str]) -> Column:
    return F.struct(hit_count(c, patterns).alias("hits"), longest_hit(c, patterns).alias("longest"))


def answer_normalize(c: Column, drop_joiners: bool = True) -> Column:
    text = F.lower(F.coalesce(c, F.lit("")))
    if drop_joiners:
        text = F.translate(text, "-_", "")
    return F.regexp_replace(text, ANSWER_MARKS, "")


def match_tokens(normalized: Column) -> Column:
    """ASCII words of two or more characters plus CJK bigrams."""
    words = F.regexp_extract_all(normalized, F.lit(r"[a-z0-9]{2,}"), F.lit(0))
    # Texts without such characters skip the second half.
    letters = F.regexp_extract_all(normalized, F.lit(r"[一-鿿]"), F.lit(0))
    bigrams = F.zip_with(
        F.slice(letters, 1, F.greatest(F.size(letters) - 1, F.lit(0))),
        F.slice(letters, 2, F.size(letters)),
        lambda a, b: F.concat(a, b),
    )
    both = F.concat(words, F.when(F.size(letters) == 1, letters).otherwise(bigrams))
    return F.array_distinct(F.when(normalized.rlike(r"[一-鿿]"), both).otherwise(words))


def assertion_match(answer: Column, assertion: Column) -> Column:
    """Both sides already passed through `answer_normalize`."""
    def by_tokens(wanted: Column) -> Column:
        shared = F.size(F.array_intersect(wanted, match_tokens(answer)))
        return (F.size(wanted) > 0) & (shared / F.size(wanted) >= ASSERTION_RATIO)

    def by_letters(chars: Column) -> Column:
        covered = F.size(F.filter(chars, lambda ch: answer.contains(ch)))
        return (F.size(chars) > 0) & (covered / F.size(chars) >= ASSERTION_RATIO)

    letters = F.array_distinct(F.regexp_extract_all(assertion, F.lit(r"[一-鿿]"), F.lit(0)))
    fuzzy = bind(match_tokens(assertion), by_tokens) | bind(letters, by_letters)
    return (
        F.when((assertion == "") | (answer == ""), F.lit(False))
        .when(answer.contains(assertion), F.lit(True))
        .when(F.length(assertion) < ASSERTION_SHORT, F.lit(False))
        .otherwise(fuzzy)
    )


def cap_text(c: Column, size: int) -> Column:
    """Cut with an ellipsis."""
    return F.when(F.length(c) <= size, c).otherwise(F.concat(F.substring(c, 1, size), F.lit("…")))


def word_text(c: Column) -> Column:
    """Words of lower-cased letters and digits, one blank between them."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " ")


def trigrams(c: Column) -> Column:
    """Distinct three-letter pieces of each word padded with two spaces left and one right."""
    words = F.filter(F.split(word_text(c), " "), lambda w: w != "")
    pieces = F.flatten(
        F.transform(
            F.array_distinct(words),
            lambda w: F.transform(
                F.sequence(F.lit(1), F.length(w) + 1),
                lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)),
            ),
        )
    )
    return F.array_distinct(pieces)


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared pieces over all pieces; zero when both sides are empty."""
    left, right = trigrams(a), trigrams(b)
    shared = F.size(F.array_intersect(left, right))
    total = F.size(left) + F.size(right) - shared
    return F.when(total == 0, F.lit(0.0)).otherwise(shared / total)


def cosine_distance(a: Column, b: Column) -> Column:
    """For pairs already joined; searches over a whole table use `operators.search`."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    return F.lit(1.0) - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
