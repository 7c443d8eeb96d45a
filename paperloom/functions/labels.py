"""Scalar labels and normalisations as Column expressions; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.sources.tables import TERMINAL


def mask_secret(c: Column) -> Column:
    """'' stays '', up to 4 characters become ****, longer ones keep their last four; null counts as ''."""
    c = F.coalesce(c, F.lit(""))
    return F.when(F.length(c) == 0, F.lit("")).when(F.length(c) <= 4, F.lit("****")).otherwise(F.concat(F.lit("****"), F.right(c, F.lit(4))))


def status_key(status: Column, cancel_requested: Column, output_deleted: Column) -> Column:
    """Shown status: expired, cancelling or the stored one; a null flag counts as false."""
    return (
        F.when((status == "completed") & F.coalesce(output_deleted, F.lit(False)), F.lit("expired"))
        .when(F.coalesce(cancel_requested, F.lit(False)) & ~status.isin(*TERMINAL), F.lit("cancelling"))
        .otherwise(F.lower(F.coalesce(status, F.lit(""))))
    )


def byte_label(c: Column) -> Column:
    """1024-based size with one decimal below 100 units; null and 0 are 0 B."""
    b = F.coalesce(c, F.lit(0)).cast("double")
    # The unit is found by comparison, which has no rounding at powers of 1024.
    index = sum(F.when(b >= 1024.0**k, 1).otherwise(0) for k in range(1, 5))
    amount = b / F.pow(F.lit(1024.0), index)
    unit = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), index + 1)
    whole = (amount >= 100) | (index == 0)
    text = F.when(whole, F.floor(amount + 0.5).cast("string")).otherwise(F.format_string("%d.%d", F.floor(F.floor(amount * 10 + 0.5) / 10), F.floor(amount * 10 + 0.5) % 10))
    return F.concat(text, F.lit(" "), unit)


def duration_label(ms: Column) -> Column:
    """Milliseconds as 1h 2m 3s, 2m 3s or 3s; null and negative count as 0."""
    s = F.floor(F.greatest(F.coalesce(ms, F.lit(0)), F.lit(0)) / 1000)
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))


def client_address(forwarded: Column, real: Column, peer: Column) -> Column:
    """First forwarded address (trimmed, 64 characters), else the real one, else the peer's.

    A forwarded header that is present but blank in its first part gives null: there is no fall-through.
    """
    first = F.substring(F.trim(F.split_part(forwarded, F.lit(","), F.lit(1))), 1, 64)
    return F.when(F.coalesce(F.length(forwarded), F.lit(0)) > 0, F.nullif(first, F.lit(""))).when(F.coalesce(F.length(real), F.lit(0)) > 0, F.substring(real, 1, 64)).otherwise(peer)


def language_code(c: Column, aliases: dict[str, str]) -> Column:
    """Lower-cased, trimmed code, mapped through aliases; null counts as ''."""
    key = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    table = F.create_map(*(F.lit(x) for pair in sorted(aliases.items()) for x in pair))
    return F.coalesce(F.element_at(table, key), key)


def font_tokens(c: Column) -> Column:
    """Tokens of a font name: subset prefix off, camel case split, lower-cased, style-free suffixes dropped."""
    bare = F.regexp_replace(c, "^[A-Z]{6}\\+", "")
    spaced = F.lower(F.regexp_replace(bare, "(?<=[a-z0-9])(?=[A-Z])", " "))
    return F.filter(F.split(spaced, "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin("ttf", "ttc", "otf", "psmt"))


def script_of(c: Column) -> Column:
    """Font family by script: Korean before Japanese before CJK before Cyrillic, else latin."""
    return (
        F.when(c.rlike("[\\uac00-\\ud7af\\u1100-\\u11ff\\u3130-\\u318f]"), "korea")
        .when(c.rlike("[\\u3040-\\u30ff]"), "japan")
        .when(c.rlike("[\\u4e00-\\u9fff\\u3400-\\u4dbf]"), "china")
        .when(c.rlike("[\\u0400-\\u04ff]"), "cyrillic")
        .otherwise("latin")
    )


def numbered_marker_count(c: Column) -> Column:
    """How many list markers like ``1.`` or ``(2)`` a text holds at its start or after a blank."""
    return F.regexp_count(c, F.lit("(?:^|\\s)(?:\\d{1,2}[.)]|\\(\\d{1,2}\\))\\s"))


def json_number(c: Column, *paths: str) -> Column:
    """First of several JSON paths that holds a number, as bigint."""
    return F.coalesce(*(F.get_json_object(c, p).cast("bigint") for p in paths))


# Parts of font names, by what they say (fixed values).
BOLD_NAMES = "bold black heavy semibold demibold demi".split()
ITALIC_NAMES = "italic oblique".split()
MONO_NAMES = "mono courier consolas menlo monaco code".split()
SANS_NAMES = "arial helvetica univers gotham avenir frutiger calibri verdana tahoma trebuchet sourcehansans notosans sans".split()
SERIF_NAMES = "times georgia garamond baskerville cambria constantia palatino bodoni minion sourcehanserif notoserif serif".split()


def font_traits(name: Column) -> Column:
    """Struct of bold, italic, monospace and serif (0 or 1) that a font's name tells; null where it tells none.

    A name that says sans as well as serif is sans; serif is null where neither is said.
    """
    bare = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")
    says = lambda words: bare.rlike("|".join(words)).cast("int")
    serif = F.when(says(SANS_NAMES) == 1, 0).when(says(SERIF_NAMES) == 1, 1)
    bold, italic, mono = says(BOLD_NAMES), says(ITALIC_NAMES), says(MONO_NAMES)
    told = serif.isNotNull() | (bold + italic + mono > 0)
    return F.when(told, F.struct(bold.alias("bold"), italic.alias("italic"), mono.alias("monospace"), serif.alias("serif")))


#: A text of nothing but punctuation; a number cut behind its point, and what goes on after it (fixed patterns).
PUNCTUATION_ONLY = r"^[.,:;/%+\-\x{2013}\x{b1}()]+$"
CUT_NUMBER, NUMBER_GOES_ON = r"[0-9]\.$", r"^[0-9]+[A-Za-z%\x{b0}\x{3a9}\x{2126}\x{b5}\x{3bc}]"


def pair_reason(left: Column, right: Column, same_line: Column, wrapped: Column) -> Column:
    """Why a right text goes to a left one: punctuation on its line, a decimal that wraps, or a possible fragment; else null.

    Texts without characters have no reason.
    """
    return (
        F.when((F.trim(left) == "") | (F.trim(right) == ""), None)
        .when(same_line & F.trim(right).rlike(PUNCTUATION_ONLY), "inline_punctuation")
        .when(wrapped & F.trim(left).rlike(CUT_NUMBER) & F.trim(right).rlike(NUMBER_GOES_ON), "wrapped_decimal")
        .when(same_line, "potential_pair")
    )


def joined_text(left: Column, right: Column, reason: Column, gap: Column) -> Column:
    """Both texts with a blank between them where the gap is over 1.5; punctuation and decimals join without one."""
    return F.when((reason == "potential_pair") & (gap > 1.5), F.concat(left, F.lit(" "), right)).otherwise(F.concat(left, right))


# Texts of two fragments, as expressions (fixed patterns, in a form that Java and RE2 read alike).
PAGE_NUMBER = r"^([Pp][Aa][Gg][Ee]\s*)?[0-9]{1,4}(\s*/\s*[0-9]{1,4})?$"
SCRIPT_LETTER = r"[A-Za-z\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"
SMALL_MARK = r"^[.,:;/%+\-\x{2013}\x{b1}()]{1,2}$"


def is_prose(c: Column) -> Column:
    """Three letters or more, with an a to z in lower case or white space among the text."""
    return (F.length(F.regexp_replace(c, r"\PL", "")) >= 3) & c.rlike(r"[a-z\s]")


def may_share_text(left: Column, right: Column) -> Column:
    """Whether two texts may be parts of one line: long enough, with letters, no page number, cut inside a word or prose."""
    both = F.concat(left, right)
    letters = (F.length(both) >= 8) & both.rlike(r"\pL") & (left.rlike(SCRIPT_LETTER) | right.rlike(SCRIPT_LETTER))
    cut = left.rlike(r"\pL$") & right.rlike(r"^\pL") & (left.rlike(r"\p{Ll}$") | right.rlike(r"^\p{Ll}"))
    return letters & ~left.rlike(PAGE_NUMBER) & ~right.rlike(PAGE_NUMBER) & (cut | is_prose(left) | is_prose(right))
