"""Scalar text functions as column expressions: all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import chars as C
from . import languages as L

ABBREVIATIONS = ("e.g", "i.e", "etc", "vs", "cf", "Dr", "Mr", "Mrs", "Ms", "St", "No", "Fig", "approx")
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "­": ""}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_of(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern))


def strip(c: Column | str) -> Column:
    """Text without white space at its ends; only texts whose first or last character is some are searched."""
    c = col(c)
    outer = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1)).rlike(f"[{C.WS}]")
    return F.when(outer, F.regexp_replace(c, rf"^[{C.WS}]+|[{C.WS}]+$", "")).otherwise(c)


def holds_any(c: Column, signs: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(s)) for s in signs))


def clean(c: Column | str) -> Column:
    """Runs of blanks (not line feeds) become one space; ends are stripped."""
    c = col(c)
    odd = holds_any(c, ("  ", "\t", "\r", "\f", "\x0b", "\xa0"))
    return let(F.when(odd, F.regexp_replace(c, r"[ \t\r\f\x0B\xA0]+", " ")).otherwise(c), strip)


def escape_marks(c: Column | str) -> Column:
    c = col(c)
    return F.when(holds_any(c, ("*", "`", "[", "]")), F.regexp_replace(c, r"([*`\[\]])", r"\\$1")).otherwise(c)


def without_ligatures(c: Column | str) -> Column:
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), LIGATURES.items(), col(c))


# What Markdown's inline marks become, in this order; {word} is the inside of a class of word characters.
MARKDOWN_MARKS = (
    (r"!\[([^\]]*)\]\([^)]*\)", "{1}"),
    (r"__(.+?)__", "**{1}**"),
    (r"(?<![{word}*])_(?!_)(.+?)(?<!_)_(?![{word}*])", "*{1}*"),
    (r"<(https?://[^>]+)>", "[{1}]({1})"),
)


def markdown_inline(c: Column | str) -> Column:
    """Images to their text, underscores to stars, bare addresses to links."""
    marks = ((pattern.replace("{word}", C.WORD), by.replace("{1}", "$1")) for pattern, by in MARKDOWN_MARKS)
    return clean(reduce(lambda x, mark: F.regexp_replace(x, *mark), marks, col(c)))


def without_code(c: Column | str, by: str = " ") -> Column:
    return F.regexp_replace(col(c), C.CODE_SPAN, by)


def without_urls(c: Column | str, by: str = " ") -> Column:
    return F.regexp_replace(col(c), C.URL, by)


def without_targets(c: Column | str) -> Column:
    return F.regexp_replace(col(c), C.LINK_TARGET, "]")


def if_marked(c: Column | str, bare: Callable[[Column], Column]) -> Column:
    """bare(c), which takes code, addresses and link targets out of c; texts without a sign of any stay as they are, unread."""
    c = col(c)
    return F.when(holds_any(c, ("`", "@", "://", "mailto:", "](")), bare(c)).otherwise(c)


def needs_translation(c: Column | str) -> Column:
    """Whether a letter is left without code, addresses and link targets."""
    return if_marked(c, lambda x: without_targets(without_urls(without_code(x)))).rlike(f"[{C.LETTER}]")


def unspaced_count(c: Column | str) -> Column:
    """Characters of scripts without spaces; runs of ASCII are left out first, and texts of nothing else are not searched."""
    c = col(c)
    return F.when(F.octet_length(c) == F.length(c), 0).otherwise(count_of(F.regexp_replace(c, r"[\x00-\x7F]++", ""), f"[{L.class_body(*L.UNSPACED)}]"))


def estimate_tokens(c: Column | str) -> Column:
    """Four characters a token, 1.2 in scripts without spaces, and one; 0 for empty texts."""
    c = col(c)
    size = let(unspaced_count(c), lambda unspaced: F.floor((F.length(c) - unspaced) / F.lit(4.0) + unspaced / F.lit(1.2)) + 1)
    return F.when(F.length(c) > 0, size).otherwise(0).cast("int")


def word_count(c: Column | str) -> Column:
    """Words, and a word for two characters of scripts without spaces."""
    c = col(c)
    spaced = lambda n: F.when(n > 0, F.regexp_replace(c, f"[{L.class_body(*L.UNSPACED)}]", " ")).otherwise(c)
    return let(unspaced_count(c), lambda n: count_of(spaced(n), f"[{C.WORD}]+") + F.floor(n / 2)).cast("int")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), then), 1)


def script_sizes(c: Column | str) -> list[Column]:
    """How many characters of each script a text has, in order. All scripts but the Latin one are counted without ASCII runs."""
    foreign = F.regexp_replace(col(c), r"[\x00-\x7F]++", "")
    return [count_of(col(c) if s in L.WITH_ASCII else foreign, f"[{L.class_body(s)}]") for s in L.SCRIPTS]


def script_counts(c: Column | str) -> Column:
    """Map of scripts that occur to how many of their characters do."""
    pairs = [x for s, n in zip(L.SCRIPTS, script_sizes(c), strict=True) for x in (F.lit(s), n)]
    return F.map_filter(F.create_map(*pairs), lambda _, n: n > 0)


def detect_language(c: Column | str) -> Column:
    """Language by the main script and, within the Latin script, by frequent words; `en` if nothing tells.

    The main script is the one with the most characters (of equals, the first in order).
    """
    names = list(L.SCRIPTS)
    listed = {code: words.split() for code, words in L.STOP_WORDS.items()}
    frequent = sorted({w for words in listed.values() for w in words})
    words = F.filter(F.regexp_extract_all(F.lower(col(c)), F.lit(f"([{C.LETTER}]+)"), F.lit(1)), lambda w: w.isin(*frequent))

    def tongue(found: Column) -> Column:
        among = lambda some: F.size(F.filter(found, lambda w: w.isin(*some)))
        hits = [F.struct(among(some).alias("n"), F.lit(-i).alias("order"), F.lit(code).alias("code")) for i, (code, some) in enumerate(listed.items())]
        return F.array_max(F.array(*hits))["code"]

    def by_script(main: Column, sizes: Column) -> Column:
        japanese = (main == "kana") | (sizes["han"] > 0) & (sizes["kana"] > 0)
        others = reduce(lambda x, kv: x.when(main == kv[0], kv[1]), L.SCRIPT_LANGUAGE.items(), F.when(main.isNull(), "en").when(japanese, "ja"))
        return others.when(main == "latin", let(words, tongue)).otherwise("en")

    def by_sizes(sizes: Column) -> Column:
        ranked = F.array(*(F.struct(sizes[s].alias("n"), F.lit(-i).alias("order"), F.lit(s).alias("script")) for i, s in enumerate(names)))
        return let(let(F.array_max(ranked), lambda best: F.when(best["n"] > 0, best["script"])), lambda main: by_script(main, sizes))

    return let(F.struct(*(n.alias(s) for s, n in zip(names, script_sizes(c), strict=True))), by_sizes)


def ascii_digits(c: Column | str) -> Column:
    return F.translate(col(c), L.FROM_DIGITS, L.TO_DIGITS)


def numbers(c: Column | str) -> Column:
    """All numbers outside code and addresses, in ASCII digits, repeats included."""
    bare = ascii_digits(if_marked(c, lambda x: without_code(without_urls(without_targets(x)))))
    return F.regexp_extract_all(bare, F.lit(f"({C.NUMBER})"), F.lit(1))


def sentences(c: Column | str) -> Column:
    """Sentence ends, without those of abbreviations and decimals."""
    x = without_code(without_urls(c, "x"), "x")
    short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    x = F.regexp_replace(x, rf"(?<![{C.WORD}])({short})\.", "$1")
    x = F.regexp_replace(x, rf"[{C.DIGIT}]\.[{C.DIGIT}]", "0")
    return count_of(x, rf"[.!?؟۔।](?=[{C.WS}\"'”»)]|\z)|[。！？]")


def verbatim_tokens(c: Column | str, keep: list[str] | None = None) -> Column:
    """What a translation must hold unchanged: code spans, link targets, addresses, and terms to keep."""
    c = col(c)
    code = F.filter(F.regexp_extract_all(c, F.lit(r"(`[^`\n]+`)"), F.lit(1)), lambda x: x.rlike(f"[{C.WORD}]"))
    plain = without_code(c)
    targets = F.regexp_extract_all(plain, F.lit(C.LINK_TARGET), F.lit(1))
    urls = F.regexp_extract_all(without_targets(plain), F.lit(f"({C.URL})"), F.lit(1))
    found = [F.when(plain.rlike(whole_word(k)), F.array(F.lit(k))).otherwise(F.array().cast("array<string>")) for k in keep or []]
    return F.concat(code, targets, urls, *found)


def quoted(literal: str) -> str:
    """A literal as a regular expression; what it holds is never read as one."""
    return "".join(rf"\x{{{ord(ch):X}}}" for ch in literal)


def whole_word(literal: str) -> str:
    return rf"(?<![{C.WORD}]){quoted(literal)}(?![{C.WORD}])"


def source_words(c: Column | str) -> Column:
    return count_of(without_code(c), f"[{C.LETTER}]{{2,}}")


def normal_title(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(c)), rf"[^{C.WORD}]+", "")


def slug(c: Column | str) -> Column:
    """A file stem: runs of other characters become -, at most 60 characters, `book` if nothing is left."""
    x = F.regexp_replace(F.regexp_replace(col(c), rf"[^{C.WORD}]+", "-"), "^-+|-+$", "")
    x = F.substring(x, 1, 60)
    return F.when(F.length(x) > 0, x).otherwise("book")


def html_escape(c: Column | str, quote: bool = True) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + [('"', "&quot;"), ("'", "&#x27;")] * quote
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, col(c))


def closed_tags(c: Column | str) -> Column:
    """Void elements in their XML form."""
    return F.regexp_replace(col(c), r"<(img|hr|br)([^>]*?)(?<!/)>", "<$1$2/>")


def direction_mark(c: Column | str, rtl: Column | bool) -> Column:
    """` dir="ltr"` for blocks of a right-to-left book that hold no right-to-left letter."""
    rtl = F.lit(rtl) if isinstance(rtl, bool) else rtl
    return F.when(rtl & ~col(c).rlike(f"[{L.class_body(*L.RIGHT_TO_LEFT)}]"), ' dir="ltr"').otherwise("")


def literal_count(c: Column | str, literal: str) -> Column:
    """Occurrences of a literal that do not overlap."""
    return count_of(c, quoted(literal))


def joined_lines(lines: Column) -> Column:
    """Lines of a paragraph as one: a word broken by a soft hyphen is put together, others get a space between."""
    def add(text: Column, line: Column) -> Column:
        broken = text.rlike(r"[a-z\x{DF}-\x{24F}]{2,}-\z") & line.rlike(r"^\p{Ll}")
        return F.when(text == "", line).when(broken, F.concat(F.regexp_replace(text, r"-\z", ""), line)).otherwise(F.concat(text, F.lit(" "), line))

    return F.aggregate(lines, F.lit(""), lambda text, line: add(text, strip(line)))


def page_numbers(spec: str | None) -> list[int]:
    """The pages that a list such as `1-3,10` names."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in (spec or "").split(","))):
        first, _, last = part.partition("-")
        out += range(int(first), int(last or first) + 1)
    return out


def sampled_pages(total: int, count: int) -> list[int]:
    """Pages, from 1, spread evenly over all of a book, the first and the last among them."""
    count = min(count, total)
    return sorted({1 + round(k * (total - 1) / max(count - 1, 1)) for k in range(count)})
