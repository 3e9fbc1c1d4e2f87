"""Text functions over columns: normal forms, tokens, codes, references, escapes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import dictionaries as d

# White space as scripts count it: the ASCII kinds, NBSP, and the Unicode spaces.
SPACES = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
_PAUSES = "\u06d6-\u06ed"
# Vowel signs and pause marks one by one, as ``translate`` wants them.
_VOWEL_SIGNS = "".join(map(chr, (*range(0x64B, 0x660), *range(0x610, 0x61B))))
_PAUSE_SIGNS = "".join(map(chr, range(0x6D6, 0x6EE)))


def trim_spaces(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def marks_removed(text: Column) -> Column:
    """Without marks and fillers, plain alif; texts that have none are only looked through, which is much faster."""
    some = "\u0671" + _VOWEL_SIGNS + _PAUSE_SIGNS + "\u0640\u0670"
    return F.when(text.rlike("[\u0610-\u061a\u0640\u064b-\u065f\u0670\u0671\u06d6-\u06ed]"), F.translate(text, some, "\u0627")).otherwise(text)


def search_form(text: Column) -> Column:
    """Form in which texts are searched: no marks or fillers, plain alif, trimmed."""
    return trim_spaces(marks_removed(text))


def strip_vowels(text: Column) -> Column:
    """Without vowel signs and fillers; pause marks stay."""
    return F.translate(text, _VOWEL_SIGNS + "\u0640", "")


def matching_form(text: Column) -> Column:
    """Form in which words are matched: vowels stripped, kinds of alif and ya made one."""
    return F.translate(strip_vowels(text), "\u0670\u0671\u0649\u0622", "\u0627\u0627\u064a\u0627")


def bounded_distance(a: Column, b: Column, most: int = 1) -> Column:
    """Edit distance, or most + 1 where it is larger."""
    found = F.levenshtein(a, b, most)
    return F.when(found < 0, F.lit(most + 1)).otherwise(found)


def within_distance(a: Column, b: Column, most: int = 1) -> Column:
    return F.levenshtein(a, b, most) >= 0


def is_pause(token: Column) -> Column:
    """Whether a token is pause marks alone."""
    return token.rlike(f"^[{_PAUSES}]+$")


def _blanks(text: Column) -> Column:
    """All white space as blanks, so that one character parts words; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(_blanks(text), " "), lambda w: w != "")


def count_words(text: Column) -> Column:
    """Number of words, counted without cutting them out."""
    return F.regexp_count(_blanks(text), F.lit("[^ ]+"))


def classified_tokens(text: Column) -> Column:
    """Array of (type, text): pause, ayah (end-of-verse brackets) or word.

    Only a token that begins with a pause mark meets the pattern.
    """

    def kind(token: Column) -> Column:
        may_pause = (token >= F.lit("\u06d6")) & (token < F.lit("\u06ee"))
        bracket = F.contains(token, F.lit("\ufd3e")) | F.contains(token, F.lit("\ufd3f"))
        return F.when(may_pause & is_pause(token), "pause").when(bracket, "ayah").otherwise("word")

    return F.transform(words(text), lambda t: F.struct(kind(t).alias("type"), t.alias("text")))


_MARKS = "".join(m[0] for m in d.MARKS)


def tokens_and_marks(text: Column) -> Column:
    """Array of (kind, text): each word, and after it the marks that end it, one by one."""

    def parts(token: Column) -> Column:
        word = F.rtrim(token, F.lit(_MARKS))
        marks = F.filter(F.split(F.substring(token, F.length(word) + 1, F.length(token)), ""), lambda m: m != "")
        own = F.filter(F.array(word), lambda w: w != "")
        return F.concat(
            F.transform(own, lambda w: F.struct(F.lit("word").alias("kind"), w.alias("text"))),
            F.transform(marks, lambda m: F.struct(F.lit("mark").alias("kind"), m.alias("text"))),
        )

    return F.flatten(F.transform(words(text), parts))


def transliterate(text: Column) -> Column:
    """ASCII letters to Arabic script; others stay; null gives the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), "".join(d.TRANSLITERATION), "".join(d.TRANSLITERATION.values()))


def arabic_digits(number: Column) -> Column:
    return F.translate(number.cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")


def has_arabic(text: Column) -> Column:
    return text.rlike("[\u0600-\u06ff\u0750-\u077f]")


def only_arabic(text: Column) -> Column:
    return text.rlike("^[\u0600-\u06ff]+$")


def _dictionary(rows: list[tuple[str, str]]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(a), F.lit(b)) for a, b in rows))


def _by_code(more: dict[str, dict[str, str]] | None, order: tuple[str, ...], value: int) -> Column:
    """Map of codes to a field of their first row in the order of categories."""
    first: dict[str, str] = {}
    for category in order:
        for row in d.code_rows(more):
            if row[0] == category:
                first.setdefault(row[1], row[value])
    return _dictionary(list(first.items()))


_WIDENED = {c: c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x110000)) if len(c.upper()) > 1} | {"ß": "ẞ"}


def upper_by_character(text: Column) -> Column:
    """Upper case that keeps the number of characters: ß is ẞ, not SS, and a ligature stays, so that lower case finds the text again."""
    some = "".join(_WIDENED)
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)([{some}]+|[^{some}]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^[{some}]"), F.translate(p, some, "".join(_WIDENED.values()))).otherwise(F.upper(p))), "")


def titled(code: Column) -> Column:
    """Underscores to spaces, and every ASCII word's first letter in upper case, the rest unchanged."""
    pieces = F.regexp_extract_all(F.translate(code, "_", " "), F.lit("([A-Za-z0-9]+|[^A-Za-z0-9]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def label(code: Column, more: dict[str, dict[str, str]] | None = None) -> Column:
    """Label of a code: of the first category that has it, else the code titled; empty for null-like codes."""
    nothing = code.isNull() | code.isin("", "null", "undefined", "None")
    return F.when(nothing, "").otherwise(F.coalesce(F.try_element_at(_by_code(more, d.LABEL_ORDER, 2), code), titled(code)))


def short_label(code: Column, more: dict[str, dict[str, str]] | None = None) -> Column:
    full = label(code, more)
    cut = F.when(F.length(full) > 18, F.concat(F.substring(full, 1, 15), F.lit("…"))).otherwise(full)
    return F.when(code.isNull() | (code == ""), "").otherwise(F.coalesce(F.try_element_at(_dictionary(list(d.SHORT_LABELS.items())), code), cut))


def category(code: Column, more: dict[str, dict[str, str]] | None = None) -> Column:
    """First category that has the code, or empty."""
    return F.coalesce(F.try_element_at(_by_code(more, d.CATEGORY_ORDER, 0), code), F.lit(""))


def format_reference(first: Column, second: Column) -> Column:
    return F.concat_ws(":", first.cast("string"), second.cast("string"))


def parse_reference(text: Column) -> Column:
    """Struct of two numbers from "s:v", null if it isn't such."""
    part = lambda k: F.regexp_extract(text, r"^([0-9]+):([0-9]+)$", k).try_cast("int")
    return F.when(text.rlike(r"^[0-9]+:[0-9]+$"), F.struct(part(1).alias("first"), part(2).alias("second")))


def split_reference(ref: Column) -> Column:
    """Struct (surah, verse, word) from "s:v:w"."""
    at = F.split(ref, ":")
    return F.struct(*[F.get(at, k).try_cast("int").alias(n) for k, n in enumerate(("surah", "verse", "word"))])


def leading_int(text: Column) -> Column:
    """The whole number a text begins with, null if none."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")


def morphology_tag(tag: Column) -> Column:
    """Struct (lemma, root) from parts LEM: and ROOT: of a tag; braces around a lemma go."""
    lemma = F.regexp_replace(F.regexp_extract(tag, r"(?:^|\s)LEM:(\S+)", 1), "[{}]", "")
    return F.struct(F.nullif(lemma, F.lit("")).alias("lemma"), F.nullif(F.regexp_extract(tag, r"(?:^|\s)ROOT:(\S+)", 1), F.lit("")).alias("root"))


def unquote(text: Column) -> Column:
    return F.regexp_replace(text, '(?s)^"(.*)"$', "$1")


def clean_field(text: Column) -> Column:
    """Null-like words to the empty text, then trimmed."""
    return trim_spaces(F.when(text.isNull() | text.isin("(null)", "null", "None"), "").otherwise(text))


def xml_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_escape(text: Column) -> Column:
    return F.replace(xml_escape(text), F.lit("'"), F.lit("&#x27;"))


def xml_attribute(name: str, value: Column) -> Column:
    """``name="value"`` with a space before it, or nothing for an empty value."""
    clean = clean_field(value)
    return F.when(clean == "", "").otherwise(F.concat(F.lit(f' {name}="'), xml_escape(clean), F.lit('"')))


def slug(text: Column) -> Column:
    """Runs of other than letters, digits and _ to one hyphen, none at the ends."""
    return F.btrim(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", "-"), F.lit("-"))


def page_main(html: Column) -> Column:
    """The first main element of class "quran", null if it isn't there or isn't closed."""
    return F.nullif(F.regexp_extract(html, r'(?s)(<main\b[^>]*class="quran"[^>]*>.*?</main>)', 1), F.lit(""))


def page_title(html: Column) -> Column:
    """The trimmed title, null if there is none."""
    return F.when(html.rlike("(?s)<title>.*?</title>"), trim_spaces(F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1)))


def page_file(number: Column, name: Column) -> Column:
    digits = number.cast("string")
    return F.concat(F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), F.lit("0")), F.lit("-"), name, F.lit(".html"))


def mark_html(symbol: Column) -> Column:
    """Span of a reading mark, with its meaning."""
    rows = F.create_map(*chain.from_iterable((F.lit(m[0]), F.struct(*[F.lit(x).alias(k) for k, x in zip(("name", "type", "meaning", "action"), m[1:], strict=True)])) for m in d.MARKS))
    info = F.try_element_at(rows, symbol)
    about = F.concat(info["name"], F.lit(": "), info["meaning"], F.lit(". "), info["action"])
    return F.concat(
        F.lit('<span class="quran-mark '), info["type"], F.lit('" role="note" aria-label="'), html_escape(about), F.lit('" data-symbol="'), html_escape(symbol),
        F.lit('" data-meaning="'), html_escape(info["meaning"]), F.lit('" data-action="'), html_escape(info["action"]), F.lit('">'), symbol, F.lit("</span>"),
    )


def literal_pattern(term: str) -> str:
    """A pattern that matches the term as it stands."""
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def first_sentence(text: Column, fallback: int = 80) -> Column:
    """Text before the first full stop, or its first characters if that is empty."""
    return F.coalesce(F.nullif(F.get(F.split(text, r"\."), 0), F.lit("")), F.substring(text, 1, fallback))


def unique_glosses(glosses: Column, otherwise: Column, separator: str = " ") -> Column:
    """Distinct glosses in order, joined; noise left out; ``otherwise`` if none is left."""
    good = F.array_distinct(F.filter(glosses, lambda g: g.isNotNull() & ~g.isin("", "null", "undefined")))
    return F.when(F.size(good) > 0, F.array_join(good, separator)).otherwise(otherwise)
