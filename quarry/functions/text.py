"""Text functions as Column expressions; Arrow UDFs only where the JVM has no counterpart.

Every function maps null to null unless its docstring says otherwise.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: symbols that keep their form in ASCII folding
KEPT = "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩαβγδεζηθικλμνξοπρςστυφχψωÅ°±≈⋯∞∆ϵ⋅≫≡≅≃∙≠"
# fixed values: code points unified to the degree sign, and code points removed
DEGREES = "\u00ba\u02da\u030a\u2070\u2218\u25e6\u25cb"
REMOVED = "\u0307\u2020\u202a\u2297\u2122\u266f"
# fixed values: leftovers of removed citations
EMPTY_BRACKETS = ("[]", "[,]", "()", "( )", "[ ]", " - ")
# fixed values: abbreviations that lose their last dot, and those that lose all dots
LAST_DOT = ("Dr.", "Mr.", ",Mrs.", "et al.", "cf.", "viz.", "etc.", "Corp.", "Inc.", "spp.", "Co.", "Ltd.", "eg.", "ex.")
ALL_DOTS = ("A.R.", "A. R.", "i.e.", "e.g.")
# fixed values: spellings unified
SPELLINGS = (("sulph", "sulf"), ("aluminum", "aluminium"), ("cesium", "caesium"))
# fixed values: longer sequences before single characters
SEQUENCES = (("ï£½", "---"), ("Î¼", "\\mu "), ("Î±", "\\alpha"), ("Ïâ", "pi-"))
# fixed values: single characters and what replaces them
CHARACTERS = {
    "â": "-", "\xa0": " ", "©": "(c)", "¼": "1/4", "®": "(R)", "¶": "\n", "²": "^{2}", "µ": "\\mu", "′": "'", "“": '"',
    "‐": "-", "–": "-", "±": "+/-", "−": "-", "\uf8ff": "-", "≈": "~", "α": "\\alpha", "’": "'", "×": "x", "\uf8fe": "=",
    "\u2005": " ", "β": "\\beta", "ζ": "\\zeta", "ö": "o", "ü": "u",
}
# fixed values: single characters that go
DROPPED = "ÂÃÄ¤\x80\x85\x86\x88\x89\x8b\x8d\x90\x92\x93\x94\x96\x97\x98\x99\x9c\x9d"
# fixed values: parts of names that mark a copolymer
COPOLYMER_MARKS = ("g-", "g‐", "co‐", "co-", "(co)", "copoly", "b-", "b‐", "star-", "-stat-", "stat‐", "block", "ipn-", "-ran")
# fixed values: pairs closed up between tokens, in order
TOKEN_GAPS = (
    (" )", ")"), (" }", "}"), (" - ", "-"), (" ( ", "("), ("{ ", "{"), (" _ ", "_"), (" , ", ","), (" / ", "/"), ("( ", "("),
    ("' ", "'"), (" '", "'"), ('" ', '"'), (' "', '"'), ("[ ", "["), (" ]", "]"), (" : ", ":"),
)

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
URL = r"(?i)\b(?:https?://|ftp://|www\.)[^\s<>\"]+"


def arrow(returns: str):
    """A function over iterators of series as an Arrow UDF that is made where it is used: types need a session."""

    def wrap(f):
        @functools.wraps(f)
        def call(*columns) -> Column:
            return F.pandas_udf(f, returns)(*columns)

        return call

    return wrap


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def replaced(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def times(c: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.regexp_count(c, F.lit(re.escape(part)))


def filename_to_doi(name, compat: bool = False) -> Column:
    """``@`` stands for ``/``; the suffix goes. ``compat`` strips the suffix's letters as a set, eating into names."""
    c = F.replace(col(name), F.lit("@"), F.lit("/"))
    return F.rtrim(F.rtrim(c, F.lit(".html")), F.lit(".xml")) if compat else F.regexp_replace(c, r"\.(html|xml)$", "")


def doi_to_filename(doi, doctype) -> Column:
    return F.concat(F.replace(col(doi), F.lit("/"), F.lit("@")), F.lit("."), col(doctype))


def close_pairs(text) -> Column:
    """One missing closing brace or parenthesis is appended; one surplus ``)`` costs the last character."""
    c = col(text)
    c = F.when(times(c, "}") == times(c, "{") - 1, F.concat(c, F.lit("}"))).otherwise(c)
    opened, closed = times(c, "("), times(c, ")")
    return F.when(closed == opened - 1, F.concat(c, F.lit(")"))).when(closed == opened + 1, F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def join_tokens(text) -> Column:
    """A token joined from pieces: gaps around brackets and operators close, then one pair is repaired."""
    c = replaced(col(text), TOKEN_GAPS)
    long = F.length(c) >= 2
    parens, braces = times(c, ")") - times(c, "("), times(c, "}") - times(c, "{")
    return (
        F.when(long & (parens == -1), F.concat(c, F.lit(")")))
        .when(long & (braces == -1), F.concat(c, F.lit("}")))
        .when(long & (parens == 1), F.substring(c, F.lit(1), F.length(c) - 1))
        .otherwise(c)
    )


def trim_unmatched(name) -> Column:
    """Without a last bracket that nothing opens."""
    c = col(name)
    cut = (c.endswith(")") & (times(c, ")") > times(c, "("))) | (c.endswith("}") & (times(c, "}") > times(c, "{")))
    return F.when(cut, F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def chemical_spelling(text) -> Column:
    c = col(text)
    for a, b in SPELLINGS:
        c = F.regexp_replace(c, f"(?i){a}", b)
    return c


@arrow("string")
def unescape_html(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(html.unescape, na_action="ignore")


def folded(text: str) -> str:
    """ASCII letters for accented ones; KEPT symbols stay, what has no ASCII form goes."""
    if text.isascii():
        return text
    return "".join(c if c in KEPT or c.isascii() else unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in text)


@arrow("string")
def fold_ascii(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(folded, na_action="ignore")


def _letters(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


def normalize_text(text, fold: bool = True, chem: bool = True, spaces: bool = True, figures: bool = True, numbers: bool = False, lower: bool = False) -> Column:
    """The ordered clean-up of a paragraph before tagging or prompting."""
    c = unescape_html(col(text))
    c = F.regexp_replace(F.regexp_replace(c, EMAIL, "_EMAIL_"), URL, "_URL_")
    c = replaced(c, [(b, "") for b in EMPTY_BRACKETS])
    c = F.regexp_replace(c, _letters(REMOVED), "")
    c = replaced(c, [(a, a[:-1]) for a in LAST_DOT])
    c = F.regexp_replace(c, r"\s+(\^\{\w*\})", "$1")
    for nucleus in (r"\^\{1\}H", r"\^\{13\}C", r"\^\{7\}Li"):
        c = F.regexp_replace(c, f"({nucleus})", " $1")
    c = F.regexp_replace(c, r"\s+(_\{\w*\})", "$1")
    c = F.regexp_replace(c, r"(\^\{\w*)\s+\}", "$1}")
    c = F.regexp_replace(c, r"(_\{\w*\s+)\}", "$1}")
    c = replaced(c, [(a, a.replace(".", "")) for a in ALL_DOTS])
    c = F.regexp_replace(c, _letters(DEGREES), "°")
    c = replaced(c, [("° C", "°C"), ("°C", " °C")])
    c = F.regexp_replace(c, r"© \d{4} .+", "")
    if figures:
        c = F.regexp_replace(c, r"Fig.\s*([0-9]+)", "Figure $1")
        c = F.regexp_replace(c, r"[Rr]ef.\s*([0-9]+)", "reference $1")
        c = F.regexp_replace(c, r"\sal\.\s*[0-9\s]+", " al ")
    if spaces:
        c = F.regexp_replace(c, r"[\x0b\x0c\x{85}\n\r\x{2028}\x{2029}]", " ")
        c = F.regexp_replace(c, r"\s+,", ",")
        c = F.regexp_replace(c, r"([1-9]),([0-9]{3})", "$1$2")
        c = F.regexp_replace(c, r"(\w+)=(\d+)", "$1 = $2")
        c = F.regexp_replace(c, r"\(\s+", "(")
        c = F.replace(c, F.lit("%"), F.lit(" %"))
        c = F.regexp_replace(c, r"(\d+),([A-Za-z])", "$1, $2")
    c = chemical_spelling(c) if chem else c
    c = fold_ascii(c) if fold else F.regexp_replace(F.translate(c, "˜⁓∼∽∿〜～⁄∕‘’“”", "~~~~~~~//''\"\""), r"[\x01-\x08\x0e-\x1b\x{2028}-\x{202e}\x{2060}-\x{2069}\x{206b}-\x{206f}]", "")
    if numbers:
        c = F.regexp_replace(F.regexp_replace(c, r"-?\d+/\d+", " _FRAC_ "), r"(?<![\w.])[+-]?\d+(?:[.,]\d+)*(?![\w])", "_NUMBER_")
    c = F.lower(c) if lower else c
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_chars(text) -> Column:
    """Special characters and mojibake to a plain notation, then spacing."""
    c = replaced(col(text), SEQUENCES)
    one = {k: v for k, v in CHARACTERS.items() if len(v) == 1}
    c = replaced(c, [(k, v) for k, v in CHARACTERS.items() if len(v) > 1])
    c = F.translate(c, "".join(one) + DROPPED, "".join(one.values()))
    c = F.replace(c, F.lit("("), F.lit(" ("))
    c = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return replaced(c, [(" isa ", " is a "), ("( ", "("), (" )", ")"), ("- ", "-"), (" ^", "^"), (" _", "_"), ("}=", "} ="), (" , ", ", "), ("^{[}", "["), ("^{]}", "]"), ("-\\x89", "")])


def strip_heading(text, compat: bool = False) -> Column:
    """Without a leading section word; ``compat`` strips the words' letters as sets."""
    if compat:
        return F.ltrim(F.ltrim(col(text), F.lit("Abstract")), F.lit("Introduction"))
    return F.regexp_replace(col(text), r"^(?:Abstract|Introduction)\s*", "")


def norm_name(name) -> Column:
    """Lower case without spaces; alpha in letters."""
    return replaced(F.trim(F.lower(col(name))), [(" ", ""), ("α", "\\alpha")])


def norm_value(value) -> Column:
    """Lower case, one form of plus-minus and of degrees, no spaces."""
    forms = (" ± ", " +/- ", " + /-", " +/-", "+/-")
    return replaced(F.trim(F.lower(col(value))), [(f, "±") for f in forms] + [("° C", "°C"), (" ", "")])


def name_matches(name, names) -> Column:
    """The name, or its normal form, is in the array."""
    n = col(name)
    return F.array_contains(names, n) | F.exists(names, lambda x: norm_name(x) == norm_name(n))


def values_match(a, b) -> Column:
    """Normal forms equal, or one holds the other."""
    x, y = norm_value(a), norm_value(b)
    return x.contains(y) | y.contains(x)


def materials_match(a, b, a_corefs, b_corefs) -> Column:
    """Normal names equal, one in the other (over two letters), or one among the other's coreferents."""
    x, y = norm_name(a), norm_name(b)
    among = lambda n, names: F.exists(names, lambda c: norm_name(c) == n)
    return (x == y) | ((F.length(y) > 2) & x.contains(y)) | ((F.length(x) > 2) & y.contains(x)) | among(x, b_corefs) | among(y, a_corefs)


def loose_key(text) -> Column:
    """The form in which extracted entities, properties and values are compared without regard to case, spaces and degrees."""
    return replaced(F.lower(F.trim(col(text))), [("° c", "°c"), (" ", "")])


def clean_word(word, dash: bool = True) -> Column:
    """Trimmed, without a leading tilde or a trailing dash, thousands closed up."""
    c = F.ltrim(F.trim(col(word)), F.lit("~"))
    c = F.rtrim(c, F.lit("-")) if dash else c
    return F.trim(F.replace(c, F.lit(","), F.lit("")))


def split_error(value) -> Column:
    """``a +/- b``, with or without one pair of parentheses, as (value, error); null where either part is no number."""
    c = col(value)
    wrapped = c.contains("(") & c.contains(")")
    bare = F.when(wrapped & (c.contains("x") | c.contains("10^")), None).when(wrapped, F.translate(c, "()", "")).otherwise(c)
    parts = F.split(bare, r"\+/-")
    number = clean_word(parts[0]).try_cast("double")
    error = clean_word(F.get(F.split(F.trim(F.get(parts, F.lit(1))), r"\s+"), F.lit(0))).try_cast("double")
    return F.when(number.isNotNull() & error.isNotNull(), F.struct(number.alias("value"), error.alias("error")))


def polymer_type(name) -> Column:
    """star_polymer, copolymer or homopolymer, by cues in the name."""
    c = col(name)
    marks = F.lit(False)
    for m in COPOLYMER_MARKS:
        marks = marks | c.contains(m)
    capitals = c.contains("-") & (F.upper(c) == c)
    return F.when(c.isNull(), None).when(c.contains("star"), "star_polymer").when((times(c, "poly") > 1) | marks | capitals, "copolymer").otherwise("homopolymer")


def sentences(text) -> Column:
    """Split after a full stop, question or exclamation mark that white space and a capital, digit or bracket follow."""
    return F.filter(F.transform(F.split(col(text), r"(?<=[.?!])\s+(?=[A-Z0-9(\[])"), F.trim), lambda s: s != "")


def relevant_sentences(text, keywords) -> Column:
    """The sentences that hold any of the keywords."""
    return F.filter(sentences(text), lambda s: F.exists(keywords, lambda k: s.contains(k)))


def caption_number(caption) -> Column:
    """``Table 3`` or ``Table IV`` at the start of a caption."""
    return F.nullif(F.regexp_extract(col(caption), r"^\s*(Table\s+(?:[0-9]+|[IVXLC]+))\b", 1), F.lit(""))


def coerce_cell(cell) -> Column:
    """(whole, real, text): the narrowest kind the cell can be read as; the others are null."""
    c = F.trim(col(cell))
    whole = F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("long"))
    real = F.when(whole.isNull(), c.try_cast("double"))
    return F.struct(whole.alias("whole"), real.alias("real"), F.when(whole.isNull() & real.isNull(), c).alias("text"))


def unique_key(prefix: str) -> Column:
    return F.concat(F.lit(prefix + "-"), F.uuid())


def prompt(template: str, **values) -> Column:
    """A template with {names} filled from columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[col(values[p]) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def preprocess_for_prompt(text) -> Column:
    return normalize_text(text)


def abbreviation_pairs(text: str) -> list[tuple[str, str]]:
    """(short, long) definitions after Schwartz and Hearst (2003), in order; one-letter forms are passed over.

    A short form in parentheses has 2 to 10 characters and two words at most; its long form
    ends before the parenthesis and is the shortest whose letters hold the short form's, right to
    left, the first at the start of a word.
    """
    found = []
    for m in re.finditer(r"\(([^()]{2,40})\)", text):
        short = m.group(1).split(";")[0].split(",")[0].strip()
        if not 2 <= len(short) <= 10 or len(short.split()) > 2 or not any(c.isalpha() for c in short) or not short[0].isalnum():
            continue
        words = text[: m.start()].rstrip().split()
        window = " ".join(words[-min(len(short) + 5, 2 * len(short)) :])
        at, i = len(window) - 1, len(short) - 1
        while i >= 0:
            c = short[i].lower()
            if c.isalnum():
                while at >= 0 and (window[at].lower() != c or (i == 0 and at > 0 and window[at - 1].isalnum())):
                    at -= 1
                if at < 0:
                    break
                at -= 1
            i -= 1
        if i < 0:
            long = window[window.rfind(" ", 0, at + 1) + 1 :] if at >= 0 else window
            if len(long) > len(short) and short not in long.split():
                found.append((short, long))
    return found


@arrow("array<struct<short:string,long:string>>")
def abbreviations(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Definitions of a paragraph's abbreviations."""
    for t in texts:
        yield t.map(lambda x: [{"short": a, "long": b} for a, b in abbreviation_pairs(x or "")])
