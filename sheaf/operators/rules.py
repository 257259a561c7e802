"""Rules on texts: what is a title, a name list, a formula line, a caption, a clause left untranslated; checks of translations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens, word lists and patterns that decide the results.
MATH_TOKEN, CITE_TOKEN, STYLE_TOKEN = r"__MATH_\d{4,}__", r"__CITE_\d{4,}__", r"__STYLE_(\d{4,})_(OPEN|CLOSE)__"
ADDRESS = r"https?://\S+|www\.\S+|\S+@\S+"
CJK = "[㐀-鿿]"
PLACEHOLDER_TITLES = ["untitled", "document", "paper", "main", "latex", "manuscript", "template", "abstract", "introduction", "references", "summary", "摘要", "引言", "目录"]
TITLE_FILE, TITLE_HASH = r"(?i)\.(?:pdf|docx?|tex|ps|dvi)$", r"(?i)^[0-9a-f]{32,64}$"
TITLE_ID = r"(?i)^(?:arxiv\s*:\s*|\d{4}\.\d{4,5}(?:v\d+)?\b|doi\s*:|10\.\d{4,9}/|https?://|www\.)"
TITLE_NOTICE = r"(?i)^(?:\d+[.\s]+(?:introduction|background)\b|copyright\b|©|all rights reserved\b|provided proper attribution\b|preprint\b|submitted to\b|under review\b|published as\b|accepted (?:at|by|for|as)\b|proceedings of\b|journal of\b|anonymous (?:author|submission)|microsoft word\b|latex template\b)"
SECTION_WORDS = ["ABSTRACT", "METHOD", "METHODS", "RESULT", "RESULTS", "SUMMARY", "TABLE", "FIGURE", "APPENDIX", "CONCLUSION"]
FUNCTIONS = ["relu", "softmax", "sigmoid", "tanh", "log", "exp", "max", "min", "sin", "cos"]
MATH_WORDS = ["log", "exp", "sin", "cos", "max", "min", "tr"]
COMMON = r"(?i)\b(?:the|is|are|we|of|for|and|in|to|by|as|an|or|let|be|if|not)\b"
CONNECTORS = ["a", "an", "the", "of", "and", "in", "for", "on", "to", "with", "by", "via", "from"]
CLAUSE = r"\b[A-Za-z][A-Za-z'-]*(?:\s+[A-Za-z][A-Za-z'-]*){3,}\b"
NUMBERED_NAME = r"^(?:\d+(?:\.\d+)*\.?\s+|\([a-z]\)\s*)?([A-Za-z][A-Za-z0-9]*(?:[-.][A-Za-z0-9]+)*)$"
QUOTED = "\"[^\"\n]+\"|“[^”\n]+”|`[^`\n]+`"
REPLY_LITERAL = r"(?i)\b(?:respond(?:s|ed)?|repl(?:y|ies|ied)|return(?:s|ed)?|output(?:s|ted)?)(?:\s+with)?\s*:?\s*(" + QUOTED + ")"
LABEL, PRODUCT = r"^(?:[A-Z][A-Za-z]*\d[\w.−-]*|[A-Z]{2,}(?:-[A-Z][A-Za-z0-9]*)+|[\d.+−-]+)$", r"^[A-Za-z][A-Za-z0-9.-]*$"
MATH_CHARS = "∑∫∏∂√∇∞∈∉⊂⊆∀∃≤≥≠±×÷⋅→←↔⇒⇔∪∩∅⊗⊕⊥∥⋯…≈≡∝≪≫−∼⟨⟩αβγδεζηθικλμνξοπρστυφχψωΓΔΘΛΞΠΣΦΨΩ⋆∗∴∵∘∙†‡"
MATH_FONTS = ["cmmi", "cmsy", "cmex", "msam", "msbm", "mtmi", "mtsyn", "txsy", "latinmodernmath", "lmmath", "xchartermath", "libertinusmath", "newtxmath", "texgyretermesmath", "asana math", "firamath", "xits", "stix", "cambria math", "cambriamath", "mathjax"]
PROSE_WORDS = r"(?i)\b(?:where|with|when|which|that|the|each|these|their|incoming|experts|cores|served|retains|denotes|defined|minimize|given|such)\b"
EQUATION = r"=|→|^\s*(arg|max|min)\b|\^|_"
TABLE_NUMBER = r"(?:\d+|[IVXLCDM]+)"
CAPTIONS = {
    "algorithm": r"(?i)^\s*(Algorithm|Alg\.)\s*\d+",
    "table": rf"(?i)^\s*(Table|Tab\.)\s*{TABLE_NUMBER}\s*[:.|·–—]",
    "table_start": rf"(?i)^\s*(Table|Tab\.)\s*{TABLE_NUMBER}\b",
    "figure": r"(?i)^\s*(Figure|Fig\.)\s*\d+\s*[:.|" + "·–—]",
    "citation": r"^\[[\d,\s\-" + "–]+\\]",
    "references": r"(?i)^\s*R\s*e\s*f\s*e\s*r\s*e\s*n\s*c\s*e\s*s?\s*$",
    "reference_mark": r"(?i)\b(?:arXiv|CoRR|doi:|ISBN)\b",
}
ALGORITHM_LABEL = r"(?i)^\s*(Input|Output|Desc\.|Algorithm|Alg\.|while|for|if\s|return)"
AFTER_REFERENCES = r"^(?:Appendix|Appendices|Acknowledg|Supplement|[A-Z](?:\.|\s)|\d+\s+[A-Z])|(?i)^(?:Limitations|Conclusion|Ethics Statement)$"

SUBFIGURE, ABBREVIATION_GAPS, CODE_NAME = r"^\([a-z]\)\s*", r"[\s\d#(),.+/−-]+", r"^[A-Z][A-Z\d-]+$"
COMMON_BY_FORMULA = r"(?i)\b(?:the|is|are|we|of|for|and|with|where|in|to|this|that|from|by|as)\b"
DEFINITION = r"^(?:where\s+)?[A-Za-z][A-Za-z0-9]*(?:_\{?\w+\}?)?(?:\([^)]*\))?\s*=\s*[A-Za-z][A-Za-z0-9]*\s*\("
EXPLAINS, NUMBER_AT_END, LATEX, OPERATORS = r"(?i)\b(?:where|with)\b", r"\(\d+\)\s*$", r"\\[a-zA-Z]+", "[_^=←→±≤≥∈∑∫∂√]"
LETTER, LETTER_OR_DIGIT, LONG_WORD, WORD = r"\p{L}", r"[\p{L}\p{Nd}]", r"[A-Za-z][A-Za-z'\-]{1,}", r"[A-Za-z][A-Za-z'\-]+"
BREAK_START, BREAK_END = r"^(?:__STYLE_\d{4,}_OPEN__)*[a-z]", r"([A-Za-z]{2})-((?:__STYLE_\d{4,}_CLOSE__)*)$"
FENCE, GIVEN_NAME, MATH_LETTER = r"^```(?:json)?\s*|\s*```$", r"[A-Za-z][A-Za-z.'-]*", "[\U0001d400-\U0001d7ff]"
ADDRESSES = [r"(?i)^(?:[*†]?(?:github\.com|arxiv\.org)/\S+\s*)+$", r"^[\w.-]+/[\w.-]+$", r"^[A-Z][A-Z0-9_]+_[\da-f-]{16,}$"]
QUANTITY = r"(?i)^[−-]?\d+(?:\.\d+)?\s+(?:bpp|fps|ms|ms/frame|dB|Hz)$"
IDENTIFIERS = [r"(?i)^ORCID\s*:?\s*[\d−–-]+$", r"(?i)^\S*(?:https?://|www\.|@)\S*$"]
CITED = r"(?i)\([^()]*\bet\s+al\.?[^()]*\)"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def words_of(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def usable_title(text: Column) -> Column:
    """Whether a text can be a title: neither a placeholder, a file name, an identifier, an address nor a publisher's notice."""
    return (
        F.length(text).between(2, 600) & text.rlike(LETTER) & ~text.contains("@") & ~F.lower(text).isin(PLACEHOLDER_TITLES)
        & ~text.rlike(TITLE_FILE) & ~text.rlike(TITLE_HASH) & ~text.rlike(TITLE_ID) & ~text.rlike(TITLE_NOTICE)
    )


def clean_title(text: Column) -> Column:
    """A title in one line: soft hyphens out, words broken by a hyphen joined, breaks between ideographs out, white space collapsed."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "­", "")
    out = F.regexp_replace(out, r"(\w)-[ \t]*\n[ \t]*(?=\w)", "$1-")
    out = F.regexp_replace(out, rf"({CJK})\s*\n\s*(?={CJK})", "$1")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def name_list(text: Column) -> Column:
    """Whether a text lists names: four words or more, a comma or semicolon, all but connectives capitalised."""
    words = found(text, GIVEN_NAME)
    names = F.filter(words, lambda w: ~F.regexp_replace(F.lower(w), r"^\.+|\.+$", "").isin("and", "et", "al"))
    return (F.size(words) >= 4) & text.rlike("[,;]") & (F.size(names) > 0) & F.forall(names, lambda w: w.rlike("^[A-Z]"))


def plain_of(text: Column) -> Column:
    """A text without formula, citation and style tokens."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), MATH_TOKEN, " "), CITE_TOKEN, " ")
    return F.regexp_replace(out, STYLE_TOKEN, "")


def nontranslatable(text: Column) -> Column:
    """Whether a text has nothing to translate: formulas, labels, abbreviations, names, quantities, addresses, other script."""
    formula = F.coalesce(text, F.lit("")).rlike(MATH_TOKEN)
    bare = strip(plain_of(text))
    rest = F.regexp_replace(bare, SUBFIGURE, "")
    short = words_of(F.regexp_replace(rest, ABBREVIATION_GAPS, " "))
    labels = words_of(F.regexp_replace(rest, SUBFIGURE, ""))
    heading = F.regexp_extract(rest, NUMBERED_NAME, 1)
    words = lambda n: found(rest, f"[A-Za-z]{{{n},}}")
    return (
        (formula & F.forall(found(bare, "[A-Za-z]{2,}"), lambda w: F.lower(w).isin(FUNCTIONS)))
        | (bare == "")
        | (bare.rlike(SUBFIGURE) & rest.rlike(CODE_NAME))
        | rest.rlike(ADDRESSES[0]) | rest.rlike(ADDRESSES[1]) | rest.rlike(ADDRESSES[2])
        | ((F.size(short) > 0) & ~F.exists(short, lambda w: w.isin(SECTION_WORDS)) & F.forall(short, lambda w: w.rlike("^[A-Z]{2,8}$")))
        | ((F.size(labels) > 0) & F.forall(labels, lambda w: w.rlike(LABEL) | (w.rlike(PRODUCT) & w.rlike("[a-z][A-Z]"))))
        | rest.rlike(QUANTITY)
        | (formula & ~rest.rlike("[A-Za-z]{4,}") & ~rest.rlike(COMMON))
        | (rest.rlike(MATH_LETTER) & F.forall(words(2), lambda w: (F.upper(w) == w) | w.isin(MATH_WORDS)))
        | heading.rlike("[a-z][A-Z]")
        | (rest.rlike(CJK) & ~rest.rlike("[A-Za-z]{3,}"))
        | ~F.regexp_replace(rest, ADDRESS, "").rlike("[A-Za-z]{2,}")
        | rest.rlike(IDENTIFIERS[0]) | rest.rlike(IDENTIFIERS[1])
        | name_list(rest)
    )


def _allowed(text: Column) -> Column:
    """A text without what may stay in the source's language: tokens, addresses, citations in parentheses."""
    return F.regexp_replace(F.regexp_replace(plain_of(text), f"(?i){ADDRESS}", " "), CITED, " ")


def residual_clauses(translated: Column, source: Column) -> Column:
    """Runs of four or more Latin words that a translation still has, but for proper names of the source and literals that
    the source says are to be output."""
    original, left = _allowed(source), _allowed(translated)
    literals = F.transform(found(original, REPLY_LITERAL, 1), lambda m: F.substring(m, F.lit(2), F.length(m) - 2))
    cleared = F.aggregate(literals, left, lambda t, m: F.replace(F.replace(F.replace(t, F.concat(F.lit('"'), m, F.lit('"')), F.lit(" ")), F.concat(F.lit("“"), m, F.lit("”")), F.lit(" ")), F.concat(F.lit("`"), m, F.lit("`")), F.lit(" ")))

    def proper(phrase: Column) -> Column:
        w = words_of(phrase)
        capital = lambda x: x.rlike("^[A-Z]")
        return original.contains(phrase) & (F.size(F.filter(w, capital)) >= 2) & F.forall(w, lambda x: capital(x) | x.isin(CONNECTORS))

    return F.filter(found(cleared, CLAUSE), lambda p: ~proper(p))


def markers_nest(text: Column) -> Column:
    """Whether numbered style markers open and close in pairs, none crossing another. The open numbers are kept as one string."""
    marks = found(F.coalesce(text, F.lit("")), STYLE_TOKEN)
    number = lambda m: F.concat(F.regexp_extract(m, STYLE_TOKEN, 1), F.lit(","))

    def step(held: Column, m: Column) -> Column:
        closes = F.when(held.endswith(F.concat(F.lit(","), number(m))), F.substring(held, F.lit(1), F.length(held) - F.length(number(m)))).otherwise("!")
        return F.when(held.startswith("!"), held).when(m.endswith("_OPEN__"), F.concat(held, number(m))).otherwise(closes)

    return F.aggregate(marks, F.lit(","), step) == ","


def same_tokens(a: Column, b: Column, pattern: str) -> Column:
    """Whether two texts have the same tokens, each as often."""
    sides = [F.array_sort(found(F.coalesce(x, F.lit("")), pattern)) for x in (a, b)]
    return sides[0] == sides[1]


def translation_issue(source: Column, masked: Column, translated: Column, chinese: Column) -> Column:
    """The first of the checks that a translation fails, or null."""
    wanted = chinese & ~nontranslatable(source)
    return (
        F.when(strip(F.coalesce(translated, F.lit(""))) == "", "empty")
        .when(~same_tokens(masked, translated, MATH_TOKEN), "formulas")
        .when(~same_tokens(masked, translated, CITE_TOKEN), "citations")
        .when(~same_tokens(masked, translated, STYLE_TOKEN) | ~markers_nest(translated), "styles")
        .when(wanted & ~translated.rlike(CJK), "language")
        .when(wanted & (F.size(residual_clauses(translated, source)) > 0), "clause")
    )


def caption_kind(text: Column) -> Column:
    """The first recogniser that a line meets, or null."""
    out = F.when(text.rlike(CAPTIONS["algorithm"]), "algorithm")
    for kind in list(CAPTIONS)[1:-1]:
        out = out.when(text.rlike(CAPTIONS[kind]), kind)
    return out.when((F.length(text) < 60) & text.rlike(CAPTIONS["reference_mark"]), "reference_mark")


def function_definition(text: Column, font: Column) -> Column:
    return F.lower(font).contains("cmr") & text.rlike(DEFINITION)


def math_font(font: Column) -> Column:
    return F.lower(font).rlike("|".join(MATH_FONTS))


def math_line(text: Column, font: Column) -> Column:
    """Whether a line is a formula; the first rule that applies decides."""
    symbols, letters = F.size(found(text, f"[{MATH_CHARS}]")), F.size(found(text, LETTER_OR_DIGIT))
    words = found(text, LONG_WORD)
    total = F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w))
    equation, in_font, n = text.rlike(EQUATION), math_font(font), F.length(text)
    braces = text.contains("{") & text.contains("}") & text.rlike(OPERATORS)
    return (
        F.when(text.rlike(PROSE_WORDS), False)
        .when(in_font & ((symbols > 0) | equation) & ~text.rlike(COMMON_BY_FORMULA), True)
        .when(function_definition(text, font), True)
        .when(text.rlike(EXPLAINS) & ~text.rlike(NUMBER_AT_END), False)
        .when((F.size(words) >= 4) & (total >= F.greatest(F.lit(12), symbols * 3)), False)
        .when(text.rlike(LATEX) & (F.size(found(text, " ")) <= 2), True)
        .when(braces & ((n < 40) | (symbols >= F.greatest(F.lit(2.0), letters * 0.4))), True)
        .when((symbols >= 2) & (symbols >= letters * 0.5), True)
        .when(in_font, True)
        .when((n < 70) & (symbols >= 1) & (letters <= 2 * symbols), True)
        .when((n < 50) & equation & (letters <= 12), True)
        .when((n < 70) & (F.lower(font).contains("cmr") | F.lower(font).contains("times")) & equation, True)
        .otherwise(False)
    )


def body_rescue(text: Column, font: Column, math: Column) -> Column:
    """Whether a line that was set aside is body text after all: 40 characters, five words, four spaces, no label of an algorithm."""
    still = function_definition(text, font) | (math & math_font(font) & math_line(text, font))
    return ~still & (F.length(text) >= 40) & ~text.rlike(CAPTIONS["algorithm"]) & ~text.rlike(ALGORITHM_LABEL) & (F.size(found(text, WORD)) >= 5) & (F.size(found(text, " ")) >= 4)


def join_lines(a: Column, b: Column) -> Column:
    """Two lines of a paragraph as one text: a word that is broken by a hyphen is joined, style markers around the break stay."""
    rest = F.regexp_replace(b, r"^\s+", "")
    return F.when(a.rlike(BREAK_END) & rest.rlike(BREAK_START), F.concat(F.regexp_replace(a, BREAK_END, "$1$2"), rest)).otherwise(F.concat(a, F.lit(" "), b))


def spacing(text: Column, chinese: Column) -> Column:
    """A translation without layout noise: zero-width characters out, white space collapsed, lines trimmed; for Chinese no
    spaces between ideographs and beside marks."""
    out = F.regexp_replace(text, "[​﻿]", "")
    out = F.regexp_replace(out, r"[^\S\n]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, r" ?\n ?", "\n"), r"^\s+|\s+$", "")
    c = CJK[1:-1]
    han = F.regexp_replace(out, rf"([{c}]) +(?=[{c}A-Za-z0-9_（(【\[])", "$1")
    han = F.regexp_replace(han, rf"([A-Za-z_）)】\]]) +(?=[{c}])", "$1")
    han = F.regexp_replace(han, r" +([，。、！？；：,.!?;:）)】\]])", "$1")
    han = F.regexp_replace(F.regexp_replace(han, r"([（(【\[]) +", "$1"), r"([，。、！？；：]) +", "$1")
    return F.when(chinese, han).otherwise(out)


def unfenced(reply: Column) -> Column:
    """A model's reply without the fence of a code block."""
    return F.regexp_replace(strip(reply), FENCE, "")


def readable(text: Column, formulas: Column) -> Column:
    """A translation with its formulas' texts in place of their tokens (a map) and without style markers."""
    put = F.aggregate(F.map_entries(formulas), text, lambda t, e: F.replace(t, e["key"], e["value"]))
    return F.regexp_replace(put, STYLE_TOKEN, "")


def human_bytes(size: Column) -> Column:
    """A size in steps of 1024: at most 2 decimals below 10, 1 below 100, none beyond; thousands apart, no zeros at the end."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        x = F.greatest(size, F.lit(0)) / float(1024**k)
        exact = F.when(x < 10, F.round(x, 2)).when(x < 100, F.round(x, 1)).otherwise(F.round(x, 0))
        shown = F.regexp_replace(F.regexp_replace(F.when(x < 100, exact.cast("decimal(20,2)").cast("string")).otherwise(F.format_number(exact.cast("long"), 0)), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        out = F.when(size >= 1024**k, F.concat(shown, F.lit(f" {unit}"))).otherwise(out)
    return out
