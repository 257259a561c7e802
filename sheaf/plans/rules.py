"""Queries on the rules for texts. Their inputs are shapes of lines filled with the names and numbers of the part table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules as R
from ..operators import spans
from ..sources.tables import table

TITLES = [
    "%N of Things", "untitled", "Main", "%n.pdf", "%n.DOCX", "arXiv: %k.12345 %n", "2401.%k%k %n", "doi: 10.1234/%n", "https://x.org/%n", "%N @ %b", "%k", "x", "Copyright %k %N", "© %n",
    "1. Introduction to %n", "%k Background of %n", "Preprint %n", "Accepted at %N", "Accepted %N", "Journal of %N", "journals of %n", "Microsoft Word - %n", "  %N\n in  Two Lines ", "Deep-\n %n", "soft­%n", "深度\n学习 %k", "摘要", "深度 学习", "0123456789abcdef0123456789ABCDEF", "%n: a study", "Anonymous author %k", "Under review %n", "Proceedings %n", "10.12345/%k", "www.%n", "%N%N%N", "REFERENCES", "Published as %n",
]
NOTHING = [
    "__MATH_0001__ relu(softmax) __MATH_0002__", "__MATH_0001__ of the %n", "__MATH_0012__ + ab", "", "  ", "(a) RESNET-%k", "(b) the %n", "github.com/%k/x arxiv.org/abs/%k", "*github.com/%k", "%k/x.y-z", "DATA_SET_0123456789abcdef01", "GPU, CPU + %k",
    "RESULTS", "TABLE %k", "BERT-Base T5 v%k", "Bert%k Bert2.%k", "PaperNet resNet", "%k.5 ms", "-%k fps", "12 ms/frame", "𝐀 max 𝐁 LOG", "𝐀 is %n", "4. PaperOrchestra", "(c) plainname", "4.2 iPhone%k", "中文 ab", "中文 abc %n", "见 https://x.org/%k 1",
    "%k + 12 = x", "ORCID: 0000-%k", "https://x.org/%n", "mail@%n.org", "Anna Lee, Bo Chen and C. Dee", "Anna Lee and Bo Chen", "Anna Lee; bo chen, Cy Dee", "%n is a plain line", "See %N for more", "__STYLE_0001_OPEN____STYLE_0001_CLOSE__", "__CITE_0001__", "__STYLE_0001_OPEN__%n__STYLE_0001_CLOSE__", "A 1 (B) c", "von der Leyen, Ursula et al.",
]
PAIRS = [  # source, translation
    ("The %n is red.", "这个 %k 是红的。"), ("The %n is red.", ""), ("The %n is red.", "  "), ("The %n is red.", "The %n is red."), ("The %n is red.", "%k 是 a very long %n left"), ("See __MATH_0001__ here for %n", "见 __MATH_0001__ 处"), ("See __MATH_0001__ here for %n", "见 __MATH_0002__ 处"),
    ("As __CITE_0001__ and __CITE_0002__ say", "__CITE_0002__ 与 __CITE_0001__ 说"), ("As __CITE_0001__ says", "__CITE_0001____CITE_0001__ 说"), ("A __STYLE_0001_OPEN__%n__STYLE_0001_CLOSE__ b", "一 __STYLE_0001_OPEN__%k__STYLE_0001_CLOSE__ 二"), ("A __STYLE_0001_OPEN__%n__STYLE_0001_CLOSE__ b", "__STYLE_0001_CLOSE__一__STYLE_0001_OPEN__"),
    ("__STYLE_0001_OPEN__a__STYLE_0002_OPEN__b__STYLE_0002_CLOSE__c__STYLE_0001_CLOSE__ is %n", "__STYLE_0001_OPEN__一__STYLE_0002_OPEN__二__STYLE_0001_CLOSE__三__STYLE_0002_CLOSE__"), ("__STYLE_0001_OPEN__a__STYLE_0002_OPEN__b__STYLE_0002_CLOSE__c__STYLE_0001_CLOSE__ is %n", "__STYLE_0002_OPEN__一__STYLE_0002_CLOSE__二__STYLE_0001_OPEN__三__STYLE_0001_CLOSE__"),
    ("We use the Big Model of %N Data here", "我们用 the Big Model of %N Data"), ("We use the Big Model of %N Data here", "我们用 Big Model of %N Data"), ("It will respond with \"yes it is a %n\" then", "它回答 “yes it is a %n”"), ("It may say \"yes it is a %n\" then", "它说 \"yes it is a %n\""), ("Foo (see Li et al. 2020) is %n", "富 (as we know from Li et al. 2020) 是"),
    ("https://x.org/%n", "https://x.org/%n"), ("%k.5 ms", "%k.5 ms"), ("GPU %k", "GPU %k"), ("Output: `one two three four` for %n", "输出 `one two three four`"), ("The link https://a.b/c d e f is %n", "链接 https://a.b/c d e f"),
]
LINES = [  # text, font
    ("where x is the %n", "CMMI10"), ("x_1 = y + %k", "CMMI10"), ("f(x) = Concat(a, b, c, d)", "CMR10"), ("%n with a = b", "CMR10"), ("y with a = b (%k)", "CMR10"), ("we take a long %n of many words α", "Times"), ("\\alpha \\beta", "Arial"), ("\\alpha and one more %n here", "Arial"), ("{x_i} = %k", "Arial"), ("∑ ∫ x", "Arial"),
    ("∑α∫β %n", "Arial"), ("plain", "STIXGeneral"), ("K − %k", "Arial"), ("Pass@1 → %n", "Arial"), ("a = %k", "Arial"), ("a long name = %n and more", "Times-Roman"), ("a long name = %n and more", "Arial"), ("argmax %n", "Arial"), ("max %k", "Arial"), ("%N", "Arial"), ("", "Arial"), ("∑ is the sum of %n", "CMSY10"), ("Algorithm %k Sorting", "Times"), ("Alg. x", "Times"),
    ("Table %k: %n", "Times"), ("Table %k summarizes %n", "Times"), ("Tab. IV — %n", "Times"), ("Figure %k. The %n", "Times"), ("Fig. x", "Times"), ("figure 2 shows", "Times"), ("[%k] Lee. %N", "Times"), ("[1, 2-3] x", "Times"), ("References", "Times"), ("R E F E R E N C E S", "Times"), ("arXiv %k", "Times"), ("A long line that says arXiv somewhere and goes on well beyond sixty characters", "Times"),
    ("Input: a long %n of words that are many and more", "Times"), ("dataset D = {x} of a long %n to derive many more words", "CMMI10"), ("Implementation (Alg. 1) of the %n takes many more words here", "Times"), ("if so the long %n of words are many and more again", "Times"),
]
SPACED = ["  中 文 %k 和 %n  ", "a   b\t\tc​ %n", "深 度 （ 学习 ） ， 好 。 是", "中文 abc 中文 __MATH_0001__ 中文", "one\n  two \n\n three  ", "“ %n ” , 中 : 文", "1 引言 %k 节", "（ a ） 【 b 】", "text with no marks %n"]
REPLIES = ["```json\n[\"%n\"]\n```", "```\n%n```", "%n", "  ```json %k ```  ", "x ``` y", "__STYLE_0001_OPEN__%n__STYLE_0001_CLOSE__ __MATH_0001__"]
BROKEN = [("the long exam-", "ple of %n"), ("the long exam-", "Ple"), ("exa-__STYLE_0001_CLOSE__", "__STYLE_0002_OPEN__mple %n"), ("a-", "b"), ("%n", "  and so"), ("1-", "x"), ("ab-", "  cd")]

CITED = [  # text, the same masked
    ("As (Smith, 2020; Lee et al., 2019) show %n", "As __CITE_0000__ show %n"), ("Smith (2020) and Lee & Park (2019, 2021) say %n", "__CITE_0000__ and __CITE_0001__ say %n"), ("as in [1, 2–4] and [7] %k", "as in __CITE_0000__ and __CITE_0001__ %k"), ("see Table 2020 of %n", "see Table 2020 of %n"),
    ("what van der Berg and Lee 2001a, b hold of %n", "what van __CITE_0000__ hold of %n"), ("__CITE_0000__ is used [%k]", "__CITE_0000__ is used __CITE_0001__"), ("shown by (Miller, ", "shown by __CITE_0000__"), ("2019; Lee 2020) we see %n", "__CITE_0000__ we see %n"), ("(see Smith, 2020) %n", "(see __CITE_0000__) %n"),
    ("year Ox 20201 of %n", "year Ox 20201 of %n"), ("no cite of %n (at all)", "no cite of %n (at all)"), ("%n by Müller et al. 1999", "%n by __CITE_0000__"), ("(Smith, 2020; and others) %n", "(__CITE_0000__; and others) %n"), ("Lee et al., ", "__CITE_0000__"),
]


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def filled(spark: SparkSession, sf_dir: str, **shapes: list[str]) -> DataFrame:
    """A row for each part: its id and, for each name, the shape that its number chooses, filled with its name and number."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")

    def fill(shape: list[str]) -> Column:
        out = F.element_at(F.array(*map(F.lit, shape)), (F.col("p_partkey") % len(shape) + 1).cast("int"))
        for mark, value in (("%n", F.col("p_name")), ("%N", F.initcap("p_name")), ("%k", F.col("p_partkey").cast("string")), ("%b", F.col("p_brand"))):
            out = F.replace(out, F.lit(mark), value)
        return out

    return p.select(F.col("p_partkey").alias("id"), *[fill(v).alias(k) for k, v in shapes.items()])


def filled_sql(**shapes: list[str]) -> str:
    initcap = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    fill = lambda v: f"replace(replace(replace(replace([{', '.join(map(_quote, v))}][p_partkey % {len(v)} + 1], '%n', p_name), '%N', {initcap}), '%k', p_partkey::VARCHAR), '%b', p_brand)"
    return "SELECT p_partkey AS id, " + ", ".join(f"{fill(v)} AS {k}" for k, v in shapes.items()) + " FROM part"


def _first(pairs: list[tuple[str, str]]) -> list[str]:
    return [a for a, _ in pairs]


def _second(pairs: list[tuple[str, str]]) -> list[str]:
    return [b for _, b in pairs]


def usable_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = filled(spark, sf_dir, raw=TITLES).withColumn("title", R.clean_title(F.col("raw")))
    return t.select("id", "title", R.usable_title(F.col("title")).alias("usable"))


def nontranslatable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = filled(spark, sf_dir, text=NOTHING)
    return t.select("id", "text", R.nontranslatable(F.col("text")).alias("untranslated"), R.name_list(F.col("text")).alias("names"))


def residual_clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = filled(spark, sf_dir, source=_first(PAIRS), translated=_second(PAIRS))
    return t.select("id", F.concat_ws(" | ", R.residual_clauses(F.col("translated"), F.col("source"))).alias("clauses"))


def translation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = filled(spark, sf_dir, source=_first(PAIRS), translated=_second(PAIRS))
    issue = R.translation_issue(F.col("source"), F.col("source"), F.col("translated"), F.col("id") % 5 != 0)
    return t.select("id", F.coalesce(issue, F.lit("none")).alias("issue"), R.markers_nest(F.col("translated")).alias("nested"))


def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = filled(spark, sf_dir, text=_first(LINES), font=_second(LINES))
    text, font = F.col("text"), F.col("font")
    return t.select("id", R.math_line(text, font).alias("math"), R.function_definition(text, font).alias("definition"), F.coalesce(R.caption_kind(text), F.lit("none")).alias("kind"), R.body_rescue(text, font, F.lit(True)).alias("body"))


def spacing_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = filled(spark, sf_dir, text=SPACED)
    return t.select("id", R.spacing(F.col("text"), F.col("id") % 4 != 0).alias("text"))


def replies_unfenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = filled(spark, sf_dir, reply=REPLIES)
    formulas = F.create_map(F.lit("__MATH_0001__"), F.concat(F.lit("x_"), F.col("id").cast("string")))
    return t.select("id", R.unfenced(F.col("reply")).alias("body"), R.readable(F.col("reply"), formulas).alias("plain"))


def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = filled(spark, sf_dir, a=_first(BROKEN), b=_second(BROKEN))
    return t.select("id", R.join_lines(F.col("a"), F.col("b")).alias("text"))


def citations_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = filled(spark, sf_dir, text=_first(CITED)).withColumn("m", spans.mask_citations("text"))
    return t.select("id", F.col("m.masked").alias("masked"), (spans.restore(F.col("m.masked"), F.col("m.tokens"), F.col("m.cited")) == F.col("text")).alias("restored"))


def section_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a bibliography: on from its heading until a bold heading of another section."""
    from pyspark.sql.window import Window

    t = filled(spark, sf_dir, text=_SECTIONS).select((F.col("id") / 37).cast("int").alias("doc"), ((F.col("id") * 7) % 37).alias("line"), "id", "text", (F.col("id") % 3 != 0).alias("bold"))
    event = F.when(R.strip(F.col("text")).rlike(R.CAPTIONS["references"]), True).when(F.col("bold") & R.strip(F.col("text")).rlike(R.AFTER_REFERENCES), False)
    w = Window.partitionBy("doc").orderBy("line", "id").rowsBetween(Window.unboundedPreceding, 0)
    return t.select("doc", "id", F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(False)).alias("skip"))


def _found(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {_quote(pattern)}, {group})"


def _has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_quote(pattern)})"


def _sub(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {_quote(pattern)}, {_quote(by)}, 'g')"


def _strip(text: str) -> str:
    return _sub(text, r"^\s+|\s+$", "")


def _all(items: str, test: str) -> str:
    return f"(len(list_filter({items}, lambda w: NOT ({test}))) = 0)"


def _names(words: list[str]) -> str:
    return f"({', '.join(map(_quote, words))})"


def _plain_sql(text: str) -> str:
    return _sub(_sub(_sub(f"coalesce({text}, '')", R.MATH_TOKEN, " "), R.CITE_TOKEN, " "), R.STYLE_TOKEN, "")


def _name_list_sql(text: str) -> str:
    words = _found(text, R.GIVEN_NAME)
    names = f"list_filter({words}, lambda w: trim(lower(w), '.') NOT IN ('and', 'et', 'al'))"
    return f"(len({words}) >= 4 AND {_has(text, '[,;]')} AND len({names}) > 0 AND {_all(names, _has('w', '^[A-Z]'))})"


def _split_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"


def _nothing_sql(text: str) -> str:
    """One select over (id, text) that gives (id, text, untranslated)."""
    rules = [
        f"formula AND {_all(_found('bare', '[A-Za-z]{2,}'), f'lower(w) IN {_names(R.FUNCTIONS)}')}", "bare = ''", f"{_has('bare', R.SUBFIGURE)} AND {_has('rest', R.CODE_NAME)}", *[_has("rest", a) for a in R.ADDRESSES],
        f"len(short) > 0 AND {_all('short', f'w NOT IN {_names(R.SECTION_WORDS)} AND ' + _has('w', '^[A-Z]{2,8}$'))}",
        f"len(labels) > 0 AND {_all('labels', _has('w', R.LABEL) + ' OR (' + _has('w', R.PRODUCT) + ' AND ' + _has('w', '[a-z][A-Z]') + ')')}",
        _has("rest", R.QUANTITY), f"formula AND NOT {_has('rest', '[A-Za-z]{4,}')} AND NOT {_has('rest', R.COMMON)}",
        f"{_has('rest', R.MATH_LETTER)} AND {_all(_found('rest', '[A-Za-z]{2,}'), f'upper(w) = w OR w IN {_names(R.MATH_WORDS)}')}", _has(f"regexp_extract(rest, {_quote(R.NUMBERED_NAME)}, 1)", "[a-z][A-Z]"),
        f"{_has('rest', R.CJK)} AND NOT {_has('rest', '[A-Za-z]{3,}')}", f"NOT {_has(_sub('rest', R.ADDRESS, ''), '[A-Za-z]{2,}')}", *[_has("rest", a) for a in R.IDENTIFIERS], _name_list_sql("rest"),
    ]
    bare = f"SELECT *, {_has("coalesce(text, '')", R.MATH_TOKEN)} AS formula, {_strip(_plain_sql('text'))} AS bare FROM ({text})"
    rest = f"SELECT *, {_sub('bare', R.SUBFIGURE, '')} AS rest FROM ({bare})"
    split = f"SELECT *, {_split_sql(_sub('rest', R.ABBREVIATION_GAPS, ' '))} AS short, {_split_sql(_sub('rest', R.SUBFIGURE, ''))} AS labels FROM ({rest})"
    return f"SELECT *, ({' OR '.join(f'({r})' for r in rules)}) AS untranslated FROM ({split})"


def _allowed_sql(text: str) -> str:
    return _sub(_sub(_plain_sql(text), f"(?i){R.ADDRESS}", " "), R.CITED, " ")


def _clauses_sql(pairs: str) -> str:
    """(all columns of pairs, clauses) where pairs has source and translated."""
    a = f"SELECT *, {_allowed_sql('source')} AS original, {_allowed_sql('translated')} AS remaining FROM ({pairs})"
    b = f"SELECT *, list_transform({_found('original', R.REPLY_LITERAL, 1)}, lambda m: m[2:len(m) - 1]) AS literals FROM ({a})"
    c = f"SELECT *, list_reduce(list_prepend(remaining, literals), lambda t, m: replace(replace(replace(t, '\"' || m || '\"', ' '), '“' || m || '”', ' '), '`' || m || '`', ' ')) AS cleared FROM ({b})"
    word = _has("w", "^[A-Z]")
    proper = f"contains(original, p) AND len(list_filter({_split_sql('p')}, lambda w: {word})) >= 2 AND {_all(_split_sql('p'), f'{word} OR w IN {_names(R.CONNECTORS)}')}"
    return f"SELECT *, list_filter({_found('cleared', R.CLAUSE)}, lambda p: NOT ({proper})) AS clauses FROM ({c})"


def _nest_sql(text: str) -> str:
    number = f"(regexp_extract(m, {_quote(R.STYLE_TOKEN)}, 1) || ',')"
    step = f"CASE WHEN h[1] = '!' THEN h WHEN ends_with(m, '_OPEN__') THEN h || {number} WHEN ends_with(h, ',' || {number}) THEN h[1:len(h) - len({number})] ELSE '!' END"
    return f"(list_reduce(list_prepend(',', {_found(text, R.STYLE_TOKEN)}), lambda h, m: {step}) = ',')"


def _same_sql(a: str, b: str, pattern: str) -> str:
    return f"list_sort({_found(a, pattern)}) = list_sort({_found(b, pattern)})"


def _math_sql() -> str:
    words, letters, symbols = _found("text", R.LONG_WORD), f"len({_found('text', R.LETTER_OR_DIGIT)})", f"len({_found('text', f'[{R.MATH_CHARS}]')})"
    equation, in_font, n = _has("text", R.EQUATION), _has("lower(font)", "|".join(R.MATH_FONTS)), "len(text)"
    return f"""CASE WHEN {_has('text', R.PROSE_WORDS)} THEN false
      WHEN {in_font} AND ({symbols} > 0 OR {equation}) AND NOT {_has('text', R.COMMON_BY_FORMULA)} THEN true
      WHEN definition THEN true
      WHEN {_has('text', R.EXPLAINS)} AND NOT {_has('text', R.NUMBER_AT_END)} THEN false
      WHEN len({words}) >= 4 AND list_sum(list_transform({words}, lambda w: len(w))) >= greatest(12, 3 * {symbols}) THEN false
      WHEN {_has('text', R.LATEX)} AND len({_found('text', ' ')}) <= 2 THEN true
      WHEN contains(text, '{{') AND contains(text, '}}') AND {_has('text', R.OPERATORS)} AND ({n} < 40 OR {symbols} >= greatest(2, {letters} * 0.4)) THEN true
      WHEN {symbols} >= 2 AND {symbols} >= {letters} * 0.5 THEN true WHEN {in_font} THEN true
      WHEN {n} < 70 AND {symbols} >= 1 AND {letters} <= 2 * {symbols} THEN true
      WHEN {n} < 50 AND {equation} AND {letters} <= 12 THEN true
      WHEN {n} < 70 AND (contains(lower(font), 'cmr') OR contains(lower(font), 'times')) AND {equation} THEN true ELSE false END"""


_CLEAN = _sub(_sub(_sub(_sub("replace(raw, '­', '')", r"(\w)-[ \t]*\n[ \t]*(\w)", r"\1-\2"), rf"({R.CJK})\s*\n\s*({R.CJK})", r"\1\2"), r"\s+", " "), r"^ | $", "")
_KINDS = " ".join(f"WHEN {_has('text', R.CAPTIONS[k])} THEN '{k}'" for k in list(R.CAPTIONS)[:-1])
_DEFINITION = f"(contains(lower(font), 'cmr') AND {_has('text', R.DEFINITION)})"
_MATHFONT = _has("lower(font)", "|".join(R.MATH_FONTS))


def _spacing_sql() -> str:
    c = R.CJK[1:-1]
    out = _sub(_sub(_sub(_sub("text", "[​﻿]", ""), r"[^\S\n]+", " "), r" ?\n ?", "\n"), r"^\s+|\s+$", "")
    han = out
    for _ in range(2):  # without looking ahead, neighbours are met in two passes
        han = _sub(han, rf"([{c}]) +([{c}A-Za-z0-9_（(【\[])", r"\1\2")
    for _ in range(2):
        han = _sub(han, rf"([A-Za-z_）)】\]]) +([{c}])", r"\1\2")
    han = _sub(_sub(_sub(han, r" +([，。、！？；：,.!?;:）)】\]])", r"\1"), r"([（(【\[]) +", r"\1"), r"([，。、！？；：]) +", r"\1")
    return f"CASE WHEN id % 4 <> 0 THEN {han} ELSE {out} END"


_SECTIONS = ["%N text", "References", "[%k] Lee. %N", "Appendix A %n", "A. %N", "plain %n", "R e f e r e n c e s", "Limitations", "3 Results", "[%k] x"]
_PAIRS = filled_sql(source=_first(PAIRS), translated=_second(PAIRS))
_WANTED = "id % 5 <> 0 AND NOT untranslated"

QUERIES = {f.__name__: f for f in (usable_titles, nontranslatable_texts, residual_clause, translation_issues, line_classes, spacing_normalised, replies_unfenced, joined_lines, section_marks, citations_masked)}
ORACLE_SQL = {
    "usable_titles": f"""SELECT id, title, (len(title) BETWEEN 2 AND 600 AND {_has('title', R.LETTER)} AND NOT contains(title, '@') AND lower(title) NOT IN {_names(R.PLACEHOLDER_TITLES)}
  AND NOT {_has('title', R.TITLE_FILE)} AND NOT {_has('title', R.TITLE_HASH)} AND NOT {_has('title', R.TITLE_ID)} AND NOT {_has('title', R.TITLE_NOTICE)}) AS usable
FROM (SELECT id, {_CLEAN} AS title FROM ({filled_sql(raw=TITLES)}))""",
    "nontranslatable_texts": f"SELECT id, text, untranslated, {_name_list_sql('text')} AS names FROM ({_nothing_sql(filled_sql(text=NOTHING))})",
    "residual_clause": f"SELECT id, array_to_string(clauses, ' | ') AS clauses FROM ({_clauses_sql(_PAIRS)})",
    "translation_issues": f"""SELECT id, CASE WHEN {_strip('translated')} = '' THEN 'empty' WHEN NOT ({_same_sql('source', 'translated', R.MATH_TOKEN)}) THEN 'formulas'
  WHEN NOT ({_same_sql('source', 'translated', R.CITE_TOKEN)}) THEN 'citations' WHEN NOT ({_same_sql('source', 'translated', R.STYLE_TOKEN)}) OR NOT nested THEN 'styles'
  WHEN {_WANTED} AND NOT {_has('translated', R.CJK)} THEN 'language' WHEN {_WANTED} AND len(clauses) > 0 THEN 'clause' ELSE 'none' END AS issue, nested
FROM (SELECT c.*, n.untranslated, {_nest_sql('translated')} AS nested FROM ({_clauses_sql(_PAIRS)}) c JOIN ({_nothing_sql(f'SELECT id, source AS text FROM ({_PAIRS})')}) n USING (id))""",
    "line_classes": f"""SELECT id, math, definition, kind, (NOT (definition OR ({_MATHFONT} AND math)) AND len(text) >= 40 AND NOT {_has('text', R.CAPTIONS['algorithm'])} AND NOT {_has('text', R.ALGORITHM_LABEL)}
  AND len({_found('text', R.WORD)}) >= 5 AND len({_found('text', ' ')}) >= 4) AS body
FROM (SELECT *, {_math_sql()} AS math, CASE {_KINDS} WHEN len(text) < 60 AND {_has('text', R.CAPTIONS['reference_mark'])} THEN 'reference_mark' ELSE 'none' END AS kind
  FROM (SELECT *, {_DEFINITION} AS definition FROM ({filled_sql(text=_first(LINES), font=_second(LINES))})))""",
    "spacing_normalised": f"SELECT id, {_spacing_sql()} AS text FROM ({filled_sql(text=SPACED)})",
    "replies_unfenced": f"SELECT id, {_sub(_strip('reply'), R.FENCE, '')} AS body, {_sub("replace(reply, '__MATH_0001__', 'x_' || id)", R.STYLE_TOKEN, '')} AS plain FROM ({filled_sql(reply=REPLIES)})",
    "joined_lines": f"""SELECT id, CASE WHEN {_has('a', R.BREAK_END)} AND {_has('ltrim(b)', R.BREAK_START)}
  THEN {_sub('a', R.BREAK_END, r'\1\2')} || ltrim(b) ELSE a || ' ' || b END AS text FROM ({filled_sql(a=_first(BROKEN), b=_second(BROKEN))})""",
    "citations_masked": f"SELECT id, masked, true AS restored FROM ({filled_sql(masked=_second(CITED))})",
    "section_marks": f"""WITH t AS (SELECT id // 37 AS doc, id * 7 % 37 AS line, id, {_strip('text')} AS text, id % 3 <> 0 AS bold FROM ({filled_sql(text=_SECTIONS)})),
e AS (SELECT *, CASE WHEN {_has('text', R.CAPTIONS['references'])} THEN true WHEN bold AND {_has('text', R.AFTER_REFERENCES)} THEN false END AS event FROM t)
SELECT doc::INTEGER AS doc, id, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line, id ROWS UNBOUNDED PRECEDING), false) AS skip FROM e""",
}
