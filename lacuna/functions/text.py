"""Text forms, splitters, grams and other text functions, as Column expressions.

Positions and lengths count code points. Functions that need a value several times bind it with `let`, because a
lambda evaluates what it refers to for each element.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.config import HAN, Profile

# The code point ranges that count as ideographs.
IDEOGRAPHS = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}"

# Variant characters and what they fold to, after conversion to traditional forms.
VARIANTS = {
    "羣": "群", "峯": "峰", "牀": "床", "眞": "真", "靑": "青", "淸": "清", "敎": "教", "竝": "並", "溫": "温", "爲": "為",
    "遙": "遥", "臥": "卧", "却": "卻", "祕": "秘", "疎": "疏", "菸": "煙", "菴": "庵", "牕": "窗", "囘": "回", "廼": "乃",
    "冩": "寫", "揷": "插", "硏": "研", "覩": "睹", "喫": "吃",
}

# The sexagenary cycle, what may follow a date, and words that mark an inscription.
STEMS, BRANCHES, DATE_TAIL = "甲乙丙丁戊己庚辛壬癸", "子丑寅卯辰巳午未申酉戌亥", "年月日春夏秋冬"
MARKERS = (
    "書", "寫", "題", "錄", "録", "臨", "作", "撰", "並書", "敬書", "謹書", "節錄", "節録", "印",
    "鈐", "篆", "刻", "先生", "女士", "雅正", "清賞", "惠存", "正之", "指正", "詩", "詞", "句", "聯",
)
INSCRIPTION = 2

# A seed of pairs for script conversion; a full table is a parameter of match_form.
SIMPLIFIED = {"书": "書", "诗": "詩", "词": "詞", "风": "風", "云": "雲", "长": "長", "门": "門", "马": "馬", "鸟": "鳥", "鸥": "鷗", "飘": "飄", "独": "獨", "万": "萬", "东": "東", "汉": "漢", "国": "國", "见": "見", "来": "來", "时": "時", "应": "應", "岁": "歲", "龙": "龍", "无": "無", "与": "與", "为": "為"}

_CYCLE = f"[{STEMS}][{BRANCHES}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _composed() -> dict[str, str]:
    """Single ideographs that NFC replaces by another single character."""
    out = {}
    for block in (range(0xF900, 0xFB00), range(0x2F800, 0x2FA20)):
        for point in block:
            new = unicodedata.normalize("NFC", chr(point))
            if len(new) == 1 and new != chr(point):
                out[chr(point)] = new
    return out


def replaced(text: Column, table: dict[str, str]) -> Column:
    return F.translate(text, "".join(table), "".join(table.values()))


def display_form(text: Column) -> Column:
    """NFC for ideographs; other scripts are composed by `nfc`."""
    return replaced(text, _composed())


def nfc(text: Column) -> Column:
    """NFC of any script, by batches in Python: the full form of display_form."""
    def composed(values: pd.Series) -> pd.Series:
        return values.map(lambda x: unicodedata.normalize("NFC", x) if x is not None else None)

    return F.pandas_udf(composed, "string")(text)


def traditional(text: Column, table: dict[str, str] = SIMPLIFIED) -> Column:
    return replaced(display_form(text), table)


def simplified(text: Column, table: dict[str, str] = SIMPLIFIED) -> Column:
    return replaced(display_form(text), {v: k for k, v in table.items()})


def match_form(text: Column, profile: Profile = HAN, table: dict[str, str] = SIMPLIFIED) -> Column:
    """What texts are compared by: letters only, folded. The same for corpus and query."""
    if profile.name == "han":
        return _folded(profile.script.converted(display_form(text)) if profile.script else traditional(text, table))
    return F.lower(F.regexp_replace(text, r"[^\p{L}]", ""))


def _folded(text: Column) -> Column:
    return display_form(replaced(F.regexp_replace(text, f"[^{IDEOGRAPHS}]", ""), VARIANTS))


def match_forms(texts: Column, profile: Profile = HAN) -> Column:
    """match_form of each text of an array. Conversion by phrases takes the whole array, as no lambda can hold it."""
    if profile.name == "han" and profile.script:
        return F.transform(profile.script.all_converted(F.transform(texts, display_form)), _folded)
    return F.transform(texts, lambda x: match_form(x, profile))


def match_to_display(text: Column, profile: Profile = HAN) -> Column:
    """For each character of the match form, its place in the display form, whatever lengths a conversion changes."""
    def kept(characters: Column, place: Callable[[Column], Column]) -> Column:
        return F.filter(F.transform(characters, lambda c, i: F.when(c.rlike(f"^[{IDEOGRAPHS}]$"), place(i))), lambda i: i.isNotNull())

    if profile.script:
        return let(profile.script.placed(display_form(text)), lambda made: kept(F.split(made["text"], ""), lambda i: F.get(made["places"], i)))
    return kept(F.split(display_form(text), ""), lambda i: i)


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), lambda x: F.trim(x)), lambda x: x != "")


def visual_lines(text: Column) -> Column:
    """What white space parts, the ideographic space included."""
    return _parts(text, r"[\s\x{3000}\x{00A0}]+")


def prosody_lines(text: Column, profile: Profile = HAN) -> Column:
    """Visual lines, parted at clause punctuation."""
    clause = r"[，。！？；、：,.!?;:]+" if profile.name == "han" else r"[.!?;:,]+"
    return F.flatten(F.transform(visual_lines(text), lambda line: _parts(line, clause)))


def corpus_lines(text: Column, profile: Profile = HAN) -> Column:
    """The clauses of a paragraph as a corpus stores them."""
    return _parts(text, profile.clause)


def answer_lines(text: Column) -> Column:
    """The clauses of an answer: punctuation and line ends."""
    return _parts(text, r"[，。！？；\n]")


def windows(text: Column, profile: Profile) -> Column:
    """Distinct windows, longest first and then by place: at most max_windows of them."""
    n = F.length(text)
    longest = F.least(n, F.lit(profile.max_window))

    def of_length(size: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), n - size + 1), lambda at: F.substring(text, at, size))

    every = F.flatten(F.transform(F.sequence(longest, F.lit(profile.min_window), F.lit(-1)), of_length))
    return F.when(n >= profile.min_window, F.slice(F.array_distinct(every), 1, profile.max_windows)).otherwise(F.array().cast("array<string>"))


def grams(text: Column, size: int) -> Column:
    """Every gram of a text in order, with repeats."""
    def built(chars: Column) -> Column:
        n = F.size(chars) - (size - 1)
        out = F.slice(chars, F.lit(1), F.greatest(n, F.lit(0)))
        for k in range(1, size):
            out = F.zip_with(out, F.slice(chars, F.lit(k + 1), F.greatest(n, F.lit(0))), lambda a, b: F.concat(a, b))
        return out

    return let(F.split(text, ""), built)


def bigrams(text: Column) -> Column:
    return grams(text, 2)


def query_terms(text: Column, most: int | None = 24) -> Column:
    """The first distinct bigrams, or all of them."""
    distinct = F.array_distinct(bigrams(text))
    return distinct if most is None else F.slice(distinct, 1, most)


def lexical_overlap(query: Column, candidate: Column) -> Column:
    """Share of the query's distinct characters that the candidate has; null for an empty query."""
    own = F.array_distinct(F.split(query, ""))
    return F.when(F.length(query) > 0, F.size(F.array_intersect(own, F.split(candidate, ""))) / F.size(own))


def cjk_ratio(value: Column) -> Column:
    dense = F.regexp_replace(value, r"[\s\p{P}\p{S}]", "")
    return F.when(F.length(dense) > 0, F.regexp_count(dense, F.lit(r"\p{IsHan}")) / F.length(dense)).otherwise(F.lit(0.0))


def han_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\p{IsHan}"))


def cell_text(value: Column) -> Column:
    """A VARIANT cell as text: strings trimmed, numbers and booleans written out, anything else empty."""
    kind = F.schema_of_variant(value)
    plain = ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & (kind != "VOID")
    return F.coalesce(F.when(plain, F.trim(F.try_variant_get(value, "$", "string"))), F.lit(""))


def has_cyclical_date(text: Column) -> Column:
    return text.rlike(_CYCLE)


def cyclical_date(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, f"{_CYCLE}[{DATE_TAIL}]*", 0), F.lit(""))


def inscription_score(line: Column) -> Column:
    """How much a line looks like a signature rather than verse."""
    def scored(m: Column) -> Column:
        total = F.when(has_cyclical_date(m), 3).otherwise(0)
        for marker in MARKERS:
            total = total + F.contains(m, F.lit(marker)).cast("int")
        return F.when(F.length(m) == 0, 0).otherwise(total + (F.length(m) <= 3).cast("int") + (F.length(m) > 12).cast("int"))

    return let(match_form(line), scored)


def split_inscription(text: Column) -> Column:
    """struct(body, inscription, cyclical_date, title): verse lines, and the lines around them that aren't verse."""
    def parted(rows: Column) -> Column:
        n = F.size(rows)
        signed = F.transform(rows, lambda r: r["score"] >= INSCRIPTION)
        last_verse = F.array_max(F.transform(rows, lambda r, i: F.when(r["score"] < INSCRIPTION, i + 1)))
        end = F.coalesce(last_verse, F.lit(0))
        first_undated = F.array_min(F.transform(rows, lambda r, i: F.when(~r["dated"], i)))
        dated = F.least(F.coalesce(first_undated, end), end)
        extra = ((end - dated) > 2) & F.coalesce(F.get(signed, dated), F.lit(False))
        start = dated + extra.cast("int")
        lines = F.transform(rows, lambda r: r["line"])

        def found(bounds: Column) -> Column:
            s, e = bounds["s"], bounds["e"]
            body = F.filter(lines, lambda x, i: (i >= s) & (i < e))
            rest = F.filter(lines, lambda x, i: (i < s) | (i >= e))
            date = cyclical_date(match_form(F.array_join(rest, " ")))
            return F.struct(body.alias("body"), rest.alias("inscription"), date.alias("cyclical_date"), F.when((s > 0) & (e > 0), F.get(lines, F.lit(0))).alias("title"))

        return F.when(n >= 0, let(F.struct(F.when(end > 0, start).otherwise(F.lit(0)).alias("s"), end.alias("e")), found))

    each = F.transform(visual_lines(text), lambda line: F.struct(line.alias("line"), inscription_score(line).alias("score"), has_cyclical_date(match_form(line)).alias("dated")))
    return let(each, parted)


def embed_text(title: Column, author: Column, text: Column) -> Column:
    return F.concat_ws("\n", *[F.nullif(x, F.lit("")) for x in (title, author, text)])


def matched_text(content: Column, start: Column, end: Column) -> Column:
    """The span of a content, or all of it where there is no span or nothing in it."""
    part = F.substring(content, start + 1, end - start)
    return F.when(start.isNull() | end.isNull() | (F.length(part) == 0), content).otherwise(part)


def stripped(html: Column) -> Column:
    """Text of an HTML fragment: no tags, two entities, single spaces."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ""), "&nbsp;", " "), "&amp;", "&")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def substituted(requested: Column, served: Column) -> Column:
    """Whether a served model is not the requested one: neither name starts with the other, letters and digits alone."""
    a, b = (F.lower(F.regexp_replace(x, "[^A-Za-z0-9]", "")) for x in (requested, served))
    return F.coalesce(~(F.startswith(a, b) | F.startswith(b, a)), F.lit(False))


def highlighted(text: Column, matches: Column, open_: str = "[", close: str = "]") -> Column:
    """text with each match marked, the longest first; what is marked already is left alone."""
    order = F.array_sort(F.filter(F.array_distinct(matches), lambda m: m != ""), lambda a, b: F.length(b) - F.length(a))
    parts = F.aggregate(
        order,
        F.array(F.struct(text.alias("t"), F.lit(False).alias("hit"))),
        lambda acc, m: F.flatten(
            F.transform(
                acc,
                lambda p: F.when(p["hit"] | ~F.contains(p["t"], m), F.array(F.struct(p["t"].alias("t"), p["hit"].alias("hit")))).otherwise(
                    let(
                        F.instr(p["t"], m),
                        lambda at: F.array(
                            F.struct(F.substring(p["t"], F.lit(1), at - 1).alias("t"), F.lit(False).alias("hit")),
                            F.struct(m.alias("t"), F.lit(True).alias("hit")),
                            F.struct(F.substring(p["t"], at + F.length(m), F.length(p["t"])).alias("t"), F.lit(False).alias("hit")),
                        ),
                    )
                ),
            )
        ),
    )
    return F.array_join(F.transform(parts, lambda p: F.when(p["hit"], F.concat(F.lit(open_), p["t"], F.lit(close))).otherwise(p["t"])), "")
