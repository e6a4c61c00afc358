"""Text normalisation and classification as column expressions.

All patterns carry ``(?iuU)`` where case or letter classes matter: Java regular expressions are not
Unicode-aware by default, and the texts are Cyrillic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------------------------
STANDARD_WORD = "ГОСТ"
STANDARD_NUMBER = r"(?iu)ГОСТ(?U:\s*)((?U:[\d.\-])+)"
STEEL_PREFIX = r"(?iuU)^Сталь\s+"
ROUND_PROFILE = r"(?iuU)^(?:Круг|Пруток|Труба)\s+(\d+(?:[.,]\d+)?)"
DIAMETER_SIGN = r"(?iuU)[ØO]\s*(\d+(?:[.,]\d+)?)"
SCALE_PREFIX = r"(?U)^[МM]\s*"
STANDARD_REFERENCE = r"(?iuU)(ГОСТ|ТУ|ОСТ|СТО)\s*[\dР]"
EMPTY_FIELD_MARKERS = ["-", "–", "—", "нет", "н/д", "не указан", "не указано"]

REQUIREMENT_CATEGORIES = [
    ("material", r"материал\s*:"),
    ("chemical_thermal_treatment", r"цементаци|азотирован|борирован|нитроцементаци"),
    ("heat_treatment", r"\bHRC\b|\bHB\b|\bHV\b|закал|отпуск|термическ"),
    ("coating", r"покрыти|никелирован|цинкован|оксидирован|хромирован"),
    ("unspecified_tolerances", r"неуказанн\w*\s+(предельн|допуск|радиус)|H1[0-9]\s*,\s*h1[0-9]|±\s*IT\d+"),
    ("form_position_tolerance", r"допуск\w*\s+(форм|расположени)|общ\w*\s+допуск"),
    ("roughness", r"шероховатост|\bRa\b|\bRz\b"),
    ("process_sequence", r"обрабатывать после|выполнять до|последовательност"),
    ("inspection_testing", r"контрол\w*\s+(герметичност|качеств)|балансировк|неразрушающ|испытани"),
    ("assembly", r"момент\w*\s+затяжк|фиксатор|зазор"),
    ("operating_conditions", r"рабоч\w*\s+температур|ресурс|гарантийн"),
    ("reference_dimension", r"размер\w*\s+для\s+справок|справочн"),
    ("rounding_edges", r"радиус\w*\s+скруглени|притупить|кромк\w*\s+притупить"),
]

RU_SUFFIXES = [
    "иями", "ями", "ами", "его", "ему", "ыми", "ими", "ов", "ев", "ей", "ах", "ях", "ию", "ья", "ье", "ья",
    "ая", "яя", "ое", "ее", "ы", "и", "а", "я", "у", "ю", "е", "о", "й", "ь",
]
RU_STEM_MIN_LENGTH = 4
MIN_KEYWORD_LENGTH = 3
STOPWORDS = [
    "как", "что", "какой", "какая", "какое", "какие", "для", "при", "это", "если", "или", "его", "она", "они",
    "мне", "нам", "можно", "есть", "нет", "чем", "где", "почему", "нужно", "нужен", "нужна", "подойдет",
    "подходит", "подойдёт", "используется", "какой-то", "про", "расскажи", "скажи", "хочу", "могу", "должен",
]
# Characters that count as white space in texts.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# ---------------------------------------------------------------------------------------------


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    """Trim all white space, not only spaces."""
    return F.btrim(c, F.lit(WHITESPACE))


def without_space(c: Column) -> Column:
    return F.translate(c, WHITESPACE, "")


def normalize_grade(c: Column) -> Column:
    return F.upper(without_space(F.regexp_replace(c, STEEL_PREFIX, "")))


def standard_number(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(c, STANDARD_NUMBER, 1))


def standard_mention(c: Column) -> Column:
    """Whole mention, ``ГОСТ 2590-2006``, out of a designation."""
    return blank_to_null(F.regexp_extract(c, STANDARD_NUMBER, 0))


def grade_part(c: Column) -> Column:
    at = F.instr(F.upper(c), STANDARD_WORD)
    return strip(F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c))


def grade_key(c: Column) -> Column:
    return normalize_grade(grade_part(c))


def _decimal(c: Column) -> Column:
    return blank_to_null(F.regexp_replace(c, ",", ".")).cast("double")


def profile_diameter(c: Column) -> Column:
    return _decimal(F.regexp_extract(strip(c), ROUND_PROFILE, 1))


def blank_diameter(c: Column) -> Column:
    """A diameter sign wins over the size that follows the profile name."""
    return F.coalesce(_decimal(F.regexp_extract(c, DIAMETER_SIGN, 1)), profile_diameter(c))


def normalize_scale(c: Column) -> Column:
    return without_space(F.regexp_replace(F.upper(strip(c)), SCALE_PREFIX, ""))


def is_filled(c: Column) -> Column:
    text = strip(c)
    return c.isNotNull() & (text != "") & ~F.lower(text).isin(EMPTY_FIELD_MARKERS)


def names_standard(c: Column) -> Column:
    return c.rlike(STANDARD_REFERENCE)


def requirement_category(c: Column) -> Column:
    """First matching rule wins; null when no rule matches."""
    return F.coalesce(*[F.when(c.rlike("(?iuU)" + p), F.lit(code)) for code, p in REQUIREMENT_CATEGORIES])


def stem_ru(c: Column) -> Column:
    """Cut the first listed suffix that leaves at least four letters."""
    def cut(suffix: str) -> Column:
        keep = F.length(c) - len(suffix)
        return F.when(c.endswith(suffix) & (keep >= RU_STEM_MIN_LENGTH), F.substring(c, F.lit(1), keep))

    return F.coalesce(*[cut(s) for s in RU_SUFFIXES], c)


def keywords(c: Column) -> Column:
    """Stemmed search words of a question, stop words dropped before stemming."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)([\w\-]+)"), F.lit(1))
    kept = F.filter(tokens, lambda t: (F.length(t) >= MIN_KEYWORD_LENGTH) & ~t.isin(STOPWORDS))
    return F.transform(kept, stem_ru)


def split_values(c: Column) -> Column:
    """``';'``-joined text to an array of trimmed, non-empty values."""
    return F.filter(F.transform(F.split(c, ";"), strip), lambda v: v != "")


def layout_columns(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "columns array<string>")["columns"], F.array().cast("array<string>"))


def first_prefix(c: Column, rules: list[tuple[str, str]], fallback: str) -> Column:
    upper = F.upper(c)
    return F.coalesce(*[F.when(upper.startswith(p), F.lit(v)) for p, v in rules], F.lit(fallback))


_HIGH_BYTES = bytes(range(0x80, 0x100))
_LATIN_HIGH, _CYRILLIC_HIGH = _HIGH_BYTES.decode("iso-8859-1"), _HIGH_BYTES.decode("windows-1251", errors="replace")


def from_windows_1251(content: Column) -> Column:
    """Single-byte decode without a Python worker: bytes as Latin-1, then the upper half is translated."""
    return F.translate(F.decode(content, "iso-8859-1"), _LATIN_HIGH, _CYRILLIC_HIGH)


def to_windows_1251(text: Column) -> Column:
    return F.encode(F.translate(text, _CYRILLIC_HIGH, _LATIN_HIGH), "iso-8859-1")


def decode_step_bytes(content: Column) -> Column:
    """UTF-8 where the bytes are valid UTF-8, Windows-1251 otherwise."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(from_windows_1251(content))


def decode_step_escapes(c: Column) -> Column:
    r"""``\X2\HHHH…\X0\`` runs to characters, four hex digits each; other text is kept."""
    parts = F.split(c, r"\\X2\\")

    def piece(p: Column) -> Column:
        digits = F.regexp_extract(p, r"^((?:[0-9A-Fa-f]{4})+)\\X0\\", 1)
        rest = F.regexp_replace(p, r"^(?:[0-9A-Fa-f]{4})+\\X0\\", "")
        decoded = F.concat(F.decode(F.unhex(digits), "utf-16be"), rest)
        return F.when(digits != "", decoded).otherwise(F.concat(F.lit("\\X2\\"), p))

    tail = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), piece)
    return F.concat(F.element_at(parts, 1), F.array_join(tail, ""))


def requirement_with_standard(text: Column, standard: Column) -> Column:
    """Append the standard in brackets unless the text already names it."""
    return F.when(
        standard.isNotNull() & (standard != "") & ~text.contains(standard),
        F.concat(text, F.lit(" ("), standard, F.lit(")")),
    ).otherwise(text)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
