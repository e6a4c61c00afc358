"""SQL spellings of the text rules, used only inside the check statements."""

from __future__ import annotations

from partwright.functions import text as tx

WORD = "[0-9A-Za-zА-Яа-яЁё_]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def normalize_grade(x: str) -> str:
    return f"upper(regexp_replace(regexp_replace({x}, '(?i)^Сталь\\s+', ''), '\\s+', '', 'g'))"


def number(x: str) -> str:
    return f"nullif(regexp_extract({x}, '(?i)ГОСТ\\s*([\\d.\\-]+)', 1), '')"


def mention(x: str) -> str:
    return f"nullif(regexp_extract({x}, '(?i)ГОСТ\\s*([\\d.\\-]+)', 0), '')"


def grade_part(x: str) -> str:
    return strip(f"CASE WHEN instr(upper({x}), 'ГОСТ') > 0 THEN left({x}, instr(upper({x}), 'ГОСТ') - 1) ELSE {x} END")


def grade_key(x: str) -> str:
    return normalize_grade(grade_part(x))


def profile_diameter(x: str) -> str:
    got = f"regexp_extract({strip(x)}, '(?i)^(?:Круг|Пруток|Труба)\\s+(\\d+(?:[.,]\\d+)?)', 1)"
    return f"CAST(replace(nullif({got}, ''), ',', '.') AS DOUBLE)"


def blank_diameter(x: str) -> str:
    got = f"regexp_extract({x}, '(?i)[ØO]\\s*(\\d+(?:[.,]\\d+)?)', 1)"
    return f"coalesce(CAST(replace(nullif({got}, ''), ',', '.') AS DOUBLE), {profile_diameter(x)})"


def scale(x: str) -> str:
    return f"regexp_replace(regexp_replace(upper({strip(x)}), '^[МM]\\s*', ''), '\\s+', '', 'g')"


def filled(x: str) -> str:
    marks = ", ".join(f"'{m}'" for m in tx.EMPTY_FIELD_MARKERS)
    return f"coalesce({strip(x)} <> '' AND lower({strip(x)}) NOT IN ({marks}), FALSE)"


def standard_reference(x: str) -> str:
    return f"regexp_matches({x}, '(?i)(ГОСТ|ТУ|ОСТ|СТО)\\s*[\\dР]')"


def category(x: str) -> str:
    whens = []
    for code, pattern in tx.REQUIREMENT_CATEGORIES:
        p = pattern.replace("\\w", WORD)
        while "\\b" in p:  # RE2 word boundaries are ASCII: spell them out, first of a pair opens
            p = p.replace("\\b", "(?:^|[^0-9A-Za-zА-Яа-яЁё_])", 1).replace("\\b", "(?:$|[^0-9A-Za-zА-Яа-яЁё_])", 1)
        whens.append(f"WHEN regexp_matches({x}, '(?i){p}') THEN '{code}'")
    return "CASE " + " ".join(whens) + " END"


def stem(x: str) -> str:
    whens = " ".join(
        f"WHEN ends_with({x}, '{s}') AND length({x}) - {len(s)} >= {tx.RU_STEM_MIN_LENGTH}"
        f" THEN left({x}, length({x}) - {len(s)})" for s in tx.RU_SUFFIXES
    )
    return f"CASE {whens} ELSE {x} END"


def keywords(x: str) -> str:
    stops = ", ".join(f"'{s}'" for s in tx.STOPWORDS)
    return (
        f"list_transform(list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_\\-]+'),"
        f" lambda t: length(t) >= {tx.MIN_KEYWORD_LENGTH} AND t NOT IN ({stops})), lambda t: {stem('t')})"
    )


def g(x: str) -> str:
    """Shortest text of a double without a trailing ``.0``."""
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"
