"""SQL twins of the cleaning expressions, as text for DuckDB."""

from __future__ import annotations

from tallymark.constants import (BLANK_TOKENS, NULL_TOKENS, REVIEW_WORDS, STATUS_FOLD,
                                 STATUS_ORDER)

SPACE = (r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
         r"\x{205F}\x{3000}]")
GATE = (r"(?i)^" + SPACE + r"*[-+(]?" + SPACE + r"*(?:ZAR|US\$|R|\$|€|£|¥)?" + SPACE
        + r"*[0-9][0-9\t-\r \x{A0}.,]*\)?" + SPACE + r"*%?" + SPACE + r"*$")
DATE_ISH = r"(?i)[-/.:]|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(tokens) -> str:
    return "(" + ", ".join(lit(t) for t in tokens) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def tidy(x: str) -> str:
    bare = f"regexp_replace({x}, '[\\x00-\\x1f\\x7f]', '', 'g')"
    return f"trim(regexp_replace({bare}, '{SPACE}+', ' ', 'g'))"


def clean(x: str) -> str:
    t = tidy(x)
    return f"CASE WHEN {t} NOT IN {words(NULL_TOKENS)} THEN {t} END"


def blank(x: str) -> str:
    return f"(coalesce({strip(x)}, '') IN {words(BLANK_TOKENS)})"


def amount(x: str) -> str:
    t = strip(x)
    bare = f"trim({t}, '()')"
    bare = f"regexp_replace({bare}, '(?i)\\b(zar|rand)\\b', '', 'g')"
    bare = f"regexp_replace({bare}, '[Rr \\x{{A0}}]', '', 'g')"
    bare = (f"CASE WHEN {bare} LIKE '%,%' AND {bare} NOT LIKE '%.%' "
            f"AND regexp_matches({bare}, ',\\d{{1,2}}$') THEN replace({bare}, ',', '.') "
            f"ELSE replace({bare}, ',', '') END")
    digits = f"regexp_replace({bare}, '[^0-9.\\-]', '', 'g')"
    sign = f"CASE WHEN starts_with({t}, '(') AND ends_with({t}, ')') THEN -1.0 ELSE 1.0 END"
    return f"(TRY_CAST({digits} AS DOUBLE) * ({sign}))"


def date(x: str) -> str:
    t = f"regexp_replace({strip(x)}, '[/.]', '-', 'g')"
    return (f"CASE WHEN regexp_matches({t}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') "
            f"THEN CAST(try_strptime({t}, '%Y-%m-%d') AS DATE) "
            f"WHEN regexp_matches({t}, '^\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}$') "
            f"THEN CAST(coalesce(try_strptime({t}, '%d-%m-%Y'), "
            f"try_strptime({t}, '%m-%d-%Y')) AS DATE) "
            f"WHEN regexp_matches({t}, '^\\d{{8}}$') "
            f"THEN CAST(try_strptime({t}, '%Y%m%d') AS DATE) END")


def cents(x: str) -> str:
    return f"round_even(({x}) * 100, 0) / 100"


def status_key(x: str) -> str:
    return f"regexp_replace(lower({strip(x)}), '[\\s\\-]+', '_', 'g')"


def known_status(x: str) -> str:
    k = status_key(x)
    cases = " ".join(f"WHEN {k} IN {words(w for w, to in STATUS_FOLD.items() if to == s)} "
                     f"THEN '{s}'" for s in STATUS_ORDER if s in STATUS_FOLD.values())
    return f"CASE {cases} END"


def status(x: str) -> str:
    bare = strip(f"coalesce({x}, '')")
    return (f"CASE WHEN {bare} = '' THEN 'UNASSIGNED' "
            f"ELSE coalesce({known_status(x)}, {bare}) END")


def status_rank(x: str) -> str:
    cases = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(STATUS_ORDER))
    return f"CASE {x} {cases} ELSE 99 END"


def client(x: str) -> str:
    d = f"regexp_replace(upper({x}), '{SPACE}*[-_]{SPACE}*', '-', 'g')"
    return strip(f"regexp_replace({d}, '{SPACE}+', ' ', 'g')")


def email(x: str) -> str:
    return f"lower(regexp_replace({x}, '{SPACE}+', '', 'g'))"


def phone(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9+]', '', 'g')"
    return f"regexp_replace(regexp_replace({d}, '^0', '+27'), '^27', '+27')"


def proper(x: str) -> str:
    tokens = f"regexp_extract_all(lower(regexp_replace({x}, '{SPACE}+', ' ', 'g')), '(\\pL+|[^\\pL]+)')"
    title = (f"array_to_string(list_transform({tokens}, lambda t: "
             f"upper(substr(t, 1, 1)) || substr(t, 2)), '')")
    out = f"regexp_replace({title}, '\\(Pty\\)|\\bPty\\b', '(Pty)', 'g')"
    out = f"regexp_replace({out}, '\\bCc\\b', 'CC', 'g')"
    return f"regexp_replace({out}, '\\bNpc\\b', 'NPC', 'g')"


def review(*xs: str) -> str:
    joined = "lower(concat_ws(' ', " + ", ".join(xs) + "))"
    return "(" + " OR ".join(f"contains({joined}, {lit(w)})" for w in REVIEW_WORDS) + ")"


def gate(x: str) -> str:
    return f"regexp_matches({x}, {lit(GATE)})"


def datelike(x: str) -> str:
    return f"regexp_matches({x}, {lit(DATE_ISH)})"
