"""DuckDB SQL of the typed tokens and of the English stemmer, step by step over a table of distinct tokens."""

from __future__ import annotations

from ..functions import stemmer
from ..functions.tokens import SHAPES

_PATTERNS = {k: p.replace("{1,20}", "+").replace("{1,100}", "+").replace("{2,20}", "{2,}").replace("'", "''") for k, p in SHAPES.items()}
_ALL = "|".join(_PATTERNS.values())


def _is(*shapes: str) -> str:
    return f"regexp_full_match(token, '{'|'.join(shapes)}')"


def _word_type(token: str, ascii_: int, letters: int, mixed: int) -> str:
    return f"CASE WHEN regexp_full_match({token}, '[A-Za-z]+') THEN {ascii_} WHEN regexp_full_match({token}, '\\p{{L}}+') THEN {letters} ELSE {mixed} END"


def s_typed(out: str, source: str, keys: str, text: str) -> str:
    """CTE out(keys, nth, type, token): the tokens of a text column of source, with the parts of compounds and urls; nth is the place of what a token came from."""
    k = "".join(f"{x}, " for x in keys.split())
    number = f"CASE WHEN {_is(_PATTERNS['int'])} THEN 21 WHEN {_is(_PATTERNS['version'])} THEN 8 WHEN contains(lower(token), 'e') THEN 7 ELSE 20 END"
    kind = (
        f"CASE WHEN {_is('[0-9]+')} THEN 22 WHEN {_is(_PATTERNS['word'])} THEN {_word_type('token', 1, 2, 3)} WHEN starts_with(token, '<') THEN 13 WHEN starts_with(token, '&') THEN 23 WHEN {_is(_PATTERNS['email'])} THEN 4 "
        f"WHEN {_is(_PATTERNS['protocol'])} THEN 14 WHEN {_is(_PATTERNS['host'])} THEN (CASE WHEN contains(token, '/') THEN 5 ELSE 6 END) "
        f"WHEN {_is(_PATTERNS['compound'])} THEN (CASE WHEN {_is('[A-Za-z-]+')} THEN 16 WHEN regexp_full_match(token, '[\\p{{L}}-]+') THEN 17 ELSE 15 END) ELSE {number} END"
    )
    return (
        f"{out}_l AS (SELECT {k}regexp_extract_all({text}, '{_ALL}', 0) AS found FROM {source} WHERE {text} IS NOT NULL), "
        f"{out}_w AS (SELECT {k}unnest(found) AS token, unnest(range(len(found))) AS nth FROM {out}_l), {out}_d AS (SELECT token, {kind} AS type FROM (SELECT DISTINCT token FROM {out}_w)), "
        f"{out}_e AS (SELECT token AS whole, type, token FROM {out}_d UNION ALL SELECT token, {_word_type('p', 11, 2, 3).replace('THEN 2 ELSE 3', 'THEN 10 ELSE 9')}, p FROM (SELECT token, unnest(string_split(token, '-')) AS p FROM {out}_d WHERE type BETWEEN 15 AND 17) "
        f"UNION ALL SELECT token, 6, split_part(token, '/', 1) FROM {out}_d WHERE type = 5 UNION ALL SELECT token, 18, substr(token, instr(token, '/')) FROM {out}_d WHERE type = 5), "
        f"{out} AS (SELECT {k}nth, type, e.token FROM {out}_w w JOIN {out}_e e ON w.token = e.whole)"
    )


def _ends(rules: list[tuple[str, str]]) -> str:
    """The first rule whose ending the word has decides; it is applied if the ending lies in the region that it asks for."""
    out = []
    for end, new in rules:
        n = len(end)
        able = f"length(w) - {n} >= r1"
        if end == "ogi":
            able += f" AND substr(w, length(w) - {n}, 1) = 'l'"
        if end == "li":
            able += f" AND length(w) > {n} AND contains('cdeghkmnrt', substr(w, length(w) - {n}, 1))"
        if end == "ative":
            able += f" AND length(w) - {n} >= r2"
        out.append(f"WHEN ends_with(w, '{end}') THEN CASE WHEN {able} THEN substr(w, 1, length(w) - {n}) || '{new}' ELSE w END")
    return "CASE " + " ".join(out) + " ELSE w END"


_SHORT = "regexp_matches({0}, '(?s)(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$')"
_R1 = "CASE WHEN regexp_matches({0}, '^(gener|commun|arsen)') THEN length(regexp_extract({0}, '^(gener|commun|arsen)')) WHEN regexp_matches({0}, '(?s)[aeiouy][^aeiouy]') THEN length(regexp_extract({0}, '(?s)^.*?[aeiouy][^aeiouy]')) ELSE length({0}) END"


def s_stems(out: str, tokens: str) -> str:
    """CTEs that end in out(token, stem) for the distinct tokens of a table; a stop word's stem is empty."""
    stop = ", ".join(f"'{w}'" for w in sorted(stemmer.STOP_WORDS))
    known = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in stemmer._EXCEPTIONS.items())
    stays = ", ".join(f"'{w}'" for w in sorted(stemmer._STAYS))
    doubles = ", ".join(f"'{w}'" for w in sorted(stemmer._DOUBLES))
    suffix = "CASE " + " ".join(f"WHEN ends_with(w, '{e}') THEN '{e}'" for e in ("eedly", "ingly", "edly", "eed", "ing", "ed")) + " END"
    cut = "CASE " + " ".join(f"WHEN ends_with(w, '{e}') THEN CASE WHEN length(w) - {len(e)} >= r2{' AND length(w) > 3 AND substr(w, length(w) - 3, 1) IN (' + chr(39) + 's' + chr(39) + ', ' + chr(39) + 't' + chr(39) + ')' if e == 'ion' else ''} THEN substr(w, 1, length(w) - {len(e)}) ELSE w END" for e in stemmer._STEP4) + " ELSE w END"
    base = "substr(w, 1, length(w) - length(suf))"
    return (
        f"{out}_0 AS (SELECT token, lower(token) AS low FROM (SELECT DISTINCT token FROM {tokens})), "
        f"{out}_1 AS (SELECT token, CASE WHEN low IN ({stop}) THEN '' WHEN length(low) <= 2 THEN low ELSE CASE low {known} END END AS done, regexp_replace(regexp_replace(regexp_replace(low, '^''+', ''), '(^|[aeiouy])y', '\\1Y', 'g'), '(''s''|''s|'')$', '') AS w FROM {out}_0), "
        f"{out}_2 AS (SELECT token, done, CASE WHEN ends_with(w, 'sses') THEN substr(w, 1, length(w) - 2) WHEN ends_with(w, 'ied') OR ends_with(w, 'ies') THEN substr(w, 1, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END) "
        f"WHEN ends_with(w, 's') AND NOT ends_with(w, 'us') AND NOT ends_with(w, 'ss') AND regexp_matches(substr(w, 1, greatest(length(w) - 2, 0)), '[aeiouy]') THEN substr(w, 1, length(w) - 1) ELSE w END AS w FROM {out}_1), "
        f"{out}_3 AS (SELECT token, coalesce(done, CASE WHEN w IN ({stays}) THEN lower(w) END) AS done, w, {_R1.format('w')} AS r1, {suffix} AS suf FROM {out}_2), "
        f"{out}_4 AS (SELECT token, done, w, r1, suf, {base} AS b FROM {out}_3), "
        f"{out}_5 AS (SELECT token, done, CASE WHEN suf IS NULL THEN w WHEN suf IN ('eed', 'eedly') THEN CASE WHEN length(b) >= r1 THEN b || 'ee' ELSE w END WHEN NOT regexp_matches(b, '[aeiouy]') THEN w "
        f"WHEN ends_with(b, 'at') OR ends_with(b, 'bl') OR ends_with(b, 'iz') THEN b || 'e' WHEN right(b, 2) IN ({doubles}) THEN substr(b, 1, length(b) - 1) WHEN {_SHORT.format('b')} AND {_R1.format('b')} >= length(b) THEN b || 'e' ELSE b END AS w FROM {out}_4), "
        f"{out}_6 AS (SELECT token, coalesce(done, CASE WHEN w IN ({stays}) THEN w END) AS done, regexp_replace(w, '(?s)^(.+[^aeiouy])[yY]$', '\\1i') AS w FROM {out}_5), "
        f"{out}_7 AS (SELECT *, {_R1.format('w')} AS r1 FROM {out}_6), "
        f"{out}_8 AS (SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), '(?s)[aeiouy][^aeiouy]') THEN r1 + length(regexp_extract(substr(w, r1 + 1), '(?s)^.*?[aeiouy][^aeiouy]')) ELSE length(w) END AS r2 FROM {out}_7), "
        f"{out}_9 AS (SELECT token, done, r1, r2, {_ends(stemmer._STEP2)} AS w FROM {out}_8), {out}_10 AS (SELECT token, done, r1, r2, {_ends(stemmer._STEP3)} AS w FROM {out}_9), {out}_11 AS (SELECT token, done, r1, r2, {cut} AS w FROM {out}_10), "
        f"{out} AS (SELECT token, coalesce(done, lower(CASE WHEN (ends_with(w, 'e') AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT {_SHORT.format('substr(w, 1, length(w) - 1)')}))) OR (ends_with(w, 'll') AND length(w) - 1 >= r2) THEN substr(w, 1, length(w) - 1) ELSE w END)) AS stem FROM {out}_11)"
    )
