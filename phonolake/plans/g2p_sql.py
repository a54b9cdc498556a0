"""The grapheme-to-phoneme rules said in SQL: each step looks at a letter and at what stands before and after it."""

from __future__ import annotations

from ..functions import g2p
from ..functions.exprs import WORD
from .adapters import sql_list

_V, _C, _FRONT, _ROUND, _VOICELESS = g2p._V, g2p._C, g2p._FRONT, g2p._ROUND, g2p._VOICELESS
_STOPS = "tdkɡpbfcɟTKPQ"
WORDS_SQL = "regexp_extract_all(text, '" + WORD.replace("'", "''") + "')"


def _each(cases: list[tuple[str, str, str, str, str]]) -> str:
    """x with letters replaced: (letter, what must end before it, what must begin after it, other condition, by)."""
    when = []
    for letter, before, after, other, by in cases:
        c = [f"x[i] = '{letter}'"]
        c += [f"regexp_matches(x[1:i - 1], '(?:{before})$')"] if before else []
        c += [f"regexp_matches(x[i + 1:], '^(?:{after})')"] if after else []
        c += [other] if other else []
        when.append(f"WHEN {' AND '.join(c)} THEN '{by}'")
    return f"array_to_string(list_transform(range(1, length(x) + 1), lambda i: CASE {' '.join(when)} ELSE x[i] END), '')"


def _one_of(values: str) -> str:
    return sql_list(values)


_DOT = (
    f"regexp_matches(x[1:i - 1], '[{_V}]') AND (x[i] IN {_one_of(_V)} AND x[i - 1] IN {_one_of(_V)} "
    f"OR x[i] IN {_one_of(_C)} AND x[i + 1] IN {_one_of(_V)} AND NOT (x[i] = 'ɾ' AND x[i - 1] IN {_one_of(_STOPS)}) "
    f"OR x[i] IN {_one_of(_STOPS)} AND x[i + 1] = 'ɾ' AND x[i + 2] IN {_one_of(_V)})"
)
_DOTTED = f"array_to_string(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i > 1 AND {_DOT} THEN '.' ELSE '' END || x[i]), '')"
_NEAR = f"[{_C}]*"


def _palatal(plain: str, palatal: str) -> list[str]:
    return [
        _each([(plain, "", f"[{_C}]*[{_FRONT}]", "", palatal)]),
        _each([(plain, f"[{_FRONT}]{_NEAR}", "\\.?[lɫɾ]|$", "x[i - 1] <> 'n'", palatal)]),
    ]


_PROPER = "upper(word[1]) = word[1] AND lower(word[1]) <> word[1]"
_SOFT_G = [
    f"CASE WHEN {_PROPER} THEN {_each([('ğ', f'[{_C}]', '', '', 'ɡ')])} ELSE x END",
    f"regexp_replace(x, '^([{_C}]*)ğ+', '\\1')",
    _each([("ğ", f"[{_FRONT}]{_NEAR}", f"[{_FRONT}]", "", "j")]),
    _each([("ğ", "", f"[{_V}]", "", "")]),
    _each([("ğ", f"e{_NEAR}", "", "", "j")]),
    *[f"regexp_replace(x, '{short}([{_C}]*)ğ', '{long}\\1', 'g')" for short, long in zip("aiɯoœuy", "AIƜOŒUY", strict=True)],
    "replace(x, 'ğ', '')",
]
_CLOSED, _THIN, _FIRST = (sql_list(x) for x in (g2p.CLOSED_E, g2p.THIN_L, g2p.FIRST_STRESSED))
#: The steps by name, each a chain of expressions over x.
STEPS: list[tuple[str, list[str]]] = [
    ("soft_g", [*_SOFT_G, _DOTTED]),
    ("palatalization", [*_palatal("k", "c"), *_palatal("ɡ", "ɟ")]),
    (
        "l_allophony",
        [
            f"CASE WHEN (low IN {_THIN} OR kind = 'thin_l') THEN translate(x, 'ɫ', 'l') ELSE translate(x, 'l', 'ɫ') END",
            f"CASE WHEN (low IN {_THIN} OR kind = 'thin_l') THEN x ELSE {_each([('ɫ', '', f'[{_C}.]*[{_FRONT}]', '', 'l')])} END",
            f"CASE WHEN (low IN {_THIN} OR kind = 'thin_l') THEN x ELSE {_each([('ɫ', f'[{_FRONT}][{_C}.]*', '', '', 'l')])} END",
        ],
    ),
    (
        "v_allophony",
        [
            _each([("v", f"[{_ROUND}]\\.?", f"\\.?[{_V}]", "", "W"), ("v", f"[{_V}]\\.?", f"\\.?[{_ROUND}]", "", "W")]),
            _each([("v", f"[{_ROUND}]\\.?", "", "", "β"), ("v", "", f"\\.?[{_ROUND}]", "", "β")]),
        ],
    ),
    ("n_assimilation", [_each([("n", "", "\\.?[kɡ]", "", "ŋ")]), _each([("n", "", "\\.?[cɟCJ]", "", "ɲ")])]),
    ("e_open", [f"CASE WHEN low IN {_CLOSED} OR kind = 'no_e_open' THEN x ELSE {_each([('e', '', f'[lɫmnɾŋɲ][{_C}]*(?:[.]|$)', chr(120) + '[i + 1:i + 2] <> ' + repr('ɾɾ'), 'æ')])} END"]),
    ("final_mez", [f"CASE WHEN regexp_matches(low, 'm[ea]z$') AND low NOT IN {_CLOSED} AND kind <> 'no_e_open' AND ends_with(x, 'mez') THEN x[1:length(x) - 2] || 'æz' ELSE x END"]),
    ("aspiration", [f"CASE WHEN regexp_matches(x, '[{_V}]') THEN {_each([(p, '', f'[{_C}]*[{_V}]', '', q) for p, q in zip('ptkc', 'PTKQ', strict=True)])} ELSE translate(x, 'ptkc', 'PTKQ') END"]),
    ("r_devoicing", [_each([("ɾ", "", f"$|\\.?[{_VOICELESS}]", "", "R")])]),
    ("stress", [f"CASE WHEN NOT contains(x, '.') THEN x WHEN low IN {_FIRST} OR kind IN ('stress', 'thin_l') THEN 'ˈ' || x ELSE regexp_replace(x, '\\.([^.]*)$', '.ˈ\\1') END"]),
]

_LETTERS = "list_extract([" + ", ".join(f"'{x}'" for x in g2p.PHONES) + "], list_position([" + ", ".join(f"'{x}'" for x in g2p.LETTERS) + "], c))"
_NAMES = "list_extract([" + ", ".join(f"'{x}'" for x in g2p.LETTER_NAMES.values()) + "], list_position([" + ", ".join(f"'{x}'" for x in g2p.LETTER_NAMES) + "], c))"


def _letters(table: str) -> str:
    return f"coalesce(array_to_string(list_filter(list_transform(regexp_split_to_array(low, ''), lambda c: {table}), lambda p: p IS NOT NULL), ''), '')"


def chain(words: str, lexicon: str | None = None) -> str:
    """CTEs up to `said` (word, source, kind, coded) and one table a step, from a table expression of distinct words.

    lexicon: a table expression of (word, kind) whose words keep their letters' phones, looked up as written, then in lower case.
    """
    seed = _letters(f"CASE WHEN c = 'x' THEN 'ks' ELSE {_LETTERS} END")
    capital = "length(regexp_replace(word, '[^\\p{L}]', '', 'g')) > 1 AND NOT contains(word, 'ß') AND upper(regexp_replace(word, '[^\\p{L}]', '', 'g')) = regexp_replace(word, '[^\\p{L}]', '', 'g')"
    low = "lower(translate(w.word, 'Iİ', 'ıi'))"
    found = f"SELECT w.word, {low} AS low, coalesce(a.kind, b.kind) AS entry FROM {words} w LEFT JOIN lex a ON a.word = w.word LEFT JOIN lex b ON b.word = {low}"
    out = [f"lex AS MATERIALIZED (SELECT * FROM {lexicon})"] if lexicon else []
    out += [
        f"w0 AS MATERIALIZED ({found if lexicon else f'SELECT word, {low} AS low, NULL::VARCHAR AS entry FROM {words} w'})",
        f"s0 AS MATERIALIZED (SELECT word, low, coalesce(entry, '') AS kind, CASE WHEN entry IS NOT NULL THEN 'exception' WHEN {capital} THEN 'acronym' ELSE 'rules' END AS source, CASE WHEN entry IS NULL AND {capital} THEN {_letters(_NAMES)} ELSE {seed} END AS x FROM w0)",
    ]
    for k, (_, exprs) in enumerate(STEPS, 1):
        before = f"s{k - 1}"
        for j, e in enumerate(exprs):
            name = f"s{k}" if j == len(exprs) - 1 else f"s{k}_{j}"
            out.append(f"{name} AS MATERIALIZED (SELECT word, low, kind, source, {e} AS x FROM {before})")
            before = name
    out.append(f"said AS (SELECT word, source, kind, x AS coded FROM s{len(STEPS)})")
    return ",\n".join(out)


def spelled(coded: str) -> str:
    for code, ipa in g2p.CODES.items():
        coded = f"replace({coded}, '{code}', '{ipa}')"
    return f"'/' || {coded} || '/'"


def phones(coded: str) -> str:
    """List of phones of coded ones."""
    codes, ipa = list(g2p.CODES), list(g2p.CODES.values())
    return f"list_transform(list_filter(regexp_split_to_array(replace({coded}, '.', ''), ''), lambda c: c <> ''), lambda c: coalesce(list_extract({ipa}, list_position({codes}, c)), c))"
