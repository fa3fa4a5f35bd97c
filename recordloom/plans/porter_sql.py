"""The Porter algorithm as SQL over a vocabulary, for the SQL twins of the searches.

Written from the published description with expressions over letters, independently of the column
function: consonants and vowels are told apart by patterns in which a first ``y`` is a capital.
"""

from __future__ import annotations

# The suffixes of steps 2, 3 and 4 and what takes their place.
_TWO = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_THREE = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_FOUR = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"


def _is(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _some(x: str) -> str:
    """Measure above 0."""
    return _is(x, f"^({_C})?{_V}{_C}")


def _one(x: str) -> str:
    return _is(x, f"^({_C})?{_V}{_C}({_V})?$")


def _more(x: str) -> str:
    return _is(x, f"^({_C})?{_V}{_C}{_V}{_C}")


def _vowel(x: str) -> str:
    return _is(x, f"^({_C})?[aeiouy]")


def _short(x: str) -> str:
    return _is(x, "^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]$")


def _cut(n: int) -> str:
    return f"substr(s, 1, length(s) - {n})"


def _table(rules: dict[str, str]) -> str:
    ways = (f"WHEN ends_with(s, '{a}') THEN CASE WHEN {_some(_cut(len(a)))} THEN {_cut(len(a))} || '{b}' ELSE s END" for a, b in sorted(rules.items(), key=lambda r: -len(r[0])))
    return "CASE " + " ".join(ways) + " ELSE s END"


def stems(words: str) -> str:
    """CTEs from ``words``, a query of distinct words w, to ``stem_(w, s)``."""
    four = " ".join(
        f"WHEN ends_with(s, '{a}') THEN CASE WHEN {_more(_cut(len(a)))}" + (f" AND {_is(_cut(3), '[st]$')}" if a == "ion" else "") + f" THEN {_cut(len(a))} ELSE s END" for a in sorted(_FOUR, key=len, reverse=True)
    )
    steps = [
        "CASE WHEN regexp_matches(s, '.(ss|i)es$') THEN substr(s, 1, length(s) - 2) WHEN ends_with(s, 's') AND NOT ends_with(s, 'ss') THEN substr(s, 1, length(s) - 1) ELSE s END",
        f"CASE WHEN ends_with(s, 'eed') THEN CASE WHEN {_some(_cut(3))} THEN {_cut(1)} ELSE s END WHEN ends_with(s, 'ed') AND {_vowel(_cut(2))} THEN {_cut(2)} || '+' WHEN ends_with(s, 'ing') AND {_vowel(_cut(3))} THEN {_cut(3)} || '+' ELSE s END",
        # A plus marks the words that lost their ending.
        f"""CASE WHEN NOT ends_with(s, '+') THEN s WHEN {_is('s', '(at|bl|iz)[+]$')} THEN {_cut(1)} || 'e' WHEN substr(s, -2, 1) = substr(s, -3, 1) AND length(s) > 2 AND NOT {_is('s', '[aeioulsz][+]$')} THEN {_cut(2)}
    WHEN {_short(_cut(1))} THEN {_cut(1)} || 'e' ELSE {_cut(1)} END""",
        f"CASE WHEN ends_with(s, 'y') AND {_vowel(_cut(1))} THEN {_cut(1)} || 'i' ELSE s END", _table(_TWO), _table(_THREE), f"CASE {four} ELSE s END",
        f"CASE WHEN ends_with(s, 'e') AND ({_more(_cut(1))} OR ({_one(_cut(1))} AND NOT {_is(_cut(1), '[^aeiou][aeiouy][^aeiouwxy]$')})) THEN {_cut(1)} ELSE s END",
        f"CASE WHEN ends_with(s, 'll') AND {_more('s')} THEN {_cut(1)} ELSE s END",
    ]
    out = [f"p0_ AS (SELECT w, CASE WHEN starts_with(w, 'y') THEN 'Y' || substr(w, 2) ELSE w END AS s FROM ({words}))"]
    out += [f"p{k}_ AS (SELECT w, {step} AS s FROM p{k - 1}_)" for k, step in enumerate(steps, 1)]
    return ",\n".join([*out, f"stem_ AS (SELECT w, CASE WHEN strlen(w) BETWEEN 3 AND 64 THEN replace(s, 'Y', 'y') ELSE w END AS s FROM p{len(steps)}_)"])
