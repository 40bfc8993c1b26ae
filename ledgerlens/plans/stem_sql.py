"""Porter's stemmer as DuckDB SQL over a vocabulary, for the oracles of the stemmed
scores. Written from the published rules; shares nothing with ``functions/porter.py``.

``cv`` marks a consonant y as Y (first letter, or after a vowel), so that the
vowels of a word are just ``[aeiouy]``; what precedes a suffix is judged on its part of
that spelling.
"""

from __future__ import annotations

# Irregular forms, then suffixes and what replaces them, longest first.
IRREGULAR = ("skies sky, sky sky, dying die, lying lie, tying tie, news news, innings inning, "
             "inning inning, outings outing, outing outing, cannings canning, canning canning, "
             "howe howe, proceed proceed, exceed exceed, succeed succeed")
STEP2 = ("ational ate, ization ize, iveness ive, fulness ful, ousness ous, tional tion, "
         "biliti ble, entli ent, ousli ous, ation ate, alism al, aliti al, iviti ive, fulli ful, "
         "enci ence, anci ance, izer ize, alli al, ator ate, logi log, bli ble, eli e")
STEP3 = "icate ic, ative -, alize al, iciti ic, ical ic, ness -, ful -"
STEP4 = ("ement ance ence able ible ment ant ent ion ism ate iti ous ive ize al er ic ou")


def _cv(x: str) -> str:
    return (f"regexp_replace(regexp_replace({x}, '(^|[aeiou])y', '\\1Y', 'g'), "
            "'yy', 'yY', 'g')")


def _cut(n: int, x: str = "w") -> str:
    return f"left({x}, length({x}) - {n})"


def _measure(x: str) -> str:
    return f"len(regexp_extract_all({_cv(x)}, '[aeiouy][^aeiouy]'))"


def _cvc(x: str) -> str:
    return (f"(regexp_matches({_cv(x)}, '[^aeiouy][aeiouy][^aeiouywxY]$') "
            f"OR regexp_matches({_cv(x)}, '^[aeiouy][^aeiouy]$'))")


def _vowel(x: str) -> str:
    return f"regexp_matches({_cv(x)}, '[aeiouy]')"


def _replaced(table: str) -> str:
    """The longest suffix of ``table`` that fits is replaced if something with a
    positive measure stands before it."""
    cases = []
    for entry in table.split(", "):
        suffix, new = entry.split()
        before = _cut(len(suffix))
        if suffix == "logi":                    # its l counts as standing before it
            rule = f"CASE WHEN {_measure(_cut(3))} > 0 THEN {_cut(1)} ELSE w END"
        else:
            rule = (f"CASE WHEN {_measure(before)} > 0 THEN {before} || "
                    f"'{new.replace('-', '')}' ELSE w END")
        cases.append(f"WHEN ends_with(w, '{suffix}') THEN {rule}")
    return f"CASE {' '.join(cases)} ELSE w END"


def _dropped() -> str:
    cases = []
    for suffix in STEP4.split():
        before = _cut(len(suffix))
        fits = f"{_measure(before)} > 1"
        if suffix == "ion":
            fits += f" AND regexp_matches({before}, '[st]$')"
        cases.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {fits} THEN {before} "
                     "ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


def stem_ctes(vocabulary: str) -> str:
    """CTEs that end in ``stems(t, stem)`` for the words ``t`` of the CTE
    ``vocabulary``; words of three letters or fewer are their own stems."""
    irregular = " ".join("WHEN '{}' THEN '{}'".format(*e.split()) for e in IRREGULAR.split(", "))
    steps = [
        # 1a: plurals
        f"""CASE WHEN ends_with(w, 'ies') AND length(w) = 4 THEN {_cut(1)}
  WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_cut(2)}
  WHEN ends_with(w, 'ss') THEN w WHEN ends_with(w, 's') THEN {_cut(1)} ELSE w END""",
        # 1b: -eed, -ied, -ed, -ing; a bar marks a stem whose end is put right next
        f"""CASE WHEN ends_with(w, 'ied') THEN CASE WHEN length(w) = 4 THEN {_cut(1)} ELSE {_cut(2)} END
  WHEN ends_with(w, 'eed') THEN CASE WHEN {_measure(_cut(3))} > 0 THEN {_cut(1)} ELSE w END
  WHEN ends_with(w, 'ed') AND {_vowel(_cut(2))} THEN {_cut(2)} || '|'
  WHEN ends_with(w, 'ing') AND {_vowel(_cut(3))} THEN {_cut(3)} || '|' ELSE w END""",
        f"""CASE WHEN NOT ends_with(w, '|') THEN w
  WHEN regexp_matches(w, '(at|bl|iz)[|]$') THEN {_cut(1)} || 'e'
  WHEN w[-2] = w[-3] AND w[-2] NOT IN ('l', 's', 'z')
    AND regexp_matches({_cv(_cut(1))}, '[^aeiouy]$') THEN {_cut(2)}
  WHEN {_measure(_cut(1))} = 1 AND {_cvc(_cut(1))} THEN {_cut(1)} || 'e' ELSE {_cut(1)} END""",
        # 1c: -y
        f"""CASE WHEN ends_with(w, 'y') AND length(w) > 2
  AND regexp_matches({_cv(_cut(1))}, '[^aeiouy]$') THEN {_cut(1)} || 'i' ELSE w END""",
        f"CASE WHEN ends_with(w, 'alli') AND {_measure(_cut(4))} > 0 THEN {_cut(2)} ELSE w END",
        _replaced(STEP2), _replaced(STEP3), _dropped(),
        # 5: a last e, a double l
        f"""CASE WHEN ends_with(w, 'e') AND ({_measure(_cut(1))} > 1
  OR ({_measure(_cut(1))} = 1 AND NOT {_cvc(_cut(1))})) THEN {_cut(1)} ELSE w END""",
        f"CASE WHEN ends_with(w, 'll') AND {_measure(_cut(1))} > 1 THEN {_cut(1)} ELSE w END",
    ]
    ctes = [f"""stem0 AS (
  SELECT t, CASE t {irregular} END AS fixed, t AS w FROM {vocabulary} WHERE length(t) > 3)"""]
    ctes += [f"stem{i + 1} AS (SELECT t, fixed, {step} AS w FROM stem{i})"
             for i, step in enumerate(steps)]
    ctes.append(f"""stems AS MATERIALIZED (
  SELECT t, coalesce(fixed, w) AS stem FROM stem{len(steps)}
  UNION ALL SELECT t, t FROM {vocabulary} WHERE length(t) <= 3)""")
    return ",\n".join(ctes)
