"""DuckDB twins of the text helpers (used only to build oracle SQL)."""

from __future__ import annotations

from txrisk.functions.scalar import FEATURE_LABELS
from txrisk.functions.text import FEATURE_KEYWORDS, USEFULNESS_SECTIONS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fixed(v: str, d: int) -> str:
    s = 10 ** d
    return f"printf('%.{d}f', round_even(({v}) * {s}.0, 0) / {s}.0)"


def signed(v: str, d: int) -> str:
    return f"(CASE WHEN ({v}) >= 0 THEN '+' ELSE '' END || {fixed(v, d)})"


def label(f: str) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in FEATURE_LABELS.items())
    return (f"(CASE {f} {whens} ELSE CASE WHEN starts_with({f}, 'bank_') THEN 'bank (' || "
            f"substr({f}, 6) || ')' ELSE replace({f}, '_', ' ') END END)")


def cap(s: str) -> str:
    return f"(upper(substr({s}, 1, 1)) || lower(substr({s}, 2)))"


def naira(a: str) -> str:
    return f"('₦' || format('{{:,.0f}}', {a}))"


def hour12(h: str) -> str:
    return (f"(CAST(CASE WHEN {h} % 12 = 0 THEN 12 ELSE {h} % 12 END AS VARCHAR) || "
            f"CASE WHEN {h} < 12 THEN ' AM' ELSE ' PM' END)")


def band(p: str) -> str:
    return f"(CASE WHEN {p} >= 0.7 THEN 'High' WHEN {p} >= 0.4 THEN 'Medium' ELSE 'Low' END)"


def template(text: str, values: dict[str, str]) -> str:
    parts, rest = [], text
    while "{" in rest:
        i = rest.index("{")
        j = rest.index("}", i)
        parts += [lit(rest[:i]), f"({values[rest[i + 1:j]]})"]
        rest = rest[j + 1:]
    parts.append(lit(rest))
    return "(" + " || ".join(parts) + ")"


def keywords(f: str) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN [{', '.join(lit(w) for w in v)}]"
                     for k, v in FEATURE_KEYWORDS.items())
    return f"(CASE {f} {whens} ELSE [replace({f}, '_', ' ')] END)"


def mentioned(f: str, text: str, strict: bool = False) -> str:
    low = f"lower({text})"
    if strict:
        hit = f"len(list_filter({keywords(f)}, lambda k: regexp_matches({low}, '\\b' || k || '\\b'))) > 0"
        bank = (f"(regexp_matches({low}, '\\b' || lower(substr({f}, 6)) || '\\b') OR "
                f"regexp_matches({low}, '\\bbank\\b'))")
    else:
        hit = f"len(list_filter({keywords(f)}, lambda k: contains({low}, k))) > 0"
        bank = f"(contains({low}, lower(substr({f}, 6))) OR contains({low}, 'bank'))"
    return f"(CASE WHEN starts_with({f}, 'bank_') THEN {bank} ELSE {hit} END)"


def usefulness(text: str) -> str:
    low = f"lower({text})"
    terms = []
    for pats in USEFULNESS_SECTIONS.values():
        any_ = " OR ".join(f"regexp_matches({low}, {lit(p)})" for p in pats)
        terms.append(f"CAST(({any_}) AS INT)")
    return f"least({' + '.join(terms)}, 4)"
