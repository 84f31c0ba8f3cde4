"""DuckDB SQL of the text forms, as pieces for the queries' oracle statements."""

from __future__ import annotations

WORDS = "'candidate','row','group','batch','sample','station','skupina','vrstica','kandidat','vzorec'"
#: White space as the JVM's Unicode-aware \\s has it.
S = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
W = r"\p{L}\p{N}_"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{S}+', ' ', 'g'))"


def surface(x: str) -> str:
    plain = f"translate({x}, '’‘`´-', repeat(chr(39), 4) || ' ')"
    return squeeze(f"regexp_replace(lower({plain}), '[^{W}{S[1:-1]}]', ' ', 'g')")


def masked(s: str) -> str:
    """Of a surface form: punctuation is gone, so only quantities and plain numbers are left to mask."""
    left, right = rf"(^|[^{W}])", rf"($|[^{W}])"
    # neighbours share a boundary, so numbers are masked word by word
    word = rf"CASE WHEN regexp_full_match(x, '[0-9]+(?i:kg|g|km|m|cm|mm|l|ml)') THEN '<QUANTITY>' WHEN regexp_full_match(x, '\p{{Nd}}+') THEN '<NUM>' ELSE x END"
    spaced = rf"regexp_replace({s}, '{left}(\d+) (?i:kg|g|km|m|cm|mm|l|ml){right}', '\1<QUANTITY>\3', 'g')"
    return f"array_to_string(list_transform(string_split({spaced}, ' '), lambda x: {word}), ' ')"


def tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda x: x <> '')"


def role(x: str = "doc_id") -> str:
    return f"CASE WHEN {x} % 10 = 0 THEN 'synthetic_holdout' WHEN {x} % 10 <= 2 THEN 'selected_training' ELSE 'synthetic_candidate' END"


def grams(words: str, n: int, separator: str = " ") -> str:
    """Shifted lists side by side; a lambda that looks into the whole list would copy it for each place."""
    shifted = ", ".join(f"{words}[{i + 1}:len({words})-{n - 1 - i}]" for i in range(n))
    joined = f" || '{separator}' || ".join(f"x[{i + 1}]" for i in range(n))
    return f"CASE WHEN len({words}) >= {n} THEN list_transform(list_zip({shifted}), lambda x: {joined}) ELSE [] END"


def shingles(words: str, n: int) -> str:
    return f"CASE WHEN len({words}) >= {n} THEN list_distinct({grams(words, n)}) WHEN len({words}) > 0 THEN [array_to_string({words}, ' ')] ELSE [] END"


def edits(pairs: str, name: str = "edits") -> str:
    """Common table expressions for pairs(id, r, h), r and h lists of symbols: `name`(id, n, m, s, d, i) with substitutions, deletions and insertions.

    The textbook table row by row: a cell holds cost times unit plus insertions, insertions along the row by a running minimum."""
    p = f"{name}_p"
    return f"""{p} AS ({pairs}), {name}_n AS (SELECT id, len(r) AS n, len(h) AS m, len(r) + len(h) + 1 AS u FROM {p}),
{name}_r AS (SELECT id, unnest(r) AS w, generate_subscripts(r, 1) AS i FROM {p}), {name}_h AS (SELECT id, unnest(h) AS w, generate_subscripts(h, 1) AS j FROM {p}),
{name}_t AS (SELECT id, 0::BIGINT AS i, j, (j * (u + 1))::BIGINT AS c FROM (SELECT id, u, unnest(range(0, m + 1)) AS j FROM {name}_n)
  UNION ALL SELECT id, i, j, (min(b - j * (u + 1)) OVER (PARTITION BY id ORDER BY j) + j * (u + 1))::BIGINT FROM (
    SELECT t.id, t.i + 1 AS i, t.j, n.u, least(t.c + n.u, coalesce(lag(t.c) OVER (PARTITION BY t.id ORDER BY t.j) + CASE WHEN h.w = r.w THEN 0 ELSE n.u END, t.c + n.u)) AS b
    FROM {name}_t t JOIN {name}_n n ON n.id = t.id AND t.i < n.n JOIN {name}_r r ON r.id = t.id AND r.i = t.i + 1 LEFT JOIN {name}_h h ON h.id = t.id AND h.j = t.j)),
{name} AS (SELECT id, n, m, c // u - c % u - (c % u + n - m) AS s, c % u + n - m AS d, c % u AS i FROM (SELECT t.id, n.n, n.m, n.u, t.c FROM {name}_t t JOIN {name}_n n ON n.id = t.id AND t.i = n.n AND t.j = n.m))"""


def percent(distance: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN {distance} / {n} * 100.0 WHEN {distance} = 0 THEN 0.0 ELSE 100.0 END"


def one_byte(x: str) -> str:
    """The accented letters of the driver's texts as single bytes, as levenshtein() counts bytes here."""
    letters = "äÄöÖüÜßéÉèÈêÊçÇíÍóÓñÑ"
    return f"translate({x}, '{letters}', {' || '.join(f'chr({14 + i})' for i in range(len(letters)))})"
