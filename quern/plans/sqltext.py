"""Pieces of SQL that several oracles share."""

#: White space as Unicode has it, and the information separators.
WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


def canonical(x: str) -> str:
    return f"array_to_string({words(f'lower({x})')}, ' ')"


def lines(x: str) -> str:
    s = f"string_split_regex({x}, '{LINE_END}')"
    return f"CASE WHEN {s}[-1] = '' THEN {s}[1:len({s})-1] ELSE {s} END"


def grams(w: str, width: int) -> str:
    """Distinct n-grams of a list of words (a column, so that it is split once)."""
    return f"CASE WHEN len({w}) >= {width} THEN list_distinct(list_transform(range(1, len({w}) - {width} + 2), lambda i: array_to_string({w}[i:i + {width} - 1], ' '))) ELSE [] END"


TOKENS = r"""w0 AS (SELECT row_id, coalesce(source, '') AS doc, source_id, language, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{N}]+') AS forms FROM sentences),
w1 AS (SELECT row_id, doc, source_id, language, unnest(forms) AS form, CAST(generate_subscripts(forms, 1) AS INT) AS id FROM w0),
gold AS (SELECT doc, source_id, language, row_id AS sent, id, form, substr(form, 1, greatest(1, length(form) - 2)) AS lemma,
  (['NOUN', 'VERB', 'ADJ', 'ADP'])[length(form) % 4 + 1] AS upos, '_' AS xpos,
  (['Case=Nom|Number=Sing', '_', 'Foo=Bar|Number=Plur'])[id % 3 + 1] AS feats, CAST(id - 1 AS INT) AS head,
  CASE WHEN id = 1 THEN 'root' ELSE (['nsubj', 'obj', 'case', 'punct', 'obl:tmod', 'det'])[id % 6 + 1] END AS deprel FROM w1),
sys AS (SELECT doc, source_id, language, sent, id, form, CASE WHEN id % 13 = 0 THEN '?' ELSE lemma END AS lemma,
  CASE WHEN (sent + 3 * id) % 11 = 0 THEN 'X' ELSE upos END AS upos, xpos, feats,
  CAST(CASE WHEN id > 2 AND (sent + id) % 7 = 0 THEN id - 2 ELSE id - 1 END AS INT) AS head,
  CASE WHEN id > 1 AND (sent + 2 * id) % 5 = 0 THEN 'dep' ELSE deprel END AS deprel FROM gold)"""
