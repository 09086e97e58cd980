"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of the four languages, lower case.
STOP_WORDS = {
    "en": "the of and a to in is be it for that with on by this are was as at an not from or only to".split(),
    "fr": "de la le et les des en un une du que est pour qui dans sur par pas au avec ne se".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch".split(),
    "es": "de la que el en y a los se del las un por con no una su para es lo al".split(),
}
#: As they count: in lower case, or with a capital.
ALL_STOP_WORDS = sorted({x for words in STOP_WORDS.values() for w in words for x in (w, w.capitalize())})
LONGEST_STOP_WORD = max(len(w.encode()) for w in ALL_STOP_WORDS)

#: (feature, least, most): a document with a feature outside its bounds is rejected; None leaves a side open. Parameters.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 2.0, 15.0),
    ("symbol_ratio", None, 0.2),
    ("bang_ratio", None, 0.2),
    ("stop_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
)

FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"

FEATURES: dict[str, str] = {
    "mean_word_chars": "word_chars / n_words",
    "symbol_ratio": "n_symbols / n_words",
    "bang_ratio": "n_bangs / n_words",
    "stop_ratio": "n_stop_words / if(n_words >= 50, n_words, 0)",  # a short text may do without
    "dup_line_ratio": "n_dup_lines / n_lines",
}

_GAP = r"[\\x20\\x09-\\x0D]"
_WORDS = f"array_remove(split(text, '{_GAP}+'), '')"
_LINES = r"filter(split(text, '\\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def repeated_words(words: str) -> str:
    """SQL: the words that lie in a 5-word window that the text holds twice or more.

    Each window is one long: its hash above, its place in as many low bits as the text needs. Sorting brings equal
    windows together, and the words of neighbours with equal hashes are compared, as in a text of a million words the
    hash has 44 bits; the places of equal ones, sorted again, give the words they cover.
    """
    window = ", ".join(f"w[i + {k}]" for k in range(5))
    keys = f"sort_array(transform(sequence(0, size(w) - 5), i -> shiftleft(xxhash64({window}), b) | cast(i as long)))"
    place = "cast({0} & (shiftleft(1L, b) - 1L) as int)".format
    equal = lambda y: f"coalesce(shiftright(x, b) = shiftright({y}, b) and slice(w, {place('x')} + 1, 5) = slice(w, {place(y)} + 1, 5), false)"
    places = f"sort_array(transform(filter(p, (x, j) -> {equal('get(p, j - 1)')} or {equal('get(p, j + 1)')}), x -> x & (shiftleft(1L, b) - 1L)))"
    cover = "aggregate(transform(s, (x, j) -> least(5L, coalesce(get(s, j + 1) - x, 5L))), 0L, (acc, x) -> acc + x)"
    body = _let("cast(length(bin(size(w))) as int)", "b", _let(keys, "p", _let(places, "s", cover)))
    return _let(words, "w", f"if(size(w) < 5, 0L, {body})")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str = "null") -> DataFrame:
    """The counts that rules are made of, of each row; row: SQL of a value to carry along as "row"."""
    stop = ", ".join(f"'{w}'" for w in ALL_STOP_WORDS)
    base = docs.select(F.expr(row).alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.select("row", "doc_id", "text", F.expr(_WORDS).alias("words"), F.expr(_LINES).alias("lines"))
    return base.selectExpr(
        "row",
        "doc_id",
        "cast(size(words) as long) as n_words",
        "cast(length(array_join(words, '')) as long) as word_chars",
        "cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '')) as long) as n_symbols",
        "cast(size(lines) - size(array_distinct(lines)) as long) as n_dup_lines",
        f"{repeated_words('words')} as n_repeat_words",
        "cast(size(lines) as long) as n_lines",
        "cast(length(text) - length(replace(text, '!', '')) as long) as n_bangs",
        f"cast(size(filter(words, x -> octet_length(x) <= {LONGEST_STOP_WORD} and x in ({stop}))) as long) as n_stop_words",
    )


def verdict(rules=RULES) -> Column:
    """True if no rule rejects; a ratio over nothing rejects nothing."""
    tests = []
    for name, least, most in rules:
        value = F.expr(f"try_divide(cast({FEATURES[name].split(' / ')[0]} as double), {FEATURES[name].split(' / ')[1]})")
        if least is not None:
            tests.append(F.coalesce(value >= least, F.lit(True)))
        if most is not None:
            tests.append(F.coalesce(value <= most, F.lit(True)))
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), one for each row.

    Cases: null, empty or blank text has no words and fails the base rule; very long texts are measured whole; there are
    no ties, as each row is judged by itself, rows that repeat an id and null ids too; an empty table gives an empty
    result; other columns are ignored.
    """
    m = measures(docs, id_col, text_col)
    m = m.withColumn("base_failed", F.expr(FAILED)).withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """docs' rows that neither the base rule nor the table rejects, with all their columns, whatever their names. The cases are those of quality(): what it doesn't keep goes."""
    m = measures(docs, id_col, text_col, "struct(*)")
    return m.where(~F.expr(FAILED) & verdict(rules)).select("row.*")


#: DuckDB SQL of the same result.
ORACLE = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, words[i:i+4] AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
r AS (
  SELECT doc_id, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM d) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(r.n_repeat_words, 0) AS n_repeat_words,
         len(lines) AS n_lines,
         length(text) - length(replace(text, '!', '')) AS n_bangs,
         len(list_filter(words, lambda x: x IN ({", ".join(f"'{w}'" for w in ALL_STOP_WORDS)}))) AS n_stop_words
  FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
       AND {" AND ".join(" AND ".join(f"coalesce({FEATURES[n].split(' / ')[0]}::DOUBLE / nullif({FEATURES[n].split(' / ')[1]}, 0) {op} {v}::DOUBLE, true)" for op, v in ((">=", lo), ("<=", hi)) if v is not None) for n, lo, hi in RULES)} AS kept
FROM m"""
