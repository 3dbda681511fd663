"""Line-first quality cleaning with DataFrame functions only.

Each line is judged by itself: symbol density, shouting, navigation
separators, words said over and over, terminal punctuation of very short lines,
and boilerplate phrases. Lines that fail are removed; a document that loses more than
``max_loss`` of its word characters that way is rejected, as is one that fails
the base measures (too few words, or too many words in repeated windows).

Everything is computed within the row, so nothing is shuffled and no document
meets another. Windows of eight words are compared by 64-bit hashes; only a
text that has two equal windows pays for sorting them.

Defined results: null and empty texts have no words and fail the base
measures; repeated rows give repeated results; an input column named as an
output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Share of word characters that may be lost with removed lines, in percent.
MAX_LOSS_PERCENT = 50
#: A line fails with more symbols than this per hundred word characters.
MAX_SYMBOL_PERCENT = 10
BOILERPLATE = (
    "cookie policy", "privacy policy", "terms of use", "terms of service", "terms and conditions", "use of cookies", "uses cookies", "enable javascript", "javascript is disabled",
    "lorem ipsum", "click here", "read more", "sign in", "sign up", "log in", "subscribe to our", "share this", "follow us on", "back to top", "skip to content",
)
_SPACE = r"[\x20\x09-\x0D]"
_SPACE_RUN = _SPACE + "+"
_SYMBOL = r"[#*$%&|<>]"


def measured(line: Column) -> Column:
    """(l, ws, syms, chars): a line, its words, its symbols and its word characters."""
    return F.struct(
        line.alias("l"),
        F.filter(F.split(line, _SPACE_RUN), lambda w: w != "").alias("ws"),
        F.regexp_count(line, F.lit(_SYMBOL)).alias("syms"),
        (F.length(line) - F.regexp_count(line, F.lit(_SPACE))).alias("chars"),
    )


def line_fails(line: Column) -> Column:
    """Whether a measured line with at least one word is removed."""
    text, ws, chars = line["l"], line["ws"], line["chars"]
    words = F.size(ws)
    bangs = F.regexp_count(text, F.lit(r"[!?]{2,}"))
    pipes = F.regexp_count(text, F.lit(r"[|»›•·](?:[\x20\x09-\x0D]|$)"))
    stutters = F.size(F.filter(ws, lambda w, i: (i > 0) & (w == F.get(ws, i - 1))))
    return (
        (line["syms"] * 100 > chars * MAX_SYMBOL_PERCENT)
        | let(bangs, lambda n: (n >= 2) & (n * 3 >= words))
        | let(pipes, lambda n: (n >= 2) & (n * 4 >= words))
        | ((chars >= 20) & (F.regexp_count(text, F.lit(r"\p{Lu}")) * 10 > chars * 6))
        | ((words <= 25) & let(F.lower(text), _boilerplate))
        | ((words >= 6) & (stutters * 3 > words))
        | ((words <= 2) & ~text.rlike(r"[.!?…:;\"'”’)][\x20\x09-\x0D]*$"))
    )


def _boilerplate(lowered: Column) -> Column:
    out = F.lit(False)
    for phrase in BOILERPLATE:
        out = out | F.contains(lowered, F.lit(phrase))
    return out


def repeated_window_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words that stand in a window of ``window`` words found twice or more."""

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(rows: Column) -> Column:
            last = F.size(rows) - 1
            same = lambda a, b: F.get(rows, a)["h"] == F.get(rows, b)["h"]
            twice = F.filter(F.sequence(F.lit(0), last), lambda j: ((j > 0) & same(j - 1, j)) | ((j < last) & same(j, j + 1)))
            return F.sort_array(F.transform(twice, lambda j: F.get(rows, j)["i"]))

        def total(found: Column) -> Column:
            steps = F.aggregate(
                found,
                F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
                lambda acc, i: F.struct((acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n"), i.alias("last")),
                lambda acc: acc["n"],
            )
            return steps

        return let(let(ordered, starts), total)

    def from_hashes(word_hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(word_hashes) - window)
        grams = F.transform(starts, lambda i: F.xxhash64(*[F.get(word_hashes, i + k) for k in range(window)]))
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0)))

    return F.when(F.size(words) <= window, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), from_hashes))


def clean_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the base measures, ``lost_chars``, ``clean_text``, ``base_failed`` and ``kept``.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and
    ``n_repeat_words`` are long; ``clean_text`` is the text without its failed
    lines (lines without a word stay).
    """
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), measured)
    total = lambda rows, field: F.aggregate(rows, F.lit(0).cast("long"), lambda acc, r: acc + r[field])

    def judged(rows: Column) -> Column:
        worded = F.transform(F.filter(rows, lambda r: F.size(r["ws"]) > 0), lambda r: r["l"])
        marked = F.transform(rows, lambda r: F.struct(r["l"].alias("l"), r["chars"].alias("chars"), ((F.size(r["ws"]) > 0) & line_fails(r)).alias("f")))
        words = F.flatten(F.transform(rows, lambda r: r["ws"]))
        return F.struct(
            let(words, lambda ws: F.struct(F.size(ws).cast("long").alias("n"), repeated_window_words(ws).cast("long").alias("again"))).alias("w"),
            let(worded, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("dup"),
            total(rows, "chars").alias("chars"),
            total(rows, "syms").alias("syms"),
            let(
                marked,
                lambda ms: F.struct(
                    total(F.filter(ms, lambda r: r["f"]), "chars").alias("lost"),
                    F.array_join(F.transform(F.filter(ms, lambda r: ~r["f"]), lambda r: r["l"]), "\n").alias("clean"),
                ),
            ).alias("m"),
        )

    out = docs.withColumn("__l", let(lines, judged))
    out = out.withColumns(
        {
            "n_words": F.col("__l.w.n"),
            "word_chars": F.col("__l.chars"),
            "n_symbols": F.col("__l.syms"),
            "n_dup_lines": F.col("__l.dup"),
            "n_repeat_words": F.col("__l.w.again"),
            "lost_chars": F.col("__l.m.lost"),
            "clean_text": F.col("__l.m.clean"),
        }
    ).drop("__l")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * MAX_LOSS_PERCENT))


def oracle_sql() -> str:
    blank = r"[ \t\n\x0b\x0c\r]"
    word = r"[^ \t\n\x0b\x0c\r]"
    syms = r"[#*$%&|<>]"
    count = lambda text, pattern: f"length(regexp_extract_all({text}, '{pattern}'))"
    quote = r"[.!?…:;\"''”’)]"
    boiler = " OR ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{word}+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM t),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
d AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before
      FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, CAST(sum(least({WINDOW}, i - coalesce(before, -{WINDOW}))) AS BIGINT) AS n FROM d GROUP BY doc_id),
l AS (SELECT doc_id, x, {count('x', word + '+')} AS words, length(regexp_replace(x, '{blank}', '', 'g')) AS chars,
             length(regexp_replace(x, '[^\\p{{Lu}}]+', '', 'g')) AS capitals,
             len(list_filter(regexp_split_to_array(x, '{blank}+'), lambda w, i: i > 1 AND w = regexp_split_to_array(x, '{blank}+')[i - 1])) AS stutters,
             {count('x', '[!?]{2,}')} AS bangs, {count('x', f'[|»›•·](?:{blank}|$)')} AS pipes, {count('x', syms)} AS syms
      FROM (SELECT doc_id, unnest(ls) AS x FROM w)),
f AS (SELECT doc_id, CAST(sum(chars) AS BIGINT) AS lost FROM l
      WHERE syms * 100 > chars * {MAX_SYMBOL_PERCENT} OR (bangs >= 2 AND bangs * 3 >= words) OR (pipes >= 2 AND pipes * 4 >= words)
         OR (chars >= 20 AND capitals * 10 > chars * 6) OR (words <= 25 AND ({boiler})) OR (words >= 6 AND stutters * 3 > words)
         OR (words <= 2 AND NOT regexp_matches(x, '{quote}{blank}*$')) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{blank}+', '', 'g')) AS BIGINT) AS word_chars,
             CAST({count('text', syms)} AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             coalesce(r.n, 0) AS n_repeat_words, coalesce(f.lost, 0) AS lost_chars
      FROM w LEFT JOIN r USING (doc_id) LEFT JOIN f USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed,
       NOT base_failed AND lost_chars * 100 <= word_chars * {MAX_LOSS_PERCENT} AS kept
FROM b"""
