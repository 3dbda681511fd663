"""Text functions: content tokens, entities, aliases, support scores, digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model: words that are no content, and the phrase pattern of entities.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this",
    "through", "to", "was", "were", "what", "which", "who", "whom", "with",
)
# Classes are spelled out because \\b and \\w mean ASCII in some engines and Unicode in others: a phrase begins where no letter, digit or underscore stands before.
ENTITY_PHRASE = r"(?:^|[^\p{L}\p{N}_])([A-Z][A-Za-z0-9'_-]*(?:\s+[A-Z][A-Za-z0-9'_-]*)*)"
ALIAS_WEIGHT = 1.5
ENTITY_WEIGHT = 2.0
SUPPORT_WEIGHTS = {"title_subject": 8, "text_subject": 4, "title_object": 2, "text_object": 2, "text_relation": 1}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def content_tokens(text: Column | str, keep_short: Column | None = None) -> Column:
    """Lower-cased ASCII word tokens without stop words and, unless kept, without those of one or two characters."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))

    def good(token: Column) -> Column:
        long = F.length(token) > 2
        if keep_short is not None:
            long = long | F.array_contains(keep_short, token)
        return ~token.isin(*STOP_WORDS) & long

    return F.filter(tokens, good)


def normalised_entity(text: Column | str) -> Column:
    """Content tokens joined by single spaces."""
    return F.array_join(content_tokens(text), " ")


def entities(text: Column | str) -> Column:
    """Distinct normalised capitalised phrases."""
    phrases = F.regexp_extract_all(text, F.lit(ENTITY_PHRASE), F.lit(1))
    return F.array_distinct(F.filter(F.transform(phrases, normalised_entity), lambda e: e != ""))


def title_aliases(title: Column | str) -> Column:
    """The normalised title and each of its content tokens."""
    own = F.concat(F.array(normalised_entity(title)), content_tokens(title))
    return F.array_distinct(F.filter(own, lambda e: e != ""))


def smoothed_idf(documents: Column, frequency: Column) -> Column:
    return F.log((documents + 1) / (frequency + 1)) + 1.0


def folded(text: Column | str) -> Column:
    """Lower case with single spaces; the sharp s folds to ss, as in full case folding."""
    low = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(low, r"(?U)\s+", " "))


def support_score(title: Column, text: Column, subject: Column, relation: Column, obj: Column) -> Column:
    """How well a sentence supports a (subject, relation, object) triple."""
    title, text, subject, relation, obj = map(folded, (title, text, subject, relation, obj))
    hit = lambda inner, outer, key: F.when((inner != "") & F.contains(outer, inner), SUPPORT_WEIGHTS[key]).otherwise(0)
    return (
        hit(subject, title, "title_subject")
        + hit(subject, text, "text_subject")
        + hit(obj, title, "title_object")
        + hit(obj, text, "text_object")
        + hit(relation, text, "text_relation")
    )


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def node_number(node_id: Column | str) -> Column:
    """Numeric order of ids like m12."""
    return F.substring(node_id, 2, 10).cast("int")


def prefixed(text: Column | str, prefix: str) -> Column:
    """Text as a dense encoder expects it."""
    return F.concat(F.lit(prefix), F.col(text) if isinstance(text, str) else text)


def hashed_vector(text: Column | str, dims: int = 64) -> Column:
    """Counts of content tokens in ``dims`` hashed places, of length 1; zeros for a text without tokens.

    An encoder that needs no model; any other that gives arrays can stand in its place.
    """

    def counts(places: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(places, lambda p: p == d)).cast("double"))

    def unit(vector: Column) -> Column:
        norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))

    places = F.transform(content_tokens(text), lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 6), 16, 10).cast("long") % dims)
    return let(let(places, counts), unit)


def corpus_id(task: Column | str, node: Column | str) -> Column:
    return F.concat_ws("::", task, node)


def content_digest(items: Column) -> Column:
    """SHA-256 of the compact JSON of items, an array of (id, position, source, text) structs.

    Escapes of control characters are lower-cased, as other JSON writers have them.
    """
    body = F.to_json(F.struct(items.alias("items")), {"ignoreNullFields": "false"})
    for code in (*range(0x0B, 0x0C), *range(0x0E, 0x20)):
        body = F.replace(body, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    return F.sha2(body, 256)


def min_max(x: Column, over) -> Column:
    """Scaled to 0..1 within the window; constant values give 0."""
    low, high = F.min(x).over(over), F.max(x).over(over)
    return F.when(high == low, F.lit(0.0)).otherwise((x - low) / (high - low))
