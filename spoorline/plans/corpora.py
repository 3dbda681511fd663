"""Queries over records: documents rendered as raw QA records, read strictly, converted, prepared and ordered."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memory
from ..runtime import shared_folder
from ..sources import canonical, manifests, records
from ..sources.splits import ordered_slice, permuted_split
from ..sources.strict_records import read_records, reasons

SPLIT_SEED = 7
#: A sentence number that no line has.
NOWHERE = 2**31 - 1


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value) one JSON record per document with text, with faults put in by its number.

    A line that isn't blank is a document of its sentences under its first two
    words; the first sentences of every second line support, at most three; and
    triples lead from each supporting title to the next.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null and text is not null")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    title = lambda x: F.array_join(F.slice(F.split(x, " "), 1, 2), " ")
    cut = lambda x: F.filter(F.split(x, r"\. "), lambda s: F.trim(s) != "")
    rows = docs.select("doc_id", "lang", "source", lines.alias("lines"))
    titles = F.transform(F.slice(F.filter("lines", lambda _, k: k % 2 == 0), 1, 3), title)
    rows = rows.select("doc_id", "lang", "source", "lines", titles.alias("titles"), (F.col("doc_id") % 13).alias("kind"))
    text = lambda x: F.coalesce(F.to_json(F.array(x)), F.lit("[null]"))
    bare = lambda x: F.substr(text(x), F.lit(2), F.length(text(x)) - 2)
    # Pairs of unlike types can't be one array: they are put together as text.
    each = lambda x: F.concat(F.lit("["), F.substr(F.to_json(F.array(title(x))), F.lit(2), F.length(F.to_json(F.array(title(x)))) - 2), F.lit(","), F.to_json(cut(x)), F.lit("]"))
    context = F.concat(F.lit("["), F.array_join(F.transform("lines", each), ","), F.lit("]"))
    place = F.when(F.col("kind") == 4, NOWHERE).otherwise(0).cast("string")
    facts = F.concat(F.lit("["), F.array_join(F.transform("titles", lambda t: F.concat(F.lit("["), F.substr(F.to_json(F.array(t)), F.lit(2), F.length(F.to_json(F.array(t))) - 2), F.lit(","), place, F.lit("]"))), ","), F.lit("]"))
    triple = lambda k: F.array(F.get("titles", k - 1), F.lit("leads to"), F.get("titles", k))
    triples = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size("titles") - 1, F.lit(1))), lambda k: k < F.size("titles")), triple)
    triples = F.to_json(F.when(F.col("kind") == 5, F.transform(triples, lambda t: F.slice(t, 1, 2))).otherwise(triples))
    ident = F.concat(F.lit('"'), F.col("doc_id").cast("string"), F.lit('"'))
    question = F.get(F.split(F.get("lines", 0), r"\. "), 0)
    record = F.concat(
        F.lit('{"_id":'), ident, F.when(F.col("kind") == 1, F.lit(',"_id":"again"')).otherwise(""), F.when(F.col("kind") == 2, F.lit(',"extra":1')).otherwise(""),
        F.lit(',"question":'), bare(question), F.when(F.col("kind") == 3, "").otherwise(F.concat(F.lit(',"answer":'), bare(F.concat(F.lit("from "), F.coalesce("lang", F.lit("nowhere")))))),
        F.lit(',"type":"bridge","context":'), context, F.lit(',"supporting_facts":'), facts, F.lit(',"evidences":'), triples, F.when(F.col("kind") == 6, "").otherwise("}"),
    )
    return rows.select(record.alias("value"))


def _read(spark, sf_dir) -> DataFrame:
    path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    rendered(spark, sf_dir).write.text(path)
    return read_records(spark, path, "twowiki")


def record_reasons(spark, sf_dir):
    return reasons(_read(spark, sf_dir))


def record_items(spark, sf_dir):
    _, items, gold = records.converted(_read(spark, sf_dir))
    return items.join(gold, ["task_id", "item_id"], "left").select("task_id", "item_id", "position", "title", "sequence_index", "text", F.coalesce("ord", F.lit(-1)).alias("gold_ord"))


def record_dependency_edges(spark, sf_dir):
    rows = _read(spark, sf_dir)
    _, items, gold = records.converted(rows)
    return records.dependency_edges(rows, items, gold)


def record_ambiguity(spark, sf_dir):
    rows = _read(spark, sf_dir)
    _, items, gold = records.converted(rows)
    return records.mapping_ambiguity(rows, items, gold)


def importance_prepared(spark, sf_dir):
    """The second hundred tasks of an importance order over conversations, with faults counted before any is taken."""
    from .tasks import conversation_tasks

    own = conversation_tasks(spark, sf_dir)
    scored = memory.cleaned_importance(own.items.select("task_id", "item_id", F.length("text").alias("raw")))
    order = canonical.importance_tasks(scored, own.items)
    # Gold follows from positions, so short conversations have none and can't be prepared.
    good = order.join(canonical.importance_faults(order, own.tasks, own.items, own.gold), "task_id", "left_anti")
    again = canonical.importance_tasks(good.select("task_id", F.inline("scores")), own.items)
    return canonical.prepared_by_importance(again, own.tasks, own.items, own.gold, 5, 20)


def importance_fault_counts(spark, sf_dir):
    """Reasons why tasks can't be prepared, with faults put in by the task's place."""
    from .tasks import conversation_tasks

    own = conversation_tasks(spark, sf_dir)
    scored = memory.cleaned_importance(own.items.select("task_id", "item_id", F.length("text").alias("raw")))
    order = canonical.importance_tasks(scored, own.items)
    kind = F.col("task_ord") % 5
    planted = order.withColumn("digest", F.when(kind == 1, "other").otherwise(F.col("digest"))).withColumn(
        "scores", F.when(kind == 2, F.slice("scores", 1, F.size("scores") - 1)).when(kind == 3, F.transform("scores", lambda s: F.struct(s["item_id"].alias("item_id"), (s["score"] + 10).alias("score")))).otherwise(F.col("scores"))
    )
    faults = canonical.importance_faults(planted, own.tasks, own.items, own.items.select("task_id", "item_id"))
    return faults.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def document_slice(spark, sf_dir):
    """A tenth of the documents from the middle of their order by source, then length and id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.length("text"), F.lit(0)).alias("length"))
    n = docs.count()
    return ordered_slice(docs, ["source", "length", "doc_id"], n // 2, n // 10)


def document_splits(spark, sf_dir):
    """A seeded shuffle of all documents cut into three exact counts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    n = docs.count()
    return permuted_split(docs, ["doc_id"], SPLIT_SEED, {"train": n * 8 // 10, "dev": n // 10, "test": n // 20}).select("doc_id", "row", "place", "split")


def table_files(spark, sf_dir):
    """The tables' files with their digests, and whether they would be delivered."""
    return manifests.classified(manifests.file_digests(spark, sf_dir), [r"\.parquet"], ["^lineitem"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (record_reasons, record_items, record_dependency_edges, record_ambiguity, importance_prepared, importance_fault_counts, document_slice, document_splits, table_files)
    return {f.__name__: f for f in found}


_RECORDS = r"""
src AS (SELECT doc_id, lang, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines, doc_id % 13 AS kind FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
rlines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS no FROM src),
rdocs AS (SELECT doc_id, no, array_to_string(string_split(line, ' ')[1:2], ' ') AS title, list_filter(string_split(line, '. '), lambda s: trim(s) <> '') AS sentences FROM rlines),
asked AS (SELECT s.*, string_split(lines[1], '. ')[1] AS question, len(lines) AS n_lines FROM src s),
bad_doc AS (SELECT doc_id, bool_or(title = '') AS untitled, bool_or(len(sentences) = 0) AS empty FROM rdocs GROUP BY doc_id),
sup AS (SELECT doc_id, no // 2 AS k, title, no FROM rdocs WHERE no % 2 = 0 AND no < 6),
rerror AS (SELECT a.doc_id, CASE WHEN kind = 6 THEN 'json' WHEN kind = 1 THEN 'repeated_key' WHEN kind = 2 THEN 'unknown_field' WHEN coalesce(question, '') = '' THEN 'question' WHEN kind = 3 THEN 'answer'
   WHEN untitled THEN 'document' WHEN empty THEN 'sentences' WHEN kind = 5 AND n_lines > 2 THEN 'triple' WHEN n_lines = 0 THEN 'no_facts' WHEN kind = 4 THEN 'unmapped_fact' WHEN trim(question) = '' THEN 'blank_question' END AS error
  FROM asked a LEFT JOIN bad_doc b USING (doc_id)),
good AS (SELECT doc_id FROM rerror WHERE error IS NULL),
ritems AS (SELECT '2wiki_' || doc_id AS task_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY no, si) - 1 AS INTEGER) AS position, title, CAST(si AS INTEGER) AS sequence_index, text
  FROM (SELECT doc_id, no, title, unnest(sentences) AS text, generate_subscripts(sentences, 1) - 1 AS si FROM rdocs SEMI JOIN good USING (doc_id))),
facts AS (SELECT task_id, k, max(position) AS position FROM (SELECT '2wiki_' || doc_id AS task_id, k, title FROM sup SEMI JOIN good USING (doc_id)) JOIN ritems i USING (task_id, title) WHERE i.sequence_index = 0 GROUP BY ALL),
rgold AS (SELECT task_id, position, CAST(row_number() OVER (PARTITION BY task_id ORDER BY first) - 1 AS INTEGER) AS ord FROM (SELECT task_id, position, min(k) AS first FROM facts GROUP BY ALL)),
triples AS (SELECT '2wiki_' || a.doc_id AS task_id, a.k AS no, a.title AS subject, b.title AS object FROM sup a JOIN sup b ON a.doc_id = b.doc_id AND b.k = a.k + 1 SEMI JOIN good g ON g.doc_id = a.doc_id)"""
_FOLD = lambda x: f"trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[\\s\\x{{00A0}}]+', ' ', 'g'))"
_SUPPORTS = f"""
folded AS (SELECT t.task_id, t.no, g.position, g.ord, {_FOLD('i.title')} AS title, {_FOLD('i.text')} AS text, {_FOLD('subject')} AS s, {_FOLD('object')} AS o FROM triples t JOIN rgold g USING (task_id) JOIN ritems i USING (task_id, position)),
supports AS (SELECT * FROM (SELECT task_id, no, position, ord, CASE WHEN s <> '' AND contains(title, s) THEN 8 ELSE 0 END + CASE WHEN s <> '' AND contains(text, s) THEN 4 ELSE 0 END
   + CASE WHEN o <> '' AND contains(title, o) THEN 2 ELSE 0 END + CASE WHEN o <> '' AND contains(text, o) THEN 2 ELSE 0 END + CASE WHEN contains(text, 'leads to') THEN 1 ELSE 0 END AS score FROM folded) WHERE score > 0)"""
_IMPORTANCE = """
raws AS (SELECT task_id, item_id, length(text) AS raw FROM items),
per AS (SELECT task_id, count(*) AS n FROM items GROUP BY task_id)"""


def _walked(walks: int = 10) -> str:
    """Feistel rounds as common table expressions, a few walks of them."""
    parts = ["n AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS a FROM documents)", "sides AS (SELECT n, a, (n + a - 1) // a AS b FROM n)",
             "numbered AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM documents)", "w0 AS (SELECT doc_id, row, row AS v, false AS done FROM numbered)"]
    for w in range(1, walks + 1):
        parts.append(f"f{w}_0 AS (SELECT doc_id, row, v, done, v % a AS l, v // a AS r FROM w{w - 1}, sides)")
        for k in range(1, 5):
            side = "a" if k % 2 else "b"
            parts.append(f"f{w}_{k} AS (SELECT doc_id, row, v, done, r AS l, (l + CAST('0x' || substr(md5('{SPLIT_SEED}|{k}|' || r), 1, 8) AS BIGINT)) % {side} AS r FROM f{w}_{k - 1}, sides)")
        parts.append(f"w{w} AS (SELECT doc_id, row, CASE WHEN done THEN v ELSE r * a + l END AS v, done OR r * a + l < n AS done FROM f{w}_4, sides)")
    return ", ".join(parts)


def oracle_sql(conv) -> dict[str, str]:
    return {
        "record_reasons": f"WITH {_RECORDS} SELECT error, count(*) AS n FROM rerror WHERE error IS NOT NULL GROUP BY error",
        "record_items": f"WITH {_RECORDS} SELECT task_id, 'm' || i.position AS item_id, i.position, title, sequence_index, text, coalesce(ord, -1) AS gold_ord FROM ritems i LEFT JOIN rgold USING (task_id, position)",
        "record_dependency_edges": f"""WITH {_RECORDS}, {_SUPPORTS}, chosen AS (SELECT task_id, no, position FROM (SELECT *, row_number() OVER (PARTITION BY task_id, no ORDER BY score DESC, ord) AS r FROM supports) WHERE r = 1)
SELECT DISTINCT t.task_id, 'm' || a.position AS source, 'm' || b.position AS target FROM triples t JOIN triples u ON u.task_id = t.task_id AND u.no = t.no + 1
 JOIN chosen a ON a.task_id = t.task_id AND a.no = t.no JOIN chosen b ON b.task_id = u.task_id AND b.no = u.no WHERE a.position <> b.position""",
        "record_ambiguity": f"""WITH {_RECORDS}, {_SUPPORTS} SELECT task_id, CAST(sum(more) AS BIGINT) AS ambiguity FROM (SELECT task_id, no, count(*) - 1 AS more FROM (SELECT *, max(score) OVER (PARTITION BY task_id, no) AS best FROM supports) WHERE score = best GROUP BY ALL) GROUP BY task_id""",
        "importance_prepared": conv(_IMPORTANCE) + """SELECT task_id, ord AS task_ord FROM (SELECT task_id, row_number() OVER (ORDER BY task_id) - 1 AS ord FROM (SELECT DISTINCT g.task_id FROM gold g SEMI JOIN tasks USING (task_id))) WHERE ord >= 5 AND ord < 25""",
        "importance_fault_counts": conv(_IMPORTANCE) + """SELECT error, count(*) AS n FROM (SELECT CASE ord % 5 WHEN 1 THEN 'digest' WHEN 2 THEN 'coverage' WHEN 3 THEN 'score' END AS error FROM (SELECT task_id, row_number() OVER (ORDER BY task_id) - 1 AS ord FROM per)) WHERE error IS NOT NULL GROUP BY error""",
        "document_slice": """SELECT doc_id, source, length, place FROM (SELECT doc_id, coalesce(source, '') AS source, CAST(coalesce(length(text), 0) AS INTEGER) AS length, row_number() OVER (ORDER BY coalesce(source, ''), coalesce(length(text), 0), doc_id) - 1 AS place FROM documents), (SELECT count(*) AS n FROM documents)
WHERE place >= n // 2 AND place < n // 2 + n // 10""",
        "document_splits": f"""WITH {_walked()} SELECT doc_id, row, v AS place, CASE WHEN v < n * 8 // 10 THEN 'train' WHEN v < n * 8 // 10 + n // 10 THEN 'dev' ELSE 'test' END AS split FROM w10, sides WHERE v < n * 8 // 10 + n // 10 + n // 20""",
    }
