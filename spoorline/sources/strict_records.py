"""Raw QA records read strictly, with bad ones put aside by reason.

``strict_records`` is a data source for files of nested JSON records: a record
per line (``.jsonl``, ``.txt`` and what Spark's text writer leaves), which are
split by byte ranges, or one array per file (``.json``). Repeated keys at any
depth, unknown fields and wrong types make a record bad, not the job: it comes
back with a reason and its text, and the good ones in one shape for both kinds
of data sets. Files are opened through Arrow, so any store that Arrow knows
will do, and each task holds one range of lines or one array.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range of lines.
RANGE = 64 << 20
#: Records that go out at once.
BATCH = 2_000
SCHEMA = (
    "file string, place long, raw_id string, question string, answer string, question_type string, documents array<struct<title:string,sentences:array<string>>>, "
    "facts array<struct<title:string,index:long>>, evidences array<array<string>>, answer_id string, error string, raw string"
)
# Fixed field names of the two kinds of records.
HOTPOT_FIELDS = ("_id", "question", "answer", "context", "supporting_facts")
TWOWIKI_FIELDS = (*HOTPOT_FIELDS, "type", "evidences", "evidences_id", "answer_id")


class Bad(Exception):
    """A record's fault; its text is the reason."""


def _need(ok: bool, reason: str) -> None:
    if not ok:
        raise Bad(reason)


def _text(value: object) -> bool:
    return isinstance(value, str) and value != ""


def _pairs(value: object, reason: str, good: Callable[[object], bool], each: str) -> list[list]:
    _need(isinstance(value, list), reason)
    for pair in value:
        _need(isinstance(pair, list) and len(pair) == 2 and _text(pair[0]) and good(pair[1]), each)
    return value


def _triples(value: object) -> list[list[str]]:
    _need(isinstance(value, list), "evidences")
    for triple in value:
        _need(isinstance(triple, list) and len(triple) == 3 and all(map(_text, triple)), "triple")
    return value


def fields_of(record: object, triples: bool) -> dict:
    """The fields of a parsed record in the common shape; raises ``Bad``."""
    _need(isinstance(record, dict), "record")
    if triples:
        _need(set(record) <= set(TWOWIKI_FIELDS), "unknown_field")
    get = record.get
    _need(_text(get("_id")), "id")
    _need(_text(get("question")), "question")
    _need(isinstance(get("answer"), str) and (not triples or get("answer") != ""), "answer")
    out = {"raw_id": get("_id"), "question": get("question"), "answer": get("answer"), "question_type": None, "evidences": None, "answer_id": None}
    if triples:
        _need(_text(get("type")), "type")
        out["question_type"] = get("type")
    documents = _pairs(get("context"), "context", lambda s: isinstance(s, list), "document")
    for _, sentences in documents:
        _need(all(isinstance(s, str) for s in sentences) and (bool(sentences) or not triples), "sentences")
    facts = _pairs(get("supporting_facts"), "supporting_facts", lambda n: isinstance(n, int) and not isinstance(n, bool), "fact")
    out["documents"] = [{"title": t, "sentences": s} for t, s in documents]
    out["facts"] = [{"title": t, "index": n} for t, n in facts]
    if triples:
        own = _triples(get("evidences"))
        by_id = [] if get("evidences_id") is None else _triples(get("evidences_id"))
        out["evidences"] = by_id or own
        _need(get("answer_id") is None or _text(get("answer_id")), "answer_id")
        out["answer_id"] = get("answer_id")
    return out


class StrictDecoder:
    """Parses one JSON value and notes repeated keys at any depth."""

    def __init__(self) -> None:
        self.repeated = False
        self.decoder = json.JSONDecoder(object_pairs_hook=self._object)

    def _object(self, pairs: list[tuple[str, object]]) -> dict:
        out = dict(pairs)
        self.repeated |= len(out) < len(pairs)
        return out

    def value(self, text: str, at: int) -> tuple[object, int, bool]:
        """The value at a place, the place behind it, and whether a key was repeated in it."""
        self.repeated = False
        value, end = self.decoder.raw_decode(text, at)
        return value, end, self.repeated


def row_of(file: str, place: int, raw: str, parse: Callable[[], tuple[object, bool]], triples: bool) -> dict:
    """A record's row: its fields, or the reason and the text."""
    row = dict.fromkeys(c.split()[0] for c in re.split(r", (?=\w+ )", SCHEMA)) | {"file": file, "place": place}
    try:
        try:
            value, repeated = parse()
        except ValueError:
            raise Bad("json") from None
        _need(not repeated, "repeated_key")
        return row | fields_of(value, triples)
    except Bad as fault:
        return row | {"error": str(fault), "raw": raw}


def rows_of_array(file: str, text: str, triples: bool) -> Iterator[dict]:
    """Records of one JSON array; behind a place that is no JSON nothing more can be read, which is one bad record."""
    decoder, skip = StrictDecoder(), re.compile(r"[\s]*")
    at = skip.match(text, 0).end()
    if text[at : at + 1] != "[":
        yield row_of(file, 0, text, lambda: (None, False), triples)
        return
    at, place = skip.match(text, at + 1).end(), 0
    while text[at : at + 1] != "]":
        try:
            value, end, repeated = decoder.value(text, at)
            after = skip.match(text, end).end()
            if text[after : after + 1] not in (",", "]"):
                raise ValueError
        except ValueError:
            yield row_of(file, place, text[at:], lambda: json.loads("{"), triples)
            return
        yield row_of(file, place, text[at:end], lambda: (value, repeated), triples)  # noqa: B023
        at = skip.match(text, after + 1).end() if text[after] == "," else after
        place += 1


def row_of_line(file: str, place: int, line: str, triples: bool) -> dict:
    def parse() -> tuple[object, bool]:
        decoder = StrictDecoder()
        value, end, repeated = decoder.value(line, len(line) - len(line.lstrip()))
        if line[end:].strip():
            raise ValueError("more than one value")
        return value, repeated

    return row_of(file, place, line, parse, triples)


@dataclass
class Range(InputPartition):
    """Lines that begin in [start, stop) of a file, or a whole array (stop is -1)."""

    file: str
    start: int
    stop: int


def _store(path: str):
    from pyarrow import fs

    if re.match(r"file:/(?!/)", path):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class StrictRecords(DataSource):
    """Options: path (a file or folder) and dataset (hotpotqa or twowiki)."""

    @classmethod
    def name(cls) -> str:
        return "strict_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StrictReader:
        return StrictReader(self.options["path"], self.options.get("dataset", "hotpotqa"))


class StrictReader(DataSourceReader):
    def __init__(self, path: str, dataset: str) -> None:
        self.path, self.triples = path, DATASETS[dataset].triples

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, path = _store(self.path)
        told = store.get_file_info(path)
        if told.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [told] if told.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if f.base_name.startswith(("_", ".")):
                continue
            if f.base_name.endswith(".json"):
                out.append(Range(f.path, 0, -1))
            else:
                out += [Range(f.path, lo, min(f.size, lo + RANGE)) for lo in range(0, f.size, RANGE)]
        return out or [Range("", 0, 0)]

    def rows(self, part: Range) -> Iterator[dict]:
        if not part.file:
            return
        store, _ = _store(self.path)
        if part.stop < 0:
            with store.open_input_stream(part.file) as data:
                yield from rows_of_array(part.file, data.read().decode("utf-8"), self.triples)
            return
        with store.open_input_file(part.file) as data:
            at = max(0, part.start - 1)
            data.seek(at)
            buffered = io.BufferedReader(data, 1 << 20)
            if part.start:  # a line belongs to the range in which it begins
                at += len(buffered.readline())
            while at < part.stop:
                line = buffered.readline()
                if not line:
                    return
                if line.strip():
                    yield row_of_line(part.file, at, line.decode("utf-8", "replace"), self.triples)
                at += len(line)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        held = []
        for row in self.rows(partition):
            held.append(row)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_pylist(held, ARROW)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, ARROW)


_WORD = pa.string()
ARROW = pa.schema(
    [
        ("file", _WORD), ("place", pa.int64()), ("raw_id", _WORD), ("question", _WORD), ("answer", _WORD), ("question_type", _WORD),
        ("documents", pa.list_(pa.struct([("title", _WORD), ("sentences", pa.list_(_WORD))]))), ("facts", pa.list_(pa.struct([("title", _WORD), ("index", pa.int64())]))),
        ("evidences", pa.list_(pa.list_(_WORD))), ("answer_id", _WORD), ("error", _WORD), ("raw", _WORD),
    ]
)


@dataclass(frozen=True)
class Dataset:
    """What differs between the kinds of records."""

    prefix: str
    triples: bool


DATASETS = {"hotpotqa": Dataset("hotpot", False), "twowiki": Dataset("2wiki", True)}


def read_records(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Records with task_id; a fault of the second gate (``gated``) is told as well."""
    if dataset not in DATASETS:
        raise ValueError(f"unknown data set {dataset}; known: {sorted(DATASETS)}")
    spark.dataSource.register(StrictRecords)
    raw = spark.read.format("strict_records").option("path", path).option("dataset", dataset).load()
    return gated(raw).withColumn("task_id", F.concat(F.lit(f"{DATASETS[dataset].prefix}_"), "raw_id"))


def gated(records: DataFrame) -> DataFrame:
    """Fill ``error`` of records that parse but can't be tasks: facts that name no sentence, none at all, or blank texts."""
    named = lambda f: F.exists("documents", lambda d: (d["title"] == f["title"]) & (f["index"] >= 0) & (f["index"] < F.size(d["sentences"])))
    fault = (
        F.when(F.size("facts") == 0, "no_facts")
        .when(F.exists("facts", lambda f: ~named(f)), "unmapped_fact")
        .when(F.trim("question") == "", "blank_question")
        .when(F.trim("answer") == "", "blank_answer")
        .when(F.exists("documents", lambda d: F.exists(d["sentences"], lambda s: F.trim(s) == "")), "blank_sentence")
    )
    return records.withColumn("error", F.coalesce("error", F.when(F.col("error").isNull(), fault)))


def reasons(records: DataFrame) -> DataFrame:
    """(error, n) of bad records."""
    return records.where("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def accepted(records: DataFrame, strict: bool = False) -> DataFrame:
    """The good records; ``strict`` raises on the first bad one instead of leaving it out."""
    if strict and (bad := records.where("error is not null").select("file", "place", "error").orderBy("file", "place").take(1)):
        raise ValueError(f"bad record in {bad[0].file} at {bad[0].place}: {bad[0].error}")
    return records.where("error is null")
