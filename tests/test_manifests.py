"""Digests of files by Spark, changes between manifests, and stages that go stale by content."""

import hashlib
import os

import pytest

from spoorline import workflow as w
from spoorline.sources import manifests as m


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, body in (("a.json", b"{}"), ("sub/b.json", b"[1]"), ("sub/empty.txt", b""), ("big.bin", b"x" * 5000)):
        (tmp_path / "in" / name).write_bytes(body)
    return tmp_path / "in"


def rows(df):
    return {r.file: (r.bytes, r.sha256) for r in df.collect()}


def test_digests_and_limits(spark, folder):
    got = rows(m.file_digests(spark, str(folder), limit=1000))
    sha = lambda name: hashlib.sha256((folder / name).read_bytes()).hexdigest()
    assert got == {"a.json": (2, sha("a.json")), "sub/b.json": (3, sha("sub/b.json")), "big.bin": (5000, None)}
    alone = rows(m.file_digests(spark, str(folder / "a.json")))
    assert alone == {"a.json": (2, sha("a.json"))}


def test_changes_verification_and_classes(spark, folder):
    old = spark.createDataFrame(m.file_digests(spark, str(folder)).collect())
    assert old.count() == 3
    first = m.tree_digest(old)
    os.utime(folder / "a.json", (1, 1))
    assert m.tree_digest(m.file_digests(spark, str(folder))) == first
    (folder / "a.json").write_bytes(b"[]")
    (folder / "sub/b.json").unlink()
    (folder / "new.json").write_bytes(b"1")
    new = m.file_digests(spark, str(folder))
    assert m.tree_digest(new) != first
    assert {r.file: r.change for r in m.changes(old, new).collect()} == {"a.json": "changed", "sub/b.json": "removed", "new.json": "added"}
    m.verified(new, new)
    m.verified(new, old.where("file = 'big.bin'"))
    with pytest.raises(ValueError, match="a.json"):
        m.verified(new, old)
    told = {r.file: r.status for r in m.classified(new, [r"\.json$", "big"], ["^new"], limit=100).collect()}
    assert told == {"a.json": "included", "new.json": "excluded", "big.bin": "too_large"}


def test_stages_go_stale_by_content_alone(spark, folder, tmp_path):
    digest = lambda path: m.tree_digest(m.file_digests(spark, path))
    flow = w.Workflow(str(tmp_path / "runs"), [w.Stage("one", dict, inputs=(str(folder),), digest=digest), w.Stage("two", dict)])
    assert flow.run() == ["one", "two"] and [flow.status(s) for s in flow.stages] == ["complete", "complete"]
    os.utime(folder / "a.json", (5, 5))
    assert flow.status(flow.stages[0]) == "complete"
    (folder / "a.json").write_bytes(b"[]")
    assert [flow.status(s) for s in flow.stages] == ["stale", "complete"]
    assert flow.run() == ["one", "two"]


def test_provenance(spark, folder):
    row = m.provenance(spark, "bm25", {"k1": "1.5"}, {"tasks": str(folder)}).first()
    assert row.method == "bm25" and row.settings == {"k1": "1.5"} and row.sha256 == m.tree_digest(m.file_digests(spark, str(folder)))


def test_contents_are_no_values_of_rows(spark, folder):
    """A large file is read in pieces: Spark reads none of its content."""
    (folder / "a b%20c.bin").write_bytes(b"y" * (3 * m.PIECE + 5))
    found = m.file_digests(spark, str(folder))
    assert rows(found)["a b%20c.bin"] == (3 * m.PIECE + 5, hashlib.sha256(b"y" * (3 * m.PIECE + 5)).hexdigest())
    assert "sha2(content" not in found._jdf.queryExecution().optimizedPlan().toString()
