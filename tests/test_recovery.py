"""Damaged responses, decoded files, and reports on literal rows."""

import hashlib
import json
import time

from gleanery.operators import reports as rp
from gleanery.operators import responses as rs
from gleanery.plans import knowledge
from gleanery.sources import store


def _titles(text):
    got = rs._recovered(text)
    return None if got is None else [c["title"] for c in json.loads(got)["wiki_candidates"]]


def test_recovery_of_damage():
    a, b = '{"title":"a","x":{"y":[1,"}]"]}}', '{"title":"b \\\\\\" ] }"}'
    head = '{"k":[{"title":"not this"}],"wiki_candidates" : ['
    assert _titles(f"{head}{a},{b},{{\"title\":\"cut") == ["a", 'b \\" ] }']
    assert _titles(f"{head}{a}, nonsense \" {b}]{{\"title\":\"after\"}}") == ["a", 'b \\" ] }']
    assert _titles(f"{head}{a},{{title: bad}},{b}") == ["a", 'b \\" ] }']
    assert _titles(f"{head}{{\"title\":\"open, {a}") is None
    assert _titles("no list") is None and _titles('"wiki_candidates": 3') is None and _titles(head) is None


def test_recovery_is_one_pass():
    text = '{"wiki_candidates":[' + '{"title":"x"},{' * 200_000
    began = time.time()
    assert len(rs.complete_objects(text, 20)) == 1  # the second opens and never ends
    assert time.time() - began < 5


def test_files_of_any_bytes(spark, tmp_path):
    contents = {"bom": b"\xef\xbb\xbfone\r\ntwo\rthree", "pages": b"first\n\x0csecond\x0c", "latin": b"caf\xe9 \xff", "utf": "日本﻿".encode(), "empty": b""}
    for name, c in contents.items():
        (tmp_path / f"{name}.txt").write_bytes(c)
    got = {}
    for r in store.decoded(store.corpus_files(spark, f"{tmp_path}/*.txt")).collect():
        got.setdefault(r.path.rsplit("/", 1)[1].removesuffix(".txt"), {})[r.page] = r.text
    assert got == {"bom": {1: "one\ntwo\nthree"}, "pages": {1: "first\n", 2: "second", 3: ""}, "latin": {1: "caf� �"}, "utf": {1: "日本﻿"}}
    (tmp_path / "copy.txt").write_bytes(contents["latin"])
    ids = {r.path.rsplit("/", 1)[1]: r.content_id for r in store.decoded(store.corpus_files(spark, f"{tmp_path}/*.txt")).collect()}
    assert ids["copy.txt"] == ids["latin.txt"] != ids["bom.txt"] and len(ids["bom.txt"]) == 16


def test_reports_count_all_grains_at_once(spark):
    cards = spark.createDataFrame([("s", "concept", "ignore", "held"), ("s", "concept", "create_new", "held"), ("s", None, "ignore", "pending"), ("t", "method", "ignore", "held")], "source_id string, type string, action string, decision string")
    pages = spark.createDataFrame([("s", 3), ("s", 7), ("u", 1)], "source_id string, page int")
    batches = spark.createDataFrame([("s", "ok"), ("s", "error"), ("s", "error"), ("s", "empty"), ("t", "recovered")], "source_id string, status string")
    got = {r.source_id: json.loads(r.report) for r in rp.run_reports(cards, pages, batches).collect()}
    k = lambda **n: [{"k": x, "n": y} for x, y in sorted(n.items())]
    assert got["s"] == {"source": "s", "pages": 7, "cards": 3, "by_type": k(concept=2, none=1), "by_action": k(create_new=1, ignore=2), "by_decision": k(held=2, pending=1), "batches": 4, "failures": k(empty=1, error=2)}
    assert got["t"]["failures"] == [] and got["t"]["pages"] == 0 and got["u"]["cards"] == 0 and got["u"]["by_type"] == []


def test_packed_files_are_few_and_read_like_loose_ones(spark, tmp_path, monkeypatch):
    contents = {"bom": b"\xef\xbb\xbfone\r\ntwo\rthree", "pages": b"first\n\x0csecond\x0c", "latin": b"caf\xe9 \xff", "empty": b""}
    for name, c in contents.items():
        (tmp_path / f"{name}.txt").write_bytes(c)
    pages = lambda files: sorted((r.path.rsplit("/", 1)[-1], r.page, r.text, r.content_id) for r in store.decoded(files).collect())
    store.pack_files(spark.createDataFrame([(f"{n}.txt", c) for n, c in contents.items()], "path string, content binary"), f"{tmp_path}/packed")
    assert pages(store.packed_files(spark, f"{tmp_path}/packed")) == pages(store.corpus_files(spark, f"{tmp_path}/*.txt"))

    texts = [(4 * v + p, f"page {p}\nof\r{v}" if p else None) for v in range(60) for p in range(4)]
    spark.createDataFrame([*texts, (None, "in no file")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (tmp_path / "shared").mkdir()
    monkeypatch.setattr(knowledge, "shared_folder", lambda spark: f"{tmp_path}/shared")
    got = {(r.source_id, r.page): r.text_md5 for r in knowledge.decoded_files(spark, str(tmp_path)).collect()}
    want = {(f"v{d // 4}", d % 4 + 1): (t or "").replace("\r", "\n") + ("��" if d % 4 == 1 else "") + ("\n" if d % 4 == 3 else "") for d, t in texts}
    assert got == {k: hashlib.md5(t.encode()).hexdigest() for k, t in want.items()}
    assert len([f for f in (tmp_path / "shared").rglob("*") if f.is_file() and not f.name.startswith((".", "_"))]) <= 4
