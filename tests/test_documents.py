"""Snapshot documents: ranges, odd JSON, and that only the wanted ones are opened."""

import io
import json
import random

import pytest

from shelf.sinks import files
from shelf.sources import documents

ODD = ['plain', 'quote " here', 'back\\slash', 'both \\" x', '}], {"items": [', "café 中", "\\\\", "tab\t\n", ""]


def document(rng, n):
    items = [{"roaster": rng.choice(ODD), "bean_name": rng.choice(ODD), "error": rng.choice([None, 3, {"a": [1, {"b": 2}]}])} for _ in range(n)]
    body = {"generated_at": "2026-01-01", "summary": {"items": [1, {"x": 2}]}, "grouped": {"items": [{"roaster": "no"}]},
            "items": items, "errors": [{"roaster": "no"}]}
    if rng.random() < 0.5:
        body = dict(reversed(body.items()))
    return body, json.dumps(body, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5).encode()


@pytest.mark.parametrize("block", [1, 7, 64, 4 << 20])
def test_ranges_give_every_item_once(monkeypatch, block):
    monkeypatch.setattr(documents, "BLOCK_BYTES", block)
    rng = random.Random(block)
    for _ in range(25):
        body, raw = document(rng, rng.randint(1, 12))
        cut = rng.randint(1, len(raw))
        got = []
        for low in range(0, len(raw), cut):
            got += list(documents.items_of(io.BytesIO(raw), len(raw), low, low + cut))
        assert got == list(enumerate(body["items"]))
        assert documents._generated_at(documents.Structure(io.BytesIO(raw), len(raw))) == "2026-01-01"


def test_documents_without_items():
    for raw in (b"{}", b'{"items": []}', b"", b"[1]", b'{"items": [{"roaster": "a"}', b'{"items": [1, "x", null]}', b'{"items": "no"}'):
        got = list(documents.items_of(io.BytesIO(raw), len(raw), 0, 1 << 30))
        assert got[-1] == (None, None)
    raw = b'{"items": [1, {"roaster": "a"}, "x", {"roaster": "b"}]}'
    assert [(o, i["roaster"]) for o, i in documents.items_of(io.BytesIO(raw), len(raw), 0, 99)] == [(1, "a"), (3, "b")]


def test_only_the_newest_are_opened(spark, tmp_path):
    rng, bodies = random.Random(1), {}
    for i in range(100):
        name = f"list_2026-01-01_{i:06d}.json"
        body, raw = document(rng, 20)
        (tmp_path / name).write_bytes(raw if i >= 98 else b"{ broken")
        bodies[name] = body["items"]
    (tmp_path / "zzz.json").write_bytes(b"{}")
    found = documents.read_documents(spark, str(tmp_path), newest=2)
    # damaged older ones would each give a row without an item
    rows = found.collect()
    assert {r.snapshot for r in rows} == set(sorted(bodies)[-2:]) and all(r.ord is not None for r in rows) and len(rows) == 40
    assert found.rdd.getNumPartitions() == 2
    split = spark.read.format("snapshot_documents").option("newest", 1).option("range_bytes", 300).load(str(tmp_path))
    assert split.rdd.getNumPartitions() > 2
    assert sorted((r.ord, r.roaster) for r in split.collect()) == [(i, x["roaster"]) for i, x in enumerate(bodies[max(bodies)])]
    assert documents.read_documents(spark, str(tmp_path)).where("ord IS NULL").count() == 98


def test_round_trip(spark, tmp_path):
    rows = [("2026-01", i, f"r{i}", 'x "y"' if i else None) for i in range(5)] + [("2026-02", 0, "z", "")]
    items = spark.createDataFrame(rows, "snapshot string, ord int, roaster string, bean_name string")
    from pyspark.sql import functions as F
    from shelf.schemas import ITEM_COLUMNS

    items = items.withColumns({c: F.lit("") for c in ITEM_COLUMNS if c not in items.columns})
    made = files.write_documents(items, str(tmp_path / "out")).collect()
    assert sorted(tuple(r) for r in made) == [("list_2026-01.json", 5), ("list_2026-02.json", 1)]
    got = sorted((r.generated_at, r.ord, r.roaster, r.bean_name) for r in documents.read_documents(spark, str(tmp_path / "out")).collect())
    assert got == sorted(rows, key=lambda r: r[:2])


def test_empty_folder(spark, tmp_path):
    assert documents.read_documents(spark, str(tmp_path)).count() == 0
