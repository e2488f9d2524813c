import base64
import hashlib
import os
import random
import subprocess
import sys
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugewell.llm import mixing, models, quality, toxicity, warc
from gaugewell.llm.texts import table, utf8
from gaugewell.session import scratch_path

TABLES, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_quality_of_held_out_documents(llm, edge_cases, no_documents):
    docs, labels = table(llm, TABLES, "documents"), table(llm, TABLES, "labels")
    scores = quality.quality_scores(docs, labels)
    assert scores.count() == docs.count()
    right = scores.join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.93
    row = scores.agg(F.min("score"), F.max("score"), F.sum((F.col("predicted") != (F.col("score") >= 0.3).cast("int")).cast("int"))).first()
    assert 0 <= row[0] and row[1] <= 1 and row[2] == 0
    assert quality.quality_scores(edge_cases, labels).where("score between 0 and 1").count() == 12
    assert quality.quality_scores(no_documents, labels).count() == 0
    assert {r.score for r in quality.quality_scores(edge_cases, labels.limit(0)).collect()} == {0.5}
    nulls = labels.select("doc_id", F.lit(None).cast("int").alias("quality"))
    assert {r.score for r in quality.quality_scores(edge_cases, nulls).collect()} == {0.5}


def test_toxic_documents_are_found_and_graded(llm, edge_cases, no_documents):
    docs, labels = table(llm, LARGER, "documents"), table(llm, LARGER, "labels")
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "marked")
    found = toxicity.toxicity(docs, train)
    assert found.count() == docs.count()
    seen = Counter((r.marked, r.toxic) for r in found.join(test, "doc_id").collect())
    assert seen[0, True] <= 0.01 * seen[0, False] and seen[1, True] >= 0.75 * (seen[1, True] + seen[1, False])
    order = found.groupBy("grade").agg(F.avg("severity").alias("s")).orderBy("grade").collect()
    assert [r.s for r in order] == sorted(r.s for r in order) and len(order) > 2
    assert toxicity.toxicity(edge_cases, labels).count() == 12
    assert toxicity.toxicity(no_documents, labels).count() == 0
    assert toxicity.toxicity(edge_cases, labels.limit(0)).where("toxic").count() == 0
    kept = toxicity.drop_toxic(edge_cases, docs, labels)
    assert kept.columns == edge_cases.columns and kept.count() == 12


def test_training_holds_few_copies_of_the_sample():
    draw, rows, each = np.random.default_rng(3), 3000, 1500
    labels = draw.integers(0, 2, rows)
    table = pa.table({
        "label": pa.array(labels, pa.int32()),
        "buckets": [np.sort(draw.choice(1 << 14, each, False)).astype(np.int32).tobytes() for _ in range(rows)],
        "vals": [np.ones(each, np.float32).tobytes()] * rows})
    held = rows * each * 8  # bytes of the pairs
    tracemalloc.start()
    order = np.arange(rows)[::-1]
    bounds, buckets = models.gathered(table.column("buckets"), order, np.int32)
    values = models.gathered(table.column("vals"), order, np.float32)[1]
    found = toxicity.supported(models.Sparse(bounds, buckets, values))
    assert tracemalloc.get_traced_memory()[1] < 3 * held
    assert np.array_equal(found.buckets, buckets) and found.bounds.tolist() == bounds.tolist()
    assert buckets[:each].tobytes() == table["buckets"][rows - 1].as_py()
    del buckets, values, bounds
    tracemalloc.reset_peak()
    grades = toxicity.grades(labels[::-1], found, 4)
    # the table of all features counts, too
    assert tracemalloc.get_traced_memory()[1] < held + 100_000_000
    tracemalloc.stop()
    assert (grades > 0).tolist() == (labels[::-1] > 0).tolist()


def test_counts_of_runs_of_rows():
    rows = models.Sparse(np.array([0, 2, 2, 5]), np.array([1, 3, 0, 1, 3], np.int32), np.ones(5))
    assert list(rows.parts(2)) == [(0, 2), (2, 3)] and list(models.Sparse(np.array([0]), rows.buckets[:0], rows.values[:0]).parts()) == []
    assert rows.counts(np.array([True, True, False]), 4).tolist() == [0, 1, 0, 1]
    assert rows.counts(np.ones(3, bool), 4).tolist() == [1, 2, 0, 2]
    packed = pa.chunked_array([pa.array([b"", b"abcd"]), pa.array([b"efghijkl"])]).slice(1)
    bounds, out = models.gathered(packed, np.array([1, 0]), np.uint8)
    assert bounds.tolist() == [0, 8, 12] and out.tobytes() == b"efghijklabcd"


def plain_mix(blocks, shares):
    """{(source, block): (slot, release, deadline)}, cycle by cycle, slot by slot."""
    out, start, cycle = {}, 0, 0
    while any(n > cycle * q for n, q in zip(blocks, shares)):
        inside = [min(max(n - cycle * q, 0), q) for n, q in zip(blocks, shares)]
        slots = sum(inside)
        waiting = [(-(-(k + 1) * slots // m), i, k, k * slots // m) for i, m in enumerate(inside) for k in range(m)]
        for slot in range(slots):
            chosen = min(w for w in waiting if w[3] <= slot)
            waiting.remove(chosen)
            deadline, i, k, release = chosen
            out[i, cycle * shares[i] + k] = (start + slot, start + release, start + deadline)
        start, cycle = start + slots, cycle + 1
    return out


@pytest.mark.parametrize("shipped", [dict(), dict(shipped_sources=0), dict(shipped_entries=0)])
def test_blocks_have_the_places_of_a_plain_scheduler(llm, shipped):
    draw = random.Random(5)
    for case in range(2):
        names = [None, *(f"s{i}" for i in range(draw.randint(3, 9)))]
        shares = {n: draw.randint(1, 5) for n in names if n != "s1"}
        sizes = {n: draw.choice([1, 7, 40, 200]) for n in names}
        docs = llm.createDataFrame([(i, n, "x") for n in names for i in range(sizes[n])], "doc_id long, source string, mix_block string").repartition(3)
        found = mixing.mix_sources(docs, shares, block_documents=4, **shipped).collect()
        order = sorted(names, key=lambda n: (n is None, n or ""))
        expected = plain_mix([-(-sizes[n] // 4) for n in order], [shares.get(n, 1) for n in order])
        by_block = {}
        for r in found:
            by_block.setdefault((r.source, r.mix_block, r.mix_release, r.mix_deadline), []).append(r.mix_position)
        assert sorted((order.index(s), *p) for s, *p in by_block) == sorted((i, *p) for (i, _), p in expected.items())
        assert all(min(p) == k[1] * 4 and len(set(p)) == len(p) and max(p) < k[1] * 4 + 4 for k, p in by_block.items())
        assert len(found) == sum(sizes.values())


def test_every_prefix_is_within_one_block_of_its_weights():
    draw = random.Random(5)
    for _ in range(60):
        shares = [draw.randint(1, 9) for _ in range(draw.randint(1, 8))]
        slots = mixing.cycle(shares)
        assert [slot for _, _, slot, _, _ in slots] == list(range(sum(shares))) and all(release <= slot < deadline for _, _, slot, release, deadline in slots)
        count = [0] * len(shares)
        for t, (source, *_) in enumerate(slots):
            count[source] += 1
            assert all(abs(c - (t + 1) * s / sum(shares)) < 1 for c, s in zip(count, shares))


def test_more_sources_than_tasks_are_given(llm):
    """Some thousand sources of differing sizes, each with a share of its own: nothing is refused."""
    docs = llm.range(9000).selectExpr("id as doc_id", "concat('s', cast(pow(id, 0.9) as int)) as source")
    found = mixing.mix_sources(docs, {"s1": 3}, block_documents=1, shipped_sources=100)
    rows = found.collect()
    assert sorted(r.mix_position for r in rows) == list(range(9000)) and all(r.mix_release <= r.mix_block < r.mix_deadline for r in rows)


def test_every_document_has_one_place(documents, edge_cases, no_documents):
    docs = documents([(i, f"text {i}", "big" if i % 3 else f"s{i % 4}") for i in range(3000)])
    rows = mixing.mix_sources(docs, {"big": 2}, block_documents=8).collect()
    assert len({r.mix_position for r in rows}) == len({r.doc_id for r in rows}) == 3000
    blocks = {}
    for r in rows:
        blocks.setdefault(r.mix_block, set()).add(r.source)
    assert all(len(s) == 1 for s in blocks.values()) and sorted(blocks) == list(range(len(blocks)))
    again = mixing.mix_sources(docs, {"big": 2}, block_documents=8).collect()
    assert {(r.doc_id, r.mix_position) for r in rows} == {(r.doc_id, r.mix_position) for r in again}
    edge = mixing.mix_sources(edge_cases)
    assert edge.count() == 12 and len({r.mix_position for r in edge.collect()}) == 12
    assert set(edge.columns) == {*edge_cases.columns, *mixing.PLACES}
    assert mixing.mix_sources(no_documents).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {"big": 0})


def test_archives_give_back_every_page(llm):
    html = ["<p>" + "é" * 600, "small", None, "", "<b>" * 500]
    pages = [(i, f"http://x/{i}", html[i % 5]) for i in range(60)]
    pages += [(59, "http://again\r\nbad", html[4]), (None, None, html[0]), (None, "http://y", "z" * 2000), (100, "http://z", None)]
    frame = llm.createDataFrame(pages, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash"))
    rows = warc.round_trip(frame).collect()
    largest = {h: max(p for p, _, x in pages if x == h and p is not None) for h in html}
    expected = []
    for page, _, text in pages:
        raw = (text or "").encode()
        away = len(raw) >= 1000 and text in largest and page != largest[text]
        expected.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if away else "response", largest[text] if away else None))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, expected))
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_selected_records_come_with_their_payload(llm):
    folder = "file://" + scratch_path(llm, "warc-test")
    pages = llm.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 50) for i in range(500)], "page_id long, url string, html string")
    index = warc.write_archives(pages, folder, archive_bytes=20_000)
    assert index.select("archive").distinct().count() > 3
    picked = warc.read_archives(index.where("page_id % 7 = 0"), folder, gap_bytes=100).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in picked} == {i: f"page {i} " * 50 for i in range(0, 500, 7)}
    record = warc._record("response", 3, "http://u", hashlib.sha1(b"x").hexdigest(), 1, None, b"x")
    fields, payload = warc._parse(record)
    assert payload == b"x" and fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"x").digest()).decode()
    assert Path(folder.removeprefix("file://")).is_dir()


def test_grades_of_yes_and_no_come_from_the_other_half():
    """A word that marks a single row grades nobody; words that tell rows of both halves grade all that hold them."""
    draw = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        strong = toxic and i % 8 == 0
        rows.append([f"p{draw.randrange(60)}" for _ in range(12)] + (["vile"] if toxic else []) + (["foul", "grim"] if strong else []) + ([f"own{i}"] if toxic else []))
        labels.append(int(toxic))
    found = toxicity.features(*utf8(pa.array([" ".join(r) for r in rows])))
    grade = toxicity.grades(np.array(labels), toxicity.supported(found), 4)
    assert all((g > 0) == bool(y) for g, y in zip(grade.tolist(), labels))
    strong = [g for i, g in enumerate(grade.tolist()) if i % 8 == 0]
    weak = [g for i, g in enumerate(grade.tolist()) if i % 8 == 4]
    assert min(strong) > max(weak)
    assert toxicity.grades(np.array([0, 3, 9, 1]), found, 4).tolist() == [0, 3, 3, 1]


def test_operators_called_from_a_checkout_reach_the_workers(tmp_path):
    """In a process that starts elsewhere, without the settings of this machine and without the registered queries."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from gaugewell.session import local_session
from gaugewell.llm import simhash, secrets, spelling, tokens
spark = local_session("2")
docs = spark.createDataFrame([(1, "some words some words token=abcdefgh12"), (2, "some words some words token=abcdefgh12 token token"), (3, None)], "doc_id long, text string")
assert secrets.find_secrets(docs).count() == 3
assert sorted(r.component_id for r in simhash.near_duplicates(docs).collect()) == [1, 2, 3]
assert tokens.token_counts(docs).count() == 3 and spelling.spelling_variants(docs).count() == 2
print("done")
"""
    (tmp_path / "conf").mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_CONF_DIR": str(tmp_path / "conf")}
    ran = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=400)
    assert ran.stdout.strip().endswith("done"), ran.stderr[-3000:]


def test_archives_of_many_equal_and_null_ids_and_of_long_payloads(llm):
    rows = [(7 if i % 3 else None, f"http://x/{i}", ("same " * 400) if i % 2 else f"own {i} " * 300) for i in range(300)] + [(900, "http://long", "é" * 3_000_000)]
    frame = llm.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    found = warc.round_trip(frame).collect()
    assert Counter(r.payload_digest for r in found) == Counter(hashlib.sha1(h.encode()).hexdigest() for _, _, h in rows)
    assert {r.payload_bytes for r in found if r.page_id == 900} == {6_000_000}
    assert all(r.refers_to == 7 for r in found if r.record_type == "revisit")
    with pytest.raises(TypeError):
        warc.round_trip(frame.withColumn("page_id", F.col("url")))
