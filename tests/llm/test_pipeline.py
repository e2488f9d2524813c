import importlib
import re
from pathlib import Path

from gaugewell.llm import secrets
from gaugewell.llm.queries import QUERIES
from gaugewell.llm.simhash import near_duplicates
from gaugewell.llm.texts import table
from gaugewell.session import scratch_root

corpus_pipeline = importlib.import_module("corpus_pipeline")
TABLES = "/root/testdata/sf0.01"


def test_stages_take_effect_and_keep_clean_documents(llm, tmp_path):
    docs = table(llm, TABLES, "documents")
    labels = {r.doc_id: r.toxic for r in table(llm, TABLES, "labels").collect()}
    items = [" ".join(r.text.lower().split()) for r in table(llm, TABLES, "benchmark").collect()]
    now, seen = docs, []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(llm, now, TABLES)
        after.write.parquet(f"{tmp_path}/{number}")
        after = llm.read.parquet(f"{tmp_path}/{number}")
        seen.append((name, now, after))
        now = after
    ids = lambda frame: [r.doc_id for r in frame.select("doc_id").collect()]
    for name, before, after in seen[:-1]:
        assert after.columns == docs.columns, name

    _, before, after = seen[0]
    kept = set(ids(after))
    assert sum(labels.get(d) == 0 for d in set(ids(before)) - kept) <= 2
    assert sum(labels.get(d) == 1 for d in kept) <= 2

    _, before, after = seen[1]
    classes = {r.doc_id: r.component_id for r in near_duplicates(before).collect()}
    assert sorted(ids(after)) == sorted(set(classes.values()))

    _, before, after = seen[2]
    texts = {r.doc_id: " ".join(r.text.lower().split()) for r in before.collect()}
    gone = set(texts) - set(ids(after))
    assert {d for d, t in texts.items() if any(i in t for i in items)} == gone

    _, before, after = seen[3]
    assert sorted(ids(before)) == sorted(ids(after))
    for row in after.collect():
        for rule in secrets.BASE:
            for match in re.finditer(rule.pattern, row.text, (re.I if rule.fold else 0) | re.A):
                assert len(match[rule.group]) < rule.least
        assert row.n_chars == len(row.text)

    _, before, after = seen[4]
    assert sorted(ids(before)) == sorted(ids(after))
    assert after.select("mix_position").distinct().count() == after.count()


def test_the_whole_run_on_edge_cases(llm, tmp_path, edge_cases, no_documents, documents):
    """Null, empty, very long and repeated rows and columns of clashing names, and empty tables, pass through all stages."""
    labels = llm.createDataFrame([(i, 1, 0) for i in range(9)] + [(None, None, None), (4, 0, 0)], "doc_id long, quality int, toxic int")
    benchmark = llm.createDataFrame([(1, "word1 word2 word3 word4 word5"), (None, None)], "item_id long, text string")
    columns = edge_cases.columns
    for number, (docs, bench, marks) in enumerate([
            (edge_cases, benchmark, labels), (edge_cases, benchmark.limit(0), labels.limit(0)), (no_documents, benchmark, labels),
            (no_documents, benchmark.limit(0), labels.limit(0))]):
        folder = f"{tmp_path}/tables{number}"
        for name, frame in (("documents", docs), ("benchmark", bench), ("labels", marks)):
            frame.write.parquet(f"{folder}/{name}.parquet")
        before = set(Path(scratch_root(llm).removeprefix("file:")).iterdir()) if Path(scratch_root(llm).removeprefix("file:")).exists() else set()
        found = corpus_pipeline.run(llm, folder)
        kept = found.collect()
        if number < 2:
            assert set(found.columns) == {*columns, "mix_block", "mix_position", "mix_release", "mix_deadline"}
            # of equal texts one stays: the least id; no text, an empty one and white space alone are alike
            expected = [0, 1, 6, 7, 8, 9] if number == 0 else [0, 1, 4, 6, 7, 8, 9]
            assert sorted(r.doc_id or 0 for r in kept) == expected
            assert len({r.mix_position for r in kept}) == len(kept)
        else:
            assert kept == []
        left = {p.name.rsplit("-", 1)[0] for p in set(Path(scratch_root(llm).removeprefix("file:")).iterdir()) - before}
        assert left <= {"pipeline", "mixing"}, left
        assert len(list(next(p for p in set(Path(scratch_root(llm).removeprefix("file:")).iterdir()) - before if p.name.startswith("pipeline")).iterdir())) == 1


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))
