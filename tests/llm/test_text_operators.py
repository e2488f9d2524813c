import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from gaugewell.llm import components, decontamination, phrases, recompression, secrets, simhash, tokens
from gaugewell.llm.texts import Words, utf8
from gaugewell.session import configure

ATOMS = ["password", "passwd", "secret", "Token", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "abcdef12", "a",
         "AKIA", "AKIA1234567890ABCD", "0123456789abcdef" * 2, "deadbeef", "é", "\n", ",", "ghp_" + "A1b2" * 9,
         "eyJabcdefghij", ".eyJ", ".", "abcdefghijklmnopqrstu", "-----BEGIN RSA PRIVATE KEY-----", "xoxb-", "1234-5678901234567"]


def plain_findings(text):
    out = []
    for number, rule in enumerate(secrets.RULES):
        for match in re.finditer(rule.pattern, text, (re.I if rule.fold else 0) | re.A):
            if len(match[rule.group]) >= rule.least:
                out.append((match.start(), number, match.end()))
    return [(secrets.RULES[n].kind, s, e) for s, n, e in sorted(out)]


def test_secrets_are_those_of_the_patterns(documents, edge_cases, no_documents):
    draw = random.Random(1)
    texts = ["".join(draw.choice(ATOMS) for _ in range(draw.randint(0, 30))) for _ in range(1500)]
    texts.append("x" * 50_000 + " token=" + "a" * 60_000 + ":b")
    texts.append("token=secret:" + "a" * 20_000)  # the second key is inside the dropped finding
    found = secrets.find_secrets(documents(list(enumerate(texts)))).collect()
    for row in found:
        assert [(f.kind, f.start, f.end) for f in row.findings] == plain_findings(texts[row.doc_id])
    assert {r.doc_id: r.n_assign for r in secrets.digests(secrets.find_secrets(edge_cases)).collect()}[1] == 0
    assert secrets.find_secrets(edge_cases).count() == 12
    assert secrets.find_secrets(no_documents).count() == 0


def test_redaction_keeps_rows_and_columns(documents, edge_cases, no_documents):
    docs = documents([(1, "é token=abcdefgh12345 end"), (2, "clean"), (3, None)])
    rows = {r.doc_id: r for r in secrets.redact_secrets(docs).collect()}
    assert rows[1].text == "é [secret] end" and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text == "clean" and rows[3].text is None
    out = secrets.redact_secrets(edge_cases)
    assert out.columns == edge_cases.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, edge_cases.collect()))
    assert secrets.redact_secrets(no_documents).count() == 0


def plain_repeats(texts, window):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("vocabulary, window", [(3, 6), (40, 9), (4000, 35)])
def test_repeats_are_those_of_all_windows(documents, vocabulary, window):
    draw = random.Random(vocabulary)
    passages = [" ".join(f"w{draw.randrange(vocabulary)}" for _ in range(draw.randint(5, 90))) for _ in range(12)]
    texts = []
    for _ in range(120):
        parts = [draw.choice(passages) if draw.random() < 0.4 else
                 " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(draw.randint(0, 60))) for _ in range(draw.randint(0, 5))]
        texts.append("\n".join(parts))
    texts += texts[:5] + ["la " * 200, "ab cd " * 60, None, ""]
    rows = recompression.remove_repeats(documents(list(enumerate(texts))), window).collect()
    assert len(rows) == len(texts)
    expected = plain_repeats(texts, window)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == dict(enumerate(expected))


def thue_morse(length):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(length))


def test_words_of_equal_quick_hashes_are_told_apart(documents):
    """Words that sums weighted by powers of any odd number modulo 2 ** 64 cannot tell apart."""
    rest = " ".join(f"w{i}" for i in range(34))
    texts = []
    for length in (1024, 2048):
        one = thue_morse(length)
        texts += [f"{one} {rest}{length}", f"{one.translate(str.maketrans('ab', 'ba'))} {rest}{length}"]
    rows = recompression.remove_repeats(documents(list(enumerate(texts)))).collect()
    assert [r.n_removed for r in rows] == [0, 0, 0, 0]


def test_windows_are_verified_by_their_words(documents, monkeypatch):
    """With names that mean nothing, and many blocks that all hold one passage, the result is that of all windows."""
    draw = random.Random(21)
    common = " ".join(f"c{i}" for i in range(50))
    texts = []
    for i in range(150):
        own = [" ".join(f"w{draw.randrange(3000)}" for _ in range(draw.randint(0, 120))) for _ in range(2)]
        texts.append(f"{own[0]} {common} {own[1]}")
    monkeypatch.setattr(recompression, "BLOCK_BYTES", 4000)
    rows = recompression.remove_repeats(documents(list(enumerate(texts)))).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == dict(enumerate(plain_repeats(texts, 35)))
    words = Words(*utf8(pa.array(["a  b\tc", "b c d", "", "c"])))
    digests = recompression.window_digests(words, np.array([0, 1, 3]), 2)
    assert [bytes(d.tobytes()) for d in digests] == [hashlib.blake2b(t, digest_size=16).digest() for t in (b"a b", b"b c", b"b c")]


def test_repeats_of_edge_cases(edge_cases, no_documents):
    rows = recompression.remove_repeats(edge_cases).collect()
    assert len(rows) == 12
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4].n_removed == by_id[5].n_removed == 60_000 and by_id[1].n_words == 0 and by_id[6].n_removed == 0
    assert recompression.remove_repeats(no_documents).count() == 0


def plain_fingerprint(text):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    words = (text or "").encode().translate(lower).split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("tile", [7, 1 << 15])
def test_classes_are_those_of_all_pairs(documents, tile):
    draw = random.Random(4)
    texts = [None, "", "One two", "one  TWO", "one\ntwo three"]
    for _ in range(60):
        words = [f"w{draw.randrange(300)}" for _ in range(draw.randint(3, 120))]
        texts.append(" ".join(words))
        for _ in range(draw.randint(0, 3)):
            words = list(words)
            words[draw.randrange(len(words))] = "changed"
            texts.append(draw.choice([" ", "  "]).join(words))
    prints = np.array([plain_fingerprint(t) for t in texts], np.uint64)
    component = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            near = np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 4)
            component[i] = min(component[j] for j in near)
    rows = simhash.near_duplicates(documents(list(enumerate(texts))), tile=tile).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {
        i: (f"{int(p):016x}", c) for i, (p, c) in enumerate(zip(prints, component))}
    kept = simhash.drop_near_duplicates(documents(list(enumerate(texts))), tile=tile)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(component))


def test_classes_of_edge_cases(edge_cases, no_documents):
    rows = simhash.near_duplicates(edge_cases).collect()
    assert len(rows) == 12
    assert {r.doc_id: r.component_id for r in rows if r.doc_id} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 9}
    kept = simhash.drop_near_duplicates(edge_cases)
    assert kept.columns == edge_cases.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 6, 7, 8, 9]
    assert simhash.near_duplicates(no_documents).count() == simhash.drop_near_duplicates(no_documents).count() == 0


def test_a_node_of_many_edges_is_split(llm, tmp_path):
    """All edges share one centre; the joins of a round are between two plain shuffles, so that adaptive execution splits it."""
    llm.range(1, 60_000).selectExpr("id as a", "0L as b").write.parquet(f"{tmp_path}/edges")
    edges = llm.read.parquet(f"{tmp_path}/edges")
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in settings.items():
        llm.conf.set(name, value)
    try:
        star = components._large_star(edges)
        assert star.count() == 59_999
        star.collect()
        plan = star._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan, plan
    finally:
        for name in settings:
            llm.conf.unset(name)
        configure(llm)


def test_links_in_a_tile_are_stars_not_pairs():
    near = np.array([1 << b for b in range(40)], np.uint64)
    member, centre = simhash.links(near, None, 4)
    assert len(member) == 39 and set(centre.tolist()) == {1}
    member, centre = simhash.links(near[:20], near[20:], 4)
    assert len(member) == 39


def edited_item(text, edits, draw):
    words = text.split()
    for _ in range(edits):
        at, kind = draw.randrange(len(words)), draw.randrange(3)
        if kind == 0:
            words[at] = f"q{draw.randrange(999)}"
        elif kind == 1:
            words.insert(at, f"r{draw.randrange(999)}")
        else:
            words.pop(at)
    return " ".join(words)


def plain_contamination(texts, items, share=decontamination.EDIT_SHARE):
    """The items of each text by the distance to its nearest passage of any length."""
    words = lambda t: re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [words(i) for i in items]
    return [{n for n, item in enumerate(own) if item and passage_distance(item, words(t)) <= int(share * len(item))} for t in texts]


@pytest.mark.parametrize("block_bytes", [600, 8 << 20])
def test_contamination_is_found_up_to_edits(llm, documents, edge_cases, no_documents, block_bytes):
    draw = random.Random(9)
    word = lambda: f"w{draw.randrange(500)}"
    items = [" ".join(word() for _ in range(draw.randint(8, 40))) for _ in range(12)] + ["", items_repeat := "same words here again " * 3, items_repeat]
    texts = [None, ""]
    for _ in range(150):
        item = draw.choice(items[:12])
        edited = edited_item(item, draw.randint(0, len(item.split()) // 3), draw)
        base = [word() for _ in range(draw.randint(0, 80))]
        at = draw.randint(0, len(base))
        texts.append(" ".join([*base[:at], edited.upper() if draw.random() < 0.3 else edited + "!", *base[at:]]))
    benchmark = llm.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontamination.contamination(documents(list(enumerate(texts))), benchmark, block_bytes=block_bytes).collect()
    expected = plain_contamination(texts, items)
    assert len(rows) == len(texts)
    missed = sum(len(expected[r.doc_id] - set(r.item_ids)) for r in rows)
    assert not any(set(r.item_ids) - expected[r.doc_id] for r in rows)
    reached = decontamination.expected_recall(benchmark, block_bytes=block_bytes).collect()
    assert {r.words for r in reached} == {len(i.split()) for i in items if i} and all(0.95 < r.recall <= 1 for r in reached)
    assert missed <= 0.01 * sum(map(len, expected)) and sum(map(len, expected)) > 50
    kept = decontamination.drop_contaminated(documents(list(enumerate(texts))), benchmark, block_bytes=block_bytes).collect()
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in rows if not r.contaminated)
    assert decontamination.contamination(edge_cases, benchmark, block_bytes=block_bytes).where("not contaminated").count() == 12
    assert decontamination.contamination(no_documents, benchmark, block_bytes=block_bytes).count() == 0
    none = benchmark.limit(0)
    assert decontamination.contamination(edge_cases, none).where("n_items = 0").count() == 12
    assert decontamination.drop_contaminated(edge_cases, none).count() == 12


def passage_distance(item, words):
    """Edits from the item to the nearest run of the words, of any length."""
    row = [0] * (len(words) + 1)
    for number, own in enumerate(item, 1):
        now = [number]
        for at, word in enumerate(words, 1):
            now.append(min(row[at] + 1, now[-1] + 1, row[at - 1] + (own != word)))
        row = now
    return min(row)


@pytest.mark.parametrize("block_bytes", [600, 8 << 20])
def test_passages_that_gained_or_lost_words_are_found(llm, documents, block_bytes):
    draw = random.Random(12)
    items = [[f"w{draw.randrange(900)}" for _ in range(n)] for n in (5, 8, 10, 15, 20, 20, 30, 45)]
    texts = []
    for number in range(240):
        item = draw.choice(items)
        edited, kinds = list(item), ("insert", "delete", "either")[number % 3]
        for _ in range(len(item) // 5 + (number % 4 == 0)):
            if kinds == "insert" or kinds == "either" and draw.random() < 0.5:
                edited.insert(draw.randrange(len(edited) + 1), f"x{draw.randrange(900)}")
            else:
                edited.pop(draw.randrange(len(edited)))
        before, behind = ([f"y{draw.randrange(900)}" for _ in range(draw.choice([0, 1, 3, 60]))] for _ in range(2))
        texts.append([*before, *edited, *behind])
    benchmark = llm.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    docs = documents([(i, " ".join(t)) for i, t in enumerate(texts)])
    rows = decontamination.contamination(docs, benchmark, block_bytes=block_bytes).collect()
    expected = [{i for i, item in enumerate(items) if passage_distance(item, t) <= len(item) // 5} for t in texts]
    assert len(rows) == len(texts) and sum(map(len, expected)) > 150
    assert not any(set(r.item_ids) - expected[r.doc_id] for r in rows)
    assert sum(len(expected[r.doc_id] - set(r.item_ids)) for r in rows) <= 1
    kept = decontamination.drop_contaminated(docs, benchmark, block_bytes=block_bytes).collect()
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in rows if not r.contaminated)


@pytest.mark.parametrize("block_bytes", [1, 8 << 20])
def test_items_without_id_are_searched(llm, documents, edge_cases, no_documents, block_bytes):
    items = [(None, "one two three four five"), (7, "six seven eight"), (None, "nine ten eleven"), (7, "nine ten eleven"), (3, None)]
    benchmark = llm.createDataFrame(items, "item_id long, text string")
    texts = [(1, "so one two three four five"), (2, "six seven eight nine ten eleven"), (3, "six seven"), (4, None)]
    rows = decontamination.contamination(documents(texts), benchmark, block_bytes=block_bytes).collect()
    assert {r.doc_id: (r.contaminated, r.n_items, r.item_ids) for r in rows} == {
        1: (True, 1, [None]), 2: (True, 3, [None, 7, 7]), 3: (False, 0, []), 4: (False, 0, [])}
    kept = decontamination.drop_contaminated(documents(texts), benchmark, block_bytes=block_bytes).collect()
    assert sorted(r.doc_id for r in kept) == [3, 4]
    assert decontamination.contamination(edge_cases, benchmark, block_bytes=block_bytes).where("not contaminated").count() == 12
    assert decontamination.contamination(no_documents, benchmark, block_bytes=block_bytes).count() == 0
    assert decontamination.contamination(edge_cases, benchmark.limit(0)).where("n_items = 0").count() == 12
    assert decontamination.drop_contaminated(edge_cases, benchmark.limit(0)).count() == 12


@pytest.mark.parametrize("block_bytes", [1, 8 << 20])
def test_each_row_is_judged_alone(llm, documents, block_bytes):
    """Rows of one id, of which some hold an item, whatever the number of blocks; ids may be texts."""
    items = [("x", "one two three four five"), ("y", "six seven eight nine ten"), (None, "alpha beta gamma delta")]
    benchmark = llm.createDataFrame(items, "item_id string, text string")
    texts = [(1, "nothing here"), (1, "so one two three four five"), (1, "six seven eight nine ten one two three four five"), (None, "alpha beta gamma delta"), (None, None)]
    docs = documents(texts)
    rows = decontamination.contamination(docs, benchmark, block_bytes=block_bytes).collect()
    assert sorted((str(r.doc_id), r.contaminated, r.n_items, tuple(r.item_ids)) for r in rows) == [
        ("1", False, 0, ()), ("1", True, 1, ("x",)), ("1", True, 2, ("x", "y")), ("None", False, 0, ()), ("None", True, 1, (None,))]
    kept = decontamination.drop_contaminated(docs, benchmark, block_bytes=block_bytes).collect()
    assert sorted(str(r.text) for r in kept) == ["None", "nothing here"]
    plan = decontamination.contamination(docs, benchmark, block_bytes=block_bytes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Aggregate" not in plan


ALL = (1 << 64) - 1


def plain_mix(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & ALL
    x ^= x >> 29
    x = x * 0xC4CEB9FE1A85EC53 & ALL
    return x ^ x >> 32


def plain_weight(seed, i):
    return plain_mix((i * 0x9E3779B97F4A7C15 + seed) & ALL) | 1


def plain_sketch(text):
    """The parse by its definition, symbol by symbol."""
    lowest = lambda x: (x & -x).bit_length() - 1 if x else 0
    symbols, kept, bits = list((text or "").encode()), set(), 8
    for level in (1, 2, 3):
        runs = []
        for symbol in symbols:
            if runs and runs[-1][0] == symbol:
                runs[-1][1] += 1
            else:
                runs.append([symbol, 1])
        labels, top = [], (1 << bits) - 1
        for i, (symbol, _) in enumerate(runs):
            place = lowest(symbol ^ (runs[i - 1][0] if i else ~symbol & top))
            labels.append(2 * place + (symbol >> place & 1))
        for _ in range(3):
            tossed = []
            for i, label in enumerate(labels):
                place = lowest(label ^ (labels[i - 1] if i else ~label & 255))
                tossed.append(2 * place + (label >> place & 1))
            labels = tossed
        names = [plain_mix((symbol + count * 0xD6E8FEB86659FD93) & ALL) for symbol, count in runs]
        begins = [i for i in range(len(names)) if i == 0 or labels[i] > labels[i - 1] and (i + 1 == len(labels) or labels[i] >= labels[i + 1])]
        symbols, bits = [], 64
        for low, high in zip(begins, [*begins[1:], len(names)]):
            total = sum(n * plain_weight(phrases._NAME, k) for k, n in enumerate(names[low:high]))
            symbols.append(plain_mix((total + (high - low) * 0xA24BAED4963EE407) & ALL))
        if level > 1:
            kept |= {plain_mix((s + level) & ALL) >> 32 for s in symbols}
    return sorted(kept)[:64]


def plain_likeness(a, b):
    both = sorted({*a, *b})[:64]
    return sum(n in a and n in b for n in both) / len(both) if both else 1.0


def plain_hex(sketch):
    return "".join(f"{n:08x}" for n in sketch)


def test_fingerprints_follow_the_content(documents, edge_cases, no_documents):
    draw = random.Random(6)
    texts = [" ".join(f"w{draw.randrange(5000)}ü" for _ in range(draw.randint(0, 400))) for _ in range(80)] + [None, "", "a", "ab" * 500, "aaa" * 90, "\0\0x"]
    rows = phrases.edited_likeness(documents(list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    sketches, order = [plain_sketch(t) for t in texts], [t or "" for t in reversed(texts)]
    for row in rows:
        text = texts[row.doc_id] or ""
        behind = order[(len(texts) - row.doc_id) % len(texts)]
        edited = text[:len(text) - len(text) // 2] + behind[:len(text) // 2]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, other = sketches[row.doc_id], plain_sketch(edited)
        assert row.fingerprint == plain_hex(own) and row.edited_fingerprint == plain_hex(other)
        assert row.near_edited == plain_likeness(own, other) and row.near_next == plain_likeness(own, plain_sketch(behind))
        if len(text) > 1000:
            assert row.near_edited > 0.1 > row.near_next
    edge = phrases.edited_likeness(edge_cases).collect()
    prints = {r.id: r.fingerprint for r in phrases.fingerprints(edge_cases.drop("id").withColumnRenamed("doc_id", "id"), "id").collect()}
    assert len(edge) == 12 and all(0 <= r.near_next <= 1 for r in edge) and prints[4] == prints[5] and prints[1] == ""
    assert phrases.edited_likeness(no_documents).count() == 0
    single = phrases.edited_likeness(documents([(3, "just one text of some length")])).collect()[0]
    assert single.near_next == 1.0
    with pytest.raises(TypeError):
        phrases.edited_likeness(edge_cases.withColumn("doc_id", edge_cases.text))


def test_rows_of_one_id_are_dealt_to_many_tasks(llm, documents):
    """A third of the rows without id, a third with one id; each row still meets exactly one next row."""
    draw = random.Random(8)
    texts = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {draw.randrange(40)} " * draw.randint(1, 4)) for i in range(900)]
    docs = documents(texts)
    cuts = phrases._cut_places(docs.selectExpr("coalesce(doc_id, -9223372036854775808) as key", "xxhash64(text) as order"), 16)
    hot = Counter(cuts.keys.tolist())
    assert hot[7] > 2 and hot[-(1 << 63)] > 2
    rows = phrases.edited_likeness(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)
    prints = Counter((r.doc_id, r.fingerprint) for r in rows)
    assert prints == Counter((i, plain_hex(plain_sketch(t))) for i, t in texts)
    # the next texts are the texts of all rows, each once
    by_print = {plain_hex(plain_sketch(t)): plain_sketch(t) for _, t in texts}
    assert all(r.near_next in {plain_likeness(by_print[r.fingerprint], s) for s in by_print.values()} for r in rows)


def test_equal_substrings_share_phrases():
    draw = random.Random(3)
    common = "".join(draw.choice("abcdefgh ") for _ in range(3000))
    names = []
    for before in ("", "x", "some other beginning "):
        found = phrases.phrase_names(*utf8(pa.array([before + common])))
        names.append(set(found[1][0].tolist()))
    for other in names[1:]:
        assert len(names[0] & other) >= len(names[0]) - 6


def test_token_trees_count_like_the_tokenizer(documents, edge_cases, no_documents):
    encode = tokens.encoding(tokens.Path(tokens.VOCABULARY).read_bytes(), tokens.PATTERN).encode_ordinary
    draw = random.Random(2)
    atoms = ["", " ", "  ", "\n", "a", "'s", " the", "123", "!!", " é", "日本", "x" * 300, "\n\n  ", " word word", " or "]
    for _ in range(200):
        text = "".join(draw.choice(atoms) for _ in range(draw.randint(0, 300)))
        tree = tokens.TokenTree(text, encode)
        for _ in range(draw.randint(1, 8)):
            start = draw.randint(0, len(text))
            end = min(len(text), start + draw.choice([0, 1, 5, 40, 700]))
            new = draw.choice(atoms)
            tree.replace(start, end, new)
            text = text[:start] + new + text[end:]
            assert tree.count() == len(encode(text)) and tree.length() == len(text)
    units = ["the word ", "это русский текст ", "これは日本語の文章です。とても長い、", "这是一个很长的句子，没有空格。", "यह हिन्दी में है। ", "ภาษาไทยไม่มีช่องว่าง", "1234 5678.", "한국어 문장입니다. "]
    for unit in units:
        text = unit * 2000
        tree = tokens.TokenTree(text, encode)
        for start, end, new in ((8000, 8005, "edit"), (5000, 5000, unit * 900), (6000, 6001, "'s"), (9, 9000, "")):
            tree.encoded = 0
            tree.replace(start, end, new)
            assert 0 < tree.encoded < 4 * tokens.LEAF_CHARACTERS + len(new) + 100 and max(map(len, tree.leaves)) < 3 * tokens.LEAF_CHARACTERS, unit
            text = text[:start] + new + text[end:]
            assert tree.count() == len(encode(text)) and tree.length() == len(text)
    from pyspark.sql import functions as F
    edit = lambda a, b, t: F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end"), F.lit(t).alias("text"))
    edits = F.array(edit(2, 6, "new"), edit(4, 99, None), edit(None, 3, "x"))
    row = tokens.token_counts(documents([(1, "0123456789")]), edits).collect()[0]
    assert (row.n_chars, row.n_edited_chars, row.n_edited_tokens) == (10, 5, len(encode("01new")))
    assert tokens.token_counts(edge_cases, edits).count() == tokens.token_counts(edge_cases).count() == 12
    assert tokens.token_counts(no_documents).count() == 0


def test_words_are_split_at_ascii_white_space_only():
    texts = ["a b  c\x0bd", "", " x ", "　"]
    words = Words(*utf8(pa.array(texts)))
    assert np.diff(words.bounds).tolist() == [len(t.encode().split()) for t in texts]
