"""Embedding classes, prefix tries and spelling variants against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gaugewell.llm import embeddings, prefixes, spelling


# ------------------------------------------------------------------ embeddings


def plain_near(rows, threshold):
    """(id, links, least id, kept) per row from all pairs."""
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v) / max(abs(x) for x in v)
        return v / np.linalg.norm(v)
    units = [unit(v) for _, v in rows]
    near = [[j for j, b in enumerate(units) if i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= threshold]
            for i, a in enumerate(units)]
    component = list(range(len(rows)))
    for start in range(len(rows)):
        reached, todo = {start}, [start]
        while todo:
            for j in near[todo.pop()]:
                if j not in reached:
                    reached.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in reached if rows[j][0] is not None]
        component[start] = min(ids) if ids else None
    return Counter((rows[i][0], len(near[i]), component[i], component[i] == rows[i][0]) for i in range(len(rows)))


def found_near(frame, **options):
    found = embeddings.near_vectors(frame, **options)
    assert found.columns == [frame.columns[0], "n_links", "component_id", "kept"]
    return Counter(map(tuple, found.collect()))


@pytest.fixture(scope="session")
def vectors(llm):
    draw = np.random.default_rng(5)
    rows, number = [], 0
    for _ in range(60):
        centre = draw.normal(size=24) * np.linspace(2, 0.2, 24)
        for _ in range(int(draw.integers(1, 9))):
            vector = centre + draw.normal(size=24) * draw.choice([0.01, 0.1, 0.3])
            rows.append((number, (vector * draw.choice([1, 30])).tolist()))
            number += 1
    # a chain, in which the ends are far apart
    for k in range(12):
        rows.append((number + k, [float(np.cos(k * 0.4)), float(np.sin(k * 0.4))] + [0.0] * 22))
    return rows


@pytest.mark.parametrize("tiles, least_tile, tile_bytes, threshold", [(12, 1024, 32 << 20, 0.9), (7, 9, 32 << 20, 0.9), (3, 1000, 24 * 8 * 20, 0.99)])
def test_links_are_those_of_all_pairs(llm, vectors, tiles, least_tile, tile_bytes, threshold):
    frame = llm.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(4)
    found = found_near(frame, threshold=threshold, tiles=tiles, least_tile=least_tile, tile_bytes=tile_bytes)
    assert found == plain_near(vectors, threshold)


def test_vectors_of_edge_cases(llm):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, -0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]),
            (8, [1e200, -0.0]), (9, [1e-300, 0.0]), (None, [1.0, 0.001]), (None, [0.0, 1.0]), (None, None), (10, [1.0, 0.0, 0.0]),
            (11, [2.0]), (12, [-1.0]), (-5, [3.0]), (13, [1.0, 0.0]), (13, [-1.0, 0.0])]
    frame = llm.createDataFrame([(i, v, None, "x") for i, v in rows], "vec_id long, embedding array<double>, n_links int, `key` string")
    assert found_near(frame) == plain_near(rows, 0.9)
    assert found_near(frame.limit(0)) == Counter()
    assert found_near(llm.createDataFrame([("b", [1.0]), ("a", [2.0]), ("c", None)], "vec_id string, embedding array<float>")) == Counter(
        [("b", 1, "a", False), ("a", 1, "a", True), ("c", 0, "c", True)])


def test_copies_and_near_copies_of_a_third_of_the_rows(llm):
    draw = np.random.default_rng(8)
    rows = [(i, [1.0, 0.0, 0.0, 0.0] if i < 200 else [0.0, 1.0, float(draw.normal()) * 0.01, 0.0] if i < 400 else draw.normal(size=4).tolist()) for i in range(600)]
    frame = llm.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert found_near(frame, tiles=5, least_tile=16) == plain_near(rows, 0.9)


def test_bound_leaves_few_pairs_and_loses_none():
    draw = np.random.default_rng(3)
    units = embeddings.scaled([v.tobytes() for v in draw.normal(size=(700, 64)) * np.linspace(3, 0.1, 64)])
    units[100:140] = embeddings.scaled([v.tobytes() for v in units[:40] + 0.02 * draw.normal(size=(40, 64))])
    axes = np.linalg.eigh(units.T @ units)[1][:, ::-1].copy()
    found = {(int(i), int(j)) for x, y in embeddings.links(units, None, axes, 0.9) for i, j in zip(x, y)}
    assert found == {(i, j) for i, j in np.argwhere(units @ units.T >= 0.9).tolist() if i < j}


# ------------------------------------------------------------------ prefix tries


def turn_order(row):
    _, turn, role, text = row
    whole = f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()
    return turn is not None, turn or 0, hashlib.sha256(whole).digest()[:16]


def plain_trie(rows):
    own = defaultdict(list)
    for row in sorted((r for r in rows if r[0] is not None), key=turn_order):
        own[row[0]].append((row[2] or "", row[3] or ""))
    whole = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        base = conv - int(np.fmod(conv, 5))
        whole[conv] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
        ends[turns].append(conv)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


CONVERSATION = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="session")
def conversations():
    draw = random.Random(6)
    openings = [[("system", "be kind")], [("system", "be kind"), ("user", "hello é")], [("user", "hi")], []]
    rows = []
    for conv in [*range(-12, 150), 900, 903]:
        if draw.random() < 0.08:
            continue
        turns = [*draw.choice(openings), *((draw.choice(["user", "assistant"]), f"t{draw.randrange(4)}") for _ in range(draw.randint(1, 9)))]
        rows += [(conv, k, *t) for k, t in enumerate(turns)]
    for conv in range(200, 260):  # a large group of equal ones, of which long parts stay after rebuilding
        rows += [(conv, k, "user", f"same {k}") for k in range(12)]
    rows += [(300, k, "user", f"long {k % 3}") for k in range(300)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns", [1, 40])
def test_trie_is_that_of_all_prefixes(llm, conversations, shard_turns):
    frame = llm.createDataFrame(conversations, CONVERSATION).repartition(3)
    found = prefixes.prefix_trie(frame, shard_turns=shard_turns)
    assert found.columns == [f.split()[0] for f in prefixes.NODE.split(", ")]
    assert Counter(map(tuple, found.collect())) == plain_trie(conversations)


def test_trie_of_edge_cases(llm):
    rows = [(None, 1, "user", "nobody's"), (5, None, "user", None), (5, None, None, "x"), (5, 1, "user", "a"), (5, 1, "user", "a"), (5, 1, "user", ""),
            (6, 0, "", ""), (6, 1, None, None), (7, 3, "user", "y" * 300_000), (8, 0, "a", "bc"), (9, 0, "ab", "c"), (-3, 7, "user", "z"), (13, 0, "user", "alone")]
    frame = llm.createDataFrame([(*r, None, 1) for r in rows], CONVERSATION + ", depth string, n_convs int").repartition(2)
    assert Counter(map(tuple, prefixes.prefix_trie(frame).collect())) == plain_trie(rows)
    assert prefixes.prefix_trie(frame.limit(0)).count() == 0
    with pytest.raises(TypeError):
        prefixes.prefix_trie(llm.createDataFrame([("a", 1, "user", "x")], "conv_id string, turn long, role string, text string"))


def test_conversations_without_turns_end_in_the_root(llm):
    # the base conversation is absent and all own turns are replaced
    ids = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 3][:20]
    rows = [(c, 0, "user", "gone") for c in ids]
    found = prefixes.prefix_trie(llm.createDataFrame(rows, CONVERSATION)).collect()
    assert len(found) == 1 and found[0].depth == 0 and found[0].n_convs == 20 and found[0].n_leaves == 1
    assert found[0].ends_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_double_array_holds_its_sequences_and_no_other():
    draw = random.Random(2)
    sequences = sorted({tuple(draw.randint(1, 30) for _ in range(draw.randint(0, 6))) for _ in range(400)})
    trie = prefixes.DoubleArray([np.array(s, np.int64) for s in sequences])
    known = {s[:d] for s in sequences for d in range(len(s) + 1)}
    at = {(): 0}
    for s in sorted(known, key=len):
        if s:
            at[s] = int(trie.step(np.array([at[s[:-1]]]), np.array([s[-1]]))[0])
    assert len(set(at.values())) == len(known)
    for s in sorted(known)[:50]:
        for code in range(1, 31):
            if (*s, code) not in known:
                with pytest.raises((KeyError, IndexError)):
                    trie.step(np.array([at[s]]), np.array([code]))


# ------------------------------------------------------------------ spelling


def plain_variants(rows):
    count = Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    n = {w: c for w, c in count.items() if c >= 3 and len(w) >= 5}
    cuts = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            cuts[i, w[:i] + w[i + 1:]].add(w)
    near = {w: set() for w in n}
    for group in cuts.values():
        for w in group:
            near[w] |= group - {w}
    for w in n:
        for i in range(len(w)):
            if (v := w[:i] + w[i + 1:]) in n:
                near[w].add(v)
                near[v].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def found_variants(frame, **options):
    rows = [tuple(r) for r in spelling.spelling_variants(frame, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="session")
def prose():
    draw = random.Random(12)
    syllables = ["an", "the", "ou", "ré", "ñi", "st", "er", "x", "÷o", "Öl", "que"]
    known = ["".join(draw.choice(syllables) for _ in range(draw.randint(2, 6))) for _ in range(400)]

    def word():
        w = known[min(int(draw.expovariate(0.01)), 399)]
        if draw.random() < 0.15:
            i, kind = draw.randrange(len(w)), draw.randrange(3)
            w = w[:i] + [draw.choice("aeéz"), "", w[i] + draw.choice("aeéz")][kind] + w[i + 1:]
        return w.upper() if draw.random() < 0.05 else w
    return [(i, draw.choice([" ", "-", "1", "漢", "ÿ ", "Ā"]).join(word() for _ in range(draw.randint(0, 300)))) for i in range(120)]


@pytest.mark.parametrize("groups, most", [(16, 20), (28, 7)])
def test_variants_are_those_of_all_pairs(documents, prose, groups, most):
    expected = plain_variants(prose)
    assert len(expected) > 400 and sum(r[1] is not None for r in expected) > 100
    assert found_variants(documents(prose), groups=groups, most=most) == expected


def test_variants_of_edge_cases(documents, edge_cases, no_documents):
    long = "ab" * 40_000
    rows = [(None, "straße straße strasse Straße"), (1, None), (2, ""), (3, "12 34 ÷÷÷ ×"), (4, f"{long} {long} {long} {long}x {long}x {long}x {long}x"),
            (5, "abcde abcde abcde abcdf abcdf abcdf abcdg abcdg abcdg"), (6, "twins twins"), (6, "twins twins"),
            (7, "Ünïte ünïte ÜnÏte ünïtes ünïtes ünïtes ünïtes ünïtes ünïtes"), (8, "x" * 300 + " " + "x" * 301), (9, ("x" * 300 + " ") * 5 + ("x" * 301 + " ") * 12)]
    assert found_variants(documents(rows)) == plain_variants(rows)
    plain = [(r.doc_id, r.text) for r in edge_cases.collect()]
    assert found_variants(edge_cases) == plain_variants(plain)
    assert found_variants(no_documents) == set()


def test_runs_of_bytes_have_their_checksums():
    draw = random.Random(1)
    parts = [bytes(draw.randrange(256) for _ in range(draw.choice([0, 1, 5, 20, 63, 64, 65, 200]))) for _ in range(300)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    lengths = np.array([len(p) for p in parts])
    before = np.array([draw.randrange(1 << 32) for _ in parts], np.uint32)
    found = spelling.crc32(data, np.cumsum(lengths) - lengths, lengths, before)
    assert found.tolist() == [zlib.crc32(p, int(b)) for p, b in zip(parts, before)]
