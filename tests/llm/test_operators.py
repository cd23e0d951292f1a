"""The training-data operators against brute force, on rows with every awkward case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gearledger.llm import (
    decontamination, huffman, licenses, lines, mixing, neardup, quality, secrets, substrings, tokens, topk,
)
from gearledger.llm.common import prepare, text_mark

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
# Names the operators use inside, and names of other tables' columns.
EXTRA = ["size", "target", "key", "n", "root", "band", "_row", "_score", "_found", "data", "d", "h", "quality", "item_id", "part", "ids"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


def prose(rng, n):
    return " ".join("".join(rng.choice(["ta", "lo", "mi", "re", "su", "ké"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus():
    """Nulls, blanks, copies, near copies, repeated rows and ids, shared passages, one long text."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(20, 120)) for _ in range(24)]
    passage = prose(rng, 40)
    rows = [(i, t, "en", f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [(40 + i, texts[i], "en", "s0") for i in range(4)]
    words = texts[5].split()
    for i in range(6):
        changed = words[:]
        changed[rng.randrange(len(words))] = f"edit{i}"
        rows.append((50 + i, " ".join(changed), "fr", None))
    rows += [(60 + i, f"{prose(rng, 30)}\n{passage}\n{prose(rng, 12)}", "de", "s1") for i in range(4)]
    rows += [(70, None, None, None), (71, "", "en", "s0"), (72, " \n\t ", "en", "s0"), (73, "one two", "en", "s2"),
             (74, "One  TWO", "en", "s2"), (None, texts[1], "en", "s3"), (None, None, "en", "s3"), (None, "lone " + prose(rng, 30), "en", "é")]
    rows += [(75, "ab" * 400, "en", "s3"), (76, "ab" * 90, "en", "s3"), (77, prose(rng, 6000), "en", "s1")]
    rows += [(80, texts[2] + " twin", "en", "s0")] * 3 + [(80, "another text under that id " + prose(rng, 30), "en", "s0")]
    rows += [(81 + i, f"a\n\nb {i}\nc\nd\ne\nlast {i}", "en", "s2") for i in range(3)]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    rows = [(*r, len(r[1] or ""), *["x"] * len(EXTRA)) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], SCHEMA)


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def ordered(rows):
    return sorted(rows, key=repr)


# 1 -------------------------------------------------------------------------------------------

def brute_mix(rows, seed=mixing.SEED):
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    total = Counter()
    for r, n in zip(rows, sizes):
        total[r[3]] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, free, target = sum(sizes), set(names), {}
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * budget > 3 * total[s] * w}
        if not over:
            target |= {s: weight[s] * budget / w for s in free}
            break
        target |= {s: float(3 * total[s]) for s in over}
        budget -= sum(3 * total[s] for s in over)
        free -= over
    cells = defaultdict(Counter)
    cell = lambda d: int(hashlib.md5(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()[:8], 16) >> 2
    for r, n in zip(rows, sizes):
        cells[r[3]][cell(r[0])] += n
    taken_cells = {}
    for s in names:
        whole = int(target[s] // total[s]) if total[s] else 0
        before, need = 0, target[s] - whole * total[s]
        for c in sorted(cells[s]):
            taken_cells[s, c] = whole + (2 * before + cells[s][c] <= 2 * need)
            before += cells[s][c]
    return [(r[0], n, total[r[3]], target[r[3]], n * taken_cells[r[3], cell(r[0])]) for r, n in zip(rows, sizes)]


def test_mixing(docs, none):
    columns = ("doc_id", "size", "source_size", "target", "taken")
    got = tuples(mixing.mixing_report(docs), *columns)
    assert got == ordered(brute_mix(ROWS))
    assert got == tuples(mixing.mixing_report(docs.repartition(5)), *columns)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = sum(n for *_, n in got)
    assert mixed.agg(F.sum(mixing.word_count())).first()[0] == words
    assert mixing.mixing_report(none).count() == 0 and mixing.mix(none).count() == 0


@pytest.mark.parametrize("sizes, weights, epochs", [
    ([100, 100, 100], [5, 2, 1], 3), ([1, 1000, 1000], [9, 1, 1], 2), ([0, 0], [1, 2], 3), ([7], [3], 3),
    ([10, 20, 3000, 5], [100, 50, 1, 1], 3),
])
def test_water_filling(spark, sizes, weights, epochs):
    rows = [(f"0{i}", s, w) for i, (s, w) in enumerate(zip(sizes, weights))]
    filled = mixing.fill(spark.createDataFrame(rows, "_source string, _words long, _weight long"), epochs)
    target = [r._target for r in filled.orderBy("_source").collect()]
    assert sum(target) == pytest.approx(sum(sizes))
    assert all(t <= epochs * s for t, s in zip(target, sizes))
    below = [t / w for t, s, w in zip(target, sizes, weights) if t < epochs * s]
    assert not below or max(below) == pytest.approx(min(below))


# 2 -------------------------------------------------------------------------------------------

def test_top_k(spark):
    prepare(spark)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)], 1) for i in range(400)]
    rows += [(400, None, 1), (450, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (500, [float("nan")] * 6, 1), (550, [float("inf")] * 6, 1),
             (600, [1.0, 2.0], 1), (601, [1.0, 2.0], 1), (650, [], 1), (651, [], 1), (None, rows[3][1], 1), (700, [1e12] * 6, 1)]
    rows += [rows[50], rows[7], (401, rows[8][1], 1), (402, rows[8][1], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, `rank` int").repartition(3)
    whole = [
        (i, tuple(int(np.floor(256 * x)) for x in v)) for i, v, _ in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    want = []
    for q, v in {w for w in whole if w[0] % 50 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, u)), i) for i, u in whole if i != q and len(u) == len(v))
        want += [(q, n + 1, i, min(-s, 2**63 - 1)) for n, (s, i) in enumerate(scored[:5])]
    for shard in (8192, 64):
        got = topk.exact_top_k(vectors, shard_rows=shard, block_rows=3 if shard == 64 else 2048)
        assert tuples(got, "query_id", "rank", "vec_id", "score") == ordered(want)
    assert topk.exact_top_k(vectors.limit(0)).count() == 0


def test_one_bound_cuts_a_branch(monkeypatch):
    """Far clusters are never split: fewer bounds than leaves, and the same answer as all products."""
    rng = np.random.default_rng(4)
    points = rng.integers(-20, 20, (8192, 4)).astype(float)
    points[:, 0] += 1000 * rng.integers(0, 16, 8192)
    ids, vector, asked, bounds = np.arange(len(points)), np.array([9.0, 2.0, -1.0, 1.0]), [], topk.Tree.bounds
    monkeypatch.setattr(topk.Tree, "bounds", lambda tree, nodes, *a: asked.extend(nodes) or bounds(tree, nodes, *a))
    got = topk.search(ids, points, [(-1, vector, topk.LIMIT[0])], 5)
    scores = (points @ vector).astype(int)
    assert [(i, s) for _, i, s in got] == [(i, scores[i]) for i in sorted(ids, key=lambda i: (-scores[i], i))[:5]]
    assert len(asked) < 8192 // topk.LEAF / 2
    tree = topk.Tree(points)
    for node, rows in enumerate(tree.rows):
        assert np.sqrt(((points[rows] - tree.centres[node]) ** 2).sum(axis=1)).max() <= tree.radii[node]
        assert not tree.children[node] or sorted(np.concatenate([tree.rows[c] for c in tree.children[node]])) == sorted(rows)


# 3 -------------------------------------------------------------------------------------------

def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    got = tokens.token_report(docs, VOCABULARY).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda i: (i is None, i or 0))
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()

    def facts(text):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        return len(ids), zlib.crc32(ids.tobytes())

    assert ordered((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == ordered((r[0], *facts(r[1])) for r in ROWS)
    assert tokens.token_report(none, VOCABULARY).count() == 0


def test_encoder_equals_whole_texts():
    encoder = tokens.Encoder(Path(VOCABULARY).read_text())
    odd = ["", "  a  b ", " a", "a ", "a\n b", "a \n\n  b", "x<|endoftext|> y <|endoftext|>z", "it's  don't  ", "a  　b",
           "a\x1c b \x1d c", "日本語 テスト", "   ", "\t\n ", "a" * 300, "b " * 300]
    for text in odd:
        want = np.array([*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 2], encoder.kind).tobytes()
        assert encoder.encode([text]) == [want], repr(text)
    assert encoder.encode(odd) == [encoder.encode([t])[0] for t in odd]


@pytest.mark.parametrize("n", [1, 2, 3, 300, 5000])
def test_huffman_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.flatnonzero(np.ones(n)) * 3
    counts = np.floor(1.5 ** np.minimum(rng.integers(0, 60, n), 58)).astype(np.int64) + 1
    code = huffman.Code.of(ids, counts)
    used = code.lengths[ids]
    assert used.max() <= huffman.LIMIT and (n == 1 or (2.0**-used).sum() == 1)
    sizes = np.array([1, 700, 128, 129, 5])
    stream_ids = rng.choice(ids, sizes.sum())
    stream, nbytes, marks = code.encode(stream_ids, sizes)
    blocks = -(-sizes // huffman.BLOCK)
    marks = marks + np.repeat(8 * (np.cumsum(nbytes) - nbytes), blocks)
    lengths = np.full(blocks.sum(), huffman.BLOCK)
    lengths[np.cumsum(blocks) - 1] = sizes - huffman.BLOCK * (blocks - 1)
    assert (code.decode(stream, marks, lengths) == stream_ids).all()
    # Any block alone.
    at = 3
    assert (code.decode(stream, marks[at : at + 1], lengths[at : at + 1]) == stream_ids[1 + 2 * 128 : 1 + 3 * 128]).all()


def test_huffman_is_optimal_within_its_limit():
    import heapq

    counts = np.random.default_rng(2).integers(1, 1000, 200)
    heap = [(int(c), [i]) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], a[1] + b[1]))
    assert int((huffman.code_lengths(counts) * counts).sum()) == cost


# 4 -------------------------------------------------------------------------------------------

def brute_contamination(rows, items):
    words = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    patterns = [(i, tuple(w[k : k + 10])) for i, t in items for w in [words(t)] if w for k in range(max(len(w) - 10, 0) + 1)]
    for row in rows:
        w, hit, names = words(row[1]), set(), set()
        for i, p in patterns:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    names.add(i)
        named = sorted(str(i) for i in names if i is not None)
        out.append((row[0], len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark, docs, none):
    items = [(1, " ".join(ROWS[3][1].split()[4:16])), (10, ROWS[60 - 22][1]), (2, None), (3, "..."), (None, " ".join(ROWS[4][1].split()[:11])),
             (4, "one TWO"), (5, "edit3"), (4, "one TWO"), (6, "a b 1")]
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = ordered(brute_contamination(ROWS, items))
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)
    assert tuples(decontamination.contamination_report(docs, benchmark), *columns) == want
    few = decontamination.mark(docs.select("doc_id", "text"), benchmark, chunk_bytes=200)  # several passes
    assert tuples(few, "doc_id", "_found.n_words", F.size("_found.items")) == ordered((r[0], r[1], r[3]) for r in want)
    kept = decontamination.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == sum(not r[-1] for r in want)
    assert decontamination.decontaminate(none, benchmark).count() == 0
    assert decontamination.decontaminate(docs, benchmark.limit(0)).count() == len(ROWS)


# 5 -------------------------------------------------------------------------------------------

def mark(d, text):
    """63 bits of the text's SHA-256, below zero where there is an id."""
    digest = hashlib.sha256(text.encode()).hexdigest()
    return (int(digest[:15], 16) << 3 | int(digest[15], 16) & 7) - (2**63 if d != 2**63 - 1 else 0)


def brute_substrings(rows, n=substrings.LENGTH):
    keyed = sorted({(r[0] if r[0] is not None else 2**63 - 1, r[1] or "") for r in rows})
    place = {}
    texts = {k: k[1].encode() for k in keyed}
    order = lambda k: (k[0], mark(*k))
    for k in sorted(keyed, key=order):
        for p in range(len(texts[k]) - n + 1):
            g = texts[k][p : p + n]
            place[g] = min(place.get(g, (*order(k), p)), (*order(k), p))
    out = {}
    for k in keyed:
        data, gone = texts[k], np.zeros(len(texts[k]) + 2, int)
        for p in range(len(data) - n + 1):
            if place[data[p : p + n]] != (*order(k), p):
                gone[p] += 1
                gone[p + n] -= 1
        mask = np.cumsum(gone)[: len(data)] > 0
        kept = bytes(b for b, m in zip(data, mask) if not m)
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out[k] = (len(data), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest())
    return [(r[0], *out[r[0] if r[0] is not None else 2**63 - 1, r[1] or ""]) for r in rows]


def test_substrings(docs, none):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = ordered(brute_substrings(ROWS))
    assert sum(r[2] for r in want) > 1000
    assert tuples(substrings.substring_report(docs), *columns) == want
    assert substrings.substring_report(none).count() == 0


def test_popular_anchors_and_small_shards_change_nothing(docs):
    keyed = docs.select(
        F.coalesce("doc_id", F.lit(substrings.LAST)).alias("d"), text_mark().alias("h"),
        F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("data"),
    )

    def starts(**options):
        found = substrings.repeats(keyed, **options)
        return {(r.d, r.h, r.pos + k) for r in found.collect() for k in range(r.cnt)}

    usual = starts()
    assert usual and starts(anchor_classes=0) == usual == starts(shard_bytes=500)


@pytest.mark.parametrize("seed", range(6))
def test_interval_expansion(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 4, 160)
    parts = [base[: 150 - 5 * seed], base[20:], rng.integers(1, 4, 120), np.tile([1, 2], 80), base]
    symbols = np.concatenate([np.append(p, 0) for p in parts]).astype(np.int64)
    classes = substrings.repeat_classes(symbols)
    whole = np.concatenate([symbols, symbols])
    by_class, by_text = defaultdict(set), defaultdict(set)
    for i in range(len(symbols)):
        by_class[classes[i]].add(i)
        by_text[whole[i : i + substrings.LENGTH].tobytes()].add(i)
    assert sorted(map(sorted, by_class.values())) == sorted(map(sorted, by_text.values()))


@pytest.mark.parametrize("piece", [101, 150, 333])
def test_runs_cover_every_string_once(monkeypatch, piece):
    rng = random.Random(piece)
    data = np.frombuffer(prose(rng, 60).encode() + b"a" * 150, np.uint8)
    anchor, sid, pos, cnt = substrings.runs_of(data, np.full(len(data), len(data)))
    places = [p + k for p, c in zip(pos, cnt) for k in range(c)]
    assert places == list(range(len(data) - substrings.LENGTH + 1))


# 6 -------------------------------------------------------------------------------------------

def brute_groups(rows):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if i < j and a and b and root[i] != root[j] and 100 * len(a & b) >= 75 * len(a | b):
                    old, new = max(root[i], root[j]), min(root[i], root[j])
                    root = [new if x == old else x for x in root]
                    changed = True
    return sets, root


def test_near_duplicates(docs, none):
    sets, root = brute_groups(ROWS)
    least = {}
    for r, x in zip(ROWS, root):
        if r[0] is not None:
            least[x] = min(least.get(x, r[0]), r[0])
    want = [(r[0], len(s), least.get(x) if s else r[0], r[0] == (least.get(x) if s else r[0])) for r, s, x in zip(ROWS, sets, root)]
    assert tuples(neardup.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == ordered(want)
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = [r.text for r in kept.collect()]
    assert len([t for t in rows if t and t.split()]) == len({x for x, s in zip(root, sets) if s})
    assert len([t for t in rows if not t or not t.split()]) == len([s for s in sets if not s])
    assert neardup.near_duplicates(none).count() == 0 and neardup.drop_near_duplicates(none).count() == 0


def test_links_without_a_pivot_are_found(spark, monkeypatch):
    """Every pair of a band is compared in blocks where pivots leave it open."""
    monkeypatch.setattr(neardup, "PIVOT_ROUNDS", 0)
    monkeypatch.setattr(neardup, "BLOCK", 2)
    rng = random.Random(8)
    words = prose(rng, 80).split()
    rows = []
    for i in range(12):  # a chain: each differs from the next a little, the ends a lot
        rows.append((i, " ".join(words)))
        words[6 * i] = f"new{i}"
    rows += [(100 + i, prose(rng, 50)) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets, root = brute_groups(rows)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
    assert got == {r[0]: rows[x][0] for r, x in zip(rows, root)}


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(4)
    for share in (0.5, 0.75, 0.9):
        pool = neardup.scramble(rng.integers(0, 2**63, 3000, dtype=np.uint64))
        n = 1000
        overlap = int(2 * n * share / (1 + share))
        a, b = np.sort(pool[:n]), np.sort(pool[n - overlap : 2 * n - overlap])
        est = neardup.estimate(neardup.registers(a)[None, :], neardup.registers(b)[None, :], np.array([n]), np.array([n]))
        assert abs(est[0] - share) < 0.12
        merged = np.maximum(neardup.registers(a), neardup.registers(b))
        assert (merged == neardup.registers(np.union1d(a, b))).all()


# 7 -------------------------------------------------------------------------------------------

def test_licenses(spark, none):
    prepare(spark)
    rng = random.Random(2)
    texts = [None, "", "...", "under the MIT license", "Licensed Under the Apache License, Version 2.0!", "a cc-by-nc cc by nc",
             prose(rng, 400) + " this work is licensed under the GNU General Public License, version 3 " + prose(rng, 30),
             "This work is licensed under the GNU General Public license", "under the mit\nlicense under the mit license",
             " ".join("redistribution and use in source and binary forms with or without modification are permitted provided".split()),
             prose(rng, 3000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (3, texts[3]), (3, texts[4])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, token string, block int").repartition(2)
    want = []
    for i, t in rows:
        w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, name) for p, name in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        base, more, best = {n for _, n in at}, set(), 0.0
        for k in range(0, max(len(w), 1), licenses.BLOCK // 2):
            block = set(w[k : k + licenses.BLOCK])
            for name, text in licenses.TEMPLATES:
                tokens_of = set(text.split())
                if 100 * len(block & tokens_of) >= licenses.CONTAINED * len(tokens_of):
                    more.add(name)
                    best = max(best, len(block & tokens_of) / len(tokens_of))
        starts = [k for k, _ in at]
        want.append((i, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                     ",".join(sorted(base | more)), 1.0 if at else best))
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert tuples(licenses.find_licenses(df), *columns) == ordered(want)
    assert licenses.find_licenses(none).count() == 0


# 8 -------------------------------------------------------------------------------------------

def test_quality(spark, folder, docs, none):
    # The smallest table has too few labels to hold any out.
    larger = Path(folder).parent / "sf0.01"
    table, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    table = table.withColumns({"quality": F.lit(9), "vector": F.lit("x")})
    scored = quality.quality_report(table, labels.withColumn("text", F.lit("x"))).cache()
    marks = labels.select("doc_id", "quality")
    rows = scored.join(marks, "doc_id").where("quality IN (0, 1)").collect()
    out = [r for r in rows if r.held_out]
    assert len(out) > 50 and sum(r.predicted == r.quality for r in out) >= 0.95 * len(out)
    for r in scored.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    # Held-out labels are not learned from.
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.quality_report(table, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in scored.collect())
    got = quality.quality_report(docs, labels)
    assert got.count() == len(ROWS) and got.where("score IS NULL OR isnan(score)").count() == 0
    same = lambda q: labels.withColumn("quality", F.lit(q))
    for few, score in ((labels.limit(0), 0.5), (same(7), 0.5), (same(1), 1.0), (same(0), 0.0)):
        assert {r.score for r in quality.quality_report(docs, few).select("score").collect()} == {score}
    assert quality.quality_report(none, labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_density_equals_the_textbook():
    rng = np.random.default_rng(0)
    d = len(quality.FEATURES)
    cov, mean = np.cov(rng.normal(size=(d, 200))), rng.normal(size=d)
    factor = np.linalg.cholesky(cov)
    model = quality.Model(np.array([mean, mean * 0]), np.array([np.linalg.inv(factor)] * 2),
                          np.array([np.log(np.diag(factor)).sum()] * 2), np.log([0.3, 0.7]))
    x = rng.normal(size=(5, d))
    log = lambda m: -0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(cov), x - m)
    odds = log(mean * 0) + np.log(0.7) - log(mean) - np.log(0.3)
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(-odds)))


# 9 -------------------------------------------------------------------------------------------

def brute_lines(rows):
    def units(text):
        out = []
        for line in text.split("\n"):
            words = line.split(" ")
            words = line.encode().split()
            out += [b" ".join(words[i : i + lines.WRAP]) for i in range(0, len(words), lines.WRAP)]
        return out

    key = lambda r: (lambda d: (d, mark(d, r[1] or "")))(2**63 - 1 if r[0] is None else r[0])
    first = {}
    for r in rows:
        u = units(r[1] or "")
        for k in range(len(u) - lines.RUN + 1):
            g = tuple(u[k : k + lines.RUN])
            first[g] = min(first.get(g, (*key(r), k)), (*key(r), k))
    out = []
    for r in rows:
        u, gone = units(r[1] or ""), set()
        for k in range(len(u) - lines.RUN + 1):
            if first[tuple(u[k : k + lines.RUN])] != (*key(r), k):
                gone.update(range(k, k + lines.RUN))
        kept = b" ".join(x for i, x in enumerate(u) if i not in gone)
        out.append((r[0], len(u), len(gone), len([i for i in gone if i - 1 not in gone]), b" ".join(kept.split())))
    return out


def test_lines(docs, none):
    cut = lines.remove_repeated_lines(docs).collect()
    got = [(r.doc_id, r.n_lines, len(r.removed), r.n_runs, b" ".join(bytes(r.kept).split())) for r in cut]
    want = brute_lines(ROWS)
    assert sum(r[2] for r in want) > 10
    assert ordered(got) == ordered(want)
    for r in cut:  # what has nothing removed stays byte for byte
        if not r.removed:
            assert bytes(r.kept) in {(x[1] or "").encode() for x in ROWS if x[0] == r.doc_id}
    assert lines.line_report(none).count() == 0


def brute_passages(texts, size):
    """What remains of single-line texts without the later copies of runs of ``size`` words."""
    first, out = {}, {}
    for i, text in sorted(texts.items()):
        words = text.split()
        grams = [tuple(words[k : k + size]) for k in range(len(words) - size + 1)]
        gone = {j for k, g in enumerate(grams) if first.setdefault(g, (i, k)) != (i, k) for j in range(k, k + size)}
        out[i] = " ".join(w for j, w in enumerate(words) if j not in gone)
    return out


def test_passages_at_any_offset_of_a_line(spark):
    """Passages of 48 to 60 words and of 500 at other word offsets, edited copies, own repeats."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    some = lambda n: [word() for _ in range(n)]
    texts = {}
    for size in [47, 48, *range(51, 61), 500]:
        shared = some(size)
        for before, after in ((5, 30), (9, 21), (rng.randint(0, 40), rng.randint(0, 40)), (0, 0)):
            texts[len(texts)] = " ".join(some(before) + shared + some(after))
    phrase = some(20)  # a popular short phrase whose first places are not the passage's
    texts |= {len(texts) + i: " ".join(some(30) + phrase + some(30)) for i in range(20)}
    passage = some(20) + phrase + some(15)
    texts |= {len(texts) + i: " ".join(some(3 + i) + passage + some(7)) for i in range(3)}
    long = some(300)
    texts |= {len(texts) + i: " ".join(edited) for i, edited in enumerate(
        [long, long[:70] + some(1) + long[70:], long[:130] + long[131:], some(7) + long[40:200] + some(2) + long[100:]])}
    texts[len(texts)] = " ".join(["same"] * 90 + some(20) + ["same"] * 70)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    cut = lines.remove_repeats(docs).collect()
    want = brute_passages(texts, lines.PASSAGE)
    assert {r.doc_id: " ".join(bytes(r.kept).decode().split()) for r in cut} == want
    report = {r.doc_id: r for r in lines.line_report(docs).collect()}
    for r in cut:
        assert report[r.doc_id].kept_sha256 == hashlib.sha256(bytes(r.kept)).hexdigest()
        assert (len(r.removed) > 0) == (r.n_runs > 0) == (want[r.doc_id] != texts[r.doc_id])
    assert all(report[i].n_removed for i in range(8, 13 * 4) if i % 4)


def test_selected_positions_do_not_depend_on_the_place():
    """Winnowing keeps few positions, and equal passages the same ones, across blocks of bytes too."""
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(map(str, rng.integers(0, 10**6, n)))
    shared = text(500)
    words = lines.Words([t.encode() for t in (f"{text(9)} {shared}", f"{text(3 * lines.BLOCK // 7)}\n{shared}\n{text(5)}")])
    fingerprint, key, start, _ = lines.passages_of(words, lines.PASSAGE)
    assert len(start) < len(words) / 14
    both = [(f, k) for (f, k), n in Counter(zip(fingerprint.tolist(), key.tolist())).items() if n == 2]
    assert len(both) > 20 and len(set(key.tolist())) == len(key) - len(both)


def test_passages_contain_the_runs_of_lines(docs):
    """Nothing that runs of lines remove stays."""
    whole = {(r.doc_id, r.n_lines, tuple(r.removed)) for r in lines.remove_repeats(docs).collect()}
    for r in lines.remove_repeated_lines(docs).collect():
        assert any(x[:2] == (r.doc_id, r.n_lines) and set(r.removed) <= set(x[2]) for x in whole)


def test_wrapped_lines_tile_the_text():
    data = ("a b c\n\n  " + " ".join(f"w{i}" for i in range(50)) + "  \nend").encode()
    spans, hashes = lines.lines_of(data)
    assert len(spans) == len(hashes) == 1 + 4 + 1
    assert b"".join(data[a:b] for a, b in spans) == data.replace(b"\n\n", b"\n")


# 10 ------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def brute_secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 16]
    return sorted(found)


def test_secret_spans_equal_the_expressions():
    automata = secrets.compile_rules(secrets.RULES)
    rng = random.Random(5)
    pieces = ["token", "Secret", "PASSWORD", "passwd", "api_key", "apiKEY", "api", "=", ":", " ", "  ", '"', "'", "AKIA", "AKIAAKIA", "é",
              "abc0123def456789", "0" * 15, "Zz9+/_.=-", "ABCDEFGH123456", "\n", "x", "日本", "_", "deadbeefdeadbeef"]
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        got = [s for s in secrets.scan(text, secrets.RULES, automata) if s[1] < 3]
        assert got == brute_secrets(text), text


def test_secrets(spark, none):
    prepare(spark)
    more = ["ghp_" + "a1B2" * 9, "xoxb-123456789012-abcdef", "AIza" + "b" * 35, "-----BEGIN RSA PRIVATE KEY-----",
            "eyJhbGciOi.eyJzdWIiOi." + "x" * 20]
    texts = [None, "", "é token = 'abcdefghijkl' x", "token=short", *[f"é {m} end" for m in more], "z" * 200_000 + " 0123456789abcdef"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(2, texts[2], "x")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in secrets.secrets_report(df).collect()}
    for i, text in enumerate(texts):
        base = brute_secrets(text or "")
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        told = ",".join(f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(told.split(",")) - {""} <= set(r.spans.split(","))
    for i, kind in enumerate(("github", "slack", "google", "private_key", "jwt")):
        assert f"{kind}:2:" in got[4 + i].spans, kind
    assert secrets.secrets_report(none).count() == 0
