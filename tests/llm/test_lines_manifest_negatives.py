"""Line dedup, the Merkle manifest and hard negatives against brute force: nulls, long texts, ties, repeated rows, hot keys, empty tables, extra columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from touchline.llm import ann, exact_dedup, hard_negatives, html_extract, line_dedup, merkle, mixing, toxicity, warc

SPACE = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def _texts(seed):
    rng = random.Random(seed)
    lines = [f"Line {i}" for i in range(30)] + ["", "  ", "ÀB", "àb", " x", "x\r"]
    texts = ["\n".join(rng.choices(lines, k=rng.choice([1, 2, 5, 12]))) for _ in range(60)]
    texts += [None, "", "\n", "\n\n", "line 1\n" * 50, " LINE 1\t", "Everywhere", "long line " * 120_000 + "\nline 2"]
    texts += ["everywhere\nown %d" % (i % 3) for i in range(60)]
    return texts


def _lines(rows, min_docs, min_chars, keep_first):
    """doc -> (n_lines, kept text, dropped) by brute force; rows are (id, text, order key)."""
    keys = [[k.strip(SPACE).translate(LOWER) for k in (t or "").split("\n")] for _, t in rows]
    found = defaultdict(set)
    for r, ks in enumerate(keys):
        for k in ks:
            found[k].add(r)
    gone = [{i for i, k in enumerate(ks) if len(k) >= min_chars and len(found[k]) >= min_docs} for ks in keys]
    return keys, found, gone


@pytest.mark.parametrize("min_docs, min_chars", [(10, 1), (3, 7), (1, 1)])
@pytest.mark.parametrize("partitions", [1, 7])
def test_lines_in_many_documents_lose_all(spark, min_docs, min_chars, partitions):
    rows = [*enumerate(_texts(min_docs)), (None, "line 3\nnull id"), (5, "line 4\nrepeated id"), (7, "everywhere\ntwice"), (7, "everywhere\ntwice")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, keep string, n_lines int").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        bitmaps = line_dedup.keep_bitmaps(docs, min_docs, min_chars, keep_first=False)
        got = line_dedup.apply_bitmaps(docs, bitmaps).collect()
        assert bitmaps.columns == ["doc_id", "text_key", "n_lines", "n_dropped", "keep"]
        narrow = sorted((str(r.doc_id), r.n_lines, r.n_dropped, int(line_dedup.unpack_bits(r.keep, r.n_lines).sum())) for r in bitmaps.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    _, _, gone = _lines(rows, min_docs, min_chars, False)
    want = []
    for (i, t), lost in zip(rows, gone, strict=True):
        parts = (t or "").split("\n")
        want.append((str(i), len(parts), len(lost), "\n".join(p for j, p in enumerate(parts) if j not in lost)))
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept) for r in got) == sorted(want)
    assert narrow == sorted((i, n, lost, n - lost) for i, n, lost, _ in want)


@pytest.mark.parametrize("min_docs", [1, 2, 5])
@pytest.mark.parametrize("partitions", [1, 9])
def test_first_occurrences_stay(spark, min_docs, partitions):
    rows = [*enumerate(_texts(min_docs + 20)), (3, "everywhere\nsame id\nsame id"), (200, "only here"), (200, "only here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    key = {(r.doc_id, r.text): r.k for r in line_dedup._keyed(docs, "doc_id", "text").select("doc_id", F.col("text"), "k").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_docs)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    keys, found, _ = _lines(rows, min_docs, 1, True)
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0], key[rows[r][0], rows[r][1] or ""]))
    seen, lost = {}, defaultdict(set)
    for r in order:
        for i, k in enumerate(keys[r]):
            if k and len(found[k]) >= min_docs:
                place = (*rows[r], i)
                if seen.setdefault(k, place) != place:
                    lost[r].add(i)
    want = sorted((str(i), "\n".join(p for j, p in enumerate((t or "").split("\n")) if j not in lost[r])) for r, (i, t) in enumerate(rows))
    assert sorted((str(r.doc_id), r.kept) for r in got) == want


def test_runs_that_batches_and_tasks_cut():
    """The streaming pass gives the same totals wherever batches and tasks are cut, waiting for few rows only."""
    rng = random.Random(9)
    lines = sorted((h, 0, d, d % 3, p) for h in range(6) for d in range(rng.choice([1, 3, 9, 10, 11, 40])) for p in range(rng.choice([1, 2, 4])))
    docs = defaultdict(set)
    for h, _, d, k, _ in lines:
        docs[h].add((d, k))
    for seed in range(30):
        cut = random.Random(seed)
        tasks = sorted(cut.sample(range(1, len(lines)), 4))
        dropped, open_, parts = [], [], []
        for a, b in zip([0, *tasks], [*tasks, len(lines)], strict=True):
            mine = lines[a:b]
            at = sorted({0, len(mine), *cut.choices(range(len(mine) + 1), k=3)})
            batches = [pa.RecordBatch.from_pylist([dict(zip(line_dedup.ORDER, r, strict=True)) for r in mine[x:y]]) for x, y in zip(at, at[1:], strict=False) if y > x]
            for out in line_dedup._decide(10, False)(iter(batches)):
                for r in out.to_pylist():
                    {line_dedup.DROPPED: dropped, line_dedup.OPEN: open_, line_dedup.SUMMARY: parts}[r["kind"]].append(r)
        total = defaultdict(int)
        last = {}
        for p in sorted(parts, key=lambda p: (p["h1"], p["d"], p["k"], p["pos"])):
            total[p["h1"]] += p["docs"] - (p["head_docs"] if last.get(p["h1"]) == (p["d"], p["k"]) else 0)
            last[p["h1"]] = (p["last_d"], p["last_k"])
        assert all(total[h] == len(docs[h]) for h in total)
        gone = {(r["h1"], r["d"], r["pos"]) for r in dropped} | {(r["h1"], r["d"], r["pos"]) for r in open_ if total[r["h1"]] >= 10}
        assert gone == {(h, d, p) for h, _, d, _, p in lines if len(docs[h]) >= 10}
        assert len(open_) <= 2 * 5 * 9 * 4


def test_line_dedup_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.keep_bitmaps(none).count() == 0
    assert line_dedup.apply_bitmaps(none, line_dedup.keep_bitmaps(none)).count() == 0


def _h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _climb(nodes):
    """(root, siblings of each node from the bottom up as (left, right)) of runs of eight."""
    paths, spot = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(spot):
            a = at // 8 * 8
            paths[i].append(("".join(nodes[a:at]), "".join(nodes[at + 1 : a + 8])))
            spot[i] = at // 8
        nodes = [_h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def _manifest(rows):
    def leaf(i, source, lang, n, text):
        return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))

    groups = defaultdict(list)
    for i, text, lang, source, n in rows:
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and text is not None
        groups[lang].append((-1 if i is None else i, leaf(i, source, lang, n, text), leaf(i, source, lang, n, text.translate(LOWER) if hit else text), i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g], key=lambda r: r[:2]), *_climb([r[1] for r in sorted(groups[g], key=lambda r: r[:2])])) for g in names}
    root, above = _climb([trees[g][1] for g in names])
    out = []
    for g, up in zip(names, above, strict=True):
        leaves, sub, paths = trees[g]
        for (_, mine, claim, i), path in zip(leaves, paths, strict=True):
            node = claim
            for left, right in path + up:
                node = _h(left + node + right)
            out.append((str(i), mine, sub, root, _h("".join(x + y for x, y in path + up)), node, node == root))
    return sorted(out)


@pytest.mark.parametrize("n, langs, partitions", [(0, 0, 2), (1, 1, 2), (9, 12, 3), (700, 3, 1), (1300, 2, 7)])
def test_manifest(spark, n, langs, partitions):
    rng = random.Random(n)
    names = [None, "", *(f"l{chr(90 + i)}" for i in range(langs)), "é", "\U0001f600", "￿"][: max(1, langs)]
    rows = [(i, rng.choice([None, "", "Some TEXT %d" % i, "ÀÉ lower", "UPPER"]), names[0] if rng.random() < 0.7 else rng.choice(names), rng.choice(["s", None]), rng.choice([i, None])) for i in range(n)]
    if n > 100:
        rows += [(None, "no id", names[0], "s", 1), (4, "REPEATED", names[0], "s", 1), (4, "REPEATED", names[0], "s", 1), (4, "other", names[0], None, 2), (5, "A" * 1_000_000, names[0], "s", 3)]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, leaf string, pos int").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = merkle.tampered_manifest(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == (_manifest(rows) if rows else [])


def test_manifest_takes_the_same_root_by_other_block_sizes(spark):
    leaves = spark.range(300).select(F.lit("a").alias("grp"), "id", F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("leaf")).withColumn("claim", F.col("leaf"))
    one, two = (merkle.manifest(leaves, merkle.Shape(8, n)).orderBy("id").collect() for n in (1, 2))
    assert one == two
    assert all(r.verified for r in one)


def _negatives(rows, s=hard_negatives.Settings()):
    good = [(i, lab, [int(np.floor(s.scale * float(x))) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and len(v) == 8]
    out = []
    for a, (i, lab, q) in enumerate(good):
        if i % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), j, m) for b, (j, m, v) in enumerate(good) if b != a)
        for p, j, _ in [r for r in scored if r[2] == lab][: s.positives]:
            hard = [r for r in scored if r[2] != lab and s.low * -p <= 100 * -r[0] <= s.high * -p][: s.negatives]
            out += [(i, j, k, h[1], -p, -h[0]) for k, h in enumerate(hard, 1)]
    return sorted(out)


def _vectors(seed, n, spread=1.0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.round(spread * rng.normal(size=8), 1 if seed % 2 else 6)], int(rng.integers(0, 3))) for i in range(n)]
    rows += [(50, rows[0][1], 1), (50, rows[0][1], 1), (0, rows[3][1], 0)]  # repeated ids and vectors
    rows += [(100, rows[7][1], None), (150, None, 1), (None, rows[1][1], 1), (200, [], 1), (250, [1.0] * 7 + [None], 1), (300, [float("nan")] + [1.0] * 7, 1), (350, [float("inf")] * 8, 1), (400, [1.0, 2.0], 2)]
    return rows + [(1000 + i, rows[5][1], 1) for i in range(n // 3)]  # one vector a quarter of all rows share


@pytest.mark.parametrize("seed", range(4))
def test_hard_negatives(spark, seed):
    rows = _vectors(seed, 400)
    df = spark.createDataFrame([(*r, 1.5, "r") for r in rows], "vec_id long, embedding array<float>, label int, score double, row string").repartition(3)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    want = _negatives(exact)
    for s in (hard_negatives.Settings(), hard_negatives.Settings(cells=4, block=32, together=3, chunk=5, sample=50)):
        assert sorted(map(tuple, hard_negatives.mine(df, F.col("id") % 50 == 0, s).collect())) == want


def test_bounds_hold_and_spare_exact_scores():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(4000, 16))).astype(np.int64)
    cells = hard_negatives.Cells.fit(x[:200], x.min(0), x.max(0), 64)
    codes = cells.encode(x)
    lower, upper = hard_negatives.bounds(codes, cells.tables(x[:20]))
    exact = x[:20] @ x.T
    assert (lower <= exact).all() and (exact <= upper).all()
    label = np.sort(rng.integers(0, 4, 4000))
    block, best = hard_negatives.Block(np.arange(4000), np.arange(4000), label, x, codes), [np.empty((0, 3), np.int64)] * 20
    scored = hard_negatives.near_same(block, cells, x[:20], np.arange(20), label[:20], best, 5, 64)
    assert scored < 20 * 1000 / 4


def test_no_vectors_no_anchors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(none, F.col("id") % 50 == 0).count() == 0
    some = spark.createDataFrame([(1, [1.0], 0)], none.schema)
    assert hard_negatives.mine(some, F.col("id") % 50 == 0).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    huge = spark.createDataFrame([(0, [1e30], 0)], none.schema)
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.mine(huge, F.col("id") % 50 == 0)


def test_stages_keep_columns_of_any_name(spark):
    """Columns called like the ones that exact dedup and mixing add come back as they were."""
    names = "doc_id long, text string, source string, digest_ string, id_ string, n_ string, content_ string, row_ string, copy_ string, order_ string, of_ string, __digest string, __row string, __copy string"
    rows = [(i % 7, f"text {i % 5} " * 3, "s", *("mine%d" % i,) * 11) for i in range(20)] + [(1, "same row", "s", *("mine",) * 11)] * 3
    docs = spark.createDataFrame(rows, names)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    out = [tuple(r) for r in kept.collect()]
    assert len(out) == len(groups) and all(r in rows and r[0] == max(x[0] for x in groups[r[1]]) for r in out)
    drawn = mixing.draw(docs)
    assert drawn.columns == [*docs.columns, "shard"] and {tuple(r)[:-1] for r in drawn.collect()} <= set(rows)


def test_drop_copies_with_null_ids_and_nothing(spark):
    rows = [(None, "a"), (None, "a"), (3, "a"), (None, "b"), (None, "b"), (4, None), (5, "")]
    out = sorted((str(r.doc_id), r.text) for r in exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [("3", "a"), ("5", ""), ("None", "b")]
    assert exact_dedup.drop_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_deep_pages_and_broken_headers_cost_linear_time():
    import time
    import tracemalloc

    n = 100_000
    for page in ("<div>" * n, "<div>a" * n, "<div>" * n + "</nav>" * n, "<div><p>" * n + "</div>" * n, "<main>" + "<section>x</ul>" * n):
        start = time.time()
        tracemalloc.start()
        for _ in html_extract.blocks(page):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert time.time() - start < 20 and peak < 200_000_000, page[:20]
    version = b"WARC/1.0\r\n"
    for data in (version * n, (version + b"x: y\r\n") * n, (version + b"a: b\r\n") * n + b"\r\n\r\n"):
        start = time.time()
        found = list(warc._records(data))
        assert time.time() - start < 20 and all(f[2] is None for f in found)


def test_search_with_repeated_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    rows += [(0, rows[0][1]), (0, rows[9][1]), (20, rows[20][1]), (None, rows[1][1])]
    df = spark.createDataFrame([(*r, 1, 0.5) for r in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = defaultdict(list)
    for r in ann.search(df, "vec_id % 20 = 0", top=5).collect():
        got[r.query_id].append((r["rank"], r.vec_id, round(r.score, 9)))
    known = [r for r in rows if r[0] is not None]
    for q in (0, 20, 40):
        want = []
        for a, (i, v) in enumerate(known):
            if i == q:
                scored = sorted((-float(np.dot(v, w)), j) for b, (j, w) in enumerate(known) if b != a)
                want += [(k, j, round(-s, 9)) for k, (s, j) in enumerate(scored[:5], 1)]
        assert sorted(got[q]) == sorted(want)


def test_training_reads_one_text_an_id(spark):
    docs = spark.createDataFrame([(i, f"bad word {i % 3}" if i % 2 else f"good thing {i % 3}") for i in range(1, 60)] + [(7, f"copy {k}") for k in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels)
    plan = toxicity.train(docs.repartition(5), labels)
    assert plan == toxicity.train(docs, labels)
