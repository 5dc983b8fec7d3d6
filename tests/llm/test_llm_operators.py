"""The training-data operators against brute force on small fixtures: nulls, empty texts, ties, repeats, empty tables, extra columns."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from touchline.llm import ann, chat, exact_dedup, html_extract, jaccard_join, mixing, packing, pii, toxicity, warc

DOCS = "doc_id long, text string, source string, key string, digest string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 30, 60, 200]))) for _ in range(40)]
    texts = [*base, *base[:10], None, "", " \t\n", "one", "one two", "x" * 5000]
    for t in base:
        words = t.split()
        for edits in (1, 2, 4):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy).upper())
    rows = [(i, t, f"s{i % 4}" if i % 7 else None, "k", "d") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3), rows


def _shingles(text, k):
    words = [w.lower() for w in WORD.findall(text or "")]
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_jaccard_components(docs, k, num, den):
    df, rows = docs
    sets = {r[0]: _shingles(r[1], k) for r in rows}
    home = {i: i for i in sets}

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] & sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                home[y] = x
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, k, num, den).collect()}
    assert out == {i: (len(sets[i]), root(i)) for i in sets}


def test_parity_vectors_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 3000)).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(0, 40)).astype(np.uint64)]))
        if not len(b):
            continue
        x, y = (np.frombuffer(jaccard_join._parities(e, np.array([0, len(e)]))[0], np.uint8) for e in (a, b))
        while len(x) != len(y):
            x, y = (x, y) if len(x) > len(y) else (y, x)
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_exact_dedup(docs):
    df, rows = docs
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    for r in exact_dedup.exact_dedup(df).collect():
        text = rows[r.doc_id][1] or ""
        assert (r.keep_id, r.group_size, r.kept) == (max(groups[text]), len(groups[text]), r.doc_id == max(groups[text]))
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert exact_dedup.drop_copies(df).count() == len(groups)
    assert exact_dedup.drop_copies(df).columns == df.columns


def test_cuckoo_filter_inserts_deletes_and_grows():
    live, keys = exact_dedup.CuckooFilter(16), [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        live.insert(k, (i,))
    for k in keys[::2]:
        assert live.delete(k) is not None
    assert all((live.find(k) is None) == (i % 2 == 0) for i, k in enumerate(keys))
    assert len(live) == 1500 and live.delete(keys[0]) is None


def test_index_takes_further_documents_in_and_out(spark):
    schema = "doc_id long, text string"
    first = spark.createDataFrame([(1, "a"), (5, "b"), (3, "a"), (4, None)], schema)
    more = spark.createDataFrame([(9, "a"), (2, "c"), (2, "c"), (1, "b")], schema)
    index = exact_dedup.insert(exact_dedup.build_index(first), more)
    assert sorted((r.keep_id, r.group_size) for r in index.collect()) == [(2, 2), (4, 1), (5, 2), (9, 3)]
    both = exact_dedup.build_index(first.unionByName(more))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, index.collect()))
    gone = exact_dedup.delete(index, spark.createDataFrame([(7, "a"), (8, ""), (8, ""), (8, "never seen")], schema))
    assert sorted((r.keep_id, r.group_size) for r in gone.collect()) == [(2, 2), (5, 2)]
    back = exact_dedup.insert(gone, spark.createDataFrame([(3, "a")], schema))
    assert sorted((r.keep_id, r.group_size) for r in back.collect()) == [(2, 2), (3, 1), (5, 2)]


def test_packing(docs):
    df, rows = docs
    out = packing.pack(df, size=64).collect()
    encode = packing._encoder(packing.TOKENIZER)
    want = {}
    for doc, text, *_ in rows:
        ids = encode(text or "") + b"\0\0\0\0"
        for n, at in enumerate(range(0, len(ids), 256)):
            want[doc, n] = (at // 4, len(ids[at : at + 256]) // 4, zlib.crc32(ids[at : at + 256]))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == want
    bins = {}
    for r in sorted(out, key=lambda r: r.offset):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 64
    rooms = []
    for length in sorted((v[1] for v in want.values()), reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= length]
        if fits:
            best = min(fits, key=lambda i: rooms[i])
            rooms[best] -= length
        else:
            rooms.append(64 - length)
    assert len(bins) == len(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_piece_by_piece_best_fit(seed):
    rng = random.Random(seed)
    size = rng.choice([7, 64, 300])
    histogram = {n: rng.choice([1, 2, 9, 200]) for n in rng.sample(range(1, size + 1), min(size, rng.choice([3, 6, 20])))}
    if seed == 0:
        size, histogram = 2048, {1100: 3, 400: 3, 300: 4}
    rooms = []
    for length in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        best = min((i for i, room in enumerate(rooms) if room >= length), key=lambda i: rooms[i], default=None)
        if best is None:
            best = len(rooms)
            rooms.append(size)
        rooms[best] -= length
    runs, filled, ranks = packing.plan(histogram, size), {}, {}
    for (length, rank, first, offset), after in zip(runs, [*runs[1:], None], strict=True):
        assert rank == ranks.get(length, 0)
        pieces = (after[1] if after and after[0] == length else histogram[length]) - rank
        ranks[length] = rank + pieces
        for b in range(first, first + pieces):
            assert filled.get(b, 0) == offset
            filled[b] = offset + length
    assert ranks == histogram and sorted(size - f for f in filled.values()) == sorted(rooms)


def test_quick_tokens_are_the_tokenizers_own():
    import public_tokenizers
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)), packing._encoder(packing.TOKENIZER)
    for text in ("", "It's 12 O'CLOCK, we'll  go\n\nÄrger über naïve Straße…", "A\tb c 3½ ²x", "a" * 300, "日本 é", "don't'S don'T"):
        assert list(np.frombuffer(encode(text), "<u4")) == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("token", ["<|startoftext|>", "<|endoftext|>"])
def test_added_tokens_inside_texts_are_the_tokenizers_own(token):
    import public_tokenizers
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)), packing._encoder(packing.TOKENIZER)
    special = t.token_to_id(token)
    for text in (token, f"one{token}two", f" A {token} b{token}", token.upper(), token[:-1], f"<{token}>"):
        ids = list(np.frombuffer(encode(text), "<u4"))
        assert ids == t.encode(text, add_special_tokens=False).ids
        assert token not in text or special in ids


def test_mixing(docs):
    df, rows = docs
    out = mixing.mix(df, block_docs=5).collect()
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(7), block_docs=5).collect()}
    assert {r.doc_id: r.taken for r in out} == again
    sizes = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    assert {r.doc_id: r.size for r in out} == sizes
    assert all(r.taken <= 3 * r.size for r in out)
    # A source misses its target by less than a document of its last block; in a block of 500 documents small ones fill the gap.
    for found, most in ((out, 200), (mixing.mix(df).collect(), 5)):
        by = {}
        for r in found:
            by.setdefault(rows[r.doc_id][2], []).append(r)
        assert abs(sum(v[0].target for v in by.values()) - sum(sizes.values())) < 1e-6
        for v in by.values():
            assert abs(sum(r.taken for r in v) - v[0].target) <= most


def test_draw_takes_each_row_as_often_as_the_mix_says(spark):
    rng = random.Random(10)
    rows = [(None if i % 3 == 0 else i // 4, " ".join(["w"] * rng.randrange(1, 30)), f"s{i % 3}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tag long").repartition(3)
    mixed, drawn = mixing.mix(df, block_docs=20).collect(), mixing.draw(df, block_docs=20).collect()
    target = {r.source_size: r.target for r in mixed}
    takes = {}
    for r in drawn:
        assert (r.doc_id, r.text, r.source, r.tag) == rows[r.tag]
        takes[r.tag] = takes.get(r.tag, 0) + 1
    # Rows of the same id and size may stand for one another; otherwise the copies are the mix's own.
    want = sorted((str(r.doc_id), r.size, r.copies) for r in mixed)
    assert sorted((str(d), len(t.split()), takes.get(i, 0)) for d, t, _, i in rows) == want
    assert any(r.doc_id is None for r in drawn)
    for s in ("s0", "s1", "s2"):
        whole = sum(len(t.split()) for _, t, source, _ in rows if source == s)
        assert abs(sum(len(r.text.split()) for r in drawn if r.source == s) - target[whole]) < 30
    shards = [s for r in mixed for s in r.shards]
    assert sorted(r.shard for r in drawn) == sorted(shards) and len(set(shards)) == 8
    tags = [r.tag for r in drawn if r.shard == 0]
    assert [r.shard for r in drawn] == sorted(r.shard for r in drawn) and tags != sorted(tags)
    again = mixing.draw(df.repartition(5), block_docs=20).collect()
    assert [(r.doc_id, r.text, r.shard) for r in again] == [(r.doc_id, r.text, r.shard) for r in drawn]


def test_quota_tree_is_exact_at_every_node(spark):
    quotas = {1: 900, 2: 1, 3: 0, 4: 257, 5: 4000}
    roots = spark.createDataFrame(list(quotas.items()), "source_rank int, quota long")
    for shards in (1, 2, 8, 64):
        leaves = mixing.quota_tree(roots, shards, 5).collect()
        assert {r.shard for r in leaves} == set(range(shards)) and all(r.quota >= 0 for r in leaves)
        for s, q in quotas.items():
            assert sum(r.quota for r in leaves if r.source_rank == s) == q
        totals = [sum(r.quota for r in leaves if r.shard == i) for i in range(shards)]
        assert max(totals) - min(totals) <= 1
    assert sorted(map(tuple, leaves)) == sorted(map(tuple, mixing.quota_tree(roots.repartition(3), 64, 5).collect()))
    assert mixing.quota_tree(roots.where("quota < 0"), 8, 5).count() == 0


@pytest.mark.parametrize(("total", "marked", "drawn"), [(12, 5, 6), (1, 1, 0), (40, 0, 20), (40, 40, 13), (3000, 1000, 1500), (10**9, 10, 5 * 10**8)])
def test_hypergeometric_draws_follow_the_distribution(spark, total, marked, drawn):
    from math import lgamma

    from pyspark.sql import functions as F

    n = 4000
    rows = spark.range(n).select(F.expr(mixing.hypergeometric(str(total), str(marked), str(drawn), f"(id + 0.5D) / {n}")).alias("x")).groupBy("x").count().collect()
    found = {r.x: r["count"] for r in rows}
    choose = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
    low, high = max(0, drawn - total + marked), min(marked, drawn)
    below = 0.0
    for k in range(low, high + 1):
        p = np.exp(choose(marked, k) + choose(total - marked, drawn - k) - choose(total, drawn))
        # Evenly spaced u: the count of k is the number of them in an interval as long as its probability.
        assert abs(found.pop(k, 0) - n * p) <= 1.01 + 1e-4 * n * (total > 10**6)
        below += p
    assert not found and abs(below - 1) < 1e-5


def test_shards_draw_disjoint_copies_that_make_up_what_is_taken(docs):
    df, rows = docs
    out = mixing.mix(df, shards=4, block_docs=3).collect()
    assert all(len(r.shards) == r.copies and r.taken == r.copies * r.size and set(r.shards) <= set(range(4)) for r in out)
    assert {s for r in out for s in r.shards} == set(range(4))
    # The same seed and one shard more than there are copies for: the number of copies doesn't depend on the shards.
    alone = {r.doc_id: r.copies for r in mixing.mix(df, shards=1, block_docs=3).collect()}
    assert alone == {r.doc_id: r.copies for r in out}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 40, 90]))) for _ in range(60)]
    texts += texts[:15] + [t.replace(t.split()[0], "new", 1) for t in texts[15:30]]
    rows = [(None if i in (3, 70) else i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    groups = {}
    for doc, text, _ in rows:
        groups.setdefault(text, []).append(doc)
    single = corpus_pipeline.drop_copies(spark, df, "")
    want = {(max((d for d in ids if d is not None), default=None), text) for text, ids in groups.items()}
    assert sorted((str(r.doc_id), r.text) for r in single.collect()) == sorted((str(d), t) for d, t in want)
    known = [(d, t) for d, t, _ in rows if d is not None]
    sets, home = {d: _shingles(t, 5) for d, t in known}, {d: d for d, _ in known}

    def root(i):
        return i if home[i] == i else root(home[i])

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                home[y] = x
    near = corpus_pipeline.drop_near_copies(spark, df.where("doc_id is not null"), "").collect()
    assert {r.doc_id for r in near} == {d for d in sets if root(d) == d} and len(near) < len(sets)
    labels = [(i, int(i % 2)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    scores = {(r.doc_id, r.predicted) for r in toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    clean = corpus_pipeline.drop_toxic(spark, df.where("doc_id is not null"), str(tmp_path)).collect()
    assert {r.doc_id for r in clean} == {d for d, bad in scores if d is not None and not bad}
    mixed = corpus_pipeline.mix_sources(spark, df, "")
    assert mixed.count() == sum(r.copies for r in mixing.mix(df).collect())
    assert corpus_pipeline.pack(spark, mixed, "").select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()


def test_pii_base_spans(spark):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def good(kind, hit):
        d = re.sub("[^0-9]", "", hit)
        if kind == "ip":
            return all(int(p) <= 255 for p in hit.split("."))
        if kind == "card":
            total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(d)))
            return 13 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    rng = random.Random(6)
    texts = [None, "", "é😀 a@b.co, +49 (30) 123-4567 1.2.3.4.5.6.7.8 4111 1111 1111 1111", "x@y.com+z@w.org"]
    texts += ["".join(rng.choices("a@.+-1 4(é", k=rng.randrange(80))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_personal_data(df).collect():
        text = texts[r.doc_id] or ""
        spans = [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text) if good(k, m.group())]
        whole = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(whole.encode()).hexdigest(), text
        assert set(filter(None, whole.split(","))) <= set(r.spans.split(","))


def test_pii_spelled_out_emails_reach_the_classifier(spark):
    hits = [f"jane{a}example{b}{d}com" for a in ("[at]", "(at)", " at ", " [at] ", " (at) ") for b in ("[dot]", "(dot)", " dot ", " [dot] ", " (dot) ") for d in ("", f"co{b}")]
    texts = [f"contact {hit}" for hit in hits]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    loose = {r.doc_id: [(x.start, x.end) for x in r.loose] for r in pii.candidates(df).collect()}
    assert loose == {i: [(8, len(t))] for i, t in enumerate(texts)}
    # Strict emails, some without a trigger word, beside the spelled-out ones and beside words that only look like them.
    texts += [f"mail jo{i}@example.com" for i in range(200)] + [f"jo{i}@example.com" for i in range(50)] + ["met at noon [dot] and left"] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}
    assert all(spans[i] == f"email:8:{len(texts[i])}" for i in range(len(hits)))
    assert all(spans[i] == "" for i in range(len(texts) - 20, len(texts)))


def test_warc_round_trip_and_salvage(spark):
    html = "<p>" + "é" * 200 + "</p>"
    rows = [(1, "http://a/x y", html), (2, None, html), (3, "u", None), (4, "u", "short"), (5, "u", "short"), (6, "u", html + "!")]
    out = {r.page_id: r for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for page, _, body in rows:
        raw = (body or "").encode()
        assert (out[page].payload_bytes, out[page].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert [(p, r.record_type, r.refers_to) for p, r in sorted(out.items()) if r.record_type == "revisit"] == [(2, "revisit", 1)]
    twice = spark.createDataFrame([(1, "a" * 200, "x"), (1, "b" * 500, "y"), (2, "a" * 200, "z")], "page_id long, html string, url string")
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in warc.archive_pages(twice).collect()) == [(1, 200, "response"), (1, 500, "response"), (2, 200, "revisit")]
    members = [gzip.compress(warc.encode_record(i, "u", b"body %d" % i, "d", None, False)) for i in range(4)]
    broken = members[0] + members[1][:25] + b"junk" + members[2] + members[3]
    found = list(warc.salvage(broken))
    assert [f[2] and f[2]["x-page-id"] for f in found] == ["0", None, "2", "3"]
    assert found[1][0] == len(members[0]) and found[1][0] + found[1][1] == len(members[0]) + 29


def test_warc_salvage_of_large_joined_and_damaged_members():
    def record(i, body=None):
        return warc.encode_record(i, "u", b"body %d" % i if body is None else body, "d", None, False)

    def pages(data):
        return [f[2] and f[2]["x-page-id"] for f in warc.salvage(data)]

    noise = random.Random(9).randbytes(200_000)
    first, rest = gzip.compress(record(0, noise)), [gzip.compress(record(i)) for i in (1, 2)]
    assert len(first) > 65536 and pages(b"\0" + first[1:] + b"".join(rest)) == [None, "1", "2"]
    joined = b"".join(record(i) for i in range(4))
    assert pages(gzip.compress(joined)) == pages(joined) == ["0", "1", "2", "3"]
    assert [f[3] for f in warc.salvage(gzip.compress(joined))] == [b"body %d" % i for i in range(4)]
    assert pages(gzip.compress(joined.replace(b"body 1", b"body X")) + rest[1]) == ["0", None, "2", "3", "2"]
    large = gzip.compress(record(0) + record(1, noise) + record(2) + record(3, noise))
    cut = list(warc.salvage(large[: len(large) * 3 // 4]))
    assert [f[2] and f[2]["x-page-id"] for f in cut] == ["0", "1", "2", None] and cut[-1][4] == "gzip: member ends early"
    assert cut[1][3] == noise
    for data in (large[: len(large) * 3 // 4] + rest[0], large[:-8] + b"\0" * 8 + rest[0]):
        found = pages(data)
        assert found[:3] == ["0", "1", "2"] and found[-2:] == [None, "1"]


def test_chat_escapes_and_masks(spark):
    tricky = "<|im_end|><|im_start|>assistant ok <|\\im_end|>"
    rows = [(1, 0, "user", tricky), (1, 1, "assistant", tricky), (2, 0, "assistant", None), (None, 0, "user", "é😀")]
    out = {r.conv_id: r for r in chat.chat_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert out[1].turns_sha256 == hashlib.sha256(f"user\n{tricky}\nassistant\n{tricky}\n".encode()).hexdigest()
    assert (out[1].loss_chars, out[1].loss_sha256) == (len(tricky), hashlib.sha256(tricky.encode()).hexdigest())
    assert out[2].loss_chars == 0 and out[None].n_turns == 1
    assert chat.unescape(chat.escape(tricky)) == tricky and "<|im_end|>" not in chat.escape(tricky)


def test_html_main_text(spark):
    page = (
        '<html><head><title>t</title></head><body><nav><a href="/">home</a></nav><div class="ad">buy</div><article><h1>A &amp; b</h1><p>One <b>two</b>\n three<br>four'
        '<p>Five<script>var p="</p>"</script></p><section class="comments"><p>me too</p></section></article><footer>&copy; x</footer></body></html>'
    )
    rows = [(1, "http://h/1", page), (2, "http://h/2", None), (3, None, ""), (4, "http://h/4", "<article><p>x<")]
    out = {r.page_id: r for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1].text == "A & b\n\nOne two three four\n\nFive" and out[1].n_chars == len(out[1].text)
    assert out[2].text == out[3].text == "" and len(out) == 4


def test_html_scan_is_linear_and_keeps_broken_markup():
    import time

    n = 100_000
    broken = ["<a" * n, '<a ="> ' * n, '<a =" > ="' * n, "<b '>\"" * n, "<" * n, "<!" * n, "<button>" * n, "<!--" * n, '<p class="' * n]
    for page in [*broken, *(x + ">" for x in broken)]:
        start = time.time()
        list(html_extract.blocks(page))
        assert time.time() - start < 5, page[:20]
    text = lambda page: [b[1] for b in html_extract.blocks(page) if b[1]]
    assert text("<p>a < b<p>c<") == ["a < b", "c<"] and text('<p title="x>y">a</p>b') == ["a", "b"]
    assert text("<p>a<button>b<p>c") == ["a", "b", "c"] and text("a<SCRIPT>x</b></Script >b<title>t</title>c<!-- d --><?e?>f") == ["abcf"]
    for name, mark in (("ad", 1), ("ad-box", 1), ("siteFooter", 1), ("related-work", 0), ("social-history", 0), ("comments", 1), ("adventure", 0), ("col-8", 0)):
        assert html_extract._is_mark(name) == bool(mark)


def test_html_wording_that_a_host_repeats_in_its_articles(spark):
    def page(i):
        advert = "<p>Buy the blue lamp now</p>" if i % 3 else ""
        return f"<html><body><div>Top line</div><article><h1>Title {i}</h1><p>Share this story with friends</p><p>Body {i} is here.</p>{advert}<p>End {i}.</p></article><div>Bottom</div></body></html>"

    rows = [(i, f"http://h/{i}", page(i)) for i in range(12)]
    # Copies of one page, alone on a host and beside others, and a line that stands on few pages, are no template.
    rows += [(100 + i, "http://copies/", page(1)) for i in range(6)] + [(200 + i, f"http://h/{i}", page(1)) for i in range(30)]
    rows += [(300 + i, f"http://few/{i}", page(i).replace(f"Body {i} is", "Body same is" if i < 2 else f"Body {i} is")) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    out = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert all(out[i] == f"Title {i}\n\nBody {i} is here.\n\nEnd {i}." for i in range(12))
    assert all("Share this story" in out[100 + i] and "Body 1 is here." in out[100 + i] for i in range(6))
    assert all(out[200 + i] == out[1] for i in range(30))
    assert all(out[300 + i].startswith(f"Title {i}\n\nBody {'same' if i < 2 else i} is here.") for i in range(9))


def test_ann_finds_the_largest_products(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[7] = x[8]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(900, None), (920, [0.0] * 16), (940, [float("nan")] * 16), (960, [None] * 16), (980, [1.0])]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id % 20 = 0").collect()
    d, hits = x.astype(float), 0
    for q in range(0, 600, 20):
        score = d @ d[q]
        score[q] = -np.inf
        want = set(np.lexsort((np.arange(600), -score))[:20])
        mine = sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and all(abs(r.score - score[r.vec_id]) < 1e-9 for r in mine)
        hits += len(want & {r.vec_id for r in mine})
    assert hits >= 0.9 * 600 and {r.query_id for r in out} == set(range(0, 600, 20))


def test_toxicity_separates_held_out_rows(spark):
    rng = random.Random(8)
    rows, labels = [(5000, None), (5001, "")], []
    for i in range(1500):
        bad = i % 3 == 0
        rows.append((i, " ".join(rng.choices(["vile", "rot", "scum"] if bad else ["calm", "sky", "tea"], k=3) + rng.choices([f"w{j}" for j in range(50)], k=20))))
        labels.append((i, int(bad)))
    out = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in out if r.held_out and r.doc_id < 1500]
    assert len(out) == len(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in held) >= 0.97 * len(held)


def test_toxicity_without_labels_of_both_classes_keeps_everything(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, None, "y"), (None, "c", "z")], "doc_id long, text string, score string")
    for labels in ([], [(1, None)], [(1, 1), (2, 1)]):
        known = spark.createDataFrame(labels, "doc_id long, toxic int")
        out = toxicity.toxicity(df, known).collect()
        assert all(r.score == 0 and r.predicted == 0 for r in out) and sorted(r.held_out for r in out if r.doc_id is None) == [True]
        kept = toxicity.drop_toxic(df, known)
        assert kept.count() == 3 and kept.columns == df.columns


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert jaccard_join.jaccard_components(none).count() == packing.pack(none).count() == mixing.mix(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == pii.find_personal_data(none).count() == toxicity.toxicity(none, labels).count() == 0
    assert html_extract.main_text(pages).count() == warc.archive_pages(pages).count() == 0
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id % 20 = 0").count() == 0
    assert chat.chat_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
