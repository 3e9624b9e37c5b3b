"""Each operator against brute force on a small table with nulls, empty and long texts, ties,
repeated rows and clashing columns, and on an empty table."""

import hashlib
import heapq
import math
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import byte_bpe, line_dedup, packing, quality, queries, sharding, shingle_sets, simhash, token_count, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, ids string"
LONG = "word and more words " * 3000
TEXTS = ["a b c d e f", "a b c d e f", "A B c d e f", "", None, " \n\t", LONG, LONG + "end", "one", "one two", "été <|endoftext|> don't 12", "x\ny\nx", "￿ tail"]


def docs(spark, texts=TEXTS):
    rows = [(None if i == 2 else i, t, "en", None if i % 5 == 4 else f"s{i % 2}", None, 3, 1.0, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0]] if rows else [], SCHEMA)


def values(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def descend(key, topology):
    """The shard of a key, level by level: the least of -ln(u) / weight among a node's children."""
    base = "" if key is None else str(key)

    def draw(path, weight):
        u = (int(hashlib.md5(f"{base}/{path}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / weight

    def pick(path, weights):
        return min((draw(f"{path}{i}", w), i) for i, w in enumerate(weights) if w > 0)[1]

    i = pick("", [sum(map(sum, region)) for region in topology.regions])
    j = pick(f"{i}.", [sum(rack) for rack in topology.regions[i]])
    k = pick(f"{i}.{j}.", topology.regions[i][j])
    return sum(len(rack) for region in topology.regions[:i] for rack in region) + sum(map(len, topology.regions[i][:j])) + k


@pytest.mark.parametrize("topology", [sharding.Topology.balanced(4, 2, 2), sharding.Topology((((1.0, 3.0), (2.0, 0.0)), ((2.0,),), ((0.5, 0.25, 4.0),)))])
def test_sharding(spark, topology):
    texts = [*TEXTS, *(f"text {i}" for i in range(300))]
    rows = docs(spark, texts).union(docs(spark, texts[6:8])).collect()
    rows += [rows[0]] * 500  # repeated as a whole
    got = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA), topology).collect()
    want = Counter()
    for r in rows:
        t = (r.text or "").encode()
        want[r.doc_id, len(t) + 1, zlib.crc32(t), "key", descend(r.doc_id, topology), descend(r.doc_id, topology.grow())] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    by_shard = Counter(r.shard for r in got)
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in sorted(by_shard) for i in range(by_shard[s])]
    assert all(r.grown_shard in (r.shard, topology.n_shards) for r in got)
    assert sharding.shard_documents(docs(spark, []), topology).count() == 0


def test_sharding_moves_rows_only_into_the_new_shard_and_follows_weights(spark):
    top = sharding.Topology((((1.0, 3.0), (2.0,)), ((2.0,),)))
    df = sharding.place(spark.range(8000), F.col("id"), top, "a")
    rows = sharding.place(df, F.col("id"), top.grow(), "b").collect()
    share = Counter(r.a for r in rows)
    assert [round(share[s] / 8000, 1) for s in range(4)] == [0.1, 0.4, 0.2, 0.2] or abs(share[1] / 8000 - 3 / 8) < 0.03
    assert all(r.b in (r.a, 4) for r in rows) and any(r.b == 4 for r in rows)


def values_of_unruled(rows):
    return [tuple(r)[1:] for r in rows if r.rule is None]


def test_url_filter(spark):
    urls = ["http://A.Example.net/en/x?q", "https://example.com/de/", "http://x.org/fr/1#f", "http://y.net", "nourl", None, "ftp://bad.example.com/z", "http://q.org/en"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls * 3)], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(i, i % 8 == 6) for i in range(24) if i % 8 != 4] + [(0, False), (None, True), (4, None)], "page_id long, bad boolean")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge_pages(pages, outcomes, queries.RULES, max_bad=0.05, z=0.5).collect()}
    assert len(got) == 24
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1][2:] == ("example.com/de/", "block") and got[2][2:] == ("org/fr/", "allow")
    assert got[3][:3] == ("y.net", "", None) and got[4][:3] == got[5][:3] == ("", "", None)
    assert got[6][2:] == (None, "block")
    assert {v[3] for v in values_of_unruled(url_filter.judge_pages(pages, outcomes.limit(0), queries.RULES).collect())} == {"allow"}
    assert url_filter.judge_pages(pages.limit(0), outcomes.limit(0), queries.RULES).count() == 0


def test_packing(spark):
    import tokenizers

    path, pattern = queries.vocabulary("byte_bpe_50k.json"), queries.pretoken_pattern()
    pieces = packing.pack_documents(docs(spark), path, pattern).collect()
    library = tokenizers.Tokenizer.from_file(path)
    want = {None if i == 2 else i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}
    copies, covered, by_seq = Counter([*want, 0]), {i: np.zeros(len(t), int) for i, t in want.items()}, {}
    for p in pieces:
        assert np.frombuffer(p.ids, "<u4").tolist() == want[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(want[p.doc_id]) and p.length == len(p.ids) // 4 > 0
        covered[p.doc_id][p.start : p.start + p.length] += 1
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert all((c == copies[i]).all() for i, c in covered.items())  # each id of each document once
    for parts in by_seq.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts[:-1]]]).tolist()
        used = sum(n for _, n in parts)
        assert used <= 2048 and used & (used - 1) == 0  # full or a power of two: no padding
    assert packing.pack_documents(docs(spark, []), path, pattern).count() == 0


def test_packing_takes_the_ids_of_the_json_file():
    import pyarrow.parquet as pq
    import tokenizers

    path = queries.vocabulary("byte_bpe_50k.json")
    texts = [*TEXTS, "<|endoftext|><|endoftext|> x", "\x00\u2028\u00a0 a\u0301 \U0001f468\u200d\U0001f469", "'S don't 12345 \t\t\n\n x", "<|endoftext", "ſ İ ß"]
    known = Path("/root/testdata/sf0.01/documents.parquet")
    texts += pq.read_table(known, columns=["text"]).column(0).to_pylist() if known.exists() else []
    texts = [t or "" for t in texts]
    encoder, library = packing._encoder(path, queries.pretoken_pattern()), tokenizers.Tokenizer.from_file(path)
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder.encode(text, allowed_special="all") == e.ids


def test_url_hierarchy_and_odd_urls(spark):
    hosts = {
        "u:p@a.b.example.co.uk:8080": ("a.b.example.co.uk", "example.co.uk", "co.uk"), "example.com:8080": ("example.com", "example.com", "com"),
        "10.0.0.1:80": ("10.0.0.1",) * 3, "[::1]:443": ("[::1]",) * 3, "x.y.z.kobe.jp": ("x.y.z.kobe.jp", "kobe.jp", "jp"), "example.com.": ("example.com", "example.com", "com"),
        "localhost": ("localhost",) * 3, "": ("",) * 3, "1.2.3": ("1.2.3", "2.3", "3"), "co.uk": ("co.uk",) * 3,
    }
    df = spark.createDataFrame([(h,) for h in hosts], "raw string").withColumn("host", url_filter.site_of(F.col("raw")))
    assert {r.raw: (r.host, r.domain, r.suffix) for r in url_filter.with_domain(df).collect()} == hosts
    table = spark.createDataFrame([("z.kobe.jp",), ("kobe.jp",), ("kobe.jp",)], "s string")
    found = {r.raw: (r.domain, r.suffix) for r in url_filter.with_domain(df, table).collect()}
    assert found["x.y.z.kobe.jp"] == ("y.z.kobe.jp", "z.kobe.jp") and found["u:p@a.b.example.co.uk:8080"] == ("co.uk", "uk")
    urls = [f"http://bad.example.com:{8000 + i}/x" for i in range(40)] + ["http://bad.example.com/" + "y" * 200_000, "http://10.0.0.1/", "http://fine.org/"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, rule string")
    outcomes = spark.createDataFrame([(i, i < 40) for i in range(43)], "page_id long, bad boolean")
    got = url_filter.judge_pages(pages, outcomes, [], z=0.5).collect()
    assert len(got) == 44 and {r.host.split(":")[0]: r.verdict for r in got} == {"bad.example.com": "block", "10.0.0.1": "allow", "fine.org": "allow"}
    assert max(len(r.path) for r in got) == 200_001 and got[0].host == "bad.example.com:8000"


def test_quality_of_very_long_texts(monkeypatch):
    r = np.random.default_rng(3)
    text = b" ".join(b"w%d" % x + b"\n" * int(x % 3 == 0) for x in r.integers(0, 1000, 3000))
    whole = quality.Bags.of([text])
    for most in (40, 700, 5000, 10**6):
        parts = list(quality.segments(text, most))
        counts = [len(p.split()) for p in parts]
        assert sum(counts) == 3000 and all(n % quality.PASSAGE == 0 for n in counts[:-1]) and b" ".join(p for p in parts).split() == text.split()
    assert list(quality.segments(b"x" * 5000, 100)) == [b"x" * 5000] and list(quality.segments(b"", 100)) == [b""]
    model = quality.Model().start()
    want = model.score([text, b"short", text[:100]])
    monkeypatch.setattr(quality, "GROUP", 600)
    monkeypatch.setattr(quality, "segments", lambda t, cut=quality.segments: cut(t, 600))
    assert model.score([text, b"short", text[:100]]) == pytest.approx(want, abs=2e-3)
    assert quality.some_features(text, 7).shape == (7, 520) and quality.some_features(b"", 7).shape == (1, 520)
    ends = quality.some_features(text, 2).astype(np.float32)  # the first and the last passage: not a prefix
    assert ends[1] == pytest.approx(whole.features(59, 60)[0], abs=2e-2)


def test_quality_learns_and_handles_odd_texts(spark):
    good, bad = "the river ran over the old stones and into the town ", "BUY!! NOW!! $$$ CLICK!! "
    texts = [(good if i % 2 else bad) * (1 + i % 7) for i in range(200)] + ["", None, LONG]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score_documents(df, labels).collect()
    assert len(rows) == len(texts) + 1 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 200]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.predicted == r.doc_id % 2 for r in held)
    assert {r.score for r in quality.score_documents(df, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(docs(spark, []), labels).columns == df.columns


def plain_lines(rows, max_ratio=0.05):
    """(doc, text, host) -> {doc: (text, lines, dropped lines)} by counting pages."""
    pages, seen, out = Counter(h or "" for _, _, h in rows), Counter(), {}
    for _, text, host in rows:
        for line in {x.strip(" \t\r") for x in (text or "").split("\n")} - {""}:
            seen[host or "", line] += 1

    def stays(host, line):
        n = seen[host, line]
        return not line or n < 2 or n / pages[host] <= max_ratio

    for i, text, host in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if stays(host or "", x.strip(" \t\r"))]
        if not any(x.strip(" \t\r") for x in kept):
            kept = lines
        out[i] = (None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_line_dedup_matches_brute_force(spark):
    r = np.random.default_rng(6)
    texts = [f"menu \nunique {i}\n\nmenu" for i in range(20)] + ["plain\nmenu", None, "", "menu", " \t\n\r\n", LONG, "x" * 100_000 + "\nmenu"]
    rows = [(i, t, "s" if i < 20 else None) for i, t in enumerate(texts)]
    rows += [(100 + i, "\n".join(f"line {r.integers(0, 60)}" + " " * r.integers(0, 2) for _ in range(8)), f"h{i % 3}") for i in range(90)]
    rows += [(300 + i, "a copied page\nof two lines", "h0") for i in range(30)]  # a third of its host
    rows += [(400 + i, t, "few") for i, t in enumerate(["home\none", "home\ntwo", "home\nthree", "home"])] + [(500, "alone\non its host", "single")]
    df = spark.createDataFrame([(*row, 7, row[0], "z", 1) for row in rows], "doc_id long, text string, source string, n_lines int, dropped_lines long, host string, __text int")
    found = line_dedup.drop_boilerplate(df, F.col("source"))
    assert found.columns == [*df.columns, "n_lines_", "dropped_lines_"]
    got = {r.doc_id: r for r in found.collect()}
    want = plain_lines(rows)
    assert {i: (r.text, r.n_lines_, r.dropped_lines_) for i, r in got.items()} == want
    assert all((r.n_lines, r.dropped_lines, r.host, r["__text"]) == (7, i, "z", 1) for i, r in got.items())
    assert all(want[i][0] == f"unique {i}\n" for i in range(20)) and want[300] == ("a copied page\nof two lines", 2, 0)
    assert [want[i][0] for i in (400, 401, 402, 403, 500)] == ["one", "two", "three", "home", "alone\non its host"]
    assert any(d for _, _, d in want.values()) and sum(i >= 100 and i < 190 and d > 0 for i, (_, _, d) in want.items()) > 20
    assert line_dedup.drop_boilerplate(df, F.col("source"), counts=False).columns == df.columns
    assert line_dedup.drop_boilerplate(df.limit(0), F.col("source")).count() == 0
    twice = line_dedup.drop_boilerplate(df.union(df), F.col("source"), counts=False)
    assert twice.count() == 2 * len(rows)
    bare = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(df, F.col("source"), keep_whole=False, counts=False).collect()}
    assert bare[300] == bare[403] == "" and bare[400] == "one"


def plain_fingerprint(t):
    from xxhash import xxh64_intdigest

    words = (t or "").encode().lower().split()
    h = [xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    got = simhash.near_duplicates(docs(spark)).collect()
    texts = [*enumerate(TEXTS), (0, TEXTS[0])]
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((None if i == 2 else i, f"{plain_fingerprint(t):016x}") for i, t in texts)
    by_doc = {r.doc_id: r.component_id for r in got}
    assert by_doc[1] == by_doc[None] == 0 and by_doc[3] == by_doc[4] == by_doc[5] == 3
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    kept = simhash.keep_one(docs(spark))
    assert kept.columns == docs(spark).columns and sorted(r.doc_id for r in kept.collect())[:2] == [0, 3]


def test_kept_documents_match_brute_force(spark):
    r = np.random.default_rng(2)
    base, texts = [f"w{x}" for x in r.integers(0, 5000, 120)], [*TEXTS]
    for i in range(150):  # one large group of near copies, and groups of two
        words = base if i < 100 else [f"v{x}" for x in r.integers(0, 5000, 90)]
        for _ in range(1 if i < 100 else 2):
            words = [*words]
            for j in r.integers(0, len(words), r.integers(0, 4)):
                words[j] = f"e{r.integers(0, 10**6)}"
            texts.append(" ".join(words))
    rows = {i: t for i, t in enumerate(texts) if i != 2}
    sets, group = {}, {}
    for i, t in rows.items():
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        near = {group[j] for j in group if sets[i] == sets[j] or (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))}
        group[i] = min(near | {i})
        group |= {j: group[i] for j, g in group.items() if g in near}
    kept = [r.doc_id for r in simhash.keep_one(docs(spark, texts)).select("doc_id").collect()]
    assert sorted(kept) == sorted(set(group.values())) and len(kept) < len(texts) - 100
    assert simhash.keep_one(docs(spark, [])).count() == 0


def test_a_shared_passage_brings_few_together(spark):
    """300 unlike sets in one bucket that share a third of their hashes, and twins of some."""
    r = np.random.default_rng(7)
    passage, sets = r.integers(-(2**62), 2**62, 50), []
    for i in range(300):
        sets.append(np.unique(np.concatenate([passage, r.integers(-(2**62), 2**62, 100)])))
    sets += [np.unique(np.concatenate([s[:-5], r.integers(-(2**62), 2**62, 5)])) for s in sets[:30]]
    placed = spark.createDataFrame([(0, 9, i, i) for i in range(330)], "band int, key long, node long, comp long")
    known = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "node long, set array<long>")
    assert sorted(values(shingle_sets.open_links(placed, known, 0.8, large=100), "u", "v")) == [(300 + i, i) for i in range(30)]
    dealt = shingle_sets.prefix_buckets(placed, known, 0.8)
    assert dealt.groupBy("key").count().agg(F.max("count")).first()[0] < 10


def test_blocks_of_a_bucket_join_all_that_is_similar(spark):
    r = np.random.default_rng(5)
    base, sets = r.integers(-(2**62), 2**62, 100), []
    for i in range(60):  # about half of the pairs are similar, some only by way of others
        own = base.copy() if i < 45 else r.integers(-(2**62), 2**62, 100)
        own[r.integers(0, 100, r.integers(0, 18))] = i
        sets.append(np.unique(own))
    labels = list(range(60))
    near = [(i, j) for i in range(60) for j in range(i) if (b := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - b)]
    for i, j in near:
        labels = [min(labels[i], labels[j]) if x in (labels[i], labels[j]) else x for x in labels]
    comp = [0 if i < 20 and labels[i] == 0 else i for i in range(60)]  # part of the group is joined already
    placed = spark.createDataFrame([(b, 9, i, comp[i]) for b in range(2) for i in range(60)], "band int, key long, node long, comp long")
    known = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "node long, set array<long>")
    for sizes in ({}, {"block_nodes": 7}, {"block_hashes": 1500}, {"large": 10}, {"large": 10, "block_nodes": 5}):
        found = values(shingle_sets.open_links(placed, known, 0.8, **sizes), "u", "v")
        assert set(found) <= set(near) and len(found) < len(near)
        mine = list(comp)
        for i, j in found:
            mine = [min(mine[i], mine[j]) if x in (mine[i], mine[j]) else x for x in mine]
        assert mine == labels and len(set(labels)) > 10
    one = placed.withColumn("comp", F.lit(0).cast("long"))
    assert shingle_sets.open_links(one, known, 0.8).count() == shingle_sets.open_links(placed.limit(0), known, 0.8).count() == 0


@pytest.mark.parametrize(("shard_size", "sample_size"), [(8192, 65_536), (200, 500), (50, 320)])
def test_simhash_links_match_brute_force(spark, monkeypatch, shard_size, sample_size):
    r = np.random.default_rng(1)
    points = [r.integers(0, 2**63, 600).astype(np.uint64)]
    for _ in range(6):
        points.append(points[-1][:500] ^ (np.uint64(1) << r.integers(0, 64, 500).astype(np.uint64)))
    p = np.unique(np.concatenate(points))
    fps = spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "fp long")
    made, divide = [], simhash.divided
    monkeypatch.setattr(simhash, "divided", lambda *a: made.append(divide(*a)) or made[-1])
    roots = dict(values(simhash.connect(simhash.links(fps, 2, shard_size, sample_size)), "u", "v"))
    assert len(made) == (shard_size < 8192)
    if made:  # every point is somewhere, and no shard is far too large
        sizes = made[0].groupBy("shard").count()
        assert made[0].select("fp").distinct().count() == len(p) and max(r[1] for r in sizes.collect()) < 6 * shard_size
    near, labels = np.bitwise_count(p[:, None] ^ p[None, :]) <= 2, np.arange(len(p))
    while True:
        low = np.where(near, labels[None, :], len(p)).min(1)
        if (low == labels).all():
            break
        labels = low
    mine = [roots.get(int(x), int(x)) for x in p.view(np.int64)]
    assert len(set(zip(mine, labels.tolist(), strict=True))) == len(set(mine)) == len(set(labels.tolist()))


def test_token_counts(spark):
    import tokenizers

    path = queries.vocabulary("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    got = values(token_count.count_tokens(docs(spark), path), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = Counter()
    for i, t in [*enumerate(TEXTS), (0, TEXTS[0])]:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[(None if i == 2 else i, len((t or "").encode()), n, n > 2048)] += 1
    assert Counter(got) == want
    assert token_count.count_tokens(docs(spark, []), path).count() == 0


def merge_by_heap(bpe, piece):
    """The same merges one by one, by a heap of (rank, position) over linked tokens."""
    ids = bpe.single[np.frombuffer(piece, np.uint8)].tolist()
    size = len(ids)
    after, before, gone = list(range(1, size + 1)), list(range(-1, size - 1)), bytearray(size)

    def pair(i):
        return bpe.ranks.get(bpe.tokens[ids[i]] + bpe.tokens[ids[after[i]]]) if after[i] < size else None

    heap = [(r, i) for i in range(size) if (r := pair(i)) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if gone[i] or pair(i) != r:
            continue
        j = after[i]
        ids[i], after[i], gone[j] = r, after[j], 1
        if after[j] < size:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and (x := pair(k)) is not None:
                heapq.heappush(heap, (x, k))
    return np.array([t for t, g in zip(ids, gone) if not g], "<u4").tobytes()


def test_matrices_of_any_width_merge_in_order():
    bpe = byte_bpe.ByteBPE(queries.vocabulary("byte_bpe_multi_50k.tiktoken"), queries.pretoken_pattern())
    r = np.random.default_rng(0)
    letters = np.frombuffer(b"etaoinshrdlu", np.uint8)
    pieces = [r.choice(letters, n).tobytes() for n in (2, 3, 127, 128, 129, 255, 256, 257, 300, 511, 513, 1000, 5000, 40_000)]
    pieces += [b"a" * 1025, b"\xff" * 700, ("é" * 400).encode(), b"the" * 300, r.integers(0, 256, 3000, np.uint8).tobytes()]
    assert bpe.merge_rows(pieces) == [merge_by_heap(bpe, p) for p in pieces]
    assert bpe.merge_rows([]) == []


def test_byte_bpe_round_trip(spark):
    import base64

    import tiktoken

    path, pattern = queries.vocabulary("byte_bpe_multi_50k.tiktoken"), queries.pretoken_pattern()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    long = "".join(np.random.default_rng(1).choice(list("etaoinshrdlu"), 100_000))
    texts = [*TEXTS, "a" * 5000, "é" * 400 + " " * 700, "漢字😀 \x1c\x85", long, long[:257], long[:5000] + " x", "ab" * 300 + " " + "ab" * 300]
    want = Counter()
    for i, t in [*enumerate(texts), (0, texts[0])]:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        want[(None if i == 2 else i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(values(byte_bpe.round_trip(docs(spark, texts), path, pattern), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == want
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(docs(spark), path, pattern), path, pattern)
    assert Counter(bytes(r[1]) for r in values(back, "doc_id", "decoded")) == Counter((t or "").encode() for t in [*TEXTS, TEXTS[0]])
    assert byte_bpe.round_trip(docs(spark, []), path, pattern).count() == 0
