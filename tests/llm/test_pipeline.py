"""The pipeline as a whole: each stage's rows against a plain Python version of that stage on
the rows that reached it."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from quern.llm import quality, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    r = random.Random(6)
    texts = []
    for i in range(90):
        if i % 3 == 2:
            texts.append("BUY!! NOW!! $$$ CLICK!! " * (3 + i % 4))
        else:
            words = [r.choice("river stone town bridge field garden window letter morning winter story water".split()) + r.choice(("", "s", "ly")) for _ in range(80)]
            texts.append(f"menu é \n{' '.join(words[:40])}\n\n{' '.join(words[40:])}")
    texts += [texts[0], texts[1] + " end", texts[3].replace("menu é \n", "\tmenu é\n"), None, "", "menu é", "one\n two <|endoftext|>"]
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 4 // 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[4]]


def plain_quality(rows, labels):
    """The sample, its labels and the threshold; the network is the operator's numpy class."""
    known = defaultdict(int)
    for i, label, _ in labels:
        if i is not None and label is not None and zlib.crc32(str(i).encode()) % 5:
            known[i] = max(known[i], label)
    first = {}
    for row in rows:
        if row[0] in known:
            first[row[0]] = min(first.get(row[0], row[1] or ""), row[1] or "")
    model = quality.Model().fit([first[i].encode() for i in sorted(first)], np.array([known[i] for i in sorted(first)], np.float32))
    return [row for row in rows if model.score([(row[1] or "").encode()])[0] >= 0.3]


def plain_lines(rows):
    pages, seen, out = Counter(row[3] or "" for row in rows), Counter(), []
    for row in rows:
        for line in {x.strip(" \t\r") for x in (row[1] or "").split("\n")} - {""}:
            seen[row[3] or "", line] += 1

    def stays(host, line):
        n = seen[host, line]
        return not line or n < 2 or n / pages[host] <= 0.05

    for i, text, lang, source, *_ in rows:
        if text is not None:
            kept = [x for x in text.split("\n") if stays(source or "", x.strip(" \t\r"))]
            text = "\n".join(kept) if any(x.strip(" \t\r") for x in kept) else text
        out.append((i, text, lang, source, None if text is None else len(text)))
    return out


def plain_near_duplicates(rows):
    sets = []
    for row in rows:
        words = (row[1] or "").encode().lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a and len(a & b) >= 0.8 * len(a | b)):
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for row, g in zip(rows, group, strict=True):
        best[g] = min(best.get(g, row), row, key=lambda x: x[0])
    return list(best.values())


def check_packing(rows, pieces):
    """Every document's tokens once, in order; sequences without gaps, full or a power of two."""
    import tokenizers

    library = tokenizers.Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    want = {row[0]: [*library.encode(row[1] or "", add_special_tokens=False).ids, 1] for row in rows}
    got, spans = defaultdict(list), defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == len(got[p.doc_id]) and p.doc_tokens == len(want[p.doc_id])
        got[p.doc_id] += np.frombuffer(p.ids, "<u4").tolist()
        assert p.length == len(p.ids) // 4
        spans[p.sequence_id].append((p.offset, p.length))
    assert got == want
    for parts in spans.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048 and end & (end - 1) == 0


def test_every_stage_matches_plain_python(spark, tmp_path, monkeypatch):
    rows = documents()
    labels = [(i, int(i % 3 != 2), 0) for i in range(90)] + [(91, None, 0), (None, 1, 0)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    read = {}

    def watched(name, stage):
        def run(spark, docs, sf_dir):
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
            read[name] = [tuple(r) for r in docs.collect()]
            return stage(spark, docs, sf_dir)

        return name, run

    names = [name for name, _ in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*s) for s in corpus_pipeline.STAGES])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    first, lines, near, packed = (read[name] for name in names)
    assert names == ["quality classifier", "line dedup", "near-dedup", "packing"]
    assert Counter(first) == Counter(rows)
    assert Counter(lines) == Counter(plain_quality(first, labels)) and len(lines) < len(first) - 20
    assert Counter(near) == Counter(plain_lines(lines)) and Counter(near) != Counter(lines)
    assert Counter(packed) == Counter(plain_near_duplicates(near)) and len(packed) < len(near)
    check_packing(packed, pieces)


ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n", "en", "s", 3), (None, "river stone town", "en", None, 16), (4, "river stone town", None, "s", None),
    (5, "word " * 60_000, "en", "s", 300_000), (6, "menu\nriver one", "en", "s", 14), (7, "menu\nriver two", "en", "s", 14), (7, "menu\nriver two", "en", "s", 14), (7, "another text of this id", "en", "s", 23),
]


def odd(spark, rows=ODD):
    """Extra columns take names that the stages use for counts, scores, keys and results."""
    more = ", ".join(f"{c} string" for c in ("score", "n_lines", "dropped_lines", "label", "fp", "comp", "host", "length", "__row", "__host"))
    return spark.createDataFrame([(*r, *("z" * 10)) for r in rows], f"{SCHEMA}, {more}")


def test_stages_with_odd_rows(spark, tmp_path):
    labels = [(i, i % 2, 0) for i in range(30)] + [(6, None, 0), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages, docs = dict(corpus_pipeline.STAGES), odd(spark)
    all_rows = Counter(tuple(r) for r in docs.collect())
    for name in ("quality classifier", "line dedup", "near-dedup"):
        got = stages[name](spark, docs, str(tmp_path))
        assert got.columns == docs.columns and stages[name](spark, docs.limit(0), str(tmp_path)).count() == 0
        rows = got.collect()
        assert all(set(r[5:]) == {"z"} for r in rows)
        if name == "quality classifier":  # equal texts share their fate
            assert not Counter(tuple(r) for r in rows) - all_rows
            kept = {r["text"] for r in rows}
            assert len(rows) == sum(r[1] in kept for r in ODD)
        elif name == "line dedup":
            want = Counter(r[:5] for r in plain_lines(ODD))
            assert Counter(tuple(r)[:5] for r in rows) == want
            texts = Counter(r["text"] for r in rows)
            assert texts["river one"] == 1 and texts["menu\nriver two"] == 2  # the repeated page is boilerplate as a whole
        else:
            assert sorted((r["doc_id"], (r["text"] or "")[:9]) for r in rows) == [(1, ""), (4, "river sto"), (5, "word word"), (6, "menu\nrive"), (7, "another t"), (7, "menu\nrive")]
    check_packing([(1, ""), (4, "river stone town"), (5, "word " * 60_000)], [r for r in stages["packing"](spark, docs, str(tmp_path)).collect() if r.doc_id in (1, 4, 5)])
    assert stages["packing"](spark, docs, str(tmp_path)).groupBy("doc_id").count().count() == 8
    assert stages["packing"](spark, docs.limit(0), str(tmp_path)).count() == 0
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert stages["quality classifier"](spark, docs, str(tmp_path / "none")).count() == len(ODD)  # nothing learned, nothing rejected
