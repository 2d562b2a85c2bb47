"""The corpus pipeline: every stage on what its predecessor kept, against brute force on small tables."""

import collections
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_ops import passages, sample
from tidegraph.llm import mixing, quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_columns_and_shrink(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == docs.columns and 0 < out.count() < n
    assert out.select("doc_id").distinct().count() == out.count()


def tables(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def bag(text):
    w = text.lower().split()
    return collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def similar(a, b):
    n = sum((a & b).values())
    return n / max(1, a.total() + b.total() - n)


def test_pipeline_by_brute_force(spark, tmp_path):
    rng, item = random.Random(1), sample(1, 30, 500)[0]
    shared = "\n".join(sample(3, 20, 501))
    rows = []
    for i, t in enumerate(sample(60, 80, 502)):
        w = t.split()
        text = "\n".join(" ".join(w[k : k + 10]) for k in range(0, 80, 10))
        kind = i % 6
        if kind == 1:
            text = text + "\n" + shared
        elif kind == 2:
            text = text + "\n" + item
        elif kind == 3:
            text = "short one"
        elif kind == 4:  # a near copy of the document four before, on one line
            near = rows[i - 4][1].split()
            near[rng.randrange(len(near))] = "changed"
            text = " ".join(near)
        rows.append((i, text, "en" if i % 2 else "de", f"s{i % 3}", len(text)))
    folder = tables(spark, tmp_path / "t", rows, [(r[0], 1, 0) for r in rows], [(0, item)])

    # quality: one class of labels teaches no rule, so the base rule alone decides
    left = []
    for r in rows:
        n_words, *_, again = quality_rules.stats_of(r[1])[:5]
        if n_words >= 50 and not 100 * again > 50 * n_words:
            left.append(r)
    # line dedup
    owner, cut = {}, []
    for r in left:
        gone = {k for run, places in passages(r[1]) if owner.get(run, r[0]) < r[0] for k in places}
        for run, _ in passages(r[1]):
            owner.setdefault(run, r[0])
        text = "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone)
        if text.strip():
            cut.append((r[0], text, r[2], r[3], len(text) if gone else r[4]))
    # near duplicates: the first of each class
    bags, first = {r[0]: bag(r[1]) for r in cut}, {r[0]: r[0] for r in cut}

    def root(x):
        while first[x] != x:
            x = first[x]
        return x

    for a in bags:
        for b in bags:
            if a < b and similar(bags[a], bags[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                first[y] = x
    alone = [r for r in cut if root(r[0]) == r[0]]
    # decontamination
    own = bag(item)
    clean = [r for r in alone if max(similar(bag(" ".join(r[1].split()[s : s + 30])), own) for s in range(max(1, len(r[1].split()) - 29))) < 0.8]
    assert len(rows) > len(left) > len(alone) > len(clean) and any(r[1] not in {x[1] for x in rows} for r in cut)
    # mixing
    form = lambda t: "table" if " | " in t else "long" if len(t.split()) >= 1000 else "medium" if len(t.split()) >= 200 else "short"
    cells = collections.Counter()
    for r in clean:
        cells[r[3], r[2], form(r[1])] += len(r[1].split())
    keys = sorted(cells)
    names = [sorted({k[m] for k in keys}) for m in range(3)]
    index = [np.array([names[m].index(k[m]) for k in keys]) for m in range(3)]
    tokens = np.array([cells[k] for k in keys], float)
    goals = []
    for m in range(3):
        have = np.bincount(index[m], weights=tokens) ** mixing.FLATTEN
        goals.append(have / have.sum())
    p = dict(zip(keys, mixing.KEEP * tokens.sum() * mixing.rake(index, tokens, goals) / tokens, strict=True))
    draw = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 4294967296.0
    want = sorted(r for r in clean if draw(r[0]) < p[r[3], r[2], form(r[1])])
    assert want and len(want) < len(clean)

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for (_, stage), after in zip(corpus_pipeline.STAGES, (left, cut, alone, clean, want), strict=True):
        got = stage(spark, docs, folder)
        assert got.columns == COLUMNS
        docs = got.checkpoint()
        assert sorted(map(tuple, docs.collect())) == sorted(after)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == want


def test_stages_on_odd_tables(spark, tmp_path):
    long = "\n".join(sample(900, 40, 510))
    rows = [(None, sample(1, 60, 511)[0], None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, long, "en", "s", len(long)), (3, long, "en", "s", len(long)), (4, sample(1, 60, 512)[0], None, "s", 9)]
    for name, docs, labels, items in (("odd", rows, [(3, 1, 0), (3, 0, 0), (None, 0, 1)], [(None, "x"), (1, None), (2, "a b")]), ("none", [], [], [])):
        folder = tables(spark, tmp_path / name, docs, labels, items)
        for _, stage in corpus_pipeline.STAGES:
            df = spark.createDataFrame(docs, SCHEMA).withColumn("verdict", F.lit(1)).withColumn("removed", F.lit(2)).withColumn("probability", F.lit(3)).withColumn("class_id", F.lit(4))
            out = stage(spark, df, folder)
            assert out.columns == df.columns and out.count() <= len(docs)
    assert {r.doc_id for r in corpus_pipeline.quality(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path / "odd")).collect()} == {None, 3, 4}
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()) == [0, 1, 3, 4]
