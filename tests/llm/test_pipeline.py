"""The pipeline, stage by stage, against a brute-force version on a small corpus."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from lodeworks.llm import compressor, decontaminate, simhash
from lodeworks.llm.common import table
from lodeworks.llm.tokens import words

from .test_brute_force import corpus, norm, one_edit


def plant(spark, folder):
    rng = random.Random(12)
    voc, docs = corpus(rng, 120, size=120, vocabulary=900)
    items = [[rng.choice(voc) for _ in range(25)] for _ in range(5)]
    texts, labels = [], []
    for i, d in enumerate(docs):
        if i % 6 == 5:
            d = [f"{w}{rng.choice(['%%%', '###'])}" for w in d]
        if i % 11 == 3 and i % 6 != 5:
            d[5:5] = items[i % 5]
        lines = [" ".join(d[k : k + 15]) for k in range(0, len(d), 15)]
        if i % 7 == 1:
            lines.insert(0, "the same first line everywhere")
        texts.append("\n".join(lines))
        labels.append((i, int(i % 6 != 5), 0))
    texts[8] = "the same first line everywhere\n\n \t\u00a0\nthe same first line everywhere"  # nothing is left of it
    texts += [texts[0], " ".join(texts[1].replace("\n", " ").split()[::-1]), texts[2].replace("\n", " ").upper()]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(900, None, "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {r[0]: r[1] for r in rows}, items


def brute_quality(spark, docs, folder):
    m = compressor.fit(spark, table(spark, folder, "documents"), table(spark, folder, "labels"))
    size = compressor.Sizer(m.dictionaries)
    out = {}
    for i, t in docs.items():
        b = (t or "").encode()
        low, toxic = compressor.probabilities(m, np.array([size(b)], dtype=float), np.array([len(b)]))
        if not b or (1 - low[0]) * (1 - toxic[0]) >= compressor.THRESHOLD:
            out[i] = t
    return out


def brute_lines(docs):
    flat = [(i, k, x) for i, t in sorted(docs.items()) if t is not None for k, x in enumerate(t.split("\n"))]
    out = {}
    for i, t in docs.items():
        if t is None:
            out[i] = t
            continue
        kept = [x for k, x in enumerate(t.split("\n")) if not any((d, n) < (i, k) and (y == x or one_edit(x, y)) for d, n, y in flat)]
        if "".join(kept).strip():
            out[i] = "\n".join(kept)
    return out


def brute_near(docs):
    ids = [i for i, t in sorted(docs.items()) if t]
    f = np.concatenate([simhash.fingerprints(w)[0] for w in words(pa.array([docs[i] for i in ids]))])
    near = np.bitwise_count(f[:, None] ^ f[None]).sum(2) <= simhash.RADIUS
    label = list(range(len(ids)))
    for a, b in zip(*np.nonzero(near)):
        x, y = label[a], label[b]
        label = [min(x, y) if v in (x, y) else v for v in label]
    gone = {ids[k] for k, v in enumerate(label) if v != k}
    return {i: t for i, t in docs.items() if i not in gone}


def brute_benchmark(docs, items):
    def near(words_, item):
        row = [0] * (len(words_) + 1)
        for x in item:
            last, row[0] = row[0], row[0] + 1
            for c, y in enumerate(words_, 1):
                last, row[c] = row[c], min(row[c] + 1, row[c - 1] + 1, last + (x != y))
        return min(row) <= int(len(item) * decontaminate.RATE)

    return {i: t for i, t in docs.items() if not t or not any(near(norm(t), x) for x in items)}


def test_pipeline(spark, tmp_path):
    folder = str(tmp_path / "sf")
    docs, items = plant(spark, folder)
    want = [brute_quality(spark, docs, folder)]
    want.append(brute_lines(want[-1]))
    want.append(brute_near(want[-1]))
    want.append(brute_benchmark(want[-1], items))
    assert len(docs) > len(want[0]) > len(want[1]) >= len(want[2]) > len(want[3])
    now = table(spark, folder, "documents")
    columns = now.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, now, folder).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert now.columns == columns
        assert {r.doc_id: r.text for r in now.collect()} == want[k], k
    taken = corpus_pipeline.run(spark, folder).collect()
    left = {r.doc_id: r for r in now.collect()}
    assert {r.doc_id for r in taken} <= set(left) and all(r.text == left[r.doc_id].text for r in taken)
    size = lambda t: len((t or "").split())
    total = {s: sum(size(r.text) for r in left.values() if r.source == s) for s in ("s0", "s1", "s2")}
    for s, n in total.items():
        share = min(total.values()) / n
        own = [size(r.text) for r in taken if r.source == s]
        assert abs(sum(own) - share * n) <= 120 and abs(len(own) - share * sum(r.source == s for r in left.values())) <= 1.5


def test_no_near_copy_is_left(spark):
    """The stage that keeps one of near copies, of more documents than a sampled bucket held."""
    rng = random.Random(17)
    voc = [f"w{k}" for k in range(5000)]
    docs = [[rng.choice(voc) for _ in range(60)] for _ in range(900)]
    docs += [[rng.choice(voc) if k < 11 else w for k, w in enumerate(d)] for d in docs]
    texts = {i: " ".join(d) for i, d in enumerate(docs)}
    left = corpus_pipeline.near(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "")
    want = brute_near(texts)
    assert len(want) < 1600 and {r.doc_id for r in left.collect()} == set(want)


def test_no_item_at_the_edit_bound_is_left(spark, tmp_path):
    rng = random.Random(18)
    word = lambda: f"v{rng.randrange(4000)}"
    items = [[word() for _ in range(rng.choice([4, 5, 11, 25, 40]))] for _ in range(300)]
    docs = []
    for x in items:
        for more in (0, 1):  # as many edits as the bound allows, and one more
            copy = list(x)
            for _ in range(int(len(x) * decontaminate.RATE) + more):
                at = rng.randrange(len(copy))
                rng.choice([lambda: copy.pop(at), lambda: copy.insert(at, word()), lambda: copy.__setitem__(at, word())])()  # noqa: B023
            docs.append([word() for _ in range(rng.choice([0, 3, 60]))] + copy + [word() for _ in range(rng.choice([0, 2, 50]))])
    texts = {i: " ".join(d) for i, d in enumerate(docs)}
    spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.benchmark(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), str(tmp_path))

    def met(d, x):  # columns of the table of edit distances, a part of the document beginning anywhere
        row = np.zeros(len(d) + 1, dtype=int)
        step = np.arange(len(d) + 1)
        for k, w in enumerate(x, 1):
            best = np.concatenate(([k], np.minimum(row[1:] + 1, row[:-1] + np.array([v != w for v in d]))))
            row = np.minimum.accumulate(best - step) + step
        return row.min() <= int(len(x) * decontaminate.RATE)

    # items share too few words for any but the planted one to be near
    want = {k for k, d in enumerate(docs) if not met(d, items[k // 2])}
    assert 100 <= len(want) <= 300 and {r.doc_id for r in left.collect()} == want
