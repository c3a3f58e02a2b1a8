"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import itertools
import math
import random
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from lodeworks.llm import compressor, credentials, cube, decontaminate, linededup, multiindex, passages, sanitise, simhash, warc
from lodeworks.llm.tokens import words

SF = "/root/testdata/sf0.001"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u9fff\uf900-\ufaff"


def norm(text):
    """Words by the rules of tokens.py, character by character."""
    kept = "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in text.lower())
    return re.findall(f"[{_ALONE}]|[^ {_ALONE}]+", kept)


def one_edit(x, y):
    """One character or one word apart, by the bounds of linededup.py; x and y differ."""
    a, b = x.split(" "), y.split(" ")
    chars = min(len(x), len(y)) >= linededup.MIN_FUZZY and abs(len(x) - len(y)) < 2 and levenshtein(x, y) == 1
    return chars or min(len(a), len(b)) >= linededup.MIN_WORDS and abs(len(a) - len(b)) < 2 and levenshtein(a, b) == 1


def corpus(rng, n, size=200, vocabulary=4000):
    voc = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(vocabulary)]
    return voc, [[rng.choice(voc) for _ in range(rng.randint(20, size))] for _ in range(n)]


def test_words_match_a_regular_expression():
    texts = ["", "Hello, WorldÉé 3x", None, "a", "中文。全角，B.c", "x" * 9, "“don’t” — go…", "naïve ½\u00a0€5 😀x", "ภาษา 日本語テスト", "end."]
    (w,) = words(pa.array(texts))
    b = w.row_bounds()
    got = [[bytes(w.data[s:e]).decode() for s, e in zip(w.start[i:j], w.end[i:j])] for i, j in itertools.pairwise(b)]
    assert got == [norm(t or "") for t in texts]
    again = list(words(pa.array(texts), chunk=1))
    assert np.array_equal(np.concatenate([x.hash for x in again]), w.hash)


def test_simhash_groups(spark):
    rng = random.Random(3)
    voc, docs = corpus(rng, 150)
    for d in docs[:60]:
        copy = list(d)
        for _ in range(rng.randint(0, max(1, len(d) // 25))):
            copy[rng.randrange(len(copy))] = rng.choice(voc)
        docs.append(copy)
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    f = np.concatenate([simhash.fingerprints(w)[0] for w in words(pa.array([t for _, t in rows]))])
    near = np.bitwise_count(f[:, None] ^ f[None]).sum(2) <= simhash.RADIUS
    label = list(range(len(rows)))
    for i, j in zip(*np.nonzero(near)):
        a, b = label[i], label[j]
        if a != b:
            label = [min(a, b) if x in (a, b) else x for x in label]
    got = {r.doc_id: r.group_id for r in simhash.near_duplicates(spark, table(spark, rows)).collect()}
    assert got == dict(enumerate(label))
    pairs = {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}
    sampled = {r.doc_id: r.group_id for r in simhash.near_duplicates(spark, table(spark, rows), bucket=4).collect()}
    assert sum(sampled[i] == sampled[j] for i, j in pairs) >= 0.9 * len(pairs)


def test_bit_sliced_distances_are_exact():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 2**63, (300, 2), dtype=np.uint64)
    for i in range(150):
        f[i] = f[rng.integers(300)]
        for b in rng.choice(128, rng.integers(0, 30), replace=False):
            f[i][b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    d = np.bitwise_count(f[:, None] ^ f[None]).sum(2)
    for radius in (0, 3, 20, 40):
        want = {(i, j) for i in range(300) for j in range(i + 1, 300) if d[i, j] <= radius}
        got = [p for a, b in simhash.close_pairs(f, radius, tile=700) for p in zip(a.tolist(), b.tolist())]
        assert len(got) == len(want) and set(got) == want


def test_repeated_lines(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abc d") for _ in range(rng.randint(1, 30))) for _ in range(60)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(1, 8)):
            s = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                p = rng.randrange(len(s) + 1)
                rng.choice([lambda: s.insert(p, "z"), lambda: s.pop(min(p, len(s) - 1)) if s else None, lambda: s.__setitem__(slice(p, p + 1), "y")])()
            lines.append("".join(s))
        docs.append((i, "\n".join(lines)))
    flat = [((i, k), line) for i, t in docs for k, line in enumerate(t.split("\n")) if line.strip()]
    want = {}
    for own, line in flat:
        for other, x in flat:
            if other < own and (x == line or one_edit(x, line)):
                want[own] = (*other, int(x != line))
                break
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no, r.edits) for r in linededup.repeated_lines(spark, table(spark, docs)).collect()}
    assert got == want and {e for *_, e in want.values()} == {0, 1}
    left = {r.doc_id: r.text for r in linededup.drop_repeated_lines(spark, table(spark, docs)).collect()}
    for i, t in docs:
        kept = [x for k, x in enumerate(t.split("\n")) if (i, k) not in want]
        changed = any(d == i for d, _ in want)
        assert left.get(i) == (("\n".join(kept) if "".join(kept).strip() else None) if changed else t)


def test_decontamination(spark):
    rng = random.Random(8)
    voc, docs = corpus(rng, 60, vocabulary=600)
    items = [[rng.choice(voc) for _ in range(rng.randint(4, 60))] for _ in range(25)]
    for k, d in enumerate(docs[:40]):
        item = list(items[k % 25])
        for _ in range(rng.randint(0, int(len(item) * 0.25))):
            p = rng.randrange(len(item))
            rng.choice([lambda: item.pop(p), lambda: item.insert(p, "new" + rng.choice(voc)), lambda: item.__setitem__(p, rng.choice(voc))])()
        at = rng.randrange(len(d))
        d[at:at] = item
    want = set()
    for i, d in enumerate(docs):
        for j, item in enumerate(items):
            row = [0] * (len(d) + 1)
            for x in item:
                last, row[0] = row[0], row[0] + 1
                for c, y in enumerate(d, 1):
                    last, row[c] = row[c], min(row[c] + 1, row[c - 1] + 1, last + (x != y))
            if min(row) <= int(len(item) * decontaminate.RATE):
                want.add((i, j, min(row)))
    found = decontaminate.contaminated(spark, table(spark, [(i, " ".join(d).title() + ".") for i, d in enumerate(docs)]), table(spark, [(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string"))
    got = {(r.doc_id, r.item_id, r.edits) for r in found.collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 25
    shards = decontaminate.contaminated(spark, table(spark, [(i, " ".join(d)) for i, d in enumerate(docs)]), table(spark, [(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string"), shard_words=200)
    assert {(r.doc_id, r.item_id, r.edits) for r in shards.collect()} == got


def test_lsh_recall_at_the_edit_bound():
    rng = np.random.default_rng(0)
    items = [rng.integers(1, 2**62, n, dtype=np.uint64) for n in (10, 20, 40, 60) for _ in range(25)]
    made = decontaminate.prepare(list(range(100)), [" ".join(f"t{k}a{j}" for j in range(len(s))) for k, s in enumerate(items)], decontaminate.RATE)
    hit = 0
    for i, s in enumerate(made.words):
        v = s.tolist()
        for _ in range(int(made.bound[i])):
            p = int(rng.integers(len(v)))
            (v.pop, lambda p: v.insert(p, 77), lambda p: v.__setitem__(p, 78))[rng.integers(3)](p)
        doc = np.concatenate([rng.integers(1, 2**62, 30, dtype=np.uint64), np.array(v, dtype=np.uint64), rng.integers(1, 2**62, 30, dtype=np.uint64)])
        c = decontaminate.Candidates({}, {})
        decontaminate.gather(made, doc, np.zeros(len(doc), np.int64), 0, c)
        hit += any(x[1] == i for x in decontaminate.find(made, c))
    assert hit >= 95
    assert [decontaminate.walks_for(r, decontaminate.RATE) for r in (0.5, 0.9, 0.99)] == sorted({decontaminate.walks_for(r, decontaminate.RATE) for r in (0.5, 0.9, 0.99)})


def test_recurring_passages(spark):
    rng = random.Random(4)
    voc, docs = corpus(rng, 50, size=300)
    for n in (31, 50, 51, 70, 120):
        shared = [rng.choice(voc) for _ in range(n)]
        for d in rng.sample(docs, 3):
            at = rng.randrange(len(d))
            d[at:at] = shared
    docs += [docs[0], ["again"] * 300, ["again"] * 200]
    rows = list(enumerate(docs))
    k, n = passages.PHRASE, passages.PASSAGE
    at = {}
    for size in (k, n):
        for i, d in rows:
            for s in range(len(d) - size + 1):
                at.setdefault(tuple(d[s : s + size]), set()).add((i, s))
    twice = {g for g, x in at.items() if len({i for i, _ in x}) > 1}
    for options in ({}, {"shard_phrases": 3, "shard_docs": 2}):
        got = [tuple(r) for r in passages.recurring(spark, table(spark, [(i, " ".join(d)) for i, d in rows]), **options).collect()]
        spans = {}
        for i, a, z, _, first in got:
            assert first <= i and z - a >= k
            spans.setdefault(i, []).append((a, z))
            # every word of a span is in a run of k words that another document holds too
            covered = {p for s in range(a, z - k + 1) if tuple(docs[i][s : s + k]) in twice for p in range(s, s + k)}
            assert covered >= set(range(a, z))
        for g in twice:
            if len(g) == n:  # a passage is found wherever it stands, from end to end
                for i, s in at[g]:
                    assert any(a <= s and z >= s + n for a, z in spans.get(i, []))
        assert len(got) > 10


def test_bundles_are_seekable(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    made = warc.bundles(pages, frame_bytes=20_000, bundle_bytes=60_000)
    want = {(r.page_id, r.url, r.html) for r in pages.collect()}
    assert {(r.page_id, r.url, r.html) for r in warc.read_back(made).collect()} == want
    rows = made.collect()
    assert len(rows) > 1 and {r.bundle_id for r in made.collect()} == {r.bundle_id for r in rows}
    for r in rows:
        whole = zstandard.ZstdDecompressor().stream_reader(r.payload, read_across_frames=True).read()
        assert len(whole) == r.raw_bytes and struct.unpack("<I", r.payload[-4:])[0] == 0x8F92EAB1
        assert len(warc.seek_table(r.payload)) == r.n_frames
        for e in r.records:
            page = warc.parse(warc.read_record(r.payload, e.frame, e.offset, e.length))
            assert (page["page_id"], page["url"], page["html"]) in want and page["record_id"] == e.record_id
            assert warc.seek_table(r.payload)[e.frame][0] == e.frame_offset
    damaged = bytearray(rows[0].payload)
    damaged[40] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        warc.read_record(bytes(damaged), 0, 0, 10)
    paths = warc.write_files(made, str(tmp_path)).collect()
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(f"{r.bundle_id}.warc.zst" for r in rows) and len(paths) == len(rows)


def test_credentials_by_brute_force(spark):
    rng = random.Random(2)
    pieces = ["AKIA" + "ABCD" * 4, "password=abc123", 'token = "0123456789abcdef0123456789abcdef01234567"', "10.0.0.7", "https://x.example.com/a", "u.v@example.com", "user: bob42", "ftp://me:pw12@h.example.org/z"]
    docs = [(i, " ".join(rng.choice(pieces) if rng.random() < 0.08 else "word" * rng.randint(1, 9) for _ in range(rng.randint(1, 150)))) for i in range(60)]
    want = set()
    for i, t in docs:
        found = credentials.parts(t)
        for kind, part, a, z, strong, value in found:
            if kind != "secret" and part != "access key id":
                continue
            near = {}
            for k in {"identifier", "secret", "endpoint"} - {kind}:
                c = [(max(s - z, a - e, 0), s, -e, v) for kk, _, s, e, _, v in found if kk == k and max(s - z, a - e, 0) <= credentials.GAP]
                if c:
                    near[k] = min(c)
            if strong or near:
                get = lambda k: (value[:4] + "***", a) if k == kind else (near[k][3][:4] + "***", near[k][1]) if k in near else (None, None)  # noqa: B023, E731
                want.add((i, kind, part, a, z, strong, *get("identifier"), *get("endpoint"), *get("secret"), 1 + len(near)))
    got = {tuple(r) for r in credentials.linked(spark, table(spark, docs)).collect()}
    assert got == want and any(not w[5] for w in want)
    alone = credentials.linked(spark, table(spark, [(1, "password=abc123 " + "word " * 200 + "10.0.0.7")])).collect()
    assert alone == []


def test_cube_balances(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(["w"] * rng.randint(1, 90)), "hot" if i % 3 else f"s{i % 5}") for i in range(1500)]
    t = table(spark, docs, "doc_id long, text string, source string")
    for options in ({}, {"weights": {"hot": 3.0, "s0": 1.0, "s2": 1.0}, "tokens": 9000, "block": 100}):
        rows = cube.mix_sources(spark, t, **options).collect()
        assert len(rows) == 1500 and all(0 <= r.inclusion <= 1 for r in rows)
        for s in {r.source for r in rows}:
            own = [r for r in rows if r.source == s]
            assert abs(sum(r.inclusion for r in own) - sum(r.selected for r in own)) <= 1.5
            assert abs(sum(r.inclusion * r.tokens for r in own) - sum(r.tokens for r in own if r.selected)) <= 95
    weights = {s: sum(r.tokens for r in rows if r.selected and r.source == s) / 9000 for s in ("hot", "s0", "s2", "s1")}
    assert abs(weights["hot"] - 0.6) < 0.02 and abs(weights["s0"] - 0.2) < 0.02 and weights["s1"] == 0
    assert rows == cube.mix_sources(spark, t, **options).collect() or sorted(rows) == sorted(cube.mix_sources(spark, t, **options).collect())
    # over many draws each unit is taken as often as its probability says
    taken = np.mean([cube.flight([0.3] * 20 + [0.7] * 20, [float(x) for x in range(40)], np.random.default_rng(k).random(40).tolist()) for k in range(3000)], axis=0)
    assert np.abs(taken - np.array([0.3] * 20 + [0.7] * 20)).max() < 0.05


def test_quality_on_held_out_documents(spark):
    rng = random.Random(9)
    _, good = corpus(rng, 1200, size=300, vocabulary=900)
    rows, labels, truth = [], [], {}
    for i, d in enumerate(good):
        kind = ("good", "good", "low", "toxic")[i % 4]
        if kind == "low":
            d = [f"{w}{rng.choice(['%%%', '###', '&&&'])}" for w in d] if i % 8 < 4 else [w for w in d[:20] for _ in range(12)]
        if kind == "toxic":
            for _ in range(max(3, len(d) // 40)):
                d[rng.randrange(len(d))] = rng.choice(["blockhead", "nitwit", "dullard"])
        rows.append((i, " ".join(d)))
        truth[i] = kind
        if i < 800:
            labels.append((i, int(kind != "low"), int(kind == "toxic")))
    got = compressor.classify(spark, table(spark, rows), table(spark, labels, "doc_id long, quality int, toxic int"), per_class=200).where("doc_id >= 800").collect()
    rate = {k: np.mean([r.rejected for r in got if truth[r.doc_id] == k]) for k in ("good", "low", "toxic")}
    assert rate["good"] <= 0.03 and rate["low"] >= 0.95 and rate["toxic"] >= 0.9, rate
    # calibrated: the mean score is the share of good documents
    assert abs(np.mean([r.score for r in got]) - 0.5) < 0.06


def test_neighbours_recall(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(700, 16)), rng.normal(size=(20, 16)).repeat(40, 0) * 2 + rng.normal(size=(800, 16)) * 0.2]).astype(np.float32)
    d = ((x[:, None].astype(float) - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :10]
    rows = multiindex.neighbours(spark, table(spark, [(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), shard=400).collect()
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.rank] = (r.neighbour_id, r.distance)
    assert len(got) == 1500 and all(sorted(v) == list(range(1, 11)) for v in got.values())
    assert np.mean([len({n for n, _ in got[i].values()} & set(want[i].tolist())) / 10 for i in range(1500)]) >= 0.9
    assert all(math.isclose(dist, math.sqrt(d[i, n]), rel_tol=1e-9) for i, v in got.items() for n, dist in v.values())


def test_traversal_is_in_order_of_summed_distance():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.random(6), rng.random(5)
        cells = multiindex.traverse(a, b, [1] * 30, 30)
        sums = [a[c // 5] + b[c % 5] for c in cells]
        assert sorted(cells) == list(range(30)) and sums == sorted(sums)


def test_sanitise_by_brute_force(spark):
    rng = random.Random(1)
    _, docs = corpus(rng, 80, size=60, vocabulary=300)
    people = [(f"p{k}.q{k}@mail.example.com", f"nick{k}zz") for k in range(6)]
    for i, d in enumerate(docs[:36]):
        mail, nick = people[i % 6] if i < 33 else (f"lone{i}@mail.example.com", f"only{i}")
        at = rng.randrange(len(d))
        d[at:at] = [mail, nick if i % 2 else rng.choice(docs[-1])]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    blank = lambda t: re.sub(r"\S+@\S+", " | ", t)
    n, df, dc, both = len(rows), {}, {}, {}
    for _, t in rows:
        for w in set(norm(t)):
            df[w] = df.get(w, 0) + 1
        for mail in set(re.findall(r"\S+@\S+", t)):
            dc[mail] = dc.get(mail, 0) + 1
            tokens, near = blank(t), set()
            for m in re.finditer(re.escape(mail), t):
                left, right = norm(blank(t[: m.start()])), norm(blank(t[m.end() :]))
                near |= set(left[-sanitise.WINDOW :]) | set(right[: sanitise.WINDOW])
            for w in near:
                both[mail, w] = both.get((mail, w), 0) + 1
    # entities of one document are examined too, by a smoothed estimate
    share = {k: math.log2(n * v / (dc[k[0]] * (max(df[k[1]], v) + (dc[k[0]] < 2)))) / math.log2(n / dc[k[0]]) for k, v in both.items() if v >= 2 or dc[k[0]] < 2}
    got = {r.doc_id: r for r in sanitise.sanitise(spark, table(spark, rows)).collect()}
    assert set(got) == {i for i, t in rows if "@" in t}
    for i, t in rows:
        if "@" not in t:
            continue
        own = set(re.findall(r"\S+@\S+", t))
        best = {}
        for (mail, w), s in share.items():
            if mail in own:
                best[w] = max(best.get(w, 0), s)
        out = ["<email>" if "@" in w else "" if best.get(w, 0) >= sanitise.REMOVE else sanitise.generalise(w) if best.get(w, 0) >= sanitise.GENERALISE else w for w in t.split(" ")]
        assert got[i].text == " ".join(out)
    assert sum(r.removed for r in got.values()) > 10
    assert all(f"only{i}" not in got[i].text for i in (33, 35)) and "only35" in rows[35][1]


def test_bundles_by_brute_force(spark):
    """Every record found by walking the frames of the payload, without seek table or index."""
    rows = [(i, f"http://e.example/{i}", f"<p>{'x' * (i * 37 % 900)}é{i}</p>") for i in range(120)] + [(5, "http://e.example/5", "<p>twice</p>")] * 2
    made = warc.bundles(table(spark, rows, "page_id long, url string, html string").coalesce(2), frame_bytes=3000, bundle_bytes=20_000)
    seen, places = [], {}
    for b in made.collect():
        rest, at, frame = b.payload, 0, 0
        while rest[:4] == b"\x28\xb5\x2f\xfd":
            d = zstandard.ZstdDecompressor().decompressobj()
            data = d.decompress(rest)
            size = len(rest) - len(d.unused_data)
            spot = 0
            while spot < len(data):
                head, _, _ = data[spot:].partition(b"\r\n\r\n")
                n = len(head) + 4 + int(re.search(rb"Content-Length: (\d+)", head)[1]) + 4
                page = warc.parse(data[spot : spot + n])
                seen.append((page["page_id"], page["url"], page["html"]))
                places.setdefault(page["record_id"], []).append((b.bundle_id, frame, at, spot, n))
                spot += n
            rest, at, frame = d.unused_data, at + size, frame + 1
        assert rest[:4] == struct.pack("<I", 0x184D2A5E) and frame == b.n_frames > 1
    assert sorted(seen) == sorted(rows)
    found = {r.record_id: (r.bundle_id, r.frame, r.frame_offset, r.offset, r.length) for r in warc.index(made).collect()}
    assert found == {k: min(v) for k, v in places.items()} and len(found) == 121


def test_quality_by_brute_force(spark):
    """Scores from sizes of each chunk compressed on its own, features and the logistic function written out."""
    rng = random.Random(10)
    _, docs = corpus(rng, 60, size=150, vocabulary=300)
    rows = [(i, " ".join(d) if i % 3 else " ".join(d[:4] * 9)) for i, d in enumerate(docs)] + [(90, None), (91, "")]
    t, labels = table(spark, rows), table(spark, [(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = compressor.fit(spark, t, labels)
    want = {}
    for i, text in rows:
        raw = (text or "").encode()
        if not raw:
            want[i] = None
            continue
        chunks = [raw[k : k + 256] for k in range(0, len(raw), 256)]
        sizes = []
        for d in model.dictionaries:
            dictionary = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(6, dict_size=len(d), source_size=256, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes.append([len(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=p).compress(c)) for c in chunks])
        good, low, toxic = map(sum, sizes)
        gain = [g - x - 2 for g, x in zip(sizes[0], sizes[2]) if g - x > 2]
        r = min(good / len(raw), 1.0)
        x = [1, 10 * (good - low) / good, 10 * max((good - low) / good, 0), 20 * (good - toxic) / good, math.log1p(sum(gain)), 4 * len(gain) / len(chunks), 10 * min(r, 0.5), 4 * r, 10 * r * r]
        p = [1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, w)))))) for w in (model.low, model.toxic)]
        want[i] = (1 - p[0]) * (1 - p[1])
    got = {r.doc_id: (r.score, r.rejected) for r in compressor.classify(spark, t, labels).collect()}
    assert set(got) == set(want)
    for i, s in want.items():
        assert (s is None and got[i] == (None, False)) or (abs(got[i][0] - s) < 1e-9 and got[i][1] == (s < compressor.THRESHOLD)), i
