"""Operators for training text against brute force, SQL, exact round trips and held-out accuracy."""

import hashlib
import itertools
import json
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import blocks, context_tree, exact_dedup, langid, lattice_dedup, mixing, near_dedup, packing, queries, secret_scan, toxicity, url_filter
from gridloom.llm.components import components

SF = "/root/testdata/sf0.001"
WS = re.compile(r"[\x20\x09-\x0D]")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=""):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    for c in ("uid", "key", "rep", "bucket", "n", "t", "whole", "digest", "kept", "group_size", "class_id", "tokens"):
        df = df.withColumn(c, F.lit("clash"))
    return df


ODD = [None, "", " \t\n", "a", "a b", "A  b", "a b", "x" * 3000, "один два три четыре пять шесть", "word " * 5000, "one two three four five six", "one two three four five six", "%%% ***", "日本語 テスト"]


def all_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_exact_groups_on_odd_texts(spark):
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs(spark, ODD)).collect()}
    groups = {}
    for i, t in enumerate(ODD):
        groups.setdefault(WS.sub("", t or ""), []).append(i)
    for key, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(ODD[i] or ""), i))
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(ids), i == keep, hashlib.sha256(key.encode()).hexdigest())
    d = docs(spark, ODD)
    kept = exact_dedup.drop_copies(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in got if got[i].kept)
    assert exact_dedup.exact_groups(docs(spark, ODD).limit(0)).count() == 0
    twice = docs(spark, ["a", "b"]).union(docs(spark, ["a", "b"]))
    assert exact_dedup.exact_groups(twice).where("kept").count() == 2 and exact_dedup.drop_copies(twice).count() == 2


def test_exact_stage_with_hot_ids_and_files(spark, tmp_path):
    """A null id in half of all rows, a repeated id with several texts, and copies over several files."""
    rows = [(None, f"t {i % 7}") for i in range(60)] + [(5, f"u{i % 3}") for i in range(30)] + [(100 + i, "t 1" if i % 2 else f"own {i}") for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_gl_n", F.lit("clash")).repartition(5)
    want = {WS.sub("", t) for _, t in rows}
    d.write.parquet(str(tmp_path / "d"))
    for each in (d, spark.read.parquet(str(tmp_path / "d")), spark.read.parquet(str(tmp_path / "d")).where("text <> 'own 0'")):
        kept = exact_dedup.drop_copies(each)
        texts = [WS.sub("", r.text) for r in kept.collect()]
        assert kept.columns == each.columns and len(texts) == len(set(texts)) and want - set(texts) <= {"own0"}


@pytest.mark.parametrize("name", ["op2_lattice_dedup", "op3_exact_dedup", "op7_url_filter"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    res = con.execute(queries.SQL[name])
    names = [x[0] for x in res.description]
    want = sorted(tuple(r[names.index(c)] for c in cols) for r in res.fetchall()) if name != "op7_url_filter" else sorted((tuple(r[names.index(c)] for c in cols) for r in res.fetchall()), key=str)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str if name == "op7_url_filter" else None)
    assert got == want


def test_url_rules(spark):
    urls = [None, "", "no-scheme", "http://", "HTTP://Example.ORG/es/1?x", "https://a.example.org/en/12", "https://xexample.org/es/", "http://b.com/fr/", "http://b.com/de/x#y", "http://org/", "ftp://com", "http://b.com//de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")

    def brute(u):
        if u is None or "://" not in u:
            host, path = "", ""
        else:
            m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
            host, path = m[1].lower(), m[2]
        fits = [(len(h + p), v == "block", h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[2:] if fits else (None, "allow")))

    for df in (url_filter.judge(pages, url_filter.RULES), url_filter.judge_by_join(pages, spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string"))):
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()} == {i: brute(u) for i, u in enumerate(urls)}
    tie = [("allow", "a.b", "/"), ("block", "a.b", "/")]
    assert url_filter.judge(spark.createDataFrame([(1, "x://a.b/")], "page_id long, url string"), tie).first().verdict == "block"


def test_lattice_links_equal_brute_force(spark):
    g = np.random.default_rng(3)
    base = g.normal(size=(12, 20))
    rows = []
    for b in base:
        for _ in range(15):
            rows.append((b + g.normal(size=20) * 0.12).astype(np.float32))
    rows += [rows[0], rows[0] * 2, np.zeros(20, np.float32)]
    table = [(i, [float(x) for x in v], i % 2 if i < 180 else 0) for i, v in enumerate(rows)]
    table += [(900, None, 0), (901, [float("nan")] * 20, 0), (902, [None] * 20, 0), (903, [float(x) for x in rows[0]], None), (904, [1.0, 2.0], 0), (905, [], 1)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice_dedup.near_vectors(df).collect()}
    good = [(i, np.array(v, float), y) for i, v, y in table if v and y is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i, _, _ in table}
    for (i, a, y), (j, b, z) in itertools.combinations(good, 2):
        if y == z and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
            near[i].add(j)
            near[j].add(i)
    for i in near:
        reach, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        assert got[i] == (len(near[i]), min(reach), i == min(reach))
    assert sum(map(len, near.values())) > 100
    assert lattice_dedup.near_vectors(df.limit(0)).count() == 0


def test_lattice_grid_of_blocks(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = sorted(map(tuple, lattice_dedup.near_vectors(df).collect()))
    monkeypatch.setattr(lattice_dedup, "MOST", 4)
    assert sorted(map(tuple, lattice_dedup.near_vectors(df).collect())) == want


def test_lattice_cells_follow_the_radius(spark):
    """Few dimensions and a low threshold need larger cells than the query's; smaller ones are refused."""
    g = np.random.default_rng(8)
    for dim, threshold in ((8, 0.98), (16, 0.9)):
        x = (g.normal(size=(8, dim))[:, None] + g.normal(size=(8, 25, dim)) * 0.25).reshape(-1, dim).astype(np.float32)
        df = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int")
        unit = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
        near = unit @ unit.T >= threshold
        got = {r.vec_id: r.n_links for r in lattice_dedup.near_vectors(df, threshold).collect()}
        assert near.sum() > 2 * len(x) and all(got[i] == near[i].sum() - 1 for i in range(len(x)))
    with pytest.raises(Exception, match="too small"):
        lattice_dedup.near_vectors(df, 0.9, cell=0.25).collect()


def test_e8_decoding():
    m, length = lattice_dedup.steps()
    assert len(m) == 2400 and len(np.unique(m, axis=0)) == 2400
    x = np.random.default_rng(0).normal(size=(200, 8)) * 2
    near = lattice_dedup.nearest_e8(x)
    gap = ((x - near) ** 2).sum(1)
    other = ((x[:, None] - near[:, None] - m[None]) ** 2).sum(2).min(1)
    assert (gap <= other + 1e-9).all()


def shingle_sets(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes_of(texts):
    sets = [shingle_sets(t) for t in texts]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if min(len(sets[i]), len(sets[j])) < 0.8 * max(len(sets[i]), len(sets[j])):
            continue
        u = len(sets[i] | sets[j])
        if (u == 0 or len(sets[i] & sets[j]) / u >= 0.8) and label[i] != label[j]:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return label


def test_near_groups_equal_brute_force(spark):
    g = np.random.default_rng(5)
    texts = list(ODD)
    for _ in range(6):
        base = [f"w{g.integers(0, 500)}" for _ in range(150)]
        texts.append(" ".join(base))
        for k in (0, 1, 2, 3, 6):
            copy = list(base)
            for i in g.choice(150, k, replace=False):
                copy[i] = "changed"
            texts.append(" ".join(copy))
    got = {r.doc_id: r.class_id for r in near_dedup.near_groups(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == classes_of(texts)
    assert near_dedup.near_groups(docs(spark, ODD).limit(0)).count() == 0
    d = docs(spark, texts)
    kept = near_dedup.drop_near_copies(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_near_groups_of_the_table(spark):
    rows = sorted((r.doc_id, r.text) for r in all_docs(spark).collect())
    want = classes_of([t for _, t in rows])
    got = {r.doc_id: r.class_id for r in near_dedup.near_groups(all_docs(spark)).collect()}
    assert [got[i] for i, _ in rows] == [rows[x][0] for x in want]


def test_open_buckets_are_compared_in_blocks(spark, monkeypatch):
    """A hot group in which the centre is far from most members, and blocks of a few rows."""
    monkeypatch.setattr(near_dedup, "MOST", 8)
    g = np.random.default_rng(1)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for k in range(40):
        copy = list(base)
        for i in g.choice(400, 26 if k % 4 == 0 else 3, replace=False):
            copy[i] = f"c{k}"
        texts.append(" ".join(copy))
    got = {r.doc_id: r.class_id for r in near_dedup.near_groups(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == classes_of(texts)


def test_links_of_the_smallest_asking_row():
    """Row 1 asks and finds 2 and 3, which do not ask: both must carry the link to it."""
    pairs = lambda raw, q, h: (np.zeros(2, int), np.array([1, 2]))
    got = blocks.links(np.array([1, 2, 3]), [b""] * 3, np.array([1, 4, 5]), np.array([3, 2, 2]), pairs)
    assert sorted(zip(*(x.tolist() for x in got))) == [(1, 9, 1), (2, 0, 1), (3, 0, 1)]


def test_open_bucket_in_which_the_smallest_linked_row_asks(spark):
    """One bucket with centre 1: 1~3 and 2~3 are near, 1~2 is not; only 2 asks, and finds a larger id."""
    base = [f"w43_{i}" for i in range(400)]
    first, second = list(base), list(base)
    for i in range(8):
        first[20 + 20 * i] = f"a{i}"
        second[220 + 20 * i] = f"b{i}"
    texts = [" ".join(x) for x in (["alone"], first, second, base)]
    assert classes_of(texts) == [0, 1, 1, 1] and classes_of(texts[1:3]) == [0, 1]
    sketches = near_dedup.sketch(docs(spark, texts), k=5, bands=1).collect()
    assert len({r.bands[0] for r in sketches if r.doc_id}) == 1
    got = {r.doc_id: (r.class_id, r.class_size, r.kept) for r in near_dedup.near_groups(docs(spark, texts), k=5, bands=1).collect()}
    assert got == {0: (0, 1, True), 1: (1, 3, True), 2: (1, 3, False), 3: (1, 3, False)}
    assert sorted(r.doc_id for r in near_dedup.drop_near_copies(docs(spark, texts), k=5, bands=1).collect()) == [0, 1]


def test_near_groups_of_null_ids(spark):
    base = [f"n{i}" for i in range(200)]
    near, other = [*base[:-1], "changed"], [f"m{i}" for i in range(200)]
    texts = [base, base, near, other, [*other[:-1], "changed"], ["one"], [], [], [f"k{i}" for i in range(50)]]
    ids = [None, None, None, 7, None, None, None, None, 9]
    rows = [(i, " ".join(t), "en", str(n), 0) for n, (i, t) in enumerate(zip(ids, texts))] + [(None, None, "en", "9", 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("whole", F.lit("clash"))
    got = sorted(map(str, map(tuple, near_dedup.near_groups(df).collect())))
    want = [(None, None, 3, True)] + [(None, None, 3, False)] * 2 + [(7, 7, 2, True), (None, 7, 2, False), (None, None, 1, True)]
    want += [(None, None, 3, True)] + [(None, None, 3, False)] * 2 + [(9, 9, 1, True)]
    assert got == sorted(map(str, want))
    kept = near_dedup.drop_near_copies(df)
    left = [r.source for r in kept.collect()]
    assert kept.columns == df.columns and len(left) == 5
    assert [sum(x in part for x in left) for part in ("012", "3", "4", "5", "679", "8")] == [1, 1, 0, 1, 1, 1]


def test_dart_minhash_estimates_weighted_jaccard():
    g = np.random.default_rng(2)
    h = g.integers(1, 2**63, 60).astype(np.uint64)
    a, b = g.integers(0, 6, 60), g.integers(0, 6, 60)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    e = np.concatenate([h[a > 0], h[b > 0]])
    r = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
    sig = near_dedup.dart_minhash(e, r, 2, 2000, np.concatenate([a[a > 0], b[b > 0]]))
    assert abs((sig[0] == sig[1]).mean() - want) < 0.05
    assert near_dedup.dart_minhash(np.zeros(0, np.uint64), np.zeros(0, int), 3, 8).sum() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(30)] + [(101, 100)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}


def test_secret_spans(spark):
    rows = [
        'password = "hunter22" token: abc secret: token: abcdefgh',
        "AKIA" + "A" * 16 + " AKIAshort AKIAAKIA" + "B" * 9,
        "é" * 7 + " deadbeefdeadbeefdeadbeef0 api_key=Zz9.Zz9-Zz9 ApiKey:'aaaaaa'",
        "live Qm7xT2pLw9Rk4Vn8Zs3Yb6Hd1 here",
        "copied Aa1Bb2Cc3Dd4Ee5Ff6Gg7Hh8Ii9 here",
    ]
    table = [(i, t, "en", "s0") for i, t in enumerate([*rows, None, ""])] + [(100 + k, rows[4], "en", f"s{k}") for k in range(6)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in secret_scan.secret_spans(df).collect()}
    for i, t, *_ in table:
        t = t or ""
        base = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [(x.s, x.k, x.e) for x in got[i].at if x.k < 3] == sorted(base)
    assert [x.k for x in got[3].at] == [3] and got[4].at == [] and got[100].at == []
    assert len(got[0].at) == 1 and len(got[1].at) >= 1
    assert secret_scan.secret_spans(df.limit(0)).count() == 0


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = [(r.doc_id, r.text) for r in all_docs(spark).collect()] + [(10_000 + i, x) for i, x in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.pack(df).collect()
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.start for p in pieces] == list(np.cumsum([0, *[p.length for p in pieces]])[:-1]) and sum(p.length for p in pieces) == len(ids)
        assert all(p.length == 2048 for p in pieces[1:]) and (len(pieces) == 1 or len(ids) > 2048)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces)
    for seq in by_seq.values():
        seq.sort(key=lambda r: r.offset)
        assert [r.offset for r in seq] == list(np.cumsum([0, *[r.length for r in seq]])[:-1]) and sum(r.length for r in seq) <= 2048
    total = sum(r.length for r in out)
    assert len(by_seq) <= -(-total // 2048) * 1.1 + 1
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_of_special_tokens(spark):
    """Ids are those of the tokenizer at its defaults, where a special token's name in a text is that token."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"good text {end} more text", end, end * 3, f"a{end}b", f"{end}  x \n{end}\n", "<|endoftext|", f"<{end}>", "<|ENDOFTEXT|>", f"word {end} " * 900]
    out = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, text in enumerate(texts):
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [0], "<u4")
        pieces = [r for r in out if r.doc_id == i]
        assert sum(r.length for r in pieces) == len(ids) and (ids == 50256).sum() == text.count(end)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces)


def test_packing_counts_place_every_item():
    g = np.random.default_rng(0)
    for _ in range(20):
        counts = np.zeros(101, int)
        for x in g.integers(1, 101, g.integers(0, 400)):
            counts[x] += 1
        bins = packing.pack_counts(counts, 100)
        back = np.zeros(101, int)
        for n, items in bins:
            assert sum(a * b for a, b in items) <= 100 and sum(b for a, b in items if a > 100 / 3) <= 2
            for a, b in items:
                back[a] += n * b
        assert (back == counts).all()


def test_language(spark):
    df = all_docs(spark)
    from gridloom.llm.work import crc_mod

    got = {r.doc_id: r for r in langid.query(spark, SF).collect()}
    held = [r for r in df.collect() if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.9
    model = langid.learn(df, crc_mod("doc_id", 4) != 2)
    odd = {r.doc_id: r for r in langid.identify(docs(spark, ODD), model).collect()}
    for i, t in enumerate(ODD):
        assert (odd[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= odd[i].score <= 1
    empty = langid.learn(df.limit(0), crc_mod("doc_id", 4) != 2)
    assert {r.lang_pred for r in langid.identify(docs(spark, ODD), empty).collect()} == {"und"}


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in toxicity.query(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].predicted == r.toxic for r in labels) / len(labels) > 0.9
    net = toxicity.train(["you idiot", "a fine day", "idiot again", "good morning"] * 5, [1, 0, 1, 0] * 5, epochs=2)
    scores = [r.toxic_score for r in toxicity.score_documents(docs(spark, ODD), net).collect()]
    assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    d = docs(spark, ODD)
    assert toxicity.drop_toxic(d, net, 1.1).columns == d.columns and toxicity.drop_toxic(d, net, 1.1).count() == len(ODD)
    assert toxicity.train(["x"], [1]) is None and toxicity.score_documents(docs(spark, ODD), None).count() == len(ODD)


def test_toxic_passage_at_every_offset():
    """A passage of a window less a stride is whole in one window, wherever it begins."""
    fine = "the river runs past quiet green hills and old stone mills by day".split()
    bad = ("you are a stupid worthless idiot and I hate you so much go away " * 3).split()[: toxicity.WINDOW - toxicity.STRIDE]
    train = [" ".join(fine * 3), " ".join(fine[::-1] * 3), " ".join(bad)] * 12
    net = toxicity.train(train, [0, 0, 1] * 12)
    clean = (fine * 20)[:200]
    texts = [" ".join(clean[:k] + bad + clean[k:]) for k in range(len(clean))] + [" ".join(clean)]
    x = toxicity.Features(pa.array(texts, pa.large_string()))
    at = {(r, s - int(x.count[:r].sum())) for r, s in zip(x.window_row, x.window_start)}
    assert all(any((k, s) in at for s in range(max(0, k + len(bad) - toxicity.WINDOW), k + 1)) for k in range(len(clean)))
    score = net.score(pa.array(texts))
    assert (score[:-1] >= 0.5).all() and score[-1] < 0.5


def test_samples_skip_what_does_not_fit():
    from gridloom.llm.sampling import fitting

    rows = [("a", 0, 900), ("b", 0, 10), ("c", 1, 60), ("d", 0, 40), ("e", 1, 50), ("f", 1, 30), ("d", 0, 45)]
    assert fitting(rows, 100) == [("b", 0), ("c", 1), ("d", 0), ("f", 1)]
    assert fitting([("a", 0, 900), ("b", 0, 500), ("c", 1, 5)], 100) == [("c", 1), ("b", 0)]
    assert fitting([], 100) == []


def test_samples_start_no_python_on_executors(spark, monkeypatch):
    """Python workers of the sample stayed beside those that score; ids under two labels count under the first."""
    from gridloom.llm.sampling import labelled_sample

    d = spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'bb'), (2, 'b'), (3, NULL), (4, 'd') AS t(doc_id, text)")
    labels = spark.sql("SELECT * FROM VALUES ('1', 0), ('2', 1), ('2', 0), ('3', 1), ('5', 1) AS t(id, y)")
    langs = labels.select("id", F.when(F.col("y") == 0, "en").otherwise("fr").alias("y"))

    def none(*_):
        raise AssertionError("rows went through Python")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", none)
    assert labelled_sample(d, labels, 10, 1000) == (["a", "b", "bb", ""], [0, 0, 0, 1])
    assert labelled_sample(d, langs, 10, 1000) == (["a", "b", "bb", ""], ["en", "en", "en", "fr"])
    assert labelled_sample(d, labels.limit(0), 10, 1000) == ([], [])


def test_toxicity_gradients():
    import pyarrow as pa

    net = toxicity.Net(3)
    net.w = {d: {k: v.astype(float) for k, v in p.items()} for d, p in net.w.items()}
    net.head = {k: v.astype(float) for k, v in net.head.items()}
    x = toxicity.Features(pa.array(["one two three", "four five " * 40], pa.large_string()))
    index = x.index(np.arange(len(x.window_row)))
    e = net.inputs(x).astype(float)
    y = np.arange(index.shape[1]) % 2

    def loss():
        z, _ = net.run(e, index)
        return float((np.log1p(np.exp(z)) - y * z).sum())

    z, kept = net.run(e, index, keep=True)
    grad, words = net.back(kept, 1 / (1 + np.exp(-z)) - y)
    for k, v in toxicity._weights(net).items():
        at = tuple(s // 2 for s in v.shape)
        old, h = v[at], 1e-5
        v[at] = old + h
        up = loss()
        v[at] = old - h
        down = loss()
        v[at] = old
        assert abs((up - down) / (2 * h) - grad[k][at]) < 1e-3, k


def test_context_tree_base_and_score(spark):
    texts = [t for t in ODD] + ["the cat sat on the mat"] * 3
    df = docs(spark, texts)
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in context_tree.scores(df, F.col("doc_id") % 3 != 1).collect()}

    def tokens(t):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]

    counts = {}
    for i, t in enumerate(texts):
        if i % 3 != 1:
            for w in tokens(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        ws = tokens(t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(w in counts for w in ws), n)
        assert abs(got[i].base_score - sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ws)) < 1e-6
        assert got[i].score < 0
    assert context_tree.scores(df.limit(0), F.lit(True)).count() == 0
    assert got[len(texts) - 1].bits_per_byte < 3


def test_context_tree_counts_in_blocks(spark, monkeypatch):
    """Counts travel as blocks of parts, not as rows, and are those of all texts; small bounds make many blocks of a part and sums between."""
    k = np.array([-(1 << 63), -5, 0, 7, (1 << 56) - 1, 1 << 62], np.int64)
    n, m = np.array([0, 1, 255, 256, 3, 1 << 40], np.int64), np.array([9, 1, 255, 300, 3, 1 << 41], np.int64)
    b = context_tree._blocks(1, k, n, m)
    got = context_tree._unpacked([(w, x.as_buffer()) for w, x in zip(b.column(1).to_pylist(), b.column(2))])
    assert sorted(zip(*got)) == sorted(zip(k, n, m)) and all(p >> context_tree.PARTS == 1 for p in b.column(0).to_pylist())
    assert context_tree._blocks(0, k[:0], n[:0], m[:0]).num_rows == 0 and len(context_tree._unpacked([])[0]) == 0
    texts = [*ODD, *(f"Some words {i} of {i % 7} texts" for i in range(80))] * 2
    want = {}
    for i, t in enumerate(texts):
        data, offsets = context_tree.utf8(pa.array([t], pa.string()))
        for what, keys in ((0, np.append(context_tree.words(data, offsets, context_tree.WORD)[0], context_tree.END).view(np.int64)), (1, context_tree.symbols(data, offsets)[0])):
            for key in keys.tolist() if what or i % 3 != 1 else []:
                x = want.setdefault((what, key), [0, 0])
                x[0] += i % 3 != 1
                x[1] += 1
    df = docs(spark, texts).repartition(5).select("text", (F.col("doc_id") % 3 != 1).alias("learns"))
    for held, chunk in ((context_tree.HELD, context_tree.CHUNK), (300, 100), (40, 20)):
        monkeypatch.setattr(context_tree, "HELD", held)
        monkeypatch.setattr(context_tree, "CHUNK", chunk)
        monkeypatch.setattr(context_tree, "SLICE", 64)
        got = [((r.what, r.key), [r.n, r.m]) for r in context_tree.gathered(df).collect()]
        assert len(got) == len(want) and dict(got) == want
    assert context_tree.gathered(df.limit(0)).count() == 0


def test_context_tree_without_training_texts(spark):
    from pyspark.sql import functions as F

    df = docs(spark, ODD)
    for learns in (F.lit(False), F.lit(None).cast("boolean")):
        got = {r.doc_id: r for r in context_tree.scores(df, learns).collect()}
        for i, t in enumerate(ODD):
            assert (got[i].n_known, got[i].train_tokens, got[i].base_score) == (0, 0, 0)
            assert abs(got[i].score - 8 * np.log10(0.5) * (len((t or "").encode()) + 1)) < 1e-6 * abs(got[i].score)
    twice = context_tree.scores(df.unionAll(df), F.lit(True)).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("score").alias("k")).collect()
    assert all((r.n, r.k) == (2, 1) for r in twice) and len(twice) == len(ODD)


def test_context_tree_weighs_as_defined():
    """One binary source by hand: the mixture of depth 0 and depth 1 of the last bit's contexts sums to one over all bytes."""
    code = np.array([(a << 8) | b for a, b in [(0, 97), (97, 98), (98, 97), (97, 98), (98, 0)]], np.int64)
    tree = context_tree.Tree.of(*np.unique(code, return_counts=True), 1)
    for context in (0, 97, 98, 200):
        p = 10 ** tree.log10(np.array([(context << 8) | b for b in range(256)], np.int64))
        assert abs(p.sum() - 1) < 1e-5
    # the first bit at depth 0 is 0 for all five bytes: KT gives 0.5/6 to a 1
    k = np.searchsorted(tree.keys[0], 1)
    assert abs(tree.one[0][k] - 0.5 / 6) < 1e-6


def test_context_tree_keeps_rare_bits_of_frequent_contexts():
    """A bit that a context showed a billion times leaves the other a probability above zero; codes only asked for learn nothing."""
    code, n = np.array([98, 99, 120], np.int64), np.array([10**9, 0, 0], np.int64)
    tree, bits = context_tree.Tree.asked(code, n, 0)
    assert (bits[~np.isnan(bits)] > 0).all() and not np.isnan(bits[0]).any()
    assert np.allclose(bits, tree.bits(code), rtol=1e-6, atol=0, equal_nan=True)
    assert abs(bits[1, 7] * (2 * (10**9 + 1)) - 1) < 1e-6  # 1 after 0110001: the node saw 0 only
    assert np.allclose(np.log10(np.where(np.isnan(bits), 0.5, bits)).sum(1), context_tree.Tree.of(code, n, 0).log10(code))


def test_context_tree_lists_and_known_codes():
    rng = np.random.default_rng(1)
    keys, rows = rng.integers(0, 1 << 56, 4000) >> rng.integers(0, 56, 4000), np.sort(rng.integers(0, 700, 4000))
    for a, b in zip(context_tree._lists(keys, rows, 700), context_tree._lists(keys, rows, 700, 56)):
        assert a.equals(b)
    held = np.unique(keys[:2000])
    at, there = context_tree.Known(held, held * 3).find(keys)
    assert (there == np.isin(keys, held)).all()
    assert (context_tree.Known(held, held * 3).values[at[there]] == keys[there] * 3).all()


def test_context_tree_in_parts_is_the_whole_tree(spark):
    """Subtrees in tasks, with most codes and words joined instead of broadcast, against one tree in memory."""
    from pyspark.sql import functions as F

    from gridloom.llm.textvec import utf8

    df = all_docs(spark)
    learns = F.col("doc_id") % 3 != 1
    rows = [(r.doc_id, r.text) for r in df.collect()]
    for depth in (1, 3, 5, 6):
        codes = {i: context_tree.symbols(*utf8(pa.array([t])), depth)[0] for i, t in rows}
        tree = context_tree.Tree.of(*np.unique(np.concatenate([codes[i] for i, _ in rows if i % 3 != 1]), return_counts=True), depth)
        got = {r.doc_id: r for r in context_tree.scores(df, learns, depth=depth, frequent=100, frequent_codes=3000).collect()}
        assert len(got) == len(rows)
        for i, _ in rows[:40]:
            want = tree.log10(codes[i]).sum()
            assert abs(got[i].score - want) < 1e-5 * abs(want)
    assert depth == context_tree.DEPTH
    every = {r.doc_id: r for r in context_tree.scores(df, learns).collect()}
    for i, r in got.items():
        assert r.n_known == every[i].n_known and abs(r.base_score - every[i].base_score) < 1e-6 and abs(r.score - every[i].score) < 1e-6 * abs(r.score)


def test_mixing_hits_targets(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    targets = {"good": 0.6, "poor": 0.3, "toxic": 0.1}
    out = mixing.mix(all_docs(spark), mixing.label_domains(labels), targets).collect()
    tokens = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in all_docs(spark).collect()}
    assert all(r.tokens == tokens[r.doc_id] and r.rate >= 0 and abs(r.p_good + r.p_poor + r.p_toxic - 1) < 1e-9 for r in out)
    total = sum(tokens.values())
    for k, w in targets.items():
        assert abs(sum(r.rate * r.tokens * r[f"p_{k}"] for r in out) - w * total) < 0.01 * total
    # brute force: the same projected gradient in numpy
    p = np.array([[r[f"p_{k}"] for k in sorted(targets)] for r in out])
    t = np.array([r.tokens for r in out], float)
    goal, rate, m = np.array([targets[k] for k in sorted(targets)]) * total, np.ones(len(out)), (p * t[:, None]).T @ p
    for _ in range(40):
        rate = np.maximum(0, rate + p @ (np.linalg.pinv(m) @ (goal - (p * t[:, None]).T @ rate)))
    assert np.allclose(rate, [r.rate for r in out], atol=1e-3)
    grown = mixing.mix(all_docs(spark), mixing.label_domains(labels), {"good": 0.85, "poor": 0.15}, grow_only=True)
    assert grown.where("copies < 1").count() == 0
    d = docs(spark, ODD)
    again = mixing.mixed_documents(d, mixing.label_domains(labels), targets, grow_only=True, most=3)
    assert again.columns == d.columns and {(r.doc_id, r.text) for r in again.collect()} == set(enumerate(ODD)) and len(ODD) <= again.count() <= 3 * len(ODD)
    assert mixing.mixed_documents(d.limit(0), mixing.label_domains(labels), targets).count() == 0
    none = labels.limit(0)
    assert mixing.mix(docs(spark, ODD), mixing.label_domains(none), targets).count() == len(ODD)
    assert mixing.mix(docs(spark, ODD).limit(0), mixing.label_domains(labels), targets).count() == 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    columns = d.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    toxic, clean = ({r.doc_id for r in labels if r.toxic == y} for y in (1, 0))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in d.collect()] if k < 5 else []
        stage(spark, d, sf).write.parquet(str(tmp_path / str(k)))
        d = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert d.columns == columns
        ids = [r.doc_id for r in d.collect()]
        texts = dict(before)
        if name == "toxicity":
            assert set(ids) <= set(texts) and len(toxic & set(ids)) < 0.3 * len(toxic) and len(clean & set(ids)) > 0.98 * len(clean)
        if name == "exact_dedup":
            assert len(ids) == len({WS.sub("", t or "") for t in texts.values()})
        if name == "minhash_near_dedup":
            order = sorted(texts)
            assert sorted(ids) == sorted({order[x] for x in classes_of([texts[i] for i in order])})
        if name == "mixing":
            assert set(ids) == set(texts)
        if name == "best_fit_packing":
            assert set(ids) == set(texts)


def test_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES if k.startswith("op")) == list(range(1, 11))
    assert "pipeline" in queries.QUERIES and json.dumps(sorted(queries.SQL))
