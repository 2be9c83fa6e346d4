"""Each operator against brute force, and its cases of nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import decontaminate, embedding_dedup, line_dedup, mixing, simhash_dedup, substring_dedup, suffix_dedup, token_records, toxicity, url_filter
from lodestrata.llm import repeats as R
from lodestrata.llm import textkit as K

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th long, d string, copies int, score string, n_dropped int, b long, key string"


def frame(spark, rows):
    """Documents with columns that operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "x", 2, "y", 3, 4, "z") for i, t, s in rows], SCHEMA)


def prose(r, n):
    return " ".join("".join(r.choice(["ka", "lo", "mi", "ser", "tun", "Ñé", "wa"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    base = [(i, prose(r, r.choice([3, 30, 120])), f"s{i % 3}") for i in range(60)]
    passage = prose(r, 60)
    out = [(i, (t + " " + passage + "\n" + prose(r, 5)) if i % 7 == 0 else t, s) for i, t, s in base]
    out += [(100, out[3][1], "s0"), (101, out[4][1], None), (102, None, "s1"), (103, "", "s1"), (104, " \n\t ", None), (None, "alone ka lo", "s2"), (None, None, None)]
    out += [(105, "repeated row ka lo mi", "s1")] * 3 + [(106, "one", "s1"), (107, "one", "s1"), (108, "ka " * 60 + "lo", "s0")]
    words = out[1][1].split() * 40
    near = words[:]
    near[50] = "changed"
    return out + [(109, " ".join(words), "s0"), (110, " ".join(near), "s0"), (111, prose(r, 60_000), "s0"), (112, "x" * 300_000, "s0")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [(1, "a", "s")]).limit(0)


def words_of(t):
    return WORD.findall((t or "").lower())


@given(st.lists(st.text(alphabet="aB1 .é\n-ß日", max_size=20), max_size=8))
@settings(max_examples=150, deadline=None)
def test_words(texts):
    w = K.words(pa.array(texts, pa.string()))
    want = [words_of(t) for t in texts]
    assert np.diff(w.off).tolist() == [len(x) for x in want]
    assert [w.data[s:e].tobytes().decode() for s, e in zip(w.start, w.end)] == [x for d in want for x in d]
    names = {}
    for h, x in zip(w.h.tolist(), [x for d in want for x in d]):
        assert names.setdefault(x, h) == h
    assert len(set(names.values())) == len(names)


def test_url_filter(spark):
    r = random.Random(1)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "a.com.au", "ba.com", "X.B.A.com"]
    urls = [f"https://{r.choice(['', 'u@'])}{r.choice(hosts)}{r.choice(['', ':80'])}{r.choice(['', '/', '/p', '/p/q?x', '?y', '#f', '/pq'])}" for _ in range(300)] + [None, "", "not a url", "http:///p", "//a.com/p", "https://...", "https://a.com/p/" + "z" * (1 << 20), "https://a.com/p" + "/q" * (1 << 19)]
    given_ = [("a.com", None, "drop"), ("b.a.com", None, "keep"), ("a.com", "/p", "keep"), ("a.com", "/p/", "drop"), ("com", None, "keep"), ("a.com", None, "a tie"), ("com.au", None, "drop"), ("a.com", "/p" + "/q" * 300_000, "deep")] + [("b.a.com", "/" + "p/q?x"[:k], "nested") for k in range(6)]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(3, urls[3], "x", "y"), (None, urls[4], "x", "y")], "page_id long, url string, key string, action string")
    keyed = [x[0] for x in pages.select(url_filter.key(pages.url)).collect()]
    prefixes = defaultdict(list)
    for h, p, a in given_:
        prefixes[url_filter.rule_prefix(h, p)].append(a)
    want = []
    for i, k in zip([x[0] for x in pages.select("page_id").collect()], keyed):
        open_ = sorted(p for p in prefixes if k is not None and k.startswith(p))
        want.append((i, min(prefixes[open_[-1]]) if open_ else "keep", open_[-1] if open_ else None, len(open_)))
    rules = url_filter.rules(spark, given_)
    for n in (1, 4, 30):
        got = [tuple(x) for x in url_filter.filter_urls(pages, rules, n).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {x["action"] for x in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"keep"}


def test_toxicity(spark, docs, nothing):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(d, labels.where("doc_id % 4 <> 0"))
    held = labels.where("doc_id % 4 = 0")
    got = toxicity.score(d, model).join(held.withColumnRenamed("toxic", "said"), "doc_id").collect()
    right = sum(x["toxic"] == bool(x["said"]) for x in got) / len(got)
    assert right > 0.9 and not any(x["toxic"] and not x["said"] for x in got[:50])
    assert len(model[1]) < 20_000
    all_ = toxicity.score(docs, model)
    assert all_.count() == docs.count()
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert toxicity.keep_clean(docs, model).count() == docs.count() - all_.where("toxic").count()
    assert toxicity.score(nothing, model).count() == 0
    one_kind = [labels.limit(0), labels.withColumn("toxic", F.lit(1)), labels.withColumn("toxic", F.lit(0)), labels.withColumn("toxic", F.lit(None).cast("int")), labels.withColumn("doc_id", F.col("doc_id") + 10**9)]
    for none in (toxicity.train(d, x) for x in one_kind):
        assert not toxicity.score(docs, none).where("toxic").count() and toxicity.keep_clean(docs, none).count() == docs.count()
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (999, 1)], "doc_id long, toxic int")
    assert toxicity.train(docs, odd)[0] is not None


def test_toxicity_of_nothing_said(spark):
    """Null, empty and wordless texts are kept however many labels are toxic; repeated rows and long texts are judged like one."""
    bad, good = "awful vile slur words", "kind calm plain words"
    rows = [(i, bad if i % 10 else good) for i in range(200)] + [(900, None), (901, ""), (902, " \n!"), (903, bad), (903, bad), (904, " ".join([bad] * 50_000)), (905, " ".join([good] * 50_000))]
    d = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.train(d, labels, l1=1.0)
    assert 1 / (1 + np.exp(-model[0])) > toxicity.THRESHOLD
    got = Counter((x["doc_id"], x["toxic"]) for x in toxicity.score(d, model).where("doc_id >= 900").collect())
    assert got == {(900, False): 1, (901, False): 1, (902, False): 1, (903, True): 2, (904, True): 1, (905, False): 1}
    kept = toxicity.keep_clean(d, model)
    assert kept.columns == d.columns and {x["doc_id"] for x in kept.where("doc_id >= 900").collect()} == {900, 901, 902, 905}


def test_toxicity_full_model(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(d, labels)
    got = toxicity.score(d, model).join(labels.withColumnRenamed("toxic", "said"), "doc_id").collect()
    assert sum(x["toxic"] for x in got if x["said"]) >= 0.95 * sum(x["said"] for x in got)
    assert sum(x["toxic"] for x in got if not x["said"]) <= 0.005 * len(got)


def crc_by_bit(data):
    c = 0xFFFFFFFF
    for x in data:
        c ^= x
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


@given(st.lists(st.binary(max_size=70), max_size=12))
@settings(max_examples=60, deadline=None)
def test_checksums(strings):
    off = np.concatenate([[0], np.cumsum([len(x) for x in strings])]).astype(np.int64)
    got = token_records.crc32c(np.frombuffer(b"".join(strings), np.uint8), off)
    assert got.tolist() == [crc_by_bit(x) for x in strings]
    assert crc_by_bit(b"123456789") == 0xE3069283


def test_token_records(spark, docs, rows, nothing, tmp_path):
    index = token_records.write_records(docs, f"file://{tmp_path}")
    enc = token_records.encoder(token_records.RANKS)
    back = token_records.read_records(index.orderBy("length_crc", "offset")).collect()
    assert Counter((x[0], enc.decode(x[1])) for x in back) == Counter((i, t or "") for i, t, _ in rows)
    assert token_records.write_records(nothing).count() == 0
    shard = index.first()["shard"].removeprefix("file://")
    raw = bytearray(open(shard, "rb").read())
    first = index.where(f"shard like '%{shard[-20:]}'").where("n_tokens > 3").first()
    raw[first["offset"] + 13] ^= 1
    open(shard, "wb").write(raw)
    with open(shard, "rb") as f, pytest.raises(ValueError):
        token_records.read_record(f, first["offset"], first["length"])


def test_record_bytes(spark, tmp_path):
    """A shard is what struct and a bit by bit checksum make of the tokens."""
    texts = ["one two", None, "", "x" * 5000, "déjà vu", "one two"]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, offset int").coalesce(1)
    index = token_records.write_records(d, f"file://{tmp_path}").orderBy("offset").collect()
    enc, want, at = token_records.encoder(token_records.RANKS), b"", []
    mask = lambda x: (((crc_by_bit(x) >> 15) | (crc_by_bit(x) << 17)) + 0xA282EAD8) & 0xFFFFFFFF
    for t in texts:
        ids = enc.encode_ordinary(t or "")
        data, head = struct.pack(f"<{len(ids)}H", *ids), struct.pack("<Q", 2 * len(ids))
        at.append((len(want), 16 + len(data), len(ids), mask(head), mask(data)))
        want += head + struct.pack("<I", mask(head)) + data + struct.pack("<I", mask(data))
    assert open(index[0]["shard"].removeprefix("file://"), "rb").read() == want
    assert [(x["offset"], x["length"], x["n_tokens"], x["length_crc"], x["data_crc"]) for x in index] == at and [x["doc_id"] for x in index] == list(range(6))
    with pytest.raises(Exception, match="don't fit into 1 bytes"):
        token_records.write_records(d, f"file://{tmp_path}", width=1)


def test_decontamination(spark, docs, rows, nothing):
    r = random.Random(9)
    rows = [*rows, (200, rows[7][1], "s0"), (200, rows[7][1], "s0"), (201, "word " * 400_000 + rows[7][1], "s0")]
    docs = frame(spark, rows).repartition(3)
    long = next(t for i, t, _ in rows if i == 7).split()
    tests = [" ".join(long[5:25]).upper(), " ".join(rows[2][1].split()[:6]), "one", "", None, prose(r, 12), " ".join(long[5:25])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(tests)], "item_id long, text string, hash string")
    grams = defaultdict(set)
    for t in tests:
        w = words_of(t)
        k = min(8, len(w))
        if k >= 5:
            grams[k] |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    want = Counter()
    for i, t, _ in rows:
        w = words_of(t)
        hits = sorted((s, k) for k, g in grams.items() for s in range(len(w) - k + 1) if tuple(w[s : s + k]) in g)
        want.update((i, s, e, n) for _, s, e, n in decontaminate.merge([(0, s, k) for s, k in hits]))
    assert want
    for limit in (10**6, 3):
        got = Counter(tuple(x) for x in decontaminate.contaminated_spans(docs, bench, broadcast_limit=limit).collect())
        assert got == want
    bad = {x[0] for x in want}
    clean = {(i, t) for i, t, _ in rows if i not in bad}
    whole = None
    for limit, bits in ((10**6, 1 << 29), (3, 1 << 29), (3, 1 << 10)):
        kept = decontaminate.remove_documents(docs, bench, broadcast_limit=limit, filter_bits=bits)
        assert kept.columns == docs.columns and Counter(x["doc_id"] for x in kept.collect()) == Counter(i for i, _, _ in rows if i not in bad)
        cut = decontaminate.remove_spans(docs, bench, broadcast_limit=limit, filter_bits=bits)
        assert cut.columns == docs.columns and decontaminate.contaminated_spans(cut, bench).count() == 0
        texts = Counter((x["doc_id"], x["text"]) for x in cut.collect())
        assert clean <= set(texts) and sum(texts.values()) == len(rows) and whole in (None, texts)
        whole = texts
        assert decontaminate.contaminated_spans(nothing, bench, broadcast_limit=limit).count() == 0
    assert decontaminate.contaminated_spans(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated_spans(nothing, bench).count() == 0


def components(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in up}


def test_embeddings(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(300, 16))
    v = np.concatenate([base, base[:60] + r.normal(size=(60, 16)) * 0.08, base[:20], np.repeat(base[:1] * 3, 15, axis=0)])
    rows = [(i, [float(y) for y in x], 7) for i, x in enumerate(v)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [1.0, 2.0], 1), (903, [None] + [1.0] * 15, 1), (904, [float("nan")] * 16, 1), (None, rows[0][1], 1), rows[5], rows[5]]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, cell int")
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    a, b = np.nonzero(np.triu(u @ u.T, 1) >= 0.95)
    want = components(zip(a.tolist(), b.tolist()))
    for block in (4096, 16):
        got = {x[0]: x[1] for x in embedding_dedup.groups(table, codes=16, block=block).collect()}
        assert got == want
    assert embedding_dedup.groups(table.limit(0)).count() == 0
    assert embedding_dedup.groups(table.where("vec_id = 3")).count() == 0
    vectors, dim = embedding_dedup.unit_vectors(table.where("vec_id < 360"))
    found = embedding_dedup.near_edges(vectors, dim, codes=16, spanning=False).collect()
    inner = {(x, y) for x, y in zip(a.tolist(), b.tolist()) if x < 360 and y < 360}
    assert {tuple(sorted(x)) for x in found} == inner


def test_simhash(spark, docs, rows, nothing):
    w = K.words(pa.array([t for _, t, _ in rows], pa.string()))
    s, some = simhash_dedup.signatures(w)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if some[i] and some[j] and int(np.bitwise_count(s[i] ^ s[j]).sum()) <= simhash_dedup.RADIUS]
    comp = defaultdict(set)
    for x, c in components(pairs).items():
        comp[c].add(x)
    want = {}
    for g in comp.values():
        ids = {rows[x][0] for x in g}
        want |= {i: min(y for y in ids if y is not None) for i in ids}
    got = {x[0]: x[1] for x in simhash_dedup.groups(docs).collect()}
    assert got == want and got[110] == got[109] and got[100] == 3 and 103 not in got
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(x["doc_id"] for x in kept.collect())
    assert ids == Counter(i for i, _, _ in {(i, t, s) for i, t, s in rows} if i not in want or want[i] == i)
    assert simhash_dedup.groups(nothing).count() == 0 and simhash_dedup.keep_one(nothing).count() == 0


def test_simhash_recall(spark):
    """All pairs of random signatures and of noisy copies, against every pair compared."""
    r = np.random.default_rng(8)
    s = r.integers(0, 2**63, (3000, 4), dtype=np.uint64)
    noisy = np.repeat(s[:500], 2, axis=0)
    for i in range(len(noisy)):
        for b in r.choice(256, r.integers(1, simhash_dedup.RADIUS), replace=False):
            noisy[i, b >> 6] ^= np.uint64(1) << np.uint64(b & 63)
    s = np.concatenate([s, noisy])
    a, b = simhash_dedup.close(s, simhash_dedup.RADIUS)
    bits = np.unpackbits(s.view(np.uint8), axis=1).astype(np.int32)
    dist = bits @ (1 - bits.T) + (1 - bits) @ bits.T
    assert set(zip(*map(np.ndarray.tolist, np.nonzero(np.triu(dist <= simhash_dedup.RADIUS, 1))))) == set(zip(a.tolist(), b.tolist()))
    table = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(s)], "id long, sig binary")
    want = set(zip(a.tolist(), b.tolist()))
    assert len(want) > 1000
    for node in (64, 8):
        found = {tuple(sorted(x)) for x in simhash_dedup.near_edges(table, node=node, spanning=False).collect()}
        assert found <= want and len(found) >= simhash_dedup.RECALL * len(want)
    shallow = {tuple(sorted(x)) for x in simhash_dedup.near_edges(table, node=8, spanning=False, recall=0.1, trees=2).collect()}
    assert shallow <= want and len(shallow) < 0.9 * len(want)
    climbed = {tuple(sorted(x)) for x in simhash_dedup.near_edges(table, node=8, spanning=False, trees=2).collect()}
    assert climbed <= want and len(climbed) >= simhash_dedup.RECALL * len(want)  # the two trees alone don't reach it


def test_simhash_dense(spark):
    """A third of all signatures within a few bits of each other, among sparse ones; components against brute force."""
    r = np.random.default_rng(4)
    s = r.integers(0, 2**63, (4000, 4), dtype=np.uint64)
    s[:1500] = s[0]
    for i in range(1, 1500):
        for b in r.choice(256, r.integers(1, 9), replace=False):
            s[i, b >> 6] ^= np.uint64(1) << np.uint64(b & 63)
    s = np.unique(s, axis=0)
    table = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(s)], "id long, sig binary")
    a, b = simhash_dedup.close(s, simhash_dedup.RADIUS)
    want = components(zip(a.tolist(), b.tolist()))
    got = components((x[0], x[1]) for x in simhash_dedup.near_edges(table, node=32).collect())
    classes = lambda c: Counter(frozenset(x for x in c if c[x] == k) for k in set(c.values()))
    assert classes(got) == classes(want)


def test_simhash_through_the_trees(spark, docs, rows):
    """Groups with nodes so small that the trees decide, against those of one node."""
    assert {tuple(x) for x in simhash_dedup.groups(docs, node=16).collect()} == {tuple(x) for x in simhash_dedup.groups(docs).collect()}


@given(st.lists(st.floats(0, 1), max_size=40), st.integers(0, 2**32))
@settings(max_examples=200, deadline=None)
def test_pivot(p, seed):
    got, held = mixing.pivot(np.array(p), np.random.default_rng(seed).random(len(p)))
    assert abs(got.sum() - sum(p)) < 1e-6
    assert all(x in (0, 1) for i, x in enumerate(got) if i != held)


def test_mixing(spark, docs, rows, nothing):
    units = {(i, s) for i, _, s in rows}
    n = Counter(s for _, s in units)
    for weights, total, bucket, fan, limit in ((None, None, 65536, 64, 9), (None, None, 4, 2, 1), ({"s0": 3, "s1": 1, "absent": 5}, 333, 4, 2, 9), ({"s0": 3, "s1": 1, "absent": 5}, 333, 4, 2, 1), ({None: 1}, 10, 2, 2, 9), ({None: 1}, 10, 2, 2, 2)):
        got = mixing.copies(docs, weights, total, bucket=bucket, fan_in=fan, sources=limit).collect()
        assert Counter((x["doc_id"], x["source"]) for x in got) == Counter(units)
        w = weights or mixing.tempered(n)
        whole, t = sum(w.get(k, 0) for k in n), total or sum(n.values())
        for k in n:
            e = t * w.get(k, 0) / whole
            own = [x["copies"] for x in got if x["source"] == k]
            assert e - 1 < sum(own) < e + 1
            assert all(abs(c - e / n[k]) < 1 for c in own)
        assert abs(sum(x["copies"] for x in got) - t) <= 1
    out = mixing.mixed(docs, {"s0": 3, "s1": 1}, 333)
    c = {(x["doc_id"], x["source"]): x["copies"] for x in mixing.copies(docs, {"s0": 3, "s1": 1}, 333).collect()}
    want = Counter()
    for x in docs.collect():
        want[tuple(x)] += c[(x["doc_id"], x["source"])]
    assert out.columns == docs.columns and Counter(map(tuple, out.collect())) == +want
    assert mixing.copies(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


@pytest.mark.parametrize("bucket, fan", [(65536, 64), (7, 2)])
def test_mixing_against_a_replay(spark, docs, rows, bucket, fan):
    """The same hashes, rounded in plain loops: buckets of a source, then sources, pair by pair."""
    units = sorted({(i, s) for i, _, s in rows}, key=str)
    n = Counter(s for _, s in units)
    names = sorted(n, key=lambda k: (k is None, k or ""))
    w = {k: n[k] ** mixing.ALPHA for k in n}
    each = {k: len(units) * w[k] / sum(w.values()) / n[k] for k in n}
    frame_ = spark.createDataFrame([(i, names.index(s), max(1, -(-n[s] // bucket))) for i, s in units], "doc_id long, s int, buckets int")
    hashed = frame_.selectExpr("doc_id", "s", f"xxhash64({mixing.SEED}, doc_id, s) as r", f"pmod(xxhash64({mixing.SEED + 1}, doc_id, s), buckets) as b").collect()
    want, open_ = {}, []

    def settle(group, level):
        """Rows [id, s, p, r] of one group, in the order of their hashes; the one left open, if any."""
        held = None
        for row in sorted(group, key=lambda x: (x[3], -(2**63) if x[0] is None else x[0])):
            u = (int(K.mix(np.array([row[3]], np.int64).view(np.uint64) + np.uint64(level))[0]) >> 11) / 2.0**53
            if row[2] <= 1e-9 or row[2] >= 1 - 1e-9:
                want[row[0], row[1]] = round(row[2])
            elif held is None:
                held = row
            else:
                a, b = held, row
                t = a[2] + b[2]
                first = u * t < a[2] if t < 1 else u * (2 - t) < 1 - b[2]
                win, lose = (a, b) if first else (b, a)
                if t < 1:
                    win[2], want[lose[0], lose[1]], held = t, 0, win
                else:
                    want[win[0], win[1]], lose[2], held = 1, t - 1, lose
                if held[2] <= 1e-9 or held[2] >= 1 - 1e-9:
                    want[held[0], held[1]], held = round(held[2]), None
        return held

    groups = defaultdict(list)
    for x in hashed:
        e = each[names[x["s"]]]
        groups[x["s"], x["b"]].append([x["doc_id"], x["s"], e - int(e), x["r"]])
    left = {k: h for k, g in groups.items() if (h := settle(g, 0))}
    width, level = max(-(-k // bucket) for k in n.values()), 1
    while width > 1:
        groups = defaultdict(list)
        for (s, b), h in left.items():
            groups[s, b // fan].append(h)
        left = {k: h for k, g in groups.items() if (h := settle(g, level))}
        width, level = -(-width // fan), level + 1
    left, width = {s: h for (s, _), h in left.items()}, max(2, len(names))
    while width > 1:
        groups = defaultdict(list)
        for b, h in left.items():
            groups[b // fan].append(h)
        left = {k: h for k, g in groups.items() if (h := settle(g, level))}
        width, level = -(-width // fan), level + 1
    for h in left.values():
        want[h[0], h[1]] = int((h[3] % (1 << 30)) / float(1 << 30) < h[2])
    got = {(x["doc_id"], names.index(x["source"])): x["copies"] for x in mixing.copies(docs, bucket=bucket, fan_in=fan).collect()}
    assert got == {k: int(each[names[k[1]]]) + v for k, v in want.items()}


def test_mixing_is_fair(spark):
    d = spark.range(200).selectExpr("id as doc_id", "'t' as text", "if(id % 4 = 0, 'a', 'b') as source")
    total = Counter()
    for seed in range(40):
        for x in mixing.copies(d, {"a": 1, "b": 1}, 60, seed=seed * 7, bucket=16, fan_in=2).collect():
            total[x["doc_id"]] += x["copies"]
    a, b = [total[i] / 40 for i in range(0, 200, 4)], [total[i] / 40 for i in range(200) if i % 4]
    assert abs(np.mean(a) - 0.6) < 0.02 and abs(np.mean(b) - 0.2) < 0.02
    assert np.std(a) < 0.14 and np.std(b) < 0.11


@given(st.lists(st.integers(1, 3), max_size=60))
@settings(max_examples=300, deadline=None)
def test_suffix_array(t):
    t = [*t, 0]
    assert suffix_dedup.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def repeated(rows, n):
    texts = {(i, t) for i, t, _ in rows}
    count = Counter()
    for _, t, _ in rows:
        w = words_of(t)
        count.update(tuple(w[s : s + n]) for s in range(len(w) - n + 1))
    out = set()
    for i, t in texts:
        w = words_of(t)
        at = [(0, s, n) for s in range(len(w) - n + 1) if count[tuple(w[s : s + n])] > 1]
        out |= {(i, s, e) for _, s, e, _ in decontaminate.merge(at)}
    return out


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup])
@pytest.mark.parametrize("n", [50, 12])
def test_repeated_passages(spark, docs, rows, nothing, op, n):
    got = [tuple(x) for x in op.repeated_substrings(docs, n).collect()]
    assert len(got) == len(set(got)) and set(got) == repeated(rows, n)
    if n == 50:
        assert op.repeated_substrings(nothing, n).count() == 0


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup])
@given(st.lists(st.text(alphabet="abc ", max_size=60), max_size=8), st.integers(2, 12))
@settings(max_examples=80, deadline=None)
def test_window_keys(op, texts, n):
    """Equal windows have equal keys, whatever stands around them."""
    w = K.words(pa.array([" ".join(t) for t in texts], pa.string()))
    if len(w.h) < n:
        return
    doc, v, seen = K.doc_of(w.off), op.keys(w, n), {}
    for s in range(len(v)):
        if doc[s] == doc[s + n - 1]:
            assert seen.setdefault(tuple(w.h[s : s + n]), v[s]) == v[s]


def test_lines(spark, nothing):
    rows = [(i, f"common  LINE\nown {i}\n\n" + ("rare\n" if i < 3 else "") + "tail", "s") for i in range(12)]
    rows += [(20, None, "s"), (21, "", None), (22, "\n\n", "s"), (None, "Common line\nx", "s"), (23, "twice\n" * 40, "s"), (24, "common line", "s"), (24, "common line\nb", "s"), (24, "common line", "s"), (25, "common line\nown\n" * 100_000 + "end", "s"), (26, "x" * (1 << 20), "s")]
    count = defaultdict(set)
    norm = lambda x: re.sub(r"[ \t\r\f\v]+", " ", x.lower()).strip(" ")
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            count[norm(x)].add(i)
    often = {x for x, d in count.items() if x and len(d) > 10}
    want = Counter((i, None if t is None else "\n".join(x for x in t.split("\n") if norm(x) not in often), sum(norm(x) in often for x in (t or "").split("\n"))) for i, t, _ in rows)
    got = line_dedup.dedup_lines(frame(spark, rows))
    assert Counter((x["doc_id"], x["text"], x["n_dropped"]) for x in got.collect()) == want
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_merging_spans():
    t = np.zeros(4, R.RUN)
    t["uid"], t["start"], t["nwin"] = [5, 5, 5, 2], [10, 0, 100, 3], [3, 1, 1, 1]
    ids, s, e = R.merged(t, 10)
    assert list(zip(ids, s, e)) == [(2, 3, 13), (5, 0, 22), (5, 100, 110)]
