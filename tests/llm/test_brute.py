"""Operators that SQL can't express against plain Python versions of the same definition, and each stage of the pipeline."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("lumenframe.llm")

from lumenframe.llm import components, decontam, jaccard, line_dedup, sharding, substring_dedup, token_counts, toxicity, url_filter  # noqa: E402
from lumenframe.llm import common  # noqa: E402


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


# --- op1


def brute_urls(urls):
    """score of every URL by interpolated counts, and the calibrated threshold; None where there is nothing to learn."""
    def fold(u):
        rest = re.search(r"(?s)^(?:.*?://)?(.*)$", u or "").group(1)
        rest = "".join(c.lower() if c.isascii() else c for c in rest)
        return re.sub(r"[^a-z0./\-_?&=%:~+#]", "*", re.sub("[0-9]", "0", rest)) + "$"

    def decided(u):
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if c.isascii() else c for c in host)
        best = None
        for r, v in url_filter.RULES:
            h, _, p = r.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or (len(r), r) > (len(best[0]), best[0])):
                best = (r, v)
        return best

    n = url_filter.ORDER
    counts = {v: Counter() for v in ("allow", "block")}
    held = lambda f: zlib.crc32(f.encode()) % url_filter.CALIBRATION == 0
    all_grams = set()
    for u in urls:
        f = fold(u)
        g = "^" * n + f
        all_grams |= {g[i : i + n + 1] for i in range(len(f))}
        if (d := decided(u)) and not held(f):
            counts[d[1]].update(g[i : i + n + 1] for i in range(len(f)))
    suffix = {v: Counter() for v in counts}
    context = {v: Counter() for v in counts}
    for v, c in counts.items():
        for g, k in c.items():
            for m in range(1, n + 2):
                suffix[v][g[-m:]] += k
                context[v][m, g[-m:][:-1]] += k

    def log_p(v, g):
        p = 1 / url_filter.ALPHABET
        for m in range(1, n + 2):
            p = (suffix[v][g[-m:]] + url_filter.ALPHA * p) / (context[v][m, g[-m:][:-1]] + url_filter.ALPHA)
        return math.log(p)

    weight = {g: round((log_p("allow", g) - log_p("block", g)) * url_filter.UNIT) for g in all_grams}
    score = {}
    for u in urls:
        f = fold(u)
        g = "^" * n + f
        score[u] = sum(weight[g[i : i + n + 1]] for i in range(len(f))) / len(f) / url_filter.UNIT
    cal = [(math.floor(score[u] * 100), d[1] == "allow") for u in urls if (d := decided(u)) and held(fold(u))]
    goods, bads = sum(g for _, g in cal), sum(not g for _, g in cal)
    at = sorted({x for x, _ in cal})
    cuts = [(t, (t + before + 1) / 2) for t, before in zip(at, [at[0] - 1, *at[:-1]], strict=True)]
    best = max(cuts, key=lambda c: (sum(g for x, g in cal if x >= c[0]) * bads + sum(not g for x, g in cal if x < c[0]) * goods, -abs(c[1]), -c[1]))[1] if goods and bads else 0
    return score, best / 100, {u: decided(u) for u in urls}


def test_url_models_by_brute_force(spark):
    rng = np.random.default_rng(5)
    word = lambda good: "".join(rng.choice(list("aeiourst" if good else "xzqkjvw0")) for _ in range(rng.integers(3, 9)))
    urls = []
    for i in range(160):
        good = i % 2
        host = f"{word(good)}.org" if good else f"{word(good)}.net"
        urls.append(f"https://{host}/{'fr/' if good else ''}{word(good)}/{word(good)}?id={i}")
        urls.append(f"http://www.{word(good)}.info/{word(good)}")
    urls += [None, "", "no scheme", "HTTP://ÜBER.Example.COM/de/x#y", "https://long.info/" + "ab" * 40_000, urls[0], urls[1]]
    pages = spark.createDataFrame([(i if i % 50 else None, u, "x") for i, u in enumerate(urls)], "page_id long, url string, gram string")
    got = [(r.page_id, r.verdict, r.score, r.rule) for r in url_filter.judged(pages).collect()]
    score, cut, decided = brute_urls(urls)
    want = [(i if i % 50 else None, d[1] if (d := decided[u]) else "allow" if score[u] >= cut else "block", score[u], d and d[0]) for i, u in enumerate(urls)]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert [(a[0], a[1], a[3]) for a in sorted(got, key=key)] == [(a[0], a[1], a[3]) for a in sorted(want, key=key)]
    np.testing.assert_allclose([a[2] for a in sorted(got, key=key)], [a[2] for a in sorted(want, key=key)], atol=1e-6)
    free = [u for u in urls if u and "info" in u and "long" not in u]
    right = sum((score[u] >= cut) == (i % 2 == 1) for i, u in enumerate(free))
    assert right > 0.9 * len(free)


def test_urls_without_anything_to_learn(spark):
    pages = spark.createDataFrame([(1, "http://a.info/x"), (1, "http://a.info/x"), (None, "http://b.net/")], "page_id long, url string")
    assert sorted((str(r.page_id), r.verdict, r.score) for r in url_filter.judged(pages).collect()) == [("1", "allow", None), ("1", "allow", None), ("None", "block", None)]
    assert url_filter.judged(pages.limit(0)).count() == 0


# --- op2


def test_scores_by_brute_force(spark):
    bad = ["awful", "nasty", "vile", "rotten"]
    sample = [(1, f"you are {bad[i % 4]} and {bad[(i + 1) % 4]} number{i} thing{i}\nplain line {i}") for i in range(40)] + [(0, f"you are kind and fair number{i} thing{i}") for i in range(80)]
    f = toxicity.fit(sample)
    texts = ["they are vile, nasty people\n\nand so on", "nothing here", "", None, "rotten " * 3000, "Vile!\nvile\nNASTY and fair", "12 !! \n\t"]

    def score(text):
        total = 0.0
        for words in toxicity.chains(text or ""):
            e = []
            for i, w in enumerate(words):
                own, near = toxicity.features(w)
                x = sum(float(f.own[k]) for k in own)
                if i:
                    x += sum(float(f.left[k]) for k in toxicity.features(words[i - 1])[1])
                if i + 1 < len(words):
                    x += sum(float(f.right[k]) for k in toxicity.features(words[i + 1])[1])
                e.append(max(-30.0, min(30.0, x)))
            if not e:
                continue
            ahead = [np.array([0.0, f.start + e[0]])]
            for x in e[1:]:
                ahead.append(np.logaddexp.reduce(ahead[-1][:, None] + f.trans, axis=0) + np.array([0.0, x]))
            back = [np.zeros(2)]
            for x in e[:0:-1]:
                back.append(np.logaddexp.reduce(f.trans + np.array([0.0, x]) + back[-1], axis=1))
            for a, b in zip(ahead, back[::-1], strict=True):
                odds = math.exp(min((a + b)[1] - (a + b)[0], 60))
                total += 1e-4 * odds if odds < toxicity.NOISE else min(odds, 1e4)
        return 1 / (1 + math.exp(-(f.scale * math.log(total + 1e-2) + f.shift)))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, f).collect()}
    np.testing.assert_allclose([got[i] for i in range(len(texts))], [score(t) for t in texts], rtol=1e-3)
    assert toxicity.score(docs.limit(0), f).count() == 0


def test_training_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} " * 5) for i in range(40)] + [(3, "again"), (3, "again"), (None, "x"), (41, "y" * 300_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(42)] + [(2, 1), (None, 1), (5, None), (6, 7)], "doc_id long, toxic int")
    sample = toxicity.training_sample(docs, labels)
    assert len(sample) == 40 and (1, "again") in sample and sum(y for y, _ in sample) == 21
    monkeypatch.setattr(toxicity, "SAMPLE_LETTERS", 500)
    assert 0 < sum(len(t) for _, t in toxicity.training_sample(docs, labels)) <= 500
    assert toxicity.fit([]).shift == -5.0 and toxicity.fit([(1, "a b")]).shift == -5.0 and toxicity.training_sample(docs.limit(0), labels) == []


# --- op6


def test_fit_holds_a_block_at_a_time():
    """Memory of a fit, beyond the sample, doesn't follow the tokens it is fitted on."""
    rng = np.random.default_rng(5)
    plain, bad = [f"w{i}" for i in range(400)], [f"curse{i}" for i in range(10)]

    def document(y):
        lines = [list(rng.choice(plain, 30)) for _ in range(20)]
        for words in lines if y else ():
            words[3] = bad[rng.integers(len(bad))]
        return y, "\n".join(" ".join(words) for words in lines)

    sample = [document(i % 2) for i in range(600)]
    tracemalloc.start()
    try:
        field = toxicity.fit(iter(sample), steps=2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert field.own.any() and peak < 100 * 360_000  # bytes: 360,000 tokens


def test_shards_by_brute_force(spark):
    def hash48(*parts):
        return int(hashlib.md5(":".join(parts).encode()).hexdigest()[:12], 16)

    def draw(key, level, children):
        total = lambda x: sum(map(total, x.values())) if isinstance(x, dict) else x
        return min((-math.log((hash48(f"{level}{k}", key) + 1) / 2.0**48) / total(c), k) for k, c in children.items())[1]

    def shard(key, n):
        t = sharding.tree([1.0] * n)
        racks = t[draw(key, "g", t)]
        leaves = racks[draw(key, "r", racks)]
        return draw(key, "s", leaves)

    texts = [(i, f"text {i}" * (i % 5)) for i in range(300)] + [(None, "a"), (None, None), (7, "text 7text 7"), (7, "other"), (7, "other")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, slot int")
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert (r["shard"], r.grown_shard) == (shard(key, 24), shard(key, 25))
    order = lambda r: (hash48("slot", *("null" if v is None else str(v) for v in (r.doc_id, r["size"], r.text_crc32))), r.doc_id or 0)
    for s in {r["shard"] for r in rows}:
        mine = sorted((r for r in rows if r["shard"] == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine))) and list(map(order, mine)) == sorted(map(order, mine))


# --- op4, shared pieces


def test_frequent_pre_tokens_are_bounded(spark):
    vocab = spark.createDataFrame([(f"w{i}", max(1, 1000 // (i + 1)), i) for i in range(500)] + [("x" * 60, 10**6, 1)], "pretoken string, freq long, n long")
    for head in (0, 1, 10, 100, 499, 500, 10_000):
        got = token_counts.frequent(vocab, head)
        assert len(got) <= head and (head < 10 or len(got) >= min(head, 500) / 8)
        if got:
            least = min(1000 // (int(w[1:]) + 1) for w in got)
            assert all(f"w{i}" in got for i in range(500) if 1000 // (i + 1) > least)
    assert len(token_counts.frequent(vocab, 10_000)) == 500 and token_counts.frequent(vocab.limit(0), 5) == {}


def test_packed_steps_round_trip():
    rng = np.random.default_rng(2)
    for x in ([], [0], [65535], [0, 65534, 65535, 65536, 131070, 4_000_000_000], np.unique(rng.integers(0, 1 << 28, 5000))):
        x = np.array(x, np.uint32)
        assert (common.unpacked(common.packed(x)) == x).all()


def test_members_and_hot_groups(spark):
    scratch = common.Scratch(spark, "test")
    ids = spark.createDataFrame([(i * 7919 - 5000,) for i in range(2000)], "id long")
    test, table = common.members(ids, scratch)
    inside = np.array([i * 7919 - 5000 for i in range(2000)])
    assert test(inside).all() and test(inside + 1).mean() < 0.2
    table.destroy()
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 50}" if i % 7 else None) for i in range(6000)], "i long, k string")
    groups = scratch.save(rows.where("k IS NOT NULL").groupBy("k").agg({"i": "min", "*": "count"}).toDF("k", "least", "n"))
    got = {r.i: r.least for r in common.join_groups(rows, groups, "k").collect()}
    first = {}
    for r in rows.collect():
        if r.k is not None:
            first.setdefault(r.k, r.i)
    assert len(got) == 6000 and all(got[r.i] == first.get(r.k) for r in rows.collect())


def test_components_of_links_by_keys(spark):
    rng = np.random.default_rng(9)
    scratch = common.Scratch(spark, "test")
    keys = {i: set(rng.choice(60, 3).tolist()) for i in range(150)}
    linked = lambda a, b: (a * 31 + b * 31) % 3 == 0
    want = list(range(150))
    for a in keys:
        for b in keys:
            if a < b and keys[a] & keys[b] and linked(a, b):
                lo, hi = sorted((want[a], want[b]))
                want = [lo if x == hi else x for x in want]
    postings = spark.createDataFrame([(k, i, (0,), i % 5) for i, ks in keys.items() for k in ks], "key long, id long, v struct<x:int>, central int")
    check = lambda pairs: pairs.where("(a * 31 + b * 31) % 3 = 0")
    for rounds in (0, 2):
        comp = components.linked(postings, check, scratch, lambda x, y: x["x"] == y["x"], rounds=rounds)
        got = {r.id: r.component for r in comp.collect()}
        assert [got.get(i, i) for i in range(150)] == want


# --- nulls, repeats, empties, very long texts and clashing names


def test_postings_are_read_once(spark, tmp_path):
    """Postings are dealt by key in one shuffle, however many rounds follow."""
    log = str(tmp_path / "log")

    def read(batches):
        for b in batches:
            with open(log, "a") as f:
                f.write(f"{b.num_rows}\n")
            yield b

    rows = spark.createDataFrame([(i % 40, i, (0,), 1) for i in range(400)], "key long, id long, v struct<x:int>, central int")
    comp = components.linked(rows.coalesce(1).mapInArrow(read, rows.schema), lambda pairs: pairs, common.Scratch(spark, "test"), lambda x, y: x["x"] == y["x"])
    assert {r.id: r.component for r in comp.collect()} == {i: i % 40 for i in range(400)}
    with open(log) as f:
        assert sum(map(int, f)) == 400


def test_lines_that_share_a_phrase_alone_seldom_meet():
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("aehinorst"), rng.integers(2, 8))) for _ in range(60)]
    lines = []
    for _ in range(60):
        w = list(rng.choice(words, 60))
        w[30:36] = ["onwhor", "thouenre", "anrely", "and", "anhestor", "thanhash"]
        lines.append(" ".join(w))
    row, key, _, near = line_dedup.line_keys(lines, lambda key: np.ones(len(key), bool))
    near = near.reshape(len(row), -1).view(np.uint64)
    met = passed = 0
    for k in np.unique(key):
        at = np.flatnonzero(key == k)
        for j in range(1, len(at)):
            both, own, other = (np.bitwise_count(x).astype(int).sum(-1) for x in (near[at[:j]] & near[at[j]], near[at[:j]], near[at[j]]))
            met += j
            passed += int((both * 100 >= np.minimum(own, other) * line_dedup.ALIKE).sum())
    assert met > 1000 and passed < 0.2 * met


def test_pairs_with_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(5, "a b c d e f g"), (3, "A b c d e f g"), (3, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (9, long), (8, long + " end"), (4, "")]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, sig string, component int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(5, 3, 3), (3, 3, 3), (3, 3, 3), (None, 3, 3), (None, 0, None), (9, 39_996, 8), (8, 39_997, 8), (4, 0, 4)], key=repr)
    words = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(2, words, 1), (1, "x " + words, 1), (2, words, 1), (None, words, 1), (None, None, 1), (7, "", 1), (8, words + " tail", 1)], "doc_id long, text string, row int")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.cut_repeats(docs).collect()), key=repr)
    assert got == sorted([(2, 20, 20), (2, 20, 20), (1, 21, 0), (None, 20, 0), (None, 0, 0), (7, 0, 0), (8, 21, 20)], key=repr)


def test_decontamination_with_odd_rows(spark):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(2, item, "x"), (10, item + " eleven", "x"), (2, item, "x"), (None, "alpha beta", "x"), (5, None, "x")], "item_id long, text string, doc string")
    long = "filler " * 60_000 + item
    docs = spark.createDataFrame([(1, f"a {item} b", 1), (1, f"a {item} b", 1), (None, item, 1), (3, None, 1), (4, "", 1), (6, long, 1), (7, "alpha beta", 1)], "doc_id long, text string, start int")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, len(r.items)) for r in decontam.contamination(docs, bench).collect()), key=repr)
    assert got == sorted([(1, 12, 10, 2), (1, 12, 10, 2), (None, 10, 10, 2), (3, 0, 0, 0), (4, 0, 0, 0), (6, 60_010, 10, 2), (7, 2, 2, 0)], key=repr)


def test_lines_with_odd_rows(spark):
    line = "this line has quite some words and it is repeated in other documents with a few changes now and then"
    other = "another line that nothing else is like, of numbers and of names"
    wide = "".join(np.random.default_rng(1).choice(list("abcdefghij"), 60_000))
    rows = [(9, f"{line}\n{other}"), (None, f"{line}\nown words"), (4, line.replace("quite", "rather")), (4, line.replace("quite", "rather")), (4, "something else"), (5, None), (6, ""), (7, "\n\n"), (8, f"{wide}\n{wide}y")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, "d") for i, t in rows], "doc_id long, text string, n_lines int, row int, gone int, doc string")
    out = line_dedup.without_repeated_lines(docs)
    assert out.columns[:4] == ["doc_id", "row", "gone", "doc"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=repr)
    assert got == sorted([(9, other, 2, 1), (None, "own words", 2, 1), (4, line.replace("quite", "rather"), 1, 0), (4, line.replace("quite", "rather"), 1, 0), (4, "something else", 1, 0), (5, None, 0, 0), (6, "", 1, 0), (7, "\n\n", 3, 0), (8, wide, 2, 1)], key=repr)


# --- the pipeline, stage by stage


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, sf, empty, tmp_path):
    import corpus_pipeline as P

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name, f in P.STAGES:
        assert f(spark, empty, str(tmp_path)).count() == 0, name
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = stages["toxicity"](spark, docs, sf)
    field = toxicity.fit(toxicity.training_sample(docs, labels))
    bad = {r.doc_id for r in toxicity.score(docs, field).where("score >= 0.7").collect()}
    assert kept.columns == P.COLUMNS and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - bad
    base = " ".join(f"word{i}" for i in range(30))
    near = stages["near_dedup"](spark, documents(spark, [(5, base), (3, base + " more"), (4, base), (None, base), (None, None), (8, ""), (9, "")]), sf)
    assert sorted((str(r.doc_id) for r in near.collect())) == ["3", "8", "9", "None", "None"]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 100").first().text
    clean = stages["decontamination"](spark, documents(spark, [(1, f"before {item} after"), (2, "nothing of it"), (None, item), (4, None), (2, "twice")]), sf)
    assert sorted((str(r.doc_id) for r in clean.collect())) == ["2", "2", "4", "None"]
    packed = stages["packing"](spark, documents(spark, [(1, "a few words"), (1, "a few words"), (None, None), (3, "")]), sf).collect()
    assert len({r.sequence_id for r in packed}) == 1 and sorted(str(r.doc_id) for r in packed if r.start == 0) == ["1", "1", "3", "None"]


def test_postings_without_partners_go():
    """Rows that fit no other of their key go, however the rows of a key lie in batches; all pairs that fit stay."""
    rng = np.random.default_rng(12)
    n = 3000
    key = np.sort(np.r_[rng.integers(0, 700, n - 200), np.full(140, 50), np.full(60, 700)]).astype(np.int64)
    size, place = rng.integers(200, 230, n).astype(np.int32), rng.integers(0, 190, n).astype(np.int64)
    near = rng.integers(0, 1 << 62, (n, 2), dtype=np.int64)
    twin = np.flatnonzero(rng.random(n - 1) < 0.1)
    size[twin + 1], place[twin + 1], near[twin + 1] = size[twin], place[twin], near[twin]
    rows = pa.RecordBatch.from_arrays([pa.array(x) for x in (key, np.arange(n), size, place, near[:, 0].copy(), near[:, 1].copy())], ["key", "id", "len", "place", "before", "after"])

    def fits(i, j):
        most = int(max(size[i], size[j])) * (100 - line_dedup.PERCENT) // 100
        if abs(int(place[i]) - int(place[j])) + abs(int(size[i] - place[i]) - int(size[j] - place[j])) > most:
            return False
        bits = lambda x: sum(int(v).bit_count() for v in x)
        return bits(near[i] & near[j]) * 100 >= min(bits(near[i]), bits(near[j])) * line_dedup.ALIKE

    want = set()
    for k in np.unique(key):
        at = np.flatnonzero(key == k)
        want |= {int(i) for i in at if len(at) > line_dedup.FEW or any(fits(min(i, j), max(i, j)) for j in at if i != j)}
    assert len(want) < 0.8 * n
    for step in (1, 7, 500, n):
        got = [i for b in line_dedup.with_partners(rows.slice(a, step) for a in range(0, n, step)) for i in b.column("id").to_pylist()]
        assert got == sorted(want)


def test_postings_with_partners_find_the_same_groups(spark, monkeypatch):
    """The written postings are those with a partner, and nothing but the result is left in the shared folder."""
    rng = np.random.default_rng(13)
    words = ["".join(rng.choice(list("aehinorst"), rng.integers(2, 8))) for _ in range(300)]
    phrase = "onwhor thouenre anrely and anhestor thanhash"
    lines = [" ".join([*rng.choice(words, 30), phrase, *rng.choice(words, 30)]) for _ in range(120)]
    lines += [x.replace(phrase, phrase + " end") for x in lines[:30]]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    kept, save = {}, common.Scratch.save

    def seen(self, df, name="t", **k):
        out = save(self, df, name, **k)
        kept.setdefault(name, []).append((out.count(), self))
        return out

    monkeypatch.setattr(common.Scratch, "save", seen)
    got = {r.doc_id: r.n_removed for r in line_dedup.without_repeated_lines(docs).collect()}
    assert got == {i: int(i >= 120) for i in range(150)}
    assert kept["postings"][0][0] < 0.6 * sum(len(line_dedup.line_keys([x])[1]) for x in lines)
    assert [p.rpartition("-")[2] for p in kept["gone"][0][1].paths] == ["gone"]


def test_sets_that_share_passages_alone_are_not_verified(spark, monkeypatch):
    """Sets that share passages but differ too much, by their parities, are no candidates; links are as by brute force."""
    rng = np.random.default_rng(14)
    passages = [" ".join(f"p{i}w{j}" for j in range(30)) for i in range(40)]
    texts = [" ".join(passages[i] for i in rng.choice(40, 8, replace=False)) for _ in range(150)]
    texts += [f"{t} x{i}" for i, t in enumerate(texts[:20])] + [" ".join(t.split()[:-45]) for t in texts[:20]]
    sets = [set(zip(*(t.split()[j:] for j in range(5)), strict=False)) for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * (both := len(sets[i] & sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - both):
                lo, hi = sorted((want[i], want[j]))
                want = [lo if x == hi else x for x in want]
    tried, linked = [], jaccard.linked

    def counted(postings, check, *a, **k):
        def seen(pairs):
            tried.append(pairs.count())
            return check(pairs)

        return linked(postings, seen, *a, **k)

    monkeypatch.setattr(jaccard, "linked", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert got == dict(enumerate(want)) and len(set(want)) < len(want)
    assert sum(tried) < 150
    for a, b in rng.integers(0, len(texts), (50, 2)):
        x, y = (np.unique(jaccard.shingle_sets([texts[i]], 5, common.WordHash())[0]) for i in (a, b))
        bits = sum(int(v & 0xFFFFFFFFFFFFFFFF).bit_count() for v in map(int, jaccard.parities(x) ^ jaccard.parities(y)))
        assert bits <= len(np.setxor1d(x, y))


def test_copies_around_several_centres_are_merged_before_the_last_step(spark, monkeypatch):
    """Large groups of lines alike that share a passage fall together by hubs: hardly a link within them is left to the last step."""
    rng = np.random.default_rng(15)
    word = lambda: "".join(rng.choice(list("aehinorst"), rng.integers(3, 9)))
    passage = " ".join(word() for _ in range(30))
    lines, group = [], []
    for g in range(3):
        base = [word() for _ in range(25)]
        for _ in range(40):
            own = list(base)
            own[rng.integers(25)] = word()
            lines.append(" ".join([*own, passage]))
            group.append(g)
    found, linked = [], line_dedup.linked

    def counted(postings, check, *a, **k):
        def seen(pairs):
            out = check(pairs)
            found.append(out.count())
            return out

        return linked(postings, seen, *a, **k)

    monkeypatch.setattr(line_dedup, "linked", counted)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in line_dedup.without_repeated_lines(docs).collect()}
    assert got == {i: int(i % 40 > 0) for i in range(120)}
    assert sum(found) < 2 * 120


def test_many_edit_distances_at_once():
    """Pairs compared in blocks of 64 letters, with a band and an early end, are judged as one by one."""
    from lumenframe.llm.edits import all_within

    rng = np.random.default_rng(21)
    for letters in ("ab", "abcdefghij ", "aé語😀 bc"):
        x, y = [], []
        draw = lambda n, letters=letters: "".join(rng.choice(list(letters), n))
        for n in [0, 1, 4, 30, 63, 64, 65, 127, 128, 129, 300, 640] * 4:
            a = draw(n)
            for part in (0, 0.1, 0.2, 0.25):
                b = [("", c + draw(1), draw(1))[rng.integers(3)] if rng.random() < part else c for c in a]
                x.append(a)
                y.append("".join(b))
            x.append(a)
            y.append(draw(max(0, n + int(rng.integers(-20, 20)))))
        most = np.array([max(len(a), len(b)) // 5 for a, b in zip(x, y, strict=True)])
        want = [line_dedup.within(a, b, int(k)) for a, b, k in zip(x, y, most, strict=True)]
        assert all_within(x, y, most).tolist() == want and 40 < sum(want) < len(want) - 40


def test_short_lines_that_share_a_gram_go_by_parities():
    """Parities never part lines alike, and short lines that share a gram but aren't alike are no candidates."""
    rng = np.random.default_rng(22)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(600)]
    lines = [f"{a} the {b}" for a, b in rng.choice(words, (300, 2))]
    near = [x[:3] + x[4:-1] + "é" for x in lines]
    row, key, place, around = line_dedup.line_keys(lines + near, lambda key: np.ones(len(key), bool))
    at = np.array([np.flatnonzero(row == i)[0] for i in range(600)])
    size = np.array([len(x) for x in lines + near])[row]
    assert line_dedup.fits_at(size, place, around, at[:300], at[300:]).all()
    i, j = (at[:300][x] for x in np.triu_indices(300, 1))
    assert line_dedup.fits_at(size, place, around, i, j).mean() < 0.2


def test_pairs_are_verified_by_cells(spark, monkeypatch):
    """Many pairs that share a passage but aren't alike: each text is shuffled once for each side, not for each pair."""
    rng = np.random.default_rng(23)
    words = ["".join(rng.choice(list("aehinorst"), rng.integers(3, 8))) for _ in range(400)]
    passage = " ".join(rng.choice(words, 40))
    lines = [" ".join([*rng.choice(words, 35), passage]) for _ in range(60)]
    lines += [x.replace(passage, passage[:-3]) for x in lines[:5]]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    cells = []
    cogroup = type(docs.groupBy("doc_id")).cogroup
    monkeypatch.setattr(type(docs.groupBy("doc_id")), "cogroup", lambda *a: cells.append(cogroup(*a)) or cells[-1])
    monkeypatch.setattr(line_dedup, "SIDE", 8000)
    monkeypatch.setattr(line_dedup, "SIDES", 2)
    got = {r.doc_id: r.n_removed for r in line_dedup.without_repeated_lines(docs).collect()}
    assert got == {i: int(i >= 60) for i in range(65)}
    assert cells
