"""Operators against DuckDB SQL and brute force on small tables, and on the edge cases their docstrings define."""

import zlib

import numpy as np
import pytest

pytest.importorskip("lumenframe.llm")

from lumenframe.llm import decontam, exact_dedup, jaccard, line_dedup, packing, queries, sharding, substring_dedup, token_counts, toxicity, url_filter  # noqa: E402

ODD = [(1, "a b  c"), (2, "a b c"), (2, "a b c"), (None, "a b c"), (None, None), (3, None), (4, ""), (5, " \n\t"), (6, "x " * 30_000), (7, "<|endoftext|> it's 12"), (8, "日本語\x1c ½ É"), (9, "a b\tc"), (10, "idiot\n\nidiot")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in ODD], "doc_id long, text string, doc string, row long, gone int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows(df):
    return sorted(repr(tuple(r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(name, spark, sf, duck):
    got, want = queries.queries()[name](spark, sf).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert rows(got) == rows(want[list(got.columns)])


def test_sharding(odd, empty, spark, sf):
    assert sharding.shard_documents(empty).count() == 0
    for df, n in ((odd, len(ODD)), (spark.read.parquet(f"{sf}/documents.parquet"), 200)):
        r = sharding.shard_documents(df).toPandas()
        assert len(r) == n and r["shard"].between(0, 23).all()
        assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in r.groupby("shard"))
        assert set(r["grown_shard"][r["grown_shard"] != r["shard"]]) <= {24}
    texts = dict(ODD)
    one = sharding.shard_documents(odd.where("doc_id = 9")).first()
    assert one.size == len(texts[9].encode()) + 8 and one.text_crc32 == zlib.crc32(texts[9].encode())


@pytest.mark.parametrize("limit", [1, 200, 1 << 20])
def test_exact_dedup(odd, empty, limit):
    import re

    assert exact_dedup.dedup(empty).count() == 0
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in ODD:
        groups.setdefault(norm(t), []).append(i)
    got = sorted(((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.dedup(odd, limit).collect()), key=repr)
    want = sorted(((i, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g), key=repr)
    assert got == want


def test_token_counts_and_packing(odd, empty, spark):
    from tokenizers import Tokenizer

    assert token_counts.count_tokens(empty).count() == 0 and packing.pack(empty, token_counts.vocabulary_path("word_bpe_49k.json")).count() == 0
    tok = Tokenizer.from_file(token_counts.vocabulary_path())
    want = sorted(((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD), key=repr)
    for head in (0, 5, 1000):
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(odd, head=head).collect()), key=repr) == want
    path = token_counts.vocabulary_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    p = packing.pack(odd, path).toPandas()
    seq = p.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (seq["length"].sum() <= 4096).all() and all((g["offset"].to_numpy() == np.r_[0, g["length"].cumsum()[:-1]]).all() for _, g in seq)
    whole = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for i, t in ODD if i not in (None, 2)}
    for i, ids in whole.items():
        g = p[p["doc_id"] == i].sort_values("start")
        assert g["length"].sum() * 4 == len(ids) and all(zlib.crc32(ids[4 * s : 4 * (s + n)]) == c for s, n, c in zip(g["start"], g["length"], g["ids_crc32"], strict=True))


def test_pairs_and_repeats(odd, empty):
    assert jaccard.near_duplicates(empty).count() == 0 and substring_dedup.cut_repeats(empty).count() == 0
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(odd).collect() if r.doc_id}
    assert got[1] == got[2] == got[9] == (1, 1) and got[3] == (0, 3) and got[4] == (0, 4) and got[6] == (1, 6)
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.cut_repeats(odd).collect() if r.doc_id}
    assert cut[6] == (30_000, 0) and cut[3] == (0, 0) and cut[2] == (3, 0)


def test_sketch_never_misses():
    from lumenframe.llm.common import RepeatSketch, mix

    h = mix(np.arange(5000, dtype=np.uint64) % np.uint64(3000))
    sketch = RepeatSketch(2, 12)
    cells = sketch.cells(h)
    bits = np.zeros((2 << 12) >> 3, np.uint8)
    for c in cells:
        n = np.bincount(c, minlength=2 << 12)
        bits |= np.packbits(n > 1, bitorder="little")
    again = sketch.repeated(h, bits)
    n = np.bincount(np.arange(5000) % 3000)
    assert again[n[np.arange(5000) % 3000] > 1].all()


def test_lines(spark, empty):
    assert line_dedup.without_repeated_lines(empty).count() == 0
    base = "the quick brown fox jumps over the lazy dog and runs far away from the old stone house by the river"
    docs = spark.createDataFrame([(1, f"{base}\nother line here"), (2, f"Page 1\n{base.upper()}\n\nown words"), (3, "page 2\nstays"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(docs).collect()}
    assert got == {1: f"{base}\nother line here", 2: "Page 1\n\nown words", 3: "stays", 4: None}


def test_decontamination(spark, odd, empty):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item), (2, "Short item"), (3, None), (4, "...")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x y {item.upper()} z"), (2, "a short, ITEM"), (3, "nine ten"), (4, None), (5, "shörtitem")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in decontam.contamination(docs, bench).collect()}
    assert got == {1: (14, 11, ["1"]), 2: (3, 2, ["2"]), 3: (2, 0, []), 4: (0, 0, []), 5: (1, 0, [])}
    assert decontam.contamination(empty, bench).count() == 0 and not decontam.contamination(odd, bench.limit(0)).where("contaminated").count()


def test_urls(spark, sf):
    pages = spark.createDataFrame([(1, "http://A.Example.NET/en/x?y"), (2, "https://example.com/de/1"), (3, "ftp://x.net/q"), (4, "http://a.org/fr/2#t"), (5, None), (6, "no scheme"), (7, "http://example.com")], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2][2:] == ("example.com/de/", "block") and got[3][2:] == ("net/", "block") and got[4][2:] == ("org/fr/", "allow")
    assert got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None) and got[7][:3] == ("example.com", "", None)
    r = url_filter.op1_url_filter(spark, sf).toPandas()
    assert len(r) == 50 and set(r["verdict"]) <= {"allow", "block"}


def test_marginals_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    e, t, s = rng.normal(size=5), rng.normal(size=(2, 2)), 0.3
    odds = toxicity.marginals(e, np.array([0, 5]), s, t)
    total = np.zeros(5)
    z = 0.0
    for y in product((0, 1), repeat=5):
        w = np.exp(sum(v for v, on in zip(e, y, strict=True) if on) + s * y[0] + sum(t[a, b] for a, b in zip(y[:-1], y[1:], strict=True)))
        z += w
        total += w * np.array(y)
    np.testing.assert_allclose(odds / (1 + odds), total / z)


def test_toxicity(spark, odd):
    bad = ["awful", "nasty", "vile", "rotten"]
    sample = [(1, f"you are {bad[i % 4]} and {bad[(i + 1) % 4]} number{i} thing{i}") for i in range(40)] + [(0, f"you are kind and fair number{i} thing{i}") for i in range(80)]
    field = toxicity.fit(sample)
    docs = spark.createDataFrame([(1, "they are vile people"), (2, "they are fair people"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, field).collect()}
    assert got[1].score >= 0.7 > max(got[i].score for i in (2, 3, 4)) and [tuple(s) for s in got[1].spans] == [(9, 13)]
    assert toxicity.score(odd, field).count() == len(ODD)


def test_pipeline(spark, sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf).toPandas()
    docs = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert set(out["doc_id"]) <= docs and len(set(out["doc_id"])) > 100 and (out.groupby("sequence_id")["length"].sum() <= 4096).all()


def test_edit_bound_by_brute_force():
    from lumenframe.llm.line_dedup import within

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = np.random.default_rng(1)
    for _ in range(2000):
        a, b = ("".join(rng.choice(list("abcé"), rng.integers(0, 14))) for _ in range(2))
        for most in (0, 1, 3, 6):
            assert within(a, b, most) == (distance(a, b) <= most)


def test_quick_alignment_is_an_upper_bound():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcde"), rng.integers(1, 6))) for _ in range(40)]
    sure = 0
    for _ in range(3000):
        x = list(rng.choice(words, rng.integers(1, 14)))
        y = [w if rng.random() > 0.2 else rng.choice(words) for w in x if rng.random() > 0.1]
        a, b = " ".join(x), " ".join(y)
        for most in (0, 2, 5, len(a) // 5):
            if line_dedup.surely_alike(a, b, most):
                sure += 1
                assert line_dedup.within(a, b, most)
    assert sure > 1000 and line_dedup.surely_alike("x" * 9, "x" * 9, 0)


def test_anchored_grams_of_scripts_without_blanks():
    rng = np.random.default_rng(4)
    line = "".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 300))
    like = line[:100] + "中文" + line[110:]
    row, key, place, near = line_dedup.anchored([line, "short", like, "0 0.0 " * 40], 16, 40)
    keys = [set(key[row == i].tolist()) for i in range(4)]
    assert len(keys[0] & keys[2]) > 5 and keys[3] and (place >= 0).all() and place[row == 0].max() < 300 and len(near(np.arange(len(row)))) == len(row)


def test_lines_alike_by_brute_force(spark):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(2, 9))) for _ in range(400)]
    lines = []
    for n in (1, 2, 3, 6, 10, 16, 30, 60, 150):
        for _ in range(6):
            w = list(rng.choice(words, n))
            lines.append(" ".join(w))
            for share in (0.05, 0.1, 0.15):
                x = [rng.choice(words) if rng.random() < share else y for y in w]  # words replaced
                lines.append(" ".join(x))
                x = list(" ".join(w))
                for _ in range(max(1, int(len(x) * share / 2))):  # letters replaced, left out or added
                    i, kind = rng.integers(len(x)), rng.integers(3)
                    x[i : i + 1] = [[rng.choice(list("xyz"))], [], [x[i], rng.choice(list("xyz"))]][kind] if len(x) > 1 else x
                lines.append("".join(x))
    lines = [x for x in (" ".join(x.split()) for x in lines) if x]
    rng.shuffle(lines)
    group = list(range(len(lines)))
    for j, b in enumerate(lines):
        for i in range(j):
            a, most = lines[i], max(len(lines[i]), len(b)) // 5
            if group[i] != group[j] and line_dedup.within(a, b, most):
                lo, hi = sorted((group[i], group[j]))
                group = [lo if g == hi else g for g in group]
    want = {i // 8: [lines[j] for j in range(i, min(i + 8, len(lines))) if group[j] == j] for i in range(0, len(lines), 8)}
    docs = spark.createDataFrame([(i // 8, "\n".join(lines[i : i + 8])) for i in range(0, len(lines), 8)], "doc_id long, text string")
    got = {r.doc_id: [x for x in r.text.split("\n") if x] for r in line_dedup.without_repeated_lines(docs).collect()}
    assert got == want and len(set(group)) < len(lines) / 2


def test_short_lines_meet_without_loss():
    rng = np.random.default_rng(2)
    lines = sorted({"".join(rng.choice(list("ab "), rng.integers(1, 10))).strip() or "a" for _ in range(400)} | {"".join(rng.choice(list("abcd"), 8)) + x for x in ("efghijklm", "efxhijylm", "zfghyjklm", "efgxhijkm") for _ in range(20)})
    keys = [set() for _ in lines]
    for i, k in zip(*line_dedup.line_keys(lines)[:2], strict=True):
        keys[i].add(int(k))
    near = [(i, j) for j, b in enumerate(lines) for i, a in enumerate(lines[:j]) if line_dedup.within(a, b, max(len(a), len(b)) // 5)]
    assert len(near) > 100 and all(keys[i] & keys[j] for i, j in near)


def test_pipeline_drops_copies_with_blank_lines(spark):
    import re

    import corpus_pipeline

    one = re.compile(f"[{line_dedup.WHITE}]")
    assert all(bool(one.match(chr(i))) == chr(i).isspace() for i in range(0x110000))
    text = "a first line of some words\n\n \u3000\t\nanother line of words\n"
    docs = spark.createDataFrame([(1, text), (2, text), (3, "\n \n"), (4, text + "own"), (5, None)], "doc_id long, text string").selectExpr("*", "'en' lang", "'x' source", "length(text) n_chars")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {1: text, 3: "\n \n", 4: "\n \u3000\t\nown", 5: None}


def test_decontamination_with_slop(spark):
    terms = "one two three four five six".split()
    bench = spark.createDataFrame([(1, " ".join(terms))], "item_id long, text string")
    texts = ["a b one two four three five six c d", "one two three four five six", ", one two three four five x six.", "a six five four three two one", "x y z two one four three six five", "a b c d", "two one three four five six tail end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for slop in (0, 1, 2):
        want = {}
        for i, t in enumerate(texts):
            w = [x for x in t.replace(",", " ").replace(".", " ").split()]
            inside = set()
            for start in range(-slop - 6, len(w) + slop + 6):
                if all(x in w[max(start + o - slop, 0) : max(start + o + slop + 1, 0)] for o, x in enumerate(terms)):
                    inside |= set(range(start - slop, start + len(terms) + slop)) & set(range(len(w)))
            want[i] = (len(w), len(inside))
        assert {r.doc_id: (r.n_words, r.n_hit) for r in decontam.contamination(docs, bench, slop=slop).collect()} == want
