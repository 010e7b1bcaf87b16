"""The corpus operators against brute force, round trips and held-out accuracy."""
import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tests_llm_helpers import hits, linked, without_repeats

from canvass.llm import (archives, bpe, components, decontaminate, language, near_dedup, queries, suffix_dedup, token_counts, topk, toxicity,
                         url_filter)

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LONG = "lorem ipsum " * 20_000
DOCS = "doc_id long, text string, lang string, ids string, spans string, kept string, score string, digest string, rep string, value string, _x string"


def documents(spark, *texts, start=0):
    """Rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(start + k, t, "en", *"abcdefgh") for k, t in enumerate(texts)], DOCS)


def edge_documents(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "one"), (5, "one"), (6, LONG), (7, LONG), (8, "née 漢字 <|endoftext|> 😀!"), (None, "one two three four five six"), (8, "née 漢字 <|endoftext|> 😀!")]
    return spark.createDataFrame([(i, t, None, *"abcdefgh") for i, t in rows], DOCS)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(spark, sf_dir=SMALL):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want)


# --- 1 ------------------------------------------------------------------------

def passages(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    shared = [" ".join(word() for _ in range(r.randint(15, 60))) for _ in range(4)]
    out = ["ha " * 120, "x" * 350, shared[0] * 3]
    while len(out) < n:
        parts = [" ".join(word() for _ in range(r.randint(0, 40))), r.choice(shared), " ".join(word() for _ in range(r.randint(0, 40)))]
        out.append(r.choice(out) if r.random() < 0.15 else " ".join(parts))
    return out


@pytest.mark.parametrize("collection", [8192, 3])
def test_suffix_dedup_is_exact(spark, monkeypatch, collection):
    monkeypatch.setattr(suffix_dedup, "COLLECTION", collection)  # 3: collections are split
    texts = passages(collection, 80)
    got = suffix_dedup.remove_repeats(documents(spark, *texts)).select("doc_id", "kept", "spans").collect()
    assert sorted((r.doc_id, bytes(r.kept), len(r.spans)) for r in got) == without_repeats(enumerate(texts))


def test_merge_finds_every_repeated_window():
    strings = [t.encode() for t in passages(5, 25)]
    string, start, block = suffix_dedup.merge(strings)
    found = defaultdict(set)
    for s, t, b in zip(string.tolist(), start.tolist(), block.tolist()):
        found[b].add((s, t))
    windows = defaultdict(set)
    for k, s in enumerate(strings):
        for t in range(len(s) - 99):
            windows[s[t:t + 100]].add((k, t))
    assert {frozenset(x) for x in found.values()} == {frozenset(x) for x in windows.values() if len(x) > 1}


def test_suffix_dedup_edges(spark):
    got = {(r.doc_id, r.text): r for r in suffix_dedup.remove_repeats(edge_documents(spark)).collect()}
    assert len(got) == 9 and got[1, None].kept == b"" and got[2, ""].spans == []
    assert got[6, LONG].kept == LONG.encode()[:12] and got[7, LONG].kept == b""
    assert got[None, "one two three four five six"].kept == b"one two three four five six"
    assert suffix_dedup.remove_repeats(no_documents(spark)).count() == 0
    cut = suffix_dedup.remove_repeats(documents(spark, "é" * 60 + "ab", "à" + "é" * 59 + "ab"), characters=True).collect()
    assert all(bytes(r.kept).decode() is not None for r in cut)


# --- 2 ------------------------------------------------------------------------

def test_url_filter_equals_sql(spark):
    same_as_sql(spark, "op2_url_filter")


def test_url_filter_edges(spark):
    pages = spark.createDataFrame(
        [(1, None, "x"), (2, "no scheme", "x"), (3, "http://A.Example.COM/en/1?x", "x"), (4, "http://com", "x"), (5, "a://xcom/", "x"), (6, "http://www.example.com/en/", "x"),
         (6, "http://www.example.com/en/", "x"), (7, "", "x"), (8, "http://" + "a." * 50_000 + "net/es/q", "x")], "page_id long, url string, verdict string")
    listed = spark.createDataFrame([*queries.URL_RULES, (None, "/", "block")], "host string, path string, verdict string")
    got = {r.page_id: r for r in url_filter.judge(pages, listed).collect()}
    assert url_filter.judge(pages, listed).count() == 9
    assert [(got[k].rule, got[k].verdict) for k in range(1, 9)] == [
        (None, "allow"), (None, "allow"), ("example.com/en/", "block"), (None, "allow"), (None, "allow"), ("www.example.com/en/", "allow"), (None, "allow"), ("net/es/", "block")]
    assert (got[2].host, got[2].path, got[3].host, got[3].path) == ("", "", "a.example.com", "/en/1")
    assert url_filter.judge(pages, listed.limit(0)).where("verdict = 'allow' and rule is null").count() == 9
    assert url_filter.judge(pages.limit(0), listed).count() == 0


def test_url_filter_many_listed(spark):
    listed = spark.range(500).selectExpr("concat('h', id, '.org') as host", "concat('/', id % 7, '/') as path", "'block' as verdict")
    pages = spark.range(2000).selectExpr("id as page_id", "concat('http://s.h', id % 1000, '.org/', id % 9, '/p') as url")
    blocked = {r.page_id for r in url_filter.judge(pages, listed).where("verdict = 'block'").collect()}
    assert blocked == {k for k in range(2000) if k % 1000 < 500 and (k % 1000) % 7 == k % 9}


# --- 3 ------------------------------------------------------------------------

def test_decontamination_is_exact(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{MID}/benchmark.parquet").collect()]
    got = queries.op3_decontaminate(spark, MID).collect()
    want = hits(texts_of(spark, MID), items)
    assert any(w[3] for w in want.values())
    assert {r.doc_id: (r.n_words, r.n_hit, r.items_sha256, r.contaminated) for r in got} == {
        d: (n, h, hashlib.sha256(",".join(i).encode()).hexdigest(), c) for d, (n, h, i, c) in want.items()}


def test_decontamination_edges(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK_BYTES", 20)  # items in several blocks
    items = spark.createDataFrame([(1, "One TWO"), (2, None), (3, "..."), (None, "five six"), (4, "ipsum lorem " * 6), (1, "One TWO"), (9, "née 漢字")], "item_id long, text string")
    docs = edge_documents(spark)
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in decontaminate.matches(docs, items).collect())
    assert got == Counter([(1, 0, 0, ()), (2, 0, 0, ()), (3, 0, 0, ()), (4, 1, 0, ()), (5, 1, 0, ()), (6, 40000, 40000, ("4",)), (7, 40000, 40000, ("4",)),
                           (None, 6, 4, ("1",)), *[(8, 4, 2, ("9",))] * 2])
    assert sorted(str(r.doc_id) for r in decontaminate.clean(docs, items).collect()) == ["1", "2", "3", "4", "5"]
    assert decontaminate.matches(no_documents(spark), items).count() == 0
    assert decontaminate.matches(docs, items.limit(0)).where("contaminated").count() == 0


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = documents(spark, "alpha beta x gamma delta", "alpha beta gamma delta", "delta gamma beta y y y y y y alpha")
    got = {r.doc_id: (r.items, r.near_items) for r in decontaminate.matches(docs, items, slop=1).collect()}
    assert got == {0: ([], ["1"]), 1: (["1"], ["1"]), 2: ([], [])}


# --- 4 ------------------------------------------------------------------------

def test_toxicity_on_documents_it_has_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    models = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    assert [len(m["weights"]) - len(m["slots"]) for m in models] == [1, 2]  # the second one is fed the first one's probability
    got = toxicity.predict(docs, models).join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("toxic").agg({"*": "count"}).collect()
    table = Counter()
    for r in toxicity.predict(docs, models).join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("toxic", "is_toxic").count().collect():
        table[r.toxic, r.is_toxic] = r["count"]
    assert got and table[1, True] > 0.9 * (table[1, True] + table[1, False])
    assert table[0, True] < 0.01 * (table[0, True] + table[0, False])


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(4, 1, 0), (6, None, 1), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    models = toxicity.fit(edge_documents(spark), labels)
    got = toxicity.predict(edge_documents(spark), models)
    assert got.count() == 10 and got.where("text is null and is_toxic").count() == 0
    assert toxicity.predict(no_documents(spark), toxicity.fit(no_documents(spark), labels.limit(0))).count() == 0


# --- 5 ------------------------------------------------------------------------

def test_language_on_held_out_documents(spark):
    got = queries.op5_language(spark, MID).join(spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(0 <= r.score <= 1 for r in got) and 250 < len(held) < 420
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_language_spans_and_edges(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    model = language.fit(docs.where("doc_id >= 100"))
    by = {x: " ".join(docs.where(f"doc_id < 100 and lang = '{x}'").orderBy("doc_id").first().text.split()[:60]) for x in ("en", "de")}
    mixed = documents(spark, by["en"] + " " + by["de"] + " " + by["en"], "Ελληνικά", "12 !?", None)
    spans = [(r.start, r.lang) for r in language.label_spans(mixed.where("doc_id = 0"), model).orderBy("start").collect()]
    assert [x for _, x in spans] == ["en", "de", "en"]
    assert abs(spans[1][0] - len(by["en"])) < 60
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(mixed, model).collect()}
    assert got[0][0] == "en" and got[1][0] in model["languages"] and got[2] == got[3] == ("und", 0.0)
    assert language.predict(edge_documents(spark), model).where("lang_pred = 'und'").count() == 3
    nothing = language.fit(no_documents(spark))
    assert {r.lang_pred for r in language.predict(edge_documents(spark), nothing).collect()} == {"und"}
    assert language.predict(no_documents(spark), model).count() == 0


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(3)
    for n in (1, 2, 6):
        scores = r.normal(size=(n, 3)) * 3
        best = max(np.ndindex(*[3] * n), key=lambda p: sum(scores[k, x] for k, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:])))
        assert language.viterbi(scores, np.zeros(n, int), 1, 2.0).tolist() == list(best)


def test_paths_without_viterbi_are_its_paths():
    r = np.random.default_rng(5)
    for penalty in (0.5, 3.0):
        for _ in range(40):
            text = np.sort(r.integers(0, 12, 30))
            scores = np.round(r.normal(size=(30, 3)) * 2)  # with ties
            scores[:, 1] += (text % 3 == 0) * 4
            assert (language.best_paths(scores, text, 12, penalty) == language.viterbi(scores, text, 12, penalty)).all()


def test_scores_of_distinct_words_are_all_scores(spark):
    model = language.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))
    scorer = language.Scorer(model)
    for texts in (["Ελλ ΟΔΟΣ одно one One ONE", "", "ﬁ İı ſ ǅ"], list(texts_of(spark).values())):
        words = language.Words([t or "" for t in texts])
        assert np.allclose(scorer(words), language.word_scores(model, words))


# --- 6 ------------------------------------------------------------------------

def test_topk_equals_sql(spark):
    same_as_sql(spark, "op6_topk")


def test_topk_edges(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    r = np.random.default_rng(1)
    rows = [(k, [float(x) for x in r.integers(-3, 4, 6)]) for k in range(300)]  # many ties
    odd = [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (None, [1.0] * 6), (1020, [1.0, 2.0]), (0, rows[0][1]), (1040, [])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, score string")
    v = topk.integers(table, 64)
    got = defaultdict(list)
    for x in topk.top_k(v, v.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    ints = {i: [int(np.floor(64 * x)) for x in y] for i, y in rows}
    for q in range(0, 300, 20):
        best = sorted(((-sum(a * b for a, b in zip(ints[q], w)), i) for i, w in ints.items() if i != q))[:20]
        assert got[q] == [(i, -s) for s, i in best]
    assert set(got) == set(range(0, 300, 20))  # 1020 and 1040 have no vector of their length to meet
    few = v.where("vec_id < 5")
    assert topk.top_k(few, few, 20).count() == 20 and topk.top_k(v.limit(0), few, 20).count() == 0


def test_topk_scores_beyond_a_long(spark):
    vectors = topk.integers(spark.createDataFrame([(0, [1e17, 1.0]), (1, [1e17, 2.0]), (2, [-1e17, 1.0]), (3, [0.0, 1.0])],
                                                  "vec_id long, embedding array<double>"), 64)
    got = [(r.rank, r.vec_id, r.score) for r in topk.top_k(vectors, vectors.where("vec_id = 0"), 20).orderBy("rank").collect()]
    assert got == [(1, 1, 2**63 - 1), (2, 3, 64 * 64), (3, 2, -2**63)]


def lists_of(data):
    places = np.argsort(data, axis=0, kind="stable").T.astype(np.int32)
    return places, np.take_along_axis(data.T, places, axis=1)


@pytest.mark.parametrize("scale", [3, 40, 1 << 30, 1 << 60])
def test_topk_bounds_drop_no_row(scale):
    r = np.random.default_rng(2)
    data, queries_ = r.integers(-scale, scale, (3000, 8)), r.integers(-scale, scale, (5, 8))
    queries_[1] = 0
    queries_[2, 3:] = 0
    ids = r.permutation(3000)
    who, place, value, read = topk.block_top(ids[:5], queries_, ids, data, *lists_of(data), 10)
    for q in range(5):
        score = [min(max(sum(int(a) * int(b) for a, b in zip(row, queries_[q])), -(2**63)), 2**63 - 1) for row in data]
        order = sorted((k for k in range(3000) if k != q), key=lambda k: (-score[k], ids[k]))[:10]
        assert place[who == q].tolist() == order and value[who == q].tolist() == [score[k] for k in order]
        assert (read[who == q] <= 3000 * np.count_nonzero(queries_[q])).all()
    # with the k-th score as a bar brought along, the same rows
    bars = np.array([value[who == q].min() for q in range(5)], float)
    again = topk.block_top(ids[:5], queries_, ids, data, *lists_of(data), 10, bars)
    assert {q: again[1][again[0] == q].tolist() for q in range(5)} == {q: place[who == q].tolist() for q in range(5)}


def test_topk_lists_are_left_early_where_scores_are_skewed(spark):
    r = np.random.default_rng(3)
    # a few components carry most of the scores: the best rows stand at the tops of their lists
    values = np.floor(r.pareto(1.2, (4000, 8)) * 10).clip(0, 10**6)
    v = spark.createDataFrame([(k, [int(x) for x in row]) for k, row in enumerate(values)], "vec_id long, v array<long>")
    found = topk.found_in_blocks(v.coalesce(1), v.where("vec_id % 20 = 0").coalesce(1), 20)
    read = found.groupBy("query_id", "block").agg({"n_read": "max"}).toDF("q", "b", "n").agg({"n": "avg"}).first()[0]
    assert read < 4000 * 8 / 2
    want = values @ values[40]
    got = [x.vec_id for x in topk.top_k(v, v.where("vec_id = 40"), 20).orderBy("rank").collect()]
    assert got == sorted((k for k in range(4000) if k != 40), key=lambda k: (-want[k], k))[:20]


# --- 7 ------------------------------------------------------------------------

def test_archives_equal_sql(spark):
    same_as_sql(spark, "op7_warc")


def test_archives_edges(spark, monkeypatch):
    monkeypatch.setattr(archives, "RECORDS_PER_FILE", 3)  # both versions, several files
    big = "WARC/1.0\r\n\r\nfiledesc://\n" * 8
    rows = [(1, "http://a b/\n", None), (2, None, ""), (3, "http://c/", big), (4, "http://d/", big), (4, "http://d/", big), (None, "http://e/", big), (6, "http://f/", "short"), (7, "http://g/", "short")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string").repartition(2)
    got = archives.round_trip(pages).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter(
        (i, len(t or ""), digest(t), "revisit" if t == big and i != 3 else "response", 3 if t == big and i != 3 else None) for i, _, t in rows)
    assert archives.round_trip(pages.limit(0)).count() == 0


def test_arc_versions_and_damage():
    one = b"filedesc://x 0.0.0.0 19990101000000 text/plain 77\n1 0 old\nURL IP-address Archive-date Content-type Archive-length\n"
    one = one.replace(b" 77\n", f" {len(one.split(b'\n', 1)[1])}\n".encode())
    record = b"http://a b/c 1.2.3.4 19990102030405 text/html 5\nhel\nl\n"
    found = list(archives.arc_records(gzip.compress(one + record + b"\n" + record)))
    assert [(v, f["URL"], body) for v, f, body in found] == [(1, "http://a b/c", b"hel\nl")] * 2
    two = one.replace(b"\n1 0", b"\n2 0").replace(b"URL IP-address Archive-date Content-type Archive-length", archives.ARC_FIELDS[2].encode())
    two = re.sub(rb"plain \d+", f"plain {len(two.split(b'\n', 1)[1])}".encode(), two)
    more = b"http://a/ 1.2.3.4 19990102030405 text/html 200 - - 0 f.arc 2\nhi\n"
    assert [(v, f["Result-code"], body) for v, f, body in archives.arc_records(two + more)] == [(2, "200", b"hi")]
    assert list(archives.arc_records(one + record[:-4])) == [] and list(archives.arc_records(b"")) == []


# --- 8 ------------------------------------------------------------------------

def test_token_counts_answer_every_limit(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 50)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    lengths = token_counts.encoded_lengths(docs, public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(len(t.encode(x, add_special_tokens=False).ids) for x in texts_of(spark).values())
    hist = token_counts.histogram(lengths).cache()
    for r in hist.collect():
        assert (r.n_docs, r.docs_up_to) == (want.count(r.length), sum(x <= r.length for x in want))
        assert (r.tokens_up_to, r.tokens_longer) == (sum(x for x in want if x <= r.length), sum(x for x in want if x > r.length))
        assert r.truncated_total == sum(min(x, r.length) for x in want)
    for limit in (0, 1, 77, 128, 10**6):
        assert tuple(token_counts.truncated(hist, limit).first()) == (sum(x > limit for x in want), sum(min(x, limit) for x in want))
    assert token_counts.quantile(hist, 0.5).first().length == want[(len(want) + 1) // 2 - 1]


def test_token_counts_edges(spark):
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    hist = token_counts.histogram(token_counts.encoded_lengths(edge_documents(spark), vocabulary))
    assert hist.where("length = 0").first().n_docs == 2 and hist.agg({"n_docs": "sum"}).first()[0] == 10
    blanks = documents(spark, " " * 2_000_000, "a <|endoftext|> b")
    assert sorted(r.length for r in token_counts.encoded_lengths(blanks, vocabulary).collect()) == sorted(
        r.n_tokens for r in bpe.digests(blanks, vocabulary).collect())
    empty = token_counts.histogram(token_counts.encoded_lengths(no_documents(spark), vocabulary)).collect()
    assert [(r.length, r.n_docs, r.share) for r in empty] == [(0, 0, None)]


# --- 9 ------------------------------------------------------------------------

def near_texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    out = []
    for size in (8, 30, 62, 64, 66, 70, 150, 400):
        base = [word() for _ in range(size)]
        for _ in range(25):
            copy = list(base)
            for _ in range(r.randint(0, max(1, size // 60))):
                copy[r.randrange(size)] = word()
            out.append(" ".join(copy + [word() for _ in range(r.randint(0, size // 30))]))
    return out


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_are_exact(spark, percent):
    texts = near_texts(percent)
    got = near_dedup.near_duplicates(documents(spark, *texts), percent).collect()
    want = linked(dict(enumerate(texts)), percent)
    assert 8 < len({c for _, c in want.values()}) < len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_the_documents(spark):
    got = queries.op9_minhash(spark, SMALL).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked(texts_of(spark), 85)


def test_near_duplicate_edges(spark):
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(edge_documents(spark), 85).collect())
    assert got == Counter([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 2, 6, True), (7, 2, 6, False), (None, 2, None, True), *[(8, 1, 8, True)] * 2])
    assert sorted(str(r.doc_id) for r in near_dedup.deduplicate(edge_documents(spark), 85).collect()) == ["1", "2", "3", "4", "6", "8", "8", "None"]
    assert near_dedup.near_duplicates(no_documents(spark), 85).count() == 0


def test_words_of_equal_power_sums_are_different(spark):
    bits = [bin(k).count("1") & 1 for k in range(4096)]  # Thue-Morse words and their complements
    texts = ["".join("ab"[x ^ flip] for x in bits) for flip in (0, 1)]
    got = near_dedup.near_duplicates(documents(spark, *texts), 85).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(0, 0), (1, 1)}
    sets = [[s.tolist() for s in near_dedup.shingle_sets(np.frombuffer(" ".join(texts).encode(), np.uint8), np.array([0, 4096, 8193]), salt)] for salt in (0, 9)]
    assert len({x for s in sets for y in s for x in y}) == 4


def test_components_of_a_chain(spark):
    chain = spark.range(60).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(100, 101)], "a long, b long"))
    got = {r.node: r.component for r in components.components(chain.repartition(3)).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


# --- 10 -----------------------------------------------------------------------

def test_bpe_equals_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.digests(spark.read.parquet(f"{SMALL}/documents.parquet"), path).collect()}
    for d, text in texts_of(spark).items():
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[d].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoder, r = bpe.Encoder(bpe.vocabulary(path)), random.Random(4)
    alphabet = [*" \t\n\r'sdtmrelvaaabc123é²½漢字<>|!?\x00\x1c\x85\u200b😀", "<|endoftext|>", "'ll", "  ", "aaaa"]
    for _ in range(1500):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
        assert encoder.encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_bpe_edges(spark, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = bpe.decode(bpe.encode(edge_documents(spark), path), path, text="decoded").collect()
    assert len(got) == 10 and all(r.decoded == (r.text or "") for r in got)
    assert {len(r.ids) for r in got if not r.text} == {0}
    assert bpe.encode(no_documents(spark), path).count() == 0
