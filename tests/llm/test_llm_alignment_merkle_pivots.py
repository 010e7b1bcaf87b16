"""Token alignment, the Merkle manifest and the pivot index against brute force."""
import bisect
import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm_operators import SMALL, documents, edge_documents, no_documents, same_as_sql, texts_of

from canvass.llm import alignment, merkle, pivots, queries
from canvass.llm.bpe import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# --- 11 -----------------------------------------------------------------------

def brute_vectors(rows, cosine=0.93):
    """vec_id -> (links, component) of (vec_id, label, vector) rows with different ids."""
    usable = [(i, lab, np.array(v, float)) for i, lab, v in rows
              if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent, count = {i: i for i, *_ in rows}, Counter()

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, lab, v) in enumerate(usable):
        for j, other, w in usable[k + 1:]:
            if lab == other and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= cosine:
                count[i] += 1
                count[j] += 1
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: (count[i], top(i)) for i, *_ in rows}


def near_vectors(seed, n, labels=3, dim=64):
    """Random vectors with copies, near copies of all degrees and one large group."""
    r = np.random.default_rng(seed)
    out = [r.normal(size=dim)]
    while len(out) < n:
        base = out[r.integers(len(out))] if r.random() < 0.5 else out[0] if r.random() < 0.3 else r.normal(size=dim)
        out.append(base + r.normal(size=dim) * r.choice([0, 0.1, 0.25, 0.3, 0.36, 0.45]))
    return [(k, int(r.integers(labels)), [float(x) for x in v * r.choice([1, 1e-3, 1e60])]) for k, v in enumerate(out)]


VECTORS = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("block", [2048, 40])
def test_pivot_index_finds_the_links(spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK_ROWS", block)
    rows = near_vectors(4, 900)
    want = brute_vectors(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.near_duplicates(spark.createDataFrame(rows, VECTORS), 0.93).collect()}
    assert all(kept == (c == i) for i, (_, c, kept) in got.items())
    found, links = sum(n for n, *_ in got.values()), sum(n for n, _ in want.values())
    assert links > 1000 and 0.999 * links <= found <= links
    assert all(got[i][0] <= want[i][0] for i in want)
    assert np.mean([got[i][:2] == want[i] for i in want]) > 0.99


def test_pivot_index_does_not_compare_all(spark):
    r = np.random.default_rng(8)
    rows = [(k, 1, [float(x) for x in r.normal(size=64)]) for k in range(6000)]
    distinct = pivots.classes(spark.createDataFrame(rows, VECTORS))
    about = pivots.described(distinct, pivots.pivots(distinct)).toPandas()
    prefix = np.stack(about.prefix.to_numpy())
    assert prefix.shape == (6000, pivots.NEAREST) and all(len(set(p)) == pivots.NEAREST for p in prefix[:50].tolist())
    has = np.zeros((6000, prefix.max() + 1), np.float32)
    np.put_along_axis(has, prefix, 1, axis=1)
    assert ((has @ has.T) >= pivots.SHARED).mean() < 0.1


def test_first_common_pivot_decides_the_list():
    """Every pair with enough common pivots is met in exactly one list."""
    r = np.random.default_rng(2)
    prefix = np.stack([r.permutation(15)[:6] for _ in range(60)]).astype(np.int32)
    x = np.ones((60, 1))
    met = Counter()
    for p in range(15):
        rows = np.flatnonzero([p in sorted(q)[:4] for q in prefix.tolist()])
        i, j = pivots.linked(x[rows], prefix[rows], x[rows], prefix[rows], p, 3, 0.5, True)
        met.update(zip(rows[i].tolist(), rows[j].tolist()))
    assert met == Counter({(i, j): 1 for i in range(60) for j in range(i + 1, 60) if len(set(prefix[i]) & set(prefix[j])) >= 3})


def test_pivot_index_equals_sql(spark):
    same_as_sql(spark, "op11_embedding_dedup")


def test_pivot_index_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, 1, [1.0, 2.0]), (3, 1, [1.0, 2.0]), (9, 1, [2.0, 4.0]), (4, 2, [1.0, 2.0]), (6, None, [1.0, 2.0]), (7, 1, None), (8, 1, []),
            (10, 1, [0.0, 0.0]), (11, 1, [nan, 1.0]), (12, 1, [inf, 1.0]), (13, 1, [None, 1.0]), (14, 1, [1.0, 2.0, 0.0]), (None, 1, [1.0, 2.0]), (15, 1, [-1.0, -2.0])]
    vectors = spark.createDataFrame([(*r, "x", 7) for r in rows], VECTORS + ", node string, m int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.near_duplicates(vectors, 0.93).collect()}
    assert got == {3: (2, 3, True), 5: (2, 3, False), 9: (2, 3, False), None: (0, None, None),
                   **{i: (0, i, True) for i in (4, 6, 7, 8, 10, 11, 12, 13, 14, 15)}} | {None: (0, None, True)}
    assert pivots.near_duplicates(spark.createDataFrame([], VECTORS), 0.93).count() == 0


# --- 12 -----------------------------------------------------------------------

def brute_alignment(texts):
    """Whole texts through both libraries; offsets by the bytes of each token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet, vocab = byte_alphabet(), {i: t for t, i in a.get_vocab().items()}
    a_bytes = lambda i: bytes(alphabet[c] for c in vocab[i])
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, linked_in = [], defaultdict(set)
    for k, text in enumerate(texts):
        whole = (" " + text).encode() if text else b""
        sides = [(a.encode(" " + text, add_special_tokens=False).ids, a_bytes), (b.encode(text), b_bytes)] if text else [([], a_bytes), ([], b_bytes)]
        sides = [[(i, table(i)) for i in ids] for ids, table in sides]
        if any(b"".join(x for _, x in side) != whole for side in sides):
            sides = [[], []]
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in sides]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for s in (0, 1):
            for (i, _), end in zip(sides[s], ends[s]):
                groups[bisect.bisect_left(cuts, end)][s].append(i)
        links = Counter((x, y) for left, right in groups for x in left for y in right)
        for pair in links:
            linked_in[pair].add(k)
        docs.append((len(sides[0]), len(sides[1]), groups, links))
    count = {pair: len(d) for pair, d in linked_in.items()}
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    for n_a, n_b, groups, links in docs:
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        yield (n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if count[p] == most[p[0]]),
               sum(n * count[p] for p, n in links.items()), sha(text) if text else "")


def odd_texts():
    r = random.Random(5)
    parts = ["née", "漢字かな", "😀👩‍👩‍👧", " ", "\t\n", "   ", "▁", "<s>", "</s>", "<|endoftext|>", "<0x41>", "́", "\U0002F9F4", "don't", "x" * 40, "​", "\r\n ", "12,345.67",
             "\x00", "\x1c", "\x85", "ſ", "", "नमस्ते", "ﬁ", "½", " ' s", "a  b", "؟", "﻿"]
    yield from ["", " ", "  ", "\n", "a", " a ", "a ", "▁", "a▁b c", "\x85 x", "x\x1c y"]
    for _ in range(300):
        yield "".join(r.choice(parts) + r.choice(["", " ", "  ", "\n"]) for _ in range(r.randint(1, 12)))


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 2000)
    texts = list(odd_texts())
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in alignment.digests(documents(spark, *texts), A, B).collect()}
    want = list(brute_alignment(texts))
    assert [got[k] for k in range(len(texts))] == want
    assert sum(w[0] == 0 for w in want) > 10 and sum(w[2] > 3 for w in want) > 100


def test_alignment_of_the_documents(spark):
    texts = texts_of(spark)
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in queries.op12_alignment(spark, SMALL).collect()}
    assert got == dict(zip(texts, brute_alignment(texts.values())))


def held_bytes(known):
    """Bytes of a memory of segments: strings, index, list and arrays."""
    arrays = [x for v in vars(known).values() for x in (v if isinstance(v, list) else [v]) if isinstance(x, np.ndarray)]
    return sum(map(sys.getsizeof, [*known.index, *known.texts, known.index, known.texts])) + sum(x.nbytes for x in arrays)


def test_memory_of_segments_is_bounded_in_bytes(monkeypatch):
    """Long segments don't fill a worker, what comes again stays, and what was dropped is found again."""
    monkeypatch.setattr(alignment, "REMEMBERED_BYTES", 1 << 20, raising=False)
    r = random.Random(3)
    word = lambda n: "".join(r.choices("abcdeéß漢字", k=n))
    common = [word(6) for _ in range(50)]
    chunks = [[" ".join([*common, *(word(r.randint(1, 400)) for _ in range(300))]) for _ in range(2)] for _ in range(25)]
    known = alignment.segments.__wrapped__(A, B)
    most, texts = 0, []
    for chunk in chunks + chunks[:2]:
        places = known.places(chunk)
        most = max(most, held_bytes(known))
        texts.append([";".join(known.texts[k] for k in p.tolist()) for p in places])
    assert most < 4 << 20
    assert all(" " + w in known.index for w in common)
    assert texts[25:] == texts[:2]
    monkeypatch.setattr(alignment, "REMEMBERED_BYTES", 64 << 20, raising=False)
    for spans in (True, False):  # a thinned memory has what an unthinned one has
        some, whole = alignment.Segments(A, B, spans), alignment.Segments(A, B, spans)
        some.places(chunks[0]), some.places([chunks[0][1]]), whole.places([chunks[0][1]])
        some.thin()
        assert 0 < len(some.index) == len(whole.index)
        for name, k in whole.index.items():
            j = some.index[name]
            assert some.texts[j] == whole.texts[k] and some.counts[j].tolist() == whole.counts[k].tolist()
            for kind, columns in enumerate([("ids", "ends"), ("ids", "ends"), ("pairs", "times")]):
                for c in columns if spans or kind == 2 else ():
                    x, y = (getattr(m, c) if kind == 2 else getattr(m, c)[kind] for m in (some, whole))
                    assert x[some.starts[kind][j]:some.starts[kind][j + 1]].tolist() == y[whole.starts[kind][k]:whole.starts[kind][k + 1]].tolist()


def test_chunk_rows_are_smaller_than_their_texts(spark, monkeypatch):
    """What an executor holds of a chunk on the way to the scores and back."""
    kept = {}
    monkeypatch.setattr(alignment, "written", lambda df, name, f=alignment.written: kept.setdefault(name, f(df, name)))
    queries.op12_alignment(spark, SMALL).count()
    assert kept["aligned"].toArrow().nbytes < sum(len(t.encode()) for t in texts_of(spark).values())


def test_scores_need_no_segments():
    alignment.segments(A, B)
    assert alignment.segments.cache_info().currsize == 1
    assert list(alignment._score_rows(iter([]))) == []
    assert alignment.segments.cache_info().currsize == 0


@pytest.mark.parametrize("bits", [(5, 20), (20, 45), (1, 62), (31, 31)])
def test_sums_of_equal_owners_and_keys(bits):
    r = np.random.default_rng(6)
    some = [r.integers(0, 1 << b, 20) for b in bits]
    rows = np.stack([*(np.r_[x[r.integers(0, 20, 2000)], (1 << b) - 1, 0] for x, b in zip(some, bits)), r.integers(1, 1 << 40, 2002)])
    want = Counter()
    for owner, key, n in rows.T.tolist():
        want[owner, key] += n
    assert alignment._summed(rows).T.tolist() == [[*k, n] for k, n in sorted(want.items())]
    assert alignment._summed(rows[:, :0]).shape == (3, 0)


@pytest.mark.parametrize("most", [0, 1, 255, 256, 65_536, 1 << 32, (1 << 63) - 1])
def test_packed_numbers_come_back(most):
    x = np.array([most, 0, most // 2, 3 % (most + 1)], np.int64)
    assert alignment._unpacked(alignment._packed(x), 4).tolist() == x.tolist()
    assert alignment._unpacked(alignment._packed(x[:0]), 0).tolist() == []


def test_alignment_edges(spark):
    rows = alignment.digests(edge_documents(spark), A, B).collect()
    assert len(rows) == 10 and [r.doc_id for r in rows].count(None) == 1 and [r.doc_id for r in rows].count(8) == 2
    by = {r.doc_id: r for r in rows}
    assert tuple(by[1])[1:] == tuple(by[2])[1:] == (0, 0, 0, 0, 0, 0, "")
    assert tuple(by[4])[1:] == tuple(by[5])[1:] and by[4].count_sum == 3 and by[6].n_a > 40_000
    assert alignment.digests(no_documents(spark), A, B).count() == 0
    long = alignment.align(documents(spark, " " * 500_000, "a" * 300_000), A, B).collect()
    assert all(r.n_groups > 0 and len(r.groups.split(";")) == r.n_groups for r in long)


def test_spans_cover_the_text(spark):
    texts = ["née 😀\U0002F9F4 x", "▁", None, "plain words here"]
    for r in alignment.spans(documents(spark, *texts), A, B).orderBy("doc_id").collect():
        text = texts[r.doc_id]
        for ids, ends in ((r.a_ids, r.a_ends), (r.b_ids, r.b_ends)):
            assert len(ids) == len(ends) and ends == sorted(set(ends))
            assert (ends or [0])[-1] == (len((" " + text).encode()) if text and text != "▁" else 0)


def test_large_groups_are_laid_out_in_slices(monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 7)
    r = np.random.default_rng(0)
    a, b = r.integers(0, 5, 40), r.integers(0, 6, 50)
    ga, gb, of = np.sort(r.integers(0, 4, 40)), np.sort(r.integers(0, 4, 50)), np.array([0, 0, 1, 1])
    want = Counter((int(of[x]), int(i), int(j)) for x, i in zip(ga, a) for y, j in zip(gb, b) if x == y)
    got = zip(*(z.tolist() for z in alignment.Segments._pairs([ga, gb], a, b, of)))
    assert {(s, p >> 32, p & 0xFFFFFFFF): n for s, p, n in got} == want


# --- 13 -----------------------------------------------------------------------

def brute_manifest(rows, more=lambda r: r):
    """rows (doc_id, source, lang, n_chars, text) -> result rows of op13, in order of language and id."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(field, r)))

    def tree(nodes):
        """Root and each leaf's (left, right) steps."""
        steps, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, place in enumerate(at):
                pair = nodes[place // 2 * 2:place // 2 * 2 + 2]
                steps[k].append((pair[0] if place % 2 else "", pair[1] if not place % 2 and len(pair) == 2 else ""))
                at[k] = place // 2
            nodes = [sha("".join(nodes[k:k + 2])) for k in range(0, len(nodes), 2)]
        return nodes[0], steps

    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in order:
        langs[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[x] = tree([leaf(r) for r in langs[x]])
    root, upper = tree([trees[x][0] for x in order]) if order else (None, [])
    for x, above in zip(order, upper):
        for r, own in zip(langs[x], trees[x][1]):
            steps, h = own + above, leaf(more(r))
            for left, right in steps:
                h = sha(left + h + right)
            yield r[0], leaf(r), trees[x][0], root, sha("".join(a + b for a, b in steps)), h, h == root


def tampered(r):
    if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
        return (*r[:3], r[3] + 1, r[4])
    return r


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("bits", [10, 2])
def test_merkle_equals_brute_force(spark, monkeypatch, bits, tmp_path):
    monkeypatch.setattr(merkle, "BLOCK_BITS", bits)
    r = random.Random(bits)
    sizes = {"en": 70, "dé": 17, "de": 16, "z": 1, None: 7, "": 3, "漢": 2}
    rows = [(k * 3 % 1009 - 50, r.choice(["web", None, ""]), lang, r.choice([None, 0, 10**6]), r.choice([None, "", "née 😀", "t" * k]))
            for k, lang in enumerate([x for x, n in sizes.items() for _ in range(n)])]
    rows += [(None, None, None, None, None), (None, "a", "en", 1, "x")]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    spark.createDataFrame([(*x, "y", 1) for x in rows], schema + ", leaf string, pos int").write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(x[c] for c in COLUMNS) for x in queries.op13_merkle(spark, str(tmp_path)).collect())
    assert got == Counter(brute_manifest(rows, tampered))
    assert 0 < sum(not x[-1] for x in got) < len(rows) / 3


def test_merkle_equals_sql(spark):
    same_as_sql(spark, "op13_merkle")


def test_merkle_edges(spark):
    docs = edge_documents(spark).withColumns({"source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    rows = [(x.doc_id, x.source, x.lang, x.n_chars, x.text) for x in docs.collect()]
    done = merkle.manifest(docs, "lang", ["doc_id"], queries.LEAF_COLUMNS)
    got = Counter((x.doc_id, x.leaf, x.subroot, x.root, x.h == x.root) for x in done.withColumn("h", merkle.fold(F.col("leaf"), F.col("steps"))).collect())
    assert got == Counter((a, b, c, d, True) for a, b, c, d, *_ in brute_manifest(rows))
    assert merkle.manifest(docs.where("false"), "lang", ["doc_id"], queries.LEAF_COLUMNS).count() == 0
    one = merkle.manifest(docs.where("doc_id = 4"), "lang", ["doc_id"], queries.LEAF_COLUMNS).first()
    assert one.leaf == one.subroot == one.root and one.steps == []
