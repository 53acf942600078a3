"""Each operator against a brute-force version on documents with odd rows."""

import base64
import hashlib
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from helpers import DOCS, near_by_force, odd_documents, slow_tiles, words_of, write_tables
from tokenizers import Tokenizer

from palimpsest.llm import decontaminate
from palimpsest.llm.byte_bpe import bpe_of, decode_ids, default_vocabulary, encode_texts, op10_byte_bpe
from palimpsest.llm.decontaminate import contaminated, tiles
from palimpsest.llm.embedding_dup import near_vectors, op9_embedding_dedup
from palimpsest.llm.line_dedup import OP5_SQL, dedup_lines, op5_line_dedup
from palimpsest.llm.near_dup import MISS, near_duplicates, op3_minhash_dedup, trees_for
from palimpsest.llm.substring_dedup import dedup_substrings, hash_bits, op7_substring_dedup
from palimpsest.llm.token_file import EliasFano, TokenFile, export_files, json_encoder, op8_token_file, read_token_files, write_token_files


@pytest.fixture(scope="module")
def rows():
    return odd_documents()


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    df = spark.createDataFrame(rows, DOCS)
    return write_tables(spark, tmp_path_factory.mktemp("docs"), documents=df)


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def test_lines_like_sql(spark, folder):
    got = sorted(map(tuple, op5_line_dedup(spark, folder).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = sorted(con.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({OP5_SQL})").fetchall())
    assert got == want and any(r[2] for r in got)


def test_lines_do_not_depend_on_batches(spark, rows):
    df = spark.createDataFrame(rows, DOCS).select("doc_id", "text")
    one, many = (sorted(map(tuple, dedup_lines(df, batches=b, fanout=2).collect())) for b in (1, 7))
    assert one == many


def test_near_duplicates(spark, rows, folder):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op3_minhash_dedup(spark, folder).collect()}
    want = near_by_force([(r[0], r[1]) for r in rows], 3, 85, 100)
    assert got == want and sum(not kept for *_, kept in got.values()) > 3


def test_near_duplicates_with_small_limits(spark, rows):
    """Nodes that branch, and clusters of many blocks."""
    base = rows[3][1].split(" ") * 2
    texts = [(1000 + k, " ".join(base[: 120 + k])) for k in range(14)] + [(r[0], r[1]) for r in rows[:20]]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, trees=16, node_limit=3, block_bytes=4000).collect()}
    assert got == near_by_force(texts, 5, 80, 100)


def hot_template(n, distinct, seed):
    """Texts that share a template, each with words of its own, and for each third one a near copy just above 0.85, while others are just below."""
    rng = np.random.default_rng(seed)
    template = [f"t{k}" for k in range(200)]
    texts = []
    for i in range(n):
        own = [f"d{i}x{k}" for k in range(distinct)]
        texts.append((i, " ".join(template + own)))
        if i % 3 == 0:
            for k in range(int(rng.integers(1, 5)), distinct, 4):
                own[k] = f"e{i}y{k}"
            texts.append((n + i, " ".join(template + own)))
    return texts


def test_trees_meet_the_target():
    for share in (0.5, 0.8, 0.85, 0.99, 1.0):
        for steps in (1, 2, 3, 6):
            assert (1 - share**steps) ** trees_for(share, steps) <= MISS


def test_near_duplicates_under_a_hot_template(spark):
    """Pairs within a group of look-alikes below the threshold that no token divides: all nodes crowded, one large cluster of many blocks."""
    texts = hot_template(400, 21, 1)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, shingle=3, share=(85, 100), node_limit=16, block_bytes=16 << 10).collect()}
    want = near_by_force(texts, 3, 85, 100)
    assert sum(not k for *_, k in want.values()) == 134
    assert got == want


def test_near_duplicates_of_deep_nodes(spark):
    """Pairs at 0.85 to 0.9 in nodes six steps deep: the trees follow from the steps."""
    rng = np.random.default_rng(21)
    texts = []
    for i in range(300):
        own = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
        other = list(own)
        for k in rng.choice(118, 2, replace=False):
            other[k] = f"e{i}x{k}"  # up to six of 118 shingles on either side
        texts += [(i, " ".join(own)), (1000 + i, " ".join(other))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, shingle=3, share=(85, 100), node_limit=1, steps=6).collect()}
    want = near_by_force(texts, 3, 85, 100)
    pairs = [i for i in range(300) if not want[1000 + i][2]]
    found = sum(got[1000 + i] == want[1000 + i] for i in pairs)
    assert len(pairs) > 250 and found >= 0.99 * len(pairs)
    assert all(got[i][1] in (i, want[i][1]) for i in got)  # nothing but real links


def test_near_duplicates_of_one_great_cluster(spark):
    """10,000 distinct look-alikes, more than a node or a block holds, against all pairs."""
    rng = np.random.default_rng(22)
    n, size = 10_000, 40
    base = [f"b{k}" for k in range(size)]
    texts = []
    for i in range(n):
        own = list(base)
        for k in rng.choice(size, int(rng.integers(1, 5)), replace=False):
            own[k] = f"o{int(rng.integers(30))}x{k}"
        texts.append((i, " ".join(own)))
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), shingle=1, share=(90, 100), node_limit=1000, block_bytes=100_000).collect()}
    names = {w: k for k, w in enumerate(sorted({w for _, t in texts for w in t.split()}))}
    held = np.zeros((n, len(names)), np.float32)
    for i, t in texts:
        held[i, [names[w] for w in t.split()]] = 1
    label = np.arange(n)
    for i in range(n):
        both = held[i:] @ held[i]
        linked = i + np.flatnonzero(100 * both >= 90 * (2 * size - both))
        groups = np.unique(label[linked])
        if len(groups) > 1:
            label[np.isin(label, groups)] = groups[0]
    assert {i: int(label[i]) for i in range(n)} == {i: c for i, (c, _) in got.items()} and len(np.unique(label)) > 5


def test_near_duplicates_in_a_chain(spark):
    """Successive revisions, each linked only with the next, whose ids rise."""
    texts = [(i, " ".join(f"r{i + k}" for k in range(40))) for i in range(1500)]
    got = near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), shingle=1, share=(95, 100))
    assert got.count() == 1500 and got.where("component_id <> 0").count() == 0


def test_substrings(spark, rows, folder):
    window = 35
    counts = Counter()
    for r in rows:
        w = words_of(r[1])
        counts.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    want = {}
    for r in rows:
        w = words_of(r[1])
        gone = set()
        for k in range(len(w) - window + 1):
            if counts[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        want[r[0]] = (len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))
    assert {r.doc_id: tuple(r)[1:] for r in op7_substring_dedup(spark, folder).collect()} == want
    assert sum(n for _, n, _ in want.values()) > 500


def test_hash_bits():
    for doublings in (1, 20, 32, 38):
        anchor, more = hash_bits((1 << doublings) - 1)
        assert anchor >= doublings + 10 and 64 + more >= 2 * doublings + 20
    assert hash_bits(1 << 60) == (64, 32)


@pytest.mark.parametrize("window", [1, 5, 8, 18, 60])
def test_substrings_of_any_window(spark, window):
    texts = [(1, "a b c d e f g h i j " * 7), (2, "x a b c d e f g h"), (3, None), (4, "z")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    counts = Counter()
    for _, t in texts:
        w = words_of(t)
        counts.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    for r in dedup_substrings(df, window, shard_bytes=40).collect():
        w = words_of(dict(texts)[r.doc_id])
        gone = {j for k in range(len(w) - window + 1) if counts[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        assert (r.n_words, r.n_removed, r.kept_text.encode()) == (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone))


@pytest.mark.parametrize("places", [1 << 20, 12])
def test_tiles_like_their_definition(monkeypatch, places):
    monkeypatch.setattr(decontaminate, "_PLACES", places)
    rng = np.random.default_rng(3)
    for _ in range(400):
        a, b = rng.integers(0, 4, rng.integers(1, 13)), rng.integers(0, 4, rng.integers(0, 17))
        assert tiles(a.astype(np.uint64), b.astype(np.uint64), 3) == slow_tiles(a.tolist(), b.tolist(), 3)


def test_tiles_of_one_long_repetition():
    """Every place of the item meets every place of the text: 60 million pairs, none of them written out."""
    tracemalloc.start()
    laid = tiles(np.zeros(1000, np.uint64), np.zeros(60_000, np.uint64), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert laid == [(0, 0, 1000)] and peak < 200 << 20


def test_decontamination(spark):
    item = "Alpha beta gamma delta epsilon, zeta eta theta iota kappa; lambda mu nu xi omicron."
    w = item.split(" ")
    docs = [
        (1, "before " + item.upper() + " after"),
        (2, " ".join(w[8:] + ["and", "then"] + w[:8])),  # reordered
        (3, " ".join(w[:8])),  # half of it
        (4, "clean text with alpha beta gamma only"),
        (5, None),
        (6, ""),
        (7, ("filler words " * 9000) + item),
        (8, "tiny item"),
        (None, item),
    ]
    bench = spark.createDataFrame([(10, item), (10, item), (11, "tiny item"), (12, None), (13, ""), (None, "clean text with alpha")], "item_id long, text string")
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted(((r.doc_id is None, r.doc_id), r.item_id) for r in got) == [((False, 1), 10), ((False, 2), 10), ((False, 7), 10), ((False, 8), 11), ((True, None), 10)]
    assert {r.doc_id: r.n_tiles for r in got}[2] == 2
    blocks = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench, block_bytes=1).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, got))


def test_decontamination_like_its_definition(spark):
    """All pairs of short items and documents, with pieces of items reordered and words changed."""
    rng = np.random.default_rng(9)
    items = [(i, [f"w{x}" for x in rng.integers(0, 40 if i % 2 else 8, rng.integers(1, 24))]) for i in range(60)]
    docs = []
    for i in range(300):
        w = list(items[int(rng.integers(len(items)))][1])
        if i % 3 == 0:  # pieces of three or four words, in any order
            step = int(rng.integers(3, 5))
            pieces = [w[k : k + step] for k in range(0, len(w), step)]
            w = [x for k in rng.permutation(len(pieces)) for x in [*pieces[k], "and"]]
        if i % 3 == 1:  # every fifth word changed, or the middle one
            for k in range(4, len(w), 5) if i % 2 else [len(w) // 2]:
                w[k] = "other"
        docs.append((i, ["before", *w, "after"]))
    got = contaminated(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    want = set()
    for i, text in docs:
        for name, item in items:
            if len(set(item) & set(text)) and sum(w in set(text) for w in item) >= 0.8 * len(item):
                laid = slow_tiles(item, text, 3)
                if (n := sum(x[2] for x in laid)) >= 0.8 * len(item):
                    want.add((i, name, len(item), n, len(laid)))
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want) > 200


@pytest.fixture(scope="module")
def encoders():
    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return hf, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_token_files(spark, rows, folder, encoders, tmp_path):
    start, want = 0, {}
    for r in sorted(rows):
        ids = np.array([*encoders[0].encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want[r[0]] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: tuple(r)[1:] for r in op8_token_file(spark, folder).collect()} == want
    files = write_token_files(spark.read.parquet(f"{folder}/documents.parquet"), file_ids=2000)
    assert {r.doc_id: tuple(r)[1:] for r in read_token_files(files).collect()} == want
    paths = export_files(files, str(tmp_path))
    assert len(paths) == files.count() > 5
    file = TokenFile(open(sorted(paths)[0], "rb").read())
    assert file.doc_ids[0] == -3 and len(file.document(0)) == want[-3][1]


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, high in [(0, 1), (1, 5), (300, 10), (1000, 10**6), (700, 2**62)]:
        values = np.sort(rng.integers(-high, high, n))
        back = EliasFano.from_bytes(EliasFano.encode(values).to_bytes())
        assert (back.values() == values).all() and all(back[i] == values[i] for i in range(n))
    dense = EliasFano.encode(np.arange(0, 10**6, 100))
    assert len(dense.to_bytes()) < 10**4 * 9 / 8 + 500
    with pytest.raises(IndexError):
        dense[10**4]


def test_elias_fano_blocks():
    rng = np.random.default_rng(2)
    for n, high in [(1, 5), (256, 3), (257, 10**4), (300, 10), (1000, 10**6), (700, 2**62), (2000, 1)]:
        values = np.sort(rng.integers(-high, high, n))
        back = EliasFano.from_bytes(EliasFano.encode(values).to_bytes())
        blocks = list(back.blocks())
        assert [len(b) for b in blocks[:-1]] == [256] * (len(blocks) - 1) and (np.concatenate(blocks) == values).all()
    assert list(EliasFano.encode(np.zeros(0, np.int64)).blocks()) == []


def test_encoders_on_random_texts(encoders):
    """White space of every kind, marks, scripts, controls; texts alone and many at once."""
    rng = np.random.default_rng(9)
    spaces = [9, 10, 13, 32, 32, 32, 0x1C, 0x1D, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x3000]
    others = [0x200B, 0x200D, 0xFEFF, 0x7F, 0, 0xE9, 0x65E5, 0x1F64F, 0x663, *map(ord, "ab'streLL12!?.,-")]
    letters = [chr(x) for x in spaces + others]
    letters += ["<|endoftext|>", "<|end", "oftext|>"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(3000)] + ["", None, " a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>"]
    bpe = bpe_of(*default_vocabulary())
    encode, _ = json_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    array = pa.array(texts, pa.string())
    for text, ids, others_ids in zip(texts, bpe.encode_many(array), encode(array), strict=True):
        assert ids.tolist() == encoders[1].encode_ordinary(text or ""), repr(text)
        assert others_ids.tolist() == encoders[0].encode(text or "", add_special_tokens=False).ids, repr(text)
        assert bpe.encode(text or "") == ids.tobytes() and bpe.decode(ids.tobytes()) == (text or "").encode()
    part = array.slice(7, 50)
    assert [x.tolist() for x in bpe.encode_many(part)] == [encoders[1].encode_ordinary(t or "") for t in part.to_pylist()]


def test_byte_bpe(spark, rows, folder, encoders):
    want = {}
    for r in rows:
        ids = np.array(encoders[1].encode_ordinary(r[1] or ""), "<u4").tobytes()
        want[r[0]] = (len(ids) // 4, sha(ids), sha(r[1] or ""))
    assert {r.doc_id: tuple(r)[1:] for r in op10_byte_bpe(spark, folder).collect()} == want
    docs = spark.createDataFrame([("a <|endoftext|> b", "kept"), (None, None)], "text string, n_tokens string")
    got = decode_ids(encode_texts(docs)).collect()
    assert [(r.n_tokens, bytes(r.decoded)) for r in got] == [("kept", b"a <|endoftext|> b"), (None, b"")]


def vector_rows():
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        v = rng.standard_normal(16)
        rows += [(len(rows) + j, [float(x) for x in v + rng.standard_normal(16) * 0.05 * (j > 1)], 0) for j in range(1 + k % 4)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [0.0] * 15, [1.0, 2.0], [1.0, 2.0], [1e300, 1e300], [1e-300, 1e-300]]
    return rows + [(1000 + i, v, i) for i, v in enumerate(odd)]


def vectors_by_force(rows):
    """n_links, component and kept of each id, by comparing all pairs."""
    unit = {}
    for i, v, _ in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.array(v) / np.abs(v).max()
            unit[i] = v / np.linalg.norm(v)
    up = {r[0]: r[0] for r in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = Counter()
    for i in unit:
        for j in unit:
            if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (links[i], root(i), root(i) == i) for i in up}


def test_vectors(spark, tmp_path):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = vectors_by_force(rows)
    got = op9_embedding_dedup(spark, write_tables(spark, tmp_path, embeddings=df))
    assert {r.vec_id: tuple(r)[1:] for r in got.collect()} == want and sum(n for n, *_ in want.values()) > 100
    assert {r.vec_id: tuple(r)[1:] for r in near_vectors(df.unionAll(df)).collect()} == want  # repeated rows


def test_vectors_in_small_blocks(spark):
    """Runs of several blocks, bounds of partitions, and a crowd that fills many blocks, copies included."""
    rng = np.random.default_rng(12)
    rows = [(r[0], r[1], 0) for r in vector_rows() if r[0] < 1000]
    centre = rng.standard_normal(16)
    rows += [(2000 + k, [float(x) for x in centre + rng.standard_normal(16) * 0.12], 0) for k in range(90)]
    rows += [(3000 + k, rows[-1][1], 0) for k in range(5)]
    for kind in ("double", "float"):
        own = [(i, np.array(v, "<f4").astype(float).tolist(), x) for i, v, x in rows] if kind == "float" else rows
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
        want = vectors_by_force(own)
        assert {r.vec_id: tuple(r)[1:] for r in near_vectors(df, block=8, run=2).collect()} == want and max(n for n, *_ in want.values()) > 60


def test_vectors_in_a_chain(spark):
    """Each is linked only with the next, and ids rise."""
    steps = [np.zeros(220) for _ in range(200)]
    for k, v in enumerate(steps):
        v[k : k + 20] = 1  # the next shares 19 of 20
    rows = [(k, v.tolist(), 0) for k, v in enumerate(steps)]
    got = {r.vec_id: tuple(r)[1:] for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=16).collect()}
    assert got == {k: (1 if k in (0, 199) else 2, 0, k == 0) for k in range(200)}


def test_vectors_of_one_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [1.0, 0.1]), (4, [-1.0, 0.0]), (None, [1.0, 0.0])]
    got = {r.vec_id: tuple(r)[1:] for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (1, 1, False), 4: (0, 4, True), None: (0, None, True)}
