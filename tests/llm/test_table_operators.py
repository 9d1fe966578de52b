import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import components, embeddings, hnsw, packing, rans, separators, sharding, tokens
from ledgerloom.llm.scratch import Scratch
from ledgerloom.session import scratch_path

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
ODD = ["", None, "a  b", "a \n b\n\n", " lead", "trail ", "\ttab\x0b\x0cx", "x  y", "é ́ a", "A\x1cB", "don't 's  't. a,", "<|endoftext|> a",
       "ΣΑΣ ΣΑΣ.", "x" * 300 + " " + "y z" * 40, "\n", "a\n\nb", "a\n b", "a \nb", "中文 字", "12 345", " ", "a.b,c. d!. e.", "x~y ~ z", "é. è, ñ."]


def plain_ids(name, texts, end):
    found = tokens.encoder(tokens.tokenizer_path(name)).tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [x.ids + [end] for x in found]


@pytest.fixture(scope="module")
def texts(corpus):
    return ODD + [t for _, t in corpus]


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_ids_are_those_of_the_library(texts, name, monkeypatch):
    import pyarrow as pa
    path = tokens.tokenizer_path(name)
    for most in (1_000_000, 50):
        monkeypatch.setattr(tokens, "MOST_SEGMENTS", most)
        ids, n = tokens.ids_of(path, pa.array(texts), 7)
        ends = np.cumsum(n)
        assert [ids[b - k:b].tolist() for b, k in zip(ends, n)] == plain_ids(name, texts, 7)


def test_rans_round_trip():
    rng = np.random.default_rng(1)
    for counts in ([5], [1, 1], [10**6, 1, 0, 3], rng.zipf(1.3, 3000) % 10**6):
        counts = np.array(counts)
        table = rans.Table.of(rans.quantise(counts))
        assert table.freq.sum() == 1 << rans.SCALE
        ids = rng.choice(np.flatnonzero(counts), rans.LANES * 3 * 4).astype(np.uint32).reshape(3, -1)
        coded = rans.encode_blocks(ids, table)
        assert (rans.decode_blocks(coded, ids.shape[1], table) == ids).all()
        with pytest.raises(Exception):
            assert (rans.decode_blocks([coded[0][:-4], *coded[1:]], ids.shape[1], table) == ids).all()


def test_token_files(spark, frame, texts, monkeypatch):
    rows = [(3 * k, t) for k, t in enumerate(texts)] + [(None, "no id"), (6, "twice"), (6, "twice")]
    want = sorted(((d is not None, d or 0), i) for (d, _), i in zip(rows, plain_ids(WORD, [t for _, t in rows], 2)))
    manifest = rans.write_token_files(frame(rows), scratch_path(spark, "files"), WORD, 2)
    got = sorted(rans.read_token_files(spark, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d if known else None for (known, d), _ in want]
    at = 0
    for r, (_, ids) in zip(got, sorted(want, key=lambda x: x[0])):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((d if known else None, np.array(i, "<u4").tobytes()) for (known, d), i in want)


def test_token_files_of_many_blocks(spark, frame, monkeypatch):
    texts = [" ".join(f"w{(k * 7919 + i * i) % 977}" for i in range(900)) for k in range(250)]
    manifest = rans.write_token_files(frame(list(enumerate(texts))), scratch_path(spark, "files"), WORD, 2)
    assert manifest.agg(F.sum("blocks")).first()[0] > 4
    want = [brute.crc_ids(i) for i in plain_ids(WORD, texts, 2)]
    got = rans.read_token_files(spark, manifest).select("doc_id", F.crc32("ids").alias("c")).collect()
    assert {r.doc_id: r.c for r in got} == dict(enumerate(want))


def test_damaged_token_files_are_noticed(spark, frame):
    manifest = rans.write_token_files(frame([(1, "some words here")]), scratch_path(spark, "files"), WORD, 2)
    name = manifest.first().file.removeprefix("file://")
    with open(name, "r+b") as f:
        f.seek(20)
        f.write(b"\xff\xff")
    with pytest.raises(Exception, match="damaged"):
        rans.read_token_files(spark, manifest).collect()
    assert rans.read_token_files(spark, rans.write_token_files(frame([]), scratch_path(spark, "files"), WORD, 2)).count() == 0


def test_packing(frame, texts):
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (5, ODD[5])]
    ids = {}
    for (d, _), i in zip(rows, plain_ids(BYTE, [t for _, t in rows], 0)):
        ids[d] = i
    got = packing.pack(frame(rows), BYTE, 0, 64).collect()
    at = 0
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert 64 * r.sequence_id + r.offset == at and r.offset + r.length <= 64
        at += r.length
        assert r.doc_tokens == len(ids[r.doc_id]) and brute.crc_ids(ids[r.doc_id][r.start:r.start + r.length]) == r.ids_crc32
    assert at == sum(len(i) for i in ids.values()) + len(ids[5])
    assert packing.pack(frame([]), BYTE, 0).count() == 0


def test_hilbert_neighbours_touch():
    side = np.arange(8)
    cube = np.array(np.meshgrid(side, side, side)).reshape(3, -1).T
    key = packing.hilbert(cube, 3)
    assert sorted(key) == list(range(512))
    path = cube[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_separator_scan(frame, texts, block):
    rows = [(k, t) for k, t in enumerate(texts[:60])] + [(None, "no id"), (5, "again")]
    want = Counter((d, len(i)) for (d, _), i in zip(rows, plain_ids(BYTE, [t for _, t in rows], 50256)))
    assert Counter(tuple(r) for r in separators.count_tokens(frame(rows), BYTE, 50256, block).collect()) == want
    assert separators.count_tokens(frame([]), BYTE, 50256, block).count() == 0


def test_separator_scan_of_a_file_without_a_last_end(spark):
    from ledgerloom.llm import files
    scratch = Scratch(spark, "flat")
    name = files.new_name(scratch.path("flat"), "part", "ids")
    with files.writing(name) as out:
        out.write(np.array([4, 9, 9, 1, 2, 3, 4, 5, 9, 6, 6], "<u2").tobytes())
    found = separators.scan_documents(spark, spark.createDataFrame([(name,)], "file string"), scratch, np.dtype("<u2"), 9, 2)
    assert sorted(tuple(r)[1:] for r in found.collect()) == [(0, 0, 2), (1, 2, 1), (2, 3, 6), (3, 9, 2)]


def test_shards(frame, corpus):
    rows = corpus + [(None, "no id"), (5, "twice"), (5, "twice")]
    got = sharding.shard(frame(rows), 4, ranges=16).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    for slots in brute.groups((r.shard, r.slot) for r in got).values():
        assert sorted(slots) == list(range(len(slots)))
    assert all(len(set(s)) == 1 for s in brute.groups((r.text_crc32, r.shard) for r in got).values())
    total = Counter()
    for r in got:
        total[r.shard] += r["size"]
    assert max(total.values()) - min(total.values()) <= max(r["size"] for r in got)
    assert sharding.shard(frame([]), 4).count() == 0


def test_shards_split_a_giant_group(frame):
    rows = [(k, "same text " * 5) for k in range(600)] + [(1000 + k, f"text {k} " * 6) for k in range(400)]
    got = sharding.shard(frame(rows), 4).collect()
    total = Counter()
    for r in got:
        total[r.shard] += r["size"]
    assert max(total.values()) / min(total.values()) < 1.05


def clusters(rng, groups, size, dim=16):
    out = []
    for _ in range(groups):
        centre = rng.normal(size=dim)
        out += [centre + rng.normal(size=dim) * 0.09 * np.linalg.norm(centre) / np.sqrt(dim) * rng.uniform(0, 3) for _ in range(size)]
    return out


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(clusters(rng, 40, 6) + list(rng.normal(size=(120, 16))))]
    rows += [(900 + k, rows[k][1]) for k in range(5)] + [(950, [2 * x for x in rows[3][1]])]
    rows += [(960, None), (961, []), (962, [0.0] * 16), (963, [float("nan")] * 16), (964, [1.0, None]), (965, [1.0, 2.0]), (966, [1.0, 2.0]),
             (967, [float("inf")] + [0.0] * 15), (968, [1e-3, 2e-3])]
    order = rng.permutation(len(rows))
    frame = spark.createDataFrame([(*rows[i], 3, "x") for i in order], "vec_id long, embedding array<float>, n_links int, component_id string")
    want = brute.near([(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 0.95)
    got = embeddings.near_vectors(frame).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_near_vectors_odd_rows(spark):
    kind = "vec_id long, embedding array<float>"
    got = embeddings.near_vectors(spark.createDataFrame([(None, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (4, [1.0, 0.01])], kind)).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id) for r in got) == [(-1, 0, None), (2, 2, 2), (2, 2, 2), (4, 2, 2)]
    assert embeddings.near_vectors(spark.createDataFrame([], kind)).count() == 0


def test_near_vectors_shuffle_no_graphs(spark, monkeypatch):
    """Rows of a shard's graph name its file; with the graph in them each block of queries would shuffle it again."""
    kept, keep = {}, embeddings.Scratch.keep

    def held(self, df, label, *more):
        kept[label] = keep(self, df, label, *more)
        return kept[label]
    monkeypatch.setattr(embeddings.Scratch, "keep", held)
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 100)
    rows = [(k, v.tolist()) for k, v in enumerate(np.random.default_rng(5).normal(size=(400, 8)))]
    assert embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.999, shards=2).count() == 400
    graphs = kept["graphs"].collect()
    assert len(graphs) == 2 and all(len(str(tuple(r))) < 1000 for r in graphs)
    assert sum(len(embeddings._read(r["file"])[0]) for r in graphs) == 400


def test_graph_recall_and_widening():
    rng = np.random.default_rng(2)
    raw = np.array(clusters(rng, 12, 150, 32))
    raw = raw[rng.permutation(len(raw))]
    unit = (raw / np.linalg.norm(raw, axis=1, keepdims=True)).astype(np.float32)
    graph = hnsw.build(unit, rng.uniform(1e-9, 1, len(unit)))
    norm = np.linalg.norm(raw, axis=1)
    exact = embeddings._exact(raw, norm, raw, 0.95)
    found = embeddings._found(graph, raw, norm, raw, unit, 0.95, embeddings.BEAMS)
    want, got = set(zip(*map(np.ndarray.tolist, exact))), list(zip(*map(np.ndarray.tolist, found)))
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want)
    query = (lambda q: (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32))(raw[::9] + rng.normal(size=(len(raw[::9]), 32)) * 0.05)
    best = np.argmax(query @ unit.T, 1)
    assert (graph.search(query, 24)[0][:, 0] == best).mean() >= 0.9


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [tuple(map(int, x)) for x in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5000 + k) for k in range(200)]
    frame = spark.createDataFrame(links + [(None, 3), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(frame, Scratch(spark, "t")).collect()}
    want = brute.roots({x for e in links for x in e if e[0] != e[1]}, [e for e in links if e[0] != e[1]])
    assert got == want
    assert components.components(frame.limit(0), Scratch(spark, "t")).count() == 0


def test_near_vectors_widens_beams_for_sparse_pairs(spark, monkeypatch):
    """Narrow beams, few links: the links of a vector with itself say nothing about the others."""
    monkeypatch.setattr(embeddings, "BEAMS", (2, 3))
    rng = np.random.default_rng(6)
    raw = rng.normal(size=(3000, 48))
    near, aside = raw[:150], rng.normal(size=(150, 48))
    aside -= (aside * near).sum(1, keepdims=True) / (near * near).sum(1, keepdims=True) * near
    aside *= np.linalg.norm(near, axis=1, keepdims=True) / np.linalg.norm(aside, axis=1, keepdims=True)
    raw[150:300] = 0.955 * near + np.sqrt(1 - 0.955 ** 2) * aside
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(raw)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(frame, shards=4).collect()}
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    assert want.sum() == 300 and all(got[k] <= want[k] for k in got)
    assert sum(got.values()) >= embeddings.RECALL * want.sum()


def test_written_shards_hold_every_row_once(spark, frame):
    rows = [(None, "no id"), (None, "none"), (5, "twice"), (5, "twice"), (5, "other"), *((10 + k, f"text {k}") for k in range(20)), (None, None)]
    folder = scratch_path(spark, "shards")
    sharding.write_shards(frame(rows), folder, 3)
    got = spark.read.parquet(folder).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    for slots in brute.groups((r.shard, r.slot) for r in got).values():
        assert sorted(slots) == list(range(len(slots)))
