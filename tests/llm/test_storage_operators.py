"""Archives, packing, nearest neighbours and id files on small fixtures."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest
from brute import crc
from pyspark.sql import functions as F

from cairn.llm import idfiles, neighbours, packing, warc
from cairn.llm.shared import new_folder
from cairn.llm.tokens import PieceEncoder

tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS = (tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))

TEXTS = ["", "  a  b\n\n c\t d ", "don't  DON'T\n\n\nx", "a\x00b c", "a \nb", "\n", "word. word, word.", "ßé́ x", "Σας ΑΣ 12 345", "<|endoftext|> a", "x" * 5_000, "the cat sat on the mat. " * 400]


def encoded(path, text):
    return PieceEncoder(path).tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_piece_encoder(path):
    rng = random.Random(1)
    parts = ["a", "B", " ", "\n", "\t", "'s", "1", ".", ",", "é", "\xa0", "\x1d", "İ", "Σ", "́", "\x85", " ", "\0"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(1500)]
    e = PieceEncoder(path, limit=5_000, block=2_000)
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        got = [x.tolist() for ids, n in e.encode(pa.array(part)) for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [x.ids for x in e.tokenizer.encode_batch(part, add_special_tokens=False)]
        assert e.words.nbytes + e.ids.nbytes + e.ends.nbytes <= 5_000


# --- best-fit packing ---


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = random.Random(seed)
    cap = rng.choice([16, 64, 100])
    counts = {n: rng.randrange(1, 50) for n in rng.sample(range(1, cap + 1), rng.randrange(1, 14))}
    groups = packing.plan(counts, cap)
    used = {}
    for lengths, n in groups:
        assert n > 0 and sum(lengths) <= cap
        for x in lengths:
            used[x] = used.get(x, 0) + n
    assert used == counts
    total = sum(k * n for k, n in counts.items())
    first_fit = []
    for x in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        at = next((i for i, g in enumerate(first_fit) if g >= x), None)
        first_fit.append(cap - x) if at is None else first_fit.__setitem__(at, first_fit[at] - x)
    assert -(-total // cap) <= sum(n for _, n in groups) <= len(first_fit) + 1


def test_plan_finds_exact_complements():
    assert packing.plan({70: 3, 30: 3}, 100) == [((70, 30), 3)]
    assert packing.plan({60: 2, 25: 2, 15: 2}, 100) == [((60, 25, 15), 2)]
    assert sum(n for _, n in packing.plan({40: 5, 30: 5, 20: 5, 10: 5}, 100)) == 5
    assert packing.plan({}, 100) == []


def test_packing(spark):
    docs = [(i, t) for i, t in enumerate([None, *TEXTS, "the cat", "the cat"])] + [(3, "again")]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, length int").repartition(3)
    got = packing.pack(df, BYTES, capacity=64).toPandas()
    ids = {}
    for d, t in docs:
        ids.setdefault(d, []).append([*encoded(BYTES, t), 2])
    assert got["length"].sum() == sum(len(x) for v in ids.values() for x in v)
    for r in got.itertuples():
        assert r.ids_crc32 in {crc(x[r.start : r.start + r.length]) for x in ids[r.doc_id]}
        assert r.length == 64 or r.piece == 0
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 64
    assert packing.pack(df.limit(0), BYTES).count() == 0


# --- id files ---


def test_perfect_hash():
    keys = np.random.default_rng(1).choice(1 << 40, 20_000, replace=False).astype(np.uint64)
    table = idfiles.PerfectHash.build(keys)
    assert sorted(table.ranks(keys).tolist()) == list(range(len(keys))) and sum(table.sizes) < 6 * len(keys)
    assert idfiles.PerfectHash.build(np.zeros(0, np.uint64)).ranks(np.array([1], np.uint64)).tolist() == [-1]
    with pytest.raises(ValueError):
        idfiles.PerfectHash.build(np.array([7, 7], np.uint64))


def test_id_files(spark):
    docs = [(i * 7 - 20, t) for i, t in enumerate([None, *TEXTS] * 6)] + [(1, "repeated"), (1, "repeated"), (None, "no key")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = idfiles.round_trip(df, WORDS).orderBy("start").collect()
    assert len(got) == len(docs) and [r["doc_id"] for r in got] == sorted((d for d, _ in docs), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    want = sorted((d is not None, d or 0, crc([*encoded(WORDS, t), 2])) for d, t in docs)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids_crc32"]) for r in got) == want
    assert idfiles.round_trip(df.limit(0), WORDS).count() == 0


def test_id_width(spark, tmp_path):
    """An end id beyond 16 bits makes the ids 4 bytes wide."""
    df = spark.createDataFrame([(i, t, 1, b"c") for i, t in enumerate(TEXTS)] + [(3, TEXTS[2], 1, b"c")], "doc_id long, text string, start long, n_tokens binary")
    folder = new_folder(spark, "test-ids")
    shards = idfiles.write_shards(df, folder, WORDS, end_id=70_000, shards=3).collect()
    assert {idfiles.Shard(folder, s["shard"]).width for s in shards} == {4} and idfiles.id_width(WORDS, 2) == 2
    found = {i: x for s in shards for i in range(len(TEXTS)) if (x := idfiles.Shard(folder, s["shard"]).get(i)) is not None}
    assert {i: x.tolist() for i, x in found.items() if i != 3} == {i: [*encoded(WORDS, t), 70_000] for i, t in enumerate(TEXTS) if i != 3}
    got = idfiles.round_trip(df, WORDS, 70_000).filter("doc_id = 3").collect()
    assert sorted(r["ids_crc32"] for r in got) == sorted(crc([*encoded(WORDS, t), 70_000]) for t in (TEXTS[2], TEXTS[3]))


def test_keyed_access(spark):
    folder = new_folder(spark, "test-ids")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    shards = idfiles.write_shards(df, folder, WORDS, shards=2).collect()
    for s in shards:
        shard = idfiles.Shard(folder, s["shard"])
        for i, t in enumerate(TEXTS):
            found = shard.get(i)
            assert (found is not None) == (s["first_doc"] <= i <= s["last_doc"])
            if found is not None:
                assert found.tolist() == [*encoded(WORDS, t), 2]
        assert shard.get(10**12) is None


# --- archives ---

PAGES = [(1, "http://a b/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 300_000), (6, "u", "WARC/1.1\r\nfake\r\n\r\n"), (6, "u", "WARC/1.1\r\nfake\r\n\r\n"), (None, "u", "<p>x</p>"), (9, "u", "<p>x</p>")]


def test_archive_round_trip(spark):
    df = spark.createDataFrame([(*p, 5) for p in PAGES], "page_id long, url string, html string, first int").repartition(3)
    got = sorted(((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()), key=repr)
    first = {}
    for p, _, h in PAGES:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = []
    for p, _, h in PAGES:
        data = (h or "").encode()
        again = p is not None and first[h or ""] < p
        want.append((p or -1, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_pages_of_one_id(spark, broadcast_rows):
    pages = [(1, "u", "copied"), (2, "u", "also copied"), (7, "u", "copied"), (7, "u", "own text"), (8, "u", "copied"), (8, "u", "also copied")]
    folder = new_folder(spark, "test-warc")
    archives = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), folder, broadcast_rows=broadcast_rows)
    got = warc.read_archives(archives, folder).select("record_id", "kind", "refers_to", "payload_bytes").collect()
    first = {"copied": 1, "also copied": 2, "own text": 7}
    want = [(f"<urn:page:{p}>", *(("response", None) if first[h] == p else ("revisit", f"<urn:page:{first[h]}>")), len(h)) for p, _, h in pages]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_a_damaged_round_trip_fails(spark, monkeypatch):
    df = spark.createDataFrame([(1, "u", "some text"), (2, "u", "other text")], "page_id long, url string, html string")
    write = warc.write_archives

    def damaged(*args, **kwargs):
        archives = write(*args, **kwargs)
        fs, root = pyarrow.fs.FileSystem.from_uri(args[1])
        for r in archives.collect():
            with fs.open_output_stream(f"{root}/{r['archive']}", compression=None) as out:
                out.write(b"junk" * 20)
        return archives

    monkeypatch.setattr(warc, "write_archives", damaged)
    with pytest.raises(Exception, match="damaged archive"):
        warc.round_trip(df).collect()


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


def record(i, compress, n=2_000):
    payload = random.Random(i).randbytes(n)
    return warc.record_bytes({"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{i}>", "WARC-Payload-Digest": "sha1:" + warc.payload_digest(payload)}, payload, compress)


def read(data):
    records, gaps = [], []
    for x in warc.Salvage(Bytes(data)):
        records.append(x.headers["warc-record-id"]) if isinstance(x, warc.Record) else gaps.append((x.start, x.end))
    return records, gaps


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(compress):
    parts = [record(i, compress) for i in range(6)]
    ends = np.cumsum([len(p) for p in parts]).tolist()
    names = [f"<urn:page:{i}>" for i in range(6)]
    assert read(b"".join(parts)) == (names, [])
    for broken in range(6):
        hurt = bytearray(b"".join(parts))
        middle = ends[broken] - len(parts[broken]) // 2
        hurt[middle : middle + 40] = b"\x1f\x8b\x08WARC/1.1" * 3 + bytes(7)
        records, gaps = read(bytes(hurt))
        assert records == names[:broken] + names[broken + 1 :] and gaps == [(ends[broken] - len(parts[broken]), ends[broken])]
        cut = b"".join(parts[:broken]) + parts[broken][:-9] + b"".join(parts[broken + 1 :])
        records, gaps = read(cut)
        assert records == names[:broken] + names[broken + 1 :] and len(gaps) == 1
    assert read(b"garbage" + b"".join(parts) + b"tail")[0] == names and read(b"") == ([], []) and read(b"\x1f\x8b\x08") == ([], [(0, 3)])
    mixed = record(0, True) + record(1, False) + gzip.compress(b"no record") + record(2, True)
    assert read(mixed)[0] == names[:3]


def test_salvage_large_and_straddling():
    lead = b"z" * (warc.BLOCK - 3)  # the next lead lies across two blocks
    assert read(lead + record(1, True, 700_000) + record(2, False, 700_000)) == (["<urn:page:1>", "<urn:page:2>"], [(0, len(lead))])


def test_gaps_are_logged(spark):
    folder = new_folder(spark, "test-warc")
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root)
    with fs.open_output_stream(f"{root}/a.warc.gz", compression=None) as out:
        out.write(record(1, True) + b"junk" + record(2, True))
    got = warc.read_archives(spark.createDataFrame([("a.warc.gz",)], "archive string"), folder).orderBy("start").collect()
    assert [(r["gap"] is None, r["record_id"]) for r in got] == [(True, "<urn:page:1>"), (False, None), (True, "<urn:page:2>")]


# --- nearest neighbours ---


def vectors(spark, n=1500, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[rng.integers(0, n, n // 3)] = x[0]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5001, [0.0] * dim), (5002, [float("nan")] * dim), (5003, [float("inf")] + [1.0] * (dim - 1)), (5004, [None] + [1.0] * (dim - 1)), (None, x[1].tolist()), (0, x[0].tolist()), (7000, [1.0, 2.0]), (7100, [1.0, 3.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), rows


@pytest.mark.parametrize("least, most", [(4096, 131_072), (200, 131_072), (200, 300)])
def test_nearest(spark, least, most):
    df, rows = vectors(spark)
    v = neighbours.usable(df)
    index = neighbours.build_index(v, least, most)
    shards = index.filter("dim = 16").count()
    assert shards == {(4096, 131_072): 1, (200, 131_072): 4}.get((least, most), shards) and (most > 300 or shards >= 4)
    got = neighbours.search_index(index, v.filter("vec_id % 100 = 0").dropDuplicates(["vec_id", "v"])).toPandas()
    ids = np.array([i for i, x in rows if i is not None and i < 1500 and x][:1500])
    x = np.array([x for i, x in rows if i is not None and i < 1500 and x][:1500], np.float64)
    hits = total = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [(i, s) for s, i in sorted((s, i) for s, i in zip(d.tolist(), ids.tolist()) if i != q)[:10]]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and q not in mine["vec_id"].tolist()
        assert np.allclose(mine["score"], [d[i] for i in mine["vec_id"]], rtol=1e-12, atol=0)
        pairs = list(zip(mine["score"], mine["vec_id"]))
        assert pairs == sorted(pairs)
        hits += len({i for i, _ in want} & set(mine["vec_id"]))
        total += 10
    assert hits / total >= 0.9
    assert set(got["query_id"]) == {*range(0, 1500, 100), 7000, 7100}
    assert got[got["query_id"] == 7000]["vec_id"].tolist() == [7100]


def test_repeated_rows_take_no_place_of_other_ids(spark):
    ids = spark.range(3000).filter(F.pmod(F.xxhash64("id"), F.lit(64)) == 0).orderBy("id").limit(4)  # of one salt
    ids = [r["id"] for r in ids.collect()]
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in ids[:1] * 12 + ids[1:]] + [(5000, [9.0, 9.0])], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") == ids[1]).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got[:3]] == [(i, 0.0) for i in (ids[0], ids[2], ids[3])] and len(got) == 4


def test_recall_on_the_embeddings(spark, data):
    """Several shards: 0.9 of the true neighbours and more are found."""
    df = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    v = neighbours.usable(df)
    index = neighbours.build_index(v, least_rows=300)
    assert index.count() == 4
    got = neighbours.search_index(index, v.filter("vec_id % 100 = 0")).toPandas()
    every = v.toPandas()
    x, ids = np.array(every["v"].tolist(), np.float64), every["vec_id"].to_numpy()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        want = [i for _, i in sorted(zip(d.tolist(), ids.tolist())) if i != q][:10]
        hits += len(set(want) & set(got[got["query_id"] == q]["vec_id"]))
        total += len(want)
    assert hits >= 0.9 * total


def test_ids_of_several_vectors(spark):
    df = spark.createDataFrame([(100, [0.0, 1.0], "x"), (100, [9.0, 9.0], "x"), (1, [0.0, 2.0], "x"), (2, [9.0, 8.0], "x"), (2, [0.0, 7.0], "x")], "vec_id long, embedding array<float>, score string")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).orderBy("rank").collect()]
    assert got == [(100, 1, 1, 1.0), (100, 2, 2, 1.0)]


def test_nearest_of_nothing(spark):
    df, _ = vectors(spark, 20)
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(100, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert neighbours.nearest(one, F.col("vec_id") % 100 == 0).count() == 0


