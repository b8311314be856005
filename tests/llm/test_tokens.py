import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from tessera.llm import bpe, packing, pretokens, token_files

BYTE, WORD = path("byte_bpe_50k.json"), path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def fuzz(corpus):
    rnd = random.Random(1)
    odd = list("abcdeTHE  \n\n\t.,!?12 'séÉßÑ×÷µº ́Σσςİ中文🙂\x1c\x85 <|>endoftext")
    plain = list("abcdeTHE  \n\n\t.,!?12éÉßÑ<|>  \r")
    out = ["".join(rnd.choices(a, k=rnd.randint(0, 60))) for a in (odd, plain) for _ in range(700)]
    out += [t or "" for _, t in corpus]
    return out + [" ", "\n", " \n ", "a<|endoftext|>b", "it's I'll 'S", "aaaa " * 300, "é" * 1000, " " * 500 + "\n" * 40]


@pytest.mark.parametrize(
    ("file", "make"),
    [(BYTE, pretokens.library_encoder), (BYTE, bpe.backtracking_encoder), (WORD, lambda p: pretokens.library_encoder(p, word_level=True))],
)
def test_encoders_equal_the_library(fuzz, file, make):
    tok, enc, got = Tokenizer.from_file(file), make(file), []
    for _, offs, ids in enc.rows(pa.array(fuzz)):
        got += [ids[a:b].tolist() for a, b in zip(offs, offs[1:], strict=False)]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in fuzz]


def test_random_bytes_of_letters_equal_the_library():
    tok, enc, rnd = Tokenizer.from_file(BYTE), bpe.BacktrackingBpe(BYTE), random.Random(3)
    for _ in range(500):
        word = "".join(rnd.choices("abcehinorst", k=rnd.randint(1, 40)))
        assert enc.encode(word.encode()) == tok.encode(word, add_special_tokens=False).ids


def test_decoding_equals_the_library(fuzz):
    tok, enc = Tokenizer.from_file(BYTE), bpe.BacktrackingBpe(BYTE)
    rnd = random.Random(4)
    for ids in [tok.encode(t, add_special_tokens=False).ids for t in fuzz[:300]] + [[rnd.randrange(50257) for _ in range(20)] for _ in range(200)]:
        raw, _ = enc.decode(np.array(ids, np.uint32))
        assert bpe.as_text(raw.tobytes()).decode() == tok.decode(ids, skip_special_tokens=False)


def test_round_trip_query(docs, corpus, empty):
    tok = Tokenizer.from_file(BYTE)
    rows = {r.doc_id: r for r in bpe.round_trip(docs, BYTE).collect()}
    for i, t in corpus:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(empty, BYTE).count() == 0
    back = {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(docs, BYTE), BYTE).collect()}
    assert all(back[i] == (t or "") for i, t in corpus)


def test_codes_give_any_id():
    rnd = np.random.default_rng(0)
    ids = np.concatenate([rnd.integers(0, 50000, 5000), [0, 255, 256, 65535, 65536, 2**24, 2**32 - 1]]).astype(np.uint32)
    seg = token_files.Segment(token_files.write_segment([1, 2], [0, 100, len(ids)], ids))
    assert (seg.read(0, len(ids)) == ids).all()
    for lo, hi in ((0, 1), (511, 513), (1000, 3000), (len(ids) - 3, len(ids)), (7, 7)):
        assert (seg.read(lo, hi) == ids[lo:hi]).all()
    assert [seg[i] for i in (0, 1, 511, 512, 513, 4999, *range(5000, 5007))] == ids[[0, 1, 511, 512, 513, 4999, *range(5000, 5007)]].tolist()
    with pytest.raises(IndexError):
        seg[len(ids)]
    with pytest.raises(ValueError):
        token_files.Segment(b"else" + bytes(40))


def test_a_file_gives_any_id_by_position(spark, docs, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 50)
    monkeypatch.setattr(token_files, "FILE_SEGMENTS", 3)
    docs.write.parquet(f"file://{tmp_path}/docs")  # read from files, the table's size is known
    token_files.write(spark.read.parquet(f"file://{tmp_path}/docs"), f"file://{tmp_path}/a", WORD)
    tok = Tokenizer.from_file(WORD)
    ids = [x for _, t in corpus for x in (*tok.encode(t or "", add_special_tokens=False).ids, 2)]
    files = [token_files.TokenFile(str(f)) for f in tmp_path.glob("a/part-*") if f.stat().st_size]
    files.sort(key=lambda f: (f.segments[0].part, f.first))
    assert len(files) > 3 and max(len(f.segments) for f in files) > 1
    assert all(s.n_bytes and len(f.segments) <= 3 for f in files for s in f.segments)
    got = [f[i] for f in files for i in range(f.n_ids)]
    assert got == ids
    with pytest.raises(IndexError):
        files[0][files[0].n_ids]
    assert sum(r.n_tokens for r in token_files.read(spark, f"file://{tmp_path}/a").collect()) == len(ids)


def test_token_files(spark, docs, corpus, empty, repeated, tmp_path):
    tok = Tokenizer.from_file(WORD)
    token_files.write(docs, f"file://{tmp_path}/a", WORD)
    rows = {r.doc_id: r for r in token_files.read(spark, f"file://{tmp_path}/a").collect()}
    start = 0
    for i, t in corpus:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
    token_files.write(empty, f"file://{tmp_path}/b", WORD)
    assert token_files.read(spark, f"file://{tmp_path}/b").count() == 0
    token_files.write(repeated, f"file://{tmp_path}/c", WORD)
    again = sorted(token_files.read(spark, f"file://{tmp_path}/c").collect(), key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(again, again[1:], strict=False))


def test_shortest_pack_first_keeps_the_histogram():
    rnd = random.Random(2)
    hist = defaultdict(int)
    for _ in range(30000):
        hist[rnd.randint(1, 64)] += 1
    packs = packing.shortest_pack_first(hist, 64)
    got = defaultdict(int)
    for pattern, n in packs:
        assert sum(pattern) <= 64
        for x in pattern:
            got[x] += n
    assert got == hist
    assert sum(n for _, n in packs) * 64 <= 1.02 * sum(k * n for k, n in hist.items())
    assert packing.shortest_pack_first({}, 64) == []


def test_packing(docs, corpus, empty, repeated):
    tok, size = Tokenizer.from_file(BYTE), 128
    rows = packing.packed(docs, BYTE, size).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in corpus:
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(ids)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    made = {r.sequence_id: r for r in packing.sequences(docs, packing.packed(docs, BYTE, size), BYTE, size).collect()}
    whole = lambda n: n if n & (n - 1) == 0 else size
    assert all(len(r.ids) == whole(r.n_ids) for r in made.values()) and len(made) == len(by_seq)
    assert packing.packed(empty, BYTE, size).count() == 0
    assert packing.packed(repeated, BYTE, size).count() >= repeated.count()
