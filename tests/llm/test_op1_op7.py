import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from llm_fixtures import documents, saved, table

from stopgrid.llm import byte_bpe, token_store
from stopgrid.llm.queries import op1_token_store, op7_byte_bpe

ODD = ["a\x1cb \x85 c　d  \x1d\x1e e", "x" * 3000, "🚎" * 500, "'s'S don't", " \n\n  x", "​́ ½ ² Ⅷ ªº é", "aaaa" * 50, "İSS ſ Σς", "<|endoftext|> a<|endoftext|>b", "see <|endoftext|> here", "<|startoftext|><|endoftext|>", "x<|STARTOFTEXT|><|startoftext|", "é<|startoftext|>\u0301 é"]


def rows_():
    return documents() + [(2000 + i, t, "en", "s", 0) for i, t in enumerate(ODD)]


def test_op1_equals_library(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    import xxhash

    signed = lambda h: h - (1 << 64) * (h >> 63)
    rows = sorted(rows_(), key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1] or "", 42))))
    want, at = [], 0
    for d, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [tuple(r) for r in op1_token_store(spark, saved(spark, tmp_path, rows_())).collect()]
    assert Counter(got) == Counter(want)


def test_store_reads_one_document_and_checks_dictionary(spark):
    many = [(i, t or "x", "en", "s", 0) for i, (_, t, *_) in enumerate(documents(300))]
    m = token_store.write_store(table(spark, many).select("doc_id", "text"), P.path("word_bpe_49k.json"), 2).cache()
    enc = token_store.encoder(P.path("word_bpe_49k.json"))
    assert token_store.find_document(m, 17).astype("<u2").tobytes() == enc.encode([many[17][1]])[0] + b"\2\0"
    assert token_store.find_document(m, 10**6) is None
    shas = {r.dict_sha256 for r in m.collect()}
    assert len(shas) == 1
    path = m.first().path.removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    s = token_store.Shard("file://" + path)
    if s.head["dict_bytes"]:
        raw[16 + int.from_bytes(raw[8:16], "little") + 5] ^= 1
        open(path + "x", "wb").write(raw)
        with pytest.raises(ValueError):
            token_store.Shard("file://" + path + "x")


def test_special_token_strings_are_recognised_as_the_library_does():
    enc = token_store.encoder(P.path("word_bpe_49k.json"))
    ids = np.frombuffer(enc.encode(["see <|endoftext|> here"])[0], enc.type)
    assert len(ids) == 3 and ids[1] == 49407


def test_manifest_tells_where_a_document_is(spark):
    rows = [(i if i % 3 else None, f"text {i}", "en", "s", 0) for i in range(200)]
    m = token_store.write_store(table(spark, rows, h=1, i="x").select("doc_id", "text"), P.path("word_bpe_49k.json"), 2)
    # Rows without id don't fill one shard.
    assert max(r.n_docs for r in m.collect()) < 120
    assert m.where("least <= 100 and most >= 100").count() == 1 and len(token_store.find_document(m, 100)) == 5


def test_long_text(spark):
    t = "Straße 42, <|endoftext|> ok\n" * 60_000
    r = token_store.read_store(spark, token_store.write_store(table(spark, [(1, t, "en", "s", 0)]).select("doc_id", "text"), P.path("word_bpe_49k.json"), 2)).first()
    from tokenizers import Tokenizer

    assert r.n_tokens == len(Tokenizer.from_file(P.path("word_bpe_49k.json")).encode(t, add_special_tokens=False).ids) + 1


def test_empty_tables(spark, tmp_path):
    d = saved(spark, tmp_path, [])
    assert op1_token_store(spark, d).count() == 0 and op7_byte_bpe(spark, d).count() == 0


def test_op7_equals_library(spark, tmp_path):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for d, t, *_ in rows_():
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        want[(d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in op7_byte_bpe(spark, saved(spark, tmp_path, rows_())).collect()) == want


def test_encode_decode_columns(spark):
    args = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    out = byte_bpe.decode(byte_bpe.encode(table(spark, token_ids="clash", n_tokens=7), *args), *args)
    for r in out.collect():
        assert bytes(r.decoded).decode() == (r.text or "") and r.n_tokens * 4 == len(r.token_ids)


def test_perfect_hash():
    r = random.Random(1)
    keys = list({bytes(r.randrange(256) for _ in range(r.randint(1, 6))) for _ in range(3000)})
    h = byte_bpe.PerfectHash(keys)
    assert sorted(h.slot_at) == list(range(len(keys)))
    assert [h.get(k) for k in keys] == list(range(len(keys))) and h.get(b"absent!") == -1
