"""Token files against the tokenizers library, and their format."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.llm.token_files import Encoder, TokenFile, TokenFileError, TokenStream, read_token_files, token_file_round_trip, write_token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def brute(library, rows, end=0):
    """doc_id, start, n_tokens, crc of rows in the order they are given."""
    out, at = [], 0
    for key, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [end]
        out.append((key, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    return out


PARTS = [" ", "  ", "\n", "\t", "\r\n", " ", "　", "\x0b", "\x1c", "\x85", "a", "Bc", "é", "12", "'s", "'ll", "!", "...", "日本", "<|endoftext|>", "<|endof", "​", "👍🏽", "́"]


def test_encoder_against_the_library(library):
    with open(PATH, encoding="utf-8") as f:
        e = Encoder(f.read())
    assert e.by_pieces and e.dtype == np.dtype("<u2")
    rng = random.Random(5)
    for _ in range(20_000):
        s = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(e.ids(s), e.dtype).tolist() == library.encode(s, add_special_tokens=False).ids, repr(s)


def test_encoder_forgets(library, monkeypatch):
    import sylva.llm.token_files as module

    monkeypatch.setattr(module, "REMEMBERED", 5)
    with open(PATH, encoding="utf-8") as f:
        e = Encoder(f.read())
    for s in ("one two three four five six seven eight", "a  b c d e f g h i j  k", "one two nine", "x"):
        assert np.frombuffer(e.ids(s), e.dtype).tolist() == library.encode(s, add_special_tokens=False).ids


def test_encoder_of_another_kind():
    """A vocabulary with normalisation goes through the library whole."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        e = Encoder(f.read())
    assert not e.by_pieces
    for s in ("Hello  World", "ÀB c", ""):
        assert np.frombuffer(e.ids(s), e.dtype).tolist() == Tokenizer.from_file(path).encode(s, add_special_tokens=False).ids


def test_token_files(spark, library, tmp_path):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["the", "tree", "naïve", "x1", "Über,"]) for _ in range(n))
    rows = [(i, say(rng.randint(0, 30)), "x", 7) for i in range(-50, 150)] + [(500, None, "x", 7), (501, "", "x", 7), (502, say(60_000), "x", 7)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    docs = spark.createDataFrame(shuffled, "doc_id long, text string, start string, n_tokens int").repartition(5)
    manifest = write_token_files(docs, PATH, f"file://{tmp_path}/t", file_bytes=900)
    files = manifest.orderBy("start").collect()
    assert len(files) > 4 and max(f.docs for f in files) > 1
    got = sorted(map(tuple, read_token_files(manifest).collect()), key=lambda r: r[0])
    want = brute(library, [(r[0], r[1]) for r in rows])
    assert got == want
    # the ids themselves, from the files and through the stream over all of them
    ids = {r.doc_id: r.ids for r in read_token_files(manifest, ids=True).collect()}
    stream = TokenStream(spark.read.parquet(f"file://{tmp_path}/t/manifest"))
    assert len(stream) == sum(w[2] for w in want)
    for (key, start, n, _), (_, t, *_) in zip(want, rows, strict=True):
        assert ids[key] == library.encode(t or "", add_special_tokens=False).ids + [0]
        assert stream[start : start + n].tolist() == ids[key]
    assert stream[10:5000].tolist() == [x for r in rows for x in ids[r[0]]][10:5000]
    assert stream[7:7].tolist() == []
    one = TokenFile(files[0].path, files[0].docs, files[0].tokens)
    assert one.mapped is not None and one[0].base is not None and len(one) == files[0].docs


def test_shared_and_missing_ids(spark, library):
    """Rows that share a doc_id or have none are all there, in ascending order of id, each of them once."""
    rows = [(None, "no id"), (3, "three"), (None, None), (1, "one")] + [(2, "hot"), (2, "two words")] * 200
    got = [tuple(r) for r in token_file_round_trip(spark.createDataFrame(rows, "doc_id long, text string"), PATH).orderBy("start").collect()]
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    by_key = lambda table: sorted((str(k), n, c) for k, _, n, c in table)
    assert by_key(got) == by_key(brute(library, rows))
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n


def test_empty_table_and_broken_files(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_file_round_trip(docs, PATH).count() == 0
    manifest = write_token_files(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), PATH, f"file://{tmp_path}/b")
    path = manifest.first().path.removeprefix("file://")
    with open(path + ".bin", "ab") as f:
        f.write(b"\0\0")
    with pytest.raises(TokenFileError):
        TokenFile(path)
    with open(path + ".idx", "wb") as f:
        f.write(b"something else")
    with pytest.raises(TokenFileError):
        TokenFile(path)
    with pytest.raises(ValueError):
        write_token_files(docs, PATH, end_id=1 << 16)


def test_counts_agree_with_token_counts(spark):
    from sylva.llm.token_count import count_tokens
    from sylva.runtime import table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    files, counts = token_file_round_trip(docs, PATH), count_tokens(docs, PATH)
    assert files.join(counts.select("doc_id", F.col("n_tokens").alias("n")), "doc_id").filter("n_tokens <> n + 1").count() == 0
    assert files.count() == docs.count()
