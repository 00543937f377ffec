"""Round trips of the token files, and ids equal to the library's own."""

import random
import struct

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer
import public_tokenizers

from termtrail.llm import common, token_file
from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, shard int, file string"


def plain(texts):
    library = Tokenizer.from_file(public_tokenizers.path(token_file.TOKENIZER))
    return [library.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_cached_encoding_equals_the_library(spark):
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    texts += ["", None, "  two  spaces\t\ttab\r\nline\n\n", "it's WE'RE don't", "<|endoftext|> a<|startoftext|>b",
              "e\u0301 \u0301x İΣΑΣ a\u00a0b\u2003c\u0085d", "x" * 5000, "1234 ½ 😀👍🏽 #!?%", " \u0301 lead", "'s 't"]
    got = token_file.encoder().encode(texts)
    assert [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in got] == [p[:-1] for p in plain(texts)]


def test_round_trip_with_ties_nulls_and_small_frames(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_file.common, "shard_bounds",
                        lambda d, c, real=common.shard_bounds: real(d, c, rows_per_shard=4))
    rnd = random.Random(2)
    rows = [(i * 3, " ".join(rnd.choice(("the", "of", "qzx", "Ünder")) for _ in range(rnd.randrange(0, 40))), 1, "f")
            for i in range(30)]
    rows[4] = (12, None, None, None)
    rows += [(27, "tie", 1, "f"), (27, "tie", 1, "f"), (None, "no id", 1, "f")]
    made = token_file.write(spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    assert sum(r.n_docs for r in made.collect()) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    ids = plain([r[1] for r in order])
    starts = np.concatenate(([0], np.cumsum([len(i) for i in ids])))[:-1]
    want = [(r[0], int(s), len(i), struct.pack(f"<{len(i)}I", *i)) for r, s, i in zip(order, starts, ids, strict=True)]
    got = sorted((tuple(r) for r in token_file.read(spark, str(tmp_path), made).collect()), key=lambda r: r[1])
    assert [(a, b, c, bytes(d)) for a, b, c, d in got] == want


def test_reader_takes_single_documents_and_sees_damage(tmp_path, monkeypatch):
    monkeypatch.setattr(token_file, "FRAME_BYTES", 64)
    path = tmp_path / "one.zst"
    texts = {5: bytes(range(200)) + bytes(56), 6: b"", 9: b"\1\0\0\0" * 3}
    with open(path, "wb") as sink:
        out = token_file.Writer(sink)
        for doc_id, ids in texts.items():
            out.add(doc_id, ids)
        out.close()
    reader = token_file.Reader(str(path))
    assert {d: reader.find(d)[0] for d in texts} == texts and reader.find(7) == []
    raw = path.read_bytes()  # any zstandard reader can stream the file: index and table are skippable
    with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as stream:
        assert stream.read() == b"".join(texts.values())
    path.write_bytes(raw[:12] + bytes([raw[12] ^ 1]) + raw[13:])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_file.Reader(str(path)).find(5)


def test_empty_table(spark, tmp_path):
    made = token_file.write(spark.createDataFrame([], SCHEMA), str(tmp_path))
    assert made.count() == 0 and token_file.read(spark, str(tmp_path), made).count() == 0


def test_a_word_is_spelled_once_for_all_marks_and_capitals():
    one = token_file.Encoder(public_tokenizers.path(token_file.TOKENIZER))
    assert one.direct
    one.runs.clear()
    text = "wörterbuch wörterbuch, WÖRTERBUCH!! Wörterbuch, wörterbuch. plain plain, Plain! plain."
    assert one.encode([text]) == [b"".join(one._whole([p])[0] for p in text.split(" "))]
    assert set(one.runs) == {"wörterbuch", "plain", ",", "!!", "!", "."}
