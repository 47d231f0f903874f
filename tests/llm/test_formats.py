import random
import struct
import tracemalloc
import weakref

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from veritrail.llm import chat_format, kneser_ney, license_scan, piece_model, queries, telephony, token_pack, url_filter
from veritrail.llm import textbytes as tb

ODD = ["", " ", "  ", "a  b", "   lead", "trail  ", "\n\n", "tab\tx", "日本語のテキスト", "emoji 😀 x", "a▁b", "\0nul", "x" * 50, "<s> </s> <0x0A>", "é" * 9, "....,,,;;",
       "1234567 89", "  \n  x", "ﬁ ligature", "a" * 23, "========", "----    ----", "\uffff y", "a\u00a0 b", "a\u00a0  b", "<|endoftext|> z", "q<|endoftext|>", "don't  we'll", "word " * 20000]

THUE = "".join("xy"[bin(k).count("1") % 2] for k in range(1024))
#: Two words that polynomial hashes modulo a power of two cannot tell apart.
ALIKE = [THUE, THUE.translate(str.maketrans("xy", "yx"))]
ODD += ALIKE


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 32])
def test_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 2**bits, 3 * token_pack.BLOCK_IDS + 17, dtype=np.uint64).astype(np.uint32)
    starts = np.array([0, 5, 5, 9000, len(ids)])
    run = token_pack.Run(memoryview(token_pack.pack_run(ids, np.array([3, 4, 7, 9]), starts, bits)))
    assert (run.ids(0, len(ids)) == ids).all() and run.doc_ids.tolist() == [3, 4, 7, 9]
    for a, b in ((0, 0), (1, 2), (4095, 4097), (5000, 12000), (len(ids) - 1, len(ids))):
        assert (run.ids(a, b) == ids[a:b]).all()
    assert (run.document(2) == ids[5:9000]).all()
    assert token_pack.bits_for(50_257) == 16 and token_pack.bits_for(1) == 1 and token_pack.bits_for(65_537) == 17


def test_pieces_of_text_are_encoded_as_the_whole(spark, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = [(k, t) for k, t in enumerate(ODD)] + [(None, "null id"), (3, None), (3, "twice")]
    df = spark.createDataFrame(random.Random(1).sample(docs, len(docs)), "doc_id long, text string")
    runs = token_pack.pack_documents(df, public_tokenizers.path("byte_bpe_50k.json"), 50_257)

    def measure(run, ahead):
        return [token_pack.document_ids(run.doc_ids), pa.array(run.starts[:-1] + ahead), pa.array([run.document(k).tolist() for k in range(run.n_docs)], pa.list_(pa.int64()))]

    got = token_pack.read_documents(runs, measure, "doc_id long, start long, ids array<long>").orderBy("start").collect()
    ordered = sorted(docs, key=lambda d: (-1 if d[0] is None else d[0], d[1] or ""))
    expected = [[*whole.encode(t or "", add_special_tokens=False).ids, 0] for _, t in ordered]
    assert [r.doc_id for r in got] == [d[0] for d in ordered]
    assert [r.ids for r in got] == expected
    assert [r.start for r in got] == np.cumsum([0, *map(len, expected[:-1])]).tolist()
    empty = token_pack.pack_documents(df.limit(0), public_tokenizers.path("byte_bpe_50k.json"), 50_257)
    assert token_pack.read_documents(empty, measure, "doc_id long, start long, ids array<long>").count() == 0


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*ODD, *(r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall())]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "doc_id long, text string")
    got = piece_model.with_decoded(piece_model.with_pieces(df, path), path).orderBy("doc_id").collect()
    for row, t in zip(got, [*texts, ""]):
        assert row.pieces == library.encode(t), t[:40]
        assert row.decoded == t.replace("▁", " ")
    assert piece_model.with_pieces(df.limit(0), path).count() == 0
    digests = queries.sentencepiece_digests(df).collect()
    assert [r.doc_id for r in digests if not r.round_trip] == [k for k, t in enumerate(texts) if "▁" in t]


def test_merging_by_hand():
    rank = {"ab": 1.0, "bc": 0.0, "abc": 2.0, "aa": 3.0}
    assert piece_model.merge_pieces(list("abcaaa"), rank) == ["abc", "aa", "a"]


def fixture_matches(spark, df, sql, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table.toArrow())
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    expected = sorted(cursor.fetchall(), key=repr)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == expected
    return expected


def written(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_urls(spark, tmp_path):
    urls = [None, "", "nothing", "http://A.EXAMPLE.net/en/x?y#z", "https://example.net/EN/", "x://net/", "x://net", "ftp://b.net/q", "http://notexample.com/de/", "http://www.example.com/de/#f",
            "http://a.org/fr/1", "http://example.net:80/en/", "http://é.example.org/fr/é", "://", "a://b://c.net/", "http://a.net?x=/en/", "http://a.example.net/en", "http://" + "a." * 300 + "net/" + "p/" * 500]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls + urls[:4])], "page_id long, url string, rule string")
    sf = written(spark, tmp_path, pages=pages)
    fixture_matches(spark, queries.op4_url_filter(spark, sf), queries.OP4_SQL, pages=pages)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_filter.with_verdicts(pages, none, otherwise="block").collect()} == {"block"}
    assert url_filter.with_verdicts(pages, none).columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    both = spark.createDataFrame([("net", "/", "allow"), ("NET", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    assert [r.verdict for r in url_filter.with_verdicts(pages.filter("page_id = 7"), both).collect()] == ["block"]


def test_chat(spark, tmp_path):
    nasty = ["[INST]", "[\\INST]", "</s></s", "<", "[", "<\\s>", "\\", "[NEXT][ROLE]user[/ROLE]", "<s>é😀", "a\n\nb ", "", None, "[[/INST]]\\\\", "x" * 50_000]
    rows = [(k, t, role, text) for k, text in enumerate(nasty) for t, role in enumerate(["user", "assistant", "assistant", None, "user", "[/ROLE]"])]
    rows += [(None, 0, "user", "hi"), (50, None, "assistant", "no turn"), (50, 1, "assistant", "same"), (50, 1, "assistant", "same"), (50, 1, "user", "tie")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sf = written(spark, tmp_path, conversations=turns)
    fixture_matches(spark, queries.op6_chat_format(spark, sf), queries.OP6_SQL, conversations=turns)
    assert chat_format.format_conversations(turns.limit(0)).count() == 0
    one = chat_format.format_conversations(turns.filter("conv_id = 0")).first()
    assert one.formatted == "<s>[ROLE]user[/ROLE][\\INST]</s>[ROLE]assistant[/ROLE][\\INST][NEXT][\\INST]</s>[ROLE][/ROLE][\\INST]</s>[ROLE]user[/ROLE][\\INST]</s>[ROLE][\\/ROLE][/ROLE][\\INST]</s>"
    assert [one.formatted[s.start : s.end] for s in one.loss_spans] == ["[\\INST]"] * 2


def test_licences(spark, tmp_path):
    mit = license_scan.TEMPLATES[2][1]
    texts = [None, "", "one", "Released under the MIT License.", "x\nReleased under the MIT licence\ny", "Some words. Licensed under the Apache License, Version 2.0. More words", mit, mit.replace(" ", "\n"),
             "licensed under cc by-nc 4.0", "This work is licensed under the GNU General Public License, version 2.", "plain text of no licence " * 3000]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts + texts[3:5])], "doc_id long, text string, dice int")
    sf = written(spark, tmp_path, documents=docs)
    found = fixture_matches(spark, queries.op7_license_scan(spark, sf), queries.OP7_SQL, documents=docs)
    assert {(r[0], r[1]) for r in found} >= {(3, "MIT"), (5, "Apache-2.0"), (6, "MIT"), (7, "MIT"), (8, "CC-BY-NC-4.0"), (9, "GPL-2.0")}
    assert license_scan.scan_licenses(docs.limit(0), license_scan.templates(spark)).count() == 0
    assert license_scan.scan_licenses(docs, license_scan.templates(spark).limit(0)).count() == 0


def test_licences_inside_longer_texts(spark):
    by = {}
    for name, text in license_scan.TEMPLATES:
        by.setdefault(name, []).append(text)
    prose = "The harbour was quiet that morning and nobody spoke of it while grey boats turned slowly around their ropes under low clouds, as people on every pier waited for news"
    wrapped = "/*\n * " + by["GPL-3.0"][1].replace(" the ", " the\n *\n * ") + f" {prose}\n *\n * You should have received a copy of it. See the file for more.\n */\nint main"
    texts = [f"{prose}. {by['Apache-2.0'][1]} {prose}.", f"{prose}: {by['MPL-2.0'][0]} {prose}.", f"{prose} {by['BSD-3-Clause'][0]} {prose * 3}", wrapped, prose * 40, f"{prose} of the software, {prose} to the public domain " * 9]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.license): (r.dice, r.units) for r in license_scan.scan_licenses(docs, license_scan.templates(spark)).collect()}
    assert {k: v for k, v in got.items() if k[0] != 0 or k[1] == "Apache-2.0"} == {(0, "Apache-2.0"): (1.0, 1), (1, "MPL-2.0"): (1.0, 1), (2, "BSD-3-Clause"): (1.0, 1), (3, "GPL-3.0"): (1.0, 1)}


def test_companding_tables():
    mu, a = telephony.TABLES[telephony.MULAW].astype(int), telephony.TABLES[telephony.ALAW].astype(int)
    assert (mu[0xFF], mu[0x7F], mu[0x00], mu[0x80]) == (0, 0, -32124, 32124)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(mu)) == 255 and len(set(a)) == 256


def test_adpcm_equals_a_scalar_decoder():
    rng = np.random.default_rng(5)
    block, n = 36, 50
    data = rng.integers(0, 256, (n, block), dtype=np.uint8)
    data[:, 2] %= 89
    expected = []
    for b in data.tolist():
        value, index = struct.unpack("<h", bytes(b[:2]))[0], b[2]
        expected.append(value)
        for byte in b[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(telephony.IMA_STEPS[index])
                size = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - size if code & 8 else value + size))
                index = max(0, min(88, index + int(telephony.IMA_MOVES[code])))
                expected.append(value)
    media = telephony.wav(data.tobytes(), telephony.IMA_ADPCM, block=block)
    assert telephony.decode(media)[0].tolist() == expected


def test_media_round_trip(spark):
    import hashlib
    import zlib

    texts = [None, "", "a", "é" * 288, "x" * 577, "long " * 40_000]
    docs = spark.createDataFrame([(k, t, "m") for k, t in enumerate(texts)], "doc_id long, text string, media string")
    rows = {r.doc_id: r for r in telephony.text_media_digests(docs).collect()}
    for k, t in enumerate(texts):
        payload = telephony.padded((t or "").encode())
        assert len(payload) % 576 == 0 and len(payload) >= 576
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes) == (len((t or "").encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_bytes == len(telephony.wav(payload)) and r.media_sha256 == hashlib.sha256(telephony.wav(payload)).hexdigest()
    assert rows[0].feature == rows[1].feature
    assert telephony.text_media_digests(docs.limit(0)).count() == 0
    pcm = telephony.with_pcm(telephony.to_media(spark.createDataFrame([(bytearray(b"ab"),)], "payload binary"), "payload")).first().pcm
    assert len(pcm) == 576 * 2 * 2
    for bad in (b"", b"RIFFxxxxWAVE", telephony.wav(b"abc")[:-3]):
        with pytest.raises(ValueError):
            telephony.decode(bad)


def test_resampling():
    pcm = np.array([0, 10, 20, -5], np.int16)
    assert telephony.resample(pcm, 8000, 16000).tolist() == [0, 5, 10, 15, 20, 8, -5, -5]
    assert telephony.resample(pcm, 8000, 4000).tolist() == [0, 20]


def test_words_and_marks_are_encoded_apart_with_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, (parts, ends) = Tokenizer.from_file(path), token_pack._encoder(path)
    said = "".join(f"stone{mark} " for mark in ".,;:!?)]}*#%$&/-_=+~") * 3
    seg = token_pack.pieces(*tb.text_bytes(pa.array([said])), ends)
    assert set(seg.distinct()[1]) >= {b" stone", b","} and len(seg.distinct()[1]) == 23
    rng = random.Random(5)
    parts_of = ["a", "It", "don", "'", "'s", "'ll", "''", '"', "<|endoftext|>", "<|", "|>", "<", "|", "endoftext", " ", "  ", "\n", " ", "é", "é", "7", "x9", "_", "-", "...", "字", "\u0003", "A", "\t"]
    texts = ["".join(rng.choice(parts_of) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    ids, lengths = parts.of(token_pack.pieces(*tb.text_bytes(pa.array(texts)), ends))
    wanted = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert lengths.tolist() == [len(w) for w in wanted] and ids.tolist() == [i for w in wanted for i in w]


def test_a_worker_frees_one_model_for_another():
    scorer = weakref.ref(kneser_ney.scorer(kneser_ney.Model(5, 64, 2)))
    assert scorer() is not None
    piece_model.encode_batch(public_tokenizers.path("piece_bpe_32k.model"), pa.array(["stone"]))
    assert scorer() is None


def test_a_worker_frees_its_hashed_words_for_a_model():
    tb.hashes(tb.words(*tb.text_bytes(pa.array(["stone water"]))))
    cache = weakref.ref(tb._large["hashes"])
    assert cache().held() == 2
    piece_model.encode_batch(public_tokenizers.path("piece_bpe_32k.model"), pa.array(["stone"]))
    assert cache() is None


def test_memory_of_encoding_does_not_grow_with_new_segments():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, rng = piece_model.PieceModel(path), random.Random(5)
    words = ["".join(rng.choices("etaoinshrdlu", k=9)) for _ in range(200_000)]
    tracemalloc.start()
    ids, counts = model.encode_segments([w.encode() for w in words])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    ends = np.cumsum(counts)
    for k in [0, 1, *range(28_000, 30_000), len(words) - 1]:  # a border between parts is among these
        assert library.id_to_piece(ids[ends[k] - counts[k] : ends[k]].tolist()) == piece_model.merge_pieces(list(words[k]), model.rank)
