"""Counts, encodings, scans and media against plain Python and the libraries."""

import hashlib
import random
import struct
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from ledgerflow.llm import bpe, licences, tiff, token_counts

PATH = public_tokenizers.path(bpe.RANK_FILE)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, ids string"
EDGES = [
    (1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "It's 2 o'clock — naïve 日本語 🙂 <|endoftext|>"), (6, "x" * 3000), (7, "ab " * 20000), (7, "ab " * 20000), (None, "no id"), (8, "　  \x85  x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", 1, "clash") for i, t in EDGES], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_text(df, docs):
    """Rows in the order of EDGES."""
    assert df.count() == docs.count()
    return {(r["doc_id"], i): r for i, r in enumerate(sorted(df.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)))}


def ordered():
    return sorted(EDGES, key=lambda e: (e[0] is None, e[0] or 0))


def test_bpe_is_the_librarys(docs, empty):
    ranks = bpe.read_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = list(by_text(bpe.round_trip(docs, PATH, public_tokenizers.PATTERN), docs).values())
    for (_, text), row in zip(ordered(), rows, strict=True):
        ids = library.encode_ordinary(text or "")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(empty, PATH, public_tokenizers.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert sorted(bytes(r["bytes"]) for r in back.collect()) == sorted((t or "").encode() for _, t in EDGES)


def test_bpe_fold_in_higher_order_functions(spark):
    ranks = bpe.read_ranks(PATH)
    words = spark.createDataFrame([("hello there, naïve 日本語 wonderfully aaaaaaaa 🙂",), ("antidisestablishmentarianism",)], "text string")
    found = bpe.fold_pieces(bpe.pieces(words, public_tokenizers.PATTERN), PATH).collect()
    assert len(found) > 6 and all(r["ids"] == bpe.merge(r["piece"].encode(), ranks) for r in found)
    odd = spark.createDataFrame([(None, 1, "p"), ("", 2, "p"), ("twice twice", 3, "p"), ("twice twice", 4, "p")], "text string, h int, p string")
    pieces = bpe.pieces(odd, public_tokenizers.PATTERN)
    assert sorted(r[0] for r in pieces.collect()) == [" twice", "twice"]
    again = bpe.fold_pieces(spark.createDataFrame([(None, 1), ("", 2), ("ab", 3), ("ab", 4)], "piece string, r int"), PATH)
    assert [r["ids"] for r in again.collect()] == [bpe.merge(b"ab", ranks)] * 2 and bpe.fold_pieces(pieces.limit(0), PATH).count() == 0


def test_bpe_long_pieces():
    ranks, rng = bpe.read_ranks(PATH), random.Random(5)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for n in (255, 256, 257, 900):
        piece = "".join(rng.choice("aeinorst") for _ in range(n)).encode()
        assert bpe.merge(piece, ranks) == bpe._merge_long(piece, ranks) == library._encode_single_piece(piece)


def test_token_counts_are_the_librarys(docs, empty):
    path = public_tokenizers.path(token_counts.VOCABULARY)
    whole = token_counts.Counter(path)
    rows = list(by_text(token_counts.token_counts(docs, path), docs).values())
    for (_, text), row in zip(ordered(), rows, strict=True):
        n = whole.whole(text or "")
        assert (row["n_tokens"], row["n_bytes"], row["over_limit"]) == (n, len((text or "").encode()), n > 2048)
    assert token_counts.token_counts(empty, path).count() == 0


def test_spliced_chunks_equal_the_whole():
    counter = token_counts.Counter(public_tokenizers.path(token_counts.VOCABULARY))
    rng = random.Random(2)
    texts = [
        " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))) for _ in range(3000)),
        "y" * 5000,  # no boundary anywhere: the chunk grows to the whole
        "z" * 900 + " and so on, " * 300,
        "<|endoftext|> it's \n" * 400,
    ]
    for text in texts:
        assert counter.spliced(text, chunk=400, overlap=16) == counter.whole(text)


def test_licence_scan(spark, docs, empty):
    model = licences.train()
    for family, templates in licences.TEMPLATES.items():
        for t in templates:
            assert [h[1] for h in model.scan("Before.\nSee: " + t + " Thanks.")] == [family]
    for other in ("the public commons of creative people", "a licence to drive, version 3 of the general's work", "apache mozilla mit bsd"):
        assert model.scan(other) == []
    assert model.probabilities(licences.words_of("nothing of the kind"))[-1] > 0.3
    rows = licences.scan_licences(docs, model).collect()
    assert len(rows) == len(EDGES) and all((r["n_notices"], r["families"], r["first_paragraph"]) == (0, "", -1) for r in rows)
    two = spark.createDataFrame([(1, "x\n" * 50 + "Released under the MIT License.\n" + "word " * 500 + "Licensed under CC BY-NC 4.0. end")], "doc_id long, text string")
    row = licences.scan_licences(two, model).first()
    assert (row["families"], row["n_notices"], row["first_paragraph"]) == ("CC-BY-NC-4.0,MIT", 2, 50)
    assert licences.scan_licences(empty, model).count() == 0


def test_licence_notices_side_by_side(spark):
    model = licences.train()
    pairs = [(f, g) for f in licences.TEMPLATES for g in licences.TEMPLATES if f != g]
    for f, g in pairs:
        for s in licences.TEMPLATES[f]:
            for t in licences.TEMPLATES[g]:
                assert {h[1] for h in model.scan(s + " " + t)} == {f, g}, (s, t)
    both = "Released under the MIT License. Licensed under the Apache License, Version 2.0."
    assert [h[1] for h in model.scan(both)] == ["MIT", "Apache-2.0"]
    assert {h[1] for h in model.scan("Licensed under the Apache License, Version 2.0 or the MIT License.")} == {"MIT", "Apache-2.0"}
    row = licences.scan_licences(spark.createDataFrame([(1, both)], "doc_id long, text string"), model).first()
    assert (row["families"], row["n_notices"], row["first_paragraph"]) == ("Apache-2.0,MIT", 2, 0)


def test_licence_notices_wrapped(spark):
    model = licences.train()
    for family, templates in licences.TEMPLATES.items():
        for t in templates:
            for lead in ("", "# ", " * "):
                wrapped = textwrap.fill(t, 72, initial_indent=lead, subsequent_indent=lead)
                for end in ("\n", "\r\n"):
                    assert [h[:2] for h in model.scan(("Before.\n\n" + wrapped + "\n\nAfter.").replace("\n", end))] == [(2, family)]
    assert model.scan("Licensed under the Apache\n\nLicense, Version 2.0.") == []  # notices end at blank lines
    assert [h[:2] for h in model.scan("Released under\n\nthe MIT License.")] == [(2, "MIT")]  # its name is a template of its own
    mit = "intro\n" + textwrap.fill(licences.TEMPLATES["MIT"][2], 72)
    row = licences.scan_licences(spark.createDataFrame([(1, mit)], "doc_id long, text string"), model).first()
    assert (row["families"], row["n_notices"], row["first_paragraph"]) == ("MIT", 1, 1)


@pytest.mark.parametrize("n", [0, 1, 3, 130, 5000])
@pytest.mark.parametrize("kind", ["same", "noise", "mixed"])
def test_codecs_round_trip(n, kind):
    rng = random.Random(n)
    data = bytes(65 if kind == "same" or kind == "mixed" and rng.random() < 0.8 else rng.randrange(256) for _ in range(n))
    assert tiff.packbits_decode(tiff.packbits_encode(data), n) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), n) == data


def test_tiff_tiles_strips_and_orders():
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (37, 50), dtype=np.uint8)
    pages = [{"pixels": pixels, "compression": c, "predictor": p} | how for c in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS) for p in (1, 2) for how in ({"rows_per_strip": 8}, {"tile": (16, 32)})]
    found = list(tiff.read_tiff(tiff.write_tiff(pages)))
    assert len(found) == 16 and all((f["pixels"][:, :, 0] == pixels).all() for f in found)
    # big-endian, 16 bits, two planes, horizontal differences
    deep = rng.integers(0, 65536, (4, 6, 2), dtype=np.uint16)
    planes = [np.diff(deep[:, :, i].astype(np.int64), axis=1, prepend=0).astype(np.uint16).astype(">u2").tobytes() for i in range(2)]
    fields = [(256, 6), (257, 4), (258, 16), (259, 8), (277, 2), (278, 4), (284, 2), (317, 2)]
    packed = [zlib.compress(p) for p in planes]
    at = 8 + len(packed[0]) + len(packed[1])
    body = b"".join(packed) + struct.pack(">2I", 8, 8 + len(packed[0])) + struct.pack(">2I", *map(len, packed))
    entries = sorted([struct.pack(">HHII", t, 4, 1, v) for t, v in fields] + [struct.pack(">HHII", 273, 4, 2, at), struct.pack(">HHII", 279, 4, 2, at + 8)])
    data = b"MM\0*" + struct.pack(">I", 8 + len(body)) + body + struct.pack(">H", len(entries)) + b"".join(entries) + b"\0\0\0\0"
    assert (next(tiff.read_tiff(data))["pixels"] == deep).all()


def test_tiff_pages_and_damage(spark):
    good = tiff.text_to_tiff(tiff.payload_of("hello " * 500)[0])
    ring = bytearray(good)
    struct.pack_into("<I", ring, len(ring) - 4, struct.unpack_from("<I", ring, 4)[0])
    rows = [(1, bytearray(good)), (2, None), (3, bytearray(b"")), (4, bytearray(b"junk")), (5, bytearray(good[:-40])), (6, ring)]
    got = tiff.decode_pages(spark.createDataFrame(rows, "doc_id long, media binary"), "doc_id", "media").collect()
    of = lambda i: [r for r in got if r["doc_id"] == i]
    assert [r["page"] for r in of(1)] == [0, 1, 2] and b"".join(bytes(r["pixels"]) for r in of(1)).startswith(b"hello ")
    assert of(2) == of(3) == [] and of(4)[0]["error"] and of(5)[-1]["error"] and "ring" in of(6)[-1]["error"]


def test_tiff_digests(docs, empty):
    rows = list(by_text(tiff.text_digests(docs), docs).values())
    for (_, text), row in zip(ordered(), rows, strict=True):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (row["n_bytes"], row["payload_bytes"]) == (len(raw), len(payload))
        assert row["payload_sha256"] == hashlib.sha256(payload).hexdigest() and row["tail_crc32"] == zlib.crc32(payload[-32:])
    assert tiff.text_digests(empty).count() == 0


def test_codecs_read_foreign_bytes():
    """The examples of the format's specification and of the packing's technical note."""
    spec = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.lzw_decode(bytes.fromhex("8001e0408044080c068080"), 9) == spec == tiff.lzw_decode(tiff.lzw_encode(spec), 9)
    packed, plain = "feaa0280002afdaa0380002a22f7aa", "aa" * 3 + "80002a" + "aa" * 4 + "80002a22" + "aa" * 10
    assert tiff.packbits_decode(bytes.fromhex(packed), 24).hex() == plain


def slow_lzw(data):
    """Codes one by one, as text of bits: an encoder that shares nothing with the operator's."""
    table, bits, width, word = {bytes((i,)): i for i in range(256)}, [f"{256:09b}"], 9, b""
    following = 258
    for i in range(len(data)):
        if word + data[i : i + 1] in table:
            word += data[i : i + 1]
            continue
        bits.append(f"{table[word]:0{width}b}")
        table[word + data[i : i + 1]] = following
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        if following == 4095:
            bits.append(f"{256:012b}")
            table, following, width = {bytes((i,)): i for i in range(256)}, 258, 9
        word = data[i : i + 1]
    if word:
        bits.append(f"{table[word]:0{width}b}")
        width = 9 if following + 1 < 512 else 10 if following + 1 < 1024 else 11 if following + 1 < 2048 else 12
    text = "".join(bits) + f"{257:0{width}b}"
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


@pytest.mark.parametrize("n", [1, 252, 253, 254, 255, 700, 764, 765, 766, 5000, 30000])
def test_lzw_agrees_with_a_slow_encoder(n):
    rng = random.Random(n)
    for data in (rng.randbytes(n), bytes(rng.choice(b"the quick brown fox") for _ in range(n))):
        assert tiff.lzw_decode(slow_lzw(data), n) == data


def test_tiff_shallow_and_float_samples():
    rng = np.random.default_rng(2)
    for bits in (1, 2, 4):
        pixels = rng.integers(0, 1 << bits, (5, 11), dtype=np.uint8)
        rows = b"".join(np.packbits(np.unpackbits(row[:, None], axis=1)[:, 8 - bits :].reshape(-1)).tobytes() for row in pixels)
        assert (next(tiff.read_tiff(one_strip(rows, 11, 5, bits)))["pixels"][:, :, 0] == pixels).all()
    floats = rng.normal(size=(3, 7)).astype(">f4")
    planes = np.frombuffer(floats.tobytes(), np.uint8).reshape(3, 7, 4).transpose(0, 2, 1).reshape(3, 28)
    rows = np.concatenate((planes[:, :1], np.diff(planes, axis=1)), axis=1).tobytes()
    assert (next(tiff.read_tiff(one_strip(rows, 7, 3, 32, (317, 3), (339, 3))))["pixels"][:, :, 0] == floats).all()
    for fields in ([(256, 0)], [(277, 0)], [(317, 9)], [(266, 2)], [(258, 13)], [(259, 77)], [(278, 0)]):
        with pytest.raises(tiff.TiffError):
            list(tiff.read_tiff(one_strip(b"\0" * 8, 8, 1, 8, *fields)))


def one_strip(data, width, height, bits, *more):
    """A file of one uncompressed strip; ``more`` fields replace the usual ones."""
    fields = {256: width, 257: height, 258: bits, 259: 1, 262: 1, 273: 8, 277: 1, 278: height, 279: len(data)} | dict(more)
    head = b"II*\0" + struct.pack("<I", 8 + len(data) + len(data) % 2)
    entries = b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in sorted(fields.items()))
    return head + data + b"\0" * (len(data) % 2) + struct.pack("<H", len(fields)) + entries + b"\0\0\0\0"


def test_damaged_files_are_tiff_errors():
    rng, good = random.Random(9), tiff.text_to_tiff(tiff.payload_of("damage " * 300)[0])
    empty = bytearray(one_strip(b"\0" * 8, 8, 1, 8))
    at = struct.unpack_from("<I", empty, 4)[0] + 2
    struct.pack_into("<I", empty, at + 4, 0)  # a width of no values
    tried = [bytes(empty)]
    for _ in range(400):
        bad = bytearray(good)
        for _ in range(rng.randrange(1, 6)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        tried.append(bytes(bad[: rng.randrange(len(bad))] if rng.random() < 0.2 else bad))
    for data in tried:
        try:
            for _ in tiff.read_tiff(data):
                pass
        except tiff.TiffError:
            pass


NOTICES = {
    "MIT": """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:""",
    "Apache-2.0": """Copyright 2019 Somebody Else

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-3-Clause": """Copyright (c) 2001, The Owner. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.""",
    "GPL-3.0": """This file is part of Something.

This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
}


@pytest.mark.parametrize("lead", ["", "# ", " * ", "// "])
@pytest.mark.parametrize("family", NOTICES)
def test_whole_notices_as_they_stand_in_files(family, lead):
    """Notices as files hold them, wrapped: their words go beyond the templates'."""
    model = licences.train()
    wrapped = "\n\n".join(textwrap.fill(p, 72, initial_indent=lead, subsequent_indent=lead) for p in NOTICES[family].split("\n\n"))
    assert {h[1] for h in model.scan("import this\n\n" + wrapped + "\n\ndef main(): pass\n")} == {family}


def test_licence_tags_and_every_paragraph():
    model = licences.train()
    for family in licences.TEMPLATES:
        assert [h[:2] for h in model.scan(f"#!/bin/sh\n# {licences.TAG}{family}\n\nexit 0\n")] == [(1, family)]
    far = "plain words of a long text " * 4000 + "\n\nReleased under the ISC License.\n\n" + "and more of them " * 4000
    assert [h[:2] for h in model.scan(far)] == [(2, "ISC")]
    # windows are chosen by the model alone: what it finds likely is the same for the words by themselves
    words = licences.words_of("nothing here " * 30 + "licensed under cc by 4.0. " + "nor here " * 30)
    assert any(model.families[f] == "CC-BY-4.0" and a <= 60 < b for a, b, f in model.likely(words))
