"""BPE against the tokenizers library, media against a general encoder and exact round trips."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerleaf.llm import bpe, media, queries_bytes

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", "a", " ", "   ", "hello  world\n\n x", "<|endoftext|>", "a<|endoftext|> b", "don't we'll 12 34é 日本 😀", "x" * 300, "ab" * 700, "a\x1cb\x1d\x85z", "!?" * 200, " " * 90 + "q"]


def test_bpe_equals_the_library(docs):
    rng = random.Random(3)
    noise = ["".join(chr(rng.choice([rng.randint(0, 127), rng.randint(128, 0x2FFF), 32, 10])) for _ in range(rng.randint(0, 90))) for _ in range(300)]
    texts = TEXTS + noise
    got = {r.doc_id: r for r in bpe.encode_and_decode(docs(list(enumerate(texts))), PATH, keep=("lang",)).collect()}
    library = Tokenizer.from_file(PATH)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids and got[i].decoded == library.decode(ids, skip_special_tokens=False) == (t or "") and got[i].lang == "en"


def test_bpe_empty_table_and_repeated_rows(docs):
    assert bpe.encode_and_decode(docs([]), PATH).count() == 0
    rows = bpe.encode_and_decode(docs([(1, "same"), (1, "same"), (None, "x")]), PATH).collect()
    assert len(rows) == 3 and rows[0].ids == rows[1].ids


def test_forgetting_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    vocab = bpe.Vocabulary(PATH)
    encoder, texts = bpe.Encoder(vocab), ["one two three", "two four five six", "one seven"]
    assert [encoder.encode([t])[0] for t in texts] == bpe.Encoder(vocab).encode(texts)


@pytest.mark.parametrize("blocks", [1, 2, 6, 7, 31])
def test_payloads_survive(blocks):
    payload = np.random.RandomState(blocks).bytes(64 * blocks)
    stored = media.store_payload(payload)
    image = media.read_progressive(stored)
    assert media.stored_payload(image) == payload
    assert media.to_rgb(image).shape == (image.height, image.width, 3)


def test_reading_side_by_side_and_bit_by_bit_agree(monkeypatch):
    rng = np.random.RandomState(1)
    payloads = [rng.bytes(64 * n) for n in (1, 13, 150)] + [b"plain text of letters ".ljust(640, b"e"), b"\xff" * 128]
    files = media.store_many(payloads)
    assert files == [media.store_payload(x) for x in payloads]
    monkeypatch.setattr(media, "FEW_LANES", 0)
    fast = media.read_many(files)
    monkeypatch.setattr(media, "FEW_LANES", 1 << 60)
    slow = media.read_many(files)
    for x, y, payload in zip(fast, slow, payloads, strict=True):
        assert all((c.coefficients == d.coefficients).all() for c, d in zip(x.components, y.components, strict=True))
        assert media.stored_payload(x) == media.stored_payload(y) == payload


@pytest.mark.parametrize("few", [0, 1 << 60])
def test_a_broken_file_spoils_no_other(monkeypatch, few):
    monkeypatch.setattr(media, "FEW_LANES", few)
    good = media.store_payload(b"x" * 6400)
    scan = good.index(b"\xff\xda") + 12
    files = [good, good[: len(good) // 3], good[:scan] + b"\xfe" * 40 + good[scan + 40 :], b"", b"\xff\xd8\xff", good[:scan] + good[scan + 30 :], good]
    images = media.read_many(files, strict=False)
    assert [media.stored_payload(x) if x else None for x in (images[0], images[-1])] == [b"x" * 6400] * 2
    assert not any(images[1:5]) and (images[5] is None or media.stored_payload(images[5]) != b"x" * 6400)
    with pytest.raises(ValueError):
        media.read_many(files)


def test_large_payloads_make_wider_images(monkeypatch):
    monkeypatch.setattr(media, "ACROSS", 2)
    monkeypatch.setattr(media, "MOST_UNITS", 5)
    sizes = {}
    for blocks in (1, 12, 60, 61, 150):
        payload = np.random.RandomState(blocks).bytes(64 * blocks)
        image = media.read_progressive(media.store_payload(payload))
        assert media.stored_payload(image) == payload
        sizes[blocks] = image.width // 16, image.height // 16
    assert sizes == {1: (1, 1), 12: (2, 1), 60: (2, 5), 61: (3, 4), 150: (5, 5)}
    with pytest.raises(ValueError):
        media.store_payload(bytes(64 * 151))


class BitWriter:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def bytes(self):
        return np.packbits(self.bits + [1] * (-len(self.bits) % 8)).tobytes().replace(b"\xff", b"\xff\x00")


def signed(out, value):
    size = abs(int(value)).bit_length()
    out.put(int(value) if value >= 0 else int(value) + (1 << size) - 1, size)


def general_jpeg(planes, width, height, restart=0):
    """A progressive file of sparse coefficients with zero runs, end-of-band runs and refinement: code = symbol, 8 bits and a zero."""
    codes = lambda kind: media._segment(0xC4, bytes([kind << 4, *[0] * 8, 255, *[0] * 7, *range(255)]))
    sampling = [(2, 2), (1, 1), (1, 1)][: len(planes)]
    frame = media.struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))
    out = [b"\xff\xd8", media._QUANT, media._segment(0xC2, frame), codes(0), codes(1)]
    symbol = lambda w, s: w.put(s, 9)
    across, down = -(-width // (8 * sampling[0][0])), -(-height // (8 * sampling[0][1]))
    for high, low in ((0, 1), (1, 0)):  # DC, interleaved
        w, before = BitWriter(), [0] * len(planes)
        for m in range(across * down):
            y, x = divmod(m, across)
            for k, ((h, v), plane) in enumerate(zip(sampling, planes, strict=True)):
                for j in range(v):
                    for i in range(h):
                        dc = int(plane[(y * v + j) * across * h + x * h + i, 0])
                        if high:
                            w.put(dc & 1, 1)
                        else:
                            size = abs((dc >> 1) - before[k]).bit_length()
                            symbol(w, size)
                            signed(w, (dc >> 1) - before[k])
                            before[k] = dc >> 1
        body = bytes([len(planes), *(b for k in range(len(planes)) for b in (k + 1, 0)), 0, 0, high << 4 | low])
        out += [media._segment(0xDA, body), w.bytes()]
    for k, plane in enumerate(planes):
        h, v = sampling[k]
        c_across, c_down = -(-(-(-width * h // sampling[0][0])) // 8), -(-(-(-height * v // sampling[0][1])) // 8)
        blocks = [plane[y * across * h + x] for y in range(c_down) for x in range(c_across)]
        for first, last in ((1, 5), (6, 63)):
            w, run = BitWriter(), 0

            def flush(w, run):
                if run:
                    n = run.bit_length() - 1
                    symbol(w, n << 4)
                    w.put(run - (1 << n), n)
                return 0

            for b in blocks:
                zeros = 0
                kept = [(j, int(np.sign(b[j])) * (abs(int(b[j])) >> 1)) for j in range(first, last + 1)]
                if not any(value for _, value in kept):
                    run += 1
                    continue
                run = flush(w, run)
                end = max(j for j, value in kept if value)
                for j, value in kept:
                    if j > end:
                        break
                    if not value:
                        zeros += 1
                        continue
                    while zeros > 15:
                        symbol(w, 0xF0)
                        zeros -= 16
                    symbol(w, zeros << 4 | abs(value).bit_length())
                    signed(w, value)
                    zeros = 0
                if end < last:
                    run = 1
            flush(w, run)
            out += [media._segment(0xDA, bytes([1, k + 1, 0, first, last, 1])), w.bytes()]
            w = BitWriter()
            for b in blocks:
                new = [j for j in range(first, last + 1) if abs(int(b[j])) == 1]
                end, zeros, held = (max(new) if new else first - 1), 0, []
                for j in range(first, end + 1):
                    value = int(b[j])
                    if abs(value) > 1:
                        held.append(abs(value) & 1)
                        continue
                    if value == 0:
                        if zeros == 15:
                            symbol(w, 0xF0)
                            for bit in held:
                                w.put(bit, 1)
                            held, zeros = [], 0
                        else:
                            zeros += 1
                        continue
                    symbol(w, zeros << 4 | 1)
                    w.put(int(value > 0), 1)
                    for bit in held:
                        w.put(bit, 1)
                    held, zeros = [], 0
                if end < last:
                    symbol(w, 0)
                    for bit in held:
                        w.put(bit, 1)
                    for j in range(end + 1, last + 1):
                        if abs(int(b[j])) > 1:
                            w.put(abs(int(b[j])) & 1, 1)
            out += [media._segment(0xDA, bytes([1, k + 1, 0, first, last, 0x10])), w.bytes()]
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize("few", [0, 1 << 60])
@pytest.mark.parametrize(("width", "height", "grey"), [(40, 23, False), (16, 16, False), (70, 33, True)])
def test_general_progressive_files(monkeypatch, width, height, grey, few):
    monkeypatch.setattr(media, "FEW_LANES", few)
    rng = np.random.RandomState(width)
    unit = 8 if grey else 16
    across, down = -(-width // unit), -(-height // unit)
    planes = []
    for h, v in [(1, 1)] if grey else [(2, 2), (1, 1), (1, 1)]:
        c = rng.randint(-9, 10, (across * h * down * v, 64)) * (rng.rand(across * h * down * v, 64) < 0.15)
        c[:, 0] = rng.randint(-300, 300, len(c))
        planes.append(c)
    if grey:  # one component is never interleaved: the sampling of one is its unit
        stored = general_jpeg_grey(planes[0], width, height)
    else:
        stored = general_jpeg(planes, width, height)
    image = media.read_progressive(stored)
    for c, plane in zip(image.components, planes, strict=True):
        rows = (np.arange(c.down)[:, None] * c.wide + np.arange(c.across)).ravel()
        assert (c.coefficients[rows] == plane[rows]).all()
    assert media.to_rgb(image).shape == (height, width, 3)


def general_jpeg_grey(plane, width, height):
    """DC scans of one component, with restarts; all AC coefficients are left out."""
    plane[:, 1:] = 0
    frame = media.struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0])
    codes = media._segment(0xC4, bytes([0, *[0] * 8, 255, *[0] * 7, *range(255)]))
    step, pieces = 4, []
    for lo in range(0, len(plane), step):
        w, before = BitWriter(), 0
        for dc in plane[lo : lo + step, 0]:
            size = abs(int(dc) - before).bit_length()
            w.put(size, 9)
            signed(w, int(dc) - before)
            before = int(dc)
        pieces.append(w.bytes() + bytes([0xFF, 0xD0 + lo // step % 8]))
    pieces[-1] = pieces[-1][:-2]
    return b"".join([b"\xff\xd8", media._QUANT, media._segment(0xC2, frame), codes, media._segment(0xDD, media.struct.pack(">H", step)), media._segment(0xDA, bytes([1, 1, 0, 0, 0, 0])), *pieces, b"\xff\xd9"])


def test_inverse_transform_is_the_cosine_sum():
    rng = np.random.RandomState(0)
    flat = rng.randint(-50, 50, 64)
    natural = np.zeros(64)
    natural[media.zigzag_order()] = flat
    f = natural.reshape(8, 8)
    scale = lambda k: np.sqrt(0.5) if k == 0 else 1.0
    want = [[sum(scale(u) * scale(v) * f[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4 for x in range(8)] for y in range(8)]
    assert np.allclose(flat @ media.INVERSE, np.ravel(want), atol=1e-2)


def test_media_tables(spark, docs):
    rows = docs([(1, None), (2, ""), (3, "abc"), (3, "abc"), (4, "é" * 5000)])
    stored = media.store_texts(rows)
    read = {r.doc_id: r for r in media.read_media(stored).collect()}
    assert read[1].payload == read[2].payload == bytes(64) and bytes(read[3].payload) == b"abc".ljust(64, b"\0")
    assert bytes(read[4].payload)[:10000] == ("é" * 5000).encode() and len(read[4].rgb) == read[4].width * read[4].height * 3
    broken = spark.createDataFrame([(1, b"nope"), (2, None)], "doc_id bigint, media binary")
    assert all(r.rgb is None and r.height is None for r in media.read_media(broken, strict=False).collect())
    assert media.store_texts(docs([])).count() == 0
    with pytest.raises(ValueError):
        media.read_media(stored.withColumn("height", stored.n_bytes), keep=("height",))


def test_very_long_texts_round_trip(spark, docs):
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) for _ in range(150_000))
    rows = docs([(1, text), (2, "short")])
    (got,) = bpe.encode_and_decode(rows, PATH).where("doc_id = 1").collect()
    assert got.decoded == text and list(got.ids) == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    (read,) = media.read_media(media.store_texts(rows), tensors=False).where("doc_id = 1").collect()
    assert bytes(read.payload)[: len(text)] == text.encode()


def test_queries_round_trip(spark, small):
    import hashlib
    import zlib

    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries_bytes.op9_media_columns(spark, small).collect():
        raw = texts[r.doc_id]
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stored = media.store_payload(payload)
        rgb = media.to_rgb(media.read_progressive(stored))
        assert (r.media_bytes, r.media_sha256, r.tensor_sha256) == (len(stored), hashlib.sha256(stored).hexdigest(), hashlib.sha256(rgb.tobytes()).hexdigest())
        means = ",".join(f"{m:,.4f}" for m in rgb.reshape(-1, 3).astype(float).mean(0))
        assert r.feature == f"{rgb.shape[0]}x{rgb.shape[1]}x{means}"
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    library = Tokenizer.from_file(PATH)
    for r in queries_bytes.op6_bpe(spark, small).collect():
        ids = library.encode(texts[r.doc_id].decode(), add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id]).hexdigest()
