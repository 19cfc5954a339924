"""Each operator against a brute-force version, an exact round trip or held-out labels, and on awkward tables."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logframe.llm import bpe, chat, components, decontaminate, media, secret_scan, sharding, simhash, token_counts
from tests.llm.conftest import clashing

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- sharding
def slow_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_by_the_book():
    keys = sharding.mix64(np.arange(2000))
    for n in (1, 2, 24, 25):
        assert sharding.jump_hash(keys, n).tolist() == [slow_jump(int(k), n) for k in keys]


def test_sharding(odd, empty, documents):
    for df in (odd, documents, clashing(odd)):
        got = sharding.shard_rows(df, 24).collect()
        assert len(got) == df.count()
        by = {}
        for r in got:
            by.setdefault(r.shard, []).append(r.slot)
            assert r.grown_shard in (r.shard, 24)
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
    null = [r for r in sharding.shard_rows(odd, 24).collect() if r.doc_id == 2][0]
    assert (null.size, null.text_crc32) == (8, 0)
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id].encode()) + 8 for r in sharding.shard_rows(documents, 24).collect())
    assert rows(sharding.shard_rows(empty, 24)) == []


# --- decontamination
def slow_windows(texts, items, n=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(decontaminate.ascii_lower.__globals__["UPPER"], decontaminate.ascii_lower.__globals__["LOWER"])))
    wins = {}
    for i, t in items:
        w = split(t)
        for s in range(max(1, len(w) - n + 1)) if w else ():
            wins.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    for d, t in texts:
        w, hit, ids = split(t), set(), set()
        for s in range(len(w)):
            for k in {len(x) for x in wins}:
                if (found := wins.get(tuple(w[s : s + k]))) and s + k <= len(w):
                    hit |= set(range(s, s + k))
                    ids |= found
        yield (d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_SHINGLES, 0])
def test_decontamination(spark, odd, empty, bound, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", bound)
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice("a b c d É 1".split()) for _ in range(rng.randrange(60)))) for i in range(60)] + [(3, "a b c"), (3, "a b c"), (None, "b"), (5, None), (6, "")]
    items = [(i, " ".join(rng.choice("a b c d é".split()) for _ in range(k))) for i, k in enumerate((1, 2, 3, 4, 11, 12, 0))] + [(9, None), (10, "b b b b b b b b b b b"), (11, "A")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(rows(decontaminate.decontaminate(spark.createDataFrame(texts, "doc_id long, text string"), bench)), key=repr)
    assert got == sorted(slow_windows(texts, items), key=repr)
    assert decontaminate.decontaminate(clashing(odd), bench).count() == odd.count()
    assert rows(decontaminate.decontaminate(empty, bench)) == []
    assert not any(r.contaminated for r in decontaminate.decontaminate(odd, bench.limit(0)).collect())
    assert decontaminate.drop_contaminated(odd, bench.limit(0)).count() == odd.count()


# --- media
def test_images():
    rng = np.random.default_rng(0)
    for shape in ((1, 1, 3), (13, 7, 3), (5, 64, 3)):
        x = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (media.decode_image(media.encode_ppm(x)) == x).all() and (media.decode_image(media.encode_bmp(x)) == x).all()
        assert (media.decode_image(media.encode_ppm(x[:, :, 0])) == x[:, :, 0]).all()
        assert np.allclose(media.area_resize(x, *shape[:2]), x)
        big = media.area_resize(x, 3, 4)
        fine = np.repeat(np.repeat(x.astype(float), 3 * 4, axis=0), 3 * 4, axis=1)
        h, w = fine.shape[:2]
        assert np.allclose(big, fine.reshape(3, h // 3, 4, w // 4, 3).mean(axis=(1, 3)))
    assert media.decode_image(b"P1\n# c\n2 2\n1 0 0 1\n").tolist() == [[0, 255], [255, 0]]
    assert media.decode_image(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode_image(b"P2 2 1 3 0 3").tolist() == [[0, 255]]
    assert media.difference_hash(np.tile(np.arange(90, dtype=np.uint8), (8, 1))) == "f" * 16
    tile = np.load(__import__("io").BytesIO(media.npy_tile(np.full((4, 4, 3), 9, np.uint8))))
    assert tile.shape == (32, 32, 3) and (tile == 9).all()


def weights(n, cells):
    """How much of each of ``cells`` equal stretches of 0..n every unit interval covers."""
    edges = np.arange(cells + 1) * n / cells
    i = np.arange(n)
    return np.clip(np.minimum(edges[1:, None], i + 1) - np.maximum(edges[:-1, None], i), 0, None)


def slow_resize(pixels, h, w):
    return np.stack([weights(pixels.shape[0], h) @ p @ weights(pixels.shape[1], w).T for p in np.moveaxis(pixels.astype(float), 2, 0)], axis=2) / (pixels.shape[0] / h * pixels.shape[1] / w)


def slow_media(text):
    raw = (text or "").encode()
    payload = raw + b" " * (-len(raw) % 192 if raw else 192)
    stored = f"P6\n64 {len(payload) // 192}\n255\n".encode() + payload
    pixels = np.array(list(payload), dtype=np.uint8).reshape(-1, 64, 3)
    grey = np.round(slow_resize((pixels @ np.array([0.299, 0.587, 0.114]))[:, :, None], 8, 9)[:, :, 0], 6)
    bits = "".join("01"[int(a < b)] for row in grey for a, b in zip(row, row[1:]))
    tile = __import__("io").BytesIO()
    np.save(tile, np.rint(np.round(slow_resize(pixels, 32, 32), 6)).astype(np.uint8))
    feature = f"{int(bits, 2):016x}" + hashlib.sha256(tile.getvalue()).hexdigest()[:16]
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


def test_media(spark, odd, empty, documents):
    for df in (odd, documents):
        want = sorted(((r.doc_id, *slow_media(r.text)) for r in df.collect()), key=repr)
        assert sorted(rows(media.text_media(df)), key=repr) == want
    assert media.text_media(clashing(odd)).count() == odd.count() and rows(media.text_media(empty)) == []
    blobs = spark.createDataFrame([(1, media.encode_bmp(np.zeros((3, 3, 3), np.uint8))), (2, b"junk"), (3, None), (4, b"P6\n9 9\n255\nxx")], "id int, media binary")
    out = {r.id: r for r in media.decode_media(blobs.withColumn("width", F.lit("clash"))).collect()}
    assert (out[1].width, out[1].height, out[1].error) == (3, 3, None) and all(out[i].error and out[i].tile is None for i in (2, 3, 4))
    assert (np.load(__import__("io").BytesIO(out[1].tile)) == 0).all()


def test_broken_media_never_end_a_job(spark):
    x = np.arange(60, dtype=np.uint8).reshape(4, 5, 3)
    plain = b" ".join(b"%d" % v for v in x.ravel())
    head = lambda size, w, h, bits, offset: b"BM" + __import__("struct").pack("<IIIIiiHHIIiiII", size, 0, offset, 40, w, h, 1, bits, 0, 0, 0, 0, 0, 0)
    whole = [
        b"P1\n3 2\n101010\n", b"P2\n5 4\n255\n" + plain, b"P3\n5 4\n255\n" + plain, b"P4\n9 2\n\xa0\x80\xff\x00", media.encode_ppm(x[:, :, 0]), media.encode_ppm(x), b"P5 2 2 9999\n" + bytes(range(8)),
        media.encode_bmp(x), head(0, 4, -2, 8, 54 + 1024) + bytes(1024) + bytes(8), head(0, 2, 2, 32, 54) + bytes(16),
    ]
    odd_heads = [
        b"P6\n", b"P5 3", b"P5\n0 0\n255\n", b"P6 2 2 0 " + bytes(12), b"P6 99999999999 9 255 x", b"P6 99999 99999 255 x", b"P2 2 1 3 9 1", b"P5 -1 1 255 x", head(0, 2**30, 2**30, 24, 54), head(0, -4, 2, 24, 54) + bytes(99),
        head(0, 4, 2, 8, 2**31) + bytes(99), head(0, 4, 2, 8, 20) + bytes(99), head(0, 2, -(2**31), 24, 54), b"P7\n1 1", b"P", b"BM", b"", b"P3 1 1 255 1 2 x",
    ]
    blobs = [(len(w) == n, w[:n]) for w in whole for n in range(len(w) + 1)] + [(False, d) for d in odd_heads]
    got = media.decode_media(spark.createDataFrame(blobs, "ok boolean, media binary")).collect()
    assert len(got) == len(blobs) and all(r.error is None and r.tile for r in got if r.ok)
    # a cut text format may end between two samples' digits; all else that is cut has too few samples
    assert all(r.error and r.tile is None for r in got if not r.ok and not bytes(r.media).startswith((b"P1", b"P2", b"P3")))
    assert all((r.error is None) == (r.tile is not None) for r in got)


# --- byte pairs
ODD_TEXTS = [
    "Hello World's ünï 123  x<|endoftext|>y é <|startoftext|> İ ΣΑΣ", "", None, "<|ENDOFTEXT|> aaaaaaa aaaaaaaaa ǅ 日本 é \x1c a\x1db ​ a b", "'S 'LL don't 1234 ½ ² ٣ \U0001f600\U0001f600 \x00 \x7f ab\x85cd\xa0ef  ",
    "x<|endoftext|", "Å ﬁ ẞ ǆ Ⅷ ⅷ", "a" * 3000, "\n", "\x1c\x1d",
]


def test_bpe(spark, documents, odd, empty):
    lib = Tokenizer.from_file(WORDS)

    def want(t):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        return len(ids), " ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False)

    assert list(bpe.codec(WORDS).texts(ODD_TEXTS)) == [want(t) for t in ODD_TEXTS]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for df in (documents, odd, clashing(odd)):
        expect = sorted(((d, n, sha(i), sha(b)) for d, t in df.select("doc_id", "text").collect() for n, i, b in [want(t)]), key=repr)
        assert sorted(rows(bpe.token_digests(df, WORDS)), key=repr) == expect
    back = bpe.decode(bpe.encode(odd, WORDS), WORDS).collect()
    assert all(r.decoded == want(r.text)[2] and r.n_tokens == len(r.ids) for r in back)
    assert rows(bpe.encode(empty, WORDS)) == []


# --- secrets
def test_secrets(spark, documents, odd, empty):
    language, forest = secret_scan.fit(documents)
    assert rows(secret_scan.scan(empty, language, forest)) == [] and secret_scan.scan(clashing(odd), language, forest).count() == odd.count()
    key = hashlib.sha1(b"x").hexdigest()
    texts = [(1, f'set token = "{key}" here'), (2, "card 4734663219866878 only"), (3, "einungtzheitgeungverlich"), (4, f'commit: "{key}"'), (5, f'password="{key[:20]}"')]
    found = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(texts, "doc_id long, text string"), language, forest).collect()}
    assert {i: r.n_secrets for i, r in found.items()} == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1} and found[1].spans == [f"13-{13 + 40}"]
    clean = secret_scan.redact(documents, language, forest)
    assert clean.filter(F.col("text").rlike('(?i)token = "[0-9a-f]{40}"')).count() == 0 and clean.count() == documents.count()
    assert clean.filter(F.col("n_chars") != F.length("text")).count() == 0


# --- near duplicates
def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(pairs, distance=4):
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, f) in enumerate(pairs):
        for j in range(i):
            if (f ^ pairs[j][1]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, f"{f:016x}", least[find(i)]) for i, (d, f) in enumerate(pairs)), key=repr)


def test_simhash(spark, documents, odd, empty):
    for df in (documents, odd, clashing(odd)):
        pairs = [(d, slow_fingerprint(t)) for d, t in df.select("doc_id", "text").collect()]
        assert sorted(rows(simhash.simhash_groups(df)), key=repr) == slow_groups(pairs)
    assert rows(simhash.simhash_groups(empty)) == []
    kept = simhash.keep_one(clashing(odd))
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None) == sorted(
        (False, r.doc_id, r.text) for r in odd.distinct().collect() if r.doc_id in (1, 2, 4, 8)
    )


@pytest.mark.parametrize("segments", [simhash.SEGMENTS_SMALL, simhash.SEGMENTS_LARGE])
def test_links_of_dense_groups(spark, segments):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(4)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for c in centres for _ in range(120)} | {rng.getrandbits(64) for _ in range(200)}
    signed = sorted(v - 2**64 if v >= 2**63 else v for v in values)
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = simhash.links(fps, segments=segments, chunk=50)
    got = {r.node: r.root for r in components.connected(found).collect()}
    want = slow_groups([(v, v % 2**64) for v in signed])
    roots = {d: least for d, _, least in want}
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert groups({v: got.get(v, v) for v in signed}) == groups(roots)


# --- chat
def test_chat_parts(spark):
    parts = [{"type": "text", "text": "see </turn> "}, {"type": "image", "uri": "a.png", "width": 28, "height": 15}, None, {"type": "audio", "uri": "b.wav", "seconds": 1.5}, {"type": "document", "uri": "c.pdf", "pages": 2}]
    piece, begin, end, found = chat.format_turn("user", parts)
    assert piece == "<turn user>see \\</turn\\> <attachment image 0><attachment audio 1><attachment document 2></turn>\n"
    assert piece[begin:end].startswith("see") and [a["tokens"] for a in found] == [4, 75, 1024]
    assert list(chat.read_turns(piece * 2)) == [("user", "see </turn> ")] * 2
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["\\", "<", ">", "</turn>", "<turn user>", "x", "\n", "<attachment image 0>"]) for _ in range(rng.randrange(12)))
        assert list(chat.read_turns(chat.format_turn(text, [{"type": "text", "text": text}])[0])) == [(text, text)]
    piece, _, _, found = chat.format_turn("user", [{"type": "smell", "uri": "s"}, {"type": "a> <b"}, {"type": "unknown"}, {"type": "attach"}])
    assert piece == "<turn user><attachment smell 0><attachment a___b 1><attachment unknown 2><attachment attach 3></turn>\n"
    assert [(a["type"], a["uri"], a["tokens"]) for a in found][:2] == [("smell", "s", 1), ("a___b", None, 1)] and list(chat.read_turns(piece)) == [("user", "")]


def test_chat_table(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", None), (None, 0, "user", "x"), (1, 2, None, "<"), (2, 0, "assistant", "é\\"), (2, 0, "assistant", "é\\")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(chat.text_parts(chat.with_test_conversation(turns)))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\nb\n\n<\n") and got[1].loss_sha256 == sha("b")
    assert (got[2].n_turns, got[2].loss_chars) == (2, 4) and got[-7].loss_sha256 == sha(chat.TEST_TURN) and None in got
    assert got[-7].turns_sha256 == sha(f"user\n{chat.TEST_TURN}\nassistant\n{chat.TEST_TURN}\n")
    assert rows(chat.digests(chat.format_conversations(chat.text_parts(turns.limit(0))))) == []


# --- token counts
def test_token_counts(documents, odd, empty):
    lib = Tokenizer.from_file(BYTES)
    want = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    whole, cut = token_counts.Counter(BYTES), token_counts.Counter(BYTES, chunk=200, overlap=8)
    rng = random.Random(1)
    made = ["".join(rng.choice(["a", "b ", "  ", "\n", "é", "1", " ", "'s", "!", "\x1c", "\x85", "日", "<|endoftext|>", "　", "​"]) for _ in range(rng.randrange(900))) for _ in range(80)]
    for t in [*ODD_TEXTS, "x" * 5000, " " * 5000 + "a", "word " * 3000, *made]:
        assert whole.count(t) == cut.count(t) == want(t)
    for df in (documents, odd, clashing(odd)):
        expect = sorted(((d, len((t or "").encode()), want(t), want(t) > 1024) for d, t in df.select("doc_id", "text").collect()), key=repr)
        assert sorted(rows(token_counts.count_tokens(df, BYTES)), key=repr) == expect
    assert rows(token_counts.count_tokens(empty, BYTES)) == []


def test_other_tokenizer_files_are_refused(tmp_path):
    spec = json.loads(open(BYTES, encoding="utf-8").read())
    token_counts.check_spec(spec)
    other = [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "use_regex": False}},
             {"model": {**spec["model"], "end_of_word_suffix": "</w>"}}, {"model": {**spec["model"], "ignore_merges": True}}, {"added_tokens": [{**spec["added_tokens"][0], "lstrip": True}]}]
    for change in other:
        with pytest.raises(ValueError, match="byte-level"):
            token_counts.check_spec({**spec, **change})
    with pytest.raises(ValueError):
        token_counts.encoder(WORDS)
