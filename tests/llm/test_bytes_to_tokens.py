import hashlib
import io
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import packing, simhash, tokenfile, tokens
from lodestone.llm.queries import vocabulary
from lodestone.llm.suffixes import suffix_arrays
from tests.llm.common import ROWS, docs

ODD = ["It's WE'LL <|endoftext|>x y 12ab3 é́ É İx ŸŽ ſ ß× ÷\r\nfoo\x1cbar don't''s …", "  \n\t ", "", "中文 ｆｕｌｌ éa ŉ Ǆ", "Σας ΣΑΣ", "a<|endoftext|> <|EndOfText|>"]


@pytest.fixture(scope="module")
def tok():
    return tokens.WordTokenizer(vocabulary())


def whole(tok, text):
    return np.array(tok.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("text", ODD)
def test_ids_are_the_librarys(tok, text):
    assert tok.encode(text) == whole(tok, text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(tok, text):
    assert tok.encode(text) == whole(tok, text)


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), min_size=1, max_size=120))))
def test_plans_place_every_piece_once(case):
    capacity, lengths = case
    want = Counter(lengths)
    plan = packing.plan(want, capacity)
    got = Counter()
    for pattern, n in plan:
        assert sum(w * k for w, k in pattern) <= capacity
        for w, k in pattern:
            got[w] += k * n
    assert got == want
    table = packing.lookup(plan)
    w = np.array([x for x, n in want.items() for _ in range(n)])
    r = np.array([i for _, n in want.items() for i in range(n)])
    held = defaultdict(list)
    for s, at, length in zip(*packing.place(table, w, r), w, strict=True):
        held[s].append((at, length))
    for pieces in held.values():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length


def exact_bins(lengths, capacity):
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    for seed in range(60):
        r = random.Random(seed)
        capacity = r.choice([10, 17, 30])
        lengths = sorted([r.randint(1, capacity) for _ in range(r.randint(1, 9))], reverse=True)
        fixed, left = packing.reduce_instance(Counter(lengths), capacity)
        rest = sorted(Counter(left).elements(), reverse=True)
        assert sum(n for _, n in fixed) + exact_bins(rest, capacity) == exact_bins(lengths, capacity)


def test_packing_of_odd_rows(spark, tok):
    got = packing.pack_documents(docs(spark), vocabulary(), 64, 0).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at <= 64
    assert sum(r["length"] for r in got) == sum(len(tok.encode(t or "")) // 4 + 1 for _, t, *_ in ROWS)
    assert packing.pack_documents(docs(spark, []), vocabulary(), 64, 0).count() == 0


def test_token_files_round_trip(spark, tok):
    got = tokenfile.token_files(docs(spark), vocabulary(), 1).collect()
    want = sorted(((i is not None, i or 0, t or "") for i, t, *_ in ROWS), key=lambda x: x[:2])
    at = 0
    assert len(got) == len(want)
    got.sort(key=lambda r: r["start"])
    for r, (_, i, t) in zip(got, want, strict=True):
        coded = tok.encode(t) + np.array([1], "<u4").tobytes()
        assert (r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(coded) // 4, zlib.crc32(coded))
        at += len(coded) // 4
    assert tokenfile.token_files(docs(spark, []), vocabulary(), 1).count() == 0


def test_frames_are_independent_and_checked():
    import zstandard

    out = io.BytesIO()
    w = tokenfile.Writer(out, frame_ids=100)
    texts = [np.arange(n, dtype="<u4").tobytes() for n in (5, 250, 0, 99, 100, 1)]
    for i, t in enumerate(texts):
        w.add(i if i else None, t)
    w.close()
    data = out.getvalue()
    r = tokenfile.Reader(io.BytesIO(data), len(data))
    assert [r.document(k) for k in (4, 1, 0, 2, 5, 3)] == [texts[k] for k in (4, 1, 0, 2, 5, 3)]
    assert r.doc_ids == [None, 1, 2, 3, 4, 5]
    assert zstandard.ZstdDecompressor().decompressobj().decompress(data[: int(r.packed[0])]) == texts[0]
    bad = bytearray(data)
    bad[int(r.where[1]) + int(r.packed[1]) // 2] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tokenfile.Reader(io.BytesIO(bytes(bad)), len(bad)).document(1)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=25), min_size=1, max_size=4))
def test_suffix_arrays(instances):
    instances = [[*x, 0] for x in instances]
    got, at = suffix_arrays(np.array([s for x in instances for s in x]), [len(x) for x in instances]), 0
    for x in instances:
        assert got[at : at + len(x)].tolist() == [at + i for i in sorted(range(len(x)), key=lambda i: x[i:])]
        at += len(x)


def test_simhash(spark):
    got = simhash.edited_fingerprints(docs(spark)).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == by[5]["fingerprint"] != by[6]["fingerprint"]
    six, five = ROWS[5][1], ROWS[4][1]
    k = len(six) // 3
    assert by[6]["edited_sha256"] == hashlib.sha256((six[: len(six) - k] + five[:k]).encode()).hexdigest()
    # the last row's successor is the first
    last, first = ROWS[3][1], ROWS[8][1]
    k = len(last) // 3
    assert by[None]["edited_sha256"] == hashlib.sha256((last[: len(last) - k] + first[:k]).encode()).hexdigest()
    assert simhash.edited_fingerprints(docs(spark, [])).count() == 0


def test_fingerprints_against_a_direct_program(spark):
    """Every term's votes on every bit, one by one; likeness from the bits that differ; rows within three bits by all pairs."""
    from lodestone.llm.textbytes import mix, prefix, span_hash

    r = random.Random(4)
    words_ = [f"w{i}" + "x" * r.randint(0, 12) for i in range(30)]
    base = [" ".join(r.choice(words_) for _ in range(r.choice([0, 1, 5, 90, 300]))) for _ in range(60)]
    texts = base + [t.replace("w1 ", "w2 ") for t in base] + base[:9]
    ids = list(range(0, 20 * len(texts), 20))[: len(texts) // 2]
    ids += [20 * i + 7 for i in range(len(texts) - len(ids))]

    def fingerprint(text):
        h = {}
        for w in set(text.split()):
            b = np.frombuffer(w.encode(), np.uint8)
            h[w] = span_hash(prefix(b, lower=True), np.array([0]), np.array([len(b)]))
        votes, before, long_ = [0] * 128, simhash._START, 0
        for w in text.split():
            term = mix(np.array([before], np.uint64) * np.uint64(3) + h[w])
            weight = min(3, 1 + (len(w) + long_) // 8)
            for k in range(2):
                hashed = mix(term + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)).tobytes()
                for byte in range(8):
                    for bit in range(8):
                        votes[64 * k + 8 * byte + bit] += weight if hashed[byte] >> (7 - bit) & 1 else -weight
            before, long_ = h[w][0], len(w)
        return sum(1 << (127 - k) for k, v in enumerate(votes) if v > 0)

    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    rows = simhash.edited_fingerprints(df).cache()
    got = {x["doc_id"]: x for x in simhash.with_neighbours(rows, F.col("doc_id") % 20 == 0, 3).collect()}
    own = dict(zip(ids, map(fingerprint, texts), strict=True))
    order = sorted(ids, reverse=True)
    text = dict(zip(ids, texts, strict=True))
    for k, i in enumerate(order):
        after = text[order[(k + 1) % len(order)]]
        cut = len(text[i]) // 3
        edited = fingerprint(text[i][: len(text[i]) - cut] + after[:cut])
        x = got[i]
        assert (int(x["fingerprint"], 16), int(x["edited_fingerprint"], 16), x["n_chars"]) == (own[i], edited, len(text[i]))
        for name, other in (("near_edited", edited), ("near_next", own[order[(k + 1) % len(order)]])):
            assert abs(x[name] - max(0.0, math.cos(math.pi * (own[i] ^ other).bit_count() / 128))) < 1e-12
        assert x["n_near"] == (sum((own[i] ^ v).bit_count() <= 3 for v in own.values()) - 1 if i % 20 == 0 else None)
    assert any(x["n_near"] for x in got.values())


@pytest.mark.parametrize("per_part", [10_000, 2])
def test_neighbours_against_brute_force(spark, per_part):
    r = random.Random(3)
    base = [r.getrandbits(128) for _ in range(20)]
    values = base + [b ^ sum(1 << r.randrange(128) for _ in range(r.randint(1, 6))) for b in base]
    values += [values[0] ^ 1 << k for k in range(0, 128, 5)]  # blocks that many share
    df = spark.createDataFrame([(f"{v:032x}",) for v in [*values, values[3]]] + [(None,)], "fingerprint string")
    for radius in (0, 1, 4):
        got = [(x["query"], x["found"], x["distance"], x["n_found"]) for x in simhash.neighbours(df, df, radius, per_part=per_part).collect()]
        kinds = set(values)
        want = [(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count(), 2 if b == values[3] else 1) for a in kinds for b in kinds if (a ^ b).bit_count() <= radius]
        assert sorted(got) == sorted(want)


def test_a_second_attempt_keeps_the_first_file(tmp_path):
    """Stores that don't replace files keep the first attempt's; drafts of lost executors are swept."""
    from pyarrow import fs

    class Strict(fs.LocalFileSystem):
        def move(self, src, dest):
            if self.get_file_info(dest).type == fs.FileType.File:
                raise OSError("exists")
            super().move(src, dest)

    (tmp_path / ".one").write_text("x")
    (tmp_path / ".two").write_text("x")
    (tmp_path / ".lost").write_text("x")
    for draft in (".one", ".two"):
        tokenfile._put(Strict(), f"{tmp_path}/{draft}", f"{tmp_path}/part.tok")
    with pytest.raises(OSError):
        tokenfile._put(Strict(), f"{tmp_path}/nothing", f"{tmp_path}/other.tok")
    tokenfile._sweep(str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["part.tok"]
