"""Every operator of the list on tables with nulls, empty and very long texts,
ties, repeated rows and clashing column names, on empty tables, and against
brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from touchline.llm import embeddings, mixing, packing, quality, queries, sharding, simhash, store, substring, tokens, topk, toxicity
from touchline.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, part int, size int, shard string, score double, _part int, n_words string, label string, fp long, start long, bucket int"


def documents() -> list[tuple]:
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["Éa", "x,", "y.", "über", "\x1cq"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = text(60), text(200)
    out: list[tuple] = [(i, text(rng.randint(1, 120)), rng.choice(["en", None]), rng.choice(["a", "b", "ä", None])) for i in range(60)]
    out += [(60, None, None, None), (61, "", "en", "a"), (62, " \n\t ", "en", "b"), (63, text(20_000), "en", "a"), (None, "lost words here", "en", "a"), (None, None, None, None)]
    out += [(64 + i, base, "en", "a") for i in range(5)] + [(70 + i, f"{text(50)}\n{passage}\n{text(40)}", "en", "b") for i in range(4)]
    out += [(80 + i, base.replace("w1 ", f"v{i} ", 1), "en", "a") for i in range(3)] + [(90, passage[:40], "en", "a")] * 3
    out += [(91, "ABC def  ghi", "en", "a"), (92, "abc DEF ghi", "en", "a"), (93, "one", "en", "a"), (94, "one two", "en", "a"), (95, f"{passage} {passage}", "de", "b"), (96, "a<|endoftext|> b <|startoftext|>", "en", "b")]
    return [(*r, None if r[1] is None else len(r[1]), 1, 2, "s", 0.5, 3, "n", None, 7, 8, 9) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOC_COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC_COLUMNS)


def path(name: str) -> str:
    return queries.tokenizer(name)


def ids_of(text: str | None, name: str) -> np.ndarray:
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(path(name)).encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@pytest.mark.parametrize(("kind", "name"), [("words", "word_bpe_49k.json"), ("bytes", "byte_bpe_50k.json")])
def test_encoders_agree_with_whole_texts(kind, name):
    rng = random.Random(1)
    letters = [" ", "\n", "a", "B", "1", "'s", "!", ".", ",", "\t", "é", " ", "\x1c", "́", "<|endoftext|>", "漢", "\x00", "\x85", "İ", "Σ"]
    own = tokens.encoder(kind, path(name))
    for text in ["", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(4000)), *(r[1] for r in documents() if r[1])]:
        assert own.ids(text) == own.raw(text), text


def test_texts_encoded_together_agree_with_whole_texts(monkeypatch):
    """What is new in texts is encoded once for all of them, also with a memo
    that is full and pieces that it doesn't keep."""
    rng = random.Random(2)
    letters = [" ", " ", "\n", "ab", "B", "1", "'s", "!", ".", ",", "\t", "é", "<|endoftext|>", "\x00", "\x85", "x" * 70]
    texts = ["", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(600)), *(r[1] for r in documents() if r[1]), ""]
    own = tokens.Bytes(path("byte_bpe_50k.json"))
    for most in (1_000_000, 50):
        monkeypatch.setattr(tokens, "MEMO", most)
        for at in range(0, len(texts), 40):
            assert own.many(texts[at : at + 40]) == [own.raw(t) for t in texts[at : at + 40]]
            assert max(map(len, own.memo)) <= tokens.LONGEST
    assert own.many([]) == []
    fresh, asked = tokens.Bytes(path("byte_bpe_50k.json")), []
    learn = fresh.learn
    monkeypatch.setattr(fresh, "learn", lambda stems: asked.append(stems) or learn(stems))
    fresh.many([t for t in texts if "\x00" not in t])
    assert len(asked) == 1 and len(set(asked[0])) == len(asked[0])


def test_columns_of_texts_agree_with_whole_texts(monkeypatch):
    """Cuts before marks that follow letters, signs that only look like
    letters, nulls, slices, and groups and slices of a few bytes."""
    rng = random.Random(5)
    letters = [" ", " ", " ", "\n", "ab", "Z", "é", "×", "÷", "ė", "ŉ", "Ġ", "漢", "İ", "7", "²", "'", "'s", "!", "...", ",", "_", "<|", "|>", "<|endoftext|>", "“", "\u0301", "\x00", "\x85", "\u00a0", "\t", "x" * 70]
    texts = [None, "", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(4000)), None, *(r[1] for r in documents()), ""]
    plain = [" ".join(rng.choice(["word", "Élan", "été", "end.", "x***", "don't", "3rd", "a×b", "漢字,"]) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    own = tokens.Bytes(path("byte_bpe_50k.json"))
    for part in (texts, plain):
        want = [own.raw(t or "") for t in part]
        for group, one in ((32 << 20, 1 << 18), (200, 7)):
            monkeypatch.setattr(store, "GROUP", group)
            monkeypatch.setattr(tokens, "SLICE", one)
            for kind in (pa.string(), pa.large_string()):
                assert list(store.encoded_texts(own, pa.array(["cut off", *part], kind).slice(1))) == want
    assert list(store.encoded_texts(own, pa.array([], pa.string()))) == []


def test_a_column_encodes_each_different_word_once():
    """A word with other marks after it is no new word, and nothing of a
    column's pieces stays in a Python worker."""
    words = [f"{a}{b}{c}" for a in "BDFGK" for b in ("ane", "ilo", "urt") for c in ("na", "shé", "ti")]
    texts = [f"a {w}{mark} b" for w in words for mark in ("", ",", ".", "!!", "***", "###")]
    own, asked = tokens.Bytes(path("byte_bpe_50k.json")), []
    assert list(store.encoded_texts(own, pa.array(texts))) == [own.raw(t) for t in texts]
    assert not own.memo
    encoded = own.encoded
    own.encoded = lambda pieces, good: asked.extend(pieces.to_pylist()) or encoded(pieces, good)
    list(store.encoded_texts(own, pa.array(texts)))
    assert len(asked) == len(words) + 7


def test_a_worker_holds_one_memo():
    """Workers live on from stage to stage; a task lets go what another
    operator's tasks remembered, and keeps its own."""
    words = tokens.encoder("words", path("word_bpe_49k.json"))
    words.ids("some words")
    assert words.memo and tokens.encoder("words", path("word_bpe_49k.json")).memo
    quality.begin()
    assert not words.memo
    quality.buckets(b"some words")
    quality.begin()
    assert len(quality._grams) == 2
    other = tokens.encoder("bytes", path("byte_bpe_50k.json"))
    assert not quality._grams
    other.ids("some words")
    words = tokens.encoder("words", path("word_bpe_49k.json"))
    assert not other.memo and words.ids("Some words") == words.raw("Some words")


def test_packing(docs, empty):
    got = packing.pack(docs, path("word_bpe_49k.json"), capacity=256).collect()
    want = Counter()
    for r in documents():
        ids = ids_of(r[1], "word_bpe_49k.json")
        want.update((r[0], k // 256, k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes())) for k in range(0, len(ids), 256))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(n * k[3] for k, n in want.items())
    assert len(bins) <= total / 256 * 1.05 + 1
    assert packing.pack(empty, path("word_bpe_49k.json")).count() == 0


def test_best_two_fit_replaces_the_smallest():
    # greedy gives 6 + 3 (gap 1); 2 + 2 fit the expanded gap of 4 exactly
    bins, offsets = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert bins[0] == bins[2] == bins[3] != bins[1]
    rng = np.random.default_rng(0)
    for _ in range(50):
        lengths = rng.integers(1, 33, rng.integers(1, 80))
        bins, _ = packing.best_two_fit(lengths, 32)
        assert np.bincount(bins, lengths).max() <= 32


def test_token_store(spark, docs, empty, tmp_path):
    place = f"file://{tmp_path}/store"
    store.write(docs, place, path("byte_bpe_50k.json"))
    store.verify(spark, place)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in store.digests(spark, place).collect())
    at, order = 0, sorted((r[0] is not None, r[0] or 0) for r in documents())
    assert [(d is not None, d or 0) for _, d, _, _ in got] == order
    for start, _, n, _ in got:
        assert start == at
        at += n
    want = Counter((r[0], len(i), zlib.crc32(i.tobytes())) for r in documents() for i in [ids_of(r[1], "byte_bpe_50k.json")])
    assert Counter((d, n, c) for _, d, n, c in got) == want
    whole = {(r.doc_id, r.start): r.ids for r in store.read(spark, place).collect()}
    assert Counter((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, _), i in whole.items()) == want
    keys = [r.key for r in store.chunks(spark, place).collect()]
    assert len(keys) == len(set(map(bytes, keys)))
    store.write(empty, f"{place}-empty", path("byte_bpe_50k.json"))
    assert store.digests(spark, f"{place}-empty").count() == 0


def stored(spark, docs, tmp_path) -> str:
    place = f"file://{tmp_path}/store"
    store.write(docs.limit(20), place, path("byte_bpe_50k.json"))
    return place


def rewritten(spark, folder: str, change) -> None:
    old = spark.read.parquet(folder)
    rows, schema = old.collect(), old.schema
    spark.createDataFrame([change(r.asDict()) for r in rows], schema).write.mode("overwrite").parquet(folder)


def swapped_sizes(r: dict) -> dict:
    sizes = np.frombuffer(r["sizes"], "<u4").copy()
    if len(sizes) > 1:
        sizes[:2] += np.array([1, -1], "<i4").astype("<u4")
    return r | {"sizes": bytearray(sizes.tobytes())}


@pytest.mark.parametrize("change", [lambda r: r | {"n_tokens": r["n_tokens"] + 1}, lambda r: r | {"start": r["start"] + 1}, lambda r: r | {"doc_id": (r["doc_id"] or 0) + 1}, lambda r: r | {"row": r["row"] + 1}, lambda r: r | {"keys": bytearray(bytes(r["keys"])[::-1])}, swapped_sizes])
def test_tampered_recipe_is_found(spark, docs, tmp_path, change):
    place = stored(spark, docs.where("length(text) > 900"), tmp_path)
    rewritten(spark, f"{place}/recipes", change)
    with pytest.raises(ValueError, match="manifest"):
        store.verify(spark, place)


def test_sizes_are_compared_with_chunks(spark, docs, tmp_path):
    place = stored(spark, docs.where("length(text) > 900"), tmp_path)
    rewritten(spark, f"{place}/recipes", swapped_sizes)
    with pytest.raises(Exception, match="size isn't what its recipe says"):
        store.digests(spark, place).collect()


def test_tampered_or_lost_chunk_is_found(spark, docs, tmp_path):
    place = stored(spark, docs, tmp_path)
    folder = f"{place}/encoded/kind=chunk"
    rewritten(spark, folder, lambda r: r | {"data": bytearray(bytes([r["data"][0] ^ 1]) + bytes(r["data"])[1:])})
    with pytest.raises(Exception, match="isn't what its name says"):
        store.digests(spark, place).collect()
    place = stored(spark, docs, tmp_path / "second")
    folder = f"{place}/encoded/kind=chunk"
    old = spark.read.parquet(folder)
    rows, schema = old.collect(), old.schema
    spark.createDataFrame(rows[1:], schema).write.mode("overwrite").parquet(folder)
    with pytest.raises(Exception, match="a chunk is missing"):
        store.digests(spark, place).collect()


def test_recipes_stand_in_order_and_manifest_has_levels(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FAN", 4)
    place = f"file://{tmp_path}/store"
    store.write(docs, place, path("byte_bpe_50k.json"))
    store.verify(spark, place)
    files = sorted((tmp_path / "store" / "recipes").glob("*.parquet"))
    import pyarrow.parquet as pq

    rows = [r for f in files for r in pq.read_table(f, columns=["row", "doc_id", "start"]).to_pylist()]
    assert [r["row"] for r in rows] == list(range(len(documents())))
    assert [r["start"] for r in rows] == sorted(r["start"] for r in rows)
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    levels = len(list((tmp_path / "store" / "manifest").glob("level=*")))
    assert levels == 4  # 84 documents: 21, 6, 2, 1 blocks
    rewritten(spark, f"{place}/manifest/level=1", lambda r: r | {"n_tokens": r["n_tokens"] + 1})
    with pytest.raises(ValueError, match="manifest"):
        store.verify(spark, place)


def test_crc_of_parts():
    rng = np.random.default_rng(1)
    a, b = rng.bytes(1000), rng.bytes(12_345)
    shifted = store.crc_shift(np.array([zlib.crc32(a)]), np.array([len(b)]))[0]
    assert int(shifted) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_substring(docs, empty):
    got = substring.remove_repeats(docs, window=35, part_bytes=20_000).collect()
    rows = documents()
    words = [WORD.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = Counter()
    for r, w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[(r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert all(r.kept_text == r.text for r in got if not r.n_removed)
    assert sum(r.n_removed for r in got) > 1000
    assert substring.remove_repeats(empty).count() == 0


def test_simhash(docs, empty):
    def fingerprint(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(r[0], fingerprint(r[1])) for r in documents()]
    known = sorted({r for r in rows if r[0] is not None})
    low = {d: d for d, _ in known}
    for _ in range(10):
        for a, x in known:
            for b, y in known:
                if (x ^ y).bit_count() <= 2:
                    low[a] = min(low[a], low[b])
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((d, f"{x:016x}", low.get(d)) for d, x in rows)
    assert simhash.near_duplicates(empty).count() == 0


def test_covering_masks_meet_every_pair_within_the_radius():
    rng = random.Random(0)
    for radius in (1, 2, 3):
        each = simhash.masks(radius)
        for _ in range(300):
            differing = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
            assert any(not differing & m for m in each)


def test_similar_groups(spark, docs, empty):
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert {got[i] for i in (64, 65, 66, 67, 68, 80, 81, 82)} == {64}
    assert got[0] == 0 and got[63] == 63
    assert simhash.similar_groups(empty).count() == 0


@pytest.mark.parametrize("spread", [2, 60])
def test_bucket_pairs_connect_all_that_is_near(spread):
    """Small and large buckets, with strangers, pairs, chains and groups."""
    rng = random.Random(8)
    entries = np.empty(900, simhash.ENTRY)
    base = [rng.getrandbits(96) for _ in range(12)]
    for i in range(len(entries)):
        x = rng.getrandbits(96) if i % 3 else base[i % 12]
        for _ in range(rng.randint(0, 9)):
            x ^= 1 << rng.randrange(96)
        entries[i] = (rng.randrange(spread), x >> 64, i % 880, x & (1 << 64) - 1)
    bits = lambda r: int(r["tail"]) << 64 | int(r["head"])
    near = {(max(a["rep"], b["rep"]), min(a["rep"], b["rep"])) for a, b in itertools.combinations(entries, 2) if a["key"] == b["key"] and a["rep"] != b["rep"] and (bits(a) ^ bits(b)).bit_count() <= 12}
    src, dst, dense = simhash.bucket_pairs(entries, 12)
    got = set(zip(src.tolist(), dst.tolist(), strict=True))
    closed = lambda pairs: {x: {y for y in range(880) if group[y] == group[x]} for group in [joined(pairs)] for x in range(880)}

    def joined(pairs: set) -> list[int]:
        low = list(range(880))
        for _ in range(30):
            for a, b in pairs:
                low[a] = low[b] = min(low[a], low[b])
        return low

    assert near and closed(got) == closed({(int(a), int(b)) for a, b in near})
    assert dense.any() == (spread == 2) and all((a, b) in near for a, b, d in zip(src, dst, dense, strict=True) if not d)
    assert [len(x) for x in simhash.bucket_pairs(entries[:0], 12)] == [0, 0, 0]


def test_similar_groups_beside_strangers_in_every_bucket(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(30)]
    rows = [*enumerate(texts), (30, texts[20] + " and more"), (31, texts[25] + " and more")]
    # one bucket for all: masks that hold no bits
    monkeypatch.setattr(simhash, "masks", lambda *_: [0])
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: i for i in range(30)}, 30: 20, 31: 25}


@pytest.mark.parametrize("bytes_", [3_000, 16 << 20])
def test_similar_groups_are_exact_about_the_similarity(spark, monkeypatch, bytes_):
    """Also with a block for each row of a cluster."""
    rng = random.Random(11)
    monkeypatch.setattr(simhash, "CELL_BYTES", bytes_)
    rows, want = [], {}
    for i in range(240):
        words = [f"w{rng.randrange(50_000)}" for _ in range(304)]
        other = list(words)
        # k words changed at the end leave 300 - k shingles: 300 - k of 300 + k are common
        k = (24, 33, 34, 50)[i % 4]
        other[-k:] = [f"v{rng.randrange(50_000)}" for _ in range(k)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        want[2 * i + 1] = (300 - k) / (300 + k) >= 0.8
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not [d for d, near in want.items() if not near and got[d] != d]
    assert sum(near and got[d] != d - 1 for d, near in want.items()) <= 3
    assert all(got[d - 1] == d - 1 for d in want)


@pytest.mark.parametrize("settings", [{}, {"CELL_BYTES": 50_000}, {"HOT": 20, "CELL_BYTES": 200_000}])
def test_a_large_group_of_near_copies_gives_few_pairs(spark, monkeypatch, settings):
    """In one cell, in blocks, and with hot buckets."""
    rng = random.Random(17)
    base = [f"w{rng.randrange(50_000)}" for _ in range(280)]
    rows = []
    for i in range(300):  # each two differ in some six words: similarities about 0.8 and on both sides of it
        words = list(base)
        for _ in range(3):
            words[rng.randrange(280)] = f"v{rng.randrange(50_000)}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    low = list(range(300))
    near = [(a, b) for a in range(300) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    assert len(near) > 5000
    for _ in range(20):
        for a, b in near:
            low[a] = low[b] = min(low[a], low[b])
    for name, value in settings.items():
        monkeypatch.setattr(simhash, name, value)
    pairs = written_pairs(monkeypatch)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == dict(enumerate(low))
    assert sum(pairs) < 300 * 20, pairs


def written_pairs(monkeypatch) -> list[int]:
    """The numbers of candidates written, and of links."""
    seen, kept = [], simhash.written

    def counted(df, name, *more):
        out = kept(df, name, *more)
        if name in ("candidates", "links"):
            seen.append(out.count())
        return out

    monkeypatch.setattr(simhash, "written", counted)
    return seen


@pytest.mark.parametrize("own", [35, 60])
def test_documents_of_one_template_are_not_written_as_pairs(spark, monkeypatch, own):
    """2,000 documents, each two at a similarity of 0.79 or 0.66: none links."""
    rng = random.Random(19)
    template = [f"w{rng.randrange(50_000)}" for _ in range(300)]
    rows = [(i, " ".join([*template[:150], *(f"v{rng.randrange(10**9)}" for _ in range(own)), *template[150:]])) for i in range(2_000)]
    pairs = written_pairs(monkeypatch)
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).where("doc_id <> component_id").count()
    assert got == 0
    assert sum(pairs) < 20 * len(rows), pairs


def near_copies(n: int, changed: int = 2) -> list[tuple]:
    """n documents of one base, some words changed in each."""
    rng = random.Random(23)
    base = [f"w{rng.randrange(50_000)}" for _ in range(280)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(changed):
            words[rng.randrange(280)] = f"v{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    return rows


def met_rows(spark, rows: list[tuple]) -> tuple[int, set]:
    """How many candidates meet in all tables, and the groups that they make."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    classes = simhash.written(simhash.fingerprints(docs, 5, 12, distinct=True).select(F.col("doc_id").alias("rep"), "fp"), "classes")
    found = simhash.written(simhash.meetings(classes, simhash.Tables(12, 30, 40, 1), 28), "met")
    return found.count(), {tuple(r) for r in components(found.select("src", "dst")).collect()}


def test_near_copies_meet_once_not_in_every_table(spark, monkeypatch):
    """As many rows a member in a group three times as large, and the same
    groups as without leaders."""
    small, large = near_copies(600), near_copies(1_800)
    few, _ = met_rows(spark, small)
    many, groups = met_rows(spark, large)
    assert few < 20 * len(small) and many < 20 * len(large), (few, many)
    monkeypatch.setattr(simhash, "KNOWN", 10**9)
    monkeypatch.setattr(simhash, "HOT", 10**9)
    unled, same = met_rows(spark, large)
    assert groups == same and unled > 60 * len(large), unled


def test_bucket_pairs_leave_out_what_a_leader_connects():
    """With the ties to leaders, pairs and stars connect what they connect
    without leaders."""
    rng = random.Random(29)
    entries = np.empty(600, simhash.ENTRY)
    base = [rng.getrandbits(96) for _ in range(20)]
    for i in range(len(entries)):
        x = base[i % 20] if i % 5 else rng.getrandbits(96)
        for _ in range(rng.randint(0, 7)):
            x ^= 1 << rng.randrange(96)
        entries[i] = (rng.randrange(6 if i % 2 else 90), x >> 64, i, x & (1 << 64) - 1)
    src, dst, _ = simhash.bucket_pairs(entries, 12)
    pairs = {*zip(src.tolist(), dst.tolist(), strict=True)}
    # every other row that a pair links to a smaller one has that as its leader
    leader = np.full(600, -1, np.int32)
    for a, b in pairs:
        if a % 2:
            leader[a] = max(leader[a], b)
    ties = {(a, b) for a, b in enumerate(leader.tolist()) if b >= 0}
    src, dst, _ = simhash.bucket_pairs(entries, 12, leader)
    led = {*zip(src.tolist(), dst.tolist(), strict=True)}

    def joined(edges: set) -> list[int]:
        low = list(range(600))
        for _ in range(40):
            for a, b in edges:
                low[a] = low[b] = min(low[a], low[b])
        return low

    assert len(led) < len(pairs) and joined(led | ties) == joined(pairs)
    assert not [(a, b) for a, b in led if leader[a] >= 0 and leader[a] == leader[b]]


def test_similar_groups_find_every_band(spark):
    rng = random.Random(15)
    rows, bands = [], defaultdict(list)
    sets = lambda words: {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    at = 0
    while min(len(bands[b]) for b in range(4)) < 60:
        words = [f"w{rng.randrange(50_000)}" for _ in range(rng.choice([60, 150, 400]))]
        other = list(words)
        for _ in range(rng.randint(1, max(1, len(words) // 40))):  # words replaced anywhere
            other[rng.randrange(len(other))] = f"v{rng.randrange(50_000)}"
        a, b = sets(words), sets(other)
        similarity = len(a & b) / len(a | b)
        band = int((similarity - 0.8) * 20 + 1e-9) if similarity >= 0.8 else -1
        if similarity < 1 and len(bands[band]) < 60:
            bands[band].append(at)
            rows += [(at, " ".join(words)), (at + 1, " ".join(other))]
            at += 2
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    shares = {b: sum(got[i + 1] == i for i in own) / len(own) for b, own in bands.items()}
    assert shares[-1] == 0
    assert all(shares[b] >= 0.95 for b in range(4)), shares


def test_mixing(docs, empty):
    got = mixing.mix(docs, block=16, shard_rows=10).collect()
    again = mixing.mix(docs.repartition(5), block=16, shard_rows=10).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes, source = Counter(), defaultdict(int)
    for r in documents():
        n = len(WORD.findall(r[1] or ""))
        sizes[(r[0], n)] += 1
        source[r[3]] += n
    assert Counter((r.doc_id, r["size"]) for r in got) == sizes
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    names = sorted(source, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want = {s: 0.0 for s in names}
    open_, left = set(names), 1.5 * sum(source.values())
    while open_ and left > 1e-9:
        level = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in sorted(open_, key=str):
            want[s] += level * weight[s]
            if want[s] > 2 * source[s]:
                left += want[s] - 2 * source[s]
                want[s] = 2.0 * source[s]
                open_.discard(s)
    by_size = {(r.source_size, round(r.target, 6)) for r in got}
    assert by_size == {(source[s], round(want[s], 6)) for s in names}
    taken = defaultdict(int)
    for r in got:
        taken[r.source_size] += r.taken
    for s in names:
        assert abs(taken[source[s]] - want[s]) <= 16 * (2 + len(got) / 10)
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("share", [0.2, 0.33, 0.6, 1.4])
def test_copies_hold_what_the_mix_takes(spark, share):
    import corpus_pipeline

    rng = random.Random(10)
    sizes = [rng.choice([rng.randint(1, 100), rng.randint(3000, 9000)]) for _ in range(2000)]
    total = sum(sizes)
    # long documents have the source's ratio, short ones all or nothing
    taken = [round(n * share) if n >= 3000 else n * (rng.random() < share) for n in sizes]
    mixed = spark.createDataFrame([(i, n, total, total * share, t) for i, (n, t) in enumerate(zip(sizes, taken, strict=True))], "doc_id long, size long, source_size long, target double, taken long")
    docs = spark.createDataFrame([(i, "x") for i in range(2000)], "doc_id long, text string")
    times = Counter(r.doc_id for r in corpus_pipeline.copied(docs, mixed, shard_rows=500).collect())
    assert all(taken[i] // n <= times[i] <= -(-taken[i] // n) for i, n in enumerate(sizes))
    for part in (range(0, 3000), range(3000, 9001)):
        want = sum(t for n, t in zip(sizes, taken, strict=True) if n in part)
        assert abs(sum(sizes[i] * k for i, k in times.items() if sizes[i] in part) - want) <= 6 * 9000
    # rows without doc_id draw one by one
    lost = spark.createDataFrame([(None, f"text {i}") for i in range(400)], docs.schema)
    gone = spark.createDataFrame([(None, 100, 40_000, 40_000 * share, int(100 * share))] * 400, mixed.schema)
    assert abs(corpus_pipeline.copied(lost, gone).count() - 400 * share) < 60


def test_apportionment_by_highest_quotients(spark):
    votes = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0, "e": 24.0}
    for seats in (0, 1, 7, 23, 100):
        rows = spark.createDataFrame([(1, k, x, seats, 10_000) for k, x in votes.items()], "g int, k string, votes double, seats long, most long")
        got = {r.k: r.quota for r in mixing.apportioned(rows, ["g"], ["k"], "votes", "seats", "most").collect()}
        want = dict.fromkeys(votes, 0)
        for _ in range(seats):
            best = max(sorted(votes), key=lambda k: votes[k] / (2 * want[k] + 1))
            want[best] += 1
        assert got == want


@pytest.mark.parametrize("limit", [300, 2_000, 10**9])
def test_sharding(docs, empty, limit):
    got = sharding.shard(docs, limit).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter((r[0], len((r[1] or "").encode())) for r in documents())
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    for name, own in shards.items():
        total = sum(r.n_bytes for r in own)
        assert {r.shard_bytes for r in own} == {total}
        assert total <= limit or len(own) == 1, name
        if own[0].depth and "." not in name:
            # the bucket it was split from was too large
            assert sum(r.n_bytes for r in got if r.shard.startswith(name[:-1])) > limit
    assert sharding.shard(empty, limit).count() == 0


def test_equal_keys_are_cut_by_size(spark):
    rng = random.Random(13)
    sizes = [rng.choice([0, 1, 7, 30, 80, 150]) for _ in range(600)]
    table = spark.createDataFrame([(None if i % 3 else 7, "x" * n) for i, n in enumerate(sizes)], "doc_id long, text string").repartition(5)
    got = sharding.shard(table, 100).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter((None if i % 3 else 7, n) for i, n in enumerate(sizes))
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    for own in shards.values():
        total = sum(r.n_bytes for r in own)
        assert {(r.doc_id, r.shard_bytes) for r in own} == {(own[0].doc_id, total)}
        assert total <= 100 or len(own) == 1
    # at most one way in two is half empty
    assert len([s for s, own in shards.items() if own[0].n_bytes <= 50]) <= 2 * sum(n for n in sizes if n <= 50) / 50 + 4


@pytest.mark.parametrize("most_hubs", [0, 5])
def test_components_of_stars_and_chains(spark, most_hubs):
    rng = random.Random(14)
    # a star about the largest and one about the smallest node, a chain, and their bridge
    edges = [(9_000, i) for i in range(10, 1_600)] + [(2_000, i) for i in range(2_001, 3_500)] + [(i, i + 1) for i in range(4_000, 4_040)] + [(4_010, 700), (8_000, 8_001), (8_001, 8_001)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long").repartition(4), most_hubs=most_hubs).collect()}
    want = {i: 10 for i in [*range(10, 1_600), 9_000, *range(4_000, 4_041)]} | {i: 2_000 for i in range(2_000, 3_500)} | {8_000: 8_000, 8_001: 8_000}
    assert got == want


def jobs_of(spark, group: str, work) -> tuple[int, object]:
    """The Spark jobs that work() takes, and its result."""
    context = spark.sparkContext
    context.setJobGroup(group, group)
    try:
        out = work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return len(context.statusTracker().getJobIdsForGroup(group)), out


def test_components_are_few_jobs(spark):
    """Stars end at once, and a round with hubs doesn't compute one minimum many times."""
    stars = [(k * 10_000, k * 10_000 + i) for k in range(1, 4) for i in range(1, 1_300)]
    edges = spark.createDataFrame(stars, "src long, dst long").repartition(4)
    n, found = jobs_of(spark, "stars", lambda: components(edges))
    assert n <= 8
    assert {(r.node, r.component) for r in found.collect()} == {(i, a) for a, b in stars for i in (a, b)}
    bridged = spark.createDataFrame([*stars, (10_700, 20_001), (20_700, 30_001)], "src long, dst long").repartition(4)
    n, found = jobs_of(spark, "bridged", lambda: components(bridged))
    assert n <= 60
    assert {(r.node, r.component) for r in found.collect()} == {(i, 10_000) for e in stars for i in e}


VECTOR_COLUMNS = "vec_id long, embedding array<float>, label int, own int, v string, keys int, class string, rep long, rank int, score string, dim int"


def vectors() -> list[tuple]:
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 16))
    out: list[tuple] = []
    for i in range(120):
        v = base[i % 6] + rng.normal(size=16) * (0.05 if i % 3 else 1.0)
        out.append((i, [float(x) for x in v], i % 2 if i % 11 else None))
    out += [(200, None, 1), (201, [0.0] * 16, 1), (202, [1.0] * 15 + [None], 1), (203, [float("nan")] + [1.0] * 15, 1), (204, [float("inf")] + [1.0] * 15, 1), (220, [1.0, 2.0], 1), (221, [1.0, 2.0], 1), (240, [], 1)]
    out += [(300 + i, [1.0] * 16, 1) for i in range(30)] + [(300, [1.0] * 16, 1), (340, [-0.0] + [1.0] * 15, 0), (341, [0.0] + [1.0] * 15, 0)]
    return [(*r, 1, "v", 2, "c", 3, 4, "s", 5) for r in out]


def test_top_k(spark):
    table = spark.createDataFrame(vectors(), VECTOR_COLUMNS)
    rows = []
    for r in vectors():
        v = r[1]
        if v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v):
            rows.append((r[0], np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)))
    want = Counter()
    for q, a in rows:
        if q % 20 == 0:
            scores = sorted((-int(np.dot(a, b)), i) for i, b in rows if i != q and len(b) == len(a))
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:20]))
    for block in (64, 65_536):
        got = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(table, block=block, queries_each=4).collect())
        assert got == want
    assert topk.top_k(spark.createDataFrame([], VECTOR_COLUMNS)).count() == 0


def test_top_k_of_large_components(spark):
    rng = random.Random(12)
    # products of some 80 bits that sum to some 60
    rows = []
    for i in range(41):
        a, b = rng.randrange(1 << 40, 1 << 41), rng.randrange(-(1 << 18), 1 << 18)
        rows.append((i, [float(a), float(-a + b), float(rng.randrange(1 << 20))]))
    rows += [(60, [float(1 << 39), float(1 << 39), 3.0])]
    kind = "vec_id long, embedding array<double>"
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame([r for r in rows if r[0] not in (0, 20, 40)], kind), k=5, scale=1).collect()}
    query = [int(x) for x in rows[-1][1]]
    scores = sorted((-sum(x * int(y) for x, y in zip(query, v, strict=True)), i) for i, v in rows if i not in (0, 20, 40, 60))
    assert got == {(60, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])}
    # a's own squares don't fit
    with pytest.raises(Exception, match="beyond a long"):
        topk.top_k(spark.createDataFrame(rows, kind), k=5, scale=1).collect()
    with pytest.raises(Exception, match="beyond a long"):
        topk.top_k(spark.createDataFrame([(0, [1e300]), (1, [1.0])], kind)).collect()


def test_near_vectors(spark):
    table = spark.createDataFrame(vectors(), VECTOR_COLUMNS)
    ok = []
    for r in vectors():
        v = r[1]
        if v and r[2] is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            ok.append((r[0], r[2], x / np.linalg.norm(x)))
    links, low = Counter(), {r[0]: r[0] for r in vectors()}
    for n, (i, l, a) in enumerate(ok):
        links[n] = sum(m != n and l == k and len(a) == len(b) and float(a @ b) >= 0.98 for m, (_, k, b) in enumerate(ok))
    for _ in range(10):
        for i, l, a in ok:
            for j, k, b in ok:
                if l == k and len(a) == len(b) and float(a @ b) >= 0.98:
                    low[i] = min(low[i], low[j])
    rows = vectors()
    for block in (8, 1024):
        # so many tables that no link is missed
        got = embeddings.near_vectors(table, tables=80, block=block).collect()
        found = Counter((r.vec_id, r.n_links) for r in got)
        by_row = iter(range(len(ok)))
        linked = [(r[0], links[next(by_row)] if r[0] in {o[0] for o in ok} else 0) for r in rows]
        assert found == Counter(linked)
        assert all(r.component_id == low[r.vec_id] and r.kept == (r.vec_id == r.component_id) for r in got)
    usual = embeddings.near_vectors(table).collect()
    assert 0.99 * sum(links.values()) <= sum(r.n_links for r in usual) <= sum(links.values())
    assert embeddings.near_vectors(spark.createDataFrame([], VECTOR_COLUMNS)).count() == 0


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_near_vectors_keeps_chains_whole(spark, block):
    # links 1-3, 3-4, 4-2 only: 10 degrees apart in this order
    rows = [(i, [float(np.cos(np.radians(10 * at))), float(np.sin(np.radians(10 * at)))], 1) for at, i in enumerate((1, 3, 4, 2))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    # one wide cell in one table: all four meet
    got = embeddings.near_vectors(table, tables=1, width=1, w=1e6, block=block).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(1, 1, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False)}


def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 > 0), int(i % 7 == 0)) for i in range(60)] + [(None, 1, 1), (3, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")


def test_quality_on_messy_tables(spark, docs, empty):
    kept = quality.select(docs, labels(spark))
    assert kept.columns[: len(docs.columns)] == docs.columns
    n = kept.count()
    assert 0 < n <= docs.count()
    assert quality.select(docs, labels(spark), keep=0.5).count() == round(docs.count() * 0.5)
    assert quality.select(empty, labels(spark)).count() == 0
    assert quality.select(docs, labels(spark).limit(0)).count() == docs.count()


def test_quality_keeps_text_and_rejects_junk(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(20, 90)))
    junk = lambda: " | ".join(rng.choice(words) + "$$$" for _ in range(40))
    rows = [(i, junk() if i % 6 == 0 else text()) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 6 > 0)) for i in range(0, 600, 2)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.select(docs, known).collect()}
    assert sum(i in kept for i in range(600) if i % 6 == 0) <= 2
    assert sum(i in kept for i in range(600) if i % 6) >= 490


def test_quality_against_brute_force(spark, docs):
    seed, sample = 11, 12
    marks = [(r.doc_id, r.quality) for r in labels(spark).collect() if r.doc_id is not None and r.quality is not None]
    known = {d: max(q for e, q in marks if e == d) for d, _ in marks}

    def gumbel(doc: int | None) -> float:
        h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
        h = h if doc is None else xxhash.xxh64_intdigest(doc.to_bytes(8, "little", signed=True), h)
        return -math.log(-math.log((h % (1 << 52) + 0.5) / (1 << 52)))

    def drawn(q: int) -> set:
        h = lambda d: simhash.signed(xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), xxhash.xxh64_intdigest(d.to_bytes(8, "little", signed=True), 42)))
        return set(sorted((d for d, x in known.items() if x == q), key=h)[:sample])

    def grams(text: str | None) -> tuple[Counter, Counter]:
        words = (text or "").encode().split()
        own, pair = Counter(), Counter()
        for w in words:
            low = w.lower()
            own[zlib.crc32(low.strip(b".,;:!?'\"()[]{}*#$%&|") or low) % 8192] += 1
        kind = lambda c: "a" if 97 <= c <= 122 or c >= 128 else "A" if 65 <= c <= 90 else "0" if 48 <= c <= 57 else chr(c)
        form = [zlib.crc32("".join(k for k, _ in itertools.groupby(map(kind, w))).encode("latin1")) & 0xFFFF for w in words]
        for a, b, x, y in zip(words, words[1:], form, form[1:], strict=False):
            pair[(x * 40503 + y * 30011 + (zlib.crc32(a.lower()) == zlib.crc32(b.lower())) * 7919) % 4096] += 1
        return own, pair

    rows = [(r[0], grams(r[1])) for r in documents()]
    good = drawn(1)
    ratio = []
    for part, size in ((0, 8192), (1, 4096)):
        raw = sum((g[part] for _, g in rows), Counter())
        target = sum((g[part] for d, g in rows if d in good), Counter())
        raw_all, target_all = sum(raw.values()) + size, sum(target.values()) + size
        p = {b: ((target[b] + 1) / target_all, (raw[b] + 1) / raw_all) for b in range(size)}
        ratio.append({b: math.log(t / (0.99 * r + 0.01 * t)) for b, (t, r) in p.items()})
    score = [(d, sum(n * ratio[k][b] for k in (0, 1) for b, n in g[k].items())) for d, g in rows]
    keys = sorted(((d, s, s + gumbel(d)) for d, s in score), key=lambda r: (-r[2], r[0] is None, r[0]))
    got = quality.selected(docs, labels(spark), keep=0.4, sample=sample, seed=seed).collect()
    want = keys[: round(len(keys) * 0.4)]
    # ties at the cut are all in
    want += [r for r in keys[len(want) :] if r[0] == want[-1][0] and abs(r[2] - want[-1][2]) < 1e-9]
    assert Counter(r.doc_id for r in got) == Counter(d for d, _, _ in want)
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    for g, w in zip(sorted(((r.doc_id, r._score, r._key) for r in got), key=order), sorted(want, key=order), strict=True):
        assert g[1:] == pytest.approx(w[1:], abs=1e-6)
    # the share, by the point that parts the labelled documents best
    marked = [(s, known[d]) for d, s in score if d in good | drawn(0)]
    cut = max(sorted({s for s, _ in marked}), key=lambda c: (sum(s >= c for s, q in marked if q) / sum(q for _, q in marked) - sum(s >= c for s, q in marked if not q) / sum(not q for _, q in marked), c))
    below = [s for s, _ in marked if s < cut]
    point = (cut + max(below)) / 2 if below else float("-inf")
    n = quality.selected(docs, labels(spark), sample=sample, seed=seed).count()
    assert abs(n - sum(s >= point for _, s in score)) <= 2  # rows that tie in key and doc_id


def test_shapes_are_of_whole_words():
    assert quality.shape(b"a" * 300 + b"1") == b"a0"
    assert quality.shape(b"a1" * 300) == b"a0" * 300


def test_boundary_is_exact(spark):
    rng = random.Random(4)
    rows = [(i, float(rng.choice([1.5, 2.5, rng.random()]))) for i in range(500)]
    keys = spark.createDataFrame(rows, "doc_id long, key double")
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    for k in (1, 100, 250, 333, 499):
        assert quality.boundary(keys, k, few=5, bins=4) == (order[k - 1][1], order[k - 1][0])


def test_toxicity_locates_sentences(spark, docs, empty):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(150)]
    sentence = lambda bad: " ".join([rng.choice(words) for _ in range(6)] + (["scoundrel"] if bad else []) + [rng.choice(words)]) + "."
    rows, marks = [], []
    for i in range(500):
        toxic, n = i % 8 == 0, rng.randint(1, 12)
        at = rng.randrange(n) if toxic else -1
        rows.append((i, " ".join(sentence(j == at) for j in range(n)), at))
        marks.append((i, int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, at int")
    known = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(table, known.where("doc_id % 3 <> 1")).collect()}
    for i, _, at in rows:
        assert got[i].predicted == int(at >= 0)
        if at >= 0:
            assert [o.begin for o in got[i].offending] == [7 * at]
    messy = toxicity.score(docs, labels(spark)).collect()
    assert len(messy) == docs.count() and all(0 <= r.score <= 1 for r in messy)
    assert toxicity.score(empty, labels(spark)).count() == 0
    assert toxicity.score(docs, labels(spark).limit(0)).count() == docs.count()


def test_toxicity_against_brute_force(spark, docs):
    rng = random.Random(16)
    bodies = [" ".join(rng.choice(["bad", "Good,", "fine", "so.", "odd!", "w1", "w2", "w2"]) for _ in range(rng.randint(0, 25))) for _ in range(30)]
    y = np.array([i % 3 == 0 for i in range(30)])
    bags, at = toxicity.Bags(bodies), np.array(sorted({f for b in bodies for w in b.split() for f in toxicity.features(w)}))
    w = np.zeros(toxicity.BUCKETS)
    w[at] = np.random.default_rng(1).normal(size=len(at))
    weight = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())

    def document(body: str, w: np.ndarray, bias: float) -> float:
        """1 - prod(1 - p) over sentences."""
        clean, sentence, words = 1.0, [], body.split()
        for i, word in enumerate(words):
            sentence.append(word)
            if word[-1] in ".!?" or i == len(words) - 1:
                z = bias + sum(sum(w[f] for f in toxicity.features(x)) for k, x in enumerate(sentence) if not k or sentence[k - 1] != x)
                clean, sentence = clean / (1 + math.exp(z)), []
        return 1 - (clean if words else 1 / (1 + math.exp(bias)))

    def loss(w: np.ndarray, bias: float) -> float:
        p = [document(b, w, bias) for b in bodies]
        return -sum(g * math.log(q if t else 1 - q) for g, q, t in zip(weight, p, y, strict=True))

    own, grad, by_bias = toxicity.loss_and_gradient(bags, y, weight, w, -1.5)
    assert own == pytest.approx(loss(w, -1.5))
    for f in at:
        up, down = w.copy(), w.copy()
        up[f] += 1e-5
        down[f] -= 1e-5
        assert grad[f] == pytest.approx((loss(up, -1.5) - loss(down, -1.5)) / 2e-5, abs=1e-7)
    assert by_bias == pytest.approx((loss(w, -1.5 + 1e-5) - loss(w, -1.5 - 1e-5)) / 2e-5, abs=1e-7)
    # what score() gives is the fitted model's noisy-or of whole texts, equal for equal texts
    known = labels(spark)
    bodies, toxic = toxicity.training_sample(docs, known, 3_000, 1 << 20, 5)
    model = toxicity.fit(bodies, toxic)
    full = np.zeros(toxicity.BUCKETS)
    full[model.at] = model.values
    shift = math.exp(toxicity.calibration(bodies, toxic, 0.7))
    moved = lambda p: p * shift / (p * shift + 1 - p)
    want = Counter((r[0], round(moved(document(r[1] or "", full, model.bias)), 9)) for r in documents())
    assert Counter((r.doc_id, round(r.score, 9)) for r in toxicity.score(docs, known, most_bytes=1 << 20).collect()) == want


def test_toxicity_learns_from_long_documents_and_stably(spark):
    long = "fine words here. " * 3_000 + "scoundrel talk. " + "more words. " * 2_000
    rows = [(i, long if i % 2 == 0 else "fine words here. more words. talk.") for i in range(40)] + [(3, "another text."), (5, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)], "doc_id long, toxic int")
    bodies, toxic = toxicity.training_sample(table, known, 3_000, 64 << 20, 5)
    assert len(bodies) == 40 and sum(toxic) == 20 and sum(len(b) > 20_000 for b in bodies) == 20
    again = toxicity.training_sample(table.repartition(7), known, 3_000, 64 << 20, 5)
    assert bodies == again[0] and "another text." in bodies and "" in bodies
    for bound in (20_000, 200_000):  # long texts come last, as far as the bound and one more
        few, marks = toxicity.training_sample(table, known, 3_000, bound, 5)
        own = sorted(len(b) for b, t in zip(few, marks, strict=True) if t)
        assert 1 <= len(own) < 20 and sum(own[:-1]) < bound and sum(marks == 0) == 20
    got = {r.doc_id: r.predicted for r in toxicity.score(table.where("doc_id > 5"), known).collect()}
    assert got == {i: int(i % 2 == 0) for i in range(6, 40)}


def test_sentence_ends():
    found = {w: toxicity.ends(w) for w in ('end."', "end!)", "so…»", '"', ")", "word", "a.b", ".")}
    assert [w for w, e in found.items() if e] == ['end."', "end!)", "so…»", "."]


def test_clean_long_texts_stay_clean(spark):
    """Noisy-or over thousands of sentences; the model learns from short texts and few long ones."""
    rng = random.Random(21)
    words = [f"word{i}" for i in range(300)]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(9)) + "."
    text = lambda n: " ".join(sentence() for _ in range(n))
    rows = [(i, text(rng.choice([5, 20, 60])) + (" you utter scoundrel, vile words." if i % 2 else "")) for i in range(200)]
    rows += [(i, text(1_500)) for i in range(200, 240)] + [(i, text(1_500) + " vile scoundrel. " + text(100)) for i in range(240, 250)]
    known = spark.createDataFrame([(i, i % 2 if i < 200 else 0) for i in range(220)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), known).where("doc_id >= 220").collect()}
    assert sum(got[i] for i in range(220, 240)) <= 1 and sum(got[i] for i in range(240, 250)) >= 9


CLASHES = "doc_id long, text string, lang string, source string, n_chars long, _copy int, _times string, _score int, _key string, n_words int, n_removed string, removed int, kept_text string, kept_sha256 int, _part int, component_id int, fp int, _gone string, _rate int, size string, taken int"


def test_pipeline_keeps_clashing_columns_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    names = [c.split()[0] for c in CLASHES.split(", ")]
    rows = [(*r[:5], *[str(r[0]) if "string" in c else (r[0] or 0) for c in CLASHES.split(", ")[5:]]) for r in documents()]
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, CLASHES)
    nothing = docs.limit(0)
    want = {r[0]: r[5:] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == names, name
        got = out.collect()
        assert got and all(tuple(r)[5:] == want[r.doc_id] for r in got), name
        assert stage(spark, nothing, str(tmp_path)).collect() == []
        if name == "mixing sources":  # documents without words are none of a mix
            assert not [r for r in got if not WORD.search(r.text or "")]
    assert corpus_pipeline.pack_sequences(spark, nothing, str(tmp_path)).count() == 0
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_on_a_small_table(spark, tmp_path):
    import corpus_pipeline

    plain = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([r[:5] for r in documents()], plain).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == plain.replace(" long", "").replace(" string", "").split(", ")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
